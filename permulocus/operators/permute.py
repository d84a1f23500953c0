"""Random placements. All draws are functions of (seed, what is drawn, row id, permutation), see functions.rng."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng
from .overlap import overlap_pairs


def random_bins(annotations: DataFrame, n: int, dmin: int, dmax: int, seed: int = 0) -> DataFrame:
    """aid, side, perm, chrom, start, end: n / 2 bins up- and n / 2 downstream of each annotation, of its width.

    Distances count from the annotation's middle. Annotations of dmax - dmin or more bases have no room and get none.
    Bins are not held inside the chromosome.
    """
    if n < 2 or n % 2:
        raise ValueError("n must be an even number of at least 2")
    if dmin < 0 or dmax <= dmin:
        raise ValueError("0 <= dmin < dmax must hold")
    width, mid = F.col("end") - F.col("start"), F.floor((F.col("start") + F.col("end")) / 2)
    room = F.lit(dmax - dmin) - (width + 1)
    rows = annotations.withColumns({"__w": width, "__m": mid, "__r": room}).where("__r > 0").select("aid", "chrom", "__w", "__m", "__r", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm"))
    up = F.col("perm") <= n // 2
    side = F.when(up, "up").otherwise("down")
    start = F.col("__m") + F.when(up, -dmax).otherwise(dmin) + rng.below(F.col("__r"), seed, side, F.col("aid"), F.col("perm"))
    return rows.select("aid", side.alias("side"), "perm", "chrom", start.alias("start"), (start + F.col("__w")).alias("end"))


def candidates(positions: DataFrame, bins: DataFrame) -> DataFrame:
    """Positions inside bins, numbered within (grp, kmer): grp, kmer, rank, pos, chrom and c, how many there are.

    positions: chrom, pos, kmer; bins: grp and an interval, position p inside if start < p <= end. Built once for
    all permutations. A group's positions are at most its bins' bases.
    """
    points = positions.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "pos", "kmer")
    inside = overlap_pairs(bins.select("grp", "chrom", "start", "end"), points, "point")
    inside = inside.select("grp", "chrom", F.col("v_pos").alias("pos"), F.col("v_kmer").alias("kmer"))
    w = W.partitionBy("grp", "kmer")
    return inside.select("grp", "kmer", "chrom", "pos", F.row_number().over(w.orderBy("chrom", "pos")).cast("long").alias("rank"), F.count("*").over(w).alias("c"))


def draw_sites(variants: DataFrame, sites: DataFrame, n: int, what: str, seed: int = 0, exclude_own: bool = True) -> DataFrame:
    """vid, perm, chrom, start, end: each variant's new site, uniform over the sites of its (grp, kmer).

    variants: vid, chrom, end, grp, kmer. Its own site is stepped over (exclude_own); with no other site it is dropped.
    """
    size = sites.where("rank = 1").select("grp", "kmer", "c")
    own = sites.select("grp", "kmer", F.col("chrom").alias("own_chrom"), F.col("pos").alias("own_pos"), F.col("rank").alias("own_rank"))
    v = variants.alias("v").join(size, ["grp", "kmer"])
    v = v.join(own.alias("o"), (F.col("v.grp") == F.col("o.grp")) & (F.col("v.kmer") == F.col("o.kmer")) & (F.col("v.chrom") == F.col("own_chrom")) & (F.col("v.end") == F.col("own_pos")), "left").select("vid", F.col("v.grp").alias("grp"), F.col("v.kmer").alias("kmer"), "c", "own_rank")
    skip = F.col("own_rank").isNotNull() if exclude_own else F.lit(False)
    room = F.col("c") - skip.cast("long")
    v = v.select("vid", "grp", "kmer", "own_rank", skip.alias("skip"), room.alias("room"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm")).where("room > 0")
    r = rng.below(F.col("room"), seed, what, F.col("vid"), F.col("perm")) + 1
    v = v.withColumn("r", r).withColumn("rank", F.col("r") + F.when(F.col("skip") & (F.col("r") >= F.col("own_rank")), 1).otherwise(0))
    placed = v.join(sites.select("grp", "kmer", "rank", "chrom", "pos"), ["grp", "kmer", "rank"])
    return placed.select("vid", "perm", "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
