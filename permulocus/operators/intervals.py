"""Transforms of interval tables. Intervals are chrom, start, end with start < end; touching ones (closed rule) belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import written
from .overlap import overlap_pairs


def _carried(rows: DataFrame, value: Column, keys: list[str], name: str) -> DataFrame:
    """rows (with keys, bucket) and name: the greatest value in earlier buckets of the same keys."""
    totals = rows.groupBy(*keys, "bucket").agg(F.max(value).alias("m"))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(totals.select(*keys, "bucket", F.max("m").over(before).alias(name)), [*keys, "bucket"])


#: Bases of a bucket of merge's two levels.
BUCKET = 1 << 14


def merge(intervals: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The islands of intervals that overlap or touch, in two levels: within buckets of the start and over buckets."""
    keys = ["chrom"]
    rows = intervals.groupBy("chrom", "start").agg(F.max("end").alias("end")).withColumn("bucket", F.floor(F.col("start") / bucket))
    rows = _carried(rows, F.col("end"), keys, "end_before")
    earlier = W.partitionBy("chrom", "bucket").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.greatest("end_before", F.max("end").over(earlier)))
    rows = rows.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start")))
    rows = _carried(rows, F.col("opens"), keys, "open_before")
    so_far = W.partitionBy("chrom", "bucket").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("island", F.greatest("open_before", F.max("opens").over(so_far)))
    return rows.groupBy("chrom", F.col("island").alias("start")).agg(F.max("end").alias("end"))


def clip(regions: DataFrame, others: DataFrame) -> DataFrame:
    """regions' columns with the parts of others inside them as clip_start, clip_end (closed rule, so a part may be a point)."""
    pairs = overlap_pairs(regions, others, "closed")
    return pairs.select(*(F.col(f"`{c}`") for c in regions.columns), F.greatest("start", "v_start").alias("clip_start"), F.least("end", "v_end").alias("clip_end"))


def tile(genome: DataFrame, width: int) -> DataFrame:
    """Bins (left, left + width] from 1 to each chromosome's length; the last ends there. One row set a chromosome, exploded."""
    count = F.ceil((F.col("length") - 1) / width).cast("long")
    left = genome.where("length > 1").select("chrom", "ord", "length", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"))
    start = F.lit(1) + F.col("i") * width
    return left.select("chrom", "ord", start.alias("start"), F.least(start + width, F.col("length")).alias("end"))


def subtract(bins: DataFrame, blacklist: DataFrame) -> DataFrame:
    """bins less merged blacklist intervals: the gaps that are left, none where a bin is covered."""
    parts = clip(bins, blacklist).select("chrom", "ord", "start", "end", "clip_start", "clip_end")
    whole = W.partitionBy("chrom", "start").orderBy("clip_start", "clip_end")
    inside = parts.select("chrom", "ord", "start", "end", F.coalesce(F.lag("clip_end").over(whole), F.col("start")).alias("a"), F.col("clip_start").alias("b"))
    tail = parts.groupBy("chrom", "ord", "start", "end").agg(F.max("clip_end").alias("a")).select("chrom", "ord", "start", "end", "a", F.col("end").alias("b"))
    gaps = inside.unionByName(tail).where("a < b").select("chrom", "ord", F.col("a").alias("start"), F.col("b").alias("end"))
    free = bins.join(parts.select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_anti").select("chrom", "ord", "start", "end")
    return free.unionByName(gaps)


def absorb(bins: DataFrame, min_width: int) -> DataFrame:
    """Bins narrower than min_width go: into the bin before if that touches and is left, else into the bin after if
    that touches; both grow. The rule runs from left to right over runs of touching bins.

    After a wide bin the rule always stands the same: the narrow bin behind it joins it. A narrow bin whose left neighbour is gone or missing grows to the right up to the
    bin that holds its start + min_width, and what it has become takes in one more narrow bin behind; then the next one stands as it did. So the rule is a function from
    such a bin to the next, found by joins on touching ends and one overlap join. Functions are composed by doubling, and those that a run's beginning or a wide bin leads to are marked: as
    many rounds as the logarithm of the longest stretch of narrow bins, over narrow bins alone, and no bin waits for all before it.
    """
    own = written(bins.select("chrom", "ord", "start", "end"), "whole-bins")
    narrow = F.col("end") - F.col("start") < min_width
    if own.where(narrow).isEmpty():
        return own
    right = own.select("chrom", F.col("start").alias("end"), F.col("end").alias("r_end"), narrow.alias("r_narrow"))
    left = own.select("chrom", F.col("end").alias("start"), F.lit(True).alias("touched"))
    rows = own.join(right, ["chrom", "end"], "left").join(left, ["chrom", "start"], "left")
    takes = F.coalesce("r_narrow", F.lit(False))
    rows = written(rows.select("chrom", "ord", "start", "end", narrow.alias("narrow"), F.coalesce("touched", F.lit(False)).alias("touched"), F.when(takes, F.col("r_end")).otherwise(F.col("end")).alias("reach"), F.when(takes, F.col("r_end")).alias("node")), "neighbours")
    small = rows.where("narrow").select("chrom", "start", "end")
    inside = overlap_pairs(merge(own).select("chrom", "start", "end"), small, "point").where(F.col("v_start") + min_width <= F.col("end"))
    at = F.col("v_start") + min_width
    asked = inside.select("chrom", (at - 1).alias("start"), at.alias("end"), F.col("v_start").alias("from"))
    grown = overlap_pairs(rows.drop("narrow", "touched"), asked, "point", levels=(None, [0]))
    hops = written(grown.select("chrom", "ord", F.col("v_from").alias("from"), F.col("start").alias("into"), "reach", "node"), "hops")
    steps = [written(hops.where("node IS NOT NULL").select("chrom", "from", F.col("node").alias("to")).join(small.select("chrom", F.col("start").alias("to")), ["chrom", "to"], "left_semi"), "steps")]
    while not steps[-1].isEmpty():
        onward = steps[-1].select("chrom", F.col("from").alias("to"), F.col("to").alias("next"))
        steps.append(written(steps[-1].join(onward, ["chrom", "to"]).select("chrom", "from", F.col("next").alias("to")), "steps"))
    marked = rows.where("narrow AND NOT touched").select("chrom", F.col("start").alias("from")).unionByName(rows.where("NOT narrow AND node IS NOT NULL").select("chrom", F.col("node").alias("from"))).distinct()
    for step in steps[-2::-1]:
        marked = written(marked.unionByName(step.join(marked, ["chrom", "from"], "left_semi").select("chrom", F.col("to").alias("from"))).distinct(), "marked")
    pieces = hops.join(marked, ["chrom", "from"], "left_semi").select("chrom", "ord", "into", F.col("from").alias("start"), F.col("reach").alias("end"))
    wide = rows.where("NOT narrow").select("chrom", "ord", F.col("start").alias("into"), "start", F.col("reach").alias("end"))
    return pieces.unionByName(wide).groupBy("chrom", "ord", "into").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("into")


def assign(variants: DataFrame, bins: DataFrame) -> DataFrame:
    """Variants with the bin that holds them: start < v.end <= end; bin_start and bin_end on top. Bins don't overlap, so one at most."""
    pairs = overlap_pairs(bins.select("chrom", "start", "end"), variants, "point")
    return pairs.select(*(F.col(f"v_{c}").alias(c) for c in variants.columns), F.col("start").alias("bin_start"), F.col("end").alias("bin_end"))
