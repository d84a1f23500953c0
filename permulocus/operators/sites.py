"""Drawing sites by rank, without listing bases.

Contexts: the sequence inside the groups' bins is cut into segments; the index counts (group, context, segment) and keeps running totals, so a rank picks its segment,
and only drawn segments are walked. Uniform draws: runs without N with running lengths, where a rank is arithmetic. Ranks go by
(chrom, position) within a group, as if every base were listed. A rank finds its row by the join over bins of overlap_pairs, on the axis of ranks, so
a group of very many segments is no candidate list. Windows are over a group's segments or runs, not its bases. Joins with the index and segments are sorted and merged: their
compressed files are small enough for Spark to broadcast them, their rows are not.

Groups' bins are disjoint: grp, chrom, start, end, base p inside if start < p <= end. A group may have bins on several chromosomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kmers, rng
from ..functions.staging import written
from .overlap import overlap_pairs, overlap_sums

#: Bases of a segment. Longer ones make a smaller index and longer walks.
SEGMENT = 512
#: The narrowest bins on the axis of ranks: about as many ranks as a segment has sites of one context.
RANKS = 32


def segments(seq: DataFrame, bins: DataFrame, k: int, length: int = SEGMENT) -> DataFrame:
    """grp, chrom, start, end, first, bases: stretches of bins of length bases at most, in upper case; bases (from position first) go as far as their contexts of k do, and no further."""
    cut = overlap_pairs(bins.select("grp", "chrom", "start", "end"), kmers.pieces(seq, k, length), "closed", levels=(None, [0]), bucket=length)
    cut = cut.select("grp", "chrom", F.greatest("start", "v_start").alias("start"), F.least("end", "v_end").alias("end"), F.col("v_first").alias("had"), F.upper("v_bases").alias("v_bases")).where("start < `end`")
    first = F.greatest(F.col("start") + 1 - k // 2, F.col("had"))
    bases = F.substring(F.col("v_bases"), (first - F.col("had") + 1).cast("int"), (F.col("end") + k // 2 - first + 1).cast("int"))
    checked = F.when(bases.rlike(f"[^{kmers.ALPHABET}]"), F.raise_error(F.concat(F.lit("not a base in the sequence of "), "chrom"))).otherwise(bases)
    return written(cut.select("grp", "chrom", "start", "end", first.alias("first"), checked.alias("bases")), "segments")


def context_index(segs: DataFrame, k: int) -> DataFrame:
    """grp, kmer, chrom, start, before, c: how many sites of the context a segment has, and the group's earlier ones. Contexts with N, or without a neighbour, are none."""
    rows = segs.select("grp", "chrom", "start", F.explode(F.regexp_extract_all("bases", F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))).alias("kmer"))
    counts = rows.groupBy("grp", "kmer", "chrom", "start").agg(F.count("*").alias("c"))
    earlier = W.partitionBy("grp", "kmer").orderBy("chrom", "start").rowsBetween(W.unboundedPreceding, -1)
    return written(counts.select("*", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before")), "context-index")


def _parts(bases: Column) -> Column:
    """bases cut before each place where kmer begins, overlapping ones too."""
    return F.split(bases, F.concat(F.lit("(?="), F.col("kmer"), F.lit(")")))


def _begins(bases: Column) -> Column:
    return F.startswith(bases, F.col("kmer")).cast("int")


def _at_rank(draws: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """draws (keys, rank, others) with seg_chrom, seg_start and local, the rank inside the row (keys, chrom, start, before, c) of index that has it."""
    key = F.concat_ws("\t", *keys)
    axis = index.select(key.alias("chrom"), F.col("before").alias("start"), (F.col("before") + F.col("c")).alias("end"), F.col("chrom").alias("seg_chrom"), F.col("start").alias("seg_start"))
    at = draws.withColumns({"chrom": key, "start": F.col("rank") - 1, "end": F.col("rank")})
    pairs = overlap_pairs(axis, at, "point", RANKS, levels=(None, [0]))
    return pairs.select(*(F.col(f"v_{c}").alias(c) for c in draws.columns), "seg_chrom", "seg_start", (F.col("v_rank") - F.col("start")).alias("local"))


def draw_contexts(variants: DataFrame, segs: DataFrame, n: int, k: int, what: str, seed: int = 0) -> DataFrame:
    """vid, perm, chrom, start, end: each variant's new site, uniform over the other sites of its group and context.

    variants: vid, chrom, start, end, a single base at end. One on an N or outside the segments is dropped, as is one without another site.
    """
    index = context_index(segs, k)
    half, pos = k // 2, F.col("v_end")
    inside = overlap_pairs(segs, variants.select("vid", "chrom", "start", "end"), "point")
    at = (pos - half - F.col("first") + 1).cast("int")
    own = inside.select(F.col("v_vid").alias("vid"), "grp", "chrom", "start", F.when(at > 0, F.substring("bases", at, F.lit(k))).alias("kmer"), F.expr("left(bases, v_end + " + str(half) + " - first + 1)").alias("upto"))
    own = own.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).select("vid", "grp", "kmer", "chrom", "start", (F.size(_parts(F.col("upto"))) - 1 + _begins(F.col("upto"))).alias("nth"))
    total = index.groupBy("grp", "kmer").agg(F.sum("c").alias("total"))
    ranked = own.join(index.drop("c").hint("merge"), ["grp", "kmer", "chrom", "start"]).join(total.hint("merge"), ["grp", "kmer"]).select("vid", "grp", "kmer", (F.col("before") + F.col("nth")).alias("own_rank"), (F.col("total") - 1).alias("room"))
    each = written(ranked.where("room > 0"), "ranked").select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm"))
    r = rng.below(F.col("room"), seed, what, F.col("vid"), F.col("perm")) + 1
    draws = each.select("vid", "perm", "grp", "kmer", (r + F.when(r >= F.col("own_rank"), 1).otherwise(0)).alias("rank"))
    drawn = _at_rank(draws, index, ["grp", "kmer"])
    walked = drawn.join(segs.withColumnsRenamed({"chrom": "seg_chrom", "start": "seg_start"}).hint("merge"), ["grp", "seg_chrom", "seg_start"])
    earlier = F.array_join(F.slice(_parts(F.col("bases")), F.lit(1), (F.col("local") - _begins(F.col("bases"))).cast("int")), "")
    pos = F.col("first") + F.char_length(earlier) + half
    return walked.select("vid", "perm", F.col("seg_chrom").alias("chrom"), (pos - 1).alias("start"), pos.alias("end"))


def runs(seq: DataFrame, bins: DataFrame) -> DataFrame:
    """grp, chrom, start, end, before, c: the bins' stretches without N, their lengths, and the lengths of the group's earlier ones."""
    chunk = seq.select("chrom", (F.col("chunk_start") - 1).alias("start"), (F.col("chunk_start") + F.char_length("bases") - 1).alias("end"), F.upper("bases").alias("bases")).where("start < `end`")
    used = overlap_sums(chunk, bins, "closed").where("n > 0").drop("n")
    letters = F.when(F.col("bases").rlike(f"[^{kmers.ALPHABET}]"), F.raise_error(F.concat(F.lit("not a base in the sequence of "), "chrom"))).otherwise(F.col("bases"))
    parts = used.select("chrom", F.col("start").alias("chunk"), F.posexplode(F.split(letters, "(?<=N)(?=[^N])|(?<=[^N])(?=N)")).alias("i", "run"))
    upto = W.partitionBy("chrom", "chunk").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.char_length("run").cast("long")
    parts = parts.select("chrom", "chunk", F.substring("run", 1, 1).alias("kind"), size.alias("size"), F.sum(size).over(upto).alias("upto"))
    clean = written(parts.where("kind <> 'N'").select("chrom", (F.col("chunk") + F.col("upto") - F.col("size")).alias("start"), (F.col("chunk") + F.col("upto")).alias("end")), "runs")
    cut = overlap_pairs(bins.select("grp", "chrom", "start", "end"), clean, "closed")
    cut = cut.select("grp", "chrom", F.greatest("start", "v_start").alias("start"), F.least("end", "v_end").alias("end")).where("start < `end`")
    earlier = W.partitionBy("grp").orderBy("chrom", "start").rowsBetween(W.unboundedPreceding, -1)
    c = F.col("end") - F.col("start")
    return written(cut.select("*", c.alias("c"), F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias("before")), "bin-runs")


def draw_uniform(variants: DataFrame, free: DataFrame, n: int, what: str, seed: int = 0) -> DataFrame:
    """vid, perm, chrom, start, end: a base of the variant's group that is no N, its own included. Variants on an N, or outside, are dropped. free: as of runs."""
    total = free.groupBy("grp").agg(F.sum("c").alias("total"))
    inside = overlap_pairs(free.select("grp", "chrom", "start", "end"), variants.select("vid", "chrom", "start", "end"), "point").select(F.col("v_vid").alias("vid"), "grp")
    each = inside.join(total, "grp").select("vid", "grp", "total", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm"))
    draws = each.select("vid", "perm", "grp", (rng.below(F.col("total"), seed, what, F.col("vid"), F.col("perm")) + 1).alias("rank"))
    pos = F.col("seg_start") + F.col("local")
    return _at_rank(draws, free, ["grp"]).select("vid", "perm", F.col("seg_chrom").alias("chrom"), (pos - 1).alias("start"), pos.alias("end"))
