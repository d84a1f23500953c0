"""Sequence contexts. Positions count from 1; a single-base variant (start, end) is the base at end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACGTN"
#: Positions of a piece: about the root of a chunk's, which makes walking both cheapest.
PIECE = 256


def context(bases: Column, pos: Column, k: int, first: int | Column = 1) -> Column:
    """The k bases around pos, upper-cased; bases begins at position first. Null where a neighbour is missing."""
    at = pos - first + 1
    c = F.upper(F.substring(bases, (at - k // 2).cast("int"), F.lit(k)))
    return F.when((at > k // 2) & (F.char_length(c) == k), c)


def checked(kmer: Column, k: int) -> Column:
    """The context, or an error if its centre is not one of A, C, G, T, N."""
    mid = F.substring(kmer, k // 2 + 1, 1)
    return F.when(kmer.isNull() | mid.isin(*ALPHABET), kmer).otherwise(F.raise_error(F.concat(F.lit("not a base: "), mid)))


def pieces(seq: DataFrame, k: int, length: int = PIECE) -> DataFrame:
    """chrom, start, end, first, bases: chunks cut into pieces of length positions (start, end], with their neighbours' ends; first is that of bases' first base.

    seq: chrom, chunk_start, bases. A chunk takes its neighbours' ends with it, so that contexts at chunk borders are whole.
    """
    half = k // 2
    chunk = seq.select("chrom", "chunk_start", "bases", F.char_length("bases").alias("n"))
    left = chunk.select("chrom", (F.col("chunk_start") + F.col("n")).alias("chunk_start"), F.expr(f"right(bases, {half})").alias("before"))
    right = chunk.select("chrom", F.col("chunk_start").alias("next"), F.expr(f"left(bases, {half})").alias("after"))
    wide = chunk.join(left, ["chrom", "chunk_start"], "left").withColumn("next", F.col("chunk_start") + F.col("n")).join(right, ["chrom", "next"], "left")
    wide = wide.select("chrom", "n", "chunk_start", F.concat(F.coalesce("before", F.lit("")), "bases", F.coalesce("after", F.lit(""))).alias("bases"), (F.col("chunk_start") - F.char_length(F.coalesce("before", F.lit("")))).alias("first"))
    last = F.col("chunk_start") + F.col("n") - 1
    cut = wide.where("n > 0").select("chrom", "bases", F.col("first").alias("begin"), last.alias("last"), F.explode(F.sequence(F.col("chunk_start"), last, F.lit(length).cast("long"))).alias("from"))
    end = F.least(F.col("from") + length - 1, F.col("last"))
    first = F.greatest(F.col("from") - half, F.col("begin"))
    bases = F.substring(F.col("bases"), (first - F.col("begin") + 1).cast("int"), (end + half - first + 1).cast("int"))
    return cut.select("chrom", (F.col("from") - 1).alias("start"), end.alias("end"), first.alias("first"), bases.alias("bases"))


def positions(seq: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """chrom, pos, kmer of every position with all neighbours; with within (intervals), of pieces of the sequence that touch some only.

    Time is in proportion to the bases: a chunk is walked once for each of its pieces, a piece once for each of its positions.
    """
    cut = pieces(seq, k)
    if within is not None:
        from ..operators.overlap import overlap_sums

        cut = overlap_sums(cut, within, "closed").where("n > 0")
    at = cut.select("chrom", "bases", "first", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos"))
    return at.select("chrom", "pos", checked(context(F.col("bases"), F.col("pos"), k, F.col("first")), k).alias("kmer")).where("kmer IS NOT NULL")
