"""A cluster's bins laid end to end: positions from 1 to the cluster's width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import assign
from .overlap import overlap_pairs


def lay_out(bins: DataFrame) -> DataFrame:
    """bins (cluster, chrom, ord, start, end) with lo and hi: the bin holds epoch positions lo < p <= hi."""
    w = W.partitionBy("cluster").orderBy("ord", "start").rowsBetween(W.unboundedPreceding, W.currentRow)
    hi = F.sum(F.col("end") - F.col("start")).over(w)
    return bins.withColumn("hi", hi).withColumn("lo", F.col("hi") - (F.col("end") - F.col("start")))


def forward(variants: DataFrame, laid: DataFrame) -> DataFrame:
    """Variants inside bins with cluster and epoch."""
    placed = assign(variants, laid)
    bins = laid.select("chrom", F.col("start").alias("bin_start"), "cluster", "lo")
    return placed.join(bins, ["chrom", "bin_start"]).select(*variants.columns, "cluster", (F.col("end") - F.col("bin_start") + F.col("lo")).alias("epoch"))


def inverse(rows: DataFrame, laid: DataFrame) -> DataFrame:
    """rows (cluster, epoch, other columns) with chrom, start, end of the single base there; epochs outside are dropped."""
    axis = laid.select(F.col("cluster").cast("string").alias("chrom"), F.col("lo").alias("start"), F.col("hi").alias("end"), F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"))
    at = rows.withColumns({"chrom": F.col("cluster").cast("string"), "start": F.col("epoch") - 1, "end": F.col("epoch")})
    pairs = overlap_pairs(axis, at, "point")
    pos = F.col("g_start") + F.col("v_epoch") - F.col("start")
    return pairs.select(*(F.col(f"v_{c}").alias(c) for c in rows.columns), F.col("g_chrom").alias("chrom"), (pos - 1).alias("start"), pos.alias("end"))
