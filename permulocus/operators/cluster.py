"""z-scores and Lloyd's k-means with fixed seeds and a fixed number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import written

DIGITS = 9


def zscores(rows: DataFrame, features: list[str], digits: int = DIGITS) -> DataFrame:
    """Features as (x - mean) / population deviation, rounded; 0 where all are equal. Moments are one small row, joined as a broadcast."""
    moments = rows.agg(*(F.avg(f).alias(f"__m_{f}") for f in features), *(F.stddev_pop(f).alias(f"__s_{f}") for f in features)).first()
    z = {f: F.round((F.col(f) - F.lit(moments[f"__m_{f}"])) / F.lit(moments[f"__s_{f}"]), digits) if moments[f"__s_{f}"] else F.lit(0.0) for f in features}
    return rows.withColumns(z)


def kmeans(rows: DataFrame, features: list[str], k: int = 100, iterations: int = 10, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """(members, centroids) after exactly iterations steps. rows: rid (0, 1, ... in order), features.

    Centroid i starts at row i * floor(rows / k); the nearest wins, the lowest number of equals; a centroid that loses all its
    members is gone for good. At most k centroids are collected after each step and stand in the next step's
    expressions, so rows are never joined or shuffled but for the small partial sums.
    """
    if k < 1 or iterations < 1:
        raise ValueError("k and iterations must be at least 1")
    step = rows.count() // k
    seeds = rows.where(F.col("rid").isin([i * step for i in range(k)])).select("rid", *features).collect()
    by_row = {r["rid"]: [float(r[f]) for f in features] for r in seeds}
    cents = [(i, by_row[i * step]) for i in range(k) if i * step in by_row]
    rows, members = written(rows, "kmeans"), None
    for _ in range(iterations):
        if not cents:
            break
        table = F.array(*(F.struct(F.lit(i).alias("c"), F.array(*map(F.lit, x)).alias("x")) for i, x in cents))
        point = F.array(*(F.col(f).cast("double") for f in features))
        far = F.transform(table, lambda t: F.struct(F.aggregate(F.zip_with(point, t["x"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("d"), t["c"].alias("c")))
        members = rows.withColumn("cluster", F.array_min(far)["c"])
        means = members.groupBy("cluster").agg(*(F.round(F.avg(f), digits).alias(f) for f in features)).collect()
        cents = sorted((m["cluster"], [m[f] for f in features]) for m in means)
    spark = rows.sparkSession
    schema = "cluster int, " + ", ".join(f"{f} double" for f in features)
    return rows.withColumn("cluster", F.lit(None).cast("int")) if members is None else members, spark.createDataFrame([(c, *x) for c, x in cents], schema)
