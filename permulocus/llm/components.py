"""Connected components of an undirected graph, by alternating large and small stars.

Every round maps edges to edges with one aggregate and one join on a node; a hub's rows are split by adaptive execution, as the
other side has one row a node. Rounds grow with the logarithm of the longest path. Edges are written to the shared folder
after each star, so a lost executor costs one star at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_folder, shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for each node that an edge joins to another: component is its smallest reachable node."""
    spark = edges.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_dir(spark, "components")
        df.distinct().write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = put(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    seen = mark(now)
    while seen[0]:
        # Large star: each node sends its greater neighbours to its least one.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid, mid_path = put(large)
        # Small star: each node sends its smaller neighbours and itself to the least of them.
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, (now, path) = path, put(small)
        for p in (old, mid_path):
            remove_folder(spark, p)
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
