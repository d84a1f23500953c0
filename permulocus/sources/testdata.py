"""The driver's tables as genomic inputs. Five contigs of 2,592,001 bases (30 days in seconds); sequence on five of 20,000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.staging import written

LENGTH, SHORT = 2_592_001, 20_000
CONTIGS = ("chr1", "chr2", "chr3", "chrX", "chrY")
EVENT_CONTIG = {"click": "chr1", "error": "chr2", "purchase": "chr3", "signup": "chrX"}
SEQ_SEED = 11


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contig_of(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, CONTIGS)), (n % 5).cast("int"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, chrom, start, end, signal."""
    e = _table(spark, sf_dir, "events")
    name = F.lit("chrY")
    for kind, chrom in EVENT_CONTIG.items():
        name = F.when(F.col("event_type") == kind, chrom).otherwise(name)
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return e.select(F.col("event_id").alias("vid"), name.alias("chrom"), start.alias("start"), (start + 1).alias("end"), F.col("value").cast("decimal(18,2)").alias("signal"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aid, chrom, start, end, name."""
    o, start = _table(spark, sf_dir, "orders"), (F.col("o_orderkey") * 1733) % 2592000
    return o.select(F.col("o_orderkey").alias("aid"), contig_of(F.col("o_custkey")).alias("chrom"), start.alias("start"), (start + 200 + F.col("o_orderkey") % 1800).alias("end"), F.concat(F.lit("ord"), F.col("o_orderkey").cast("string")).alias("name"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, start = _table(spark, sf_dir, "supplier"), (F.col("s_suppkey") * 104729) % 2592000
    return s.select(contig_of(F.col("s_suppkey")).alias("chrom"), start.alias("start"), (start + 500 + F.col("s_suppkey") % 700).alias("end"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end, value: a track from parts."""
    p, start = _table(spark, sf_dir, "part"), (F.col("p_partkey") * 7919) % 2592000
    return p.select(contig_of(F.col("p_partkey")).alias("chrom"), start.alias("start"), (start + 400 + 20 * F.col("p_size").cast("long")).alias("end"), F.col("p_retailprice").cast("decimal(18,2)").alias("value"))


def second_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another track, from customers."""
    c, start = _table(spark, sf_dir, "customer"), (F.col("c_custkey") * 6007) % 2592000
    return c.select(contig_of(F.col("c_custkey")).alias("chrom"), start.alias("start"), (start + 900).alias("end"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"))


def genome(spark: SparkSession, length: int = LENGTH) -> DataFrame:
    names = {"chr1": 1, "chr2": 2, "chr3": 3, "chrX": 23, "chrY": 24}
    return spark.createDataFrame([(c, o, length) for c, o in names.items()], "chrom string, ord int, length long").coalesce(1)


def short_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants on the short contigs, with a column that is carried along."""
    v, start = variants(spark, sf_dir), F.col("start") % (SHORT - 2) + 1
    return v.select("vid", "chrom", start.alias("start"), (start + 1).alias("end"), F.col("signal").alias("extra"))


def short_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blacklist intervals on the short contigs."""
    b = blacklist(spark, sf_dir)
    start = F.col("start") % (SHORT - 400)
    return b.select("chrom", start.alias("start"), (start + 60 + F.col("start") % 70).alias("end"))


def sequence(spark: SparkSession, length: int = SHORT, chunk: int = 5000) -> DataFrame:
    """chrom, chunk_start, bases: drawn bases, N from 7001 to 7100 and in lower case from 12001 to 13000."""

    def base(chrom: Column, pos: Column) -> Column:
        drawn = F.substring(F.lit("ACGT"), (F.pmod(rng.draw(SEQ_SEED, "base", chrom, pos), F.lit(4)) + 1).cast("int"), F.lit(1))
        return F.when(pos.between(7001, 7100), "N").when(pos.between(12001, 13000), F.lower(drawn)).otherwise(drawn)

    at = F.sequence(F.lit(1).cast("long"), F.lit(length).cast("long"), F.lit(chunk).cast("long"))
    rows = genome(spark, length).select("chrom", F.explode(at).alias("chunk_start"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if length > SHORT else 1
    upto = F.least(F.col("chunk_start") + chunk - 1, F.lit(length))
    bases = F.array_join(F.transform(F.sequence("chunk_start", upto), lambda p: base(F.col("chrom"), p)), "")
    return written(rows.repartition(tasks).select("chrom", "chunk_start", bases.alias("bases")), "sequence")
