"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators' contracts define it, as a Java regular expression.
WS = r"[\x20\x09-\x0D]+"
#: The same characters, for translate() and trim().
WS_CHARS = " \t\n\x0b\x0c\r"
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local tests), a temporary folder is set for the session once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="permulocus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it again.

    A lost executor then costs re-reading committed files, not recomputing what came before.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """A column name, or the beginning of some, that no column begins with (upper and lower case are the same to Spark)."""
    name, taken = f"__{name}", [c.lower() for c in columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the staged table's values are BROADCAST_BYTES at most (a number counts 16)."""
    sizes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16 if f.dataType.typeName() == "string" else F.lit(16) for f in df.schema.fields]
    total = df.agg(F.sum(sum(sizes, F.lit(0)).cast("long")).alias("n")).first().n or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what is named inside a lambda is otherwise computed for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, size_of: Callable[[Column], Column], made: Callable[[Column, Column], Column], kind: str, block: int = 512) -> Column:
    """made(item, at) for each item of an array, of type kind; at is the sum (long) of size_of over the items before it.

    A list that grows by an element is copied at each step, so items are cut into blocks: first the blocks' sums, then each
    block from its own start. n items cost n * block / 2 + n ** 2 / block copied references, not n ** 2 / 2.
    """
    zero = F.lit(0).cast("long")

    def of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + size_of(x)))
        starts = F.aggregate(
            totals, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        )["out"]
        walk = lambda b, at: F.aggregate(
            b, F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), lambda s, x: F.struct((s["at"] + size_of(x)).alias("at"), F.concat(s["out"], F.array(made(x, s["at"]))).alias("out"))
        )["out"]
        return F.flatten(F.zip_with(blocks, starts, walk))

    def cut(every: Column) -> Column:
        firsts = F.when(F.size(every) > 0, F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(block))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda at: F.slice(every, at, block))

    return named(items, lambda every: named(cut(every), of))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def shingle_hashes(words: Column, n: int) -> Column:
    """xxhash64 of each n-word window (repeats included); fewer words: the whole sequence; no words: none."""
    size = F.size(words)
    one = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n)))
    return (
        F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), one))
        .when(size > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def shingle_texts(words: Column, n: int) -> Column:
    """The windows themselves, words joined by one space; the same cases as shingle_hashes."""
    size = F.size(words)
    return (
        F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " ")))
        .when(size > 0, F.array(F.array_join(words, " ")))
        .otherwise(F.array().cast("array<string>"))
    )
