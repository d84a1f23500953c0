"""Operator 4, line dedup: levelled sorted runs of line hashes.

A run is a table of 128-bit line keys with the smallest document that holds each, bucketed and sorted by
key. Batches come in the order of the document id. Each batch keeps one row a key, merge-anti-joins it to
the runs (whose buckets are read in place, not shuffled) and adds its keys as a level-0 run, where those that
an earlier run holds are marked old and not part of the run; when a level has FANOUT runs they are compacted
into one of the next level. One call over a whole table makes BATCHES batches of about equally many documents, cut at quantiles of the id. A key's rows in the runs thus carry
the smallest document of all batches so far.

A line goes if its key is in an earlier batch's run, or in its own batch under a smaller document. Hot lines:
keys are counted with map-side combine first. The join back to occurrences reads the run's files, not its bucketed table: only keys that
some line must lose, one row each. Where they are few it is a broadcast; else both sides are shuffled, so that adaptive execution can split a hot key's lines.

Cases: null or empty text is one empty line; short keys never go; repeated rows of a document keep or lose
the same lines; rows with a null id lose no line and take none from others; an empty table gives none;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, shared_dir, table

MIN_CHARS = 10
FANOUT = 3
#: Batches that one call over a whole table makes, more than FANOUT; incremental callers add batches as they come.
BATCHES = 4
#: Relative error of the quantiles between batches: a batch's size may differ by that share of all rows. It does not touch results.
QUANTILE_ERROR = 0.01


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a line long enough: doc, pos and the two halves of its key."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= MIN_CHARS)
    return keyed.select("doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """The runs seen so far, under one shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.path, self.levels, self.written = shared_dir(spark, "line-runs"), [], []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name))
        self.written.append(name)
        return name

    def close(self) -> None:
        """Take the runs' names out of the catalog. Their files stay: the lines to drop are read from them."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.written, self.levels = [], []

    def _read(self, names: list[str]) -> DataFrame:
        """Their new keys; a key is new in one run only."""
        out = self.spark.table(names[0])
        for n in names[1:]:
            out = out.unionByName(self.spark.table(n))
        return out.where("NOT old")

    def tables(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Takes one batch in; gives its lines to drop as rows (doc, pos)."""
        lines = _lines(docs, id_col, text_col)
        own = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        old = F.lit(False)
        for i, n in enumerate(self.tables()):
            run = self.spark.table(n).where("NOT old").select("h1", "h2", F.lit(True).alias(f"in{i}"))
            own, old = own.join(run.hint("merge"), ["h1", "h2"], "left"), old | F.col(f"in{i}").isNotNull()
        name = self._write(own.select("h1", "h2", "first", "last", old.alias("old")))
        # Keys that some line of this batch must lose: all of an earlier batch's, and those of two documents here.
        rows = self.spark.table(name)
        repeated = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}").where("old OR last > first")
        drops = lines.join(repeated, ["h1", "h2"]).where("old OR doc > first").select("doc", "pos")
        self._level(0, name)
        return drops

    def _level(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._read(self.levels[level]))
            self.levels[level] = []
            self._level(level + 1, merged)


def rewrite(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "__ld_") -> DataFrame:
    """docs with columns prefix + n_lines, n_dropped, kept: the lines that stay, joined by line feeds. No column of docs may begin with prefix."""
    by_doc = drops.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias(f"{prefix}drop")).withColumnRenamed("doc", f"{prefix}doc")
    out = docs.join(by_doc, F.col(id_col) == F.col(f"{prefix}doc"), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    out = out.withColumn(f"{prefix}lines", lines).withColumn(f"{prefix}n_lines", F.size(f"{prefix}lines").cast("long"))
    n, drop = F.col(f"{prefix}n_lines").cast("int"), F.col(f"{prefix}drop")
    stays = F.array_except(F.sequence(F.lit(0), n - 1), drop)
    kept = F.when(drop.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col(f"{prefix}lines"), i)), "\n"))
    return out.withColumn(f"{prefix}n_dropped", F.coalesce(F.size(drop), F.lit(0)).cast("long")).withColumn(f"{prefix}kept", kept).drop(f"{prefix}doc", f"{prefix}drop", f"{prefix}lines")


def batch_ends(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """The last id of each batch but the last one, rising: about equally many rows each, fewer batches where ids repeat much."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    at = F.array(*(F.lit(i / batches) for i in range(1, batches)))
    ends = ids.agg(F.percentile_approx("id", at, round(1 / QUANTILE_ERROR)).alias("ends")).first().ends or []
    return sorted(set(ends))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, prefix: str = "__ld_") -> DataFrame:
    """The whole table in batches in the order of the id; see rewrite for the columns that come on top."""
    spark = docs.sparkSession
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = [None, *(batch_ends(docs, id_col, batches) if batches > 1 else []), None]
    drops = None
    for after, upto in zip(ends, ends[1:], strict=False):
        batch = docs if after is None else docs.where(F.col(id_col) > after)
        d = runs.add(batch if upto is None else batch.where(F.col(id_col) <= upto), id_col, text_col)
        drops = d if drops is None else drops.unionByName(d)
    runs.close()
    return rewrite(docs, drops, id_col, text_col, prefix)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__ld_n_lines").alias("n_lines"), F.col("__ld_n_dropped").alias("n_dropped"), F.sha2(F.col("__ld_kept"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
