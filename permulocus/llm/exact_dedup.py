"""Operator 11, exact dedup: a persistent digest index, bucketed and sorted by digest.

Texts are equal when they are once all ASCII white space is deleted. Each text is read once, for its SHA-256 and its length;
all that follows moves digests. A batch is brought to one row a digest (with map-side combine, so a group of copies is one row
a task), merge-anti-joined to the index, whose buckets are read in place, and appended as a new segment: digests that the index
lacks are new, those that it has are changes (more copies, perhaps a better row to keep) and never duplicate a digest's entry as new.
Segments are tables of their own under one folder; a manifest, written after each, names them, so a later session opens
the same folder and goes on, a batch that failed is not in it, and a batch whose name it holds is not added twice.

Of equal texts the row with the most code points in the original text stays, then that with the smallest id (null comes last), then the
earliest batch, then the row first read. Cases: null text is empty; texts without a character but white space are all equal; repeated rows are
copies like others, so one row of a group stays; a null id has its row judged like others; an empty table gives none; other columns are not
carried by the query and are kept, whatever their names, by keep_unique.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, fresh, shared_dir, stage, table

#: Batches that one call over a whole table makes, so that all but the first meet an index; incremental callers add batches as they come.
BATCHES = 3
_MANIFEST = "segment long, name string, buckets int, batch string"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null: empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WS_CHARS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row (a number of the row), chars (code points of the original) and digest (32 bytes), written to the shared folder."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    return stage(docs.select(F.col(f"`{id_col}`").alias("doc"), F.monotonically_increasing_id().alias("row"), F.char_length(text).cast("long").alias("chars"), digest.alias("digest")), "digests")


class DigestIndex:
    """The index in a folder: opened where it exists, begun where it doesn't. path must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "digest-index")
        self.segments: list[tuple[int, str, int, str]] = []
        if path:
            try:
                self.segments = sorted(tuple(r) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect())
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        self.buckets = self.segments[0][2] if self.segments else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for _, name, n, _ in self.segments:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, n BIGINT, best STRUCT<less: BIGINT, nameless: BOOLEAN, doc: BIGINT, batch: BIGINT, row: BIGINT>, seen BOOLEAN) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{self.path}/{name}'")

    def add(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Takes digests in as one segment; False, and nothing is done, where the manifest has a batch of that name."""
        if batch is not None and any(b == batch for *_, b in self.segments):
            return False
        number = len(self.segments)
        best = F.struct((-F.col("chars")).alias("less"), F.col("doc").isNull().alias("nameless"), F.col("doc").cast("long").alias("doc"), F.lit(number).cast("long").alias("batch"), "row")
        own = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(best).alias("best"))
        seen = F.lit(False)
        for i, (_, name, _, _) in enumerate(self.segments):
            # A digest is new in one segment only; an outer join whose misses are the anti-join's rows and whose hits are the changes.
            had = self.spark.table(name).where("NOT seen").select("digest", F.lit(True).alias(f"in{i}"))
            own, seen = own.join(had.hint("merge"), "digest", "left"), seen | F.col(f"in{i}").isNotNull()
        name = f"digest_segment_{uuid.uuid4().hex}"
        rows_out = own.select("digest", "n", "best", seen.alias("seen")).repartition(self.buckets, "digest")
        rows_out.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        entry = (number, name, self.buckets, batch if batch is not None else name)
        self.spark.createDataFrame([entry], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.segments.append(entry)
        return True

    def state(self) -> DataFrame:
        """One row a digest: digest, group_size, keep_doc, keep_batch, keep_row. Read from the segments' files, which the catalog need not name."""
        parts = [self.spark.read.schema(self.spark.table(name).schema).parquet(f"{self.path}/{name}") for _, name, _, _ in self.segments]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return both.groupBy("digest").agg(F.sum("n").alias("group_size"), F.min("best").alias("best")).select("digest", "group_size", F.col("best.doc").alias("keep_doc"), F.col("best.batch").alias("keep_batch"), F.col("best.row").alias("keep_row"))

    def close(self) -> None:
        """Takes the segments' names out of the catalog; their files and the manifest stay."""
        for _, name, _, _ in self.segments:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def judged(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """digests' rows with keep_doc, group_size and kept, through an index that they are added to in batches."""
    spark = rows.sparkSession
    index, batch = DigestIndex(spark), F.pmod(F.xxhash64("doc"), F.lit(batches))
    for i in range(batches):
        index.add(rows.where(batch == i))
    state = index.state()
    index.close()
    # One row a digest on the other side: adaptive execution can split a digest that very many rows share.
    out = rows.withColumn("batch", batch).join(state, "digest")
    kept = (F.col("batch") == F.col("keep_batch")) & (F.col("row") == F.col("keep_row"))
    return out.select("doc", "row", "digest", "group_size", "keep_doc", kept.alias("kept"))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs without the rows that have a better copy; all columns stay. The rows are written first, so that a row's number means the same row later."""
    row = fresh(docs.columns, "row")
    own = stage(docs.withColumn(row, F.monotonically_increasing_id()), "exact-dedup")
    digest = F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    rows = stage(own.select(F.col(f"`{id_col}`").alias("doc"), F.col(row).alias("row"), F.char_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long").alias("chars"), digest.alias("digest")), "digests")
    stays = judged(rows, batches).where("kept").select(F.col("row").alias(row))
    return own.join(stays, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(digests(table(spark, sf_dir, "documents")))
    return out.select(F.col("doc").alias("doc_id"), F.col("keep_doc").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
