"""Operator 6, secret scans by an incremental blob ledger. DataFrame functions only.

A blob is a version of a text under its SHA-256. The ledger is a Parquet table of (blob, rules) -> findings in
a shared folder. A scan takes one row of each blob that the ledger lacks under these rules, scans its whole text,
adds the findings, then joins the ledger back to every path. So copies and unchanged versions cost a hash.

Spans are found with built-in functions: the pieces between matches (split) and the matches themselves
(regexp_extract_all) alternate, so running lengths of both give positions in code points.

Cases: null or empty text has no span; repeated rows each get their findings; rows with a null id are scanned like others;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running, shared_dir, table


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length; base kinds first. The runs of access and hex are of one class, so their least length can be part of the pattern.
RULES = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1),
)
BASE_KINDS = 3
RULES_VERSION = "1"
_EMPTY = "array<struct<start:int,kind:int,stop:int>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, kind, stop) of one rule, leftmost and non-overlapping, the failing ones dropped."""
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
    gaps = F.transform(F.split(text, pattern), F.char_length)  # one more than matches: what follows the last
    # Lists are zipped: one that is named inside a lambda would be made anew for each match.
    sized = F.zip_with(gaps, lengths(0), lambda gap, n: F.struct(gap.alias("gap"), n.alias("len")))
    if group:
        sized = F.zip_with(sized, lengths(group), lambda x, n: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), n.alias("counted")))
    counted = "counted" if group else "len"
    spans = running(
        F.filter(sized, lambda x: x["len"].isNotNull()),
        lambda x: x["gap"] + x["len"],
        lambda x, at: F.struct((at.cast("int") + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at.cast("int") + x["gap"] + x["len"]).alias("stop"), (x[counted] >= least).alias("holds")),
        "struct<start:int,kind:int,stop:int,holds:boolean>",
    )
    kept = F.transform(F.filter(spans, lambda x: x["holds"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(_EMPTY))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(r[0]) for r in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """texts without the text, with n_assign, n_access, n_hex, base (as written) and spans (as written)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = texts.withColumn("__s_base", F.sort_array(F.concat(*(_spans(text, k, *r[1:]) for k, r in enumerate(RULES[:BASE_KINDS])))))
    out = out.withColumn("__s_more", F.concat(*(_spans(text, k, *r[1:]) for k, r in enumerate(RULES) if k >= BASE_KINDS)))
    count = lambda k: F.size(F.filter("__s_base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        *(F.col(f"`{c}`") for c in texts.columns if c != text_col),
        *(count(k).alias(f"n_{RULES[k][0]}") for k in range(BASE_KINDS)),
        _written(F.col("__s_base")).alias("base"),
        _written(F.sort_array(F.concat("__s_base", "__s_more"))).alias("spans"),
    )


class BlobLedger:
    """Findings by blob and rules version, in a folder that outlives the calls."""

    SCHEMA = "blob string, n_assign long, n_access long, n_hex long, base string, spans string, rules string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            fields = T.StructType.fromDDL(self.SCHEMA).fields
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))

    def scan(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row a row of versions: the id and its findings."""
        blobs = versions.select(F.col(id_col).alias("__id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"), F.col(text_col).alias("text"))
        paths = blobs.drop("text")
        known = self.read().where(F.col("rules") == RULES_VERSION)
        unseen = paths.groupBy("blob").agg(F.min("__id").alias("rep")).join(known.select("blob"), "blob", "left_anti")
        texts = blobs.join(unseen, (blobs["blob"] == unseen["blob"]) & blobs["__id"].eqNullSafe(unseen["rep"]), "left_semi")
        found = scan(texts.select("blob", "text")).dropDuplicates(["blob"])  # the same row may be there twice
        found.withColumn("rules", F.lit(RULES_VERSION)).write.mode("append").parquet(self.path)
        findings = self.read().where(F.col("rules") == RULES_VERSION).drop("rules").dropDuplicates(["blob"])  # two scans at once may both have added it
        return paths.join(findings, "blob").select(F.col("__id").alias(id_col), "n_assign", "n_access", "n_hex", "base", "spans")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = BlobLedger(spark, shared_dir(spark, "secret-ledger")).scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def _oracle() -> str:
    quoted = [r[1].replace("'", "''") for r in RULES]
    parts = []
    for k, (_, _, group, least) in enumerate(RULES):
        parts.append(f"""
  SELECT doc_id, {k} AS kind, {least} AS least,
         unnest(list_transform(range(1, len(found) + 1), lambda i: struct_pack(
           start := CAST(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
           len := length(found[i]), counted := length(counted[i])))) AS m
  FROM (SELECT doc_id, regexp_extract_all(t, '{quoted[k]}', 0) AS found, regexp_split_to_array(t, '{quoted[k]}') AS between, regexp_extract_all(t, '{quoted[k]}', {group}) AS counted
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{quoted[k]}'))""")
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{r[0]}'" for k, r in enumerate(RULES)) + " END"
    return f"""
WITH m AS ({' UNION ALL '.join(parts)}
), s AS (
  SELECT doc_id, kind, m.start AS b, {names} || ':' || m.start || ':' || (m.start + m.len) AS w FROM m WHERE m.counted >= least
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(w, ',' ORDER BY b, kind) FILTER (WHERE kind < {BASE_KINDS}) AS base, string_agg(w, ',' ORDER BY b, kind) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


OP6_SQL = _oracle()
