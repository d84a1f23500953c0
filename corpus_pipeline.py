"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all rows that its predecessor kept,
and returns the columns of documents; the last returns packed pieces. run() writes and rereads between stages.

n_chars follows the text where a stage rewrites it.

Cases, for every stage: null and empty texts are texts without words (the first stage rejects them); rows with a null id pass as documents
that are nobody's copy; repeated rows each meet the same fate, as copies of one document; an empty table gives none; further columns are
carried, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permulocus.llm import decontaminate, line_dedup, packing, quality, simhash
from permulocus.llm.common import fresh, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the base rules or the calibrated cutoffs reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines that an earlier document holds go; the document stays, with what is left of it."""
    p = fresh(docs.columns, "ld_")
    out = line_dedup.dedup_lines(docs, prefix=p)
    changed, kept = F.col(f"{p}n_dropped") > 0, F.col(f"{p}kept")
    put = {"text": F.when(changed, kept).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group the document with the smallest id stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


#: Workers of the last stage live on beside the first ones of a next run, so they remember less than the operator alone would.
CACHE_WORDS = 250_000


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: sequences of token ids, one row a piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER), with_ids=True, cache_words=CACHE_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: Tokenization is not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
