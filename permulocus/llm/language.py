"""Operator 8, language identification by rank-order n-gram profiles.

A profile is the TOP most frequent letter n-grams (one to three letters, word ends count as a letter) by rank. A text's
distance from a language is the sum over the text's profile of how far out of place each n-gram is; one that the
language's profile lacks counts TOP. The nearest language wins, the first in order of equals.
score is 1 - distance / largest possible distance.

Training: at most about TRAIN_PER_LANGUAGE rows a language, by hash of the id (a documented bound); counts are summed
by (language, n-gram) with a map-side sum. Every language is learned; a profile is TOP numbers. Tasks get the profiles in blocks of
BLOCK languages: a text's nearest language so far goes on from block to block, so what one task holds is bounded.

Cases: null text, and text without a letter, is "und" with score 0; so is all if nothing was learned; repeated rows get equal rows; rows with a
null id are predicted and not learned from; a language may itself be called und; an empty table gives none; whole texts count, however long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, table

TOP = 300
TRAIN_PER_LANGUAGE = 2000
BLOCK = 200
FOLDS = 5


@cache
def _letters() -> np.ndarray:
    """By code point: is it a letter? Made by rule, once a worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (packed: 20 bits a letter, length on top) and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    c = np.where(_letters()[c], c, 0)
    c = np.concatenate([[0], c, [0]])
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # runs of other characters are one word end
    two, three = c[:-1] << 20 | c[1:], c[:-2] << 40 | c[1:-1] << 20 | c[2:]
    keys = np.concatenate([c[c != 0] | 1 << 60, two | 2 << 60, three | 3 << 60])
    return np.unique(keys, return_counts=True)


def profile(text: str, top: int = TOP) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, equals by code."""
    keys, n = ngrams(text)
    return keys[np.lexsort((keys, -n))[:top]]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, per_language: int = TRAIN_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Language -> its profile, from rows with a language and an id."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = stage(rows.groupBy("lang").agg(F.count("*").alias("size")), "language-sizes")
    # The id's hash as a number from 0 to 1.
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = rows.join(sizes, "lang").where(chance < F.lit(float(per_language)) / F.col("size")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                keys, n = ngrams("\n".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64) for lang, g in out.items()}


def nearest(text: str, names: list[str], keys: list[np.ndarray], ranks: list[np.ndarray], top: int = TOP, known: tuple[str, float] | None = None) -> tuple[str, float]:
    """The nearest of names and its score, or what is known of names before these (None: there were none) if none is nearer."""
    own = profile(text, top)
    if not names or not (own >> 60 == 1).any():
        return known or ("und", 0.0)
    at, best = np.arange(len(own)), (np.inf, 0)
    for i, (k, r) in enumerate(zip(keys, ranks, strict=True)):
        j = np.minimum(np.searchsorted(k, own), len(k) - 1)
        d = int(np.where(k[j] == own, np.abs(r[j] - at), top).sum())
        best = min(best, (d, i))
    score = 1.0 - best[0] / (top * len(own))
    return (names[best[1]], score) if known is None or score > known[1] else known


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", top: int = TOP) -> DataFrame:
    """docs' other columns, lang_pred and score. docs must hold the text and columns to carry, no others."""
    carried = [f for f in docs.schema.fields if f.name != text_col]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried) + f"`{text_col}` string, lang_pred string, score double"

    def over(names: list[str], first: bool):
        order = [np.argsort(profiles[n]) for n in names]
        keys, ranks = [profiles[n][o] for n, o in zip(names, order, strict=True)], order
        at = len(carried)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = [None] * b.num_rows if first else zip(b.column(at + 1).to_pylist(), b.column(at + 2).to_pylist(), strict=True)
                found = [nearest(t or "", names, keys, ranks, top, k) for t, k in zip(b.column(at).to_pylist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at + 1)), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*b.schema.names])

        return run

    out = docs.select(*(f"`{f.name}`" for f in carried), F.col(text_col).cast("string").alias(text_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    names = sorted(profiles)
    for i in range(0, len(names), BLOCK):
        out = out.mapInArrow(over(names[i : i + BLOCK], i == 0), schema)
    return out.drop(text_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    profiles = train(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), profiles)
