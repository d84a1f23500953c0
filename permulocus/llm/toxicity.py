"""Operator 10, toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features: which character n-grams (lengths in GRAMS, lower-cased, white space as one blank) a text holds once, twice or three times
at least (LEVELS), hashed to 2**HASH_BITS buckets; a bucket at a level is a feature of its own. r = log((p + 1) / |p + 1|) -
log((q + 1) / |q + 1|), from the numbers p and q of toxic and other
training texts that hold a feature. The FEATURES ones whose shares among toxic and other texts differ most (in standard errors), with at
least MIN_TEXTS texts, are kept; on them, with value r where held, Spark's logistic regression is trained, both labels weighing the same. A
score is its probability for the whole text, so it is that of label 1 where both labels are equally frequent.

Levels, FEATURES and REGULARIZATION were chosen by cross-validation on training rows, equal texts in one fold.

Training uses at most about TRAIN_PER_LABEL rows a label, by hash of the id (a documented bound). Counts are summed by feature.
The model is FEATURES weights.

Cases: null or empty text has no feature and gets the score of the intercept; without both labels in training every score is
the share of label 1 (0 where there is no label at all, 0.5 where the drawn rows have one label only); of several labels of one document the greatest counts; null labels and
labels of no document do nothing; repeated rows get equal rows; an empty table gives none; whole texts count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

GRAMS = (4, 5, 6, 7)
HASH_BITS = 20
LEVELS = (1, 2, 3)
FEATURES = 4096
MIN_TEXTS = 5
TRAIN_PER_LABEL = 8000
CUT = 0.7
REGULARIZATION = 1e-3
MAX_ITERATIONS = 100
FOLDS = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> np.ndarray:
    """The hash bucket of each n-gram, repeats included."""
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h, out = np.zeros(len(c), np.uint64), []
    for n in range(1, min(max(GRAMS), len(c)) + 1):  # the hash of an n-gram goes on from that of its first n - 1 characters
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * _ODD
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            out.append(((h + np.uint64(n)) * _ODD) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(out).astype(np.int64) if out else np.array([], np.int64)


def held(found: np.ndarray) -> np.ndarray:
    """The features that n-grams of these buckets make: bucket + 2**HASH_BITS * k where one is there LEVELS[k] times or more."""
    at, n = np.unique(found, return_counts=True)
    return np.concatenate([at[n >= least] + (k << HASH_BITS) for k, least in enumerate(LEVELS)])


@dataclass
class Model:
    slots: np.ndarray  # feature -> its place among the chosen ones, or -1
    weights: np.ndarray  # by feature, already times r
    intercept: float

    def __post_init__(self) -> None:
        self.asked = (self.slots.reshape(len(LEVELS), -1) >= 0).any(0)  # buckets with a chosen level

    def places(self, text: str) -> np.ndarray:
        """Places of the chosen features that the text holds, each once, ascending."""
        found = buckets(text)
        at = self.slots[held(found[self.asked[found]])]
        return np.sort(at[at >= 0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            out[i] = self.intercept + self.weights[self.places(t or "")].sum()
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _counts(sample: DataFrame) -> DataFrame:
    """Rows (feature, p, q): how many texts of label 1 and 0 hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(LEVELS) << HASH_BITS), np.int32)  # 24 MB a task, fixed by HASH_BITS
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[label, held(buckets(text))] += 1
        some = np.flatnonzero(n.any(0))
        for part in np.array_split(some, max(1, len(some) // 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (part, n[1, part], n[0, part])], ["feature", "p", "q"])

    return sample.select("label", "text").mapInArrow(run, "feature long, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> Model:
    """docs: id, text; labels: id, label (0 or 1), one row an id. Only the drawn ids are broadcast, about 2 * per_label."""
    sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    none = np.full(len(LEVELS) << HASH_BITS, -1, np.int32)
    if len(sizes) < 2:
        return Model(none, np.zeros(0), -math.inf if 1 not in sizes else math.inf)
    share = {k: min(1.0, per_label / n) for k, n in sizes.items()}
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003)
    taken = labels.where(chance < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    sample = stage(docs.join(F.broadcast(taken), "id").select("label", F.coalesce("text", F.lit("")).alias("text")), "toxicity-sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model(none, np.zeros(0), 0.0)

    counts = _counts(sample).where(F.col("p") + F.col("q") >= MIN_TEXTS)
    ratio = F.log((F.col("p") + 1) / F.lit(n[1] + 2.0)) - F.log((F.col("q") + 1) / F.lit(n[0] + 2.0))
    pooled = (F.col("p") + F.col("q")) / F.lit(float(n[1] + n[0]))
    spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * F.lit(1 / n[1] + 1 / n[0]))
    weight = F.abs(F.col("p") / F.lit(n[1]) - F.col("q") / F.lit(n[0])) / spread
    picked = counts.withColumn("r", ratio).select("feature", "r", weight.alias("w")).orderBy(F.desc("w"), "feature").limit(FEATURES).collect()
    if not picked:
        return Model(none, np.zeros(0), 0.0)
    r = np.array([x["r"] for x in picked])
    slots = none.copy()
    slots[[x["feature"] for x in picked]] = np.arange(len(picked))

    chosen = docs.sparkSession.sparkContext.broadcast(Model(slots, r, 0.0))

    @F.udf(VectorUDT())
    def vector(text: str):
        at = chosen.value.places(text)
        return Vectors.sparse(len(r), at, r[at])

    weigh = F.when(F.col("label") == 1, n[0] / n[1]).otherwise(1.0).alias("weight")
    rows = sample.select(F.col("label").cast("double").alias("label"), weigh, vector("text").alias("features"))
    fitted = LogisticRegression(maxIter=MAX_ITERATIONS, regParam=REGULARIZATION, standardization=False, weightCol="weight").fit(rows)
    return Model(slots, fitted.coefficients.toArray() * r, float(fitted.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs' other columns, score and predicted. docs must hold the text and columns to carry, no others."""
    carried = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", score double, predicted int"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 13 MB of slots, fixed by HASH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(b.column(len(carried)).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(carried))] + [pa.array(s), pa.array((s >= cut).astype(np.int32))], [f.name for f in carried] + ["score", "predicted"])

    return docs.select(*(f"`{f.name}`" for f in carried), text_col).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    open_labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 1).withColumnRenamed("doc_id", "id")
    model = train(docs.select(F.col("doc_id").alias("id"), "text"), open_labels)
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model)
