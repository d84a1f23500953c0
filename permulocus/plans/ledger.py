"""Empirical p-values kept up over permutations that come in sets.

The ledger is a folder: the annotations with their observed values, written once; a segment for each added set, one row an annotation that some
permuted variant met: how many of its permutations have a row, how many reach the observed count, how many the observed signal; and a manifest, written after each
segment, with the permutation numbers it holds. Segments add up, so n more permutations cost work on those n. A number that the manifest has is not
counted again, in whatever set it comes back; a segment without its line in the manifest (a job that died) counts for nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import algorithms as alg

_MANIFEST = "segment string, perms array<int>, mode string"


class ExceedanceLedger:
    """path: a folder that driver and executors share. begin() once, add() as sets come, pvalues() at any time; another session opens the same path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def begin(self, variants: DataFrame, annotations: DataFrame, blacklist: DataFrame, mode: str = "n") -> None:
        """Observed values of the annotations that no blacklisted interval touches. A folder that was begun raises."""
        alg.checked(mode, "signal" in variants.columns)
        v, a, _ = alg.prepare(variants, annotations, blacklist)
        alg.observed(a, v, mode).write.parquet(f"{self.path}/observed")
        self._note("", [], mode)

    def _note(self, segment: str, perms: list[int], mode: str) -> None:
        self.spark.createDataFrame([(segment, perms, mode)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _manifest(self) -> list:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise ValueError(f"{self.path} is no ledger") from e

    def permutations(self) -> list[int]:
        """The numbers that it holds."""
        return sorted(p for m in self._manifest() for p in m.perms)

    def add(self, permuted: DataFrame) -> list[int]:
        """Counts in those permutations of permuted (perm, chrom, start, end and, in mode p, signal) that it doesn't hold; gives their numbers."""
        notes = self._manifest()
        mode, held = notes[0].mode, {p for m in notes for p in m.perms}
        new = sorted({r["perm"] for r in permuted.where("perm IS NOT NULL").select("perm").distinct().collect()} - held)  # as many numbers as permutations
        if not new:
            return []
        segment = f"segment-{uuid.uuid4().hex}"
        alg.exceedances(self.observed(), permuted.where(F.col("perm").isin(new)), mode).write.parquet(f"{self.path}/{segment}")
        self._note(segment, new, mode)
        return new

    def observed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/observed")

    def pvalues(self) -> DataFrame:
        """annotations with n_obs, p and by mode signal_obs and signal_p, over all permutations held."""
        notes = self._manifest()
        n, segments = sum(len(m.perms) for m in notes), [f"{self.path}/{m.segment}" for m in notes if m.segment]
        if not n:
            raise ValueError("there is no permutation")
        parts = self.spark.read.parquet(*segments)
        sums = parts.groupBy("aid").agg(*(F.sum(c).alias(c) for c in parts.columns if c != "aid"))
        return alg.shares(self.observed(), sums, n, notes[0].mode)
