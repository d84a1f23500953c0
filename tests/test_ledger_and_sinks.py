"""The ledger adds up sets of permutations; permutation files appear all at once or not at all."""

import os
import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from permulocus.plans import algorithms as alg
from permulocus.plans.ledger import ExceedanceLedger
from permulocus.sources import readers, sinks

IV = "chrom string, start long, end long"


def world(spark, seed=2):
    rng = random.Random(seed)
    at = lambda far: (rng.choice(["chr1", "chr2"]), s := rng.randrange(far), s + 1)
    sig = lambda: Decimal(rng.randrange(-50, 400)) / 100
    v = spark.createDataFrame([(i, *at(4000), sig()) for i in range(150)], f"vid long, {IV}, signal decimal(18,2)")
    a = spark.createDataFrame([(i, c, s, s + rng.randrange(1, 200), f"a{i}", i, -i) for i in range(60) for c, s, _ in [at(5000)]], f"aid long, {IV}, name string, n int, rows int")
    moved = spark.createDataFrame([(p, *at(4000), sig()) for p in range(1, 8) for _ in range(100)], f"perm int, {IV}, signal decimal(18,2)")
    black = spark.createDataFrame([("chr1", 100, 200)], IV)
    return v, a, black, moved


def brute(spark, v, a, black, moved):
    """Listed pairs for every annotation and permutation."""
    b = black.collect()
    free = lambda rs: [r for r in rs if not any(r.chrom == x.chrom and r.start <= x.end and r.end >= x.start for x in b)]
    n_of = lambda x, rs: sum(r.chrom == x.chrom and r.start < x.end and r.end >= x.start for r in rs)
    s_of = lambda x, rs: sum((r.signal for r in rs if r.chrom == x.chrom and x.start < r.end <= x.end), Decimal(0))
    sets = {}
    for r in moved.collect():
        sets.setdefault(r.perm, []).append(r)
    out, vs = [], free(v.collect())
    for x in free(a.collect()):
        n, s = n_of(x, vs), s_of(x, vs)
        out.append((x.aid, n, float(s), sum(n_of(x, r) >= n for r in sets.values()) / len(sets), sum(s_of(x, r) >= s for r in sets.values()) / len(sets)))
    return sorted(out)


def values(df):
    return sorted((r.aid, r.n_obs, float(r.signal_obs), r.p, r.signal_p) for r in df.collect())


def test_empirical_brute_force_and_columns(spark):
    v, a, black, moved = world(spark)
    got = alg.empirical_pvalues(v, a, black, moved, "p")
    assert values(got) == brute(spark, v, a, black, moved)
    assert {(r.aid, r.n, r["rows"]) for r in got.collect()} <= {(i, i, -i) for i in range(60)}  # columns of these names are kept
    hits = alg.exceedances(got.select("aid", "chrom", "start", "end", "n_obs", "signal_obs"), moved, "p")
    assert 0 < hits.agg(F.sum("rows")).first()[0] < 60 * 7


def test_ledger_adds_up(spark, tmp_path):
    v, a, black, moved = world(spark)
    whole = brute(spark, v, a, black, moved)
    ledger = ExceedanceLedger(spark, f"file://{tmp_path}/ledger")
    ledger.begin(v, a, black, "p")
    with pytest.raises(ValueError, match="no permutation"):
        ledger.pvalues()
    assert ledger.add(moved.where("perm IN (2, 5)")) == [2, 5]
    assert values(ledger.pvalues()) == brute(spark, v, a, black, moved.where("perm IN (2, 5)"))
    again = ExceedanceLedger(spark, f"file://{tmp_path}/ledger")  # another session
    assert again.add(moved.where("perm IN (1, 2, 3)")) == [1, 3]
    assert again.add(moved.where("perm IN (1, 2, 3)")) == []
    moved.limit(3).write.parquet(f"{tmp_path}/ledger/segment-of-a-job-that-died")
    assert again.add(moved) == [4, 6, 7] and again.permutations() == [1, 2, 3, 4, 5, 6, 7]
    assert values(again.pvalues()) == whole
    with pytest.raises(Exception, match="already exists"):
        again.begin(v, a, black, "p")
    with pytest.raises(ValueError, match="no ledger"):
        ExceedanceLedger(spark, f"{tmp_path}/none").pvalues()


def files(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)


def test_one_sorted_file_a_permutation(spark, tmp_path):
    rng = random.Random(1)
    data = [(p, i, rng.choice(["chr2", "chr10", "chrX"]), s := rng.randrange(1000), s + 1, "é" * (i % 3)) for p in (1, 2, 11) for i in range(300)]
    df = spark.createDataFrame(data, f"perm int, vid long, {IV}, alt string").repartition(5)
    sinks.write_permuted(df, f"{tmp_path}/perms")
    assert files(tmp_path / "perms") == [f"perm={p}/part-{p}.txt" for p in (1, 11, 2)]
    for p in (1, 2, 11):
        lines = (tmp_path / f"perms/perm={p}/part-{p}.txt").read_text().split("\n")[:-1]
        order = [(["chr2", "chr10", "chrX"].index(x[0]), int(x[1]), int(x[2])) for x in (line.split("\t") for line in lines)]
        assert len(lines) == 300 and order == sorted(order)
    back = readers.permutations(spark, f"{tmp_path}/perms")
    assert rows(back.select("perm", "chrom", "start", "end")) == sorted((p, c, s, e) for p, _, c, s, e, _ in data)
    with pytest.raises(ValueError, match="holds files"):
        sinks.write_permuted(df, f"{tmp_path}/perms")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 4).cast("int").alias("perm"), F.lit("chr1").alias("chrom"), F.col("id").alias("start"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id") + 1).alias("end"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_permuted(df, f"{tmp_path}/perms")
    assert files(tmp_path / "perms") == []
    sinks.write_permuted(df.where("perm < 1 AND id < 50"), f"{tmp_path}/perms")
    assert files(tmp_path / "perms") == ["perm=0/part-0.txt"]
