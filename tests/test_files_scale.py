"""What files to p-values cost: lines are split once, dealt by hashes, and permuted sites that are the same place are one."""

import re
from decimal import Decimal

from pyspark.sql import functions as F

from permulocus.operators import overlap
from permulocus.plans import algorithms as alg
from permulocus.sources import readers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_split_once(spark, tmp_path):
    (tmp_path / "v.txt").write_text("chr1\t5\t6\tx\n chr1\t1\t2\nchrMT\t7\t8\n\nchr1\tno\t3\nchr1\t4\n")
    got = readers._interval(readers._lines(spark, f"file://{tmp_path}/v.txt"))
    assert _plan(got).count("split(") == 1
    assert sorted(map(tuple, got.collect())) == [("chr1", 5, 6), ("chrM", 7, 8)]


def test_lines_are_numbered_by_hashes(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text("chr1\t5\t9\tx\n" * 2 + f"chr1\t{i}\t9\ty\n")
    got = readers.annotations(spark, f"file://{folder}")
    assert not [x for x in _plan(got).splitlines() if "Exchange" in x and re.search("value#|file_path#", x)]
    line = "chr1\t5\t9\tx"
    hashed = {r[0] for r in spark.range(1, 7).select(F.xxhash64(F.lit(line), F.col("id").cast("int"))).collect()}
    assert {r.aid for r in got.where("name = 'x'").collect()} == hashed  # numbers 1 to 6, over all files
    assert got.select("aid").distinct().count() == 9


def test_points_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(x: int) -> int:
        seen.add(1)
        return x

    rows = spark.range(500).select(F.lit("chr1").alias("chrom"), F.explode(F.array(F.udf(passed, "long")("id"))).alias("x"), F.lit(1).cast("long").alias("n"))
    overlap.prefix_index(rows, ["chrom"], ["n"])
    assert seen.value == 500


def test_sites_of_one_place_are_one(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(overlap, "overlap_pairs", lambda *a, f=overlap.overlap_pairs, **b: pairs.append(f(*a, **b)) or pairs[-1])
    obs = spark.createDataFrame([(1, "chr1", 10, 20, 30, Decimal(50)), (2, "chr1", 21, 30, 40, Decimal(0))], "aid long, chrom string, start long, `end` long, n_obs long, signal_obs decimal(18,6)")
    sites = [(1 + i % 2, "chr1", 20 - i % 2, 21 - i % 2, Decimal(i % 4) if i % 8 else None) for i in range(100)]
    moved = spark.createDataFrame(sites, "perm int, chrom string, start long, `end` long, signal decimal(18,6)")
    got = {r.aid: r for r in alg.exceedances(obs, moved, "p").collect()}
    assert pairs[0].count() == 3  # places 19 and 20 meet the first, place 20 the second
    for o in obs.collect():
        of = [[s for s in sites if s[0] == p and s[2] <= o.end and s[3] >= o.start] for p in (1, 2)]
        met = [x for x in of if x]
        n = [sum(s[2] < o.end and s[3] >= o.start for s in x) for x in met]
        total = [sum(s[4] or 0 for s in x if o.start < s[3] <= o.end) for x in met]
        assert (got[o.aid].rows, got[o.aid].over, got[o.aid].signal_over) == (len(met), sum(x >= o.n_obs for x in n), sum(x >= o.signal_obs for x in total))
