"""The directory of prefix sums stays bounded for any positions, and pairs are found from one home a row."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from permulocus.operators import overlap

IV = "chrom string, start long, end long"


def pred(p, v, a):
    return {
        "count": v[1] < a[2] and v[2] >= a[1], "point": a[1] < v[2] <= a[2], "up": a[1] <= v[1] <= a[2],
        "down": a[1] <= v[2] <= a[2], "closed": v[1] <= a[2] and v[2] >= a[1],
    }[p] and v[0] == a[0]


def layouts(kind):
    random.seed(kind)
    if kind == "outlier":
        return [("chr1", 50 * i, 50 * i + 1) for i in range(3000)] + [("chr1", 10**15, 10**15 + 1)]
    if kind == "exome":  # clusters far apart, some very dense
        return [(c, base + x, base + x + 1) for c in ("chr1", "chrX") for base in (10_000, 90_000_000, 200_000_000) for x in random.sample(range(4000), 900)]
    if kind == "powers":
        return [("chr1", 1 << i, (1 << i) + 3) for i in range(50)] + [("chr2", -(1 << i), 5) for i in range(50)]
    return [("chr1", 7, 8)] * 500 + [("chr2", 9, 9)]


@pytest.mark.parametrize("kind", ["outlier", "exome", "powers", "hot"])
def test_rows_are_bounded(spark, kind):
    v = layouts(kind)
    points = overlap.variant_points(spark.createDataFrame(v, IV))
    for level in points.index.levels:
        longest, most_sub = level.rows.agg(F.max(F.size("xs")), F.max("sub")).first()
        assert longest <= overlap.MOST and most_sub < overlap.FAN
    n_rows = sum(level.rows.count() for level in points.index.levels)
    assert n_rows <= len(points.index.levels) * (2 * len(v) / overlap.FILL + 10)
    random.seed(kind + "asks")
    near = [x for _, s, e in random.sample(v, min(30, len(v))) for x in (s - 1, s, e, e + 1)] + [-(10**16), 0, 10**16]
    asks = [(i, c, *sorted((random.choice(near), random.choice(near)))) for i, c in enumerate(["chr1", "chrX", "chr2", "chr9"] * 25)]
    a = spark.createDataFrame(asks, "aid int, " + IV)
    for p in overlap.PREDICATES:
        got = dict(rows(overlap.overlap_sums(a, points, p), "aid", "n"))
        assert got == {i: sum(pred(p, x, (c, s, e)) for x in v) for i, c, s, e in asks}


def test_other_bounds_and_keys(spark):
    random.seed(1)
    v = [(random.choice("ab"), s := random.randrange(300), s + random.randrange(40), random.randrange(3), random.randrange(100)) for _ in range(400)]
    df = spark.createDataFrame([*v, ("a", None, 4, 1, 5), (None, 1, 4, 1, 5), ("a", 1, 4, None, 5)], "chrom string, start long, end long, perm int, w long")
    asks = [(i, random.choice("abc"), s := random.randrange(-5, 310), s + random.randrange(60), random.randrange(3)) for i in range(80)]
    a = spark.createDataFrame([*asks, (99, "a", 1, None, 1)], "aid int, chrom string, start long, end long, perm int")
    for most in (1, 3, 200):
        got = rows(overlap.overlap_sums(a, df, "closed", ["w"], ["perm"], bucket=most), "aid", "n", "sum_w")
        assert got == sorted((i, sum(1 for x in v if x[3] == p and pred("closed", x, (c, s, e))), sum(x[4] for x in v if x[3] == p and pred("closed", x, (c, s, e)))) for i, c, s, e, p in asks)


def test_pairs_equal_brute_force(spark):
    random.seed(2)
    size = lambda: random.choice([0, 1, 3, 900, 1024, 1025, 8192, 9000, 70_000, 600_000])
    r = [(random.choice("ab"), s := random.randrange(-2000, 250_000), s + size()) for _ in range(120)] + [("a", 0, 250_000_000), ("a", 1024, 2048), ("a", 1024, 2048)]
    v = [(random.choice("ab"), s := random.randrange(-2000, 250_000), s + size()) for _ in range(120)] + [("a", 2048, 2048), ("a", 2049, 2049), ("b", 5, 300_000_000)]
    left, right = spark.createDataFrame([*r, ("a", None, 3), (None, 1, 3)], IV), spark.createDataFrame([*v, ("a", 3, None)], IV)
    for p in overlap.PREDICATES:
        for bucket in (16, overlap.BUCKET):
            got = Counter(tuple(x) for x in overlap.overlap_pairs(left, right, p, bucket).collect())
            assert got == Counter((*a, *x) for a in r for x in v if pred(p, x, a))


def test_a_long_interval_is_one_row(spark):
    """A chromosome-long interval is dealt to one home; against points it visits nothing, and each point visits two bins of its level."""
    long = spark.createDataFrame([("chr1", 0, 249_250_621)], IV)
    points = spark.createDataFrame([("chr1", i * 1000, i * 1000) for i in range(500)], IV)
    out = overlap.overlap_pairs(long, points)
    assert out.count() == 500
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate") == 2
    lived = overlap._level(F.col("start"), F.col("end"), overlap.BUCKET)
    assert [r.l for r in long.select(lived.alias("l")).collect()] == [6]


def test_pairs_keep_clashing_names(spark):
    r = spark.createDataFrame([("a", 1, 5, 7, 8)], "chrom string, start long, end long, __br int, v_start int")
    v = spark.createDataFrame([("a", 4, 9, 1)], "chrom string, start long, end long, n int")
    with pytest.raises(ValueError):
        overlap.overlap_pairs(r, v)
    assert overlap.overlap_pairs(r.drop("v_start"), v).columns == ["chrom", "start", "end", "__br", "v_chrom", "v_start", "v_end", "v_n"]
