"""Which joins are broadcast: by the rows that they get, not by the sizes of compressed files."""

from permulocus.functions.staging import written
from permulocus.operators import overlap, sites
from permulocus.plans import algorithms as alg


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_broadcast_small_sides_only(spark):
    many = spark.range(300_000).selectExpr("'chr1' AS chrom", "id % 100 AS start", "id % 100 + 1 AS `end`")
    many, few = written(many, "many"), written(many.limit(20), "few")  # many is a small file: its values repeat
    assert "BroadcastHashJoin" not in _plan(overlap.overlap_pairs(many, many.withColumnRenamed("v", "w"), "point"))
    for r, v in ((few, many), (many, few)):
        assert "BroadcastHashJoin" in _plan(overlap.overlap_pairs(r, v, "closed"))


def test_draws_broadcast_no_index(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS_BYTES", 0)
    seq = spark.createDataFrame([("chr1", 1, "ACGT" * 300)], "chrom string, chunk_start long, bases string")
    bins = spark.createDataFrame([("g", "chr1", 0, 1200)], "grp string, chrom string, start long, `end` long")
    v = spark.createDataFrame([(i, "chr1", 10 + i, 11 + i) for i in range(50)], "vid long, chrom string, start long, `end` long")
    drawn = sites.draw_contexts(v, sites.segments(seq, bins, 3), 2, 3, "t")
    assert "BroadcastHashJoin" not in _plan(drawn)
    assert drawn.count() == 100


def test_a_large_directory_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 0)
    points = spark.range(2000).selectExpr("'chr1' AS chrom", "id AS start", "id + 1 AS `end`")
    out = overlap.overlap_sums(points, points, "count")
    assert "BroadcastHashJoin" not in _plan(out)
    assert out.where("n <> 2").count() == 1


def test_features_are_computed_once(spark):
    """What asks features again reads them: the plan of means has no join left."""
    bins = spark.createDataFrame([("chr1", 1, i * 10, i * 10 + 10) for i in range(20)], "chrom string, ord int, start long, `end` long")
    track = bins.selectExpr("chrom", "start", "`end`", "CAST(start AS decimal(18,2)) AS value")
    out = alg.covariate_features(bins, [track, track])
    assert "Join" not in _plan(out)
    assert all(r.f0 == r.f1 == r.start for r in out.collect())
