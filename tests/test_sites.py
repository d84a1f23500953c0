"""Draws by rank equal those over a list of every base."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from permulocus.functions import kmers
from permulocus.operators import permute, sites

BINS = [("g1", "chr1", 0, 400), ("g2", "chr1", 400, 950), ("g1", "chr2", 10, 1300), ("g3", "chr2", 1300, 1310)]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    seq = []
    for chrom in ("chr1", "chr2"):
        bases = "".join(rng.choice("ACGTacgt" if i % 500 > 60 else "N") for i in range(1400))
        seq += [(chrom, at + 1, bases[at : at + 450]) for at in range(0, 1400, 450)]
    seq = spark.createDataFrame(seq, "chrom string, chunk_start long, bases string")
    bins = spark.createDataFrame(BINS, "grp string, chrom string, start long, end long")
    v = spark.createDataFrame([(i, rng.choice(["chr1", "chr2"]), p - 1, p) for i in range(120) for p in [rng.randrange(1, 1400)]], "vid long, chrom string, start long, end long")
    return seq, bins, v


@pytest.mark.parametrize("k", [3, 5])
@pytest.mark.parametrize("length", [7, 512])
def test_contexts_equal_a_list_of_bases(spark, world, k, length):
    seq, bins, v = world
    listed = permute.candidates(kmers.positions(seq, k).where(~F.col("kmer").contains("N")), bins)
    own = listed.select("grp", "chrom", F.col("pos").alias("end"), "kmer")
    want = permute.draw_sites(v.join(own, ["chrom", "end"]).select("vid", "chrom", "end", "grp", "kmer"), listed, 5, "t", 3)
    segs = sites.segments(seq, bins, k, length)
    assert rows(sites.draw_contexts(v, segs, 5, k, "t", 3), "vid", "perm", "chrom", "start", "end") == rows(want, "vid", "perm", "chrom", "start", "end")
    index = sites.context_index(segs, k)
    assert index.count() <= segs.count() * min(4**k, length)
    assert rows(index.groupBy("grp", "kmer").agg(F.sum("c"))) == rows(listed.where("rank = 1").select("grp", "kmer", "c"))


def test_uniform_equals_a_list_of_bases(spark, world):
    seq, bins, v = world
    listed = permute.candidates(kmers.positions(seq, 1).where(~F.col("kmer").contains("N")).withColumn("kmer", F.lit("*")), bins)
    own = listed.select("grp", "chrom", F.col("pos").alias("end"), "kmer")
    want = permute.draw_sites(v.join(own, ["chrom", "end"]).select("vid", "chrom", "end", "grp", "kmer"), listed, 5, "t", 3, exclude_own=False)
    free = sites.runs(seq, bins)
    assert rows(sites.draw_uniform(v, free, 5, "t", 3), "vid", "perm", "chrom", "start", "end") == rows(want, "vid", "perm", "chrom", "start", "end")
    assert free.count() < 20 and free.agg(F.sum("c")).first()[0] == listed.count()


def test_no_sequence_no_variants_and_bad_bases(spark, world):
    seq, bins, v = world
    assert sites.draw_contexts(v, sites.segments(seq.limit(0), bins, 3), 2, 3, "t").count() == 0
    assert sites.draw_uniform(v.limit(0), sites.runs(seq, bins), 2, "t").count() == 0
    bad = spark.createDataFrame([("chr1", 1, "ACX" * 20)], seq.schema)
    for draw in (lambda: sites.context_index(sites.segments(bad, bins, 3), 3), lambda: sites.runs(bad, bins)):
        with pytest.raises(Exception, match="not a base"):
            draw()
