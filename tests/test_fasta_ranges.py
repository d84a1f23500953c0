"""Indexed FASTA: only byte ranges near regions are read, with the same sites; files without equal lines are read whole."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from permulocus.operators import sites
from permulocus.sources import bigwig, fasta_ranges, readers, sinks

IV = "chrom string, start long, end long"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, path, bases = random.Random(4), tmp_path_factory.mktemp("fa"), {}
    for chrom, size, width, end in (("chr1", 400_000, 60, "\n"), ("chr2", 150_001, 50, ""), ("chrMT", 9_000, 60, "\n"), ("chrX", 70_000, 61, "\n")):
        b = bases[chrom] = "".join(rng.choices("ACGTNacgt", k=size))
        lines = [b[i : i + width] for i in range(0, size, width)]
        if chrom == "chrX":  # one short line in between
            lines[3:5] = [lines[3][:10], lines[3][10:] + lines[4]]
        (path / f"{chrom}.fa").write_text(f">{chrom} of a test\n" + "\n".join(lines) + end)
    return path, bases


def test_index_and_ranges(spark, folder):
    path, bases = folder
    assert readers.index_fasta(spark, str(path)) == ["chr1", "chr2", "chrMT"]
    assert (path / "chr1.fa.fai").read_text() == f"chr1\t400000\t{len('>chr1 of a test') + 1}\t60\t61\n"
    regions = spark.createDataFrame([("chr1", 200_000, 200_300), ("chrM", 5, 10), ("chrX", 10, 60_000), ("chr9", 1, 2)], IV)
    runs = fasta_ranges.asked_runs(regions)
    ranges = fasta_ranges.read(spark, str(path), {"chr1": runs["chr1"], "chrMT": runs["chrM"]}, rows="ranges")
    assert ranges.agg(F.sum("size")).first()[0] <= 1.1 * (bigwig.BIN + 9_000)
    got = readers.fasta(spark, str(path), regions=regions)
    whole = {"chrM": bases["chrMT"]} | bases
    assert {r.chrom for r in got.select("chrom").distinct().collect()} == {"chr1", "chrM", "chrX"}
    for r in got.collect():
        assert whole[r.chrom][r.chunk_start - 1 : r.chunk_start - 1 + len(r.bases)] == r.bases
    assert {r.chrom: r.n for r in got.groupBy("chrom").agg(F.sum(F.char_length("bases")).alias("n")).collect()} == {"chr1": bigwig.BIN, "chrM": 9_000, "chrX": 70_000}


def test_same_sites_as_from_whole_files(spark, folder):
    path, _ = folder
    readers.index_fasta(spark, str(path))
    edge = 2 * bigwig.BIN
    bins = spark.createDataFrame([("a", "chr1", edge - 40, edge), ("b", "chr1", edge, edge + 30), ("b", "chr2", 149_950, 150_001), ("c", "chrX", 100, 300)], "grp string, " + IV)
    count = lambda seq: rows(sites.context_index(sites.segments(seq, bins, 5), 5), "grp", "kmer", "chrom", "c")
    by = lambda seq: sorted({(g, k, c): sum(x[3] for x in count_ if x[:3] == (g, k, c)) for count_ in [count(seq)] for g, k, c, _ in count_}.items())
    assert by(readers.fasta(spark, str(path), regions=bins)) == by(readers.fasta(spark, str(path)))


def test_written_fasta_is_indexed(spark, tmp_path):
    seq = spark.createDataFrame([("chr1", 1, "ACGT" * 50), ("chr1", 201, "TTGCA" * 11), ("chrY", 1, "acgtn" * 3)], "chrom string, chunk_start long, bases string")
    sinks.write_fasta(seq, f"{tmp_path}/fa", width=20)
    assert readers.index_fasta(spark, f"{tmp_path}/fa") == ["chr1", "chrY"]
    near = readers.fasta(spark, f"{tmp_path}/fa", regions=spark.createDataFrame([("chr1", 1, 5)], IV))
    assert rows(near) == [("chr1", 1, "ACGT" * 50 + "TTGCA" * 11)]


def test_equal_lines_keep_their_ids(spark, tmp_path):
    """Ids are a line's hash and its number among equals, however the file is split."""
    (tmp_path / "v.bed").write_text("chr1\t5\t6\tA\n" * 400 + "chr2\t7\t8\tC\n")
    one = rows(readers.variants(spark, f"{tmp_path}/v.bed"), "vid")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        many = rows(readers.variants(spark, f"{tmp_path}/v.bed"), "vid")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one == many and len({x for x, in one}) == 401
