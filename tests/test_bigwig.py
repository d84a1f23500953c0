"""bigWig: files of an encoder of the test's own are read, written ones are read back, and only touched blocks are inflated."""

import os
import random
import struct
import zlib

import pytest
from conftest import rows

from permulocus.operators import overlap
from permulocus.sources import bigwig, readers


def encode(path, blocks, order="<", deflate=True, fan=2):
    """blocks: (chrom number, kind, step, span, [(start, end, value)]). Two levels of names where there are more than two chromosomes."""
    p = lambda f, *x: struct.pack(order + f, *x)
    names = ["chr1", "chr2", "chrMT", "chrUn"]
    rows_ = [n.encode().ljust(5, b"\0") + p("II", i, 10**6) for i, n in enumerate(names)]
    at = 64
    head = p("IIIIQQ", 0x78CA8C91, 2, 5, 8, len(names), 0)
    inner = at + 32
    leaf0 = inner + 4 + 2 * 13
    leaf1 = leaf0 + 4 + 2 * 13
    tree = head + p("BBH", 0, 0, 2) + names[0].encode().ljust(5, b"\0") + p("Q", leaf0) + names[2].encode().ljust(5, b"\0") + p("Q", leaf1)
    tree += p("BBH", 1, 0, 2) + b"".join(rows_[:2]) + p("BBH", 1, 0, 2) + b"".join(rows_[2:])
    data_at = at + len(tree)
    body, entries = p("Q", len(blocks)), []
    for chrom, kind, step, span, values in blocks:
        items = {1: lambda v: p("IIf", *v), 2: lambda v: p("If", v[0], v[2]), 3: lambda v: p("f", v[2])}[kind]
        raw = p("IIIIIBBH", chrom, values[0][0], values[-1][1], step, span, kind, 0, len(values)) + b"".join(map(items, values))
        raw = zlib.compress(raw) if deflate else raw
        entries.append((chrom, values[0][0], chrom, values[-1][1], data_at + len(body), len(raw)))
        body += raw
    index_at = data_at + len(body)
    leaves = [entries[i : i + fan] for i in range(0, len(entries), fan)]
    index = p("IIQIIIIQII", 0x2468ACE0, fan, len(entries), 0, 0, 9, 9, index_at, 1, 0) + p("BBH", 0, 0, len(leaves))
    place = index_at + 48 + 4 + 24 * len(leaves)
    for leaf in leaves:
        index += p("IIIIQ", *leaf[0][:2], *leaf[-1][2:4], place)
        place += 4 + 32 * len(leaf)
    for leaf in leaves:
        index += p("BBH", 1, 0, len(leaf)) + b"".join(p("IIIIQQ", *e) for e in leaf)
    header = p("IHHQQQHHQQIQ", 0x888FFC26, 4, 0, at, data_at, index_at, 0, 0, 0, 0, 4096 if deflate else 0, 0)
    with open(path, "wb") as f:
        f.write(header + tree + body + index)


BLOCKS = [
    (0, 1, 0, 0, [(0, 10, 1.5), (10, 30, 2.0)]),
    (0, 2, 0, 5, [(100_000, 100_005, 0.25), (100_050, 100_055, 4.0)]),
    (0, 3, 20, 7, [(400_000, 400_007, 1.0), (400_020, 400_027, 2.0), (400_040, 400_047, 3.0)]),
    (1, 1, 0, 0, [(5, 9, -1.0)]),
    (2, 1, 0, 0, [(3, 4, 8.0)]),
    (3, 1, 0, 0, [(3, 4, 9.0)]),
]
NAMES = ["chr1", "chr2", "chrMT", "chrUn"]
VALUES = sorted((NAMES[c], *v) for c, *_, values in BLOCKS for v in values)


@pytest.mark.parametrize(("order", "deflate"), [("<", True), (">", True), ("<", False)])
def test_reads_all_kinds(spark, tmp_path, order, deflate):
    encode(tmp_path / "x.bw", BLOCKS, order, deflate)
    assert rows(bigwig.read(spark, str(tmp_path / "x.bw"), subtrees=1)) == VALUES
    assert rows(bigwig.read(spark, f"file://{tmp_path}/x.bw")) == VALUES
    got = readers.signal(spark, str(tmp_path / "x.bw"))
    assert {r.chrom for r in got.collect()} == {"chr1", "chr2", "chrM"}


def test_inflates_touched_blocks_only(spark, tmp_path):
    encode(tmp_path / "x.bw", BLOCKS)
    asked = spark.createDataFrame([("chr1", 100_010, 100_060), ("chrM", 0, 5), ("chr2", 900_000, 900_001), (None, 1, 2)], "chrom string, start long, end long")
    blocks = bigwig.read(spark, str(tmp_path / "x.bw"), asked, rows="blocks")
    assert rows(blocks, "chrom", "start", "items") == [("chr1", 100_000, 2), ("chrMT", 3, 1)]
    assert bigwig.read(spark, str(tmp_path / "x.bw"), rows="blocks").count() == len(BLOCKS)
    assert rows(bigwig.read(spark, str(tmp_path / "x.bw"), asked.limit(0))) == []


def test_round_trip_over_many_nodes(spark, tmp_path):
    random.seed(4)
    data = [(random.choice(["chr1", "chr2", "chrX"]), s := random.randrange(3_000_000), s + random.randrange(1, 5000), random.randrange(-400, 400) / 4) for _ in range(5000)]
    path, df = f"file://{tmp_path}/track.bw", spark.createDataFrame([*data, ("chr1", None, 4, 1.0), ("chr1", 1, 4, None)], "chrom string, start long, end long, value double")
    bigwig.write(df.repartition(3), path, items=16, node_items=4, files=3)
    assert all(not n.startswith("_") for n in os.listdir(tmp_path / "track.bw")) and len(os.listdir(tmp_path / "track.bw")) == 3
    for subtrees in (1, 64):
        assert rows(bigwig.read(spark, path, subtrees=subtrees)) == sorted(data)
    regions = spark.createDataFrame([("chr1", 5000, 90_000), ("chrX", 2_000_000, 2_000_400), ("chr9", 1, 5)], "chrom string, start long, end long")
    part = bigwig.read(spark, path, regions)
    every, some = (bigwig.read(spark, path, r, rows="blocks").count() for r in (None, regions))
    assert 0 < some < every / 4
    mean = lambda track: rows(overlap.interval_means(regions, track.withColumn("value", track.value.cast("decimal(18,6)"))))
    assert mean(part) == mean(df.where("start IS NOT NULL AND value IS NOT NULL"))


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("chr1", 1, 5, 1.0), ("chr2", -3, 5, 1.0)], "chrom string, start long, end long, value double").repartition(2)
    with pytest.raises(Exception, match="not an interval"):
        bigwig.write(bad, f"{tmp_path}/bad.bw")
    assert not os.path.isdir(tmp_path / "bad.bw") or os.listdir(tmp_path / "bad.bw") == []


def test_no_track(spark, tmp_path):
    with pytest.raises(ValueError, match="does not exist"):
        bigwig.read(spark, str(tmp_path / "none.bw"))
    (tmp_path / "short.bw").write_bytes(b"x" * 10)
    with pytest.raises(Exception, match="no bigWig file"):
        bigwig.read(spark, str(tmp_path / "short.bw")).collect()
    bigwig.write(spark.createDataFrame([], "chrom string, start long, end long, value double"), f"{tmp_path}/empty.bw")
    with pytest.raises(ValueError, match="is empty"):
        bigwig.read(spark, f"{tmp_path}/empty.bw")
