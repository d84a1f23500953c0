"""Absorption over long stretches of narrow bins equals the fold from left to right."""

import random

import pytest
from conftest import rows

from permulocus.operators import intervals


def fold(bins, least):
    left, gone = [list(b) for b in bins], [False] * len(bins)
    for i in range(len(left)):
        s, e = left[i]
        if e - s >= least:
            continue
        if i and not gone[i - 1] and left[i - 1][1] == s:
            left[i - 1][1] = e
        elif i + 1 < len(left) and left[i + 1][0] == e:
            left[i + 1][0] = s
        gone[i] = True
    return [tuple(b) for b, g in zip(left, gone, strict=True) if not g]


@pytest.mark.parametrize(("widths", "least"), [([1], 8), ([1, 2, 3], 4), ([7, 1, 40], 8), ([3, 9], 10), ([50], 8)])
def test_long_stretches(spark, widths, least):
    rng = random.Random(least)
    data = []
    for chrom, gap in (("chr1", 0.0), ("chr2", 0.02), ("chrX", 0.4)):
        at = 5
        for _ in range(300):
            at += 2 if rng.random() < gap else 0
            data.append((chrom, 1, at, at + rng.choice(widths)))
            at = data[-1][3]
    df = spark.createDataFrame(data, "chrom string, ord int, start long, end long").repartition(3)
    want = sorted((c, s, e) for chrom in ("chr1", "chr2", "chrX") for c, (s, e) in ((chrom, b) for b in fold([d[2:] for d in data if d[0] == chrom], least)))
    assert rows(intervals.absorb(df, least), "chrom", "start", "end") == want
