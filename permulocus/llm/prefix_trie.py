"""Operator 13, conversation prefix trie, by smallest-member ownership.

A node is a depth and a prefix's fingerprint; it belongs to the smallest conversation that runs through it. A smaller conversation that
shares a prefix shares all shorter ones, so each conversation owns a suffix of its path. Sums over a node's subtree are then sums over its members, with
no walk through the tree: the tokens of all occurrences below it less those that members own themselves is what sharing saves, and each member
that owns a leaf is one leaf. Members are summed with map-side combine, so a first turn that very many conversations share is one row a task.

A prefix's fingerprint is 128 bits, four running sums of 32-bit pieces of a turn's hash with its depth. Running sums go by blocks of BLOCK turns and
over block totals; turns are numbered over a range partitioning and one offset a partition. So no conversation, however long, is one task or one row.
A parent differs from its child's owner only at the top of an owned suffix: only those, one a conversation at most, are joined to their parents.
Ids of conversations that end at a node are hashed as a stream of blocks of END_BLOCK ids in order, never gathered.

Cases: null role or text is empty; equal turn numbers are taken by role, then by the text's hash, and repeated rows are turns each; rows with a null
conversation are left out, null turns come first; a conversation without turns after rebuilding is a member of the root; an empty table has no node; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, table

#: A conversation takes at most HEADS - 1 turns from the one whose id is the next multiple of FAMILY below.
HEADS, FAMILY = 9, 5
BLOCK = 4096
END_BLOCK = 4096
_TURNS = "conv long, h1 long, h2 long, bytes long"
_SUMS = ["a1", "a2", "a3", "a4", "before"]
_KEY = ["depth", "a1", "a2", "a3", "a4"]


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, i (from 1), h1, h2, bytes: each conversation's turns in order; the text itself goes no further than its hash."""
    r, x = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), r.alias("role"), F.xxhash64(r, x).alias("h1"), F.xxhash64(F.lit("second"), r, x).alias("h2"), F.octet_length(x).cast("long").alias("bytes"))
    order = ["conv", "turn", "role", "h1", "h2"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            start = np.r_[True, ids[1:] != ids[:-1]]
            first = np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))
            i = np.arange(1, len(ids) + 1) - first
            if last is not None and ids[0] == last:
                i[first == 0] += n
            last, n = ids[-1], int(i[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(i)], ["conv", "h1", "h2", "bytes", "part", "i"])

    local = stage(dealt.select("conv", "h1", "h2", "bytes").mapInArrow(run, f"{_TURNS}, part int, i long"), "turns")
    # One row a partition: its last conversation and how many of its turns lie there; what a partition's first conversation has before it.
    carried, before = [], {}
    for part, (first, last, n) in sorted((p.part, (p.first, p.last.conv, p.last.i)) for p in local.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "i")).alias("last")).collect()):
        had = before.get(first, 0)
        if had:
            carried.append((part, first, had))
        before = {last: n + (had if first == last else 0)}
    offsets = local.sparkSession.createDataFrame(carried, "part int, conv long, had long")
    return local.join(F.broadcast(offsets), ["part", "conv"], "left").select("conv", (F.col("i") + F.coalesce("had", F.lit(0))).alias("i"), "h1", "h2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, turns): members conv, length; turns conv, depth, h1, h2, bytes of the conversations with the first turns of their family's first. turns: as numbered."""
    base, h = F.col("conv") - F.col("conv") % FAMILY, F.crc32(F.col("conv").cast("string")) % HEADS
    own = turns.groupBy("conv").agg(F.max("i").alias("n")).select("conv", "n", base.alias("base"), h.alias("h"))
    own = own.join(own.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left")
    given = F.least("h", F.coalesce("there", F.lit(0)))
    members = stage(own.select("conv", "base", "h", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "members")
    of_base = turns.where(F.col("i") < HEADS).withColumnRenamed("conv", "base").join(members.where("given > 0").select("conv", "base", "given"), "base")
    heads = of_base.where("i <= given").select("conv", F.col("i").alias("depth"), "h1", "h2", "bytes")
    rest = turns.join(members.select("conv", "h", "given"), "conv").where("i > h").select("conv", (F.col("given") + F.col("i") - F.col("h")).alias("depth"), "h1", "h2", "bytes")
    return members.select("conv", "length"), heads.unionByName(rest)


def paths(members: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, depth from 0, bytes, before (bytes of smaller depths), last, a1-a4 (the prefix's fingerprint), p1-p4 (its parent's)."""
    low = (1 << 32) - 1
    hashes = turns.select("conv", "depth", "bytes", F.xxhash64("depth", "h1", "h2").alias("x"), F.xxhash64(F.lit("second"), "depth", "h1", "h2").alias("y"))
    pieces = [F.col(c).bitwiseAND(low) if part == 0 else F.shiftrightunsigned(c, 32) for c in "xy" for part in (0, 1)]
    rows = hashes.select("conv", "depth", "bytes", F.floor((F.col("depth") - 1) / block).alias("block"), *(p.alias(f"x{i}") for i, p in enumerate(pieces, 1)))
    rows = stage(rows, "rebuilt")
    added = [F.col("x1"), F.col("x2"), F.col("x3"), F.col("x4"), F.col("bytes")]
    upto = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.select("*", *(F.sum(c).over(upto).alias(s) for c, s in zip(added, _SUMS, strict=True)))
    totals = rows.join(members.where(F.col("length") > block), "conv", "left_semi").groupBy("conv", "block").agg(*(F.sum(c).alias(s) for c, s in zip(added, _SUMS, strict=True)))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("conv", "block", *(F.sum(s).over(earlier).alias(f"b_{s}") for s in _SUMS))
    whole = local.join(base, ["conv", "block"], "left").select("conv", "depth", "bytes", *(F.col(f"x{i}") for i in range(1, 5)), *((F.col(s) + F.coalesce(f"b_{s}", F.lit(0))).alias(s) for s in _SUMS))
    whole = whole.join(members, "conv").select("conv", "depth", "bytes", (F.col("before") - F.col("bytes")).alias("before"), (F.col("depth") == F.col("length")).alias("last"), *_KEY[1:], *((F.col(f"a{i}") - F.col(f"x{i}")).alias(f"p{i}") for i in range(1, 5)))
    zero = F.lit(0).cast("long")
    roots = members.select("conv", zero.alias("depth"), zero.alias("bytes"), zero.alias("before"), (F.col("length") == 0).alias("last"), *(zero.alias(f"{x}{i}") for x in "ap" for i in range(1, 5)))
    return stage(whole.unionByName(roots), "paths")


def _ends(path: DataFrame) -> DataFrame:
    """The key and ends_sha256 of nodes at which conversations end."""
    ended = path.where("last").groupBy(*_KEY, F.floor(F.col("conv") / END_BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = ended.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            *keys, ids = (c.to_pylist() for c in batch.columns)
            for *k, text in zip(*keys, ids, strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*_KEY, "ends"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], [*_KEY, "ends"])

    return dealt.select(*_KEY, "ids").mapInArrow(run, ", ".join(f"{k} long" for k in _KEY) + ", ends string")


def nodes(path: DataFrame) -> DataFrame:
    """The trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. path: as of paths."""
    owner = F.min(F.struct("conv", "before", "p1", "p2", "p3", "p4"))
    owned = stage(path.groupBy(*_KEY).agg(owner.alias("o"), F.min("last").alias("leaf")), "owned")
    tops = owned.groupBy(F.col("o.conv").alias("conv")).agg(F.min(F.struct("depth", "o.before", "o.p1", "o.p2", "o.p3", "o.p4")).alias("top"), F.max("leaf").alias("leaf"))
    tops = stage(tops.select("conv", F.col("top.depth").alias("top"), F.col("top.before").alias("free"), *(F.col(f"top.p{i}").alias(f"p{i}") for i in range(1, 5)), F.col("leaf").cast("long").alias("leaf")), "tops")
    # What a conversation shares with a smaller one: the bytes before its own suffix, all of them if it owns nothing.
    each = path.where("last").select("conv", (F.col("before") + F.col("bytes")).alias("all")).join(tops.select("conv", "top", "free", "leaf"), "conv", "left")
    each = each.select("conv", F.col("top"), F.coalesce("free", "all").alias("free"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = F.when(F.col("top").isNull() | (F.col("depth") < F.col("top")), F.col("free") - F.col("before")).otherwise(0)
    zero = F.lit(0).cast("long")
    passing = path.join(each, "conv").select(*_KEY, F.struct("conv", "last").alias("o"), F.lit(1).cast("long").alias("member"), shared.alias("saved"), "leaf", zero.alias("child"))
    hanging = tops.where("top > 0").select((F.col("top") - 1).alias("depth"), *(F.col(f"p{i}").alias(f"a{i}") for i in range(1, 5)), F.lit(None).cast("struct<conv: bigint, last: boolean>").alias("o"), zero.alias("member"), zero.alias("saved"), zero.alias("leaf"), F.lit(1).cast("long").alias("child"))
    sums = passing.unionByName(hanging).groupBy(*_KEY).agg(F.min("o").alias("o"), *(F.sum(c).alias(c) for c in ("member", "saved", "leaf", "child")))
    up = tops.where("top > 0").select("conv", "top", (F.col("top") - 1).alias("depth"), *(F.col(f"p{i}").alias(f"a{i}") for i in range(1, 5)))
    up = up.join(owned.select(*_KEY, F.col("o.conv").alias("parent")), _KEY).select(F.col("conv").alias("up_conv"), F.col("top").alias("up_depth"), "parent")
    out = sums.join(_ends(path), _KEY, "left").join(up, (F.col("o.conv") == F.col("up_conv")) & (F.col("depth") == F.col("up_depth")), "left")
    return out.select(
        F.col("o.conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "o.conv")).alias("parent_conv_id"),
        F.col("member").alias("n_convs"),
        (F.col("child") + F.when(F.col("o.last"), 0).otherwise(1)).alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations."""
    return nodes(paths(*rebuilt(stage(numbered(conversations, conv, turn, role, text), "numbered"))))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(x, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY x) AS t FROM range(256) r(x)
), turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1])), 4294967295) % 9 AS h FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc
), conv AS (
  SELECT a.c, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS given FROM own a LEFT JOIN own b ON b.c = a.base
), r AS (
  SELECT conv.c, i AS d, role, text FROM conv JOIN turns ON turns.c = base AND i <= given
  UNION ALL SELECT conv.c, given + i - h, role, text FROM conv JOIN turns ON turns.c = conv.c AND i > h
), p AS (
  SELECT c, d, octet_length(encode(text)) AS bytes, string_agg(sha256(role || chr(9) || text), '') OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM conv
), ends AS (
  SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max_by(path, d) AS path FROM p GROUP BY c) GROUP BY path
), node AS (
  SELECT path, d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes, CASE WHEN d > 0 THEN substr(path, 1, 64 * (d - 1)) END AS up FROM p GROUP BY path, d
), kids AS (
  SELECT up, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT a.path, sum((b.n - 1) * b.bytes) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves
  FROM node a JOIN node b ON starts_with(b.path, a.path) LEFT JOIN kids ON kids.up = b.path GROUP BY a.path
)
SELECT node.c AS conv_id, node.d AS depth, par.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.k, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (path) LEFT JOIN node par ON par.path = node.up LEFT JOIN kids ON kids.up = node.path LEFT JOIN ends ON ends.path = node.path
"""
