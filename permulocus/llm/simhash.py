"""Operator 7, SimHash near-dedup by anchor-point covering.

Fingerprints: 64 bits, each set where over half of the text's shingle hashes have it set.

Links (at most THRESHOLD = 2 differing bits) are found at anchors. The anchors are the words of the perfect Hamming code
[63, 57] over a fingerprint's low 63 bits, whose covering radius is 1. Two linked fingerprints have a point between them
within one bit of both, and an anchor within one bit of that point; so each fingerprint goes to every anchor within
covering radius + half the threshold = 2 (32 of them at most, 1 for a code word) and no link is lost. That is
a smaller ball than covering radius + threshold, which needs 652. All fingerprints are compared per anchor.

An anchor's group is bounded by geometry, not by data: at most 2 * 2017 distinct fingerprints lie within two bits of it. Exact
copies and other equal fingerprints are one representative, the smallest id. A group gives a tree of links, not all pairs; what
is connected within groups is connected by the trees.

Cases: null or empty text has fingerprint zero, linked like any other; rows with a null id get a fingerprint and a null component and link
nothing; repeated rows are copies; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small, stage, table
from .components import components

SHINGLE = 3
THRESHOLD = 2
SEED = 42

#: Counts of set bits by byte value and bit.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8, dtype=np.uint16) << 8)[None, :]


def fingerprint_bytes(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The fingerprint of a text's words, as an unsigned number."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp), fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_bytes((t or b"").lower().split(), shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def anchors(fp: Column) -> Column:
    """All code words within two bits of fp's low 63 bits. Position p (1 to 63) of the code is bit p - 1.

    A word's syndrome is the exclusive or of its set positions; flipping positions i and j with i ^ j = syndrome (0: none) gives a code word.
    """
    low = fp.bitwiseAND(F.lit(2**63 - 1))
    mask = lambda k: sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1)
    syndrome = sum(((F.bit_count(low.bitwiseAND(F.lit(mask(k)))) % 2) * (1 << k) for k in range(6)), F.lit(0)).cast("int")
    flip = F.array(F.lit(0).cast("long"), *(F.lit(1 << (p - 1)) for p in range(1, 64)))
    pair = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(syndrome))
    return F.when(syndrome == 0, F.array(low)).otherwise(F.transform(pair, lambda i: low.bitwiseXOR(F.get(flip, i)).bitwiseXOR(F.get(flip, i.bitwiseXOR(syndrome)))))


def group_tree(fps: np.ndarray, ids: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges (id, root) that connect exactly what links within threshold bits connect; root is a component's smallest id."""
    order = np.argsort(ids, kind="stable")
    fps, ids = fps[order].view(np.uint64), ids[order]  # unsigned: bits of a negative number count as its absolute value's
    rest, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if not rest[i]:
            continue
        rest[i], front = False, [i]
        while front:
            near = rest & (np.bitwise_count(fps ^ fps[front.pop()]) <= threshold)
            rest &= ~near
            new = np.flatnonzero(near).tolist()
            front += new
            out += [(int(ids[j]), int(ids[i])) for j in new]
    return out


def _per_anchor(edges_of):
    """For rows (anchor, ...) sorted by anchor: the pairs (a, b) that edges_of(anchor, other columns of its rows) gives."""

    def of(cols: list[np.ndarray]) -> pa.RecordBatch:
        edges: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if len(cols[0]) else np.array([], int)
        ends = np.r_[starts[1:], len(cols[0])]
        many = ends - starts > 1
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            edges += edges_of(int(cols[0][s]), *(c[s:e] for c in cols[1:]))
        x = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            if len(now[0]):
                cut = int(np.searchsorted(now[0], now[0][-1]))  # the last anchor may go on in the next batch
                yield of([c[:cut] for c in now])
                held = [c[cut:] for c in now]
        if held:
            yield of(held)

    return run


def link_components(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fps: staged rows (doc_id, fp). Gives (fp, component_id)."""
    reps = stage(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    at = reps.select(F.explode(anchors(F.col("fp"))).alias("anchor"), "fp", "rep")
    edges = at.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_per_anchor(lambda _, fp, rep: group_tree(fp, rep, threshold)), "a long, b long")
    labels = components(edges)
    return reps.join(labels, reps["rep"] == labels["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (doc_id, fp, component_id), one a row of docs."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    found = fps.join(link_components(fps, threshold), "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- near copies by similarity ---
#
# Two linked bits say little about a similarity of 0.8: such texts differ in about a tenth of the bits. So for a decision by similarity,
# SimHash at anchors only finds candidates, which are then compared in full:
# * fingerprints of 128 bits are taken over a text's distinct words, of which copies with single words changed share most;
# * they are cut into four bands of 31 bits, each with the perfect Hamming code [31, 26] as anchors; texts that differ in at most two
#   bits of some band meet at an anchor (16 anchors a band);
# * an anchor with more than BLOCK texts is dealt into blocks of about that many, each of which also gets the anchor's smallest id, so that
#   a large group is neither one task nor compared with itself as a whole;
# * in a block each text is paired with its closest one of smaller id within BITS bits, so pairs grow with texts; a pair stands if
#   its five-word shingles have a Jaccard similarity of at least SIMILAR, and what pairs connect is one group from then on.
#
# That leaves near copies apart whose bits differ more (blocks added or cut off) or that met in no block. So what is in different groups
# is searched once more, exactly, by prefixes:
# * all texts' distinct shingles have one order: by hash, but the HOT_SHINGLES most frequent of a sample last. Sampling decides the order only;
# * two texts of similarity SIMILAR at least share a shingle among the first n - ceil(SIMILAR * n) + 1 of the longer and the first
#   n - ceil(2 * SIMILAR / (1 + SIMILAR) * n) + 1 of the other (n: a text's shingles), as at least the rest of each must be common;
# * only shingles of two groups are joined. For each, the group with most texts there is never joined to itself: its texts meet those of the
#   others only. So a large group costs rows in proportion to itself;
# * a pair goes on if the sizes, what is left of both texts from that shingle on, and the parities allow the similarity: each text
#   has PARITIES bits, each the parity of how many of its shingles fall on it, and two texts differ in at least as many shingles as bits.
#
# All pairs, of either search, then pass the same test with WIDE_PARITIES bits, so that texts are moved and made sets of shingles for few of them.

BANDS = 4
BITS = 26
BLOCK = 2048
SIMILAR = 0.8
WORDS = 5
HOT_SHINGLES = 100_000
HOT_SAMPLE = 16
PARITIES = 256
WIDE_PARITIES = 2048
_PARITY = tuple(f"p{i}" for i in range(PARITIES // 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EPS = 1e-9


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Hashes of a text's distinct five-word shingles, sorted, from its words' hashes; none for fewer words (such texts are similar only if equal)."""
    n = len(hashes) - WORDS + 1
    if n < 1:
        return np.array([], np.int64)
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        s = (s ^ hashes[k : k + n]) * _MIX
        s ^= s >> np.uint64(29)
    return np.unique(s.view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")


def _hashed(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """A text's words, joined by single blanks, and their hashes."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    return b" ".join(words), np.array([xxh64_intdigest(w, SEED) for w in words], dtype="<u8")


def hot_shingles(docs: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, sorted, and the place of each in the order from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(_hashed(t)[1]))], ["token"])

    tokens = _texts(docs, id_col, text_col).where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).mapInArrow(run, "token long")
    top = tokens.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(HOT_SHINGLES).select("token").toArrow()
    hot = top.column("token").to_numpy()[::-1].astype(np.int64)
    order = np.argsort(hot)
    return hot[order], order


def first_shingles(s: np.ndarray, hot: np.ndarray, place: np.ndarray) -> np.ndarray:
    """As many of a set's first shingles, in the common order, as the longer text of a pair needs."""
    need = len(s) - int(np.ceil(SIMILAR * len(s) - _EPS)) + 1 if len(s) else 0
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        late = hot[at] == s
        s = np.concatenate([s[~late], s[late][np.argsort(place[at[late]])]])
    return s[:need]


def text_prints(docs: DataFrame, id_col: str, text_col: str, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (doc_id, text_hash, k1, k2, fa, fb, p0.., n, tokens): a hash of the text as it stands, a 128-bit key of the text's words in order, the fingerprint's halves, parities, number of shingles, the first of them, more parities."""
    names = ("k1", "k2", "fa", "fb", *_PARITY)
    sent = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_SHINGLES pairs of numbers at most

    def majority(h: np.ndarray) -> int:
        if not len(h):
            return 0
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
        return int(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").view("<u8")[0])

    def one(text: bytes | None) -> tuple:
        from xxhash import xxh64_intdigest

        whole, h = _hashed(text)
        distinct = np.unique(h)
        second = distinct * _MIX
        second = (second ^ (second >> np.uint64(32))) * _MIX
        s = shingle_set(h)
        wide = (np.bincount(s & (WIDE_PARITIES - 1), minlength=WIDE_PARITIES) & 1).astype(bool)
        parity = np.packbits(np.bitwise_xor.reduce(wide.reshape(-1, PARITIES), axis=0), bitorder="little").view("<u8")
        return (xxh64_intdigest(whole, 1), xxh64_intdigest(whole, 2), majority(distinct), majority(second ^ (second >> np.uint64(29))), *parity.tolist()), len(s), first_shingles(s, *sent.value), np.packbits(wide, bitorder="little").view("<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [one(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
                keys = np.array([r[0] for r in rows], dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), *(pa.array(keys[:, i]) for i in range(len(names))), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (2, 3))],
                    ["doc_id", "text_hash", *names, "n", "tokens", "wide"],
                )

    return _texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, " + "".join(f"{c} long, " for c in names) + "n long, tokens array<long>, wide array<long>")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (a, b, rep, k1, k2, text) in the order of a and b, rep being either: the pairs whose sets of shingles are similar. A text with other keys than k1 and k2 is not the one that counts."""
    from xxhash import xxh64_intdigest

    key, sets = None, {}
    for whole in batches:
        out: list[tuple[int, int]] = []
        for at in range(0, whole.num_rows, 64):
            part = whole.slice(at, 64)
            *numbers, texts = part.columns
            for a, b, rep, k1, k2, text in zip(*(c.to_pylist() for c in numbers), texts.cast(pa.binary()).to_pylist(), strict=True):
                if key != (a, b):
                    key, sets = (a, b), {}
                if rep in sets:
                    continue
                words, hashes = _hashed(text)
                if (xxh64_intdigest(words, 1), xxh64_intdigest(words, 2)) != (k1 % 2**64, k2 % 2**64):
                    continue
                sets[rep] = shingle_set(hashes)
                if len(sets) == 2:
                    n, m = len(np.intersect1d(*sets.values(), assume_unique=True)), sum(map(len, sets.values()))
                    if n >= SIMILAR * (m - n) - _EPS:
                        out.append(key)
        x = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def band_anchors(fa: Column, fb: Column) -> Column:
    """All anchors of the four bands: the code word, with the band's number above it. See anchors()."""
    flip = F.array(F.lit(0), *(F.lit(1 << (p - 1)) for p in range(1, 32)))
    mask = lambda k: sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)

    def of(band: int) -> Column:
        half = fa if band < 2 else fb
        low = F.shiftrightunsigned(half, 32 * (band % 2)).bitwiseAND(F.lit(2**31 - 1)).cast("int")
        syndrome = sum(((F.bit_count(low.bitwiseAND(F.lit(mask(k)))) % 2) * (1 << k) for k in range(5)), F.lit(0)).cast("int")
        pair = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i < i.bitwiseXOR(syndrome))
        words = F.when(syndrome == 0, F.array(low)).otherwise(F.transform(pair, lambda i: low.bitwiseXOR(F.get(flip, i)).bitwiseXOR(F.get(flip, i.bitwiseXOR(syndrome)))))
        return F.transform(words, lambda w: w.cast("long") + F.lit(band << 31))

    return F.concat(*(of(b) for b in range(BANDS)))


def nearest_smaller(key: int, fa: np.ndarray, fb: np.ndarray, ids: np.ndarray, block: int = 512) -> list[tuple[int, int]]:
    """Pairs (a, b): for each id its closest one of smaller id within BITS bits, if any.

    A pair counts in the first band that could bring it together only, so not again at every later one. Memory is bounded by block rows.
    """
    bands = [(x >> np.uint64(shift)) & np.uint64(2**31 - 1) for x in (fa.view(np.uint64), fb.view(np.uint64)) for shift in (0, 32)][: key >> 31 & 3]
    order = np.argsort(ids, kind="stable")
    bands = [b[order] for b in bands]
    fa, fb, ids, out = fa[order].view(np.uint64), fb[order].view(np.uint64), ids[order], []
    for s in range(0, len(ids), block):
        e = min(len(ids), s + block)
        d = np.bitwise_count(fa[s:e, None] ^ fa[None, :e]).astype(np.int16) + np.bitwise_count(fb[s:e, None] ^ fb[None, :e])
        d[ids[None, :e] >= ids[s:e, None]] = 999
        for b in bands:
            d[np.bitwise_count(b[s:e, None] ^ b[None, :e]) <= 2] = 999
        at = d.argmin(1)
        i = np.flatnonzero(d[np.arange(e - s), at] <= BITS)
        out += zip(ids[s + i].tolist(), ids[at[i]].tolist(), strict=True)
    return out


def anchor_pairs(texts: DataFrame, sample: int = HOT_SAMPLE) -> DataFrame:
    """Pairs (a, b), a > b, of texts that are close in bits. texts: rep, fa, fb. The sample decides the blocks' number only."""
    at = texts.select(F.explode(band_anchors(F.col("fa"), F.col("fb"))).alias("anchor"), "fa", "fb", "rep")
    counted = at.where(F.pmod(F.xxhash64("rep"), F.lit(sample)) == 0).groupBy("anchor").agg((F.count("*") * sample).alias("size"))
    hot = stage(counted.where(F.col("size") > BLOCK).select("anchor", F.ceil(F.col("size") / BLOCK).alias("salts")), "near-hot-anchors")
    salt = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("salts"))
    dealt = at.join(hot, "anchor", "left").select(F.col("anchor"), F.coalesce(salt, F.lit(0)).alias("salt"), "fa", "fb", "rep")
    first = at.join(hot, "anchor").groupBy("anchor").agg(F.min(F.struct("rep", "fa", "fb")).alias("f"), F.first("salts").alias("salts"))
    first = first.select("anchor", "f.*", F.col("salts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).where(F.col("salt") != salt)
    rows = dealt.unionByName(first.select("anchor", "salt", "fa", "fb", "rep")).select((F.col("anchor") + F.col("salt") * (1 << 33)).alias("key"), "fa", "fb", "rep")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_per_anchor(nearest_smaller), "a long, b long").distinct()


def _most_different(sizes: Column) -> Column:
    """How many shingles may be in one text of a similar pair only, if both have so many together."""
    return (1 - SIMILAR) / (1 + SIMILAR) * sizes + _EPS


def similar_pairs(pairs: DataFrame, prints: DataFrame, docs: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (a, b) whose texts' five-word shingles have a Jaccard similarity of at least SIMILAR. Only texts of pairs that parities allow are read, sent once a pair and made sets there.

    prints: rep, n, wide.
    """
    sides = F.explode(F.array("a", "b")).alias("rep")
    asked = prints.join(small(stage(pairs.select(sides).distinct(), "near-asked")), "rep", "left_semi")
    a, b = (asked.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("wide").alias(f"w{side}")) for side in "ab")
    bits = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    likely = stage(pairs.join(a, "a").join(b, "b").where(bits <= _most_different(F.col("na") + F.col("nb"))).select("a", "b"), "near-likely")
    wanted = stage(likely.select("a", "b", sides).join(texts, "rep").select("a", "b", "rep", "k1", "k2"), "near-wanted")
    sent = _texts(docs, id_col, text_col).withColumnRenamed("doc_id", "rep").join(small(wanted), "rep").select("a", "b", "rep", "k1", "k2", "text")
    return sent.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_compared, "a long, b long")


def _prefix(n: Column, share: float) -> Column:
    return n - F.ceil(F.lit(share) * n - F.lit(_EPS)) + 1


def prefix_pairs(prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of different groups that may be similar: none that is similar is left out.

    prints: rep, n, tokens and the parities, one row a text; groups: node, component of texts not alone in theirs.
    """
    held = prints.select("rep", "tokens").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    held = held.select("rep", F.coalesce("component", "rep").alias("component"), F.posexplode("tokens").alias("at", "token"))
    shared = stage(held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token"), "near-shared")
    held = stage(held.join(small(shared), "token"), "near-shared-prefixes")
    sizes = held.groupBy("token", "component").count()
    largest = sizes.groupBy("token").agg(F.max(F.struct("count", "component"))["component"].alias("largest"))
    split = held.join(largest, "token").withColumn("other", F.col("component") != F.col("largest")).drop("largest")
    held = stage(split.join(prints.select("rep", "n", *_PARITY), "rep"), "near-split-prefixes")
    x, y = (held.select("token", *(F.col(c).alias(f"{c}_{side}") for c in held.columns if c != "token")) for side in "xy")
    y = y.where(F.col("at_y") < _prefix(F.col("n_y"), 2 * SIMILAR / (1 + SIMILAR)))
    rest = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))  # the most they can share if this is their first common shingle
    after = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("rep_x") > F.col("rep_y")))
    both = F.col("n_x") + F.col("n_y")
    bits = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in _PARITY), F.lit(0))
    fits = after & (F.col("component_x") != F.col("component_y")) & (rest >= SIMILAR * (both - rest) - _EPS) & (bits <= _most_different(both))
    met = x.where("other_x").join(y, "token").where(fits).unionByName(x.where("NOT other_x").join(y.where("other_y"), "token").where(fits))
    return met.select(F.greatest("rep_x", "rep_y").alias("a"), F.least("rep_x", "rep_y").alias("b")).distinct()


def similar_groups(docs: DataFrame, prints: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, component) of what similar pairs connect. prints: staged rows of text_prints with a row number; texts: staged rows (rep, row, k1, k2), one a distinct text."""
    of_texts = prints.where("n > 0").join(texts.select("rep", "row"), "row")
    near = stage(anchor_pairs(of_texts.select("rep", "fa", "fb"), HOT_SAMPLE), "near-pairs")
    wide = of_texts.select("rep", "n", "wide")
    groups = stage(components(similar_pairs(near, wide, docs, texts, id_col, text_col)), "near-groups")
    far = stage(prefix_pairs(of_texts.select("rep", "n", "tokens", *_PARITY), groups).join(near, ["a", "b"], "left_anti"), "near-exact")
    more = similar_pairs(far, wide, docs, texts, id_col, text_col)
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, component_id) of texts that have a copy under a smaller id, which is their component's. Texts of equal words are copies; so are all without words.

    Rows with a null id are in no group. Of several texts under one id each is judged by itself; of those that have no copy of equal words under a smaller id, one is also compared
    with other documents' texts for similarity, and the others stay.
    """
    prints = stage(text_prints(docs, id_col, text_col, hot_shingles(docs, id_col, text_col, HOT_SAMPLE)).withColumn("row", F.monotonically_increasing_id()), "near-prints")
    keys = stage(prints.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("k1", "k2", F.col("m.doc_id").alias("rep"), "m.row"), "near-keys")
    texts = stage(keys.groupBy("rep").agg(F.min(F.struct("k1", "k2", "row")).alias("t")).select("rep", "t.*"), "near-texts")
    labels = similar_groups(docs, prints, texts, id_col, text_col).join(texts.select(F.col("rep").alias("node"), "k1", "k2"), "node")
    named = keys.join(labels, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "text_hash", "k1", "k2").join(named, ["k1", "k2"]).where("doc_id <> component_id").select("doc_id", "text_hash", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is a near copy of one with a smaller id."""
    doc, text_hash = fresh(docs.columns, "gone"), fresh(docs.columns, "hash")
    gone = stage(near_copies(docs, id_col, text_col).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).distinct(), "near-gone")
    return docs.join(gone, (F.col(id_col) == F.col(doc)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text_hash)), "left_anti")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
