"""Exact dedup, spelling variants and the prefix trie: against brute force, against their SQL, and in the corner cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import rows

from permulocus.llm import exact_dedup, prefix_trie, spelling

WS = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- exact dedup ---


def brute_dedup(docs):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(docs):
        text = text or ""
        groups["".join(c for c in text if c not in WS)].append((-len(text), doc is None, doc or 0, i))
    out = []
    for key, members in groups.items():
        best = min(members)
        out += [(docs[m[3]][0], docs[best[3]][0], len(members), m[3] == best[3], sha(key)) for m in members]
    return Counter(out)


def judged(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = exact_dedup.judged(exact_dedup.digests(df), **more)
    return Counter((r.doc, r.keep_doc, r.group_size, r.kept, bytes(r.digest).hex()) for r in out.collect())


def test_exact_dedup_brute_force(spark):
    random.seed(5)
    docs = [(random.choice([None, *range(300)]), "".join(random.choice("ab é\n　\t") for _ in range(random.randrange(7)))) for _ in range(250)]
    docs += [(900, None), (901, ""), (902, " \r\n"), (903, "x" * 300_000), (904, "x" * 299_999 + " x"), (7, "same"), (7, "same"), (7, "same")]
    docs += [(2000 + i, "hot copy") for i in range(300)]
    got, want = judged(spark, docs), brute_dedup(docs)
    # Which of several equal rows stays can't be told from its values.
    assert got == want


def test_exact_dedup_empty_and_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.judged(exact_dedup.digests(empty)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 1, 2, "x"), (2, "ab", 3, 4, "y"), (2, "ab", 3, 4, "y"), (None, None, 5, 6, "z"), (3, "c", 7, 8, None)], "doc_id long, text string, `row` int, digest int, `__row` string")
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == [1, 5, 7]


def test_digest_index_persists(spark, tmp_path):
    """A second opening of the folder goes on where the first stopped; a batch is added once; a longer copy that comes later takes over."""
    path, d = f"file://{tmp_path}/index", lambda docs: exact_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string"))
    first = exact_dedup.DigestIndex(spark, path, buckets=3)
    assert first.add(d([(1, "a b"), (2, "c")]), "monday")
    first.close()
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 3 and not again.add(d([(1, "a b"), (2, "c")]), "monday")
    assert again.add(d([(5, "a  b"), (6, "a b"), (7, "d")]), "tuesday")
    assert rows(again.state(), "keep_doc", "group_size") == [(2, 1), (5, 3), (7, 1)]
    name = again.segments[1][1]
    assert rows(spark.table(name), "seen", "n") == [(False, 1), (True, 2)]
    again.close()


# --- spelling variants ---


def brute_words(docs):
    import re

    low, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def edits(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def brute_variants(n):
    def is_near(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        return abs(len(x) - len(y)) == 1 and min(x, y, key=len) in edits(max(x, y, key=len))

    near = {x: [y for y in n if is_near(x, y)] for x in n}
    form = {}
    for x, ys in near.items():
        best = min(ys, key=lambda y: (-n[y], y), default=None)
        form[x] = best if best and n[best] >= 5 * n[x] else None

    def root(x):
        while form[x]:
            x = form[x]
        return x

    return sorted((x, form[x], root(x), n[x], len(near[x]), n[form[x]] if form[x] else None) for x in n)


def key(r):
    return tuple((x is not None, x) if x is not None else (False, "") for x in r)


def of(spark, n, **more):
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    out = spelling.variants(vocabulary, **more).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r) for r in out.collect())


def by_word(out):
    return {r[0]: r for r in out}


@pytest.mark.parametrize(("letters", "cell"), [("ab", 4096), ("abcé", 4096), ("ab", 16)])
def test_spelling_brute_force(spark, letters, cell):
    random.seed(len(letters) + cell)
    pool = {"".join(random.choice(letters) for _ in range(random.choice([6, 6, 7, 8, 8, 9, 10, 11]))) for _ in range(260)}
    for w in random.sample(sorted(pool), 60):
        i = random.randrange(len(w))
        pool |= {w[:i] + random.choice(letters) + w[i:], w[:i] + random.choice(letters) + w[i + 1 :]}
    n = {w: random.choice([5, 6, 25, 30, 150, 800, 800]) for w in pool}
    assert by_word(of(spark, n, cell=cell)) == by_word(brute_variants(n))


def test_spelling_chain_and_ties(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "zzzzzz": 9, "zzzzzy": 45, "zzzzzx": 45, "aaaaaaaaaaaa": 5, "aaaaaaaaaaaaa": 5}
    got = by_word(of(spark, n))
    assert got == by_word(brute_variants(n))
    assert got["abcdef"][2] == "abjihg" and got["zzzzzz"][1] == "zzzzzx" and got["aaaaaaaaaaaa"][4] == 1


def test_spelling_words(spark):
    random.seed(3)
    pool = ["Étion-abcdef", "STRASSE", "straße", "GROSSES×x", "abcdefgh", "q" * 5000, "don't", "naïvement"]
    docs = [(i, " ".join(random.choice(pool) for _ in range(40))) for i in range(120)] + [(3, "again abcdefgh"), (3, "again abcdefgh"), (7, None), (8, ""), (None, "abcdefgh nullid " * 6)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, word int, run string")
    assert dict(rows(spelling.words(df))) == brute_words(docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.words(empty)).count() == 0


def test_spelling_pair_is_given_once(spark):
    n = {"aaaaaa": 5, "aaaaaaa": 5, "aaabaa": 5, "aabaaa": 5}
    got = Counter((r.word, r.near) for r in spelling.near(spark.createDataFrame(list(n.items()), "word string, n long")).collect())
    assert set(got.values()) == {1} and got["aaaaaa", "aaaaaaa"] == got["aaaaaaa", "aaaaaa"] == 1


# --- prefix trie ---


def brute_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(path))))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids), leaves, saved, sha(ends)))
    return sorted(out, key=lambda r: r[:2])


def trie(spark, turns):
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, depth int, conv string").repartition(3)
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=lambda r: r[:2])


def test_trie_brute_force(spark):
    random.seed(11)
    turns = []
    for c in [*range(60), -1, -3, -7, 4096, 10**12]:
        for i in range(random.choice([1, 1, 2, 5, 9, 12])):
            turns.append((c, random.choice([None, i]) if i == 0 else i, random.choice(["user", "assistant", None]), random.choice(["a", "b", "é" * 40, "", None])))
    turns += [(None, 0, "user", "a"), (None, 1, "user", "b")]
    turns += [(70 + i, d, "user", "hello") for i in range(40) for d in range(3)]  # very many copies
    assert trie(spark, turns) == brute_trie(turns)


def test_trie_repeated_rows_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "END_BLOCK", 5)
    turns = [(3, i, "user", f"t{i % 5}") for i in range(200)] + [(8, i, "user", f"t{i % 5}") for i in range(200)] + [(5, 1, "user", "x")] * 30 + [(9, 2, "a", "y" * 100_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    members, built = prefix_trie.rebuilt(prefix_trie.stage(prefix_trie.numbered(df), "numbered"))
    got = sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.paths(members, built, block=7)).collect()), key=lambda r: r[:2])
    assert got == brute_trie(turns)


def test_trie_turnless_and_empty(spark):
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    assert trie(spark, [(c, 0, "user", "only")]) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- near copies, by text ---


def test_keep_one_judges_texts_not_ids(spark):
    from permulocus.llm import simhash

    rng = random.Random(9)
    a, b, c, d, e = (" ".join(rng.choice("lorem ipsum dolor sit amet vita nova terra aqua ignis ventus luna sol stella mare".split()) + str(rng.randrange(400)) for _ in range(80)) for _ in range(5))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, d), (9, c), (9, c), (7, None), (8, ""), (None, a), (11, e + " one more"), (10, e)], "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == Counter([(1, a), (5, b), (5, d), (9, c), (9, c), (7, None), (None, a), (10, e)])
