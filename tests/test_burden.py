"""Worked examples of each operator, properties, and queries against their SQL."""

import random
from decimal import Decimal

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from permulocus.functions import genome as g
from permulocus.functions import kmers
from permulocus.operators import cluster, epoch, intervals, overlap, permute
from permulocus.plans import algorithms as alg
from permulocus.plans import queries as q
from permulocus.sources import readers, sinks

SF = "/root/testdata/sf0.001"
IV = "chrom string, start long, end long"
VS = [("chr1", 98, 99), ("chr1", 99, 100), ("chr1", 199, 200), ("chr1", 200, 201)]


def iv(spark, data, extra=""):
    return spark.createDataFrame(data, IV + extra)


def test_merge_closed(spark):
    got = intervals.merge(iv(spark, [("chr1", 10, 20), ("chr1", 20, 30), ("chr1", 31, 40), ("chr2", 10, 12)]), bucket=16)
    assert rows(got, "chrom", "start", "end") == [("chr1", 10, 30), ("chr1", 31, 40), ("chr2", 10, 12)]


def test_merge_over_many_buckets(spark):
    got = intervals.merge(iv(spark, [("chr1", 0, 1000), ("chr1", 500, 510), ("chr1", 990, 1200), ("chr1", 1300, 1301)]), bucket=8)
    assert rows(got, "start", "end") == [(0, 1200), (1300, 1301)]


def test_blacklist_touch_counts(spark):
    got = overlap.without_blacklisted(iv(spark, [("chr1", 200, 250), ("chr1", 201, 250), ("chr1", 201, 250)]), iv(spark, [("chr1", 100, 200)]))
    assert rows(got, "start") == [(201,), (201,)]


@pytest.mark.parametrize(("predicate", "n"), [("count", 2), ("point", 1), ("up", 2), ("down", 2), ("closed", 3)])
@pytest.mark.parametrize("bucket", [4, 1 << 14])
def test_predicates(spark, predicate, n, bucket):
    got = overlap.overlap_sums(iv(spark, [("chr1", 100, 200)]), iv(spark, VS), predicate, bucket=bucket)
    assert [r.n for r in got.collect()] == [n]
    assert overlap.overlap_pairs(iv(spark, [("chr1", 100, 200)]), iv(spark, VS), predicate, bucket).count() == n


def test_no_variants_and_long_variants(spark):
    a = iv(spark, [("chr1", 100, 200), ("chr2", 1, 5)])
    assert rows(overlap.overlap_sums(a, iv(spark, []), "count"), "n") == [(0,), (0,)]
    assert rows(overlap.overlap_sums(a, iv(spark, [("chr1", 0, 1000), ("chr1", 150, 5000)]), "count", bucket=8), "chrom", "n") == [("chr1", 2), ("chr2", 0)]


def test_tiles(spark):
    one = lambda n: rows(intervals.tile(g.genome(spark, {"chrM": n}), 5000), "start", "end")
    assert one(16571) == [(1, 5001), (5001, 10001), (10001, 15001), (15001, 16571)]
    assert one(15001) == [(1, 5001), (5001, 10001), (10001, 15001)]


@pytest.mark.parametrize(("bin_", "black", "left"), [((1, 5001), [(1, 100), (2000, 2100)], [(100, 2000), (2100, 5001)]), ((5001, 10001), [(4000, 12000)], []), ((5001, 10001), [(4000, 5001)], [(5001, 10001)])])
def test_subtract(spark, bin_, black, left):
    bins = spark.createDataFrame([("chr1", 1, *bin_)], "chrom string, ord int, start long, end long")
    assert rows(intervals.subtract(bins, iv(spark, [("chr1", *b) for b in black])), "start", "end") == left


@pytest.mark.parametrize(("bins", "least", "left"), [([(1, 5001), (5001, 5101), (5200, 5210), (5210, 10001)], 500, [(1, 5101), (5200, 10001)]), ([(1, 5001), (6000, 6010), (7000, 9000)], 500, [(1, 5001), (7000, 9000)]), ([(100, 110), (110, 120), (200, 900)], 50, [(200, 900)])])
def test_absorb(spark, bins, least, left):
    df = spark.createDataFrame([("chr1", 1, *b) for b in bins], "chrom string, ord int, start long, end long")
    assert rows(intervals.absorb(df, least), "start", "end") == left


def test_random_bins(spark):
    a = spark.createDataFrame([(1, "chr1", 10000, 10100)], "aid long, " + IV)
    got = permute.random_bins(a, 200, 1000, 5000).collect()
    up, down = [r for r in got if r.side == "up"], [r for r in got if r.side == "down"]
    assert len(up) == len(down) == 100 and all(r.end - r.start == 100 for r in got)
    assert all(5050 <= r.start <= 8948 for r in up) and all(11050 <= r.start <= 14948 for r in down)
    assert permute.random_bins(a, 2, 0, 101).count() == 0  # no room
    for bad in ((3, 0, 10), (0, 0, 10), (2, 10, 10)):
        with pytest.raises(ValueError):
            permute.random_bins(a, *bad)


def test_kmers(spark):
    seq = spark.createDataFrame([("chr1", 1, "ACGTAC"), ("chr1", 7, "gtac")], "chrom string, chunk_start long, bases string")
    k = {r.pos: r.kmer for r in kmers.positions(seq, 3).collect()}
    assert k[5] == "TAC" and k[6] == "ACG" and k[7] == "CGT" and set(k) == set(range(2, 10))
    with pytest.raises(Exception, match="not a base"):
        kmers.positions(spark.createDataFrame([("chr1", 1, "AXC")], seq.schema), 3).collect()


def test_context_candidates_and_own_site(spark):
    seq = spark.createDataFrame([("chr1", 1, "ACGTACGTAC")], "chrom string, chunk_start long, bases string")
    bins = spark.createDataFrame([("g", "chr1", 1, 10)], "grp string, " + IV)
    sites = permute.candidates(kmers.positions(seq, 3), bins)
    assert rows(sites.where("kmer = 'TAC'"), "pos", "c") == [(5, 2), (9, 2)] or rows(sites.where("kmer = 'TAC'"), "pos") == [(5,)]
    v = spark.createDataFrame([(1, "chr1", 3, "g", "CGT"), (2, "chr1", 6, "g", "ACG")], "vid long, chrom string, end long, grp string, kmer string")
    moved = permute.draw_sites(v, sites, 20, "t").collect()
    assert {(r.vid, r.end) for r in moved} == {(1, 7), (2, 2)}


def test_epochs(spark):
    laid = epoch.lay_out(spark.createDataFrame([(0, "chr1", 1, 100001, 150001), (0, "chr1", 1, 150001, 250001)], "cluster int, chrom string, ord int, start long, end long"))
    v = spark.createDataFrame([(1, "chr1", 150000, 150001), (2, "chr1", 150001, 150002)], "vid long, " + IV)
    there = epoch.forward(v, laid)
    assert rows(there, "vid", "epoch") == [(1, 50000), (2, 50001)]
    assert rows(epoch.inverse(there.select("vid", "cluster", "epoch"), laid), "vid", "start", "end") == [(1, 150000, 150001), (2, 150001, 150002)]


def test_zscores_and_kmeans(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 10.0), (3, 10.0)], "rid long, f double")
    z = cluster.zscores(df, ["f"])
    assert rows(z, "f") == [(-1.0,), (-1.0,), (1.0,), (1.0,)]
    members, cents = cluster.kmeans(z, ["f"], 2, 10)
    assert rows(members, "rid", "cluster") == [(0, 0), (1, 0), (2, 1), (3, 1)] and rows(cents) == [(0, -1.0), (1, 1.0)]
    few, _ = cluster.kmeans(z, ["f"], 100, 10)
    assert {r.cluster for r in few.collect()} == {0}
    assert rows(cluster.zscores(df.withColumn("f", F.lit(3.0)), ["f"]), "f") == [(0.0,)] * 4


def test_interval_means(spark):
    signal = spark.createDataFrame([("chr1", 0, 10, 1), ("chr1", 10, 20, 3)], IV + ", value int").withColumn("value", F.col("value").cast("decimal(18,2)"))
    r = spark.createDataFrame([(1, "chr1", 5, 15), (2, "chr1", 15, 25), (3, "chr1", 30, 40)], "id long, " + IV)
    assert rows(overlap.interval_means(r, signal), "id", "mean") == [(1, 2.0), (2, 3.0), (3, 0.0)]


def test_chromosomes(spark):
    df = spark.createDataFrame([(c,) for c in ("chrX", "chr10", "chr2", "chrMT", "chrY", "chrUn", "chr1_random", "c", None)], "chrom string")
    kept = df.where(g.is_standard(F.col("chrom"))).orderBy(g.order_of(F.col("chrom")))
    assert [r[0] for r in kept.select(g.canonical(F.col("chrom"))).collect()] == ["chr2", "chr10", "chrX", "chrY", "chrM"]


def test_pvalues(spark):
    v = spark.createDataFrame([(i, "chr1", 150 + i, 151 + i) for i in range(3)], "vid long, " + IV)
    a = spark.createDataFrame([(1, "chr1", 100, 200, "x"), (2, "chr1", 5000, 5100, "y")], "aid long, " + IV + ", name string")
    p = {r.aid: (r.n_obs, r.p) for r in alg.permute_annotations(v, a, iv(spark, []), 10, 1000, 5000).collect()}
    assert p[1] == (3, 0.0) and p[2][0] == 0 and p[2][1] == 1.0
    moved = spark.createDataFrame([(1, "chr1", 150, 151), (1, "chr1", 151, 152), (1, "chr1", 152, 153), (2, "chr1", 900, 901)], "perm int, " + IV)
    assert {r.aid: r.p for r in alg.empirical_pvalues(v, a, iv(spark, []), moved).collect()} == {1: 0.5, 2: 1.0}
    with pytest.raises(ValueError):
        alg.empirical_pvalues(v, a, iv(spark, []), moved.limit(0))
    with pytest.raises(ValueError):
        alg.permute_annotations(v, a, iv(spark, []), 10, 1000, 5000, "p")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "v.bed").write_text("chr1\t5\t6\tA\tT\nchr1_random\t1\t2\tA\tT\nchrMT\t7\t8\tC\n")
    v = readers.variants(spark, str(tmp_path / "v.bed"))
    assert [(r.chrom, r.start, r.end, r.extras) for r in v.orderBy("start").collect()] == [("chr1", 5, 6, ["A", "T"]), ("chrM", 7, 8, ["C"])]
    (tmp_path / "a.bed").write_text("chr2\t5\t60\tgene\trest\n")
    a = readers.annotations(spark, str(tmp_path / "a.bed"))
    assert rows(a, "chrom", "start", "end", "name") == [("chr2", 5, 60, "gene")]
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa" / "chr1.fa").write_text(">chr1 x\nACGT\nacgt\nAC\n")
    seq = readers.fasta(spark, str(tmp_path / "fa"), chunk=4)
    assert rows(seq, "chrom", "chunk_start", "bases") == [("chr1", 1, "ACGT"), ("chr1", 5, "acgt"), ("chr1", 9, "AC")]
    moved = spark.createDataFrame([(1, 1, "chr1", 5, 6, 0.5, "T"), (2, 1, "chr2", 1, 2, 1.5, "A")], "perm int, vid long, " + IV + ", score double, alt string")
    sinks.write_permuted(moved, str(tmp_path / "perms"))
    back = readers.permutations(spark, str(tmp_path / "perms"), scored=True)
    assert rows(back, "perm", "chrom", "start", "end", "score") == [(1, "chr1", 5, 6, 0.5), (2, "chr2", 1, 2, 1.5)]
    (tmp_path / "empty.bed").write_text("")
    for missing in ("empty.bed", "none.bed"):
        with pytest.raises(ValueError):
            readers.variants(spark, str(tmp_path / missing))


def test_fasta_over_many_blocks(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for chrom in ("chr1", "chrMT"):
        want[chrom.replace("MT", "M")] = bases = "".join(rng.choice("ACGTN") for _ in range(3000))
        (tmp_path / f"{chrom}.fa").write_text(f">{chrom}\n" + "".join(bases[i : i + 60] + "\n" for i in range(0, len(bases), 60)))
    (tmp_path / "chr1_random.fa").write_text(">x\nACGT\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        seq = sorted((r.chrom, r.chunk_start, r.bases) for r in readers.fasta(spark, str(tmp_path), chunk=500).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for chrom, bases in want.items():
        parts = [(at, b) for c, at, b in seq if c == chrom]
        assert "".join(b for _, b in parts) == bases and len(parts) > 4
        assert all(bases[at - 1 : at - 1 + len(b)] == b for at, b in parts)
    assert {c for c, _, _ in seq} == set(want)
    for missing in ("none", "empty"):
        (tmp_path / "empty").mkdir(exist_ok=True)
        with pytest.raises(ValueError):
            readers.fasta(spark, str(tmp_path / missing))
        with pytest.raises(ValueError):
            readers.permutations(spark, str(tmp_path / missing))


def test_kmers_over_pieces(spark):
    rng = random.Random(5)
    bases = "".join(rng.choice("ACGTNacgt") for _ in range(1500))
    chunks = [(at, bases[at : at + 600]) for at in range(0, 1500, 600)]
    seq = spark.createDataFrame([("chr1", at + 1, b) for at, b in chunks], "chrom string, chunk_start long, bases string")
    for k in (1, 3, 5):
        want = [(p, bases[p - 1 - k // 2 : p + k // 2].upper()) for p in range(1 + k // 2, 1501 - k // 2)]
        assert rows(kmers.positions(seq, k), "pos", "kmer") == want
        near = kmers.positions(seq, k, spark.createDataFrame([("chr1", 300, 310)], IV)).where("pos BETWEEN 301 AND 310")
        assert rows(near, "pos", "kmer") == [w for w in want if 301 <= w[0] <= 310]


@pytest.mark.parametrize("bucket", [None, 1, 7, 1000])
def test_overlaps_brute_force(spark, bucket):
    """Ties, repeated rows, nulls, negative positions, clashing names, decimals; and all predicates."""
    rng = random.Random(6)
    iv_of = lambda n, far: [(rng.choice(["chr1", "chr2"]), s := rng.randrange(-20, far), s + rng.randrange(0, 40)) for _ in range(n)]
    r = iv_of(60, 300) * 2 + [("chr3", 1, 5), (None, 1, 5), ("chr1", None, 5), ("chr1", 5, None), ("chr1", 10**9, 10**9 + 5)]
    v = iv_of(80, 250) * 2 + [("chr1", 40, 41)] * 30 + [(None, 1, 5), ("chr1", None, 7)]
    reg = spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "__o long, " + IV)
    var = spark.createDataFrame([(*x, Decimal(i) / 4 if i % 3 else None) for i, x in enumerate(v)], IV + ", __w decimal(18,2)")
    holds = {
        "count": lambda s, e, a, b: s < b and e >= a, "point": lambda s, e, a, b: a < e <= b, "up": lambda s, e, a, b: a <= s <= b,
        "down": lambda s, e, a, b: a <= e <= b, "closed": lambda s, e, a, b: s <= b and e >= a,
    }
    for pred, f in holds.items():
        got = {x[0]: (x.n, x["sum___w"]) for x in overlap.overlap_sums(reg, var, pred, ["__w"], bucket=bucket).collect()}
        want = {}
        for i, (c, a, b) in enumerate(r):
            if None in (c, a, b):
                continue
            hit = [j for j, x in enumerate(v) if None not in x and x[0] == c and f(x[1], x[2], a, b)]
            want[i] = (len(hit), sum((Decimal(j) / 4 for j in hit if j % 3), Decimal(0)))
        assert got == want, pred
    assert overlap.overlap_sums(reg, var.limit(0)).where("n = 0").count() == len(r) - 3
    track = spark.createDataFrame([(*x, Decimal(i)) for i, x in enumerate(v) if None not in x], IV + ", value decimal(18,2)")
    means = {x[0]: x["mean"] for x in overlap.interval_means(reg, track, bucket).collect()}
    for i, (c, a, b) in enumerate(r):
        parts = [(min(b, x[2]) - max(a, x[1]), j) for j, x in enumerate(v) if None not in (*x, c, a, b) and x[0] == c and min(b, x[2]) > max(a, x[1])]
        assert means[i] == pytest.approx(sum(w * j for w, j in parts) / sum(w for w, _ in parts) if parts else 0), i
    named = reg.withColumnsRenamed({"__o": "N"})
    assert rows(overlap.without_blacklisted(named, var), "N") == [(i,) for i, x in enumerate(r) if None not in x and not any(None not in y and y[0] == x[0] and holds["closed"](y[1], y[2], x[1], x[2]) for y in v)]


def test_absorb_brute_force(spark):
    rng = random.Random(8)
    bins, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 0, 0, 3])
        end = at + rng.choice([1, 2, 5, 9, 30])
        bins.append([at, end])
        at = end
    left, gone = [list(b) for b in bins], [False] * len(bins)
    for i, (s, e) in enumerate(left):
        s, e = left[i]
        if e - s >= 8:
            continue
        if i and not gone[i - 1] and left[i - 1][1] == s:
            left[i - 1][1] = e
        elif i + 1 < len(left) and left[i + 1][0] == e:
            left[i + 1][0] = s
        gone[i] = True
    want = [tuple(b) for b, g_ in zip(left, gone, strict=True) if not g_]
    df = spark.createDataFrame([("chr1", 1, *b) for b in bins], "chrom string, ord int, start long, end long")
    assert rows(intervals.absorb(df, 8), "start", "end") == want
    assert intervals.absorb(df.limit(0), 8).count() == 0


@pytest.mark.parametrize("preserve", [True, False])
def test_simulation_keeps_its_rules(spark, preserve):
    """New sites lie in bins of the old site's cluster, have its context where kept, and all other columns stay."""
    from permulocus.sources import testdata as t

    rng = random.Random(9)
    genome = t.genome(spark, 2000)
    seq = {c: "".join(rng.choice("ACGT") for _ in range(2000)) for c in t.CONTIGS}
    seq_df = spark.createDataFrame([(c, 1, b) for c, b in seq.items()], "chrom string, chunk_start long, bases string")
    v = spark.createDataFrame([(i, rng.choice(t.CONTIGS), p := rng.randrange(2, 1990), p + 1, f"x{i}") for i in range(60)], "vid long, " + IV + ", alt string")
    black = spark.createDataFrame([(c, 500, 700) for c in t.CONTIGS], IV)
    cov = spark.createDataFrame([(c, s, s + 100, Decimal(rng.randrange(4))) for c in t.CONTIGS for s in range(0, 2000, 100)], IV + ", value decimal(18,2)")
    args = (100, 20, preserve, 3, 3)
    got = alg.simulate_variants(v, black, genome, seq_df, [cov], 3, *args, seed=1).collect()
    bins = alg.covariate_features(alg.clean_bins(genome, black, 100, 20), [cov])
    members, _ = cluster.kmeans(cluster.zscores(bins, ["f0"]), ["f0"], 3, 3)
    where = [(m.chrom, m.start, m.end, m.cluster) for m in members.collect()]
    of = lambda c, e: next((k for ch, s, en, k in where if ch == c and s < e <= en), None)
    old = {r.vid: r for r in v.collect()}
    assert got and len({(r.vid, r.perm) for r in got}) == len(got)
    assert {r.vid for r in got} <= {i for i, r in old.items() if of(r.chrom, r.end) is not None}
    kmer = lambda c, e: seq[c][e - 2 : e + 1]
    for r in got:
        o = old[r.vid]
        assert r.alt == o.alt and r.end == r.start + 1 and of(r.chrom, r.end) == of(o.chrom, o.end)
        if preserve:
            assert kmer(r.chrom, r.end) == kmer(o.chrom, o.end) and (r.chrom, r.end) != (o.chrom, o.end)
    assert preserve or len(got) == 3 * sum(of(r.chrom, r.end) is not None for r in old.values())


def test_command_line(spark, tmp_path):
    from permulocus import cli

    rng = random.Random(10)
    bases = "".join(rng.choice("ACGT") for _ in range(4000))
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa" / "chr21.fa").write_text(">chr21\n" + "\n".join(bases[i : i + 50] for i in range(0, 4000, 50)) + "\n")
    put = lambda name, lines: (tmp_path / name).write_text("".join("\t".join(map(str, x)) + "\n" for x in lines))
    put("v.bed", [("chr21", p, p + 1, "A", f"alt{p}") for p in range(100, 3900, 90)])
    put("a.bed", [("chr21", 200, 400, "one"), ("chr21", 3000, 3100, "two"), ("chrUn", 1, 2, "no")])
    put("b.bed", [("chr21", 3050, 3060)])
    put("s.bg", [("chr21", s, s + 100, s / 100) for s in range(0, 4000, 100)])
    at = lambda name: str(tmp_path / name)
    run = lambda what, out, *more: cli.main([what, "--variants", at("v.bed"), "--blacklist", at("b.bed"), "--out", at(out), *more], spark)
    lines = lambda out: [x.split("\t") for f in sorted((tmp_path / out).rglob("part-*")) for x in f.read_text().splitlines()]
    run("annotations", "p1", "--annotations", at("a.bed"), "-n", "4", "--dmin", "10", "--dmax", "900", "--signal", at("s.bg"), "--mode", "p")
    assert [x[:4] for x in lines("p1")] == [["chr21", "200", "400", "one"]] and len(lines("p1")[0]) == 7
    shape = ("--fasta", at("fa"), "--width", "1000", "--min-width", "50", "-n", "2")
    run("variants", "moved", *shape, "--signal", at("s.bg"))
    moved = lines("moved")
    assert len(moved) > 40 and all(len(x) == 6 and x[5].startswith("alt") for x in moved)
    assert sorted(x.name for x in (tmp_path / "moved").iterdir() if x.is_dir()) == ["perm=1", "perm=2"]
    run("pvalues", "p2", "--annotations", at("a.bed"), "--permutations", at("moved"), "--signal", at("s.bg"), "--mode", "p")
    assert [x[3] for x in lines("p2")] == ["one"]
    run("simulate", "sim", *shape, "--covariate", at("s.bg"), "--clusters", "2", "--context", "n")
    assert {len(x) for x in lines("sim")} == {5} and len(lines("sim")) > 40
    with pytest.raises(ValueError):
        cli.main(["pvalues", "--variants", at("none"), "--blacklist", at("b.bed"), "--out", at("x"), "--annotations", at("a.bed"), "--permutations", at("moved")], spark)


FAST = ["std_chrom_filter", "merge_intervals", "clip_intersections", "observed_burden", "perm_annotation_signal_pvalue", "output_format", "subtract_blacklist", "assign_variant_bins", "permute_trimer", "empirical_signal_pvalue", "kmeans_members", "epoch_inverse", "simulate_trimer"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "part", "orders", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(q.ORACLES[name])
    cols = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in cols]
    norm = lambda r: tuple(round(float(x), 6) if isinstance(x, float) or str(type(x).__name__) == "Decimal" else x for x in r)
    expected = sorted(norm([r[i] for i in order]) for r in want.fetchall())
    got = sorted(norm(r) for r in q.QUERIES[name](spark, SF).select(*cols).collect())
    assert got == expected


@pytest.mark.parametrize("name", ["permute_uniform_all", "permute_pentamer_all", "empirical_signal_pvalue_all"])
def test_whole_input_equals_sql(spark, name):
    sql = q.ORACLES[name]
    assert "aid % 10" not in sql and "WHERE s % 5" not in sql
    con = duckdb.connect()
    for t in ("events", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    expected = sorted(map(norm, want.fetchall()))
    got = sorted(map(norm, q.QUERIES[name](spark, SF).select(*names).collect()))
    assert got == expected
    if name.startswith("empirical"):
        assert {r[names.index("aid")] % 10 < 5 for r in got} == {True, False}


def test_rank_check_without_annotations_equals_sql(spark, tmp_path):
    """A blacklist that leaves no annotation: all counts are 0."""
    con = duckdb.connect()
    small = SF.rsplit("/", 1)[0] + "/sf0.001"
    for t in ("events", "orders"):
        con.execute(f"COPY (SELECT * FROM '{small}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    con.execute(f"COPY (SELECT i AS s_suppkey FROM range(100000) x(i)) TO '{tmp_path}/supplier.parquet'")
    for t in ("events", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for t in ("part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(q.ORACLES["rank_diff_vs_bucket_check"])
    names = [c[0] for c in want.description]
    got = [tuple(r) for r in q.QUERIES["rank_diff_vs_bucket_check"](spark, str(tmp_path)).select(*names).collect()]
    assert got == want.fetchall() == [(0,) * len(names)]
