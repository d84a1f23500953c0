"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import genome as g
from ..functions import kmers
from ..functions.staging import shared_path, written
from ..operators import cluster, epoch, intervals, overlap, permute, sites
from ..sources import bigwig, readers, sinks
from ..sources import testdata as t
from . import algorithms as alg
from .ledger import ExceedanceLedger

N, DMIN, DMAX, SEED = 10, 1000, 50_000, 7
WIDTH, MIN_WIDTH, SHORT_WIDTH, SHORT_MIN = 5000, 500, 1000, 100
CLUSTERS, ITERATIONS = 5, 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL of the inputs ---


def _contig(n: str) -> str:
    return f"['chr1','chr2','chr3','chrX','chrY'][1 + CAST({n} % 5 AS INTEGER)]"


def _u(*keys: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")), 1, 13) AS BIGINT)"


INPUTS = f"""
V AS (SELECT event_id AS vid, CASE event_type WHEN 'click' THEN 'chr1' WHEN 'error' THEN 'chr2' WHEN 'purchase' THEN 'chr3' WHEN 'signup' THEN 'chrX' ELSE 'chrY' END AS chrom,
  datediff('second', TIMESTAMP '2024-01-01', ts) AS s, datediff('second', TIMESTAMP '2024-01-01', ts) + 1 AS e, CAST(value AS DECIMAL(18,2)) AS signal FROM events),
A AS (SELECT o_orderkey AS aid, {_contig('o_custkey')} AS chrom, (o_orderkey * 1733) % 2592000 AS s, (o_orderkey * 1733) % 2592000 + 200 + o_orderkey % 1800 AS e, 'ord' || o_orderkey AS name FROM orders),
B AS (SELECT {_contig('s_suppkey')} AS chrom, (s_suppkey * 104729) % 2592000 AS s, (s_suppkey * 104729) % 2592000 + 500 + s_suppkey % 700 AS e FROM supplier),
S1 AS (SELECT {_contig('p_partkey')} AS chrom, (p_partkey * 7919) % 2592000 AS s, (p_partkey * 7919) % 2592000 + 400 + 20 * p_size AS e, CAST(p_retailprice AS DECIMAL(18,2)) AS value FROM part),
S2 AS (SELECT {_contig('c_custkey')} AS chrom, (c_custkey * 6007) % 2592000 AS s, (c_custkey * 6007) % 2592000 + 900 AS e, CAST(c_acctbal AS DECIMAL(18,2)) AS value FROM customer),
"""


def _merged(name: str, src: str) -> str:
    return f"""{name} AS (SELECT chrom, min(s) AS s, max(e) AS e FROM (SELECT *, sum(brk) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS brk FROM {src})) GROUP BY chrom, isl),
"""


def _anti(name: str, src: str) -> str:
    return f"{name} AS (SELECT x.* FROM {src} x WHERE NOT EXISTS (SELECT 1 FROM BM b WHERE b.chrom = x.chrom AND x.s <= b.e AND x.e >= b.s)),\n"


CLEAN = INPUTS + _merged("BM", "B") + _anti("VF", "V") + _anti("AF", "A")
ON = {
    "count": "v.s < a.e AND v.e >= a.s", "point": "a.s < v.e AND v.e <= a.e", "up": "a.s <= v.s AND v.s <= a.e",
    "down": "a.s <= v.e AND v.e <= a.e", "closed": "v.s <= a.e AND v.e >= a.s",
}


def _with(ctes: str, body: str) -> str:
    return "WITH " + ctes.rstrip().rstrip(",") + "\n" + body


def _per_annotation(pred: str, agg: str, name: str) -> str:
    return f"SELECT a.aid, a.name, {agg} AS {name} FROM AF a LEFT JOIN VF v ON v.chrom = a.chrom AND {ON[pred]} GROUP BY a.aid, a.name"


# --- filters, order, intervals ---


def _odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("vid") % 7 == 0, F.concat("chrom", F.lit("_random"))).when(F.col("vid") % 7 == 1, "chrMT").when(F.col("vid") % 7 == 2, "chrUn").otherwise(F.col("chrom"))
    return t.variants(spark, sf_dir).select("vid", odd.alias("chrom"))


@query(_with(INPUTS, "SELECT vid, CASE WHEN vid % 7 = 1 THEN 'chrM' ELSE chrom END AS chrom FROM V WHERE vid % 7 NOT IN (0, 2)"))
def std_chrom_filter(spark, sf_dir):
    return _odd_names(spark, sf_dir).where(g.is_standard(F.col("chrom"))).withColumn("chrom", g.canonical(F.col("chrom")))


@query(_with(INPUTS, "SELECT CASE chrom WHEN 'chrX' THEN 23 WHEN 'chrY' THEN 24 ELSE CAST(substr(chrom, 4) AS INTEGER) END AS ord, s AS \"start\", e AS \"end\", name FROM A"))
def chrom_order_sort(spark, sf_dir):
    return t.annotations(spark, sf_dir).select(g.order_of(F.col("chrom")).alias("ord"), "start", "end", "name").orderBy("ord", "start", "end", "name")


@query(_with(INPUTS + _merged("M", "A"), 'SELECT chrom, s AS "start", e AS "end" FROM M'))
def merge_intervals(spark, sf_dir):
    return intervals.merge(t.annotations(spark, sf_dir)).select("chrom", "start", "end")


@query(_with(CLEAN, "SELECT a.aid, greatest(a.s, b.s) AS clip_start, least(a.e, b.e) AS clip_end FROM A a JOIN BM b ON a.chrom = b.chrom AND a.s <= b.e AND a.e >= b.s"))
def clip_intersections(spark, sf_dir):
    return intervals.clip(t.annotations(spark, sf_dir), written(intervals.merge(t.blacklist(spark, sf_dir)), "blacklist")).select("aid", "clip_start", "clip_end")


def _clean(spark, sf_dir):
    return alg.prepare(t.variants(spark, sf_dir), t.annotations(spark, sf_dir), t.blacklist(spark, sf_dir))


@query(_with(CLEAN, "SELECT vid FROM VF"))
def blacklist_anti_variants(spark, sf_dir):
    return _clean(spark, sf_dir)[0].select("vid")


@query(_with(CLEAN, "SELECT aid FROM AF"))
def blacklist_anti_annotations(spark, sf_dir):
    return _clean(spark, sf_dir)[1].select("aid")


# --- overlaps ---


def _counted(spark, sf_dir, predicate):
    v, a, _ = _clean(spark, sf_dir)
    return overlap.overlap_sums(a, v, predicate).select("aid", "name", "n")


@query(_with(CLEAN, _per_annotation("count", "count(v.vid)", "n_obs")))
def observed_burden(spark, sf_dir):
    return _counted(spark, sf_dir, "count").withColumnRenamed("n", "n_obs")


@query(_with(CLEAN, _per_annotation("closed", "count(v.vid)", "n")))
def overlap_closed(spark, sf_dir):
    return _counted(spark, sf_dir, "closed")


@query(_with(CLEAN, _per_annotation("point", "count(v.vid)", "n")))
def overlap_point(spark, sf_dir):
    return _counted(spark, sf_dir, "point")


@query(_with(CLEAN, _per_annotation("point", "CAST(coalesce(sum(v.signal), 0) AS DOUBLE)", "signal_obs")))
def signal_sum_observed(spark, sf_dir):
    v, a, _ = _clean(spark, sf_dir)
    return overlap.overlap_sums(a, v, "point", ["signal"]).select("aid", "name", F.col("sum_signal").cast("double").alias("signal_obs"))


def _mean(region: str, track: str, key: str) -> str:
    return f"""SELECT a.{key}, round(coalesce(CAST(sum(v.value * (least(a.e, v.e) - greatest(a.s, v.s))) AS DOUBLE) / sum(least(a.e, v.e) - greatest(a.s, v.s)), 0), 9) AS mean
FROM {region} a LEFT JOIN {track} v ON v.chrom = a.chrom AND v.s < a.e AND v.e > a.s GROUP BY a.{key}"""


@query(_with(INPUTS, _mean("A", "S1", "aid")))
def signal_mean_over_interval(spark, sf_dir):
    return overlap.interval_means(t.annotations(spark, sf_dir), t.signal(spark, sf_dir)).select("aid", F.round("mean", 9).alias("mean"))


@query(_with(INPUTS, _mean("A", "S1", "aid")))
def signal_mean_bigwig(spark, sf_dir):
    """The same means from a bigWig track: the given track is written as one, and read where annotations lie. The format's 32-bit values have the two decimals whole."""
    path = shared_path(spark, "track") + ".bw"
    bigwig.write(t.signal(spark, sf_dir), path)
    a = t.annotations(spark, sf_dir)
    track = bigwig.read(spark, path, a).withColumn("value", F.round("value", 2).cast("decimal(18,2)"))
    return overlap.interval_means(a, track).select("aid", F.round("mean", 9).alias("mean"))


@query(_with(CLEAN, f"SELECT {', '.join(f'(SELECT count(*) FROM AF a JOIN VF v ON v.chrom = a.chrom AND {c}) AS n_{k}' for k, c in ON.items())}, 0 AS different"))
def rank_diff_vs_bucket_check(spark, sf_dir):
    v, a, _ = _clean(spark, sf_dir)
    v, a, rows = written(v, "clean-variants"), written(a, "clean-annotations"), None
    for p in ON:
        sums = overlap.overlap_sums(a, v, p).select(F.lit(p).alias("p"), "aid", F.col("n").alias("x"), F.lit(0).cast("long").alias("y"))
        pairs = overlap.overlap_pairs(a, v, p).groupBy("aid").agg(F.count("*").alias("y")).select(F.lit(p).alias("p"), "aid", F.lit(0).cast("long").alias("x"), "y")
        rows = sums.unionByName(pairs) if rows is None else rows.unionByName(sums).unionByName(pairs)
    each = rows.groupBy("p", "aid").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))  # noqa: E731  (where no annotation is left, all are 0)
    of = lambda p: total(F.when(F.col("p") == p, F.col("x")).otherwise(0)).alias(f"n_{p}")
    return each.agg(*(of(p) for p in ON), total((F.col("x") != F.col("y")).cast("int")).alias("different"))


# --- annotation permutation ---

RANDOM = f"""
R0 AS (SELECT aid, chrom, (s + e) // 2 AS m, e - s AS w, {DMAX - DMIN} - (e - s + 1) AS r, unnest(range(1, {N + 1})) AS perm FROM AF WHERE {DMAX - DMIN} - (e - s + 1) > 0),
R AS (SELECT aid, chrom, perm, w, CASE WHEN perm <= {N // 2} THEN 'up' ELSE 'down' END AS side,
  m + CASE WHEN perm <= {N // 2} THEN -{DMAX} ELSE {DMIN} END + {_u(str(SEED), "CASE WHEN perm <= " + str(N // 2) + " THEN 'up' ELSE 'down' END", 'aid', 'perm')} % r AS s FROM R0),
RB AS (SELECT aid, chrom, perm, side, s, s + w AS e FROM R),
RC AS (SELECT a.aid, a.perm, a.side, count(v.vid) AS n, coalesce(sum(v.signal), 0) AS sig FROM RB a LEFT JOIN VF v ON v.chrom = a.chrom AND a.s <= (CASE WHEN side = 'up' THEN v.s ELSE v.e END) AND (CASE WHEN side = 'up' THEN v.s ELSE v.e END) <= a.e GROUP BY ALL),
O AS (SELECT a.aid, a.name, a.chrom, a.s, a.e, count(v.vid) FILTER (WHERE v.s < a.e) AS n_obs, coalesce(sum(v.signal) FILTER (WHERE a.s < v.e AND v.e <= a.e), 0) AS sig_obs
  FROM (SELECT * FROM AF WHERE {DMAX - DMIN} - (e - s + 1) > 0) a LEFT JOIN VF v ON v.chrom = a.chrom AND v.s <= a.e AND v.e >= a.s GROUP BY ALL),
P AS (SELECT O.aid, O.name, O.chrom, O.s, O.e, O.n_obs, O.sig_obs, count(*) FILTER (WHERE RC.n >= O.n_obs) / {N} AS p, count(*) FILTER (WHERE RC.sig >= O.sig_obs) / {N} AS signal_p FROM O JOIN RC ON RC.aid = O.aid GROUP BY ALL),
"""
RANDOM_CTES = CLEAN + RANDOM


def _random(spark, sf_dir):
    v, a, _ = _clean(spark, sf_dir)
    return v, permute.random_bins(a, N, DMIN, DMAX, SEED)


def _side(side: str) -> str:
    return _with(RANDOM_CTES, f'SELECT aid, perm, chrom, s AS "start", e AS "end" FROM RB WHERE side = \'{side}\'')


@query(_side("up"))
def random_bins_upstream(spark, sf_dir):
    return _random(spark, sf_dir)[1].where("side = 'up'").drop("side")


@query(_side("down"))
def random_bins_downstream(spark, sf_dir):
    return _random(spark, sf_dir)[1].where("side = 'down'").drop("side")


@query(_with(RANDOM_CTES, "SELECT aid, perm, n FROM RC WHERE side = 'up'"))
def bin_counts_up(spark, sf_dir):
    v, r = _random(spark, sf_dir)
    return overlap.overlap_sums(r.where("side = 'up'"), v, "up").select("aid", "perm", "n")


@query(_with(RANDOM_CTES, "SELECT aid, perm, n FROM RC WHERE side = 'down'"))
def bin_counts_down(spark, sf_dir):
    v, r = _random(spark, sf_dir)
    return overlap.overlap_sums(r.where("side = 'down'"), v, "down").select("aid", "perm", "n")


def _permuted(spark, sf_dir, mode):
    return alg.permute_annotations(t.variants(spark, sf_dir), t.annotations(spark, sf_dir), t.blacklist(spark, sf_dir), N, DMIN, DMAX, mode, SEED)


@query(_with(RANDOM_CTES, "SELECT aid, name, n_obs, p FROM P"))
def perm_annotation_pvalue(spark, sf_dir):
    return _permuted(spark, sf_dir, "n").select("aid", "name", "n_obs", "p")


@query(_with(RANDOM_CTES, "SELECT aid, n_obs, p, CAST(sig_obs AS DOUBLE) AS signal_obs FROM P"))
def perm_annotation_signal_observed(spark, sf_dir):
    return _permuted(spark, sf_dir, "o").select("aid", "n_obs", "p", F.col("signal_obs").cast("double").alias("signal_obs"))


@query(_with(RANDOM_CTES, "SELECT aid, n_obs, p, CAST(sig_obs AS DOUBLE) AS signal_obs, signal_p FROM P"))
def perm_annotation_signal_pvalue(spark, sf_dir):
    return _permuted(spark, sf_dir, "p").select("aid", "n_obs", "p", F.col("signal_obs").cast("double").alias("signal_obs"), "signal_p")


@query(_with(RANDOM_CTES, "SELECT chrom || chr(9) || s || chr(9) || e || chr(9) || name || chr(9) || printf('%.6f', p) || chr(9) || printf('%e', CAST(sig_obs AS DOUBLE)) || chr(9) || printf('%.6f', signal_p) AS line FROM P"))
def output_format(spark, sf_dir):
    return sinks.pvalue_lines(_permuted(spark, sf_dir, "p"))


# --- bins ---


def _tiles(name: str, length: int, width: int) -> str:
    return f"""{name} AS (SELECT chrom, ord, 1 + i * {width} AS s, least(1 + (i + 1) * {width}, {length}) AS e FROM (VALUES ('chr1', 1), ('chr2', 2), ('chr3', 3), ('chrX', 23), ('chrY', 24)) x(chrom, ord), (SELECT unnest(range(0, CAST(ceil({length - 1} / {width}) AS BIGINT))) AS i)),
"""


def _subtracted(name: str, tiles: str, black: str) -> str:
    return f"""{name}C AS (SELECT a.chrom, a.ord, a.s, a.e, greatest(a.s, b.s) AS x, least(a.e, b.e) AS y FROM {tiles} a JOIN {black} b ON a.chrom = b.chrom AND a.s <= b.e AND a.e >= b.s),
{name}G AS (SELECT chrom, ord, coalesce(lag(y) OVER (PARTITION BY chrom, s ORDER BY x, y), s) AS a, x AS b FROM {name}C UNION ALL SELECT chrom, ord, max(y), e FROM {name}C GROUP BY chrom, ord, s, e),
{name} AS (SELECT chrom, ord, a AS s, b AS e FROM {name}G WHERE a < b UNION ALL SELECT t.chrom, t.ord, t.s, t.e FROM {tiles} t WHERE NOT EXISTS (SELECT 1 FROM {name}C c WHERE c.chrom = t.chrom AND c.s = t.s)),
"""


def _absorbed(name: str, src: str, min_width: int) -> str:
    """The fold as a list reduction over each chromosome's bins: the last bin of acc is judged when the next one comes, so a bin far away ends the list."""
    bin_ = lambda s, e, gone: f"struct_pack(s := CAST({s} AS BIGINT), e := CAST({e} AS BIGINT), gone := {gone})"
    narrow = f"NOT acc[-1].gone AND acc[-1].e - acc[-1].s < {min_width}"
    left = "NOT acc[-2].gone AND acc[-2].e = acc[-1].s"
    return f"""{name}L AS (SELECT chrom, ord, list_append(list({bin_('s', 'e', 'false')} ORDER BY s), {bin_('1e15', '2e15', 'false')}) AS l FROM {src} GROUP BY chrom, ord),
{name}F AS (SELECT chrom, ord, list_reduce(list_prepend([{bin_('-2e15', '-1e15', 'true')}, {bin_('-2e15', '-1e15', 'true')}], list_transform(l, lambda b: [b])), lambda acc, nxt:
   CASE WHEN {narrow} AND {left} THEN list_concat(acc[:-3], [{bin_('acc[-2].s', 'acc[-1].e', 'false')}, {bin_('acc[-1].s', 'acc[-1].e', 'true')}, nxt[1]])
        WHEN {narrow} AND acc[-1].e = nxt[1].s THEN list_concat(acc[:-2], [{bin_('acc[-1].s', 'acc[-1].e', 'true')}, {bin_('acc[-1].s', 'nxt[1].e', 'false')}])
        WHEN {narrow} THEN list_concat(acc[:-2], [{bin_('acc[-1].s', 'acc[-1].e', 'true')}, nxt[1]])
        ELSE list_concat(acc, nxt) END) AS l FROM {name}L),
{name} AS (SELECT chrom, ord, b.s AS s, b.e AS e FROM (SELECT chrom, ord, unnest(l) AS b FROM {name}F) WHERE NOT b.gone AND b.s < 1000000000000000),
"""


TILES = CLEAN + _tiles("T", t.LENGTH, WIDTH)
BINS = TILES + _subtracted("D", "T", "BM")


_ENDS = "VE AS (SELECT chrom, CASE chrom WHEN 'chr1' THEN 1 WHEN 'chr2' THEN 2 WHEN 'chr3' THEN 3 WHEN 'chrX' THEN 23 ELSE 24 END AS ord, max(e) AS length FROM V GROUP BY chrom),\n"


@query(_with(INPUTS + _ENDS, f'SELECT chrom, 1 + i * {WIDTH} AS "start", least(1 + (i + 1) * {WIDTH}, length) AS "end" FROM (SELECT *, unnest(range(0, CAST(ceil((length - 1) / {WIDTH}) AS BIGINT))) AS i FROM VE WHERE length > 1)'))
def tile_genome(spark, sf_dir):
    """Tiles of contigs that are as long as their variants reach."""
    ends = t.variants(spark, sf_dir).groupBy("chrom").agg(F.max("end").alias("length")).withColumn("ord", g.order_of(F.col("chrom")))
    return intervals.tile(ends, WIDTH).select("chrom", "start", "end")


@query(_with(BINS, 'SELECT chrom, s AS "start", e AS "end" FROM D'))
def subtract_blacklist(spark, sf_dir):
    return intervals.subtract(intervals.tile(t.genome(spark), WIDTH), written(intervals.merge(t.blacklist(spark, sf_dir)), "blacklist")).select("chrom", "start", "end")


def _bins(spark, sf_dir):
    return alg.clean_bins(t.genome(spark), t.blacklist(spark, sf_dir), WIDTH, MIN_WIDTH)


@query(_with(BINS + _absorbed("AB", "D", MIN_WIDTH), 'SELECT chrom, s AS "start", e AS "end" FROM AB'))
def absorb_small_bins(spark, sf_dir):
    return _bins(spark, sf_dir).select("chrom", "start", "end")


@query(_with(BINS, "SELECT v.vid, a.s AS bin_start, a.e AS bin_end FROM V v JOIN D a ON v.chrom = a.chrom AND " + ON["point"]))
def assign_variant_bins(spark, sf_dir):
    bins = _plain_bins(spark, sf_dir)
    return intervals.assign(t.variants(spark, sf_dir), bins).select("vid", "bin_start", "bin_end")


# --- contexts and variant permutation, on the short contigs ---

def _bases(length: int) -> str:
    return f"""
Q0 AS (SELECT chrom, pos, CASE WHEN pos BETWEEN 7001 AND 7100 THEN 'N' ELSE substr('ACGT', 1 + CAST({_u(str(t.SEQ_SEED), "'base'", 'chrom', 'pos')} % 4 AS INTEGER), 1) END AS b
  FROM (VALUES ('chr1'), ('chr2'), ('chr3'), ('chrX'), ('chrY')) x(chrom), (SELECT unnest(range(1, {length + 1})) AS pos)),
Q1 AS (SELECT chrom, pos, b AS k1, lag(b) OVER w || b || lead(b) OVER w AS k3, lag(b, 2) OVER w || lag(b) OVER w || b || lead(b) OVER w || lead(b, 2) OVER w AS k5 FROM Q0 WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
"""


SHORT = (
    CLEAN
    + f"""
SV AS (SELECT vid, chrom, s % {t.SHORT - 2} + 1 AS s, s % {t.SHORT - 2} + 2 AS e, signal AS extra FROM V),
SB0 AS (SELECT chrom, s % {t.SHORT - 400} AS s, s % {t.SHORT - 400} + 60 + s % 70 AS e FROM B),
"""
    + _merged("SB", "SB0")
    + _tiles("ST", t.SHORT, SHORT_WIDTH)
    + _subtracted("SD", "ST", "SB")
    + _bases(t.SHORT)
)
#: The same names over the whole contigs, of 2,592,001 bases each, with the given coordinates.
LONG = BINS + "SV AS (SELECT vid, chrom, s, e, signal AS extra FROM V),\nSB AS (SELECT * FROM BM),\nSA AS (SELECT aid, chrom, s, e FROM A),\nSD AS (SELECT * FROM D),\n" + _bases(t.LENGTH)


@query(_with(SHORT, "SELECT v.vid, q.k3 AS kmer FROM SV v JOIN Q1 q ON v.chrom = q.chrom AND v.e = q.pos WHERE q.k3 NOT LIKE '%N%'"))
def kmer_of_variant(spark, sf_dir):
    k = kmers.positions(t.sequence(spark), 3).where(~F.col("kmer").contains("N"))
    return t.short_variants(spark, sf_dir).withColumn("pos", F.col("end")).join(k, ["chrom", "pos"]).select("vid", "kmer")


def _short_bins(spark, sf_dir):
    return written(intervals.subtract(intervals.tile(t.genome(spark, t.SHORT), SHORT_WIDTH), written(intervals.merge(t.short_blacklist(spark, sf_dir)), "blacklist")), "bins")


@query(_with(SHORT, "SELECT a.chrom || ':' || a.s AS grp, q.k3 AS kmer, count(*) AS n FROM SD a JOIN Q1 q ON a.chrom = q.chrom AND a.s < q.pos AND q.pos <= a.e WHERE q.k3 NOT LIKE '%N%' GROUP BY ALL"))
def kmer_index_counts(spark, sf_dir):
    bins = _short_bins(spark, sf_dir).withColumn("grp", F.concat_ws(":", "chrom", "start"))
    return sites.context_index(sites.segments(t.sequence(spark), bins, 3), 3).groupBy("grp", "kmer").agg(F.sum("c").alias("n"))


def _drawn(kmer: str, what: str, grp: str = "a.chrom || ':' || a.s", bins: str = "SD", n: int = 4) -> str:
    """Draws of sites of the same context but the own one; where all are one ('*'), of any."""
    other = int(kmer != "'*'")
    return f"""
C0 AS (SELECT {grp} AS grp, q.chrom, q.pos, {kmer} AS kmer FROM {bins} a JOIN Q1 q ON a.chrom = q.chrom AND a.s < q.pos AND q.pos <= a.e WHERE {kmer if kmer != "'*'" else 'q.k1'} NOT LIKE '%N%'),
C AS (SELECT *, row_number() OVER (PARTITION BY grp, kmer ORDER BY chrom, pos) AS rank, count(*) OVER (PARTITION BY grp, kmer) AS c FROM C0),
W0 AS (SELECT v.vid, c.grp, c.kmer, c.c, c.rank AS own, unnest(range(1, {n + 1})) AS perm FROM SV v JOIN C c ON c.chrom = v.chrom AND c.pos = v.e WHERE c.c > {other}),
W1 AS (SELECT *, {_u(str(SEED), f"'{what}'", 'vid', 'perm')} % (c - {other}) + 1 AS r FROM W0),
X AS (SELECT W1.vid, W1.perm, C.chrom, C.pos - 1 AS s, C.pos AS e FROM W1 JOIN C ON C.grp = W1.grp AND C.kmer = W1.kmer AND C.rank = W1.r + CASE WHEN {other} = 1 AND W1.r >= own THEN 1 ELSE 0 END),
"""


PERMS = 4
_X = 'SELECT X.vid, X.perm, X.chrom, X.s AS "start", X.e AS "end", CAST(SV.extra AS DOUBLE) AS extra FROM X JOIN SV ON SV.vid = X.vid'


def _permute_short(spark, sf_dir, preserve, k=3):
    # The plain bins (SHORT_MIN of 1 absorbs none), so that the SQL needs no fold.
    out = alg.permute_variants(t.short_variants(spark, sf_dir), t.short_blacklist(spark, sf_dir), t.genome(spark, t.SHORT), t.sequence(spark), PERMS, SHORT_WIDTH, 1, preserve, k, SEED)
    return out.withColumn("extra", F.col("extra").cast("double"))


@query(_with(SHORT + _drawn("'*'", "permute0"), _X))
def permute_uniform(spark, sf_dir):
    return _permute_short(spark, sf_dir, False)


@query(_with(SHORT + _drawn("q.k3", "permute3"), _X))
def permute_trimer(spark, sf_dir):
    return _permute_short(spark, sf_dir, True)


@query(_with(SHORT + _drawn("q.k5", "permute5"), _X))
def permute_pentamer(spark, sf_dir):
    return _permute_short(spark, sf_dir, True, 5)


SHORT_SIGNAL = f"SS AS (SELECT chrom, s % {t.SHORT} AS s, s % {t.SHORT} + 25 AS e, value FROM S1),\n"


def _short_signal(spark, sf_dir):
    start = F.col("start") % t.SHORT
    return t.signal(spark, sf_dir).select("chrom", start.alias("start"), (start + 25).alias("end"), "value")


@query(_with(SHORT + SHORT_SIGNAL + _drawn("q.k3", "permute3"), "SELECT a.vid, a.perm, a.chrom, a.s AS \"start\", a.e AS \"end\", round(coalesce(CAST(avg(v.value) AS DOUBLE), 0), 6) AS score FROM X a LEFT JOIN SS v ON v.chrom = a.chrom AND v.s < a.e AND v.e > a.s GROUP BY ALL"))
def permuted_scores(spark, sf_dir):
    moved = _permute_short(spark, sf_dir, True).drop("extra")
    return alg.score(moved, _short_signal(spark, sf_dir)).withColumn("score", F.round("score", 6)).select("vid", "perm", "chrom", "start", "end", "score")


SHORT_ANN = f"SA AS (SELECT aid, chrom, s % {t.SHORT - 300} AS s, s % {t.SHORT - 300} + 20 + aid % 80 AS e FROM A),\n"


def _short_annotations(spark, sf_dir):
    start, a = F.col("start") % (t.SHORT - 300), t.annotations(spark, sf_dir)
    return a.select("aid", "chrom", start.alias("start"), (start + 20 + F.col("aid") % 80).alias("end"), "name")


def _empirical_sql(cols: str, world: str = SHORT + SHORT_ANN) -> str:
    anti = lambda name, src: f"{name} AS (SELECT x.* FROM {src} x WHERE NOT EXISTS (SELECT 1 FROM SB b WHERE b.chrom = x.chrom AND x.s <= b.e AND x.e >= b.s)),\n"
    return _with(
        world + _drawn("q.k3", "permute3") + anti("EV", "SV") + anti("EA", "SA")
        + f"""EO AS (SELECT a.aid, count(v.vid) FILTER (WHERE v.s < a.e) AS n_obs, coalesce(sum(v.extra) FILTER (WHERE a.s < v.e AND v.e <= a.e), 0) AS sig FROM EA a LEFT JOIN EV v ON v.chrom = a.chrom AND v.s <= a.e AND v.e >= a.s GROUP BY a.aid),
EX AS (SELECT X.*, SV.extra FROM X JOIN SV ON SV.vid = X.vid),
EP AS (SELECT a.aid, v.perm, count(*) FILTER (WHERE v.s < a.e) AS n, coalesce(sum(v.extra) FILTER (WHERE a.s < v.e AND v.e <= a.e), 0) AS sig FROM EA a JOIN EX v ON v.chrom = a.chrom AND v.s <= a.e AND v.e >= a.s GROUP BY a.aid, v.perm),
ER AS (SELECT o.aid, o.n_obs, o.sig, p.perm, coalesce(e.n, 0) AS n, coalesce(e.sig, 0) AS psig FROM EO o, (SELECT unnest(range(1, {PERMS + 1})) AS perm) p LEFT JOIN EP e ON e.aid = o.aid AND e.perm = p.perm),
""",
        f"SELECT aid, n_obs, count(*) FILTER (WHERE n >= n_obs) / {PERMS} AS p{cols} FROM ER GROUP BY aid, n_obs, sig",
    )


def _empirical(spark, sf_dir, mode):
    v = t.short_variants(spark, sf_dir).withColumnRenamed("extra", "signal")
    moved = alg.permute_variants(v, t.short_blacklist(spark, sf_dir), t.genome(spark, t.SHORT), t.sequence(spark), PERMS, SHORT_WIDTH, 1, True, 3, SEED)
    return alg.empirical_pvalues(v, _short_annotations(spark, sf_dir), t.short_blacklist(spark, sf_dir), moved, mode)


@query(_empirical_sql(""))
def empirical_pvalue(spark, sf_dir):
    return _empirical(spark, sf_dir, "n").select("aid", "n_obs", "p")


@query(_empirical_sql(f", CAST(sig AS DOUBLE) AS signal_obs, count(*) FILTER (WHERE psig >= sig) / {PERMS} AS signal_p"))
def empirical_signal_pvalue(spark, sf_dir):
    return _empirical(spark, sf_dir, "p").select("aid", "n_obs", "p", F.col("signal_obs").cast("double").alias("signal_obs"), "signal_p")


@query(_empirical_sql(""))
def empirical_pvalue_ledger(spark, sf_dir):
    """The same p-values from a ledger that got the permutations in three sets, some of them twice."""
    v, black = t.short_variants(spark, sf_dir).withColumnRenamed("extra", "signal"), t.short_blacklist(spark, sf_dir)
    moved = written(alg.permute_variants(v, black, t.genome(spark, t.SHORT), t.sequence(spark), PERMS, SHORT_WIDTH, 1, True, 3, SEED), "permuted")
    book = ExceedanceLedger(spark, shared_path(spark, "ledger"))
    book.begin(v, _short_annotations(spark, sf_dir), black)
    for some in ("perm = 2", "perm IN (1, 2, 3)", "perm > 0"):
        book.add(moved.where(some))
    return book.pvalues().select("aid", "n_obs", "p")


# --- from files to files ---


def _as_text(df: DataFrame, tag: str, *cols: str) -> str:
    """The address of df's columns as tab-separated text in the shared folder."""
    path = shared_path(df.sparkSession, tag)
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in cols))).write.text(path)
    return path


@query(_with(INPUTS, 'SELECT chrom, s AS "start", e AS "end", CAST(vid AS VARCHAR) AS id, CAST(signal AS VARCHAR) AS signal FROM V'))
def variants_from_text(spark, sf_dir):
    v = readers.variants(spark, _as_text(t.variants(spark, sf_dir), "variants", "chrom", "start", "end", "vid", "signal"))
    return v.select("chrom", "start", "end", F.get("extras", F.lit(0)).alias("id"), F.get("extras", F.lit(1)).alias("signal"))


@query(_with(INPUTS, 'SELECT chrom, s AS "start", e AS "end", name FROM A'))
def annotations_from_text(spark, sf_dir):
    return readers.annotations(spark, _as_text(t.annotations(spark, sf_dir), "annotations", "chrom", "start", "end", "name")).drop("aid")


@query(_with(SHORT, "SELECT v.vid, q.k3 AS kmer FROM SV v JOIN Q1 q ON v.chrom = q.chrom AND v.e = q.pos WHERE q.k3 NOT LIKE '%N%'"))
def kmers_from_fasta(spark, sf_dir):
    path = shared_path(spark, "fasta")
    sinks.write_fasta(t.sequence(spark), path)
    k = kmers.positions(readers.fasta(spark, path), 3).where(~F.col("kmer").contains("N"))
    return t.short_variants(spark, sf_dir).withColumn("pos", F.col("end")).join(k, ["chrom", "pos"]).select("vid", "kmer")


@query(_with(SHORT + _drawn("q.k3", "permute3"), 'SELECT perm, chrom, s AS "start", e AS "end" FROM X'))
def permutation_files(spark, sf_dir):
    """Permuted sets written one file a permutation and read back."""
    path = shared_path(spark, "permutations")
    sinks.write_permuted(_permute_short(spark, sf_dir, True), path)
    return readers.permutations(spark, path).select("perm", "chrom", "start", "end")


_LINE = "SELECT SA.chrom || chr(9) || SA.s || chr(9) || SA.e || chr(9) || 'ord' || SA.aid || chr(9) || printf('%.6f', p) AS line FROM"


@query(_empirical_sql("").replace("SELECT aid, n_obs, count(*)", f"{_LINE} (SELECT aid, n_obs, count(*)").replace("GROUP BY aid, n_obs, sig", "GROUP BY aid, n_obs, sig) JOIN SA USING (aid)"))
def burden_files_to_files(spark, sf_dir):
    """The command line's p-values: variants, annotations, blacklist and permuted sets as files, a file of results, read as lines."""
    perms, out = shared_path(spark, "permutations"), shared_path(spark, "results")
    sinks.write_permuted(_permute_short(spark, sf_dir, True), perms)
    inputs = {"variants": (t.short_variants(spark, sf_dir), []), "annotations": (_short_annotations(spark, sf_dir), ["name"]), "blacklist": (t.short_blacklist(spark, sf_dir), [])}
    args = [x for name, (df, more) in inputs.items() for x in (f"--{name}", _as_text(df, name, "chrom", "start", "end", *more))]
    cli.main(["pvalues", *args, "--permutations", perms, "--out", out], spark)
    return spark.read.text(out).withColumnRenamed("value", "line")


@query(_with(SHORT + _drawn("q.k3", "permute3"), "SELECT count(DISTINCT perm) AS n FROM X"))
def permutation_count(spark, sf_dir):
    return _permute_short(spark, sf_dir, True).select("perm").distinct().agg(F.count("*").alias("n"))


# --- variant permutation on the whole contigs ---


def _permute_long(spark, sf_dir, preserve, k=3, name="extra"):
    v = t.variants(spark, sf_dir).withColumnRenamed("signal", name)
    return alg.permute_variants(v, t.blacklist(spark, sf_dir), t.genome(spark), t.sequence(spark, t.LENGTH), PERMS, WIDTH, 1, preserve, k, SEED)


def _long(spark, sf_dir, preserve, k=3):
    return _permute_long(spark, sf_dir, preserve, k).withColumn("extra", F.col("extra").cast("double"))


@query(_with(LONG + _drawn("'*'", "permute0"), _X))
def permute_uniform_all(spark, sf_dir):
    return _long(spark, sf_dir, False)


@query(_with(LONG + _drawn("q.k3", "permute3"), _X))
def permute_trimer_all(spark, sf_dir):
    return _long(spark, sf_dir, True)


@query(_with(LONG + _drawn("q.k5", "permute5"), _X))
def permute_pentamer_all(spark, sf_dir):
    return _long(spark, sf_dir, True, 5)


@query(_empirical_sql(f", CAST(sig AS DOUBLE) AS signal_obs, count(*) FILTER (WHERE psig >= sig) / {PERMS} AS signal_p", LONG))
def empirical_signal_pvalue_all(spark, sf_dir):
    out = alg.empirical_pvalues(t.variants(spark, sf_dir), t.annotations(spark, sf_dir), t.blacklist(spark, sf_dir), _permute_long(spark, sf_dir, True, name="signal"), "p")
    return out.select("aid", "n_obs", "p", F.col("signal_obs").cast("double").alias("signal_obs"), "signal_p")


# --- covariates, clusters, epochs, simulation ---

COVARIATES = (
    BINS
    + """
Z0 AS (SELECT *, row_number() OVER (ORDER BY ord, s) - 1 AS rid FROM D),
Z1 AS (SELECT a.rid, coalesce(CAST(sum(v.value * (least(a.e, v.e) - greatest(a.s, v.s))) AS DOUBLE) / sum(least(a.e, v.e) - greatest(a.s, v.s)), 0) AS f0 FROM Z0 a LEFT JOIN S1 v ON v.chrom = a.chrom AND v.s < a.e AND v.e > a.s GROUP BY a.rid),
Z2 AS (SELECT a.rid, coalesce(CAST(sum(v.value * (least(a.e, v.e) - greatest(a.s, v.s))) AS DOUBLE) / sum(least(a.e, v.e) - greatest(a.s, v.s)), 0) AS f1 FROM Z0 a LEFT JOIN S2 v ON v.chrom = a.chrom AND v.s < a.e AND v.e > a.s GROUP BY a.rid),
ZF AS (SELECT Z0.rid, chrom, ord, s, e, f0, f1 FROM Z0 JOIN Z1 ON Z0.rid = Z1.rid JOIN Z2 ON Z0.rid = Z2.rid),
ZZ AS (SELECT rid, chrom, ord, s, e, round((f0 - (SELECT avg(f0) FROM ZF)) / (SELECT stddev_pop(f0) FROM ZF), 9) AS f0, round((f1 - (SELECT avg(f1) FROM ZF)) / (SELECT stddev_pop(f1) FROM ZF), 9) AS f1 FROM ZF),
"""
)


def _lloyd() -> str:
    out = f"K0 AS (SELECT CAST(rid // (SELECT count(*) // {CLUSTERS} FROM ZZ) AS INTEGER) AS c, f0, f1 FROM ZZ WHERE rid % (SELECT count(*) // {CLUSTERS} FROM ZZ) = 0 AND rid < {CLUSTERS} * (SELECT count(*) // {CLUSTERS} FROM ZZ)),\n"
    for i in range(ITERATIONS):
        out += f"""M{i} AS MATERIALIZED (SELECT z.rid, arg_min(k.c, struct_pack(d := (z.f0 - k.f0) * (z.f0 - k.f0) + (z.f1 - k.f1) * (z.f1 - k.f1), c := k.c)) AS cluster FROM ZZ z, K{i} k GROUP BY z.rid),
K{i + 1} AS MATERIALIZED (SELECT M{i}.cluster AS c, round(avg(f0), 9) AS f0, round(avg(f1), 9) AS f1 FROM ZZ JOIN M{i} ON ZZ.rid = M{i}.rid GROUP BY M{i}.cluster),
"""
    return out


LLOYD = COVARIATES + _lloyd()
LAST = f"M{ITERATIONS - 1}"


def _plain_bins(spark, sf_dir):
    return written(intervals.subtract(intervals.tile(t.genome(spark), WIDTH), written(intervals.merge(t.blacklist(spark, sf_dir)), "blacklist")), "bins")


def _features(spark, sf_dir):
    return alg.covariate_features(_plain_bins(spark, sf_dir), [t.signal(spark, sf_dir), t.second_signal(spark, sf_dir)])


@query(_with(COVARIATES, "SELECT rid, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM ZF"))
def covariate_means(spark, sf_dir):
    return _features(spark, sf_dir).select("rid", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


@query(_with(COVARIATES, "SELECT rid, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM ZZ"))
def zscore_covariates(spark, sf_dir):
    return cluster.zscores(_features(spark, sf_dir), ["f0", "f1"]).select("rid", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


def _clustered(spark, sf_dir):
    return cluster.kmeans(cluster.zscores(_features(spark, sf_dir), ["f0", "f1"]), ["f0", "f1"], CLUSTERS, ITERATIONS)


@query(_with(LLOYD, f"SELECT rid, cluster FROM {LAST}"))
def kmeans_members(spark, sf_dir):
    return _clustered(spark, sf_dir)[0].select("rid", "cluster")


@query(_with(LLOYD, f"SELECT c AS cluster, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM K{ITERATIONS}"))
def kmeans_centroids(spark, sf_dir):
    return _clustered(spark, sf_dir)[1].select("cluster", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


EPOCH = (
    LLOYD
    + f"""
LB AS (SELECT cluster, chrom, ord, s, e, CAST(sum(e - s) OVER (PARTITION BY cluster ORDER BY ord, s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM ZZ JOIN {LAST} m ON ZZ.rid = m.rid),
EF AS (SELECT v.vid, a.cluster, v.e - a.s + a.hi - (a.e - a.s) AS epoch FROM V v JOIN LB a ON v.chrom = a.chrom AND {ON['point']}),
"""
)


def _laid(spark, sf_dir):
    return written(epoch.lay_out(_clustered(spark, sf_dir)[0].select("cluster", "chrom", "ord", "start", "end")), "laid")


@query(_with(EPOCH, "SELECT vid, cluster, epoch FROM EF"))
def epoch_forward(spark, sf_dir):
    return epoch.forward(t.variants(spark, sf_dir), _laid(spark, sf_dir)).select("vid", "cluster", "epoch")


@query(_with(EPOCH, 'SELECT V.vid, V.chrom, V.s AS "start", V.e AS "end" FROM V JOIN EF ON V.vid = EF.vid'))
def epoch_inverse(spark, sf_dir):
    laid = _laid(spark, sf_dir)
    there = epoch.forward(t.variants(spark, sf_dir), laid).select("vid", "cluster", "epoch")
    return epoch.inverse(there, laid).select("vid", "chrom", "start", "end")


@query(_with(
    EPOCH + f"""
U0 AS (SELECT EF.vid, EF.cluster, unnest(range(1, {PERMS + 1})) AS perm, (SELECT max(hi) FROM LB WHERE LB.cluster = EF.cluster) AS total FROM EF),
U AS (SELECT vid, perm, cluster, {_u(str(SEED), "'simulate0'", 'vid', 'perm')} % total + 1 AS epoch FROM U0),
""",
    'SELECT U.vid, U.perm, b.chrom, b.s + U.epoch - (b.hi - (b.e - b.s)) - 1 AS "start", b.s + U.epoch - (b.hi - (b.e - b.s)) AS "end" FROM U JOIN LB b ON b.cluster = U.cluster AND b.hi - (b.e - b.s) < U.epoch AND U.epoch <= b.hi',
))
def simulate_uniform(spark, sf_dir):
    laid = _laid(spark, sf_dir)
    return alg.simulate_uniform(epoch.forward(t.variants(spark, sf_dir), laid), laid, PERMS, SEED)


SIM_BINS = f"ZB AS (SELECT *, CAST(((s - 1) // {SHORT_WIDTH}) % 3 AS VARCHAR) AS grp FROM SD),\n"


@query(_with(SHORT + SIM_BINS + _drawn("q.k3", "simulate3", "a.grp", "ZB"), 'SELECT vid, perm, chrom, s AS "start", e AS "end" FROM X'))
def simulate_trimer(spark, sf_dir):
    """Sites drawn over groups of bins of several chromosomes, of the variant's context."""
    bins = _short_bins(spark, sf_dir).withColumn("grp", (F.floor((F.col("start") - 1) / SHORT_WIDTH) % 3).cast("string"))
    v = t.short_variants(spark, sf_dir).drop("extra")
    return alg._with_extras(sites.draw_contexts(v, sites.segments(t.sequence(spark), bins, 3), PERMS, 3, "simulate3", SEED), v)


def _simulated(clusters: int, iterations: int, n: int) -> str:
    """Absorbed short bins, their mean signal, z-scores, Lloyd's steps and draws over clusters."""
    out = SHORT + SHORT_SIGNAL + _absorbed("AB", "SD", SHORT_MIN) + """
Y0 AS (SELECT *, row_number() OVER (ORDER BY ord, s) - 1 AS rid FROM AB),
Y1 AS (SELECT a.rid, coalesce(CAST(sum(v.value * (least(a.e, v.e) - greatest(a.s, v.s))) AS DOUBLE) / sum(least(a.e, v.e) - greatest(a.s, v.s)), 0) AS f FROM Y0 a LEFT JOIN SS v ON v.chrom = a.chrom AND v.s < a.e AND v.e > a.s GROUP BY a.rid),
YZ AS (SELECT Y0.rid, chrom, ord, s, e, round((f - (SELECT avg(f) FROM Y1)) / (SELECT stddev_pop(f) FROM Y1), 9) AS f FROM Y0 JOIN Y1 ON Y0.rid = Y1.rid),
"""
    step = f"(SELECT count(*) // {clusters} FROM YZ)"
    out += f"YK0 AS (SELECT CAST(rid // {step} AS INTEGER) AS c, f FROM YZ WHERE rid % {step} = 0 AND rid < {clusters} * {step}),\n"
    for i in range(iterations):
        out += f"""YM{i} AS MATERIALIZED (SELECT z.rid, arg_min(k.c, struct_pack(d := (z.f - k.f) * (z.f - k.f), c := k.c)) AS cluster FROM YZ z, YK{i} k GROUP BY z.rid),
YK{i + 1} AS MATERIALIZED (SELECT YM{i}.cluster AS c, round(avg(f), 9) AS f FROM YZ JOIN YM{i} ON YZ.rid = YM{i}.rid GROUP BY YM{i}.cluster),
"""
    return out + f"ZB AS (SELECT chrom, s, e, CAST(cluster AS VARCHAR) AS grp FROM YZ JOIN YM{iterations - 1} m ON YZ.rid = m.rid),\n" + _drawn("q.k3", "simulate3", "a.grp", "ZB", n)


@query(_with(_simulated(4, 3, 2), _X))
def simulate_variants(spark, sf_dir):
    """The whole simulation, from covariates to new sites."""
    return alg.simulate_variants(t.short_variants(spark, sf_dir), t.short_blacklist(spark, sf_dir), t.genome(spark, t.SHORT), t.sequence(spark), [_short_signal(spark, sf_dir)], 2, SHORT_WIDTH, SHORT_MIN, True, 4, 3, 3, SEED).withColumn("extra", F.col("extra").cast("double"))
