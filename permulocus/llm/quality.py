"""Operator 1, quality rules with risk-controlled thresholds. DataFrame functions only.

Fixed base rules fail short and repetitive texts. Beyond them each rule of RULES rejects a text whose
statistic reaches a cutoff, chosen per stratum (lang) from a grid of BINS steps on labelled holdout rows:

* risk of a cutoff: the share of good texts (quality 1, base rules passed) that it rejects;
* a cutoff is certified if an exact binomial test rejects "risk > ALPHA / rules", that is, if
  P(Binomial(n, ALPHA / rules) <= rejected) <= DELTA / (rules * strata);
* cutoffs are tested from the most lenient on and testing stops at the first that is not certified
  (fixed-sequence testing, which needs no further correction over the grid; rules and strata get
  Bonferroni's). So with confidence 1 - DELTA, in every stratum at most ALPHA of good texts are rejected;
* of the certified cutoffs that one is taken which rejects most bad less good texts, the most lenient of equals,
  and none where none rejects more bad than good ones.

Text is read once and never shuffled; what is grouped are small rows, counted per (stratum, rule, bin)
with map-side combine. A document is one trial, however many rows it has.

Cases: null or empty text has no words and fails the base rules; null lang is the stratum "und"; strata
with too few labels get no cutoff, so only the base rules hold there; of several labels of one
document the best counts; repeated rows each get the verdict, and of several texts of one labelled document that with
the greatest stratum and bins counts; labels without documents do nothing; an empty table gives none; columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS_CHARS, fresh, shingle_hashes, stage, table, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ALPHA = 0.02
DELTA = 0.05
BINS = 64
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "dup_lines", "repeats", "capitals", "marks")


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda j: F.coalesce(F.get(s, j - 1)["h"] == F.get(s, j)["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == F.get(s, j)["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), same), lambda j: F.get(s, j)["i"]))
        # Sorted starts: each window adds three words less its overlap with the next one.
        return F.aggregate(F.transform(F.array(at), lambda a: F.aggregate(F.transform(a, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(a, k + 1) - p), F.lit(3))), F.lit(0), lambda x, y: x + y)), F.lit(0), lambda x, y: x + y)

    many = (F.size(words) >= 3) & (F.size(F.array_distinct(hashes)) < F.size(hashes))
    return F.when(many, F.get(F.transform(F.array(order), covered), F.lit(0))).otherwise(0)


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "__q_") -> DataFrame:
    """docs and its statistics, in columns that begin with prefix."""
    p, text = prefix, F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(f"{p}words", words_of(F.col(text_col)))
    out = out.withColumn(f"{p}hashes", shingle_hashes(F.col(f"{p}words"), 3))
    out = out.withColumn(f"{p}lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""))
    size = lambda c: F.char_length(c).cast("long")
    without = lambda chars: size(text) - size(F.translate(text, chars, ""))
    out = out.withColumns(
        {
            f"{p}n_words": F.size(f"{p}words").cast("long"),
            f"{p}word_chars": size(F.translate(text, WS_CHARS, "")),
            f"{p}n_symbols": without(SYMBOLS),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
            f"{p}n_repeat_words": _repeat_words(F.col(f"{p}words"), F.col(f"{p}hashes")).cast("long"),
            f"{p}n_lines": F.size(f"{p}lines").cast("long"),
            f"{p}n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            f"{p}n_marks": without("!?"),
        }
    ).drop(f"{p}words", f"{p}hashes", f"{p}lines")
    col = lambda x: F.col(p + x)
    out = out.withColumn(f"{p}base_failed", (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > MAX_REPEAT_PERCENT * col("n_words")))
    # Whole numbers from 0 to BINS: a cutoff of k rejects statistics of at least k / BINS.
    bins = lambda a, b: F.coalesce(F.least(F.lit(BINS), F.floor(BINS * col(a) / col(b))), F.lit(0)).cast("int")
    stat = {"symbols": bins("n_symbols", "word_chars"), "dup_lines": bins("n_dup_lines", "n_lines"), "repeats": bins("n_repeat_words", "n_words"), "capitals": bins("n_capitals", "word_chars"), "marks": bins("n_marks", "word_chars")}
    # A row number beside the bins keeps filters above them: pushed below, they would compute words anew for each use.
    return out.withColumns({f"{p}bins": F.array(*(F.when(col("n_words") > 0, stat[r]).otherwise(0) for r in RULES)), f"{p}row": F.monotonically_increasing_id()})


def _binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), the exact sum in logarithms; 1 where k is at least the mean."""
    step = lambda s, i: F.struct(
        (s["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).alias("t"),
        (s["c"] + F.log1p(F.exp(s["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p))) - s["c"]))).alias("c"),
    )
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), first.alias("c")), step)["c"]
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(first)).otherwise(F.exp(total))


def choose_cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """holdout: stratum, quality, bins. Gives (stratum, cutoffs): an array by rule, null: no cutoff. One row a stratum."""
    counts = stage(
        holdout.select("stratum", "quality", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")),
        "quality-counts",
    )
    strata = max(1, counts.select("stratum").distinct().count())
    from_top = W.partitionBy("stratum", "rule").orderBy(F.desc("bin"))
    # A bin that no text has gives the same test as the next higher one, so only bins that occur are tried.
    tests = counts.select("stratum", "rule", "bin", F.sum("good").over(W.partitionBy("stratum", "rule")).alias("n"), F.sum("good").over(from_top).alias("k"), F.sum("bad").over(from_top).alias("caught")).where("bin > 0")
    sure = _binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= delta / (len(RULES) * strata)
    tests = tests.withColumn("sure", F.min(sure).over(from_top)).where("sure AND caught > k")
    best = tests.groupBy("stratum", "rule").agg(F.max(F.struct(F.expr("caught - k").alias("gain"), "bin"))["bin"].alias("bin"))
    chosen = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "bin"))).alias("m"))
    return stage(chosen.select("stratum", F.array(*(F.try_element_at("m", F.lit(i)) for i in range(len(RULES)))).alias("cutoffs")), "quality-cutoffs")


def _rejected(bins: Column, cutoffs: Column) -> Column:
    hit = F.exists(F.zip_with(bins, cutoffs, lambda b, c: F.coalesce(b >= c, F.lit(False))), lambda x: x)
    return F.coalesce(hit, F.lit(False))


def _holdout(stats: DataFrame, labels: DataFrame, stratum: Column, prefix: str = "__q_") -> DataFrame:
    best = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    passed = stats.where(~F.col(f"{prefix}base_failed")).select("doc_id", stratum.alias("stratum"), F.col(f"{prefix}bins").alias("bins"))
    once = passed.join(best, "doc_id").groupBy("doc_id").agg(F.max(F.struct("stratum", "bins")).alias("at"), F.max("quality").alias("quality"))
    return once.select("at.stratum", "quality", "at.bins")


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One small row a document, without text: doc_id, the statistics, base_failed and kept."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("und"))
    # A few numbers a document, computed once; what follows reads them, not texts.
    stats = stage(with_statistics(docs.select("doc_id", stratum.alias("stratum"), F.col(text_col).alias("text"))).drop("text"), "quality-statistics")
    cutoffs = choose_cutoffs(_holdout(stats, labels, F.col("stratum")))
    out = stats.join(cutoffs, "stratum", "left")
    kept = ~F.col("__q_base_failed") & ~_rejected(F.col("__q_bins"), F.col("cutoffs"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *(F.col(f"__q_{n}").alias(n) for n in names), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, with all their columns. What passes the base rules is written once beside its statistics; texts are never shuffled."""
    p, stratum = fresh(docs.columns, "q_"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und"))
    measured = with_statistics(docs, text_col, p).where((F.col(f"{p}row") >= 0) & ~F.col(f"{p}base_failed"))
    passed = stage(measured.select(*(F.col(f"`{c}`") for c in docs.columns), f"{p}base_failed", f"{p}bins"), "quality-passed")
    cutoffs = choose_cutoffs(_holdout(passed, labels, stratum, p)).withColumnsRenamed({"stratum": f"{p}stratum", "cutoffs": f"{p}cutoffs"})
    out = passed.join(cutoffs, stratum == F.col(f"{p}stratum"), "left")
    return out.where(~_rejected(F.col(f"{p}bins"), F.col(f"{p}cutoffs"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT *, list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w
), grams AS (
  SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id
), s AS (
  SELECT g.doc_id, stratum, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks
  FROM g LEFT JOIN rep ON g.doc_id = rep.doc_id
), f AS (
  SELECT *, row_number() OVER () AS rn, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s
), r AS (
  SELECT doc_id, rn, stratum, base_failed, rule,
         CASE WHEN n_words > 0 AND den > 0 THEN least({BINS}, CAST(floor({BINS} * num / den) AS INTEGER)) ELSE 0 END AS bin
  FROM (SELECT f.*, v.rule,
               CASE v.rule WHEN 0 THEN n_symbols WHEN 1 THEN n_dup_lines WHEN 2 THEN n_repeat_words WHEN 3 THEN n_capitals ELSE n_marks END AS num,
               CASE v.rule WHEN 1 THEN n_lines WHEN 2 THEN n_words ELSE word_chars END AS den
        FROM f, (VALUES (0), (1), (2), (3), (4)) v(rule))
), o AS (
  SELECT doc_id, max(struct_pack(stratum := stratum, bins := bins)) AS best
  FROM (SELECT doc_id, rn, any_value(stratum) AS stratum, list(bin ORDER BY rule) AS bins FROM r WHERE NOT base_failed GROUP BY doc_id, rn) GROUP BY doc_id
), lab AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT best.stratum AS stratum, rule, best.bins[rule + 1] AS bin, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad
  FROM o JOIN lab ON o.doc_id = lab.doc_id, (VALUES (0), (1), (2), (3), (4)) v(rule) GROUP BY ALL
), t AS (
  SELECT stratum, rule, bin, CAST(sum(good) OVER (PARTITION BY stratum, rule) AS BIGINT) AS n,
         CAST(sum(good) OVER (PARTITION BY stratum, rule ORDER BY bin DESC) AS BIGINT) AS k,
         CAST(sum(bad) OVER (PARTITION BY stratum, rule ORDER BY bin DESC) AS BIGINT) AS caught,
         (SELECT count(DISTINCT stratum) FROM c) AS strata
  FROM c
), u AS (
  SELECT *, CASE WHEN k >= n * {ALPHA / len(RULES)!r} THEN 1.0
              ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(
                   CASE WHEN i = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END
                   + i * ln({ALPHA / len(RULES)!r}) + (n - i) * ln(1 - {ALPHA / len(RULES)!r})))) END
              <= {DELTA!r} / ({len(RULES)} * strata) AS sure
  FROM t WHERE bin > 0
), v AS (
  SELECT *, bool_and(sure) OVER (PARTITION BY stratum, rule ORDER BY bin DESC) AS all_sure FROM u
), best AS (
  SELECT stratum, rule, arg_max(bin, (caught - k) * 1000 + bin) AS cutoff FROM v WHERE all_sure AND caught > k GROUP BY ALL
), bad AS (
  SELECT DISTINCT r.doc_id FROM r JOIN best ON r.stratum = best.stratum AND r.rule = best.rule WHERE r.bin >= best.cutoff
)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad ON f.doc_id = bad.doc_id
"""
