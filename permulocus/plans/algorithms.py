"""The four analyses, from DataFrames to DataFrames. See the operators for the rules of each step.

variants: vid, chrom, start, end (and signal); annotations: aid, chrom, start, end, name; blacklist: chrom, start, end.
Zero variants give counts of 0; p-values are the share of permutations that reach the observed value, without a correction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genome as g
from ..functions import rng
from ..functions.staging import written
from ..operators import cluster, epoch, intervals, overlap, permute, sites

MODES = ("n", "o", "p")


def checked(mode: str, signal: bool) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode != "n" and not signal:
        raise ValueError("modes o and p need a signal column")


def prepare(variants: DataFrame, annotations: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standard chromosomes only, names made canonical, blacklist merged and taken out."""
    v, a, b = (df.where(g.is_standard(F.col("chrom"))).withColumn("chrom", g.canonical(F.col("chrom"))) for df in (variants, annotations, blacklist))
    b = written(intervals.merge(b), "blacklist")
    out = overlap.variant_points(b)
    return overlap.without_blacklisted(v, out), overlap.without_blacklisted(a, out), b


def observed(annotations: DataFrame, variants: DataFrame | overlap.Points, mode: str = "n") -> DataFrame:
    """annotations with n_obs and, unless mode is n, signal_obs. variants: intervals, or their points (with signal, unless mode is n)."""
    if not isinstance(variants, overlap.Points):
        variants = overlap.variant_points(variants, [] if mode == "n" else ["signal"])
    out = overlap.overlap_sums(annotations, variants, "count", names={"n": "n_obs"})
    if mode == "n":
        return out
    unused = overlap.fresh(out.columns, "__n")
    return overlap.overlap_sums(out, variants, "point", ["signal"], names={"n": unused, "sum_signal": "signal_obs"}).drop(unused)


def bin_counts(bins: DataFrame, variants: DataFrame | overlap.Points, weights: list[str] | None = None) -> DataFrame:
    """Random bins with n (and sum_<w>): upstream bins count variant starts, downstream bins variant ends."""
    return overlap.overlap_sums(bins, variants, "up", weights, side=F.when(F.col("side") == "up", "start").otherwise("end"))


def reached(obs: DataFrame, perm: DataFrame, mode: str) -> DataFrame:
    """aid, rows, over and, in mode p, signal_over: how many rows of perm (aid, n and, in mode p, sum_signal; one a permutation) there are, and how many reach the observed values."""
    signal = mode == "p"
    rows = perm.join(obs.select("aid", "n_obs", *(["signal_obs"] if signal else [])).hint("merge"), "aid")
    over = [F.count("*").alias("rows"), F.count_if(F.col("n") >= F.col("n_obs")).alias("over")] + ([F.count_if(F.col("sum_signal") >= F.col("signal_obs")).alias("signal_over")] if signal else [])
    return rows.groupBy("aid").agg(*over)


def shares(obs: DataFrame, counts: DataFrame, n: int, mode: str) -> DataFrame:
    """obs with p and, in mode p, signal_p, of n permutations; those without a row in counts (as of reached) have 0."""
    own = overlap.fresh(obs.columns, "__p")
    out = obs.join(counts.withColumnsRenamed({c: f"{own}{c}" for c in counts.columns if c != "aid"}).hint("merge"), "aid", "left")
    missing = F.lit(n) - F.coalesce(f"{own}rows", F.lit(0))
    share = lambda k, o: (F.coalesce(F.col(f"{own}{k}"), F.lit(0)) + F.when(F.col(o) <= 0, missing).otherwise(0)) / F.lit(n)
    out = out.withColumn("p", share("over", "n_obs"))
    if mode == "p":
        out = out.withColumn("signal_p", share("signal_over", "signal_obs"))
    return out.drop(*(f"{own}{c}" for c in counts.columns if c != "aid"))


def permute_annotations(variants: DataFrame, annotations: DataFrame, blacklist: DataFrame, n: int, dmin: int, dmax: int, mode: str = "n", seed: int = 0) -> DataFrame:
    """annotations with n_obs, p and, by mode, signal_obs (o, p) and signal_p (p). Annotations without room for bins are left out."""
    checked(mode, "signal" in variants.columns)
    v, a, _ = prepare(variants, annotations, blacklist)
    points = overlap.variant_points(v, [] if mode == "n" else ["signal"])
    fits = F.lit(dmax - dmin) - (F.col("end") - F.col("start") + 1) > 0
    # Bins are n times as many as annotations: those are spread first, so that few files don't mean few tasks.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    obs = written(observed(a.where(fits).repartition(tasks, "aid"), points, mode), "observed")
    bins = permute.random_bins(obs.select("aid", "chrom", "start", "end"), n, dmin, dmax, seed)
    return shares(obs, reached(obs, bin_counts(bins, points, ["signal"] if mode == "p" else None), mode), n, mode)


def clean_bins(genome: DataFrame, blacklist: DataFrame, width: int, min_width: int) -> DataFrame:
    """Tiles less the merged blacklist, narrow ones absorbed."""
    if width <= 0 or min_width <= 0:
        raise ValueError("width and min_width must be positive")
    merged = written(intervals.merge(blacklist), "blacklist")
    return written(intervals.absorb(intervals.subtract(intervals.tile(genome, width), merged), min_width), "bins")


def permute_variants(variants: DataFrame, blacklist: DataFrame, genome: DataFrame, seq: DataFrame | Callable[[DataFrame], DataFrame], n: int, width: int, min_width: int, preserve_context: bool = True, k: int = 3, seed: int = 0) -> DataFrame:
    """perm, chrom, start, end and the variants' other columns: each variant at another site of its bin, of its own context, if that is preserved; else at any site of its bin that is no N.

    seq: chrom, chunk_start, bases, or a function that gives them for the bins in use, so that a reader need not read the rest.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    bins = clean_bins(genome, blacklist, width, min_width)
    placed = written(intervals.assign(variants, bins), "placed")
    used = written(placed.select("chrom", F.col("bin_start").alias("start"), F.col("bin_end").alias("end"), F.concat_ws(":", "chrom", "bin_start").alias("grp")).distinct(), "used")
    seq = seq(used) if callable(seq) else seq
    if preserve_context:
        drawn = sites.draw_contexts(placed, sites.segments(seq, used, k), n, k, f"permute{k}", seed)
    else:
        drawn = sites.draw_uniform(placed, sites.runs(seq, used), n, "permute0", seed)
    return _with_extras(drawn, variants)


def _with_extras(drawn: DataFrame, variants: DataFrame) -> DataFrame:
    extras = variants.drop("chrom", "start", "end")
    return drawn.join(extras.hint("merge"), "vid") if len(extras.columns) > 1 else drawn


def covariate_features(bins: DataFrame, covariates: list[DataFrame]) -> DataFrame:
    """bins with rid (their order in the genome from 0) and f0, f1, ...: each covariate's mean over the bin."""
    from pyspark.sql import Window as W

    per = bins.groupBy("ord").count().select("ord", (F.sum("count").over(W.orderBy("ord")) - F.col("count")).alias("before"))  # one row a chromosome
    rid = F.row_number().over(W.partitionBy("ord").orderBy("start")) - 1 + F.col("before")
    out = written(bins.join(F.broadcast(per), "ord").withColumn("rid", rid.cast("long")).drop("before"), "features")
    for i, c in enumerate(covariates):
        out = written(overlap.interval_means(out, c, mean_name=f"f{i}"), "features")  # asked several times by what follows
    return out


def simulate_variants(variants: DataFrame, blacklist: DataFrame, genome: DataFrame, seq: DataFrame | Callable[[DataFrame], DataFrame], covariates: list[DataFrame], n: int, width: int, min_width: int, preserve_context: bool = True, clusters: int = 100, iterations: int = 10, k: int = 3, seed: int = 0) -> DataFrame:
    """Like permute_variants, over all bins of the cluster of bins with like covariates instead of the own bin."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if not covariates:
        raise ValueError("at least one covariate is needed")
    features = [f"f{i}" for i in range(len(covariates))]
    bins = covariate_features(clean_bins(genome, blacklist, width, min_width), covariates)
    members, _ = cluster.kmeans(cluster.zscores(bins, features), features, clusters, iterations)
    laid = written(epoch.lay_out(members.select("cluster", "chrom", "ord", "start", "end")), "laid")
    placed = written(epoch.forward(variants, laid), "placed")
    if not preserve_context:
        return _with_extras(simulate_uniform(placed, laid, n, seed), variants)
    used = written(laid.join(placed.select("cluster").distinct(), "cluster").withColumn("grp", F.col("cluster").cast("string")), "used")
    seq = seq(used) if callable(seq) else seq
    return _with_extras(sites.draw_contexts(placed, sites.segments(seq, used, k), n, k, f"simulate{k}", seed), variants)


def simulate_uniform(placed: DataFrame, laid: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """placed: vid, cluster. A uniform position of the cluster for each variant and permutation: vid, perm, chrom, start, end."""
    total = laid.groupBy("cluster").agg(F.max("hi").alias("total"))
    rows = placed.select("vid", "cluster").join(F.broadcast(total), "cluster").select("vid", "cluster", "total", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm"))
    rows = rows.select("vid", "perm", "cluster", (rng.below(F.col("total"), seed, "simulate0", F.col("vid"), F.col("perm")) + 1).alias("epoch"))
    return epoch.inverse(rows, laid).select("vid", "perm", "chrom", "start", "end")


def score(permuted: DataFrame, signal: DataFrame) -> DataFrame:
    """permuted with score: the signal's mean over each site."""
    return overlap.interval_means(permuted, signal, mean_name="score")


def exceedances(obs: DataFrame, permuted: DataFrame, mode: str = "n") -> DataFrame:
    """As reached, counted from the permuted sites' side: a row for an annotation and a permutation is made only where a site meets the annotation.
    Sites of a permutation that are the same place are one with their number and sum, so pairs follow annotations and places, not annotations times variants.

    obs: aid, chrom, start, end, n_obs (and signal_obs in mode p); permuted: perm, chrom, start, end (and signal).
    """
    summed = [F.count("*").alias("times")] + ([F.sum("signal").alias("signal")] if mode == "p" else [])
    sites = written(permuted.groupBy("perm", "chrom", "start", "end").agg(*summed), "sites")
    hits = overlap.overlap_pairs(obs.select("aid", "chrom", "start", "end"), sites, "closed")
    total = lambda predicate, c: F.coalesce(F.sum(F.when(overlap.condition(predicate, F.col("v_start"), F.col("v_end"), F.col("start"), F.col("end")), F.col(c))), F.lit(0))
    counted = [total("count", "v_times").alias("n")] + ([total("point", "v_signal").alias("sum_signal")] if mode == "p" else [])
    return reached(obs, hits.groupBy("aid", F.col("v_perm").alias("perm")).agg(*counted), mode)


def empirical_pvalues(variants: DataFrame, annotations: DataFrame, blacklist: DataFrame, permuted: DataFrame, mode: str = "n") -> DataFrame:
    """annotations with n_obs, p and by mode signal_obs and signal_p, against permuted sets (perm, chrom, start, end, signal)."""
    checked(mode, "signal" in variants.columns)
    permuted = written(permuted, "permuted")
    n = permuted.agg(F.count_distinct("perm")).first()[0]
    if not n:
        raise ValueError("there is no permutation")
    v, a, _ = prepare(variants, annotations, blacklist)
    obs = written(observed(a, v, mode), "observed")
    return shares(obs, exceedances(obs, permuted, mode), n, mode)
