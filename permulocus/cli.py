"""Command line: permulocus {annotations,variants,simulate,pvalues} ... over tab-separated files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.genome import genome
from .operators import overlap
from .plans import algorithms as alg
from .sources import readers, sinks

VERSION = "1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="permulocus", description=__doc__)
    p.add_argument("-v", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("annotations", "variants", "simulate", "pvalues"):
        s = sub.add_parser(name)
        for x in ("variants", "blacklist", "out"):
            s.add_argument(f"--{x}", required=True)
        s.add_argument("--signal")
        s.add_argument("--seed", type=int, default=0)
        if name in ("annotations", "pvalues"):
            s.add_argument("--annotations", required=True)
            s.add_argument("--mode", choices=alg.MODES, default="n")
        if name != "pvalues":
            s.add_argument("-n", type=int, required=True)
        if name == "annotations":
            s.add_argument("--dmin", type=int, required=True)
            s.add_argument("--dmax", type=int, required=True)
        if name == "pvalues":
            s.add_argument("--permutations", required=True)
        if name in ("variants", "simulate"):
            for x in ("width", "min-width"):
                s.add_argument(f"--{x}", type=int, required=True)
            s.add_argument("--fasta", required=True)
            s.add_argument("--context", choices=("y", "n"), default="y")
        if name == "simulate":
            s.add_argument("--covariate", action="append", required=True)
            s.add_argument("--clusters", type=int, default=100)
    return p


def _scored(rows, path: str | None, spark: SparkSession):
    """rows with signal, the track's mean over each; as they are without a track."""
    if not path:
        return rows
    means = overlap.interval_means(rows, readers.signal(spark, path, rows), mean_name="signal")
    return means.withColumn("signal", F.col("signal").cast("decimal(18,6)"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("permulocus").getOrCreate()
    v, b = readers.variants(spark, a.variants), readers.blacklist(spark, a.blacklist)
    if a.what == "annotations":
        out = alg.permute_annotations(_scored(v, a.signal, spark), readers.annotations(spark, a.annotations), b, a.n, a.dmin, a.dmax, a.mode, a.seed)
        sinks.write_pvalues(out, a.out)
    elif a.what == "pvalues":
        perms = readers.permutations(spark, a.permutations, scored=bool(a.signal)).withColumn("signal", F.col("score").cast("decimal(18,6)")) if a.signal else readers.permutations(spark, a.permutations)
        sinks.write_pvalues(alg.empirical_pvalues(_scored(v, a.signal, spark), readers.annotations(spark, a.annotations), b, perms, a.mode), a.out)
    else:
        shape = (genome(spark), lambda used: readers.fasta(spark, a.fasta, regions=used))
        flat = v.withColumn("extras", F.array_join("extras", "\t"))
        if a.what == "variants":
            moved = alg.permute_variants(flat, b, *shape, a.n, a.width, a.min_width, a.context == "y", seed=a.seed)
        else:
            moved = alg.simulate_variants(flat, b, *shape, [readers.signal(spark, c) for c in a.covariate], a.n, a.width, a.min_width, a.context == "y", a.clusters, seed=a.seed)
        sinks.write_permuted(alg.score(moved, readers.signal(spark, a.signal, moved)) if a.signal else moved, a.out)


if __name__ == "__main__":
    main()
