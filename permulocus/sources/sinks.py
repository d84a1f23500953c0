"""Writers of results as tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commit import listed
from .text_files import TextFiles


def _line(*cols: Column) -> Column:
    return F.concat_ws("\t", *cols)


def pvalue_lines(results: DataFrame) -> DataFrame:
    """line: chrom, start, end, name, p and, where there, signal_obs and signal_p."""
    cols = ["chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.format_string("%.6f", "p")]
    if "signal_obs" in results.columns:
        cols.append(F.format_string("%e", F.col("signal_obs").cast("double")))
    if "signal_p" in results.columns:
        cols.append(F.format_string("%.6f", "signal_p"))
    return results.select(_line(*cols).alias("line"))


def write_pvalues(results: DataFrame, path: str) -> None:
    from ..functions.genome import order_of

    pvalue_lines(results.orderBy(order_of(F.col("chrom")), "start", "end", "name")).write.text(path)


def write_permuted(permuted: DataFrame, path: str, ordered: bool = True) -> None:
    """One sorted file a permutation (perm=1/part-1.txt, ...): chrom, start, end, score if there, other columns. All files appear at once, when every task has ended.

    ordered=False leaves a file's lines as they come. A folder that holds files raises ValueError.
    """
    from ..functions.genome import order_of

    rest = [c for c in permuted.columns if c not in ("perm", "vid", "chrom", "start", "end", "score")]
    score = [F.format_string("%e", "score")] if "score" in permuted.columns else []
    line = _line("chrom", F.col("start").cast("string"), F.col("end").cast("string"), *score, *(F.col(f"`{c}`").cast("string") for c in rest))
    place = [order_of(F.col("chrom")), F.col("start"), F.col("end")] if ordered else []
    file = F.format_string("perm=%d/part-%d.txt", F.col("perm").cast("int"), F.col("perm").cast("int"))
    _write_files(permuted.where("perm IS NOT NULL").select(file.alias("file"), line.alias("line"), *(c.alias(f"at{i}") for i, c in enumerate([*place, line]))), path)


def write_fasta(seq: DataFrame, path: str, width: int = 50) -> None:
    """{path}/{chrom}.fa from chunks (chrom, chunk_start, bases): a header, then lines of width bases; a chunk's last line may be shorter."""
    at = F.posexplode(F.sequence(F.lit(1), F.greatest(F.char_length("bases"), F.lit(1)), F.lit(width)))
    lines = seq.select("chrom", "chunk_start", "bases", at.alias("i", "from")).select("chrom", "chunk_start", "i", F.expr(f"substring(bases, `from`, {width})").alias("line"))
    heads = seq.select("chrom").distinct().select("chrom", F.lit(0).cast("long").alias("chunk_start"), F.lit(0).alias("i"), F.concat(F.lit(">"), "chrom").alias("line"))
    _write_files(heads.unionByName(lines).select(F.concat("chrom", F.lit(".fa")).alias("file"), "line", F.col("chunk_start").alias("at0"), F.col("i").alias("at1")), path)


def _write_files(rows: DataFrame, path: str) -> None:
    """rows: file, line and the columns they are sorted by."""
    if listed(path, deep=True):
        raise ValueError(f"{path} holds files")
    rows.sparkSession.dataSource.register(TextFiles)
    dealt = rows.repartition("file").sortWithinPartitions("file", *(c for c in rows.columns if c not in ("file", "line")))
    dealt.select("file", "line").write.format("text_files").mode("append").save(path)
