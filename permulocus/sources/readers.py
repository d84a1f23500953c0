"""Readers of tab-separated interval files, FASTA folders and permutation folders.

Rows on other than standard chromosomes are left out, chrMT is read as chrM, and numbers that are none become null
and their rows are left out. A missing or empty input raises ValueError.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.genome import canonical, is_standard
from ..functions.staging import written
from . import bigwig, fasta_ranges
from .commit import listed, opened


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = _found(_read(lambda: spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block")), path), path)
    return lines.select("value", "file_path", "block", F.split(F.rtrim("value"), "\t").alias("f"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (value, file_path, block, ...) with an id: the line's hash and its number among equal lines. Numbers go by blocks of files and offsets, so a line that is
    very often there is no single task's. Lines are dealt and sorted by hashes of themselves and of their blocks, not by long texts and paths; where two clash, a number is left out."""
    rows = rows.withColumns({"line": F.xxhash64("value"), "place": F.xxhash64("file_path", "block")}).drop("file_path", "block")
    here = ["line", "place"]
    per_block = rows.groupBy(*here).agg(F.count("*").alias("n"))
    earlier = W.partitionBy("line").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(*here, F.sum("n").over(earlier).alias("before")).where("before > 0")
    own = F.row_number().over(W.partitionBy(*here).orderBy("value"))
    number = (F.col("own") + F.coalesce("before", F.lit(0))).cast("int")
    return rows.withColumn("own", own).join(offsets, here, "left").withColumn(name, F.xxhash64("value", number))


def _interval(lines: DataFrame, *more) -> DataFrame:
    """chrom, start, end and more. Fields come from a generator of one row, below which Spark moves no filter: there it would split each line anew for each condition."""
    at = lambda i: F.get("f", F.lit(i))
    fields = F.struct(canonical(at(0)).alias("chrom"), at(1).try_cast("long").alias("start"), at(2).try_cast("long").alias("end"), *more)
    return lines.select(F.inline(F.array(fields))).where(is_standard(F.col("chrom")) & F.col("start").isNotNull() & F.col("end").isNotNull())


def variants(spark: SparkSession, path: str) -> DataFrame:
    """vid, chrom, start, end, extras (all further columns). vid is a row's hash and its number among equal rows."""
    rows = _interval(_lines(spark, path), F.slice("f", 4, 1 << 20).alias("extras"), "value", "file_path", "block")
    return _numbered(rows, "vid").select("vid", "chrom", "start", "end", "extras")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """aid, chrom, start, end, name."""
    rows = _interval(_lines(spark, path), F.get("f", F.lit(3)).alias("name"), "value", "file_path", "block")
    return _numbered(rows, "aid").select("aid", "chrom", "start", "end", "name")


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    return _interval(_lines(spark, path))


def signal(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """A track, bigWig by its ending (.bw, .bigWig, or a folder of such a name), else bedGraph: chrom, start, end, value. regions: where values are asked, if not everywhere."""
    if path.rstrip("/").lower().endswith((".bw", ".bigwig")):
        rows = bigwig.read(spark, path, regions).withColumn("chrom", canonical(F.col("chrom"))).where(is_standard(F.col("chrom")))
        return rows.withColumn("value", F.col("value").cast("decimal(18,6)"))
    return _interval(_lines(spark, path), F.get("f", F.lit(3)).try_cast("decimal(18,6)").alias("value")).where("value IS NOT NULL")


def _found(df: DataFrame, path: str) -> DataFrame:
    """df, or ValueError where nothing is there."""
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def _read(read, path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"{path} does not exist") from e


def _fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """Written: file_path, block (of the file, where Spark split it), i (order in it), header, n (bases, white space left out), b, and the line's bytes, its end as one."""
    text = _read(lambda: spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block")), path)
    lines = written(_found(text, path).withColumn("i", F.monotonically_increasing_id()), "fasta")
    first = (F.col("block") == 0) & (F.row_number().over(W.partitionBy("file_path", "block").orderBy("i")) == 1)
    bases = F.regexp_replace("value", r"\s+", "")
    return lines.select("file_path", "block", "i", first.alias("header"), bases.alias("b"), F.char_length(bases).cast("long").alias("n"), (F.octet_length("value") + 1).alias("bytes"))


def index_fasta(spark: SparkSession, folder: str) -> list[str]:
    """Writes {name}.fa.fai beside each {folder}/{name}.fa whose lines are of one length, the last aside, and end in one byte; gives those names. One pass over the files."""
    rows = fasta_ranges.index_rows(_fasta_lines(spark, f"{folder}/*.fa")).collect()  # one row a file
    system, inside = opened(folder)
    done = []
    for r in rows:
        name = r.file_path.rsplit("/", 1)[-1].removesuffix(".fa")
        size = system.get_file_info(f"{inside}/{name}.fa").size
        ends = r.length + -(-r.length // r.width)  # one byte ends each line; the last one's may be missing
        if r.bytes == r.width + 1 and size - r.offset in (ends, ends - 1):
            with system.open_output_stream(f"{inside}/{name}.fa.fai") as out:
                out.write(f"{name}\t{r.length}\t{r.offset}\t{r.width}\t{r.bytes}\n".encode())
            done.append(name)
    return sorted(done)


def fasta(spark: SparkSession, folder: str, chunk: int = 1 << 16, regions: DataFrame | None = None) -> DataFrame:
    """chrom, chunk_start, bases from {folder}/{chrom}.fa, one header line each; white space is dropped.

    regions (chrom, start, end): only the sequence near these is needed. Of files with an index (see index_fasta) only its byte ranges are read then; others are read whole.
    Whole files are read by lines and split as Spark splits text, so no chromosome is one row or one task: a line's position is the number of bases before
    it in its block of the file, plus those of earlier blocks. A chunk is the lines that begin in one range of chunk positions, so its length varies by a line.
    """
    if regions is None:
        return _whole_fasta(spark, f"{folder}/*.fa", chunk)
    runs = fasta_ranges.asked_runs(regions)
    known = {n: "chrM" if n == "chrMT" else n for n in fasta_ranges.indexes(folder)}
    by_range = {n: runs[c] for n, c in known.items() if c in runs}
    files = {x.rsplit("/", 1)[-1].removesuffix(".fa") for x in listed(folder) if x.endswith(".fa")}
    whole = [n for n in sorted(files - set(by_range)) if ("chrM" if n == "chrMT" else n) in runs]
    parts = [fasta_ranges.read(spark, folder, by_range).withColumn("chrom", canonical(F.col("chrom")))] if by_range or not whole else []
    if whole:
        parts.append(_whole_fasta(spark, [f"{folder}/{n}.fa" for n in whole], chunk))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _whole_fasta(spark: SparkSession, path: str | list[str], chunk: int) -> DataFrame:
    bases = _fasta_lines(spark, path).where("NOT header")
    in_block = W.partitionBy("file_path", "block").orderBy("i")
    by_file = W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = bases.groupBy("file_path", "block").agg(F.sum("n").alias("size")).select("file_path", "block", F.coalesce(F.sum("size").over(by_file), F.lit(0)).alias("before"))
    at = bases.withColumn("in", F.sum("n").over(in_block) - F.col("n")).join(blocks, ["file_path", "block"]).withColumn("at", F.col("before") + F.col("in")).where("n > 0")
    name = F.regexp_extract("file_path", r"([^/]+)\.fa$", 1)
    at = at.withColumn("chrom", name).where(is_standard(F.col("chrom"))).withColumn("chrom", canonical(F.col("chrom")))
    cut = at.groupBy("chrom", F.floor(F.col("at") / chunk).alias("c")).agg(F.sort_array(F.collect_list(F.struct("at", "b"))).alias("l"))
    return cut.select("chrom", (F.get("l", F.lit(0))["at"] + 1).alias("chunk_start"), F.array_join(F.col("l.b"), "").alias("bases"))


def permutations(spark: SparkSession, folder: str, scored: bool = False) -> DataFrame:
    """perm, chrom, start, end and score or extras from folders perm=1, perm=2, ..."""
    text = _read(lambda: spark.read.text(folder), folder)
    if "perm" not in text.columns:
        raise ValueError(f"{folder} has no permutation")
    lines = _found(text, folder).select(F.col("perm").cast("int").alias("perm"), F.split("value", "\t").alias("f"))
    more = F.get("f", F.lit(3)).try_cast("double").alias("score") if scored else F.slice("f", 4, 1 << 20).alias("extras")
    return _interval(lines, "perm", more)
