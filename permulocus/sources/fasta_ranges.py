"""Parts of indexed FASTA files as a Spark data source.

An index line says how long a sequence is, where its first base lies, and how many bases and bytes a line has, as the common .fai files beside
FASTA files do; lines of unequal length have no such index. With it, a position is arithmetic, so a task reads the byte ranges of its chunks and no others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bigwig import BIN, runs_of
from .commit import listed, opened

#: Bases around regions that contexts may need; tasks over all files, about.
FLANK, TASKS = 64, 256
_CHUNKS = "chrom string, chunk_start long, bases string"
_RANGES = "chrom string, chunk_start long, offset long, size long"


class Lines(NamedTuple):
    """A file's .fai line, without the name: bases, offset of the first, bases and bytes a line."""

    length: int
    offset: int
    width: int
    bytes: int

    def at(self, position: int) -> int:
        """Where the base at position (from 0) lies."""
        return self.offset + position // self.width * self.bytes + position % self.width


def indexes(folder: str) -> dict[str, Lines]:
    """Of the files {name}.fa that have an index {name}.fa.fai of one line."""
    system, _ = opened(folder)
    out = {}
    for file in listed(folder):
        if file.endswith(".fa.fai"):
            with system.open_input_file(file) as f:
                rows = [x.split("\t") for x in f.read().decode().splitlines() if x]
            if len(rows) == 1 and len(rows[0]) == 5:
                out[file.rsplit("/", 1)[-1].removesuffix(".fa.fai")] = Lines(*map(int, rows[0][1:]))
    return out


class Ranges(InputPartition):
    def __init__(self, chunks: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.chunks = chunks


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.runs, self.only_ranges = options["path"], json.loads(options["runs"]), options.get("rows") == "ranges"

    def partitions(self) -> list[InputPartition]:
        known, chunks = indexes(self.folder), []
        for chrom, runs in self.runs.items():
            lines = known[chrom]
            for begin, end in runs:
                for start in range(max(begin, 0), min(end, lines.length), BIN):
                    stop = min(start + BIN, end, lines.length)
                    chunks.append((chrom, start, lines.at(start), lines.at(stop - 1) + 1 - lines.at(start)))
        size = -(-len(chunks) // TASKS) or 1
        return [Ranges(chunks[i : i + size]) for i in range(0, len(chunks), size)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, inside = opened(self.folder)
        for chrom, start, offset, size in partition.chunks:
            if self.only_ranges:
                yield pa.RecordBatch.from_pylist([{"chrom": chrom, "chunk_start": start + 1, "offset": offset, "size": size}])
                continue
            with system.open_input_file(f"{inside}/{chrom}.fa") as f:
                bases = b"".join(f.read_at(size, offset).split()).decode()
            yield pa.RecordBatch.from_arrays([pa.array([chrom]), pa.array([start + 1]), pa.array([bases])], ["chrom", "chunk_start", "bases"])


class FastaRanges(DataSource):
    """Format fasta_ranges. Options: runs (asked positions from 0, JSON), rows=ranges (one row a byte range in place of its bases)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return _RANGES if self.options.get("rows") == "ranges" else _CHUNKS

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def asked_runs(regions: DataFrame) -> dict[str, list[list[int]]]:
    """What regions and their flanks touch, as runs of chunks."""
    return runs_of(regions.select("chrom", (F.col("start") - FLANK).alias("start"), (F.col("end") + FLANK).alias("end")))


def read(spark: SparkSession, folder: str, runs: dict[str, list[list[int]]], rows: str = "bases") -> DataFrame:
    """chrom, chunk_start, bases of the chunks in runs; names are those of files, which must have an index."""
    spark.dataSource.register(FastaRanges)
    return spark.read.format("fasta_ranges").option("runs", json.dumps(runs)).option("rows", rows).load(folder)


def index_rows(lines: DataFrame) -> DataFrame:
    """file_path and an index for files whose lines are all of one length but the last. lines: file_path, block, i (order in the block), header, n (bases), bytes."""
    by_file = lines.groupBy("file_path").agg(
        F.sum(F.when(F.col("header"), F.col("bytes"))).alias("offset"),
        F.sum(F.when(~F.col("header"), F.col("n"))).alias("length"),
        F.max(F.when(~F.col("header"), F.col("n"))).alias("width"),
        F.max(F.when(~F.col("header"), F.col("bytes"))).alias("bytes"),
        F.max(F.when(~F.col("header"), F.struct("block", "i"))).alias("last"),
    )
    each = lines.where("NOT header").join(by_file, "file_path").where((lines["n"] < by_file["width"]) & (F.struct("block", "i") != F.col("last")))
    return by_file.join(each.select("file_path").distinct(), "file_path", "left_anti").where("width > 0").select("file_path", "length", "offset", "width", "bytes")
