"""bigWig tracks as a Spark data source, for reading and writing.

The format, as published: a header; a B+ tree of chromosome names; blocks of values, mostly deflated; an R-tree over the blocks, whose leaves
say what each covers and where it lies. Reading takes the index apart on the driver only so far that there are enough subtrees for the
tasks; a task walks its own subtrees and inflates only blocks that asked regions touch. Files are opened in byte ranges, through the file system of their
address (local folders that all share, or any that Arrow knows), and never read whole.

Writing makes one file a task, each a track of its own over the task's rows in order, under a temporary name that the commit takes
away; a failed or lost task leaves nothing. Values are 32-bit floats, as the format has them.
"""

from __future__ import annotations

import json
import posixpath
import struct
import tempfile
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.intervals import merge
from .commit import Files, FolderWriter, listed, opened, own

# Fixed values of the format: magic numbers of the file, its tree of names and its index; kinds of blocks.
MAGIC, NAMES_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3

SCHEMA = "chrom string, start long, end long, value double"
BLOCKS_SCHEMA = "file string, chrom string, start long, end long, offset long, size long, items long"
#: Asked regions are told to tasks as runs of bins so wide, so what is told is bounded by the genome and not by the regions.
BIN = 1 << 16
#: Subtrees of all files' indexes that tasks share, about; values in a written block; entries in an index node.
SUBTREES, BLOCK_ITEMS, NODE_ITEMS = 256, 1024, 256


def _files(path: str) -> list[str]:
    """The track's files: itself, or those of a folder that don't begin with _ or a dot. ValueError where none is there."""
    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"{path} does not exist")
    if info.type == fs.FileType.File:
        return [path]
    if not (names := [posixpath.basename(x) for x in listed(path) if own(x)]):
        raise ValueError(f"{path} is empty")
    return [f"{path.rstrip('/')}/{n}" for n in names]


class Block(NamedTuple):
    """What an index entry says: from (chromosome, base) to (chromosome, base), and where the block or node lies."""

    first: tuple[int, int]
    last: tuple[int, int]
    offset: int
    size: int


class Track:
    """One open file."""

    def __init__(self, path: str):
        system, inside = opened(path)
        self.file = system.open_input_file(inside)
        head = self._at(0, 64)
        if len(head) < 64:
            raise ValueError(f"{path} is no bigWig file")
        self.order = next((o for o in "<>" if struct.unpack(f"{o}I", head[:4])[0] == MAGIC), None)
        if not self.order:
            raise ValueError(f"{path} is no bigWig file")
        names, _, self.index, *_, self.inflated, _ = self._unpack("4xHHQQQHHQQIQ", head)[2:]
        self.names = dict(self._names(names))
        magic, *_ = self._unpack("I", self._at(self.index, 4))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path} has no index")

    def _unpack(self, layout: str, data: bytes) -> tuple:
        return struct.unpack(self.order + layout, data)

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def _names(self, offset: int) -> Iterator[tuple[int, str]]:
        magic, _, key, _, n, _ = self._unpack("IIIIQQ", self._at(offset, 32))
        if magic != NAMES_MAGIC:
            raise ValueError("the tree of names is damaged")
        nodes = [offset + 32] if n else []
        while nodes:
            at = nodes.pop()
            leaf, count = self._unpack("BxH", self._at(at, 4))
            rows = self._at(at + 4, count * (key + 8))
            for i in range(0, len(rows), key + 8):
                name = rows[i : i + key].rstrip(b"\0").decode()
                if leaf:
                    yield self._unpack("II", rows[i + key : i + key + 8])[0], name
                else:
                    nodes.append(self._unpack("Q", rows[i + key : i + key + 8])[0])

    def node(self, offset: int) -> tuple[bool, list[Block]]:
        """Whether it is a leaf, and its entries."""
        leaf, count = self._unpack("BxH", self._at(offset, 4))
        width, layout = (32, "IIIIQQ") if leaf else (24, "IIIIQ")
        rows = self._at(offset + 4, count * width)
        parts = (self._unpack(layout, rows[i : i + width]) for i in range(0, len(rows), width))
        return bool(leaf), [Block(p[0:2], p[2:4], p[4], p[5] if leaf else 0) for p in parts]

    def root(self) -> int:
        return self.index + 48

    def values(self, block: Block) -> tuple[str, list[int], list[int], list[float]]:
        """A block's chromosome, starts, ends and values."""
        data = self._at(block.offset, block.size)
        data = zlib.decompress(data) if self.inflated else data
        chrom, begin, _, step, span, kind, count = self._unpack("IIIIIBxH", data[:24])
        if kind == BED_GRAPH:
            flat = self._unpack("IIf" * count, data[24 : 24 + 12 * count])
            starts, ends, values = flat[0::3], flat[1::3], flat[2::3]
        elif kind == VARIABLE_STEP:
            flat = self._unpack("If" * count, data[24 : 24 + 8 * count])
            starts, values = flat[0::2], flat[1::2]
            ends = [s + span for s in starts]
        elif kind == FIXED_STEP:
            values = self._unpack("f" * count, data[24 : 24 + 4 * count])
            starts = range(begin, begin + step * count, step) if step else [begin] * count
            ends = [s + span for s in starts]
        else:
            raise ValueError(f"a block of the unknown kind {kind}")
        return self.names[chrom], list(starts), list(ends), list(values)


class Asked:
    """Regions as sorted, disjoint runs [from, to) a chromosome; None: everything."""

    def __init__(self, runs: dict[str, list[list[int]]] | None):
        self.runs = runs

    def touches(self, block: Block, names: dict[int, str]) -> bool:
        if self.runs is None:
            return True
        if block.first[0] != block.last[0]:  # a node over several chromosomes: any run that they have
            return any(self.runs.get(names.get(c)) for c in range(block.first[0], block.last[0] + 1))
        runs = self.runs.get(names.get(block.first[0]), [])
        i = bisect_right(runs, [block.last[1], 1 << 62]) - 1
        return i >= 0 and runs[i][1] > block.first[1]

    def keeps(self, chrom: str, start: int, end: int) -> bool:
        if self.runs is None:
            return True
        runs = self.runs.get(chrom, [])
        i = bisect_left(runs, [end + 1]) - 1
        return i >= 0 and runs[i][1] > start


class Subtrees(InputPartition):
    def __init__(self, file: str, roots: list[int]):
        super().__init__(None)
        self.file, self.roots = file, roots


class BigWigReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only_blocks = options.get("path", ""), options.get("rows", "values") == "blocks"
        self.asked, self.subtrees = Asked(json.loads(options["runs"]) if "runs" in options else None), int(options.get("subtrees", SUBTREES))

    def partitions(self) -> list[InputPartition]:
        files = _files(self.path)
        each, out = max(1, self.subtrees // len(files)), []
        for file in files:
            track = Track(file)
            level, deeper = [track.root()], True
            while level and deeper and len(level) < each:
                level, deeper = self._below(track, level)
            size = -(-len(level) // each) or 1
            out += [Subtrees(file, level[i : i + size]) for i in range(0, len(level), size)]
        return out or [Subtrees(files[0], [])]  # none at all would be read as one without a place

    def _below(self, track: Track, level: list[int]) -> tuple[list[int], bool]:
        """The next level's touched nodes; the same level where it holds leaves."""
        nodes = [track.node(at) for at in level]
        if any(leaf for leaf, _ in nodes):
            return level, False
        return [b.offset for _, entries in nodes for b in entries if self.asked.touches(b, track.names)], True

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        track, nodes = Track(partition.file), partition.roots[::-1]
        while nodes:
            leaf, entries = track.node(nodes.pop())
            touched = [b for b in entries if self.asked.touches(b, track.names)]
            if not leaf:
                nodes += [b.offset for b in touched[::-1]]
                continue
            for b in touched:
                chrom, *cols = track.values(b)
                if self.only_blocks:
                    yield pa.RecordBatch.from_pylist([{"file": partition.file, "chrom": chrom, "start": b.first[1], "end": b.last[1], "offset": b.offset, "size": b.size, "items": len(cols[0])}])
                    continue
                kept = [(chrom, *x) for x in zip(*cols, strict=True) if self.asked.keeps(chrom, x[0], x[1])]
                if kept:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], ["chrom", "start", "end", "value"])


class BigWigWriter(FolderWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.items, self.node_items = int(options.get("items", BLOCK_ITEMS)), int(options.get("nodeItems", NODE_ITEMS))

    def write(self, iterator: Iterator) -> Files:
        with tempfile.TemporaryFile() as spool:  # this task's own blocks, until what stands before them is known
            blocks, names = spooled(spool, iterator, self.items)
            if not blocks:
                return Files([])
            system, temporary = self.temporary()
            with system.open_output_stream(temporary) as out:
                assembled(out, spool, blocks, names, self.items, self.node_items)
        return Files([(temporary, f"{uuid.uuid4().hex}.bw")])


def spooled(spool: BinaryIO, rows: Iterator, items: int = BLOCK_ITEMS) -> tuple[list[Block], list[str]]:
    """Deflated blocks of rows (chrom, start, end, value), which come in order, put one after another; their entries, offsets from 0, and the names in order."""
    names: list[str] = []
    blocks: list[Block] = []
    now: list[tuple[int, int, float]] = []
    last, at = None, 0

    def close() -> int:
        if not now:
            return at
        chrom, low, high = len(names) - 1, now[0][0], max(r[1] for r in now)
        head = struct.pack("<IIIIIBBH", chrom, low, high, 0, 0, BED_GRAPH, 0, len(now))
        data = zlib.compress(head + b"".join(struct.pack("<IIf", *r) for r in now))
        blocks.append(Block((chrom, low), (chrom, high), at, len(data)))
        spool.write(data)
        now.clear()
        return at + len(data)

    for chrom, start, end, value in rows:
        if last is not None and (chrom, start) < last:
            raise ValueError(f"rows are not in order at {chrom}:{start}")
        if not 0 <= start <= end < 1 << 32:
            raise ValueError(f"not an interval of the format: {chrom}:{start}-{end}")
        if not names or names[-1] != chrom or len(now) == items:
            at = close()
        if not names or names[-1] != chrom:
            names.append(chrom)
        now.append((start, end, float(value)))
        last = (chrom, start)
    close()
    return blocks, names


def assembled(out: BinaryIO, spool: BinaryIO, blocks: list[Block], names: list[str], items: int, node_items: int) -> None:
    """The file, front to back: header, blocks, names, index."""
    data_at = 64
    tree_at = data_at + 8 + blocks[-1].offset + blocks[-1].size
    tree = _names_tree(names, blocks)
    index_at = tree_at + len(tree)
    out.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, 24 + 12 * items, 0))
    out.write(struct.pack("<Q", len(blocks)))
    spool.seek(0)
    while part := spool.read(1 << 20):
        out.write(part)
    out.write(tree)
    for part in _index([b._replace(offset=b.offset + data_at + 8) for b in blocks], index_at, items, node_items):
        out.write(part)


def _names_tree(names: list[str], blocks: list[Block]) -> bytes:
    """One leaf with all names, and for each the end of its last value as its length."""
    size, key = [0] * len(names), max(len(n.encode()) for n in names)
    for b in blocks:
        size[b.last[0]] = max(size[b.last[0]], b.last[1])
    rows = b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", i, size[i]) for i, n in enumerate(names))
    return struct.pack("<IIIIQQ", NAMES_MAGIC, len(names), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names)) + rows


def _index(blocks: list[Block], at: int, items: int, node_items: int) -> Iterator[bytes]:
    """The R-tree, level by level from the root; a level's nodes hold the next one's in order."""
    levels = [[blocks[i : i + node_items] for i in range(0, len(blocks), node_items)]]
    while len(levels[0]) > 1:
        over = [Block(min(b.first for b in node), max(b.last for b in node), 0, 0) for node in levels[0]]
        levels.insert(0, [over[i : i + node_items] for i in range(0, len(over), node_items)])
    places, offset = [], at + 48
    for depth, level in enumerate(levels):
        width, here = 32 if depth == len(levels) - 1 else 24, []
        for node in level:
            here.append(offset)
            offset += 4 + width * len(node)
        places.append(here)
    first, last = min(b.first for b in blocks), max(b.last for b in blocks)
    yield struct.pack("<IIQIIIIQII", INDEX_MAGIC, node_items, len(blocks), *first, *last, at, items, 0)
    for depth, level in enumerate(levels):
        leaf, child = depth == len(levels) - 1, iter(() if depth == len(levels) - 1 else places[depth + 1])
        for node in level:
            rows = (struct.pack("<IIIIQQ", *b.first, *b.last, b.offset, b.size) if leaf else struct.pack("<IIIIQ", *b.first, *b.last, next(child)) for b in node)
            yield struct.pack("<BBH", leaf, 0, len(node)) + b"".join(rows)


class BigWig(DataSource):
    """Format bigwig. Options for reading: runs (asked regions, JSON), subtrees, rows=blocks (one row an inflated block in place of its values); for writing: items, nodeItems."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return BLOCKS_SCHEMA if self.options.get("rows") == "blocks" else SCHEMA

    def reader(self, schema: StructType) -> BigWigReader:
        return BigWigReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BigWigWriter:
        if schema.fieldNames() != ["chrom", "start", "end", "value"]:
            raise ValueError("a track has the columns chrom, start, end, value")
        return BigWigWriter(self.options, overwrite)


def runs_of(regions: DataFrame) -> dict[str, list[list[int]]]:
    """What regions (chrom, start, end) touch, as runs of bins: as many numbers as the genome has bins at most."""
    bins = regions.where("chrom IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL").select("chrom", F.floor(F.col("start") / BIN).alias("start"), (F.floor(F.col("end") / BIN) + 1).alias("end"))
    out: dict[str, list[list[int]]] = {}
    for r in merge(bins.distinct()).collect():
        out.setdefault(r.chrom, []).append([r.start * BIN, r.end * BIN])
    return {c: sorted(v) for c, v in out.items()}


def read(spark: SparkSession, path: str, regions: DataFrame | None = None, rows: str = "values", subtrees: int = SUBTREES) -> DataFrame:
    """chrom, start, end, value of a file or folder, where regions are given with no blocks that they don't touch; rows=blocks: the blocks read."""
    _files(path)
    spark.dataSource.register(BigWig)
    reader = spark.read.format("bigwig").option("rows", rows).option("subtrees", subtrees)
    if regions is not None:
        runs = runs_of(regions)
        reader = reader.option("runs", json.dumps(runs | ({"chrMT": runs["chrM"]} if "chrM" in runs else {})))
    return reader.load(path)


def write(track: DataFrame, path: str, items: int = BLOCK_ITEMS, node_items: int = NODE_ITEMS, files: int | None = None) -> None:
    """track (chrom, start, end, value) as a folder of files, one a range of it: so many files, or as many as Spark finds right."""
    track.sparkSession.dataSource.register(BigWig)
    rows = track.select("chrom", F.col("start").cast("long"), F.col("end").cast("long"), F.col("value").cast("double")).where("chrom IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL AND value IS NOT NULL")
    dealt = rows.repartitionByRange(*([files] if files else []), "chrom", "start", "end").sortWithinPartitions("chrom", "start", "end")
    dealt.write.format("bigwig").mode("append").option("items", items).option("nodeItems", node_items).save(path)
