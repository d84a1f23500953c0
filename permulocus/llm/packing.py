"""Operator 9, packing: concatenate and cut.

Pass 1 tokenizes every document once and writes ids with running totals per partition. The partition
totals' prefix sums (one number a partition) give each document its global offset. Pass 2 cuts the one
long stream at multiples of the sequence length; each cut document yields one record a piece. Only the
last sequence can be short, so padding is below one sequence for the whole corpus. No shuffle at all.

Cases: null or empty text is the end id alone; repeated rows are packed each; null ids are carried; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

SEQ_LEN = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a Python worker keeps; then the cache starts anew. About 250 bytes each, held as long as the worker lives, beside whatever runs there later.
CACHE_WORDS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENS = "doc_id long, part int, before long, n long, ids binary"


class WordIds(dict):
    """Word (UTF-8 bytes) -> its token ids as little-endian bytes.

    The tokenizer never joins across white space, so a text's ids are its words' ids in order. Words of
    printable ASCII and Latin-1 letters take a short way: the tokenizer's own model on each piece that
    its pre-tokenizer would cut. All other words, and any with a special token's mark, take its full way.
    """

    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, dtype: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.full, self.dtype, self.most = Tokenizer.from_file(path), dtype, most
        self.model, self.pieces = self.full.model, {}
        spec = str(self.full.normalizer) + str(self.full.pre_tokenizer)
        #: The short way holds for this normalizer and pre-tokenizer only.
        self.short = all(x in spec for x in ("NFC()", "Lowercase()", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel(add_prefix_space=False"))
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        alphabet = {b: chr(b) for b in direct} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(direct))}
        self.spelled = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(161, 256)}

    def piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            if len(self.pieces) >= self.most // 2:
                self.pieces.clear()
            ids = self.pieces[p] = np.array([t.id for t in self.model.tokenize(p.translate(self.spelled))], self.dtype).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        w = word.decode()
        if self.short and "<|" not in w and self.PLAIN.fullmatch(w):
            ids = b"".join(map(self.piece, self.PIECE.findall(w.lower())))
        else:
            ids = np.array(self.full.encode(w, add_special_tokens=False).ids, self.dtype).tobytes()
        self[word] = ids
        return ids


_WORDS: dict[tuple[str, int], WordIds] = {}


def _tokenizer(path: str, dtype: str, most: int) -> WordIds:
    """One cache a Python worker, kept from task to task."""
    if (path, most) not in _WORDS:
        _WORDS[path, most] = WordIds(path, dtype, most)
    return _WORDS[path, most]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Rows (doc_id, part, before, n, ids): ids in 2 bytes each where the vocabulary allows, before: ids of the partition's earlier rows."""
    dtype = "<u2" if max(vocab_size, end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _tokenizer(tokenizer_path, dtype, cache_words), np.array([end_id], dtype).tobytes()
        part, before, width = TaskContext.get().partitionId(), 0, len(end)
        for batch in batches:
            ids = [b"".join(map(words.__getitem__, (t or b"").split())) + end for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    return docs.mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of documents in sequences of seq_len tokens; with_ids adds the ids themselves. cache_words bounds what a worker remembers, no result."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocab = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    path = shared_dir(spark, "packing")
    tokens = tokenize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), tokenizer_path, end_id, vocab, cache_words)
    tokens.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(tokens.schema).parquet(path)
    # One row a partition of pass 1: the prefix sums are as many numbers as that pass had tasks.
    base, total = {}, 0
    for part, n in sorted((r.part, r.n) for r in staged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[part], total = total, total + n
    dtype = "<u2" if max(vocab, end_id + 1) <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            pieces: list[bytes] = []
            for doc, part, before, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                at, ids = base[part] + before, np.frombuffer(ids, dtype).astype("<u4")
                for start, stop in _windows(at, n, seq_len):
                    piece = ids[start:stop].tobytes()
                    rows.append((doc, start, stop - start, zlib.crc32(piece), n, (at + start) // seq_len, (at + start) % seq_len))
                    if with_ids:
                        pieces.append(piece)
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(pieces, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return staged.select("doc_id", "part", "before", "n", "ids").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def _windows(at: int, n: int, seq_len: int) -> Iterator[tuple[int, int]]:
    """A document's pieces: n tokens that begin at global offset at, cut at multiples of seq_len."""
    start = 0
    while start < n:
        stop = min(n, start + seq_len - (at + start) % seq_len)
        yield start, stop
        start = stop


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
