"""Token identifiers packed into rows of one length by best-fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pieces of the byte-level vocabulary, and its free identifier.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: Tokens that a task packs at once: bounded memory, and some thousand rows to fit pieces into.
BLOCK_TOKENS = 1 << 22

PACKED = "pack_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<int>"


class Tokenizer:
    """Texts to token identifiers, as bytes of little-endian 32-bit integers."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<i4").tobytes() if text else b""


class Capacities:
    """Open rows by their free places: a segment tree of counts over 0 to `most`."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def put(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row of the least free places that suffice, with them; it is no longer open."""
        count, node = self.count, self.width + need
        while not count[node]:  # the next subtree on the right that has a row
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if count[2 * node] else 2 * node + 1
        free = node - self.width
        self._add(free, -1)
        return free, self.rows[free].pop()

    def _add(self, free: int, by: int) -> None:
        node = free + self.width
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of the positions of pieces (each of 1 to length tokens): the largest first, each into the fullest row that has room."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        free, row = open_rows.take(sizes[i]) or (length, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if free > sizes[i]:
            open_rows.put(free - sizes[i], row)
    return rows


def _packed(pieces: list[tuple], length: int, pad: int, first_id: int) -> pa.RecordBatch:
    """Rows for one block; pieces: (doc_id, offset in its document, bytes)."""
    rows = best_fit([len(p[2]) // 4 for p in pieces], length)
    cols: list[list] = [[] for _ in range(8)]
    fill = np.array([pad], "<i4").tobytes()
    count = np.arange(length, dtype="<i4")
    for k, row in enumerate(rows):
        own = [pieces[i] for i in row]
        sizes = [len(p[2]) // 4 for p in own]
        ends = np.cumsum([0, *sizes]).tolist()
        used = ends[-1]
        positions = b"".join(count[:n].tobytes() for n in (*sizes, length - used))
        values = (first_id + k, used, b"".join(p[2] for p in own) + fill * (length - used), positions, ends, ends[:-1], [p[0] for p in own], [p[1] for p in own])
        for c, v in zip(cols, values, strict=True):
            c.append(v)
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def pack_documents(docs: DataFrame, length: int = 2048, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, end: int | None = END, pad: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows: pack_id, n_tokens, ids, position_ids, cu_seqlens, position_resets, doc_ids, doc_offsets.

    ids and position_ids are `length` little-endian 32-bit integers: rows of a matrix. Segment i of a row is
    ids[cu_seqlens[i]:cu_seqlens[i + 1]], the tokens of document doc_ids[i] from its token doc_offsets[i] on; positions begin
    again at 0 at each of position_resets, and in the padding after n_tokens. Each document's tokens, all of
    them, are followed by `end` (None: by nothing) and cut into pieces of `length`, so segments in the order of their offsets
    give the document back. Each task packs its rows block by block, nothing is shuffled; a block has up to
    block_tokens tokens and at least one document.

    Null and empty texts have the end token only (without one, nothing). Repeated rows are packed each; null ids stay null. Other
    columns are ignored. pack_id tells rows apart and counts them within a task. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Path(tokenizers) / vocabulary).read_bytes())
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        tokenizer, tail = Tokenizer(shared.value), b"" if end is None else np.array([end], "<i4").tobytes()
        pieces, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = tokenizer.encode(text.as_py()) + tail
                pieces += [(doc_id, at // 4, ids[at : at + step]) for at in range(0, len(ids), step)]
                held += len(ids) // 4
                if held >= block_tokens:
                    out = _packed(pieces, length, pad, first)
                    first += out.num_rows
                    yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))
                    pieces, held = [], 0
        if pieces:
            out = _packed(pieces, length, pad, first)
            yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))

    return arrow_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PACKED)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet: binary columns are the matrices' rows. What pack_documents makes of null, empty, long and repeated texts is written; an empty table gives a table without rows."""
    pack_documents(docs, **options).write.mode("overwrite").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
