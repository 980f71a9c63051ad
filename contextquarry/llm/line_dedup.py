"""Line deduplication: the first document keeps a line, and others get bitmaps of what they keep."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize
from contextquarry.llm.firsts import later_rows
from contextquarry.session import spread

#: Code points that a line's key has at least.
LEAST = 10
SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a missing id, which is greater than any other.
NO_ID = (1 << 63) - 1


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least)


def _keys(least: int):
    """_id, _h and the lists k1, k2 and at: the keys of a text's lines, 128 bits each, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            digests, at, ends = [], [], [0]
            for text in batch.column("text"):
                for i, line in enumerate(text.as_py().split(b"\n")):
                    if len(line) < least:
                        continue
                    digest = seen.get(line)
                    if digest is None:
                        key = line.strip(SPACE).lower()  # of bytes, so A-Z only
                        digest = xxhash.xxh3_128_digest(key) if _long_enough(key, least) else b""
                        if len(seen) >= 20_000:
                            seen.clear()
                        if len(line) < 1000:
                            seen[line] = digest
                    if digest:
                        digests.append(digest)
                        at.append(i)
                ends.append(len(at))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), np.array(at, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), *lists], names=["_id", "_h", "k1", "k2", "at"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_lines, n_dropped, keep, and the text's kept lines, from text and the list of dropped places (may be null)."""
    for batch in batches:
        total, gone, keep, kept = [], [], [], []
        for text, drop in zip(batch.column("text"), batch.column("dropped").to_pylist(), strict=True):
            body = text.as_py() or b""
            n = body.count(b"\n") + 1
            mask = np.ones(n, bool)
            if drop:
                mask[drop] = False
                body = b"\n".join(line for line, k in zip(body.split(b"\n"), mask.tolist(), strict=True) if k)
            total.append(n)
            gone.append(n - int(mask.sum()))
            keep.append(zlib.compress(np.packbits(mask, bitorder="little").tobytes()))
            kept.append(hashlib.sha256(body).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(keep, pa.binary()), pa.array(kept)], names=["doc_id", "n_lines", "n_dropped", "keep", "kept_sha256"]
        )


def kept_lines(text: str | None, keep: bytes) -> str:
    """A text without the lines whose bit isn't set: what keep says of it."""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    return "\n".join(line for line, b in zip(lines, bits, strict=True) if b)


def line_dedup(docs: DataFrame, least: int = LEAST, partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, keep, kept_sha256.

    keep: one bit per line, least bit first, in bytes that zlib has compressed; kept_lines applies it. kept_sha256: of the kept lines, joined by \\n.

    Texts are split at \\n. A line's key is the line without ASCII white space at its ends, with A-Z in small letters. Keys of at least `least` code points lose all their lines except in
    the document of the least id. Hashes of 128 bits stand for keys; they are range-partitioned with a secondary sort by document and place, so a line of
    any number of documents spreads over tasks, and each partition streams past the first holder of each key.

    Rows of one id are one document, and each keeps its lines. A null id is greater than any other; such rows are documents of their own, by their texts. Null and empty texts are one empty line, and so
    keep it. Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("text"))
    fields = "_id long, _h long, k1 array<long>, k2 array<long>, at array<int>"
    keys = arrow_batches(spread(rows.where("text <> X''"))).mapInArrow(_keys(least), fields)
    keys = materialize(keys.where(F.size("at") > 0), "line-keys")
    lines = keys.select("_id", "_h", F.explode(F.arrays_zip("k1", "k2", "at")).alias("l")).select(
        "_id", "_h", "l.*", F.coalesce("_id", F.lit(NO_ID)).alias("a"), F.when(F.col("_id").isNull(), F.col("_h")).otherwise(F.lit(0)).cast("long").alias("b")
    )
    dropped = later_rows(lines, partitions).groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(F.collect_set("at").alias("dropped"))
    # the lists are hashed, so that texts stream past them and no task sorts texts
    marked = rows.join(dropped.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    marked = marked.select(F.col("_id").alias("doc_id"), "text", "dropped")
    return arrow_batches(marked).mapInArrow(_bitmaps, "doc_id long, n_lines long, n_dropped long, keep binary, kept_sha256 string")


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("keep")


OP13_SQL = rf"""
WITH lines AS (
  SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
judged AS (SELECT *, length(key) >= {LEAST} AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM lines)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
