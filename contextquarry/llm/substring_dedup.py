"""Substring deduplication: repeated windows of words, found by FM-indexes of routed segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize
from contextquarry.llm.fm_index import FMIndex
from contextquarry.llm.rolling import bytes_of, mix, range_hashes, runs_of, window_minima, words_of

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8
#: Windows of a segment at most: bits of its mask.
RUN = 28
#: Words of an index, about: some 100 MB while it is built.
SHARD_WORDS = 250_000
#: Different segments of an anchor at least, and parts of all segments, for the anchor to be hot: so there are at most PARTS hot ones.
HOT, PARTS = 4096, 1_000_000

#: Bytes of texts that are cut into segments at once.
_PART = 8_000_000

SEGMENTS = "anchor array<long>, seg array<long>, start array<int>, n array<int>, many array<int>"


class Segments:
    """The segments of a batch of texts: text (its place in the batch), anchor, seg, start, n and many, one entry per segment.

    The anchor of a window is the least hash of ANCHOR consecutive words in it, so equal windows have equal anchors. A segment is a
    run of n <= RUN windows of one anchor that begins at word start of its text; seg is the hash of its words; many is 2 if its anchor is in the text more than once, as it
    is if two windows of one segment are equal. With only_hot, windows of hot anchors are given, each a segment
    of its own, anchored by its own hash; otherwise hot anchors are left out.
    """

    def __init__(self, column: pa.Array, window: int, hot: np.ndarray, only_hot: bool = False):
        self.buffer, offsets = bytes_of(column)
        self.word_start, self.word_end, first_word = words_of(self.buffer, offsets)
        self.first_word = first_word
        hashes = range_hashes(self.buffer.astype(np.uint64), self.word_start, self.word_end)
        size = np.diff(first_word)
        text = np.repeat(np.arange(len(size)), size)
        if len(hashes) < window:
            self._set(*(np.zeros(0, np.int64) for _ in range(6)))
            return
        short = runs_of(hashes, ANCHOR)
        anchors = window_minima(short, window - ANCHOR + 1)
        at = np.flatnonzero(np.arange(len(anchors)) + window <= first_word[1:][text[: len(anchors)]])
        anchors = anchors[at]
        is_hot = hot[np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)] == anchors if len(hot) else np.zeros(len(at), bool)
        if only_hot:
            at = at[is_hot]
            own = range_hashes(hashes, at, at + window)
            self._set(text[at], mix(own + np.uint64(1)), own, at - first_word[text[at]], np.ones(len(at), np.int64), np.ones(len(at), np.int64))
            return
        new = np.ones(len(at), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.concatenate([first, [len(at)]]))
        pieces = -(-length // RUN)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        index = np.repeat(first, pieces) + RUN * within
        n = np.minimum(np.repeat(length, pieces) - RUN * within, RUN)
        cool = ~is_hot[index]
        index, n = index[cool], n[cool]
        start, anchor = at[index], anchors[index]
        own = mix(text.astype(np.uint64) + np.uint64(1))
        kinds, count = np.unique(short ^ own[: len(short)], return_counts=True)
        many = np.minimum(count[np.searchsorted(kinds, anchor ^ own[start])], 2)
        self._set(text[start], anchor, range_hashes(hashes, start, start + n + window - 1), start - first_word[text[start]], n, many)

    def _set(self, text, anchor, seg, start, n, many) -> None:
        self.text, self.anchor, self.seg, self.start, self.n, self.many = text, anchor.astype(np.uint64).view(np.int64), seg.astype(np.uint64).view(np.int64), start, n, many

    def words(self, i: int, window: int) -> bytes:
        first = self.first_word[self.text[i]] + self.start[i]
        return self.buffer[self.word_start[first] : self.word_end[first + self.n[i] + window - 2]].tobytes()


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a few MB of text each."""
    total = np.cumsum([len(t) if t is not None else 0 for t in batch.column(batch.schema.get_field_index("text"))] or [0]) if batch.nbytes > _PART else np.zeros(1)
    if total[-1] <= _PART:
        yield batch
        return
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _PART)))
        yield batch.slice(begin, end - begin)
        begin = end


def _occurrences(docs: DataFrame, window: int, hot: np.ndarray, only_hot: bool = False) -> DataFrame:
    """_id, _h, anchor, seg, start, n, many: one row per segment. Written, since it is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _in_parts(whole):
                s = Segments(batch.column("text"), window, hot, only_hot)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(s.text, minlength=batch.num_rows))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v).cast(t)) for v, t in ((s.anchor, pa.int64()), (s.seg, pa.int64()), (s.start, pa.int32()), (s.n, pa.int32()), (s.many, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), *lists], names=["_id", "_h", "anchor", "seg", "start", "n", "many"])

    found = arrow_batches(docs.where("text IS NOT NULL")).mapInArrow(run, f"_id long, _h long, {SEGMENTS}")
    found = materialize(found.where(F.size("anchor") > 0), "all-segments")
    return found.select("_id", "_h", F.explode(F.arrays_zip("anchor", "seg", "start", "n", "many")).alias("s")).select("_id", "_h", "s.*")


def _repeated(found: DataFrame) -> DataFrame:
    """The occurrences of anchors that occur more than once: no other window is repeated."""
    often = found.groupBy(F.col("anchor").alias("_a")).agg(F.sum("many").alias("_n")).where("_n > 1").select("_a")
    return found.drop("many").join(often, F.col("anchor") == F.col("_a")).drop("_a")


def _kinds(found: DataFrame) -> DataFrame:
    """anchor, seg, weight, n and rep: the different segments, and the least id and text that has each. Ids alone may be null or repeat."""
    return found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("_id", "_h")).alias("rep"), F.first("n").alias("n"))


def _wanted(kinds: DataFrame) -> DataFrame:
    """_i, _g and want: the segments whose words each text is asked for."""
    return kinds.groupBy(F.col("rep._id").alias("_i"), F.col("rep._h").alias("_g")).agg(F.collect_list(F.struct("anchor", "seg", "weight")).alias("want"))


def _words_of(docs: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """anchor, seg, weight, words: the words of the wanted segments of each document (rows with want: array of anchor, seg, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _in_parts(whole):
                want = batch.column("want")
                item = want.flatten()
                row = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
                anchor, seg, weight = (item.field(c).to_numpy() for c in ("anchor", "seg", "weight"))
                key = lambda text, a, b: mix(mix(mix(text.astype(np.uint64)) ^ a.view(np.uint64)) ^ b.view(np.uint64))
                wanted = key(row, anchor, seg)
                order = np.argsort(wanted)
                wanted, weight = wanted[order], weight[order]
                for only_hot in (False, True) if len(hot) else (False,):
                    s = Segments(batch.column("text"), window, hot, only_hot)
                    own = key(s.text, s.anchor, s.seg)
                    place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1) if len(wanted) else np.zeros(0, int)
                    good = np.flatnonzero(wanted[place] == own) if len(wanted) else place
                    good = good[np.unique(own[good], return_index=True)[1]]
                    words = pa.array([s.words(i, window) for i in good], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(s.anchor[good]), pa.array(s.seg[good]), pa.array(weight[place[good]]), words], names=["anchor", "seg", "weight", "words"])

    return arrow_batches(docs).mapInArrow(run, "anchor long, seg long, weight long, words binary")


def _search(rows: DataFrame, window: int) -> DataFrame:
    """anchor, seg, mask: bit i is set if the segment's window i is repeated. Rows come sorted by (shard, anchor, seg)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, weights, texts = None, [], [], []

        def close() -> pa.RecordBatch:
            ids: dict[bytes, int] = {}
            coded = [np.fromiter((ids.setdefault(w, len(ids) + 1) for w in t.split()), np.int64) for t in texts]
            index = FMIndex(coded, np.minimum(weights, 2), window)
            masks = [int(np.bitwise_or.reduce(np.int64(1) << np.flatnonzero((n == window) & (w > 1)), initial=0)) for n, w in index.matching(coded)]
            out = [[k[0] for k in keys], [k[1] for k in keys], masks]
            for x in (keys, weights, texts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor", "seg", "mask"])

        for batch in batches:
            for s, anchor, seg, weight, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchor", "seg", "weight", "words")), strict=True):
                if s != shard and keys:
                    yield close()
                shard = s
                if keys and keys[-1] == (anchor, seg):
                    continue  # the same segment from repeated rows
                keys.append((anchor, seg))
                weights.append(weight)
                texts.append(words)
        if keys:
            yield close()

    return arrow_batches(rows).mapInArrow(run, "anchor long, seg long, mask long").where("mask <> 0")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (spans of words) for rows with marks (array of start, mask; may be null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, sha, spans = [], [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                words = text.split() if text else []
                cover = np.zeros(len(words) + 1, np.int64)
                for m in marks or ():
                    at = m["start"] + np.array([i for i in range(RUN) if m["mask"] >> i & 1])
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                covered = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                total.append(len(words))
                gone.append(int(covered.sum()))
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c] if gone[-1] else words
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
            )

    return arrow_batches(rows).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot_segments: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, removed (spans of words, end exclusive).

    A window is `window` consecutive words (separated by ASCII white space, unchanged) of one text, ANCHOR + RUN - 1 at most; its words go if it starts
    anywhere else, too. Windows are routed by anchors: each text is cut into segments of windows of one anchor. Anchors that occur once are
    done with. Of equal segments one is kept, with their number as its weight. Shards of anchors each get an FM-index of their segments;
    the segments stream through it backwards, and the matching statistics of each window, as the weight of its places, tell whether it is repeated.
    Anchors of very many different segments (a common line among other words) are cut into single windows, each routed by its own hash.

    Null, empty and short texts keep all. Repeated rows repeat each other's windows. Null ids are like others. Extra columns are ignored; an empty table gives no rows.
    """
    if not ANCHOR <= window < 62 + ANCHOR:
        raise ValueError("window")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("text"))
    none = np.zeros(0, np.uint64)
    found = materialize(_repeated(_occurrences(rows, window, none)), "segments")
    kinds = materialize(_kinds(found), "segment-kinds")
    limit = max(hot_segments, kinds.count() // PARTS)
    often = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("anchor")
    hot = np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))  # at most PARTS
    if len(hot):
        cool = found.join(F.broadcast(often.withColumnRenamed("anchor", "_a")), F.col("anchor") == F.col("_a"), "left_anti")
        found = cool.unionByName(materialize(_repeated(_occurrences(rows, window, hot, True)), "hot-windows"))
        kinds = materialize(_kinds(found), "segment-kinds")
    words = kinds.agg(F.sum(F.col("n") + window)).first()[0] or 0
    want = _wanted(kinds)
    asked = rows.where("text IS NOT NULL").hint("merge").join(want, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))).select("text", "want")
    shards = max(1, -(-words // shard_words))
    routed = _words_of(asked, window, hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    routed = routed.repartition(max(parts, min(shards, 10 * parts)), "shard").sortWithinPartitions("shard", "anchor", "seg")
    masks = materialize(_search(routed, window), "masks").withColumnsRenamed({"anchor": "_a", "seg": "_s"})
    marks = found.join(masks, (F.col("anchor") == F.col("_a")) & (F.col("seg") == F.col("_s")))
    marks = marks.groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    marked = rows.hint("merge").join(marks, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left").select("_id", "text", "marks")
    return _cut(marked, window)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")


OP2_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM repeated)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
