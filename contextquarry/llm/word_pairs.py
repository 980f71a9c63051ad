"""Pairs of neighbouring words of the quality classifier: the level above words of its Kneser-Ney model.

The probability of a word after another, or at the beginning of a sentence, is the pair's discounted count in trusted text; what the discounts leave goes to the word in its place
(the beginning of a sentence, or within one), whose count is the number of different words it was seen after, and from there to its spelling. -log p is therefore a sum of three costs: of the word, of what its context leaves, and, for pairs that trusted text has, less what
the pair gains. The first two go by words and the third by pairs, so no document needs more than sums from the shards of its words' hashes.

Trusted pairs are dealt to the shards of their second words and summed there; sums by first words go to the shards of these, which answer with what each context leaves. Documents send, once, without storing it before,
the words and pairs that aren't among the commonest, but for those that a filter of FILTER_BITS bits holds back: words that trusted text hasn't have the cost of their spelling, which is known where the text stands. Where
trusted pairs are many more than its bits, it holds back few, and results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextquarry.llm import quality as q
from contextquarry.llm.common import arrow_batches, materialize
from contextquarry.llm.rolling import bytes_of, mix, range_hashes, words_of

#: The context of a word that begins a sentence.
START = 0
FILTER_BITS = 1 << 28
#: Pairs that are scored where a text stands: at most so many of the commonest, of common words.
HEAD_PAIRS = 1 << 20
MODEL, LEFT, CONTEXTS = -3, -2, -1
DEALT = "shard int, block long, source int, payload binary"


def shard_bits(spark) -> int:
    """Of the number of shards, which grows with the shuffle partitions."""
    return min(10, max(q.SHARD_BITS, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def context_of(hashes: np.ndarray) -> np.ndarray:
    """48 bits of a word's hash: its number as a context."""
    return np.maximum(hashes >> np.uint64(16), np.uint64(1))


def pair_keys(hashes: np.ndarray, contexts: np.ndarray, bits: int) -> np.ndarray:
    """48 bits of a pair, the first of them those of its shard."""
    low = np.uint64((1 << (64 - bits)) - 1)
    return ((hashes & ~low) | (mix(hashes + mix(contexts + np.uint64(1))) & low)) >> np.uint64(16)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> np.uint64(16)).astype(np.uint32), (x & np.uint64(0xFFFF)).astype(np.uint16)


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(16)) | low


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins, in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64)


@dataclass
class Tokens:
    """The words of a part of texts, where they stand."""

    letters: np.ndarray  # each word after its byte of place
    start: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    said: np.ndarray  # 1, or 0 of a word of the part before that is only a context here
    n_words: np.ndarray
    n_chars: np.ndarray

    @classmethod
    def of(cls, buffer: np.ndarray, offsets: np.ndarray, carried: int = 0) -> Tokens:
        start, end, first = words_of(buffer, offsets)
        n_words, size = np.diff(first), end - start + 1
        char = (buffer & 0xC0) != 0x80
        char &= (buffer != 32) & ((buffer < 9) | (buffer > 13))
        n_chars = np.diff(np.concatenate([[0], np.cumsum(char)])[offsets]) + n_words
        letters = buffer[q._spans(end - size, size)]
        place = np.cumsum(size) - size
        begins = np.zeros(len(start), bool)
        begins[1:] = np.isin(buffer[end[:-1] - 1], np.frombuffer(q.ENDS, np.uint8))
        begins[first[:-1][n_words > 0]] = True
        letters[place] = np.where(begins, q.FIRST, q.WITHIN)
        if carried:
            letters[0] = carried
        hashes = range_hashes(letters, place, place + size)
        context, said = np.zeros(len(start), np.uint64), np.ones(len(start), np.int64)
        context[1:] = context_of(hashes[:-1])
        context[begins] = START
        if carried:
            said[0] = 0
            n_words[0] -= 1
            n_chars[0] -= int(char[: end[0]].sum()) + 1
        return cls(letters, place, size, hashes, context, np.repeat(np.arange(len(n_words)), np.diff(first)), said, n_words, n_chars)


def _tokens(buffer: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, Tokens]]:
    """The first text of each part, and its words. A part that goes on with a sentence begins with the last word before it."""
    last = None
    for first, part, ends, opens in q._parts(buffer, offsets):
        if not opens:
            part, ends = np.concatenate([last[1:], np.array([32], np.uint8), part]), np.concatenate([[0], ends[1:] + len(last)])
        t = Tokens.of(part, ends, 0 if opens else int(last[0]))
        if len(t.start):
            last = t.letters[t.start[-1] :]
        yield first, t


def _by_shard(hashes: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Where the hashes of each shard begin, in sorted ones, and the end."""
    return np.searchsorted(hashes >> np.uint64(width - bits), np.arange((1 << bits) + 1))


def _dealt(df: DataFrame, run: Callable, bits: int, *order: str) -> DataFrame:
    """What run makes of the rows of each shard, which it gets as (shard, rows), in order. A task has about four shards, one after the other, so files are fewer."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != key and held:
                    yield from run(key, held)
                    held = []
                key = row["shard"]
                held.append(row)
        if held:
            yield from run(key, held)

    return arrow_batches(df.repartition(1 << bits >> 2, "shard").sortWithinPartitions("shard", *order)).mapInArrow(each, DEALT + ", stats array<long>")


def _row(shard: int, block: int, source: int, payload: bytes | None, stats: list[int] | None = None) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    names = ["shard", "block", "source", "payload", "stats"]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, block, source, payload, stats), types, strict=True)], names=names)


# the model

_MODEL = (np.uint8, np.uint32, np.uint32, np.uint32, np.uint16, np.uint32, np.uint32)


def _packed(letters: np.ndarray, size: np.ndarray, runs: np.ndarray, context: np.ndarray, n: np.ndarray) -> bytes:
    """Words and their pairs. Contexts are listed once, in order, and pairs have their places in that list."""
    v, at = np.unique(context, return_inverse=True)
    return q._pack(letters, size.astype(np.uint32), runs.astype(np.uint32), *_halves(np.diff(v, prepend=np.uint64(0))), at.astype(np.uint32), n.astype(np.uint32))


def _summed(letters: np.ndarray, start: np.ndarray, size: np.ndarray, word: np.ndarray, hashes: np.ndarray, context: np.ndarray, n: np.ndarray):
    """Different words by hash, with their pairs by context: letters and sizes, pairs a word, contexts, counts and hashes of words. word: of each entry, its place in start and size."""
    order = np.lexsort((context, hashes))
    h, v = hashes[order], context[order]
    at = _firsts(h, v)
    begins = _firsts(h[at])
    sample = word[order[at[begins]]]
    return letters[q._spans(start[sample], size[sample])], size[sample], np.diff(np.concatenate([begins, [len(at)]])), v[at], _sums(n[order], at), h[at[begins]]


def _fit(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in q._blocks(batches):
            for _, t in _tokens(*bytes_of(batch.column("text").fill_null(b""))):
                own = np.flatnonzero(t.said)
                letters, size, runs, v, n, h = _summed(t.letters, t.start, t.size, own, t.hashes[own], t.context[own], t.said[own])
                ends, pairs, cut = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(runs)]), _by_shard(h, bits)
                for s in np.flatnonzero(np.diff(cut)):
                    a, b = cut[s], cut[s + 1]
                    p = slice(pairs[a], pairs[b])
                    yield _row(int(s), MODEL, 0, _packed(letters[ends[a] : ends[b]], size[a:b], runs[a:b], v[p], n[p]))

    return run


@dataclass
class Shard:
    """Words and pairs of one shard of the model."""

    letters: np.ndarray
    size: np.ndarray
    runs: np.ndarray
    contexts: np.ndarray  # different ones, in order
    at: np.ndarray  # of each pair, the place of its context
    n: np.ndarray

    @classmethod
    def opened(cls, payload: bytes) -> Shard:
        letters, size, runs, high, low, at, n = q._unpack(payload, *_MODEL)
        return cls(letters, size.astype(np.int64), runs.astype(np.int64), np.cumsum(_whole(high, low), dtype=np.uint64), at.astype(np.int64), n.astype(np.int64))

    @property
    def context(self) -> np.ndarray:
        return self.contexts[self.at]

    def pair_keys(self, hashes: np.ndarray, bits: int) -> np.ndarray:
        return pair_keys(np.repeat(hashes, self.runs), self.context, bits)

    def hashes(self) -> np.ndarray:
        return _hashes(self.letters, self.size)

    def places(self) -> np.ndarray:
        return self.letters[np.cumsum(self.size) - self.size]


def _hashes(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return range_hashes(letters, ends - size, ends)


def _lined(letters: np.ndarray, size: np.ndarray) -> bytes:
    out = np.full(len(letters) + len(size), 10, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return out.tobytes()


def _merged(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    parts = [Shard.opened(r["payload"]) for r in rows]
    letters, size, runs, v, n = (np.concatenate([getattr(p, c) for p in parts]) for c in ("letters", "size", "runs", "context", "n"))
    word, h = np.repeat(np.arange(len(size)), runs), _hashes(letters, size)
    letters, size, runs, v, n, _ = _summed(letters, np.cumsum(size) - size, size, word, h[word], v, n)
    place = letters[np.cumsum(size) - size]
    stats = [int((n == k).sum()) for k in (1, 2, 3, 4)]
    for own in (runs[place == q.FIRST], runs[place == q.WITHIN]):
        stats += [int(own.sum()), len(own), *(int((own == k).sum()) for k in (1, 2, 3, 4))]
    yield _row(shard, MODEL, 0, _packed(letters, size, runs, v, n), stats)


def _over(model: DataFrame, make: Callable[[int, Shard], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                yield from make(shard, Shard.opened(payload))

    return arrow_batches(model.select("shard", "payload")).mapInArrow(run, fields)


def _contexts(model: DataFrame, cut: tuple[float, float, float], bits: int) -> DataFrame:
    """What each context leaves: rows LEFT (for a shard of words, of its contexts in each shard, in order) and CONTEXTS (by context, its share and what is left of its count)."""

    def asked(shard: int, own: Shard) -> Iterator[pa.RecordBatch]:
        v = own.contexts
        sums = [np.bincount(own.at, x, len(v)).astype(np.uint32) for x in (own.n, own.n == 1, own.n == 2, own.n >= 3)]
        to = _by_shard(v, bits, 48)
        for s in np.flatnonzero(np.diff(to)):
            p = slice(to[s], to[s + 1])
            yield _row(int(s), CONTEXTS, shard, q._pack(*_halves(v[p]), *(x[p] for x in sums)))

    def answered(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        parts = [q._unpack(r["payload"], np.uint32, np.uint16, *[np.uint32] * 4) for r in rows]
        lists = [_whole(p[0], p[1]) for p in parts]
        v, at = np.unique(np.concatenate(lists), return_inverse=True)
        total, *seen = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(v)) for k in (2, 3, 4, 5))
        left = sum(d * n for d, n in zip(cut, seen, strict=True))
        yield _row(shard, CONTEXTS, 0, q._pack(*_halves(v), (left / total).astype(np.float32), left.astype(np.float32)))
        for r, own in zip(rows, np.split(at, np.cumsum([len(x) for x in lists])[:-1]), strict=True):
            yield _row(r["source"], LEFT, shard, q._pack(left[own].astype(np.float32)))

    return materialize(_dealt(_over(model, asked, DEALT + ", stats array<long>"), answered, bits, "source"), "kn-contexts", free=True).drop("stats")


@dataclass
class Common:
    """Of the commonest words, by hash: the costs of the word and of what it leaves as a context; what the beginning of a sentence leaves; bits of all words and pairs; and the gains of the commonest pairs."""

    hashes: np.ndarray
    cost: np.ndarray
    leaves: np.ndarray
    start: float
    bits: bytes  # packed
    pairs: bytes  # packed: keys, in order, and gains

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        high, low, gains = q._unpack(self.pairs, np.uint32, np.uint16, np.float32)
        return np.cumsum(_whole(high, low), dtype=np.uint64), gains

    @classmethod
    def of(cls, model: DataFrame, contexts: DataFrame, level: q.WordLevel, cut: tuple[float, float, float], spelled, bits: int) -> Common:
        """spelled: the spelling model, packed and broadcast."""
        spark = model.sparkSession

        def kinds(_: int, own: Shard) -> Iterator[pa.RecordBatch]:
            n, k = np.unique(own.runs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k)], names=["n", "kinds"])

        counts = _over(model, kinds, "n long, kinds long").groupBy("n").agg(F.sum("kinds").alias("kinds")).orderBy(F.desc("n")).limit(q.HEAD).toArrow()
        high = counts.column("n").to_numpy()[np.cumsum(counts.column("kinds").to_numpy()) <= q.HEAD]
        least = int(high[-1]) if len(high) else 1 << 62

        def words(_: int, own: Shard) -> Iterator[pa.RecordBatch]:
            chosen = np.flatnonzero(own.runs >= least)
            if len(chosen):
                size = own.size[chosen]
                letters = own.letters[q._spans((np.cumsum(own.size) - own.size)[chosen], size)]
                cost = level.costs(own.places()[chosen], own.runs[chosen], q.spelling_costs(_lined(letters, size), q.symbol_table(), q._unpack(spelled.value, np.float32)[0]))
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(letters, size).astype(np.int64)), pa.array(cost)], names=["h", "cost"])

        got = _over(model, words, "h long, cost double").toArrow()
        h, cost = got.column("h").to_numpy().astype(np.uint64), got.column("cost").to_numpy()
        order = np.argsort(h)
        h, cost = h[order], cost[order]
        wanted = spark.sparkContext.broadcast(np.unique(np.concatenate([[np.uint64(START)], context_of(h)])))

        def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column("payload").to_pylist():
                    high, low, share, left = q._unpack(payload, np.uint32, np.uint16, np.float32, np.float32)
                    v = _whole(high, low)
                    own = np.isin(v, wanted.value)
                    yield pa.RecordBatch.from_arrays([pa.array(v[own].astype(np.int64)), *(pa.array(x[own].astype(np.float64)) for x in (share, left))], names=["v", "share", "rest"])

        got = arrow_batches(contexts.where(F.col("block") == CONTEXTS).select("payload")).mapInArrow(shares, "v long, share double, rest double").toArrow()
        wanted.destroy()
        v, share, rest = got.column("v").to_numpy().astype(np.uint64), got.column("share").to_numpy(), got.column("rest").to_numpy()
        order = np.argsort(v)
        v, leaves, rest = v[order], -np.log(share[order]), rest[order]

        def repeats(_: int, own: Shard) -> Iterator[pa.RecordBatch]:
            n, k = np.unique(own.n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k)], names=["n", "kinds"])

        counts = _over(model, repeats, "n long, kinds long").groupBy("n").agg(F.sum("kinds").alias("kinds")).orderBy(F.desc("n")).limit(HEAD_PAIRS).toArrow()
        high = counts.column("n").to_numpy()[np.cumsum(counts.column("kinds").to_numpy()) <= HEAD_PAIRS]
        often = int(high[-1]) if len(high) else 1 << 62

        def frequent(_: int, own: Shard) -> Iterator[pa.RecordBatch]:
            chosen = own.n >= often
            cols = (np.repeat(own.hashes(), own.runs)[chosen].astype(np.int64), own.context[chosen].astype(np.int64), own.n[chosen])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "v", "n"])

        got = _over(model, frequent, "h long, v long, n long").toArrow()
        first, second, n = got.column("v").to_numpy().astype(np.uint64), got.column("h").to_numpy().astype(np.uint64), got.column("n").to_numpy()
        (known_w, word_cost), (known_v, of_context) = look_up(h, cost, second), look_up(v, rest, first)
        own = known_w & known_v
        gains = np.log1p((n[own] - np.array([0.0, *cut])[np.minimum(n[own], 3)]) / (of_context[own] * np.exp(-word_cost[own])))
        keys = pair_keys(second[own], first[own], bits)
        order = np.argsort(keys)
        pairs = q._pack(*_halves(np.diff(keys[order], prepend=np.uint64(0))), gains[order].astype(np.float32))
        size = FILTER_BITS >> bits

        def filtered(shard: int, own: Shard) -> Iterator[pa.RecordBatch]:
            hashes, mask = own.hashes(), np.zeros(size, bool)
            for keys in (context_of(hashes), own.pair_keys(hashes, bits)):
                mask[_filter_place(keys) - shard * size] = True
            yield _row(shard, MODEL, 0, q._pack(np.packbits(mask)))

        table = np.zeros(FILTER_BITS >> 3, np.uint8)
        for r in _over(model, filtered, DEALT + ", stats array<long>").select("shard", "payload").toLocalIterator():
            table[r["shard"] * size >> 3 : (r["shard"] + 1) * size >> 3] = q._unpack(bytes(r["payload"]), np.uint8)[0]
        return cls(h, cost, look_up(v, leaves, context_of(h))[1], float(look_up(v, leaves, np.array([START], np.uint64))[1][0]), q._pack(table), pairs)


#: Of a key of 48 bits, the first are its place in the filter.
REST_BITS = 48 - (FILTER_BITS.bit_length() - 1)


def _filter_place(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(REST_BITS)).astype(np.int64)


def _coded(number: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys with the number of their place, among those of their shard that the filter has, for the place: as exact, and shorter to send."""
    return (number.astype(np.uint64) << np.uint64(REST_BITS)) | (keys & np.uint64((1 << REST_BITS) - 1))


class Filter:
    """The places that the keys of words and pairs of trusted text have."""

    def __init__(self, packed: bytes, bits: int):
        self.words = q._unpack(packed, np.uint8)[0].view(">u8").astype(np.uint64)
        set_bits = np.bitwise_count(self.words).reshape(-1, 4).sum(axis=1, dtype=np.uint32)
        self.before = np.cumsum(set_bits, dtype=np.uint32) - set_bits  # each fourth word
        self.start = self.number(np.arange(1 << bits) << (FILTER_BITS.bit_length() - 1 - bits))
        self.shard = np.uint64(48 - bits)

    def number(self, place: np.ndarray) -> np.ndarray:
        """How many places before these it has."""
        at, inside = place >> 6, (place & 63).astype(np.uint64)
        n = self.before[at >> 2].astype(np.int64) + np.bitwise_count((self.words[at] >> np.uint64(1)) >> (np.uint64(63) - inside))
        for k in range(3):
            n += np.where(at & 3 > k, np.bitwise_count(self.words[(at & ~3) + k]), 0)
        return n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Which keys it lets pass."""
        place = _filter_place(keys)
        return ((self.words[place >> 6] >> (63 - (place & 63)).astype(np.uint64)) & np.uint64(1)) > 0

    def coded(self, keys: np.ndarray) -> np.ndarray:
        """Of keys that pass."""
        return _coded(self.number(_filter_place(keys)) - self.start[(keys >> self.shard).astype(np.int64)], keys)


def look_up(known: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which are known (sorted), and the values of these, else 0."""
    if not len(known):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    found = known[at] == wanted
    return found, np.where(found, values[at], 0)


# documents

_ASKED = (np.uint32, np.uint16, np.uint32, np.uint16, np.uint32, np.uint32, np.uint32, np.uint16, np.uint16, np.uint32)
ABOUT = "ids array<long>, h array<long>, lang array<string>, n_words array<long>, n_chars array<long>, nll array<double>"
_ABOUT = [x.split()[0] for x in ABOUT.split(", ")]


def _asks(t: Tokens, first_doc: int, common: Common, pairs: tuple[np.ndarray, np.ndarray], passing: Filter, spell: Callable[[bytes], np.ndarray], level: q.WordLevel, bits: int) -> tuple[np.ndarray, dict[int, bytes]]:
    """The costs of a part's words by text, all but the commonest as words that trusted text hasn't; and by shard what is asked, of what the filter lets pass: words with their texts, how often they are there and how
    often a word follows them; and pairs."""
    n_docs = len(t.n_words)
    cost = np.bincount(t.doc, (t.context == START) & (t.said > 0), n_docs) * common.start
    followed = np.zeros(len(t.start), np.int64)
    followed[:-1] = t.context[1:] != START
    order = np.lexsort((t.doc, t.hashes))
    h, d = t.hashes[order], t.doc[order]
    at = _firsts(h, d)
    begins = _firsts(h[at])
    doc, said, after = d[at], _sums(t.said[order], at), _sums(followed[order], at)
    word, sample = h[at[begins]], order[at[begins]]
    runs = np.diff(np.concatenate([begins, [len(at)]]))
    known, word_cost = look_up(common.hashes, common.cost, word)
    leaves = look_up(common.hashes, common.leaves, word)[1]
    other = np.flatnonzero(~known)
    if len(other):
        start, size = t.start[sample[other]], t.size[sample[other]]
        word_cost[other] = level.costs(t.letters[start], np.zeros(len(other), np.int64), spell(_lined(t.letters[q._spans(start, size)], size)))
    cost = cost + np.bincount(doc, np.repeat(word_cost, runs) * said + np.repeat(leaves, runs) * after, n_docs)
    other = other[passing.find(context_of(word[other]))]
    codes = passing.coded(context_of(word[other]))
    keys = pair_keys(t.hashes, t.context, bits)
    common_pair, gain = look_up(*pairs, keys)
    cost = cost - np.bincount(t.doc, gain * t.said, n_docs)
    own = np.flatnonzero(passing.find(keys) & (t.said > 0) & ~common_pair)
    own = own[np.lexsort((t.doc[own], keys[own]))]
    at = _firsts(keys[own], t.doc[own])
    key, key_doc, key_n = keys[own][at], t.doc[own][at], np.diff(np.concatenate([at, [len(own)]]))
    pair_codes = passing.coded(key)
    of_words, of_pairs, out = _by_shard(word[other], bits), _by_shard(key, bits, 48), {}
    for s in range(1 << bits):
        w, p = slice(of_words[s], of_words[s + 1]), slice(of_pairs[s], of_pairs[s + 1])
        if w.stop > w.start or p.stop > p.start:
            x = q._spans(begins[other[w]], runs[other[w]])
            out[s] = q._pack(
                *_halves(np.diff(codes[w], prepend=np.uint64(0))), runs[other[w]].astype(np.uint32), (doc[x] + first_doc).astype(np.uint16), said[x].astype(np.uint32), after[x].astype(np.uint32),
                *_halves(np.diff(pair_codes[p], prepend=np.uint64(0))), (key_doc[p] + first_doc).astype(np.uint16), key_n[p].astype(np.uint32),
            )
    return cost, out


def _postings(docs: DataFrame, common: Common, level: q.WordLevel, spelled, bits: int) -> DataFrame:
    """As quality._postings: a block's documents with their costs as far as they are known where texts are (payload null, in any shard), and what is asked of each shard."""
    types = [pa.int32(), pa.int64(), pa.binary(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())]]
    names = ["shard", "block", "payload", *_ABOUT]
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        pairs = passing = table = log_p = None
        for batch in q._blocks(batches):
            if passing is None:
                pairs, passing, table, log_p = shared.value.gains(), Filter(shared.value.bits, bits), q.symbol_table(), q._unpack(spelled.value, np.float32)[0]
            n_words, n_chars, nll = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, t in _tokens(*bytes_of(batch.column("text").fill_null(b""))):
                own = slice(first, first + len(t.n_words))
                cost, found = _asks(t, first, shared.value, pairs, passing, lambda words: q.spelling_costs(words, table, log_p), level, bits)
                n_words[own] += t.n_words
                n_chars[own] += t.n_chars
                nll[own] += cost
                cols = (list(found), [block] * len(found), list(found.values()), *[[None] * len(found)] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, types, strict=True)], names=names)
            own = [batch.column(x).to_pylist() for x in ("doc_id", "h", "lang")] + [n_words.tolist(), n_chars.tolist(), nll.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((int(mix(np.array([block], np.uint64))[0]) % (1 << bits), block, None, *own), types, strict=True)], names=names)
            block += 1

    return arrow_batches(docs).mapInArrow(run, f"shard int, block long, payload binary, {ABOUT}")


def _answers(postings: DataFrame, model: DataFrame, contexts: DataFrame, level: q.WordLevel, cut: tuple[float, float, float], spelled, bits: int) -> DataFrame:
    """block, sums (packed: documents, in order, and sums): what each shard's words and pairs add to the costs by document; and the blocks' documents, as they come. The shard's model comes first, and what is asked of it streams past."""
    none = [F.lit(None).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in ABOUT.split(", ")]
    known = model.select("shard", "block", "source", "payload").unionByName(contexts).select("*", *none)
    every = known.unionByName(postings.withColumn("source", F.lit(0)))
    steps = np.array([0.0, *cut])

    def opened(model: Shard, left: np.ndarray, v: np.ndarray, leaves: np.ndarray, spell: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, ...]:
        """Codes of words, in order, with what they gain over words that trusted text hasn't and what they leave as contexts; codes of pairs, in order, and their gains."""
        hashes, spelling = model.hashes(), spell(_lined(model.letters, model.size))
        cost = level.costs(model.places(), model.runs, spelling)
        gains = np.log1p((model.n - steps[np.minimum(model.n, 3)]) / (left[model.at] * np.repeat(np.exp(-cost), model.runs)))
        words, keys = context_of(hashes), model.pair_keys(hashes, bits)
        places = np.unique(_filter_place(np.concatenate([words, keys])))
        code = lambda x: _coded(np.searchsorted(places, _filter_place(x)), x)
        order, of_pairs = np.argsort(words), np.argsort(keys)
        words, gained = words[order], (level.costs(model.places(), np.zeros(len(cost), np.int64), spelling) - cost)[order]
        return code(words), gained, look_up(v, leaves, words)[1], code(keys[of_pairs]), gains[of_pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = log_p = key = model = ready = None
        for batch in batches:
            blocks, sums = [], []
            for shard, block, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "payload")), strict=True):
                if key != shard:
                    key, model, ready, left, shares = shard, None, None, [], (np.zeros(0, np.uint64), np.zeros(0))
                if payload is None:
                    continue
                if block == MODEL:
                    model = Shard.opened(payload)
                elif block == LEFT:  # in the order of contexts
                    left.append(q._unpack(payload, np.float32)[0])
                elif block == CONTEXTS:
                    high, low, share, _ = q._unpack(payload, np.uint32, np.uint16, np.float32, np.float32)
                    shares = _whole(high, low), -np.log(share.astype(np.float64))
                if block < 0:
                    continue
                if ready is None:  # the filter lets nothing pass to a shard without a model
                    if log_p is None:
                        table, log_p = q.symbol_table(), q._unpack(spelled.value, np.float32)[0]
                    ready = opened(model, np.concatenate(left).astype(np.float64), *shares, lambda words: q.spelling_costs(words, table, log_p))
                    model = None
                words, gained, leaves, pairs, gains = ready
                high, low, runs, doc, said, after, pair_high, pair_low, pair_doc, pair_n = q._unpack(payload, *_ASKED)
                word, pair = (np.cumsum(_whole(*x), dtype=np.uint64) for x in ((high, low), (pair_high, pair_low)))
                each = [np.repeat(look_up(words, x, word)[1], runs) for x in (gained, leaves)]
                each = np.concatenate([each[1] * after - each[0] * said, -look_up(pairs, gains, pair)[1] * pair_n])
                found, at = np.unique(np.concatenate([doc, pair_doc]), return_inverse=True)
                blocks.append(block)
                sums.append(q._pack(np.diff(found, prepend=found.dtype.type(0)), np.bincount(at, each).astype(np.float32)))
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sums, pa.binary()), *(pa.nulls(len(blocks), batch.column(c).type) for c in _ABOUT)], names=["block", "sums", *_ABOUT])
            about = batch.filter(batch.column("ids").is_valid())
            if about.num_rows:
                yield pa.RecordBatch.from_arrays([about.column("block"), pa.nulls(about.num_rows, pa.binary()), *(about.column(c) for c in _ABOUT)], names=["block", "sums", *_ABOUT])

    dealt = every.select("shard", "block", "source", "payload", *_ABOUT).repartition(1 << bits, "shard").sortWithinPartitions("shard", "block", "source")
    return arrow_batches(dealt).mapInArrow(run, f"block long, sums binary, {ABOUT}")


def _scores(answers: DataFrame) -> DataFrame:
    """doc_id, h, lang, n_words, n_chars, nll: the documents of each block with the sum of their costs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nll = np.array(row["nll"])
                for packed in sorted(row["sums"]):  # in an order that doesn't depend on tasks
                    doc, sums = q._unpack(packed, np.uint16, np.float32)
                    nll[np.cumsum(doc, dtype=np.int64)] += sums
                cols = (row["ids"], row["h"], row["lang"], row["n_words"], row["n_chars"], nll)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", *_ABOUT[1:]])

    # a block has one row of documents, and a list for each shard and each part of a long text
    whole = answers.groupBy("block").agg(F.collect_list("sums").alias("sums"), *(F.first(c, ignorenulls=True).alias(c) for c in _ABOUT))
    return arrow_batches(whole).mapInArrow(add, "doc_id long, h long, lang string, n_words long, n_chars long, nll double")


def score_rows(rows: DataFrame, fit: Callable[[Callable, str], DataFrame]) -> DataFrame:
    """doc_id, h, lang, n_words, n_chars, nll of rows (doc_id, h, lang, text), by a model of trusted texts: fit(make, fields) is what make has of their batches."""
    spark = rows.sparkSession
    bits = shard_bits(spark)
    model = materialize(_dealt(fit(_fit(bits), DEALT + ", stats array<long>"), _merged, bits), "kn-pairs", free=True)
    stats = model.select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    stats = {r["pos"]: r["n"] for r in stats}
    cut = q.discounts(*(stats.get(k, 0) for k in range(4)))
    level = q.WordLevel(np.zeros(3), np.tile([0.0, 0.5, 1.0, 1.5], (3, 1)), np.ones(3))
    for k, place in ((4, q.FIRST), (10, q.WITHIN)):
        total, kinds, n1, n2, n3, n4 = (stats.get(k + i, 0) for i in range(6))
        if total:
            own = q.discounts(n1, n2, n3, n4)
            level.total[place], level.cut[place, 1:] = total, own
            level.left[place] = (own[0] * n1 + own[1] * n2 + own[2] * (kinds - n1 - n2)) / total

    def words(_: int, own: Shard) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([[0], np.cumsum(own.size)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(own.size), [None, pa.py_buffer(ends), pa.py_buffer(own.letters.tobytes())])], names=["word"])

    spelled = spark.sparkContext.broadcast(q._pack(q.spelling(_over(model, words, "word binary"))))
    contexts = _contexts(model, cut, bits)
    postings = _postings(rows, Common.of(model, contexts, level, cut, spelled, bits), level, spelled, bits)
    return _scores(_answers(postings, model, contexts, level, cut, spelled, bits))
