"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The classifier's model has pairs of neighbouring words (word_pairs) above words above characters. At the level of words, which is a model of its own where no pairs are asked for, a word's
probability, at the beginning of a sentence or within one, is its discounted count there in trusted text, and what the discounts leave goes to the word's spelling: a Kneser-Ney model of characters within words, which each different word adds to once, as the lower orders do.
Counts of words are tables of any size, sharded by the words' hashes. The commonest words, a fixed number, are scored where a text stands; all others are
sent to the shards once, by blocks of documents, and come back as a sum per document. What passes the driver is bounded by constants: the spelling model, by its alphabet, the
commonest words, and a filter of ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize
from contextquarry.llm.rolling import bytes_of, mix, range_hashes, words_of

#: Symbols of the spelling model, so that its tables of ORDER symbols have a fixed bound.
SYMBOLS = 48
ORDER = 4
PAD, WORD_END = 0, 1
#: The byte before a word says where it stands: at the beginning of a sentence (or text), or within one.
FIRST, WITHIN = 1, 2
#: What ends the last word of a sentence.
ENDS = b".!?:"
#: Shards of the words, by the first bits of their hashes.
SHARD_BITS = 6
SHARDS = 1 << SHARD_BITS
#: Words that are scored where a text stands: so many of the commonest.
HEAD = 1 << 16
#: Bits of the filter that holds back texts that can't be trusted ones before they are joined with the ids of trusted ones.
FILTER_BITS = 1 << 27
#: Bytes of text and documents of a block, about; a longer text is a block of its own, read in parts of words.
BLOCK_BYTES, BLOCK_DOCS = 1_500_000, 8192
POSTINGS = "block long, shard int, payload binary, ids array<long>, h array<long>, lang array<string>, n_words array<long>, n_chars array<long>, nll array<double>"


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x110000: a letter from a to z each, one for capitals of these, digits and each of a few kinds of punctuation; all others
    share eleven by a hash of the code point, so texts of different scripts differ."""
    points = np.arange(0x110000, dtype=np.uint64)
    at = (37 + mix(points + np.uint64(1)) % np.uint64(SYMBOLS - 37)).astype(np.uint8)
    at[:128] = 36
    at[ord("a") : ord("z") + 1] = np.arange(2, 28)
    at[ord("A") : ord("Z") + 1] = 28
    at[ord("0") : ord("9") + 1] = 29
    for k, kind in enumerate((".", ",", "!?;:", "\"'-", "()[]{}<>", "#$%&*+/=@\\^_`|~")):
        at[[ord(c) for c in kind]] = 30 + k
    at[ord("\n")] = WORD_END
    return at


def grams(words: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words, each after its byte of place and before a line end: the codes of the ORDER-grams that end in each character, the line end included, and the word of each.

    Before a word stand a pad at the beginning of a sentence, and the end of a word within one, after further pads.
    """
    points = np.frombuffer(words.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = points == 10
    word = np.cumsum(ends) - ends
    place = np.arange(len(points)) + (ORDER - 2) * (word + 1)
    padded = np.zeros(len(points) + (ORDER - 2) * int(ends.sum()), np.int64)
    padded[place] = table[points]
    begins = np.concatenate([[True], ends[:-1]]) if len(ends) else ends
    padded[place[begins]] = np.where(points[begins] == FIRST, PAD, WORD_END)
    word, place = word[~begins], place[~begins]
    code = padded[place - (ORDER - 1)]
    for k in range(ORDER - 2, -1, -1):
        code = code * SYMBOLS + padded[place - k]
    return code, word


def spelling_costs(words: bytes, table: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """-log of the probability of each word's spelling."""
    code, word = grams(words, table)
    return np.bincount(word, -log_p[code].astype(np.float64))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams seen 1, 2, 3 and 4 times; 0.5, 1 and 1.5 where they are undefined."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05 * k), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


# documents to postings


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers: the first bytes of an array's items, compressed where that is shorter, or once where all are the same, then the second ones, and so on."""
    sizes, parts = [], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        sizes.append(len(x))
        for k in range(x.itemsize if len(x) else 0):
            plain = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize)[:, k]).tobytes()
            short = plain[:1] if plain == plain[:1] * len(plain) else pa.compress(plain, codec="zstd", asbytes=True)
            parts.append(min(plain, short, key=len))
            sizes.append(len(parts[-1]))
    return b"".join([np.array(sizes, np.uint32).tobytes(), *parts])


def _unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, found = np.frombuffer(payload, np.uint32, len(payload) // 4), []
    at = 0
    for kind in kinds:
        width = np.dtype(kind).itemsize if sizes[at] else 0
        found.append((int(sizes[at]), sizes[at + 1 : at + 1 + width].tolist()))
        at += 1 + width
    at, out = 4 * at, []
    for kind, (n, parts) in zip(kinds, found, strict=True):
        x = np.empty((n, np.dtype(kind).itemsize), np.uint8)
        for k, size in enumerate(parts):
            part = payload[at : at + size]
            x[:, k] = np.frombuffer(part if size in (1, n) else pa.decompress(part, n, codec="zstd", asbytes=True), np.uint8)
            at += size
        out.append(x.reshape(-1).view(kind))
    return out


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    places = np.arange(int(size.sum()))
    places += np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size)
    return places


@dataclass
class Words:
    """The different words of a block of texts, each after its byte of place, in the order of their hashes; and in which texts each is (pairs), how often."""

    letters: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray  # a word's first pair, and the end of the last
    doc: np.ndarray
    count: np.ndarray
    n_words: np.ndarray  # of each text
    n_chars: np.ndarray  # of each text, with a line end for each word

    @classmethod
    def of(cls, buffer: np.ndarray, offsets: np.ndarray, opens: bool = True) -> Words:
        start, end, first = words_of(buffer, offsets)
        n_words = np.diff(first)
        char = (buffer & 0xC0) != 0x80
        char &= (buffer != 32) & ((buffer < 9) | (buffer > 13))
        n_chars = np.diff(np.concatenate([[0], np.cumsum(char)])[offsets]) + n_words
        if not len(start):
            none = np.zeros(0, np.int64)
            return cls(buffer[:0], none, none.astype(np.uint64), np.zeros(1, np.int64), none, none, n_words, n_chars)
        final = np.isin(buffer[end - 1], np.frombuffer(ENDS, np.uint8))
        place = np.where(np.concatenate([[True], final[:-1]]), FIRST, WITHIN).astype(np.uint8)
        place[first[:-1][n_words > 0]] = FIRST
        if not opens and n_words[0]:
            place[0] = WITHIN
        size = end - start + 1
        placed = buffer[_spans(end - size, size)]  # with the byte before each word
        start = np.cumsum(size) - size
        placed[start] = place
        hashes = range_hashes(placed.astype(np.uint64), start, start + size)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], doc[order]
        new_word = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.flatnonzero(new_word | np.concatenate([[True], d[1:] != d[:-1]]))
        begins = np.flatnonzero(new_word[at])
        sample = order[at[begins]]
        return cls(placed[_spans(start[sample], size[sample])], size[sample], h[at[begins]], np.concatenate([begins, [len(at)]]), d[at], np.diff(np.concatenate([at, [len(h)]])), n_words, n_chars)

    def totals(self) -> np.ndarray:
        """How often each word is in the block."""
        return np.add.reduceat(self.count, self.begins[:-1]) if len(self.size) else self.count

    def binary(self) -> pa.BinaryArray:
        offsets = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.size), [None, pa.py_buffer(offsets), pa.py_buffer(self.letters.tobytes())])

    def shards(self, chosen: np.ndarray, first_doc: int) -> dict[int, bytes]:
        """By shard: the chosen words with their texts and counts."""
        cut = np.searchsorted(self.hashes >> np.uint64(64 - SHARD_BITS), np.arange(SHARDS + 1))
        starts, runs = np.cumsum(self.size) - self.size, np.diff(self.begins)
        out = {}
        for s in range(SHARDS):
            own = cut[s] + np.flatnonzero(chosen[cut[s] : cut[s + 1]])
            if len(own):
                pairs = _spans(self.begins[own], runs[own])
                letters = self.letters[_spans(starts[own], self.size[own])]
                out[s] = _pack(letters, self.size[own].astype(np.uint32), runs[own].astype(np.uint32), (self.doc[pairs] + first_doc).astype(np.uint16), self.count[pairs].astype(np.uint32))
        return out


def _open(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """letters, size, word of each pair, document of each pair, count of each pair."""
    letters, size, runs, doc, count = _unpack(payload, np.uint8, np.uint32, np.uint32, np.uint16, np.uint32)
    return letters, size.astype(np.int64), np.repeat(np.arange(len(runs)), runs), doc.astype(np.int64), count.astype(np.int64)


def _parts(buffer: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """The first text, the bytes and the offsets of parts of about BLOCK_BYTES, and whether the part's first word begins a sentence. A longer text is cut at white space, never within a word."""
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    at, doc, n, opens = 0, 0, len(offsets) - 1, True
    while doc < n:
        end = int(np.searchsorted(offsets, at + BLOCK_BYTES, "right")) - 1
        if end > doc:  # whole texts
            yield doc, buffer[at : offsets[end]], np.concatenate([[at], offsets[doc + 1 : end + 1]]) - at, opens
            at, doc, opens = int(offsets[end]), end, True
            continue
        stop = int(offsets[doc + 1])
        blank = np.flatnonzero(space[at : at + BLOCK_BYTES])
        if len(blank):
            to = at + int(blank[-1]) + 1
        else:
            blank = np.flatnonzero(space[at + BLOCK_BYTES : stop])
            to = at + BLOCK_BYTES + int(blank[0]) + 1 if len(blank) else stop
        yield doc, buffer[at:to], np.array([0, to - at]), opens
        said = np.flatnonzero(~space[at:to])
        if len(said):
            opens = bool(buffer[at + said[-1]] in ENDS)
        at = to
        if at == stop:
            doc, opens = doc + 1, True


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES or sum(b.num_rows for b in held) >= BLOCK_DOCS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _postings(docs: DataFrame, head: Head) -> DataFrame:
    """Rows of two kinds for rows (doc_id, h, lang, text): a block's documents with the cost of their commonest words (shard null), and all other words of a block in each shard (ids and the like null)."""
    names = [x.split()[0] for x in POSTINGS.split(", ")]
    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    types = [pa.int64(), pa.int32(), pa.binary(), longs, longs, texts, longs, longs, pa.list_(pa.float64())]
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, common = TaskContext.get().partitionId() << 32, shared.value
        for batch in _blocks(batches):
            buffer, offsets = bytes_of(batch.column("text").fill_null(b""))
            n_words, n_chars, nll = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, part, ends, opens in _parts(buffer, offsets):
                words = Words.of(part, ends, opens)
                own = slice(first, first + len(words.n_words))
                n_words[own] += words.n_words
                n_chars[own] += words.n_chars
                known, cost = common.find(words.hashes)
                runs = np.diff(words.begins)
                nll[own] += np.bincount(words.doc, np.repeat(np.where(known, cost, 0), runs) * words.count, len(words.n_words))
                found = words.shards(~known, first)
                cols = ([block] * len(found), list(found), list(found.values()), *[[None] * len(found)] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)
            own = [batch.column(x).to_pylist() for x in ("doc_id", "h", "lang")] + [n_words.tolist(), n_chars.tolist(), nll.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, None, None, *own), types, strict=True)], names=names)
            block += 1

    return arrow_batches(docs).mapInArrow(run, POSTINGS)


# the model


def _fit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: the words of the texts, each after its byte of place."""
    for batch in _blocks(batches):
        for _, part, ends, opens in _parts(*bytes_of(batch.column("text").fill_null(b""))):
            words = Words.of(part, ends, opens)
            yield pa.RecordBatch.from_arrays([words.binary(), pa.array(words.totals())], names=["word", "n"])


def _filter_bit(c, salt: str):
    return F.pmod(F.xxhash64(F.lit(salt), c), F.lit(FILTER_BITS))


def _filter_of(ids: DataFrame, salt: str) -> np.ndarray:
    """A filter of FILTER_BITS bits of the column _id; at most 1/64 as many words pass the driver."""
    set_bits = ids.select(_filter_bit(F.col("_id"), salt).alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[set_bits.column("at").to_numpy()] = set_bits.column("bits").to_numpy()
    return table


def _with_ids(rows: DataFrame, ids: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, fields: str = "doc_id long, text binary") -> DataFrame:
    """doc_id and text of the rows whose doc_id is among ids (_id: no nulls, no doubles), or what make has of batches of them.

    A filter of ids holds back most other rows. Ids that it lets pass although they aren't among ids are found by a join without texts, and a second filter has these: rows that pass
    the first and not the second are surely among ids. Only rows that pass both are joined with their texts. Where ids are so many that filters tell little, the result is the same.
    """
    rows = rows.where("doc_id IS NOT NULL")
    made = make or iter
    cast = rows.sparkSession.sparkContext.broadcast

    def passing(columns: list[str], tables: list, fields: str, then: Callable = iter) -> DataFrame:
        """Rows that pass filters (broadcast, and whether a row's bit is wanted)."""

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = [(_unpack(shared.value, np.int64)[0], wanted) for shared, wanted in tables]
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for k, (table, wanted) in enumerate(opened):
                    at = batch.column(f"_bit{k}").to_numpy()
                    keep &= ((table[at >> 6] >> (at & 63)) & 1 == 1) == wanted
                yield batch.filter(pa.array(keep)).select(columns)

        bits = [_filter_bit(F.col("doc_id"), salt).alias(f"_bit{k}") for k, salt in enumerate(("first", "second")[: len(tables)])]
        return arrow_batches(rows.select(*columns, *bits)).mapInArrow(lambda batches: then(chosen(batches)), fields)

    first = cast(_pack(_filter_of(ids, "first")))
    others = passing(["doc_id"], [(first, True)], "doc_id long").join(ids.hint("merge"), F.col("doc_id") == F.col("_id"), "left_anti")
    second = cast(_pack(_filter_of(others.select(F.col("doc_id").alias("_id")), "second")))
    columns = ["doc_id", "text"]
    unsure = passing(columns, [(first, True), (second, True)], "doc_id long, text binary").hint("merge").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    unsure = arrow_batches(unsure).mapInArrow(made, fields) if make else unsure
    return passing(columns, [(first, True), (second, False)], fields, made).unionByName(unsure)


def _lines(words: pa.Array) -> bytes:
    return b"\n".join([*words.to_pylist(), b""])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts = symbol_table(), None
    for batch in batches:
        if batch.num_rows:
            counts = np.zeros(SYMBOLS**ORDER, np.int64) if counts is None else counts
            seen, n = np.unique(grams(_lines(batch.column("word")), table)[0], return_counts=True)
            counts[seen] += n
    if counts is not None:
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["code", "n"])


def spelling(words: DataFrame) -> np.ndarray:
    """log of the probability of a symbol after ORDER - 1 others, by code: a table of SYMBOLS ** ORDER cells, from the column word (different words).

    Counts are summed by gram over all shards; lower orders count distinct left neighbours. Totals and back-off weights
    of the contexts are joined to the counts. What reaches the driver has at most SYMBOLS ** ORDER rows, by the alphabet.
    """
    counted = arrow_batches(words.select("word")).mapInArrow(_count_grams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    orders = {ORDER: materialize(counted, "kn-counts")}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy((F.col("code") % SYMBOLS**k).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    every = None
    for k, df in orders.items():
        df = df.select(F.lit(k).alias("k"), "code", F.floor(F.col("code") / SYMBOLS).cast("int").alias("context"), "n")
        every = df if every is None else every.unionByName(df)
    every = materialize(every, "kn-orders")
    seen = {r["k"]: r for r in every.groupBy("k").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()}
    cut = {k: discounts(*(seen[k][f"n{i}"] for i in (1, 2, 3, 4))) if k in seen else (0.5, 1.0, 1.5) for k in orders}
    by_order = F.coalesce(*(F.when(F.col("k") == k, F.element_at(F.array(*map(F.lit, d)), F.least(F.col("n"), F.lit(3)).cast("int"))) for k, d in cut.items()))
    cutted = every.withColumn("d", by_order)
    contexts = cutted.groupBy("k", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    terms = cutted.join(contexts, ["k", "context"]).select("k", "code", "context", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"), (F.col("left") / F.col("total")).alias("backoff"))
    got = terms.toArrow()
    k, code, context, p, backoff = (got.column(c).to_numpy() for c in ("k", "code", "context", "p", "backoff"))
    prob = np.full(1, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        of = k == order
        weight = np.ones(SYMBOLS ** (order - 1))
        weight[context[of]] = backoff[of]
        # a lower order's table repeats for each first symbol of the context
        lower = np.tile(prob.reshape(-1, SYMBOLS), (SYMBOLS, 1)) if order > 1 else np.full((1, SYMBOLS), prob[0])
        new = (weight[:, None] * lower).ravel()
        new[code[of]] += p[of]
        prob = new
    return np.log(prob).astype(np.float32)


@dataclass(frozen=True)
class WordLevel:
    """What the counts of words sum up to, by place: all words, the discounts of words seen once, twice and more often, and the share that these leave to spellings."""

    total: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    def costs(self, place: np.ndarray, n: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """-log of the probability of words of these places, counts and costs of spelling."""
        known = (n - self.cut[place, np.minimum(n, 3)]) / np.maximum(1, self.total[place])
        unknown = np.log(self.left[place]) - spelled
        return -np.where(n > 0, np.log(np.maximum(known, 1e-300) + np.exp(np.maximum(unknown, -700))), unknown)


def word_level(words: DataFrame) -> WordLevel:
    """Two rows are collected."""
    level = WordLevel(np.zeros(3), np.tile([0.0, 0.5, 1.0, 1.5], (3, 1)), np.ones(3))
    place = F.when(F.substring("word", 1, 1) == F.lit(bytes([FIRST])), FIRST).otherwise(WITHIN)
    sums = (F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), *(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    for r in words.groupBy(place.alias("place")).agg(*sums).collect():
        cut = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        level.total[r["place"]], level.cut[r["place"], 1:] = r["total"], cut
        level.left[r["place"]] = (cut[0] * r["n1"] + cut[1] * r["n2"] + cut[2] * (r["kinds"] - r["n1"] - r["n2"])) / r["total"]
    return level


@dataclass
class Head:
    """Hashes, in order, and costs of the commonest words."""

    hashes: np.ndarray
    cost: np.ndarray

    @classmethod
    def of(cls, words: DataFrame, level: WordLevel, log_p: np.ndarray) -> Head:
        """The words of counts so high that HEAD words at most have them are collected; no task sorts all words for that."""
        counts = words.groupBy("n").agg(F.count(F.lit(1)).alias("kinds")).orderBy(F.desc("n")).limit(HEAD).toArrow()
        high = counts.column("n").to_numpy()[np.cumsum(counts.column("kinds").to_numpy()) <= HEAD]
        got = words.where(F.col("n") >= F.lit(int(high[-1]) if len(high) else 1 << 62)).toArrow().combine_chunks()
        word, n = got.column("word").combine_chunks(), got.column("n").to_numpy()
        buffer, offsets = bytes_of(word) if len(word) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        if not len(n):
            return cls(np.zeros(0, np.uint64), np.zeros(0))
        hashes = range_hashes(buffer.astype(np.uint64), offsets[:-1], offsets[1:])
        cost = level.costs(buffer[offsets[:-1]], n, spelling_costs(_lines(word), symbol_table(), log_p))
        order = np.argsort(hashes)
        return cls(hashes[order], cost[order])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes it has, and their costs."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.cost[at]


def _sharded(words: DataFrame) -> DataFrame:
    """shard, payload (hashes and counts) of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = bytes_of(batch.column("word"))
            hashes, n = range_hashes(buffer.astype(np.uint64), offsets[:-1], offsets[1:]), batch.column("n").to_numpy()
            order = np.argsort(hashes)
            hashes, n = hashes[order], n[order]
            cut = np.searchsorted(hashes >> np.uint64(64 - SHARD_BITS), np.arange(SHARDS + 1))
            own = [s for s in range(SHARDS) if cut[s] < cut[s + 1]]
            packed = [hashes[cut[s] : cut[s + 1]].tobytes() + np.minimum(n[cut[s] : cut[s + 1]], 2**32 - 1).astype(np.uint32).tobytes() for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], names=["shard", "payload"])

    return arrow_batches(words).mapInArrow(run, "shard int, payload binary")


def _tail_costs(postings: DataFrame, words: DataFrame, level: WordLevel, log_p: np.ndarray) -> DataFrame:
    """block, at, cost: the cost of each document's words that were sent to the shards.

    A task has the counts of one shard, and the postings of that shard stream past. With more shuffle partitions than shards, blocks are dealt to several tasks of a shard, which
    have the counts each.
    """
    spark = postings.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    counts = _sharded(words).select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("block"), "payload")
    asked = postings.select("shard", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "payload")
    dealt = counts.unionByName(asked).repartition(SHARDS * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "block")
    shared = spark.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, spelled = symbol_table(), shared.value
        key, held, known, n = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            blocks, docs, sums = [], [], []
            for shard, salt, block, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "block", "payload")), strict=True):
                if key != (shard, salt):
                    key, held, known, n = (shard, salt), [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if block < 0:
                    half = len(payload) // 12 * 8
                    held.append((np.frombuffer(payload[:half], np.uint64), np.frombuffer(payload[half:], np.uint32).astype(np.int64)))
                    continue
                if held:
                    known, n = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(known)
                    known, n, held = known[order], n[order], []
                letters, size, word, doc, count = _open(payload)
                ends = np.cumsum(size)
                hashes = range_hashes(letters.astype(np.uint64), ends - size, ends)
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                own = np.where(known[place] == hashes, n[place], 0) if len(known) else np.zeros(len(size), np.int64)
                lined = np.full(len(letters) + len(size), 10, np.uint8)
                lined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
                cost = level.costs(letters[ends - size], own, spelling_costs(lined.tobytes(), table, spelled))
                found, at = np.unique(doc, return_inverse=True)
                blocks.append(block)
                docs.append(found.astype(np.uint16).tobytes())
                sums.append(np.bincount(at, cost[word] * count).astype(np.float32).tobytes())
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], names=["block", "docs", "sums"])

    return _added(arrow_batches(dealt).mapInArrow(run, "block long, docs binary, sums binary"))


def _added(parted: DataFrame) -> DataFrame:
    """block, at, cost: sums over the shards' lists (block, docs, sums)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lists in zip(batch.column("block").to_pylist(), batch.column("x").to_pylist(), strict=True):
                lists = sorted((x["docs"], x["sums"]) for x in lists)  # in an order that doesn't depend on tasks
                doc = np.concatenate([np.frombuffer(x, np.uint16) for x, _ in lists]).astype(np.int64)
                total = np.bincount(doc, np.concatenate([np.frombuffer(x, np.float32) for _, x in lists]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), block)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["block", "at", "cost"])

    # a block has a list for each shard, and each part of a long text
    return arrow_batches(parted.groupBy("block").agg(F.collect_list(F.struct("docs", "sums")).alias("x"))).mapInArrow(add, "block long, at int, cost double")


def score_documents(docs: DataFrame, trusted: DataFrame, held_out: int = 5, order: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, h (hash of the text), lang, n_words, n_chars, nll (-log of the probability of its words), role.

    order: 2 for words after words (word_pairs), as the classifier has it, or 1 for words above spellings only.
    role: 1 of trusted documents that the model is fitted on, 2 of trusted ones that are held out of it (one in `held_out`, by the hash of the id), else 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    known = trusted.select(F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct()
    known = materialize(known.withColumn("_role", F.when(F.pmod(F.xxhash64(F.lit("held out"), "_id"), F.lit(held_out)) == 0, 2).otherwise(1)), "kn-trusted")
    ids = known.where("_role = 1").select("_id")
    if order == 2:
        from contextquarry.llm.word_pairs import score_rows

        scored = score_rows(rows, lambda make, fields: _with_ids(rows, ids, make, fields))
    else:
        counted = _with_ids(rows, ids, _fit_counts, "word binary, n long")
        words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "kn-words")
        level, log_p = word_level(words), spelling(words)
        postings = materialize(_postings(rows, Head.of(words, level, log_p)), "kn-postings")
        costs = _tail_costs(postings.where("shard IS NOT NULL").select("block", "shard", "payload"), words, level, log_p)
        about = postings.where("shard IS NULL").select("block", F.posexplode(F.arrays_zip("ids", "h", "lang", "n_words", "n_chars", "nll")).alias("at", "d"))
        about = about.select("block", "at", F.col("d.ids").alias("doc_id"), "d.h", "d.lang", "d.n_words", "d.n_chars", "d.nll")
        scored = about.join(costs, ["block", "at"], "left").withColumn("nll", F.col("nll") + F.coalesce("cost", F.lit(0.0)))
    # ids, without texts, meet by a shuffle
    scored = scored.join(known.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    return scored.select("doc_id", "h", "lang", "n_words", "n_chars", "nll", F.coalesce("_role", F.lit(0)).alias("role"))


def judge(scored: DataFrame, quantile: float = 0.99, margin: float = 0.05, prior: int = 60) -> DataFrame:
    """scored with score, limit and kept; see classify. Rows of score_documents."""
    scored = materialize(scored, "kn-scores", free=True)
    trusted = scored.where("role > 0 AND n_chars > 0")
    # thresholds come from held-out documents; of all trusted ones only where none is held out
    means = trusted.groupBy("lang").agg((F.sum("nll") / F.sum("n_chars")).alias("mean"), F.max("role").alias("judged"))
    overall = trusted.agg((F.sum("nll") / F.sum("n_chars")).alias("mean"), F.max("role").alias("judged")).first()
    means = materialize(means, "kn-means")  # a row for each language
    score = (F.col("nll") + F.coalesce("mean", F.lit(overall["mean"] or 0.0)) * prior) / (F.col("n_chars") + prior)
    own = means.select(F.col("lang").alias("_l"), "mean", "judged")
    rows = scored.join(own, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l").withColumn("score", score).drop("mean")
    ranked = rows.where("role > 0 AND n_chars > 0")
    at = lambda: F.percentile_approx("score", quantile, 10_000) + margin
    every = ranked.where(F.col("role") == (overall["judged"] or 0)).agg(at().alias("limit")).first()["limit"]
    limits = materialize(ranked.where("role = judged").groupBy(F.col("lang").alias("_l")).agg(at().alias("_limit")), "kn-limits")
    rows = rows.drop("judged").join(limits, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    limit = F.coalesce("_limit", F.lit(float("inf") if every is None else every))
    return rows.withColumn("limit", limit).drop("_limit").withColumn("kept", F.col("score") <= F.col("limit"))


def classify(docs: DataFrame, trusted: DataFrame, held_out: int = 5, **options) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_words, n_chars, perplexity, threshold, kept.

    trusted: doc_id of trusted documents. Four in five of their texts, whole, train the model. The score is the mean of -log p per
    character (a word's end is one), where `prior` characters at the mean of the language's trusted documents are added, so a few characters don't
    condemn a short text; perplexity is its exponential. A document is kept if its score is at most the quantile of the scores of the held-out trusted documents in its language, plus
    margin (in nats per character); languages without any use all trusted ones, and languages without trusted documents, perhaps null, the threshold of all languages. Without any, all are kept.

    Null and empty texts have the mean score and are kept. Repeated ids and rows get a result each. Null ids are never
    trusted. Extra columns are ignored; an empty table gives no rows.
    """
    got = judge(score_documents(docs, trusted, held_out, order=2), **options)
    return got.select("doc_id", "lang", "n_words", "n_chars", F.exp("score").alias("perplexity"), F.exp("limit").alias("threshold"), "kept")


def good_documents(docs: DataFrame, trusted: DataFrame, held_out: int = 5, **options) -> DataFrame:
    """The rows of docs that the classifier keeps; same columns as docs. Rows go by their id, language and text."""
    bad = judge(score_documents(docs, trusted, held_out, order=2), **options).where("NOT kept").select(F.col("doc_id").alias("__cq_id"), F.col("h").alias("__cq_h"), F.col("lang").alias("__cq_lang")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__cq_id")) & (F.xxhash64(docs["text"]) == F.col("__cq_h")) & docs["lang"].cast("string").eqNullSafe(F.col("__cq_lang"))
    return docs.hint("merge").join(bad, same, "left_anti")


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_ids(spark, sf_dir))
