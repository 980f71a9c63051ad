"""Source divergence audit: how far the sources of a language are apart, by tiles of pairs of groups."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize
from contextquarry.session import spread

#: Documents of its language that a kept term is in at least, what is added to each count, and what a share of one counts.
LEAST_DOCS, ADDED, UNIT = 30, 5, 1_000_000_000
TOP = 50
#: Terms of a chunk and groups of a block, about; neighbouring chunks of one task.
CHUNK, BLOCK, SPAN = 4096, 32, 16
#: Different terms of groups that a task holds before it passes them on, and bytes of a text that are split at once.
HELD, PIECE = 200_000, 1 << 20

#: A-Z in small letters; everything else of ASCII but letters parts terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, begin = text.translate(_LETTERS), 0
    while begin < len(text):
        end = text.find(b" ", begin + PIECE)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, d: occurrences and documents, summed over the task up to a bound."""
    many: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in many.items():
            d, size = docs[lang, source], len(n)
            columns = [pa.array([v] * size, pa.string()) for v in (lang, source)]
            columns += [pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])
        many.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            n, seen = many[lang, source], set()
            before = len(n)
            for words in _pieces(text.as_py()):
                n.update(words)
                seen.update(words)
            docs[lang, source].update(seen)
            held += len(n) - before
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / total), in three steps of long division: exact for totals below 9e15."""
    rest, whole = count + ADDED, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", rest, total), rest % total
    return whole + 1


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """share for a matrix of counts, a row per group."""
    rest, whole = counts + ADDED, np.zeros_like(counts)
    for _ in range(3):
        rest *= 1000
        whole = whole * 1000 + rest // totals
        rest %= totals
    return whole + 1


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value: the summed differences of each pair of groups of a tile over the chunks of a span. Rows come by tile, chunk, block and source."""
    tile = chunk = total = None
    rows: list[tuple] = []  # of the chunk: block, source, total, slots, counts

    def add() -> None:
        """The chunk's part of the tile's submatrix."""
        nonlocal total
        counts = np.zeros((len(rows), width), np.int64)
        for k, (_, _, _, slots, n) in enumerate(rows):
            counts[k, slots] = n
        p = _shares(counts, np.array([r[2] for r in rows], np.int64)[:, None]) if width else counts
        left = sum(r[0] == tile[1] for r in rows)
        right = 0 if tile[1] == tile[2] else left
        part = np.zeros((left, len(rows) - right), np.int64)
        for i in range(left):
            part[i] = np.abs(p[right:] - p[i]).sum(axis=1)
        total = ([r[1] for r in rows[:left]], [r[1] for r in rows[right:]], part if total is None else total[2] + part)

    def done() -> pa.RecordBatch:
        one, other, values = total
        at = np.triu_indices(len(one), 1) if tile[1] == tile[2] else np.indices(values.shape).reshape(2, -1)
        columns = [pa.array([tile[0]] * len(at[0]), pa.string()), pa.array([one[i] for i in at[0]], pa.string()), pa.array([other[j] for j in at[1]], pa.string()), pa.array(values[at[0], at[1]], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    width = 0
    for batch in batches:
        slots, n = batch.column("slots"), batch.column("n")
        keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "x", "y", "span", "chunk", "block", "source", "total", "width")), strict=True)
        for i, (*t, c, block, source, sum_of, w) in enumerate(keys):
            if (t, c) != (tile, chunk):
                if rows:
                    add()
                    rows.clear()
                if t != tile:
                    if total is not None:
                        yield done()
                    total = None
                tile, chunk, width = t, c, w
            rows.append((block, source, sum_of, np.asarray(slots[i].values or [], np.int64), np.asarray(n[i].values or [], np.int64)))
    if rows:
        add()
        yield done()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the groups (lang, source) of documents apart.

    Terms are runs of letters and of characters beyond ASCII, A-Z in small letters. A language keeps the V terms that are in at least least_docs of its documents. In a group with N kept terms, a term of
    count n has the share p = 1 + floor(1e9 * (n + 5) / (N + 5V)); q is that of the whole language. Part `pair`: for each other source of the language, the sum of differences of p over
    all kept terms. Part `term`: the `top` terms of the group with the greatest p - q, above zero.

    Counts are packed in vectors, one per group and chunk of the vocabulary. Groups are dealt to blocks, and a task has a pair of blocks and a span of chunks: it gets the
    vectors of both blocks, and passes over its chunks one by one. A hot group is no longer than its vocabulary.

    Null texts, languages and sources are empty. Each row is a document, repeated ones too. A group without terms has its pairs; a language without kept terms has values of 0. Very long texts are
    split piece by piece. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    named = docs.select(of("lang"), of("source"), F.col("text").cast("binary").alias("text"))
    found = arrow_batches(spread(named.where("text <> X''"))).mapInArrow(_terms, "lang string, source string, term string, n long, d long")
    counts = materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")

    common = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
    common = materialize(common, "common-terms")
    langs = common.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    every = named.groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one")
    blocks = every.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    langs = blocks.join(langs, "lang", "left").na.fill(0, ["v", "lang_n"]).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)).cast("int"))
    langs = materialize(langs.withColumn("lang_total", F.col("lang_n") + ADDED * F.col("v")), "languages")

    placed = common.join(langs.select("lang", "chunks", "lang_total"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    places = placed.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    places = materialize(places.select("lang", "term", "chunk", "slot", share(F.col("all_n"), F.col("lang_total")).alias("q")), "vocabulary")
    kept = materialize(counts.drop("d").join(places, ["lang", "term"]), "kept-counts")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = every.join(sums, ["lang", "source"], "left").join(langs.select("lang", "v", "blocks", "chunks"), "lang")
    groups = groups.withColumn("total", F.coalesce("group_n", F.lit(0)) + ADDED * F.col("v")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).drop("group_n", "v")
    groups = materialize(groups, "groups")

    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("slot", "n")).alias("_p")).select("lang", "source", "chunk", F.col("_p.slot").alias("slots"), F.col("_p.n").alias("n"))
    widths = places.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("width"))
    vectors = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(packed, ["lang", "source", "chunk"], "left").join(widths, ["lang", "chunk"], "left")
    other = vectors.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    sent = other.select(
        "lang", F.least("block", "_other").alias("x"), F.greatest("block", "_other").alias("y"), F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "block", "source", "total",
        F.coalesce("width", F.lit(0)).alias("width"), none("slots", "int"), none("n", "bigint"),
    )
    tile = ["lang", "x", "y", "span"]
    dealt = sent.repartition(parts, *tile).sortWithinPartitions(*tile, "chunk", (F.col("block") != F.col("x")).cast("int"), "source")
    sides = arrow_batches(dealt).mapInArrow(_tiles, "lang string, a string, b string, value long")
    sums = sides.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    above = kept.join(groups.select("lang", "source", "total"), ["lang", "source"]).withColumn("value", share(F.col("n"), F.col("total")) - F.col("q"))
    terms = above.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
common AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN common c ON c.lang = w.lang AND c.term = w.term GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM common GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
grid AS (
  SELECT g.lang, g.source, c.term, coalesce(n.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(n.n, 0) + {ADDED})) // (g.total + {ADDED} * l.v)::HUGEINT AS p,
         1 + ({UNIT}::HUGEINT * (c.n + {ADDED})) // (l.total + {ADDED} * l.v)::HUGEINT AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN common c ON c.lang = g.lang LEFT JOIN counts n ON n.lang = g.lang AND n.source = g.source AND n.term = c.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
