"""Benchmark decontamination: windows of templates, and the values that fill their slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextquarry.llm.common import SPACES, materialize

WINDOW = 8
#: Words of a window that are no slots, at least; for windows of fewer words, half of them.
LITERALS = 4
#: Share of an item's windows that a document must have, wherever they stand in it.
COVERAGE = 0.25
#: Benchmark windows that are broadcast at most (about 40 MB); more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000

PUNCTUATION = ".,;:!?\"'()[]{}<>*&%$#|€£+-"
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres second seconds sec minute minutes min hour hours h day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh km/h m/s watt watts volt volts joule joules meter meters metre metres"
).split()
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def templates(df: DataFrame) -> DataFrame:
    """Add plain (words in small letters, without punctuation around them), slots (the words' templates) and heads (slots, but names as they are).

    A number begins with a digit, perhaps after a sign or currency, and may end in a few letters. A unit is one of UNITS. A name begins with a capital and
    follows a word that doesn't end a sentence; the first word of a window has no known predecessor, so there it is a plain word.
    """
    mark = F.lit(PUNCTUATION)
    df = df.withColumn("_words", _words(F.col("text")))

    def plain(w: Column) -> Column:
        bare = F.btrim(F.lower(w), mark)
        return F.when(bare == "", w).otherwise(bare)

    def slot(w: Column, i: Column) -> Column:
        bare = F.get("plain", i)
        number = (bare >= "0") & (bare < ":") & bare.rlike(r"^[0-9][0-9.,:/%]*[a-z°]{0,4}$")
        before = F.get("_words", i - 1)
        first = F.substring(F.btrim(w, mark), 1, 1)
        name = (w != F.lower(w)) & (i > 0) & (first != F.lower(first)) & ~F.right(before, F.lit(1)).isin(".", "!", "?", ":")
        return F.when(number, NUMBER).when(bare.isin(UNITS), UNIT).when(name, NAME).otherwise(bare)

    df = df.withColumn("plain", F.transform("_words", plain)).withColumn("slots", F.transform("_words", slot)).drop("_words")
    return df.withColumn("heads", F.zip_with("slots", "plain", lambda s, p: F.when(s == NAME, p).otherwise(s)))


def _keys(length: int) -> Column:
    """The hash of each window of the length, by its start."""

    def key(i: Column) -> Column:
        return F.xxhash64(F.lit(length), F.get("heads", i), *(F.get("slots", i + k) for k in range(1, length)))

    return F.when(F.size("slots") >= length, F.transform(F.sequence(F.lit(0), F.size("slots") - length), key)).otherwise(F.array().cast("array<long>"))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """key, item_id, at, size, n_windows. Items shorter than the window are one window of their own length. Windows with too few literal words are no evidence and don't count."""
    spec = items.withColumn("size", F.least(F.size("slots"), F.lit(window))).where("size > 0")
    every = None
    for length in range(1, window + 1):
        of = spec.where(F.col("size") == length).select("item_id", "size", "slots", F.posexplode(_keys(length)).alias("at", "key"))
        literal = F.size(F.filter(F.slice("slots", F.col("at") + 1, length), lambda s: ~s.isin(NUMBER, UNIT, NAME)))
        of = of.where(literal >= min(LITERALS, -(-length // 2))).select("key", "item_id", "at", "size")
        every = of if every is None else every.unionByName(of)
    sizes = every.groupBy(F.col("item_id").alias("_i")).agg(F.count(F.lit(1)).alias("n_windows"))
    return every.join(sizes, F.col("item_id") == F.col("_i")).drop("_i")


def _place(at: Column, shift: Column) -> Column:
    return F.shiftleft(shift.cast("long"), 32) + at.cast("long")


def _at(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1))


def _reach(places: str, first: Column | int, last: Column | int) -> Column:
    """The places from `first` to `last` after each of a list, each once."""
    whole = lambda c: c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long")
    return F.array_distinct(F.flatten(F.transform(places, lambda x: F.sequence(x + whole(first), x + whole(last)))))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, n_matched, coverage, n_slots, reworded.

    Windows of the documents' templates meet those of the items by hash, at whatever distance of positions, so words put in between don't matter. Slots
    have to be consistent: equal values of the item became equal values of the document, and different ones different. Where values conflict,
    the pair of values that fills most slots stands, and windows that hold another one don't count. What is left must have the share `coverage` of
    the item's windows. n_matched: these; n_slots: slots of the item in them; reworded: some value differs. Of repeated items or texts of an id, that with most windows is reported.

    Null and empty texts match nothing, nor do items of slots only. Repeated rows of a document give one result; null ids stay null. Items with a null id are
    left out, and of repeated item ids all texts count as one item's. Extra columns don't matter; empty tables give no rows.
    """
    best = F.max(F.struct("n_matched", "coverage", "n_slots", (~F.col("reworded")).alias("same")))
    result = _alignments(docs, benchmark, window, coverage).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return result.select("doc_id", "item_id", "b.n_matched", F.round("b.coverage", 6).alias("coverage"), "b.n_slots", (~F.col("b.same")).alias("reworded"))


def _alignments(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The columns of leaks and h, the hash of the document's text: one row for each document and item's text that count."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", "text").distinct()
    items = materialize(templates(items).select("item_id", F.xxhash64("text").alias("_t"), "plain", "slots", "heads"), "items")
    wanted = materialize(_item_windows(items.withColumn("item_id", F.struct("item_id", "_t")), window), "item-windows")
    n = wanted.count()
    short = [r[0] for r in wanted.where(F.col("size") < window).select("size").distinct().collect()]  # fewer than `window` values
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    told = templates(rows)
    if short:
        keys = F.flatten(F.array(*(F.transform(_keys(k), lambda x, i: F.struct(i.alias("at"), x.alias("key"))) for k in [*sorted(short), window])))
        found = told.select("_id", "_h", F.explode(keys).alias("w")).select("_id", "_h", F.col("w.at").alias("pos"), F.col("w.key").alias("key"))
    else:
        found = told.select("_id", "_h", F.posexplode(_keys(window)).alias("pos", "key"))
    small = F.broadcast(wanted) if n <= BROADCAST_WINDOWS else wanted
    met = found.join(small, "key").withColumn("shift", F.col("pos") - F.col("at"))
    # a place is one long, (shift << 32) + position in the item: sets of longs are hashed, however often a document repeats an item
    grouped = met.groupBy("_id", "_h", "item_id", "n_windows", "size").agg(F.collect_set(_place(F.col("at"), F.col("shift"))).alias("windows"))
    enough = lambda windows: F.size(F.array_distinct(F.transform(windows, _at))) >= F.greatest(F.lit(1), F.ceil(F.col("n_windows") * coverage))
    grouped = materialize(grouped.where(enough("windows")), "alignments")
    texts = items.select(F.struct("item_id", "_t").alias("item_id"), F.col("plain").alias("_plain"), F.col("slots").alias("_slots"))
    grouped = grouped.withColumn("_covered", _reach("windows", 0, F.col("size") - 1)).join(texts, "item_id")
    # rejoined at every size in the same way: matches may be many
    whole = rows.withColumnRenamed("_id", "_i").withColumnRenamed("_h", "_g")
    own = whole.hint("merge").join(grouped, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_g") == F.col("_h"))).dropDuplicates(["_id", "_h", "item_id"])
    # written, so that words are split once per row and not in each step of the functions below
    own = materialize(own.withColumn("_words", _words(F.col("text"))).drop("text"), "aligned-words")

    def pair(place: Column) -> Column:
        word = F.get("_words", (_at(place) + F.shiftright(place, 32)).cast("int"))
        bare = F.btrim(F.lower(word), F.lit(PUNCTUATION))
        p = _at(place).cast("int")
        return F.struct(place.alias("place"), F.get("_slots", p).alias("slot"), F.get("_plain", p).alias("item"), F.when(bare == "", word).otherwise(bare).alias("doc"))

    filled = F.filter(F.transform("_covered", pair), lambda x: x["slot"].isin(NUMBER, UNIT, NAME))
    own = own.select("_id", "_h", "item_id", "windows", "size", "n_windows", filled.alias("filled"), F.monotonically_increasing_id().alias("_row"))
    own = materialize(own, "slots")
    fills = own.select("_row", F.explode("filled").alias("x")).select("_row", "x.*")
    pair_of = ["_row", "slot", "item", "doc"]
    kinds = fills.groupBy(*pair_of).agg(F.count(F.lit(1)).alias("n"))
    # of the pairs that share the item's value, or the document's, only the first can stand
    best = lambda side: F.row_number().over(Window.partitionBy("_row", "slot", side).orderBy(F.desc("n"), "item", "doc"))
    lost = kinds.select("*", best("item").alias("_a"), best("doc").alias("_b")).where("_a > 1 OR _b > 1").select(*pair_of)
    bad = fills.join(lost, pair_of).groupBy(F.col("_row").alias("_r")).agg(F.collect_list("place").alias("_bad"))
    own = own.join(bad, F.col("_row") == F.col("_r"), "left").withColumn("_bad", F.coalesce("_bad", F.array().cast("array<bigint>")))
    own = materialize(own.withColumn("windows", F.array_except("windows", _reach("_bad", 1 - F.col("size"), 0))).drop("_bad", "_row", "_r"), "kept-windows").where(enough("windows"))
    own = own.withColumn("_covered", _reach("windows", 0, F.col("size") - 1))
    n = F.size(F.array_distinct(F.transform("windows", _at)))
    slots = F.array_intersect(F.col("filled.place"), F.col("_covered"))
    changed = F.filter("filled", lambda x: x["item"] != x["doc"])["place"]
    return own.select(
        F.col("_id").alias("doc_id"),
        F.col("_h").alias("h"),
        F.col("item_id.item_id").alias("item_id"),
        n.cast("long").alias("n_matched"),
        (n / F.col("n_windows")).alias("coverage"),
        F.size(F.array_distinct(F.transform(slots, _at))).cast("long").alias("n_slots"),
        F.arrays_overlap(changed, F.col("_covered")).alias("reworded"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no item is found; same columns as docs. Rows go by their id and text, so others of the same id, or without one, stay."""
    found = _alignments(docs, benchmark, **options).select(F.col("doc_id").alias("__cq_id"), F.col("h").alias("__cq_h")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__cq_id")) & (F.xxhash64(docs["text"]) == F.col("__cq_h"))
    return docs.hint("merge").join(found, same, "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _canon_sql(table: str, key: str) -> str:
    mark = PUNCTUATION.replace("'", "''")
    units = ", ".join(f"'{u}'" for u in UNITS)
    slots = ", ".join(f"lead(slot, {k}) OVER p AS s{k}" for k in range(1, WINDOW))
    joined = " || ' ' || ".join(["head", *(f"s{k}" for k in range(1, WINDOW))])
    literal = " + ".join(f"(s{k} NOT IN ('{NUMBER}', '{UNIT}', '{NAME}'))::INT" for k in range(1, WINDOW))
    return rf"""
{table}_words AS (
  SELECT k, i, w, lag(w) OVER (PARTITION BY k ORDER BY i) AS before
  FROM (SELECT {key} AS k, unnest(ws) AS w, unnest(range(len(ws))) AS i
        FROM (SELECT {key}, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM {table} WHERE text IS NOT NULL))),
{table}_plain AS (
  SELECT *, CASE WHEN trim(lower(w), '{mark}') = '' THEN w ELSE trim(lower(w), '{mark}') END AS plain, trim(w, '{mark}')[1:1] AS c FROM {table}_words),
{table}_slots AS (
  SELECT *, CASE WHEN regexp_matches(plain, '^[0-9][0-9.,:/%]*[a-z°]{{0,4}}$') THEN '{NUMBER}' WHEN plain IN ({units}) THEN '{UNIT}'
                 WHEN w <> lower(w) AND i > 0 AND c <> lower(c) AND before[-1:] NOT IN ('.', '!', '?', ':') THEN '{NAME}' ELSE plain END AS slot
  FROM {table}_plain),
{table}_windows AS (
  SELECT k, i, {joined} AS key, (slot NOT IN ('{NUMBER}', '{UNIT}', '{NAME}'))::INT + {literal} AS literals
  FROM (SELECT *, CASE WHEN slot = '{NAME}' THEN plain ELSE slot END AS head, {slots} FROM {table}_slots WINDOW p AS (PARTITION BY k ORDER BY i)))"""


OP1_SQL = f"""
WITH {_canon_sql("documents", "doc_id")}, {_canon_sql("benchmark", "item_id")},
wanted AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM benchmark_windows WHERE key IS NOT NULL AND literals >= {LITERALS}),
met AS (SELECT DISTINCT d.k AS doc_id, b.k AS item_id, d.i - b.i AS shift, b.i AS place, b.n FROM documents_windows d JOIN wanted b ON d.key = b.key),
candidates AS (SELECT doc_id, item_id FROM met GROUP BY doc_id, item_id, n HAVING count(DISTINCT place) >= greatest(1, ceil(n * {COVERAGE}))),
filled AS (
  SELECT DISTINCT m.doc_id, m.item_id, m.shift, b.i, b.slot, b.plain AS item, d.plain AS doc
  FROM met m JOIN candidates c ON c.doc_id = m.doc_id AND c.item_id = m.item_id
  JOIN benchmark_slots b ON b.k = m.item_id AND b.slot IN ('{NUMBER}', '{UNIT}', '{NAME}') AND b.i BETWEEN m.place AND m.place + {WINDOW - 1}
  JOIN documents_slots d ON d.k = m.doc_id AND d.i = b.i + m.shift),
kinds AS (SELECT doc_id, item_id, slot, item, doc, count(*) AS n FROM filled GROUP BY ALL),
lost AS (
  SELECT k.* FROM kinds k WHERE EXISTS (
    SELECT 1 FROM kinds o WHERE o.doc_id = k.doc_id AND o.item_id = k.item_id AND o.slot = k.slot AND (o.item = k.item) <> (o.doc = k.doc)
    AND (o.n > k.n OR (o.n = k.n AND (o.item < k.item OR (o.item = k.item AND o.doc < k.doc)))))),
bad AS (SELECT f.* FROM filled f JOIN lost l ON l.doc_id = f.doc_id AND l.item_id = f.item_id AND l.slot = f.slot AND l.item = f.item AND l.doc = f.doc),
kept AS (
  SELECT m.* FROM met m JOIN candidates c ON c.doc_id = m.doc_id AND c.item_id = m.item_id
  WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = m.doc_id AND b.item_id = m.item_id AND b.shift = m.shift AND b.i BETWEEN m.place AND m.place + {WINDOW - 1})),
counts AS (SELECT doc_id, item_id, n, count(DISTINCT place) AS n_matched FROM kept GROUP BY ALL HAVING count(DISTINCT place) >= greatest(1, ceil(n * {COVERAGE}))),
slots AS (
  SELECT f.doc_id, f.item_id, count(DISTINCT f.i) AS n_slots, bool_or(f.item <> f.doc) AS reworded FROM filled f
  WHERE EXISTS (SELECT 1 FROM kept m WHERE m.doc_id = f.doc_id AND m.item_id = f.item_id AND m.shift = f.shift AND f.i BETWEEN m.place AND m.place + {WINDOW - 1}) GROUP BY ALL)
SELECT c.doc_id, c.item_id, c.n_matched, round(c.n_matched / c.n, 6) AS coverage, coalesce(s.n_slots, 0) AS n_slots, coalesce(s.reworded, false) AS reworded
FROM counts c LEFT JOIN slots s ON s.doc_id = c.doc_id AND s.item_id = c.item_id
"""
