"""One key with most of the rows: rows without id, repeated ids, repeated items."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contextquarry.llm import decontaminate, jaccard_join, mixing, sharding, substring_dedup
from contextquarry.scratch import materialize

ITEM = "A farmer named Peter sells 12 apples and 7 pears to Maria for 30 dollars each week and then walks home with 5 friends at night"


def test_decontamination_of_an_item_thousands_of_times(spark):
    text = " ".join(ITEM.replace("12", str(12 + k % 977)).replace("30", str(30 + k % 311)) for k in range(5000))
    docs = spark.createDataFrame([(5, text), (6, "Nothing of it. " * 2000), (7, ITEM)], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in decontaminate.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    assert set(got) == {5, 7}
    assert got[7].coverage == 1 and got[5].coverage > 0.5


def brute_conflicts(pairs):
    """Which pairs of values stand: of those that share a value on one side and differ on the other, the commonest."""
    n = Counter(pairs)

    def beats(o, k):
        return o[0] == k[0] and (o[1] == k[1]) != (o[2] == k[2]) and (-n[o], o[1], o[2]) < (-n[k], k[1], k[2])

    return {k for k in n if not any(beats(o, k) for o in n)}


def test_decontamination_finds_conflicts_as_brute_force_does(spark):
    """Documents with an item several times, its values swapped, shared or repeated: the matched windows are those without a lost pair."""
    rng = random.Random(11)
    values = ["3", "4", "5", "6"]
    item = "take {} plus red boxes and put {} under the old table near {} quiet green chairs"
    own = item.format("3", "4", "5")
    docs = []
    for i in range(40):
        docs.append((i, " . ".join(item.format(*(rng.choice(values) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
    got = {r.doc_id: r.n_matched for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, own)], "item_id long, text string"), coverage=1e-9).collect()}
    words = own.split()
    places = [i for i, w in enumerate(words) if w.isdigit()]
    windows = [i for i in range(len(words) - 7) if sum(not w.isdigit() for w in words[i : i + 8]) >= 4]
    for i, text in docs:
        copies = [c.split() for c in text.split(" . ")]
        stand = brute_conflicts([("n", words[p], c[p]) for c in copies for p in places])
        matched = {w for w in windows for c in copies if all(("n", words[p], c[p]) in stand for p in places if w <= p < w + 8)}
        assert got.get(i, 0) == len(matched), text


@pytest.mark.parametrize("ids", ["NULL", "7"])
def test_wanted_segments_are_linear_in_rows_of_one_id(spark, ids):
    def wanted(n):
        docs = spark.range(n).select(F.expr(ids).cast("long").alias("_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(79)), lambda k: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), k.cast("string")))).alias("body"))
        docs = docs.select("_id", F.concat_ws(" ", "body", F.lit(" ".join(f"shared{k}" for k in range(60)))).alias("text"))
        docs = docs.select("_id", F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("text"))
        found = substring_dedup._occurrences(docs, 12, substring_dedup.np.zeros(0, "uint64"))
        want = materialize(substring_dedup._wanted(substring_dedup._kinds(found)), "wanted")
        asked = docs.join(want, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")))
        return asked.agg(F.sum(F.size("want"))).first()[0]

    few, many = wanted(50), wanted(200)
    assert many <= 4.2 * few


@pytest.mark.parametrize("ids", ["NULL", "7"])
def test_keys_of_rows_of_one_id_spread(spark, ids):
    """Mixing and sharding deal rows without id, or of one id, to buckets by their texts."""
    docs = spark.range(12_000).select(F.expr(ids).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(docs)
    assert mixed.count() == 12_000
    assert mixed.agg(F.sum("taken")).first()[0] == 36_000
    got = sharding.shard_documents(docs).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"), F.sum("size").alias("bytes")).collect()
    assert all(r.n == r.slots == r["last"] + 1 for r in got)
    assert max(r.bytes for r in got) - min(r.bytes for r in got) < 1000


def test_near_copies_of_a_long_text_are_compared_in_small_blocks(spark, monkeypatch):
    """A bucket of few sets is cut, too, where they have many shingles."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.choice([0, 5, 60])):
            words[rng.randrange(3000)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect())
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 20_000)
    seen = []
    screened = jaccard_join._screened
    monkeypatch.setattr(jaccard_join, "_screened", lambda rows, t: seen.append(rows.groupBy("node", "left", "right").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0]) or screened(rows, t))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()) == want
    assert seen[0] < 80_000 < 40 * 2996
