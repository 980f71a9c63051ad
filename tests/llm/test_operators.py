"""The corpus operators against brute force on a small odd table."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextquarry.llm import decontaminate, exact_dedup, jaccard_join, mixing, packing, quality, secrets, sharding, substring_dedup, toxicity, word_pairs
from contextquarry.llm.components import components
from contextquarry.llm.fm_index import FMIndex

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return SPLIT.findall(text or "")


def test_exact_dedup(odd, empty, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_dedup(odd).collect()
    want = Counter((r[0], max((i for i in groups[r[1] or ""] if i is not None), default=None), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id or r.doc_id is None) for r in got)
    assert not exact_dedup.exact_dedup(empty).collect()


def test_exact_dedup_of_groups_with_null_ids(spark):
    rows = [(1, "a"), (None, "a"), (5, "a"), (None, "b"), (None, "b")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.kept) for r in got) == Counter([(1, 5, False), (None, 5, False), (5, 5, True), (None, None, True), (None, None, True)])


def test_exact_dedup_group_over_many_partitions(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "same text").otherwise(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(docs, partitions=9).where("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(399 if 399 % 3 < 2 else 397, 267)]


def test_substring_dedup(odd, empty, rows):
    window = 12
    count = Counter(tuple(w[i : i + window]) for w in (split(r[1]) for r in rows) for i in range(len(w) - window + 1))
    want = Counter()
    for r in rows:
        w = split(r[1])
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want[(r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    for hot in (4096, 0):
        got = substring_dedup.remove_repeats(odd, window, hot_segments=hot, shard_words=500).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert not substring_dedup.remove_repeats(empty).collect()


def test_fm_index_gives_matching_statistics():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 5, 35):
        texts = [rng.integers(1, 4, rng.integers(0, 90)) for _ in range(30)]
        weights = rng.integers(1, 3, 30)
        count = Counter()
        for t, w in zip(texts, weights, strict=True):
            for n in range(1, depth + 1):
                for i in range(len(t) - n + 1):
                    count[tuple(t[i : i + n])] += w
        # the texts themselves, and documents that the index doesn't hold, with symbols that it doesn't know
        foreign = [rng.integers(1, 6, rng.integers(0, 60)) for _ in range(10)] + [np.concatenate([texts[3][5:40], [9], texts[4]]), np.array([7, 7])]
        index = FMIndex(texts, weights, depth)
        for t, (lengths, found) in zip([*texts, *foreign], index.matching([*texts, *foreign]), strict=True):
            for i in range(len(t)):
                n = max((k for k in range(min(depth, len(t) - i) + 1) if k == 0 or count[tuple(t[i : i + k])]), default=0)
                assert (lengths[i], found[i]) == (n, count[tuple(t[i : i + n])] if n else 0)
    assert FMIndex([], np.zeros(0, int), 3).matching([np.array([1, 2])])[0][0].tolist() == [0, 0]


def brute_classes(rows):
    sets = {}
    for r in rows:
        w = split(r[1])
        sets.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset(), []).append(r[0])
    keys = list(sets)
    link = {i: {j for j in range(len(keys)) if i != j and keys[i] | keys[j] and len(keys[i] & keys[j]) >= 0.8 * len(keys[i] | keys[j])} for i in range(len(keys))}
    out = Counter()
    for i, k in enumerate(keys):
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [x for s in seen for x in sets[keys[s]] if x is not None]
        for d in sets[k]:
            out[(d, min(ids, default=None), len(link[i]), len(sets[k]))] += 1
    return out


def test_jaccard_join(odd, empty, rows):
    got = jaccard_join.jaccard_classes(odd).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_classes(rows)
    kept = jaccard_join.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert not jaccard_join.jaccard_classes(empty).collect()


def test_distinct_documents_by_content(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = a.replace("a59", "changed")
    # a null id in a class with an id, unique texts without id, an id of two texts, repeated rows, copies without any id
    rows = [(1, a), (None, near), (None, b), (2, near), (2, c), (3, c), (4, d), (4, d), (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in jaccard_join.distinct_documents(docs).collect())
    assert got == Counter([(1, a), (None, b), (2, c), (4, d), (None, "x y z")])


def test_jaccard_join_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    rows = []
    for i in range(24):  # near copies of one text
        w = list(base)
        w[int(rng.integers(0, 150))] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(24, 60):  # a common passage among other words
        rows.append((i, " ".join([*base[:60], *(f"y{x}" for x in rng.integers(0, 10**6, 90))])))
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_classes(rows)


def test_jaccard_join_of_many_near_copies(spark):
    """More near copies than a block holds, at all distances from their text, a quarter of them without an id."""
    rng = np.random.default_rng(11)
    base, rows = [f"w{x}" for x in rng.integers(0, 10**6, 64)], []
    for i in range(1200):
        w = list(base)
        for at in rng.integers(0, 64, int(rng.integers(1, 4))):
            w[at] = f"x{rng.integers(0, 400)}"
        rows.append((None if i % 4 == 0 else i, " ".join(w)))
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_classes(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 104)}


def test_components_of_long_chains(spark):
    at = np.random.default_rng(8).permutation(1000)
    edges = [(int(a), int(b)) for a, b in zip(at, at[1:])]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), rounds=15).collect()}
    assert got == dict.fromkeys(range(1000), 0)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=2)


def test_sharding(odd, empty, rows):
    got = sharding.shard_documents(odd, 3).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    places = defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        places[text[r.doc_id]].add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    assert not sharding.shard_documents(empty).collect()


def test_differencing_is_balanced():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.pareto(1.5, 3000) * 100 + 1).astype(int)[::-1]
    sums = np.bincount(sharding.differencing(sizes, 8), sizes, 8)
    assert sums.max() - sums.min() <= max(2, sizes[0] - sizes.sum() / 8)
    five = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(sharding.differencing(five, 2), five, 2)) == [14, 16]  # as the method is known to end
    assert len(sharding.differencing(np.array([], int), 4)) == 0 and len(sharding.differencing(np.array([5]), 4)) == 1


def test_differencing_is_the_textbook_method():
    """Lists of eight sums, sorted anew for each combination; sizes without ties."""
    rng = np.random.default_rng(5)
    sizes = rng.choice(10**6, 60, replace=False).tolist()
    parts = [([0] * 7 + [s], [[] for _ in range(7)] + [[s]]) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][-1] - p[0][0])
        (a, x), (b, y) = parts.pop(), parts.pop()
        met = sorted(((u + v, p + q) for u, v, p, q in zip(a, b[::-1], x, y[::-1], strict=True)), key=lambda m: m[0])
        parts.append(([m[0] - met[0][0] for m in met], [m[1] for m in met]))
    order = np.argsort(sizes)[::-1]
    own = np.array(sizes)[order]
    found = sharding.differencing(own, 8)
    assert sorted(map(sum, parts[0][1])) == sorted(np.bincount(found, own, 8).astype(int).tolist())


def test_sharding_of_a_dominating_group(spark):
    rows = [(i, "the same text of a group that is most of all") for i in range(50)] + [(100 + i, f"other {i}") for i in range(30)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    place = {s: [r.doc_id for r in got if r.shard == s] for s in range(8)}
    hot = [s for s, own in place.items() if any(d < 50 for d in own)]
    assert len(hot) == 1 and len(place[hot[0]]) == 50 and all(place.values())


def test_very_long_texts(spark):
    """Texts of over a million characters, one of them a single word, beside short ones, through every operator."""
    rng = np.random.default_rng(2)
    prose = " ".join(f"word{x}" for x in rng.integers(0, 5000, 120_000))
    rows = [(1, prose, "en", "a"), (2, prose + " end", "en", "a"), (3, "x" * 1_200_000, "en", "b"), (4, "short text", "en", "b"), (5, " \n" * 400_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(4, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(prose.split()[500:540]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {1, 2}
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 120_000, 2: 120_000, 3: 0, 4: 0, 5: 0}
    assert toxicity.toxicity(docs, labels).count() == 5
    assert secrets.scan_secrets(docs).where("doc_id = 3").first().spans == ""
    assert sum(r.n_tokens for r in packing.pack_documents(docs).collect()) > 240_000
    assert {r.doc_id: r.size for r in sharding.shard_documents(docs).collect()}[3] == 1_200_001
    classes = {r.doc_id: r.class_id for r in jaccard_join.jaccard_classes(docs).collect()}
    assert classes[1] == classes[2] == 1 and len(set(classes.values())) == 4
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {1: 120_000, 2: 120_001, 3: 1, 4: 2, 5: 0}
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 5
    assert {r.doc_id: r.n_words for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1: 120_000, 2: 120_001, 3: 1, 4: 2, 5: 0}


def test_mixing(odd, empty, rows):
    got = mixing.mix(odd).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(split(r[1]))
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source] and r.target <= 3 * size[r.source] + 1e-6
        taken[r.source] += r.taken
    assert all(taken[s] == int(t + 1e-9) for s, t in target.items())
    order = sorted((s for s in size if s is not None)) + [None]
    level = {s: target[s] / (i % 3 + 1) for i, s in enumerate(order) if target[s] < 3 * size[s] - 1e-3}
    assert max(level.values()) - min(level.values()) < 1e-3
    again = mixing.mix(odd.repartition(7)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.target, r.taken) for r in again) == Counter((r.doc_id, r.source, r.size, r.target, r.taken) for r in got)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert not mixing.mix(empty).collect() and not mixing.mixed_documents(empty).collect()


def test_secrets(spark, empty):
    key = "Ab1" * 13
    texts = [
        f"API_KEY = 'abc123' token: x1 x AKIA{'A' * 16} {key} https://example.com/api/v1",
        f"{key} and https://example.com/api/v1 alone",
        "é" * 5 + f" token:secret=abcdef {'0a' * 14} AKIAAKIA{'B' * 12} password:token: abcdefgh",
        None,
        "",
    ]
    # parts at the edge of the scope: the identifier starts 256 code points after one key, and 257 after another
    texts.append(key + " " * (secrets.SCOPE - len(key)) + f"AKIA{'C' * 16}")
    texts.append(key + " " * (secrets.SCOPE + 1 - len(key)) + f"AKIA{'C' * 16}")
    texts.append(f"PassWord = {'x' * 9} and a PASSWD:{'y' * 5} client-id user_name: user=bob {'f' * 23} {'e' * 40}")
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")]
    got = secrets.scan_secrets(spark.createDataFrame([*rows, (None, texts[0], "z"), (None, texts[0], "z")], "doc_id long, text string, _text string")).collect()
    nulls, got = [r for r in got if r.doc_id is None], sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)
    assert len(got) == 9 and got[0].spans == got[1].spans == nulls[0].spans == nulls[1].spans
    assert "key" in {x.kind for x in got[6].found} and "key" not in {x.kind for x in got[7].found}
    kinds = {
        "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    for r in got:
        text = texts[r.doc_id] or ""
        spans = sorted((m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(kinds.items()) for m in p.finditer(text) if ok(m))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in kinds)
    assert {s.kind for s in got[0].found} == {"assign", "access", "key", "endpoint"} and not got[2].found
    assert not secrets.scan_secrets(empty).collect()


def test_decontamination(spark, odd, empty):
    item = "Yesterday in the market Anna bought 12 kg of apples and then Anna gave Ben 5 of them so how many apples are left for Anna"
    reworded = item.replace("Anna", "Clara").replace("Ben", "David").replace("12 kg", "30 lb").replace("5 of", "9 of")
    mixed = item.replace("Anna", "Clara", 1)
    rows = [(1, "Some words. " + item + " more words."), (2, "Other text here. " + reworded), (3, "And so on. " + mixed), (4, "Nothing of that kind is said in this text at all, not 12 kg."), (5, None), (6, ""), (1, "Some words. " + item + " more words.")]
    bench = spark.createDataFrame([(7, item, 1), (8, "one two three four", 1), (None, item, 1), (9, None, 1)], "item_id long, text string, key int")
    docs = spark.createDataFrame([*rows, (10, "zero one two three four five")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 7): False, (2, 7): True, (3, 7): False, (10, 8): False}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {4, 5, 6}
    clean = decontaminate.clean_documents(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert not decontaminate.leaks(empty, bench).collect() and not decontaminate.leaks(docs, bench.limit(0)).collect()


def brute_leaks(doc, item, window=8, coverage=0.25):
    """n_matched, n_slots, reworded of plain words in small letters and numbers."""
    number = re.compile("[0-9]+")
    a, b = item.split(), doc.split()
    slot = lambda w: "#" if number.fullmatch(w) else w
    windows = [i for i in range(len(a) - window + 1) if sum(slot(w) != "#" for w in a[i : i + window]) >= 4]
    met = {(i, j - i) for i in windows for j in range(len(b) - window + 1) if [slot(w) for w in a[i : i + window]] == [slot(w) for w in b[j : j + window]]}
    places = {(p, s) for i, s in met for p in range(i, i + window) if slot(a[p]) == "#"}
    n = Counter((a[p], b[p + s]) for p, s in places)
    lost = {x for x in n for y in n if x != y and (x[0] == y[0] or x[1] == y[1]) and (-n[y], y) < (-n[x], x)}
    bad = {(p, s) for p, s in places if (a[p], b[p + s]) in lost}
    kept = {(i, s) for i, s in met if not any((p, s) in bad for p in range(i, i + window))}
    if len({i for i, _ in kept}) < max(1, coverage * len(windows)):
        return None
    left = {(p, s) for i, s in kept for p in range(i, i + window)} & places
    return len({i for i, _ in kept}), len({p for p, _ in left}), any(a[p] != b[p + s] for p, s in left)


def test_decontamination_is_brute_force(spark):
    rng = np.random.default_rng(12)
    word = lambda: str(rng.integers(1, 5)) if rng.random() < 0.25 else "abcdefghijklmnop"[rng.integers(0, 16)] * 3
    items = [" ".join(word() for _ in range(int(rng.integers(9, 60)))) for _ in range(12)]
    docs = []
    for i in range(90):
        own = items[i % 12].split()
        for _ in range(int(rng.integers(0, 6))):  # put words in, leave some out, change numbers
            at = int(rng.integers(0, len(own)))
            own[at : at + 1] = [[word(), own[at]], [], [str(rng.integers(1, 5)) if own[at].isdigit() else own[at]]][int(rng.integers(0, 3))]
        docs.append(" ".join([*(word() for _ in range(9)), *own, *(own if i % 9 == 0 else [])]))
    found = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = {(i, j): x for i, d in enumerate(docs) for j, item in enumerate(items) if (x := brute_leaks(d, item))}
    assert {(r.doc_id, r.item_id): (r.n_matched, r.n_slots, r.reworded) for r in found} == want and len(want) > 50


def test_clean_documents_by_content(spark):
    item = "every morning the old miller walked along the river and counted seven grey herons near the broken wooden bridge"
    rows = [(None, f"Before it. {item} and after it."), (None, "a clean text without any id"), (1, item), (1, "another text of the same id"), (2, "clean too"), (None, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert Counter(map(tuple, decontaminate.clean_documents(docs, bench).collect())) == Counter([rows[1], *rows[3:]])


def test_packing_round_trip(odd, empty, rows):
    length = 64
    parts = defaultdict(list)
    for r in packing.pack_documents(odd, length, block_tokens=2000).collect():
        ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(positions) == length and r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens
        for i, (d, at) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)):
            a, b = r.cu_seqlens[i : i + 2]
            parts[d].append((at, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
    tokenizer = packing.Tokenizer((Path(packing.TOKENIZERS) / packing.VOCABULARY).read_bytes())
    times = Counter(r[0] for r in rows)
    for d, text in {r[0]: r[1] for r in rows}.items():
        assert all(n % times[d] == 0 for n in Counter((at, tuple(p)) for at, p in parts[d]).values())  # repeated rows are packed each
        ids = [t for _, p in sorted((at, p) for at, p in parts[d])[:: times[d]] for t in p]
        assert ids[-1] == packing.END and tokenizer.encoding.decode(ids[:-1]) == (text or "")
    assert not packing.pack_documents(empty).collect()


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 101, 400).tolist()
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free.remove(min(fits))
        free.append(min(fits, default=100) - s)
    got = packing.best_fit(sizes, 100)
    assert sorted(i for row in got for i in row) == list(range(400))
    assert sorted(100 - sum(sizes[i] for i in row) for row in got) == sorted(free)


def test_quality(spark, sf, odd, empty):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trusted = labels.where("quality = 1").select("doc_id")
    got = quality.classify(docs, trusted).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, got))
    assert share[1] > 0.97 and share[0] < 0.3
    trusted = odd.select("doc_id").where("doc_id < 4")
    assert quality.classify(odd, trusted).count() == odd.count()
    assert quality.good_documents(odd, trusted).columns == odd.columns
    assert quality.classify(odd, trusted.limit(0)).where("kept").count() == odd.count()
    assert not quality.classify(empty, trusted).collect() and not quality.good_documents(empty, trusted).collect()


def tokens_in_place(text):
    """Each word with its place: after the end of a sentence, or not."""
    words = split(text)
    return [(quality.FIRST if i == 0 or words[i - 1][-1] in ".!?:" else quality.WITHIN, w) for i, w in enumerate(words)]


def brute_word_costs(fit_texts, texts):
    """-log of the probability of each text's words, by dictionaries and recursion."""
    table = quality.symbol_table()
    seen = Counter(t for x in fit_texts for t in tokens_in_place(x))

    def path(token):
        place, word = token
        return [quality.PAD] * (quality.ORDER - 2) + [quality.PAD if place == quality.FIRST else quality.WORD_END] + [int(table[ord(c)]) for c in word] + [quality.WORD_END]

    grams = {quality.ORDER: Counter(tuple(p[i - quality.ORDER + 1 : i + 1]) for p in map(path, seen) for i in range(quality.ORDER - 1, len(p)))}
    for k in range(quality.ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    sizes = lambda values: [sum(v == i for v in values) for i in (1, 2, 3, 4)]
    cut = {k: (0.0, *quality.discounts(*sizes(g.values()))) for k, g in grams.items()}

    def p(k, gram):
        if k == 0:
            return 1 / quality.SYMBOLS
        own = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        lower = p(k - 1, gram[1:])
        if not own:
            return lower
        total, n = sum(own.values()), own.get(gram, 0)
        return (n - cut[k][min(n, 3)] + sum(cut[k][min(x, 3)] for x in own.values()) * lower) / total

    def cost(token):
        steps = path(token)
        spelled = np.prod([p(quality.ORDER, tuple(steps[i - quality.ORDER + 1 : i + 1])) for i in range(quality.ORDER - 1, len(steps))])
        own = {t: n for t, n in seen.items() if t[0] == token[0]}
        if not own:
            return -np.log(spelled)
        c = (0.0, *quality.discounts(*sizes(own.values())))
        total, n = sum(own.values()), own.get(token, 0)
        return -np.log((n - c[min(n, 3)] + sum(c[min(x, 3)] for x in own.values()) * spelled) / total)

    return [sum(map(cost, tokens_in_place(x))) for x in texts]


def test_quality_is_kneser_ney(spark, monkeypatch):
    texts = ["The cat saw the dog. The dog saw a cat.", "A dog! The end: no cat", "cat cat cat  Dog's 12 cats", "日本語 のテキスト です。 cat", "", None, "the\tcat\nsat  on Łódź", "unseen wörds ONLY"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 3)], "doc_id long")
    for head in (quality.HEAD, 3):  # all words that are known are common ones; few are
        monkeypatch.setattr(quality, "HEAD", head)
        got = sorted(quality.score_documents(docs, trusted).collect(), key=lambda r: r.doc_id)
        fit = [texts[r.doc_id] for r in got if r.role == 1]
        assert fit and [r.nll for r in got] == pytest.approx(brute_word_costs(fit, texts), rel=1e-5)
    assert [(r.n_words, r.n_chars) for r in got] == [(len(split(t)), sum(len(w) + 1 for w in split(t))) for t in texts]


def brute_pair_costs(fit_texts, texts):
    """-log of the probability of each text's words after the words before them, by dictionaries and recursion."""
    table = quality.symbol_table()

    def pairs(text):
        tokens = tokens_in_place(text)
        return [(None if token[0] == quality.FIRST else tokens[i - 1], token) for i, token in enumerate(tokens)]

    def path(token):
        place, word = token
        return [quality.PAD] * (quality.ORDER - 2) + [quality.PAD if place == quality.FIRST else quality.WORD_END] + [int(table[ord(c)]) for c in word] + [quality.WORD_END]

    seen = Counter(p for x in fit_texts for p in pairs(x))
    after = Counter(w for _, w in seen)
    grams = {quality.ORDER: Counter(tuple(p[i - quality.ORDER + 1 : i + 1]) for p in map(path, after) for i in range(quality.ORDER - 1, len(p)))}
    for k in range(quality.ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cuts = lambda c: (0.0, *quality.discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))))
    cut = {k: cuts(g) for k, g in grams.items()}

    def mixed(own, item, d, lower):
        if not own:
            return lower
        n = own.get(item, 0)
        return (n - d[min(n, 3)] + sum(d[min(x, 3)] for x in own.values()) * lower) / sum(own.values())

    def p(k, gram):
        return 1 / quality.SYMBOLS if k == 0 else mixed({g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}, gram, cut[k], p(k - 1, gram[1:]))

    def cost(pair):
        steps = path(pair[1])
        spelled = np.prod([p(quality.ORDER, tuple(steps[i - quality.ORDER + 1 : i + 1])) for i in range(quality.ORDER - 1, len(steps))])
        own = Counter({x: n for x, n in after.items() if x[0] == pair[1][0]})
        return -np.log(mixed({x: n for x, n in seen.items() if x[0] == pair[0]}, pair, cuts(seen), mixed(own, pair[1], cuts(own), spelled)))

    return [sum(map(cost, pairs(x))) for x in texts]


def test_quality_is_kneser_ney_of_pairs(spark, monkeypatch):
    texts = ["The cat saw the dog. The dog saw a cat.", "A dog! The end: no cat saw the cat", "cat cat cat  Dog's 12 cats", "日本語 のテキスト です。 cat", "", None, "the\tcat\nsat  on Łódź", "unseen wörds ONLY", "dog the saw cat The"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 3)], "doc_id long")
    for head, pairs in ((quality.HEAD, 0), (3, 2), (quality.HEAD, word_pairs.HEAD_PAIRS)):
        monkeypatch.setattr(quality, "HEAD", head)
        monkeypatch.setattr(word_pairs, "HEAD_PAIRS", pairs)
        got = sorted(quality.score_documents(docs, trusted, order=2).collect(), key=lambda r: r.doc_id)
        fit = [texts[r.doc_id] for r in got if r.role == 1]
        assert fit and [r.nll for r in got] == pytest.approx(brute_pair_costs(fit, texts), rel=1e-5, abs=1e-5)
    assert [(r.n_words, r.n_chars) for r in got] == [(len(split(t)), sum(len(w) + 1 for w in split(t))) for t in texts]


def test_rows_with_ids_by_two_filters(spark, monkeypatch):
    """Filters of few bits let others pass; the rows are those of a join."""
    docs = spark.range(-200, 800).select(F.col("id").alias("doc_id"), F.col("id").cast("string").cast("binary").alias("text"))
    docs = docs.unionByName(docs.limit(300)).unionByName(spark.createDataFrame([(None, b"x")], "doc_id long, text binary"))
    ids = spark.range(0, 1500, 7).withColumnRenamed("id", "_id")
    for bits in (64, 1 << 10, quality.FILTER_BITS):
        monkeypatch.setattr(quality, "FILTER_BITS", bits)
        got = Counter(r.doc_id for r in quality._with_ids(docs, ids).collect())
        assert got == Counter(r.doc_id for r in docs.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").collect())


def test_order_of_words_matters_to_perplexity(spark):
    """Words in another order have the same counts; only pairs tell them apart."""
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, " ".join(text.split()[k:] + text.split()[:k]), "en") for i, k in enumerate((0, 0, 0, 0))] + [(9, " ".join(text.split()[::-1]), "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in quality.classify(docs, spark.createDataFrame([(0,), (1,), (2,), (3,)], "doc_id long"), held_out=10**9).collect()}
    assert got[9] > 1.2 * got[0]


def test_pairs_go_on_over_parts_of_long_texts(spark):
    sentence = "some words that go on "
    texts = ["The end. Some words that go on.", sentence * 180_000, sentence * 2, sentence * 3]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r for r in quality.score_documents(docs, spark.createDataFrame([(0,)], "doc_id long"), held_out=10**9, order=2).collect()}
    assert (got[1].n_words, got[1].n_chars) == (900_000, 900_000 + 17 * 180_000)
    assert got[1].nll == pytest.approx(got[2].nll + 179_998 * (got[3].nll - got[2].nll), rel=1e-4)
    assert [got[i].nll for i in (2, 3)] == pytest.approx(brute_pair_costs(texts[:1], texts[2:]), rel=1e-5)


def test_quality_sends_once_and_only_what_trusted_text_may_have(spark, monkeypatch):
    """Words and pairs that trusted text hasn't aren't sent, and nothing sent is stored before; costs are those of a model that asks for all (test_quality_is_kneser_ney_of_pairs)."""
    docs = spark.createDataFrame([(0, "one two three. one two four"), *((i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(1, 6))], "doc_id long, text string").withColumn("lang", F.lit("en"))
    stored, sent, store, posted = [], [], word_pairs.materialize, word_pairs._postings
    monkeypatch.setattr(word_pairs, "materialize", lambda df, name, *a, **b: stored.append(name) or store(df, name, *a, **b))
    monkeypatch.setattr(word_pairs, "_postings", lambda *a: sent.append(posted(*a)) or sent[-1])
    got = {r.doc_id: r for r in quality.score_documents(docs, spark.createDataFrame([(0,)], "doc_id long"), held_out=10**9, order=2).collect()}
    assert [got[i].n_words for i in range(6)] == [6, *[50] * 5] and all(got[i].nll > 100 for i in range(1, 6))
    assert sorted(stored) == ["kn-contexts", "kn-pairs"]
    assert not sent[0].where("payload IS NOT NULL").collect()


def test_filter_numbers_places():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    mask = np.zeros(word_pairs.FILTER_BITS, bool)
    mask[word_pairs._filter_place(keys)] = True
    bits = 6
    passing = word_pairs.Filter(quality._pack(np.packbits(mask)), bits)
    assert passing.find(keys).all() and passing.find(rng.integers(0, 1 << 48, 10**5, dtype=np.uint64)).mean() < 1e-3
    for shard in range(1 << bits):
        own = keys[keys >> np.uint64(48 - bits) == shard]
        places = np.unique(word_pairs._filter_place(own))
        assert (passing.coded(own) == word_pairs._coded(np.searchsorted(places, word_pairs._filter_place(own)), own)).all()


def test_packed_arrays_are_opened_again():
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 2**32, 700, dtype=np.uint32), np.zeros(0, np.uint16), np.ones(1, np.uint16), np.full(300, 7, np.uint32), rng.random(9).astype(np.float32), np.arange(-3, 5), np.arange(2, dtype=np.uint8)]
    for x, y in zip(arrays, quality._unpack(quality._pack(*arrays), *(x.dtype for x in arrays)), strict=True):
        assert x.dtype == y.dtype and (x == y).all()


def test_shuffle_files_end_with_what_is_stored(spark):
    from contextquarry.scratch import CLEANUP, materialize

    disk, before = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(CLEANUP)
    shuffled = lambda: {x for x in disk.getAllBlocks().mkString(",").split(",") if x.startswith("shuffle")}
    rows, had = spark.range(1000).repartition(3, "id"), shuffled()
    materialize(rows, "freed", free=True)
    for _ in range(50):
        if shuffled() <= had:
            break
        time.sleep(0.1)
    assert shuffled() <= had and spark.conf.get(CLEANUP) == before
    materialize(rows, "kept")
    assert shuffled() - had


def test_quality_reads_long_texts_in_parts(monkeypatch):
    """Parts have the words of the whole, each whole and in its place."""
    rng = np.random.default_rng(3)
    for text in (" ".join(f"w{x}{'' if x % 7 else '.'}" for x in rng.integers(0, 50, 3000)), "x" * 5000, "a. " + "y" * 3000 + "  \n" + " " * 2000 + "z b", " " * 3000 + "c", "é" * 2000 + ". d " + "e" * 1500):
        raw = np.frombuffer(f"One text. {text}|short one".encode(), np.uint8)
        ends = np.array([0, 10, len(raw) - 10, len(raw)])
        whole = quality.Words.of(raw, ends)
        monkeypatch.setattr(quality, "BLOCK_BYTES", 700)
        parts = list(quality._parts(raw, ends))
        monkeypatch.undo()
        assert len(parts) >= 3
        counts, n_words, n_chars = Counter(), np.zeros(3, int), np.zeros(3, int)
        for first, part, cut, opens in parts:
            own = quality.Words.of(part, cut, opens)
            n_words[first : first + len(own.n_words)] += own.n_words
            n_chars[first : first + len(own.n_words)] += own.n_chars
            counts.update(dict(zip(own.binary().to_pylist(), own.totals().tolist(), strict=True)))
        assert counts == Counter(dict(zip(whole.binary().to_pylist(), whole.totals().tolist(), strict=True)))
        assert (n_words.tolist(), n_chars.tolist()) == (whole.n_words.tolist(), whole.n_chars.tolist())


def test_quality_of_words_and_texts_longer_than_a_block(spark):
    """4 MB: one word, and words without a sentence's end; costs are those of any length."""
    sentence = "some words that go on "
    texts = ["The end. Some words that go on.", "u" * 4_000_000, sentence * 180_000, sentence * 2, "u" * 40, "ü" * 2_000_001]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r for r in quality.score_documents(docs, spark.createDataFrame([(0,)], "doc_id long"), held_out=10**9).collect()}
    assert [(got[i].n_words, got[i].n_chars) for i in (1, 2, 5)] == [(1, 4_000_001), (900_000, 900_000 + 17 * 180_000), (1, 2_000_002)]
    first, later = got[3].nll, None
    want = brute_word_costs([texts[0]], ["some", "words", sentence.strip(), " ".join([sentence.strip()] * 3)])
    later = want[3] - want[2]  # two sentences' words within a sentence
    assert got[2].nll == pytest.approx(want[2] + later / 2 * 179_999, rel=1e-4)
    assert first == pytest.approx(want[2] + later / 2, rel=1e-5)


def test_judge_by_hand(spark):
    """Means, prior, quantile, held-out roles and languages without any."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        lang = ("en", "de", None, "few", "new")[i % 5]
        role = 0 if lang == "new" or i % 2 else 1 + (i % 6 == 0 and lang not in ("few",))
        n = int(rng.integers(0, 300))
        rows.append((i, i, lang, n // 5, n, float(n * rng.uniform(1, 4)), role))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, h long, lang string, n_words long, n_chars long, nll double, role int").repartition(4), 0.9, 0.05, 60).collect()}
    trusted = [r for r in rows if r[6] > 0 and r[4] > 0]
    mean = lambda rs: sum(r[5] for r in rs) / sum(r[4] for r in rs)
    score = {r[0]: (r[5] + 60 * mean([t for t in trusted if t[2] == r[2]] or trusted)) / (r[4] + 60) for r in rows}

    def limit(rs):
        """The least score that the share 0.9 of them doesn't exceed."""
        own = sorted(score[r[0]] for r in rs)
        return own[int(np.ceil(0.9 * len(own))) - 1] + 0.05

    every = limit([r for r in trusted if r[6] == 2])
    for r in rows:
        own = [t for t in trusted if t[2] == r[2]]
        judged = max((t[6] for t in own), default=0)
        want = limit([t for t in own if t[6] == judged]) if own else every
        assert got[r[0]].score == pytest.approx(score[r[0]])
        assert got[r[0]].limit == pytest.approx(want)
        assert got[r[0]].kept == (score[r[0]] <= got[r[0]].limit)


def test_spelling_sums_to_one(spark):
    words = [bytes([p]) + w.encode() for p, w in ((quality.FIRST, "abc"), (quality.WITHIN, "abd"), (quality.WITHIN, "xyz"), (quality.FIRST, "aa"))]
    log_p = quality.spelling(spark.createDataFrame([(bytearray(w),) for w in words], "word binary"))
    assert np.allclose(np.exp(log_p.astype(float)).reshape(-1, quality.SYMBOLS).sum(axis=1), 1, atol=1e-4)


def test_toxicity(spark, sf, odd, empty):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.1')}/labels.parquet")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    good, bad = ([r.score for r in got if r.toxic == k] for k in (0, 1))
    assert np.mean([a < b for a in good for b in bad]) > 0.9
    few = odd.select("doc_id", F.lit(1).alias("toxic"))
    assert toxicity.toxicity(odd, few).count() == odd.count()
    assert {r.score for r in toxicity.toxicity(odd, few.limit(0)).collect()} == {0.5}
    assert not toxicity.toxicity(empty, few).collect()


def machine_data(label, rows=4000, fill=50):
    """Rows of columns 1 and 2, each by chance, and others; labelled by what is known of the two."""
    rng = np.random.default_rng(6)
    columns, labels = [], []
    for _ in range(rows):
        a, b = rng.integers(0, 2, 2)
        columns.append(np.unique(np.array([*([1] if a else []), *([2] if b else []), *rng.integers(10, 10 + fill, 5)])))
        labels.append(float(label(a, b)))
    return columns, np.array(labels)


def test_pairs_matter_to_the_machine():
    fm = toxicity.fit(*machine_data(lambda a, b: a and b))
    one, two, both = fm.margin(np.array([1, 2, 1, 2]), np.array([0, 1, 2, 4]))
    assert both > 0 > max(one, two)


def test_terms_that_tell_nothing_alone():
    """Whether two terms agree: neither says anything by itself, so only their interaction can be learnt."""
    columns, labels = machine_data(lambda a, b: a == b)
    fm = toxicity.fit(columns, labels)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
    right = (fm.margin(np.concatenate(columns), begin) > 0) == labels
    assert right.mean() > 0.95
    fm.factors[:] = 0
    right = (fm.margin(np.concatenate(columns), begin) > 0) == labels
    assert right.mean() < 0.8


def test_margin_is_the_double_sum():
    rng = np.random.default_rng(9)
    fm = toxicity.FactorizationMachine(rng.random(toxicity.COLUMNS), 0.3, rng.normal(size=toxicity.COLUMNS), rng.normal(size=(toxicity.COLUMNS, toxicity.FACTORS)))
    rows = [np.unique(rng.integers(0, toxicity.COLUMNS, n)) for n in (0, 1, 2, 9)]
    want = []
    for own in rows:
        x = fm.scale[own]
        z = fm.bias + x @ fm.linear[own]
        z += sum(fm.factors[own[i]] @ fm.factors[own[j]] * x[i] * x[j] for i in range(len(own)) for j in range(i))
        want.append(z)
    assert fm.margin(np.concatenate(rows).astype(int), np.concatenate([[0], np.cumsum([len(r) for r in rows])])) == pytest.approx(want)
