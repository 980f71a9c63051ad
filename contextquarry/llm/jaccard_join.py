"""N-gram Jaccard self-join by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize
from contextquarry.llm.components import components
from contextquarry.llm.rolling import WordHashes, mix, runs_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Tokens of a pair at the threshold that both its sets choose at a node, on average.
SHARED = 2.0
#: Larger buckets split, unless their sets are alike.
BUCKET = 256
#: Sets that are compared with each other at once, and shingles of them: what a task holds. Buckets of more are compared block by block.
BLOCK, BLOCK_TOKENS = 4096, 1 << 21
#: Bytes of a set's sketch, each of a minimum hash, and how many two sets must have in common to be compared in full. At the threshold
#: fewer agree with a probability of 3e-5; each of a pair's meetings has the same sketches.
SKETCH, ALIKE = 24, 11
#: Bytes of a shingle's hash.
TOKEN = 5
_COLUMNS = 4096
_ROWS = 256
#: Shingles of a set that meet all nodes at once.
_CHUNK = 1 << 16


def runs_for(recall: float, shared: float = SHARED) -> int:
    """Runs after which a pair at the threshold has met with the probability `recall`.

    The nodes that both sets of a pair reach are a branching process with a Poisson number of children of mean `shared`; it
    survives all levels with the probability s = 1 - exp(-shared * s).
    """
    s = 1.0
    for _ in range(200):
        s = 1 - math.exp(-shared * s)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - s)))


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted set of hashes (TOKEN bytes) of five consecutive words; of all words, if there are fewer."""
    return np.unique(runs_of(hashes.of(text.split()), SHINGLE_WORDS) >> np.uint64(64 - 8 * TOKEN)) if text else np.zeros(0, np.uint64)


def pack(tokens: np.ndarray) -> bytes:
    return tokens.view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // TOKEN, 8), np.uint8)
    out[:, :TOKEN] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN)
    return out.view(np.uint64).ravel()


def sketch(tokens: np.ndarray) -> bytes:
    """A byte of each of SKETCH minimum hashes: of products with odd numbers, as the tokens are spread already."""
    if not len(tokens):
        return bytes(SKETCH)
    spread, odd = mix(tokens + np.uint64(1)), mix(np.arange(101, 101 + SKETCH, dtype=np.uint64)) | np.uint64(1)
    return mix(np.array([(spread * k).min() for k in odd])).astype(np.uint8).tobytes()


def choose(tokens: np.ndarray, parents: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The children of each parent's node for this set: each token is chosen with the probability shared / (threshold * size), by a hash of node and token."""
    share = SHARED / (threshold * max(1, len(tokens)))
    limit = np.uint64(min(share, 1.0) * (2**64 - 2**12))
    of, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, len(tokens), _CHUNK):
        own = tokens[begin : begin + _CHUNK]
        node, token = np.nonzero(mix((own[None, :] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ parents[:, None]) <= limit)
        of.append(node)
        kids.append(mix(parents[node] * np.uint64(0x9E3779B97F4A7C15) + own[token]))
    of, kids = np.concatenate(of), np.concatenate(kids)
    order = np.argsort(of, kind="stable")
    return np.split(kids[order], np.searchsorted(of[order], np.arange(1, len(parents))))


def _key(tokens: bytes) -> int:
    return xxhash.xxh3_64_intdigest(tokens) - (1 << 63)


def _longs(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
    values = np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _sets(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """doc_id, h, k (hash of the set), size, sketch, nodes (of the first level, of all runs) and kids (the next level's, for each node)."""
    schema = "doc_id long, h long, k long, size int, sketch binary, nodes array<long>, kids array<array<long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, roots = WordHashes(), mix(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in batches:
            key, size, signs, nodes, kids = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, hashes)
                key.append(_key(own.tobytes()))
                size.append(len(own))
                signs.append(sketch(own))
                nodes.append(np.unique(np.concatenate(choose(own, roots, threshold))))
                if len(nodes[-1]):
                    kids.extend(choose(own, nodes[-1], threshold))
            tops = _longs(nodes)
            below = pa.ListArray.from_arrays(tops.offsets, _longs(kids))
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(signs, pa.binary()), tops, below]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "k", "size", "sketch", "nodes", "kids"])

    return arrow_batches(docs).mapInArrow(run, schema)


def _tokens(docs: DataFrame) -> DataFrame:
    """k and the set itself, for rows (k, text); of rows of one k that follow each other, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, before = WordHashes(), None
        for batch in batches:
            keys = batch.column("k").to_pylist()
            new = [k != p for k, p in zip(keys, [before, *keys], strict=False)]
            own = batch.filter(pa.array(new))
            before = keys[-1] if keys else before
            yield pa.RecordBatch.from_arrays([own.column("k"), pa.array([pack(shingles(t, hashes)) for t in own.column("text").to_pylist()], pa.binary())], names=["k", "tokens"])

    return arrow_batches(docs).mapInArrow(run, "k long, tokens binary")


def _together(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each list of the left shares with each of the right; a list has no value twice. The columns are taken some thousands at a time."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), len(lists)) for lists in (left, right)]
    if left is right:
        kinds, count = np.unique(sides[0][0], return_counts=True)
        used = kinds[count > 1]
    else:
        used = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, row, rows in sides:
        at = np.minimum(np.searchsorted(used, values), max(0, len(used) - 1))
        good = used[at] == values if len(used) else np.zeros(len(values), bool)
        at, row = at[good], row[good]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], row[order], rows))
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(used), _COLUMNS):
        dense = []
        for at, row, rows in placed[: 1 if left is right else 2]:
            a, b = np.searchsorted(at, (begin, begin + _COLUMNS))
            dense.append(np.zeros((rows, min(_COLUMNS, len(used) - begin)), np.float32))
            dense[-1][row[a:b], at[a:b] - begin] = 1
        out += dense[0] @ dense[-1].T
    return out


def _sides(key: tuple[int, int, int], own: list[tuple]) -> tuple[list[int], list[int]]:
    """The positions of the two blocks of a group (node, left, right); twice the same list if it is one block with itself."""
    left = [i for i, r in enumerate(own) if r[1] == key[1]]
    return left, left if key[1] == key[2] else [i for i, r in enumerate(own) if r[1] == key[2]]


def _met_before(node: int, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether the sets of a pair are together in a lesser leaf."""
    lesser = [x[x < node] for x in left]
    return _together(lesser, lesser if left is right else [x[x < node] for x in right]) > 0


def compare(key: tuple[int, int, int], own: list[tuple], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that are counted at this leaf, per row (k, block, leaves, size, set), and the first row of each one's local component.

    Of two blocks only links across count. A link counts at the least leaf that both sets are in.
    """
    n, (left, right) = len(own), _sides(key, own)
    sets = [[own[i][4] for i in left]]
    sets.append(sets[0] if left is right else [own[i][4] for i in right])
    a, b = (np.array([len(s) for s in x], np.float32) for x in sets)
    linked = _together(*sets)
    for at in range(0, len(left), _ROWS):  # shared >= threshold * (a + b - shared)
        rows = linked[at : at + _ROWS]
        rows[:] = rows >= (threshold * (a[at : at + _ROWS, None].astype(np.float64) + b[None, :]) - 1e-6) / (1 + threshold)
    linked = linked.astype(bool)
    if left is right:
        np.fill_diagonal(linked, False)
    label, i, j = np.arange(n), np.array(left, int), np.array(right, int)
    edge = np.nonzero(linked)
    ends = i[edge[0]], j[edge[1]]
    while True:
        new = label.copy()
        np.minimum.at(new, ends[0], label[ends[1]])
        np.minimum.at(new, ends[1], label[ends[0]])
        new = new[new]
        if (new == label).all():
            break
        label = new
    links = np.zeros(n, np.int64)
    if len(edge[0]):
        leaves = [own[x][2] for x in left]
        linked &= ~_met_before(key[0], leaves, leaves if left is right else [own[x][2] for x in right])
        links[i] += linked.sum(axis=1)
        if left is not right:
            links[j] += linked.sum(axis=0)
    return links, label


def screen(key: tuple[int, int, int], own: list[tuple], threshold: float) -> np.ndarray:
    """Which rows (k, block, leaves, size, sketch) have a pair to compare at this leaf: of sizes and sketches that agree, and with no lesser leaf in common."""
    left, right = _sides(key, own)
    sketches = np.frombuffer(b"".join(r[4] for r in own), np.uint8).reshape(len(own), SKETCH)
    size = np.array([r[3] for r in own], np.float32)
    near = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(left), _ROWS):
        rows = left[at : at + _ROWS]
        alike = np.zeros((len(rows), len(right)), np.uint8)
        for x, y in zip(sketches[rows].T, sketches[right].T, strict=True):
            alike += x[:, None] == y[None, :]
        a, b = size[rows][:, None], size[right][None, :]
        near[at : at + _ROWS] = (alike >= ALIKE) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-3)
    if left is right:
        np.fill_diagonal(near, False)
    if near.any():
        leaves = [own[x][2] for x in left]
        near &= ~_met_before(key[0], leaves, leaves if left is right else [own[x][2] for x in right])
    good = np.zeros(len(own), bool)
    good[np.array(left, int)[near.any(axis=1)]] = True
    good[np.array(right, int)[near.any(axis=0)]] = True
    return good


def _by_group(rows: DataFrame, value: str, schema: str, handle) -> DataFrame:
    """Rows (node, left, right, k, block, leaves, size, value), dealt and sorted by group, through handle(group, ks, rows) -> columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "node", "left", "right").sortWithinPartitions("node", "left", "right", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, out = None, [], [[] for _ in names]

        def close() -> None:
            if len(own) > 1:
                for column, v in zip(out, handle(key, own), strict=True):
                    column.extend(v.tolist())

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "block" else pa.int64()) for c, n in zip(out, names, strict=True)], names=names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("node", "left", "right", "k", "block", "leaves", "size", value)]
            for node, left, right, k, block, leaves, size, v in zip(*cols, strict=True):
                if key != (node, left, right):
                    close()
                    key, own = (node, left, right), []
                if own and own[-1][0] == k:
                    continue  # repeated rows of one document
                own.append((k, block, np.array(leaves, np.int64), size, v))
            if len(out[0]) > 10_000:
                yield flush()
        close()
        if out[0]:
            yield flush()

    return arrow_batches(dealt).mapInArrow(run, schema)


def _screened(rows: DataFrame, threshold: float) -> DataFrame:
    def handle(key, own):
        good = np.flatnonzero(screen(key, own, threshold))
        return [np.full(len(good), x) for x in key] + [np.array([r[0] for r in own])[good], np.array([r[1] for r in own])[good]]

    return _by_group(rows, "sketch", "node long, left long, right long, k long, block int", handle)


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    def handle(key, own):
        own = [(*r[:4], unpack(r[4])) for r in own]
        links, label = compare(key, own, threshold)
        ids = np.array([r[0] for r in own])
        good = np.flatnonzero((links > 0) | (label != np.arange(len(own))))
        return ids[good], ids[label[good]], links[good]

    return _by_group(rows, "tokens", "k long, root long, links long", handle)


def _counted(members: DataFrame) -> DataFrame:
    """Members of buckets of two or more, with the bucket's number of members and of their shingles."""
    counts = members.groupBy(F.col("node").alias("_n")).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles")).where("members > 1")
    return members.join(counts, F.col("node") == F.col("_n")).drop("_n")


def _leaves(sets: DataFrame, threshold: float) -> DataFrame:
    """node, k, members, shingles: the buckets in which sets are compared.

    Buckets of up to BUCKET sets, and larger ones whose sets are alike (their sketches begin with few different bytes), as splitting these
    would only repeat them. Others split by the sets' next choices; what is large and mixed after that splits by size, so that sets whose sizes allow
    the threshold meet still: a class of sizes spans that factor, and each set is in its own and the next.
    """
    large = lambda df: df.where(F.col("members") > BUCKET)
    head = F.substring("sketch", 1, 3)

    def mixed(level: DataFrame) -> DataFrame:
        kinds = large(level).groupBy("node", "head").agg(F.first("members").alias("members")).groupBy("node").agg(F.count(F.lit(1)).alias("kinds"), F.first("members").alias("members"))
        return materialize(kinds.where(F.col("kinds") * 3 > F.col("members")).select(F.col("node").alias("_m")), "cp-mixed")

    first = materialize(_counted(sets.select(F.explode("nodes").alias("node"), "k", "size", head.alias("head")).distinct()), "cp-members")
    split = mixed(first)
    leaves = first.join(split, F.col("node") == F.col("_m"), "left_anti").select("node", "k", "members", "shingles")
    if split.take(1):
        kids = sets.select("k", "size", head.alias("head"), F.explode(F.arrays_zip("nodes", "kids")).alias("x")).join(split, F.col("x.nodes") == F.col("_m"), "left_semi")
        second = materialize(_counted(kids.select(F.explode("x.kids").alias("node"), "k", "size", "head").distinct()), "cp-members")
        again = mixed(second)
        leaves = leaves.unionByName(second.join(again, F.col("node") == F.col("_m"), "left_anti").select("node", "k", "members", "shingles"))
        if again.take(1):
            of_size = F.floor(F.log(F.col("size").cast("double")) / -math.log(threshold)).cast("long")
            third = second.join(again, F.col("node") == F.col("_m"), "left_semi").withColumn("_c", F.explode(F.array(of_size, of_size + 1)))
            leaves = leaves.unionByName(_counted(third.select(F.xxhash64("node", "_c").alias("node"), "k", "size").distinct()).select("node", "k", "members", "shingles"))
    return leaves


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_copies, size (of its set).

    Sets of hashed five-word shingles; texts of equal sets are copies, and one set stands for them. Each set chooses some of its
    tokens, and sets that chose the same meet in a bucket. Large buckets split on further tokens (see _leaves) or are compared in pairs of blocks. All pairs
    of a bucket are compared inside a task, by sketches and then exactly, and none are emitted: a set gets its number of links and the first set it hangs together with.
    A pair that meets in several buckets is compared in the least. Runs repeat until a pair at the threshold has met with probability `recall`.

    class_id is the least doc_id of the component of links and copies; n_links is the number of different sets linked; n_copies is the number of rows of
    the same set. Words are separated by ASCII white space and not changed. Texts of one to four words are one shingle; null, empty and blank texts have the empty set and are
    copies of each other without links. Null ids take part; class_id is null only if all ids of a class are. Extra columns are ignored, empty tables give no rows.
    """
    return _classes(docs, threshold, recall).select("doc_id", "class_id", "n_links", "n_copies", "size", "k")


def _classes(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """The columns of jaccard_classes, with h (hash of the text) and label (of the class; class_id may be null, or the id of rows of two classes)."""
    runs = runs_for(recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    sets = materialize(_sets(rows, threshold, runs), "cp-sets")
    # a set's text is that of one row: its id and its hash, as ids may be null or repeat
    of_set = sets.groupBy("k").agg(F.min("doc_id").alias("_id"), F.min(F.struct("doc_id", "h")).alias("_row"), F.count(F.lit(1)).alias("n_copies"))
    leaf = materialize(_leaves(sets, threshold), "cp-leaves")

    lists = leaf.groupBy("k").agg(F.collect_list("node").alias("leaves"))
    about = lists.join(sets.select("k", "size", "sketch").dropDuplicates(["k"]), "k")
    blocks = F.least(F.col("members"), F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_TOKENS))).cast("int")
    placed = leaf.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("k"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.select("node", "k", "block", F.least("block", "_other").cast("long").alias("left"), F.greatest("block", "_other").cast("long").alias("right"))
    worthy = materialize(_screened(placed.join(about, "k"), threshold), "cp-worthy")

    # one text for each set that is compared
    needed = worthy.select("k").distinct().join(of_set, "k").select(F.col("k").alias("_k"), F.col("_row.doc_id").alias("_i"), F.col("_row.h").alias("_h"))
    texts = rows.hint("merge").join(needed, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).select(F.col("_k").alias("k"), "text")
    tokens = materialize(_tokens(texts), "cp-tokens")
    links = materialize(_verified(worthy.join(lists, "k").join(tokens.withColumn("size", F.lit(0)), "k"), threshold), "cp-links")

    labels = components(links.select(F.col("k").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("k").agg(F.sum("links").alias("n_links"))
    classes = of_set.drop("_row").join(labels.withColumnRenamed("node", "k"), "k", "left").join(counted, "k", "left")
    classes = classes.withColumn("label", F.coalesce("label", "k"))
    first = classes.groupBy("label").agg(F.min("_id").alias("class_id"))
    classes = classes.join(first, "label").select(F.col("k").alias("_k"), "label", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n_copies").cast("long"))
    return sets.select("doc_id", "h", "k", "size").join(classes, F.col("k") == F.col("_k")).select("doc_id", "h", "label", "class_id", "n_links", "n_copies", F.col("size").cast("long").alias("size"), "k")


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of docs for each class; same columns as docs.

    That of the least id, a null id being greater than any other, and of equal ids the least hash of the text. Of repeated rows (same id and text) one stays, whichever.
    """
    key = lambda i, h: (i.isNull().alias("__cq_null"), F.coalesce(i, F.lit(0)).alias("__cq_id"), h.alias("__cq_h"))
    heads = _classes(docs, threshold, recall).groupBy("label").agg(F.min(F.struct(*key(F.col("doc_id"), F.col("h")))).alias("head")).select("head.*")
    names = heads.columns
    rows = docs.select("*", *key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    # both steps go by the same key, so texts are dealt and sorted once
    return rows.hint("merge").join(heads, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("k")


OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE_WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE_WORDS - 1}], ' ')))) END AS s FROM w),
keyed AS (SELECT doc_id, s, md5(array_to_string(s, chr(10))) AS k FROM shingles),
sets AS (SELECT k, len(any_value(s)) AS size, any_value(s) AS s, min(doc_id) AS rep, count(*) AS copies FROM keyed GROUP BY k),
tokens AS (SELECT k, size, unnest(s) AS t FROM sets),
pairs AS (SELECT a.k AS ka, b.k AS kb, a.size AS na, b.size AS nb, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.k <> b.k GROUP BY ALL),
links AS (SELECT ka, kb FROM pairs WHERE n >= {THRESHOLD} * (na + nb - n) - 1e-9),
reach(k, r) AS (SELECT k, k FROM sets UNION SELECT reach.k, l.kb FROM reach JOIN links l ON l.ka = reach.r),
classes AS (SELECT reach.k, min(s.rep) AS class_id FROM reach JOIN sets s ON s.k = reach.r GROUP BY reach.k)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM links l WHERE l.ka = d.k) AS n_links, s.copies AS n_copies, s.size::BIGINT AS size
FROM keyed d JOIN sets s ON s.k = d.k JOIN classes c ON c.k = d.k
"""
