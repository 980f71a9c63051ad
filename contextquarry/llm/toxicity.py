"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches

#: Columns of hashed terms, and factors of a column.
COLUMNS = 1 << 16
FACTORS = 8
#: At most so many labelled rows are learnt from: those of the smallest hash of their id.
SAMPLE_ROWS = 16_384
#: Epochs of the linear part and of both parts, the step of factors, the penalty on them, and the standard errors that let a column have some: chosen by cross-validation among rows that aren't held out.
FIRST, JOINT, PAIR_RATE, APART, GATE, PAIR_GATE = 10, 10, 1.0, 0.001, 4.0, 7.0
#: Columns of which each pair is looked at for that.
FREQUENT = 1024
#: Terms of which a worker remembers the column.
REMEMBERED = 500_000


class Terms(dict):
    """Column of a word: by its small letters, without ASCII punctuation around it."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.lower().strip(string.punctuation) or word
        self[word] = column = xxhash.xxh32_intdigest(bare.encode("utf-8", "surrogatepass")) % COLUMNS
        return column


def distinct_columns(texts: list[str | None], terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of each text, one text after the other, and where each begins."""
    words = [t.split() if t else [] for t in texts]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    column = np.fromiter((terms[w] for own in words for w in own), np.int64, len(row))
    pairs = np.unique(row * COLUMNS + column)
    return pairs % COLUMNS, np.searchsorted(pairs, np.arange(len(words) + 1) * COLUMNS)


@dataclass
class FactorizationMachine:
    """weight of each column's presence, bias, linear weights and factors."""

    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, columns: np.ndarray, begin: np.ndarray) -> np.ndarray:
        rows = len(begin) - 1
        row = np.repeat(np.arange(rows), np.diff(begin))
        x = self.scale[columns]
        out = self.bias + np.bincount(row, x * self.linear[columns], rows)
        for f in range(self.factors.shape[1]):
            vx = self.factors[columns, f] * x
            out += 0.5 * (np.bincount(row, vx, rows) ** 2 - np.bincount(row, vx * vx, rows))
        return out

    def score(self, texts: list[str | None], terms: Terms) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*distinct_columns(texts, terms)), -30, 30)))

    def pack(self) -> bytes:
        return np.concatenate([[self.bias], self.scale, self.linear, self.factors.ravel()]).astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> FactorizationMachine:
        a = np.frombuffer(raw, np.float32).astype(np.float64)
        return cls(a[1 : 1 + COLUMNS], float(a[0]), a[1 + COLUMNS : 1 + 2 * COLUMNS], a[1 + 2 * COLUMNS :].reshape(COLUMNS, -1))


def _unexplained(columns: list[np.ndarray], residual: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many standard errors the squared residuals of each column's documents are above the mean: pairs that linear weights can't tell leave them large, whatever the sign."""
    squares = residual**2
    count = np.array([len(c) for c in columns])
    total = np.bincount(np.concatenate([*columns, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(squares, count), COLUMNS)
    return (total - seen * squares.mean()) / np.maximum(np.sqrt(seen) * max(squares.std(), 1e-9), 1e-9)


def _conspicuous(columns: list[np.ndarray], residual: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The greatest number of standard errors by which the residuals of documents with a pair of columns differ from 0, for each of the FREQUENT commonest columns; 0 for others."""
    common = np.flatnonzero(seen)
    common = common[np.lexsort((common, -seen[common]))][:FREQUENT]
    place = np.full(COLUMNS, -1)
    place[common] = np.arange(len(common))
    sums, squares = np.zeros((2, len(common), len(common)), np.float32)
    for at in range(0, len(columns), 2048):
        x = np.zeros((len(columns[at : at + 2048]), len(common)), np.float32)
        for i, c in enumerate(columns[at : at + 2048]):
            own = place[c]
            x[i, own[own >= 0]] = 1
        r = residual[at : at + 2048].astype(np.float32)[:, None]
        sums += (x * r).T @ x
        squares += (x * r * r).T @ x
    np.fill_diagonal(sums, 0)
    out = np.zeros(COLUMNS)
    out[common] = (np.abs(sums) / np.sqrt(np.maximum(squares, 1e-9))).max(axis=1, initial=0)
    return out


def fit(
    columns: list[np.ndarray], labels: np.ndarray, first: int = FIRST, joint: int = JOINT, rate: float = 1.0, pair_rate: float = PAIR_RATE, absent: float = 12.0, apart: float = APART, decay: float = 0.001, batch: int = 128, least: int = 4,
    gate: float = GATE, pair_gate: float = PAIR_GATE,
) -> FactorizationMachine:
    """Logistic loss, mini-batches in a fixed order: `first` epochs of the linear part, and `joint` epochs of both parts.

    A column's presence weighs 1, or less if it is in more than a quarter of the documents. Linear weights of either sign follow the regularised leader
    with an absolute penalty. Factors belong to columns, however rare or without weight, of whose documents the linear part explains less than of others (by `gate` standard errors), and to common ones that it is wrong about together with another (by pair_gate); steps
    go by the sums of squared gradients, and a penalty on the length of a column's factors ends at zero if its pairs tell nothing. Columns of fewer than `least` documents are left out.
    """
    n = len(labels)
    seen = np.bincount(np.concatenate([*columns, np.zeros(0, np.int64)]).astype(np.int64), minlength=COLUMNS)
    rng = np.random.default_rng(7)
    share = float(np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    scale = np.where(seen >= least, np.clip(np.log(max(n, 1) / np.maximum(seen, 1)) / np.log(4), 0, 1), 0)
    fm = FactorizationMachine(scale, float(np.log(share / (1 - share))), np.zeros(COLUMNS), np.zeros((COLUMNS, FACTORS)))
    if n == 0 or labels.min() == labels.max():
        return fm  # nothing to tell apart: everything has the share of the label
    paired = np.zeros(COLUMNS, bool)
    lead, squares, factor_squares, bias_squares = np.zeros(COLUMNS), np.zeros(COLUMNS), np.zeros((COLUMNS, FACTORS)), 1.0
    own_columns = [c[scale[c] > 0] for c in columns]
    for epoch in range(first + joint):
        if epoch == first:
            flat, begin = np.concatenate([*own_columns, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(c) for c in own_columns])])
            residual = 1 / (1 + np.exp(-np.clip(fm.margin(flat, begin), -30, 30))) - labels
            paired = (scale > 0) & ((_unexplained(own_columns, residual, seen) > gate) | (_conspicuous(own_columns, residual, seen * (scale > 0)) > pair_gate))
            fm.factors[paired] = rng.normal(0, 0.05, (int(paired.sum()), FACTORS))
            if not paired.any():
                joint = 0
        if epoch >= first + joint:
            break
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            col = np.concatenate([own_columns[i] for i in own]).astype(np.int64)
            row = np.repeat(np.arange(len(own)), [len(own_columns[i]) for i in own])
            x = scale[col]
            z = fm.bias + np.bincount(row, fm.linear[col] * x, len(own))
            if epoch >= first:
                many = paired[col]
                c, r, w = col[many], row[many], x[many]
                v = fm.factors[c] * w[:, None]
                sums = np.column_stack([np.bincount(r, v[:, f], len(own)) for f in range(FACTORS)])
                z += 0.5 * ((sums**2).sum(1) - np.bincount(r, (v**2).sum(1), len(own)))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]
            bias_squares += error.sum() ** 2
            fm.bias -= rate * error.sum() / np.sqrt(bias_squares)
            # with the factors only their columns' weights go on, as others would only fit the rows at hand
            free = paired[col] if epoch >= first else np.ones(len(col), bool)
            found, place = np.unique(col[free], return_inverse=True)
            grad = np.bincount(place, (error[row] * x)[free], len(found))
            step = (np.sqrt(squares[found] + grad**2) - np.sqrt(squares[found])) / rate
            lead[found] += grad - step * fm.linear[found]
            squares[found] += grad**2
            fm.linear[found] = -np.sign(lead[found]) * np.maximum(np.abs(lead[found]) - absent, 0) / ((1 + np.sqrt(squares[found])) / rate + decay)
            if epoch >= first and len(c):
                found, place = np.unique(c, return_inverse=True)
                g = (error[r] * w)[:, None] * (sums[r] - v)
                g = np.column_stack([np.bincount(place, g[:, f], len(found)) for f in range(FACTORS)]) + decay * fm.factors[found]
                factor_squares[found] += g**2
                step = pair_rate / np.sqrt(1 + factor_squares[found])
                new = fm.factors[found] - step * g
                length = np.sqrt((new**2).sum(axis=1, keepdims=True))
                fm.factors[found] = new * np.maximum(0, 1 - apart * step.mean(axis=1, keepdims=True) / np.maximum(length, 1e-12))
    return fm


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on the texts of at most sample_rows labelled ids (labels: doc_id, toxic); contradictory labels of one id count as toxic. Nulls in either column are left out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            col, begin = distinct_columns(batch.column("text").to_pylist(), terms)
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(col.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), lists], names=["_id", "label", "columns"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_size=pdf["columns"].map(len)).sort_values(["_id", "_size"]).head(sample_rows)
        fm = fit(list(pdf["columns"]), pdf["label"].to_numpy(float))
        return pd.DataFrame({"model": [fm.pack()]})

    # one group: it holds the bounded sample only
    got = arrow_batches(rows).mapInArrow(columns, "_id long, label int, columns array<int>").groupBy().applyInPandas(learn, "model binary").collect()
    return FactorizationMachine.unpack(bytes(got[0]["model"])) if got else fit([], np.zeros(0))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """One row per row of docs: doc_id, score. Null is the empty text; its score is that of no terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm, terms = FactorizationMachine.unpack(shared.value), Terms()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fm.score(batch.column("text").to_pylist(), terms))], names=["doc_id", "score"])

    return arrow_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Every row is scored from its text alone, extra columns don't matter. Labels are learnt from rows that aren't held out; null ids are not held out and have no labels.
    With no labels all scores are 0.5. An empty table gives no rows.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
