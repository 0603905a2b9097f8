"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features cos(Wx + b) approximate a Gaussian kernel over standardised statistics of a text.
Each partition sums its normal equations, the driver adds the sums of the partitions of a bounded
training sample and solves, and isotonic regression on rows that the fit didn't see turns raw
scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import drop_table, materialize, mix, pieces, release, rolling, words_of

#: Labelled rows that a fit uses at most (about: a seeded share of them), and the sums' partitions.
TRAIN_ROWS, SUM_PARTITIONS = 60_000, 16
#: Random features, kernel width in standard deviations per root of the number of statistics, ridge.
FEATURES, WIDTH, RIDGE = 384, 0.8, 1e-4
STATISTICS = 22

_CLASS = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 usual punctuation, 5 white space, 6 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its different values of h and the count of its most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    begin = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[begin], np.diff(np.append(begin, len(h))))
    return np.bincount(row[begin], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """STATISTICS numbers for each text; of counts of that text alone, so that equal texts get equal numbers."""
    w = words_of(texts)
    n = len(w)
    kind = _CLASS[w.buf]
    size = np.diff(w.offsets).astype(float)
    count = [_per_row(kind == k, w.offsets).astype(float) for k in range(7)]
    lines = _per_row(w.buf == 10, w.offsets).astype(float)
    words = np.diff(w.first).astype(float)
    row = np.repeat(np.arange(n), np.diff(w.first))
    length = w.end - w.start
    h = w.hashes()
    odd = np.concatenate(([0], np.cumsum(kind == 0)))
    up = np.concatenate(([0], np.cumsum(kind == 2)))
    has_odd = (odd[w.end] - odd[w.start]) > 0
    all_up = (up[w.end] - up[w.start]) >= np.maximum(2, (length + 1) // 2)
    stop = np.isin(w.buf[w.end - 1], np.frombuffer(b".!?", np.uint8)) if len(w.end) else np.zeros(0, bool)
    different, top = _repeats(h, row, n)
    tri = rolling(h, 3)
    own = row[: len(tri)] == row[2:] if len(tri) else np.zeros(0, bool)
    tri_different, tri_top = _repeats(tri[own], row[: len(tri)][own] if len(tri) else row[:0], n)
    trios = np.maximum(words - 2, 0)
    # lines by the hashes of their words
    breaks = np.concatenate(([0], np.cumsum(w.buf == 10)))
    line = breaks[w.start] if len(w.start) else row
    change = np.concatenate(([True], (line[1:] != line[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
    begin = np.flatnonzero(change)
    if len(begin):
        place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        whole = np.add.reduceat(mix(h) * (mix(place + 1) | np.uint64(1)), begin)
        line_different, line_top = _repeats(whole, row[begin], n)
        full_lines = np.bincount(row[begin], minlength=n).astype(float)
    else:
        line_different = line_top = full_lines = np.zeros(n)
    d = np.maximum(size, 1)
    m = np.maximum(words, 1)
    letters = np.maximum(count[1] + count[2] + count[6], 1)
    mean = _per_row(length, w.first) / m
    square = _per_row(length * length, w.first) / m
    out = [
        np.log1p(words), mean, np.sqrt(np.maximum(square - mean * mean, 0)), count[0] / d, count[2] / letters, count[3] / d, count[4] / d, count[5] / d, count[6] / d,
        lines / m, different / m, np.log1p(different), top / m, tri_different / np.maximum(trios, 1), tri_top / np.maximum(trios, 1), _per_row(has_odd, w.first) / m, _per_row(all_up, w.first) / m,
        _per_row(stop, w.first) / m, _per_row(length <= 2, w.first) / m, _per_row(length >= 12, w.first) / m, line_different / np.maximum(full_lines, 1), line_top / np.maximum(full_lines, 1),
    ]
    return np.stack(out, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing fit of y on x (pool adjacent violators), for linear interpolation."""
    order = np.argsort(x, kind="stable")
    values, at = np.unique(x[order], return_index=True)
    weight = np.diff(np.append(at, len(x))).astype(float)
    level = np.add.reduceat(y[order].astype(float), at) / weight
    stack: list[list[float]] = []  # level, weight, weighted sum of x
    for v, n, s in zip(level, weight, values, strict=True):
        stack.append([v, n, n * s])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            stack.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.array([s / n for _, n, s in stack]), np.array([v for v, _, _ in stack])


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    solution: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.expand(x), self.solution)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(x), self.solution[0])
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def held_out(id_column: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 1 on division by 3 (null id: false)."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int, seed: int) -> DataFrame:
    """A written table (y, u, x) of the labelled rows of docs that a fit uses: those with label 0 or 1 that aren't
    held out; of more than `train_rows` a share by the hash u (0 to 999,999) of the id. Ids alone are counted
    and drawn, so that only the texts drawn are read into statistics."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
    known = materialize(y.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi"), "known")
    n = known.count()
    u = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000))
    drawn = known.withColumn("u", u).where(F.col("u") < (1_000_000 if n <= train_rows else int(1_000_000 * train_rows / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                x = statistics(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64()))], ["y", "u", "x"])

    texts = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")))
    picked = texts.join(F.broadcast(drawn), "_id")  # about train_rows ids
    out = materialize(picked.select("y", "u", "text").mapInArrow(run, "y int, u long, x array<double>"), "labelled")
    drop_table(known)
    return out


def fit(rows: DataFrame, seed: int = 7) -> Model:
    """Fit on (y, u, x): four fifths, by u, for the ridge, a fifth for the calibration. Without rows of both
    labels the model gives every text the mean label (0.5 without labels). The ridge grows with the rows in
    the sums, so that labels that no fit sees don't matter."""
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    ones = ones or 0
    rng = np.random.default_rng(seed)
    weights, phase = rng.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS)), rng.uniform(0, 2 * np.pi, FEATURES)
    flat = Model(np.zeros(STATISTICS), np.ones(STATISTICS), weights, phase, np.array([ones / n if n else 0.5]), (np.zeros(0), np.zeros(0)))
    if not n or ones in (0, n):
        return flat
    moments = rows.select([f(F.col("x")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = flat
    model.center = np.array([moments[f"m{i}"] for i in range(STATISTICS)])
    model.scale = np.array([moments[f"s{i}"] for i in range(STATISTICS)])
    model.scale[~(model.scale > 1e-9)] = 1.0

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for part in batches:
            z = model.expand(np.stack(part["x"].to_numpy())) if len(part) else np.zeros((0, FEATURES + 1))
            a += z.T @ z
            b += z.T @ part["y"].to_numpy(float)
            n += len(part)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    fold = F.col("u") % 5 == 0
    parts = rows.where(~fold).coalesce(SUM_PARTITIONS).mapInPandas(sums, "a binary, b binary, n long").collect()  # SUM_PARTITIONS at most
    a = sum(np.frombuffer(p["a"]) for p in parts).reshape(FEATURES + 1, FEATURES + 1)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    model.solution = np.linalg.solve(a + RIDGE * sum(p["n"] for p in parts) * np.eye(len(b)) / FEATURES, b)

    def raws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({"raw": model.raw(np.stack(part["x"].to_numpy())), "y": part["y"]})

    seen = rows.where(fold).mapInPandas(raws, "raw double, y int").toPandas()  # train_rows / 5
    if len(seen):
        model.knots = isotonic(seen["raw"].to_numpy(), seen["y"].to_numpy())
    return model


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int, seed: int = 7) -> Model:
    rows = labelled_statistics(docs, labels, id_col, text_col, label_col, train_rows, seed)
    model = fit(rows, seed)
    drop_table(rows)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each document: id_col, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    A score depends on the text and the fitted model alone. Null and empty texts are scored as texts
    of no words. Repeated rows stay and score alike; an empty table gives no rows. Labels of unknown
    documents don't matter; see `fit` for which ones do.
    """
    model = trained(docs, labels, id_col, text_col, label_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                s = model.score(statistics(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    out = spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least `least`; see `score_documents`. Texts aren't shuffled."""
    model = trained(docs, labels, id_col, text_col, label_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col):
                text = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array(model.score(statistics(text)) >= least))
        release()

    return spread(docs).mapInArrow(run, docs.schema)
