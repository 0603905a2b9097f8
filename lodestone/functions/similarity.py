"""Cosine searches and joins of vector tables.

A bounded number of queries is sent to the workers and the items are scanned once. Beyond that bound both
sides are tables, and meet in a metric join: the left side falls into cells around pivots, each right row
goes to those cells alone that may hold a left row within the angle, and a cell's rows meet in chunks of
bounded size. Neither side passes the driver, and no plan grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import written
from .vector import unit

#: Query vectors that are sent to all workers at most.
BLOCK = 4096
#: Cells at most (their pivots are sent to all workers), left rows a cell that are wished for, least rows of a chunk.
CELLS, CELL_ROWS, CHUNK_ROWS = 2048, 1024, 2048
#: Bytes (as floats) of the left rows that a task holds, and chunks that right rows fall into at most: a row has a copy for
#: each chunk of the other side, so that chunks grow with the table as far as memory allows, and the right ones are fewer the
#: more left ones there are, yet FEW_CHUNKS if the rows suffice.
CHUNK_BYTES, RIGHT_CHUNKS, FEW_CHUNKS = 16 << 20, 16, 4
#: Similarities that are in memory at once.
AT_ONCE = 1 << 20
#: Right rows on which the worth of cells is estimated, and the share of the cells up to which a row's copies pay.
PROBE, WORTH = 2048, 0.25
#: Radians by which bounds are loosened against rounding.
SLACK = 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


class _Kept:
    """What may count of the similarities of some queries to items that come piece by piece: at least `least`, and among
    the `top` best of a query so far, ties at the sixth digit included."""

    def __init__(self, queries: np.ndarray, least: float | None, top: int | None):
        self.q, self.least, self.top = queries, least, top
        self.best = np.full((top or 0, len(queries)), -np.inf)

    def of(self, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, query, similarity), AT_ONCE at most of them at a time unless there are more queries."""
        step = max(1, AT_ONCE // max(1, len(self.q)))
        for at in range(0, len(items), step):
            s = items[at : at + step] @ self.q.T
            keep = s + 1e-10 >= self.least if self.least is not None else np.ones(s.shape, bool)
            if self.top is not None:
                both = np.concatenate([self.best, np.where(np.isnan(s), -np.inf, s)])
                self.best = np.partition(both, len(both) - self.top, axis=0)[len(both) - self.top :]
                keep &= s >= self.best[0] - 2e-6
            i, j = np.nonzero(keep)
            yield i + at, j, s[i, j]


def similar(queries: DataFrame, items: DataFrame, least: float | None = None, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", block: int = BLOCK, top: int | None = None) -> DataFrame:
    """(query_id, item_id, sim): cosine of every query with every item, those of at least `least`. top: of a
    query's items only those that may be among its `top` best (ties at the sixth digit included) leave a batch, so
    that a cut must follow. Rows with null vectors take no part. Up to `block` queries are sent to the workers; more are
    joined as a table. An id may be a struct: what a pair is judged by rides along, and pairs need not be joined for it.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    held = asked.limit(block + 1).toArrow().combine_chunks()
    if held.num_rows > block:
        return join_similar(asked, items, least, query_id, item_id, vector, top)
    q_kind, i_kind = dict(queries.dtypes)[query_id], dict(items.dtypes)[item_id]
    schema = f"`{query_id}` {q_kind}, `{item_id}` {i_kind}, sim double"
    if not held.num_rows:
        return items.sparkSession.createDataFrame([], schema)
    sent = items.sparkSession.sparkContext.broadcast((pa.concat_arrays(held.column(0).chunks), unit(held.column(1).to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        kept = _Kept(q, least, top)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                m = _vectors(part.column(1))
                if m.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of {m.shape[1]} and {q.shape[1]} dimensions")
                for i, j, sim in kept.of(m):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(sim)], [query_id, item_id, "sim"])

    return items.where(F.col(vector).isNotNull()).select(F.col(item_id), F.col(vector)).mapInArrow(run, schema)


class Cells:
    """Pivots and, once the left rows are dealt, the angles at which each cell holds rows."""

    def __init__(self, pivots: np.ndarray, least: float | None):
        self.pivots = pivots
        self.angle = float(np.arccos(np.clip(least, -1, 1))) if least is not None else np.pi
        # distance of pivots: the plane between two of them cuts the sphere at right angles to their difference
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0)) if len(pivots) else np.zeros((0, 0))
        self.low, self.high = np.zeros(len(pivots)), np.full(len(pivots), np.pi)

    def nearest(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, angle to its pivot) of unit vectors."""
        s = m @ self.pivots.T
        cell = s.argmax(axis=1)
        return cell, np.arccos(np.clip(s[np.arange(len(m)), cell], -1, 1))

    def reached(self, m: np.ndarray) -> np.ndarray:
        """(vectors, cells): whether a cell may hold a row within the angle of a vector: its rows lie on its side of the
        plane towards the vector's own pivot, and in its ring."""
        s = m @ self.pivots.T
        own = s.argmax(axis=1)
        over = s[np.arange(len(m)), own][:, None] - s
        a = np.arccos(np.clip(s, -1, 1))
        near = np.ones(s.shape, bool)
        if self.angle < np.pi / 2:  # a vector without length is like none
            near = (over <= np.sin(min(self.angle + SLACK, np.pi / 2)) * self.apart[own] + SLACK) & (np.abs(m).sum(axis=1) > 0)[:, None]
        return near & (a <= self.high + self.angle + SLACK) & (a >= self.low - self.angle - SLACK)


def _choose(left: DataFrame, right: DataFrame, n: int, least: float | None, vector: str, cells: int | None) -> Cells:
    """Pivots drawn from the left rows; a single cell where the angle is so wide that cells would hardly part the rows."""
    wanted = min(CELLS, max(1, n // CELL_ROWS) if cells is None else cells)
    one = left.select(vector).limit(1).collect()
    if wanted < 2 or least is None or least <= 0:
        return Cells(unit([r[0] for r in one]), least)
    some = left.select(vector).sample(min(1.0, 4.0 * wanted / n), seed=3).limit(wanted).collect()
    pivots = np.unique(unit([r[0] for r in some or one]), axis=0)
    out = Cells(pivots[np.abs(pivots).sum(axis=1) > 0] if np.abs(pivots).sum() else pivots[:1], least)
    probe = right.select(vector).limit(PROBE).collect()
    if cells is None and probe and out.reached(unit([r[0] for r in probe])).mean() > WORTH:
        return Cells(out.pivots[:1], least)
    return out


def _dealt(parts: str) -> Column:
    """Which of a cell's chunks a row goes to, by its number in the written table: repeated ids spread too."""
    return F.pmod(F.xxhash64("r"), F.col(parts)).cast("int")


def join_similar(left: DataFrame, right: DataFrame, least: float | None, left_id: str = "query_id", right_id: str = "item_id", vector: str = "embedding", top: int | None = None, cells: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(left_id, right_id, sim): as `similar`, of two tables of any size.

    A left row has one cell and a right row a copy for each cell it may reach by the triangle inequality and the
    planes between pivots, so each pair meets once. A cell of many rows is cut into chunks of `chunk_rows` or more on both sides
    and its chunks meet pairwise, so that a crowd of near vectors meets no single task. A task holds the left chunk of a
    pair, of CHUNK_BYTES at most, while the right one passes by.
    Null vectors take no part; others must have one dimension. Repeated rows pair as often as they stand.
    """
    spark = left.sparkSession
    kinds = dict(left.dtypes)[left_id], dict(right.dtypes)[right_id]
    schema = f"`{left_id}` {kinds[0]}, `{right_id}` {kinds[1]}, sim double"
    a = left.where(F.col(vector).isNotNull()).select(F.col(left_id).alias("id"), F.col(vector).alias("v"))
    b = right.where(F.col(vector).isNotNull()).select(F.col(right_id).alias("id"), F.col(vector).alias("v"))
    n = a.count()
    if not n:
        return spark.createDataFrame([], schema)
    sent = _choose(a, b, n, least, "v", cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, angle = sent.nearest(_vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "v", "cell", "angle"])

    placed = written(a.mapInArrow(deal, f"id {kinds[0]}, v {dict(left.dtypes)[vector]}, cell int, angle double").withColumn("r", F.monotonically_increasing_id()), "cells")
    for r in placed.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # CELLS at most
        sent.low[r["cell"]], sent.high[r["cell"]] = r["low"], r["high"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                m = _vectors(part.column(1))
                if m.shape[1] != sent.pivots.shape[1]:
                    raise ValueError(f"vectors of {m.shape[1]} and {sent.pivots.shape[1]} dimensions")
                row, cell = np.nonzero(sent.reached(m))
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))], ["id", "v", "cells"])

    routed = written(b.mapInArrow(route, f"id {kinds[1]}, v {dict(right.dtypes)[vector]}, cells array<int>").withColumn("r", F.monotonically_increasing_id()), "reached")
    most = max(chunk_rows, CHUNK_BYTES // (4 * sent.pivots.shape[1]))
    rows = lambda n: F.ceil(F.count("*") / F.lit(n)).cast("int")
    left_parts = placed.groupBy("cell").agg(F.least(rows(chunk_rows), F.greatest(F.lit(2), rows(most))).alias("n"))
    right_parts = routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(rows(chunk_rows).alias("m"))
    few = F.greatest(F.lit(FEW_CHUNKS), F.least(F.lit(RIGHT_CHUNKS), F.lit(RIGHT_CHUNKS + 2) - F.col("n")))
    plan = left_parts.join(right_parts, "cell").select("cell", "n", F.least("m", few).alias("m"))
    plan = F.broadcast(spark.createDataFrame(plan.collect(), "cell int, n int, m int"))  # CELLS rows at most
    none = lambda kind: F.lit(None).cast(kind)
    one = placed.join(plan, "cell").select("cell", _dealt("n").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.lit(0).alias("side"), F.col("id").alias("a"), none(kinds[1]).alias("b"), "v")
    two = routed.select("id", "v", "r", F.explode("cells").alias("cell")).join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), _dealt("m").alias("j"), F.lit(1).alias("side"), none(kinds[0]).alias("a"), F.col("id").alias("b"), "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kept, names = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([c.to_numpy() for c in batch.columns[:4]])
            heads = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for start, end in zip(heads, np.append(heads[1:], batch.num_rows), strict=True):
                part, group = batch.slice(start, end - start), tuple(key[:3, start])
                if group != at:
                    at, held, kept = group, [], None
                if key[3, start] == 0:
                    held.append((part.column(4), _vectors(part.column(6))))
                elif held:
                    if kept is None:
                        names, kept = pa.concat_arrays([n for n, _ in held]), _Kept(np.concatenate([v for _, v in held]), least, top)
                    for i, j, sim in kept.of(_vectors(part.column(6))):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), part.column(5).take(pa.array(i)), pa.array(sim)], [left_id, right_id, "sim"])

    group = ["cell", "i", "j"]
    return one.unionByName(two).repartition(*group).sortWithinPartitions(*group, "side").mapInArrow(meet, schema)
