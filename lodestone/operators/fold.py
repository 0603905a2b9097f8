"""Ordered series of clamped changes, folded as an associative aggregate; and numbers in a global order.

"Add, then clamp" composes: clamp(clamp(x + s, l, h) + t, m, k) is clamp(x + s + t, l', h') with l' = clamp(l + t, m, k) and
h' = clamp(h + t, m, k). So any stretch of a link's changes is one triple (low, high, shift), stretches combine in order,
and no link's changes ever stand in one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import written


def compose(low: np.ndarray, high: np.ndarray, shift: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One triple for each run of equal group numbers: neighbours combine pairwise until one is left."""
    while True:
        first = np.append(True, group[1:] != group[:-1])
        if first.all():
            return low, high, shift
        place = np.arange(len(group)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        left = np.flatnonzero(place % 2 == 0)
        right = left + 1
        paired = (right < len(group)) & (group[np.minimum(right, len(group) - 1)] == group[left])
        a, b = left[paired], right[paired]
        l, h, s = low[left], high[left], shift[left]  # noqa: E741
        l[paired], h[paired] = np.clip(low[a] + shift[b], low[b], high[b]), np.clip(high[a] + shift[b], low[b], high[b])
        s[paired] = shift[a] + shift[b]
        low, high, shift, group = l, h, s, group[left]


def stretches(events: DataFrame, by: list[str], least: float, most: float) -> DataFrame:
    """(*by, seq, delta, n, low, high, shift): each link's changes (*by, seq, delta) as a few triples, one for each
    range of the log in which it has some; seq and delta are those of its first change.

    The log is dealt by ranges of link and seq, so that a link of any number of changes is spread over tasks."""
    order = [*by, "seq", "delta"]
    kinds = dict(events.dtypes)
    names = [*order, "n", "low", "high", "shift"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the last link so far, whose changes may go on
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in range(len(by)):
                x = batch.column(c)
                new[1:] |= ~pc.fill_null(pc.equal(x.slice(1), x.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            delta = batch.column(len(by) + 1).to_numpy(zero_copy_only=False).astype(float)
            low, high, shift = compose(np.full(n, least), np.full(n, most), delta, np.cumsum(new))
            heads = np.flatnonzero(new)
            out = batch.take(pa.array(heads)).to_pydict()
            rows = [list(r) for r in zip(*(out[c] for c in order), np.diff(np.append(heads, n)).tolist(), low.tolist(), high.tolist(), shift.tolist(), strict=True)]
            if held is not None and held[: len(by)] == rows[0][: len(by)]:
                a, b = held[-4:], rows[0][-4:]
                rows[0] = [*held[:-4], a[0] + b[0], min(max(a[1] + b[3], b[1]), b[2]), min(max(a[2] + b[3], b[1]), b[2]), a[3] + b[3]]
            elif held is not None:
                rows.insert(0, held)
            held = rows.pop()
            yield _rows(rows, batch.schema, names)
        if held is not None:
            yield _rows([held], batch.schema, names)

    def _rows(rows: list[list], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
        types = [*(schema.field(c).type for c in order), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    ordered = events.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in order), "n long, low double, high double, shift double"]))


def in_order(parts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n_events, parts): the triples of each link in order."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n_events"), F.array_sort(F.collect_list(F.struct("seq", "delta", "low", "high", "shift"))).alias("parts"))


def after(parts: Column, start: Column) -> Column:
    """A weight after the changes that `parts` stand for."""
    return F.aggregate(parts, start, lambda w, p: F.least(p["high"], F.greatest(p["low"], w + p["shift"])))


def counted(rows: DataFrame, order: list[str], what: str) -> DataFrame:
    """rows with `nth`: how many rows up to this one, in the order of some columns, have the boolean `what`.

    A window over all rows would be one task; here ranges of the order count by themselves, and the sums of
    the ranges before are added."""
    at = rows.columns.index(what)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.cumsum(pc.fill_null(batch.column(at), False).to_numpy(zero_copy_only=False)) + total
            total = int(n[-1]) if len(n) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(n.astype(np.int64))], [*batch.schema.names, "_range", "nth"])

    local = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, _range int, nth long"), "counted")
    sums = sorted((r["_range"], r["n"]) for r in local.groupBy("_range").agg(F.max("nth").alias("n")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n in sums)])
    known = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sums, before, strict=False)], "_range int, _before long")
    return local.join(F.broadcast(known), "_range").withColumn("nth", F.col("nth") + F.col("_before")).drop("_range", "_before")
