"""Exact top-k inner products through a pivot-distance index.

Vectors get one more coordinate that lifts them to equal length, so that the largest inner product
is the smallest distance. A vector's cell is its nearest pivot and the ring of its distance to it;
cells are packed into chunks. For a block of queries, the rings around each query's own place are
searched first and bound its k-th distance; then only the rings are read that the triangle
inequality doesn't put beyond the bound of every query of the block. Chunks lie in order of their
cells, so the choice of rings reaches the scan. Nothing is approximate: every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Pivots, rings of each, vectors of a chunk (about), queries of a block.
PIVOTS, RINGS, CHUNK_ROWS, BLOCK_QUERIES = 48, 24, 2048, 4096
#: Slack on bounds of float distances between integer vectors.
SLACK = 1e-6


def _stack(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths, no nulls, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def quantized(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, norm long): floor(scale * x) of each component, x as double. Rows whose
    vector or a component of it is null or not finite are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = rows.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e))
    out = whole.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return out.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, e: s + e * e))


class Space:
    """Lifted vectors and their distances to the pivots."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most = most
        self.pivots = self.lift(pivots)

    def lift(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.hstack([v, np.sqrt(np.maximum(self.most - (v * v).sum(1), 0))[:, None]])

    def to_pivots(self, v: np.ndarray) -> np.ndarray:
        x = self.lift(v)
        return np.sqrt(np.maximum(2 * self.most - 2 * (x @ self.pivots.T), 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k best of each row: larger score, then smaller id (-1 stays last)."""
    return np.lexsort((np.where(ids < 0, np.iinfo(np.int64).max, ids), -scores), axis=1)[:, :k]


class Search:
    """The best k of each query of a block so far."""

    EMPTY = -(2**62)

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space, k: int, bound: np.ndarray | None):
        self.ids, self.vectors, self.space, self.k = ids, vectors.astype(np.float64), space, k
        self.to_pivots = space.to_pivots(vectors) if len(ids) else np.zeros((0, len(space.pivots)))
        self.score = np.full((len(ids), k), self.EMPTY, np.int64)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.floor = np.full(len(ids), self.EMPTY, np.int64) if bound is None else bound

    def reach(self) -> np.ndarray:
        """Distance beyond which no vector can score as much as the k-th best."""
        low = np.maximum(self.floor, self.score[:, -1])
        return np.where(low == self.EMPTY, np.inf, np.sqrt(np.maximum(2 * self.space.most - 2.0 * low, 0)))

    def add(self, pivot: int, near: float, far: float, ids: np.ndarray, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        d = self.to_pivots[:, pivot]
        least = np.maximum(np.maximum(d - far, near - d), 0)
        use = least <= self.reach() * (1 + SLACK) + SLACK * np.sqrt(self.space.most) if only is None else only
        rows = np.flatnonzero(use)
        for at in range(0, len(rows), 512):
            r = rows[at : at + 512]
            s = np.rint(self.vectors[r] @ vectors.T).astype(np.int64)  # exact below 2**53
            s[ids[None, :] == self.ids[r][:, None]] = self.EMPTY
            if s.shape[1] > 4 * self.k:
                kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k]
                hit = (s >= np.maximum(kth, self.score[r, -1])[:, None]) & (s > self.EMPTY)
                for i in np.flatnonzero(hit.any(1)):
                    c = np.flatnonzero(hit[i])
                    self._merge(r[i : i + 1], s[i : i + 1, c], ids[c][None, :])
            else:
                self._merge(r, s, np.broadcast_to(ids, s.shape))

    def _merge(self, r, s, ids):
        both = np.hstack([self.score[r], s])
        names = np.where(both == self.EMPTY, -1, np.hstack([self.found[r], ids]))
        best = _best(both, names, self.k)
        self.score[r], self.found[r] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)

    def rows(self) -> pa.RecordBatch:
        q, c = np.nonzero(self.found >= 0) if len(self.ids) else (np.zeros(0, int),) * 2
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, c]), pa.array(self.score[q, c])], ["query_id", "vec_id", "score"])


def _pivots(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """A bounded sample that spans the rows: farthest-first traversal of 16 * n seeded rows."""
    rows = vectors.select("v", F.xxhash64(F.lit(seed), "v", "id").alias("u")).orderBy("u").limit(16 * n).collect()  # 16 * PIVOTS rows
    v = np.array([r["v"] for r in rows], np.float64)
    chosen = [0]
    away = ((v - v[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(v)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen]


def exact_topk(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, query_every: int = 50, scale: int = 256, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `query_every` the k rows
    of largest integer inner product of floor(scale * x), ties to the smaller id, never the row's own id.

    Vectors that are null, or hold null or non-finite components, take no part, nor do null ids;
    vectors of another length than most are left out too. With fewer candidates a query has fewer
    rows. Rows that share an id and a vector count once. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = quantized(rows, id_col, vector_col, scale).where("id IS NOT NULL")
    vectors = materialize(vectors.distinct(), "vectors")
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if lengths is None or not lengths["d"]:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("v") == lengths["d"])
    space = Space(_pivots(vectors, PIVOTS, seed), float(lengths["most"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.to_pivots(_stack(batch.column(1)))
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], ["id", "v", "pivot", "d"])

    placed = materialize(vectors.select("id", "v").mapInArrow(place, "id long, v array<long>, pivot int, d double"), "placed")
    spans = placed.groupBy("pivot").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))  # a row a pivot
    ring = F.least(F.lit(RINGS - 1), F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9) * RINGS)).cast("int")
    ringed = placed.join(F.broadcast(spans), "pivot").select("pivot", ring.alias("ring"), "d", "id", "v")
    rings = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    rings = materialize(rings, "rings")  # PIVOTS * RINGS rows at most
    # a crowded ring, say of one vector many times over, is dealt into chunks by a hash of the id
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK_ROWS)).cast("int")
    chunks = ringed.join(F.broadcast(rings.select("pivot", "ring", "n")), ["pivot", "ring"]).withColumn("chunk", deal)
    chunks = chunks.groupBy("pivot", "ring", "chunk").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.collect_list(F.struct("id", "v")).alias("rows"))
    cell = F.col("pivot") * RINGS + F.col("ring")
    chunks = chunks.select(cell.alias("cell"), "chunk", "pivot", "ring", "near", "far", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vs"))
    # in order of cells, so that a scan for some cells skips the files and row groups of others
    files = max(1, -(-placed.count() // (16 * CHUNK_ROWS)))
    chunks = materialize(chunks.repartitionByRange(files, "cell", "chunk").sortWithinPartitions("cell", "chunk"), "chunks")
    edges = rings.select("pivot", "ring", "lo", "hi").toPandas().sort_values(["pivot", "ring"], ignore_index=True)  # PIVOTS * RINGS rows at most
    cells = (edges["pivot"] * RINGS + edges["ring"]).to_numpy()
    width = lengths["d"]

    def of(wanted: np.ndarray) -> DataFrame:
        """The chunks of some cells: stretches of neighbouring ones are ranges that reach the scan."""
        wanted = np.unique(wanted)
        cut = np.flatnonzero(np.diff(np.searchsorted(cells, wanted), prepend=-2) != 1)
        here = F.lit(False)
        for a, b in zip(cut, np.append(cut[1:], len(wanted)), strict=True):
            here |= F.col("cell").between(int(wanted[a]), int(wanted[b - 1]))
        return chunks.where(here)

    def search(block: tuple[np.ndarray, np.ndarray], bound: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            s = Search(ids, q, space, k, bound)
            own = s.to_pivots.argmin(1)
            for batch in batches:
                for i in range(batch.num_rows):
                    pivot, ring, near, far = (batch.column(c)[i].as_py() for c in ("pivot", "ring", "near", "far"))
                    own_ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                    v = batch.column("vs")[i].values.to_numpy(zero_copy_only=False).reshape(len(own_ids), width).astype(np.float64)
                    only = (own == pivot) & (first[:, 0] <= ring) & (ring <= first[:, 1]) if bound is None else None
                    s.add(pivot, near, far, own_ids, v, only)
            yield s.rows()

        d = space.to_pivots(block[1])
        own = d.argmin(1)
        if bound is None:  # the rings around each query's own distance
            first = np.zeros((len(own), 2))
            wanted = []
            for p in np.unique(own):
                e = edges[edges["pivot"] == p]
                for r in np.flatnonzero(own == p):
                    at = min(int(np.searchsorted(e["hi"].to_numpy(), d[r, p])), len(e) - 1)
                    near = e["ring"].iloc[max(0, at - 1) : at + 2].to_numpy()
                    first[r] = near[0], near[-1]
                    wanted.append(p * RINGS + near)
            wanted = np.concatenate(wanted)
        else:  # every ring that the triangle inequality doesn't put beyond some query's bound
            reach = np.where(bound == Search.EMPTY, np.inf, np.sqrt(np.maximum(2 * space.most - 2.0 * bound, 0)))
            reach = reach * (1 + SLACK) + SLACK * np.sqrt(space.most)
            away = d[:, edges["pivot"]]
            least = np.maximum(np.maximum(away - edges["hi"].to_numpy(), edges["lo"].to_numpy() - away), 0)
            wanted = cells[(least <= reach[:, None]).any(0)]
        sent = spark.sparkContext.broadcast(block)  # BLOCK_QUERIES vectors
        return of(wanted).mapInArrow(run, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = None
    # queries near one another share a block, and so the cells that it reads
    queries = materialize(placed.where(F.col("id") % query_every == 0).select("id", "v", "pivot", "d"), "queries").orderBy("pivot", "d", "id")
    block: list = []

    def flush() -> None:
        nonlocal out, block
        ids, q = np.array([r["id"] for r in block], np.int64), np.array([r["v"] for r in block], np.float64)
        kth = {r["query_id"]: r["score"] for r in best(search((ids, q), None)).where(F.col("rank") == k).collect()}  # a row a query of the block
        bound = np.array([kth.get(int(i), Search.EMPTY) for i in ids], np.int64)
        # ids with several vectors: each keeps the bound of the better one, so search them unbounded
        twice = np.isin(ids, [i for i, n in zip(*np.unique(ids, return_counts=True), strict=True) if n > 1])
        bound[twice] = Search.EMPTY
        part = materialize(best(search((ids, q), bound)), "found")
        out = part if out is None else out.union(part)
        block = []

    for r in queries.toLocalIterator():  # a block at a time
        block.append(r)
        if len(block) == BLOCK_QUERIES:
            flush()
    if block:
        flush()
    for x in (vectors, placed, rings, chunks, queries):
        drop_table(x)
    return spark.createDataFrame([], schema) if out is None else out
