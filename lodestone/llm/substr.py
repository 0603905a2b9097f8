"""Removal of repeated word windows through a compacted de Bruijn graph.

The edges of the graph are the windows of `window` consecutive words. As in partitioned genome
assembly, an edge goes to the bucket of its minimiser (the smallest hash of its shorter word
k-mers, those of very many edges last), so that runs of consecutive edges travel together and equal
edges meet. A bucket names, for each repeated edge, the coordinates where it starts first; edges that
follow one another in a document and in its source form a nonbranching path. Edges of frequent k-mers
alone, say of a passage in a third of all texts, are aggregated and joined by Spark instead. Spark joins
the pieces of paths of all buckets by document, where they compact into maximal spans with source
coordinates. Every span is then verified against the words at its source; edges of one hash but
different words are settled anew by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import CHUNK_BYTES, Sieve, drop_table, materialize, mix, pieces, release, rolling, words_of

_U = np.uint64
#: Edges that a bucket should hold about, and text bytes that an edge stands for.
BUCKET_EDGES, BYTES_PER_EDGE = 1_000_000, 6
#: One row in SAMPLE shows which k-mers have more edges than a bucket should. It balances the load alone:
#: results don't depend on it.
SAMPLE = 32
#: Hashes that one pass over the texts settles anew.
AGAIN = 1_000_000
#: Stands for a null id: later than any other.
LAST = 2**63 - 1
_TOP = _U(1 << 63)

_RUN = ["id", "tag", "start", "n", "src", "src_tag", "src_start"]
_RUN_TYPES = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32]


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive entries, by doubling."""
    have, width = x, 1
    while 2 * width <= k:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = k - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def _runs(*columns: np.ndarray, step: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a new run begins in sorted rows: a column changes, or a step column doesn't grow by 1."""
    n = len(step[0])
    new = np.ones(n, bool)
    if n > 1:
        same = np.ones(n - 1, bool)
        for c in columns:
            same &= c[1:] == c[:-1]
        for c in step:
            same &= c[1:] == c[:-1] + 1
        new[1:] = ~same
    return np.flatnonzero(new)


def _lengths(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begin, n))


def _removed(h, own: list[np.ndarray], order_by: list[np.ndarray]):
    """Of edges with hashes h and coordinates own = [id, tag, pos]: those that also start earlier
    (by order_by, most significant first) and, for each, the row of its first start."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    order = order[again]
    order = order[np.lexsort((*[c[order] for c in reversed(order_by)], h[order]))]
    hh = h[order]
    head = np.concatenate(([True], hh[1:] != hh[:-1])) if len(hh) else np.zeros(0, bool)
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(hh) else order
    later = np.zeros(len(order), bool)
    for c in order_by:
        later |= c[order] != c[first]
    return order[later], first[later]


def _pack_runs(ids, tags, pos, gone, first) -> list[np.ndarray]:
    """Runs [id, tag, start, n, src, src_tag, src_start] of removed edges."""
    order = np.lexsort((pos[gone], tags[gone], ids[gone]))
    gone, first = gone[order], first[order]
    begin = _runs(ids[gone], tags[gone], ids[first], tags[first], step=(pos[gone], pos[first]))
    g, f = gone[begin], first[begin]
    return [x.astype(t) for x, t in zip((ids[g], tags[g], pos[g], _lengths(begin, len(gone)), ids[f], tags[f], pos[f]), _RUN_TYPES, strict=True)]


def _windows(batch: pa.RecordBatch, window: int, seed: int, bits: int):
    """The edges of a piece of texts (id, tag, text): row, position, hash and minimiser of each."""
    w = words_of(batch.column(2))
    n = np.maximum(np.diff(w.first) - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    if not len(row):
        return row, row.astype(np.int32), np.zeros(0, _U), np.zeros(0, _U)
    at = np.arange(len(row)) + np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    hashes = w.hashes(seed)
    short = max(1, window // 2)
    return row, (at - w.first[row]).astype(np.int32), rolling(hashes, window)[at] & _U((1 << bits) - 1), (mix(rolling(hashes, short) ^ _U(seed)) >> _U(1), window - short + 1, at)


def _minimisers(low, frequent: Sieve | None) -> np.ndarray:
    """The smallest k-mer hash of each edge, frequent ones (with the top bit) last."""
    own, width, at = low
    if frequent is not None:
        own = np.where(frequent.test(own), own | _TOP, own)
    return _sliding_min(own, width)[at]


def _frequent(rows: DataFrame, window: int, seed: int) -> Sieve | None:
    """The minimisers that about BUCKET_EDGES edges or more have, by a hashed sample of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 2 * CHUNK_BYTES):
                row, _, _, low = _windows(batch, window, seed, 64)
                if len(row):
                    x, n = np.unique(_minimisers(low, None), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], ["low", "n"])

    sample = rows.where(F.pmod(F.xxhash64("key", "tag"), F.lit(SAMPLE)) == 0).select("key", "tag", "text")
    often = sample.mapInArrow(run, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= BUCKET_EDGES / SAMPLE).select("low")
    often = materialize(often, "often")
    found = Sieve(often, "low") if often.limit(1).count() else None
    drop_table(often)
    return found


def _edges(buckets: int, window: int, seed: int, bits: int, frequent: Sieve | None):
    """Map side: packed runs of edges for each bucket; edges that start earlier in the same piece
    of a partition are settled here and never shuffled with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "a", "b", "c", "d", "e"]
        for whole in batches:
            for batch in pieces(whole, "text", 2 * CHUNK_BYTES):
                row, pos, edge, low = _windows(batch, window, seed, bits)
                if not len(row):
                    continue
                low = _minimisers(low, frequent)
                if frequent is not None:
                    rare = low < _TOP
                    row, pos, edge, low = row[rare], pos[rare], edge[rare], low[rare]
                ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
                tags = batch.column(1).to_numpy(zero_copy_only=False)[row]
                gone, first = _removed(edge, [ids, tags, pos], [ids, pos])
                if len(gone):
                    local = _pack_runs(ids, tags, pos, gone, first)
                    size = 100_000
                    for i in range(0, len(local[0]), size):
                        part = [x[i : i + size] for x in local]
                        blobs = [np.stack([part[0], part[4]], 1), np.stack([part[1], part[5]], 1), np.stack([part[2], part[6]], 1), part[3]]
                        to = -1 - int(mix(part[0][:1].view(_U))[0] % _U(buckets))  # any group will do
                        yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([b""], pa.binary())], names)
                keep = np.ones(len(edge), bool)
                keep[gone] = False
                keep = np.flatnonzero(keep)
                if not len(keep):
                    continue
                bucket = (mix(low[keep]) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keep, bucket = keep[order], bucket[order]
                begin = _runs(bucket, row[keep], step=(pos[keep],))
                k, size = keep[begin], _lengths(begin, len(keep))
                cut = np.flatnonzero(np.diff(bucket[begin], prepend=-1))
                ends, total = np.append(cut[1:], len(begin)), np.concatenate(([0], np.cumsum(size)))
                out = [[] for _ in names]
                for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
                    x = k[a:b]
                    blobs = (ids[x], tags[x], pos[x], size[a:b].astype(np.int32), edge[keep[total[a] : total[b]]])
                    for o, v in zip(out, (int(bucket[begin[a]]), *(v.tobytes() for v in blobs)), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(o, pa.binary()) for o in out[1:])], names)
            release()

    return run


def _packed(out: list[np.ndarray], blocks: int) -> list[pa.Array]:
    """Runs as rows (block, *_RUN), packed by block of documents."""
    block = (mix((out[0] ^ out[1]).view(_U)) % _U(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, out = block[order], [x[order].astype(t) for x, t in zip(out, _RUN_TYPES, strict=True)]
    cut = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(cut[1:], len(block))[: len(cut)]
    return [pa.array(block[cut], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for x in out)]


def _settle(blocks: int):
    """Reduce side: a bucket's runs of edges that also start earlier, packed by block of documents."""

    def run(group: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

        if group.num_rows and group.column("bucket")[0].as_py() < 0:
            a, b, c = (column(x, k).reshape(-1, 2) for x, k in (("a", np.int64), ("b", np.int64), ("c", np.int32)))
            out = [a[:, 0], b[:, 0], c[:, 0], column("d", np.int32), a[:, 1], b[:, 1], c[:, 1]]
        else:
            n = column("d", np.int32)
            begin = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
            ids, tags = np.repeat(column("a", np.int64), n), np.repeat(column("b", np.int64), n)
            pos = np.repeat(column("c", np.int32) - begin.astype(np.int32), n) + np.arange(len(ids), dtype=np.int32)
            gone, first = _removed(column("e", _U), [ids, tags, pos], [ids, pos])
            out = _pack_runs(ids, tags, pos, gone, first)
        out = pa.table(_packed(out, blocks), ["block", *_RUN])
        release()
        return out

    return run


def _frequent_runs(rows: DataFrame, blocks: int, window: int, seed: int, bits: int, frequent: Sieve) -> DataFrame:
    """(block, *_RUN): the runs, of one edge each, of edges of frequent k-mers alone. Such an edge may start in a
    third of all texts, so its first start is a combined minimum and the rest is a plain join."""
    kinds = "h long, id long, tag long, pos int, src long, src_tag long, src_pos int"
    names = [x.split(" ")[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 2 * CHUNK_BYTES):
                row, pos, edge, low = _windows(batch, window, seed, bits)
                if len(row):
                    often = np.flatnonzero(_minimisers(low, frequent) >= _TOP)
                    row, pos, edge = row[often], pos[often], edge[often]
                    ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
                    gone, first = _removed(edge, [ids, tags, pos], [ids, pos])
                    src = np.full(len(row), -1)
                    src[gone] = first
                    none = src < 0
                    own = [edge.view(np.int64), ids, tags, pos]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), *(pa.array(x[src], mask=none) for x in (ids, tags, pos))], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t, p, s, u, q = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays(_packed([i, t, p, np.ones(len(i), np.int32), s, u, q], blocks), ["block", *_RUN])

    found = materialize(rows.select("key", "tag", "text").mapInArrow(run, kinds), "frequent")
    open_ = found.where("src IS NULL").select("h", "id", "tag", "pos")
    first = materialize(open_.groupBy("h").agg(F.min(F.struct("id", "pos", "tag")).alias("f")), "firsts")
    later = open_.join(first, "h").where((F.col("id") != F.col("f.id")) | (F.col("pos") != F.col("f.pos"))).select("id", "tag", "pos", F.col("f.id").alias("src"), F.col("f.tag").alias("src_tag"), F.col("f.pos").alias("src_pos"))
    return later.unionByName(found.where("src IS NOT NULL").drop("h")).mapInArrow(pack, _PACKED)


_PACKED = "block long, " + ", ".join(f"{c} binary" for c in _RUN)
_MARKS = "id long, tag long, spans array<struct<start:int,n:int,src:long,src_tag:long,src_start:int>>, asked array<struct<src_start:int,n:int>>"
_LISTS = {
    "spans": pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("src", pa.int64()), ("src_tag", pa.int64()), ("src_start", pa.int32())])),
    "asked": pa.list_(pa.struct([("src_start", pa.int32()), ("n", pa.int32())])),
}


def _list(values: np.ndarray, columns: list[np.ndarray], names: list[str], n: int) -> pa.Array:
    """Struct rows as lists, `values` telling (in order) the list of n that each belongs to."""
    kinds = [pa.int64() if x in ("src", "src_tag") else pa.int32() for x in names]
    rows = pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=n)))).astype(np.int32)), rows)


def _compact(group: pa.Table) -> pa.Table:
    """Glue the runs of a block's documents into maximal paths that follow one source: rows (id, tag,
    spans, null). And what the block's paths need to know of each source, once: rows (id, tag, null,
    asked)."""
    names = ["id", "tag", "spans", "asked"]
    ids, tags, start, n, src, src_tag, at = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in zip(_RUN, _RUN_TYPES, strict=True))
    shift = at - start
    order = np.lexsort((start, shift, src_tag, src, tags, ids))
    ids, tags, start, n, src, src_tag, shift = (v[order] for v in (ids, tags, start, n, src, src_tag, shift))
    begin = _breaks(ids, tags, src, src_tag, shift, more=start[1:] > start[:-1] + n[:-1])
    n = np.maximum.reduceat(start + n, begin) - start[begin]
    ids, tags, start, src, src_tag, at = (v[begin] for v in (ids, tags, start, src, src_tag, start + shift))
    doc = _breaks(ids, tags)
    row = np.repeat(np.arange(len(doc)), _lengths(doc, len(ids)))
    spans = _list(row, [start, n, src, src_tag, at], ["start", "n", "src", "src_tag", "src_start"], len(doc))
    own = pa.table([pa.array(ids[doc]), pa.array(tags[doc]), spans, pa.nulls(len(doc), _LISTS["asked"])], names)
    order = np.lexsort((n, at, src_tag, src))
    src, src_tag, at, n = (v[order] for v in (src, src_tag, at, n))
    new = _breaks(src, src_tag, at, n)
    src, src_tag, at, n = (v[new] for v in (src, src_tag, at, n))
    doc = _breaks(src, src_tag)
    asked = _list(np.repeat(np.arange(len(doc)), _lengths(doc, len(src))), [at, n], ["src_start", "n"], len(doc))
    other = pa.table([pa.array(src[doc]), pa.array(src_tag[doc]), pa.nulls(len(doc), _LISTS["spans"]), asked], names)
    return pa.concat_tables([own, other])


def _breaks(*columns: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Where sorted rows differ from the ones before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False if more is None else more
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_CHECKS = "array<struct<src:long,src_tag:long,src_start:int,n:int,digest:string>>"


def _cut(window: int, with_text: bool):
    """Apply the spans to the texts; tell a digest of what stands at both ends of each span. Edges settled
    anew (`met`, those of them that go: `gone`) override the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                cols = {k: [] for k in ("id", "tag", "key", "n_words", "n_removed", "kept_sha256", "text", "checks")}
                texts = batch.column(1)
                said: set[tuple] = set()
                for i in range(batch.num_rows):
                    text = texts[i].as_py()
                    words = (text or "").encode().split()
                    spans, asked, met, again, tag, key = (batch.column(c)[i].as_py() for c in ("spans", "asked", "met", "gone", "tag", "key"))
                    ends = [(key, tag, s["src_start"], s["n"], s["src_start"]) for s in asked or ()]
                    ends += [(s["src"], s["src_tag"], s["src_start"], s["n"], s["start"]) for s in spans or ()]
                    for *end, p in ends:
                        said.add((*end, hashlib.blake2b(b" ".join(words[p : p + end[3] + window - 1]), digest_size=16).hexdigest()))
                    kept, gone = words, 0
                    if spans or again:
                        edges = np.zeros(max(0, len(words) - window + 1) + 1, np.int32)
                        if spans:
                            a, n = np.array([s["start"] for s in spans]), np.array([s["n"] for s in spans])
                            np.add.at(edges, a, 1)
                            np.add.at(edges, a + n, -1)
                        edges = np.cumsum(edges[:-1]) > 0
                        if met:
                            edges[met] = False
                            edges[again or []] = True
                        drop = np.zeros(len(words) + 1, np.int32)
                        at = np.flatnonzero(edges)
                        drop[at] += 1
                        drop[at + window] -= 1
                        stay = np.cumsum(drop[:-1]) == 0
                        gone = int(len(words) - stay.sum())
                        kept = [words[j] for j in np.flatnonzero(stay)]
                        if with_text and gone:
                            w = words_of(pa.array([text]))
                            sides = np.flatnonzero(np.diff(np.concatenate(([0], stay.astype(np.int8), [0]))))
                            raw = text.encode()
                            text = b" ".join(raw[w.start[x] : w.end[y - 1]] for x, y in zip(sides[::2], sides[1::2], strict=True)).decode()
                    for c, v in zip(cols, (batch.column(0)[i].as_py(), tag, key, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest(), text if with_text else None, None), strict=True):
                        cols[c].append(v)
                # what the batch says of the two ends of its paths, once, with its first row
                cols["checks"][0] = [dict(zip(("src", "src_tag", "src_start", "n", "digest"), x, strict=True)) for x in sorted(said)] or None
                kinds = {"text": pa.string(), "kept_sha256": pa.string(), "checks": pa.list_(pa.struct([("src", pa.int64()), ("src_tag", pa.int64()), ("src_start", pa.int32()), ("n", pa.int32()), ("digest", pa.string())]))}
                out = [pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()]
                also = [c for c in batch.schema.names if c.startswith("also_")]
                yield pa.RecordBatch.from_arrays([*out, *(batch.column(c) for c in also)], [*cols, *also])

    return run


def _spans(rows: DataFrame, buckets: int, window: int, seed: int, bits: int) -> DataFrame:
    """A written table of the maximal repeated paths of each document (id, tag, spans) and of what the
    paths of others need to know of it (id, tag, asked)."""
    frequent = _frequent(rows, window, seed)
    edges = rows.select("key", "tag", "text").mapInArrow(_edges(buckets, window, seed, bits, frequent), "bucket long, a binary, b binary, c binary, d binary, e binary")
    runs = edges.groupBy("bucket").applyInArrow(_settle(buckets), _PACKED)
    if frequent is not None:
        runs = runs.unionByName(_frequent_runs(rows, buckets, window, seed, bits, frequent))
    return materialize(runs.groupBy("block").applyInArrow(_compact, _MARKS), "spans")


def _settled_anew(rows: DataFrame, wrong: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """A written table (key, tag, met, gone) of the rows with an edge whose hash some wrong span has: the positions
    of such edges and of those among them that go, by the words of the edges (128-bit digests)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, edge, _ = _windows(batch.slice(i, 1), window, seed, bits)
                found = [edge[r["src_start"] : r["src_start"] + r["n"]] for r in batch.column(3)[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["h"])

    def members(block: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, "text", 2 * CHUNK_BYTES):
                    row, pos, edge, _ = _windows(batch, window, seed, bits)
                    hit = np.flatnonzero(np.isin(edge, block))
                    digests, last, words = [], -1, []
                    for r, p in zip(row[hit].tolist(), pos[hit].tolist(), strict=True):
                        if r != last:
                            last, words = r, batch.column(2)[r].as_py().encode().split()
                        digests.append(hashlib.blake2b(b" ".join(words[p : p + window]), digest_size=16).digest())
                    ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[row[hit]] for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(pos[hit]), pa.array(digests, pa.binary())], ["key", "tag", "pos", "digest"])

        return run

    texts = rows.select("key", "tag", "text")
    asked = wrong.groupBy(F.col("src").alias("key"), F.col("src_tag").alias("tag")).agg(F.collect_list(F.struct("src_start", "n")).alias("ranges"))
    h = materialize(texts.join(asked, ["key", "tag"]).mapInArrow(hashes, "h long").distinct(), "again")
    found, block = None, []

    def flush() -> DataFrame:
        part = texts.mapInArrow(members(np.array(block, np.int64).view(_U)), "key long, tag long, pos int, digest binary")
        return materialize(part if found is None else found.unionByName(part), "members")

    for r in h.toLocalIterator():  # AGAIN hashes at a time
        block.append(r["h"])
        if len(block) == AGAIN:
            found, block = flush(), []
    found = flush() if block or found is None else found
    first = found.groupBy("digest").agg(F.min(F.struct("key", "pos")).alias("f"))
    marked = found.distinct().join(first, "digest").withColumn("later", (F.col("key") != F.col("f.key")) | (F.col("pos") != F.col("f.pos")))
    out = materialize(marked.groupBy("key", "tag").agg(F.collect_list("pos").alias("met"), F.collect_list(F.when(F.col("later"), F.col("pos"))).alias("gone")), "anew")
    for x in (h, found):
        drop_table(x)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = False, carry: list[str] | None = None, seed: int = 1, bits: int = 64) -> DataFrame:
    """One row for each input row: id_col, n_words, n_removed, kept_sha256, and with `with_text` the
    remaining text (kept stretches as they stood, joined by a space); `carry` names further columns.

    A word goes if it lies in a window of `window` consecutive words of its document whose word
    sequence also starts earlier: in a row of smaller id, or earlier in the same document. Windows
    are judged on the input. Words are split at ASCII white space and taken unchanged.
    Null texts have no words; texts shorter than a window lose none. Rows that share an id count as
    one place: neither is earlier than the other. A null id counts as later than any other.
    An empty table gives no rows; other columns are ignored. bits: of an edge's hash; with any number the
    result is the same.
    """
    carry = list(carry or ())
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tag"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"), *(F.col(c).alias(f"also_{c}") for c in carry))
    rows = spread(rows)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = _spans(rows, max(16, size // (BUCKET_EDGES * BYTES_PER_EDGE)), window, seed, bits)
    own = spans.where("spans IS NOT NULL").select(F.col("id").alias("key"), "tag", "spans")
    # all that ask for one stretch of a source ask once
    asked = spans.where("asked IS NOT NULL").select(F.col("id").alias("key"), "tag", F.explode("asked").alias("a")).distinct().groupBy("key", "tag").agg(F.collect_list("a").alias("asked"))
    marks = materialize(own.join(asked, ["key", "tag"], "full").withColumn("mark", F.xxhash64("key", "tag")), "marks")
    drop_table(spans)
    none = F.lit(None).cast("array<int>")
    kinds = dict(docs.select(*carry).dtypes) if carry else {}
    schema = f"id long, tag long, key long, n_words long, n_removed long, kept_sha256 string, text string, checks {_CHECKS}" + "".join(f", `also_{c}` {kinds[c]}" for c in carry)
    order = ["id", "text", "tag", "key", "spans", "asked", "met", "gone", *(f"also_{c}" for c in carry)]
    # texts that take no part in any path stay where they are
    rows = rows.withColumn("mark", F.xxhash64("key", "tag"))
    maybe = Sieve(marks, "mark").passes("mark")
    alone = rows.where(~maybe).withColumns({"spans": F.lit(None).cast(own.schema["spans"].dataType), "asked": F.lit(None).cast(marks.schema["asked"].dataType)})
    met = rows.where(maybe).drop("mark").join(marks.drop("mark"), ["key", "tag"], "left")
    done = materialize(alone.drop("mark").unionByName(met).withColumn("met", none).withColumn("gone", none).select(order).mapInArrow(_cut(window, with_text), schema), "cut")
    said = done.where("checks IS NOT NULL").select(F.inline("checks")).groupBy("src", "src_tag", "src_start", "n").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    wrong = materialize(said.where("a <> b").select("src", "src_tag", "src_start", "n"), "wrong")
    if wrong.limit(1).count():
        anew = _settled_anew(rows, wrong, window, seed, bits)
        again = rows.drop("mark").join(anew, ["key", "tag"]).join(marks.select("key", "tag", "spans"), ["key", "tag"], "left").withColumn("asked", F.lit(None).cast(marks.schema["asked"].dataType))
        both = done.join(anew, ["key", "tag"], "left_anti").select(done.columns).unionByName(again.select(order).mapInArrow(_cut(window, with_text), schema))
        first, done = done, materialize(both, "cut")
        drop_table(first)
        drop_table(anew)
    for x in (marks, wrong):
        drop_table(x)
    out = [F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *([F.col("text").alias(text_col)] if with_text else []), *(F.col(f"also_{c}").alias(c) for c in carry)]
    return done.select(*out)
