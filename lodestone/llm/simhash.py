"""SimHash near-duplicate classes by a binary trie self-join.

Fingerprints stand in a binary trie, which a sorted array represents: a node is a range of the
array that shares its leading bits. Pairs of nodes descend together, add up the bits in which
their paths differ, and end as soon as the sum exceeds the Hamming budget. A large table is dealt to
nodes of bounded size: by the pigeonhole, keys within the budget share whole blocks of bits, so
there is a trie for each choice of blocks that come first, and near keys lie in one node of
some such trie, which one task walks. Where keys crowd in a node it is cut into smaller ones, and the
pairs of those within the budget meet. A task returns a spanning forest of the links it
found, never all pairs, and the forests meet in a star contraction on DataFrames.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import Sieve, drop_table, materialize, mix, pieces, release, rolling, words_of

_U = np.uint64
#: Node pairs at most in one step of the walk, and leaves at most of a node that is compared whole.
_STEP, _LEAVES = 20_000, 8
#: Fingerprints of one trie node at most in a task, whatever the size of the table.
NODE_ROWS = 1 << 18
#: Heads of a node of equal keys that are compared with all of it before the rest is.
_HEADS = 3

#: For each byte the 64-bit number whose bytes are its bits: sums of up to 255 of them count bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(_U)[:, 0]


# ---------------------------------------------------------------- fingerprints


def _majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run at[i]:at[i+1] of h, the 64-bit number whose bits are set in over half of it."""
    n = np.diff(at)
    out = np.zeros(len(n), _U)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    cut = np.unique(np.concatenate([at[full], np.arange(0, len(h), 255)]))  # segments of one text, short enough for the lanes
    ends = np.append(cut, len(h))
    counts = []
    for i in range(0, len(cut), 256):
        a, b = ends[i], ends[min(i + 256, len(cut))]
        counts.append(np.add.reduceat(_LANES[h[a:b].view(np.uint8).reshape(-1, 8)], cut[i : i + 256] - a, axis=0).view(np.uint8))
    sums = np.add.reduceat(np.concatenate(counts), np.searchsorted(cut, at[full]), axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * sums > n[full][:, None], axis=1, bitorder="little").view(_U)[:, 0]
    return out


def _shingle_xxh64(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles of each text, and where each text's begin."""
    from xxhash import xxh64_intdigest

    out: list[int] = []
    at = np.zeros(len(words) + 1, np.int64)
    raw = words.buf.tobytes()
    start, end = words.start.tolist(), words.end.tolist()
    first = words.first.tolist()
    for i in range(len(words)):
        a, b = first[i], first[i + 1]
        if a < b:
            w = [raw[x:y] for x, y in zip(start[a:b], end[a:b], strict=True)]
            if b - a <= k:
                out.append(xxh64_intdigest(b" ".join(w), 42))
            else:
                line = b" ".join(w)
                stop = np.cumsum([len(x) + 1 for x in w])
                begin = [0, *stop[:-1].tolist()]
                out += [xxh64_intdigest(line[x:y], 42) for x, y in zip(begin, (stop[k - 1 :] - 1).tolist(), strict=False)]
        at[i + 1] = len(out)
    return np.array(out, _U), at


def _shingle_hash(words, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A fast 64-bit hash of the k-word shingles of each text, and where each text's begin; a text of fewer
    words is one shingle."""
    h = words.hashes() if h is None else h
    n = np.diff(words.first)
    whole = n >= k
    per = np.where(whole, n - k + 1, n > 0)
    at = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(at[-1], _U)
    to = np.flatnonzero(np.repeat(whole, per))
    if len(to):
        out[to] = rolling(h, k)[to + np.repeat((words.first[:-1] - at[:-1])[whole], per[whole])]
    for i in np.flatnonzero((n > 0) & ~whole):
        out[at[i]] = rolling(h[words.first[i] : words.first[i + 1]], n[i])[0]
    return out, at


def _once(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different hashes, ascending, and where each text's begin."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(at)))


def _text_hash(words, seed: int, h: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each text's word sequence; two seeds make 128 bits."""
    h = words.hashes(seed) if h is None else h
    place = np.arange(len(h)) - np.repeat(words.first[:-1], np.diff(words.first))
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h ^ _U(seed)) * (mix(place + seed) | _U(1)), out=total[1:])
    return mix((total[words.first[1:]] - total[words.first[:-1]]) ^ np.diff(words.first).astype(_U)).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): 64-bit SimHash over XXH64 of the word shingles, A-Z lower-cased. Texts of
    fewer words than a shingle count as one; null and wordless texts get fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 500_000):
                fp = _majority(*_shingle_xxh64(words_of(batch.column(1), lower=True), shingle))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- the trie walk


class _Side:
    """A sorted array of keys of `bits` bits (in the high bits of 64) seen as a binary trie."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def split(self, lo: np.ndarray, depth: int) -> np.ndarray:
        """For nodes that start at lo, where their second child begins."""
        prefix = self.keys[lo]
        if depth:
            prefix = prefix >> _U(64 - depth) << _U(64 - depth)
        else:
            prefix = np.zeros_like(prefix)
        return np.searchsorted(self.keys, prefix | (_U(1) << _U(63 - depth)))


def trie_pairs(a: np.ndarray, b: np.ndarray | None, budget: int, bits: int = 64, full: Callable[[int, int, int, int], None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in a, j in b) of keys that differ in at most `budget` bits, in blocks; a and b
    are sorted. b None: a against itself, each unordered pair at least once, i = j left out. full: takes
    the ranges of pairs of full-depth nodes of many equal keys, whose pairs are then not given."""
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    left, right = _Side(a), _Side(b)
    one = np.zeros(1, np.int64)
    stack = [(0, one, one + len(a), one, one + len(b), one)]
    while stack:
        depth, alo, ahi, blo, bhi, spent = stack.pop()
        small = (ahi - alo <= _LEAVES) & (bhi - blo <= _LEAVES)
        for i in range(0, int(small.sum()), 4096):  # so many fit the cache
            yield from _leaves(a, b, *(x[small][i : i + 4096] for x in (alo, ahi, blo, bhi)), budget, same)
        alo, ahi, blo, bhi, spent = (x[~small] for x in (alo, ahi, blo, bhi, spent))
        if depth == bits:
            for node in zip(alo, ahi, blo, bhi, strict=True):
                if full is None:
                    yield from _equal(*node, same)
                else:
                    full(*node)
            continue
        if not len(alo):
            continue
        amid = np.clip(left.split(alo, depth), alo, ahi)
        bmid = np.clip(right.split(blo, depth), blo, bhi)
        parts = []
        for al, ah, bl, bh, cost in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            keep = (al < ah) & (bl < bh) & (spent + cost <= budget)
            if same and cost:
                keep &= al <= bl  # the mirror image of a pair of different nodes is the same pair
            parts.append([x[keep] for x in (al, ah, bl, bh, spent + cost)])
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        for i in range(0, len(nxt[0]), _STEP):
            stack.append((depth + 1, *(x[i : i + _STEP] for x in nxt)))


def _leaves(a, b, alo, ahi, blo, bhi, budget, same):
    """Pairs of leaves within the budget below pairs of small nodes: one padded block of all."""
    width = np.arange(_LEAVES)
    i, j = alo[:, None] + width, blo[:, None] + width
    left, right = a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)]
    n, x, y = np.nonzero(np.bitwise_count(left[:, :, None] ^ right[:, None, :]) <= budget)
    i, j = i[n, x], j[n, y]
    ok = (i < ahi[n]) & (j < bhi[n])
    if same:
        ok &= i < j
    if ok.any():
        yield i[ok], j[ok]


def _equal(alo, ahi, blo, bhi, same):
    """All pairs of two full-depth nodes, some rows of the rectangle at a time."""
    step = max(1, 1_000_000 // (bhi - blo))
    for lo in range(alo, ahi, step):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, min(ahi, lo + step)), np.arange(blo, bhi), indexing="ij"))
        ok = i < j if same else np.ones(len(i), bool)
        if ok.any():
            yield i[ok], j[ok]


class Forest:
    """Union-find over 0..n-1, smallest member first."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flat(self) -> np.ndarray:
        r = self.root
        while True:
            nxt = r[r]
            if (nxt == r).all():
                return r
            r[:] = nxt

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs aren't known to be connected."""
        return self.root[i] != self.root[j]

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        """Contract by minimum labels: every round hooks the larger root of each pair on the smaller."""
        if not len(i):
            return
        r = self.root
        while len(i):
            self.flat()
            x, y = r[i], r[j]
            open_ = x != y
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            if len(i):
                np.minimum.at(r, np.maximum(x, y), np.minimum(x, y))
        self.flat()


def _link_equal(forest: Forest, x: np.ndarray, y: np.ndarray, link: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Link the near pairs of two full-depth nodes (x is y: of one with itself). Heads meet everyone first; what
    then is outside the largest class meets the rest exactly. Pairs already connected are never compared."""
    for step in range(_HEADS + 1):
        rx, ry = forest.root[x], forest.root[y]
        names, n = np.unique(np.concatenate([rx, ry]), return_counts=True)
        if len(names) == 1:
            return
        top = names[n.argmax()]
        if step < _HEADS:
            one, others = (x[rx != top], y) if (rx != top).any() else (y[ry != top], x)
            link(np.full(len(others), one[0]), others)
    for part, whole in ((x[rx != top], y), (x[:0] if x is y else x[rx == top], y[ry != top])):
        size = max(1, 500_000 // max(1, len(whole)))
        for lo in range(0, len(part), size):
            rows = part[lo : lo + size]
            i, j = np.nonzero(forest.root[rows][:, None] != forest.root[whole][None, :])
            link(rows[i], whole[j])


def _walk(left: np.ndarray, right: np.ndarray | None, budget: int, bits: int, near=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions in left + right) of the links between two sorted key arrays.
    near(i, j): a further test of pairs."""
    n = len(left)
    forest = Forest(n + (0 if right is None else len(right)))
    own = np.arange(len(forest.root))

    def link(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            away = forest.apart(a, b)
            a, b = a[away], b[away]
            if near is not None and len(a):
                ok = near(a, b)
                a, b = a[ok], b[ok]
            forest.union(a, b)

    def full(alo: int, ahi: int, blo: int, bhi: int) -> None:
        x = own[alo:ahi]
        _link_equal(forest, x, x if right is None and alo == blo else own[blo:bhi] if right is None else own[n + blo : n + bhi], link)

    for i, j in trie_pairs(left, right, budget, bits, full):
        link(i, j if right is None else j + n)
    root = forest.flat()
    member = np.flatnonzero(root != own)
    return member, root[member]


# ---------------------------------------------------------------- cutting the trie


def _prefix(depth: int):
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def routes(bits: int, budget: int, depth: int) -> list[list[tuple[int, int]]]:
    """Ways to lead keys to `depth` bits that they share: for each a list of (first bit, bits) from the top.

    Keys of `bits` bits fall into budget + r blocks, of which near ones share r whole. Each choice of r blocks is a
    trie that has them on top: near keys lie in one node of some such trie. r is the least that gives
    enough bits, so a key has C(budget + r, r) copies, where as many nodes as 2**depth would have
    been near its own.
    """
    r = 0
    while r * (bits // (budget + r)) < depth and budget + r < bits:
        r += 1
    width = bits // (budget + r)
    each = min(width, -(-depth // r)) if r else 0
    return [[(b * width, each) for b in some] for some in itertools.combinations(range(budget + r), r)]


def _routed(keys: DataFrame, bits: int, budget: int, limit: int, rows: int) -> DataFrame:
    """keys with a copy for each route (perm, route) that leads to nodes of about `limit` of `rows` keys."""
    ways = routes(bits, budget, max(0, math.ceil(math.log2(max(1, rows) / limit))))

    def shared(way: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for first, n in way:
            part = F.shiftrightunsigned(F.shiftleft("key", first), 64 - n) if n else F.lit(0).cast("long")
            out = F.shiftleft(out, n).bitwiseOR(part)
        return out

    return keys.select("*", F.posexplode(F.array(*(shared(w) for w in ways))).alias("perm", "route"))


def cut_trie(keys: DataFrame, heavy: DataFrame, by: list[str], bits: int, limit: int) -> DataFrame:
    """(*by, depth, prefix, n): trie nodes that cover the keys of the groups `heavy` (by), in written tables. Nodes of
    more than `limit` rows are split two bits at a time until they are of one key."""
    depth, nodes = min(bits, 2), None
    part = keys.join(heavy.select(by), by, "left_semi")
    while True:
        found = materialize(part.groupBy(*by, _prefix(depth).alias("prefix")).agg(F.count("*").alias("n")).withColumn("depth", F.lit(depth)), "nodes")
        light = found if depth == bits else found.where(F.col("n") <= limit)
        nodes = light if nodes is None else nodes.unionByName(light)
        open_ = found.where(F.col("n") > limit).select(*by, "prefix")
        if depth == bits or not open_.limit(1).count():
            return nodes
        part = keys.withColumn("prefix", _prefix(depth)).join(open_, [*by, "prefix"], "left_semi")
        depth = min(bits, depth + 2)


def near_nodes(blocks: DataFrame, by: list[str], budget: int) -> DataFrame:
    """(pair, side, *by, depth, prefix, chunk): for each pair of blocks of one group whose paths differ in at most
    `budget` bits as far as both go its two sides; one for a block with itself."""
    own = [*by, "depth", "prefix", "chunk"]
    a = blocks.select(F.struct(*own).alias("l"), *by)
    b = blocks.select(F.struct(*own).alias("r"), *by)
    shared = "least(l.depth, r.depth)"
    near = F.expr(f"bit_count(shiftrightunsigned(l.prefix, l.depth - {shared}) ^ shiftrightunsigned(r.prefix, r.depth - {shared})) <= {budget}")
    met = materialize(a.join(b, by).where((F.col("l") <= F.col("r")) & near).select("l", "r").withColumn("pair", F.monotonically_increasing_id()), "pairs")
    return met.select("pair", F.lit(0).alias("side"), "l.*").unionByName(met.where(F.col("l") < F.col("r")).select("pair", F.lit(1).alias("side"), "r.*"))


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected `edges` (a, b) reaches.
    Alternates large-star and small-star contraction (Kiveris et al. 2014), every round a written
    table; ends when a round changes nothing. A node of very many neighbours stands in plain
    joins of two tables, which AQE splits."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n, before = now.count(), None
    while True:
        # the written tables are read as they are, so that neither side of a join hides an aggregate
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", n)
        # large star: every neighbour above u goes to the smallest of u and its neighbours
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", n)
        # small star: every neighbour below u, and u itself, goes to the smallest of them
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges", n)
        stat = nxt.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")).first()
        for x in (now, low, large, low2):
            drop_table(x)
        now, n = nxt, stat["n"]
        if not n or stat == before:
            break
        before = stat
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


# ---------------------------------------------------------------- operators


def _walk_nodes(keys: DataFrame, by: list[str], value: str, limit: int, rows: int, bits: int, budget: int, walk: Callable[[list[pa.Array]], tuple[np.ndarray, np.ndarray]]) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): the links that `walk` finds in the groups to which near keys are led, and tables to drop once they are
    written. walk takes the values (column `value`) of one block of `limit` keys at most, or of two. A group of more,
    where keys crowd, is cut into nodes, those of one key into chunks, and its near blocks meet in pairs."""
    keys = _routed(keys, bits, budget, limit, rows)
    by = [*by, "perm", "route"]
    sizes = materialize(keys.groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    heavy = sizes.where(F.col("n") > limit)
    stat = sizes.agg(F.sum("n"), F.sum((F.col("n") > limit).cast("int"))).first()
    tasks = max(64, min(1 << 16, stat[0] // (NODE_ROWS // 4)))

    def table(a: np.ndarray, b: np.ndarray) -> pa.Table:
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def one(group: pa.Table) -> pa.Table:
        out = table(*walk([group.column(0).combine_chunks()]))
        release()
        return out

    def some(group: pa.Table) -> pa.Table:
        blocks, side = group.column("rows").combine_chunks(), group.column("side").to_numpy()
        out = table(*walk([blocks[int(i)].values for i in np.argsort(side)]))
        release()
        return out

    light = keys if not stat[1] else keys.join(heavy.select(by), by, "left_anti")
    edges = light.select(F.col(value).alias("value"), *by).repartition(tasks, *by).groupBy(*by).applyInArrow(one, "a long, b long")
    if not stat[1]:
        return edges, [sizes]
    cut = cut_trie(keys, heavy, by, bits, limit)
    nodes = materialize(cut.withColumn("chunks", F.ceil(F.col("n") / limit).cast("int")), "nodes")
    drop_table(cut)
    own = [*by, "depth", "prefix", "chunk"]
    blocks = nodes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(own)
    met = near_nodes(blocks, by, budget)
    sides = materialize(met, "sides")
    drop_table(met)
    located, crowded = None, keys.join(heavy.select(by), by, "left_semi")
    for r in nodes.select("depth").distinct().sort("depth").collect():  # bits / 2 + 1 rows at most
        at = nodes.where(F.col("depth") == r["depth"]).select(*by, "depth", "prefix", "chunks")
        here = crowded.withColumn("prefix", _prefix(r["depth"])).join(at, [*by, "prefix"])  # a key lies in exactly one node
        located = here if located is None else located.unionByName(here)
    located = located.withColumn("chunk", F.expr(f"int(pmod(xxhash64({value}), chunks))"))
    packed = located.groupBy(*own).agg(F.collect_list(value).alias("rows"))  # `limit` rows or so
    sent = packed.join(sides, own).select("pair", "side", "rows").repartition(max(64, min(1 << 16, sides.count())), "pair")
    return edges.unionByName(sent.groupBy("pair").applyInArrow(some, "a long, b long")), [sizes, nodes, sides]


def _with_least(named: DataFrame, name: str) -> DataFrame:
    """A written table of `named` (root, least, ...) with the smallest `least` of each row's root. A class
    may hold a third of all rows: it's joined between two written tables, so that no aggregate stands
    in the join's stage and AQE can split the class."""
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("least").alias(name)), "least")
    done = materialize(named.drop("least").join(least, "root"), "classes")
    drop_table(named)
    drop_table(least)
    return done


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """Every row's fingerprint and near-duplicate class: (id_col, fingerprint, component_id).

    Fingerprints are linked at `budget` or fewer differing bits; component_id is the smallest id
    reachable over links. Null and wordless texts have fingerprint 0 and are linked like others.
    Repeated rows stay; a null id takes part but never names a class unless the class has no other.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    keys = materialize(prints.groupBy(F.col("fp").alias("key")).agg(F.min("id").alias("least")), "keys")
    n = keys.count()
    if not n:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` long, fingerprint string, component_id long")

    def walk(blocks: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        sides = [np.sort(x.to_numpy(zero_copy_only=False).view(_U)) for x in blocks]
        x, y = _walk(sides[0], sides[1] if len(sides) > 1 else None, budget, 64)
        both = np.concatenate(sides).view(np.int64)
        return both[x], both[y]

    # smaller nodes only make more tasks of a small table
    edges, used = _walk_nodes(keys.select("key"), [], "key", min(NODE_ROWS, max(1024, n // 16)), n, 64, budget, walk)
    roots = components(edges)
    named = keys.join(roots, keys["key"] == roots["node"], "left").select("key", F.coalesce("root", "key").alias("root"), "least")
    classes = _with_least(named, "component_id").select("key", "component_id")
    for x in (keys, *used):
        drop_table(x)
    # rows of a hot fingerprint are on the streamed side of a plain equi-join, which AQE can split
    return prints.join(classes, prints["fp"] == classes["key"]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: The near-duplicate operator's SimHash parts: words of the fingerprint that makes keys, 64-bit numbers of
#: it, 64-bit numbers of the one on full shingles that filters candidates, how many of those the tries carry
#: (every trie holds a copy), standard errors of slack in the filter.
KEY_SHINGLE, KEY_WORDS, SIGN_WORDS, WALK_WORDS, SLACK = 2, 8, 6, 2, 4
#: Weight of the texts that one task verifies on one side: their different shingles, and as many as
#: TEXT_WEIGHT more a text, so that many short ones stay bounded too.
VERIFY_WEIGHT, TEXT_WEIGHT = 2_000_000, 100


def differing_share(similarity: float) -> float:
    """Expected share of differing SimHash bits of two shingle sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def row_hash(text: Column) -> Column:
    """Tells a row from others of the same id."""
    return F.xxhash64(text.cast("string"))


def _bytes(values: pa.Array, width: int) -> np.ndarray:
    """The rows of a binary column of equal widths as a byte matrix, not copied."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset]
    return np.frombuffer(data, np.uint8)[at : at + len(values) * width].reshape(-1, width) if len(values) else np.zeros((0, width), np.uint8)


def exact_links(sets: list[np.ndarray], signs: np.ndarray, right: np.ndarray | None, most: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets (of different entries) have Jaccard `similarity` or
    more, of those whose signs differ in at most `most` bits. right: only pairs of a set outside and
    one inside this mask."""
    size = np.array([len(x) for x in sets])
    at = np.concatenate(([0], np.cumsum(size)))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(ids), bool)
    root = np.arange(len(sets))
    out = []
    for i in range(len(sets)) if right is None else np.flatnonzero(~right):
        js = i + 1 + np.flatnonzero(root[i + 1 :] != root[i]) if right is None else np.flatnonzero(right & (root != root[i]))
        js = js[np.minimum(size[js], size[i]) >= similarity * np.maximum(size[js], size[i]) - 1e-9]
        js = js[np.bitwise_count(signs[js] ^ signs[i]).sum(1, dtype=np.int32) <= most]
        if not len(js):
            continue
        mark[ids[at[i] : at[i + 1]]] = True
        common = np.array([np.count_nonzero(mark[ids[at[j] : at[j + 1]]]) for j in js])
        mark[ids[at[i] : at[i + 1]]] = False
        js = js[common >= similarity * (size[js] + size[i] - common) - 1e-9]
        if len(js):
            met, one = np.unique(root[js], return_index=True)
            out += [(int(i), int(j)) for j in js[one]]
            root[np.isin(root, met)] = root[i]
    return out


def _verified(docs: DataFrame, texts: DataFrame, roots: DataFrame, text_col: str, shingle: int, most: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links by exact Jaccard of the shingle sets between texts of one component of candidates (roots:
    node, root), a spanning forest of them in each task; and tables to drop once they are written.
    Components are dealt to tasks by weight; one heavier than VERIFY_WEIGHT is cut in chunks that meet in
    pairs."""
    members = roots.union(roots.select("root", "root")).distinct().toDF("node", "root")
    members = materialize(members.join(texts.select("node", "h1", "h2", F.expr(f"substring(prints, 1, {8 * SIGN_WORDS})").alias("sign")), "node"), "members")
    sieve = Sieve(members, "h1")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 500_000):
                words = words_of(batch.column(0), lower=True)
                h = words.hashes()
                h1 = _text_hash(words, 0, h)
                use = np.flatnonzero(sieve.test(h1) & (np.diff(words.first) > 0))
                if len(use):
                    own = _Some(words.first, use)
                    hh, begin = _once(*_shingle_hash(own, shingle, h[own.rows]))
                    rows = pa.array([hh[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(h1[use]), pa.array(_text_hash(words, 1)[use]), rows], ["h1", "h2", "shingles"])
        release()

    def verify(group: pa.Table) -> pa.Table:
        root, node, right = (group.column(c).to_numpy() for c in ("root", "node", "right"))
        sets = [np.frombuffer(x.as_buffer(), _U) for x in group.column("shingles")]
        signs = _bytes(group.column("sign").combine_chunks(), 8 * SIGN_WORDS).view(_U)
        order = np.argsort(root, kind="stable")
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            side = right[rows] if right.any() else None
            for i, j in exact_links([sets[x] for x in rows], signs[rows], side, most, similarity):
                a.append(node[rows[i]])
                b.append(node[rows[j]])
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = spread(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(shingles, "h1 long, h2 long, shingles binary")
    sets = sets.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))  # copies meet on the map side already
    sets = materialize(members.join(sets, ["h1", "h2"]).select("node", "root", "sign", "shingles"), "sets")
    heavy = materialize(sets.groupBy("root").agg(F.sum(F.length("shingles") / 8 + TEXT_WEIGHT).alias("weight")), "weights")
    total = heavy.agg(F.sum("weight")).first()[0] or 0
    buckets = max(1, math.ceil(total / VERIFY_WEIGHT))
    dealt = sets.join(heavy.select("root", F.ceil(F.col("weight") / VERIFY_WEIGHT).cast("int").alias("chunks")), "root")
    dealt = dealt.withColumn("chunk", F.expr("int(pmod(xxhash64(node), chunks))")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    light = F.col("chunks") == 1
    dealt = dealt.select(
        light.alias("light"), F.when(light, F.expr(f"pmod(xxhash64(root), {buckets})")).otherwise(F.col("root")).alias("part"),
        F.least("chunk", "other").alias("l"), F.greatest("chunk", "other").alias("r"), (F.col("chunk") > F.col("other")).alias("right"), "root", "node", "sign", "shingles",
    )
    return dealt.groupBy("light", "part", "l", "r").applyInArrow(verify, "a long, b long"), [members, sets, heavy]


class _Some:
    """Some texts of a run of words: where each one's words begin in the words of those texts alone."""

    def __init__(self, first: np.ndarray, use: np.ndarray):
        n = np.diff(first)[use]
        self.first = np.concatenate(([0], np.cumsum(n)))
        self.rows = np.arange(self.first[-1]) + np.repeat(first[use] - self.first[:-1], n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """(id, row, class_id, keep): near-duplicate classes of texts by similarity, not by equal prints.

    64 * KEY_WORDS bits of SimHash over 2-word shingles give tries of 32-bit keys; pairs within
    `budget` bits in some trie are candidates if 64 * WALK_WORDS bits of SimHash over `shingle`-word
    shingles allow it, and then 64 * SIGN_WORDS bits, at the share of differing bits of `similarity` plus SLACK
    standard errors. Each
    different shingle votes once, and pairs of a component of candidates are linked by the exact
    Jaccard similarity of their sets of `shingle`-word shingles (64-bit hashes). Classes are the
    connected components of links; class_id is the smallest id. row is `row_hash` of the text, which with
    the id names a row; keep: whether it is the one of its class to stay (smallest id, then row; null
    ids come last). Texts without words are no one's copy and aren't in the result; equal word
    sequences (A-Z lower-cased, compared by 128 bits) always share a class. Repeated rows share a class and
    `keep`. An empty table gives no rows; other columns are ignored.
    """
    share = differing_share(similarity)
    walk_most, most = (round(bits * share + SLACK * math.sqrt(bits * share * (1 - share))) for bits in (64 * WALK_WORDS, 64 * SIGN_WORDS))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 500_000):
                words = words_of(batch.column(2), lower=True)
                own = words.hashes()
                prints = []
                for k, n in ((shingle, SIGN_WORDS), (KEY_SHINGLE, KEY_WORDS)):
                    h, at = _once(*_shingle_hash(words, k, own))
                    prints += [_majority(mix(h ^ _U(0x9E37 * (s + 1))), at) for s in range(n)]
                blob = np.stack(prints, 1).tobytes()
                width = 8 * len(prints)
                rows = pa.array([blob[i : i + width] for i in range(0, len(blob), width)], pa.binary())
                out = [batch.column(0), batch.column(1), pa.array(_text_hash(words, 0, own)), pa.array(_text_hash(words, 1)), rows]
                yield pa.RecordBatch.from_arrays(out, ["id", "row", "h1", "h2", "prints"]).filter(pa.array(np.diff(words.first) > 0))
        release()

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(text).alias("row"), text.alias("text"))
    signed = materialize(spread(rows).mapInArrow(sign, "id long, row long, h1 long, h2 long, prints binary"), "signs")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    texts = materialize(signed.groupBy("h1", "h2").agg(least, F.first("prints").alias("prints")).withColumn("node", F.monotonically_increasing_id()), "texts")
    n = texts.count()
    if not n:
        return docs.sparkSession.createDataFrame([], "id long, row long, class_id long, keep boolean")

    # for each trie a row with 32 bits of the key print, big end first, and what the walk needs: node, sign, key
    half = [F.expr(f"substring(prints, {8 * SIGN_WORDS + 4 * t + 1}, 4)") for t in range(2 * KEY_WORDS)]
    named = F.to_binary(F.lpad(F.hex("node"), 16, "0"), F.lit("hex"))
    keys = texts.select(named.alias("name"), F.expr(f"substring(prints, 1, {8 * WALK_WORDS})").alias("sign"), F.posexplode(F.array(*half)).alias("trie", "k"))
    keys = keys.select("trie", F.shiftleft(F.conv(F.hex("k"), 16, 10).cast("long"), 32).alias("key"), F.concat("name", "sign", "k").alias("value"))

    def walk(blocks: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        sides = []
        for x in blocks:
            m = _bytes(x, 12 + 8 * WALK_WORDS)
            k = np.ascontiguousarray(m[:, -4:]).view(">u4")[:, 0].astype(_U) << _U(32)
            order = np.argsort(k, kind="stable")
            sides.append((k[order], m[order]))
        both = np.concatenate([m for _, m in sides])
        node, own = np.ascontiguousarray(both[:, :8]).view(">i8")[:, 0].astype(np.int64), np.ascontiguousarray(both[:, 8:-4]).view(_U)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.bitwise_count(own[i] ^ own[j]).sum(1, dtype=np.int32) <= walk_most

        x, y = _walk(sides[0][0], sides[1][0] if len(sides) > 1 else None, budget, 32, near)
        return node[x], node[y]

    edges, used = _walk_nodes(keys, ["trie"], "value", NODE_ROWS, n, 32, budget, walk)
    links, more = _verified(docs, texts, components(edges), text_col, shingle, most, similarity)
    roots = components(links)
    named = texts.select("h1", "h2", "node", "least").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"), "least")
    classes = _with_least(named, "first").select("h1", "h2", "first")
    for x in (texts, *used, *more):
        drop_table(x)
    out = signed.select("id", "row", "h1", "h2").join(classes, ["h1", "h2"])
    keep = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))
    return out.select("id", "row", F.col("first.id").alias("class_id"), keep.alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each class of `near_duplicates` the one row to
    keep, and of rows equal in id and text one. Texts without words stay, once for each id and text. An empty
    table gives no rows. A row goes by id and text, so that a text of its own stays whatever shares its id.

    Only rows whose text may have to go, or stands twice under its id, are shuffled.
    """
    columns = docs.columns
    free = next(p for p in (f"_{i}_" for i in itertools.count()) if not any(c.startswith(p) for c in columns))
    name, other_id, other_row = f"{free}row", f"{free}gone_id", f"{free}gone_row"
    rows = docs.withColumn(name, row_hash(F.col(text_col)))
    marked = near_duplicates(docs, id_col, text_col, shingle, similarity, budget)
    gone = marked.where(~F.col("keep")).select("id", "row", F.lit(True).alias("gone")).distinct()
    twice = rows.groupBy(F.col(id_col).cast("long").alias("id"), F.col(name).alias("row")).agg(F.count("*").alias("n")).where("n > 1").select("id", "row", F.lit(False).alias("gone"))
    marks = materialize(gone.unionByName(twice), "marks")
    maybe = Sieve(marks, "row").passes(name)
    gone = marks.where("gone").select(F.col("id").alias(other_id), F.col("row").alias(other_row))
    rest = rows.where(maybe).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(other_id)) & (F.col(name) == F.col(other_row)), "left_anti")
    return rows.where(~maybe).unionByName(rest.dropDuplicates([id_col, name])).select(*(F.col(f"`{c}`") for c in columns))
