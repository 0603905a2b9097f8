"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may stand in a text with up to `rate * m` edits. Cut in one piece more
than that, it leaves at least one piece untouched wherever it stands. An automaton finds all exact
piece hits in one pass over a text; the places they point at are verified with Myers' bit-parallel
edit distance. Items come to the workers in blocks of bounded size, texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import spread

#: Edits allowed per character of an item, and the shortest piece that is looked up.
RATE, LEAST_PIECE = 0.06, 8
#: Characters from which an item of under five words has an error budget (scripts without spaces).
LEAST_CHARS = 25
#: From here on (Thai, Lao, Tibetan, East Asian scripts) words stand without spaces.
SPACELESS = "\u0e00"
#: Characters of items that one pass over the texts takes.
BLOCK_CHARS = 4_000_000


def normalize(text: str | None) -> str:
    """Lower case, single spaces."""
    return " ".join((text or "").lower().split())


def edits(item: str, rate: float = RATE) -> int:
    """The error budget of a normalized item: none for items of under five words that also have
    under LEAST_CHARS characters, and never so many that pieces get shorter than LEAST_PIECE."""
    if item.count(" ") < 4 and len(item) < LEAST_CHARS:
        return 0
    return max(0, min(int(rate * len(item)), len(item) // LEAST_PIECE - 1))


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of about equal length."""
    n = budget + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _joins(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word, in scripts that put spaces between words."""
    return (a.isalnum() or a == "_") and (b.isalnum() or b == "_") and max(a, b) < SPACELESS


def stands(item: str, text: str, lo: int, hi: int) -> bool:
    """Whether the item stands in text[lo:hi] as it is, not as a part of longer words."""
    at = text.find(item, lo, hi)
    while at >= 0:
        end = at + len(item)
        if not (at and _joins(text[at - 1], item[0])) and not (end < len(text) and _joins(item[-1], text[end])):
            return True
        at = text.find(item, at + 1, hi)
    return False


class Pattern:
    """Least edit distance of an item to any part of a text (Myers 1999, columns as Python integers)."""

    def __init__(self, item: str):
        self.item, self.m = item, len(item)
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def distance(self, text: str, stop: int = 0) -> int:
        """The least distance over all parts of `text`; ends early at `stop` or less."""
        m, at = self.m, self.at
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best = full, 0, m, m
        for c in text:
            eq = at.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
                    if best <= stop:
                        break
            ph = ph << 1 & full
            mh = mh << 1 & full
            up = mh | (full & ~(xv | ph))
            down = ph & xv
        return best


class Matcher:
    """Finds (item position, distance) in texts, for a block of (normalized) items."""

    def __init__(self, items: list[str], rate: float):
        import ahocorasick

        self.patterns = [Pattern(x) for x in items]
        self.budget = [edits(x, rate) for x in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for offset, piece in cut(item, self.budget[i]):
                found.setdefault(piece, []).append((i, offset + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, owners)
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def find(self, text: str) -> list[tuple[int, int]]:
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, owners in self.automaton.iter(text):
            for i, back in owners:
                starts.setdefault(i, []).append(end - back)
        out = []
        for i, places in starts.items():
            p, k = self.patterns[i], self.budget[i]
            best, places = k + 1, sorted(set(places))
            a = 0
            while a < len(places) and best:
                b = a  # places within the budget of each other are one region
                while b + 1 < len(places) and places[b + 1] - places[b] <= k:
                    b += 1
                lo, hi = max(0, places[a] - k), places[b] + p.m + k
                if not k:
                    best = 0 if stands(p.item, text, lo, hi) else best
                else:
                    best = min(best, 0 if text.find(p.item, lo, hi) >= 0 else p.distance(text[lo:hi]))
                a = b + 1
            if best <= k:
                out.append((i, best))
        return sorted(out)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).distinct().sort(item_col, text_col).toLocalIterator():
        item = normalize(r[1])
        if item:
            if block and size + len(item) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((r[0], item))
            size += len(item)
    if block:
        yield block


_HITS = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32())]))
_HITS_SQL = "array<struct<item:long,distance:int>>"


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, column: str = "hits") -> DataFrame:
    """docs with one more column, the benchmark items that stand in the row's text: array of (item,
    distance), by item.

    An item stands in a text if some part of the text is within int(rate * characters) edits of it,
    both lower-cased with single spaces. An item without a budget (see `edits`) must stand as it is and
    not as a part of longer words: "the" stands in "the end", not in "then". Null and empty texts hold
    nothing; null and empty items stand nowhere. A null item id stays null. Repeated items count
    once, repeated rows each get their hits, an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    out = spread(docs).withColumn(column, F.array().cast(_HITS_SQL))
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = sc.broadcast(block)  # BLOCK_CHARS characters, or one item

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = [x for x, _ in sent.value]
            matcher = Matcher([x for _, x in sent.value], rate)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                at = batch.schema.get_field_index(column)
                hits = []
                for old, text in zip(batch.column(at), texts, strict=True):
                    new = [{"item": names[i], "distance": d} for i, d in matcher.find(normalize(text.as_py()))]
                    hits.append(old.as_py() + new)
                yield pa.RecordBatch.from_arrays([pa.array(hits, _HITS) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row for each document: id_col, contaminated, n_items, item_ids (comma-joined, ascending),
    least_distance (null if none). See `find_items`."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    hits = find_items(rows, benchmark, text_col, rate=rate)
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    return hits.select(id_col, (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs, all columns, in whose text no benchmark item stands; see `find_items`."""
    column = next(c for c in (f"_hits{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    return find_items(docs, benchmark, text_col, rate=rate, column=column).where(F.size(column) == 0).drop(column)
