"""Phrase collocations by Suffix-sigma.

Every word position starts a suffix of at most `max_n` words within its piece. Suffixes are shuffled by
language and first word, sorted in reverse order, and one stack of open prefixes counts all phrases
(Berberich and Bedathur 2013). The parts of each phrase are joined to it afterwards.

Suffixes travel in blocks: each chunk of text is counted, sorted and compressed before the shuffle, which
makes it several times smaller than rows would. A first word that holds more suffixes than a
partition should is dealt by two words, a hot pair by three, and so on; the counts of such hot prefixes
come in parts, one a partition, and are summed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import _LOWER, Words, materialize, mix, pieces, release, text_buffer

#: Text bytes counted at once in a worker, and of a partition of suffixes.
CHUNK, PARTITION_BYTES = 3_000_000, 12_000_000
#: Partitions at most, sampled suffixes a partition, and those of a prefix that make it hot. The sample balances
#: load alone: counts don't depend on it.
MAX_PARTITIONS, SAMPLE, HOT = 20_000, 256, 64
#: Salts of the first of two rounds in which a language's best phrases are drawn.
SALTS = 64
_CUT, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK[[9, 32]] = True
_U = np.uint64


class PieceWords(Words):
    """The words of texts, A-Z lower-cased; `piece` numbers the pieces they stand in, which end at
    punctuation, line ends and the ends of texts."""

    def __init__(self, column: pa.Array):
        buf, offsets = text_buffer(column)
        self.buf, self.offsets = _LOWER[buf], offsets
        ink = ~(_CUT | _BLANK)[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        prev = np.append([False], ink[:-1]) & ~edge[:-1] if len(buf) else ink
        self.start = np.flatnonzero(ink & ~prev)
        after = np.append(ink[1:], [False]) & ~edge[1:] if len(buf) else ink
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.piece = np.cumsum(_CUT[self.buf])[self.start] + self.text


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.StringArray:
    """The slices of a buffer as strings."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    data = buf[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])] if len(size) else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _prefix_hashes(lang: np.ndarray, words: np.ndarray, at: np.ndarray, size: np.ndarray, max_n: int) -> list[np.ndarray]:
    """Hash of language and first k words of each suffix, for k = 1 .. max_n (0 where it is shorter)."""
    out, h = [], lang
    for k in range(max_n):
        have = size > k
        h = np.where(have, mix(h * _U(3) + words[np.minimum(at + k, len(words) - 1)]), _U(0)) if len(at) else np.zeros(0, _U)
        out.append(h)
    return out


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each language's bytes."""
    buf, offsets = text_buffer(langs)
    w = Words.__new__(Words)
    w.buf, w.start, w.end = buf, offsets[:-1], offsets[1:]
    size = offsets[1:] - offsets[:-1]
    out = np.full(len(langs), 7, _U)
    some = size > 0
    w.start, w.end = w.start[some], w.end[some]
    out[some] = w.hashes(1)
    return out


class Suffixes:
    """The suffixes of a batch (lang, text): `at` and `size` in words, and the hashes of their prefixes."""

    def __init__(self, batch: pa.RecordBatch, max_n: int):
        self.w = w = PieceWords(batch.column(1))
        n = len(w.start)
        self.at = np.arange(n)
        ends = np.searchsorted(w.piece, w.piece, "right") if n else np.zeros(0, np.int64)
        self.size = np.minimum(ends - self.at, max_n)
        codes = batch.column(0).dictionary_encode()
        self.langs, self.lang = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)[w.text]
        self.prefix = _prefix_hashes(_lang_hashes(self.langs)[self.lang], w.hashes(), self.at, self.size, max_n)

    def dealt_by(self, hot: np.ndarray) -> np.ndarray:
        """A hash of the shortest prefix that isn't hot, of the whole suffix if all are."""
        out, open_ = np.zeros(len(self.at), _U), np.ones(len(self.at), bool)
        for k, h in enumerate(self.prefix):
            open_ = open_ & (self.size > k)
            out[open_] = h[open_]
            open_ = open_ & (hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h) if len(hot) else np.zeros(len(h), bool)
        return out

    def counted(self, bucket: np.ndarray, max_n: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(bucket, rows (suffix, c)): each different suffix once, sorted, as `language TAB word TAB .. word TAB`."""
        w = self.w
        if not len(self.at):
            return
        words = _gather(w.buf, w.start, w.end - w.start).dictionary_encode()
        rank = np.empty(len(words.dictionary), np.int64)
        rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(1, len(rank) + 1)
        code = np.append(rank[words.indices.to_numpy()], np.zeros(max_n, np.int64))
        keys = [np.where(self.size > k, code[self.at + k], 0) for k in range(max_n)]
        if max_n == 4 and len(rank) < 1 << 31:  # two words fill one key
            keys = [keys[0] << 32 | keys[1], keys[2] << 32 | keys[3]]
        place = bucket * len(self.langs) + self.lang
        order = np.lexsort((*keys[::-1], place))
        same = np.ones(len(order), bool)
        for key in (place, *keys):
            same[1:] &= key[order[1:]] == key[order[:-1]]
        same[0] = False
        heads = np.flatnonzero(~same)
        counts = np.diff(np.append(heads, len(order)))
        pick = order[heads]
        # the words of a chunk in a row, each with a tab behind: a suffix is a slice of them
        size = w.end - w.start + 1
        laid = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=laid[1:])
        flat = np.append(w.buf, np.uint8(9))[np.repeat(w.start - laid[:-1], size) + np.arange(laid[-1])]
        flat[laid[1:] - 1] = 9
        rows = _gather(flat, laid[self.at[pick]], laid[self.at[pick] + self.size[pick]] - laid[self.at[pick]])
        rows = pc.binary_join_element_wise(self.langs.take(pa.array(self.lang[pick])), rows, "\t")
        table = pa.RecordBatch.from_arrays([rows, pa.array(counts)], ["suffix", "c"])
        cuts = np.append(np.flatnonzero(np.append([True], bucket[pick][1:] != bucket[pick][:-1])), len(pick))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[pick[a]]), table.slice(a, b - a)


def _pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


class Stack:
    """Counts the prefixes of suffixes that come sorted, batch by batch: at each level the prefix that is open, whose
    count grows until a suffix comes that does not have it. Of closed prefixes those of `least` occurrences are told,
    those of no word, and the `hot` ones (sorted hashes), which may have further occurrences elsewhere."""

    def __init__(self, levels: int, least: int = 1, hot: np.ndarray | None = None):
        self.levels, self.least, self.hot = levels, least, np.zeros(0, _U) if hot is None else hot
        self.words: list[str] = []
        self.counts = [0] * levels

    def _hot(self, prefixes: pa.Array) -> np.ndarray:
        return np.isin(_hashes_of(prefixes), self.hot) if len(prefixes) else np.zeros(0, bool)

    def _closed(self, k: int) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        """The open prefix of level k, closed."""
        prefix = pa.array(["".join(f"{w}\t" for w in self.words[: k + 1])])
        if k == 0 or self.counts[k] >= self.least or self._hot(prefix)[0]:
            yield prefix, k, np.array([self.counts[k]])

    def push(self, suffixes: pa.Array, counts: np.ndarray) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        """(prefixes, level, counts) that these suffixes close."""
        n = len(suffixes)
        split = pc.split_pattern(suffixes, "\t")
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat, size = split.flatten(), np.diff(offsets) - 1  # a tab stands at the end
        offsets -= offsets[0]
        same = np.ones(n, bool)  # whether a row has all words so far in common with the one before
        warm = np.ones(n, bool)  # whether all its prefixes so far are hot
        rows = np.arange(n)
        first = [w.as_py() for w in flat[: int(size[0])]]
        last = [w.as_py() for w in flat[int(offsets[n - 1]) : int(offsets[n - 1] + size[n - 1])]]
        for k in range(self.levels):
            have = size > k
            word = flat.take(pa.array(np.where(have, offsets[:-1] + k, 0)))
            equal = np.zeros(n, bool)
            equal[1:] = pc.equal(word.slice(1), word.slice(0, n - 1)).to_numpy(zero_copy_only=False) & have[1:] & have[:-1]
            same &= equal
            same[0] = goes_on = have[0] and len(self.words) > k and self.words[: k + 1] == first[: k + 1]
            if not goes_on and len(self.words) > k:
                yield from self._closed(k)
            at = rows[have]
            if not len(at):
                continue
            heads = np.flatnonzero(~same[at] | (np.arange(len(at)) == 0))
            sums = np.add.reduceat(counts[at], heads)
            if goes_on:
                sums[0] += self.counts[k]
            lead = at[heads]
            told = (sums >= self.least) | (k == 0)
            look = np.flatnonzero(warm[lead]) if k and len(self.hot) else np.zeros(0, np.int64)
            prefix = lambda which, k=k: pc.binary_join_element_wise(*(flat.take(pa.array(offsets[which] + j)) for j in range(k + 1)), pa.array([""] * len(which), pa.string()), "\t")
            if k and len(self.hot):  # only below hot prefixes may others be hot
                hot = np.zeros(len(lead), bool)
                hot[look] = self._hot(prefix(lead[look])) if len(look) else False
                told |= hot
                warm[:] = False
                warm[at] = np.repeat(hot, np.diff(np.append(heads, len(at))))
            if have[n - 1]:  # the last one stays open
                self.counts[k] = int(sums[-1])
                told[-1] = False
            if told.any():
                yield prefix(lead[told]), k, sums[told]
        self.words = last

    def close(self) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        for k in range(len(self.words)):
            yield from self._closed(k)
        self.words = []


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 4, least: int = 30, partitions: int | None = None) -> DataFrame:
    """A written table (phrase, n_words, f): all phrases of up to max_n words that occur `least` times or more within pieces
    of a language's texts, as `language TAB word TAB .. word TAB`; a row of no words holds all word occurrences.
    Backslashes, tabs and line ends in the language are escaped."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    for char, escape in ESCAPES:
        lang = F.replace(lang, F.lit(char), F.lit(escape))
    rows = docs.where(F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    n_rows, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = partitions or int(min(MAX_PARTITIONS, max(docs.sparkSession.sparkContext.defaultParallelism, (size or 0) // PARTITION_BYTES)))
    hot = _hot_prefixes(rows, max_n, n, size or 0)
    buckets = 16 * n

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                s = Suffixes(batch, max_n)
                for bucket, part in s.counted((s.dealt_by(hot) % _U(buckets)).astype(np.int64), max_n):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_pack(part)], pa.binary())], ["bucket", "block"])
            release()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from pa.ipc.open_stream(block.as_buffer())
        release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n + 1, least, hot)

        def told(prefixes: pa.Array, level: int, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([prefixes, pa.array(np.full(len(counts), level, np.int32)), pa.array(counts.astype(np.int64))], ["phrase", "n_words", "f"])

        for batch in batches:
            if batch.num_rows:
                for closed in stack.push(batch.column(0), batch.column(1).to_numpy()):
                    yield told(*closed)
        for closed in stack.close():
            yield told(*closed)
        release()

    dealt = spread(rows).mapInArrow(blocks, "bucket int, block binary").repartition(n, "bucket").select("block")
    ordered = dealt.mapInArrow(unpack, "suffix string, c long").sortWithinPartitions(F.desc("suffix"))
    parts = ordered.mapInArrow(count, "phrase string, n_words int, f long")
    whole = parts.groupBy("phrase", "n_words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n_words") == 0))
    return materialize(whole, "phrases")


def _hashes_of(prefixes: pa.Array) -> np.ndarray:
    """The prefix hashes of strings `language TAB word TAB ..`, as `Suffixes` has them."""
    split = pc.split_pattern(prefixes, "\t")
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    flat, size = split.flatten(), np.diff(offsets) - 2
    buf, at = text_buffer(flat)
    w = Words.__new__(Words)
    some = np.flatnonzero(at[1:] > at[:-1])
    w.buf, w.start, w.end = buf, at[:-1][some], at[1:][some]
    words = np.zeros(len(flat), _U)
    words[some] = w.hashes()
    h = _lang_hashes(flat.take(pa.array(offsets[:-1])))
    for k in range(int(size.max(initial=0))):
        have = size > k
        h = np.where(have, mix(h * _U(3) + words[np.where(have, offsets[:-1] + 1 + k, 0)]), h)
    return h


def _hot_prefixes(rows: DataFrame, max_n: int, n: int, size: int) -> np.ndarray:
    """Hashes of prefixes that may hold more than a quarter of a partition's suffixes, by a sample of about
    SAMPLE suffixes a partition."""
    wanted = SAMPLE * n
    share = min(1.0, 20.0 * wanted / max(size // 6, 1))  # every twentieth suffix of so many texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                s = Suffixes(batch, max_n)
                step = slice(None, None, 20)
                got = np.concatenate([h[step][s.size[step] > k] for k, h in enumerate(s.prefix)])
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64))], ["h"])
        release()

    sample = spread(rows.sample(share, seed=11)).mapInArrow(run, "h long")
    hot = sample.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= HOT).select("h").collect()  # SAMPLE / HOT * max_n * n at most, about
    return np.sort(np.array([r["h"] for r in hot], np.int64).view(_U))


#: What stands in a language's name, and how it is written in a phrase.
ESCAPES = (("\\", "\\s"), ("\t", "\\t"), ("\n", "\\n"))


def _joined(lang: Column, words: Column) -> Column:
    return F.concat_ws("\t", lang, words, F.lit(""))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 4, least: int = 30, top: int = 2000, covered: int = 80, partitions: int | None = None) -> DataFrame:
    """(lang, rank, phrase, n_words, a, l, r, cut, n, score): each language's `top` phrases of 2 to max_n words.

    Words are runs of anything but blanks within pieces between `.,;:!?` and line ends, A-Z lower-cased; a null language
    is `und`. a: occurrences of the phrase, at least `least`; l and r: those of its parts before and after
    the `cut` that gives the lowest score floor(2,000,000 a / (l + r)), the first of such cuts; n: all word occurrences of
    the language. A phrase goes if a longer one that holds it has `covered` percent of its occurrences or more. Ranked by
    score, a and phrase (UTF-8 order), so that ties have one order. Null and empty texts have no words; repeated rows count
    as often as they stand; an empty table gives no rows; other columns play no part. Texts are counted whole.
    """
    counts = phrase_counts(docs, lang_col, text_col, max_n, least, partitions)
    words = F.split("phrase", "\t")
    size = F.col("n_words")
    rows = counts.where("n_words > 1").select("phrase", "n_words", F.col("f").alias("a"), words.alias("w"))
    # an immediate extension has at least the occurrences of any longer one
    longer = rows.where("n_words > 2").select(F.col("w")[0].alias("lang"), "w", "n_words", F.col("a").alias("b"))
    inner = lambda from_: _joined(F.col("lang"), F.slice("w", from_, F.col("n_words") - 1))
    covers = longer.select(F.explode(F.array(inner(2), inner(3))).alias("phrase"), "b").groupBy("phrase").agg(F.max("b").alias("b"))
    rows = rows.join(covers, "phrase", "left").where(F.col("b").isNull() | (F.lit(100) * F.col("b") < F.lit(covered) * F.col("a"))).drop("b")
    cuts = rows.select("phrase", "n_words", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    lang = F.col("w")[0]
    cuts = cuts.select("phrase", "a", "cut", _joined(lang, F.slice("w", 2, F.col("cut"))).alias("left"), _joined(lang, F.slice("w", F.col("cut") + 2, size - F.col("cut"))).alias("right"))
    parts = counts.where("n_words > 0").select("phrase", "f")
    cuts = cuts.join(parts.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("CAST((CAST(a AS DECIMAL(28, 0)) * 2000000) div (CAST(l AS DECIMAL(28, 0)) + r) AS BIGINT)")
    best = cuts.groupBy("phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    totals = counts.where("n_words = 0").select(F.substring_index("phrase", "\t", 1).alias("lang"), F.col("f").alias("n"))
    best = best.select(F.substring_index("phrase", "\t", 1).alias("lang"), F.expr("replace(substr(phrase, 1 + instr(phrase, '\t'), length(phrase) - instr(phrase, '\t') - 1), '\t', ' ')").alias("phrase"), "a", "m.l", "m.r", "m.cut", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = best.withColumn("_r", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("_r") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = some.join(totals, "lang")
    name = F.col("lang")
    for char, escape in reversed(ESCAPES):
        name = F.replace(name, F.lit(escape), F.lit(char))
    n_words = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).cast("long")
    return out.select(name.alias("lang"), "rank", "phrase", n_words.alias("n_words"), "a", "l", "r", F.col("cut").cast("long").alias("cut"), "n", "score")
