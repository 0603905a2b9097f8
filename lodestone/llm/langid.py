"""Languages of words and texts by a linear-chain conditional random field.

Each word of a text is labelled: affixes, character n-grams (hashed) and a lexicon score it against each
language, learned transitions tie neighbours together, and forward-backward gives each word's
probability of each language. A text's language is the one with the most probability over its words, so that
code-switched texts are told by their larger part, and `language_spans` tells the parts.

Weights are learned by stochastic gradients on shards of a bounded sample; after each epoch Spark
averages the shards' weights (iterative parameter mixing). Training chains are spliced from stretches of
texts in different languages, so that transitions see languages change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import Words, drop_table, materialize, mix, pieces, release, text_buffer

#: Labelled texts that a fit uses, about, shared evenly by the languages; labels at most (the most frequent).
TRAIN_DOCS, MAX_LABELS = 12_000, 64
#: Hashed features, lexicon words a language, and how many classes of certainty a lexicon word may have.
BUCKETS, LEXICON, CERTAINTY = 1 << 16, 4096, (0.98, 0.9, 0.6, 0.0)
#: Shards and epochs of the fit, words of a training chain, stretches taken of a text.
SHARDS, EPOCHS, CHAIN, STRETCHES = 8, 4, 24, 6
RATE, DECAY = 0.3, 1e-6
#: Words of a block of forward-backward.
BLOCK = 64
#: Text bytes times labels handled at once in a worker.
WORK = 4_000_000
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class LetterWords(Words):
    """Runs of letters (of a to z and all characters beyond ASCII) in lower-cased texts."""

    def __init__(self, column: pa.Array):
        self.buf, self.offsets = text_buffer(column)
        ink = _LETTER[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.offsets] = True
        n = len(self.buf)
        self.start = np.flatnonzero(ink & ~(np.append([False], ink[:-1]) & ~edge[:-1])) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(ink & ~(np.append(ink[1:], [False]) & ~edge[1:])) + 1 if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)

    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """(one position of each different word, the number of each word's)."""
        _, at, of = np.unique(self.hashes(), return_index=True, return_inverse=True)
        return at, of


def features(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket, value) of the words at some positions, in order of the word: prefixes and suffixes of
    one to four bytes, and n-grams of two to four between word marks, which share a value of one."""
    size = w.end[at] - w.start[at] + 2
    laid = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=laid[1:])
    flat = np.zeros(laid[-1], np.uint8)
    inner = np.ones(laid[-1], bool)
    inner[laid[:-1]] = inner[laid[1:] - 1] = False
    flat[laid[:-1]], flat[laid[1:] - 1] = 1, 2
    flat[inner] = w.buf[np.repeat(w.start[at] - laid[:-1] - 1, size)[inner] + np.flatnonzero(inner)]
    letters, owner = flat.astype(_U) + _U(1), np.repeat(np.arange(len(at)), size)
    place = np.arange(laid[-1]) - laid[owner]
    found = []
    gram = letters
    for n in (1, 2, 3, 4, 5):
        if n > 1:
            gram = gram[: max(0, laid[-1] - n + 1)] * _U(257) + letters[n - 1 :]
        inside = place[: len(gram)] + n <= size[owner[: len(gram)]]
        own, hashed = owner[: len(gram)], mix(gram + _U(n << 40))
        begins, ends = place[: len(gram)] == 0, place[: len(gram)] + n == size[owner[: len(gram)]]
        for kind, which in ((1, inside & begins & (n > 1)), (2, inside & ends & (n > 1))):
            found.append((own[which], mix(hashed[which] + _U(kind)), np.ones(int(which.sum()))))
        if 2 <= n <= 4:
            count = np.maximum(size - n + 1, 1)[own[inside]]
            found.append((own[inside], hashed[inside], 1.0 / np.sqrt(count)))
    own, hashed, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(own, kind="stable")
    return own[order], (hashed[order] & _U(BUCKETS - 1)).astype(np.int64), value[order]


@dataclass
class Model:
    labels: list[str]
    #: Hash of a lexicon word -> its class, `language * len(CERTAINTY) + certainty`.
    lexicon: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, _U), np.zeros(0, np.int64)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def width(self) -> int:
        """Rows of the weights: hashed features, classes of the lexicon, no lexicon word."""
        return BUCKETS + len(self.labels) * len(CERTAINTY) + 1

    def word_features(self, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, bucket, value = features(w, at)
        keys, classes = self.lexicon
        h = w.hashes()[at]
        kind = np.full(len(at), self.width - 1)
        if len(keys):
            spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            kind = np.where(keys[spot] == h, BUCKETS + classes[spot], kind)
        own, bucket, value = np.append(own, np.arange(len(at))), np.append(bucket, kind), np.append(value, np.ones(len(at)))
        order = np.argsort(own, kind="stable")
        return own[order], bucket[order], value[order]

    def emissions(self, w: Words, at: np.ndarray) -> np.ndarray:
        """Scores (words, labels)."""
        own, bucket, value = self.word_features(w, at)
        if not len(at):
            return np.zeros((0, len(self.labels)))
        heads = np.searchsorted(own, np.arange(len(at)))
        return np.add.reduceat(self.weights[bucket] * value[:, None], heads, axis=0)

    def marginals(self, w: LetterWords) -> np.ndarray:
        """Probability of each label for each word of each text."""
        at, of = w.different()
        return forward_backward(self.emissions(w, at)[of], w.first, self.transitions)


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The label probabilities of the words of chains: scores (words, labels), chain i has the words
    first[i] to first[i + 1].

    Chains are cut into blocks that all advance together: first each block's product of step matrices, then
    the vectors that enter it from both sides, block after block, then its words. So a long text takes
    about `block` plus its number of blocks steps, not its number of words.
    """
    n, k = scores.shape
    if not n:
        return scores
    a = np.exp(transitions - transitions.max())
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    size = np.diff(first)
    blocks = -(-size // block)
    head = np.zeros(len(size) + 1, np.int64)
    np.cumsum(blocks, out=head[1:])
    chain = np.repeat(np.arange(len(size)), blocks)
    at = first[:-1][chain] + (np.arange(head[-1]) - head[chain]) * block
    length = np.minimum(first[1:][chain] - at, block)
    starts = np.arange(head[-1]) == head[chain]  # blocks that begin a chain

    def steps(reverse: bool = False):
        """(place in the block, blocks that have a word there, those words, those of them that follow another word)."""
        for t in range(block)[:: -1 if reverse else 1]:
            live = np.flatnonzero(length > t)
            if len(live):
                yield t, live, at[live] + t, ~starts[live] if t == 0 else np.ones(len(live), bool)

    whole = np.repeat(np.eye(k)[None], head[-1], axis=0)
    for _, live, word, follows in steps():
        m = whole[live]
        m[follows] = m[follows] @ a
        m *= p[word][:, None, :]
        whole[live] = m / m.max(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((head[-1], k)), np.ones((head[-1], k))
    for j in range(1, int(blocks.max())):
        b = head[:-1][blocks > j] + j
        v = np.einsum("bi,bij->bj", enter[b - 1], whole[b - 1])
        enter[b] = v / v.max(axis=1, keepdims=True)
        b = head[1:][blocks > j] - 1 - j
        v = np.einsum("bij,bj->bi", whole[b + 1], leave[b + 1])
        leave[b] = v / v.max(axis=1, keepdims=True)
    alpha = np.empty((n, k))
    for _, live, word, follows in steps():
        v = enter[live]
        v[follows] = v[follows] @ a
        v *= p[word]
        alpha[word] = enter[live] = v / v.max(axis=1, keepdims=True)
    for _, live, word, follows in steps(reverse=True):
        v = leave[live]
        alpha[word] *= v
        v = v * p[word]
        v[follows] = v[follows] @ a.T
        leave[live] = v / v.max(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


def gradient(scores: np.ndarray, gold: np.ndarray, transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels `gold` (chains, words) of equally long chains with `scores` (chains, words,
    labels), and its derivatives by scores and transitions."""
    b, t, k = scores.shape
    shift, top = scores.max(axis=2, keepdims=True), transitions.max()
    p, a = np.exp(scores - shift), np.exp(transitions - top)
    alpha, beta, norm = np.empty((t, b, k)), np.ones((t, b, k)), np.empty((t, b, 1))
    for i in range(t):
        v = p[:, i] if i == 0 else (alpha[i - 1] @ a) * p[:, i]
        norm[i] = v.sum(axis=1, keepdims=True)
        alpha[i] = v / norm[i]
    pairs = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        v = p[:, i] * beta[i] / norm[i]
        pairs += a * (alpha[i - 1].T @ v)
        beta[i - 1] = v @ a.T
    chains, words = np.arange(b)[:, None], np.arange(t)[None, :]
    by_score = -(alpha * beta).transpose(1, 0, 2)
    by_score[chains, words, gold] += 1
    by_pair = -pairs
    np.add.at(by_pair, (gold[:, :-1], gold[:, 1:]), 1)
    value = scores[chains, words, gold].sum() + transitions[gold[:, :-1], gold[:, 1:]].sum() - np.log(norm).sum() - shift.sum() - top * b * (t - 1)
    return float(value), by_score, by_pair


def spliced(w: LetterWords, label: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(words, labels) of training chains: stretches of texts, in random order, one after the other."""
    size = np.diff(w.first)
    some = np.flatnonzero(size)
    if not len(some):
        return np.zeros((0, CHAIN), np.int64), np.zeros((0, CHAIN), np.int64)
    of = rng.permutation(np.repeat(some, STRETCHES))
    length = np.minimum(rng.integers(3, 2 * CHAIN, len(of)), size[of])
    start = w.first[of] + (rng.random(len(of)) * (size[of] - length + 1)).astype(np.int64)
    laid = np.zeros(len(of) + 1, np.int64)
    np.cumsum(length, out=laid[1:])
    words = np.repeat(start - laid[:-1], length) + np.arange(laid[-1])
    marks = np.repeat(label[of], length)
    full = -(-len(words) // CHAIN) * CHAIN
    return np.resize(words, full).reshape(-1, CHAIN), np.resize(marks, full).reshape(-1, CHAIN)


def train_shard(model: Model, texts: pa.Array, label: np.ndarray, seed: int, batch: int = 256) -> Model:
    """The model after one pass of adaptive gradient steps over a shard's chains."""
    rng = np.random.default_rng(seed)
    w = LetterWords(texts)
    chains, gold = spliced(w, label, rng)
    at, of = w.different()
    own, bucket, value = model.word_features(w, at)
    heads = np.searchsorted(own, np.arange(len(at) + 1))
    weights, transitions = model.weights.copy(), model.transitions.copy()
    seen, seen_t = np.full(weights.shape, 1.0), np.full(transitions.shape, 1.0)
    for i in range(0, len(chains), batch):
        which, words = np.unique(of[chains[i : i + batch]], return_inverse=True)
        words = words.reshape(-1, CHAIN)
        part = np.repeat(heads[which], heads[which + 1] - heads[which])
        starts = np.cumsum(heads[which + 1] - heads[which]) - (heads[which + 1] - heads[which])
        rows = part + np.arange(len(part)) - np.repeat(starts, heads[which + 1] - heads[which])
        b, v = bucket[rows], value[rows]
        scores = np.add.reduceat(weights[b] * v[:, None], starts, axis=0)
        _, by_score, by_pair = gradient(scores[words], gold[i : i + batch], transitions)
        by_word = np.stack([np.bincount(words.ravel(), by_score[:, :, c].ravel(), len(which)) for c in range(scores.shape[1])], axis=1)
        slope = np.repeat(by_word, heads[which + 1] - heads[which], axis=0) * v[:, None]
        used, where = np.unique(b, return_inverse=True)
        g = np.stack([np.bincount(where, slope[:, c], len(used)) for c in range(scores.shape[1])], axis=1) / words.size * 64 - DECAY * weights[used]
        seen[used] += g * g
        weights[used] += RATE * g / np.sqrt(seen[used])
        g = by_pair / words.size * 64
        seen_t += g * g
        transitions += RATE * g / np.sqrt(seen_t)
    return Model(model.labels, model.lexicon, weights, transitions)


def held_out(id_column: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int, seed: int) -> tuple[DataFrame, list[str]]:
    """A written table (lang, shard, text, h) of the texts that a fit uses, lower-cased and each once, and the labels. A
    share of each language is drawn by a hash of the text, so that each has about as many."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LABELS).collect()
    labels = sorted(r["lang"] for r in counts)
    share = {r["lang"]: int(min(1.0, train_docs / max(1, len(labels)) / r["count"]) * 1_000_000) for r in counts}
    lang = F.col(lang_col).cast("string")
    limit = F.lit(0)
    for name, part in share.items():  # MAX_LABELS at most
        limit = F.when(lang == name, part).otherwise(limit)
    h = F.xxhash64(F.lit(seed), F.col(text_col).cast("string"))
    drawn = rows.select(lang.alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text"), h.alias("h"), limit.alias("_limit")).where(F.pmod("h", F.lit(1_000_000)) < F.col("_limit"))
    once = drawn.groupBy("h", "lang").agg(F.min("text").alias("text"))
    return materialize(once.select("lang", F.pmod("h", F.lit(SHARDS)).cast("int").alias("shard"), "text", "h"), "labelled"), labels


def lexicon(rows: DataFrame, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The LEXICON most used words of each language (by share of its words), with the language that uses each most, and
    how surely: (hashes, classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                w = LetterWords(batch.column(1))
                lang = batch.column(0).dictionary_encode()
                codes = lang.indices.to_numpy(zero_copy_only=False)
                pair, n = np.unique(np.stack([np.repeat(codes, np.diff(w.first)).astype(_U), w.hashes()]), axis=1, return_counts=True) if len(w.start) else (np.zeros((2, 0), _U), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(pair[0].astype(np.int32))), pa.array(pair[1].view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    words = rows.select("lang", "text").mapInArrow(run, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    shared = words.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    ranked = shared.where("n >= 3").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= LEXICON).select("word").distinct()
    use = shared.join(ranked, "word", "left_semi").groupBy("word").agg(F.max_by("lang", F.struct("p", "lang")).alias("lang"), (F.max("p") / F.sum("p")).alias("sure"))
    got = sorted((int(np.int64(r["word"]).view(_U)), labels.index(r["lang"]) * len(CERTAINTY) + next(i for i, c in enumerate(CERTAINTY) if r["sure"] >= c)) for r in use.collect())  # LEXICON a label at most
    return np.array([h for h, _ in got], _U), np.array([c for _, c in got], np.int64)


def _epoch(sent: Broadcast, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The weights that each shard makes of the model that was sent."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "lang"])
        now: Model = sent.value
        label = part["lang"].map({x: i for i, x in enumerate(now.labels)}).to_numpy(np.int64)
        new = train_shard(now, pa.array(part["text"], pa.string()), label, seed + int(part["shard"].iloc[0]))
        release()
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "w": [new.weights.astype(np.float32).tobytes()], "t": [new.transitions.tobytes()]})

    return run


def fit(rows: DataFrame, labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Learn from (lang, shard, text, h). Reruns agree: shards are sorted and draw from seeds of their own."""
    model = Model(labels)
    if not labels:
        return model
    model.lexicon = lexicon(rows, labels)
    model.weights, model.transitions = np.zeros((model.width, len(labels))), np.zeros((len(labels), len(labels)))
    for epoch in range(epochs):
        sent = rows.sparkSession.sparkContext.broadcast(model)
        parts = rows.groupBy("shard").applyInPandas(_epoch(sent, seed + 1000 * epoch), "shard int, w binary, t binary")
        got = sorted(parts.collect(), key=lambda r: r["shard"])  # SHARDS at most
        if not got:
            return model
        model = Model(labels, model.lexicon, np.mean([np.frombuffer(r["w"], np.float32).reshape(model.weights.shape) for r in got], axis=0, dtype=np.float64), np.mean([np.frombuffer(r["t"]).reshape(model.transitions.shape) for r in got], axis=0))
        sent.unpersist()
    model.weights = model.weights.astype(np.float32)
    return model


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, seed: int = 7) -> Model:
    rows, labels = labelled_texts(docs, id_col, text_col, lang_col, train_docs, seed)
    model = fit(rows, labels, seed=seed)
    drop_table(rows)
    return model


def _lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    letters = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    return spread(docs.select(F.col(id_col).alias("id"), F.when(letters, F.lower(text)).otherwise("").alias("text")))


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each document: the label with the most probability over all words, and its
    mean probability; `und` and 0 for a null text or one without letters (by Unicode), or if nothing was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        names = pa.array([*model.labels, "und"])
        for whole in batches:
            for batch in pieces(whole, "text", max(20_000, WORK // max(4, len(model.labels)))):
                w = LetterWords(batch.column(1))
                size = np.diff(w.first)
                pick, score = np.full(len(size), len(model.labels)), np.zeros(len(size))
                some = np.flatnonzero(size)
                if len(some) and model.labels:
                    mean = np.add.reduceat(model.marginals(w), w.first[:-1][some], axis=0) / size[some][:, None]
                    pick[some], score[some] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(pick)), pa.array(score)], ["id", "lang_pred", "score"])
        release()

    return _lowered(docs, id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, span, first_word, n_words, lang, score): the stretches of a text whose words have one likeliest language, in
    order from 0; words are runs of letters, counted from 0. Texts without letters have no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for whole in batches:
            for batch in pieces(whole, "text", max(20_000, WORK // max(4, len(model.labels)))):
                w = LetterWords(batch.column(1))
                if not len(w.start) or not model.labels:
                    continue
                p = model.marginals(w)
                label, text = p.argmax(axis=1), np.repeat(np.arange(len(w)), np.diff(w.first))
                heads = np.flatnonzero(np.append([True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])))
                size = np.diff(np.append(heads, len(label)))
                opens = np.searchsorted(text[heads], text[heads])
                score = np.add.reduceat(p.max(axis=1), heads) / size
                columns = [batch.column(0).take(pa.array(text[heads])), pa.array(np.arange(len(heads)) - opens), pa.array(heads - w.first[:-1][text[heads]]), pa.array(size), pa.array(model.labels).take(pa.array(label[heads])), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "span", "first_word", "n_words", "lang", "score"])
        release()

    schema = f"id {dict(docs.dtypes)[id_col]}, span long, first_word long, n_words long, lang string, score double"
    return _lowered(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row for each document: id_col, held_out, lang_pred (a learned language, or `und`), score (0 to 1).

    Learned from about `train_docs` texts of known language that aren't held out, at most MAX_LABELS languages; a prediction
    depends on the text alone. Null texts, and texts without a letter, are `und` with score 0; so is everything where
    nothing can be learned. Repeated rows stay and come out alike; texts of any length are read whole; other columns play no
    part; an empty table gives no rows.
    """
    model = trained(docs, id_col, text_col, lang_col, train_docs)
    return languages(docs, model, id_col, text_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
