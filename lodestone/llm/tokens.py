"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of tokens popped on
following it (Song et al. 2021, linear-time WordPiece). Walking a word once, and adding the
popped counts, gives the number of greedy longest-match pieces without building any piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import WORD, pieces, words_of

#: Vocabulary entries at most, and different words kept in a worker's memo.
MAX_VOCABULARY, MEMO_WORDS = 1_000_000, 500_000
_SUFFIX = "\x00"


class Automaton:
    """Greedy longest-match piece counts for words over a vocabulary of initial pieces and
    continuation pieces (which stand anywhere but at a word's start). An empty initial piece is the bare word
    start: one piece, after which continuations spell the word."""

    def __init__(self, initial: Iterable[str], continuation: Iterable[str]):
        nodes: list[dict[str, int]] = [{}]
        accepts = [False]

        def add(piece: str) -> int:
            at = 0
            for c in piece:
                nxt = nodes[at].get(c)
                if nxt is None:
                    nxt = nodes[at][c] = len(nodes)
                    nodes.append({})
                    accepts.append(False)
                at = nxt
            return at

        self.rest = add(_SUFFIX)  # where a continuation begins
        bare = False  # whether the word start is a piece by itself
        for p in initial:
            bare |= not p
            if p and _SUFFIX not in p:
                accepts[add(p)] = True
        for p in continuation:
            if p and _SUFFIX not in p:
                accepts[add(_SUFFIX + p)] = True
        fail, popped = [-1] * len(nodes), [0] * len(nodes)
        if bare:
            fail[0], popped[0] = self.rest, 1
        level = [0, self.rest]
        while level:  # breadth first: links go to shorter strings
            below = []
            for u in level:
                for c, v in nodes[u].items():
                    if v == self.rest:
                        continue
                    if accepts[v]:
                        fail[v], popped[v] = self.rest, 1
                    else:
                        z, n = fail[u], popped[u]
                        while z >= 0 and c not in nodes[z]:
                            n += popped[z]
                            z = fail[z]
                        if z >= 0:
                            fail[v], popped[v] = nodes[z][c], n
                    below.append(v)
            level = below
        self.nodes, self.fail, self.popped = nodes, fail, popped

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if the vocabulary can't spell it greedily."""
        nodes, fail, popped = self.nodes, self.fail, self.popped
        at, n = 0, 0
        for c in word:
            if c == _SUFFIX:
                return -1
            nxt = nodes[at].get(c)
            while nxt is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                nxt = nodes[at].get(c)
            at = nxt
        while at != self.rest:
            if at <= 0:
                return -1 if at < 0 else 0
            n += popped[at]
            at = fail[at]
        return n


def sentencepiece_pieces(path: str) -> tuple[list[str], list[str]]:
    """(initial, continuation) pieces of a sentencepiece model file on the driver; control and byte
    pieces are left out; the bare word start is the empty initial piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, rest = [], []
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            (initial if piece.startswith("▁") else rest).append(piece.removeprefix("▁"))
    return initial, rest


def token_counts(docs: DataFrame, vocabulary: tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_words, n_tokens, n_unknown.

    Words are runs of anything but ASCII white space, taken unchanged; n_tokens counts the greedy
    longest-match pieces of each, and a word that the vocabulary can't spell is one unknown token.
    Null and empty texts have no words. Repeated rows stay; an empty table gives no rows; other
    columns are ignored. The broadcast vocabulary has MAX_VOCABULARY pieces at most.
    """
    if sum(map(len, vocabulary)) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has over {MAX_VOCABULARY} pieces")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*sent.value)
        memo: dict[bytes, int] = {}
        for whole in batches:
            for batch in pieces(whole, "text"):
                w = words_of(batch.column(1))
                raw = w.buf.tobytes()
                counts = np.empty(len(w.start), np.int64)
                for i, (a, b) in enumerate(zip(w.start.tolist(), w.end.tolist(), strict=True)):
                    word = raw[a:b]
                    n = memo.get(word)
                    if n is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        n = memo[word] = automaton.count(word.decode())
                    counts[i] = n
                total = np.concatenate(([0], np.cumsum(np.abs(counts))))
                unknown = np.concatenate(([0], np.cumsum(counts < 0)))
                out = [np.diff(w.first), np.diff(total[w.first]), np.diff(unknown[w.first])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in out)], ["id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)


__all__ = ["WORD", "Automaton", "sentencepiece_pieces", "token_counts"]
