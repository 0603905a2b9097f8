"""The phrase, language and fill-in-middle operators against brute force, and their edge cases."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fim, langid, phrases, queries

from .test_ops import empty_docs, odd_docs


# ---------------------------------------------------------------- 11


def phrase_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def brute_phrases(rows, least, top, max_n=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in phrase_words(text):
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), b in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * b >= 80 * f[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    best = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, k, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            best[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, rows in best.items() for i, x in enumerate(sorted(rows)[:top]))


def got_phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("partitions", [1, 5])
def test_collocations_equal_counting_all_phrases(spark, monkeypatch, partitions):
    monkeypatch.setattr(phrases, "CHUNK", 2000)  # a phrase's suffixes come from many blocks
    monkeypatch.setattr(phrases, "HOT", 8)
    rng = random.Random(partitions)
    vocabulary = ["The", "cat", "sat", "É", "x\x01", "x", "on", "a-b", "日本"]
    rows = [(rng.choice(["en", "fr", None, "und", "a\tb", "", "\\s"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ". "]) for _ in range(rng.randint(0, 120)))) for _ in range(300)]
    rows += [("en", "hot words stand here"), ("fr", None), ("en", ""), (None, " .,\n")] * 40
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got_phrases(phrases.collocations(df, least=5, top=40, partitions=partitions)) == brute_phrases(rows, 5, 40)


def test_stack_counts_prefixes_across_batches():
    rng = random.Random(4)
    rows = sorted({"".join(rng.choice("ab") + "\t" for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(40)}.items(), reverse=True)
    want = Counter()
    for s, c in rows:
        w = s.split("\t")[:-1]
        want.update({"".join(x + "\t" for x in w[:k]): c for k in range(1, len(w) + 1)})
    for size in (1, 2, 7, 40):
        stack, got = phrases.Stack(4), Counter()
        batches = [rows[i : i + size] for i in range(0, len(rows), size)]
        closed = [x for b in batches for x in stack.push(pa.array([s for s, _ in b]), np.array([c for _, c in b]))] + list(stack.close())
        for p, _, c in closed:
            assert not set(p.to_pylist()) & set(got)  # each prefix is closed once
            got.update(dict(zip(p.to_pylist(), c.tolist(), strict=True)))
        assert got == want


def test_scores_stay_exact_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000_000
    rows = [("en\tx\ty\t", 2, big - 1), ("en\tx\t", 1, big), ("en\ty\t", 1, big + 1), ("en\t", 0, 4 * big)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: spark.createDataFrame(rows, "phrase string, n_words int, f long"))
    (r,) = phrases.collocations(empty_docs(spark)).collect()
    assert (r.score, r.a, r.n) == (2_000_000 * (big - 1) // (2 * big + 1), big - 1, 4 * big)


def test_collocations_edges(spark):
    df = odd_docs(spark)
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    assert got_phrases(phrases.collocations(df, least=2, top=3000)) == brute_phrases(rows, 2, 3000)
    assert phrases.collocations(empty_docs(spark)).count() == 0


# ---------------------------------------------------------------- 12


def path_weights(scores, transitions):
    """Every labelling of a chain with its weight."""
    n, k = scores.shape
    paths = list(itertools.product(range(k), repeat=n))
    return paths, np.array([np.exp(sum(scores[i, y] for i, y in enumerate(p)) + sum(transitions[a, b] for a, b in itertools.pairwise(p))) for p in paths])


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_forward_backward_equals_all_paths(block):
    rng = np.random.default_rng(block)
    sizes = [0, 1, 5, 0, 2, 7, 3, 0]
    first = np.cumsum([0, *sizes])
    scores, transitions = rng.normal(size=(first[-1], 3)) * 3, rng.normal(size=(3, 3)) * 2
    got = langid.forward_backward(scores, first, transitions, block)
    for i, n in enumerate(sizes):
        if n:
            part = scores[first[i] : first[i + 1]]
            paths, weight = path_weights(part, transitions)
            want = np.array([[sum(w for p, w in zip(paths, weight, strict=True) if p[t] == y) for y in range(3)] for t in range(n)]) / weight.sum()
            assert np.allclose(got[first[i] : first[i + 1]], want, atol=1e-9)


def test_forward_backward_of_a_long_chain_stays_finite():
    rng = np.random.default_rng(2)
    scores, transitions, first = rng.normal(size=(20_000, 4)) * 60, rng.normal(size=(4, 4)) * 5, np.array([0, 20_000])
    got = langid.forward_backward(scores, first, transitions)
    assert np.isfinite(got).all() and np.allclose(got.sum(axis=1), 1)
    assert np.allclose(got, langid.forward_backward(scores, first, transitions, 20_000))  # in one block


def test_gradient_equals_differences_of_the_log_likelihood():
    rng = np.random.default_rng(3)
    scores, transitions, gold = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (3, 5))
    value, by_score, by_pair = langid.gradient(scores, gold, transitions)
    exact = 0.0
    for s, g in zip(scores, gold, strict=True):
        paths, weight = path_weights(s, transitions)
        exact += np.log(weight[paths.index(tuple(g))] / weight.sum())
    assert np.isclose(value, exact)
    step = 1e-6
    for grad, array in ((by_score, scores), (by_pair, transitions)):
        for at in np.ndindex(array.shape):
            array[at] += step
            up = langid.gradient(scores, gold, transitions)[0]
            array[at] -= 2 * step
            down = langid.gradient(scores, gold, transitions)[0]
            array[at] += step
            assert np.isclose((up - down) / (2 * step), grad[at], atol=1e-5)


def test_features_are_affixes_and_ngrams_of_each_word():
    w = langid.LetterWords(pa.array(["ab, b xyzzyab", None, "", "é!ab"]))
    assert np.diff(w.first).tolist() == [3, 0, 0, 2]
    at, of = w.different()
    assert len(at) == 4 and of[0] == of[4]
    own, bucket, value = langid.features(w, np.arange(5))
    sets = [set(zip(bucket[own == i].tolist(), value[own == i].tolist(), strict=True)) for i in range(5)]
    assert sets[0] == sets[4] and sets[0] != sets[1]
    for i, n in enumerate((2, 1, 7, 2, 2)):
        # affixes of 2 to 5 bytes with the mark, on both sides; n-grams of 2, 3 and 4
        assert int((value[own == i] == 1.0).sum()) >= 2 * min(4, n + 1)
        assert len(value[own == i]) == 2 * min(4, n + 1) + sum(max(0, n + 2 - k + 1) for k in (2, 3, 4))


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_languages_of_held_out_texts_and_of_switched_ones(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = queries.op12_language_id(spark, TABLES).collect()
    assert len(got) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    # texts spliced from held-out ones: words are told one by one
    model = langid.trained(docs)
    texts = {r.doc_id: re.findall("[^\\W\\d_]+", r.text) for r in docs.where(langid.held_out(F.col("doc_id"))).select("doc_id", "text").collect()}
    ids = [i for i in sorted(texts) if len(texts[i]) >= 40]
    rng, rows, gold = random.Random(6), [], {}
    for k in range(60):
        parts = [(i, rng.randint(0, len(texts[i]) - 20)) for i in rng.sample(ids, 3)]
        rows.append((k, " ".join(w for i, a in parts for w in texts[i][a : a + 20])))
        gold[k] = [want[i] for i, _ in parts for _ in range(20)]
    spans = langid.language_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    said = {k: [None] * 60 for k in gold}
    for s in spans:
        said[s.doc_id][s.first_word : s.first_word + s.n_words] = [s.lang] * s.n_words
    right = sum(a == b for k in gold for a, b in zip(gold[k], said[k], strict=True))
    assert right >= 0.93 * 60 * 60
    again = langid.trained(docs)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.transitions, again.transitions)


def test_language_edges(spark):
    got = langid.identify_languages(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    by_id = {r.doc_id: r for r in got}
    for i in (3, 4, 5):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(r.lang_pred in ("en", "fr") for r in got if r.doc_id not in (3, 4, 5))
    assert by_id[None].held_out is False and by_id[1].lang_pred == "en"
    assert langid.identify_languages(empty_docs(spark)).count() == 0
    none = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify_languages(none).collect()} == {("und", 0.0)}
    digits = spark.createDataFrame([(1, "12 34"), (2, "\u00b7 \u2014"), (3, "\u0416")], "doc_id long, text string")
    model = langid.trained(odd_docs(spark))
    assert {r.doc_id: r.lang_pred == "und" for r in langid.languages(digits, model).collect()} == {1: True, 2: True, 3: False}
    assert {r.doc_id for r in langid.language_spans(digits, model).collect()} == {3}


# ---------------------------------------------------------------- 13


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, mid, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}")
    return (doc_id, n, "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}")


def test_fill_in_middle_equals_brute_force_and_goes_back(spark, monkeypatch):
    monkeypatch.setattr(fim, "SLICE_BYTES", 400)
    rng = random.Random(8)
    alphabet = ["a", "Bc", "é", " ", "\n", "<", ">", "<P", "S>", "日", "\x00", "😀", "'", "\\1"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000, "x<P>y"), (1001, "<S>"), (1002, None), (1003, ""), (None, "no id here"), (5, rows[5][1]), (1004, "Ab1 " * 60_000)]
    done = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, done.collect()), key=repr)
    assert got == sorted((brute_fim(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    back = fim.restore(done, keep=("n",)).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_fill_in_middle_edges(spark):
    df = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, fim.fill_in_middle(df).collect()), key=repr) == sorted((brute_fim(*r) for r in rows), key=repr)
    assert fim.fill_in_middle(empty_docs(spark)).count() == 0
    assert fim.restore(fim.fill_in_middle(empty_docs(spark))).count() == 0
