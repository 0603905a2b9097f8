"""Retrieval operators: gates, matches, graph steps, writes, sources, streams and the facade."""

import json
import math
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.api import Memory
from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.functions.similarity import join_similar, similar
from lodestone.functions.vector import BigramEmbedder, check_dimension, cosine, embed
from lodestone.operators import bm25, evaluate, fold, graph, keys, maintain, recall, robust, write
from lodestone.schema import KEYS, conform
from lodestone.sources import store as ST
from lodestone.sources import transcripts as TR

NOW = 1_000_000.0


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# ---------------------------------------------------------------- configuration


def test_profiles_and_environment():
    assert C.PROFILES["bgem3"].content_gate(True) == 0.46 and C.PROFILES["bge"].content_gate(True) == 0.50
    env = {"LODESTONE_KEY_MERGE": "0.5", "LODESTONE_MIN_SCORE": "7", "LODESTONE_GATE_Z": "2.5", "LODESTONE_HUB_LINKS": "1", "LODESTONE_RELATED_LIMIT": "5", "LODESTONE_PROMOTE_N": "x"}
    c = C.from_env(env=env, profile="bge")
    assert (c.profile.key_merge, c.profile.min_score, c.profile.gate_z, c.hub_links, c.related_limit, c.promote_n) == (0.5, 0.5, 2.5, 3, 5, 3)
    with pytest.warns(UserWarning):
        assert C.from_env(env={}, profile="?").profile == C.PROFILES["bge"]
    assert C.from_env(env={"OLD_KEY_MERGE": "0.7", "OLD_MIN_SCORE": "0.1", "LODESTONE_MIN_SCORE": "0.2"}, legacy="OLD_", model=" BGE_M3 ").profile == C.dataclasses.replace(C.PROFILES["bgem3"], key_merge=0.7, min_score=0.2)
    assert [C.family_of(x) for x in ("EmbeddingModel.MLE5Large", "all-minilm-l6-v2", "bge small en v1.5", "gpt")] == ["e5", "minilm", "bge", None]
    assert C.model_prefix("e5", "query") == "query: " and C.model_prefix("bgem3", "query") == ""
    assert C.data_dir({"LODESTONE_DATA_DIR": "/x"}) == "/x" and C.data_dir({"OLD_DATA_DIR": "/y"}, legacy="OLD_") == "/y" and C.data_dir({}, home="/nowhere") == "/nowhere/.lodestone"


# ---------------------------------------------------------------- text


def texts(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select(f(F.col("t")), "i").orderBy("i").collect()]


def test_text_functions(spark):
    assert texts(spark, ["Hello, World—x $5+"], T.terms) == [["hello", "world", "x", "$5+"]]
    assert texts(spark, ["one two", "a long concept name here", "fifteen chars!!", "abcdefghij klmnop qrs"], T.short_concept) == [True, False, True, False]
    assert texts(spark, ["한글 text", "kana か", "ㄱ"], T.has_hangul) == [True, False, True]
    assert texts(spark, ["Only one sentence here.", "First sentence here. Second one is here!\nThird line is long\nshort"], T.sentences) == [[], ["First sentence here.", "Second one is here!", "Third line is long"]]
    assert texts(spark, ["fix v1.2.3 and #42 in deadbeef1", "version 10.4 of feedface", "x1.2y", "needs 1.2.3-beta.1 now", "버전1.2.3", "1.0+b-é. 2.0", "#1#2 3.4/5.6", "abcdef #x"], T.structured_tokens) == [
        ["v1.2.3", "#42", "deadbeef1"], ["10.4", "feedface"], [], ["1.2.3-beta.1"], ["2.3"], ["1.0+b-é.", "2.0"], ["#1", "3.4", "5.6"], []]
    hay = F.lit("the release 1.2.3 is out")
    assert list(one(spark, T.covers_structured(F.lit("needs 1.2.3-beta.1 now"), hay), T.covers_structured(F.lit("needs 1.2.3 now"), hay))) == [False, True]
    assert texts(spark, ["what is the C++ api of Foo-Bar"], T.query_tokens) == [["c++", "api", "of", "foo-bar"]]
    assert texts(spark, ["내 what were tell about please 관련 dog and dog"], T.query_tokens) == [["dog", "and", "dog"]]
    assert texts(spark, ["hi", "/cmd longer", "long enough"], T.skip_prompt) == [True, True, False]
    assert texts(spark, ["a" * 30], lambda t: T.preview(t, 10)) == ["a" * 9 + "…"]
    r = one(
        spark, T.usable_keys(F.array(*map(F.lit, [" ab ", "x", "中", "か", ""]))), T.literal_match(F.lit("C++"), F.lit("I like c++, a lot")), T.literal_match(F.lit("art"), F.lit("start of it")), T.literal_match(F.lit("a"), F.lit("a")),
        T.covers_lexically(F.lit("red green blue"), F.lit("the red and green")), T.covers_lexically(F.lit("who is the"), F.lit("who is the")), T.covers_structured(F.lit("bug #12"), F.lit("see #13")),
        T.conflicting_qualifier(F.lit("Plan A"), F.lit("plan b")), T.conflicting_qualifier(F.lit("plan a"), F.lit("plans b")), T.aliases(F.array(*map(F.lit, ["K", "Key", "kEy", "Other"])), F.lit("other")), T.parse_keys(F.lit('["a","b"]')),
        T.merge_source(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))), T.phrase_key(F.lit("a b c")), T.single_language(F.array(F.lit("한"), F.lit("a"))), T.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000")), F.length(T.new_id(F.lit("x"))),
    )
    assert list(r) == [["ab", "中", "か"], True, False, False, True, False, False, True, False, ["Key"], ["a", "b"], {"a": "1", "b": "2"}, True, False, True, 12]
    with pytest.raises(Exception, match="invalid session"):
        one(spark, T.check_session(F.lit("../x")))


# ---------------------------------------------------------------- scores and vectors


def test_scores(spark):
    r = one(
        spark, S.time_factor(F.lit(NOW - 30 * 86400), F.lit(0.0), NOW), S.depth_factor(F.lit(0.5)), S.clamp_weight(F.lit(9.0)), S.superseded_depth(F.lit(0.7)), S.superseded_depth(F.lit(0.5)), S.idf(F.lit(4), F.lit("name")), S.idf(F.lit(1), F.lit("concept")),
        S.round3(F.lit(0.0005)), S.distribution_gate(F.lit(1.0), F.lit(7), 2.5), S.distribution_gate(F.lit(1.0), F.lit(8), 2.5), S.distribution_gate(F.lit(None).cast("double"), F.lit(9), 2.5), S.absolute_gate(F.lit(0.1), 0.0), S.recall_status(F.lit(0), F.lit(3)),
        S.contradiction_band(F.lit(0.8), 0.8, 0.94), S.contradiction_band(F.lit(0.94), 0.8, 0.94),
    )
    assert r[0] == pytest.approx(0.5 + 0.5 * math.exp(-1)) and list(r)[1:7] == pytest.approx([0.95, 3.0, 0.56, 0.15, 0.125, 1.0])
    assert list(r)[7:] == [0.001, True, False, True, True, "no_match", True, False]


def test_similarity_kernel_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 8)).astype(np.float32)
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "item_id long, embedding array<float>")
    got = {(r.query_id, r.item_id): r.sim for r in similar(df.withColumnRenamed("item_id", "query_id"), df, least=0.2, block=7).collect()}
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-30)
    want = {(i, j): s for (i, j), s in np.ndenumerate(u @ u.T) if s >= 0.2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert similar(df.limit(0).withColumnRenamed("item_id", "query_id"), df, least=0.0).count() == 0
    a, z = F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert list(one(spark, cosine(a, a), cosine(a, z))) == pytest.approx([1.0, 0.0])
    with pytest.raises(Exception, match="dimensions"):
        one(spark, check_dimension(a, 3))
    e = embed(spark.createDataFrame([("abc",), (None,)], "t string"), "t", BigramEmbedder(16)).collect()
    assert np.linalg.norm(e[0].embedding) == pytest.approx(1, abs=1e-6) and len(e[1].embedding) == 16


@pytest.mark.parametrize("kind", ["random", "clustered", "crowded", "low"])
def test_similarity_join_equals_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    centers = rng.normal(size=(12, 8))
    draw = lambda n: (rng.normal(size=(n, 8)) if kind in ("random", "low") else centers[rng.integers(0, 12 if kind == "clustered" else 2, n)] + 0.15 * rng.normal(size=(n, 8))).astype(np.float32)
    left, right = draw(300), draw(400)
    left[5], right[7] = 0, 0
    right[20:40], left[30:35] = right[20], right[20]  # copies, on both sides
    least = -0.2 if kind == "low" else 0.7
    frame = lambda m, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(900, None)], f"{name} long, embedding array<float>")
    a, b = frame(left, "query_id"), frame(right, "item_id")
    u = [m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-30) for m in (left, right)]
    want = {(i, j): s for (i, j), s in np.ndenumerate(u[0] @ u[1].T) if s + 1e-10 >= least}
    for cells, chunk in ((None, 2048), (10, 64), (40, 16)):
        rows = join_similar(a, b, least, cells=cells, chunk_rows=chunk).collect()
        got = {(r.query_id, r.item_id): r.sim for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    best = join_similar(a, b, None, cells=10, chunk_rows=64, top=2).groupBy("query_id").agg(F.max("sim").alias("s")).collect()
    assert all(abs(r.s - (u[0] @ u[1].T)[r.query_id].max()) < 1e-9 for r in best) and len(best) == 300
    # a query table beyond the bound takes the join
    assert {(r.query_id, r.item_id) for r in similar(a, b, least, block=50).collect()} == want.keys()
    with pytest.raises(Exception, match="dimensions"):
        join_similar(a, b.withColumn("embedding", F.slice("embedding", 1, 3)), least, cells=4).count()


def test_similarities_come_in_bounded_pieces_and_rows_have_few_copies(spark, monkeypatch):
    from lodestone.functions import similarity

    rng = np.random.default_rng(5)
    q, m = rng.normal(size=(40, 6)), rng.normal(size=(500, 6))
    monkeypatch.setattr(similarity, "AT_ONCE", 400)
    pieces = list(similarity._Kept(q, None, 3).of(m))
    assert len(pieces) == 50 and all(len(i) <= 400 for i, _, _ in pieces)
    got = {(a, b) for i, j, _ in pieces for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(int(i), j) for j in range(40) for i in np.argsort(-(m @ q[j]))[:3]} <= got and len(got) < 40 * 100
    # chunks grow with the table: the copies of a row don't
    plans, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None, *a, **k: (plans.append((rows, schema)), make(self, rows, schema, *a, **k))[1])
    e = make(spark, [(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    join_similar(e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "item_id"), 0.5, cells=2, chunk_rows=4)
    plan = next(rows for rows, schema in plans if schema == "cell int, n int, m int")
    assert all(r["n"] <= 2 and r["m"] <= 16 for r in plan)


def test_the_last_round_of_an_expansion_is_not_written(spark, monkeypatch):
    from lodestone.operators import graph as g

    k = spark.createDataFrame([(i, f"c{i}", "concept") for i in range(3)], "key_id long, concept string, key_type string")
    l = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 2.0), (2, 1, 2.0), (2, 4, 1.0)], "key_id long, memory_id long, weight double")
    m = spark.createDataFrame([(i, i, None, None) for i in range(1, 5)], "memory_id long, seq long, ttl double, supersedes long")
    q = spark.createDataFrame([(7, 1, 1.0)], "query_id long, memory_id long, score double")
    seen, real = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df: (seen.append(df), real(df))[1])
    got = {r.memory_id: (round(r.score, 9), r.hop) for r in g.expand(q, k, l, m, 0.0, hops=3).collect()}
    # round two from 1: key 0 gives 0.15 to 2, key 2 gives 0.2 to 3 and 0.1 to 4; round three from all of those
    assert got == {1: (1.0825, 1), 2: (0.18, 2), 3: (0.2425, 2), 4: (0.12, 2)}
    assert [df.agg(F.max("hop")).first()[0] for df in seen] == [2] and all(len(d.where("memory_id = 1 AND score > 1.0").take(1)) == 0 for d in seen)


def test_postings_are_added_in_bounded_parts(monkeypatch):
    from lodestone.operators import bm25 as b

    monkeypatch.setattr(b, "POSTINGS", 10)
    sizes = np.array([3, 3, 4, 25, 0, 1, 9, 1])
    parts = list(b._parts(sizes))
    assert np.concatenate([np.arange(8)[p] for p in parts]).tolist() == list(range(8)) and all(sizes[p].sum() <= 10 or p.stop - p.start <= 2 for p in parts)
    sums, whole = np.zeros((3, 4)), np.zeros((3, 4))
    row, place, w = np.array([0, 0, 1, 1, 2]), np.array([1, 1, 0, 3, 2]), np.arange(1.0, 6.0)
    np.add.at(whole, (row, place), w)
    for p in (slice(0, 3), slice(3, 5)):
        b._add(sums, row[p], place[p], w[p])
    assert (sums == whole).all()


def test_cells_keep_right_rows_from_most_cells():
    from lodestone.functions.similarity import Cells
    from lodestone.functions.vector import unit

    rng = np.random.default_rng(9)
    centers = unit(rng.normal(size=(64, 32)))
    rows = unit(centers[rng.integers(0, 64, 4000)] + 0.05 * rng.normal(size=(4000, 32)))
    c = Cells(centers, 0.9)
    assert c.reached(rows).mean() < 0.05  # of 64 cells a row is copied to three at most, on average


def ordered_fold(pairs, gone):
    out, away = {}, set()
    for mine, q in sorted({(p[4], p[0]) for p in pairs}):
        own = sorted((-p[2], p[3], p[1]) for p in pairs if p[0] == q and p[1] not in away)
        if own:
            out[q] = own[0][2]
            away.add(q if gone == "query_id" else own[0][2])
    return out


@pytest.mark.parametrize("gone", ["query_id", "item_id"])
def test_fold_in_ranges_equals_the_ordered_fold(spark, gone):
    rng = np.random.default_rng(len(gone))
    for n, density in ((60, 0.05), (50, 0.4)):
        pairs = [(f"n{i}", f"n{j}", float(rng.integers(40, 60)) / 100, j, i) for i in range(n) for j in range(i) if rng.random() < density]
        df = spark.createDataFrame(pairs, "query_id string, item_id string, sim double, order long, mine long")
        for limit in (10_000, 60):
            assert {r.query_id: r.item_id for r in write.fold_in_order(df, gone, limit).collect()} == ordered_fold(pairs, gone)


def test_a_chain_of_near_items_folds_range_by_range(spark):
    n = 100_000
    df = spark.range(1, n).select(F.format_string("n%06d", "id").alias("query_id"), F.format_string("n%06d", F.col("id") - 1).alias("item_id"), F.lit(0.9).alias("sim"), (F.col("id") - 1).alias("order"), F.col("id").alias("mine"))
    merged = write.fold_in_order(df, "query_id", limit=40_000)
    # every other one merges: its neighbour before it stands
    r = merged.agg(F.count("*"), F.min(F.substring("query_id", 2, 6).cast("int") % 2), F.max(F.substring("query_id", 2, 6).cast("int") % 2)).first()
    assert tuple(r) == (n // 2, 1, 1)


def test_contradictions_by_keys_and_by_similarity_agree(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    m = spark.createDataFrame([(f"m{i}", i, x.tolist()) for i, x in enumerate(v)], "memory_id string, seq long, embedding array<float>")
    links = spark.createDataFrame([(f"k{rng.integers(0, 8)}", f"m{i}") for i in range(60) for _ in range(2)], "key_id string, memory_id string").distinct()
    c = C.Config(profile=C.dataclasses.replace(C.PROFILES["bgem3"], contradiction=0.3, memory_dedup=0.9))
    got = [{(r.a, r.b): round(r.sim, 9) for r in write.contradictions(m, links, config=c, by_keys=k).collect()} for k in (True, False, None)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20
    n = {k: sum(1 for r in links.collect() if r.key_id == k) for k in {r.key_id for r in links.collect()}}
    assert write.key_pairs(links) == sum(x * (x - 1) // 2 for x in n.values())


def test_bm25_expansion_equals_brute_force(spark):
    vocabulary = ["cat", "cats", "cat's", "cut", "category", "dog", "doge", "a", "ab", "international", "internatinal", "internationalise", "élan", "elan"]
    asked = ["cat", "dog", "a", "international", "elan", "categori"]
    v = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    got = {(r.q_term, r.term): r.term_weight for r in bm25.expand_terms(spark.createDataFrame([(1, q) for q in asked], "query_id long, q_term string"), v).collect()}

    want = {}
    for q in asked:
        for t in vocabulary:
            w = [1.0] if q == t else []
            if t.startswith(q) and len(t) > len(q):
                w.append(0.375 * len(t) / (len(t) + 0.3 * (len(t) - len(q))))
            d = edits(q, t)
            if q != t and d <= math.floor(len(q) * 0.2 + 0.5):
                w.append(0.45 * len(t) / (len(t) + d))
            if w:
                want[q, t] = max(w)
    assert got == pytest.approx(want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_walking_the_trie_finds_all_near_terms():
    rng = np.random.default_rng(5)
    word = lambda low, high: "".join(rng.choice(list("abcé"), rng.integers(low, high)))
    trie = bm25.Trie(sorted({word(1, 12) for _ in range(600)} | {"a\x00", "a", "\U0010ffff", "\U0010ffffx"}))
    for budget in (1, 2, 3):
        asked = sorted({word(8, 9) for _ in range(30)} | {trie.names[i] for i in range(0, len(trie.names), 9) if len(trie.names[i]) == 8})
        got = {(asked[q], trie.names[t]): d for part in trie.near(asked, budget) for q, t, d in zip(*(x.tolist() for x in part), strict=True)}
        assert got == {(q, t): edits(q, t) for q in asked for t in trie.names if edits(q, t) <= budget}
    for q in ("a", "ab", "é", "zz", "\U0010ffff"):
        assert [trie.names[i] for i in trie.prefixed(q)] == [t for t in trie.names if t.startswith(q) and t != q]


def full_scores(docs, asked, prefix, fuzzy):
    """Scores of all documents for all queries, posting by posting."""
    split = lambda t: [w for w in (t or "").split(" ") if w]
    words = {i: split(t) for i, t in docs.items()}
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    avg = sum(map(len, words.values())) / max(1, len(words))
    out = {}
    for q, text in asked.items():
        for i, w in words.items():
            total, answered = 0.0, 0
            for x in sorted(set(split(text))):
                hit = False
                for y in sorted(set(w)):
                    tw = [1.0] if x == y else []
                    if prefix and y.startswith(x) and y != x:
                        tw.append(0.375 * len(y) / (len(y) + 0.3 * (len(y) - len(x))))
                    if fuzzy and x != y and edits(x, y) <= math.floor(len(x) * 0.2 + 0.5):
                        tw.append(0.45 * len(y) / (len(y) + edits(x, y)))
                    if tw:
                        tf = w.count(y)
                        hit = True
                        total += max(tw) * math.log(1 + (len(words) - df[y] + 0.5) / (df[y] + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len(w) / avg)))
                answered += hit
            if answered:
                out[q, i] = total * answered
    return out


@pytest.mark.parametrize(("prefix", "fuzzy"), [(False, False), (True, True)])
def test_search_with_bounds_equals_scoring_everything(spark, monkeypatch, prefix, fuzzy):
    monkeypatch.setattr(bm25, "SHARD_DOCS", 16)
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 4)
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(60)]
    text = lambda n: " ".join(vocabulary[min(int(rng.exponential(12)), 59)] for _ in range(n))
    docs = {f"d{i:03d}": text(int(rng.integers(0, 30))) for i in range(150)} | {"null": None, "empty": ""}
    docs |= {"copy1": docs["d007"], "copy2": docs["d007"]}
    asked = {i: text(int(rng.integers(1, 6))) for i in range(20)} | {90: "zzzzzz", 91: "", 92: None}
    d = spark.createDataFrame(list(docs.items()), "memory_id string, content string").repartition(4)
    q = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    want = full_scores(docs, asked, prefix, fuzzy)
    index = bm25.Index.build(d)
    assert index.shards.count() >= 9 and index.stats().first()["n_docs"] == len(docs)

    def ranked(k):
        for i in asked:
            own = sorted((-round(s + 1e-10, 6), doc) for (x, doc), s in want.items() if x == i)
            yield from ((i, doc, r + 1, s) for r, (s, doc) in enumerate(own[:k]))

    for probe, blocks in ((0, 512), (3, 512), (3, 7)):
        monkeypatch.setattr(bm25, "QUERY_BLOCK", blocks)
        got = sorted((r.query_id, r.memory_id, r["rank"], -round(r.score + 1e-10, 6)) for r in index.search(q, 5, prefix, fuzzy, probe=probe).collect())
        assert [g[:3] for g in got] == [w[:3] for w in sorted(ranked(5))] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, sorted(ranked(5)), strict=True))
    terms = {r.term: r.df for r in index.terms().collect()}
    rows = index.postings().collect()
    assert terms == {t: sum(r.term == t for r in rows) for t in terms} and len(rows) == sum(terms.values())


def test_shards_are_told_of_their_own_rare_terms(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCS", 16)
    docs = [(i, f"a{i} and {'b' * (1 + i % 3)}") for i in range(640)]
    told, packed = [], bm25._packed
    monkeypatch.setattr(bm25, "_packed", lambda wanted, stands, blocks: (told.append(stands.count()), packed(wanted, stands, blocks))[1])
    asked = [(1, "a"), (2, "a63 bb"), (3, "a"), (4, "zzz")]
    want = full_scores(dict(docs), dict(asked), True, True)
    index = bm25.Index.build(spark.createDataFrame(docs, "memory_id long, content string").coalesce(2))
    assert index.shards.count() == 40
    for blocks in (512, 1):
        monkeypatch.setattr(bm25, "QUERY_BLOCK", blocks)
        got = {(r.query_id, r.memory_id): r.score for r in index.search(spark.createDataFrame(asked, "query_id long, query string"), 700, probe=0).collect()}
        assert got == pytest.approx(want)
    assert told == [3, 3]  # `and` of `a`, two of `bb`; a term of one document is told to one shard


def test_blocks_that_cannot_reach_a_score_are_not_read(spark):
    import pyarrow as pa

    # a rare word in one block of documents, a common word everywhere
    docs = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i < 64 else "filler")) for i in range(640)]
    index = bm25.Index.build(spark.createDataFrame(docs, "memory_id long, content string").coalesce(1))
    (row,) = index.shards.collect()
    shard = bm25.Shard(pa.array(row.docs), row.lens, pa.array(row.terms), np.array(row.dfs), row.at, row.tf, index.stats().first()["avg_len"])

    def asked(least):
        wanted = spark.createDataFrame([(1, "common", least), (1, "rare", least)], "query_id long, q_term string, least double")
        stands = spark.createDataFrame([("common", "common", 0.1), ("rare", "rare", 2.0)], "q_term string, term string, v double")
        row = bm25._packed(wanted, stands, 1).first()
        return bm25.Asked(row.queries, row.stands)

    q, d, s, read = shard.best(asked(0.0), 10)
    kth = np.sort(s)[-10]
    q2, d2, s2, fewer = shard.best(asked(float(kth)), 10)
    assert set(zip(d, s, strict=True)) >= set(zip(d2, s2, strict=True)) and len(d2) >= 10
    assert read == 640 + 64 and fewer == 128  # both words' postings of one block


# ---------------------------------------------------------------- graph


def tables(spark, memories, links, concepts, dim=2):
    m = spark.createDataFrame(
        [(x["id"], x.get("content", ""), x.get("embedding", [0.0] * dim), x.get("created_at", NOW), x.get("supersedes"), x.get("depth", 0.0), 0, NOW, x.get("namespace", "default"), x.get("ttl"), x.get("links", []), x.get("contradicts", []), i) for i, x in enumerate(memories)],
        "memory_id string, content string, embedding array<float>, created_at double, supersedes string, depth double, access_count int, last_accessed double, namespace string, ttl double, links array<string>, contradicts array<string>, seq long",
    )
    k = spark.createDataFrame([(c, c, x.get("aliases", []), x.get("type", "concept"), x.get("embedding", [0.0] * dim), i) for i, (c, x) in enumerate(concepts.items())], "key_id string, concept string, aliases array<string>, key_type string, embedding array<float>, seq long")
    return m, k, spark.createDataFrame([(a, b, w) for a, b, w in links], "key_id string, memory_id string, weight double")


def test_active_hops_and_related(spark):
    m, k, l = tables(
        spark, [{"id": "A"}, {"id": "B"}, {"id": "C"}, {"id": "D"}, {"id": "old"}, {"id": "new", "supersedes": "old"}, {"id": "gone", "ttl": NOW - 1}, {"id": "edge", "ttl": NOW, "links": ["D"]}],
        [("ab", "A", 1.0), ("ab", "B", 1.0), ("bc", "B", 1.0), ("bc", "C", 2.0), ("cd", "C", 1.0), ("cd", "D", 1.0), ("ab", "old", 1.0)], {"ab": {}, "bc": {}, "cd": {"type": "name"}},
    )
    assert {r.memory_id for r in graph.active(m, NOW).collect()} == {"A", "B", "C", "D", "new", "edge"}
    assert graph.active(m, NOW, "other").count() == 0 and graph.active(m, NOW, "").count() == 6
    start = spark.createDataFrame([(1, "A", 1.0)], "query_id long, memory_id string, score double")
    rows = {r.memory_id: r for r in graph.expand(start, k, l, m, NOW, 5, pairs=graph.explicit_pairs(m)).collect()}
    assert {x: r.hop for x, r in rows.items()} == {"A": 1, "B": 2, "C": 3, "D": 4, "edge": 5}
    assert rows["B"].score >= 0.3 / 3 - 1e-12
    rel = {r.memory_id: (r.link_type, round(r.score, 6), r.n_shared) for r in graph.related(spark.createDataFrame([("C",), ("D",)], "seed_id string"), k, l, m, NOW).where("seed_id = 'C'").collect()}
    assert rel == {"B": ("key", 0.5, 1), "D": ("key", 0.25, 1)}
    heads = {r.memory_id: (r.head_id, r.steps) for r in graph.supersession_heads(m).collect()}
    assert heads["old"] == ("new", 1) and heads["A"] == ("A", 0)


def test_search_keys_gates_and_ranking(spark):
    m, k, l = tables(
        spark, [{"id": "m1", "embedding": [1.0, 0.0]}, {"id": "m2", "embedding": [0.0, 1.0]}], [("near", "m1", 1.0), ("other", "m1", 1.0), ("Ann", "m2", 1.0), ("far", "m2", 1.0)],
        {"near": {"embedding": [1.0, 0.1]}, "other": {"embedding": [0.3, 1.0]}, "Ann": {"type": "name", "embedding": [1.0, 0.0], "aliases": ["Annie"]}, "far": {"embedding": [0.0, 1.0]}},
    )
    q = spark.createDataFrame([(1, [1.0, 0.0], "who"), (2, [1.0, 0.0], "where is annie?")], "query_id long, embedding array<float>, query string")
    got = {(r.query_id, r.key_id): (r.match_type, r.score) for r in keys.search_keys(q, k, l, m, NOW).collect()}
    # of the two keys of m1 one claims its content; the entity key needs its name in the text
    assert set(got) == {(1, "near"), (2, "near"), (2, "Ann")} and got[2, "Ann"] == ("alias", 1.0)
    near = [r.key_id for r in keys.nearest_keys(q.where("query_id = 1"), k, l, m, NOW).orderBy("rank").collect()]
    assert set(near) == {"near", "other", "Ann", "far"}


def test_names_meet_texts_on_their_rarest_token(spark):
    # every name begins with a stop word that every text has
    names = [(f"k{i}", f"a topic{i}", [f"A Thing{i}"]) for i in range(40)] + [("c", "c++", []), ("p", "++", [])]
    k = spark.createDataFrame(names, "key_id string, concept string, aliases array<string>")
    q = spark.createDataFrame([(i, f"tell me a topic{i % 10} or a thing{i % 7}, c++ too") for i in range(30)] + [(99, "++"), (100, None)], "query_id long, query string")
    hits = {(r.query_id, r.key_id, r.literal) for r in keys.literal_hits(q, k).collect()}
    want = {(i, f"k{i % 10}", "alias" if i % 7 == i % 10 else "concept") for i in range(30)} | {(i, f"k{i % 7}", "alias") for i in range(30)} | {(i, "c", "concept") for i in range(30)} | {(99, "p", "concept")}
    assert hits >= want - {(i, "p", "concept") for i in range(30)} and {h[:2] for h in hits} >= {w[:2] for w in want}
    n = keys.literal_candidates(q, k).count()
    assert n <= 2 * 30 + 30 + 32  # the alphabetically first token, the stop word, would have met 80 names in each text


def test_candidates_carry_tokens_not_texts(spark):
    # a text in each row of a token is quadratic in its length
    k = spark.createDataFrame([("k", "red fox", ["the fox"])], "key_id string, concept string, aliases array<string>")
    q = spark.createDataFrame([(1, "the red fox " + "word " * 50), (1, "the fox"), (None, "red fox"), (2, None)], "query_id long, query string")
    assert set(keys.literal_candidates(q, k).columns) == {"query_id", "key_id", "term", "is_alias"}
    assert {tuple(r) for r in keys.literal_hits(q, k).collect()} == {(1, "k", "alias"), (None, "k", "concept")}
    assert {tuple(r) for r in keys.alias_uses(q, k).collect()} == {(1, "k", "the fox")}


def test_key_gate_lets_no_near_copy_through_as_a_certain_one(spark, tmp_path):
    import duckdb

    from lodestone.plans.queries import ORACLES, QUERIES

    a = np.eye(8)
    near = a[0] + 0.09 * a[5]  # a cosine of 0.996 to the first, of none to any key of another label
    rows = [(0, a[0], 0), (1, a[1], 1), (50, a[2], 0), (51, a[2] + 0.09 * a[6], 1), (2, near, 0)]
    spark.createDataFrame([(i, v.tolist(), label) for i, v, label in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in QUERIES["key_gate"](spark, str(tmp_path)).collect()}
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(duckdb.sql(ORACLES["key_gate"]).fetchall()) == {(0, False), (50, False)}


def test_gates_decide_whether_anything_is_found(spark):
    pop = spark.createDataFrame([(1, s) for s in [0.9] + [0.1, 0.11, 0.12, 0.1, 0.09, 0.13, 0.1, 0.12]] + [(2, 0.5)] * 9, "query_id long, sim double")
    z = {r.query_id: r.z for r in recall.robust_z(pop).collect()}
    assert z[1] > 10 and z[2] is None
    c = C.Config(profile=C.Profile(0.8, 0.9, 0.5, 0.3, 0.3, 0.6, 0.8, gate_z=2.5))
    found = {r.query_id: r.found for r in recall.anchored(pop.withColumnRenamed("sim", "raw_sim"), recall.robust_z(pop), config=c).collect()}
    assert found == {1: True, 2: False}


@pytest.mark.parametrize("kind", ["spread", "equal", "even"])
def test_median_and_deviation_without_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(robust, "LISTED", 6)  # so that intervals are refined
    monkeypatch.setattr(robust, "BINS", 24)
    monkeypatch.setattr(robust, "ITEMS", 16)
    rng = np.random.default_rng(len(kind))
    n = 100 if kind == "even" else 101
    v = (np.repeat(rng.normal(size=(1, 6)), n, axis=0) if kind == "equal" else rng.normal(size=(n, 6))).astype(np.float32)
    extra = rng.normal(size=(40, 6)).astype(np.float32)
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, embedding array<float>")
    items = frame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "memory_id").repartition(3)
    packs = frame([(int(rng.integers(0, n)), x.tolist()) for x in extra], "memory_id")
    q = frame([(i, v[i].tolist()) for i in range(0, n, 12)] + [(901, None)], "query_id")
    sentences, block = {"spread": (packs, 4), "equal": (None, 4096), "even": (packs, 4096)}[kind]
    monkeypatch.setattr(robust, "BLOCK", block)  # of four: queries beyond the bound meet the items in chunks
    rows = items if sentences is None else items.unionByName(sentences)
    sims = similar(q, rows, item_id="memory_id").where("query_id <> memory_id").groupBy("query_id", "memory_id").agg(F.max("sim").alias("sim"))
    want = {r.query_id: r for r in recall.robust_z(sims).collect()}
    got = {r.query_id: r for r in robust.robust_spread(q, items, sentences, apart=True).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    for i, w in want.items():
        assert (got[i].n, got[i].top) == (w.n, pytest.approx(w.top, abs=1e-12))
        assert got[i].med == pytest.approx(w.med, abs=1e-12) and got[i].mad == pytest.approx(w.mad, abs=1e-12)
    assert robust.robust_spread(q, items.limit(0)).count() == 0 and robust.robust_spread(q.limit(0), items).count() == 0


# ---------------------------------------------------------------- writes


def test_writes_in_order(spark):
    c = C.Config(profile=C.PROFILES["bgem3"])
    m, k, l = tables(spark, [{"id": "a", "embedding": [1.0, 0.0], "depth": 0.8}], [("xx", "a", 1.0)], {"xx": {"embedding": [0.0, 1.0]}})
    new = spark.createDataFrame(
        [("b", 10, "near a", [1.0, 0.05], "other", None, ["xx"]), ("c", 11, "near b", [1.0, 0.08], "other", 5.0, ["xx"]), ("d", 12, "apart", [0.6, 0.8], "other", None, ["xx"]), ("e", 13, "similar to d", [0.2, 0.98], "other", None, ["xx"]), ("f", 14, "no keys", [0.0, 1.0], "other", None, [" ", "q"])],
        "memory_id string, seq long, content string, embedding array<float>, namespace string, ttl double, keys array<string>",
    )
    out = write.add_batch(new, m, l, k, NOW, c)
    rows = {r.memory_id: r for r in out["memories"].collect()}
    assert {r.memory_id for r in out["errors"].collect()} == {"f"} and set(rows) == {"a", "b", "c", "d", "e"}
    assert (rows["b"].supersedes, rows["c"].supersedes, rows["d"].supersedes) == ("a", "b", None)
    assert rows["a"].depth == pytest.approx(0.64) and rows["c"].ttl == NOW + 5
    assert {(r.a, r.b) for r in out["contradictions"].collect()} == {("d", "e")}


def test_key_resolution(spark):
    c = C.Config(profile=C.PROFILES["bgem3"])
    _, k, _ = tables(spark, [{"id": "a"}], [], {"deployment of services": {"embedding": [1.0, 0.0], "aliases": ["rollout"]}, "Bob": {"type": "name", "embedding": [0.0, 1.0]}})
    asked = spark.createDataFrame(
        [(1, "ROLLOUT", "concept", [0.0, 1.0]), (2, "deploying of the services", "concept", [1.0, 0.01]), (3, "plan a", "concept", [0.7, 0.7]), (4, "plan b", "concept", [0.7, 0.71]), (5, "Plan A", "concept", [0.7, 0.7]), (6, "bobby", "name", [0.0, 1.0])],
        "seq long, concept string, key_type string, embedding array<float>",
    )
    got = {r.seq: (r.key_id, r.how) for r in write.resolve_keys(asked, k, c).collect()}
    assert got[1] == ("deployment of services", "equal") and got[2] == ("deployment of services", "merged")
    assert got[3][1] == got[4][1] == got[6][1] == "new" and got[3][0] != got[4][0] and got[5] == (got[3][0], "equal")


def test_maintenance(spark):
    m, k, l = tables(spark, [{"id": "a", "links": ["b"], "contradicts": ["b"]}, {"id": "b", "supersedes": "c"}, {"id": "c"}, {"id": "t", "ttl": 5.0}], [("Go", "a", 0.4), ("go", "a", 1.2), ("go", "c", 1.0), ("only", "b", 1.0)], {"Go": {"type": "name"}, "go": {}, "only": {}})
    t = maintain.forget(spark.createDataFrame([("b",)], "memory_id string"), k, l, m)
    a = t["memories"].where("memory_id = 'a'").first()
    assert a.links == [] and a.contradicts == [] and {r.key_id for r in t["keys"].collect()} == {"Go", "go"}
    assert "c" in {r.memory_id for r in graph.active(t["memories"], NOW).collect()}  # no longer superseded
    assert {r.memory_id for r in maintain.cleanup_expired(k, l, m, NOW)["memories"].collect()} == {"a", "b", "c"}
    mapping, merged = maintain.heal_keys(k, l)
    assert {r.key_id: r.canonical_id for r in mapping.collect()} == {"Go": "Go", "go": "Go", "only": "only"}
    assert {(r.key_id, r.memory_id): r.weight for r in merged.collect()} == {("Go", "a"): 1.2, ("Go", "c"): 1.0, ("only", "b"): 1.0}
    events = spark.createDataFrame([("k", "m", i, 0.9) for i in range(5)] + [("k", "m", 9, -0.5)], "key_id string, memory_id string, seq long, delta double")
    assert maintain.fold_weights(events).first().weight == pytest.approx(2.5)  # clamped at 3.0 before the loss
    assert maintain.upsert_links(l, spark.createDataFrame([("go", "a"), ("go", "b")], "key_id string, memory_id string")).count() == 5


def test_changes_compose(spark):
    rng = np.random.default_rng(6)
    group = np.sort(rng.integers(0, 9, 200))
    delta = rng.normal(size=200)
    low, high, shift = fold.compose(np.full(200, 0.1), np.full(200, 3.0), delta, group)
    for i, g in enumerate(np.unique(group)):
        for x in (-5.0, 0.1, 1.0, 2.2, 9.0):
            w = x
            for d in delta[group == g]:
                w = max(0.1, min(3.0, w + d))
            assert min(high[i], max(low[i], x + shift[i])) == pytest.approx(w)


def test_a_log_folds_as_change_by_change(spark):
    rng = np.random.default_rng(7)
    rows = [(f"k{rng.integers(0, 3)}", f"m{rng.integers(0, 3)}", int(rng.integers(0, 500)), float(rng.normal())) for _ in range(2000)]
    links = spark.createDataFrame([("k0", "m0", 2.5), ("k1", "m1", 0.2)], "key_id string, memory_id string, weight double")
    want = {}
    for k, m, _, d in sorted(rows):
        n, w = want.get((k, m), (0, {("k0", "m0"): 2.5, ("k1", "m1"): 0.2}.get((k, m), 1.0)))
        want[k, m] = n + 1, max(0.1, min(3.0, w + d))
    got = {(r.key_id, r.memory_id): (r.n_events, r.weight) for r in maintain.fold_weights(spark.createDataFrame(rows, "key_id string, memory_id string, seq long, delta double"), links).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1]) for x in want)
    # a million changes of one link are a few triples
    many = spark.range(1_000_000).select(F.lit("k").alias("key_id"), F.lit("m").alias("memory_id"), F.col("id").alias("seq"), (F.sin(F.col("id")) * 0.3).alias("delta"))
    w = 1.0
    for d in np.sin(np.arange(1_000_000)) * 0.3:
        w = max(0.1, min(3.0, w + d))
    parts = fold.stretches(many, ["key_id", "memory_id"], 0.1, 3.0)
    assert parts.count() <= 8
    assert maintain.fold_weights(many).first().weight == pytest.approx(w)


def test_one_ring_for_all_things(spark):
    rng = np.random.default_rng(8)
    rows = [("abcd"[rng.integers(0, 4)], i, float(rng.integers(0, 120)), bool(rng.random() < 0.5)) for i in range(300)]
    c, pending, want = C.Config(buffer_size=5), [], {}
    for key, i, ts, read in sorted(rows, key=lambda x: (x[2], x[3], x[1])):
        if not read:
            pending = [*pending, [key, i, ts, False]][-5:]
            continue
        own = [p for p in pending if p[0] == key and not p[3]]
        if own and ts - own[-1][2] <= 20.0:
            own[-1][3] = True
            want[i] = own[-1][1]
    df = spark.createDataFrame(rows, "key string, id long, ts double, read boolean").repartition(4)
    got = {r.read_id: r.query_id for r in maintain.match_buffer(df.where("NOT read"), df.where("read"), ["key"], 20.0, c, one_ring=True).collect()}
    assert got == want and len(want) > 20
    n = fold.counted(df, ["ts", "id"], "read").orderBy("ts", "id").collect()
    assert [r.nth for r in n] == np.cumsum([r.read for r in n]).tolist()


def test_a_query_is_confirmed_once(spark):
    """Each read takes the latest fresh query that none took before; the ring holds the newest queries."""
    c = C.Config(buffer_size=3)
    asked = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 10.0), ("j", 3, 10.0), *[("r", 10 + i, 100.0 + i) for i in range(5)]], "key string, id long, ts double")
    reads = spark.createDataFrame([("k", 1, 11.0), ("k", 2, 12.0), ("k", 3, 13.0), ("j", 4, 400.0), ("j", 5, 9.0), *[("r", 10 + i, 200.0 + i) for i in range(5)]], "key string, id long, ts double")
    got = {(r.key, r.read_id): r.query_id for r in maintain.match_buffer(asked, reads, ["key"], 300.0, c).collect()}
    assert got == {("k", 1): 2, ("k", 2): 1, ("r", 10): 14, ("r", 11): 13, ("r", 12): 12}


def test_alias_learning(spark):
    c = C.Config(promote_n=2, max_aliases=2)
    k = conform(spark.createDataFrame([("k", "database", ["db"], "concept"), ("z", "other", [], "concept")], "key_id string, concept string, aliases array<string>, key_type string"), KEYS)
    rows = [("k", "m", q, cos, float(t), t) for t, (q, cos) in enumerate([
        ("DB", 0.9), ("DB", 0.9), ("Pg store", 0.9), ("pg store", 0.9), ("pg", 0.5), ("pg", 0.5), ("tables", 0.9), ("tables", 0.9), ("dbms", 0.7), ("dbms", 0.7), ("once", 0.9), ("x", 0.9), ("x", 0.9), ("far", 0.2), ("far", 0.2),
        ("a question that is long", 0.9), ("a question that is long", 0.9)])]
    confirmed = spark.createDataFrame(rows, "key_id string, memory_id string, query string, cosine double, ts double, read_id int")
    learned = maintain.learn_aliases(confirmed, k, c)
    assert {(r.name, r.decision, r.n_confirmed) for r in learned.collect()} == {("pg store", "alias", 2), ("pg", "alias", 2), ("tables", "none", 2), ("dbms", "newKey", 2), ("once", "none", 1), ("far", "none", 2), ("a question that is long", "none", 2)}
    row = maintain.apply_aliases(k, learned).where("key_id = 'k'").first()
    assert row.aliases == ["db", "pg store", "pg"] and [a.hits for a in row.learned_aliases] == [0, 0] and set(row.alias_candidates) == {"tables", "once", "far", "a question that is long"}
    again = maintain.learn_aliases(spark.createDataFrame([("k", "m", "once", 0.9, 99.0, 99)], confirmed.schema), maintain.apply_aliases(k, learned), C.Config(promote_n=2, max_aliases=3))
    assert [(r.n_confirmed, r.decision) for r in again.collect()] == [(2, "alias")]
    hit = maintain.count_alias_hits(maintain.apply_aliases(k, learned), spark.createDataFrame([("k", "PG"), ("k", "pg"), ("k", "db")], "key_id string, alias string")).where("key_id = 'k'").first()
    assert {a.alias: a.hits for a in hit.learned_aliases} == {"pg store": 0, "pg": 2}


def test_requests_promote_and_name_keys(spark):
    k = conform(spark.createDataFrame([("k1", "Ann", ["Annie"], "concept", 0)], "key_id string, concept string, aliases array<string>, key_type string, seq long"), KEYS)
    asked = spark.createDataFrame([(1, "annie", "concept"), (2, "ANN", "name"), (3, "ann", "proper_noun"), (4, "Anna Lee", "concept")], "seq long, concept string, key_type string")
    found = spark.createDataFrame([(1, "k1"), (2, "k1"), (3, "k1"), (4, "k1")], "seq long, key_id string")
    row = write.record_keys(k, asked, found).first()
    assert row.key_type == "name" and row.aliases == ["Annie", "Anna Lee"]
    m, _, _ = tables(spark, [{"id": "a"}, {"id": "b"}], [], {})
    wanted = spark.createDataFrame([("a", ["b", "a", "zz", "b"]), ("b", [])], "memory_id string, related_to array<string>")
    assert {r.memory_id: r.links for r in write.valid_links(wanted, m).collect()} == {"a": ["b"]}


def test_corrections_inherit_keys_that_fit(spark):
    _, k, l = tables(spark, [{"id": "o"}, {"id": "p"}], [("near", "o", 1.5), ("far", "o", 1.0), ("Bob", "o", 1.0), ("far", "p", 2.0)], {"near": {"embedding": [1.0, 0.1]}, "far": {"embedding": [0.0, 1.0]}, "Bob": {"type": "name", "embedding": [0.0, 1.0]}})
    new = spark.createDataFrame([("n", "o", [1.0, 0.0]), ("q", "p", [1.0, 0.0])], "memory_id string, supersedes string, embedding array<float>")
    got = {(r.memory_id, r.key_id): r.weight for r in write.inherited_links(new, l, k).collect()}
    assert got == {("n", "near"): 1.5, ("n", "Bob"): 1.0, ("q", "far"): 2.0}


def test_evidence_follows_anchors(spark):
    """A cluster that only full text found tags none of its neighbours; a real anchor does, over two hops."""
    m, k, l = tables(spark, [{"id": x} for x in "ABCXY"] + [{"id": "L", "links": ["A"]}], [("ab", "A", 1.0), ("ab", "B", 1.0), ("bc", "B", 1.0), ("bc", "C", 1.0), ("xy", "X", 1.0), ("xy", "Y", 1.0)], {"ab": {}, "bc": {}, "xy": {}})
    start = spark.createDataFrame([(1, "A", 1.0, ["(content)"]), (1, "X", 1.0, ["(bm25)"])], "query_id long, memory_id string, score double, via array<string>")
    got = {r.memory_id: (r.hop, sorted(r.via)) for r in graph.expand(start, k, l, m, NOW, 3, pairs=graph.explicit_pairs(m)).collect()}
    assert got == {"A": (1, ["(content)", "(linked)", "ab(via)"]), "X": (1, ["(bm25)"]), "Y": (2, []), "B": (2, ["ab(via)"]), "L": (2, ["(linked)"]), "C": (3, ["bc(via)"])}


def test_an_index_is_kept(spark):
    docs = spark.createDataFrame([("a", "red fox and dog"), ("b", "blue dog dog"), ("c", "")], "memory_id string, content string")
    more = spark.createDataFrame([("d", "green fox")], "memory_id string, content string")
    q = spark.createDataFrame([(1, "dog fox"), (2, "gre")], "query_id long, query string")
    grown = bm25.Index.build(docs).add(more).discard(docs.where("memory_id = 'b'"))
    fresh = bm25.Index.build(docs.where("memory_id <> 'b'").unionByName(more))
    rows = lambda i: sorted((r.query_id, r.memory_id, round(r.score, 9), r["rank"]) for r in i.search(q, 10).collect())
    assert rows(grown) == rows(fresh) and {(x[0], x[1]) for x in rows(grown)} == {(1, "a"), (1, "d"), (2, "d")}
    assert rows(grown.keep(more)) and bm25.Index.build(docs.limit(0)).search(q, 10).count() == 0


# ---------------------------------------------------------------- evaluation


def test_calibration(spark):
    rows = [("train", 0.95, True, "duplicate"), ("train", 0.82, True, "contradiction"), ("train", 0.82, False, "independent"), ("train", 0.3, True, "independent"), ("held-out", 0.96, False, "duplicate"), ("held-out", 0.81, True, "contradiction"), ("held-out", 0.2, False, "independent")]
    p = spark.createDataFrame(rows, "split string, sim double, shared boolean, actual string")
    best = evaluate.calibrate(p)
    assert (best["floor"], best["cut"]) == (0.75, 0.88) and best["train_macro_f1"] == 1.0 and best["held_out_macro_f1"] == 1.0 and best["prior_weighted_fp"] == 0.0
    for r in evaluate.sweep(p, [0.75, 0.85], [0.9, 0.97]).collect():  # the grid by counts equals the grid row by row
        q = p.withColumn("predicted", evaluate.classify(F.col("sim"), F.col("shared"), r.floor, r.cut))
        assert evaluate.prf(q).agg(F.avg("f1")).first()[0] == pytest.approx(r.macro_f1)
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (3, 1, "z")], "query_id long, rank int, item_id string")
    relevant = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, item_id string")
    got = {r.query_id: r for r in evaluate.query_metrics(ranked, relevant, spark.createDataFrame([(1,), (2,), (3,)], "query_id long")).collect()}
    assert (got[1].mrr, got[1].recall5, got[1].hit1, got[1].both5) == (0.5, 0.5, 0, 0) and got[2].correct_empty == 1 and got[3].correct_empty == 0


# ---------------------------------------------------------------- sources


def test_store_round_trip_and_migration(spark, tmp_path):
    m, k, l = tables(spark, [{"id": "a", "content": "hello world", "embedding": [1.0, 0.0]}], [("x", "a", 1.5), ("x", "nowhere", 1.0)], {"x": {"embedding": [1.0, 0.0]}})
    s = ST.Store(spark, str(tmp_path / "s"))
    assert s.load()["memories"].count() == 0
    s.save({"keys": k, "memories": m, "links": l}, "old")
    assert s._pointers() == [1]
    t = s.load()
    assert t["links"].count() == 1 and t["memories"].first().content == "hello world" and t["memories"].first().source is None
    e = BigramEmbedder(8)
    assert not s.migrate(e, auto=False) and s.migrate(e) and not s.migrate(e)
    assert len(s.load()["memories"].first().embedding) == 8 and s.current()["fingerprint"] == "bigram:8"
    s.append_log(spark.createDataFrame([("x", "a", 1, 0.25), ("x", "a", 2, 0.25)], "key_id string, memory_id string, seq long, delta double"))
    s.compact()
    assert s.load()["links"].first().weight == pytest.approx(2.0) and s._pointers() == [2, 3] and s.compact() is None
    side = spark.createDataFrame([("b", "m", 0, [0.0, 1.0])], "id string, kind string, part int, embedding array<float>")
    rows = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", []), ("c", "zed", None)], "memory_id string, content string, embedding array<float>")
    filled = {r.memory_id: list(r.embedding) for r in ST.fill_vectors(rows, side, "m", "memory_id", "content", BigramEmbedder(2)).collect()}
    assert filled["a"] == [1.0, 0.0] and filled["b"] == [0.0, 1.0] and len(filled["c"]) == 2
    packs = ST.sentence_vectors(spark.createDataFrame([("a", "One sentence here. And another one."), ("b", "single")], "memory_id string, content string"), e)
    assert sorted((r.memory_id, r.sent_idx) for r in packs.collect()) == [("a", 0), ("a", 1)]


def test_legacy_files(spark, tmp_path):
    g = {"keys": {"k1": {"id": "k1", "concept": "x"}}, "memories": {"m1": {"id": "m1", "content": "c", "embedding": [1, 2]}}, "links": [{"key_id": "k1", "memory_id": "m1"}, {"key_id": "k1", "memory_id": "m1"}, {"key_id": "k1", "memory_id": "gone"}]}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    t = ST.read_graph_json(spark, str(tmp_path / "g.json"))
    assert t["links"].collect()[0].weight == 1.0 and t["links"].count() == 1 and t["memories"].first().depth == 0.0
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        ST.read_graph_json(spark, str(tmp_path / "bad.json"))["keys"].collect()
    (tmp_path / "v.idx.json").write_text(json.dumps({"schema": 1, "dim": 2, "entries": {"m:a": {"off": 0, "n": 2}, "s:a": {"off": 2, "n": 4}, "k:bad": {"off": 0, "n": 3}, "k:far": {"off": 90, "n": 2}}}))
    (tmp_path / "v.bin").write_bytes(struct.pack("<6f", *range(6)))
    rows = ST.read_sidecar(spark, str(tmp_path / "v.idx.json"), str(tmp_path / "v.bin")).collect()
    assert sorted((r.kind, r.id, r.part, list(r.embedding)) for r in rows) == [("m", "a", 0, [0.0, 1.0]), ("s", "a", 0, [2.0, 3.0]), ("s", "a", 1, [4.0, 5.0])]


def test_a_legacy_store_keeps_sources_and_learned_names_and_gets_its_vectors(spark, tmp_path):
    keys_ = {
        "k1": {"id": "k1", "concept": "Database", "aliases": ["db", "DB ", "x", "database"], "aliasCandidates": {"pg": {"count": 2, "lastSeen": 5.5, "queryText": "Pg"}, "bad": {"count": "many"}}, "learnedAliases": [{"alias": "store", "addedAt": 3.0, "hits": 4}, {"alias": 7}]},
        "k2": {"id": "k2", "concept": "plain"},
    }
    memories = {
        "m1": {"id": "m1", "content": "first", "source": "chat", "embedding": [1, 2], "contradicts": ["m2", "gone"]}, "m2": {"id": "m2", "content": "second", "source": {"agent": "a", "turn": 3}},
        "m3": {"id": "m3", "content": "third", "links": ["m1"]},
    }
    (tmp_path / "g.json").write_text(json.dumps({"keys": keys_, "memories": memories, "links": [{"key_id": "k1", "memory_id": "m1"}]}))
    (tmp_path / "v.idx.json").write_text(json.dumps({"schema": 1, "dim": 2, "entries": {"m:m2": {"off": 0, "n": 2}, "k:k1": {"off": 2, "n": 2}, "s:m1": {"off": 4, "n": 4}, "m:m1": {"off": 0, "n": 2}}}))
    (tmp_path / "v.bin").write_bytes(struct.pack("<8f", *range(8)))
    t = ST.load_legacy(spark, str(tmp_path / "g.json"), BigramEmbedder(2), str(tmp_path / "v.idx.json"), str(tmp_path / "v.bin"))
    k = {r.key_id: r for r in t["keys"].collect()}
    assert k["k1"].aliases == ["db"] and [(a.alias, a.added_at, a.hits) for a in k["k1"].learned_aliases] == [("store", 3.0, 4)] and k["k2"].learned_aliases is None
    assert {n: (c["count"], c.last_seen, c.query_text) for n, c in k["k1"].alias_candidates.items()} == {"pg": (2, 5.5, "Pg")}
    assert list(k["k1"].embedding) == [2.0, 3.0] and len(k["k2"].embedding) == 2
    m = {r.memory_id: r for r in t["memories"].collect()}
    assert m["m1"].source == "chat" and json.loads(m["m2"].source) == {"agent": "a", "turn": 3} and m["m3"].source is None
    assert list(m["m1"].embedding) == [1.0, 2.0] and list(m["m2"].embedding) == [0.0, 1.0] and len(m["m3"].embedding) == 2
    assert m["m1"].contradicts == ["m2"] and m["m3"].links == ["m1"]
    assert sorted((r.memory_id, r.sent_idx, list(r.embedding)) for r in t["sentences"].collect()) == [("m1", 0, [4.0, 5.0]), ("m1", 1, [6.0, 7.0])]
    bare = ST.load_legacy(spark, str(tmp_path / "g.json"), BigramEmbedder(2))  # without a sidecar all is embedded
    assert bare["memories"].where("size(embedding) = 2").count() == 3 and bare["sentences"].count() == 0
    s = ST.Store(spark, str(tmp_path / "s"))
    s.save(t, "bigram:2")
    assert {r.key_id: r.learned_aliases for r in s.load()["keys"].collect()}["k1"][0].hits == 4


def test_rerank_trusts_low_scores_within_one_script_only(spark):
    c = C.Config(rerank_min_score=0.5)
    m = spark.createDataFrame([("a", "english text"), ("b", "한국어 글")], "memory_id string, content string")
    q = spark.createDataFrame([(1, "english"), (2, "질문"), (3, "english")], "query_id long, query string")
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (3, 1, "b"), (3, 2, "a")], "query_id long, rank int, memory_id string")
    # english scores 0.2 everywhere, korean 0.1; query 3 has korean text first by fusion, but not by score
    scorer = lambda qs, ts: np.array([0.2 if t.startswith("e") else 0.1 for t in ts])
    got = sorted((r.query_id, r["rank"], r.memory_id) for r in recall.rerank(found, scorer, q, m, 2, c).collect())
    assert got == [(2, 1, "a"), (2, 2, "b")]


def test_transcripts(spark, tmp_path):
    a = tmp_path / "a" / "p"
    a.mkdir(parents=True)
    uid = "123e4567-e89b-12d3-a456-426614174000"
    lines = [{"type": "user", "cwd": "/w", "timestamp": "t0", "message": {"role": "user", "content": "first question"}}, {"type": "meta"}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "tool_use"}, {"type": "text", "text": "y"}]}}, {"type": "user", "message": {"role": "user", "content": "  "}}]
    (a / f"{uid}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n" + json.dumps({"type": "user", "message": {"role": "user", "content": "last"}}) + "\n")
    t = TR.read_agent_a(spark, str(tmp_path / "a"))
    rows = t.orderBy("turn").collect()
    assert [(r.turn, r.role, r.content) for r in rows] == [(0, "user", "first question"), (1, "assistant", "x\ny"), (2, "user", "last")] and rows[0].session_id == uid
    assert TR.read_agent(spark, str(tmp_path / "a"), "a").count() == 3 and TR.host_link(t, "a", uid).first().turn == 2 and TR.host_link(t, "b", uid).first().turn == 0
    assert TR.session_file(spark, str(tmp_path / "a"), "a", uid).endswith(f"{uid}.jsonl") and TR.session_file(spark, str(tmp_path / "a"), "b", uid) is None and TR.session_file(spark, str(tmp_path / "a"), "a", "x") is None
    out = tmp_path / "outside.jsonl"
    other = uid.replace("123e", "923e")
    out.write_text("{}")
    (a / f"{other}.jsonl").symlink_to(out)
    assert TR.session_file(spark, str(tmp_path / "a"), "a", other) is None
    (a / f"{other}.jsonl").unlink()
    assert TR.host_session({"S": uid}, {"a": "T", "b": "S"}) == ("b", uid) and TR.host_session({"S": "no"}, {"b": "S"}) is None
    assert TR.transcripts_open({"S": uid}, {"b": "S"}) and not TR.transcripts_open({"S": uid, "LODESTONE_TRANSCRIPT_ACCESS": "false"}, {"b": "S"})
    with pytest.raises(ValueError):
        TR.read_agent(spark, str(tmp_path), "zz")
    listed = TR.sessions(t, limit=5).first()
    assert (listed.n_turns, listed.last_turn, listed.preview, listed.cwd) == (3, 2, "first question", "/w")
    assert TR.load_session(t, uid).count() == 3 and TR.load_session(t, "nope").count() == 0
    b = tmp_path / "b"
    b.mkdir()
    meta = [{"type": "session_meta", "payload": {"id": uid, "cwd": "/v"}}] + [{"type": "response_item", "timestamp": "t", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": f"q{i}"}]}} for i in range(10)]
    (b / f"rollout-1-{uid}.jsonl").write_text("\n".join(map(json.dumps, meta)))
    u = TR.read_agent_b(spark, str(b))
    w = TR.window(u, spark.createDataFrame([(uid, 8)], "session_id string, center int"))
    assert sorted(r.content for r in w.collect()) == ["q6", "q7", "q8", "q9"]
    assert TR.active_session(TR.sessions(u), now=0.0, max_age=-1e12).count() == 0
    own = spark.createDataFrame([("s1", 0, "user", "hi", 1.0)], "session_id string, turn int, role string, content string, ts double")
    TR.append_turns(own, str(tmp_path / "own"))
    TR.append_turns(own.withColumn("turn", F.lit(1)), str(tmp_path / "own"))
    assert spark.read.json(str(tmp_path / "own")).count() == 2 and TR.next_turns(own).first().next_turn == 1


# ---------------------------------------------------------------- facade


def test_memory_facade(spark):
    c = C.Config(profile=C.Profile(0.95, 0.97, 0.9, 0.5, 0.5, 0.3, 0.9), allow_transcripts=False)
    g, out = Memory.empty(spark, NOW, config=c).remember(
        [{"content": "The staging database runs on port 5433", "keys": ["staging database", "ports"]}, {"content": "Deploys happen on Fridays at noon", "keys": ["deploys"]}, {"content": "nothing", "keys": []}]
    )
    assert out["errors"].count() == 1 and g.memory_stats() == {"keys": 3, "memories": 2, "links": 3}
    hit = g.recall(["staging database"]).where("rank = 1").first()
    assert hit.concept == "staging database" and hit.match_type == "concept"
    assert g.recall_explain(["zzzz qqqq"]).first().status in ("no_match", "found")
    found = g.recall_memories(["which port does the staging database use"]).orderBy("rank").first()
    row = g.memories.where(F.col("memory_id") == found.memory_id).first()
    assert "5433" in row.content
    read, after = g.read_memory(found.memory_id, via_key=hit.key_id)
    assert read.count() == 2 and after.links.where(F.col("key_id") == hit.key_id).first().weight == pytest.approx(1.1)
    assert after.memories.where(F.col("memory_id") == found.memory_id).first().depth == pytest.approx(0.05)
    assert found.matched_via and g.sentences.count() == 0
    long, more = g.remember([{"content": "The parrot is called Pico. It eats mango every day.", "keys": ["parrot"], "ttl": 500.0, "related_to": [found.memory_id, "zz"]}])
    bird = long.memories.where("content LIKE '%parrot%'").first()
    assert long.sentences.count() == 2 and bird.links == [found.memory_id] and more["duplicates"].count() == 0
    kept, _ = long.correct(bird.memory_id, "The parrot is called Rio. It eats mango every day.")
    rio = kept.memories.where("content LIKE '%Rio%'").first()
    assert rio.ttl == bird.ttl == NOW + 500 and rio.links == [found.memory_id] and kept.sentences.where(F.col("memory_id") == rio.memory_id).count() == 2
    with pytest.raises(KeyError, match="superseded"):
        kept.read_memory(bird.memory_id)
    found_by = g.indexed().recall_memories(["which port does the staging database use"]).orderBy("rank").first()
    assert found_by.memory_id == found.memory_id and found_by.score == pytest.approx(found.score)
    answered = g.recalled(["staging database"], spark.createDataFrame([(0, 1, found.memory_id)], "query_id long, rank int, memory_id string"))
    assert answered.memories.where(F.col("memory_id") == found.memory_id).first().access_count == 1 and answered.links.agg(F.max("weight")).first()[0] == pytest.approx(1.1)
    assert g.diagnose("staging database").where("what = 'memory'").count() == 2
    pushed = g.push(["which port does the staging database use", "/cmd"]).collect()
    assert all(r.query_id == 0 and r.line.startswith("- [") for r in pushed)
    learned = g.learn(spark.createDataFrame([(hit.key_id, found.memory_id, "stage db", x, float(i), i) for i, x in enumerate([0.92, 0.92, 0.92])], "key_id string, memory_id string, query string, cosine double, ts double, read_id int"))
    assert learned.memory_stats()["keys"] == 4 and learned.links.count() == 4
    fixed, note = g.correct(found.memory_id, "The staging database moved to port 6000 entirely")
    assert fixed.memory_stats()["memories"] == 2 and fixed.list_memories().where("content LIKE '%6000%'").count() == 1 and "staging database" in note.first().note
    left = fixed.forget([fixed.list_memories().where("content LIKE '%6000%'").first().memory_id])
    assert left.list_memories().where("content LIKE '%5433%'").count() == 1
    with pytest.raises(KeyError):
        g.read_memory("nope")
    with pytest.raises(PermissionError):
        g.list_sessions(None)


def _labelled(spark):
    """400 memories under 4 keys of which each has 100, some by two keys, and 6 queries of which each names a key."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(410, 8))
    m = spark.createDataFrame([(i, i, "n", float(NOW - i * 9e4), i % 7 / 7, None, None, v[i].tolist(), [i + 1] if i % 90 == 0 else [], []) for i in range(400)], "memory_id long, seq long, namespace string, created_at double, depth double, supersedes long, ttl double, embedding array<double>, links array<long>, contradicts array<long>")
    k = spark.createDataFrame([(i, i, f"topic {i}", [], "concept", v[400 + i].tolist()) for i in range(4)], "key_id long, seq long, concept string, aliases array<string>, key_type string, embedding array<double>")
    links = spark.createDataFrame([(i % 4, i, 1.0) for i in range(400)] + [((i + 1) % 4, i, 0.5) for i in range(0, 400, 8)], "key_id long, memory_id long, weight double")
    q = spark.createDataFrame([(i, v[404 + i].tolist(), f"what is it about topic {i % 4}" if i % 2 else None) for i in range(6)], "query_id long, embedding array<double>, query string")
    return m, k, links, q


def test_dense_evidence_of_memories_that_are_alike_is_kept_once(spark):
    m, k, links, q = _labelled(spark)
    c = C.Config(profile=C.PROFILES["testbed"])
    sims = similar(q, m, least=0.25, item_id="memory_id")
    d = recall.Dense(q, k, links, m, sims, c)
    whole = d.all()
    assert d.by_like.count() <= 6 * 8 and whole.count() > 600  # 8 sets of links, whatever number of memories
    want = {(r.query_id, r.memory_id, r.rank, round(r.score, 9), round(r.raw_sim, 9), tuple(sorted(r.via))) for r in recall._ranked(whole, 9).collect()}
    assert {(r.query_id, r.memory_id, r.rank, round(r.score, 9), round(r.raw_sim, 9), tuple(sorted(r.via))) for r in d.best(9).collect()} == want
    assert d.of(whole).join(whole.select("query_id", "memory_id", F.col("raw_sim").alias("x"), F.size("via").alias("n")), ["query_id", "memory_id"]).where("raw_sim = x and size(via) = n").count() == whole.count()


def test_two_hops_tell_the_first_of_those_that_are_alike(spark, monkeypatch):
    m, k, links, q = _labelled(spark)
    c = C.dataclasses.replace(C.Config(profile=C.dataclasses.replace(C.PROFILES["testbed"], gate_z=0.0)), dense_depth=3, bm25_depth=3)
    sparse = spark.createDataFrame([(a, (a * 37 + 11 * b) % 400, b) for a in range(6) for b in range(1, 4)], "query_id long, memory_id long, rank int")
    sizes, spread = [], recall.expand

    def expand(*args):
        out = spread(*args)
        sizes.append(out.count())
        return out

    def go(min_depth):
        rows = recall.hybrid_recall(q, k, links, m, NOW, sparse, top_k=5, hops=2, min_rel=0.01, min_depth=min_depth, config=c).collect()
        return {(r.query_id, r.rank, r.memory_id, round(r.score, 9), round(r.raw_sim, 9), r.hop, tuple(r.matched_via)) for r in rows}

    monkeypatch.setattr(recall, "expand", expand)
    few = [go(x) for x in (0.0, 0.6)]
    monkeypatch.setattr(recall, "first_alike", lambda members, n, order, own=recall.first_alike: own(members, 1 if n == 1 else 1000, order))
    assert few == [go(x) for x in (0.0, 0.6)] and len(few[0]) > 30
    assert max(sizes[:2]) < min(sizes[2:])


@pytest.mark.parametrize(("held", "at_once"), [(1 << 23, 1 << 20), (40, 7)])
def test_last_round_meets_links_in_blocks_of_queries(spark, monkeypatch, held, at_once):
    rng = np.random.default_rng(17)
    n = lambda x: int(rng.integers(0, x))
    m = spark.createDataFrame([(i, i, "n", float(NOW), 0.5, i - 1 if i % 9 == 5 else None, 1.0 if i % 11 == 0 else None, [n(150)] if i % 6 == 0 else []) for i in range(150)], "memory_id long, seq long, namespace string, created_at double, depth double, supersedes long, ttl double, links array<long>")
    k = spark.createDataFrame([(i, i, f"c{i}", "name" if i % 3 else "concept") for i in range(30)], "key_id long, seq long, concept string, key_type string")
    pairs = sorted({(n(30), n(130)) for _ in range(220)} | {(3, i) for i in range(0, 130, 3)})
    links = spark.createDataFrame([(a, b, 0.1 + n(29) / 10) for a, b in pairs], "key_id long, memory_id long, weight double").repartition(3)
    start = spark.createDataFrame([(q, q * 7 + j, 1.0 + j) for q in range(20) for j in range(1 + q % 2)] + [(50, 149, 1.0), (51, 0, 1.0)], "query_id long, memory_id long, score double")
    texts = lambda df, *ids: df.select(*(F.col(c).cast("string").alias(c) if c in ids else c for c in df.columns))
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    for hops, linked in ((2, None), (3, graph.explicit_pairs(m)), (3, None)):
        out = graph.expand(start, k, links, m, NOW, hops, pairs=linked)
        got = {(r.query_id, r.memory_id): (r.score, r.hop) for r in out.collect()}
        plain = graph.expand(texts(start, "query_id"), k, links, m, NOW, hops, pairs=linked)  # pairs of other ids are exchanged
        want = {(int(r.query_id), r.memory_id): (r.score, r.hop) for r in plain.collect()}
        assert out.count() == len(got) == len(want) > 200 and {x: h for x, (_, h) in got.items()} == {x: h for x, (_, h) in want.items()}
        assert all(abs(got[x][0] - want[x][0]) < 1e-9 for x in want)
        top = out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert "Aggregate" not in top and "Join" not in top and [c for c in plain._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in c]


def test_related_memories_of_hubs_travel_in_packs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PACK", 4)
    m, k, links, _ = _labelled(spark)
    seeds = m.where("memory_id % 50 < 2").select(F.col("memory_id").alias("seed_id"))
    out = graph.related(seeds, k, links, m, NOW, C.Config(related_limit=30))
    got = {(r.seed_id, r.memory_id, round(r.score, 9), r.n_shared, r.link_type, r.rank) for r in out.collect()}
    own: dict[int, set[int]] = {}
    for r in links.collect():
        own.setdefault(r.memory_id, set()).add(r.key_id)
    n = {x: sum(x in o for o in own.values()) for x in range(4)}
    told = {(i, i + 1) for i in range(400) if i % 90 == 0}
    want = set()
    for s in (i for i in range(400) if i % 50 < 2):
        rows = []
        for i in range(400):
            met, linked = own[s] & own[i], (s, i) in told or (i, s) in told
            if i != s and (met or linked):
                rows.append((-round(sum(1 / n[x] for x in met) + linked + 1e-10, 6), i, round(sum(1 / n[x] for x in met) + linked, 9), len(met), "key" if not linked else "both" if met else "explicit"))
        want |= {(s, i, score, c, kind, at + 1) for at, (_, i, score, c, kind) in enumerate(sorted(rows)[:30])}
    assert got == want
    assert not re.search(r"hashpartitioning\(seed_id#\d+L?, memory_id", out._jdf.queryExecution().toString())  # pairs are not dealt anew


def test_what_judges_a_pair_rides_along_with_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"l{i % 3}" if i % 7 else None, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 4)))]
    e = spark.createDataFrame(rows, "id long, label string, embedding array<float>").select(F.struct("id", "label").alias("x"), "embedding")
    for block in (4096, 10):  # sent to the workers, and joined as a table
        got = similar(e, e.withColumnRenamed("x", "y"), 0.5, "x", "y", block=block).collect()
        plain = similar(e.select(F.col("x.id").alias("x"), "embedding"), e.select(F.col("x.id").alias("y"), "embedding"), 0.5, "x", "y").collect()
        assert len(got) == len(plain) > 60 and {(r.x.id, r.y.id) for r in got} == {(r.x, r.y) for r in plain}
        assert all(v.label == rows[v.id][1] for r in got for v in (r.x, r.y))


@pytest.mark.parametrize("name", ["calibration_prf", "threshold_sweep", "prior_weighted_fp", "all_pairs_over_threshold"])
def test_similar_pairs_meet_no_join(spark, name):
    from lodestone.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0]


def test_contents_of_keys_are_judged_where_they_are_found(spark, monkeypatch):
    m, k, links, q = _labelled(spark)
    sims = similar(q, m, least=-1.0, item_id="memory_id")
    q = q.drop("query")
    told, best = [], keys._best_content
    monkeypatch.setattr(keys, "_best_content", lambda rows: (told.append(rows), best(rows))[1])
    got, want = (keys._candidates(q, k, links, m, NOW, None, x, C.Config(), -1.0).select("query_id", "key_id", "content_sim", "content_id").collect() for x in (None, sims))
    key = lambda rows: {(r.query_id, r.key_id): (round(r.content_sim, 9), r.content_id) for r in rows}
    assert key(got) == key(want) and len(got) == 24
    assert ["Join" in x._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0] for x in told] == [False, True]


def test_right_chunks_are_fewer_the_more_left_ones_there_are(spark, monkeypatch):
    from lodestone.functions import similarity

    plans, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None, *a, **k: (plans.append((rows, schema)), make(self, rows, schema, *a, **k))[1])
    e = make(spark, [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(2).normal(size=(200, 6)))], "x long, embedding array<double>")
    for size, n, m in ((24 * 200, 2, 16), (24 * 20, 10, 8), (0, 50, 4)):
        monkeypatch.setattr(similarity, "CHUNK_BYTES", size)
        pairs = join_similar(e, e.withColumnRenamed("x", "y"), 0.5, "x", "y", cells=1, chunk_rows=4)
        assert [(r["n"], r["m"]) for rows, schema in plans if schema == "cell int, n int, m int" for r in rows][-1] == (n, m)
        assert pairs.count() == similar(e, e.withColumnRenamed("x", "y"), 0.5, "x", "y").count()


def test_contradictions_judge_pairs_where_they_are_found(spark):
    m = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.9, 0.44]), ("c", 2, [0.9, 0.44]), ("d", 3, [0.0, 1.0]), ("e", 4, [0.9, 0.44])], "memory_id string, seq long, embedding array<double>")
    links = spark.createDataFrame([("k", "a"), ("l", "a"), ("k", "b"), ("l", "b"), ("n", "c"), ("k", "d")], "key_id string, memory_id string")
    c = C.Config(profile=C.dataclasses.replace(C.PROFILES["bgem3"], contradiction=0.8, memory_dedup=0.94))
    found = write.contradictions(m, links, config=c, by_keys=False)
    assert [(r.a, r.b) for r in found.collect()] == [("a", "b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not {"Join", "Aggregate"} & set(re.findall(r"\b(?:Join|Aggregate)\b", plan.split("MapInArrow")[0]))


@pytest.mark.parametrize("scope", ["global", "namespace"])
def test_best_duplicate_sends_one_row_a_memory(spark, scope):
    rows = [("a", 3, "x", [1.0, 0.0]), ("b", 2, "y", [1.0, 0.0]), ("c", 1, "x", [1.0, 0.01]), ("d", 0, "x", [0.0, 1.0]), ("e", 4, None, [1.0, 0.0]), ("f", 5, None, [1.0, 0.2])]
    m = spark.createDataFrame(rows, "memory_id string, seq long, namespace string, embedding array<double>")
    c = C.Config(profile=C.dataclasses.replace(C.PROFILES["bgem3"], memory_dedup=0.9), dedup_scope=scope)
    best = write.best_duplicate(m, m, c)
    want = {"global": {"a": "b", "b": "a", "c": "b", "e": "b", "f": "c"}, "namespace": {"a": "c", "c": "a", "e": "f", "f": "e"}}[scope]
    assert {r.memory_id: r.duplicate_id for r in best.collect()} == want
    plan = best._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Join" not in plan and "Window" not in plan and "Aggregate" in plan


def test_joins_by_memory_keep_to_all_partitions(spark):

    k = spark.createDataFrame([(i, f"c{i}", i) for i in range(5)], "key_id long, concept string, seq long")
    l = spark.range(200).select((F.col("id") % 5).alias("key_id"), (F.col("id") % 50).alias("memory_id"), F.lit(1.0).alias("weight")).distinct()
    m = spark.range(50).select(F.col("id").alias("memory_id"), F.col("id").alias("seq"), *(F.array().cast("array<bigint>").alias(c) for c in ("links", "contradicts")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = keys.memory_keys(m.where("memory_id < 40"), k, l)
        left = maintain.forget(m.where("memory_id >= 40"), k, l, m)["links"]
        for found in (left, rows.select("memory_id", "rank")):
            assert found.rdd.getNumPartitions() == 4
        assert rows.count() == left.count() == l.where("memory_id < 40").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
