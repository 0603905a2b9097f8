"""The pipeline keeps clean documents and catches planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestone.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    rows, labels, plan = [], [], {}

    def add(text, kind, good=1):
        i = len(rows)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, good, 0))
        plan[i] = kind
        return i

    for _ in range(300):
        add(prose(rng.randint(40, 300)), "clean")
    for _ in range(80):
        add(" ".join(rng.choice(vocabulary).upper() + rng.choice(["!!", "%%%", "***"]) for _ in range(rng.randint(30, 200))), "junk", 0)
    base = [prose(200) for _ in range(10)]
    for t in base:
        add(t, "clean")
        add(t, "copy")
        w = t.split(" ")
        w[50] = "changed"
        add(" ".join(w), "copy")
    item = [prose(30) for _ in range(10)]
    for t in item:
        add(prose(80) + " " + t + " " + prose(40), "leak")
    passage = prose(70)
    add(prose(60) + " " + passage + " " + prose(60), "clean")
    for _ in range(5):
        add(prose(60) + " " + passage + " " + prose(60), "repeat")
    rows.append((None, None, None, None, None))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, plan, passage


def test_stages(spark, corpus):
    d, plan, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None}
    of = lambda *kinds: {i for i, k in plan.items() if k in kinds}
    stages = dict(P.STAGES)
    from lodestone.llm.common import materialize

    docs = materialize(stages["quality"](spark, docs, d))
    assert docs.columns == P.COLUMNS
    kept = ids(docs)
    assert len(of("junk") & kept) <= 2 and len(of("clean", "copy", "leak", "repeat") - kept) <= 6
    docs = materialize(stages["near_dedup"](spark, docs, d))
    assert not of("copy") & ids(docs) or len(of("copy") & ids(docs)) <= 2
    assert kept - ids(docs) <= of("copy")
    docs = materialize(stages["substring_dedup"](spark, docs, d))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sum(passage in t for t in texts.values() if t) <= 1
    docs = materialize(stages["decontaminate"](spark, docs, d))
    assert not of("leak") & ids(docs) and (set(texts) - {None}) - ids(docs) == of("leak") & set(texts)
    out = stages["mix"](spark, docs, d)
    assert ids(out) == ids(docs) and {"taken", "copies", "target"} <= set(out.columns)


def test_run_is_all_stages(spark, corpus):
    d, plan, _ = corpus
    out = P.run(spark, d)
    assert out.count() > 200 and not {r.doc_id for r in out.collect()} & {i for i, k in plan.items() if k == "leak"}


def test_run_gives_the_mixed_corpus(spark, corpus):
    d, _, _ = corpus
    rows = P.run(spark, d).collect()
    assert min(r.copies for r in rows) > 0 and all(r.text and len(r.text.split()) == r.size for r in rows)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, long texts, shared ids, repeated rows and further columns with names that operators use."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    one, long, late = prose(120), prose(30_000), prose(90)
    rows = [(1, one, "en", "a", 1), (2, one, "en", "a", 1), (2, late, "en", "a", 1), (3, long, "en", "b", 1), (3, long, "en", "b", 1), (4, None, None, None, None), (5, "", "en", "b", 0), (None, prose(80), None, None, None), (None, one, "en", "a", 1)]
    rows += [(10 + i, prose(60), "en", "a", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("id", "key", "tag", "row", "_row0", "_hits0", "mark", "spans", "score", "size", "_source", "u"):
        docs = docs.withColumn(c, F.lit("clash"))
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(20)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = None
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        if name != "mix":
            assert out.columns == P.COLUMNS
            docs = out.withColumn("key", F.lit("clash")).withColumn("u", F.lit("clash"))
        got = sorted((str(r.doc_id), r.text) for r in out.select("doc_id", "text").collect() if r.text)
        if name == "near_dedup":
            assert [t for i, t in got if i == "2"] == [late] and [t for i, t in got if i == "3"] == [long] and sum(t == one for _, t in got) == 1
    assert len(got) == 24


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())
