"""The operation log: merged tables, batches of streams, reads that learn."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.api import Memory
from lodestone.operators import keys, oplog, write
from lodestone.schema import KEYS, LINKS, MEMORIES, conform
from lodestone.sources.store import Store
from lodestone.streaming.reinforce import log_stream

NOW = 1_000_000.0


def graph(spark):
    k = conform(spark.createDataFrame([("k", "database", ["db"], "concept", 0), ("z", "other", None, "concept", 1)], "key_id string, concept string, aliases array<string>, key_type string, seq long"), KEYS)
    m = conform(spark.createDataFrame([("m", "text", 1.0, 0), ("n", "more", 1.0, 1)], "memory_id string, content string, created_at double, seq long"), MEMORIES)
    return {"keys": k, "memories": m, "links": spark.createDataFrame([("k", "m", 1.0), ("z", "n", 2.9)], LINKS)}


def rows(spark, data):
    return spark.createDataFrame(data, oplog.LOG)


def link(seq, delta, k="k", m="m"):
    return ("link", k, m, None, seq, delta, None)


def test_a_log_merges_as_row_by_row(spark):
    rng = random.Random(5)
    data = [link(i, rng.choice([0.7, -0.9, 0.1]), *rng.choice([("k", "m"), ("z", "n")])) for i in range(300)]
    want = {("k", "m"): 1.0, ("z", "n"): 2.9}
    for _, k, m, _, _, d, _ in data:
        want[k, m] = min(3.0, max(0.1, want[k, m] + d))
    data += [("read", None, "m", None, None, None, float(t)) for t in (5, 9, 7)] + [("read", None, "gone", None, None, None, 1.0), link(400, 1.0, "k", "gone")]
    data += [("learned", "k", None, a, None, None, t) for a, t in (("Pg", 3.0), ("pg", 4.0), ("DB", 1.0), ("store", 2.0), ("Database", 1.0))] + [("learned", "k", None, None, None, None, 1.0)]
    data += [("use", "k", None, a, None, None, None) for a in ("PG", "pg", "db", "nothing")]
    rng.shuffle(data)
    out = oplog.merged(rows(spark, data), graph(spark))
    assert {(r.key_id, r.memory_id): pytest.approx(r.weight) for r in out["links"].collect()} == want
    m = {r.memory_id: r for r in out["memories"].collect()}
    assert (m["m"].access_count, m["m"].last_accessed, m["n"].access_count, len(m)) == (3, 9.0, 0, 2) and m["m"].depth == pytest.approx(0.15)
    k = {r.key_id: r for r in out["keys"].collect()}
    assert k["k"].aliases == ["db", "store", "Pg"] and {a.alias: a.hits for a in k["k"].learned_aliases} == {"store": 0, "Pg": 2} and k["z"].concept == "other" and not k["z"].learned_aliases
    same = oplog.merged(rows(spark, []), graph(spark))
    assert sorted(map(tuple, same["links"].collect())) == [("k", "m", 1.0), ("z", "n", 2.9)]


def test_batches_count_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.save(graph(spark))
    weight = lambda: s.load()["links"].where("key_id = 'k'").first().weight
    assert s.append_log(rows(spark, [link(1, 0.2)]), "st", 0) and weight() == pytest.approx(1.2)
    assert s.append_log(rows(spark, [link(1, 0.2)]), "st", 0) and weight() == pytest.approx(1.2)  # written again
    (tmp_path / "s" / f"log-{s.current()['version']}" / "stream-st" / "batch-0" / "_SUCCESS").unlink()
    assert weight() == 1.0  # cut off
    s.append_log(rows(spark, [link(1, 0.2)]), "st", 0)
    s.append_log(spark.createDataFrame([("k", "m", 2, 0.1)], "key_id string, memory_id string, seq long, delta double"))
    s.compact()
    assert s.current()["streams"] == {"st": 0} and weight() == pytest.approx(1.3) and s.compact() is None
    assert not s.append_log(rows(spark, [link(1, 0.2)]), "st", 0) and weight() == pytest.approx(1.3)
    t = s.load()
    Store(spark, s.path).append_log(rows(spark, [link(3, 0.5)]), "st", 1)  # between load and save
    s.save(t)
    assert weight() == pytest.approx(1.8) and s.current()["streams"] == {"st": 0}
    with pytest.raises(ValueError):
        s.append_log(rows(spark, []), "a/b", 0)


def test_a_stream_that_starts_again_leaves_the_same_store(spark, tmp_path):
    src, state = tmp_path / "in", str(tmp_path / "state")
    s = Store(spark, str(tmp_path / "s"))
    s.save(graph(spark))
    for i in range(4):
        rows(spark, [link(2 * i, 0.3), link(2 * i + 1, -0.1), ("read", None, "m", None, None, None, float(i))]).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(oplog.LOG).option("maxFilesPerTrigger", 1).parquet(str(src))
    calls = []
    whole = Store.append_log

    class Breaking(Store):
        def append_log(self, events, stream=None, batch=None, own=False):
            done = whole(self, events, stream, batch, own)
            calls.append(batch)
            if calls == [0, 1, 2]:
                raise RuntimeError("lost after the batch was written")
            return done

    b = Breaking(spark, s.path)
    with pytest.raises(Exception, match="lost"):
        log_stream(stream, b, "reads", state, compact_every=2, once=True).awaitTermination()
    log_stream(stream, b, "reads", state, compact_every=2, once=True).awaitTermination()
    assert calls == [0, 1, 2, 2, 3] and s.current()["streams"] == {"reads": 3}
    t = s.load()
    assert t["links"].where("key_id = 'k'").first().weight == pytest.approx(1.8) and t["memories"].where("memory_id = 'm'").first().access_count == 4


def test_reads_take_their_question_and_teach(spark, tmp_path):
    c = C.Config(profile=C.Profile(0.86, 0.97, 0.8, 0.75, 0.95, 0.3, 0.9), promote_n=2, confirm_floor=0.3)
    g, out = Memory.empty(spark, NOW, config=c).remember([{"content": "port 5433 it is", "keys": ["staging database"]}, {"content": "noon on Fridays", "keys": ["staging data", "deploys every single week"]}])
    near = {(r.your_key, r.existing_concept) for r in out["near_keys"].collect()}
    assert near == {("staging database", "staging data"), ("staging data", "staging database")} and out["hints"].count() >= 1
    key = g.keys.where("concept = 'staging database'").first().key_id
    mem = g.memories.where("content LIKE 'port%'").first().memory_id
    s = Store(spark, str(tmp_path / "s"), c)
    g = g.flush(s)
    version = s.current()["version"]
    asked = g.noted(["stage data"])
    assert {(r.concept, r.cosine >= 0.75) for r in asked.asked.join(g.keys.select("key_id", "concept"), "key_id").collect()} == {("staging database", False), ("staging data", True)}  # below the gate, and let in
    _, once = asked.read_memory(mem, key)
    assert once.asked.where(F.col("key_id") == key).count() == 0 and dict(once.keys.where(F.col("key_id") == key).first().alias_candidates)["stage data"]["count"] == 1
    _, again = once.read_memory(mem, key)  # the question is taken
    assert dict(again.keys.where(F.col("key_id") == key).first().alias_candidates)["stage data"]["count"] == 1
    late = dataclasses.replace(again.noted(["stage data"]), now=NOW + 301)
    assert late.read_memory(mem, key)[1].asked.where(F.col("key_id") == key).count() == 1
    _, taught = again.noted(["stage data"]).read_memory(mem, key)
    assert taught.keys.where(F.col("key_id") == key).first().aliases == ["stage data"]
    used = taught.flush(s).noted(["the stage data server", "stage data"])
    assert s.current()["version"] != version and used.keys.where(F.col("key_id") == key).first().learned_aliases[0].hits == 2
    version = s.current()["version"]
    _, last = used.read_memory(mem)
    last = last.flush(s)
    assert s.current()["version"] == version and last.changes == ()  # reads alone add to the log
    t = s.load()
    assert t["keys"].where(F.col("key_id") == key).first().learned_aliases[0].hits == 2
    pick = lambda df: sorted((r.memory_id, r.access_count, round(r.depth, 6)) for r in df.collect())
    assert pick(t["memories"]) == pick(last.memories) and sorted((r.key_id, round(r.weight, 6)) for r in t["links"].collect()) == sorted((r.key_id, round(r.weight, 6)) for r in last.links.collect())


def test_alias_uses_take_the_first_alias(spark):
    k = spark.createDataFrame([("k", "database", ["pg store", "pg"], 0), ("z", "pg", None, 1), ("e", "x", [], 2)], "key_id string, concept string, aliases array<string>, seq long")
    q = spark.createDataFrame([(1, "the pg store and database"), (2, "pg"), (3, None), (4, "")], "query_id long, query string")
    assert {(r.query_id, r.key_id, r.alias) for r in keys.alias_uses(q, k).collect()} == {(1, "k", "pg store"), (2, "k", "pg")}


def test_near_hints_skip_own_keys_and_entities(spark):
    k = conform(spark.createDataFrame([("a", "Alpha", "concept", [1.0, 0.0], 0), ("b", "beta", "concept", [0.8, 0.6], 1), ("c", "gamma", "name", [0.8, 0.6], 2), ("d", "delta", "concept", [0.8, 0.6], 3)], "key_id string, concept string, key_type string, embedding array<float>, seq long"), KEYS)
    links = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 1.0), ("b", "n", 1.0)], LINKS)
    new = spark.createDataFrame([("m", ["alpha", "alpha", "nothing"]), ("n", ["ALPHA"]), ("o", [])], "memory_id string, keys array<string>")
    got = sorted((r.memory_id, r.your_key, r.key_id, r.similarity) for r in write.near_hints(new, links, k).collect())
    assert got == [("m", "Alpha", "b", 0.8), ("n", "Alpha", "d", 0.8)]
