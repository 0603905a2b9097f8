"""Promotion inside a stream: as over the whole log, after a restart, with late events."""

import random

from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.operators import maintain
from lodestone.schema import KEYS, conform
from lodestone.streaming import stateful
from lodestone.streaming.stateful import promote_stream

EVENTS = "key_id string, kind string, ts timestamp, id long, query string, cosine double"


def test_a_stream_promotes_as_the_whole_log_does(spark, tmp_path):
    rng = random.Random(11)
    c = C.Config(promote_n=2, max_aliases=2, buffer_size=4)
    names = ["pg", "Pg", "dbms", "store", "DB", "a question that is long", "x", " tables "]
    data = []
    for i in range(900):
        read = rng.random() < 0.45
        data.append((f"k{rng.randrange(12)}", "read" if read else "query", 1e6 + i * 3.0, i, None if read else rng.choice(names), None if read else rng.choice([0.2, 0.5, 0.7, 0.9])))
    known = conform(spark.createDataFrame([(f"k{i}", "database", ["db"], [("old", 0.0, 0)] if i % 3 == 0 else None, {"store": (1, 0.0, "store")} if i % 4 == 0 else None) for i in range(11)], "key_id string, concept string, aliases array<string>, learned_aliases array<struct<alias:string,added_at:double,hits:int>>, alias_candidates map<string,struct<count:int,last_seen:double,query_text:string>>"), KEYS)
    log = spark.createDataFrame(data, EVENTS.replace("timestamp", "double"))
    hits = maintain.match_buffer(log.where("kind = 'query'"), log.where("kind = 'read'"), ["key_id"], 200.0, c)
    confirmed = hits.join(log.select(F.col("id").alias("query_id"), "query", "cosine"), "query_id").withColumn("memory_id", F.lit("m"))
    learned = maintain.learn_aliases(confirmed, known, c).where("decision <> 'none'")
    want = sorted((r.key_id, r.query, r.n_confirmed, r.decision) for r in learned.collect())
    assert len(want) > 20 and {d for *_, d in want} == {"alias", "newKey"}

    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, EVENTS.replace("timestamp", "double")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(src)

    def go():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
        rows = promote_stream(stream, known, ttl=200.0, config=c, watermark="10 minutes")
        rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()

    put(data[:300])
    put(data[300:500])
    go()
    put(data[500:])
    put([(f"k{i}", kind, 5e5 + i, 2000 + 2 * i + n, "late" if kind == "query" else None, 0.9) for i in range(11) for n, kind in enumerate(["query", "read", "query", "read"])])  # long past the watermark
    go()  # from the state that is kept
    got = sorted((r.key_id, r.query, r.n_confirmed, r.decision) for r in spark.read.parquet(out).collect())
    assert got == want


def test_weights_of_many_links_are_folded_group_by_group(spark, tmp_path):
    rng = random.Random(5)
    c = C.Config()
    data = [(f"u{rng.randrange(40)}", rng.choice([None, 2**60 + rng.randrange(5)]), i, rng.choice([0.5, 0.9, -0.7])) for i in range(2000)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user string, k long, seq long, delta double"
    for part in (data[:700], data[700:1200], data[1200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    calls = []

    def go(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        calls.append(n)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = stateful.fold_stream(stream, ["user", "k"], c, groups=3)
    query = rows.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(go).start()
    query.awaitTermination()
    kept = sum(p["numRowsTotal"] for p in query.lastProgress["stateOperators"])
    assert len(calls) == 3 and kept == 3  # a state for each group, not for each link
    want: dict[tuple, tuple[int, float]] = {}
    for user, k, _, delta in data:
        n, w = want.get((user, k), (0, c.weight_default))
        want[user, k] = n + 1, min(c.weight_max, max(c.weight_min, w + delta))
    last: dict[tuple, tuple[int, float]] = {}
    for r in spark.read.parquet(out).collect():
        last[r.user, r.k] = max(last.get((r.user, r.k), (0, 0.0)), (r.n_events, r.weight))
    assert last.keys() == want.keys() and len(want) > 200
    assert all(last[x][0] == want[x][0] and abs(last[x][1] - want[x][1]) < 1e-9 for x in want)
