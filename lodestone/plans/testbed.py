"""The test tables seen as memory graphs, in Spark and in SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILES, Config

#: The clock of all tests: 2001-08-01 00:00 UTC.
NOW = 996624000.0
CONFIG = Config(profile=PROFILES["testbed"])
#: Buffered queries of the test log stay for six hours.
TTL = 6 * 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Epoch seconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})") / 1e6


@dataclasses.dataclass
class Graph:
    keys: DataFrame
    links: DataFrame
    memories: DataFrame


def catalog(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders as memories, parts as keys, line items as links."""
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<bigint>")
    memories = o.select(
        F.col("o_orderkey").alias("memory_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("namespace"), seconds("o_orderdate").alias("created_at"), ((F.col("o_orderkey") % 21) * 0.05).alias("depth"),
        F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderkey") - 1).alias("supersedes"), F.when(F.col("o_orderkey") % 17 == 0, seconds("o_orderdate") + 30 * 86400).alias("ttl"), none.alias("links"), none.alias("contradicts"), F.col("o_totalprice").alias("price"),
    )
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 10 == 0, "name").when(F.col("p_size") % 10 == 1, "proper_noun").otherwise("concept")
    keys = p.select(F.col("p_partkey").alias("key_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("concept"), F.array().cast("array<string>").alias("aliases"), kind.alias("key_type"))
    weight = F.greatest(F.lit(0.1), F.least(F.lit(3.0), F.sum("l_quantity") / 25))
    links = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key_id"), F.col("l_orderkey").alias("memory_id")).agg(weight.alias("weight"))
    return Graph(keys, links, memories)


CATALOG = f"""
m AS (SELECT o_orderkey AS memory_id, o_orderkey AS seq, o_orderstatus AS namespace, epoch(o_orderdate) AS created_at, (o_orderkey % 21) * CAST(0.05 AS DOUBLE) AS depth,
  CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey - 1 END AS supersedes, CASE WHEN o_orderkey % 17 = 0 THEN epoch(o_orderdate) + 30 * 86400 END AS ttl, o_totalprice AS price FROM orders),
k AS (SELECT p_partkey AS key_id, p_partkey AS seq, p_name AS concept, CASE p_size % 10 WHEN 0 THEN 'name' WHEN 1 THEN 'proper_noun' ELSE 'concept' END AS key_type FROM part),
l AS (SELECT l_partkey AS key_id, l_orderkey AS memory_id, greatest(CAST(0.1 AS DOUBLE), least(CAST(3.0 AS DOUBLE), sum(l_quantity) / 25)) AS weight FROM lineitem GROUP BY 1, 2),
a AS (SELECT * FROM m WHERE NOT (ttl IS NOT NULL AND {NOW} > ttl) AND memory_id NOT IN (SELECT supersedes FROM m WHERE supersedes IS NOT NULL)),
idf AS (SELECT k.key_id AS key_id, count(l.key_id) AS n_links, (CASE WHEN count(l.key_id) <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / count(l.key_id) END) * (CASE WHEN key_type IN ('name', 'proper_noun') THEN 0.5 ELSE 1 END) AS idf
  FROM k LEFT JOIN l ON k.key_id = l.key_id GROUP BY k.key_id, key_type),
tops AS (SELECT memory_id FROM m WHERE memory_id % 50 = 0)
"""


def seeds(g: Graph) -> DataFrame:
    """(query_id, memory_id): the stated query set, every order whose key is divisible by 50."""
    return g.memories.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "memory_id")


def vectors(spark: SparkSession, sf_dir: str) -> Graph:
    """Vectors as memories, each label's first vector as a key, membership as links."""
    e = table(spark, sf_dir, "embeddings")
    none = F.array().cast("array<bigint>")
    memories = e.select(
        F.col("vec_id").alias("memory_id"), F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("namespace"), (F.lit(NOW) - F.col("vec_id") * 86400.0).alias("created_at"), ((F.col("vec_id") % 21) * 0.05).alias("depth"),
        F.lit(None).cast("bigint").alias("supersedes"), F.lit(None).cast("double").alias("ttl"), "embedding", "label", none.alias("links"), none.alias("contradicts"),
    )
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("f"))
    keys = first.select(F.col("f.vec_id").alias("key_id"), F.col("f.vec_id").alias("seq"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("concept"), F.array().cast("array<string>").alias("aliases"), F.lit("concept").alias("key_type"), F.col("f.embedding").alias("embedding"), "label")
    links = e.select("vec_id", "label").join(keys.select("key_id", "label"), "label").select("key_id", F.col("vec_id").alias("memory_id"), F.lit(1.0).alias("weight"))
    return Graph(keys, links, memories)


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, embedding): the stated query set, every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


VECTORS = f"""
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ke AS (SELECT min(vec_id) AS key_id, label, arg_min(e, vec_id) AS e FROM v GROUP BY label),
vm AS (SELECT vec_id AS memory_id, label, e, {NOW} - vec_id * 86400.0 AS created_at, (vec_id % 21) * CAST(0.05 AS DOUBLE) AS depth FROM v),
q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 50 = 0),
qm AS (SELECT query_id, vec_id AS memory_id, label, list_cosine_similarity(q.e, v.e) AS sim FROM q, v),
qk AS (SELECT query_id, key_id, label, list_cosine_similarity(q.e, ke.e) AS sim FROM q, ke),
km AS (SELECT key_id, vec_id AS memory_id FROM v JOIN ke USING (label))
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.col("doc_id").alias("seq"), F.col("source").alias("namespace"), F.col("text").alias("content"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, event_type, ts, k) of events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", seconds("ts").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"))


LOG = "ev AS (SELECT event_id AS id, user_id, event_type, epoch(ts) AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
