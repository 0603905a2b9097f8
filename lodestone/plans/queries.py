"""Queries of the retrieval operators over the test tables, each with its DuckDB oracle.

Doubles leave both engines as round(x + 1e-10, 6), see functions.scoring.r6.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROFILES
from ..functions import text as T
from ..functions.scoring import depth_factor, r6, time_factor
from ..functions.similarity import join_similar, similar
from ..functions.vector import max_sim
from ..operators import bm25, evaluate, graph, keys, maintain, oplog, recall, write
from ..operators.durable import shared_dir, spread
from ..operators.robust import robust_spread
from ..schema import KEYS, LINKS, MEMORIES, conform, prune_keys, prune_links
from ..sources import transcripts
from ..sources.store import Store
from ..streaming import stateful
from ..streaming.reinforce import log_stream
from .testbed import CATALOG, CONFIG, LOG, NOW, TTL, VECTORS, catalog, documents, log, seeds, table, text_queries, turns, vector_queries, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r(x: str, digits: int = 6) -> str:
    return f"round({x} + 1e-{digits + 4}, {digits})"


TIME = f"(0.5 + 0.5 * exp(-greatest(0, {NOW} - created_at) * (1 - 0.7 * depth) / 2592000.0))"
DEPTH = "(0.9 + 0.1 * depth)"

# The idle words that coverage leaves out.
_IDLE = "내 나의 뭐 뭐야 뭔가 무슨 어느 있어 있니 알려 알려줘 해줘 좋아해 좋아하는 선호하는 쓰니 했어 관련 대한 what which who where when why how is are was were do does did my me tell about the a an please"


def _covers(query: str, hay: str) -> str:
    """SQL: over half of a query's words, of two characters or more and not idle, stand in the text."""
    w = f"list_filter(regexp_extract_all(lower({query}), '[\\p{{L}}\\p{{N}}_.+#-]+'), lambda x: length(x) >= 2 AND NOT list_contains(string_split('{_IDLE}', ' '), x))"
    return f"(len(list_filter({w}, lambda x: contains(lower({hay}), x))) * 2 > len({w}))"


def _structured(text: str) -> str:
    """SQL: the structured tokens of a text, in order, distinct. Without look-around: every separator is followed
    by a mark, so that what ends one token leaves the mark before the next."""
    marked = f"regexp_replace(lower({text}), '([^\\p{{L}}\\p{{N}}])', '\\1' || chr(1), 'g')"
    version = "(?:v?[0-9]+\\.\\x01)+[0-9]+(?:[-+]\\x01(?:[\\p{L}\\p{N}]|[.-]\\x01)+)?"
    found = f"regexp_extract_all({marked}, '(?:^|\\x01)({version}|#\\x01[0-9]+|[a-f0-9]{{7,40}})(?:[^\\p{{L}}\\p{{N}}\\x01]|$)', 1)"
    clean = f"list_transform({found}, lambda x: replace(x, chr(1), ''))"
    return f"list_filter({clean}, lambda x, i: list_position({clean}, x) = i)"


# ------------------------------------------------------------------ graph


@query(f"WITH {CATALOG} SELECT memory_id, namespace FROM a")
def active_memories(spark, d):
    return graph.active(catalog(spark, d).memories, NOW).select("memory_id", "namespace")


@query(f"WITH {CATALOG} SELECT memory_id, created_at, {r('depth')} AS depth, supersedes FROM a WHERE namespace = 'F'")
def list_memories(spark, d):
    return graph.active(catalog(spark, d).memories, NOW, "F").select("memory_id", "created_at", r6(F.col("depth")).alias("depth"), "supersedes")


@query(f"WITH {CATALOG} SELECT (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM a) AS n_memories, (SELECT count(*) FROM l) AS n_links")
def memory_stats(spark, d):
    g = catalog(spark, d)
    counts = [x.agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for w, x in (("k", g.keys), ("m", graph.active(g.memories, NOW)), ("l", g.links))]
    rows = counts[0].union(counts[1]).union(counts[2])
    return rows.agg(*(F.sum(F.when(F.col("what") == w, F.col("n"))).alias(c) for w, c in (("k", "n_keys"), ("m", "n_memories"), ("l", "n_links"))))


@query(f"WITH {CATALOG} SELECT namespace, count(*) AS n FROM a WHERE namespace = 'O' GROUP BY 1")
def namespace_filter(spark, d):
    return graph.active(catalog(spark, d).memories, NOW, "O").groupBy("namespace").agg(F.count("*").alias("n"))


_COUNTS = "c AS (SELECT key_id, count(*) AS n_memories, count(*) >= 3 AS is_hub, floor(1000.0 / count(*) + 0.5) / 1000 AS specificity FROM l SEMI JOIN a USING (memory_id) GROUP BY 1)"


@query(f"WITH {CATALOG}, {_COUNTS} SELECT key_id, n_memories, is_hub, CAST(specificity AS DOUBLE) AS specificity FROM c")
def key_memory_counts_hubs(spark, d):
    g = catalog(spark, d)
    return graph.key_counts(g.links, graph.active(g.memories, NOW))


@query(f"WITH {CATALOG} SELECT key_id, n_links, {r('idf', 9)} AS idf FROM idf")
def key_idf(spark, d):
    g = catalog(spark, d)
    return graph.key_idf(g.keys, g.links).withColumn("idf", r6(F.col("idf"), 9))


@query(f"WITH {CATALOG}, {_COUNTS} SELECT key_id, concept, n_memories, is_hub FROM k JOIN c USING (key_id) ORDER BY is_hub DESC, n_memories DESC, concept, key_id LIMIT 20 OFFSET 20")
def browse_keys_page(spark, d):
    g = catalog(spark, d)
    return keys.browse_keys(g.keys, g.links, g.memories, NOW, limit=20, offset=20).select("key_id", "concept", "n_memories", "is_hub")


@query(f"""WITH {CATALOG}, s AS (SELECT key_id, memory_id, created_at, weight * {DEPTH} * {TIME} AS score FROM l JOIN a USING (memory_id)),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY key_id ORDER BY {r('score')} DESC, created_at DESC, memory_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY key_id) AS total FROM s)
  SELECT key_id, rank, memory_id, {r('score')} AS score, total, CAST(CASE WHEN total > 15 THEN 15 END AS INTEGER) AS next_offset FROM t WHERE rank > 5 AND rank <= 15""")
def read_key_ranked(spark, d):
    g = catalog(spark, d)
    rows = keys.read_key(g.keys, g.links, g.memories, NOW, limit=10, offset=5)
    return rows.select("key_id", "rank", "memory_id", r6(F.col("score")).alias("score"), "total", "next_offset")


@query(f"""WITH {VECTORS}, s AS (SELECT query_id, km.key_id, vm.memory_id, created_at, sim * {DEPTH} * {TIME} AS score FROM km JOIN vm USING (memory_id) JOIN qm ON qm.memory_id = vm.memory_id),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, key_id ORDER BY {r('score')} DESC, created_at DESC, memory_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, key_id, rank, memory_id, {r('score')} AS score FROM t WHERE rank <= 10""")
def read_key_with_query(spark, d):
    g = vectors(spark, d)
    rel = similar(vector_queries(spark, d), g.memories, least=-2.0, item_id="memory_id")
    return keys.read_key(g.keys, g.links, g.memories, NOW, relevance=rel).select("query_id", "key_id", "rank", "memory_id", r6(F.col("score")).alias("score"))


@query(f"WITH {CATALOG} SELECT memory_id, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY weight DESC, seq) AS INTEGER) AS rank, key_id, concept, {r('weight')} AS weight FROM l JOIN k USING (key_id) SEMI JOIN m USING (memory_id)")
def read_memory_keys(spark, d):
    g = catalog(spark, d)
    return keys.memory_keys(g.memories, g.keys, g.links).withColumn("weight", r6(F.col("weight")))


_SEED_STEPS = f"""
g1 AS (SELECT memory_id AS query_id, memory_id, CAST(1 AS DOUBLE) AS score, 1 AS hop FROM tops),
x1 AS (SELECT query_id, o.memory_id AS memory_id, sum(g1.score * 0.3 * idf * o.weight) AS gain FROM g1 JOIN l i USING (memory_id) JOIN l o ON o.key_id = i.key_id AND o.memory_id <> i.memory_id JOIN idf ON idf.key_id = i.key_id WHERE o.memory_id IN (SELECT memory_id FROM a) GROUP BY 1, 2),
g2 AS (SELECT coalesce(g1.query_id, x1.query_id) AS query_id, coalesce(g1.memory_id, x1.memory_id) AS memory_id, coalesce(score, 0) + coalesce(gain, 0) AS score, coalesce(hop, 2) AS hop FROM g1 FULL JOIN x1 ON g1.query_id = x1.query_id AND g1.memory_id = x1.memory_id),
x2 AS (SELECT query_id, o.memory_id AS memory_id, sum(g2.score * 0.3 * idf * o.weight) AS gain FROM g2 JOIN l i USING (memory_id) JOIN l o ON o.key_id = i.key_id AND o.memory_id <> i.memory_id JOIN idf ON idf.key_id = i.key_id WHERE hop = 2 AND o.memory_id IN (SELECT memory_id FROM a) GROUP BY 1, 2),
g3 AS (SELECT coalesce(g2.query_id, x2.query_id) AS query_id, coalesce(g2.memory_id, x2.memory_id) AS memory_id, coalesce(score, 0) + coalesce(gain, 0) AS score, coalesce(hop, 3) AS hop FROM g2 FULL JOIN x2 ON g2.query_id = x2.query_id AND g2.memory_id = x2.memory_id)
"""


def _expanded(spark, d, hops):
    g = catalog(spark, d)
    start = seeds(g).withColumn("score", F.lit(1.0))
    return graph.expand(start, g.keys, g.links, g.memories, NOW, hops)


@query(f"WITH {CATALOG}, {_SEED_STEPS} SELECT query_id, memory_id, {r('CASE WHEN hop >= 2 THEN score * 0.7 ELSE score END', 8)} AS score, CAST(hop AS INTEGER) AS hop FROM g2")
def hop2_expand(spark, d):
    return graph.far_penalty(_expanded(spark, d, 2)).withColumn("score", r6(F.col("score"), 8))


@query(f"WITH {CATALOG}, {_SEED_STEPS} SELECT query_id, memory_id, {r('CASE WHEN hop >= 2 THEN score * 0.7 ELSE score END', 8)} AS score, CAST(hop AS INTEGER) AS hop FROM g3")
def hop3_expand(spark, d):
    return graph.far_penalty(_expanded(spark, d, 3)).withColumn("score", r6(F.col("score"), 8))


@query(f"WITH {CATALOG}, {_SEED_STEPS} SELECT query_id, CAST(hop AS INTEGER) AS hop, count(*) AS n FROM g3 GROUP BY 1, 2")
def hop_distance(spark, d):
    return _expanded(spark, d, 3).groupBy("query_id", "hop").agg(F.count("*").alias("n"))


@query(f"""WITH {CATALOG}, n AS (SELECT t.memory_id AS seed_id, o.memory_id AS memory_id, sum(idf) AS score, count(*) AS n_shared FROM tops t JOIN l i USING (memory_id) JOIN l o ON o.key_id = i.key_id AND o.memory_id <> i.memory_id
    JOIN idf ON idf.key_id = i.key_id WHERE o.memory_id IN (SELECT memory_id FROM a) GROUP BY 1, 2),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY {r('score')} DESC, memory_id) AS INTEGER) AS rank FROM n)
  SELECT seed_id, memory_id, {r('score')} AS score, n_shared, 'key' AS link_type, rank FROM t WHERE rank <= 20""")
def related_memories(spark, d):
    g = catalog(spark, d)
    return graph.related(seeds(g).select(F.col("memory_id").alias("seed_id")), g.keys, g.links, g.memories, NOW).withColumn("score", r6(F.col("score")))


@query(f"WITH {CATALOG} SELECT m.memory_id AS memory_id, coalesce(s.memory_id, m.memory_id) AS head_id, CASE WHEN s.memory_id IS NULL THEN 0 ELSE 1 END AS steps, {r('CASE WHEN s.memory_id IS NULL THEN m.depth WHEN m.depth >= 0.7 THEN m.depth * 0.8 ELSE m.depth * 0.3 END')} AS depth FROM m LEFT JOIN m s ON s.supersedes = m.memory_id")
def supersede_chain(spark, d):
    m = catalog(spark, d).memories
    chains = m.where("supersedes IS NOT NULL").select("memory_id", "supersedes")
    deep = write.apply_supersession(m, chains).select("memory_id", r6(F.col("depth")).alias("depth"))
    return graph.supersession_heads(m).join(deep, "memory_id").select("memory_id", "head_id", "steps", "depth")


@query(f"""WITH {CATALOG}, n AS (SELECT key_id, count(*) AS n FROM l GROUP BY 1),
  c AS (SELECT k.key_id AS key_id, lower(concept) AS c, row_number() OVER (PARTITION BY lower(concept) ORDER BY (key_type IN ('name', 'proper_noun')) DESC, coalesce(n, 0) DESC, seq) AS o FROM k LEFT JOIN n ON n.key_id = k.key_id),
  f AS (SELECT c, key_id AS canonical_id FROM c WHERE o = 1), p AS (SELECT key_id, canonical_id FROM c JOIN f USING (c)),
  w AS (SELECT canonical_id, memory_id, max(weight) AS weight FROM l JOIN p USING (key_id) GROUP BY 1, 2)
  SELECT canonical_id, count(*) AS n_links, {r('sum(weight)')} AS weight, (SELECT count(*) FROM p WHERE p.canonical_id = w.canonical_id) AS n_merged FROM w GROUP BY 1""")
def heal_fragmented_keys(spark, d):
    g = catalog(spark, d)
    mapping, merged = maintain.heal_keys(g.keys, g.links)
    n = mapping.groupBy("canonical_id").agg(F.count("*").alias("n_merged"))
    return merged.groupBy(F.col("key_id").alias("canonical_id")).agg(F.count("*").alias("n_links"), r6(F.sum("weight")).alias("weight")).join(n, "canonical_id")


@query(f"WITH {CATALOG} SELECT key_id, concept FROM k WHERE key_id IN (SELECT key_id FROM l SEMI JOIN (SELECT memory_id FROM a WHERE namespace = 'P') USING (memory_id))")
def orphan_key_prune(spark, d):
    g = catalog(spark, d)
    left = g.links.join(graph.active(g.memories, NOW, "P").select("memory_id"), "memory_id", "left_semi")
    return prune_keys(g.keys, left).select("key_id", "concept")


@query(f"WITH {CATALOG} SELECT key_id, memory_id, {r('weight')} AS weight FROM l SEMI JOIN (SELECT key_id FROM k WHERE key_type = 'concept') USING (key_id) SEMI JOIN a USING (memory_id)")
def dangling_link_prune(spark, d):
    g = catalog(spark, d)
    return prune_links(g.links, g.keys.where("key_type = 'concept'"), graph.active(g.memories, NOW)).withColumn("weight", r6(F.col("weight")))


@query(f"""WITH {CATALOG}, e AS (SELECT * FROM m WHERE namespace <> 'O'), x AS (SELECT l.* FROM l SEMI JOIN e USING (memory_id))
  SELECT e.memory_id AS memory_id, NOT (ttl IS NOT NULL AND {NOW} > ttl) AND e.memory_id NOT IN (SELECT supersedes FROM e WHERE supersedes IS NOT NULL) AS current, (SELECT count(*) FROM x WHERE x.memory_id = e.memory_id) AS n_links FROM e""")
def delete_cascade(spark, d):
    g = catalog(spark, d)
    t = maintain.forget(g.memories.where("namespace = 'O'"), g.keys, g.links, g.memories)
    n = t["links"].groupBy("memory_id").agg(F.count("*").alias("n_links"))
    current = graph.active(t["memories"], NOW).select("memory_id", F.lit(True).alias("current"))
    return t["memories"].select("memory_id").join(current, "memory_id", "left").join(n, "memory_id", "left").select("memory_id", F.coalesce("current", F.lit(False)).alias("current"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(f"WITH {CATALOG}, e AS (SELECT * FROM m WHERE NOT (ttl IS NOT NULL AND {NOW} > ttl)) SELECT memory_id, namespace FROM e")
def cleanup_expired(spark, d):
    g = catalog(spark, d)
    return maintain.cleanup_expired(g.keys, g.links, g.memories, NOW)["memories"].select("memory_id", "namespace")


@query(f"WITH {CATALOG} SELECT memory_id, {r(DEPTH + ' * ' + TIME)} AS factor FROM m")
def depth_time_modulation(spark, d):
    m = catalog(spark, d).memories
    return m.select("memory_id", r6(depth_factor(F.col("depth")) * time_factor(F.col("created_at"), F.col("depth"), NOW)).alias("factor"))


@query(f"""WITH {CATALOG}, n AS MATERIALIZED (SELECT min(key_id) AS query_id, concept FROM k GROUP BY concept),
  nn AS MATERIALIZED (SELECT n.query_id AS query_id, o.concept AS concept FROM n, n o WHERE contains(lower(n.concept), lower(o.concept)) AND regexp_matches(lower(n.concept), '(^|[^\\p{{L}}\\p{{N}}])' || lower(o.concept) || '($|[^\\p{{L}}\\p{{N}}])')),
  h AS (SELECT query_id, key_id FROM nn JOIN k USING (concept))
  SELECT query_id, memory_id, {r('sum(idf / 61)', 9)} AS boost FROM h JOIN idf USING (key_id) JOIN l USING (key_id) WHERE memory_id IN (SELECT memory_id FROM a) GROUP BY 1, 2""")
def lexical_boost(spark, d):
    g = catalog(spark, d)
    asked = g.keys.groupBy(F.col("concept").alias("query")).agg(F.min("key_id").alias("query_id"))
    named = keys.literal_hits(asked, g.keys)
    return recall.lexical_boost(named, g.keys, g.links, graph.active(g.memories, NOW)).withColumn("boost", r6(F.col("boost"), 9))


_TOP20 = "res AS (SELECT * FROM (SELECT namespace AS query_id, memory_id, depth, price, CAST(row_number() OVER (PARTITION BY namespace ORDER BY price DESC, memory_id) AS INTEGER) AS rank FROM a) WHERE rank <= 20)"


def _results(spark, d):
    rows = graph.active(catalog(spark, d).memories, NOW).select(F.col("namespace").alias("query_id"), "memory_id", "seq", "depth", "price")
    order = Window.partitionBy("query_id").orderBy(F.desc("price"), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 20")


@query(f"""WITH {CATALOG}, {_TOP20}, w AS (SELECT query_id, memory_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY depth DESC, rank) AS INTEGER) AS slot FROM res WHERE rank <= 5),
  s AS (SELECT query_id, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, rank) AS o FROM res) WHERE o = 1),
  x AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.query_id = s.query_id AND w.memory_id = s.memory_id AND slot < 5))
  SELECT query_id, memory_id, slot FROM w WHERE slot < 5 OR query_id NOT IN (SELECT query_id FROM x) UNION ALL SELECT query_id, memory_id, 5 FROM x""")
def select_inject(spark, d):
    return recall.select_inject(_results(spark, d), 5, by_depth=True, shallow_slot=True).select("query_id", "memory_id", F.col("slot").cast("int").alias("slot"))


@query(f"""WITH {CATALOG}, {_TOP20}, hits AS (SELECT query_id, key_id FROM res JOIN l USING (memory_id) WHERE rank = 1),
  z AS (SELECT key_id, memory_id, CAST(0.1 AS DOUBLE) AS delta FROM hits JOIN l USING (key_id) JOIN res USING (query_id, memory_id) WHERE rank = 1
    UNION ALL SELECT key_id, memory_id, CAST(-0.005 AS DOUBLE) FROM hits JOIN l USING (key_id) WHERE memory_id IN (SELECT memory_id FROM a) AND NOT EXISTS (SELECT 1 FROM res WHERE res.query_id = hits.query_id AND res.memory_id = l.memory_id))
  SELECT key_id, memory_id, {r('sum(delta)')} AS delta FROM z GROUP BY 1, 2""")
def recall_reinforce_decay(spark, d):
    g = catalog(spark, d)
    res = _results(spark, d)
    hits = res.where("rank = 1").join(g.links, "memory_id").select("query_id", "key_id")
    return maintain.recall_reinforcement(res, hits, g.links, graph.active(g.memories, NOW)).withColumn("delta", r6(F.col("delta")))


@query(f"WITH {CATALOG}, x AS (SELECT memory_id AS src, memory_id + 1 AS dst FROM m WHERE memory_id % 13 = 0 UNION ALL SELECT memory_id, memory_id + 26 FROM m WHERE memory_id % 13 = 0) SELECT DISTINCT src, dst FROM (SELECT src, dst FROM x UNION ALL SELECT dst, src FROM x) WHERE dst IN (SELECT memory_id FROM a)")
def explicit_links(spark, d):
    m = _linked(spark, d).memories
    return graph.explicit_pairs(m).join(graph.active(m, NOW).select(F.col("memory_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def _linked(spark, d):
    g = catalog(spark, d)
    some = F.when(F.col("memory_id") % 13 == 0, F.array(F.col("memory_id") + 1, F.col("memory_id") + 26, F.col("memory_id"))).otherwise(F.array().cast("array<bigint>"))
    return dataclasses.replace(g, memories=g.memories.withColumn("links", some))


@query(f"""WITH {CATALOG}, sd AS (SELECT memory_id AS seed_id FROM m WHERE memory_id % 13 < 2),
  pr AS (SELECT memory_id AS src, memory_id + 1 AS dst FROM m WHERE memory_id % 13 = 0 UNION SELECT memory_id, memory_id + 26 FROM m WHERE memory_id % 13 = 0), pp AS (SELECT src, dst FROM pr UNION SELECT dst, src FROM pr),
  n AS (SELECT seed_id, memory_id, sum(s) AS score, sum(k) AS n_shared, max(e) AS e FROM (SELECT seed_id, o.memory_id AS memory_id, idf AS s, 1 AS k, 0 AS e FROM sd JOIN l i ON i.memory_id = seed_id JOIN l o ON o.key_id = i.key_id AND o.memory_id <> seed_id JOIN idf ON idf.key_id = i.key_id
      UNION ALL SELECT seed_id, dst, 1.0, 0, 1 FROM sd JOIN pp ON src = seed_id) SEMI JOIN a USING (memory_id) GROUP BY 1, 2),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY {r('score')} DESC, memory_id) AS INTEGER) AS rank FROM n)
  SELECT seed_id, memory_id, {r('score')} AS score, CAST(n_shared AS BIGINT) AS n_shared, CASE WHEN e = 0 THEN 'key' WHEN n_shared = 0 THEN 'explicit' ELSE 'both' END AS link_type, rank FROM t WHERE rank <= 20""")
def related_with_links(spark, d):
    g = _linked(spark, d)
    some = g.memories.where("memory_id % 13 < 2").select(F.col("memory_id").alias("seed_id"))
    return graph.related(some, g.keys, g.links, g.memories, NOW).withColumn("score", r6(F.col("score")))


@query(f"WITH {CATALOG}, rd AS (SELECT l_orderkey AS memory_id, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) SELECT memory_id, {r('least(1.0, depth + 0.05 * coalesce(n, 0))')} AS depth, CAST(coalesce(n, 0) AS INTEGER) AS access_count, CASE WHEN n IS NULL THEN created_at ELSE {NOW} END AS last_accessed FROM m LEFT JOIN rd USING (memory_id)")
def read_reinforcement(spark, d):
    m = catalog(spark, d).memories.withColumn("access_count", F.lit(0)).withColumn("last_accessed", F.col("created_at"))
    read = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("memory_id"))
    return maintain.touch(m, read, NOW).select("memory_id", r6(F.col("depth")).alias("depth"), "access_count", "last_accessed")


@query(f"""WITH {CATALOG}, g AS (SELECT * FROM l WHERE NOT (key_id % 5 = 0 AND memory_id % 2 = 0)), h AS (SELECT key_id, memory_id, CASE WHEN memory_id % 3 = 0 THEN greatest(0.1, least(3.0, weight * 2 - 1)) ELSE weight END AS weight FROM g)
  SELECT key_id, memory_id, {r('weight')} AS weight FROM h UNION ALL SELECT DISTINCT l.key_id, memory_id + 1, 1.0 FROM l WHERE memory_id % 40 = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.key_id = l.key_id AND h.memory_id = l.memory_id + 1)""")
def link_changes(spark, d):
    l = catalog(spark, d).links
    left = maintain.unlink(l, l.where("key_id % 5 = 0 AND memory_id % 2 = 0"))
    new = l.where("memory_id % 3 = 0").withColumn("weight", F.col("weight") * 2 - 1)
    more = l.where("memory_id % 40 = 1").select("key_id", (F.col("memory_id") + 1).alias("memory_id"))
    return maintain.upsert_links(maintain.set_weights(left, new), more).withColumn("weight", r6(F.col("weight")))


@query("""WITH p AS (SELECT p_partkey, p_name AS concept, lower(trim(p_name)) AS name, CASE p_size % 10 WHEN 0 THEN 'name' WHEN 1 THEN 'proper_noun' ELSE 'concept' END AS kind FROM part),
  k AS (SELECT lower(concept) AS name, min(p_partkey) AS first FROM p WHERE p_partkey % 3 = 0 GROUP BY 1),
  r AS (SELECT p.*, coalesce('k' || first, substr(sha256(p.name), 1, 12)) AS key_id, first IS NOT NULL AS old FROM p LEFT JOIN k ON k.name = p.name)
  SELECT key_id, CASE WHEN old THEN coalesce(arg_min(kind, p_partkey) FILTER (kind <> 'concept'), 'concept') WHEN arg_min(kind, p_partkey) = 'concept' THEN coalesce(arg_min(kind, p_partkey) FILTER (kind <> 'concept'), 'concept') ELSE arg_min(kind, p_partkey) END AS key_type,
    count(*) AS n_requests, CAST(sum(CASE WHEN old OR p_partkey <> f THEN 1 ELSE 0 END) AS BIGINT) AS n_equal FROM (SELECT *, min(p_partkey) OVER (PARTITION BY name) AS f FROM r) GROUP BY key_id, old""")
def key_requests(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 10 == 0, "name").when(F.col("p_size") % 10 == 1, "proper_noun").otherwise("concept")
    no_vector = F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>").alias("embedding")  # equal names alone
    asked = p.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("concept"), kind.alias("key_type"), no_vector)
    keyed = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key_id"), F.col("p_name").alias("concept"), F.array().cast("array<string>").alias("aliases"), F.lit("concept").alias("key_type"), no_vector, F.col("p_partkey").alias("seq"))
    found = write.resolve_keys(asked, keyed, CONFIG)
    made = found.where("how = 'new'").join(asked.select("seq", "key_type", "embedding"), "seq").withColumn("aliases", F.array().cast("array<string>"))
    done = write.record_keys(keyed.unionByName(made.select(keyed.columns)), asked, found)
    n = found.groupBy("key_id").agg(F.count("*").alias("n_requests"), F.sum((F.col("how") == "equal").cast("long")).alias("n_equal"))
    return done.join(n, "key_id").select("key_id", "key_type", "n_requests", "n_equal")


# ------------------------------------------------------------------ vectors


@query(f"""WITH RECURSIVE {VECTORS}, nw AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n FROM v WHERE vec_id % 4 = 0),
  cd AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS sim, CASE WHEN y.vec_id % 4 = 0 THEN 1000000 + y.vec_id ELSE y.vec_id END AS o FROM v x, v y WHERE x.vec_id % 4 = 0 AND x.vec_id <> y.vec_id AND (y.vec_id % 4 <> 0 OR y.vec_id < x.vec_id) AND list_cosine_similarity(x.e, y.e) + 1e-10 >= 0.42),
  st(n, gone, a, pick) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
    SELECT n, CASE WHEN p IS NULL THEN gone ELSE list_append(gone, p) END, vec_id, p FROM (SELECT nw.n AS n, gone, vec_id, arg_max(b, (sim, -o)) AS p FROM st JOIN nw ON nw.n = st.n + 1 LEFT JOIN cd ON cd.a = vec_id AND NOT list_contains(gone, b) GROUP BY nw.n, gone, vec_id))
  SELECT CAST(a AS VARCHAR) AS memory_id, CAST(pick AS VARCHAR) AS supersedes, CASE WHEN a + 1 IN (SELECT vec_id FROM v) THEN CAST(a + 1 AS VARCHAR) ELSE '' END AS links, CASE WHEN pick IS NOT NULL THEN x.label = y.label END AS conflict FROM st JOIN v x ON x.vec_id = a LEFT JOIN v y ON y.vec_id = pick""")
def remember_batch(spark, d):
    g = vectors(spark, d)
    name = lambda c: (F.concat(F.lit("k"), F.col(c).cast("string")) if c == "key_id" else F.col(c).cast("string")).alias(c)
    keyed = g.keys.select(name("key_id"), "seq", "concept", "aliases", F.lit("name").alias("key_type"), "embedding")
    links = g.links.select(name("key_id"), name("memory_id"), "weight")
    rows = g.memories.select(name("memory_id"), F.col("memory_id").alias("id"), "seq", "embedding", "namespace", F.lit("").alias("content"), F.lit(None).cast("double").alias("ttl"))
    at = F.col("id").cast("string")
    new = rows.where("id % 4 = 0").join(links.groupBy("memory_id").agg(F.collect_list("key_id").alias("keys")), "memory_id").withColumn("seq", F.col("seq") + 1_000_000)
    new = new.withColumn("related_to", F.array((F.col("id") + 1).cast("string"), at, F.lit("nowhere"), (F.col("id") + 1).cast("string")))
    old = rows.where("id % 4 <> 0")
    out = write.add_batch(new, old, links.join(old.select("memory_id"), "memory_id", "left_semi"), keyed, NOW, CONFIG)
    fresh = out["memories"].join(new.select("memory_id"), "memory_id", "left_semi")
    return fresh.join(out["duplicates"].select("memory_id", "conflict"), "memory_id", "left").select("memory_id", "supersedes", F.array_join("links", ",").alias("links"), "conflict")


@query(f"WITH {VECTORS}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {r('sim')} DESC, memory_id) AS INTEGER) AS rank FROM qm WHERE query_id <> memory_id) SELECT query_id, rank, memory_id, {r('sim')} AS sim FROM t WHERE rank <= 10")
def cosine_topk(spark, d):
    return _nearest(spark, d, 10).select("query_id", "rank", "memory_id", r6(F.col("sim")).alias("sim"))


def _nearest(spark, d, k):
    sims = similar(vector_queries(spark, d), vectors(spark, d).memories, item_id="memory_id", top=k + 1).where("query_id <> memory_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(r6(F.col("sim"))), "memory_id")
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_ALL = "ab AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS la, y.label AS lb, list_cosine_similarity(x.e, y.e) AS sim FROM v x, v y WHERE x.vec_id < y.vec_id)"


def _pairs(spark, d, least):
    """(a, b, sim, la, lb): labels ride along with the ids."""
    e = table(spark, d, "embeddings").select(F.struct("vec_id", "label").alias("x"), "embedding")
    rows = similar(e, e.withColumnRenamed("x", "y"), least, "x", "y").where("x.vec_id < y.vec_id")
    return rows.select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), "sim", F.col("x.label").alias("la"), F.col("y.label").alias("lb"))


@query(f"WITH {VECTORS}, {_ALL} SELECT a, b, {r('sim')} AS sim FROM ab WHERE sim + 1e-10 >= 0.3")
def all_pairs_over_threshold(spark, d):
    return _pairs(spark, d, 0.3).select("a", "b", r6(F.col("sim")).alias("sim"))


@query(f"WITH {VECTORS}, {_ALL} SELECT a, b, {r('sim')} AS sim FROM ab WHERE sim + 1e-10 >= 0.42")
def similarity_join(spark, d):
    e = table(spark, d, "embeddings")
    rows = join_similar(e.select(F.col("vec_id").alias("a"), "embedding"), e.select(F.col("vec_id").alias("b"), "embedding"), 0.42, "a", "b", cells=24, chunk_rows=64)
    return rows.where("a < b").withColumn("sim", r6(F.col("sim")))


@query(f"WITH {VECTORS}, s AS (SELECT x.vec_id AS memory_id, y.vec_id AS duplicate_id, list_cosine_similarity(x.e, y.e) AS sim FROM v x, v y WHERE x.vec_id <> y.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY {r('sim')} DESC, duplicate_id) AS o FROM s WHERE sim + 1e-10 >= 0.42) SELECT memory_id, duplicate_id, {r('sim')} AS sim FROM t WHERE o = 1")
def duplicate_argmax(spark, d):
    m = vectors(spark, d).memories
    return write.best_duplicate(m, m, CONFIG).withColumn("sim", r6(F.col("sim")))


@query(f"WITH {VECTORS}, {_ALL} SELECT a, b, {r('sim')} AS sim FROM ab WHERE la = lb AND sim + 1e-10 >= 0.3 AND sim + 1e-10 < 0.42")
def contradiction_band(spark, d):
    g = vectors(spark, d)
    return write.contradictions(g.memories, g.links, config=CONFIG).withColumn("sim", r6(F.col("sim")))


@query(f"WITH {VECTORS} SELECT ke.key_id AS key_id, vec_id AS memory_id, {r('greatest(0.1, least(3.0, list_cosine_similarity(ke.e, v.e)))')} AS weight FROM ke, v WHERE ke.label <> v.label AND list_cosine_similarity(ke.e, v.e) + 1e-10 >= 0.3")
def auto_link(spark, d):
    g = vectors(spark, d)
    return write.auto_links(g.memories, g.keys, g.links, CONFIG).withColumn("weight", r6(F.col("weight")))


_KEYSCORE = f"""
b AS (SELECT query_id, key_id, max(sim) AS content_sim, arg_max(qm.memory_id, ({r('sim')}, -qm.memory_id)) AS content_id FROM qm JOIN km USING (memory_id) %s GROUP BY 1, 2),
n AS (SELECT key_id, count(*) AS n_memories FROM km GROUP BY 1),
j AS (SELECT coalesce(x.query_id, b.query_id) AS query_id, coalesce(x.key_id, b.key_id) AS key_id, coalesce(x.sim, 0) AS key_sim, coalesce(content_sim, 0) AS content_sim, content_id FROM (SELECT * FROM qk %s) x FULL JOIN b ON x.query_id = b.query_id AND x.key_id = b.key_id),
s AS (SELECT j.*, n_memories, 'label ' || label AS concept, floor((greatest(key_sim, content_sim) + 1e-10) * 1000 + 0.5) / 1000 AS score, CASE WHEN content_sim > key_sim + 1e-10 THEN 'content' ELSE 'semantic' END AS match_type, floor(1000.0 / n_memories + 0.5) / 1000 AS specificity FROM j JOIN n USING (key_id) JOIN ke USING (key_id))
"""


@query(f"""WITH {VECTORS}, {_KEYSCORE % ('WHERE sim + 1e-10 >= 0.2', 'WHERE sim + 1e-10 >= 0.2')},
  g AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_id, match_type = 'content' ORDER BY score DESC, specificity DESC, key_id) AS claimed FROM s WHERE key_sim + 1e-10 >= 0.2 OR content_sim + 1e-10 >= 0.25),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, specificity DESC, key_id) AS INTEGER) AS rank FROM g WHERE match_type <> 'content' OR claimed = 1)
  SELECT query_id, rank, key_id, concept, CAST(score AS DOUBLE) AS score, match_type, n_memories FROM t WHERE rank <= 8""")
def search_keys(spark, d):
    g = vectors(spark, d)
    sims = similar(vector_queries(spark, d), g.memories, least=0.2, item_id="memory_id")
    rows = keys.search_keys(vector_queries(spark, d), g.keys, g.links, g.memories, NOW, top_k=8, content_sims=sims, config=CONFIG)
    return rows.select("query_id", "rank", "key_id", "concept", "score", "match_type", "n_memories")


@query(f"""WITH {VECTORS}, {_KEYSCORE % ('', '')}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, key_id, concept, CAST(score AS DOUBLE) AS score, match_type, n_memories FROM t WHERE rank <= 5""")
def nearest_keys(spark, d):
    g = vectors(spark, d)
    return keys.nearest_keys(vector_queries(spark, d), g.keys, g.links, g.memories, NOW, config=CONFIG)


@query(f"WITH {VECTORS}, s AS (SELECT ke.key_id AS key_id, vec_id AS near_id, list_cosine_similarity(ke.e, v.e) AS sim FROM ke, v WHERE vec_id NOT IN (SELECT key_id FROM ke)), t AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY {r('sim')} DESC, near_id) AS o FROM s WHERE sim + 1e-10 >= 0.2 AND NOT sim + 1e-10 >= 0.42) SELECT key_id, near_id, {r('sim')} AS sim FROM t WHERE o = 1")
def near_key_hints(spark, d):
    g = vectors(spark, d)
    others = g.memories.select(F.col("memory_id").alias("key_id"), "seq", "embedding", F.lit("concept").alias("key_type"))
    return keys.near_key_hints(g.keys.select("key_id", "embedding"), others, CONFIG).withColumn("sim", r6(F.col("sim")))


@query(f"WITH {VECTORS} SELECT query_id, memory_id // 4 AS memory_id, {r('max(sim)')} AS sim FROM qm WHERE sim + 1e-10 >= 0.25 GROUP BY 1, 2")
def max_sim_sentences(spark, d):
    sims = similar(vector_queries(spark, d), vectors(spark, d).memories, least=0.25, item_id="memory_id")
    pack = sims.withColumn("memory_id", F.floor(F.col("memory_id") / 4).cast("long"))
    return max_sim(pack, ["query_id", "memory_id"]).withColumn("sim", r6(F.col("sim")))


_Z = "z1 AS (SELECT query_id, count(*) AS n, max(sim) AS top, median(sim) AS med FROM qm WHERE query_id <> memory_id GROUP BY 1), z2 AS (SELECT query_id, median(abs(sim - med)) AS mad FROM qm JOIN z1 USING (query_id) WHERE query_id <> memory_id GROUP BY 1), z AS (SELECT query_id, n, top, med, mad, CASE WHEN mad > 0 THEN (top - med) / (1.4826 * mad) END AS z FROM z1 JOIN z2 USING (query_id))"


@query(f"WITH {VECTORS}, {_Z} SELECT query_id, n, {r('top')} AS top, {r('med')} AS med, {r('mad')} AS mad, {r('z')} AS z, n < 8 OR z IS NULL OR z + 1e-10 >= 2.8 AS passes FROM z")
def robust_z_gate(spark, d):
    z = robust_spread(vector_queries(spark, d), vectors(spark, d).memories, apart=True)
    return z.select("query_id", "n", *(r6(F.col(c)).alias(c) for c in ("top", "med", "mad", "z")), recall.distribution_gate(F.col("z"), F.col("n"), 2.8).alias("passes"))


@query(f"WITH {VECTORS}, {_Z} SELECT query_id, top + 1e-10 >= 0.999 OR (top + 1e-10 >= 0.25 AND (n < 8 OR z IS NULL OR z + 1e-10 >= 2.8)) AS found FROM z")
def anchor_decision(spark, d):
    q, m = vector_queries(spark, d), vectors(spark, d).memories
    best = similar(q, m, item_id="memory_id", top=2).where("query_id <> memory_id").withColumnRenamed("sim", "raw_sim")
    return recall.anchored(best, robust_spread(q, m, apart=True), config=CONFIG)


@query(f"WITH {VECTORS}, t AS (SELECT *, max(sim) OVER (PARTITION BY query_id) AS top FROM qm WHERE query_id <> memory_id) SELECT query_id, memory_id, {r('sim')} AS sim FROM t WHERE sim + 1e-10 >= top * 0.6")
def relative_floor(spark, d):
    # a score counts from 0.6 of the best on: of negative ones none, as best scores are positive
    rows = similar(vector_queries(spark, d), vectors(spark, d).memories, least=0.0, item_id="memory_id").where("query_id <> memory_id")
    return recall.relative_floor(rows.withColumnRenamed("sim", "score"), 0.6).select("query_id", "memory_id", r6(F.col("score")).alias("sim"))


_REC = f"""
ks AS (SELECT query_id, key_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r('sim')} DESC, key_id) AS o FROM qk WHERE sim + 1e-10 >= 0.2) WHERE o <= 10),
f AS (SELECT key_id, CASE WHEN count(*) <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / count(*) END AS idf FROM km GROUP BY 1),
dk AS (SELECT query_id, memory_id, sum(sim * idf) AS key_score, max(sim) AS key_sim FROM ks JOIN f USING (key_id) JOIN km USING (key_id) GROUP BY 1, 2),
dc AS (SELECT query_id, memory_id, sim AS content_sim FROM qm WHERE sim + 1e-10 >= 0.25),
de AS (SELECT coalesce(dk.query_id, dc.query_id) AS query_id, coalesce(dk.memory_id, dc.memory_id) AS memory_id, CASE WHEN key_score IS NULL THEN content_sim * 0.8 ELSE key_score + coalesce(content_sim, 0) * 0.8 * 0.2 END AS score, greatest(coalesce(key_sim, 0), coalesce(content_sim, 0)) AS raw_sim FROM dk FULL JOIN dc ON dk.query_id = dc.query_id AND dk.memory_id = dc.memory_id),
dr AS (SELECT query_id, memory_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r('score')} DESC, memory_id) AS rank FROM de) WHERE rank <= 50),
br AS (SELECT query_id, memory_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r('score')} DESC, memory_id) AS rank FROM bs) WHERE rank <= 50 AND memory_id IN (SELECT vec_id FROM v)),
bq AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM br),
fu AS (SELECT query_id, memory_id, sum(s) AS score FROM (SELECT query_id, memory_id, 1.0 / (60 + rank) AS s FROM dr UNION ALL SELECT query_id, memory_id, 1.0 / (60 + rank) FROM bq) GROUP BY 1, 2)
"""

_TOKENS = r"list_filter(regexp_split_to_array(lower(%s), '[\s\p{P}]+'), lambda x: x <> '')"
_INDEX = f"""
dt AS (SELECT doc_id, {_TOKENS % 'text'} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM dt),
ps AS (SELECT term, doc_id, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM dt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM ps GROUP BY 1)
"""
_BM = "(0.5 + tf * 2.2 / (tf + 1.2 * (1 - 0.7 + 0.7 * doc_len / avg_len))) * ln(1 + (n_docs - df + 0.5) / (df + 0.5))"
#: Vector query 50 i asks benchmark item i.
_BS = f"""
qt AS (SELECT DISTINCT item_id * 50 AS query_id, unnest({_TOKENS % 'text'}) AS q_term FROM benchmark WHERE item_id * 50 IN (SELECT vec_id FROM embeddings)),
bs AS (SELECT query_id, doc_id AS memory_id, sum({_BM}) * count(DISTINCT q_term) AS score FROM qt JOIN df ON q_term = df.term JOIN ps ON ps.term = df.term, st GROUP BY 1, 2)
"""


def _index(spark, d):
    return bm25.Index.build(documents(spark, d))


def _both_queries(spark, d):
    q = vector_queries(spark, d)
    return q.join(text_queries(spark, d).withColumn("query_id", F.col("query_id") * 50), "query_id", "left")


def _sparse(spark, d):
    asked = _both_queries(spark, d).where("query IS NOT NULL")
    return _index(spark, d).search(asked, 50, prefix=False, fuzzy=False)


@query(f"WITH {VECTORS}, {_INDEX}, {_BS}, {_REC} SELECT query_id, memory_id, {r('score', 8)} AS score FROM fu")
def rrf_fusion(spark, d):
    g = vectors(spark, d)
    sims = similar(vector_queries(spark, d), g.memories, least=CONFIG.profile.content_recall, item_id="memory_id")
    dense = recall.Dense(vector_queries(spark, d), g.keys, g.links, g.memories, sims, CONFIG).best(50)
    sparse = _sparse(spark, d).join(g.memories.select("memory_id"), "memory_id", "left_semi")
    sparse = sparse.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return recall.fuse([dense, sparse]).withColumn("score", r6(F.col("score"), 8))


def _recalled(spark, d, top_k=10):
    g = vectors(spark, d)
    q = _both_queries(spark, d)
    return recall.hybrid_recall(q.select("query_id", "embedding"), g.keys, g.links, g.memories, NOW, bm25=_sparse(spark, d), top_k=top_k, config=CONFIG)


_GATED = f"""
zz1 AS (SELECT query_id, count(*) AS n, max(sim) AS top, median(sim) AS med FROM qm GROUP BY 1), zz2 AS (SELECT query_id, median(abs(sim - med)) AS mad FROM qm JOIN zz1 USING (query_id) GROUP BY 1),
mo AS (SELECT fu.query_id AS query_id, fu.memory_id AS memory_id, fu.score * {DEPTH} * {TIME} AS score, coalesce(raw_sim, 0) AS raw_sim FROM fu JOIN vm USING (memory_id) LEFT JOIN de ON de.query_id = fu.query_id AND de.memory_id = fu.memory_id),
an AS (SELECT mo.query_id AS query_id FROM mo JOIN zz1 ON zz1.query_id = mo.query_id JOIN zz2 ON zz2.query_id = mo.query_id GROUP BY mo.query_id, n, top, med, mad HAVING max(raw_sim) + 1e-10 >= 0.999 OR (max(raw_sim) + 1e-10 >= 0.25 AND (n < 8 OR mad = 0 OR (top - med) / (1.4826 * mad) + 1e-10 >= 2.8))),
hr AS (SELECT * FROM (SELECT mo.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {r('score')} DESC, memory_id) AS INTEGER) AS rank FROM mo SEMI JOIN an USING (query_id)) WHERE rank <= 10)
"""


@query(f"WITH {VECTORS}, {_INDEX}, {_BS}, {_REC}, {_GATED} SELECT query_id, rank, memory_id, {r('score', 8)} AS score, {r('raw_sim')} AS raw_sim, 1 AS hop FROM hr")
def hybrid_recall(spark, d):
    return _recalled(spark, d).drop("matched_via").withColumn("score", r6(F.col("score"), 8)).withColumn("raw_sim", r6(F.col("raw_sim")))


@query(f"WITH {VECTORS}, g AS (SELECT query_id, max(sim) AS top FROM qm WHERE query_id <> memory_id GROUP BY 1), kg AS (SELECT query_id, max(sim) AS near FROM qk WHERE key_id <> query_id GROUP BY 1) SELECT query_id, top + 1e-10 >= 0.999 OR near + 1e-10 >= 0.35 AS found FROM g JOIN kg USING (query_id)")
def key_gate(spark, d):
    c = dataclasses.replace(CONFIG, profile=dataclasses.replace(CONFIG.profile, key_gate=0.35, min_score=0.999, gate_z=0.0))
    q, g = vector_queries(spark, d), vectors(spark, d)
    best = similar(q, g.memories, item_id="memory_id", top=2).where("query_id <> memory_id")
    keyed = similar(q, g.keys, least=0.35, item_id="key_id").where("key_id <> query_id").groupBy("query_id").agg(F.max("sim").alias("key_sim"))
    return recall.anchored(best.withColumnRenamed("sim", "raw_sim"), recall.robust_z(best), keyed, c)


#: Queries with text: a benchmark item and the name of a key, every third the name alone, which is short.
_TEXTS = r"""
qq AS (SELECT *, CASE WHEN len(list_filter(regexp_split_to_array(trim(query), '\s+'), lambda x: x <> '')) <= 2 OR length(trim(query)) <= 15 THEN 0.2 ELSE 0.25 END AS gate
  FROM (SELECT q.query_id AS query_id, CASE WHEN q.query_id // 50 % 3 = 0 THEN '' ELSE coalesce(b.text || ' ', '') END || 'label ' || CAST(q.query_id // 50 % 10 AS VARCHAR) AS query FROM q LEFT JOIN benchmark b ON b.item_id * 50 = q.query_id)),
qt AS (SELECT DISTINCT query_id, unnest({tok}) AS q_term FROM qq),
w AS (SELECT DISTINCT q_term, length(q_term) AS n, CAST(floor(length(q_term) * 0.2 + 0.5) AS INTEGER) AS e FROM qt),
x AS (SELECT q_term, term, 1.0 AS tw FROM w JOIN df ON q_term = term UNION ALL SELECT q_term, term, 0.375 * length(term) / (length(term) + 0.3 * (length(term) - n)) FROM w JOIN df ON starts_with(term, q_term) AND length(term) > n
  UNION ALL SELECT q_term, term, 0.45 * length(term) / (length(term) + {lev}) FROM w JOIN df ON e > 0 AND term <> q_term AND abs(length(term) - n) <= e WHERE {lev} <= e),
y AS (SELECT query_id, q_term, term, max(tw) AS tw FROM qt JOIN x USING (q_term) GROUP BY ALL),
bs AS (SELECT query_id, doc_id AS memory_id, sum(tw * {bm}) * count(DISTINCT q_term) AS score FROM y JOIN df ON y.term = df.term JOIN ps ON ps.term = df.term, st GROUP BY 1, 2)
"""
#: DuckDB's levenshtein counts bytes: the letters of the test tables are first made single bytes.
_LEV = "levenshtein(translate(q_term, 'éèêçíóñßöüä', 'ABCDEFGHIJK'), translate(term, 'éèêçíóñßöüä', 'ABCDEFGHIJK'))"
_TEXTS = _TEXTS.replace("{lev}", _LEV).replace("{bm}", _BM).replace("{tok}", _TOKENS % "query")
#: Recall of those in two hops, with the evidence of each row.
_WIDE = f"""
{_REC.replace('FROM qm WHERE sim + 1e-10 >= 0.25)', 'FROM qm JOIN qq USING (query_id) WHERE sim + 1e-10 >= gate)')},
lb AS (SELECT query_id, memory_id, sum(idf / 61.0) AS boost FROM qq JOIN ke ON regexp_matches(lower(query), '(^|[^\\p{{L}}\\p{{N}}])label ' || label || '($|[^\\p{{L}}\\p{{N}}])') JOIN f USING (key_id) JOIN km USING (key_id) GROUP BY 1, 2),
fb AS (SELECT coalesce(fu.query_id, lb.query_id) AS query_id, coalesce(fu.memory_id, lb.memory_id) AS memory_id, coalesce(score, 0) + coalesce(boost, 0) AS score FROM fu FULL JOIN lb ON lb.query_id = fu.query_id AND lb.memory_id = fu.memory_id),
vt AS (SELECT query_id, memory_id, list(DISTINCT t) AS via FROM (SELECT query_id, memory_id, 'label ' || label AS t FROM ks JOIN km USING (key_id) JOIN ke USING (key_id) UNION ALL SELECT query_id, memory_id, '(content)' FROM dc UNION ALL SELECT query_id, memory_id, '(bm25)' FROM bq) GROUP BY 1, 2),
a1 AS (SELECT fb.query_id AS query_id, fb.memory_id AS memory_id, fb.score * {DEPTH} * {TIME} AS score, coalesce(via, []) AS via, CASE WHEN len(list_filter(coalesce(via, []), lambda z: z <> '(bm25)')) > 0 THEN 1 ELSE 0 END AS firm
  FROM fb JOIN vm USING (memory_id) LEFT JOIN vt ON vt.query_id = fb.query_id AND vt.memory_id = fb.memory_id),
tt AS (SELECT query_id, key_id, sum(score) AS total, count(*) AS n, sum(firm) AS firm FROM a1 JOIN km USING (memory_id) GROUP BY 1, 2),
gg AS (SELECT tt.query_id AS query_id, km.memory_id AS memory_id, 0.3 * idf * (total - coalesce(a1.score, 0)) AS gain, CASE WHEN tt.firm - coalesce(a1.firm, 0) > 0 THEN 'label ' || label || '(via)' END AS tag
  FROM tt JOIN km USING (key_id) JOIN f USING (key_id) JOIN ke USING (key_id) LEFT JOIN a1 ON a1.query_id = tt.query_id AND a1.memory_id = km.memory_id WHERE n - CASE WHEN a1.memory_id IS NULL THEN 0 ELSE 1 END > 0),
s2 AS (SELECT coalesce(a1.query_id, gg.query_id) AS query_id, coalesce(a1.memory_id, gg.memory_id) AS memory_id, (coalesce(score, 0) + coalesce(gain, 0)) * CASE WHEN a1.query_id IS NULL THEN 0.7 ELSE 1.0 END AS score, CASE WHEN a1.query_id IS NULL THEN 2 ELSE 1 END AS hop,
  list_sort(list_distinct(list_filter(list_append(coalesce(via, []), tag), lambda z: z IS NOT NULL))) AS via FROM a1 FULL JOIN gg ON gg.query_id = a1.query_id AND gg.memory_id = a1.memory_id),
s3 AS (SELECT s2.*, coalesce(raw_sim, 0) AS raw_sim, max(coalesce(raw_sim, 0)) OVER (PARTITION BY s2.query_id) AS best, max(score_) OVER (PARTITION BY s2.query_id) AS top_score FROM (SELECT *, score AS score_ FROM s2) s2 LEFT JOIN de ON de.query_id = s2.query_id AND de.memory_id = s2.memory_id),
zz1 AS (SELECT query_id, count(*) AS n, max(sim) AS top, median(sim) AS med FROM qm GROUP BY 1), zz2 AS (SELECT query_id, median(abs(sim - med)) AS mad FROM qm JOIN zz1 USING (query_id) GROUP BY 1),
rr AS (SELECT * FROM (SELECT s3.query_id AS query_id, memory_id, score_ AS score, hop, via, raw_sim, CAST(row_number() OVER (PARTITION BY s3.query_id ORDER BY {r('score_')} DESC, memory_id) AS INTEGER) AS rank
  FROM s3 JOIN zz1 ON zz1.query_id = s3.query_id JOIN zz2 ON zz2.query_id = s3.query_id JOIN qq ON qq.query_id = s3.query_id
  WHERE score_ + 1e-10 >= top_score * 0.05 AND (best + 1e-10 >= 0.999 OR (best + 1e-10 >= gate AND (n < 8 OR mad = 0 OR (top - med) / (1.4826 * mad) + 1e-10 >= 2.8)))) WHERE rank <= 20)
"""


def _named_queries(spark, d):
    n = F.floor(F.col("query_id") / 50)
    text = F.concat(F.when(n % 3 == 0, "").otherwise(F.coalesce(F.concat("query", F.lit(" ")), F.lit(""))), F.lit("label "), (n % 10).cast("string"))
    return _both_queries(spark, d).withColumn("query", text)


def _recalled_wide(spark, d):
    g, q = vectors(spark, d), _named_queries(spark, d)
    sparse = _index(spark, d).search(q, 50)
    return recall.hybrid_recall(q, g.keys, g.links, g.memories, NOW, bm25=sparse, top_k=10, hops=2, min_rel=0.05, config=CONFIG)


@query(f"WITH {VECTORS}, {_INDEX}, {_TEXTS}, {_WIDE} SELECT query_id, rank, memory_id, {r('score', 8)} AS score, {r('raw_sim')} AS raw_sim, hop, array_to_string(via, ', ') AS matched_via FROM rr")
def hybrid_recall_two_hops(spark, d):
    rows = _recalled_wide(spark, d)
    return rows.select("query_id", "rank", "memory_id", r6(F.col("score"), 8).alias("score"), r6(F.col("raw_sim")).alias("raw_sim"), "hop", F.array_join("matched_via", ", ").alias("matched_via"))


_HAY = "content || ' ' || keys"
_PICKED = f"""
ij AS (SELECT rr.query_id AS query_id, rr.memory_id AS memory_id, rank, score, raw_sim, vm.label AS label, d.text AS content, 'label ' || vm.label AS keys, query FROM rr JOIN documents d ON d.doc_id = rr.memory_id JOIN vm ON vm.memory_id = rr.memory_id JOIN qq ON qq.query_id = rr.query_id WHERE len(list_filter(via, lambda z: z <> '(bm25)')) > 0),
ic AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ij WHERE len(list_filter({_structured('query')}, lambda x: NOT contains(lower({_HAY}), x))) = 0 AND {_covers('query', _HAY)}),
ip AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS slot FROM ic WHERE score + 1e-10 >= top * 0.2) WHERE slot <= 3)
"""


def _texts(spark, d):
    return vectors(spark, d).memories.join(table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content")), "memory_id")


def _injected(spark, d):
    g = vectors(spark, d)
    return recall.recall_inject(_recalled_wide(spark, d), _named_queries(spark, d), g.keys, g.links, _texts(spark, d), top_k=3, min_rel=0.2, config=CONFIG)


@query(f"WITH {VECTORS}, {_INDEX}, {_TEXTS}, {_WIDE}, {_PICKED} SELECT query_id, slot, memory_id, CASE WHEN length(content) > 2000 THEN regexp_replace(substr(content, 1, 1953), '\\s+\\z', '') || chr(10) || '…[truncated; use read_memory for full content]' ELSE content END AS text, length(content) > 2000 AS truncated, CASE WHEN length(content) > 2000 THEN CAST(length(content) AS INTEGER) END AS n_chars, keys FROM ip")
def recall_inject(spark, d):
    return _injected(spark, d).drop("raw_sim")


@query(f"""WITH {VECTORS}, {_INDEX}, {_TEXTS}, {_WIDE}, {_PICKED} SELECT query_id, slot, memory_id,
  '- [' || memory_id || ' rel=' || CAST(round(raw_sim + 1e-10, 3) AS VARCHAR) || ' ns=' || label || '] ' || CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '…' ELSE content END AS line
  FROM ip WHERE round(raw_sim + 1e-10, 3) + 1e-10 >= 0.05 AND (query_id // 50 % 2 = 1 OR label IN (query_id // 50 % 10, 1, 2))""")
def push_lines(spark, d):
    n = F.floor(F.col("query_id") / 50)
    allowed = vector_queries(spark, d).select("query_id", F.when(n % 2 == 0, F.array((n % 10).cast("string"), F.lit("1"), F.lit("2"))).alias("namespaces"))
    return recall.push_inject(_injected(spark, d), _texts(spark, d), allowed, dataclasses.replace(CONFIG, push_min_rel=0.05))


def _overlap(queries: list[str], texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for a cross-encoder: shared words."""
    return np.array([len(set(q.lower().split(" ")) & set(t.lower().split(" "))) for q, t in zip(queries, texts, strict=True)], float)


@query(f"""WITH {VECTORS}, {_INDEX}, {_BS}, {_REC}, {_GATED}, s AS (SELECT hr.query_id AS query_id, memory_id, rank AS fused_rank, CAST(len(list_intersect(string_split(lower(coalesce(b.text, '')), ' '), string_split(lower(substr(d.text, 1, 512)), ' '))) AS DOUBLE) AS rerank_score FROM hr JOIN documents d ON d.doc_id = memory_id LEFT JOIN benchmark b ON b.item_id * 50 = hr.query_id),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS INTEGER) AS rank FROM s) SELECT query_id, rank, memory_id, rerank_score, fused_rank FROM t WHERE rank <= 5 AND (query_id // 50 % 2 = 1 OR query_id IN (SELECT query_id FROM t WHERE rerank_score >= 6.5))""")
def rerank_pool(spark, d):
    hangul = F.when(F.floor(F.col("query_id") / 50) % 2 == 1, " 질문").otherwise("")  # such queries have no text of their script to answer them
    q = _both_queries(spark, d).withColumn("query", F.concat(F.coalesce("query", F.lit("")), hangul))
    return recall.rerank(_recalled(spark, d), _overlap, q, documents(spark, d), top_k=5, config=dataclasses.replace(CONFIG, rerank_min_score=6.5))


# ------------------------------------------------------------------ text


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: length(x) >= 10) AS p FROM documents)
  SELECT doc_id, CAST(CASE WHEN len(p) >= 2 THEN least(12, len(p)) ELSE 0 END AS INTEGER) AS n, CASE WHEN len(p) >= 2 THEN md5(array_to_string(list_slice(p, 1, 12), '|')) ELSE md5('') END AS joined FROM s""")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("joined"))


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, md5(array_to_string(t, ' ')) AS joined FROM (SELECT doc_id, {_TOKENS % 'text'} AS t FROM documents)")
def tokenize_terms(spark, d):
    t = T.terms(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("joined"))


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: length(x) >= 2 OR regexp_matches(x, '^[\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}]$'))) AS INTEGER) AS n_usable FROM documents")
def sanitize_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.usable_keys(F.split("text", " "))).alias("n_usable"))


_NAMES = ("the", "on", "licensed", "mit license", "general public license", "all rights", "cc by", "un")


@query("WITH n(key_id, concept) AS (VALUES %s) SELECT doc_id AS query_id, key_id FROM documents, n WHERE contains(lower(text), concept) AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || concept || '($|[^\\p{L}\\p{N}])')" % ", ".join(f"({i}, '{c}')" for i, c in enumerate(_NAMES)))
def literal_key_match(spark, d):
    named = spark.createDataFrame([(i, c, []) for i, c in enumerate(_NAMES)], "key_id int, concept string, aliases array<string>")
    asked = spread(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))
    return keys.literal_hits(asked, named).select("query_id", "key_id")


#: Keys by the names that they go by, and each name's place among those of its key.
_ALIASES = {1: ("mit license", "licensed", "un"), 2: ("all rights", "the"), 3: ("general public license", "cc by", "on")}


@query("WITH n(key_id, pos, alias) AS (VALUES %s) SELECT doc_id AS query_id, key_id, arg_min(alias, pos) AS alias FROM documents, n WHERE contains(lower(text), alias) AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || alias || '($|[^\\p{L}\\p{N}])') GROUP BY 1, 2" % ", ".join(f"({k}, {i}, '{a}')" for k, names in _ALIASES.items() for i, a in enumerate(names)))
def alias_uses(spark, d):
    named = spark.createDataFrame([(k, f"key {k}", list(a)) for k, a in _ALIASES.items()], "key_id int, concept string, aliases array<string>")
    asked = spread(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))
    return keys.alias_uses(asked, named)


_CODED = "url || ' v' || page_id % 9 || '.' || page_id % 7 || '.x #' || page_id % 50 || ', ' || substr(md5(url), 1, 10) || ' (2.' || page_id % 3 || ') needs 1.' || page_id % 3 || '.3-beta.' || page_id % 2 || ' now, not deadbeef or 버전1.2.3'"
#: What the tokens are looked for in: betas of one kind aren't there, nor is every third page's hexadecimal id.
_SAID = f"CASE WHEN page_id % 3 = 0 THEN replace({_CODED}, 'deadbeef', 'feed') ELSE replace({_CODED}, '-beta.1', '') END"


def _coded(spark, d):
    part = lambda n: (F.col("page_id") % n).cast("string")
    text = F.concat("url", F.lit(" v"), part(9), F.lit("."), part(7), F.lit(".x #"), part(50), F.lit(", "), F.substring(F.md5("url"), 1, 10), F.lit(" (2."), part(3), F.lit(") needs 1."), part(3), F.lit(".3-beta."), part(2), F.lit(" now, not deadbeef or 버전1.2.3"))
    return table(spark, d, "pages").withColumn("text", text)


@query(f"SELECT page_id, array_to_string({_structured(_CODED)}, ' ') AS tokens FROM pages")
def structured_tokens(spark, d):
    return _coded(spark, d).select("page_id", F.array_join(T.structured_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT page_id, len(list_filter({_structured(_CODED)}, lambda x: NOT contains(lower({_SAID}), x))) = 0 AS covered FROM pages")
def structured_coverage(spark, d):
    said = lambda a, b: F.replace("text", F.lit(a), F.lit(b))
    hay = F.when(F.col("page_id") % 3 == 0, said("deadbeef", "feed")).otherwise(said("-beta.1", ""))
    return _coded(spark, d).select("page_id", T.covers_structured(F.col("text"), hay).alias("covered"))


_ASKED = "'tell me about the ' || url || ' where were you'"


@query(f"SELECT page_id, {_covers(_ASKED, 'html')} AS covered FROM pages")
def lexical_coverage(spark, d):
    asked = F.concat(F.lit("tell me about the "), "url", F.lit(" where were you"))
    return table(spark, d, "pages").select("page_id", T.covers_lexically(asked, F.col("html")).alias("covered"))


@query(r"SELECT p_partkey, len(list_filter(regexp_split_to_array(trim(p_name), '\s+'), lambda x: x <> '')) <= 2 OR length(trim(p_name)) <= 15 AS short FROM part")
def short_concept(spark, d):
    return table(spark, d, "part").select("p_partkey", T.short_concept(F.col("p_name")).alias("short"))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{3130}-\x{318F}\x{AC00}-\x{D7A3}]') AS hangul FROM documents")
def hangul_script_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_hangul(F.col("text")).alias("hangul"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN rtrim(substr(text, 1, 399)) || '…' ELSE text END AS preview FROM documents")
def truncate_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 400).alias("preview"))


@query(f"WITH {_INDEX} SELECT term, df, CAST(n_docs AS BIGINT) AS n_docs, {r('avg_len')} AS avg_len FROM df, st")
def bm25_stats(spark, d):
    index = _index(spark, d)
    one = index.stats().first()
    return index.terms().select("term", "df", F.lit(one["n_docs"]).alias("n_docs"), r6(F.lit(one["avg_len"])).alias("avg_len"))


_ITEMS = f"qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS % 'text'}) AS q_term FROM benchmark)"


@query(f"""WITH {_INDEX}, {_ITEMS}, s AS (SELECT query_id, doc_id AS memory_id, sum({_BM}) * count(DISTINCT q_term) AS score FROM qt JOIN df ON q_term = df.term JOIN ps ON ps.term = df.term, st GROUP BY 1, 2),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {r('score')} DESC, memory_id) AS INTEGER) AS rank FROM s) SELECT query_id, memory_id, {r('score')} AS score, rank FROM t WHERE rank <= 10""")
def bm25_exact(spark, d):
    return _index(spark, d).search(text_queries(spark, d), 10, prefix=False, fuzzy=False).withColumn("score", r6(F.col("score")))


@query(f"""WITH {_INDEX}, {_ITEMS}, w AS (SELECT DISTINCT q_term, length(q_term) AS n, CAST(floor(length(q_term) * 0.2 + 0.5) AS INTEGER) AS e FROM qt),
  x AS (SELECT q_term, term, 1.0 AS tw FROM w JOIN df ON q_term = term UNION ALL SELECT q_term, term, 0.375 * length(term) / (length(term) + 0.3 * (length(term) - n)) FROM w JOIN df ON starts_with(term, q_term) AND length(term) > n
    UNION ALL SELECT q_term, term, 0.45 * length(term) / (length(term) + {_LEV}) FROM w JOIN df ON e > 0 AND term <> q_term AND abs(length(term) - n) <= e WHERE {_LEV} <= e),
  y AS (SELECT query_id, q_term, term, max(tw) AS tw FROM qt JOIN x USING (q_term) GROUP BY ALL),
  s AS (SELECT query_id, doc_id AS memory_id, sum(tw * {_BM}) * count(DISTINCT q_term) AS score FROM y JOIN df ON y.term = df.term JOIN ps ON ps.term = df.term, st GROUP BY 1, 2),
  t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {r('score', 5)} DESC, memory_id) AS INTEGER) AS rank FROM s) SELECT query_id, memory_id, {r('score', 5)} AS score, rank FROM t WHERE rank <= 10""")
def bm25_prefix_fuzzy(spark, d):
    return _index(spark, d).search(text_queries(spark, d), 10).withColumn("score", r6(F.col("score"), 5))


@query("SELECT namespace, count(*) AS n FROM (SELECT CASE WHEN source = 'src0' AND NOT regexp_matches(text, '[\\x{3130}-\\x{318F}\\x{AC00}-\\x{D7A3}]') THEN 'bench' ELSE source END AS namespace FROM documents) GROUP BY 1")
def quarantine(spark, d):
    docs = documents(spark, d).withColumn("namespace", F.when(F.col("namespace") == "src0", "default").otherwise(F.col("namespace"))).withColumn("source", F.lit(""))
    return maintain.quarantine(docs).groupBy("namespace").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') AS prefix, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS namespace FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') || '/en/', 'english' FROM pages)
  SELECT page_id, (SELECT arg_max(namespace, length(prefix)) FROM p WHERE url = prefix OR (starts_with(url, prefix) AND (ends_with(prefix, '/') OR substr(url, length(prefix) + 1, 1) = '/'))) AS namespace FROM pages""")
def namespace_prefix_map(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    root = F.regexp_extract("path", r"^[a-z]+://[^/]+", 0)
    prefixes = pages.select(root.alias("prefix"), F.regexp_extract("path", r"^[a-z]+://([^/]+)", 1).alias("namespace")).union(pages.select(F.concat(root, F.lit("/en/")), F.lit("english"))).distinct()
    best = recall.namespace_of(pages.select("path").distinct(), prefixes)
    return pages.join(best, "path").select("page_id", "namespace")


# ------------------------------------------------------------------ log and transcripts

_DELTAS = "CASE event_type WHEN 'purchase' THEN 0.1 WHEN 'view' THEN 0.05 WHEN 'error' THEN -0.2 END"


@query(f"WITH {LOG}, c AS (SELECT user_id, k, list(CAST({_DELTAS} AS DOUBLE) ORDER BY id) AS s FROM ev WHERE event_type IN ('purchase', 'view', 'error') GROUP BY 1, 2) SELECT user_id, k, CAST(len(s) AS BIGINT) AS n_events, {r('list_reduce(s, lambda w, x: greatest(0.1, least(3.0, w + x)), CAST(1.0 AS DOUBLE))')} AS weight FROM c")
def hebbian_fold(spark, d):
    return maintain.fold_weights(_changes(spark, d), by=("user_id", "k")).withColumn("weight", r6(F.col("weight")))


def _changes(spark, d):
    e = log(spark, d)
    kind = F.col("event_type")
    delta = F.when(kind == "purchase", 0.1).when(kind == "view", 0.05).when(kind == "error", -0.2)
    return e.where(kind.isin("purchase", "view", "error")).select("user_id", "k", F.col("id").alias("seq"), delta.alias("delta"))


#: Users as keys, numbers of events as memories; purchases, views and errors change links, views are reads.
_LOGGED = f"""WITH {LOG}, c AS (SELECT user_id, k, list(CAST({_DELTAS} AS DOUBLE) ORDER BY id) AS s FROM ev WHERE event_type IN ('purchase', 'view', 'error') GROUP BY 1, 2),
  w AS (SELECT user_id, k, {r('list_reduce(s, lambda w, x: greatest(0.1, least(3.0, w + x)), CAST(1.0 AS DOUBLE))')} AS weight FROM c),
  n AS (SELECT k, count(*) FILTER (event_type = 'view') AS n, max(ts) FILTER (event_type = 'view') AS seen FROM ev GROUP BY 1)
  SELECT user_id, k, coalesce(weight, 1.0) AS weight, CAST(n AS INTEGER) AS access_count, {r('least(1.0, n * CAST(0.05 AS DOUBLE))')} AS depth, round(seen, 3) AS last_accessed
  FROM (SELECT DISTINCT user_id, k FROM ev) JOIN n USING (k) LEFT JOIN w USING (user_id, k)"""


def _logged_graph(spark, d) -> dict[str, DataFrame]:
    pairs = log(spark, d).select(F.col("user_id").cast("string").alias("key_id"), F.col("k").cast("string").alias("memory_id")).distinct()
    return {
        "keys": conform(pairs.select("key_id").distinct().withColumn("concept", F.concat(F.lit("user "), "key_id")), KEYS),
        "memories": conform(pairs.select("memory_id").distinct(), MEMORIES),
        "links": conform(pairs, LINKS),
    }


def _log_rows(e: DataFrame) -> DataFrame:
    """Log rows of events (id, user_id, event_type, ts, k): at most two of an event."""
    kind = F.col("event_type")
    delta = F.when(kind == "purchase", 0.1).when(kind == "view", 0.05).when(kind == "error", -0.2)
    rows = e.where(kind.isin("purchase", "view", "error")).select(F.col("user_id").cast("string").alias("key_id"), F.col("k").cast("string").alias("memory_id"), F.col("id").alias("seq"), delta.alias("delta"), "ts", "event_type")
    return oplog.link_changes(rows).unionByName(oplog.reads(rows.where("event_type = 'view'")))


def _logged(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["links"].join(t["memories"].select("memory_id", "access_count", "depth", "last_accessed"), "memory_id")
    return rows.select(F.col("key_id").cast("long").alias("user_id"), F.col("memory_id").cast("long").alias("k"), r6(F.col("weight")).alias("weight"), "access_count", r6(F.col("depth")).alias("depth"), F.round("last_accessed", 3).alias("last_accessed"))


@query(_LOGGED)
def log_merge(spark, d):
    return _logged(oplog.merged(_log_rows(log(spark, d)), _logged_graph(spark, d)))


#: Reads against a stack of pending queries, event by event: a read takes the latest that none took, if it is fresh.
_MATCH = f"""
o AS MATERIALIZED (SELECT user_id, id, ts, k, event_type = 'view' AS is_read, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'view', id) AS n FROM ev WHERE event_type IN ('click', 'view')),
st(user_id, n, pending, read_id, ts, hit) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, ts DOUBLE, taken BOOLEAN)[]), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS STRUCT(id BIGINT, ts DOUBLE, taken BOOLEAN)) FROM o
  UNION ALL
  SELECT user_id, n, CASE WHEN NOT is_read THEN list_slice(list_append(pending, {{'id': id, 'ts': ts, 'taken': false}}), -32, 33) WHEN fresh THEN list_transform(pending, lambda x, i: {{'id': x.id, 'ts': x.ts, 'taken': x.taken OR i = p}}) ELSE pending END,
    CASE WHEN is_read THEN id END, ts, CASE WHEN fresh THEN pending[p] END
  FROM (SELECT *, is_read AND p IS NOT NULL AND ts - pending[p].ts <= {TTL} AS fresh
    FROM (SELECT s.user_id AS user_id, o.n AS n, s.pending AS pending, o.id AS id, o.ts AS ts, o.is_read AS is_read, list_max(list_filter(list_transform(s.pending, lambda x, i: CASE WHEN NOT x.taken THEN i END), lambda x: x IS NOT NULL)) AS p FROM st s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))),
mt AS (SELECT user_id, read_id, hit.id AS query_id, ts, ts - hit.ts AS delay FROM st WHERE hit IS NOT NULL)
"""


def _matches(spark, d):
    e = log(spark, d)
    return maintain.match_buffer(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], TTL)


@query(f"WITH RECURSIVE {LOG}, {_MATCH} SELECT user_id, read_id, query_id, round(delay + 1e-10, 6) AS delay FROM mt")
def recall_buffer_match(spark, d):
    return _matches(spark, d).select("user_id", "read_id", "query_id", r6(F.col("delay")).alias("delay"))


#: The same against one ring of the latest 32 queries of all users.
_RING = f"""
o AS MATERIALIZED (SELECT user_id, id, ts, event_type = 'view' AS is_read, row_number() OVER (ORDER BY ts, event_type = 'view', id) AS n FROM ev WHERE event_type IN ('click', 'view')),
st(n, pending, user_id, read_id, ts, hit) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(u BIGINT, id BIGINT, ts DOUBLE, taken BOOLEAN)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS STRUCT(u BIGINT, id BIGINT, ts DOUBLE, taken BOOLEAN))
  UNION ALL
  SELECT n, CASE WHEN NOT is_read THEN list_slice(list_append(pending, {{'u': user_id, 'id': id, 'ts': ts, 'taken': false}}), -32, 33) WHEN fresh THEN list_transform(pending, lambda x, i: {{'u': x.u, 'id': x.id, 'ts': x.ts, 'taken': x.taken OR i = p}}) ELSE pending END,
    user_id, CASE WHEN is_read THEN id END, ts, CASE WHEN fresh THEN pending[p] END
  FROM (SELECT *, is_read AND p IS NOT NULL AND ts - pending[p].ts <= {20 * TTL} AS fresh
    FROM (SELECT o.n AS n, s.pending AS pending, o.user_id AS user_id, o.id AS id, o.ts AS ts, o.is_read AS is_read, list_max(list_filter(list_transform(s.pending, lambda x, i: CASE WHEN NOT x.taken AND x.u = o.user_id THEN i END), lambda x: x IS NOT NULL)) AS p FROM st s JOIN o ON o.n = s.n + 1))),
mt AS (SELECT user_id, read_id, hit.id AS query_id, ts - hit.ts AS delay FROM st WHERE hit IS NOT NULL)
"""


@query(f"WITH RECURSIVE {LOG}, {_RING} SELECT user_id, read_id, query_id, round(delay + 1e-10, 6) AS delay FROM mt")
def recall_ring_match(spark, d):
    e = log(spark, d)
    rows = maintain.match_buffer(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], 20 * TTL, one_ring=True)
    return rows.select("user_id", "read_id", "query_id", r6(F.col("delay")).alias("delay"))


_TAUGHT = dataclasses.replace(CONFIG, profile=PROFILES["bgem3"], promote_n=2, max_aliases=2)


@query(f"""WITH RECURSIVE {LOG}, {_MATCH},
  cf AS (SELECT mt.user_id AS user_id, read_id, mt.ts AS ts, CASE e.k % 5 WHEN 0 THEN 'a longer question about' ELSE 'topic' END || ' ' || e.k % 10 AS query, (e.id * 7 % 100) / 100.0 AS cosine FROM mt JOIN ev e ON e.id = query_id),
  cn AS (SELECT *, row_number() OVER (PARTITION BY user_id, query ORDER BY ts, read_id) AS n FROM cf WHERE query <> 'topic 3'),
  cw AS (SELECT *, CASE WHEN n < 2 OR query LIKE 'a longer%' THEN 'none' WHEN cosine + 1e-10 >= 0.86 THEN 'alias' WHEN cosine + 1e-10 >= 0.62 THEN 'newKey' WHEN cosine + 1e-10 >= 0.45 THEN 'alias' ELSE 'none' END AS would FROM cn),
  cd AS (SELECT user_id, query, coalesce(min(n) FILTER (would <> 'none'), max(n)) AS n_confirmed FROM cw GROUP BY 1, 2),
  ce AS (SELECT cd.*, would, ts, read_id FROM cd JOIN cw ON cw.user_id = cd.user_id AND cw.query = cd.query AND cw.n = n_confirmed)
  SELECT user_id AS key_id, query, n_confirmed, CASE WHEN would = 'alias' AND (SELECT count(*) FROM ce o WHERE o.user_id = ce.user_id AND o.would = 'alias' AND (o.ts, o.read_id) < (ce.ts, ce.read_id)) >= 2 THEN 'none' ELSE would END AS decision FROM ce""")
def alias_promotion(spark, d):
    e = log(spark, d).select(F.col("id").alias("query_id"), F.concat(F.when(F.col("k") % 5 == 0, "a longer question about").otherwise("topic"), F.lit(" "), (F.col("k") % 10).cast("string")).alias("query"), (F.col("id") * 7 % 100 / 100.0).alias("cosine"))
    confirmed = _matches(spark, d).join(e, "query_id").select(F.col("user_id").alias("key_id"), F.col("read_id").alias("memory_id"), "query", "cosine", "ts", "read_id")
    known = log(spark, d).select(F.col("user_id").alias("key_id")).distinct().select("key_id", F.lit("user").alias("concept"), F.array(F.lit("Topic 3")).alias("aliases"))
    return maintain.learn_aliases(confirmed, known, _TAUGHT).select("key_id", "query", "n_confirmed", "decision")


@query("WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) // 2 AS center FROM conversations) SELECT conv_id AS session_id, turn, role, CAST(pos AS INTEGER) AS pos FROM t WHERE abs(pos - center) <= 2")
def turn_window(spark, d):
    t = turns(spark, d)
    middle = t.groupBy("session_id").agg(F.floor(F.count("*") / 2).alias("center"))
    return transcripts.window(t, middle).select("session_id", "turn", "role", "pos")


@query("SELECT conv_id AS session_id, count(*) AS n_turns, count(*) - 1 AS last_turn, arg_min(substr(text, 1, 80), turn) FILTER (role = 'user') AS preview FROM conversations GROUP BY 1")
def list_sessions(spark, d):
    return transcripts.sessions(turns(spark, d))


@query("SELECT conv_id AS session_id, count(*) AS next_turn FROM conversations GROUP BY 1")
def next_turn(spark, d):
    return transcripts.next_turns(turns(spark, d))


@query("SELECT conv_id AS session_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS new_turn FROM conversations WHERE role <> 'system'")
def transcript_renumber(spark, d):
    return transcripts.renumber(turns(spark, d), keep=F.col("role") != "system").select("session_id", "turn", "role", "new_turn")


# ------------------------------------------------------------------ evaluation

_ACTUAL = "pr AS (SELECT sim, la = lb AS shared, CASE WHEN la = lb AND (a + b) % 3 = 0 THEN 'duplicate' WHEN la = lb THEN 'contradiction' ELSE 'independent' END AS actual FROM ab WHERE sim + 1e-10 >= 0.2)"


def _judged(spark, d):
    p = _pairs(spark, d, 0.2)
    same = F.col("la") == F.col("lb")
    return p.select("sim", same.alias("shared"), F.when(same & ((F.col("a") + F.col("b")) % 3 == 0), "duplicate").when(same, "contradiction").otherwise("independent").alias("actual"))


def _guess(floor: str, cut: str) -> str:
    return f"CASE WHEN sim + 1e-10 >= {cut} THEN 'duplicate' WHEN sim + 1e-10 >= {floor} AND shared THEN 'contradiction' ELSE 'independent' END"


@query(f"""WITH {VECTORS}, {_ALL}, {_ACTUAL}, g AS (SELECT actual, {_guess('0.3', '0.42')} AS predicted FROM pr), c(relation) AS (VALUES ('duplicate'), ('contradiction'), ('independent')),
  t AS (SELECT relation, count(*) FILTER (predicted = relation AND actual = relation) AS tp, count(*) FILTER (predicted = relation AND actual <> relation) AS fp, count(*) FILTER (predicted <> relation AND actual = relation) AS fn FROM g, c GROUP BY 1),
  u AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM t)
  SELECT relation, tp, fp, fn, {r('p')} AS precision, {r('q')} AS recall, {r('coalesce(2 * p * q / nullif(p + q, 0), 0)')} AS f1 FROM u""")
def calibration_prf(spark, d):
    p = _judged(spark, d).withColumn("predicted", evaluate.classify(F.col("sim"), F.col("shared"), 0.3, 0.42))
    return evaluate.prf(p).select("relation", "tp", "fp", "fn", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


_FLOORS, _CUTS = [0.25, 0.3, 0.35], [0.3, 0.36, 0.42]


@query(f"""WITH {VECTORS}, {_ALL}, {_ACTUAL}, fl(floor) AS (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in _FLOORS)}), cu(cut) AS (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in _CUTS)}),
  g AS (SELECT floor, cut, actual, {_guess('floor', 'cut')} AS predicted FROM pr, fl, cu WHERE floor < cut), c(relation) AS (VALUES ('duplicate'), ('contradiction'), ('independent')),
  t AS (SELECT floor, cut, relation, count(*) FILTER (predicted = relation AND actual = relation) AS tp, count(*) FILTER (predicted = relation AND actual <> relation) AS fp, count(*) FILTER (predicted <> relation AND actual = relation) AS fn FROM g, c GROUP BY ALL),
  u AS (SELECT floor, cut, relation, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM t)
  SELECT floor, cut, {r('avg(f1)')} AS macro_f1, {r("min(f1) FILTER (relation <> 'independent')")} AS min_f1 FROM u GROUP BY 1, 2""")
def threshold_sweep(spark, d):
    return evaluate.sweep(_judged(spark, d), _FLOORS, _CUTS).select("floor", "cut", r6(F.col("macro_f1")).alias("macro_f1"), r6(F.col("min_f1")).alias("min_f1"))


@query(f"WITH {VECTORS}, {_ALL}, {_ACTUAL} SELECT {r('0.95 * avg(CASE WHEN ' + _guess('0.3', '0.42') + chr(32) + '<> ' + chr(39) + 'independent' + chr(39) + ' THEN 1.0 ELSE 0.0 END)')} AS fp_rate FROM pr WHERE actual = 'independent'")
def prior_weighted_fp(spark, d):
    p = _judged(spark, d).withColumn("predicted", evaluate.classify(F.col("sim"), F.col("shared"), 0.3, 0.42))
    return evaluate.prior_weighted_fp(p).select(r6(F.col("fp_rate")).alias("fp_rate"))


_RANKED = f"rk AS (SELECT query_id, memory_id AS item_id, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r('sim')} DESC, memory_id) AS rank FROM qm WHERE query_id <> memory_id) WHERE rank <= 10), rl AS (SELECT query_id, y.vec_id AS item_id FROM q JOIN v x ON x.vec_id = query_id JOIN v y ON y.label = x.label AND y.vec_id <> x.vec_id)"


def _run(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = q.join(e.select(F.col("vec_id").alias("item_id"), "label"), "label").where("query_id <> item_id").select("query_id", "item_id")
    return _nearest(spark, d, 10).select("query_id", "rank", F.col("memory_id").alias("item_id")), relevant, q


@query(f"""WITH {VECTORS}, {_RANKED}, h AS (SELECT query_id, min(rank) AS first_rank, count(*) FILTER (rank <= 5) AS in5 FROM rk SEMI JOIN rl USING (query_id, item_id) GROUP BY 1), n AS (SELECT query_id, count(*) AS n_relevant FROM rl GROUP BY 1)
  SELECT q.query_id AS query_id, coalesce(n_relevant, 0) AS n_relevant, CAST(first_rank AS INTEGER) AS first_rank, CAST(coalesce(first_rank = 1, false) AS INTEGER) AS hit1, {r('coalesce(in5 / nullif(n_relevant, 0), 0)')} AS recall5, CAST(coalesce(first_rank <= 5, false) AS INTEGER) AS hit5,
    CAST(coalesce(first_rank <= 10, false) AS INTEGER) AS reach10, CAST(coalesce(in5 = n_relevant, false) AS INTEGER) AS both5, {r('coalesce(1.0 / first_rank, 0)')} AS mrr FROM q LEFT JOIN h ON h.query_id = q.query_id LEFT JOIN n ON n.query_id = q.query_id""")
def ranking_metrics(spark, d):
    m = evaluate.query_metrics(*_run(spark, d))
    return m.select("query_id", "n_relevant", "first_rank", "hit1", r6(F.col("recall5")).alias("recall5"), "hit5", "reach10", "both5", r6(F.col("mrr")).alias("mrr"))


@query(f"WITH {VECTORS}, {_RANKED}, c(n) AS (VALUES (2), (3), (5), (8), (10)) SELECT n, count(*) FILTER (EXISTS (SELECT 1 FROM rl WHERE rl.query_id = rk.query_id AND rl.item_id = rk.item_id)) AS found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rl WHERE rl.query_id = rk.query_id AND rl.item_id = rk.item_id)) AS noise FROM rk, c WHERE rank <= n GROUP BY 1")
def noise_sweep(spark, d):
    ranked, relevant, _ = _run(spark, d)
    return evaluate.noise_at(ranked, relevant)


# ------------------------------------------------------------------ streams


def _drained(spark: SparkSession, stream: DataFrame, key: list[str] | None = None, version: str | None = None) -> DataFrame:
    """Run a stream over what is there now; its output as a table in the shared folder. key and version: of a stream of
    updates the row of highest version for each key."""
    path = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if key is None:
        q = writer.format("parquet").option("path", f"{path}/rows").outputMode("append").start()
    else:  # each batch writes its own folder, again if it is run again
        q = writer.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")).start()
    q.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if key is None:
        return rows
    rest = [c for c in schema.names if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("last")).select(*key, *(F.col(f"last.{c}").alias(c) for c in rest))


def _event_stream(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = f"{d}/events.parquet*"
    e = spark.readStream.schema(schema).parquet(folder)
    return e.withColumn("t", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(f"WITH RECURSIVE {LOG}, {_MATCH} SELECT user_id, read_id, query_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, read_id) AS n_confirmed FROM mt")
def stream_autokey(spark, d):
    e = _event_stream(spark, d).where("event_type IN ('click', 'view')")
    rows = e.select("user_id", F.when(F.col("event_type") == "click", "query").otherwise("read").alias("kind"), F.col("t").alias("ts"), F.col("event_id").alias("id"))
    return _drained(spark, stateful.confirm_stream(rows, ttl=TTL))


@query(f"SELECT * FROM ({ORACLES['alias_promotion'].replace('WHEN n < 2 OR', 'WHEN n < 1 OR')}) WHERE decision <> 'none'")
def stream_promotion(spark, d):
    e = _event_stream(spark, d).where("event_type IN ('click', 'view')")
    text = F.concat(F.when(F.col("k") % 5 == 0, "a longer question about").otherwise("topic"), F.lit(" "), (F.col("k") % 10).cast("string"))
    rows = e.select(F.col("user_id").alias("key_id"), F.when(F.col("event_type") == "click", "query").otherwise("read").alias("kind"), F.col("t").alias("ts"), F.col("event_id").alias("id"), text.alias("query"), (F.col("event_id") * 7 % 100 / 100.0).alias("cosine"))
    known = log(spark, d).select(F.col("user_id").alias("key_id")).distinct().select("key_id", F.lit("user").alias("concept"), F.array(F.lit("Topic 3")).alias("aliases"))
    return _drained(spark, stateful.promote_stream(rows, known, ttl=TTL, config=dataclasses.replace(_TAUGHT, promote_n=1))).select("key_id", "query", "n_confirmed", "decision")


@query(ORACLES["hebbian_fold"])
def stream_hebbian(spark, d):
    kind = F.col("event_type")
    delta = F.when(kind == "purchase", 0.1).when(kind == "view", 0.05).when(kind == "error", -0.2)
    e = _event_stream(spark, d).where(kind.isin("purchase", "view", "error")).select("user_id", "k", F.col("event_id").alias("seq"), delta.alias("delta"))
    return _drained(spark, stateful.fold_stream(e, ["user_id", "k"]), ["user_id", "k"], "n_events").withColumn("weight", r6(F.col("weight")))


@query(ORACLES["log_merge"])
def stream_log(spark, d):
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = Store(spark, path)
    store.save(_logged_graph(spark, d))
    e = _event_stream(spark, d).select(F.col("event_id").alias("id"), "user_id", "event_type", (F.unix_micros("t") / 1e6).alias("ts"), "k")
    log_stream(_log_rows(e), store, "events", f"{path}-state", compact_every=0, once=True).awaitTermination()
    return _logged(store.load())


@query("""WITH e AS (SELECT user_id, epoch(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 7200 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, fresh) AS n FROM g)
  SELECT user_id, round(min(t), 3) AS start, round(max(t) + 7200, 3) AS end, count(*) AS n_events FROM s GROUP BY user_id, n HAVING max(t) + 7200 <= (SELECT max(t) - 3600 FROM e)""")
def stream_idle_sessions(spark, d):
    e = _event_stream(spark, d).select("user_id", F.col("t").alias("ts"))
    rows = _drained(spark, stateful.idle_sessions(e, gap="2 hours"))
    at = lambda c: F.round(F.unix_micros(c) / 1e6, 3)
    return rows.select("user_id", at("start").alias("start"), at("end").alias("end"), "n_events")
