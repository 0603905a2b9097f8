"""The tables of a memory graph. `seq` is insertion order: every ranking ends in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = (
    "key_id string, concept string, aliases array<string>, key_type string, embedding array<float>, "
    "alias_candidates map<string, struct<count: int, last_seen: double, query_text: string>>, "
    "learned_aliases array<struct<alias: string, added_at: double, hits: int>>, seq bigint"
)
MEMORIES = (
    "memory_id string, content string, embedding array<float>, created_at double, source string, supersedes string, depth double, "
    "access_count int, last_accessed double, namespace string, ttl double, links array<string>, contradicts array<string>, seq bigint"
)
LINKS = "key_id string, memory_id string, weight double"
SENTENCES = "memory_id string, sent_idx int, embedding array<float>"
TURNS = "session_id string, turn int, role string, content string, ts double"
PAIRS = "id string, a string, b string, keys_a array<string>, keys_b array<string>, relation string, confidence string, split string"

_DEFAULTS = {"depth": 0.0, "access_count": 0, "namespace": "default"}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns: missing ones are null, memory fields get their defaults."""
    cols = []
    for f in T.StructType.fromDDL(schema).fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if schema == MEMORIES and f.name in _DEFAULTS:
            c = F.coalesce(c, F.lit(_DEFAULTS[f.name]).cast(f.dataType))
        if schema == MEMORIES and f.name in ("links", "contradicts"):
            c = F.coalesce(c, F.array().cast(f.dataType))
        if schema == MEMORIES and f.name == "last_accessed" and "created_at" in df.columns:
            c = F.coalesce(c, F.col("created_at").cast("double"))
        if schema == LINKS and f.name == "weight":
            c = F.coalesce(c, F.lit(1.0))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def prune_links(links: DataFrame, keys: DataFrame, memories: DataFrame) -> DataFrame:
    """Links both of whose ends exist."""
    return links.join(keys.select("key_id"), "key_id", "left_semi").join(memories.select("memory_id"), "memory_id", "left_semi").select(links.columns)


def prune_keys(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Keys that some link uses."""
    return keys.join(links.select("key_id"), "key_id", "left_semi")
