"""The operation log: what reads change, as rows to add rather than tables to rewrite.

Four kinds of rows (see `LOG`): `link` moves a link's weight by delta, clamped in the order of seq; `read` makes a memory
deeper and counts an access at ts; `learned` gives a key a new alias at ts; `use` counts a hit of an alias that was learned.
`merged` folds any number of rows into the tables that they change; batches of rows may come in any order, as seq
orders those that don't commute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..schema import conform
from .maintain import apply_aliases, count_alias_hits, fold_weights, set_weights

DEFAULT = Config()
LOG = "kind string, key_id string, memory_id string, alias string, seq bigint, delta double, ts double"


def _rows(df: DataFrame, kind: str) -> DataFrame:
    return conform(df.withColumn("kind", F.lit(kind)), LOG)


def link_changes(rows: DataFrame) -> DataFrame:
    """Log rows of changes (key_id, memory_id, seq, delta) of link weights."""
    return _rows(rows.select("key_id", "memory_id", "seq", "delta"), "link")


def reads(rows: DataFrame) -> DataFrame:
    """Log rows of reads (memory_id, ts), a row each."""
    return _rows(rows.select("memory_id", "ts"), "read")


def lessons(rows: DataFrame) -> DataFrame:
    """Log rows of names (key_id, alias, ts) that keys learned."""
    return _rows(rows.select("key_id", "alias", "ts"), "learned")


def uses(rows: DataFrame) -> DataFrame:
    """Log rows of texts (key_id, alias) that named a key by an alias, a row each."""
    return _rows(rows.select("key_id", "alias"), "use")


def read_again(memories: DataFrame, log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """memories after the reads of a log: each deeper by one step a read, up to 1, counted, and seen at the latest."""
    n = log.where("kind = 'read'").groupBy("memory_id").agg(F.count("*").cast("int").alias("_n"), F.max("ts").alias("_at"))
    seen = F.col("_n").isNotNull()
    new = {"depth": F.least(F.lit(1.0), F.col("depth") + F.col("_n") * config.depth_step), "access_count": (F.col("access_count") + F.col("_n")).cast("int"), "last_accessed": F.greatest("last_accessed", "_at")}
    return memories.join(n, "memory_id", "left").withColumns({c: F.when(seen, v).otherwise(F.col(c)) for c, v in new.items()}).select(memories.columns)


def taught(keys: DataFrame, log: DataFrame) -> DataFrame:
    """keys with the names that a log tells, each once and only where the key hasn't got it, earliest first; then with
    the hits of learned names."""
    names = log.where("kind = 'learned' AND alias IS NOT NULL").withColumn("name", F.lower("alias"))
    first = Window.partitionBy("key_id", "name").orderBy("ts", "alias")
    names = names.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    own = keys.select("key_id", F.lower("concept").alias("_c"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower).alias("_a"))
    fresh = names.join(own, "key_id").where((F.col("name") != F.col("_c")) & ~F.array_contains("_a", F.col("name")))
    learned = fresh.select("key_id", "name", F.col("alias").alias("query"), F.lit("alias").alias("decision"), F.lit(0).alias("n_confirmed"), "ts")
    return count_alias_hits(apply_aliases(keys, learned), log.where("kind = 'use' AND alias IS NOT NULL").select("key_id", "alias"))


def merged(log: DataFrame, tables: dict[str, DataFrame], config: Config = DEFAULT) -> dict[str, DataFrame]:
    """keys, links and memories (of `tables`) after a log. Rows about what doesn't exist change nothing."""
    changes = log.where("kind = 'link'").select("key_id", "memory_id", "seq", "delta")
    known = changes.join(tables["links"].select("key_id", "memory_id"), ["key_id", "memory_id"], "left_semi")
    folded = fold_weights(known, tables["links"], config=config).select("key_id", "memory_id", "weight")
    return {**tables, "links": set_weights(tables["links"], folded, config), "memories": read_again(tables["memories"], log, config), "keys": taught(tables["keys"], log)}
