"""Maintenance: forgetting, expiry, healing of fragmented keys, reinforcement, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import at_least, clamp_weight
from ..functions.text import has_hangul, short_concept
from .durable import dealt
from .fold import after, counted, in_order, stretches
from .graph import expired

DEFAULT = Config()


def forget(ids: DataFrame, keys: DataFrame, links: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """Tables without the memories `ids` (memory_id), references to them and keys left without links. A
    predecessor of a forgotten memory is current again, as nothing supersedes it any more."""
    gone = dealt(ids.select("memory_id"), "memory_id").distinct()
    kept = memories.join(gone, "memory_id", "left_anti")
    refs = kept.select("memory_id", F.explode(F.array_union("links", "contradicts")).alias("ref")).join(gone.select(F.col("memory_id").alias("ref")), "ref", "left_semi")
    lost = refs.groupBy("memory_id").agg(F.collect_set("ref").alias("lost"))
    kept = kept.join(lost, "memory_id", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    kept = kept.withColumn("links", F.array_except("links", "lost")).withColumn("contradicts", F.array_except("contradicts", "lost")).drop("lost").select(memories.columns)
    left = links.join(gone, "memory_id", "left_anti").select(links.columns)
    return {"memories": kept, "links": left, "keys": keys.join(left.select("key_id"), "key_id", "left_semi")}


def cleanup_expired(keys: DataFrame, links: DataFrame, memories: DataFrame, now: float, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """Tables without expired memories, and keys without learned aliases that no one used and alias
    candidates that no one repeated for `prune_age`."""
    out = forget(memories.where(expired(F.col("ttl"), now)), keys, links, memories)
    limit = F.lit(float(now) - config.prune_age)
    if "learned_aliases" in keys.columns:
        stale = F.filter("learned_aliases", lambda a: (a["hits"] == 0) & (a["added_at"] <= limit))
        k = out["keys"].withColumn("_stale", F.coalesce(F.transform(stale, lambda a: a["alias"]), F.array().cast("array<string>")))
        k = k.withColumn("aliases", F.array_except("aliases", "_stale")).withColumn("learned_aliases", F.filter("learned_aliases", lambda a: (a["hits"] > 0) | (a["added_at"] > limit))).drop("_stale")
        out["keys"] = k.withColumn("alias_candidates", F.map_filter("alias_candidates", lambda _, v: v["last_seen"] > limit))
    return out


def heal_keys(keys: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping: key_id, canonical_id; links): keys of one concept, whatever the case, become one: an entity
    key if there is one, else the one with most links, else the earliest. Merged links keep the heavier weight."""
    n = links.groupBy("key_id").agg(F.count("*").alias("n"))
    rows = keys.select("key_id", F.lower("concept").alias("c"), F.col("key_type").isin("name", "proper_noun").alias("entity"), "seq").join(n, "key_id", "left")
    best = rows.groupBy("c").agg(F.max(F.struct("entity", F.coalesce("n", F.lit(0)).alias("n"), (-F.col("seq")).alias("o"), "key_id"))["key_id"].alias("canonical_id"))
    mapping = rows.join(best, "c").select("key_id", "canonical_id")
    merged = links.join(mapping, "key_id").groupBy(F.col("canonical_id").alias("key_id"), "memory_id").agg(F.max("weight").alias("weight"))
    return mapping, merged


def upsert_links(links: DataFrame, wanted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """links plus those of `wanted` (key_id, memory_id) that don't exist, at the default weight."""
    fresh = wanted.select("key_id", "memory_id").distinct().join(links.select("key_id", "memory_id"), ["key_id", "memory_id"], "left_anti")
    return links.select("key_id", "memory_id", "weight").unionByName(fresh.withColumn("weight", F.lit(config.weight_default)))


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    """links without those of `gone` (key_id, memory_id, or memory_id alone: all of a memory's)."""
    on = [c for c in ("key_id", "memory_id") if c in gone.columns]
    return links.join(gone.select(on).distinct(), on, "left_anti").select(links.columns)


def set_weights(links: DataFrame, wanted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """links with new weights (key_id, memory_id, weight), clamped; links that don't exist aren't made."""
    new = wanted.select("key_id", "memory_id", clamp_weight(F.col("weight"), config).alias("_new"))
    return links.join(new, ["key_id", "memory_id"], "left").withColumn("weight", F.coalesce("_new", "weight")).select(links.columns)


def touch(memories: DataFrame, read: DataFrame, now: float, config: Config = DEFAULT) -> DataFrame:
    """memories after reads of `read` (memory_id, a row a read): deeper, counted, seen now."""
    n = read.groupBy("memory_id").agg(F.count("*").cast("int").alias("_n"))
    seen = F.col("_n").isNotNull()
    deeper = F.least(F.lit(1.0), F.col("depth") + F.col("_n") * config.depth_step)
    rows = memories.join(n, "memory_id", "left").withColumns({"access_count": F.when(seen, F.col("access_count") + F.col("_n")).otherwise(F.col("access_count")), "last_accessed": F.when(seen, F.lit(float(now))).otherwise(F.col("last_accessed")), "depth": F.when(seen, deeper).otherwise(F.col("depth"))})
    return rows.select(memories.columns)


def fold_weights(events: DataFrame, links: DataFrame | None = None, by: tuple[str, ...] = ("key_id", "memory_id"), config: Config = DEFAULT) -> DataFrame:
    """(*by, n_events, weight): link weights after an ordered series of changes (*by, seq, delta), clamped after each one.

    Changes of one link are folded in the order of seq, as triples that ranges of the log make of them, so that a link may
    have any number of changes (see `fold`). Links without a weight begin with the default one."""
    rows = in_order(stretches(events, list(by), config.weight_min, config.weight_max), list(by))
    start = F.lit(config.weight_default)
    if links is not None:
        rows = rows.join(links.select(*by, F.col("weight").alias("_start")), list(by), "left")
        start = F.coalesce("_start", start)
    return rows.select(*by, "n_events", after(F.col("parts"), start).alias("weight"))


def recall_reinforcement(results: DataFrame, key_hits: DataFrame, links: DataFrame, alive: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key_id, memory_id, delta) of one recall: the matched keys of the top row gain, the same keys' active links
    to memories that weren't returned decay. results: (query_id, rank, memory_id); key_hits: (query_id, key_id)."""
    top = results.where("rank = 1").select("query_id", "memory_id")
    hit = key_hits.join(links.select("key_id", "memory_id"), "key_id")
    gain = hit.join(top, ["query_id", "memory_id"], "left_semi").select("key_id", "memory_id", F.lit(config.reinforce).alias("delta"))
    fed = hit.join(top, ["query_id", "memory_id"], "left_semi").select("query_id", "key_id").distinct()
    other = hit.join(fed, ["query_id", "key_id"], "left_semi").join(alive.select("memory_id"), "memory_id", "left_semi").join(results.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    loss = other.select("key_id", "memory_id", F.lit(-config.decay).alias("delta"))
    return gain.unionByName(loss).groupBy("key_id", "memory_id").agg(F.sum("delta").alias("delta"))


def match_buffer(asked: DataFrame, reads: DataFrame, by: list[str], ttl: float, config: Config = DEFAULT, one_ring: bool = False) -> DataFrame:
    """(*by, read_id, query_id, ts, delay): reads that confirm a query about the same thing. Both have `by`, ts
    (seconds) and an id.

    In the order of time a read takes the latest query that no read took before, if that is at most `ttl`
    seconds old and among the `buffer_size` latest queries. Queries open and reads close like brackets: the
    depth of nesting, a running sum over its running minimum, tells which belong together, so two windows
    do and no pairs are made. A read that finds nothing fresh confirms nothing, and so do later ones
    until a new query comes, as what lies deeper is older still. one_ring: the latest queries are those of all
    things together, counted in one order, rather than those of the same thing.
    """
    both = asked.select(*by, "ts", F.col("id").alias("query_id"), F.lit(None).cast("long").alias("read_id")).unionByName(reads.select(*by, "ts", F.lit(None).cast("long").alias("query_id"), F.col("id").alias("read_id")))
    order = ["ts", F.col("read_id").isNotNull(), F.coalesce("query_id", "read_id")]
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_query = F.col("query_id").isNotNull()
    if one_ring:
        both = both.withColumns({"_read": ~is_query, "_id": F.coalesce("query_id", "read_id"), "_query": is_query})
        both = counted(both, ["ts", "_read", "_id"], "_query").drop("_read", "_id", "_query")
    else:
        both = both.withColumn("nth", F.sum(is_query.cast("long")).over(past))
    rows = both.withColumn("sum", F.sum(F.when(is_query, 1).otherwise(-1)).over(past))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(past)))
    # a read at a new minimum closes nothing; else a query and its read have one level, and take turns there
    before = F.lag("low", 1, 0).over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("lost", ~is_query & (F.col("low") < before)).where(~F.col("lost"))
    rows = rows.withColumn("level", F.col("sum") - F.col("low") + F.when(is_query, 0).otherwise(1))
    turn = Window.partitionBy(*by, "low", "level").orderBy(*order)
    rows = rows.withColumn("open", F.lag(F.struct("ts", "query_id", "nth")).over(turn))
    hits = rows.where(~is_query & (F.col("ts") - F.col("open.ts") <= ttl) & (F.col("nth") - F.col("open.nth") < config.buffer_size))
    return hits.select(*by, "read_id", F.col("open.query_id").alias("query_id"), "ts", (F.col("ts") - F.col("open.ts")).alias("delay"))


def promotion(count: Column, query: Column, cosine: Column, learned: Column, config: Config = DEFAULT) -> Column:
    """What `count` confirmed queries make of a key: `alias`, `newKey` or `none`. Only short concepts count; a
    near one becomes an alias, a fairly near one a key of its own, and one below that, but above the
    confirmation floor, an alias too. A key learns `max_aliases` at most."""
    p = config.profile
    alias = F.when(learned < config.max_aliases, "alias").otherwise("none")
    band = F.when(at_least(cosine, p.key_merge), alias).when(at_least(cosine, p.key_autolink), "newKey").when(at_least(cosine, config.confirm_floor), alias).otherwise("none")
    return F.when((count >= config.promote_n) & short_concept(query), band).otherwise("none")


def learn_aliases(confirmed: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key_id, name, query, memory_id, n_confirmed, decision, ts) of each key and query text that some read
    confirmed (key_id, memory_id, query, cosine, ts, read_id): what the first confirmation that decides makes of
    it, else `none` as of the last. Texts that the key has as concept or alias already, or of under two
    characters, teach nothing. A key's new aliases are counted in the order of time, with those that it has
    learned before."""
    rows = confirmed.withColumn("query", F.trim("query")).withColumn("name", F.lower("query")).where(F.length("query") >= 2)
    known = keys.select("key_id", "concept", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), *([F.size(F.coalesce("learned_aliases", F.expr("array()"))).alias("learned")] if "learned_aliases" in keys.columns else [F.lit(0).alias("learned")]), *(["alias_candidates"] if "alias_candidates" in keys.columns else []))
    rows = rows.join(known, "key_id").where((F.lower("concept") != F.col("name")) & ~F.exists("aliases", lambda a: F.lower(a) == F.col("name")))
    had = F.coalesce(F.element_at("alias_candidates", F.col("name"))["count"], F.lit(0)) if "alias_candidates" in known.columns else F.lit(0)
    order = ["ts", "read_id"]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("key_id", "name").orderBy(*order)) + had)
    # whether there is room for an alias depends on the key's earlier ones; what it would be otherwise doesn't
    rows = rows.withColumn("would", promotion(F.col("n"), F.col("query"), F.col("cosine"), F.lit(0), config))
    at = F.when(F.col("would") != "none", F.struct("ts", "read_id", "would", "query", "memory_id", "n"))
    last = F.max(F.struct("ts", "read_id", F.lit("none").alias("would"), "query", "memory_id", "n"))
    one = rows.groupBy("key_id", "name").agg(F.coalesce(F.min(at), last).alias("d"), F.first("learned").alias("learned"))
    one = one.select("key_id", "name", "learned", "d.*")
    turn = Window.partitionBy("key_id").orderBy(F.col("would") != "alias", "ts", "read_id", "name")
    room = F.col("learned") + F.row_number().over(turn) <= config.max_aliases
    decision = F.when((F.col("would") == "alias") & ~room, "none").otherwise(F.col("would"))
    return one.select("key_id", "name", "query", "memory_id", F.col("n").cast("long").alias("n_confirmed"), decision.alias("decision"), "ts")


def apply_aliases(keys: DataFrame, learned: DataFrame) -> DataFrame:
    """keys with what `learn_aliases` decided: new aliases, remembered as learned, and the counts of texts that
    are still candidates."""
    taught = learned.where("decision = 'alias'").groupBy("key_id").agg(F.array_sort(F.collect_list(F.struct("ts", "query"))).alias("taught"))
    open_ = learned.where("decision = 'none'").groupBy("key_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.col("n_confirmed").cast("int").alias("count"), F.col("ts").alias("last_seen"), F.col("query").alias("query_text"))))).alias("open"))
    done = learned.where("decision <> 'none'").groupBy("key_id").agg(F.collect_set("name").alias("done"))
    rows = keys.join(taught, "key_id", "left").join(open_, "key_id", "left").join(done, "key_id", "left")
    none = F.array().cast("array<string>")
    fresh = F.coalesce(F.transform("taught", lambda t: F.struct(t["query"].alias("alias"), t["ts"].alias("added_at"), F.lit(0).alias("hits"))), F.array().cast("array<struct<alias:string,added_at:double,hits:int>>"))
    aliases = F.concat(F.coalesce("aliases", none), F.transform(fresh, lambda t: t["alias"]))
    kind = "map<string,struct<count:int,last_seen:double,query_text:string>>"
    empty = F.from_json(F.lit("{}"), kind)
    old = F.map_filter(F.coalesce("alias_candidates", empty), lambda k, _: ~F.array_contains(F.coalesce("done", none), k) & ~F.map_contains_key(F.coalesce("open", empty), k))
    return rows.withColumns({"aliases": aliases, "learned_aliases": F.concat(F.coalesce("learned_aliases", F.array().cast("array<struct<alias:string,added_at:double,hits:int>>")), fresh), "alias_candidates": F.map_concat(old, F.coalesce("open", empty))}).select(keys.columns)


def count_alias_hits(keys: DataFrame, literal: DataFrame) -> DataFrame:
    """keys whose learned aliases count one hit more for each query that named them (literal: key_id, alias)."""
    n = literal.groupBy("key_id", F.lower("alias").alias("a")).agg(F.count("*").cast("int").alias("n")).groupBy("key_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("_hits"))
    more = F.transform("learned_aliases", lambda a: F.struct(a["alias"].alias("alias"), a["added_at"].alias("added_at"), (a["hits"] + F.coalesce(F.element_at("_hits", F.lower(a["alias"])), F.lit(0))).cast("int").alias("hits")))
    return keys.join(n, "key_id", "left").withColumn("learned_aliases", F.when(F.col("_hits").isNotNull(), more).otherwise(F.col("learned_aliases"))).select(keys.columns)


def quarantine(memories: DataFrame, label: str = "bench") -> DataFrame:
    """Default-namespace memories without source and without Hangul move to another namespace."""
    odd = (F.col("namespace") == "default") & (F.coalesce("source", F.lit("")).isin("", "{}")) & ~has_hangul(F.col("content"))
    return memories.withColumn("namespace", F.when(odd, label).otherwise(F.col("namespace")))
