"""Key search and key-wise reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import at_least, depth_factor, round3, time_factor
from ..functions.text import literal_match, short_concept
from ..functions.similarity import similar
from .durable import dealt
from .graph import active, key_counts

DEFAULT = Config()


#: Stands in every text, and for terms without a token.
_ANYWHERE = "\x00"


def literal_candidates(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, key_id, term, is_alias): the pairs of query texts and names of keys that share the name's
    rarest token, counted over the query texts: a word that all names begin with brings none of them together, and
    names with a token that no text has meet none. Texts stay behind: their tokens alone are dealt, and of those only the
    ones that names have."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    named = keys.select("key_id", F.explode(F.array_union(F.array("concept"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"), F.col("concept").alias("c"))
    own = tokens(F.col("term"))
    named = named.select("key_id", "term", (F.lower("term") != F.lower("c")).alias("is_alias"), F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(_ANYWHERE)))).alias("token"))
    asked = queries.select("query_id", F.explode(F.array_union(tokens(F.col("query")), F.array(F.lit(_ANYWHERE)))).alias("token")).join(named.select("token").distinct(), "token", "left_semi")
    spread_ = asked.groupBy("token").agg(F.count("*").alias("n"))
    rare = named.join(spread_, "token", "left").groupBy("key_id", "term", "is_alias").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return asked.join(rare, "token").drop("token")


def _named(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, key_id, term, is_alias): the candidates that the texts name. Each text is dealt once, whatever number of
    names it meets."""
    pairs = literal_candidates(queries, keys).withColumnRenamed("query_id", "_of")
    met = pairs.join(queries.select("query_id", "query"), F.col("_of").eqNullSafe(F.col("query_id")))
    return met.where(literal_match(F.col("term"), F.col("query"))).select("query_id", "key_id", "term", "is_alias")


def literal_hits(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, key_id, literal): keys whose concept or alias the query text names; literal is
    `alias` where an alias does, else `concept`. Only candidate pairs run the pattern."""
    return _named(queries, keys).groupBy("query_id", "key_id").agg(F.when(F.max("is_alias"), "alias").otherwise("concept").alias("literal"))


def alias_uses(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, key_id, alias): the alias by which a query text names a key, the first in the key's own order. Whether
    the text names the concept too doesn't matter."""
    place = keys.select("key_id", F.posexplode("aliases").alias("pos", "term"))
    return _named(queries, keys).where("is_alias").join(place, ["key_id", "term"]).groupBy("query_id", "key_id").agg(F.min_by("term", "pos").alias("alias"))


def _keyed_sims(queries: DataFrame, links: DataFrame, alive: DataFrame, least: float) -> DataFrame:
    """(query_id, key_id, memory_id, seq, sim): similarities to contents, by key. Order and keys of a memory ride along with its
    vector, so that pairs meet no join."""
    own = links.groupBy("memory_id").agg(F.collect_list("key_id").alias("keys"))
    items = dealt(alive.join(own, "memory_id"), "memory_id", "seq").select(F.struct("memory_id", "seq", "keys").alias("m"), "embedding")
    return similar(queries, items, least=least, item_id="m").select("query_id", F.explode("m.keys").alias("key_id"), "m.memory_id", "m.seq", "sim")


def _best_content(rows: DataFrame) -> DataFrame:
    """(query_id, key_id, content_sim, content_id): each key's best memory of (query_id, key_id, memory_id, seq, sim), ties to the earliest."""
    return rows.groupBy("query_id", "key_id").agg(F.max(F.struct(F.round(F.col("sim") + 1e-10, 6).alias("s"), (-F.col("seq")).alias("o"), F.col("sim").alias("sim"), F.col("memory_id").alias("id"))).alias("b")).select("query_id", "key_id", F.col("b.sim").alias("content_sim"), F.col("b.id").alias("content_id"))


def _candidates(queries: DataFrame, keys: DataFrame, links: DataFrame, memories: DataFrame, now: float, namespace: str | None, content_sims: DataFrame | None, config: Config, floor: float) -> DataFrame:
    alive = active(memories, now, namespace).select("memory_id", "seq", "embedding")
    counts = key_counts(links, alive, config)
    key_sims = similar(queries, keys, least=floor, item_id="key_id")
    if content_sims is None:
        keyed = _keyed_sims(queries, links, alive, floor)
    else:
        keyed = content_sims.join(alive.select("memory_id", "seq"), "memory_id").join(links.select("key_id", "memory_id"), "memory_id")
    best = _best_content(keyed)
    literal = literal_hits(queries, keys) if "query" in queries.columns else None
    out = key_sims.withColumnRenamed("sim", "key_sim").join(best, ["query_id", "key_id"], "full")
    if literal is not None:
        out = out.join(literal, ["query_id", "key_id"], "full")
    else:
        out = out.withColumn("literal", F.lit(None).cast("string"))
    info = keys.select("key_id", "concept", "key_type", "seq").join(counts, "key_id")
    return out.join(info, "key_id").select("query_id", "key_id", "concept", "key_type", "seq", "literal", F.coalesce("key_sim", F.lit(0.0)).alias("key_sim"), F.coalesce("content_sim", F.lit(0.0)).alias("content_sim"), "content_id", "n_memories", "is_hub", "specificity")


def _score(rows: DataFrame) -> DataFrame:
    entity = F.col("key_type").isin("name", "proper_noun") & F.col("literal").isNotNull()
    raw = F.when(entity, F.lit(1.0)).otherwise(F.greatest("key_sim", "content_sim"))
    kind = F.coalesce("literal", F.when(F.col("content_sim") > F.col("key_sim") + 1e-10, "content").otherwise("semantic"))
    return rows.withColumn("score", round3(raw + 1e-10)).withColumn("match_type", kind)


def search_keys(queries: DataFrame, keys: DataFrame, links: DataFrame, memories: DataFrame, now: float, top_k: int = 8, namespace: str | None = None, content_sims: DataFrame | None = None, config: Config = DEFAULT, short: bool = False) -> DataFrame:
    """(query_id, rank, key_id, concept, score, match_type, content_id, n_memories, is_hub, specificity).

    queries: query_id, embedding and perhaps query (text, for literal matches). Entity keys need a
    literal match; concept keys one, or a key or content similarity above their gates. content_sims
    (query_id, memory_id, sim) replaces the similarities to contents, say by those of sentences or of
    a context. Of keys that matched by the same memory's content only the first stays.
    """
    top_k = max(1, min(20, top_k))
    p = config.profile
    gate = F.lit(p.content_gate(short))
    if "query" in queries.columns:  # a short text has its own content gate
        gate = F.when(F.coalesce(short_concept(F.col("query")), F.lit(False)), p.content_gate(True)).otherwise(gate)
    gates = queries.select("query_id", gate.alias("gate"))
    rows = _candidates(queries, keys, links, memories, now, namespace, content_sims, config, floor=min(p.key_recall, p.content_gate(short), p.content_gate("query" in queries.columns)))
    rows = rows.join(gates, "query_id")
    near = at_least(F.col("key_sim"), p.key_recall) | at_least(F.col("content_sim"), F.col("gate"))
    rows = _score(rows.where(F.col("literal").isNotNull() | (~F.col("key_type").isin("name", "proper_noun") & near)))
    order = [F.desc("score"), F.desc(F.col("literal").isNotNull()), F.desc("specificity"), F.asc("seq")]
    claimed = F.row_number().over(Window.partitionBy("query_id", "content_id", F.col("match_type") == "content").orderBy(*order))
    rows = rows.withColumn("claimed", claimed).where((F.col("match_type") != "content") | (F.col("claimed") == 1))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top_k)
    return rows.select("query_id", "rank", "key_id", "concept", "score", "match_type", "content_id", "n_memories", "is_hub", "specificity")


def weak_matches(queries: DataFrame, found: DataFrame, keys: DataFrame, links: DataFrame, memories: DataFrame, now: float, namespace: str | None = None, content_sims: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """(query_id, key_id, query, cosine): the keys that a later read may teach a query's text to: those that
    `search_keys` found (found) by meaning alone, and, for short texts, concept keys that no gate let in but
    whose similarity reaches the confirmation floor. queries: query_id, query, embedding."""
    p = config.profile
    texts = queries.select("query_id", "query", F.coalesce(short_concept(F.col("query")), F.lit(False)).alias("short"))
    shown = found.where("match_type = 'semantic'").select("query_id", "key_id", F.col("score").alias("cosine"))
    rows = _candidates(queries, keys, links, memories, now, namespace, content_sims, config, floor=min(config.confirm_floor, p.content_gate(True), p.content_gate(False))).join(texts.where("short"), "query_id")
    below = ~at_least(F.col("key_sim"), p.key_recall) & at_least(F.col("key_sim"), config.confirm_floor) & ~at_least(F.col("content_sim"), p.content_gate(True))
    missed = rows.where(F.col("literal").isNull() & ~F.col("key_type").isin("name", "proper_noun") & below)
    missed = missed.select("query_id", "key_id", round3(F.col("key_sim") + 1e-10).alias("cosine"))
    return shown.unionByName(missed).join(texts, "query_id").select("query_id", "key_id", "query", "cosine")


def nearest_keys(queries: DataFrame, keys: DataFrame, links: DataFrame, memories: DataFrame, now: float, limit: int = 5, namespace: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """As search_keys, without gates: what lies nearest, entity keys too."""
    rows = _score(_candidates(queries, keys, links, memories, now, namespace, None, config, floor=-1.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(10, limit)))
    return rows.select("query_id", "rank", "key_id", "concept", "score", "match_type", "n_memories")


def read_key(key_ids: DataFrame, links: DataFrame, memories: DataFrame, now: float, limit: int = 10, offset: int = 0, namespace: str | None = None, relevance: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """(key_id, rank, memory_id, score, weight, total, next_offset): a page of each key's memories by
    relevance x weight x depth x time. relevance: (memory_id, sim), 1 where not given; with a query_id the pages
    are those of each query and key, of the memories that have a relevance to the query."""
    limit = max(1, min(50, limit))
    rows = links.join(key_ids.select("key_id"), "key_id", "left_semi").join(active(memories, now, namespace).select("memory_id", "created_at", "depth", "seq"), "memory_id")
    rel, by = F.lit(1.0), ["key_id"]
    if relevance is not None and "query_id" in relevance.columns:
        rows, rel, by = rows.join(relevance.select("query_id", "memory_id", F.col("sim").alias("rel")), "memory_id"), F.col("rel"), ["query_id", "key_id"]
    elif relevance is not None:
        rows, rel = rows.join(relevance.select("memory_id", F.col("sim").alias("rel")), "memory_id", "left"), F.coalesce("rel", F.lit(0.0))
    rows = rows.withColumn("score", rel * F.col("weight") * depth_factor(F.col("depth")) * time_factor(F.col("created_at"), F.col("depth"), now, config))
    own = Window.partitionBy(*by)
    rank = F.row_number().over(own.orderBy(F.desc(F.round(F.col("score") + 1e-10, 6)), F.desc("created_at"), "seq"))
    rows = rows.withColumn("rank", rank).withColumn("total", F.count("*").over(own)).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return rows.select(*by, "rank", "memory_id", "score", "weight", "total", F.when(F.col("total") > offset + limit, offset + limit).alias("next_offset"))


def browse_keys(keys: DataFrame, links: DataFrame, memories: DataFrame, now: float, limit: int = 20, offset: int = 0, hubs_only: bool = False, namespace: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """A page of keys with active memories: hubs first, then by count and concept (binary order)."""
    rows = keys.select("key_id", "concept", "key_type").join(key_counts(links, active(memories, now, namespace), config), "key_id")
    if hubs_only:
        rows = rows.where("is_hub")
    return rows.orderBy(F.desc("is_hub"), F.desc("n_memories"), "concept", "key_id").offset(max(0, offset)).limit(max(1, min(100, limit)))


def browse_status(keys: DataFrame, links: DataFrame, memories: DataFrame, now: float, hubs_only: bool = False, namespace: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row (status, memory_count, key_count) of a namespace: `ok`, or `empty_namespace` if no key leads to an
    active memory, hubs or not."""
    alive = active(memories, now, namespace)
    n = links.join(keys.select("key_id"), "key_id", "left_semi").join(alive.select("memory_id"), "memory_id", "left_semi").agg(F.count_distinct("memory_id").alias("memory_count"))
    counts = key_counts(links, alive, config)
    shown = (counts.where("is_hub") if hubs_only else counts).agg(F.count("*").alias("key_count"))
    both = n.withColumn("_one", F.lit(1)).join(shown.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.when(F.col("memory_count") > 0, "ok").otherwise("empty_namespace").alias("status"), "memory_count", "key_count")


def memory_keys(memory_ids: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """(memory_id, rank, key_id, concept, weight): the keys of memories, heaviest links first."""
    rows = links.join(dealt(memory_ids.select("memory_id"), "memory_id"), "memory_id", "left_semi")
    rows = dealt(rows.join(keys.select("key_id", "concept", "seq"), "key_id"), "memory_id")
    order = Window.partitionBy("memory_id").orderBy(F.desc("weight"), "seq")
    return rows.select("memory_id", F.row_number().over(order).alias("rank"), "key_id", "concept", "weight")


def near_key_hints(own: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key_id, near_id, sim): for each of the provided keys the most similar other concept key whose
    similarity is high enough to be found by, too low to merge."""
    p = config.profile
    sims = similar(own.select(F.col("key_id").alias("query_id"), "embedding"), keys.where("key_type = 'concept'"), least=p.key_recall, item_id="key_id")
    sims = sims.where(~at_least(F.col("sim"), p.key_merge)).join(own.select("key_id"), "key_id", "left_anti").join(keys.select("key_id", "seq"), "key_id")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("sim") + 1e-10, 6)), "seq"))
    return sims.withColumn("r", best).where("r = 1").select(F.col("query_id").alias("key_id"), F.col("key_id").alias("near_id"), "sim")
