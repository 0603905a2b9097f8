"""Writing memories in batches: key resolution, duplicates, contradictions, corrections.

Single adds see the effects of earlier ones. A batch keeps that order in three phases: keys
resolve, then contents, each as an ordered fold over the connected components of pairs that are
similar enough to matter, heavy ones range by range; contradictions follow as a set-based join.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import at_least, clamp_weight, contradiction_band, round3, superseded_depth
from ..functions.similarity import similar
from ..functions.text import conflicting_qualifier, new_id, phrase_key, record_alias, short_concept, single_language, usable_keys
from ..functions.vector import cosine
from ..schema import MEMORIES, conform
from .durable import cut

DEFAULT = Config()
#: Pairs that meet in keys, a memory on average, up to which contradictions are looked for among them.
KEY_PAIRS = 32
#: Candidate pairs of a component that one task folds.
FOLD_PAIRS = 200_000


def best_duplicate(new: DataFrame, old: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(memory_id, duplicate_id, sim): for each new memory the most similar other one at or above the
    duplicate threshold, ties to the earliest; across namespaces unless the config says otherwise."""
    scope = ["namespace"] if config.dedup_scope == "namespace" else []
    sims = similar(new.select(F.struct("memory_id", *scope).alias("x"), "embedding"), old.select(F.struct("memory_id", "seq", *scope).alias("y"), "embedding"), config.profile.memory_dedup, "x", "y").where("x.memory_id <> y.memory_id")
    if scope:
        sims = sims.where("x.namespace <=> y.namespace")
    # a task sends its best of a memory alone, however many are alike
    best = sims.groupBy(F.col("x.memory_id").alias("memory_id")).agg(F.min(F.struct((-F.round(F.col("sim") + 1e-10, 6)).alias("o"), F.col("y.seq").alias("seq"), F.col("y.memory_id").alias("duplicate_id"), "sim")).alias("b"))
    return best.select("memory_id", "b.duplicate_id", "b.sim")


def key_pairs(links: DataFrame) -> int:
    """How many pairs of memories meet in keys, a pair once for each key they share."""
    n = links.groupBy("key_id").agg(F.count("*").cast("double").alias("n"))
    return int(n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)


def contradictions(memories: DataFrame, links: DataFrame, pairs: DataFrame | None = None, config: Config = DEFAULT, by_keys: bool | None = None) -> DataFrame:
    """(a, b, sim), a earlier than b: memories that share a key and are similar, yet no duplicates.
    pairs: (query_id, item_id, sim), computed here where not given: from the pairs that meet in keys where these are few
    (KEY_PAIRS a memory on average), else by a similarity join, so that no hub is paired out. by_keys decides it beforehand."""
    p = config.profile
    one = links.select(F.col("memory_id").alias("query_id"), "key_id")
    two = links.select(F.col("memory_id").alias("item_id"), "key_id")
    if pairs is None and (key_pairs(links) <= KEY_PAIRS * memories.count() if by_keys is None else by_keys):
        met = one.join(two, "key_id").where("query_id <> item_id").select("query_id", "item_id").distinct()
        met = met.join(memories.select(F.col("memory_id").alias("query_id"), F.col("seq").alias("s1"), F.col("embedding").alias("v1")), "query_id").join(memories.select(F.col("memory_id").alias("item_id"), F.col("seq").alias("s2"), F.col("embedding").alias("v2")), "item_id")
        met = met.where("s1 < s2").withColumn("sim", cosine(F.col("v1"), F.col("v2")))
        return met.where(contradiction_band(F.col("sim"), p.contradiction, p.memory_dedup)).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"), "sim")
    if pairs is None:  # order and keys of the memories ride along, so that a pair is judged where it is found
        own = memories.select("memory_id", "seq", "embedding").join(links.groupBy("memory_id").agg(F.collect_set("key_id").alias("in_keys")), "memory_id")
        own = own.select(F.struct("memory_id", "seq", "in_keys").alias("x"), "embedding")
        met = similar(own, own.withColumnRenamed("x", "y"), p.contradiction, "x", "y").where("x.seq < y.seq").where(contradiction_band(F.col("sim"), p.contradiction, p.memory_dedup))
        return met.where(F.arrays_overlap("x.in_keys", "y.in_keys")).select(F.col("x.memory_id").alias("a"), F.col("y.memory_id").alias("b"), "sim")
    seq = memories.select("memory_id", "seq")
    rows = pairs.where(contradiction_band(F.col("sim"), p.contradiction, p.memory_dedup))
    rows = rows.join(seq.select(F.col("memory_id").alias("query_id"), F.col("seq").alias("s1")), "query_id").join(seq.select(F.col("memory_id").alias("item_id"), F.col("seq").alias("s2")), "item_id").where("s1 < s2")
    # similar pairs are few: they meet the links of both ends rather than links one another
    return rows.join(one, "query_id").join(two, ["item_id", "key_id"]).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"), "sim").distinct()


def auto_links(memories: DataFrame, keys: DataFrame, links: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key_id, memory_id, weight): new links of memories to similar keys, weighted by similarity."""
    sims = similar(keys.select(F.col("key_id").alias("query_id"), "embedding"), memories, least=config.profile.key_autolink, item_id="memory_id")
    sims = sims.select(F.col("query_id").alias("key_id"), "memory_id", clamp_weight(F.col("sim"), config).alias("weight"))
    return sims.join(links.select("key_id", "memory_id"), ["key_id", "memory_id"], "left_anti")


def _components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's component, by label spreading with pointer jumps, round by round
    until nothing changes."""
    both = cut(pairs.union(pairs.select(pairs.columns[1], pairs.columns[0])).toDF("x", "y").distinct())
    now = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        low = both.join(now, both["y"] == now["id"]).groupBy("x").agg(F.min("root").alias("m"))
        nxt = now.join(low, now["id"] == low["x"], "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"))
        up = nxt.select(F.col("id").alias("r"), F.col("root").alias("rr"))
        nxt = nxt.join(up, nxt["root"] == up["r"], "left").select("id", F.coalesce("rr", "root").alias("root"))
        nxt = cut(nxt)
        if not nxt.exceptAll(now).limit(1).count():
            return nxt
        now = nxt


def resolve_keys(asked: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(seq, concept, key_id, how): the key that each requested concept (seq, concept, key_type,
    embedding) finds or becomes, in seq order: `equal` by name or alias, `merged` by similarity, else
    `new`. Entity keys never merge by similarity; short concepts do only under their own threshold
    and never across a different one-character qualifier."""
    p = config.profile
    named = keys.select(F.col("key_id").alias("id"), F.explode(F.array_union(F.array("concept"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), F.col("seq").alias("key_seq"))
    known = named.groupBy(F.lower("name").alias("name")).agg(F.min_by("id", "key_seq").alias("id"))
    rows = asked.withColumn("name", F.lower(F.trim("concept"))).join(known, "name", "left")
    open_ = rows.where(F.col("id").isNull())
    first = open_.groupBy("name").agg(F.min("seq").alias("first"))
    heads = open_.join(first, "name").where(F.col("seq") == F.col("first")).drop("first")
    pool = keys.where("key_type = 'concept'").select(F.col("key_id").alias("item_id"), "embedding", F.col("concept").alias("other"), F.col("seq").alias("order"))
    fresh = heads.where("key_type = 'concept'").select(new_id(F.col("name")).alias("item_id"), "embedding", F.col("concept").alias("other"), (F.col("seq") + 1_000_000_000_000).alias("order"))
    items = pool.unionByName(fresh)
    least = min(x for x in (p.key_merge, p.short_key_merge or p.key_merge))
    sims = similar(heads.where("key_type = 'concept'").select(new_id(F.col("name")).alias("query_id"), "embedding"), items, least=least)
    about = heads.select(new_id(F.col("name")).alias("query_id"), "concept", (F.col("seq") + 1_000_000_000_000).alias("mine"))
    pairs = sims.where("query_id <> item_id").join(about, "query_id").join(items.drop("embedding"), "item_id").where(F.col("order") < F.col("mine"))
    short = short_concept(F.col("concept"))
    fits = F.when(short, F.lit(p.short_key_merge > 0) & at_least(F.col("sim"), p.short_key_merge or 2.0) & ~conflicting_qualifier(F.col("concept"), F.col("other"))).otherwise(at_least(F.col("sim"), p.key_merge))
    folded = fold_in_order(pairs.where(fits), gone="query_id")
    done = heads.withColumn("own", new_id(F.col("name"))).join(folded.withColumnRenamed("item_id", "target"), F.col("own") == F.col("query_id"), "left")
    done = done.select("name", F.coalesce("target", "own").alias("key"), F.when(F.col("target").isNotNull(), "merged").otherwise("new").alias("how"))
    out = rows.join(done, "name", "left")
    how = F.when(F.col("id").isNotNull(), "equal").otherwise(F.col("how"))
    first_seq = F.min("seq").over(Window.partitionBy("name"))
    return out.select("seq", "concept", F.coalesce("id", "key").alias("key_id"), F.when((how != "equal") & (F.col("seq") > first_seq), "equal").otherwise(how).alias("how"))


def record_keys(keys: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """keys after the requests `asked` (seq, concept, key_type) found theirs (seq, key_id): a concept key that an
    entity request found becomes an entity key in place, of the first such request's type, and other
    names, whatever the case, are recorded as aliases in order."""
    hits = asked.select("seq", "concept", "key_type").join(found.select("seq", "key_id"), "seq")
    entity = F.when(F.col("key_type") != "concept", F.struct("seq", F.col("key_type").alias("kind")))
    said = hits.groupBy("key_id").agg(F.min(entity)["kind"].alias("_kind"), F.array_sort(F.collect_list(F.struct("seq", "concept"))).alias("_names"))
    none = F.array().cast("array<string>")
    names = F.transform(F.coalesce("_names", F.array().cast("array<struct<seq:bigint,concept:string>>")), lambda x: x["concept"])
    aliases = F.aggregate(names, F.coalesce("aliases", none), lambda have, x: record_alias(have, F.col("concept"), x))
    kind = F.when((F.col("key_type") == "concept") & F.col("_kind").isNotNull(), F.col("_kind")).otherwise(F.col("key_type"))
    return keys.join(said, "key_id", "left").withColumns({"aliases": aliases, "key_type": kind}).select(keys.columns)


def valid_links(wanted: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_id, links): of the ids that a memory wants links to (memory_id, related_to) those that exist and
    aren't its own, each once, in order."""
    rows = wanted.select("memory_id", F.posexplode("related_to").alias("pos", "other")).where("other <> memory_id")
    rows = rows.join(memories.select(F.col("memory_id").alias("other")).distinct(), "other", "left_semi").groupBy("memory_id", "other").agg(F.min("pos").alias("pos"))
    return rows.groupBy("memory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "other"))), lambda x: x["other"]).alias("links"))


def inherited_links(new: DataFrame, links: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key_id, memory_id, weight): the links that corrections (memory_id, supersedes, embedding) take over: all but
    those of concept keys that the new content has drifted away from; all, if none would be left."""
    old = links.select("key_id", F.col("memory_id").alias("supersedes"), "weight")
    rows = new.select("memory_id", "supersedes", F.col("embedding").alias("mine")).join(old, "supersedes").join(keys.select("key_id", "key_type", "embedding"), "key_id")
    near = (F.col("key_type") != "concept") | F.coalesce(at_least(cosine(F.col("mine"), F.col("embedding")), config.profile.content_gate(True)), F.lit(True))
    some = F.max(near).over(Window.partitionBy("memory_id"))
    return rows.withColumn("_near", near).withColumn("_some", some).where(F.col("_near") | ~F.col("_some")).select("key_id", "memory_id", "weight")


def _fold(gone: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Queries in order, each taking the most similar item that is not gone; then its `gone` column is."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(["mine", "query_id", "sim", "order"], ascending=[True, True, False, True], kind="stable")
        out: list[tuple[str, str]] = []
        away: set[str] = set()
        done = None
        for query, item in zip(pairs["query_id"], pairs["item_id"], strict=True):
            if query != done and item not in away:
                done = query
                out.append((query, item))
                away.add(query if gone == "query_id" else item)
        return pd.DataFrame(out, columns=["query_id", "item_id"], dtype=object)

    return run


def fold_in_order(pairs: DataFrame, gone: str, limit: int = FOLD_PAIRS) -> DataFrame:
    """(query_id, item_id): what each query takes of its candidates `pairs` (query_id, item_id, sim, order, mine), in the
    order of `mine`: the most similar item that is not gone, ties to the lower `order`. What took (gone: `query_id`) or what
    was taken (`item_id`) is gone for all later queries.

    Components of pairs don't matter to one another and are folded in parallel. One of more than `limit` pairs
    is cut into ranges of `mine` of about that many; range follows range, each after what is gone by then has
    been taken out, so that no task holds more than a range. The candidates of one query stay together.
    """
    pairs = cut(pairs.select("query_id", "item_id", "sim", "order", "mine"))
    nodes = pairs.select(F.col("query_id").alias("id")).union(pairs.select("item_id")).distinct()
    comp = _components(nodes, pairs.select("query_id", "item_id"))
    rows = pairs.join(comp, pairs["query_id"] == comp["id"]).drop("id")
    size = rows.groupBy("root").agg(F.count("*").alias("n"))
    most = size.agg(F.max("n")).first()[0] or 0
    if most <= limit:
        return cut(rows.groupBy("root").applyInPandas(_fold(gone), "query_id string, item_id string"))
    rounds = -(-most // limit)
    # the bounds of all heavy components are quantiles of `mine`, as sketches that merge; what they are changes the work alone
    heavy = size.where(F.col("n") > limit).select("root")
    bounds = rows.join(heavy, "root").groupBy("root").agg(F.expr(f"percentile_approx(CAST(mine AS DOUBLE), {[i / rounds for i in range(1, rounds)]!r}, 10000)".replace("[", "array(").replace("]", ")")).alias("bounds"))
    at = F.coalesce(F.size(F.filter("bounds", lambda x: x < F.col("mine"))), F.lit(0))
    rows = cut(rows.join(bounds, "root", "left").withColumn("range", F.when(F.col("bounds").isNull(), 0).otherwise(at)).drop("bounds"))
    out = None
    for i in range(rounds):
        part = rows.where(F.col("range") == i).drop("range")
        if out is not None:
            part = part.join(out.select(F.col(gone).alias("item_id")), "item_id", "left_anti")
        done = cut(part.groupBy("root").applyInPandas(_fold(gone), "query_id string, item_id string"))
        out = done if out is None else cut(out.unionByName(done))
    return out


def add_batch(new: DataFrame, memories: DataFrame, links: DataFrame, keys: DataFrame, now: float, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """Tables after adding `new` (memory_id, seq, content, embedding, namespace, ttl, keys: array of concepts
    already resolved to key ids): `memories`, `links`, `contradictions`, and `errors` (memory_id, error).

    A new memory that duplicates a current one supersedes it, loses nothing of its namespace and ttl,
    and makes the old one shallower; history keeps one predecessor. `duplicates` (memory_id, supersedes,
    conflict) tells them, and whether both have a key in common. related_to (ids), where given, become links.
    """
    memories = conform(memories, MEMORIES)
    usable = new.withColumn("key_ids", usable_keys(F.col("keys")))
    errors = usable.where(F.size("key_ids") == 0).select("memory_id", F.lit("no usable keys").alias("error"))
    rows = usable.where(F.size("key_ids") > 0)
    current = memories.join(memories.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id")), "memory_id", "left_anti")
    items = current.select(F.col("memory_id").alias("item_id"), "embedding", F.col("seq").alias("order")).unionByName(rows.select(F.col("memory_id").alias("item_id"), "embedding", F.col("seq").alias("order")))
    sims = similar(rows.select(F.col("memory_id").alias("query_id"), "embedding"), items, least=config.profile.memory_dedup)
    pairs = sims.where("query_id <> item_id").join(items.drop("embedding"), "item_id").join(rows.select(F.col("memory_id").alias("query_id"), F.col("seq").alias("mine")), "query_id").where(F.col("order") < F.col("mine"))
    # in order, each memory supersedes the most similar earlier one that is still current; a predecessor's
    # own predecessor is forgotten
    chains = fold_in_order(pairs, gone="item_id").toDF("memory_id", "supersedes")
    fresh = rows.join(chains, "memory_id", "left")
    linked_to = F.array().cast("array<string>")
    if "related_to" in rows.columns:
        everyone = memories.select("memory_id").unionByName(rows.select("memory_id"))
        fresh, linked_to = fresh.join(valid_links(rows, everyone).withColumnRenamed("links", "_links"), "memory_id", "left"), F.coalesce("_links", linked_to)
    source = F.col("source").cast("string") if "source" in rows.columns else F.lit(None).cast("string")
    fresh = fresh.select(
        "memory_id", "content", "embedding", F.lit(float(now)).alias("created_at"), source.alias("source"), "supersedes", F.lit(0.0).alias("depth"), F.lit(0).alias("access_count"),
        F.lit(float(now)).alias("last_accessed"), "namespace", (F.lit(float(now)) + F.col("ttl")).alias("ttl"), linked_to.alias("links"), F.array().cast("array<string>").alias("contradicts"), "seq",
    )
    everything = apply_supersession(memories.select(fresh.columns).unionByName(fresh), chains, config)
    own = rows.select(F.explode(F.array_distinct("key_ids")).alias("key_id"), "memory_id", F.lit(config.weight_default).alias("weight"))
    linked = links.select("key_id", "memory_id", "weight").unionByName(own)
    # contradictions look at the keys that were given, not at those that similarity adds
    apart = contradictions(everything.join(rows.select("memory_id"), "memory_id", "left_semi").unionByName(current.select(fresh.columns)), linked, config=config)
    shared = linked.alias("a").join(chains.alias("c"), "memory_id").join(linked.select(F.col("key_id").alias("other"), F.col("memory_id").alias("supersedes")), "supersedes").where("key_id = other").select("memory_id").distinct().withColumn("conflict", F.lit(True))
    duplicates = chains.join(shared, "memory_id", "left").select("memory_id", "supersedes", F.coalesce("conflict", F.lit(False)).alias("conflict"))
    linked = linked.unionByName(auto_links(fresh, keys, linked, config))
    return {"memories": everything, "links": linked, "contradictions": apart, "errors": errors, "duplicates": duplicates}


def apply_supersession(memories: DataFrame, chains: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Superseded memories (chains: memory_id, supersedes) get shallower."""
    old = chains.select(F.col("supersedes").alias("memory_id"), F.lit(True).alias("_old")).distinct()
    return memories.join(old, "memory_id", "left").withColumn("depth", F.when(F.col("_old"), superseded_depth(F.col("depth"), config)).otherwise(F.col("depth"))).drop("_old").select(memories.columns)


def write_hints(new: DataFrame) -> DataFrame:
    """(memory_id, phrases, mixed_languages) for new memories' keys worth a second look."""
    rows = new.select("memory_id", F.filter("keys", phrase_key).alias("phrases"), (~single_language(F.col("keys"))).alias("mixed_languages"))
    return rows.where((F.size("phrases") > 0) | F.col("mixed_languages"))


def near_hints(new: DataFrame, links: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(memory_id, your_key, key_id, existing_concept, similarity): for each of the concepts that a memory was given (new:
    memory_id, keys) and that a key of its own is named by, the most similar concept key that isn't the memory's, near
    enough to be found by and too far to merge; ties to the earliest."""
    p = config.profile
    given = new.select("memory_id", F.explode("keys").alias("concept")).select("memory_id", F.lower("concept").alias("name")).distinct()
    own = links.join(new.select("memory_id").distinct(), "memory_id", "left_semi").select("memory_id", "key_id")
    mine = own.join(keys.select("key_id", F.col("concept").alias("your_key"), F.lower("concept").alias("name"), "embedding"), "key_id").join(given, ["memory_id", "name"])
    mine = mine.select("memory_id", F.col("key_id").alias("mine"), "your_key", "embedding")
    asked = mine.select(F.col("mine").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    sims = similar(asked, keys.where("key_type = 'concept'"), least=p.key_recall, item_id="key_id").where(~at_least(F.col("sim"), p.key_merge))
    pairs = mine.drop("embedding").join(sims.withColumnRenamed("query_id", "mine"), "mine").join(own, ["memory_id", "key_id"], "left_anti")
    pairs = pairs.join(keys.select("key_id", F.col("concept").alias("existing_concept"), "seq"), "key_id")
    best = F.row_number().over(Window.partitionBy("memory_id", "mine").orderBy(F.desc(F.round(F.col("sim") + 1e-10, 6)), "seq"))
    return pairs.withColumn("r", best).where("r = 1").select("memory_id", "your_key", "key_id", "existing_concept", round3(F.col("sim") + 1e-10).alias("similarity"))
