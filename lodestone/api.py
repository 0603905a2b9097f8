"""The verbs of a memory service over one graph: thin calls into the operators, one method a tool.

Reads are DataFrames over an immutable snapshot; writes return a new `Memory` over new tables, which
`save` commits. A batch of queries costs one plan, so prefer batches to loops.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .functions.scoring import recall_status
from .functions.text import new_id, retag_note, skip_prompt, usable_keys
from .functions.vector import BigramEmbedder, Embedder, embed
from .operators import bm25, graph, keys, maintain, oplog, recall, write
from .operators.durable import cut
from .operators.robust import robust_spread
from .schema import KEYS, LINKS, MEMORIES, SENTENCES, conform
from .sources import transcripts
from .sources.store import Store, sentence_vectors


@dataclasses.dataclass(frozen=True)
class Memory:
    """A graph snapshot with its embedder, configuration and clock; `indexed` adds a full-text index that writes
    keep up to date.

    asked: the weak matches (turn, ts, query, key_id, cosine) of the latest questions, which reads may still take. changes:
    rows of the operation log that the snapshot has and its store hasn't; rewritten: whether more than those changed."""

    keys: DataFrame
    links: DataFrame
    memories: DataFrame
    now: float
    embedder: Embedder = dataclasses.field(default_factory=BigramEmbedder)
    config: Config = dataclasses.field(default_factory=Config)
    sentences: DataFrame | None = None
    index: bm25.Index | None = None
    asked: DataFrame | None = None
    changes: tuple[DataFrame, ...] = ()
    rewritten: bool = False

    @staticmethod
    def empty(spark: SparkSession, now: float, **more) -> Memory:
        return Memory(spark.createDataFrame([], KEYS), spark.createDataFrame([], LINKS), spark.createDataFrame([], MEMORIES), now, sentences=spark.createDataFrame([], SENTENCES), **more)

    @staticmethod
    def load(store: Store, now: float, **more) -> Memory:
        t = store.load()
        return Memory(t["keys"], t["links"], t["memories"], now, sentences=t["sentences"], **more)

    def save(self, store: Store) -> str:
        tables = {"keys": self.keys, "links": self.links, "memories": self.memories}
        return store.save(tables if self.sentences is None else {**tables, "sentences": self.sentences}, self.embedder.fingerprint)

    def flush(self, store: Store) -> Memory:
        """Bring a store that this graph was loaded from up to date: where reads alone changed it, their log rows are
        added, else a new version is written. The same graph with nothing left to flush."""
        if self.rewritten:
            self.save(store)
        elif self.changes:
            store.append_log(functools.reduce(DataFrame.unionByName, self.changes), own=True)
        return dataclasses.replace(self, changes=(), rewritten=False)

    def _seq(self) -> int:
        """A number for the next changes of links: later than all before by the clock, and in the order of verbs."""
        return int(self.now * 1e6) + len(self.changes)

    @property
    def spark(self) -> SparkSession:
        return self.memories.sparkSession

    def indexed(self) -> Memory:
        """With a full-text index of all memories that nothing supersedes."""
        return dataclasses.replace(self, index=bm25.Index.build(self._unsuperseded()))

    def _unsuperseded(self) -> DataFrame:
        gone = self.memories.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id"))
        return self.memories.join(gone, "memory_id", "left_anti")

    def _queries(self, texts: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
        return embed(rows, "query", self.embedder, kind="query")

    def _cues(self, texts: list[str], contexts: list[str | None] | None) -> DataFrame:
        return self._queries([c.strip() if c and c.strip() else t for t, c in zip(texts, contexts or texts, strict=True)]).drop("query")

    def _content_sims(self, texts: list[str], contexts: list[str | None] | None, namespace: str | None, least: float) -> DataFrame:
        """Similarities to contents of the texts, or of longer contexts where given."""
        return recall.content_similarities(self._cues(texts, contexts), graph.active(self.memories, self.now, namespace), self.sentences, least)

    # reads ----------------------------------------------------------------

    def recall(self, texts: list[str], top_k: int = 8, namespace: str | None = None, contexts: list[str | None] | None = None) -> DataFrame:
        """Keys that answer each text; contexts: what the content path compares instead of the short text."""
        p = self.config.profile
        sims = self._content_sims(texts, contexts, namespace, min(p.content_gate(True), p.content_gate(False)))
        return keys.search_keys(self._queries(texts), self.keys, self.links, self.memories, self.now, top_k, namespace, sims, self.config)

    def noted(self, texts: list[str], namespace: str | None = None, contexts: list[str | None] | None = None) -> Memory:
        """The graph after `recall` answered the texts, one after the other: aliases that they used count hits, and weak
        matches wait for reads that confirm them, those of the latest `buffer_size` texts that have any."""
        p, q = self.config.profile, self._queries(texts)
        sims = cut(self._content_sims(texts, contexts, namespace, min(p.content_gate(True), p.content_gate(False))))
        found = keys.search_keys(q, self.keys, self.links, self.memories, self.now, 8, namespace, sims, self.config)
        weak = keys.weak_matches(q, found, self.keys, self.links, self.memories, self.now, namespace, sims, self.config)
        last = -1 if self.asked is None else self.asked.agg(F.max("turn")).first()[0]
        base = 0 if last is None else last + 1
        rows = weak.select((F.col("query_id") + base).alias("turn"), F.lit(float(self.now)).alias("ts"), F.trim("query").alias("query"), "key_id", "cosine")
        rows = rows if self.asked is None else self.asked.unionByName(rows)
        kept = rows.select("turn").distinct().orderBy(F.desc("turn")).limit(self.config.buffer_size)
        seen = self.links.join(graph.active(self.memories, self.now, namespace).select("memory_id"), "memory_id", "left_semi")
        used = cut(keys.alias_uses(q, self.keys.join(seen.select("key_id"), "key_id", "left_semi")).join(self._learned(), ["key_id", "alias"], "left_semi").select("key_id", "alias"))
        return dataclasses.replace(self, asked=cut(rows.join(F.broadcast(kept), "turn", "left_semi")), keys=cut(maintain.count_alias_hits(self.keys, used)), changes=(*self.changes, oplog.uses(used)))

    def _learned(self) -> DataFrame:
        """(key_id, alias) of the names that keys learned."""
        return self.keys.select("key_id", F.explode("learned_aliases.alias").alias("alias"))

    def recall_hint(self, texts: list[str], namespace: str | None = None) -> DataFrame:
        """The nearest keys of texts that no key answers."""
        q = self._queries(texts)
        none = q.join(self.recall(texts, namespace=namespace).select("query_id").distinct(), "query_id", "left_anti")
        return keys.nearest_keys(none, self.keys, self.links, self.memories, self.now, 2, namespace, self.config)

    def recall_explain(self, texts: list[str], namespace: str | None = None) -> DataFrame:
        """(query_id, n_hits, status)."""
        n = self.recall(texts, namespace=namespace).groupBy("query_id").agg(F.count("*").alias("n_hits"))
        active = graph.active(self.memories, self.now, namespace).count()
        rows = self._queries(texts).select("query_id").join(n, "query_id", "left").fillna(0, ["n_hits"])
        return rows.withColumn("status", recall_status(F.col("n_hits"), F.lit(active)))

    def recall_memories(self, texts: list[str], top_k: int = 10, hops: int = 1, namespace: str | None = None, min_rel: float = 0.0, min_depth: float = 0.0, contexts: list[str | None] | None = None, scorer: Callable[[list[str], list[str]], np.ndarray] | None = None) -> DataFrame:
        """Memories that answer each text. scorer: of (query, text) pairs, reorders the first `rerank_pool` of them."""
        q, p = self._queries(texts), self.config.profile
        index = self.index or bm25.Index.build(self._unsuperseded())
        if self.config.bm25_scope == "active":
            index = index.keep(graph.active(self.memories, self.now, namespace))
        sparse = index.search(q, self.config.bm25_depth, seq=self.memories)
        sims = self._content_sims(texts, contexts, namespace, min(p.content_gate(True), p.content_gate(False)))
        z = robust_spread(self._cues(texts, contexts), graph.active(self.memories, self.now, namespace), self.sentences) if p.gate_z > 0 else None
        wanted = top_k if scorer is None else max(top_k, self.config.rerank_pool)
        found = recall.hybrid_recall(q, self.keys, self.links, self.memories, self.now, sparse, wanted, hops, namespace, min_rel, min_depth, sims, self.config, limit=max(20, wanted), z=z)
        if scorer is None:
            return found
        found = cut(found)
        picked = recall.rerank(found, scorer, q, self.memories, max(1, min(20, top_k)) * (2 if hops > 1 else 1), self.config)
        return picked.join(found.drop("rank"), ["query_id", "memory_id"]).select("query_id", "rank", "memory_id", "score", "raw_sim", "hop", "matched_via", "rerank_score")

    def recalled(self, texts: list[str], found: DataFrame) -> Memory:
        """The graph after an answer `found` of recall_memories was given: its memories are deeper, the links
        of the matched keys to the best one stronger, those to memories that weren't returned weaker."""
        q = self._queries(texts)
        sims = recall.similar(q, self.keys.where("key_type = 'concept'"), least=self.config.profile.key_recall, item_id="key_id", top=self.config.top_keys)
        named = keys.literal_hits(q, self.keys.where("key_type <> 'concept'").withColumn("aliases", F.array().cast("array<string>"))).select("query_id", "key_id", F.lit(1.0).alias("sim"))
        hits = recall._ranked(sims.unionByName(named).withColumnRenamed("sim", "score").join(self.keys.select("key_id", "seq"), "key_id"), self.config.top_keys).select("query_id", "key_id")
        found = cut(found)
        delta = cut(maintain.recall_reinforcement(found, hits, self.links, graph.active(self.memories, self.now), self.config))
        links = maintain.set_weights(self.links, self.links.join(delta, ["key_id", "memory_id"]).select("key_id", "memory_id", (F.col("weight") + F.col("delta")).alias("weight")), self.config)
        log = (oplog.link_changes(delta.withColumn("seq", F.lit(self._seq()))), oplog.reads(found.withColumn("ts", F.lit(float(self.now)))))
        return dataclasses.replace(self, links=cut(links), memories=cut(maintain.touch(self.memories, found, self.now, self.config)), changes=(*self.changes, *log))

    def inject(self, texts: list[str], top_k: int = 2, namespace: str | None = None, min_rel: float = 0.0, contexts: list[str | None] | None = None, by_depth: bool = False, shallow_slot: bool = False) -> DataFrame:
        """Passages to put before a model's answer to each text."""
        found = self.recall_memories(texts, max(3 * top_k, 15), 2, namespace, contexts=contexts)
        return recall.recall_inject(found, self._queries(texts), self.keys, self.links, self.memories, top_k, min_rel, self.config, by_depth, shallow_slot)

    def push(self, prompts: list[str], folders: list[str | None] | None = None, allowed: DataFrame | None = None, top_k: int = 2) -> DataFrame:
        """(query_id, slot, memory_id, line): hints for prompts, none for short ones and commands. allowed: (prefix,
        namespaces) by folder; the longest prefix of a prompt's folder counts."""
        picked = self.inject(prompts, top_k, contexts=list(prompts))
        use = self._queries(prompts).where(~skip_prompt(F.col("query"))).select("query_id")
        by_query = None
        if allowed is not None and folders is not None:
            asked = self.spark.createDataFrame([(i, f.lower()) for i, f in enumerate(folders) if f], "query_id long, path string")
            known = allowed.select(F.lower("prefix").alias("prefix"), F.col("namespaces").alias("namespace"))
            by_query = asked.join(recall.namespace_of(asked.select("path").distinct(), known), "path").select("query_id", F.col("namespace").alias("namespaces"))
        return recall.push_inject(picked.join(use, "query_id", "left_semi"), self.memories, by_query, self.config)

    def read_key(self, key_id: str, limit: int = 10, offset: int = 0, namespace: str | None = None) -> DataFrame:
        one = self.keys.where(F.col("key_id") == key_id).select("key_id")
        if not one.limit(1).count():
            raise KeyError(f"no key {key_id}")
        return keys.read_key(one, self.links, self.memories, self.now, limit, offset, namespace, config=self.config)

    def browse_keys(self, limit: int = 20, offset: int = 0, hubs_only: bool = False, namespace: str | None = None) -> DataFrame:
        return keys.browse_keys(self.keys, self.links, self.memories, self.now, limit, offset, hubs_only, namespace, self.config)

    def read_memory(self, memory_id: str, via_key: str | None = None, namespace: str | None = None) -> tuple[DataFrame, Memory]:
        """The memory with its keys, and the graph after the read: deeper memory, stronger link. A read by a key takes the
        latest question that matched the key weakly (see `noted`), and the key may learn its text."""
        me = F.col("memory_id") == memory_id
        row = self.memories.where(me & ~graph.expired(F.col("ttl"), self.now))
        if namespace:
            row = row.where(F.col("namespace") == namespace)
        if not row.limit(1).count():
            raise KeyError(f"no memory {memory_id}")
        newer = self.memories.where(F.col("supersedes") == memory_id).select("memory_id").first()
        if newer is not None:
            raise KeyError(f"memory {memory_id} was superseded by {newer[0]}")
        if via_key is not None and not self.links.where((F.col("key_id") == via_key) & me).limit(1).count():
            raise KeyError(f"memory {memory_id} has no key {via_key}")
        links, log = self.links, [oplog.reads(row.select("memory_id", F.lit(float(self.now)).alias("ts")))]
        if via_key is not None:
            change = links.where(me & (F.col("key_id") == via_key)).select("key_id", "memory_id", F.lit(self._seq()).alias("seq"), F.lit(self.config.reinforce).alias("delta"))
            log.append(oplog.link_changes(cut(change)))
            links = maintain.set_weights(links, links.where(me & (F.col("key_id") == via_key)).withColumn("weight", F.col("weight") + self.config.reinforce), self.config)
        memories = maintain.touch(self.memories, row, self.now, self.config)
        after = dataclasses.replace(self, memories=memories, links=links, changes=(*self.changes, *log))
        return row.join(keys.memory_keys(row, self.keys, self.links), "memory_id", "left"), after._confirmed(via_key, memory_id)

    def _confirmed(self, key_id: str | None, memory_id: str) -> Memory:
        """After a read of a memory by a key: the latest fresh question that matched the key weakly is taken, once."""
        if self.asked is None or key_id is None:
            return self
        mine = self.asked.where((F.col("key_id") == key_id) & (F.lit(float(self.now)) - F.col("ts") <= self.config.buffer_ttl))
        hit = mine.orderBy(F.desc("turn")).first()
        if hit is None:
            return self
        left = dataclasses.replace(self, asked=cut(self.asked.where(~((F.col("key_id") == key_id) & (F.col("turn") == hit["turn"])))))
        row = [(key_id, memory_id, hit["query"], float(hit["cosine"]), float(self.now), int(hit["turn"]))]
        return left.learn(self.spark.createDataFrame(row, "key_id string, memory_id string, query string, cosine double, ts double, read_id long"))

    def learn(self, confirmed: DataFrame) -> Memory:
        """The graph after reads confirmed weakly matched keys (key_id, memory_id, query, cosine, ts, read_id): texts
        that were confirmed often enough become aliases, or keys of their own linked to the memory read."""
        learned = cut(maintain.learn_aliases(confirmed, self.keys, self.config))
        taught = cut(maintain.apply_aliases(self.keys, learned))
        new = learned.where("decision = 'newKey'").select("query", "memory_id", "ts", "name")
        if not new.limit(1).count():
            # names alone are rows of the log; counts of candidates are in the keys only, and make a new version
            open_ = learned.where("decision = 'none'").limit(1).count()
            log = oplog.lessons(learned.where("decision = 'alias'").select("key_id", F.col("query").alias("alias"), "ts"))
            return dataclasses.replace(self, keys=taught, changes=(*self.changes, log), rewritten=self.rewritten or bool(open_))
        base = (taught.agg(F.max("seq")).first()[0] or 0) + 1
        asked = new.withColumn("seq", F.row_number().over(Window.orderBy("ts", "name")) + F.lit(base)).select("seq", F.col("query").alias("concept"), F.lit("concept").alias("key_type"), "memory_id")
        asked = cut(embed(asked, "concept", self.embedder))
        found = cut(write.resolve_keys(asked, taught, self.config))
        made = found.where("how = 'new'").join(asked.select("seq", "key_type", "embedding"), "seq")
        grown = cut(write.record_keys(taught.unionByName(conform(made.withColumn("aliases", F.array().cast("array<string>")), KEYS)), asked, found))
        wanted = found.join(asked.select("seq", "memory_id"), "seq").select("key_id", "memory_id")
        return dataclasses.replace(self, keys=grown, links=cut(maintain.upsert_links(self.links, wanted, self.config)), rewritten=True)

    def related(self, memory_id: str) -> DataFrame:
        seed = self.memories.where(F.col("memory_id") == memory_id).select(F.col("memory_id").alias("seed_id"))
        return graph.related(seed, self.keys, self.links, self.memories, self.now, self.config)

    def list_memories(self, namespace: str | None = None) -> DataFrame:
        return graph.active(self.memories, self.now, namespace).drop("embedding")

    def memory_stats(self) -> dict[str, int]:
        return {"keys": self.keys.count(), "memories": graph.active(self.memories, self.now).count(), "links": self.links.count()}

    def diagnose(self, text: str, k: int = 6) -> DataFrame:
        """(what, id, text, score): the nearest keys and the nearest memories of a text whatever the gates."""
        near = keys.nearest_keys(self._queries([text]), self.keys, self.links, self.memories, self.now, k, config=self.config)
        alive = graph.active(self.memories, self.now)
        sims = recall._ranked(self._content_sims([text], None, None, -1.0).withColumnRenamed("sim", "score").join(alive.select("memory_id", "seq", "content"), "memory_id"), k)
        return near.select(F.lit("key").alias("what"), F.col("key_id").alias("id"), F.col("concept").alias("text"), "score").unionByName(sims.select(F.lit("memory").alias("what"), F.col("memory_id").alias("id"), F.col("content").alias("text"), F.round("score", 3).alias("score")))

    def get_conversation(self, turns: DataFrame, session_id: str, turn: int | None = None) -> DataFrame:
        if not self.config.allow_transcripts:
            raise PermissionError("transcripts are not open to this caller")
        rows = transcripts.load_session(turns, session_id)
        if turn is None:
            return rows
        return transcripts.window(rows, rows.select("session_id").distinct().withColumn("center", F.lit(turn)))

    def list_sessions(self, turns: DataFrame, limit: int = 20) -> DataFrame:
        if not self.config.allow_transcripts:
            raise PermissionError("transcripts are not open to this caller")
        return transcripts.sessions(turns, limit=limit)

    def trace(self, memory_id: str, turns: DataFrame) -> DataFrame:
        """The turns around the one that a memory came from (source: JSON with session and turn)."""
        src = self.memories.where(F.col("memory_id") == memory_id).select(F.get_json_object("source", "$.session").alias("session_id"), F.get_json_object("source", "$.turn").cast("int").alias("center"))
        return transcripts.window(turns, src)

    # writes ---------------------------------------------------------------

    def _resolved(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(memory_id, keys: key ids) of rows (memory_id, seq, concepts, key_types), and the keys afterwards."""
        asked = rows.select("memory_id", F.col("seq").alias("m"), F.posexplode(usable_keys(F.col("concepts"))).alias("pos", "concept"), "key_types")
        most = (rows.agg(F.max(F.size("concepts"))).first()[0] or 0) + 1
        asked = asked.select((F.col("m") * most + F.col("pos")).alias("seq"), "memory_id", "concept", F.coalesce(F.col("key_types")[F.col("concept")], F.lit("concept")).alias("key_type"))
        asked = cut(embed(asked, "concept", self.embedder))
        found = cut(write.resolve_keys(asked, self.keys, self.config))
        made = found.where("how = 'new'").join(asked.select("seq", "key_type", "embedding"), "seq")
        grown = self.keys.unionByName(conform(made.withColumn("aliases", F.array().cast("array<string>")), KEYS))
        grown = cut(write.record_keys(grown, asked, found))
        own = asked.select("seq", "memory_id").join(found.select("seq", "key_id"), "seq").groupBy("memory_id").agg(F.collect_set("key_id").alias("keys"))
        return own, grown

    def _with(self, before: Memory, fresh: DataFrame) -> Memory:
        """This graph with the sentence vectors and the index of the memories `fresh`, as far as it has any."""
        out = dataclasses.replace(self, rewritten=True)
        if self.sentences is not None and self.config.sentence_vectors:
            out = dataclasses.replace(out, sentences=cut(self.sentences.unionByName(sentence_vectors(fresh, self.embedder))))
        if before.index is not None:
            gone = self.memories.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id"))
            out = dataclasses.replace(out, index=before.index.add(fresh).discard(gone))
        return out

    def remember(self, items: list[dict]) -> tuple[Memory, dict[str, DataFrame]]:
        """Add memories {content, keys, key_types?, namespace?, ttl?, related_to?, source?} in order; the new graph,
        and `errors`, `duplicates`, `contradictions`, `hints` and `near_keys`."""
        base = (self.memories.agg(F.max("seq")).first()[0] or 0) + 1
        rows = [(base + i, x["content"], list(x.get("keys") or []), dict(x.get("key_types") or {}), x.get("namespace", "default"), x.get("ttl"), list(x.get("related_to") or []), x.get("source")) for i, x in enumerate(items)]
        new = self.spark.createDataFrame(rows, "seq long, content string, concepts array<string>, key_types map<string,string>, namespace string, ttl double, related_to array<string>, source string")
        new = cut(embed(new.withColumn("memory_id", new_id(F.col("seq").cast("string"), F.col("content"))), "content", self.embedder))
        own, grown = self._resolved(new)
        ready = cut(new.join(own, "memory_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))))
        out = write.add_batch(ready, self.memories, self.links, grown, self.now, self.config)
        given = new.select("memory_id", F.col("concepts").alias("keys"))
        hints = write.write_hints(given)
        done = dataclasses.replace(self, keys=grown, links=cut(out["links"]), memories=cut(out["memories"]))
        fresh = done.memories.join(new.select("memory_id"), "memory_id", "left_semi")
        return done._with(self, fresh), {"errors": out["errors"], "duplicates": out["duplicates"], "contradictions": out["contradictions"], "hints": hints, "near_keys": write.near_hints(given, done.links, grown, self.config)}

    def correct(self, memory_id: str, content: str, concepts: list[str] | None = None, related_to: list[str] | None = None) -> tuple[Memory, DataFrame]:
        """Supersede the newest version of a memory. Namespace and expiry are the old one's, and so are explicit links
        where none are given (an empty list: none) and the keys that still fit where none are given. The
        new graph and a note (note) about inherited keys."""
        head = graph.supersession_heads(self.memories).where(F.col("memory_id") == memory_id).first()
        if head is None:
            raise KeyError(f"no memory {memory_id}")
        old = self.memories.where(F.col("memory_id") == head["head_id"]).first()
        seq = (self.memories.agg(F.max("seq")).first()[0] or 0) + 1
        row = (seq, content, [c for c in concepts or []], {}, old["namespace"], old["ttl"], list(old["links"] if related_to is None else related_to), old["memory_id"])
        new = self.spark.createDataFrame([row], "seq long, content string, concepts array<string>, key_types map<string,string>, namespace string, ttl double, related_to array<string>, supersedes string")
        new = cut(embed(new.withColumn("memory_id", new_id(F.col("seq").cast("string"), F.col("content"))), "content", self.embedder))
        own, grown = self._resolved(new)
        given = own.select(F.explode("keys").alias("key_id"), "memory_id", F.lit(self.config.weight_default).alias("weight"))
        kept = write.inherited_links(new.join(own, "memory_id", "left_anti"), self.links, grown, self.config)
        near = keys.memory_keys(kept.select("memory_id").distinct(), grown, kept).agg(F.array_sort(F.collect_set("concept")).alias("old"))
        note = near.crossJoin(own.agg(F.flatten(F.collect_list("keys")).alias("new"))).select(retag_note(F.col("old"), F.col("new")).alias("note"))  # a row each
        fresh = conform(new.join(write.valid_links(new, self.memories), "memory_id", "left").withColumn("created_at", F.lit(float(self.now))), MEMORIES)
        memories = write.apply_supersession(conform(self.memories, MEMORIES).unionByName(fresh), fresh.select("memory_id", "supersedes"), self.config)
        memories = cut(memories.withColumn("contradicts", F.array_remove("contradicts", old["memory_id"])))
        links = cut(self.links.select("key_id", "memory_id", "weight").unionByName(given.unionByName(kept)))
        links = cut(links.unionByName(write.auto_links(fresh, grown, links, self.config)))
        done = dataclasses.replace(self, keys=grown, links=links, memories=memories)._with(self, fresh)
        if old["supersedes"]:  # history keeps one predecessor
            done = done.forget([old["supersedes"]])
        return done, note

    def _without(self, t: dict[str, DataFrame]) -> Memory:
        out = dataclasses.replace(self, **t, rewritten=True)
        if self.sentences is not None:
            out = dataclasses.replace(out, sentences=self.sentences.join(t["memories"].select("memory_id"), "memory_id", "left_semi").select(self.sentences.columns))
        return out if self.index is None else dataclasses.replace(out, index=self.index.keep(t["memories"]))

    def forget(self, ids: list[str]) -> Memory:
        return self._without(maintain.forget(self.spark.createDataFrame([(i,) for i in ids], "memory_id string"), self.keys, self.links, self.memories))

    def cleanup_expired(self) -> Memory:
        return self._without(maintain.cleanup_expired(self.keys, self.links, self.memories, self.now, self.config))
