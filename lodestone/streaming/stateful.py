"""Stateful streams: confirmation of recalled keys, and folding of reinforcement into link weights."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..operators.fold import compose
from ..operators.maintain import promotion

DEFAULT = Config()
#: The latest queries of a key, those that a read took marked; `buffer_size` at most.
_STATE = "pending array<struct<ts:double,id:long,taken:boolean>>, confirmed long"


def confirm_stream(events: DataFrame, by: str = "user_id", ttl: float | None = None, config: Config = DEFAULT, watermark: str = "1 hour") -> DataFrame:
    """(by, read_id, query_id, n_confirmed) for each read that confirms a query about the same thing: the
    latest that no read took before, if at most `ttl` seconds old (see `maintain.match_buffer`). events: by, kind
    (`query` or `read`), ts (timestamp), id. State is per key, holds `buffer_size` queries at most and
    expires with the watermark."""
    ttl = config.buffer_ttl if ttl is None else ttl

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending, confirmed = state.get if state.exists else ([], 0)
        pending = [tuple(p) for p in pending]
        rows = pd.concat(list(batches)).assign(t=lambda d: d["ts"].astype("datetime64[us]").astype("int64") / 1e6, late=lambda d: d["kind"] == "read").sort_values(["t", "late", "id"])
        out = []
        for t, kind, i in zip(rows["t"], rows["kind"], rows["id"], strict=True):
            pending = [p for p in pending if t - p[0] <= ttl]
            if kind == "query":
                pending = [*pending, (float(t), int(i), False)][-config.buffer_size :]
                continue
            open_ = [n for n, p in enumerate(pending) if not p[2]]
            if open_:
                at, query, _ = pending[open_[-1]]
                pending[open_[-1]] = (at, query, True)
                confirmed += 1
                out.append((key[0], int(i), query, confirmed))
        state.update((pending, confirmed))
        last = int(rows["t"].max() * 1000)
        state.setTimeoutTimestamp(max(last + int(ttl * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "read_id", "query_id", "n_confirmed"])

    rows = events.withWatermark("ts", watermark).select(by, "kind", "ts", "id")
    schema = f"{by} long, read_id long, query_id long, n_confirmed long"
    return rows.groupBy(by).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: The latest queries of a key, what each text was confirmed, and how many names the key has learned.
_LEDGER = "pending array<struct<ts:double,id:long,taken:boolean,query:string,name:string,band:string,had:int>>, ledger array<struct<name:string,n:int,settled:boolean>>, learned int"


def promote_stream(events: DataFrame, known: DataFrame, by: str = "key_id", ttl: float | None = None, config: Config = DEFAULT, watermark: str = "1 hour") -> DataFrame:
    """(by, read_id, query_id, query, n_confirmed, decision, ts) for each read by which a key learns: as
    `maintain.learn_aliases` decides over the confirmations of `confirm_stream`, read by read.

    events: by, kind (`query` or `read`), ts (timestamp), id, query, cosine (both of queries). known: (by, concept, aliases,
    and where there are any learned_aliases and alias_candidates), a static table: names that a key has teach it nothing,
    counts and learned names go on from there. State is per key: `buffer_size` queries, and the texts
    confirmed so far; a key without events for `prune_age` is forgotten."""
    ttl = config.buffer_ttl if ttl is None else ttl

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).assign(t=lambda d: d["ts"].astype("datetime64[us]").astype("int64") / 1e6, late=lambda d: d["kind"] == "read").sort_values(["t", "late", "id"])
        pending, ledger, learned = state.get if state.exists else ([], [], int(rows["learned"].max()))
        pending, counts = [tuple(p) for p in pending], {e[0]: (e[1], e[2]) for e in ledger}
        out = []
        for r in rows.itertuples():
            pending = [p for p in pending if r.t - p[0] <= ttl]
            if r.kind == "query":
                pending = [*pending, (float(r.t), int(r.id), False, r.query, r.name, r.band, int(r.had))][-config.buffer_size :]
                continue
            open_ = [n for n, p in enumerate(pending) if not p[2]]
            if not open_:
                continue
            at, query_id, _, text, name, band, had = pending[open_[-1]]
            pending[open_[-1]] = (at, query_id, True, text, name, band, had)
            n, settled = counts.get(name, (had, False))
            if name is None or settled:
                continue
            settled = n + 1 >= config.promote_n and band != "none"
            counts[name] = (n + 1, settled)
            if settled and (band != "alias" or learned < config.max_aliases):
                learned += band == "alias"
                out.append((key[0], int(r.id), query_id, text, n + 1, band, r.ts))
        state.update((pending, [(name, *c) for name, c in counts.items()], int(learned)))
        state.setTimeoutTimestamp(max(int((rows["t"].max() + config.prune_age) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "read_id", "query_id", "query", "n_confirmed", "decision", "ts"])

    none = F.array().cast("array<string>")
    own = known.select(
        by, F.transform(F.array_append(F.coalesce("aliases", none), F.col("concept")), F.lower).alias("_names"),
        (F.greatest(F.size("learned_aliases"), F.lit(0)) if "learned_aliases" in known.columns else F.lit(0)).alias("learned"),
        (F.transform_values("alias_candidates", lambda _, v: v["count"]) if "alias_candidates" in known.columns else F.lit(None).cast("map<string,int>")).alias("_had"),
    )
    text = F.trim("query")
    rows = events.withWatermark("ts", watermark).select(by, "kind", "ts", "id", text.alias("query"), "cosine").join(own, by)
    name = F.when((F.length("query") >= 2) & ~F.array_contains("_names", F.lower("query")), F.lower("query"))
    rows = rows.withColumn("name", name).withColumn("band", promotion(F.lit(config.promote_n), F.col("query"), F.col("cosine"), F.lit(0), config))
    rows = rows.select(by, "kind", "ts", "id", "query", "name", F.coalesce("band", F.lit("none")).alias("band"), F.coalesce(F.try_element_at("_had", F.col("name")), F.lit(0)).alias("had"), "learned")
    schema = f"{by} {dict(events.dtypes)[by]}, read_id long, query_id long, query string, n_confirmed long, decision string, ts timestamp"
    return rows.groupBy(by).applyInPandasWithState(step, schema, _LEDGER, "append", GroupStateTimeout.EventTimeTimeout)


#: Groups that links are dealt to by hash; the state of a stream is a row for each.
FOLD_GROUPS = 2048
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def fold_stream(events: DataFrame, by: list[str], config: Config = DEFAULT, groups: int = FOLD_GROUPS) -> DataFrame:
    """Running link weights (by, n_events, weight) of a stream of changes (by, seq, delta), clamped after each: a batch's
    changes of a link become one triple (see `operators.fold`), which moves the weight that is its state.

    Links are dealt to `groups` by hash, whose states hold the weights of all their links: a batch costs a call for
    each group that it meets, not for each link, and writes the states of those anew. A checkpoint goes with its number of groups."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, n, w = state.get if state.exists else ([], [], [])
        rows = pd.concat(list(batches))
        g, links = pd.factorize(rows["link"])
        delta, seq = rows["delta"].to_numpy(float), rows["seq"].to_numpy()
        order = np.lexsort((delta, seq, g))
        low, high, shift = compose(np.full(len(g), config.weight_min), np.full(len(g), config.weight_max), delta[order], g[order])
        at = {link: i for i, link in enumerate(known)}
        place = np.array([at.setdefault(link, len(at)) for link in links], np.int64)
        n = np.concatenate([np.array(n, np.int64), np.zeros(len(at) - len(known), np.int64)])
        w = np.concatenate([np.array(w, float), np.full(len(at) - len(known), float(config.weight_default))])
        n[place] += np.bincount(g, minlength=len(links))
        w[place] = np.minimum(high, np.maximum(low, w[place] + shift))
        state.update((list(at), n.tolist(), w.tolist()))
        yield pd.DataFrame({"link": list(links), "n_events": n[place], "weight": w[place]})

    own = events.select(*by).schema
    rows = events.select(F.pmod(F.xxhash64(*by), F.lit(groups)).alias("_group"), F.to_json(F.struct(*by), _EXACT).alias("link"), "seq", "delta")
    folded = rows.groupBy("_group").applyInPandasWithState(step, "link string, n_events long, weight double", "link array<string>, n array<long>, weight array<double>", "update", GroupStateTimeout.NoTimeout)
    return folded.select(F.from_json("link", own, _EXACT).alias("l"), "n_events", "weight").select(*(F.col("l")[c].alias(c) for c in by), "n_events", "weight")


def idle_sessions(events: DataFrame, by: str = "user_id", gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """(by, start, end, n_events): sessions that end after a gap without events."""
    return events.withWatermark("ts", watermark).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
