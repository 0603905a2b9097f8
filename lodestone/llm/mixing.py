"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length; a source's budget is met by whole passes over it and a
remainder, which a bounded knapsack on the length counts fits; a seeded order then picks the
documents of each length. Only (source, length) counts reach Python, one source at a time, so a
task holds as many rows as there are different lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import WORD, drop_table, materialize

#: Words of a remainder that the dynamic programme fits; what is above is filled by proportion.
DP_WORDS = 1 << 16
#: Seeded slots in which the documents of one source and length are dealt for selection.
SLOTS = 1024


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: float, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, at most `counts`, so that their words come as
    near `budget` as this finds: a proportional share of every length, then the largest lengths
    while they fit, then a bounded knapsack over what is left for the last `dp_words` words."""
    take = np.zeros(len(lengths), np.int64)
    total = float(np.dot(lengths, counts))
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    take = np.minimum(counts, np.floor(counts * (budget / total))).astype(np.int64)
    left = budget - float(np.dot(take, lengths))
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # different lengths, not documents
        if left <= dp_words:
            break
        if lengths[i] > 0:
            n = min(int(counts[i] - take[i]), int((left - dp_words) // lengths[i]) + (left - dp_words > 0))
            n = min(n, int(left // lengths[i]))
            take[i] += n
            left -= n * lengths[i]
    goal = int(round(left))
    longest = int(lengths.max())
    most = min(goal + longest, 2 * dp_words + longest)
    first = np.full(most + 1, -1, np.int64)  # the item that first made a sum reachable
    first[0] = len(lengths) * 64
    items: list[tuple[int, int]] = []
    for i in order[::-1]:
        free, part = int(counts[i] - take[i]), 1
        if lengths[i] <= 0 or lengths[i] > most:
            continue
        free = min(free, most // int(lengths[i]))
        while free > 0:  # 1, 2, 4 ... copies: every number up to `free`
            n = min(part, free)
            items.append((int(i), n))
            free -= n
            part *= 2
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    for k, (i, n) in enumerate(items):
        step = int(lengths[i]) * n
        if step > most:
            continue
        new = np.zeros_like(reached)
        new[step:] = reached[:-step]
        new &= ~reached
        first[new] = k
        reached |= new
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= int(lengths[i]) * n
    return take


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources in
    code-point order, null last. Targets share `share` of all words by weight, stop at `most` times
    their source, and the excess goes by weight to the others: target = min(most * size, level *
    weight), where level is found by a running sum over the sources in the order in which they fill."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("weight", F.element_at(w, (F.pmod(at - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("full", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("weight"))
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("goal", F.least(F.lit(float(share)), F.lit(float(most))) * F.sum("source_size").over(everyone)).withColumn("heavy", F.sum("weight").over(everyone))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("filled", F.coalesce(F.sum("full").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if just the sources before this one were full: it falls from the first on at which it holds
    s = s.withColumn("level", (F.col("goal") - F.col("filled")) / (F.col("heavy") - F.col("gone")))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everyone))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("full")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    size, target = float(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(target // size) if size else 0
    rows = rows.sort_values("size", ignore_index=True)
    extra = fit_lengths(rows["size"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64), target - passes * size)
    return pd.DataFrame({"_source": rows["_source"], "size": rows["size"], "passes": passes, "extra": extra})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """One row for each document: id_col, size (words), source_size, target, taken (words that the
    mix takes of it, repeats counted) and copies; `carry` names further columns.

    Sizes count runs of anything but ASCII white space; null texts have size 0 and are taken 0
    words of. A null source is a source of its own. Every source gives whole passes and a seeded
    remainder: no document is taken more than one time more often than another of its source, nor
    over `most` times. The order within a length is a hash of seed, id and text, so reruns agree;
    of rows equal in all three any may be taken. An empty table gives no rows.
    """
    carry = list(carry or ())
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    # a null source under a name of its own, so that all joins and windows deal rows by the same plain columns
    known = F.col(source_col).cast("string")
    rows = spread(docs).select(F.col(id_col), F.when(known.isNull(), "0").otherwise(F.concat(F.lit("1"), known)).alias("_source"), size.alias("size"), mark.alias("_mark"), *(F.col(c).alias(f"_also_{c}") for c in carry))
    rows = materialize(rows, "sized")  # words are counted once
    rows = rows.withColumn("_slot", F.pmod("_mark", F.lit(SLOTS)).cast("int"))
    counts = materialize(rows.groupBy("_source", "size", "_slot").agg(F.count("*").alias("docs")), "counts")
    sizes = counts.groupBy("_source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    named = sizes.select(F.when(F.col("_source") != "0", F.substring("_source", 2, 2**31 - 1)).alias("source"), "source_size")
    targets = source_targets(named, weights, share, most)
    targets = materialize(targets.select(F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("_source"), "source_size", "target"), "targets")
    lengths = counts.groupBy("_source", "size").agg(F.sum("docs").alias("docs")).join(targets, "_source")
    fitted = lengths.groupBy("_source").applyInPandas(_fit, "_source string, size long, passes long, extra long")
    before = Window.partitionBy("_source", "size").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0)))  # SLOTS rows a length at most
    plan = slots.join(fitted, ["_source", "size"]).join(targets, "_source")
    plan = materialize(plan.select("_source", "size", "_slot", "before", "passes", "extra", "source_size", "target"), "plan")
    for x in (counts, targets):
        drop_table(x)
    order = Window.partitionBy("_source", "size", "_slot").orderBy("_mark", id_col)
    out = rows.withColumn("_rank", F.row_number().over(order)).join(plan, ["_source", "size", "_slot"])
    copies = F.col("passes") + F.when(F.col("before") + F.col("_rank") <= F.col("extra"), 1).otherwise(0)
    return out.select(F.col(id_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), *(F.col(f"_also_{c}").alias(c) for c in carry))
