"""Calibration of pair thresholds, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("duplicate", "contradiction", "independent")


def share_concepts(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.transform(a, lambda x: F.lower(x)), F.transform(b, lambda x: F.lower(x)))


def classify(sim: Column, shared: Column, floor: Column | float, cut: Column | float) -> Column:
    """duplicate from `cut` on; contradiction from `floor` on with a shared key; else independent."""
    bias = F.lit(1e-10)
    return F.when(sim + bias >= cut, "duplicate").when((sim + bias >= floor) & shared, "contradiction").otherwise("independent")


def prf(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of each class of (actual, predicted) pairs, per group `by`."""
    by = by or []
    counted = pairs.groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    long = counted.select(*by, "actual", "predicted", "n", F.explode(F.array(*(F.lit(c) for c in CLASSES))).alias("relation"))
    is_p, is_a = F.col("predicted") == F.col("relation"), F.col("actual") == F.col("relation")
    t = long.groupBy(*by, "relation").agg(*(F.sum(c.cast("long") * F.col("n")).alias(n) for n, c in (("tp", is_p & is_a), ("fp", is_p & ~is_a), ("fn", ~is_p & is_a))))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    t = t.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sweep(pairs: DataFrame, floors: list[float], cuts: list[float]) -> DataFrame:
    """Macro and minimum F1 of every floor < cut over (sim, shared, actual), in one job. Pairs are first counted by
    the grid steps that they reach, so each row meets the grid as a count, not by itself."""
    bias = F.lit(1e-10)
    steps = lambda grid: sum((F.when(F.col("sim") + bias >= g, 1).otherwise(0) for g in sorted(grid)), F.lit(0))
    counted = pairs.groupBy(steps(floors).alias("nf"), steps(cuts).alias("nc"), "shared", "actual").agg(F.count("*").alias("n"))
    grid = [(float(f), float(c), i + 1, j + 1) for i, f in enumerate(sorted(floors)) for j, c in enumerate(sorted(cuts)) if f < c]
    points = F.explode(F.array(*(F.struct(F.lit(f).alias("floor"), F.lit(c).alias("cut"), F.lit(i).alias("i"), F.lit(j).alias("j")) for f, c, i, j in grid))).alias("g")
    rows = counted.select("*", points).select("nf", "nc", "shared", "actual", "n", "g.*")
    guess = F.when(F.col("nc") >= F.col("j"), "duplicate").when((F.col("nf") >= F.col("i")) & F.col("shared"), "contradiction").otherwise("independent")
    rows = rows.withColumn("predicted", guess)
    sums = []
    for k in CLASSES:
        p, a = F.col("predicted") == k, F.col("actual") == k
        sums += [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{k}_{m}") for m, c in (("tp", p & a), ("fp", p & ~a), ("fn", ~p & a))]
    rows = rows.groupBy("floor", "cut").agg(*sums)
    f1 = {k: F.coalesce(F.try_divide((2 * F.col(f"{k}_tp")).cast("double"), (2 * F.col(f"{k}_tp") + F.col(f"{k}_fp") + F.col(f"{k}_fn")).cast("double")), F.lit(0.0)) for k in CLASSES}
    return rows.select("floor", "cut", ((f1["duplicate"] + f1["contradiction"] + f1["independent"]) / 3).alias("macro_f1"), F.least(f1["duplicate"], f1["contradiction"]).alias("min_f1"))


def best_point(swept: DataFrame, by: str = "macro_f1") -> DataFrame:
    """The grid point of highest `by`, ties to the smallest floor, then cut."""
    return swept.orderBy(F.desc(F.round(F.col(by) + 1e-10, 6)), "floor", "cut").limit(1)


def calibrate(pairs: DataFrame, floors: list[float] | None = None, cuts: list[float] | None = None, prior: float = 0.95) -> dict[str, float]:
    """Thresholds fitted on the train split of (split, sim, shared, actual), judged on the held-out one."""
    floors = floors or [round(0.75 + 0.05 * i, 2) for i in range(4)]
    cuts = cuts or [round(0.88 + 0.01 * i, 2) for i in range(12)]
    best = best_point(sweep(pairs.where("split = 'train'"), floors, cuts)).first()
    held = pairs.where("split <> 'train'").withColumn("predicted", classify(F.col("sim"), F.col("shared"), best["floor"], best["cut"]))
    macro = prf(held).agg(F.avg("f1")).first()[0] or 0.0
    flags = prior_weighted_fp(held, prior).first()["fp_rate"] or 0.0
    return {"floor": best["floor"], "cut": best["cut"], "train_macro_f1": best["macro_f1"], "held_out_macro_f1": macro, "overfit": best["macro_f1"] - macro, "prior_weighted_fp": flags}


def prior_weighted_fp(pairs: DataFrame, prior: float = 0.95) -> DataFrame:
    """(fp_rate): the share of independent pairs that are flagged, times the prior of independence."""
    own = F.col("actual") == "independent"
    return pairs.agg((F.lit(prior) * F.coalesce(F.avg(F.when(own, (F.col("predicted") != "independent").cast("double"))), F.lit(0.0))).alias("fp_rate"))


def query_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query (query_id, n_relevant, first_rank, hit1, recall5, hit5, reach10, both5, mrr) of ranked
    (query_id, rank, item_id) against relevant (query_id, item_id); without relevant items, correct means
    that nothing came back."""
    hits = ranked.join(relevant, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.sum((F.col("rank") <= 5).cast("int")).alias("in5"))
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    got = ranked.groupBy("query_id").agg(F.count("*").alias("n_returned"))
    q = queries.select("query_id").join(n, "query_id", "left").join(hits, "query_id", "left").join(got, "query_id", "left").fillna(0, ["n_relevant", "in5", "n_returned"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    none = F.col("n_relevant") == 0
    return q.select(
        "query_id", F.col("n_relevant").cast("long").alias("n_relevant"), "first_rank", flag(F.col("first_rank") == 1).alias("hit1"),
        F.when(none, F.lit(0.0)).otherwise(F.col("in5") / F.col("n_relevant")).alias("recall5"), flag(F.col("first_rank") <= 5).alias("hit5"), flag(F.col("first_rank") <= 10).alias("reach10"),
        flag(~none & (F.col("in5") == F.col("n_relevant"))).alias("both5"), F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("mrr"), flag(none & (F.col("n_returned") == 0)).alias("correct_empty"),
    )


def noise_at(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (2, 3, 5, 8, 10)) -> DataFrame:
    """(n, found, noise): over all queries, relevant and other results among the first n."""
    rows = ranked.join(relevant.withColumn("good", F.lit(1)), ["query_id", "item_id"], "left")
    rows = rows.select("rank", F.coalesce("good", F.lit(0)).alias("good"), F.explode(F.array(*(F.lit(c) for c in cuts))).alias("n")).where(F.col("rank") <= F.col("n"))
    return rows.groupBy("n").agg(F.sum("good").alias("found"), (F.count("*") - F.sum("good")).alias("noise"))


def first_occurrence_ranks(lists: DataFrame) -> DataFrame:
    """(query_id, item_id, rank) of concatenated result lists (query_id, pos, item_id) without repeats."""
    from pyspark.sql import Window

    first = lists.groupBy("query_id", "item_id").agg(F.min("pos").alias("pos"))
    return first.select("query_id", "item_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("rank"))
