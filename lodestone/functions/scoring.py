"""Scores and weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config

DEFAULT = Config()


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded with a small upward bias, so that sums taken in another order round alike."""
    return F.round(x + F.lit(10.0 ** -(digits + 4)), digits)


def at_least(x: Column, threshold: float | Column) -> Column:
    return x + F.lit(1e-10) >= threshold


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def time_factor(created: Column, depth: Column, now: float, config: Config = DEFAULT) -> Column:
    """0.5 to 1: decays with age, the slower the deeper a memory."""
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - created)
    return F.lit(0.5) + F.lit(0.5) * F.exp(-age * (F.lit(1.0) - F.lit(0.7) * depth) / F.lit(config.time_scale))


def depth_factor(depth: Column) -> Column:
    return F.lit(0.9) + F.lit(0.1) * depth


def clamp_weight(w: Column, config: Config = DEFAULT) -> Column:
    return F.greatest(F.lit(config.weight_min), F.least(F.lit(config.weight_max), w))


def superseded_depth(depth: Column, config: Config = DEFAULT) -> Column:
    return F.when(depth >= config.deep, depth * 0.8).otherwise(depth * 0.3)


def deepen(depth: Column, config: Config = DEFAULT) -> Column:
    return F.least(F.lit(1.0), depth + F.lit(config.depth_step))


def idf(n: Column, key_type: Column) -> Column:
    """Rarity of a key of n links; entity keys count half."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.lit(1.0) / n) * F.when(key_type.isin("name", "proper_noun"), 0.5).otherwise(1.0)


def absolute_gate(raw: Column, min_score: float) -> Column:
    return F.lit(True) if min_score <= 0 else at_least(raw, min_score)


def distribution_gate(z: Column, n: Column, gate_z: float, population: int = DEFAULT.gate_population) -> Column:
    """Passes where the gate is off, the population small, or the score stands out enough (a null z is
    an infinite one)."""
    return F.lit(True) if gate_z <= 0 else (n < population) | z.isNull() | at_least(z, gate_z)


def recall_status(hits: Column, active: Column) -> Column:
    return F.when(hits > 0, "found").when(active > 0, "no_match").otherwise("empty_namespace")


def contradiction_band(sim: Column, floor: float, dedup: float) -> Column:
    return at_least(sim, floor) & ~at_least(sim, dedup)
