"""Thresholds and limits of retrieval, one frozen object instead of scattered knobs."""

from __future__ import annotations

import dataclasses
import os
import re
import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """Similarity thresholds that suit one family of embedding models."""

    key_merge: float
    memory_dedup: float
    key_autolink: float
    key_recall: float
    content_recall: float
    min_score: float
    contradiction: float
    gate_z: float = 0.0
    key_gate: float = 0.0
    short_key_merge: float = 0.0
    content_recall_short: float = 0.0

    def content_gate(self, short: bool) -> float:
        """Short queries get their own content threshold where the profile has one."""
        return self.content_recall_short if short and self.content_recall_short > 0 else self.content_recall


# Thresholds by model family, and the profile of the generated test vectors.
PROFILES = {
    "openai": Profile(0.85, 0.90, 0.50, 0.28, 0.28, 0.28, 0.85),
    "bge": Profile(0.85, 0.90, 0.60, 0.60, 0.50, 0.50, 0.85),
    "e5": Profile(0.97, 0.985, 0.93, 0.85, 0.80, 0.80, 0.95),
    "minilm": Profile(0.85, 0.90, 0.60, 0.50, 0.45, 0.45, 0.85),
    "bgem3": Profile(0.86, 0.94, 0.62, 0.62, 0.55, 0.55, 0.80, short_key_merge=0.90, content_recall_short=0.46),
    "testbed": Profile(0.42, 0.42, 0.30, 0.20, 0.25, 0.25, 0.30, gate_z=2.8, short_key_merge=0.40, content_recall_short=0.20),
}


@dataclass(frozen=True)
class Config:
    """Every limit and constant of the engine."""

    profile: Profile = PROFILES["bgem3"]
    # Fixed values of ranking.
    rrf_k: int = 60
    bm25_depth: int = 50
    dense_depth: int = 50
    top_keys: int = 10
    hop_decay: float = 0.3
    far_hop_factor: float = 0.7
    time_scale: float = 30 * 86400.0
    content_weight: float = 0.8
    content_blend: float = 0.2
    depth_step: float = 0.05
    deep: float = 0.7
    weight_min: float = 0.1
    weight_max: float = 3.0
    weight_default: float = 1.0
    reinforce: float = 0.1
    decay: float = 0.005
    hub_links: int = 3
    related_limit: int = 20
    explicit_bonus: float = 1.0
    rerank_pool: int = 30
    rerank_chars: int = 512
    rerank_min_score: float | None = None
    inject_min_rel: float = 0.2
    inject_max_chars: int = 2000
    push_min_rel: float = 0.6
    surfaced_chars: int = 400
    gate_population: int = 8
    sentence_max: int = 12
    sentence_min_chars: int = 10
    sentence_vectors: bool = True
    promote_n: int = 3
    confirm_floor: float = 0.45
    max_aliases: int = 8
    prune_age: float = 30 * 86400.0
    buffer_ttl: float = 300.0
    buffer_size: int = 32
    # Where the code's defaults are open to choice.
    bm25_scope: str = "global"
    dedup_scope: str = "global"
    allow_transcripts: bool = False


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


# Model names by the family whose thresholds suit them.
MODEL_FAMILIES = {
    "bgem3": ("bge-m3", "bgem3", "baai/bge-m3", "fast-bge-m3", "bge_m3"),
    "e5": ("fast-multilingual-e5-large", "multilingual-e5-large", "mle5large"),
    "bge": ("fast-bge-base-en-v1.5", "bge-base-en-v1.5", "bgebaseenv15", "fast-bge-small-en-v1.5", "bge-small-en-v1.5", "bgesmallenv15"),
    "minilm": ("fast-all-minilm-l6-v2", "all-minilm-l6-v2", "allminilml6v2"),
}


def normal_model(model: str) -> str:
    """A model name in lower case, with dashes for spaces and underscores, without the prefix of an enumeration."""
    return re.sub(r"[\s_]", "-", re.sub(r"(?i)^embeddingmodel\.", "", model.strip()).lower())


def family_of(model: str) -> str | None:
    """The family of a model name; None if it has none."""
    name = normal_model(model)
    return next((f for f, names in MODEL_FAMILIES.items() if name in names), None)


def model_prefix(family: str | None, kind: str) -> str:
    """What a text of a kind (`query` or `passage`) is prefixed with for models of a family."""
    return f"{kind}: " if family == "e5" else ""


def lookup(name: str, env: dict[str, str], prefix: str = "LODESTONE_", legacy: str | None = None) -> str | None:
    """A setting under its prefix, else under an older one."""
    return env.get(prefix + name, env.get(legacy + name) if legacy else None)


def data_dir(env: dict[str, str] | None = None, prefix: str = "LODESTONE_", legacy: str | None = None, home: str | None = None, folder: str = ".lodestone", legacy_folder: str | None = None) -> str:
    """The folder of a store: as set, else one in the home folder, of an older name if only that exists."""
    env = dict(os.environ) if env is None else env
    home = os.path.expanduser("~") if home is None else home
    new, old = os.path.join(home, folder), legacy_folder and os.path.join(home, legacy_folder)
    return lookup("DATA_DIR", env, prefix, legacy) or (old if old and os.path.exists(old) and not os.path.exists(new) else new)


def from_env(prefix: str = "LODESTONE_", profile: str = "bgem3", env: dict[str, str] | None = None, legacy: str | None = None, model: str | None = None) -> Config:
    """A Config with overrides such as LODESTONE_KEY_MERGE or LODESTONE_RELATED_LIMIT; values that don't
    parse or lie out of range are ignored. legacy: an older prefix, second choice. model: its family's profile
    replaces `profile`. An unknown profile or model means "bge", with a warning."""
    env = dict(os.environ) if env is None else env
    if model is not None:
        profile = family_of(model) or model
    if profile not in PROFILES:
        warnings.warn(f"unknown profile {profile!r}: using bge", stacklevel=2)
        profile = "bge"

    def number(name: str, low: float, high: float) -> float | None:
        try:
            value = float(lookup(name, env, prefix, legacy) or "")
        except ValueError:
            return None
        return value if low <= value <= high else None

    thresholds = {f.name: v for f in dataclasses.fields(Profile) if (v := number(f.name.upper(), 0, 1 if f.name != "gate_z" else 1e9)) is not None}
    ranges = {
        "related_limit": (1, 1e6), "hub_links": (2, 1e6), "rerank_pool": (1, 1e6), "inject_min_rel": (0, 0.9), "inject_max_chars": (256, 20000),
        "promote_n": (1, 1e6), "confirm_floor": (0, 1), "max_aliases": (0, 1e6), "prune_age": (0, 1e12), "rerank_min_score": (-1e9, 1e9),
    }
    whole = {"related_limit", "hub_links", "rerank_pool", "inject_max_chars", "promote_n", "max_aliases"}
    limits = {k: int(v) if k in whole else v for k, (a, b) in ranges.items() if (v := number(k.upper(), a, b)) is not None}
    return Config(profile=dataclasses.replace(PROFILES[profile], **thresholds), **limits)
