"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens fetch candidate rules from the index, and only those run their regular expressions. A
short list of rules is a constant of the plan: all of it is one projection, and nothing is shuffled but
the counts of the rules' own tokens. A long one is a table that the tokens meet in an equi-join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

_TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Rules up to which the index is a constant of the plan.
CONSTANT_RULES = 5_000
_RULES = "name string, verdict string, pattern string, tokens array<string>, weight int"


@dataclass(frozen=True)
class Rule:
    """A rule on host + path. `tokens`: literal tokens that every URL it fits has whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Base rules go before the patterns, longer ones before shorter.
    weight: int

    @staticmethod
    def prefix(host: str, path: str, verdict: str) -> Rule:
        """Fits the host, its subdomains, and paths that start with `path` (from its slash on)."""
        literal = host + path
        tokens = _TOKEN.findall(host) + [m.group() for m in _TOKEN.finditer(path) if m.end() < len(path)]
        return Rule(literal, verdict, r"(?s)^(?:[^/]*\.)?" + re.escape(literal), tuple(tokens), 1_000_000 + len(literal))

    @staticmethod
    def regex(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
        """A pattern with the literal tokens that a URL must have (A-Z lower-cased) to fit."""
        return Rule(name, verdict, pattern, tokens, 0)


#: Host and path rules.
BASE_RULES = (
    Rule.prefix("com", "/", "allow"),
    Rule.prefix("example.com", "/en/", "block"),
    Rule.prefix("www.example.com", "/en/", "allow"),
    Rule.prefix("net", "/es/", "block"),
    Rule.prefix("net", "/fr/", "block"),
)
#: The method's own patterns, for URLs that no base rule fits.
PATTERN_RULES = (
    Rule.regex("casino-host", "block", r"(?i)^[^/]*\bcasino\b[^/]*", "casino"),
    Rule.regex("porn-host", "block", r"(?i)^[^/]*\bporn\b[^/]*", "porn"),
    Rule.regex("ads-path", "block", r"(?i)^[^/]*/(?:[^/]*/)*ads/", "ads"),
    Rule.regex("login-page", "block", r"(?i)/login(?:\.[a-z]+)?$", "login"),
    Rule.regex("cart-page", "block", r"(?i)/cart/checkout\b", "cart", "checkout"),
    Rule.regex("feed-file", "block", r"(?i)/feed\.xml$", "feed", "xml"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.substr(u, F.locate("://", u) + F.lit(3))).otherwise("")
    rest = F.split_part(F.split_part(rest, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    cut = F.locate("/", rest)
    host = F.when(cut > 0, F.split_part(rest, F.lit("/"), F.lit(1))).otherwise(rest)
    path = F.when(cut > 0, F.substr(rest, cut)).otherwise("")
    return ascii_lower(host), path


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[Rule, str]:
    """For each rule its token that the fewest of the rows' host + path (column _at) have."""
    wanted = sorted({t.lower() for r in rules for t in r.tokens})
    if any(not r.tokens for r in rules):
        raise ValueError("each rule needs a literal token")
    own = F.array_intersect(F.regexp_extract_all(F.lower("_at"), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*(F.lit(t) for t in wanted)))
    seen = {r["t"]: r["count"] for r in urls.select(F.explode(own).alias("t")).groupBy("t").count().collect()}  # one row a rule token
    return {r: min(r.tokens, key=lambda t: (seen.get(t.lower(), 0), t)).lower() for r in rules}


def _index(keys: dict[Rule, str]) -> tuple[Column, int]:
    """The rules of each token as a constant: an array of maps, addressed by the token's hash."""
    n = 1
    while n < len(keys):
        n *= 2
    slots: list[dict[str, list[Rule]]] = [{} for _ in range(n)]
    for rule, token in keys.items():
        slots[xxhash.xxh64_intdigest(token.encode(), 42) % n].setdefault(token, []).append(rule)

    def struct(r: Rule) -> Column:
        return F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))

    empty = F.expr("cast(map() as map<string, array<struct<weight: int, name: string, verdict: string, pattern: string>>>)")
    maps = [F.create_map(*(x for t, rs in s.items() for x in (F.lit(t), F.array(*(struct(r) for r in rs))))) if s else empty for s in slots]
    return F.array(*maps), n


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("_at"), F.lit("[a-z0-9]+"), F.lit(0)))


def _from_constant(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with the best base rule and the first pattern rule, as structs _base and _own."""
    index, n = _index(rarest_tokens(rows, rules))
    # xxhash64 is signed: its low bits address the index alike
    found = F.flatten(F.transform(_tokens(), lambda t: F.coalesce(F.get(index, F.xxhash64(t).bitwiseAND(F.lit(n - 1).cast("long")).cast("int"))[t], F.array())))
    fits = F.filter(found, lambda r: F.regexp_like(F.col("_at"), r["pattern"]))
    base = F.array_max(F.filter(fits, lambda r: r["weight"] > 0))
    own = F.array_min(F.filter(fits, lambda r: r["weight"] == 0))
    return rows.withColumn("_base", base).withColumn("_own", own)


def _from_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """As `_from_constant`, with the rules (_RULES) in a table of any size: a URL meets the rules whose rarest
    token it has. A token that a third of all URLs have is on the streamed side of a plain equi-join."""
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    said = rows.select("_row", "_at", F.explode(_tokens()).alias("token"))
    seen = said.groupBy("token").agg(F.count("*").alias("n"))
    wanted = rules.select("*", F.explode_outer(F.transform("tokens", lambda t: F.lower(t))).alias("token"))
    none = F.raise_error(F.lit("each rule needs a literal token"))
    wanted = wanted.withColumn("token", F.coalesce("token", none.cast("string"))).join(seen, "token", "left")
    rarest = wanted.groupBy("weight", "name", "verdict", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = materialize(rarest, "index")
    rule = F.struct("weight", "name", "verdict", "pattern")
    fits = said.join(index, "token").where(F.regexp_like("_at", F.col("pattern"))).groupBy("_row")
    best = fits.agg(F.max(F.when(F.col("weight") > 0, rule)).alias("_base"), F.min(F.when(F.col("weight") == 0, rule)).alias("_own"))
    return rows.join(best, "_row", "left")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] | DataFrame = BASE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """One row for each page: id_col, host, path, rule, verdict, pattern.

    rule: the longest base rule that fits, else null; verdict: its verdict, else that of the first
    pattern rule by name that fits (`pattern` names it), else `default`. Null urls and those
    without `://` have an empty host and path and get the default. Repeated rows stay, an empty
    table gives no rows, and other columns are ignored. rules: Rule objects, or a table of them with the
    columns of _RULES; a rule without a literal token is an error.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select(id_col, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_at", F.concat("host", "path"))
    if isinstance(rules, DataFrame):
        rows = _from_table(rows, rules)
    elif len(rules) > CONSTANT_RULES:
        rows = _from_table(rows, pages.sparkSession.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.weight) for r in rules], _RULES))
    else:
        rows = _from_constant(rows, rules)
    return rows.select(
        id_col, "host", "path", F.col("_base.name").alias("rule"),
        F.coalesce("_base.verdict", "_own.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("_base").isNull(), F.col("_own.name")).alias("pattern"),
    )
