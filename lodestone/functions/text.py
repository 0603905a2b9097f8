"""Text expressions: tokens, keys, literal matches, sentences. All are JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = r"[\s\p{P}]+"
_HANGUL = r"[㄰-㆏가-힣]"
_ONE_CJK = r"^[\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]$"
_MEANINGFUL = r"[\p{L}\p{N}_.+#-]+"
# Fixed value: versions (with what follows a hyphen or plus), #numbers, hexadecimal ids; no letter or digit beside them.
_STRUCTURED = r"(?i)(?:^|[^\p{L}\p{N}])((?:v?\d+\.)+\d+(?:[-+][\p{L}\p{N}.-]+)?|#[0-9]+|[a-f0-9]{7,40})(?=$|[^\p{L}\p{N}])"
# Words that say nothing about what a query is after.
FILLER = (
    "내", "나의", "뭐", "뭐야", "뭔가", "무슨", "어느", "있어", "있니", "알려", "알려줘", "해줘", "좋아해", "좋아하는", "선호하는", "쓰니", "했어", "관련", "대한",
    "what", "which", "who", "where", "when", "why", "how", "is", "are", "was", "were", "do", "does", "did", "my", "me", "tell", "about", "the", "a", "an", "please",
)


def terms(text: Column) -> Column:
    """Index terms: lower case, split at white space and punctuation."""
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda t: t != "")


def query_tokens(text: Column, filler: tuple[str, ...] = FILLER) -> Column:
    """Meaningful tokens of a query, in order, repeats included: two characters or more, no filler."""
    idle = F.array(*(F.lit(w) for w in filler))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_MEANINGFUL), F.lit(0)), lambda t: (F.length(t) >= 2) & ~F.array_contains(idle, t))


def structured_tokens(text: Column) -> Column:
    """Versions, #numbers and hexadecimal ids, in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_STRUCTURED), F.lit(1)))


def covers_structured(query: Column, haystack: Column) -> Column:
    """Whether all structured tokens of the query stand in the haystack."""
    return F.forall(structured_tokens(query), lambda t: F.contains(F.lower(haystack), t))


def covers_lexically(query: Column, haystack: Column) -> Column:
    """Whether over half of the query's meaningful tokens stand in the haystack; no tokens: false."""
    tokens = query_tokens(query)
    return F.size(F.filter(tokens, lambda t: F.contains(F.lower(haystack), t))) * 2 > F.size(tokens)


def short_concept(text: Column) -> Column:
    """At most two words, or at most 15 characters."""
    t = F.trim(text)
    return (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 2) | (F.length(t) <= 15)


def phrase_key(text: Column) -> Column:
    """Three words or more: a phrase rather than a concept."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) >= 3


def has_hangul(text: Column) -> Column:
    return text.rlike(_HANGUL)


def single_language(texts: Column) -> Column:
    """Whether all or none of an array of texts have Hangul."""
    return F.forall(texts, has_hangul) | F.forall(texts, lambda t: ~has_hangul(t))


def usable_keys(keys: Column) -> Column:
    """Trimmed keys of two characters or more, or of one East Asian character."""
    return F.filter(F.transform(keys, lambda k: F.trim(k)), lambda k: (F.length(k) >= 2) | k.rlike(_ONE_CJK))


def parse_keys(raw: Column) -> Column:
    """Keys given as a JSON array in a string; any other string is one key, null none."""
    listed = F.from_json(F.when(F.ltrim(raw).startswith("["), raw), "array<string>")
    return F.coalesce(listed, F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))


def literal_match(term: Column, query: Column) -> Column:
    """Whether a term of two characters or more stands in the query between non-letters."""
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}])\Q"), F.lower(term), F.lit(r"\E($|[^\p{L}\p{N}])"))
    # contains() is cheap and rules nearly all pairs out before a pattern is compiled
    return (F.length(term) >= 2) & F.contains(F.lower(query), F.lower(term)) & F.regexp_like(F.lower(query), pattern)


def conflicting_qualifier(a: Column, b: Column) -> Column:
    """Concepts equal but for a different one-character last word, such as "plan a" and "plan b"."""
    x, y = F.split(F.lower(F.trim(a)), r"\s+"), F.split(F.lower(F.trim(b)), r"\s+")
    n = F.size(x)
    last = lambda z: F.element_at(z, -1)
    return (n == F.size(y)) & (n >= 2) & (F.slice(x, F.lit(1), n - 1) == F.slice(y, F.lit(1), n - 1)) & last(x).rlike("^[a-z0-9]$") & last(y).rlike("^[a-z0-9]$") & (last(x) != last(y))


def sentences(text: Column, most: int = 12, least_chars: int = 10) -> Column:
    """Sentences of a text of at least `least_chars` each, the first `most`; none if there is only one."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?…])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least_chars)
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, most)).otherwise(F.array().cast("array<string>"))


def preview(text: Column, most: int, marker: str = "…") -> Column:
    """Text cut at `most` characters, marker included."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - len(marker))), F.lit(marker))).otherwise(text)


#: Fixed value: what follows a text that was cut, and names the way to the rest.
CUT_NOTICE = "\n…[truncated; use read_memory for full content]"


def cut_text(text: Column, most: int) -> Column:
    """Text of at most `most` characters, the notice of a cut included."""
    head = F.regexp_replace(F.substring(text, 1, max(0, most - len(CUT_NOTICE))), r"\s+\z", "")
    return F.when(F.length(text) > most, F.concat(head, F.lit(CUT_NOTICE))).otherwise(text)


def aliases(found: Column, concept: Column) -> Column:
    """Aliases of two characters or more, distinct regardless of case, without the concept itself."""
    kept = F.filter(found, lambda a: (F.length(F.trim(a)) >= 2) & (F.lower(F.trim(a)) != F.lower(concept)))
    first = F.transform(kept, lambda a: F.trim(a))
    return F.filter(first, lambda a, i: F.array_position(F.transform(first, lambda b: F.lower(b)), F.lower(a)) == i + 1)


def new_id(*parts: Column) -> Column:
    """A deterministic id of 12 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12)


def check_session(session: Column) -> Column:
    """The session id; an error if it isn't 1 to 128 letters, digits, dots, dashes or underscores."""
    return F.when(session.rlike(r"^[A-Za-z0-9._-]{1,128}$"), session).otherwise(F.raise_error(F.concat(F.lit("invalid session id: "), F.coalesce(session, F.lit("null")))))


def is_uuid(text: Column) -> Column:
    return text.rlike(r"^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def skip_prompt(text: Column, least: int = 6) -> Column:
    """Prompts too short for a passive look-up, and commands."""
    return (F.length(F.trim(text)) < least) | F.trim(text).startswith("/")


def merge_source(*maps: Column) -> Column:
    """Maps merged left to right, later ones winning."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    out = maps[0]
    for m in maps[1:]:
        out = two(out, m)
    return out


def retag_note(old_keys: Column, new_keys: Column) -> Column:
    """What a correction that named no keys should look at: the keys that it inherited."""
    inherited = (F.size(new_keys) == 0) & (F.size(old_keys) > 0)
    return F.when(inherited, F.concat(F.lit("keys kept from the earlier version: "), F.array_join(old_keys, ", ")))


def record_alias(found: Column, concept: Column, name: Column) -> Column:
    """The aliases `found` of a concept with one more name, unless it has under two characters or stands there
    already, whatever the case."""
    n = F.trim(name)
    known = (F.lower(n) == F.lower(concept)) | F.exists(found, lambda a: F.lower(a) == F.lower(n))
    return F.when((F.length(n) < 2) | F.coalesce(known, F.lit(False)), found).otherwise(F.concat(found, F.array(n)))


def surfaced_line(memory_id: Column, content: Column, relevance: Column, namespace: Column, most: int = 400) -> Column:
    """One line of a passive hint: id, relevance, namespace and the first `most` characters."""
    head = F.concat(F.lit("- ["), memory_id.cast("string"), F.coalesce(F.concat(F.lit(" rel="), relevance.cast("string")), F.lit("")))
    where = F.when(F.coalesce(namespace, F.lit("")) != "", F.concat(F.lit(" ns="), namespace)).otherwise("")
    text = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("…"))).otherwise(content)
    return F.concat(head, where, F.lit("] "), text)


def lenient_array(raw: Column) -> Column:
    """An array of strings from JSON text; an empty one where it is none."""
    return F.coalesce(F.from_json(F.when(F.ltrim(raw).startswith("["), raw), "array<string>"), F.array().cast("array<string>"))


def lenient_object(raw: Column) -> Column:
    """A map of strings from JSON text; null where it is no object."""
    return F.from_json(F.when(F.ltrim(raw).startswith("{"), raw), "map<string,string>")


def lenient_number(raw: Column, otherwise: float | None = None) -> Column:
    return F.coalesce(F.expr("try_cast(null as double)") if raw is None else raw.try_cast("double"), F.lit(otherwise).cast("double"))
