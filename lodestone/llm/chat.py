"""Chat formatting with tool calls linked to their results.

A message is a call message if its role is `assistant` and its text a JSON object with
`tool_calls`: [{"id", "name", "arguments"}] and maybe `content`, and a result if its role is `tool` and its text a
JSON object with `tool_call_id` and `content`. Calls meet results in a hash join on conversation and
identifier; an argument "$ID" makes a call depend on the result of call ID. Every message, call
and result becomes one row with its canonical JSON (keys sorted, no spaces, no nulls) and a place in a
topological order, so no conversation is ever gathered in one task. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Argument types by the SQL type that a parsed JSON value has.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}
#: The argument schemas of the query: tool, argument: (type, required).
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "digits": ("integer", False)},
}


def _right(fields: dict[str, tuple[str, bool]]):
    """Whether a map entry is one of the fields and of its type."""

    def test(e: Column) -> Column:
        out = F.lit(False)
        for field, (kind, _) in fields.items():
            out = F.when(e["key"] == field, F.coalesce(F.schema_of_variant(e["value"]).rlike(f"^{TYPES[kind]}$"), F.lit(False))).otherwise(out)
        return out

    return test


def _valid(args: Column, name: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether the arguments (map<string, variant>, null if no object) fit the tool's schema: known
    tool and arguments, types right, required ones there."""
    ok = F.lit(False)
    for tool, fields in schemas.items():
        fit = args.isNotNull()
        for field, (_, required) in fields.items():
            if required:
                fit &= F.array_contains(F.map_keys(args), field)
        fit &= F.forall(F.map_entries(args), _right(fields))
        ok = F.when(name == tool, F.coalesce(fit, F.lit(False))).otherwise(ok)
    return ok


def _canonical(text: Column) -> Column:
    """Canonical JSON of JSON text (null if it isn't JSON): an object's keys come out sorted."""
    return F.to_json(F.try_parse_json(text))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """(conv_col, turn, kind, idx, call_id, status, place, level, json): a row for each plain message,
    call and result; sorted by (place, level, turn, idx) a conversation stands in topological order.

    kind: message, call or result. Content beside calls is a message of its own, before them. idx: a
    call's position in its message, -1 for content beside calls, else 0. status: `ok` for
    messages; for calls `ok`, `invalid` (arguments against the schema), `duplicate` (the id stands
    earlier in the conversation), `cycle` (depends on itself) or `open` (no result); for results `ok`
    or `orphan` (no such call). place: the latest turn of the row and all that it depends on; level:
    the length of its longest dependency chain. Texts that only look like tool JSON are messages.
    Null texts give no content, null roles no role; null turns sort last; a null conversation is one
    of its own. Repeated rows stay (their repeated calls are duplicates of each other's id only by
    turn and idx, so equal rows share a status). An empty table gives no rows.
    """
    schemas = SCHEMAS if schemas is None else schemas
    m = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    shape = "tool_calls array<struct<id string, name string, arguments string>>, tool_call_id string, content string"
    looks = F.col("role").isin("assistant", "tool") & F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    m = m.withColumn("j", F.when(looks, F.from_json("text", shape)))
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size("j.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), F.lit(False))
    plain = m.where(~is_call & ~is_result).select(
        "conv", "turn", F.lit("message").alias("kind"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), F.col("turn").alias("place"), F.lit(0).alias("level"),
        F.to_json(F.struct(F.col("text").alias("content"), "role", "turn")).alias("json"),
    )
    tools = materialize(m.where(is_call | is_result).select("conv", "turn", "role", "j"), "tools")
    said = tools.where("role = 'assistant' AND j.content IS NOT NULL").select(
        "conv", "turn", F.lit("message").alias("kind"), F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), F.col("turn").alias("place"), F.lit(0).alias("level"),
        F.to_json(F.struct(F.col("j.content").alias("content"), "role", "turn")).alias("json"),
    )
    calls = tools.where("role = 'assistant'").select("conv", "turn", F.posexplode("j.tool_calls").alias("idx", "c"))
    calls = calls.select("conv", "turn", "idx", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.try_parse_json(F.coalesce("c.arguments", F.lit("{}"))).alias("args"))
    typed = F.when(F.schema_of_variant("args").startswith("OBJECT"), F.col("args").try_cast("map<string, variant>"))
    calls = calls.withColumn("valid", _valid(typed, F.col("name"), schemas))
    # an argument that is a string "$ID" depends on the result of call ID
    texts = F.transform(F.map_values(typed), lambda v: v.try_cast("string"))
    needs = F.transform(F.filter(texts, lambda t: F.coalesce(t.startswith("$"), F.lit(False))), lambda t: F.substr(t, F.lit(2)))
    calls = materialize(calls.withColumn("needs", F.coalesce(needs, F.array().cast("array<string>"))), "calls")
    results = tools.where("role = 'tool'").select("conv", "turn", F.col("j.tool_call_id").alias("call_id"), F.col("j.content").alias("content"))
    # the owner of an id is its earliest call; sums and minima combine before the shuffle
    owners = calls.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "idx")).alias("first"))
    answered = results.groupBy("conv", "call_id").agg(F.max("turn").alias("answer"))
    c, o, a = calls.alias("c"), owners.alias("o"), answered.alias("a")

    def on(x, y):
        return F.col(f"{x}.conv").eqNullSafe(F.col(f"{y}.conv")) & F.col(f"{x}.call_id").eqNullSafe(F.col(f"{y}.call_id"))

    linked = c.join(o, on("c", "o")).join(a, on("c", "a"), "left").select("c.*", F.col("o.first").eqNullSafe(F.struct("c.turn", "c.idx")).alias("owner"), F.col("a.conv").isNotNull() | F.col("a.answer").isNotNull() | F.col("a.call_id").isNotNull())
    linked = linked.toDF(*[*calls.columns, "owner", "has"])
    order = _levels(linked, results)
    l, d = linked.alias("l"), order.alias("d")
    placed = l.join(d, on("l", "d"), "left").select("l.*", F.col("d.place").alias("place"), F.coalesce("d.level", F.lit(0)).alias("level"), F.coalesce("d.cycle", F.lit(False)).alias("cycle"))
    status = F.when(~F.col("owner"), "duplicate").when(~F.col("valid"), "invalid").when(F.col("cycle"), "cycle").when(~F.col("has"), "open").otherwise("ok")
    call_rows = placed.select(
        "conv", "turn", F.lit("call").alias("kind"), F.col("idx").cast("int").alias("idx"), "call_id", status.alias("status"), F.greatest("turn", "place").alias("place"), F.col("level").cast("int").alias("level"),
        F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("assistant").alias("role"), "turn")).alias("json"),
    )
    r = results.alias("r")
    result_rows = r.join(o, on("r", "o"), "left").join(d, on("r", "d"), "left").select(
        F.col("r.conv").alias("conv"), F.col("r.turn").alias("turn"), F.lit("result").alias("kind"), F.lit(0).alias("idx"), F.col("r.call_id").alias("call_id"),
        F.when(F.col("o.first").isNull(), "orphan").otherwise("ok").alias("status"),
        F.greatest("r.turn", "d.place", "o.first.turn").alias("place"), (F.coalesce("d.level", F.lit(0)) + F.when(F.col("o.first").isNull(), 0).otherwise(1)).cast("int").alias("level"),
        F.to_json(F.struct(F.coalesce(F.when(F.col("r.content").rlike(r"^\s*[\[{]"), _canonical(F.col("r.content"))), F.col("r.content")).alias("content"), F.col("r.call_id").alias("id"), F.lit("tool").alias("role"), F.col("r.turn").alias("turn"))).alias("json"),
    )
    return plain.unionByName(said).unionByName(call_rows).unionByName(result_rows).withColumnRenamed("conv", conv_col)


def _levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv, call_id, place, level, cycle) of the owner calls, level by level: a call is settled once all
    calls whose results it needs are. Rounds go on, one for each step of the longest chain, until one
    settles nothing; what then is open depends on a cycle."""
    own = materialize(calls.where("owner").select("conv", "call_id", "turn", "needs"), "own")
    ready = own.where(F.size("needs") == 0).select("conv", "call_id", F.col("turn").alias("place"), F.lit(0).alias("level"), F.lit(False).alias("cycle"))
    open_ = materialize(own.where(F.size("needs") > 0).select("conv", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("need")), "open")
    if not open_.limit(1).count():
        return ready.distinct()
    known = own.select(F.col("conv").alias("kc"), F.col("call_id").alias("ki")).distinct()
    # needs of calls that don't exist bind nothing
    open_ = materialize(open_.join(known, F.col("conv").eqNullSafe(F.col("kc")) & (F.col("need") == F.col("ki")), "left").withColumn("bound", F.col("ki").isNotNull()).drop("kc", "ki"), "open")
    late = results.groupBy(F.col("conv").alias("ac"), F.col("call_id").alias("ai")).agg(F.max("turn").alias("answer"))
    settled = materialize(ready.distinct(), "settled")
    before = open_.count()
    while True:
        s = settled.select(F.col("conv").alias("sc"), F.col("call_id").alias("si"), F.col("place").alias("sp"), F.col("level").alias("sl"))
        step = open_.join(s, F.col("conv").eqNullSafe(F.col("sc")) & (F.col("need") == F.col("si")), "left").join(late, F.col("conv").eqNullSafe(F.col("ac")) & (F.col("need") == F.col("ai")), "left")
        step = step.groupBy("conv", "call_id", "turn").agg(
            F.bool_and(~F.col("bound") | F.col("si").isNotNull()).alias("free"), F.max(F.greatest("sp", "answer")).alias("sp"), F.max(F.coalesce(F.col("sl") + 2, F.lit(0))).alias("level")
        )
        new = step.where("free").select("conv", "call_id", F.greatest("turn", "sp").alias("place"), "level", F.lit(False).alias("cycle"))
        rest = materialize(open_.join(new.select(F.col("conv").alias("nc"), F.col("call_id").alias("ni")), F.col("conv").eqNullSafe(F.col("nc")) & (F.col("call_id") == F.col("ni")), "left_anti"), "open")
        both = materialize(settled.unionByName(new), "settled")
        for x in (open_, settled):
            drop_table(x)
        open_, settled = rest, both
        after = open_.count()
        if not after or after == before:
            break
        before = after
    stuck = open_.select("conv", "call_id", F.col("turn").alias("place"), F.lit(0).alias("level"), F.lit(True).alias("cycle")).distinct()
    return settled.unionByName(stuck)
