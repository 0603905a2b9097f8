"""Conversation logs of agents as turns and sessions."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import check_session, is_uuid

UUID = r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
_BLOCKS = "array<struct<type:string,text:string>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, start, nth, value) of the lines of all *.jsonl files below a directory.

    Files are read in ranges of spark.sql.files.maxPartitionBytes, cut at line ends, so that one of any size is many
    tasks. start is where a line's range begins; nth grows within a range, as a range is read from one end to the other
    by one task. Both together are the order of a file's lines."""
    # the line end is given, or else a lone carriage return would end a line too
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), F.regexp_replace("value", r"\r$", "").alias("value"))
    return rows.where(F.trim("value") != "")


def _text(content: Column) -> Column:
    """A string, or the text blocks of an array joined by line ends."""
    blocks = F.from_json(content, _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"]), "\n")
    return F.when(F.ltrim(content).startswith("["), joined).otherwise(content)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows that say something, numbered within their file: each range counts its own, and starts where those before it
    end, so that no task sees a long file whole."""
    rows = rows.where(F.trim("content") != "")
    sums = rows.groupBy("path", "start").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("start")) - F.col("_n")  # a row a range
    place = F.row_number().over(Window.partitionBy("path", "start").orderBy("nth")) - 1
    rows = rows.withColumn("turn", place).join(sums.select("path", "start", before.alias("_before")), ["path", "start"])
    return rows.withColumn("turn", (F.col("turn") + F.col("_before")).cast("int")).drop("_before")


def read_agent_a(spark: SparkSession, path: str) -> DataFrame:
    """Turns of logs with one {type, sessionId, cwd, timestamp, message: {role, content}} a line; malformed
    lines and other types are skipped, turns numbered anew."""
    shape = "type string, sessionId string, cwd string, timestamp string, message struct<role:string,content:string>"
    rows = _lines(spark, path).withColumn("j", F.from_json("value", shape)).where(F.col("j.type").isin("user", "assistant"))
    session = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return _numbered(rows.select("path", "mtime", "start", "nth", F.lit("a").alias("agent"), session.alias("session_id"), F.col("j.cwd").alias("cwd"), F.col("j.type").alias("role"), _text(F.col("j.message.content")).alias("content"), F.col("j.timestamp").alias("ts")))


def read_agent_b(spark: SparkSession, path: str) -> DataFrame:
    """Turns of logs with session_meta and response_item lines."""
    shape = "type string, timestamp string, payload struct<type:string,role:string,content:string,id:string,cwd:string>"
    rows = _lines(spark, path).withColumn("j", F.from_json("value", shape))
    meta = rows.where("j.type = 'session_meta'").groupBy("path").agg(F.min_by("j.payload.id", F.struct("start", "nth")).alias("session_id"), F.min_by("j.payload.cwd", F.struct("start", "nth")).alias("cwd"))
    items = rows.where("j.type = 'response_item' AND j.payload.type = 'message' AND j.payload.role IN ('user', 'assistant')").join(meta, "path", "left")
    return _numbered(items.select("path", "mtime", "start", "nth", F.lit("b").alias("agent"), "session_id", "cwd", F.col("j.payload.role").alias("role"), _text(F.col("j.payload.content")).alias("content"), F.col("j.timestamp").alias("ts")))


def read_own(spark: SparkSession, path: str) -> DataFrame:
    """Turns of our own logs, {turn, role, content, ts} a line; a malformed line is an error."""
    rows = spark.read.schema("turn int, role string, content string, ts double").option("mode", "FAILFAST").json(path)
    return rows.select(check_session(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl?)?$", 1)).alias("session_id"), "turn", "role", "content", "ts")


def append_turns(turns: DataFrame, path: str) -> None:
    """Add turns (session_id, turn, role, content, ts) to the log, a folder for each session."""
    turns.withColumn("session_id", check_session(F.col("session_id"))).write.mode("append").partitionBy("session_id").json(path)


def next_turns(turns: DataFrame, by: str = "session_id") -> DataFrame:
    """(session, next_turn)."""
    return turns.groupBy(by).agg(F.count("*").alias("next_turn"))


def renumber(turns: DataFrame, by: str = "session_id", keep: Column | None = None) -> DataFrame:
    """Turns kept by a predicate, numbered from 0 within their session."""
    rows = turns if keep is None else turns.where(keep)
    return rows.withColumn("new_turn", F.row_number().over(Window.partitionBy(by).orderBy("turn")) - 1)


def window(turns: DataFrame, wanted: DataFrame, by: str = "session_id", reach: int = 2) -> DataFrame:
    """Turns at most `reach` positions from the wanted ones (by, center); positions count the session's turns."""
    rows = turns.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("turn")) - 1)
    return rows.join(wanted, by).where(F.abs(F.col("pos") - F.col("center")) <= reach)


def sessions(turns: DataFrame, by: str = "session_id", limit: int | None = None, preview: int = 80) -> DataFrame:
    """(session, n_turns, last_turn, preview): the first user message of each, latest first if turns have mtime."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", F.substring("content", 1, preview).alias("text"))))["text"]
    more = [F.max("mtime").alias("mtime"), F.first("cwd", ignorenulls=True).alias("cwd")] if "mtime" in turns.columns else []
    out = turns.groupBy(by).agg(F.count("*").alias("n_turns"), (F.count("*") - 1).alias("last_turn"), first.alias("preview"), *more)
    if limit is not None:
        out = out.orderBy(*([F.desc("mtime")] if more else []), by).limit(limit)
    return out


def host_session(env: dict[str, str], variables: dict[str, str]) -> tuple[str, str] | None:
    """(agent, session) that the host names: the first agent whose variable (variables: agent to name) holds a
    UUID; None if none does."""
    return next(((a, env[v]) for a, v in variables.items() if re.fullmatch(UUID, env.get(v, ""))), None)


def transcripts_open(env: dict[str, str], variables: dict[str, str], flag: str = "LODESTONE_TRANSCRIPT_ACCESS") -> bool:
    """Whether a caller may read transcripts: as the flag says, else if a host's session is set."""
    return env[flag] == "true" if env.get(flag) in ("true", "false") else any(env.get(v) for v in variables.values())


def active_session(listed: DataFrame, now: float, max_age: float = 300.0, host: tuple[str, str] | None = None) -> DataFrame:
    """The session that the host names, whatever its age; else the latest, if it is at most `max_age` seconds old."""
    if host is not None:
        own = listed.where(F.col("session_id") == host[1])
        return own.where(F.col("agent") == host[0]) if "agent" in listed.columns else own
    best = listed.orderBy(F.desc("mtime")).limit(1)
    return best.where(F.lit(float(now)) - F.col("mtime").cast("double") <= max_age)


def host_link(turns: DataFrame, agent: str, session_id: str) -> DataFrame:
    """One row (agent, session_id, turn): the latest turn of a session, 0 if it has none."""
    mine = turns.where((F.col("session_id") == session_id) & (F.col("agent") == agent)) if "agent" in turns.columns else turns.where(F.col("session_id") == session_id)
    return mine.agg(F.greatest(F.lit(0), F.count("*") - 1).alias("turn")).select(F.lit(agent).alias("agent"), F.lit(session_id).alias("session_id"), "turn")


PARSERS = {"a": read_agent_a, "b": read_agent_b}


def read_agent(spark: SparkSession, path: str, agent: str) -> DataFrame:
    """The turns of an agent's logs, by the agent's own parser."""
    if agent not in PARSERS:
        raise ValueError(f"no parser for agent {agent!r}: one of {', '.join(PARSERS)}")
    return PARSERS[agent](spark, path)


def session_file(spark: SparkSession, root: str, agent: str, session_id: str) -> str | None:
    """The log of a session below an agent's root: <session>.jsonl for agent a, *-<session>.jsonl for agent b, the
    first by path. Ids that aren't UUIDs have none, nor do files that links lead out of the root to."""
    if not re.fullmatch(UUID, session_id):
        return None
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    inside = fs.resolvePath(top).toString().rstrip("/")
    names = "" if agent == "a" else "*-"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{names}{session_id}.jsonl").load(root)
    for r in files.select("path").sort("path").toLocalIterator():  # the files of one session
        real = fs.resolvePath(jvm.org.apache.hadoop.fs.Path(r["path"])).toString()
        local = jvm.org.apache.hadoop.fs.Path(r["path"]).toUri()
        if local.getScheme() in (None, "file"):  # the local file system resolves no links by itself
            real, inside = os.path.realpath(local.getPath()), os.path.realpath(top.toUri().getPath())
        if real == inside or real.startswith(inside + "/"):
            return r["path"]
    return None


def load_session(turns: DataFrame, session_id: str) -> DataFrame:
    """Turns of a session whatever the agent, the first agent that has it; ids that aren't UUIDs have none."""
    rows = turns.where(F.col("session_id") == session_id).where(is_uuid(F.col("session_id")))
    return rows.withColumn("_a", F.dense_rank().over(Window.partitionBy("session_id").orderBy("agent"))).where("_a = 1").drop("_a")
