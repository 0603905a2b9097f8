"""Versioned snapshots of a graph, and the binary vector sidecar of older stores."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import aliases, sentences
from ..functions.vector import Embedder, embed
from ..operators import oplog
from ..operators.durable import cut
from ..schema import KEYS, LINKS, MEMORIES, SENTENCES, conform, prune_links

_TABLES = {"keys": KEYS, "memories": MEMORIES, "links": LINKS, "sentences": SENTENCES}


#: The namespace that gets no sentence vectors.
QUARANTINE = "bench"


def fill_vectors(rows: DataFrame, sidecar: DataFrame, kind: str, id_col: str, text: str, embedder: Embedder) -> DataFrame:
    """rows with a vector each: their own, else that of the sidecar (id, kind, part, embedding; kind m or k), else
    one embedded now."""
    side = sidecar.where((F.col("kind") == kind) & (F.col("part") == 0)).select(F.col("id").alias(id_col), F.col("embedding").alias("_side"))
    own = F.when(F.size("embedding") > 0, F.col("embedding"))
    rows = rows.join(side, id_col, "left").withColumn("embedding", F.coalesce(own, "_side"))
    have, none = rows.where("embedding IS NOT NULL"), rows.where("embedding IS NULL").drop("embedding")
    return have.drop("_side").unionByName(embed(none.drop("_side"), text, embedder))


class Store:
    """A directory of immutable snapshot versions with a pointer to the current one, on any file system
    that Spark reads. Readers keep the version that they opened; one writer at a time.

    What only reinforces is added to the operation log of the version, batch by batch, and merged when the store is
    read; `compact` makes a new version of it. A batch counts once it is whole. Batches that come between a `load` and
    the `save` of what was made of it go on to the log of the new version."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self._merged: set[str] = set()  # batches that the tables of this writer have in them
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """The numbers of the pointer files, ascending."""
        folder = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"CURRENT-(\d+)\.json", n)))

    def _point(self, text: str) -> None:
        """Write the next pointer under another name, then rename it: no moment is without a pointer."""
        have = self._pointers()
        tmp, to = self._path(f"{self.path}/.pointer-{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT-{(have[-1] if have else 0) + 1}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(tmp, to):
            raise RuntimeError(f"another writer has written {to}")
        for n in have[:-1]:  # the one before stays as a way back
            self._fs.delete(self._path(f"{self.path}/CURRENT-{n}.json"), False)

    def current(self) -> dict | None:
        have = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT-{have[-1]}.json", wholetext=True).first()[0]) if have else None

    def load(self) -> dict[str, DataFrame]:
        """keys, memories, links and sentences of the current version, its log merged; empty tables if there is none.
        Missing fields get defaults, links to nothing are left out."""
        now = self.current()
        if now is None:
            return {name: self.spark.createDataFrame([], schema) for name, schema in _TABLES.items()}
        out = {}
        for name, schema in _TABLES.items():
            folder = f"{self.path}/{now['version']}/{name}"
            out[name] = conform(self.spark.read.parquet(folder), schema) if self._fs.exists(self._path(folder)) else self.spark.createDataFrame([], schema)
        out["links"] = prune_links(out["links"], out["keys"], out["memories"])
        batches = self._batches(now["version"])
        self._merged = set(batches)
        return out | oplog.merged(self._rows(list(batches.values())), out, self.config) if batches else out

    def save(self, tables: dict[str, DataFrame], fingerprint: str | None = None) -> str:
        """Write a new version, then flip the pointer."""
        version, now = f"v-{uuid.uuid4().hex}", self.current() or {}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        dim = tables["memories"].where("embedding IS NOT NULL").select(F.size("embedding").alias("d")).first() if "memories" in tables else None
        streams, batches = dict(now.get("streams", {})), self._batches(now.get("version"))
        for name, folder in batches.items():
            if name not in self._merged:
                self._rows([folder]).write.parquet(f"{self._log(version)}/{name}")
            elif m := re.fullmatch(r"stream-(.+)/batch-(\d+)", name):
                streams[m[1]] = max(streams.get(m[1], -1), int(m[2]))
        self._point(json.dumps({"version": version, "fingerprint": fingerprint, "dim": dim and dim["d"], "streams": streams}))
        self._merged = set()
        return version

    def _log(self, version: str | None) -> str:
        return f"{self.path}/log-{version or 'none'}"

    def _batches(self, version: str | None) -> dict[str, str]:
        """The whole batches of a version's log: name to folder."""
        top = self._path(self._log(version))
        found = self._fs.globStatus(self._path(f"{self._log(version)}/*/*/_SUCCESS")) if self._fs.exists(top) else []
        folders = [f.getPath().getParent() for f in found]
        return {f"{p.getParent().getName()}/{p.getName()}": p.toString() for p in folders}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(oplog.LOG).parquet(*folders)

    def append_log(self, events: DataFrame, stream: str | None = None, batch: int | None = None, own: bool = False) -> bool:
        """Add rows (see `operators.oplog`, or changes of links: key_id, memory_id, seq, delta) to the log of the current
        version. stream and batch: name and number of a stream's batch, which replaces itself when it is run again, and is
        left out (False) if a version has it already; a stream that starts anew takes another name. own: the tables
        that this writer will save have these changes in them."""
        now = self.current() or {}
        if stream is not None and (batch is None or not re.fullmatch(r"[\w.-]+", stream)):
            raise ValueError("a batch of a stream has a number, and a name of letters, digits, dots and dashes")
        if stream is not None and batch <= now.get("streams", {}).get(stream, -1):
            return False
        rows = conform(events, oplog.LOG) if "kind" in events.columns else oplog.link_changes(events)
        name = f"once/{uuid.uuid4().hex}" if stream is None else f"stream-{stream}/batch-{batch}"
        rows.write.mode("overwrite").parquet(f"{self._log(now.get('version'))}/{name}")
        if own:
            self._merged.add(name)
        return True

    def compact(self) -> str | None:
        """Fold the log into a new version; None, and no new version, if there is nothing to fold."""
        now = self.current()
        if now is None or not self._batches(now["version"]):
            return None
        return self.save(self.load(), now.get("fingerprint"))

    def migrate(self, embedder: Embedder, force: bool = False, auto: bool = True) -> bool:
        """Embed everything anew if the embedder isn't the one that the store was written with, or has another
        dimension; a store without a fingerprint is left alone unless its dimension differs. Content, links and
        depth stay, and so does the earlier version in its directory."""
        now = self.current()
        if now is None:
            return False
        other = now.get("dim") not in (None, embedder.dim) or now.get("fingerprint") not in (None, embedder.fingerprint)
        if not force and not (auto and other):
            return False
        t = self.load()
        t["memories"] = embed(t["memories"], "content", embedder)
        t["keys"] = embed(t["keys"], "concept", embedder)
        t["sentences"] = sentence_vectors(t["memories"], embedder)
        self.save(t, embedder.fingerprint)
        return True


def sentence_vectors(memories: DataFrame, embedder: Embedder, have: DataFrame | None = None) -> DataFrame:
    """(memory_id, sent_idx, embedding) of the sentences of memories that have no pack yet; those in quarantine
    get none."""
    memories = memories.where(F.coalesce("namespace", F.lit("")) != QUARANTINE) if "namespace" in memories.columns else memories
    rows = memories if have is None else memories.join(have.select("memory_id").distinct(), "memory_id", "left_anti")
    rows = rows.select("memory_id", F.posexplode(sentences(F.col("content"))).alias("sent_idx", "sentence"))
    return embed(rows, "sentence", embedder).select("memory_id", "sent_idx", "embedding")


def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """keys, memories, links of a whole-graph JSON file (objects by id, as small stores have). A malformed
    file is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    # names that were learned are read apart, so that a malformed entry costs itself alone; a source is text or JSON
    key = "struct<id:string,concept:string,aliases:array<string>,key_type:string,embedding:array<float>,aliasCandidates:string,learnedAliases:string>"
    mem = "struct<id:string,content:string,embedding:array<float>,created_at:double,source:string,supersedes:string,depth:double,access_count:int,last_accessed:double,namespace:string,ttl:double,links:array<string>,contradicts:array<string>>"
    shape = f"struct<keys:map<string,{key}>,memories:map<string,{mem}>,links:array<struct<key_id:string,memory_id:string,weight:double>>>"
    doc = raw.select(F.from_json("v", shape, {"mode": "FAILFAST"}).alias("g"))
    k = doc.select(F.posexplode(F.map_values("g.keys")).alias("seq", "k")).select(F.col("k.id").alias("key_id"), "k.*", F.col("seq").cast("long").alias("seq"))
    asked = F.map_entries(F.from_json("aliasCandidates", "map<string,struct<count:int,lastSeen:double,queryText:string>>"))
    asked = F.filter(asked, lambda e: e["value"]["count"].isNotNull() & e["value"]["lastSeen"].isNotNull() & e["value"]["queryText"].isNotNull())
    asked = F.map_from_entries(F.transform(asked, lambda e: F.struct(e["key"], F.struct(e["value"]["count"].alias("count"), e["value"]["lastSeen"].alias("last_seen"), e["value"]["queryText"].alias("query_text")))))
    learned = F.filter(F.from_json("learnedAliases", "array<struct<alias:string,addedAt:double,hits:int>>"), lambda a: a["alias"].isNotNull() & a["addedAt"].isNotNull() & a["hits"].isNotNull())
    learned = F.transform(learned, lambda a: F.struct(a["alias"].alias("alias"), a["addedAt"].alias("added_at"), a["hits"].alias("hits")))
    k = k.withColumns({"aliases": aliases(F.coalesce("aliases", F.array().cast("array<string>")), F.col("concept")), "alias_candidates": asked, "learned_aliases": learned})
    m = doc.select(F.posexplode(F.map_values("g.memories")).alias("seq", "m"), F.map_keys("g.memories").alias("_ids")).select(F.col("m.id").alias("memory_id"), "m.*", F.col("seq").cast("long").alias("seq"), "_ids")
    m = m.withColumn("contradicts", F.array_intersect("contradicts", "_ids"))
    out = {"keys": conform(k, KEYS), "memories": conform(m, MEMORIES), "links": conform(doc.select(F.inline("g.links")), LINKS)}
    out["links"] = prune_links(out["links"], out["keys"], out["memories"]).dropDuplicates(["key_id", "memory_id"])
    return out


def load_legacy(spark: SparkSession, graph: str, embedder: Embedder, index: str | None = None, blob: str | None = None) -> dict[str, DataFrame]:
    """keys, memories, links and sentences of a whole-graph JSON file and, where given, its vector sidecar: a vector is
    the file's own, else the sidecar's, else made now. Saving the tables makes a store of today's form of them."""
    t = read_graph_json(spark, graph)
    side = read_sidecar(spark, index, blob) if index and blob else spark.createDataFrame([], "id string, kind string, part int, embedding array<float>")
    side = cut(side)  # it is read three times
    t["keys"] = conform(fill_vectors(t["keys"], side, "k", "key_id", "concept", embedder), KEYS)
    t["memories"] = conform(fill_vectors(t["memories"], side, "m", "memory_id", "content", embedder), MEMORIES)
    packs = side.where("kind = 's'").select(F.col("id").alias("memory_id"), F.col("part").alias("sent_idx"), "embedding")
    t["sentences"] = packs.join(t["memories"].select("memory_id"), "memory_id", "left_semi")
    return t


def read_sidecar(spark: SparkSession, index_path: str, blob_path: str, slice_bytes: int = 64 << 20) -> DataFrame:
    """(id, kind, part, embedding) of a float32 blob with a JSON index {schema, dim, entries: {id: {off, n}}};
    entries out of bounds or not a multiple of dim are left out. Ids start with m:, k: or s:.

    Entries are dealt by where they lie in the blob, some `slice_bytes` of it a task, and a task reads no more than
    the stretch of its own entries, one after the other: the blob may be of any size. Its file system is one that
    Arrow opens by URI (a local or mounted path, HDFS, an object store)."""
    shape = "struct<schema:int,dim:int,entries:map<string,struct<off:long,n:long>>>"
    index = spark.read.text(index_path, wholetext=True).select(F.from_json("value", shape).alias("i"))
    entries = index.where("i.schema = 1 AND i.dim > 0").select(F.col("i.dim").alias("dim"), F.explode("i.entries").alias("id", "e")).select("id", "dim", "e.off", "e.n")
    length = spark.read.format("binaryFile").load(blob_path).select(F.floor(F.col("length") / 4).alias("floats"))  # no content is read for it
    whole = entries.withColumn("_one", F.lit(1)).join(F.broadcast(length.withColumn("_one", F.lit(1))), "_one")
    whole = whole.where((F.col("off") >= 0) & (F.col("n") > 0) & (F.col("n") % F.col("dim") == 0) & (F.col("off") + F.col("n") <= F.col("floats")))
    size = length.first()
    slices = max(1, -(-4 * (size["floats"] if size else 0) // max(1, slice_bytes)))
    dealt = whole.select("id", "dim", "off", "n").repartitionByRange(slices, "off").sortWithinPartitions("off")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(blob_path) if "://" in blob_path or blob_path.startswith("file:") else (pafs.LocalFileSystem(), blob_path)
        with fs.open_input_file(name) as blob:
            for batch in batches:
                for e in batch.to_pylist():
                    blob.seek(4 * e["off"])
                    v = np.frombuffer(blob.read(4 * e["n"]), "<f4")
                    k = e["n"] // e["dim"]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * e["dim"], pa.int32()), pa.array(v, pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([e["id"][2:]] * k), pa.array([e["id"][:1]] * k), pa.array(range(k), pa.int32()), vectors], ["id", "kind", "part", "embedding"])

    return dealt.mapInArrow(parts, "id string, kind string, part int, embedding array<float>")
