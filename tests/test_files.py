"""Files of other programs, read in ranges."""

import json
import struct

from lodestone.sources import store as ST
from lodestone.sources import transcripts as TR

UID = "123e4567-e89b-12d3-a456-42661417400"


def logs(folder, n=400):
    """Three logs of an agent, with odd lines: blank, malformed, of carriage returns, far longer than a range."""
    folder.mkdir()
    for i in range(3):
        lines = []
        for j in range(n):
            text = ("long " * 700 if j % 97 == 5 else f"turn {j} caf\u00e9\r lone") if j % 7 else "  "
            lines.append(json.dumps({"type": "user" if j % 2 else "assistant", "cwd": "/w", "message": {"role": "user", "content": text}}, ensure_ascii=False))
            if j % 11 == 0:
                lines.append(["", "{broken", json.dumps({"type": "meta"})][j % 3])
        (folder / f"{UID}{i}.jsonl").write_bytes(("\r\n" if i == 1 else "\n").join(lines).encode())


def test_a_file_in_ranges_has_the_turns_of_the_whole(spark, tmp_path):
    logs(tmp_path / "a")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    pick = lambda df: sorted((r.session_id, r.turn, r.role, r.content) for r in df.collect())
    whole = TR.read_agent_a(spark, str(tmp_path / "a"))
    assert whole.select("path", "start").distinct().count() == 3
    want = pick(whole)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        parts = TR.read_agent_a(spark, str(tmp_path / "a"))
        assert parts.select("path", "start").distinct().count() > 30
        assert pick(parts) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    said = [j for j in range(400) if j % 7]
    assert [(t, c[:4]) for s, t, _, c in want if s == f"{UID}1"] == [(t, "long" if j % 97 == 5 else "turn") for t, j in enumerate(said)]


def test_a_sidecar_is_read_by_many_tasks(spark, tmp_path):
    n, dim = 300, 4
    entries = {f"m:{i}": {"off": i * 2 * dim, "n": dim} for i in range(n)} | {f"s:{i}": {"off": i * 2 * dim, "n": 2 * dim} for i in range(n)}
    entries |= {"k:odd": {"off": 1, "n": dim}, "k:far": {"off": 2 * n * dim - 1, "n": dim}, "k:neg": {"off": -4, "n": dim}, "k:part": {"off": 0, "n": 3}, "k:none": {"off": 0, "n": 0}}
    (tmp_path / "i.json").write_text(json.dumps({"schema": 1, "dim": dim, "entries": entries}))
    values = [float(x % 251) for x in range(2 * n * dim)]
    (tmp_path / "b.bin").write_bytes(struct.pack(f"<{len(values)}f", *values) + b"xy")
    df = ST.read_sidecar(spark, str(tmp_path / "i.json"), str(tmp_path / "b.bin"), slice_bytes=1000)
    assert df.rdd.getNumPartitions() >= 8
    got = {(r.kind, r.id, r.part): list(r.embedding) for r in df.collect()}
    want = {("k", "odd", 0): values[1:5]}
    for i in range(n):
        at = i * 2 * dim
        want |= {("m", str(i), 0): values[at : at + dim], ("s", str(i), 0): values[at : at + dim], ("s", str(i), 1): values[at + dim : at + 2 * dim]}
    assert got == want
    same = ST.read_sidecar(spark, f"file://{tmp_path}/i.json", f"file://{tmp_path}/b.bin")
    assert same.count() == len(want)
    (tmp_path / "i2.json").write_text(json.dumps({"schema": 2, "dim": dim, "entries": entries}))
    assert ST.read_sidecar(spark, str(tmp_path / "i2.json"), str(tmp_path / "b.bin")).count() == 0
