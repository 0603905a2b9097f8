"""Fill-in-middle rearrangement of texts by DuckDB inside Arrow batches.

A text is cut into units (runs of ASCII letters, or one other code point), two cuts are drawn from a
hash of the document's id, and prefix, middle and suffix are written in the order that a model is
trained on. Each slice of a batch is registered as a table and transformed by one SQL statement; rows
never become Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import pieces, release

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Text bytes of a statement: a unit takes some dozens of bytes while lists are made. A longer text goes alone.
SLICE_BYTES = 500_000


def _number(group: int) -> str:
    return f"CAST('0x' || substr(h, {8 * group - 7}, 8) AS UBIGINT)"


def transform_sql(plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> str:
    """Of rows (id, text) in `part`: id, n, form, prefix_chars, middle_chars, output. Ids of units are
    1-based in lists; a cut falls before unit `a` + 1 and before unit `b` + 1."""
    return f"""
WITH u AS (SELECT id, text, regexp_extract_all(text, '{UNIT}') AS units, sha256('1:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM part),
d AS (SELECT id, text, units, len(units) AS n, {_number(1)} % (len(units) + 1) AS x, {_number(2)} % (len(units) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_number(3)} % 100 >= {100 - plain} THEN 'plain'
    WHEN {_number(4)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT id, text, units, n, form, CAST(least(x, y) AS BIGINT) AS a, CAST(greatest(x, y) AS BIGINT) AS b FROM d),
p AS (SELECT id, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS head,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS mid, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS tail FROM c)
SELECT id, CAST(n AS BIGINT) AS n, form, CAST(length(head) AS BIGINT) AS prefix_chars, CAST(length(mid) AS BIGINT) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || head || '{SUFFIX}' || tail || '{MIDDLE}' || mid ELSE '{SUFFIX}' || tail || '{PREFIX}' || head || '{MIDDLE}' || mid END AS output FROM p
"""


#: Of rows (id, form, text) in `part` the texts before the change: a mark can't begin inside another mark, so that the
#: first one found is the one that was written.
RESTORE_SQL = f"""
WITH s AS (SELECT id, form, text, CASE form WHEN 'psm' THEN string_split(substr(text, {len(PREFIX) + 1}), '{SUFFIX}') WHEN 'spm' THEN string_split(substr(text, {len(SUFFIX) + 1}), '{PREFIX}') END AS halves FROM part),
m AS (SELECT id, form, text, halves[1] AS first, string_split(halves[2], '{MIDDLE}') AS rest FROM s)
SELECT id, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN first || rest[2] || rest[1] ELSE rest[1] || rest[2] || first END AS restored FROM m
"""


def _run(sql: str, names: list[str]):
    """A mapInArrow function that runs `sql` over slices of each batch, registered as `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one thread, as a task has one core, and no spill folder: slices are small
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for whole in batches:
            for batch in pieces(whole, "text", SLICE_BYTES):
                con.register("part", pa.Table.from_batches([batch]))
                out = con.sql(sql).to_arrow_table()
                con.unregister("part")
                yield from out.select(names).to_batches()
        con.close()
        release()

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row for each document: id_col, n (units of the text), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain), output (the rearranged text).

    The cuts and the form depend on id and text alone, so that reruns agree and repeated rows come out alike. A null
    text counts as empty; a null id is hashed as an empty one. Empty texts, and texts that hold a
    mark, stay plain. A text of any length is cut as a whole. Other columns play no part; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = rows.mapInArrow(_run(transform_sql(plain, suffix_first), names), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(outputs: DataFrame, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, restored): the texts that `fill_in_middle` rearranged, from form and output alone. Null
    forms and outputs give null."""
    kinds = dict(outputs.dtypes)
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = outputs.select(F.col(id_col).alias("id"), F.col(form_col).alias("form"), F.col(output_col).alias("text"), *kept)
    sql = RESTORE_SQL
    names = ["id", *(f"kept_{i}" for i in range(len(keep))), "restored"]
    if keep:
        more = ", ".join(names[1:-1])
        sql = sql.replace("SELECT id, ", f"SELECT id, {more}, ")
    schema = ", ".join([f"id {kinds[id_col]}", *(f"kept_{i} {kinds[c]}" for i, c in enumerate(keep)), "restored string"])
    out = rows.mapInArrow(_run(sql, names), schema)
    return out.select(F.col("id").alias(id_col), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "restored")
