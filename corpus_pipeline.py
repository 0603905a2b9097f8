"""The training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import drop_table, materialize, table
from lodestone.llm.decontam import keep_clean
from lodestone.llm.mixing import mix
from lodestone.llm.quality import keep_good
from lodestone.llm.simhash import drop_near_duplicates
from lodestone.llm.substr import remove_repeats

#: Words of a near-duplicate shingle and the similarity from which texts are copies; words of a
#: window that no two places may share; weights of the sources.
SHINGLE, SIMILARITY, WINDOW, WEIGHTS = 5, 0.8, 50, (5, 2, 1)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's own input, scores at least 0.5. Null and empty texts are
    scored as texts of no words, whole long texts as they are; repeated rows score alike and stay or go
    together; null ids are scored and fit nothing. An empty table gives no rows, a table without labels is
    scored 0.5 throughout and stays."""
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id; of rows equal in id and text
    one. Null, empty and wordless texts are no one's copies and stay; a text of its own stays whatever shares its
    id; null ids come last. Texts of any length are compared whole. An empty table gives no rows."""
    return drop_near_duplicates(docs.select(*COLUMNS), shingle=SHINGLE, similarity=SIMILARITY)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of WINDOW words that start earlier elsewhere; untouched texts stay as
    they are, null and short ones among them, and a text of which nothing is left goes. Of rows that share an id
    none is earlier; a null id is later than any other. An empty table gives no rows."""
    out = remove_repeats(docs, window=WINDOW, with_text=True, carry=["lang", "source", "n_chars"])
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return out.withColumn("n_chars", chars.cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Null and empty texts hold none and stay, null and empty items
    stand nowhere, long texts are searched whole, repeated rows and items are treated alike. Empty tables give no
    rows, or all."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a plan: every document, its text too, with its size, its source's target and the copies
    that the mix takes; 0 for those it leaves out. Null and empty texts have size 0, a null source is a source of
    its own, equal rows may be taken differently often. An empty table gives no rows."""
    return mix(docs, weights=WEIGHTS, carry=["text", "lang", "source", "n_chars"])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("mix", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; of the mix, the documents that it takes, each to be repeated `copies`
    times."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir).where("copies > 0")


#: No SQL expresses the classifier, SimHash and the knapsack; tests hold the stages against brute force.
ORACLE_SQL = None
