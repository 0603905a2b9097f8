"""Driver queries of the corpus operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import table
from .decontam import contamination_report
from .fim import fill_in_middle, restore
from .langid import identify_languages
from .license import license_report
from .mixing import mix
from .oracles import ORACLES
from .phrases import collocations
from .quality import score_documents
from .simhash import simhash_classes
from .substr import remove_repeats
from .tokens import sentencepiece_pieces, token_counts
from .topk import exact_topk
from .urlfilter import judge

#: The vocabulary file of op9, a path on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"), shingle=3, budget=3)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_col="quality")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), sentencepiece_pieces(vocabulary))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    rows = restore(done, keep=("n", "prefix_chars", "middle_chars", "output_sha256", "form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_mixing": op2_mixing,
        "op3_url_filter": op3_url_filter,
        "op4_decontamination": op4_decontamination,
        "op5_quality": op5_quality,
        "op6_topk": op6_topk,
        "op7_chat_format": op7_chat_format,
        "op8_license_scan": op8_license_scan,
        "op9_token_counts": op9_token_counts,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_collocations": op11_collocations,
        "op12_language_id": op12_language_id,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
