"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import chat, decontaminate, language, licenses, media, mixture, neural, quality, ranking, repair, simhash, tokens, toxicity
from inkmill.llm._shared import table

#: The tokenizer's file within the folder of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op1(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op2(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op6(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op7(table(spark, sf_dir, "conversations"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op8(table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.op9(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op12(table(spark, sf_dir, "conversations"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_language_id, op3_simhash, op4_toxicity, op5_decontaminate, op6_token_ids, op7_chat, op8_media, op9_mixture, op10_quality, op11_ranked_search, op12_conversation_repair, op13_lm_score)
}
SQL: dict[str, str] = {"op7_chat": chat.SQL, "op11_ranked_search": ranking.SQL, "op12_conversation_repair": repair.SQL}
