"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import collocations, decontaminate, html_extract, oracle, packing, pii, quality_crf, quality_rules, simhash, substring_dedup, suffix_dedup, url_filter, vector_codes, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the contract, where the installed package keeps it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents")).drop("rejected_by")  # depends on the order that the sample gave


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_read(spark, sf_dir, "documents")).drop("kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("url", "payload")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.train(docs, _read(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_read(spark, sf_dir, "documents")).drop("kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings")).drop("label")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), url_filter.train(url_filter.labelled(spark))).drop("probability")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_decontaminate, op4_substring_dedup, op5_warc, op6_quality_classifier, op7_packing, op8_simhash, op9_html_extraction, op10_suffix_dedup, op11_vector_codes, op12_url_filter, op13_collocations)}
#: The others are beyond SQL; tests hold them against plain versions.
ORACLE: dict[str, str] = {
    "op2_quality_rules": oracle.QUALITY_RULES,
    "op3_decontaminate": oracle.DECONTAMINATION,
    "op4_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op5_warc": oracle.WARC,
    "op11_vector_codes": oracle.VECTOR_CODES,
    "op12_url_filter": oracle.URL_FILTER,
    "op13_collocations": oracle.COLLOCATIONS,
}
