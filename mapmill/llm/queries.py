"""Registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapmill.llm import toxicity
from mapmill.llm.host_rules import host_rules
from mapmill.llm.html_text import extract_text
from mapmill.llm.line_dedup import MIN_WORDS, dedup_lines
from mapmill.llm.merkle import manifest
from mapmill.llm.mixing import mix
from mapmill.llm.near_duplicates import near_duplicates
from mapmill.llm.neighbours import nearest
from mapmill.llm.packing import pack
from mapmill.llm.passages import repeated_text
from mapmill.llm.quality import classify
from mapmill.llm.secrets import scan_secrets
from mapmill.llm.vector_codes import compress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    return nearest(every, every.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return host_rules(table(spark, sf_dir, "documents")).select(*cols)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_words=MIN_WORDS).select("doc_id", "text", "n_lines", "n_deleted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_packing": op2_packing,
    "op3_host_rules": op3_host_rules,
    "op4_passages": op4_passages,
    "op5_mixing": op5_mixing,
    "op6_html_text": op6_html_text,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}
