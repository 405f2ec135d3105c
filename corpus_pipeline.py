"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``, and pass further columns through, whatever their names. Every stage takes nulls in any column, empty
texts, texts of any length, repeated rows and an empty table; its docstring says what they give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapmill.llm.line_dedup import MIN_WORDS, dedup_lines
from mapmill.llm.mixing import mixed_documents
from mapmill.llm.near_duplicates import one_of_each
from mapmill.llm.packing import pack
from mapmill.llm.quality import accepted
from mapmill.llm.queries import table, tokenizer_file
from mapmill.storage import materialize


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where there is such a column, as long as its text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are.

    A null text is scored as an empty one. Each row is judged by its text alone, so repeated rows share their fate and ids
    play no part. Without labels every score is one half, which is accepted. An empty table stays empty.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines, of paragraphs of fifty words, and of whole short texts.

    Every row stays; a text of which all lines were repeats becomes empty, a null text stays null. Rows equal in id and text are one
    document and lose nothing to each other; a null id counts as the smallest. An empty table stays empty.
    """
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("n_lines", "n_deleted")}
    out = dedup_lines(docs.withColumnsRenamed(aside), min_words=MIN_WORDS).drop("n_lines", "n_deleted")
    return recounted(out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates.

    Of a group without ids one row stays, and of rows equal in id and text one. Blank and null texts belong to no group and stay.
    Texts are compared whole. An empty table stays empty.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them.

    Texts without words are left out, as the mix takes nothing of them. A null source is one source. Repeated rows are mixed as often as they
    stand; ties of the draw are broken by id, size and text. An empty table stays empty.
    """
    return recounted(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of the tokens of all documents.

    A null text is an empty one: a piece of the end token alone. Repeated rows and rows without an id are packed as often as
    they stand. Only doc_id and text are read. An empty table gives no piece.
    """
    return pack(docs, tokenizer_file())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier, MinHash and tokenizer stages have no SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
