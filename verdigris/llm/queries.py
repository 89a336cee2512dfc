"""The queries of the text problems, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm.leakage import leaked_passages, without_leaks
from verdigris.llm.sentences import split_sentences
from verdigris.llm.tokenization import decode_documents, encode_documents
from verdigris.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return decode_documents(p7_ids(spark, sf_dir))


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_matches(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left after the leaked ones are removed."""
    documents = table(spark, sf_dir, "documents")
    return without_leaks(documents, p8_matches(spark, sf_dir)).select("doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_decoded, p8_found, p8_matches, p8_clean, p9_found)}
