"""Problem 6: the corpus as ids of a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.tokens import token_ids, token_texts
from cartulary.session import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts read back from their ids: an exact round trip."""
    return token_texts(p6_ids(spark, sf_dir), "doc_id", "ids")


QUERIES = {"p6_ids": p6_ids, "p6_texts": p6_texts}
SQL = {"p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
