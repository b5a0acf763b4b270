"""Problem 4: personal information in the free texts of the cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.personal import found_spans, masked_texts
from cartulary.session import table

_TEXTS = {"giurisprudenza": "massima", "circolari": "oggetto"}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [found_spans(table(spark, sf_dir, t), "scheda_id", c).select(F.lit(t).alias("tabella"), "*") for t, c in _TEXTS.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in the place of what it holds."""
    parts = [masked_texts(table(spark, sf_dir, t), "scheda_id", c).select(F.lit(t).alias("tabella"), "*") for t, c in _TEXTS.items()]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
SQL: dict[str, str] = {}
