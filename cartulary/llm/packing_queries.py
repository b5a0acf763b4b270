"""Problem 7: the documents assigned to containers of every format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.packing import pack
from cartulary.llm.tokens import token_counts
from cartulary.session import table


def p7_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n", table(spark, sf_dir, "formati"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of room used, a format."""
    a = p7_assigned(spark, sf_dir).groupBy("formato_id", "contenitore").agg(F.sum("n").alias("n")).groupBy("formato_id").agg(F.count(F.lit(1)).alias("contenitori"), F.sum("n").alias("token"))
    f = table(spark, sf_dir, "formati").select("formato_id", "capienza")
    return a.join(f, "formato_id").select("formato_id", "contenitori", "token", F.expr("token / (contenitori * capienza)").alias("pieno"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every format: all documents are there, all tokens, no container is
    overfull, no document is cut that fits, pieces but the last fill a container."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = token_counts(docs, "doc_id", "text").withColumnRenamed("n", "intero")
    a = p7_assigned(spark, sf_dir).join(table(spark, sf_dir, "formati").select("formato_id", "capienza"), "formato_id")
    bins = a.groupBy("formato_id", "contenitore").agg(F.sum("n").alias("n"), F.first("capienza").alias("c")).groupBy("formato_id").agg(F.count_if(F.col("n") > F.col("c")).alias("sovraccarichi"))
    items = a.groupBy("formato_id", "doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parti"), F.first("capienza").alias("c"), F.count_if(F.col("n") < F.col("capienza")).alias("ridotte")).join(sizes, "doc_id", "left")
    wrong = F.count_if((F.col("n") != F.col("intero")) | F.col("intero").isNull()).alias("incompleti")
    cut = F.count_if((F.col("intero") <= F.col("c")) & (F.col("parti") > 1) | (F.col("parti") > 1) & (F.col("ridotte") > 1)).alias("tagliati")
    return items.groupBy("formato_id").agg(F.count(F.lit(1)).alias("documenti"), wrong, cut).join(bins, "formato_id")


QUERIES = {"p7_assigned": p7_assigned, "p7_fill": p7_fill, "p7_checked": p7_checked}
SQL = {"p7_checked": "SELECT formato_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documenti, 0::BIGINT AS incompleti, 0::BIGINT AS tagliati, 0::BIGINT AS sovraccarichi FROM formati WHERE capienza > 0"}
