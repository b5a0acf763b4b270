"""Problem 8: verbatim passages of at least 160 characters in more than one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.spans import LEAST, shared_lengths, shared_pairs, text_classes
from cartulary.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its characters that also occur elsewhere."""
    return shared_lengths(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its exact copies and their number."""
    return text_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared, "p8_classes": p8_classes}

#: Every run of characters at every place, by its own text: no window, no hash of ours.
_RUNS = f"""
runs AS (SELECT doc_id, i, md5(substr(text, i, {LEAST})) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - {LEAST} + 2)) AS i FROM documents WHERE length(text) >= {LEAST})),
often AS (SELECT g FROM runs GROUP BY g HAVING min(doc_id) < max(doc_id)),
kept AS (SELECT doc_id, i, g FROM runs JOIN often USING (g))"""

SQL = {
    "p8_found": f"WITH {_RUNS}, d AS (SELECT DISTINCT doc_id, g FROM kept) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id",
    "p8_shared": f"WITH {_RUNS}, s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT DISTINCT doc_id, i FROM kept)), c AS (SELECT doc_id, sum(least(coalesce(j - i, {LEAST}), {LEAST}))::BIGINT AS shared FROM s GROUP BY doc_id) SELECT doc_id, length(text)::BIGINT AS n_chars, coalesce(shared, 0) AS shared FROM documents LEFT JOIN c USING (doc_id)",
    "p8_classes": f"SELECT doc_id, CASE WHEN length(text) >= {LEAST} THEN min(doc_id) OVER w ELSE doc_id END AS classe, CASE WHEN length(text) >= {LEAST} THEN count(*) OVER w ELSE 1 END AS copie FROM documents WINDOW w AS (PARTITION BY text)",
}
