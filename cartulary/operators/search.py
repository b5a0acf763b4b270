"""Search over texts and vectors: extensions, for the categories that the surveyed source lacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors handled in one pass over the table.
BLOCK = 2048


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ranked(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, punti: BM25 of the rows that hold one of the terms (small letters). One pass
    counts the terms of each row; the corpus' figures are one row. Null and empty texts
    count as documents without words."""
    held = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))

    def times(term: str) -> Column:
        return F.size(F.filter(held, lambda w: w == term))

    rows = docs.select(F.col(key), F.size(held).alias("n"), *(times(t).alias(f"f{i}") for i, t in enumerate(terms)))
    figures = rows.agg(F.count(F.lit(1)).alias("all"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    points = F.lit(0.0)
    hit = F.lit(False)
    for i in range(len(terms)):
        weight = float(np.log(1 + (figures["all"] - figures[f"d{i}"] + 0.5) / (figures[f"d{i}"] + 0.5)))
        f = F.col(f"f{i}").cast("double")
        points = points + weight * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / (figures["mean"] or 1.0)))
        hit = hit | (F.col(f"f{i}") > 0)
    return rows.where(hit).select(key, points.alias("punti"))


def _block_nearest(keys: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k), -np.inf)
        ids = np.full((len(queries), k), -1, np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            flat = batch.column(1)
            at = flat.flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
            norm = np.linalg.norm(at, axis=1, keepdims=True)
            points = queries @ np.divide(at, norm, out=np.zeros_like(at), where=norm > 0).T
            points[keys[:, None] == own[None, :]] = -np.inf
            merged, who = np.hstack([best, points]), np.hstack([ids, np.broadcast_to(own, points.shape)])
            order = np.lexsort((who, -merged), axis=1)[:, :k]
            best, ids = np.take_along_axis(merged, order, 1), np.take_along_axis(who, order, 1)
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(ids[q, j]), pa.array(best[q, j])], names=["q", "id", "punti"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """q, id, punti, posto: the k rows of greatest cosine for each query (a row of its own is
    none), exact. The queries are a stated set: they pass over the table in blocks of BLOCK,
    each task keeps k rows a query, and the merge reads no more than k a query and task.
    Rows with null vectors, or of another length than most, are left out."""
    size = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("s")).count().orderBy(F.desc("count"), "s").first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "q bigint, id bigint, punti double, posto int")
    usable = lambda df: df.where(F.size(vector) == size["s"]).where(~F.exists(vector, lambda x: x.isNull())).select(F.col(key).cast("bigint").alias(key), vector)
    table, parts = usable(vectors), []
    block: list = []

    def flush() -> None:
        own = np.array([r[0] for r in block], np.int64)
        at = np.array([r[1] for r in block], np.float64)
        norm = np.linalg.norm(at, axis=1, keepdims=True)
        parts.append(table.mapInArrow(_block_nearest(own, np.divide(at, norm, out=np.zeros_like(at), where=norm > 0), k), "q bigint, id bigint, punti double"))
        block.clear()

    for row in usable(queries).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            flush()
    if block:
        flush()
    if not parts:
        return vectors.sparkSession.createDataFrame([], "q bigint, id bigint, punti double, posto int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("q").orderBy(F.desc("punti"), "id")
    return every.withColumn("posto", F.row_number().over(w)).where(F.col("posto") <= k)
