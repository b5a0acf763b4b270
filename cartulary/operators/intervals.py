"""Joins on order: as-of, range and interval joins without a product of the two sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], step: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` of the same keys at
    or before its time; null where there is none. Both are put into one sorted stream, over
    which the last values are carried on; rows of ``right`` with equal times: the greatest
    values count. Null keys or times match nothing.

    ``step`` cuts the time (the day of a time, say): the stream of a key is then one of each
    of its steps, and what a step begins with is the last value of the steps before, of which
    there is one row each; a key with a third of all rows is many tasks."""
    whole = F.lit(0)
    kind = right.select(F.struct(*values)).dtypes[0][1]
    cut = (lambda: step(F.col("_t"))) if step else (lambda: whole)
    own = left.select(F.struct(*left.columns).alias("_l"), *keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"))
    other = right.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    other = other.select(F.lit(None).cast(own.dtypes[0][1]).alias("_l"), *keys, "_t", F.lit(0).alias("_side"), "_v")
    rows = own.unionByName(other).withColumn("_p", cut())
    w = Window.partitionBy(*keys, "_p").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last("_v", ignorenulls=True).over(w)
    if step:
        ends = other.withColumn("_p", cut()).groupBy(*keys, "_p").agg(F.max_by("_v", "_t").alias("_u"))
        steps = rows.select(*keys, "_p").distinct().join(ends, [*keys, "_p"], "left")
        before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("_u", F.last("_u", ignorenulls=True).over(before))
        rows = rows.withColumn("_k", known).join(steps, [*keys, "_p"], "left")
        known = F.coalesce("_k", "_u")
    usable = F.col("_t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    joined = rows.select("_l", "_side", F.when(usable, known).alias("_v")).where("_side = 1")
    return joined.select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= point < high: both sides are cut into buckets of ``width``, joined on
    the bucket and filtered; a range lies in as many buckets as it touches."""
    p = points.withColumn("_b", F.floor(point / width))
    r = ranges.where(low < high).withColumn("_b", F.explode(F.sequence(F.floor(low / width), F.ceil(high / width) - 1)))
    return p.join(r, "_b").where((low <= point) & (point < high)).drop("_b")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows of the same keys whose [da, a) overlap; both have da, a as numbers. A
    pair comes out in the first bucket that both touch, so once."""
    cut = lambda x: x.where("da < a").withColumn("_b", F.explode(F.sequence(F.floor(F.col("da") / width), F.ceil(F.col("a") / width) - 1)))
    x, y = cut(a).alias("x"), cut(b).alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "_b"]]
    first = F.floor(F.greatest("x.da", "y.da") / width) == F.col("x._b")
    return x.join(y, [*same, F.col("x.da") < F.col("y.a"), F.col("y.da") < F.col("x.a"), first])
