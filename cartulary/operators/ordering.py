"""Global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.session import materialize

_ROW = (1 << 33) - 1


def in_order(rows: DataFrame, keys: list[Column | str], place: str = "posto") -> DataFrame:
    """``rows`` with ``place``, counted from 1 in the order of the keys (ties in any order:
    give keys that have none).

    Range-partitioned and sorted, then written: the partitions' sizes (one number each, on
    the driver) make the offsets, and no task sees more than its own partition."""
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = spread.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(_ROW))
    spread = materialize(spread, "ordine")
    sizes = {r["_p"]: r["n"] for r in spread.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    offsets = spread.sparkSession.createDataFrame(before, "_p int, _da bigint")
    kind = "int" if at < 2**31 else "bigint"
    return spread.join(offsets, "_p").withColumn(place, (F.col("_da") + F.col("_i") + 1).cast(kind)).drop("_p", "_i", "_da")
