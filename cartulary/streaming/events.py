"""Structured Streaming over append-only event files: windows with watermarks, sessions,
duplicates, joins of streams, and state of one's own.

Every function takes and gives a streaming DataFrame; ``settled`` runs one to the end of what
is there and gives the result as a table. Times are event times; what is later than the
watermark is left out, as stated in each docstring.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.session import scratch


def event_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """The event files below ``path`` as a stream; ts becomes a time with zone (UTC), which
    watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    # as a pattern that matches nothing else: a plain path to the source must be a folder
    at = path.rstrip("/")
    return reader.parquet(f"{at[:-1]}[{at[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def settled(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there, exactly once by its checkpoint, and reads what
    it wrote. ``complete`` mode keeps the last state of the whole result."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_stato").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/righe").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/righe")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/righe")


def window_counts(stream: DataFrame, keys: list[str], window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """keys, inizio, fine, n of each window once it is closed: once an event ``late`` after its
    end was seen. Events behind the watermark are not counted."""
    rows = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", window, slide or window).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("inizio"), F.col("w.end").alias("fine"), "n")


def sessions(stream: DataFrame, user: str, gap: str, late: str = "1 hour") -> DataFrame:
    """user, inizio, fine, n of each closed session; fine is the last event's time plus the gap."""
    rows = stream.withWatermark("ts", late).groupBy(user, F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("inizio"), F.col("w.end").alias("fine"), "n")


def without_duplicates(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are remembered until the watermark has passed them."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def joined_within(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of a left event and a right one of the same key at most ``within`` later; state is
    kept no longer than that and the lateness."""
    a = left.withWatermark("ts", late).select(F.col(key).alias("k"), F.col("ts").alias("t_a"), F.col("event_id").alias("a"))
    b = right.withWatermark("ts", late).select(F.col(key).alias("k_b"), F.col("ts").alias("t_b"), F.col("event_id").alias("b"))
    near = (F.col("t_b") >= F.col("t_a")) & (F.col("t_b") <= F.col("t_a") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("k") == F.col("k_b")) & near).select(F.col("k").alias(key), "a", "b")


def enriched(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A stream with the columns of a table, null where it has no row of the key."""
    return stream.join(table, key, "left")


def kept_stack(stream: DataFrame, user: str, most: int = 30) -> DataFrame:
    """T3 as a stream: user, pila: after each batch the ids of the user's last ``most`` pushes,
    oldest first. The state of a user is bounded by ``most``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        for frame in frames:
            stack += sorted(zip(frame["ts"], frame["event_id"]))
            stack = [(pd.Timestamp(t), int(i)) for t, i in sorted((pd.Timestamp(t), int(i)) for t, i in stack)][-most:]
        state.update(([(t.to_pydatetime(), i) for t, i in stack],))
        yield pd.DataFrame({user: [key[0]], "pila": [",".join(str(i) for _, i in stack)]})

    kind = stream.schema[user].dataType.simpleString()
    out = f"{user} {kind}, pila string"
    return stream.where(F.col(user).isNotNull()).groupBy(user).applyInPandasWithState(run, out, "s array<struct<t:timestamp,i:bigint>>", "update", "NoTimeout")
