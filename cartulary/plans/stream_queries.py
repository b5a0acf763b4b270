"""Extension: event-time streams over ``events``, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.plans.registry import Registry
from cartulary.session import scratch, table
from cartulary.streaming import events

register = Registry()
QUERIES, SQL = register.queries, register.sql


def _stream(spark, sf_dir):
    return events.event_stream(spark, f"{sf_dir}/events.parquet")


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_CLOSED = "fine <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@register("stream_tumbling", f"SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS inizio, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS fine, count(*) AS n FROM events GROUP BY ALL) WHERE {_CLOSED}")
def tumbling(spark, sf_dir):
    return _ntz(events.settled(events.window_counts(_stream(spark, sf_dir), ["event_type"], "6 hours"), "finestre"), "inizio", "fine")


@register("stream_sliding", f"SELECT * FROM (SELECT event_type, b - k * INTERVAL 1 HOUR AS inizio, b - k * INTERVAL 1 HOUR + INTERVAL 3 HOURS AS fine, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS b, unnest([0, 1, 2]) AS k FROM events) GROUP BY ALL) WHERE {_CLOSED}")
def sliding(spark, sf_dir):
    return _ntz(events.settled(events.window_counts(_stream(spark, sf_dir), ["event_type"], "3 hours", "1 hour"), "scorrevoli"), "inizio", "fine")


@register("stream_sessions", f"SELECT * FROM (SELECT user_id, min(ts) AS inizio, max(ts) + INTERVAL 2 HOURS AS fine, count(*) AS n FROM (SELECT *, sum(nuova) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOURS)::INT AS nuova FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s) WHERE {_CLOSED}")
def sessions(spark, sf_dir):
    return _ntz(events.settled(events.sessions(_stream(spark, sf_dir), "user_id", "2 hours"), "sessioni"), "inizio", "fine")


@register("stream_distinct", "SELECT event_id FROM events")
def distinct(spark, sf_dir):
    """Every event put into the stream twice comes out once."""
    s = _stream(spark, sf_dir)
    twice = s.withColumn("volta", F.explode(F.array(F.lit(1), F.lit(2)))).drop("volta")
    return events.settled(events.without_duplicates(twice, ["event_id"]), "distinti").select("event_id")


@register("stream_join", "SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOURS WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def join(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return events.settled(events.joined_within(s.where("event_type = 'click'"), s.where("event_type = 'purchase'"), "user_id", "3 HOURS"), "congiunti")


@register("stream_enriched", "SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def enriched(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return events.settled(events.enriched(_stream(spark, sf_dir), names, "user_id"), "arricchiti").select("event_id", "c_name")


@register("stream_kept_stack", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS pila FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('click', 'view')) WHERE r <= 30 GROUP BY user_id")
def kept_stack(spark, sf_dir):
    """Each batch appends the users' new stacks; a user's last one counts."""
    stacks = events.kept_stack(_stream(spark, sf_dir).where("event_type IN ('click', 'view')"), "user_id")
    root = scratch(spark, "pile")
    query = stacks.writeStream.outputMode("update").option("checkpointLocation", f"{root}/_stato").trigger(availableNow=True)
    query.foreachBatch(lambda df, n: df.withColumn("lotto", F.lit(n)).write.mode("overwrite").parquet(f"{root}/lotto={n}")).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).schema("user_id bigint, pila string, lotto bigint").parquet(f"{root}/lotto=*")
    return rows.groupBy("user_id").agg(F.max_by("pila", "lotto").alias("pila"))
