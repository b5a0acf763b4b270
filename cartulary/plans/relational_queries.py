"""Extension: the relational categories of the survey's section 2.10, which its source lacks,
over the star schema. Sums of money are exact decimals."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.operators import intervals, search
from cartulary.plans.registry import Registry
from cartulary.session import scratch, table
from cartulary.sources import jdbc

register = Registry()
QUERIES, SQL = register.queries, register.sql


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


_CENTS = lambda x: F.sum(F.round(F.col(x) * 100).cast("bigint"))
_CENTS_SQL = "sum(CAST(round({0} * 100) AS BIGINT))::BIGINT"


@register("ext_sql_text", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_CENTS_SQL.format('l_extendedprice')} AS prezzo FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def sql_text(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("ext_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS prezzo FROM ext_lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")


@register("ext_inner_join", f"SELECT n_name, {_CENTS_SQL.format('o_totalprice')} AS totale FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner_join(spark, sf_dir):
    o, c, n = _t(spark, sf_dir, "orders", "customer", "nation")
    per = o.groupBy("o_custkey").agg(_CENTS("o_totalprice").alias("p"))  # pre-aggregated before the join
    rows = per.join(c, per["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("p").alias("totale"))


@register("ext_left_join", "SELECT c_custkey, count(o_orderkey) AS ordini FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return c.join(per, c["c_custkey"] == per["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("ordini"))


@register("ext_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "customer")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(urgent, "c_custkey", "left_semi").select("c_custkey")


@register("ext_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join(spark, sf_dir):
    p, li = _t(spark, sf_dir, "part", "lineitem")
    return p.join(li.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@register("ext_full_join", "SELECT coalesce(c_nationkey, s_nationkey) AS nazione, c.n AS clienti, s.n AS fornitori FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c_nationkey = s_nationkey")
def full_join(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    c = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nazione")).agg(F.count(F.lit(1)).alias("clienti"))
    s = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nazione")).agg(F.count(F.lit(1)).alias("fornitori"))
    return c.join(s, "nazione", "full")


@register("ext_as_of_join", "SELECT e.event_id, p.event_id AS prima FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'purchase'")
def as_of_join(spark, sf_dir):
    """The last view of the user at or before each purchase."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("prima"))
    return intervals.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["prima"], lambda t: F.date_trunc("day", t)).select("event_id", "prima")


@register("ext_range_join", "SELECT event_id, p.fascia FROM events JOIN (SELECT p_size AS fascia, CAST(p_size AS DOUBLE) AS low, p_size + 1.5::DOUBLE AS high FROM part GROUP BY p_size) p ON value >= low AND value < high")
def range_join(spark, sf_dir):
    e, p = _t(spark, sf_dir, "events", "part")
    bands = p.select(F.col("p_size").alias("fascia")).distinct().select("fascia", F.col("fascia").cast("double").alias("low"), (F.col("fascia") + 1.5).alias("high"))
    return intervals.range_join(e.select("event_id", "value"), bands, F.col("value"), F.col("low"), F.col("high"), 1.0).select("event_id", "fascia")


_SPANS = "SELECT act, row_number() OVER (PARTITION BY act ORDER BY caricato_il, art, heading) AS i, epoch_us(caricato_il) / 8.64e10::DOUBLE AS da, coalesce(epoch_us(rimosso_il) / 8.64e10::DOUBLE, 30000.0::DOUBLE) AS a FROM articoli WHERE rimosso_il IS NOT NULL AND act IS NOT NULL"


@register("ext_interval_join", f"WITH s AS ({_SPANS}) SELECT x.act, x.i AS i, y.i AS j FROM s x JOIN s y ON x.act = y.act AND x.da < y.a AND y.da < x.a AND x.i < y.i")
def interval_join(spark, sf_dir):
    """Articles of an act that were removed and in force at the same time."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 8.64e10
    rows = table(spark, sf_dir, "articoli").where("rimosso_il IS NOT NULL AND act IS NOT NULL")
    rows = rows.select("act", F.row_number().over(Window.partitionBy("act").orderBy("caricato_il", "art", "heading")).cast("bigint").alias("i"), micros("caricato_il").alias("da"), micros("rimosso_il").alias("a"))
    return intervals.overlaps(rows, rows, ["act"], 90.0).where("x.i < y.i").select("x.act", F.col("x.i").alias("i"), F.col("y.i").alias("j"))


@register("ext_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS livello, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("livello"), F.count(F.lit(1)).alias("n"))


@register("ext_cube", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS livello, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("livello"), F.count(F.lit(1)).alias("n"))


@register("ext_grouping_sets", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def grouping_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupingSets([[e["event_type"]], [e["user_id"]], []], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@register("ext_pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot(spark, sf_dir):
    kinds = ["click", "view", "purchase"]
    rows = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return rows.na.fill(0, kinds)


@register("ext_unpivot", "UNPIVOT (SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, length(s_name) AS lung FROM supplier) ON s_nationkey, lung INTO NAME campo VALUE valore")
def unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("s_nationkey"), F.length("s_name").cast("bigint").alias("lung"))
    return rows.unpivot("s_suppkey", ["s_nationkey", "lung"], "campo", "valore")


@register("ext_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS pezzi, count(DISTINCT l_suppkey) AS fornitori FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("pezzi"), F.countDistinct("l_suppkey").alias("fornitori"))


@register("ext_approx_distinct", "SELECT l_returnflag, true AS vicino FROM lineitem GROUP BY l_returnflag")
def approx_distinct(spark, sf_dir):
    """Whether the sketch's estimate lies within a tenth of the exact count."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("e"))
    return rows.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= F.col("e") * 0.1).alias("vicino"))


@register("ext_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS mediana, round(quantile_cont(value, 0.9), 6) AS nono FROM events GROUP BY event_type")
def quantiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("mediana"), F.round(F.percentile("value", 0.9), 6).alias("nono"))


@register("ext_approx_quantiles", "SELECT event_type, true AS vicino FROM events GROUP BY event_type")
def approx_quantiles(spark, sf_dir):
    """Whether the sketch's median has between 49 and 51 in a hundred rows at or below it."""
    e = table(spark, sf_dir, "events")
    mid = e.groupBy("event_type").agg(F.percentile_approx("value", 0.5, 10_000).alias("m"))
    rows = e.join(mid, "event_type").groupBy("event_type").agg((F.avg((F.col("value") < F.col("m")).cast("double"))).alias("b"), F.avg((F.col("value") <= F.col("m")).cast("double")).alias("a"))
    return rows.select("event_type", ((F.col("b") <= 0.51) & (F.col("a") >= 0.49)).alias("vicino"))


@register("ext_ranks", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ranks(spark, sf_dir):
    w, u = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    big = lambda c: c.cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", big(F.rank().over(w)).alias("r"), big(F.dense_rank().over(w)).alias("d"), big(F.row_number().over(u)).alias("n"), big(F.ntile(3).over(u)).alias("t"))


@register("ext_framed_windows", "SELECT event_id, lag(event_id, 1) OVER w AS prima, lead(event_id, 2) OVER w AS poi, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS ora FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def framed_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.lag("event_id").over(w).alias("prima"), F.lead("event_id", 2).over(w).alias("poi"), F.count(F.lit(1)).over(w.rowsBetween(-2, 1)).alias("n"), F.max("event_id").over(hour).alias("ora"))


@register("ext_set_operations", "SELECT 'intersezione' AS caso, n.k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier) n UNION ALL SELECT 'differenza', n.k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) n UNION ALL SELECT 'distinti', n.k FROM (SELECT DISTINCT s_nationkey AS k FROM supplier) n")
def set_operations(spark, sf_dir):
    c, s, n = _t(spark, sf_dir, "customer", "supplier", "nation")
    rich = c.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    sup, all_ = s.select(F.col("s_nationkey").alias("k")), n.select(F.col("n_nationkey").alias("k"))
    named = lambda df, x: df.select(F.lit(x).alias("caso"), "k")
    return named(rich.intersect(sup), "intersezione").unionByName(named(all_.subtract(rich), "differenza")).unionByName(named(sup.distinct(), "distinti"))


@register("ext_multiset_operations", "SELECT k, count(*) AS n FROM (SELECT l_linenumber AS k FROM lineitem EXCEPT ALL SELECT (o_orderkey % 7 + 1)::INTEGER FROM orders) GROUP BY k")
def multiset_operations(spark, sf_dir):
    li, o = _t(spark, sf_dir, "lineitem", "orders")
    left = li.select(F.col("l_linenumber").alias("k")).exceptAll(o.select((F.col("o_orderkey") % 7 + 1).cast("int").alias("k")))
    return left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register("ext_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@register("ext_top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@register("ext_math", "SELECT event_id, round(sin(value) + cos(value) + sqrt(value) + ln(value + 1) + exp(-value) + atan2(value, 2.0) + power(value, 0.5), 6) AS m FROM events")
def math(spark, sf_dir):
    v = F.col("value")
    m = F.sin(v) + F.cos(v) + F.sqrt(v) + F.log(v + 1) + F.exp(-v) + F.atan2(v, F.lit(2.0)) + F.pow(v, F.lit(0.5))
    return table(spark, sf_dir, "events").select("event_id", F.round(m, 6).alias("m"))


@register("ext_statistics", "SELECT event_type, round(stddev_samp(value), 6) AS s, round(var_pop(value), 6) AS v, round(corr(value, event_id), 6) AS c, round(skewness(value), 3) > -100 AS k FROM events GROUP BY event_type")
def statistics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("s"), F.round(F.var_pop("value"), 6).alias("v"), F.round(F.corr("value", F.col("event_id").cast("double")), 6).alias("c"), (F.round(F.skewness("value"), 3) > -100).alias("k"))


@register("ext_decimals", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS VARCHAR) AS netto FROM lineitem GROUP BY l_returnflag")
def decimals(spark, sf_dir):
    net = F.col("l_extendedprice").cast("decimal(15,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(net).cast("decimal(38,4)").cast("string").alias("netto"))


@register("ext_other_formats", "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def other_formats(spark, sf_dir):
    """A table through ORC, CSV and JSON files, each read with a schema."""
    s, root = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), scratch(spark, "formati")
    s.write.orc(f"{root}/orc")
    s.write.option("header", True).csv(f"{root}/csv")
    s.write.json(f"{root}/json")
    schema = "s_suppkey bigint, s_name string, s_acctbal double"
    csv = spark.read.schema(schema).option("header", True).csv(f"{root}/csv")
    return spark.read.orc(f"{root}/orc").unionByName(csv).unionByName(spark.read.schema(schema).json(f"{root}/json"))


@register("ext_database_table", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 3")
def database_table(spark, sf_dir):
    """A table through an embedded database, read in parts; the filter is the database's work."""
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    url = jdbc.embedded(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), scratch(spark, "banca-dati"), "supplier")
    return jdbc.read_table(spark, url, "supplier", jdbc.EMBEDDED, "s_suppkey", 4).toDF("s_suppkey", "s_name").where("s_suppkey > 3")


@register("ext_partitioned_layout", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type")
def partitioned_layout(spark, sf_dir):
    """A layout by kind of event: the filter reads two folders, the count no other column."""
    root = scratch(spark, "per-tipo")
    e = table(spark, sf_dir, "events")
    e.repartition("event_type", F.pmod(F.xxhash64("event_id"), F.lit(4))).write.partitionBy("event_type").parquet(root)
    return spark.read.parquet(root).where(F.col("event_type").isin("click", "error")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("ext_event_windows", "SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS inizio, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    w = F.window(F.col("ts"), "6 hours")
    return table(spark, sf_dir, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("inizio"), "n")


_TERMS = ["ricorso", "permesso", "udienza"]


@register("ext_text_ranking", """WITH w AS (SELECT scheda_id, regexp_extract_all(lower(coalesce(massima, '')), '[\\p{L}\\p{N}]+') AS p FROM giurisprudenza),
f AS (SELECT scheda_id, len(p) AS n, len(list_filter(p, lambda x: x = 'ricorso')) AS a, len(list_filter(p, lambda x: x = 'permesso')) AS b, len(list_filter(p, lambda x: x = 'udienza')) AS c FROM w),
s AS (SELECT count(*) AS t, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc FROM f)
SELECT scheda_id, round(ln(1 + (t - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (t - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (t - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / m)), 6) AS punti FROM f, s WHERE a > 0 OR b > 0 OR c > 0""")
def text_ranking(spark, sf_dir):
    return search.ranked(table(spark, sf_dir, "giurisprudenza"), "scheda_id", "massima", _TERMS).select("scheda_id", F.round("punti", 6).alias("punti"))


@register("ext_vector_search", "SELECT q, id, posto FROM (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::INTEGER AS posto FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE posto <= 10")
def vector_search(spark, sf_dir):
    """Exact: every row whose id is divisible by 50 against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("q", "id", "posto")
