"""Menus, redirects, headers, links (J6, J13-J16, F6, F15, F16, P12, P22) and state over
events (T2-T9, L1): the latter are analogues of page behaviour over the table ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import paths, values
from cartulary.operators import events, site
from cartulary.plans.registry import Registry
from cartulary.session import scratch, table

register = Registry()
QUERIES, SQL = register.queries, register.sql

_NAV = '{"it": [{"label": "Testi", "href": "/testi.html", "items": [{"label": "Atti", "href": "/atti.html"}, {"label": "Fuori", "href": "https://altrove.example", "external": true}]}, {"label": "Chi siamo", "href": "/chi.html", "items": []}], "en": [{"label": "Texts", "href": "/texts.html"}]}'


def _menus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("lang").alias("lang"))
    return docs.select("doc_id", site.menu_of(values.parsed(F.lit(_NAV), site.MENU), F.col("lang")).alias("menu"))


_MENU_SQL = "(VALUES ('it', 0, 'Testi', true, 'Atti', '/sito/atti.html'), ('it', 0, 'Testi', true, 'Fuori', 'https://altrove.example'), ('it', 1, 'Chi siamo', false, 'Chi siamo', '/sito/chi.html'), ('en', 0, 'Texts', false, 'Texts', '/sito/texts.html')) m(l, posto, voce, con_figli, etichetta, href)"
_LANG_SQL = "CASE WHEN lower(lang) = 'en' THEN 'en' ELSE 'it' END"


@register("j6_menu_of_language", f"SELECT doc_id, CASE WHEN {_LANG_SQL} = 'en' THEN 'Texts' ELSE 'Testi|Chi siamo' END AS voci FROM documents")
def j6(spark, sf_dir):
    return _menus(spark, sf_dir).select("doc_id", F.array_join("menu.label", "|").alias("voci"))


@register("prj12_menu_items", f"SELECT doc_id, posto, voce, etichetta, href FROM documents JOIN {_MENU_SQL} ON l = {_LANG_SQL}")
def prj12(spark, sf_dir):
    return site.menu_rows(_menus(spark, sf_dir), prefix="/sito").drop("con_figli")


@register("f6_entries_with_children", f"SELECT doc_id, voce, con_figli FROM documents JOIN (SELECT DISTINCT l, voce, con_figli FROM {_MENU_SQL}) ON l = {_LANG_SQL}")
def f6(spark, sf_dir):
    return site.menu_rows(_menus(spark, sf_dir)).select("doc_id", "voce", "con_figli").distinct()


_REDIRECTS = [("/index.html", "/", 301, True), ("/favicon.ico", "/icone/32.png", 200, False), ("/circolari/1.html", "/circolari/2.html", 301, True), ("/circolari/3.html", "/manca.html", 302, False)]


def _requests(spark, sf_dir):
    rows = table(spark, sf_dir, "circolari").select(F.concat(F.lit("/circolari/"), "scheda_id", F.lit(".html")).alias("path"), F.lit(True).alias("esiste"))
    return rows.unionByName(spark.createDataFrame([("/index.html", True), ("/favicon.ico", False), ("/altro", False)], "path string, esiste boolean"))


_REQ_SQL = "r AS (SELECT '/circolari/' || scheda_id || '.html' AS path, true AS esiste FROM circolari UNION ALL VALUES ('/index.html', true), ('/favicon.ico', false), ('/altro', false))"


@register("j14_redirects", f"WITH {_REQ_SQL} SELECT path, CASE path WHEN '/index.html' THEN '/' WHEN '/favicon.ico' THEN '/icone/32.png' WHEN '/circolari/1.html' THEN '/circolari/2.html' ELSE path END AS verso, CASE WHEN path IN ('/index.html', '/circolari/1.html') THEN 301 WHEN path = '/favicon.ico' THEN 200 WHEN esiste THEN 200 ELSE 404 END::INTEGER AS stato FROM r")
def j14(spark, sf_dir):
    rules = spark.createDataFrame(_REDIRECTS, "da string, verso string, stato int, forza boolean")
    return site.redirected(_requests(spark, sf_dir), rules).select("path", "verso", "stato")


_HEADERS = [("/", "X-Frame-Options", "SAMEORIGIN"), ("/circolari/", "Cache-Control", "max-age=3600"), ("/circolari/altre/", "Cache-Control", "no-store"), ("/icone/", "Cache-Control", "max-age=86400")]


@register("j15_header_rules", f"WITH {_REQ_SQL} SELECT path, nome, valore FROM r JOIN (VALUES ('/', 'X-Frame-Options', 'SAMEORIGIN'), ('/circolari/', 'Cache-Control', 'max-age=3600'), ('/circolari/altre/', 'Cache-Control', 'no-store'), ('/icone/', 'Cache-Control', 'max-age=86400')) h(cartella, nome, valore) ON starts_with(path, cartella)")
def j15(spark, sf_dir):
    rules = spark.createDataFrame(_HEADERS, "cartella string, nome string, valore string")
    return site.with_headers(_requests(spark, sf_dir), rules).select("path", "nome", "valore")


@register("j13_menu_sections", "SELECT voce_id, CASE nome WHEN 'Ordinanza' THEN 'ordinanze' WHEN 'Decreto' THEN 'decreti' END AS sezione FROM voci")
def j13(spark, sf_dir):
    """A map from the text of a menu entry to a section; a text that is no key has none."""
    known = F.create_map(F.lit("Ordinanza"), F.lit("ordinanze"), F.lit("Decreto"), F.lit("decreti"))
    return table(spark, sf_dir, "voci").select("voce_id", F.try_element_at(known, F.col("nome")).alias("sezione"))


_LAST_SQL = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS url, arg_max(value, (ts, event_id)) AS y FROM events GROUP BY user_id"


@register("j16_restore_point", f"SELECT user_id, y FROM ({_LAST_SQL}) WHERE url = 'view'")
def j16(spark, sf_dir):
    """The stored place of each user, restored only on the page it belongs to."""
    stored = events.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return stored.where(paths.same_page(F.col("event_type"), F.lit("view"))).select("user_id", F.col("value").alias("y"))


@register("f16_same_page", "SELECT scheda_id, posizione, split_part(href, '#', 1) = '' OR regexp_extract(split_part(href, '#', 1), '([^/]*)$', 1) IN ('index.html', '') AS stessa FROM (SELECT scheda_id, unnest(norme).href AS href, (generate_subscripts(norme, 1) - 1)::INTEGER AS posizione FROM circolari) WHERE href IS NOT NULL")
def f16(spark, sf_dir):
    rows = table(spark, sf_dir, "circolari").select("scheda_id", F.posexplode("norme.href").alias("posizione", "href")).where("href IS NOT NULL")
    page = paths.page_of(F.col("href"))
    return rows.select("scheda_id", "posizione", paths.same_page(F.when(page == "", "").otherwise(paths.file_name(page)), F.lit("index.html")).alias("stessa"))


@register("prj22_localized_url", f"SELECT doc_id, CASE WHEN t = 'it' THEN b || h ELSE '/' || t || b || h END AS url FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'it' ELSE 'es' END AS t, CASE WHEN doc_id % 2 = 0 THEN '#a' ELSE '' END AS h, CASE doc_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '/' WHEN 2 THEN '/' ELSE '/atti/' || doc_id || '.html' END AS b FROM documents)")
def prj22(spark, sf_dir):
    d = F.col("doc_id")
    page = F.concat(F.lit("/atti/"), d, F.lit(".html"))
    path = F.when(d % 5 == 0, "/").when(d % 5 == 1, "/en/").when(d % 5 == 2, "/fr").when(d % 5 == 3, page).otherwise(F.concat(F.lit("/zh"), page))
    target = F.when(d % 3 == 0, "it").otherwise("es")
    return table(spark, sf_dir, "documents").select("doc_id", paths.localized(path, target, F.when(d % 2 == 0, "#a").otherwise("")).alias("url"))


@register("f15_swipes", "SELECT event_id, CASE WHEN event_id % 400 <= 300 AND abs(value - 60) >= 50 AND abs(event_id % 150) <= 100 THEN CASE WHEN value - 60 < 0 THEN 'left' ELSE 'right' END END AS verso FROM events")
def f15(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", events.swipe(F.col("value") - 60, e % 150, e % 400).alias("verso"))


_STEP_SQL = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN -1 WHEN 'purchase' THEN NULL ELSE 0 END"
_STACK_SQL = f"""a AS (SELECT *, {_STEP_SQL} AS s, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(coalesce(s, 0)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS t FROM a),
c AS (SELECT *, (t - least(min(t) OVER (PARTITION BY user_id, g ORDER BY ts, event_id), 0))::INTEGER AS profondita FROM b),
d AS (SELECT *, CASE WHEN profondita > 0 THEN last_value(CASE WHEN s = 1 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, g, profondita ORDER BY ts, event_id) END AS cima FROM c)"""


def _stacked(spark, sf_dir):
    kind = F.col("event_type")
    step = F.when(kind.isin("click", "view"), 1).when(kind == "error", -1).when(kind == "purchase", F.lit(None)).otherwise(0)
    return events.stacked(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], step, F.col("event_id"), lambda t: F.date_trunc("day", t))


@register("t2_breadcrumb_stack", f"WITH {_STACK_SQL} SELECT event_id, profondita, cima FROM d")
def t2(spark, sf_dir):
    """click and view push, error pops, purchase closes."""
    return _stacked(spark, sf_dir).select("event_id", "profondita", "cima")


@register("t3_return_stack", "SELECT user_id, event_id, posto FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS posto FROM events WHERE event_type IN ('click', 'view')) WHERE posto <= 30")
def t3(spark, sf_dir):
    """What the store keeps of each user's pushes: the last 30."""
    return events.last_rows(table(spark, sf_dir, "events").where("event_type IN ('click', 'view')"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "posto")


@register("l1_last_kept", "SELECT scheda_id, array_to_string(temi[-2:], '|') AS ultimi FROM giurisprudenza")
def l1(spark, sf_dir):
    return table(spark, sf_dir, "giurisprudenza").select("scheda_id", F.array_join(values.last_kept(F.col("temi"), 2), "|").alias("ultimi"))


@register("t4_undisturbed", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dopo FROM events) WHERE dopo IS NULL OR dopo > ts + INTERVAL 2 HOURS")
def t4(spark, sf_dir):
    return events.undisturbed(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], "2 HOURS").select("event_id")


@register("t5_debounced", "SELECT user_id, min(ts) AS inizio, max(ts) AS fine, count(*) AS n, max(event_id) AS ultimo FROM (SELECT *, sum(nuova) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS)::INT AS nuova FROM events)) GROUP BY user_id, s")
def t5(spark, sf_dir):
    rows = events.debounced(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], "2 hours")
    return rows.select("user_id", "inizio", "fine", "n", F.col("ultimo.event_id").alias("ultimo"))


@register("t6_throttled", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts)")
def t6(spark, sf_dir):
    return events.throttled(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"], "1 day").select("user_id", "event_id")


@register("t7_last_in_view", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id")
def t7(spark, sf_dir):
    return events.latest(table(spark, sf_dir, "events").where("event_type = 'view'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@register("t8_place_per_page", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS posto FROM events GROUP BY user_id, event_type")
def t8(spark, sf_dir):
    return events.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.col("value").alias("posto"))


@register("t9_tracked", "SELECT event_id, event_type AS nome, props AS dati FROM events WHERE event_type = 'click'")
def t9(spark, sf_dir):
    """Tracking as an append-only table."""
    root = scratch(spark, "tracce")
    table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.col("event_type").alias("nome"), F.col("props").alias("dati")).write.mode("append").parquet(root)
    return spark.read.parquet(root)
