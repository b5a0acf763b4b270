"""Card archives and the site map."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import text, values
from cartulary.operators import pages, sitemap
from cartulary.operators.ordering import in_order
from cartulary.operators.pages import SITE
from cartulary.plans.registry import Registry
from cartulary.plans.scalar_queries import DATE_SQL, xml_sql
from cartulary.session import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

_CUT = lambda x: f"nullif(CASE WHEN length({x}) > 158 THEN substr({x}, 1, 155) || '...' ELSE {x} END, '')"
_BARE = lambda x: f"regexp_replace({x}, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<.*?>', '', 'gs')"


def _decisions(spark, sf_dir):
    return table(spark, sf_dir, "giurisprudenza")


def _circulars(spark, sf_dir):
    return table(spark, sf_dir, "circolari")


def _slug(prefix):
    return F.concat(F.lit(prefix), F.col("scheda_id"), F.lit(".html"))


@register("prj1_circular_permalink", "SELECT scheda_id, 'circolari/' || scheda_id || '.html' AS permalink FROM circolari")
def prj1(spark, sf_dir):
    return _circulars(spark, sf_dir).select("scheda_id", _slug("circolari/").alias("permalink"))


@register("prj2_decision_permalink", "SELECT scheda_id, 'giurisprudenza/' || scheda_id || '.html' AS permalink FROM giurisprudenza")
def prj2(spark, sf_dir):
    return _decisions(spark, sf_dir).select("scheda_id", _slug("giurisprudenza/").alias("permalink"))


@register("prj3_page_permalink", "SELECT scheda_id, CASE WHEN esempio THEN pdf ELSE scheda_id || '.html' END AS permalink FROM giurisprudenza")
def prj3(spark, sf_dir):
    """Paged pages (here: the samples) keep their own address."""
    return _decisions(spark, sf_dir).select("scheda_id", F.when(F.col("esempio"), F.col("pdf")).otherwise(_slug("")).alias("permalink"))


@register("prj4_page_title", f"SELECT 'giurisprudenza' AS tabella, scheda_id, coalesce(CASE WHEN esempio THEN nullif(numero, '') END, nullif(corte, '') || ', ' || {DATE_SQL} || ' — {SITE.name}', '{SITE.name}') AS titolo FROM giurisprudenza UNION ALL SELECT 'circolari', scheda_id, coalesce(nullif(ente, '') || ', ' || {DATE_SQL} || ' — {SITE.name}', '{SITE.name}') FROM circolari")
def prj4(spark, sf_dir):
    none = F.lit(None).cast("string")
    d = _decisions(spark, sf_dir).select(F.lit("giurisprudenza").alias("tabella"), "scheda_id", pages.card_title(F.when(F.col("esempio"), F.col("numero")), F.col("corte"), none, F.col("date")).alias("titolo"))
    return d.unionByName(_circulars(spark, sf_dir).select(F.lit("circolari").alias("tabella"), "scheda_id", pages.card_title(none, none, F.col("ente"), F.col("date")).alias("titolo")))


_TOLD = SITE.default_description


@register("prj5_page_description", f"SELECT 'giurisprudenza' AS tabella, scheda_id, coalesce(CASE WHEN esempio THEN nullif(tipo, '') END, {_CUT(_BARE('massima'))}, '{_TOLD}') AS descrizione FROM giurisprudenza UNION ALL SELECT 'circolari', scheda_id, coalesce({_CUT(_BARE('oggetto'))}, '{_TOLD}') FROM circolari")
def prj5(spark, sf_dir):
    none = F.lit(None).cast("string")
    d = _decisions(spark, sf_dir).select(F.lit("giurisprudenza").alias("tabella"), "scheda_id", pages.card_description(F.when(F.col("esempio"), F.col("tipo")), F.col("massima"), none).alias("descrizione"))
    return d.unionByName(_circulars(spark, sf_dir).select(F.lit("circolari").alias("tabella"), "scheda_id", pages.card_description(none, none, F.col("oggetto")).alias("descrizione")))


@register("prj6_headline", f"SELECT scheda_id, coalesce(ente, '') || ', ' || {DATE_SQL} AS titolo FROM circolari")
def prj6(spark, sf_dir):
    return _circulars(spark, sf_dir).select("scheda_id", pages.headline(F.col("ente"), F.col("date")).alias("titolo"))


_HEAD = f"to_json(coalesce(corte, '') || ', ' || {DATE_SQL})::VARCHAR"


@register("prj7_structured_data", f"""SELECT scheda_id, '{{"@context":"https://schema.org","@graph":[{{"@type":"Article","headline":' || {_HEAD} || coalesce(',"datePublished":"' || strftime(date, '%Y-%m-%d') || '"', '') || ',"inLanguage":"it","mainEntityOfPage":"{SITE.base}giurisprudenza/' || scheda_id || '.html"}},{{"@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"Home","item":"{SITE.base}"}},{{"@type":"ListItem","position":2,"name":"Giurisprudenza","item":"{SITE.base}giurisprudenza.html"}},{{"@type":"ListItem","position":3,"name":' || {_HEAD} || '}}]}}]}}' AS json FROM giurisprudenza""")
def prj7(spark, sf_dir):
    json = pages.article_json(pages.headline(F.col("corte"), F.col("date")), F.col("date"), _slug("giurisprudenza/"), "Giurisprudenza", "giurisprudenza.html")
    return _decisions(spark, sf_dir).select("scheda_id", json.alias("json"))


_LIST_SQL = f"SELECT scheda_id, coalesce(tipo, '') || coalesce(' · ' || nullif(numero, ''), '') AS occhiello, coalesce(corte, '') || ', ' || {DATE_SQL} AS titolo, CASE WHEN length(massima) > 180 THEN substr(massima, 1, 177) || '...' ELSE massima END AS sunto, array_to_string(temi, '|') AS temi FROM giurisprudenza"


@register("prj8_archive_rows", _LIST_SQL)
def prj8(spark, sf_dir):
    c = F.col
    return _decisions(spark, sf_dir).select("scheda_id", pages.kicker(c("tipo"), c("numero")).alias("occhiello"), pages.headline(c("corte"), c("date")).alias("titolo"), text.truncated(c("massima"), 180).alias("sunto"), F.array_join("temi", "|").alias("temi"))


_SEC = lambda label, x: f"CASE WHEN {x} <> '' THEN '<p>{label}</p><p>' || {x} || '</p>' ELSE '' END"


@register("prj9_sections", f"SELECT scheda_id, {_SEC('Oggetto', 'oggetto')} || {_SEC('Testo', 'body')} || {_SEC('Documento', 'pdf')} || {_SEC('Allegati', 'al')} AS corpo FROM (SELECT *, array_to_string(list_transform(allegati, lambda a: a.label), ', ') AS al FROM circolari)")
def prj9(spark, sf_dir):
    parts = [("Oggetto", F.col("oggetto")), ("Testo", F.col("body")), ("Documento", F.col("pdf")), ("Allegati", F.array_join("allegati.label", ", "))]
    return _circulars(spark, sf_dir).select("scheda_id", F.concat(*(pages.section(label, x) for label, x in parts)).alias("corpo"))


@register("prj10_defaults", "SELECT scheda_id, coalesce(nullif(tipo, ''), 'Circolare') AS tipo, coalesce(nullif(pdflabel, ''), 'Scarica il documento (PDF)') AS etichetta FROM circolari")
def prj10(spark, sf_dir):
    return _circulars(spark, sf_dir).select("scheda_id", text.default(F.col("tipo"), F.lit(pages.KIND)).alias("tipo"), text.default(F.col("pdflabel"), F.lit(pages.FILE_LABEL)).alias("etichetta"))


@register("f7_archive_or_notice", "SELECT CASE WHEN count(*) > 0 THEN count(*) || ' schede' ELSE 'nessuna scheda' END AS riga, 'piena' AS caso FROM circolari UNION ALL SELECT 'nessuna scheda', 'vuota'")
def f7(spark, sf_dir):
    """The list or, where it is empty, its notice; once with all cards, once with none."""
    n = F.count(F.lit(1))
    line = F.when(n > 0, F.concat(n, F.lit(" schede"))).otherwise("nessuna scheda").alias("riga")
    cards = _circulars(spark, sf_dir)
    return cards.agg(line).withColumn("caso", F.lit("piena")).unionByName(cards.where(F.lit(False)).agg(line).withColumn("caso", F.lit("vuota")))


@register("f8_not_indexed", "SELECT scheda_id, coalesce(esempio, false) OR coalesce(tipo = '', false) AS escludi FROM giurisprudenza")
def f8(spark, sf_dir):
    return _decisions(spark, sf_dir).select("scheda_id", pages.any_of([F.col("esempio"), F.col("tipo") == ""]).alias("escludi"))


@register("a10_collection_size", "SELECT 'giurisprudenza' AS raccolta, count(*) AS n FROM giurisprudenza UNION ALL SELECT 'circolari', count(*) FROM circolari")
def a10(spark, sf_dir):
    of = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("raccolta"), "n")
    return of(_decisions(spark, sf_dir), "giurisprudenza").unionByName(of(_circulars(spark, sf_dir), "circolari"))


@register("o1_newest_first", "SELECT scheda_id, CAST(row_number() OVER (ORDER BY date DESC NULLS LAST, scheda_id) AS INTEGER) AS posto FROM giurisprudenza")
def o1(spark, sf_dir):
    return in_order(_decisions(spark, sf_dir).select("scheda_id", "date"), [F.desc_nulls_last("date"), F.col("scheda_id")]).select("scheda_id", "posto")


@register("o4_declared_order", "SELECT formato_id, CAST(row_number() OVER (ORDER BY CASE nome WHEN 'volume' THEN 0 WHEN 'raccolta' THEN 1 ELSE 2 END, capienza DESC, formato_id) AS INTEGER) AS posto FROM formati")
def o4(spark, sf_dir):
    """An order declared by hand, the rest by size."""
    declared = F.when(F.col("nome") == "volume", 0).when(F.col("nome") == "raccolta", 1).otherwise(2)
    return in_order(table(spark, sf_dir, "formati").withColumn("ord", declared), [F.col("ord"), F.desc("capienza"), F.col("formato_id")]).select("formato_id", "posto")


_S = "https://raccolta.example"
_MAP_SQL = f"""m AS (
  SELECT '{_S}/giurisprudenza/' || scheda_id || '.html' AS loc, strftime(date, '%Y-%m-%d') AS lastmod FROM giurisprudenza WHERE NOT coalesce(esempio, false)
  UNION ALL SELECT '{_S}/patto-interattivo/' || file, strftime(caricato_il, '%Y-%m-%d') FROM atti WHERE file <> 'index.html' AND file IS NOT NULL AND external IS DISTINCT FROM false)"""


def _entries(spark, sf_dir):
    cards = _decisions(spark, sf_dir).where(sitemap.listed(_slug("/giurisprudenza/"), F.lit(None).cast("boolean"), F.col("esempio"))).select(*sitemap.entries(_slug("/giurisprudenza/"), F.col("date"), _S))
    files = table(spark, sf_dir, "atti").where(sitemap.listed(F.col("file"), F.col("external"), F.lit(False)) & (F.col("file") != "index.html"))
    return cards.unionByName(files.select(*sitemap.entries(F.concat(F.lit("/patto-interattivo/"), "file"), F.col("caricato_il"), _S)))


@register("f1_listed_pages", "SELECT scheda_id, coalesce(pdf <> '', false) AND (tipo <> 'Decreto') IS DISTINCT FROM false AND NOT coalesce(esempio, false) AS in_mappa FROM giurisprudenza")
def f1(spark, sf_dir):
    """The switch is here whether the kind is another than Decreto: true, false or null."""
    return _decisions(spark, sf_dir).select("scheda_id", sitemap.listed(F.col("pdf"), F.col("tipo") != "Decreto", F.col("esempio")).alias("in_mappa"))


@register("prj21_map_entries", f"SELECT scheda_id, '{_S}/circolari/' || scheda_id || '.html' AS loc, strftime(caricata_il, '%Y-%m-%d') AS lastmod FROM circolari")
def prj21(spark, sf_dir):
    return _circulars(spark, sf_dir).select("scheda_id", *sitemap.entries(_slug("/circolari/"), F.col("caricata_il"), _S))


@register("u1_two_sources", f"WITH {_MAP_SQL} SELECT loc, lastmod FROM m")
def u1(spark, sf_dir):
    return _entries(spark, sf_dir)


@register("u2_lists_joined", "SELECT file AS percorso FROM atti UNION ALL SELECT DISTINCT bundle FROM atti")
def u2(spark, sf_dir):
    acts = table(spark, sf_dir, "atti")
    return acts.select(F.col("file").alias("percorso")).union(acts.select("bundle").distinct())


@register("a7_map_lines", f"WITH {_MAP_SQL} SELECT '  <url>' || chr(10) || '    <loc>' || {xml_sql('loc')} || '</loc>' || chr(10) || '    <lastmod>' || coalesce(lastmod, '') || '</lastmod>' || chr(10) || '  </url>' AS riga FROM m UNION ALL SELECT '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' UNION ALL SELECT '</urlset>'")
def a7(spark, sf_dir):
    return sitemap.lines(_entries(spark, sf_dir)).select("riga")


@register("o2_language_order", "SELECT loc, CAST(row_number() OVER (ORDER BY loc COLLATE icu_noaccent, loc) AS INTEGER) AS posto FROM (SELECT 'https://raccolta.example/patto-interattivo/' || file AS loc FROM atti WHERE file IS NOT NULL)")
def o2(spark, sf_dir):
    rows = table(spark, sf_dir, "atti").where("file IS NOT NULL").select(F.concat(F.lit(f"{_S}/patto-interattivo/"), "file").alias("loc"), F.lit("").alias("lastmod"))
    return sitemap.ordered(rows).select("loc", "posto")


_K3_SQL = f"SELECT '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || chr(10) || string_agg('  <url>' || chr(10) || '    <loc>' || {xml_sql('loc')} || '</loc>' || chr(10) || '    <lastmod>' || lastmod || '</lastmod>' || chr(10) || '  </url>', chr(10) ORDER BY loc) || chr(10) || '</urlset>' || chr(10) AS xml FROM (SELECT '{_S}/atti/' || lpad(CAST(rank() OVER (ORDER BY act) AS VARCHAR), 9, '0') || '?a&b' AS loc, strftime(caricato_il, '%Y-%m-%d') AS lastmod FROM atti)"


@register("k3_map_document", _K3_SQL)
def k3(spark, sf_dir):
    """One document of all acts; numbered addresses, in which every order agrees."""
    acts = in_order(table(spark, sf_dir, "atti").select("act", "caricato_il"), ["act"])
    url = F.concat(F.lit("/atti/"), F.lpad(F.col("posto").cast("string"), 9, "0"), F.lit("?a&b"))
    return sitemap.document(acts.select(*sitemap.entries(url, F.col("caricato_il"), _S)))


@register("d2_registered_views", "SELECT 'giurisprudenza' AS vista, count(*) AS n, max(date) AS ultima FROM giurisprudenza UNION ALL SELECT 'circolari', count(*), max(date) FROM circolari")
def d2(spark, sf_dir):
    for name in ("giurisprudenza", "circolari"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"raccolta_{name}")
    return spark.sql("SELECT 'giurisprudenza' AS vista, count(*) AS n, max(date) AS ultima FROM raccolta_giurisprudenza UNION ALL SELECT 'circolari', count(*), max(date) FROM raccolta_circolari")


@register("d4_table_to_document", "SELECT string_agg('## ' || nome || chr(10) || 'Capienza: ' || capienza, chr(10) || chr(10) ORDER BY capienza, formato_id) AS documento FROM formati")
def d4(spark, sf_dir):
    """A class of data and rendering: a table in, one document out."""

    class Listing:
        order = ("capienza", "formato_id")

        def data(self):
            return table(spark, sf_dir, "formati")

        def render(self, rows):
            part = F.concat(F.lit("## "), "nome", F.lit("\nCapienza: "), "capienza").alias("x")
            return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*self.order, part))), lambda r: r["x"]), "\n\n").alias("documento"))

    listing = Listing()
    return listing.render(listing.data())


@register("prj11_text_links", "SELECT act, '/patto-interattivo/' || file AS href, label || ' ' || coalesce(short, '') AS etichetta FROM atti")
def prj11(spark, sf_dir):
    return table(spark, sf_dir, "atti").select("act", F.concat(F.lit("/patto-interattivo/"), "file").alias("href"), F.concat("label", F.lit(" "), F.coalesce("short", F.lit(""))).alias("etichetta"))


@register("l3_summary_dates", f"SELECT scheda_id, {DATE_SQL} AS giorno, strftime(date, '%Y-%m-%d') AS iso FROM giurisprudenza")
def dates(spark, sf_dir):
    return _decisions(spark, sf_dir).select("scheda_id", values.date_label(F.col("date")).alias("giorno"), values.iso_day(F.col("date")).alias("iso"))
