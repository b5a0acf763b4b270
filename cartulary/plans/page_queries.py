"""Metadata and rewriting of pages.

The pages are made from the rows of ``articoli``: one page an article, in the states that a
rewrite has to tell apart (no title, tags of its own, stale or current block, none).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import paths, text
from cartulary.operators import pages
from cartulary.operators.ordering import in_order
from cartulary.operators.pages import SITE
from cartulary.plans.registry import Registry
from cartulary.plans.scalar_queries import BLANK_SQL, xml_sql
from cartulary.session import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

_ESC = lambda x: xml_sql(x, "&#x27;")
_BASE = SITE.base + SITE.folder
_CANON = f"'{_BASE}' || CASE WHEN ends_with(rel, '/index.html') THEN substr(rel, 1, length(rel) - 10) ELSE rel END"
_TOLD = """CASE WHEN starts_with(rel, 'dlgs-') THEN 'Testo coordinato di ' || nome || ' con le modifiche in evidenza' || CASE WHEN resto <> '' THEN ' (' || resto || ')' ELSE '' END || '.'
  WHEN starts_with(rel, 'ext-') THEN 'Testo navigabile di ' || nome || ', atto collegato.'
  WHEN resto <> '' THEN 'Testo navigabile di ' || resto || ' (' || nome || ').' ELSE 'Testo navigabile di ' || nome || '.' END"""
_BLOCK = (
    f"'{SITE.begin}\n<link rel=\"canonical\" href=\"' || {_ESC('url')} || '\">\n<meta name=\"description\" content=\"' || {_ESC('told')} || '\">\n<meta property=\"og:title\" content=\"' || {_ESC('title')}"
    f" || '\">\n<meta property=\"og:description\" content=\"' || {_ESC('told')} || '\">\n<meta property=\"og:url\" content=\"' || {_ESC('url')} || '\">\n<meta property=\"og:type\" content=\"article\">\n<meta property=\"og:site_name\" content=\"{SITE.name}\">\n<meta property=\"og:image\" content=\"{SITE.image}\">\n{SITE.end}'"
)
_HTML = f"""'<html><head>' || CASE WHEN stato = 0 THEN '' ELSE '<TITLE>' || raw || '</TITLE>' END
  || CASE stato WHEN 1 THEN '<link rel="canonical" href="x">' WHEN 2 THEN '\n{SITE.begin}vecchio{SITE.end}\n' WHEN 3 THEN '\n' || block || '\n' WHEN 4 THEN '<meta name="robots" content="none">' ELSE '' END
  || '</head><body><a class="home" href="/">Home</a><link href="assets/style.css' || CASE WHEN stato = 5 THEN '?v=00ff' ELSE '' END || '"></body></html>'"""

PAGES_SQL = f"""
p0 AS (
  SELECT act, art, caricato_il, length(coalesce(heading, '')) % 7 AS stato, '  ' || coalesce(heading, '') || CASE WHEN length(coalesce(heading, '')) % 2 = 0 THEN ' —\n ' || coalesce(label, '') || ' "&" \\1$1' ELSE '' END AS raw,
    CASE WHEN art = '1' THEN 'index.html' WHEN art = '2' THEN 'audit.html' WHEN bundle = 'esterni' THEN 'ext-' || act || '-' || art || '.html'
      WHEN starts_with(bundle, 'dlgs-') THEN bundle || '/' || CASE WHEN n_frammenti % 2 = 1 THEN 'index.html' ELSE art || '.html' END ELSE act || '-' || art || '.html' END AS rel
  FROM articoli),
p1 AS (SELECT *, trim(regexp_replace(raw, '{BLANK_SQL}+', ' ', 'g')) AS title FROM p0),
p2 AS (SELECT *, trim(split_part(title, '—', 1)) AS nome, CASE WHEN strpos(title, '—') > 0 THEN trim(substr(title, strpos(title, '—') + 1)) ELSE '' END AS resto FROM p1),
p3 AS (SELECT *, {_CANON} AS url, {_TOLD} AS told FROM p2),
p4 AS (SELECT *, {_BLOCK} AS block FROM p3),
pages AS (SELECT *, {_HTML} AS html, strpos({_HTML}, '</TITLE>') + 7 AS fine FROM p4),
esiti AS (SELECT *, CASE WHEN stato = 0 THEN 'skip' WHEN rel IN ('index.html', 'audit.html') THEN CASE WHEN stato = 4 THEN 'gia_ok' ELSE 'noindex' END WHEN stato = 2 THEN 'aggiornato' WHEN stato IN (1, 3) THEN 'gia_ok' ELSE 'iniettato' END AS esito FROM pages),
nuove AS (SELECT *, CASE esito WHEN 'noindex' THEN substr(html, 1, fine) || '\n{SITE.begin}\n<meta name="robots" content="noindex">\n{SITE.end}' || substr(html, fine + 1)
  WHEN 'iniettato' THEN substr(html, 1, fine) || '\n' || block || substr(html, fine + 1) WHEN 'aggiornato' THEN replace(html, '{SITE.begin}vecchio{SITE.end}\n', block || '\n') ELSE html END AS nuovo FROM esiti)"""


def site_pages(spark, sf_dir):
    """act, art, caricato_il, rel, html."""
    n = F.length(F.coalesce("heading", F.lit("")))
    head = F.coalesce("heading", F.lit(""))
    raw = F.concat(F.lit("  "), head, F.when(n % 2 == 0, F.concat(F.lit(" —\n "), F.coalesce("label", F.lit("")), F.lit(' "&" \\1$1'))).otherwise(""))
    own = F.concat("bundle", F.lit("/"), F.when(F.col("n_frammenti") % 2 == 1, "index.html").otherwise(F.concat("art", F.lit(".html"))))
    rel = F.when(F.col("art") == "1", "index.html").when(F.col("art") == "2", "audit.html").when(F.col("bundle") == "esterni", F.concat(F.lit("ext-"), "act", F.lit("-"), "art", F.lit(".html"))).when(F.startswith("bundle", F.lit("dlgs-")), own).otherwise(F.concat("act", F.lit("-"), "art", F.lit(".html")))
    rows = table(spark, sf_dir, "articoli").select("act", "art", "caricato_il", rel.alias("rel"), (n % 7).alias("stato"), raw.alias("raw"))
    stato, block = F.col("stato"), pages.meta_block(text.collapsed(F.col("raw")), F.col("rel"))
    tags = F.when(stato == 1, '<link rel="canonical" href="x">').when(stato == 2, f"\n{SITE.begin}vecchio{SITE.end}\n").when(stato == 3, F.concat(F.lit("\n"), block, F.lit("\n"))).when(stato == 4, '<meta name="robots" content="none">').otherwise("")
    title = F.when(stato == 0, "").otherwise(F.concat(F.lit("<TITLE>"), F.col("raw"), F.lit("</TITLE>")))
    html = F.concat(F.lit("<html><head>"), title, tags, F.lit('</head><body><a class="home" href="/">Home</a><link href="assets/style.css'), F.when(stato == 5, "?v=00ff").otherwise(""), F.lit('"></body></html>'))
    return rows.select("act", "art", "caricato_il", "rel", html.alias("html"))


_ID = ["act", "art", "caricato_il"]
_IDS = "act, art, caricato_il"


def _q(columns, where="", frm="nuove"):
    return f"WITH {PAGES_SQL} SELECT {_IDS}, {columns} FROM {frm} {where}"


def _titled(spark, sf_dir):
    return site_pages(spark, sf_dir).withColumn("t", pages.page_title(F.col("html")))


@register("prj13_canonical", _q("url", frm="p3"))
def prj13(spark, sf_dir):
    return site_pages(spark, sf_dir).select(*_ID, pages.canonical(F.col("rel")).alias("url"))


@register("prj14_description", _q("CASE WHEN stato > 0 THEN told END AS descrizione", frm="p3"))
def prj14(spark, sf_dir):
    return _titled(spark, sf_dir).select(*_ID, pages.description(F.col("t"), F.col("rel")).alias("descrizione"))


@register("prj15_meta_block", _q("CASE WHEN stato > 0 THEN block END AS blocco", frm="p4"))
def prj15(spark, sf_dir):
    return _titled(spark, sf_dir).select(*_ID, F.when(F.col("t").isNotNull(), pages.meta_block(F.col("t"), F.col("rel"))).alias("blocco"))


@register("k4_pages_rewritten", _q("esito, nuovo"))
def k4(spark, sf_dir):
    return pages.with_metadata(site_pages(spark, sf_dir)).select(*_ID, "esito", "nuovo")


@register("f13_changed_only", _q("nuovo", "WHERE nuovo <> html"))
def f13(spark, sf_dir):
    return pages.changed(pages.with_metadata(site_pages(spark, sf_dir))).select(*_ID, "nuovo")


@register("f5_noindex_pages", _q("rel IN ('index.html', 'audit.html') AS solo_noindex", frm="pages"))
def f5(spark, sf_dir):
    return site_pages(spark, sf_dir).select(*_ID, F.col("rel").isin(*SITE.noindex).alias("solo_noindex"))


@register("f11_guards", _q(f"contains(html, '{SITE.begin}') AS con_blocco, contains(html, 'class=\"logo\"') AS con_logo", frm="pages"))
def f11(spark, sf_dir):
    html = F.col("html")
    return site_pages(spark, sf_dir).select(*_ID, F.contains(html, F.lit(SITE.begin)).alias("con_blocco"), F.contains(html, F.lit('class="logo"')).alias("con_logo"))


@register("f12_own_tags", _q("stato = 4 AS robots, stato IN (1, 3) AS proprio", frm="pages"))
def f12(spark, sf_dir):
    html = F.col("html")
    own = F.rlike(html, F.lit('rel="canonical"')) | F.rlike(html, F.lit('name="description"'))
    return site_pages(spark, sf_dir).select(*_ID, F.rlike(html, F.lit('name="robots"')).alias("robots"), own.alias("proprio"))


@register("a1_outcomes", f"WITH {PAGES_SQL} SELECT o.esito, count(n.esito) AS n FROM (VALUES ('iniettato'), ('aggiornato'), ('gia_ok'), ('noindex'), ('skip')) o(esito) LEFT JOIN nuove n ON n.esito = o.esito GROUP BY o.esito")
def a1(spark, sf_dir):
    return pages.tally(pages.with_metadata(site_pages(spark, sf_dir)).select("esito"), "esito")


@register("a1_second_run", f"WITH {PAGES_SQL}, s AS (SELECT CASE WHEN esito = 'iniettato' THEN 'aggiornato' WHEN esito IN ('aggiornato', 'noindex') THEN 'gia_ok' ELSE esito END AS esito FROM nuove) SELECT o.esito, count(s.esito) AS n FROM (VALUES ('iniettato'), ('aggiornato'), ('gia_ok'), ('noindex'), ('skip')) o(esito) LEFT JOIN s USING (esito) GROUP BY o.esito")
def a1_again(spark, sf_dir):
    """The outcomes of a second run over the first one's pages: an injection without a line
    end behind it is brought up to date once, then all is settled."""
    once = pages.with_metadata(site_pages(spark, sf_dir)).select("rel", F.col("nuovo").alias("html"))
    return pages.tally(pages.with_metadata(once).select("esito"), "esito")


@register("a11_pages_processed", "SELECT count(*) AS n FROM articoli")
def a11(spark, sf_dir):
    return site_pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@register("k6_report", f"WITH {PAGES_SQL} SELECT count(*) || ' pagine: ' || count(*) FILTER (WHERE esito = 'iniettato') || ' iniettate, ' || count(*) FILTER (WHERE esito = 'skip') || ' saltate' AS riga, count(*) FILTER (WHERE esito = 'skip') > 0 AS da_segnalare FROM nuove")
def k6(spark, sf_dir):
    """The report of a run as one row; ``da_segnalare`` is what an exit code would say."""
    of = lambda x: F.count_if(F.col("esito") == x)
    rows = pages.with_metadata(site_pages(spark, sf_dir))
    return rows.agg(F.concat(F.count(F.lit(1)), F.lit(" pagine: "), of("iniettato"), F.lit(" iniettate, "), of("skip"), F.lit(" saltate")).alias("riga"), (of("skip") > 0).alias("da_segnalare"))


_OLD, _NEW, _MARK = '<a class="home" href="/">Home</a>', '<a class="home" href="/"><img class="logo" src="/logo.png"></a>', 'class="logo"'


def _topbars(spark, sf_dir):
    """Pages with the old link, with the logo already, and with neither."""
    kind = F.length("html") % 3
    html = F.when(kind == 1, F.replace("html", F.lit(_OLD), F.lit(_NEW))).when(kind == 2, F.replace("html", F.lit(_OLD), F.lit(""))).otherwise(F.col("html"))
    return site_pages(spark, sf_dir).withColumn("html", html)


_LOGO = f"WITH {PAGES_SQL}, l AS (SELECT *, length(html) % 3 AS kind FROM pages)"


@register("x12_logo_link", f"{_LOGO} SELECT {_IDS}, CASE kind WHEN 0 THEN true WHEN 1 THEN false END AS fatto, CASE WHEN kind < 2 THEN replace(html, '{_OLD}', '{_NEW}') ELSE replace(html, '{_OLD}', '') END AS nuovo FROM l")
def x12_logo(spark, sf_dir):
    return pages.with_logo(_topbars(spark, sf_dir), _OLD, _NEW, _MARK).select(*_ID, "fatto", "nuovo")


@register("a2_three_way_count", f"{_LOGO} SELECT count(*) FILTER (WHERE kind = 0) AS fatti, count(*) FILTER (WHERE kind = 1) AS gia_fatti, count(*) FILTER (WHERE kind = 2) AS senza FROM l")
def a2(spark, sf_dir):
    done = F.col("fatto")
    rows = pages.with_logo(_topbars(spark, sf_dir), _OLD, _NEW, _MARK)
    return rows.agg(F.count_if(done).alias("fatti"), F.count_if(~done).alias("gia_fatti"), F.count_if(done.isNull()).alias("senza"))


#: Invented tokens: three that are mapped, one that is forbidden and not mapped.
_TOKENS = [("#FFD701", "#1199EE"), ("rgba(255, 215, 1", "rgba(17, 153, 238"), ("#1a6b5e", "#0D47A2")]
_FORBIDDEN = ["#ffd701", "rgba(255, 215, 1", "#1A6B5E", "#abc123"]

_STYLES_SQL = """st AS (SELECT bundle || '/' || act || '/assets/style.css' AS path, '.a { color: ' || CASE length(label) % 5 WHEN 0 THEN '#ffd701' WHEN 1 THEN 'RGBA(255, 215, 1, .5)' WHEN 2 THEN '#1A6B5E' WHEN 3 THEN '#ABC123' ELSE '#000' END || '; }' || CASE WHEN external THEN E'\n/* b */x/* e */\n' ELSE E'\n\n' END AS css FROM atti),
rt AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(css, '#FFD701', '#1199EE', 'gi'), 'rgba\\(255, 215, 1', 'rgba(17, 153, 238', 'gi'), '#1a6b5e', '#0D47A2', 'gi') AS nuovo FROM st)"""


def _styles(spark, sf_dir):
    k = F.length("label") % 5
    color = F.when(k == 0, "#ffd701").when(k == 1, "RGBA(255, 215, 1, .5)").when(k == 2, "#1A6B5E").when(k == 3, "#ABC123").otherwise("#000")
    css = F.concat(F.lit(".a { color: "), color, F.lit("; }"), F.when(F.col("external"), "\n/* b */x/* e */\n").otherwise("\n\n"))
    return table(spark, sf_dir, "atti").select(F.concat_ws("/", "bundle", "act", F.lit("assets/style.css")).alias("path"), css.alias("css"), "external")


@register("x13_styles_retoned", f"WITH {_STYLES_SQL} SELECT path, nuovo FROM rt")
def x13_styles(spark, sf_dir):
    return pages.retoned(_styles(spark, sf_dir), _TOKENS).select("path", "nuovo")


@register("a4_styles_changed", f"WITH {_STYLES_SQL} SELECT count(*) FILTER (WHERE nuovo <> css) AS n FROM rt")
def a4(spark, sf_dir):
    rows = pages.retoned(_styles(spark, sf_dir), _TOKENS)
    return rows.agg(F.count_if(~F.col("nuovo").eqNullSafe(F.col("css"))).alias("n"))


@register("j9_residues", f"WITH {_STYLES_SQL} SELECT path, t AS token FROM rt, (VALUES ('#ffd701'), ('rgba(255, 215, 1'), ('#1A6B5E'), ('#abc123')) f(t) WHERE contains(lower(nuovo), lower(t))")
def j9(spark, sf_dir):
    forbidden = spark.createDataFrame([(t,) for t in _FORBIDDEN], "token string")
    return pages.residues(pages.retoned(_styles(spark, sf_dir), _TOKENS), forbidden)


@register("x11_style_rule", f"WITH {_STYLES_SQL} SELECT path, regexp_replace(replace(css, '/* b */x/* e */' || chr(10), ''), '\\n+$', '') || chr(10) || '/* b */.logo {{ }}/* e */' || chr(10) AS nuovo FROM st")
def x11_rule(spark, sf_dir):
    return pages.with_rule(_styles(spark, sf_dir), ".logo { }", "/* b */", "/* e */").select("path", "nuovo")


@register("a3_styles_patched", f"WITH {_STYLES_SQL} SELECT count(*)::BIGINT AS n FROM st")
def a3(spark, sf_dir):
    rows = pages.with_rule(_styles(spark, sf_dir), ".logo { }", "/* b */", "/* e */")
    return rows.agg(F.sum(F.when(F.col("nuovo") != F.col("css"), 1).otherwise(0)).alias("n"))


_BUMP_SQL = f"WITH {PAGES_SQL}, {_STYLES_SQL.split('rt AS')[0].rstrip().rstrip(',')}, b AS (SELECT {_IDS}, html, regexp_replace(html, '(href=\"assets/style\\.css)(\\?v=[0-9a-f]+)?(\")', '\\1?v=' || substr(md5(css), 1, 8) || '\\3', 'g') AS nuovo FROM pages JOIN st ON path = 'principale/' || act || '/assets/style.css')"


def _bumped(spark, sf_dir):
    rows = site_pages(spark, sf_dir).withColumn("path", F.concat(F.lit("principale/"), "act", F.lit("/"), "art", F.lit(".html")))
    return pages.versions_bumped(rows, _styles(spark, sf_dir))


@register("j8_sibling_style", f"{_BUMP_SQL} SELECT {_IDS}, nuovo FROM b")
def j8(spark, sf_dir):
    return _bumped(spark, sf_dir).select(*_ID, "nuovo")


@register("a5_versions_bumped", f"{_BUMP_SQL} SELECT count(*) FILTER (WHERE nuovo <> html) AS n FROM b")
def a5(spark, sf_dir):
    return _bumped(spark, sf_dir).agg(F.count_if(F.col("nuovo") != F.col("html")).alias("n"))


_LISTED = ["principale.css", "manca.css", "esterni.css", "scheda.css"]


@register("a9_files_digest", "SELECT substr(md5(string_agg(c, '' ORDER BY o)), 1, 8) AS versione FROM (SELECT CASE bundle WHEN 'principale' THEN 0 ELSE 2 END AS o, string_agg(act, '|' ORDER BY act) AS c FROM atti WHERE bundle IN ('principale', 'esterni') GROUP BY bundle)")
def a9(spark, sf_dir):
    acts = table(spark, sf_dir, "atti").where("bundle IS NOT NULL").groupBy("bundle").agg(F.array_join(F.sort_array(F.collect_list("act")), "|").alias("content"))
    return pages.files_digest(acts.select(F.concat("bundle", F.lit(".css")).alias("path"), "content"), _LISTED)


@register("f2_excluded_paths", _q("rel", "WHERE rel NOT IN ('index.html', 'audit.html')", "pages"))
def f2(spark, sf_dir):
    return site_pages(spark, sf_dir).where(~F.col("rel").isin(*SITE.noindex)).select(*_ID, "rel")


@register("j10_excluded_by_table", _q("rel", "WHERE rel NOT IN (SELECT file FROM atti WHERE file IS NOT NULL) AND rel IS NOT NULL", "pages"))
def j10(spark, sf_dir):
    """The pages that are no act's main page: an anti join."""
    files = table(spark, sf_dir, "atti").select(F.col("file").alias("rel"))
    return site_pages(spark, sf_dir).where("rel IS NOT NULL").join(files, "rel", "left_anti").select(*_ID, "rel")


@register("f3_path_parts", "SELECT act, bundle || '/' || CASE WHEN external THEN 'assets/' ELSE '' END || file AS percorso FROM atti WHERE NOT external AND file IS NOT NULL AND bundle IS NOT NULL")
def f3(spark, sf_dir):
    path = F.concat("bundle", F.lit("/"), F.when(F.col("external"), "assets/").otherwise(""), "file")
    rows = table(spark, sf_dir, "atti").select("act", path.alias("percorso"))
    return rows.where(~paths.has_part(F.col("percorso"), "assets"))


@register("f4_page_suffix", "SELECT act, ends_with(file, '.html') AS pagina FROM atti")
def f4(spark, sf_dir):
    return table(spark, sf_dir, "atti").select("act", paths.is_page(F.col("file")).alias("pagina"))


@register("o3_path_order", "SELECT act, CAST(row_number() OVER (ORDER BY replace(bundle || '/' || file, '/', chr(1)), act) AS INTEGER) AS posto FROM atti")
def o3(spark, sf_dir):
    """Paths in order of their parts: the separator is lower than any character of a name."""
    path = F.translate(F.concat("bundle", F.lit("/"), "file"), "/", "\x01")
    return in_order(table(spark, sf_dir, "atti").select("act", path.alias("k")), ["k", "act"]).select("act", "posto")
