"""References resolved into the texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import paths, text
from cartulary.functions.links import link_key, link_key_sql
from cartulary.operators import reader
from cartulary.operators.orphans import act_parents
from cartulary.plans.registry import Registry
from cartulary.session import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

LINKS_SQL = f"""
parents AS (
  SELECT DISTINCT lower(file) || '#' AS k, act, NULL::VARCHAR AS art FROM atti WHERE file IS NOT NULL AND act IS NOT NULL
  UNION ALL
  SELECT lower(a.file) || '#' || lower(r.anchor), r.act, min(r.art) FROM articoli r JOIN (SELECT DISTINCT act, lower(file) AS file FROM atti WHERE file IS NOT NULL) a USING (act) WHERE r.anchor IS NOT NULL GROUP BY ALL),
lk AS (
  SELECT scheda_id, posizione, act, art, nullif(regexp_extract(label, 'co\\. ?([0-9]+(?:-[a-z]+)?)', 1), '') AS par
  FROM (SELECT scheda_id, posizione, n.label AS label, {link_key_sql('n.href')} AS k
        FROM (SELECT scheda_id, unnest(norme) AS n, (generate_subscripts(norme, 1) - 1)::INTEGER AS posizione FROM giurisprudenza)) JOIN parents USING (k)),
arts AS (
  SELECT DISTINCT ON (act, art) act, art, bundle, label, heading, anchor, n_frammenti FROM articoli WHERE act IS NOT NULL AND art IS NOT NULL
  ORDER BY act, art, coalesce(caricato_il, TIMESTAMP '1900-01-01') DESC, coalesce(label, '') DESC, coalesce(heading, '') DESC),
frs AS (SELECT act, art, pos, par, coalesce(html, '') AS html FROM frammenti WHERE act IS NOT NULL AND art IS NOT NULL)"""


def _links(spark, sf_dir):
    parents = act_parents(table(spark, sf_dir, "atti"), table(spark, sf_dir, "articoli"))
    return reader.card_links(table(spark, sf_dir, "giurisprudenza"), parents)


def _tables(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@register("j1_act_by_key", f"WITH {LINKS_SQL} SELECT scheda_id, posizione, a.label, a.short FROM lk JOIN atti a USING (act)")
def j1(spark, sf_dir):
    return _links(spark, sf_dir).join(table(spark, sf_dir, "atti").select("act", "label", "short"), "act").select("scheda_id", "posizione", "label", "short")


@register("j2_article_by_key", f"WITH {LINKS_SQL} SELECT scheda_id, posizione, arts.label, heading FROM lk JOIN arts USING (act, art)")
def j2(spark, sf_dir):
    articles = reader.latest_articles(table(spark, sf_dir, "articoli")).select("act", "art", "label", "heading")
    return _links(spark, sf_dir).join(articles, ["act", "art"]).select("scheda_id", "posizione", "label", "heading")


_BODY_SQL = "'<div class=\"tip-body\">' || CASE WHEN bool_or(coalesce(par = p, false)) THEN string_agg({shown}, '' ORDER BY pos, par, html) ELSE coalesce(string_agg(html, '' ORDER BY pos, par, html), '') END || '</div>'"
_MARK_SQL = "'<span class=\"hl-par\">' || html || '</span>'"
_JOINED_SQL = f"WITH {LINKS_SQL}, x AS (SELECT lk.scheda_id, posizione, TRY_CAST(nullif(regexp_extract(lk.par, '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER) AS p, pos, frs.par, html FROM lk JOIN arts USING (act, art) JOIN (SELECT DISTINCT act FROM atti) USING (act) LEFT JOIN frs USING (act, art))"


def _content(spark, sf_dir, full):
    return reader.article_content(_links(spark, sf_dir), *_tables(spark, sf_dir, "atti", "articoli", "frammenti"), full)


@register("j4_paragraph_or_all", f"{_JOINED_SQL} SELECT scheda_id, posizione, {_BODY_SQL.format(shown=f'CASE WHEN par = p THEN {_MARK_SQL} END')} AS body FROM x GROUP BY scheda_id, posizione, p")
def j4(spark, sf_dir):
    return _content(spark, sf_dir, False).select("scheda_id", "posizione", "body")


@register("f9_paragraph_marked", f"{_JOINED_SQL} SELECT scheda_id, posizione, {_BODY_SQL.format(shown=f'CASE WHEN par = p THEN {_MARK_SQL} ELSE html END')} AS body FROM x GROUP BY scheda_id, posizione, p")
def f9(spark, sf_dir):
    return _content(spark, sf_dir, True).select("scheda_id", "posizione", "body")


@register("prj16_article_head", f"""WITH {LINKS_SQL} SELECT scheda_id, posizione, '<div class="tip-head"><span class="t-act">' || coalesce(a.label, act) || '</span>' || CASE WHEN external THEN ' <span class="t-ver">' || coalesce(version, '') || '</span>' ELSE '' END || '<div class="t-label">' || coalesce(arts.label, '') || '</div>' || CASE WHEN coalesce(heading, '') <> '' THEN '<div class="t-heading">' || heading || '</div>' ELSE '' END || '</div>' AS head FROM lk JOIN arts USING (act, art) JOIN atti a USING (act)""")
def prj16(spark, sf_dir):
    return _content(spark, sf_dir, False).select("scheda_id", "posizione", "head")


@register("a6_ordered_concat", "SELECT act, art, string_agg(coalesce(html, ''), '' ORDER BY pos, par, html) AS testo FROM frammenti WHERE act IS NOT NULL AND art IS NOT NULL GROUP BY ALL")
def a6(spark, sf_dir):
    return reader.article_texts(table(spark, sf_dir, "frammenti")).select("act", "art", reader.ordered_text(F.col("frags")).alias("testo"))


_RECITALS_SQL = "rec AS (SELECT act, CAST(row_number() OVER (PARTITION BY act ORDER BY art, pos, html) AS INTEGER) AS n, html FROM frammenti WHERE act IS NOT NULL AND par IS NULL)"
_RCT_SQL = f"WITH {LINKS_SQL}, {_RECITALS_SQL}, rl AS (SELECT scheda_id, posizione, act, TRY_CAST(regexp_extract(art, '^([0-9]+)', 1) AS INTEGER) AS rct FROM lk)"


def _recital_links(spark, sf_dir):
    """Links read as links to the recital of the article's number."""
    return _links(spark, sf_dir).select("scheda_id", "posizione", "act", F.regexp_extract("art", "^([0-9]+)", 1).try_cast("int").alias("rct"))


@register("j3_recital_by_key", f"{_RCT_SQL} SELECT scheda_id, posizione, rct, html FROM rl JOIN rec ON rl.act = rec.act AND rct = n")
def j3(spark, sf_dir):
    rec = reader.recitals(table(spark, sf_dir, "frammenti")).withColumnRenamed("n", "rct")
    return _recital_links(spark, sf_dir).join(rec, ["act", "rct"]).select("scheda_id", "posizione", "rct", "html")


@register("prj17_recital", f"""{_RCT_SQL} SELECT scheda_id, posizione, '<div class="tip-head"><span class="t-act">' || coalesce(a.label, a.act) || '</span><div class="t-label">Considerando (' || n || ')</div></div>' AS head, '<div class="tip-body">' || coalesce(html, '') || '</div>' AS body FROM rl JOIN rec ON rl.act = rec.act AND rct = n JOIN atti a ON a.act = rl.act""")
def prj17(spark, sf_dir):
    rec = reader.recitals(table(spark, sf_dir, "frammenti"))
    return reader.recital_content(_recital_links(spark, sf_dir), table(spark, sf_dir, "atti"), rec).select("scheda_id", "posizione", "head", "body")


@register("prj18_act_note", "SELECT act, CASE WHEN external THEN 'Atto esterno — ' || coalesce(version, '') || '. Clic per aprire.' ELSE 'Clic per aprire il testo completo.' END AS nota FROM atti")
def prj18(spark, sf_dir):
    return table(spark, sf_dir, "atti").select("act", reader.act_note(F.col("external"), F.col("version")).alias("nota"))


@register("j5_label_or_key", "SELECT r.bundle, r.act, art, r.caricato_il, coalesce(a.short, r.act) AS nome FROM articoli r LEFT JOIN atti a USING (act)")
def j5(spark, sf_dir):
    acts = table(spark, sf_dir, "atti").select("act", "short")
    return table(spark, sf_dir, "articoli").join(acts, "act", "left").select("bundle", "act", "art", "caricato_il", F.coalesce("short", "act").alias("nome"))


@register("prj19_crumb_label", f"WITH {LINKS_SQL} SELECT scheda_id, posizione, CASE WHEN posizione % 2 = 1 AND par IS NOT NULL THEN coalesce(short, act) || ' · cons. ' || par ELSE coalesce(short, act) || ' · art. ' || coalesce(art, 'null') || coalesce(', par. ' || par, '') END AS etichetta FROM lk LEFT JOIN atti USING (act)")
def prj19(spark, sf_dir):
    """Every other link is read as one to a recital."""
    links = _links(spark, sf_dir).join(table(spark, sf_dir, "atti").select("act", "short"), "act", "left")
    rct = F.when(F.col("posizione") % 2 == 1, F.col("par"))
    return links.select("scheda_id", "posizione", reader.crumb_label(F.col("short"), F.col("act"), F.col("art"), rct, F.col("par")).alias("etichetta"))


@register("prj20_page_label", "SELECT r.bundle, r.act, art, r.caricato_il, coalesce(a.short, nullif(trim(split_part(r.heading || ' — ' || r.label, '—', 1)), ''), 'pagina precedente') AS etichetta FROM articoli r LEFT JOIN atti a USING (act)")
def prj20(spark, sf_dir):
    acts = table(spark, sf_dir, "atti").select("act", "short")
    rows = table(spark, sf_dir, "articoli").join(acts, "act", "left")
    return rows.select("bundle", "act", "art", "caricato_il", reader.page_label(F.col("short"), F.concat("heading", F.lit(" — "), "label")).alias("etichetta"))


@register("j7_toc_entry", f"WITH {LINKS_SQL} SELECT scheda_id, posizione, arts.anchor, arts.label AS voce FROM lk JOIN arts ON arts.act = lk.act AND arts.anchor = 'art_' || lk.art")
def j7(spark, sf_dir):
    """The entry of the table of contents of the element in view."""
    toc = reader.latest_articles(table(spark, sf_dir, "articoli")).select("act", "anchor", F.col("label").alias("voce"))
    return _links(spark, sf_dir).withColumn("anchor", F.concat(F.lit("art_"), "art")).join(toc, ["act", "anchor"]).select("scheda_id", "posizione", "anchor", "voce")


@register("j11_card_norms", f"WITH {LINKS_SQL}, e AS (SELECT scheda_id, unnest(norme) AS n, (generate_subscripts(norme, 1) - 1)::INTEGER AS posizione FROM giurisprudenza) SELECT e.scheda_id, e.posizione, n.label AS label, split_part(n.href, '#', 1) AS pagina, lk.act FROM e LEFT JOIN lk USING (scheda_id, posizione)")
def j11(spark, sf_dir):
    """Every entry of norme as an edge; act is null where no target exists."""
    parents = act_parents(*_tables(spark, sf_dir, "atti", "articoli")).select("chiave", "act")
    rows = table(spark, sf_dir, "giurisprudenza").select("scheda_id", F.posexplode("norme").alias("posizione", "n"))
    rows = rows.select("scheda_id", "posizione", "n.label", paths.page_of(F.col("n.href")).alias("pagina"), link_key(F.col("n.href")).alias("chiave"))
    return rows.join(parents, "chiave", "left").select("scheda_id", "posizione", "label", "pagina", "act")


@register("j12_official_link", "SELECT act, CASE WHEN external THEN eurlex END AS ufficiale FROM atti")
def j12(spark, sf_dir):
    return table(spark, sf_dir, "atti").select("act", F.when(F.col("external"), F.col("eurlex")).alias("ufficiale"))


@register("f10_lazy_acts", "SELECT act, regexp_matches(act, '^(reg|dir|dec)') AS differito FROM atti")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "atti").select("act", paths.lazily_loaded(F.col("act")).alias("differito"))


_TAGS = [("xref", "art"), ("xref ext", "art"), ("xref", "rct"), ("lawlink ext", None), ("xref", None)]


def _tag(kinds):
    """A link of the kind that the number of fragments picks, built for the article."""
    out = F.lit(None).cast("string")
    for i, (kind, what) in enumerate(kinds):
        tail = F.concat(F.lit(f' data-{what}="'), F.col("art"), F.lit('"')) if what else F.lit("")
        out = F.when(F.coalesce("n_frammenti", F.lit(0)) % len(kinds) == i, F.concat(F.lit(f'<a class="{kind}" data-act="'), F.col("act"), F.lit('"'), tail, F.lit(">"))).otherwise(out)
    return out


@register("f14_panel_links", "SELECT act, art, caricato_il, coalesce(n_frammenti, 0) % 5 IN (0, 2) AS apre FROM articoli")
def f14(spark, sf_dir):
    rows = table(spark, sf_dir, "articoli").select("act", "art", "caricato_il", _tag(_TAGS).alias("t"))
    t = F.col("t")
    return rows.select("act", "art", "caricato_il", reader.shown_link(text.has_class(t, "xref"), text.has_class(t, "ext"), text.attribute(t, "data-art"), text.attribute(t, "data-rct")).alias("apre"))


@register("a8_crumb_trail", f"WITH {LINKS_SQL}, c AS (SELECT scheda_id, posizione, coalesce(short, act) || ' · art. ' || coalesce(art, 'null') || coalesce(', par. ' || par, '') AS e, lead(posizione) OVER (PARTITION BY scheda_id ORDER BY posizione) IS NULL AS ultimo FROM lk LEFT JOIN atti USING (act)) SELECT scheda_id, string_agg(CASE WHEN ultimo THEN '<b>' || e || '</b>' ELSE e END, ' → ' ORDER BY posizione) AS briciole FROM c GROUP BY scheda_id")
def a8(spark, sf_dir):
    """The links of a card as if followed one after another."""
    links = _links(spark, sf_dir).join(table(spark, sf_dir, "atti").select("act", "short"), "act", "left")
    label = reader.crumb_label(F.col("short"), F.col("act"), F.col("art"), F.lit(None).cast("string"), F.col("par"))
    trail = F.transform(F.sort_array(F.collect_list(F.struct("posizione", label.alias("e")))), lambda x: x["e"])
    return links.groupBy("scheda_id").agg(trail.alias("tutte")).select("scheda_id", reader.crumbs(F.col("tutte")).alias("briciole"))


@register("w1_is_last", f"WITH {LINKS_SQL} SELECT scheda_id, posizione, lead(posizione) OVER (PARTITION BY scheda_id ORDER BY posizione) IS NULL AS ultimo FROM lk")
def w1(spark, sf_dir):
    """A card's links are few: the window's partitions are bounded by a card's length."""
    w = Window.partitionBy("scheda_id").orderBy("posizione")
    return _links(spark, sf_dir).select("scheda_id", "posizione", F.lead("posizione").over(w).isNull().alias("ultimo"))


@register("w2_top_of_stack", f"WITH {LINKS_SQL} SELECT scheda_id, max(posizione) AS cima, list_sort(list(posizione))[-2] AS sotto FROM lk GROUP BY scheda_id")
def w2(spark, sf_dir):
    stack = F.sort_array(F.collect_list("posizione"))
    return _links(spark, sf_dir).groupBy("scheda_id").agg(F.max("posizione").alias("cima"), F.try_element_at(stack, F.lit(-2)).alias("sotto"))
