"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import markdown, paths, text, values
from cartulary.plans.registry import Registry
from cartulary.session import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

_MONTHS = "[" + ", ".join(f"'{m}'" for m in values.MONTHS) + "]"
DATE_SQL = f"coalesce(day(date) || ' ' || {_MONTHS}[month(date)] || ' ' || year(date), '')"
#: White space as the oracle's dialect needs it spelled out.
BLANK_SQL = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}]"


def xml_sql(x: str, apostrophe: str = "&apos;") -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '{apostrophe}')"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "giurisprudenza")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register("x1_date_label", f"SELECT scheda_id, {DATE_SQL} AS data FROM giurisprudenza")
def x1(spark, sf_dir):
    return _cards(spark, sf_dir).select("scheda_id", values.date_label(F.col("date")).alias("data"))


@register("x2_iso_day", "SELECT scheda_id, strftime(caricata_il, '%Y-%m-%d') AS giorno FROM giurisprudenza")
def x2(spark, sf_dir):
    return _cards(spark, sf_dir).select("scheda_id", values.iso_day(F.col("caricata_il")).alias("giorno"))


@register("x3_card_day", "SELECT scheda_id, strftime(date, '%Y-%m-%d') AS giorno FROM circolari")
def x3(spark, sf_dir):
    return table(spark, sf_dir, "circolari").select("scheda_id", values.iso_day(F.col("date")).alias("giorno"))


@register("x4_this_year", "SELECT formato_id, year(current_date)::INTEGER - year(current_date)::INTEGER AS scarto FROM formati")
def x4(spark, sf_dir):
    """The year itself changes; what is compared is its distance from the clock's."""
    return table(spark, sf_dir, "formati").select("formato_id", (values.current_year() - F.year(F.current_timestamp())).alias("scarto"))


@register("x5_markdown")
def x5(spark, sf_dir):
    return _cards(spark, sf_dir).select("scheda_id", markdown.rendered(F.col("body")).alias("html"))


@register("x6_xml_escape", f"SELECT doc_id, {xml_sql('text')} AS xml FROM documents")
def x6(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.xml_escape(F.col("text")).alias("xml"))


@register("x7_attribute_escape", f"SELECT doc_id, {xml_sql('text', '&#x27;')} AS attributo FROM documents")
def x7(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.attribute_escape(F.col("text")).alias("attributo"))


_PARAGRAPH = "<p[^>]*>(.*?)</p>"


@register("x8_first_match", f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_PARAGRAPH}', 'is') THEN regexp_extract(text, '{_PARAGRAPH}', 1, 'is') END AS primo FROM documents")
def x8(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.first_match(F.col("text"), f"(?is){_PARAGRAPH}").alias("primo"))


@register("x9_white_space", f"SELECT doc_id, trim(regexp_replace(text, '{BLANK_SQL}+', ' ', 'g')) AS testo FROM documents")
def x9(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.collapsed(F.col("text")).alias("testo"))


_MARKED = "'<a>' || coalesce(massima, '') || '<!-- b -->uno<!-- e -->\n' || coalesce(body, '') || '<!-- b -->due<!-- e -->fine'"


def _marked(spark, sf_dir):
    x = F.concat(F.lit("<a>"), F.coalesce("massima", F.lit("")), F.lit("<!-- b -->uno<!-- e -->\n"), F.coalesce("body", F.lit("")), F.lit("<!-- b -->due<!-- e -->fine"))
    return _cards(spark, sf_dir).select("scheda_id", x.alias("x"), F.concat(F.lit("$1\\"), F.col("numero")).alias("nuovo"))


@register("x10_first_block", f"SELECT scheda_id, '<a>' || coalesce(massima, '') || '$1\\' || numero || coalesce(body, '') || '<!-- b -->due<!-- e -->fine' AS testo FROM giurisprudenza")
def x10(spark, sf_dir):
    return _marked(spark, sf_dir).select("scheda_id", text.first_block_replaced(F.col("x"), "<!-- b -->", "<!-- e -->", F.col("nuovo")).alias("testo"))


@register("x11_all_blocks", f"SELECT scheda_id, '<a>' || coalesce(massima, '') || '$1\\' || numero || coalesce(body, '') || '$1\\' || numero || 'fine' AS testo FROM giurisprudenza")
def x11(spark, sf_dir):
    return _marked(spark, sf_dir).select("scheda_id", text.blocks_replaced(F.col("x"), "<!-- b -->", "<!-- e -->", F.col("nuovo")).alias("testo"))


@register("x12_literal_replace", "SELECT scheda_id, replace(massima, 'un', '[un$1]') AS testo FROM giurisprudenza")
def x12(spark, sf_dir):
    return _cards(spark, sf_dir).select("scheda_id", text.replaced(F.col("massima"), [("un", "[un$1]")]).alias("testo"))


#: An invented map of tokens; the order matters, the second reads what the first wrote.
TOKENS = [("termine", "TERMINE$"), ("termine$", "scadenza"), ("giudice.", "giudice!"), ("UN ", "uno\\ ")]


@register("x13_token_map", "SELECT scheda_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(massima, 'termine', 'TERMINE$', 'gi'), 'termine\\$', 'scadenza', 'gi'), 'giudice\\.', 'giudice!', 'gi'), 'UN ', 'uno\\\\ ', 'gi') AS testo FROM giurisprudenza")
def x13(spark, sf_dir):
    return _cards(spark, sf_dir).select("scheda_id", text.tokens_replaced(F.col("massima"), TOKENS).alias("testo"))


@register("x14_insert_after", "SELECT scheda_id, CASE WHEN strpos(massima, '.') > 0 THEN substr(massima, 1, strpos(massima, '.')) || '[' || numero || ']' || substr(massima, strpos(massima, '.') + 1) ELSE massima END AS testo FROM giurisprudenza")
def x14(spark, sf_dir):
    addition = F.concat(F.lit("["), F.col("numero"), F.lit("]"))
    return _cards(spark, sf_dir).select("scheda_id", text.inserted_after(F.col("massima"), r"\.", addition).alias("testo"))


@register("x15_first_separator", "SELECT voce_id, trim(split_part(nome, '—', 1)) AS prima, CASE WHEN strpos(nome, '—') > 0 THEN trim(substr(nome, strpos(nome, '—') + 1)) ELSE '' END AS dopo FROM voci")
def x15(spark, sf_dir):
    nome = F.col("nome")
    return table(spark, sf_dir, "voci").select("voce_id", text.before_separator(nome, "—").alias("prima"), text.after_separator(nome, "—").alias("dopo"))


@register("x16_prefix_suffix", "SELECT act, starts_with(act, 'dlgs-') AS italiano, ends_with(file, '/index.html') AS cartella, CASE WHEN ends_with(file, '/index.html') THEN substr(file, 1, length(file) - 10) ELSE file END AS indirizzo FROM atti")
def x16(spark, sf_dir):
    file = F.col("file")
    inside = F.endswith(file, F.lit("/index.html"))
    return table(spark, sf_dir, "atti").select("act", F.startswith("act", F.lit("dlgs-")).alias("italiano"), inside.alias("cartella"), F.when(inside, F.substr(file, F.lit(1), F.length(file) - 10)).otherwise(file).alias("indirizzo"))


@register("x17_digest", "SELECT doc_id, substr(md5(text), 1, 8) AS impronta FROM documents")
def x17(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", values.digest(F.col("text")).alias("impronta"))


@register("x18_versioned_href", "SELECT act, '<link href=\"assets/style.css?v=' || substr(md5(label), 1, 8) || '\"><a href=\"altro.css\">' AS riga FROM atti")
def x18(spark, sf_dir):
    old = F.when(F.col("external"), '<link href="assets/style.css?v=0a1b"><a href="altro.css">').otherwise('<link href="assets/style.css"><a href="altro.css">')
    return table(spark, sf_dir, "atti").select("act", values.versioned(old, "assets/style.css", values.digest(F.col("label"))).alias("riga"))


@register("x19_leading_int", "SELECT act, art, caricato_il, TRY_CAST(nullif(regexp_extract(art, '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER) AS numero FROM articoli")
def x19(spark, sf_dir):
    return table(spark, sf_dir, "articoli").select("act", "art", "caricato_il", values.leading_int(F.col("art")).alias("numero"))


@register("x20_file_name", "SELECT act, coalesce(nullif(regexp_extract(replace(file, 'index.html', ''), '([^/]*)$', 1), ''), 'index.html') AS pagina FROM atti")
def x20(spark, sf_dir):
    return table(spark, sf_dir, "atti").select("act", paths.file_name(F.replace("file", F.lit("index.html"), F.lit(""))).alias("pagina"))


@register("x21_truncate", "SELECT doc_id, CASE WHEN length(text) > 180 THEN substr(text, 1, 177) || '...' ELSE text END AS inizio FROM documents")
def x21(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.truncated(F.col("text"), 180).alias("inizio"))


@register("x22_strip_html", "SELECT doc_id, regexp_replace(text, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<.*?>', '', 'gs') AS testo FROM documents")
def x22(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.without_html(F.col("text")).alias("testo"))


@register("x23_json_string", "SELECT scheda_id, to_json(massima)::VARCHAR AS json FROM giurisprudenza WHERE massima IS NOT NULL")
def x23(spark, sf_dir):
    return _cards(spark, sf_dir).where("massima IS NOT NULL").select("scheda_id", text.json_string(F.col("massima")).alias("json"))


@register("x24_prefixed_url", "SELECT scheda_id, CASE WHEN starts_with(pdf, '/') AND NOT starts_with(pdf, '//') THEN '/sito' || pdf ELSE pdf END AS indirizzo FROM circolari")
def x24(spark, sf_dir):
    return table(spark, sf_dir, "circolari").select("scheda_id", paths.prefixed(F.col("pdf"), "/sito").alias("indirizzo"))


@register("x25_default", "SELECT scheda_id, coalesce(nullif(pdflabel, ''), 'senza titolo') AS etichetta FROM circolari")
def x25(spark, sf_dir):
    return table(spark, sf_dir, "circolari").select("scheda_id", text.default(F.col("pdflabel"), F.lit("senza titolo")).alias("etichetta"))


@register("x26_href_parts", "SELECT scheda_id, posizione, split_part(href, '#', 1) AS pagina, CASE WHEN strpos(href, '#') > 0 THEN substr(href, strpos(href, '#') + 1) ELSE '' END AS ancora FROM (SELECT scheda_id, unnest(norme).href AS href, (generate_subscripts(norme, 1) - 1)::INTEGER AS posizione FROM giurisprudenza) WHERE href IS NOT NULL")
def x26(spark, sf_dir):
    links = _cards(spark, sf_dir).select("scheda_id", F.posexplode("norme.href").alias("posizione", "href")).where("href IS NOT NULL")
    return links.select("scheda_id", "posizione", paths.page_of(F.col("href")).alias("pagina"), paths.anchor_of(F.col("href")).alias("ancora"))


@register("x27_relative_path", "SELECT act, bundle || '/' || file AS percorso FROM atti")
def x27(spark, sf_dir):
    full = F.concat(F.lit("/radice/testi\\"), F.col("bundle"), F.lit("\\"), F.col("file"))
    return table(spark, sf_dir, "atti").select("act", paths.relative(full, F.lit("/radice/testi")).alias("percorso"))


_LANGUAGES = "|".join(paths.LANGUAGES)


@register("x28_language_prefix", f"SELECT doc_id, coalesce(nullif(regexp_extract('/' || coalesce(lower(lang), '') || '/p.html', '^/({_LANGUAGES})(?:/|$)', 1), ''), 'it') AS lingua FROM documents")
def x28(spark, sf_dir):
    path = F.concat(F.lit("/"), F.coalesce(F.lower("lang"), F.lit("")), F.lit("/p.html"))
    return _docs(spark, sf_dir).select("doc_id", paths.language(path).alias("lingua"))


@register("x29_clamp", "SELECT event_id, least(greatest(value, 10.0), 20.0)::DOUBLE AS valore FROM events")
def x29(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.clamped(F.col("value"), F.lit(10.0), F.lit(20.0)).alias("valore"))


@register("x30_round_half_up", "SELECT event_id, floor(10.5 - value + 0.5::DOUBLE)::BIGINT AS intero, floor(-(event_id % 7) / 2.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS meta FROM events")
def x30(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.half_up(F.lit(10.5) - F.col("value")).alias("intero"), values.half_up(-(F.col("event_id") % 7) / F.lit(2.0)).alias("meta"))


@register("x31_json_parse", "SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END, '$.k') AS INTEGER) AS k FROM events")
def x31(spark, sf_dir):
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", values.parsed(broken, "k int")["k"].alias("k"))


@register("x32_arrays", "SELECT scheda_id, CAST(len(temi) AS INTEGER) AS quanti, array_to_string(list_transform(list_append(temi, 'fine'), lambda x: upper(x)), '|') AS tutti, array_to_string(temi[1:2], '|') AS primi, temi[-1] AS ultimo FROM giurisprudenza WHERE temi IS NOT NULL")
def x32(spark, sf_dir):
    temi = F.col("temi")
    cards = _cards(spark, sf_dir).where(temi.isNotNull())
    all_ = F.array_join(F.transform(F.array_append(temi, F.lit("fine")), F.upper), "|")
    return cards.select("scheda_id", F.size(temi).alias("quanti"), all_.alias("tutti"), F.array_join(F.slice(temi, 1, 2), "|").alias("primi"), F.try_element_at(temi, F.lit(-1)).alias("ultimo"))


@register("x33_maps", "SELECT act, CAST(count(*) AS INTEGER) AS articoli, max(CASE WHEN art = '1' THEN heading END) AS primo, CAST(count(*) FILTER (WHERE art <> '1') AS INTEGER) AS altri FROM (SELECT DISTINCT ON (act, art) act, art, heading FROM articoli WHERE act IS NOT NULL AND art IS NOT NULL ORDER BY act, art, caricato_il, heading) GROUP BY act")
def x33(spark, sf_dir):
    """A map of headings an act: set (the first loaded stays), get, delete, size."""
    first = table(spark, sf_dir, "articoli").where("act IS NOT NULL AND art IS NOT NULL").groupBy("act", "art").agg(F.min_by("heading", F.struct("caricato_il", "heading")).alias("heading"))
    acts = first.groupBy("act").agg(F.map_from_entries(F.collect_list(F.struct("art", "heading"))).alias("m"))
    return acts.select("act", F.size("m").alias("articoli"), F.try_element_at("m", F.lit("1")).alias("primo"), F.size(F.map_filter("m", lambda k, _: k != "1")).alias("altri"))


_LINK_SQL = "'<a class=\"xref' || CASE WHEN external THEN ' ext' ELSE '' END || '\" data-act=\"' || act || '\" href=\"' || file || '\">'"


def link_tag():
    return F.concat(F.lit('<a class="xref'), F.when(F.col("external"), " ext").otherwise(""), F.lit('" data-act="'), F.col("act"), F.lit('" href="'), F.col("file"), F.lit('">'))


@register("x34_attributes", "SELECT act AS atto, file AS href, CAST(NULL AS VARCHAR) AS par, external IS NOT DISTINCT FROM true AS esterno FROM atti")
def x34(spark, sf_dir):
    tags = table(spark, sf_dir, "atti").select(link_tag().alias("t"))
    t = F.col("t")
    return tags.select(text.attribute(t, "data-act").alias("atto"), text.attribute(t, "href").alias("href"), text.attribute(t, "data-par").alias("par"), text.has_class(t, "ext").alias("esterno"))


@register("l2_digest_prefix", "SELECT act, substr(md5(coalesce(file, '')), 1, 8) AS versione FROM atti")
def l2(spark, sf_dir):
    return table(spark, sf_dir, "atti").select("act", values.digest(F.coalesce("file", F.lit(""))).alias("versione"))


@register("l3_short_text", "SELECT scheda_id, CASE WHEN length(massima) > 158 THEN substr(massima, 1, 155) || '...' ELSE massima END AS breve FROM giurisprudenza")
def l3(spark, sf_dir):
    return _cards(spark, sf_dir).select("scheda_id", text.truncated(F.col("massima"), 158).alias("breve"))


@register("d1_registered_filters", f"SELECT scheda_id, {DATE_SQL} AS data FROM circolari")
def d1(spark, sf_dir):
    """The date label as a function of the SQL session."""
    months = ", ".join(f"'{m}'" for m in values.MONTHS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION data_it(d DATE) RETURNS STRING RETURN coalesce(concat(day(d), ' ', element_at(array({months}), month(d)), ' ', year(d)), '')")
    table(spark, sf_dir, "circolari").createOrReplaceTempView("circolari_d1")
    return spark.sql("SELECT scheda_id, data_it(date) AS data FROM circolari_d1")


@register("d3_computed_columns", "SELECT scheda_id, 'circolari/' || scheda_id || '.html' AS permalink, coalesce(nullif(tipo, ''), 'Circolare') AS genere, len(coalesce(allegati, [])) > 0 AS con_allegati FROM circolari")
def d3(spark, sf_dir):
    computed = {"permalink": F.concat(F.lit("circolari/"), F.col("scheda_id"), F.lit(".html")), "genere": text.default(F.col("tipo"), F.lit("Circolare")), "con_allegati": F.coalesce(F.size("allegati") > 0, F.lit(False))}
    return table(spark, sf_dir, "circolari").withColumns(computed).select("scheda_id", *computed)
