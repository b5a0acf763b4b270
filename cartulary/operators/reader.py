"""Resolving references into the texts: acts, articles, fragments, recitals, labels.

Fragments are gathered once an article into an ordered array; a link then needs one join and
no window, whatever the number of links to an article. Links to very frequent articles are
spread over sub-keys (``merge_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.links import link_key
from cartulary.functions.values import leading_int
from cartulary.operators.orphans import hot_keys, merge_join
from cartulary.session import materialize, spread

#: The classes of the reader's markup.
HEAD, ACT, VERSION, LABEL, HEADING, BODY, FOUND = "tip-head", "t-act", "t-ver", "t-label", "t-heading", "tip-body", "hl-par"

#: What the reader shows for a recital, for an act as a whole, for a page without a name.
RECITAL, OUTSIDE, OPENS, WHOLE, PREVIOUS = "Considerando (", "Atto esterno — ", ". Clic per aprire.", "Clic per aprire il testo completo.", "pagina precedente"


def _in(tag: str, kind: str, x: Column) -> Column:
    return F.concat(F.lit(f'<{tag} class="{kind}">'), x, F.lit(f"</{tag}>"))


def card_links(cards: DataFrame, parents: DataFrame) -> DataFrame:
    """scheda_id, posizione, act, art, par of the references in ``norme``; par is what the
    label names as paragraph, as text. ``parents``: chiave, act, art."""
    par = F.regexp_extract(F.col("n.label"), r"co\. ?([0-9]+(?:-[a-z]+)?)", 1)
    rows = spread(cards.select("scheda_id", "norme")).select("scheda_id", F.posexplode("norme").alias("posizione", "n")).select("scheda_id", "posizione", F.nullif(par, F.lit("")).alias("par"), link_key(F.col("n.href")).alias("chiave"))
    return rows.where("chiave IS NOT NULL").join(parents.select("chiave", "act", "art"), "chiave").drop("chiave")


def latest_articles(articles: DataFrame) -> DataFrame:
    """One row an article: of those loaded again the last."""
    order = F.struct(F.coalesce("caricato_il", F.lit("1900-01-01").cast("timestamp_ntz")), F.coalesce("label", F.lit("")), F.coalesce("heading", F.lit("")))
    row = F.max_by(F.struct("bundle", "label", "heading", "anchor", "n_frammenti"), order).alias("r")
    return articles.where("act IS NOT NULL AND art IS NOT NULL").groupBy("act", "art").agg(row).select("act", "art", "r.*")


def article_texts(fragments: DataFrame) -> DataFrame:
    """act, art, frags: the fragments in order (A6 reads them)."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "par", "html"))).alias("frags")
    return fragments.where("act IS NOT NULL AND art IS NOT NULL").groupBy("act", "art").agg(listed)


def ordered_text(frags: Column, separator: str = "") -> Column:
    """The fragments one after another; null html counts as empty."""
    return F.array_join(F.transform(frags, lambda f: F.coalesce(f["html"], F.lit(""))), separator)


def paragraph_text(frags: Column, par: Column, full: bool) -> Column:
    """With a paragraph, only its fragments, marked, or (``full``) all with those
    marked; all unmarked where none has its number or none is asked for."""
    hit = lambda f: F.coalesce(f["par"] == par, F.lit(False))
    marked = lambda f: _in("span", FOUND, F.coalesce(f["html"], F.lit("")))
    plain = lambda f: F.coalesce(f["html"], F.lit(""))
    if full:
        shown = F.transform(frags, lambda f: F.when(hit(f), marked(f)).otherwise(plain(f)))
    else:
        shown = F.transform(F.filter(frags, hit), marked)
    return F.when(F.exists(frags, hit), F.array_join(shown, "")).otherwise(ordered_text(frags))


def article_content(links: DataFrame, acts: DataFrame, articles: DataFrame, fragments: DataFrame, full: bool) -> DataFrame:
    """Head and body of the article each link leads to; links to an act or an
    article without a row give none. ``links`` needs act, art, par (text)."""
    known = acts.select("act", F.col("label").alias("act_label"), "external", "version")
    whole = latest_articles(articles).join(known, "act").join(article_texts(fragments), ["act", "art"], "left")
    version = F.when(F.col("external"), F.concat(F.lit(" "), _in("span", VERSION, F.coalesce("version", F.lit(""))))).otherwise("")
    heading = F.when(F.coalesce("heading", F.lit("")) != "", _in("div", HEADING, F.col("heading"))).otherwise("")
    head = _in("div", HEAD, F.concat(_in("span", ACT, F.coalesce("act_label", "act")), version, _in("div", LABEL, F.coalesce("label", F.lit(""))), heading))
    whole = whole.select(F.concat_ws("#", "act", "art").alias("k"), head.alias("head"), F.coalesce("frags", F.expr("array()")).alias("frags"), F.lit(True).alias("_there"))
    asked = links.where("act IS NOT NULL AND art IS NOT NULL").withColumn("k", F.concat_ws("#", "act", "art"))
    asked = materialize(asked, "rinvii")  # read twice: hot keys, join
    found = merge_join(asked, whole, "k", F.struct(*asked.columns), hot_keys(asked, "k")).where("_there")
    body = _in("div", BODY, paragraph_text(F.col("frags"), leading_int(F.col("par")), full))
    return found.withColumn("body", body).drop("k", "frags", "_there")


def recitals(fragments: DataFrame) -> DataFrame:
    """act, n, html of the unnumbered fragments, numbered by act in order of article and place."""
    listed = F.sort_array(F.collect_list(F.struct("art", "pos", "html")))
    acts = fragments.where("act IS NOT NULL AND par IS NULL").groupBy("act").agg(listed.alias("all"))
    return acts.select("act", F.posexplode("all").alias("i", "f")).select("act", (F.col("i") + 1).alias("n"), F.col("f.html").alias("html"))


def recital_content(links: DataFrame, acts: DataFrame, known: DataFrame) -> DataFrame:
    """Head and body of the recital (act, rct) of each link; none for a missing one."""
    head = _in("div", HEAD, F.concat(_in("span", ACT, F.coalesce("label", "act")), _in("div", LABEL, F.concat(F.lit(RECITAL), F.col("n"), F.lit(")")))))
    rows = links.join(known, (links["act"] == known["act"]) & (links["rct"] == known["n"])).drop(known["act"])
    return rows.join(acts.select("act", "label"), "act").select(*links.columns, head.alias("head"), _in("div", BODY, F.coalesce("html", F.lit(""))).alias("body"))


def act_note(external: Column, version: Column) -> Column:
    """What a link to a whole act shows."""
    return F.when(external, F.concat(F.lit(OUTSIDE), F.coalesce(version, F.lit("")), F.lit(OPENS))).otherwise(WHOLE)


def crumb_label(short: Column, act: Column, art: Column, rct: Column, par: Column) -> Column:
    """The short name, or the key of an unknown act, with recital or article."""
    name = F.coalesce(short, act)
    article = F.concat(name, F.lit(" · art. "), F.coalesce(art, F.lit("null")), F.coalesce(F.concat(F.lit(", par. "), par), F.lit("")))
    return F.when(rct.isNotNull(), F.concat(name, F.lit(" · cons. "), rct)).otherwise(article)


def page_label(short: Column, title: Column, fallback: str = PREVIOUS) -> Column:
    """P20: the act's short name, the title up to its dash, a fixed text."""
    return F.coalesce(short, F.nullif(F.trim(F.substring_index(title, "—", 1)), F.lit("")), F.lit(fallback))


def shown_link(is_xref: Column, is_external: Column, art: Column, rct: Column) -> Column:
    """whether a click on the link opens the panel."""
    return is_xref & ~is_external & (art.isNotNull() | rct.isNotNull())


def crumbs(labels: Column, separator: str = " → ") -> Column:
    """The labels joined, the last one bold."""
    last = F.size(labels) - 1
    return F.array_join(F.transform(labels, lambda x, i: F.when(i == last, F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(x)), separator)
