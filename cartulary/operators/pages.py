"""Metadata of pages and the rewriting of pages in place: block states, tokens, versions.

A rewrite is a projection with an outcome: what changes is written to a new place, since
files of a dataset are immutable; a second run changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import paths, text, values


@dataclass(frozen=True)
class Site:
    """What the texts of a site's pages need; every value is a parameter."""

    name: str = "Raccolta"
    base: str = "https://raccolta.example/"
    folder: str = "patto-interattivo/"
    image: str = "https://raccolta.example/immagini/anteprima.png"
    default_description: str = "Raccolta di testi, decisioni e circolari con collegamenti fra gli articoli."
    consolidated: str = "Testo coordinato di {nome} con le modifiche in evidenza{coda}."
    external: str = "Testo navigabile di {nome}, atto collegato."
    titled: str = "Testo navigabile di {resto} ({nome})."
    plain: str = "Testo navigabile di {nome}."
    begin: str = "<!-- meta:inizio -->"
    end: str = "<!-- meta:fine -->"
    noindex: tuple[str, ...] = ("index.html", "audit.html")


SITE = Site()

#: The outcomes of a rewrite.
OUTCOMES = ["iniettato", "aggiornato", "gia_ok", "noindex", "skip"]

#: What stands for a missing kind of circular and for a missing label of its file.
KIND, FILE_LABEL = "Circolare", "Scarica il documento (PDF)"

_TITLE = r"(?is)<title>(.*?)</title>"


def _filled(pattern: str, **columns: Column) -> Column:
    """A pattern with {names} as a concatenation."""
    parts: list[Column] = []
    rest = pattern
    while rest:
        hit = min(((rest.index("{" + n + "}"), n) for n in columns if "{" + n + "}" in rest), default=None)
        if hit is None:
            parts.append(F.lit(rest))
            break
        at, name = hit
        parts += [F.lit(rest[:at]), columns[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once: the optimizer does not put a generator's
    expressions into each place that reads them, nor below a filter."""
    one = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select("*", F.explode(F.array(one)).alias("_b")).select(*rows.columns, *(F.col(f"_b.{n}").alias(n) for n in columns))


def page_title(html: Column) -> Column:
    """The title with white space collapsed, null without one."""
    return text.collapsed(text.first_match(html, _TITLE))


def description(title: Column, rel: Column, site: Site = SITE) -> Column:
    """By class of page: consolidated, external, with and without a second part."""
    nome, resto = text.before_separator(title, "—"), text.after_separator(title, "—")
    coda = F.when(resto != "", F.concat(F.lit(" ("), resto, F.lit(")"))).otherwise("")
    return (
        F.when(F.startswith(rel, F.lit("dlgs-")), _filled(site.consolidated, nome=nome, coda=coda))
        .when(F.startswith(rel, F.lit("ext-")), _filled(site.external, nome=nome))
        .when(resto != "", _filled(site.titled, resto=resto, nome=nome))
        .otherwise(_filled(site.plain, nome=nome))
    )


def canonical(rel: Column, site: Site = SITE) -> Column:
    """An index page below the top stands for its folder."""
    base = F.lit(site.base + site.folder)
    inside = F.endswith(rel, F.lit("/index.html"))
    return F.concat(base, F.when(inside, F.substr(rel, F.lit(1), F.length(rel) - len("index.html"))).otherwise(rel))


def meta_block(title: Column, rel: Column, site: Site = SITE) -> Column:
    """Ten lines between the marks."""
    e = text.attribute_escape
    url, told = e(canonical(rel, site)), e(description(title, rel, site))
    of = lambda head, x: F.concat(F.lit(head), x, F.lit('">'))
    lines = [
        F.lit(site.begin),
        of('<link rel="canonical" href="', url),
        of('<meta name="description" content="', told),
        of('<meta property="og:title" content="', e(title)),
        of('<meta property="og:description" content="', told),
        of('<meta property="og:url" content="', url),
        F.lit('<meta property="og:type" content="article">'),
        F.lit(f'<meta property="og:site_name" content="{site.name}">'),
        F.lit(f'<meta property="og:image" content="{site.image}">'),
        F.lit(site.end),
    ]
    return F.concat_ws("\n", *lines)


def with_metadata(pages: DataFrame, site: Site = SITE) -> DataFrame:
    """``pages`` (rel, html, any others) with ``nuovo`` and ``esito`` of OUTCOMES.

    No title: skip. A page of ``site.noindex``: gia_ok with robots of its own, else noindex
    gets injected. A block between the marks: gia_ok where it is up to date, else aggiornato.
    A canonical or description of its own: gia_ok. All others: iniettato. Null html is skip
    and stays null. Running it on its own result changes nothing; the one exception is the
    line end that an update puts after the end mark."""
    html, rel = F.col("html"), F.col("rel")
    out = bound(bound(pages, _titolo=page_title(html)), _blocco=meta_block(F.col("_titolo"), rel, site))
    block = F.col("_blocco")
    robots = F.lit(f'\n{site.begin}\n<meta name="robots" content="noindex">\n{site.end}')
    fresh = text.first_block_replaced(html, site.begin, site.end, F.concat(block, F.lit("\n")))
    injected = text.inserted_after(html, _TITLE, F.concat(F.lit("\n"), block))
    case = (
        F.when(F.col("_titolo").isNull(), "skip")
        .when(rel.isin(*site.noindex), F.when(F.contains(html, F.lit('name="robots"')), "gia_ok").otherwise("noindex"))
        .when(F.contains(html, F.lit(site.begin)), "blocco")
        .when(F.contains(html, F.lit('rel="canonical"')) | F.contains(html, F.lit('name="description"')), "gia_ok")
        .otherwise("iniettato")
    )
    out, case = bound(out, _caso=case), F.col("_caso")
    new = F.when(case == "noindex", text.inserted_after(html, _TITLE, robots)).when(case == "blocco", fresh).when(case == "iniettato", injected).otherwise(html)
    out = bound(out, nuovo=new)
    state = F.when(case == "blocco", F.when(F.col("nuovo") == html, "gia_ok").otherwise("aggiornato")).otherwise(case)
    return out.withColumn("esito", state).drop("_titolo", "_blocco", "_caso")


def tally(outcomes: DataFrame, column: str, known: list[str] = OUTCOMES) -> DataFrame:
    """A1: column, n with a row for each of ``known``, zero where none occurred."""
    spark = outcomes.sparkSession
    names = spark.createDataFrame([(x,) for x in known], f"{column} string")
    counts = outcomes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def changed(rewritten: DataFrame, old: str = "html", new: str = "nuovo") -> DataFrame:
    """The rows whose text changed."""
    return rewritten.where(~F.col(new).eqNullSafe(F.col(old)))


def retoned(styles: DataFrame, tokens: list[tuple[str, str]]) -> DataFrame:
    """``styles`` (path, css) with ``nuovo``."""
    return bound(styles, nuovo=text.tokens_replaced(F.col("css"), tokens))


def residues(styles: DataFrame, forbidden: DataFrame, column: str = "nuovo") -> DataFrame:
    """Path, token of every forbidden token that a text still holds, letter case aside.

    ``forbidden`` (token) is a list written by hand: it is collected, at most 10,000 tokens
    are allowed, and every text is read once; no product of two tables is formed."""
    tokens = [r[0] for r in forbidden.select("token").where("token IS NOT NULL AND token <> ''").distinct().limit(10_001).collect()]
    if len(tokens) > 10_000:
        raise ValueError("more than 10,000 forbidden tokens: join them instead")
    if not tokens:
        return styles.select("path", F.lit(None).cast("string").alias("token")).where(F.lit(False))
    low = F.lower(F.col(column))
    held = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(low, F.lower(t)))
    return styles.select("path", F.explode(held).alias("token"))


def with_logo(pages: DataFrame, old: str, new: str, mark: str) -> DataFrame:
    """``nuovo`` and ``fatto``: false where the mark is there already, null where
    there is nothing to replace, true where it was replaced."""
    html = F.col("html")
    there = F.contains(html, F.lit(mark))
    done = F.when(there, F.lit(False)).when(F.contains(html, F.lit(old)), F.lit(True))
    return pages.withColumn("fatto", done).withColumn("nuovo", F.when(F.col("fatto"), F.replace(html, F.lit(old), F.lit(new))).otherwise(html))


def with_rule(styles: DataFrame, rule: str, begin: str, end: str) -> DataFrame:
    """``nuovo``: the marked rule replaced where there is one, else appended."""
    css = F.col("css")
    whole = f"{begin}{rule}{end}\n"
    appended = F.concat(F.regexp_replace(css, r"\n+\z", ""), F.lit("\n" + whole))
    new = F.when(F.contains(css, F.lit(begin)), text.blocks_replaced(css, begin, end, F.lit(whole))).otherwise(appended)
    return styles.withColumn("nuovo", new)


def versions_bumped(pages: DataFrame, styles: DataFrame, href: str = "assets/style.css") -> DataFrame:
    """``pages`` (path, html) whose folder holds the style sheet, with
    ``nuovo`` in which the link to it carries its digest. Pages without one are left out."""
    sheets = styles.where(F.endswith("path", F.lit("/" + href))).select(F.expr(f"substring(path, 1, length(path) - {len(href) + 1})").alias("_cartella"), values.digest(F.col("css")).alias("_versione"))
    out = pages.withColumn("_cartella", paths.folder(F.col("path"))).join(sheets, "_cartella")
    return out.withColumn("nuovo", values.versioned(F.col("html"), href, F.col("_versione"))).drop("_cartella", "_versione")


def files_digest(files: DataFrame, listed: list[str], length: int = 8) -> DataFrame:
    """One row, versione: the md5 over the contents of the listed files, in the
    list's order; files that are missing count as empty. ``files``: path, content."""
    spark = files.sparkSession
    order = spark.createDataFrame(list(enumerate(listed)), "ord int, path string")
    there = order.join(files.select("path", F.col("content").cast("binary").alias("content")), "path").where("content IS NOT NULL")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"])
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))
    return there.agg(F.substring(F.md5(joined), 1, length).alias("versione"))


def card_title(title: Column, corte: Column, ente: Column, day: Column, site: Site = SITE) -> Column:
    """Title, court and date, office and date, or the site's name; empty counts as none."""
    of = lambda who: F.concat(F.nullif(who, F.lit("")), F.lit(", "), values.date_label(day), F.lit(f" — {site.name}"))
    return F.coalesce(F.nullif(title, F.lit("")), of(corte), of(ente), F.lit(site.name))


def card_description(own: Column, massima: Column, oggetto: Column, n: int = 158, site: Site = SITE) -> Column:
    """P5."""
    cut = lambda x: F.nullif(text.truncated(text.without_html(x), n), F.lit(""))
    return F.coalesce(F.nullif(own, F.lit("")), cut(massima), cut(oggetto), F.lit(site.default_description))


def headline(who: Column, day: Column) -> Column:
    """Who and when; null counts as empty."""
    return F.concat(F.coalesce(who, F.lit("")), F.lit(", "), values.date_label(day))


def article_json(head: Column, day: Column, url: Column, archive: str, archive_url: str, site: Site = SITE) -> Column:
    """The structured data of a card: an article and its three breadcrumbs."""
    item = lambda n, name, at: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), name.alias("name"), at.alias("item"))
    crumbs = F.array(item(1, F.lit("Home"), F.lit(site.base)), item(2, F.lit(archive), F.lit(site.base + archive_url)), item(3, head, F.lit(None).cast("string")))
    article = F.struct(F.lit("Article").alias("@type"), head.alias("headline"), values.iso_day(day).alias("datePublished"), F.lit("it").alias("inLanguage"), F.concat(F.lit(site.base), url).alias("mainEntityOfPage"))
    trail = F.struct(F.lit("BreadcrumbList").alias("@type"), crumbs.alias("itemListElement"))
    return F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.to_json(article), F.lit(","), F.to_json(trail), F.lit("]}"))


def section(label: str, x: Column) -> Column:
    """A labelled section, nothing where its content is absent."""
    return F.when(x.isNotNull() & (x != ""), F.concat(F.lit(f"<p>{label}</p><p>"), x, F.lit("</p>"))).otherwise("")


def kicker(tipo: Column, numero: Column) -> Column:
    """Kind and number."""
    return F.concat(F.coalesce(tipo, F.lit("")), F.coalesce(F.concat(F.lit(" · "), F.nullif(numero, F.lit(""))), F.lit("")))


def any_of(columns: list[Column]) -> Column:
    """F8: whether one of the flags is set; null is not."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in columns))
