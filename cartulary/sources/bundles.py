"""Nested legal texts: script files around one JSON value, read with an explicit schema.

Keys (acts, articles) are data, so they are read as maps: inferring a schema would make a
column of each article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.text import attribute, has_class, tags
from cartulary.functions.values import parsed

#: One article, one act, a bundle of acts.
ARTICLE = "struct<label:string,heading:string,anchor:string,frags:array<array<string>>>"
ACT = f"struct<label:string,short:string,file:string,external:boolean,version:string,eurlex:string,articles:map<string,{ARTICLE}>,recitals:map<string,string>>"
BUNDLE = f"struct<acts:map<string,{ACT}>>"

_ASSIGNED = r"(?s)\A\s*window\.[^=]*=\s*(.*?)\s*;?\s*\z"


def script_value(source: Column) -> Column:
    """The JSON that a script assigns."""
    return F.regexp_extract(source, _ASSIGNED, 1)


def read_bundles(files: DataFrame) -> DataFrame:
    """Bundle, act, a (the nested act): ``files`` has path, value; the bundle is the
    folder below the root. Texts that are no such value give no row."""
    rows = files.select(F.substring_index("path", "/", 1).alias("bundle"), parsed(script_value(F.col("value")), BUNDLE).alias("b"))
    return rows.select("bundle", F.explode("b.acts").alias("act", "a"))


def acts_of(nested: DataFrame) -> DataFrame:
    """M1."""
    return nested.select("bundle", "act", *(F.col(f"a.{c}").alias(c) for c in ("label", "short", "file", "external", "version", "eurlex")))


def articles_of(nested: DataFrame) -> DataFrame:
    """M2."""
    rows = nested.select("bundle", "act", F.explode("a.articles").alias("art", "x"))
    return rows.select("bundle", "act", "art", "x.label", "x.heading", "x.anchor", F.size("x.frags").alias("n_frammenti"))


def fragments_of(nested: DataFrame) -> DataFrame:
    """M3: the number of a fragment is null or an integer."""
    rows = nested.select("bundle", "act", F.explode("a.articles").alias("art", "x")).select("bundle", "act", "art", F.posexplode("x.frags").alias("pos", "f"))
    return rows.select("bundle", "act", "art", "pos", F.try_element_at("f", F.lit(1)).try_cast("int").alias("par"), F.try_element_at("f", F.lit(2)).alias("html"))


def recitals_of(nested: DataFrame) -> DataFrame:
    """M4."""
    return nested.select("bundle", "act", F.explode("a.recitals").alias("n", "html"))


def cross_references(fragments: DataFrame) -> DataFrame:
    """M5: one row a link of class xref in a fragment."""
    rows = fragments.select("bundle", F.col("act").alias("src_act"), F.col("art").alias("src_art"), F.col("pos").alias("src_pos"), F.explode(tags(F.col("html"), "a")).alias("t"))
    t = F.col("t")
    names = {"dst_act": "data-act", "dst_art": "data-art", "dst_rct": "data-rct", "dst_par": "data-par", "href": "href"}
    return rows.where(has_class(t, "xref")).select("bundle", "src_act", "src_art", "src_pos", *(attribute(t, a).alias(n) for n, a in names.items()))


def amendments(fragments: DataFrame) -> DataFrame:
    """M6: one row a marked insertion or deletion."""
    marks = F.concat(tags(F.col("html"), "ins"), tags(F.col("html"), "del"))
    rows = fragments.select("bundle", "act", "art", "pos", F.explode(marks).alias("t"))
    t = F.col("t")
    kept = has_class(t, "amd-ins") | has_class(t, "amd-del")
    return rows.where(kept).select("bundle", "act", "art", "pos", F.substring(t, 2, 3).alias("kind"), attribute(t, "data-amd").alias("amd"))


def official_links(fragments: DataFrame) -> DataFrame:
    """M7: bundle, act, art, pos, href of the links to the official text."""
    rows = fragments.select("bundle", "act", "art", "pos", F.explode(tags(F.col("html"), "a")).alias("t"))
    t = F.col("t")
    return rows.where(has_class(t, "lawlink") & has_class(t, "ext")).select("bundle", "act", "art", "pos", attribute(t, "href").alias("href"))


def write_by_act(fragments: DataFrame, root: str) -> None:
    """A layout in which an act's fragments are found without reading the others'."""
    fragments.repartition("act").write.partitionBy("act").parquet(root)


def fragments_on_demand(spark: SparkSession, root: str, asked: DataFrame | str) -> DataFrame:
    """The fragments of one act, or of the acts in ``asked`` (act): only their
    folders are read, each once however often it is asked for; an unknown act gives none."""
    stored = spark.read.parquet(root)
    if isinstance(asked, str):
        return stored.where(F.col("act") == asked)
    return stored.join(asked.select("act").distinct(), "act", "left_semi")
