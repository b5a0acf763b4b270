"""Menus, redirects and header rules: small rule tables applied to large tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import paths

MENU = "map<string, array<struct<label:string, href:string, items:array<struct<label:string, href:string, external:boolean>>>>>"


def menu_of(menus: Column, lang: Column, home: str = "it") -> Column:
    """The menu of a language, the home language's where there is none."""
    return F.coalesce(F.try_element_at(menus, lang), F.try_element_at(menus, F.lit(home)))


def menu_rows(menus: DataFrame, column: str = "menu", prefix: str = "") -> DataFrame:
    """One row an entry and item: voce, con_figli, etichetta, href; an entry without
    items is a link of its own. External links stay as they are."""
    rows = menus.select(*[c for c in menus.columns if c != column], F.posexplode(column).alias("posto", "v"))
    children = F.coalesce(F.size("v.items"), F.lit(0)) > 0
    own = F.array(F.struct(F.col("v.label").alias("label"), F.col("v.href").alias("href"), F.lit(False).alias("external")))
    rows = rows.withColumn("con_figli", children).withColumn("i", F.explode(F.when(children, F.col("v.items")).otherwise(own)))
    href = F.when(F.coalesce("i.external", F.lit(False)), F.col("i.href")).otherwise(paths.prefixed(F.col("i.href"), prefix))
    return rows.select(*[c for c in menus.columns if c != column], "posto", F.col("v.label").alias("voce"), "con_figli", F.col("i.label").alias("etichetta"), href.alias("href"))


def redirected(requests: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``requests`` with ``verso`` and ``stato`` of the rule for the exact path (da,
    verso, stato, forza): it applies where the page does not exist (``esiste`` false) or the
    rule is forced; else the path itself with 200, or 404."""
    r = rules.select(F.col("da").alias(path), F.col("verso").alias("_verso"), F.col("stato").alias("_stato"), "forza")
    rows = requests.join(r, path, "left")
    applies = F.coalesce(F.col("_verso").isNotNull() & (F.coalesce("forza", F.lit(False)) | ~F.col("esiste")), F.lit(False))
    return rows.withColumn("verso", F.when(applies, F.col("_verso")).otherwise(F.col(path))).withColumn("stato", F.when(applies, F.col("_stato")).when(F.col("esiste"), 200).otherwise(404)).drop("_verso", "_stato", "forza")


def folders(path: Column) -> Column:
    """Every folder a path lies in, from the top: / first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def with_headers(requests: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """One row a request and rule (cartella ending in /, nome, valore) whose folder holds
    the path. The folders of a path are joined by equality: no request meets every rule."""
    rows = requests.withColumn("cartella", F.explode(folders(F.col(path))))
    return rows.join(rules, "cartella")
