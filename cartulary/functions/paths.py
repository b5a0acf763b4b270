"""Paths and addresses of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The languages that have a prefix of their own.
LANGUAGES = ["en", "fr", "es", "tr", "bn", "ru", "ar", "ur", "fa", "zh"]

_PREFIX = rf"^/({'|'.join(LANGUAGES)})(?:/|$)"


def relative(path: Column, root: Column) -> Column:
    """The path below the root folder, with / between its parts."""
    x = F.translate(path, "\\", "/")
    return F.when(F.startswith(x, root), F.regexp_replace(F.substr(x, F.length(root) + 1), "^/+", "")).otherwise(x)


def file_name(path: Column, index: str = "index.html") -> Column:
    """The last part of a path, the index page for a folder."""
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit(index))


def folder(path: Column) -> Column:
    """The path before its last part."""
    return F.regexp_extract(path, "^(.*)/", 1)


def has_part(path: Column, part: str) -> Column:
    """whether a folder or file of the path has this name."""
    return F.array_contains(F.split(path, "/"), part)


def is_page(path: Column) -> Column:
    """F4."""
    return F.endswith(path, F.lit(".html"))


def prefixed(path: Column, prefix: str = "") -> Column:
    """A path of the site under its prefix; other addresses as they are."""
    inside = F.startswith(path, F.lit("/")) & ~F.startswith(path, F.lit("//"))
    return F.when(inside, F.concat(F.lit(prefix), path)).otherwise(path)


def page_of(href: Column) -> Column:
    """Before the first #."""
    return F.substring_index(href, "#", 1)


def anchor_of(href: Column) -> Column:
    """After the first #, empty without one."""
    at = F.instr(href, "#")
    return F.when(at > 0, F.substr(href, at + 1)).otherwise(F.when(href.isNotNull(), F.lit("")))


def same_page(page: Column, current: Column) -> Column:
    """F16: whether a link's page part leads to the current page."""
    return (page == "") | (page == current)


def lazily_loaded(act: Column) -> Column:
    """acts of the Union, whose data are fetched when first asked for."""
    return F.regexp_like(act, F.lit("^(reg|dir|dec)"))


def language(path: Column, home: str = "it") -> Column:
    """The language of a path."""
    return F.coalesce(F.nullif(F.regexp_extract(path, _PREFIX, 1), F.lit("")), F.lit(home))


def localized(path: Column, target: Column, anchor: Column, home: str = "it") -> Column:
    """The page in another language; the anchor (with its #, or empty) is kept."""
    own = F.nullif(F.regexp_extract(path, _PREFIX, 1), F.lit(""))
    bare = F.when(own.isNotNull(), F.substr(path, F.length(own) + 2)).otherwise(path)
    bare = F.coalesce(F.nullif(bare, F.lit("")), F.lit("/"))
    return F.when(target == home, F.concat(bare, anchor)).otherwise(F.concat(F.lit("/"), target, bare, anchor))
