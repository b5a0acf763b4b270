"""String functions: escaping, matching, replacing, cutting. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def xml_escape(x: Column) -> Column:
    """The ampersand first, so that no entity is escaped twice."""
    return replaced(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def attribute_escape(x: Column) -> Column:
    """For attribute values."""
    return replaced(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def quoted(new: Column) -> Column:
    """Replacement text in which the regex engine finds no group references."""
    return F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def first_match(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match (an empty match stays empty)."""
    return F.when(F.regexp_like(x, F.lit(pattern)), F.regexp_extract(x, pattern, group))


def collapsed(x: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def first_block_replaced(x: Column, begin: str, end: str, new: Column) -> Column:
    """The first text from ``begin`` to ``end`` (and a line end after it) gives way to
    ``new``; a text without such a block stays. ``new`` is taken literally."""
    at = F.instr(x, begin)
    upto = at + F.instr(F.substr(x, at), end) - 1
    rest = F.substr(x, upto + len(end))
    rest = F.when(F.startswith(rest, F.lit("\n")), F.substr(rest, F.lit(2))).otherwise(rest)
    return F.when((at > 0) & (upto >= at), F.concat(F.substr(x, F.lit(1), at - 1), new, rest)).otherwise(x)


def blocks_replaced(x: Column, begin: str, end: str, new: Column) -> Column:
    """X11: every text from ``begin`` to the next ``end`` gives way to ``new``."""
    return F.regexp_replace(x, F.lit(rf"(?s)\Q{begin}\E.*?\Q{end}\E\n?"), quoted(new))


def tokens_replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements that ignore letter case."""
    for old, new in pairs:
        x = F.regexp_replace(x, rf"(?i)\Q{old}\E", re.sub(r"([\\$])", r"\\\1", new))
    return x


def inserted_after(x: Column, pattern: str, addition: Column) -> Column:
    """``addition`` right after the first match; a text without one stays."""
    at = F.regexp_instr(x, F.lit(pattern))
    end = at + F.length(F.regexp_extract(x, pattern, 0)) - 1
    return F.when(at > 0, F.concat(F.substr(x, F.lit(1), end), addition, F.substr(x, end + 1))).otherwise(x)


def before_separator(x: Column, separator: str) -> Column:
    """The trimmed text before the first separator, all of it without one."""
    return F.trim(F.substring_index(x, separator, 1))


def after_separator(x: Column, separator: str) -> Column:
    """The trimmed text after the first separator, empty without one."""
    at = F.instr(x, separator)
    return F.when(at > 0, F.trim(F.substr(x, at + len(separator)))).otherwise(F.when(x.isNotNull(), F.lit("")))


def truncated(x: Column, n: int, ellipsis: str = "...") -> Column:
    """At most n characters, the ellipsis counted in."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - len(ellipsis)), F.lit(ellipsis))).otherwise(x)


def without_html(x: Column) -> Column:
    """Script and style blocks, comments and tags removed."""
    return F.regexp_replace(x, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<.*?>", "")


def json_string(x: Column) -> Column:
    """The JSON literal of a text."""
    inner = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substr(inner, F.lit(2), F.length(inner) - 2))


def default(x: Column, value: Column) -> Column:
    """``value`` where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), value)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, null where the tag lacks it."""
    return first_match(tag, rf'\s{re.escape(name)}="([^"]*)"')


def has_class(tag: Column, name: str) -> Column:
    """Whether a tag has the class."""
    return F.coalesce(F.array_contains(F.split(attribute(tag, "class"), " "), name), F.lit(False))


def tags(html: Column, name: str) -> Column:
    """The start tags of one element, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(<{name}(?:\s[^>]*)?>)"), F.lit(1))
