"""Cards as text files with front matter: a restricted YAML, read with built-in expressions.

Understood: scalars (plain, single- and double-quoted), lists of scalars (flow or block) and
lists of records (block, each ``{ label: .., href: .. }`` or one key a line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import paths, text
from cartulary.sources.files import whole_texts

_SPLIT = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n(.*))?\z"
_STRING = r'("[^"\\]*(?:\\.[^"\\]*)*"|\'[^\']*(?:\'\'[^\']*)*\'|[^,}\]\n]*)'


def _close(value: Column) -> tuple[Column, Column, Column]:
    """Whether a file has plain line ends and both marks, where it needs no expression over
    the whole text; what follows the first mark; where the second begins in that."""
    rest = F.substr(value, F.lit(5))
    at = F.instr(rest, "\n---\n")
    return F.startswith(value, F.lit("---\n")) & (at > 0) & ~F.contains(value, F.lit("\r")), rest, at


def front(value: Column) -> Column:
    """S3: the text between the marks, null where the file has none."""
    plain, rest, at = _close(value)
    return F.when(plain, F.substr(rest, F.lit(1), at - 1)).otherwise(text.first_match(value, _SPLIT, 1))


def body(value: Column) -> Column:
    """S3: what follows the front matter; the whole file where it has none."""
    plain, rest, at = _close(value)
    return F.when(plain, F.substr(rest, at + 5)).when(F.rlike(value, F.lit(_SPLIT)), F.regexp_extract(value, _SPLIT, 2)).otherwise(value)


def plain(x: Column) -> Column:
    """The text that a scalar stands for; null for nothing, null and ~."""
    t = F.trim(x)
    double = F.try_element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(1))
    single = F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'"))
    return F.when(F.startswith(t, F.lit('"')), double).when(F.startswith(t, F.lit("'")), single).when(t.isin("", "null", "~"), F.lit(None)).otherwise(t)


def _written(head: Column, key: str) -> Column:
    """What the key's line has after it, found by plain search; null without such a line."""
    lines = F.concat(F.lit("\n"), head)
    at = F.instr(lines, f"\n{key}:")
    return F.when(at > 0, F.btrim(F.substring_index(F.substr(lines, at + len(key) + 2), "\n", 1), F.lit(" \r")))


def scalar(head: Column, key: str) -> Column:
    return plain(_written(head, key))


def _block(head: Column, key: str) -> Column:
    return text.first_match(head, rf"(?m)^{key}:[ ]*\r?\n((?: +.*(?:\r?\n|\z))+)")


def strings(head: Column, key: str) -> Column:
    """A list of scalars; null where the key is absent."""
    flow = text.first_match(_written(head, key), r"^\[(.*)\]$")
    items = F.filter(F.regexp_extract_all(flow, F.lit(rf"(?:^|,)[ ]*{_STRING}"), F.lit(1)), lambda x: F.trim(x) != "")
    lines = F.regexp_extract_all(_block(head, key), F.lit(r"(?m)^ +- (.*?)\r?$"), F.lit(1))
    return F.coalesce(F.transform(items, plain), F.transform(lines, plain))


def records(head: Column, key: str, fields: list[str]) -> Column:
    """A list of records with the fields given; null where the key is absent."""
    items = F.regexp_extract_all(_block(head, key), F.lit(r"(?m)^ +- (.*(?:\r?\n {4,}.*)*)"), F.lit(1))
    of = lambda x, f: F.get(F.regexp_extract_all(x, F.lit(rf"(?:^|[{{,\n])\s*{f}:[ ]*{_STRING}"), F.lit(1)), F.lit(0))
    written = F.transform(items, lambda x: F.struct(*(of(x, f).alias(f) for f in fields)))  # found once, then read
    empty = F.when(_written(head, key) == "[]", F.array().cast(f"array<struct<{','.join(f + ':string' for f in fields)}>>"))
    return F.coalesce(empty, F.transform(written, lambda x: F.struct(*(plain(x[f]).alias(f) for f in fields))))


def cards_of(rows: DataFrame, scalars: list[str], lists: list[str], tables: list[str]) -> DataFrame:
    """The cards of files (path, value): slug, the fields as text, lists of texts, lists of
    (label, href), body. Files without front matter have null fields."""
    rows = rows.select(F.regexp_replace(paths.file_name(F.col("path")), r"\.md$", "").alias("slug"), front(F.col("value")).alias("head"), body(F.col("value")).alias("body"))
    h = F.col("head")
    rows = rows.select("slug", *(_written(h, k).alias(k) for k in scalars), *(strings(h, k).alias(k) for k in lists), *(records(h, k, ["label", "href"]).alias(k) for k in tables), "body")
    return rows.select("slug", *(plain(F.col(k)).alias(k) for k in scalars), *lists, *tables, "body")


def read_cards(spark: SparkSession, root: str, scalars: list[str], lists: list[str], tables: list[str]) -> DataFrame:
    """One row a ``*.md`` file right below ``root``, see ``cards_of``."""
    return cards_of(whole_texts(spark, root, "*.md", recursive=False), scalars, lists, tables)


def card_text(scalars: list[str], lists: list[str], tables: list[str], body: str = "body") -> Column:
    """The file of a card; absent fields are left out."""
    quoted = lambda x: F.coalesce(text.json_string(x), F.lit("null"))
    lines = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), quoted(F.col(k).cast("string")), F.lit("\n"))).otherwise("") for k in scalars]
    for k in lists:
        some = F.concat(F.lit(f"{k}:\n"), F.array_join(F.transform(k, lambda x: F.concat(F.lit("  - "), quoted(x), F.lit("\n"))), ""))
        lines.append(F.when(F.size(k) > 0, some).when(F.col(k).isNotNull(), f"{k}: []\n").otherwise(""))
    for k in tables:
        row = lambda x: F.concat(F.lit("  - label: "), quoted(x["label"]), F.lit("\n    href: "), quoted(x["href"]), F.lit("\n"))
        some = F.concat(F.lit(f"{k}:\n"), F.array_join(F.transform(k, row), ""))
        lines.append(F.when(F.size(k) > 0, some).when(F.col(k).isNotNull(), f"{k}: []\n").otherwise(""))
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"), F.coalesce(F.col(body), F.lit("")))
