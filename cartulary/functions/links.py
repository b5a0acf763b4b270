"""Addresses of acts and articles: one canonical key for every way of writing a link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The folder of the site that holds the acts (fixed value of the data format).
ROOT = "patto-interattivo/"


#: White space trimmed from around an address, as code points of the Unicode property.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: What may stand before the folder of the acts: scheme, host, steps.
_BEFORE = r"^(?:https?:)?(?://[^/]*/|[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+)?/)?(?:\.{0,2}/)*"


def _decoded(x: Column) -> Column:
    """Percent escapes resolved; with a malformed escape the text as it is."""
    read = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(x, F.lit("%")), F.coalesce(read, x)).otherwise(x)


def _stepped(path: Column) -> Column:
    """A path without ``..``: every such step takes back the step before it, if there is one."""
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/")
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(F.contains(path, F.lit("/..")), walked).otherwise(path)


def link_key(href: Column) -> Column:
    """``file#anchor`` in lower case for a link into the folder of the acts, ``file#``
    without a fragment, null for any other link, for null and for blank.

    Any host counts as the site's own: the cards write it in several ways, and an address of
    another site does not hold the folder's name. White space around, scheme and host, ``.`` and ``..`` steps, doubled slashes, query,
    percent escapes and letter case do not matter; a folder stands for its index.html. Each
    costly step reads the one before it once: inlining by the optimizer stays linear."""
    x = F.btrim(href, F.lit(BLANKS))
    page = F.lower(_decoded(F.substring_index(F.substring_index(x, "#", 1), "?", 1)))
    page = F.regexp_extract_all(F.translate(page, "\\", "/"), F.lit(_BEFORE + ROOT.rstrip("/") + "(/.*)$"), F.lit(1))
    page = F.transform(page, lambda p: F.regexp_replace(p, r"/+(?:\./+)*", "/"))
    page = F.try_element_at(F.transform(page, _stepped), F.lit(1))
    page = F.regexp_replace(F.regexp_replace(page, r"/([^/.]+)$", "/$1/"), r"/$", "/index.html")
    anchor = F.lower(_decoded(F.split_part(x, F.lit("#"), F.lit(2))))
    return F.concat(F.substring(page, 2, 2**31 - 1), F.lit("#"), anchor)


def link_key_sql(href: str) -> str:
    """The same key in the oracle's SQL dialect (RE2: no lookaround)."""
    x = f"regexp_replace({href}, '^[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{3000}}]+$', '', 'g')"
    page = f"lower(url_decode(replace(regexp_replace(regexp_replace({x}, '#.*$', '', 's'), '\\?.*$', '', 's'), '+', '%2B')))"
    page = f"regexp_replace(regexp_replace({page}, '^https?://[^/]*/', '/'), '/(\\./)+|/{{2,}}', '/', 'g')"
    page = f"regexp_replace({page}, '^(\\.{{0,2}}/)+', '')"
    rest = f"regexp_replace(regexp_replace(substr({page}, {len(ROOT) + 1}), '(^|/)$', '\\1index.html'), '(^|/)([^/.]+)$', '\\1\\2/index.html')"
    anchor = f"CASE WHEN strpos({x}, '#') > 0 THEN lower(url_decode(replace(substr({x}, strpos({x}, '#') + 1), '+', '%2B'))) ELSE '' END"
    return f"CASE WHEN starts_with({page}, '{ROOT}') THEN ({rest}) || '#' || ({anchor}) END"
