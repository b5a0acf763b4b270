"""Markdown to HTML (X5): the one scalar that no built-in expression covers.

Blocks: headings, paragraphs, lists, quotes, fenced code, rules, raw HTML. Inline: code,
strong, emphasis, links, bare addresses; quotation marks and dashes are set typographically.
Null and empty texts give an empty text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")
_ITEM = re.compile(r"([-*+]|\d{1,9}[.)])\s+(.*)$")
_RULE = re.compile(r"(?:-\s*){3,}$|(?:\*\s*){3,}$|(?:_\s*){3,}$")
_RAW = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->")
_LINK = re.compile(r"\[([^\[\]]*)\]\(\s*<?([^\s<>()]*)>?(?:\s+\"([^\"]*)\")?\s*\)")
_BARE = re.compile(r"\bhttps?://[^\s<>\"]*[^\s<>\".,;:!?)]")


def _escaped(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _typographic(x: str) -> str:
    x = re.sub(r"(?<!-)---(?!-)", "—", x)
    x = re.sub(r"(?<!-)--(?!-)", "–", x)
    x = x.replace("...", "…").replace("(c)", "©").replace("(tm)", "™").replace("(r)", "®")
    x = re.sub(r'(^|[\s(\[—–])"', r"\1“", x).replace('"', "”")
    return re.sub(r"(^|[\s(\[—–])'", r"\1‘", x).replace("'", "’")


def inline(x: str) -> str:
    """Inline marks of one block; what is finished is kept aside so that no later step reads it."""
    kept: list[str] = []

    def keep(html: str) -> str:
        kept.append(html)
        return f"\x00{len(kept) - 1}\x00"

    x = x.replace("\x00", "�")
    x = re.sub(r"(`+)(.+?)\1(?!`)", lambda m: keep(f"<code>{_escaped(m[2].strip())}</code>"), x, flags=re.S)
    x = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(_escaped(m[1])), x)
    x = _LINK.sub(lambda m: keep(f'<a href="{_escaped(m[2])}"' + (f' title="{_escaped(m[3])}"' if m[3] else "") + ">") + m[1] + keep("</a>"), x)
    x = _RAW.sub(lambda m: keep(m[0]), x)
    x = _BARE.sub(lambda m: keep(f'<a href="{_escaped(m[0])}">{_escaped(m[0])}</a>'), x)
    x = _escaped(_typographic(x))
    x = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<strong>\2</strong>", x, flags=re.S)
    x = re.sub(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?!\*)|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", lambda m: f"<em>{m[1] or m[2]}</em>", x, flags=re.S)
    x = re.sub(r"(?: {2,}|\\)\n", "<br>\n", x)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], x))


def to_html(source: str | None) -> str:
    lines = (source or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[str] = []
    at = 0
    while at < len(lines):
        line = lines[at]
        bare = line.strip()
        if not bare:
            at += 1
        elif bare.startswith("```") or bare.startswith("~~~"):
            fence, at, body = bare[:3], at + 1, []
            while at < len(lines) and not lines[at].strip().startswith(fence):
                body.append(lines[at])
                at += 1
            at += 1
            out.append(f"<pre><code>{_escaped(chr(10).join(body))}\n</code></pre>")
        elif _RULE.match(bare):
            out.append("<hr>")
            at += 1
        elif m := _HEADING.match(bare):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            at += 1
        elif bare.startswith(">"):
            body = []
            while at < len(lines) and lines[at].strip().startswith(">"):
                body.append(re.sub(r"^\s*> ?", "", lines[at]))
                at += 1
            out.append("<blockquote>\n" + to_html("\n".join(body)) + "</blockquote>")
        elif m := _ITEM.match(bare):
            kind, items = ("ul" if m[1] in "-*+" else "ol"), []
            while at < len(lines) and (n := _ITEM.match(lines[at].strip())) and (n[1] in "-*+") == (kind == "ul"):
                items.append(f"<li>{inline(n[2])}</li>")
                at += 1
            out.append(f"<{kind}>\n" + "\n".join(items) + f"\n</{kind}>")
        else:
            body = []
            while at < len(lines) and lines[at].strip() and not _HEADING.match(lines[at].strip()) and (not body or not _ITEM.match(lines[at].strip())):
                body.append(lines[at].lstrip())
                at += 1
            joined = "\n".join(body).rstrip()
            out.append(joined if joined.startswith("<") and not joined.startswith("<http") and _RAW.match(joined) and re.match(r"</?(?:div|p|table|ul|ol|section|pre|h\d)\b", joined, re.I) else f"<p>{inline(joined)}</p>")
    return "".join(x + "\n" for x in out)


def rendered(source: Column) -> Column:
    """X5 over a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(to_html)

    return run(source)
