"""Functions and operators on invented rows: nulls, empty texts, ties, repeated rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cartulary.functions import markdown, paths, text, values


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("1-bis", 1), ("1.1", 1), (" -7x", -7), ("x1", None), ("", None), (None, None), ("99999999999", None)],
)
def test_leading_int(spark, value, wanted):
    assert one(spark, value, values.leading_int) == wanted


@pytest.mark.parametrize(("value", "wanted"), [(-0.5, 0), (0.5, 1), (1.49, 1), (-1.5, -1), (None, None)])
def test_half_up(spark, value, wanted):
    assert one(spark, value, values.half_up, "double") == wanted


def test_truncated_and_default(spark):
    assert one(spark, "abcdef", lambda x: text.truncated(x, 5)) == "ab..."
    assert one(spark, "abcde", lambda x: text.truncated(x, 5)) == "abcde"
    assert one(spark, None, lambda x: text.truncated(x, 5)) is None
    assert one(spark, "", lambda x: text.default(x, F.lit("d"))) == "d"


def test_blocks(spark):
    new = F.lit("$1\\n")
    assert one(spark, "a<b>1</b>\nc<b>2</b>", lambda x: text.first_block_replaced(x, "<b>", "</b>", new)) == "a$1\\nc<b>2</b>"
    assert one(spark, "a</b><b>1", lambda x: text.first_block_replaced(x, "<b>", "</b>", new)) == "a</b><b>1"
    assert one(spark, "a<b>1</b>c<b>2</b>\n", lambda x: text.blocks_replaced(x, "<b>", "</b>", new)) == "a$1\\nc$1\\n"
    assert one(spark, "ab", lambda x: text.inserted_after(x, "z", F.lit("!"))) == "ab"
    assert one(spark, "A\xa0 \t b ", text.collapsed) == "A b"


def test_paths(spark):
    assert one(spark, "a/b/", paths.file_name) == "index.html"
    assert one(spark, "/zh", paths.language) == "zh" and one(spark, "/zhou/", paths.language) == "it"
    assert one(spark, "x#y#z", paths.anchor_of) == "y#z" and one(spark, "x", paths.anchor_of) == ""
    assert one(spark, "//altro", lambda x: paths.prefixed(x, "/p")) == "//altro"


@pytest.mark.parametrize(
    ("source", "html"),
    [
        (None, ""),
        ("", ""),
        ("# Uno *due*", "<h1>Uno <em>due</em></h1>\n"),
        ("a **b** `c<d`", "<p>a <strong>b</strong> <code>c&lt;d</code></p>\n"),
        ("[x](y.html) e https://z.example.", '<p><a href="y.html">x</a> e <a href="https://z.example">https://z.example</a>.</p>\n'),
        ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"),
        ('"q" -- r...', "<p>“q” – r…</p>\n"),
        ("uno\ndue\n\ntre", "<p>uno\ndue</p>\n<p>tre</p>\n"),
        ("```\n<a>\n```", "<pre><code>&lt;a&gt;\n</code></pre>\n"),
        ("> a\n> b", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n"),
    ],
)
def test_markdown(source, html):
    assert markdown.to_html(source) == html


def test_front_matter(spark):
    from cartulary.sources import cards

    source = "---\ncorte: 'L''Aquila'\ndate: 2026-07-10\nnumero: ~\ntemi: [uno, \"d, u\"]\nnorme:\n  - { label: \"a, b\", href: \"/x#1\" }\n  - label: c\n    href: null\n---\n\ncorpo\n---\nfine"
    rows = spark.createDataFrame([(source,), ("senza",)], "v string").select(cards.front(F.col("v")).alias("h"), cards.body(F.col("v")).alias("b"))
    h = F.col("h")
    a, b = rows.select(cards.scalar(h, "corte").alias("c"), cards.scalar(h, "date").alias("d"), cards.scalar(h, "numero").alias("n"), cards.strings(h, "temi").alias("t"), cards.records(h, "norme", ["label", "href"]).alias("r"), "b").collect()
    assert (a.c, a.d, a.n, a.t) == ("L'Aquila", "2026-07-10", None, ["uno", "d, u"])
    assert [tuple(x) for x in a.r] == [("a, b", "/x#1"), ("c", None)]
    assert a.b == "\ncorpo\n---\nfine"
    assert (b.c, b.t, b.r, b.b) == (None, None, None, "senza")


def test_paragraph_or_all(spark):
    from cartulary.operators.reader import paragraph_text

    frags = "array<struct<pos:int,par:int,html:string>>"
    rows = spark.createDataFrame([([(0, None, "a"), (1, 2, "b"), (2, 2, "c"), (3, None, None)], p) for p in (2, 9, None)] + [([], 1)], f"f {frags}, p int")
    short = [r[0] for r in rows.select(paragraph_text(F.col("f"), F.col("p"), False)).collect()]
    mark = '<span class="hl-par">{}</span>'.format
    assert short == [mark("b") + mark("c"), "abc", "abc", ""]
    assert rows.select(paragraph_text(F.col("f"), F.col("p"), True)).first()[0] == "a" + mark("b") + mark("c")


def test_metadata_settles(spark):
    """A second run brings an injection up to date once at most, a third changes nothing."""
    from cartulary.operators.pages import changed, with_metadata

    rows = [("index.html", "<title>x</title>"), ("ext-a.html", "<TITLE>\n Uno\\1 — $2 & \"due\" </TITLE><body>"), ("a/index.html", "<title>N</title>\n<meta>"), ("b.html", None), ("c.html", "niente"), ("d.html", "<title></title>")]
    pages = spark.createDataFrame(rows, "rel string, html string")
    for _ in range(2):
        pages = with_metadata(pages).select("rel", F.col("nuovo").alias("html"))
    again = with_metadata(pages)
    assert changed(again).count() == 0
    assert {r.rel: r.esito for r in again.collect()} == {"index.html": "gia_ok", "ext-a.html": "gia_ok", "a/index.html": "gia_ok", "b.html": "skip", "c.html": "skip", "d.html": "gia_ok"}


def test_stack(spark):
    from cartulary.operators.events import stacked

    steps = [(1, 1), (2, 1), (3, -1), (4, -1), (5, -1), (6, 1), (7, None), (8, 0), (9, 1)]
    rows = spark.createDataFrame([("u", t, s) for t, s in steps], "u string, t int, s int")
    got = [(r.t, r.profondita, r.cima) for r in stacked(rows, "u", ["t"], F.col("s"), F.col("t")).orderBy("t").collect()]
    assert got == [(1, 1, 1), (2, 2, 2), (3, 1, 1), (4, 0, None), (5, 0, None), (6, 1, 6), (7, 0, None), (8, 0, None), (9, 1, 9)]


@pytest.mark.parametrize("width", [1, 3, 50])
def test_stack_in_parts(spark, width):
    """Against a stack that is kept, for users with and without closings."""
    from random import Random

    from cartulary.operators.events import stacked

    rng = Random(width)
    rows, want = [], {}
    for u in ("a", "b", None):
        kept = []
        for t in range(60):
            step = rng.choice([1, 1, -1, -1, 0] + ([None] if u == "b" else []))
            if step is None:
                kept = []
            elif step == 1:
                kept.append(t)
            elif step == -1 and kept:
                kept.pop()
            rows.append((u, t, step))
            want[u, t] = (len(kept), kept[-1] if kept else None)
    events = spark.createDataFrame(rows, "u string, t int, s int")
    got = {(r.u, r.t): (r.profondita, r.cima) for r in stacked(events, "u", ["t"], F.col("s"), F.col("t"), lambda t: F.floor(t / width)).collect()}
    assert got == want


def test_joins_on_order(spark):
    from cartulary.operators.intervals import as_of, overlaps, range_join

    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), (None, 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("c", 1, "w")], "k string, t int, v string")
    assert sorted(((r.k, r.t, r.v) for r in as_of(left, right, ["k"], "t", ["v"]).collect()), key=str) == sorted([("a", 5, "z"), ("a", 1, None), ("b", 5, None), (None, 5, None), ("a", None, None)], key=str)
    cut = as_of(left, right, ["k"], "t", ["v"], lambda t: F.floor(t / 2))
    assert sorted(((r.k, r.t, r.v) for r in cut.collect()), key=str) == sorted([("a", 5, "z"), ("a", 1, None), ("b", 5, None), (None, 5, None), ("a", None, None)], key=str)
    late = spark.createDataFrame([("a", 40), ("c", 90)], "k string, t int")
    assert sorted((r.k, r.v) for r in as_of(late, right, ["k"], "t", ["v"], lambda t: F.floor(t / 2)).collect()) == [("a", "z"), ("c", "w")]
    points, bands = spark.createDataFrame([(1.0,), (2.5,), (None,)], "p double"), spark.createDataFrame([(1.0, 2.5), (0.0, 10.0), (3.0, 3.0)], "lo double, hi double")
    assert sorted((r.p, r.hi) for r in range_join(points, bands, F.col("p"), F.col("lo"), F.col("hi"), 2.0).collect()) == [(1.0, 2.5), (1.0, 10.0), (2.5, 10.0)]
    spans = spark.createDataFrame([("k", 1, 0.0, 9.0), ("k", 2, 4.0, 5.0), ("k", 3, 5.0, 6.0)], "k string, i int, da double, a double")
    assert sorted((r.i, r.j) for r in overlaps(spans, spans, ["k"], 2.0).where("x.i < y.i").select(F.col("x.i").alias("i"), F.col("y.i").alias("j")).collect()) == [(1, 2), (1, 3)]


def test_undisturbed(spark):
    from datetime import datetime

    from cartulary.operators.events import undisturbed

    at = lambda d, h: datetime(2024, 1, d, h)
    rows = [("u", 1, at(1, 10)), ("u", 2, at(1, 11)), ("u", 3, at(1, 23)), ("u", 4, at(2, 0)), ("u", 5, at(9, 5)), ("v", 6, at(1, 1)), (None, 7, at(1, 1)), (None, 8, at(1, 2)), ("u", 9, at(9, 5))]
    events = spark.createDataFrame(rows, "u string, i int, t timestamp_ntz")
    assert sorted(r.i for r in undisturbed(events, "u", "t", ["t", "i"], "2 HOURS").collect()) == [2, 4, 6, 8, 9]


def test_places_in_order(spark):
    from cartulary.operators.ordering import in_order

    rows = spark.createDataFrame([(x,) for x in ("b", "a", None, "c")], "x string")
    assert sorted((r.posto, r.x) for r in in_order(rows, ["x"]).collect()) == [(1, None), (2, "a"), (3, "b"), (4, "c")]
    assert in_order(rows.where("x = 'z'"), ["x"]).count() == 0


def test_nearest_leaves_itself_out(spark):
    from cartulary.operators.search import nearest

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id bigint, v array<float>")
    got = [(r.q, r.id) for r in nearest(rows, rows.where("id = 1"), "id", "v", 1).collect()]
    assert got == [(1, 2)]


def test_cross_references_and_marks(spark):
    from cartulary.sources import bundles

    html = '<p><a class="xref" data-act="x" data-art="5-bis" data-par="1" href="#a">r</a><a class="lawlink ext" href="u">g</a><ins class="amd-ins" data-amd="m">n</ins><del>v</del></p>'
    rows = spark.createDataFrame([("b", "a", "1", 0, None, html), ("b", "a", "1", 1, None, None)], "bundle string, act string, art string, pos int, par int, html string")
    assert [(r.dst_act, r.dst_art, r.dst_par, r.dst_rct) for r in bundles.cross_references(rows).collect()] == [("x", "5-bis", "1", None)]
    assert [(r.kind, r.amd) for r in bundles.amendments(rows).collect()] == [("ins", "m")]
    assert [r.href for r in bundles.official_links(rows).collect()] == ["u"]
    source = 'window.D = {"acts":{"dlgs-1":{"label":"L","articles":{"5-bis":{"label":"A","frags":[[1,"x"],[null,"y"]]}},"recitals":{"1":"r"}}}};\n'
    nested = bundles.read_bundles(spark.createDataFrame([("k/data.js", source), ("k/altro.js", "nulla")], "path string, value string"))
    assert [(r.art, r.pos, r.par, r.html) for r in bundles.fragments_of(nested).orderBy("pos").collect()] == [("5-bis", 0, 1, "x"), ("5-bis", 1, None, "y")]
    assert [(r.n, r.html) for r in bundles.recitals_of(nested).collect()] == [("1", "r")]


def test_spread(spark):
    from cartulary.session import spread

    few = spark.range(0, 10, 1, 1)
    assert spread(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 64)
    assert spread(many) is many
    grouped = many.groupBy("id").count()
    assert spread(grouped) is grouped
