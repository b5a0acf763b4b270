"""Cards and pages as files: neither their names nor all of them at once are held."""

from __future__ import annotations

import os

import pytest
from comparing import SF
from pyspark.sql import functions as F


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["s1_decision_cards", "s2_circular_cards"])
def test_driver_holds_no_card_names(spark, name):
    from cartulary.plans import catalog

    assert len(catalog.queries()[name](spark, SF).inputFiles()) == 1  # the table


def test_whole_texts(spark, tmp_path):
    from cartulary.sources.files import whole_texts

    for name in ["a.md", "b c+%20.md", "_x.md", ".y.md", "d.txt", "e.htm", "sotto/f.md", "_no/g.md"]:
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(name if name != "a.md" else "")
    found = whole_texts(spark, str(tmp_path), "*.{md,htm}")
    assert found.inputFiles() == []
    assert sorted((r.path, r.value) for r in found.collect()) == [("a.md", ""), ("b c+%20.md", "b c+%20.md"), ("e.htm", "e.htm"), ("sotto/f.md", "sotto/f.md")]
    assert {r.path for r in whole_texts(spark, f"file://{tmp_path}", "*.md", recursive=False).collect()} == {"a.md", "b c+%20.md"}
    with pytest.raises(FileNotFoundError):
        whole_texts(spark, f"{tmp_path}/manca", "*.md")


def test_through_files(spark, tmp_path):
    """Every row comes back, those of one path too, in turns of few files; none stays."""
    from cartulary.sources.files import through_files

    rows = spark.range(500).select(F.concat("id", F.lit(".md")).alias("path"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("content"))
    odd = spark.createDataFrame([("7.md", "altro"), ("7.md", ""), (None, "x"), ("n.md", None), ("t.txt", "x")], "path string, content string")
    got = sorted((r.path, r.value) for r in through_files(rows.unionByName(odd), f"file://{tmp_path}", "*.md", at_once=7).collect())
    assert got == sorted([*((f"{i}.md", "é" * i) for i in range(500)), ("7.md", "altro"), ("7.md", "")])
    assert list(tmp_path.iterdir()) == []


def test_cards_read_back(spark, tmp_path):
    """Long values, escapes, line ends of other kinds; a folder of cards and cards in turns
    read the same."""
    from cartulary.sources import cards
    from cartulary.sources.files import through_files
    from cartulary.sources.sinks import write_files

    shape = (["corte", "numero"], ["temi"], ["norme"])
    values = [("1", "a b\r\n---\n\u0085c", "~", ["x\ny", None, "[z]"], [("l" * 20_000, 'q"\\,}'), (None, "")], "---\n"), ("2", None, "", [], [], None), ("3", " sp ", "'", None, None, "b\r\n---\nc")]
    rows = spark.createDataFrame(values, "id string, corte string, numero string, temi array<string>, norme array<struct<label:string,href:string>>, body string")
    rows = rows.select(F.concat("id", F.lit(".md")).alias("path"), cards.card_text(*shape).alias("content"))
    write_files(rows, f"file://{tmp_path}/cards")
    wanted = [tuple(v[:-1]) + (v[-1] or "",) for v in values]
    for found in (cards.read_cards(spark, f"file://{tmp_path}/cards", *shape), cards.cards_of(through_files(rows, f"file://{tmp_path}", "*.md"), *shape)):
        got = [(r.slug, r.corte, r.numero, r.temi, r.norme and [tuple(x) for x in r.norme] if r.norme is not None else None, r.body) for r in found.orderBy("slug").collect()]
        assert got == wanted
