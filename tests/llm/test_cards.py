"""Problem 3 on invented cards: spellings, fields without letters, collisions, large classes."""

from __future__ import annotations

from datetime import date

import pytest

DAY = date(2024, 1, 2)
SCHEMA = "scheda_id bigint, date date, corte string, numero string"


def pairs(spark, rows):
    from cartulary.llm.cards import formatting_pairs

    return sorted(tuple(r) for r in formatting_pairs(spark.createDataFrame(rows, SCHEMA)).collect())


def test_collisions_do_not_merge(spark, monkeypatch):
    from cartulary.llm import cards

    monkeypatch.setattr(cards, "_MASK", 0)  # every token's hash is 0: all cards collide
    rows = [(1, DAY, "Tribunale di Provanico", "12/2024"), (2, DAY, "TRIBUNALE  di provanico", "2024-12"), (3, DAY, "Tribunale di Testarolo", "12/2024"), (4, DAY, "Provanico", "12/12/2024"), (5, DAY, "Provanico", "12/2024/2024"), (6, None, "Provanico", "1"), (7, date(2024, 1, 3), "Provanico", "12/2024/2024")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.scheda_id, r.copie) for r in cards.collapsed(table).collect()) == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]
    assert pairs(spark, rows) == [(1, 2)]


def test_fields_without_letters_are_present(spark):
    rows = [(1, DAY, "-", "1"), (2, DAY, "???", "1"), (3, DAY, " \xa0", "1"), (4, DAY, "", "1"), (5, DAY, None, "1"), (6, DAY, "A", "-"), (7, DAY, "a", "..."), (8, None, "a", "-")]
    assert pairs(spark, rows) == [(1, 2), (6, 7)]


def test_numbers_apart_and_initials(spark):
    rows = [(1, DAY, "R. G. Provanico", "12 34"), (2, DAY, "provanico, RG", "34/12"), (3, DAY, "RG Provanico", "1234"), (4, DAY, "R.G. Provanicò", "12 34")]
    assert pairs(spark, rows) == [(1, 2)]


def test_repeated_rows_and_empty_table(spark):
    from cartulary.llm.cards import collapsed

    rows = [(1, DAY, "A", "1"), (1, DAY, "A", "1"), (2, DAY, "a.", "1")]
    assert pairs(spark, rows) == [(1, 2)]
    assert [(r.scheda_id, r.copie) for r in collapsed(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 3)]
    assert pairs(spark, []) == [] and collapsed(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [60])
def test_large_class_is_whole(spark, n):
    rows = [(i, DAY, f"Corte{' ' * (i % 5)}, Uno", "7") for i in range(n)] + [(n, DAY, "Corte", "7")]
    assert pairs(spark, rows) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_other_columns_do_not_matter(spark):
    from cartulary.llm.cards import collapsed, formatting_pairs

    table = spark.createDataFrame([(1, DAY, "A", "1", "x", 1), (2, DAY, "a", "1", "y", 2)], SCHEMA + ", h1 string, tc int")
    assert formatting_pairs(table).count() == 1 and collapsed(table).count() == 1
