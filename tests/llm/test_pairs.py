"""Problem 2 against brute force: heavy and light items, nulls, long lists, small tables."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from random import Random

import pytest


def brute(rows):
    """{(campo, a, b): (k, n_a, n_b, n)}"""
    out = {}
    for campo in {c for c, _ in rows if c}:
        lists = [sorted({x for x in v if x is not None}, key=lambda x: x.encode()) for c, v in rows if c == campo and v]
        lists = [v for v in lists if v]
        single = Counter(x for v in lists for x in v)
        for (a, b), k in Counter(p for v in lists for p in combinations(v, 2)).items():
            out[campo, a, b] = (k, single[a], single[b], len(lists))
    return out


def invented(seed, n, light):
    rng = Random(seed)
    rows = []
    for _ in range(n):
        v = {x for x in ("comune", "è frequente", "Zeta", "a") if rng.random() < 0.5}
        v |= {f"raro {rng.randrange(light)}" for _ in range(rng.randrange(0, 6))}
        rows.append((rng.choice(["temi", "temi", "norme"]), sorted(v)))
    return [*rows, ("temi", None), ("temi", []), (None, ["a", "b"]), ("norme", [None, "x", "a"]), ("temi", [f"lungo {i}" for i in range(120)])]


def found(df):
    return {(r.campo, r.voce_a, r.voce_b): (r.k, r.n_a, r.n_b, r.n) for r in df.collect()}


@pytest.mark.parametrize("heavy", [512, 3, 1])
def test_against_brute_force(spark, monkeypatch, heavy):
    from cartulary.llm import pairs

    monkeypatch.setattr(pairs, "HEAVY", heavy)
    rows = invented(heavy, 300, 40)
    df = spark.createDataFrame(rows, "campo string, voci array<string>")
    assert found(pairs.item_pairs(df)) == brute(rows)


def test_frequent_pairs_only(spark):
    from cartulary.llm.pairs import item_pairs

    rows = invented(5, 400, 30)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "campo string, voci array<string>, k int, n string")
    want = {p: x for p, x in brute(rows).items() if x[0] >= 8 and x[0] * 20 >= x[3]}
    assert want and found(item_pairs(df, least=8, least_share=20)) == want


def test_empty(spark):
    from cartulary.llm.pairs import item_pairs

    df = spark.createDataFrame([], "campo string, voci array<string>")
    assert item_pairs(df).count() == 0 and item_pairs(df, 8, 1000).count() == 0


def test_rows_of_cards(spark):
    from cartulary.llm.pairs import citation_rows, topic_rows

    norme = "array<struct<label:string,href:string>>"
    cards = spark.createDataFrame([(1, [" A\xa0 b ", "a B", " ", None], [("l", "/patto-interattivo/x.html#art_1"), ("l", "patto-interattivo/X.html#ART_1"), (None, None)]), (2, None, None), (3, [], [("l", "/patto-interattivo/manca.html")])], f"scheda_id bigint, temi array<string>, norme {norme}")
    parents = spark.createDataFrame([("x.html#art_1", "x", "1"), ("x.html#", "x", None)], "chiave string, act string, art string")
    assert [r.voci for r in topic_rows(cards).where("size(voci) > 0").collect()] == [["a b"]]
    assert [tuple(r) for r in citation_rows(cards, parents).collect()] == [("norme", ["x#1"])]


@pytest.mark.parametrize(("pending", "names"), [(1 << 22, 1 << 20), (50, 1 << 20), (1 << 22, 7)])
def test_table_that_overflows(monkeypatch, pending, names):
    """A partition gives partial counts away; their sums are the same."""
    import pyarrow as pa

    from cartulary.llm import pairs

    monkeypatch.setattr(pairs, "PENDING", pending)
    monkeypatch.setattr(pairs, "NAMES", names)
    rows = [(c, v) for c, v in invented(7, 200, 30) if c and v]
    rows = [(c, [x for x in v if x is not None]) for c, v in rows]
    batches = [pa.RecordBatch.from_pydict({"campo": pa.array([c for c, _ in part], pa.string()), "voci": pa.array([v for _, v in part], pa.list_(pa.string()))}) for part in (rows[:90], rows[90:])]
    sums = Counter()
    for batch in pairs._partial({"temi": ["a", "comune"], "norme": []}, None)(iter(batches)):
        for r in batch.to_pylist():
            sums[r["campo"], r["voce_a"], r["voce_b"]] += r["k"]
    assert sums == {p: x[0] for p, x in brute(rows).items()}
