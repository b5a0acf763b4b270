"""Addresses of acts and articles, and references without a valid target."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

SAME = [
    "/patto-interattivo/dlgs-1/index.html#art_5-bis",
    "patto-interattivo/dlgs-1/#ART_5-BIS",
    " HTTPS://sito.example//patto-interattivo/./dlgs-1#art_5-bis\xa0",
    "../patto-interattivo/a/b/../../dlgs-1/index.html#art_5%2Dbis",
    "/patto-interattivo/../patto-interattivo/dlgs-1/?x=1#art_5-bis",
]


def test_one_key_for_all_spellings(spark):
    from cartulary.functions.links import link_key

    rows = spark.createDataFrame([(i, h) for i, h in enumerate(SAME)], "i int, h string")
    got = {r.i: r.k for r in rows.select("i", link_key(F.col("h")).alias("k")).collect()}
    assert [got[i] for i in range(4)] == ["dlgs-1/index.html#art_5-bis"] * 4
    assert got[4] in ("dlgs-1/index.html#art_5-bis", "patto-interattivo/dlgs-1/index.html#art_5-bis")


@pytest.mark.parametrize("href", [None, "", "  ", "#art_1", "/altro/x.html", "mailto:a@b.example"])
def test_no_reference(spark, href):
    from cartulary.functions.links import link_key

    assert spark.createDataFrame([(href,)], "h string").select(link_key(F.col("h"))).first()[0] is None


def test_states_of_orphans(spark):
    from cartulary.operators.orphans import orphan_references

    day = lambda n: datetime(2024, 1, n)
    span = "array<struct<da:timestamp_ntz,a:timestamp_ntz>>"
    parents = spark.createDataFrame([("x#", [(day(5), day(9))], None), ("x#1", [(day(5), None)], [(day(7), None)])], f"k string, atto {span}, articolo {span}")
    refs = [(1, "x#", day(6)), (2, "x#", day(9)), (3, "x#", day(2)), (4, "x#1", day(6)), (5, "x#1", day(8)), (6, "y#", day(6)), (7, None, day(6)), (8, "x#", None), (6, "y#", day(6))]
    refs = spark.createDataFrame(refs, "id int, k string, t timestamp_ntz")
    got = sorted((r.id, r.stato) for r in orphan_references(refs, parents, "k", "t", F.col("id"), ["atto", "articolo"]).collect())
    assert got == [(2, "rimosso"), (3, "tardivo"), (4, "tardivo"), (6, "assente"), (6, "assente"), (8, "senza data")]
    assert orphan_references(refs.where("id < 0"), parents, "k", "t", F.col("id"), ["atto", "articolo"]).count() == 0


def test_no_local_folder_on_a_cluster():
    from cartulary.session import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_orphans_of_odd_tables(spark):
    """Null and empty lists, null fields, parents without file or anchor, clashing columns,
    repeated rows, empty tables."""
    from cartulary.operators.orphans import act_parents, card_references, orphan_references

    day = datetime(2024, 1, 6)
    norme = "array<struct<label:string,href:string>>"
    cards = spark.createDataFrame([(1, None, day, "k", 1), (2, [], day, None, 2), (3, [("l", None), ("l", "/patto-interattivo/a.html"), None, ("l", "patto-interattivo/" + "x" * 50_000)], None, "", 3), (3, [("l", None), ("l", "/patto-interattivo/a.html"), None, ("l", "patto-interattivo/" + "x" * 50_000)], None, "", 3)], f"scheda_id bigint, norme {norme}, caricata_il timestamp_ntz, chiave string, atto int")
    atti = spark.createDataFrame([("a", "a.html", day, None, "z"), (None, "b.html", day, None, "z"), ("c", None, day, None, "z")], "act string, file string, caricato_il timestamp_ntz, rimosso_il timestamp_ntz, chiave string")
    articoli = spark.createDataFrame([("a", "1", None, day, None), ("c", "1", "art_1", day, None)], "act string, art string, anchor string, caricato_il timestamp_ntz, rimosso_il timestamp_ntz")
    refs, parents = card_references(cards, "t"), act_parents(atti, articoli)
    assert [r.chiave for r in parents.collect()] == ["a.html#"]
    got = sorted((r.scheda_id, r.posizione, r.stato) for r in orphan_references(refs, parents, "chiave", "caricata_il", F.struct("scheda_id", "posizione"), ["atto", "articolo"]).collect())
    assert got == [(3, 1, "senza data")] * 2 + [(3, 3, "senza data")] * 2
    none = card_references(cards.where("scheda_id > 9"), "t")
    assert orphan_references(none, act_parents(atti.where("act = 'q'"), articoli), "chiave", "caricata_il", F.col("scheda_id"), ["atto", "articolo"]).count() == 0


def test_hot_keys_are_spread(spark):
    """One key with most of the rows: found as hot, and the join gives every row."""
    from cartulary.operators.orphans import hot_keys, merge_join

    refs = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'caldo' ELSE concat('k', id) END AS k")
    parents = spark.createDataFrame([("caldo", 1), ("k0", 2)], "k string, v int")
    hot = hot_keys(refs, "k")
    assert hot == ["caldo"]
    joined = merge_join(refs, parents, "k", F.col("id"), hot)
    assert joined.count() == 3000 and joined.where("v = 1").count() == 2000 and joined.where("v = 2").count() == 1
