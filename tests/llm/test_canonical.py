"""Problem 5 on an invented list: spellings, remarks, ties and values that mean no entry."""

from __future__ import annotations

VOCI = [
    (1, "corte", "Tribunale di Provanico, I Sez. civile", None),
    (2, "corte", "Tribunale di Provanico, II Sez. civile", None),
    (3, "corte", "Corte d'Appello di Castel Provasico, I Sez. civile", None),
    (4, "corte", "Giudice di pace di Testarolo", None),
    (5, "tipo", "Decreto", None),
    (6, "tipo", "Decreto di proroga", None),
    (7, "ente", "Ufficio — Direzione generale prove", "UDP"),
    (8, "ente", "Autorità garante di Testarolo", None),
]
MEANT = {
    ("corte", "TRIB. ORD. Provanico  (1^ Sez. civile)"): 1,
    ("corte", "sez. II civ. — Tribunale di Prvoanico;"): 2,
    ("corte", "C.d'A. di Castel Provaico Prima Sezione civile"): 3,  # as near to Provanico as to Provasico
    ("corte", "G.d.P. di Testarollo"): 4,
    ("corte", "Tribunale di Provanico, Sez. lavoro"): 0,
    ("corte", "Tribunale di Altrovello, I Sez. civile"): 0,
    ("corte", "Tribunale di Rpvoanico, I Sez. civile"): 1,  # three edits, two of them letters that changed places
    ("corte", "Tribunale di Probandico, I Sez. civile"): 1,
    ("corte", "Tribunale di Porvainco, I Sez. civile"): 1,  # two pairs of letters that changed places
    ("corte", "Tribunale di Plobendico, I Sez. civile"): 0,  # as many edits, of other letters
    ("corte", "Corte d'Appello di Testarolo"): 0,
    ("corte", "???"): 0,
    ("tipo", "Decr. n. 2049"): 5,
    ("tipo", "DERCETO (ricorso ex art. 4 c.p.c.)"): 5,
    ("tipo", "D. proroga - inaudita altera parte"): 6,
    ("tipo", "Visura"): 0,
    ("ente", "u.d.p. (ufficio)"): 7,
    ("ente", "Dir. gen. prove (Ufficio)"): 7,
    ("ente", "Alla Autorita' garante di Testarolo"): 8,
}


def test_mapped(spark):
    from cartulary.llm.canonical import mapped

    voci = spark.createDataFrame(VOCI, "voce_id bigint, campo string, nome string, sigla string")
    values = spark.createDataFrame([*MEANT, ("corte", "  "), ("corte", None)], "campo string, valore string")
    assert {(r.campo, r.valore): r.voce_id for r in mapped(values, voci).collect()} == MEANT


def test_found_leaves_names_out(spark):
    from cartulary.llm.canonical import found_values

    voci = spark.createDataFrame(VOCI, "voce_id bigint, campo string, nome string, sigla string")
    rows = [("g", "tipo", 1, "Decreto"), ("g", "tipo", 2, "decreto"), ("g", "tipo", 3, ""), ("g", "tipo", 4, None), ("g", "tipo", 5, "altro"), ("g", "tipo", 6, "decreto")]
    rows = spark.createDataFrame(rows, "tabella string, campo string, scheda_id bigint, valore string")
    assert sorted(map(tuple, found_values(rows, voci, "scheda_id").collect())) == [("g", "tipo", 2, 5), ("g", "tipo", 5, 0), ("g", "tipo", 6, 5)]


def test_odd_tables(spark):
    """No list, no values, very long values, clashing columns, repeated rows."""
    from cartulary.llm.canonical import found_values, mapped

    voci = spark.createDataFrame(VOCI, "voce_id bigint, campo string, nome string, sigla string")
    long = "Tribunale di " + "parola " * 5000
    rows = [("g", "corte", 1, long, 5, "a"), ("g", "corte", 2, "x" * 40_000, 5, "a"), ("g", "corte", 3, "Giudice di pace Testarolo", 5, "a"), ("g", "corte", 3, "Giudice di pace Testarolo", 5, "a")]
    rows = spark.createDataFrame(rows, "tabella string, campo string, scheda_id bigint, valore string, voce_id int, x string")
    assert sorted(tuple(r) for r in found_values(rows, voci, "scheda_id").collect()) == [("g", "corte", 1, 0), ("g", "corte", 2, 0), ("g", "corte", 3, 4)]
    assert {r.voce_id for r in mapped(rows.select("campo", "valore"), voci.where("voce_id > 99")).collect()} == {0}
    assert found_values(rows.where("scheda_id > 9"), voci, "scheda_id").count() == 0


def test_registered():
    import __spark_entry__

    assert {"p5_found", "p5_values"} <= set(__spark_entry__.queries())
