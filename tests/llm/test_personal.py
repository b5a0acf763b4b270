"""Problem 4 on invented sentences: kinds, places and what is no case."""

from __future__ import annotations

import pytest


def found(text):
    from cartulary.llm.personal import segments

    return [(kind, text[s:e]) for s, e, kind in segments(text)]


@pytest.mark.parametrize(
    ("text", "cases"),
    [
        ("Scrivere a Ugo.Test+3 [chiocciola] posta.example oppure al 0777-821 46 79.", [("EMAIL", "Ugo.Test+3 [chiocciola] posta.example"), ("TELEFONO", "0777-821 46 79")]),
        ("Da avv-prova chiocciola mail punto invalid.", [("EMAIL", "avv-prova chiocciola mail punto invalid")]),
        ("Chiama +39 301 000 4837 ore pasti.", [("TELEFONO", "+39 301 000 4837")]),
        ("Codice fiscale abc def 15r66 z602 r. Passaporto AB 0123456.", [("DOCUMENTO", "abc def 15r66 z602 r"), ("DOCUMENTO", "AB 0123456")]),
        ("Vive in V.le dei Cardi Alti, n° 72 bis da un mese.", [("INDIRIZZO", "V.le dei Cardi Alti, n° 72 bis")]),
        ("Abita in corso Provese s.n.c.. Il resto.", [("INDIRIZZO", "corso Provese s.n.c.")]),
        ("Sentiti D. Provandi, ROSSINOTTI Ada-Lea e Ugo El Testari, si riserva.", [("NOME", "D. Provandi"), ("NOME", "ROSSINOTTI Ada-Lea"), ("NOME", "Ugo El Testari")]),
        ("Firmato xü. Estensore Qwertan Zxcvano.", [("NOME", "Qwertan Zxcvano")]),
        ("😀 di ugo provandi inviata il 6.12.2023 e il 06/08/2023.", [("NOME", "ugo provandi")]),
        ("Posizione di provandi ada, documento ignoto.", [("NOME", "provandi ada")]),
        ("Nei confronti di Moussa Ada Provandi il giudizio prosegue.", [("NOME", "Moussa Ada Provandi")]),
        ("La sig.ra A. K. non compare. Iscritto al n. 3167992461 del ruolo. Rif. prot. 0035011 del 20.2.2024.", []),
        ("In via principale, capi da 4 a 90. La piazza antistante il valico 43 è chiusa. Modulo https://m.example/scheda/3189599203.", []),
        ("", []),
        (None, []),
    ],
)
def test_segments(text, cases):
    assert found(text) == cases


def test_masked_leaves_the_rest():
    from cartulary.llm.personal import masked

    assert masked("Poi  Ada Provandi\trinuncia. ") == "Poi  [NOME]\trinuncia. "
    assert masked(None) is None and masked("") == ""


def accuracy(given, seed):
    from cartulary.llm import labelled, personal

    both = found = gold = 0
    for text, spans in labelled.sentences(given, 600, seed):
        a, b = set(personal.segments(text)), set(spans)
        both, found, gold = both + len(a & b), found + len(a), gold + len(b)
    return both / found, both / gold


def test_held_out_accuracy():
    from cartulary.llm import personal

    precision, recall = accuracy(sorted(personal.GIVEN), 1001)
    assert precision > 0.98 and recall > 0.98


def test_names_that_no_list_holds():
    """Given names drawn from invented ones only."""
    precision, recall = accuracy(["zorvia", "belquando", "trinalfo"], 1002)
    assert precision > 0.95 and recall > 0.93


def test_training_is_repeatable_and_gradient_right():
    from cartulary.llm import labelled, personal

    sample = labelled.sentences(sorted(personal.GIVEN), 40, 5)
    assert personal.trained(sample, 2) == personal.trained(sample, 2)
    # one text: expectations by all segmentations
    text, gold = next((t, g) for t, g in sample if 2 <= len(personal.candidates(t)) <= 9)
    found = personal._sorted(personal.candidates(text))
    weights = {x: (len(x) % 5 - 2) / 3 for c in found for x in c[3]}
    scores = [sum(weights[x] for x in c[3]) for c in found]
    import math

    total, taken = 0.0, [0.0] * len(found)
    for bits in range(1 << len(found)):
        own = [k for k in range(len(found)) if bits >> k & 1]
        if all(found[i][1] <= found[j][0] or found[j][1] <= found[i][0] for i in own for j in own if i < j):
            p = math.exp(sum(scores[k] for k in own))
            total += p
            for k in own:
                taken[k] += p
    want: dict[str, float] = {}
    for k, c in enumerate(found):
        for x in c[3]:
            want[x] = want.get(x, 0.0) + (c[:3] in set(gold)) - taken[k] / total
    got = personal._gradient(found, set(gold), weights)
    assert all(abs(got.get(x, 0.0) - w) < 1e-2 for x, w in want.items())


def test_found_spans(spark):
    from cartulary.llm.personal import found_spans, masked_texts

    rows = spark.createDataFrame([(1, "😀 Firmato Ada Provandi.", "x"), (2, None, "x"), (3, "", "x"), (4, "nulla", "x"), (1, "😀 Firmato Ada Provandi.", "x")], "id bigint, massima string, tipo string")
    assert sorted(tuple(r) for r in found_spans(rows, "id", "massima").collect()) == [(1, 10, 22, "NOME")] * 2
    assert sorted((r.id, r.testo) for r in masked_texts(rows, "id", "massima").where("testo IS NOT NULL").collect()) == [(1, "😀 Firmato [NOME].")] * 2 + [(3, ""), (4, "nulla")]
    assert found_spans(rows.where("id > 9"), "id", "massima").count() == 0


def test_long_text():
    text = "Il termine decorre. " * 20_000 + "Firmato Ada Provandi."
    assert found(text) == [("NOME", "Ada Provandi")]


def test_registered():
    import __spark_entry__

    assert {"p4_found", "p4_masked"} <= set(__spark_entry__.queries())
