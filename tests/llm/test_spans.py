"""Problem 8 against brute force on invented texts: short passages, repetitive texts, many
holders of one passage, texts longer than a piece, copies, nulls."""

from __future__ import annotations

from itertools import combinations
from random import Random

import pytest

SCHEMA = "doc_id bigint, text string"


def brute(rows, least):
    """Pairs and shared lengths, from every run of every text."""
    texts = {k: t for k, t in rows if t and len(t) >= least}
    where: dict[str, set] = {}
    for k, t in texts.items():
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    pairs = {p for ks in where.values() if len(ks) > 1 for p in combinations(sorted(ks), 2)}
    shared = {k: 0 for k, _ in rows}
    for k, t in texts.items():
        covered = set()
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                covered.update(range(i, i + least))
        shared[k] = len(covered)
    return pairs, shared


def check(spark, rows, least, gram=None):
    from cartulary.llm.spans import shared_lengths, shared_pairs

    docs = spark.createDataFrame(rows, SCHEMA)
    pairs, shared = brute(rows, least)
    assert {tuple(r) for r in shared_pairs(docs, "doc_id", "text", least, gram).collect()} == pairs
    assert {r.doc_id: r.shared for r in shared_lengths(docs, "doc_id", "text", least, gram).collect()} == shared


def invented(seed, n, letters, passage):
    rng = Random(seed)
    word = lambda m: "".join(rng.choice(letters) for _ in range(m))
    held = [word(passage) for _ in range(3)]
    rows = []
    for k in range(n):
        parts = [word(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            h = rng.choice(held)
            at = rng.randrange(0, passage // 3)
            parts += [h[at : rng.randrange(passage // 2, passage)], word(rng.randrange(0, 40))]
        rows.append((k, "".join(parts)))
    return [*rows, (n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "x")]


@pytest.mark.parametrize(("seed", "letters"), [(1, "abcdefghilmnopqrstuvz "), (2, "ab"), (3, "a😀è\n")])
def test_against_brute_force(spark, seed, letters):
    check(spark, invented(seed, 25, letters, 90), 40)


@pytest.mark.parametrize("few", [0, 1])
def test_many_forms(spark, monkeypatch, few):
    """The way by counted runs gives what the way by pairs gives."""
    from cartulary.llm import spans

    monkeypatch.setattr(spans, "FEW", few)
    check(spark, invented(4, 30, "abcdefghil ", 90), 40)


def test_repetitive_texts(spark):
    rows = [(1, "-" * 300), (2, "x" + "-" * 130 + "y" * 50), (3, "ab" * 100), (4, "ba" * 60 + "-" * 39), (5, "z" * 39 + "-" * 41)]
    check(spark, rows, 40)
    check(spark, rows, 40, gram=40)


def test_text_longer_than_a_piece(monkeypatch):
    """The windows of pieces hold every run that those of the whole text hold."""
    import numpy as np

    from cartulary.llm import spans

    rng = Random(5)
    text = "".join(rng.choice("abcd") for _ in range(900))

    def covered(piece):
        monkeypatch.setattr(spans, "PIECE", piece)
        found = set()
        for group in spans._pieces([text, None, "abc"], 40):
            for _, at, part in group:
                codes = np.frombuffer(part.encode("utf-32-le"), "<u4")
                _, c, h, before, after = spans.compact_windows(codes, np.array([0]), np.array([len(codes)]), 40, 12)
                for i in range(len(c)):
                    for s in range(c[i] - before[i], c[i] + after[i] - 39):
                        found.add((at + s, at + int(c[i]), int(h[i])))
        return found

    whole = covered(1 << 19)
    assert {s for s, _, _ in whole} == set(range(861))
    assert covered(100) == whole


def test_one_passage_in_many_records(spark):
    """Its cost follows the records, not their pairs."""
    from cartulary.llm.spans import shared_lengths

    rng = Random(6)
    word = lambda m: "".join(rng.choice("abcdefghilmnopqrstuvz ") for _ in range(m))
    passage = word(600)
    rows = [(k, word(100) + passage + word(100)) for k in range(2000)]
    got = {r.shared for r in shared_lengths(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert min(got) >= 600 and max(got) <= 620


def test_repeated_rows_and_bounds(spark):
    from cartulary.llm.spans import shared_lengths, shared_pairs, check_least, text_classes

    text = "una parte inventata che torna uguale in due testi diversi"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + "!"), (3, text)], SCHEMA)
    assert sorted(tuple(r) for r in shared_pairs(docs, "doc_id", "text", 50).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted((r.doc_id, r.shared) for r in shared_lengths(docs, "doc_id", "text", 50).collect()) == [(1, 57), (1, 57), (2, 57), (3, 57)]
    assert sorted(tuple(r) for r in text_classes(docs, "doc_id", "text", 50).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
    assert shared_pairs(docs.where("doc_id > 9"), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        check_least(4000)
    with pytest.raises(ValueError):
        shared_pairs(docs, "doc_id", "text", 50, 51)


def test_nearest_smaller():
    import numpy as np

    from cartulary.llm.spans import nearest_smaller

    rng = np.random.default_rng(7)
    x, g = rng.permutation(500), np.sort(rng.integers(0, 9, 500))
    want = [max((j for j in range(i) if x[j] < x[i] and g[j] == g[i] and all(g[m] == g[i] for m in range(j, i))), default=-1) for i in range(500)]
    assert nearest_smaller(x, g).tolist() == want


def test_other_columns_do_not_matter(spark):
    from cartulary.llm.spans import shared_pairs

    text = "una parte inventata che torna uguale in due testi diversi"
    docs = spark.createDataFrame([(1, text, 1, 2, "a"), (2, text, 3, 4, "b")], SCHEMA + ", h int, k int, t string")
    assert shared_pairs(docs, "doc_id", "text", 50).count() == 1
