"""Problem 6 against a second encoder over the same vocabulary, and back again."""

from __future__ import annotations

import base64
import os

import pytest

from cartulary.llm.bpe import PATTERN, VOCABULARY, RankQueue, encoder, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")

TEXTS = ["", " ", "  \n\t ", "Il permesso n. 12/2024 è scaduto.", "l'avv. D’Ulivo  dice: «sì» ", "<p class=\"x\">ciao</p>\r\n\r\n", "😀👩‍👩‍👧 漢字 кириллица العربية", "a" * 3000, "ab" * 2000, "\x1c \x1f x", "don't we'll IT'S", "x y　z \u0085", "0123456789" * 40, "\n \n  \n", "é̀", "…—–", " \x1ca", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    import numpy as np

    return np.frombuffer(encoder(vocabulary()).encode(text), "<i4").tolist()


def test_same_ids_as_the_second_encoder(reference):
    for text in TEXTS:
        assert ids(text) == reference.encode_ordinary(text), text[:40]


def test_random_texts(reference):
    from random import Random

    rng = Random(1)
    letters = "abcdefghilmnopqrstuvzàèéìòù '’.,;:-()0123456789\n\t  😀é\r"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 200)))
        assert ids(text) == reference.encode_ordinary(text)


def test_very_long_pre_token():
    """A pre-token of a million letters takes time in proportion."""
    got = ids("ba" * 500_000)
    assert sum(len(t) for t in map(encoder_tokens().__getitem__, got)) == 1_000_000


def encoder_tokens():
    from cartulary.llm.bpe import decoder

    return decoder(vocabulary())


def test_queue():
    queue = RankQueue(50_256)
    for rank, at in ((70_00, 3), (5, 9), (7000, 1), (50_255, 2), (64, 4), (5, 1)):
        queue.push(rank, at)
    assert [queue.pop() for _ in range(5)] == [(5, [1, 9]), (64, [4]), (7000, [1, 3]), (50_255, [2]), None]


def test_table(spark, reference):
    from cartulary.llm.tokens import token_counts, token_ids, token_texts

    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (0, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    found = token_ids(docs, "doc_id", "text")
    assert sorted((r.doc_id, list(r.ids)) for r in found.collect()) == sorted((i, reference.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.doc_id, r.n) for r in token_counts(docs, "doc_id", "text").collect()) == sorted((i, len(reference.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((r.doc_id, r.text) for r in token_texts(found, "doc_id", "ids").collect()) == sorted((i, t or "") for i, t in rows)
    assert token_ids(docs.where("doc_id = 1000"), "doc_id", "text").count() == 0


def test_missing_vocabulary(spark):
    from cartulary.llm.tokens import token_ids

    with pytest.raises(FileNotFoundError):
        token_ids(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "doc_id", "text", "/nessuno")
