"""How many near copies the near_dedup stage finds, by similarity and by how the changes lie."""

from __future__ import annotations

import random

import pytest

from ledgerloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def changed(rng, words, word, how, share):
    """``words`` with some of them replaced, here and there or in one stretch, or with a stretch put in or left out."""
    n = max(1, round(len(words) * share))
    out = list(words)
    if how == "scattered":
        for k in rng.sample(range(len(words)), max(1, n // 5)):
            out[k] = word()
        return out
    at = rng.randrange(len(words) - n)
    return out[:at] + ([word() for _ in range(n)] + out[at:] if how == "put in" else out[at + n :])


@pytest.mark.parametrize("how", ["scattered", "put in", "left out"])
def test_recall_by_similarity(spark, how):
    rng = random.Random(how)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    rows, pairs = [], []
    for k in range(260):
        words = [word() for _ in range(rng.randint(60, 500))]
        near = changed(rng, words, word, how, rng.uniform(0.01, {"scattered": 0.14, "put in": 0.28, "left out": 0.24}[how]))
        a, b = shingles(words), shingles(near)
        pairs.append((2 * k, len(a & b) / len(a | b)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in near_copies.drop_near_copies(docs).select("doc_id").collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        own = [k for k, similarity in pairs if low <= similarity < high]
        assert len(own) >= 15 and sum(not {k, k + 1} <= kept for k in own) >= 0.9 * len(own), (low, len(own))
    assert all({k, k + 1} <= kept for k, similarity in pairs if similarity < 0.8)
    assert all({k, k + 1} & kept for k, _ in pairs)
