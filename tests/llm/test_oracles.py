"""Token attribution by section against the library's offsets, and the ordinal fit against a plain solver."""

from __future__ import annotations

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerloom.llm import quality_classifier, token_counts

SCHEMA = "doc_id long, text string, section string, n_tokens long"


def by_section(text, rule, library):
    """(start, end, tokens, crossing tokens) of each line, token by token and character by character."""
    sections, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            sections.append((at, end))
        at = end
    sections = sections or [(0, 0)]
    of = [k for k, (a, b) in enumerate(sections) for _ in range(a, b)]
    counts = [[0, 0] for _ in sections]
    for a, b in library.encode(text, add_special_tokens=False).offsets if text else ():
        held = [of[c] for c in range(a, b)]
        own = {"first": held[0], "last": held[-1], "most": max(dict.fromkeys(held), key=lambda k: (held.count(k), -k))}[rule]
        counts[own][0] += 1
        counts[own][1] += len(set(held)) > 1
    return [(a, b, *n) for (a, b), n in zip(sections, counts, strict=True)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, rule):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    pieces = ["word", " and", "\n", "\n\n", "\n \n", "   ", "\t\n", "é", "漢字", "🙂", ".", ";\n", "}\n\n\n", "12", "\r\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(120)] + [None, "", "\n", "\n" * 40, "x " * 20_000 + "\nlast"]
    rows = [(k, t, "mine", 1) for k, t in enumerate(texts)]
    got: dict = {}
    for r in token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_tokens, r.n_crossing))
    want = {k: by_section(t or "", rule, library) for k, t in enumerate(texts)}
    assert got == want
    assert sum(n for own in want.values() for *_, n in own) > 20


def test_rules_differ():
    """Three lines in one token: it is the first's, the last's, or that of the longest part."""
    borders, starts, lasts = np.array([0, 1, 4]), np.array([0]), np.array([5])
    assert [int(token_counts.attribute(starts, lasts, borders, rule)[0][0]) for rule in ("first", "last", "most")] == [0, 2, 1]


def test_fit_against_a_plain_solver():
    """The same likelihood with the same penalty, by plain steps along numerical slopes that are halved where they fail."""
    rng = np.random.default_rng(2)
    n, words, shrink = 600, 6, 2e-4
    held = rng.random((n, words)) < 0.4
    score = held @ np.array([2.0, -1.5, 1.0, 0.5, -0.5, 0.0]) + rng.logistic(size=n)
    grade = (score > -0.5).astype(int) + (score > 1.0)
    doc, bucket = np.nonzero(held)
    model = quality_classifier.fit(doc, bucket, grade, bits=3, rounds=4000, shrink=shrink, min_chi2=0.0)

    def tails(x):
        return 1 / (1 + np.exp(-((held @ x[:words])[:, None] - x[words:][None, :])))

    def loss(x):
        tail = np.column_stack([np.ones(n), tails(x), np.zeros(n)])
        p = tail[np.arange(n), grade] - tail[np.arange(n), grade + 1]
        return np.inf if (p <= 0).any() else -np.log(p).mean() + shrink / 2 * (x[:words] ** 2).sum()

    x, step = np.concatenate([np.zeros(words), [-1.0, 1.0]]), 4.0
    for _ in range(1500):
        slope = np.array([(loss(x + d) - loss(x - d)) / 2e-5 for d in np.eye(words + 2) * 1e-5])
        while loss(x - step * slope) > loss(x) and step > 1e-8:
            step /= 2
        x, step = x - step * slope, step * 1.5
    mine = np.concatenate([model.weights[:words], model.thresholds])
    used = model.weights[:words] != 0
    assert used.sum() >= 5 and loss(mine) <= loss(x) * 1.002
    assert np.abs(tails(mine) - tails(x)).max() < 0.03
