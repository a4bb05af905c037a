"""Locally consistent parsing against a plain reading of its rules, one text at a time."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import document_fingerprints
from ledgerloom.llm.document_fingerprints import BASE_LEVEL, DIGITS, KEPT, edited, fingerprint_documents, levels, likeness, sketches

SCHEMA = "doc_id long, text string, fingerprint string, n_chars long"
M = (1 << 64) - 1


def mixed(x):
    x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & M
    return x ^ x >> 29


def toss(before, here):
    at = 0
    while (before >> at & 1) == (here >> at & 1):
        at += 1
    return 2 * at + (here >> at & 1)


def parse(names, level):
    """Names of the next level."""
    step = 0x9E3779B97F4A7C15
    runs, k = [], 0
    while k < len(names):
        n = 1
        while k + n < len(names) and names[k + n] == names[k]:
            n += 1
        runs.append(names[k] if n == 1 else mixed((names[k] * step + n) & M) | 1 << 63)
        k += n
    lab = [toss(x, y) for x, y in zip([runs[0] ^ 1, *runs], runs, strict=False)]
    for _ in range(3):
        lab = [toss(x, y) for x, y in zip([lab[0] ^ 1, *lab], lab, strict=False)]
    assert max(lab) < 6
    for c in (3, 4, 5):
        lab = [min({0, 1, 2} - {*lab[max(0, i - 1) : i], *lab[i + 1 : i + 2]}) if x == c else x for i, x in enumerate(lab)]
    begins = [0] + [i for i in range(2, len(lab) - 1) if lab[i - 1] < lab[i] > lab[i + 1]]
    out = []
    for a, b in zip(begins, [*begins[1:], len(runs)], strict=True):
        assert b - a <= 6
        h = runs[a]
        if b - a > 1 or level == 1:
            h = mixed((h + level) * step & M)
            for x in runs[a + 1 : b]:
                h = mixed((h + x) * step & M)
        out.append(h & M >> 1)
    return out


def plain(text):
    names, level, values = [ord(c) for c in text], 0, set()
    while names:
        level += 1
        names = parse(names, level)
        if level >= BASE_LEVEL or len(names) == 1:
            values.update(names)
        if len(names) == 1:
            break
    return sorted({mixed(v * 0x9E3779B97F4A7C15 & M) >> 64 - 4 * DIGITS for v in values})[:KEPT]


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    out = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 60, 400]))) for _ in range(n)]
    return [*out, "", "a", "aa", "ab", "aaa", "aab", "a" * 999, "ab" * 500, "x" * 40_000 + "y", out[4], "\x00\U0001f600"]


def test_against_plain_parsing():
    some = texts(1)
    got = sketches(some)
    for t, (values, digits) in zip(some, got, strict=True):
        assert values == plain(t) and digits == "".join(f"{v:0{DIGITS}x}" for v in values), t[:20]
    assert [sketches([t])[0] for t in some] == got  # alone as among others


@pytest.mark.parametrize("seed", range(5))
def test_equal_substrings_have_equal_interiors(seed):
    rng = random.Random(seed)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 500))) for _ in range(2))
    both = [one + shared + two, two + one[:7] + shared]
    for (names, first), level in zip(levels(np.concatenate([np.array([ord(c) for c in t], np.uint32) for t in both]), np.array([0, len(both[0])])), range(1, 6)):
        alone = next(x for x, k in zip(levels(np.array([ord(c) for c in shared], np.uint32), np.array([0])), range(1, 6)) if k == level)[0]
        inner = alone[12:-12].tolist()  # a few names at each end may differ
        for own in (names[: first[1]].tolist(), names[first[1] :].tolist()):
            assert any(own[at : at + len(inner)] == inner for at in range(len(own)))


def brute(rows):
    known = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, a), (_, b) in zip(known, known[1:] + known[:1], strict=True):
        e = edited(a, b)
        f, g, h = plain(a), plain(e), plain(b)
        hexed = lambda x: "".join(f"{v:0{DIGITS}x}" for v in x)
        out.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), hexed(f), hexed(g), likeness(f, g), likeness(f, h)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 17, 50])
def test_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(document_fingerprints, "SLICE_BYTES", size)
    rows = [(5 * k, t, "f", 1) for k, t in enumerate(texts(2, 30)[:-1])] + [(1000, None, None, None), (None, "the last", "f", 1)]
    got = fingerprint_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_few_documents(spark):
    for rows in ([], [(1, "only one document of its kind", "f", 1)], [(1, None, None, None)], [(1, "one of two", "f", 1), (2, "", "f", 1)]):
        got = fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)
    same = [(1, "a row that stands twice, and twice", "f", 1)] * 2
    assert len({tuple(r) for r in fingerprint_documents(spark.createDataFrame(same, SCHEMA)).collect()}) == 1


def test_edited():
    assert edited("abcde", "xyz") == "abcxy" and edited("abcdef", "x") == "abcx" and edited("a", "x") == "a" and edited("", "x") == ""


def test_likeness_follows_what_is_shared():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda: " ".join(word() for _ in range(600))
    half, none, most = [], [], []
    for _ in range(40):
        a, b = text(), text()
        near = a[:1500] + b[:40] + a[1540:]
        for out, other in ((half, edited(a, b)), (none, b), (most, near)):
            out.append(likeness(*(v for v, _ in sketches([a, other]))))
    assert abs(np.mean(half) - 0.5) < 0.05 and max(none) < 0.1 and min(most) > 0.8
