"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import spelling_variants

SCHEMA = "doc_id long, text string, word string, form string, n long"


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(60)]
    words += ["samehead" + "".join(rng.choice(letters) for _ in range(8)) for _ in range(60)]
    words += [w[:-1] for w in words[:30]] + [w + "a" for w in words[:30]] + [w[:3] + "b" + w[4:] for w in words[:60]]
    weight = [rng.choice([1, 1, 1, 3, 40, 500]) for _ in words]
    out = []
    for k in range(120):
        t = " ".join(rng.choices(words, weight, k=rng.choice([0, 5, 400])))
        out.append((k, t.upper() if k % 9 == 0 else t, "w", "f", 1))
    out += [(300, "chainaaaaa " * 2 + "chainaaaab " * 30 + "chainaaabb " * 400 + "chainaaabbb " * 5000, "w", "f", 1)]
    out += [(None, out[3][1], "w", "f", 1), (200, None, None, None, None), (201, "", "w", "f", 1), out[5], out[5]]
    out += [(202, "ÀÉÎcontent À×÷ØÿABCDEFG naïvetéāabcdefgh abcdefgh ퟿xxabcdefgh" * 2, "w", "f", 1), (203, "z" * 40_000 + " " + "z" * 40_000, "w", "f", 1)]
    return out


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    form, near = {}, {}
    for w in count:
        near[w] = [v for v in count if abs(len(v) - len(w)) < 2 and distance_one(w, v)]
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("shard, hot, few", [(50_000, 2_000, 16), (20, 3, 2)])
def test_variants(spark, monkeypatch, shard, hot, few):
    monkeypatch.setattr(spelling_variants, "SHARD", shard)
    monkeypatch.setattr(spelling_variants, "HOT", hot)
    monkeypatch.setattr(spelling_variants, "FEW", few)
    rows = corpus(few)
    got = spelling_variants.group_variants(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 10 and any(w[2] not in (w[0], w[1]) for w in want)
    assert sorted(map(tuple, got)) == want


def test_no_words(spark):
    for rows in ([], [(1, None, "w", "f", 1)], [(1, "short words only", "w", "f", 1)]):
        assert spelling_variants.group_variants(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_hot_halves():
    """A half that all words share: what is beside it is looked up, not compared word by word."""
    rng = random.Random(3)
    words = list({"prefixes" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(3000)})
    words += ["prefixes" + w for w in ("aaaaaaaa", "aaaaaaab", "aaaaabaa") if "prefixes" + w not in words]
    shard = spelling_variants.Shard([(w, end, 0) for w in words for end in (0, 1)])
    for other in ("prefixesaaaaaaaa", "prefixesaaaaaaa", "prefixesaaaaaaaaa", "prefixeaaaaaaaa", words[5][:9] + "z" + words[5][10:], words[7][1:], "x" + words[8]):
        assert sorted(shard.words[k] for k in shard.near(other)) == sorted(w for w in words if distance_one(w, other))
