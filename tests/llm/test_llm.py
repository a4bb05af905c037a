"""Each operator against brute force on a small corpus that holds the odd cases: null and empty texts, null ids, rows that
repeat, ids that repeat with other texts, a very long text, near copies, and columns with the names of ours."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from ledgerloom.llm import bpe, decontaminate, line_templates, near_copies, quality_classifier, quality_rules, secrets, simhash, substring_dedup, token_counts, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n"]) for _ in range(k))
    shared, out = text(70), []
    for k in range(n):
        t = text(rng.choice([1, 3, 40, 120, 300]))
        if k % 6 == 0:
            t += " " + shared + " " + text(5)
        out.append([k, t])
    for k in range(n, n + 12):
        t = out[rng.randrange(n)][1].split(" ")
        t[rng.randrange(len(t))] = "changed"
        out.append([k, " ".join(t)])
    out += [[100, out[2][1]], [101, out[2][1].upper()], [102, "x " * 9000 + shared], [103, ""], [104, None], [None, out[0][1]], [None, None], [7, out[9][1]], [8, out[8][1]], [105, " \t\n"], [106, "a " * 130], [107, "a " * 75]]
    return [(i, t, "en", "s", len(t) if t else 0) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumns({"fingerprint": F.lit("mine"), "kept": F.lit(1), "n_words": F.lit("x"), "t1": F.lit(2)}).cache()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def by_pairs(docs, got, make):
    """Multisets of (id, outputs) are equal."""
    want = sorted(repr((i, *make(t or ""))) for i, t in rows_of(docs))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (simhash.near_duplicates(none), token_counts.count_tokens(none), secrets.scan_secrets(none), bpe.encode_texts(none), quality_rules.judge_quality(none), substring_dedup.drop_repeats(none), line_templates.drop_recurring_lines(none), near_copies.drop_near_copies(none), decontaminate.find_leaks(none, bench), quality_classifier.classify(none, quality_classifier.train(none, labels), ["doc_id"])):
        assert got.count() == 0


def test_urls(spark):
    urls = ["http://WWW.Foo.NET/a?b#c", "https://example.net/en/x", "http://a.example.com/de/", "http://x.org/fr/", "http://foo.net", None, "no scheme", "http://cheap-pills.example.org/x", "http://spam-farm.org/abuse-report/", "http://my-cheap-pillsx.org/", "a://b://c/d", "http://evilexample.com/de/"]
    pages = spark.createDataFrame([(k % 4, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()]
    assert got == [
        ("www.foo.net", "/a", "net/", "block"), ("example.net", "/en/x", "example.net/en/", "allow"), ("a.example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"), ("foo.net", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("cheap-pills.example.org", "/x", None, "block"), ("spam-farm.org", "/abuse-report/", None, "allow"), ("my-cheap-pillsx.org", "/", None, "allow"), ("b:", "//c/d", None, "allow"), ("evilexample.com", "/de/", None, "allow"),
    ]
    assert url_filters.PatternRule("block", "^a-b^*x*^c^").literals() == ["a", "b", "c"]


def test_many_url_rules(spark, monkeypatch):
    """Beyond what one expression holds the index is a table; held against every rule in turn."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 2)))
    rules = tuple(url_filters.PatternRule(rng.choice(["allow", "block"]), p) for p in dict.fromkeys(rng.choice(["^{}^", "^{}-{}^", "^{}*{}^", "{}{}", "^{}^*^{}^"]).format(word(), word()) for _ in range(80)))
    urls = [f"http://{word()}.{word()}.zz/{word()}/{word()}-{word()}?{word()}" for _ in range(150)] + ["http://Foo.NET/aa", None, "", "aa"] + ["http://aa.bb.zz/aa"] * 3
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")

    def plain(u):
        low = (u or "").lower()
        hit = {a: next((r.pattern for r in rules if r.action == a and re.search(r.regex(), low)), None) for a in ("allow", "block")}
        return hit["allow"] or hit["block"], "block" if hit["block"] and not hit["allow"] else "allow"

    for most in (2000, 10):
        monkeypatch.setattr(url_filters, "MAX_INLINED_RULES", most)
        got = {r.page_id: (r.matched_rule, r.verdict) for r in url_filters.filter_urls(pages, list_rules=(url_filters.ListRule("allow", "none", "/"),), pattern_rules=rules).collect()}
        assert got == {k: plain(u) for k, u in enumerate(urls)}


def test_simhash(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    rows = rows_of(docs)
    prints = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        assert got[i, f"{prints[k]:016x}"] == (min(ids) if ids else None)


def test_simhash_cells_lose_nothing():
    rng = random.Random(2)
    for groups in (7, 8):
        masks = simhash.cell_masks(groups)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            a, b = simhash.unary_counts(np.array([x, y], np.uint64))
            assert ((a & masks) == (b & masks)).any() and int(a ^ b).bit_count() <= (x ^ y).bit_count()


def test_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(4)
    base = rng.getrandbits(62)
    prints = list({base ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 5))) for _ in range(60)})
    edges = simhash._Cells(4).links(np.zeros(len(prints), np.uint64), np.array(prints, np.uint64), np.array(prints, np.int64))
    assert len(edges[0]) < len(prints) and edges[2]
    got = {(r.node, r.root) for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    root = {p: p for p in prints}
    for _ in prints:
        root = {p: min(root[q] for q in prints if (p ^ q).bit_count() <= 4) for p in prints}
    assert got == {(p, root[p]) for p in prints if any(p != q and (p ^ q).bit_count() <= 4 for q in prints)}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Two chains that meet at the top, and a shuffled path: rounds follow the logarithm of their length."""
    rounds = []
    real = simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, instead_of=None: rounds.append(1) or real(df, instead_of))
    names = list(range(2000, 2300))
    random.Random(1).shuffle(names)
    edges = [(k, k - 2) for k in range(2, 1000)] + [(999, 998)] + list(zip(names, names[1:]))
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1000), 0) | dict.fromkeys(names, 2000) and len(rounds) <= 14


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, rule):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for r in token_counts.count_tokens(docs, rule=rule).collect():
        assert 0 <= r.n_crossing <= r.n_tokens
        total.setdefault((r.doc_id, r.doc_tokens), []).append(r.n_tokens)
    for i, t in rows_of(docs):
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        assert sum(total[i, n]) % max(n, 1) == 0
    starts, lasts = token_counts.token_spans("aé日🙂 b\n\nc", token_counts.default_path())
    spans = whole.encode("aé日🙂 b\n\nc", add_special_tokens=False).offsets
    assert starts.tolist() == [a for a, _ in spans] and (lasts + 1).tolist() == [b for _, b in spans]
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, rule="none")


def encoders():
    """kind -> text to (encoded text, first and last place of each character in it), by plain loops."""

    def percent(t):
        out, at = "", []
        for c in t:
            e = "".join(f"%{b:02X}" for b in c.encode()) if not c.isalnum() or not c.isascii() else c
            at.append((len(out), len(out) + len(e)))
            out += e
        return out, at

    def unicode(t):
        out, at = "", []
        for k, c in enumerate(t):
            e = f"\\u{ord(c):04x}" if k % 2 == 0 or not c.isalnum() else c
            at.append((len(out), len(out) + len(e)))
            out += e
        return out, at

    def b64(t):
        at, n = [], 0
        for c in t:
            m = n + len(c.encode())
            at.append((n * 8 // 6, -(-m * 8 // 6)))
            n = m
        return base64.b64encode(t.encode()).decode().rstrip("="), at

    def zipped(t):
        out = base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode()
        return out, [(0, len(out))] * len(t)

    return {"percent": percent, "unicode": unicode, "b64": b64, "zipped": zipped}


@pytest.mark.parametrize("seed", range(40))
def test_secrets_in_nested_layers(seed):
    """A secret under one to three layers has the span of just those characters that it was decoded from."""
    rng = random.Random(seed)
    inner = " ".join(rng.choices(["plain", "wörter", "words", "日本", "note"], k=6))
    secret = "password=hunter22" if seed % 2 else "AKIA" + "Q7" * 9
    text, span = f"{inner} {secret} {inner}", (len(inner) + 1, len(inner) + 1 + len(secret))
    if seed % 2 and seed % 3 == 0:  # two secrets in one run have two spans
        text += " token=abcdefgh"
    kinds = encoders()
    for kind in rng.choices(list(kinds), k=rng.randint(1, 3)):
        text, at = kinds[kind](text)
        span = at[span[0]][0], at[span[1] - 1][1]
    base, every = secrets.scan(f"see {text} end")
    kind = "assign" if seed % 2 else "access"
    # What follows the key may be letters of its own in a layer of escapes: an access key's span may only start exactly.
    assert (kind, span[0] + 4, span[1] + 4) in every, (text[:200], span, every)
    assert all(4 <= a < z <= 4 + len(text) for _, a, z in set(every) - set(base))


def test_secrets(docs):
    assert secrets.scan("token: token: abcdefgh")[0] == []  # the first match fails and takes its words with it
    assert secrets.scan("API_KEY = 'abc123' ſecret=abcdefg")[0] == [("assign", 0, 17)]
    assert secrets.scan("")[1] == []

    def plain(t):
        found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        n = [sum(k == f[0] for f in found) for k in ("assign", "access", "hex")]
        return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest())

    by_pairs(docs, secrets.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), plain)


def test_secrets_in_odd_layers():
    b64 = lambda raw: base64.b64encode(raw).decode()
    escaped = lambda raw, mark: "".join(f"{mark}{x:02x}" for x in raw)
    secret, noise = "password=hunter22", " ".join(f"{k:x}z" for k in range(3000))
    zipped = gzip.compress(f"{noise} {secret} {noise}".encode(), mtime=0)
    large = gzip.compress(b"filler " * 3_000_000 + secret.encode(), mtime=0)
    wrap = lambda t, wide: "\n".join(t[k : k + wide] for k in range(0, len(t), wide))
    cases = [b64(("\ufeff" + secret).encode()), b64(f"a\xa0\u3000\u200b {secret}\0".encode()), b64(secret.encode("utf-16")), "caf%E9/password%3Dhunter22", b64(f"caf\xe9 {secret}".encode("latin-1"))]
    cases += [escaped(gzip.compress(secret.encode(), mtime=0), mark) for mark in ("%", "\\x")] + [wrap(b64(zipped), wide) for wide in (64, 76)] + [wrap(b64(f"{'x ' * 21}{secret} and more words".encode()), 64), b64(large)]
    for t in cases:
        base, every = secrets.scan(f"see {t} end")
        assert any(kind == "assign" and 4 <= a and z <= 4 + len(t) for kind, a, z in set(every) - set(base)), t[:60]
    assert secrets.scan(f"see {b64(bytes(range(128, 256)) * 4)} end") == ([], [])
    # Beyond what a worker takes up at once, in either place; members that follow one another; a layer that decodes to itself.
    far = gzip.compress(secret.encode() + b" filler" * 3_000_000, mtime=0) + gzip.compress(b" token = abcdefgh", mtime=0)
    assert {k for k, _, _ in secrets.scan(f"see {b64(far)} end")[1]} == {"assign"} and len(secrets.base_spans(secret)) == 1
    two = secrets.scan("see a%20password%3Dhunter22%20token%3Dabcdefgh%21 end")[1]
    assert two == [("assign", 8, 27), ("assign", 30, 46)]
    assert secrets.scan("a%20b&token=abcdefgh%21")[1] == [("assign", 6, 20)]


def test_bpe(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path())

    def plain(t):
        e = whole.encode(t, add_special_tokens=False)
        return len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()

    by_pairs(docs, bpe.encode_texts(docs), plain)
    # Letters of every age between two letters: the tables of characters are the library's.
    every = [f"a{chr(c)}b {chr(c)}1" for c in range(0x80, 0x30000, 7) if not 0xD800 <= c < 0xE000] + [f"a{chr(c)}b" for c in (0x558, 0x1C89, 0x1C8A, 0xA7CB, 0x10D40, 0x2FFFF)]
    for t, (ids, _) in zip(every, bpe.vocabulary(bpe.default_path()).encode_batch(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    odd = ["Hi<|endoftext|>World’s Καλημέρας ΟΔΟΣ é x", "İst a\x1cb \x85 z ", "don't!!!'s <|startoftext|>", "日本語🙂½Ⅷ", "a" * 900 + "b " + "xyz!" * 80, "aaa aaaa aaaaa"]
    for t, (ids, text) in zip(odd, bpe.vocabulary(bpe.default_path()).encode_batch(odd), strict=True):
        e = whole.encode(t, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids and text.decode() == whole.decode(e.ids, skip_special_tokens=False)


def test_quality_rules(docs):
    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 400 else set(range(len(words)))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed

    few = docs.where("length(text) < 5000 or text is null")
    by_pairs(few, quality_rules.judge_quality(few).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), plain)
    assert not quality_rules.compression(b"ab " * 3000)[2] and quality_rules.compression(b"")[2]
    assert not quality_rules.compression(np.random.default_rng(1).bytes(9000))[2]


def test_kept_by_bands(docs):
    """``kept`` from the limits themselves, chunk by chunk."""
    import zstandard

    def plain(t):
        raw = t.encode()
        size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / max(1, len(x))
        band = max((b for b in quality_rules.DOCUMENT_BANDS if b.least <= len(raw)), key=lambda b: b.least)
        at, bad, n = 0, 0, 0
        while len(raw) >= 2048 and at < len(raw):
            n += 1
            bad += not quality_rules.CHUNK_LOW <= size(raw[at : at + 2048] if at + 2048 <= len(raw) else raw[-2048:]) <= quality_rules.CHUNK_HIGH
            at += 2048
        return not raw or (band.low <= size(raw) <= band.high and 2 * bad <= n)

    noise = " ".join("".join(random.Random(k).choices("ABCDEFGHJKabcdefghjk0123456789+/", k=12)) for k in range(170))
    texts = [t or "" for _, t in rows_of(docs)] + ["ab " * 800, noise, " ".join(f"w{k * k % 997}" for k in range(300)) + noise, "x" * 2048, "y " * 1024 + noise[:100]]
    for t in texts:
        assert quality_rules.compression(t.encode())[2] == plain(t), t[:80]
    prose = " ".join(w for k in range(30) for w in (texts[k] or "a").split())[:2048]
    # What follows the last whole chunk is judged too.
    assert quality_rules.compression((prose + noise[:2000]).encode())[1] >= 0.5


@pytest.mark.parametrize("size", [300, 450, 600, 900, 1200, 1800, 3000, 9000, 40000])
def test_incompressible_words(size):
    rng = random.Random(size)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_words = lambda chars, wide: " ".join("".join(rng.choices(chars, k=wide)) for _ in range(size)).encode()[:size]
    assert not quality_rules.compression(random_words(letters, 12))[2]
    assert not quality_rules.compression(random_words([chr(c) for c in range(0x4E00, 0x9FA0)], 8))[2]
    assert size < 1024 or not quality_rules.compression(random_words(letters[26:62], 8))[2]
    assert size < 32768 or not quality_rules.compression(random_words("0123456789abcdef", 8))[2]
    prose = [w for t in corpus(n=20) for w in (t[1] or "").split() if len(w) < 12]
    assert quality_rules.compression(" ".join(rng.choices(prose[:300], k=size)).encode()[:size])[2]


def test_substring_dedup(docs):
    seen = {}
    for i, t in rows_of(docs):
        w = (t or "").split()
        for k in range(len(w) - 49) if i is not None else ():
            seen[tuple(w[k : k + 50])] = min(i, seen.get(tuple(w[k : k + 50]), i))

    want = []
    for i, t in rows_of(docs):
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 49) if i is not None else ():
            if seen[tuple(x.decode() for x in w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want.append(repr((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())))
    assert sorted(repr(tuple(r)) for r in substring_dedup.drop_repeats(docs).collect()) == sorted(want)


def test_substring_dedup_of_long_words(spark):
    """Words of over 64 bytes that hold the same letters in other places are other words."""
    a, b = "a" + 63 * "x" + "b", "b" + 63 * "x" + "a"
    rows = [(1, " ".join(f"w{k}" for k in range(25)) + f" {a} " + " ".join(f"w{k}" for k in range(25, 60))), (2, " ".join(f"w{k}" for k in range(25)) + f" {b} " + " ".join(f"w{k}" for k in range(25, 60)))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}
    long = " ".join(f"{'y' * 70}{k}" for k in range(60))
    rows = [(k, f"own{k} {long} end{k}") for k in range(1, 4)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 60, 3: 60}


def test_lines(spark, docs):
    rows = [(k, f"Contact us at number {k} today\nown {'x' * k}- line of {'y' * k}- document {'z' * k}-\nsent by {'x' * k}- to {'y' * k}- yesterday\nAll rights reserved by us", "en", "s", 9) for k in range(20)]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, SCHEMA))
    a = line_templates.drop_recurring_lines(more).collect()
    assert [r.n_dropped for r in a if r.text and "- line of" in r.text] and sorted(map(repr, a)) == sorted(map(repr, line_templates.drop_recurring_lines(more, max_sent=0).collect()))
    kept = [r.text for r in a if r.text and "- line of" in r.text]
    assert len(kept) == 20 and all(sum(w in t for t in kept) == 1 for w in ("rights", "Contact", "sent by"))
    assert sum(r.text is None for r in a) == 2


def plain_line_dedup(rows, min_docs=12):
    """Kept lines by the docstrings, with dictionaries of whole lines, leaves, places and templates."""
    any_ = "<*>"
    variable = lambda t: re.search(r"[0-9]|@|://|^www\.", t) is not None
    parsed = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        own = []
        for x in lines:
            tokens = re.findall(r"[^\x20\x09-\x0D]+", x)
            masked = tuple(any_ if variable(w) else w for w in tokens)
            n, fixed = len(tokens), sum(w != any_ for w in masked)
            tree, long = n >= 3 and fixed >= 0.6 * n, n >= 8
            keys = [("=", tuple(tokens), 2 if long else min_docs)] if n and (long or not tree) else []
            keys += [("m", masked, 3 if long else min_docs)] if tree and (not long or fixed < n) else []
            leaves = [("l", n, masked[0], masked[1]), ("t", n, masked[-1], masked[-2])] if tree else []
            own.append((masked, keys, leaves))
        parsed.append((i, own))
    held, first = {}, {}

    def count(i, keys):
        for k in set(keys):
            held[k] = held.get(k, 0) + 1
            if i is not None:
                first[k] = min(i, first.get(k, i))

    for i, own in parsed:
        count(i, [k for _, keys, leaves in own for k in keys + leaves])
    enough = lambda k: held[k] >= min(k[2], min_docs)
    asked = lambda leaf: max(min_docs, -(-held[leaf] // 10))
    left = {(r, x): [leaf for leaf in leaves if held[leaf] >= min_docs] for r, (_, own) in enumerate(parsed) for x, (_, _, leaves) in enumerate(own)}
    for r, (i, own) in enumerate(parsed):
        count(i, [(leaf, k, w) for x, (masked, _, _) in enumerate(own) for leaf in left.get((r, x), ()) for k, w in enumerate(masked)])
    opened = {}
    for (r, x), leaves in left.items():
        masked = parsed[r][1][x][0]
        for leaf in leaves:
            shape = tuple(w if w != any_ and held[leaf, k, w] >= asked(leaf) else any_ for k, w in enumerate(masked))
            if sum(w != any_ for w in shape) >= 0.6 * len(shape):
                opened.setdefault((r, x), []).append((leaf, shape))
    for r, (i, own) in enumerate(parsed):
        count(i, [k for x in range(len(own)) for k in opened.get((r, x), ())])
    out = []
    for r, ((i, t), (_, own)) in enumerate(zip(rows, parsed, strict=True)):
        keep = []
        for x, line in enumerate(t.split("\n") if t is not None else ()):
            hits = [k for k in own[x][1] if enough(k)] + [k for k in opened.get((r, x), ()) if held[k] >= asked(k[0])]
            if not any(k in first and (i is None or first[k] < i) for k in hits):
                keep.append(line)
        out.append((i, None if t is None else "\n".join(keep), len(own), len(own) - len(keep)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "at"]
    name = lambda: rng.choice(["ann", "bob", "cyd"]) + "".join(rng.choices("xyz", k=4))
    shapes = ["Posted by {} in news", "{} wrote this note", "seen {} and {} on the road to the old town by night", "Call 555-{} now or never", "Read more", "page 7 of 9 {}", "mail me@{} x", "see www.{} or http://{}"]
    rows = []
    for k in range(160):
        lines = [rng.choice(shapes).replace("{}", "%s") for _ in range(rng.randint(0, 5))]
        lines = [x % tuple(name() for _ in range(x.count("%s"))) for x in lines] + [" ".join(rng.choices(words, k=rng.choice([1, 3, 4, 9]))) for _ in range(rng.randint(0, 4))]
        rng.shuffle(lines)
        rows.append((rng.choice([k, k, k, k // 2, None]) if k > 20 else k, rng.choice(["\n", "\r\n"]).join(lines)))
    rows += [(500, None), (None, None), (501, ""), rows[30], (None, "only those without an id\nRead more")] + [(None, "only those without an id")] * 14
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(repr, plain_line_dedup(rows)))
    assert sum(r[3] for r in plain_line_dedup(rows)) > 200
    for sent in (line_templates.MAX_SENT, 0):
        assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in line_templates.drop_recurring_lines(docs, max_sent=sent).collect()) == want


def test_long_lines_that_few_share(spark):
    passage = "the committee shall meet once every quarter in the town hall"
    dated = "this notice of {} replaces all earlier notices of our house"
    rows = [(k, f"own words {'x' * k}\n{passage}" if k in (1, 4) else f"own words {'x' * k}\nonly five words are shared\n{dated.format(2000 + k)}") for k in range(5)]
    rows.append((5, "one of 1 2 3 4 5 6 7 8\n" + passage))
    rows.append((6, "one of 1 2 3 4 5 6 7 8\n" + passage))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sent in (line_templates.MAX_SENT, 0):
        got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_recurring_lines(docs, max_sent=sent).collect()}
        assert [k for k in got if passage in got[k]] == [1] and [k for k in got if any("notice" in x for x in got[k])] == [0]
        assert got[5] == ["one of 1 2 3 4 5 6 7 8"] and got[6] == [""]
        assert all("only five words are shared" in got[k] for k in (0, 2, 3)) and all(f"own words {'x' * k}" in got[k] for k in range(5))


def test_many_whole_lines_are_joined_without_tokens(spark, monkeypatch):
    """Whole lines beyond the limit no longer drag the tokens of every line through joins; few leaves are sent all the same."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared = [" ".join(word() for _ in range(9)) for _ in range(120)]
    rows = [(k if k % 40 else None, f"own {word()}\n{shared[k % 120]}\nPosted by {word()} in news\n\n{shared[k * 7 % 120]}") for k in range(1, 260)]
    docs = spark.createDataFrame([*rows, rows[30], (9, None), (None, "")], "doc_id long, text string").repartition(3)
    keep = lambda sent: sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in line_templates.drop_recurring_lines(docs, max_sent=sent).collect())
    want = keep(line_templates.MAX_SENT)
    monkeypatch.setattr(line_templates, "_drop_by_join", None)
    assert keep(60) == want


def test_tables_beyond_the_limit_are_joined_without_tokens(spark, monkeypatch):
    """Whichever table is too large to be sent, the stages hold less than the texts, and the result is the same; also if all keys pass the bits."""
    import os

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    own = lambda: [f"It is {' '.join(word() for _ in range(8))}" for _ in range(25)]
    shared = [f"the {word()} was {word()} by" for _ in range(9)]
    rows = [(k if k % 40 else None, "\n".join([*own(), f"Posted by {word()} in news", f"{shared[k % 9]} {word()} in the end", "Read more", "", shared[k % 7]])) for k in range(1, 300)]
    rows += [rows[30], (9, None), (None, ""), (500, rows[50][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes, real = [], line_templates.cut

    def cut(df):
        out = real(df)
        at = out._cut_path.removeprefix("file://")
        sizes.append((sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.endswith(".parquet")), out.count()))
        return out

    monkeypatch.setattr(line_templates, "cut", cut)

    def keep(sent):
        sizes.clear()
        return sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in line_templates.drop_recurring_lines(docs, max_sent=sent).collect())

    want = keep(line_templates.MAX_SENT)
    cells, opened = sizes[1][1], sizes[2][1]
    assert cells > opened > 9 and sum("Posted" in r for r in want) < 20
    limit = sum(len(t or "") for _, t in rows) / 2
    for sent in (0, opened - 1, cells - 1):
        assert keep(sent) == want and sum(n for n, _ in sizes) < limit
    monkeypatch.setattr(line_templates, "MAX_WORDS", 1)
    assert keep(0) == want


def test_short_variable_and_opened_lines(spark):
    names = ["".join(random.Random(k).choice("abcdefgh") for _ in range(9)) for k in range(12)]
    lines = ["Read more", "Tel: 555-1234 Fax: 555-9876", "Posted by {} in news", "the meeting was opened by our dear friend {} who then read the report aloud"]
    docs = spark.createDataFrame([(k, "\n".join([f"own{k}", "", *lines]).replace("{}", names[k])) for k in range(12)], "doc_id long, text string")
    for sent in (line_templates.MAX_SENT, 0):
        got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_recurring_lines(docs, max_sent=sent).collect()}
        assert len(got[0]) == 6 and all(got[k] == [f"own{k}", ""] for k in range(1, 12))


@pytest.mark.parametrize("block", [near_copies.BLOCK, 3])
def test_near_copies(docs, block, monkeypatch):
    """Also with groups far larger than a block, and with tables too large to be sent."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    if block == 3:
        rng = random.Random(6)
        body = [f"w{rng.randrange(900)}" for _ in range(150)]
        chain = lambda k: " ".join(f"c{j}{k // 40}" if j < k % 40 * 2 else w for j, w in enumerate(body))
        more = [(1000 + k, chain(k), "en", "s", 1, "mine", 1, "x", 2) for k in range(60)] + [(1100 + k, " ".join(w if rng.random() > 0.01 else "other" for w in body[::-1]), "en", "s", 1, "mine", 1, "x", 2) for k in range(25)]
        docs = docs.union(docs.sparkSession.createDataFrame(more, docs.schema))
        monkeypatch.setattr(near_copies, "MAX_SENT", 0)
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    words = [simhash.lower_words(t) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for _ in range(40):
        group = [min(group[j] for j in range(len(rows)) if words[i] == words[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))) for i in range(len(rows))]
    assert sorted(repr(r.doc_id) for r in got.collect()) == sorted(repr(rows[g][0]) for g in set(group))


def test_decontamination(spark, docs):
    rng = random.Random(9)
    items = [" ".join("".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(15, 40))) for _ in range(30)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(98, None), (99, "two words")], "item_id long, text string")
    changed = [w if k % 6 else "other" for k, w in enumerate(items[3].split())]
    planted = [(200, "start of it " * 9 + items[1].upper() + " the end " * 30), (201, "before this " * 7 + " ".join(changed) + " after"), (202, items[2] + " and " + items[4])]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    for most in (5000, 10):
        got = {r.doc_id: (r.n_leaks, set(r["items"].split(","))) for r in decontaminate.find_leaks(more, bench, max_items=most).collect() if r.n_leaks}
        assert got == {200: (1, {"1"}), 201: (1, {"3"}), 202: (2, {"2", "4"})}
    assert decontaminate.lcs([1, 2, 3, 4], [2, 9, 4, 1]) == 2


def test_decontamination_of_large_benchmarks(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(8000)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [text(rng.randint(15, 59)) for _ in range(3000)] + [text(1000)]
    docs = spark.createDataFrame([(k, f"{text(20)} {items[7 * k]} {text(25)}") for k in range(300)] + [(300, f"{text(90)} {items[-1]} {text(40)}"), (301, text(900))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {k: str(7 * k) for k in range(300)} | {300: "3000", 301: ""}


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.1, 1.0), (0.2, 0.97), (0.3, 0.9)])
def test_recall_of_changed_passages(spark, share, least):
    """Passages of real length inside other text, with a share of their words replaced at random; other texts stay clean."""
    rng = random.Random(int(share * 10))
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    weight = [1 / (k + 5) for k in range(3000)]
    text = lambda k: rng.choices(vocabulary, weight, k=k)
    items = [text(rng.randint(20, 60)) for _ in range(120)]
    planted = [[w if rng.random() >= share else rng.choices(vocabulary, weight)[0] for w in item] for item in items]
    docs = [(k, " ".join([*text(rng.randint(0, 90)), *p, *text(rng.randint(0, 90))])) for k, p in enumerate(planted)] + [(1000 + k, " ".join(text(rng.randint(50, 400)))) for k in range(300)]
    got = {r.doc_id: r["items"].split(",") for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")).collect()}
    assert np.mean([str(k) in got[k] for k in range(120)]) >= least
    assert sum(got[1000 + k] != [""] for k in range(300)) == 0


def test_classifier(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(1200):
        words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(60)]
        grade = k % 3
        if grade == 0:
            words[rng.randrange(60)] = rng.choice(["badword", "worseword"])
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, int(grade == 2), int(grade == 0)))
    rows += [(None, None, "en", "s", 0), (5000, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = quality_classifier.train(docs.where("doc_id < 900"), spark.createDataFrame(labels + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in quality_classifier.classify(docs, model, ["doc_id"]).collect()}
    right = [got[k].kept == (k % 3 == 2) for k in range(900, 1200)]
    assert np.mean(right) > 0.97 and len(got) == 1202
    assert all(got[k].p_poor_or_better >= got[k].p_good for k in range(1200))
