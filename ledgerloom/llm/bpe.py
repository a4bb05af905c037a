"""BPE encoding and decoding by speculation: greedy longest match proposes, pair checks verify, the rest is merged.

A sequence of tokens is what merging gives exactly if each token merges back to itself and every adjacent pair does.
So a proposal costs one table look-up per pair, for all new words of a batch at once, and only words with a pair that
fails go through the merges.  The vocabulary file is a parameter; it is read by path on each executor, and never copied.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import per_text

#: Bytes of a word from which on it is merged by itself.
LONG_WORD = 512

# The vocabulary's letters and numbers are those of Unicode 16, its lower case is that of Unicode 17.  The first two
# are ranges that ``regex`` takes for letters and for numbers beyond that; LOWER holds ranges whose lower case lies so far off.
NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NO_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_class = lambda ranges: "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, *_ in ranges) + "]"
_L, _N = rf"[\p{{L}}--{_class(NO_LETTERS)}]", rf"[\p{{N}}--{_class(NO_NUMBERS)}]"
#: The splitting pattern of this vocabulary.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|[^\s{_L}{_N}]+", regex.V1)
NEW_CAPITALS = regex.compile(_class(LOWER))
_LOWER_OF = {c: c + far for a, b, far in LOWER for c in range(a, b + 1)}
#: Whitespace to Python's str.split() but not to the pattern.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: Chunks and pairs that a worker keeps at most (some 80 MB).
MAX_CACHED = 250_000
NONE = np.int64(1 << 40)
#: An odd number, so it has an inverse modulo 2**64.
POWER = 0x9E3779B97F4A7C15


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * POWER**place modulo 2**64, and the inverse powers: the difference of two sums, brought
    back to place 0, is a hash of the bytes between."""
    n = len(raw) + 1
    power, unpower = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, p % 2**64, np.uint64))) for p in (POWER, pow(POWER, -1, 2**64)))
    return np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])), unpower


def span_hashes(raw: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    sums, unpower = prefix_sums(raw)
    return (sums[starts + n] - sums[starts]) * unpower[starts]


class Vocabulary:
    """The vocabulary with its merges as sorted codes, and its tokens as hashes by length, for look-ups in bulk."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.texts = {i: t for t, i in [*ids.items(), *self.special.items()]}
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.inner_of = np.array([ids[c] for c in letters], np.int64)
        self.final_of = np.array([ids[c + self.end] for c in letters], np.int64)
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        codes = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        order = np.argsort(codes)
        self.merge_codes, self.merge_ranks = codes[order], order
        self.merge_results = np.array([c for _, _, c in merges], np.int64)
        spelled = {i: (bytes(byte_of[c] for c in (t[: -len(self.end)] if t.endswith(self.end) else t)), t.endswith(self.end)) for t, i in ids.items()}
        self.pieces = {i: np.append(self.inner_of[list(w[:-1])], (self.final_of if last else self.inner_of)[w[-1]]) for i, (w, last) in spelled.items()}
        self.by_length: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for last in (False, True):
            for n in {len(w) for w, e in spelled.values() if e == last}:
                own = [(i, w) for i, (w, e) in spelled.items() if e == last and len(w) == n]
                hashes = span_hashes(np.frombuffer(b"".join(w for _, w in own), np.uint8), np.arange(len(own)) * n, n)
                at = np.argsort(hashes)
                self.by_length[n, last] = hashes[at], np.array([i for i, _ in own], np.int64)[at]
        self.longest = max(n for n, _ in self.by_length)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.good_codes, self.good = np.empty(0, np.int64), np.empty(0, bool)
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.results: dict[int, tuple[int, int]] | None = None
        self.counts = {"proposed": 0, "failed": 0}

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; NONE where there is none."""
        at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
        return np.where(self.merge_codes[at] == codes, self.merge_ranks[at], NONE)

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once (their symbols one after another): each round merges, in every word,
        the pair of the lowest rank wherever it stands.  A merge only makes pairs of higher rank, so that is the
        same as one merge at a time."""
        done_flat, done_word = [], []
        word = np.repeat(np.arange(len(sizes)), sizes)
        while len(flat):
            rank = np.full(len(flat), NONE)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks(flat[inside] << 32 | flat[inside + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(flat))))
            over = least == NONE
            done_flat.append(flat[over])
            done_word.append(word[over])
            flat, word, hit, least = flat[~over], word[~over], (rank == least)[~over], least[~over]
            if not len(flat):
                break
            if (hit[1:] & hit[:-1]).any():  # a run of one symbol: pairs from its left end on
                start = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
                place = np.arange(len(hit))
                hit &= (place - start[np.maximum(np.searchsorted(start, place, "right") - 1, 0)]) % 2 == 0
            flat = np.where(hit, self.merge_results[least], flat)
            keep = ~np.append(False, hit[:-1])
            flat, word = flat[keep], word[keep]
        flat, word = np.concatenate([*done_flat, np.empty(0, np.int64)]), np.concatenate([*done_word, np.empty(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return flat[order], np.bincount(word, minlength=len(sizes))

    def propose(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match on the bytes of many words at once; a word's last token carries the end mark."""
        at, stop = starts.copy(), starts + sizes
        active, out_word, out_id = np.arange(len(starts)), [], []
        sums, unpower = prefix_sums(raw)
        while len(active):
            here, left = at[active], (stop - at)[active]
            token = np.full(len(active), -1, np.int64)
            step = np.zeros(len(active), np.int64)
            for n in range(min(self.longest, int(left.max())), 0, -1):
                for last in (True, False):
                    table = self.by_length.get((n, last))
                    open_ = np.flatnonzero((token < 0) & ((left == n) if last else (left > n)))
                    if table is None or not len(open_):
                        continue
                    h = (sums[here[open_] + n] - sums[here[open_]]) * unpower[here[open_]]
                    k = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
                    found = table[0][k] == h
                    token[open_[found]] = table[1][k[found]]
                    step[open_[found]] = n
            out_word.append(active)
            out_id.append(token)
            at[active] += step
            active = active[at[active] < stop[active]]
        word = np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(out_id)[order], np.bincount(word, minlength=len(starts))

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For codes ``left << 32 | right`` (right 0xFFFFFFFF: a token alone): whether the tokens, spelled out and
        merged, come back as they are.  Answers are kept."""
        at = np.searchsorted(self.good_codes, pairs)
        known = at < len(self.good_codes)
        known[known] = self.good_codes[at[known]] == pairs[known]
        if not known.all():
            new = np.unique(pairs[~known])
            spelled = [np.concatenate([self.pieces[t] for t in (c >> 32, c & 0xFFFFFFFF) if t != 0xFFFFFFFF]) for c in new.tolist()]
            flat, sizes = self.merge(np.concatenate(spelled), np.fromiter(map(len, spelled), np.int64, len(spelled)))
            first = np.cumsum(sizes) - sizes
            alone = (new & 0xFFFFFFFF) == 0xFFFFFFFF
            good = (sizes == np.where(alone, 1, 2)) & (flat[first] == new >> 32)
            good &= alone | (flat[np.minimum(first + 1, len(flat) - 1)] == new & 0xFFFFFFFF)
            codes, answers = np.append(self.good_codes, new), np.append(self.good, good)
            order = np.argsort(codes)
            self.good_codes, self.good = codes[order], answers[order]
            at = np.searchsorted(self.good_codes, pairs)
        return self.good[at]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Exact merging of one long word: the pair of the lowest rank, from the left, by a queue of pairs."""
        if self.results is None:
            self.results = dict(zip(self.merge_codes.tolist(), zip(self.merge_ranks.tolist(), self.merge_results[self.merge_ranks].tolist(), strict=True), strict=True))
        rank = self.ranks(symbols[:-1] << 32 | symbols[1:])
        at = np.flatnonzero(rank != NONE)
        queue = np.sort(rank[at] << 36 | at).tolist()  # sorted, so a heap
        here, n, results = symbols.tolist(), len(symbols), self.results
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            top = heapq.heappop(queue)
            i = top & 0xFFFFFFFFF
            j = after[i]
            if here[i] < 0 or j >= n:
                continue
            found = results.get(here[i] << 32 | here[j])
            if found is None or found[0] != top >> 36:
                continue
            here[i], here[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if new := results.get(here[i] << 32 | here[k]):
                    heapq.heappush(queue, new[0] << 36 | i)
            if (k := before[i]) >= 0 and (new := results.get(here[k] << 32 | here[i])):
                heapq.heappush(queue, new[0] << 36 | k)
        left = np.array(here, np.int64)
        return left[left >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct, not empty words one after another, and how many each has.

        In words of over ``LONG_WORD`` bytes some pair fails all but surely, and a proposal is as long as the word: they are
        merged at once.
        """
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self.encode_short(words)
        flat, sizes = self.encode_short([w for w in words if len(w) <= LONG_WORD]) if len(long) < len(words) else (np.empty(0, np.int64), np.empty(0, np.int64))
        parts, n, far = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], np.zeros(len(words), np.int64), set(long)
        short, out = iter(parts), []
        for k, w in enumerate(words):
            if k in far:
                raw = np.frombuffer(w, np.uint8)
                out.append(self.merge_long(np.append(self.inner_of[raw[:-1]], self.final_of[raw[-1]])))
            else:
                out.append(next(short))
            n[k] = len(out[-1])
        self.counts["proposed"] += len(long)
        self.counts["failed"] += len(long)
        return np.concatenate(out), n

    def encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        flat, n = self.propose(raw, starts, sizes)
        word = np.repeat(np.arange(len(words)), n)
        inside = np.flatnonzero(word[1:] == word[:-1])
        single = np.flatnonzero(n == 1)
        ok = self.compatible(np.append(flat[inside] << 32 | flat[inside + 1], flat[(np.cumsum(n) - n)[single]] << 32 | 0xFFFFFFFF))
        bad = np.zeros(len(words), bool)
        bad[word[inside[~ok[: len(inside)]]]] = True
        bad[single[~ok[len(inside) :]]] = True
        self.counts["proposed"] += len(words)
        self.counts["failed"] += int(bad.sum())
        if not bad.any():
            return flat, n
        member = np.repeat(bad, sizes)
        ends = np.zeros(len(raw), bool)
        ends[starts + sizes - 1] = True
        symbols = np.where(ends, self.final_of[raw], self.inner_of[raw])[member]
        merged, m = self.merge(symbols, sizes[bad])
        kept = ~np.repeat(bad, n)
        which = np.append(word[kept], np.repeat(np.flatnonzero(bad), m))
        order = np.argsort(which, kind="stable")
        return np.append(flat[kept], merged)[order], np.bincount(which, minlength=len(words))

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks (no whitespace inside, normalised) that are not known yet, all in one pass."""
        new = [c for c in chunks if c not in self.chunks]
        cut = [(c,) if c.isalpha() else (c[:-1], c[-1]) if c[-1] in ".,;:!?" and c[:-1].isalpha() else WORD.findall(c) for c in new]
        distinct = list(dict.fromkeys(w for ws in cut for w in ws))
        if not distinct:
            return
        flat, sizes = self.encode_words([w.encode() for w in distinct])
        packed, ends, texts = flat.astype("<u4").tobytes(), np.cumsum(sizes).tolist(), self.texts
        names, ids, at = {}, flat.tolist(), 0
        for w, end in zip(distinct, ends, strict=True):
            names[w] = packed[4 * at : 4 * end], " ".join([texts[i] for i in ids[at:end]]).encode()
            at = end
        for c, ws in zip(new, cut, strict=True):
            own = [names[w] for w in ws]
            self.chunks[c] = own[0] if len(own) == 1 else (b"".join([a for a, _ in own]), b" ".join([b for _, b in own]))

    def segments(self, text: str) -> list[tuple[bool, str]]:
        if self.special_split is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(k % 2 == 1, part) for k, part in enumerate(self.special_split.split(text)) if part]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text, its ids as little-endian 32-bit integers, and what they decode to in UTF-8."""
        cut = [[(special, part if special else self.split(part)) for special, part in self.segments(t)] for t in texts]
        if len(self.chunks) > MAX_CACHED:
            self.chunks.clear()
        if len(self.good) > MAX_CACHED:
            self.good_codes, self.good = self.good_codes[:0], self.good[:0]
        self.learn(list({c for own in cut for special, part in own if not special for c in part}))
        known = self.chunks
        out = []
        for own in cut:
            got = []
            for special, part in own:
                if special:
                    got.append((self.special[part].to_bytes(4, "little"), part.encode()))
                else:
                    got += [known[c] for c in part]
            out.append((b"".join([a for a, _ in got]), b" ".join([b for _, b in got if b])))
        return out

    def split(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not _latin(text) and NEW_CAPITALS.search(text):
            text = text.translate(_LOWER_OF)
        # Letter by letter: Python's own lower() treats a final capital sigma apart.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return WORD.findall(text) if NOT_SPACE.search(text) else text.split()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``n_tokens, ids_sha256, decoded_sha256``; with ``ids`` also ``ids`` and ``decoded``.

    Null text is empty text: no tokens, decoded to the empty string.  No shuffle; each worker keeps a bounded cache.
    """
    where = path or default_path()

    def make(texts: list[str]) -> dict:
        gc.disable()  # a cache of a million small objects, none of them in a cycle
        try:
            got = vocabulary(where).encode_batch(texts)
        finally:
            gc.enable()
        out = {
            "n_tokens": [len(a) // 4 for a, _ in got],
            "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in got],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in got],
        }
        return out | ({"ids": [a for a, _ in got], "decoded": [b.decode() for _, b in got]} if ids else {})

    return per_text(docs, [key], text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * ids, 500)
