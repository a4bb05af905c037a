"""Substring dedup by recompression.

Rounds rename the words of a document: first runs of one word, then, again and again, pairs of neighbours of which a coin
that is the symbol's own makes the first a left one and the second a right one.  A name is a hash of what it stands for,
so all tasks give equal content the same name without a shared table.  Whether a symbol arises depends on few words
around it (its context).  Two equal windows of words therefore hold the same symbols, but for those whose context
reaches over their ends.  Of the symbols of the highest round inside a window, the one of the least hash is its sign.

Signs are brought together by a shuffle; only windows whose sign stands in two different texts are then hashed whole (95 bits
of hashes of 64-bit word hashes) and compared.  Which windows are compared depends on the signs, and never misses an equal
pair; so results are exact but for chance collisions of those hashes.

Before each shuffle a task settles what it can by itself: of a sign that it has seen in two texts only one row need meet
the other tasks, and of equal windows only those of an id smaller than all that it has seen.  So a passage that a third of
all documents hold makes a few rows per task, not a row per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_partitions, run_hashes, slices

WINDOW = 50
ROUNDS = 6
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2, _M3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than space and \\t..\\r."""
    data = np.frombuffer(raw, np.uint8)
    return mix(run_hashes(data, ~_SPACE[data])[1])


class Parse:
    """Symbols of one round over many documents at once: name, context [cs, ce) in words, document."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        at = np.arange(len(words))
        self.name, self.doc, self.cs, self.ce = words, doc, at, at + 1
        change = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else at
        sizes = np.diff(np.append(change, len(doc)))
        self.low, self.high = np.repeat(change, sizes) - 1, np.repeat(change + sizes, sizes) + 1  # beyond the document

    def _new(self, name, keep, cs, ce) -> Parse:
        out = Parse.__new__(Parse)
        out.name, out.doc, out.cs, out.ce, out.low, out.high = (x[keep] for x in (name, self.doc, cs, ce, self.low, self.high))
        return out

    def _around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is of the same document; the neighbours' contexts, beyond the document if there is none."""
        joined = np.append(self.doc[1:] == self.doc[:-1], False)
        before = np.where(np.append(False, joined[:-1]), np.append(0, self.cs[:-1]), self.low)
        after = np.where(joined, np.append(self.ce[1:], 0), self.high)
        return joined, before, after

    def runs(self) -> Parse:
        joined, before, after = self._around()
        same = joined & np.append(self.name[1:] == self.name[:-1], False)
        first = ~np.append(False, same[:-1])
        starts = np.flatnonzero(first)
        last = np.append(starts[1:], len(self.name)) - 1
        length = (last - starts + 1).astype(np.uint64)
        name, ce = self.name.copy(), self.ce.copy()
        name[starts] = np.where(length > 1, mix(self.name[starts] * _M2 + length), self.name[starts])
        ce[starts] = after[last]
        return self._new(name, first, before, ce)

    def pairs(self, k: int) -> Parse:
        joined, before, after = self._around()
        left = mix(self.name + np.uint64((2 * k + 1) * int(_M2) % 2**64)) >> np.uint64(63) == 0
        start = joined & left & np.append(~left[1:], False)
        second = np.append(False, start[:-1])
        name = np.where(start, mix(self.name * _M3 + np.append(self.name[1:], np.uint64(0)) + np.uint64(k)), self.name)
        # A lone left symbol is so because of the next one, a lone right symbol because of the one before.
        cs = np.where(left, self.cs, before)
        ce = np.where(start | left, after, self.ce)
        return self._new(name, ~second, cs, ce)


def signs(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows, and the sign of each; both depend on nothing but the window's words."""
    n = len(words)
    first = np.arange(max(0, n - window + 1))
    first = first[doc[first] == doc[first + window - 1]]
    sign = np.zeros(len(first), np.uint64)
    open_ = np.arange(len(first))
    levels = [Parse(words, doc)]
    if len(first):
        levels.append(levels[-1].runs())
        for k in range(rounds):
            levels.append(levels[-1].pairs(k))
    for level in reversed(range(len(levels))):
        if not len(open_):
            break
        p = levels[level]
        order = mix(p.name ^ np.uint64((level + 1) * int(_M2) % 2**64))
        lo = np.searchsorted(p.cs, first[open_], "left")
        hi = np.searchsorted(p.ce, first[open_] + window, "right")
        some = lo < hi
        a, b, at = lo[some], hi[some], open_[some]
        if len(at):
            # Least of a range from two overlapping ranges whose length is a power of two.
            power = np.int64(np.log2(b - a))
            table, best = order, np.empty(len(at), np.uint64)
            for k in range(int(power.max()) + 1):
                own = power == k
                best[own] = np.minimum(table[a[own]], table[b[own] - (1 << k)])
                step = 1 << k
                table = np.minimum(table, np.append(table[step:], np.full(min(step, len(table)), np.uint64(2**64 - 1))))
            sign[at] = best
        open_ = open_[~some]
    return first, sign


def window_hashes(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that start at ``first``: sums of words times powers, brought back to one place."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(words), b % 2**64, np.uint64))) for b in (base, pow(base, -1, 2**64)))
        sums = np.append(np.uint64(0), np.cumsum(words * power[:-1]))
        out.append(mix((sums[first + window] - sums[first]) * back[first]))
    return out[0].view(np.int64), (out[1] >> np.uint64(33)).astype(np.int32)


def _marks(text: str | bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _slices(batch: pa.RecordBatch, at_text: int) -> Iterator[tuple[int, list[str]]]:
    """Whole texts, some MB at a time: where the slice starts, and the texts."""
    column = batch.column(at_text)
    for at, n in slices(column, 1000, 1 << 22):
        yield at, [t or "" for t in column.slice(at, n).to_pylist()]


class _Seen:
    """What a task has met so far: a number per 64-bit key; at most ``LIMIT`` keys, after which it starts anew."""

    LIMIT = 1 << 19

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its place."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, ascending."""
        if len(self.keys) + len(keys) > self.LIMIT:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


def _stream(batches: Iterator[pa.RecordBatch], group: int, rows: int = 1 << 17, size: int = 1 << 25) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups of equal values in column ``group``."""
    held: list[pa.RecordBatch] = []
    count = total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        total += batch.nbytes
        if count >= rows or total >= size:
            table = pa.Table.from_batches(held)
            keys = table.column(group).to_numpy()
            stop = int(np.searchsorted(keys, keys[-1], "left"))
            if stop:
                yield table.slice(0, stop)
                held = table.slice(stop).combine_chunks().to_batches()
                count, total = len(keys) - stop, sum(b.nbytes for b in held)
            else:
                rows, size = 2 * rows, 2 * size
    if held:
        yield pa.Table.from_batches(held)


def _signs_of_texts(docs: DataFrame, window: int) -> DataFrame:
    """``sign, t1, known``: the distinct signs of each text, t1 standing for the text; ``known`` where the task has met the sign
    in another text.  Of each sign a task also gives one row that is not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()  # of each sign the text it was first met in
        told = _Seen()  # signs whose first text has been told
        for batch in batches:
            for _, texts in _slices(batch, 0):
                texts = list(dict.fromkeys(texts))
                own = [word_hashes(t.encode("utf-8", "surrogatepass")) for t in texts]
                use = [k for k, w in enumerate(own) if len(w) >= window]
                if not use:
                    continue
                words = np.concatenate([own[k] for k in use])
                doc = np.repeat(np.arange(len(use)), [len(own[k]) for k in use])
                first, sign = signs(words, doc, window)
                marks = np.array([_marks(texts[k])[0] for k in use], np.int64)
                sign, t1 = sign.view(np.int64), marks[doc[first]]
                order = np.lexsort((t1, sign))
                sign, t1 = sign[order], t1[order]
                new = np.append(True, (sign[1:] != sign[:-1]) | (t1[1:] != t1[:-1]))
                sign, t1 = sign[new], t1[new]
                yield from met(seen, told, sign, t1)

    def met(seen: _Seen, told: _Seen, sign: np.ndarray, t1: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.append(True, sign[1:] != sign[:-1])
        group = np.cumsum(start) - 1
        keys, head = sign[start], t1[start]
        old, at = seen.find(keys)
        leader = np.where(old, seen.values[at] if len(seen.values) else 0, head)
        again = t1 != leader[group]  # the leader's own row is told below
        shared = np.bincount(group[again], minlength=len(keys)) > 0
        tell = shared & ~told.find(keys)[0]
        told.add(keys[tell], leader[tell])
        seen.add(keys[~old], leader[~old])
        out = [(keys[~old], leader[~old], False), (sign[again], t1[again], True), (keys[tell], leader[tell], True)]
        for s, t, known in out:
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(t), pa.array(np.full(len(s), known))], names=["sign", "t1", "known"])

    return docs.select("text").mapInArrow(run, "sign long, t1 long, known boolean")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (sign, t1, known) rows sorted by the first two, those that are known or whose sign stands in two texts or more."""
    for table in _stream(batches, 0):
        sign, t1, known = (table.column(k).to_numpy() for k in range(3))
        open_ = np.flatnonzero(~known)
        s, t = sign[open_], t1[open_]
        first = np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))[: len(s)]
        open_, s = open_[first], s[first]
        same = s[1:] == s[:-1]
        keep = known.copy()
        keep[open_] = (np.append(same, False) | np.append(False, same))[: len(s)]
        yield pa.RecordBatch.from_arrays([pa.array(t1[keep]), pa.array(sign[keep])], names=["t1", "sign"])


def _packed_texts(docs: DataFrame, window: int) -> DataFrame:
    """``t1, t2, id, body``: each text of enough words, its words compressed, and the smallest id so far in the task; of copies
    those that come after a smaller id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        met: dict[tuple[int, int], int] = {}
        for batch in batches:
            for start, texts in _slices(batch, 1):
                if len(met) > _Seen.LIMIT:
                    met.clear()
                ids = batch.column(0).slice(start, len(texts)).to_pylist()
                least: dict[str, int] = {}
                for i, t in zip(ids, texts, strict=True):
                    least[t] = min(i, least.get(t, i))
                rows = []
                for t, i in least.items():
                    w = t.encode("utf-8", "surrogatepass").split()
                    if len(w) < window or met.get(mark := _marks(t), i + 1) <= i:
                        continue
                    met[mark] = i
                    rows.append((*mark, i, pack.compress(b" ".join(w))))
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], names=["t1", "t2", "id", "body"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "t1 long, t2 long, id long, body binary")


_EMPTY = {"h1": pa.int64(), "h2": pa.int32(), "id": pa.int64(), "t1": pa.int64(), "at": pa.int32(), "t2": pa.int64(), "body": pa.binary()}


def _rows(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, kind) for c, kind in _EMPTY.items()], names=list(_EMPTY))


def _joint(t1: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """One hash for a sign in a text; that two may share one only makes a window a candidate in vain."""
    return mix(sign ^ mix(t1.view(np.uint64)))


def _lost(met: _Seen, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows a smaller id has too, as far as the task has seen; the others are remembered."""
    order = np.lexsort((ids, h2, h1))
    a, b, own = h1[order], h2[order], ids[order]
    start = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    least = own[start]
    # One number for both hashes; that two windows may share it only matters for the smaller of two ids met by chance.
    keys = mix(a[start].view(np.uint64) ^ (b[start].astype(np.uint64) << np.uint64(33))).view(np.int64)
    known, at = met.find(keys)
    before = np.where(known, met.values[at] if len(met.values) else 0, least)
    out = np.empty(len(ids), bool)
    out[order] = own > np.minimum(before, least)[np.cumsum(start) - 1]
    better = known & (least < before)
    met.values[at[better]] = least[better]
    new = np.flatnonzero(~known)
    new = new[np.argsort(keys[new])]
    new = new[np.append(True, keys[new][1:] != keys[new][:-1])[: len(new)]]
    met.add(keys[new], least[new])
    return out


def _candidates(window: int):
    """From (t1, sign, t2, id, body) rows sorted by t1 and t2, signs first: the hashed windows with a shared sign (without their
    hashes where the task has met them with a smaller id), and the texts that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, met = zstandard.ZstdDecompressor(), _Seen()
        for table in _stream(batches, 0):
            t1, sign, t2 = (table.column(k).to_numpy() if table.column(k).null_count == 0 else table.column(k).fill_null(0).to_numpy() for k in range(3))
            is_text = table.column(4).is_valid().to_numpy()
            rows = np.flatnonzero(is_text)
            if not len(rows):
                continue
            flags = np.unique(_joint(t1[~is_text], sign[~is_text].view(np.uint64)))
            flagged = np.unique(t1[~is_text])
            ids = table.column(3).fill_null(0).to_numpy()
            bounds = np.flatnonzero(np.append(True, (t1[rows][1:] != t1[rows][:-1]) | (t2[rows][1:] != t2[rows][:-1])))
            least, rows = np.minimum.reduceat(ids[rows], bounds), rows[bounds]
            use = np.isin(t1[rows], flagged)
            least, rows = least[use], rows[use]
            for s in range(0, len(rows), 200):  # some hundred texts at a time
                part, owner = rows[s : s + 200], least[s : s + 200]
                packed = table.column(4).take(pa.array(part)).to_pylist()
                own = [word_hashes(unpack.decompress(x)) for x in packed]
                sizes = np.array(list(map(len, own)))
                words, doc = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
                first, found = signs(words, doc, window)
                at = doc[first]
                hit = np.isin(_joint(t1[part][at], found), flags)
                first, at = first[hit], at[hit]
                if not len(first):
                    continue
                h1, h2 = window_hashes(words, first, window)
                inside = (first - (np.cumsum(sizes) - sizes)[at]).astype(np.int32)
                lost = _lost(met, h1, h2, owner[at])
                for rows_, has in ((np.flatnonzero(lost), False), (np.flatnonzero(~lost), True)):
                    where = at[rows_]
                    hashes = {"h1": pa.array(h1[rows_]), "h2": pa.array(h2[rows_])} if has else {}
                    if len(rows_):
                        yield _rows(len(rows_), id=pa.array(owner[where]), t1=pa.array(t1[part][where]), at=pa.array(inside[rows_]), **hashes)
                some = np.unique(at)
                yield _rows(len(some), id=pa.array(owner[some]), t1=pa.array(t1[part][some]), t2=pa.array(t2[part][some]), body=pa.array([packed[k] for k in some.tolist()], pa.binary()))

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by hash, then id: those that a smaller id has too."""
    for table in _stream(batches, 0):
        h1, h2, ids = (table.column(k).to_numpy() for k in range(3))
        first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        starts = np.flatnonzero(first)
        least = np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))
        keep = pa.array(ids > least)
        got = table.select(["t1", "id", "at"]).filter(keep)
        yield from got.combine_chunks().to_batches()


def _cleaned(window: int):
    """From texts and repeated windows sorted by text: ``t1, t2, n_removed, kept_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for table in _stream(batches, 0):
            t1, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            at, t2, bodies = table.column(2), table.column(3), table.column(4)
            text = bodies.is_valid().to_numpy()
            where = at.fill_null(0).to_numpy()
            starts = np.flatnonzero(np.append(True, (t1[1:] != t1[:-1]) | (ids[1:] != ids[:-1])))
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(t1)).tolist(), strict=True):
                gone = where[a:b][~text[a:b]]
                if not len(gone):
                    continue
                for k in (a + np.flatnonzero(text[a:b])).tolist():
                    words = unpack.decompress(bodies[k].as_py()).split(b" ")
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, gone, 1)
                    np.add.at(cover, gone + window, -1)
                    kept = np.cumsum(cover[:-1]) == 0
                    rest = [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]
                    out.append((int(t1[k]), t2[k].as_py(), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3])], names=["t1", "t2", "n_removed", "kept_sha256"])

    return run


def _summaries(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, n_words, whole``: a row per row, with the digest of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch, 1):
                own = [t.encode("utf-8", "surrogatepass").split() for t in texts]
                marks = np.array([_marks(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(list(map(len, own)), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in own])], names=["doc_id", "t1", "t2", "n_words", "whole"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, t1 long, t2 long, n_words long, whole string")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.  Of
    equal texts all but those of the smallest id go whole (shorter ones than a window stay).  Null texts have no words;
    rows without an id are neither changed nor a source; rows that repeat an id do not affect each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = n_partitions(docs)
    base = cut(_summaries(docs))
    place = F.when(F.col("known"), F.xxhash64("t1")).otherwise(F.col("sign"))
    found = _signs_of_texts(docs.where("doc_id is not null"), window).repartition(n, place).sortWithinPartitions("sign", "t1")
    flags = found.mapInArrow(_shared, "t1 long, sign long").selectExpr("t1", "sign", "cast(null as long) t2", "cast(null as long) id", "cast(null as binary) body")
    texts = _packed_texts(docs, window).selectExpr("t1", "cast(null as long) sign", "t2", "id", "body")
    met = flags.union(texts).repartition(n, "t1").sortWithinPartitions("t1", "t2")
    work = cut(met.mapInArrow(_candidates(window), "h1 long, h2 int, id long, t1 long, at int, t2 long, body binary"))
    windows = work.where("h1 is not null").select("h1", "h2", "id", "t1", "at").repartition(n, "h1").sortWithinPartitions("h1", "h2", "id")
    gone = windows.mapInArrow(_repeated, "t1 long, id long, at int").selectExpr("t1", "id", "at", "cast(null as long) t2", "cast(null as binary) body")
    owners = work.where("h1 is null").selectExpr("t1", "id", "at", "t2", "body")  # and windows that are gone already
    cleaned = gone.union(owners).repartition(n, "t1").sortWithinPartitions("t1", "id").mapInArrow(_cleaned(window), "t1 long, t2 long, n_removed long, kept_sha256 string")
    texts_by_mark = base.where(F.col("doc_id").isNotNull()).groupBy("t1", "t2").agg(F.min("doc_id").alias("owner")).join(cleaned, ["t1", "t2"], "left")
    out = base.join(texts_by_mark, ["t1", "t2"], "left")
    copy = (F.col("doc_id") != F.col("owner")) & (F.col("n_words") >= window)
    own = F.col("doc_id") == F.col("owner")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(own, F.coalesce("kept_sha256", "whole")).otherwise(F.col("whole")).alias("kept_sha256"),
    )
