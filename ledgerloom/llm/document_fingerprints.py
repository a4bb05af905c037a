"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points.  At each level runs of one name become one name; then deterministic
coin tossing gives each name a small label by the lowest bit in which it differs from the name before, again and again until
six labels are left, and three after recolouring.  Phrases begin at local maxima of the labels, so they hold two to six
names, and where they begin depends only on a few names around.  Each phrase is named by a hash of its names, and the names
are the sequence of the next level.  Equal substrings so have equal names, but near their ends, wherever they stand.

A fingerprint is the smallest hashes of the names of all phrases from ``BASE_LEVEL`` up (of shorter texts, of their highest
level); the likeness of two is the share of names that they have in common, as the smallest of both show it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, slices

#: Names from this level on (phrases of some fifteen code points, and longer) are in the fingerprint.
BASE_LEVEL = 3
#: Hashes in a fingerprint, and hexadecimal digits of each.
KEPT, DIGITS = 64, 12

#: Bytes of text parsed at once, so that arrays stay near the processor; a longer text by itself.
SLICE_BYTES = 1 << 17

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def _toss(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Twice the lowest bit that differs, and that bit's value."""
    differs = before ^ here
    at = np.bitwise_count((differs & (~differs + differs.dtype.type(1))) - differs.dtype.type(1))
    return (at << 1 | (here >> at.astype(here.dtype)).astype(np.uint8) & 1).astype(np.uint8)


def _table() -> np.ndarray:
    """Coin tossing for labels below 128, by the label before and here."""
    before, here = np.meshgrid(np.arange(128, dtype=np.uint8), np.arange(128, dtype=np.uint8), indexing="ij")
    out = _toss(before, here)
    out[before == here] = 0
    return out.reshape(-1)


def _free() -> np.ndarray:
    """The smallest of three labels that neither neighbour has."""
    return np.array([min({0, 1, 2} - {a, b}) for a in range(8) for b in range(8)], np.uint8)


_TOSSED, _FREE = _table(), _free()


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A label of 0, 1, 2 per name, different from its neighbours' within a text; no two neighbours have one name.

    ``first`` are the places where texts begin.  The name before a text is taken to differ from its first in the lowest bit.
    """
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = names[first] ^ names.dtype.type(1)
    out = _toss(before, names)
    for _ in range(3):
        pair = np.empty(len(out), np.uint16)
        pair[1:] = out[:-1]
        pair[first] = out[first] ^ 1
        out = _TOSSED[(pair << np.uint16(7)) | out]
    # Labels are below 6 now; 7 stands for no neighbour.
    edge = np.zeros(len(out) + 1, bool)
    edge[first] = edge[-1] = True
    padded = np.full(len(out) + 2, 7, np.uint8)
    padded[1:-1] = out
    for label in (3, 4, 5):
        at = np.flatnonzero(padded[1:-1] == label)
        left, right = padded[at], padded[at + 2]
        left[edge[at]] = 7
        right[edge[at + 1]] = 7
        padded[at + 1] = _FREE[left << 3 | right]
    return padded[1:-1]


def phrases(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at texts' beginnings and at local maxima, but for a text's second and last name."""
    lab = labels(names, first)
    begins = np.zeros(len(names), bool)
    begins[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    begins[first[1:] - 1] = False
    begins[np.minimum(first + 1, len(names) - 1)] = False
    begins[first] = True
    return np.flatnonzero(begins)


def levels(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``names, first`` of each level from 1 up, for code points of many texts (none of them empty) one after another.

    A text that has become one name keeps it.  Ends when all have.
    """
    names, level = codes, 0
    while True:
        level += 1
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        new[first] = True
        starts = np.flatnonzero(new)
        if len(starts) < len(names):
            times = np.diff(starts, append=len(names))
            names = names[starts].astype(np.uint64)
            first = np.searchsorted(starts, first)
            many = np.flatnonzero(times > 1)
            names[many] = _mixed(names[many] * _STEP + times[many].astype(np.uint64)) | np.uint64(1 << 63)
        starts = phrases(names, first)
        size = np.diff(starts, append=len(names))
        named = names[starts].astype(np.uint64)
        inner = np.flatnonzero(size > 1) if level > 1 else np.arange(len(starts))
        named[inner] = _mixed((named[inner] + np.uint64(level)) * _STEP)
        for place in range(1, int(size.max())):
            inner = inner[size[inner] > place]
            named[inner] = _mixed((named[inner] + names[starts[inner] + place]) * _STEP)
        named &= np.uint64((1 << 63) - 1)
        names, first = named, np.searchsorted(starts, first)
        yield names, first
        if len(names) == len(first):
            return


def sketches(texts: list[str]) -> list[tuple[list[int], str]]:
    """The ``KEPT`` smallest distinct hashes of each text's phrase names, ascending, and the same as digits; none for an empty text."""
    out: list[tuple[list[int], str]] = [([], "")] * len(texts)
    held = [k for k, t in enumerate(texts) if t]
    if not held:
        return out
    raw = [np.frombuffer(texts[k].encode("utf-32-le", "surrogatepass"), np.uint32) for k in held]
    sizes = np.array([len(r) for r in raw])
    values, owners, growing = [], [], np.ones(len(held), bool)
    for level, (names, first) in enumerate(levels(np.concatenate(raw), np.cumsum(sizes) - sizes), 1):
        count = np.diff(np.append(first, len(names)))
        done = growing & (count == 1)
        taken = growing if level >= BASE_LEVEL else done
        owner = np.repeat(np.arange(len(held)), count)
        take = taken[owner]
        values.append(names[take])
        owners.append(owner[take])
        growing = growing & ~done
    value = _mixed(np.concatenate(values) * _STEP) >> np.uint64(64 - 4 * DIGITS)
    owner = np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    digits = np.ascontiguousarray(value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :])
    at = np.searchsorted(owner, np.arange(len(held) + 1)).tolist()
    for k, a, b in zip(held, at, at[1:], strict=False):
        b = min(b, a + KEPT)
        out[k] = value[a:b].tolist(), digits[a:b].tobytes().hex()
    return out


def likeness(a: list[int], b: list[int]) -> float:
    """Share of names in common (twice the common ones of those of both), estimated from the smallest hashes; 1 for two empty texts."""
    if a == b:
        return 1.0
    x, y = set(a), set(b)
    both = x | y
    if len(a) == KEPT or len(b) == KEPT:
        both = set(sorted(both)[:KEPT])
    jaccard = len(both & x & y) / len(both)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """``text``, its last half replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _starts(keys: DataFrame, n: int) -> list:
    """The largest key of each of ``n`` stretches of keys of about one size, descending; null keys belong to the last."""
    ranged = keys.repartitionByRange(n, F.col("__key").desc_nulls_last()).groupBy(F.spark_partition_id().alias("part")).agg(F.max("__key").alias("first"))
    # A key per task.
    return sorted((r["first"] for r in ranged.collect() if r["first"] is not None), reverse=True)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is that with the next smaller key (of equal keys the one with the larger hash of its text first; null
    keys last); after the last comes the first; a lone document is its own next.  Null texts are empty; an empty text has an
    empty fingerprint, like no other but itself.  Other columns are not read.

    Keys alone are sorted first, to cut them into stretches; then texts go to the stretch of their key, and the first text
    of each also to the stretch before.  A task walks down its stretch and holds a document and the one before.
    """
    kind = docs.schema[key].dataType.simpleString()
    known = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    n = n_partitions(docs)
    starts = _starts(known.select("__key"), n)
    rising, parts = starts[::-1], max(len(starts), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {k: (part - 1) % parts for part, k in enumerate(starts)} or {None: 0}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            part = [parts - 1 if k is None or not starts else max(0, len(starts) - 1 - bisect_left(rising, k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array([False] * len(part))], names=[*batch.schema.names, "__part", "__after"])
            if ends := [k for k, x in enumerate(keys) if x in first]:
                rows = batch.take(pa.array(ends))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([first[keys[k]] for k in ends], pa.int32()), pa.array([True] * len(ends))], names=[*batch.schema.names, "__part", "__after"])

    tied = known.withColumn("__tie", F.xxhash64("__text")).select("__key", "__tie", "__text")
    placed = tied.mapInArrow(place, f"__key {kind}, __tie long, __text string, __part int, __after boolean")
    dealt = placed.repartitionById(n, "__part").sortWithinPartitions("__part", "__after", F.col("__key").desc_nulls_last(), F.col("__tie").desc())
    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["__key", *(c.strip().split(" ")[0] for c in columns.split(","))]

    def rows(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """All but the last of ``texts``, each with the one after."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        made = sketches([*texts, *changed])
        own, new = made[: len(texts)], made[len(texts) :]
        shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        arrays = [
            keys, pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(shas, pa.string()), pa.array([s for _, s in own[:-1]], pa.string()), pa.array([s for _, s in new], pa.string()),
            pa.array([likeness(a, b) for (a, _), (b, _) in zip(own, new, strict=False)], pa.float64()), pa.array([likeness(a, b) for (a, _), (b, _) in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[pa.Array, str]] = []  # the document whose next is still to come
        closed = False
        for batch in batches:
            after = batch.column(4).to_numpy(zero_copy_only=False)
            own = batch.slice(0, int(np.searchsorted(after, True)))
            for at, count in slices(own.column(2), 500, SLICE_BYTES):
                keys, texts = own.column(0).slice(at, count), own.column(2).slice(at, count).to_pylist()
                if last:
                    keys, texts = pa.concat_arrays([last[0][0], keys]), [last[0][1], *texts]
                if len(texts) > 1:
                    yield rows(keys.slice(0, len(texts) - 1), texts)
                last = [(keys.slice(len(texts) - 1, 1), texts[-1])]
            if own.num_rows < batch.num_rows and not closed:
                closed = True
                yield rows(last[0][0], [last[0][1], batch.column(2)[own.num_rows].as_py()])
        pa.default_memory_pool().release_unused()

    return dealt.mapInArrow(walk, f"__key {kind}, {columns}").withColumnRenamed("__key", key)
