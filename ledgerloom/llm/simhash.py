"""SimHash near-dedup by segment popcounts.

A fingerprint is cut into segments of two bits, and each segment is mapped to its bit count.  The Manhattan distance of
two count vectors never exceeds the Hamming distance of the fingerprints.  The vectors are laid on a grid of ``GROUPS``
blocks of segments: within distance ``d`` at most ``d`` blocks differ, so the two share a cell of some choice of
``GROUPS - d`` blocks.  Rows that share a cell are held against the Manhattan bound, then against the fingerprints.

Written in unary (00, 01, 11 for 0, 1, 2), the count vector fits into 64 bits, and the Manhattan distance of two vectors
is the number of bits in which the unary forms differ.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, n_partitions, per_text

MAX_BITS = 4
GROUPS = 8
#: Rows of one cell that one task holds against each other; larger cells are dealt out as pairs of blocks.
BLOCK = 4096
#: In cells up to this size every link is written, in larger ones a spanning forest of the links.
SMALL = 6

_ODD = np.uint64(0x55_55_55_55_55_55_55_55)


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Repeats included; the whole sequence where there are fewer words; none without words."""
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes (rows; a column per view) have, as one fingerprint per column."""
    n, views = hashes.shape
    bits = np.unpackbits(np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8), axis=1)
    ones = bits.sum(0, dtype=np.int64)
    return np.packbits((2 * ones > n).reshape(views, 64), axis=1).view(">u8")[:, 0].astype(np.uint64)


def fingerprint(text: str | None, size: int = 4) -> int:
    from xxhash import xxh64_intdigest

    got = shingles(lower_words(text), size)
    if not got:
        return 0
    return int(majority(np.array([xxh64_intdigest(s, 42) for s in got], np.uint64)[:, None])[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", size: int = 4) -> DataFrame:
    """``keys`` and ``fp`` (the 64 bits as a signed long), one row per row; null text: no words, fingerprint 0."""

    def make(texts: list[str]) -> dict:
        return {"fp": pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))}

    return per_text(docs, keys, text, make, "fp long")


def unary_counts(fp: np.ndarray) -> np.ndarray:
    one = (fp | fp >> np.uint64(1)) & _ODD
    two = (fp & fp >> np.uint64(1)) & _ODD
    return one | two << np.uint64(1)


def cell_masks(groups: int = GROUPS, max_bits: int = MAX_BITS) -> np.ndarray:
    """The choices of ``groups - max_bits`` blocks, each as a mask over the unary form."""
    edges = [round(32 * k / groups) * 2 for k in range(groups + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return np.array([sum(blocks[k] for k in chosen) for chosen in combinations(range(groups), groups - max_bits)], np.uint64)


def _forest(fp: np.ndarray, near) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among rows: positions from and to.

    Breadth first, from the first row on: rows that stand together in many cells, sorted alike, get the same links in
    all of them, so that what is left after repeats are dropped follows the rows and not the cells.
    """
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        queue, rest = deque([rest[0]]), rest[1:]
        while queue and len(rest):
            at = queue.popleft()
            hit = near(at, rest)
            if hit.any():
                found = rest[hit]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found.tolist())
                rest = rest[~hit]
    return a, b


class _Cells:
    """Links within the cells of (cell, fingerprint, node) rows sorted by cell, then node, a stretch of whole cells at a time."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits

    def near(self, x, y):
        near = np.bitwise_count(unary_counts(x) ^ unary_counts(y)) <= self.max_bits
        return near & (np.bitwise_count(x ^ y) <= self.max_bits)

    def links(self, cell: np.ndarray, fp: np.ndarray, node: np.ndarray):
        """Pairs of linked nodes, and where the pairs of blocks stand of cells too large for one task."""
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(first, len(cell)))
        a, b, pairs = [], [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, SMALL):
            i = np.flatnonzero(small[:-d] & (cell[d:] == cell[:-d])) if d < len(cell) else np.empty(0, np.int64)
            i = i[self.near(fp[i], fp[i + d])]
            a.append(node[i])
            b.append(node[i + d])
        for at, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            starts = range(at, at + n, BLOCK)
            for k, s in enumerate(starts):
                own = slice(s, min(s + BLOCK, at + n))
                f, own_node = fp[own], node[own]
                x, y = _forest(f, lambda p, rest, f=f: self.near(f[p], f[rest]))
                a += [own_node[i] for i in x]
                b += [own_node[i] for i in y]
                for t in starts[k + 1 :]:
                    other = slice(t, min(t + BLOCK, at + n))
                    pairs.append((own, other))
        empty = [np.empty(0, np.int64)]
        a, b = np.concatenate(a + empty), np.concatenate(b + empty)
        return a[a != b], b[a != b], pairs


def links(rows: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS, views: int = 1) -> DataFrame:
    """``a, b``: links that join up all nodes whose fingerprints differ in at most ``max_bits`` bits in some view.

    ``rows``: ``node`` and the fingerprints ``fp0, fp1, ...``, or ``fp`` alone where the fingerprint is the node.  A node
    may stand for several rows, which hang together then.  Every pair of close nodes is found in a cell, but of large cells only a spanning forest is written, so
    the links are linear in the rows that share cells.  Which nodes hang together is exact.
    """
    masks = cell_masks(groups, max_bits)
    names = [f"fp{v}" for v in range(views)] if "node" in rows.columns else ["fp"]
    lone = names == ["fp"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = part.num_rows
                for v, name in enumerate(names):
                    fp = part.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                    counts = unary_counts(fp.view(np.uint64))
                    salt = (np.arange(len(masks), dtype=np.uint64) + np.uint64(1 + v * 1000)) * np.uint64(0x9E3779B97F4A7C15)
                    cell = (counts[:, None] & masks[None, :]) * np.uint64(0xD6E8FEB86659FD93) + salt[None, :]
                    cell ^= cell >> np.uint64(29)
                    out = [pa.array(cell.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(masks)))]
                    if not lone:
                        out.append(pa.array(np.repeat(part.column("node").to_numpy(zero_copy_only=False), len(masks))))
                    if n:
                        yield pa.RecordBatch.from_arrays(out, names=["cell", "fp", "node"][: len(out)])

    cells = _Cells(max_bits)
    LIMIT = 1 << 19

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            stop = len(cols[0])
            if not final:
                stop = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            held, count = [[c[stop:] for c in cols]], len(cols[0]) - stop
            if stop:
                fp, node = cols[1][:stop].view(np.uint64), cols[-1][:stop]
                a, b, pairs = cells.links(cols[0][:stop], fp, node)
                for s in range(0, len(a), 1 << 16):
                    x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                    none = pa.nulls(len(x), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), none, none], names=["a", "b", "fps", "nodes"])
                for own, other in pairs:
                    f, n = (np.concatenate([x[own], x[other]]).tobytes() for x in (fp, node))
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([f]), pa.array([n])], names=["a", "b", "fps", "nodes"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(batch.num_columns)])
                count += batch.num_rows
                if count > LIMIT:
                    yield from flush(False)
                    if count > LIMIT // 2:  # one large cell: wait until there is as much again
                        held = [[np.concatenate(c) for c in zip(*held, strict=True)]]
        if count:
            yield from flush(True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fp, node = np.frombuffer(f, np.uint64), np.frombuffer(n, np.int64)
                x, y = _forest(fp, lambda p, rest, fp=fp: cells.near(fp[p], fp[rest]))
                if x:
                    x, y = node[np.concatenate(x)], node[np.concatenate(y)]
                    yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], names=["a", "b"])

    placed = rows.mapInArrow(place, "cell long, fp long" + ("" if lone else ", node long"))
    dealt = placed.repartition(n_partitions(rows), "cell").sortWithinPartitions("cell", "fp" if lone else "node")
    found = cut(dealt.mapInArrow(compare, "a long, b long, fps binary, nodes binary"))
    direct = found.where(F.col("a").isNotNull()).select("a", "b")
    blocks = found.where(F.col("fps").isNotNull()).select("fps", "nodes")
    return direct.union(blocks.repartition(n_partitions(rows), F.xxhash64("fps")).mapInArrow(across, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node with a link, the smallest node it hangs together with.

    Star contraction in turns: each end of a link is hooked onto the smallest node that the link's smaller end knows,
    then all smaller neighbours of a node onto the smallest of them.  The rounds grow with the logarithm of the longest
    chain.  Each round is written to the shared folder, in place of the one before; only counts come to the driver.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    work = cut(edges.where("a <> b").select(hi, lo).distinct())
    while True:
        above = work.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "lo")
        lifted = work.select("hi", "lo").join(above, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"), F.col("m").isNotNull().alias("moved"))
        lifted = lifted.groupBy("hi", "lo").agg(F.max("moved").alias("moved"))
        least = lifted.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"), F.max("moved").alias("moved"))
        more = lifted.select("hi", "lo").join(least.where("n > 1").select("hi", "m"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(True).alias("moved"))
        stars = least.select("hi", F.col("m").alias("lo"), (F.col("moved") | (F.col("n") > 1)).alias("moved")).union(more)
        work = cut(stars.groupBy("hi", "lo").agg(F.max("moved").alias("moved")), instead_of=work)
        if not work.where("moved").limit(1).count():
            break
    parent = work.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return parent.union(parent.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``key, fingerprint, component_id``.

    ``component_id`` is the smallest key in the group of documents joined by links of at most ``max_bits`` differing
    bits.  Null keys are never smallest (null only where a group has no other); repeated rows share a group.  Equal
    fingerprints are grouped before anything is compared, however many copies there are.
    """
    marked = cut(fingerprints(docs, [key], text, size).withColumnRenamed(key, "__key"))
    reps = marked.groupBy("fp").agg(F.min("__key").alias("rep"))
    rooted = components(links(reps.select("fp"), max_bits))
    member = reps.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    member = cut(member)
    smallest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = member.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select(F.col("__key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
