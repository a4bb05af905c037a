"""Near copies of documents: SimHash candidates, verified by the shingles they share.

SimHash of word shingles parts documents of 80 % common shingles by ten bits and more.  So the candidates come from
several fingerprints of the documents' distinct words, in each of which documents with scattered changes differ in four
bits or so; any of them within ``max_bits`` makes a candidate.  Added or lost passages move these fingerprints further, so
bands of least shingles (equal in two documents of 80 % common shingles in 998 of 1000 cases) make candidates too.
Candidates that hang together are then held against each other by the share
of common ``size``-word shingles, exactly, and only those of ``similarity`` or more are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_partitions, per_text
from .simhash import MAX_BITS, _forest, components, links, lower_words, majority
from .substring_dedup import _marks, _stream, mix, word_hashes

SIZE, SIMILARITY = 5, 0.8
VIEWS, GROUPS = 5, 7
BANDS, ROWS = 12, 4
#: Shorter words are in every text, so they say nothing about it.
LETTERS = 4
#: Documents of one group of candidates that a task holds against each other; larger groups are dealt out as pairs of blocks.
BLOCK = 512
#: Rows (of some 30 bytes) that are sent to all executors at most; larger tables are joined by a shuffle.
MAX_SENT = 500_000
NO_ID = -(2**63)


def shingle_hashes(words: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words joined by a space; of the whole where there are fewer words."""
    w = word_hashes(words)
    n = len(w) - size + 1
    if not len(w):
        return np.empty(0, np.uint64)
    if n < 1:
        w, n, size = w, 1, len(w)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h + w[k : k + n])
    return np.unique(h)


def word_views(texts: list[str], views: int = VIEWS) -> np.ndarray:
    """A fingerprint per view of the distinct words of each text."""
    out = np.zeros((len(texts), views), np.uint64)
    salts = np.arange(1, views + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, t in enumerate(texts):
        words = set(lower_words(t))
        own = [w for w in words if len(w) >= LETTERS] or list(words)
        if own:
            h = word_hashes(b" ".join(own))
            out[k] = majority(mix(h[:, None] ^ salts[None, :]))
    return out


def shingle_bands(words: bytes, size: int = SIZE) -> np.ndarray:
    """A hash per band of its ROWS least shingles, each by an order of its own."""
    h = shingle_hashes(words, size)
    if not len(h):
        return np.empty(0, np.int64)
    salts = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.array([mix(h ^ s).min() for s in salts]).reshape(BANDS, ROWS)
    out = salts[:BANDS].copy()
    for r in range(ROWS):
        out = mix(out ^ least[:, r])
    return out.view(np.int64)


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, fp0, ...``: what stands for the lower-cased words, and their fingerprints."""

    def make(texts: list[str]) -> dict:
        marks = np.array([_words_mark(t) for t in texts], np.int64).reshape(-1, 2)
        views = word_views(texts).view(np.int64)
        bands = [shingle_bands(b" ".join(lower_words(t))).tobytes() for t in texts]
        return {"t1": pa.array(marks[:, 0]), "t2": pa.array(marks[:, 1]), "bands": bands} | {f"fp{v}": pa.array(views[:, v].copy()) for v in range(VIEWS)}

    return per_text(docs, ["doc_id"], "text", make, "t1 long, t2 long, bands binary, " + ", ".join(f"fp{v} long" for v in range(VIEWS)))


def _verified(similarity: float, size: int):
    """A spanning forest of the links among the packed texts of each task, rows sorted by task."""

    def near_of(sets: list[np.ndarray], sizes: np.ndarray):
        def near(at: int, rest: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rest), bool)
            fits = np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at])
            for k in np.flatnonzero(fits).tolist():
                other = sets[rest[k]]
                place = np.minimum(np.searchsorted(other, sets[at]), len(other) - 1) if len(other) else None
                common = int((other[place] == sets[at]).sum()) if place is not None else 0
                out[k] = common >= similarity * (len(other) + len(sets[at]) - common)
            return out

        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for table in _stream(batches, 0, 1024, 1 << 23):
            group, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            sets = [shingle_hashes(unpack.decompress(x), size) for x in table.column(2).to_pylist()]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(group)).tolist(), strict=True):
                own = sets[s:e]
                x, y = _forest(np.arange(e - s), near_of(own, np.array(list(map(len, own)))))
                a += [node[s + i] for i in x]
                b += [node[s + i] for i in y]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            del table, sets
        pa.default_memory_pool().release_unused()

    return run


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """``docs`` with one row of each group of copies and near copies: that of the smallest doc_id.

    Documents of the same lower-cased words are copies; texts without words (and null texts) are copies of each other
    only where all are without words.  Two others are linked where they share ``similarity`` of their shingles; groups
    are what hangs together.  Rows that repeat an id with equal words leave one row (the one of least content hash);
    null ids come last.  All columns pass through.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = cut(_marked(slim))
    least = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"))
    fps = [F.first(c).alias(c) for c in ("bands", *(f"fp{v}" for v in range(VIEWS)))]
    distinct = cut(marked.groupBy("t1", "t2").agg(F.min(least).alias("rep"), *fps))  # node: t1, of equal words one row
    near = _groups_of_candidates(distinct)
    bodies = per_text(slim.select(F.lit(0).alias("one"), "text"), ["one"], "text", _packed, "node long, body binary").where("body is not null")
    linked = _links_in_groups(near, bodies, similarity, size)
    groups = components(linked)

    owner = distinct.select("t1", "t2", "rep", F.col("t1").alias("node")).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owner = cut(owner.select("t1", "t2", "rep", "root"))
    best = owner.groupBy("root").agg(F.min(F.struct("rep", "t1", "t2")).alias("best"))
    kept = best.select(F.col("best.t1").alias("__t1"), F.col("best.t2").alias("__t2"), F.coalesce("best.rep.doc_id", F.lit(NO_ID)).alias("__id"))
    ids = marked.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"))
    times = ids.groupBy("__t1", "__t2", "__id").agg(F.count("*").alias("n"))
    gone = cut(times.join(kept, ["__t1", "__t2", "__id"], "left_anti").drop("n"))
    rows = _with_marks(docs)
    left = rows.join(_sendable(gone), ["__t1", "__t2", "__id"], "left_anti")
    if times.where("n > 1").limit(1).count():
        order = W.partitionBy("__t1", "__t2", "__id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        left = left.withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def _groups_of_candidates(distinct: DataFrame) -> DataFrame:
    """``node, root`` of all nodes with a candidate: by shared bands first, then by fingerprints.

    What shares bands goes under one name before fingerprints are compared, so the many cells in which near copies meet
    give no links among them, but only to others.
    """
    prints = [f"fp{v}" for v in range(VIEWS)]
    by_band = components(_equal_bands(distinct.select(F.col("t1").alias("node"), "bands")))
    named = cut(distinct.select(F.col("t1").alias("node"), *prints).join(by_band.withColumnRenamed("root", "name"), "node", "left"))
    by_print = components(links(named.select(F.coalesce("name", "node").alias("node"), *prints), MAX_BITS, GROUPS, VIEWS))
    own = F.coalesce("name", F.col("named.node"))
    met = named.alias("named").join(by_print.select(F.col("node").alias("__name"), "root"), own == F.col("__name"), "left")
    return met.where("name is not null or root is not null").select(F.col("named.node").alias("node"), F.coalesce("root", "name").alias("root"))


def _links_in_groups(near: DataFrame, bodies: DataFrame, similarity: float, size: int) -> DataFrame:
    """``a, b``: verified links that join up whatever in a group of candidates (``node, root``) hangs together.

    In groups of more than BLOCK nodes all are first held against one, the pivot.  Those linked to it hang together by
    that, so of them only links to the others are looked for: in a group of near copies, however large, hardly any
    text is sent twice.  All pairs of nodes but those are held against each other, by pairs of blocks.
    """
    n = n_partitions(near)
    sizes = near.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("pivot"))
    member = cut(near.join(sizes, "root").select("node", "root", "pivot", (F.col("n") > BLOCK).alias("large")))
    bodies = cut(bodies.join(_sendable(member.select("node")), "node"))  # of candidates only, compressed; read up to three times
    if member.where("large").limit(1).count():
        large = member.where("large")
        pivots = bodies.join(_sendable(large.select("root", F.col("pivot").alias("node")).distinct()), "node").groupBy("root").agg(F.first("body").alias("pivot_body"))
        # Texts stay where they are; one text a large group is sent to them, or joined to them by a shuffle in even parts.
        beside = bodies.join(_sendable(large.select("node", "root", "pivot")), "node").join(_sendable(cut(pivots)), "root").select("node", "pivot", "body", "pivot_body")
        star = cut(beside.mapInArrow(_verified_pairs(similarity, size), "a long, b long"))
        settled = star.select(F.col("b").alias("node")).distinct().withColumn("settled", F.lit(True))
        member = member.join(settled, "node", "left")
    else:
        star, member = None, member.withColumn("settled", F.lit(None).cast("boolean"))
    member = member.withColumn("settled", F.coalesce("settled", F.lit(False)) & F.col("large"))
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    counts = member.groupBy("root").agg(blocks(~F.col("settled")).alias("loose_blocks"), blocks(F.col("settled")).alias("settled_blocks"))
    # Blocks of loose nodes are numbered from 0 and those of settled ones from -1 down; a task is a pair of blocks, one of them loose.
    own = F.pmod(F.xxhash64("node"), F.when(F.col("settled"), F.col("settled_blocks")).otherwise(F.col("loose_blocks"))).cast("int")
    placed = member.join(counts, "root").where("loose_blocks > 0").withColumn("own", F.when(F.col("settled"), -1 - own).otherwise(own))
    placed = cut(placed.select("node", "root", "own", "loose_blocks", "settled_blocks"))
    loose = F.sequence(F.lit(0), F.col("loose_blocks") - 1)
    others = F.when(F.col("own") < 0, loose).when(F.col("settled_blocks") > 0, F.concat(loose, F.sequence(-F.col("settled_blocks"), F.lit(-1)))).otherwise(loose)
    pairs = F.transform(others, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    sent = bodies.join(_sendable(placed), "node").select("node", "body", "root", F.explode(pairs).alias("p"))
    task = F.xxhash64("root", "p.i", "p.j")
    found = sent.select(task.alias("task"), "node", "body").repartition(n, "task").sortWithinPartitions("task", "node").mapInArrow(_verified(similarity, size), "a long, b long")
    return found.union(star) if star is not None else found


def _verified_pairs(similarity: float, size: int):
    """``pivot, node`` of the rows (node, pivot, body, pivot_body) whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, held = zstandard.ZstdDecompressor(), (None, None)
        for batch in batches:
            a, b = [], []
            for k, (node, pivot) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if held[0] != pivot:
                    held = pivot, shingle_hashes(unpack.decompress(batch.column(3)[k].as_py()), size)
                own = shingle_hashes(unpack.decompress(batch.column(2)[k].as_py()), size)
                common = len(np.intersect1d(own, held[1], assume_unique=True))
                if common >= similarity * (len(own) + len(held[1]) - common):
                    a.append(pivot)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _equal_bands(rows: DataFrame) -> DataFrame:
    """Links of all nodes that share a band to the smallest of them: as many as nodes, however many share it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x or b"", np.int64) for x in batch.column(1).to_pylist()]
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), list(map(len, own))), pa.int64()))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.concatenate([*own, np.empty(0, np.int64)]))], names=["node", "band"])

    held = rows.mapInArrow(spread, "node long, band long")
    shared = held.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("band", "a")
    return held.join(shared, "band").select("a", F.col("node").alias("b"))


def _sendable(df: DataFrame) -> DataFrame:
    """To be sent to all executors if it is small enough, which is counted; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= MAX_SENT else df


def _with_marks(docs: DataFrame) -> DataFrame:
    def make(texts: list[str]) -> dict:
        marks = np.array([_words_mark(t) for t in texts], np.int64).reshape(-1, 2)
        return {"__t1": pa.array(marks[:, 0]), "__t2": pa.array(marks[:, 1])}

    return per_text(docs, docs.columns, "text", make, "__t1 long, __t2 long").withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def _words_mark(text: str) -> tuple[int, int]:
    return _marks(b" ".join(lower_words(text)))


def _packed(texts: list[str]) -> dict:
    """What stands for the words, and the words compressed; of copies within a batch one is sent."""
    import zstandard

    pack, seen = zstandard.ZstdCompressor(level=1), set()
    node, body = [], []
    for t in texts:
        words = b" ".join(lower_words(t))
        t1 = _marks(words)[0]
        node.append(t1)
        body.append(None if t1 in seen else pack.compress(words))
        seen.add(t1)
    return {"node": node, "body": body}
