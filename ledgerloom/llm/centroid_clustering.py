"""Lloyd's clustering of whole-number vectors by two trees.

Each task cuts its vectors into blocks and builds a cover tree over each, once: a node's vectors lie within its radius of
its centre, children have at most half the node's radius and centres further apart than that.  In each round a cover tree
over the centroids meets the trees of the blocks.  A pair of nodes is dropped where the centroids' node lies further off than
another certainly does; where one centroid is left the node's vectors take it unseen (their sum is kept); where a leaf is
reached, its vectors are held against the centroids that are left, exactly.

Vectors are read once, without a shuffle.  What leaves a task in a round is a sum and a count per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import cut

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of one tree, and of a leaf of it.
BLOCK, LEAF = 2048, 24
#: Components beyond this many steps leave no room for a distance in a long; such vectors are left out.
LARGEST = 1 << 27
#: Up to here, products of vectors are exact in doubles.
_EXACT = 1 << 22
#: Distances are compared with so much room for rounding.
_ROOM = 1e-6


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors, a row per row of ``a``."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < _EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.empty((len(a), 0), np.int64)


class CoverTree:
    """Nodes over ``points``, parents first.  Node ``i`` covers ``order[lo[i]:hi[i]]``, all within ``radius[i]`` of point ``centre[i]``;
    its children are the nodes ``first[i]`` up to ``first[i] + n_children[i]``."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        far = np.sqrt(squared(points, points).astype(np.float64))
        order: list[np.ndarray] = []
        centre, lo, hi, radius, first, kids = [0], [0], [n], [float(far[0].max(initial=0))], [0], [0]
        members = {0: np.arange(n)}
        at = 0
        while at < len(centre):
            own = members.pop(at)
            if len(own) > leaf and radius[at] > 0:
                parts = self._net(far, own, centre[at], 2.0 ** (np.ceil(np.log2(radius[at])) - 1), leaf)
                first[at], kids[at], start = len(centre), len(parts), lo[at]
                for c, part in parts:
                    members[len(centre)] = part
                    centre.append(c)
                    lo.append(start)
                    start += len(part)
                    hi.append(start)
                    radius.append(float(far[c, part].max()))
                    first.append(0)
                    kids.append(0)
            else:
                order.append((lo[at], own))
            at += 1
        self.order = np.concatenate([own for _, own in sorted(order, key=lambda x: x[0])]) if n else np.empty(0, np.int64)
        self.centre, self.lo, self.hi = (np.array(x, np.int64) for x in (centre, lo, hi))
        self.radius, self.first, self.n_children = np.array(radius), np.array(first, np.int64), np.array(kids, np.int64)

    @staticmethod
    def _net(far: np.ndarray, own: np.ndarray, centre: int, reach: float, leaf: int) -> list[tuple[int, np.ndarray]]:
        """Centres more than ``reach`` apart, each with what it is the first to hold within ``reach``.

        Children of a few vectors each go into common leaves.
        """
        parts, loose, c = [], [], centre
        while len(own):
            near = far[c, own] <= reach
            (parts if near.sum() * 4 > leaf or c == centre else loose).append((c, own[near]))
            own = own[~near]
            c = int(own[0]) if len(own) else c
        if loose:
            rest = np.concatenate([part for _, part in loose])
            parts += [(int(rest[k]), rest[k : k + leaf]) for k in range(0, len(rest), leaf)]
        return parts

    FIELDS = ("order", "centre", "lo", "hi", "radius", "first", "n_children")

    def pack(self) -> bytes:
        arrays = [getattr(self, f) for f in self.FIELDS]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def unpack(cls, data: bytes) -> CoverTree:
        tree, at = cls.__new__(cls), 8 * len(cls.FIELDS)
        for field, n in zip(cls.FIELDS, np.frombuffer(data, np.int64, len(cls.FIELDS)).tolist(), strict=True):
            setattr(tree, field, np.frombuffer(data, np.float64 if field == "radius" else np.int64, n, at))
            at += 8 * n
        return tree


def assign(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, np.ndarray]]]:
    """Nearest centroids (the smaller number of several) as stretches of ``tree.order``: with one centroid for all, and with one for each."""
    whole, each = [], []
    place, exact = points.astype(np.float64), centroids.astype(np.float64)
    spots = exact[over.centre]
    sizes = over.hi - over.lo
    stack = [(0, np.zeros(1, np.int64))] if len(points) else []
    while stack:
        node, pairs = stack.pop()
        q, reach = place[tree.centre[node]], tree.radius[node] + _ROOM
        while True:
            d = np.sqrt(((spots[pairs] - q) ** 2).sum(1))
            # A node's centre is itself a centroid: none of the vectors is further from its nearest than this.
            keep = d - reach - over.radius[pairs] <= (d.min() + reach) * (1 + 1e-9)
            pairs = pairs[keep]
            wide = (over.n_children[pairs] > 0) & (over.radius[pairs] * 2 > reach)
            if not wide.any():
                break
            opened = [np.arange(over.first[p], over.first[p] + over.n_children[p]) for p in pairs[wide].tolist()]
            pairs = np.concatenate([pairs[~wide], *opened])
        lo, hi = int(tree.lo[node]), int(tree.hi[node])
        if tree.n_children[node] == 0 or sizes[pairs].sum() == 1:
            left = np.sort(np.concatenate([over.order[over.lo[p] : over.hi[p]] for p in pairs.tolist()]))
            if len(left) == 1:
                whole.append((lo, hi, int(left[0])))
            else:
                each.append((lo, hi, left[squared(points[tree.order[lo:hi]], centroids[left]).argmin(1)]))
        else:
            first = int(tree.first[node])
            stack += [(child, pairs) for child in range(first, first + int(tree.n_children[node]))]
    return whole, each


def whole_vectors(df: DataFrame, key: str, vector: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``__key, __v``: vectors of ``size`` finite components as whole numbers ``floor(scale * x)``."""
    v = F.col("__v")
    known = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) > float(LARGEST) / scale))
    return known.where((F.size(v) == size) & ~bad).select("__key", F.transform(v, lambda x: F.floor(x * scale)).alias("__v"))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """``ids, points, tree``: stretches of up to ``BLOCK`` rows; equal vectors stand for one another's ``ids`` (``of`` tells which)."""
    kind = vectors.schema["__key"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column(0).combine_chunks()
            flat = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            points, of = np.unique(flat.reshape(-1, size), axis=0, return_inverse=True)
            tree = CoverTree(points, LEAF)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            packed = [pa.array([x], pa.binary()) for x in (of.reshape(-1).astype(np.int32).tobytes(), points.astype(np.int32).tobytes(), tree.pack())]
            return pa.RecordBatch.from_arrays([lists, *packed], names=["ids", "of", "points", "tree"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            at = 0
            while rows.num_rows - at >= BLOCK:
                yield block(rows.slice(at, BLOCK))
                at += BLOCK
            held = rows.slice(at).combine_chunks().to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield block(rows)

    return cut(vectors.mapInArrow(build, f"ids array<{kind}>, of binary, points binary, tree binary"))


def _unpacked(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, CoverTree]]:
    for k in range(batch.num_rows):
        of, points, tree = (batch.column(c)[k].as_py() for c in ("of", "points", "tree"))
        yield batch.column("ids").slice(k, 1).flatten(), np.frombuffer(of, np.int32), np.frombuffer(points, np.int32).astype(np.int64).reshape(-1, size), CoverTree.unpack(tree)


def _sums(blocks: DataFrame, centroids: np.ndarray, size: int) -> dict[int, list[int]]:
    """Per centroid with vectors: their number, and the sum of each component."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, total = CoverTree(centroids, 1), np.zeros((k, size + 1), np.int64)
        for batch in batches:
            for _, of, points, tree in _unpacked(batch, size):
                times = np.bincount(of, minlength=len(points))[tree.order]
                rows = np.column_stack([np.ones(len(points), np.int64), points[tree.order]]) * times[:, None]
                before = np.concatenate([np.zeros((1, size + 1), np.int64), np.cumsum(rows, 0)])
                whole, each = assign(points, tree, centroids, over)
                for lo, hi, c in whole:
                    total[c] += before[hi] - before[lo]
                for lo, hi, got in each:
                    np.add.at(total, got, rows[lo:hi])
        used = np.flatnonzero(total[:, 0])
        if len(used):
            flat = np.arange(size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size + 1)), pa.array(np.tile(flat, len(used))), pa.array(total[used].reshape(-1))], names=["c", "part", "total"])

    parts = blocks.select("of", "points", "tree", F.expr("slice(ids, 1, 0)").alias("ids")).mapInArrow(add, "c long, part long, total long")
    out: dict[int, list[int]] = {}
    # k * (size + 1) numbers, whatever the number of vectors.
    for c, part, total in parts.groupBy("c", "part").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        out.setdefault(c, [0] * (size + 1))[part] = int(total)
    return out


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per row of ``df`` with a vector of ``size`` finite components: ``key, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Starts from the ``clusters`` rows of smallest ``sha256("seed:key")`` (all, where there are fewer; of rows with one key
    that with the smaller vector; a null key counts as an empty text), then ``rounds`` times assigns every vector to its
    nearest centroid (squared Euclidean distance; ties: the smaller number) and moves each centroid to the floor of its
    vectors' mean; an empty one stays.  Vectors that are null, of another length, or with components beyond
    ``LARGEST / scale`` have no row.  Repeated rows count as often as they stand; other columns are not read.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, key, vector, size, scale)
    kind = vectors.schema["__key"].dataType.simpleString()
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit(""))), 256)
    start = vectors.select(rank.alias("rank"), "__v").orderBy("rank", "__v").limit(clusters).collect()
    out = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out)
    centroids = np.array([r["__v"] for r in start], np.int64)
    blocks = _blocks(vectors, size)
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, *total) in _sums(blocks, centroids, size).items():
            centroids[c] = [t // n for t in total]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(centroids, 1)
        for batch in batches:
            for ids, of, points, tree in _unpacked(batch, size):
                nearest = np.empty(len(points), np.int32)
                whole, each = assign(points, tree, centroids, over)
                for lo, hi, c in (*whole, *each):
                    nearest[tree.order[lo:hi]] = c
                distance = ((points - centroids[nearest]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest[of]), pa.array(distance[of])], names=["__key", "cluster", "distance"])

    labelled = cut(blocks.mapInArrow(label, f"__key {kind}, cluster int, distance long"))
    by_cluster = {r["cluster"]: int(r["d"]) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(by_cluster.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda n: n if n < 1 << 63 else None
    # One row per centroid.
    told = spark.createDataFrame([Row(cluster=c, cluster_inertia=fits(d), inertia=fits(whole), centroid_sha256=digest[c]) for c, d in by_cluster.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(told), "cluster").select(F.col("__key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query over ``embeddings``: the rounds one after another, every vector against every centroid."""
    nearest = """{to} AS MATERIALIZED (
  SELECT vec_id, v, min_by(c, d * {clusters} + c) AS c, min(d) AS d FROM (
    SELECT k.vec_id, k.v, m.c, CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k, {centroids} m)
  GROUP BY vec_id, v)"""
    moved = """{to} AS MATERIALIZED (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM {centroids} m LEFT JOIN (
    SELECT c, list(mean ORDER BY part) AS v FROM (
      SELECT c, part, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM (
        SELECT c, part, CAST(sum(v[part]) AS BIGINT) AS s, count(*) AS n FROM {labels}, range(1, 65) t(part) GROUP BY c, part))
    GROUP BY c) n ON n.c = m.c)"""
    steps = []
    for r in range(rounds):
        steps.append(nearest.format(to=f"a{r}", centroids=f"m{r}", clusters=clusters))
        steps.append(moved.format(to=f"m{r + 1}", centroids=f"m{r}", labels=f"a{r}"))
    steps.append(nearest.format(to="last", centroids=f"m{rounds}", clusters=clusters))
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, v FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {clusters}),
{", ".join(steps)}
SELECT l.vec_id, l.c AS cluster, l.d AS distance, CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia, CAST(sum(l.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM last l JOIN m{rounds} m ON m.c = l.c"""
