"""Benchmark decontamination by latent semantic retrieval.

The benchmark's passages are weighed by TF-IDF (document frequencies over the whole corpus) and laid into a latent
space by a randomised SVD.  Every stretch of every document is projected and held against the items by cosine; near
ones are checked by the longest common subsequence of words and by the item's telling words (its rarest ones: the
benchmark has no column of answers).  Only the benchmark enters the SVD, not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, run_hashes, slices

#: A stretch is 2 or 4 blocks of so many words, and starts at every block.
STEP = 16
WINDOWS = (2, 4)
#: Latent dimensions at most, and the share of the passages' energy after which no more are taken.
DIMENSIONS, ENERGY = 256, 0.95
MIN_COSINE = 0.35
#: A leak has this share of the item's words as a common subsequence, or the lesser one and this share of the telling words.
LCS_SURE, LCS_LIKELY, TELLING = 0.6, 0.5, 0.5
#: Items with fewer words tell nothing.
MIN_WORDS = 6
#: Longer items are scored by pieces of so many words at most: wherever a piece starts, a stretch holds it whole.
PIECE = STEP * (WINDOWS[-1] - 1)
#: Pieces of which the latent space holds a lesser share of the energy are also scored by their exact TF-IDF cosine.
HELD = 0.9
#: Pieces taken at once; a larger benchmark is worked off in blocks of whole items, one after another, so only one block's
#: model is on the driver or an executor.  All blocks share the weights of words.
MAX_ITEMS = 5000
#: Products of words and postings that are added up at once.
MAX_PRODUCTS = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word: runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased."""
    data = np.frombuffer(raw, np.uint8)
    starts, h = run_hashes(_LOWER[data], _IN_WORD[data])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return starts, h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    return _words(raw)[1]


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and where each text starts (one more at the end)."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts, hashes = _words(b" ".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.append(0, np.searchsorted(starts, ends))


def lcs(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, all of the item's places in one integer."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        hit = row & places.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted word hashes
    idf: np.ndarray
    unknown: float  # idf of words that no item has
    most: np.ndarray  # of each word the most that it can add, by its weight, to the score of any piece
    basis: np.ndarray  # word x dimension
    pieces: np.ndarray  # piece x dimension, of length 1
    item_of: np.ndarray  # of each piece
    weak: np.ndarray  # pieces that the latent space holds badly
    posted: np.ndarray  # where each word's postings start, and one more
    post_piece: np.ndarray  # places in ``weak``
    post_weight: np.ndarray  # of the word in the piece of length 1
    item_ids: list[int]
    item_words: list[list[int]]
    telling: list[set[int]]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Index in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def exact(self, block: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Products of n blocks with the weak pieces, from the words' blocks (ascending), places and weights."""
        wide = len(self.weak)
        out = np.zeros(n * wide, np.float32)
        times = self.posted[at + 1] - self.posted[at]
        ends = np.cumsum(times)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MAX_PRODUCTS, "right")))
            own = times[lo:hi]
            place = np.repeat(self.posted[at[lo:hi]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            first, last = int(block[lo]), int(block[hi - 1]) + 1
            cell = np.repeat((block[lo:hi] - first) * wide, own) + self.post_piece[place]
            out[first * wide : last * wide] += np.bincount(cell, np.repeat(weight[lo:hi], own) * self.post_weight[place], (last - first) * wide)
            lo = hi
        return out.reshape(n, wide)

    def find(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, longest common subsequence, cosine) of the leaks in one document (its word hashes and their places in the
        vocabulary), the best stretch of each item."""
        n = len(hashes)
        if n < MIN_WORDS:
            return []
        weight = np.where(at >= 0, self.idf[at], self.unknown).astype(np.float32)
        starts = np.arange(0, n, STEP)
        energy = np.add.reduceat(weight * weight, starts)
        reach = np.add.reduceat(np.where(at >= 0, weight * self.most[at], 0), starts)
        wide = [np.convolve(x, np.ones(w))[w - 1 :] for w in WINDOWS for x in (energy, reach)]
        open_ = [np.flatnonzero(wide[2 * k + 1] >= MIN_COSINE * np.sqrt(wide[2 * k])) for k in range(len(WINDOWS))]
        if not any(map(len, open_)):
            return []
        # No piece's score with a stretch, latent or exact, exceeds the sum of its words' weights times the most that any
        # piece gives each of them; stretches that stay below the limit are not projected.
        blocks = np.unique(np.concatenate([np.add.outer(o, np.arange(w)).ravel() for o, w in zip(open_, WINDOWS, strict=True)]))
        blocks = blocks[blocks < len(starts)]
        latent = np.zeros((len(blocks), self.basis.shape[1]), np.float32)
        exact = np.zeros((len(blocks) + 1, len(self.weak)), np.float32)
        used = np.concatenate([np.arange(starts[b], min(starts[b] + STEP, n)) for b in blocks])
        used = used[at[used] >= 0]
        if len(used):
            b = np.searchsorted(blocks, used // STEP)
            share = np.zeros((len(blocks), len(used)), np.float32) if len(blocks) * len(used) < 1 << 16 else None
            if share is not None:
                share[b, np.arange(len(used))] = weight[used]
                latent = share @ self.basis[at[used]]
            else:
                first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                latent[b[first]] = np.add.reduceat(self.basis[at[used]] * weight[used, None], first, axis=0)
            if len(self.weak):
                exact[:-1] = self.exact(b, at[used], weight[used], len(blocks))
        # Scores of blocks, and of none; a stretch's score is the sum of its blocks'.
        scores = np.vstack([latent @ self.pieces.T, np.zeros((1, len(self.pieces)), np.float32)])
        best: dict[int, tuple[int, float]] = {}
        for k, w in enumerate(WINDOWS):
            for s in range(0, len(open_[k]), 4096):
                o = open_[k][s : s + 4096]
                norm = np.sqrt(np.maximum(wide[2 * k][o], 1e-9))
                at_block = np.searchsorted(blocks, o)
                score = sum(scores[np.minimum(at_block + j, len(blocks))] for j in range(w)) / norm[:, None]
                if len(self.weak):
                    score[:, self.weak] = np.maximum(score[:, self.weak], sum(exact[np.minimum(at_block + j, len(blocks))] for j in range(w)) / norm[:, None])
                near: dict[tuple[int, int], float] = {}
                for r, piece in np.argwhere(score >= MIN_COSINE).tolist():
                    own = r, int(self.item_of[piece])
                    near[own] = max(near.get(own, 0.0), float(score[r, piece]))
                for (r, item), cosine in near.items():
                    lo, words = int(starts[o[r]]), self.item_words[item]
                    if best.get(item, (0, 0.0))[0] == len(words):
                        continue
                    region = hashes[max(0, lo - len(words)) : lo + w * STEP + len(words)].tolist()
                    within = set(region)
                    if sum(x in within for x in words) < LCS_LIKELY * len(words):
                        continue
                    got = lcs(words, region)
                    if got < LCS_LIKELY * len(words) or got <= best.get(item, (0, 0.0))[0]:
                        continue
                    got = self.tight(words, region, got)
                    share = got / len(words)
                    told = len(self.telling[item] & within) / max(1, len(self.telling[item]))
                    if got > best.get(item, (0, 0.0))[0] and (share >= LCS_SURE or (share >= LCS_LIKELY and told >= TELLING)):
                        best[item] = (got, cosine)
        return [(i, a, c) for i, (a, c) in sorted(best.items())]

    @staticmethod
    def tight(words: list[int], region: list[int], loose: int) -> int:
        """The best within any stretch of one and a half times the item's length, so that scattered words don't add up."""
        size = len(words) * 3 // 2
        if len(region) <= size:
            return loose
        step = max(1, len(words) // 8)
        return max(lcs(words, region[k : k + size]) for k in range(0, len(region) - size + step, step))


def _partials(items: DataFrame, make) -> np.ndarray:
    """Sum over the partitions of the arrays that ``make(texts)`` gives; their size does not depend on the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = make([t or "" for t in batch.column(0).to_pylist()])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()])], names=["part"])

    return sum(np.frombuffer(r, np.float64) for r in items.select(F.col("text").cast("string")).mapInArrow(run, "part binary").toArrow().column(0).to_pylist())


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and how many hold each word of the vocabulary, over the whole corpus."""
    box = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(texts: list[str]) -> np.ndarray:
        known, out = box.value, np.zeros(len(box.value) + 1)
        out[-1] = len(texts)
        for s in range(0, len(texts), 200):
            hashes, starts = hashes_of(texts[s : s + 200])
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            hit = known[at] == hashes
            out[:-1] += np.bincount(np.unique(doc[hit] * len(known) + at[hit]) % len(known), minlength=len(known))
        return out

    got = _partials(docs, count)
    return (int(got[-1]), got[:-1]) if isinstance(got, np.ndarray) else (0, np.zeros(len(vocabulary)))


def pieces_of(words: np.ndarray) -> list[np.ndarray]:
    """An item's words, cut evenly where they are more than PIECE."""
    return np.array_split(words, -(-len(words) // PIECE))


@dataclass
class Weights:
    """What all blocks share: the words of the whole benchmark, and how telling each is."""

    vocabulary: np.ndarray
    idf: np.ndarray
    unknown: float


def weigh(benchmark: DataFrame, docs: DataFrame) -> Weights:
    """Words of the benchmark (their number is bounded by it, not by the corpus), counted over all documents in one pass."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(0)):
                found = np.unique(hashes_of([t or "" for t in batch.column(0).slice(at, n).to_pylist()])[0])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["word"])

    words = benchmark.select(F.col("text").cast("string")).mapInArrow(own, "word long").distinct().toArrow().column(0).to_numpy()
    vocabulary = np.sort(words.astype(np.int64).view(np.uint64))
    if not len(vocabulary):
        return Weights(vocabulary, np.empty(0), 0.0)
    n, df = document_frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    return Weights(vocabulary, idf, float(np.mean(idf)))


def fit(items: DataFrame, weights_: Weights, dimensions: int = DIMENSIONS) -> Model | None:
    """The latent space of one block of items (``item_id, text``; MAX_ITEMS pieces or so); None where none has words.

    Randomised SVD on the driver, which holds the block: its TF-IDF rows are sparse, and the words-by-dimensions matrices
    are bounded by the block.
    """
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").orderBy("item_id", "text").toArrow()
    own = [(i, word_hashes(t.encode("utf-8", "surrogatepass"))) for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
    own = [(i, w) for i, w in own if len(w) >= MIN_WORDS]
    if not own:
        return None
    vocabulary = np.unique(np.concatenate([w for _, w in own]))
    idf = weights_.idf[np.searchsorted(weights_.vocabulary, vocabulary)]
    size = len(vocabulary)
    item_of, tfidf = [], []  # tfidf: each piece's words and their weights, of length 1
    for k, (_, w) in enumerate(own):
        for piece in pieces_of(w):
            at, times = np.unique(np.searchsorted(vocabulary, piece), return_counts=True)
            weights = times * idf[at]
            weights /= np.linalg.norm(weights)
            item_of.append(k)
            tfidf.append((at, weights.astype(np.float32)))

    def onto(matrix: np.ndarray) -> np.ndarray:
        return np.array([w @ matrix[at] for at, w in tfidf])

    wide = min(dimensions + 10, len(tfidf))
    y = onto(np.random.default_rng(5).standard_normal((size, wide), np.float32))
    values, vectors = np.linalg.eigh(y.T.astype(np.float64) @ y)
    good = values > values[-1] * 1e-10
    q = (y @ (vectors[:, good] / np.sqrt(values[good]))).astype(np.float32)  # has orthonormal columns
    b = np.zeros((size, q.shape[1]), np.float32)
    for (at, w), row in zip(tfidf, q, strict=True):
        b[at] += w[:, None] * row
    values, vectors = np.linalg.eigh(b.T.astype(np.float64) @ b)
    values, vectors = values[::-1], vectors[:, ::-1]
    most_k = min(dimensions, int((values > values[0] * 1e-10).sum()))
    basis = b @ (vectors[:, :most_k] / np.sqrt(values[:most_k])).astype(np.float32)
    latent = onto(basis)
    # As many dimensions as hold every piece, where the block allows that.
    least = np.cumsum(latent * latent, axis=1).min(0)
    k = min(most_k, int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-12), ENERGY)) + 1)
    if least[-1] >= HELD:
        k = max(k, int(np.searchsorted(least, HELD)) + 1)
    basis, latent = np.ascontiguousarray(basis[:, :k]), latent[:, :k]
    held = np.linalg.norm(latent, axis=1)
    latent /= np.maximum(held, 1e-9)[:, None]
    weak = np.flatnonzero(held * held < HELD)
    word = np.concatenate([tfidf[j][0] for j in weak]) if len(weak) else np.empty(0, np.int64)
    order = np.argsort(word, kind="stable")
    post_piece = np.repeat(np.arange(len(weak)), [len(tfidf[j][0]) for j in weak])[order]
    post_weight = np.concatenate([tfidf[j][1] for j in weak])[order] if len(weak) else np.empty(0, np.float32)
    posted = np.searchsorted(word[order], np.arange(size + 1))
    most = np.zeros(size, np.float32)
    for s in range(0, size, 4096):
        most[s : s + 4096] = np.maximum((basis[s : s + 4096] @ latent.T).max(1), 0)
    for j in weak:
        at, w = tfidf[j]
        most[at] = np.maximum(most[at], w)
    telling = []
    for _, w in own:
        rare = sorted({int(x) for x in w}, key=lambda x: (-idf[np.searchsorted(vocabulary, np.uint64(x))], x))
        telling.append(set(rare[: max(3, len(rare) // 4)]))
    return Model(vocabulary, idf.astype(np.float32), weights_.unknown, most, basis, latent.astype(np.float32), np.array(item_of), weak, posted, post_piece, post_weight, [i for i, _ in own], [w.tolist() for _, w in own], telling)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: list[str] | None = None, max_items: int = MAX_ITEMS) -> DataFrame:
    """``keys`` (doc_id) with ``n_leaks, items, lcs, cosine``: a row per row of ``docs``.

    ``items``: the leaked items' ids, comma-joined in the order of the items; ``lcs`` and ``cosine``: the best of them,
    0 where there is none.  Null texts and null items hold nothing; items of fewer than MIN_WORDS words are not looked
    for; an empty benchmark finds nothing.  Whole texts are searched.  No row is shuffled, unless the benchmark has more
    than ``max_items`` pieces: then each block of it gives the rows that it finds, which are joined to the documents.
    """
    keys = keys or ["doc_id"]
    spark = docs.sparkSession
    pieces = F.greatest(F.lit(1), F.ceil(F.size(F.split(F.col("text").cast("string"), r"\s+")) / PIECE))
    n = benchmark.agg(F.sum(pieces)).first()[0] or 0
    blocks = max(1, -(-n // max_items))
    weights = weigh(benchmark, docs)

    def searched(model: Model | None, rows: DataFrame, kept: list[str]) -> tuple[DataFrame, object]:
        box = spark.sparkContext.broadcast(model)

        def make(texts: list[str]) -> dict:
            got: dict = {"n_leaks": [], "items": [], "lcs": [], "cosine": []}
            for k, t in enumerate(texts):
                if k % 200 == 0 and box.value:
                    hashes, starts = hashes_of(texts[k : k + 200])
                    places = box.value.places(hashes)
                own = slice(starts[k % 200], starts[k % 200 + 1]) if box.value else None
                found = box.value.find(hashes[own], places[own]) if box.value and t else []
                got["n_leaks"].append(len(found))
                got["items"].append(",".join(str(box.value.item_ids[i]) for i, _, _ in found))
                got["lcs"].append(max([a for _, a, _ in found], default=0))
                got["cosine"].append(round(max([c for _, _, c in found], default=0.0), 6))
            return got

        return per_text(rows, kept, "text", make, "n_leaks long, items string, lcs long, cosine double"), box

    if blocks == 1:
        return searched(fit(benchmark, weights), docs, keys)[0]
    # Blocks of rows in the order of a hash, so that each holds max_items pieces or so.
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, "text"])])
    marked = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, "text"])], whole.alias("__row"))
    hits = []
    for k in range(blocks):
        if (model := fit(benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), weights)) is None:
            continue
        found, box = searched(model, marked, ["__row"])
        hits.append(cut(found.where("n_leaks > 0")))
        box.destroy()
    if not hits:
        return searched(None, docs, keys)[0]
    each = reduce(DataFrame.unionByName, hits).distinct().groupBy("__row").agg(F.sum("n_leaks").alias("n_leaks"), F.array_join(F.array_sort(F.collect_list("items")), ",").alias("items"), F.max("lcs").alias("lcs"), F.max("cosine").alias("cosine"))
    ours = {"n_leaks": F.lit(0).cast("long"), "items": F.lit(""), "lcs": F.lit(0).cast("long"), "cosine": F.lit(0.0)}
    each = each.withColumnsRenamed({c: f"__{c}" for c in ours})
    return marked.join(each, "__row", "left").select(*[F.col(f"`{c}`") for c in keys], *[F.coalesce(f"__{c}", default).alias(c) for c, default in ours.items()])
