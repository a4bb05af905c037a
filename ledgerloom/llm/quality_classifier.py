"""Quality classifier: cumulative-link (ordinal) regression on graded ratings over hashed text.

Every grade shares one weight vector ``w`` over hashed features; ordered thresholds ``t_1 < t_2 < ...`` turn the score
into P(grade >= k) = sigmoid(score - t_k).  That gives the expected grade and the tail probability for selection.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, run_hashes

BITS = 18
#: At most so many labelled documents are fitted on: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: A feature is weighed only if so many of the fitted documents hold it, and if its grades differ from the overall
#: ones by so much chi-square: rare words of no bearing would else be learned by heart.  Where few documents are labelled
#: (FULL fewer) or few of one grade, less will do: a LEAST_SHARE of the rarest grade, and chi-square in proportion.
MIN_DOCS, MIN_CHI2 = 12, 40.0
LEAST_DOCS, LEAST_CHI2, LEAST_SHARE, FULL = 3, 12.0, 0.1, 2000
#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
#: Kept: P(grade >= 2) of at least this; a little under one half, as good documents lost cost more than poor ones kept.
KEEP = 0.45

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shape_features(text: str) -> list[tuple[int, int]]:
    """(kind, step) of shares that do not depend on any one word: every step that a share reaches, of ten."""
    pieces = text.split()
    m = max(1, len(pieces))
    shares = (
        sum(map(text.count, "#*$%&|<>")) / m,
        text.count("|") / m,
        text.count("!") / m,
        sum(map(str.isupper, pieces)) / m,
        sum(map(text.count, "0123456789")) / max(1, len(text)),
        1 - len(set(pieces)) / m,
        sum(map(eq, pieces, pieces[1:])) / m,
        text.count("\n") / m,
        np.log2(m) / 15,
    )
    return [(kind, step) for kind, share in enumerate(shares) for step in range(1, min(10, int(10 * share + 0.5)) + 1)]


def features(texts: list[str], bits: int = BITS, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, each once and in order: the distinct words of each whole text, hashed, and its shape.

    ``only``: buckets to keep, as a mask.  Words are runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased.
    """
    mask = np.uint64((1 << bits) - 1)
    pairs = []
    at = 0
    while at < len(texts):  # a few MB at a time, but whole texts
        raws, size, stop = [], 0, at
        while stop < len(texts) and size < 1 << 22:
            raws.append(texts[stop].encode("utf-8", "surrogatepass") + b" ")
            size += len(raws[-1])
            stop += 1
        raw = np.frombuffer(b"".join(raws), np.uint8)
        starts, hashes = run_hashes(_LOWER[raw], _IN_WORD[raw])
        if len(starts):
            buckets = (_mix(hashes) & mask).astype(np.int64)
            ends = np.cumsum(list(map(len, raws)))
            doc = at + np.searchsorted(ends, starts, "right")
            own = doc << bits | buckets
            pairs.append(np.unique(own if only is None else own[only[buckets]]))
        at = stop
    shapes = [k << bits | kind * 16 + step for k, t in enumerate(texts) for kind, step in shape_features(t)]
    shape = np.array(shapes, np.int64)
    every = np.unique(np.concatenate([*pairs, shape if only is None else shape[only[shape & int(mask)]]]))
    return every >> bits, every & int(mask)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, bucket = features(texts, self.bits, self.weights != 0)
        return np.bincount(doc, self.weights[bucket], len(texts))

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a row per text."""
        return sigmoid(self.scores(texts)[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(doc: np.ndarray, bucket: np.ndarray, grade: np.ndarray, bits: int = BITS, rounds: int = 200, rate: float = 0.25, shrink: float = 2e-4, min_chi2: float = MIN_CHI2) -> OrdinalModel:
    """Maximum likelihood with a small quadratic penalty, by full-batch AdaGrad."""
    n, size = len(grade), 1 << bits
    rarest = int(np.bincount(grade, minlength=GRADES).min())
    min_docs = min(MIN_DOCS, max(LEAST_DOCS, int(LEAST_SHARE * rarest)))
    min_chi2 = min(min_chi2, max(LEAST_CHI2, min_chi2 * n / FULL))
    k = GRADES
    share = np.maximum(np.bincount(grade, minlength=k), 1) / n
    held = np.bincount(bucket * k + grade[doc], minlength=size * k).reshape(size, k)
    expected = np.maximum(held.sum(1, keepdims=True) * share, 1e-9)
    bearing = (((held - expected) ** 2 / expected).sum(1) >= min_chi2) & (held.sum(1) >= min_docs)
    use = bearing[bucket]
    doc, bucket = doc[use], bucket[use]
    w, t = np.zeros(size), np.linspace(-1, 1, k - 1)
    sum_w, sum_t = np.full(size, 1e-8), np.full(k - 1, 1e-8)
    rows = np.arange(n)
    for _ in range(rounds):
        s = np.bincount(doc, w[bucket], n)
        tail = np.concatenate([np.ones((n, 1)), sigmoid(s[:, None] - t), np.zeros((n, 1))], 1)
        slope = tail * (1 - tail)
        p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-9)
        above, below = slope[rows, grade] / p, slope[rows, grade + 1] / p
        by_score = (above - below) / n
        g = -np.bincount(bucket, by_score[doc], size) + shrink * w
        gt = np.array([(np.where(grade == j + 1, above, 0) - np.where(grade == j, below, 0)).sum() / n for j in range(k - 1)])
        sum_w += g * g
        sum_t += gt * gt
        w -= rate * g / np.sqrt(sum_w)
        t = np.sort(t - rate * gt / np.sqrt(sum_t))
    return OrdinalModel(w.astype(np.float32), t, bits)


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 toxic, else 1 for quality 0 and 2 for quality 1.  Rows without an id or a label are left out;
    of several labels of one id the lowest grade counts."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality") == 0, 1)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, bits: int = BITS) -> OrdinalModel:
    """Fit on at most ``max_labelled`` labelled documents, whole texts.  Without any, every text has grade 2.

    Of several documents of one id the one of the least content hash is fitted on.
    """
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # Bounded by max_labelled rows of two numbers, so it may be broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("mark", F.xxhash64("text"))

    def make(texts: list[str]) -> dict:
        doc, bucket = features(texts, bits)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        packed = bucket.astype("<i4")
        return {"found": [packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]}

    found = per_text(rows, ["doc_id", "grade", "mark"], "text", make, "found binary")
    got = found.groupBy("doc_id", "grade").agg(F.min_by("found", "mark").alias("found")).orderBy("doc_id").select("grade", "found").toArrow()
    grade = got.column("grade").to_numpy().astype(np.int64)
    if not len(grade):
        return OrdinalModel(np.zeros(1 << bits, np.float32), np.full(GRADES - 1, -40.0), bits)
    own = [np.frombuffer(x, "<i4") for x in got.column("found").to_pylist()]
    doc = np.repeat(np.arange(len(own)), list(map(len, own)))
    return fit(doc, np.concatenate(own).astype(np.int64), grade, bits)


def classify(docs: DataFrame, model: OrdinalModel, keys: list[str], keep: float = KEEP) -> DataFrame:
    """``keys`` with ``expected_grade, p_poor_or_better, p_good, kept``, a row per row of ``docs``.

    Null text is empty text; it has the features of an empty text and is judged by them.  No shuffle; what goes to
    the executors is the model, whose size is fixed by ``bits``.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str]) -> dict:
        tails = box.value.tails(texts)
        grade = tails.sum(1)
        return {"expected_grade": pa.array(grade), "p_poor_or_better": pa.array(tails[:, 0].copy()), "p_good": pa.array(tails[:, -1].copy()), "kept": pa.array(tails[:, -1] >= keep)}

    return per_text(docs, keys, "text", make, "expected_grade double, p_poor_or_better double, p_good double, kept boolean")
