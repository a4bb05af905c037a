"""Quality rules: counts over words and lines, and bands of zstandard ratios over the document and its chunks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LEVEL = 3


@dataclass(frozen=True)
class Band:
    """Ratio = compressed bytes / bytes; texts from ``least`` bytes on, up to the next band's least."""

    least: int
    low: float
    high: float


#: Short texts compress badly (the frame alone is over ten bytes) and long ones well, so limits follow the length.
#: The upper ones lie above all texts of 50 words or more in sf0.1 (at most 0.745, 0.708, 0.698, 0.636, 0.592,
#: 0.543, 0.521, 0.478 and 0.419 from 256 bytes on) by 0.04 or more, and below random base64 and CJK words (0.72 and more).
DOCUMENT_BANDS = (
    Band(0, 0.0, 9.9), Band(256, 0.22, 0.80), Band(384, 0.22, 0.77), Band(512, 0.22, 0.74), Band(768, 0.22, 0.70),
    Band(1024, 0.16, 0.65), Band(1536, 0.16, 0.61), Band(2048, 0.16, 0.59), Band(4096, 0.10, 0.56), Band(32768, 0.06, 0.50),
)
CHUNK_BYTES = 2048
#: Chunks of those texts reach 0.529, of random letters and digits 0.655.
CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 0.10, 0.60, 0.5


@lru_cache(maxsize=1)
def compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL)


def band_of(size: int) -> Band:
    return [b for b in DOCUMENT_BANDS if size >= b.least][-1]


def compression(raw: bytes) -> tuple[float, float, bool]:
    """Ratio of the whole, share of chunks outside the chunk band, and whether all bands hold.

    Chunks of CHUNK_BYTES follow one another, and the last one ends with the text, so all bytes are in one.  A text
    shorter than a chunk is a chunk of its own, held to the limits of its length.
    """
    if not raw:
        return 0.0, 0.0, True
    box = compressor()
    ratio = len(box.compress(raw)) / len(raw)
    band = band_of(len(raw))
    fits = band.low <= ratio <= band.high
    if len(raw) < CHUNK_BYTES:
        return ratio, float(not fits), fits
    starts = [*range(0, len(raw) - CHUNK_BYTES, CHUNK_BYTES), len(raw) - CHUNK_BYTES]
    bad = sum(not CHUNK_LOW <= len(box.compress(raw[i : i + CHUNK_BYTES])) / CHUNK_BYTES <= CHUNK_HIGH for i in starts)
    return ratio, bad / len(starts), fits and bad <= CHUNK_SHARE * len(starts)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) < 2_000_000:
        code = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    else:  # three numbers no longer fit into 64 bits
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        code = pair[:-1].astype(np.int64) * len(number) + ids[2:]
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return 0
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= again
    return int(cover.sum())


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``ratio``, ``bad_chunks`` and ``kept``.

    Null text is empty text: no words, so it fails the base rule.  ``kept`` needs the base rule and every band.
    """

    def make(texts: list[str]) -> dict:
        out: dict = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")}
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            words = raw.split()
            n, repeats = len(words), repeated_words(words)
            ratio, bad, fits = compression(raw)
            failed = n < 50 or 100 * repeats > 50 * n
            row = (n, len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), duplicate_lines(t), repeats, failed, fits and not failed, ratio, bad)
            for c, v in zip(out.values(), row, strict=True):
                c.append(v)
        return out

    return per_text(docs, [key], text, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double")
