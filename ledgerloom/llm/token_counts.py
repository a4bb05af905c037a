"""Token counts by section: whole documents are encoded once, token spans are joined to section spans.

Rule for a token that crosses a border: ``first`` gives it to the section of its first character, ``last`` to that of
its last, ``most`` to the section that holds most of its characters (the earlier where they tie).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RULES = ("first", "last", "most")
#: A section is a line with its line break; text after the last break is one more.
SECTION = r"[^\n]*\n|[^\n]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding and the length in bytes of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and last character (inclusive) of each token.  A token of a part of a character spans it all."""
    encoding, lengths = encoder(path)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends - 1
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1]


def attribute(starts: np.ndarray, lasts: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a border; ``borders`` holds the sections' first characters."""
    a = np.searchsorted(borders, starts, "right") - 1
    b = np.searchsorted(borders, lasts, "right") - 1
    crossing = a != b
    if rule == "last":
        return b, crossing
    if rule == "most" and crossing.any():
        a = a.copy()
        for k in np.flatnonzero(crossing):
            inner = np.arange(a[k], b[k] + 1)
            low = np.maximum(borders[inner], starts[k])
            high = np.minimum(np.append(borders[inner[1:]], lasts[k] + 1), lasts[k] + 1)
            a[k] = inner[np.argmax(high - low)]
    return a, crossing


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, section: str = SECTION, rule: str = "first", slice_rows: int = 500) -> DataFrame:
    """A row per section: ``key, section, start, end, n_tokens, n_crossing, doc_tokens`` (spans in code points, end exclusive).

    ``n_crossing`` counts the section's tokens that reach into another one; over a document's sections ``n_tokens``
    adds up to ``doc_tokens``.  Null or empty text is one section 0 of no characters and no tokens.  A section that
    starts in the middle of what ``section`` leaves uncovered runs on to the next start.  Repeated rows each get
    their sections.  No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    where = path or default_path()
    keyed = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    kind = keyed.schema["__key"].dataType.simpleString()
    cuts = regex.compile(section)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in slices(batch.column(1), slice_rows):
                part = batch.slice(at, size)
                rows, cols = [], [[], [], [], [], [], []]
                for k, t in enumerate(part.column(1).to_pylist()):
                    t = t or ""
                    borders = np.array([m.start() for m in cuts.finditer(t) if m.end() > m.start()] or [0], np.int64)
                    borders[0] = 0
                    starts, lasts = token_spans(t, where) if t else (np.empty(0, np.int64),) * 2
                    own, crossing = attribute(starts, lasts, borders, rule)
                    n = len(borders)
                    rows += [k] * n
                    for c, v in zip(cols, (np.arange(n), borders, np.append(borders[1:], len(t)), np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n), np.full(n, len(starts))), strict=True):
                        c.append(v)
                arrays = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in cols]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(arrays[0].astype(np.int32)), *map(pa.array, arrays[1:])], names=[key, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return keyed.mapInArrow(run, f"`{key}` {kind}, section int, start long, `end` long, n_tokens long, n_crossing long, doc_tokens long")
