"""Helpers shared by the corpus operators: whole-text Arrow batches, word splitting, stage tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import cut  # noqa: F401

#: A-Z to a-z and nothing else, on UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\t..\\r, as UTF-8 (bytes.split knows exactly these six)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Bytes of text that a worker takes up at once; a longer text is taken by itself.
SLICE_BYTES = 1 << 22
#: Longer words have a hash of their own.
_PLACES = 64
#: Powers of an odd number over a stretch of places, and of its inverse.
_STRETCH = 1 << 16
_POWER, _BACK = (np.cumprod(np.append(np.uint64(1), np.full(_STRETCH - 1, b, np.uint64))) for b in (0xA0761D6478BD642F, pow(0xA0761D6478BD642F, -1, 2**64)))


def slices(texts: pa.Array, rows: int = 2000, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) of stretches of at most ``rows`` whole texts and ``size`` bytes (or one text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        stop = max(at + 1, min(at + rows, stop))
        yield at, stop - at
        at = stop


def run_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of bytes that are ``inside``, and a 64-bit number for the run (to be mixed by the caller).

    The number is a polynomial in the bytes, as a difference of running sums brought back to one place; runs of more than
    64 bytes have a hash of their own.
    """
    flags = np.zeros(len(inside) + 2, bool)
    flags[1:-1] = inside
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    n = len(data)
    rows = -(-n // _STRETCH)
    sums = np.zeros(rows * _STRETCH + 1, np.uint64)
    value = sums[1:]
    value[:n] = data
    value += np.uint64(1)
    value.reshape(rows, _STRETCH)[:] *= _POWER
    np.cumsum(value, out=value)
    out = (sums[stops] - sums[starts]) * _BACK[starts % _STRETCH]
    for k in np.flatnonzero(starts // _STRETCH != (stops - 1) // _STRETCH).tolist():
        own = data[starts[k] : stops[k]][:_PLACES].astype(np.uint64) + np.uint64(1)
        out[k] = (own * _POWER[: len(own)]).sum(dtype=np.uint64)
    if long := np.flatnonzero(stops - starts > _PLACES).tolist():
        from xxhash import xxh3_64_intdigest

        out[long] = np.array([xxh3_64_intdigest(data[starts[k] : stops[k]].tobytes()) for k in long], np.uint64)
    return starts, out


def per_text(df: DataFrame, keys: list[str], text: str, make: Callable, schema: str, slice_rows: int = 2000) -> DataFrame:
    """``make(texts)`` gives a dict of column lists for a list of whole texts (null: ""); ``keys`` pass through.

    Works a bounded number of rows and bytes at a time; no shuffle.
    """
    keyed = df.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    added = [f.strip().split(" ")[0] for f in schema.split(",")]
    out = ", ".join([*(f"`{k}` {keyed.schema[k].dataType.simpleString()}" for k in keys), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(batch.num_columns - 1), slice_rows):
                part = batch.slice(at, n)
                made = make([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                arrays = [*(part.column(i) for i in range(len(keys)))]
                arrays += [made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], kinds[c]) for c in added]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *added])
        pa.default_memory_pool().release_unused()  # the worker lives on

    kinds = {}
    for field in schema.split(","):
        name, kind = field.strip().split(" ", 1)
        kinds[name] = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]
    return keyed.mapInArrow(run, out)
