"""Plain Python over many small groups: rows are brought together by a shuffle and a sort, and each task walks through its
groups in one go, so a group of ten rows costs no call into Arrow or pandas of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at once; a larger group is taken by itself.
BATCH_ROWS = 1 << 14


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of sorted rows that end where a group ends; ``__group`` tells groups apart."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= BATCH_ROWS and held[0].column("__group")[0] != batch.column("__group")[batch.num_rows - 1]:
            table = pa.Table.from_batches(held)
            group = table.column("__group").to_numpy()
            stop = int(np.flatnonzero(group != group[-1])[-1]) + 1
            yield table.slice(0, stop)
            held = table.slice(stop).combine_chunks().to_batches()
            count = table.num_rows - stop
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], order: list[str], choose: Callable[[dict[str, list]], list[tuple]], schema: str, carried: str | None = None) -> DataFrame:
    """``choose(columns)`` for each group of equal ``keys``, its rows sorted by ``order``, as rows of ``schema``.

    ``carried`` names a key column that each row starts with.  Nulls in keys make a group of their own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    kinds = ([f"`{carried}` {df.schema[carried].dataType.simpleString()}"] if carried else []) + [schema]
    out_schema = ", ".join(kinds)
    # Groups are told apart by a change of their keys, written as one text, so that any kind of key will do.
    keyed = df.withColumn("__group", F.to_json(F.struct(*keys)))
    sorted_ = keyed.repartition(n, *keys).sortWithinPartitions(*keys, "__group", *order)
    empty = df.sparkSession.createDataFrame([], out_schema)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in empty.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            group = table.column("__group").to_numpy()
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
            data = {c: table.column(c).to_pylist() for c in columns}
            rows: list[tuple] = []
            for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
                got = choose({c: x[a:b] for c, x in data.items()})
                rows += [(data[carried][a], *r) for r in got] if carried else got
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return sorted_.mapInArrow(run, out_schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind]


def spread_row_number(df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the row's number within ``keys`` by ``bucket``, then ``order``.

    Only rows of one bucket are sorted together; buckets are counted, and the counts before each bucket added up, so a
    key that holds a third of all rows is not sorted by one task.
    """
    places = [f"__b{k}" for k in range(len(bucket))]
    dealt = df.withColumns(dict(zip(places, bucket, strict=True)))
    counts = dealt.groupBy(*keys, *places).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy(*places).rowsBetween(W.unboundedPreceding, -1)
    named = [F.col(c).alias(f"__of_{c}") for c in (*keys, *places)]
    offset = counts.select(*named, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, *places)]
    joined = dealt.join(offset, same).select(*dealt.columns, "__before")
    own = F.row_number().over(W.partitionBy(*keys, *places).orderBy(*order))
    return joined.withColumn(name, (own + F.col("__before")).cast("int")).drop(*places, "__before")
