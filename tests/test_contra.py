"""Rows that cancel: pairs against plain loops, amounts against pairs, and many equal ones at once."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import recon as R

SCHEMA = "recon_id long, side string, row long, ref string, ref_raw string, date string, date_iso string, type string, amount double"


def open_rows(seed):
    """Of several reconciliations: (id, reference, cents), in the order in which rows come about."""
    rng = random.Random(seed)
    amounts = [0, 0, 30, -30, 50, -50, -120, 70, 10_000, -10_000, 10_050, -9_980, 777]
    return {rid: sorted((f"R{rng.randint(0, 10**6):07}", rng.choice(amounts)) for _ in range(rng.choice([0, 1, 12, 40]))) for rid in range(12)}


def as_results(spark, rows):
    flat = [(rid, "V", k, ref, ref, "", "2026-01-01", "Invoice", c / 100) for rid, own in rows.items() for k, (ref, c) in enumerate(own)]
    v = R.aggregate_refs(R.split_lanes(spark.createDataFrame(flat, SCHEMA))[0])
    return R.unmatched_results(v, v.where("false"))


def plain(own, tol=100):
    return [(a, b) for a, b in itertools.combinations(own, 2) if a[1] != 0 and abs(a[1] + b[1]) <= tol]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_classes_and_notes(spark, seed):
    rows = open_rows(seed)
    open_v = as_results(spark, rows)
    got = {}
    for r in R.contra_pairs(open_v, 100).collect():
        got.setdefault(r.recon_id, set()).add((r.a, r.b))
    want = {rid: {(a[0], b[0]) for a, b in plain(own)} for rid, own in rows.items() if plain(own)}
    assert got == want
    counts = {}
    for r in R.contra_classes(open_v, 100).collect():
        counts[r.recon_id, round(r.amount * 100), round(r.offsets * 100)] = r.pairs
    by_class = {}
    for rid, own in rows.items():
        for a, b in plain(own):
            key = (rid, max(a[1], b[1]), min(a[1], b[1]))
            by_class[key] = by_class.get(key, 0) + 1
    assert counts == by_class

    for most, shown in ((10**6, 100), (0, 3)):
        notes, findings = R.contra_notes(open_v, 100, shown, most)
        said = {(r.recon_id, r.by_name): r.said for r in notes.collect()}
        expected = {}
        for rid, own in rows.items():
            for ref, c in own:
                partners = [b if a == (ref, c) else a for a, b in plain(own) if (ref, c) in (a, b)]
                if not partners:
                    continue
                named = partners if most else [p for p in partners if p[1] != 0][:shown]
                rest = len(partners) - len(named)
                expected[rid, ref] = "".join(f" · possible contra with {p[0]}" for p in named) + (f" · and {rest} more" if rest else "")
        assert said == expected
        assert findings.count() == sum(map(len, want.values())) if most else findings.where("k = 2").count() == 0


def test_many_equal_rows_that_cancel(spark):
    """50,000 rows of 100.00 and as many of -100.00 in one reconciliation: 2.5 * 10^9 pairs, in time that follows the rows."""
    side = spark.range(100_000).select(F.lit(1).cast("long").alias("recon_id"), F.lit("V").alias("side"), F.col("id").alias("row"), F.format_string("X%06d", "id").alias("ref"), F.lit("").alias("ref_raw"), F.lit("").alias("date"), F.lit("2026-01-01").alias("date_iso"), F.lit("Invoice").alias("type"), F.when(F.col("id") % 2 == 0, 100.0).otherwise(-100.0).alias("amount"))
    results, summary = R.reconcile(side, strict=True)
    s = summary.collect()[0]
    assert s.extra_in_vendor == 100_000 and s.findings == ["possible vendor-side contra: 50000 rows of 100.0 offset 50000 rows of -100.0"]
    r = results.where("ref = 'X000004'").collect()[0]
    assert r.note.startswith("missing in our books · possible contra with X000001 · possible contra with X000003") and r.note.endswith(" · and 49900 more")


@pytest.fixture(scope="module")
def heap(tmp_path_factory):
    """Orders of one customer, all of one price, each with a line of its own that cancels it: 22,500 pairs."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    at = tmp_path_factory.mktemp("heap")
    n = 150
    orders = {"o_orderkey": [18 + 20 * k for k in range(n)], "o_custkey": [7] * n, "o_totalprice": [60_000.0] * n, "o_orderdate": pa.array([datetime.datetime(1996, 1, 2)] * n, pa.timestamp("us"))}
    pq.write_table(pa.table(orders), at / "orders.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["r21_reconcile", "r21_contended", "r21_contended_summary", "r21_summary", "r19_findings"])
def test_queries_tell_every_pair(spark, heap, name):
    """More pairs than ``PAIRS`` and more partners than ``PARTNERS``: the rows are those of the SQL all the same."""
    import duckdb

    from ledgerloom.queries import reconciliation as Q

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{heap}/orders.parquet')")
    found = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in found.description]
    tidy = lambda r: repr([round(x, 4) + 0.0 if isinstance(x, float) else x for x in r])
    assert sorted(map(tidy, Q.QUERIES[name](spark, heap).select(columns).collect())) == sorted(map(tidy, found.fetchall()))
