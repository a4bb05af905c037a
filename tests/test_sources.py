"""Blocks of documents by kind, request bodies, word lines, responses in parts, and invariants watched while writing."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import grid as G
from ledgerloom.operators import recon as R
from ledgerloom.sources import files as S

CELL = "struct<s: string, d: double, ts: timestamp>"
TABLE = f"doc_id string, page int, table_idx int, row_idx int, cells array<{CELL}>"
LINE = "recon_id string, side string, row long, ref string, ref_raw string, date string, date_iso string, type string, amount double"


def test_document_kinds(spark):
    cells = lambda *xs: [(x, None, None) for x in xs]
    docs = spark.createDataFrame([(d, k) for d, k in (("p", "pdf"), ("scan", "pdf"), ("t", "docx"), ("w", "docx"), ("none", "docx"), ("x", "csv"))], "doc_id string, kind string")
    table = spark.createDataFrame([("p", 1, 0, 0, cells(" a ", "")), ("p", 1, 0, 1, cells("b")), ("p", 2, 0, 0, cells("one row")), ("t", None, 0, 0, cells("only")), ("x", 1, 0, 0, cells("?"))], TABLE)
    words = spark.createDataFrame([("p", 1, 0, cells("hidden")), ("p", 2, 0, cells("line")), ("t", 1, 0, cells("no"))], f"doc_id string, page int, row_idx int, cells array<{CELL}>")
    text = spark.createDataFrame([("t", 0, "ignored"), ("w", 0, "  "), ("w", 1, "INV-1  5.00"), ("w", 2, "a b"), ("p", 0, "no")], "doc_id string, para_idx int, text string")
    grid, meta = S.document_blocks(docs, table, words, text)
    got = {}
    for r in grid.orderBy("doc_id", "row_idx").collect():
        got.setdefault(r.doc_id, []).append([c.s for c in r.cells])
    assert got == {"p": [["a", None], ["b"], ["line"]], "t": [["only"]], "w": [["INV-1", "5.00"], ["a", "b"]]}
    assert {tuple(r) for r in meta.collect()} == {("p", "pdf", 1, 1, False), ("scan", "pdf", 0, 0, True), ("t", "docx", 1, None, None), ("w", "docx", 0, None, None), ("none", "docx", 0, None, None)}
    _, about = G.extract(grid, meta)
    told = {r.doc_id: (r.confidence, r.warnings) for r in about.collect()}
    assert told["scan"] == (0.0, ["No date column detected", "PDF appears scanned (no extractable text)"]) and len(told) == 5


def plain_rows(words, tol=3.0):
    lines = []
    for w in sorted(words, key=lambda w: (round(w[4], 1), w[2])):
        line = next((x for x in lines if abs(x[0] - w[4]) <= tol), None)
        if line is None:
            lines.append((w[4], [w]))
        else:
            line[1].append(w)
    out = []
    for _, ws in lines:
        ws = sorted(ws, key=lambda w: w[2])
        width = sorted((w[3] - w[2]) / max(len(w[1]), 1) for w in ws)[len(ws) // 2]
        cells = [ws[0][1]]
        for a, b in zip(ws, ws[1:], strict=False):
            if b[2] - a[3] > max(1.8 * width, 7.0):
                cells.append(b[1])
            else:
                cells[-1] += " " + b[1]
        out.append(cells)
    return out


@pytest.mark.parametrize("tol", [3.0, 0.05])
def test_crooked_lines_of_several_pages(spark, tol):
    rng = random.Random(4)
    words, want = [], {}
    for page in (1, 2, 3):
        own = []
        for line in range(40):
            for k in range(rng.randint(1, 6)):
                x = k * 60 + rng.random()
                mils = round(1000 * (line * rng.choice([4.0, 4.0, 2.5]) + rng.uniform(-0.4, 0.4)))
                top = (mils + (mils % 50 == 0)) / 1000  # halves of a tenth are rounded by their digits, not by their binary value
                own.append((len(own), "w" * rng.randint(1, 9), x, x + rng.choice([20.0, 55.0]), top))
        want[page] = plain_rows(own, tol)
        words += [("d", page, *w) for w in own]
    frame = spark.createDataFrame(words, "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double")
    got = {}
    for r in S.words_to_rows(frame, tol).orderBy("page", "row_idx").collect():
        got.setdefault(r.page, []).append([c.s for c in r.cells])
    assert got == want


def test_a_long_page(spark):
    """50,000 words on one page, five to a line."""
    words = spark.range(50_000).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("word_idx"), F.lit("word").alias("text"), (F.col("id") % 5 * 100).cast("double").alias("x0"), (F.col("id") % 5 * 100 + 30).cast("double").alias("x1"), (F.floor(F.col("id") / 5) * 12).cast("double").alias("top"))
    rows = S.words_to_rows(words)
    assert rows.count() == 10_000 and rows.agg(F.sum(F.size("cells"))).collect()[0][0] == 50_000


def test_bodies(spark, tmp_path):
    t = lambda amount, kind="Invoice", ref="A": {"ref": ref, "refRaw": ref, "date": "d", "dateISO": "2026-01-01", "type": kind, "amount": amount}
    body = lambda rid, v, b: json.dumps({"recon_id": rid, "vendorTransactions": v, "booksTransactions": b})
    good = body("a", [t(10), t("10.5"), t(True), t(None), t([1]), t("x", "Payment"), "no object", t(1e3, ref=12)], [t(-2.25, "Payment")])
    lines = [good, "{broken", "[1]", body("", [t(1)], []), body("b", [], []), body("c", {"x": 1}, [t(1)]), json.dumps({"recon_id": "d", "vendorTransactions": [t(1)]}), body(7, [], [t(1)]), ""]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    got, refused, bad = S.read_transactions(spark, str(tmp_path / "in.jsonl"))
    rows = sorted((r.recon_id, r.side, r.row, r.ref, r.amount) for r in got.select("recon_id", "side", "row", F.coalesce("ref", F.lit("-")).alias("ref"), F.coalesce("amount", F.lit(-1.0)).alias("amount")).collect())
    assert rows == [("7", "B", 0, "A", 1.0), ("a", "B", 0, "A", -2.25), ("a", "V", 0, "A", 10.0), ("a", "V", 1, "A", 10.5), ("a", "V", 2, "A", 1.0), ("a", "V", 3, "A", -1.0), ("a", "V", 4, "A", -1.0), ("a", "V", 6, "-", -1.0), ("a", "V", 7, "12", 1000.0)]
    assert sorted((r.recon_id or "", r.reason) for r in refused.collect()) == sorted([("", S.NO_JSON), ("", S.NO_JSON), ("", S.NO_ID), ("b", S.BOTH_EMPTY), ("c", S.NO_LISTS), ("d", S.NO_LISTS)])
    assert [(r.row, r.text) for r in bad.collect()] == [(5, "x")]


def results_of(spark, n):
    line = lambda rid, side, k, amount: (rid, side, k, f"A{k}", f"A{k}", "", "2026-01-01", "Invoice", amount)
    rows = [line(rid, side, k, float(k + (side == "V"))) for rid, m in (("big", n), ("small", 1)) for side in "VB" for k in range(m)] + [("none", "V", 0, "", "", "", "", "Invoice", None)]
    return R.reconcile(spark.createDataFrame(rows, LINE))


def test_responses_in_parts(spark, tmp_path):
    results, summary = results_of(spark, 25)
    for batch in ("one", "two", "one"):
        S.write_responses(results, summary, str(tmp_path), batch, rows=10)
    parts = spark.read.parquet(f"{tmp_path}/parts")
    assert sorted((r.batch, r.recon_id, r.part, r.parts, r.n) for r in parts.collect()) == [(b, *x) for b in ("one", "two") for x in (("big", 0, 3, 10), ("big", 1, 3, 10), ("big", 2, 3, 5), ("none", 0, 1, 0), ("small", 0, 1, 1))]
    assert {("one", "big", 3, 25), ("two", "none", 1, 0)} <= {(r.batch, r.recon_id, r.parts, r.results) for r in spark.read.parquet(f"{tmp_path}/manifest").collect()}
    fields = "ord int, ref string, ref_raw string, date string, date_iso string, type string, vendor_amt double, books_amt double, diff double, status string, tier int, note string"
    back = S.read_responses(spark, str(tmp_path), fields).where("batch = 'one'").drop("batch")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, results.select(back.columns).collect()), key=repr)
    first = json.loads(parts.where("batch = 'one' and recon_id = 'big' and part = 0").collect()[0].response)
    assert first["summary"]["total_references"] == 25 and "summary" not in json.loads(parts.where("batch = 'one' and recon_id = 'big' and part = 1").collect()[0].response)


def test_extract_is_read_back(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"Date,Reference,Amount\n01-01-2026,INV-001,5\n"))], "doc_id string, content binary")
    records, meta = G.extract(S.read_delimited(files)[0])
    for fmt in ("parquet", "json"):
        S.write_extract(records, meta, f"{tmp_path}/{fmt}", fmt)
        assert [(r.ref, r.amount) for r in spark.read.format(fmt).load(f"{tmp_path}/{fmt}/records").collect()] == [("INV-001", 5.0)]
        assert [r.records for r in spark.read.format(fmt).load(f"{tmp_path}/{fmt}/meta").collect()] == [1]


def test_invariants_are_watched(spark, tmp_path):
    _, summary = results_of(spark, 3)
    good = R.Watch(summary)
    good.watched.write.parquet(f"{tmp_path}/good")
    good.check()
    assert good.offenders["all"] == 3 and not good.offenders["names"]
    broken = R.Watch(R.check_invariants(summary.drop("rows_ok", "value_ok").withColumn("matched", F.col("matched") + F.when(F.col("recon_id") != "none", 1).otherwise(0))))
    broken.watched.write.parquet(f"{tmp_path}/broken")
    with pytest.raises(ValueError, match="2 by rows, 0 by value, of 3: big, small"):
        broken.check()
