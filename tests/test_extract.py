from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import grid as G
from ledgerloom.sources import files as S

CSV = b"Date,Reference,Type,Amount\n01-01-2026,INV-001,Invoice,1000\n02-01-2026,INV-002,Invoice,500\n"


def test_small_statement(spark):
    files = spark.createDataFrame([("a", bytearray(CSV))], "doc_id string, content binary")
    records, meta = G.extract(S.read_delimited(files)[0])
    got = sorted((r.ref, r.ref_raw, r.date, r.date_iso, r.type, r.amount, r.row) for r in records.collect())
    assert got == [("INV-001", "INV-001", "01-01-2026", "2026-01-01", "Invoice", 1000.0, 2), ("INV-002", "INV-002", "02-01-2026", "2026-01-02", "Invoice", 500.0, 3)]
    m = meta.collect()[0]
    assert (m.header_row, m.total_rows, m.date_col, m.ref_col, m.type_col, m.amount_col, m.debit_col, m.credit_col) == (0, 3, 0, 1, 2, 3, -1, -1)
    assert (m.data_rows, m.invalid_rows, m.confidence, m.warnings, m.totals_check) == (2, 0, 1.0, [], None)


def test_workbook_cells(spark):
    """Numbers and dates as such: a serial date, a credit note by column type, a bare number as a totals row."""
    day = datetime.datetime(2026, 1, 5)
    t, d, ts = (lambda s: (s, None, None)), (lambda x: (None, x, None)), (lambda x: (None, None, x))
    rows = [("w", 0, [t("Date"), t("Ref"), t("Type"), t("Amount")]), ("w", 1, [ts(day), t("INV-1234"), t("Credit Note"), d(10.5)]), ("w", 2, [d(46023.0), t("INV-1235"), t(""), d(7.0)]), ("w", 3, [t(""), t("1234"), t(""), d(-3.5)]), ("w", 4, [])]
    g = spark.createDataFrame(rows, "doc_id string, row_idx int, cells array<struct<s: string, d: double, ts: timestamp>>")
    records, meta = G.extract(g)
    got = sorted((r.ref, r.date_iso, r.type, r.amount) for r in records.collect())
    assert got == [("INV-1234", "2026-01-05", "Credit Note", -10.5), ("INV-1235", "2026-01-01", "Invoice", 7.0)]
    m = meta.collect()[0]
    assert m.totals_check.document_total == -3.5 and m.totals_check.ok and m.data_rows == 2


def test_delimited_variants():
    assert S.parse_delimited("﻿a;b\n\n\"x\ny\";2".encode()) == [["a", "b"], [], ["x\ny", "2"]]
    assert S.parse_delimited("Date\tAmount\n1\t2\n".encode())[0] == ["Date", "Amount"]
    assert S.parse_delimited("سعر".encode("cp1256")) == [["سعر"]]
    assert S.parse_delimited(b"") == []


def test_word_layout(spark):
    words = [("d", 1, 0, "Total", 0.0, 30.0, 10.0), ("d", 1, 1, "due", 33.0, 50.0, 11.0), ("d", 1, 2, "5.00", 100.0, 120.0, 10.2), ("d", 1, 3, "next", 0.0, 24.0, 20.0)]
    rows = S.words_to_rows(spark.createDataFrame(words, "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double")).collect()
    assert [[c.s for c in r.cells] for r in sorted(rows, key=lambda r: r.row_idx)] == [["Total due", "5.00"], ["next"]]


def test_intake(spark):
    rows = [("1", "a.CSV", 5), ("2", "x.doc", 5), ("3", "y", 5), ("4", "z.pdf", 0), ("5", "z.pdf", 11 << 20), ("6", "q.zip", 1)]
    ok, bad = S.intake_files(spark.createDataFrame(rows, "doc_id string, filename string, length long"))
    assert [r.doc_id for r in ok.collect()] == ["1"] and bad.count() == 5


def test_bad_files_cost_no_other(spark):
    """Bare carriage returns, a field of any length, bytes that are no text, and a file that cannot be parsed."""
    rows = [("cr", CSV.replace(b"\n", b"\r")), ("long", CSV + b"03-01-2026,INV-003,Invoice," + b"x " * 70_000 + b"\n"), ("good", CSV), ("empty", b"")]
    grid, bad = S.read_delimited(spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "doc_id string, content binary"))
    records, _ = G.extract(grid)
    assert {r["doc_id"]: r["count"] for r in records.groupBy("doc_id").count().collect()} == {"cr": 2, "long": 2, "good": 2}
    assert bad.count() == 0


def test_files_that_fail_are_told(spark, monkeypatch):
    import csv

    def fails_on_bad(content):
        if content == b"bad":
            raise csv.Error("no table")
        return [["x", "y"]]

    monkeypatch.setattr(S, "parse_delimited", fails_on_bad)
    grid, bad = S.read_delimited(spark.createDataFrame([("a", bytearray(b"bad")), ("b", bytearray(b"x,y\n"))], "doc_id string, content binary"))
    assert [tuple(r) for r in bad.collect()] == [("a", "Parser failed: no table")] and grid.count() == 1


def test_whole_numbers_in_workbooks(spark):
    """An invoice number that a workbook holds as a whole number keeps its digits, and is a reference if it is long enough."""
    cell = lambda s=None, d=None, i=None: (s, d, None, i)
    rows = [("w", 0, [cell("Date"), cell("Invoice No"), cell("Amount")]), ("w", 1, [cell("05-01-2026"), cell(i=123456789), cell(i=250)]), ("w", 2, [cell("06-01-2026"), cell(i=123456), cell(d=7.5)])]
    g = spark.createDataFrame(rows, "doc_id string, row_idx int, cells array<struct<s: string, d: double, ts: timestamp, i: bigint>>")
    got = sorted((r.ref, r.date_iso, r.amount) for r in G.extract(g)[0].collect())
    assert got == [("123456", "2026-01-06", 7.5), ("123456789", "2026-01-05", 250.0)]


def test_numbers_that_are_no_amounts(spark):
    from ledgerloom.operators import route as V

    rows = [("d", k, f"INV-{k}00", None, None, "Invoice", a) for k, a in enumerate(["1.5", "Infinity", "NaN", "-inf", "1e400", "x", None])]
    records = V.validate_records(spark.createDataFrame(rows, "doc_id string, pos int, ref string, date string, date_iso string, type string, amount string"))
    assert [(r.ref, r.amount) for r in records.collect()] == [("INV-000", 1.5)] and V.agreement(records, records).collect()[0].rate == 1.0
    t = lambda a, kind="Invoice": ("R1", "R1", "", "2026-01-01", kind, a)
    body = [("a", [t("10"), t("NaN"), t("inf", "Payment")], [t("10")])]
    kind = "array<struct<ref: string, refRaw: string, date: string, dateISO: string, type: string, amount: string>>"
    lines, none, bad = S.transactions_to_lines(spark.createDataFrame(body, f"recon_id string, vendor {kind}, books {kind}"))
    from ledgerloom.operators import recon as R

    results, summary = R.reconcile(lines, strict=True)
    assert [(r.status, r.vendor_amt, r.books_amt) for r in results.collect()] == [("MATCHED", 10.0, 10.0)] and summary.count() == 1
    assert none.count() == 0 and [r.text for r in bad.collect()] == ["inf"]


def test_statements_of_one_reconciliation(spark):
    """Two documents of one owner whose rows have the same numbers: payments pair line by line."""
    from ledgerloom.jobs.statements import statements_vs_books

    cell = lambda s: (s, None, None)
    table = lambda doc, ref, amount: [(doc, 0, [cell(x) for x in ("Date", "Reference", "Type", "Amount")]), (doc, 1, [cell(x) for x in ("05-01-2026", ref, "Payment", amount)])]
    grid = spark.createDataFrame(table("x", "RVT-1001", "100") + table("y", "RVT-1002", "200"), "doc_id string, row_idx int, cells array<struct<s: string, d: double, ts: timestamp>>")
    books = spark.createDataFrame([(7, k, f"RVT-100{k}", f"RVT-100{k}", "05-01-2026", "2026-01-05", "Payment", -100.0 * k) for k in (1, 2)], "recon_id long, row long, ref string, ref_raw string, date string, date_iso string, type string, amount double")
    owner = spark.createDataFrame([("x", 7), ("y", 7)], "doc_id string, recon_id long")
    results, summary = statements_vs_books(grid, books, owner, strict=True)
    assert sorted((r.ref, r.status, r.tier, r.vendor_amt) for r in results.collect()) == [("RVT-1001", "MATCHED", 1, -100.0), ("RVT-1002", "MATCHED", 1, -200.0)]
    assert summary.collect()[0].total_references == 2


def test_outputs_are_read_back(spark, tmp_path):
    from ledgerloom.operators import recon as R

    line = lambda side, amount: (1, side, 1, "A", "A", "", "2026-01-01", "Invoice", amount)
    schema = "recon_id long, side string, row long, ref string, ref_raw string, date string, date_iso string, type string, amount double"
    results, summary = R.reconcile(spark.createDataFrame([line("V", 5.0), line("B", 4.0)], schema))
    for fmt in ("parquet", "json"):
        S.write_recon(results, summary, f"{tmp_path}/{fmt}", fmt)
        assert [r.status for r in spark.read.format(fmt).load(f"{tmp_path}/{fmt}/results").collect()] == ["MATCHED"]
        assert spark.read.format(fmt).load(f"{tmp_path}/{fmt}/summary").count() == 1


def test_a_header_row_is_mapped_once(spark, tmp_path):
    """What is asked about the mapping must not go below it, where each column asked about would map the row once more."""
    one = spark.createDataFrame([("a", 0, [("Date",), ("Reference",), ("Amount",)]), ("a", 1, [("01-02-2024",), ("INV-1234",), ("5.00",)])], "doc_id string, row_idx int, cells array<struct<s: string>>")
    G.read_grid(one).write.parquet(str(tmp_path / "read"))
    read = spark.read.parquet(str(tmp_path / "read"))
    uses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("gross amount")
    assert uses(G.find_header(read)) == uses(read.select(G.map_row(F.transform("c", lambda x: x["txt"])).alias("m")))
    assert [(r.header_row, r.date_col, r.ref_col, r.amount_col) for r in G.find_header(read).collect()] == [(0, 0, 1, 2)]
