from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def table(spark, values, make):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["k"])]


def test_parse_amount(spark):
    given = ["(1,234.50)", "AED 1,000", "100 CR", "(100 CR)", "AED (100)", "nil", None, "", "-", "12E4", "nan", "1_000", "-5", "--5", " 7 Dr. ", "₹ 3", "١٢", "()", "1d"]
    want = [-1234.5, 1000.0, -100.0, 100.0, None, None, None, None, None, 120000.0, None, None, -5.0, 5.0, 7.0, 3.0, 12.0, None, None]
    assert table(spark, given, S.parse_amount) == want


def test_parse_date(spark):
    given = ["1-2-2026", "31-02-2026", "5 Jan 2026", "1/2/75", "1/2/26", "2026/3/4", "Oct 5, 2025", "5-DEC-24", "5 September 2025", "5  Sept 2025", "1-2/2026", None, "x"]
    want = ["2026-02-01", None, "2026-01-05", "1975-02-01", "2026-02-01", "2026-03-04", "2025-10-05", "2024-12-05", "2025-09-05", None, None, None, None]
    assert table(spark, given, S.parse_date_iso) == want


def test_references(spark):
    assert table(spark, [" inv 001. ", None, "a b;"], S.norm_ref) == ["INV001", "", "AB"]
    assert table(spark, ["CN-001", "CN001", "rvt-1", "DN 5", None], S.type_from_ref) == ["Credit Note", None, "Payment", "Debit Note", None]
    assert table(spark, ["INV-0007", "INV-000", None], S.ref_zstrip) == ["7", "000", ""]
    assert table(spark, ["INV-001", "01-02-2026", "1.012345678", "0123456789", None, "hello"], S.looks_like_ref) == [True, False, False, True, False, False]
    assert table(spark, ["paid INV-001 now", "INV-001", "no ref"], S.extract_ref_token) == ["INV-001", "INV-001", "no ref"]


def test_types_and_headers(spark):
    assert table(spark, ["Bank transfer", "credit  note", "x dn y", "Bill 5", "goods"], S.infer_type) == ["Payment", "Credit Note", "Debit Note", "Bill", "Invoice"]
    assert table(spark, ["Grand total", "totally", "Balance c/f"], S.is_total_row) == [True, False, True]
    assert table(spark, ["Opening  balance", "balance as on 1", "balance"], S.is_opening_row) == [True, True, False]
    assert table(spark, ["Date", "Invoice No.", "INV-001", "Total Cr Amount", None, "x", "Our ref no", "dr"], S.match_header) == ["date", "ref", None, "credit", None, None, "ref", "debit"]
    assert table(spark, [" Receipt ", "payments", None], S.is_payment) == [True, False, False]
    assert table(spark, ["2026-03-01", "2026-2", None], S.day_ordinal) == [2026 * 372 + 3 * 31 + 1, None, None]
    rows = spark.createDataFrame([("806G000834", "8066000834"), ("INV001", "INV001"), ("AB1", "AB2")], "a string, b string")
    assert [r[0] for r in rows.select(S.one_typo(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_serial_date(spark):
    rows = spark.createDataFrame([(46023.0,), (20000.0,), (60000.0,)], "d double")
    assert [r[0] for r in rows.select(S.excel_serial_date(F.col("d"))).collect()] == ["2026-01-01", None, None]


def test_short_ways_give_what_the_long_way_does(spark):
    """Plain amounts and texts that cannot be one are told by a look; so are texts that cannot be a reference."""
    amounts = {"1,234.50": 1234.5, "12": 12.0, "1,2,3.": 123.0, "5.": 5.0, ".5": 0.5, "1.5E3": 1500.0, "2-1": None, "12-03-2024": None, "3/4": None, "INV-1": None, "7 CR": -7.0, "(8 Dr.)": -8.0, "-9": -9.0, "١٢": 12.0, "AED 4": 4.0, "ا 4": None, "4x": None, "1 234,5": 12345.0, "99999999999999": None, "1.2.3": None}
    got = spark.createDataFrame([(a,) for a in amounts], "a string").select("a", S.parse_amount(F.col("a")).alias("x")).collect()
    assert {r.a: r.x for r in got} == amounts
    dates = {"5/3/99": "1999-03-05", "31-02-2024": None, "2024-2-29": "2024-02-29", "2023/2/29": None, "3 Foo 2024": None, "Jan 7, 2024": "2024-01-07", "07-DEC-68": "2068-12-07", "1-13-2024": None, "0-1-2024": None}
    got = spark.createDataFrame([(a,) for a in dates], "a string").select("a", S.parse_date_iso(F.col("a")).alias("x")).collect()
    assert {r.a: r.x for r in got} == dates
    refs = {"1,234.50": False, "123456789": True, "0123456": False, "01234567": True, "1,123456789.": False, "012345,6": False, "No 123": True}
    cells = spark.createDataFrame([(a, a) for a in refs], "a string, s string").select("a", S.read_cell(F.struct("s", F.lit(None).cast("double").alias("d"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("i")))["ref"].alias("x"), S.looks_like_ref(F.col("s")).alias("y")).collect()
    assert all(r.x == r.y for r in cells)


def test_cells_told_by_one_look_are_read_as_by_all(spark):
    """Amounts, dates, references and words have short ways; what comes out is what the full patterns say, and nothing asks for
    the type of a whole expression at every row, as an item taken out of a transformed array does."""
    texts = [
        "", " ", "Invoice", "nil", "-", "1,234.56", "1234567", "12", "999,999,999,999,999.99", "1,23.5", "1.5E3", "0123456", "12.", "1,234.5678901", "05-06-2021", "31-02-2021", "05/06/2021", "05-06/2021", "12/34/5678", "5-6-21",
        "INV-00000123", "CN-00000123", "AED-000123", "V-123", "INV-12", "INV-00000123\n", "INV 00000123", "GKVW#x", "#", "PHUB1", "a١٢٣", "١٢", " 5.00", "1,234.56\n", "KAB-1234", "(5.00)", "5.00 CR", "Mar 5, 2020", "2020-01-02",
        "5 March  2020", "05-06-2021 ", "1,234.56-", "0000-00-00", "00-00-0000", "INV/1/2", "\x001", "ſub total 5", "K1-2", "12345678-1234",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    cell = F.struct("s", F.lit(None).cast("double").alias("d"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("i"))
    iso = S.parse_date_iso(F.col("s"))
    hint = F.coalesce(iso.isNull() & ~F.col("s").rlike(S.NO_REF) & F.col("s").rlike("(?iU)" + S.REF_HINT), F.lit(False))
    got = df.select("s", S.read_cell(cell).alias("c")).select("s", "c.*")
    assert "transform(array(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = df.select("s", F.col("s").alias("txt"), S.parse_amount(F.col("s")).alias("amt"), iso.alias("iso"), hint.alias("ref"), (F.col("s") != "").alias("full"))
    assert {r.s: r for r in got.collect()} == {r.s: r for r in want.collect()}
