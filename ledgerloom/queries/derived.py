"""Inputs derived from the given tables, in SQL that Spark and DuckDB read alike, so that both sides start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = """
  SELECT o_custkey AS owner, o_orderkey AS k, lpad(CAST(o_orderkey AS STRING), 8, '0') AS k8,
         translate(CAST(o_orderkey AS STRING), '0123456789', 'ABCDEFGHIJ') AS abc,
         CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
         o_orderkey % 20 AS m, o_custkey % 2 AS odd
  FROM orders"""

#: What becomes of an order by its key modulo 20 (and, of payments, by whether its customer's key is odd): side, line number,
#: reference, share of the amount, type.
_V, _B, _ANY = "V", "B", (0, 1)
CASES = (
    *((m, _ANY, (_B, 1, "inv", "all", "Invoice"), (_V, 2, "inv", "most", "Invoice"), (_V, 3, "inv", "rest", "Invoice")) for m in range(9)),
    (9, _ANY, (_B, 1, "inv", "all", "Invoice"), (_V, 2, "inv", "cents over", "Invoice")),
    (10, _ANY, (_B, 1, "inv", "all", "Invoice"), (_V, 2, "inv", "units over", "Invoice")),
    (11, _ANY, (_B, 1, "inv", "all", "Invoice"), (_V, 2, "invk", "all", "Bill")),
    (12, _ANY, (_B, 1, "inv", "all", "Invoice"), (_V, 2, "short", "all", "Invoice")),
    (13, _ANY, (_B, 1, "inv", "all", "Invoice"), (_B, 2, "bill", "seven over", "Bill"), (_V, 3, "doc", "all", "Invoice")),
    (14, _ANY, (_B, 1, "inv", "all", "Invoice"), (_V, 2, "typo", "all", "Invoice")),
    (15, _ANY, (_B, 1, "inv", "all", "Invoice"), (_V, 2, "xq", "all", "Invoice")),
    (16, _ANY, (_B, 1, "pa", "less", "Invoice"), (_B, 2, "pb", "other", "Invoice"), (_V, 3, "inv", "all", "Invoice")),
    (17, _ANY, (_B, 1, "inv", "all", "Invoice")),
    (18, _ANY, (_V, 1, "inv", "all", "Invoice"), (_V, 2, "ct", "against", "Credit Note")),
    (19, _ANY, (_B, 1, "rvt", "all", "Payment")),
    (19, (0,), (_V, 2, "rvt", "against", "Payment")),
    (19, (1,), (_V, 3, "tr", "against", "Receipt")),
)
_REF = "CASE x.ref WHEN 'inv' THEN 'INV-' || k8 WHEN 'invk' THEN 'INVK' || k8 WHEN 'short' THEN 'INV-' || CAST(k AS STRING) WHEN 'bill' THEN 'BILL-00' || k8 WHEN 'doc' THEN 'DOC/' || k8 WHEN 'typo' THEN '1NV-' || k8 WHEN 'rvt' THEN 'RVT-' || k8 ELSE upper(x.ref) || abc END"
_CENTS = """CASE x.share WHEN 'all' THEN c WHEN 'against' THEN -c WHEN 'most' THEN CAST(floor(c * 0.6) AS BIGINT) WHEN 'rest' THEN c - CAST(floor(c * 0.6) AS BIGINT) WHEN 'less' THEN CAST(floor(c * 0.4) AS BIGINT)
    WHEN 'other' THEN c - CAST(floor(c * 0.4) AS BIGINT) WHEN 'cents over' THEN c + 50 WHEN 'seven over' THEN c + 700 WHEN 'units over' THEN c + 2500 END"""
_SMALL_TABLE = ", ".join(f"({2 * m + odd}, '{side}', {n}, '{ref}', '{share}', '{kind}')" for m, odds, *lines_ in CASES for odd in odds for side, n, ref, share, kind in lines_)


def _lines(owner: str, where: str = "true", orders: str = ORDERS) -> str:
    """The orders, read once, joined to what becomes of them."""
    return f"""WITH o AS ({orders}), x AS (SELECT * FROM (VALUES {_SMALL_TABLE}) AS t(m2, side, n, ref, share, kind))
  SELECT {owner} AS recon_id, x.side, k * 10 + x.n AS row, {_REF} AS ref, {_REF} AS ref_raw, d AS date, d AS date_iso, x.kind AS type, CAST({_CENTS} AS DOUBLE) / 100 AS amount
  FROM o JOIN x ON o.m * 2 + o.odd = x.m2 WHERE {where}"""


LINES = _lines("owner")
#: One reconciliation holds the lines of every second customer.
SKEWED = _lines("CASE WHEN owner % 2 = 0 THEN 0 ELSE owner END")

#: Every order has one of some twenty amounts, so that items of a reconciliation compete for one another.
CONTENDED = _lines("owner", orders=ORDERS.replace("CAST(round(o_totalprice * 100) AS BIGINT) AS c", "CAST(floor(o_totalprice / 25000) * 2500000 + 60 * (o_orderkey % 3) AS BIGINT) AS c"))

_AMOUNT = "CASE WHEN c >= 100000 THEN CAST(CAST(floor(c / 100000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(c / 100) AS BIGINT) % 1000 AS STRING), 3, '0') ELSE CAST(CAST(floor(c / 100) AS BIGINT) AS STRING) END || '.' || lpad(CAST(c % 100 AS STRING), 2, '0')"
ITEMS = f"""
  SELECT owner AS doc_id, owner % 6 AS layout, k, k8, c, d, m, abc, {_AMOUNT} AS amt, substr(d, 9, 2) || '-' || substr(d, 6, 2) || '-' || substr(d, 1, 4) AS dmy,
         CAST(row_number() OVER (PARTITION BY owner ORDER BY k) AS INT) - 1 AS i, CAST(count(*) OVER (PARTITION BY owner) AS INT) AS n, sum(c) OVER (PARTITION BY owner) AS total
  FROM ({ORDERS}) AS o"""
_OFF = "CASE WHEN doc_id % 12 >= 6 THEN 10000 ELSE 0 END"
_TOTAL = _AMOUNT.replace("c ", "t ").replace("c)", "t)").replace("(c", "(t")
#: Rows of up to four cells ('' is an empty cell, null is none) by layout: whether a row comes once a document, its number, its cells.
_SHAPES = (
    *((k, 1, "0", "'Date'", "'Reference'", "'Type'", "'Amount'") for k in (0, 4, 5)),
    (1, 1, "0", "'ACME TRADING LLC'", "''", "''", "NULL"), (1, 1, "1", "'Statement for the period'", "''", "''", "NULL"), (1, 1, "2", "'DOCUMENT'", "'DOCUMENT'", "'AMOUNT'", "NULL"), (1, 1, "3", "'DATE'", "'NUMBER'", "''", "NULL"),
    (2, 1, "0", "'Date'", "'Doc No'", "'Debit'", "'Credit'"),
    (4, 1, "1", "'Opening balance'", "''", "''", "'1,000.00'"), (4, 1, "n + 2", "'Total'", "''", "''", "tamt"),
    (5, 1, "n + 1", "''", "''", "''", "''"),
    *((k, 0, at, "dmy", "'INV-' || k8", "'Invoice'", "amt") for k, at in ((0, "i + 1"), (5, "i + 1"), (4, "i + 2"), (5, "n + 2 + i"))),
    *((k, 0, at, "dmy", "'INV-' || k8", "amt", "NULL") for k, at in ((1, "i + 4"), (3, "i"))),
    (2, 0, "i + 1", "dmy", "CASE WHEN i % 5 = 4 THEN 'CN-' ELSE 'INV-' END || k8", "CASE WHEN i % 5 = 4 THEN '' ELSE amt END", "CASE WHEN i % 5 = 4 THEN amt ELSE '' END"),
)
_pick = lambda k: "CASE x.shape " + " ".join(f"WHEN {j} THEN {shape[k]}" for j, shape in enumerate(_SHAPES)) + " END"
ROWS = f"""WITH items AS ({ITEMS}), i AS (SELECT *, {_TOTAL} AS tamt FROM (SELECT *, CAST(total AS BIGINT) + {_OFF} AS t FROM items) AS y), x AS (SELECT * FROM (VALUES {", ".join(f"({s[0]}, {s[1]}, {j})" for j, s in enumerate(_SHAPES))}) AS t(of_layout, once, shape))
  SELECT doc_id, {_pick(2)} AS row_idx, {", ".join(f"{_pick(3 + k)} AS c{k}" for k in range(4))} FROM i JOIN x ON i.layout = x.of_layout WHERE x.once = 0 OR i.i = 0"""
#: What the records of those grids must be, straight from the orders.
RECORDS = f"""WITH items AS ({ITEMS})
  SELECT CAST(doc_id AS STRING) AS doc_id, CASE WHEN layout = 2 AND i % 5 = 4 THEN 'CN-' ELSE 'INV-' END || k8 AS ref, dmy AS date, d AS date_iso,
         CASE WHEN layout = 2 AND i % 5 = 4 THEN 'Credit Note' ELSE 'Invoice' END AS type,
         CAST(CASE WHEN layout = 2 AND i % 5 = 4 THEN -c ELSE c END AS DOUBLE) / 100 AS amount,
         CAST(i + CASE layout WHEN 3 THEN 1 WHEN 1 THEN 5 WHEN 4 THEN 3 ELSE 2 END AS INT) AS row
  FROM items"""
#: The second extraction: every 70th record is left out, every 50th amount is off by one.
CANDIDATES = f"""SELECT doc_id, CAST(row AS INT) AS pos, ref, date, CASE WHEN row % 9 = 0 THEN date ELSE date_iso END AS date_iso, CASE WHEN row % 7 = 0 THEN '' ELSE type END AS type,
  CASE WHEN k % 90 = 0 THEN 'n/a' ELSE CAST(CASE WHEN k % 50 = 0 THEN amount + 1 ELSE amount END AS STRING) END AS amount
  FROM (SELECT *, CAST(substr(ref, length(ref) - 7, 8) AS BIGINT) AS k FROM ({RECORDS}) AS r) AS x WHERE k % 70 <> 0"""

#: Texts for the scalar operators: variants of each order's amount, date and reference.
TEXTS = f"""WITH o AS ({ORDERS}), t AS (SELECT *, {_AMOUNT} AS amt, k % 13 AS v, substr(d, 1, 4) AS yy, substr(d, 6, 2) AS mm, substr(d, 9, 2) AS dd FROM o)
  SELECT k,
    CASE v WHEN 0 THEN '(' || amt || ')' WHEN 1 THEN 'AED ' || amt WHEN 2 THEN amt || ' CR' WHEN 3 THEN '(' || amt || ' CR)' WHEN 4 THEN 'AED (' || amt || ')' WHEN 5 THEN 'nil' WHEN 6 THEN '-' || amt
      WHEN 7 THEN ' ' || amt || ' Dr. ' WHEN 8 THEN amt || '-' WHEN 9 THEN '$' || amt WHEN 10 THEN k8 || 'x' WHEN 11 THEN '1.5E3' ELSE '' END AS amount_text,
    CASE v WHEN 0 THEN dd || '-' || mm || '-' || yy WHEN 1 THEN dd || '/' || mm || '/' || yy WHEN 2 THEN d WHEN 3 THEN yy || '/' || mm || '/' || dd WHEN 4 THEN dd || '-' || mm || '-' || substr(yy, 3, 2) WHEN 5 THEN dd || '/' || mm || '/' || substr(yy, 3, 2)
      WHEN 6 THEN dd || '  Jan ' || yy WHEN 7 THEN dd || ' March ' || yy WHEN 8 THEN 'Oct ' || dd || ', ' || yy WHEN 9 THEN dd || '-DEC-' || yy WHEN 10 THEN '31-02-' || yy WHEN 11 THEN dd || '-sep-' || substr(yy, 3, 2) ELSE k8 END AS date_text,
    CASE v WHEN 0 THEN ' inv ' || k8 || '. ' WHEN 1 THEN 'CN-' || k8 WHEN 2 THEN 'CN' || k8 WHEN 3 THEN 'paid by ' || 'RVT-' || k8 || ' today' WHEN 4 THEN 'PMT ' || abc WHEN 5 THEN 'dn-' || k8 WHEN 6 THEN dd || '-' || mm || '-' || yy WHEN 7 THEN 'Bill no ' || k8
      WHEN 8 THEN 'credit  note ' || abc WHEN 9 THEN 'Sub-Total ' || amt WHEN 10 THEN 'Opening Balance as on' WHEN 11 THEN 'bank transfer ' || abc ELSE abc END AS ref_text,
    CAST(20000 + (k * 37) % 45000 - 2000 AS DOUBLE) + 0.25 AS serial, CASE WHEN v = 3 THEN 'x-' || mm ELSE d END AS iso_text,
    CASE v WHEN 0 THEN 'Payment' WHEN 1 THEN ' RECEIPT ' WHEN 2 THEN 'payment made' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'Invoice' END AS type_text, abc, k8
  FROM t"""


def tables(spark: SparkSession, sf_dir: str) -> None:
    """The orders as a view; a table of fewer splits than the cluster has cores (one row group is one split) is dealt out."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cores = spark.sparkContext.defaultParallelism
    if orders.rdd.getNumPartitions() < cores:
        orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").repartition(cores)
    orders.createOrReplaceTempView("orders")


def from_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(sql)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, LINES)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.struct(F.col(c).alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("i"))
    rows = from_sql(spark, sf_dir, ROWS)
    cells = F.filter(F.array(*map(cell, ("c0", "c1", "c2", "c3"))), lambda c: c["s"].isNotNull())
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("row_idx").cast("int").alias("row_idx"), cells.alias("cells"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, CANDIDATES)
