"""Queries of the scalar operators (C1-C15) and of S5, each over variants made from every order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.files import split_line
from .derived import TEXTS, from_sql


def _q(make: Callable[[], dict]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: from_sql(spark, sf_dir, TEXTS).select("k", *[c.alias(n) for n, c in make().items()])


def _quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CURRENCY = S.CURRENCY.replace("(?iU)", "(?i)")
_AMOUNT = rf"""
  (SELECT CASE WHEN s IN ({_quoted(S.NO_AMOUNT)}) OR NOT regexp_matches(d, '{S.NUMBER}') THEN NULL
     ELSE CAST(d AS DOUBLE) * CASE WHEN (CAST(w AS INT) + CAST(cr AS INT) + CAST(starts_with(b, '-') AS INT)) % 2 = 1 THEN -1 ELSE 1 END END
   FROM (SELECT *, CASE WHEN starts_with(b, '-') THEN substr(b, 2) ELSE b END AS d FROM
     (SELECT s, w, upper(regexp_extract(i, '(?i)\b(DR|CR)\b\.?$', 1)) = 'CR' AS cr,
        trim(replace(replace(regexp_replace(regexp_replace(i, '(?i)\b(DR|CR)\b\.?$', ''), '{_CURRENCY}', '', 'g'), ',', ''), ' ', '')) AS b FROM
       (SELECT s, w, CASE WHEN w THEN substr(s, 2, length(s) - 2) ELSE s END AS i FROM
         (SELECT s, starts_with(s, '(') AND ends_with(s, ')') AND length(s) >= 2 AS w FROM (SELECT trim(amount_text) AS s))))))"""
_PART = {"d": (r"\d{1,2}", "%d"), "m": (r"\d{1,2}", "%m"), "Y": (r"\d{4}", "%Y"), "y": (r"\d{2}", "%y"), "b": ("[A-Za-z]{3}", "%b"), "B": ("[A-Za-z]{4,9}", "%B")}
#: The accepted forms of dates.  Numeric ones: these orders with a dash or a slash between; the year in two digits comes last.
_FORMS = [sep.join(order) for order in ("dmY", "dmy", "Ymd") for sep in "-/"] + ["d b Y", "d B Y", "b d, Y", "d-b-Y", "d-b-y"]
_FORMATS = [tuple("".join(_PART[c][k] if c in _PART else c for c in form) for k in (0, 1)) for form in _FORMS]


def _iso(c: str) -> str:
    s = rf"regexp_replace(trim({c}), '\s+', ' ', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, '^{p}$') THEN strftime(try_strptime({s}, '{f}'), '%Y-%m-%d')" for p, f in _FORMATS) + " END"


#: The reference pattern with its look-arounds written as neighbouring characters; as a predicate the same.
_HINT = r"(?i)([A-Z]{2,}[-/#]?\d{3,}|\d{8}-\d{4,}|GKVW#\S+|PHUB\d+|[A-Z]+\d*[-/]\d+([-/]\d+)*|(^|[^\d.,])0\d{6,}([^\d.,]|$)|(^|[^\d.,/-])\d{2,4}/\d{2,4}/\d{3,}(?:/\d+)*([^\d.,]|$)|(^|[^\d.,])\d{9,}([^\d.,]|$)|(?:INVOICE|INV|BILL|VOUCHER|DOC|REF|NO)\s*(?:NO)?[.#:\s]*\d{3,})"
_TOKEN = r"(?i)([A-Z]{2,}[-/#]?\d{3,}|[A-Z]+\d*[-/]\d+([-/]\d+)*|(?:INVOICE|INV|BILL|VOUCHER|DOC|REF|NO)\s*(?:NO)?[.#:\s]*\d{3,})"


def _sql(columns: str) -> str:
    return f"SELECT k, {columns} FROM ({TEXTS}) AS x"


def _first(rules, c: str, otherwise: str, flag: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{flag}{p}') THEN '{t}'" for p, t in rules) + f" ELSE {otherwise} END"


def _header_sql(c: str) -> str:
    s = rf"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z#() ]', ' ', 'g'), ' +', ' ', 'g'))"
    exact = " ".join(f"WHEN s IN ({_quoted(n)}) THEN '{r}'" for r, n in S.HEADER_WORDS.items())
    part = " ".join(f"WHEN length(s) > 2 AND ({' OR '.join(f"starts_with(s, '{x} ') OR ends_with(s, ' {x}') OR list_contains(string_split(s, ' '), '{x}')" for x in n)}) THEN '{r}'" for r, n in S.HEADER_WORDS.items())
    return f"(SELECT CASE {exact} {part} END FROM (SELECT {s} AS s))"


_HEADERS = "CASE k % 11 WHEN 0 THEN 'Date' WHEN 1 THEN 'Invoice No.' WHEN 2 THEN 'Txn Date (dd)' WHEN 3 THEN 'Net Amount AED' WHEN 4 THEN 'Total Cr Amount' WHEN 5 THEN 'Particulars' WHEN 6 THEN 'INV-' || k8 WHEN 7 THEN 'dr' WHEN 8 THEN 'Transaction Type' WHEN 9 THEN 'x' ELSE 'Bill # / Number' END"
_TYPO = "CASE WHEN k % 3 = 0 THEN overlay(k8 PLACING 'Z' FROM 4) WHEN k % 3 = 1 THEN k8 ELSE '99' || substr(k8, 3) END"
_TYPO_DUCK = "CASE WHEN k % 3 = 0 THEN substr(k8, 1, 3) || 'Z' || substr(k8, 5) WHEN k % 3 = 1 THEN k8 ELSE '99' || substr(k8, 3) END"
_LINE = "CASE k % 5 WHEN 0 THEN k8 || '   ' || abc || '  ' || d WHEN 1 THEN abc || ' ' || k8 WHEN 2 THEN ' ' || k8 || '\t' || abc WHEN 3 THEN abc ELSE '' END"


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = from_sql(spark, sf_dir, f"SELECT k, {_LINE.replace(chr(9), chr(92) + 't')} AS line FROM (SELECT *, iso_text AS d FROM ({TEXTS}) AS x) AS y")
    parts = split_line(F.col("line"))
    return lines.select("k", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("parts"))


_SPLIT_SQL = rf"""SELECT k, CAST(len(p) AS BIGINT) AS n, coalesce(array_to_string(p, '|'), '') AS parts FROM
  (SELECT k, CASE WHEN s = '' THEN [] WHEN len(regexp_split_to_array(s, '\s{{2,}}|\t')) < 2 THEN regexp_split_to_array(s, '\s+') ELSE regexp_split_to_array(s, '\s{{2,}}|\t') END AS p FROM
    (SELECT k, trim(line) AS s FROM (SELECT k, {_LINE} AS line FROM (SELECT *, iso_text AS d FROM ({TEXTS}) AS x) AS y)))"""

QUERIES = {
    "c01_parse_amount": _q(lambda: {"amount": S.parse_amount(F.col("amount_text"))}),
    "c02_parse_date": _q(lambda: {"iso": S.parse_date(F.col("date_text"))["iso"], "raw": S.parse_date(F.col("date_text"))["raw"]}),
    "c03_excel_serial_date": _q(lambda: {"iso": S.excel_serial_date(F.col("serial"))}),
    "c04_norm_ref": _q(lambda: {"ref": S.norm_ref(F.col("ref_text"))}),
    "c05_looks_like_ref": _q(lambda: {"hit": S.looks_like_ref(F.col("ref_text"))}),
    "c06_extract_ref_token": _q(lambda: {"token": S.extract_ref_token(F.col("ref_text"))}),
    "c07_type_from_ref": _q(lambda: {"type": S.type_from_ref(F.col("ref_text"))}),
    "c08_infer_type": _q(lambda: {"type": S.infer_type(F.col("ref_text"))}),
    "c09_row_kinds": _q(lambda: {"total": S.is_total_row(F.col("ref_text")), "opening": S.is_opening_row(F.col("ref_text"))}),
    "c10_match_header": _q(lambda: {"role": S.match_header(F.expr(_HEADERS))}),
    "c11_ref_keys": _q(lambda: {"alnum": S.ref_alnum(F.col("ref_text")), "digits": S.ref_digits(F.col("ref_text")), "zstrip": S.ref_zstrip(F.col("ref_text"))}),
    "c12_one_typo": _q(lambda: {"typo": S.one_typo(F.col("k8"), F.expr(_TYPO))}),
    "c13_day_ordinal": _q(lambda: {"day": S.day_ordinal(F.col("iso_text"))}),
    "c14_is_payment": _q(lambda: {"pays": S.is_payment(F.col("type_text"))}),
    "s05_split_line": split_lines,
}

ORACLES = {
    "c01_parse_amount": _sql(f"{_AMOUNT} AS amount"),
    "c02_parse_date": _sql(f"{_iso('date_text')} AS iso, trim(date_text) AS raw"),
    "c03_excel_serial_date": _sql("CASE WHEN serial > 20000 AND serial < 60000 THEN CAST(DATE '1899-12-30' + CAST(floor(serial) AS INT) AS VARCHAR) END AS iso"),
    "c04_norm_ref": _sql(r"regexp_replace(upper(regexp_replace(ref_text, '\s+', '', 'g')), '^[.,;:]+|[.,;:]+$', '', 'g') AS ref"),
    "c05_looks_like_ref": _sql(f"({_iso('ref_text')}) IS NULL AND regexp_matches(ref_text, '{_HINT}') AS hit"),
    "c06_extract_ref_token": _sql(f"CASE WHEN contains(trim(ref_text), ' ') AND regexp_matches(ref_text, '{_TOKEN}') THEN regexp_extract(ref_text, '{_TOKEN}') ELSE ref_text END AS token"),
    "c07_type_from_ref": _sql(_first(S.REF_TYPES, "ref_text", "NULL", "(?i)") + " AS type"),
    "c08_infer_type": _sql(_first(S.TEXT_TYPES, "lower(ref_text)", "'Invoice'", "") + " AS type"),
    "c09_row_kinds": _sql(f"regexp_matches(ref_text, '(?i){S.TOTAL_ROW}') AS total, regexp_matches(ref_text, '(?i){S.OPENING_ROW}') AS opening"),
    "c10_match_header": _sql(_header_sql(_HEADERS) + " AS role"),
    "c11_ref_keys": _sql(r"regexp_replace(upper(ref_text), '[^A-Z0-9]', '', 'g') AS alnum, regexp_replace(ref_text, '\D', '', 'g') AS digits, coalesce(nullif(ltrim(regexp_replace(ref_text, '\D', '', 'g'), '0'), ''), regexp_replace(ref_text, '\D', '', 'g')) AS zstrip"),
    "c12_one_typo": _sql(f"(SELECT length(a) = length(b) AND length(a) >= 6 AND len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1 FROM (SELECT k8 AS a, {_TYPO_DUCK} AS b)) AS typo"),
    "c13_day_ordinal": _sql("CASE WHEN regexp_matches(iso_text, '^\\d+-\\d+-\\d+$') THEN CAST(split_part(iso_text, '-', 1) AS INT) * 372 + CAST(split_part(iso_text, '-', 2) AS INT) * 31 + CAST(split_part(iso_text, '-', 3) AS INT) END AS day"),
    "c14_is_payment": _sql(f"coalesce(lower(trim(type_text)) IN ({_quoted(S.PAYMENT_TYPES)}), false) AS pays"),
    "s05_split_line": _SPLIT_SQL,
}
