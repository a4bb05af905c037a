"""Statement grids to records.

A grid is ``doc_id, row_idx (from 0), cells array<struct<s, d, ts, i>>`` (text, number, time, whole number).  Each cell is read once; everything after is array
look-ups in the row, and aggregation by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stages import cut

HEADER_ROWS, INFER_ROWS = 20, 40
COLUMNS = tuple(f"{r}_col" for r in S.ROLES)


def read_grid(grid: DataFrame) -> DataFrame:
    """``doc_id, row_idx, c``: the cells, read once.  Cells may lack any of the four fields but ``s``."""
    has = grid.schema["cells"].dataType.elementType.fieldNames()
    kinds = {"s": "string", "d": "double", "ts": "timestamp", "i": "bigint"}
    whole = lambda c: F.struct(*[(c[f] if f in has else F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()])
    return grid.select("doc_id", "row_idx", F.transform("cells", lambda c: S.read_cell(whole(c))).alias("c"))


def map_row(texts: Column) -> Column:
    """Struct of a column number per role (-1: none; the first column wins) and ``hits``."""
    roles = F.transform(texts, lambda t: F.coalesce(S.match_header(t), F.lit("")))
    place = lambda found: F.transform(F.array(*map(F.lit, S.ROLES)), lambda r: (F.array_position(found, r) - 1).cast("int"))

    def row(at: Column) -> Column:
        return F.struct(*[F.get(at, F.lit(k)).alias(n) for k, n in enumerate(COLUMNS)], F.size(F.filter(at, lambda x: x >= 0)).alias("hits"))

    nothing = F.array_repeat(F.lit(-1), len(S.ROLES))
    return S.let(S.let(roles, lambda found: F.when(F.exists(found, lambda r: r != ""), place(found)).otherwise(nothing)), row)


def find_header(read: DataFrame) -> DataFrame:
    """G1: ``doc_id, header_row`` and the column numbers, a row per document; header_row -1 if there is none."""
    order = W.partitionBy("doc_id").orderBy("row_idx")
    full = F.transform("c", lambda x: F.when(x["full"], x["txt"]))
    is_data = F.exists("c", lambda x: x["full"] & x["iso"].isNotNull()) | (F.size(F.filter("c", lambda x: x["amt"].isNotNull())) >= 2)
    top = read.where(F.col("row_idx") <= HEADER_ROWS).select("doc_id", "row_idx", full.alias("t"), ((F.size("c") > 0) & ~F.coalesce(is_data, F.lit(True))).alias("merges"))
    top = top.withColumn("next", F.lead(F.struct("t", "merges")).over(order))
    both = F.zip_with("t", "next.t", lambda a, b: F.nullif(F.trim(F.concat_ws(" ", a, b)), F.lit("")))
    alone, merged = (F.struct(F.lit(span).alias("span"), t.alias("t")) for span, t in ((1, F.col("t")), (2, both)))
    tries = F.when(F.col("next.merges"), F.array(alone, merged)).otherwise(F.array(alone))
    cand = top.where(F.col("row_idx") < HEADER_ROWS).select("doc_id", "row_idx", F.explode(tries).alias("x")).select("doc_id", "row_idx", "x.span", map_row(F.col("x.t")).alias("m"))
    usable = (F.col("m.ref_col") >= 0) | (F.col("m.amount_col") >= 0) | ((F.col("m.debit_col") >= 0) & (F.col("m.credit_col") >= 0))
    rank = F.struct(F.col("m.hits"), -F.col("row_idx"), -F.col("span"))
    # What is not usable has no rank.  A filter would go below the mapping and work it out once for each column it asks about.
    best = cand.groupBy("doc_id").agg(F.max_by(F.struct((F.col("row_idx") + F.col("span") - 1).alias("header_row"), "m"), F.when(usable, rank)).alias("b"))
    docs = read.select("doc_id").distinct()
    col = lambda n: F.coalesce(F.col(f"b.m.{n}"), F.lit(-1)).alias(n)
    return docs.join(best, "doc_id", "left").select("doc_id", F.coalesce("b.header_row", F.lit(-1)).cast("int").alias("header_row"), *map(col, COLUMNS))


def infer_columns(read: DataFrame, header: DataFrame) -> DataFrame:
    """``header`` with missing date, ref and amount columns filled by votes of the first rows, and ``inferred``."""
    lacking = header.where((F.col("header_row") < 0) | ((F.col("amount_col") < 0) & ~((F.col("debit_col") >= 0) & (F.col("credit_col") >= 0))))
    first = read.join(lacking.select("doc_id", "header_row"), "doc_id").where((F.col("row_idx") > F.col("header_row")) & (F.col("row_idx") <= F.col("header_row") + INFER_ROWS))
    cells = first.select("doc_id", "row_idx", F.posexplode("c").alias("col", "x")).where("x.full")
    vote = F.explode(F.array_compact(F.array(
        F.when(F.col("x.iso").isNotNull(), "date"), F.when(F.col("x.ref"), "ref"),
        F.when(F.col("x.amt").isNotNull() & F.col("x.iso").isNull() & ~F.col("x.ref"), "amount"),
    )))
    votes = cells.select("doc_id", "row_idx", "col", vote.alias("role")).groupBy("doc_id", "role", "col").agg((-F.count("*")).alias("n"), F.min(F.struct("row_idx", "col")).alias("seen"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("role") == "amount", F.struct("n", "seen", "col"))))
    top = lambda role: F.min_by("col", F.when(F.col("role") == role, F.struct("n", "seen")))
    guess = votes.groupBy("doc_id").agg(top("date").alias("g_date"), top("ref").alias("g_ref"), ranked.alias("g_amount"))
    out = header.join(guess, "doc_id", "left")
    date = F.when(F.col("date_col") >= 0, F.col("date_col")).otherwise(F.coalesce("g_date", F.lit(-1)))
    ref = F.when(F.col("ref_col") >= 0, F.col("ref_col")).otherwise(F.coalesce("g_ref", F.lit(-1)))
    used = F.array(date, ref, *[F.col(n) for n in COLUMNS if n not in ("date_col", "ref_col")])
    amount = F.get(F.filter("g_amount", lambda g: ~F.array_contains(used, g["col"])), F.lit(0))["col"]
    out = out.withColumns({"n_date": date, "n_ref": ref, "n_amount": amount}).withColumn("inferred", F.col("n_amount").isNotNull())
    pick = lambda n, new: F.when(F.col("inferred"), F.col(new)).otherwise(F.col(n)).alias(n)
    filled = {"date_col": "n_date", "ref_col": "n_ref", "amount_col": "n_amount"}
    return out.select("doc_id", "header_row", *[pick(n, filled[n]) if n in filled else F.col(n) for n in COLUMNS], "inferred")


def _cell(role: str) -> Column:
    return F.when(F.col(f"{role}_col") >= 0, F.get("c", F.col(f"{role}_col")))


def classify_rows(read: DataFrame, colmap: DataFrame) -> DataFrame:
    """Rows below the header with ``class`` (blank, opening, total, none, numeric_ref, data), the column map,
    their text, the last amount in them and the resolved amount."""
    rows = read.join(colmap, "doc_id").where(F.col("row_idx") > F.col("header_row"))
    rows = rows.withColumns({"text": S.row_text(F.col("c")), "last_amount": F.try_element_at(F.filter(F.transform("c", lambda x: x["amt"]), lambda a: a.isNotNull()), F.lit(-1))})
    raw = _cell("ref")
    numeric_ref = F.coalesce(raw["full"] & raw["amt"].isNotNull() & ~raw["ref"], F.lit(False)) & _cell("date")["iso"].isNull()
    kind = (
        F.when(S.is_blank_row(F.col("c")), "blank").when(S.is_opening_row(F.col("text")), "opening").when(S.is_total_row(F.col("text")), "total")
        .when(~S.has_signal(F.col("c")), "none").when(numeric_ref, "numeric_ref").otherwise("data")
    )
    return rows.withColumns({"class": kind, "amount": resolve_amount()})


def resolve_amount() -> Column:
    """G5."""
    debit, credit = F.coalesce(_cell("debit")["amt"], F.lit(0.0)), F.coalesce(_cell("credit")["amt"], F.lit(0.0))
    split = (F.col("debit_col") >= 0) | (F.col("credit_col") >= 0)
    at = F.transform("c", lambda x, i: F.struct(x["amt"].alias("amt"), x["iso"].alias("iso"), i.alias("i")))
    free = F.filter(at, lambda x: x["amt"].isNotNull() & x["iso"].isNull() & (x["i"] != F.col("date_col")) & (x["i"] != F.col("ref_col")))
    own = _cell("amount")["amt"]
    return F.when(split, F.when((debit != 0) | (credit != 0), debit - credit).otherwise(own)).otherwise(F.coalesce(own, F.try_element_at(free, F.lit(-1))["amt"]))


def document_total(rows: DataFrame) -> DataFrame:
    """``doc_id, document_total``: the last amount of the last totals row that has one."""
    totals = rows.where(F.col("class").isin("total", "numeric_ref") & F.col("last_amount").isNotNull())
    return totals.groupBy("doc_id").agg(F.max_by("last_amount", "row_idx").alias("document_total"))


def resolve_ref() -> Column:
    """The raw reference of a data row, else null."""
    own = F.when(_cell("ref")["full"], _cell("ref")["txt"])
    hinted = F.try_element_at(F.filter("c", lambda x: x["ref"] & x["amt"].isNull()), F.lit(1))["txt"]
    at = F.transform("c", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    taken = F.array(*[F.col(f"{r}_col") for r in ("date", "amount", "debit", "credit")])
    lone = F.filter(at, lambda y: ~F.array_contains(taken, y["i"]) & y["x"]["full"] & y["x"]["amt"].isNull())
    first = F.transform(lone, lambda y: F.split(S.strip(F.split(S.strip(y["x"]["txt"]), "\n")[0]), " ")[0])
    number = F.try_element_at(F.filter(first, lambda t: t.rlike(r"^\d{4,9}$")), F.lit(1))
    return S.extract_ref_token(F.coalesce(own, hinted, number))


def resolve_type(ref: Column) -> Column:
    """The type."""
    own = _cell("type")
    return F.coalesce(S.type_from_ref(ref), F.when(own["full"], S.strip(own["txt"])), S.infer_type(F.col("text")))


def extract_rows(rows: DataFrame) -> DataFrame:
    """Data rows with reference, type, sign and dates; ``valid`` if they have an amount and a reference."""
    data = rows.where("class = 'data'").withColumn("raw_ref", resolve_ref()).withColumn("ref", S.norm_ref(F.col("raw_ref")))
    data = data.withColumn("type", resolve_type(F.col("ref")))
    flip = F.col("type").isin("Credit Note", "Payment") & (F.col("amount") > 0) & (F.coalesce(_cell("credit")["amt"], F.lit(0.0)) == 0)
    date = _cell("date")
    return data.select(
        "doc_id", "ref", S.strip("raw_ref").alias("ref_raw"), F.coalesce(S.let(S.strip(date["txt"]), lambda s: F.when(s != "", s)), date["iso"], F.lit("")).alias("date"), date["iso"].alias("date_iso"), "type",
        F.round(F.when(flip, -F.col("amount")).otherwise(F.col("amount")), 2).alias("amount"), (F.col("row_idx") + 1).cast("int").alias("row"),
        (F.col("amount").isNotNull() & (F.col("ref") != "")).alias("valid"),
    )


def dedupe_records(records: DataFrame) -> DataFrame:
    """With ``repeat``: whether an earlier row of the document has the same reference, amount and date."""
    same = W.partitionBy("doc_id", "ref", "amount", "date_iso").orderBy("row")
    return records.withColumn("repeat", F.row_number().over(same) > 1)


RECORD = ("doc_id", "ref", "ref_raw", "date", "date_iso", "type", "amount", "row")


def totals_check(total: Column, extracted: Column, some: Column) -> Column:
    """struct(document_total, extracted_sum, ok), null without a total or without records."""
    ok = F.abs(extracted - total) <= F.greatest(F.lit(1.0), F.abs(total) * 0.001)
    return F.when(total.isNotNull() & some, F.struct(total.alias("document_total"), extracted.alias("extracted_sum"), ok.alias("ok")))


def money_text(d: Column) -> Column:
    """An amount with one or two decimals, without an exponent."""
    fixed = F.format_string("%.2f", d)
    return F.when(fixed.endswith("0"), F.substr(fixed, F.lit(1), F.length(fixed) - 1)).otherwise(fixed)


def extract(grid: DataFrame, reader_meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and document metadata of all grids.  ``reader_meta``: ``doc_id, scanned`` and more, a row per document.

    Documents of no rows have no metadata unless ``reader_meta`` names them.
    """
    read = cut(read_grid(grid))  # what follows reads it four times
    colmap = cut(infer_columns(read, find_header(read)))
    rows = classify_rows(read, colmap)
    extracted = cut(extract_rows(rows))
    marked = dedupe_records(extracted.where("valid"))
    records = marked.where(~F.col("repeat")).select(*RECORD)
    return records, document_meta(read, colmap, rows, extracted, marked, reader_meta)


def document_meta(read: DataFrame, colmap: DataFrame, rows: DataFrame, extracted: DataFrame, marked: DataFrame, reader_meta: DataFrame | None = None) -> DataFrame:
    """G12-G15, a row per document."""
    total_rows = read.groupBy("doc_id").agg(F.count("*").alias("total_rows"))
    by_class = rows.groupBy("doc_id").agg(
        F.count_if(F.col("class") == "data").alias("n_data"),
        F.array_sort(F.collect_list(F.when(F.col("class") == "opening", F.col("row_idx") + 1))).alias("opening"),
        F.max_by("last_amount", F.when(F.col("class").isin("total", "numeric_ref") & F.col("last_amount").isNotNull(), F.col("row_idx"))).alias("document_total"),
    )
    invalid = extracted.groupBy("doc_id").agg(F.count_if(~F.col("valid")).alias("invalid_rows"))
    kept = marked.groupBy("doc_id").agg(F.count_if(~F.col("repeat")).alias("records"), F.count_if("repeat").alias("dropped"), (F.sum(F.when(~F.col("repeat"), F.round(F.col("amount") * 100).cast("long"))) / 100.0).alias("extracted_sum"))
    d = colmap.join(total_rows, "doc_id").join(by_class, "doc_id", "left").join(invalid, "doc_id", "left").join(kept, "doc_id", "left")
    if reader_meta is not None:
        d = d.join(reader_meta, "doc_id", "full_outer")
    scanned = F.coalesce(F.col("scanned"), F.lit(False)) if reader_meta is not None and "scanned" in reader_meta.columns else F.lit(False)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    d = d.withColumns({c: zero(c) for c in ("total_rows", "n_data", "invalid_rows", "records", "dropped")}).withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in ("header_row", *COLUMNS)})
    d = d.withColumns({"inferred": F.coalesce("inferred", F.lit(False)), "scanned": scanned, "data_rows": F.col("n_data") - F.col("dropped")})
    d = d.withColumn("totals_check", totals_check(F.col("document_total"), F.col("extracted_sum"), F.col("records") > 0))
    return d.select(
        "doc_id", "header_row", "total_rows", *[c for c in COLUMNS if c != "desc_col"], "data_rows", "invalid_rows", "records",
        confidence().alias("confidence"), warnings().alias("warnings"), "totals_check", "inferred", "scanned",
        *([c for c in reader_meta.columns if c not in ("doc_id", "scanned")] if reader_meta is not None else []),
    )


def confidence() -> Column:
    """G14, on the counts of a document."""
    base = F.when(F.col("data_rows") > 0, F.col("records") / F.col("data_rows")).otherwise(0.0)
    base = base - F.when(F.col("date_col") < 0, 0.10).otherwise(0.0) - F.when(F.col("inferred"), 0.10).otherwise(0.0)
    ok = F.col("totals_check.ok")
    base = F.when(ok, F.greatest(base, F.lit(0.9))).when(~ok, base - 0.15).otherwise(base)
    return F.round(F.when(F.col("scanned"), 0.0).otherwise(F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0))), 3)


def warnings() -> Column:
    """G15, on the counts of a document.  The texts are fixed values."""
    opening = F.transform(F.coalesce("opening", F.array().cast("array<int>")), lambda r: F.concat(F.lit("Row "), r.cast("string"), F.lit(": opening-balance row skipped")))
    check = F.col("totals_check")
    rest = F.array_compact(F.array(
        F.when(F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(" duplicate rows dropped (repeated pages)"))),
        F.when(F.col("date_col") < 0, "No date column detected"),
        F.when(F.col("inferred"), "Headers not found — columns inferred from data shape"),
        F.when(~check["ok"], F.concat(F.lit("Extracted sum "), money_text(check["extracted_sum"]), F.lit(" != document total "), money_text(check["document_total"]))),
        F.when(F.col("scanned"), "PDF appears scanned (no extractable text)"),
    ))
    return F.concat(opening, rest)
