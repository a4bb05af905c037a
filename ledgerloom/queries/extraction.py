"""Queries of grids, sources and routing (G, S, V), over grids made from the orders.

Their SQL says what must come out, straight from the orders and the known layouts, without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions.stages import cut
from ..jobs.extraction import Extraction, extract_documents
from ..operators import grid as G
from ..operators import route as V
from ..sources import files as S
from .derived import CANDIDATES, ITEMS, LINES, RECORDS, ROWS, candidates, from_sql, grid

_ALT_DOCS = f"SELECT CAST(doc_id AS STRING) AS doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(total AS DOUBLE) / 100 END AS document_total, doc_id % 5 <> 0 AS present, CASE WHEN doc_id % 10 = 0 THEN 'timeout' END AS error FROM ({ITEMS}) AS i WHERE i.i = 0"
_COLS = ("date_col", "ref_col", "type_col", "debit_col", "credit_col", "amount_col")


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = cut(G.read_grid(grid(spark, sf_dir)))
    colmap = cut(G.infer_columns(read, G.find_header(read)))
    return read, colmap, G.classify_rows(read, colmap)


def g01_find_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.find_header(G.read_grid(grid(spark, sf_dir))).select("doc_id", "header_row", *_COLS)


def g02_map_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.transform("cells", lambda c: C.cell_text(c))
    hits = grid(spark, sf_dir).select("doc_id", "row_idx", F.explode(F.array(G.map_row(texts)["hits"])).alias("hits"))  # worked out once, below the filter
    return hits.where("hits > 0")


def g03_infer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = cut(G.read_grid(grid(spark, sf_dir)))
    return G.infer_columns(read, cut(G.find_header(read))).select("doc_id", "inferred", "date_col", "ref_col", "amount_col")


def g04_classify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir)[2].groupBy("doc_id", "class").agg(F.count("*").alias("n"))


def g05_resolve_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir)[2].where("class = 'data'").select("doc_id", (F.col("row_idx") + 1).alias("row"), F.round("amount", 2).alias("amount"))


def g06_numeric_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grid with one more row, a bare number in the reference column and no date."""
    g = cut(grid(spark, sf_dir))
    last = g.groupBy("doc_id").agg((F.max("row_idx") + 1).alias("row_idx"))
    cell = lambda s: F.struct(F.lit(s).alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("i"))
    read = cut(G.read_grid(g.unionByName(last.select("doc_id", "row_idx", F.array(cell(""), cell("1234"), cell(""), cell("")).alias("cells")))))
    rows = G.classify_rows(read, cut(G.infer_columns(read, cut(G.find_header(read)))))
    return rows.where("class = 'numeric_ref'").select("doc_id", "row_idx", "last_amount")


def g07_document_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_total(_read(spark, sf_dir)[2])


def g08_resolve_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir)[2].where("class = 'data'")
    blind = rows.withColumn("ref_col", F.lit(-1))
    by = lambda d, how: d.select("doc_id", (F.col("row_idx") + 1).alias("row"), F.lit(how).alias("how"), G.resolve_ref().alias("raw_ref"))
    return by(rows, "column").union(by(blind, "search"))


def g09_type_and_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.extract_rows(_read(spark, sf_dir)[2]).select("doc_id", "row", "type", "amount")


def g10_extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.extract_rows(_read(spark, sf_dir)[2]).where("valid").select(*G.RECORD)


def g11_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = G.dedupe_records(G.extract_rows(_read(spark, sf_dir)[2]).where("valid"))
    return marked.groupBy("doc_id").agg(F.count_if("repeat").alias("dropped"), F.count_if(~F.col("repeat")).alias("kept"))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.extract(grid(spark, sf_dir))[1]


def g12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select("doc_id", "total_rows", "data_rows", "invalid_rows", "records")


def g13_totals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).where("totals_check is not null").select("doc_id", "totals_check.document_total", "totals_check.extracted_sum", "totals_check.ok")


def g14_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select("doc_id", "confidence")


def g15_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select("doc_id", F.array_join("warnings", " | ").alias("warnings"))


def g16_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.extract(grid(spark, sf_dir))[0]


def g16_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids as a workbook holds them: amounts as numbers, whole ones as integers, dates as timestamps or (odd documents)
    serial numbers.  Grids without a header stay text, for there a number may be taken for a date."""
    text = lambda c: F.col(c).isNotNull() & (F.col("doc_id") % 6 != 3)
    day = lambda c: F.when(text(c) & F.col(c).rlike(r"^\d{2}-\d{2}-\d{4}$"), F.to_date(c, "dd-MM-yyyy"))
    number = lambda c: F.when(text(c) & F.col(c).rlike(r"^[\d,]+\.\d{2}$"), F.regexp_replace(c, ",", "").cast("double"))
    odd = F.col("doc_id") % 2 == 1

    def cell(c: str) -> Column:
        whole = number(c) == F.floor(number(c))
        serial = F.when(odd, F.datediff(day(c), F.lit("1899-12-30").cast("date")).cast("double"))
        return F.struct(
            F.when(day(c).isNull() & number(c).isNull(), F.col(c)).alias("s"), F.coalesce(serial, F.when(~whole, number(c))).alias("d"), F.when(~odd, day(c).cast("timestamp")).alias("ts"), F.when(whole, number(c)).cast("bigint").alias("i"),
        )

    there = lambda c: c["s"].isNotNull() | c["d"].isNotNull() | c["ts"].isNotNull() | c["i"].isNotNull()
    cells = F.filter(F.array(*map(cell, ("c0", "c1", "c2", "c3"))), there)
    book = from_sql(spark, sf_dir, ROWS).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("row_idx").cast("int").alias("row_idx"), cells.alias("cells"))
    return G.extract(book)[0].select("doc_id", "ref", "date_iso", "type", "amount", "row")


def c15_row_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = G.read_grid(grid(spark, sf_dir))
    return read.select("doc_id", "row_idx", C.is_blank_row(F.col("c")).alias("blank"), C.has_signal(F.col("c")).alias("signal"))


def s01_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = from_sql(spark, sf_dir, _FILES)
    ok, bad = S.intake_files(files)
    return ok.select("doc_id", "ext", F.lit("").alias("reason")).union(bad.select("doc_id", "ext", "reason"))


def s02_read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids written as text with one of four delimiters and read back; some files are no table, some empty."""
    return S.read_delimited(_files(spark, sf_dir))[0].select("doc_id", "row_idx", F.array_join(F.transform("cells", lambda c: c["s"]), "|").alias("cells"))


def s03_pick_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    cover = g.where("row_idx < 3").withColumns({"sheet_idx": F.lit(0), "sheet": F.lit("Cover")})
    sheets = cover.unionByName(g.withColumns({"sheet_idx": F.lit(1), "sheet": F.lit("Ledger")})).unionByName(g.withColumns({"sheet_idx": F.lit(2), "sheet": F.lit("Copy")}))
    return S.pick_sheet(sheets).groupBy("doc_id", "sheet").agg(F.count("*").alias("n"))


def s04_words_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of each grid's cells, 100 apart, in lines 12 apart."""
    cells = from_sql(spark, sf_dir, ROWS).select("doc_id", "row_idx", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("col", "text")).where("text <> ''")
    words = cells.select("doc_id", "row_idx", "col", F.posexplode(F.split("text", " ")).alias("w", "text"))
    boxes = words.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), (F.col("row_idx") * 1000 + F.col("col") * 100 + F.col("w")).alias("word_idx"), "text",
        (F.col("col") * 400 + F.col("w") * 60).cast("double").alias("x0"), (F.col("col") * 400 + F.col("w") * 60 + 58).cast("double").alias("x1"), (F.col("row_idx") * 12 + F.col("col") * 0.5).cast("double").alias("top"),
    )
    return S.words_to_rows(boxes).select("doc_id", "row_idx", F.array_join(F.transform("cells", lambda c: c["s"]), "|").alias("cells"))


def s04_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over pages of eight rows, with crooked lines: words of a line stand up to 1.5 apart, in any order."""
    cells = from_sql(spark, sf_dir, ROWS).select("doc_id", "row_idx", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("col", "text")).where("text <> ''")
    words = cells.select("doc_id", "row_idx", "col", F.posexplode(F.split("text", " ")).alias("w", "text"))
    left = F.col("col") * 400 + F.col("w") * 60
    boxes = words.select(
        F.col("doc_id").cast("string").alias("doc_id"), (F.floor(F.col("row_idx") / 8) + 1).cast("int").alias("page"), (F.col("row_idx") * 1000 + F.col("col") * 100 + F.col("w")).alias("word_idx"), "text",
        left.cast("double").alias("x0"), (left + 58).cast("double").alias("x1"), (F.col("row_idx") % 8 * 12 + F.pmod(F.col("col") * 7 + F.col("w") * 3, F.lit(4)) * 0.5).cast("double").alias("top"),
    )
    return S.words_to_rows(boxes).select("doc_id", "page", "row_idx", F.array_join(F.transform("cells", lambda c: c["s"]), "|").alias("cells"))


def s06_select_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five rows; of every third page a table, of every seventh one of a single row."""
    rows = grid(spark, sf_dir).withColumn("page", F.floor(F.col("row_idx") / 5).cast("int"))
    table = rows.where("page % 3 = 0 or (page % 7 = 1 and row_idx % 5 = 0)").withColumn("table_idx", F.lit(0))
    return S.select_blocks(table, rows)[1]


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every third document from a word processor, with tables, a table of one row (every twelfth) or paragraphs alone; the
    others paged, of which every tenth is scanned: nothing came out of it."""
    rows = grid(spark, sf_dir).withColumn("id", F.col("doc_id").cast("long"))
    docs = rows.select("doc_id", F.when(F.col("id") % 3 == 0, "docx").otherwise("pdf").alias("kind")).distinct()
    flowing, paged = rows.where("id % 3 = 0"), rows.where("id % 3 <> 0 and id % 10 <> 9").withColumn("page", F.floor(F.col("row_idx") / 5).cast("int"))
    tables = paged.where("page % 3 = 0 or (page % 7 = 1 and row_idx % 5 = 0)").withColumn("table_idx", F.lit(0))
    own = flowing.where("id % 2 = 0 and (id % 12 <> 0 or row_idx = 0)").withColumns({"page": F.lit(None).cast("int"), "table_idx": F.floor(F.col("row_idx") / 5).cast("int")})
    texts = F.filter(F.transform("cells", lambda c: c["s"]), lambda x: x != "")
    paragraphs = flowing.select("doc_id", F.col("row_idx").alias("para_idx"), F.array_join(texts, "   ").alias("text"))
    return S.document_blocks(docs, tables.unionByName(own), paged, paragraphs)


def s06_document_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)[0].select("doc_id", "row_idx", F.array_join(F.transform("cells", lambda c: c["s"]), "|", "").alias("cells"))


def s06_document_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With what extraction makes of it: a scanned document has confidence 0 and says why."""
    blocks, about = _blocks(spark, sf_dir)
    meta = G.extract(blocks, about)[1].select("doc_id", F.when(F.col("scanned"), F.col("confidence")).alias("scanned_confidence"), F.when(F.col("scanned"), F.array_join("warnings", " | ")).alias("scanned_warnings"))
    return about.join(meta, "doc_id").select("doc_id", "reader", "tables", "text_pages", "scanned", "scanned_confidence", "scanned_warnings")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reconciliation's lines as a JSON text; amounts are numbers, texts, truth values, null or no amount at all; some
    bodies are cut short, some hold something else than lists, some nothing."""
    rows = from_sql(spark, sf_dir, LINES)
    amount = F.col("amount").cast("decimal(18,2)").cast("string")
    value = F.element_at(F.array(amount, F.concat(F.lit('" '), amount, F.lit('"')), F.lit("true"), F.lit("null"), F.lit('"n/a"'), F.lit("[1]")), ((F.col("row") % 6) + 1).cast("int"))
    text = F.concat(F.lit('{"ref":"'), "ref", F.lit('","refRaw":"'), "ref_raw", F.lit('","date":"'), "date", F.lit('","dateISO":"'), "date_iso", F.lit('","type":"'), "type", F.lit('","amount":'), value, F.lit("}"))
    of = lambda s: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("row", "text")))), lambda x: x["text"]), ","), F.lit("]"))
    bodies = rows.withColumn("text", text).groupBy("recon_id").agg(of("V").alias("v"), of("B").alias("b"))
    kind = F.col("recon_id") % 10
    vendor = F.when(kind == 5, F.lit('"none"')).when(kind == 7, F.lit("[]")).otherwise(F.col("v"))
    books = F.when(kind == 7, F.lit("[]")).otherwise(F.col("b"))
    whole = F.concat(F.lit('{"recon_id":'), F.col("recon_id").cast("string"), F.lit(',"vendorTransactions":'), vendor, F.lit(',"booksTransactions":'), books, F.lit("}"))
    return bodies.select(F.col("recon_id").alias("place"), F.when(kind == 3, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("value"))


def s07_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bodies_to_lines(_bodies(spark, sf_dir))[0].select("recon_id", "side", "row", "ref", "date_iso", "type", "amount")


def s07_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused bodies with the reason, and refused payment lines with what stands for their amount."""
    _, refused, bad = S.bodies_to_lines(_bodies(spark, sf_dir))
    whole = refused.select(F.col("place").cast("string").alias("recon_id"), F.lit("body").alias("what"), F.lit(-1).cast("long").alias("row"), "reason")
    return whole.union(bad.select("recon_id", "side", "row", "text"))


def s07_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = from_sql(spark, sf_dir, LINES)
    t = F.struct("ref", F.col("ref_raw").alias("refRaw"), "date", F.col("date_iso").alias("dateISO"), "type", F.col("amount").cast("string").alias("amount"))
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("row", t.alias("t"))))), lambda x: x["t"])
    bodies = lines.groupBy("recon_id").agg(of("V").alias("vendor"), of("B").alias("books"))
    return S.transactions_to_lines(bodies)[0].select("recon_id", "side", "row", "ref", "date_iso", "type", "amount")


def s08_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import recon as R
    from .derived import lines

    return S.responses(*R.reconcile(cut(lines(spark, sf_dir)), every_pair=True))


def s08_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses in parts of four results, told from their JSON texts."""
    from ..operators import recon as R
    from .derived import lines

    parts = S.response_parts(*R.reconcile(cut(lines(spark, sf_dir)), every_pair=True), rows=4)
    body = F.from_json("response", "summary struct<total_references: bigint, vendor_net: double>, results array<struct<ord: int, ref: string, status: string>>")
    told = F.array_join(F.transform(body["results"], lambda r: F.concat_ws(" ", r["ord"].cast("string"), r["ref"], r["status"])), "|")
    return parts.select("recon_id", "part", "parts", "n", told.alias("results"), body["summary"]["total_references"].alias("total"), body["summary"]["vendor_net"].alias("vendor_net"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    records, meta = G.extract(grid(spark, sf_dir))
    records, meta = cut(records), cut(meta)
    alt = cut(V.validate_records(candidates(spark, sf_dir)))
    return records, meta, alt, cut(V.alternate_meta(alt, from_sql(spark, sf_dir, _ALT_DOCS)))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids as delimited files; some are no table at all, some empty, some of an unknown kind."""
    rows = from_sql(spark, sf_dir, ROWS)
    mark = F.element_at(F.array(*map(F.lit, ",;\t|")), (F.col("doc_id") % 4 + 1).cast("int"))
    line = F.expr("""concat('"', concat_ws(concat('"', mark, '"'), c0, c1, c2, c3), '"')""")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n")
    files = rows.withColumn("mark", mark).withColumn("line", line).groupBy("doc_id").agg(text.alias("text"))
    kind = F.col("doc_id") % 17
    content = F.when(kind == 3, "nothing to be seen here\n").when(kind == 7, "").otherwise(F.col("text")).cast("binary")
    name = F.when(kind == 5, "x.zip").otherwise("statement.csv")
    return files.select("doc_id", name.alias("filename"), content.alias("content")).withColumn("length", F.length("content").cast("long"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)


def alternate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, _ALT_DOCS)


def _extraction(spark: SparkSession, sf_dir: str, mode: str) -> Extraction:
    return extract_documents(_files(spark, sf_dir), mode, candidates(spark, sf_dir), from_sql(spark, sf_dir, _ALT_DOCS), threshold=0.95)


def _said(done: Extraction) -> DataFrame:
    n = done.records.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    return done.meta.join(n, "doc_id", "left").select("doc_id", "engine", "confidence", "needs_review", F.element_at(F.concat(F.array(F.lit("")), "warnings"), -1).alias("last_warning"), "records", "n", "amount", "ref_col")


def x_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(_extraction(spark, sf_dir, "auto"))


def x_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(_extraction(spark, sf_dir, "alternate"))


def x_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _extraction(spark, sf_dir, "verify")
    more = done.meta.select("doc_id", "rate", "agreed_rows", F.array_join("parser_only", "|").alias("parser_only"), F.array_join("alternate_only", "|").alias("alternate_only"))
    return _said(done).join(more, "doc_id")


def x_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extraction(spark, sf_dir, "auto").rejected


def v01_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_records(candidates(spark, sf_dir)).drop("row")


def v02_alternate_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)[3].select("doc_id", "present", "error", "records", "confidence", "totals_check.ok")


def v03_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, alt, _ = _both(spark, sf_dir)
    return V.agreement(records, alt)


def v04_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, alt, _ = _both(spark, sf_dir)
    return V.disagreements(records, alt).select("doc_id", F.array_join("only_a", "|").alias("only_a"), F.array_join("only_b", "|").alias("only_b"))


def v05_route_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit that some documents stay below."""
    _, meta, _, alt = _both(spark, sf_dir)
    return V.route_auto(meta, alt, 0.95).select("doc_id", "engine", F.element_at(F.concat(F.array(F.lit("")), "warnings"), -1).alias("last_warning"))


def v06_route_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, meta, _, alt = _both(spark, sf_dir)
    return V.route_prefer_alternate(meta, alt).select("doc_id", "engine", F.element_at(F.concat(F.array(F.lit("")), "warnings"), -1).alias("last_warning"))


def v07_route_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, meta, alt, alt_meta = _both(spark, sf_dir)
    return V.route_verify(meta, alt_meta, V.agreement(records, alt)).select("doc_id", "engine", "confidence", "needs_review", F.element_at(F.concat(F.array(F.lit("")), "warnings"), -1).alias("last_warning"))


def v08_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.finalize_primary(_meta(spark, sf_dir), 0.95)[0].select("doc_id", "needs_review", F.size("warnings").alias("n_warnings"))


def v09_response_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, meta, _, alt = _both(spark, sf_dir)
    return V.alternate_response_meta(meta, alt).select("doc_id", "header_row", "amount_col", "confidence", "parser_confidence")


QUERIES = {
    f.__name__: f
    for f in (
        g01_find_header, g02_map_row, g03_infer_columns, g04_classify_rows, g05_resolve_amount, g06_numeric_ref, g07_document_total, g08_resolve_ref, g09_type_and_sign, g10_extract_rows, g11_dedupe, g12_counts, g13_totals_check, g14_confidence, g15_warnings, g16_extract, g16_workbook, c15_row_signals,
        s01_intake, s02_read_delimited, s03_pick_sheet, s04_words_to_rows, s04_pages, s06_select_blocks, s06_document_grid, s06_document_meta, s07_transactions, s07_bodies, s07_refused, s08_responses, s08_parts,
        v01_validate, v02_alternate_meta, v03_agreement, v04_disagreements, v05_route_auto, v06_route_prefer, v07_route_verify, v08_finalize, v09_response_meta, x_auto, x_prefer, x_verify, x_rejects,
    )
}

_FILES = """SELECT CAST(o_orderkey AS STRING) AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN 'a.CSV' WHEN 1 THEN 'b.tar.xlsx' WHEN 2 THEN 'noext' WHEN 3 THEN 'old.doc' WHEN 4 THEN 'x.zip' WHEN 5 THEN 'p.pdf' ELSE 'dot.' END AS filename,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN 10485761 ELSE o_orderkey END AS BIGINT) AS length, 'x' AS content FROM orders"""

_WITH = f"WITH items AS ({ITEMS}), docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS id, layout, n, CAST(total AS BIGINT) AS total FROM items WHERE i = 0), records AS ({RECORDS}), rows AS ({ROWS}), cand AS ({CANDIDATES}) "
_by = lambda *v: "CAST(CASE layout " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(v)) + " END AS INT)"
_credit = "(SELECT sum(CASE WHEN i % 5 = 4 THEN -c ELSE c END) FROM items AS x WHERE CAST(x.doc_id AS VARCHAR) = docs.doc_id)"
_off = "CASE WHEN id % 12 >= 6 THEN 100.0 ELSE 0 END"
_ok = f"({_off} <= greatest(1.0, (total / 100.0 + {_off}) * 0.001))"
_money = "regexp_replace(printf('%.2f', CAST({} AS DOUBLE)), '0$', '')"
_conf = f"CASE WHEN layout = 3 THEN 0.9 WHEN layout = 4 AND NOT {_ok} THEN 0.85 ELSE 1.0 END"
_ROW = "CAST(i + CASE layout WHEN 3 THEN 1 WHEN 1 THEN 5 WHEN 4 THEN 3 ELSE 2 END AS INT)"
_TWICE = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, layout, i, k, k8, c, d, dmy, {_ROW} AS row FROM items UNION ALL SELECT CAST(doc_id AS VARCHAR), layout, i, k, k8, c, d, dmy, CAST(n + 3 + i AS INT) FROM items WHERE layout = 5"
_REF = "CASE WHEN layout = 2 AND i % 5 = 4 THEN 'CN-' ELSE 'INV-' END || k8"
_SIGNED = "CAST(CASE WHEN layout = 2 AND i % 5 = 4 THEN -c ELSE c END AS DOUBLE) / 100"
_TYPE = "CASE WHEN layout = 2 AND i % 5 = 4 THEN 'Credit Note' ELSE 'Invoice' END"
_VALID = "SELECT doc_id, ref, date, CASE WHEN regexp_matches(date_iso, '^\\d{4}-\\d{2}-\\d{2}$') THEN date_iso END AS date_iso, CASE WHEN type = '' THEN 'Invoice' ELSE type END AS type, round(try_cast(amount AS DOUBLE), 2) AS amount FROM cand WHERE try_cast(amount AS DOUBLE) IS NOT NULL"
_KEYS = f"a AS (SELECT DISTINCT doc_id, ref, CAST(round(amount * 100) AS BIGINT) AS c FROM records), b AS (SELECT DISTINCT doc_id, ref, CAST(round(amount * 100) AS BIGINT) AS c FROM ({_VALID})), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.ref, b.ref) AS ref, coalesce(a.c, b.c) AS c, a.ref IS NOT NULL AS in_a, b.ref IS NOT NULL AS in_b FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.ref = b.ref AND a.c = b.c)"
_RATE = f"rate AS (SELECT doc_id, round(sum(CAST(in_a AND in_b AS INT)) / greatest(count(*), 1), 3) AS rate, CAST(sum(CAST(in_a AND in_b AS INT)) AS BIGINT) AS agreed, CAST(sum(CAST(NOT (in_a AND in_b) AS INT)) AS BIGINT) AS disagreed FROM j GROUP BY 1)"
_ALT = f"alt AS (SELECT docs.doc_id, id, layout, id % 5 <> 0 AS there, CASE WHEN id % 10 = 0 THEN 'timeout' END AS err, CASE WHEN id % 4 = 0 THEN total / 100.0 END AS dt, coalesce(v.n, 0) AS records, v.s FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n, sum(amount) AS s FROM ({_VALID}) GROUP BY 1) AS v ON v.doc_id = docs.doc_id), altm AS (SELECT doc_id, id, layout, there AND records > 0 AND err IS NULL AS present, CASE WHEN there AND err IS NULL AND records = 0 THEN 'no valid records' ELSE err END AS error, CAST(records AS BIGINT) AS records, CASE WHEN dt IS NOT NULL AND records > 0 THEN abs(s - dt) <= greatest(1.0, abs(dt) * 0.001) + 1e-9 END AS ok FROM alt)"

_NONE = "''"
_LAST = f"CASE WHEN layout = 3 THEN 'Headers not found — columns inferred from data shape' WHEN layout = 5 THEN n || ' duplicate rows dropped (repeated pages)' WHEN layout = 4 THEN CASE WHEN {_ok} THEN 'Row 2: opening-balance row skipped' ELSE 'Extracted sum ' || {_money.format('total / 100.0')} || ' != document total ' || {_money.format('total / 100.0 + ' + _off)} END ELSE '' END"
_FAILED = "'Alternate extraction failed: ' || error"
_NO_OTHER = "CASE WHEN error IS NOT NULL THEN 'Alternate extraction failed (' || error || ') — deterministic result returned' ELSE 'Alternate extraction is not available' END"
_APART = "'Both extractions disagree on ' || disagreed || ' rows — review before reconciling'"
_ALONE = "'Verify mode: no alternate extraction — deterministic result returned'"
_COMPARED = f", CASE WHEN present THEN rate END AS rate, CASE WHEN present THEN agreed END AS agreed_rows, CASE WHEN present THEN coalesce(only_a, {_NONE}) END AS parser_only, CASE WHEN present THEN coalesce(only_b, {_NONE}) END AS alternate_only"
_X_ALT = _ALT.replace("FROM alt)", "FROM alt WHERE id % 17 NOT IN (5, 7))")
_SOME = "SELECT * FROM records WHERE CAST(doc_id AS INT) % 17 NOT IN (3, 5, 7)"
_X = (
    _WITH
    + f", recs AS ({_SOME}), {_KEYS.replace('FROM records', 'FROM recs')}, {_RATE}, {_X_ALT}, sums AS (SELECT doc_id, round(sum(amount), 2) AS s FROM recs GROUP BY 1), alts AS (SELECT doc_id, round(sum(amount), 2) AS s FROM ({_VALID}) GROUP BY 1), "
    + f"apart AS (SELECT doc_id, array_to_string(list_slice(list_sort(list(t) FILTER (in_a)), 1, 20), '|') AS only_a, array_to_string(list_slice(list_sort(list(t) FILTER (NOT in_a)), 1, 20), '|') AS only_b FROM (SELECT doc_id, in_a, ref || ' ' || {_money.format('c / 100.0')} AS t FROM j WHERE NOT (in_a AND in_b)) GROUP BY 1), "
    + "z AS (SELECT altm.*, docs.n, docs.total, id % 17 = 3 AS empty, coalesce(rate, 0.0) AS rate, coalesce(agreed, 0) AS agreed, coalesce(disagreed, 0) AS disagreed, only_a, only_b, sums.s AS own_sum, alts.s AS alt_sum, present AND coalesce(rate, 0) >= 0.999 AND id % 17 <> 3 AS agree "
    + "FROM altm JOIN (SELECT doc_id, n, total FROM docs) AS docs USING (doc_id) LEFT JOIN rate USING (doc_id) LEFT JOIN apart USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN alts USING (doc_id)) "
)


def _x(other: str, engine: str, review: str, their_warning: str, own_warning: str, verified: str = "false", more: str = "") -> str:
    """Columns of an x query: of documents where ``other`` holds the other engine's, else the parser's."""
    low = f"{_conf} < 0.95"
    return f"""doc_id, CASE WHEN {other} THEN '{engine}' WHEN {verified} THEN 'verified' ELSE 'parser' END AS engine,
      CAST(CASE WHEN {other} THEN CASE WHEN NOT ok THEN 0.7 ELSE 0.9 END WHEN {verified} THEN 1.0 ELSE {_conf} END AS DOUBLE) AS confidence, CASE WHEN {other} THEN {review} ELSE {low} END AS needs_review,
      CASE WHEN {other} THEN {their_warning} WHEN {low} THEN 'Low confidence (' || CAST({_conf} AS DOUBLE) || ') — review before reconciling' ELSE {own_warning} END AS last_warning,
      CASE WHEN {other} THEN records ELSE CAST(n AS BIGINT) END AS records, CASE WHEN {other} THEN records ELSE CAST(n AS BIGINT) END AS n, CASE WHEN {other} THEN alt_sum ELSE own_sum END AS amount,
      CAST(CASE WHEN empty THEN -1 ELSE 1 END AS BIGINT) AS ref_col{more} FROM z WHERE present OR NOT empty"""


# Rows that become the grid of a document, by its kind, under the number they had.
_BLOCKS = """, r AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS id, row_idx, row_idx // 5 AS page, concat_ws('|', c0, c1, c2, c3) AS cells, concat_ws('|', nullif(c0, ''), nullif(c1, ''), nullif(c2, ''), nullif(c3, '')) AS full_cells, count(*) OVER (PARTITION BY doc_id, row_idx // 5) AS n FROM rows),
    kept AS (SELECT doc_id, id, row_idx, page, page % 3 = 0 AND n >= 2 AS tabled, cells FROM r WHERE id % 3 <> 0 AND id % 10 <> 9
      UNION ALL SELECT doc_id, id, row_idx, page, true, cells FROM r WHERE id % 3 = 0 AND id % 2 = 0 AND (id % 12 <> 0 OR row_idx = 0)
      UNION ALL SELECT doc_id, id, row_idx, page, false, CASE WHEN contains(full_cells, '|') THEN full_cells ELSE replace(full_cells, ' ', '|') END FROM r WHERE id % 3 = 0 AND id % 2 = 1 AND full_cells <> '') """
_BODY_LINES = f"""WITH lines AS ({LINES}), n AS (SELECT *, row % 6 AS how, CAST(row_number() OVER (PARTITION BY recon_id, side ORDER BY row) - 1 AS BIGINT) AS place FROM lines),
    t AS (SELECT CAST(recon_id AS VARCHAR) AS recon_id, side, place AS row, ref, date_iso, type, CASE how WHEN 0 THEN amount WHEN 1 THEN amount WHEN 2 THEN 1.0 END AS amount, CASE how WHEN 4 THEN 'n/a' WHEN 5 THEN '[1]' END AS said,
      how IN (4, 5) AND lower(type) IN ('payment', 'payment made', 'receipt') AS bad FROM n WHERE recon_id % 10 NOT IN (3, 5, 7)) """

ORACLES = {
    "g01_find_header": _WITH + f"SELECT doc_id, {_by(0, 3, 0, -1, 0, 0)} AS header_row, {_by(0, 0, 0, -1, 0, 0)} AS date_col, {_by(1, 1, 1, -1, 1, 1)} AS ref_col, {_by(2, -1, -1, -1, 2, 2)} AS type_col, {_by(-1, -1, 2, -1, -1, -1)} AS debit_col, {_by(-1, -1, 3, -1, -1, -1)} AS credit_col, {_by(3, 2, -1, -1, 3, 3)} AS amount_col FROM docs",
    "g02_map_row": _WITH + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_idx AS INT) AS row_idx, CASE WHEN c0 = 'Date' THEN 4 WHEN c0 = 'Opening balance' THEN NULL WHEN c0 = 'Statement for the period' THEN NULL ELSE 2 END AS hits FROM rows WHERE c0 IN ('Date', 'DOCUMENT', 'DATE') UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(row_idx AS INT), 1 FROM rows WHERE c0 = 'Total' UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(row_idx AS INT), 1 FROM rows WHERE c2 = 'Invoice'",
    "g03_infer_columns": _WITH + f"SELECT doc_id, layout = 3 AS inferred, CAST(0 AS INT) AS date_col, CAST(1 AS INT) AS ref_col, {_by(3, 2, -1, 2, 3, 3)} AS amount_col FROM docs",
    "g04_classify_rows": _WITH + "SELECT doc_id, 'data' AS class, CAST(CASE WHEN layout = 5 THEN 2 * n ELSE n END AS BIGINT) AS n FROM docs UNION ALL SELECT doc_id, 'opening', 1 FROM docs WHERE layout = 4 UNION ALL SELECT doc_id, 'total', 1 FROM docs WHERE layout = 4 UNION ALL SELECT doc_id, 'blank', 1 FROM docs WHERE layout = 5",
    "g05_resolve_amount": _WITH + f"SELECT doc_id, row, {_SIGNED} AS amount FROM ({_TWICE})",
    "g06_numeric_ref": _WITH + f"SELECT doc_id, CAST({_by('n + 1', 'n + 4', 'n + 1', 'n', 'n + 3', '2 * n + 2')} AS INT) AS row_idx, CAST(1234 AS DOUBLE) AS last_amount FROM docs",
    "g07_document_total": _WITH + f"SELECT doc_id, total / 100.0 + {_off} AS document_total FROM docs WHERE layout = 4",
    "g08_resolve_ref": _WITH + f"SELECT doc_id, row, how, {_REF} AS raw_ref FROM ({_TWICE}), (SELECT unnest(['column', 'search']) AS how)",
    "g09_type_and_sign": _WITH + f"SELECT doc_id, row, {_TYPE} AS type, {_SIGNED} AS amount FROM ({_TWICE})",
    "g10_extract_rows": _WITH + f"SELECT doc_id, {_REF} AS ref, {_REF} AS ref_raw, dmy AS date, d AS date_iso, {_TYPE} AS type, {_SIGNED} AS amount, row FROM ({_TWICE})",
    "g11_dedupe": _WITH + "SELECT doc_id, CAST(CASE WHEN layout = 5 THEN n ELSE 0 END AS BIGINT) AS dropped, CAST(n AS BIGINT) AS kept FROM docs",
    "g12_counts": _WITH + f"SELECT doc_id, CAST({_by('n + 1', 'n + 4', 'n + 1', 'n', 'n + 3', '2 * n + 2')} AS BIGINT) AS total_rows, CAST(n AS BIGINT) AS data_rows, CAST(0 AS BIGINT) AS invalid_rows, CAST(n AS BIGINT) AS records FROM docs",
    "g13_totals_check": _WITH + f"SELECT doc_id, total / 100.0 + {_off} AS document_total, total / 100.0 AS extracted_sum, {_ok} AS ok FROM docs WHERE layout = 4",
    "g14_confidence": _WITH + f"SELECT doc_id, CAST({_conf} AS DOUBLE) AS confidence FROM docs",
    "g15_warnings": _WITH + f"SELECT doc_id, CASE WHEN layout = 3 THEN 'Headers not found — columns inferred from data shape' WHEN layout = 5 THEN n || ' duplicate rows dropped (repeated pages)' WHEN layout = 4 THEN 'Row 2: opening-balance row skipped' || CASE WHEN {_ok} THEN '' ELSE ' | Extracted sum ' || {_money.format('total / 100.0')} || ' != document total ' || {_money.format('total / 100.0 + ' + _off)} END ELSE '' END AS warnings FROM docs",
    "g16_extract": _WITH + "SELECT doc_id, ref, ref AS ref_raw, date, date_iso, type, amount, row FROM records",
    "s01_intake": f"SELECT doc_id, ext, CASE WHEN length > 10485760 THEN 'File exceeds 10 MB limit' WHEN length = 0 THEN 'Empty file' WHEN ext = 'doc' THEN 'Legacy .doc files are not supported' WHEN ext NOT IN ('csv', 'txt', 'xlsx', 'xlsm', 'xltx', 'xls', 'docx', 'pdf') THEN 'Unsupported file type ''.' || ext || '''' ELSE '' END AS reason FROM (SELECT *, CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '[^.]*$')) ELSE '' END AS ext FROM ({_FILES}))",
    "s02_read_delimited": _WITH + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_idx AS INT) AS row_idx, concat_ws('|', c0, c1, c2, c3) AS cells FROM rows WHERE doc_id % 17 NOT IN (3, 7) UNION ALL SELECT doc_id, 0, 'nothing to be seen here' FROM docs WHERE id % 17 = 3",
    "s03_pick_sheet": _WITH + f"SELECT doc_id, CASE WHEN CASE layout WHEN 1 THEN 0 WHEN 3 THEN least(n, 3) WHEN 4 THEN least(n + 1, 2) ELSE least(n, 2) END = CASE layout WHEN 1 THEN n WHEN 3 THEN n WHEN 4 THEN n + 2 WHEN 5 THEN 2 * n ELSE n END THEN 'Cover' ELSE 'Ledger' END AS sheet, CASE WHEN CASE layout WHEN 1 THEN 0 WHEN 3 THEN least(n, 3) WHEN 4 THEN least(n + 1, 2) ELSE least(n, 2) END = CASE layout WHEN 1 THEN n WHEN 3 THEN n WHEN 4 THEN n + 2 WHEN 5 THEN 2 * n ELSE n END THEN least(3, CAST({_by('n + 1', 'n + 4', 'n + 1', 'n', 'n + 3', '2 * n + 2')} AS BIGINT)) ELSE CAST({_by('n + 1', 'n + 4', 'n + 1', 'n', 'n + 3', '2 * n + 2')} AS BIGINT) END AS n FROM docs",
    "s04_words_to_rows": _WITH + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS INT) AS row_idx, cells FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_idx, concat_ws('|', nullif(c0, ''), nullif(c1, ''), nullif(c2, ''), nullif(c3, '')) AS cells FROM rows) WHERE cells <> ''",
    "s04_pages": _WITH + "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY row_idx) - 1 AS INT) AS row_idx, cells FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_idx, CAST(row_idx // 8 + 1 AS INT) AS page, concat_ws('|', nullif(c0, ''), nullif(c1, ''), nullif(c2, ''), nullif(c3, '')) AS cells FROM rows) WHERE cells <> ''",
    "s06_select_blocks": _WITH + ", p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_idx // 5 AS page, count(*) AS n FROM rows GROUP BY 1, 2) SELECT doc_id, CAST(sum(CAST(page % 3 = 0 AND n >= 2 AS INT)) AS BIGINT) AS tables, CAST(sum(CAST(NOT (page % 3 = 0 AND n >= 2) AS INT)) AS BIGINT) AS text_pages, false AS scanned FROM p GROUP BY 1",
    "s07_transactions": f"SELECT recon_id, side, CAST(row_number() OVER (PARTITION BY recon_id, side ORDER BY row) - 1 AS BIGINT) AS row, ref, date_iso, type, amount FROM ({LINES})",
    "g16_workbook": _WITH + "SELECT doc_id, ref, date_iso, type, amount, row FROM records",
    "c15_row_signals": _WITH + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_idx AS INT) AS row_idx, concat(c0, c1, c2, c3) = '' AS blank, len(list_filter([c0, c1, c2, c3], lambda c: regexp_matches(coalesce(c, ''), '^([0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9,]+[.][0-9]{2})$'))) > 0 AS signal FROM rows",
    "s06_document_grid": _WITH + _BLOCKS + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS INT) AS row_idx, cells FROM kept",
    "s06_document_meta": _WITH + _BLOCKS + """SELECT d.doc_id, CASE WHEN id % 3 = 0 THEN 'docx' ELSE 'pdf' END AS reader, CAST(CASE WHEN id % 3 = 0 THEN coalesce(own, 0) ELSE coalesce(tables, 0) END AS BIGINT) AS tables, CASE WHEN id % 3 <> 0 THEN coalesce(pages, 0) END AS text_pages,
      CASE WHEN id % 3 <> 0 THEN id % 10 = 9 END AS scanned, CASE WHEN id % 3 <> 0 AND id % 10 = 9 THEN CAST(0 AS DOUBLE) END AS scanned_confidence, CASE WHEN id % 3 <> 0 AND id % 10 = 9 THEN 'No date column detected | PDF appears scanned (no extractable text)' END AS scanned_warnings
      FROM docs AS d LEFT JOIN (SELECT doc_id, count(DISTINCT page) FILTER (tabled) AS tables, count(DISTINCT page) FILTER (NOT tabled) AS pages, count(DISTINCT page) FILTER (id % 2 = 0) AS own FROM kept GROUP BY 1) AS k ON k.doc_id = d.doc_id""",
    "s07_bodies": _BODY_LINES + "SELECT recon_id, side, row, ref, date_iso, type, amount FROM t WHERE NOT bad",
    "s07_refused": _BODY_LINES + "SELECT recon_id, side AS what, row, said AS reason FROM t WHERE bad UNION ALL SELECT CAST(recon_id AS VARCHAR), 'body', -1, CASE recon_id % 10 WHEN 3 THEN 'Body is not a JSON object' WHEN 5 THEN 'vendorTransactions and booksTransactions must be arrays' ELSE 'Both transaction lists are empty' END FROM (SELECT DISTINCT recon_id FROM lines) WHERE recon_id % 10 IN (3, 5, 7)",
    "v01_validate": _WITH + "SELECT doc_id, ref, ref AS ref_raw, date, date_iso, type, amount FROM (" + _VALID + ")",
    "v02_alternate_meta": _WITH + f", {_ALT} SELECT doc_id, present, error, records, CASE WHEN NOT ok THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, ok FROM altm",
    "v03_agreement": _WITH + f", {_KEYS}, {_RATE} SELECT doc_id, rate, agreed, disagreed FROM rate",
    "v04_disagreements": _WITH + f", {_KEYS}, t AS (SELECT doc_id, in_a, ref || ' ' || {_money.format('c / 100.0')} AS t FROM j WHERE NOT (in_a AND in_b)) SELECT doc_id, coalesce(array_to_string(list_slice(list_sort(list(t) FILTER (in_a)), 1, 20), '|'), '') AS only_a, coalesce(array_to_string(list_slice(list_sort(list(t) FILTER (NOT in_a)), 1, 20), '|'), '') AS only_b FROM t GROUP BY 1",
    "v05_route_auto": _WITH + f", {_ALT} SELECT doc_id, CASE WHEN {_conf} < 0.95 AND present THEN 'alternate' ELSE 'parser' END AS engine, CASE WHEN {_conf} < 0.95 AND NOT present AND error IS NOT NULL THEN {_FAILED} ELSE {_LAST} END AS last_warning FROM altm JOIN (SELECT doc_id, n, total FROM docs) USING (doc_id)",
    "v06_route_prefer": _WITH + f", {_ALT} SELECT doc_id, CASE WHEN present THEN 'alternate' ELSE 'parser' END AS engine, CASE WHEN present THEN {_LAST} ELSE {_NO_OTHER} END AS last_warning FROM altm JOIN (SELECT doc_id, n, total FROM docs) USING (doc_id)",
    "v07_route_verify": _WITH + f", {_KEYS}, {_RATE}, {_ALT}, z AS (SELECT altm.*, coalesce(rate, 0) >= 0.999 AND present AS agree, disagreed, total, n FROM altm LEFT JOIN rate USING (doc_id) JOIN (SELECT doc_id, total, n FROM docs) USING (doc_id)) SELECT doc_id, CASE WHEN agree THEN 'verified' WHEN present THEN 'alternate+review' ELSE 'parser' END AS engine, CAST(CASE WHEN agree THEN 1.0 WHEN present THEN CASE WHEN NOT ok THEN 0.7 ELSE 0.9 END ELSE {_conf} END AS DOUBLE) AS confidence, present AND NOT agree AS needs_review, CASE WHEN agree THEN {_LAST} WHEN present THEN {_APART} ELSE {_ALONE} END AS last_warning FROM z",
    "x_auto": _X + f"SELECT {_x(f'present AND (empty OR {_conf} < 0.95)', 'alternate', 'false', _NONE, f'CASE WHEN NOT present AND error IS NOT NULL AND {_conf} < 0.95 THEN {_FAILED} ELSE {_LAST} END')}",
    "x_prefer": _X + f"SELECT {_x('present', 'alternate', 'false', _NONE, _NO_OTHER)}",
    "x_verify": _X + f"SELECT {_x('present AND NOT agree', 'alternate+review', 'true', _APART, f'CASE WHEN agree THEN {_LAST} ELSE {_ALONE} END', 'agree', _COMPARED)}",
    "x_rejects": _X + "SELECT doc_id, 'No transactions could be extracted from this file' AS reason FROM z WHERE empty AND NOT present UNION ALL SELECT doc_id, CASE WHEN id % 17 = 5 THEN 'Unsupported file type ' || chr(39) || '.zip' || chr(39) ELSE 'Empty file' END FROM docs WHERE id % 17 IN (5, 7)",
    "v08_finalize": _WITH + f"SELECT doc_id, ({_conf}) < 0.95 AS needs_review, CAST(CASE WHEN layout = 3 THEN 2 WHEN layout = 5 THEN 1 WHEN layout = 4 THEN CASE WHEN {_ok} THEN 1 ELSE 3 END ELSE 0 END AS INT) AS n_warnings FROM docs",
    "v09_response_meta": _WITH + f", {_ALT} SELECT altm.doc_id, CAST({_by(0, 3, 0, -1, 0, 0).replace('layout', 'docs.layout')} AS BIGINT) AS header_row, CAST({_by(3, 2, -1, 2, 3, 3).replace('layout', 'docs.layout')} AS BIGINT) AS amount_col, CASE WHEN NOT ok THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, CAST({_conf.replace('layout', 'docs.layout').replace('id %', 'docs.id %')} AS DOUBLE) AS parser_confidence FROM altm JOIN docs ON docs.doc_id = altm.doc_id WHERE present",
}


def statement_oracles(owner: str, books: str, whole: dict[str, str]) -> dict[str, str]:
    """SQL of the statements-against-books queries: what each document must come to, and ``whole``, the SQL of a whole
    reconciliation, over the lines that follow."""
    chosen = "CASE WHEN agree THEN 'verified' WHEN present THEN 'alternate+review' WHEN NOT empty THEN 'parser' END"
    low = f"{_conf} < 0.95"
    low_text = f"'Low confidence (' || CAST({_conf} AS DOUBLE) || ') — review before reconciling'"
    judged = f"""SELECT doc_id, CASE WHEN {chosen} IS NULL THEN 'rejected' WHEN present AND NOT agree THEN 'review' WHEN {low} THEN 'review' WHEN agree THEN 'verified' ELSE 'unverified' END AS outcome, {chosen} AS engine,
      CAST(CASE WHEN agree THEN 1.0 WHEN present THEN CASE WHEN NOT ok THEN 0.7 ELSE 0.9 END WHEN NOT empty THEN {_conf} END AS DOUBLE) AS confidence, CASE WHEN agree THEN n WHEN present THEN records WHEN NOT empty THEN n END AS records,
      CASE WHEN {chosen} IS NULL THEN 'No transactions could be extracted from this file' WHEN present AND NOT agree THEN {_APART} WHEN {low} THEN {low_text} WHEN agree THEN {_LAST} ELSE {_ALONE} END AS reason FROM z
      UNION ALL SELECT doc_id, 'rejected', NULL, NULL, NULL, CASE WHEN id % 17 = 5 THEN 'Unsupported file type ' || chr(39) || '.zip' || chr(39) ELSE 'Empty file' END FROM docs WHERE id % 17 IN (5, 7)"""
    documents = f"SELECT doc_id, {owner.format('doc_id')} AS recon_id, outcome, engine, confidence, CAST(records AS BIGINT) AS records, reason FROM ({judged})"
    # The place of a line: by document, then by its row or, of the alternate's, its place among the candidates.
    placed = f"""SELECT doc_id, ref, ref AS ref_raw, date, date_iso, type, amount, row AS place FROM recs WHERE doc_id IN (SELECT doc_id FROM z WHERE {chosen} IN ('verified', 'parser'))
      UNION ALL SELECT v.doc_id, v.ref, v.ref, v.date, v.date_iso, v.type, v.amount, c.pos FROM ({_VALID}) AS v JOIN cand AS c ON c.doc_id = v.doc_id AND c.ref = v.ref WHERE v.doc_id IN (SELECT doc_id FROM z WHERE {chosen} = 'alternate+review')"""
    lines = f"""{_X}, placed AS ({placed}) SELECT {owner.format('doc_id')} AS recon_id, 'V' AS side, row_number() OVER (ORDER BY doc_id, place) AS row, ref, ref_raw, date, date_iso, type, amount FROM placed
      UNION ALL SELECT recon_id, 'B', row, ref, ref_raw, date, date_iso, type, amount FROM ({books})"""
    results, summary = (whole[name].replace(LINES, lines) for name in ("r21_reconcile", "r21_summary"))
    zero = ("total_references", "matched", "amount_diff", "extra_in_vendor", "missing_in_vendor", "combos_matched")
    money = ("net_difference", "vendor_net", "books_net", "amount_diff_value", "extra_in_vendor_value", "missing_in_vendor_value", "matched_residual")
    outcomes = ("rejected", "review", "unverified", "verified", "accepted")
    counted = f"SELECT recon_id, count(*) AS documents, {', '.join(f'count(*) FILTER (outcome = {chr(39)}{o}{chr(39)}) AS {o}' for o in outcomes)} FROM ({_X}{documents}) GROUP BY 1"
    filled = ", ".join([*(f"coalesce(s.{c}, 0) AS {c}" for c in zero), *(f"CAST(coalesce(s.{c}, 0) AS DOUBLE) AS {c}" for c in money), *(f"coalesce(d.{c}, 0) AS {c}" for c in ("documents", *outcomes))])
    summary = f"""SELECT coalesce(s.recon_id, d.recon_id) AS recon_id, {filled}, coalesce(matched_by_tier, '{{"1":0,"2":0,"3":0}}') AS matched_by_tier, CAST(1 AS DOUBLE) AS tolerance, coalesce(findings, '') AS findings, true AS rows_ok, true AS value_ok
      FROM ({summary}) AS s FULL JOIN ({counted}) AS d ON d.recon_id = s.recon_id"""
    return {"e01_documents": _X + documents, "e01_results": results, "e01_summary": summary}
