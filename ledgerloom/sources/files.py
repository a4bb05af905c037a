"""Sources and sinks (S1-S8): statement files to grids, transactions to lines, results to Parquet or JSON."""

from __future__ import annotations

import csv
import io
import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stages import cut

KNOWN = ("csv", "txt", "xlsx", "xlsm", "xltx", "xls", "docx", "pdf")
DELIMITERS = ",;\t|"
CELL = "struct<s: string, d: double, ts: timestamp, i: bigint>"
GRID = f"doc_id string, row_idx int, cells array<{CELL}>"
SHEET_ROWS, SCORED_ROWS = 5000, 60


def intake_files(files: DataFrame | str, max_mb: int = 10, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted files with ``ext``, and rejected ones with ``reason``.

    ``files``: ``doc_id, filename, length, ...`` or a path to read as binary files.
    """
    if isinstance(files, str):
        read = spark.read.format("binaryFile").load(files)
        files = read.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")
    ext = F.when(F.col("filename").contains("."), F.lower(F.element_at(F.split("filename", r"\."), -1))).otherwise("")
    reason = (
        F.when(F.col("length") > max_mb * 1024 * 1024, f"File exceeds {max_mb} MB limit")
        .when(F.col("length") == 0, "Empty file")
        .when(F.col("ext") == "doc", "Legacy .doc files are not supported")
        .when(~F.col("ext").isin(*KNOWN), F.concat(F.lit("Unsupported file type '."), F.col("ext"), F.lit("'")))
    )
    judged = files.withColumn("ext", ext).withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("content")


def decode(content: bytes) -> str:
    """UTF-8 with or without a byte order mark, else Windows-1256."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1256")


def parse_delimited(content: bytes) -> list[list[str]]:
    """Rows of a file whose lines may end in any way; fields of any length."""
    csv.field_size_limit(sys.maxsize)
    text = decode(content)
    try:
        found = csv.Sniffer().sniff(text[:4000], delimiters=DELIMITERS)
        delimiter, quote = found.delimiter, found.quotechar or '"'
    except csv.Error:
        delimiter, quote = ",", '"'
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote))


def read_delimited(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, content`` to a grid, and ``doc_id, reason`` of the files that could not be read.

    A file stays in one task; blank lines are empty rows and keep their number.  A file that fails costs no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.struct([("s", pa.string()), ("d", pa.float64()), ("ts", pa.timestamp("us", "UTC")), ("i", pa.int64())])
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows, error = parse_delimited(content.as_py() or b""), None
                except (csv.Error, ValueError, RecursionError) as e:
                    rows, error = [], f"Parser failed: {e}"
                for at in range(0, max(len(rows), error is not None), 10_000):
                    part = rows[at : at + 10_000] or [None]
                    sizes = [len(r or ()) for r in part]
                    flat = pa.array([c for r in part for c in r or ()], pa.string())
                    struct = pa.StructArray.from_arrays([flat, *(pa.nulls(len(flat), f.type) for f in list(cell)[1:])], fields=list(cell))
                    cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), struct)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), cells, pa.array([error] * len(part), pa.string())], names=["doc_id", "row_idx", "cells", "reason"])

    read = cut(files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, GRID + ", reason string"))
    return read.where("reason is null").drop("reason"), read.where("reason is not null").select("doc_id", "reason")


def pick_sheet(sheet_cells: DataFrame) -> DataFrame:
    """S3: of ``doc_id, sheet_idx, sheet, row_idx, cells`` the best sheet of each document, with ``sheet``.

    A row with an amount and two cells scores 1 and up to 3 of its amounts; ties go to the earlier sheet.
    """
    kept = sheet_cells.where(F.col("row_idx") < SHEET_ROWS)
    whole = "i" in kept.schema["cells"].dataType.elementType.fieldNames()

    def read(c: Column) -> Column:
        number = F.coalesce(c["d"], c["i"].cast("double")) if whole else c["d"]
        return F.struct(F.coalesce(S.finite(number), S.parse_amount(c["s"])).alias("amt"), (F.coalesce(c["s"], F.when(number.isNotNull() | c["ts"].isNotNull(), "x"), F.lit("")) != "").alias("full"))

    seen = F.transform("cells", lambda c: F.struct(read(c)["amt"].isNotNull().alias("amount"), read(c)["full"].alias("full")))
    counts = S.let(seen, lambda x: F.struct(F.size(F.filter(x, lambda y: y["amount"])).alias("amounts"), F.size(F.filter(x, lambda y: y["full"])).alias("full")))
    points = S.let(counts, lambda n: F.when((n["amounts"] >= 1) & (n["full"] >= 2), 1 + F.least(n["amounts"], F.lit(3))).otherwise(0))
    score = F.when(F.col("row_idx") < SCORED_ROWS, points).otherwise(0)
    scored = kept.select("doc_id", "sheet_idx", score.alias("score")).groupBy("doc_id", "sheet_idx").agg(F.sum("score").alias("score"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("sheet_idx")).alias("first"))).alias("b")).select("doc_id", (-F.col("b.first")).alias("sheet_idx"))
    return kept.join(best, ["doc_id", "sheet_idx"]).select("doc_id", "row_idx", "cells", "sheet")


def words_to_rows(words: DataFrame, line_tol: float = 3.0) -> DataFrame:
    """``doc_id, page, word_idx, text, x0, x1, top`` to ``doc_id, page, row_idx, cells``.

    Words are taken from the top down; one that no line's first word is within ``line_tol`` of starts a line, and a word
    belongs to the oldest line it is near to.  So the tops at which lines start are a fold over a page's sorted tops.  Lines
    start more than ``line_tol`` apart, and tops fall back by a rounding at most, so only the last few starts can be near: the
    fold looks at no others, and a word meets the lines of its own stretch of the page and of the next ones.  Inside a line a
    gap wider than 1.8 usual letters (7 at least) parts cells.
    """
    recent = 2 + math.ceil(0.2 / line_tol)
    key, kind = ["doc_id", "page"], "array<double>"
    down = F.struct(F.bround("top", 1).alias("y"), "x0", "word_idx")
    tops = F.transform(F.array_sort(F.collect_list(F.struct(down.alias("at"), "top"))), lambda w: w["top"])
    near = lambda t: lambda a: F.abs(a - t) <= line_tol
    last = lambda got: F.slice(got, F.greatest(F.size(got) - recent + 1, F.lit(1)), F.lit(recent))
    starts = F.aggregate(tops, F.array().cast(kind), lambda got, t: F.when(F.exists(last(got), near(t)), got).otherwise(F.concat(got, F.array(t))))
    lines = words.groupBy(*key).agg(starts.alias("starts")).select(*key, F.posexplode("starts").alias("line", "start"))
    lines = lines.withColumn("line", F.col("line") + 1)
    stretch = lambda c: F.floor(F.col(c) / line_tol)
    reach = lines.withColumn("stretch", F.explode(F.array(*[stretch("start") + k for k in (-1, 0, 1)])))
    met = words.withColumn("stretch", stretch("top")).join(reach, [*key, "stretch"]).where(F.abs(F.col("start") - F.col("top")) <= line_tol)
    own = met.groupBy(*key, "word_idx").agg(F.min("line").alias("line"))
    placed = words.join(own, [*key, "word_idx"])
    line = W.partitionBy(*key, "line")
    across = line.orderBy("x0", down)
    wide = F.array_sort(F.collect_list((F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))).over(line))
    gap = F.greatest(1.8 * F.get(wide, F.floor(F.size(wide) / 2).cast("int")), F.lit(7.0))
    apart = F.col("x0") - F.lag("x1").over(across) > F.col("gap")
    parted = placed.withColumn("gap", gap).withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
    celled = parted.withColumn("cell", F.sum("new").over(across.rowsBetween(W.unboundedPreceding, 0))).withColumn("k", F.row_number().over(across))
    cells = celled.groupBy(*key, "line", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda w: w["text"]), " ").alias("s"))
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("d", "double"), ("ts", "timestamp"), ("i", "bigint"))]
    whole = cells.groupBy(*key, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "s"))), lambda c: F.struct(F.nullif(S.strip(c["s"]), F.lit("")).alias("s"), *empty)).alias("cells"))
    return whole.select(*key, (F.col("line") - 1).cast("int").alias("row_idx"), "cells")


def split_line(c: Column) -> Column:
    """Parts of a text line between wide gaps, else between any whitespace; empty parts are null."""
    s = S.strip(c)
    wide = F.split(s, r"(?U)\s{2,}|\t")
    words = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))
    return F.transform(F.when(F.size(wide) < 2, words).otherwise(wide), lambda p: F.nullif(S.strip(p), F.lit("")))


def select_blocks(table_rows: DataFrame, word_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S6 of paged documents alone: the grid, and ``doc_id, tables, text_pages, scanned`` of documents with any row."""
    docs = table_rows.select("doc_id").union(word_rows.select("doc_id")).distinct().withColumn("kind", F.lit("pdf"))
    grid, meta = document_blocks(docs, table_rows, word_rows)
    return grid, meta.drop("reader")


def document_blocks(docs: DataFrame, table_rows: DataFrame, word_rows: DataFrame | None = None, paragraphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What of a document becomes its grid, by its kind.

    ``docs``: ``doc_id, kind``, a row per document, also of those that no row came out of.  ``table_rows``: ``doc_id, page,
    table_idx, row_idx, cells`` (``page`` null in a word-processor file); ``word_rows``: ``doc_id, page, row_idx, cells``;
    ``paragraphs``: ``doc_id, para_idx, text``.

    ``pdf``: of each page the rows of its tables of two rows or more if it has one, else its word lines; a document without
    any row is ``scanned``.  ``docx``: the rows of all tables, be it one row; paragraphs (S5) only where the document has no
    table row at all.  Cells are trimmed, empty ones null.  Gives the grid, renumbered, and ``doc_id, reader, tables,
    text_pages, scanned`` of every document of these kinds (the last two null for ``docx``); other kinds are left out.
    """
    of = lambda kind: docs.where(F.col("kind") == kind).select("doc_id")
    trimmed = lambda d: d.withColumn("cells", F.transform("cells", lambda c: c.withField("s", F.nullif(S.strip(c["s"]), F.lit("")))))
    shape = ("doc_id", "page", "table_idx", "row_idx", "cells")
    paged, flowing = (trimmed(table_rows.join(of(kind), "doc_id", "left_semi")) for kind in ("pdf", "docx"))
    good = paged.groupBy("doc_id", "page", "table_idx").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    parts = [paged.join(good, ["doc_id", "page", "table_idx"]).select(*shape), flowing.withColumn("page", F.lit(0)).select(*shape)]
    tables = good.select("doc_id").unionByName(flowing.select("doc_id", "table_idx").distinct().select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("tables"))
    meta = docs.where(F.col("kind").isin("pdf", "docx")).select("doc_id", F.col("kind").alias("reader")).join(tables, "doc_id", "left")
    if word_rows is not None:
        lines = trimmed(word_rows.join(of("pdf"), "doc_id", "left_semi")).join(good.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
        parts.append(lines.withColumn("table_idx", F.lit(0)).select(*shape))
        meta = meta.join(lines.groupBy("doc_id").agg(F.countDistinct("page").alias("text_pages")), "doc_id", "left")
    else:
        meta = meta.withColumn("text_pages", F.lit(None).cast("long"))
    if paragraphs is not None:
        kind = table_rows.schema["cells"].dataType.elementType
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields if f.name != "s"]
        cells = F.transform(split_line(F.col("text")), lambda p: F.struct(p.alias("s"), *rest))
        text = paragraphs.join(of("docx"), "doc_id", "left_semi").join(flowing.select("doc_id").distinct(), "doc_id", "left_anti").where(S.strip(F.col("text")) != "")
        parts.append(text.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("table_idx"), F.col("para_idx").alias("row_idx"), cells.alias("cells")))
    order = W.partitionBy("doc_id").orderBy("page", "table_idx", "row_idx")
    grid = reduce(DataFrame.unionByName, parts).withColumn("row_idx", (F.row_number().over(order) - 1).cast("int")).select("doc_id", "row_idx", "cells")
    pdf = F.col("reader") == "pdf"
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    scanned = F.when(pdf, (n("tables") == 0) & (n("text_pages") == 0))
    return grid, meta.select("doc_id", "reader", n("tables").alias("tables"), F.when(pdf, n("text_pages")).alias("text_pages"), scanned.alias("scanned"))


TRANSACTION = "array<struct<ref: string, refRaw: string, date: string, dateISO: string, type: string, amount: string>>"


def transactions_to_lines(bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``recon_id, vendor, books`` (arrays of transactions) to lines, ids with no transaction at all, and payments
    whose amount is no number (left out of the lines).  NaN and infinity are no numbers."""
    empty = (F.coalesce(F.size("vendor"), F.lit(0)) <= 0) & (F.coalesce(F.size("books"), F.lit(0)) <= 0)
    some = bodies.where(~empty)
    one = lambda col, side: some.select("recon_id", F.lit(side).alias("side"), F.posexplode(col).alias("row", "t"))
    t = one("vendor", "V").union(one("books", "B")).where("t is not null")
    lines = t.select("recon_id", "side", F.col("row").cast("long").alias("row"), "t.ref", F.col("t.refRaw").alias("ref_raw"), "t.date", F.col("t.dateISO").alias("date_iso"), "t.type", F.col("t.amount").alias("text"), S.finite(F.trim("t.amount").try_cast("double")).alias("amount"))
    bad = S.is_payment(F.col("type")) & F.col("text").isNotNull() & F.col("amount").isNull()
    return lines.where(~bad).drop("text"), bodies.where(empty).select("recon_id"), lines.where(bad).drop("amount")


#: Why a body is refused.
NO_JSON, NO_ID, NO_LISTS, BOTH_EMPTY = "Body is not a JSON object", "recon_id is missing", "vendorTransactions and booksTransactions must be arrays", "Both transaction lists are empty"


def bodies_to_lines(bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S7 from JSON texts: ``place, value`` (any key, one body) to lines, refused bodies ``place, recon_id, reason``, and lines refused.

    A body has ``recon_id, vendorTransactions, booksTransactions``.  Values keep their JSON types until they are read: an
    amount may be a number, a text that holds one, or a truth value (1 or 0); anything else is no amount.  References, dates
    and types are taken as text, whatever they were.  A line is exploded by itself; no struct of a whole body is made.  Lines
    that are no object have no values; payment lines whose amount is given and no number are refused, as in
    ``transactions_to_lines``.
    """
    body = F.try_parse_json("value")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("body", path, "variant"))
    read = bodies.select("place", body.alias("body"))
    read = read.select("place", "body", F.schema_of_variant("body").alias("kind"), F.try_variant_get("body", "$.recon_id", "string").alias("recon_id"), *[kind(f"$.{n}Transactions").alias(n) for n in ("vendor", "books")])
    lists = [F.coalesce(F.col(n), F.lit("")).startswith("ARRAY") for n in ("vendor", "books")]
    none = [F.coalesce(F.try_variant_get("body", f"$.{n}Transactions[0]", "variant").isNull(), F.lit(True)) for n in ("vendor", "books")]
    why = F.when(~F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)), NO_JSON).when(F.coalesce("recon_id", F.lit("")) == "", NO_ID).when(~(lists[0] & lists[1]), NO_LISTS).when(none[0] & none[1], BOTH_EMPTY)
    judged = read.withColumn("reason", why)
    good = judged.where("reason is null")
    one = lambda n, side: good.lateralJoin(good.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("body").outer(), f"$.{n}Transactions", "variant"))).select("recon_id", F.lit(side).alias("side"), F.col("pos").cast("long").alias("row"), F.col("value").alias("t"))
    text = lambda f: F.try_variant_get("t", f"$.{f}", "string")
    amount_kind = F.schema_of_variant(F.try_variant_get("t", "$.amount", "variant"))
    number = F.when(amount_kind == "BOOLEAN", F.try_variant_get("t", "$.amount", "boolean").cast("double")).when(amount_kind == "STRING", F.trim(text("amount")).try_cast("double")).when(~amount_kind.rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get("t", "$.amount", "double"))
    lines = one("vendor", "V").union(one("books", "B")).select(
        "recon_id", "side", "row", text("ref").alias("ref"), text("refRaw").alias("ref_raw"), text("date").alias("date"), text("dateISO").alias("date_iso"), text("type").alias("type"),
        F.when(amount_kind != "VOID", F.coalesce(text("amount"), amount_kind)).alias("text"), S.finite(number).alias("amount"),
    )
    bad = S.is_payment(F.col("type")) & F.col("text").isNotNull() & F.col("amount").isNull()
    return lines.where(~bad).drop("text"), judged.where("reason is not null").select("place", "recon_id", "reason"), lines.where(bad).drop("amount")


def read_transactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S7 from JSON lines: lines, refused bodies (``place`` is the file and the text itself is not kept), and lines refused."""
    return bodies_to_lines(spark.read.text(path).select(F.input_file_name().alias("place"), "value").where("trim(value) <> ''"))


def write_extract(records: DataFrame, meta: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S8."""
    records.write.format(fmt).mode("overwrite").save(f"{path}/records")
    meta.write.format(fmt).mode("overwrite").save(f"{path}/meta")


def write_recon(results: DataFrame, summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S8."""
    results.write.format(fmt).mode("overwrite").save(f"{path}/results")
    summary.write.format(fmt).mode("overwrite").save(f"{path}/summary")


#: Results in a part of a response.
PART_ROWS = 10_000


def responses(results: DataFrame, summary: DataFrame) -> DataFrame:
    """``recon_id, response``: one JSON text per reconciliation, results in their order.  For small ones: see ``response_parts``."""
    rows = results.groupBy("recon_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in results.columns if c not in ("recon_id", "ord")]))).alias("results"))
    both = summary.select("recon_id", F.struct(*[c for c in summary.columns if c != "recon_id"]).alias("summary")).join(rows, "recon_id", "left")
    return both.select("recon_id", F.to_json(F.struct("summary", "results")).alias("response"))


def response_parts(results: DataFrame, summary: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """S8 in parts: ``recon_id, part, parts, n, response``; no row holds more than ``rows`` results, however many there are.

    Parts are numbered from 0; part 0 has the summary too, and is there even without results.  ``ord`` counts from 1 without
    gaps, so a part is known from a row alone.
    """
    placed = results.withColumn("part", F.floor((F.col("ord") - 1) / rows).cast("int"))
    fields = [c for c in results.columns if c not in ("recon_id", "ord")]
    held = placed.groupBy("recon_id", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("results"))
    parts = placed.groupBy("recon_id").agg((F.max("part") + 1).alias("parts"))
    first = summary.join(parts, "recon_id", "left").select("recon_id", F.coalesce("parts", F.lit(1)).alias("parts"), F.struct(*[c for c in summary.columns if c != "recon_id"]).alias("summary"))
    numbered = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("summary", F.when(F.col("part") == 0, F.col("summary")))
    whole = numbered.join(held, ["recon_id", "part"], "left")
    return whole.select("recon_id", "part", "parts", F.coalesce("n", F.lit(0)).alias("n"), F.to_json(F.struct("summary", "results")).alias("response"))


def write_responses(results: DataFrame, summary: DataFrame, path: str, batch: str, rows: int = PART_ROWS) -> None:
    """``response_parts`` under ``path/batch=...``, and a manifest ``recon_id, parts, results`` beside them.

    A batch is replaced as a whole and others stay as they are, so a run that is repeated leaves no part of the one before.
    """
    parts = response_parts(results, summary, rows).withColumn("batch", F.lit(batch))
    write = lambda d: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
    write(parts.repartitionByRange("recon_id", "part").sortWithinPartitions("recon_id", "part")).parquet(f"{path}/parts")
    written = parts.sparkSession.read.parquet(f"{path}/parts").where(F.col("batch") == batch)
    write(written.groupBy("batch", "recon_id").agg(F.max("parts").alias("parts"), F.sum("n").alias("results"))).parquet(f"{path}/manifest")


def read_responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results of all batches under ``path``, as rows of ``schema`` (their fields without ``recon_id``), with ``batch``."""
    kind = f"struct<results: array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in schema.split(','))}>>>"
    parts = spark.read.parquet(f"{path}/parts")
    return parts.select("batch", "recon_id", F.explode(F.from_json("response", kind)["results"]).alias("r")).select("batch", "recon_id", "r.*")
