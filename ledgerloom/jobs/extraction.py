"""Extraction of many documents as one job: intake, grids, records, the choice of engine, and what is rejected and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import cut
from ..operators import grid as G
from ..operators import route as V
from ..sources import files as S

#: ``parser``: the grids alone; ``alternate``: the other engine where it has an answer; ``verify``: both, compared;
#: ``auto``: the other engine only where the grids' confidence is low.
MODES = ("auto", "parser", "alternate", "verify")
TEXT_FILES = ("csv", "txt")
NOTHING = "No transactions could be extracted from this file"


@dataclass(frozen=True)
class Extraction:
    records: DataFrame  # of the engine chosen for each document, with their place in it
    meta: DataFrame  # a row per document that was not rejected
    rejected: DataFrame  # doc_id, reason


def extract_documents(
    files: DataFrame, mode: str = "auto", candidates: DataFrame | None = None, alt_docs: DataFrame | None = None, grids: DataFrame | None = None,
    reader_meta: DataFrame | None = None, threshold: float = V.THRESHOLD, max_mb: int = 10,
) -> Extraction:
    """``files`` (``doc_id, filename, length, content``) to records by ``mode``.

    Delimited files are read here; ``grids`` (and ``reader_meta``) hold what other readers made of the other files.
    ``candidates`` and ``alt_docs`` are the other engine's answers (V1, V2).  A document is rejected by intake (any
    mode), or where the chosen engine is the parser and it has no record; a file that could not be read tells why.
    ``meta`` has ``engine, confidence, needs_review, warnings``, counts and columns, what the parser said where the other
    engine was chosen, and in mode ``verify`` the comparison: ``rate, agreed_rows, parser_only, alternate_only``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = files.sparkSession
    accepted, refused = S.intake_files(files.withColumn("doc_id", F.col("doc_id").cast("string")), max_mb)
    grid, failed = S.read_delimited(accepted.where(F.col("ext").isin(*TEXT_FILES)))
    if grids is not None:
        given = grids.join(accepted.where(~F.col("ext").isin(*TEXT_FILES)).select("doc_id"), "doc_id", "left_semi")
        grid = grid.unionByName(given, allowMissingColumns=True)
    known = accepted.select("doc_id")
    about = known.join(reader_meta, "doc_id", "left") if reader_meta is not None else known
    records, meta = G.extract(grid, about)
    errors = failed.withColumnRenamed("reason", "parser_error")
    primary = cut(meta.join(errors, "doc_id", "left"))
    records = cut(records.withColumn("place", F.col("row").cast("long")))

    candidates = candidates if candidates is not None else spark.createDataFrame([], "doc_id string, pos int, ref string, date string, date_iso string, type string, amount string")
    alt_docs = alt_docs if alt_docs is not None else spark.createDataFrame([], "doc_id string, document_total double, present boolean, error string")
    others = cut(V.validate_records(candidates.join(known, "doc_id", "left_semi"), place=True))
    alternate = cut(V.alternate_meta(others, alt_docs.join(known, "doc_id", "left_semi")))

    if mode == "auto":
        choice = V.route_auto(primary, alternate, threshold)
    elif mode == "alternate":
        choice = V.route_prefer_alternate(primary, alternate)
    elif mode == "verify":
        choice = V.route_verify(primary, alternate, V.agreement(records, others), threshold)
    else:
        choice = primary.select("doc_id", F.lit("parser").alias("engine"), "warnings")
    choice = cut(choice.select("doc_id", "engine", F.col("warnings").alias("said")))

    # The parser's answers, judged; then the other engine's.
    own = primary.drop("parser_error").join(choice.where(~F.col("engine").startswith(V.ALTERNATE)), "doc_id").withColumn("warnings", F.col("said"))
    kept, without = V.finalize_primary(own, threshold)
    kept = kept.withColumn("confidence", F.when(F.col("engine") == "verified", 1.0).otherwise(F.col("confidence")))
    theirs = V.alternate_response_meta(primary, alternate).drop("engine").join(choice.where(F.col("engine").startswith(V.ALTERNATE)), "doc_id")
    review = F.col("engine") == f"{V.ALTERNATE}+review"
    theirs = theirs.withColumns({"warnings": F.when(review, F.col("said")).otherwise(F.array().cast("array<string>")), "needs_review": review}).join(primary.select("doc_id", "parser_error"), "doc_id")
    shared = ("doc_id", "engine", "header_row", "total_rows", *[c for c in G.COLUMNS if c != "desc_col"], "records", "confidence", "needs_review", "warnings", "totals_check")
    number: dict[str, Column] = {c: F.col(c).cast("long").alias(c) for c in ("header_row", "total_rows", "records", *G.COLUMNS)}
    pick = lambda d, *more: d.select(*[number.get(c, F.col(c)) for c in shared], *more)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("parser_confidence", "double"), ("parser_warnings", "array<string>"), ("parser_error", "string"))]
    meta = pick(kept, "data_rows", "invalid_rows", *nothing).unionByName(pick(theirs, "parser_confidence", "parser_warnings", "parser_error"), allowMissingColumns=True)
    if mode == "verify":
        rates = V.agreement(records, others, choice).select("doc_id", "rate", F.col("agreed").alias("agreed_rows"))
        apart = V.disagreements(records, others).withColumnsRenamed({"only_a": "parser_only", "only_b": "alternate_only"})
        compared = rates.join(apart, "doc_id", "left").join(alternate.where("present").select("doc_id"), "doc_id", "left_semi")
        some = {c: F.when(F.col("rate").isNotNull(), F.coalesce(c, F.array().cast("array<string>"))) for c in ("parser_only", "alternate_only")}
        meta = meta.join(compared, "doc_id", "left").withColumns(some)
    meta = cut(meta)
    why = F.coalesce("parser_error", F.lit(NOTHING))
    rejected = refused.select("doc_id", "reason").union(without.select("doc_id").join(errors, "doc_id", "left").select("doc_id", why.alias("reason")))
    chosen = V.chosen_records(records, others, meta.select("doc_id", "engine"))
    return Extraction(chosen, meta, rejected)
