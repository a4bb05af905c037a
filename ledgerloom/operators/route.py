"""Cross-check of two extractions of the same documents, and the choice between them (V1-V9).

``primary``: metadata of G16; ``alternate``: metadata of V2.  ``present`` tells whether the alternate extraction exists at
all; ``error`` carries why it failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .grid import COLUMNS, RECORD, money_text, totals_check

MAX_ROWS, THRESHOLD, SAMPLE = 2000, 0.75, 20
ALTERNATE = "alternate"


def validate_records(candidates: DataFrame, max_rows: int = MAX_ROWS, place: bool = False) -> DataFrame:
    """V1: the first ``max_rows`` candidates of a document, then those with a reference and an amount (NaN and infinity are none).

    ``place``: with the place of each among the document's candidates, in a column of that name.
    """
    first = candidates.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where(F.col("n") <= max_rows)
    ref, amount = S.norm_ref(F.col("ref")), S.finite(F.trim("amount").try_cast("double"))
    iso = F.when(F.col("date_iso").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_iso"))
    out = first.select("doc_id", ref.alias("ref"), S.strip(F.coalesce("ref", F.lit(""))).alias("ref_raw"), F.coalesce("date", F.lit("")).alias("date"), iso.alias("date_iso"), F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("Invoice")).alias("type"), F.round(amount, 2).alias("amount"), F.lit(None).cast("int").alias("row"), *([F.col("pos").cast("long").alias("place")] if place else []))
    return out.where("ref <> '' and amount is not null")


def alternate_meta(records: DataFrame, alt_docs: DataFrame) -> DataFrame:
    """V2: ``doc_id, present, error, records, confidence, totals_check``; of no valid record the extraction has failed."""
    sums = records.groupBy("doc_id").agg(F.count("*").alias("records"), (F.sum(F.round(F.col("amount") * 100).cast("long")) / 100.0).alias("s"))
    d = alt_docs.join(sums, "doc_id", "left").withColumn("records", F.coalesce("records", F.lit(0)).cast("long"))
    check = totals_check(F.col("document_total"), F.col("s"), F.col("records") > 0)
    failed = F.coalesce("present", F.lit(False)) & F.col("error").isNull() & (F.col("records") == 0)
    d = d.withColumns({"totals_check": check, "error": F.when(failed, "no valid records").otherwise(F.col("error")), "present": F.coalesce("present", F.lit(False)) & (F.col("records") > 0) & F.col("error").isNull()})
    return d.select("doc_id", "present", "error", "records", F.when(~F.col("totals_check.ok"), 0.7).otherwise(0.9).alias("confidence"), "totals_check")


def keyed(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "ref", F.round(F.col("amount") * 100).cast("long").alias("cents")).distinct()


def agreement(a: DataFrame, b: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """V3: ``doc_id, rate, agreed, disagreed`` of the sets of (reference, amount); two empty sets have rate 0."""
    both = keyed(a).withColumn("a", F.lit(1)).join(keyed(b).withColumn("b", F.lit(1)), ["doc_id", "ref", "cents"], "full_outer")
    n = both.groupBy("doc_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("agreed"), F.count("*").alias("all"))
    if docs is not None:
        n = docs.select("doc_id").distinct().join(n, "doc_id", "left").fillna(0, ["agreed", "all"])
    return n.select("doc_id", F.round(F.col("agreed") / F.greatest("all", F.lit(1)), 3).alias("rate"), "agreed", (F.col("all") - F.col("agreed")).alias("disagreed"))


def disagreements(a: DataFrame, b: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """V4: ``doc_id, only_a, only_b``: the first ``limit`` of each difference, as sorted text."""
    both = keyed(a).withColumn("a", F.lit(1)).join(keyed(b).withColumn("b", F.lit(1)), ["doc_id", "ref", "cents"], "full_outer").where("a is null or b is null")
    text = F.concat("ref", F.lit(" "), money_text(F.col("cents") / 100.0))
    ranked = both.select("doc_id", F.col("a").isNotNull().alias("in_a"), text.alias("t")).withColumn("k", F.row_number().over(W.partitionBy("doc_id", "in_a").orderBy("t"))).where(F.col("k") <= limit)
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("t"))))
    return ranked.groupBy("doc_id").agg(pick(F.col("in_a")).alias("only_a"), pick(~F.col("in_a")).alias("only_b"))


def _choice(primary: DataFrame, alt: DataFrame) -> DataFrame:
    a = alt.select("doc_id", F.col("present").alias("alt_present"), F.col("error").alias("alt_error"), F.col("confidence").alias("alt_confidence"))
    return primary.join(a, "doc_id", "left").withColumn("alt_present", F.coalesce("alt_present", F.lit(False)))


def _add(warnings: Column, *more: Column) -> Column:
    return F.concat(warnings, F.array_compact(F.array(*more)))


def finalize_primary(p: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """V8: documents with records, those of low confidence marked for review; and the others with a reason."""
    low = F.col("confidence") < threshold
    warned = _add(F.col("warnings"), F.when(low, F.concat(F.lit("Low confidence ("), F.regexp_replace(F.col("confidence").cast("string"), r"(\.\d)0+$", "$1"), F.lit(") — review before reconciling"))))
    ok = p.where("records > 0").withColumns({"warnings": warned, "needs_review": low})
    return ok, p.where("records = 0").select("doc_id", F.lit("No transactions could be extracted from this file").alias("reason"))


def route_auto(primary: DataFrame, alt: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """V5: ``doc_id, engine, warnings``: the primary if it is confident, else the alternate if there is one."""
    d = _choice(primary, alt)
    sure = (F.col("records") > 0) & (F.col("confidence") >= threshold)
    engine = F.when(~sure & F.col("alt_present"), ALTERNATE).otherwise("parser")
    return d.select("doc_id", engine.alias("engine"), _add(F.col("warnings"), F.when(~sure & ~F.col("alt_present") & F.col("alt_error").isNotNull(), F.concat(F.lit("Alternate extraction failed: "), "alt_error"))).alias("warnings"))


def route_prefer_alternate(primary: DataFrame, alt: DataFrame) -> DataFrame:
    """V6: the alternate if there is one, else the primary with a warning."""
    d = _choice(primary, alt)
    why = F.when(F.col("alt_error").isNotNull(), F.concat(F.lit("Alternate extraction failed ("), F.col("alt_error"), F.lit(") — deterministic result returned"))).otherwise("Alternate extraction is not available")
    return d.select("doc_id", F.when(F.col("alt_present"), ALTERNATE).otherwise("parser").alias("engine"), _add(F.col("warnings"), F.when(~F.col("alt_present"), why)).alias("warnings"))


def route_verify(primary: DataFrame, alt: DataFrame, rates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """V7: the primary as verified where both agree, else the alternate for review; the primary where there is no other."""
    d = _choice(primary, alt).join(rates, "doc_id", "left").withColumns({"rate": F.coalesce("rate", F.lit(0.0)), "disagreed": F.coalesce("disagreed", F.lit(0))})
    agree = F.col("alt_present") & (F.col("rate") >= 0.999) & (F.col("records") > 0)
    engine = F.when(agree, "verified").when(F.col("alt_present"), f"{ALTERNATE}+review").otherwise("parser")
    low = F.col("confidence") < threshold
    said = F.when(F.col("alt_present") & ~agree, F.concat(F.lit("Both extractions disagree on "), F.col("disagreed").cast("string"), F.lit(" rows — review before reconciling"))).when(~F.col("alt_present"), "Verify mode: no alternate extraction — deterministic result returned")
    return d.select(
        "doc_id", engine.alias("engine"), F.when(agree, 1.0).when(F.col("alt_present"), F.col("alt_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("alt_present") & ~agree, True).otherwise(low).alias("needs_review"), _add(F.when(F.col("alt_present") & ~agree, F.array().cast("array<string>")).otherwise(F.col("warnings")), said).alias("warnings"), "rate", "disagreed",
    )


def alternate_response_meta(primary: DataFrame, alt: DataFrame) -> DataFrame:
    """V9: column metadata of the primary (-1 by default) under that of the alternate, with what the primary said."""
    names = ["header_row", "total_rows", *[c for c in COLUMNS if c != "desc_col"]]
    p = primary.select("doc_id", *names, F.col("confidence").alias("parser_confidence"), F.col("warnings").alias("parser_warnings"))
    a = alt.where("present").select("doc_id", "confidence", "totals_check", "records")
    j = a.join(p, "doc_id", "left")
    return j.select("doc_id", *[F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in names], "confidence", "totals_check", "records", F.coalesce("parser_confidence", F.lit(0.0)).alias("parser_confidence"), F.coalesce("parser_warnings", F.array().cast("array<string>")).alias("parser_warnings"), F.lit(ALTERNATE).alias("engine"))


def chosen_records(primary: DataFrame, alternate: DataFrame, choice: DataFrame) -> DataFrame:
    """The records of the engine chosen for each document of ``choice``, with their ``place`` in it if both have one."""
    columns = [*RECORD, *(["place"] if "place" in primary.columns and "place" in alternate.columns else [])]
    mine = choice.select("doc_id", F.col("engine").startswith(ALTERNATE).alias("other"))
    pick = lambda d, other: d.select(*columns).join(mine.where(F.col("other") == other).select("doc_id"), "doc_id", "left_semi").select(*columns)
    return pick(primary, False).unionByName(pick(alternate, True))
