"""Whole workloads: extract, reconcile, and statements against the books."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stages import cut
from ..operators import grid as G
from ..operators import recon as R
from .extraction import extract_documents

#: What became of a document.  ``unverified``: mode ``verify`` had no other extraction to compare it with.
REJECTED, REVIEW, UNVERIFIED, VERIFIED, ACCEPTED = OUTCOMES = ("rejected", "review", "unverified", "verified", "accepted")


@dataclass(frozen=True)
class Statements:
    results: DataFrame  # of R21
    summary: DataFrame  # of R21, with a count of documents per outcome; also of reconciliations without any line
    documents: DataFrame  # doc_id, recon_id, outcome, engine, confidence, records, reason
    records: DataFrame  # of the engine chosen for each document


def statements_vs_books(grid: DataFrame, books: DataFrame, owner: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Statements are extracted, their records are the V lines, and ``books`` (lines without ``side``) the B lines.

    ``owner``: ``doc_id, recon_id``; without it a document is its own reconciliation.  Documents of one reconciliation
    follow one another by ``doc_id``: their rows are numbered on, so that no two lines share a number.
    """
    records, _ = G.extract(grid)
    if owner is not None:
        held = records.groupBy("doc_id").agg(F.max("row").cast("long").alias("n")).join(owner.distinct(), "doc_id")
        earlier = W.partitionBy("recon_id").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
        owned = records.join(held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"), "doc_id")
    else:
        owned = records.withColumns({"recon_id": F.col("doc_id"), "before": F.lit(0)})
    v = owned.select("recon_id", F.lit("V").alias("side"), (F.col("row") + F.col("before")).cast("long").alias("row"), "ref", "ref_raw", "date", "date_iso", "type", "amount")
    b = books.select("recon_id", F.lit("B").alias("side"), "row", "ref", "ref_raw", "date", "date_iso", "type", "amount")
    return R.reconcile(cut(v.unionByName(b)), **options)


def _outcome(verify: bool) -> Column:
    seen = F.when(F.col("engine") == "verified", VERIFIED)
    if verify:
        seen = seen.when(F.col("engine") == "parser", UNVERIFIED)
    # A verified document that was of low confidence before stays marked for review, as its metadata says.
    return F.when(F.col("needs_review"), REVIEW).otherwise(F.coalesce(seen, F.lit(ACCEPTED)))


def reconcile_statements(files: DataFrame, books: DataFrame, owner: DataFrame | None = None, mode: str = "auto", candidates: DataFrame | None = None, alt_docs: DataFrame | None = None, grids: DataFrame | None = None,
    reader_meta: DataFrame | None = None, threshold: float | None = None, max_mb: int = 10, **options) -> Statements:
    """E1 from files: ``extract_documents`` by ``mode``, then the chosen records as V lines against ``books`` as B lines.

    ``owner``: ``doc_id, recon_id``; without it a document is its own reconciliation.  A reconciliation that has documents
    is in the summary even if all of them were rejected: with its books as missing, or with nothing at all.  Documents
    without an owner are in ``documents`` with a null ``recon_id``, and in no reconciliation; one of several owners is in
    each.  Lines of a reconciliation follow one another by document and by their place in it.
    """
    given = {} if threshold is None else {"threshold": threshold}
    done = extract_documents(files, mode, candidates, alt_docs, grids, reader_meta, max_mb=max_mb, **given)
    last = F.when(F.size("warnings") > 0, F.element_at("warnings", -1))
    kept = done.meta.select("doc_id", _outcome(mode == "verify").alias("outcome"), "engine", "confidence", F.col("records").cast("long").alias("records"), last.alias("reason"))
    none = {"engine": "string", "confidence": "double", "records": "long"}
    lost = done.rejected.select("doc_id", F.lit(REJECTED).alias("outcome"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "reason")
    said = kept.unionByName(lost)
    owned = owner.select(F.col("doc_id").cast("string").alias("doc_id"), "recon_id").distinct() if owner is not None else said.select("doc_id", F.col("doc_id").alias("recon_id")).distinct()
    documents = cut(said.join(owned, "doc_id", "left").select("doc_id", "recon_id", "outcome", "engine", "confidence", "records", "reason"))

    records = cut(done.records)
    per_doc = records.groupBy("doc_id").agg(F.max("place").alias("n")).join(owned, "doc_id")
    earlier = W.partitionBy("recon_id").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    shifted = per_doc.withColumn("before", F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0))).drop("n")
    columns = ("ref", "ref_raw", "date", "date_iso", "type", "amount")
    v = records.join(shifted, "doc_id").select("recon_id", F.lit("V").alias("side"), (F.col("place") + F.col("before")).cast("long").alias("row"), *columns)
    b = books.select("recon_id", F.lit("B").alias("side"), F.col("row").cast("long").alias("row"), *columns)
    results, summary = R.reconcile(cut(v.unionByName(b)), **options)

    counts = documents.where("recon_id is not null").groupBy("recon_id").agg(F.count("*").alias("documents"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    whole = summary.join(counts, "recon_id", "full_outer")
    empty = {"matched_by_tier": F.create_map(*[x for t in "123" for x in (F.lit(t), F.lit(0).cast("long"))]), "findings": F.array().cast("array<string>"), "rows_ok": F.lit(True), "value_ok": F.lit(True), "tolerance": F.lit(float(options.get("tolerance", R.TOLERANCE)))}
    filled = {c: F.coalesce(c, empty.get(c, F.lit(0).cast(whole.schema[c].dataType))) for c in whole.columns if c != "recon_id"}
    return Statements(results, whole.withColumns(filled), documents, records)
