"""Queries of the reconciliation (R1-R21, E1) over lines derived from every order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import cut
from ..jobs.statements import Statements, reconcile_statements, statements_vs_books
from ..operators import recon as R
from .extraction import statement_oracles
from .derived import CONTENDED, ITEMS, LINES, RECORDS, SKEWED, candidates, from_sql, grid, lines

TOL, WINDOW = 100, R.DATE_WINDOW
_OWNER = "CASE WHEN CAST({0} AS BIGINT) % 17 = 7 THEN -CAST({0} AS BIGINT) ELSE CAST(floor(CAST({0} AS BIGINT) / 2) AS BIGINT) END"
_BOOKS = f"""SELECT {_OWNER.format('doc_id')} AS recon_id, CAST(substr(ref, length(ref) - 7, 8) AS BIGINT) AS row, ref, ref AS ref_raw, date, date_iso, type, amount FROM ({RECORDS}) AS r
  WHERE CAST(substr(ref, length(ref) - 7, 8) AS BIGINT) % 30 <> 0 AND CAST(doc_id AS BIGINT) % 17 <> 7"""


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V and B references, and the payment lines."""
    by_ref, pays = R.split_lanes(lines(spark, sf_dir))
    refs = cut(R.aggregate_refs(by_ref))
    return R.side(refs, "V"), R.side(refs, "B"), pays


def _relaxed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """V, B, the pairs of tier 1 and the three relaxed passes, and what is open after them."""
    v, b, _ = _lanes(spark, sf_dir)
    done = [R.match_exact(v, b)]
    vo, bo = R.open_items(v, done[0], "vref"), R.open_items(b, done[0], "zref")
    for step, (label, key) in enumerate(R.RELAXED, 1):
        vo, bo = cut(vo), cut(bo)
        done.append(cut(R.match_relaxed(vo, bo, label, key, step)))
        vo, bo = R.open_items(vo, done[-1], "vref"), R.open_items(bo, done[-1], "zref")
    return v, b, reduce(DataFrame.unionByName, done), cut(vo), cut(bo)


def r01_split_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_ref, pays = R.split_lanes(lines(spark, sf_dir))
    both = by_ref.select("recon_id", "side", F.lit("ref").alias("lane"), "cents").union(pays.select("recon_id", "side", F.lit("payment").alias("lane"), "cents"))
    return both.groupBy("recon_id", "side", "lane").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def r02_aggregate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_ref, _ = R.split_lanes(lines(spark, sf_dir))
    return R.aggregate_refs(by_ref).select("recon_id", "side", "ref", "ref_raw", R.money(F.col("cents")).alias("amount"), "lines", "date", "date_raw", F.array_join("types", "|").alias("types"))


def r03_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, b, _ = _lanes(spark, sf_dir)
    return R.match_exact(v, b).select("recon_id", "vref", "zref", "tier")


def r04_match_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relaxed(spark, sf_dir)[2].where("tier = 2").select("recon_id", "vref", "zref", "note")


def _whole(spark: SparkSession, sf_dir: str) -> R.Matching:
    """Every pass over every line."""
    return R.match_lines(cut(lines(spark, sf_dir)), TOL)


def r05_match_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, vo, bo = _relaxed(spark, sf_dir)
    return R.match_typo(vo, bo, TOL).select("recon_id", "vref", "zref", "note")


def r05_typo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, vo, bo = _relaxed(spark, sf_dir)
    return R.typo_candidates(vo, bo, TOL).select("recon_id", "v", "b")


def r06_match_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).value.select("recon_id", "vref", "zref", "note")


def r07_match_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).combos.select("recon_id", "ref", F.array_join("parts", "|").alias("parts"), "direction", R.money(F.col("resid")).alias("resid"))


def r08_match_payment_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    pays = _lanes(spark, sf_dir)[2]
    return R.match_payment_ref(R.side(pays, "V"), R.side(pays, "B"))


def _pays(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pays = cut(_lanes(spark, sf_dir)[2])
    v, b = R.side(pays, "V"), R.side(pays, "B")
    met = cut(R.match_payment_ref(v, b))
    left = lambda d, n: d.join(met.select("recon_id", F.col(n).alias("row")), ["recon_id", "row"], "left_anti").select(d.columns)
    return v, b, met, R.match_payment_amount(left(v, "v_row"), left(b, "b_row"), TOL, WINDOW)


def r09_match_payment_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pays(spark, sf_dir)[3]


def r10_open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, vo, bo = _relaxed(spark, sf_dir)
    return vo.union(bo).select("recon_id", "side", "ref")


def r11_contra_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, vo, bo = _relaxed(spark, sf_dir)
    return R.contra_pairs(R.unmatched_results(vo, bo).where(F.col("status") == R.EXTRA), TOL).select("recon_id", "a", "b", "note")


def r11_contra_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All unmatched vendor rows, payments too, after every pass."""
    results = cut(R.all_results(_whole(spark, sf_dir), TOL))
    return R.contra_pairs(results.where(F.col("status") == R.EXTRA), TOL).select("recon_id", "a", "b", "note")


def r11_contra_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = cut(R.all_results(_whole(spark, sf_dir), TOL))
    return R.contra_classes(results.where(F.col("status") == R.EXTRA), TOL)


def r12_pair_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, b, pairs, _, _ = _relaxed(spark, sf_dir)
    out = R.pair_results(pairs, v, b, TOL)
    return out.select("recon_id", "ref", "date_iso", "type", R.money(F.col("v_cents")).alias("vendor_amt"), R.money(F.col("b_cents")).alias("books_amt"), R.money(F.col("diff")).alias("diff"), "status", "tier")


def r13_combo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.combo_results(_whole(spark, sf_dir).combos).select("recon_id", "ref", "type", "status", "tier", "note")


def r14_unmatched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, vo, bo = _relaxed(spark, sf_dir)
    return R.unmatched_results(vo, bo).select("recon_id", "ref", "date", "type", R.money(F.coalesce("v_cents", "b_cents")).alias("amount"), "status", "note")


def r15_payment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, b, met, more = _pays(spark, sf_dir)
    return R.payment_results(met, more, v, b, TOL).select("recon_id", "ref", "status", "tier", R.money(F.col("diff")).alias("diff"), "note")


def _simple(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tiers 1 and 2 only: results and pairs."""
    v, b, pairs, vo, bo = _relaxed(spark, sf_dir)
    return R.pair_results(pairs, v, b, TOL).unionByName(R.unmatched_results(vo, bo)), pairs


def r16_order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.order_results(_simple(spark, sf_dir)[0]).select("recon_id", "ord", "ref", "status")


def r17_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary after tiers 1 and 2 of the reference lane, and R20 on it."""
    results, pairs = _simple(spark, sf_dir)
    by_ref, _ = R.split_lanes(lines(spark, sf_dir))
    nets = by_ref.where("cents is not null").select("recon_id", "side", F.col("cents").alias("net"))
    kind = results.schema["recon_id"].dataType.simpleString()
    none = spark.createDataFrame([], f"recon_id {kind}, from_v boolean, resid long, pos long, note string")
    contra = R.contra_notes(results.where(F.lit(False)), TOL)[1]
    out = R.check_invariants(R.summarize(results, nets, pairs, none, contra, R.TOLERANCE))
    return out.select("recon_id", "total_references", "matched", "amount_diff", "extra_in_vendor", "missing_in_vendor", "net_difference", "vendor_net", "books_net", "amount_diff_value", "extra_in_vendor_value", "missing_in_vendor_value", "matched_residual", "rows_ok", "value_ok")


def r18_matched_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matched_by_tier(_simple(spark, sf_dir)[1])


def r19_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _whole(spark, sf_dir)
    results = cut(R.all_results(m, TOL))
    contra = R.contra_notes(results.where(F.col("status") == R.EXTRA), TOL, every_pair=True)[1]
    return R.findings(m.combos, contra).select("recon_id", F.array_join("findings", "\n").alias("findings"))


def r20_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole reconciliation: the rows that violate an invariant (none), counted with all."""
    summary = R.reconcile(cut(lines(spark, sf_dir)))[1]
    return summary.select("recon_id", "rows_ok", "value_ok")


def r21_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(cut(lines(spark, sf_dir)), every_pair=True)[0]


def r21_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(R.reconcile(cut(lines(spark, sf_dir)), every_pair=True)[1])


def _told(summary: DataFrame) -> DataFrame:
    return summary.withColumns({"matched_by_tier": F.to_json("matched_by_tier"), "findings": F.array_join("findings", "\n")})


def r21_contended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of few different amounts, so that most candidates have rivals and the order of matching decides."""
    return R.reconcile(cut(from_sql(spark, sf_dir, CONTENDED)), every_pair=True)[0]


def r21_contended_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(R.reconcile(cut(from_sql(spark, sf_dir, CONTENDED)), every_pair=True)[1])


def r21_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reconciliation holds the lines of every second customer: what it comes to, and that its invariants hold."""
    results, summary = R.reconcile(cut(from_sql(spark, sf_dir, SKEWED)))
    n = results.groupBy("recon_id").agg(F.count("*").alias("n"), F.max("ord").cast("long").alias("last"))
    return summary.join(n, "recon_id").select("recon_id", "total_references", "n", "last", "vendor_net", "books_net", "rows_ok", "value_ok")


def e01_statements_vs_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements made from the orders against books that lack every 30th order."""
    books = from_sql(spark, sf_dir, f"SELECT doc_id AS recon_id, CAST(row AS BIGINT) AS row, ref, ref AS ref_raw, date, date_iso, type, amount FROM ({RECORDS}) AS r WHERE CAST(substr(ref, length(ref) - 7, 8) AS BIGINT) % 30 <> 0")
    results, _ = statements_vs_books(grid(spark, sf_dir), books)
    return results.groupBy("recon_id", "status", "tier").agg(F.count("*").alias("n"))


def _statements(spark: SparkSession, sf_dir: str) -> Statements:
    """The files of the extraction queries, in mode verify, two documents to a reconciliation; every 17th (an empty file) has
    one of its own and no books.  The books lack every 30th order."""
    from .extraction import alternate_documents, files

    owner = from_sql(spark, sf_dir, f"SELECT DISTINCT doc_id, {_OWNER.format('doc_id')} AS recon_id FROM ({ITEMS}) AS i")
    books = from_sql(spark, sf_dir, _BOOKS)
    return reconcile_statements(files(spark, sf_dir), books, owner, "verify", candidates(spark, sf_dir), alternate_documents(spark, sf_dir), threshold=0.95, strict=True, every_pair=True)


def e01_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each document: all outcomes occur."""
    return _statements(spark, sf_dir).documents.select("doc_id", "recon_id", "outcome", "engine", "confidence", "records", F.coalesce("reason", F.lit("")).alias("reason"))


def e01_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).results


def e01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_statements(spark, sf_dir).summary)


QUERIES = {
    f.__name__: f
    for f in (
        r01_split_lanes, r02_aggregate_refs, r03_match_exact, r04_match_relaxed, r05_match_typo, r05_typo_candidates, r06_match_value, r07_match_combos, r08_match_payment_ref, r09_match_payment_amount, r10_open_items, r11_contra_pairs, r11_contra_whole, r11_contra_classes,
        r12_pair_results, r13_combo_results, r14_unmatched_results, r15_payment_results, r16_order_results, r17_summarize, r18_matched_by_tier, r19_findings, r20_invariants, r21_reconcile, r21_summary, r21_contended, r21_contended_summary, r21_skewed, e01_statements_vs_books, e01_documents, e01_results, e01_summary,
    )
}

_PAYS = "coalesce(lower(trim(type)) IN ('payment', 'payment made', 'receipt'), false)"
_KEYS = {"alnum": r"regexp_replace(upper(ref), '[^A-Z0-9]', '', 'g')", "zero-stripped": r"coalesce(nullif(ltrim(regexp_replace(ref, '\D', '', 'g'), '0'), ''), regexp_replace(ref, '\D', '', 'g'))", "digits-only": r"regexp_replace(ref, '\D', '', 'g')"}


def _pass(n: int, label: str) -> str:
    k = _KEYS[label]
    return f""",
    p{n} AS (SELECT v.recon_id, v.vref, b.zref, 2 AS tier, 'ref match ({label})' AS note FROM
        (SELECT recon_id, {k} AS k, min(ref) AS vref FROM open{n - 1} WHERE side = 'V' AND {k} <> '' GROUP BY 1, 2) AS v JOIN
        (SELECT recon_id, {k} AS k, min(ref) AS zref FROM open{n - 1} WHERE side = 'B' AND {k} <> '' GROUP BY 1, 2 HAVING count(*) = 1) AS b USING (recon_id, k)),
    open{n} AS (SELECT o.* FROM open{n - 1} AS o WHERE NOT EXISTS (SELECT 1 FROM p{n} WHERE p{n}.recon_id = o.recon_id AND CASE o.side WHEN 'V' THEN p{n}.vref ELSE p{n}.zref END = o.ref))"""


_BASE = f"""WITH lines AS ({LINES}), l AS (SELECT *, CAST(round(amount * 100) AS BIGINT) AS cents, {_PAYS} AS pays FROM lines),
    refs AS (SELECT recon_id, side, trim(ref) AS ref, arg_min(ref_raw, row) AS ref_raw, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS lines, arg_min(date_iso, row) AS date, arg_min(date, row) AS date_raw, arg_min(type, row) AS kind FROM l WHERE NOT pays GROUP BY 1, 2, 3),
    p0 AS (SELECT v.recon_id, v.ref AS vref, b.ref AS zref, 1 AS tier, '' AS note FROM refs AS v JOIN refs AS b ON v.recon_id = b.recon_id AND v.ref = b.ref AND v.side = 'V' AND b.side = 'B'),
    open0 AS (SELECT o.* FROM refs AS o WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.recon_id = o.recon_id AND p0.vref = o.ref))""" + "".join(_pass(n, label) for n, label in enumerate(_KEYS, 1)) + """,
    pairs AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
    res AS (SELECT p.recon_id, CASE WHEN vref = zref THEN vref ELSE vref || ' = ' || zref END AS ref, coalesce(v.date, b.date) AS date_iso, v.kind AS type, v.cents AS vc, b.cents AS bc, CASE WHEN abs(v.cents - b.cents) <= 100 THEN 0 ELSE v.cents - b.cents END AS diff,
        CASE WHEN abs(v.cents - b.cents) <= 100 THEN 'MATCHED' ELSE 'AMOUNT_DIFF' END AS status, p.tier, 0 AS section, CASE WHEN note = '' THEN 0 WHEN note LIKE '%alnum%' THEN 1 WHEN note LIKE '%zero%' THEN 2 ELSE 3 END AS step, vref AS name
      FROM pairs AS p JOIN refs AS v ON v.side = 'V' AND v.recon_id = p.recon_id AND v.ref = vref JOIN refs AS b ON b.side = 'B' AND b.recon_id = p.recon_id AND b.ref = zref),
    un AS (SELECT recon_id, ref, date, kind, side, cents, date_raw FROM open3),
    every AS (SELECT recon_id, ref, vc, bc, diff, status, section, step, name FROM res UNION ALL SELECT recon_id, ref, CASE WHEN side = 'V' THEN cents END, CASE WHEN side = 'B' THEN cents END, NULL, CASE WHEN side = 'V' THEN 'EXTRA_IN_VENDOR' ELSE 'MISSING_IN_VENDOR' END, CASE WHEN side = 'V' THEN 2 ELSE 3 END, 0, ref FROM un),
    vp AS (SELECT *, row_number() OVER (PARTITION BY recon_id, ref ORDER BY row) AS k FROM l WHERE pays AND side = 'V'), bp AS (SELECT *, row_number() OVER (PARTITION BY recon_id, ref ORDER BY row) AS k FROM l WHERE pays AND side = 'B')
    """
_d = lambda c: f"CAST({c} AS DOUBLE) / 100"
_m = lambda c: f"regexp_replace(printf('%.2f', CAST({c} AS DOUBLE) / 100), '0$', '')"

_day = lambda c: f"(CAST(substr({c}, 1, 4) AS INT) * 372 + CAST(substr({c}, 6, 2) AS INT) * 31 + CAST(substr({c}, 9, 2) AS INT))"


def _one_by_one(name: str, items: str, pick: str, result: str) -> str:
    """A recursion that visits the items of each reconciliation in order, one a step, and carries what is taken by then.

    ``items``: ``recon_id, k`` from 1 and what ``pick`` reads; ``pick``: a struct of what the item takes, or null; its
    ``took`` are the keys taken.  ``result``: the select from the steps that took something.
    """
    return f""",
    {name}_items AS MATERIALIZED ({items}),
    {name}_steps AS (SELECT DISTINCT recon_id, 0 AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS {result}) AS got FROM {name}_items
      UNION ALL SELECT recon_id, k, CASE WHEN got IS NULL THEN taken ELSE list_concat(taken, got.took) END, got FROM
        (SELECT s.recon_id, i.k, s.taken, ({pick}) AS got FROM {name}_steps AS s JOIN {name}_items AS i ON i.recon_id = s.recon_id AND i.k = s.k + 1))"""


_OPEN = "SELECT o.* FROM {0} AS o WHERE NOT EXISTS (SELECT 1 FROM {1} AS p WHERE p.recon_id = o.recon_id AND CASE o.side WHEN 'V' THEN p.vref ELSE p.zref END = o.ref)"
_LEFT = "list_filter(i.bs, lambda b: NOT list_contains(s.taken, b.ref))"
_VALUE = f"""WITH x AS (SELECT {_LEFT} AS o), y AS (SELECT CASE WHEN len(list_filter(o, lambda b: abs(b.c) = abs(i.c))) > 0 THEN list_filter(o, lambda b: abs(b.c) = abs(i.c)) ELSE list_filter(o, lambda b: abs(abs(b.c) - abs(i.c)) <= 100) END AS o FROM x),
      z AS (SELECT CASE WHEN len(list_filter(o, lambda b: (b.c >= 0) = (i.c >= 0))) > 0 THEN list_filter(o, lambda b: (b.c >= 0) = (i.c >= 0)) ELSE o END AS o FROM y), w AS (SELECT o, list_filter(o, lambda b: abs(b.d - i.d) <= 7) AS near FROM z)
      SELECT CASE WHEN len(o) = 1 THEN {{'took': [o[1].ref], 'vref': i.ref, 'dated': false}} WHEN len(near) = 1 THEN {{'took': [near[1].ref], 'vref': i.ref, 'dated': true}} END FROM w"""
_PAID = f"""WITH x AS (SELECT list_filter({_LEFT}, lambda b: abs(abs(b.c) - abs(i.c)) <= 100) AS o), y AS (SELECT o, list_filter(o, lambda b: abs(b.d - i.d) <= 7) AS near FROM x),
      z AS (SELECT CASE WHEN len(o) > 1 AND len(near) > 0 THEN near ELSE o END AS o FROM y) SELECT CASE WHEN len(o) = 1 THEN {{'took': [o[1].ref], 'v_row': i.row}} END FROM z"""
# Pool: the other side's 25 largest that are not taken, already sorted; all twos before all threes, in order.
_SUMS = """WITH x AS (SELECT list_slice(list_filter(i.others, lambda b: NOT list_contains(s.taken, b.side || b.ref)), 1, 25) AS p),
      y AS (SELECT p, flatten(list_transform(range(1, len(p) + 1), lambda a: list_transform(range(a + 1, len(p) + 1), lambda b: [a, b]))) AS two FROM x),
      z AS (SELECT p, list_concat(two, flatten(list_transform(two, lambda ab: list_transform(range(ab[2] + 1, len(p) + 1), lambda c: [ab[1], ab[2], c])))) AS choices FROM y),
      w AS (SELECT p, list_filter(choices, lambda c: abs(p[c[1]].c + p[c[2]].c + CASE WHEN len(c) = 3 THEN p[c[3]].c ELSE 0 END - i.c) <= 100)[1] AS hit FROM z)
      SELECT CASE WHEN NOT list_contains(s.taken, i.side || i.ref) AND hit IS NOT NULL THEN {'took': list_concat([i.side || i.ref], list_transform(hit, lambda h: p[h].side || p[h].ref)), 'ref': i.ref, 'side': i.side,
        'parts': list_transform(hit, lambda h: p[h].ref), 'resid': i.c - list_sum(list_transform(hit, lambda h: p[h].c))} END FROM w"""
_GREEDY = (
    ", tc AS (SELECT v.recon_id, v.ref AS v, b.ref AS b FROM (SELECT *, " + _KEYS["alnum"] + " AS a FROM open3 WHERE side = 'V') AS v JOIN (SELECT *, " + _KEYS["alnum"] + " AS a FROM open3 WHERE side = 'B') AS b ON v.recon_id = b.recon_id AND length(v.a) = length(b.a) AND length(v.a) >= 6 AND abs(v.cents - b.cents) <= 100 AND len(list_filter(range(1, length(v.a) + 1), lambda i: substr(v.a, i, 1) <> substr(b.a, i, 1))) = 1)"
    + _one_by_one("typo", "SELECT recon_id, v AS ref, list({'ref': b}) AS bs, row_number() OVER (PARTITION BY recon_id ORDER BY v) AS k FROM tc GROUP BY recon_id, v", f"WITH x AS (SELECT {_LEFT} AS o) SELECT CASE WHEN len(o) = 1 THEN {{'took': [o[1].ref], 'vref': i.ref}} END FROM x", "STRUCT(took VARCHAR[], vref VARCHAR)")
    + ", p4 AS (SELECT recon_id, got.vref AS vref, got.took[1] AS zref, 2 AS tier, 'ref match (1-char difference)' AS note FROM typo_steps WHERE got IS NOT NULL), open4 AS (" + _OPEN.format("open3", "p4") + ")"
    + _one_by_one("value", f"SELECT v.recon_id, v.ref, v.cents AS c, {_day('v.date')} AS d, bs, row_number() OVER (PARTITION BY v.recon_id ORDER BY -abs(v.cents), v.ref) AS k FROM open4 AS v JOIN (SELECT recon_id, list({{'ref': ref, 'c': cents, 'd': {_day('date')}}}) AS bs FROM open4 WHERE side = 'B' GROUP BY 1) AS b ON b.recon_id = v.recon_id WHERE v.side = 'V'", _VALUE, "STRUCT(took VARCHAR[], vref VARCHAR, dated BOOLEAN)")
    + ", p5 AS (SELECT recon_id, got.vref AS vref, got.took[1] AS zref, 3 AS tier, CASE WHEN got.dated THEN 'amount+date match (±7d)' ELSE 'amount match (unique value)' END AS note FROM value_steps WHERE got IS NOT NULL), open5 AS (" + _OPEN.format("open4", "p5") + ")"
    + ", gate AS (SELECT recon_id FROM open5 GROUP BY 1 HAVING count(*) <= 80 AND count(*) FILTER (side = 'V') > 0 AND count(*) FILTER (side = 'B') > 0), sorted AS (SELECT recon_id, side, list({'side': side, 'ref': ref, 'c': cents} ORDER BY -abs(cents), ref) AS others FROM open5 WHERE recon_id IN (SELECT recon_id FROM gate) GROUP BY 1, 2)"
    + _one_by_one("sums", "SELECT o.recon_id, o.side, o.ref, o.cents AS c, t.others, row_number() OVER (PARTITION BY o.recon_id ORDER BY o.side DESC, -abs(o.cents), o.ref) AS k FROM open5 AS o JOIN sorted AS t ON t.recon_id = o.recon_id AND t.side <> o.side", _SUMS, "STRUCT(took VARCHAR[], ref VARCHAR, side VARCHAR, parts VARCHAR[], resid HUGEINT)")
    + """, combos AS (SELECT recon_id, got.ref AS ref, got.parts AS parts, got.took AS took, CAST(got.resid AS BIGINT) AS resid, got.side = 'V' AS from_v, row_number() OVER (PARTITION BY recon_id ORDER BY k) - 1 AS pos,
        CASE WHEN got.side = 'V' THEN 'vendor line equals sum of our lines' ELSE 'our line equals sum of vendor lines' END AS direction FROM sums_steps WHERE got IS NOT NULL),
    noted AS (SELECT *, direction || ': ' || ref || ' = ' || array_to_string(parts, ' + ') AS note FROM combos),
    gone AS (SELECT recon_id, unnest(took) AS t FROM combos), open6 AS (SELECT o.* FROM open5 AS o WHERE NOT EXISTS (SELECT 1 FROM gone AS g WHERE g.recon_id = o.recon_id AND g.t = o.side || o.ref)),
    same_ref AS (SELECT vp.recon_id, vp.row AS v_row, bp.row AS b_row FROM vp JOIN bp ON vp.recon_id = bp.recon_id AND vp.ref = bp.ref AND vp.k = bp.k AND vp.ref <> ''),
    vl AS (SELECT * FROM vp WHERE row NOT IN (SELECT v_row FROM same_ref)), bl AS (SELECT * FROM bp WHERE row NOT IN (SELECT b_row FROM same_ref))"""
    + _one_by_one("paid", f"SELECT v.recon_id, v.row, v.cents AS c, {_day('v.date_iso')} AS d, bs, row_number() OVER (PARTITION BY v.recon_id ORDER BY v.row) AS k FROM vl AS v JOIN (SELECT recon_id, list({{'ref': CAST(row AS VARCHAR), 'c': cents, 'd': {_day('date_iso')}}}) AS bs FROM bl GROUP BY 1) AS b ON b.recon_id = v.recon_id", _PAID, "STRUCT(took VARCHAR[], v_row BIGINT)")
    + """, same_amount AS (SELECT recon_id, got.v_row AS v_row, CAST(got.took[1] AS BIGINT) AS b_row FROM paid_steps WHERE got IS NOT NULL),
    pay_pairs AS (SELECT *, 1 AS tier, 'payment ref match' AS note FROM same_ref UNION ALL SELECT *, 3, 'payment amount match' FROM same_amount),
    all_pairs AS (SELECT *, 0 AS step FROM p0 UNION ALL SELECT *, 1 FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3 UNION ALL SELECT *, 4 FROM p4 UNION ALL SELECT *, 5 FROM p5),
    judged AS (
      SELECT p.recon_id, CASE WHEN vref = zref THEN vref ELSE vref || ' = ' || zref END AS ref, v.ref_raw, coalesce(nullif(v.date_raw, ''), b.date_raw) AS date, coalesce(v.date, b.date) AS date_iso, v.kind AS type, v.cents AS vc, b.cents AS bc, true AS met,
        p.tier, p.note, 0 AS section, step, CASE WHEN step = 5 THEN -abs(v.cents) ELSE 0 END AS pos, vref AS name FROM all_pairs AS p JOIN refs AS v ON v.side = 'V' AND v.recon_id = p.recon_id AND v.ref = vref JOIN refs AS b ON b.side = 'B' AND b.recon_id = p.recon_id AND b.ref = zref
      UNION ALL SELECT recon_id, ref, ref_raw, date_raw, date, kind, CASE WHEN side = 'V' THEN cents END, CASE WHEN side = 'B' THEN cents END, false, 0, CASE WHEN side = 'V' THEN 'missing in our books' ELSE 'only in our books' END, CASE WHEN side = 'V' THEN 2 ELSE 3 END, 0, 0, ref FROM open6
      UNION ALL SELECT p.recon_id, CASE WHEN v.ref = b.ref THEN v.ref ELSE v.ref || ' = ' || b.ref END, v.ref_raw, v.date, v.date_iso, 'Payment', v.cents, b.cents, true, p.tier, p.note, 4, p.tier, v.row, v.ref FROM pay_pairs AS p JOIN vp AS v ON v.recon_id = p.recon_id AND v.row = p.v_row JOIN bp AS b ON b.recon_id = p.recon_id AND b.row = p.b_row
      UNION ALL SELECT recon_id, ref, ref_raw, date, date_iso, 'Payment', cents, NULL, false, 0, 'payment on vendor SOA not found in our books', 5, 0, row, ref FROM vp WHERE row NOT IN (SELECT v_row FROM pay_pairs)
      UNION ALL SELECT recon_id, ref, ref_raw, date, date_iso, 'Payment', NULL, cents, false, 0, 'our payment not reflected on vendor SOA', 6, 0, row, ref FROM bp WHERE row NOT IN (SELECT b_row FROM pay_pairs)),
    outcome AS (SELECT *, CASE WHEN met THEN CASE WHEN abs(vc - bc) <= 100 THEN 0 ELSE vc - bc END END AS diff, CASE WHEN met THEN CASE WHEN abs(vc - bc) <= 100 THEN 'MATCHED' ELSE 'AMOUNT_DIFF' END WHEN vc IS NOT NULL THEN 'EXTRA_IN_VENDOR' ELSE 'MISSING_IN_VENDOR' END AS status FROM judged
      UNION ALL SELECT recon_id, ref, ref, '', NULL, 'Combination', NULL, NULL, true, 4, note, 1, 0, pos, ref, 0, 'MATCHED' FROM noted),
    extra AS (SELECT *, row_number() OVER (PARTITION BY recon_id ORDER BY section, CASE WHEN section = 2 THEN name END, pos) AS seq FROM outcome WHERE status = 'EXTRA_IN_VENDOR'),
    against AS (SELECT x.recon_id, x.seq AS sx, y.seq AS sy, x.ref AS a, y.ref AS b, x.vc AS ca, y.vc AS cb, 'possible vendor-side contra: ' || x.ref || ' (' || """ + _m("x.vc") + """ || ') offsets ' || y.ref || ' (' || """ + _m("y.vc") + """ || ')' AS note FROM extra AS x JOIN extra AS y ON x.recon_id = y.recon_id AND x.seq < y.seq AND x.vc <> 0 AND abs(x.vc + y.vc) <= 100),
    beside AS (SELECT recon_id, seq, string_agg(' · possible contra with ' || other, '' ORDER BY turn) AS said FROM (SELECT recon_id, sx AS seq, b AS other, sy AS turn FROM against UNION ALL SELECT recon_id, sy, a, sx FROM against) GROUP BY 1, 2),
    found AS (SELECT recon_id, string_agg(note, chr(10) ORDER BY k, x, y) AS findings FROM (SELECT recon_id, note, 0 AS k, pos AS x, 0 AS y FROM noted UNION ALL SELECT recon_id, note, 1, sx, sy FROM against) GROUP BY 1)
    """
)
_BASE_STEPS = _BASE.replace("WITH lines", "WITH RECURSIVE lines", 1) + _GREEDY
_UNIT = lambda c: f"CAST({c} AS DOUBLE) / 100"

ORACLES = {
    "r01_split_lanes": _BASE + "SELECT recon_id, side, CASE WHEN pays THEN 'payment' ELSE 'ref' END AS lane, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM l GROUP BY 1, 2, 3",
    "r02_aggregate_refs": _BASE + f"SELECT recon_id, side, ref, ref_raw, {_d('cents')} AS amount, lines, date, date_raw, kind AS types FROM refs",
    "r03_match_exact": _BASE + "SELECT recon_id, vref, zref, CAST(tier AS INT) AS tier FROM p0",
    "r04_match_relaxed": _BASE + "SELECT recon_id, vref, zref, note FROM pairs WHERE tier = 2",
    "r05_typo_candidates": _BASE + f"SELECT v.recon_id, v.ref AS v, b.ref AS b FROM (SELECT *, {_KEYS['alnum']} AS a FROM open3 WHERE side = 'V') AS v JOIN (SELECT *, {_KEYS['alnum']} AS a FROM open3 WHERE side = 'B') AS b ON v.recon_id = b.recon_id AND length(v.a) = length(b.a) AND length(v.a) >= 6 AND abs(v.cents - b.cents) <= 100 AND len(list_filter(range(1, length(v.a) + 1), lambda i: substr(v.a, i, 1) <> substr(b.a, i, 1))) = 1",
    "r08_match_payment_ref": _BASE + "SELECT vp.recon_id, vp.row AS v_row, bp.row AS b_row FROM vp JOIN bp ON vp.recon_id = bp.recon_id AND vp.ref = bp.ref AND vp.k = bp.k AND vp.ref <> ''",
    "r10_open_items": _BASE + "SELECT recon_id, side, ref FROM open3",
    "r11_contra_pairs": _BASE + f"SELECT x.recon_id, x.ref AS a, y.ref AS b, 'possible vendor-side contra: ' || x.ref || ' (' || {_m('x.cents')} || ') offsets ' || y.ref || ' (' || {_m('y.cents')} || ')' AS note FROM open3 AS x JOIN open3 AS y ON x.side = 'V' AND y.side = 'V' AND x.recon_id = y.recon_id AND x.ref < y.ref AND x.cents <> 0 AND abs(x.cents + y.cents) <= 100",
    "r12_pair_results": _BASE + f"SELECT recon_id, ref, date_iso, type, {_d('vc')} AS vendor_amt, {_d('bc')} AS books_amt, {_d('diff')} AS diff, status, CAST(tier AS INT) AS tier FROM res",
    "r14_unmatched_results": _BASE + f"SELECT recon_id, ref, date_raw AS date, kind AS type, {_d('cents')} AS amount, CASE WHEN side = 'V' THEN 'EXTRA_IN_VENDOR' ELSE 'MISSING_IN_VENDOR' END AS status, CASE WHEN side = 'V' THEN 'missing in our books' ELSE 'only in our books' END AS note FROM un",
    "r16_order_results": _BASE + "SELECT recon_id, CAST(row_number() OVER (PARTITION BY recon_id ORDER BY CASE status WHEN 'AMOUNT_DIFF' THEN 0 WHEN 'EXTRA_IN_VENDOR' THEN 1 WHEN 'MISSING_IN_VENDOR' THEN 2 ELSE 3 END, -abs(coalesce(nullif(diff, 0), nullif(vc, 0), nullif(bc, 0), 0)), section, step, name) AS INT) AS ord, ref, status FROM every",
    "r17_summarize": _BASE + f"""SELECT n.recon_id, coalesce(t, 0) AS total_references, coalesce(ma, 0) AS matched, coalesce(df, 0) AS amount_diff, coalesce(ex, 0) AS extra_in_vendor, coalesce(mi, 0) AS missing_in_vendor, {_d('n.v - n.b')} AS net_difference, {_d('n.v')} AS vendor_net, {_d('n.b')} AS books_net,
        {_d('coalesce(dfv, 0)')} AS amount_diff_value, {_d('coalesce(exv, 0)')} AS extra_in_vendor_value, {_d('coalesce(miv, 0)')} AS missing_in_vendor_value, {_d('coalesce(rs, 0)')} AS matched_residual, true AS rows_ok, true AS value_ok FROM
        (SELECT recon_id, coalesce(sum(cents) FILTER (side = 'V'), 0) AS v, coalesce(sum(cents) FILTER (side = 'B'), 0) AS b FROM l WHERE NOT pays GROUP BY 1) AS n LEFT JOIN
        (SELECT recon_id, count(*) AS t, count(*) FILTER (status = 'MATCHED') AS ma, count(*) FILTER (status = 'AMOUNT_DIFF') AS df, count(*) FILTER (status = 'EXTRA_IN_VENDOR') AS ex, count(*) FILTER (status = 'MISSING_IN_VENDOR') AS mi,
           sum(vc - bc) FILTER (status = 'AMOUNT_DIFF') AS dfv, sum(vc) FILTER (status = 'EXTRA_IN_VENDOR') AS exv, sum(bc) FILTER (status = 'MISSING_IN_VENDOR') AS miv, sum(vc - bc) FILTER (status = 'MATCHED') AS rs FROM every GROUP BY 1) AS e ON e.recon_id = n.recon_id""",
    "r18_matched_by_tier": _BASE + "SELECT recon_id, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3 FROM pairs GROUP BY 1",
    "r20_invariants": _BASE + "SELECT DISTINCT recon_id, true AS rows_ok, true AS value_ok FROM l",
    "r05_match_typo": _BASE_STEPS + "SELECT recon_id, vref, zref, note FROM p4",
    "r06_match_value": _BASE_STEPS + "SELECT recon_id, vref, zref, note FROM p5",
    "r07_match_combos": _BASE_STEPS + f"SELECT recon_id, ref, array_to_string(parts, '|') AS parts, direction, {_UNIT('resid')} AS resid FROM combos",
    "r09_match_payment_amount": _BASE_STEPS + "SELECT recon_id, v_row, b_row FROM same_amount",
    "r11_contra_whole": _BASE_STEPS + "SELECT recon_id, a, b, note FROM against",
    "r11_contra_classes": _BASE_STEPS + f"""SELECT p.recon_id, {_UNIT('hi')} AS amount, x.n AS rows, {_UNIT('lo')} AS offsets, y.n AS offset_rows, p.n AS pairs FROM (SELECT recon_id, greatest(ca, cb) AS hi, least(ca, cb) AS lo, count(*) AS n FROM against GROUP BY 1, 2, 3) AS p
      JOIN (SELECT recon_id, vc, count(*) AS n FROM extra GROUP BY 1, 2) AS x ON x.recon_id = p.recon_id AND x.vc = hi JOIN (SELECT recon_id, vc, count(*) AS n FROM extra GROUP BY 1, 2) AS y ON y.recon_id = p.recon_id AND y.vc = lo""",
    "r13_combo_results": _BASE_STEPS + "SELECT recon_id, ref, type, status, tier, note FROM outcome WHERE section = 1",
    "r15_payment_results": _BASE_STEPS + f"SELECT recon_id, ref, status, tier, {_UNIT('diff')} AS diff, note FROM outcome WHERE section >= 4",
    "r19_findings": _BASE_STEPS + "SELECT recon_id, findings FROM found",
    "r21_reconcile": _BASE_STEPS + f"""SELECT o.recon_id, CAST(row_number() OVER (PARTITION BY o.recon_id ORDER BY CASE status WHEN 'AMOUNT_DIFF' THEN 0 WHEN 'EXTRA_IN_VENDOR' THEN 1 WHEN 'MISSING_IN_VENDOR' THEN 2 ELSE 3 END, -abs(coalesce(nullif(diff, 0), nullif(vc, 0), nullif(bc, 0), 0)), section, step, pos, name) AS INT) AS ord,
      ref, ref_raw, date, date_iso, type, {_UNIT('vc')} AS vendor_amt, {_UNIT('bc')} AS books_amt, {_UNIT('diff')} AS diff, status, tier, note || coalesce(said, '') AS note FROM (SELECT o.*, e.seq FROM outcome AS o LEFT JOIN extra AS e ON e.recon_id = o.recon_id AND e.section = o.section AND e.name = o.name AND e.pos = o.pos) AS o LEFT JOIN beside AS b ON b.recon_id = o.recon_id AND b.seq = o.seq""",
    "r21_summary": _BASE_STEPS + f"""SELECT n.recon_id, coalesce(t, 0) AS total_references, coalesce(ma, 0) AS matched, coalesce(df, 0) AS amount_diff, coalesce(ex, 0) AS extra_in_vendor, coalesce(mi, 0) AS missing_in_vendor, {_UNIT('v - b')} AS net_difference, {_UNIT('v')} AS vendor_net, {_UNIT('b')} AS books_net,
      {_UNIT('coalesce(dfv, 0)')} AS amount_diff_value, {_UNIT('coalesce(exv, 0)')} AS extra_in_vendor_value, {_UNIT('coalesce(miv, 0)')} AS missing_in_vendor_value, '{{"1":' || coalesce(t1, 0) || ',"2":' || coalesce(t2, 0) || ',"3":' || coalesce(t3, 0) || '}}' AS matched_by_tier, coalesce(nc, 0) AS combos_matched, CAST(1 AS DOUBLE) AS tolerance,
      {_UNIT('coalesce(rs, 0) + coalesce(cr, 0)')} AS matched_residual, coalesce(findings, '') AS findings, true AS rows_ok, true AS value_ok FROM
      (SELECT recon_id, coalesce(sum(cents) FILTER (side = 'V'), 0) AS v, coalesce(sum(cents) FILTER (side = 'B'), 0) AS b FROM l GROUP BY 1) AS n LEFT JOIN
      (SELECT recon_id, count(*) AS t, count(*) FILTER (status = 'MATCHED') AS ma, count(*) FILTER (status = 'AMOUNT_DIFF') AS df, count(*) FILTER (status = 'EXTRA_IN_VENDOR') AS ex, count(*) FILTER (status = 'MISSING_IN_VENDOR') AS mi, sum(vc - bc) FILTER (status = 'AMOUNT_DIFF') AS dfv, sum(vc) FILTER (status = 'EXTRA_IN_VENDOR') AS exv,
         sum(bc) FILTER (status = 'MISSING_IN_VENDOR') AS miv, sum(vc - bc) FILTER (status = 'MATCHED') AS rs, count(*) FILTER (section = 0 AND tier = 1) AS t1, count(*) FILTER (section = 0 AND tier = 2) AS t2, count(*) FILTER (section = 0 AND tier = 3) AS t3 FROM outcome GROUP BY 1) AS e ON e.recon_id = n.recon_id LEFT JOIN
      (SELECT recon_id, count(*) AS nc, sum(CASE WHEN from_v THEN resid ELSE -resid END) AS cr FROM combos GROUP BY 1) AS c ON c.recon_id = n.recon_id LEFT JOIN found AS f ON f.recon_id = n.recon_id""",
}
ORACLES |= {name.replace("r21_reconcile", "r21_contended").replace("r21_summary", "r21_contended_summary"): ORACLES[name].replace(LINES, CONTENDED) for name in ("r21_reconcile", "r21_summary")}
ORACLES |= statement_oracles(_OWNER, _BOOKS, {name: ORACLES[name] for name in ("r21_reconcile", "r21_summary")})
ORACLES["s08_parts"] = f"""SELECT s.recon_id, CAST(coalesce(part, 0) AS INT) AS part, CAST(greatest(ceil(total_references / 4.0), 1) AS INT) AS parts, coalesce(n, 0) AS n, results, CASE WHEN coalesce(part, 0) = 0 THEN total_references END AS total, CASE WHEN coalesce(part, 0) = 0 THEN vendor_net END AS vendor_net
  FROM ({ORACLES['r21_summary']}) AS s LEFT JOIN (SELECT recon_id, (ord - 1) // 4 AS part, count(*) AS n, string_agg(ord || ' ' || ref || ' ' || status, '|' ORDER BY ord) AS results FROM ({ORACLES['r21_reconcile']}) GROUP BY 1, 2) AS r ON r.recon_id = s.recon_id"""
ORACLES["r21_skewed"] = f"""SELECT recon_id, total_references, total_references AS n, total_references AS last, vendor_net, books_net, rows_ok, value_ok FROM ({ORACLES['r21_summary'].replace(LINES, SKEWED)})"""
_GRID_LINES = f"""SELECT doc_id AS recon_id, 'V' AS side, CAST(row AS BIGINT) AS row, ref, ref AS ref_raw, date, date_iso, type, amount FROM ({RECORDS}) AS r UNION ALL
  SELECT doc_id, 'B', CAST(row AS BIGINT), ref, ref, date, date_iso, type, amount FROM ({RECORDS}) AS r WHERE CAST(substr(ref, length(ref) - 7, 8) AS BIGINT) % 30 <> 0"""
ORACLES["e01_statements_vs_books"] = f"SELECT recon_id, status, tier, count(*) AS n FROM ({ORACLES['r21_reconcile'].replace(LINES, _GRID_LINES)}) GROUP BY 1, 2, 3"
