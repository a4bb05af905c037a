"""Reconciliation of vendor lines (V) with our own (B) (R1-R21), many ``recon_id`` at once.

Lines are ``recon_id, side, row, ref, ref_raw, date, date_iso, type, amount``.  Money is whole cents inside and a double
at the edge.  Matching keys on references, keys or amount islands, never on ``recon_id`` alone but for combinations (at
most 80 open items), so one giant reconciliation spreads over the cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.groups import map_groups, spread_row_number
from ..functions.stages import cut
from .greedy import match_combos as combos_of
from .greedy import match_first_unique, match_segment

TOLERANCE, DATE_WINDOW, COMBO_GATE = 1.0, 7, 80
#: Cents; amounts are sorted by stretches of this length, and worked off by segments of that (or what twice the tolerance takes).
STRETCH, SEGMENT = 100_000, 2_000
#: Unless every pair is asked for: partners that a row names, and pairs of a reconciliation that are findings of their own; beyond
#: that amounts stand for rows.
PARTNERS, PAIRS = 100, 10_000
#: Rounds of claims before what is left is worked off by islands.
CLAIMS = 12
# Texts that results carry.
EXTRA, MISSING, MATCHED, DIFFERS = "EXTRA_IN_VENDOR", "MISSING_IN_VENDOR", "MATCHED", "AMOUNT_DIFF"
NOTES = {"extra": "missing in our books", "missing": "only in our books", "pay_extra": "payment on vendor SOA not found in our books", "pay_missing": "our payment not reflected on vendor SOA", "pay_ref": "payment ref match", "pay_amount": "payment amount match"}
RELAXED: tuple[tuple[str, Callable[[Column], Column]], ...] = (("alnum", S.ref_alnum), ("zero-stripped", S.ref_zstrip), ("digits-only", S.ref_digits))
PAIR = "recon_id, vref, zref, tier, note, pass, pos"


def cents_of(amount: Column) -> Column:
    """Null where the amount is no number (NaN, infinite, or beyond what money can be)."""
    return F.round(S.finite(amount) * 100).cast("long")


def money(cents: Column) -> Column:
    return cents / 100.0


def money_text(cents: Column) -> Column:
    """Cents as units with one or two decimals."""
    sign, whole, rest = F.when(cents < 0, "-").otherwise(""), F.floor(F.abs(cents) / 100).cast("long"), F.abs(cents) % 100
    return F.concat(sign, whole.cast("string"), F.lit("."), F.when(rest % 10 == 0, (rest / 10).cast("int").cast("string")).otherwise(F.lpad(rest.cast("string"), 2, "0")))


def split_lanes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines by reference, and payment lines with an amount.  Payment lines without one (or of NaN) are left out."""
    lines = lines.withColumns({"cents": cents_of(F.col("amount")), "pays": S.is_payment(F.col("type"))})
    return lines.where("not pays").drop("pays"), lines.where("pays and cents is not null").drop("pays")


def aggregate_refs(lines: DataFrame) -> DataFrame:
    """R2: a row per ``recon_id, side, ref``.  Partial sums leave the map side; a hot reference is small by then."""
    ref = S.strip(F.col("ref"))
    used = lines.withColumn("ref", ref).where((F.col("ref") != "") & ~F.upper("ref").isin("TOTAL", "TOTALS") & F.col("cents").isNotNull())
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    kind = F.coalesce(given("type"), F.lit("Invoice"))
    head = F.struct("row", F.coalesce(given("ref_raw"), F.col("ref")).alias("ref_raw"), F.coalesce("date", F.lit("")).alias("date_raw"))
    dated = F.when(given("date_iso").isNotNull(), F.struct("row", "date_iso"))
    by_type = used.withColumn("kind", kind).groupBy("recon_id", "side", "ref", "kind").agg(F.sum("cents").alias("cents"), F.count("*").alias("lines"), F.min(head).alias("head"), F.min(dated).alias("dated"), F.min("row").alias("row"))
    return by_type.groupBy("recon_id", "side", "ref").agg(
        F.min("head").getField("ref_raw").alias("ref_raw"), F.sum("cents").alias("cents"), F.sum("lines").alias("lines"),
        F.min("dated").getField("date_iso").alias("date"), F.min("head").getField("date_raw").alias("date_raw"),
        F.transform(F.array_sort(F.collect_list(F.struct("row", "kind"))), lambda x: x["kind"]).alias("types"),
    )


def side(refs: DataFrame, which: str) -> DataFrame:
    return refs.where(F.col("side") == which)


def open_items(items: DataFrame, pairs: DataFrame, column: str, ref: str = "ref") -> DataFrame:
    """R10."""
    return items.join(pairs.select("recon_id", F.col(column).alias(ref)), ["recon_id", ref], "left_anti")


def _pairs(df: DataFrame, tier: int, note: Column, step: int, pos: Column | None = None) -> DataFrame:
    return df.select("recon_id", "vref", "zref", F.lit(tier).alias("tier"), note.alias("note"), F.lit(step).alias("pass"), (pos if pos is not None else F.lit(0)).cast("long").alias("pos"))


def match_exact(v: DataFrame, b: DataFrame) -> DataFrame:
    """R3."""
    both = v.select("recon_id", "ref").join(b.select("recon_id", "ref"), ["recon_id", "ref"])
    return _pairs(both.select("recon_id", F.col("ref").alias("vref"), F.col("ref").alias("zref")), 1, F.lit(""), 0)


def match_relaxed(v: DataFrame, b: DataFrame, label: str, key: Callable[[Column], Column], step: int) -> DataFrame:
    """R4, one pass: keys that one open B reference has, given to the smallest V reference with that key.
    Both sides are grouped before they meet, so a key that many share costs one row."""
    keyed = lambda d: d.select("recon_id", "ref", key(F.col("ref")).alias("k")).where("k <> ''").groupBy("recon_id", "k")
    one = keyed(b).agg(F.min("ref").alias("zref"), F.count("*").alias("n")).where("n = 1").drop("n")
    first = keyed(v).agg(F.min("ref").alias("vref"))
    return _pairs(first.join(one, ["recon_id", "k"]), 2, F.lit(f"ref match ({label})"), step)


def typo_candidates(v: DataFrame, b: DataFrame, tol: int) -> DataFrame:
    """Pairs one substitution apart with signed amounts within ``tol``: equal once one place is blanked."""

    def masked(d: DataFrame, name: str) -> DataFrame:
        a = d.select("recon_id", F.col("ref").alias(name), F.col("cents").alias(f"c_{name}"), S.ref_alnum(F.col("ref")).alias("a")).where("length(a) >= 6")
        a = a.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("a"))))
        return a.select("recon_id", name, f"c_{name}", F.col("a").alias(f"a_{name}"), "p", F.overlay("a", F.lit("\x00"), F.col("p"), F.lit(1)).alias("mask"))

    # Amounts within tol fall into the same or the next bucket, so masks that many share do not multiply.
    wide = max(1, tol + 1)
    left = masked(v, "v").withColumn("bucket", F.explode(F.array(*[F.floor(F.col("c_v") / wide) + k for k in (-1, 0, 1)])))
    right = masked(b, "b").withColumn("bucket", F.floor(F.col("c_b") / wide))
    # Spark sizes a side by what it was before it was exploded to a row per place, and would send it whole through the driver.
    met = left.join(right.hint("merge"), ["recon_id", "p", "mask", "bucket"]).where((F.abs(F.col("c_v") - F.col("c_b")) <= tol) & (F.col("a_v") != F.col("a_b")))
    return met.select("recon_id", "v", "b", "c_v", "c_b").distinct()


def match_typo(v: DataFrame, b: DataFrame, tol: int) -> DataFrame:
    """V in the order of references, paired where exactly one candidate is still open.

    By reservations: every open V claims its candidates, and a V all of whose claims no earlier V contests is settled, for
    what earlier V do is known by then.  Rounds go on with what is left open; chains longer than ``CLAIMS`` rounds are
    worked off by islands of signed amounts, of which two share no item.
    """
    met = cut(typo_candidates(v, b, tol))
    done = []
    for _ in range(CLAIMS):
        if not met.limit(1).count():
            break
        first = met.groupBy("recon_id", "b").agg(F.min("v").alias("first"))
        claims = met.join(first, ["recon_id", "b"]).groupBy("recon_id", "v").agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("v")).alias("own"), F.min("b").alias("b"))
        settled = cut(claims.where("own = n").select("recon_id", "v", "b", F.col("n").alias("of")))
        done.append(settled.where("of = 1").select("recon_id", F.col("v").alias("vref"), F.col("b").alias("zref")))
        met = cut(met.join(settled.select("recon_id", "v"), ["recon_id", "v"], "left_anti").join(settled.where("of = 1").select("recon_id", "b"), ["recon_id", "b"], "left_anti").select(met.columns), instead_of=met)
    else:
        ends = met.select("recon_id", F.lit("V").alias("side"), F.col("v").alias("key"), F.col("c_v").alias("size")).union(met.select("recon_id", F.lit("B"), "b", "c_b")).distinct()
        placed = _islands(ends, tol).where("side = 'V'").select("recon_id", F.col("key").alias("v"), "island")
        done.append(map_groups(met.join(placed, ["recon_id", "v"]).select("recon_id", "island", "v", "b"), ["recon_id", "island"], ["v", "b"], match_first_unique, "vref string, zref string", "recon_id"))
    none = met.where(F.lit(False)).select("recon_id", F.col("v").alias("vref"), F.col("b").alias("zref"))
    return _pairs(reduce(DataFrame.union, done, none), 2, F.lit("ref match (1-char difference)"), 4)


def _islands(items: DataFrame, tol: int) -> DataFrame:
    """``items`` (``recon_id, side, key, size, ...``) with ``island``: no V of one is within ``tol`` of a B of another.

    Rows are sorted by stretches of sizes; only what each stretch holds at its ends is looked at by ``recon_id``, to tell
    whether its first island goes on from the stretch before.  Islands without a V or without a B are left out.
    """
    assert tol < STRETCH
    kind = lambda which, c: F.when(F.col("side") == which, F.col(c))
    dealt = items.withColumn("stretch", F.floor(F.col("size") / STRETCH))
    by = W.partitionBy("recon_id", "stretch")
    sort = by.orderBy("size", "side", "key")
    before = sort.rowsBetween(W.unboundedPreceding, -1)
    after = by.orderBy(*[F.desc(c) for c in ("size", "side", "key")]).rowsBetween(W.unboundedPreceding, 0)
    edges = {f"last_{x}": F.max(kind(x, "size")).over(before) for x in "VB"} | {f"next_{x}": F.min(kind(x, "size")).over(after) for x in "VB"}
    meets = lambda a, b: F.coalesce(F.col(a) - F.col(b) <= tol, F.lit(False))
    new = ~(meets("next_V", "last_B") | meets("next_B", "last_V"))
    local = dealt.withColumns(edges).withColumn("local", F.sum(new.cast("long")).over(sort.rowsBetween(W.unboundedPreceding, 0))).drop(*edges)
    # Stretches, with the ends of each: does the first island go on from the stretch before, and under which name?
    ends = local.groupBy("recon_id", "stretch").agg(F.max("local").alias("last"), F.min("local").alias("first"), *[f(kind(x, "size")).alias(f"{n}_{x}") for x in "VB" for n, f in (("min", F.min), ("max", F.max))])
    row = W.partitionBy("recon_id").orderBy("stretch")
    ends = ends.withColumns({f"was_{c}": F.lag(c).over(row) for c in ("stretch", "first", "last", "max_V", "max_B")})
    joined = (F.col("was_stretch") == F.col("stretch") - 1) & (meets("min_V", "was_max_B") | meets("min_B", "was_max_V"))
    name = lambda stretch, place: F.struct(F.col(stretch).alias("stretch"), F.col(place).alias("place"))
    own = F.when(~F.coalesce(joined, F.lit(False)), name("stretch", "first")).when(F.col("was_last") > F.col("was_first"), name("was_stretch", "was_last"))
    ends = ends.withColumn("head", F.last(own, ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, 0))).select("recon_id", "stretch", "first", "head")
    named = local.join(ends, ["recon_id", "stretch"]).withColumn("island", F.when(F.col("local") == F.col("first"), F.col("head")).otherwise(name("stretch", "local")))
    named = named.select(*[named[c] for c in items.columns], "island")
    counts = named.groupBy("recon_id", "island").agg(*[F.count_if(F.col("side") == x).alias(f"n_{x}") for x in "VB"])
    return named.join(counts.where("n_V > 0 and n_B > 0").select("recon_id", "island"), ["recon_id", "island"])


def _greedy(items: DataFrame, tol: int, window: int, exact_first: bool) -> DataFrame:
    """``recon_id, v, b, dated`` of ``recon_id, side, key, cents, day, ord``: V in the order of ``ord, key``, each visited once.

    Amounts are cut into segments wide enough for a V to reach B of its own and the next segment only; B near a border
    stand in both.  Each segment is worked off as if the others took nothing from it; then the segments that lost a B to
    a neighbour, or got one back, are worked off again, knowing which V takes it elsewhere, until nothing changes.  What a
    V does depends on earlier V alone, so this ends, and in what the one-after-another result is: the first V that still
    differs from it comes later each time.

    Of more than two B of one amount and day two are kept: they can be no V's only candidate as long as both are open,
    and so never cease to be.
    """
    wide = max(2 * tol + 1, SEGMENT)
    sized = items.withColumn("size", F.abs("cents"))
    place = lambda shift: F.floor((F.col("size") + shift) / wide)
    twin = F.row_number().over(W.partitionBy("recon_id", "cents", "day").orderBy("key"))
    b = side(sized, "B").withColumn("twin", twin).where("twin <= 2").drop("twin")
    b = b.withColumns({"low": place(-tol), "high": place(tol)}).withColumn("seg", F.explode(F.array_distinct(F.array("low", "high"))))
    b = b.withColumn("mate", F.when(F.col("low") != F.col("high"), F.col("low") + F.col("high") - F.col("seg"))).drop("low", "high")
    both = side(sized, "V").withColumns({"seg": place(0), "mate": F.lit(None).cast("long")}).unionByName(b).drop("size")
    group = ["recon_id", "seg"]
    sides = both.groupBy(*group).agg(*[F.count_if(F.col("side") == x).alias(f"n_{x}") for x in "VB"]).where("n_V > 0 and n_B > 0")
    work = cut(both.join(sides.select(*group), group))
    key, whose = items.schema["key"].dataType.simpleString(), items.schema["recon_id"].dataType.simpleString()
    none = items.sparkSession.createDataFrame([], f"recon_id {whose}, seg long, key {key}, gone_at long, gone_by {key}")
    made = f"seg long, v {key}, b {key}, dated boolean, ord long, mate long"

    def settle(rows: DataFrame, gone: DataFrame) -> DataFrame:
        known = rows.join(gone.withColumn("side", F.lit("B")), ["recon_id", "seg", "side", "key"], "left")
        return map_groups(known, group, ["ord", "key"], lambda c: match_segment(c, tol, window, exact_first), made, "recon_id")

    known, picks = none, cut(settle(work, none))
    while True:
        gone = picks.where("mate is not null").select("recon_id", F.col("mate").alias("seg"), F.col("b").alias("key"), F.col("ord").alias("gone_at"), F.col("v").alias("gone_by"))
        gone = cut(gone.join(work.where("mate is not null").select("recon_id", "seg", "key"), ["recon_id", "seg", "key"], "left_semi").select(none.columns))
        changed = cut(gone.exceptAll(known).union(known.exceptAll(gone)).select(*group).distinct())
        if not changed.limit(1).count():
            return picks.select("recon_id", "v", "b", "dated")
        again = settle(work.join(changed, group, "left_semi").select(work.columns), gone)
        picks = cut(picks.join(changed, group, "left_anti").select(picks.columns).union(again), instead_of=picks)
        known = gone


def match_value(v: DataFrame, b: DataFrame, tol: int, window: int) -> DataFrame:
    """By value, largest first, ties by reference."""
    both = v.union(b).select("recon_id", "side", F.col("ref").alias("key"), "cents", S.day_ordinal(F.col("date")).alias("day"), (-F.abs("cents")).alias("ord"))
    got = _greedy(both, tol, window, True)
    note = F.when(F.col("dated"), f"amount+date match (±{window}d)").otherwise("amount match (unique value)")
    sized = got.join(v.select("recon_id", F.col("ref").alias("v"), F.abs("cents").alias("size")), ["recon_id", "v"])
    return _pairs(sized.withColumnsRenamed({"v": "vref", "b": "zref"}), 3, note, 5, -F.col("size"))


def match_combos(v: DataFrame, b: DataFrame, tol: int, gate: int = COMBO_GATE) -> DataFrame:
    """``recon_id, ref, parts, from_v, resid (cents), note, pos``.  Only reconciliations of at most ``gate`` open items."""
    both = v.select("recon_id", "side", "ref", "cents").union(b.select("recon_id", "side", "ref", "cents"))
    counts = both.groupBy("recon_id").agg(F.count_if(F.col("side") == "V").alias("n_v"), F.count_if(F.col("side") == "B").alias("n_b"))
    small = both.join(counts.where((F.col("n_v") > 0) & (F.col("n_b") > 0) & (F.col("n_v") + F.col("n_b") <= gate)).select("recon_id"), "recon_id")
    found = map_groups(small, ["recon_id"], ["side", "ref"], lambda c: combos_of(c, tol), "ref string, parts array<string>, from_v boolean, resid long, pos long", "recon_id")
    direction = F.when(F.col("from_v"), "vendor line equals sum of our lines").otherwise("our line equals sum of vendor lines")
    return found.withColumn("direction", direction).withColumn("note", F.concat("direction", F.lit(": "), "ref", F.lit(" = "), F.array_join("parts", " + ")))


def match_payment_ref(v: DataFrame, b: DataFrame) -> DataFrame:
    """``recon_id, v_row, b_row``: the k-th line of a reference with the k-th."""
    nth = lambda d, name: d.where("ref <> ''").select("recon_id", "ref", F.col("row").alias(name), F.row_number().over(W.partitionBy("recon_id", "ref").orderBy("row")).alias("k"))
    return nth(v, "v_row").join(nth(b, "b_row"), ["recon_id", "ref", "k"]).select("recon_id", "v_row", "b_row")


def match_payment_amount(v: DataFrame, b: DataFrame, tol: int, window: int) -> DataFrame:
    """``recon_id, v_row, b_row`` of what R8 left open, in line order."""
    both = v.union(b).select("recon_id", "side", F.col("row").alias("key"), "cents", S.day_ordinal(F.col("date_iso")).alias("day"), F.col("row").alias("ord"))
    return _greedy(both, tol, window, False).select("recon_id", F.col("v").alias("v_row"), F.col("b").alias("b_row"))


RESULT = ("recon_id", "ref", "ref_raw", "date", "date_iso", "type", "v_cents", "b_cents", "diff", "status", "tier", "note", "section", "pass", "pos", "name")


def _result(df: DataFrame, **given: Column) -> DataFrame:
    null = {"v_cents": "long", "b_cents": "long", "diff": "long", "date_iso": "string"}
    return df.select("recon_id", *[(given[c] if c in given else F.lit(None)).cast(null.get(c, {"section": "int", "pass": "int", "pos": "long", "tier": "int"}.get(c, "string"))).alias(c) for c in RESULT[1:]])


def _judge(v: Column, b: Column, tol: int) -> tuple[Column, Column, Column]:
    true = v - b
    ok = F.abs(true) <= tol
    return true, F.when(ok, 0).otherwise(true), F.when(ok, MATCHED).otherwise(DIFFERS)


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def pair_results(pairs: DataFrame, v: DataFrame, b: DataFrame, tol: int) -> DataFrame:
    """R12, with ``true``: the difference in cents that a match within the tolerance hides."""
    as_ = lambda d, p, ref: d.select("recon_id", F.col("ref").alias(ref), *[F.col(c).alias(p + c) for c in ("ref_raw", "cents", "date", "date_raw", "types")])
    j = pairs.join(as_(v, "v_", "vref"), ["recon_id", "vref"]).join(as_(b, "b_", "zref"), ["recon_id", "zref"])
    true, diff, status = _judge(F.col("v_cents"), F.col("b_cents"), tol)
    return _result(
        j, ref=F.when(F.col("vref") == F.col("zref"), F.col("vref")).otherwise(F.concat("vref", F.lit(" = "), "zref")), ref_raw=F.col("v_ref_raw"),
        date=F.coalesce(_given(F.col("v_date_raw")), F.col("b_date_raw")), date_iso=F.coalesce("v_date", "b_date"), type=F.get("v_types", F.lit(0)),
        v_cents=F.col("v_cents"), b_cents=F.col("b_cents"), diff=diff, status=status, tier=F.col("tier"), note=F.col("note"), section=F.lit(0), **{"pass": F.col("pass")}, pos=F.col("pos"), name=F.col("vref"),
    )


def combo_results(combos: DataFrame) -> DataFrame:
    """R13."""
    return _result(combos, ref=F.col("ref"), ref_raw=F.col("ref"), date=F.lit(""), type=F.lit("Combination"), diff=F.lit(0), status=F.lit(MATCHED), tier=F.lit(4), note=F.col("note"), section=F.lit(1), **{"pass": F.lit(0)}, pos=F.col("pos"), name=F.col("ref"))


def unmatched_results(v: DataFrame, b: DataFrame) -> DataFrame:
    """R14."""
    common = dict(ref=F.col("ref"), ref_raw=F.col("ref_raw"), date=F.col("date_raw"), date_iso=F.col("date"), type=F.get("types", F.lit(0)), tier=F.lit(0), pos=F.lit(0), name=F.col("ref"), **{"pass": F.lit(0)})
    extra = _result(v, v_cents=F.col("cents"), status=F.lit(EXTRA), note=F.lit(NOTES["extra"]), section=F.lit(2), **common)
    return extra.unionByName(_result(b, b_cents=F.col("cents"), status=F.lit(MISSING), note=F.lit(NOTES["missing"]), section=F.lit(3), **common))


def payment_results(ref_pairs: DataFrame, amount_pairs: DataFrame, v: DataFrame, b: DataFrame, tol: int) -> DataFrame:
    """R15."""
    pairs = ref_pairs.select("*", F.lit(1).alias("tier"), F.lit(NOTES["pay_ref"]).alias("note")).union(amount_pairs.select("*", F.lit(3).alias("tier"), F.lit(NOTES["pay_amount"]).alias("note")))
    cols = ("ref", "ref_raw", "date", "date_iso", "cents")
    as_ = lambda d, p: d.select("recon_id", F.col("row").alias(f"{p}row"), *[F.col(c).alias(p + c) for c in cols])
    j = pairs.join(as_(v, "v_"), ["recon_id", "v_row"]).join(as_(b, "b_"), ["recon_id", "b_row"])
    _, diff, status = _judge(F.col("v_cents"), F.col("b_cents"), tol)
    raw = lambda p: F.coalesce(_given(F.col(f"{p}ref_raw")), F.col(f"{p}ref"))
    met = _result(
        j, ref=F.when(F.col("v_ref") == F.col("b_ref"), F.col("v_ref")).otherwise(F.concat("v_ref", F.lit(" = "), "b_ref")), ref_raw=raw("v_"),
        date=F.coalesce(_given(F.col("v_date")), F.col("b_date"), F.lit("")), date_iso=F.coalesce(_given(F.col("v_date_iso")), F.col("b_date_iso")), type=F.lit("Payment"),
        v_cents=F.col("v_cents"), b_cents=F.col("b_cents"), diff=diff, status=status, tier=F.col("tier"), note=F.col("note"), section=F.lit(4), **{"pass": F.col("tier")}, pos=F.col("v_row"), name=F.col("v_ref"),
    )
    left = lambda d, name: d.join(pairs.select("recon_id", F.col(name).alias("row")), ["recon_id", "row"], "left_anti")
    common = dict(ref=F.col("ref"), ref_raw=raw(""), date=F.coalesce("date", F.lit("")), date_iso=F.col("date_iso"), type=F.lit("Payment"), tier=F.lit(0), pos=F.col("row"), name=F.col("ref"), **{"pass": F.lit(0)})
    extra = _result(left(v, "v_row"), v_cents=F.col("cents"), status=F.lit(EXTRA), note=F.lit(NOTES["pay_extra"]), section=F.lit(5), **common)
    missing = _result(left(b, "b_row"), b_cents=F.col("cents"), status=F.lit(MISSING), note=F.lit(NOTES["pay_missing"]), section=F.lit(6), **common)
    return met.unionByName(extra).unionByName(missing)


def _open_rows(open_v: DataFrame) -> DataFrame:
    """``recon_id, ref, c, at``: results of status EXTRA_IN_VENDOR with their amount and the place in which they came about."""
    at = F.struct("section", F.when(F.col("section") == 2, F.col("name")).alias("name"), "pos").alias("at")
    return open_v.select("recon_id", "ref", F.col("v_cents").alias("c"), at)


def contra_pairs(open_v: DataFrame, tol: int) -> DataFrame:
    """Pairs of unmatched V rows that cancel, the earlier one not zero.

    ``open_v``: results of status EXTRA_IN_VENDOR.  Rows meet by bucket of their amounts, so only near sums are tried;
    where many rows of one amount cancel, the output itself is that large: see ``contra_classes``.
    """
    wide = max(1, tol + 1)
    rows = _open_rows(open_v)
    a = rows.where("c <> 0").select("recon_id", F.col("ref").alias("a"), F.col("c").alias("ca"), F.col("at").alias("at_a"), F.explode(F.array(*[F.floor(-F.col("c") / wide) + k for k in (-1, 0, 1)])).alias("bucket"))
    b = rows.select("recon_id", F.col("ref").alias("b"), F.col("c").alias("cb"), F.col("at").alias("at_b"), F.floor(F.col("c") / wide).alias("bucket"))
    met = a.join(b, ["recon_id", "bucket"]).where((F.col("at_a") < F.col("at_b")) & (F.abs(F.col("ca") + F.col("cb")) <= tol))
    note = F.concat(F.lit("possible vendor-side contra: "), "a", F.lit(" ("), money_text(F.col("ca")), F.lit(") offsets "), "b", F.lit(" ("), money_text(F.col("cb")), F.lit(")"))
    return met.select("recon_id", "a", "b", "at_a", "at_b", note.alias("note"))


def _class_links(rows: DataFrame, tol: int) -> DataFrame:
    """``recon_id, c, n, other, m``: amounts with their number of rows, and amounts that cancel them with theirs; both ways."""
    wide = max(1, tol + 1)
    classes = rows.groupBy("recon_id", "c").agg(F.count("*").alias("n"))
    reach = classes.withColumn("bucket", F.explode(F.array(*[F.floor(-F.col("c") / wide) + k for k in (-1, 0, 1)])))
    other = classes.select("recon_id", F.col("c").alias("other"), F.col("n").alias("m"), F.floor(F.col("c") / wide).alias("bucket"))
    return reach.join(other, ["recon_id", "bucket"]).where(F.abs(F.col("c") + F.col("other")) <= tol).drop("bucket")


def _beside_zero(rows: DataFrame, tol: int) -> DataFrame:
    """``recon_id, at, c, zeros_after, others_before``: rows within ``tol`` of zero.  Only of two such rows does the order matter."""
    order = W.partitionBy("recon_id").orderBy("at")
    zero = F.col("c") == 0
    later, earlier = order.rowsBetween(1, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    counted = {"zeros_after": F.count_if(zero).over(later), "others_before": F.count_if(~zero).over(earlier)}
    return rows.where(F.abs("c") <= tol).withColumns(counted).select("recon_id", "at", "c", "zeros_after", "others_before")


def contra_classes(open_v: DataFrame, tol: int) -> DataFrame:
    """R11 by amounts: ``recon_id, amount, rows, offsets, offset_rows, pairs``, each two amounts that cancel once, the larger first.

    The number of pairs is exact, and what is written grows with the rows: n rows of +a and m of -a make one row here.
    """
    rows = _open_rows(open_v)
    links = _class_links(rows, tol).where("c >= other")
    beside = _beside_zero(rows, tol).where("c <> 0").groupBy("recon_id", "c").agg(F.sum("zeros_after").alias("with_zero"))
    # A zero row has the other amount, whichever of the two is the larger.
    apart = F.when(F.col("c") == 0, F.col("other")).otherwise(F.col("c"))
    links = links.withColumn("apart", F.when((F.col("c") == 0) | (F.col("other") == 0), apart))
    links = links.join(beside.withColumnRenamed("c", "apart"), ["recon_id", "apart"], "left")
    pairs = F.when(F.col("apart").isNotNull(), F.coalesce("with_zero", F.lit(0))).when(F.col("c") == F.col("other"), F.floor(F.col("n") * (F.col("n") - 1) / 2)).otherwise(F.col("n") * F.col("m"))
    return links.select("recon_id", money(F.col("c")).alias("amount"), F.col("n").alias("rows"), money(F.col("other")).alias("offsets"), F.col("m").alias("offset_rows"), pairs.cast("long").alias("pairs")).where("pairs > 0")


def _partners_told(partners: Column) -> Column:
    return F.array_join(F.transform(partners, lambda p: F.concat(F.lit(" · possible contra with "), p["with"])), "")


def _said_at(said: DataFrame) -> DataFrame:
    return said.select("recon_id", F.col("at.section").alias("section"), F.coalesce("at.name", F.lit("")).alias("by_name"), F.col("at.pos").alias("pos"), "said")


def _each_pair_told(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``contra_notes`` of ``contra_pairs``: every row's partners in their order, and a finding per pair."""
    x = lambda by, ref: F.struct(F.col(by).alias("by"), F.col(ref).alias("with")).alias("x")
    ends = pairs.select("recon_id", F.col("at_a").alias("at"), x("at_b", "b")).union(pairs.select("recon_id", F.col("at_b").alias("at"), x("at_a", "a")))
    said = ends.groupBy("recon_id", "at").agg(_partners_told(F.array_sort(F.collect_list("x"))).alias("said"))
    return _said_at(said), pairs.select("recon_id", F.lit(1).alias("k"), F.lit(0).cast("long").alias("pos"), F.col("at_a").alias("x"), F.col("at_b").alias("y"), "note")


def contra_notes(open_v: DataFrame, tol: int, shown: int | None = None, most: int | None = None, every_pair: bool = False) -> tuple[DataFrame, DataFrame]:
    """R11 as texts: ``recon_id, section, by_name, pos, said`` per row with partners, and findings ``recon_id, k, pos, x, y, note``.

    With ``every_pair`` each pair is a finding, and each row names all of its partners, in their order, however many there are;
    what is written then grows with the pairs.  So it does without, in a reconciliation of at most ``most`` pairs.
    Beyond that its findings are one per two amounts that cancel, by size, and a row names its first ``shown`` partners that
    are not zero and the number of the rest; ``contra_classes`` then has all of them.  No row is ever held against all others.
    """
    if every_pair:
        return _each_pair_told(cut(contra_pairs(open_v, tol)))
    shown, most = PARTNERS if shown is None else shown, PAIRS if most is None else most
    classes = cut(contra_classes(open_v, tol))
    many = classes.groupBy("recon_id").agg(F.sum("pairs").alias("pairs")).where(F.col("pairs") > most).select("recon_id")
    many = cut(many)
    pairs = cut(contra_pairs(open_v.join(many, "recon_id", "left_anti"), tol))
    said, found = _each_pair_told(pairs)
    if not many.limit(1).count():
        return said, found

    # The first rows of each amount, then of all amounts that cancel it; then rows are joined to their amount's.
    crowd = _open_rows(open_v.join(many, "recon_id", "left_semi"))
    links = _class_links(crowd, tol)
    rank = F.row_number().over(W.partitionBy("recon_id", "c").orderBy("at"))
    heads = crowd.where("c <> 0").withColumn("k", rank).where(F.col("k") <= shown + 1)
    heads = heads.groupBy("recon_id", F.col("c").alias("other")).agg(F.collect_list(F.struct(F.col("at").alias("by"), F.col("ref").alias("with"))).alias("heads"))
    partners = links.join(heads, ["recon_id", "other"]).groupBy("recon_id", "c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("heads"))), 1, shown + 1).alias("heads"), F.sum("m").alias("m"))
    own = crowd.join(partners, ["recon_id", "c"]).join(_beside_zero(crowd, tol).drop("c"), ["recon_id", "at"], "left")
    lone = crowd.where("c <> 0").join(_beside_zero(crowd, tol).where("c <> 0 and zeros_after > 0").drop("c"), ["recon_id", "at"]).join(partners.select("recon_id", "c"), ["recon_id", "c"], "left_anti")
    own = own.unionByName(lone.select(crowd.columns + ["zeros_after", "others_before"]), allowMissingColumns=True)
    zero = F.col("c") == 0
    fits = F.filter(F.coalesce("heads", F.array().cast(partners.schema["heads"].dataType)), lambda p: (p["by"] != F.col("at")) & (~zero | (p["by"] < F.col("at"))))
    first = F.slice(fits, 1, shown)
    n = F.when(zero, F.col("others_before")).otherwise(F.coalesce("m", F.lit(0)) - (F.abs(2 * F.col("c")) <= tol).cast("long") + F.coalesce("zeros_after", F.lit(0)))
    more = F.when(F.col("n") > F.size("first"), F.concat(F.lit(" · and "), (F.col("n") - F.size("first")).cast("string"), F.lit(" more"))).otherwise("")
    crowded = own.withColumns({"first": first, "n": n}).where("n > 0").select("recon_id", "at", F.concat(_partners_told(F.col("first")), more).alias("said"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    note = F.concat(F.lit("possible vendor-side contra: "), F.col("rows").cast("string"), F.lit(" rows of "), money_text(cents("amount")), F.lit(" offset "), F.col("offset_rows").cast("string"), F.lit(" rows of "), money_text(cents("offsets")))
    by_size = F.row_number().over(W.partitionBy("recon_id").orderBy(F.desc("amount"), F.desc("offsets")))
    heaps = classes.join(many, "recon_id", "left_semi").withColumn("place", by_size).where(F.col("place") <= most)
    nowhere = F.lit(None).cast(pairs.schema["at_a"].dataType)
    return said.union(_said_at(crowded)), found.union(heaps.select("recon_id", F.lit(2), F.col("place").cast("long"), nowhere, nowhere, note))


def add_contra_notes(results: DataFrame, notes: DataFrame) -> DataFrame:
    """The partners of each row appended to its note."""
    keyed = results.withColumn("by_name", F.when(F.col("section") == 2, F.col("name")).otherwise(""))
    return keyed.join(notes, ["recon_id", "section", "by_name", "pos"], "left").withColumn("note", F.concat("note", F.coalesce("said", F.lit("")))).select(*RESULT)


def order_results(results: DataFrame) -> DataFrame:
    """``ord`` from 1: status, then size, then the order in which the rows came about."""
    rank = F.when(F.col("status") == DIFFERS, 0).when(F.col("status") == EXTRA, 1).when(F.col("status") == MISSING, 2).otherwise(3)
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    size = F.abs(F.coalesce(some("diff"), some("v_cents"), some("b_cents"), F.lit(0)))
    return spread_row_number(results, ["recon_id"], [rank, F.floor(-size / STRETCH)], [-size, "section", "pass", "pos", "name"], "ord")


def matched_by_tier(pairs: DataFrame) -> DataFrame:
    """``recon_id, tier_1, tier_2, tier_3`` of the reference lane."""
    return pairs.groupBy("recon_id").agg(*[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)])


def findings(combos: DataFrame, contra: DataFrame) -> DataFrame:
    """Combination notes in the order they were found, then contra notes (of ``contra_notes``) in the order of their rows.

    A reconciliation has at most 26 combinations; of contra notes ``PAIRS``, or where every pair is asked for as many as there are pairs.
    """
    nowhere = F.lit(None).cast(contra.schema["x"].dataType)
    a = combos.select("recon_id", F.struct(F.lit(0).alias("k"), F.col("pos"), nowhere.alias("x"), nowhere.alias("y"), "note").alias("f"))
    b = contra.select("recon_id", F.struct("k", "pos", "x", "y", "note").alias("f"))
    return a.union(b).groupBy("recon_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["note"]).alias("findings"))


def summarize(results: DataFrame, lines: DataFrame, pairs: DataFrame, combos: DataFrame, contra: DataFrame, tolerance: float) -> DataFrame:
    """A row per ``recon_id`` of ``lines``.  ``results`` are R12-R15; money as doubles."""
    tol = round(tolerance * 100)
    nets = lines.groupBy("recon_id").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("net"))), F.lit(0)).alias(n) for s, n in (("V", "v_net"), ("B", "b_net"))])
    is_ = lambda s: F.col("status") == s
    total = lambda s, c: F.coalesce(F.sum(F.when(is_(s), c)), F.lit(0))
    true = F.when(F.abs(F.col("v_cents") - F.col("b_cents")) <= tol, F.col("v_cents") - F.col("b_cents"))
    counted = results.groupBy("recon_id").agg(
        F.count("*").alias("total_references"), F.count_if(is_(MATCHED)).alias("matched"), F.count_if(is_(DIFFERS)).alias("amount_diff"), F.count_if(is_(EXTRA)).alias("extra_in_vendor"), F.count_if(is_(MISSING)).alias("missing_in_vendor"),
        total(DIFFERS, F.col("v_cents") - F.col("b_cents")).alias("diff_c"), total(EXTRA, F.col("v_cents")).alias("extra_c"), total(MISSING, F.col("b_cents")).alias("missing_c"), total(MATCHED, true).alias("resid_c"),
    )
    combo = combos.groupBy("recon_id").agg(F.count("*").alias("combos_matched"), F.sum(F.when(F.col("from_v"), F.col("resid")).otherwise(-F.col("resid"))).alias("combo_c"))
    s = nets.join(counted, "recon_id", "left").join(combo, "recon_id", "left").join(matched_by_tier(pairs), "recon_id", "left").join(findings(combos, contra), "recon_id", "left")
    zero = [c for c in s.columns if c not in ("recon_id", "findings")]
    s = s.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in zero}).withColumn("resid_c", F.col("resid_c") + F.col("combo_c"))
    tiers = F.create_map(*[x for t in (1, 2, 3) for x in (F.lit(str(t)), F.col(f"tier_{t}"))])
    return s.select(
        "recon_id", "total_references", "matched", "amount_diff", "extra_in_vendor", "missing_in_vendor",
        money(F.col("v_net") - F.col("b_net")).alias("net_difference"), money(F.col("v_net")).alias("vendor_net"), money(F.col("b_net")).alias("books_net"), money(F.col("diff_c")).alias("amount_diff_value"),
        money(F.col("extra_c")).alias("extra_in_vendor_value"), money(F.col("missing_c")).alias("missing_in_vendor_value"), tiers.alias("matched_by_tier"), "combos_matched", F.lit(float(tolerance)).alias("tolerance"),
        money(F.col("resid_c")).alias("matched_residual"), F.coalesce("findings", F.array().cast("array<string>")).alias("findings"),
    )


def check_invariants(summary: DataFrame, strict: bool = False) -> DataFrame:
    """``summary`` with ``rows_ok, value_ok``; ``strict`` fails the job at the first row that violates one."""
    rows = F.col("matched") + F.col("amount_diff") + F.col("extra_in_vendor") + F.col("missing_in_vendor") == F.col("total_references")
    gap = F.col("amount_diff_value") + F.col("matched_residual") + F.col("extra_in_vendor_value") - F.col("missing_in_vendor_value") - F.col("net_difference")
    value = F.abs(F.round(gap, 2)) <= 0.02
    out = summary.withColumns({"rows_ok": rows, "value_ok": value})
    if strict:
        out = out.withColumn("rows_ok", F.when(F.col("rows_ok") & F.col("value_ok"), True).otherwise(F.raise_error(F.concat(F.lit("reconciliation invariant violated: "), F.col("recon_id").cast("string")))))
    return out


class Watch:
    """R20 on the way: what ``summary`` comes to is counted while it is written, without a pass of its own.

    ``watched`` is the summary to write; once that has run, ``offenders`` tells how many reconciliations there were, how many
    violate each invariant, and up to ``named`` of those that do.
    """

    def __init__(self, summary: DataFrame, named: int = 1000):
        bad = ~(F.col("rows_ok") & F.col("value_ok"))
        # One accumulator per task and metric; the names are bounded by their number, the counts are not.
        sample = F.slice(F.array_sort(F.collect_set(F.when(bad, F.col("recon_id").cast("string")))), 1, named)
        self._seen = Observation(f"invariants-{uuid.uuid4().hex}")
        self.watched = summary.observe(self._seen, F.count("*").alias("all"), F.count_if(~F.col("rows_ok")).alias("rows"), F.count_if(~F.col("value_ok")).alias("value"), sample.alias("names"))

    @property
    def offenders(self) -> dict:
        return dict(self._seen.get)

    def check(self) -> None:
        """Fails with the names of the offenders, if there are any."""
        got = self.offenders
        if got["rows"] or got["value"]:
            raise ValueError(f"reconciliation invariants violated: {got['rows']} by rows, {got['value']} by value, of {got['all']}: {', '.join(got['names'])}")


@dataclass(frozen=True)
class Matching:
    """What was matched, pass by pass, and what is left open."""

    v: DataFrame  # references of each side (R2)
    b: DataFrame
    pairs: DataFrame  # of all passes
    typo: DataFrame
    value: DataFrame
    combos: DataFrame
    v_open: DataFrame  # after combinations
    b_open: DataFrame
    v_pay: DataFrame  # payment lines
    b_pay: DataFrame
    by_line: DataFrame
    by_amount: DataFrame


def match_payments(pays: DataFrame, tol: int, date_window: int = DATE_WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The payment lane: V lines, B lines, and the pairs of R8 and of R9."""
    pays = cut(pays)
    v, b = side(pays, "V"), side(pays, "B")
    by_line = cut(match_payment_ref(v, b))
    left = lambda d, name: d.join(by_line.select("recon_id", F.col(name).alias("row")), ["recon_id", "row"], "left_anti").select(d.columns)
    return v, b, by_line, cut(match_payment_amount(left(v, "v_row"), left(b, "b_row"), tol, date_window))


def match_lines(lines: DataFrame, tol: int, date_window: int = DATE_WINDOW, enable_combos: bool = True) -> Matching:
    """Both lanes through all of their passes, side by side, for neither needs the other.

    Stages that later passes read twice are written to the shared folder.
    """
    by_ref, pays = split_lanes(lines)
    with ThreadPoolExecutor(1) as beside:
        paid = beside.submit(match_payments, pays, tol, date_window)
        refs = cut(aggregate_refs(by_ref))
        v, b = side(refs, "V"), side(refs, "B")
        done = [match_exact(v, b)]
        v_open, b_open = open_items(v, done[0], "vref"), open_items(b, done[0], "zref")
        work = cut(v_open.union(b_open))
        after = lambda found: cut(open_items(side(work, "V"), found, "vref").union(open_items(side(work, "B"), found, "zref")), instead_of=work)
        for step, (label, key) in enumerate(RELAXED, 1):
            done.append(cut(match_relaxed(side(work, "V"), side(work, "B"), label, key, step)))
            work = after(done[-1])
        for match in (lambda x, y: match_typo(x, y, tol), lambda x, y: match_value(x, y, tol, date_window)):
            done.append(cut(match(side(work, "V"), side(work, "B"))))
            work = after(done[-1])
        v_open, b_open = side(work, "V"), side(work, "B")
        combos = match_combos(v_open, b_open, tol)
        combos = cut(combos if enable_combos else combos.where(F.lit(False)))
        used = combos.select("recon_id", F.when(F.col("from_v"), F.array("ref")).otherwise(F.col("parts")).alias("v"), F.when(F.col("from_v"), F.col("parts")).otherwise(F.array("ref")).alias("b"))
        v_open = open_items(v_open, used.select("recon_id", F.explode("v").alias("x")), "x")
        b_open = open_items(b_open, used.select("recon_id", F.explode("b").alias("x")), "x")
        return Matching(v, b, reduce(DataFrame.unionByName, done), done[4], done[5], combos, v_open, b_open, *paid.result())


def all_results(m: Matching, tol: int) -> DataFrame:
    """R12 to R15 together."""
    return pair_results(m.pairs, m.v, m.b, tol).unionByName(combo_results(m.combos)).unionByName(unmatched_results(m.v_open, m.b_open)).unionByName(payment_results(m.by_line, m.by_amount, m.v_pay, m.b_pay, tol))


def reconcile(lines: DataFrame, tolerance: float = TOLERANCE, date_window: int = DATE_WINDOW, enable_combos: bool = True, strict: bool = False, every_pair: bool = False) -> tuple[DataFrame, DataFrame]:
    """Results (with ``ord``) and the summary of every ``recon_id``.  Ties that leave the order open are broken by reference.
    ``every_pair``: as in ``contra_notes``."""
    tol = round(tolerance * 100)
    m = match_lines(lines, tol, date_window, enable_combos)
    results = cut(all_results(m, tol))
    notes, contra = contra_notes(results.where(F.col("status") == EXTRA), tol, every_pair=every_pair)
    net = lambda d: d.select("recon_id", "side", F.col("cents").alias("net"))
    everyone = lines.select("recon_id", "side", F.lit(0).cast("long").alias("net")).distinct()
    nets = reduce(DataFrame.union, [net(d) for d in (m.v, m.b, m.v_pay, m.b_pay)], everyone)
    summary = check_invariants(summarize(results, nets, m.pairs, m.combos, contra, tolerance), strict)
    ordered = order_results(add_contra_notes(results, notes))
    return ordered.select("recon_id", "ord", "ref", "ref_raw", "date", "date_iso", "type", money(F.col("v_cents")).alias("vendor_amt"), money(F.col("b_cents")).alias("books_amt"), money(F.col("diff")).alias("diff"), "status", "tier", "note"), summary
