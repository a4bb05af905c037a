"""Brute force: one reconciliation at a time, in plain loops, against the Spark jobs on many at once."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from ledgerloom.operators import recon as R

SCHEMA = "recon_id long, side string, row long, ref string, ref_raw string, date string, date_iso string, type string, amount double"


def day(iso):
    y, m, d = map(int, iso.split("-"))
    return y * 372 + m * 31 + d


def plain(rows, tol=100, window=7, combos=True):
    """Pairs, combinations and payment pairs of one reconciliation, in cents."""
    pays = [r for r in rows if r["type"] == "Payment"]
    agg = {"V": {}, "B": {}}
    for r in sorted((r for r in rows if r["type"] != "Payment"), key=lambda r: r["row"]):
        e = agg[r["side"]].setdefault(r["ref"], [0, None])
        e[0] += r["cents"]
        e[1] = e[1] or r["date_iso"]
    v, b = agg["V"], agg["B"]
    vo, bo, pairs = set(v), set(b), []

    def pair(x, y, tier):
        pairs.append((x, y, tier))
        vo.discard(x)
        bo.discard(y)

    for x in sorted(vo & bo):
        pair(x, x, 1)
    alnum = lambda x: re.sub("[^A-Z0-9]", "", x.upper())
    digits = lambda x: re.sub(r"\D", "", x)
    for key in (alnum, lambda x: digits(x).lstrip("0") or digits(x), digits):
        start = set(bo)
        for x in sorted(vo):
            c = [y for y in start if y in bo and key(y) == key(x)] if key(x) else []
            if len(c) == 1:
                pair(x, c[0], 2)
    for x in sorted(vo):
        a = alnum(x)
        c = [y for y in bo if len(alnum(y)) == len(a) >= 6 and sum(p != q for p, q in zip(a, alnum(y), strict=True)) == 1 and abs(v[x][0] - b[y][0]) <= tol]
        if len(c) == 1:
            pair(x, c[0], 2)
    for x in sorted(vo, key=lambda r: (-abs(v[r][0]), r)):
        c = [y for y in bo if abs(b[y][0]) == abs(v[x][0])] or [y for y in bo if abs(abs(b[y][0]) - abs(v[x][0])) <= tol]
        c = [y for y in c if (b[y][0] >= 0) == (v[x][0] >= 0)] or c
        if len(c) > 1:
            c = [y for y in c if abs(day(b[y][1]) - day(v[x][1])) <= window]
        if len(c) == 1:
            pair(x, c[0], 3)
    found = []
    if combos and vo and bo and len(vo) + len(bo) <= 80:
        for singles, sm, many, mm in ((vo, v, bo, b), (bo, b, vo, v)):
            for s in sorted(singles, key=lambda r: (-abs(sm[r][0]), r)):
                pool = sorted(many, key=lambda r: (-abs(mm[r][0]), r))[:25]
                hit = next((c for n in (2, 3) for c in itertools.combinations(pool, n) if abs(sum(mm[p][0] for p in c) - sm[s][0]) <= tol), None)
                if hit:
                    found.append((s, "|".join(hit)))
                    singles.discard(s)
                    many.difference_update(hit)
    vp, bp = ([r for r in sorted(pays, key=lambda r: r["row"]) if r["side"] == s] for s in "VB")
    used, got = set(), []
    for x in vp:
        y = next((y for y in bp if y["row"] not in used and x["ref"] and x["ref"] == y["ref"]), None)
        if y:
            used.add(y["row"])
            got.append((x["row"], y["row"]))
    for x in vp:
        if x["row"] in {g[0] for g in got}:
            continue
        c = [y for y in bp if y["row"] not in used and abs(abs(y["cents"]) - abs(x["cents"])) <= tol]
        if len(c) > 1:
            c = [y for y in c if abs(day(y["date_iso"]) - day(x["date_iso"])) <= window] or c
        if len(c) == 1:
            used.add(c[0]["row"])
            got.append((x["row"], c[0]["row"]))
    return sorted(pairs), sorted(found), sorted(got)


def random_lines(seed, recons=40):
    rng = random.Random(seed)
    rows = []
    for rid in range(recons):
        n = 0
        for side in "VB":
            for _ in range(rng.randint(0, 14)):
                n += 1
                pays = rng.random() < 0.25
                ref = rng.choice(["INV-", "inv", "B/", "DOC", "XQ", ""]) + rng.choice(["00", "0", ""]) + str(rng.randint(1, 9)) * rng.randint(1, 4) + rng.choice(["", "A", "ABCD"])
                rows.append((rid, side, n, ref, ref, "d", f"2026-0{rng.randint(1, 3)}-{rng.randint(1, 28):02}", "Payment" if pays else "Invoice", rng.choice([-1.0, 1.0]) * (rng.randint(1, 6) * 100 + rng.choice([0, 0, 0.5, 1.0]))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = random_lines(seed)
    lines = spark.createDataFrame(rows, SCHEMA)
    results, summary = R.reconcile(lines, strict=True)
    got = results.collect()
    assert all(r.rows_ok and r.value_ok for r in summary.collect())
    wrong = []
    for rid in range(40):
        own = [dict(zip(("recon_id", "side", "row", "ref", "ref_raw", "date", "date_iso", "type", "amount"), r, strict=True)) for r in rows if r[0] == rid]
        for r in own:
            r["cents"] = round(r["amount"] * 100)
        own = [r for r in own if r["ref"] or r["type"] == "Payment"]
        pairs, found, pays = plain(own)
        mine = [r for r in got if r.recon_id == rid]
        want = sorted([(x if x == y else f"{x} = {y}", t) for x, y, t in pairs] + [(s, 4) for s, _ in found])
        have = sorted((r.ref, r.tier) for r in mine if r.type != "Payment" and r.tier > 0)
        paid = sum(r.type == "Payment" and r.tier > 0 for r in mine)
        if want != have or paid != len(pays):
            wrong.append((rid, want, have, paid, pays))
    assert not wrong, wrong[:2]


@pytest.mark.parametrize("seed, segment", [(11, 2000), (12, 1)])
def test_every_column_against_sql(spark, seed, segment, monkeypatch):
    """Results, their order and notes, and summaries with findings, by a recursion in SQL that visits one item a step."""
    import duckdb

    from ledgerloom.queries import reconciliation as Q
    from ledgerloom.queries.derived import LINES

    monkeypatch.setattr(R, "SEGMENT", segment)  # 1: as narrow as the tolerance allows, so that most B stand in two
    rows = [r for r in random_lines(seed, 60) if r[3]]
    rows = [(*r[:2], r[0] * 1000 + r[2], *r[3:8], r[8] + (k % 7) * 0.37) for k, r in enumerate(rows)]  # the SQL knows payments by their row alone
    con = duckdb.connect()
    con.execute("CREATE TABLE given (recon_id BIGINT, side VARCHAR, row BIGINT, ref VARCHAR, ref_raw VARCHAR, date VARCHAR, date_iso VARCHAR, type VARCHAR, amount DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    results, summary = R.reconcile(spark.createDataFrame(rows, SCHEMA).repartition(3))
    for name, got in (("r21_reconcile", results), ("r21_summary", Q._told(summary))):
        found = con.execute(Q.ORACLES[name].replace(LINES, "SELECT * FROM given"))
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(got.columns)
        tidy = lambda r: repr([round(x, 4) + 0.0 if isinstance(x, float) else x for x in r])
        assert sorted(tidy(r) for r in got.select(columns).collect()) == sorted(tidy(r) for r in found.fetchall())


def test_partitions_and_order_do_not_matter(spark):
    rows = random_lines(7, 12)
    a = R.reconcile(spark.createDataFrame(rows, SCHEMA))[0].collect()
    random.Random(3).shuffle(rows)
    b = R.reconcile(spark.createDataFrame(rows, SCHEMA).repartition(3))[0].collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_hand_worked(spark):
    line = lambda side, row, ref, amount, kind="Invoice": (1, side, row, ref, ref, "", "2026-01-01", kind, amount)
    out = lambda *rows: {(r.ref, r.status, r.tier, r.diff) for r in R.reconcile(spark.createDataFrame(list(rows), SCHEMA))[0].collect()}
    assert out(line("V", 1, "A", 100.5), line("B", 1, "A", 100.0)) == {("A", "MATCHED", 1, 0.0)}
    assert out(line("V", 1, "V1", 300.0), line("B", 1, "x", 100.0), line("B", 2, "y", 200.0)) == {("V1", "MATCHED", 4, 0.0)}
    assert out(line("V", 1, "p", -50.0, "Payment"), line("B", 1, "q", 50.0, "Payment")) == {("p = q", "AMOUNT_DIFF", 3, -100.0)}
    assert out(line("V", 1, "a", 100.8), line("V", 2, "b", 100.0), line("B", 1, "x", 100.9), line("B", 2, "y", 99.5)) == {("a = x", "MATCHED", 3, 0.0), ("b = y", "MATCHED", 3, 0.0)}
    assert out(line("V", 1, "A-7", 1.0), line("V", 2, "B-7", 50.0), line("B", 1, "C-07", 900.0)) == {("A-7 = C-07", "AMOUNT_DIFF", 2, -899.0), ("B-7", "EXTRA_IN_VENDOR", 0, None)}


def test_contra_is_asymmetric_at_zero(spark):
    line = lambda row, ref, amount: (1, "V", row, ref, ref, "", "2026-01-01", "Invoice", amount)
    notes = lambda *rows: [r.note for r in R.reconcile(spark.createDataFrame(list(rows), SCHEMA))[0].orderBy("ref").collect()]
    assert notes(line(1, "a", 0.0), line(2, "b", 0.5)) == ["missing in our books"] * 2
    assert notes(line(1, "a", 0.5), line(2, "b", 0.0)) == ["missing in our books · possible contra with b", "missing in our books · possible contra with a"]


def test_empty(spark):
    results, summary = R.reconcile(spark.createDataFrame([], SCHEMA))
    assert results.count() == 0 and summary.count() == 0


def test_typo_candidates_are_not_sent_through_the_driver(spark, tmp_path):
    """A side is exploded to a row per place of its references, which its size before that does not tell."""
    refs = spark.createDataFrame([(1, "V", f"INV-{k:06d}", 100 * k) for k in range(50)] + [(1, "B", f"1NV-{k:06d}", 100 * k) for k in range(50)], "recon_id long, side string, ref string, cents long")
    refs.write.parquet(str(tmp_path / "refs"))  # a file has a size that Spark goes by
    refs = spark.read.parquet(str(tmp_path / "refs"))
    met = R.typo_candidates(R.side(refs, "V"), R.side(refs, "B"), 0)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.v, r.b) for r in met.collect()) == [(f"INV-{k:06d}", f"1NV-{k:06d}") for k in range(50)]
