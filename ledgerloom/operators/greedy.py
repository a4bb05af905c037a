"""Order-dependent matching inside one small group: unique-candidate greedy (H1) and combination sums (H2).

Amounts are whole cents.  Both work on one group at a time: a segment of amounts, or one reconciliation of
at most 80 open items.  Groups come as lists by column, V rows in the order in which they are to be visited.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

POOL, PARTS = 25, (2, 3)
#: A day number that is near no other.
NO_DAY = -(10**9)


@cache
def _choices(size: int, n: int) -> np.ndarray:
    """All choices of ``n`` of ``size`` places, in order."""
    return np.array(list(combinations(range(size), n)))


class _Stock:
    """B items by absolute cents; those taken are marked, so that a look-up is a slice and never moves anything."""

    def __init__(self, keys: list, cents: list[int], days: list[int | None]):
        order = sorted(range(len(keys)), key=lambda k: abs(cents[k]))
        self.keys = [keys[k] for k in order]
        signed = np.array([cents[k] for k in order], np.int64)
        self.size, self.plus = np.abs(signed), signed >= 0
        self.day = np.array([days[k] or NO_DAY for k in order], np.int64)
        self.open = np.ones(len(order), bool)

    def within(self, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.size, (low, high + 1))
        return a + np.flatnonzero(self.open[a:b])


def match_segment(columns: dict[str, list], tol: int, window: int, exact_first: bool) -> list[tuple]:
    """(segment, v key, b key, dated, place of the V, the B's other segment) of one segment.  Each V is visited once, in the order of the rows.

    ``exact_first`` (values): open B of equal absolute cents, else within ``tol``; those of the same sign if any; one
    left is the pair, else exactly one inside the day window.  Otherwise (payments): B within ``tol``; of several those
    inside the window if any; a pair only if one is left.  A B with ``gone`` (place and key of a V) is open to earlier V only.
    """
    seg, side, key, cents, days, mate = (columns[c] for c in ("seg", "side", "key", "cents", "day", "mate"))
    place, gone_at, gone_by = (columns[c] for c in ("ord", "gone_at", "gone_by"))
    b = [k for k, s in enumerate(side) if s == "B"]
    stock = _Stock([key[k] for k in b], [cents[k] for k in b], [days[k] for k in b])
    mates = {key[k]: mate[k] for k in b}
    leaves = sorted(((gone_at[k], gone_by[k]), key[k]) for k in b if gone_at[k] is not None)[::-1]
    where = {k: at for at, k in enumerate(stock.keys)} if leaves else {}
    out = []
    for k in (k for k, s in enumerate(side) if s == "V"):
        while leaves and leaves[-1][0] < (place[k], key[k]):
            stock.open[where[leaves.pop()[1]]] = False
        size, day = abs(cents[k]), days[k] or None
        found = stock.within(size, size) if exact_first else stock.within(size - tol, size + tol)
        if exact_first and not len(found):
            found = stock.within(size - tol, size + tol)
        near = lambda at: at[np.abs(stock.day[at] - day) <= window] if day is not None else at[:0]  # noqa: E731, B023
        dated = False
        if exact_first and len(found) > 1:
            same = found[stock.plus[found] == (cents[k] >= 0)]
            found = same if len(same) else found
            if len(found) > 1:
                dated, found = True, near(found)
        elif len(found) > 1:
            inside = near(found)
            found = inside if len(inside) else found
        if len(found) == 1:
            stock.open[found[0]] = False
            taken = stock.keys[found[0]]
            out.append((seg[k], key[k], taken, dated, place[k], mates[taken]))
    return out


def match_first_unique(columns: dict[str, list]) -> list[tuple]:
    """Of candidate pairs (v, b), sorted by v: V in order; a pair where exactly one of its candidates is still open."""
    taken: set = set()
    out, own = [], []
    v, b = columns["v"], columns["b"]
    for k, x in enumerate(v):
        if b[k] not in taken:
            own.append(b[k])
        if k + 1 == len(v) or v[k + 1] != x:
            if len(own) == 1:
                taken.add(own[0])
                out.append((x, own[0]))
            own = []
    return out


def match_combos(columns: dict[str, list], tol: int) -> list[tuple]:
    """(single, parts, from V, residual in cents, place): one item equal to the sum of two, else three, of the other side's
    25 largest open ones; V items first, then B items; largest first, then by reference."""
    by_size = lambda x: (-abs(x[1]), x[0])
    items = list(zip(columns["side"], columns["ref"], columns["cents"], strict=True))
    left, right = (sorted([(r, c) for s, r, c in items if s == which], key=by_size) for which in "VB")
    out: list[tuple] = []
    for from_v in (True, False):
        singles, many = (left, right) if from_v else (right, left)
        for item in list(singles):
            pool = many[:POOL]
            cents = np.array([c for _, c in pool], np.int64)
            for n in PARTS:
                if len(pool) < n:
                    continue
                places = _choices(len(pool), n)
                hit = np.flatnonzero(np.abs(cents[places].sum(1) - item[1]) <= tol)
                if len(hit):
                    parts = [pool[k] for k in places[hit[0]]]
                    out.append((item[0], [p for p, _ in parts], from_v, item[1] - sum(c for _, c in parts), len(out)))
                    for p in parts:
                        many.remove(p)
                    singles.remove(item)
                    break
    return out
