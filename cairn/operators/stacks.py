"""Many walks of as many stops each, solved at once: what walks.py does with one, step by step for all of them.

An order is a row of stop numbers; orders are arrays of (walks, orders of each, stops). Walks whose orders have come to
other lengths are taken apart by these.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .walks import EXHAUSTIVE, LESS, SEED, STARTS, UNREACHABLE, Walk, _moves, _orders, _pruned, _saturated

#: Numbers that a stack's tables hold at once, some 8 bytes each.
CELLS = 1 << 21


@dataclass
class Walks:
    """As Walk, with a first axis for the walks; ends tells which have an origin (outward and homeward are the same)."""

    legs: np.ndarray
    visits: np.ndarray
    must: np.ndarray
    relevance: np.ndarray
    budget: np.ndarray
    cap: np.ndarray
    outward: np.ndarray
    ends: np.ndarray
    round_trip: np.ndarray

    def __post_init__(self) -> None:
        finite = lambda x: np.where(np.isfinite(x), x, 0.0)
        self.value, self.value_out = _saturated(self.legs), _saturated(self.outward)
        self.finite, self.finite_out = finite(self.legs), finite(self.outward)
        self.alike = bool((self.value == self.finite).all() and (self.value_out == self.finite_out).all())

    def __len__(self) -> int:
        return len(self.legs)

    def of(self, rows: np.ndarray | slice) -> Walks:
        return Walks(*(x[rows] for x in self._columns()))

    def part(self, rows: np.ndarray, kept: np.ndarray) -> Walks:
        """Of some walks the stops kept, as many of each."""
        r = rows[:, None]
        legs = self.legs[r[:, :, None], kept[:, :, None], kept[:, None, :]]
        return Walks(legs, *(x[r, kept] if x.ndim == 2 else x[rows] for x in self._columns()[1:]))

    def _columns(self) -> tuple[np.ndarray, ...]:
        return (self.legs, self.visits, self.must, self.relevance, self.budget, self.cap, self.outward, self.ends, self.round_trip)

    def _sums(self, orders: np.ndarray, rows: np.ndarray, legs: np.ndarray, outward: np.ndarray) -> np.ndarray:
        orders = np.ascontiguousarray(orders)  # sums are added in the same order as those of one walk
        w = rows.reshape(-1, *[1] * (orders.ndim - 1))
        n = legs.shape[1]
        out = self.visits[w, orders].sum(axis=-1) + legs.ravel().take((w * n + orders[..., :-1]) * n + orders[..., 1:]).sum(axis=-1)
        w, ends, back = w[..., 0], self.ends[rows], self.round_trip[rows]
        ends, back = (x.reshape(w.shape) for x in (ends, back))
        first, last = orders[..., 0], orders[..., -1]
        if ends.any():
            out = np.where(ends, out + outward[w, first], out)
        if orders.shape[-1] > 1 and back.any():
            out = np.where(back, out + np.where(ends, outward[w, last], legs[w, last, first]), out)
        return out

    def _sums_of_all(self, orders: np.ndarray, legs: np.ndarray, outward: np.ndarray) -> np.ndarray:
        """Of each walk those of the same orders: a row of stop numbers each."""
        many, n = self.visits.shape
        flat = legs.reshape(many, n * n)
        out = _added(flat, orders[:, :-1] * n + orders[:, 1:])
        if self.visits.any():
            out = _added(self.visits, orders) + out
        first, last = orders[:, 0], orders[:, -1]
        ends, back = self.ends[:, None], self.round_trip[:, None]
        if ends.any():
            out = np.where(ends, out + outward.take(first, axis=1), out)
        if orders.shape[1] > 1 and back.any():
            out = np.where(back, out + np.where(ends, outward.take(last, axis=1), flat.take(last * n + first, axis=1)), out)
        return out

    def totals_of_all(self, orders: np.ndarray) -> np.ndarray:
        return self._sums_of_all(orders, self.value, self.value_out)

    def measured_of_all(self, orders: np.ndarray) -> np.ndarray:
        return self._sums_of_all(orders, self.finite, self.finite_out)

    def totals(self, orders: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self._sums(orders, rows, self.value, self.value_out)

    def measured(self, orders: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self._sums(orders, rows, self.finite, self.finite_out)

    def bound_legs(self, orders: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """As of Walk; the last is the way back, nothing at all (less than any leg) where the cap isn't for it."""
        w = rows.reshape(-1, *[1] * (orders.ndim - 1))
        legs = self.legs[w, orders, np.roll(orders, -1, axis=-1)]
        legs = np.where(np.isnan(legs), 0.0, legs)
        closing = (self.round_trip & ~self.ends)[rows].reshape(w[..., 0].shape) & (orders.shape[-1] > 1)
        legs[..., -1] = np.where(closing, legs[..., -1], -np.inf)
        return legs


def _added(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of numbers of each row of a table, added as sum() does: fewer than eight one after another."""
    n = index.shape[1]
    if n < 1 or n > 7:
        return table.take(index, axis=1).sum(axis=-1)
    out = table.take(index[:, 0], axis=1)
    for k in range(1, n):
        out += table.take(index[:, k], axis=1)
    return out


def stacked(many: list[Walk]) -> Walks:
    """Walks of as many stops in a stack."""
    none = np.full(len(many[0].legs), np.nan)
    column = lambda name: np.array([getattr(w, name) for w in many])
    outward = np.array([none if w.outward is None else w.outward for w in many])
    return Walks(*(column(c) for c in ("legs", "visits", "must", "relevance", "budget", "cap")), outward, np.array([w.outward is not None for w in many]), column("round_trip"))


class Orders:
    """An order of each walk, of its own length."""

    def __init__(self, stops: np.ndarray, length: np.ndarray) -> None:
        self.stops, self.length = stops, length

    def by_length(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of these walks those of one length after another, and their orders."""
        for n in np.unique(self.length[rows]):
            own = rows[self.length[rows] == n]
            yield own, self.stops[own, :n]

    def put(self, rows: np.ndarray, orders: np.ndarray) -> None:
        self.stops[rows, : orders.shape[1]] = orders
        self.length[rows] = orders.shape[1]


def _whole(orders: np.ndarray) -> Orders:
    return Orders(orders.copy(), np.full(len(orders), orders.shape[1]))


def polished(walks: Walks, orders: Orders) -> Orders:
    out = Orders(orders.stops.copy(), orders.length.copy())
    for rows, own in orders.by_length(np.flatnonzero(orders.length > 2)):
        moves = _moves(own.shape[1])
        own, now = own.copy(), walks.totals(own, rows)
        while len(rows):
            # Stops are numbered by their places, so that the same moves are priced of all walks.
            placed = walks.part(rows, own)
            totals = placed.totals_of_all(moves)
            spent = totals if placed.alike else placed.measured_of_all(moves)
            totals = np.where(spent <= np.maximum(walks.budget[rows], walks.measured(own, rows))[:, None], totals, np.inf)
            best = totals.argmin(axis=1)
            least = totals[np.arange(len(rows)), best]
            go = least + LESS < now
            out.put(rows[~go], own[~go])
            own, now, rows = np.take_along_axis(own, moves[best], 1)[go], least[go], rows[go]
    return out


def _cheaper(walks: Walks, tours: list[Orders]) -> Orders:
    """Of tours of each walk the cheapest, the first of equals."""
    costs = np.full((len(walks), len(tours)), np.inf)
    for t, orders in enumerate(tours):
        for rows, own in orders.by_length(np.arange(len(walks))):
            costs[rows, t] = [round(x, 6) for x in walks.totals(own, rows).tolist()]
    best = costs.argmin(axis=1)
    out = Orders(tours[0].stops.copy(), tours[0].length.copy())
    for t, orders in enumerate(tours):
        own = best == t
        out.stops[own], out.length[own] = orders.stops[own], orders.length[own]
    return out


def insertion(walks: Walks) -> Orders:
    many, n = walks.visits.shape
    out = Orders(np.zeros((many, n), np.int64), np.ones(many, np.int64))
    bound = walks.must.sum(axis=1)
    out.stops[:, 0] = walks.relevance.argmax(axis=1)
    first = np.argsort(~walks.must, axis=1, kind="stable")
    out.stops[bound > 0], out.length[bound > 0] = first[bound > 0], bound[bound > 0]
    taken = np.zeros((many, n), bool)
    for rows, own in out.by_length(np.arange(many)):
        taken[rows[:, None], own] = True
    left = ~taken
    active = np.arange(many)
    while len(active):
        go = []
        for rows, own in out.by_length(active):
            some = left[rows].any(axis=1) & (walks.totals(own, rows) < walks.budget[rows])
            rows, own = rows[some], own[some]
            if not len(rows):
                continue
            k = own.shape[1]
            place = np.array([[*range(p), k, *range(p, k)] for p in range(k + 1)])
            each = np.concatenate([np.broadcast_to(own[:, None, :], (len(rows), n, k)), np.broadcast_to(np.arange(n)[:, None], (len(rows), n, 1))], axis=2)
            tried = each[:, :, place]
            fits = (walks.bound_legs(tried, rows) <= walks.cap[rows][:, None, None, None]).all(axis=-1)
            totals = np.where(fits, walks.totals(tried, rows), np.inf)
            two = np.sort(totals, axis=2)[:, :, :2]
            least = two[:, :, 0]
            regret = np.where(np.isfinite(two[:, :, -1]), two[:, :, -1] - np.where(np.isfinite(least), least, 0.0), 0.0)
            regret = np.where(left[rows] & np.isfinite(least), regret, -1.0)
            stop = regret.argmax(axis=1)
            every = np.arange(len(rows))
            found = regret[every, stop] >= 0
            every, stop, rows = every[found], stop[found], rows[found]
            left[rows, stop] = False
            within = least[every, stop] <= walks.budget[rows]
            at = totals[every, stop].argmin(axis=1)
            out.put(rows[within], tried[every, stop, at][within])
            go.append(rows)
        active = np.concatenate(go) if go else np.zeros(0, np.int64)
    return out


def nearest(walks: Walks) -> Orders:
    many, n = walks.visits.shape
    shuffled = list(range(n))
    random.Random(SEED).shuffle(shuffled)
    starts = np.broadcast_to(np.array(shuffled), (many, n)).copy()
    if walks.ends.any():
        out = np.where(np.isnan(walks.outward), np.inf, walks.outward)
        close = out.argmin(axis=1)
        for w in np.flatnonzero(walks.ends).tolist():
            starts[w] = [close[w], *(s for s in shuffled if s != close[w])]
    tours, every = [], np.arange(many)
    for start in starts.T[:STARTS]:
        orders, left = np.zeros((many, n), np.int64), np.ones((many, n), bool)
        orders[:, 0] = start
        left[every, start] = False
        for k in range(1, n):
            orders[:, k] = np.where(left, walks.value[every, orders[:, k - 1]], np.inf).argmin(axis=1)
            left[every, orders[:, k]] = False
        tours.append(polished(walks, _whole(orders)))
    return _cheaper(walks, tours)


def tour(walks: Walks) -> Orders:
    many, n = walks.visits.shape
    every = np.arange(many)
    if n < 2:
        return _whole(np.zeros((many, n), np.int64))
    if n == 2:
        order = np.argsort(~walks.must, axis=1, kind="stable")
        back = walks.ends & (walks.totals(order[:, ::-1], every) < walks.totals(order, every))
        return _whole(np.where(back[:, None], order[:, ::-1], order))
    if n <= EXHAUSTIVE:
        orders = _orders(n)
        costs = np.round(walks.totals_of_all(orders), 6)
        return _whole(orders[costs.argmin(axis=1)])
    return _cheaper(walks, [polished(walks, insertion(walks)), nearest(walks)])


def trimmed(walks: Walks, orders: Orders) -> Orders:
    out = Orders(orders.stops.copy(), orders.length.copy())
    active = np.flatnonzero(out.length > 1)
    while len(active):
        go = []
        for rows, own in out.by_length(active):
            k = own.shape[1]
            every = np.arange(len(rows))
            legs = walks.bound_legs(own, rows)
            longest = legs.argmax(axis=1)
            free = ~walks.must[rows[:, None], own]
            pair = np.stack([longest, (longest + 1) % k], axis=1)
            ends = free[every[:, None], pair] & (legs[every, longest] > walks.cap[rows])[:, None]
            fits = walks.measured(own, rows) <= walks.budget[rows]
            more = free.any(axis=1) & ~(fits & ~ends.any(axis=1))
            rest = np.array([[j for j in range(k) if j != i] for i in range(k)])
            saved = walks.measured(own[:, rest], rows)
            of_ends = np.where(ends, saved[every[:, None], pair], np.inf).argmin(axis=1)
            gone = np.where(ends.any(axis=1), pair[every, of_ends], np.where(free, saved, np.inf).argmin(axis=1))
            out.put(rows[more], own[every[:, None], rest[gone]][more])
            go.append(rows[more & (k > 2)])
        active = np.concatenate(go) if go else np.zeros(0, np.int64)
    return out


def planned(walks: Walks) -> Orders:
    """Ordered, trimmed and polished again."""
    return polished(walks, trimmed(walks, tour(walks)))


def pruned(walks: Walks, orders: Orders) -> Orders:
    out = Orders(orders.stops.copy(), orders.length.copy())
    for rows, own in orders.by_length(np.flatnonzero(orders.length > 2)):
        far = (walks.legs[rows[:, None], own[:, :-1], own[:, 1:]] >= UNREACHABLE).any(axis=1)
        for w, order in zip(rows[far].tolist(), own[far].tolist(), strict=True):
            out.put(np.array([w]), np.array([_pruned(walks.legs[w], walks.must[w], order)]))
    return out


def chunks(many: int, n: int) -> Iterator[slice]:
    """Walks of n stops that are solved at once."""
    each = max(1, CELLS // max(720 * 6, 4 * n**3))
    return (slice(k, k + each) for k in range(0, many, each))
