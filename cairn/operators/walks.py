"""One walk of a few stops: seconds of its legs and visits, and what binds it. Many orders are priced at once.

Legs that are NaN were not measured and add nothing; those of UNREACHABLE seconds or more can't be walked. An order is
an array of stop numbers.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import permutations

import numpy as np

UNREACHABLE = 1e9
#: All orders are tried up to so many stops, and runs of up to so many are moved.
EXHAUSTIVE = 6
SEGMENT = 3
#: Nearest-neighbour tours start at so many stops, shuffled with this seed.
STARTS = 5
SEED = 42
LESS = 1e-6


@dataclass
class Walk:
    legs: np.ndarray
    visits: np.ndarray
    must: np.ndarray
    relevance: np.ndarray
    budget: float = math.inf
    cap: float = math.inf
    outward: np.ndarray | None = None
    homeward: np.ndarray | None = None
    round_trip: bool = False
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.value = _saturated(self.legs)

    def _sums(self, orders: np.ndarray, legs: np.ndarray, outward: np.ndarray | None, homeward: np.ndarray | None) -> np.ndarray:
        out = self.visits[orders].sum(axis=1) + legs[orders[:, :-1], orders[:, 1:]].sum(axis=1)
        if outward is not None and orders.shape[1]:
            out = out + outward[orders[:, 0]]
        if self.round_trip and orders.shape[1] > 1:
            out = out + (legs[orders[:, -1], orders[:, 0]] if homeward is None else homeward[orders[:, -1]])
        return out

    def totals(self, orders: np.ndarray) -> np.ndarray:
        """Walking and visiting, the ways from and to the origin included; a leg that can't be walked costs UNREACHABLE."""
        ends = (None if x is None else _saturated(x) for x in (self.outward, self.homeward))
        return self._sums(orders, self.value, *ends)

    def measured(self, orders: np.ndarray) -> np.ndarray:
        """The same of what was measured."""
        finite = lambda x: np.where(np.isfinite(x), x, 0.0)
        ends = (None if x is None else finite(x) for x in (self.outward, self.homeward))
        return self._sums(orders, finite(self.legs), *ends)

    def bound_legs(self, orders: np.ndarray) -> np.ndarray:
        """Seconds of the legs that the cap is for: between stops, and back to the first where no origin is known."""
        legs = self.legs[orders[:, :-1], orders[:, 1:]]
        if self.round_trip and self.outward is None and orders.shape[1] > 1:
            legs = np.c_[legs, self.legs[orders[:, -1], orders[:, 0]]]
        return np.where(np.isnan(legs), 0.0, legs)

    def total(self, order: list[int]) -> float:
        return float(self.totals(np.array([order], np.int64))[0])

    def cheapest(self, orders: np.ndarray) -> list[int]:
        """The first in order of those that cost least."""
        return orders[int(np.argmin(np.round(self.totals(orders), 6)))].tolist()

    def part(self, kept: list[int]) -> Walk:
        ends = (None if x is None else x[kept] for x in (self.outward, self.homeward))
        return Walk(self.legs[np.ix_(kept, kept)], self.visits[kept], self.must[kept], self.relevance[kept], self.budget, self.cap, *ends, self.round_trip)


def _saturated(legs: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(legs), 0.0, np.minimum(legs, UNREACHABLE))


@lru_cache(maxsize=16)
def _orders(n: int) -> np.ndarray:
    return np.array(list(permutations(range(n))), np.int64).reshape(-1, n)


@lru_cache(maxsize=64)
def _moves(n: int) -> np.ndarray:
    """Places after each reversal of a run, and after each run of up to SEGMENT stops went elsewhere."""
    at = list(range(n))
    runs = [at[:i] + at[i:j][::-1] + at[j:] for i in range(n) for j in range(i + 2, n + 1)]
    for size in range(1, min(SEGMENT, n - 1) + 1):
        for i in range(n - size + 1):
            rest = at[:i] + at[i + size :]
            runs += [rest[:k] + at[i : i + size] + rest[k:] for k in range(len(rest) + 1) if k != i]
    return np.array(runs, np.int64).reshape(-1, n)


def exhaustive(walk: Walk) -> list[int]:
    return walk.cheapest(_orders(len(walk.legs)))


def polished(walk: Walk, order: list[int]) -> list[int]:
    """The best of all moves, as long as one shortens the walk; none leads over the budget."""
    if len(order) < 3:
        return order
    now, own = walk.total(order), np.array(order, np.int64)
    while True:
        tried = own[_moves(len(order))]
        totals = np.where(walk.measured(tried) <= max(walk.budget, float(walk.measured(own[None, :])[0])), walk.totals(tried), math.inf)
        best = int(np.argmin(totals))
        if totals[best] + LESS >= now:
            return own.tolist()
        own, now = tried[best], float(totals[best])


def insertion(walk: Walk) -> list[int]:
    """The stop that loses most by waiting goes in where it is cheapest; it begins with what must be visited, else the most relevant.

    Places that need a leg over the cap are not tried, stops that would lead over the budget are skipped, and a walk
    that has used up its budget is done.
    """
    order = np.flatnonzero(walk.must).tolist() or [int(np.argmax(walk.relevance))]
    left = [i for i in range(len(walk.legs)) if i not in order]
    while left and walk.total(order) < walk.budget:
        best = None
        for stop in left:
            tried = np.array([order[:k] + [stop] + order[k:] for k in range(len(order) + 1)], np.int64)
            legs = walk.bound_legs(tried)
            totals = np.where((legs <= walk.cap).all(axis=1), walk.totals(tried), math.inf)
            first, *more = np.sort(totals[np.isfinite(totals)])[:2].tolist() or [None]
            if first is None:
                continue
            regret = more[0] - first if more else 0.0
            if best is None or regret > best[0]:
                best = (regret, stop, tried[int(np.argmin(totals))].tolist(), first)
        if best is None:
            break
        left.remove(best[1])
        order = best[2] if best[3] <= walk.budget else order
    return order


def nearest(walk: Walk) -> list[int]:
    """Nearest-neighbour tours from a few stops (the one nearest to the origin first), polished; the cheapest, the first of equals."""
    n = len(walk.legs)
    starts = list(range(n))
    random.Random(SEED).shuffle(starts)
    if walk.outward is not None:
        close = int(np.nanargmin(walk.outward)) if not np.isnan(walk.outward).all() else 0
        starts = [close, *(s for s in starts if s != close)]
    tours = []
    for order in ([s] for s in starts[:STARTS]):
        left = [i for i in range(n) if i != order[0]]
        while left:
            order.append(min(left, key=lambda j: (walk.value[order[-1], j], j)))
            left.remove(order[-1])
        tours.append(polished(walk, order))
    return min(tours, key=lambda o: round(walk.total(o), 6))


def tour(walk: Walk) -> list[int]:
    """All orders up to six stops, beyond that the better of two heuristics, the first of equals; two stops go from the better end."""
    n = len(walk.legs)
    if n < 2:
        return list(range(n))
    if n == 2:
        bound = np.flatnonzero(walk.must).tolist()
        order = bound + [i for i in range(2) if i not in bound]
        return order[::-1] if walk.outward is not None and walk.total(order[::-1]) < walk.total(order) else order
    if n <= EXHAUSTIVE:
        return exhaustive(walk)
    return min((polished(walk, insertion(walk)), nearest(walk)), key=lambda o: round(walk.total(o), 6))


def trimmed(walk: Walk, order: list[int]) -> list[int]:
    """Stops go one by one, each time the one that saves most, until the budget and every leg's cap are kept.

    An end of the longest leg goes first while that is over the cap. What must be visited stays.
    """
    order = list(order)
    while len(order) > 1:
        own = np.array([order], np.int64)
        legs = walk.bound_legs(own)[0]
        k = int(np.argmax(legs))
        too_long, fits = bool(legs[k] > walk.cap), bool(walk.measured(own)[0] <= walk.budget)
        free = [i for i in order if not walk.must[i]]
        ends = [i for i in (order[k], order[(k + 1) % len(order)]) if too_long and i in free]
        if not free or fits and not ends:
            break
        choice = ends or free
        left = walk.measured(np.array([[j for j in order if j != i] for i in choice], np.int64))
        order.remove(choice[int(np.argmin(left))])
    return order


def planned(walk: Walk) -> list[int]:
    """Ordered, trimmed and polished again."""
    return polished(walk, trimmed(walk, tour(walk)))


def pruned(walk: Walk, order: list[int]) -> list[int]:
    """Stops that can't be walked to from the one kept before go, while three or more are left; what must be visited stays."""
    return _pruned(walk.legs, walk.must, order)


def _pruned(legs: np.ndarray, must: np.ndarray, order: list[int]) -> list[int]:
    kept = list(order)
    k = 0
    while k < len(kept) - 1 and len(kept) > 2:
        if legs[kept[k], kept[k + 1]] >= UNREACHABLE and not must[kept[k + 1]]:
            del kept[k + 1]
        else:
            k += 1
    return kept


#: Fixed value: walks of more stops are ordered by going on to the nearest stop left, from the first.
EXACT = 12
#: Bytes of one stack's table of partial walks.
TABLE_BYTES = 64 << 20
#: Walks that differ by less cost the same.
EQUAL = 1e-9


def shortest(legs: np.ndarray) -> np.ndarray:
    """Orders of many walks of as many stops: the cheapest, and of those that cost the same the first in order of their stops.

    legs: of each walk, from each stop to each. Walks beyond EXACT stops go on to the nearest, the first of equals.
    """
    many, n = legs.shape[:2]
    if n > EXACT:
        return _onward(legs)
    each = max(1, TABLE_BYTES // (8 * n << n))
    return np.concatenate([_cheapest(legs[k : k + each]) for k in range(0, many, each)]) if many else np.zeros((0, n), np.int64)


def _onward(legs: np.ndarray) -> np.ndarray:
    many, n = legs.shape[:2]
    every = np.arange(many)
    orders = np.zeros((many, n), np.int64)
    left = np.ones((many, n), bool)
    for k in range(n):
        if k:
            orders[:, k] = np.where(left, legs[every, orders[:, k - 1]], np.inf).argmin(axis=1)
        left[every, orders[:, k]] = False
    return orders


@lru_cache(maxsize=16)
def _sets(n: int) -> list[np.ndarray]:
    """Sets of n stops as bits, by how many they hold."""
    every = np.arange(1 << n)
    held = np.bitwise_count(every)
    return [every[held == k] for k in range(n + 1)]


def _cheapest(legs: np.ndarray) -> np.ndarray:
    """rest[w, s, i]: what it costs to go on from i through all of the set s, which holds i; all walks and all sets of a size at once."""
    many, n = legs.shape[:2]
    rest = np.full((many, 1 << n, n), np.inf)
    for i in range(n):
        rest[:, 1 << i, i] = 0.0
    for sets in _sets(n)[2:]:
        for i in range(n):
            own = sets[sets >> i & 1 == 1]
            rest[:, own, i] = (legs[:, None, i, :] + rest[:, own ^ (1 << i), :]).min(axis=2)
    # Read forward: at each place the first stop that leads to the least in all.
    every, seen = np.arange(many), np.full(many, (1 << n) - 1)
    orders = np.zeros((many, n), np.int64)
    costs = rest[:, -1, :]
    for k in range(n):
        orders[:, k] = (costs <= costs.min(axis=1, keepdims=True) + EQUAL).argmax(axis=1)
        seen = seen ^ (1 << orders[:, k])
        costs = legs[every, orders[:, k]] + rest[every, seen]
    return orders
