"""Chinese restaurants: customers of many dishes at tables, seated again one at a time by Gibbs sampling.

A customer of a dish with c customers at t tables takes a table of n customers with odds of n -
discount, and a new one with odds of urge, which is (strength + discount * tables of the
restaurant) * the parent's probability of the dish. A step takes one customer of each of many
dishes away, at random, and seats them again given all that still sit.
"""

from __future__ import annotations

import math

import numpy as np

#: Customers that join or leave a dish one by one for all dishes together; what is beyond is drawn dish by dish, from the same distribution.
TOGETHER = 64


def digamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def quiet(customers: int, tables: int, many: int, urge: float, discount: float, u: float) -> int:
    """How many of so many further customers sit down before one opens a table, for a uniform number u."""
    c = customers - discount * tables
    start = math.lgamma(c) - math.lgamma(urge + c)

    def stays(j: int) -> bool:
        return math.lgamma(c + j) - math.lgamma(urge + c + j) - start >= math.log(u)

    if stays(many):
        return many
    # About (1 + j / c) ** -urge stay; from that guess outwards to a bracket, which is then halved.
    guess = min(many - 1, int(min(many, c * math.expm1(min(50.0, -math.log(u) / urge)))))
    step = 1 + guess // 64
    low, high = (guess, min(many, guess + step)) if stays(guess) else (max(0, guess - step), guess)
    while high < many and stays(high):
        low, high, step = high, min(many, high + 2 * step), 2 * step
    while low > 0 and not stays(low):
        low, high, step = max(0, low - 2 * step), low, 2 * step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if stays(middle) else (low, middle)
    return low


def seat_many(sizes: np.ndarray, many: int, urge: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The tables of a dish after so many customers have come one after another. There is a table already."""
    sizes = sizes.copy()
    while many:
        some = quiet(int(sizes.sum()), len(sizes), many, urge, discount, 1.0 - rng.random())
        if some:
            sizes += rng.multinomial(some, rng.dirichlet(sizes - discount)) if len(sizes) > 1 else some
        many -= some
        if many:
            sizes, many = np.append(sizes, 1), many - 1
    return sizes


class Seating:
    """Of each dish its customers and tables, and the tables' sizes in the order of the dishes."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray, discount: float, rng: np.random.Generator):
        self.discount, self.rng = discount, rng
        self.tables = tables.astype(np.int64)
        self.owner = np.repeat(np.arange(len(tables)), self.tables)
        self.sizes = sizes.astype(np.int64)
        self.customers = np.bincount(self.owner, self.sizes, len(tables)).astype(np.int64)
        self._index()

    def _index(self) -> None:
        self.ends = np.cumsum(self.sizes)
        self.start = np.cumsum(self.customers) - self.customers

    def _some_table(self, who: np.ndarray) -> np.ndarray:
        """The table of a random customer of each dish."""
        return np.searchsorted(self.ends, self.start[who] + (self.rng.random(len(who)) * self.customers[who]).astype(np.int64), side="right")

    def _rebuild(self, opened: np.ndarray) -> None:
        """Empty tables go, and each dish in opened, which ascends, gets a table of one customer."""
        if not self.sizes.all():
            some = self.sizes > 0
            self.owner, self.sizes = self.owner[some], self.sizes[some]
        if len(opened):
            at = np.searchsorted(self.owner, opened, side="right")
            self.owner, self.sizes = np.insert(self.owner, at, opened), np.insert(self.sizes, at, 1)
        self._index()

    def leave(self, who: np.ndarray) -> np.ndarray:
        """A random customer of each of the dishes (none twice) goes; the dishes that lose a table."""
        at = self._some_table(who)
        self.sizes[at] -= 1
        self.customers[who] -= 1
        gone = who[self.sizes[at] == 0]
        self.tables[gone] -= 1
        self._index()
        return gone

    def join(self, who: np.ndarray, urge: np.ndarray) -> np.ndarray:
        """A customer comes to each of the dishes (none twice); the dishes that open a table."""
        old = self.customers[who] - self.discount * self.tables[who]
        opens = (self.customers[who] == 0) | (self.rng.random(len(who)) * (urge + old) < urge)
        rest = seated = who[~opens]
        while len(rest):
            at = self._some_table(rest)
            takes = self.rng.random(len(rest)) * self.sizes[at] < self.sizes[at] - self.discount
            self.sizes[at[takes]] += 1
            rest = rest[~takes]  # the index is of before the step, and so right for dishes that still wait
        opened = who[opens]
        self.customers[seated] += 1
        self.customers[opened] += 1
        self.tables[opened] += 1
        self._rebuild(opened)
        return opened

    def change(self, target: np.ndarray, urge: np.ndarray) -> None:
        """Customers come or go until each dish has its target."""
        for turn in range(TOGETHER):
            off = np.flatnonzero(self.customers != target)
            if not len(off):
                return
            if turn % 4 == 3 and 2 * len(off) < len(target):
                return self._change_some(off, target[off], urge[off])
            more = self.customers[off] < target[off]
            if not more.all():
                self.leave(off[~more])
                self._rebuild(off[:0])
            if more.any():
                self.join(off[more], urge[off[more]])
        first = np.cumsum(self.tables) - self.tables
        parts, at = [], 0
        for i in np.flatnonzero(self.customers != target):
            a, b = first[i], first[i] + self.tables[i]
            sizes, step = self.sizes[a:b], int(target[i] - self.customers[i])
            new = seat_many(sizes, step, float(urge[i]), self.discount, self.rng) if step > 0 else sizes - self.rng.multivariate_hypergeometric(sizes, -step, method="marginals")
            new = new[new > 0]
            parts += [self.sizes[at:a], new]
            at, self.tables[i], self.customers[i] = b, len(new), target[i]
        self.sizes = np.concatenate([*parts, self.sizes[at:]])
        self.owner = np.repeat(np.arange(len(self.tables)), self.tables)
        self._index()

    def _change_some(self, dishes: np.ndarray, target: np.ndarray, urge: np.ndarray) -> None:
        """change() for a few dishes, without the others being moved about."""
        chosen = np.zeros(len(self.tables), dtype=bool)
        chosen[dishes] = True
        mine = chosen[self.owner]
        some = Seating(self.tables[dishes], self.sizes[mine], self.discount, self.rng)
        some.change(target, urge)
        owner = np.concatenate([self.owner[~mine], dishes[some.owner]])
        order = np.argsort(owner, kind="stable")
        self.owner, self.sizes = owner[order], np.concatenate([self.sizes[~mine], some.sizes])[order]
        self.tables[dishes], self.customers[dishes] = some.tables, some.customers
        self._index()

    def bends(self) -> float:
        """What the seating says about the discount: the expected sum of 1 - z over all but the first customer of each table."""
        sizes, often = np.unique(self.sizes[self.sizes > 1], return_counts=True)
        d = self.discount
        return float((often * (1 - d) * (digamma(sizes - d) - digamma(1 - d))).sum())
