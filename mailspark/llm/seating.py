"""Numbers of tables in Pitman-Yor restaurants, drawn from their posterior.

A restaurant with discount d, strength s and T tables gets a variable x from Gamma(s/d + T). Given x its dishes are independent: one
with c customers has t tables with weight S(c, t) y^t, where y = d x times the dish's base probability and S are the generalised
Stirling numbers of discount d. All customers of all dishes so sit down anew at once, and all of a restaurant that its dishes need to
share is x: they can lie in different tasks. Numbers up to ``EXACT`` customers come from a table of log S, larger ones from a numeric
contour integral of S's generating function, interpolated over the likely t.

Random numbers are hashes of a key and a number of the sweep, so all tasks that need one get the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np

from mailspark.llm.common import BASE, mixed

EXACT = 1 << 10
#: Points of the contour integral, their reach, and the numbers of tables at which it is taken.
POINTS, REACH, NODES = 28, 4.0, 16
#: Weights of a block of dishes.
BLOCK = 1 << 19


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1, neither included."""
    h = keys.astype(np.uint64)
    for number in salt:
        h = mixed((h + np.uint64(number + 1)) * BASE)
        h = mixed(h ^ (h >> np.uint64(32)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variables of shapes above 1 (Marsaglia and Tsang)."""
    out, left = np.zeros(len(shape)), np.arange(len(shape))
    attempt = 0
    while len(left):
        a, b, c = (uniform(keys[left], salt, 3 * attempt + k) for k in range(3))
        normal = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        d = shape[left] - 1 / 3
        v = np.maximum(1 + normal / np.sqrt(9 * d), 0) ** 3
        with np.errstate(divide="ignore"):
            taken = np.log(c) < 0.5 * normal**2 + d - d * v + d * np.log(v)
        out[left[taken]] = (d * v)[taken]
        left = left[~taken]
        attempt += 1
    return out


@cache
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) at [t, c] up to ``EXACT`` each."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        table[c + 1, 1 : c + 2] = np.logaddexp(table[c, : c + 1], np.log(np.maximum(c - discount * t, 1e-300)) + table[c, 1 : c + 2])
    return np.ascontiguousarray(table.T)


def log_factorial(t: np.ndarray) -> np.ndarray:
    """log of t!, continued to numbers above -1 that aren't whole."""
    x = t + 9.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return series - np.log((t + 1.0) * (t + 2.0) * (t + 3.0) * (t + 4.0)) - np.log((t + 5.0) * (t + 6.0) * (t + 7.0) * (t + 8.0))


def log_coefficient(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log of the coefficient of s^c in (1 - (1 - s)^d)^t; t lies below c and need not be whole.

    S(c, t) is that times c! / (t! d^t). The contour is a parabola around the branch cut from 1, through the saddle unless that lies very close to 1.
    """
    low, high, want = np.full(c.shape, -60 / (1 - discount)), np.zeros(c.shape), np.log(c / t)
    for _ in range(40):
        middle = (low + high) / 2
        above = math.log(discount) + (discount - 1) * middle + np.log(-np.expm1(middle)) - np.log(-np.expm1(discount * middle)) > want
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    w = np.minimum(np.maximum(np.exp((low + high) / 2), 3 / c), 1 - 1e-9)
    g, slope, bend = 1 - w**discount, discount * w ** (discount - 1), discount * (1 - discount) * w ** (discount - 2)
    width = 1 / np.sqrt(np.maximum(4 * w**2 * (t * (bend / g - (slope / g) ** 2) + c / (1 - w) ** 2), 2 * c * w))
    step = REACH / POINTS
    at = np.arange(POINTS) * step
    length = width[..., None] * np.cosh(at) * step
    length[..., 0] /= 2
    turn = 1 + 1j * width[..., None] * np.sinh(at)
    around = w[..., None] * turn**2
    height = t[..., None] * np.log(1 - around**discount) - (c[..., None] + 1) * np.log(1 - around)
    top = height[..., 0].real
    return np.log(2 * w / np.pi * ((np.exp(height - top[..., None]) * turn).real * length).sum(axis=-1)) + top


class Large:
    """Weights of the numbers of tables of dishes of more than ``EXACT`` customers."""

    def __init__(self, c: np.ndarray, log_y: np.ndarray, discount: float) -> None:
        self.c, self.log_d = c, math.log(discount)
        low, high = np.full(len(c), -60 / (1 - discount)), np.zeros(len(c))
        for _ in range(50):
            middle = (low + high) / 2
            above = log_y + (discount - 1) * middle + np.log(-np.expm1(middle)) > np.log(c)
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        typical = np.clip(np.exp(log_y - self.log_d) * -np.expm1(discount * (low + high) / 2), 1, c)
        reach = 9 * np.sqrt(typical) + 12
        self.first, self.last = np.floor(np.maximum(typical - reach, 1)), np.ceil(np.minimum(typical + reach, c))
        angle = np.pi * (np.arange(NODES) + 0.5) / NODES
        waves = np.cos(np.outer(np.arange(NODES), angle)) * (2 / NODES)
        waves[0] /= 2
        self.middle, self.radius = (self.first + self.last) / 2, (self.last - self.first) / 2
        self.series = np.zeros((len(c), NODES))
        for begin in range(0, len(c), 256):
            some = slice(begin, begin + 256)
            nodes = self.middle[some, None] + self.radius[some, None] * np.cos(angle)
            values = log_coefficient(np.broadcast_to(c[some, None].astype(np.float64), nodes.shape), nodes, discount)
            # what is left without these two is smooth up to both ends
            values += log_factorial(c[some, None] - nodes) - np.log(nodes)
            self.series[some] = values @ waves.T

    def weights(self, log_y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(dishes, row of weights of each, from its ``first`` number of tables on); log_y may differ a little from that of before."""
        widths = (self.last - self.first).astype(np.int64) + 1
        order, done = np.argsort(widths, kind="stable"), 0
        while done < len(order):
            some = order[done : done + max(1, BLOCK // int(widths[order[min(done + 256, len(order)) - 1]]))][:256]
            done += len(some)
            t = self.first[some, None] + np.arange(widths[some[-1]])
            t = np.minimum(t, self.last[some, None])
            logs = np.polynomial.chebyshev.chebval((t - self.middle[some, None]) / self.radius[some, None], self.series[some].T[:, :, None], tensor=False)
            logs += np.log(t) - log_factorial(self.c[some, None] - t) - log_factorial(t) + t * (log_y[some, None] - self.log_d)
            weights = np.exp(logs - logs.max(axis=1, keepdims=True))
            weights[np.arange(weights.shape[1]) >= widths[some, None]] = 0
            yield some, weights


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, width) over ascending sizes: dishes of similar size whose weights fit a block."""
    first = 0
    while first < len(sizes):
        last = int(np.searchsorted(sizes, sizes[first] + sizes[first] // 4, side="right"))
        last = min(last, first + max(1, BLOCK // int(sizes[last - 1])))
        yield first, last, int(sizes[last - 1])
        first = last


def drawn(c: np.ndarray, log_y: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of c customers (1 at least), by uniform numbers u."""
    out = np.ones(len(c), dtype=np.int64)
    several = np.flatnonzero(c > 1)
    size = np.minimum(c[several], EXACT + 1).astype(np.uint16)
    order = several[np.argsort(size, kind="stable")]
    end = int((size <= EXACT).sum())
    table = log_stirling(discount)
    for first, last, width in blocks(c[order[:end]]):
        some = order[first:last]
        weights = table[1 : width + 1, c[some]] + log_y[some] * np.arange(1, width + 1)[:, None]
        reach = np.cumsum(np.exp(weights - weights.max(axis=0)), axis=0)
        out[some] = 1 + (reach < u[some] * reach[-1]).sum(axis=0)
    rest = order[end:]
    if len(rest):
        more = Large(c[rest], log_y[rest], discount)
        for at, weights in more.weights(log_y[rest]):
            reach = np.cumsum(weights, axis=1)
            out[rest[at]] = more.first[at].astype(np.int64) + (reach < u[rest[at], None] * reach[:, -1:]).sum(axis=1)
    return out


class Alike:
    """Dishes with the same base in one restaurant: ``times`` of c customers each, c ascending."""

    def __init__(self, c: np.ndarray, times: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        self.c, self.times, self.discount, self.rng = c, times, discount, rng
        self.several, self.end = int(np.searchsorted(c, 2)), int(np.searchsorted(c, EXACT, side="right"))
        self.more, self.log_y = None, 0.0

    def mean_tables(self, log_y: float) -> np.ndarray:
        """Tables on average over the dishes of as many customers, drawn."""
        out = np.ones(len(self.c))
        table = log_stirling(self.discount)
        for k in range(self.several, self.end):
            t = np.arange(1, self.c[k] + 1)
            logs = table[1 : self.c[k] + 1, self.c[k]] + log_y * t
            out[k] = self._mean(k, np.exp(logs - logs.max()))
        if self.end < len(self.c):
            c = self.c[self.end :]
            if self.more is None or abs(log_y - self.log_y) > 0.05:
                self.more, self.log_y = Large(c, np.full(len(c), log_y), self.discount), log_y
            for at, weights in self.more.weights(np.full(len(c), log_y)):
                for k, row in zip(at, weights):
                    out[self.end + k] = self.more.first[k] - 1 + self._mean(self.end + k, row)
        return out

    def _mean(self, k: int, weights: np.ndarray) -> float:
        return float(self.rng.multinomial(self.times[k], weights / weights.sum()) @ np.arange(1, len(weights) + 1)) / self.times[k]
