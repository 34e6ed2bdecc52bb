"""PCMCI+ on a correlation matrix of stacked lags: lagged parents, momentary tests, and the orientation of contemporaneous links.

After Runge (2020), "Discovering contemporaneous and lagged causal relations in autocorrelated nonlinear time series datasets", and for context
nodes Guenther, Ninad and Runge (2023), "Causal discovery for time series from multiple datasets with latent contexts". A node is a set of columns
of the matrix, so that a dummy of many levels is one node; a node at lag k lies `width` columns times k further on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

#: A node at a lag: (number of the node, frames before the present).
Place = tuple[int, int]


def correlation_p(r: float, freedom: float, columns: int = 1) -> float:
    """p of a (multiple) correlation of Gaussian data with so many columns: the F test, for one column Student's two-sided t test.

    That is the regularized incomplete beta function I_{1 - r^2}(freedom / 2, columns / 2), freedom being what the columns leave.
    """
    if freedom < 1:
        return 1.0
    x, a, b = 1 - min(r * r, 1.0), freedom / 2, columns / 2
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _continued(b, a, 1 - x) / b
    return front * _continued(a, b, x) / a


def _continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated from the front (Lentz 1976)."""
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


@dataclass
class Tests:
    """Partial correlations of nodes: columns[a] are those of node a at lag 0; kinds[a] is system, context, space or dummy.

    Context nodes are series of their own; space nodes and dummies don't change with the lag, so their columns stay those of lag 0.
    """

    matrix: np.ndarray
    n: int
    width: int
    columns: Sequence[Sequence[int]]
    kinds: Sequence[str] = field(default_factory=list)

    @property
    def system(self) -> list[int]:
        return [a for a in range(len(self.columns)) if self.kind(a) == "system"]

    def kind(self, a: int) -> str:
        return self.kinds[a] if self.kinds else "system"

    def at(self, place: Place) -> list[int]:
        a, lag = place
        return [c + (lag * self.width if self.kind(a) in ("system", "context") else 0) for c in self.columns[a]]

    def __call__(self, x: Place, y: Place, given: Iterable[Place]) -> tuple[float, float]:
        """The partial correlation of x with the one column of y and its p; of a node x of several columns the multiple one, which has no sign."""
        of_x, of_y = self.at(x), self.at(y)
        z = sorted({c for place in given for c in self.at(place)} - set(of_x) - set(of_y))
        own = of_x + of_y
        c = self.matrix[np.ix_(own, own)]
        if z:
            c = c - self.matrix[np.ix_(own, z)] @ np.linalg.lstsq(self.matrix[np.ix_(z, z)], self.matrix[np.ix_(z, own)], rcond=1e-10)[0]
        left = np.diag(c)
        spread = np.sqrt(np.where(left > 1e-9, left, np.inf))
        c = c / np.outer(spread, spread)
        r, q = c[:-1, -1], len(of_x)
        if q > 1:
            np.fill_diagonal(c, 1.0)
            r = [math.sqrt(max(0.0, float(r @ np.linalg.lstsq(c[:-1, :-1], r, rcond=1e-10)[0])))]
        best = float(np.clip(r[0], -1, 1))
        return best, correlation_p(best, self.n - 1 - q - len(z), q)


def lagged_parents(test: Tests, target: int, sources: Sequence[int], tau_max: int, alpha: float, always: Sequence[Place] = ()) -> list[tuple[Place, float]]:
    """Lagged links into the target with their strengths (least |partial correlation| of all tests), strongest first.

    Each level tests every candidate left given the `level` strongest others; what is independent goes at the end of the level.
    """
    left = {(a, k): math.inf for a in sources for k in range(1, tau_max + 1)}
    order = sorted(left)
    level = 0
    while len(order) > level:
        gone = []
        for place in order:
            given = [p for p in order if p != place][:level]
            r, p = test(place, (target, 0), [*given, *always])
            left[place] = min(left[place], abs(r))
            if p > alpha:
                gone.append(place)
        order = sorted((p for p in order if p not in gone), key=lambda p: (-left[p], p))
        level += 1
    return [(p, left[p]) for p in order]


@dataclass
class Links:
    """A skeleton: parents[j] are the lagged parents of j (fixed conditions), lagged[j] and now[j] what is still linked to j, with strengths."""

    parents: dict[int, list[Place]]
    lagged: dict[int, dict[Place, float]]
    now: dict[int, dict[int, float]]

    def neighbours(self, j: int, but: int | None = None) -> list[int]:
        return sorted((a for a in self.now.get(j, {}) if a != but), key=lambda a: (-self.now[j][a], a))

    def base(self, x: Place, j: int) -> list[Place]:
        """Conditions of every momentary test of x and j: the parents of both, those of x as long ago as x is."""
        a, lag = x
        return [p for p in self.parents.get(j, []) if p != x] + [(b, k + lag) for b, k in self.parents.get(a, [])]

    def linked(self, x: Place, j: int) -> bool:
        return x in self.lagged.get(j, {}) if x[1] else x[0] in self.now.get(j, {})


def level_tests(test: Tests, links: Links, target: int, level: int, alpha: float) -> Iterator[tuple[Place, float, float, list[int] | None]]:
    """Momentary tests of all links into the target with `level` contemporaneous conditions: place, last r, its p, and the separating set, if any.

    Conditions are tried strongest first until one separates; links with fewer neighbours than `level` aren't tested any more.
    """
    for place in [*sorted(links.lagged.get(target, {})), *((a, 0) for a in sorted(links.now.get(target, {})))]:
        around = links.neighbours(target, place[0] if place[1] == 0 else None)
        if len(around) < level:
            continue
        found = None
        for chosen in combinations(around, level):
            r, p = test(place, (target, 0), [*((a, 0) for a in chosen), *links.base(place, target)])
            if found is None or abs(r) < abs(found[0]):
                found = (r, p)
            if p > alpha:
                yield place, r, p, list(chosen)
                break
        else:
            yield place, *found, None


Orientation = dict[tuple[int, int], str]


def _majority(test: Tests, links: Links, x: Place, k: int, j: int, alpha: float) -> str:
    """Whether k is a collider between x and j: in under half of all contemporaneous sets that separate them; no such set, or half: ambiguous."""
    tried, separating, holds = set(), 0, 0
    for end, other in ((j, x[0] if x[1] == 0 else None), *(((x[0], j),) if x[1] == 0 else ())):
        around = links.neighbours(end, other)
        for size in range(len(around) + 1):
            for chosen in combinations(sorted(around), size):
                if chosen in tried:
                    continue
                tried.add(chosen)
                if test(x, (j, 0), [*((a, 0) for a in chosen), *links.base(x, j)])[1] > alpha:
                    separating += 1
                    holds += k in chosen
    share = holds / separating if separating else 0.5
    return "collider" if share < 0.5 else "other" if share > 0.5 else "ambiguous"


def oriented(test: Tests, links: Links, separated: dict[tuple[Place, int], list[int]], alpha: float, rule: str = "majority") -> Orientation:
    """Marks of contemporaneous links among system nodes, both ways: (i, j) -> '-->', '<--', 'o-o' or, where rules contradict, 'x-x'.

    rule: majority (of separating sets) or none (the separating set that was found decides).
    """
    if rule not in ("majority", "none"):
        raise ValueError(f"unknown rule {rule!r}")
    system = set(test.system)
    mark: Orientation = {(i, j): "o-o" for j in system for i in links.now.get(j, {}) if i in system}
    triples = []
    for i, k in sorted(mark):
        for x in [*((a, lag) for a, lag in sorted(links.lagged.get(i, {})) if a in system), *((a, 0) for a in sorted(system) if (a, i) in mark)]:
            if x != (k, 0) and not links.linked(x, k):
                triples.append((x, i, k))  # x - i - k, where x and k aren't linked
    verdict = {}
    for x, k, j in triples:
        if rule == "none":
            held = separated.get((x, j)) if x[1] else separated.get((x, j), separated.get(((j, 0), x[0])))
            verdict[x, k, j] = "ambiguous" if held is None else "other" if k in held else "collider"
        else:
            verdict[x, k, j] = _majority(test, links, x, k, j, alpha)

    def point(arrows: set[tuple[int, int]]) -> None:
        for a, b in arrows:
            clash = (b, a) in arrows or mark[a, b] in ("<--", "x-x")
            mark[a, b], mark[b, a] = ("x-x", "x-x") if clash else ("-->", "<--")

    point({(j, k) for (x, k, j), v in verdict.items() if v == "collider"} | {(x[0], k) for (x, k, j), v in verdict.items() if v == "collider" and x[1] == 0})
    free = lambda a, b: mark.get((a, b)) == "o-o"
    into = lambda a, b: mark.get((a, b)) == "-->"
    while True:
        chain = {(k, j) for (x, k, j), v in verdict.items() if v == "other" and free(k, j) and (x[1] > 0 or into(x[0], k))}
        around = {(i, j) for i, j in mark if free(i, j) and any(into(i, k) and into(k, j) for k in system)}
        two = {
            (i, j) for i, j in mark if free(i, j)
            for k, m in combinations([k for k in sorted(system) if free(i, k) and into(k, j)], 2)
            if (k, m) not in mark and verdict.get(((k, 0), i, m)) == "other"
        }
        arrows = {(a, b) for a, b in chain | around | two if free(a, b)}
        if not arrows:
            return mark
        point(arrows)
