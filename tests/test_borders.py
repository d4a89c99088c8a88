"""Rings thinned together: neighbours still meet, nothing crosses, shared arcs are one arc, odd rings."""

import math
import random
from collections import Counter

import pytest

from evigrid.operators import borders

KIND = "id long, ring array<struct<x:double,y:double>>"


def table(spark, rings):
    return spark.createDataFrame([(i, None if r is None else [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in rings], KIND).repartition(3)


def done(spark, rings, tolerance, cell=1.0):
    return {r.id: [(p.x, p.y) for p in r.ring] for r in borders.simplified_together(table(spark, rings), tolerance, cell).collect()}


def edges(ring):
    return [tuple(sorted(e)) for e in zip(ring, ring[1:])]


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def crossing(e, f):
    return turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def wavy(n, size, seed):
    """A grid of n x n rings whose common sides are random walks."""
    rnd = random.Random(seed)
    line = {}

    def side(a, b):
        if (a, b) not in line:
            steps = 12
            line[a, b] = [a] + [(a[0] + (b[0] - a[0]) * k / steps + rnd.uniform(-size, size), a[1] + (b[1] - a[1]) * k / steps + rnd.uniform(-size, size)) for k in range(1, steps)] + [b]
        return line[a, b]

    rings = []
    for r in range(n):
        for c in range(n):
            a, b, d, e = (c * 4.0, r * 4.0), (c * 4.0 + 4, r * 4.0), (c * 4.0 + 4, r * 4.0 + 4), (c * 4.0, r * 4.0 + 4)
            rings.append((r * n + c, side(a, b)[:-1] + side(b, d)[:-1] + side(e, d)[::-1][:-1] + side(a, e)[::-1]))
    return rings


@pytest.mark.parametrize("tolerance", [0.05, 0.3, 3.0])
def test_neighbours_still_meet(spark, tolerance):
    rings = wavy(4, 0.15, 1)
    got = done(spark, rings, tolerance)
    count = Counter(e for r in got.values() for e in edges(r))
    # Each inner side is had by two rings, and outer ones by one: the rings cover the same square without gaps.
    outer = [e for e, n in count.items() if n == 1]
    assert max(count.values()) == 2 and math.isclose(sum(area(r) for r in got.values()), area_of(outer), rel_tol=1e-9)
    every = list(count)
    assert not any(crossing(e, f) for i, e in enumerate(every) for f in every[:i])
    assert all(set(got[i]) <= set(r) and got[i][0] == got[i][-1] for i, r in rings)
    assert sum(map(len, got.values())) < sum(len(r) for _, r in rings)
    assert all(len(set(r)) >= 3 for r in got.values())


def area_of(outline):
    """The area within the outer sides, taken from them alone."""
    ahead = {}
    for a, b in outline:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, []).append(a)
    assert all(len(n) == 2 for n in ahead.values())
    at = before = min(ahead)
    ring = [at]
    while len(ring) == 1 or at != ring[0]:
        new = ahead[at][0] if ahead[at][0] != before or len(ring) == 1 else ahead[at][1]
        before, at = at, new
        ring.append(at)
    return area(ring)


def test_conflicts_are_refined(spark):
    """A ring that stands out of the bay of another: thinning the bay away would cross it."""
    bay = [(0, 0), (10, 0), (10, 10), (6, 10), (5, 6), (4, 10), (0, 10)]
    island = [(4.9, 9.0), (5.1, 9.0), (5.0, 10.5)]
    got = done(spark, [(1, bay), (2, island)], 4.5)
    assert not any(crossing(e, f) for e in edges(got[1]) for f in edges(got[2])) and (5.0, 6.0) in got[1]
    assert len(done(spark, [(1, bay)], 4.5)[1]) < len(got[1])
    # Two rings with one common side and a lens between common nodes keep an area each.
    lens = [(0, 0), (1, 0.1), (2, 0.1), (3, 0)], [(3, 0), (2, -0.1), (1, -0.1), (0, 0)]
    two = done(spark, [(1, lens[0] + lens[1][1:]), (2, lens[0] + [(3, 5), (0, 5)]), (3, lens[1] + [(0, -5), (3, -5)])], 0.5)
    assert all(area(r) > 0 for r in two.values()) and area(two[1]) > 0.1


def test_odd_rings(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    rings = [(1, None), (2, []), (3, [(0, 0), (1, 1), (0, 0)]), (4, square), (5, square[2:] + square[:2]), (6, square[::-1] + [square[-1]]), (7, [(9, 9), (9, 9), (11, 9), (11, 9), (11, 11)]), (4, square)]
    rows = borders.simplified_together(table(spark, rings), 0.1, 1.0).collect()
    got = Counter((r.id, frozenset(edges([(p.x, p.y) for p in r.ring]))) for r in rows)
    whole = frozenset(edges([*map(lambda p: (float(p[0]), float(p[1])), square), (0.0, 0.0)]))
    assert got == {(4, whole): 2, (5, whole): 1, (6, whole): 1, (7, frozenset(edges([(9.0, 9.0), (11.0, 9.0), (11.0, 11.0), (9.0, 9.0)]))): 1}
    assert borders.simplified_together(table(spark, rings).limit(0), 0.1, 1.0).count() == 0
