"""Quantiles by selection: equal to sorting, one group with 90 % of the rows, repeated and extreme values, and what a task may hold."""

import math
import random

import pytest

from evigrid.operators import quantiles

AT = {"least": 0.0, "p02": 0.02, "p10": 0.1, "median": 0.5, "p90": 0.9, "most": 1.0}


def wanted(values, p):
    v = sorted(values)
    pos = p * (len(v) - 1)
    low = math.floor(pos)
    return v[low] + (v[math.ceil(pos)] - v[low]) * (pos - low)


def rows():
    rnd = random.Random(5)
    out = [("hot", rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 3)), 10.0 ** rnd.randint(-300, 300)])) for _ in range(9000)]
    out += [("ties", 4.0)] * 600 + [("ties", float(i)) for i in range(20)] + [(None, float(i)) for i in range(150)] + [("one", 1.5)] + [("two", 1.0), ("two", 2.0)]
    return out + [("nothing", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", -3.0), ("odd", None)]


@pytest.mark.parametrize("limit", [quantiles.LIMIT, 40])
def test_quantiles_equal_sorting(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "EDGES", 20)  # several passes
    monkeypatch.setattr(quantiles, "ACCURACY", 50)  # and edges that are only about right
    table = spark.createDataFrame(rows(), "zone string, price double").repartition(5)
    got = {r.zone: tuple(r)[1:] for r in quantiles.quantiles(table, "zone", "price", AT, limit).collect()}
    by = {}
    for zone, v in rows():
        by.setdefault(zone, []).extend([v] if v is not None and math.isfinite(v) else [])
    assert set(got) == set(by)
    for zone, values in by.items():
        want = tuple(wanted(values, p) if values else None for p in AT.values())
        assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[zone], want)), zone
    assert quantiles.quantiles(table.limit(0), "zone", "price", AT).count() == 0


def test_what_is_left_is_bounded(spark):
    """One zone of 60,000 values: after one pass no target has more than a few hundredths of them left."""
    table = spark.range(60_000).selectExpr("'z' AS g", "CAST((id * 7919) % 60000 AS DOUBLE) AS v")
    targets = spark.createDataFrame([("z", k, None, None, 0) for k in (0, 6000, 30_000, 59_999)], "g string, k long, low double, high double, below long")
    after = quantiles._narrowed(table, targets).collect()
    assert len(after) == 4 and all(r.value is not None or 0 <= r.left <= 2000 for r in after)
    statistics = quantiles.order_statistics(table, targets.selectExpr("g", "k", "60000L AS n"), 1000).collect()
    assert sorted((r.k, r.value) for r in statistics) == [(k, float(k)) for k in (0, 6000, 30_000, 59_999)]
