import numpy as np
import pytest

from brightloom.llm import percentiles
from brightloom.llm.percentiles import bisect_percentiles, measured, percentiles_of_counts, rank_counts

P = [0.0, 0.5, 0.9, 0.99, 1.0]


def expected(values):
    out = {}
    for g, x in values:
        if x is not None and x == x:
            out.setdefault(g, []).append(x)
    return {g: np.percentile(v, [p * 100 for p in P]) for g, v in out.items()}


def got(spark, values, **kw):
    df = spark.createDataFrame(values, "g string, v double").selectExpr("g", "v", "1 as __g0", "2 as __x")
    out = {}
    for r in bisect_percentiles(df, ["g"], "v", P, **kw).collect():
        out.setdefault(r["g"], {})[r["probability"]] = r["percentile"]
    return {g: [d[p] for p in P] for g, d in out.items()}


@pytest.mark.parametrize("kw", [{}, {"cuts": 4, "small": 1}, {"cuts": 2, "small": 3}])
def test_equals_brute_force(spark, kw):
    rng = np.random.default_rng(3)
    values = [("hot", float(x)) for x in rng.lognormal(3, 2, 900)] + [("ties", float(x)) for x in rng.integers(0, 4, 300)]
    values += [("one", 5.0), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, -3.0), ("hot", None), ("hot", float("nan")), ("none", None), ("out", 1e-9), ("out", 6e6)]
    e, g = expected(values), got(spark, values, **kw)
    assert e.keys() == g.keys()
    for k in e:
        assert np.allclose(e[k], g[k], rtol=1e-12), k


def test_empty(spark):
    assert got(spark, []) == {}


def test_measured(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (3, -1.0), (4, None), (None, 5.0), (5, float("inf")), (6, 3.0)], "id int, v double")
    assert sorted(r["id"] for r in measured(df, "id", "v").collect()) == [1, 6]


def test_counts_combine_within_the_error(spark):
    rng = np.random.default_rng(5)
    x = rng.lognormal(4, 1.5, 3000)
    df = spark.createDataFrame([("a", i % 5, float(v)) for i, v in enumerate(x)], "g string, day int, v double")
    days = [rank_counts(df.where(f"day = {d}"), ["g", "day"], "v", 0.01) for d in range(5)]
    both = days[0]
    for d in days[1:]:
        both = both.unionByName(d)
    for r in percentiles_of_counts(both, ["g"], [0.1, 0.5, 0.99], 0.01).collect():
        true = np.sort(x)[int(np.ceil(r["probability"] * len(x))) - 1]
        assert abs(r["percentile"] / true - 1) <= 0.0101 and r["n_values"] == len(x)


def test_extreme_and_infinite_values(spark):
    rng = np.random.default_rng(8)
    values = [("wide", float(s * 10.0**e)) for s, e in zip(rng.choice([-1, 1], 500), rng.uniform(-300, 307, 500))] + [("wide", v) for v in (0.0, 5e-324, 1.7e308, -1.7e308)]
    values += [("near", 1.0 + k * 2.0**-52) for k in range(200)] + [("inf", float("inf")), ("inf", float("-inf")), ("inf", 3.0), ("all", float("inf"))]
    e, g = expected([(k, v) for k, v in values if abs(v) < float("inf")]), got(spark, values, small=1)
    assert e.keys() == g.keys() and all(np.allclose(e[k], g[k], rtol=1e-12) for k in e)


def test_interval_tables_beyond_the_bound_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = [("hot" if i % 3 else None if i % 7 == 0 else f"g{i % 11}", float(x)) for i, x in enumerate(rng.lognormal(3, 2, 1500))]
    want = got(spark, values, small=1)
    monkeypatch.setattr(percentiles, "BROADCAST_ROWS", 0)
    assert got(spark, values, small=1) == want


def test_open_ranks_are_an_error(spark):
    with pytest.raises(RuntimeError):
        got(spark, [("a", float(i)) for i in range(500)], cuts=2, small=1, passes=2)
