"""Exact quantiles against numpy, on distributions that are hard to narrow."""

import numpy as np
import pytest

from seqlake.operators import quantiles as qt
from seqlake.operators.quantiles import quantiles, rank_values

rng = np.random.default_rng(5)
PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
SETS = {
    "normal": rng.standard_normal(40_000), "two values": np.repeat([1.0, 2.0], [30_001, 9_999]),
    "a third alike": np.concatenate((np.full(13_000, 0.5), rng.random(27_000))), "steps": rng.integers(0, 50, 40_000) / 7,
    "wide": 10.0 ** rng.uniform(-300, 300, 40_000) * rng.choice([-1, 1], 40_000), "few": np.array([3.0, 1.0]), "one": np.array([4.0]),
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("keep,accuracy", [(5_000, 10_000), (40, 100)])
def test_equals_numpy(spark, monkeypatch, name, keep, accuracy):
    monkeypatch.setattr(qt, "KEEP", keep)
    monkeypatch.setattr(qt, "ACCURACY", accuracy)
    x = SETS[name]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "v double").repartition(4)
    got = quantiles(df, ["v"], PROBS)[0]
    want = np.sort(x)
    for p, g in zip(PROBS, got):
        h = p * (len(x) - 1)
        lo, hi = want[int(np.floor(h))], want[int(np.ceil(h))]
        assert g == lo + (hi - lo) * (h - np.floor(h))


def test_several_columns_and_empty(spark):
    df = spark.range(2000).selectExpr("id", "cast(null as double) as none", "case when id % 2 = 0 then id end as even")
    ids, none, even = quantiles(df, ["id", "none", "even"], [0.5, 0.95])
    assert ids == [999.5, 1999 * 0.95] and none is None and even == [999.0, 999.0 * 0.95 * 2]
    assert quantiles(df.where("id < 0"), ["id"], [0.5]) == [None]
    assert rank_values(df, ["id"], [[0, 7]], [2000]) == [{0: 0.0, 7: 7.0}]


def test_a_wrong_sketch_costs_a_pass_only(spark, monkeypatch):
    df = spark.range(9000).selectExpr("cast(id as double) as v")
    monkeypatch.setattr(qt, "KEEP", 50)
    real = qt._Bracket.around
    calls = []

    def off(self):
        calls.append(1)
        lo, hi = real(self)
        return (lo, hi) if len(calls) > 2 else (0.9, 0.95)

    monkeypatch.setattr(qt._Bracket, "around", off)
    assert quantiles(df, ["v"], [0.5])[0] == [4499.5]
