"""Top share (A-08) against a sort, with ties, and its parts."""

from __future__ import annotations

import random

import pytest

from cubewash.operators import views as vw


def frame(spark, values):
    return spark.createDataFrame([(f"d{(i * 7919) % 100003:06d}", v) for i, v in enumerate(values)],
                                 "detection_id string, value double").repartition(5)


def expected(rows, divisor):
    k = max(1, len(rows) // divisor)
    return sorted(sorted(((-abs(r[1]), r[0]) for r in rows))[:k])


CASES = {
    "third tied": [50.0] * 400 + [float(i) for i in range(800)],
    "all tied": [-3.0] * 333,
    "all exponents": [random.Random(1).choice([-1, 1]) * 2.0 ** e for e in range(-1000, 1000, 3)],
    "neighbours": [1.0 + k * 2.0 ** -52 for k in range(600)],
    "zeros and infinities": [0.0] * 90 + [float("inf")] * 3 + [float("-inf")] * 4 + [5e-324, -1.7e308, 1.6e308],
    "one": [4.0],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("divisor", [20, 3])
def test_top_share_equals_a_sort(spark, name, divisor):
    df = frame(spark, CASES[name])
    rows = [tuple(r) for r in df.collect()]
    got = sorted((-abs(r["value"]), r["detection_id"]) for r in vw.top_share(df, divisor).collect())
    assert got == expected(rows, divisor)


def test_top_share_of_nothing(spark):
    assert vw.top_share(frame(spark, [1.0]).where("false")).count() == 0


def test_cut_takes_few_passes(spark, monkeypatch):
    rng = random.Random(3)
    sizes = spark.createDataFrame([(rng.random() * 10.0 ** rng.randint(-300, 300),) for _ in range(3000)], "size double")
    ordered = sorted((r[0] for r in sizes.collect()), reverse=True)
    for k in (1, 2, 1500, 3000):
        value, above = vw.radix_cut(sizes, k)
        assert value == ordered[k - 1] and above == sum(x > value for x in ordered)
    assert vw.radix_cut(sizes, 3001) is None
