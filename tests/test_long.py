"""The window form of the detectors against the block form of the same cube."""

from __future__ import annotations

import random

import pytest

from cubewash.operators import detect as dt
from cubewash.operators import long as lg
from cubewash.sources.cube import wide_to_long
from tests.conftest import row_frame


@pytest.mark.parametrize("width", [1, 2, 9, 60])
def test_long_detections_equal_those_of_the_cube(spark, width):
    rng = random.Random(width)
    cells = [None, 0.0, 0.0, float("nan"), float("inf"), 1e9]
    values = [[rng.choice([*cells, float(rng.randint(-300, 400)), rng.random()]) if k % 3 else float(rng.randint(-9, 30))
               for _ in range(width)] for k in range(25)]
    df, roles = row_frame(spark, values)
    places = {m: i for i, m in enumerate(roles.measure_columns)}
    long = wide_to_long(df, ["id"], roles.measure_columns)
    long = long.join(spark.createDataFrame(list(places.items()), "period string, pos int"), "period")
    keep = ["detection_id", "pos", "column", "value", "flagged_by", "suggested_fix", "alternative_fixes"]
    pick = lambda d: sorted(str(tuple(r)) for r in d.select(*keep).collect())
    want = pick(dt.detect(df, roles))
    assert pick(lg.detect_long(long, ["id"])) == want and (want or width == 1)


def test_cells_without_a_fact_are_filled_or_missing(spark):
    facts = spark.createDataFrame([("a", "p1", 4.0), ("a", "p3", -4.0), (None, "p2", 1.0)],
                                  "id string, period string, value double")
    cells = lg.fill_periods(facts, ["id"], "period", "value", ["p1", "p2", "p3"])
    assert sorted((str(r["id"]), r["pos"], r["period"], r["value"]) for r in cells.collect()) == [
        ("None", 0, "p1", 0.0), ("None", 1, "p2", 1.0), ("None", 2, "p3", 0.0),
        ("a", 0, "p1", 4.0), ("a", 1, "p2", 0.0), ("a", 2, "p3", -4.0)]
    empty = lg.fill_periods(facts, ["id"], "period", "value", ["p1", "p2", "p3"], fill=None)
    assert empty.where("value IS NULL").count() == 3
    assert lg.detect_long(cells.where("false"), ["id"]).count() == 0
