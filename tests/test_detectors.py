"""Detectors and their merge: rules over blocks against plain Python, and cubes through Spark."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubewash.functions import blocks
from cubewash.model import ColumnRoles
from cubewash.operators import detect as dt
from tests.conftest import flagged, row_frame

CELL = st.one_of(st.none(), st.integers(-30, 30), st.just(0), st.floats(-1e6, 1e6, width=32),
                 st.sampled_from([1e-9, -1e-9, 1e15, -1e15]))
BLOCK = st.integers(1, 9).flatmap(lambda n: st.lists(st.lists(CELL, min_size=n, max_size=n), min_size=1, max_size=6))


def matrix(rows) -> np.ndarray:
    return np.array([[math.nan if x is None else float(x) for x in r] for r in rows])


# --- the rules, one row and one cell at a time -------------------------------------------

def plain_negative(row):
    return [x is not None and x < 0 for x in row]


def plain_refund(row):
    out, before = [], 0.0
    for x in row:
        out.append(x is not None and x < 0 and before >= -x)
        before += x if x is not None and x > 0 else 0.0
    return out


def plain_double_booking(row):
    positive = [x for x in row if x is not None and x > 0]
    total = 0.0
    for x in positive:
        total += x
    mean = total / len(positive) if positive else 0.0
    zero = [x == 0 for x in row]
    return [x is not None and x > 0 and x > 2 * mean
            and ((i > 0 and zero[i - 1]) or (i + 1 < len(row) and zero[i + 1])) for i, x in enumerate(row)]


def plain_outlier(row):
    there = np.array([x for x in row if x is not None], float)
    if not len(there):
        return [False] * len(row)
    q1, q3 = np.percentile(there, [25, 75])
    return [x is not None and not q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1) for x in row]


PLAIN = {"negative": plain_negative, "refund": plain_refund, "double_booking": plain_double_booking,
         "outlier": plain_outlier}


@pytest.mark.parametrize("detector", dt.DEFAULT_DETECTORS, ids=lambda d: d.name)
@settings(max_examples=150, deadline=None)
@given(rows=BLOCK)
def test_rules_equal_plain_python(detector, rows):
    rows = [[None if x is None else float(x) for x in r] for r in rows]
    with np.errstate(all="ignore"):
        got = detector.mask(matrix(rows))
    assert got.tolist() == [PLAIN[detector.name](r) for r in rows]


@settings(max_examples=60, deadline=None)
@given(rows=BLOCK)
def test_bits_hold_every_detector_and_its_least_width(rows):
    rows = [[None if x is None else float(x) for x in r] for r in rows]
    bits = blocks.flag_bits(matrix(rows), dt.masks(dt.DEFAULT_DETECTORS))
    for k, d in enumerate(dt.DEFAULT_DETECTORS):
        want = [PLAIN[d.name](r) if len(r) >= d.min_measures else [False] * len(r) for r in rows]
        assert (bits >> k & 1).astype(bool).tolist() == want


def test_infinite_cells_flag_nothing_by_bounds_that_are_no_number():
    v = np.array([[math.inf, -math.inf, 1.0, 2.0, math.inf, -math.inf]])
    with np.errstate(all="ignore"):
        assert not blocks.outliers(v)[0, 2:4].any()
        assert blocks.negatives(v)[0].tolist() == [False, True, False, False, False, True]


# --- through Spark ---------------------------------------------------------------------------

ROWS = [[7, None, -7, 0, 40, 3, 2], [None] * 7, [0] * 7, [-1, 90, 0, -2, 4, 4, 4], [5, 5, 5, 5, 5, -500, 5]]


@pytest.mark.parametrize("detector", dt.DEFAULT_DETECTORS, ids=lambda d: d.name)
def test_a_cube_gets_the_flags_of_its_rows(spark, detector):
    want = [(f"r{k}", f"m{i + 1}") for k, row in enumerate(ROWS)
            for i, hit in enumerate(PLAIN[detector.name](row)) if hit]
    assert flagged(spark, ROWS, detector) == sorted(want)


def test_missing_and_not_a_number_are_one_and_numbers_in_ids_are_no_cells(spark):
    df = spark.createDataFrame([(-3, float("nan"), -8.0, 9.0), (-4, None, 9.0, -8.0)],
                               "code int, m1 double, m2 double, m3 double")
    roles = ColumnRoles(["code"], ["m1", "m2", "m3"], ["m1", "m2", "m3"])
    got = {(r["row_key"]["code"], r["column"], tuple(r["flagged_by"])) for r in dt.detect(df, roles).collect()}
    assert got == {(-3, "m2", ("negative",)), (-4, "m3", ("negative", "refund"))}


def test_no_measures_no_detections(spark):
    df = spark.createDataFrame([("a",)], "id string")
    none = dt.detect(df, ColumnRoles(["id"], [], []))
    assert none.count() == 0 and {"column", "value", "flagged_by"} <= set(none.columns)


def at_least(limit: float) -> dt.Detector:
    return dt.Detector("large", "keep_as_is", ("set_to_zero",), lambda v: v >= limit)


@pytest.mark.parametrize("width", [8, 80, 400])
def test_a_detector_of_the_users_works_at_any_width(spark, width, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 1000)
    values = [[float((i * 7 + k) % 50) - 3 for i in range(width)] for k in range(6)]
    df, roles = row_frame(spark, values)
    detectors = (*dt.DEFAULT_DETECTORS, at_least(45.0))
    got = {(r["row_key"]["id"], r["column"]): r for r in dt.detect(df, roles, detectors).collect()}
    for k, row in enumerate(values):
        for i, x in enumerate(row):
            names = [n for n, rule in PLAIN.items() if rule(row)[i]] + (["large"] if x >= 45 else [])
            found = got.get((f"r{k}", f"m{i + 1}"))
            assert (found["flagged_by"] if found else []) == names
            assert found is None or found["value"] == x
    assert any(r["flagged_by"] == ["large"] and r["suggested_fix"] == "keep_as_is" for r in got.values())


def test_columns_that_look_internal_are_user_columns(spark):
    df = spark.createDataFrame([("a", -5.0, 5.0, 1.0)], "__s_lower string, __f_negative double, m2 double, __e double")
    roles = ColumnRoles(["__s_lower"], ["__f_negative", "m2", "__e"], ["__f_negative", "m2", "__e"])
    assert [r["column"] for r in dt.detect_one(df, roles, dt.NEGATIVES).collect()] == ["__f_negative"]


# --- merge (M-02..M-04) ------------------------------------------------------------------------

@pytest.mark.parametrize("names, fix, others", [
    (["outlier"], "keep_as_is", ["set_to_zero"]),
    (["double_booking", "outlier"], "split_evenly", ["set_to_zero", "keep_as_is"]),
    (["negative", "refund", "outlier"], "set_to_zero", ["keep_as_is"]),
    (["negative", "refund"], "set_to_zero", []), ([], None, [])])
def test_merge_takes_the_first_fix_by_priority(names, fix, others):
    merged = dt.merge_combo(names, dt.DEFAULT_DETECTORS)
    assert merged == {"flagged_by": names, "suggested_fix": fix, "alternative_fixes": others}


def test_detections_come_in_file_order_then_column_text(spark):
    df, roles = row_frame(spark, [[-1] * 11])
    assert [r["column"] for r in dt.ordered(dt.detect_one(df, roles, dt.NEGATIVES)).collect()] == sorted(
        f"m{i}" for i in range(1, 12))
    first, again = (sorted(r["detection_id"] for r in dt.detect(df, roles).collect()) for _ in range(2))
    assert first == again and len(set(first)) == len(first)
    assert all(r["confidence"] == 1.0 for r in dt.detect(df, roles).collect())
