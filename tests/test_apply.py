"""Apply + audit (APP / AUD ids and the reference's apply cases)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cubewash.model import InvalidSelectionError
from cubewash.operators import apply as ap
from cubewash.operators import detect as dt
from cubewash.operators import policy as pol
from tests.conftest import row_frame


def _run(spark, values, selections_fn, names=None):
    df, roles = row_frame(spark, values)
    if names:
        df = df.toDF("id", *names)
        from cubewash.model import ColumnRoles
        roles = ColumnRoles(["id"], names, names)
    d = dt.detect(df, roles)
    sel = selections_fn(d)
    applied = ap.apply_selections(df, roles, d, sel)
    cleaned = [list(r)[1:] for r in ap.cleaned_cube(applied, roles).orderBy("id").collect()]
    log = (ap.changes(applied, roles).orderBy("pass", "ord", "step")
           .select("column", "anomaly_type", "change_kind", "value_before", "value_after",
                   "flagged", "change_id", "parent_change_id").collect())
    return cleaned, log


def _stage(kind, fix=None, attribution=None):
    def fn(d):
        s = d.where(F.array_contains("flagged_by", kind))
        return s.select("detection_id",
                        F.lit(fix).alias("fix") if fix else F.col("suggested_fix").alias("fix"),
                        F.lit(attribution).cast("string").alias("attribution"),
                        F.col("pos").cast("bigint").alias("sel_ord"))
    return fn


def test_refund_cascade_two_periods(spark):
    cleaned, log = _run(spark, [[600, 700, -1200, 50]], _stage("refund"))
    assert cleaned == [[100.0, 0.0, 0.0, 50.0]]
    assert [e["column"] for e in log] == ["m3", "m2", "m1"]
    assert [e["change_kind"] for e in log] == ["primary", "refund_cascade", "refund_cascade"]
    assert all(e["anomaly_type"] == "refund" for e in log)
    assert log[1]["parent_change_id"] == log[0]["change_id"] == log[2]["parent_change_id"]


def test_refund_paired(spark):
    cleaned, log = _run(spark, [[200, -200, 50]], _stage("refund"))
    assert cleaned == [[0.0, 0.0, 50.0]]
    assert [e["column"] for e in log] == ["m2", "m1"]


def test_refund_partial(spark):
    cleaned, _ = _run(spark, [[10000, -8900, 50]], _stage("refund"))
    assert cleaned == [[1100.0, 0.0, 50.0]]


def test_refund_skips_zeros(spark):
    cleaned, log = _run(spark, [[10000, 0, 0, 550, -8900]], _stage("refund"))
    assert cleaned == [[1650.0, 0.0, 0.0, 0.0, 0.0]]
    assert [e["column"] for e in log] == ["m5", "m4", "m1"]


def test_split_even(spark):
    names = ["2022_1", "2022_2", "2022_3", "2022_4"]
    cleaned, log = _run(spark, [[100, 10000, 0, 100]], _stage("double_booking"), names)
    assert cleaned == [[100.0, 5000.0, 5000.0, 100.0]]
    assert [e["column"] for e in log] == ["2022_2", "2022_3"]
    assert [(e["value_before"], e["value_after"]) for e in log] == [(10000.0, 5000.0),
                                                                     (0.0, 5000.0)]


def test_split_odd_spike_keeps_larger_half(spark):
    cleaned, log = _run(spark, [[10, 101, 0, 10]], _stage("double_booking"))
    assert cleaned == [[10.0, 51.0, 50.0, 10.0]]


def test_split_backwards_partner(spark):
    cleaned, log = _run(spark, [[10, 10, 0, 101]], _stage("double_booking"))
    assert cleaned == [[10.0, 10.0, 50.0, 51.0]]
    assert [e["column"] for e in log] == ["m3", "m4"]  # earlier column first


def test_explicit_attribution_outlier(spark):
    row = [120, 110, 95, 130, 105, 140, 100, 115, 125, 110, 120, -800]
    cleaned, log = _run(spark, [row], _stage("outlier", "set_to_zero", "outlier"))
    assert cleaned[0][-1] == 0.0
    assert [(e["column"], e["anomaly_type"], e["change_kind"]) for e in log] == [
        ("m12", "outlier", "primary")]


def test_keep_as_is_entry(spark):
    row = [100, 105, 110, 95, 100, 5000, 105, 100, 110, 95, 100, 105]
    cleaned, log = _run(spark, [row], _stage("outlier"))
    assert cleaned == [[float(x) for x in row]]
    assert len(log) == 1 and log[0]["flagged"] is True
    assert log[0]["value_before"] == log[0]["value_after"] == 5000.0


def test_no_selections_identical(spark):
    df, roles = row_frame(spark, [[1, -2, 3], [4, 5, 6]])
    d = dt.detect(df, roles)
    sel = d.limit(0).select("detection_id", F.lit("set_to_zero").alias("fix"))
    applied = ap.apply_selections(df, roles, d, sel)
    assert ap.cleaned_cube(applied, roles).orderBy("id").collect() == df.orderBy("id").collect()
    assert ap.changes(applied, roles).count() == 0
    assert [r["n"] for r in ap.summary(ap.changes(applied, roles)).collect()] == [0, 0, 0, 0]


def test_unknown_detection_rejected(spark):
    df, roles = row_frame(spark, [[1, -2, 3]])
    d = dt.detect(df, roles)
    sel = spark.createDataFrame([("d_nope", "set_to_zero")], "detection_id string, fix string")
    with pytest.raises(InvalidSelectionError, match="Unknown detection_id"):
        ap.apply_selections(df, roles, d, sel)


def test_fix_not_allowed_rejected(spark):
    df, roles = row_frame(spark, [[1, -2, 3]])
    d = dt.detect(df, roles)
    sel = d.select("detection_id", F.lit("split_evenly").alias("fix"))
    with pytest.raises(InvalidSelectionError, match="not allowed"):
        ap.apply_selections(df, roles, d, sel)


def test_conflicting_duplicates_rejected(spark):
    row = [120, 110, 95, 130, 105, 140, 100, 115, 125, 110, 120, -800]
    df, roles = row_frame(spark, [row])
    d = dt.detect(df, roles)
    one = d.where(F.col("column") == "m12")
    sel = one.select("detection_id", F.lit("set_to_zero").alias("fix")).unionByName(
        one.select("detection_id", F.lit("keep_as_is").alias("fix")))
    with pytest.raises(InvalidSelectionError, match="Conflicting"):
        ap.apply_selections(df, roles, d, sel)


def test_policy_path_equals_selection_path(spark):
    rows = [[600, 700, -1200, 50, 0, 9000, 0, 30], [10, 101, 0, 10, -5, 3, 2, 1],
            [0, 0, 0, 0, 100, 0, 0, 0]]
    df, roles = row_frame(spark, rows)
    d = dt.detect(df, roles)
    sel = pol.stage_all(d, roles.measure_columns)
    a1 = ap.cleaned_cube(ap.apply_selections(df, roles, d, sel), roles).orderBy("id").collect()
    a2 = ap.cleaned_cube(ap.apply_policy(df, roles), roles).orderBy("id").collect()
    assert a1 == a2
    c1 = ap.changes(ap.apply_selections(df, roles, d, sel), roles)
    c2 = ap.changes(ap.apply_policy(df, roles), roles)
    cols = ["column", "anomaly_type", "change_kind", "value_before", "value_after"]
    assert sorted(c1.select(cols).collect()) == sorted(c2.select(cols).collect())


def test_aud_unique_change_ids_and_summary(spark):
    rows = [[120, 110, 95, 130, 105, 140, 100, 115, 125, 110, 120, -800],
            [100, 100, 10000, 0, 100, 100, 100, 100, 100, 100, 100, 100]]
    df, roles = row_frame(spark, rows)
    applied = ap.apply_policy(df, roles)
    ch = ap.changes(applied, roles)
    ids = [r["change_id"] for r in ch.collect()]
    assert len(ids) == len(set(ids))
    summ = {r["anomaly_type"]: r["n"] for r in ap.summary(ch).collect()}
    assert summ["double_booking"] == 2  # a split writes two entries
    assert sum(summ.values()) == len(ids)


def test_top_share_exact_path_matches_brute_force(spark):
    from cubewash.operators import views as vw

    rows = [[float((k * 37 + i * 11) % 97 - 40) for i in range(8)] for k in range(60)]
    df, roles = row_frame(spark, rows)
    d = dt.detect(df, roles)
    fast = {r["detection_id"] for r in vw.top_share(d, divisor=3).collect()}
    exact = {r["detection_id"] for r in vw.top_share(d, divisor=3, max_driver_rows=0).collect()}
    assert fast == exact and len(fast) == max(1, d.count() // 3)


def test_what_if_lists_changed_cells_only(spark):
    df, roles = row_frame(spark, [[600, 700, -1200, 50], [5, 5, 5, 5]])
    view = ap.what_if(ap.apply_policy(df, roles), roles).orderBy("column").collect()
    assert [(r["row_key"]["id"], r["column"], r["value_before"], r["value_after"]) for r in view] == [
        ("r0", "m1", 600.0, 100.0), ("r0", "m2", 700.0, 0.0), ("r0", "m3", -1200.0, 0.0)]


def test_what_if_without_measures_is_empty(spark):
    from cubewash.model import ColumnRoles

    df, roles = spark.createDataFrame([("a",)], "id string"), ColumnRoles(["id"], [], [])
    assert ap.what_if(ap.apply_policy(df, roles), roles).collect() == []
