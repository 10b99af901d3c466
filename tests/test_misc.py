"""Coercion (P-04), generic merge of raw detections (M-01), selection log (G-04), preview (A-05/06)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from cubewash.model import ColumnRoles
from cubewash.operators import detect as dt
from cubewash.operators import policy as pol
from cubewash.plans import pipeline
from cubewash.sources.cube import coerce


def test_coerce_text_to_numbers(spark):
    df = spark.createDataFrame([("a", "12"), ("b", "not a number"), ("c", " 3.5 "), ("d", "1d")],
                               "c string, `2021_1` string")
    got = [r[0] for r in coerce(df, ["2021_1"]).orderBy("c").select("2021_1").collect()]
    assert got == [12.0, None, 3.5, None]  # '1d' is not a number for pandas either


def test_merge_raw_groups_by_cell(spark):
    from tests.conftest import row_frame

    df, roles = row_frame(spark, [[120, 110, 95, 130, 105, 140, 100, 115, 125, 110, 120, -800]])
    raw = None
    for det in dt.DEFAULT_DETECTORS:
        part = dt.detect_one(df, roles, det).select("__row_id", "row_key", "pos", "column",
                                                     "value", "detector")
        raw = part if raw is None else raw.unionByName(part)
    merged = dt.merge_raw(raw).collect()
    assert len(merged) == 1
    m = merged[0]
    assert m["flagged_by"] == ["negative", "refund", "outlier"]
    assert m["suggested_fix"] == "set_to_zero" and m["alternative_fixes"] == ["keep_as_is"]
    direct = dt.detect(df, roles).collect()[0]
    assert direct["detection_id"] == m["detection_id"]


def test_latest_selection_wins_and_unstage(spark):
    ev = spark.createDataFrame(
        [("d1", "set_to_zero", None, 1, "stage"), ("d1", "keep_as_is", "outlier", 2, "stage"),
         ("d2", "split_evenly", None, 3, "stage"), ("d2", None, None, 4, "unstage")],
        "detection_id string, fix string, attribution string, sel_ord long, op string")
    cur = {r["detection_id"]: r["fix"] for r in pol.latest_selections(ev).collect()}
    assert cur == {"d1": "keep_as_is"}
    left = pol.unstage(pol.latest_selections(ev), spark.createDataFrame([("d1",)], "detection_id string"))
    assert left.count() == 0


def test_preview_pages_flagged_rows_in_file_order(spark):
    d = tempfile.mkdtemp(prefix="cubewash-test-")
    rows = [(f"r{k}", 100.0, -5.0 if k % 3 == 0 else 5.0, 100.0) for k in range(10)]
    spark.createDataFrame(rows, "id string, m1 double, m2 double, m3 double") \
        .coalesce(1).write.parquet(f"{d}/c.parquet")
    roles = ColumnRoles(["id"], ["m1", "m2", "m3"], ["m1", "m2", "m3"])
    page1 = pipeline.preview(spark, f"{d}/c.parquet", roles, detected="negative", limit=2)
    ids = [r["id"] for r in page1.collect()]
    assert ids == ["r0", "r3"]
    last = page1.agg(F.max("__row_index")).first()[0]
    page2 = pipeline.preview(spark, f"{d}/c.parquet", roles, detected="negative", after=last)
    assert [r["id"] for r in page2.collect()] == ["r6", "r9"]


def test_saved_override_rechecks_file_order(spark):
    from cubewash.operators import profile as pf

    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)],
                               "c string, `2022_3` double, `2022_1` double, `2022_2` double")
    saved = ColumnRoles(["c"], ["2022_1", "2022_2", "2022_3"], ["2022_1", "2022_2", "2022_3"])
    res = pf.resolve_schema(df, saved)
    assert res.ok and res.roles.measure_columns == ["2022_1", "2022_2", "2022_3"]
    assert any("chronological" in w for w in res.soft_warnings)
    assert pf.resolve_schema(df, ColumnRoles()).roles.id_columns == ["c"]


def test_detection_table_version_mismatch_is_ignored(spark):
    from cubewash.sinks import writers as wr

    d = tempfile.mkdtemp(prefix="cubewash-test-")
    spark.createDataFrame([("d1", "v1")], "detection_id string, format_version string") \
        .write.parquet(f"{d}/old")
    assert wr.read_detections(spark, f"{d}/old") is None
    assert wr.read_detections(spark, f"{d}/missing") is None


def test_detect_and_policy_apply_plans_have_no_shuffle(spark):
    from cubewash.operators import apply as ap

    d = tempfile.mkdtemp(prefix="cubewash-test-")
    rows = [(f"r{k}", 100.0, -5.0 if k % 3 == 0 else 5.0, 0.0, 900.0) for k in range(10)]
    spark.createDataFrame(rows, "id string, m1 double, m2 double, m3 double, m4 double") \
        .write.parquet(f"{d}/c.parquet")
    df = spark.read.parquet(f"{d}/c.parquet")
    roles = ColumnRoles(["id"], ["m1", "m2", "m3", "m4"], ["m1", "m2", "m3", "m4"])
    for q in (dt.detect(df, roles), ap.changes(ap.apply_policy(df, roles), roles)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_user_columns_with_internal_looking_names_survive(spark):
    from cubewash.operators import apply as ap

    df = spark.createDataFrame([("a", "n1", -5.0, 5.0, 4.0), ("b", "n2", 1.0, 2.0, 3.0)],
                               "row_key string, __note string, m1 double, m2 double, m3 double")
    roles = ColumnRoles(["row_key"], ["m1", "m2", "m3"], ["m1", "m2", "m3"])
    cleaned = ap.cleaned_cube(ap.apply_policy(df, roles, ap.Policy()), roles)
    assert cleaned.columns == df.columns
    assert sorted(r["__note"] for r in cleaned.collect()) == ["n1", "n2"]


def test_reserved_column_is_refused(spark):
    from cubewash.model import ReservedNameError
    from cubewash.sources.cube import read_cube

    d = tempfile.mkdtemp(prefix="cubewash-test-")
    spark.createDataFrame([("a", 1.0)], "id string, __cells double").write.parquet(f"{d}/c.parquet")
    try:
        read_cube(spark, f"{d}/c.parquet")
    except ReservedNameError:
        return
    raise AssertionError("a reserved name was taken")


def test_pages_over_several_files_hold_every_row_once(spark):
    from cubewash.model import FILE_PATH, ROW_INDEX

    d = tempfile.mkdtemp(prefix="cubewash-test-")
    rows = [(f"r{k}", -1.0 if k == 0 else 1.0, 2.0, 3.0) for k in range(9)]
    spark.createDataFrame(rows, "id string, m1 double, m2 double, m3 double") \
        .repartition(3).write.parquet(f"{d}/c.parquet")
    roles = ColumnRoles(["id"], ["m1", "m2", "m3"], ["m1", "m2", "m3"])
    seen, after = [], None
    while True:
        got = pipeline.preview(spark, f"{d}/c.parquet", roles, after=after, limit=2).collect()
        if not got:
            break
        seen += [r["id"] for r in got]
        after = (got[-1][FILE_PATH], got[-1][ROW_INDEX])
    assert sorted(seen) == sorted(r[0] for r in rows) and len(seen) == 9
    flagged = pipeline.preview(spark, f"{d}/c.parquet", roles, detected="negative").collect()
    assert [r["id"] for r in flagged] == ["r0"]
    assert pipeline.preview_total(spark, f"{d}/c.parquet", roles) == 9
    assert pipeline.preview_total(spark, f"{d}/c.parquet", roles, "negative") == 1


def test_findings_are_data_and_no_measures_find_nothing(spark):
    from cubewash.operators import detect as dt
    from cubewash.operators import profile as pf

    df = spark.createDataFrame([("a", None, "x"), ("b", None, "y")], "id string, day date, `2021_1` string")
    found = {(r["check_id"], r["severity"]) for r in pf.findings(df).collect()}
    assert ("V-14", "soft") in found
    schema = pf.infer_schema(df)
    assert schema.roles.id_columns == ["id", "day"] and schema.roles.measure_columns == []
    none = dt.detect(df, schema.roles)
    assert none.count() == 0 and "flagged_by" in none.columns


def test_null_fix_is_refused_and_unlisted_period_is_an_error(spark):
    from cubewash.model import InvalidSelectionError
    from cubewash.operators import apply as ap
    from cubewash.operators import detect as dt
    from cubewash.sources.cube import long_to_wide

    df = spark.createDataFrame([("a", -5.0, 5.0, 4.0)], "id string, m1 double, m2 double, m3 double")
    roles = ColumnRoles(["id"], ["m1", "m2", "m3"], ["m1", "m2", "m3"])
    dets = dt.detect(df, roles)
    chosen = dets.limit(1).select("detection_id", F.lit(None).cast("string").alias("fix"))
    try:
        ap.validate_selections(dets, chosen)
        raise AssertionError("a missing fix was accepted")
    except InvalidSelectionError:
        pass
    facts = spark.createDataFrame([("a", "2021_1", 1.0), ("a", "2030_1", 1.0)], "id string, p string, v double")
    try:
        long_to_wide(facts, ["id"], "p", "v", ["2021_1"]).collect()
        raise AssertionError("a period was dropped")
    except Exception as exc:  # noqa: BLE001
        assert "2030_1" in str(exc)


def test_stored_detections_of_other_roles_are_not_used(spark):
    d = tempfile.mkdtemp(prefix="cubewash-test-")
    spark.createDataFrame([("a", 1.0, -2.0, -3.0)], "id string, `2021_1` double, `2021_2` double, `2021_3` double") \
        .coalesce(1).write.parquet(f"{d}/c.parquet")
    for other in ("2021_2", "2021_3"):
        roles = ColumnRoles(["id"], ["2021_1", other], ["2021_1", other])
        got = pipeline.detect_file(spark, f"{d}/c.parquet", roles=roles, store=f"{d}/store").detections
        assert {r["column"] for r in got.collect()} == {other}


def test_run_summary_merges_fields(spark):
    from cubewash.sinks import writers as wr

    path = tempfile.mkdtemp(prefix="cubewash-test-") + "/runs"
    wr.append_run_summary(spark, path, "f", status="detected", row_count=3, anomaly_counts={"negative": 1})
    wr.append_run_summary(spark, path, "f", status="cleaned", applied_changes=2)
    row = wr.latest_run_summary(spark, path).first()
    assert (row["status"], row["row_count"], row["applied_changes"]) == ("cleaned", 3, 2)
    assert row["anomaly_counts"] == '{"negative": 1}'


def test_commit_survives_a_leftover_folder(spark):
    from cubewash.sinks import writers as wr

    out = tempfile.mkdtemp(prefix="cubewash-test-")
    df = spark.createDataFrame([(1,)], "x int")
    changes = spark.createDataFrame([], "change_id string, anomaly_type string, change_kind string, "
                                    "row_key struct<id: string>, column string, value_before double, value_after double, "
                                    "suggested_fix string, flagged boolean, parent_change_id string")
    df.write.parquet(f"{out}/audit/old")
    wr.commit_apply(spark, out, df, changes, {"file_id": "f"})
    audit = wr.committed_artifact(spark, out, "audit")
    assert wr.read_audit_header(spark, audit) == {"file_id": "f"}
    assert spark.read.parquet(wr.committed_artifact(spark, out, "cleaned")).count() == 1
