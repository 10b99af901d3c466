"""Registered queries over the driver tables (one per operator family).

Every query reads the whole tables through a cube built by Spark
(:mod:`cubewash.plans.cubes`), so its work grows with the data. Output columns
are named so that :mod:`cubewash.plans.oracle` produces the same names.
Money that was computed in double arithmetic is compared at cent precision
(``decimal(18,2)``) only where a sum's order would otherwise matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import q
from ..functions.periods import (
    MON_YY,
    YYYY_M,
    YYYY_MM,
    YYYYQN,
    date_period_index_col,
    period_index_col,
    period_label_col,
)
from ..model import DETECTORS, FILE_PATH, ROW_INDEX, ColumnRoles
from ..operators import apply as ap
from ..operators import detect as dt
from ..operators import long as lg
from ..operators import policy as pol
from ..operators import profile as pf
from ..operators import views as vw
from ..session import ensure_checkpoint_dir
from ..sinks import writers as wr
from ..sources.cube import read_cube
from . import cases, pipeline
from .cubes import (
    customer_brand_cube,
    nation_brand_cube,
    nation_brand_facts,
    nation_brand_month_cube,
    quarter_labels,
    ship_quarters,
    segment_month_cube,
    segment_month_facts,
    table,
)
from .store import CubeStore

MAIN_IDS = ["n_name", "p_brand"]
SEG_IDS = ["n_name", "c_mktsegment", "o_orderpriority"]
CUST_IDS = ["c_name", "p_brand"]


def main_roles() -> ColumnRoles:
    """Roles of the main cube over its default quarters."""
    return ColumnRoles(MAIN_IDS, quarter_labels(), quarter_labels())


def _roles_of(cube: DataFrame, ids: list[str]) -> ColumnRoles:
    """Every column that is no id is a period, so none is left out."""
    periods = [c for c in cube.columns if c not in ids]
    return ColumnRoles(ids, periods, periods)


def _main(spark: SparkSession, sf: str) -> DataFrame:
    return nation_brand_cube(spark, sf)


def _main_and_roles(spark: SparkSession, sf: str) -> tuple[DataFrame, ColumnRoles]:
    cube = _main(spark, sf)
    return cube, _roles_of(cube, MAIN_IDS)


def _key_cols(ids: list[str]) -> list:
    return [F.col(f"row_key.{c}").alias(c) for c in ids]


# --- P-05 -------------------------------------------------------------------

def cube_long(spark: SparkSession, sf: str) -> DataFrame:
    facts = nation_brand_facts(spark, sf)
    return facts.select("n_name", "p_brand", "period", F.col("v").cast("double").alias("value"))


def cube_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _main(spark, sf)


def cube_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """wide -> long (P-05 inverse) of the zero-filled cube."""
    from ..sources.cube import wide_to_long

    cube, roles = _main_and_roles(spark, sf)
    return wide_to_long(cube, MAIN_IDS, roles.measure_columns, period="period", value="value")


# --- D-01..D-05, M-* ------------------------------------------------------------

def _detect_one(detector: dt.Detector) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = dt.detect_one(*_main_and_roles(spark, sf), detector)
        return d.select(*_key_cols(MAIN_IDS), "column", "value")
    run.__name__ = f"detect_{detector.name}"
    return run


def _merged(d: DataFrame, ids: list[str]) -> DataFrame:
    return d.select(*_key_cols(ids), "column", "value",
                    F.array_join("flagged_by", ",").alias("flagged_by"), "suggested_fix",
                    F.array_join("alternative_fixes", ",").alias("alternative_fixes"))


def detections_merged(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(dt.detect(*_main_and_roles(spark, sf)), MAIN_IDS)


def detections_long(spark: SparkSession, sf: str) -> DataFrame:
    """D-01..D-05 on the long form of the main cube, which is never pivoted."""
    facts = nation_brand_facts(spark, sf).withColumnRenamed("v", "value")
    cells = lg.fill_periods(facts, MAIN_IDS, "period", "value", ship_quarters(spark, sf))
    return _merged(lg.detect_long(cells, MAIN_IDS), MAIN_IDS)


def detections_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Detections on the not-zero-filled monthly cube (NULL cells, 80 periods)."""
    cube = segment_month_cube(spark, sf)
    return _merged(dt.detect(cube, _roles_of(cube, SEG_IDS)), SEG_IDS)


def customer_detector_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-01 on the customer x brand cube, whose row count grows with the data."""
    cube = customer_brand_cube(spark, sf)
    return vw.detector_counts(dt.detect(cube, _roles_of(cube, CUST_IDS)))


# --- A-* ------------------------------------------------------------------------

def detector_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vw.detector_counts(dt.detect(*_main_and_roles(spark, sf)))


def magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return vw.totals(dt.detect(*_main_and_roles(spark, sf)))


def flagged_rows(spark: SparkSession, sf: str) -> DataFrame:
    flags = vw.row_flags(dt.flag_cells(*_main_and_roles(spark, sf)))
    return vw.flagged_rows(flags, "any").select(*_key_cols(MAIN_IDS), *DETECTORS)


def top5pct(spark: SparkSession, sf: str) -> DataFrame:
    d = dt.detect(*_main_and_roles(spark, sf)).select(
        *_key_cols(MAIN_IDS), "column", "value")
    return vw.top_share(d, 20, tie=["n_name", "p_brand", "column"])


def outlier_view(spark: SparkSession, sf: str) -> DataFrame:
    """A-07: detections filtered to a detector set."""
    d = vw.filter_types(dt.detect(*_main_and_roles(spark, sf)), ["outlier", "double_booking"])
    return _merged(d, MAIN_IDS)


# --- V-* ------------------------------------------------------------------------

def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = pf.column_profile(segment_month_cube(spark, sf))
    return p.select("column", "n_rows", "n_null",
                    (F.col("n_null") / F.col("n_rows") > 0.9).alias("mostly_null"))


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """V-12 with a two-column id override on the segment cube (not unique)."""
    return pf.duplicate_ids(segment_month_cube(spark, sf), ["n_name", "c_mktsegment"])


def all_zero_rows(spark: SparkSession, sf: str) -> DataFrame:
    """V-19 over all quarters of the customer x brand cube of returned lines."""
    labels = ship_quarters(spark, sf)
    return pf.all_zero_rows(customer_brand_cube(spark, sf, labels, returns_only=True), labels)


def period_gaps(spark: SparkSession, sf: str) -> DataFrame:
    facts = segment_month_facts(spark, sf).select(
        *SEG_IDS, period_index_col(F.col("period"), YYYY_M).alias("pidx"))
    gaps = pf.long_period_gaps(facts, SEG_IDS, "pidx")
    return gaps.select(*SEG_IDS, period_label_col(F.col("gap_index"), YYYY_M).alias("gap"))


def coercion_profile(spark: SparkSession, sf: str) -> DataFrame:
    """V-07 / V-21 value rules on the text columns of ``events``."""
    ev = table(spark, sf, "events").select(
        "event_type", "props", F.get_json_object("props", "$.k").alias("k_text"))
    p = pf.column_profile(ev)
    return p.select("column", "n_rows", "n_null", "n_lost",
                    (F.col("n_lost") == 0).alias("numeric"),
                    ((F.col("n_lost") > 0) & (F.col("n_lost") / F.col("n_rows") < 0.10))
                    .alias("coercible"))


def period_parse(spark: SparkSession, sf: str) -> DataFrame:
    """V-03/V-04 on the order months: label in each format -> index -> label."""
    months = (table(spark, sf, "orders")
              .select(date_period_index_col(F.col("o_orderdate"), YYYY_M).alias("m"),
                      date_period_index_col(F.col("o_orderdate"), YYYYQN).alias("qi"))
              .distinct())
    parts = []
    for fmt in (YYYY_M, YYYY_MM, MON_YY):
        lab = period_label_col(F.col("m"), fmt)
        parts.append(months.select(F.lit(fmt).alias("fmt"), lab.alias("label"),
                                   period_index_col(lab, fmt).cast("bigint").alias("period_index")))
    lab = period_label_col(F.col("qi"), YYYYQN)
    parts.append(months.select(F.lit(YYYYQN).alias("fmt"), lab.alias("label"),
                               period_index_col(lab, YYYYQN).cast("bigint").alias("period_index")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# --- G-*, X-* ---------------------------------------------------------------------

def default_policy(spark: SparkSession, sf: str) -> DataFrame:
    cube, roles = _main_and_roles(spark, sf)
    d = dt.detect(cube, roles)
    s = pol.stage_all(d, roles.measure_columns, ap.Policy())
    return s.join(d.select("detection_id", "row_key", "column"), "detection_id") \
        .select(*_key_cols(MAIN_IDS), "column", "fix", "attribution")


def selections_by_detector(spark: SparkSession, sf: str) -> DataFrame:
    cube, roles = _main_and_roles(spark, sf)
    d = dt.detect(cube, roles)
    s = pol.stage_all(d, roles.measure_columns, ap.Policy())
    return vw.selections_by_detector(s)


def _changes(spark: SparkSession, sf: str, policy: ap.Policy) -> DataFrame:
    cube, roles = _main_and_roles(spark, sf)
    applied = ap.apply_policy(cube, roles, policy)
    return ap.changes(applied, roles)


def _change_cols(ch: DataFrame) -> DataFrame:
    return ch.select(*_key_cols(MAIN_IDS), "column", "anomaly_type", "change_kind",
                     "value_before", "value_after", "suggested_fix", "flagged")


def apply_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _change_cols(_changes(spark, sf, ap.Policy(context="negative")))


def apply_split(spark: SparkSession, sf: str) -> DataFrame:
    return _change_cols(_changes(spark, sf, ap.Policy(context="double_booking")))


def apply_refund(spark: SparkSession, sf: str) -> DataFrame:
    return _change_cols(_changes(spark, sf, ap.Policy(context="refund")))


def cleaned_cube(spark: SparkSession, sf: str) -> DataFrame:
    cube, roles = _main_and_roles(spark, sf)
    return ap.cleaned_cube(ap.apply_policy(cube, roles, ap.Policy()), roles)


def audit_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _change_cols(_changes(spark, sf, ap.Policy()))


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ap.summary(_changes(spark, sf, ap.Policy()))


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """D10: per detector, entries and money moved (before - after), at cents."""
    ch = _changes(spark, sf, ap.Policy())
    cents = "decimal(18,2)"
    return ch.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("value_before").cast(cents)).cast("double").alias("sum_before"),
        F.sum(F.col("value_after").cast(cents)).cast("double").alias("sum_after"))


def selections_apply(spark: SparkSession, sf: str) -> DataFrame:
    """X-01..X-03 through the explicit-selection path: every outlier set to zero,
    credited to the outlier detector."""
    cube, roles = _main_and_roles(spark, sf)
    d = dt.detect(cube, roles)
    sel = d.where(F.array_contains("flagged_by", "outlier")).select(
        "detection_id", F.lit("set_to_zero").alias("fix"),
        F.lit("outlier").alias("attribution"), F.col("pos").cast("bigint").alias("sel_ord"))
    applied = ap.apply_selections(cube, roles, d, sel)
    return _change_cols(ap.changes(applied, roles))


def selections_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """X-01, X-09, G-04: every fix staged, kept cells unstaged again, rest applied last column first."""
    cube, roles = _main_and_roles(spark, sf)
    d = dt.detect(cube, roles)
    staged = d.select("detection_id", F.lit("stage").alias("op"), F.col("suggested_fix").alias("fix"),
                      F.lit(None).cast("string").alias("attribution"),
                      (-F.col("pos")).cast("bigint").alias("sel_ord"))
    unstaged = staged.where(F.col("fix") == "keep_as_is").withColumns(
        {"op": F.lit("unstage"), "sel_ord": F.lit(1).cast("bigint")})
    applied = ap.apply_selections(cube, roles, d, pol.latest_selections(staged.unionByName(unstaged)))
    return _change_cols(ap.changes(applied, roles))


def what_if(spark: SparkSession, sf: str) -> DataFrame:
    cube, roles = _main_and_roles(spark, sf)
    view = ap.what_if(ap.apply_policy(cube, roles), roles)
    return view.select(*_key_cols(MAIN_IDS), "column", "value_before", "value_after")


# --- cubes of more periods ----------------------------------------------------------

def _month(spark: SparkSession, sf: str) -> tuple[DataFrame, ColumnRoles]:
    cube = nation_brand_month_cube(spark, sf)
    return cube, _roles_of(cube, MAIN_IDS)


def wide_detections(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(dt.detect(*_month(spark, sf)), MAIN_IDS)


def wide_cleaned_cube(spark: SparkSession, sf: str) -> DataFrame:
    cube, roles = _month(spark, sf)
    return ap.cleaned_cube(ap.apply_policy(cube, roles), roles)


def wide_audit(spark: SparkSession, sf: str) -> DataFrame:
    cube, roles = _month(spark, sf)
    return _change_cols(ap.changes(ap.apply_policy(cube, roles), roles))


# --- findings, files, sinks -----------------------------------------------------------

def _findings(cube: DataFrame, ids: list[str], periods: list[str]) -> DataFrame:
    return pf.findings(cube, ColumnRoles(ids, periods, periods)).select("check_id", "severity", "column", "n")


def schema_findings_returns(spark: SparkSession, sf: str) -> DataFrame:
    """All checks on the customer x brand cube of returned lines (V-19 finds rows)."""
    labels = ship_quarters(spark, sf)
    # three jobs read the cube, which is built once
    _, path = _written(spark, customer_brand_cube(spark, sf, labels, returns_only=True))
    return _findings(spark.read.parquet(path), CUST_IDS, labels)


def schema_findings_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """All checks with too few id columns (V-12), which blocks the soft ones (V-13)."""
    cube = segment_month_cube(spark, sf)
    return _findings(cube, SEG_IDS[:2], [c for c in cube.columns if c not in SEG_IDS])


def _written(spark: SparkSession, cube: DataFrame) -> tuple[str, str]:
    """A folder of the run's own in the shared folder, and the cube's files in it."""
    folder = f"{ensure_checkpoint_dir(spark)}/cubewash-{uuid.uuid4().hex}"
    cube.write.parquet(f"{folder}/cube")
    return folder, f"{folder}/cube"


COERCED = "1997Q3"


def coerced_detections(spark: SparkSession, sf: str) -> DataFrame:
    """P-04: detections after a text period of the main cube was made numbers in a store, and
    whether the cell was detected by those stored before, which are not used any more."""
    cube = _main(spark, sf)
    text = F.when(F.col("n_name") == "NATION_7", F.lit("n/a")).otherwise(q(COERCED).cast("string"))
    folder, path = _written(spark, cube.withColumn(COERCED, text))
    store = CubeStore.create(spark, f"{folder}/store", path)
    before = _merged(store.detections(), MAIN_IDS)
    result = store.coerce(store.schema().coercible_columns)
    if store.state().detections is not None or COERCED not in result.roles.measure_columns:
        raise AssertionError("the new version still has what belonged to the old")
    after = _merged(store.detections(), MAIN_IDS)
    known = before.select(*MAIN_IDS, "column", F.lit(True).alias("known"))
    return after.join(known, [*MAIN_IDS, "column"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def selection_log(spark: SparkSession, sf: str) -> DataFrame:
    """G-04: changes after everything was staged and cleared, the negatives were staged in their
    own view, staged again with another order, and those of one period unstaged."""
    cube, roles = _main_and_roles(spark, sf)
    folder, path = _written(spark, cube)
    store = CubeStore.create(spark, f"{folder}/store", path)
    found = store.detections()
    store.stage(pol.stage_all(found, roles.measure_columns))
    store.clear()
    negatives = pol.stage_all(found, roles.measure_columns, ap.Policy(context="negative"))
    store.stage(negatives)
    store.stage(negatives.withColumn("sel_ord", -F.col("sel_ord")))
    store.unstage(found.where(F.col("column") == COERCED))
    applied = ap.apply_selections(store.read(), store.schema().roles, found, store.selections())
    return _change_cols(ap.changes(applied, roles))


def _cube_files(spark: SparkSession, sf: str) -> tuple[str, str, ColumnRoles]:
    """The main cube as several files in the shared folder: folder of the run, path, roles."""
    cube, roles = _main_and_roles(spark, sf)
    return *_written(spark, cube.repartition(4, *[q(c) for c in MAIN_IDS])), roles


def preview_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A-06: pages of 250 rows, each asked for with the place of the last row before it."""
    _, path, roles = _cube_files(spark, sf)
    pages, after = [], None
    while True:
        page = pipeline.preview(spark, path, roles, after=after, limit=250)
        last = page.orderBy(F.desc(FILE_PATH), F.desc(ROW_INDEX)).select(FILE_PATH, ROW_INDEX).first()
        if last is None:
            break
        pages.append(page.drop(FILE_PATH, ROW_INDEX))
        after = tuple(last)
    out = pages[0] if pages else page.drop(FILE_PATH, ROW_INDEX)
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def preview_flagged(spark: SparkSession, sf: str) -> DataFrame:
    """A-05: rows with a negative in a cube of several files, and their total."""
    _, path, roles = _cube_files(spark, sf)
    total = pipeline.preview_total(spark, path, roles, "negative")
    return pipeline.preview_rows(read_cube(spark, path), roles, "negative").select(
        *MAIN_IDS, F.lit(total).cast("bigint").alias("total"))


def _committed(spark: SparkSession, sf: str, name: str) -> str:
    """Folder of an artifact of the main cube after detect, apply and commit."""
    folder, path, roles = _cube_files(spark, sf)
    pipeline.clean_file(spark, path, f"{folder}/out", roles=roles)
    return wr.committed_artifact(spark, f"{folder}/out", name)


def roundtrip_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """S-01, S-04, S-07: the committed cleaned cube, read again."""
    return spark.read.parquet(_committed(spark, sf, "cleaned"))


def roundtrip_audit(spark: SparkSession, sf: str) -> DataFrame:
    """S-05, X-11: the committed audit log, read again, with the column of each parent entry."""
    log = spark.read.schema(
        "change_id string, anomaly_type string, change_kind string, "
        "row_key struct<n_name: string, p_brand: string>, column string, value_before double, "
        "value_after double, suggested_fix string, flagged boolean, parent_change_id string"
    ).json(f"{_committed(spark, sf, 'audit')}/changes")
    parents = log.select(F.col("change_id").alias("parent_change_id"), F.col("column").alias("parent_column"))
    joined = log.join(parents, "parent_change_id", "left")
    return joined.select(*_key_cols(MAIN_IDS), "column", "anomaly_type", "change_kind", "value_before",
                         "value_after", "suggested_fix", "flagged", "parent_column")


def run_summary_state(spark: SparkSession, sf: str) -> DataFrame:
    """S-06, S-08: state of a file after it was detected (table stored) and cleaned."""
    folder, path, roles = _cube_files(spark, sf)
    summary = f"{folder}/runs"
    found = pipeline.detect_file(spark, path, roles=roles, store=f"{folder}/detections", run_summary=summary)
    pipeline.clean_file(spark, path, f"{folder}/out", roles=found.roles, run_summary=summary)
    counts = F.from_json("anomaly_counts", ", ".join(f"{d} long" for d in DETECTORS))
    return wr.latest_run_summary(spark, summary).select(
        "status", "row_count", *[counts[d].alias(d) for d in DETECTORS], "applied_changes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cube_long": cube_long,
    "cube_wide": cube_wide,
    "cube_unpivot": cube_unpivot,
    "detect_negatives": _detect_one(dt.NEGATIVES),
    "detect_refunds": _detect_one(dt.REFUNDS),
    "detect_double_bookings": _detect_one(dt.DOUBLE_BOOKINGS),
    "detect_outliers": _detect_one(dt.OUTLIERS),
    "detections_merged": detections_merged,
    "detections_long": detections_long,
    "detections_nulls": detections_nulls,
    "detector_counts": detector_counts,
    "customer_detector_counts": customer_detector_counts,
    "magnitude": magnitude,
    "flagged_rows": flagged_rows,
    "top5pct": top5pct,
    "outlier_view": outlier_view,
    "null_profile": null_profile,
    "duplicate_ids": duplicate_ids,
    "all_zero_rows": all_zero_rows,
    "period_gaps": period_gaps,
    "coercion_profile": coercion_profile,
    "period_parse": period_parse,
    "default_policy": default_policy,
    "selections_by_detector": selections_by_detector,
    "apply_zero": apply_zero,
    "apply_split": apply_split,
    "apply_refund": apply_refund,
    "cleaned_cube": cleaned_cube,
    "audit_changes": audit_changes,
    "audit_summary": audit_summary,
    "reconcile": reconcile,
    "selections_apply": selections_apply,
    "selections_mixed": selections_mixed,
    "what_if": what_if,
    "wide_detections": wide_detections,
    "wide_cleaned_cube": wide_cleaned_cube,
    "wide_audit": wide_audit,
    "schema_findings_returns": schema_findings_returns,
    "schema_findings_duplicates": schema_findings_duplicates,
    "schema_findings_cases": cases.findings,
    "inferred_roles": cases.roles,
    "coerced_detections": coerced_detections,
    "selection_log": selection_log,
    "preview_pages": preview_pages,
    "preview_flagged": preview_flagged,
    "roundtrip_cleaned": roundtrip_cleaned,
    "roundtrip_audit": roundtrip_audit,
    "run_summary_state": run_summary_state,
}
