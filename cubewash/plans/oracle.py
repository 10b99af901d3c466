"""DuckDB SQL oracles for :mod:`cubewash.plans.queries`.

Independent formulations over the same tables: the cube is a spine of id
tuples x period positions, detectors are list expressions per row (values in
period order), apply passes are recursive CTEs that replay refunds and splits
in selection order. Output column names equal the Spark queries'.
"""

from __future__ import annotations

from collections.abc import Callable

from .cubes import month_labels, quarter_labels

MONEY = "DECIMAL(18,2)"


def _labels_values(labels: list[str]) -> str:
    return ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(labels))


def _q_label(ts: str) -> str:
    return f"CAST(year({ts}) AS VARCHAR) || 'Q' || CAST(quarter({ts}) AS VARCHAR)"


def _m_label(ts: str) -> str:
    return f"CAST(year({ts}) AS VARCHAR) || '_' || CAST(month({ts}) AS VARCHAR)"


def main_facts(label: Callable[[str], str] = _q_label) -> str:
    return f"""
main_facts AS (
  SELECT n.n_name, p.p_brand, li.period, SUM(li.v) AS v
  FROM (SELECT l_orderkey, l_partkey, {label('l_shipdate')} AS period,
               CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS {MONEY})
                    ELSE CAST(l_extendedprice AS {MONEY}) END AS v
        FROM lineitem
        WHERE l_shipdate IS NOT NULL) li
  JOIN part p ON li.l_partkey = p.p_partkey
  JOIN orders o ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3)"""


def customer_facts() -> str:
    return f"""
cust_facts AS (
  SELECT c.c_name, p.p_brand, li.period, SUM(li.v) AS v
  FROM (SELECT l_orderkey, l_partkey, {_q_label('l_shipdate')} AS period,
               CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS {MONEY})
                    ELSE CAST(l_extendedprice AS {MONEY}) END AS v
        FROM lineitem
        WHERE l_shipdate IS NOT NULL) li
  JOIN part p ON li.l_partkey = p.p_partkey
  JOIN orders o ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2, 3)"""


def seg_facts() -> str:
    return f"""
seg_facts AS (
  SELECT n.n_name, c.c_mktsegment, o.o_orderpriority, {_m_label('o.o_orderdate')} AS period,
         SUM(CAST(o.o_totalprice AS {MONEY})) AS v
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderdate IS NOT NULL
  GROUP BY 1, 2, 3, 4)"""


def cells(name: str, facts: str, ids: list[str], labels: list[str], fill: bool) -> str:
    """``name``: one row per id tuple and period position (0-based), value double."""
    idl = ", ".join(ids)
    on = " AND ".join(f"f.{c} = s.{c}" for c in ids)
    val = "CAST(COALESCE(f.v, 0) AS DOUBLE)" if fill else "CAST(f.v AS DOUBLE)"
    return f"""
{name}_labels(pos, period) AS (VALUES {_labels_values(labels)}),
{name}_spine AS (SELECT {idl}, unnest(range(0, {len(labels)})) AS pos
                 FROM (SELECT DISTINCT {idl} FROM {facts})),
{name} AS (
  SELECT {", ".join("s." + c for c in ids)}, s.pos, lb.period, {val} AS v
  FROM {name}_spine s JOIN {name}_labels lb ON lb.pos = s.pos
  LEFT JOIN {facts} f ON {on} AND f.period = lb.period)"""


def detect(name: str, cells_cte: str, ids: list[str]) -> str:
    """``name``: per cell the four detector flags (numpy 'linear' quartiles,
    sequential left-to-right sums)."""
    idl = ", ".join(ids)

    def quart(p: str, tag: str) -> str:
        return (f"CASE WHEN m >= 1 THEN CASE WHEN t{tag} >= 0.5 "
                f"THEN b{tag} - (b{tag} - a{tag}) * (1 - t{tag}) "
                f"ELSE a{tag} + (b{tag} - a{tag}) * t{tag} END END")

    return f"""
{name}_rows AS (
  SELECT {idl}, list(v ORDER BY pos) AS vs, list(period ORDER BY pos) AS periods
  FROM {cells_cte} GROUP BY {idl}),
{name}_r1 AS (
  SELECT *, len(vs) AS n,
         list_transform(vs, lambda x: CASE WHEN x > 0 THEN x ELSE 0.0 END) AS pp,
         list_sort(list_filter(vs, lambda x: x IS NOT NULL)) AS srt,
         len(list_filter(vs, lambda x: x IS NOT NULL)) AS m,
         len(list_filter(vs, lambda x: x > 0)) AS pos_cnt
  FROM {name}_rows),
{name}_r2 AS (
  SELECT *, list_reduce([CAST(0.0 AS DOUBLE)] || pp, lambda a, b: a + b) AS pos_sum,
         CAST(m - 1 AS DOUBLE) * 0.25 AS h1, CAST(m - 1 AS DOUBLE) * 0.75 AS h3
  FROM {name}_r1),
{name}_r3 AS (
  SELECT *, CAST(floor(h1) AS BIGINT) AS lo1, h1 - floor(h1) AS t1,
            CAST(floor(h3) AS BIGINT) AS lo3, h3 - floor(h3) AS t3
  FROM {name}_r2),
{name}_r4 AS (
  SELECT *, srt[lo1 + 1] AS a1, srt[least(lo1 + 1, m - 1) + 1] AS b1,
            srt[lo3 + 1] AS a3, srt[least(lo3 + 1, m - 1) + 1] AS b3
  FROM {name}_r3),
{name}_r5 AS (
  SELECT *, {quart('0.25', '1')} AS q1, {quart('0.75', '3')} AS q3,
         CASE WHEN pos_cnt > 0 THEN pos_sum / pos_cnt ELSE 0.0 END AS pmean
  FROM {name}_r4),
{name}_r6 AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS lower_b, q3 + 1.5 * (q3 - q1) AS upper_b,
         unnest(range(1, n + 1)) AS i
  FROM {name}_r5),
{name} AS (
  SELECT {idl}, i - 1 AS pos, periods[i] AS "column", vs[i] AS value,
    COALESCE(vs[i] < 0, false) AS neg,
    COALESCE(vs[i] < 0 AND list_reduce([CAST(0.0 AS DOUBLE)] || list_slice(pp, 1, i - 1),
                                        lambda a, b: a + b) >= abs(vs[i]), false) AS ref,
    n >= 2 AND COALESCE(vs[i] > 0 AND vs[i] > 2.0 * pmean
        AND (COALESCE(i > 1 AND vs[i - 1] = 0, false) OR COALESCE(i < n AND vs[i + 1] = 0, false)),
        false) AS dbl,
    n >= 2 AND COALESCE(vs[i] < lower_b OR vs[i] > upper_b, false) AS out_
  FROM {name}_r6)"""


MERGED_COLS = """
  concat_ws(',', CASE WHEN neg THEN 'negative' END, CASE WHEN ref THEN 'refund' END,
            CASE WHEN dbl THEN 'double_booking' END, CASE WHEN out_ THEN 'outlier' END) AS flagged_by,
  CASE WHEN neg OR ref THEN 'set_to_zero' WHEN dbl THEN 'split_evenly' ELSE 'keep_as_is' END
    AS suggested_fix,
  concat_ws(',',
    CASE WHEN (neg OR ref OR out_) AND NOT (neg OR ref) THEN 'set_to_zero' END,
    CASE WHEN dbl AND (neg OR ref) THEN 'split_evenly' END,
    CASE WHEN out_ AND (neg OR ref OR dbl) THEN 'keep_as_is' END) AS alternative_fixes"""

ANY_FLAG = "(neg OR ref OR dbl OR out_)"


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes)


def _main_det() -> list[str]:
    return [main_facts(),
            cells("mc", "main_facts", ["n_name", "p_brand"], quarter_labels(), True),
            detect("md", "mc", ["n_name", "p_brand"])]


def _month_det() -> list[str]:
    """The same tables for the cube by ship month."""
    return [main_facts(_m_label),
            cells("mc", "main_facts", ["n_name", "p_brand"], month_labels(end="2001_12"), True),
            detect("md", "mc", ["n_name", "p_brand"])]


# --- apply -------------------------------------------------------------------

def apply_sql(action: str, attribution: str, select: str, *, det: list[str] | None = None,
              order: str = '"column"') -> str:
    """Replay the apply passes on the main cube (or on the one that ``det`` detects on).

    ``action`` is a CASE over the detector flags giving 'zero', 'refund', 'split',
    'keep' or NULL per cell; ``attribution`` the credited detector. Selection order
    inside a row is ``order``, by default the column text. ``select`` is the final query over the CTEs
    ``entries`` (ids, column, anomaly_type, change_kind, value_before, value_after,
    suggested_fix, flagged, parent_column) and ``final_cells`` (ids, pos, column, v)."""
    ids = "n_name, p_brand"
    ctes = (det or _main_det()) + [f"""
acts AS (
  SELECT n_name, p_brand, pos, "column", value, {action} AS act, {attribution} AS attr FROM md),
plan AS (
  SELECT r.n_name, r.p_brand, r.vs AS vs0, r.periods,
    list_transform(r.vs, lambda x, i: CASE WHEN list_contains(
        COALESCE(a.zpos, []), i) THEN 0.0 ELSE x END) AS vs1,
    COALESCE(a.rpos, []) AS rpos, COALESCE(a.spos, []) AS spos
  FROM md_rows r LEFT JOIN (
    SELECT n_name, p_brand,
      list(pos + 1 ORDER BY {order}) FILTER (WHERE act = 'zero') AS zpos,
      list(pos + 1 ORDER BY {order}) FILTER (WHERE act = 'refund') AS rpos,
      list(pos + 1 ORDER BY {order}) FILTER (WHERE act = 'split') AS spos
    FROM acts GROUP BY 1, 2) a USING ({ids})),
rw(n_name, p_brand, k, cur, prev, r) AS (
  SELECT n_name, p_brand, 0, vs1, vs1, CAST(NULL AS BIGINT) FROM plan
  UNION ALL
  SELECT w.n_name, w.p_brand, w.k + 1,
    list_transform(w.cur, lambda x, i: CASE
      WHEN i = p.rpos[w.k + 1] THEN 0.0
      WHEN i < p.rpos[w.k + 1] AND x > 0 AND list_reduce(
             [-w.cur[p.rpos[w.k + 1]]] || list_reverse(list_transform(
                list_slice(w.cur, i + 1, p.rpos[w.k + 1] - 1),
                lambda y: CASE WHEN y > 0 THEN y ELSE 0.0 END)),
             lambda a, b: a - b) > 0
        THEN x - least(x, list_reduce(
             [-w.cur[p.rpos[w.k + 1]]] || list_reverse(list_transform(
                list_slice(w.cur, i + 1, p.rpos[w.k + 1] - 1),
                lambda y: CASE WHEN y > 0 THEN y ELSE 0.0 END)),
             lambda a, b: a - b))
      ELSE x END),
    w.cur, p.rpos[w.k + 1]
  FROM rw w JOIN plan p USING ({ids})
  WHERE w.k < len(p.rpos)),
after_refunds AS (
  SELECT w.n_name, w.p_brand, w.cur FROM rw w JOIN plan p USING ({ids}) WHERE w.k = len(p.rpos)),
sw(n_name, p_brand, k, cur, prev, s, pt) AS (
  SELECT n_name, p_brand, 0, cur, cur, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  FROM after_refunds
  UNION ALL
  SELECT w.n_name, w.p_brand, w.k + 1,
    list_transform(w.cur, lambda z, j: CASE
      WHEN j = p.spos[w.k + 1] THEN (CASE WHEN (w.cur[p.spos[w.k + 1]] % 1.0) = 0 THEN w.cur[p.spos[w.k + 1]] - (w.cur[p.spos[w.k + 1]] / 2.0 - ((w.cur[p.spos[w.k + 1]] / 2.0) % 1.0)) ELSE w.cur[p.spos[w.k + 1]] / 2.0 END)
      WHEN j = (CASE WHEN p.vs0[p.spos[w.k + 1] + 1] = 0 THEN p.spos[w.k + 1] + 1 WHEN p.spos[w.k + 1] > 1 AND p.vs0[p.spos[w.k + 1] - 1] = 0 THEN p.spos[w.k + 1] - 1 END) THEN (CASE WHEN (w.cur[p.spos[w.k + 1]] % 1.0) = 0 THEN w.cur[p.spos[w.k + 1]] / 2.0 - ((w.cur[p.spos[w.k + 1]] / 2.0) % 1.0) ELSE w.cur[p.spos[w.k + 1]] / 2.0 END)
      ELSE z END),
    w.cur, p.spos[w.k + 1], (CASE WHEN p.vs0[p.spos[w.k + 1] + 1] = 0 THEN p.spos[w.k + 1] + 1 WHEN p.spos[w.k + 1] > 1 AND p.vs0[p.spos[w.k + 1] - 1] = 0 THEN p.spos[w.k + 1] - 1 END)
  FROM sw w JOIN plan p USING ({ids})
  WHERE w.k < len(p.spos)),
final_rows AS (
  SELECT w.n_name, w.p_brand, w.cur FROM sw w JOIN plan p USING ({ids}) WHERE w.k = len(p.spos)),
final_cells AS (
  SELECT n_name, p_brand, i - 1 AS pos, periods[i] AS "column", cur[i] AS v
  FROM (SELECT f.n_name, f.p_brand, f.cur, p.periods, unnest(range(1, len(f.cur) + 1)) AS i
        FROM final_rows f JOIN plan p USING ({ids}))),
entries AS (
  SELECT a.n_name, a.p_brand, a."column", a.attr AS anomaly_type, 'primary' AS change_kind,
         a.value AS value_before, 0.0 AS value_after, 'set_to_zero' AS suggested_fix,
         false AS flagged, CAST(NULL AS VARCHAR) AS parent_column
  FROM acts a WHERE a.act = 'zero'
  UNION ALL
  SELECT w.n_name, w.p_brand, p.periods[w.r], 'refund', 'primary', w.prev[w.r], 0.0,
         'set_to_zero', false, NULL
  FROM rw w JOIN plan p USING ({ids}) WHERE w.k > 0
  UNION ALL
  SELECT n_name, p_brand, periods[i], 'refund', 'refund_cascade', prev[i], cur[i],
         'set_to_zero', false, periods[r]
  FROM (SELECT w.n_name, w.p_brand, w.cur, w.prev, w.r, p.periods, unnest(range(1, w.r)) AS i
        FROM rw w JOIN plan p USING ({ids}) WHERE w.k > 0)
  WHERE cur[i] <> prev[i]
  UNION ALL
  SELECT w.n_name, w.p_brand, p.periods[w.s], 'double_booking', 'primary', w.prev[w.s],
         w.cur[w.s], 'split_evenly', false, NULL
  FROM sw w JOIN plan p USING ({ids}) WHERE w.k > 0
  UNION ALL
  SELECT w.n_name, w.p_brand, p.periods[w.pt], 'double_booking', 'primary', w.prev[w.pt],
         w.cur[w.pt], 'split_evenly', false, NULL
  FROM sw w JOIN plan p USING ({ids}) WHERE w.k > 0
  UNION ALL
  SELECT a.n_name, a.p_brand, a."column", a.attr, 'primary', fc.v, fc.v, 'keep_as_is', true, NULL
  FROM acts a JOIN final_cells fc ON fc.n_name = a.n_name AND fc.p_brand = a.p_brand
       AND fc.pos = a.pos
  WHERE a.act = 'keep')"""]
    return _with(*ctes, recursive=True) + "\n" + select


ALL_ACTION = ("CASE WHEN neg AND NOT ref THEN 'zero' WHEN ref THEN 'refund' "
              "WHEN dbl THEN 'split' WHEN out_ THEN 'keep' END")
ALL_ATTR = ("CASE WHEN ref THEN 'refund' WHEN neg THEN 'negative' "
            "WHEN dbl THEN 'double_booking' WHEN out_ THEN 'outlier' END")
ENTRY_COLS = ('n_name, p_brand, "column", anomaly_type, change_kind, value_before, '
              'value_after, suggested_fix, flagged')


def _cube_wide_select(cells_cte: str, ids: list[str], labels: list[str], val: str = "v") -> str:
    cols = ", ".join(f"max(CASE WHEN pos = {i} THEN {val} END) AS \"{lab}\""
                     for i, lab in enumerate(labels))
    idl = ", ".join(ids)
    return f"SELECT {idl}, {cols} FROM {cells_cte} GROUP BY {idl}"


def _case_sql(facts: str, seg_cells: str, labels: list[str]) -> dict[str, str]:
    """Findings and roles of :mod:`cubewash.plans.cases`, from the cells of the segment cube."""
    months, other, nation = "1996_3", "1998_7", "NATION_7"
    soft_everywhere = [  # cases that reach the soft checks; those whose month is renamed or left out
        ("inferred", {}), ("out of order", {}), ("gap", {months: None, other: None}),
        ("mixed formats", {months: "1996-03"}), ("one id", {}), ("text period", {})]
    names = [("out of order", "V-20", "soft", None, None), ("gap", "V-17", "soft", None, 2),
             ("mixed formats", "V-15", "soft", None, None), ("mixed formats", "V-17", "soft", None, 1),
             ("mixed formats", "V-20", "soft", None, None), ("one id", "V-16", "soft", "row", None),
             ("no period", "V-10", "hard", None, None), ("no id", "V-10", "hard", None, None),
             ("no measures", "V-14", "soft", None, None), ("unknown columns", "V-11", "hard", "2099_1", None),
             ("unknown columns", "V-09", "hard", "region", None)]
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    fixed = ", ".join(f"({', '.join(map(lit, row))})" for row in names)
    nulls = []
    for case, changed in soft_everywhere:
        shown = "CASE period " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in changed.items()) + \
            " ELSE period END" if changed else "period"
        nulls.append(f"""
  SELECT '{case}' AS "case", 'V-18' AS check_id, 'soft' AS severity, {shown} AS "column", n_null AS n
  FROM nulls WHERE n_null / n_rows > 0.9 AND {shown} IS NOT NULL""")
    findings = _with(facts, seg_cells, f"""
nulls AS (SELECT period, count(*) AS n_rows, count(*) - count(v) AS n_null FROM sc GROUP BY period),
lost AS (SELECT count(*) AS n, (SELECT n_rows FROM nulls LIMIT 1) AS n_rows FROM sc
         WHERE n_name = '{nation}' AND period = '{months}'),
keys AS (SELECT n_name, c_mktsegment, count(*) AS n FROM (
           SELECT DISTINCT n_name, c_mktsegment, o_orderpriority FROM seg_facts) GROUP BY ALL)""") + f"""
SELECT "case", check_id, severity, "column", CAST(n AS BIGINT) AS n FROM (
  SELECT * FROM (VALUES {fixed}) t("case", check_id, severity, "column", n)
  UNION ALL {' UNION ALL '.join(nulls)}
  UNION ALL SELECT 'text period', 'V-21', 'soft', NULL, 1 FROM lost WHERE n > 0 AND n / n_rows < 0.1
  UNION ALL SELECT 'text as measure', 'V-11', 'hard', '{months}', n FROM lost WHERE n > 0
  UNION ALL SELECT 'too few ids', 'V-12', 'hard', NULL, sum(n) FROM keys WHERE n > 1 HAVING count(*) > 0)"""
    ids = ["n_name", "c_mktsegment", "o_orderpriority"]
    kept = [m for m in labels if m not in (months, other)]
    mixed = [m if m != months else "1996-03" for m in labels]
    # the label of the other format follows those of the common one
    mixed_times = [m for m in mixed if m != "1996-03"] + ["1996-03"]
    numbered = [f"m{i}" for i in range(len(labels))]
    no_text = [m for m in labels if m != months]
    roles = {"inferred": (ids, labels, labels, []), "out of order": (ids, labels, labels, []),
             "gap": (ids, kept, kept, []), "mixed formats": (ids, mixed_times, mixed_times, []),
             "one id": (["row"], labels, labels, []), "no period": (ids, [], numbered, []),
             "no id": ([], labels, labels, []), "no measures": (ids, labels[:3], [], []),
             "text period": (ids, labels, no_text, [months])}
    rows = ", ".join(f"('{case}', '{role}', {i}, '{c}')" for case, lists in roles.items()
                     for role, columns in zip(("id", "time", "measure", "coercible"), lists)
                     for i, c in enumerate(columns))
    return {"schema_findings_cases": findings, "inferred_roles": f"""
SELECT r.* FROM (VALUES {rows}) r("case", role, pos, "column") WHERE (SELECT count(*) FROM orders) > 0"""}


def oracle_sql() -> dict[str, str]:
    main = _main_det()
    w = _with
    qlabels = quarter_labels()
    mlabels = month_labels()
    seg_ids = ["n_name", "c_mktsegment", "o_orderpriority"]
    seg_cells = cells("sc", "seg_facts", seg_ids, mlabels, False)
    out: dict[str, str] = {}
    out["cube_long"] = w(main_facts()) + \
        "\nSELECT n_name, p_brand, period, CAST(v AS DOUBLE) AS value FROM main_facts"
    out["cube_wide"] = w(main[0], main[1]) + "\n" + _cube_wide_select(
        "mc", ["n_name", "p_brand"], qlabels)
    out["cube_unpivot"] = w(main[0], main[1]) + \
        '\nSELECT n_name, p_brand, period, v AS value FROM mc'
    for name, flag in [("detect_negatives", "neg"), ("detect_refunds", "ref"),
                       ("detect_double_bookings", "dbl"), ("detect_outliers", "out_")]:
        out[name] = w(*main) + f'\nSELECT n_name, p_brand, "column", value FROM md WHERE {flag}'
    out["detections_merged"] = w(*main) + \
        f'\nSELECT n_name, p_brand, "column", value, {MERGED_COLS}\nFROM md WHERE {ANY_FLAG}'
    out["detections_long"] = out["detections_merged"]
    out["detections_nulls"] = w(seg_facts(), seg_cells, detect("sd", "sc", seg_ids)) + \
        f'\nSELECT n_name, c_mktsegment, o_orderpriority, "column", value, {MERGED_COLS}' \
        f'\nFROM sd WHERE {ANY_FLAG}'
    counts = ("SELECT CAST(count_if(neg) AS BIGINT) AS negative, "
              "CAST(count_if(ref) AS BIGINT) AS refund, "
              "CAST(count_if(dbl) AS BIGINT) AS double_booking, "
              "CAST(count_if(out_) AS BIGINT) AS outlier FROM {t}")
    out["detector_counts"] = w(*main) + "\n" + counts.format(t="md")
    out["customer_detector_counts"] = w(
        customer_facts(), cells("cc", "cust_facts", ["c_name", "p_brand"], qlabels, True),
        detect("cd", "cc", ["c_name", "p_brand"])) + "\n" + counts.format(t="cd")
    out["magnitude"] = w(*main) + (
        f"\nSELECT count(*) AS n_detections, "
        f"CAST(SUM(CAST(abs(value) AS {MONEY})) AS DOUBLE) AS magnitude FROM md WHERE {ANY_FLAG}")
    out["flagged_rows"] = w(*main) + (
        "\nSELECT n_name, p_brand, bool_or(neg) AS negative, bool_or(ref) AS refund, "
        "bool_or(dbl) AS double_booking, bool_or(out_) AS outlier FROM md "
        f"GROUP BY n_name, p_brand HAVING bool_or({ANY_FLAG})")
    out["top5pct"] = w(*main, f"""
d AS (SELECT n_name, p_brand, "column", value FROM md WHERE {ANY_FLAG})""") + """
SELECT n_name, p_brand, "column", value FROM (
  SELECT *, row_number() OVER (ORDER BY abs(value) DESC, n_name, p_brand, "column") AS rn,
         count(*) OVER () AS cnt FROM d)
WHERE rn <= greatest(1, cnt // 20)"""
    out["outlier_view"] = w(*main) + \
        f'\nSELECT n_name, p_brand, "column", value, {MERGED_COLS}\nFROM md WHERE out_ OR dbl'
    cols = ["n_name", "c_mktsegment", "o_orderpriority"] + mlabels
    out["null_profile"] = w(seg_facts(), seg_cells, f"""
sw AS ({_cube_wide_select('sc', seg_ids, mlabels)})""") + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count(\"{c}\") AS n_null, "
        f"(count(*) - count(\"{c}\")) / count(*) > 0.9 AS mostly_null FROM sw" for c in cols)
    out["duplicate_ids"] = w(seg_facts()) + """
SELECT n_name, c_mktsegment, count(*) AS n_rows
FROM (SELECT DISTINCT n_name, c_mktsegment, o_orderpriority FROM seg_facts)
GROUP BY 1, 2 HAVING count(*) > 1"""
    returns = customer_facts().replace(f"ELSE CAST(l_extendedprice AS {MONEY}) END", "ELSE 0 END")
    out["all_zero_rows"] = w(returns) + """
SELECT CAST(count(*) AS BIGINT) AS all_zero_rows FROM (
  SELECT c_name, p_brand FROM cust_facts GROUP BY 1, 2 HAVING bool_and(COALESCE(v, 0) = 0))"""
    out["period_gaps"] = w(seg_facts(), """
idx AS (SELECT n_name, c_mktsegment, o_orderpriority,
               CAST(split_part(period, '_', 1) AS INTEGER) * 12
               + CAST(split_part(period, '_', 2) AS INTEGER) - 1 AS pidx FROM seg_facts),
rng AS (SELECT n_name, c_mktsegment, o_orderpriority, min(pidx) AS lo, max(pidx) AS hi
        FROM idx GROUP BY 1, 2, 3),
allp AS (SELECT n_name, c_mktsegment, o_orderpriority, unnest(range(lo, hi + 1)) AS pidx FROM rng)""") + """
SELECT a.n_name, a.c_mktsegment, a.o_orderpriority,
       CAST(a.pidx // 12 AS VARCHAR) || '_' || CAST(a.pidx % 12 + 1 AS VARCHAR) AS gap
FROM allp a ANTI JOIN idx i USING (n_name, c_mktsegment, o_orderpriority, pidx)"""
    num_re = (r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$")
    lost = ("count_if({c} IS NOT NULL AND NOT COALESCE(regexp_matches({c}, '{re}') "
            "AND TRY_CAST({c} AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST({c} AS DOUBLE)), false))")
    prof = []
    for c, expr in [("event_type", "event_type"), ("props", "props"),
                    ("k_text", "json_extract_string(props, '$.k')")]:
        lc = lost.format(c=expr, re=num_re)
        prof.append(
            f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({expr}) AS n_null, "
            f"{lc} AS n_lost, {lc} = 0 AS numeric, "
            f"{lc} > 0 AND {lc} / count(*) < 0.10 AS coercible FROM events")
    out["coercion_profile"] = "\nUNION ALL\n".join(prof)
    ym = ("(SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS mo, "
          "quarter(o_orderdate) AS qq FROM orders)")
    months = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
    out["period_parse"] = f"""
SELECT DISTINCT * FROM (
  SELECT 'YYYY_M' AS fmt, CAST(y AS VARCHAR) || '_' || CAST(mo AS VARCHAR) AS label,
         CAST(y * 12 + mo - 1 AS BIGINT) AS period_index FROM {ym}
  UNION ALL
  SELECT 'YYYY-MM', CAST(y AS VARCHAR) || '-' || lpad(CAST(mo AS VARCHAR), 2, '0'),
         y * 12 + mo - 1 FROM {ym}
  UNION ALL
  SELECT 'Mon-YY', {months}[mo] || '-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0'),
         (2000 + y % 100) * 12 + mo - 1 FROM {ym}
  UNION ALL
  SELECT 'YYYYQn', CAST(y AS VARCHAR) || 'Q' || CAST(qq AS VARCHAR), y * 4 + qq - 1 FROM {ym})"""
    out["default_policy"] = w(*main) + f"""
SELECT n_name, p_brand, "column",
  CASE WHEN neg OR ref THEN 'set_to_zero' WHEN dbl THEN 'split_evenly' ELSE 'keep_as_is' END AS fix,
  {ALL_ATTR} AS attribution
FROM md WHERE {ANY_FLAG}"""
    out["selections_by_detector"] = w(*main) + f"""
SELECT {ALL_ATTR} AS detector, count(*) AS n FROM md WHERE {ANY_FLAG} GROUP BY 1"""
    out["apply_zero"] = apply_sql("CASE WHEN neg THEN 'zero' END", "'negative'",
                                  f"SELECT {ENTRY_COLS} FROM entries")
    out["apply_split"] = apply_sql("CASE WHEN dbl THEN 'split' END", "'double_booking'",
                                   f"SELECT {ENTRY_COLS} FROM entries")
    out["apply_refund"] = apply_sql("CASE WHEN ref THEN 'refund' END", "'refund'",
                                    f"SELECT {ENTRY_COLS} FROM entries")
    out["cleaned_cube"] = apply_sql(ALL_ACTION, ALL_ATTR, _cube_wide_select(
        "final_cells", ["n_name", "p_brand"], qlabels))
    out["audit_changes"] = apply_sql(ALL_ACTION, ALL_ATTR, f"SELECT {ENTRY_COLS} FROM entries")
    out["audit_summary"] = apply_sql(ALL_ACTION, ALL_ATTR, """
SELECT t.anomaly_type, CAST(COALESCE(e.n, 0) AS BIGINT) AS n
FROM (VALUES ('negative'), ('refund'), ('double_booking'), ('outlier')) t(anomaly_type)
LEFT JOIN (SELECT anomaly_type, count(*) AS n FROM entries GROUP BY 1) e USING (anomaly_type)""")
    out["reconcile"] = apply_sql(ALL_ACTION, ALL_ATTR, f"""
SELECT anomaly_type, count(*) AS n,
  CAST(SUM(CAST(value_before AS {MONEY})) AS DOUBLE) AS sum_before,
  CAST(SUM(CAST(value_after AS {MONEY})) AS DOUBLE) AS sum_after
FROM entries GROUP BY 1""")
    out["selection_log"] = apply_sql("CASE WHEN neg AND \"column\" <> '1997Q3' THEN 'zero' END", "'negative'",
                                     f"SELECT {ENTRY_COLS} FROM entries")
    out["selections_apply"] = apply_sql("CASE WHEN out_ THEN 'zero' END", "'outlier'",
                                        f"SELECT {ENTRY_COLS} FROM entries")
    out["preview_pages"] = out["cube_wide"]
    out["preview_flagged"] = w(*main) + """
SELECT n_name, p_brand, count(*) OVER () AS total FROM md GROUP BY n_name, p_brand HAVING bool_or(neg)"""
    out["schema_findings_returns"] = w(returns) + """
SELECT 'V-19' AS check_id, 'soft' AS severity, CAST(NULL AS VARCHAR) AS "column", count(*) AS n FROM (
  SELECT c_name, p_brand FROM cust_facts GROUP BY 1, 2 HAVING bool_and(COALESCE(v, 0) = 0))
HAVING count(*) > 0"""
    out["schema_findings_duplicates"] = w(seg_facts()) + """
SELECT 'V-12' AS check_id, 'hard' AS severity, CAST(NULL AS VARCHAR) AS "column",
       CAST(sum(n) AS BIGINT) AS n
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT n_name, c_mktsegment, o_orderpriority FROM seg_facts)
      GROUP BY n_name, c_mktsegment)
WHERE n > 1
HAVING count(*) > 0"""
    out["selections_mixed"] = apply_sql(
        "CASE WHEN neg AND NOT ref THEN 'zero' WHEN ref THEN 'refund' WHEN dbl THEN 'split' END", ALL_ATTR,
        f"SELECT {ENTRY_COLS} FROM entries", order='"column" DESC')
    out["what_if"] = apply_sql(ALL_ACTION, ALL_ATTR, """
SELECT f.n_name, f.p_brand, f."column", m.value AS value_before, f.v AS value_after
FROM final_cells f JOIN md m USING (n_name, p_brand, pos) WHERE f.v IS DISTINCT FROM m.value""")
    out["coerced_detections"] = w(
        main_facts(), cells("mc", "main_facts", ["n_name", "p_brand"], qlabels, True), """
mt AS (SELECT n_name, p_brand, pos, period,
              CASE WHEN n_name = 'NATION_7' AND period = '1997Q3' THEN NULL ELSE v END AS v FROM mc)""",
        detect("md", "mt", ["n_name", "p_brand"]),
        cells("mx", "main_facts", ["n_name", "p_brand"], [x for x in qlabels if x != "1997Q3"], True),
        detect("mb", "mx", ["n_name", "p_brand"])) + f"""
SELECT n_name, p_brand, "column", value, {MERGED_COLS},
       (n_name, p_brand, "column") IN (SELECT (n_name, p_brand, "column") FROM mb WHERE {ANY_FLAG}) AS known
FROM md WHERE {ANY_FLAG}"""
    out.update(_case_sql(seg_facts(), seg_cells, mlabels))
    month = _month_det()
    out["wide_detections"] = w(*month) + \
        f'\nSELECT n_name, p_brand, "column", value, {MERGED_COLS}\nFROM md WHERE {ANY_FLAG}'
    out["wide_cleaned_cube"] = apply_sql(ALL_ACTION, ALL_ATTR, _cube_wide_select(
        "final_cells", ["n_name", "p_brand"], month_labels(end="2001_12")), det=month)
    out["wide_audit"] = apply_sql(ALL_ACTION, ALL_ATTR, f"SELECT {ENTRY_COLS} FROM entries", det=month)
    out["roundtrip_cleaned"] = out["cleaned_cube"]
    out["roundtrip_audit"] = apply_sql(ALL_ACTION, ALL_ATTR, f"SELECT {ENTRY_COLS}, parent_column FROM entries")
    out["run_summary_state"] = apply_sql(ALL_ACTION, ALL_ATTR, """
SELECT 'cleaned' AS status, (SELECT count(*) FROM md_rows) AS row_count,
       count_if(neg)::BIGINT AS negative, count_if(ref)::BIGINT AS refund,
       count_if(dbl)::BIGINT AS double_booking, count_if(out_)::BIGINT AS outlier,
       (SELECT count(*) FROM entries) AS applied_changes
FROM md""")
    return out
