"""Cube sources: Parquet scan with the reference's input checks (S-01..S-03),
the measure array (P-01), row identity (P-03), coercion (P-04) and the
long <-> wide reshape (P-05)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import cells_array, free_name, q, sql_name, sql_text, to_double_sql
from ..model import (
    CELLS,
    FILE_PATH,
    INTERNAL,
    ROW_ID,
    ROW_INDEX,
    CubeError,
    DuplicateColumnsError,
    EmptyInputError,
    ReservedNameError,
    UnreadableInputError,
)

_DUP_RE = re.compile(r"`([^`]*)`")


def read_cube(spark: SparkSession, path: str, *, with_row_index: bool = True,
              check_empty: bool = True) -> DataFrame:
    """Lazy Parquet scan of a cube.

    * duplicate column names -> :class:`DuplicateColumnsError` (Spark detects them
      while resolving the footer schema),
    * unreadable / non-Parquet input -> :class:`UnreadableInputError`,
    * zero rows -> :class:`EmptyInputError` (``isEmpty`` reads at most one row group).

    ``with_row_index`` keeps the place of a row: its file's path and its index in
    that file. Together they identify the row and order a table of many files; they
    cost nothing extra. Columns such as `Rev` and `rev` are distinct only in a session
    with ``spark.sql.caseSensitive``; other sessions get DuplicateColumnsError.

    The scan is not repartitioned; a session that wants more tasks for a small file
    sets ``spark.sql.files.maxPartitionBytes`` or ``minPartitionNum``.
    """
    try:
        df = spark.read.parquet(path)
        cols = df.columns
    except AnalysisException as exc:
        msg = str(exc)
        if "COLUMN_ALREADY_EXISTS" in msg or "Found duplicate column" in msg:
            raise DuplicateColumnsError(sorted(set(_DUP_RE.findall(msg)))) from exc
        raise UnreadableInputError(
            f"'{path}' cannot be read as Parquet."
        ) from exc
    except Exception as exc:  # corrupt footer, wrong magic bytes
        raise UnreadableInputError(
            f"'{path}' cannot be read as Parquet."
        ) from exc
    dups = sorted({c for c in cols if cols.count(c) > 1})
    if dups:
        raise DuplicateColumnsError(dups)
    taken = sorted(set(cols) & INTERNAL)
    if taken:
        raise ReservedNameError(f"The cube has a column named '{taken[0]}', which is reserved.")
    if with_row_index:
        df = df.select(
            "*",
            F.col("_metadata.file_path").alias(FILE_PATH),
            F.col("_metadata.row_index").alias(ROW_INDEX),
        )
    if check_empty:
        try:
            empty = df.isEmpty()
        except Exception as exc:
            raise UnreadableInputError(
                f"'{path}' cannot be read as Parquet."
            ) from exc
        if empty:
            raise EmptyInputError(f"'{path}' holds no rows.")
    return df


def user_columns(df: DataFrame) -> list[str]:
    """Columns of the cube itself (without the ones this library adds)."""
    return [c for c in df.columns if c not in INTERNAL]


def row_key(ids: list[str]) -> Column:
    return F.struct(*[q(c).alias(c) for c in ids])


def row_id(ids: list[str]) -> Column:
    """Stable 128-bit row identity from the id tuple (ids are unique, V-12).

    JSON keeps field names, so NULLs in different id columns never collide."""
    return F.substring(F.sha2(F.to_json(row_key(ids)), 256), 1, 32)


def prepare(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Add the measure array ``__cells`` (double, NaN -> NULL) and ``__row_id``.

    Narrow: one projection, no shuffle."""
    extra = [cells_array(df, measures).alias(CELLS)]
    if ROW_ID not in df.columns:
        extra.append(row_id(ids).alias(ROW_ID))
    return df.select("*", *extra)


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """P-04: listed columns become double; text that is not a number becomes NULL."""
    from ..functions.cells import to_double

    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in columns if c not in types]
    if missing:
        raise CubeError(f"The cube has no column '{missing[0]}'.")
    return df.withColumns({c: to_double(q(c), types[c]) for c in columns})


def long_to_wide(facts: DataFrame, ids: list[str], period: str, value: str,
                 labels: list[str], *, fill: float | None = 0.0) -> DataFrame:
    """P-05: fact rows (ids, period label, value) -> one row per id tuple and one
    column per label, in ``labels`` order.

    Facts are summed first, per id tuple and place of the period, in rows of one sum each
    (map-side partial sums); only these few are laid out, with one double per label. A sum
    per label at once would hold a decimal buffer for every cell of the cube, empty ones
    included. Facts that are already dealt out by the id tuple are not shuffled again. No
    distinct job, since the labels are given. A fact of any other period is an error,
    never dropped."""
    name, listed = sql_name(period), ", ".join(map(sql_text, labels))
    place, total = free_name(facts, "place"), free_name(facts, "total")
    known = (f"CASE WHEN {name} IN ({listed}) THEN array_position(array({listed}), {name}) ELSE "
             f"raise_error(concat('period outside the cube: ', coalesce(CAST({name} AS STRING), 'NULL'))) END")
    sums = (facts.withColumn(place, F.expr(known)).groupBy(*[q(c) for c in ids], q(place))
            .agg(F.sum(q(value)).cast("double").alias(total)))

    def cell(label: str) -> Column:
        one = f"max(CASE WHEN {sql_name(place)} = {labels.index(label) + 1} THEN {sql_name(total)} END)"
        filled = one if fill is None else f"coalesce({one}, {float(fill)!r}D)"
        return F.expr(f"{filled} AS {sql_name(label)}")

    return sums.groupBy(*[q(c) for c in ids]).agg(*[cell(lab) for lab in labels])


def wide_to_long(df: DataFrame, ids: list[str], measures: list[str], *,
                 period: str = "period", value: str = "value") -> DataFrame:
    """P-05 inverse: one row per id tuple and measure (narrow, no shuffle)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cast = df.selectExpr(*map(sql_name, ids), *[f"{to_double_sql(m, types[m])} AS {sql_name(m)}" for m in measures])
    return cast.unpivot([q(c) for c in ids], [q(m) for m in measures], period, value)
