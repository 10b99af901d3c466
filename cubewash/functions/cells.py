"""Column expressions over the measure cells of one cube row.

A cube row's measures are known by name on the driver, so every rule is
written as plain per-position Column expressions (unrolled over the measure
positions). They stay inside whole-stage codegen and need no shuffle: every
rule only looks at its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
"""Text a pandas-style numeric coercion accepts. Spark's ``try_cast`` alone also
takes ``'1d'``/``'1f'`` and parses ``'NaN'``, which must count as lost values."""


def q(name: str) -> Column:
    """Column by exact name; backticks keep names such as ``2021-01`` literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def to_double(c: Column, dtype: T.DataType) -> Column:
    """Measure value as double, NaN and non-numeric text as NULL."""
    if isinstance(dtype, T.StringType):
        num = F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double"))
    elif isinstance(dtype, T.BooleanType):
        num = c.cast("int").cast("double")
    else:
        num = c.cast("double")
    return F.nanvl(num, F.lit(None).cast("double"))


def lost_on_coercion(c: Column, dtype: T.DataType) -> Column:
    """True where a non-null value does not survive numeric coercion."""
    if isinstance(dtype, T.StringType):
        ok = c.rlike(NUMERIC_TEXT) & F.nanvl(c.try_cast("double"), F.lit(None)).isNotNull()
        return c.isNotNull() & ~F.coalesce(ok, F.lit(False))
    if isinstance(dtype, (T.NumericType, T.BooleanType, T.NullType)):
        return F.lit(False)
    return c.isNotNull()


def lost_on_coercion_sql(name: str, dtype: T.DataType) -> str:
    """:func:`lost_on_coercion` of a column by name, as SQL text."""
    c = sql_name(name)
    if isinstance(dtype, T.StringType):
        return f"({c} IS NOT NULL AND {to_double_sql(name, dtype)} IS NULL)"
    if is_numeric_type(dtype):
        return "false"
    return f"({c} IS NOT NULL)"


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.NullType))


def sql_name(name: str) -> str:
    """A column's name in SQL text. Python builds a Column call by call, which for a cube of
    many periods takes longer than the job; wide expressions are therefore one text each."""
    return "`" + name.replace("`", "``") + "`"


def to_double_sql(name: str, dtype: T.DataType) -> str:
    c = sql_name(name)
    if isinstance(dtype, T.StringType):
        pattern = NUMERIC_TEXT.replace("\\", "\\\\")
        num = f"CASE WHEN {c} RLIKE '{pattern}' THEN try_cast({c} AS DOUBLE) END"
    elif isinstance(dtype, T.BooleanType):
        num = f"CAST(CAST({c} AS INT) AS DOUBLE)"
    else:
        num = f"CAST({c} AS DOUBLE)"
    return f"nanvl({num}, CAST(NULL AS DOUBLE))"


def cells_array(df: DataFrame, measures: list[str]) -> Column:
    """The measures of a row as ``array<double>`` (NaN and non-numbers -> NULL),
    built as one SQL expression."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if not measures:
        return F.array().cast(T.ArrayType(T.DoubleType(), True))
    return F.expr("array(" + ", ".join(to_double_sql(m, types[m]) for m in measures)
                  + ")").cast(T.ArrayType(T.DoubleType(), True))


def sql_text(value: str | None) -> str:
    """A string literal in SQL text."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def positive_part(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(0.0))


def prefix_positive_sums(cells: list[Column]) -> list[Column]:
    """pb[i] = sum of positive cells before position i, summed left to right."""
    out = [F.lit(0.0)]
    for x in cells[:-1]:
        out.append(out[-1] + positive_part(x))
    return out


def positive_mean(cells: list[Column]) -> Column:
    total = F.lit(0.0)
    count = F.lit(0)
    for x in cells:
        total = total + positive_part(x)
        count = count + F.when(x > 0, 1).otherwise(0)
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def quantile_linear(sorted_cells: Column, n_null: Column, n: int, p: float) -> Column:
    """Linear-interpolated percentile of the non-null cells.

    ``sorted_cells`` is ``sort_array(cells)`` (NULLs first). The virtual index,
    the neighbour choice and the two-sided interpolation follow numpy's
    ``linear`` method so that results agree to the last bit.
    """
    m = F.lit(n) - n_null
    h = (m - 1).cast("double") * F.lit(p)
    lo = F.floor(h).cast("int")
    t = h - lo
    hi = F.least(lo + 1, m - 1)
    # element_at is 1-based; NULLs occupy the first n_null slots.
    a = F.element_at(sorted_cells, n_null + lo + 1)
    b = F.element_at(sorted_cells, n_null + hi + 1)
    diff = b - a
    val = F.when(t >= 0.5, b - diff * (1 - t)).otherwise(a + diff * t)
    return F.when(m >= 1, val)


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))
