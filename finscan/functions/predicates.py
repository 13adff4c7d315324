"""Filters as Spark columns. A null operand excludes the row, as in SQL."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finscan.functions.fields import q
from finscan.plans.spec import Filter

PLAIN = {"greater": operator.gt, "less": operator.lt, "egreater": operator.ge, "eless": operator.le, "equal": operator.eq, "nequal": operator.ne, "above": operator.gt, "below": operator.lt}
CROSSES = ("crosses", "crosses_above", "crosses_below")


def _right(f: Filter) -> Column:
    return q(f.right["field"]) if isinstance(f.right, dict) else F.lit(f.right)


def compile_filter(f: Filter, schema: T.StructType, *, series: str = "symbol", order: str | None = None) -> Column:
    """The predicate of a filter; crosses_* compare with the row before in the series, by order."""
    left = f.left if isinstance(f.left, tuple) else (f.left,)
    if f.operation in PLAIN:
        return PLAIN[f.operation](q(left[0]), _right(f))
    if f.operation in ("in_range", "not_in_range"):
        values = list(f.right)
        numeric = len(values) == 2 and all(isinstance(v, int | float) and not isinstance(v, bool) for v in values)
        inside = reduce(operator.or_, (q(c).between(*values) if numeric else q(c).isin(values) for c in left))
        return inside if f.operation == "in_range" else ~inside
    if f.operation in ("has", "has_none_of"):
        values = list(f.right) if isinstance(f.right, list | tuple) else [f.right]
        array = isinstance(schema[left[0]].dataType, T.ArrayType)
        found = F.arrays_overlap(q(left[0]), F.array(*map(F.lit, values))) if array else q(left[0]).isin(values)
        return found if f.operation == "has" else ~found
    if f.operation == "match":
        return F.upper(q(left[0])).contains(str(f.right).upper())
    if f.operation == "nempty":
        text = isinstance(schema[left[0]].dataType, T.StringType)
        return q(left[0]).isNotNull() & (q(left[0]) != "") if text else q(left[0]).isNotNull()
    if order is None:
        raise ValueError(f"{f.operation} needs a series in order")
    now = q(left[0]) - _right(f)
    before = F.lag(now).over(Window.partitionBy(q(series)).orderBy(q(order)))
    above, below = (before <= 0) & (now > 0), (before >= 0) & (now < 0)
    return {"crosses_above": above, "crosses_below": below, "crosses": above | below}[f.operation]


def apply_filters(df: DataFrame, filters: tuple[Filter, ...], *, series: str = "symbol", order: str | None = None) -> DataFrame:
    """Rows that pass all filters. Crossings look at the unfiltered series, so they are flagged before anything is dropped."""
    for f in filters:
        for name in f.fields:
            if name not in df.columns:
                raise ValueError(f"no field {name!r} to filter by")
    crossing = [f for f in filters if f.operation in CROSSES]
    flags = {f"__cross_{i}": compile_filter(f, df.schema, series=series, order=order) for i, f in enumerate(crossing)}
    if flags:
        df = df.withColumns(flags)
    kept = [compile_filter(f, df.schema) for f in filters if f.operation not in CROSSES] + [F.col(c) for c in flags]
    return (df.where(reduce(operator.and_, kept)) if kept else df).drop(*flags)
