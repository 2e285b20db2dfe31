"""Text form of values for the pipe-delimited sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render(c: Column, dtype: T.DataType) -> Column:
    """Floats: NaN, Inf, -Inf; whole numbers below 1e15 with one decimal; else plain digits without an exponent."""
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    digits = F.regexp_replace(c.cast("string").try_cast("decimal(38,18)").cast("string"), "0+$", "")
    whole = F.format_string("%.1f", c.cast("double"))
    return (
        F.when(c.isNull(), None)
        .when(F.isnan(c), "NaN")
        .when(c == float("inf"), "Inf")
        .when(c == float("-inf"), "-Inf")
        .when((F.abs(c) < 1e15) & (c.cast("double") % 1 == 0), whole)
        # beyond what a decimal holds, Java's fixed notation is used
        .otherwise(F.when((F.abs(c) >= 1e-17) & (F.abs(c) < 1e19), digits).otherwise(F.format_string("%.40f", c.cast("double"))))
    )


def pipe_line(df: DataFrame) -> Column:
    """One row as ``v1|v2|...|vN|``; a null is an empty field."""
    parts = [F.coalesce(render(df[f"`{f.name}`"], f.dataType), F.lit("")) for f in df.schema.fields]
    return F.concat(F.concat_ws("|", *parts), F.lit("|"))
