"""One meaning for each comparison, whatever plan it stands in.

Integers compare exactly; if either side is floating, both compare as doubles; NaN equals
nothing and is ordered before or after nothing; a string and a number are never equal and
never ordered. The choice is made from the types alone, so Catalyst sees plain comparisons
that it can push down or turn into join keys.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def family(dtype: T.DataType) -> str:
    """int, float, text, time or other."""
    for name, kinds in (("int", _INTS), ("float", _FLOATS), ("text", (T.StringType,)), ("time", _TIMES)):
        if isinstance(dtype, kinds):
            return name
    return "other"


def literal(kind: str, value) -> tuple[Column, T.DataType]:
    if kind == "F32":
        value = struct.unpack("f", struct.pack("f", value))[0]
    dtype = {"I32": T.IntegerType(), "I64": T.LongType(), "F32": T.FloatType(), "F64": T.DoubleType(), "String": T.StringType()}[kind]
    return F.lit(float(value) if kind[0] == "F" else value).cast(dtype), dtype


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"EQ": a == b, "NE": a != b, "GT": a > b, "GTE": a >= b, "LT": a < b, "LTE": a <= b}[op]


def compare(op: str, a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, b_value=None) -> Column:
    """``a op b``; ``b_value`` is the Python value if b is a literal, so that no guard is put on it."""
    fa, fb = family(a_type), family(b_type)
    iso = {fa, fb} == {"time", "text"}  # ISO text against a time column: text is cast, malformed text raises
    if fa != fb and {fa, fb} != {"int", "float"} and not iso:
        return F.lit(op == "NE")
    if "float" not in (fa, fb):
        return _apply(op, a, b)
    x, y = a.cast("double"), F.lit(float(b_value)) if b_value is not None else b.cast("double")
    odd = [F.isnan(c) for c, f, v in ((x, fa, None), (y, fb, b_value)) if f == "float" and v is None]
    if b_value is not None and math.isnan(b_value):
        return F.lit(op == "NE")
    if op == "NE":
        out = x != y
        for c in odd:
            out = out | c
        return out
    out = _apply(op, x, y)
    for c in odd:
        out = out & ~c
    return out
