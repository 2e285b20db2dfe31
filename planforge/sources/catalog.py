"""Tables by name, with declared columns and statistics."""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.nodes import PlanError

#: Names of the five declared types in the catalog's JSON.
TYPES = {"Int32": T.IntegerType(), "Int64": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType()}


def type_name(dtype: T.DataType) -> str:
    """The declared name; a type outside the five (such as a timestamp) is declared as its ISO text."""
    return next((n for n, t in TYPES.items() if t == dtype), "String")


def _datum(value, dtype: T.DataType):
    name = type_name(dtype)
    return {name: str(value) if name == "String" else value}


def stat_list(found: dict, dtype: T.DataType) -> list:
    """Statistics of a column, as column_stats() has them, in the form that the catalog's JSON gives them."""
    bounds = lambda lo, hi: {"lower_bound": _datum(lo, dtype), "upper_bound": _datum(hi, dtype)}
    out: list = ["IsPhysicallyOrdered"] if found.get("is_ordered") else []
    if "lower_bound" in found and found["lower_bound"] is not None:
        out.append({"RangeStat": bounds(found["lower_bound"], found["upper_bound"])})
    out += [{"CardinalityStat": found["cardinality"]}, {"DensityStat": found["density"]}]
    if found.get("histogram"):
        out.append({"HistogramStat": {"frequency_points": [[bounds(lo, hi), n] for lo, hi, n in found["histogram"]]}})
    return out


class Catalog:
    """Maps names to Parquet folders or to functions that make a DataFrame; reading is lazy."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self._made, self.specs = spark, root, {}, {}

    def register(self, name: str, source: "str | DataFrame | Callable[[], DataFrame]") -> "Catalog":
        self._made[name] = source
        return self

    def table(self, name: str) -> DataFrame:
        source = self._made.get(name)
        if isinstance(source, DataFrame):
            return source
        if callable(source):
            return source()
        if source is None and self.root is None:
            raise PlanError(f"unknown table {name!r}")
        try:
            return self.spark.read.parquet(source or f"{self.root}/{name}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise PlanError(f"unknown table {name!r}") from None
            raise

    def describe(self, name: str, stats: dict | None = None) -> dict:
        """Table spec: name and columns with type and, if given by column as column_stats() has them, statistics."""
        fields = self.table(name).schema.fields
        known = {f.name: stat_list(stats[f.name], f.dataType) for f in fields if f.name in (stats or {})}
        columns = [{"column_name": f.name, "data_type": type_name(f.dataType), "stats": known.get(f.name)} for f in fields]
        self.specs[name] = {"name": name, "file_id": name, "column_specs": columns}
        return self.specs[name]

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps({"table_specs": list(self.specs.values())}, indent=indent)

    @classmethod
    def load(cls, spark: SparkSession, text: str, root: str) -> "Catalog":
        """From to_json(); each table is read from ``root`` with its declared columns and types."""
        out = cls(spark, root)
        for spec in json.loads(text)["table_specs"]:
            out.specs[spec["name"]] = spec
            schema = T.StructType([T.StructField(c["column_name"], TYPES[c["data_type"]]) for c in spec["column_specs"]])
            out.register(spec["name"], lambda p=f"{root}/{spec['file_id']}.parquet", s=schema: spark.read.schema(s).parquet(p))
        return out
