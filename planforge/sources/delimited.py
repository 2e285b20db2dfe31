"""Datasets of ``name.csv`` (one ``v|v|...|`` line a row) with ``name.schema`` (names, then types)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import column_stats
from .catalog import Catalog

#: Type tokens of a schema file; any letter case.
TOKENS = {"I32": T.IntegerType(), "I64": T.LongType(), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "STRING": T.StringType()}


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()
    names, kinds = (lines[i].strip().strip("|").split("|") for i in (0, 1))
    if len(names) != len(kinds):
        raise ValueError(f"{path}: {len(names)} names and {len(kinds)} types")
    if bad := [k for k in kinds if k.strip().upper() not in TOKENS]:
        raise ValueError(f"{path}: unknown type {bad[0]!r}")
    return T.StructType([T.StructField(n.strip(), TOKENS[k.strip().upper()]) for n, k in zip(names, kinds)])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One trailing ``|`` is dropped; empty strings stay empty; blank lines are skipped.

    A line with another number of fields, or a number that does not parse, fails the read.
    """
    line = F.regexp_replace(F.col("value"), r"\|$", "")
    parts = F.split(line, r"\|", -1)
    n = len(schema.fields)
    wrong = F.raise_error(F.concat(F.lit(f"expected {n} fields: "), F.col("value")))
    rows = spark.read.text(path).filter("value <> ''").select(F.when(F.size(parts) == n, parts).otherwise(wrong).alias("p"))
    return rows.select(*[F.col("p")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Names that have both files, with a warning for others; listed by Hadoop, so any store that Spark reads will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    names = {s.getPath().getName() for s in at.getFileSystem(conf).listStatus(at)}
    found = sorted(n[:-4] for n in names if n.endswith(".csv"))
    if lone := [n for n in found if f"{n}.schema" not in names]:
        logging.getLogger(__name__).warning("no schema, skipped: %s", ", ".join(lone))
    return [n for n in found if n not in lone]


def load_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder, also registered as temporary views."""
    out = {}
    for name in discover(spark, folder):
        out[name] = read_table(spark, f"{folder}/{name}.csv", read_schema(spark, f"{folder}/{name}.schema"))
        out[name].createOrReplaceTempView(name)
    return out


def write_dataset(tables: dict[str, DataFrame], target: str) -> None:
    """The compiled form of a dataset: one Parquet folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def compile_dataset(spark: SparkSession, folder: str, target: str) -> Catalog:
    """A dataset's folder compiled: Parquet tables in ``target``, and their catalog with all columns' statistics, also written to ``target``/catalog.json."""
    tables = load_dataset(spark, folder)
    write_dataset(tables, target)
    out = Catalog(spark, target)
    for name in tables:
        out.describe(name, column_stats(out.table(name)))
    spark.createDataFrame([(out.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/catalog.json")
    return out
