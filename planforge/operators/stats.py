"""Column statistics: count, range, cardinality, density, equi-depth histogram, physical order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many distinct values are counted exactly; beyond, by a sketch of 4096 registers.
EXACT_LIMIT, SKETCH_ERROR, BUCKETS, TEXT_DISTINCT = 10_000, 0.01625, 10, 50


def _numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> dict[str, dict]:
    """By column: total_count, lower_bound and upper_bound (numbers only), cardinality, density.

    Two passes, each one aggregate over all columns. A table without rows has no statistics.
    With ``exact``, distinct values are counted exactly whatever their number, in one pass that copies a row for each column;
    a table without rows is counted too, as SQL does: no rows, no values, density 1.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    counts = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        distinct = F.count_distinct(f"`{f.name}`") if exact else F.approx_count_distinct(f"`{f.name}`", SKETCH_ERROR)
        counts.append(distinct.alias(f"d{i}"))
        if _numeric(f.dataType):
            counts += [F.min(f"`{f.name}`").alias(f"lo{i}"), F.max(f"`{f.name}`").alias(f"hi{i}")]
    first = df.agg(*counts).first()
    if not first["n"] and not exact:
        return {}
    small = [i for i in range(len(fields)) if not exact and first[f"d{i}"] <= EXACT_LIMIT * (1 + 4 * SKETCH_ERROR)]
    few = df.agg(*[F.count_distinct(f"`{fields[i].name}`").alias(f"e{i}") for i in small]).first() if small else {}
    out = {}
    for i, f in enumerate(fields):
        n = few[f"e{i}"] if i in small and few[f"e{i}"] <= EXACT_LIMIT else first[f"d{i}"]
        out[f.name] = {"total_count": first["n"], "cardinality": n, "density": min(1.0, n / first["n"]) if first["n"] else 1.0}
        if _numeric(f.dataType):
            out[f.name] |= {"lower_bound": first[f"lo{i}"], "upper_bound": first[f"hi{i}"]}
    return out


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Equi-depth: (bucket, lower_bound, upper_bound, frequency) over the sorted non-null values.

    Values are counted first, so a frequent value is one row; ranks come from sums in value
    ranges and their offsets, so no task sorts or sees the whole column.
    """
    values = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    if _numeric(df.schema[column].dataType):
        ends = df.agg(F.percentile_approx(f"`{column}`", [i / 64 for i in range(1, 64)], 1000).alias("q")).first()["q"]
    else:
        ends = [r[0] for r in df.select(f"`{column}`").sample(min(1.0, 0.01), seed=1).limit(10_000).distinct().collect() if r[0] is not None][:64]
    ends = sorted(set(ends or []))
    part = F.lit(0)
    for i, e in enumerate(ends, 1):
        part = F.when(F.col("x") >= F.lit(e), i).otherwise(part)
    values = values.withColumn("part", part)
    sums = values.groupBy("part").agg(F.sum("n").alias("s"))  # at most 65 rows
    offsets = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("off"), F.sum("s").over(Window.partitionBy()).alias("total"))
    ranked = values.join(F.broadcast(offsets), "part").withColumn("end", F.col("off") + F.sum("n").over(Window.partitionBy("part").orderBy("x")))
    size = F.ceil(F.col("total") / F.lit(float(buckets))).cast("long")
    first, last = F.expr("end - n"), F.expr("end - 1")
    spread = ranked.withColumn("c", size).withColumn("b", F.explode(F.sequence(F.floor(first / F.col("c")), F.floor(last / F.col("c")))))
    inside = F.least(F.col("end"), (F.col("b") + 1) * F.col("c")) - F.greatest(F.expr("end - n"), F.col("b") * F.col("c"))
    return (
        spread.withColumn("k", inside).groupBy(F.col("b").cast("long").alias("bucket"))
        .agg(F.min("x").alias("lower_bound"), F.max("x").alias("upper_bound"), F.sum("k").alias("frequency"))
    )


def has_histogram(dtype: T.DataType, cardinality: int) -> bool:
    return _numeric(dtype) or cardinality <= TEXT_DISTINCT


def physical_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, is_ordered): no value is above its successor, in the order of files and of rows in them.

    All columns in one pass. The window runs within a file; between files only the first and last rows are compared.
    """
    at, edges = Window.partitionBy("f").orderBy("i"), Window.orderBy("f")
    x = [f"x{k}" for k in range(len(columns))]
    rows = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, x)])
    rows = rows.withColumns({f"falls{n}": F.coalesce(F.lag(n).over(at) > F.col(n), F.lit(False)) for n in x})
    ends = [e for n in x for e in (F.bool_or(f"falls{n}").alias(f"falls{n}"), F.min_by(n, "i").alias(f"first{n}"), F.max_by(n, "i").alias(f"last{n}"))]
    files = rows.groupBy("f").agg(*ends)  # one row a file
    files = files.withColumns({f"falls{n}": F.col(f"falls{n}") | F.coalesce(F.lag(f"last{n}").over(edges) > F.col(f"first{n}"), F.lit(False)) for n in x})
    one = files.agg(*[(~F.coalesce(F.bool_or(f"falls{n}"), F.lit(False))).alias(n) for n in x])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(n).alias("is_ordered")) for c, n in zip(columns, x)])
    return one.select(F.explode(pairs).alias("p")).select("p.column_name", "p.is_ordered")


def column_stats(df: DataFrame) -> dict[str, dict]:
    """profile() of a stored table, with by column is_ordered and, where has_histogram() says so, histogram: (lower, upper, frequency) by bucket."""
    out = profile(df)
    if not out:
        return {}
    ordered = {r["column_name"]: r["is_ordered"] for r in physical_order(df, list(out)).collect()}
    for name, found in out.items():
        found["is_ordered"] = ordered[name]
        if has_histogram(df.schema[name].dataType, found["cardinality"]):
            found["histogram"] = [tuple(r)[1:] for r in sorted(histogram(df, name).collect(), key=lambda r: r["bucket"])]  # BUCKETS rows at most
    return out
