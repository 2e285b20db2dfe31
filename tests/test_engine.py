import json
import math

import pytest
from pyspark.sql import types as T

from planforge.operators import histogram, io_cost, physical_order, profile, same_multiset, same_order, write_text
from planforge.plans import F32, F64, I32, I64, Col, PlanError, Query, Str, compile_query, scan
from planforge.sources import Catalog, compile_dataset, load_dataset, write_dataset
from planforge.streaming import compile_stream

SAMPLE = '{"root":{"Project":{"column_name_map":[["a1","id"],["b2","b2"]],"underlying":{"Sort":{"sort_specs":[{"column_name":"a2","ascending":true},{"column_name":"b2","ascending":false}],"underlying":{"Filter":{"predicates":[{"column_name":"b3","operator":"GTE","value":{"I32":0}}],"underlying":{"Filter":{"predicates":[{"column_name":"a1","operator":"EQ","value":{"Column":"b1"}}],"underlying":{"Cross":{"left":{"Scan":{"table_id":"A"}},"right":{"Scan":{"table_id":"B"}}}}}}}}}}}}}'


def cat(spark, **tables):
    out = Catalog(spark)
    for name, (schema, rows) in tables.items():
        out.register(name, spark.createDataFrame(rows, schema))
    return out


def run(q, c):
    return [tuple(r) for r in compile_query(q.build(), c).collect()]


def test_wire_round_trip():
    q = Query.from_json(SAMPLE)
    assert json.loads(q.to_json()) == json.loads(SAMPLE)
    built = scan("A").cross(scan("B")).filter("a1", "EQ", Col("b1")).filter("b3", "GTE", I32(0)).sort_multiple([("a2", True), ("b2", False)]).project_multiple([("a1", "id"), ("b2", "b2")]).build()
    assert built == q


@pytest.mark.parametrize("text", ['{"root":{"Limit":{}}}', '{"root":{"Scan":{}}}', "[", '{"root":{"Filter":{"predicates":[{"column_name":"a","operator":"LIKE","value":{"I32":1}}],"underlying":{"Scan":{"table_id":"A"}}}}}', '{"root":{"Filter":{"predicates":[{"column_name":"a","operator":"EQ","value":{"I32":3000000000}}],"underlying":{"Scan":{"table_id":"A"}}}}}'])
def test_wire_errors(text):
    with pytest.raises(PlanError):
        Query.from_json(text)


TYPES = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])
VALUES = [(1, 1, 0.5, 0.5, "1"), (-1, 2**53, math.nan, math.nan, ""), (0, 2**53 + 1, -0.0, -0.0, "a"), (2147483647, -(2**63), math.inf, math.inf, "é")]
PY = {"EQ": lambda a, b: a == b, "NE": lambda a, b: a != b, "GT": lambda a, b: a > b, "GTE": lambda a, b: a >= b, "LT": lambda a, b: a < b, "LTE": lambda a, b: a <= b}


def expected(op, a, b):
    if isinstance(a, str) != isinstance(b, str):
        return op == "NE"
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    elif isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
    return PY[op](a, b)


@pytest.mark.parametrize("op", list(PY))
def test_comparison_table(spark, op):
    from pyspark.sql import functions as F

    from planforge.functions import compare

    kinds = dict(zip("ilfds", (f.dataType for f in TYPES.fields)))
    both = spark.createDataFrame(VALUES, TYPES).crossJoin(spark.createDataFrame(VALUES, TYPES).toDF(*[f"u{x}" for x in "ilfds"]))
    held = [F.sum(compare(op, F.col(a), kinds[a], F.col(f"u{b}"), kinds[b]).cast("int")) for a in "ilfds" for b in "ilfds"]
    want = [sum(expected(op, x[k], y[m]) for x in VALUES for y in VALUES) for k in range(5) for m in range(5)]
    assert list(both.agg(*held).first()) == want
    c = cat(spark, t=(TYPES, VALUES))
    for k, a in enumerate("id"):
        for lit, v in ((I64(2**53), 2**53), (F32(0.5), 0.5), (F64(math.nan), math.nan), (Str("a"), "a")):
            assert len(run(scan("t").filter(a, op, lit), c)) == sum(expected(op, x["ilfds".index(a)], v) for x in VALUES), (a, lit)


def test_mixed_key_join_and_duplicates(spark):
    c = cat(spark, k32=("k int", [(1,), (2,), (3,)]), k64=("k2 long", [(2,), (3,), (4,)]), dup=("a int", [(1,), (2,)]), empty=("a int", []))
    assert len(run(scan("k32").cross(scan("k64")).filter("k", "EQ", Col("k2")), c)) == 2
    assert len(run(scan("dup").cross(scan("dup")).filter("a", "EQ", I32(1)), c)) == 2
    assert run(scan("empty").sort("a"), c) == [] and run(scan("dup").cross(scan("empty")), c) == []
    for bad in (scan("nope"), scan("dup").filter("x", "EQ", I32(1)), scan("dup").sort("x"), scan("dup").project("x", "y"), scan("dup").project_multiple([])):
        with pytest.raises(PlanError):
            compile_query(bad.build(), c)
    assert len(run(scan("dup").filter_multiple([]).sort_multiple([]), c)) == 2


def test_nested_sorts(spark):
    c = cat(spark, ties=("a int, b int", [(1, 2), (1, 1), (0, 3)]))
    assert run(scan("ties").sort("b").filter("b", "GT", I32(0)).sort("a"), c) == [(0, 3), (1, 1), (1, 2)]
    assert run(scan("ties").sort("b", False).project("a", "x"), c) == [(0,), (1,), (1,)]


def test_pushdown_and_pruning(spark):
    from planforge import suite

    text = suite.queries()["bench_q3"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    assert "GreaterThan(l_shipdate,1995-03-15" in text and "l_extendedprice" not in text.split("Physical Plan")[1]


def test_ingest_and_sink(spark, tmp_path):
    (tmp_path / "tail.csv").write_text("1|a|\n2||\n\n")
    (tmp_path / "tail.schema").write_text("k|s|\ni32|STRING|\n")
    (tmp_path / "lone.csv").write_text("1|\n")
    tables = load_dataset(spark, str(tmp_path))
    assert list(tables) == ["tail"] and sorted(map(tuple, tables["tail"].collect())) == [(1, "a"), (2, "")]
    write_dataset(tables, str(tmp_path / "out"))
    c = Catalog(spark, str(tmp_path / "out"))
    c.describe("tail", profile(c.table("tail")))
    again = Catalog.load(spark, c.to_json(), str(tmp_path / "out"))
    write_text(again.table("tail").orderBy("k"), str(tmp_path / "txt"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert same_multiset(lines, ["2||", "1|a|"]) is None and same_order(["a"], ["b"]).startswith("line 1")
    (tmp_path / "tail.csv").write_text("1|a|b|\n")
    with pytest.raises(Exception):
        load_dataset(spark, str(tmp_path))["tail"].collect()


def test_compiled_dataset(spark, tmp_path, caplog):
    """A folder becomes Parquet and a catalog with statistics that loads again."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("".join(f"{i}|n{i % 3}|u{i}|{i % 7}.5|\n" for i in range(60)))
    (tmp_path / "in" / "t.schema").write_text("k|s|u|d|\nI64|STRING|STRING|FLOAT64|\n")
    (tmp_path / "in" / "lone.csv").write_text("1|\n")
    compile_dataset(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert "lone" in caplog.text
    text = spark.read.text(str(tmp_path / "out" / "catalog.json")).first()[0]
    again = Catalog.load(spark, text, str(tmp_path / "out"))
    assert again.table("t").count() == 60
    k, s, u, d = (c["stats"] for c in again.specs["t"]["column_specs"])
    assert k[:4] == ["IsPhysicallyOrdered", {"RangeStat": {"lower_bound": {"Int64": 0}, "upper_bound": {"Int64": 59}}}, {"CardinalityStat": 60}, {"DensityStat": 1.0}]
    assert [p[1] for p in k[4]["HistogramStat"]["frequency_points"]] == [6] * 10 and k[4]["HistogramStat"]["frequency_points"][0][0] == {"lower_bound": {"Int64": 0}, "upper_bound": {"Int64": 5}}
    assert s[0] == {"CardinalityStat": 3} and "HistogramStat" in s[2] and u == [{"CardinalityStat": 60}, {"DensityStat": 1.0}] and d[0]["RangeStat"]["upper_bound"] == {"Float64": 6.5}


def test_float_text(spark):
    from planforge.functions import pipe_line

    values = [27.0, 12345678.25, 1e7, 1e-4, -0.0, 0.05, 39890.88, -821.16, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    assert [r[0] for r in df.select(pipe_line(df)).collect()] == ["27.0|", "12345678.25|", "10000000.0|", "0.0001|", "-0.0|", "0.05|", "39890.88|", "-821.16|", "NaN|", "Inf|", "-Inf|", "|"]


def test_stats(spark, tmp_path):
    df = spark.range(1, 26).select("id")
    got = sorted(map(tuple, histogram(df, "id").collect()))
    assert [r[3] for r in got] == [3] * 8 + [1] and got[0][:3] == (0, 1, 3)
    hot = spark.createDataFrame([(7,)] * 95 + [(i,) for i in range(5)], "x int")
    assert sum(r[3] for r in histogram(hot, "x").collect()) == 100
    assert profile(spark.createDataFrame([], "a int")) == {}
    assert profile(hot)["x"] == {"total_count": 100, "cardinality": 6, "density": 0.06, "lower_bound": 0, "upper_bound": 7}
    spark.range(100).selectExpr("id", "-id as down").coalesce(1).write.parquet(str(tmp_path / "o"))
    assert {tuple(r) for r in physical_order(spark.read.parquet(str(tmp_path / "o")), ["id", "down"]).collect()} == {("id", True), ("down", False)}


def test_io_cost(spark):
    trace = spark.createDataFrame([(0, 0, 0, 64), (0, 1, 64, 64), (0, 2, 4096 * 10, 1)], "disk_id int, seq int, start long, n long")
    a, b, c = io_cost(trace).orderBy("seq").collect()
    assert (a.seek_ms, b.rotation_ms) == (0, 0) and abs(c.rotation_ms - 4.1667) < 1e-3 and abs(b.transfer_ms - 64 * 4096 / 1e6 / 150 * 1000) < 1e-9
    assert abs(c.seek_ms - (0.8 + 17.2 * math.sqrt(10 / 500000))) < 1e-9


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    c = Catalog(spark).register("t", spark.readStream.schema("id long").parquet(str(tmp_path / "in")))
    df = compile_stream(scan("t").filter("id", "GT", I64(6)).project("id", "x").build(), c)
    q = df.writeStream.format("memory").queryName("planforge_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("planforge_stream").collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        compile_stream(scan("t").sort("id").build(), c)
