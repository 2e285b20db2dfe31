"""The query suite: plans over the star schema, each with the SQL that an independent engine runs.

A row is (name, tables, predicates, order, output). The plan and the SQL are both made from it:
tables are crossed left to right, predicates are one conjunction, outputs may be renamed with AS.
An alias ("lineitem l1") renames all columns of that scan to "l1.<column>" first.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import histogram, io_cost, physical_order, profile
from .operators.sink import text_lines
from .plans import F32, F64, I32, I64, Col, Query, Str, compile_query, scan
from .sources import Catalog

#: The base tables have no part-supplier relation; it is derived from the order lines.
PARTSUPP = """SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
 CAST((l_partkey * 7 + l_suppkey * 13) % 10000 AS INTEGER) AS ps_availqty,
 CAST((l_partkey * 31 + l_suppkey * 17) % 100000 AS DOUBLE) / CAST(100 AS DOUBLE) AS ps_supplycost FROM lineitem"""

_L_KEYS = "l_orderkey, l_linenumber"
ROWS = [
    # scan and project
    ("t1_scan_nation", "nation", "", "", "n_nationkey, n_name, n_regionkey"),
    ("t2_scan_region", "region", "", "", "r_regionkey, r_name"),
    ("t3_scan_part", "part", "", "", "p_partkey, p_name, p_brand, p_type"),
    ("t4_scan_supplier", "supplier", "", "", "s_suppkey, s_name, s_acctbal"),
    ("t5_scan_customer", "customer", "", "", "c_custkey, c_name, c_mktsegment"),
    # filter
    ("t6_filter_nation", "nation", "n_regionkey = 1", "", "n_name"),
    ("t7_filter_region", "region", "r_name <> 'AFRICA'", "", "r_name"),
    ("t8_filter_part_size", "part", "p_size > 25", "", "p_name, p_size"),
    ("t9_filter_part_price", "part", "p_retailprice >= 950.0", "", "p_partkey, p_retailprice"),
    ("t10_filter_supplier", "supplier", "s_acctbal < 0.0", "", "s_name, s_acctbal"),
    ("t11_filter_customer", "customer", "c_mktsegment = 'AUTOMOBILE'", "", "c_name, c_mktsegment"),
    ("t12_filter_orders", "orders", "o_orderstatus = 'O'", "", "o_orderkey, o_totalprice"),
    ("t13_filter_lineitem", "lineitem", "l_quantity <= 10", "", "l_orderkey, l_linenumber"),
    ("t14_filter_partsupp", "partsupp", "ps_availqty > 5000", "", "ps_partkey, ps_suppkey"),
    ("t15_filter_discount", "lineitem", "l_discount >= 0.05 AND l_discount <= 0.07", "", "l_orderkey, l_discount"),
    # sort
    ("t16_sort_nation", "nation", "", "n_name, n_nationkey", "n_name"),
    ("t17_sort_region", "region", "", "r_name DESC, r_regionkey", "r_name"),
    ("t18_sort_part", "part", "", "p_brand, p_size DESC, p_partkey", "p_brand, p_size"),
    ("t19_sort_supplier", "supplier", "", "s_acctbal DESC, s_suppkey", "s_acctbal, s_name"),
    ("t20_sort_customer", "customer", "", "c_mktsegment, c_acctbal DESC, c_custkey", "c_mktsegment, c_acctbal"),
    # filter and sort
    ("t21_nation", "nation", "n_regionkey = 3", "n_name DESC, n_nationkey", "n_name"),
    ("t22_part", "part", "p_size < 10", "p_name, p_partkey", "p_name"),
    ("t23_supplier", "supplier", "s_acctbal > 5000.0", "s_acctbal DESC, s_suppkey", "s_name, s_acctbal"),
    ("t24_customer", "customer", "c_mktsegment = 'HOUSEHOLD'", "c_name, c_custkey", "c_name"),
    ("t25_orders", "orders", "o_orderstatus = 'F'", "o_totalprice DESC, o_orderkey", "o_orderkey, o_totalprice"),
    ("t26_lineitem", "lineitem", "l_shipdate > '1998-01-01'", f"l_quantity DESC, {_L_KEYS}", "l_orderkey, l_quantity"),
    ("t27_partsupp", "partsupp", "ps_availqty < 100", "ps_suppkey, ps_partkey", "ps_suppkey"),
    ("t28_lineitem", "lineitem", "l_returnflag = 'R' AND l_linestatus = 'F'", f"l_extendedprice DESC, {_L_KEYS}", "l_extendedprice"),
    ("t29_customer", "customer", "c_acctbal < 0.0", "c_name, c_custkey", "c_name"),
    ("t30_part", "part", "p_type = 'PROMO'", "p_brand, p_partkey", "p_brand"),
    # cross
    ("t31_cross", "nation, region", "", "", "n_name, r_name"),
    ("t32_cross", "supplier, region", "", "", "s_name, r_name"),
    ("t33_cross", "customer, nation", "c_custkey = 1", "", "c_name, n_name"),
    ("t34_cross", "part, partsupp", "p_partkey = 10 AND ps_suppkey = 7", "", "p_name, ps_availqty"),
    ("t35_cross", "orders, lineitem", "o_orderkey = 5 AND l_orderkey = 5", "", "o_orderkey, l_linenumber"),
    # cross and filter
    ("t36_join", "nation, region", "n_regionkey = r_regionkey", "", "n_name, r_name"),
    ("t37_join", "customer, nation", "c_nationkey = n_nationkey", "", "c_name, n_name"),
    ("t38_join", "supplier, nation", "s_nationkey = n_nationkey", "", "s_name, n_name"),
    ("t39_join", "part, partsupp", "p_partkey = ps_partkey", "", "p_name, ps_availqty"),
    ("t40_join", "supplier, partsupp", "s_suppkey = ps_suppkey", "", "s_name, ps_availqty"),
    # all together
    ("t41_full", "customer, orders", "c_custkey = o_custkey AND c_mktsegment = 'MACHINERY'", "o_totalprice DESC, c_custkey, o_orderkey", "c_name, o_totalprice"),
    ("t42_full", "orders, lineitem", "o_orderkey = l_orderkey AND o_orderstatus = 'P'", f"o_orderdate, {_L_KEYS}", "o_orderdate, l_quantity"),
    ("t43_full", "nation, region", "n_regionkey = r_regionkey AND r_name = 'EUROPE'", "n_name, n_nationkey", "n_name, r_name"),
    ("t44_full", "supplier, nation", "s_nationkey = n_nationkey AND s_acctbal > 1000.0", "s_acctbal DESC, s_suppkey", "s_name, n_name"),
    ("t45_full", "part, partsupp", "p_partkey = ps_partkey AND p_size = 50", "ps_supplycost DESC, p_partkey, ps_suppkey", "p_name, ps_supplycost"),
    ("t46_full", "customer, nation, region", "c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'", "c_name, c_custkey", "c_name, n_name"),
    ("t47_full", "part, supplier, partsupp", "p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 5", "p_brand, s_name, p_partkey, s_suppkey", "p_brand, s_name"),
    ("t48_full", "orders, customer", "o_custkey = c_custkey AND o_totalprice > 50000.0", "o_totalprice DESC, o_orderkey", "o_orderkey, c_mktsegment"),
    ("t49_full", "lineitem, part", "l_partkey = p_partkey AND l_quantity > 45", f"p_name, {_L_KEYS}", "l_linenumber, p_name"),
    ("t50_full", "supplier, part, partsupp", "s_suppkey = ps_suppkey AND p_partkey = ps_partkey AND ps_availqty < 100", "s_name, p_name, s_suppkey, p_partkey", "s_name, p_name"),
    # benchmark shapes
    ("bench_q1", "lineitem", "l_shipdate <= '1998-11-30'", f"l_returnflag, l_linestatus, {_L_KEYS}", "l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax"),
    ("bench_q2", "part, supplier, partsupp, nation, region", "p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'", "s_acctbal DESC, n_name, s_name, p_partkey, ps_suppkey", "s_acctbal, s_name, n_name, p_partkey, ps_supplycost"),
    ("bench_q3", "customer, orders, lineitem", "c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15'", f"o_orderdate, {_L_KEYS}", "l_orderkey, o_orderdate, o_orderpriority"),
    ("bench_q4", "customer, orders, lineitem, supplier, nation, region", "c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'", f"l_extendedprice DESC, l_discount DESC, {_L_KEYS}", "n_name, l_extendedprice, l_discount"),
    ("bench_q5", "lineitem", "l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount > 0.05 AND l_discount < 0.07 AND l_quantity < 24", _L_KEYS, "l_extendedprice, l_discount"),
    ("bench_q6", "customer, orders, lineitem, nation", "c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= '1996-10-01' AND o_orderdate < '1997-10-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey", f"l_extendedprice DESC, l_discount DESC, {_L_KEYS}", "c_custkey, c_name, l_extendedprice, l_discount, c_acctbal, n_name"),
    ("bench_q7", "partsupp, supplier, nation", "ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'", "ps_availqty DESC, ps_partkey, ps_suppkey", "ps_partkey, ps_supplycost, ps_availqty"),
    ("bench_q8", "supplier, nation, partsupp, part, lineitem", "s_nationkey = n_nationkey AND n_name = 'NATION_3' AND s_suppkey = ps_suppkey AND ps_partkey = p_partkey AND l_partkey = ps_partkey AND l_suppkey = ps_suppkey", f"s_name, {_L_KEYS}", "s_name, s_suppkey, ps_partkey, ps_availqty, l_quantity"),
    ("bench_q9", "supplier, lineitem l1, lineitem l2, orders, nation", "s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_tax > l1.l_discount AND l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_20'", "s_name, l1.l_orderkey, l1.l_linenumber, l2.l_orderkey, l2.l_linenumber", "s_name, l1.l_orderkey AS l1_l_orderkey, l1.l_suppkey AS l1_l_suppkey"),
    ("bench_q10", "customer, orders, lineitem, part, supplier, nation cn, nation sn, region cr, region sr", "c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND c_mktsegment = 'BUILDING' AND p_size >= 1 AND p_size <= 25 AND cr.r_name = 'ASIA' AND sr.r_name = 'EUROPE'", "c_custkey, o_orderdate, o_orderkey, l_linenumber", "c_custkey, c_name, o_orderkey, o_orderdate, l_linenumber, l_partkey, l_suppkey, p_name, s_name, cn.n_name AS cn_n_name, sn.n_name AS sn_n_name"),
    # one operator each
    ("scan_nation", "nation", "", "", "*"),
    ("scan_lineitem", "lineitem", "", "", "*"),
    ("project_subset", "part", "", "", "p_partkey, p_name"),
    ("project_rename", "customer", "", "", "c_custkey AS id, c_mktsegment AS segment"),
    ("project_reorder_dup", "region", "", "", "r_name AS a, r_regionkey AS b, r_name AS c"),
    ("filter_conjunction", "lineitem", "l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax > 0.05", "", "l_orderkey, l_linenumber"),
    ("filter_eq", "nation", "n_regionkey = 1", "", "n_name"),
    ("filter_ne", "region", "r_name <> 'AFRICA'", "", "r_name"),
    ("filter_gt", "part", "p_size > 25", "", "p_name, p_size"),
    ("filter_gte", "part", "p_retailprice >= 950.0", "", "p_partkey, p_retailprice"),
    ("filter_lt", "supplier", "s_acctbal < 0.0", "", "s_name, s_acctbal"),
    ("filter_lte", "lineitem", "l_quantity <= 10", "", "l_orderkey, l_linenumber"),
    ("filter_col_col", "lineitem", "l_tax > l_discount", "", "l_orderkey, l_linenumber"),
    ("filter_lit_i32", "customer", "c_nationkey = 3", "", "c_name"),
    ("filter_lit_i64", "orders", "o_custkey = CAST(7 AS BIGINT)", "", "o_orderkey"),
    ("filter_lit_f32", "lineitem", "l_quantity > CAST(45.5 AS FLOAT)", "", "l_orderkey"),
    ("filter_lit_f64", "orders", "o_totalprice > 450000.0", "", "o_orderkey"),
    ("filter_lit_string", "customer", "c_mktsegment = 'HOUSEHOLD'", "", "c_custkey"),
    ("filter_mixed_numeric", "lineitem", "l_linenumber >= l_quantity", "", "l_orderkey"),
    ("filter_date_range", "lineitem", "l_shipdate >= '1996-01-01' AND l_shipdate < '1996-02-01'", "", "l_orderkey, l_shipdate"),
    ("filter_range", "lineitem", "l_discount >= 0.05 AND l_discount <= 0.07", "", "l_orderkey, l_discount"),
    ("cross_join", "nation, region", "", "", "n_name, r_name"),
    ("join_equi", "customer, nation", "c_nationkey = n_nationkey", "", "c_name, n_name"),
    ("join_equi_shuffle", "orders, lineitem", "o_orderkey = l_orderkey", "", "o_orderdate, l_quantity"),
    ("join_equi_reversed", "supplier, nation", "n_nationkey = s_nationkey", "", "s_name, n_name"),
    ("join_multi_key", "lineitem, partsupp", "l_partkey = ps_partkey AND l_suppkey = ps_suppkey", "", "l_orderkey, ps_availqty"),
    ("join_equi_residual", "nation a, nation b", "a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey", "", "a.n_name AS a_name, b.n_name AS b_name"),
    ("join_theta", "nation, region", "n_regionkey < r_regionkey", "", "n_name, r_name"),
    ("join_mixed_key_types", "supplier, nation", "s_suppkey = n_nationkey", "", "s_name, n_name"),
    ("join_nway", "customer, nation, region", "c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'", "", "c_name, n_name, r_name"),
    ("join_self_renamed", "lineitem l1, lineitem l2", "l1.l_orderkey = l2.l_orderkey AND l1.l_suppkey <> l2.l_suppkey AND l1.l_tax > l1.l_discount AND l1.l_quantity > 45", "", "l1.l_orderkey AS l1_orderkey, l1.l_suppkey AS l1_suppkey, l2.l_suppkey AS l2_suppkey"),
    ("sort_asc", "nation", "", "n_name", "n_name"),
    ("sort_desc", "region", "", "r_name DESC", "r_name"),
    ("sort_multi", "part", "", "p_brand, p_size DESC, p_partkey", "p_brand, p_size, p_partkey"),
    ("sort_large", "lineitem", "", f"l_returnflag, l_linestatus, {_L_KEYS}", "l_returnflag, l_linestatus, l_quantity, l_extendedprice"),
    ("sort_physically_ordered", "customer", "", "c_name, c_custkey", "c_name"),
    ("sort_hidden_key", "supplier", "", "s_acctbal DESC, s_suppkey", "s_name"),
    ("join_filter_sort_project", "customer, orders", "c_custkey = o_custkey AND c_mktsegment = 'MACHINERY'", "o_totalprice DESC, c_custkey, o_orderkey", "c_name, o_totalprice"),
]

_OPS = {"=": "EQ", "<>": "NE", ">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE"}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog(spark, sf_dir)
    return out.register("partsupp", lambda: _partsupp(out))


def _partsupp(c: Catalog) -> DataFrame:
    pairs = c.table("lineitem").select("l_partkey", "l_suppkey").distinct()
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return pairs.select(a.alias("ps_partkey"), b.alias("ps_suppkey"), ((a * 7 + b * 13) % 10000).cast("int").alias("ps_availqty"), (((a * 31 + b * 17) % 100000).cast("double") / 100.0).alias("ps_supplycost"))


def _operand(text: str):
    if m := re.fullmatch(r"'(.*)'", text):
        return Str(m[1])
    if m := re.fullmatch(r"CAST\((.*) AS (BIGINT|FLOAT)\)", text):
        return I64(int(m[1])) if m[2] == "BIGINT" else F32(float(m[1]))
    if re.fullmatch(r"-?\d+", text):
        return I32(int(text))
    return F64(float(text)) if re.fullmatch(r"-?\d+\.\d+", text) else Col(text)


def plan(c: Catalog, tables: str, predicates: str, order: str, output: str) -> Query:
    node = None
    for t in tables.split(", "):
        name, _, alias = t.partition(" ")
        leaf = scan(name)
        if alias:
            leaf = leaf.project_multiple([(x, f"{alias}.{x}") for x in c.table(name).columns])
        node = leaf if node is None else node.cross(leaf)
    if predicates:
        node = node.filter_multiple([(a, _OPS[op], _operand(b)) for a, op, b in (p.split(" ", 2) for p in predicates.split(" AND "))])
    if order:
        node = node.sort_multiple([(k.split(" ")[0], not k.endswith(" DESC")) for k in order.split(", ")])
    if output != "*":
        node = node.project_multiple([(x.split(" AS ")[0], x.split(" AS ")[-1]) for x in output.split(", ")])
    return node.build()


def sql(tables: str, predicates: str, order: str, output: str) -> str:
    with_ = f"WITH partsupp AS ({PARTSUPP}) " if "partsupp" in tables else ""
    return f"{with_}SELECT {output} FROM {tables}" + f" WHERE {predicates}" * bool(predicates) + f" ORDER BY {order}" * bool(order)


#: Plans that the row form above cannot write: (plan, SQL).
PLANS = {
    "filter_incomparable_ne": (lambda: scan("region").filter("r_name", "NE", I32(1)).project("r_name", "r_name"), "SELECT r_name FROM region"),
    "filter_incomparable_eq": (lambda: scan("region").filter("r_name", "EQ", I32(1)).project("r_name", "r_name"), "SELECT r_name FROM region WHERE FALSE"),
    "filter_stacked": (lambda: scan("customer").filter("c_acctbal", "GT", F64(0.0)).filter("c_nationkey", "LT", I32(5)).project("c_name", "c_name"), "SELECT c_name FROM customer WHERE c_acctbal > 0.0 AND c_nationkey < 5"),
    "cross_filtered": (lambda: scan("orders").filter("o_orderkey", "EQ", I64(5)).cross(scan("lineitem").filter("l_orderkey", "EQ", I64(5))).project_multiple([("o_orderkey", "o_orderkey"), ("l_linenumber", "l_linenumber")]), "SELECT o_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderkey = 5) o, (SELECT * FROM lineitem WHERE l_orderkey = 5) l"),
    "cross_dup_names": (lambda: scan("region").cross(scan("region")).filter("r_regionkey", "EQ", I32(1)).project("r_name", "r_name"), "SELECT a.r_name AS r_name FROM region a, region b WHERE a.r_regionkey = 1"),
}


def _stats(spark, d, table, column, keys, exact=False) -> DataFrame:
    found = profile(catalog(spark, d).table(table), [column], exact)[column]
    return spark.createDataFrame([tuple(found[k] for k in keys)], list(keys))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    """A request for each order line, by supplier as disk."""
    lines = catalog(spark, d).table("lineitem")
    return io_cost(lines.select(F.col("l_suppkey").alias("disk_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"), (F.col("l_partkey") * 64).alias("start"), F.col("l_quantity").cast("long").alias("n"))).drop("seq")


def _sketched(spark: SparkSession, d: str) -> DataFrame:
    """Whether the statistics' distinct count, a sketch where there are many values, is within four of its errors."""
    df = catalog(spark, d).table("lineitem")
    found = profile(df, ["l_orderkey"])["l_orderkey"]["cardinality"]
    exact = F.count_distinct("l_orderkey")
    return df.agg(F.lit("l_orderkey").alias("column_name"), exact.alias("exact"), (F.abs(F.lit(found) - exact) <= 0.065 * exact).alias("within"))


_ORDER_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, NOT coalesce(bool_or(falls), FALSE) AS is_ordered FROM (SELECT lag({c}) OVER (ORDER BY i) > {c} AS falls FROM (SELECT {c}, row_number() OVER () AS i FROM customer))"
    for c in ("c_custkey", "c_name", "c_acctbal")
)


_IO_SQL = """WITH t AS (SELECT l_suppkey AS disk_id, l_partkey * 64 AS start, CAST(l_quantity AS BIGINT) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
c AS (SELECT *, lag(start + n - 1) OVER (PARTITION BY disk_id ORDER BY i) AS last, start // 4096 AS here, (start + n - 1) // 4096 AS there FROM t),
k AS (SELECT *, abs(here - coalesce(last // 4096, 0)) AS dist FROM c),
m AS (SELECT disk_id, start, n, CASE WHEN dist = 0 THEN CAST(0 AS DOUBLE) WHEN dist = 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) + (CAST(18 AS DOUBLE) - CAST(0.8 AS DOUBLE)) * sqrt(least(CAST(1 AS DOUBLE), CAST(dist AS DOUBLE) / CAST(500000 AS DOUBLE))) END + CAST(0.8 AS DOUBLE) * (there - here) AS seek_ms,
 CASE WHEN coalesce(last + 1 = start, FALSE) THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) * 60000 / 7200 END AS rotation_ms, CAST(n * 4096 AS DOUBLE) / CAST(1000000 AS DOUBLE) / CAST(150 AS DOUBLE) * 1000 AS transfer_ms FROM k)
SELECT *, seek_ms + rotation_ms + transfer_ms AS total_ms FROM m"""


#: Queries that are no plans: (function, SQL or None).
FUNCTIONS: dict[str, tuple[Callable, str | None]] = {
    "stats_count": (lambda s, d: _stats(s, d, "orders", "o_orderkey", ["total_count"]).select(F.lit("orders").alias("table_name"), "total_count"), "SELECT 'orders' AS table_name, count(*) AS total_count FROM orders"),
    "stats_range": (lambda s, d: _stats(s, d, "orders", "o_totalprice", ["lower_bound", "upper_bound"]), "SELECT min(o_totalprice) AS lower_bound, max(o_totalprice) AS upper_bound FROM orders"),
    "stats_cardinality": (lambda s, d: _stats(s, d, "supplier", "s_name", ["cardinality"], exact=True), "SELECT count(DISTINCT s_name) AS cardinality FROM supplier"),
    "stats_cardinality_approx": (_sketched, "SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) AS exact, TRUE AS within FROM lineitem"),
    "stats_density": (lambda s, d: _stats(s, d, "lineitem", "l_suppkey", ["density"], exact=True), "SELECT least(CAST(1 AS DOUBLE), CAST(count(DISTINCT l_suppkey) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS density FROM lineitem"),
    "stats_histogram": (lambda s, d: histogram(catalog(s, d).table("part"), "p_size"), "SELECT b AS bucket, min(x) AS lower_bound, max(x) AS upper_bound, count(*) AS frequency FROM (SELECT x, (rn - 1) // CAST(ceil(n / 10.0) AS BIGINT) AS b FROM (SELECT p_size AS x, row_number() OVER (ORDER BY p_size) AS rn, count(*) OVER () AS n FROM part)) GROUP BY b"),
    "stats_physical_order": (lambda s, d: physical_order(catalog(s, d).table("customer"), ["c_custkey", "c_name", "c_acctbal"]), _ORDER_SQL),
    "io_cost_model": (_trace, _IO_SQL),
    "sink_pipe_text": (lambda s, d: text_lines(catalog(s, d).table("supplier").select("s_suppkey", "s_name", "s_acctbal")), "SELECT CAST(s_suppkey AS VARCHAR) || '|' || s_name || '|' || CAST(s_acctbal AS VARCHAR) || '|' AS line FROM supplier"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of_row(row):
        return lambda s, d: compile_query(plan(c := catalog(s, d), *row), c)

    def of_plan(make):
        return lambda s, d: compile_query(make().build(), catalog(s, d))

    out = {name: of_row(row) for name, *row in ROWS}
    out |= {name: of_plan(make) for name, (make, _) in PLANS.items()}
    return out | {name: f for name, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql(*row) for name, *row in ROWS}
    out |= {name: text for name, (_, text) in PLANS.items()}
    return out | {name: text for name, (_, text) in FUNCTIONS.items() if text}
