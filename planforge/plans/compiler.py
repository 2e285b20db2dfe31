"""Analysis and compilation of a plan to one lazy DataFrame.

Every scanned column gets an internal id, so duplicate and dotted public names are legal and
a name means the first column that bears it. Project only renames entries of that list and
Sort only records keys; Catalyst then sees scans, cross joins, filters, at most one sort and one
final select, and does pushdown, pruning, join extraction and join ordering by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compare import compare, literal
from .nodes import Cross, Filter, PlanError, Predicate, Project, Query, Scan, Sort


@dataclass
class _Relation:
    df: DataFrame
    columns: list[tuple[str, str, T.DataType]]  # public name, internal id, type
    order: list[Column] = field(default_factory=list)

    def find(self, name: str) -> tuple[str, T.DataType]:
        for public, internal, dtype in self.columns:
            if public == name:
                return internal, dtype
        raise PlanError(f"unknown column {name!r}; there are {', '.join(c[0] for c in self.columns)}")


def _predicate(rel: _Relation, p: Predicate) -> Column:
    name, dtype = rel.find(p.column)
    if p.value.kind == "Column":
        other, other_type = rel.find(p.value.value)
        return compare(p.op, F.col(name), dtype, F.col(other), other_type)
    lit, lit_type = literal(p.value.kind, p.value.value)
    if p.value.kind[0] == "F":
        return compare(p.op, F.col(name), dtype, lit, lit_type, struct_value(p.value))
    if isinstance(dtype, (T.FloatType, T.DoubleType)) and p.value.kind[0] == "I":
        return compare(p.op, F.col(name), dtype, lit, lit_type, p.value.value)
    return compare(p.op, F.col(name), dtype, lit, lit_type)


def struct_value(value) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", value.value))[0] if value.kind == "F32" else float(value.value)


def _build(node, catalog, ids) -> _Relation:
    match node:
        case Scan(table):
            df = catalog.table(table)
            named = [(f.name, f"c{next(ids)}", f.dataType) for f in df.schema.fields]
            return _Relation(df.toDF(*[n for _, n, _ in named]), named)
        case Filter(child, predicates):
            rel = _build(child, catalog, ids)
            for p in predicates:
                rel.df = rel.df.filter(_predicate(rel, p))
            return rel
        case Project(child, pairs):
            rel = _build(child, catalog, ids)
            if not pairs:
                raise PlanError("a projection needs at least one column")
            rel.columns = [(to, *rel.find(source)) for source, to in pairs]
            return rel
        case Cross(left, right):
            a, b = _build(left, catalog, ids), _build(right, catalog, ids)
            return _Relation(a.df.crossJoin(b.df), a.columns + b.columns)  # no order survives a join
        case Sort(child, keys):
            rel = _build(child, catalog, ids)
            outer = [(F.col(rel.find(k.column)[0]).asc() if k.ascending else F.col(rel.find(k.column)[0]).desc()) for k in keys]
            rel.order = outer + rel.order  # an inner sort breaks the ties of an outer one
            return rel
    raise PlanError(f"not a plan node: {node!r}")


def compile_query(query: Query, catalog) -> DataFrame:
    """The query's result. Unknown tables and columns raise PlanError here, not at run time."""
    rel = _build(query.root, catalog, count())
    df = rel.df.orderBy(*rel.order) if rel.order else rel.df
    return df.select(*[F.col(internal).alias(public) for public, internal, _ in rel.columns])
