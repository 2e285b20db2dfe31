"""The plan algebra (Scan, Filter, Project, Cross, Sort), its builder and its JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any, Iterable, Union

OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE")
LITERALS = ("I32", "I64", "F32", "F64", "String")


class PlanError(ValueError):
    """A plan that cannot be read or analysed."""


@dataclass(frozen=True)
class Value:
    """Right operand of a predicate: a typed literal, or a column (kind ``Column``)."""

    kind: str
    value: Any

    def __post_init__(self):
        v, ok = self.value, False
        if self.kind in ("I32", "I64"):
            bits = int(self.kind[1:])
            ok = isinstance(v, int) and not isinstance(v, bool) and -(1 << bits - 1) <= v < 1 << bits - 1
        elif self.kind in ("F32", "F64"):
            ok = isinstance(v, (int, float)) and not isinstance(v, bool)
        elif self.kind in ("String", "Column"):
            ok = isinstance(v, str)
        if not ok:
            raise PlanError(f"not a {self.kind}: {v!r}")


def I32(v): return Value("I32", v)  # noqa: E704,N802
def I64(v): return Value("I64", v)  # noqa: E704,N802
def F32(v): return Value("F32", v)  # noqa: E704,N802
def F64(v): return Value("F64", v)  # noqa: E704,N802
def Str(v): return Value("String", v)  # noqa: E704,N802
def Col(v): return Value("Column", v)  # noqa: E704,N802


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: Value

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise PlanError(f"unknown comparison {self.op!r}")


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


class _Builder:
    """Fluent methods; each returns a new node."""

    def filter(self, column: str, op: str, value: Value) -> "Filter":
        return self.filter_multiple([(column, op, value)])

    def filter_multiple(self, predicates: Iterable) -> "Filter":
        return Filter(self, tuple(p if isinstance(p, Predicate) else Predicate(*p) for p in predicates))

    def project(self, source: str, target: str) -> "Project":
        return self.project_multiple([(source, target)])

    def project_multiple(self, pairs: Iterable) -> "Project":
        return Project(self, tuple((a, b) for a, b in pairs))

    def cross(self, right: "Plan") -> "Cross":
        return Cross(self, right)

    def sort(self, column: str, ascending: bool = True) -> "Sort":
        return self.sort_multiple([(column, ascending)])

    def sort_multiple(self, keys: Iterable) -> "Sort":
        return Sort(self, tuple(k if isinstance(k, SortKey) else SortKey(*k) for k in keys))

    def build(self) -> "Query":
        return Query(self)


@dataclass(frozen=True)
class Scan(_Builder):
    table: str


@dataclass(frozen=True)
class Filter(_Builder):
    child: "Plan"
    predicates: tuple[Predicate, ...]


@dataclass(frozen=True)
class Project(_Builder):
    child: "Plan"
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Cross(_Builder):
    left: "Plan"
    right: "Plan"


@dataclass(frozen=True)
class Sort(_Builder):
    child: "Plan"
    keys: tuple[SortKey, ...]


Plan = Union[Scan, Filter, Project, Cross, Sort]


def scan(table: str) -> Scan:
    return Scan(table)


# --- JSON: each node is an object with one key, the operator's name -----------------


def _encode(node: Plan) -> dict:
    match node:
        case Scan(table):
            return {"Scan": {"table_id": table}}
        case Filter(child, predicates):
            rows = [{"column_name": p.column, "operator": p.op, "value": {p.value.kind: p.value.value}} for p in predicates]
            return {"Filter": {"predicates": rows, "underlying": _encode(child)}}
        case Project(child, pairs):
            return {"Project": {"column_name_map": [list(p) for p in pairs], "underlying": _encode(child)}}
        case Cross(left, right):
            return {"Cross": {"left": _encode(left), "right": _encode(right)}}
        case Sort(child, keys):
            rows = [{"column_name": k.column, "ascending": k.ascending} for k in keys]
            return {"Sort": {"sort_specs": rows, "underlying": _encode(child)}}
    raise PlanError(f"not a plan node: {node!r}")


def _fields(obj: Any, *names: str) -> list:
    if not isinstance(obj, dict) or set(obj) != set(names):
        raise PlanError(f"expected fields {', '.join(names)}, got {obj!r}")
    return [obj[n] for n in names]


def _single(obj: Any) -> tuple[str, Any]:
    if not isinstance(obj, dict) or len(obj) != 1:
        raise PlanError(f"expected an object with one key, got {obj!r}")
    return next(iter(obj.items()))


def _text(v: Any) -> str:
    if not isinstance(v, str):
        raise PlanError(f"expected a name, got {v!r}")
    return v


def _decode_value(obj: Any) -> Value:
    kind, v = _single(obj)
    if kind not in (*LITERALS, "Column"):
        raise PlanError(f"unknown value kind {kind!r}")
    return Value(kind, v)


def _decode(obj: Any) -> Plan:
    name, body = _single(obj)
    if name == "Scan":
        return Scan(_text(*_fields(body, "table_id")))
    if name == "Cross":
        left, right = _fields(body, "left", "right")
        return Cross(_decode(left), _decode(right))
    if name == "Filter":
        rows, child = _fields(body, "predicates", "underlying")
        found = [_fields(r, "column_name", "operator", "value") for r in rows]
        return Filter(_decode(child), tuple(Predicate(_text(c), op, _decode_value(v)) for c, op, v in found))
    if name == "Project":
        pairs, child = _fields(body, "column_name_map", "underlying")
        if any(not isinstance(p, list) or len(p) != 2 for p in pairs):
            raise PlanError("column_name_map takes pairs")
        return Project(_decode(child), tuple((_text(a), _text(b)) for a, b in pairs))
    if name == "Sort":
        rows, child = _fields(body, "sort_specs", "underlying")
        found = [_fields(r, "column_name", "ascending") for r in rows]
        if any(not isinstance(up, bool) for _, up in found):
            raise PlanError("ascending takes a boolean")
        return Sort(_decode(child), tuple(SortKey(_text(c), up) for c, up in found))
    raise PlanError(f"unknown operator {name!r}")


@dataclass(frozen=True)
class Query:
    root: Plan

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps({"root": _encode(self.root)}, indent=indent, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> "Query":
        try:
            obj = json.loads(text)
        except ValueError as e:
            raise PlanError(f"not JSON: {e}") from None
        return Query(_decode(*_fields(obj, "root")))
