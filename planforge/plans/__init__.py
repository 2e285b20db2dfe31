from .nodes import (  # noqa: F401
    F32, F64, I32, I64, Col, Cross, Filter, Plan, PlanError, Predicate, Project, Query, Scan, Sort, SortKey, Str, scan,
)
from .compiler import compile_query  # noqa: F401
