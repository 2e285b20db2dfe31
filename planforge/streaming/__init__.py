"""Stateless plans over streams.

Scan, Filter and Project compile to the same DataFrame calls whether a table is static or a
stream, so a catalog that holds a streaming DataFrame is all that such a plan needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import Query, Sort, compile_query


def compile_stream(query: Query, catalog) -> DataFrame:
    """As compile_query; a plan that sorts is refused, as a stream has no end to sort."""
    todo = [query.root]
    while todo:
        node = todo.pop()
        if isinstance(node, Sort) and node.keys:
            raise ValueError("a stream cannot be sorted")
        todo += [getattr(node, n) for n in ("child", "left", "right") if hasattr(node, n)]
    return compile_query(query, catalog)
