"""Text sink, and comparison of results with expected lines."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame

from ..functions.render import pipe_line


def text_lines(df: DataFrame, name: str = "line") -> DataFrame:
    return df.select(pipe_line(df).alias(name))


def write_text(df: DataFrame, path: str) -> None:
    """Part files follow the order of a sorted DataFrame."""
    text_lines(df, "value").write.mode("overwrite").text(path)


def same_order(lines: Iterable[str], expected: Iterable[str]) -> str | None:
    """None, or the first difference; lines are compared without outer white space."""
    a, b = ([x.strip() for x in side] for side in (lines, expected))
    for i, (x, y) in enumerate(zip(a, b), 1):
        if x != y:
            return f"line {i}: {x!r} instead of {y!r}"
    return None if len(a) == len(b) else f"{len(a)} lines instead of {len(b)}"


def same_multiset(lines: Iterable[str], expected: Iterable[str]) -> str | None:
    a, b = (sorted(x.strip() for x in side) for side in (lines, expected))
    return f"{len(a)} lines instead of {len(b)}" if len(a) != len(b) else same_order(a, b)
