"""Connected components of a graph given by its links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: So many links, some 4 MB, may meet in one task: its steps need no shuffle. More stay distributed.
WHOLE = 1 << 18


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours to the least of each neighbourhood: those above the node (large), or those below it and itself."""
    if large:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    if large:
        out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; component is the least node reachable.

    Links stay distributed, unless they are WHOLE at most: each step is a minimum per node (combined before the shuffle) and a join, and
    their number never grows. Steps end when a round changes nothing, after about log(nodes) rounds.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= WHOLE:
        now = now.coalesce(1)
    mark = None
    while True:
        after = cut(_star(_star(now, True), False), "links")
        # equal as sets: same size and the same order-free digest
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now, mark = after.coalesce(1) if state[0] <= WHOLE else after, state
