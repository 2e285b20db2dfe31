"""Pairs of texts whose shingles are alike, by banded minima and an exact check.

A text is its set of SIZE-word shingles. Of BANDS keys, each made of the least values of its shingles under ROWS hashes, two texts
of Jaccard similarity s share one with chance 1 - (1 - s^ROWS)^BANDS: 0.9997 at 0.8. Texts that share a key are
candidates, and their sets verify them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, few
from .components import components
from .tokens import mixed

SIZE, BANDS, ROWS, SEED = 5, 20, 5, 42
#: Members of a key that meet in one task; the ones before it that each of them is compared with, the nearest first: what that ties needs no more comparison.
CHUNK, BEFORE = 64, (4,)
#: Members of a shingle that meet those of other components in one place; a shingle of more is dealt out.
PART = 2048
#: Buckets of the counts by which a task tells rare shingles, 4 MB; with over LOAD shingles a bucket each is counted for itself, and the counts are joined.
BUCKETS, LOAD = 1 << 20, 8
#: Rounding may only add pairs.
NEAR = 1e-6
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SIZE + 1)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(words[a : a + SIZE]), SEED) for a in range(n)), np.uint64, n))


def keys(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(found), 2048):  # bounded memory for long texts
        least = np.minimum(least, (found[None, lo : lo + 2048] * _TIMES[:, None]).min(1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out ^ mixed(row))
    return out.view(np.int64).tolist()


def digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            each = [shingles(x.as_py()) for x in b.column(1).slice(lo, 256)]
            sets = pa.array([x.view(np.int64) for x in each], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), sets], names=["s", "set"])


def _alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b, fa, fb): the pairs whose sets have a Jaccard similarity of ``similar`` or more. A set of many pairs is dealt out."""
    fits = F.least("na", "nb") >= F.lit(similar) * F.greatest("na", "nb")
    pairs = cut(pairs.filter(fits).groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("fa", "fb")]), "pairs")
    times = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times"))
    left = sets.join(times.withColumnRenamed("a", "s"), "s").select(F.col("s").alias("a"), "times", F.col("set").alias("sa"))
    both = attach(pairs, left, "a", "times", pairs.count(), "inner", "b").join(sets.select(F.col("s").alias("b"), F.col("set").alias("sb")), "b")
    met = F.size(F.array_intersect("sa", "sb"))
    every = F.size("sa") + F.size("sb") - met
    return cut(both.filter(met >= F.lit(similar) * every).select("a", "b", "fa", "fb"), "alike")


def _first(counts: np.ndarray, similar: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                ends, values = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy()
                rows, tokens, places = [], [], []
                for i in range(b.num_rows):
                    x = values[ends[i] : ends[i + 1]]
                    seen = counts[x & (BUCKETS - 1)]
                    order = np.lexsort((x, seen))[: len(x) - math.ceil(similar * len(x) - NEAR) + 1]
                    shared = np.flatnonzero(seen[order] > 1)
                    rows.append(np.full(len(shared), i))
                    tokens.append(x[order[shared]])
                    places.append(shared + 1)
                if rows:
                    at = pa.array(np.concatenate(rows))
                    made = [pa.array(np.concatenate(x).astype(np.int64)) for x in (tokens, places)]
                    yield pa.RecordBatch.from_arrays([*[b.column(j).take(at) for j in range(4)], *made], names=["s", "fp", "size", "component", "token", "pos"])

    return find


def _by_bucket(held: DataFrame, similar: float) -> DataFrame:
    """The shingles that come first in their set, ordered by the counts of their buckets: no more than BUCKETS numbers, whatever the crowd, go to the tasks."""
    found = held.select(F.explode("set").alias("token")).groupBy(F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int32)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return held.select("s", "fp", "size", "component", "set").mapInArrow(_first(counts, similar), "s long, fp long, size long, component long, token long, pos long")


def _by_shingle(held: DataFrame, similar: float) -> DataFrame:
    """The shingles that come first in their set, ordered by their own counts."""
    every = cut(held.select("s", "fp", "size", "component", F.explode("set").alias("token")), "tokens")
    counts = cut(every.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "counts")
    ranked = attach(every, counts, "token", "df", every.count(), "inner", "s").withColumn("pos", F.row_number().over(Window.partitionBy("s").orderBy("df", "token")).cast("long"))
    return ranked.filter((F.col("pos") <= F.col("size") - F.ceil(F.lit(similar) * F.col("size") - NEAR) + 1) & (F.col("df") > 1)).drop("df")


def _crowded(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs for _alike() that hold all alike members (s, fp, size, component; s distinct) of different components.

    Shingles are ordered by how many members have them, or their buckets, rare ones first. The first shingle that two alike sets of x and y
    have in common stands, in both, so far ahead that what follows can make up similar / (1 + similar) * (x + y); only members that share such a
    one are paired. Any order that is the same for all members will do. In a shingle those outside its largest component meet all, so a crowd that is tied makes no pairs.
    """
    held = cut(members.select("s", "fp", "size", "component").join(sets, "s"), "crowded")
    total = held.agg(F.sum("size")).first()[0] or 0
    ahead = cut(_by_bucket(held, similar) if total <= LOAD * BUCKETS else _by_shingle(held, similar), "ahead")
    by = ahead.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    of = by.groupBy("token").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("parts"))
    held = cut(attach(ahead, cut(of.filter("parts > 1").drop("parts"), "tokens"), "token", "all", ahead.count(), "inner", "s"), "held")
    parts = F.ceil(F.col("all") / PART).cast("int")
    here = held.withColumn("part", F.pmod(F.xxhash64("s"), parts).cast("int")).alias("x")
    other = held.filter("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    follow = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos")) + 1 >= F.lit(similar / (1 + similar)) * (F.col("x.size") + F.col("y.size")) - NEAR
    once = (F.col("x.component") == F.col("x.main")) | (F.col("x.s") < F.col("y.s"))
    pairs = here.join(other, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") != F.col("y.component")) & once & follow)
    return _ends(pairs, "x", "y")


def _ends(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """a, b, fa, fb, na, nb of pairs of x and y, the lesser s first."""
    less = F.col(f"{x}.s") < F.col(f"{y}.s")
    return pairs.select(*[F.when(less, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(name) for c, names in (("s", "ab"), ("fp", ("fa", "fb")), ("size", ("na", "nb"))) for name, p, q in zip(names, (x, y), (y, x))])


def ties(prints: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(a, b) that tie fingerprints of texts that are alike.

    prints: row, fp, s (digest of the set), size (of the set), bands. texts: row, t. All members of a key are compared with its
    least; then those that this has left in different components, in chunks of CHUNK or so: each with those
    before it, by passes, which is every one if a key has no more members than the last of BEFORE, and one. Members of larger keys
    that are still in different components are joined by their rare shingles, so no pair that shares a key is lost.
    """
    known = prints.filter(F.col("size") > 0)
    by_print = cut(known.groupBy("s", "fp").agg(F.min("row").alias("row"), F.min("size").alias("size"), F.any_value("bands").alias("bands")), "members")
    one = by_print.groupBy("s").agg(F.min(F.struct("fp", "row")).alias("m"), F.count(F.lit(1)).alias("n"))
    equal = by_print.join(one.filter("n > 1"), "s").select(F.col("m.fp").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    members = by_print.join(one.select("s", F.col("m.fp").alias("fp")), ["s", "fp"])
    every = members.select("s", "fp", "size", F.explode("bands").alias("key"))
    shared = cut(every.groupBy("key").agg(F.min(F.struct("s", "fp", "size")).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    mine = cut(attach(every, shared, "key", "n", members.count() * BANDS, "inner", "s"), "mine")
    wanted = cut(members.select("s", "row").join(mine.select("s").distinct(), "s", "left_semi"), "wanted")
    sets = cut(texts.join(few(wanted), "row").select("s", "t").dropDuplicates(["s"]).mapInArrow(_sets, "s long, set array<long>"), "sets")
    star = mine.filter("lead.s <> s").select(F.col("lead.s").alias("a"), F.col("s").alias("b"), F.col("lead.fp").alias("fa"), F.col("fp").alias("fb"), F.col("lead.size").alias("na"), F.col("size").alias("nb"))
    found = _alike(star, sets, similar)

    def parted() -> DataFrame:
        """Members of the keys whose members are in different components, with their components."""
        placed = components(found.select("a", "b")).withColumnRenamed("node", "s")
        left = mine.select("key", "n", "s", "fp", "size").join(placed, "s", "left").withColumn("component", F.coalesce("component", "s"))
        left = cut(left, "placed")
        apart = cut(left.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key"), "parted")
        return left.join(few(apart), "key", "left_semi")

    for nearer, upto in zip((0, *BEFORE), BEFORE):
        left = parted()
        if left.isEmpty():
            break
        # all members keep their place in the chunk's order, so each pass takes up where the last one ended
        left = left.withColumn("chunk", F.pmod(F.xxhash64("s"), F.ceil(F.col("n") / CHUNK)))
        ahead = F.collect_list(F.struct("s", "fp", "size", "component")).over(Window.partitionBy("key", "chunk").orderBy(F.xxhash64("key", "s"), "s").rowsBetween(-upto, -nearer - 1))
        fits = lambda o: F.least(o["size"], F.col("size")) >= F.lit(similar) * F.greatest(o["size"], F.col("size"))
        rest = left.withColumn("ahead", ahead).withColumn("y", F.explode(F.filter("ahead", lambda o: (o["component"] != F.col("component")) & fits(o)))).select(F.struct("s", "fp", "size").alias("x"), "y")
        found = cut(found.unionAll(_alike(_ends(rest, "x", "y"), sets, similar)), "found")
    else:
        crowd = cut(parted().filter(F.col("n") > BEFORE[-1] + 1).select("s", "fp", "size", "component").distinct(), "crowd")
        if not crowd.isEmpty():
            found = found.unionAll(_alike(_crowded(crowd, sets, similar), sets, similar))
    return found.select(F.col("fa").alias("a"), F.col("fb").alias("b")).unionAll(equal)
