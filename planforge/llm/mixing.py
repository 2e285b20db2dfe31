"""Mixing sources to target weights by the cube method.

A document of a source is taken target / size-of-source times: the whole part for certain, the
fractional part as an inclusion probability. The flight moves these probabilities, three documents at a
time, along the direction that changes neither the expected number of documents nor that of words,
until one of them is 0 or 1. It runs in blocks of each source; what a block leaves undecided (two documents
at most, and a reserve of all sizes) meets in the next round, until a source's rest fits one small landing problem.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, cut, numbered, own, text_of, words_of

WEIGHTS, SHARE, CAP, BLOCK, SEED, RESERVE = (5.0, 2.0, 1.0), 1.5, 2.0, 4_000, 17, 64
#: Rows that repeat id, source and size are told apart by a number, and listed so many at a time.
REPEATS = 4096
_TINY = 1e-9


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all words by weight, at most ``cap`` times a source's
    words, the excess shared again by weight among the others until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1, sums of p and of p * size unchanged."""
    p = p.astype(float).copy()
    live: list[int] = []
    draws = iter(rng.random(2 * len(p) + 4).tolist())
    for i in np.flatnonzero((p > _TINY) & (p < 1 - _TINY)).tolist():
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = [float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a])]  # orthogonal to (1, 1, 1) and to the sizes
            if u == [0.0, 0.0, 0.0]:
                u = [1.0, -1.0, 0.0]
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(live, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(live, u) if x)
            step = up if next(draws) < down / (up + down) else -down
            for k, x in zip(live, u):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
            kept = [k for k in live if _TINY < p[k] < 1 - _TINY]
            if len(kept) == 3:  # rounding kept all three inside: the nearest to an end goes there
                k = min(kept, key=lambda k: min(p[k], 1 - p[k]))
                p[k], kept = round(p[k]), [x for x in kept if x != k]
            for k in live:
                if k not in kept:
                    p[k] = round(p[k])
            live = kept
    return p


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the rest: the number of documents is let go and words alone are kept, two documents at a time
    from the largest on; the single one that remains goes to the nearer end, and what this adds or lacks in words
    is made up by turning over as few decided documents as it takes, the largest that fit first."""
    want, p, held = float((p * size).sum()), p.copy(), None
    for b in np.flatnonzero((p > _TINY) & (p < 1 - _TINY)).tolist():
        if held is None:
            held = b
            continue
        u = (float(size[b]), -float(size[held])) if size[b] or size[held] else (1.0, -1.0)
        two = [(k, x) for k, x in zip((held, b), u) if x]
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in two)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in two)
        step = up if rng.random() < down / (up + down) else -down
        for k, x in two:
            p[k] = min(1.0, max(0.0, p[k] + step * x))
        open_ = [k for k in (held, b) if _TINY < p[k] < 1 - _TINY]
        if len(open_) == 2:
            k = min(open_, key=lambda k: min(p[k], 1 - p[k]))
            p[k] = round(p[k])
            open_.remove(k)
        held = open_[0] if open_ else None
    out = np.where(p >= 0.5, 1.0, 0.0)
    over = float((out * size).sum()) - want
    for k in range(len(out)):  # sizes fall
        if 0 < size[k] <= abs(over) and out[k] == (over > 0):
            out[k], over = 1 - out[k], over - (size[k] if over > 0 else -size[k])
    return out


def _round(seed: int):
    """A block's flight. RESERVE documents, spread over the sizes, sit it out, so that the landing finds some of each size."""

    def run(group: pa.Table) -> pa.Table:
        size, h, h2, p = (group.column(c).to_numpy() for c in ("size", "h", "h2", "p"))
        order = np.lexsort((h2, h, -size))
        size, p = size[order], p[order].astype(float)
        rng = np.random.default_rng([seed, int(h[order[0]]) & 0xFFFFFFFF, len(size)])
        flies = np.ones(len(size), bool)
        flies[np.unique(np.linspace(0, len(size) - 1, min(max(1, len(size) // 8), RESERVE)).astype(int))] = False
        p[flies] = flight(p[flies], size[flies], rng)
        out = group.drop_columns(["block"]).take(order)
        if group.column("blocks")[0].as_py() == 1:
            p = landing(p, size, rng)
        return out.set_column(out.schema.get_field_index("p"), "p", pa.array(p))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken (= copies * size).

    Sources by code point, null last, bear the weights in turn. Null and empty texts have size 0 and are
    copied like others of their source. Order and blocks come from a hash of id, size and, for rows that repeat both in
    a source, a number of their own, so reruns agree; repeated rows are separate documents, and null ids need no
    block of their own. Ids are of any type. An empty table gives no rows. The number of sources, not that
    of documents, is what the driver holds.
    """
    block = max(block, 64)  # so that each round leaves less than it found
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.size(words_of(text_of(text), BLANK)).cast("long").alias("size"))
    rows = cut(rows, "sizes")
    sizes = {r["source"]: r["s"] for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    wanted = targets(sizes, weights, share, cap)
    table = [(s, sizes[s], wanted[s], wanted[s] / sizes[s] if sizes[s] else 0.0) for s in sizes]
    spark = docs.sparkSession
    known = spark.createDataFrame(table, "s string, source_size long, target double, rate double")
    kinds = cut(rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n")), "kinds")
    parts = kinds.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS))))
    if not kinds.filter(F.col("n") > REPEATS).isEmpty():
        parts = parts.repartition("source", "id", "size", "part")
    last = F.least(F.col("n") - F.col("part") * REPEATS, F.lit(REPEATS)) - 1
    rows = parts.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("rep", F.col("rep") + F.col("part") * REPEATS)
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.col("rate") + _TINY)
    part = F.greatest(F.col("rate") - whole, F.lit(0.0))
    name = (F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "rep")
    rows = rows.withColumns({"whole": whole, "p": F.when(part < _TINY, 0.0).otherwise(part), "h": F.xxhash64(*name, F.lit(seed)), "h2": F.xxhash64(F.lit(seed), *name)})
    rows = rows.select("source", "id", "size", "source_size", "target", F.col("whole").cast("long"), "p", "h", "h2")
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], T.StructField("blocks", T.LongType())])
    done, left, salt = rows.filter("p <= 0"), rows.filter("p > 0"), 0
    while counts := left.groupBy("source").count().collect():
        # a source in one block lands; each other block leaves RESERVE + 2 documents to the next round
        dealing = spark.createDataFrame([(r[0], -(-r[1] // block)) for r in counts], "s string, blocks long")
        dealt = left.join(F.broadcast(dealing), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h", F.lit(salt)), "blocks"))
        flown = cut(dealt.groupBy("source", "block").applyInArrow(_round(seed + salt), shape), "flown")
        open_ = (F.col("blocks") > 1) & (F.col("p") > _TINY) & (F.col("p") < 1 - _TINY)
        done = done.unionAll(flown.filter(~open_).drop("blocks"))
        left, salt = flown.filter(open_).drop("blocks"), salt + 1
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    out = done.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs that the mix takes, each once, with copies (how often it is taken), taken and target.

    Rows are matched by id, source and size. Of rows that repeat all three as many get each number of copies as mix() gives it;
    which of them is not defined. A column of docs that has one of the three names stays, and the new one bears an underscore more.
    """
    found = mix(docs, id_col, text, source, **how).select(F.col(id_col).alias("i"), F.col(source).alias("s"), F.col("size").alias("z"), "copies", "target")
    found = found.groupBy("i", "s", "z").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("m"), F.max("target").alias("t"))
    # copies are lo or lo + 1
    found = cut(found.select(F.struct("i", "s", "z").alias("k"), "lo", "hi", (F.col("all") - F.col("m") * F.col("lo")).alias("more"), "t"), "taken")
    key, match, lo, hi, more, number = own(docs, "_key", "_match", "_lo", "_hi", "_more", "_number")
    copies, taken, target = own(docs, "copies", "taken", "target")
    known = found.select(F.col("k").alias(match), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("more").alias(more), F.col("t").alias(target))
    size = F.size(words_of(text_of(text), BLANK)).cast("long")
    sized = docs.withColumn(key, F.struct(F.col(id_col).alias("i"), F.col(source).alias("s"), size.alias("z")))
    same = F.col(key).eqNullSafe(F.col(match))
    out = sized.join(known.filter(F.col(lo) == F.col(hi)).filter(F.col(hi) > 0), same).withColumn(copies, F.col(hi))
    torn = known.filter(F.col(lo) < F.col(hi))
    if not torn.isEmpty():
        each = numbered(sized.join(torn, same), match, number)
        out = out.unionByName(each.withColumn(copies, F.col(lo) + (F.col(number) < F.col(more)).cast("long")).filter(F.col(copies) > 0).drop(number))
    return out.withColumn(taken, F.col(copies) * F.col(key)["z"]).drop(key, match, lo, hi, more).select(*[f"`{c}`" for c in docs.columns], copies, taken, target)
