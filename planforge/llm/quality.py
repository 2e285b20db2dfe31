"""Quality by importance resampling, after a veto.

Two generative models of hashed n-grams, one of target text (labelled good) and one of all text, give each
document the log of its importance weight, log p_target - log p_raw, summed over its n-grams. With Gumbel noise added, the k
largest are a sample without replacement by weight; the rest is rejected.

A few words that target text would never hold hardly move the weight of a long text of ordinary words, each of which counts a little in
its favour. So there is a step before: the veto adds up only the n-grams whose lack in target text is beyond chance, and
documents with too much of that evidence take no part in the sampling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, row_key, without
from .tokens import LOWER, Joined, batches, grams, mixed

#: Kinds of n-grams: words, pairs of words, first HEAD bytes of words.
KINDS, HEAD = 3, 4
#: Buckets of each kind: one for PER bytes of the corpus, a power of two between these.
LEAST, MOST, PER = 1 << 17, 1 << 18, 2048
#: The target model is fitted to at most so many labelled documents (those with the least hashes); others set the thresholds.
MAX_LABELLED = 100_000
#: PRIOR: n-grams that each bucket is taken to have beside those counted, in both models, so rare ones weigh little.
PRIOR = 10.0
#: The veto: an n-gram counts if it is rarer in target text than in all text by exp(-CLEAR) and by SURE standard deviations of chance, with VETO_PRIOR for
#: its prior; the sum is divided by sqrt(1 + words / LENGTH), as chance adds up by the root of a text's length.
CLEAR, SURE, VETO_PRIOR, LENGTH = 2.0, 4.5, 3.0, 200
#: The share of held-out good documents that each of the two steps may reject.
REJECT, SEED = 0.0025, 29


def _features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of all n-grams of the texts."""
    j = Joined(texts)
    whole = np.ones(len(j.h), bool)
    whole[j.fence] = False
    at = np.flatnonzero(whole)
    doc = np.searchsorted(j.first, at, side="right") - 1
    pair = np.flatnonzero(j.whole(2))
    both = grams(j.h, 2)[pair]
    both[(j.h[pair] == j.h[pair + 1]) & (j.h[pair + 1] == j.h[np.minimum(pair + 2, len(j.h) - 1)])] = 0  # a word said thrice is one event, whatever the word
    every = np.frombuffer(j.data, np.uint8)
    head = np.zeros(len(at), np.uint64)
    for i in range(HEAD):
        place = j.starts[at] + i
        inside = place < j.ends[at]
        head = head * np.uint64(257) + np.where(inside, every[np.minimum(place, len(every) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    kinds = [(j.h[at], doc), (both, np.searchsorted(j.first, pair, side="right") - 1), (mixed(head), doc)]
    bucket = [(mixed(h) % np.uint64(buckets)).astype(np.int64) + k * buckets for k, (h, _) in enumerate(kinds)]
    return np.concatenate(bucket), np.concatenate([d for _, d in kinds])


def _lowered(x) -> bytes:
    return (x.as_py() or "").encode().translate(LOWER)


def _counter(buckets: int):
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's n-grams by bucket, in all documents and in target documents."""
        raw, target = (np.zeros(buckets * KINDS, np.int64) for _ in range(2))
        for b in rows:
            texts, good = [_lowered(x) for x in b.column(0)], np.array(b.column(1).to_pylist(), bool)
            for lo, hi in batches(texts):
                bucket, doc = _features(texts[lo:hi], buckets)
                raw += np.bincount(bucket, minlength=len(raw))
                target += np.bincount(bucket[good[lo:hi][doc]], minlength=len(raw))
        some = np.flatnonzero(raw)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"])

    return count


def _scorer(sent, buckets: int):
    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, against = np.frombuffer(sent.value, np.float32).reshape(2, -1)
        for b in rows:
            texts, out, veto = [_lowered(x) for x in b.column(2)], [], []
            for lo, hi in batches(texts):
                bucket, doc = _features(texts[lo:hi], buckets)
                n = np.bincount(doc[bucket < buckets], minlength=hi - lo)  # words
                out += np.bincount(doc, weight[bucket], minlength=hi - lo).tolist()
                veto += (np.bincount(doc, against[bucket], minlength=hi - lo) / np.sqrt(1 + n / LENGTH)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array(veto, pa.float64())], names=["id", "row", "log_weight", "absent"])

    return score


def weights(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """By bucket of one kind: log p_target - log p_raw, of either sign, and what the veto counts. Without target text all are 0."""
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + prior) / (expected + prior))
    sure = np.log((target + VETO_PRIOR) / (expected + VETO_PRIOR))
    clear = (expected - target > SURE * np.sqrt(expected)) & (sure < -CLEAR)
    return ratio, np.where(clear, sure, 0.0)


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, good, fit) of at most MAX_LABELLED labelled ids; half of them fit the target model, half are held out."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    by = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.min(good).alias("good"))
    some = by.orderBy(F.xxhash64("lid", F.lit(SEED)), "lid").limit(MAX_LABELLED)
    return some.withColumn("fit", F.pmod(F.xxhash64("lid", F.lit(SEED + 1)), F.lit(2)) == 0)


def log_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", prior: float = PRIOR) -> DataFrame:
    """(id, row, log_weight, absent, good, fit): a row per row of docs; good and fit are null for unlabelled ids. absent is what the veto found, 0 or less."""
    spark = docs.sparkSession
    known = F.broadcast(cut(_labelled(labels, id_col), "labelled"))  # MAX_LABELLED rows at most
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("row"), F.col(text).alias("t"))
    size, buckets = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0, LEAST
    while buckets < min(MOST, size // PER):
        buckets *= 2
    marked = rows.select("id", "t").join(known, F.col("id") == F.col("lid"), "left").select("t", F.coalesce(F.col("good") & F.col("fit"), F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_counter(buckets), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = (np.zeros(buckets * KINDS) for _ in range(2))
    held = counts.toArrow()  # MOST * KINDS rows at most, whatever the input
    raw[held.column("bucket").to_numpy()], target[held.column("bucket").to_numpy()] = held.column("raw").to_numpy(), held.column("target").to_numpy()
    found = np.concatenate([np.array(weights(raw[k * buckets : (k + 1) * buckets], target[k * buckets : (k + 1) * buckets], prior)) for k in range(KINDS)], axis=1)
    sent = spark.sparkContext.broadcast(found.astype(np.float32).tobytes())
    shape = T.StructType([rows.schema["id"], rows.schema["row"], T.StructField("log_weight", T.DoubleType()), T.StructField("absent", T.DoubleType())])
    scored = rows.mapInArrow(_scorer(sent, buckets), shape)
    return scored.join(known, F.col("id") == F.col("lid"), "left").drop("lid")


def _kth(scored: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, found by narrowing a range to 1/1000 at a time; each step is one aggregate."""
    lo, hi = scored.agg(F.min(column), F.max(column)).first()
    above = 0
    while lo is not None and lo < hi:
        step = (hi - lo) / 1000
        if lo + step == lo or hi - step == hi:
            break
        inside = scored.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        bins = {r["b"]: r for r in inside.groupBy(F.least(F.floor((F.col(column) - lo) / step), F.lit(999)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                lo, hi = bins[b]["lo"], bins[b]["hi"]
                break
            above += bins[b]["n"]
    return hi if lo is None or lo == hi else lo


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", k: int | None = None, reject: float = REJECT, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id, log_weight, absent, score (log_weight with Gumbel noise), selected.

    The veto rejects rows with less ``absent`` than ``reject`` of the held-out good documents have. Of the others those with a score
    among the k largest are selected; without k, it is the number of them with a weight not below that of ``reject`` of the held-out good
    ones. Null and empty texts have log_weight 0. The noise is a hash of id and text, so reruns agree, and rows that repeat
    both are selected together; values that tie at the k-th are all selected. Without labelled good
    documents all rows are selected. Ids are of any type; null ids have no label. An empty table gives no rows. Other columns are not read.
    """
    scored = log_weights(docs, labels, id_col, text)
    u = (F.shiftrightunsigned(F.xxhash64("row", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = cut(scored.withColumn("score", F.col("log_weight") - F.log(-F.log(u))), "scored")
    held = scored.filter("good and not fit")
    n = held.count()
    limit = _kth(held, "absent", n - int(reject * n)) if n else None
    passed = scored if limit is None else scored.filter(F.col("absent") >= limit)
    if k is None:
        held = passed.filter("good and not fit")
        left = held.count()
        least = _kth(held, "log_weight", left - int(reject * n)) if left else None
        k = passed.count() if least is None else passed.filter(F.col("log_weight") >= least).count()
    edge = _kth(passed, "score", k) if k > 0 else float("inf")
    chosen = F.col("score") >= F.lit(edge) if edge is not None else F.lit(True)
    chosen = chosen if limit is None else chosen & (F.col("absent") >= F.lit(limit))
    return scored.select(F.col("id").alias(id_col), "row", "log_weight", "absent", "score", chosen.alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that resample() rejects; all columns stay, whatever their names."""
    return without(docs, resample(docs, labels, id_col, text).filter(~F.col("selected")).select("row").distinct(), [id_col, text])
