"""Benchmark decontamination by winnowing.

Of each RUN - K + 1 consecutive K-grams of words the least hash is kept, on both sides, so that a passage of RUN words that
a document shares with an item has a kept K-gram in common. Fingerprints of documents are joined with those of the benchmark;
each that meets one is extended to the windows of RUN words around it, which are joined, as text, with the
windows of items. Items shorter than RUN are one window, and one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, cut, give, row_key, without
from .tokens import LETTERS, LOWER, Joined, batches, grams, slide

RUN, K = 10, 5
#: Bits of the table that tells which fingerprints the benchmark can't hold: 16 a fingerprint, and as many as this at most (8 MB), whatever the benchmark.
MOST_BITS = 1 << 26


def _clean(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def _kept(j: Joined) -> np.ndarray:
    """Places of the kept K-grams (all of them, where equal hashes tie)."""
    v, w = grams(j.h, K), RUN - K + 1
    low = slide(v, w, np.minimum)
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(w - 1, np.uint64)
    high = slide(np.concatenate([pad, low, pad]), w, np.maximum)  # the greatest of the minima of all windows that hold a place
    return np.flatnonzero(high == v)


def _salted(key: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of whole short items are told apart from others by their length."""
    return key + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)


def _items(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, n, x, fp): each window x of n words with fp null, and each fingerprint with x null."""
    for b in rows:
        ids, texts = b.column(0).to_pylist(), [_clean(x.as_py()) for x in b.column(1)]
        for lo, hi in batches(texts):
            j = Joined(texts[lo:hi], LETTERS)
            words = [j.data[a:e] for a, e in zip(j.starts.tolist(), j.ends.tolist())]
            out: list[tuple] = []
            for i, (first, n) in enumerate(zip(j.first.tolist(), j.count.tolist())):
                w = min(n, RUN)
                out += [(ids[lo + i], w, x.decode(), None) for x in {b" ".join(words[a : a + w]) for a in range(first, first + n - w + 1)} if n]
                if 0 < n < RUN:
                    out.append((ids[lo + i], w, None, int(_salted(grams(j.h[first : first + n], n), n).view(np.int64)[0])))
            place = _kept(j)
            which = np.searchsorted(j.first, place, side="right") - 1
            long_ = j.count[np.minimum(which, len(j.count) - 1)] >= RUN
            found = {(int(w), int(k)) for w, k in zip(which[long_], _salted(grams(j.h, K)[place[long_]], RUN).view(np.int64))}
            out += [(ids[lo + w], RUN, None, k) for w, k in found]
            for at in range(0, len(out), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 8192]), (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["item", "n", "x", "fp"])


def _regions(j: Joined, bits: np.ndarray, lengths: list[int]) -> Iterator[tuple]:
    """(text number, n, first word, words, fingerprints) of stretches whose windows of n words may be in the benchmark; those of one n don't overlap."""
    mask = np.uint64(len(bits) * 8 - 1)

    def may(fp: np.ndarray) -> np.ndarray:
        at = fp & mask
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    for n in lengths:
        if n == RUN:
            place = _kept(j)
            fp = _salted(grams(j.h, K)[place], RUN)
        else:
            place = np.flatnonzero(j.whole(n))
            fp = _salted(grams(j.h, n)[place], n)
        good = may(fp)
        place, fp = place[good], fp[good]
        if not len(place):
            continue
        which = np.searchsorted(j.first, place, side="right") - 1
        around = RUN - K if n == RUN else 0
        lo = np.maximum(place - around, j.first[which])
        hi = np.minimum(place + (RUN if n == RUN else n), j.first[which + 1] - 1)
        whole = hi - lo >= n
        place, fp, which, lo, hi = place[whole], fp[whole], which[whole], lo[whole], hi[whole]
        new = np.flatnonzero((lo[1:] >= hi[:-1]) | (which[1:] != which[:-1])) + 1
        for a, e in zip(np.append(0, new).tolist(), np.append(new, len(lo)).tolist()) if len(lo) else ():
            yield int(which[a]), n, int(lo[a]), int(hi[e - 1]), np.unique(fp[a:e]).view(np.int64).tolist()


def _scanner(sent, lengths: list[int]):
    """For each document a row with n_words, and one for each of its regions."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for b in rows:
            texts = [_clean(t.as_py()) for t in b.column(2)]
            for lo, hi in batches(texts):
                j = Joined(texts[lo:hi], LETTERS)
                doc, n, at, words, prints = list(range(lo, hi)), [None] * (hi - lo), j.count.tolist(), [None] * (hi - lo), [None] * (hi - lo)
                for d, size, first, last, fps in _regions(j, bits, lengths):
                    doc.append(lo + d)
                    n.append(size)
                    at.append(first - int(j.first[d]))
                    words.append(b" ".join([j.data[x:y] for x, y in zip(j.starts[first:last].tolist(), j.ends[first:last].tolist())]).decode())
                    prints.append(fps)
                take = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(n, pa.int32()), pa.array(at, pa.int64()), pa.array(words, pa.string()), pa.array(prints, pa.list_(pa.int64()))], names=["id", "row", "n", "at", "words", "fps"])

    return scan


def _table(prints: DataFrame) -> bytes:
    """A bit for each of the benchmark's fingerprints, by its last bits."""
    size = 1 << 16
    while size < min(MOST_BITS, 16 * prints.count()):
        size *= 2
    at = F.col("fp").bitwiseAND(size - 1)
    held = prints.groupBy(F.shiftright(at, 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 31L as int))")).alias("v")).toArrow()  # size / 32 rows at most
    out = np.zeros(size // 32, np.uint32)
    out[held.column("w").to_numpy()] = held.column("v").to_numpy().astype(np.uint32)
    return out.astype("<u4").tobytes()


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(id, row, n_words, spans, items), a row per row of docs."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    held = cut(items.mapInArrow(_items, "item string, n int, x string, fp long"), "benchmark")
    prints = cut(held.filter("fp is not null").select("fp").distinct(), "prints")
    windows = held.filter("x is not null").groupBy("x").agg(F.collect_set("item").alias("items"))
    lengths = sorted(r[0] for r in held.select("n").distinct().collect())  # RUN of them at most
    sent = spark.sparkContext.broadcast(_table(prints))
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("row"), F.col(text).alias("t"))
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema][:2], *T._parse_datatype_string("n int, at long, words string, fps array<long>").fields])
    scanned = cut(rows.mapInArrow(_scanner(sent, lengths), shape), "scanned")
    sized = scanned.filter("n is null").select("id", "row", F.col("at").alias("n_words"))
    regions = scanned.filter("n is not null")
    # fingerprints of both sides meet; a frequent one is dealt out
    mine = regions.select("row", "n", "at", F.explode("fps").alias("fp"))
    times = mine.groupBy("fp").agg(F.count(F.lit(1)).alias("times")).join(prints, "fp", "left_semi")
    met = attach(mine, cut(times, "times"), "fp", "times", mine.count(), "left_semi", "row").select("row", "n", "at").distinct()
    known = regions.join(cut(met, "met"), ["row", "n", "at"], "left_semi").dropDuplicates(["row", "n", "at"])
    # and are extended to windows, which meet as text
    one_by_one = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.struct((F.col("at") + i).alias("a"), F.array_join(F.slice("w", i + 1, F.col("n")), " ").alias("x")))
    each = known.withColumn("w", F.split("words", " ")).select("row", "n", F.explode(one_by_one).alias("s")).select("row", "n", "s.a", "s.x")
    each = cut(each, "extended")
    sizes = each.groupBy("x").agg(F.count(F.lit(1)).alias("times"))
    hits = attach(each, cut(windows.join(sizes, "x"), "windows"), "x", "times", each.count(), "inner", "row")
    span = F.struct("a", (F.col("a") + F.col("n")).alias("b"))
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = give(sized, cut(found, "leaks"))
    none = F.array().cast("array<struct<a:long,b:long>>")
    return out.select("id", "row", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, spans (word ranges that items share, end exclusive), items (ids, sorted as strings).

    Null texts have no words, so null items have no window. Items without an id taint words but are not named; repeated
    items are named once. Null document ids and repeated rows each give their row; ids are of any type; empty tables give no rows or no
    hits. Other columns are not read. Texts are read once, whatever the benchmark's size; only a table of bits of bounded size goes to all tasks.
    """
    return _found(docs, benchmark, id_col, text, item_id, item_text).select(F.col("id").alias(id_col), "n_words", "spans", "items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(s["b"], acc["end"]).alias("end"))
    n_hit = F.aggregate("spans", start, step, lambda a: a["n"])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that share a passage with the benchmark, told by id and text together; all columns stay, whatever their names."""
    found = _found(docs, benchmark, id_col, text, "item_id", "text")
    return without(docs, found.filter(F.size("spans") > 0).select("row").distinct(), [id_col, text])
