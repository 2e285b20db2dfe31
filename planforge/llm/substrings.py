"""Substring dedup by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the least hash of its runs of MINIMISER words. Consecutive
windows with one minimiser travel together as one packed string, in the bucket of the minimiser, so equal
windows meet. There they are sorted by minimiser and read as a stream; windows of one are sorted, and each is compared as text with the first of its
kind. Where one minimiser has more text than a task should hold, its windows are handed on one by one, and meet by their own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, cut, row_key
from .tokens import Joined, batches, grams, mixed, slide

WINDOW, MINIMISER = 20, 4
#: Bytes of packed strings for a bucket, while there are no more than PARTS of them (larger ones are sorted on disk, not held); bytes of text that a map task packs at a time.
BUCKET, PARTS, PACK = 16 << 20, 20_000, 12 << 20
#: Bytes of text that are compared together, and that one minimiser may have in a task.
HELD, LIMIT = 4 << 20, 48 << 20
#: A minimiser with more than 1/HOT of all super-k-mers is hot (fewer than HOT are): its windows travel one by one, by their own hash.
HOT = 2000
#: A row in the order of rows: z (1: no id), doc (the id, as a difference to the row before), a and b (its row_key()); start and n: its windows;
#: sub tells minimisers of a bucket apart; size: bytes of text, or -1 for windows that are known to be repeats.
_BLOB = pa.schema([("z", pa.uint8()), ("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("sub", pa.uint32()), ("size", pa.int32())])


def _normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().split())


def _runs(j: Joined) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser) of the super-k-mers."""
    width = WINDOW - MINIMISER + 1
    low = slide(grams(j.h, MINIMISER), width, np.minimum)
    at = np.flatnonzero(j.whole(WINDOW)[: len(low)])
    if not len(at):
        return at, at, low[:0]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]])
    a = at[new]
    b = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return a, b, low[a]


def _weigh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimisers with more than 1/(2 HOT) of this task's super-k-mers, and all of them and the bytes under null.
    One with over 1/HOT of all has half of its share or more in tasks where it is named."""
    counts: dict[int, int] = {}
    total = size = passed = 0
    for batch in rows:
        texts = [_normal(x.as_py()) for x in batch.column(4)]
        for lo, hi in batches(texts):
            keys, n = np.unique(_runs(Joined(texts[lo:hi]))[2], return_counts=True)
            total, size = total + int(n.sum()), size + sum(map(len, texts[lo:hi]))
            for k, c in zip(keys[n > 1].tolist(), n[n > 1].tolist()):
                counts[k] = counts.get(k, 0) + c
            passed += int(len(keys))
            if len(counts) > 50 * HOT:  # what is rare so far may be let go, as it is counted with a margin
                counts = {k: c for k, c in counts.items() if c * 8 * HOT > total}
    found = [(k, c) for k, c in counts.items() if c * 2 * HOT > total]
    keys = [np.uint64(k).astype(np.int64).item() for k, _ in found]
    yield pa.RecordBatch.from_arrays([pa.array([*keys, None], pa.int64()), pa.array([*(c for _, c in found), total], pa.int64()), pa.array([0] * len(found) + [size], pa.int64())], names=["key", "n", "size"])


def _wrapped(rows: list[tuple]) -> bytes:
    """Columns of (z, doc, a, b, start, n, sub, text) one after another, compressed as one."""
    *columns, text = zip(*rows)
    columns.append([-1 if t is None else len(t) for t in text])
    columns = [np.array(c, t.to_pandas_dtype()) for c, t in zip(columns, _BLOB.types)]
    columns[1] = np.diff(columns[1], prepend=np.int64(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in columns]  # bytes of like weight lie together
    data = b"".join([len(rows).to_bytes(8, "little"), *planes, *[t for t in text if t is not None]])
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _unwrapped(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blobs, with sub first; text is null for windows that are known to be repeats."""
    for batch in rows:
        for blob in batch.column(1):
            blob = blob.as_buffer()
            size = int.from_bytes(blob.slice(0, 8).to_pybytes(), "little")
            data = pa.Codec("zstd").decompress(blob.slice(8), size, asbytes=True)
            count, at, columns = int.from_bytes(data[:8], "little"), 8, []
            for t in _BLOB.types:
                kind = np.dtype(t.to_pandas_dtype())
                planes = np.frombuffer(data, np.uint8, count * kind.itemsize, at).reshape(kind.itemsize, count)
                columns.append(np.ascontiguousarray(planes.T).view(kind).ravel())
                at += count * kind.itemsize
            columns[1] = np.cumsum(columns[1])
            sizes = columns.pop()
            ends = at + np.cumsum(np.maximum(sizes, 0))
            text = [None if n < 0 else data[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist())]
            z, doc, a, b, start, n, sub = columns
            arrays = [sub.astype(np.int64), z.astype(np.int32), doc, a, b, start, n.astype(np.int64)]
            out = pa.RecordBatch.from_arrays([*[pa.array(c) for c in arrays], pa.array(text, pa.binary())], names=["sub", "z", "doc", "a", "b", "start", "n", "text"])
            for lo in range(0, count, 8192):
                yield out.slice(lo, 8192)


def _packer(buckets: int, hot: list[int]):
    hot_keys = np.sort(np.array(hot, np.int64).astype(np.uint64))

    def blobs(held: dict[bytes, tuple], marks: list) -> Iterator[pa.RecordBatch]:
        """Of equal strings the earliest travels; the others' windows are known to be repeats."""
        by: dict[int, list] = {}
        for text, (*one, bucket, sub) in held.items():
            by.setdefault(bucket, []).append((*one, sub, text))
        for i, one in enumerate(marks):
            by.setdefault(i % buckets, []).append((*one, 0, None))
        ids, out = [], []
        for bucket, rows in by.items():
            ids.append(bucket)
            out.append(_wrapped(rows))
        held.clear()
        marks.clear()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        marks: list = []
        size = 0
        for batch in rows:
            own_ = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            texts = [_normal(x.as_py()) for x in batch.column(4)]
            for lo, hi in batches(texts):
                j = Joined(texts[lo:hi])
                a, b, low = _runs(j)
                if len(hot_keys) and len(a):
                    near = np.minimum(np.searchsorted(hot_keys, low), len(hot_keys) - 1)
                    single = hot_keys[near] == low
                    each = np.repeat(np.arange(len(a)), np.where(single, b - a + 1, 1))
                    step = np.arange(len(each)) - np.searchsorted(each, each)
                    a, b, single = a[each] + np.where(single[each], step, 0), np.where(single[each], a[each] + step, b[each]), single[each]
                    low = low[each]
                    low[single] = grams(j.h, WINDOW)[a[single]]
                which = np.searchsorted(j.first, a, side="right") - 1
                dealt = mixed(low)
                where, sub = (dealt % np.uint64(buckets)).astype(np.int64).tolist(), (mixed(dealt) >> np.uint64(32)).tolist()
                start, n = (a - j.first[which]).tolist(), (b - a + 1).tolist()
                begins, ends = j.starts[a].tolist(), j.ends[b + WINDOW - 1].tolist()
                for i, d in enumerate(which.tolist()):
                    one = (*own_[lo + d], start[i], n[i], where[i], sub[i])
                    text = j.data[begins[i] : ends[i]]
                    was = held.setdefault(text, one)
                    if was is not one and was[:5] != one[:5]:
                        if one[:5] < was[:5]:
                            held[text], one = one, was
                        marks.append(one[:6])
                size += sum(map(len, texts[lo:hi]))
                if size > PACK:
                    yield from blobs(held, marks)
                    size = 0
        yield from blobs(held, marks)

    return pack


def _compared(held: dict[bytes, tuple]) -> Iterator[tuple]:
    """Of distinct strings, whose minimisers' windows are all there: (a, b, start, n), n windows from start that an earlier one equals."""
    order = sorted(held.items(), key=lambda x: x[1][:5])
    j = Joined([t for t, _ in order])
    at = np.flatnonzero(j.whole(WINDOW))
    key = grams(j.h, WINDOW)[at]
    rank = np.argsort(key, kind="stable")  # within a key by document and place
    same = np.append(False, key[rank[1:]] == key[rank[:-1]]) if len(rank) else np.zeros(0, bool)
    first = rank[np.maximum.accumulate(np.where(same, 0, np.arange(len(rank))))] if len(rank) else rank
    again = np.zeros(len(at), bool)
    odd: dict[int, set[bytes]] = {}
    for x, f in zip(rank[same].tolist(), first[same].tolist()):
        mine, theirs = j.text(at[x], at[x] + WINDOW - 1), j.text(at[f], at[f] + WINDOW - 1)
        if mine == theirs:
            again[x] = True
        else:  # two texts with one hash: each text's own first stays
            seen = odd.setdefault(f, set())
            again[x] = mine in seen
            seen.add(mine)
    hit = np.flatnonzero(again)
    if len(hit):
        which = np.searchsorted(j.first, at[hit], side="right") - 1
        new = np.append(True, (np.diff(at[hit]) != 1) | (np.diff(which) != 0))
        n = np.diff(np.append(np.flatnonzero(new), len(hit)))
        for w, place, k in zip(which[new].tolist(), at[hit][new].tolist(), n.tolist()):
            _, _, a, b, start, _ = order[w][1]
            yield a, b, start + place - int(j.first[w]), k


def _marked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 8192):
        part = [(None, None, a, b, start, n, None) for a, b, start, n in rows[lo : lo + 8192]]
        yield _batch(part)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["z", "doc", "a", "b", "start", "n", "text"])


def _comparer(limit: int):
    """Rows by sub: (a, b, start, n) that an earlier one equals, and whole, with their text, the rows of a sub with more than ``limit`` bytes."""

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}  # of whole subs
        now: dict[bytes, tuple] = {}  # of the sub that is being read
        marks: list[tuple] = []
        size = mine = 0
        last, over = None, False
        for batch in rows:
            for sub, *one, text in zip(*(c.to_pylist() for c in batch.columns)):
                one = tuple(one)
                if text is None:
                    marks.append(one[2:])
                    continue
                if sub != last:
                    held |= now
                    size, mine, last, over = size + mine, 0, sub, False
                    now = {}
                    if size > HELD:
                        marks += _compared(held)
                        held, size = {}, 0
                if over:
                    yield _batch([(*one, text)])
                    continue
                was = now.setdefault(text, one)
                if was is one:
                    mine += len(text)
                elif was[:5] != one[:5]:
                    if one[:5] < was[:5]:
                        now[text], one = one, was
                    marks.append(one[2:])
                if mine > limit:
                    yield _batch([(*o, t) for t, o in now.items()])
                    now, mine, over = {}, 0, True
            if len(marks) > 1 << 16:
                yield from _marked(marks)
                marks = []
        held |= now
        if held:
            marks += _compared(held)
        yield from _marked(marks)

    return compare


def _singly(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window by itself."""
    for batch in rows:
        for *one, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.split(b" ")
            out = [(*one[:4], one[4] + i, 1, b" ".join(words[i : i + WINDOW])) for i in range(len(words) - WINDOW + 1)]
            for lo in range(0, len(out), 8192):
                yield _batch(out[lo : lo + 8192])


_SHAPE = "z int, doc long, a long, b long, start long, n long, text binary"


def _in_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(z, doc, a, b, text, id): z, doc, a, b order the rows by id, null last, and row key. Ids that are no whole numbers go by their rank."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), row_key(id_col, text).alias("row"))
    doc = F.col("id").cast("long")
    if not isinstance(kind, T.IntegralType):
        ids = rows.select("id").filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
        ids = cut(ids.select(F.col("id").alias("known"), F.monotonically_increasing_id().alias("place")), "ids")
        rows, doc = rows.join(ids, F.col("id") == F.col("known"), "left"), F.col("place")
    return rows.select(F.col("id").isNull().cast("int").alias("z"), F.coalesce(doc, F.lit(0)).alias("doc"), "row.a", "row.b", "text", "id")


def _windows(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b, start, n): n windows from word ``start`` of the row with that key, each of which also starts earlier. rows: as _in_order() gives them."""
    spark = rows.sparkSession
    rows = rows.select("z", "doc", "a", "b", "text")
    weighed = rows.mapInArrow(_weigh, "key long, n long, size long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    weighed = cut(weighed, "weighed")
    total, size = (weighed.filter("key is null").select("n", "size").first() or (0, 0))
    hot = [r[0] for r in weighed.filter(f"key is not null and n * {2 * HOT} > {total}").select("key").collect()]  # fewer than 2 HOT
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTS, int(size * 3.2 / BUCKET) + 1))
    packed = rows.mapInArrow(_packer(parts, hot), "bucket int, blob binary").repartitionById(parts, F.col("bucket"))
    each = packed.mapInArrow(_unwrapped, f"sub long, {_SHAPE}").sortWithinPartitions("sub")
    found = cut(each.mapInArrow(_comparer(limit), _SHAPE), "windows")
    marks, more = found.filter("text is null").select("a", "b", "start", "n"), found.filter("text is not null")
    if more.isEmpty():
        return marks
    single, who = cut(more.mapInArrow(_singly, _SHAPE), "single"), F.struct("z", "doc", "a", "b", "start")
    firsts = cut(single.groupBy("text").agg(F.min(who).alias("first"), F.count(F.lit(1)).alias("times")), "firsts")
    again = attach(single, firsts, "text", "times", single.count(), "inner", "start").filter(who > F.col("first"))
    return marks.unionAll(again.select("a", "b", "start", "n"))


def _cut_text(text: str | None, marks: list | None) -> tuple[int, int, bytes]:
    words = (text or "").encode().split()
    if not marks:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for m in marks:
        gone[m["start"]] += 1
        gone[min(len(words), m["start"] + m["n"] + WINDOW - 1)] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return len(words), int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist()) if not c])


def _removed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        found = [_cut_text(t.as_py(), m.as_py()) for t, m in zip(b.column(1), b.column(2))]
        n, gone, kept = zip(*found) if found else ((), (), ())
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array([k.decode() for k in kept], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space).

    Null text has no words. A null id comes after all others; of rows that share an id but not the text
    the order is that of a hash, and rows that repeat id and text are one document, each with its result. Texts
    of fewer than WINDOW words have no window. Ids are of any type with an order. An empty table gives no rows. Other columns are not read.
    """
    rows = _in_order(docs, id_col, text)
    marks = _windows(rows, limit).groupBy("a", "b").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    both = rows.join(cut(marks, "marks"), ["a", "b"], "left").select("id", "text", "marks")
    more = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType())]
    return both.mapInArrow(_removed, T.StructType([both.schema["id"], *[T.StructField(*x) for x in more]])).withColumnRenamed("id", id_col)
