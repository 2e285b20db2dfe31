"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most two bits,
either the lower segments differ in at most one, or the upper ones in none; so the lower segment is indexed under its 32
variants with one bit wiped out and the upper one as it is, fingerprints that share one are candidates, and
their distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .components import components
from .common import ROW, attach, cut, row_key, without
from .tokens import mixed

DISTANCE, SEED, SHINGLE = 2, 42, 3
UPPER = 32
#: Distinct fingerprints of a bucket that are compared directly; larger buckets are linked through shared masks.
DIRECT = 128
#: Bytes of packed fingerprints that a task holds; fingerprints that one task may hold whatever their variants; a variant
#: with more than 1/SHARE of all, or with CROWD of them, is hot.
BUCKET, WHOLE, SHARE, CROWD = 32 << 20, 1 << 20, 4000, 1 << 21
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() parts at \x20 and \x09-\x0D only
    if not words:
        return 0
    line, at = b" ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    n = max(1, len(words) - SHINGLE + 1)
    ends = at[SHINGLE:] if len(words) >= SHINGLE else [at[-1]]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, n, 1 << 16):  # bounded memory for long texts
        part = b"".join([digest(line[a : b - 1], SEED) for a, b in zip(at[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)])])
        total += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), prints], names=["id", "row", "fp"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            texts = [x.as_py() for x in b.column(1).slice(lo, 1024)]
            sets = [shingles.shingles(t) for t in texts]
            made = [([fingerprint(t) for t in texts], pa.int64()), ([shingles.digest(x) for x in sets], pa.int64()), ([len(x) for x in sets], pa.int64()), ([shingles.keys(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1024), b.column(2).slice(lo, 1024), *[pa.array(*x) for x in made]], names=["id", "row", "fp", "s", "size", "bands"])


def _keys(fps: np.ndarray, i: int) -> np.ndarray:
    """Variant i of unsigned fingerprints: the lower segment with bit i wiped out, or at UPPER the upper one; and i."""
    seg = fps >> np.uint64(32) if i == UPPER else fps & np.uint64(0xFFFFFFFF ^ (1 << i))
    return seg | np.uint64(i << 32)


def _free(i: int) -> list[int]:
    """The bits, 33 at most, in which fingerprints with an equal variant may differ."""
    return [*range(32)] if i == UPPER else [i, *range(32, 64)]


def _part(i: int, p: int) -> int:
    """Mask of the p-th third of these bits. Fingerprints that differ in two bits agree in one third or more."""
    return sum(1 << b for b in _free(i)[11 * p : 11 * p + 11])


def _heavy(share: int):
    """Variants with more than 1/(2 share) of a chunk; one with over 1/share of all has half of its fingerprints or more where it is named."""

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _chunks(rows, 1 << 20):
            for i in range(UPPER + 1):
                keys, n = np.unique(_keys(fps, i), return_counts=True)
                many = (n > 1) & (n * (2 * share) > len(fps))
                yield pa.RecordBatch.from_arrays([pa.array(keys[many].astype(np.int64)), pa.array(n[many])], names=["key", "n"])

    return find


def _chunks(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for b in rows:
        held.append(b.column(0).to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _packer(buckets: int, hot: list[int]):
    """(bucket, blob): a blob holds tags, one byte each, and fingerprints. Tag i is variant i; those of
    hot variants go by a third of the free bits too, with tag 64 + 3 i + third."""
    hot_keys = np.sort(np.array(hot, np.uint64))

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _chunks(rows, 1 << 16):
            tags, prints, where = [], [], []

            def add(tag: int, x: np.ndarray, key: np.ndarray) -> None:
                tags.append(np.full(len(x), tag, np.uint8))
                prints.append(x)
                where.append((mixed(key) % np.uint64(buckets)).astype(np.int32))

            for i in range(UPPER + 1):
                key = _keys(fps, i)
                many = np.isin(key, hot_keys)
                add(i, fps[~many], key[~many])
                if many.any():
                    for p in range(3):
                        add(64 + 3 * i + p, fps[many], mixed(key[many]) + (fps[many] & np.uint64(_part(i, p))))
            tag, fp, bucket = np.concatenate(tags), np.concatenate(prints), np.concatenate(where)
            order = np.argsort(bucket, kind="stable")
            tag, fp, bucket = tag[order], fp[order], bucket[order]
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for lo in range(0, len(edge) - 1, 256):
                spans = list(zip(edge[lo : lo + 256].tolist(), edge[lo + 1 : lo + 257].tolist()))
                blobs = pa.array([tag[a:b].tobytes() + fp[a:b].tobytes() for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), blobs], names=["bucket", "blob"])

    return pack


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b; label names each one's class by its least member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _crowd(fps: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ties of fingerprints (sorted) that differ in ``bits`` only: those that are equal but for two of them are
    within DISTANCE, so for each two bits the sorted masked values tell who belongs together, and no pairs are made."""
    label = np.arange(len(fps))
    for j, x in enumerate(bits):
        for y in bits[:j]:
            masked = fps & np.uint64(~(1 << x | 1 << y) & (1 << 64) - 1)
            order = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[order[1:]] == masked[order[:-1]])
            _merge(label, order[same], order[same + 1])
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[tied]], fps[tied]


def _tied(fps: np.ndarray, tag: int, direct: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints of one tag whose variants are equal."""
    i, p = (tag, None) if tag < 64 else divmod(tag - 64, 3)
    key = _keys(fps, i)
    if p is not None:  # exact, as the key fills the upper bits of 64 and a third's bits are packed below
        third = np.zeros(len(fps), np.uint64)
        for k, b in enumerate(_free(i)[11 * p : 11 * p + 11]):
            third |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
        key = key << np.uint64(11) | third
    order = np.lexsort((fps, key))
    fps, key = fps[order], key[order]
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    size = np.diff(edge)
    for g in np.flatnonzero(size > direct).tolist():
        own = set(range(11 * p, 11 * p + 11)) if p is not None else ()
        yield _crowd(fps[edge[g] : edge[g + 1]], [b for k, b in enumerate(_free(i)) if k not in own])
    left = np.repeat(np.where(size > direct, 0, edge[1:]), size)  # the end of each one's bucket, if that is compared directly
    at, d = np.flatnonzero(left > np.arange(len(fps)) + 1), 1
    while len(at):
        x, y = fps[at], fps[at + d]
        differ = x ^ y
        near = np.bitwise_count(differ) <= DISTANCE
        # each pair is told once: under the bit in which the lower segments differ, under 0 if they don't, under UPPER if in two
        low = differ & np.uint64(0xFFFFFFFF)
        here = np.bitwise_count(low) == 2 if i == UPPER else (low == np.uint64(1 << i)) | ((low == 0) & (i == 0))
        yield x[near & here], y[near & here]
        d += 1
        at = at[left[at] > at + d]


def _linker(direct: int):
    def link(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, prints = [], []
        for b in rows:
            for blob in b.column(1):
                data, n = blob.as_buffer(), blob.as_buffer().size // 9
                tags.append(np.frombuffer(data, np.uint8, n))
                prints.append(np.frombuffer(data, np.uint8, 8 * n, n))
        if not tags:
            return
        tag, fp = np.concatenate(tags), np.concatenate(prints).view(np.uint64)
        for t in np.unique(tag).tolist():
            for a, b in _tied(fp[tag == t], t, direct):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return link


def links(prints: DataFrame, direct: int = DIRECT, whole: int = WHOLE, share: int = SHARE) -> DataFrame:
    """(a, b) that tie all fingerprints (distinct, in column fp) at DISTANCE or less into the right components.

    Each fingerprint travels to the buckets of its 33 variants, packed in blobs, once. Where up to ``direct`` fingerprints
    have an equal variant, each pair is verified; more are sorted under masks instead. A variant with over 1/share of all is hot:
    its fingerprints go by thirds of the other bits, so that no more than 2^22 of them have to meet.
    """
    spark, fps = prints.sparkSession, prints.select("fp")
    total, hot = prints.count(), []
    share = max(share, total // CROWD)
    if total > whole:  # fewer can't fill a task
        found = fps.mapInArrow(_heavy(share), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        hot = [r[0] for r in found.filter(F.col("n") * (2 * share) > total).select("key").collect()]  # fewer than 66 * share
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 33 * 9 // BUCKET + 1)
    packed = fps.mapInArrow(_packer(4 * parts, hot), "bucket int, blob binary").repartition(parts, "bucket")
    return packed.mapInArrow(_linker(direct), "a long, b long")


def _placed(docs: DataFrame, id_col: str, text: str, similar: float | None, keyed: bool, **how) -> DataFrame:
    """(id, row, fp, component_id, keep_row), a row per row of docs. row and keep_row, the row that stays of a component (of the least id, null the last), are null unless keyed."""
    key = row_key("id", "t") if keyed or similar is not None else F.lit(None).cast(ROW)
    ids = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).withColumn("row", key)
    shape = [T.StructField("id", ids.schema["id"].dataType), ids.schema["row"]]
    if similar is None:
        rows = cut(ids.mapInArrow(_fingerprints, T.StructType([*shape, T.StructField("fp", T.LongType())])), "prints")
    else:
        more = [("fp", T.LongType()), ("s", T.LongType()), ("size", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
        rows = cut(ids.mapInArrow(_sketches, T.StructType([*shape, *[T.StructField(*x) for x in more]])), "prints")
    lead = F.struct(F.col("id").isNull().alias("z"), "id", "row")
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"), F.min(lead).alias("lead"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts, "firsts")
    found = links(firsts.select("fp"), **how)
    if similar is not None:
        found = found.unionAll(shingles.ties(rows, ids.select("row", "t"), similar))
        rows = rows.select("id", "row", "fp")
    nodes = components(found)
    named = firsts.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.min("lead")["row"].alias("keep_row"))
    groups = cut(named.join(least, "component").select("fp", "n", "component_id", "keep_row"), "groups")
    return attach(rows, groups, "fp", "n", rows.count(), "inner", "id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float | None = None, **how) -> DataFrame:
    """One row per row of docs: id, fp (signed 64 bits), component_id (the least id reachable over links).

    Null text has no words; texts without words have fingerprint zero and are linked like any other.
    A null id is never a component's name, unless the component has no other id. Repeated rows each
    give their row; an empty table gives none. Ids are of any type with an order. Other columns are not read. ``how`` goes to links().
    With ``similar``, texts whose five-word shingles have that Jaccard similarity are linked too, which fingerprints
    can't do: at 0.8 they differ in more bits than segments of 64 could index.
    """
    return _placed(docs, id_col, text, similar, False, **how).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float | None = None, **how) -> DataFrame:
    """One row of each component: that of the least id (null is the last), and of rows that share it the one of the least row key.

    Rows are told by id and text together; of rows that repeat both any one stays. All columns stay, whatever their names. ``how`` goes to near_groups().
    """
    found = cut(_placed(docs, id_col, text, similar, True, **how).select("row", (F.col("row") == F.col("keep_row")).alias("stays")), "kept")
    several = found.filter("stays").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    return without(docs, found.filter("not stays").select("row").distinct(), [id_col, text], several)
