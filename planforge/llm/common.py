"""What the operators share: text rules, row keys, written cuts, joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java classes: what stands between words, for words of any signs and for words of letters and digits.
BLANK, MARKS = r"[ \t-\r]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A key with more than 1/SHARES of all rows is hot; so there are fewer than SHARES hot keys.
SHARES, LEAST_HOT = 1000, 200
#: So many short rows may be broadcast, after they have been counted.
SMALL = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_of(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that to ASCII text, and faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column, between: str = BLANK) -> Column:
    return F.array_remove(F.split(c, between), "")


#: Type of row_key().
ROW = "struct<a:bigint,b:bigint>"


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by content; equal rows share it, so results joined by it hold for each of them."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def own(df: DataFrame, *names: str) -> list[str]:
    """Column names that df has not: the given ones, each with as many underscores after it as that takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame, columns: list[str], several: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose row_key(*columns) is in gone; of those that are in several, too, one of each
    stays. Both have one column, row, of distinct keys. Rows are judged by their own content, never by an id that they share; all columns stay."""
    key, other = own(docs, "_row", "_gone")
    keyed, found = docs.withColumn(key, row_key(*columns)), gone.select(F.col("row").alias(other))
    if several is None or several.isEmpty():
        return keyed.join(found, F.col(key) == F.col(other), "left_anti").drop(key)
    twice = several.select(F.col("row").alias(other))
    rest = keyed.join(found.unionAll(twice), F.col(key) == F.col(other), "left_anti")
    return rest.unionAll(keyed.join(twice, F.col(key) == F.col(other), "left_semi").dropDuplicates([key])).drop(key)


def numbered(rows: DataFrame, key: str, name: str, salts: int = 256) -> DataFrame:
    """rows with ``name``: 0, 1, … within each key. A key's rows are numbered in ``salts`` parts, so a hot one is not sorted in one task."""
    uid, salt, before = own(rows, "_uid", "_salt", "_before")
    held = cut(rows.withColumn(uid, F.monotonically_increasing_id()).withColumn(salt, F.pmod(F.xxhash64(uid), F.lit(salts))), "numbered")
    parts = held.groupBy(key, salt).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(key).alias("_k"), F.col(salt).alias("_s"), F.coalesce(ahead, F.lit(0)).alias(before))
    here = held.withColumn(name, F.row_number().over(Window.partitionBy(key, salt).orderBy(uid)) - 1)
    both = here.join(parts, here[key].eqNullSafe(parts["_k"]) & (here[salt] == parts["_s"]))
    return both.withColumn(name, F.col(name) + F.col(before)).drop(uid, salt, before, "_k", "_s")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="planforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here and survives lost executors.

    What was shuffled to make it is removed from the executors' disks as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def few(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, which is written and has short rows, for a join: broadcast if it has at most ``most`` of them, else shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def hot_limit(total: int) -> int:
    return max(LEAST_HOT, total // SHARES)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left", salt: str | None = None, short: bool = False) -> DataFrame:
    """rows join groups, which has one row a key and in ``size`` the key's rows.

    Hot keys (fewer than SHARES, so they are broadcast) are dealt out over salts, and their
    one row in groups is repeated for each salt. Other keys have at most hot_limit rows. If groups is written
    and its rows are ``short``, and it has at most SMALL of them, it is broadcast as a whole.
    """
    if short and groups.count() <= SMALL:
        return rows.join(F.broadcast(groups.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")
    limit = hot_limit(total)
    hot = groups.filter(F.col(size) > limit).select(F.col(key).alias("_hot"), F.ceil(F.col(size) / limit).cast("int").alias("_salts"))
    left = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
    spread = F.pmod(F.xxhash64(F.col(salt)) if salt else F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int")
    left = left.withColumn("_salt", spread).drop("_hot", "_salts")
    n = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit).cast("int")).otherwise(1)
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).withColumnRenamed(key, "_key")
    return left.join(right, F.col(key).eqNullSafe(F.col("_key")) & (left["_salt"] == right["_salt"]), how).drop("_salt", "_key")


def give(rows: DataFrame, found: DataFrame, key: str = "row") -> DataFrame:
    """rows, which is written, with what found has for their key (one row a key, not null), null where it has nothing. A key that many rows share is dealt out."""
    total = rows.count()
    limit = hot_limit(total)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = cut(hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / limit).cast("int").alias("_salts")), "hot")  # fewer than SHARES rows
    if hot.isEmpty():
        return rows.join(found, key, "left")
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").drop("_hot")
    left = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = found.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").drop("_hot")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def held_as(value: Column, use) -> Column:
    """use(value), with value computed once; inside lambdas an expression would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def blocks_of(array: Column, size: int) -> Column:
    """A column's array (not empty) in arrays of ``size`` consecutive elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int")), lambda b: F.slice(array, b * size + 1, size))


def spans(text: Column, found: Column, pattern: str, kind: str, order: int, keep=None) -> Column:
    """array<start, kind_no, end, kind> in code points of the matches in ``found``, which
    regexp_extract_all(text, pattern, 0) made; what split() leaves between them gives the places.
    ``keep(match)`` drops matches, but not the text that they take.

    Places add up within blocks of matches and over the blocks' sums, so a text of very many matches does not copy its
    result once for each of them."""
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:long,no:int,end:long,kind:string>>")
    kept = keep or (lambda m: F.lit(True))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"), kept(m).alias("kept")))

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + x["own"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("no"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("pos"), F.when(x["kept"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def from_(pos, block):
        return F.aggregate(block, F.struct(pos.alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])

    def begins(blocks):
        none = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<bigint>").alias("out"))
        length = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["own"])
        return F.aggregate(blocks, none, lambda acc, b: F.struct((acc["pos"] + length(b)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])

    places = held_as(pairs, lambda p: held_as(blocks_of(p, 128), lambda bs: F.flatten(F.zip_with(begins(bs), bs, from_))))
    return F.when(F.size(found) > 0, places).otherwise(empty)


def span_text(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
