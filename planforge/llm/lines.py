"""Line dedup by deletion neighbourhoods.

A line is its words, joined by one space. Equal lines are one; lines are near if one edit of a letter makes them equal: one put in, left out or
changed, or two neighbours swapped, and if the longer one has LETTERS letters (0.9 alike, then). Each line emits itself and its
variants with one letter left out as hashed keys; lines that share a key meet if the letters were left out at places that make them one
edit apart, and the texts verify it.

Only lines that can have a partner emit variants: of two lines one edit apart, the first or the last letters, almost half of them, are the
same, so a line whose halves no other line has is done, and the letters of a half that is shared needn't be left out. Keys
combine a hash for each letter and its place, from the left before the letter left out and one place less after it, so all variants come from running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, attach, cut, few, held_as, own, row_key, text_of

LETTERS = 10


def _plain(line: Column) -> Column:
    spaced = F.when(F.rlike(line, F.lit(r"[\t\x0B\f\r]")), F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line)
    return F.array_join(F.array_remove(F.split(spaced, " "), ""), " ")


def _lines(docs: DataFrame, letters: int) -> DataFrame:
    """(row, doc, pos, l1, l2, halves): a row per line that has a word; l1, l2 tell its words; halves from letters - 1 on."""
    each = docs.select("row", "doc", F.posexplode(F.split(text_of("t"), "\n")).alias("pos", "line"))
    each = each.select("row", "doc", "pos", _plain(F.col("line")).alias("w")).filter("w <> ''").withColumn("n", F.length("w"))
    return each.select("row", "doc", "pos", F.xxhash64("w").alias("l1"), F.xxhash64(F.lit(1), "w").alias("l2"), F.when(F.col("n") >= letters - 1, _halves()).alias("halves"))


def _half(n: Column) -> Column:
    """So many first and last letters leave one or two between, so two swapped neighbours are not in both."""
    return F.floor((n - 1) / 2).cast("int")


def _halves() -> Column:
    """Keys of first and last letters by turns, as many as lines of the same length share and as lines of one letter less do."""
    n, w = F.col("n"), F.col("w")
    same, less = _half(n), _half(n - 1)

    def keys(c):
        return [F.xxhash64(F.lit(0), c, F.substring(w, F.lit(1), c)), F.xxhash64(F.lit(1), c, F.substring(w, n - c + 1, c))]

    return F.when(same == less, F.array(*keys(same))).otherwise(F.array(*keys(same), *keys(less)))


def _variants(lines: DataFrame) -> DataFrame:
    """(k1, k2, i, x, l1, l2): the line itself (i = 0) and without letter i (from 1), which is x. lines: l1, l2, w, front, back (what they share)."""
    place = lambda j, salt: F.xxhash64(F.col("x"), j, F.lit(salt))
    each = lines.select("l1", "l2", "front", "back", F.length("w").alias("n"), F.posexplode(F.split("w", "")).alias("j", "x"))
    to, every = Window.partitionBy("l1", "l2").orderBy("j").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("l1", "l2")
    sums, own_ = {}, {}
    for s in (1, 2):
        sums[f"a{s}"], sums[f"b{s}"] = F.bit_xor(place(F.col("j"), s)).over(to), F.bit_xor(place(F.col("j") - 1, s)).over(to)
        sums[f"f{s}"] = F.bit_xor(place(F.col("j") - 1, s)).over(every)
        own_[f"g{s}"] = place(F.col("j"), s)
    each = each.withColumns(sums).withColumns(own_)
    without = [F.col(f"a{s}").bitwiseXOR(F.col(f"g{s}")).bitwiseXOR(F.col(f"f{s}")).bitwiseXOR(F.col(f"b{s}")).alias(f"k{s}") for s in (1, 2)]
    here = (F.col("front") & (F.col("j") >= _half(F.col("n") - 1))) | (F.col("back") & (F.col("j") < F.col("n") - _half(F.col("n") - 1)))
    out = each.filter(here).select(*without, (F.col("j") + 1).alias("i"), "x", "l1", "l2")
    last = each.filter(F.col("j") == F.col("n") - 1).select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.lit(0).alias("i"), F.lit("").alias("x"), "l1", "l2")
    return out.unionAll(last)


def _without(w: Column, i: Column) -> Column:
    return F.when(i == 0, w).otherwise(F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))


def _near(first: DataFrame, words: DataFrame, letters: int) -> DataFrame:
    """(l1, l2) of lines that an earlier line is one edit away from. first: l1, l2, doc, pos of distinct candidates."""
    key = F.struct("k1", "k2").alias("key")
    every = cut(_variants(words.repartition("l1", "l2")).select(key, "i", "x", "l1", "l2"), "variants")
    met = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "met")
    v = attach(every, met, "key", "n", every.count(), "left_semi", "l1", short=True)
    v = cut(v.join(few(first), ["l1", "l2"]), "met")
    who = F.struct(F.col("doc").isNull().alias("z"), "doc", "pos", "l1", "l2", "i")
    # where lines meet: one of them whole (a letter put in or left out), at the same place (changed), or the same letter at neighbouring places (swapped)
    place = lambda kind, i, x: F.struct("key", F.lit(kind).alias("kind"), F.lit(i) if isinstance(i, int) else i.alias("i"), x.alias("x"))
    same, none, i = F.col("i"), F.lit(""), F.col("i")
    ats = F.when(i == 0, F.array(place("whole", F.lit(0), none))).otherwise(F.array(place("whole", F.lit(0), none), place("place", same, none), place("swap", same, F.col("x")), place("swap", i - 1, F.col("x"))))
    mine = cut(v.select(F.explode(ats).alias("at"), who.alias("me")), "mine")
    itself, others = F.min(F.when(F.col("me.i") == 0, F.col("me"))).alias("itself"), F.min(F.when(F.col("me.i") > 0, F.col("me"))).alias("others")
    groups = cut(mine.groupBy("at").agg(itself, others, F.count(F.lit(1)).alias("n")).filter("n > 1"), "apart")
    links = attach(mine, groups, "at", "n", mine.count(), "inner")
    other = F.when((F.col("at.kind") == "whole") & (F.col("me.i") > 0), F.col("itself")).otherwise(F.col("others"))
    links = links.select("me", other.alias("m")).filter((F.col("m") < F.col("me")) & ((F.col("m.l1") != F.col("me.l1")) | (F.col("m.l2") != F.col("me.l2"))))
    links = cut(links.select("me.l1", "me.l2", F.col("me.i").alias("i"), F.struct("m.l1", "m.l2").alias("o"), F.col("m.i").alias("oi")).distinct(), "links")
    theirs = words.join(links.groupBy("o").agg(F.count(F.lit(1)).alias("n")).select(F.col("o.l1").alias("l1"), F.col("o.l2").alias("l2"), "n"), ["l1", "l2"])
    theirs = cut(theirs.select(F.struct("l1", "l2").alias("o"), F.col("w").alias("ow"), "n"), "theirs")
    checked = attach(links, theirs, "o", "n", links.count(), "inner", "l1").join(words.select("l1", "l2", "w"), ["l1", "l2"])
    swapped = F.substring("w", F.col("i"), F.lit(1)) == F.substring("ow", F.col("oi"), F.lit(1))
    edit = (F.col("i") == 0) | (F.col("oi") == 0) | (F.col("i") == F.col("oi")) | ((F.abs(F.col("i") - F.col("oi")) == 1) & swapped)
    long_ = F.greatest(F.length("w"), F.length("ow")) >= letters
    return checked.filter(long_ & edit & (_without(F.col("w"), F.col("i")) == _without(F.col("ow"), F.col("oi")))).select("l1", "l2").distinct()


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", letters: int = LETTERS) -> DataFrame:
    """docs, each row with n_lines, n_removed and its text without the lines that equal, or nearly equal, an earlier line.

    Earlier is: smaller id, or same row and higher up; a null id comes last; rows that share id and text are one
    document, rows that share the id only go by a hash of their texts. Lines are judged on the input: a line
    goes if an earlier one is near, whether or not that one stays. Lines without words stay. Null text stays null. An
    empty table gives no rows. Letters are code points, as they are. All columns stay: where docs has n_lines or n_removed, the new one bears an underscore more.
    """
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("t"), row_key(id_col, text).alias("row"))
    every = cut(_lines(keyed, letters), "lines")
    total, line = every.count(), F.struct("l1", "l2").alias("line")
    halves = every.select("l1", "l2", F.posexplode("halves").alias("side", "half")).withColumn("side", F.col("side") % 2)
    shared = halves.groupBy("half").agg(F.min("l1").alias("a"), F.max("l1").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b").select("half", "n")
    shared = cut(shared, "shared")
    able = attach(halves, shared, "half", "n", 4 * total, "left_semi", "l1", short=True)
    able = able.groupBy("l1", "l2").agg(F.max(F.col("side") == 0).alias("front"), F.max(F.col("side") == 1).alias("back"))
    able = able.select(line, F.struct("front", "back").alias("able"))
    repeated = every.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(line, "n")
    wanted = cut(repeated.join(able, "line", "full").withColumn("n", F.coalesce("n", F.lit(1))), "wanted")
    places = cut(attach(every.select("row", "doc", "pos", line), wanted, "line", "n", total, "inner", short=True), "places")
    order = F.struct(F.col("doc").isNull().alias("z"), "doc", "row", "pos")
    first = places.groupBy("line").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n"), F.any_value("able").alias("able"))
    first = cut(first.select("line", "n", F.col("m.doc").alias("doc"), F.col("m.row").alias("frow"), F.col("m.pos").alias("fpos"), "able"), "first")
    candidates = cut(first.filter("able is not null").select("line.l1", "line.l2", "doc", F.struct("frow", "fpos").alias("pos"), "able"), "able")
    # each candidate's text is read once, where it stands first
    spots = cut(candidates.groupBy(F.col("pos.frow").alias("row")).agg(F.collect_list(F.struct(F.col("pos.fpos").alias("p"), "l1", "l2", "able")).alias("spots")), "spots")
    held = keyed.join(F.broadcast(spots) if candidates.count() <= SMALL else spots, "row")
    read = held_as(F.struct(F.split("t", "\n").alias("parts"), F.col("spots").alias("spots")), lambda c: F.transform(c["spots"], lambda s: F.struct(s["l1"].alias("l1"), s["l2"].alias("l2"), s["able"].alias("able"), c["parts"][s["p"]].alias("line"))))
    found = held.select(F.explode(read).alias("s")).select("s.l1", "s.l2", _plain(F.col("s.line")).alias("w"), "s.able.front", "s.able.back")
    words = cut(found.dropDuplicates(["l1", "l2"]), "words")
    near = _near(candidates.drop("able"), words, letters).select(line, F.lit(True).alias("near"))
    known = cut(first.drop("able", "doc").join(near, "line", "left").withColumn("near", F.coalesce("near", F.lit(False))), "known")
    judged = attach(places.select("row", "pos", "line"), known, "line", "n", total, "inner", short=True)
    goes = F.col("near") | (F.col("row") != F.col("frow")) | (F.col("pos") != F.col("fpos"))
    key, match, at, n_lines, n_removed = own(docs, "_row", "_match", "_gone", "n_lines", "n_removed")
    gone = cut(judged.filter(goes).groupBy(F.col("row").alias(match)).agg(F.array_sort(F.collect_set("pos")).alias(at)), "gone")
    if (gone.agg(F.sum(F.size(at))).first()[0] or 0) <= SMALL:  # then the texts need not be shuffled
        gone = F.broadcast(gone)
    out = docs.withColumn(key, row_key(id_col, text)).join(gone, F.col(key) == F.col(match), "left")
    parts, none = F.split(F.col(text), "\n"), F.array().cast("array<int>")

    def kept(c):
        """What stands before, between and after the lines that go, in one pass."""
        before = F.concat(F.array(F.lit(-1)), c["gone"])
        after = F.concat(c["gone"], F.array(F.size(c["parts"])))
        return F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(c["parts"], a + 2, b - a - 1))), "\n")

    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")
    left = held_as(F.struct(parts.alias("parts"), F.coalesce(at, none).alias("gone")), kept)
    out = out.withColumns({n_lines: n, n_removed: F.coalesce(F.size(at), F.lit(0)).cast("long"), text: F.when(F.col(at).isNull(), F.col(text)).otherwise(left)})
    return out.drop(key, match, at)
