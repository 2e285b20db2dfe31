"""License scans by diagonal voting.

All word k-grams of a document are joined by hash to the places that they have in license templates.
A match at word p of the document and word q of the template votes for diagonal p - q: all words
of a passage that follows the template vote for the same one, and an inserted or dropped word moves
to a neighbouring one. Where neighbouring diagonals together have votes enough, the words there are
aligned with the template, in order, and their edit distance decides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MARKS, ascii_lower, cut, give, row_key, text_of, words_of
from .license_texts import TEXTS

#: Templates of LONG words or more vote by three words, shorter ones by two.
LONG = 16
#: Phrases that give a base label wherever their words stand consecutively.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: COVER: 1 - word edits / words of the template that a notice needs; its numbers must all be there. NEAR: diagonals that vote
#: together; VOTES: share of a template's k-grams that it takes to be looked at, which COVER implies in templates of up to NEAR changes.
COVER, NEAR, VOTES = 0.8, 12, 0.3
#: Notices of one family that start so near to each other are readings of one place: the best of them stands.
APART = 8
_FILL = "?"


def templates() -> list[tuple]:
    """(t, label, base, words, k)."""
    split = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", x.lower())
    rows = [(label, True, split(words)) for words, label in PHRASES.items()] + [(label, False, split(words)) for label, words in TEXTS]
    return [(t, label, base, w, 3 if not base and len(w) >= LONG else 2) for t, (label, base, w) in enumerate(rows)]


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Grams (t, q, a, b, c: the words; c is null in pairs) and templates (t, label, family, base, k, grams, size, codes, needs). Both are fixed in this package, so they may be broadcast.

    codes has one sign for each word of a template, the same for the same word in all of them; needs has those of its numbers.
    """
    all_ = templates()
    code = {w: chr(0x4E00 + i) for i, w in enumerate(sorted({w for *_, words, _ in all_ for w in words}))}
    grams = [(t, q, *w[q : q + k], *[None] * (3 - k)) for t, _, _, w, k in all_ for q in range(len(w) - k + 1)] + [(-1, 0, "", None, None)]
    heads = [(t, label, re.sub("^[al]gpl", "gpl", label).split("-")[0], base, k, len(w) - k + 1, len(w), "".join(code[x] for x in w), [code[x] for x in dict.fromkeys(w) if x.isdigit()]) for t, label, base, w, k in all_]
    return (
        spark.createDataFrame(grams, "t int, q int, a string, b string, c string").withColumn("h", F.xxhash64("a", "b")),
        spark.createDataFrame(heads, "t int, label string, family string, base boolean, k int, grams int, size int, codes string, needs array<string>"),
    )


def _votes(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, p, t, q): the votes, and for each row of docs one with t = -1, whose p is its number of words. Texts are read once."""
    w = F.col("_w")
    triples = F.zip_with(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))), lambda x, c: F.struct(x["a"].alias("a"), x["b"].alias("b"), c.alias("c")))
    none = F.lit(None).cast("string")
    end = F.array(F.struct(F.lit("").alias("a"), none.alias("b"), none.alias("c")))
    each = docs.select(*keys, words_of(ascii_lower(text_of(text)), MARKS).alias("_w")).select(*keys, F.posexplode(F.concat(triples, end)).alias("p", "g"))
    grams = F.broadcast(_tables(docs.sparkSession)[0])
    same = (F.xxhash64("g.a", "g.b") == F.col("h")) & (F.col("g.a") == F.col("a")) & F.col("g.b").eqNullSafe(F.col("b")) & (F.col("c").isNull() | (F.col("g.c") == F.col("c")))
    return each.join(grams, same).select(*keys, F.col("p").cast("long").alias("p"), "t", "q")


def _aligned(votes: DataFrame, heads: DataFrame) -> DataFrame:
    """(row, t, label, start, cover): places that the alignment verifies."""
    d = F.col("p") - F.col("q")
    lines = votes.groupBy("row", "t", d.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("row", "t").orderBy("d").rangeBetween(-NEAR, NEAR)
    lines = lines.withColumn("sum", F.sum("n").over(around)).withColumn("rank", F.struct("sum", "n", (-F.col("d")).alias("d")))
    peaks = lines.withColumn("best", F.max("rank").over(around)).filter(F.col("rank") == F.col("best")).select("row", "t", "d", "sum")
    peaks = peaks.join(F.broadcast(heads), "t").filter(F.col("sum") >= F.greatest(F.lit(1.0), VOTES * F.col("grams")))
    # votes go to the peaks within NEAR of their diagonal; both are dealt in steps, so peaks don't meet all votes of a text
    step = 2 * NEAR
    there = peaks.withColumn("step", F.explode(F.sequence(F.floor((F.col("d") - NEAR) / step), F.floor((F.col("d") + NEAR) / step))))
    mine = votes.select(F.col("row").alias("_row"), F.col("t").alias("_t"), "p", "q", d.alias("e")).withColumn("_step", F.floor(F.col("e") / step))
    met = there.join(mine, (F.col("row") == F.col("_row")) & (F.col("t") == F.col("_t")) & (F.col("step") == F.col("_step"))).filter(F.abs(F.col("e") - F.col("d")) <= NEAR)
    said = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((F.col("p") + i).alias("at"), F.substring("codes", F.col("q") + i + 1, F.lit(1)).alias("code")))
    whole = met.select("row", "t", "d", said.alias("said"), F.abs(F.col("e") - F.col("d")).alias("off"))
    held = whole.groupBy("row", "t", "d").agg(F.array_distinct(F.flatten(F.collect_list("said"))).alias("all"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("off") <= 2, F.col("said"))))).alias("close"))
    one = held.join(F.broadcast(heads), "t")
    cases = one.select("row", "t", "label", "family", "size", "codes", "needs", F.explode(F.array("all", "close")).alias("said")).filter(F.size("said") > 0)
    at = F.transform("said", lambda x: x["at"])
    cases = cases.withColumns({"start": F.array_min(at), "end": F.array_max(at), "by": F.map_from_entries("said")})
    line = F.array_join(F.transform(F.sequence("start", "end"), lambda i: F.coalesce(F.element_at("by", i), F.lit(_FILL))), "")
    cases = cases.withColumn("line", line).filter(F.forall("needs", lambda x: F.contains(F.col("line"), x)))
    cover = 1 - F.levenshtein(F.col("line"), F.col("codes")) / F.col("size")
    return cases.withColumn("cover", cover).filter(F.col("cover") >= COVER).select("row", "t", "label", "family", "size", "start", "cover")


def _places(votes: DataFrame, spark: SparkSession) -> DataFrame:
    """(row, label, base, start, cover) of the votes, distinct places."""
    heads = _tables(spark)[1]
    base = votes.join(F.broadcast(heads.filter("base").select("t", "label", "grams")), "t")
    phrases = base.groupBy("row", "label", "grams", (F.col("p") - F.col("q")).alias("start")).agg(F.count(F.lit(1)).alias("n")).filter("n = grams")
    notices = _aligned(votes.join(F.broadcast(heads.filter("not base").select("t")), "t", "left_semi"), heads.filter("not base"))
    near = Window.partitionBy("row", "family").orderBy("start").rangeBetween(-APART, APART)
    stands = notices.withColumn("rank", F.struct("cover", "size")).withColumn("best", F.max("rank").over(near)).filter(F.col("rank") == F.col("best"))
    out = phrases.select("row", "label", F.lit(True).alias("base"), "start", F.lit(1.0).alias("cover"))
    return out.unionByName(stands.select("row", "label", F.lit(False).alias("base"), "start", "cover")).distinct()


def license_spans(docs: DataFrame, text: str = "text", key: str = "_row") -> DataFrame:
    """(key, label, base, start, cover): verified places, one row each; rows that share a key count as one text.

    A phrase is a place if its diagonal has all k-grams; a notice if its words and those of the place are COVER alike.
    """
    votes = _votes(docs.withColumnRenamed(key, "row"), text, "row").filter("t >= 0").distinct()
    return _places(cut(votes, "votes"), docs.sparkSession).withColumnRenamed("row", key)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty; null ids and repeated rows each give their row; an empty table gives none.
    Other columns are not read. score is the largest cover of a template found, 0 if none is.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"), row_key(id_col, text).alias("row"))
    every = cut(_votes(rows, "_t", "_id", "row"), "votes")
    votes = every.filter("t >= 0").select("row", "p", "t", "q").distinct()
    found = _places(votes, docs.sparkSession).groupBy("row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    )
    out = give(every.filter("t < 0").select("_id", "row", F.col("p").alias("n_words")), cut(found, "found"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
