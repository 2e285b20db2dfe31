"""Exact dedup by chunk recipes.

A text is cut at places that its own content defines. Chunks, not documents, are shuffled, each
distinct chunk once per map task, to verify that an identifier stands for one chunk only; from
then on a document is its ordered list of identifiers, and equal lists are equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach, cut, row_key, text_of, without

#: A chunk ends after a blank and one of b, c, d, after the like in unbroken text, or after a mark between clauses, from
#: LEAST characters on; where there is none up to MOST, it ends there.
LEAST, MOST = 512, 8192
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:[ \n][b-d]|[+/][a-d0-3]|[、。，]|\z)|.{{1,{MOST}}}"


def _chunks(docs: DataFrame, text: str, ident) -> DataFrame:
    df = docs.withColumn("_norm", ascii_lower(text_of(text)))
    return df.withColumn("_chunks", F.regexp_extract_all("_norm", F.lit(CHUNK), 0))


def _placed(docs: DataFrame, id_col: str, text: str, ident) -> DataFrame:
    """(_id, row, keep_id, keep_row, group_size, text_sha256), a row per row of docs."""
    cut_up = _chunks(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"), row_key(id_col, text).alias("row")), "_t", ident)
    named = cut_up.select(F.explode("_chunks").alias("chunk")).select(ident(F.col("chunk")).alias("ident"), "chunk").distinct()
    doubtful = named.groupBy("ident").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("ident")
    recipes = cut_up.select("_id", "row", F.sha2("_norm", 256).alias("text_sha256"), F.transform("_chunks", lambda c: ident(c)).alias("recipe"))
    if doubtful.isEmpty():
        recipes = recipes.withColumn("recipe", F.struct("recipe", F.lit(None).cast("array<struct<p:int,r:int>>").alias("ranks")))
    else:
        recipes = _ranked(cut_up, named, doubtful, recipes, ident)
    # a text's digest stands beside its recipe, not for it: lists are what is compared
    groups = recipes.groupBy("recipe").agg(F.max(F.struct("_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.select("recipe", F.col("top._id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"), "recipes")
    return attach(recipes, groups, "recipe", "group_size", docs.count(), "inner", "_id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ident=F.xxhash64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the text with A-Z lower-cased).

    The largest id of equal texts stays. Null text counts as empty; a null id is smaller than any
    other. Rows that repeat the id that stays are all marked kept. An empty table gives no rows.
    Other columns are not read. ``ident`` makes a chunk's identifier; where it gives two chunks the
    same one, the chunk's rank among them is added, so equality is exact for any ident.
    """
    out = _placed(docs, id_col, text, ident)
    return out.select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _ranked(cut_up: DataFrame, named: DataFrame, doubtful: DataFrame, recipes: DataFrame, ident) -> DataFrame:
    """Identifiers that stand for several chunks get, per place, the number of smaller chunks that share them."""
    few = named.join(doubtful, "ident", "left_semi")
    # digests order the chunks of one identifier, so no task gathers them
    a, b = (few.select("ident", F.sha2("chunk", 256).alias(n)) for n in ("sha", "other"))
    ranks = a.join(b, "ident").groupBy("ident", "sha").agg(F.sum((F.col("other") < F.col("sha")).cast("int")).cast("int").alias("r"))
    places = cut_up.select(F.sha2("_norm", 256).alias("text_sha256"), F.posexplode("_chunks").alias("p", "chunk")).distinct()
    places = places.select("text_sha256", "p", ident(F.col("chunk")).alias("ident"), F.sha2("chunk", 256).alias("sha")).join(ranks, ["ident", "sha"])
    lists = places.groupBy("text_sha256").agg(F.array_sort(F.collect_set(F.struct("p", "r"))).alias("ranks"))
    return recipes.join(lists, "text_sha256", "left").withColumn("recipe", F.struct("recipe", "ranks")).drop("ranks")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts: that of the largest id (null is the least), and of rows that share it any one.

    Rows are told by id and text together, so rows that share only an id, a null one too, are judged apart. All columns stay, whatever their names.
    """
    found = cut(_placed(docs, id_col, text, F.xxhash64).select("row", (F.col("row") == F.col("keep_row")).alias("stays")), "kept")
    several = found.filter("stays").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    return without(docs, found.filter("not stays").select("row").distinct(), [id_col, text], several)
