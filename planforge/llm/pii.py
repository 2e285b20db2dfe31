"""PII sanitisation by disclosure.

Patterns find protected entities. A term that stands in an entity's documents discloses it as far as the
corpus says so: with N documents, n(e) and n(t) that hold the entity and the term, and n(e, t) that hold
both, PMI = log2(N n(e,t) / (n(e) n(t))) is compared with what there is to know, IC = log2(N / n(e)).
A term with PMI >= ALPHA * IC is a span too wherever it stands in a document that holds the entity, and is generalised or removed.
As n(e,t) >= n(t) (n(e) / N)^(1 - ALPHA) says the same, one meeting is enough for terms so rare that the right side is 1 or
less, and terms with a right side above n(e) can't disclose; only those between have their meetings counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, attach, blocks_of, cut, give, held_as, own, row_key, span_text, spans, text_of

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9]++(?:[ -][0-9]++)*+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: ALPHA: share of an entity's information that a term may give. An entity that stands in one document is protected like any other.
ALPHA = 0.8
#: Code points of a text that are gone through to find one place in it.
TILE = 1024
#: Room for rounding where a threshold is met exactly.
_EVEN = 1 - 1e-9
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """13 to 19 digits whose weighted sum is a multiple of 10."""
    d = F.reverse(_digits(m))

    def add(acc, i):
        x = F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    n = F.length(d)
    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets(m: Column) -> Column:
    def small(x):
        short = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)

    return F.forall(F.split(m, r"\."), small)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


#: kind, pattern, test of a match, literal that every match holds, form under which equal entities are one.
KINDS = (
    ("email", _EMAIL, None, "@", lambda m: ascii_lower(m)),
    ("ip", _IP, _octets, ".", lambda m: m),
    ("card", _CARD, _luhn, None, _digits),
    ("phone", _PHONE, _phone, "+", _digits),
)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _spans: the patterns' places, by kind as listed, then start; and _entities: the distinct forms of what stands there."""
    t = F.col("_text")
    df = docs.withColumn("_text", text_of(text))
    for i, (_, pattern, _, needs, _) in enumerate(KINDS):
        if pattern is _CARD:  # runs too short for a card take their text but are never kept
            wanted = F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){12}"))
        else:
            wanted = F.contains(t, F.lit(needs))
        df = df.withColumn(f"_m{i}", F.when(wanted, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")))
    each = [spans(t, F.col(f"_m{i}"), pattern, kind, i, keep) for i, (kind, pattern, keep, _, _) in enumerate(KINDS)]
    named = [_entities(F.col(f"_m{i}"), kind, keep, form) for i, (kind, _, keep, _, form) in enumerate(KINDS)]
    return df.withColumn("_spans", F.concat(*each)).withColumn("_entities", F.array_distinct(F.concat(*named))).drop(*[f"_m{i}" for i in range(len(KINDS))])


def _entities(found: Column, kind: str, keep, form) -> Column:
    return F.transform(F.filter(found, keep) if keep else found, lambda m: F.concat(F.lit(f"{kind}:"), form(m)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), 0))


def _words(held: DataFrame) -> DataFrame:
    """(row, term, start, end): all words of the texts, apart from those of entities."""
    found = F.regexp_extract_all("_text", F.lit(TERM), 0)
    by_start = F.transform(F.array_sort("_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    bounds = lambda b: F.struct(F.array_min(b)["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("all"))
    blocks = held_as(by_start, lambda a: F.transform(blocks_of(a, 128), bounds))
    each = held.select("row", "_text", found.alias("found"), blocks.alias("blocks"))
    words = F.zip_with(spans(F.col("_text"), F.col("found"), TERM, "term", len(KINDS)), "found", lambda w, f: F.struct(f.alias("term"), w["start"].alias("start"), w["end"].alias("end")))
    each = each.select("row", "blocks", F.explode(words).alias("w"))
    meets = lambda s: (s["start"] < F.col("w.end")) & (s["end"] > F.col("w.start"))
    apart = each.filter(~F.exists("blocks", lambda b: meets(b) & F.exists(b["all"], meets)))
    return apart.select("row", ascii_lower(F.col("w.term")).alias("term"), "w.start", "w.end")


def disclosing(texts: DataFrame, held: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(row, term): terms that disclose an entity of the row. texts has a _text for each document; held has the distinct rows with
    entities: row, m (documents that share it), _text and _entities. Counts are of documents, over all of them.

    Entities of the same documents are one, as all their counts are the same. A frequent term or entity is dealt out.
    """
    total = texts.count()
    said = cut(held.select("row", F.explode(_terms(F.col("_text"))).alias("term")), "said")
    n_t = texts.select(F.explode(_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n_t = cut(n_t.join(said.select("term").distinct(), "term", "left_semi"), "terms")
    said = cut(attach(said, n_t, "term", "n_t", n_t.agg(F.sum("n_t")).first()[0] or 0, "inner", "row").select("row", "term", "n_t"), "counted")
    holds = cut(held.select("row", "m", F.explode("_entities").alias("entity")), "holds")
    every = holds.groupBy("entity").agg(F.sum("m").alias("n_e"), F.count(F.lit(1)).alias("rows"), F.bit_xor("row.a").alias("a"), F.bit_xor("row.b").alias("b")).filter(F.col("n_e") < total)
    every = cut(every.select("entity", "rows", "n_e", F.struct("n_e", "a", "b").alias("e")), "entities")
    holds = attach(holds, every, "entity", "rows", holds.count(), "inner", "row")
    holds = cut(holds.select("row", "m", "e", "n_e").distinct(), "held")
    need = F.col("n_t") * F.pow(F.col("n_e") / F.lit(float(max(total, 1))), F.lit(1 - alpha)) * _EVEN
    rarest = holds.groupBy("row").agg(F.min("n_e").alias("n_e"))
    at_once = said.join(rarest, "row").filter(need <= 1).select("row", "term")
    both = holds.join(said, "row").withColumn("need", need).filter((F.col("need") > 1) & (F.col("need") <= F.col("n_e")))
    both = cut(both.select("row", "m", F.struct("e", "term").alias("pair"), "need"), "both")
    told = both.groupBy("pair").agg(F.sum("m").alias("n_et"), F.count(F.lit(1)).alias("rows"), F.min("need").alias("least")).filter("n_et >= least").select("pair", "rows")
    there = attach(both, cut(told, "told"), "pair", "rows", both.count(), "inner", "row")
    return at_once.unionAll(there.select("row", "pair.term")).distinct()


_SPANS = "array<struct<start:long,no:int,end:long,kind:string>>"


def _found(docs: DataFrame, id_col: str, text: str, alpha: float) -> DataFrame:
    """(row, id, base, spans), a row per row of docs."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text).alias("_text"), row_key(id_col, text).alias("row"))
    has = F.size("_spans") > 0
    marked = base_spans(rows, "_text").select("_id", "row", "_spans", F.when(has, F.col("_entities")).alias("_entities"), F.when(has, F.col("_text")).alias("_text"))
    marked = cut(marked, "pii")  # texts are written where there is an entity
    some = marked.filter("_text is not null").groupBy("row").agg(F.count(F.lit(1)).alias("m"), *[F.any_value(c).alias(c) for c in ("_text", "_spans", "_entities")])
    held = cut(some, "texts")
    words = cut(_words(held), "words")
    extra = words.join(cut(disclosing(rows, held, alpha), "told"), ["row", "term"], "left_semi")
    spot = F.struct("start", F.lit(len(KINDS)).alias("no"), "end", F.lit("term").alias("kind"))
    more = extra.groupBy("row").agg(F.array_sort(F.collect_set(spot)).cast(_SPANS).alias("_terms"))
    out = give(marked.select("_id", "row", "_spans"), cut(more, "more"))
    return out.select("row", F.col("_id").alias("id"), F.col("_spans").alias("base"), F.concat("_spans", F.coalesce("_terms", F.array().cast(_SPANS))).alias("spans"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per row of docs: id, base (array of start, no, end, kind) and spans (with disclosing terms as kind "term").

    Null text is empty; null ids and repeated rows each give their row, and each counts as a document; an empty table gives none.
    Other columns are not read.
    """
    return _found(docs, id_col, text, alpha).select(F.col("id").alias(id_col), "base", "spans")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", terms: str = "generalise", alpha: float = ALPHA) -> DataFrame:
    """docs with entities replaced by ``<KIND>`` and disclosing terms by ``<TERM>``, or removed (terms="remove").

    Spans that overlap are replaced together, by the kind that starts first. Null text stays null. All columns stay, whatever their names.
    """
    each = _found(docs, id_col, text, alpha).filter(F.size("spans") > 0).select("row", "spans").dropDuplicates(["row"]).select("row", F.explode("spans").alias("s"))
    before = Window.partitionBy("row").orderBy("s.start", "s.no").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("new", (F.col("s.start") >= F.coalesce(F.max("s.end").over(before), F.lit(0))).cast("int"))
    each = each.withColumn("group", F.sum("new").over(Window.partitionBy("row").orderBy("s.start", "s.no").rowsBetween(Window.unboundedPreceding, 0)))
    one = each.groupBy("row", "group").agg(F.min(F.struct("s.start", "s.no", "s.kind")).alias("first"), F.max("s.end").alias("end"))
    key, other, found = own(docs, "_row", "_match", "_found")
    held = one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first.start", "end", "first.kind"))).alias(found)).withColumnRenamed("row", other)
    df = docs.withColumn(key, row_key(id_col, text)).join(cut(held, "replaced"), F.col(key) == F.col(other), "left")
    tiles = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{TILE}}}"), 0)

    def piece(c, a, b):
        """The text from a to b, from the tiles that hold it."""
        first = F.floor(a / TILE).cast("int")
        some = F.array_join(F.slice(c["tiles"], first + 1, F.greatest(F.floor((b - 1) / TILE).cast("int") - first + 1, F.lit(0))), "")
        return F.substring(some, (a - first * TILE + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def rebuilt(c):
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(c["found"], lambda s: s["end"]))
        mark = lambda s: F.when(s["kind"] == "term", F.lit("<TERM>" if terms == "generalise" else "")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        parts = F.zip_with(c["found"], F.slice(ends, 1, F.size(c["found"])), lambda s, a: F.concat(piece(c, a, s["start"]), mark(s)))
        return F.concat(F.array_join(parts, ""), piece(c, F.element_at(ends, -1), c["size"]))

    clean = held_as(F.struct(tiles.alias("tiles"), F.col(found).alias("found"), F.length(text).cast("long").alias("size")), rebuilt)
    return df.withColumn(text, F.when(F.col(found).isNotNull(), clean).otherwise(F.col(text))).drop(key, other, found)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [_count(kind).alias(f"n_{kind}") for kind, *_ in KINDS]
    return found.select(id_col, *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
