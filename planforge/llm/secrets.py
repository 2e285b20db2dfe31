"""Secret scans over a ledger of blobs.

Every version of a file is a row; its text's SHA-256 names the blob. The ledger holds, by blob,
which rule versions have seen it and what they found. A scan reads each unseen pair of blob and rule
version once, appends to the ledger, and joins findings back to all rows that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, shared_dir, span_text, spans, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # Java; linear in the text
    version: int = 1
    keep: Callable[[Column], Column] | None = None  # of the match
    needs: str | None = None  # a literal that every match holds
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", _ASSIGN, keep=lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", keep=lambda m: F.length(m) >= 18, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),  # a run is taken whole, so shorter runs need no match
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="-----BEGIN", base=False),
    Rule("vcs_token", r"gh[oprsu]_[A-Za-z0-9]{30,}", needs="gh", base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs="eyJ", base=False),
)
LEDGER = "blob string, scanned array<string>, spans array<struct<start:long,no:int,end:long,kind:string,rule:string>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LEDGER)
        raise


def _of_rule(found: Column, rule: Rule) -> Column:
    return F.transform(found, lambda s: s.withField("rule", F.lit(rule.key)))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def scan_unseen(versions: DataFrame, ledger: str, rules=RULES, text: str = "text") -> None:
    """Scans what the ledger has not seen and appends one ledger row per blob that was scanned."""
    spark = versions.sparkSession
    blobs = versions.select(text_of(text).alias("_t")).select(F.sha2("_t", 256).alias("blob"), "_t").distinct()
    seen = read_ledger(spark, ledger)
    keys = F.array(*[F.lit(r.key) for r in rules])
    if seen.isEmpty():
        todo = blobs.withColumn("scanned", keys)
    else:
        done = seen.select("blob", F.explode("scanned").alias("k")).groupBy("blob").agg(F.collect_set("k").alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("scanned", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))).drop("done")
        todo = todo.filter(F.size("scanned") > 0)
    for i, r in enumerate(rules):
        wanted = F.array_contains("scanned", r.key)
        wanted = wanted & F.contains("_t", F.lit(r.needs)) if r.needs else wanted
        todo = todo.withColumn(f"_m{i}", F.when(wanted, F.regexp_extract_all("_t", F.lit(r.pattern), 0)).otherwise(F.array().cast("array<string>")))
    each = [_of_rule(spans(F.col("_t"), F.col(f"_m{i}"), r.pattern, r.kind, i, r.keep), r) for i, r in enumerate(rules)]
    todo.select("blob", "scanned", F.concat(*each).alias("spans")).write.mode("append").parquet(ledger)


def find_secrets(versions: DataFrame, ledger: str | None = None, rules=RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of versions: id, blob, spans (array of start, no, end, kind), by start and then rule.

    Null text is empty text and has no secret; null ids and repeated rows each give their row; an
    empty table gives none. Other columns are not read. Without a ledger a fresh one is used.
    """
    spark = versions.sparkSession
    if ledger is None:
        import uuid

        ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    scan_unseen(versions, ledger, rules, text)
    paths = versions.select(F.col(id_col).alias("_id"), F.sha2(text_of(text), 256).alias("blob"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    found = (
        read_ledger(spark, ledger).filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
        .filter(F.array_contains(keys, F.col("s.rule"))).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("s.start", "s.no", "s.end", "s.kind"))).alias("spans"))
    )
    sizes = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("_n"))
    groups = found.join(sizes, "blob")
    out = attach(paths, groups, "blob", "_n", versions.count(), "left", "_id")
    none = F.array().cast("array<struct<start:long,no:int,end:long,kind:string>>")
    return out.select(F.col("_id").alias(id_col), F.col("blob"), F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame, rules=RULES, id_col: str = "doc_id") -> DataFrame:
    base = [r.kind for r in rules if r.base]
    held = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [_count(k).alias(f"n_{k}") for k in base]
    return found.select(id_col, *counts, F.sha2(span_text(held), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
