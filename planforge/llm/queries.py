"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, licenses, lines, mixing, pii, quality, secrets, simhash, substrings


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_docs(spark, d)).select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_docs(spark, d)))


def op3_substrings(spark: SparkSession, d: str) -> DataFrame:
    return substrings.remove_repeats(_docs(spark, d)).drop("kept")


def op4_exact(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_groups(_docs(spark, d))


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_groups(_docs(spark, d)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(pii.find_personal(_docs(spark, d)))


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.resample(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet")).drop("row")


def op8_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.drop_lines(_docs(spark, d)).select("doc_id", "n_lines", "n_removed", "text")


def op9_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_leaks(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")))


def op10_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_secrets, op3_substrings, op4_exact, op5_simhash, op6_pii, op7_quality, op8_lines, op9_decontaminate, op10_licenses)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM p),
g AS (SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 19)))) AS gone FROM r WHERE k > 1 GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, d.w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
e AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
o AS (SELECT e.doc_id, e.i FROM g, unnest(g.gone) AS u(i), e WHERE e.doc_id = g.doc_id AND e.i = u.i),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN o ON e.doc_id = o.doc_id AND e.i = o.i GROUP BY e.doc_id)
SELECT b.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)""",
        "op4_exact": f"""
WITH t AS (SELECT doc_id, {_LOW} AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256 FROM t""",
        "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS j FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS x FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS x
 FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN win ON dw.x = win.x AND dw.n = win.n),
a AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)""",
    }
