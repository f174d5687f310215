"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, langid, licenses, neardup, packing, quality, sharding, substring, topk, warc


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text without passages that an earlier document has, with their places."""
    cut = substring.substring_dedup(_docs(spark, d).select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return cut.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "n_removed", spans.alias("spans"), "text")


def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(_docs(spark, d)).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept")


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    model = langid.fitted(docs)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_docs(spark, d), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(_docs(spark, d))


def op6_topk_search(spark: SparkSession, d: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{d}/embeddings.parquet"))


def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    out = warc.read(warc.write(spark.read.parquet(f"{d}/pages.parquet")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, d))


def op9_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(_docs(spark, d))


def op10_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.digests(_docs(spark, d), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_language_id, op4_packing, op5_sharding, op6_topk_search, op7_warc, op8_near_dedup, op9_license_scan, op10_byte_bpe)}


OP6 = """
WITH q AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q a JOIN q b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q),
g AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM g
"""


def _op2() -> str:
    """Counts by lists and windows, sketches by the same bucket rule, limits by the closest quantiles that hold half of the rows, or nine tenths."""
    base = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    rules = " UNION ALL ".join(f"SELECT r, lang, source, '{r}' AS rule, CASE WHEN {b} > 0 THEN (1000 * {a}) // {b} ELSE 0 END AS v FROM m WHERE NOT {base}" for r, (a, b, _) in quality.RULES.items())
    fails = " OR ".join(f"(rule = '{r}' AND (1000 * ({a} - 3) > hi * {b}{f' OR 1000 * ({a} + 3) < lo * {b}' if low else ''}))" for r, (a, b, low) in quality.RULES.items())
    pairs = lambda step: "list_sort([" + ", ".join(f"{{'width': p[{k + step + 1}] - q[{k + 1}], 'lo': q[{k + 1}], 'hi': p[{k + step + 1}]}}" for k in range(21 - step)) + "])[1]"
    low = lambda b: f"CASE WHEN {b} < 32 THEN {b} ELSE CAST(({b} % 32 + 32) * pow(2, {b} // 32 - 1) AS BIGINT) END"
    at = lambda v: ", ".join(f"min(CASE WHEN up * 20 >= al * {k} THEN {v} END)" for k in range(21))
    level = lambda name, keys: f"""
{name}_h AS (SELECT {keys}, b, sum(n) AS n FROM sk GROUP BY {keys}, b),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS al, sum(n) OVER (PARTITION BY {keys} ORDER BY b) AS up FROM {name}_h),
{name}_q AS (SELECT {keys}, max(al) AS al, [{at("lo")}] AS q, [{at("hi")}] AS p
           FROM (SELECT *, {low("b")} AS lo, {low("(b + 1)")} - 1 AS hi FROM {name}_c) GROUP BY {keys}),
{name} AS (SELECT {keys}, al, CASE WHEN x.width > 0 THEN x ELSE y END AS m FROM (SELECT *, {pairs(10)} AS x, {pairs(18)} AS y FROM {name}_q))"""  # noqa: E731
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, d.doc_id, d.lang, d.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines,
      CAST(length(regexp_replace(d.t, '[^A-ZÀ-Þ]', '', 'g')) AS BIGINT) AS n_upper,
      CAST(length(regexp_replace(d.t, '[^!-/:-@\[-`{{-~]', '', 'g')) AS BIGINT) AS n_punct
      FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
ru AS ({rules}),
sk AS (SELECT lang, source, rule, CASE WHEN v < 32 THEN v ELSE 32 * (length(bin(v)) - 6) + v // CAST(pow(2, length(bin(v)) - 6) AS BIGINT) END AS b, count(*) AS n FROM ru GROUP BY ALL),
{level("fi", "lang, source, rule")}, {level("la", "lang, rule")}, {level("wh", "rule")},
pk AS (SELECT fi.lang, fi.source, fi.rule, CASE WHEN fi.al >= 100 THEN fi.m WHEN la.al >= 100 THEN la.m ELSE wh.m END AS m
       FROM fi JOIN la ON fi.rule = la.rule AND fi.lang IS NOT DISTINCT FROM la.lang JOIN wh ON fi.rule = wh.rule),
lim AS (SELECT lang, source, rule, m.lo - 8 * m.width AS lo, m.hi + 8 * m.width AS hi FROM pk),
bad AS (SELECT DISTINCT m.r FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source WHERE {fails})
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND bad.r IS NULL AS kept
FROM m LEFT JOIN bad ON m.r = bad.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _op2(), "op6_topk_search": OP6, "op7_warc": OP7}
