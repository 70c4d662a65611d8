"""Queries of the training-data operators over whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, lm_score, mixing, near_dedup, packing, pii, quality, substring_dedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.train_and_score(_table(spark, sf_dir, "documents"))


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, name = quality.verdicts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col(name)
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return judged.select("doc_id", *counts, failed.alias("base_failed"), (~failed & m["passed"]).alias("kept"), F.array_join(m["broken"], ",").alias("broken"))


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("spans")


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_suffix_sums(token_counts.lengths(_table(spark, sf_dir, "documents"))).drop("all_docs", "all_tokens")


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k.name) for k in pii.BASE]
    n_all = F.size("spans").cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"),
        n_all.alias("n_spans"), (n_all > 0).alias("has_personal_data"),
    )


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "first_time").orderBy("first_time", "doc_id")


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.new_index(docs)
    found = exact_dedup.assign_in_batches(docs, index)
    index.drop()  # groups are settled
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL["op10_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

#: Words of a text, in SQL.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _left(pattern: str) -> str:
    """Number of characters of the text outside a pattern."""
    return f"length(regexp_replace(t, '{pattern}', '', 'g'))"


def _lines_like(pattern: str) -> str:
    return f"len(list_filter(lines, lambda l: regexp_matches(l, '{pattern}')))"


def _rules_sql() -> str:
    """The rules that a document breaks, joined by commas."""
    out = []
    for r in quality.RULES:
        limits = [f"{r.metric} {op} {x!r}" for op, x in (("<", r.least), (">", r.most)) if abs(x) != float("inf")]
        out.append(f"CASE WHEN n_words >= {r.from_words} AND ({' OR '.join(limits)}) THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(out)}], lambda b: b IS NOT NULL), ',')"


ORACLE_SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, {_WORDS} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT row, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS five
  FROM d WHERE len(words) >= 5),
x AS (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS n FROM w),
y AS (SELECT row, least(5, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, 5)) AS covers FROM x WHERE n > 1),
r AS (SELECT row, sum(covers) AS n FROM y GROUP BY row),
c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST({_left(r"[^#*$%&|<>]+")} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, {_left(r"[^!]+")} AS n_exclaim, {_left(r"[\p{L}\x20\x09-\x0D]+")} AS n_other, {_left(r"\P{Lu}+")} AS n_upper,
  len(list_filter(words, lambda v: list_contains({quality.STOP_WORDS!r}, v))) AS n_stop, greatest(len(lines), 1) AS n_lines,
  {_lines_like(r"^[\x20\x09-\x0D]*(?:[-*•]|\d+\.)[\x20\x09-\x0D]")} AS n_bullets, {_lines_like(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z")} AS n_ellipses
  FROM d LEFT JOIN r USING (row)),
m AS (SELECT *, greatest(n_words, 1) AS one, word_chars - n_other AS letters FROM c),
v AS (SELECT *, word_chars / one AS mean_word_chars, n_symbols / one AS symbol_ratio, n_exclaim / one AS exclaim_ratio, letters / greatest(word_chars, 1) AS letter_ratio,
  n_upper / greatest(letters, 1) AS upper_ratio, n_stop / one AS stop_ratio, n_dup_lines / n_lines AS dup_line_ratio, n_bullets / n_lines AS bullet_ratio,
  n_ellipses / n_lines AS ellipsis_ratio, n_repeat_words / one AS repeat_word_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
b AS (SELECT *, {_rules_sql()} AS broken FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM b
"""

ORACLE_SQL["op3_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, unnest(list_transform(range(1, len(words) - 11), lambda i: array_to_string(words[i:i + 12], ' '))) AS w
  FROM d WHERE len(words) >= 13),
x AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) < doc_id AS again FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x WHERE again),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
o AS (SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept FROM p LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

ORACLE_SQL["op9_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top,
  list_transform(range(4), lambda j: CAST('0x' || h[10 * j + 1:10 * j + 10] AS BIGINT)) AS parts FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((parts[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact
FROM q
"""
