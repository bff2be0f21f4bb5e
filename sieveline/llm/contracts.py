"""What SQL can say of the operators' results: balance, counts and base columns, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import disclosure, licenses, outliers, sharding
from sieveline.llm.common import table


def llm_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, slots and bytes of each shard of operator 1."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = out.groupBy("shard").agg(F.count("*").alias("rows"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("bytes").alias("all_bytes"))
    return rows.drop("bytes").join(F.broadcast(total))


def llm_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that operator 2 takes of every document, and its base rule."""
    return outliers.judge(table(spark, sf_dir, "documents")).select("doc_id", *outliers.COUNTS, "base_failed")


def llm_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that operator 4 finds in every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def llm_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data that operator 5 finds in every document, without the terms that disclose it."""
    return disclosure.digests(disclosure.find(table(spark, sf_dir, "documents"))).drop("spans")


_WORD = r"[^ \t-\r]+"
_SYMBOL = "[#*$%&|<>]"
_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) WHEN CAST(d AS INT) > 4 THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END)) % 10 = 0"
_VALID = {"email": "TRUE", "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS DOUBLE) > 255)) = 0", "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 10 AND 15"}


def _spans_sql(ord: int, kind: str) -> str:
    """Matches of a kind with their places: matches are marked, the text split at the marks, offsets summed over the parts."""
    return f"""SELECT doc_id, {ord} AS ord, '{kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT doc_id, i, CAST(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS start, split_part(part, chr(2), 1) AS m
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({_PATTERNS[kind]})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM documents))
) WHERE i > 1 AND {_VALID[kind]}"""


QUERIES = {f.__name__: f for f in (llm_shard_balance, llm_quality_counts, llm_license_phrases, llm_personal_data)}
ORACLES = {
    "llm_shard_balance": "SELECT CAST(s AS INT) AS shard, n // 8 + CAST(s < n % 8 AS INT) AS rows, n // 8 + CAST(s < n % 8 AS INT) AS slots, CAST(0 AS BIGINT) AS first_slot, n // 8 + CAST(s < n % 8 AS INT) - 1 AS last_slot, b AS all_bytes FROM (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS b FROM documents), range(8) AS r(s)",
    "llm_quality_counts": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{_SYMBOL}')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(ws) AS base_failed FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN lines l ON w.doc_id = l.doc_id""",
    "llm_license_phrases": f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LICENSE_WORD}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
hits AS (SELECT doc_id, i - 1 AS i, CASE WHEN ws[i] = 'mit' AND ws[i + 1] = 'license' THEN 'mit' WHEN ws[i] = 'apache' AND ws[i + 1] = 'license' THEN 'apache' WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl' END AS label FROM places)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, count(label) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN (SELECT * FROM hits WHERE label IS NOT NULL) h ON w.doc_id = h.doc_id GROUP BY ALL""",
    "llm_personal_data": f"""WITH spans AS ({" UNION ALL ".join(_spans_sql(i, k) for i, k in enumerate(_PATTERNS))}),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PATTERNS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS base FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256 FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""",
}
