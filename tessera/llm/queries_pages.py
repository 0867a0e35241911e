"""Queries over pages and conversations: thin forms of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, table


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no labels of their own: the labels of the document with the page's number stand in for them (bad: quality 0)."""
    from tessera.llm.url_reputation import judged

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judged(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_rate_bound", 6).alias("bad_rate_bound"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import read, write

    folder = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extract import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no rejected conversations: ``worse`` makes one of each conversation in which the assistant speaks."""
    from tessera.llm.preferences import preference_pairs, worse

    turns = table(spark, sf_dir, "conversations")
    pairs = preference_pairs(turns, worse(turns))
    trained = {side: F.aggregate(f"{side}_spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"]).cast("long").alias(f"{side}_trained_chars") for side in ("chosen", "rejected")}
    return pairs.select(
        "conv_id",
        F.col("n_common").cast("long").alias("n_common"),
        F.char_length("prompt").cast("long").alias("prompt_chars"),
        F.sha2(F.encode("prompt", "UTF-8"), 256).alias("prompt_sha256"),
        F.sha2(F.encode("chosen", "UTF-8"), 256).alias("chosen_sha256"),
        F.sha2(F.encode("rejected", "UTF-8"), 256).alias("rejected_sha256"),
        *trained.values(),
    )


QUERIES = {"op6_url_filters": op6_url_filters, "op7_warc": op7_warc, "op8_html_extraction": op8_html_extraction, "op9_preferences": op9_preferences}

ORACLES = {
    "op6_url_filters": r"""
WITH seen AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), labelled AS (
  SELECT s.host, string_split(s.host, '.')[-1] AS suffix, array_to_string(string_split(s.host, '.')[-2:], '.') AS domain, 1 - l.quality AS bad
  FROM seen s LEFT JOIN labels l ON l.doc_id = s.page_id
), hosts AS (
  SELECT host, suffix, domain, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM labelled GROUP BY ALL
), root AS (
  SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS parent FROM hosts
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(parent) AS parent FROM hosts, root GROUP BY suffix
), s1 AS (
  SELECT 1 / greatest(least(coalesce(avg(((bad - n * parent) ** 2 / (parent * (1 - parent)) - n) / (n * (n - 1))), 0.1), 0.9), 0.001) - 1 AS prior FROM s0 WHERE n > 1
), s2 AS (
  SELECT suffix, (bad + prior * parent) / (n + prior) AS mean FROM s0, s1
), d0 AS (
  SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS parent FROM hosts JOIN s2 USING (suffix) GROUP BY suffix, domain
), d1 AS (
  SELECT 1 / greatest(least(coalesce(avg(((bad - n * parent) ** 2 / (parent * (1 - parent)) - n) / (n * (n - 1))), 0.1), 0.9), 0.001) - 1 AS prior FROM d0 WHERE n > 1
), d2 AS (
  SELECT domain, (bad + prior * parent) / (n + prior) AS mean FROM d0, d1
), h0 AS (
  SELECT host, n, bad, mean AS parent FROM hosts JOIN d2 USING (domain)
), h1 AS (
  SELECT 1 / greatest(least(coalesce(avg(((bad - n * parent) ** 2 / (parent * (1 - parent)) - n) / (n * (n - 1))), 0.1), 0.9), 0.001) - 1 AS prior FROM h0 WHERE n > 1
), h2 AS (
  SELECT host, (bad + prior * parent) / (n + prior) AS mean, n + prior AS weight FROM h0, h1
), ruled AS (
  SELECT s.*, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS bound,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM seen s JOIN h2 USING (host)
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict,
       round(mean, 6) AS bad_rate, round(bound, 6) AS bad_rate_bound
FROM ruled
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS last FROM p
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM g
""",
    "op9_preferences": """
WITH said AS (
  SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), earlier AS (
  SELECT c.conv_id, arg_max(c.text, c.turn) AS earlier FROM conversations c JOIN said s ON c.conv_id = s.conv_id AND c.turn < s.last WHERE role = 'assistant' GROUP BY c.conv_id
), both_sides AS (
  SELECT c.conv_id, c.turn, c.role, c.text AS a, c.turn <= s.last AS kept,
         CASE WHEN c.turn = s.last AND c.role = 'assistant' THEN coalesce(e.earlier, '') ELSE c.text END AS b, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) AS i
  FROM conversations c JOIN said s USING (conv_id) LEFT JOIN earlier e USING (conv_id)
), cut AS (
  SELECT *, coalesce(min(CASE WHEN NOT kept OR a <> b THEN i END) OVER (PARTITION BY conv_id), 1000000) AS first FROM both_sides
), parts AS (
  SELECT *, '<|' || role || '|>' || chr(10) || a || '<|end|>' || chr(10) AS ra, '<|' || role || '|>' || chr(10) || b || '<|end|>' || chr(10) AS rb FROM cut
)
SELECT conv_id, count(*) FILTER (i < first) AS n_common,
       coalesce(length(string_agg(ra, '' ORDER BY i) FILTER (i < first)), 0) AS prompt_chars,
       sha256(coalesce(string_agg(ra, '' ORDER BY i) FILTER (i < first), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(ra, '' ORDER BY i) FILTER (i >= first), '')) AS chosen_sha256,
       sha256(coalesce(string_agg(rb, '' ORDER BY i) FILTER (i >= first AND kept), '')) AS rejected_sha256,
       coalesce(sum(length(a) + 8) FILTER (i >= first AND role = 'assistant'), 0)::BIGINT AS chosen_trained_chars,
       coalesce(sum(length(b) + 8) FILTER (i >= first AND kept AND role = 'assistant'), 0)::BIGINT AS rejected_trained_chars
FROM parts GROUP BY conv_id
""",
}
