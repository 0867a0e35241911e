"""Queries over documents, benchmark and conversations: tries, suffix arrays and resampling, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.resampling import resampled

    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_prefix_trie": op11_prefix_trie, "op13_importance_resampling": op13_importance_resampling, "op12_suffix_array_dedup": op12_suffix_array_dedup}

#: Texts as hexadecimal digits, so that a byte is two characters; stretches between the spans that go are put together again.
SUFFIX_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS i FROM texts)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING count(*) > 1
), hits AS (
  SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > first
), runs AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)
), spans AS (
  SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM runs GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS begin, high FROM spans
), judged AS (
  SELECT t.doc_id, any_value(x) AS x, sum(high - low) AS n_removed, count(low) AS n_spans, max(high) AS last,
         string_agg(substr(x, 2 * begin + 1, 2 * (low - begin)), '' ORDER BY low) AS head
  FROM texts t LEFT JOIN kept k USING (doc_id) GROUP BY t.doc_id
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM judged
"""

#: The table of CRC-32 by bytes, from its polynomial, and the checksum of a column ``s`` with it.
CRC_TABLE = "SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)), lambda c, d: xor(t[xor(c, d) % 256 + 1], c // 256)), 4294967295)"

#: A node is its list of turns; each node counts for the prefixes of its least member.
TRIE_SQL = f"""
WITH crc AS ({CRC_TABLE}), heads AS (
  SELECT s::BIGINT AS conv_id, {CRC} % 4 AS h FROM (SELECT DISTINCT conv_id::VARCHAR AS s FROM conversations), crc
), own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations GROUP BY conv_id
), whole AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS turns
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(turns) AS length, d AS depth, md5(CAST(turns[1:d] AS VARCHAR)) AS node, md5(CAST(turns[1:d - 1] AS VARCHAR)) AS parent, coalesce(turns[d].text, '') AS text
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs,
         (count(*) - 1) * any_value(CASE WHEN depth > 0 THEN len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END) AS cost,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (depth, node)
), subtrees AS (
  SELECT p.depth, p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum(cost) AS saved_tokens
  FROM counted c JOIN prefixes p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees USING (depth, node) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.parent
"""

#: Checksums are computed once for each distinct feature.
RESAMPLING_SQL = f"""
WITH crc AS ({CRC_TABLE}), both_sides AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM both_sides
), spread AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM words
), counted AS (
  SELECT side, id, s, count(*) AS c FROM spread GROUP BY ALL
), sums AS (
  SELECT s, {CRC} % 10000 AS bucket FROM (SELECT DISTINCT s FROM counted), crc
), features AS (
  SELECT side, id, bucket, sum(c) AS c FROM counted JOIN sums USING (s) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(c) FILTER (side = 'd'), 0)::DOUBLE AS big_s, coalesce(sum(c) FILTER (side = 'b'), 0)::DOUBLE AS big_t FROM features
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(c) FILTER (side = 'b'), 0)::DOUBLE + 1) * (any_value(big_s) + 10000) / ((coalesce(sum(c) FILTER (side = 'd'), 0)::DOUBLE + 1) * (any_value(big_t) + 10000))))::BIGINT AS gain
  FROM features, totals GROUP BY bucket
), weights AS (
  SELECT id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS gain FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (gain - ((gain % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight, len(w) AS n_words,
         ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h
  FROM documents LEFT JOIN weights ON id = doc_id JOIN words ON words.id = doc_id AND side = 'd'
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""

ORACLES = {"op11_prefix_trie": TRIE_SQL, "op13_importance_resampling": RESAMPLING_SQL, "op12_suffix_array_dedup": SUFFIX_SQL}
