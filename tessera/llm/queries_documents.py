"""Queries over documents: thin forms of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import similarity_join

    members, _ = similarity_join(table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "class_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import judged

    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_good", "cut_symbols", "cut_dup_lines", "cut_repeats", "cut_capitals", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_codec import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixture import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_toxicity": op2_toxicity, "op3_exact_dedup": op3_exact_dedup, "op4_quality_rules": op4_quality_rules, "op5_sentencepiece": op5_sentencepiece, "op10_mixture": op10_mixture}

#: A binomial tail is summed from gamma functions, and the tests of a rule stop at the first failure, as in the operator.
QUALITY_SQL = r"""
WITH base AS (
  SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT *, list_transform(range(1, greatest(len(words) - 4, 0) + 1), lambda i: array_to_string(words[i:i + 4], ' ')) AS w FROM base
), spread AS (
  SELECT doc_id, unnest(w) AS win, unnest(range(1, len(w) + 1)) AS i FROM windows
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM spread) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, b.lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(array_to_string(words, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, len(regexp_extract_all(array_to_string(words, ''), '[A-Z]'))::BIGINT AS n_capitals
  FROM base b LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
), cutoffs AS (
  SELECT 'symbols' AS rule, unnest([20, 15, 10, 8, 6, 5, 4, 3, 2, 1]) AS cutoff, unnest(range(10)) AS pos
  UNION ALL SELECT 'dup_lines', unnest([60, 50, 40, 30, 20, 10]), unnest(range(6))
  UNION ALL SELECT 'repeats', unnest([20, 15, 10, 5]), unnest(range(4))
  UNION ALL SELECT 'capitals', unnest([60, 50, 40, 30, 20, 10]), unnest(range(6))
), shares AS (
  SELECT doc_id, lang, 'symbols' AS rule, n_symbols AS num, word_chars AS den FROM judged WHERE NOT base_failed
  UNION ALL SELECT doc_id, lang, 'dup_lines', n_dup_lines, n_lines FROM judged WHERE NOT base_failed
  UNION ALL SELECT doc_id, lang, 'repeats', n_repeat_words, n_words FROM judged WHERE NOT base_failed
  UNION ALL SELECT doc_id, lang, 'capitals', n_capitals, word_chars FROM judged WHERE NOT base_failed
), good AS (
  SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), trials AS (
  SELECT lang, rule, pos, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND 100 * num > cutoff * den) AS k, count(*) FILTER (NOT good AND 100 * num > cutoff * den) AS bad
  FROM shares JOIN good USING (doc_id) JOIN cutoffs USING (rule) GROUP BY ALL
), tested AS (
  SELECT *, k < n * 0.01 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) <= 0.05 / (4 * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM trials)) AS passed
  FROM trials
), stops AS (
  SELECT lang, rule, coalesce(min(pos) FILTER (NOT passed), 1000) AS failed FROM tested GROUP BY ALL
), chosen AS (
  SELECT t.lang, t.rule, arg_max(t.cutoff, t.bad * 1000 - t.pos) AS cutoff
  FROM tested t JOIN stops s ON t.rule = s.rule AND t.lang IS NOT DISTINCT FROM s.lang WHERE t.pos < s.failed AND t.bad > 0 GROUP BY ALL
), rejected AS (
  SELECT DISTINCT x.doc_id FROM shares x JOIN chosen c ON x.rule = c.rule AND x.lang IS NOT DISTINCT FROM c.lang WHERE 100 * num > cutoff * den
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_good,
       cut_symbols, cut_dup_lines, cut_repeats, cut_capitals, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged j
LEFT JOIN (
  SELECT lang, count(*) FILTER (good) AS n_good FROM judged JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang
) s ON j.lang IS NOT DISTINCT FROM s.lang
LEFT JOIN (
  SELECT lang, max(cutoff) FILTER (rule = 'symbols') AS cut_symbols, max(cutoff) FILTER (rule = 'dup_lines') AS cut_dup_lines,
         max(cutoff) FILTER (rule = 'repeats') AS cut_repeats, max(cutoff) FILTER (rule = 'capitals') AS cut_capitals
  FROM chosen GROUP BY lang
) c ON j.lang IS NOT DISTINCT FROM c.lang
"""

#: Classes of equal sets, all pairs of classes that share a shingle, and what each reaches by links.
NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT class_id, n, unnest(s) AS t FROM classes
), links AS (
  SELECT a.class_id AS a, b.class_id AS b FROM shingles a JOIN shingles b ON a.t = b.t AND a.class_id < b.class_id
  GROUP BY a.class_id, a.n, b.class_id, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT class_id AS id, class_id AS root FROM classes
  UNION
  SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.id
), roots AS (
  SELECT id, min(root) AS root FROM reached GROUP BY id
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, c.class_id
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN roots r ON r.id = c.class_id
"""

ORACLES = {
    "op1_ngram_join": NGRAM_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op3_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
