"""A corpus pipeline in five stages, each of which works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

1. quality_rules: documents that the base rules or the certified cutoffs reject go.
2. exact_dedup: of equal texts the one with the largest doc_id stays.
3. ngram_join: of documents that are linked by near copies the least doc_id stays.
4. mixture: what the mix takes, to the word: a row for each stretch of a document that
   an epoch takes without a gap, with the stretch as its text and its length as n_chars. A document that
   is taken whole stays as it is, and one that is taken twice is there twice.
5. sentencepiece: token counts and digests of what is left.

Defined results: an empty table passes through all stages as an empty one; nulls,
ties, very long texts and repeated rows are treated as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, table
from tessera.llm.exact_dedup import keep_exact
from tessera.llm.mixture import mixed_pieces
from tessera.llm.ngram_join import keep_one
from tessera.llm.quality_rules import keep_good
from tessera.llm.queries_documents import tokenizer_path
from tessera.llm.sentencepiece_codec import digests, encode_decode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_exact(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = mixed_pieces(docs)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return pieces.select(*(length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(encode_decode(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixture", mixture),
    ("sentencepiece", sentencepiece),
]

#: Stages 4 and 5 hash and segment in ways that SQL cannot express; a test runs a brute-force version of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
