"""Scalar functions over strings, times, numbers, JSON, arrays, maps and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(name).alias("up"), F.length(name).cast("long").alias("chars"), F.substring(name, 2, 3).alias("middle"), F.concat_ws("-", "p_brand", "p_type").alias("joined"), F.lpad("p_brand", 12, "*").alias("padded"), F.reverse(name).alias("backward"), F.regexp_replace(name, "[aeiou]", "_").alias("consonants"), F.levenshtein(name, F.col("p_type")).cast("long").alias("distance"), F.md5(name).alias("digest"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("year"), F.quarter(d).cast("long").alias("quarter"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_format(d, "yyyy-MM-dd").alias("text"), F.add_months(d, 2).alias("later"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x, 1).alias("rounded"), F.floor(x).alias("floor"), F.ceil(x).alias("ceil"), F.round(F.ln(x), 6).alias("ln"), F.round(F.sqrt(x), 6).alias("root"), F.try_divide(x, F.col("p_size") % 2).isNull().alias("by_zero"), F.greatest("p_size", F.lit(25)).alias("most"), F.width_bucket(x, F.lit(0.0), F.lit(3000.0), F.lit(10).cast("long")).alias("cell"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json("props", "k long")["k"].alias("parsed"), F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("variant"), F.size(F.json_object_keys("props")).cast("long").alias("keys"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.round(F.array_max(e), 5).alias("most"), F.exists(e, lambda x: x > 0.3).alias("any_large"), F.round(F.element_at(F.sort_array(e), 1), 5).alias("least"))


def explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(F.lit("size"), F.col("p_size"), F.lit("key"), (F.col("p_partkey") % 7).cast("int"))
    kept = F.map_filter(F.transform_values(pairs, lambda k, v: v + 1), lambda k, v: v > 3)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("names"), F.coalesce(kept["size"], F.lit(-1)).alias("size"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("url_host"), F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"))


def text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+").alias("has_mail"), F.regexp_count(text, F.lit("[0-9]+")).cast("long").alias("numbers"), F.contains(F.lower(text), F.lit("license")).alias("has_license"), F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long").alias("words"))


def more_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.instr(name, "e").cast("long").alias("at"), F.overlay(name, F.lit("##"), F.lit(2), F.lit(2)).alias("laid"), F.translate(name, "aeiou", "AEIOU").alias("vowels"), F.array_join(F.regexp_extract_all(name, F.lit("[aeiou][a-z]"), F.lit(0)), ",").alias("all_pairs"), F.bround(F.col("p_retailprice") / 100, 1).alias("even"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("md5"), F.sha1(text).alias("sha1"), F.sha2(text, 256).alias("sha256"))


MAIL, NUMBERS = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "[0-9]{3,}"


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without mail addresses and long numbers, as digests."""
    clean = F.regexp_replace(F.regexp_replace("text", MAIL, "<mail>"), NUMBERS, "<number>")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(clean, "UTF-8"), 256).alias("clean_sha256"), F.regexp_count("text", F.lit(MAIL)).cast("long").alias("mails"))


def language_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language, the shares of documents that are toxic, of good quality, or have an address, of those labelled or of all."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike(MAIL).alias("mail")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("quality"), 6).alias("good"), F.round(F.avg(F.col("mail").cast("int")), 6).alias("mail"))


QUERIES = {
    "more_strings": more_strings,
    "hashes": hashes,
    "redaction": redaction,
    "language_rates": language_rates,
    "string_functions": strings,
    "time_functions": times,
    "number_functions": numbers,
    "json_functions": json_fields,
    "array_functions": arrays,
    "explode": explode,
    "map_functions": maps,
    "url_functions": url_parts,
    "text_patterns": text_patterns,
}

ORACLES = {
    "more_strings": "SELECT p_partkey, instr(p_name, 'e') AS at, substring(p_name, 1, 1) || '##' || substring(p_name, 4) AS laid, translate(p_name, 'aeiou', 'AEIOU') AS vowels, array_to_string(regexp_extract_all(p_name, '[aeiou][a-z]'), ',') AS all_pairs, round_even(p_retailprice / 100, 1) AS even FROM part",
    "hashes": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
    "redaction": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+', '<mail>', 'g'), '[0-9]{3,}', '<number>', 'g')) AS clean_sha256, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+'))::BIGINT AS mails FROM documents",
    "language_rates": r"SELECT lang, count(*) AS documents, round(avg(toxic), 6) AS toxic, round(avg(quality), 6) AS good, round(avg(regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+')::INT), 6) AS mail FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "string_functions": "SELECT p_partkey, upper(p_name) AS up, length(p_name) AS chars, substring(p_name, 2, 3) AS middle, concat_ws('-', p_brand, p_type) AS joined, lpad(p_brand, 12, '*') AS padded, reverse(p_name) AS backward, regexp_replace(p_name, '[aeiou]', '_', 'g') AS consonants, levenshtein(p_name, p_type) AS distance, md5(p_name) AS digest FROM part",
    "time_functions": "SELECT o_orderkey, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, date_trunc('month', o_orderdate)::TIMESTAMP AS month, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate, '%Y-%m-%d') AS text, (o_orderdate + INTERVAL 2 MONTH)::DATE AS later FROM orders",
    "number_functions": "SELECT p_partkey, round(p_retailprice, 1) AS rounded, floor(p_retailprice)::BIGINT AS floor, ceil(p_retailprice)::BIGINT AS ceil, round(ln(p_retailprice), 6) AS ln, round(sqrt(p_retailprice), 6) AS root, p_size % 2 = 0 AS by_zero, greatest(p_size, 25) AS most, (floor(p_retailprice / 300.0) + 1)::BIGINT AS cell FROM part",
    "json_functions": "SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT AS parsed, (props->>'$.k')::BIGINT AS variant, len(json_keys(props))::BIGINT AS keys FROM events",
    "array_functions": "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_max(embedding)::DOUBLE, 5) AS most, len(list_filter(embedding, lambda x: x::DOUBLE > 0.3)) > 0 AS any_large, round(list_min(embedding)::DOUBLE, 5) AS least FROM embeddings",
    "explode": "SELECT label, i - 1 AS i, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL",
    "map_functions": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 7 + 1 > 3 THEN 'key' END, CASE WHEN p_size + 1 > 3 THEN 'size' END) AS names, CASE WHEN p_size + 1 > 3 THEN p_size + 1 ELSE -1 END AS size FROM part",
    "url_functions": "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS url_host, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages",
    "text_patterns": r"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+') AS has_mail, len(regexp_extract_all(text, '[0-9]+')) AS numbers, contains(lower(text), 'license') AS has_license, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words FROM documents",
}
