"""Quality rules whose cutoffs are chosen under a limit on false rejections.

Fixed base rules reject texts of under ``MIN_WORDS`` words, or with more than
``MAX_REPEATED`` percent of their words in 5-word windows that occur twice. The
other rules compare a share (``RULES``: numerator, denominator) with a cutoff in
percent from a fixed list, lenient to strict. For each stratum (language) and rule
the labelled documents that pass the base rules are the holdout: of its n good
documents a cutoff rejects k, and the cutoff is certified if a true false-rejection
rate of ``limit / number of rules`` would give k or fewer with a probability of at
most ``delta / (strata * rules)``, by the exact binomial distribution. The tests go
from lenient to strict and stop at the first failure (fixed sequence), so that only
the strata and rules need a Bonferroni correction. With probability 1 - delta, then,
no stratum loses more than ``limit`` of its good documents to these rules. Of the
certified cutoffs the one that rejects most bad documents is used, on ties the most
lenient; where none is certified, or none rejects a bad document, the rule is off.

Everything is DataFrame operations: a scan computes the counts of a text, sums by
stratum calibrate, and a broadcast of the cutoffs (a row a stratum; checked to be
``max_strata`` rows at most, else an ordinary join) gives the verdicts.

Windows of five words are compared by 64-bit hashes within one text.

Defined results: a very long text is judged as a whole, its words one array of its
row; a null text has no words; a null language is a stratum; labels
with a null doc_id or quality are ignored and a document with several labels is
good if one of them says so; repeated documents are judged alike, row by row; an
empty table gives no rows; without labels only the base rules hold; the labels'
further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, checkpoint

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
LIMIT, DELTA, MAX_STRATA = 0.04, 0.05, 10_000
SYMBOLS = "[#*$%&|<>]"
#: Rule: (numerator, denominator, cutoffs in percent from lenient to strict).
RULES = {
    "symbols": ("n_symbols", "word_chars", (20, 15, 10, 8, 6, 5, 4, 3, 2, 1)),
    "dup_lines": ("n_dup_lines", "n_lines", (60, 50, 40, 30, 20, 10)),
    "repeats": ("n_repeat_words", "n_words", (20, 15, 10, 5)),
    "capitals": ("n_capitals", "word_chars", (60, 50, 40, 30, 20, 10)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def windows_of(hashes: Column) -> Column:
    """Hashes of the windows, in order."""
    n = F.size(hashes) - (WINDOW - 1)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def sorted_windows(windows: Column) -> Column:
    """Windows with their places in order of hash, for texts that have fewer distinct windows than windows; else none."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_places(ordered: Column) -> Column:
    """Places, in order, of the windows that stand next to an equal one."""
    known = F.transform(ordered, lambda x, i: F.when((F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["i"]))
    return F.sort_array(F.filter(known, lambda i: i.isNotNull()))


def covered_words(places: Column) -> Column:
    """How many words stand in a window at one of these places."""
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words"))
    return F.aggregate(places, begin, lambda s, i: F.struct(i.alias("last"), (s["words"] + F.least(F.lit(WINDOW), i - s["last"])).alias("words")))["words"]


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the columns of COUNTS, all long; df must not have columns of these names or with two leading underscores."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = df.withColumns({"__words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), "__lines": lines})
    two = one.withColumns({"__hashes": F.transform("__words", lambda w: F.xxhash64(w)), "__chars": F.array_join("__words", "")})
    # each step is a column of its own, as lambdas would evaluate it once an element
    three = two.withColumn("__windows", windows_of(F.col("__hashes"))).withColumn("__ordered", sorted_windows(F.col("__windows"))).withColumn("__places", repeated_places(F.col("__ordered")))
    out = three.withColumns(
        {
            "n_words": F.size("__words"),
            "word_chars": F.length("__chars"),
            "n_symbols": F.regexp_count("__chars", F.lit(SYMBOLS)),
            "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
            "n_repeat_words": covered_words(F.col("__places")),
            "n_lines": F.size("__lines"),
            "n_capitals": F.regexp_count("__chars", F.lit("[A-Z]")),
        }
    )
    return out.select(*(out[c] for c in df.columns), *(F.col(c).cast("long").alias(c) for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def rejects(rule: str, cutoff: Column) -> Column:
    numerator, denominator, _ = RULES[rule]
    return 100 * F.col(numerator) > cutoff * F.col(denominator)


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series at x + 8."""
    z = x + 8.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    for i in range(8):
        series = series - F.ln(x + float(i))
    return series


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(at most k of n) at this rate; 1 where k is at or above the mean.

    Below the mean the terms fall from k downwards, and those more than 40 standard
    deviations away are beneath double precision.
    """
    k, n = k.cast("double"), n.cast("double")
    at_k = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * rate)) + 40).cast("int")
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    odds = (1 - rate) / rate

    def step(s: Column, i: Column) -> Column:
        return F.struct((s["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"), (s["total"] + s["term"]).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0), terms), begin, step)["total"]
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(at_k * total)


def calibrated(labelled: DataFrame, limit: float, delta: float) -> DataFrame:
    """labelled(stratum, good, counts of passing documents) to a row a stratum: its cutoff of each rule, null where that is off."""
    good = F.col("good")
    tests = [(rule, at, cutoff) for rule, (_, _, cutoffs) in RULES.items() for at, cutoff in enumerate(cutoffs)]
    sums = [F.sum(good.cast("long")).alias("n")]
    for i, (rule, _, cutoff) in enumerate(tests):
        hit = rejects(rule, F.lit(cutoff))
        sums += [F.sum((hit & good).cast("long")).alias(f"k{i}"), F.sum((hit & ~good).cast("long")).alias(f"b{i}")]
    wide = labelled.groupBy("stratum").agg(*sums).crossJoin(labelled.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata")))
    rows = wide.select("stratum", "n", "strata", F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(at).alias("at"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("bad")) for i, (r, at, c) in enumerate(tests)))))
    passed = binomial_tail(F.col("k"), F.col("n"), limit / len(RULES)) <= delta / (F.col("strata") * len(RULES))
    # within a stratum and rule: tests before the first failure, of these the most bad documents, then the most lenient
    lists = rows.withColumn("passed", passed).groupBy("stratum", "n", "rule").agg(F.min(F.when(~F.col("passed"), F.col("at"))).alias("failed"), F.sort_array(F.collect_list(F.struct("at", "cutoff", "bad"))).alias("all"))
    certified = F.filter("all", lambda x: (x["at"] < F.coalesce(F.col("failed"), F.lit(1 << 30))) & (x["bad"] > 0))
    chosen = lists.select("stratum", "n", "rule", F.array_max(F.transform(certified, lambda x: F.struct(x["bad"], -x["at"], x["cutoff"].alias("cutoff"))))["cutoff"].alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.max("n").alias("n_good"), *(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = LIMIT, delta: float = DELTA, max_strata: int = MAX_STRATA) -> DataFrame:
    """Per row: the id column, the columns of COUNTS, base_failed, the stratum's labelled good documents that pass the base rules and its cutoffs, and kept."""
    found = _verdicts(df, labels, id_col, text_col, stratum_col, limit, delta, max_strata)
    return found.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "n_good", *(f"cut_{r}" for r in RULES), "kept")


def _row_key(text: Column, stratum: Column) -> Column:
    """What tells rows of one id apart: a verdict depends on the text and the stratum alone."""
    return F.xxhash64(text.cast("string"), stratum)


def _verdicts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, limit: float, delta: float, max_strata: int) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"), _row_key(F.col(text_col), F.col(stratum_col)).alias("row_key"))
    rows = checkpoint(measured(rows).drop("text").withColumn("base_failed", base_failed()))
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") > 0).alias("good"))
    cutoffs = checkpoint(calibrated(rows.where(~F.col("base_failed")).join(good, "id"), limit, delta)).withColumnRenamed("stratum", "s")
    if cutoffs.count() <= max_strata:
        cutoffs = F.broadcast(cutoffs)
    found = rows.join(cutoffs, rows["stratum"].eqNullSafe(cutoffs["s"]), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(rejects(r, F.col(f"cut_{r}")), F.lit(False))
    return found.withColumn("kept", ~(F.col("base_failed") | rejected))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = LIMIT, delta: float = DELTA, max_strata: int = MAX_STRATA) -> DataFrame:
    """The rows that the rules keep, with their own columns; of rows with one id each is judged by its own text."""
    kept = _verdicts(df, labels, id_col, text_col, stratum_col, limit, delta, max_strata).where("kept").select(F.col("id").alias("__kept"), F.col("row_key").alias("__key"))
    return df.join(kept, df[id_col].eqNullSafe(kept["__kept"]) & (_row_key(df[text_col], df[stratum_col]) == kept["__key"]), "left_semi")
