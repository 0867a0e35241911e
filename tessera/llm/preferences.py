"""Preference formatting of chosen and rejected conversations, without Python on the way.

The longest common prefix of turns (same role and text) is rendered once as the
prompt; what follows is the pair of completions. A turn is rendered as
``<|role|>\\ntext<|end|>\\n``. A completion's mask names the spans, in characters of
the completion, that are trained on: the text and end mark of assistant turns.
Headers and the turns of other roles are masked out.

Turns meet by conversation in one aggregate each (a conversation is one row of the
result, and so of one task); conversations are spread by their ids, and chosen and
rejected meet by an equi-join.

Defined results: a conversation is one array of its row, however long its texts and many
its turns; turns are ordered by number, then role, then text, nulls first, and
repeated turns count each; null roles and texts render as empty, and are the same as
each other but not as the empty string; a conversation with one side only is dropped
as it is not a pair; with equal sides both completions are empty; a null id is not a
conversation; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, name: str = "turns") -> DataFrame:
    """turns(conv_id, turn, role, text) to conv_id and the ordered array of (role, text)."""
    each = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    kept = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return kept.groupBy("conv_id").agg(each.alias("all")).select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def spans(turns: Column) -> Column:
    """Begin and end of each trained span of the rendered turns."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(header(t))
        end = start + F.length(body(t))
        own = F.when(F.coalesce(t["role"] == TRAINED, F.lit(False)), F.array(F.struct(start.alias("begin"), end.alias("end")))).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(s["spans"], own).alias("spans"))

    return F.aggregate(turns, begin, step)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """How many turns the longest common prefix has."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    other = F.array_position(same, F.lit(False))
    return F.when(other > 0, other - 1).otherwise(n).cast("int")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """conv_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    both = conversations(chosen, "a").join(conversations(rejected, "b"), "conv_id").withColumn("n_common", common_turns(F.col("a"), F.col("b")))

    def rest(turns: str) -> Column:
        return F.slice(F.col(turns), F.col("n_common") + 1, F.size(turns))

    cut = both.select("conv_id", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("head"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select("conv_id", "n_common", rendered(F.col("head")).alias("prompt"), rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"), spans(F.col("a")).alias("chosen_spans"), spans(F.col("b")).alias("rejected_spans"))


def worse(turns: DataFrame) -> DataFrame:
    """A stand-in for rejected conversations where a table has none: the last assistant turn says what the assistant said before (nothing, if that was its first turn), and later turns are gone."""
    said = turns.where(F.col("conv_id").isNotNull() & (F.col("role") == TRAINED)).groupBy("conv_id").agg(F.max("turn").alias("last"))
    before = turns.where(F.col("role") == TRAINED).join(said, "conv_id").where("turn < last").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("earlier"))
    kept = turns.join(said, "conv_id").where("turn <= last").join(before, "conv_id", "left")
    again = (F.col("turn") == F.col("last")) & (F.col("role") == TRAINED)
    return kept.select("conv_id", "turn", "role", F.when(again, F.coalesce("earlier", F.lit(""))).otherwise(F.col("text")).alias("text"))
