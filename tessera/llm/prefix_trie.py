"""The trie of conversations by their turns, in succinct level-order parts.

Conversations that begin alike share nodes: a node is a distinct sequence of first
turns. Its identity is 128 bits, two running exclusive-ors of hashes of (depth, turn),
so that prefixes need no texts and a parent's identity follows from a child's.

1. Turns are numbered by one range sort over all conversations, rebuilt if asked for, and their
   prefixes scanned in two steps: within blocks of ``BLOCK`` turns and over the blocks'
   totals, so that a conversation of any length is spread.
2. A node with more than ``shard_rows`` rows below it is *upper*; there are few. Each
   child of an upper node that is none itself is the root of a shard. Shards are dealt
   by their roots; a task lays some of them end to end as a forest in level order: a
   LOUDS bitvector (a 1 for each child, then a 0, node by node), and arrays of labels and
   counts. Parents are read off the bits, and leaves and savings roll up in reverse
   level order with ``np.add.at``, level by level.
3. Upper levels are merged without a trie. A node's own share counts for its least
   member at its depth, a shard's for its root. A suffix sum along each such
   conversation's upper path, again in two steps, gives what it adds to each of its
   prefixes; sums by node give the totals, combined before the shuffle. Ids that end in an upper node are sorted by range, formatted
   in parts, and hashed part by part as a stream.

Defined results: turns are ordered by number, nulls first, then by the MD5 of role and
text; null roles and texts are empty; rows with a null conv_id are left out; repeated
turns count each; ids are 64-bit integers; other columns are ignored; an empty table
gives no rows. Very long texts are hashed where they are and never move. With a
``head`` of 0 turns conversations stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, n_words, scratch, small_batches
from tessera.operators.ranks import row_numbers

BLOCK, SHARD_ROWS, FOREST_ROWS = 1024, 200_000, 100_000
#: Ids that are formatted as one string.
ENDS = 50_000
NODE = ("p1", "p2")
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- a shard's trie


class Trie:
    """A forest in level order: ``bits`` (LOUDS, with a root above the roots), ``labels``, ``level_ends``."""

    def __init__(self, parent: np.ndarray, level: np.ndarray, labels: np.ndarray):
        """Nodes by number, with parents' numbers (-1: none) and levels (0: roots). ``order`` has the numbers in level order."""
        n = len(parent)
        place = np.empty(n, np.int64)  # in level order
        self.order = np.empty(n, np.int64)
        by_level = np.argsort(level, kind="stable")
        self.level_ends = np.cumsum(np.bincount(level, minlength=1))
        at = 0
        for end in self.level_ends.tolist():
            own = by_level[at:end]
            above = place[parent[own]] if at else np.zeros(len(own), np.int64)
            own = own[np.lexsort((labels[own], above))]
            self.order[at:end] = own
            place[own] = np.arange(at, end)
            at = end
        children = np.zeros(n + 1, np.int64)
        inner = parent >= 0
        np.add.at(children, place[parent[inner]] + 1, 1)
        children[0] = n - inner.sum()
        bits = np.ones(2 * n + 1, np.uint8)
        bits[np.cumsum(children + 1) - 1] = 0
        self.n, self.bits, self.labels = n, np.packbits(bits), labels[self.order]

    def _edges(self) -> np.ndarray:
        """Where the bit of each node's edge is."""
        return np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n + 1))

    def parents(self) -> np.ndarray:
        """In level order; -1 for roots. The zeros before a node's edge count the nodes whose children are complete."""
        return self._edges() - np.arange(self.n) - 1

    def children(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n + 1) == 0)
        return np.diff(zeros) - 1

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values in level order."""
        total, parents = own.copy(), self.parents()
        ends = [0, *self.level_ends.tolist()]
        for k in range(len(ends) - 2, 0, -1):
            level = slice(ends[k], ends[k + 1])
            np.add.at(total, parents[level], total[level])
        return total


def forest(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray | list]:
    """The nodes of complete shards. rows: conv, length, level, depth, p1, p2, words; those of one conversation have all depths of its shard."""
    conv, level, p1, p2 = rows["conv"], rows["level"], rows["p1"], rows["p2"]
    order = np.lexsort((conv, p2, p1, level))
    new = np.append(True, (p1[order][1:] != p1[order][:-1]) | (p2[order][1:] != p2[order][:-1]))
    node = np.empty(len(conv), np.int64)
    node[order] = np.cumsum(new) - 1
    first = order[new]  # a row of each node, with its least member
    count = np.diff(np.append(np.flatnonzero(new), len(conv)))
    along = np.lexsort((level, conv))
    parent = np.full(len(first), -1, np.int64)
    below = np.flatnonzero(conv[along][1:] == conv[along][:-1]) + 1
    parent[node[along[below]]] = node[along[below - 1]]
    trie = Trie(parent, level[first], p1[first])
    inner = trie.order
    children, above = trie.children(), trie.parents()
    rep = conv[first][inner]
    n = count[inner]
    ends: list[str] = [NOTHING] * len(first)
    last = np.flatnonzero(rows["depth"] == rows["length"])
    last = last[np.lexsort((conv[last], node[last]))]
    for which, members in groupby(zip(node[last].tolist(), conv[last].tolist()), key=lambda x: x[0]):
        ends[which] = hashlib.sha256(",".join(str(c) for _, c in members).encode()).hexdigest()
    return {
        "conv_id": rep,
        "depth": rows["depth"][first][inner],
        "parent_conv_id": np.where(above >= 0, rep[above], 0),
        "is_root": above < 0,
        "n_convs": n,
        "n_children": children,
        "n_leaves": trie.rolled_up((children == 0).astype(np.int64)),
        "saved_tokens": trie.rolled_up((n - 1) * rows["words"][first][inner]),
        "ends_sha256": [ends[k] for k in inner.tolist()],
        "q1": rows["q1"][first][inner],
        "q2": rows["q2"][first][inner],
    }


def shards(light: DataFrame, parts: int) -> DataFrame:
    """The nodes of all shards, with q1 and q2 (the identity of the parent) and whether they are a shard's root."""
    names = ["conv", "length", "depth", "level", "p1", "p2", "q1", "q2", "words", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def whole() -> dict[str, np.ndarray]:
            return {name: np.concatenate([h[name] for h in held]) for name in names}

        def made(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            found = forest(rows)
            found["parent_conv_id"] = pa.array(found["parent_conv_id"], mask=found["is_root"])
            return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in found.values()], names=list(found))

        for batch in batches:
            held.append({name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(names)})
            size += batch.num_rows
            if size < FOREST_ROWS:
                continue
            rows = whole()
            border = int(np.searchsorted((rows["s1"] == rows["s1"][-1]) & (rows["s2"] == rows["s2"][-1]), True))
            if border:  # the last shard may go on
                yield made({name: v[:border] for name, v in rows.items()})
            held, size = [{name: v[border:] for name, v in rows.items()}], 0 if border else size
        if held:
            rows = whole()
            if len(rows["conv"]):
                yield made(rows)

    dealt = light.select(*names).repartition(parts, "s1", "s2").sortWithinPartitions("s1", "s2")
    return dealt.mapInArrow(run, "conv_id long, depth long, parent_conv_id long, is_root boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, q1 long, q2 long")


# --- the steps over all conversations


def scanned(df: DataFrame, key: str, place: str, names: list[str], aggregate, combine, backwards: bool = False) -> DataFrame:
    """df with the columns of names replaced by what they add up to along place, up to and with rows of the same place; blocks of places first, then their totals."""
    direction = F.desc if backwards else F.asc
    blocked = df.withColumn("block", F.floor(F.col(place) / BLOCK))
    inside = Window.partitionBy(key, "block").orderBy(direction(place))
    ahead = Window.partitionBy(key).orderBy(direction("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(key, "block").agg(*(aggregate(n).alias(n) for n in names))
    earlier = totals.select(key, "block", *(aggregate(n).over(ahead).alias(f"ahead_{n}") for n in names)).where(f"ahead_{names[0]} IS NOT NULL")
    local = blocked.withColumns({n: aggregate(n).over(inside) for n in names})
    joined = local.join(earlier, [key, "block"], "left")
    return joined.withColumns({n: combine(F.col(n), F.coalesce(f"ahead_{n}", F.lit(0))) for n in names}).select(*df.columns)


def rebuilt(df: DataFrame, head: int = 3, period: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): conv and length; conv, length, depth, tie (MD5 of role and text) and words of each turn.

    Up to ``head`` first turns come from the conversation at the begin of the period; how many, the conversation's hash says.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps role and text apart
    tie = F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    turns = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", tie.alias("tie"), n_words(text).alias("words"))
    numbered = row_numbers(turns, [("conv", "asc"), ("turn", "asc"), ("tie", "asc")], "number")
    conversations = numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("own"))
    asked = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(head + 1))
    conversations = _written(conversations.withColumns({"asked": asked, "base": F.col("conv") - F.col("conv") % period}), "trie-conversations")
    given = conversations.select(F.col("conv").alias("base"), F.least("own", F.lit(head)).alias("base_own"))
    known = conversations.join(given, "base", "left").withColumn("taken", F.least("asked", F.coalesce("base_own", F.lit(0))))
    known = known.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("asked"), F.lit(0)))
    placed = numbered.join(known, "conv").withColumn("place", F.col("number") - F.col("first") + 1)
    tail = placed.where("place > asked").select("conv", "length", (F.col("taken") + F.col("place") - F.col("asked")).alias("depth"), "tie", "words")
    heads = placed.where(F.col("place") <= head).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "tie", "words")
    front = known.select("conv", "base", "length", "taken").join(heads, "base").where("depth <= taken").select("conv", "length", "depth", "tie", "words")
    return known.select("conv", "length"), tail.unionByName(front)


def with_prefixes(rows: DataFrame) -> DataFrame:
    """rows with p1, p2 (the node's identity) and q1, q2 (its parent's; 0 is the root)."""
    own = {"x1": F.xxhash64("depth", "tie"), "x2": F.xxhash64(F.lit("second"), "depth", "tie")}
    keyed = rows.select("conv", "length", "depth", "words", *(v.alias(k) for k, v in own.items()), *(v.alias(f"p{k[1]}") for k, v in own.items()))
    found = scanned(keyed, "conv", "depth", ["p1", "p2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return found.select("conv", "length", "depth", "words", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, conv to p1, p2 and the SHA-256 of the node's ids, ascending, joined by commas: formatted by ranges, hashed as a stream."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, conv = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = np.flatnonzero(np.append(True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])))
            parts = [(a, min(a + ENDS, b)) for low, b in zip(cut, np.append(cut[1:], len(conv))) for a in range(low, b, ENDS)]
            at = [a for a, _ in parts]
            yield pa.RecordBatch.from_arrays([pa.array(p1[at]), pa.array(p2[at]), pa.array(conv[at]), pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in parts], pa.string())], names=["p1", "p2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, state, key = ["p1", "p2", "ends_sha256"], None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=names)

        for batch in batches:
            for p1, p2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if key != (p1, p2):
                    if state:
                        yield told()
                    key, state = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield told()

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ends.select("p1", "p2", "conv").repartitionByRange(n, "p1", "p2", "conv").sortWithinPartitions("p1", "p2", "conv").mapInArrow(formatted, "p1 long, p2 long, first long, ids string")
    return parts.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(df: DataFrame, head: int = 3, period: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = df.sparkSession
    with small_batches(spark):
        conversations, turns = rebuilt(df, head, period)
        conversations = _written(conversations, "trie-lengths")
        rows = _written(with_prefixes(turns), "trie-rows")
        nodes = rows.groupBy("depth", *NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.max("words").alias("words"))
        nodes = _written(nodes, "trie-nodes")
        upper = nodes.where(F.col("below") > shard_rows)
        on_path = rows.join(upper.select("p1", "p2"), ["p1", "p2"])  # a conversation's upper nodes are its first ones
        depths = conversations.join(on_path.groupBy("conv").agg(F.count(F.lit(1)).alias("upper")), "conv", "left").select("conv", "length", F.coalesce("upper", F.lit(0)).alias("upper"))
        roots = rows.join(depths.select("conv", "upper"), "conv").where(F.col("depth") == F.col("upper") + 1).select("conv", "upper", F.col("p1").alias("s1"), F.col("p2").alias("s2"))
        light = rows.join(roots, "conv").where("depth > upper").withColumn("level", F.col("depth") - F.col("upper") - 1)
        found = _written(shards(light, blocks_for(rows.count(), SHARD_ROWS)), "trie-shards")

        root = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep")).where("n > 0")
        none = F.lit(None).cast("long")
        zero = F.lit(0).cast("long")
        tops = upper.select("depth", "p1", "p2", "q1", "q2", "n", "rep", "words").unionByName(root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), "n", "rep", zero.alias("words")))
        tops = _written(tops, "trie-upper")
        children = nodes.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children")).join(tops.select(*NODE), [*NODE], "left_semi")
        tops = tops.join(children, [*NODE], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        shares = tops.select(F.col("rep").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
        shares = shares.unionByName(found.where("is_root").select(F.col("conv_id").alias("conv"), "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        paths = on_path.select("conv", "depth", "p1", "p2").unionByName(conversations.select("conv", zero.alias("depth"), zero.alias("p1"), zero.alias("p2")))
        both = paths.join(shares.select("conv").distinct(), "conv", "left_semi").withColumns({"leaves": zero, "saved": zero}).unionByName(shares.withColumns({"p1": none, "p2": none}))
        sums = scanned(both, "conv", "depth", ["leaves", "saved"], F.sum, lambda a, b: a + b, backwards=True).where("p1 IS NOT NULL")
        totals = sums.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        ended = on_path.where("depth = length").select("p1", "p2", "conv").unionByName(conversations.where("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv"))
        digests = ends_digests(ended)
        parents = tops.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("parent_conv_id"))
        merged = tops.join(totals, [*NODE]).join(digests, [*NODE], "left").join(parents, ["q1", "q2"], "left")
        top_rows = merged.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
        names = top_rows.columns
        shard_roots = found.where("is_root").drop("parent_conv_id").join(parents, ["q1", "q2"])
        return _written(top_rows.unionByName(shard_roots.select(*names)).unionByName(found.where("NOT is_root").select(*names)), "trie")
