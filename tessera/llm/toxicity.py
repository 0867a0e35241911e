"""Toxicity by a convolutional text classifier that is trained here, in numpy.

Words (A-Z lower-cased; white space and ASCII punctuation part them), and their
first four and six bytes, are hashed to rows of an embedding table, and a word's
vector is the sum of the three, so that unseen forms of a known stem are near it.
Filters over windows of one, two and three words are max-pooled over the whole text
and a logistic unit joins them. Embeddings begin as small noise from a seed. The
gradient of max pooling touches a few windows of a text only, so that the rows that
training changed are few, and these alone are sent to the executors.

Labels are learnt from rows whose crc32 of the id, as text, leaves a remainder
other than 0 by 5: those of remainder 1 calibrate, the others fit. Calibration is
one line for all texts (Platt's), which makes the score a probability, and a
threshold for each language where F1 is best; the language never enters the score,
and the thresholds give ``flagged`` beside ``predicted``.

Every labelled row outside the held-out fold is learnt from, as a whole text. Texts that fit are dealt to blocks
of some ``max_words`` words (larger ones if these were more than ``MOST_BLOCKS``), by hash of their ids. In each of ``EPOCHS`` rounds each block goes on from the common
model over its own texts in small steps, in a task; what the blocks changed is averaged (a row of the table over the blocks that
touched it) as sums of integers, so that their order plays no role, and makes the next model. One block is plain training. Calibration
and thresholds see all of fold 1, as numbers of labels by language and logit (in steps of 1 / ``STEP``). What goes to the driver and back is
the model, of a bounded size, and these numbers.
Of the texts, only those whose ids a bitmap of the labelled ones lets through move, to their labels and then to the tasks of their blocks, where
words are hashed; the hashes are kept compressed. Each round's shuffle goes before the next one.
Every text is scored as a whole, in one scan, without a shuffle.

Defined results: null and empty texts score what a text without words scores;
a document with several labels is toxic if one says so, and of several texts of one
id the one of least digest is learnt from; labels that are null or of
unknown documents are ignored; a null id is not held out; without labels of both kinds every
score is the share of toxic labels (0.0 without any); repeated rows are scored
alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, drop_shuffles
from tessera.llm.ngram_join import through_bitmap
from tessera.llm.shingles import SPACE, each_text

ROW_BITS, WIDTH, FILTERS, WIDEST = 19, 8, 8, 3
FOLDS = 5
PREFIXES = (4, 6)
#: Where the rows of a word and of its prefixes lie in 64 bits.
PLACES = ROW_BITS * np.arange(1 + len(PREFIXES))
#: Passes over the texts; texts of a step; texts that a task holds at once; a logit's steps; the integers that a change is summed in.
EPOCHS, BATCH, HELD, STEP, UNIT = 12, 32, 256, 256, 1 << 32
#: Blocks of texts; with more texts, blocks are larger, and a task holds no more of one at once.
MOST_BLOCKS = 48
#: Bits of the map of labelled ids: 4 MB.
LABELLED_BITS = 1 << 25
#: Bytes of a word, roughly.
WORD_BYTES = 6
SEPARATORS = SPACE.copy()
SEPARATORS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def rows_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ROW_BITS)).astype(np.int32)


@dataclass
class Network:
    """The classifier. Filters of width w see the first w of three words in a row; a text's end is padded with zeros."""

    seed: int = 11
    table: np.ndarray = field(init=False)
    filters: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)
    out: np.ndarray = field(init=False)
    out_bias: float = field(init=False, default=-2.0)
    slope: float = field(init=False, default=1.0)
    shift: float = field(init=False, default=0.0)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.changed = np.zeros((1 << ROW_BITS) + 1, bool)
        self.table = rng.normal(0, 0.1, ((1 << ROW_BITS) + 1, WIDTH)).astype(np.float32)
        self.table[-1] = 0
        shape = (WIDEST, WIDTH, WIDEST * FILTERS)
        self.filters = rng.normal(0, 0.5, shape).astype(np.float32)
        self.mask = np.zeros(shape, np.float32)
        for w in range(WIDEST):
            self.mask[: w + 1, :, w * FILTERS : (w + 1) * FILTERS] = 1
        self.filters *= self.mask
        self.bias = np.full(WIDEST * FILTERS, 0.1, np.float32)
        self.out = np.abs(rng.normal(0, 0.5, WIDEST * FILTERS)).astype(np.float32)

    def padded(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of all words, where each text, without words too, is followed by three rows of zeros; where each text begins; and whether a window of three that begins there lies within one text and its first row of zeros."""
        ends = np.cumsum(lengths + WIDEST)
        begins = ends - (lengths + WIDEST)
        total = int(ends[-1])
        padded = np.full((total + WIDEST - 1, 1 + len(PREFIXES)), 1 << ROW_BITS, np.int32)
        padded[np.arange(len(rows)) + np.repeat(WIDEST * np.arange(len(lengths)), lengths)] = rows
        own = np.ones(total, bool)
        for i in range(1, WIDEST):
            own[ends - i] = False
        return padded, begins, own

    def responses(self, padded: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of each filter to the windows of three; those that reach into another text give nothing."""
        vectors = self.table[padded[:, 0]]
        for i in range(len(PREFIXES)):
            vectors += self.table[padded[:, i + 1]]
        n = len(own)
        found = np.concatenate([vectors[i : i + n] for i in range(WIDEST)], 1) @ self.filters.reshape(-1, WIDEST * FILTERS) + self.bias
        found[~own] = -np.inf
        return found

    def logits(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        padded, begins, own = self.padded(rows, lengths)
        most = np.full((len(lengths), WIDEST * FILTERS), -np.inf, np.float32)
        step, n = 1 << 16, len(own)  # bounds the memory of a text of any length
        for at in range(0, n, step):
            part = self.responses(padded[at : min(at + step, n) + WIDEST - 1], own[at : at + step])
            first = int(np.searchsorted(begins, at, "right")) - 1
            last = int(np.searchsorted(begins, at + len(part), "left"))
            cuts = np.maximum(begins[first:last] - at, 0)
            most[first:last] = np.maximum(most[first:last], np.maximum.reduceat(part, cuts))
        return np.maximum(most, 0) @ self.out + self.out_bias

    def scores(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(rows, lengths).astype(np.float64) + self.shift, -40, 40)))

    def begin(self) -> None:
        """Sums of squared gradients, by which steps shrink."""
        self.seen = np.full(len(self.table), 1e-6, np.float32)
        self.sums = {n: np.full_like(getattr(self, n), 1e-6) for n in ("filters", "bias", "out")}
        self.bias_sum = 1e-6

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.05) -> None:
        rng = np.random.default_rng(self.seed + 1)
        self.begin()
        for _ in range(epochs):
            self.learn(texts, labels, rng.permutation(len(texts)), batch, rate)

    def winners(self, padded: np.ndarray, begins: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and filter, the window that responds most (the first of equals), and how much; a part at a time."""
        shape = (len(begins), WIDEST * FILTERS)
        where, most = np.zeros(shape, np.int64), np.full(shape, -np.inf, np.float32)
        step, n = 1 << 16, len(own)
        for at in range(0, n, step):
            part = self.responses(padded[at : min(at + step, n) + WIDEST - 1], own[at : at + step])
            first = int(np.searchsorted(begins, at, "right")) - 1
            last = int(np.searchsorted(begins, at + len(part), "left"))
            cuts = np.append(np.maximum(begins[first:last] - at, 0), len(part))
            for text, a, b in zip(range(first, last), cuts, cuts[1:]):
                best = part[a:b].argmax(0)
                value = part[a + best, np.arange(shape[1])]
                better = value > most[text]
                where[text, better], most[text, better] = (at + a + best)[better], value[better]
        return where, most

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray, batch: int = BATCH, rate: float = 0.05) -> None:
        """One pass, in steps of so many texts."""
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            lengths = np.array([len(texts[i]) for i in chosen])
            padded, begins, own = self.padded(np.concatenate([texts[i] for i in chosen]), lengths)
            where, most = self.winners(padded, begins, own)
            pooled = np.maximum(most, 0)
            error = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30))) - labels[chosen]
            error = (error / len(chosen)).astype(np.float32)
            back = error[:, None] * self.out * (pooled > 0)
            places = padded[where[..., None] + np.arange(WIDEST)]  # text, filter, offset, part of the word
            inputs = self.table[places].sum(3)  # text, filter, offset, width
            grad = {"filters": np.einsum("tf,tfow->owf", back, inputs) * self.mask + 1e-5 * self.filters, "bias": back.sum(0), "out": pooled.T @ error}
            to_table = np.repeat(np.einsum("tf,owf->tfow", back, self.filters).reshape(-1, WIDTH), 1 + len(PREFIXES), 0)
            used, inverse = np.unique(places.reshape(-1), return_inverse=True)
            of_table = np.zeros((len(used), WIDTH), np.float32)
            np.add.at(of_table, inverse, to_table)
            self.seen[used] += (of_table**2).mean(1)
            self.table[used] -= rate * of_table / np.sqrt(self.seen[used])[:, None]
            self.table[-1] = 0
            self.changed[used] = True
            for name, g in grad.items():
                self.sums[name] += g**2
                setattr(self, name, getattr(self, name) - rate * g / np.sqrt(self.sums[name]))
            self.bias_sum += float(error.sum()) ** 2
            self.out_bias -= rate * float(error.sum()) / self.bias_sum**0.5

    def small(self) -> np.ndarray:
        """All but the table, and the sums of squares, as rows as wide as the table's."""
        flat = np.concatenate([*(getattr(self, n).ravel() for n in self.sums), *(v.ravel() for v in self.sums.values()), [self.out_bias, self.bias_sum]])
        return np.append(flat, np.zeros(-len(flat) % WIDTH)).reshape(-1, WIDTH)

    def set_small(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel(), 0
        for target in (self.__dict__, self.sums):
            for name in self.sums:
                old = target[name]
                target[name] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
                at += old.size
        self.out_bias, self.bias_sum = float(flat[at]), float(flat[at + 1])

    def state(self) -> dict:
        used = np.flatnonzero(self.changed).astype(np.int32)
        return {"seed": self.seed, "used": used, "values": self.table[used], "seen": self.seen[used], "small": self.small()}

    @classmethod
    def resumed(cls, state: dict) -> Network:
        net = cls(state["seed"])
        net.begin()
        used = state["used"]
        net.table[used], net.seen[used], net.changed[used] = state["values"], state["seen"], True
        net.set_small(state["small"])
        return net

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> None:
        """Platt's line, by Newton steps, towards his smoothed targets; each label so many times."""
        times = np.ones(len(labels)) if times is None else times.astype(np.float64)
        pos, neg = (labels * times).sum(), ((1 - labels) * times).sum()
        target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        design = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)
        line = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
            hessian = design.T @ (design * (times * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hessian, design.T @ (times * (p - target)) + 1e-6 * (line - [1.0, 0.0]))
            line -= step / max(1.0, np.abs(step).max())
        if line[0] > 0:
            self.slope, self.shift = map(float, line)

    def packed(self) -> dict:
        used = np.flatnonzero(self.changed).astype(np.int32)
        return {"seed": self.seed, "used": used, "values": self.table[used], "filters": self.filters, "bias": self.bias, "out": self.out, "line": (self.out_bias, self.slope, self.shift)}

    @classmethod
    def unpacked(cls, parts: dict) -> Network:
        net = cls(parts["seed"])
        net.table[parts["used"]] = parts["values"]
        net.filters, net.bias, net.out = parts["filters"], parts["bias"], parts["out"]
        net.out_bias, net.slope, net.shift = parts["line"]
        return net


def best_threshold(scores: np.ndarray, labels: np.ndarray, least: int = 20, times: np.ndarray | None = None) -> float:
    """Where F1 is best, midway between neighbouring scores; 0.5 with fewer than ``least`` labels of either kind. Each label counts so many times."""
    times = np.ones(len(labels)) if times is None else times
    toxic = labels * times
    if min(toxic.sum(), times.sum() - toxic.sum()) < least:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(times[order]) + toxic.sum())
    last = np.append(scores[order][1:] < scores[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = scores[order][at + 1] if at + 1 < len(order) else 0.0
    return float((scores[order][at] + below) / 2)


@dataclass
class Model:
    parts: dict | None
    share: float
    thresholds: dict


def fold(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % FOLDS


def _tokens(df: DataFrame, more: str, schema: str) -> DataFrame:
    """Each row's text (the last column) as its words' table rows, a word in 64 bits, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_packed((rows_of(h).astype(np.int64) << PLACES).sum(1)) for hashes, counts in each_text(batch.column(batch.num_columns - 1), SEPARATORS, PREFIXES) for h in np.split(hashes, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.binary())], names=[*more.split(), "words"])

    return df.mapInArrow(run, f"{schema}, words binary")


def _packed(words: np.ndarray) -> bytes:
    """Their number and, compressed, the words."""
    return len(words).to_bytes(8, "little") + pa.compress(words.tobytes(), "zstd", asbytes=True)


def _unpacked(words) -> np.ndarray:
    """The words' table rows again."""
    packed = words.as_py()
    plain = pa.decompress(packed[8:], 8 * int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    return ((np.frombuffer(plain, np.int64)[:, None] >> PLACES) & ((1 << ROW_BITS) - 1)).astype(np.int32)


def _round(rows: DataFrame, net: Network, number: int) -> None:
    """Every block goes on from net over its texts; net becomes the average of what they make of it."""
    shared = rows.sparkSession.sparkContext.broadcast(net.state())
    names = [f"d{i}" for i in range(WIDTH + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def changes():
            used = np.flatnonzero(own.changed)
            table = np.concatenate([own.table[used].astype(np.float64) - start.table[used], (own.seen[used].astype(np.float64) - start.seen[used])[:, None]], 1)
            small = own.small() - start.small()
            touched = np.append((table != 0).any(1), np.ones(len(small), bool))
            values = np.rint(np.concatenate([table, np.append(small, np.zeros((len(small), 1)), 1)]) * UNIT).astype(np.int64)[touched]
            at = np.append(used, -1 - np.arange(len(small)))[touched]
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in values.T)], names=["at", *names])

        def learn():
            if texts:
                own.learn(texts, np.array(labels, np.float32), rng.permutation(len(texts)))
                texts.clear(), labels.clear()

        start = own = block = last = None
        texts, labels = [], []
        for batch in batches:  # in order of blocks
            for its, id_, toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if id_ == last:  # the same row again
                    continue
                last = id_
                if its != block:
                    if block is not None:
                        learn()
                        yield changes()
                    start = start or Network.resumed(shared.value)
                    block, own, rng = its, Network.resumed(shared.value), np.random.default_rng([start.seed, number])
                texts.append(_unpacked(words))
                labels.append(toxic > 0)
                if len(texts) == HELD:
                    learn()
        if block is not None:
            learn()
            yield changes()

    changed = rows.mapInArrow(run, "at int, " + ", ".join(f"{n} long" for n in names))
    found = changed.groupBy("at").agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names)).toArrow()  # a row for each of the model's, at most
    shared.unpersist()
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    mean = np.stack([found[c].to_numpy() for c in names], 1) / n[:, None] / UNIT
    table, small = at >= 0, net.small()
    used = at[table]
    net.table[used] = net.table[used] + mean[table, :WIDTH]
    net.seen[used] = net.seen[used] + mean[table, WIDTH]
    net.changed[used] = True
    net.table[-1] = 0
    small[-1 - at[~table]] += mean[~table, :WIDTH]
    net.set_small(small)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_words: int = 5_000_000, seed: int = 11) -> Model:
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("id"))).where("fold <> 0")
    texts = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.where(fold(F.col("id")) != 0).withColumn("digest", F.xxhash64("text"))
    # of an id's texts the one of least digest; texts do not move for that
    size = F.octet_length("text").cast("long").alias("size")
    chosen = texts.select("id", "lang", "digest", size).join(known, "id").groupBy("id", "toxic", "fold").agg(F.min(F.struct("digest", "lang", "size")).alias("one"))
    chosen = checkpoint(chosen.select("id", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"), "one.*"))
    toxic, learnt = F.col("toxic") > 0, F.col("fold") != 1
    n, share, low, high, fits, total = chosen.agg(F.count(F.lit(1)), F.avg(toxic.cast("double")), F.min(toxic), F.max(toxic), F.count_if(learnt), F.sum(F.when(learnt, F.col("size")))).first()
    if not n or low == high:
        return Model(None, share or 0.0, {})
    blocks = min(-(-(total or 1) // (max_words * WORD_BYTES)) or 1, MOST_BLOCKS)
    # blocks of fold 1 follow
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int") + F.when(learnt, 0).otherwise(blocks)
    known = chosen.withColumn("lang", F.coalesce("lang", F.lit("")))
    labelled = through_bitmap(texts, chosen.select("id"), LABELLED_BITS).withColumn("lang", F.coalesce("lang", F.lit("")))
    one = labelled.join(known, ["id", "digest", "lang"]).select(block.alias("block"), F.col("id").cast("string").alias("id"), "lang", "toxic", "text")
    # after the join, which would deal them anew where blocks are few: a block is learnt in one task
    one = one.repartition(2 * blocks, "block")
    one = one.sortWithinPartitions("block", F.xxhash64("id", F.lit(seed)), "id")
    rows = checkpoint(_tokens(one, "block id lang toxic", "block int, id string, lang string, toxic int"))
    drop_shuffles(df.sparkSession)
    net = Network(seed)
    net.begin()
    if fits:
        for number in range(EPOCHS):
            _round(rows.where(F.col("block") < blocks).select("block", "id", "toxic", "words"), net, number)
            drop_shuffles(df.sparkSession)
    thresholds = {}
    judged = _judged(rows.where(F.col("block") >= blocks), net)
    if len(judged):
        logits, toxic, times = judged["bin"].to_numpy() / STEP, judged["toxic"].to_numpy().astype(np.float32), judged["times"].to_numpy()
        if toxic.min() < toxic.max():
            net.calibrate(logits, toxic, times)
        scores = 1 / (1 + np.exp(-np.clip(net.slope * logits + net.shift, -40, 40)))
        langs = np.array(judged["lang"].to_pylist())
        thresholds = {str(lang): best_threshold(scores[langs == lang], toxic[langs == lang], times=times[langs == lang]) for lang in np.unique(langs)}
    return Model(net.packed(), share, thresholds)


def _judged(rows: DataFrame, net: Network) -> pa.Table:
    """How many labels of either kind each language has at each step of the logit."""
    shared = rows.sparkSession.sparkContext.broadcast(net.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = Network.unpacked(shared.value), None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            fresh = [i for i, id_ in enumerate(ids) if id_ != (ids[i - 1] if i else last)]  # rows of one id are the same row again
            last = ids[-1] if ids else last
            batch = batch.take(pa.array(fresh, pa.int64()))
            bins = [int(np.rint(own.logits(t, np.array([len(t)]))[0] * STEP)) for t in map(_unpacked, batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(bins, pa.int64())], names=["lang", "toxic", "bin"])

    each = rows.select("id", "lang", (F.col("toxic") > 0).cast("int").alias("toxic"), "words")
    return each.mapInArrow(run, "lang string, toxic int, bin long").groupBy("lang", "toxic", "bin").agg(F.count(F.lit(1)).alias("times")).orderBy("lang", "toxic", "bin").toArrow()


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: the id column, held_out, score, predicted, threshold (of the language), flagged."""
    shared = df.sparkSession.sparkContext.broadcast(model.parts)
    share = model.share
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpacked(shared.value) if shared.value else None
        for batch in batches:
            found = [net.scores(rows_of(hashes), counts) if net else np.full(len(counts), share) for hashes, counts in each_text(batch.column(3), SEPARATORS, PREFIXES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(found) if found else [], pa.float64())], names=["id", "lang", "held_out", "score"])

    texts = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = texts.mapInArrow(run, f"id {id_type}, lang string, held_out boolean, score double")
    cut = F.lit(0.5)
    for lang, threshold in model.thresholds.items():
        cut = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(threshold)).otherwise(cut)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), cut.alias("threshold"), (F.col("score") >= cut).cast("int").alias("flagged"))


def toxicity(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(df, train(df, labels, **options))
