"""Nearest neighbours of many query vectors by cosine, through an inverted file of quantised residuals.

1. Centroids are fitted in the driver on the ``SAMPLE`` vectors of least hash; their number
   grows with the root of the table up to ``MOST_CELLS``. Every vector, scaled to unit length, goes
   to the cell of its closest centroid as a residual of a byte per dimension, with the
   norm of what rounding lost.
2. Cells are packed into blocks of some ``BLOCK`` vectors and the queries that probe a
   cell into blocks of their own, however many a cell has; blocks meet by cell. A pair
   of blocks is scored as one matrix product, and a query keeps what its bounds allow to
   be among the k best.
3. What is kept meets the vectors themselves by id, and is ranked by exact cosine.
4. With ``exact``, the k-th cosine found is a threshold: by the cell's radius, another cell
   may hold something better only if the centroid is close enough, and only such cells
   are probed then. Without, recall depends on ``probes``.

Equal vectors are one vector with their k + 1 least ids, which is all that the k best of
any query can name; the combine that finds them runs before the shuffle, so that one very
common vector is no group.

Defined results: rows with a null id, and vectors that are null, of another length than
most, without length or not finite, are no neighbours, and as queries have none; a
query never finds its own id; ties go to the smaller id; fewer than k others give fewer rows;
repeated rows are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import small_batches, table, written

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4_096, 8
#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 8_192, 1_024
#: Beyond the errors that are measured: rounding of single-precision sums.
SLACK = 2e-5


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and v of the rows that have a direction."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    square = _square(F.col("v"))
    return rows.where((square > 0) & (square < float("inf")))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """Each different vector once: vid (its least id), v and its k + 1 least ids."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)  # a limit that Spark applies before the shuffle too
    return least.groupBy("v").agg(F.min("id").alias("vid"), F.collect_list("id").alias("ids"))


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return (flat / np.sqrt((flat * flat).sum(1, keepdims=True))).astype(np.float32)


def centroids(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of unit vectors by a few rounds of k-means, from vectors that lie evenly in the sample."""
    found = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ found.T - 0.5 * (found * found).sum(1), 1)
        count = np.bincount(own, minlength=cells)
        sums = np.zeros(found.shape, np.float64)
        np.add.at(sums, own, vectors)
        found[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
    return found


def _index(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """cell, vid, code, scale, lost, radius of each vector(vid, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1))
            cell = np.argmax(unit @ centers.T - 0.5 * (centers * centers).sum(1), 1)
            rest = unit - centers[cell]
            scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            lost = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1))
            codes = pa.Array.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), codes, pa.array(scale), pa.array(lost), pa.array(np.sqrt((rest * rest).sum(1)))], names=["cell", "vid", "code", "scale", "lost", "radius"])

    return vectors.select("vid", "v").mapInArrow(run, "cell int, vid long, code binary, scale float, lost float, radius float")


def _probes(queries: DataFrame, centers: np.ndarray, radius: np.ndarray, probes: int, more: bool) -> DataFrame:
    """cell, qid, unit vector and least score, for the closest cells; more: for all other cells that may hold a score above ``least`` of queries(qid, v, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                unit = _unit(part.column(1))
                close = unit @ centers.T
                close[:, radius < 0] = -np.inf  # cells without vectors
                n = min(probes, close.shape[1])
                first = np.argpartition(-close, n - 1, 1)[:, :n]
                wanted = np.zeros(close.shape, bool)
                np.put_along_axis(wanted, first, True, 1)
                least = part.column(2).to_numpy(zero_copy_only=False)
                if more:
                    wanted = ~wanted & (close + radius + SLACK >= least[:, None])
                wanted &= np.isfinite(close)
                query, cell = np.nonzero(wanted)
                data = pa.Array.from_buffers(pa.binary(unit.shape[1] * 4), len(query), [None, pa.py_buffer(np.ascontiguousarray(unit[query]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0).take(pa.array(query)), data, pa.array(least[query].astype(np.float32))], names=["cell", "qid", "unit", "least"])

    return queries.select("qid", "v", "least").mapInArrow(run, "cell int, qid long, unit binary, least float")


def _packed(rows: DataFrame, id_col: str, columns: list[str], per_block: int, counts: dict[int, int]) -> DataFrame:
    """A row for each block of a cell, with ids and columns end to end as bytes."""
    many = rows.sparkSession.createDataFrame([(c, -(-n // per_block)) for c, n in counts.items()], "cell int, blocks long")  # a row a cell
    dealt = rows.join(F.broadcast(many), "cell").withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by(id_col)

        def joined(name: str) -> bytes:
            column = part.column(name).combine_chunks()
            return b"".join(column.to_pylist()) if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False).tobytes()

        return pa.table({"cell": part.column("cell").slice(0, 1), **{name: pa.array([joined(name)], pa.binary()) for name in (id_col, *columns)}})

    schema = ", ".join(["cell int", *(f"{name} binary" for name in (id_col, *columns))])
    return dealt.select("cell", "block", id_col, *columns).groupBy("cell", "block").applyInArrow(pack, schema)


def _scored(base: DataFrame, asked: DataFrame, centers: np.ndarray, k: int) -> DataFrame:
    """qid and vid of what the codes allow to be among the k best of a pair of blocks, and not below the query's least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = centers.shape[1]
        for batch in batches:
            for row in range(batch.num_rows):
                cell, *parts = (batch.column(c)[row].as_py() for c in range(8))
                vids, code, scale, lost, qids, unit, least = (np.frombuffer(x, t) for x, t in zip(parts, (np.int64, np.int8, np.float32, np.float32, np.int64, np.float32, np.float32)))
                unit = unit.reshape(-1, d)
                score = (unit @ code.reshape(-1, d).T.astype(np.float32)) * scale + (unit @ centers[cell])[:, None]
                low, high = score - lost - SLACK, score + lost + SLACK
                floor = least if len(vids) <= k else np.maximum(least, np.partition(low, len(vids) - k, 1)[:, len(vids) - k])
                query, which = np.nonzero(high >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(vids[which])], names=["qid", "vid"])

    pairs = base.join(asked, "cell").select("cell", "vid", "code", "scale", "lost", "qid", "unit", "least")
    return pairs.mapInArrow(run, "qid long, vid long")


def _ranked(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, vid, cosine, nth of the k best pairs."""
    met = pairs.join(vectors.select("vid", "v", F.sqrt(_square(F.col("v"))).alias("norm")), "vid").join(queries.select("qid", F.col("v").alias("q"), F.sqrt(_square(F.col("v"))).alias("qnorm")), "qid")
    cosine = _dot(F.col("q"), F.col("v")) / (F.col("qnorm") * F.col("norm"))
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "vid")
    return met.select("qid", "vid", cosine.alias("cosine")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def nearest_join(queries: DataFrame, base: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", probes: int = 8, exact: bool = True, cells: int | None = None) -> DataFrame:
    """query_id, id, cosine, rank (1 to k): for each query the k rows of base of greatest cosine, itself left out."""
    spark = base.sparkSession
    rows, asked = _vectors(base, id_col, vector), _vectors(queries, id_col, vector)
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    length = length[0]["length"] if length else 0
    rows, asked = rows.where(F.size("v") == length), asked.where(F.size("v") == length)
    vectors = written(_distinct(rows, k), "nearest-vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, id long, cosine double, rank int")
    own = asked.distinct()
    firsts = own.groupBy("v").agg(F.min("id").alias("qid"))
    different = written(firsts, "nearest-queries")
    named = own.join(firsts, "v").select(F.col("id").alias("query_id"), "qid")
    sample = vectors.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("v").toArrow()
    centers = centroids(_unit(sample.column("v").combine_chunks()), min(cells or max(1, round(n**0.5)), MOST_CELLS, sample.num_rows))
    with small_batches(spark):
        index = written(_index(vectors, centers), "nearest-index")
        stats = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).collect()  # a row a cell
        radius = np.full(len(centers), -1, np.float32)
        for r in stats:
            radius[r["cell"]] = r["radius"]
        blocks = written(_packed(index, "vid", ["code", "scale", "lost"], BLOCK, {r["cell"]: r["n"] for r in stats}), "nearest-blocks")

        def found(probing: DataFrame) -> DataFrame:
            probing = written(probing, "nearest-probes")
            counts = {r["cell"]: r["count"] for r in probing.groupBy("cell").count().collect()}
            return written(_scored(blocks, _packed(probing, "qid", ["unit", "least"], QUERY_BLOCK, counts), centers, k + 1), "nearest-pairs")

        # k + 1 vectors, as the query's own may be one
        best = written(_ranked(found(_probes(different.withColumn("least", F.lit(-2.0)), centers, radius, probes, False)), vectors, different, k + 1), "nearest-first")
        if exact:
            least = best.groupBy("qid").agg(F.max(F.when(F.col("nth") == k + 1, F.col("cosine"))).alias("least"))
            limits = different.join(least, "qid", "left").withColumn("least", F.coalesce(F.col("least") - SLACK, F.lit(-2.0)))
            more = found(_probes(limits, centers, radius, probes, True))
            best = _ranked(best.select("qid", "vid").unionByName(more).distinct(), vectors, different, k + 1)
        # equal vectors stand for their ids, of which the least k + 1 suffice
        each = best.join(vectors.select("vid", "ids"), "vid").select("qid", F.explode("ids").alias("id"), "cosine")
        top = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
        each = each.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).drop("nth")
        mine = named.join(each, "qid").where("id <> query_id")
        last = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
        return written(mine.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "id", "cosine", "rank"), "nearest")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other embeddings for every id divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest_join(vectors.where("vec_id % 50 = 0"), vectors)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 5).alias("cosine"), "rank")


QUERIES = {"nearest_vectors": nearest_vectors}

ORACLES = {
    "nearest_vectors": """
WITH unit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.v, b.v) / (q.norm * b.norm) AS cosine FROM unit q JOIN unit b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id
)
SELECT query_id, vec_id, round(cosine, 5) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 10"""
}
