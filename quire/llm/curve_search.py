"""Nearest neighbours by cosine with shifted space-filling curves.

Each of CURVES orderings projects the vectors on a few random directions, shifts them and
sorts by the Hilbert curve through the projections, range-partitioned by Spark. The order
is cut into blocks; a query meets the blocks of the window round its own place in every
ordering, and what the windows find is merged and ranked by the exact measure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

#: Orderings, directions of each, and bits per direction.
CURVES, DIRECTIONS, BITS = 16, 8, 7
#: Share of all rows in a window. Vectors without structure need a share; clustered ones find more in less.
WINDOW = 0.08
#: Rows of a block, and queries that are compared with a block in one call.
BLOCK, CHUNK = 2048, 4096
#: Rows that the projections' centres and spreads are fitted on, about.
SAMPLE = 4000


def usable(v: Column) -> Column:
    """Not null, with finite components that are not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Each row's place on the Hilbert curve through a grid of 2^bits cells a side."""
    x = [grid[:, i].astype(np.int64) for i in range(grid.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            turn = (x[i] >> b) & 1 == 1
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with the row of b, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Curves:
    """Directions, centres, spreads and shifts, drawn from a seed and fitted on a sample."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.m = min(DIRECTIONS, d)
        unit = _unit(sample)
        self.fits = []
        for _ in range(CURVES):
            turn = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :self.m]
            p = unit @ turn
            self.fits.append((turn, p.mean(axis=0), p.std(axis=0) + 1e-12, rng.uniform(0, 1, self.m)))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        unit, out = _unit(vectors), []
        for turn, mean, std, shift in self.fits:
            z = np.clip((unit @ turn - mean) / std, -8, 8)
            u = (1 / (1 + np.exp(-1.702 * z)) + shift) / 2
            out.append(hilbert(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))
        return out


def _order(curves):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                keys = curves.keys(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), n)), pa.array(np.concatenate(keys)),
                    pa.chunked_array([batch.column(0)] * len(keys)).combine_chunks()], ["curve", "key", "cid"])

    return run


def _meet(k):
    def run(block):
        asks = block["asks"].to_numpy(zero_copy_only=False).astype(bool)
        ids, vectors = block["id"].to_numpy(), _matrix(block["vector"])
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        found_q, found_c = [], []
        if len(q) and len(c):
            unit = _unit(vectors)
            for since in range(0, len(q), 256):
                rows = q[since:since + 256]
                near = unit[rows] @ unit[c].T
                least = np.partition(near, -min(k, len(c)), axis=1)[:, -min(k, len(c))]
                for i, row in enumerate(rows):
                    hit = np.flatnonzero(near[i] >= least[i] - 1e-12)
                    hit = hit[np.lexsort((ids[c[hit]], -near[i][hit]))[:k]]
                    found_q.append(np.full(len(hit), row))
                    found_c.append(c[hit])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_c))
        score = cosine(vectors[a], vectors[b]) if len(a) else np.zeros(0)
        return pa.table({"qid": pa.array(ids[a], pa.int64()), "cid": pa.array(ids[b], pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(vectors: DataFrame, asks: Column, k: int = 5, window: float = WINDOW) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``vectors`` (vec_id, embedding) for which ``asks`` holds.

    Candidates are all rows but those with the query's own id. Ties go to the smaller id.
    Equal vectors are indexed once, by their smallest id, with the k + 1 smallest ids that
    have them. Vectors that are null or zero, or hold a null or a non-finite component, take
    no part, nor do those whose length is not the most frequent one. Fewer candidates than
    k give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), asks.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    rows = rows.filter(F.size("vector") == size["n"]).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(3), "vector")})
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    least = rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    classes = written(least.filter("r = 1").select(F.col("vec_id").alias("cid"), "vector", "h1", "h2"), "classes")
    members = written(least.join(classes.select("cid", "h1", "h2"), ["h1", "h2"]).select("cid", "vec_id"), "members")
    queries = written(rows.filter("asks").join(classes.select("cid", "h1", "h2"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")), "queries")
    n = classes.count()
    picked = F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) <= int(min(1, SAMPLE / n) * (1 << 30))
    sample = classes.filter(picked).select("vector").collect() or classes.select("vector").take(1)
    curves = Curves(np.array([r["vector"] for r in sample]))

    asked = queries.select("qid").distinct().count()
    keys = classes.select("cid", "vector").mapInArrow(_order(curves), "curve int, key long, cid long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = ["curve", "key", "cid"]
    # monotonically_increasing_id: the task's number in the upper bits, the row's place in the task in the lower 33
    order = keys.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id())
    order = written(order.select("curve", "cid", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row")), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = order.groupBy("part").count().withColumn("since", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "since")  # a row per task
    placed = order.join(F.broadcast(starts), "part")
    blocks = -(-n // BLOCK)
    reach = max(1, round(window * n / 2 / BLOCK))
    place = ((F.col("since") + F.col("row") - F.col("curve").cast("long") * n) / BLOCK).cast("long")
    placed = placed.select("curve", "cid", place.alias("block"))

    chunks = max(1, -(-asked * (2 * reach + 1) // max(1, blocks) // CHUNK))
    cells = placed.join(classes.select("cid", "vector"), "cid")
    held = cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("asks", F.lit(False))
    wants = cells.join(queries.select(F.col("qid").alias("cid")).distinct(), "cid")
    near = F.sequence(F.greatest(F.lit(0), F.col("block") - reach), F.least(F.lit(blocks - 1), F.col("block") + reach))
    wants = wants.withColumn("block", F.explode(near)).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int")).withColumn("asks", F.lit(True))
    names = ["curve", "block", "chunk", "asks", F.col("cid").alias("id"), "vector"]
    pairs = held.select(*names).unionByName(wants.select(*names)).groupBy("curve", "block", "chunk").applyInArrow(_meet(k + 1), "qid long, cid long, score double")
    pairs = written(pairs.groupBy("qid", "cid").agg(F.max("score").alias("score")), "pairs")
    by_class = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = pairs.join(members, "cid").withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= k + 1).select("qid", "vec_id", "score")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = queries.distinct().join(best, "qid").filter("vec_id != query_id").dropDuplicates(["query_id", "vec_id"])
    found = found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
