"""Exact top-k inner products over vectors in descending length (operator 6).

Vectors are range-partitioned by length, longest first, and packed into
blocks.  A rotation from the singular vectors of a bounded sample moves most
of the length into the leading coordinates.  A query starts with the k-th
best score among the longest vectors as its threshold.  For each block the
product of lengths is tried first (Cauchy-Schwarz on whole vectors), then
partial sums over the leading rotated coordinates plus the product of the
lengths of what is left.  Pairs whose bound reaches the threshold are scored
exactly in whole numbers, and the threshold rises as blocks go by.  The
rotation only steers the pruning, so its sample cannot change a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import batch_rows, written

SAMPLE_ROWS = 4096   # rows the rotation is fitted on
HEAD_ROWS = 1024     # longest vectors that give the first thresholds
BLOCK_ROWS = 512     # vectors a candidate block holds
QUERY_ROWS = 256     # queries a query block holds
SLACK = 1e-6         # relative allowance for rounding in bounds


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending)."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


def _open_above(length: np.ndarray, least: np.ndarray) -> float:
    """A candidate length under which no query of a block can reach its threshold (Cauchy-Schwarz, rounding allowed for)."""
    if not (least > 0).all():
        return 0.0
    return float((least / (length * (1 + SLACK))).min()) * (1 - SLACK) - SLACK


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows by integer inner product.

    Components become floor(``scale`` * x).  Queries are the rows whose id is
    divisible by ``every``; candidates are all rows with another id.  Equal
    scores go to the smaller id.  Rows with a null id, a null or empty vector,
    or a null or non-finite component take no part, and vectors are compared
    only with vectors of the same number of components.  Of a query id that
    occurs twice each row is a query, and their results share the one id's
    ``k`` ranks; rows of the query's own id are never its candidates.  A
    candidate id that occurs twice is two candidates.
    Scores are exact while components stay below 2**20 and vectors below 2**12
    components.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & (F.size("v") > 0) & fine))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    rows = rows.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dims = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    parts = [_one_dimension(rows.where(F.size("v") == d), d, k, every) for d in sorted(dims)]
    schema = "query_id long, vec_id long, score long"
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _one_dimension(rows: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    gram = np.stack(sample.to_list())
    # columns by falling share of the sample's squared length
    turn = np.ascontiguousarray(np.linalg.svd(gram.T @ gram)[0])
    longest = rows.orderBy(F.desc("len2"), "id").limit(HEAD_ROWS).select("id", "v").toPandas()
    head_ids, head = longest["id"].to_numpy(np.int64), np.stack(longest["v"].to_list())
    stops = sorted({min(dim, max(1, dim // 8)), min(dim, max(1, dim // 2))})

    def query_blocks(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            q = _matrix(b.column("v"), dim)
            for s in range(0, len(ids), QUERY_ROWS):
                i, x = ids[s:s + QUERY_ROWS], q[s:s + QUERY_ROWS]
                score = x @ head.T
                score[i[:, None] == head_ids[None, :]] = -np.inf
                kth = np.sort(score, axis=1)[:, -k] if len(head_ids) >= k else np.full(len(i), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.tobytes()]), pa.array([x.tobytes()]), pa.array([kth.tobytes()]),
                     pa.array([_open_above(np.sqrt((x * x).sum(1)), kth)])], ["q_ids", "q", "least", "c_least"])

    def blocks(batches):
        part, ids, vs, n = TaskContext.get().partitionId(), [], [], 0

        def block():
            i, v = np.concatenate(ids), np.concatenate(vs)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([i.tobytes()]), pa.array([v.tobytes()]),
                 pa.array([float(np.sqrt((v * v).sum(1)).max())])], ["part", "c_ids", "c", "c_length"])

        for b in batches:
            ids.append(b.column("id").to_numpy())
            vs.append(_matrix(b.column("v"), dim))
            n += len(b)
            if n >= BLOCK_ROWS:
                yield block()
                ids, vs, n = [], [], 0
        if n:
            yield block()

    with batch_rows(spark, BLOCK_ROWS):
        asked = written(rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(
            query_blocks, "q_ids binary, q binary, least binary, c_least double"), "topk-queries")
        stored = written(rows.repartitionByRange(F.desc("len2"), "id").sortWithinPartitions(F.desc("len2"), "id")
                         .select("id", "v").mapInArrow(blocks, "part int, c_ids binary, c binary, c_length double"),
                         "topk-blocks")
    # a query block meets the blocks long enough for one of its queries, part by part of the length order, longest first
    spans = F.broadcast(stored.groupBy("part").agg(F.max("c_length").alias("longest")))  # one row per task of the sort
    asked = asked.join(spans, F.col("longest") >= F.col("c_least")).drop("longest")
    pairs = asked.join(stored, "part").where(F.col("c_length") >= F.col("c_least"))
    pairs = pairs.sortWithinPartitions("part", "q_ids", F.desc("c_length"))

    def search(batches):
        now = None
        for b in batches:
            for r in b.to_pylist():
                key = (r["part"], r["q_ids"])
                if now is None or now.key != key:
                    if now is not None:
                        yield now.rows()
                    now = _Search(key, r["q"], r["least"], dim, k, turn, stops)
                now.add(r["c_ids"], r["c"], r["c_length"])
        if now is not None:
            yield now.rows()

    with batch_rows(spark, 16):
        return written(pairs.mapInArrow(search, "query_id long, vec_id long, score long"), "topk-found")


class _Search:
    """The best candidates so far of one query block within one part of the length order."""

    def __init__(self, key, q: bytes, least: bytes, dim: int, k: int, turn: np.ndarray, stops: list[int]):
        self.key, self.dim, self.k, self.turn, self.stops = key, dim, k, turn, stops
        self.ids = np.frombuffer(key[1], np.int64)
        self.q = np.frombuffer(q, np.float64).reshape(-1, dim)
        self.rot = self.q @ turn
        self.length = np.sqrt((self.q * self.q).sum(1))
        self.least = np.frombuffer(least, np.float64).copy()
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in self.ids]

    def add(self, ids: bytes, c: bytes, c_length: float) -> None:
        slack = SLACK * (1 + self.length * c_length)
        live = np.flatnonzero(self.length * c_length + slack >= self.least)
        if not len(live):
            return
        ids, c = np.frombuffer(ids, np.int64), np.frombuffer(c, np.float64).reshape(-1, self.dim)
        rot, q = c @ self.turn, self.rot[live]
        open_ = np.ones((len(live), len(ids)), bool)
        for p in self.stops:
            rest = np.sqrt((q[:, p:] ** 2).sum(1))[:, None] * np.sqrt((rot[:, p:] ** 2).sum(1))[None, :]
            open_ &= q[:, :p] @ rot[:, :p].T + rest + slack[live, None] >= self.least[live, None]
        for a, i in enumerate(live.tolist()):
            near = np.flatnonzero(open_[a] & (ids != self.ids[i]))
            if not len(near):
                continue
            score = np.concatenate([self.best[i][0], c[near] @ self.q[i]])
            names = np.concatenate([self.best[i][1], ids[near]])
            top = _top(score, names, self.k)
            self.best[i] = score[top], names[top]
            if len(top) == self.k:
                self.least[i] = max(self.least[i], score[top[-1]])

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([i for _, i in self.best])),
             pa.array(np.concatenate([s for s, _ in self.best]).astype(np.int64))], ["query_id", "vec_id", "score"])
