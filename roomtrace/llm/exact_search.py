"""Exact top-k by inner product with a pivot table.

The distances of every vector to a few pivots are computed once.  For a query q and a
candidate x the triangle inequality makes the largest |d(q, p) - d(x, p)| over the
pivots a lower bound of d(q, x), and with the lengths of both an upper bound of their
inner product.  Candidates are evaluated in the order of that bound until no bound
left reaches the k-th best score.

Candidates lie in blocks, queries in blocks; a grid deals them to tasks, so that each pair of
blocks meets in one.  A task keeps its queries, reads its candidates as a stream, and only the k best
of each query leave it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomtrace.llm.common import table
from roomtrace.llm.vectors import EXACT, as_decimals, as_long, first_k, grid, matrix, meet, numbered, smallest, unpack, usable
from roomtrace.plans.scratch import materialize

PIVOTS = 16
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 512
#: Candidates of a block that are evaluated first, those with the highest bounds, for a query that has no k-th score yet.
FIRST = 64
#: Queries whose bounds are formed together; with a block of candidates they fit a cache.
TOGETHER = 32


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors * vectors).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def packed(rows: DataFrame, size: int, pivots: np.ndarray) -> DataFrame:
    """Blocks of up to ``size`` rows of (id, vector): ids, vectors (of the type ``kind``) and the pivot table as bytes, one narrow pass."""

    def pack(batches):
        ids, vectors, held = [], [], 0

        def blocks(all_rows):
            nonlocal ids, vectors, held
            i, v = np.concatenate(ids), np.concatenate(vectors)
            end = len(i) if all_rows else len(i) // size * size
            for a in range(0, end, size):
                part, own = v[a : a + size], i[a : a + size]
                near, part = distances(part, pivots).astype(np.float32), smallest(part)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(own)], pa.int64()), "ids": [own.tobytes()], "kind": [part.dtype.str], "vectors": [part.tobytes()], "near": [near.tobytes()]})
            ids, vectors, held = [i[end:]], [v[end:]], len(i) - end

        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            vectors.append(matrix(batch.column(1), np.float64))
            held += len(ids[-1])
            if held >= size:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    return rows.mapInArrow(pack, "n long, ids binary, kind string, vectors binary, near binary")


def upper_bounds(q_norms: np.ndarray, norms: np.ndarray, q_near: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each query and candidate a number that their inner product does not pass, from float32 distances to the pivots."""
    upper, turned = np.empty((len(q_norms), len(norms)), np.float32), np.ascontiguousarray(near.T)
    for a in range(0, len(q_norms), TOGETHER):
        lower = upper[a : a + TOGETHER]
        lower[:] = 0
        for p, distance in enumerate(turned):
            np.maximum(lower, np.abs(q_near[a : a + TOGETHER, p, None] - distance), out=lower)
        # half a unit, and a share of the lengths that covers all rounding in the bounds
        halves = ((q_norms[a : a + TOGETHER] ** 2)[:, None] + (norms**2)[None, :]).astype(np.float32) * np.float32(0.5 + 4e-6)
        np.subtract(halves, lower * lower / 2 - np.float32(0.5), out=lower)
    return upper


def best_of_block(q_ids, queries, q_near, ids, vectors, near, k: int, known: np.ndarray):
    """(query positions, candidate positions, scores): each query's best candidates of one block, the k best and perhaps more.

    ``known`` is for each query its k-th score in the blocks before, or minus infinity; candidates below it are left out.  Where it is not known, the
    candidates with the highest bounds come first; of the others only those are looked at whose bound reaches the k-th
    score.  Where they are more than an eighth of all pairs, their scores are read from one product of the two blocks.
    Scores are whole numbers, exact at any size.
    """
    n = len(vectors)
    norms, q_norms = (np.sqrt(np.square(x, dtype=np.float64).sum(axis=1)) for x in (vectors, queries))
    most = q_norms.max() * norms.max()
    # doubles hold every partial sum exactly below 2^53, floats below 2^24; else they only choose what is worked out in whole numbers
    slack = np.zeros(len(queries)) if most < 1 << 52 else 1e-12 * q_norms * norms.max()
    kind = np.float32 if most < 1 << 23 else np.float64
    q, v = queries.astype(kind), vectors.astype(kind)
    upper = upper_bounds(q_norms, norms, q_near, near)
    same = np.flatnonzero(np.isin(ids, q_ids))
    own_q, own_x = np.nonzero(q_ids[:, None] == ids[same][None, :])
    own_x = same[own_x]
    upper[own_q, own_x] = -np.inf
    lowest = -1e38  # above minus infinity, which marks pairs that do not count
    least = np.maximum(known - 2 * slack, lowest)
    new = np.flatnonzero(np.isneginf(known))
    if len(new):
        first = np.argpartition(-upper[new], FIRST, axis=1)[:, :FIRST] if n > FIRST else np.tile(np.arange(n), (len(new), 1))
        scores = np.einsum("qd,qfd->qf", q[new], v[first])
        scores[q_ids[new, None] == ids[first]] = -np.inf
        if scores.shape[1] >= k:
            least[new] = np.maximum(np.partition(scores, -k, axis=1)[:, -k] - 2 * slack[new], lowest)
    left = upper >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
    left[own_q, own_x] = False
    if np.count_nonzero(left) > left.size / 8:
        scores = q @ v.T
        scores[own_q, own_x] = -np.inf
        reached = scores >= least.astype(kind)[:, None]
        if n >= k and np.count_nonzero(reached) > 2 * k * len(queries):
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k] - 2 * slack)
            reached = scores >= least.astype(kind)[:, None]
        a, x = np.nonzero(reached)
        scores = scores[a, x]
    else:
        a, x = np.nonzero(left)
        scores = np.einsum("ij,ij->i", q[a], v[x])
        reached = scores >= least[a]
        a, x, scores = a[reached], x[reached], scores[reached]
    if not np.any(slack):
        return a, x, scores.astype(np.int64)
    whole = {("q", i): [int(c) for c in queries[i]] for i in np.unique(a)} | {("x", i): [int(c) for c in vectors[i]] for i in np.unique(x)}
    exact = np.empty(len(a), dtype=object)
    exact[:] = [sum(c * d for c, d in zip(whole["q", i], whole["x", j])) for i, j in zip(a, x)]
    return a, x, exact


class Asked:
    """A block of queries and the k best of each among the candidates seen so far."""

    def __init__(self, ids, vectors, near, k: int):
        self.ids, self.vectors, self.near, self.k = ids, vectors, near, k
        self.known = np.full(len(ids), -np.inf)
        self.query, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, ids, vectors, near) -> None:
        a, x, scores = best_of_block(self.ids, self.vectors, self.near, ids, vectors, near, self.k, self.known)
        query, found, scores = np.concatenate([self.query, a]), np.concatenate([self.found, ids[x]]), np.concatenate([self.scores, scores])
        best = first_k(query, found, scores, self.k)
        self.query, self.found, self.scores = query[best], found[best], scores[best]
        counts = np.bincount(self.query, minlength=len(self.ids))
        full = counts == self.k
        self.known[full] = self.scores[np.cumsum(counts)[full] - 1].astype(np.float64)

    def answer(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.found), as_decimals(self.scores)], ["query_id", "id", "score"])


def exact_top_k(rows: DataFrame, is_query, k: int, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score): each query's k largest inner products with all other rows, ties to the smaller id.

    ``vector_column`` holds whole numbers; vectors with one of 2^53 or more in size take no part.  Scores are exact; one that is no
    long is shown as the nearest one.  ``is_query`` is a condition on the column ``id``.  Every row but those
    with the query's own id is a candidate; with fewer than k of them all are returned.  Rows that cannot take part are
    named in ``usable``.  Repeated ids are candidates of their own, and queries of their own under the same id are answered once.
    """
    spark = rows.sparkSession
    held = materialize(usable(rows, id_column, vector_column).filter(~F.exists("vector", lambda c: F.abs(c) >= EXACT)), "vectors")
    # the pivots: a bounded number of rows, spread by a hash of the id
    chosen = held.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    points = np.array([r["vector"] for r in chosen])
    asked = materialize(held.filter(is_query).dropDuplicates(["id"]), "queries")
    queries, candidates = asked.count(), held.count()
    # every block of queries meets every block of candidates: a stated query set against all rows
    dims = points.shape[1]
    down, across = grid(spark, queries, dims + 4 * pivots + 16 * k, candidates, dims + 4 * pivots)
    q_blocks = -(-queries // QUERY_BLOCK) or 1
    down, across = min(down, q_blocks), min(across, -(-candidates // CANDIDATE_BLOCK))
    q_rows = numbered(packed(asked.repartition(q_blocks), QUERY_BLOCK, points), q_blocks)
    cells = meet(q_rows, numbered(packed(held, CANDIDATE_BLOCK, points), held.rdd.getNumPartitions()), down, across)
    cells = cells.select("cell", "side", "n", "ids", "kind", "vectors", "near")

    def search(batches):
        now, asked = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                cell, side, n, ids, kind, vectors, near = (c[row].as_py() for c in batch.columns)
                if cell != now:
                    yield from (block.answer() for block in asked)
                    now, asked = cell, []
                ids, vectors, near = np.frombuffer(ids, np.int64), unpack(vectors, np.dtype(kind), n), unpack(near, np.float32, n)
                if side == 0:
                    asked.append(Asked(ids, vectors, near, k))
                else:
                    for block in asked:
                        block.meet(ids, vectors, near)
        yield from (block.answer() for block in asked)

    best = cells.mapInArrow(search, "query_id long, id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", as_long(F.col("score")).alias("score"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The 20 best of all other rows of ``embeddings`` for every twentieth vec_id; ``exact_top_k`` defines odd rows."""
    # floor of a non-finite component would be a number; such vectors take no part
    whole = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("raw"))
    finite = ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = whole.filter(F.col("raw").isNotNull() & finite).select("vec_id", F.transform("raw", lambda x: F.floor(x * 64).cast("double")).alias("embedding"))
    found = exact_top_k(rows, F.col("id") % 20 == 0, k)
    return found.withColumnRenamed("id", "vec_id")


OP7_SQL = """
WITH held AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM held q JOIN held c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
