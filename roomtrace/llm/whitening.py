"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred vectors as rows.  From a start v1 the recurrence

    p = X v_j - beta_(j-1) u_(j-1),  u_j = p / alpha_j,   r = X' u_j - alpha_j v_j,  v_(j+1) = r / beta_j

gives orthonormal u and v in which X is bidiagonal; the singular values of that small
matrix are those of X, its right vectors combine the v into the components.

Every v has as many entries as a vector and stays on the driver.  Every u has an entry for each
row and is never stored: it is X c for a short c that follows the same recurrence, so the tasks
form the entries of all earlier u again from their own rows.  One pass over the rows does both
products: p = X c, its products with all u (full reorthogonalisation) and X' p.  What a
pass returns is as long as two vectors, summed by Spark.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import table
from roomtrace.llm.vectors import matrix, whole_vectors
from roomtrace.plans.scratch import materialize

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block.
BLOCK = 4096
#: A leading pair is found when its residual is below this share of the largest singular value.
FOUND = 1e-13
#: Below this share of the largest singular value a step leads nowhere new, and a component has no deviation.
NOTHING = 1e-10


def centred_blocks(held: DataFrame, n: int, sums: list[int], largest: int) -> DataFrame:
    """(ids, deviations, rows): blocks of centred vectors x - S / n as doubles, and of each the sum of the squares of n x - S.

    The differences are whole numbers and exact at any size; a sum of squares that is no long is null.
    """
    dims = len(sums)
    kind = held.schema["id"].dataType.simpleString()
    difference = n * largest + max(map(abs, sums))
    fits = dims * difference * difference < 1 << 63

    def pack(batches):
        total = np.array(sums, dtype=np.int64 if fits else object)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                away = matrix(part.column(1), np.int64).astype(total.dtype) * n - total
                square = (away * away).sum(axis=1).tolist()
                centred = (away / n).astype(np.float64)
                one = np.array([0, part.num_rows], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(one), part.column(0)),
                        pa.array([[s if s < 1 << 63 else None for s in square]], pa.list_(pa.int64())),
                        pa.array([np.ascontiguousarray(centred).tobytes()], pa.binary()),
                    ],
                    ["ids", "deviations", "rows"],
                )

    return held.mapInArrow(pack, f"ids array<{kind}>, deviations array<long>, rows binary")


def _summed(blocks: DataFrame, of_block, size: int) -> np.ndarray:
    """The sum of ``of_block(matrix)``, ``size`` numbers, over all blocks."""

    def add(batches):
        total = None
        for batch in batches:
            for blob in batch.column(0):
                part = of_block(blob.as_py())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    out = np.zeros(size)
    for row in blocks.select("rows").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out


def both_products(blocks: DataFrame, dims: int, c: np.ndarray, earlier: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """With p = X c and U = X ``earlier``: p'p, U'p and X'p, in one pass."""
    step, size = np.column_stack([c, earlier]), earlier.shape[1]

    def of_block(blob):
        x = np.frombuffer(blob, dtype=np.float64).reshape(-1, dims)
        u = x @ step
        p = u[:, 0]
        return np.concatenate([p @ u, x.T @ p])

    got = _summed(blocks, of_block, 1 + size + dims)
    return got[0], got[1 : 1 + size], got[1 + size :]


def _away_from(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(product, dims: int, k: int, locked: np.ndarray, start: np.ndarray, scale: float):
    """(singular values, right vectors) of X outside of the ``locked`` vectors: the leading k, or all if the space is used up.

    It ends with the leading k only while less than half of the dimensions are used.
    ``product(c, earlier)`` is one pass.  ``scale`` is a size of X, against which a step counts as nothing.  The last value
    returned says whether the space is used up: whether all of X's action on what the start reaches is in the pairs.
    """
    v = _away_from(start, locked)
    basis, combos, pulled = [v / np.linalg.norm(v)], np.zeros((dims, 0)), np.zeros((dims, 0))
    alphas, betas = [], []
    while True:
        c = basis[-1] - (betas[-1] * combos[:, -1] if betas else 0)
        square, along, back = product(c, combos)
        # full reorthogonalisation: what p has of earlier u is taken out, here and in X'p
        c, back = c - combos @ along, back - pulled @ along
        alpha = float(np.sqrt(max(square - along @ along, 0.0)))
        alphas.append(alpha)
        used_up = alpha <= NOTHING * scale
        if not used_up:
            c, back = c / alpha, back / alpha
            combos, pulled = np.column_stack([combos, c]), np.column_stack([pulled, back])
            whole = np.column_stack([locked, *basis])
            r = _away_from(back - alpha * basis[-1], whole)
            beta = float(np.linalg.norm(r))
            used_up = beta <= NOTHING * scale or whole.shape[1] == dims
        left, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        # to end early means to search outside of what is found once more, about as many passes again
        worth = 2 * whole.shape[1] < dims if not used_up else False
        found = worth and len(values) > k and np.all(beta * np.abs(left[-1, :k]) <= FOUND * values[0])
        if used_up or found:
            vectors = np.column_stack(basis) @ right.T
            return (values, vectors, True) if used_up else (values[:k], vectors[:, :k], False)
        betas.append(beta)
        basis.append(r / beta)


def leading_pairs(product, dims: int, k: int, scale: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of X and their right vectors, as columns.

    A start reaches one vector of those that share a value.  So the search is repeated outside of the vectors found,
    until nothing larger than the k-th value is there.
    """
    random = np.random.default_rng(seed)
    values, vectors = np.zeros(0), np.zeros((dims, 0))
    while vectors.shape[1] < dims:
        more, at, used_up = bidiagonalise(product, dims, k if not len(values) else 1, vectors, random.standard_normal(dims), scale)
        least = values[min(k, len(values)) - 1] if len(values) >= k else 0.0
        values, vectors = np.concatenate([values, more]), np.column_stack([vectors, at])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], np.linalg.qr(vectors[:, order])[0]
        if least and more.max() <= least * (1 + FOUND):
            break
    return values[:k], vectors[:, :k]


def whiten(
    rows: DataFrame, components: int = COMPONENTS, scaled=lambda c: F.floor(c * SCALE).cast("double") + SHIFT, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each vector on the leading components, with unit variance.

    ``scaled`` makes a whole number of each component of a vector; ``whole_vectors`` says which rows take part.  Every one of
    them, repeated rows and rows without an id too, is a row of the fit and of the result.  ``components`` are numbered from 1 by falling variance; directions
    without variance are no components, so that few distinct vectors give fewer, and equal vectors or an empty table no
    row.  ``deviation`` is the exact sum of squares of n x - S (null if it is no long).  Components of equal variance are
    any orthonormal vectors of their space.  Other columns are not read.
    """
    spark = rows.sparkSession
    held = materialize(whole_vectors(rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")), scaled, "vector"), "whole")
    per_entry = held.select(F.posexplode("x").alias("at", "c")).groupBy("at")
    entries = per_entry.agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(17,0)")).alias("s"), F.max(F.abs("c")).alias("m")).orderBy("at").collect()
    kind = held.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = spark.createDataFrame([], schema)
    if not entries:
        return nothing
    n, dims = entries[0]["n"], len(entries)
    blocks = materialize(centred_blocks(held, n, [int(r["s"]) for r in entries], max(r["m"] for r in entries)), "centred")

    def square(blob):
        x = np.frombuffer(blob, dtype=np.float64)
        return np.array([x @ x])

    total = float(_summed(blocks, square, 1)[0])
    if total <= 0:
        return nothing
    scale = np.sqrt(total / dims)
    values, vectors = leading_pairs(lambda c, earlier: both_products(blocks, dims, c, earlier), dims, min(components, dims), scale)
    real = values > NOTHING * scale
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    variance = values * values / n
    project = vectors / np.sqrt(variance)

    def products(blob):
        w = np.frombuffer(blob, dtype=np.float64).reshape(-1, dims) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums = _summed(blocks, products, k + k * k)
    means = sums[:k] / n
    error = float(np.abs(sums[k:].reshape(k, k) / n - np.outer(means, means) - np.eye(k)).max())
    explained = variance / (total / n)

    def project_rows(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                ids, deviations = batch.column(0).slice(b, 1).flatten(), batch.column(1).slice(b, 1).flatten()
                w = np.frombuffer(batch.column(2)[b].as_py(), dtype=np.float64).reshape(-1, dims) @ project
                rows_of = np.repeat(np.arange(len(ids)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), pa.array(np.full(len(rows_of), n, dtype=np.int64)),
                        deviations.take(pa.array(rows_of)), pa.array(w.reshape(-1)), pa.array(np.tile(explained, len(ids))), pa.array(np.full(len(rows_of), error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(project_rows, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` on the 8 leading components of all of them; ``whiten`` defines odd rows."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
