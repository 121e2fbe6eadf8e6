"""Vectors as packed blocks, shared by the two searches."""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector of doubles) of rows that can take part, all of one length.

    Rows with a null id, and vectors that are null, empty or hold a null or non-finite component, take no part.  Products
    need equal lengths: the most frequent length counts (of equally frequent ones the largest), others take no part.
    """
    vector = F.col("vector")
    held = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = held.filter(F.col("id").isNotNull() & vector.isNotNull() & (F.size(vector) > 0)).filter(~bad)
    first = held.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return held.filter(F.size(vector) == (first["dim"] if first else 0))


#: Whole numbers of this size and more are not exact as doubles.
EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, scaled, vector_column: str) -> DataFrame:
    """The rows with ``x``, their vector as whole numbers (longs), all of one length, in place of the vector.

    ``scaled`` makes a whole number of a component, both doubles.  Vectors that are null, empty or hold a null or
    non-finite component, or one whose number is 2^53 or more in size, take no part; of several lengths the most frequent
    counts (of equally frequent ones the largest).
    """
    raw = F.col(vector_column).cast("array<double>")
    others = [c for c in rows.columns if c != vector_column]
    held = rows.select(*others, raw.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0))
    held = held.filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    held = held.select(*others, F.transform("x", scaled).alias("x")).filter(~F.exists("x", lambda c: F.abs(c) >= EXACT))
    held = held.select(*others, F.col("x").cast("array<long>").alias("x"))
    first = held.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return held.filter(F.size("x") == (first["dim"] if first else 0))


def as_long(score: Column) -> Column:
    """The score as a long; one that is too large becomes the largest or the smallest long."""
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return F.greatest(F.least(score, most), -most - 1).cast("long")


def as_decimals(scores: np.ndarray) -> pa.Array:
    """Whole numbers, longs or of any size, as decimals."""
    return pa.array([Decimal(int(s)) for s in scores], pa.decimal128(38, 0)) if scores.dtype == object else pa.array(scores).cast(pa.decimal128(38, 0))


def first_k(groups: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The positions of each group's k best by falling score, ties to the smaller id, one group after another."""
    order = np.lexsort((ids, -scores, groups)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (groups[i], -scores[i], ids[i])), dtype=np.int64)
    held = groups[order]
    return order[np.arange(len(held)) - np.searchsorted(held, held) < k]


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unpack(blob: bytes, dtype, rows: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=dtype).reshape(rows, -1)


def smallest(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them all."""
    for kind in (np.int8, np.int16, np.int32):
        limit = np.iinfo(kind)
        if x.size and limit.min <= x.min() and x.max() <= limit.max and np.array_equal(y := x.astype(kind), x):
            return y
    return x.astype(np.float64)


#: Bytes sent of the asked side that a cell of a grid keeps in memory, and of the other side that it sorts, at most.
CELL_ASKED, CELL_HELD = 32 << 20, 128 << 20


def grid(spark: SparkSession, asked: int, asked_bytes: int, held: int, held_bytes: int) -> tuple[int, int]:
    """(groups of asked rows, groups of held rows) of a grid in which every asked row meets every held one.

    The cells are as many as a shuffle has partitions, or more where a group would pass the limits of a cell; the bytes of a row are the
    caller's estimate, for asked rows with what is found for them.  Each asked row is sent once for each group of held rows and the other way round, so of all such grids the one is taken that sends the fewest bytes.
    """
    cells = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    down = min(cells, max(1, round(math.sqrt(cells * asked * asked_bytes / max(1, held * held_bytes)))))
    down = max(down, -(-asked * asked_bytes // CELL_ASKED))
    return down, max(1, -(-cells // down), -(-held * held_bytes // CELL_HELD))


def meet(asked: DataFrame, held: DataFrame, down: int, across: int) -> DataFrame:
    """The rows of both, each in all cells of its group in a grid of ``down`` by ``across``, a cell for each task: ``cell``, ``side`` (0 asked, 1 held), columns.

    The column ``at`` numbers the rows of either side.  A cell's asked rows come before its held ones.  Nothing is joined, so nothing
    is broadcast, and a task reads the held rows as a stream.
    """
    own = (F.pmod("at", F.lit(down)) * across).cast("int")
    row = F.pmod("at", F.lit(across)).cast("int")
    left = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda a: own + a))).withColumn("side", F.lit(0))
    right = held.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda a: a * across + row))).withColumn("side", F.lit(1))
    both = left.drop("at").unionByName(right.drop("at"), allowMissingColumns=True)
    return both.repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "side")


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """The rows with ``at``, a number of their own, in turn from each of the ``parts`` partitions."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("at", place * parts + F.spark_partition_id())
