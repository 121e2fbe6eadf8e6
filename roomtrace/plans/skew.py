"""Plan building blocks that stay balanced when one key holds much of the data."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomtrace.plans.scratch import materialize

#: Rows of a table looked up in that every task can hold.
SMALL_ROWS = 4096
#: Rows of one key that one task may hold; a key with more of them is split into parts of at most about so many.
HOT_ROWS = 200_000
#: Longest stretch of one key's rows that a single window group may hold.
CHUNK = 1024


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with at least ``hot_rows`` rows, and the number of parts it takes."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )


def lookup(
    many: DataFrame,
    unique: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join ``many`` with a table that has one row per key.

    The table is written when the plan is built, so that its size is known.  One of ``SMALL_ROWS`` rows
    at most goes to all tasks, and ``many`` stays where it is.  Otherwise every key of ``many`` with more than ``hot_rows`` rows is spread over parts of about
    that size, by a hash of the ``spread`` columns (repeatable, so a recomputed task
    gives the same rows); only the matching rows of ``unique`` are repeated, once for
    each part.  Keys are counted at every size; the table of hot keys is a fraction
    1 / ``hot_rows`` of the rows at most and joined as the optimizer sees fit.
    """
    unique = materialize(unique, "unique")
    if unique.count() <= SMALL_ROWS:
        return many.join(F.broadcast(unique), keys, how)
    hot = hot_keys(many.select(*keys), keys, hot_rows)
    part = lambda parts: F.pmod(F.xxhash64(*[F.col(c) for c in spread]), parts).cast("int")
    unmatchable = reduce(Column.__or__, [F.col(c).isNull() for c in keys])
    partitions = F.lit(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted_many = (
        many.join(hot, keys, "left")
        .withColumn("_salt", F.when(unmatchable, part(partitions)).when(F.col("_parts").isNotNull(), part(F.col("_parts"))).otherwise(F.lit(0)))
        .drop("_parts")
    )
    salted_unique = (
        unique.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted_many.join(salted_unique, [*keys, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark prunes to ``k`` per key before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _stretch_start(order: str, chunk: int) -> Column:
    """First order value of the stretch a row belongs to."""
    value = F.col(order).cast("bigint")
    return value - F.pmod(value, F.lit(chunk))


def trailing(
    df: DataFrame, keys: list[str], position: str, lookback: int, aggregates: dict, chunk: int = CHUNK
) -> DataFrame:
    """Aggregates over the rows at positions p-lookback .. p-1 of the same key.

    ``position`` is an integer column.  Rows are grouped by stretches of
    ``chunk`` positions; the last ``lookback`` positions of a stretch are also
    given to the next one as context, so every frame is complete and no group
    holds a whole key's rows.  ``chunk`` must be at least ``lookback``.
    """
    stretch = _stretch_start(position, chunk)
    last_positions = F.pmod(F.col(position), F.lit(chunk)) >= chunk - lookback
    copies = F.when(last_positions, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = (
        df.withColumn("_copy", F.explode(copies))
        .withColumn("_stretch", stretch + F.col("_copy") * chunk)
    )
    frame = W.partitionBy(*keys, "_stretch").orderBy(position).rangeBetween(-lookback, -1)
    for name, aggregate in aggregates.items():
        rows = rows.withColumn(name, aggregate.over(frame))
    return rows.where(F.col("_copy") == 0).drop("_copy", "_stretch")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
