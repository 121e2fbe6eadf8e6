"""Running sums and last known values along an order, for keys of any size and orders with any gaps.

The rows are range-partitioned and sorted by key and order, so a key with very many
rows is cut between partitions wherever its rows are, and written with the number of their partition and
their place.  A window then never holds more than one key's share of one partition, or one row for each
partition.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomtrace.plans.ranges import ANY_BLOCK, blocks_below, blocks_of_rank
from roomtrace.plans.scratch import materialize

#: Levels of the tree over partitions: enough for a million.
LEVELS = 20


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in order of keys and ``order``, with ``_part`` and an ascending ``_place``."""
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = ordered.withColumn("_part", F.spark_partition_id().cast("bigint")).withColumn("_place", F.monotonically_increasing_id())
    return materialize(numbered, "placed")


def sums_before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _part, _offset): the sum of ``_total`` over a key's earlier parts, where it is not 0.

    A key has one row for each partition that holds some of it.  Without keys all partitions would be one group; they are
    summed by a tree of aligned blocks instead.
    """
    if keys:
        earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        return totals.withColumn("_offset", F.sum("_total").over(earlier)).where(F.col("_offset") != 0).drop("_total")
    own = F.array_remove(blocks_of_rank(F.col("_part"), LEVELS), ANY_BLOCK)
    blocks = totals.select("_total", F.explode(own).alias("_block")).groupBy("_block").agg(F.sum("_total").alias("_sum"))
    wanted = totals.select("_part", F.explode(blocks_below(F.col("_part"), LEVELS)).alias("_block"))
    return wanted.join(blocks, "_block").groupBy("_part").agg(F.sum("_sum").alias("_offset"))


def _within(keys: list[str]):
    return W.partitionBy(*keys, "_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Running sum of whole numbers per key over ``placed`` rows, current row included.

    The keys may be finer than those the rows were placed by, as long as their rows lie together.
    """
    valued = rows.withColumn("_value", value.cast("bigint"))
    offsets = sums_before(valued.groupBy(*keys, "_part").agg(F.sum("_value").alias("_total")), keys)
    return (
        valued.withColumn("_local", F.sum("_value").over(_within(keys)))
        .join(offsets, [*keys, "_part"], "left")
        .withColumn(name, F.col("_local") + F.coalesce("_offset", F.lit(0).cast("bigint")))
        .drop("_value", "_local", "_offset")
    )


def last_known(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value per key over ``placed`` rows, up to the current one."""
    valued = rows.withColumn("_value", value)
    known = F.when(F.col("_value").isNotNull(), F.col("_place"))
    parts = valued.groupBy(*keys, "_part").agg(F.max_by("_value", known).alias("_last"))
    # one row for each partition that holds some of the key
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).where(F.col("_carried").isNotNull())
    return (
        valued.withColumn("_local", F.last("_value", ignorenulls=True).over(_within(keys)))
        .join(carried.select(*keys, "_part", "_carried"), [*keys, "_part"], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_value", "_local", "_carried")
    )
