"""The listing table laid out for lookups: the last row of each id, in folders by a hash of the id."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtrace.operators.listings import latest_by_id
from roomtrace.plans.scratch import materialize
from roomtrace.sources.listings import LISTING_SCHEMA

#: Folders, and so the numbers that a lookup gathers at most.
FOLDERS = 1024

STORED_SCHEMA = T.StructType([*LISTING_SCHEMA.fields, T.StructField("folder", T.IntegerType())])


def _folder(id_: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(folders)).cast("int")


class ListingsById:
    """A table that ``write_by_id`` made; lookups read only the folders of the ids they ask for."""

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path, folders

    def rows(self) -> DataFrame:
        return self.spark.read.schema(STORED_SCHEMA).parquet(self.path)

    def of(self, ids: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of the listings whose id is in ``ids``, a table with a column ``id``.

        The distinct folder numbers are gathered, at most ``folders`` of them, so that the scan's plan names its folders.
        """
        distinct = ids.select("id").where(F.col("id").isNotNull()).distinct()
        asked = materialize(distinct.withColumn("folder", _folder(F.col("id"), self.folders)), "asked_ids")
        wanted = sorted(r.folder for r in asked.select("folder").distinct().collect())
        return self.rows().where(F.col("folder").isin(wanted)).select("folder", *columns).join(
            asked, ["folder", "id"], "left_semi"
        ).select(*columns)


def write_by_id(listings: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Last row per id, its columns as in the listing table."""
    placed = latest_by_id(listings.select(*LISTING_SCHEMA.names)).withColumn("folder", _folder(F.col("id"), folders))
    placed.hint("rebalance", "folder").write.partitionBy("folder").parquet(path)


def known_listings(listings: DataFrame | ListingsById, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the last listing of each id in ``ids``: from folders by id, or by a pass over the listing table."""
    if isinstance(listings, ListingsById):
        return listings.of(ids, columns)
    needed = list(dict.fromkeys(["row_index", "id", *columns]))
    wanted = materialize(listings.select(*needed).join(ids.select("id").distinct(), "id", "left_semi"), "wanted")
    return latest_by_id(wanted).select(*columns)
