"""Listing sources and sinks: crawl CSV, row index, normalised table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtrace import constants as K
from roomtrace.functions.text import district_key
from roomtrace.plans.prefix import placed, running_sum
from roomtrace.plans.skew import lookup
from roomtrace.sources.csv_records import read_records

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in K.RAW_COLUMNS])

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("price_vnd", T.LongType()),
        T.StructField("price_label", T.StringType()),
        T.StructField("area_m2", T.DoubleType()),
        T.StructField("district", T.StringType()),
        T.StructField("district_key", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("amenities", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("posted_at", T.TimestampNTZType()),
        T.StructField("days_old", T.IntegerType()),
        T.StructField("url", T.StringType()),
    ]
)


def read_listings(spark: SparkSession, path) -> DataFrame:
    """Crawl CSV as text columns: UTF-8 with or without BOM, quoted line breaks allowed.

    Columns are found by header name; files whose headers differ from the first
    one's are refused rather than read by position.  A missing path is an error.
    A file of any size is read by many tasks, also where its records have line breaks.
    ``_file``, ``_block`` and ``_nth`` say where a row lies.  Building the plan runs a job that finds the stretches that begin inside quotes.
    """
    # without type inference only the header line is looked at here
    names = spark.read.options(header=True, escape='"', inferSchema=False).csv(path).columns
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    options = {"escape": '"', "multiLine": "true", "lineSep": "\n"}  # line breaks inside quotes stay as they are
    by_name = {n.lstrip("﻿").strip(): f"c{k}" for k, n in enumerate(names)}
    records = read_records(spark, path).withColumn("record", F.regexp_replace("record", "^\ufeff", ""))
    rows = records.withColumn("_row", F.from_csv("record", schema, options))
    first = (F.col("_block") == 0) & (F.col("_nth") == 0)
    header = F.array(*[F.coalesce(F.col(f"_row.c{k}"), F.lit("")) for k in range(len(names))])
    same = header == F.array(*[F.lit(n.lstrip("﻿")) for n in names])
    refused = F.raise_error(F.format_string("the header of %s differs from the first file's", F.col("_file")))
    rows = rows.where(F.when(first, F.when(same, F.lit(False)).otherwise(refused.cast("boolean"))).otherwise(F.lit(True)))
    return rows.select(
        *[(F.col(f"_row.{by_name[c]}") if c in by_name else F.lit(None).cast("string")).alias(c) for c in K.RAW_COLUMNS],
        "_file", "_block", "_nth",
    )


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense 0-based index over all rows of read_listings, in (file, place in file) order.

    Two passes: rows per stretch of a file first, then each stretch's offset, a running sum
    along files and stretches, added to the place of its rows.
    """
    place = ["_file", "_block"]
    # the first record of a file is its header
    own = F.col("_nth") - (F.col("_block") == 0).cast("bigint")
    stretches = placed(df.groupBy(*place).agg(F.count("*").alias("_n")), [], place)
    offsets = running_sum(stretches, [], F.col("_n"), "_sum").select(*place, (F.col("_sum") - F.col("_n")).alias("_start"))
    indexed = lookup(df, offsets, place, spread=["_nth"], how="inner")
    return indexed.withColumn(name, F.col("_start") + own).drop(*place, "_nth", "_start")


#: Beside the table, ignored by its readers: the distinct district keys.
_KEYS = "_district_keys"


def write_listings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Normalised table, clustered by district key.

    Rows are range-partitioned by key and row index and sorted by key, so the number of files is that of the
    partitions, however many keys there are; a popular district takes several files, rare ones
    share one, and the smallest and largest key in each file's footer tell readers what to skip.
    """
    clustered = df.repartitionByRange("district_key", "row_index").sortWithinPartitions("district_key", "row_index")
    clustered.write.mode(mode).parquet(path)
    rows = df.sparkSession.read.schema(LISTING_SCHEMA).parquet(path)
    rows.select("district_key").distinct().repartition(1).write.mode("overwrite").parquet(f"{path}/{_KEYS}")


def read_normalized(spark: SparkSession, path: str, district: str | None = None) -> DataFrame:
    """The table of write_listings, or its rows whose key contains the district's.

    The keys that contain it are looked up first; their smallest and largest are compared with the files' statistics.
    """
    rows = spark.read.schema(LISTING_SCHEMA).parquet(path)
    if not district:
        return rows
    fits = F.contains(F.col("district_key"), district_key(F.lit(district)))
    known = spark.read.schema("district_key string").parquet(f"{path}/{_KEYS}").where(fits)
    span = known.agg(F.min("district_key").alias("low"), F.max("district_key").alias("high")).first()
    if span.low is None:
        return rows.where(F.lit(False))
    return rows.where(F.col("district_key").between(span.low, span.high) & fits)
