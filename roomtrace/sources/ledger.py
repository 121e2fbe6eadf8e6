"""Booking ledger: accepted bookings as a Parquet table, one folder per viewing date."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ["booking_ref", "listing_id", "title", "address", "date", "slot", "name"]
    ]
)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def append_bookings(accepted: DataFrame, path: str) -> None:
    """Add accepted bookings; adjudication has made (listing_id, date, slot) unique."""
    rows = accepted.select(*LEDGER_SCHEMA.names)
    rows.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def read_bookings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).select(*LEDGER_SCHEMA.names)


def reset_bookings(spark: SparkSession, path: str) -> None:
    """Empty the ledger, keeping it readable."""
    empty_ledger(spark).write.mode("overwrite").parquet(path)
