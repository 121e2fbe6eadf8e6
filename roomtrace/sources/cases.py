"""Test-case files: JSON arrays of {id, category, question, expected_behavior}."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "id bigint, category string, question string, expected_behavior string"


def read_test_cases(spark: SparkSession, path, id: str | None = None) -> DataFrame:
    """All cases, or those whose id, written as text, equals ``id``."""
    cases = spark.read.schema(CASE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return cases if id is None else cases.where(F.col("id").cast("string") == F.lit(str(id)))
