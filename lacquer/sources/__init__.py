"""Reading and writing with a policy: what is read through these is masked in the scan's own projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.policy import Policy
from ..operators.frames import redact_columns


def read_redacted(spark: SparkSession, path: str, policy: Policy, source: str = "parquet", **options) -> DataFrame:
    """A table of any Spark source with its sensitive columns masked; high and secret columns are not read."""
    return redact_columns(spark.read.format(source).options(**options).load(path), policy)


def write_redacted(df: DataFrame, path: str, policy: Policy, sink: str = "parquet", **options) -> None:
    """The masked table in any Spark sink."""
    redact_columns(df, policy).write.format(sink).options(**options).save(path)


def redacted_view(df: DataFrame, name: str, policy: Policy) -> None:
    """A temporary view of the masked table for SQL."""
    redact_columns(df, policy).createOrReplaceTempView(name)
