"""Tables that are filled once: append, memoise, rebuild; and text reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def is_open(spark: SparkSession, table: str) -> bool:
    """Whether the table is absent or empty."""
    return not spark.catalog.tableExists(table) or spark.table(table).isEmpty()


def memoised(spark: SparkSession, table: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table, built only where it is absent, empty or forced."""
    if force or is_open(spark, table):
        build().write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def rebuilt(df: DataFrame, table: str) -> DataFrame:
    """The table, replaced; readers of the old one are not disturbed until the new one is complete."""
    spark, staging = df.sparkSession, f"{table}__staging"
    df.write.mode("overwrite").saveAsTable(staging)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    return spark.table(table)
