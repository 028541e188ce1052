"""Tables in folders of Parquet, ORC, CSV or JSON, as DataFrames or temporary views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Tables of the test data.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str, format_: str = "parquet", **options) -> DataFrame:
    return spark.read.format(format_).options(**options).load(f"{folder}/{name}.{format_}")


def register_tables(spark: SparkSession, folder: str, names: Iterable[str] = TABLES, format_: str = "parquet", **options) -> None:
    """A temporary view for each table."""
    for name in names:
        read_table(spark, folder, name, format_, **options).createOrReplaceTempView(name)
