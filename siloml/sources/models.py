"""Saving and loading models of every family: parameter and tree tables as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_model(table: DataFrame, path: str) -> None:
    """A parameter or tree table, one JSON document per row."""
    table.select(F.to_json(F.struct(*table.columns)).alias("value")).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return spark.read.text(path).select(F.from_json("value", ddl).alias("r")).select("r.*")
