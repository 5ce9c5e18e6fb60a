"""New catalog files as a stream: each object once, within a watermark. An extension, not a parity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def new_objects(spark: SparkSession, path: str, schema: StructType, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Objects of files that arrive in ``path``, repeated ones within ``late`` dropped."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
