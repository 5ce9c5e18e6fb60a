"""Tables between the steps of a long plan, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whether Spark deletes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one in local mode alone.

    Raises ValueError on a cluster that names none, as executors could not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be over
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the staging folder and read back: computed once, and safe from lost executors.

    The files are removed by ``freed`` or when the driver exits, the shuffles behind them at once.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def freed(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing will read again."""
    for table in tables:
        _remove(table.sparkSession, table._staged_path)


def running_sum(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows before each, by ``order``; equal rows in any order.

    Rows are dealt into ranges of ``order``. Each range is summed on its own, and those few sums are carried on, so no
    task orders all rows.
    """
    part = "_range"
    dealt = stored(df.repartitionByRange(*order).withColumns({part: F.spark_partition_id(), "_value": value}), "ranges")
    sums = dealt.groupBy(part).agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(F.col(part).alias("_of"), before.alias("_carried"))  # a row a range
    own = F.coalesce(F.sum("_value").over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = dealt.withColumn(out, own).join(F.broadcast(carried), F.col(part) == F.col("_of"))
    return summed.withColumn(out, F.col(out) + F.col("_carried")).drop(part, "_value", "_of", "_carried")
