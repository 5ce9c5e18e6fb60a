"""What the corpus operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *replaced: str) -> list[str]:
    """Columns of ``df`` but those of the names ``replaced``, in any case."""
    gone = {r.lower() for r in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working names that no column of ``df`` has, in any case: ``names`` with underscores before them."""
    held, made = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in held:
            name = f"_{name}"
        made.append(name)
    return made


def packed(names: list[str]) -> Column:
    """The columns ``names`` in one struct, by place, so that no name of theirs meets another."""
    return F.struct(*[col(n).alias(f"c{i}") for i, n in enumerate(names)]) if names else F.struct(F.lit(True).alias("c0"))


def unpacked(struct: str, names: list[str]) -> list[Column]:
    """The columns that ``packed(names)`` holds."""
    return [F.col(f"{struct}.c{i}").alias(n) for i, n in enumerate(names)]


#: Rows of a batch between Spark and Python, where the session keeps Spark's default of 10,000.
BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``. Texts are long rows, so the session's Arrow batches are cut to ``BATCH_ROWS`` unless it sets its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode.

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


#: Whether Spark deletes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which cuts its lineage.

    The files outlive a lost executor, and the shuffles behind them go at once, as nothing reads those again. The files
    are removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables of ``shared_table`` that nothing will read again."""
    for table in tables:
        _remove(table.sparkSession, table._shared_path)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: ``(node, root)``, root the smallest node reached.

    Large-star and small-star rounds in turn, each a pair of shuffles over the edges that remain;
    the number of rounds grows with the logarithm of the longest path. Only counts of changed edges
    reach the driver. Nodes without an edge do not appear. Nulls and self loops are ignored.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).filter("u is not null and v is not null and u <> v")
    pairs = shared_table(pairs.distinct(), "edges")
    for _ in range(rounds):
        # large star: every neighbour larger than u is linked to the smallest neighbour of u
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        large = shared_table(large, "large")
        # small star: smaller neighbours of u, and u, are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = shared_table(
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct(),
            "small",
        )
        # done when every edge is a star's: no node is a centre and a leaf, none has two centres
        unsettled = small.select("u").join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)
        again = small.groupBy("u").count().filter("count > 1").limit(1)
        drop_shared(pairs, large)
        pairs = small
        if not unsettled.union(again.select("u")).take(1):
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
