"""Writing tables, graphs, models and run records."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, CSV with header, JSON or ORC; ValueError for another format."""
    if format not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {format!r}")
    writer = df.write.mode(mode)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Only the partitions that ``df`` has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, format: str = "parquet") -> None:
    """nodes and edges as Parquet, partitioned by graph, or edge lists, adjacency lists, GraphML or GEXF, a folder a graph."""
    if format == "parquet":
        nodes.write.mode("overwrite").partitionBy("graph_id").parquet(f"{path}/nodes")
        edges.write.mode("overwrite").partitionBy("graph_id").parquet(f"{path}/edges")
        return
    rows = graph_documents(nodes, edges, format) if format in ("graphml", "gexf") else edge_lines(edges, format)
    rows.write.mode("overwrite").partitionBy("graph_id").text(f"{path}/{format}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def edge_lines(edges: DataFrame, format: str) -> DataFrame:
    """graph_id and a line a row: ``src dst weight``, or ``node neighbours``."""
    if format == "edgelist":
        return edges.select("graph_id", F.concat_ws(" ", "src", "dst", F.col("weight").cast("string")).alias("value"))
    if format == "adjlist":
        near = edges.groupBy("graph_id", "src").agg(F.sort_array(F.collect_list("dst")).alias("d"))
        return near.select("graph_id", F.concat_ws(" ", F.col("src").cast("string"), F.transform("d", lambda x: x.cast("string"))).alias("value"))
    raise ValueError(f"unknown format {format!r}")


def _escaped(c):
    """Text with the characters that XML reserves written as entities."""
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graph_documents(nodes: DataFrame, edges: DataFrame, format: str = "graphml") -> DataFrame:
    """graph_id and ``value``, one GraphML or GEXF document of each graph; a graph's document is one row."""
    if format == "graphml":
        head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph id="%s" edgedefault="undirected">\n%s\n%s\n</graph>\n</graphml>'
        node, edge = '<node id="%s"/>', '<edge source="%s" target="%s"><data key="weight">%s</data></edge>'
    elif format == "gexf":
        head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph id="%s" defaultedgetype="undirected"><nodes>\n%s\n</nodes><edges>\n%s\n</edges></graph>\n</gexf>'
        node, edge = '<node id="%s"/>', '<edge source="%s" target="%s" weight="%s"/>'
    else:
        raise ValueError(f"unknown format {format!r}")
    text = lambda c: _escaped(F.col(c).cast("string"))
    lined = lambda rows, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, rows.alias("x")))), lambda s: s["x"]), "\n")
    points = nodes.groupBy("graph_id").agg(lined(F.format_string(node, text("node_id")), ["node_id"]).alias("n"))
    weight = F.coalesce(F.col("weight").cast("string"), F.lit("1.0")) if "weight" in edges.columns else F.lit("1.0")
    links = edges.groupBy("graph_id").agg(lined(F.format_string(edge, text("src"), text("dst"), weight), ["src", "dst"]).alias("e"))
    both = points.join(links, "graph_id", "left")
    return both.select("graph_id", F.format_string(head, text("graph_id"), "n", F.coalesce("e", F.lit(""))).alias("value"))


def save_grid_system(grid: DataFrame, matrix: DataFrame | None, about: dict, path: str) -> None:
    """A system on a grid: its points, its operator as (i, j, value), and a record of how it was made."""
    grid.write.mode("overwrite").parquet(f"{path}/grid")
    if matrix is not None:
        matrix.write.mode("overwrite").parquet(f"{path}/operator")
    write_json(grid.sparkSession, about, f"{path}/about")


def save_distances(distances: DataFrame, path: str) -> None:
    """Distances as rows of id_a, id_b, d, partitioned by method where there is one."""
    by = ["method"] if "method" in distances.columns else []
    distances.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """One small record as a JSON table of one row."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest(counts: dict[str, int], paths: dict[str, str], preset: str, note: str = "", commit: str | None = None) -> dict:
    return {"preset": preset, **counts, **paths, "note": note, "created_at": datetime.now(timezone.utc).isoformat(), "commit": commit}


def save_model(model, path: str, features: Sequence[str], metrics: dict | None = None) -> None:
    """A fitted pipeline, with its feature columns and metrics beside it."""
    from pyspark.sql import SparkSession as S

    model.write().overwrite().save(f"{path}/model")
    write_json(S.getActiveSession(), {"features": list(features), "metrics": metrics or {}}, f"{path}/about")


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return PipelineModel.load(f"{path}/model"), about["features"], about["metrics"]


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
