"""Paths in graphs larger than a task: searches from many sources at once, each step a join of the frontier with the links.

A row is a source and a node it has reached. A step joins and compares no more than the last two levels (or buckets): a node
beside one of level L is of level L-1, L or L+1. Levels are tables of the staging folder, so a lost executor repeats one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.staging import freed, stored

#: Sources of a graph, about, that are searched from at a time where all nodes are sources.
SOURCES = 256

_SEEN = ["graph_id", "source", "node_id"]


def two_way_links(edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, other, w)`` both ways, the least weight of parallel edges, no loops; stored."""
    ends = F.array(*[F.struct(F.col(a).alias("node_id"), F.col(b).alias("other")) for a, b in (("src", "dst"), ("dst", "src"))])
    both = edges.filter("src <> dst").select("graph_id", F.explode(ends).alias("e"), F.col("weight").cast("double").alias("w"))
    return stored(both.groupBy("graph_id", "e.node_id", "e.other").agg(F.min("w").alias("w")), "links")


def chosen(nodes: DataFrame, sample: int | None, seed: int = 42) -> DataFrame:
    """``(graph_id, source)``: the ``sample`` nodes of each graph that come first by the crc32 of graph, node and seed, or all."""
    if sample is None:
        return nodes.select("graph_id", F.col("node_id").alias("source"))
    key = F.crc32(F.concat_ws(":", F.col("graph_id").cast("string"), F.col("node_id").cast("string"), F.lit(str(seed))).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("_key", "node_id"))
    ranked = nodes.select("graph_id", "node_id", key.alias("_key")).withColumn("_rank", rank).filter(F.col("_rank") <= sample)
    return ranked.select("graph_id", F.col("node_id").alias("source"))


def dealt(nodes: DataFrame, sample: int | None, seed: int = 42) -> Iterator[DataFrame]:
    """Tables of sources one after another: the ``chosen`` ones, or all nodes, some ``SOURCES`` of a graph at a time."""
    if sample is not None:
        yield chosen(nodes, sample, seed)
        return
    parts = max(1, -(-(_counts(nodes).agg(F.max("n")).first()[0] or 0) // SOURCES))
    for part in range(parts):
        yield chosen(nodes.filter(F.pmod(F.xxhash64("node_id"), F.lit(parts)) == part), None)


def _added(sums: DataFrame | None, more: DataFrame, keys: list[str]) -> DataFrame:
    """``sums`` and ``more`` added up by ``keys``, stored."""
    every = more if sums is None else sums.unionByName(more)
    out = stored(every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in more.columns if c not in keys]), "sums")
    if sums is not None:
        freed(sums)
    return out


def levels(links: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Nodes ``(graph_id, source, node_id, ways)`` of each number of hops from their source; ways counts the shortest paths."""
    out = [stored(sources.select("graph_id", "source", F.col("source").alias("node_id"), F.lit(1.0).alias("ways")), "level")]
    while True:
        met = out[-1].join(links, ["graph_id", "node_id"]).groupBy("graph_id", "source", F.col("other").alias("node_id")).agg(F.sum("ways").alias("ways"))
        for seen in out[-2:]:
            met = met.join(seen.select(*_SEEN), _SEEN, "left_anti")
        further = stored(met, "level")
        if not further.take(1):
            freed(further)
            return out
        out.append(further)


def hops(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``(graph_id, source, node_id, hops)`` of every node that a source reaches, itself included."""
    found = levels(links, sources)
    out = None
    for n, level in enumerate(found):
        level = level.select(*_SEEN, F.lit(n).cast("long").alias("hops"))
        out = level if out is None else out.unionByName(level)
    return out


def settled_lengths(links: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Tables ``(graph_id, source, node_id, d)`` of least sums of weights, by delta-stepping; weights may not be negative.

    A bucket is as wide as the largest weight. The nodes of the nearest bucket are relaxed until none of them
    gets nearer, then they are settled; a candidate can be a settled node of the bucket before alone.
    """
    wide = links.agg(F.max("w"), F.min("w")).first()
    if wide[1] is not None and wide[1] < 0:
        raise ValueError("weights may not be negative")
    delta = wide[0] or 1.0
    settled: list[DataFrame] = []
    open_ = stored(sources.select("graph_id", "source", F.col("source").alias("node_id"), F.lit(0.0).alias("d"), F.lit(True).alias("moved")), "open")
    while True:
        nearest = open_.agg(F.min("d")).first()[0]
        if nearest is None:
            break
        end = (int(nearest / delta) + 1) * delta
        if end <= nearest:  # by rounding
            end = nearest + delta
        while True:
            active = open_.filter(F.col("moved") & (F.col("d") < end))
            met = active.join(links, ["graph_id", "node_id"])
            met = met.groupBy("graph_id", "source", F.col("other").alias("node_id")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
            if settled:
                met = met.join(settled[-1].select(*_SEEN), _SEEN, "left_anti")
            rest = open_.withColumn("old", F.col("d")).withColumn("moved", F.col("moved") & (F.col("d") >= end))
            every = rest.unionByName(met.withColumn("old", F.lit(None).cast("double")).withColumn("moved", F.lit(False)))
            merged = every.groupBy(*_SEEN).agg(F.min("d").alias("d"), F.min("old").alias("old"), F.max("moved").alias("moved"))
            nearer = F.col("old").isNull() | (F.col("d") < F.col("old"))
            new = stored(merged.select(*_SEEN, "d", (F.col("moved") | nearer).alias("moved")), "open")
            freed(open_)
            open_ = new
            if not open_.filter(F.col("moved") & (F.col("d") < end)).take(1):
                break
        settled.append(stored(open_.filter(F.col("d") < end).select(*_SEEN, "d"), "settled"))
        rest = stored(open_.filter(F.col("d") >= end), "open")
        freed(open_)
        open_ = rest
    freed(open_)
    return settled


def lengths(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``(graph_id, source, node_id, d)``: least sums of weights; weights may not be negative."""
    out = sources.select("graph_id", "source", F.col("source").alias("node_id"), F.lit(0.0).alias("d")).limit(0)
    for s in settled_lengths(links, sources):
        out = out.unionByName(s)
    return out


def dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``(graph_id, node_id, total)``: Brandes' dependencies of the sources on each node between, added up."""
    found = levels(links, sources)
    depend, out = found[-1].withColumn("dep", F.lit(0.0)), None
    for level in reversed(found[:-1]):
        share = depend.select(*_SEEN, ((1.0 + F.col("dep")) / F.col("ways")).alias("share"))
        back = share.join(links, ["graph_id", "node_id"]).groupBy("graph_id", "source", F.col("other").alias("node_id")).agg(F.sum("share").alias("share"))
        depend = stored(level.join(back, _SEEN, "left").select(*_SEEN, "ways", (F.col("ways") * F.coalesce("share", F.lit(0.0))).alias("dep")), "depend")
        out = depend if out is None else out.unionByName(depend)
    if out is None:
        return found[0].select("graph_id", "node_id", F.lit(0.0).alias("total")).limit(0)
    return out.filter("node_id <> source").groupBy("graph_id", "node_id").agg(F.sum("dep").alias("total"))


def _counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n"))


def path_features(nodes: DataFrame, edges: DataFrame, sample: int | None, seed: int) -> DataFrame:
    """graph_id, path_mean, diameter of each graph's largest component."""
    from skyloom.operators.graphs import largest_component

    inside = stored(largest_component(nodes, edges).select("graph_id", "node_id"), "inside")
    found = hops(two_way_links(edges), chosen(inside, sample, seed)).filter("hops > 0")
    got = found.groupBy("graph_id").agg(F.avg("hops").alias("path_mean"), F.max("hops").alias("diameter"))
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    return _counts(nodes).join(got, "graph_id", "left").select("graph_id", zero("path_mean", "double"), zero("diameter", "long"))


def weighted_path_mean(nodes: DataFrame, edges: DataFrame, sample: int | None, seed: int) -> DataFrame:
    """graph_id, weighted_path_mean over what the sources reach at a length above zero."""
    links, out = two_way_links(edges), None
    for sources in dealt(nodes, sample, seed):
        found = settled_lengths(links, sources)
        for s in found:
            out = _added(out, s.filter("d > 0").groupBy("graph_id").agg(F.sum("d").alias("total"), F.count("*").alias("many")), ["graph_id"])
        freed(*found)
    got = nodes.select("graph_id", F.lit(0.0).alias("total"), F.lit(0).alias("many")).limit(0) if out is None else out
    return _counts(nodes).join(got, "graph_id", "left").select("graph_id", F.try_divide("total", "many").alias("weighted_path_mean"))


def hop_lengths(nodes: DataFrame, edges: DataFrame, sample: int | None, seed: int) -> DataFrame:
    """graph_id, value, n: pairs by their hops."""
    links, out = two_way_links(edges), None
    for sources in dealt(nodes, sample, seed):
        found = levels(links, sources)
        some = [level.groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(float(n)).alias("value"), "n") for n, level in enumerate(found[1:], 1)]
        if some:
            out = _added(out, reduce(DataFrame.unionByName, some), ["graph_id", "value"])
        freed(*found)
    return nodes.select("graph_id", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n")).limit(0) if out is None else out


def betweenness(nodes: DataFrame, edges: DataFrame, sample: int | None, seed: int) -> DataFrame:
    """graph_id, node_id, betweenness of every node, scaled up from the sources to all nodes."""
    total = dependencies(two_way_links(edges), chosen(nodes, sample, seed))
    n = F.col("n").cast("double")
    picked = n if sample is None else F.least(n, F.lit(float(sample)))
    scale: Column = F.when(F.col("n") > 2, n / picked / ((n - 1) * (n - 2))).otherwise(0.0)
    held = nodes.select("graph_id", "node_id").join(_counts(nodes), "graph_id").join(total, ["graph_id", "node_id"], "left")
    return held.select("graph_id", "node_id", (F.coalesce("total", F.lit(0.0)) * scale).alias("betweenness"))


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, closeness within what a node reaches; every node is a source, some ``SOURCES`` a graph at a time."""
    links, out = two_way_links(edges), None
    for sources in dealt(nodes, None):
        found = levels(links, sources)
        part_sums = None
        for n, level in enumerate(found[1:], 1):
            sums = level.groupBy("graph_id", "source").agg(F.count("*").alias("near"), (F.count("*") * n).alias("sums"))
            part_sums = sums if part_sums is None else part_sums.unionByName(sums)
        if part_sums is not None:
            kept = stored(part_sums.groupBy("graph_id", F.col("source").alias("node_id")).agg(F.sum("near").alias("near"), F.sum("sums").alias("sums")), "close")
            out = kept if out is None else out.unionByName(kept)
        freed(*found)
    held = nodes.select("graph_id", "node_id").join(_counts(nodes), "graph_id")
    if out is None:
        return held.select("graph_id", "node_id", F.lit(0.0).alias("closeness"))
    value = F.col("near") / F.col("sums") * F.col("near") / F.greatest(F.col("n") - 1, F.lit(1))
    return held.join(out, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def centrality_features(nodes: DataFrame, edges: DataFrame, sample: int, seed: int) -> DataFrame:
    """Mean and maximum of betweenness and closeness of each graph."""
    between = betweenness(nodes, edges, sample, seed).groupBy("graph_id").agg(F.avg("betweenness").alias("betweenness_mean"), F.max("betweenness").alias("betweenness_max"))
    close = closeness(nodes, edges).groupBy("graph_id").agg(F.avg("closeness").alias("closeness_mean"), F.max("closeness").alias("closeness_max"))
    return between.join(close, "graph_id")
