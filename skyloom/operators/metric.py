"""Neighbours in many dimensions: points are dealt to cells about pivots, and blocks of them meet only if a distance can be small.

Grids need 3^d cells about a point; cells about pivots need the triangle inequality alone. Pairs of blocks, not of points,
are rows of a plan, and the distances between two blocks are one matrix in a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from skyloom.operators.sparse import components
from skyloom.staging import stored

#: Points of a block, about: cells with more are cut into rings about their pivot, and rings into parts.
BLOCK = 512
#: Pivots of all groups together; groups have them by their size. They are sent to every task.
PIVOTS = 4096
#: Rounding of squared distances by matrix products, relative to the squared size of the coordinates.
SLACK = 1e-12
#: Points of a tile at most: blocks that meet in one task. Smaller tiles where there would be fewer than ``TASKS`` pairs of them.
TILE = 32768
TASKS = 256
#: Points that a block is compared with in one matrix.
STRIP = 8192

_BLOCK = "struct<c:int,ring:int,part:int>"


def distances(a: np.ndarray, b: np.ndarray, metric: str | float) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b``, by differences; ``metric`` may be the power of a Minkowski metric."""
    step = max(1, (1 << 22) // max(1, b.size))
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), step):
        gaps = np.abs(a[i : i + step, None, :] - b[None, :, :])
        if metric == "euclidean":
            out[i : i + step] = np.sqrt((gaps * gaps).sum(-1))
        elif metric == "manhattan":
            out[i : i + step] = gaps.sum(-1)
        elif metric == "chebyshev":
            out[i : i + step] = gaps.max(-1)
        else:
            out[i : i + step] = (gaps**metric).sum(-1) ** (1 / metric)
    return out


def _rough(a: np.ndarray, b: np.ndarray, metric: str | float) -> tuple[np.ndarray, float]:
    """Distances that may be off, and by how much at most."""
    if metric != "euclidean":
        return distances(a, b, metric), 0.0
    middle = b.mean(0)
    a, b = a - middle, b - middle
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    square = np.maximum(a2[:, None] + b2[None, :] - 2 * (a @ b.T), 0)
    return np.sqrt(square), float(np.sqrt(SLACK * ((a2.max() if len(a2) else 0) + b2.max())))


def nearest(a: np.ndarray, b: np.ndarray, metric: str | float, within: np.ndarray, k: int | None, b_ids: np.ndarray, same: bool = False):
    """Row, column and distance of the ``k`` nearest rows of ``b`` to each row of ``a``, or of all, ``within`` a distance of it.

    Ties go by ``b_ids``. With ``same`` the two are one, and a row is not its own neighbour. Matrix products choose
    the candidates, with room for their rounding; those alone are measured by differences.
    """
    rough, off = _rough(a, b, metric)
    if same:
        np.fill_diagonal(rough, np.inf)
    bound = within.astype(float)
    if k is not None and rough.shape[1] > k:
        bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((rough <= bound[:, None] + 2 * off) & np.isfinite(rough))
    if metric == "euclidean":
        d = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            gaps = a[i[at : at + (1 << 16)]] - b[j[at : at + (1 << 16)]]
            d[at : at + (1 << 16)] = np.sqrt((gaps * gaps).sum(-1))
    else:
        d = rough[i, j]
    kept = d <= within[i]
    i, j, d = i[kept], j[kept], d[kept]
    if k is not None:
        i, j, d = _first(i, j, d, k, b_ids)
    return i, j, d


def _halved(points: np.ndarray, middle: np.ndarray, size: float) -> np.ndarray:
    """Rows of half the digits, whose product with those of ``_strip`` is a squared distance in units of ``size``."""
    y = (points - middle) / size
    return np.hstack([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]]).astype(np.float32)


def _strip(a: np.ndarray, b: np.ndarray, halved: np.ndarray, middle: np.ndarray, size: float, within: np.ndarray, k: int, b_ids: np.ndarray):
    """As ``nearest`` of Euclidean distances, for many rows of ``b``: products of half the digits choose the candidates."""
    x = (a - middle) / size
    x2 = (x * x).sum(1)
    if x2.max() > 1e12:  # far from all of them
        return nearest(a, b, "euclidean", within, k, b_ids)
    one = np.hstack([-2 * x, x2[:, None], np.ones((len(x), 1))]).astype(np.float32)
    off = (a.shape[1] + 8) * 2.0**-23 * 4 * max(1.0, float(x2.max()))  # each product's rounding
    square = one @ halved.T
    bound = np.minimum((within / size) ** 2, 1e13)
    at = np.flatnonzero(square <= (bound * (1 + 1e-6) + off).astype(np.float32)[:, None])
    i, j, rough = at // len(b), at % len(b), square.ravel()[at]
    order = np.lexsort((rough, i))
    i, j, rough = i[order], j[order], rough[order]
    first = np.searchsorted(i, np.arange(len(a)))
    many = np.flatnonzero(np.bincount(i, minlength=len(a)) >= k)
    last = np.full(len(a), np.inf)
    last[many] = rough[first[many] + k - 1]
    kept = rough <= last[i] + 2 * off
    i, j = i[kept], j[kept]
    d = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        gaps = a[i[at : at + (1 << 16)]] - b[j[at : at + (1 << 16)]]
        d[at : at + (1 << 16)] = np.sqrt((gaps * gaps).sum(-1))
    kept = d <= within[i]
    return _first(i[kept], j[kept], d[kept], k, b_ids)


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int, b_ids: np.ndarray):
    """The ``k`` first of each row's candidates by distance and id."""
    order = np.lexsort((b_ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], d[kept]


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), float) if len(column) else np.zeros((0, 1))


def _schema(like: DataFrame, by: str, rest: str) -> StructType:
    key = like.schema["src"].dataType.simpleString()
    return StructType([StructField(by, like.schema[by].dataType), *_parse_datatype_string(rest.replace("{key}", key)).fields])


def _pivots(base: DataFrame, by: str, block: int) -> dict:
    """Pivots of each group of more than a block: points that come first by a hash, their number by the group's share of all.

    A group whose share is less than two pivots has none: its blocks are dealt by a hash, and all of them meet.
    """
    sizes = base.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    total = sizes.agg(F.sum("_n")).first()[0]
    if not total:
        return {}
    wanted = F.least(F.col("_n") / block, F.lit(float(PIVOTS)) * F.col("_n") / total)
    sizes = sizes.withColumn("_share", wanted / F.col("_n")).filter(wanted >= 2).select(F.col(by).alias("_of"), "_share")
    hashed = F.pmod(F.xxhash64("src", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = base.join(sizes, base[by].eqNullSafe(F.col("_of"))).filter(hashed < F.col("_share")).select(by, "v").collect()
    held: dict = {}
    for group, v in chosen:
        held.setdefault(group, []).append(v)
    return {g: np.unique(np.array(v, float), axis=0) for g, v in held.items()}


def _placed(base: DataFrame, by: str, pivots, metric, block: int) -> DataFrame:
    """``base`` with the block of each point and its distance ``r`` to the pivot of its cell."""
    schema = _schema(base, by, "src {key}, v array<double>, c int, r double")

    def assign(frames):
        for f in frames:
            f["c"], f["r"] = 0, 0.0
            for group, rows in f.groupby(by, dropna=False).indices.items():
                p = pivots.value.get(None if pd.isna(group) else group)
                if p is None:
                    continue
                x = _matrix(f["v"].iloc[rows])
                c = np.concatenate([_rough(x[i : i + 1024], p, metric)[0].argmin(1) for i in range(0, len(x), 1024)])
                r = np.concatenate([np.diagonal(distances(x[i : i + 64], p[c[i : i + 64]], metric)) for i in range(0, len(x), 64)])
                f.iloc[rows, f.columns.get_loc("c")], f.iloc[rows, f.columns.get_loc("r")] = c, r
            yield f.astype({"c": "int32"})

    cells = stored(base.mapInPandas(assign, schema), "cells")
    on = [by, "c"]

    def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        b = b.withColumnsRenamed({x: f"_{x}" for x in keys})
        return a.join(b, reduce(lambda p, q: p & q, [a[x].eqNullSafe(b[f"_{x}"]) for x in keys])).drop(*[f"_{x}" for x in keys])

    spans = cells.groupBy(*on).agg(F.count("*").alias("_m"), F.min("r").alias("_lo"), F.max("r").alias("_hi"))
    rings = F.ceil(F.col("_m") / block)
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("r") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    ringed = joined(cells, spans, on).withColumn("ring", F.least(F.floor(width * rings), rings - 1).cast("int")).drop("_m", "_lo", "_hi")
    parts = ringed.groupBy(*on, "ring").agg(F.ceil(F.count("*") / block).alias("_parts"))
    part = F.pmod(F.xxhash64("src"), F.col("_parts")).cast("int")
    dealt = joined(ringed, parts, [*on, "ring"]).withColumn("part", part)
    return stored(dealt.select(by, "src", "v", "r", F.struct("c", "ring", "part").cast(_BLOCK).alias("blk")), "blocks")


def _found(i, j, d, a_ids, b_ids, group, by, looked: int) -> pd.DataFrame:
    """Neighbours as rows, and one more row of a null neighbour with the number of pairs that were measured."""
    out = pd.DataFrame({by: [group] * (len(i) + 1), "src": np.append(a_ids[i], a_ids[:1]), "d": np.append(d, float(looked))})
    out["dst"] = pd.array(np.append(b_ids[j], b_ids[:1]), dtype="Int64" if b_ids.dtype.kind in "iu" else None)
    out.iloc[-1, out.columns.get_loc("dst")] = None
    return out[[by, "src", "dst", "d"]]


def _search(points: DataFrame, axes: Sequence[str], metric, by: str, key: str, k: int | None, radius: float | None, block: int, found=_found) -> DataFrame:
    """``(by, src, dst, d)`` of candidates that hold all wanted neighbours, and rows without ``dst`` that count pairs in ``d``.

    ``found(i, j, d, a_ids, b_ids, group, by, looked)`` makes the rows of two blocks, or of one (then ``b_ids`` is ``a_ids``) both ways.
    """
    v = F.array(*[F.col(a).cast("double") for a in axes])
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = stored(points.select(by, F.col(key).alias("src"), v.alias("v")).filter(whole), "points")
    sent = base.sparkSession.sparkContext.broadcast(_pivots(base, by, block))
    placed = _placed(base, by, sent, metric, block)
    packed_schema = _schema(placed, by, f"blk {_BLOCK}, n int, lo double, hi double, ids array<{{key}}>, v binary, r binary")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        r = f["r"].to_numpy(float)
        row = [f[by].iloc[0], f["blk"].iloc[0], len(f), r.min(), r.max(), f["src"].to_numpy(), _matrix(f["v"]).tobytes(), r.tobytes()]
        return pd.DataFrame([row], columns=packed_schema.names)

    # a row a block, which goes as bytes to the blocks that it meets
    blocks = stored(placed.groupBy(by, "blk").applyInPandas(pack, packed_schema), "packed")
    result = _schema(base, by, "src {key}, dst {key}, d double")
    reach = float("inf") if radius is None else float(radius)

    def own(frames):
        for f in frames:
            for row in f.to_dict("records"):
                x, ids = _points(row["v"], row["n"]), _ids(row["ids"])
                i, j, d = nearest(x, x, metric, np.full(len(x), reach), k, ids, same=True)
                yield found(i, j, d, ids, ids, None if pd.isna(row[by]) else row[by], by, len(x) * (len(x) - 1))

    first = stored(blocks.mapInPandas(own, result), "own")
    sizes = blocks.groupBy(by).agg(F.count("*").alias("_b"), F.sum("n").alias("_n")).filter("_b > 1")
    work = sizes.agg(F.sum(F.col("_n").cast("double") ** 2)).first()[0]
    if not work:
        return first
    tile = max(block, min(TILE, int((work / TASKS) ** 0.5)))

    def bounded(frames):
        """How far each point has to look: to its k-th neighbour so far, or to the radius."""
        for f in frames:
            kth = []
            for row in f.to_dict("records"):
                far = np.full(row["n"], reach)
                if radius is None:
                    x = _points(row["v"], row["n"])
                    i, _, d = nearest(x, x, metric, far, k, _ids(row["ids"]), same=True)
                    if len(x) > k:
                        far = d.reshape(len(x), k)[:, -1]
                kth.append(far.tobytes())
            yield f.assign(kth=kth)

    several = blocks.join(sizes.select(F.col(by).alias("_of"), "_b", "_n"), F.col(by).eqNullSafe(F.col("_of")))
    # blocks beside each other in a tile, in their order, so that of two blocks the first is in no later tile
    at = F.sum("n").over(Window.partitionBy(by).orderBy("blk")) - F.col("n")
    tiles = stored(several.select(by, "blk", "n").withColumn("tile", F.floor(at / tile).cast("int")).select(F.col(by).alias("_of"), "blk", "tile"), "tiles")
    more = stored(several.select(*packed_schema.names).mapInPandas(bounded, StructType([*packed_schema.fields, StructField("kth", BinaryType())])), "more")
    pairs = _block_pairs(more, blocks, by, sent, metric, symmetric=radius is not None)

    def between(keys, left: pd.DataFrame, right: pd.DataFrame):
        group = None if pd.isna(keys[0]) else keys[0]
        pivots, out = sent.value.get(group), []
        others = {_name(b["blk"]): (_points(b["v"], b["n"]), _ids(b["ids"]), np.frombuffer(b["r"]), b["lo"], b["hi"]) for b in right.to_dict("records")}
        middle = np.mean([y.mean(0) for y, *_ in others.values()], axis=0) if others else 0.0
        size = max((float(np.sqrt(((y - middle) ** 2).sum(1).max())) for y, *_ in others.values()), default=1.0) or 1.0
        halved: dict = {}
        for a in left.to_dict("records"):
            x, a_ids, within = _points(a["v"], a["n"]), _ids(a["ids"]), np.frombuffer(a["kth"]).copy()
            meets = sorted(map(_name, a["meets"]))
            away_from = {}
            if pivots is not None:
                rough, off = _rough(x, pivots[[b[0] for b in meets]], metric)
                away_from = dict(zip(meets, rough.T))
            # the nearest blocks first, as they shorten the way to the others
            meets.sort(key=lambda b: away_from[b].min() if away_from else 0.0)
            looked, held_i, held_id, held_d, strip = 0, [], [], [], []
            best = np.full((len(x), k or 0), np.inf)

            def keep(i, ids, d):
                if not len(i):
                    return
                held_i.append(i), held_id.append(ids), held_d.append(d)
                new = np.full((len(x), k), np.inf)
                new[i, np.arange(len(i)) - np.searchsorted(i, i)] = d
                best[:] = np.sort(np.hstack([best, new]), axis=1)[:, :k]
                np.minimum(within, best[:, -1], out=within)

            def flush():
                y, ids = np.concatenate([others[b][0] for b in strip]), np.concatenate([others[b][1] for b in strip])
                halved.update({b: _halved(others[b][0], middle, size) for b in strip if b not in halved})
                i, j, d = _strip(x, y, np.concatenate([halved[b] for b in strip]), middle, size, within, k, ids)
                keep(i, ids[j], d)
                strip.clear()
                return len(x) * len(y)

            for b in meets:
                y, b_ids, r, lo, hi = others[b]
                rows, columns = np.arange(len(x)), np.arange(len(y))
                if pivots is not None:
                    away = away_from[b]
                    far = within * (1 + 1e-9) + 2 * off
                    rows = np.flatnonzero(np.maximum(away - hi, lo - away) <= far)
                    if not len(rows):
                        continue
                    low, high = (away[rows] - far[rows]).min(), (away[rows] + far[rows]).max()
                    columns = np.flatnonzero((r >= low) & (r <= high))
                    if not len(columns):
                        continue
                # where little is left out, one product with all of several blocks takes less
                if k is not None and metric == "euclidean" and 2 * len(rows) * len(columns) >= len(x) * len(y):
                    strip.append(b)
                    if sum(len(others[b][1]) for b in strip) >= STRIP:
                        looked += flush()
                    continue
                looked += len(rows) * len(columns)
                i, j, d = nearest(x[rows], y[columns], metric, within[rows], k, b_ids[columns])
                if k is not None:
                    keep(rows[i], b_ids[columns[j]], d)
                else:
                    out.append(found(i, j, d, a_ids[rows], b_ids[columns], group, by, len(rows) * len(columns)))
            if strip:
                looked += flush()
            if k is not None and looked:
                i, d, ids = (np.concatenate(h) if h else np.zeros(0, t) for h, t in ((held_i, int), (held_d, float), (held_id, a_ids.dtype)))
                i, j, d = _first(i, np.arange(len(i)), d, k, ids)
                out.append(found(i, j, d, a_ids, ids if len(ids) else a_ids, group, by, looked))
        return pd.concat(out) if out else pd.DataFrame(columns=[by, "src", "dst", "d"])

    tile_of = lambda name: tiles.select(F.col("_of").alias(f"_of_{name}"), F.col("blk").alias(f"_blk_{name}"), F.col("tile").alias(f"t{name}"))
    met = pairs
    for name in ("a", "b"):
        of = tile_of(name)
        met = met.join(of, met["_of"].eqNullSafe(of[f"_of_{name}"]) & (met[name] == of[f"_blk_{name}"])).drop(f"_of_{name}", f"_blk_{name}")
    met = stored(met, "tiled")
    # a block goes once, under new names, to each pair of tiles in which it meets another
    ones = met.groupBy("_of", "ta", "tb", "a").agg(F.collect_list("b").alias("meets"))
    twos = met.select("_of", "ta", "tb", "b").distinct()
    left = more.join(ones, more[by].eqNullSafe(ones["_of"]) & (more["blk"] == ones["a"])).select(*[F.col(c).alias(c) for c in (by, "ta", "tb", "blk", "meets", "n", "ids", "v", "kth")])
    right = blocks.join(twos, blocks[by].eqNullSafe(twos["_of"]) & (blocks["blk"] == twos["b"])).select(*[F.col(c).alias(c) for c in (by, "ta", "tb", "blk", "n", "ids", "v", "r", "lo", "hi")])
    met = left.groupBy(by, "ta", "tb").cogroup(right.groupBy(by, "ta", "tb")).applyInPandas(between, result)
    return first.unionByName(stored(met, "met"))


def _points(v: bytes, n: int) -> np.ndarray:
    return np.frombuffer(v).reshape(n, -1)


def _ids(ids) -> np.ndarray:
    return np.asarray(ids)


def _name(blk) -> tuple[int, int, int]:
    return (blk["c"], blk["ring"], blk["part"]) if isinstance(blk, dict) else tuple(blk)


def _block_pairs(more: DataFrame, blocks: DataFrame, by: str, pivots, metric, symmetric: bool) -> DataFrame:
    """``(_of, a, b)``: blocks a whose points may have a neighbour in block b; one of both orders if ``symmetric``."""
    cells = blocks.groupBy(by, F.col("blk.c").alias("c")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    held: dict = {}
    # a row a pivot
    for r in cells.filter(F.col(by).isin([g for g in pivots.value if g is not None]) | F.lit(None in pivots.value) & F.col(by).isNull()).collect():
        held.setdefault(r[by], {})[r["c"]] = (r["lo"], r["hi"])
    spans = more.sparkSession.sparkContext.broadcast(held)
    schema = StructType([StructField(by, more.schema[by].dataType), *_parse_datatype_string(f"a {_BLOCK}, c int, low double, high double").fields])

    def reached(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                group = None if pd.isna(row[by]) else row[by]
                p, own = pivots.value.get(group), _name(row["blk"])
                if p is None:
                    out.append((group, own, 0, -np.inf, np.inf))
                    continue
                lo = np.array([spans.value[group].get(c, (np.inf, -np.inf))[0] for c in range(len(p))])
                hi = np.array([spans.value[group].get(c, (np.inf, -np.inf))[1] for c in range(len(p))])
                x, kth = _points(row["v"], row["n"]), np.frombuffer(row["kth"])
                for i in range(0, len(x), 512):
                    away, off = _rough(x[i : i + 512], p, metric)
                    far = kth[i : i + 512, None] * (1 + 1e-9) + 2 * off
                    # a cell's points are nearer to its pivot than to this point's, and between lo and hi from it
                    least = np.maximum(np.maximum(away - hi, lo - away), (away - away.min(1, keepdims=True)) / 2 - off)
                    near = least <= far
                    low, high = np.where(near, away - far, np.inf).min(0), np.where(near, away + far, -np.inf).max(0)
                    out.extend((group, own, int(c), low[c], high[c]) for c in np.flatnonzero(near.any(0)))
            yield pd.DataFrame(out, columns=[by, "a", "c", "low", "high"])

    reach = more.select(by, "blk", "n", "v", "kth").mapInPandas(reached, schema).groupBy(by, "a", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    b = blocks.select(F.col(by).alias("_of"), F.col("blk").alias("b"), F.col("blk.c").alias("_c"), "lo", "hi")
    meet = reach[by].eqNullSafe(b["_of"]) & (F.col("c") == F.col("_c")) & (F.col("hi") >= F.col("low")) & (F.col("lo") <= F.col("high"))
    pairs = reach.join(b, meet).filter(F.col("a") != F.col("b")).select("_of", "a", "b")
    if symmetric:
        pairs = pairs.select("_of", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(pairs, "pairs")


def metric_knn(points: DataFrame, k: int, axes: Sequence[str], metric: str | float = "euclidean", by: str = "graph_id", key: str = "node_id", block: int = BLOCK) -> DataFrame:
    """``(by, src, dst, d, rank)``: the ``k`` nearest others of each point in its group, ties by (d, dst); exact.

    Each point belongs to the cell of its nearest pivot; large cells are cut into rings about the pivot and those into
    parts, so a block holds about ``block`` points. A point meets its own block first. Its k-th distance there bounds how
    far it has to look, and two blocks meet if a point of one may have a nearer neighbour in the other: by the distance of
    the point to a pivot and the block's ring, and by half of what the pivot is farther than the point's own. A task
    measures two blocks. Points with a null or non-finite coordinate take no part; a null group is a group.
    """
    found = _search(points, axes, metric, by, key, k, None, block).filter("dst is not null")
    rank = F.row_number().over(Window.partitionBy(by, "src").orderBy("d", "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(by, "src", "dst", "d", "rank")


def metric_radius_pairs(points: DataFrame, axes: Sequence[str], radius: float, metric: str | float = "euclidean", by: str = "graph_id", key: str = "node_id", block: int = BLOCK) -> DataFrame:
    """``(by, src, dst, d)``, src < dst, of points within ``radius`` of each other in a group, by blocks as ``metric_knn``."""
    found = _search(points, axes, metric, by, key, None, radius, block).filter("dst is not null")
    return found.select(by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d").distinct()


def radius_counts(points: DataFrame, axes: Sequence[str], radius: float, least: int, by: str = "graph_id", key: str = "node_id", block: int = 2048) -> DataFrame:
    """``(by, src, dst, d)``: parts ``d`` of the number of others within ``radius`` of each point.

    A part of fewer than ``least`` is a row a neighbour, with ``dst``; a larger one is a row without. So a point of fewer than
    ``least`` neighbours has them all as rows, and pairs in dense places are none.
    """

    def counted(i, j, d, a_ids, b_ids, group, by, looked):
        own, out = a_ids[i] != b_ids[j], []
        i, j = i[own], j[own]
        for ids, at, others in ((a_ids, i, b_ids[j]), (b_ids, j, a_ids[i]))[: 1 if a_ids is b_ids else 2]:
            n = np.bincount(at, minlength=len(ids))
            many, few = n >= max(least, 1), n[at] < least
            out.append(pd.DataFrame({"src": ids[many], "dst": pd.array([None] * int(many.sum()), dtype=_pandas(ids)), "d": n[many].astype(float)}))
            out.append(pd.DataFrame({"src": ids[at[few]], "dst": pd.array(others[few], dtype=_pandas(ids)), "d": 1.0}))
        return pd.concat(out).assign(**{by: group})[[by, "src", "dst", "d"]]

    return _search(points, axes, "euclidean", by, key, None, radius, block, counted)


def radius_forest(points: DataFrame, axes: Sequence[str], radius: float, by: str = "graph_id", key: str = "node_id", block: int = 2048) -> DataFrame:
    """``(by, src, dst)``: links with the same components as all pairs within ``radius``, fewer for two blocks than they have points."""

    def linked(i, j, d, a_ids, b_ids, group, by, looked):
        shift = 0 if a_ids is b_ids else len(a_ids)
        ids = a_ids if a_ids is b_ids else np.concatenate([a_ids, b_ids])
        label = components(len(ids), i, j + shift)
        off = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"src": ids[off], "dst": pd.array(ids[label[off]], dtype=_pandas(ids)), "d": 0.0}).assign(**{by: group})[[by, "src", "dst", "d"]]

    return _search(points, axes, "euclidean", by, key, None, radius, block, linked).select(by, "src", "dst").filter("src <> dst")


def _pandas(ids: np.ndarray):
    return "Int64" if ids.dtype.kind in "iu" else None


def pairs_measured(points: DataFrame, k: int, axes: Sequence[str], metric: str | float = "euclidean", by: str = "graph_id", key: str = "node_id", block: int = BLOCK) -> int:
    """How many ordered pairs ``metric_knn`` measures on these points."""
    return int(_search(points, axes, metric, by, key, k, None, block).filter("dst is null").agg(F.sum("d")).first()[0] or 0)
