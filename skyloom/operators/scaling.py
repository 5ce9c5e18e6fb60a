"""Scaling, binning and derived features of catalogs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.coords import C_KM_S
from skyloom.operators.quantiles import quantiles
from skyloom.staging import running_sum


def _stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [f(c).alias(f"{n}__{c}") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("samp", F.stddev_samp), ("pop", F.stddev_pop))]
    return df.groupBy(*by).agg(*aggs)


def scale(df: DataFrame, columns: Sequence[str], method: str, by: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """Each of ``columns`` scaled over all rows, or over each group of ``by``.

    minmax (0.5 where constant), zscore (sample std; 0 where that is 0), standardize (population std; 0),
    robust (median and interquartile range), maxabs (centred, over the largest magnitude; 0). Statistics are one
    aggregate, joined back: one row to every row, or by group.
    """
    if method == "robust":
        quart = quantiles(df, columns, (0.25, 0.5, 0.75), by)
        joined = df.join(quart, list(by)) if by else df.join(F.broadcast(quart))
        made = {
            c + suffix: F.coalesce(F.try_divide(F.col(c) - F.get(f"q__{c}", F.lit(1)), F.get(f"q__{c}", F.lit(2)) - F.get(f"q__{c}", F.lit(0))), F.lit(0.0) * F.col(c))
            for c in columns
        }
        return joined.withColumns(made).drop(*[f"q__{c}" for c in columns])
    stats = _stats(df, columns, by)
    joined = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))

    def one(c: str) -> Column:
        v, get = F.col(c), lambda n: F.col(f"{n}__{c}")
        if method == "minmax":
            return F.when(get("max") > get("min"), (v - get("min")) / (get("max") - get("min"))).when(v.isNotNull(), F.lit(0.5))
        if method in ("zscore", "standardize"):
            std = get("samp" if method == "zscore" else "pop")
            return F.when(std > 0, (v - get("avg")) / std).when(v.isNotNull(), F.lit(0.0))
        if method == "maxabs":
            most = F.greatest(F.abs(get("max") - get("avg")), F.abs(get("min") - get("avg")))
            return F.when(most > 0, (v - get("avg")) / most).when(v.isNotNull(), F.lit(0.0))
        raise ValueError(f"unknown scaling {method!r}")

    return joined.withColumns({c + suffix: one(c) for c in columns}).select(
        *[c for c in df.columns if not (suffix == "" and c in columns)], *[c + suffix for c in columns]
    )


def equal_bin(v: Column, low: Column, high: Column, n: int) -> Column:
    """0 .. n-1 of ``n`` equal, right-open bins on [low, high]; the last is closed, values outside are null."""
    at = F.floor(F.try_divide(v - low, high - low) * n)
    return F.when((v >= low) & (v <= high), F.least(F.coalesce(at, F.lit(0)), F.lit(n - 1))).cast("long")


def labelled_bin(v: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the right-open interval that ``v`` lies in, else null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((v >= low) & (v < high), F.lit(label)).otherwise(out)
    return out


REDSHIFT_EDGES = (0.0, 0.1, 0.5, 1.0, 2.0, 10.0)
REDSHIFT_LABELS = ("nearby", "intermediate", "distant", "high_z", "extreme")


def normalize_points(df: DataFrame, mags: Sequence[str] = ()) -> DataFrame:
    """Normalized columns beside the raw ones: angles to [0, 1] and sines, log redshift, scaled magnitudes, distances."""
    out = df
    if "ra" in df.columns:
        ra = F.col("ra")
        out = out.withColumns({"ra_norm": ra / 360.0, "ra_sin": F.sin(F.radians(ra)), "ra_cos": F.cos(F.radians(ra))})
    if "dec" in df.columns:
        dec = F.col("dec")
        out = out.withColumns({"dec_norm": (dec + 90.0) / 180.0, "dec_sin": F.sin(F.radians(dec)), "dec_cos": F.cos(F.radians(dec))})
    if "redshift" in df.columns:
        out = scale(out.withColumn("redshift_log", F.log10(F.col("redshift") + 0.001)), ["redshift"], "minmax", suffix="_minmax")
    if mags:
        out = scale(scale(out, mags, "zscore", suffix="_zscore"), mags, "minmax", suffix="_minmax")
    if {"X", "Y", "Z"} <= set(df.columns):
        out = scale(out, ["X", "Y", "Z"], "maxabs", suffix="_norm")
        d = F.sqrt(F.col("X") ** 2 + F.col("Y") ** 2 + F.col("Z") ** 2)
        out = out.withColumn("distance_3d", d).withColumn("distance_log", F.log10(d + 1))
    return out


def _cut(columns: dict[str, int]) -> dict[str, Column]:
    """For each column its cell of so many equal parts of the table's range, from its min__ and max__ columns."""
    return {c: equal_bin(F.col(c), F.col(f"min__{c}"), F.col(f"max__{c}"), n) for c, n in columns.items()}


def engineer_features(df: DataFrame, mags: Sequence[str] = (), source: str = "catalog_source", grid: int = 10) -> DataFrame:
    """Derived features of a catalog, as far as its columns go.

    Colours of each pair of magnitudes in their order; redshift classes (right-open) and 20 equal bins, recession
    velocity; 36 by 18 cells of the table's range of the sky; distance and 20 equal shells of it; mean, sample std and count by ``source`` of
    redshift, ra, dec and magnitudes; ratio and product of redshift with the first two magnitudes; cells of ``grid``
    parts an axis and how many points each holds. Bounds, statistics of the few sources and counts of cells are aggregates
    that are sent to the rows, so no row is moved to the others of its source or cell.
    """
    have = set(df.columns)
    cols = {f"color_{a.split('_')[-1]}_{b.split('_')[-1]}": F.col(a) - F.col(b) for a, b in combinations(mags, 2)}
    bounded: dict[str, int] = {}
    if "redshift" in have:
        cols |= {"redshift_bin_coarse": labelled_bin(F.col("redshift"), REDSHIFT_EDGES, REDSHIFT_LABELS), "velocity_recession_kms": F.col("redshift") * C_KM_S}
        bounded["redshift"] = 20
        for m in list(mags)[:2]:
            cols |= {f"{m}_div_redshift": F.col(m) / (F.col("redshift") + 0.001), f"{m}_mul_redshift": F.col(m) * F.col("redshift")}
    if "dec" in have:
        cols["galactic_latitude_approx"] = 90 - F.abs(F.col("dec"))
    if {"ra", "dec"} <= have:
        bounded |= {"ra": 36, "dec": 18}
    if {"X", "Y", "Z"} <= have:
        cols["distance_3d"] = F.sqrt(F.col("X") ** 2 + F.col("Y") ** 2 + F.col("Z") ** 2)
        bounded |= {"X": grid, "Y": grid, "Z": grid}
    out = df.withColumns(cols)
    if "distance_3d" in out.columns:
        bounded["distance_3d"] = 20
    if bounded:
        bounds = out.agg(*[f(c).alias(f"{n}__{c}") for c in bounded for n, f in (("min", F.min), ("max", F.max))])
        out = out.join(F.broadcast(bounds))
        cell, made = _cut(bounded), {}
        if "redshift" in bounded:
            made["redshift_bin_fine"] = cell["redshift"]
        if "ra" in bounded:
            made |= {"sky_region_ra_bin": cell["ra"], "sky_region_dec_bin": cell["dec"], "sky_region_id": cell["ra"] * 18 + cell["dec"]}
        if "distance_3d" in bounded:
            made["volume_shell_bin"] = cell["distance_3d"]
        if "X" in bounded:
            made["grid_cell_id"] = cell["X"] * grid * grid + cell["Y"] * grid + cell["Z"]
        out = out.withColumns(made).drop(*bounds.columns)
    if "X" in bounded:
        if "redshift" in have:
            out = out.withColumn("angular_diameter_distance_mpc", F.col("distance_3d"))
        cells = out.groupBy("grid_cell_id").agg(F.count(F.lit(1)).alias("local_density_grid_approx"))
        out = out.join(F.broadcast(cells), "grid_cell_id", "left")
    if source in have:
        wanted = [c for c in ("redshift", "ra", "dec", *mags) if c in have]
        stats = df.groupBy(source).agg(*[
            f(c).alias(f"{c}_src_{n}") for c in wanted for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))
        ])
        out = out.join(F.broadcast(stats), source, "left")
    return out


def attach_cell_counts(df: DataFrame, cell: str, out: str) -> DataFrame:
    """The number of rows in each row's cell, on every row; counts are summed before they are joined back."""
    return df.join(df.groupBy(cell).agg(F.count(F.lit(1)).alias(out)), cell, "left")


def attach_group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample std and count of ``value`` in the row's group, on every row."""
    stats = df.groupBy(key).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"), F.count(value).alias(f"{value}_count"))
    return df.join(stats, key, "left")


def scale_weights(edges: DataFrame, method: str, weight: str = "weight", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Edge weights of each ``graph_id``: minmax, standardize, max, or range to [low, high].

    A missing weight counts as 1. Where the range, deviation or maximum is 0 weights stay, but for ``range``,
    which puts them at its middle.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    stats = edges.groupBy("graph_id").agg(F.min(w).alias("_a"), F.max(w).alias("_b"), F.avg(w).alias("_m"), F.stddev_pop(w).alias("_s"))
    a, b = F.col("_a"), F.col("_b")
    new = {
        "minmax": F.when(b > a, (w - a) / (b - a)).otherwise(w),
        "standardize": F.when(F.col("_s") > 0, (w - F.col("_m")) / F.col("_s")).otherwise(w),
        "max": F.when(b != 0, w / b).otherwise(w),
        "range": F.when(b > a, low + (w - a) / (b - a) * (high - low)).otherwise(F.lit((low + high) / 2)),
    }[method]
    return edges.join(stats, "graph_id").withColumn(weight, new).select(*edges.columns)


def normalize_coordinates(nodes: DataFrame, axes: Sequence[str] = ("x", "y", "z"), method: str = "unit_cube") -> DataFrame:
    """Coordinates of each ``graph_id``: unit_cube (range 0 counts as 1), unit_sphere or standardize."""
    aggs = [f(c).alias(f"{n}__{c}") for c in axes for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))]
    joined = nodes.join(nodes.groupBy("graph_id").agg(*aggs), "graph_id")
    if method == "unit_cube":
        span = {c: F.col(f"max__{c}") - F.col(f"min__{c}") for c in axes}
        made = {c: (F.col(c) - F.col(f"min__{c}")) / F.when(span[c] > 0, span[c]).otherwise(1.0) for c in axes}
    elif method == "standardize":
        made = {c: (F.col(c) - F.col(f"avg__{c}")) / F.when(F.col(f"std__{c}") > 0, F.col(f"std__{c}")).otherwise(1.0) for c in axes}
    elif method == "unit_sphere":
        centred = joined.withColumns({c: F.col(c) - F.col(f"avg__{c}") for c in axes})
        norm = F.sqrt(sum((F.col(c) ** 2 for c in axes), F.lit(0.0)))
        most = centred.groupBy("graph_id").agg(F.max(norm).alias("_r"))
        return centred.join(most, "graph_id").withColumns({c: F.col(c) / F.when(F.col("_r") > 0, F.col("_r")).otherwise(1.0) for c in axes}).select(*nodes.columns)
    else:
        raise ValueError(f"unknown method {method!r}")
    return joined.withColumns(made).select(*nodes.columns)


def encode_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """0, 1, ... in the ascending order of the distinct values, null of null. Ranges of values are counted on from each other."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = running_sum(values, [column], F.lit(1), out).withColumn(out, F.col(out).cast("long"))
    return df.join(codes, column, "left")


def mapped(values: Mapping[str, str], c: Column, default: str | None = None) -> Column:
    """A small lookup as an expression."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.lit(default))
