"""Presets and experiments: points to graphs to features to distances and models, each step a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.coords import add_cartesian
from skyloom.operators import columns as C
from skyloom.operators import distances as D
from skyloom.operators import learning as M
from skyloom.operators import neighbors as N
from skyloom.operators import paths as P
from skyloom.operators import relational as R
from skyloom.operators import sampling as S
from skyloom.operators import spectral as Q
from skyloom.operators import topology as T
from skyloom.staging import stored


@dataclass(frozen=True)
class Preset:
    """A region and redshift box of the sky, and how graphs are cut out of it; ValueError for impossible bounds."""

    name: str
    ra: tuple[float, float] = (0.0, 360.0)
    dec: tuple[float, float] = (-90.0, 90.0)
    z: tuple[float, float] = (0.0, 10.0)
    points: int = 500_000
    side: float = 200.0
    n_graphs: int = 500
    k: int = 12
    least: int = 800
    most: int = 4000
    seed: int = 42

    def __post_init__(self):
        for name in ("ra", "dec", "z"):
            low, high = getattr(self, name)
            if not low < high:
                raise ValueError(f"{name}: {low} is not below {high}")
        if min(self.points, self.n_graphs, self.k, self.least) < 1 or self.most < self.least or self.side <= 0:
            raise ValueError("sizes must be positive, and the most points not below the least")

    @classmethod
    def of(cls, name: str, values: Mapping) -> Preset:
        known = {f.name for f in fields(cls)}
        return cls(name, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known and k != "name"})


@dataclass(frozen=True)
class Experiment:
    """What an experiment computes of its graphs."""

    features: Sequence[str] = ("topology", "spectral", "paths")
    distances: Sequence[str] = ("spectral",)
    eigenvalues: int = 30
    paths_sample: int = 200
    max_pairs: int | None = 1000
    tags: Sequence[str] = field(default_factory=tuple)


def ingest(raw: Mapping[str, DataFrame], preset: Preset, columns: Mapping[str, Sequence[str]]) -> tuple[DataFrame, dict[str, int]]:
    """Points of every source in one schema, cut to the preset's box and to equal numbers; and counts before and after."""
    tables, counts = {}, {}
    for name, df in raw.items():
        found = C.select_resolved(df, columns) if columns else df
        if "weight" not in found.columns:
            found = found.withColumn("weight", F.lit(1.0))
        cut = C.basic_filter(found, preset.ra, preset.dec, preset.z)
        placed = add_cartesian(cut).withColumns({"source": F.lit(name), "sample": F.lit(preset.name)})
        tables[name] = placed.select("source", "sample", "obj_id", "ra_deg", "dec_deg", "z", "x_mpc", "y_mpc", "z_mpc", "weight")
        counts[f"{name}_raw"], counts[f"{name}_cut"] = df.count(), tables[name].count()
    n = min([preset.points, *(counts[f"{name}_cut"] for name in raw)])
    if not n:
        raise ValueError("no point of some source is in the box")
    counts["n"] = n
    return R.union_all(*[S.sample_n(t, n, "obj_id", preset.seed) for t in tables.values()]), counts


def build_graphs(points: DataFrame, preset: Preset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, registry of the preset's windows in every source."""
    every = None
    for (source,) in points.select("source").distinct().collect():
        found = S.sample_windows(points.filter(F.col("source") == source), preset.n_graphs, preset.side, "obj_id", least=preset.least, most=preset.most, seed=preset.seed)
        found = found.withColumn("graph_id", F.concat_ws("_", F.lit(preset.name), F.lit(source), F.col("graph_id").cast("string")))
        every = found if every is None else every.unionByName(found)
    nodes = every.select("graph_id", F.col("obj_id").alias("node_id"), F.col("x_mpc").alias("x"), F.col("y_mpc").alias("y"), F.col("z_mpc").alias("z"), "source", "center_x", "center_y", "center_z")
    nodes = stored(nodes, "nodes")
    edges = stored(N.knn_edges(nodes, preset.k), "edges")
    registry = nodes.groupBy("graph_id", "source").agg(F.count(F.lit(1)).alias("n_nodes"), *[F.first(f"center_{c}").alias(f"center_{c}") for c in "xyz"])
    counted = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    registry = registry.join(counted, "graph_id", "left").na.fill(0, ["n_edges"]).withColumn("preset", F.lit(preset.name))
    return nodes, edges, registry


def feature_table(nodes: DataFrame, edges: DataFrame, what: Experiment) -> DataFrame:
    """One row a graph with the wanted features, eigenvalues as columns. Each family reads nodes and edges from the staging folder."""
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    out = nodes.select("graph_id").distinct()
    if "topology" in what.features:
        out = out.join(T.topology_features(nodes, edges), "graph_id", "left")
    if "paths" in what.features:
        out = out.join(P.weighted_path_mean(nodes, edges, what.paths_sample), "graph_id", "left")
    if "spectral" in what.features:
        spectra = Q.spectral_features(Q.spectrum(nodes, edges, what.eigenvalues))
        out = out.join(Q.expand(spectra, "eig", what.eigenvalues, "eig"), "graph_id", "left")
    return out


def graph_distances(nodes: DataFrame, edges: DataFrame, what: Experiment) -> DataFrame:
    """method, id_a, id_b, d of every wanted distance."""
    pairs = D.all_pairs(nodes.select(F.col("graph_id").alias("id")), what.max_pairs)
    made = {
        "spectral": lambda: D.spectral_distance(Q.spectrum(nodes, edges, what.eigenvalues), pairs, what.eigenvalues),
        "degree": lambda: D.degree_distance(nodes, edges, pairs), "clustering": lambda: D.clustering_distance(nodes, edges, pairs),
        "paths": lambda: D.path_length_distance(nodes, edges, pairs), "gromov_wasserstein": lambda: D.gromov_wasserstein(P.distance_matrices(nodes, edges), pairs),
    }
    return R.union_all(*[made[m]().select(F.lit(m).alias("method"), "id_a", "id_b", "d") for m in what.distances])


def expand_experiments(base: Experiment, ablate: bool = True, eigenvalues: Sequence[int] = ()) -> dict[str, Experiment]:
    """The base run, one run without each feature family, and one for each number of eigenvalues."""
    runs = {"baseline": base}
    if ablate:
        for f in base.features:
            runs[f"without_{f}"] = Experiment([x for x in base.features if x != f], base.distances, base.eigenvalues, base.paths_sample, base.max_pairs, base.tags)
    for k in eigenvalues:
        runs[f"eigenvalues_{k}"] = Experiment(base.features, base.distances, k, base.paths_sample, base.max_pairs, base.tags)
    return runs


@dataclass(frozen=True)
class GridRun:
    """A run of a grid: whether spectra are features, the neighbours of a node, how many eigenvalues."""

    name: str
    spectral: bool = True
    k: int = 12
    eigenvalues: int = 30


def plan_grid(config: Mapping) -> list[GridRun]:
    """The runs of a configuration: the baseline, its ablations, and one for each other number of neighbours and eigenvalues."""
    features, k = config["features"], config["cosmology"]["graph"].get("k_neighbors", 12)
    made = lambda name, f, k: GridRun(name, f.get("include_spectral", True), k, f.get("spectral_k", 30))
    more = config.get("experiments", {})
    runs = [made("baseline", features, k)]
    runs += [made(f"ablation_{a['name']}", {**features, **a.get("features", {})}, k) for a in more.get("ablations", [])]
    sensitivity = more.get("sensitivity", {})
    runs += [made(f"sensitivity_k_{x}", features, x) for x in sensitivity.get("k_neighbors", [])]
    return runs + [made(f"sensitivity_eigs_{x}", {**features, "spectral_k": x}, k) for x in sensitivity.get("spectral_k", [])]


def run_grid(nodes: DataFrame, label: str, columns: Sequence[str], runs: Sequence[GridRun], test: float = 0.2, seed: int = 42) -> DataFrame:
    """run, accuracy, use_spectral, k_neighbors, n_features: a row a run.

    ``nodes`` (graph_id, node_id, x, y, z, ``columns``, a 0/1 ``label``) are told apart by a logistic regression on ``columns`` and,
    in spectral runs, on the eigenvalues of the graph of each. Edges of a k, and spectra of a k and number, are made once.
    """
    edges: dict[int, DataFrame] = {}
    spectra: dict[tuple[int, int], DataFrame] = {}
    rows = []
    for r in runs:
        df, names = nodes, list(columns)
        if r.spectral:
            if r.k not in edges:
                edges[r.k] = stored(N.knn_edges(nodes, r.k), "edges")
            if (r.k, r.eigenvalues) not in spectra:
                found = Q.spectrum(nodes, edges[r.k], r.eigenvalues)
                spectra[r.k, r.eigenvalues] = stored(Q.expand(found, "eig", r.eigenvalues, "eig"), "spectra")
            eigen = spectra[r.k, r.eigenvalues]
            filled = eigen.na.fill(0.0)  # a graph of fewer nodes has fewer eigenvalues
            df = nodes.join(filled, "graph_id")
            names += [c for c in eigen.columns if c != "graph_id"]
        _, metrics = M.train_and_evaluate(df, "node_id", label, names, test, seed, ["logistic_regression"])
        rows.append(metrics.select(F.lit(r.name).alias("run"), "accuracy", F.lit(r.spectral).alias("use_spectral"), F.lit(r.k).alias("k_neighbors"), F.lit(len(names)).alias("n_features")))
    return R.union_all(*rows)


def corpus_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean nodes, edges, density and clustering over the graphs."""
    f = T.degree_features(nodes, edges).join(T.clustering_features(nodes, edges), "graph_id")
    return f.agg(F.count(F.lit(1)).alias("n_graphs"), *[F.avg(c).alias(f"{c}_mean") for c in ("n_nodes", "n_edges", "density", "clustering_mean")])
