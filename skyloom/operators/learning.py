"""Classification, regression and clustering of feature tables with Spark ML, and metrics as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.columns import fill_missing, finite_rows, numeric_columns
from skyloom.operators.metric import radius_counts, radius_forest
from skyloom.operators.sampling import exact_split, folds
from skyloom.operators.scaling import scale
from skyloom.staging import running_sum, stored

#: Models that are fitted at a time.
JOBS = 5


def prepare(df: DataFrame, key: str, label: str | None = None, features: Sequence[str] = (), missing: str = "mean", scaled: bool = False) -> tuple[DataFrame, list[str]]:
    """key, label, numeric features without nulls (imputed by ``missing``, or rows dropped), standardized if asked."""
    features = list(features) or numeric_columns(df, [c for c in (key, label) if c])
    kept = df.select(key, *([label] if label else []), *[F.col(c).cast("double") for c in features])
    kept = finite_rows(kept, features) if missing == "drop" else fill_missing(kept, features, missing)
    return (scale(kept, features, "standardize") if scaled else kept), features


def binary_label(c: Column, positive: str = "quantum") -> Column:
    return F.contains(F.lower(c), F.lit(positive)).cast("double")


def logistic(n: int, c: float = 1.0, iterations: int = 1000, label: str = "label"):
    """L2 with inverse strength ``c`` on ``n`` rows; features come standardized."""
    return LogisticRegression(labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-10)


def classifiers(n: int, seed: int = 42, label: str = "label") -> dict:
    return {
        "logistic_regression": logistic(n, label=label),
        "random_forest": RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=10, seed=seed),
        "gradient_boosting": GBTClassifier(labelCol=label, maxIter=100, stepSize=0.1, maxDepth=5, seed=seed),
    }


def ridge(n: int, label_std: float, alpha: float = 1.0, label: str = "label"):
    """Spark scales the penalty by the label's sample deviation, so that goes in here."""
    return LinearRegression(labelCol=label, regParam=alpha * label_std / n, elasticNetParam=0.0, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=500)


def regressors(n: int, label_std: float, seed: int = 42, label: str = "label") -> dict:
    return {
        "ridge": ridge(n, label_std, label=label),
        "random_forest": RandomForestRegressor(labelCol=label, numTrees=100, maxDepth=10, seed=seed),
        "gradient_boosting": GBTRegressor(labelCol=label, maxIter=100, stepSize=0.1, maxDepth=5, seed=seed),
        "linear": LinearRegression(labelCol=label, regParam=0.0),
    }


def fourier_features(df: DataFrame, features: Sequence[str], n: int = 64, gamma: float | None = None, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """``df`` with ``n`` columns whose inner products approach the kernel exp(-gamma |x - y|^2).

    A linear model of them stands for one with that kernel, and scales with the rows (Rahimi and Recht, 2007). ``gamma``
    is 1 over the number of features unless given; features come standardized.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    gamma = gamma or 1.0 / len(features)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (n, len(features))), rng.uniform(0, 2 * np.pi, n)
    made = {}
    for i in range(n):
        at = reduce(lambda x, y: x + y, [F.col(c) * float(v) for c, v in zip(features, w[i])])
        made[f"kernel_{i}"] = F.cos(at + float(b[i])) * (2.0 / n) ** 0.5
    return df.withColumns(made), list(made)


#: The kinds of ``named_model``; those with a kernel are linear models of ``fourier_features``.
MODEL_KINDS = ("random_forest", "linear", "svr", "random_forest_classifier", "logistic", "svc")


def named_model(kind: str, n: int, label: str = "label", seed: int = 42):
    """The estimator of a name of ``MODEL_KINDS``; ValueError for another. ``svr`` and ``svc`` go on ``fourier_features``."""
    made = {
        "random_forest": lambda: RandomForestRegressor(labelCol=label, numTrees=100, maxDepth=10, seed=seed),
        "linear": lambda: LinearRegression(labelCol=label, regParam=0.0),
        "svr": lambda: LinearRegression(labelCol=label, regParam=1.0 / n, elasticNetParam=0.0, loss="huber", maxIter=200),
        "random_forest_classifier": lambda: RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=10, seed=seed),
        "logistic": lambda: logistic(n, label=label),
        "svc": lambda: LinearSVC(labelCol=label, regParam=1.0 / n, maxIter=200),
    }
    if kind not in made:
        raise ValueError(f"unknown model {kind!r}; known: {MODEL_KINDS}")
    return made[kind]()


def assign_labels(table: DataFrame, clusters: DataFrame, key: str, cluster: str = "cluster", out: str = "cluster_label") -> DataFrame:
    """``table`` with each row's cluster by ``key``; null for rows that were not clustered, whatever the rows' order."""
    return table.join(clusters.select(key, F.col(cluster).alias(out)), key, "left")


def train(df: DataFrame, features: Sequence[str], estimators: Mapping) -> dict[str, PipelineModel]:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return {name: Pipeline(stages=[assembler, e]).fit(df) for name, e in estimators.items()}


def predict(model: PipelineModel, df: DataFrame, proba: bool = False) -> DataFrame:
    """``df`` with prediction, and probability of the positive class; ValueError where a model has none."""
    out = model.transform(df)
    if proba:
        if "probability" not in out.columns:
            raise ValueError("the model gives no probabilities")
        out = out.withColumn("proba", vector_to_array("probability")[1])
    return out.select(*df.columns, "prediction", *(["proba"] if proba else []))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", proba: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1 (0 where undefined), and roc_auc by ranks, exact with ties."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"), zero(F.try_divide(tp, tp + fp)).alias("precision"),
        zero(F.try_divide(tp, tp + fn)).alias("recall"), zero(F.try_divide(2.0 * tp, 2 * tp + fp + fn)).alias("f1"),
    )
    return out.join(roc_auc(df, label, proba)) if proba else out


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Chance that a positive outscores a negative, ties half. Equal scores are one row before ranks are summed."""
    by = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    summed = running_sum(by, [score], F.col("n"), "below")
    won = summed.select("p", "n", (F.col("p") * (F.col("below") + F.col("n") / 2)).alias("w"))
    return won.agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("n")).alias("roc_auc"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support of each class."""
    cells = df.groupBy(F.col(label).alias("class"), F.col(prediction).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    ends = cells.select("class", F.when(F.col("class") == F.col("other"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).alias("predicted")).unionByName(
        cells.select(F.col("other").alias("class"), F.lit(0).alias("hit"), F.lit(0).alias("support"), F.col("n").alias("predicted"))
    )
    g = ends.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    h = F.col("hit") * 1.0
    return g.select("class", zero(h, F.col("predicted")).alias("precision"), zero(h, F.col("support")).alias("recall"), zero(2 * h, F.col("support") + F.col("predicted")).alias("f1"), "support")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(mse, F.var_pop(label))).alias("r2"))


def cross_validate(df: DataFrame, features: Sequence[str], estimator, key: str, metric, k: int = 5, seed: int = 42) -> DataFrame:
    """cv_mean and cv_std (population) of ``metric``, a function of predictions to one named column, over ``k`` folds."""
    dealt = stored(folds(df, key, k, seed), "folds")
    scores = []
    for i in range(k):
        model = train(dealt.filter(F.col("fold") != i), features, {"m": estimator})["m"]
        scores.append(metric(model.transform(dealt.filter(F.col("fold") == i))))
    dealt.unpersist()
    every = reduce(lambda a, b: a.union(b), scores)
    return every.agg(F.avg(every.columns[0]).alias("cv_mean"), F.stddev_pop(every.columns[0]).alias("cv_std"))


def compare_models(models: Mapping[str, PipelineModel], test: DataFrame, metrics=classification_metrics) -> DataFrame:
    """A row a model."""
    rows = [metrics(m.transform(test)).withColumn("model", F.lit(name)) for name, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def train_and_evaluate(df: DataFrame, key: str, label: str, features: Sequence[str] = (), test: float = 0.2, seed: int = 42, kinds: Sequence[str] = ()) -> tuple[dict, DataFrame]:
    """Models of a stratified split and their metrics on its test part; all see scaled features. ``kinds`` of ``classifiers``, or all.

    The split is computed once and dealt evenly by ``key``, a part a core: few bytes are much work here, and every task of a
    forest sums up all nodes of a level, so more parts would be more to shuffle.
    """
    data, names = prepare(df, key, label, features)
    split = exact_split(scale(data, names, "standardize"), label, key, test, seed).withColumn("label", F.col(label).cast("double"))
    split = stored(split.repartition(df.sparkSession.sparkContext.defaultParallelism, key), "split")
    fit, held = split.filter(~F.col("is_test")), split.filter("is_test")
    models = train(fit, names, {k: e for k, e in classifiers(fit.count(), seed).items() if k in (kinds or k)})
    return models, compare_models(models, held)


def pairwise_features(table: DataFrame, pairs: DataFrame, features: Sequence[str], key: str = "graph_id", method: str = "difference", distances: DataFrame | None = None) -> DataFrame:
    """id_a, id_b, vector, similarity = 1 / (1 + d); d is given or the Euclidean distance of the features."""
    v = F.array(*[F.col(c).cast("double") for c in features])
    both = pairs.join(table.select(F.col(key).alias("id_a"), v.alias("x")), "id_a").join(table.select(F.col(key).alias("id_b"), v.alias("y")), "id_b")
    diff = F.zip_with("x", "y", lambda a, b: F.abs(a - b))
    product, mean = F.zip_with("x", "y", lambda a, b: a * b), F.zip_with("x", "y", lambda a, b: (a + b) / 2)
    made = {"difference": diff, "concat": F.concat("x", "y"), "product": product, "combined": F.concat(diff, product, mean)}[method]
    if distances is None:
        d = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, g: s + g * g))
        return both.select("id_a", "id_b", made.alias("vector"), (1 / (1 + d)).alias("similarity"))
    return both.join(distances, ["id_a", "id_b"]).select("id_a", "id_b", made.alias("vector"), (1 / (1 + F.col("d"))).alias("similarity"))


def together(jobs: Sequence[Callable]) -> list:
    """What each of ``jobs`` returns; Spark takes the tasks of several at a time, as those of one round are few and short."""
    with ThreadPoolExecutor(max_workers=max(1, min(JOBS, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, runs: int = 10, iterations: int = 300, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster``: the best of ``runs`` by cost, labels in the order of the centres."""
    data = stored(VectorAssembler(inputCols=list(features), outputCol="_v").transform(df), "points")
    fits = together([lambda i=i: KMeans(featuresCol="_v", predictionCol="_c", k=k, maxIter=iterations, seed=seed + i).fit(data) for i in range(runs)])
    best = min(fits, key=lambda m: m.summary.trainingCost)
    order = sorted(range(len(best.clusterCenters())), key=lambda i: tuple(best.clusterCenters()[i]))
    names = F.create_map(*[F.lit(x) for new, old in enumerate(order) for x in (old, new)])
    return best.transform(data).withColumn("cluster", F.element_at(names, F.col("_c"))).select(*df.columns, "cluster")


def dbscan(df: DataFrame, features: Sequence[str], key: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``df`` with ``cluster``: core points have ``min_samples`` points within ``eps``, themselves included; a border point
    joins the smallest core cluster in reach; noise is -1. Clusters are numbered by their smallest key. Blocks of points give
    counts, then links of core points that join as all pairs would; pairs in dense places are no rows."""
    from skyloom.operators.graphs import connected_components

    points = df.select(F.lit("p").alias("graph_id"), F.col(key).alias("node_id"), *features)
    near = stored(radius_counts(points, features, eps, min_samples - 1).select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "d"), "near")
    counts = points.select("node_id").join(near.groupBy("node_id").agg(F.sum("d").alias("count")), "node_id", "left").na.fill(0, ["count"])
    core = stored(counts.filter(F.col("count") + 1 >= min_samples).select("node_id"), "core")
    links = stored(radius_forest(points.join(core, "node_id", "left_semi"), features, eps), "links")
    labels = connected_components(core.select(F.lit("p").alias("graph_id"), "node_id"), links.select("graph_id", "src", "dst", F.lit(1.0).alias("weight"))).select("node_id", "component")
    # a point that is no core has all its neighbours as rows
    ends = near.filter("other is not null").select("node_id", "other")
    border = ends.join(core, "node_id", "left_anti").join(labels.withColumnRenamed("node_id", "other"), "other").groupBy("node_id").agg(F.min("component").alias("component"))
    every = labels.union(border)
    numbers = running_sum(labels.select("component").distinct(), ["component"], F.lit(1), "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    found = every.join(numbers, "component").select(F.col("node_id").alias(key), "cluster")
    return df.join(found, key, "left").na.fill(-1, ["cluster"])


#: Points of a block whose distances to those of another are added up in a task.
PAIR_BLOCK = 2048


def _distance_sums(data: DataFrame) -> DataFrame:
    """``(id, c, c2, s, k)``: the sum of the distances of each point of ``data`` (id, c, v) to cluster c2, and of how many others."""
    n = data.count()
    parts = max(1, -(-n // PAIR_BLOCK))
    # rows without an order of their own: equal ids may fall into one block
    dealt = stored(data.withColumn("_b", F.pmod(F.xxhash64("id", "c", "v"), F.lit(parts)).cast("int")), "blocks")
    # two blocks meet once, as the sums of both sides come from one matrix
    upper = F.explode(F.sequence(F.col("_b"), F.lit(parts - 1)))
    lower = F.explode(F.sequence(F.lit(0), F.col("_b")))
    left = dealt.select("id", "c", "v", F.col("_b").alias("i"), upper.alias("j"))
    right = dealt.select(F.col("id").alias("id"), F.col("c").alias("c"), F.col("v").alias("v"), F.col("_b").alias("j"), lower.alias("i"))
    kinds = dict(data.dtypes)

    def sums(key, a, b):
        import numpy as np
        import pandas as pd

        out = []
        if len(a) and len(b):
            x, y = (np.array(f["v"].tolist(), float).reshape(len(f), -1) for f in (a, b))
            middle = y.mean(0)
            x, y = x - middle, y - middle
            names = [np.unique(f["c"], return_inverse=True) for f in (a, b)]
            one, two = (np.eye(len(n))[at] for n, at in names)
            # |x|^2 + |y|^2 - 2xy as one product
            x2, y2 = (x * x).sum(1), (y * y).sum(1)
            wide = np.vstack([-2 * y.T, np.ones(len(y)), y2])
            to, back = np.zeros((len(x), two.shape[1])), np.zeros((len(y), one.shape[1]))
            for at in range(0, len(x), 128):
                d = np.hstack([x[at : at + 128], x2[at : at + 128, None], np.ones((len(x[at : at + 128]), 1))]) @ wide
                i, j = np.nonzero(d <= 1e-6 * (x2[at : at + 128, None] + y2))  # few digits are left of these
                d[i, j] = ((x[at + i] - y[j]) ** 2).sum(1)
                np.sqrt(d, out=d)
                to[at : at + 128] = d @ two
                back += d.T @ one[at : at + 128]
            for f, (own, _), s, k in ((a, names[1], to, two.sum(0)), (b, names[0], back, one.sum(0)))[: 1 if key[0] == key[1] else 2]:
                for c in range(s.shape[1]):
                    out.append(pd.DataFrame({"id": f["id"], "c": f["c"], "c2": own[c], "s": s[:, c], "k": int(k[c])}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "c", "c2", "s", "k"])

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(sums, f"id {kinds['id']}, c {kinds['c']}, c2 {kinds['c']}, s double, k long")
    summed = met.groupBy("id", "c", "c2").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    # a point is no neighbour of its own; alone in its cluster it has none there
    own = F.col("c") == F.col("c2")
    return summed.withColumn("k", F.when(own, F.col("k") - 1).otherwise(F.col("k"))).filter("k > 0")


def clustering_metrics(df: DataFrame, features: Sequence[str], key: str, cluster: str = "cluster") -> DataFrame:
    """silhouette (Euclidean), davies_bouldin, calinski_harabasz without noise; null with fewer than two clusters.

    The silhouette needs all distances: blocks of some ``PAIR_BLOCK`` points meet, and a task adds up the distances of each point
    of one to the clusters of the other, so no pair is a row, but the work grows with the square of the table.
    """
    data = df.filter(F.col(cluster) >= 0).select(F.col(key).alias("id"), F.col(cluster).alias("c"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    data = stored(data, "clustered")
    width = len(features)
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    sizes = data.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(width)]).alias("m"))
    mean = _distance_sums(data)
    ab = mean.groupBy("id", "c").agg(F.max(F.when(F.col("c") == F.col("c2"), F.col("s") / F.col("k"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("s") / F.col("k"))).alias("b"))
    sil = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    silhouette = ab.agg(F.avg(sil).alias("silhouette"))
    spread = data.join(sizes, "c").withColumn("d", dist("v", "m"))
    within = spread.groupBy("c", "n", "m").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"))
    pairs = within.select(F.col("c").alias("c1"), F.col("s").alias("s1"), F.col("m").alias("m1")).join(within.select(F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("m").alias("m2")), F.col("c1") != F.col("c2"))
    db = pairs.groupBy("c1").agg(F.max(F.try_divide(F.col("s1") + F.col("s2"), dist("m1", "m2"))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    total = data.agg(F.count(F.lit(1)).alias("n_all"), F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(width)]).alias("m_all"))
    ch = within.join(total).agg(F.sum(F.col("n") * F.pow(dist("m", "m_all"), F.lit(2))).alias("b_all"), F.sum("w").alias("w_all"), F.count(F.lit(1)).alias("k"), F.max("n_all").alias("n_all"))
    ch = ch.select("k", F.try_divide(F.col("b_all") * (F.col("n_all") - F.col("k")), F.col("w_all") * (F.col("k") - 1)).alias("calinski_harabasz"))
    found = silhouette.join(db).join(ch)
    return found.select(*[F.when(F.col("k") >= 2, F.col(c)).alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")])


def cluster_statistics(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("count"), *stats).orderBy(cluster)


def principal_components(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """pc_1 .. pc_k of standardized features; each component's largest loading is positive.

    Covariances are one aggregate row; its eigenvectors are constants of the projection.
    """
    import numpy as np

    z = scale(df, features, "standardize")
    row = z.agg(*[F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]).first()
    n = len(features)
    m = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    _, v = np.linalg.eigh(m)
    v = v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return z.withColumns({f"pc_{j + 1}": sum((F.col(c) * float(v[i, j]) for i, c in enumerate(features)), F.lit(0.0)) for j in range(v.shape[1])})


def cross_domain_distances(a: DataFrame, b: DataFrame, features: Sequence[str], key: str = "graph_id") -> DataFrame:
    """id_a, id_b, d: Euclidean distances of the two tables' rows after joint imputation and standardization.

    A row a pair, so the result grows with the product of the tables; nothing is shuffled and no task holds more than a part of each.
    """
    both = a.select(key, F.lit(0).alias("_side"), *features).unionByName(b.select(key, F.lit(1).alias("_side"), *features))
    z = scale(fill_missing(both, features, "mean"), features, "standardize")
    left = z.filter("_side = 0").select(F.col(key).alias("id_a"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(features)])
    right = z.filter("_side = 1").select(F.col(key).alias("id_b"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(features)])
    # plain columns: an array of each pair would be most of the time
    squares = [(F.col(f"x{i}") - F.col(f"y{i}")) * (F.col(f"x{i}") - F.col(f"y{i}")) for i in range(len(features))]
    return left.join(right).select("id_a", "id_b", F.sqrt(reduce(lambda s, g: s + g, squares, F.lit(0.0))).alias("d"))
