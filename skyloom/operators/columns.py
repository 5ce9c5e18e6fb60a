"""Resolving, normalizing, filtering and cleaning catalog columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.coords import add_cartesian, hubble_distance
from skyloom.operators.quantiles import row_of
from skyloom.staging import stored

POINTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("sample", T.StringType()),
        T.StructField("obj_id", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("ra_deg", "dec_deg", "z", "x_mpc", "y_mpc", "z_mpc", "weight")],
    ]
)
NUMERIC = (T.NumericType,)


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate among ``columns``, whatever its case."""
    lowered = {c.lower(): c for c in reversed(columns)}
    return next((lowered[c.lower()] for c in candidates if c.lower() in lowered), None)


def resolve_columns(columns: Sequence[str], mapping: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Target to the first of its candidates that exists; ValueError names what is missing and what there is."""
    found = {target: find_column(columns, names) for target, names in mapping.items()}
    missing = [target for target, name in found.items() if name is None]
    if missing:
        raise ValueError(f"no column for {missing}; available: {list(columns)[:200]}")
    return found


def select_resolved(df: DataFrame, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.select(*[F.col(src).alias(dst) for dst, src in resolve_columns(df.columns, mapping).items()])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def finite_or_null(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def normalize_catalog(
    df: DataFrame, source: str, vital: Mapping[str, Sequence[str]], optional: Mapping[str, Sequence[str]], id_column: str = "object_id"
) -> DataFrame:
    """Vital columns by candidates, optional ones or null, and ``catalog_source``; ids are made up if all are null.

    A missing vital column, the id's too, raises ValueError. A made-up id is the source and a hash of the row's values,
    and a number if rows are equal, so it does not change with how the table is dealt out.
    """
    resolved = resolve_columns(df.columns, {id_column: (id_column,), **vital})
    found = {k: v for k, v in resolved.items() if k != id_column}
    out = [F.col(src).cast("double").alias(dst) for dst, src in found.items()]
    for dst, names in optional.items():
        src = find_column(df.columns, names)
        out.append((F.col(src).cast("double") if src else F.lit(None).cast("double")).alias(dst))
    own = F.col(resolved[id_column]).cast("string")
    if df.filter(F.col(resolved[id_column]).isNotNull()).limit(1).count() or not df.limit(1).count():
        return df.select(own.alias(id_column), *out, F.lit(source).alias("catalog_source"))
    marked = df.withColumn("_hash", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    marked = marked.withColumn("_copy", F.row_number().over(Window.partitionBy("_hash").orderBy(F.lit(0))))
    made = F.concat_ws("_", F.lit(source.upper()), F.substring("_hash", 1, 32), F.when(F.col("_copy") > 1, F.col("_copy")))
    return marked.select(made.alias(id_column), *out, F.lit(source).alias("catalog_source"))


def rename_known(df: DataFrame, names: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Rename by a fixed map; several sources of one target are coalesced. Missing required columns raise."""
    targets: dict[str, list[str]] = {}
    for src, dst in names.items():
        if src in df.columns:
            targets.setdefault(dst, []).append(src)
    kept = [F.col(c) for c in df.columns if c not in names and c not in targets]
    made = [F.coalesce(*[F.col(c) for c in ([dst] if dst in df.columns else []) + srcs]).alias(dst) for dst, srcs in targets.items()]
    return require_columns(df.select(*kept, *made), required)


def in_range(c: str | Column, low=None, high=None) -> Column:
    """Inclusive bounds, each optional; null is out if a bound is given."""
    c = F.col(c) if isinstance(c, str) else c
    parts = ([c >= F.lit(low)] if low is not None else []) + ([c <= F.lit(high)] if high is not None else [])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_ranges(df: DataFrame, **bounds: tuple) -> DataFrame:
    """``filter_ranges(df, ra=(0, 10), z=(None, 2))``."""
    return df.filter(reduce(lambda a, b: a & b, [in_range(c, *b) for c, b in bounds.items()], F.lit(True)))


def basic_filter(df: DataFrame, ra: tuple, dec: tuple, z: tuple, needed: Sequence[str] = ("obj_id", "ra_deg", "dec_deg", "z", "weight")) -> DataFrame:
    """Box and redshift cuts, non-finite values to null, nulls out, redshift and weight above 0."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    clean = df.withColumns({c: finite_or_null(F.col(c)) for c in needed if c in doubles})
    return filter_ranges(clean.na.drop(subset=list(needed)), ra_deg=ra, dec_deg=dec, z=z).filter("z > 0 and weight > 0")


def preprocess_catalog(
    df: DataFrame, ra: tuple | None = None, dec: tuple | None = None, z: tuple | None = None, coordinates: bool = True, h0: float = 70.0, names: Sequence[str] = ("ra", "dec", "redshift")
) -> DataFrame:
    """Range cuts, each optional, then x, y, z at the linear distance c z / ``h0``; all filters reach the scan."""
    cuts = {c: bounds for c, bounds in zip(names, (ra, dec, z)) if bounds is not None}
    out = filter_ranges(df, **cuts) if cuts else df
    return add_cartesian(out, *names, ("x", "y", "z"), lambda c: hubble_distance(c, h0)) if coordinates else out


def box(df: DataFrame, center: Mapping[str, float], side: float) -> DataFrame:
    """Rows within a cube of ``side`` about ``center``, faces included."""
    return df.filter(reduce(lambda a, b: a & b, [F.abs(F.col(c) - x) <= side / 2 for c, x in center.items()]))


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in without]


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every one of ``columns`` is a finite number."""
    return df.filter(reduce(lambda a, b: a & b, [finite_or_null(F.col(c).cast("double")).isNotNull() for c in columns], F.lit(True)))


def numeric_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strings as doubles, null where they are none."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def clean_for_store(df: DataFrame) -> DataFrame:
    """Sound objects: an id, ra in [0, 360], dec in [-90, 90], redshift in [0, 10]; a null redshift goes too."""
    return numeric_or_null(df, [c for c in ("ra", "dec", "redshift") if c in df.columns]).filter(
        F.col("object_id").isNotNull() & in_range("ra", 0, 360) & in_range("dec", -90, 90) & in_range("redshift", 0, 10)
    )


def trim_quantiles(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows within the exact, linearly interpolated quantiles of ``column`` (NumPy's), ends included."""
    wanted = [q for q in (low, high) if q is not None]
    row = row_of(df, [column], wanted)[column]
    if row is None:
        return df
    bounds = dict(zip([x for x, q in (("low", low), ("high", high)) if q is not None], row))
    return df.filter(in_range(column, bounds.get("low"), bounds.get("high")))


def clean_cascade(df: DataFrame, mags: Sequence[str] = (), xyz: Sequence[str] = (), per_column_null_safe: bool = False) -> DataFrame:
    """The cleaning cascade, in order; each quantile is taken over the rows that the steps before have left.

    Full-row duplicates go; ra and dec by range and their middle 98 %; redshift in [0, 10] and to its 99.5 %;
    magnitudes in [5, 35] and their middle 99 %; rows with under half of their columns go; coordinates finite
    and in their middle 99 %. With ``per_column_null_safe`` a null magnitude does not drop its row. The distinct rows are
    written to the staging folder once, and every quantile is taken from there.
    """
    df = stored(df.dropDuplicates(), "distinct")
    for c, bounds in (("ra", (0, 360)), ("dec", (-90, 90))):
        if c in df.columns:
            df = trim_quantiles(df.filter(in_range(c, *bounds)), c, 0.01, 0.99)
    if "redshift" in df.columns:
        df = trim_quantiles(df.filter(in_range("redshift", 0, 10)), "redshift", None, 0.995)
    for c in mags:
        sound = in_range(c, 5, 35)
        if per_column_null_safe:
            row = row_of(df.filter(sound), [c], (0.005, 0.995))[c]
            df = df.filter(F.col(c).isNull() | (sound & in_range(c, *row))) if row else df
        else:
            df = trim_quantiles(df.filter(sound), c, 0.005, 0.995)
    df = df.na.drop(thresh=len(df.columns) // 2)
    for c in xyz:
        df = trim_quantiles(finite_rows(df, [c]), c, 0.005, 0.995)
    return df


def valid_coordinates(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """One row: whether all ra are in [0, 360) and all dec in [-90, 90]."""
    ok = (F.col(ra) >= 0) & (F.col(ra) < 360) & (F.col(dec) >= -90) & (F.col(dec) <= 90)
    return df.agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("valid"))


def valid_redshift(df: DataFrame, z: str = "redshift", most: float = 20.0) -> DataFrame:
    return df.agg(F.bool_and(F.coalesce(in_range(z, 0, most), F.lit(False))).alias("valid"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5, cap: bool = False) -> DataFrame:
    """Values beyond ``factor`` interquartile ranges from the quartiles: their rows go, or they are capped."""
    quartiles = row_of(df, columns, (0.25, 0.75))
    for c in columns:
        if quartiles[c] is None:
            continue
        q1, q3 = quartiles[c]
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        df = df.withColumn(c, F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))) if cap else df.filter(in_range(c, low, high))
    return df


def fill_missing(df: DataFrame, columns: Sequence[str], strategy: str = "mean", order: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """drop, mean, median, mode or interpolate each column; ``unknown`` for strings.

    ``interpolate`` is linear between the nearest values by ``order`` within each group of ``by``; ends are not filled.
    """
    if strategy == "drop":
        return df.na.drop(subset=list(columns))
    if strategy == "unknown":
        return df.na.fill("unknown", subset=list(columns))
    if strategy == "interpolate":
        return _interpolated(df, columns, order, by)
    if strategy == "median":
        row = {c: q and q[0] for c, q in row_of(df, columns, (0.5,)).items()}
    elif strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    elif strategy == "mode":  # counted before anything is gathered; ties to the smallest value
        row = {}
        for c in columns:
            most = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
            row[c] = most and most[c]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.na.fill({c: v for c, v in row.items() if v is not None})


def _interpolated(df: DataFrame, columns: Sequence[str], order: str | None, by: Sequence[str]) -> DataFrame:
    if order is None:
        raise ValueError("interpolate needs an order")
    x = F.col(order).cast("double")
    if not by:  # ranges of rows, and the known values about each of them
        df = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
        known = {c: F.when(F.col(c).isNotNull(), F.struct(x.alias("x"), F.col(c).cast("double").alias("v"))) for c in columns}
        ends = df.groupBy("_part").agg(*[f(known[c]).alias(f"_{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))])
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        later = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
        around = [f.alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.last(F.col(f"_most_{c}"), True).over(earlier)), ("b", F.first(F.col(f"_least_{c}"), True).over(later)))]
        df = df.join(F.broadcast(ends.select(F.col("_part").alias("_of"), *around)), F.col("_part") == F.col("_of")).drop("_of")
    w = Window.partitionBy(*(by or ["_part"])).orderBy(order)
    past, coming = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    made = {}
    for c in columns:
        v = F.col(c).cast("double")
        at = F.when(v.isNotNull(), x)
        a, b = F.last(v, True).over(past), F.first(v, True).over(coming)
        xa, xb = F.last(at, True).over(past), F.first(at, True).over(coming)
        if not by:
            a, b = F.coalesce(a, F.col(f"_a_{c}.v")), F.coalesce(b, F.col(f"_b_{c}.v"))
            xa, xb = F.coalesce(xa, F.col(f"_a_{c}.x")), F.coalesce(xb, F.col(f"_b_{c}.x"))
        made[c] = F.coalesce(v, a + (b - a) * F.try_divide(x - xa, xb - xa))
    out = df.withColumns(made)
    return out if by else out.drop("_part", *[f"_{n}_{c}" for c in columns for n in "ab"])


def document_struct(df: DataFrame, fields: Mapping[str, tuple[str, object]], out: str = "document") -> DataFrame:
    """``df`` with a struct of ``fields``: name to (type, default), the default where the column is null or missing."""
    have = {c.lower(): c for c in df.columns}
    made = []
    for name, (kind, default) in fields.items():
        value = F.col(have[name.lower()]).cast(kind) if name.lower() in have else F.lit(None).cast(kind)
        made.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    return df.withColumn(out, F.struct(*made))


def downcast(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Doubles as floats: half the memory, seven digits. All double columns, or those given."""
    names = list(columns) or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in names})


def broadcast_row(df: DataFrame, row: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Every row of ``df`` with the columns of the one row of ``row``; ValueError if that is not one row."""
    if len(row.take(2)) != 1:
        raise ValueError("one row is needed to go with every other")
    return df.join(F.broadcast(row.select(*(columns or row.columns))))


def health_score(df: DataFrame) -> DataFrame:
    """One row: share of cells present, share of rows that are distinct, and a score of 0 to 100.

    The score is 100 times present * (0.5 + 0.5 * distinct); bands from 90, 70, 50 and 30.
    """
    n, width = F.count(F.lit(1)), max(1, len(df.columns))
    filled = reduce(lambda a, b: a + b, [F.count(F.col(c)) for c in df.columns])
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("d"))
    row = df.agg(n.alias("n"), filled.alias("filled")).join(distinct)
    score = row.withColumns({"present": F.try_divide("filled", F.col("n") * width), "distinct_share": F.try_divide("d", "n")})
    score = score.withColumn("score", 100 * F.col("present") * (0.5 + 0.5 * F.col("distinct_share")))
    band = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "fair").when(F.col("score") >= 30, "poor")
    return score.select("n", "present", "distinct_share", "score", band.otherwise("critical").alias("band"))
