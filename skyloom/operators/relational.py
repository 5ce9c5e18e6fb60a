"""Upserts, replacement by key, set operations, statistics and document-store queries on tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.quantiles import quantiles


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``old`` with rows of a key in ``new`` replaced by those, others added; columns that only one has are null."""
    keys = [key] if isinstance(key, str) else list(key)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert column by column: a null in ``new`` keeps what ``old`` has."""
    others = [c for c in dict.fromkeys(old.columns + new.columns) if c != key]
    a, b = old.alias("a"), new.alias("b")
    value = lambda c: F.coalesce(*[F.col(f"{t}.{c}") for t, df in (("b", new), ("a", old)) if c in df.columns]).alias(c)
    return a.join(b, key, "full").select(key, *map(value, others))


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose keys do not come in ``new``, and all of ``new``."""
    return upsert(old, new, list(keys))


def upsert_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of ``new`` update a row and how many are inserted."""
    known = old.select(key).distinct().withColumn("_old", F.lit(True))
    hit = F.col("_old").isNotNull()
    return new.join(known, key, "left").agg(F.count_if(hit).alias("updated"), F.count_if(~hit).alias("inserted"))


def pack_json(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """``columns`` as one JSON text, without nulls."""
    return df.withColumn(out, F.to_json(F.struct(*columns))).drop(*columns)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_distinct(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return union_all(*tables).dropDuplicates(list(keys))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: the least of a struct, so partial minima come before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def cached_value(cache: DataFrame, key: str, now: Column) -> DataFrame:
    """Values of ``key`` that have not run out."""
    return cache.filter((F.col("cache_key") == key) & (F.col("expires_at") > now))


def with_expiry(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return df.withColumns({"created_at": now, "expires_at": now + F.make_interval(hours=F.lit(hours))})


def older_than(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    return df.filter(F.col(column) < now - F.make_interval(days=F.lit(days)))


def find(df: DataFrame, limit: int | None = None, order: Sequence[str] = (), **equal) -> DataFrame:
    """Documents that equal all given fields; a list means any of them."""
    for c, v in equal.items():
        df = df.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(limit)


def set_fields(df: DataFrame, where: Column, **values) -> DataFrame:
    """Set fields of the rows that match."""
    return df.withColumns({c: F.when(where, F.lit(v) if not isinstance(v, Column) else v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def list_experiments(
    df: DataFrame, status: str | None = None, tags: Sequence[str] = (), limit: int = 100, skip: int = 0, sort_by: str = "created_at", descending: bool = True, tie: str = "id"
) -> DataFrame:
    """Equality on status, overlap of tags, sorted, a page of it."""
    if status:
        df = df.filter(F.col("status") == status)
    if tags:
        df = df.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    key = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    return df.orderBy(key, tie).offset(skip).limit(limit)


def set_status(df: DataFrame, where: Column, status: str, progress: Column, now: Column) -> DataFrame:
    """New status with progress clamped to 0 .. 100; times of start and end are set where due."""
    p = F.least(F.greatest(progress, F.lit(0)), F.lit(100))
    started = F.when(where & F.lit(status == "RUNNING") & (p == 0), now).otherwise(F.col("started_at"))
    ended = F.when(where & F.lit(status in ("COMPLETED", "FAILED")), now).otherwise(F.col("completed_at"))
    return df.withColumns(
        {"status": F.when(where, F.lit(status)).otherwise(F.col("status")), "progress": F.when(where, p).otherwise(F.col("progress")), "started_at": started, "completed_at": ended}
    )


def summarize(df: DataFrame, by: Sequence[str], columns: Sequence[str], stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """``<column>__<stat>`` of each group; std is the sample's."""
    made = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    out = df.groupBy(*by).agg(F.count("*").alias("_rows"), *[made[s](c).alias(f"{c}__{s}") for c in columns for s in stats if s != "median"])
    if "median" in stats:
        middle = quantiles(df, columns, (0.5,), by)
        held = middle.select(*[F.col(b).alias(f"_{b}") for b in by], *[F.get(f"q__{c}", F.lit(0)).alias(f"{c}__median") for c in columns])
        out = out.join(held, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], "left") if by else out.join(held)
    return out.select(*by, *[f"{c}__{s}" for c in columns for s in stats])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def keyword_counts(df: DataFrame, words: Column, top: int = 20) -> DataFrame:
    """The ``top`` most frequent entries of an array column, empty ones aside; ties by the entry."""
    return df.select(F.explode(words).alias("keyword")).filter(F.length(F.trim("keyword")) > 0).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(top)


def histogram_by(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(name)


def overview(df: DataFrame, value: str, breakdown: str, pattern: str = "%.3f") -> DataFrame:
    """One row: total, counts by ``breakdown`` as a map, formatted minimum and maximum of ``value``."""
    parts = df.groupBy(breakdown).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
    return parts.agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(breakdown).cast("string"), F.lit("unknown")), "n")))).alias("breakdown"),
        F.format_string(pattern, F.min("a")).alias("least"),
        F.format_string(pattern, F.max("b")).alias("most"),
    )


def describe_column(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, exact median, sample std, least and most of each group of ``by``, or of all rows."""
    moments = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"),
    )
    median = quantiles(df, [column], (0.5,), by).select(*by, F.get(f"q__{column}", F.lit(0)).alias("median"))
    joined = moments.join(median, list(by), "left") if by else moments.join(median)
    return joined.select(*by, "n", "mean", "median", "std", "least", "most")


_DESCRIBED = ("column", "count", "unique", "top", "mean", "std", "min", "quartiles", "max")


def describe_all(df: DataFrame) -> DataFrame:
    """A row a column: count, distinct values, most frequent value (the least of equal ones), mean, std, quartiles of numbers.

    Values are counted by column and value before anything is distinct, so no task holds a column's values.
    """
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    rows = []
    for c in df.columns:
        v = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
            )
        )
    found = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns]))
    counts = df.select(cells.alias("x")).filter("x.value is not null").groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    tops = counts.groupBy("column").agg(F.count("*").alias("unique"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("t"))
    found = found.join(tops.select("column", "unique", F.col("t.value").alias("top")), "column", "left").na.fill(0, ["unique"])
    if not numeric:
        return found.withColumn("quartiles", F.lit(None).cast("array<double>")).select(*_DESCRIBED)
    names = [c for c in df.columns if c in numeric]
    q = quantiles(df, names, (0.25, 0.5, 0.75))
    long = q.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"q__{c}").alias("quartiles")) for c in names])))
    return found.join(long, "column", "left").select(*_DESCRIBED)


def counts_in_bins(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """One row: rows in each half-open interval, and mean, median, std of ``value``."""
    bins = [F.count_if((F.col(value) >= a) & (F.col(value) < b)).alias(f"bin_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    median = quantiles(df, [value], (0.5,)).select(F.get(f"q__{value}", F.lit(0)).alias("median"))
    found = df.agg(*bins, F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).join(median)
    return found.select(*[c for c in found.columns if c not in ("median", "std")], "median", "std")


def key_value_map(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows of few keys as one map of structs."""
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.struct(*values))))).alias("statistics"))


def class_mean_distance(df: DataFrame, label: str, a, b, columns: Sequence[str]) -> DataFrame:
    """Euclidean distance of the mean vectors of two classes."""
    gap = [F.avg(F.when(F.col(label) == a, F.col(c))) - F.avg(F.when(F.col(label) == b, F.col(c))) for c in columns]
    return df.agg(F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gap])).alias("distance"))


def best_by(df: DataFrame, name: str, metric: str) -> DataFrame:
    return df.agg(F.max_by(name, metric).alias(name), F.max(metric).alias(metric))


def sequential_ids(df: DataFrame, key: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """0, 1, ... in the order of ``key`` within each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)


def markdown_report(df: DataFrame, title: str = "Data report") -> str:
    """Rows, columns, types and summary statistics of a table as Markdown."""
    summary = df.summary().toPandas()
    lines = [f"# {title}", "", f"Rows: {df.count()}", f"Columns: {len(df.columns)}", "", "| column | type |", "|-|-|"]
    lines += [f"| {c} | {t} |" for c, t in df.dtypes]
    lines += ["", "| " + " | ".join(summary.columns) + " |", "|" + "-|" * len(summary.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in summary.itertuples(index=False)]
    return "\n".join(lines) + "\n"


def bibtex(df: DataFrame) -> DataFrame:
    """An entry for each row of bibcode, author, title, year."""
    entry = F.format_string("@article{%s,\n  author = {%s},\n  title = {%s},\n  year = {%s}\n}", "bibcode", "author", "title", F.col("year").cast("string"))
    return df.select("bibcode", entry.alias("bibtex"))
