"""Exact quantiles of columns of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a group whose quantiles one aggregate takes; of more, only those near to a wanted rank are ordered.
DIRECT = 1_000_000
#: Half-width, as a share of a group's values, of the stretch about a rank that is ordered, and the accuracy of its ends.
NEAR, ACCURACY = 2e-4, 20_000


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and for each column ``q__<column>``: its linearly interpolated quantiles (NumPy's), null without values.

    One row without ``by``. Groups of up to ``DIRECT`` values are aggregated as they are. In larger ones a sketch brackets
    each rank; what is below the bracket is counted, and only the distinct values within it are ordered.
    """
    wanted = F.array(*map(F.lit, qs))
    if not by:  # one scan tells which columns go which way
        counts = df.agg(*[F.count(F.col(c).cast("double")) for c in columns]).first() if columns else ()
        large = [c for c, n in zip(columns, counts) if n > DIRECT]
        out = df.agg(F.lit(True).alias("_"), *[F.percentile(F.col(c).cast("double"), wanted).alias(f"q__{c}") for c in columns if c not in large])
        for c in large:
            values = df.select(F.col(c).cast("double").alias("v")).filter("v is not null")
            out = out.join(_selected(values, qs, by).withColumnRenamed("q", f"q__{c}"))
        return out.select(*[f"q__{c}" for c in columns])
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= DIRECT:
        return df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(f"q__{c}") for c in columns])
    out = sizes.select(*by)
    for c in columns:
        values = df.select(*by, F.col(c).cast("double").alias("v")).filter("v is not null")
        found = _of_all_sizes(values, qs, wanted, by).withColumnRenamed("q", f"q__{c}")
        held = found.withColumnsRenamed({b: f"_{b}" for b in by})
        same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
        out = out.join(held, same, "left").drop(*[f"_{b}" for b in by])
    return out


def _of_all_sizes(values: DataFrame, qs: Sequence[float], wanted: Column, by: Sequence[str]) -> DataFrame:
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > DIRECT).select(*[F.col(b).alias(f"_{b}") for b in by])
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    small = values.join(large, same, "left_anti").groupBy(*by).agg(F.percentile("v", wanted).alias("q"))
    return small.union(_selected(values.join(large, same, "left_semi"), qs, by))


def _selected(df: DataFrame, qs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The quantiles of groups of more than ``DIRECT`` values ``v``."""
    wide = NEAR + 3 / DIRECT

    def attach(rows: DataFrame, few: DataFrame) -> DataFrame:
        """``few`` has a row a group, and there are few groups of that size."""
        if not by:
            return rows.join(F.broadcast(few))
        held = few.withColumnsRenamed({b: f"_{b}" for b in by})
        return rows.join(held, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]).drop(*[f"_{b}" for b in by])

    each = range(len(qs))
    # all ends are read from one sketch
    places = [F.lit(float(min(max(x, 0.0), 1.0))) for q in qs for x in (q - wide, q + wide)]
    sketched = df.groupBy(*by).agg(F.percentile_approx("v", F.array(*places), F.lit(ACCURACY)).alias("_ends"))
    ends = [F.get("_ends", F.lit(2 * i + j)).alias(f"{name}{i}") for i in each for j, name in enumerate(("lo", "hi"))]
    joined = attach(df, sketched.select(*by, *ends))
    below = joined.groupBy(*by).agg(F.count("v").alias("n"), *[F.count_if(F.col("v") < F.col(f"lo{i}")).alias(f"below{i}") for i in each])
    places = F.array_compact(F.array(*[F.when(F.col("v").between(F.col(f"lo{i}"), F.col(f"hi{i}")), F.lit(i)) for i in each]))
    inside = joined.select(*by, "v", F.explode(places).alias("i")).groupBy(*by, "i", "v").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    counted = attach(inside.withColumn("upto", upto), below)
    made = []
    for i, q in enumerate(qs):
        rank = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.floor(rank), F.least(F.floor(rank) + 1, F.col("n") - 1)
        seen, mine = F.col("upto") + F.col(f"below{i}"), F.col("i") == i
        a = F.min(F.when(mine & (seen > low), F.col("v")))
        b = F.min(F.when(mine & (seen > high), F.col("v")))
        made.append(a + (b - a) * F.max(rank - low))
    return counted.groupBy(*by).agg(F.array(*made).alias("q"))


def row_of(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> dict[str, list[float] | None]:
    """The quantiles of the whole table as numbers; None for a column without values."""
    row = quantiles(df, columns, qs).first()
    return {c: row[f"q__{c}"] for c in columns}
