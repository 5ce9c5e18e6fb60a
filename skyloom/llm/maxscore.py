"""Exact top-k search by MaxScore: essential terms first, others only where the bound still competes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import read_table

#: Rows of a shard of candidates, at least and at most, and of a block of queries, about.
LEAST_SHARD, SHARD, BLOCK = 4096, 65536, 8192


def top_k(query, own: int, ids, x, least, most, k: int, step: int = 8):
    """Row numbers and scores of the ``k`` best rows of ``x`` for ``query``, ties to the smaller id.

    ``least`` and ``most`` are the components' bounds in the shard. A term adds between its two bounds;
    the terms of the widest bounds that together can lift a row over the threshold are essential: their
    postings are summed for every row. The rest is probed, the widest first, for those rows only whose sum
    and remaining upper bounds reach the threshold, which rises with each probe. Rows of id ``own`` are out.
    """
    import numpy as np

    terms = np.flatnonzero(query)
    low, high = (f(query[terms] * least[terms], query[terms] * most[terms]) for f in (np.minimum, np.maximum))
    order = np.argsort(low - high, kind="stable")
    terms, low, high = terms[order], low[order], high[order]
    rest = np.concatenate([np.cumsum((high)[::-1])[::-1], [0.0]])  # upper bound of the terms from i on
    rows = np.flatnonzero(ids != own)
    if len(rows) <= k:
        return rows, x[rows] @ query
    seed = rows[: 4 * k]
    floor = np.partition(x[seed] @ query, len(seed) - k)[-k]
    # non-essential: terms that cannot, from the lowest score on, lift a row to the threshold
    spare = np.cumsum((high - low)[::-1])
    essential = max(1, len(terms) - int(np.searchsorted(spare, floor - low.sum(), "left"))) if len(terms) else 0
    score = x[np.ix_(rows, terms[:essential])] @ query[terms[:essential]]
    at = essential
    while at < len(terms):
        live = score + rest[at] >= floor
        rows, score = rows[live], score[live]
        to = min(len(terms), at + step)
        score = score + x[np.ix_(rows, terms[at:to])] @ query[terms[at:to]]
        at = to
        if len(rows) > k:  # what a row has for certain lifts the threshold
            certain = score + low[at:].sum()
            floor = max(floor, np.partition(certain, len(rows) - k)[-k])
    best = np.lexsort((ids[rows], -score))[:k]
    return rows[best], score[best]


def _dealt(df: DataFrame, name: str, mine: Column, other: str, parts: int) -> DataFrame:
    """``df`` with its own part as ``name``, once for each of ``parts`` parts of the other side."""
    return df.withColumn(name, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def search(queries: DataFrame, rows: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of the greatest inner product for each query: query_id, rank, vec_id, score (long).

    Both sides have ``id`` and ``v`` (array<double> of whole numbers; sums are exact below 2**53). A row is
    no answer to a query of its own id. Rows are dealt into shards and queries into blocks by hash; each
    shard meets each block in a task of bounded size, which returns ``k`` rows a query, and the shards'
    answers are merged by a window over them. A query that meets no row has no answer. Repeated ids are
    rows of their own, the tie between them is broken by the score alone. Empty tables give an empty table. Shards are
    as large as the cores allow, so a row is sent once for each block, of which there is one for ``block`` queries.
    """
    n_rows, n_queries = rows.count(), queries.count()
    cores = 2 * rows.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(1, -(-n_rows // shard), min(cores, n_rows // LEAST_SHARD)), max(1, -(-n_queries // block))
    left = _dealt(rows, "s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "b", blocks)
    right = _dealt(queries, "b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "s", shards)

    def meet(a, b):
        import numpy as np
        import pandas as pd

        found = []
        if len(a) and len(b):
            width = max(max(map(len, a.v)), max(map(len, b.v)))

            def matrix(v):
                return np.array([np.pad(r, (0, width - len(r))) if len(r) < width else r for r in v], np.float64)

            ids, x = a.id.to_numpy(), matrix(a.v)
            least, most = x.min(axis=0), x.max(axis=0)
            for own, q in zip(b.id.tolist(), matrix(b.v)):
                best, score = top_k(q, own, ids, x, least, most, k)
                found += [(own, int(ids[i]), int(s)) for i, s in zip(best, score)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``id`` and ``v``: floor(scale * x); vectors null, of null or non-finite components, or null keys go."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(finite).select(
        F.col(key).alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v")
    )


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each vector whose id is divisible by 50; null vectors and those not finite take no part."""
    rows = whole_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows.filter(F.col("id") % 50 == 0), rows, k=5)
