"""Packing: length buckets of least padding by dynamic programming, token-budget batches inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import col, fresh, others, read_table, shared_table

#: Rows that are ranked together, and the most parts of a bucket: beyond them the parts grow instead.
RANKED, PARTS = 2000, 4096


def word_tokens(text: str | Column = "text") -> Column:
    """Words of a text and one end token; 1 for a null or empty text."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets, ascending, that minimise the padding.

    Each length is padded to its bucket's bound. ``lengths`` ascend and are distinct. The cost of a
    bucket fulfils the quadrangle inequality, so the best last bucket's start never moves back as the
    end moves on, and each layer is found by halving: O(buckets * n * log n).
    """
    import numpy as np

    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    best = size * rows[1:]  # one bucket for the first i + 1 lengths: all padded to the i-th
    starts = []
    for _ in range(min(buckets, n) - 1):
        new, start = np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            to = min(j, hi)
            if lo <= to:  # the last bucket holds lengths i .. j
                i = np.arange(lo, to + 1)
                before = np.where(i > 0, best[i - 1], 0.0)
                cost = before + size[j] * (rows[j + 1] - rows[i])
                k = int(np.argmin(cost))
                new[j], start[j] = cost[k], lo + k
            todo += [(a, j - 1, lo, start[j]), (j + 1, b, start[j], hi)]
        starts.append(start)
        best = new
    bounds, j = [], n - 1
    for start in reversed(starts):
        bounds.append(int(lengths[j]))
        j = int(start[j]) - 1
        if j < 0:
            return sorted(bounds)
    return sorted([*bounds, int(lengths[j])])


def pack(rows: DataFrame, length: str, key: str, buckets: int = 8, budget: int = 65536) -> DataFrame:
    """``rows`` with bucket, boundary, batch_id, slot and padding.

    The histogram of ``length`` over all rows goes to the driver: a row for each distinct length, of which
    a corpus has no more than the square root of twice its tokens. A batch holds as many rows of one bucket
    as ``budget`` padded tokens allow, one at least. Only the last batch of a bucket may have room left:
    rows are ranked in parts dealt by a hash of ``key``, and each part's rank goes on from those before,
    so a bucket with most of the rows is not ranked in one task. ``length`` must not be null; rows with a
    null key are packed too, and so is each of repeated rows; an empty table gives an empty table. Columns of the
    names of new ones, in any case, are replaced; others keep their values whatever they are called.
    """
    rows = shared_table(rows.select(*map(col, others(rows, "bucket", "boundary", "batch_id", "slot", "padding"))), "lengths")
    part, size, first, rank = fresh(rows, "part", "n", "before", "rank")
    size_of, key_of = col(length), col(key)
    histogram = sorted((r[0], r[1]) for r in rows.select(size_of.alias("n")).groupBy("n").count().collect())
    total = sum(c for _, c in histogram)
    bounds = best_boundaries([x for x, _ in histogram], [c for _, c in histogram], buckets)
    bucket, boundary = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, bound in reversed(list(enumerate(bounds))):
        bucket = F.when(size_of <= bound, F.lit(i)).otherwise(bucket)
        boundary = F.when(size_of <= bound, F.lit(bound).cast("long")).otherwise(boundary)
    parts = max(1, min(PARTS, -(-total // RANKED)))
    mixed = F.xxhash64(key_of, F.lit(7))
    placed = rows.withColumns({"bucket": bucket, "boundary": boundary}).withColumn(part, F.pmod(mixed, F.lit(parts)).cast("int"))
    sizes = placed.groupBy("bucket", part).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy("bucket").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(sizes.select("bucket", part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(first)), "offsets")
    ranked = placed.withColumn(
        rank, F.row_number().over(Window.partitionBy("bucket", part).orderBy(mixed, key_of, size_of))
    ).join(offsets, ["bucket", part])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary"))).cast("long")
    at = F.col(first) + F.col(rank) - 1
    return ranked.select(
        *map(col, rows.columns),
        "bucket",
        "boundary",
        (F.col("bucket").cast("long") * F.lit(1 << 48) + F.floor(at / capacity)).cast("long").alias("batch_id"),
        (at % capacity).cast("int").alias("slot"),
        (F.col("boundary") - size_of).alias("padding"),
    )


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 8, budget: int = 65536) -> DataFrame:
    """One row a document: ``key``, n_tokens (words and an end) and where ``pack`` puts it; null texts have an end alone."""
    return pack(docs.select(col(key), word_tokens(col(text)).alias("n_tokens")), "n_tokens", key, buckets, budget)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document; null and empty texts are one token long, repeated rows packed each."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
