"""Running a Python function over rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows that are turned into Python objects at a time.
SLICE = 512


def map_rows(
    df: DataFrame, make: Callable[[], Callable[..., dict[str, list]]], schema: str | StructType, rows: int = SLICE, lists: bool = True
) -> DataFrame:
    """``mapInArrow`` where ``make()``, called once a task, returns a function of the columns of ``df``.

    That function gets a list for each column of ``df``, ``rows`` long at most, and returns a list or
    an Arrow array for each column of ``schema``; all of one length, which need not be ``rows``. Without ``lists``
    it gets Arrow arrays.
    """
    out = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    names = [f.name for f in out]
    # columns go by place, as their names may hold any character; a literal's column may not be null, a result's may
    placed = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(out)])
    # string and binary columns may exceed 2 GB only by far larger slices than these
    arrow = to_arrow_schema(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = f(*(c.to_pylist() if lists else c for c in part.columns))
                made = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], x.type) for n, x in zip(names, arrow)]
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, placed).toDF(*names)


def whole_keys(batches, columns: list[str], rows: int):
    """Tables of ``rows`` rows or more, of sorted batches, that end where all of ``columns`` change."""
    import numpy as np

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        same = np.ones(n, bool)
        for c in columns:
            x = t.column(c).to_numpy()
            same &= x == x[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n -= cut
    if held:
        yield pa.Table.from_batches(held)


class Recent(dict):
    """A memo of bounded memory: ``Recent(f)[x]`` is ``f(x)``. Of two generations the older goes when one is full.

    A generation holds ``limit`` entries of keys of ``longest`` items at most; longer keys are not kept.
    """

    def __init__(self, f: Callable, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.f, self.limit, self.longest, self.old = f, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.f(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.f(key)
        self[key] = found
        return found
