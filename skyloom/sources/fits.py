"""FITS binary tables, read by ranges of rows: a task seeks to its rows in a file of any size."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Type letters of binary table columns (FITS standard 4.0): NumPy type and Spark type.
FORMS = {"L": ("S1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}
CARD, BLOCK = 80, 2880
#: Bytes of a file that a task reads, and that it holds at a time.
SPLIT, READ = 128 << 20, 16 << 20


def _header(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    cards: dict[str, str] = {}
    while True:
        block = raw[at : at + BLOCK].decode("ascii", "replace")
        if not block:
            raise ValueError("the file ends inside a header")
        at += BLOCK
        for i in range(0, len(block), CARD):
            card = block[i : i + CARD]
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:]
                value = value.strip()[1:].split("'")[0].rstrip() if value.strip().startswith("'") else value.split("/")[0].strip()
                cards[key] = value


@dataclass(frozen=True)
class Field:
    """A column of a table: its type letter, how many values, where it starts in a row, and what its numbers stand for.

    The value is ``zero`` + ``scale`` * number; the number ``null`` stands for none.
    """

    name: str
    letter: str
    repeat: int
    offset: int
    scale: float = 1.0
    zero: float = 0.0
    null: int | None = None

    @property
    def kind(self) -> str:
        """Its Spark type. Scaled numbers are doubles, but a shift of half the range makes them unsigned and whole."""
        if self.letter in "BIJK" and (self.scale, self.zero) != (1.0, 0.0):
            wider = {("B", -128.0): "short", ("I", 32768.0): "int", ("J", 2147483648.0): "bigint"}
            return wider.get((self.letter, self.zero), "double") if self.scale == 1.0 else "double"
        return "double" if self.letter == "E" and (self.scale, self.zero) != (1.0, 0.0) else FORMS[self.letter][1]


def first_table(raw: bytes) -> tuple[list[Field], int, int, int]:
    """Fields, start of the rows, width and number of the first table with rows; ``raw`` need not reach beyond its header."""
    at = 0
    while at < len(raw):
        head, at = _header(raw, at)
        axes = [int(head[f"NAXIS{i + 1}"]) for i in range(int(head.get("NAXIS", 0)))]
        size = abs(int(head.get("BITPIX", 8))) // 8 * int(head.get("GCOUNT", 1)) * int(head.get("PCOUNT", 0)) if axes else 0
        data = 1
        for a in axes:
            data *= a
        size += data * abs(int(head.get("BITPIX", 8))) // 8 if axes else 0
        if head.get("XTENSION") == "BINTABLE" and axes[1] > 0:
            columns, offset = [], 0
            for i in range(int(head["TFIELDS"])):
                form = head[f"TFORM{i + 1}"]
                digits = "".join(c for c in form if c.isdigit() and form.index(c) < len(form) - 1)
                letter = form[len(digits)]
                repeat = int(digits or 1)
                width = {"L": 1, "B": 1, "A": 1, "I": 2, "J": 4, "E": 4, "K": 8, "D": 8, "X": 1, "P": 8, "Q": 16, "C": 8, "M": 16}[letter]
                null = head.get(f"TNULL{i + 1}")
                scale, zero = (float(head.get(f"{k}{i + 1}", d).replace("D", "E")) for k, d in (("TSCAL", "1"), ("TZERO", "0")))
                columns.append(Field(head.get(f"TTYPE{i + 1}", f"col{i + 1}"), letter, repeat, offset, scale, zero, None if null is None else int(null)))
                offset += width * repeat if letter != "X" else -(-repeat // 8)
            return columns, at, axes[0], axes[1]
        at += -(-size // BLOCK) * BLOCK
    raise ValueError("no table with rows")


def _usable(columns: list[Field]) -> list[Field]:
    """One-dimensional columns of types that Spark has."""
    return [c for c in columns if c.letter in FORMS and (c.repeat == 1 or c.letter == "A")]


def _values(part, f: Field):
    """The values of a field's numbers as an array or list, null where the table has none."""
    import numpy as np
    import pandas as pd

    if f.letter == "A":
        return [x.decode("ascii", "replace").rstrip() for x in part.tolist()]
    if f.letter == "L":
        return pd.array([{b"T": True, b"F": False}.get(x) for x in part.tolist()], "boolean")
    v = part.astype(part.dtype.newbyteorder("="))
    if f.letter in "ED":
        return v if (f.scale, f.zero) == (1.0, 0.0) else v.astype(np.float64) * f.scale + f.zero
    gone = v == f.null if f.null is not None else np.zeros(len(v), bool)
    if f.kind == "double":
        out = v.astype(np.float64) * f.scale + f.zero
        return pd.array(np.where(gone, 0.0, out), "Float64") if not gone.any() else pd.array([None if g else x for g, x in zip(gone, out)], "Float64")
    whole = v.astype(np.int64) + int(f.zero)
    return pd.arrays.IntegerArray(whole, gone)


def _start(spark: SparkSession, path: str) -> bytes:
    """The beginning of a file up to the header of its first table with rows, and no more than a few blocks beyond."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        raw, size = b"", 64 * BLOCK
        while True:
            more = bytes(stream.readNBytes(size))
            raw += more
            try:
                first_table(raw)
                return raw
            except (ValueError, IndexError, KeyError):
                if not more:
                    raise
    finally:
        stream.close()


def _opened(path: str):
    """The file as a seekable one, wherever Arrow's file systems reach; OSError or ValueError elsewhere."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _head(file) -> bytes:
    """The beginning of an open file up to the header of its first table with rows."""
    raw = b""
    while True:
        more = file.read(64 * BLOCK)
        raw += more
        try:
            first_table(raw)
            return raw
        except (ValueError, IndexError, KeyError):
            if not more:
                raise


def _layout(own: dict[str, Field], names: list[str], width: int):
    import numpy as np

    return np.dtype({
        "names": names, "itemsize": width, "offsets": [own[c].offset for c in names],
        "formats": [f"S{own[c].repeat}" if own[c].letter == "A" else FORMS[own[c].letter][0] for c in names],
    })


class Range(InputPartition):
    """Bytes of a file; its rows are those that start there."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, files: list[tuple[str, int]], split: int):
        self.schema, self.names, self.files, self.split = schema, schema.names, files, split

    def partitions(self) -> list[Range]:
        return [Range(path, at, at + self.split) for path, length in self.files for at in range(0, length, self.split)]

    def read(self, part: Range):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        arrow = to_arrow_schema(self.schema)
        with _opened(part.path) as file:
            found, at, width, n = first_table(_head(file))
            own = {f.name: f for f in _usable(found)}
            layout = _layout(own, self.names, width)
            first, last = (min(n, max(0, -(-(b - at) // width))) for b in (part.first, part.last))
            step = max(1, READ // width)
            for i in range(first, last, step):
                k = min(step, last - i)
                file.seek(at + i * width)
                raw = file.read(k * width)
                if len(raw) < k * width:
                    raise ValueError(f"{part.path} ends inside its table")
                table = np.frombuffer(raw, layout, k)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({c: _values(table[c], own[c]) for c in self.names}), schema=arrow, preserve_index=False)


class FitsSource(DataSource):
    """FITS tables by ranges of bytes; the schema names the columns. Options: ``files`` (JSON of paths and lengths), ``split``."""

    @classmethod
    def name(cls) -> str:
        return "skyloom_fits"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, json.loads(self.options["files"]), int(self.options["split"]))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, split: int = SPLIT) -> DataFrame:
    """The first table with rows of each file; the schema is that of the first file. A file without one is an error.

    A file of any size is read in ranges of ``split`` bytes, a task each, which seek to their rows; of ``columns``, where
    given, alone are values made. Scales, shifts and null numbers of the columns are applied. Paths, lengths and the first
    file's header come to the driver. A store that Arrow does not reach is read a file at a time, up to 2 GiB.
    """
    listed = spark.read.format("binaryFile").load(path)
    files = sorted((r["path"], r["length"]) for r in listed.select("path", "length").collect())
    if not files:
        raise FileNotFoundError(path)
    fields = _usable(first_table(_start(spark, files[0][0]))[0])
    if columns is not None:
        gone = set(columns) - {f.name for f in fields}
        if gone:
            raise KeyError(f"{path} has no column {sorted(gone)}")
        fields = [f for f in fields if f.name in set(columns)]
    schema = ", ".join(f"`{f.name}` {f.kind}" for f in fields)
    names = [f.name for f in fields]
    try:
        _opened(files[0][0]).close()
    except (OSError, ValueError, NotImplementedError):
        return _whole_files(listed, names, schema)
    spark.dataSource.register(FitsSource)
    return spark.read.format("skyloom_fits").schema(schema).options(files=json.dumps(files), split=str(split)).load()


def _whole_files(listed: DataFrame, names: list[str], schema: str, rows: int = 65536) -> DataFrame:
    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                found, at, width, n = first_table(bytes(raw))
                own = {f.name: f for f in _usable(found)}
                table = np.frombuffer(raw, _layout(own, names, width), n, at)
                for i in range(0, n, rows):
                    part = table[i : i + rows]
                    yield pd.DataFrame({c: _values(part[c], own[c]) for c in names})

    return listed.select("content").mapInPandas(run, schema)
