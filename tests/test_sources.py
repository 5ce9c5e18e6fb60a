import struct

import pytest

from skyloom.operators import columns as C
from skyloom.sources import readers, sinks
from skyloom.sources.fits import BLOCK, read_table


def card(key, value):
    return f"{key:<8}= {value:>20}".ljust(80)


def fits(rows):
    primary = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), "END".ljust(80)]).ljust(BLOCK).encode()
    heads = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", "20"), card("NAXIS2", str(len(rows))), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", "3")]
    for i, (name, form) in enumerate((("TARGETID", "1K"), ("RA", "D"), ("KIND", "4A")), 1):
        heads += [card(f"TTYPE{i}", f"'{name}'"), card(f"TFORM{i}", f"'{form}'")]
    head = "".join([*heads, "END".ljust(80)]).encode()
    head = head.ljust(-(-len(head) // BLOCK) * BLOCK)
    body = b"".join(struct.pack(">qd4s", a, b, c.encode()) for a, b, c in rows)
    return primary + head + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def test_fits_table(spark, tmp_path):
    (tmp_path / "t.fits").write_bytes(fits([(7, 1.5, "GAL"), (8, 2.5, "STAR")]))
    got = [tuple(r) for r in readers.read_any(spark, str(tmp_path / "t.fits")).collect()]
    assert got == [(7, 1.5, "GAL"), (8, 2.5, "STAR")]


def test_fits_files_are_read_by_ranges_of_rows(spark, tmp_path):
    files = {f"{n}.fits": [(i * 10 + n, i / 4, "GAL" if i % 2 else "STAR") for i in range(500 * n)] for n in (1, 2)}
    for name, rows in files.items():
        (tmp_path / name).write_bytes(fits(rows))
    for split in (1000, 2879, 1 << 20):
        df = read_table(spark, str(tmp_path / "*.fits"), split=split)
        assert sorted(map(tuple, df.collect())) == sorted(files["1.fits"] + files["2.fits"])
    assert read_table(spark, str(tmp_path / "*.fits"), split=1000).rdd.getNumPartitions() > 30
    some = read_table(spark, str(tmp_path / "1.fits"), columns=["KIND"])
    assert some.columns == ["KIND"] and some.count() == 500
    with pytest.raises(KeyError):
        read_table(spark, str(tmp_path / "1.fits"), columns=["NONE"])


def test_fits_file_of_more_than_two_gib(spark, tmp_path):
    width, n = 1 << 16, 35_000
    primary = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), "END".ljust(80)]).ljust(BLOCK).encode()
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(width)), card("NAXIS2", str(n)), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", "2")]
    cards += [card("TTYPE1", "'N'"), card("TFORM1", "'J'"), card("TTYPE2", "'FILL'"), card("TFORM2", f"'{width - 4}A'"), "END".ljust(80)]
    head = "".join(cards).encode()
    start = primary + head.ljust(-(-len(head) // BLOCK) * BLOCK)
    path = tmp_path / "large.fits"
    with open(path, "wb") as f:  # a file with holes
        f.write(start)
        for i in range(0, n, 5000):
            f.seek(len(start) + i * width)
            f.write(struct.pack(">i", i + 1))
        f.truncate(len(start) + n * width)
    assert path.stat().st_size > 1 << 31
    df = read_table(spark, str(path), columns=["N"])
    assert df.rdd.getNumPartitions() > 8
    assert [r["N"] for r in df.filter("N > 0").orderBy("N").collect()] == [i + 1 for i in range(0, n, 5000)] and df.count() == n


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.hdf5")


def test_graph_files_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("g", 0, 1, 0.5), ("g", 0, 2, 1.0)], "graph_id string, src long, dst long, weight double")
    lines = [r["value"] for r in sinks.edge_lines(edges, "edgelist").collect()]
    (tmp_path / "g.txt").write_text("# edges\n" + "\n".join(lines) + "\nbroken line\n")
    got = sorted(tuple(r) for r in readers.read_edge_lists(spark, str(tmp_path / "g.txt")).collect())
    assert got == [("g", 0, 1, 0.5), ("g", 0, 2, 1.0)]
    (tmp_path / "h.txt").write_text("\n".join(r["value"] for r in sinks.edge_lines(edges, "adjlist").collect()))
    assert sorted((r["src"], r["dst"]) for r in readers.read_adjacency_lists(spark, str(tmp_path / "h.txt")).collect()) == [(0, 1), (0, 2)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    for kind in ("parquet", "csv", "json"):
        sinks.save_table(df, str(tmp_path / f"t.{kind}"), kind)
        assert readers.read_any(spark, str(tmp_path / f"t.{kind}")).count() == 2
    sinks.save_table(df, str(tmp_path / "parts"), partition_by=["p"])
    sinks.replace_partitions(df.filter("p = 'a'").withColumn("k", df.k + 10), str(tmp_path / "parts"), ["p"])
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "parts")).collect()) == [2, 11]


def test_cache_aside_makes_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.cache_aside(spark, str(tmp_path / "c"), make).count() == 3
    assert made == [1]


def test_missing_columns_are_named():
    with pytest.raises(ValueError, match="dec"):
        C.resolve_columns(["RA"], {"ra": ("ra",), "dec": ("dec", "DECL")})


def test_quantile_trim_of_an_empty_table(spark):
    assert C.trim_quantiles(spark.createDataFrame([], "x double"), "x", 0.1, 0.9).count() == 0
