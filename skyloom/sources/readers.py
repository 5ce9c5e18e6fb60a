"""Catalog, document and graph sources, by format."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.operators.columns import find_column, in_range, resolve_columns
from skyloom.operators.sampling import sample_n

Reader = Callable[..., DataFrame]


def read_csv(spark: SparkSession, path: str, schema=None, comment: str | None = None) -> DataFrame:
    """CSV with a header; give the schema in production, as inference reads the file twice."""
    reader = spark.read.option("header", True)
    reader = reader.option("comment", comment) if comment else reader
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", multi_line).json(path)


def read_xml(spark: SparkSession, path: str, schema=None, row_tag: str = "row") -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).format("xml").option("rowTag", row_tag).load(path)


def read_text(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.text(path)


def read_fits(spark: SparkSession, path: str, schema=None) -> DataFrame:
    from skyloom.sources.fits import read_table

    return read_table(spark, path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


READERS: dict[str, Reader] = {
    "csv": read_csv, "parquet": read_parquet, "pq": read_parquet, "json": read_json, "jsonl": read_json, "ndjson": read_json, "xml": read_xml, "txt": read_text, "fits": read_fits, "fit": read_fits,
}


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = name.removesuffix(".gz")
    return name.rsplit(".", 1)[-1] if "." in name else ""


def read_any(spark: SparkSession, path: str, format: str | None = None, schema=None, **options) -> DataFrame:
    """Read by format, or by the suffix of the path; ValueError for one that is not known."""
    kind = (format or suffix(path)).lower()
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known: {sorted(READERS)}")
    return READERS[kind](spark, path, schema=schema, **options)


@dataclass(frozen=True)
class CatalogSource:
    """Where a catalog lies and which of its columns are which."""

    name: str
    path: str
    format: str | None = None
    columns: Mapping[str, Sequence[str]] = field(default_factory=dict)


#: Candidate columns of survey catalogs, as those surveys publish them.
SURVEY_COLUMNS = {
    "obj_id": ("obj_id", "objid", "specObjID", "TARGETID", "object_id", "COADD_OBJECT_ID"),
    "ra_deg": ("ra_deg", "RA", "TARGET_RA", "ALPHAWIN_J2000"),
    "dec_deg": ("dec_deg", "DEC", "TARGET_DEC", "DELTAWIN_J2000"),
    "z": ("z", "Z", "Z_COSMO", "Z_not4clus", "redshift", "photoz"),
    "weight": ("weight", "WEIGHT", "WEIGHT_FKP", "WEIGHT_TOT"),
}


def load_catalog(spark: SparkSession, source: CatalogSource, sample: int | None = None, key: str = "obj_id", seed: int = 42) -> DataFrame:
    """A catalog with its columns resolved; ``sample`` rows of it if that is fewer."""
    df = read_any(spark, source.path, source.format)
    if source.columns:
        found = resolve_columns(df.columns, source.columns)
        df = df.select(*[F.col(src).alias(dst) for dst, src in found.items()], *[c for c in df.columns if c not in found.values() and c not in found])
    return df if sample is None else sample_n(df, sample, find_column(df.columns, [key]) or df.columns[0], seed)


def tiled(df: DataFrame, ra: str, bounds: tuple[float, float], step: float, key: str, target: int, most_tiles: int, order: Sequence[str] = ()) -> DataFrame:
    """Rows of tile after tile of right ascension until ``target`` distinct keys are reached; first row of each key.

    One aggregate counts the tiles, so the number of tiles to take is known before any of them is read again.
    """
    low, high = bounds
    tiles = min(most_tiles, int(-(-(high - low) // step)))
    cut = df.filter(F.col(ra).between(low, high)).withColumn("_tile", F.least(F.floor((F.col(ra) - low) / step), F.lit(int(-(-(high - low) // step)) - 1)))
    first = cut.filter(F.col("_tile") < tiles).groupBy(key).agg(F.min_by(F.struct(*df.columns, "_tile"), F.struct("_tile", *order, *([] if order else [ra]))).alias("r"))
    sizes = sorted((int(r["t"]), r["n"]) for r in first.groupBy(F.col("r._tile").alias("t")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, last = 0, -1
    for t, n in sizes:
        last, total = t, total + n
        if total >= target:
            break
    return first.filter(F.col("r._tile") <= last).select("r.*").select(*df.columns)


def cache_aside(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path`` if there is one, else ``make()``, written there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_grid_system(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, dict]:
    """What ``save_grid_system`` wrote: grid, operator, record; without an operator None in its place."""
    import json

    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/operator")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    matrix = spark.read.parquet(f"{path}/operator") if there else None
    return spark.read.parquet(f"{path}/grid"), matrix, json.loads(spark.read.text(f"{path}/about").first()[0])


def load_first(makers: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The table of the first of ``makers`` that can be read and has rows; ValueError names what the others said."""
    said = []
    for make in makers:
        try:
            df = make()
            if df.limit(1).count():
                return df
            said.append("no rows")
        except Exception as e:  # noqa: BLE001  any source may be away
            said.append(f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")
    raise ValueError(f"no source could be read: {said}")


def load_survey(
    spark: SparkSession, cache: str, makers: Sequence[Callable[[], DataFrame]], z: tuple[float | None, float | None] = (None, None),
    most: int | None = None, redshift: str = "z", key: str = "obj_id", seed: int = 42,
) -> DataFrame:
    """A survey's table from the Parquet cache, or from the first source that has it, which is cached; cut and sampled."""
    found = cache_aside(spark, cache, lambda: load_first(makers)).filter(in_range(redshift, *z))
    return found if most is None else sample_n(found, most, key, seed)


#: The tracers of the survey's clustering catalogs, what they are, least and greatest redshift.
TRACERS = (
    ("BGS", "Bright Galaxy Survey", None, 0.6),
    ("LRG", "Luminous Red Galaxies", 0.4, 1.1),
    ("ELG", "Emission Line Galaxies", 0.8, 1.6),
    ("QSO", "Quasars", 0.8, 3.5),
)


def survey_summary(spark: SparkSession) -> DataFrame:
    """tracer, description, z_min, z_max of the survey's catalogs."""
    return spark.createDataFrame(list(TRACERS), "tracer string, description string, z_min double, z_max double")


def storage_paths(root: str) -> dict[str, str]:
    """Where the pipeline keeps its tables below ``root``."""
    kinds = ("raw", "processed", "graphs", "features", "distances", "models", "reports")
    return {k: f"{root.rstrip('/')}/{k}" for k in kinds}


def generated_catalog(spark: SparkSession, n: int, survey: str = "sdss", seed: int = 42) -> DataFrame:
    """A made-up catalog with the columns of a survey (sdss, desi, des, euclid), the same for the same seed."""
    u = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed * 1000 + i)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda i, m, s: m + s * F.sqrt(-2 * F.ln(u(i))) * F.cos(2 * F.pi() * u(i + 500))
    exponential = lambda i, scale: -scale * F.ln(u(i))
    base = {"object_id": F.concat_ws("_", F.lit(survey.upper()), "id"), "ra": u(1) * 360, "dec": u(2) * 180 - 90}
    kinds = F.when(u(3) < 0.7, "GALAXY").when(u(3) < 0.9, "STAR").otherwise("QSO")
    own = {
        "sdss": {"redshift": exponential(4, 0.3), "mag_g": normal(5, 20.0, 2.0), "mag_r": normal(6, 19.5, 2.0), "mag_i": normal(7, 19.0, 2.0), "object_type": kinds},
        "desi": {"redshift": exponential(4, 0.4), "mag_g": normal(5, 21.0, 1.5), "mag_r": normal(6, 20.5, 1.5), "mag_z": normal(7, 20.0, 1.5), "flux_g": exponential(8, 1000.0), "flux_r": exponential(9, 1000.0)},
        "des": {"photoz": exponential(4, 0.3), "photoz_err": 0.01 + 0.09 * u(5), "mag_g": normal(6, 22.0, 1.5), "extinction_g": 0.3 * u(7)},
        "euclid": {"photoz": exponential(4, 0.4), "stellar_mass": F.exp(normal(5, 10.0, 0.5)), "sfr": exponential(6, 1.0)},
    }
    if survey not in own:
        raise ValueError(f"unknown survey {survey!r}")
    return spark.range(n).select(*[c.alias(k) for k, c in (base | own[survey]).items()], F.lit(survey).alias("catalog_source"))


# documents and graphs

ATOM = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("published", T.StringType()),
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
    ]
)


def atom_entries(feeds: DataFrame, column: str = "xml", subjects: Mapping[str, str] | None = None) -> DataFrame:
    """id, title, summary, published, authors, subjects of entries (an Atom ``<entry>`` text a row).

    A category's name comes from ``subjects`` by its code, or else by the code's archive (before the dot).
    """
    e = F.from_xml(F.col(column), ATOM.simpleString())
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in (subjects or {"": ""}).items() for x in kv])
    name = lambda c: F.coalesce(F.try_element_at(table, c), F.try_element_at(table, F.split(c, r"\.")[0]), c)
    return feeds.withColumn("e", e).select(
        F.regexp_replace("e.id", r"^.*/abs/|v\d+$", "").alias("id"), clean(F.col("e.title")).alias("title"), clean(F.col("e.summary")).alias("summary"),
        F.expr("try_to_date(substring(e.published, 1, 10))").alias("published"), F.transform("e.author", lambda a: a["name"]).alias("authors"),
        F.array_distinct(F.transform("e.category", lambda c: name(c["_term"]))).alias("subjects"),
    )


PAPER = "struct<paperId:string,title:string,year:int,citationCount:int,authors:array<struct<name:string>>,fieldsOfStudy:array<string>,externalIds:map<string,string>>"


def paper_records(responses: DataFrame, column: str = "json") -> DataFrame:
    """Flat records of a literature API's JSON ``{"data": [...]}``."""
    d = F.from_json(F.col(column), f"struct<data:array<{PAPER}>>")
    return responses.select(F.explode(d["data"]).alias("p")).select(
        F.col("p.paperId").alias("id"), F.col("p.title").alias("title"), F.col("p.year").alias("year"), F.coalesce("p.citationCount", F.lit(0)).alias("citations"),
        F.transform("p.authors", lambda a: a["name"]).alias("authors"), F.coalesce("p.fieldsOfStudy", F.array().cast("array<string>")).alias("fields"),
        F.col("p.externalIds")["DOI"].alias("doi"),
    )


def matching(df: DataFrame, query: str, columns: Sequence[str], limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows with ``query`` in any of ``columns``, whatever its case."""
    q = query.lower()
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    df = df.filter(hit)
    df = df.orderBy(order) if order else df
    return df.limit(limit) if limit is not None else df


def paper_links(responses: DataFrame, column: str = "json") -> DataFrame:
    """``(id, kind, place, other_id, title, year)``: the papers that cite each paper of a literature API's details, and those it cites.

    ``kind`` is citation or reference, ``place`` the place in its list from 0. Entries without a paper id stay, with a null one.
    """
    other = "struct<paperId:string,title:string,year:int>"
    p = F.from_json(F.col(column), f"struct<paperId:string,citations:array<{other}>,references:array<{other}>>")
    held = responses.select(p.alias("p")).filter("p.paperId is not null")
    lists = [
        held.select(F.col("p.paperId").alias("id"), F.lit(kind).alias("kind"), F.posexplode(f"p.{name}").alias("place", "o"))
        for kind, name in (("citation", "citations"), ("reference", "references"))
    ]
    return lists[0].unionByName(lists[1]).select("id", "kind", "place", F.col("o.paperId").alias("other_id"), "o.title", "o.year")


def coordinate_box(df: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Rows within ``radius`` degrees of right ascension, the shorter way round the sky, and of declination."""
    gap = F.abs(F.pmod(F.col("ra").cast("double") - F.lit(float(ra)) + 180.0, F.lit(360.0)) - 180.0)
    return df.filter((gap <= radius) & (F.abs(F.col("dec") - dec) <= radius))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, paragraph, text of Word files: a row a paragraph, in order; an empty paragraph is an empty text."""

    def run(frames):
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as held:
                    body = ElementTree.fromstring(held.read("word/document.xml"))
                for i, p in enumerate(body.iter(f"{word}p")):
                    out.append((path, i, "".join(t.text or "" for t in p.iter(f"{word}t"))))
            yield pd.DataFrame(out, columns=["path", "paragraph", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, paragraph int, text string")


def read_dataset(spark: SparkSession, path: str, format: str | None = None, describe: bool = False) -> DataFrame:
    """A dataset by its suffix: text, JSON, Word paragraphs or a table; of a table, with ``describe``, a row a column.

    ValueError for other formats.
    """
    from skyloom.operators.relational import describe_all

    kind = format or suffix(path)
    found = read_docx(spark, path) if kind == "docx" else read_any(spark, path, kind)
    return describe_all(found) if describe and kind not in ("txt", "docx") else found


def read_gexf(spark: SparkSession, path: str, tag: str = "edge") -> DataFrame:
    """Edges (or, by tag, nodes) of GEXF files: graph_id (the file's name), source, target, weight (1 where it has none), or id, label."""
    shape = "_id string, _source string, _target string, _weight double" if tag == "edge" else "_id string, _label string"
    rows = spark.read.format("xml").option("rowTag", tag).schema(shape).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("graph_id")
    if tag == "edge":
        return rows.select(name, F.col("_source").alias("source"), F.col("_target").alias("target"), F.coalesce("_weight", F.lit(1.0)).alias("weight"))
    return rows.select(name, F.col("_id").alias("id"), F.coalesce("_label", "_id").alias("label"))


def read_distances(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """id_a, id_b, d of stored pairs, or of a square matrix: a row a graph, a column each in the same order.

    A column ``id`` of a matrix names its graphs; else they are ``graph_0``, ``graph_1`` ... in the order of the columns, and
    a column ``row`` or the order of the file tells its rows. A matrix is as wide as a row may be. Both halves are given.
    """
    df = read_any(spark, path, format)
    if {"id_a", "id_b", "d"} <= set(df.columns):
        return df.select("id_a", "id_b", "d")
    columns = [c for c in df.columns if c not in ("id", "row")]
    numbered = df.withColumn("_row", F.row_number().over(Window.orderBy("row" if "row" in df.columns else F.monotonically_increasing_id())) - 1)
    cells = numbered.select("_row", F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias("_column", "d"))
    if "id" in df.columns:
        names = numbered.select(F.col("_row"), F.col("id").cast("string").alias("name"))
    else:
        names = numbered.select("_row", F.concat(F.lit("graph_"), F.col("_row").cast("string")).alias("name"))
    a, b = (names.select(F.col("_row").alias(r), F.col("name").alias(n)) for r, n in (("_row", "id_a"), ("_column", "id_b")))
    return cells.join(a, "_row").join(b, "_column").select("id_a", "id_b", "d")


def read_edge_lists(spark: SparkSession, path: str) -> DataFrame:
    """graph_id (the file's name), src, dst, weight from lines ``src dst [weight]``; comments start with #."""
    lines = spark.read.text(path).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("graph_id"))
    p = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("graph_id", F.get(p, F.lit(0)).try_cast("long").alias("src"), F.get(p, F.lit(1)).try_cast("long").alias("dst"), F.coalesce(F.get(p, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))
    return rows.filter("src is not null and dst is not null")


def read_adjacency_lists(spark: SparkSession, path: str) -> DataFrame:
    """The same from lines ``node neighbour neighbour ...``."""
    lines = spark.read.text(path).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("graph_id"))
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("graph_id", F.get(p, F.lit(0)).try_cast("long").alias("src"), F.explode(F.slice(p, F.lit(2), F.size(p))).alias("d"))
    return rows.select("graph_id", "src", F.col("d").try_cast("long").alias("dst"), F.lit(1.0).alias("weight"))


def read_graphml(spark: SparkSession, path: str, tag: str = "edge") -> DataFrame:
    """Edges (or, by tag, nodes) of GraphML files: graph_id, source, target."""
    rows = spark.read.format("xml").option("rowTag", tag).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("graph_id")
    if tag == "edge":
        return rows.select(name, F.col("_source").cast("string").alias("source"), F.col("_target").cast("string").alias("target"))
    return rows.select(name, F.col("_id").cast("string").alias("id"))


def load_preset(path: str, name: str) -> dict:
    """A named preset of a YAML file, on the driver."""
    import yaml

    with open(path) as f:
        presets = yaml.safe_load(f) or {}
    found = presets.get("presets", presets)
    if name not in found:
        raise ValueError(f"no preset {name!r}; there are {sorted(found)}")
    return found[name]
