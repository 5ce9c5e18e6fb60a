"""Queries of the table operators: scans, filters, joins, aggregates, sampling, scaling, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.coords import add_cartesian, gauss_legendre, hubble_distance, to_cartesian
from skyloom.operators import columns as C
from skyloom.operators import neighbors, relational as R, sampling as S, scaling as X
from skyloom.sources import readers

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as objects of a catalog: id, ra, dec, redshift, magnitudes, source."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_id"), F.pmod(F.col("l_extendedprice"), F.lit(360.0)).alias("ra"),
        (F.pmod(F.col("l_partkey"), F.lit(1801)) / 10.0 - 90.0).alias("dec"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("redshift"),
        (F.col("l_quantity") / 2 + 5).alias("mag_g"), (F.col("l_extendedprice") / 4000).alias("mag_r"), F.col("l_returnflag").alias("catalog_source"),
    )


CATALOG = """(SELECT l_orderkey * 10 + l_linenumber AS object_id, l_extendedprice % 360.0 AS ra, (l_partkey % 1801) / 10.0 - 90.0 AS dec,
  l_discount * 10 + l_tax AS redshift, l_quantity / 2 + 5 AS mag_g, l_extendedprice / 4000 AS mag_r, l_returnflag AS catalog_source FROM lineitem)"""


@query("s02_scan_project_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < TIMESTAMP '1994-01-01'")
def _(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity >= 45 and l_shipdate < timestamp '1994-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("s06_catalog_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY ((o_orderkey % 2147483648) * 1103515245 + 42) % 2147483648, o_orderkey LIMIT 200")
def _(spark, d):
    return S.sample_n(table(spark, d, "orders"), 200, "o_orderkey", 42, S.lcg_order).select("o_orderkey", "o_totalprice")


@query(
    "s07_tiled_first_by_key",
    """WITH cut AS (SELECT *, o_totalprice % 360.0 AS ra FROM orders), t AS (SELECT *, least(floor(ra / 30), 11) AS tile FROM cut),
    f AS (SELECT o_custkey, o_orderkey, ra, tile, row_number() OVER (PARTITION BY o_custkey ORDER BY tile, o_orderkey) AS r FROM t WHERE tile < 12),
    s AS (SELECT tile, sum(count(*)) OVER (ORDER BY tile) - count(*) AS before FROM f WHERE r = 1 GROUP BY tile)
    SELECT o_custkey, o_orderkey, round(ra, 6) AS ra FROM f JOIN s USING (tile) WHERE r = 1 AND before < 500""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.pmod(F.col("o_totalprice"), F.lit(360.0)).alias("ra"))
    found = readers.tiled(orders, "ra", (0.0, 360.0), 30.0, "o_custkey", 500, 12, ["o_orderkey"])
    return found.select("o_custkey", "o_orderkey", F.round("ra", 6).alias("ra"))


@query(
    "s12_combined_sample",
    """SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 2
    ORDER BY (c_custkey % 2147483648 * 1103515245 + 42) % 2147483648, c_custkey) AS r FROM customer) WHERE r <= 20""",
)
def _(spark, d):
    c = table(spark, d, "customer").withColumn("half", F.col("c_nationkey") % 2)
    return S.combined_sample(c, ["c_mktsegment", "half"], 20, "c_custkey", 42, S.lcg_order).select("c_custkey", "c_mktsegment")


@query("s15_generated_catalog")
def _(spark, d):
    return readers.generated_catalog(spark, 2000, "sdss")


@query("s17_numeric_or_null", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("bad"))
    return C.numeric_or_null(e, ["k", "bad"])


@query(
    "s18_atom_entries",
    """SELECT c_custkey::VARCHAR AS id, c_name AS title, DATE '2024-01-02' AS published, [c_mktsegment, 'x'] AS authors, ['Astrophysics', 'math.XX'] AS subjects FROM customer""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    xml = F.format_string(
        "<entry><id>http://host/abs/%dv2</id><title>%s</title><summary>s</summary><published>2024-01-02T03:04:05Z</published><author><name>%s</name></author><author><name>x</name></author><category term='astro-ph.CO'/><category term='astro-ph'/><category term='math.XX'/></entry>",
        "c_custkey", "c_name", "c_mktsegment",
    )
    found = readers.atom_entries(c.select(xml.alias("xml")), subjects={"astro-ph": "Astrophysics"})
    return found.select("id", "title", "published", "authors", "subjects")


@query("s19_paper_records", "SELECT o_orderkey::VARCHAR AS id, 'T' AS title, 2001 AS year, o_custkey::INT AS citations, ['a', 'b'] AS authors, []::VARCHAR[] AS fields, 'd' AS doi FROM orders")
def _(spark, d):
    json = F.format_string('{"data": [{"paperId": "%d", "title": "T", "year": 2001, "citationCount": %d, "authors": [{"name": "a"}, {"name": "b"}], "externalIds": {"DOI": "d"}}]}', "o_orderkey", "o_custkey")
    return readers.paper_records(table(spark, d, "orders").select(json.alias("json")))


@query("s19_paper_links", "SELECT c_custkey::VARCHAR AS id, k AS kind, i::INT AS place, (c_custkey + i + j)::VARCHAR AS other_id, (1990 + i)::INT AS year FROM customer, (VALUES ('citation', 0, 1), ('citation', 1, 1), ('reference', 0, 5)) AS v(k, i, j)")
def _(spark, d):
    json = F.format_string(
        '{"paperId": "%d", "citations": [{"paperId": "%d", "title": "A", "year": 1990}, {"paperId": "%d", "year": 1991}], "references": [{"paperId": "%d", "title": "R", "year": 1990}]}',
        "c_custkey", F.col("c_custkey") + 1, F.col("c_custkey") + 2, F.col("c_custkey") + 5,
    )
    return readers.paper_links(table(spark, d, "customer").select(json.alias("json"))).drop("title")


@query("s20_box_across_zero", f"SELECT object_id FROM {CATALOG} WHERE least(abs(ra - 2), 360 - abs(ra - 2)) <= 10 AND abs(dec + 5) <= 10")
def _(spark, d):
    return readers.coordinate_box(catalog(spark, d), 2.0, -5.0, 10.0).select("object_id")


@query("s20_coordinate_box", f"SELECT object_id FROM {CATALOG} WHERE abs(ra - 120) <= 5 AND abs(dec - 10) <= 20")
def _(spark, d):
    return readers.coordinate_box(catalog(spark, d).withColumn("ra", F.col("ra")), 120.0, 10.0, 20.0).filter(F.abs(F.col("ra") - 120) <= 5).select("object_id")


@query("s21_text_match", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') ORDER BY doc_id LIMIT 50")
def _(spark, d):
    return readers.matching(table(spark, d, "documents"), "License", ["text", "source"], 50, "doc_id").select("doc_id")


# filters


@query("f01_resolve_columns", "SELECT l_orderkey AS obj_id, l_quantity AS ra_deg, l_tax AS z FROM lineitem WHERE l_linenumber = 1")
def _(spark, d):
    names = {"obj_id": ("TARGETID", "L_ORDERKEY"), "ra_deg": ("RA", "l_Quantity"), "z": ("Z", "L_TAX")}
    return C.select_resolved(table(spark, d, "lineitem").filter("l_linenumber = 1"), names)


@query("f03_normalize_catalog", "SELECT l_orderkey::VARCHAR AS object_id, l_quantity AS ra, l_tax AS \"dec\", NULL::DOUBLE AS redshift, 'demo' AS catalog_source FROM lineitem")
def _(spark, d):
    vital = {"object_id": ("l_orderkey",), "ra": ("l_quantity",), "dec": ("l_tax",)}
    return C.normalize_catalog(table(spark, d, "lineitem"), "demo", vital, {"redshift": ("z", "redshift")})


@query("f04_rename_known", "SELECT o_orderkey AS object_id, o_totalprice AS mag FROM orders")
def _(spark, d):
    return C.rename_known(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"o_orderkey": "object_id", "o_totalprice": "mag", "objid": "object_id"}, ["object_id", "mag"])


@query("f05_basic_filter", f"SELECT object_id FROM {CATALOG} WHERE ra BETWEEN 10 AND 200 AND dec BETWEEN -30 AND 60 AND redshift BETWEEN 0.1 AND 0.6 AND redshift > 0 AND mag_g > 0")
def _(spark, d):
    points = catalog(spark, d).select(F.col("object_id").alias("obj_id"), F.col("ra").alias("ra_deg"), F.col("dec").alias("dec_deg"), F.col("redshift").alias("z"), F.col("mag_g").alias("weight"))
    return C.basic_filter(points, (10, 200), (-30, 60), (0.1, 0.6)).select(F.col("obj_id").alias("object_id"))


@query("f07_optional_ranges", f"SELECT object_id, redshift FROM {CATALOG} WHERE ra >= 300 AND redshift BETWEEN 0.2 AND 0.4")
def _(spark, d):
    return C.filter_ranges(catalog(spark, d), ra=(300, None), dec=(None, None), redshift=(0.2, 0.4)).select("object_id", "redshift")


@query("f09_clean_for_store", f"SELECT object_id FROM (SELECT *, CASE WHEN object_id % 7 = 0 THEN NULL ELSE redshift END AS z FROM {CATALOG}) WHERE ra BETWEEN 0 AND 360 AND dec BETWEEN -90 AND 90 AND z BETWEEN 0 AND 10")
def _(spark, d):
    holes = catalog(spark, d).withColumn("redshift", F.when(F.col("object_id") % 7 != 0, F.col("redshift")))
    return C.clean_for_store(holes).select("object_id")


_TRIM = "quantile_cont({c}, {q}) FROM {t}"
CASCADE = f"""
WITH c0 AS (SELECT DISTINCT * FROM {CATALOG}), c1 AS (SELECT * FROM c0 WHERE ra BETWEEN 0 AND 360),
c2 AS (SELECT * FROM c1 WHERE ra BETWEEN (SELECT quantile_cont(ra, 0.01) FROM c1) AND (SELECT quantile_cont(ra, 0.99) FROM c1)),
c3 AS (SELECT * FROM c2 WHERE dec BETWEEN -90 AND 90),
c4 AS (SELECT * FROM c3 WHERE dec BETWEEN (SELECT quantile_cont(dec, 0.01) FROM c3) AND (SELECT quantile_cont(dec, 0.99) FROM c3)),
c5 AS (SELECT * FROM c4 WHERE redshift BETWEEN 0 AND 10),
c6 AS (SELECT * FROM c5 WHERE redshift <= (SELECT quantile_cont(redshift, 0.995) FROM c5)),
c7 AS (SELECT * FROM c6 WHERE mag_g BETWEEN 5 AND 35),
c8 AS (SELECT * FROM c7 WHERE mag_g BETWEEN (SELECT quantile_cont(mag_g, 0.005) FROM c7) AND (SELECT quantile_cont(mag_g, 0.995) FROM c7)),
c9 AS (SELECT * FROM c8 WHERE mag_r BETWEEN 5 AND 35),
c10 AS (SELECT * FROM c9 WHERE mag_r BETWEEN (SELECT quantile_cont(mag_r, 0.005) FROM c9) AND (SELECT quantile_cont(mag_r, 0.995) FROM c9))
SELECT object_id, round(ra, 6) AS ra FROM c10"""


@query("f10_clean_cascade", CASCADE)
def _(spark, d):
    return C.clean_cascade(catalog(spark, d), ["mag_g", "mag_r"], per_column_null_safe=False).select("object_id", F.round("ra", 6).alias("ra"))


@query("f12_filtered_limit", f"SELECT object_id, mag_r FROM {CATALOG} WHERE catalog_source = 'R' AND redshift BETWEEN 0.1 AND 0.5 AND mag_r <= 10 ORDER BY object_id LIMIT 100")
def _(spark, d):
    found = C.filter_ranges(catalog(spark, d).filter(F.col("catalog_source") == F.upper(F.lit("r"))), redshift=(0.1, 0.5), mag_r=(None, 10))
    return found.orderBy("object_id").limit(100).select("object_id", "mag_r")


@query("f13_find", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 50")
def _(spark, d):
    return R.find(table(spark, d, "orders"), 50, ["o_orderkey"], o_orderstatus="O", o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderstatus")


NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query("f14_cached_value", f"SELECT event_id, value FROM (SELECT *, ts + INTERVAL 24 HOUR AS e FROM events) WHERE event_type = (SELECT min(event_type) FROM events) AND e > {NOW}")
def _(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type")).first()[0]
    cache = e.withColumns({"cache_key": F.col("event_type"), "expires_at": F.col("ts") + F.make_interval(hours=F.lit(24))})
    return R.cached_value(cache, first, F.expr(NOW.lower())).select("event_id", "value")


@query(
    "f15_list_page",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND list_has_any([o_orderpriority, o_orderstatus], ['1-URGENT', '5-LOW']) ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 10",
)
def _(spark, d):
    o = table(spark, d, "orders").withColumns({"status": F.col("o_orderstatus"), "tags": F.array("o_orderpriority", "o_orderstatus")})
    return R.list_experiments(o, "F", ["1-URGENT", "5-LOW"], 30, 10, "o_orderdate", True, "o_orderkey").select("o_orderkey")


@query("f16_counts", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f17_set_status",
    f"SELECT event_id, CASE WHEN value > 50 THEN 'COMPLETED' ELSE event_type END AS status, CASE WHEN value > 50 THEN least(greatest(value * 1.5, 0), 100) ELSE value END AS progress, CASE WHEN value > 50 THEN {NOW} END AS completed_at FROM events",
)
def _(spark, d):
    none = F.lit(None).cast("timestamp")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), F.col("value").alias("progress"), none.alias("started_at"), none.alias("completed_at"), "value")
    out = R.set_status(e, F.col("value") > 50, "COMPLETED", F.col("value") * 1.5, F.expr(NOW.lower()))
    return out.select("event_id", "status", F.col("progress").cast("double").alias("progress"), "completed_at")


@query("f19_box", f"SELECT object_id FROM {CATALOG} WHERE abs(ra - 100) <= 10 AND abs(dec - 20) <= 10 AND abs(mag_g - 20) <= 10")
def _(spark, d):
    return C.box(catalog(spark, d), {"ra": 100.0, "dec": 20.0, "mag_g": 20.0}, 20.0).select("object_id")


@query("f20_finite_rows", f"SELECT object_id FROM {CATALOG} WHERE redshift <> 0")
def _(spark, d):
    bad = catalog(spark, d).withColumn("inverse", F.when(F.col("redshift") == 0, F.lit(float("inf"))).otherwise(F.col("redshift")))
    return C.finite_rows(bad, ["inverse", "ra"]).select("object_id")


@query("f23_valid_coordinates", f"SELECT bool_and(ra >= 0 AND ra < 360 AND dec BETWEEN -90 AND 90) AS valid FROM {CATALOG}")
def _(spark, d):
    return C.valid_coordinates(catalog(spark, d))


# joins


@query("j02_group_statistics", f"SELECT object_id, round(avg(redshift) OVER w, 6) AS m, round(stddev_samp(redshift) OVER w, 6) AS s, count(redshift) OVER w AS n FROM {CATALOG} WINDOW w AS (PARTITION BY catalog_source)")
def _(spark, d):
    out = X.attach_group_stats(catalog(spark, d), "catalog_source", "redshift")
    return out.select("object_id", F.round("redshift_mean", 6).alias("m"), F.round("redshift_std", 6).alias("s"), F.col("redshift_count").alias("n"))


@query("j05_replace_keys", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (1, 2) UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_nationkey IN (1, 2) AND c_acctbal > 0")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    gone = c.filter("c_nationkey in (1, 2)")
    assert gone.columns == c.columns
    new = gone.filter("c_acctbal > 0").withColumn("c_acctbal", F.lit(0.0))
    return R.replace_keys(c.join(gone.select("c_nationkey").distinct(), "c_nationkey", "left_anti").select(*c.columns), new, ["c_nationkey"]).select("c_custkey", "c_acctbal")


@query(
    "j06_upsert",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0",
)
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return R.upsert(c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey")


@query("j06_merge_columns", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return R.merge_columns(c, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal")), "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("j08_grid_cell_counts", "SELECT p_partkey, count(*) OVER (PARTITION BY p_size // 5) AS n FROM part")
def _(spark, d):
    p = table(spark, d, "part").withColumn("cell", F.floor(F.col("p_size") / 5))
    return p.join(p.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").select("p_partkey", "n")


@query("j13_cone", f"SELECT object_id FROM {CATALOG} WHERE degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(10.0 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(10.0)) * pow(sin(radians(150.0 - ra) / 2), 2))))) <= 8")
def _(spark, d):
    return neighbors.cone(catalog(spark, d), 150.0, 10.0, 8.0).select("object_id")


@query(
    "j13_cross_match",
    """WITH a AS (SELECT p_partkey AS id, p_retailprice % 360.0 AS ra, p_partkey % 170 - 85.0 AS dec FROM part), b AS (SELECT s_suppkey AS id, (s_acctbal + 2000) % 360.0 AS ra, s_suppkey % 170 - 85.0 AS dec FROM supplier)
    SELECT id_a, id_b, round(separation, 6) AS separation FROM (SELECT a.id AS id_a, b.id AS id_b, degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) AS separation FROM a, b) WHERE separation <= 3""",
)
def _(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.pmod(F.col("p_retailprice"), F.lit(360.0)).alias("ra"), (F.col("p_partkey") % 170 - 85.0).alias("dec"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.pmod(F.col("s_acctbal") + 2000, F.lit(360.0)).alias("ra"), (F.col("s_suppkey") % 170 - 85.0).alias("dec"))
    return neighbors.cross_match(a, b, 3.0).withColumn("separation", F.round("separation", 6))


# aggregates


@query("a01_group_moments", f"SELECT catalog_source, round(avg(redshift), 6) AS redshift__mean, round(stddev_samp(redshift), 6) AS redshift__std, count(redshift) AS redshift__count FROM {CATALOG} GROUP BY 1")
def _(spark, d):
    out = R.summarize(catalog(spark, d), ["catalog_source"], ["redshift"], ["mean", "std", "count"])
    return out.withColumns({c: F.round(c, 6) for c in ("redshift__mean", "redshift__std")})


@query("a02_ensemble_means", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity__mean, round(stddev_samp(l_quantity), 6) AS l_quantity__std, round(avg(l_tax), 6) AS l_tax__mean, round(stddev_samp(l_tax), 6) AS l_tax__std FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    out = R.summarize(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if "__" in c})


@query("a04_value_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def _(spark, d):
    return R.value_counts(table(spark, d, "events"), "event_type")


@query("a05_overview", f"SELECT count(*)::BIGINT AS total, printf('%.3f', min(redshift)) AS least, printf('%.3f', max(redshift)) AS most FROM {CATALOG}")
def _(spark, d):
    return R.overview(catalog(spark, d), "redshift", "catalog_source").drop("breakdown")


@query("a06_describe_column", f"SELECT catalog_source, count(mag_r) AS n, round(avg(mag_r), 6) AS mean, round(median(mag_r), 6) AS median, round(stddev_samp(mag_r), 6) AS std, min(mag_r) AS least, max(mag_r) AS most FROM {CATALOG} GROUP BY 1")
def _(spark, d):
    return R.describe_column(catalog(spark, d), "mag_r", ["catalog_source"]).withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query(
    "a07_counts_in_bins",
    f"SELECT count(*) FILTER (redshift >= 0 AND redshift < 0.1) AS bin_0, count(*) FILTER (redshift >= 0.1 AND redshift < 0.5) AS bin_1, count(*) FILTER (redshift >= 0.5 AND redshift < 1) AS bin_2, count(*) FILTER (redshift >= 1 AND redshift < 10) AS bin_3, round(avg(redshift), 6) AS mean, round(median(redshift), 6) AS median, round(stddev_samp(redshift), 6) AS std FROM {CATALOG}",
)
def _(spark, d):
    out = R.counts_in_bins(catalog(spark, d), "redshift", (0.0, 0.1, 0.5, 1.0, 10.0))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query("a10_first_by_key", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return R.first_by_key(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("a11_keyword_top", "SELECT keyword, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, ' ')) AS keyword FROM documents) WHERE length(trim(keyword)) > 0 GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20")
def _(spark, d):
    return R.keyword_counts(table(spark, d, "documents"), F.split("text", " "))


@query("a12_year_histogram", "SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(spark, d):
    return R.histogram_by(table(spark, d, "orders"), F.year("o_orderdate"), "year")


@query("a17_class_mean_distance", f"SELECT round(sqrt(pow(avg(redshift) FILTER (catalog_source = 'A') - avg(redshift) FILTER (catalog_source = 'R'), 2) + pow(avg(mag_g) FILTER (catalog_source = 'A') - avg(mag_g) FILTER (catalog_source = 'R'), 2)), 6) AS distance FROM {CATALOG}")
def _(spark, d):
    return R.class_mean_distance(catalog(spark, d), "catalog_source", "A", "R", ["redshift", "mag_g"]).select(F.round("distance", 6).alias("distance"))


# sampling


@query(
    "l03_downsample_matched",
    """SELECT 'c' AS side, k FROM (SELECT c_custkey AS k FROM customer ORDER BY (c_custkey % 2147483648 * 1103515245 + 42) % 2147483648, k LIMIT (SELECT least((SELECT count(*) FROM customer), (SELECT count(*) FROM part))))
    UNION ALL SELECT 'p', k FROM (SELECT p_partkey AS k FROM part ORDER BY (p_partkey % 2147483648 * 1103515245 + 42) % 2147483648, k LIMIT (SELECT least((SELECT count(*) FROM customer), (SELECT count(*) FROM part))))""",
)
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    x, y = S.downsample_matched(a, b, "k", 42, S.lcg_order)
    return x.select(F.lit("c").alias("side"), "k").union(y.select(F.lit("p").alias("side"), "k"))


@query("l05_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("l06_best", "SELECT p_name, p_retailprice FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part) ORDER BY p_partkey LIMIT 1")
def _(spark, d):
    p = table(spark, d, "part").withColumn("o", F.struct("p_retailprice", -F.col("p_partkey")))
    return p.agg(F.max_by("p_name", "o").alias("p_name"), F.max("p_retailprice").alias("p_retailprice"))


@query(
    "l09_exact_split",
    "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey % 2147483648 * 1103515245 + 42) % 2147483648, c_custkey) <= round(count(*) OVER (PARTITION BY c_mktsegment) * 0.2::DOUBLE) AS is_test FROM customer",
)
def _(spark, d):
    return S.exact_split(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 0.2, 42, S.lcg_order).select("c_custkey", "is_test")


@query("l12_folds", "SELECT c_custkey, ((c_custkey % 2147483648 * 1103515245 + 42) % 2147483648 % 5)::INT AS fold FROM customer")
def _(spark, d):
    return S.folds(table(spark, d, "customer"), "c_custkey", 5, 42, S.lcg_order).select("c_custkey", "fold")


@query("l12_shuffled_labels", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def _(spark, d):
    return S.shuffle_labels(table(spark, d, "customer"), "c_mktsegment", "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# set operations


@query("u01_union_all", "SELECT c_custkey AS id, c_acctbal AS balance, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return R.union_all(a, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")))


@query("u02_union_distinct", "SELECT DISTINCT id FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT o_custkey FROM orders)")
def _(spark, d):
    return R.union_distinct([table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))], ["id"])


@query("u03_array_distinct", "SELECT p_partkey, len(list_distinct(string_split(p_type || ' ' || p_type, ' ')))::INT AS n FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_type"), " "))).alias("n"))


# coordinates, scaling and features


def _quadrature() -> str:
    e = lambda x: f"sqrt(0.30966 * pow(1 + z * {x!r}, 3) + 9.1e-5 * pow(1 + z * {x!r}, 4) + {1 - 0.30966 - 9.1e-5!r})"
    return "z * (" + " + ".join(f"{w!r} / {e(x)}" for x, w in gauss_legendre(16)) + f") * {299792.458 / 67.66!r}"


@query(
    "x01_comoving_cartesian",
    f"WITH p AS (SELECT object_id, radians(ra) AS a, radians(dec) AS d, redshift AS z FROM {CATALOG}), q AS (SELECT *, {_quadrature()} AS r FROM p) SELECT object_id, round(r * cos(d) * cos(a), 4) AS x_mpc, round(r * cos(d) * sin(a), 4) AS y_mpc, round(r * sin(d), 4) AS z_mpc FROM q",
)
def _(spark, d):
    out = add_cartesian(catalog(spark, d), "ra", "dec", "redshift")
    return out.select("object_id", *[F.round(c, 4).alias(c) for c in ("x_mpc", "y_mpc", "z_mpc")])


@query("x03_linear_cartesian", f"SELECT object_id, round(redshift * 299792.458 / 70 * sin(radians(dec)), 4) AS z_mpc FROM {CATALOG}")
def _(spark, d):
    return add_cartesian(catalog(spark, d), "ra", "dec", "redshift", law=hubble_distance).select("object_id", F.round("z_mpc", 4).alias("z_mpc"))


@query("x05_unit_sphere", f"SELECT object_id, round(cos(radians(dec)) * cos(radians(ra)), 6) AS x, round(sin(radians(dec)), 6) AS z FROM {CATALOG}")
def _(spark, d):
    x, _, z = to_cartesian(F.col("ra"), F.col("dec"))
    return catalog(spark, d).select("object_id", F.round(x, 6).alias("x"), F.round(z, 6).alias("z"))


@query(
    "x07_normalize",
    f"SELECT object_id, round(ra / 360, 6) AS ra_norm, round((dec + 90) / 180, 6) AS dec_norm, round(log10(redshift + 0.001), 6) AS redshift_log, round((redshift - min(redshift) OVER ()) / (max(redshift) OVER () - min(redshift) OVER ()), 6) AS redshift_minmax, round((mag_g - avg(mag_g) OVER ()) / stddev_samp(mag_g) OVER (), 5) AS mag_g_zscore FROM {CATALOG}",
)
def _(spark, d):
    out = X.normalize_points(catalog(spark, d), ["mag_g"])
    names = ("ra_norm", "dec_norm", "redshift_log", "redshift_minmax")
    return out.select("object_id", *[F.round(c, 6).alias(c) for c in names], F.round("mag_g_zscore", 5).alias("mag_g_zscore"))


@query(
    "x08_engineer",
    f"""SELECT object_id, round(mag_g - mag_r, 8) AS color_g_r, CASE WHEN redshift < 0.1 THEN 'nearby' WHEN redshift < 0.5 THEN 'intermediate' WHEN redshift < 1 THEN 'distant' WHEN redshift < 2 THEN 'high_z' WHEN redshift < 10 THEN 'extreme' END AS redshift_bin_coarse,
    least(floor((redshift - min(redshift) OVER ()) / (max(redshift) OVER () - min(redshift) OVER ()) * 20), 19)::BIGINT AS redshift_bin_fine,
    round(redshift * 299792.458, 3) AS velocity_recession_kms, (least(floor((ra - min(ra) OVER ()) / (max(ra) OVER () - min(ra) OVER ()) * 36), 35) * 18 + least(floor((dec - min(dec) OVER ()) / (max(dec) OVER () - min(dec) OVER ()) * 18), 17))::BIGINT AS sky_region_id,
    round(90 - abs(dec), 6) AS galactic_latitude_approx, round(mag_g / (redshift + 0.001), 5) AS mag_g_div_redshift, round(mag_r * redshift, 9) AS mag_r_mul_redshift,
    round(avg(dec) OVER s, 6) AS dec_src_mean, round(stddev_samp(mag_r) OVER s, 6) AS mag_r_src_std, count(ra) OVER s AS ra_src_count FROM {CATALOG} WINDOW s AS (PARTITION BY catalog_source)""",
)
def _(spark, d):
    out = X.engineer_features(catalog(spark, d), ["mag_g", "mag_r"])
    assert "color_r_g" not in out.columns
    digits = {"color_g_r": 8, "velocity_recession_kms": 3, "galactic_latitude_approx": 6, "mag_g_div_redshift": 5, "mag_r_mul_redshift": 9, "dec_src_mean": 6, "mag_r_src_std": 6}
    return out.select("object_id", "redshift_bin_coarse", "redshift_bin_fine", "sky_region_id", "ra_src_count", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("x08_equal_bins", "WITH b AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part) SELECT p_partkey, least(floor((p_size - a) / (b - a)::DOUBLE * 7), 6)::BIGINT AS bin FROM part, b")
def _(spark, d):
    p = table(spark, d, "part")
    b = p.agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    return p.join(F.broadcast(b)).select("p_partkey", X.equal_bin(F.col("p_size"), F.col("a"), F.col("b"), 7).alias("bin"))


for _method, _sql in {
    "minmax": "(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())",
    "zscore": "(l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER ()",
    "standardize": "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()",
    "robust": "(l_quantity - (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem)) / ((SELECT quantile_cont(l_quantity, 0.75) FROM lineitem) - (SELECT quantile_cont(l_quantity, 0.25) FROM lineitem))",
    "maxabs": "(l_quantity - avg(l_quantity) OVER ()) / max(abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem))) OVER ()",
}.items():

    def _scaled(spark, d, method=_method):
        rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        return X.scale(rows, ["l_quantity"], method).withColumn("l_quantity", F.round("l_quantity", 6))

    QUERIES[f"x12_scale_{_method}"] = (_scaled, f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS l_quantity FROM lineitem")


@query("x14_iqr_outliers", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_orderkey, l_linenumber FROM lineitem, q WHERE l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)")
def _(spark, d):
    return C.iqr_outliers(table(spark, d, "lineitem"), ["l_extendedprice"], 0.5).select("l_orderkey", "l_linenumber")


@query("x14_iqr_capped", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, b + 0.5 * (b - a)), a - 0.5 * (b - a)), 4) AS price FROM lineitem, q")
def _(spark, d):
    return C.iqr_outliers(table(spark, d, "lineitem"), ["l_extendedprice"], 0.5, True).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("price"))


@query("x14_health_score", "SELECT count(*)::BIGINT AS n, 1.0::DOUBLE AS present, 1.0::DOUBLE AS distinct_share, 100.0::DOUBLE AS score, 'excellent' AS band FROM nation")
def _(spark, d):
    return C.health_score(table(spark, d, "nation"))


for _strategy, _sql in {"mean": "avg(l_tax)", "median": "median(l_tax)"}.items():

    def _filled(spark, d, strategy=_strategy):
        holes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("l_tax"))
        return C.fill_missing(holes, ["l_tax"], strategy).withColumn("l_tax", F.round("l_tax", 6))

    QUERIES[f"x15_fill_{_strategy}"] = (_filled, f"SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber <> 2 THEN l_tax ELSE (SELECT {_sql} FROM lineitem WHERE l_linenumber <> 2) END, 6) AS l_tax FROM lineitem")


@query("x16_label_codes", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def _(spark, d):
    return X.encode_labels(table(spark, d, "customer"), "c_mktsegment", "code").select("c_custkey", "code")


@query("x18_strings", "SELECT p_partkey, upper(p_name) AS u, trim(replace(p_type, ' ', '_')) AS t, string_split(p_brand, '#')[1] AS b, substring(p_name, 2, 3) AS s, printf('%05d', p_partkey) AS f FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.trim(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("t"), F.split("p_brand", "#")[0].alias("b"), F.substring("p_name", 2, 3).alias("s"), F.format_string("%05d", "p_partkey").alias("f"))


@query("x19_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, (o_orderdate::DATE - 7) AS before, try_cast(substring(strftime(o_orderdate, '%Y-%m-%dT%H'), 1, 10) AS DATE) AS parsed FROM orders")
def _(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH")
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.date_sub("o_orderdate", 7).alias("before"), F.to_date(F.substring(iso, 1, 10)).alias("parsed"))


@query("x20_arrays", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding[1:8])::INT AS n, len(list_concat(embedding[1:3], [0.0::FLOAT, 0.0]))::INT AS padded FROM embeddings")
def _(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(e, 1).cast("double"), 6).alias("first"), F.size(F.slice(e, 1, 8)).alias("n"), F.size(F.concat(F.slice(e, 1, 3), F.array_repeat(F.lit(0.0).cast("float"), 2))).alias("padded"))


@query("x21_json", "SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# sinks and stores whose result is a table


@query("k07_store_objects", "SELECT sum((c_custkey % 5 <> 0)::INT)::BIGINT AS updated, sum((c_custkey % 5 = 0)::INT)::BIGINT AS inserted FROM customer WHERE c_custkey % 3 = 0")
def _(spark, d):
    c = table(spark, d, "customer")
    return R.upsert_counts(c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 3 = 0"), "c_custkey")


@query("k10_documents", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, d):
    o = table(spark, d, "orders")
    return R.delete(R.set_fields(o, F.col("o_orderstatus") == "P", o_orderpriority="pending"), F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderpriority")


@query("k11_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def _(spark, d):
    return spark.sql("select o_orderkey from {o} where o_totalprice > :p and o_orderstatus = :s", args={"p": 300000, "s": "O"}, o=table(spark, d, "orders"))


@query("k15_bibtex", "SELECT c_custkey::VARCHAR AS bibcode, '@article{' || c_custkey || ',' || chr(10) || '  author = {' || c_mktsegment || '},' || chr(10) || '  title = {' || c_name || '},' || chr(10) || '  year = {2020}' || chr(10) || '}' AS bibtex FROM customer")
def _(spark, d):
    return R.bibtex(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("bibcode"), F.col("c_mktsegment").alias("author"), F.col("c_name").alias("title"), F.lit(2020).alias("year")))


@query("k17_expired", f"SELECT event_id FROM events WHERE ts < {NOW} - INTERVAL 5 DAY")
def _(spark, d):
    return R.older_than(table(spark, d, "events"), "ts", F.expr(NOW.lower()), 5).select("event_id")


@query("a08_key_values", "SELECT count(DISTINCT event_type)::BIGINT AS n FROM events")
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))
    return R.key_value_map(e, "event_type", "n", "at").select(F.size("statistics").cast("long").alias("n"))


@query("a09_describe_all", "SELECT 'p_size' AS \"column\", count(p_size) AS count, count(DISTINCT p_size) AS \"unique\", round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS std, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max FROM part")
def _(spark, d):
    out = R.describe_all(table(spark, d, "part")).filter(F.col("column") == "p_size")
    return out.select("column", "count", "unique", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("a16_stage_counts", f"SELECT count(*)::BIGINT AS before, count(*) FILTER (redshift BETWEEN 0.1 AND 0.5)::BIGINT AS after FROM {CATALOG}")
def _(spark, d):
    return catalog(spark, d).agg(F.count(F.lit(1)).alias("before"), F.count_if(C.in_range("redshift", 0.1, 0.5)).alias("after"))


@query("f11_lattice_remap", f"SELECT object_id, round(mag_g * 7.2 + 0.5, 6) AS ra FROM (SELECT DISTINCT * FROM {CATALOG}) WHERE mag_g BETWEEN 15 AND 30")
def _(spark, d):
    kept = C.filter_ranges(catalog(spark, d), mag_g=(15, 30)).dropDuplicates()
    return kept.select("object_id", F.round(F.col("mag_g") * 7.2 + 0.5, 6).alias("ra"))


@query("k08_cache_upsert", f"SELECT event_type AS cache_key, max(value) AS cache_value, {NOW} + INTERVAL 24 HOUR AS expires_at FROM events GROUP BY 1")
def _(spark, d):
    new = table(spark, d, "events").groupBy(F.col("event_type").alias("cache_key")).agg(F.max("value").alias("cache_value"))
    fresh = R.with_expiry(new, F.expr(NOW.lower()), 24)
    return R.upsert(fresh.withColumn("cache_value", F.lit(0.0)), fresh, "cache_key").select("cache_key", "cache_value", "expires_at")
