"""Registered ingest plans (L1-L15) over frames derived from the driver's
tables: the wide year-column file is the GFS analog pivoted by year, the
per-series matrix is one GEM series pivoted by country, series file names
are built from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions.agg import r4, total
from fiscus.operators import ingest as I
from fiscus.plans.econ import gem_star, gfs_star
from fiscus.plans.registry import register
from fiscus.plans.star import CONCEPT, Star, with_star

col = F.col
WIDE_IDS = ["COUNTRY", "SECTOR", "SERIES_CODE", "TYPE_OF_TRANSFORMATION"]


def _gfs_with_code(S: Star) -> DataFrame:
    g = gfs_star(S, i=False)
    ind = S.indicators().select("indicator_id", col("indicator_code").alias("_code"))
    return g.join(ind, "indicator_id")


def wide_gfs_frame(S: Star) -> DataFrame:
    g = _gfs_with_code(S)
    return (g.groupBy(col("country_name").alias("COUNTRY"), col("sector_name").alias("SECTOR"),
                      col("_code").alias("SERIES_CODE"),
                      col("transformation").alias("TYPE_OF_TRANSFORMATION"))
             .pivot("year").agg(total("value")))


WIDE_LONG_SQL = f"""
SELECT c.country_name AS COUNTRY, s.sector_name AS SECTOR, i.indicator_code AS SERIES_CODE,
       g.transformation AS TYPE_OF_TRANSFORMATION, g.year, ROUND(SUM(g.value), 4) AS value
FROM gfs_observations g
JOIN countries c ON g.country_id = c.country_id
JOIN sectors s ON g.sector_id = s.sector_id
JOIN indicators i ON g.indicator_id = i.indicator_id
GROUP BY c.country_name, s.sector_name, i.indicator_code, g.transformation, g.year"""


# ---------------------------------------------------------------- L1
@register("unpivot_years", with_star(WIDE_LONG_SQL))
def unpivot_years(spark, sf):
    wide = wide_gfs_frame(Star(spark, sf))
    return I.unpivot_years(wide, WIDE_IDS).withColumn("value", r4("value"))


# ---------------------------------------------------------------- L2
GDP = CONCEPT["GDP"]


@register("unpivot_entities", with_star(f"""
SELECT g.year, c.country_name, ROUND(SUM(g.value), 4) AS value
FROM gem_observations g
JOIN countries c ON g.country_id = c.country_id
JOIN indicators i ON g.indicator_id = i.indicator_id
WHERE i.indicator_name LIKE '{GDP}'
GROUP BY g.year, c.country_name"""))
def unpivot_entities(spark, sf):
    g = gem_star(Star(spark, sf)).where(col("indicator_name").like(GDP))
    # one matrix per series: rows = years, one column per country
    matrix = g.groupBy("year").pivot("country_name").agg(total("value"))
    countries = [c for c in matrix.columns if c != "year"]
    return I.unpivot_wide(matrix, ["year"], countries, "country_name", "value").withColumn("value", r4("value"))


# ---------------------------------------------------------------- L3
@register("dim_distinct", with_star(f"""
SELECT DISTINCT COUNTRY FROM ({WIDE_LONG_SQL}) w WHERE COUNTRY IS NOT NULL"""))
def dim_distinct(spark, sf):
    return I.distinct_values(gfs_star(Star(spark, sf)), "country_name", "COUNTRY")


# ---------------------------------------------------------------- L4
@register("dim_surrogate_key", """
SELECT CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS entity_id, c_name AS entity_name
FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL) d""")
def dim_surrogate_key(spark, sf):
    names = I.distinct_values(Star(spark, sf).t.customer, "c_name", "entity_name")
    return I.sorted_surrogate_key(names, "entity_name", "entity_id").select("entity_id", "entity_name")


# ---------------------------------------------------------------- L5
def indicator_dim_last_wins(S: Star) -> DataFrame:
    p = S.t.part.select(col("p_brand").alias("indicator_code"), col("p_name").alias("indicator_name"),
                        col("p_type").alias("unit"), col("p_partkey").alias("ord"))
    d = I.dedupe_last_wins(p, "indicator_code", "ord", ["indicator_name", "unit"])
    # ids in first-seen order (reference: dict insertion order)
    return (I.sorted_surrogate_key(d, "first_ord", "indicator_id")
            .select("indicator_id", "indicator_code", "indicator_name", "unit"))


DEDUPE_SQL = """
SELECT CAST(row_number() OVER (ORDER BY min(p_partkey)) AS BIGINT) AS indicator_id,
       p_brand AS indicator_code, arg_max(p_name, p_partkey) AS indicator_name,
       arg_max(p_type, p_partkey) AS unit
FROM part GROUP BY p_brand"""


@register("dedupe_last_wins", DEDUPE_SQL)
def dedupe_last_wins(spark, sf):
    return indicator_dim_last_wins(Star(spark, sf))


# ---------------------------------------------------------------- L6
EXISTING_REGIONS = ("AFRICA", "AMERICA")


@register("dim_insert_ignore", f"""
WITH existing AS (
  SELECT n.n_name AS country_name, r.r_name AS region
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE r.r_name IN ('AFRICA', 'AMERICA'))
SELECT country_name, region FROM existing
UNION ALL
SELECT DISTINCT n.n_name AS country_name, 'UNASSIGNED' AS region
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE n.n_name NOT IN (SELECT country_name FROM existing)""")
def dim_insert_ignore(spark, sf):
    S = Star(spark, sf)
    existing = (S.countries().where(col("region").isin(*EXISTING_REGIONS))
                .select("country_name", "region"))
    incoming = (S.t.supplier.join(S.t.nation, col("s_nationkey") == col("n_nationkey"))
                .select(col("n_name").alias("country_name"), F.lit("UNASSIGNED").alias("region"),
                        col("s_suppkey").alias("ord")))
    return I.insert_ignore(existing, incoming, "country_name", "ord")


# ---------------------------------------------------------------- L7
@register("dim_year_sequence", with_star("""
SELECT CAST(y AS INTEGER) AS year
FROM (SELECT unnest(generate_series(lo, hi)) AS y
      FROM (SELECT min(year) AS lo, max(year) AS hi FROM gem_observations) b) s"""))
def dim_year_sequence(spark, sf):
    return I.year_sequence(Star(spark, sf).gem())


# ---------------------------------------------------------------- L8
@register("fact_lookup_join", with_star(f"""
SELECT c.country_id, w.year, s.sector_id, d.indicator_id, w.value,
       w.TYPE_OF_TRANSFORMATION AS transformation
FROM ({WIDE_LONG_SQL}) w
JOIN countries c ON w.COUNTRY = c.country_name
JOIN ({DEDUPE_SQL}) d ON w.SERIES_CODE = d.indicator_code
LEFT JOIN sectors s ON w.SECTOR = s.sector_name"""))
def fact_lookup_join(spark, sf):
    S = Star(spark, sf)
    long = I.unpivot_years(wide_gfs_frame(S), WIDE_IDS)
    facts = I.lookup_facts(long, S.countries(), indicator_dim_last_wins(S), S.sectors(),
                           country_name="COUNTRY", indicator_code="SERIES_CODE", sector_name="SECTOR")
    return facts.select("country_id", "year", "sector_id", "indicator_id", r4("value").alias("value"),
                        col("TYPE_OF_TRANSFORMATION").alias("transformation"))


# ---------------------------------------------------------------- L9
@register("dim_upsert_offset", """
WITH dim AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS country_id, n.n_name AS country_name, r.r_name AS region
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE r.r_name IN ('AFRICA', 'AMERICA', 'ASIA')),
missing AS (
  SELECT DISTINCT n.n_name AS country_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE n.n_name NOT IN (SELECT country_name FROM dim))
SELECT country_id, country_name, region FROM dim
UNION ALL
SELECT CAST((SELECT max(country_id) FROM dim) + row_number() OVER (ORDER BY country_name) AS BIGINT),
       country_name, CAST(NULL AS VARCHAR)
FROM missing""")
def dim_upsert_offset(spark, sf):
    S = Star(spark, sf)
    dim = S.countries().where(col("region").isin("AFRICA", "AMERICA", "ASIA"))
    names = (S.t.customer.join(S.t.nation, col("c_nationkey") == col("n_nationkey"))
             .select(col("n_name").alias("country_name")))
    return I.upsert_with_offset(dim, names, "country_name", "country_id")


# ---------------------------------------------------------------- L10 / L11
FILE_NAME_SQL = ("p_name || ', ' || p_type || ' price, ' || p_brand || "
                 "CASE WHEN p_size % 2 = 0 THEN ', seas. adj.' ELSE ', not seas. adj.' END || '.csv'")


def series_file_names(S: Star) -> DataFrame:
    p = S.t.part
    return p.select("p_partkey", F.concat(
        col("p_name"), F.lit(", "), col("p_type"), F.lit(" price, "), col("p_brand"),
        F.when(col("p_size") % 2 == 0, ", seas. adj.").otherwise(", not seas. adj."),
        F.lit(".csv")).alias("file_name"))


@register("parse_series_name", f"""
WITH f AS (SELECT p_partkey, {FILE_NAME_SQL} AS file_name FROM part),
c AS (SELECT p_partkey, file_name, replace(file_name, '.csv', '') AS stem FROM f),
p AS (SELECT p_partkey, file_name, stem,
             list_transform(string_split(replace(replace(replace(stem, ', seas. adj.', ''),
                 ', not seas. adj.', ''), '..', '.'), ','), lambda x: trim(x)) AS parts
      FROM c)
SELECT p_partkey, file_name, parts[1] AS indicator_name,
       CASE WHEN len(parts) > 1 THEN array_to_string(list_slice(parts, 2, len(parts)), ', ') END AS unit,
       ((contains(lower(stem), 'seas. adj.') OR contains(lower(stem), 'seas adj'))
        AND NOT contains(lower(stem), 'not seas')) AS seasonal_adjustment
FROM p""")
def parse_series_name(spark, sf):
    f = series_file_names(Star(spark, sf))
    return f.select("p_partkey", "file_name", I.parse_series_name(col("file_name")).alias("p")).select(
        "p_partkey", "file_name", "p.indicator_name", "p.unit", "p.seasonal_adjustment")


@register("series_code", f"""
WITH f AS (SELECT p_partkey, {FILE_NAME_SQL} AS file_name FROM part)
SELECT p_partkey, 'GEM_' || substr(replace(replace(replace(file_name, '.csv', ''), ' ', '_'), ',', ''), 1, 50)
       AS indicator_code
FROM f""")
def series_code(spark, sf):
    f = series_file_names(Star(spark, sf))
    return f.select("p_partkey", I.series_code(col("file_name")).alias("indicator_code"))


# ---------------------------------------------------------------- L12 / L13
CELL_SQL = ("CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR) "
            "ELSE o_orderstatus || '-' || CAST(o_totalprice AS VARCHAR) END")


@register("safe_cast_reject", f"""
WITH cells AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS raw_year, {CELL_SQL} AS raw_value FROM orders),
typed AS (
  SELECT TRY_CAST(TRY_CAST(raw_year AS DOUBLE) AS INTEGER) AS y, TRY_CAST(raw_value AS DOUBLE) AS v,
         raw_value FROM cells)
SELECT COALESCE(CASE WHEN y IS NULL THEN 'bad_year'
                     WHEN y NOT BETWEEN 1972 AND 2024 THEN 'year_out_of_range'
                     WHEN raw_value IS NULL THEN 'empty_value'
                     WHEN v IS NULL THEN 'bad_value' END, 'accepted') AS status,
       CAST(COUNT(*) AS BIGINT) AS cells,
       ROUND(SUM(v), 4) AS accepted_value
FROM typed GROUP BY 1""")
def safe_cast_reject(spark, sf):
    o = Star(spark, sf).t.orders
    cells = o.select(
        F.year("o_orderdate").cast("string").alias("raw_year"),
        F.when(col("o_orderstatus") == "F", col("o_totalprice").cast("string"))
         .otherwise(F.concat(col("o_orderstatus"), F.lit("-"), col("o_totalprice").cast("string")))
         .alias("raw_value"))
    typed = I.safe_cast_reject(cells, "raw_year", "raw_value")
    return (typed.groupBy(F.coalesce(col("reject_reason"), F.lit("accepted")).alias("status"))
            .agg(F.count(F.lit(1)).alias("cells"), r4(total("value")).alias("accepted_value")))


# ---------------------------------------------------------------- L14
@register("load_summary", with_star("""
SELECT CAST(COUNT(*) AS BIGINT) AS rows,
       CAST(COUNT(DISTINCT country_id) AS BIGINT) AS distinct_country_id,
       CAST(COUNT(DISTINCT indicator_id) AS BIGINT) AS distinct_indicator_id,
       CAST(COUNT(DISTINCT year) AS BIGINT) AS distinct_year,
       CAST(COUNT(DISTINCT sector_id) AS BIGINT) AS distinct_sector_id
FROM gfs_observations"""))
def load_summary(spark, sf):
    return I.load_summary(Star(spark, sf).gfs(), ["country_id", "indicator_id", "year", "sector_id"])


# ---------------------------------------------------------------- L15
@register("constraint_report", with_star("""
SELECT 'countries' AS table_name, 'country_name not null' AS rule,
       CAST(COUNT(*) FILTER (WHERE country_name IS NULL) AS BIGINT) AS violations FROM countries
UNION ALL
SELECT 'countries', 'country_name unique',
       CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT)
FROM (SELECT country_name, COUNT(*) AS n FROM countries GROUP BY country_name) d
UNION ALL
SELECT 'sectors', 'sector_name unique',
       CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT)
FROM (SELECT sector_name, COUNT(*) AS n FROM sectors GROUP BY sector_name) d
UNION ALL
SELECT 'indicators', 'indicator_name not null',
       CAST(COUNT(*) FILTER (WHERE indicator_name IS NULL) AS BIGINT) FROM indicators
UNION ALL
SELECT 'indicators', 'source in (GFS, GEM)',
       CAST(COUNT(*) FILTER (WHERE NOT COALESCE(source IN ('GFS', 'GEM'), FALSE)) AS BIGINT) FROM indicators
UNION ALL
SELECT 'indicators', 'indicator_code unique',
       CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT)
FROM (SELECT indicator_code, COUNT(*) AS n FROM indicators GROUP BY indicator_code) d"""))
def constraint_report(spark, sf):
    S = Star(spark, sf)
    c, s, i = S.countries(), S.sectors(), S.indicators()

    def grouped(df, key, t, rule):
        return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                .agg(F.coalesce(F.sum(F.when(col("n") > 1, col("n"))), F.lit(0)).cast("bigint")
                     .alias("violations"))
                .select(F.lit(t).alias("table_name"), F.lit(rule).alias("rule"), "violations"))

    simple = I.constraint_report([
        ("countries", "country_name not null", c, col("country_name").isNotNull()),
        ("indicators", "indicator_name not null", i, col("indicator_name").isNotNull()),
        ("indicators", "source in (GFS, GEM)", i, col("source").isin("GFS", "GEM")),
    ])
    return (simple.unionByName(grouped(c, "country_name", "countries", "country_name unique"))
            .unionByName(grouped(s, "sector_name", "sectors", "sector_name unique"))
            .unionByName(grouped(i, "indicator_code", "indicators", "indicator_code unique")))
