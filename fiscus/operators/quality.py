"""L2 data quality: checks over the star schema -> one report DataFrame.

Every check is an aggregate (no driver loops over rows); the report is the
union of per-check rows, so the whole validation is a single Spark job
graph.  Severity follows the reference: only missing tables, empty tables
and orphan keys fail; NULLs and duplicates warn.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.plans.registry import register
from fiscus.plans.star import Star, with_star

col = F.col

EXPECTED_TABLES = ("countries", "time_periods", "sectors", "indicators",
                   "gfs_observations", "gem_observations")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def star_tables(S: Star) -> dict[str, DataFrame]:
    return {"countries": S.countries(), "time_periods": S.time_periods(), "sectors": S.sectors(),
            "indicators": S.indicators(), "gfs_observations": S.gfs(), "gem_observations": S.gem()}


# ---------------------------------------------------------------- Q1 / Q2
def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Q2: one row per table with its row count."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(name).alias("table_name"), "row_count")
                   for name, df in tables.items()])


# Star tables and the driver tables they are derived from.
DERIVED_FROM = {
    "countries": ["nation", "region"], "time_periods": ["orders"], "sectors": ["customer"], "indicators": ["part"],
    "gfs_observations": ["lineitem", "orders", "customer"], "gem_observations": ["lineitem", "supplier"]}


def stored_tables(spark: SparkSession, root: str) -> DataFrame:
    """Names of the tables under ``root``, from the file listing alone."""
    name = F.regexp_extract("path", rf"/\Q{root.rstrip('/').rsplit('/', 1)[-1]}\E/([^/]+)", 1)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select(F.regexp_replace(name, r"\.parquet$", "").alias("stored")).distinct())


def table_presence(S: Star) -> DataFrame:
    """Q1: expected tables against the listing of the store; a derived table
    is present when all its source tables are."""
    needs = {t: [t] for t in EXPECTED_TABLES} if S.stored else DERIVED_FROM
    exp = S.spark.createDataFrame([(t, s) for t in EXPECTED_TABLES for s in needs[t]], "table_name string, source string")
    found = stored_tables(S.spark, S.stored or S.t.root)
    return (exp.join(found, col("source") == col("stored"), "left").groupBy("table_name")
            .agg(F.every(col("stored").isNotNull()).alias("present")))


# ---------------------------------------------------------------- Q3
def orphan_counts(fks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Q3: ``(name, child, child_col, parent, parent_col)`` -> orphan rows.

    NULL child keys are not orphans (nullable FK).  ``left_anti`` is the
    null-safe form of the reference's NOT IN (which returns nothing when
    the subquery holds a NULL).

    All checks run as one plan: every child frame is scanned once and
    unpivoted to (foreign_key, key), collapsed to (foreign_key, key, rows)
    with map-side partial aggregation, and anti-joined once against the
    union of the parents' distinct keys tagged with the same foreign-key
    name -- the join works on distinct key values, not on fact rows.
    """
    by_child: dict[int, tuple[DataFrame, list[tuple[str, str]]]] = {}
    for name, child, ccol, _, _ in fks:
        by_child.setdefault(id(child), (child, []))[1].append((name, ccol))
    keyed = _union([
        child.select(F.explode(F.array(*[F.struct(F.lit(n).alias("foreign_key"),
                                                  col(c).cast("bigint").alias("_k"))
                                         for n, c in cols])).alias("_x")).select("_x.*")
        for child, cols in by_child.values()])
    per_key = (keyed.where(col("_k").isNotNull())
               .groupBy("foreign_key", "_k").agg(F.count(F.lit(1)).alias("_n")))
    parents = _union([parent.select(F.lit(name).alias("foreign_key"), col(pcol).cast("bigint").alias("_k"))
                      .where(col("_k").isNotNull()).distinct()
                      for name, _, _, parent, pcol in fks])
    orph = (per_key.join(parents, ["foreign_key", "_k"], "left_anti")
            .groupBy("foreign_key").agg(F.sum("_n").cast("bigint").alias("orphans")))
    spark = fks[0][1].sparkSession
    names = spark.createDataFrame([(n,) for n, *_ in fks], "foreign_key string")  # one row per check
    return (names.join(orph, "foreign_key", "left")
            .select("foreign_key", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans")))


def star_foreign_keys(S: Star):
    t = star_tables(S)
    g, m = t["gfs_observations"], t["gem_observations"]
    return [
        ("gfs.country_id", g, "country_id", t["countries"], "country_id"),
        ("gfs.sector_id", g, "sector_id", t["sectors"], "sector_id"),
        ("gfs.indicator_id", g, "indicator_id", t["indicators"], "indicator_id"),
        ("gfs.year", g, "year", t["time_periods"], "year"),
        ("gem.country_id", m, "country_id", t["countries"], "country_id"),
        ("gem.indicator_id", m, "indicator_id", t["indicators"], "indicator_id"),
        ("gem.year", m, "year", t["time_periods"], "year"),
    ]


# ---------------------------------------------------------------- Q4 / Q5
def null_counts(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Q4: NULL count per column, one pass."""
    wide = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in cols])
    return (wide.unpivot([], list(cols), "column_name", "nulls")
                .select(F.lit(table).alias("table_name"), "column_name",
                        col("nulls").cast("bigint").alias("nulls")))


def year_range(df: DataFrame, table: str, c: str = "year") -> DataFrame:
    """Q5: min / max year coverage."""
    return df.agg(F.min(c).alias("min_year"), F.max(c).alias("max_year")).select(
        F.lit(table).alias("table_name"), "min_year", "max_year")


# ---------------------------------------------------------------- Q6
def duplicate_groups(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Q6: number of key groups with more than one row, and rows in them.

    NULLs in key columns group together (SQL GROUP BY semantics)."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(col("_n") > 1)
    return g.agg(F.count(F.lit(1)).alias("duplicate_groups"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("duplicate_rows")).select(
        F.lit(table).alias("table_name"), "duplicate_groups", "duplicate_rows")


GFS_DUP_KEY = ("country_id", "year", "sector_id", "indicator_id")
GEM_DUP_KEY = ("country_id", "year", "indicator_id")


# ---------------------------------------------------------------- Q7
def summary(S: Star) -> DataFrame:
    """Q7: distinct country names, indicator counts by source."""
    c = S.countries().agg(F.countDistinct("country_name").alias("n")).select(
        F.lit("countries").alias("metric"), "n")
    i = (S.indicators().groupBy("source").agg(F.count(F.lit(1)).alias("n"))
         .select(F.concat(F.lit("indicators_"), col("source")).alias("metric"), "n"))
    return c.unionByName(i)


# ---------------------------------------------------------------- Q8
REPORT_ROW = "check string, subject string, key bigint, rows bigint, parent boolean"


def _report_rows(df: DataFrame, rows) -> DataFrame:
    """REPORT_ROW frames: each row of ``df`` becomes one row per entry (check,
    subject, key, rows, parent) of ``rows``, in one pass."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), key.cast("bigint").alias("key"),
                 n.cast("bigint").alias("rows"), F.lit(parent).alias("parent"))
        for check, subject, key, n, parent in rows])))


def fact_rows(fact: DataFrame, table: str, grain: Sequence[str], fks: dict[str, str]) -> DataFrame:
    """The counts a report needs of a fact, from one aggregate over its grain;
    ``fks`` names the foreign key of each column of the grain that has one."""
    per = fact.groupBy(*grain).agg(F.count(F.lit(1)).alias("n"), F.count_if(col("value").isNull()).alias("nulls"))
    none, n = F.lit(None), col("n")
    return _report_rows(per, [("row_count", table, none, n, False), ("nulls", f"{table}.value", none, col("nulls"), False),
                              ("duplicate_groups", table, none, (n > 1), False)]
                        + [("orphans", fk, col(c), n, False) for c, fk in fks.items()])


def dimension_rows(dim: DataFrame, table: str, key: str, fks: Sequence[str]) -> DataFrame:
    """A dimension's row count, and its keys as parents of ``fks``."""
    return _report_rows(dim, [("row_count", table, F.lit(None), F.lit(1), False)]
                        + [("orphans", fk, col(key), F.lit(0), True) for fk in fks])


def report(S: Star) -> DataFrame:
    """Q8: every check as (check, subject, value, severity, passed).

    Each table is read once.  Parents and children of a foreign key meet by
    (foreign key, key) in one aggregate: a key with child rows and no parent
    is an orphan.  Rows of zeros stand for checks of empty tables.
    """
    t = star_tables(S)
    frames = [
        fact_rows(t["gfs_observations"], "gfs_observations", GFS_DUP_KEY,
                  {c: f"gfs.{c}" for c in ("country_id", "sector_id", "indicator_id", "year")}),
        fact_rows(t["gem_observations"], "gem_observations", GEM_DUP_KEY,
                  {c: f"gem.{c}" for c in ("country_id", "indicator_id", "year")}),
        dimension_rows(t["countries"], "countries", "country_id", ["gfs.country_id", "gem.country_id"]),
        dimension_rows(t["sectors"], "sectors", "sector_id", ["gfs.sector_id"]),
        dimension_rows(t["indicators"], "indicators", "indicator_id", ["gfs.indicator_id", "gem.indicator_id"]),
        dimension_rows(t["time_periods"], "time_periods", "year", ["gfs.year", "gem.year"])]
    zeros = S.spark.createDataFrame(
        [("row_count", name, None, 0, False) for name in EXPECTED_TABLES]
        + [(check, subject, None, 0, False) for fact in ("gfs_observations", "gem_observations")
           for check, subject in (("nulls", f"{fact}.value"), ("duplicate_groups", fact))]
        + [("orphans", f"gfs.{c}", None, 0, False) for c in GFS_DUP_KEY]
        + [("orphans", f"gem.{c}", None, 0, False) for c in GEM_DUP_KEY], REPORT_ROW)
    per_key = (_union([*frames, zeros]).groupBy("check", "subject", "key")
               .agg(F.sum("rows").alias("rows"), F.bool_or("parent").alias("parent")))
    counted = F.when((col("check") == "orphans") & (col("parent") | col("key").isNull()), 0).otherwise(col("rows"))
    checks = per_key.groupBy("check", "subject").agg(F.sum(counted).cast("bigint").alias("value"))
    fails = col("check").isin("row_count", "orphans")
    pres = table_presence(S)
    return pres.select(F.lit("table_present").alias("check"), col("table_name").alias("subject"),
                       col("present").cast("bigint").alias("value"), F.lit("error").alias("severity"),
                       col("present").alias("passed")).unionByName(
        checks.select("check", "subject", "value", F.when(fails, "error").otherwise("warning").alias("severity"),
                      F.when(col("check") == "row_count", col("value") > 0).otherwise(col("value") == 0).alias("passed")))


def overall(report_df: DataFrame) -> DataFrame:
    """Roll-up: the database passes iff every error-severity check passes."""
    return report_df.agg(
        F.bool_and(F.when(col("severity") == "error", col("passed")).otherwise(True)).alias("passed"),
        F.count_if(~col("passed") & (col("severity") == "error")).alias("errors"),
        F.count_if(~col("passed") & (col("severity") == "warning")).alias("warnings"))


# ================================================================ registered
_COUNTS_SQL = """
SELECT 'countries' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM countries
UNION ALL SELECT 'time_periods', CAST(COUNT(*) AS BIGINT) FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) t
UNION ALL SELECT 'sectors', CAST(COUNT(*) AS BIGINT) FROM sectors
UNION ALL SELECT 'indicators', CAST(COUNT(*) AS BIGINT) FROM indicators
UNION ALL SELECT 'gfs_observations', CAST(COUNT(*) AS BIGINT) FROM gfs_observations
UNION ALL SELECT 'gem_observations', CAST(COUNT(*) AS BIGINT) FROM gem_observations"""


@register("dq_counts", with_star(_COUNTS_SQL))
def dq_counts(spark, sf):
    return table_counts(star_tables(Star(spark, sf)))


@register("dq_tables", with_star(f"""
SELECT table_name, TRUE AS present FROM ({_COUNTS_SQL}) c"""))
def dq_tables(spark, sf):
    return table_presence(Star(spark, sf))


_TP = "(SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"


def _orph_sql(name, child, ccol, parent, pcol):
    return (f"SELECT '{name}' AS foreign_key, CAST(COUNT(*) AS BIGINT) AS orphans FROM {child} x "
            f"WHERE x.{ccol} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pcol} = x.{ccol})")


@register("dq_orphans", with_star("\nUNION ALL\n".join([
    _orph_sql("gfs.country_id", "gfs_observations", "country_id", "countries", "country_id"),
    _orph_sql("gfs.sector_id", "gfs_observations", "sector_id", "sectors", "sector_id"),
    _orph_sql("gfs.indicator_id", "gfs_observations", "indicator_id", "indicators", "indicator_id"),
    _orph_sql("gfs.year", "gfs_observations", "year", _TP, "year"),
    _orph_sql("gem.country_id", "gem_observations", "country_id", "countries", "country_id"),
    _orph_sql("gem.indicator_id", "gem_observations", "indicator_id", "indicators", "indicator_id"),
    _orph_sql("gem.year", "gem_observations", "year", _TP, "year"),
])))
def dq_orphans(spark, sf):
    return orphan_counts(star_foreign_keys(Star(spark, sf)))


@register("dq_nulls", with_star("""
SELECT 'gfs_observations' AS table_name, 'value' AS column_name,
       CAST(COUNT(*) FILTER (WHERE value IS NULL) AS BIGINT) AS nulls FROM gfs_observations
UNION ALL
SELECT 'gfs_observations', 'sector_id', CAST(COUNT(*) FILTER (WHERE sector_id IS NULL) AS BIGINT)
FROM gfs_observations
UNION ALL
SELECT 'gem_observations', 'value', CAST(COUNT(*) FILTER (WHERE value IS NULL) AS BIGINT)
FROM gem_observations"""))
def dq_nulls(spark, sf):
    S = Star(spark, sf)
    return null_counts(S.gfs(), "gfs_observations", ["value", "sector_id"]).unionByName(
        null_counts(S.gem(), "gem_observations", ["value"]))


@register("dq_range", with_star("""
SELECT 'gfs_observations' AS table_name, MIN(year) AS min_year, MAX(year) AS max_year FROM gfs_observations
UNION ALL
SELECT 'gem_observations', MIN(year), MAX(year) FROM gem_observations"""))
def dq_range(spark, sf):
    S = Star(spark, sf)
    return year_range(S.gfs(), "gfs_observations").unionByName(year_range(S.gem(), "gem_observations"))


@register("dq_duplicates", with_star("""
SELECT 'gfs_observations' AS table_name, CAST(COUNT(*) AS BIGINT) AS duplicate_groups,
       CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT country_id, year, sector_id, indicator_id, COUNT(*) AS n FROM gfs_observations
      GROUP BY country_id, year, sector_id, indicator_id HAVING COUNT(*) > 1) d
UNION ALL
SELECT 'gem_observations', CAST(COUNT(*) AS BIGINT), CAST(COALESCE(SUM(n), 0) AS BIGINT)
FROM (SELECT country_id, year, indicator_id, COUNT(*) AS n FROM gem_observations
      GROUP BY country_id, year, indicator_id HAVING COUNT(*) > 1) d"""))
def dq_duplicates(spark, sf):
    S = Star(spark, sf)
    return duplicate_groups(S.gfs(), "gfs_observations", GFS_DUP_KEY).unionByName(
        duplicate_groups(S.gem(), "gem_observations", GEM_DUP_KEY))


@register("dq_summary", with_star("""
SELECT 'countries' AS metric, CAST(COUNT(DISTINCT country_name) AS BIGINT) AS n FROM countries
UNION ALL
SELECT 'indicators_' || source, CAST(COUNT(*) AS BIGINT) FROM indicators GROUP BY source"""))
def dq_summary(spark, sf):
    return summary(Star(spark, sf))


def _report_sql() -> str:
    orph = "\nUNION ALL\n".join([
        _orph_sql("gfs.country_id", "gfs_observations", "country_id", "countries", "country_id"),
        _orph_sql("gfs.sector_id", "gfs_observations", "sector_id", "sectors", "sector_id"),
        _orph_sql("gfs.indicator_id", "gfs_observations", "indicator_id", "indicators", "indicator_id"),
        _orph_sql("gfs.year", "gfs_observations", "year", _TP, "year"),
        _orph_sql("gem.country_id", "gem_observations", "country_id", "countries", "country_id"),
        _orph_sql("gem.indicator_id", "gem_observations", "indicator_id", "indicators", "indicator_id"),
        _orph_sql("gem.year", "gem_observations", "year", _TP, "year")])
    return with_star(f"""
SELECT 'table_present' AS "check", table_name AS subject, CAST(1 AS BIGINT) AS value,
       'error' AS severity, TRUE AS passed FROM ({_COUNTS_SQL}) c
UNION ALL
SELECT 'row_count', table_name, row_count, 'error', row_count > 0 FROM ({_COUNTS_SQL}) c
UNION ALL
SELECT 'orphans', foreign_key, orphans, 'error', orphans = 0 FROM ({orph}) o
UNION ALL
SELECT 'nulls', 'gfs_observations.value', n, 'warning', n = 0
FROM (SELECT CAST(COUNT(*) FILTER (WHERE value IS NULL) AS BIGINT) AS n FROM gfs_observations) a
UNION ALL
SELECT 'nulls', 'gem_observations.value', n, 'warning', n = 0
FROM (SELECT CAST(COUNT(*) FILTER (WHERE value IS NULL) AS BIGINT) AS n FROM gem_observations) a
UNION ALL
SELECT 'duplicate_groups', 'gfs_observations', CAST(COUNT(*) AS BIGINT), 'warning', COUNT(*) = 0
FROM (SELECT 1 FROM gfs_observations GROUP BY country_id, year, sector_id, indicator_id HAVING COUNT(*) > 1) d
UNION ALL
SELECT 'duplicate_groups', 'gem_observations', CAST(COUNT(*) AS BIGINT), 'warning', COUNT(*) = 0
FROM (SELECT 1 FROM gem_observations GROUP BY country_id, year, indicator_id HAVING COUNT(*) > 1) d""")


@register("dq_report", _report_sql())
def dq_report(spark, sf):
    """The union of all checks with severity and pass flag."""
    return report(Star(spark, sf))
