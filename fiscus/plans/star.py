"""The economic star schema, expressed over the driver's tables.

Reference schema (4 dimensions + 2 facts) and its analog:

  countries        nation JOIN region
  sectors          distinct customer.c_mktsegment, ids in sorted-name order
  indicators       part (id p_partkey, code p_brand, name p_name, unit p_type)
  time_periods     distinct year(o_orderdate)
  gfs_observations lineitem JOIN orders JOIN customer (LEFT JOIN sectors)
  gem_observations lineitem JOIN supplier

Join strategy: no join carries a hint; AQE converts a join to broadcast at
runtime when the (filtered) side measures under
``spark.sql.autoBroadcastJoinThreshold``.

``materialize`` writes both facts once, partitioned by ``year``, so that at
scale every analytic query reads a pruned parquet fact instead of re-joining
lineitem with orders.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscus.sources.tables import Tables

# ---------------------------------------------------------------------------
# Fixed analog values: reference literal -> value in the driver's tables.
# These are the only constants that tie the analog queries to data values.
# ---------------------------------------------------------------------------
COUNTRY = {
    "Australia": "NATION_1",
    "Brazil": "NATION_2",
    "Singapore": "NATION_3",
    "United States": "NATION_4",
    "United Kingdom": "NATION_5",
    "Germany": "NATION_6",
    "Israel": "NATION_7",
    "India": "NATION_8",
    "China": "NATION_9",
    "Japan": "NATION_10",
    "South Africa": "NATION_12",
    "Chile": "NATION_20",
}
SECTOR = {
    "General government": "BUILDING",
    "State Government": "AUTOMOBILE",
    "Central government including social security": "MACHINERY",
    "Local Government": "HOUSEHOLD",
}
# 'Percent of GDP' transformation -> l_returnflag value
PERCENT_OF_GDP = "N"
# indicator concept -> LIKE pattern on indicator_name (p_name = '<adj> <noun>')
CONCEPT = {
    "Revenue": "% widget",
    "Expenditure": "% gear",
    "Taxes": "% bolt",
    "Social benefits": "% ring",
    "Net lending": "% rod",
    "Expense": "% plate",
    "GDP": "% anvil",
    "Unemployment Rate": "% gizmo",
    "Stock Markets": "% plate",
    "Terms of Trade": "% ring",
    "CPI Price": "% bolt",
}
# unit filters ('constant 2010 US$, millions', '% y-o-y, nominal') -> p_type
UNIT = {
    "constant 2010 US$, millions": "LARGE",
    "% y-o-y, nominal": "PROMO",
}
YEAR_MIN, YEAR_MAX = 1972, 2024


STAR_DIR_CONF = "fiscus.star.dir"


def source_folder(sf_dir: str) -> str:
    """Folder of a stored star under ``fiscus.star.dir``: named after the
    tables it was built from, so a star of other tables is never read."""
    return "source-" + hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:16]


class Star:
    """Lazy star-schema views over one scale-factor directory.

    When the session conf ``fiscus.star.dir`` names a folder written by
    ``materialize`` for the same inputs, the two facts are read from there
    (year-partitioned parquet: year predicates prune whole directories)
    instead of being re-joined from lineitem / orders / customer / supplier.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        root = spark.conf.get(STAR_DIR_CONF, None)
        self.stored = f"{root}/{source_folder(sf_dir)}" if root else None

    # -- dimensions -------------------------------------------------------
    def countries(self) -> DataFrame:
        if self.stored:
            return self._stored_dim("countries")
        n, r = self.t.nation, self.t.region
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                 .select(n.n_nationkey.cast("bigint").alias("country_id"),
                         n.n_name.alias("country_name"),
                         r.r_name.alias("region")))

    def sectors(self) -> DataFrame:
        if self.stored:
            return self._stored_dim("sectors")
        names = (self.t.customer.select(F.col("c_mktsegment").alias("sector_name"))
                 .where(F.col("sector_name").isNotNull()).distinct())
        # L4: surrogate ids in sorted-name order.  The input is the distinct
        # set of a low-cardinality code column, so the single-partition
        # window only ever sees a handful of rows.
        return names.select(
            F.row_number().over(Window.orderBy("sector_name")).cast("bigint").alias("sector_id"),
            "sector_name",
            F.lit(None).cast("string").alias("sector_description"))

    def indicators(self) -> DataFrame:
        if self.stored:
            return self._stored_dim("indicators")
        p = self.t.part
        return p.select(
            F.col("p_partkey").alias("indicator_id"),
            F.col("p_brand").alias("indicator_code"),
            F.col("p_name").alias("indicator_name"),
            F.when(F.col("p_partkey") % 2 == 0, "GFS").otherwise("GEM").alias("source"),
            F.col("p_type").alias("unit"),
            F.lit(None).cast("string").alias("description"))

    def time_periods(self) -> DataFrame:
        if self.stored:
            return self._stored_dim("time_periods")
        return (self.t.orders.select(F.year("o_orderdate").cast("int").alias("year"))
                .distinct())

    # -- facts ------------------------------------------------------------
    def gfs(self) -> DataFrame:
        if self.stored:
            return self._stored("gfs_observations")
        li = self.t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice",
                                    "l_returnflag", "l_linestatus")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        s = self.sectors().select("sector_id", F.col("sector_name").alias("_sector"))
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                  .join(c, o.o_custkey == c.c_custkey)
                  .join(s, c.c_mktsegment == s._sector, "left")
                  .select(F.col("c_nationkey").cast("bigint").alias("country_id"),
                          F.year("o_orderdate").cast("int").alias("year"),
                          F.col("sector_id"),
                          F.col("l_partkey").alias("indicator_id"),
                          F.col("l_extendedprice").alias("value"),
                          F.col("l_returnflag").alias("transformation"),
                          F.col("l_linestatus").alias("scale")))

    def gem(self) -> DataFrame:
        if self.stored:
            return self._stored("gem_observations")
        li = self.t.lineitem.select("l_suppkey", "l_partkey", "l_quantity",
                                    "l_linestatus", "l_shipdate")
        s = self.t.supplier.select("s_suppkey", "s_nationkey")
        return (li.join(s, li.l_suppkey == s.s_suppkey)
                  .select(F.col("s_nationkey").cast("bigint").alias("country_id"),
                          F.year("l_shipdate").cast("int").alias("year"),
                          F.col("l_partkey").alias("indicator_id"),
                          F.col("l_quantity").alias("value"),
                          (F.col("l_linestatus") == "F").alias("seasonal_adjustment")))

    GFS_COLS = ["country_id", "year", "sector_id", "indicator_id", "value", "transformation", "scale"]
    GEM_COLS = ["country_id", "year", "indicator_id", "value", "seasonal_adjustment"]

    DIM_COLS = {
        "countries": ["country_id", "country_name", "region"],
        "sectors": ["sector_id", "sector_name", "sector_description"],
        "indicators": ["indicator_id", "indicator_code", "indicator_name", "source", "unit", "description"],
        "time_periods": ["year"],
    }

    def _stored_dim(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.stored}/{name}").select(*self.DIM_COLS[name])

    def _stored(self, name: str) -> DataFrame:
        cols = self.GFS_COLS if name == "gfs_observations" else self.GEM_COLS
        df = self.spark.read.parquet(f"{self.stored}/{name}")
        return df.select(*[F.col(c).cast("int") if c == "year" else F.col(c) for c in cols])

    def materialize(self, out_dir: str) -> None:
        """Write the four dimensions and both facts once (overwrite);
        facts partitioned by year.

        No repartition by year (that would funnel a whole year into one
        task): every task sorts its own rows by year and writes one file per
        year it holds, with a single open writer at a time."""
        out_dir = f"{out_dir}/{source_folder(self.t.root)}"
        for name, dim in (("countries", self.countries()), ("sectors", self.sectors()),
                          ("indicators", self.indicators()), ("time_periods", self.time_periods())):
            dim.write.mode("overwrite").parquet(f"{out_dir}/{name}")
        for name, df in (("gfs_observations", self.gfs()), ("gem_observations", self.gem())):
            (df.sortWithinPartitions("year").write.mode("overwrite").partitionBy("year")
               .parquet(f"{out_dir}/{name}"))

    def stored_under(self, out_dir: str) -> Star:
        """This star, written under ``out_dir`` and read from there."""
        self.materialize(out_dir)
        kept = Star(self.spark, self.t.root)
        kept.stored = f"{out_dir}/{source_folder(self.t.root)}"
        return kept

    def register_views(self) -> None:
        """Temp views under the reference's table names, for ``spark.sql``."""
        self.countries().createOrReplaceTempView("countries")
        self.sectors().createOrReplaceTempView("sectors")
        self.indicators().createOrReplaceTempView("indicators")
        self.time_periods().createOrReplaceTempView("time_periods")
        self.gfs().createOrReplaceTempView("gfs_observations")
        self.gem().createOrReplaceTempView("gem_observations")


# Same definitions as SQL text, prefixed to the DuckDB oracle statements.
ORACLE_STAR_CTE = """
countries AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS country_id, n.n_name AS country_name, r.r_name AS region
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
sectors AS (
  SELECT CAST(row_number() OVER (ORDER BY sector_name) AS BIGINT) AS sector_id, sector_name,
         CAST(NULL AS VARCHAR) AS sector_description
  FROM (SELECT DISTINCT c_mktsegment AS sector_name FROM customer WHERE c_mktsegment IS NOT NULL) d),
indicators AS (
  SELECT p_partkey AS indicator_id, p_brand AS indicator_code, p_name AS indicator_name,
         CASE WHEN p_partkey % 2 = 0 THEN 'GFS' ELSE 'GEM' END AS source, p_type AS unit,
         CAST(NULL AS VARCHAR) AS description
  FROM part),
gfs_observations AS (
  SELECT CAST(c.c_nationkey AS BIGINT) AS country_id, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         s.sector_id, l.l_partkey AS indicator_id, l.l_extendedprice AS value,
         l.l_returnflag AS transformation, l.l_linestatus AS scale
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN sectors s ON c.c_mktsegment = s.sector_name),
gem_observations AS (
  SELECT CAST(s.s_nationkey AS BIGINT) AS country_id, CAST(year(l.l_shipdate) AS INTEGER) AS year,
         l.l_partkey AS indicator_id, l.l_quantity AS value,
         (l.l_linestatus = 'F') AS seasonal_adjustment
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)
"""


def with_star(body: str, extra_ctes: str = "") -> str:
    """Prefix an oracle statement with the star-schema CTEs."""
    ctes = ORACLE_STAR_CTE.strip()
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


# Catalog of the star schema: (table, column, type, ordinal), as exposed by
# ``Star``'s frames.  tests/test_star.py checks it against their schemas.
STAR_CATALOG = [
    ("countries", "country_id", "bigint", 1), ("countries", "country_name", "string", 2),
    ("countries", "region", "string", 3),
    ("time_periods", "year", "int", 1),
    ("sectors", "sector_id", "bigint", 1), ("sectors", "sector_name", "string", 2),
    ("sectors", "sector_description", "string", 3),
    ("indicators", "indicator_id", "bigint", 1), ("indicators", "indicator_code", "string", 2),
    ("indicators", "indicator_name", "string", 3), ("indicators", "source", "string", 4),
    ("indicators", "unit", "string", 5), ("indicators", "description", "string", 6),
    ("gfs_observations", "country_id", "bigint", 1), ("gfs_observations", "year", "int", 2),
    ("gfs_observations", "sector_id", "bigint", 3), ("gfs_observations", "indicator_id", "bigint", 4),
    ("gfs_observations", "value", "double", 5), ("gfs_observations", "transformation", "string", 6),
    ("gfs_observations", "scale", "string", 7),
    ("gem_observations", "country_id", "bigint", 1), ("gem_observations", "year", "int", 2),
    ("gem_observations", "indicator_id", "bigint", 3), ("gem_observations", "value", "double", 4),
    ("gem_observations", "seasonal_adjustment", "boolean", 5),
]
CATALOG_TABLES = sorted({t for t, _, _, _ in STAR_CATALOG})


def catalog_frame(spark: SparkSession) -> DataFrame:
    """The catalog as rows of the plan: the planner knows how small it is.  A
    frame made from Python rows counts as of any size, and joins send the other side."""
    return spark.sql(f"WITH {catalog_sql()} SELECT * FROM catalog")


def catalog_sql() -> str:
    """The catalog as a VALUES list for oracle statements."""
    rows = ", ".join(f"('{t}', '{c}', '{d}', {o})" for t, c, d, o in STAR_CATALOG)
    return f"catalog(table_name, column_name, data_type, ordinal) AS (VALUES {rows})"
