"""V-2: execution accuracy -- run gold and predicted SQL statements and
compare their results.

Each statement is a Spark SQL query over the star-schema views.  Its result
is written, in its order, to the shared folder as (place, row of normalized
values); one job over all results then compares them as lists
(``evaluate.result_equality``).  Columns count by position, numbers by value
whatever their type, NULL only equals NULL.  The driver holds statements and
their errors, never result rows; either side failing makes a pair incorrect.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fiscus.operators.evaluate import result_equality
from fiscus.operators.ingest import row_number_in_group
from fiscus.plans.registry import register
from fiscus.plans.star import CONCEPT, COUNTRY, PERCENT_OF_GDP, SECTOR, UNIT, Star, with_star
from fiscus.session import ensure_checkpoint_dir

col = F.col

RESULT_SCHEMA = "place long, row array<string>"


def normalized(result: DataFrame) -> DataFrame:
    """(place, row): places grow in result order, values are comparable text."""
    named = result.toDF(*[f"c{i}" for i in range(len(result.columns))])
    values = [(col(f.name).cast("double") if isinstance(f.dataType, NumericType) else col(f.name)).cast("string")
              for f in named.schema.fields]
    return named.select(F.monotonically_increasing_id().alias("place"), F.array(*values).alias("row"))


def _store(spark: SparkSession, sql: str, path: str) -> str | None:
    """Write one result; the error text if the statement fails."""
    try:
        normalized(spark.sql(sql)).write.mode("overwrite").parquet(path)
        return None
    except Exception as e:  # noqa: BLE001 -- an error is an outcome to record
        spark.createDataFrame([], RESULT_SCHEMA).write.mode("overwrite").parquet(path)
        return f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"


def evaluate_pairs(spark: SparkSession, pairs: Sequence[tuple[int, str, str, str, str]],
                   parallelism: int = 4) -> DataFrame:
    """``pairs``: (id, difficulty, category, gold_sql, predicted_sql) ->
    one outcome row per id."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex[:12]}"
    todo = [(sql, f"{out}/id={p[0]}/side={side}") for p in pairs for side, sql in (("gold", p[3]), ("pred", p[4]))]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        errors = list(pool.map(lambda job: _store(spark, *job), todo))
    asked = spark.createDataFrame(
        [(p[0], p[1], p[2], errors[2 * i], errors[2 * i + 1]) for i, p in enumerate(pairs)],
        "id long, difficulty string, category string, gold_error string, execution_error string")
    rows = spark.read.schema(f"{RESULT_SCHEMA}, id long, side string").parquet(out)
    same = result_equality(row_number_in_group(rows, ["id", "side"], ["place"], "pos"), key="id")
    ran, gold_ran = col("execution_error").isNull(), col("gold_error").isNull()
    equal = F.coalesce(col("ordered_equal"), F.lit(True))  # no row on either side
    return (asked.join(same, "id", "left")
            .select("id", "difficulty", "category", ran.alias("execution_success"),
                    (ran & gold_ran & equal).alias("is_correct"),
                    F.when(ran, F.coalesce("n_pred", F.lit(0))).alias("pred_rows"),
                    F.when(gold_ran, F.coalesce("n_gold", F.lit(0))).alias("gold_rows"), "execution_error"))


GFS = ("gfs_observations g JOIN countries c ON g.country_id = c.country_id "
       "JOIN sectors s ON g.sector_id = s.sector_id JOIN indicators i ON g.indicator_id = i.indicator_id")
GEM = ("gem_observations g JOIN countries c ON g.country_id = c.country_id "
       "JOIN indicators i ON g.indicator_id = i.indicator_id")
GG, PCT = SECTOR["General government"], PERCENT_OF_GDP
REV, EXP, TAX = CONCEPT["Revenue"], CONCEPT["Expenditure"], CONCEPT["Taxes"]


def _total(pred: str, name: str) -> str:
    return f"ROUND(SUM(CASE WHEN {pred} THEN g.value ELSE 0 END), 4) AS {name}"


def _series(country: str, concept: str, unit: str) -> str:
    return (f"SELECT g.year, ROUND(SUM(g.value), 4) AS v FROM {GEM} WHERE c.country_name = '{country}' "
            f"AND i.indicator_name LIKE '{concept}' AND i.unit = '{unit}' GROUP BY g.year ORDER BY g.year")


_PIVOT = (f"SELECT g.year, {{}} FROM {GFS} WHERE c.country_name = '{COUNTRY['Brazil']}' AND g.transformation = '{PCT}' "
          "AND g.year BETWEEN 1996 AND 2000 GROUP BY g.year ORDER BY g.year")
_CENTRAL = f"s.sector_name = '{SECTOR['Central government including social security']}'"
_LOCAL = f"s.sector_name = '{SECTOR['Local Government']}'"
_RATE = (f"SELECT c.country_name, ROUND(SUM(g.value), 4) AS v FROM {GEM} WHERE i.indicator_name LIKE "
         f"'{CONCEPT['Unemployment Rate']}' AND g.year = {{}} GROUP BY c.country_name HAVING SUM(g.value) > {{}} ORDER BY 1")
_BALANCE = (f"SELECT c.country_name AS k, SUM(CASE WHEN i.indicator_name LIKE '{REV}' THEN g.value ELSE 0 END) AS a, "
            f"SUM(CASE WHEN i.indicator_name LIKE '{EXP}' THEN g.value ELSE 0 END) AS b FROM {GFS} "
            f"WHERE s.sector_name = '{GG}' AND g.transformation = '{PCT}' AND g.year = 1998 GROUP BY c.country_name")
_TAXES = (f"SELECT c.country_name AS k, SUM(g.value) AS v FROM {GFS} WHERE i.indicator_name LIKE '{TAX}' "
          f"AND s.sector_name = '{GG}' AND g.year = 1998 GROUP BY c.country_name")

# Analog of the 21 benchmark statements: (id, difficulty, category, columns,
# gold, predicted, whether the prediction fails).  Predictions are rewrites,
# wrong filters, wrong orders and errors.
STATEMENTS = [
    (1, "simple", "select_all", 1, "SELECT sector_name FROM sectors ORDER BY sector_name",
     "SELECT DISTINCT sector_name FROM sectors ORDER BY 1", False),
    (2, "simple", "count", 1, "SELECT COUNT(*) AS n FROM gem_observations", "SELECT COUNT(1) FROM gem_observations", False),
    (3, "simple", "max", 1, "SELECT MAX(year) AS y FROM gem_observations", "SELECT MIN(year) AS y FROM gem_observations", False),
    (4, "simple", "pattern_match", 1,
     "SELECT country_name FROM countries WHERE country_name ILIKE 'nation_1%' ORDER BY country_name",
     "SELECT country_name FROM countries WHERE country_name LIKE 'nation_1%' ORDER BY country_name", False),
    (5, "simple", "min", 1, "SELECT MIN(year) AS y FROM gfs_observations",
     "SELECT CAST(MIN(year) AS DOUBLE) FROM gfs_observations", False),
    (6, "simple", "count_filtered", 1, f"SELECT COUNT(*) AS n FROM gfs_observations WHERE transformation = '{PCT}'",
     f"SELECT COUNT(*) FROM gfs_observations WHERE transformation == '{PCT}'", False),
    (7, "medium", "star_series", 2, _PIVOT.format("ROUND(SUM(g.value), 4) AS v"),
     _PIVOT.format("ROUND(SUM(g.value), 4) AS v").replace("ORDER BY g.year", "ORDER BY g.year DESC"), False),
    (8, "medium", "join_series", 2, _series(COUNTRY["United States"], CONCEPT["GDP"], UNIT["constant 2010 US$, millions"]),
     _series(COUNTRY["United States"], CONCEPT["GDP"], UNIT["constant 2010 US$, millions"]).replace("AS v", "AS gdp"), False),
    (9, "medium", "join_series", 2, _series(COUNTRY["India"], CONCEPT["CPI Price"], UNIT["% y-o-y, nominal"]),
     _series(COUNTRY["China"], CONCEPT["CPI Price"], UNIT["% y-o-y, nominal"]), False),
    (10, "medium", "join_series", 2, _series(COUNTRY["Japan"], CONCEPT["Stock Markets"], UNIT["% y-o-y, nominal"]),
     _series(COUNTRY["Japan"], CONCEPT["Stock Markets"], UNIT["% y-o-y, nominal"]).replace("i.unit", "i.units"), True),
    (11, "medium", "range_filter", 2, _RATE.format(1998, 45), _RATE.format(1998, 45).replace("ORDER BY 1", "ORDER BY c.country_name"), False),
    (12, "medium", "join_aggregation_limit", 2,
     "SELECT c.country_name, COUNT(*) AS n FROM gem_observations g JOIN countries c ON g.country_id = c.country_id "
     "GROUP BY c.country_name ORDER BY n DESC, c.country_name LIMIT 5",
     "SELECT c.country_name, COUNT(g.year) AS k FROM gem_observations g JOIN countries c ON g.country_id = c.country_id "
     "GROUP BY c.country_name ORDER BY k DESC, c.country_name LIMIT 5", False),
    (13, "medium", "no_rows", 1, "SELECT country_name FROM countries WHERE country_name = 'Atlantis'",
     "SELECT sector_name FROM sectors WHERE sector_name = 'Atlantis'", False),
    (14, "medium", "aggregation", 2,
     "SELECT year, COUNT(DISTINCT country_id) AS n FROM gem_observations GROUP BY year ORDER BY year",
     "SELECT year, COUNT(country_id) AS n FROM gem_observations GROUP BY year ORDER BY year", False),
    (15, "medium", "sum", 1, "SELECT ROUND(SUM(value), 2) AS v FROM gfs_observations WHERE year = 1998",
     "SELECT ROUND(SUM(CASE WHEN year = 1998 THEN value END), 2) AS v FROM gfs_observations", False),
    (16, "medium", "distinct_join", 1,
     f"SELECT DISTINCT c.country_name FROM {GFS} WHERE i.indicator_name LIKE '{TAX}' AND g.year = 1998 ORDER BY c.country_name",
     f"SELECT c.country_name FROM {GFS} WHERE i.indicator_name LIKE '{TAX}' AND g.year = 1998 ORDER BY c.country_name", False),
    (17, "medium", "join_aggregation", 2,
     f"SELECT s.sector_name, ROUND(AVG(g.value), 4) AS v FROM {GFS} WHERE g.year = 1998 GROUP BY s.sector_name ORDER BY s.sector_name",
     f"SELECT s.sector_name, AVG(g.observation_value) FROM {GFS} WHERE g.year = 1998 GROUP BY s.sector_name", True),
    (18, "hard", "union_aggregation", 3,
     "SELECT c.country_name, SUM(x.gfs) AS n_gfs, COUNT(*) AS n FROM (SELECT country_id, 1 AS gfs FROM gfs_observations "
     "UNION ALL SELECT country_id, 0 FROM gem_observations) x JOIN countries c ON x.country_id = c.country_id "
     "GROUP BY c.country_name ORDER BY n DESC, c.country_name LIMIT 5",
     "SELECT c.country_name, COUNT(*) AS n_gfs, COUNT(*) AS n FROM gfs_observations g JOIN countries c "
     "ON g.country_id = c.country_id GROUP BY c.country_name ORDER BY n DESC, c.country_name LIMIT 5", False),
    (19, "hard", "correlation", 2, f"SELECT COUNT(*) AS n, ROUND(CORR(a, b), 4) AS r FROM ({_BALANCE}) t WHERE a > 0 AND b > 0",
     f"SELECT COUNT(k), ROUND(CORR(b, a), 4) FROM ({_BALANCE}) t WHERE b > 0 AND a > 0", False),
    (20, "hard", "deviation", 2,
     f"SELECT t.k, ROUND(t.v - m.v, 4) AS d FROM ({_TAXES}) t CROSS JOIN (SELECT AVG(v) AS v FROM ({_TAXES}) u) m ORDER BY t.k",
     f"SELECT k, ROUND(v - AVG(v) OVER (), 4) AS d FROM ({_TAXES}) t ORDER BY k", False),
    (21, "hard", "pivot", 3, _PIVOT.format(_total(_CENTRAL, "ce") + ", " + _total(_LOCAL, "lo")),
     _PIVOT.format(_total(_LOCAL, "lo") + ", " + _total(_CENTRAL, "ce")), False),
]


def _oracle() -> str:
    """Both results of each pair as ordered lists of normalized rows."""
    def rows(sql: str, n: int) -> str:
        cells = ", ".join(f"COALESCE(CAST(TRY_CAST(c{i} AS DOUBLE) AS VARCHAR), CAST(c{i} AS VARCHAR))" for i in range(n))
        return (f"(SELECT COALESCE(list([{cells}]), []) FROM ({sql}) "
                f"r({', '.join(f'c{i}' for i in range(n))}))")
    parts = []
    for qid, difficulty, category, n, gold, pred, fails in STATEMENTS:
        p = "NULL" if fails else rows(pred, n)
        parts.append(f"SELECT {qid} AS id, '{difficulty}' AS difficulty, '{category}' AS category, "
                     f"{rows(gold, n)} AS g, {p} AS p")
    return with_star("""
SELECT CAST(id AS BIGINT) AS id, difficulty, category, p IS NOT NULL AS execution_success,
       COALESCE(g = p, FALSE) AS is_correct, len(p) AS pred_rows, len(g) AS gold_rows
FROM (""" + "\nUNION ALL\n".join(parts) + ") o")


@register("execution_accuracy", _oracle())
def execution_accuracy(spark, sf):
    """Every (gold, predicted) pair run on the star views of ``sf``.  The
    facts are joined once, and each statement reads them by year."""
    star = Star(spark, sf)
    if not star.stored:
        star = star.stored_under(f"{ensure_checkpoint_dir(spark).rstrip('/')}/star-{uuid.uuid4().hex[:12]}")
    star.register_views()
    pairs = [(qid, difficulty, category, gold, pred) for qid, difficulty, category, _, gold, pred, _ in STATEMENTS]
    return evaluate_pairs(spark, pairs).drop("execution_error")
