"""Registered sources and sinks: driver rows are written to the session's
shared folder in the format of the sink, read back through the source, and
compared with the tables they came from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fiscus.operators import corpus as C
from fiscus.operators import evaluate as E
from fiscus.operators import ingest as I
from fiscus.operators.ingest_queries import WIDE_IDS, WIDE_LONG_SQL, wide_gfs_frame
from fiscus.functions.agg import r4, total
from fiscus.plans.econ import gem_star
from fiscus.plans.registry import ORACLE, register
from fiscus.plans.star import Star, with_star
from fiscus.session import ensure_checkpoint_dir
from fiscus.sources import files as S
from fiscus.sources.tables import Tables
from fiscus.streaming import ingest_stream as R

col = F.col


def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex[:12]}"


def _write_wide_csv(spark, sf, path: str) -> list[str]:
    wide = wide_gfs_frame(Star(spark, sf))
    years = sorted(c for c in wide.columns if c.isdigit())
    wide.select(*WIDE_IDS, *years).write.option("header", True).csv(path)
    return years


# ---------------------------------------------------------------- S1
@register("wide_csv_scan", with_star(WIDE_LONG_SQL))
def wide_csv_scan(spark, sf):
    path = scratch(spark, "wide")
    years = _write_wide_csv(spark, sf, path)
    schema = S.wide_csv_schema(WIDE_IDS, range(int(years[0]), int(years[-1]) + 1))
    long = I.unpivot_years(S.read_wide_csv(spark, path, schema), WIDE_IDS)
    return long.withColumn("value", r4("value"))


# ---------------------------------------------------------------- S2
@register("series_matrix_scan", with_star("""
SELECT i.unit AS series, g.year, c.country_name AS country, ROUND(SUM(g.value), 4) AS value
FROM gem_observations g JOIN countries c USING (country_id) JOIN indicators i USING (indicator_id)
GROUP BY ALL"""))
def series_matrix_scan(spark, sf):
    """One matrix file per series (years x countries, a bounded table), the
    series named by its folder."""
    path = scratch(spark, "matrix")
    wide = gem_star(Star(spark, sf)).groupBy("unit", "year").pivot("country_name").agg(total("value"))
    names = [c for c in wide.columns if c not in ("unit", "year")]
    line = F.array_join(F.array(*[col(f"`{c}`").cast("string") for c in ["year", *names]]), ",", "")
    text = F.array_join(F.concat(F.array(F.lit(",".join(["year", *names]))),
                                 F.array_sort(F.collect_list(line))), "\n")
    wide.groupBy("unit").agg(text.alias("value")).write.partitionBy("unit").text(path)
    long = S.read_series_matrices(spark, path, name=F.regexp_extract("_metadata.file_path", "/unit=([^/]*)/", 1))
    cells = I.safe_cast_reject(long, "year_raw", "value_raw").where("reject_reason IS NULL")
    return cells.select(col("file_name").alias("series"), "year", "country", r4("value").alias("value"))


# ---------------------------------------------------------------- S3
JSON_ARRAY_RECORDS = 1_000


@register("json_array_scan", "SELECT p_partkey AS id, p_name AS question, p_type AS category FROM part")
def json_array_scan(spark, sf):
    """Files that each hold one array of at most ``JSON_ARRAY_RECORDS`` records."""
    path = scratch(spark, "array")
    rec = F.struct(col("p_partkey").alias("id"), col("p_name").alias("question"), col("p_type").alias("category"))
    (Tables(spark, sf).part.groupBy(F.floor(col("p_partkey") / JSON_ARRAY_RECORDS).alias("n"))
     .agg(F.to_json(F.collect_list(rec)).alias("value")).write.partitionBy("n").text(path))
    return S.read_json_array(spark, path).select("id", "question", "category")


# ---------------------------------------------------------------- S4
@register("jsonl_scan", """
SELECT p_partkey % 10 = 3 AS corrupt, CAST(COUNT(*) AS BIGINT) AS records,
       CAST(SUM(IF(p_partkey % 10 = 3, 0, length(p_name))) AS BIGINT) AS question_chars
FROM part WHERE p_partkey % 7 <> 5 GROUP BY 1""")
def jsonl_scan(spark, sf):
    """Lines of chat records, among them blank and malformed ones."""
    path = scratch(spark, "lines")
    ident = col("p_partkey")
    chat = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), col("p_name").alias("content")))
                              .alias("messages")))
    line = F.when(ident % 7 == 5, "").when(ident % 10 == 3, F.concat(F.lit("{cut off "), "p_name")).otherwise(chat)
    S.write_text(Tables(spark, sf).part.select(line.alias("value")), path)
    chars = F.coalesce(F.length(col("messages")[0]["content"]), F.lit(0))
    return (S.read_jsonl(spark, path).groupBy(col("_corrupt_record").isNotNull().alias("corrupt"))
            .agg(F.count(F.lit(1)).alias("records"), F.sum(chars).cast("bigint").alias("question_chars")))


# ---------------------------------------------------------------- S5
@register("jsonl_sink", "SELECT item_id, text FROM benchmark")
def jsonl_sink(spark, sf):
    path = scratch(spark, "jsonl")
    S.write_jsonl(Tables(spark, sf).benchmark.select("item_id", "text"), path)
    return spark.read.schema("item_id bigint, text string").json(path)


# ---------------------------------------------------------------- S6
@register("augmented_sink", ORACLE["hard_examples"])
def augmented_sink(spark, sf):
    """Two augmentation types written, one read back by its partition."""
    path, t = scratch(spark, "augmented"), Tables(spark, sf)
    hard = C.hard_examples(C.query_log(t), C.results_log(t))
    S.write_augmented(hard.unionByName(hard.withColumn("augmentation_type", F.lit("other"))), path)
    return S.load_augmented(spark, path, "hard_example", hard.schema)


# ---------------------------------------------------------------- S7
@register("whole_text_round_trip", "SELECT item_id, text FROM benchmark")
def whole_text_round_trip(spark, sf):
    """One file per benchmark passage; the sink ends each with a line feed."""
    path = scratch(spark, "texts")
    Tables(spark, sf).benchmark.select("item_id", col("text").alias("value")).write.partitionBy("item_id").text(path)
    return S.read_whole_text(spark, path).select(
        F.regexp_extract("path", "/item_id=([0-9]+)/", 1).cast("bigint").alias("item_id"),
        F.regexp_replace("value", r"\n\z", "").alias("text"))


# ---------------------------------------------------------------- S9 / S10
_PER_YEAR = """SELECT year, CAST(COUNT(*) AS BIGINT) AS observations, ROUND(SUM(value), 4) AS total_value
FROM gfs_observations {} GROUP BY year"""


def _per_year(facts):
    return facts.groupBy(col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("observations"), r4(total("value")).alias("total_value"))


@register("append_facts", with_star(_PER_YEAR.format("")))
def append_facts(spark, sf):
    path, g = scratch(spark, "facts"), Star(spark, sf).gfs()
    for part in (g.where("year < 1998"), g.where("year >= 1998")):
        S.append_facts(part, path)
    return _per_year(spark.read.parquet(path))


@register("overwrite_facts", with_star(_PER_YEAR.format("WHERE year >= 1998")))
def overwrite_facts(spark, sf):
    path, g = scratch(spark, "facts"), Star(spark, sf).gfs()
    for rows in (g.where("year < 1998"), g.where("year >= 1998")):
        S.overwrite_table(rows, path, ["year"])
    return _per_year(spark.read.parquet(path))


# ---------------------------------------------------------------- S11
_CELLS = ", ".join(f"COALESCE(CAST({m} AS VARCHAR), '')" for m in E.MODELS)


@register("report_sink", f"""
SELECT '| ' || concat_ws(' | ', method, {_CELLS}) || ' |' AS value
FROM ({ORACLE["eval_pivot_matrix"]}) m""")
def report_sink(spark, sf):
    path = scratch(spark, "report")
    S.write_report(E.method_model_matrix(E.eval_log(Tables(spark, sf)), E.MODELS), path, ["method", *E.MODELS])
    return spark.read.text(f"{path}/markdown")


# ---------------------------------------------------------------- R1 / R2
@register("file_ingest_stream", with_star(f"""
SELECT COUNTRY AS country_name, SECTOR AS sector_name, SERIES_CODE AS indicator_code,
       TYPE_OF_TRANSFORMATION AS transformation, year, value FROM ({WIDE_LONG_SQL}) w"""))
def file_ingest_stream(spark, sf):
    """Wide files arrive as a stream; the facts join back to their dimensions."""
    src, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    years = _write_wide_csv(spark, sf, src)
    query = R.start_file_ingest(spark, src, f"{out}/dim", f"{out}/facts", WIDE_IDS, years,
                                name=out.rsplit("/", 1)[1], files_per_batch=4)
    query.awaitTermination()
    facts = spark.read.parquet(f"{out}/facts")
    for name, id_col, name_col in R.DIMENSIONS.values():
        facts = facts.join(R.dimension(spark, f"{out}/dim", name, id_col, name_col).drop("batch"), id_col, "left")
    return facts.select("country_name", "sector_name", "indicator_code",
                        col("TYPE_OF_TRANSFORMATION").alias("transformation"), "year", r4("value").alias("value"))


@register("running_usage_stream", ORACLE["cost_rollup"])
def running_usage_stream(spark, sf):
    src, out = scratch(spark, "usage-in"), scratch(spark, "usage-out")
    E.usage_log(Tables(spark, sf)).write.parquet(src)
    R.start_running_usage(spark, src, E.price_table(spark), out).awaitTermination()
    return R.latest_usage(spark, out)
