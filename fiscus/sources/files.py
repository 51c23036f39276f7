"""File sources and sinks.

All readers take explicit schemas (no inference pass over the data) and
return lazy DataFrames; all writers are Spark writers (parallel, one file
per task), never a driver-side loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.plans.star import YEAR_MAX, YEAR_MIN

col = F.col

# ---------------------------------------------------------------- S1
WIDE_META = ["COUNTRY", "SECTOR", "SERIES_CODE", "INDICATOR", "SERIES_NAME", "FULL_DESCRIPTION",
             "TYPE_OF_TRANSFORMATION", "SCALE", "FREQUENCY"]


def wide_csv_schema(meta: Sequence[str] = WIDE_META, years: range = range(YEAR_MIN, YEAR_MAX + 1)) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in meta]
                        + [T.StructField(str(y), T.DoubleType()) for y in years])


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The wide year-column file.  Input splits replace the reference's
    1000-row chunks; header names are checked against the schema."""
    return (spark.read.schema(schema or wide_csv_schema())
            .option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
            .csv(path))


# ---------------------------------------------------------------- S2
def decoded_path(c: Column) -> Column:
    """File metadata paths are URI-encoded; '+' is literal in a URI path."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


_CSV_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _unquote(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r'^"|"$', "")


def read_series_matrices(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """One CSV per series, rows = years, columns = entities, the series
    described by the file name (or by ``name`` over the file metadata).  Each file's header differs, so a file is
    read whole (one series matrix, bounded by years x countries) and
    reshaped with column expressions into long rows
    (file_name, year_raw, country, value_raw); casts and rejects are left to
    ``ingest.safe_cast_reject``."""
    raw = (spark.read.text(path, wholetext=True)
           .select(decoded_path(col("_metadata.file_name") if name is None else name).alias("file_name"),
                   col("value")))
    lines = raw.select("file_name", F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"),
                                             lambda s: F.trim(s) != "").alias("lines"))
    hdr = lines.select("file_name", F.transform(F.split(F.element_at("lines", 1), _CSV_SPLIT), _unquote)
                       .alias("header"), F.slice("lines", 2, F.size("lines")).alias("rows"))
    cells = hdr.select("file_name", "header", F.explode("rows").alias("row")).select(
        "file_name", "header", F.transform(F.split("row", _CSV_SPLIT), _unquote).alias("cells"))
    return (cells.select("file_name", "header", F.element_at("cells", 1).alias("year_raw"),
                         F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("pos", "value_raw"))
            .select("file_name", "year_raw",
                    F.element_at("header", (col("pos") + 2).cast("int")).alias("country"),
                    F.nullif(col("value_raw"), F.lit("")).alias("value_raw")))


# ---------------------------------------------------------------- S3 / S4
QUERY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("question", T.StringType()),
    T.StructField("ground_truth_sql", T.StringType()), T.StructField("difficulty", T.StringType()),
    T.StructField("category", T.StringType())])
CHAT_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("_corrupt_record", T.StringType())])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = QUERY_SCHEMA) -> DataFrame:
    """S3: a JSON file holding one array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CHAT_SCHEMA) -> DataFrame:
    """JSON lines; blank lines are skipped by the reader, malformed lines
    land in ``_corrupt_record`` (PERMISSIVE)."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


# ---------------------------------------------------------------- S5 / S6
def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one file per task."""
    df.write.mode(mode).json(path)


def write_augmented(df: DataFrame, path: str) -> None:
    """Augmented sets partitioned by ``augmentation_type``."""
    df.write.mode("overwrite").partitionBy("augmentation_type").json(path)


def load_augmented(spark: SparkSession, path: str, aug_type: str | None = None,
                   schema: T.StructType | None = None) -> DataFrame:
    """Read back one type -- a partition filter, so other types' files
    are never opened."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    return df.where(col("augmentation_type") == aug_type) if aug_type else df


# ---------------------------------------------------------------- S7
def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (path, value)."""
    return (spark.read.text(path, wholetext=True)
            .select(decoded_path(col("_metadata.file_path")).alias("path"), "value"))


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(col(column).alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- S9 / S10
def append_facts(df: DataFrame, path: str) -> None:
    """Append observations, partitioned by year (partition pruning
    replaces the reference's (country, year) index)."""
    df.write.mode("append").partitionBy("year").parquet(path)


def overwrite_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Drop and recreate."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# ---------------------------------------------------------------- S11
def write_report(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The report as JSON plus markdown table rows."""
    df.write.mode("overwrite").json(f"{path}/json")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(col(c).cast("string"), F.lit(""))
                                                      for c in columns]), F.lit(" |"))
    df.select(row.alias("value")).write.mode("overwrite").text(f"{path}/markdown")
