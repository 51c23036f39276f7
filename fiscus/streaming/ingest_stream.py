"""Structured Streaming: incremental file ingest (R1) and running usage
totals (R2).

R1 replaces the reference's chunked / per-file import loop: a file source
picks up new wide files, and each micro-batch unpivots them, upserts the
country, sector and indicator dimensions and appends facts.  A batch reads
only the dimension rows of earlier batches and overwrites only its own
``batch=<id>`` folders, so a repeated batch, also one that failed between
two writes, leaves the same rows and ids; with the source checkpoint each
file is ingested exactly once.

R2 keeps running token totals per model (complete mode) priced by a
stream-static join; the batch form is ``evaluate.cost_rollup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fiscus.operators import ingest as I
from fiscus.session import ensure_checkpoint_dir
from fiscus.sources.files import wide_csv_schema

col = F.col


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


# wide column -> (dimension, id column, name column)
DIMENSIONS = {
    "COUNTRY": ("countries", "country_id", "country_name"),
    "SECTOR": ("sectors", "sector_id", "sector_name"),
    "SERIES_CODE": ("indicators", "indicator_id", "indicator_code"),
}


def dimension(spark: SparkSession, dim_root: str, name: str, id_col: str, name_col: str) -> DataFrame:
    """All rows of one dimension, with the batch that added each."""
    return (spark.read.schema(f"{id_col} bigint, {name_col} string, batch bigint")
            .parquet(f"{dim_root}/{name}"))


def create_dimensions(spark: SparkSession, dim_root: str, id_cols: list[str]) -> None:
    """The empty start of every dimension (``batch=-1``), so that a read error
    later is an error and never taken for a first batch."""
    for c in id_cols:
        if c in DIMENSIONS:
            name, id_col, name_col = DIMENSIONS[c]
            (spark.createDataFrame([], f"{id_col} bigint, {name_col} string")
             .write.mode("overwrite").parquet(f"{dim_root}/{name}/batch=-1"))


def ingest_batch(dim_root: str, fact_path: str, id_cols: list[str], years: list[str]):
    """foreachBatch function: dimensions first, then the facts with their ids.
    A row without a country or indicator has no fact; its sector may be NULL."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        facts = I.unpivot_years(batch, id_cols, years)
        for c in [c for c in id_cols if c in DIMENSIONS]:
            name, id_col, name_col = DIMENSIONS[c]
            known = dimension(spark, dim_root, name, id_col, name_col)
            earlier = known.where(col("batch") < batch_id).select(id_col, name_col)
            all_rows = I.upsert_with_offset(earlier, facts.select(col(c).alias(name_col)), name_col, id_col)
            (all_rows.join(earlier.select(name_col), name_col, "left_anti").select(id_col, name_col)
             .write.mode("overwrite").parquet(f"{dim_root}/{name}/batch={batch_id}"))
            ids = (dimension(spark, dim_root, name, id_col, name_col).where(col("batch") <= batch_id)
                   .select(id_col, col(name_col).alias(c)))
            facts = facts.join(ids, c, "left" if c == "SECTOR" else "inner").drop(c)
        facts.write.mode("overwrite").partitionBy("year").parquet(f"{fact_path}/batch={batch_id}")
    return run


def start_file_ingest(spark: SparkSession, source_dir: str, dim_root: str, fact_path: str,
                      id_cols: list[str], years: list[str], name: str = "wide_ingest",
                      available_now: bool = True, files_per_batch: int = 1_000) -> StreamingQuery:
    """Stream wide CSV files from ``source_dir`` into dimensions + facts."""
    schema = wide_csv_schema(id_cols, range(int(years[0]), int(years[-1]) + 1))
    create_dimensions(spark, dim_root, id_cols)
    stream = (spark.readStream.schema(schema).option("header", True)
              .option("maxFilesPerTrigger", files_per_batch).csv(source_dir))
    w = (stream.writeStream.foreachBatch(ingest_batch(dim_root, fact_path, id_cols, years))
         .option("checkpointLocation", checkpoint_location(spark, name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def running_usage(usage_stream: DataFrame, prices: DataFrame, default=(0.18, 0.18)) -> DataFrame:
    """R2: running totals per model and their cost (stream-static join)."""
    tot = usage_stream.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"),
                                            F.sum("output_tokens").alias("output_tokens"))
    cost = (col("input_tokens") / 1e6 * F.coalesce(col("input_price"), F.lit(default[0]))
            + col("output_tokens") / 1e6 * F.coalesce(col("output_price"), F.lit(default[1])))
    return tot.join(prices, "model", "left").select("model", "input_tokens", "output_tokens",
                                                    F.round(cost, 8).alias("cost_usd"))


def start_running_usage(spark: SparkSession, source_dir: str, prices: DataFrame, out_dir: str,
                        schema: str = "model string, input_tokens long, output_tokens long") -> StreamingQuery:
    """R2: each batch writes the totals so far to its own folder, so a
    repeated batch replaces its own rows (``latest_usage`` reads the last)."""
    def write(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    stream = spark.readStream.schema(schema).parquet(source_dir)
    return (running_usage(stream, prices).writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint_location(spark, f"usage-{out_dir.strip('/').replace('/', '-')}"))
            .trigger(availableNow=True).start())


def latest_usage(spark: SparkSession, out_dir: str) -> DataFrame:
    totals = spark.read.parquet(out_dir)
    last = totals.agg(F.max("batch").alias("batch"))
    return totals.join(last, "batch").drop("batch")
