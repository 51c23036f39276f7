"""The registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.llm import bpe, chat_format, classifier, exact_dedup, licenses, ngram_join, packing, periodic_runs, pii, quality_rules, structure_repair, substring_dedup, warc
from fiscus.llm.common import written
from fiscus.llm.oracles import ORACLE  # noqa: F401  the SQL of the queries below, by key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ranks = public.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op3_exact_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "n_words_left", "n_lines_removed")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names])


@register("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return packing.best_fit_pack(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN)


@register("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    described = written(classifier.describe(docs), "features")
    model = classifier.fit(described, labels.where(~held))
    s = classifier.score(described, model).withColumnRenamed("id", "doc_id")
    return s.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


@register("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op5_ngram_jaccard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


@register("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


@register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.planted(table(spark, sf_dir, "documents")))
    best = found.select("doc_id", "runs", "collapsed_text", periodic_runs.greatest_run(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


@register("op13_chat_format")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    # conversation -7 says what looks like marks
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text"))
    formatted = chat_format.format_conversations(rows, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return chat_format.read_back(formatted).withColumnRenamed("conv", "conv_id")


@register("op12_structure_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure_repair.damaged(table(spark, sf_dir, "conversations"))
    reports = structure_repair.repair(rows, present_col="present", with_turns=False).where("report is not null")
    return reports.select("conv_id", "report.*")
