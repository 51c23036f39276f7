"""Scalar function smoke plans: numeric, string, array, map and
JSON functions as built-in column expressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscus.plans.registry import register
from fiscus.sources.tables import Tables

col = F.col


# ---------------------------------------------------------------- N1-N4, G1-G6, G10
@register("scalar_functions", """
SELECT p_partkey,
       ROUND(p_retailprice * 1.07, 2) AS price_with_tax,
       ROUND(SQRT(CAST(p_size AS DOUBLE)), 4) AS sqrt_size,
       ROUND(POWER(CAST(p_size AS DOUBLE), 1.0 / 10), 4) AS pow_size,
       CASE WHEN p_size - 25 <> 0 THEN ROUND(p_retailprice / (p_size - 25), 4) END AS guarded_ratio,
       lower(p_name) AS name_lower, upper(p_type) AS type_upper,
       trim('  ' || p_name || '  ') AS name_trim, rtrim(p_brand || ';;', ';') AS brand_rtrim,
       trim(regexp_replace(p_name || '   x   ' || p_type, '\\s+', ' ', 'g')) AS ws_normalized,
       replace(p_brand, '#', '-') AS brand_dash,
       array_to_string(list_slice(string_split(p_name, ' '), 1, 1), '|') AS first_word,
       substr(p_name || ' ' || p_type || ' ' || p_brand, 1, 12) AS truncated,
       contains(p_name, 'red') AS has_red,
       (contains(p_name, 'red') OR contains(p_name, 'blue') OR contains(p_name, 'gear')) AS any_of,
       CAST(length(p_name) - length(replace(p_name, 'o', '')) AS BIGINT) AS count_o,
       CAST(length(p_name) AS INTEGER) AS name_len,
       printf('%.3f', p_retailprice / 7) AS price_3f,
       format('{:,}', CAST(p_retailprice * 1000 AS BIGINT)) AS price_thousands
FROM part""")
def scalar_functions(spark, sf):
    p = Tables(spark, sf).part
    name = col("p_name")
    return p.select(
        "p_partkey",
        F.round(col("p_retailprice") * 1.07, 2).alias("price_with_tax"),
        F.round(F.sqrt(col("p_size").cast("double")), 4).alias("sqrt_size"),
        F.round(F.pow(col("p_size").cast("double"), F.lit(1.0 / 10)), 4).alias("pow_size"),
        F.round(F.try_divide(col("p_retailprice"), F.nullif(col("p_size") - 25, F.lit(0))), 4)
         .alias("guarded_ratio"),
        F.lower(name).alias("name_lower"), F.upper("p_type").alias("type_upper"),
        F.trim(F.concat(F.lit("  "), name, F.lit("  "))).alias("name_trim"),
        F.rtrim(F.concat(col("p_brand"), F.lit(";;")), F.lit(";")).alias("brand_rtrim"),
        F.trim(F.regexp_replace(F.concat(name, F.lit("   x   "), col("p_type")), r"\s+", " "))
         .alias("ws_normalized"),
        F.replace(col("p_brand"), F.lit("#"), F.lit("-")).alias("brand_dash"),
        F.array_join(F.slice(F.split(name, " "), 1, 1), "|").alias("first_word"),
        F.substring(F.concat_ws(" ", name, col("p_type"), col("p_brand")), 1, 12).alias("truncated"),
        name.contains("red").alias("has_red"),
        F.exists(F.array(F.lit("red"), F.lit("blue"), F.lit("gear")), lambda w: name.contains(w))
         .alias("any_of"),
        (F.length(name) - F.length(F.replace(name, F.lit("o"), F.lit("")))).cast("bigint").alias("count_o"),
        F.length(name).alias("name_len"),
        # Number formatting ('.3f', thousands separator)
        F.format_string("%.3f", col("p_retailprice") / 7).alias("price_3f"),
        F.format_number((col("p_retailprice") * 1000).cast("bigint"), 0).alias("price_thousands"))


# ---------------------------------------------------------------- C1, M1, K1
@register("json_array_map", """
WITH e AS (SELECT event_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k,
       [k, k + 1, k + 2][3] AS last_item,
       CAST(len(list_slice([k, k + 1, k + 2], 2, 3)) AS INTEGER) AS slice_len,
       CAST(COALESCE(CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 END, 0.0) AS DOUBLE) AS weight,
       k AS k_roundtrip,
       strftime(ts, '%Y%m%d_%H%M%S') AS ts_compact, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_iso
FROM e""")
def json_array_map(spark, sf):
    e = Tables(spark, sf).events
    parsed = e.select("event_id", "event_type", "ts",
                      F.from_json("props", "k bigint").alias("j"))
    arr = F.array(col("j.k"), col("j.k") + 1, col("j.k") + 2)
    weights = F.create_map(F.lit("click"), F.lit(1.0), F.lit("view"), F.lit(0.5))
    encoded = F.to_json(F.struct(col("j.k").alias("k")))
    return parsed.select(
        "event_id", col("j.k").alias("k"),
        F.element_at(arr, -1).alias("last_item"),
        F.size(F.slice(arr, 2, 2)).alias("slice_len"),
        F.coalesce(F.element_at(weights, col("event_type")), F.lit(0.0)).alias("weight"),
        F.from_json(encoded, "k bigint")["k"].alias("k_roundtrip"),
        # Report-name and ISO timestamp formats
        F.date_format("ts", "yyyyMMdd_HHmmss").alias("ts_compact"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_iso"))


# ---------------------------------------------------------------- A32 / G10
@register("text_stats", """
SELECT lang, CAST(COUNT(*) AS BIGINT) AS sections,
       CAST(SUM(length(s)) AS BIGINT) AS total_chars, ROUND(AVG(length(s)), 4) AS avg_chars
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS s FROM documents) x
GROUP BY lang""")
def text_stats(spark, sf):
    d = Tables(spark, sf).documents
    sections = d.select("lang", F.explode(F.split("text", "\n")).alias("s"))
    return sections.groupBy("lang").agg(F.count(F.lit(1)).alias("sections"),
                                        F.sum(F.length("s")).cast("bigint").alias("total_chars"),
                                        F.round(F.avg(F.length("s")), 4).alias("avg_chars"))
