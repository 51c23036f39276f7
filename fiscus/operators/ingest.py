"""L1 ingest: wide files -> normalized star schema, as DataFrame operators.

Reference behaviours kept or deliberately changed (SURVEY 1.4):
  a  dimension ids in sorted-name order                 -> sorted_surrogate_key
  b  first-seen position, last-seen attributes          -> dedupe_last_wins
  c  NULL indicator name drops the indicator            -> filter + reject count
  d  fact kept iff value, country, indicator present;
     sector may be NULL                                 -> lookup_facts (inner, inner, left)
  e  'not seas. adj.' flagged seasonal (bug)            -> fixed in parse_series_name
  f  50-char code truncation may collide                -> full name kept, code offered
  g  blank year row shifts values (bug)                 -> unpivot keeps year and value together
  h  one bad cell aborts the rest of the row (bug)      -> per-cell try_cast, cell rejected
  i  unknown countries added on the fly                 -> upsert_with_offset (anti join + union)
  j  years outside 1972-2024 dropped                    -> range filter
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscus.plans.analytics import attach_scalar
from fiscus.plans.star import YEAR_MAX, YEAR_MIN

col = F.col


# ---------------------------------------------------------------- L1 / L2
def unpivot_wide(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
                 var_name: str = "label", value_name: str = "value") -> DataFrame:
    """Wide -> long over ``value_cols``; NULL cells produce no row."""
    return (df.unpivot(list(id_cols), list(value_cols), var_name, value_name)
              .where(col(value_name).isNotNull()))


def unpivot_years(df: DataFrame, id_cols: Sequence[str], year_cols: Sequence[str] | None = None,
                  prefix: str = "") -> DataFrame:
    """L1: year columns (``<prefix>1972`` .. ) -> (ids.., year int, value double)."""
    if year_cols is None:
        year_cols = [c for c in df.columns
                     if c.startswith(prefix) and c[len(prefix):].isdigit()]
    cast = df.select(*id_cols, *[col(c).cast("double").alias(c) for c in year_cols])
    long = unpivot_wide(cast, id_cols, year_cols, "_label", "value")
    return (long.withColumn("year", F.substring(col("_label"), len(prefix) + 1, 8).cast("int"))
                .select(*id_cols, "year", "value"))


# ---------------------------------------------------------------- L3 / L4
def distinct_values(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """L3: distinct non-NULL values of one column (partial aggregate per task)."""
    return df.select(col(c).alias(out or c)).where(col(out or c).isNotNull()).distinct()


SLICE_SAMPLES_PER_SLICE = 20


def _count_below(bounds: Column, key: Column, n: int) -> Column:
    """Number of the (at most ``n - 1``) sorted ``bounds`` below ``key``, by bisection."""
    steps = [2 ** p for p in reversed(range(max(n - 1, 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        F.get(bounds, at + s - 1) < key, at + s).otherwise(at))


def with_key_slices(df: DataFrame, keys: Sequence[str], n: int | None = None,
                    out: str = "_slice") -> DataFrame:
    """Add a data-defined slice number 0..n-1 that is monotone in ``keys``.

    Boundaries come from the keys with the smallest hashes: a uniform sample
    of ``SLICE_SAMPLES_PER_SLICE * n`` keys (each task keeps that many) that
    depends on nothing but the keys themselves, so every branch of a plan and
    every task retry cuts alike.  The ``n - 1`` boundaries are one row; the
    slice of a row is the number of boundaries below its key.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = F.struct(*[col(c) for c in keys])
    sample = (df.select(k.alias("k"), F.xxhash64(*keys).alias("h")).orderBy("h", "k")
              .limit(SLICE_SAMPLES_PER_SLICE * n).agg(F.array_sort(F.collect_list("k")).alias("_ks")))
    picks = F.transform(F.sequence(F.lit(1), F.lit(max(n - 1, 1))),
                        lambda i: F.get(col("_ks"), (i * F.size("_ks") / n).cast("int")))
    bounds = sample.select(F.filter(F.array_distinct(picks), lambda b: b.isNotNull()).alias("_bounds"))
    return attach_scalar(df, bounds).withColumn(out, _count_below(col("_bounds"), k, n)).drop("_bounds")


def row_number_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str],
                        out: str = "row_number") -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without
    sending a whole group to one task.

    Rows get a data-defined slice monotone in (group, order)
    (``with_key_slices``), so a hot group is cut into several slices; each
    (group, slice) is numbered by its own window and shifted by the row count
    of the same group in earlier slices (a table with one row per
    (group, slice)).  ``order`` must make the order total (add a unique
    tie-breaker) for a deterministic result.
    """
    group, order = list(group), list(order)
    sl = with_key_slices(df, [*group, *order])
    local = sl.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)))
    counts = sl.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))) \
        .orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[col(g).alias(f"_g_{g}") for g in group], col("_slice").alias("_s"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = col("_slice") == col("_s")
    for g in group:  # a NULL group is a group
        same = same & col(g).eqNullSafe(col(f"_g_{g}"))
    return (local.join(offsets, same)
                 .withColumn(out, (col("_off") + col("_rn")).cast("bigint"))
                 .drop("_slice", "_rn", "_off", "_s", *[f"_g_{g}" for g in group]))


def sorted_surrogate_key(df: DataFrame, order_col: str, id_col: str, start: int = 1) -> DataFrame:
    """L4: consecutive ids ``start..`` in ``order_col`` order, fully distributed.

    A global ``row_number()`` without PARTITION BY pulls every row into one
    task; here it is the single-group case of ``row_number_in_group``
    (slices of the key range numbered in parallel, shifted by the sizes of
    earlier slices -- an offsets table with one row per slice)."""
    out = row_number_in_group(df, [], [order_col], id_col)
    return out if start == 1 else out.withColumn(id_col, col(id_col) + (start - 1))


# ---------------------------------------------------------------- L5
def dedupe_last_wins(df: DataFrame, key: str, ord_col: str, value_cols: Sequence[str],
                     required: Sequence[str] = ()) -> DataFrame:
    """One row per key; ``first_ord`` = first-seen position, values from
    the last-seen row (dict assignment semantics).

    ``required`` (1.4 c): keys whose *last-seen* value of any of these
    columns is NULL are dropped, as the reference's NOT NULL insert fails for
    them; their observations then fall out of the inner lookup join.  Use
    ``dedupe_rejects`` to count them."""
    last = F.max_by(F.struct(*[col(c) for c in value_cols]), col(ord_col))
    out = (df.groupBy(key)
             .agg(F.min(ord_col).alias("first_ord"), last.alias("_last"))
             .select(key, "first_ord", *[col(f"_last.{c}").alias(c) for c in value_cols]))
    for c in required:
        out = out.where(col(c).isNotNull())
    return out


def dedupe_rejects(df: DataFrame, key: str, ord_col: str, required: Sequence[str]) -> DataFrame:
    """Keys rejected by ``dedupe_last_wins(required=...)``: one row per key."""
    last = F.max_by(F.struct(*[col(c) for c in required]), col(ord_col))
    bad = F.lit(False)
    for c in required:
        bad = bad | col(f"_last.{c}").isNull()
    return df.groupBy(key).agg(last.alias("_last")).where(bad).select(key)


# ---------------------------------------------------------------- L6 / L9
def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str,
                  ord_col: str | None = None) -> DataFrame:
    """INSERT OR IGNORE -- existing rows win; among new rows the first
    (by ``ord_col``) wins.  Result has ``existing``'s columns."""
    cols = existing.columns
    new = incoming.join(existing.select(key), key, "left_anti")
    if ord_col:
        # first row per key as a partial aggregate (a hot key is combined
        # map-side instead of being sorted in one window partition)
        rest = [c for c in cols if c != key]
        new = (new.groupBy(key).agg(F.min_by(F.struct(*[col(c) for c in rest]), col(ord_col)).alias("_r"))
               .select(key, *[col(f"_r.{c}").alias(c) for c in rest]))
    else:
        new = new.dropDuplicates([key])
    return existing.unionByName(new.select(*cols))


def upsert_with_offset(dim: DataFrame, names: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Add names missing from ``dim`` with ids after ``max(id)``, in
    sorted-name order (the reference inserts and re-reads one at a time)."""
    missing = distinct_values(names, name_col).join(dim.select(name_col), name_col, "left_anti")
    base = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_base"))  # exactly one row
    keyed = sorted_surrogate_key(missing, name_col, "_k")
    new = (attach_scalar(keyed, base)
                .select((col("_base") + col("_k")).cast("bigint").alias(id_col), name_col))
    extra = [c for c in dim.columns if c not in (id_col, name_col)]
    for c in extra:
        new = new.withColumn(c, F.lit(None).cast(dim.schema[c].dataType))
    return dim.unionByName(new.select(*dim.columns))


# ---------------------------------------------------------------- L7
def year_sequence(years: DataFrame, year_col: str = "year") -> DataFrame:
    """Every year from the data's first to last (gaps filled)."""
    return (years.agg(F.min(year_col).alias("lo"), F.max(year_col).alias("hi"))
                 .select(F.explode(F.sequence("lo", "hi")).alias("_y"))
                 .select(F.col("_y").cast("int").alias("year")))


def year_sequence_range(spark: SparkSession, lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> DataFrame:
    """The reference's fixed ``range(1972, 2025)`` dimension."""
    return spark.range(lo, hi + 1).select(col("id").cast("int").alias("year"))


# ---------------------------------------------------------------- L8
def lookup_facts(long: DataFrame, countries: DataFrame, indicators: DataFrame,
                 sectors: DataFrame | None = None,
                 country_name: str = "country_name", indicator_code: str = "indicator_code",
                 sector_name: str = "sector_name") -> DataFrame:
    """Names -> ids.  Inner to country and indicator, LEFT to sector
    (a fact with an unknown sector keeps sector_id NULL).  No broadcast
    hint: AQE broadcasts each dimension when it measures small."""
    out = (long.join(countries.select(col("country_name").alias(country_name), "country_id"), country_name)
               .join(indicators.select(col("indicator_code").alias(indicator_code), "indicator_id"),
                     indicator_code))
    if sectors is not None:
        out = out.join(sectors.select(col("sector_name").alias(sector_name), "sector_id"),
                       sector_name, "left")
    return out.where(col("value").isNotNull())


# ---------------------------------------------------------------- L10 / L11
def series_stem(file_name: Column, ext: str = ".csv") -> Column:
    return F.replace(file_name, F.lit(ext), F.lit(""))


def parse_series_name(file_name: Column, ext: str = ".csv") -> Column:
    """File name -> struct(indicator_name, unit, seasonal_adjustment).

    Seasonal flag fixed: 'not seas. adj.' is *not* seasonal (the reference's
    substring test flags it True).
    """
    stem = series_stem(file_name, ext)
    low = F.lower(stem)
    seasonal = ((low.contains("seas. adj.") | low.contains("seas adj"))
                & ~low.contains("not seas"))
    cleaned = F.replace(F.replace(F.replace(stem, F.lit(", seas. adj."), F.lit("")),
                                  F.lit(", not seas. adj."), F.lit("")),
                        F.lit(".."), F.lit("."))
    parts = F.transform(F.split(cleaned, ","), lambda x: F.trim(x))
    unit = F.when(F.size(parts) > 1,
                  F.array_join(F.slice(parts, 2, F.size(parts) - 1), ", "))
    return F.struct(F.element_at(parts, 1).alias("indicator_name"),
                    unit.alias("unit"), seasonal.alias("seasonal_adjustment"))


def series_code(file_name: Column, ext: str = ".csv", prefix: str = "GEM_", width: int = 50) -> Column:
    """Prefix + first ``width`` chars of the stem with ' '->'_' and ',' removed."""
    body = F.replace(F.replace(series_stem(file_name, ext), F.lit(" "), F.lit("_")),
                     F.lit(","), F.lit(""))
    return F.concat(F.lit(prefix), F.substring(body, 1, width))


# ---------------------------------------------------------------- L12 / L13
def safe_cast_reject(df: DataFrame, year_col: str, value_col: str,
                     lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> DataFrame:
    """Per-cell casts; adds ``year``, ``value`` and ``reject_reason``
    (NULL for accepted cells).  Rejects stay in the frame as a side output
    so nothing is silently lost; callers split on ``reject_reason``."""
    y = F.expr(f"try_cast(try_cast({year_col} AS DOUBLE) AS INT)")
    v = F.expr(f"try_cast({value_col} AS DOUBLE)")
    reason = (F.when(y.isNull(), "bad_year")
               .when(~y.between(lo, hi), "year_out_of_range")
               .when(col(value_col).isNull(), "empty_value")
               .when(v.isNull(), "bad_value"))
    return df.withColumn("year", y).withColumn("value", v).withColumn("reject_reason", reason)


# ---------------------------------------------------------------- L14 / L15
def load_summary(fact: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One pass: row count and distinct counts of ``cols``."""
    return fact.agg(F.count(F.lit(1)).alias("rows"),
                    *[F.countDistinct(c).alias(f"distinct_{c}") for c in cols])


def constraint_report(checks: Sequence[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """``(table, rule, frame, predicate)`` -> one row per rule with the
    number of violating rows (predicate false or NULL)."""
    parts = [df.agg(F.count_if(~F.coalesce(pred, F.lit(False))).cast("bigint").alias("violations"))
               .select(F.lit(t).alias("table_name"), F.lit(r).alias("rule"), "violations")
             for t, r, df, pred in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
