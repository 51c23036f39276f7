"""L5 evaluation: result-set equality, accuracy roll-ups, method x model
matrix, paired comparison, retry effect, token cost.

The reference keeps counters in Python dicts while looping over queries;
here every summary is one aggregate over a row-level outcome log, so the
same code scores 21 queries or 21 billion.

Derived logs used by the registered plans (SURVEY 7.3):
  eval log   one row per event: method = event_type, model = 'm' || user_id % 5,
             difficulty from user_id % 3, category from props.k % 4,
             is_correct = value > 50, execution_success = event_type <> 'error'
  attempts   events of one user ordered by (ts, event_id) = one query's retries
  usage      conversations: tokens ~ ceil(chars / 4); user/system = input,
             assistant = output; model from conv_id % 5
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.plans.registry import register
from fiscus.sources.tables import Tables

col = F.col

# Model price table (USD per million tokens, input / output)
# and the default used for an unknown model.
MODEL_PRICING = [
    ("meta-llama/Meta-Llama-3.1-8B-Instruct-Turbo", 0.18, 0.18),
    ("Qwen/Qwen2.5-7B-Instruct", 0.20, 0.20),
    ("Qwen/Qwen2.5-32B-Instruct", 0.40, 0.40),
    ("meta-llama/Meta-Llama-3.1-70B-Instruct-Turbo", 0.88, 0.88),
]
DEFAULT_PRICE = (0.18, 0.18)
USAGE_MODELS = [m for m, _, _ in MODEL_PRICING] + ["unlisted/model"]

DIFFICULTY_SQL = "CASE user_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'hard' END"
CATEGORY_SQL = ("CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'lookup' "
                "WHEN 1 THEN 'aggregation' WHEN 2 THEN 'join' ELSE 'window' END")
EVAL_LOG_SQL = f"""
eval_log AS (
  SELECT event_id AS id, event_type AS method, 'm' || CAST(user_id % 5 AS VARCHAR) AS model,
         {DIFFICULTY_SQL} AS difficulty, {CATEGORY_SQL} AS category,
         value > 50 AS is_correct, event_type <> 'error' AS execution_success, user_id, ts
  FROM events)"""


def eval_log(t: Tables) -> DataFrame:
    e = t.events
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        col("event_id").alias("id"), col("event_type").alias("method"),
        F.concat(F.lit("m"), (col("user_id") % 5).cast("string")).alias("model"),
        F.when(col("user_id") % 3 == 0, "simple").when(col("user_id") % 3 == 1, "medium")
         .otherwise("hard").alias("difficulty"),
        F.when(k % 4 == 0, "lookup").when(k % 4 == 1, "aggregation").when(k % 4 == 2, "join")
         .otherwise("window").alias("category"),
        (col("value") > 50).alias("is_correct"),
        (col("event_type") != "error").alias("execution_success"), "user_id", "ts")


def pct(flag: Column) -> Column:
    return F.round(F.avg(F.when(flag, 1.0).otherwise(0.0).cast("double")) * 100, 4)


# ---------------------------------------------------------------- V-1 / U6
def _rows_close(g, p, fields, tol: float):
    """Field-by-field row comparison: numeric fields within ``tol``, others
    equal (NULL-safe)."""
    cond = F.lit(True)
    for name, numeric in fields:
        a, b = g[name], p[name]
        same = (a.isNull() & b.isNull()) | (F.abs(a - b) <= tol) if numeric else a.eqNullSafe(b)
        cond = cond & F.coalesce(same, F.lit(False))
    return cond


def result_equality(results: DataFrame, key: str = "query_id", side: str = "side",
                    pos: str = "pos", row: str = "row", tolerance: float | None = None) -> DataFrame:
    """Per ``key``: compare the 'gold' and 'pred' result lists.

    ``results`` is long: one row per result row with its position.  Ordered
    equality = same length and equal rows at every position (column names
    are ignored: ``row`` is a struct/array of values).  Multiset equality =
    same rows with the same multiplicities.  Both are aggregates without a join;
    no result list is collected.  ``tolerance`` relaxes the ordered mode to
    |gold - pred| <= tolerance on numeric fields (multiset mode stays exact).
    """
    gold, pred = (F.when(col(side) == s, col(row)) for s in ("gold", "pred"))
    at = results.groupBy(key, pos).agg(F.first(gold, True).alias("g"), F.first(pred, True).alias("p"))
    if tolerance is None:
        same = F.coalesce(col("g").eqNullSafe(col("p")), F.lit(False))
    else:  # ordered mode with a numeric tolerance (positional fields)
        from pyspark.sql.types import NumericType
        fields = [(f.name, isinstance(f.dataType, NumericType)) for f in results.schema[row].dataType.fields]
        same = col("g").isNotNull() & col("p").isNotNull() & _rows_close(col("g"), col("p"), fields, tolerance)
    ordered = at.groupBy(key).agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"),
                                  F.count_if(~same).alias("mismatched_positions"))
    multi = (results.groupBy(key, col(row).alias("r"))
             .agg(F.sum(F.when(col(side) == "gold", 1).otherwise(-1)).alias("_surplus"))
             .groupBy(key).agg(F.count_if(col("_surplus") != 0).alias("_bad")))
    return (ordered.join(multi, key, "left")
            .select(key, "n_gold", "n_pred", "mismatched_positions",
                    (col("mismatched_positions") == 0).alias("ordered_equal"),
                    (F.coalesce(col("_bad"), F.lit(0)) == 0).alias("multiset_equal")))


def events_results(t: Tables) -> DataFrame:
    """Analog result log: per event_type, gold rows = (user_id, value) in
    (ts, event_id) order; pred rows perturb values above 95."""
    from fiscus.operators.ingest import row_number_in_group
    e = t.events.select(col("event_type").alias("query_id"), "ts", "event_id", "user_id", "value")
    # a result list can be a large share of the log: skew-safe positions
    base = row_number_in_group(e, ["query_id"], ["ts", "event_id"], "pos").select(
        "query_id", "pos", "user_id", "value")
    def side(name, value):
        return F.struct(F.lit(name).alias("side"), F.struct("user_id", value.alias("value")).alias("row"))
    pred = F.when(col("value") > 95, col("value") + 1).otherwise(col("value"))
    return (base.select("query_id", "pos", F.explode(F.array(side("gold", col("value")), side("pred", pred))).alias("s"))
            .select("query_id", "pos", "s.side", "s.row"))


@register("result_equality", """
WITH base AS (
  SELECT event_type AS query_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos,
         user_id, value FROM events),
r AS (
  SELECT query_id, pos, 'gold' AS side, user_id, value AS v FROM base
  UNION ALL
  SELECT query_id, pos, 'pred', user_id, CASE WHEN value > 95 THEN value + 1 ELSE value END FROM base),
o AS (
  SELECT COALESCE(g.query_id, p.query_id) AS query_id, g.pos AS gpos, p.pos AS ppos,
         (g.user_id IS NOT DISTINCT FROM p.user_id AND g.v IS NOT DISTINCT FROM p.v
          AND g.pos IS NOT NULL AND p.pos IS NOT NULL) AS same
  FROM (SELECT * FROM r WHERE side = 'gold') g
  FULL OUTER JOIN (SELECT * FROM r WHERE side = 'pred') p ON g.query_id = p.query_id AND g.pos = p.pos),
oa AS (
  SELECT query_id, CAST(COUNT(gpos) AS BIGINT) AS n_gold, CAST(COUNT(ppos) AS BIGINT) AS n_pred,
         CAST(COUNT(*) FILTER (WHERE NOT same) AS BIGINT) AS mismatched_positions
  FROM o GROUP BY query_id),
m AS (
  SELECT COALESCE(g.query_id, p.query_id) AS query_id,
         CAST(COUNT(*) FILTER (WHERE g.c IS DISTINCT FROM p.c OR g.c IS NULL OR p.c IS NULL) AS BIGINT) AS bad
  FROM (SELECT query_id, user_id, v, COUNT(*) AS c FROM r WHERE side = 'gold' GROUP BY ALL) g
  FULL OUTER JOIN (SELECT query_id, user_id, v, COUNT(*) AS c FROM r WHERE side = 'pred' GROUP BY ALL) p
    ON g.query_id = p.query_id AND g.user_id IS NOT DISTINCT FROM p.user_id AND g.v IS NOT DISTINCT FROM p.v
  GROUP BY 1)
SELECT oa.query_id, n_gold, n_pred, mismatched_positions, mismatched_positions = 0 AS ordered_equal,
       COALESCE(m.bad, 0) = 0 AS multiset_equal
FROM oa LEFT JOIN m ON oa.query_id = m.query_id""")
def result_equality_q(spark, sf):
    return result_equality(events_results(Tables(spark, sf)))


# ---------------------------------------------------------------- A22 / A24 / V-3
def accuracy_grouping_sets(log: DataFrame, dims: Sequence[str] = ("difficulty", "category")) -> DataFrame:
    """One GROUPING SETS aggregate: overall, per difficulty, per category."""
    sets = [[]] + [[d] for d in dims]
    level = F.lit("overall")
    for d in reversed(dims):
        level = F.when(F.grouping(d) == 0, F.lit(d)).otherwise(level)
    return (log.groupingSets(sets, *dims)
            .agg(level.alias("level"), F.count(F.lit(1)).alias("n"),
                 pct(col("is_correct")).alias("accuracy_pct"),
                 F.count_if(~col("execution_success")).alias("execution_errors"),
                 pct(col("execution_success")).alias("execution_rate")))


@register("eval_grouping_sets", f"""
WITH {EVAL_LOG_SQL.strip()}
SELECT difficulty, category,
       CASE WHEN grouping(difficulty) = 0 THEN 'difficulty'
            WHEN grouping(category) = 0 THEN 'category' ELSE 'overall' END AS level,
       CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100, 4) AS accuracy_pct,
       CAST(COUNT(*) FILTER (WHERE NOT execution_success) AS BIGINT) AS execution_errors,
       ROUND(AVG(CASE WHEN execution_success THEN 1.0 ELSE 0.0 END) * 100, 4) AS execution_rate
FROM eval_log
GROUP BY GROUPING SETS ((), (difficulty), (category))""")
def eval_grouping_sets(spark, sf):
    return accuracy_grouping_sets(eval_log(Tables(spark, sf)))


# ---------------------------------------------------------------- A23 / V-4 / V-7
MODELS = [f"m{i}" for i in range(5)]


def method_model_matrix(log: DataFrame, models: Sequence[str]) -> DataFrame:
    """Accuracy (%) per method (rows) x model (columns).  The model list is
    passed so the pivot does not need a distinct-values job."""
    return (log.groupBy("method").pivot("model", list(models))
            .agg(F.round(F.avg(F.when(col("is_correct"), 1.0).otherwise(0.0).cast("double")) * 100, 4)))


@register("eval_pivot_matrix", f"""
WITH {EVAL_LOG_SQL.strip()}
SELECT method, {", ".join(f"ROUND(AVG(CASE WHEN model = '{m}' THEN CASE WHEN is_correct THEN 1.0 ELSE 0.0 END END) * 100, 4) AS {m}" for m in MODELS)}
FROM eval_log GROUP BY method""")
def eval_pivot_matrix(spark, sf):
    return method_model_matrix(eval_log(Tables(spark, sf)), MODELS)


# ---------------------------------------------------------------- A27 / V-5
def paired_compare(base: DataFrame, treat: DataFrame, key: str = "query_id",
                   flag: str = "is_correct") -> DataFrame:
    """Baseline vs treatment on the same queries: improved / regressed /
    unchanged counts and accuracy delta in percentage points."""
    j = base.select(key, col(flag).alias("b")).join(treat.select(key, col(flag).alias("t")), key)
    return j.agg(F.count(F.lit(1)).alias("queries"),
                 F.count_if(~col("b") & col("t")).alias("improved"),
                 F.count_if(col("b") & ~col("t")).alias("regressed"),
                 F.count_if(col("b") == col("t")).alias("unchanged"),
                 pct(col("b")).alias("baseline_accuracy"),
                 pct(col("t")).alias("treatment_accuracy"),
                 F.round(pct(col("t")) - pct(col("b")), 4).alias("delta_pp"))


def last_outcome(log: DataFrame, method: str) -> DataFrame:
    """Per query (user), the outcome of its last event of ``method``."""
    return (log.where(col("method") == method).groupBy(col("user_id").alias("query_id"))
            .agg(F.max_by("is_correct", F.struct("ts", "id")).alias("is_correct")))


@register("paired_compare", f"""
WITH {EVAL_LOG_SQL.strip()},
ranked AS (
  SELECT user_id AS query_id, method, is_correct,
         row_number() OVER (PARTITION BY user_id, method ORDER BY ts DESC, id DESC) AS rn
  FROM eval_log WHERE method IN ('view', 'click')),
j AS (
  SELECT b.query_id, b.is_correct AS b, t.is_correct AS t
  FROM (SELECT * FROM ranked WHERE method = 'view' AND rn = 1) b
  JOIN (SELECT * FROM ranked WHERE method = 'click' AND rn = 1) t ON b.query_id = t.query_id)
SELECT CAST(COUNT(*) AS BIGINT) AS queries,
       CAST(COUNT(*) FILTER (WHERE NOT b AND t) AS BIGINT) AS improved,
       CAST(COUNT(*) FILTER (WHERE b AND NOT t) AS BIGINT) AS regressed,
       CAST(COUNT(*) FILTER (WHERE b = t) AS BIGINT) AS unchanged,
       ROUND(AVG(CASE WHEN b THEN 1.0 ELSE 0.0 END) * 100, 4) AS baseline_accuracy,
       ROUND(AVG(CASE WHEN t THEN 1.0 ELSE 0.0 END) * 100, 4) AS treatment_accuracy,
       ROUND(ROUND(AVG(CASE WHEN t THEN 1.0 ELSE 0.0 END) * 100, 4)
             - ROUND(AVG(CASE WHEN b THEN 1.0 ELSE 0.0 END) * 100, 4), 4) AS delta_pp
FROM j""")
def paired_compare_q(spark, sf):
    log = eval_log(Tables(spark, sf))
    return paired_compare(last_outcome(log, "view"), last_outcome(log, "click"))


# ---------------------------------------------------------------- A25 / W9 / V-6
def attempts_log(t: Tables) -> DataFrame:
    """One row per attempt; ``at`` orders the attempts of a query."""
    return t.events.select(col("user_id").alias("query_id"), F.struct("ts", "event_id").alias("at"),
                           (col("event_type") != "error").alias("execution_success"),
                           (col("value") > 50).alias("is_correct"))


def retry_metrics(attempts: DataFrame) -> DataFrame:
    """First vs last attempt per query (min_by / max_by: partial aggregates,
    no attempt list is materialized), then the global roll-up."""
    per = attempts.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.min_by("is_correct", "at").alias("first_ok"),
        F.max_by("is_correct", "at").alias("last_ok"))
    return per.agg(F.count(F.lit(1)).alias("queries"),
                   F.count_if(col("first_ok")).alias("first_attempt_correct"),
                   F.count_if(col("last_ok")).alias("final_correct"),
                   F.count_if(~col("first_ok") & col("last_ok")).alias("fixed_by_retry"),
                   F.sum(col("attempts") - 1).cast("bigint").alias("retries_used"),
                   F.round(F.avg("attempts"), 4).alias("avg_attempts"))


@register("retry_metrics", """
WITH a AS (
  SELECT user_id AS query_id, value > 50 AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_num,
         COUNT(*) OVER (PARTITION BY user_id) AS attempts
  FROM events),
per AS (
  SELECT query_id, MAX(attempts) AS attempts,
         bool_or(ok AND attempt_num = 1) AS first_ok, bool_or(ok AND attempt_num = attempts) AS last_ok
  FROM a GROUP BY query_id)
SELECT CAST(COUNT(*) AS BIGINT) AS queries,
       CAST(COUNT(*) FILTER (WHERE first_ok) AS BIGINT) AS first_attempt_correct,
       CAST(COUNT(*) FILTER (WHERE last_ok) AS BIGINT) AS final_correct,
       CAST(COUNT(*) FILTER (WHERE NOT first_ok AND last_ok) AS BIGINT) AS fixed_by_retry,
       CAST(SUM(attempts - 1) AS BIGINT) AS retries_used,
       ROUND(AVG(attempts), 4) AS avg_attempts
FROM per""")
def retry_metrics_q(spark, sf):
    return retry_metrics(attempts_log(Tables(spark, sf)))


# ---------------------------------------------------------------- A26 / J10 / M1
def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_PRICING, "model string, input_price double, output_price double")


def usage_log(t: Tables) -> DataFrame:
    c = t.conversations
    tokens = F.ceil(F.length("text") / 4).cast("bigint")
    models = F.array(*[F.lit(m) for m in USAGE_MODELS])
    return c.select(
        F.element_at(models, (col("conv_id") % len(USAGE_MODELS) + 1).cast("int")).alias("model"),
        F.when(col("role").isin("user", "system"), tokens).otherwise(0).alias("input_tokens"),
        F.when(col("role") == "assistant", tokens).otherwise(0).alias("output_tokens"))


def cost_rollup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Token totals per model priced by lookup with a default (left join on
    the price list plus coalesce)."""
    tot = usage.groupBy("model").agg(F.sum("input_tokens").cast("bigint").alias("input_tokens"),
                                     F.sum("output_tokens").cast("bigint").alias("output_tokens"))
    p = tot.join(prices, "model", "left")  # AQE broadcasts the price list when it is small
    cost = (col("input_tokens") / 1e6 * F.coalesce(col("input_price"), F.lit(DEFAULT_PRICE[0]))
            + col("output_tokens") / 1e6 * F.coalesce(col("output_price"), F.lit(DEFAULT_PRICE[1])))
    return p.select("model", "input_tokens", "output_tokens", F.round(cost, 8).alias("cost_usd"))


_PRICES_SQL = ", ".join(f"('{m}', {i}, {o})" for m, i, o in MODEL_PRICING)
_MODELS_SQL = ", ".join(f"'{m}'" for m in USAGE_MODELS)


@register("cost_rollup", f"""
WITH u AS (
  SELECT [{_MODELS_SQL}][conv_id % {len(USAGE_MODELS)} + 1] AS model,
         CASE WHEN role IN ('user', 'system') THEN CAST(ceil(length(text) / 4) AS BIGINT) ELSE 0 END AS i,
         CASE WHEN role = 'assistant' THEN CAST(ceil(length(text) / 4) AS BIGINT) ELSE 0 END AS o
  FROM conversations),
prices(model, input_price, output_price) AS (VALUES {_PRICES_SQL}),
tot AS (SELECT model, CAST(SUM(i) AS BIGINT) AS input_tokens, CAST(SUM(o) AS BIGINT) AS output_tokens
        FROM u GROUP BY model)
SELECT t.model, input_tokens, output_tokens,
       ROUND(input_tokens / 1e6 * COALESCE(input_price, {DEFAULT_PRICE[0]})
             + output_tokens / 1e6 * COALESCE(output_price, {DEFAULT_PRICE[1]}), 8) AS cost_usd
FROM tot t LEFT JOIN prices p ON t.model = p.model""")
def cost_rollup_q(spark, sf):
    t = Tables(spark, sf)
    return cost_rollup(usage_log(t), price_table(spark))


# ---------------------------------------------------------------- A33
@register("difficulty_distribution", f"""
SELECT {DIFFICULTY_SQL} AS difficulty, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS queries,
       CAST(COUNT(*) AS BIGINT) AS rows
FROM events GROUP BY 1""")
def difficulty_distribution(spark, sf):
    log = eval_log(Tables(spark, sf))
    return log.groupBy("difficulty").agg(F.countDistinct("user_id").alias("queries"),
                                         F.count(F.lit(1)).alias("rows"))
