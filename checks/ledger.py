"""Ledger, guard and merge checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from offerlake.operators import ledger, replay
from offerlake.sources.fixtures import AS_OF, DriverTables


@check(
    "offer_derivation",
    """
    SELECT obs_id, variant_id, store_id, observed_at::DATE::VARCHAR AS day,
      COALESCE(free_shipping, shipping_cost = 0) AS free_shipping,
      CAST(CASE WHEN COALESCE(free_shipping, shipping_cost = 0) THEN cash_price
           ELSE cash_price + shipping_cost END AS DOUBLE) AS total_price,
      CAST(GREATEST(old_price - cash_price, 0) AS DOUBLE) AS discount_amount,
      round(CAST(GREATEST(old_price - cash_price, 0) AS DOUBLE) / CAST(old_price AS DOUBLE), 6) AS discount_percent
    FROM fx_observations
    """,
)
def offer_derivation(t: DriverTables) -> DataFrame:
    rows = ledger.derive_offer(t.fx_observations)
    return rows.select(
        "obs_id",
        "variant_id",
        "store_id",
        F.to_date("observed_at").alias("day"),
        "free_shipping",
        "total_price",
        "discount_amount",
        F.round(
            F.col("discount_amount").cast("double") / F.col("old_price").cast("double"), 6
        ).alias("discount_percent"),
    )


_CHANGES = """
    WITH steps AS (
      SELECT *, row_number() OVER w AS rn, lag(cash_price) OVER w AS p, lag(availability) OVER w AS a
      FROM fx_coarse_stream WINDOW w AS (PARTITION BY offer_key ORDER BY observed_at, obs_id)),
    labelled AS (
      SELECT obs_id, offer_key, CASE WHEN rn = 1 THEN 'first_seen' WHEN cash_price <> p THEN 'price_changed'
        WHEN availability <> a THEN 'availability_changed' END AS change_type FROM steps)
"""


@check("change_types", _CHANGES + "SELECT obs_id, offer_key, change_type FROM labelled")
def change_types(t: DriverTables) -> DataFrame:
    return ledger.with_change_type(t.fx_coarse_stream).select("obs_id", "offer_key", "change_type")


@check(
    "compacted_ledger",
    _CHANGES + "SELECT obs_id, offer_key, change_type FROM labelled WHERE change_type IS NOT NULL",
)
def compacted_ledger(t: DriverTables) -> DataFrame:
    return ledger.compact_ledger(t.fx_coarse_stream).select("obs_id", "offer_key", "change_type")


@check(
    "ledger_change_types",
    """
    WITH steps AS (
      SELECT *, row_number() OVER w AS rn, lag(cash_price) OVER w AS p, lag(shipping_cost) OVER w AS s,
        lag(availability) OVER w AS a, lag(warranty_type) OVER w AS wt, lag(warranty_provider) OVER w AS wp,
        lag(warranty_months) OVER w AS wm
      FROM fx_observations WINDOW w AS (PARTITION BY offer_key ORDER BY observed_at, obs_id))
    SELECT obs_id, variant_id, CASE WHEN rn = 1 THEN 'first_seen' WHEN cash_price IS DISTINCT FROM p THEN 'price_changed'
        WHEN shipping_cost IS DISTINCT FROM s THEN 'shipping_changed'
        WHEN availability IS DISTINCT FROM a THEN 'availability_changed'
        WHEN wt IS DISTINCT FROM warranty_type OR wp IS DISTINCT FROM warranty_provider
          OR wm IS DISTINCT FROM warranty_months THEN 'warranty_changed' END AS change_type
    FROM steps
    """,
)
def ledger_change_types(t: DriverTables) -> DataFrame:
    return ledger.with_change_type(t.fx_observations).select("obs_id", "variant_id", "change_type")


@check(
    "price_ratio_gate",
    """
    WITH RECURSIVE steps AS (
      SELECT *, row_number() OVER (PARTITION BY offer_key ORDER BY observed_at, obs_id) AS rn FROM fx_price_stream),
    walk AS (
      SELECT offer_key, obs_id, rn, CAST(cash_price AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS base, true AS ok
      FROM steps WHERE rn = 1
      UNION ALL
      SELECT s.offer_key, s.obs_id, s.rn, CAST(s.cash_price AS DOUBLE), CASE WHEN w.ok THEN w.price ELSE w.base END,
        CAST(s.cash_price AS DOUBLE) / (CASE WHEN w.ok THEN w.price ELSE w.base END) BETWEEN 0.2 AND 5.0
      FROM walk w JOIN steps s ON s.offer_key = w.offer_key AND s.rn = w.rn + 1)
    SELECT obs_id, offer_key, ok AS accepted, base AS base_price FROM walk
    """,
)
def price_ratio_gate(t: DriverTables) -> DataFrame:
    return replay.gate_price_ratio(t.fx_price_stream).select("obs_id", "offer_key", "accepted", "base_price")


@check(
    "market_guard_replay",
    """
    WITH priced AS (
      SELECT *, CAST(cash_price + COALESCE(shipping_cost, 0) AS DOUBLE) AS seen FROM fx_observations),
    med AS (
      SELECT *, quantile_cont(seen, 0.5) FILTER (WHERE seen >= 10) OVER (PARTITION BY variant_id ORDER BY observed_at
        RANGE BETWEEN INTERVAL 720 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS m FROM priced),
    judged AS (
      SELECT *, CAST(cash_price AS DOUBLE) AS price, m IS NOT NULL AND (cash_price < m * 0.25 OR cash_price > m * 4) AS ex,
        m IS NOT NULL AND (cash_price < m * 0.55 OR cash_price > m * 2) AS ou FROM med)
    SELECT obs_id, variant_id, round(m, 4) AS market_median,
      CASE WHEN ex THEN 'blocked' WHEN ou OR match_confidence = 'low' THEN 'review' ELSE 'clear' END AS anomaly_status,
      concat_ws(',', CASE WHEN ex THEN 'extreme_market_outlier' WHEN ou THEN 'market_outlier' END,
        CASE WHEN match_confidence = 'low' THEN 'weak_variant_match' END,
        CASE WHEN availability = 'out_of_stock' THEN 'not_currently_available' END) AS anomaly_reasons
    FROM judged
    """,
)
def market_guard_replay(t: DriverTables) -> DataFrame:
    rows = replay.guard_cash(t.fx_observations, days=720)
    return rows.select(
        "obs_id", "variant_id", F.round("market_median", 4).alias("market_median"), "anomaly_status", "anomaly_reasons"
    )


@check(
    "market_guard_batch",
    """
    WITH batch AS (SELECT * FROM fx_observations WHERE observed_at >= {as_of}),
    med AS (
      SELECT variant_id, quantile_cont(CAST(cash_price + COALESCE(shipping_cost, 0) AS DOUBLE), 0.5) AS m
      FROM fx_observations
      WHERE observed_at < {as_of} AND observed_at >= {as_of} - INTERVAL 720 DAY GROUP BY 1)
    SELECT obs_id, variant_id, round(m, 4) AS market_median,
      CASE WHEN cash_price < m * 0.25 OR cash_price > m * 4 THEN 'blocked'
           WHEN cash_price < m * 0.55 OR cash_price > m * 2 OR match_confidence = 'low' THEN 'review'
           ELSE 'clear' END AS anomaly_status
    FROM batch LEFT JOIN med USING (variant_id)
    """,
)
def market_guard_batch(t: DriverTables) -> DataFrame:
    obs = t.fx_observations
    batch = obs.filter(F.col("observed_at") >= F.lit(AS_OF).cast("timestamp_ntz"))
    rows = ledger.guard_batch(batch, obs, AS_OF, days=720)
    return rows.select("obs_id", "variant_id", F.round("market_median", 4).alias("market_median"), "anomaly_status")


@check(
    "instalment_guard",
    """
    WITH e AS (
      SELECT *, COALESCE(down_payment,0) + periodic_payment * COALESCE(months,0) + COALESCE(admin_fees,0)
        + COALESCE(shipping_cost,0) - COALESCE(coupon_discount,0) AS expected FROM fx_plans),
    f AS (SELECT *, COALESCE(total_published, CASE WHEN expected > 0 THEN expected END, expected) AS total FROM e)
    SELECT plan_id, variant_id, CAST(CASE WHEN expected > 0 THEN expected END AS DOUBLE) AS total_calculated,
      CASE WHEN total < COALESCE(down_payment,0) THEN 'blocked'
           WHEN total < periodic_payment * months * 0.8 THEN 'review' ELSE 'clear' END AS anomaly_status,
      COALESCE(CASE WHEN total < COALESCE(down_payment,0) THEN 'installment_total_below_down_payment'
           WHEN total < periodic_payment * months * 0.8 THEN 'installment_total_inconsistent' END, '') AS anomaly_reasons
    FROM f
    """,
)
def instalment_guard(t: DriverTables) -> DataFrame:
    return ledger.guard_instalment(t.fx_plans).select(
        "plan_id", "variant_id", "total_calculated", "anomaly_status", "anomaly_reasons"
    )


@check(
    "current_offer_projection",
    """
    SELECT offer_key, CAST(cash_price AS DOUBLE) AS cash_price, obs_id AS current_observation_id,
      strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM fx_ranked_observations WHERE rn = 1
    """,
)
def current_offer_projection(t: DriverTables) -> DataFrame:
    return ledger.current_offers(t.fx_observations).select(
        "offer_key", "cash_price", "current_observation_id", "updated_at"
    )


@check(
    "observation_quality",
    """
    SELECT o.obs_id, o.offer_key,
      CASE f.anomaly_status WHEN 'blocked' THEN 'blocked' WHEN 'clear' THEN 'verified' ELSE 'review' END AS quality_status,
      CAST(f.mandatory_fees AS DOUBLE) AS mandatory_fees,
      CAST(COALESCE(o.coupon_discount, f.coupon_discount) AS DOUBLE) AS coupon_discount
    FROM fx_observations o JOIN fx_offers f ON f.offer_key = o.offer_key
    """,
)
def observation_quality(t: DriverTables) -> DataFrame:
    return ledger.with_quality_status(t.fx_observations, t.fx_offers).select(
        "obs_id", "offer_key", "quality_status", "mandatory_fees", "coupon_discount"
    )


@check(
    "failure_streaks",
    """
    WITH done AS (SELECT * FROM fx_tasks WHERE status <> 'running'),
    i AS (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY store_id
            ORDER BY finished_at, task_id) AS island FROM done)
    SELECT task_id, store_id, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (
      PARTITION BY store_id, island ORDER BY finished_at, task_id) AS BIGINT) AS consecutive_failures FROM i
    """,
)
def failure_streaks(t: DriverTables) -> DataFrame:
    attempts = t.fx_tasks.filter(F.col("status") != "running").withColumnRenamed("task_id", "attempt_id")
    out = ledger.failure_streaks(attempts, "store_id")
    return out.select(F.col("attempt_id").alias("task_id"), "store_id", "consecutive_failures")


@check(
    "append_only_ledger",
    """
    WITH keyed AS (SELECT *, concat(CAST(offer_key AS VARCHAR), '|', CAST(observed_at::DATE AS VARCHAR)) AS k
                   FROM fx_price_stream),
    old AS (SELECT DISTINCT k FROM keyed WHERE observed_at < TIMESTAMP '2024-01-16 12:00:00'),
    fresh AS (SELECT k, min(obs_id) AS obs_id FROM keyed WHERE observed_at >= TIMESTAMP '2024-01-16 12:00:00' GROUP BY 1)
    SELECT obs_id, k AS idempotency_key FROM fresh WHERE k NOT IN (SELECT k FROM old)
    """,
)
def append_only_ledger(t: DriverTables) -> DataFrame:
    key = F.concat(F.col("offer_key").cast("string"), F.lit("|"), F.to_date("observed_at").cast("string"))
    rows = t.fx_price_stream.withColumn("idempotency_key", key)
    border = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    stored, batch = rows.filter(F.col("observed_at") < border), rows.filter(F.col("observed_at") >= border)
    return ledger.append_observations(stored, batch).select("obs_id", "idempotency_key")
