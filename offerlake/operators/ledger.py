"""Observation ledger: derived amounts, change detection, guards, projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.config import PRICING, SKEW, PricingRules, SkewRules
from offerlake.functions import scores
from offerlake.operators.skew import latest_per, with_previous, with_running_sum

LEDGER_ORDER = ("observed_at", "obs_id")
WATCHED = ("cash_price", "shipping_cost", "availability", "warranty_type", "warranty_provider", "warranty_months")


def derive_offer(df: DataFrame) -> DataFrame:
    """Free-shipping flag, delivered total (NULL while shipping is unknown) and discount."""
    price, shipping, old = F.col("cash_price"), F.col("shipping_cost"), F.col("old_price")
    free = F.coalesce(F.col("free_shipping"), shipping == 0)
    discount = F.greatest(old - price, F.lit(0))
    return df.withColumns(
        {
            "free_shipping": free,
            "total_price": F.when(free, price).when(shipping.isNotNull(), price + shipping),
            "discount_amount": discount,
            "discount_percent": discount / F.nullif(old, F.lit(0)),
        }
    )


def observed_price(df: DataFrame) -> Column:
    """Price of an observation for history and market statistics."""
    cash = F.col("cash_price")
    delivered = cash + F.coalesce(F.col("shipping_cost"), F.lit(0))
    return F.coalesce(F.col("total_price"), delivered, cash) if "total_price" in df.columns else F.coalesce(delivered, cash)


def _watched(df: DataFrame) -> Column:
    kind = {"cash_price": "decimal(24,4)", "shipping_cost": "decimal(24,4)", "warranty_months": "decimal(24,4)"}
    present = [c for c in WATCHED if c in df.columns]
    return F.struct(*[(F.col(c).cast(kind[c]) if c in kind else F.col(c)).alias(c) for c in present])


def change_type(previous: Column, current: Column, fields: Sequence[str]) -> Column:
    """First difference between two states in the order price, shipping, availability, warranty."""
    differs = lambda c: ~previous[c].eqNullSafe(current[c])
    label = F.when(previous.isNull() | previous["cash_price"].isNull(), "first_seen").when(
        differs("cash_price"), "price_changed"
    )
    if "shipping_cost" in fields:
        label = label.when(differs("shipping_cost"), "shipping_changed")
    if "availability" in fields:
        label = label.when(differs("availability"), "availability_changed")
    for name in ("warranty_type", "warranty_provider", "warranty_months"):
        if name in fields:
            label = label.when(differs(name), "warranty_changed")
    return label


def with_change_type(
    obs: DataFrame, keys: Sequence[str] = ("offer_key",), rules: SkewRules = SKEW
) -> DataFrame:
    """Label every observation against the previous one of its key; NULL means no change."""
    fields = [c for c in WATCHED if c in obs.columns]
    rows = with_previous(obs, keys, LEDGER_ORDER, {"_before": _watched(obs)}, rules)
    return rows.withColumn("change_type", change_type(F.col("_before"), _watched(obs), fields)).drop("_before")


def compact_ledger(obs: DataFrame, keys: Sequence[str] = ("offer_key",), rules: SkewRules = SKEW) -> DataFrame:
    """Only the observations that changed something."""
    return with_change_type(obs, keys, rules).filter(F.col("change_type").isNotNull())


def changes_against(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Incremental twin: label one batch (one row per offer) against the stored projection."""
    fields = [c for c in WATCHED if c in batch.columns]
    state = current.select(F.col("offer_key"), _watched(current).alias("_before"))
    joined = batch.join(state, "offer_key", "left")
    return joined.withColumn("change_type", change_type(F.col("_before"), _watched(batch), fields)).drop("_before")


def gate_against(batch: DataFrame, current: DataFrame, rules: PricingRules = PRICING) -> DataFrame:
    """Incremental ratio gate: ``accepted`` is false when the new price jumps too far from the stored one."""
    state = current.select(F.col("offer_key"), F.col("cash_price").alias("base_price"))
    joined = batch.join(state, "offer_key", "left")
    ratio = F.when(F.col("base_price") > 0, F.col("cash_price") / F.col("base_price"))
    inside = ratio.between(rules.min_ratio_to_previous, rules.max_ratio_to_previous)
    return joined.withColumn("accepted", F.coalesce(inside, F.lit(True)))


def cash_verdict(
    median: Column, price: Column, currency: Column, confidence: Column, availability: Column, rules: PricingRules = PRICING
) -> Column:
    """``struct(anomaly_status, anomaly_reasons)`` of one price against its market median."""
    label = scores.confidence_label(confidence)
    below = (F.upper(F.coalesce(currency, F.lit(rules.currency))) == rules.currency) & (price < rules.floor)
    below = F.coalesce(below, F.lit(False))
    known = median.isNotNull() & price.isNotNull() & ~below
    extreme = known & ((price < median * 0.25) | (price > median * 4))
    outlier = known & ~extreme & ((price < median * 0.55) | (price > median * 2))
    weak = label.isin("low", "ambiguous")
    gone = F.lower(F.coalesce(availability, F.lit(""))).isin("out_of_stock", "unavailable")
    status = F.when(below | extreme, "blocked").when(outlier | weak, "review").otherwise("clear")
    reasons = F.array_compact(
        F.array(
            F.when(below, "below_public_price_floor"),
            F.when(extreme, "extreme_market_outlier"),
            F.when(outlier, "market_outlier"),
            F.when(weak, "weak_variant_match"),
            F.when(gone, "not_currently_available"),
        )
    )
    return F.struct(status.alias("anomaly_status"), reasons.alias("anomaly_reasons"))


def market_median(
    obs: DataFrame, as_of: str | Column, days: int = PRICING.history_days, rules: PricingRules = PRICING
) -> DataFrame:
    """Exact median price per variant over the days before ``as_of``.

    ``percentile`` keeps a price histogram per variant and merges it map-side,
    so a variant with very many rows costs its distinct prices, not its rows.
    """
    at = scores.moment(as_of)
    price = observed_price(obs)
    window = obs.filter((F.col("observed_at") >= scores.days_before(at, days)) & (F.col("observed_at") < at))
    eligible = window.filter(price >= rules.floor)
    return eligible.groupBy("variant_id").agg(
        F.percentile(price.cast("double"), F.lit(0.5)).alias("market_median"),
        F.count(F.lit(1)).alias("market_samples"),
    )


def guard_batch(
    batch: DataFrame, ledger: DataFrame, as_of: str | Column, days: int = PRICING.history_days
) -> DataFrame:
    """Judge one ingest batch against the market of the days before it."""
    medians = market_median(ledger, as_of, days).drop("market_samples")
    rows = batch.join(medians, "variant_id", "left")
    verdict = cash_verdict(
        F.col("market_median"),
        F.col("cash_price").cast("double"),
        F.col("currency"),
        F.col("match_confidence"),
        F.col("availability"),
    )
    return rows.withColumn("_v", verdict).select("*", "_v.*").drop("_v")


def guard_instalment(plans: DataFrame) -> DataFrame:
    """Fill the calculated total and judge whether published amounts are consistent."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    expected = (
        zero("down_payment")
        + zero("periodic_payment") * zero("months")
        + zero("admin_fees")
        + zero("processing_fees")
        + zero("insurance_fees")
        + zero("other_fees")
        + zero("card_fees")
        + zero("shipping_cost")
        - zero("coupon_discount")
    )
    rows = plans.withColumn("_expected", expected)
    rows = rows.withColumn(
        "total_calculated",
        F.coalesce(F.col("total_calculated"), F.when(F.col("_expected") > 0, F.col("_expected"))),
    )
    total = F.coalesce(F.col("total_published"), F.col("total_calculated"), F.col("_expected"))
    below_down = total < zero("down_payment")
    inconsistent = F.coalesce(total < F.col("periodic_payment") * F.col("months") * 0.8, F.lit(False)) & ~below_down
    return rows.withColumns(
        {
            "anomaly_status": F.when(below_down, "blocked").when(inconsistent, "review").otherwise("clear"),
            "anomaly_reasons": F.array_compact(
                F.array(
                    F.when(below_down, "installment_total_below_down_payment"),
                    F.when(inconsistent, "installment_total_inconsistent"),
                )
            ),
        }
    ).drop("_expected")


def current_offers(ledger: DataFrame) -> DataFrame:
    """Latest state per offer with a pointer to the observation it came from."""
    latest = latest_per(ledger, ["offer_key"], LEDGER_ORDER)
    return latest.withColumnRenamed("obs_id", "current_observation_id").withColumnRenamed("observed_at", "updated_at")


def with_quality_status(obs: DataFrame, current: DataFrame) -> DataFrame:
    """Quality of an observation from its offer's anomaly status; missing fees come from the offer."""
    inherited = ["currency", "mandatory_fees", "card_fees", "coupon_discount"]
    state = current.select(
        "offer_key", F.col("anomaly_status").alias("_status"), *[F.col(c).alias("_c_" + c) for c in inherited]
    )
    rows = obs.join(state, "offer_key", "inner")
    filled = {
        c: F.coalesce(F.col(c), F.col("_c_" + c)) if c in obs.columns else F.col("_c_" + c) for c in inherited
    }
    quality = F.when(F.col("_status") == "blocked", "blocked").when(F.col("_status") == "clear", "verified").otherwise("review")
    return rows.withColumns({**filled, "quality_status": quality}).drop("_status", *["_c_" + c for c in inherited])


def failure_streaks(attempts: DataFrame, key: str = "mapping_id", rules: SkewRules = SKEW) -> DataFrame:
    """Failures in a row since the last success, for every attempt (``status`` success/failed)."""
    ok = F.when(F.col("status") == "success", 1).otherwise(0)
    runs = with_running_sum(
        attempts, [key], ["finished_at", "attempt_id"], F.col("finished_at"), ok, "_island", rules
    )
    failed = F.when(F.col("status") == "failed", 1).otherwise(0)
    out = with_running_sum(
        runs, [key, "_island"], ["finished_at", "attempt_id"], F.col("finished_at"), failed, "consecutive_failures", rules
    )
    return out.drop("_island")


def append_observations(ledger: DataFrame, batch: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Rows of a batch that may be appended: first of each key, and not in the ledger yet."""
    fresh = batch.dropDuplicates([key]) if "obs_id" not in batch.columns else _first_by_id(batch, key)
    return fresh.join(ledger.select(key), key, "left_anti")


def _first_by_id(batch: DataFrame, key: str) -> DataFrame:
    first = F.min_by(F.struct(*batch.columns), F.col("obs_id")).alias("_row")
    return batch.groupBy(key).agg(first).select(*[F.col("_row")[c].alias(c) for c in batch.columns])
