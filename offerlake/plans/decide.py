"""True costs, decision and safety scores, mode orders and purchase decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.config import PRICING, SKEW, WEIGHTS, PricingRules, ScoreWeights, SkewRules
from offerlake.functions import scores
from offerlake.functions.scores import clamp, moment
from offerlake.operators.skew import earliest_per, with_row_numbers, with_row_numbers_by_size
from offerlake.plans.views import installment_cost

# Availability classes a shopper can buy from.
PURCHASABLE = ("available", "in_stock", "limited")

QUALITY_METRICS = (
    "price_accuracy_score",
    "update_regularity_score",
    "availability_clarity_score",
    "warranty_clarity_score",
    "correct_destination_score",
)


def cash_final_cost(df: DataFrame, rules: PricingRules = PRICING) -> Column:
    """First published total of at least the floor, else the sum of the known parts."""
    column = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    zero = lambda c: F.coalesce(column(c), F.lit(0.0))
    published = F.coalesce(
        *[F.when(column(c) >= rules.floor, column(c)) for c in ("final_cost", "comparable_total", "total_price")]
    )
    summed = F.greatest(
        column("cash_price") + zero("shipping_cost") + zero("mandatory_fees") + zero("card_fees") - zero("coupon_discount"),
        F.lit(0.0),
    )
    return F.when(column("cash_price") >= rules.floor, F.round(F.coalesce(published, summed), 2))


def instalment_final_cost() -> Column:
    """Published, then calculated, then summed cost; NULL for incomplete plans."""
    positive = lambda c: F.when(c > 0, c)
    parts = positive(F.col("periodic_payment")) * positive(F.col("months"))
    return F.coalesce(
        positive(F.col("total_published")),
        positive(F.col("total_calculated")),
        F.when(parts.isNotNull(), installment_cost()),
    ).cast("double")


def with_components(offers: DataFrame, as_of: str | Column) -> DataFrame:
    """Component scores that depend on the offer alone."""
    at = moment(as_of)
    column = lambda c: F.col(c) if c in offers.columns else F.lit(None)
    shipping = F.coalesce(column("shipping_cost").cast("double"), F.lit(0.0))
    return offers.withColumns(
        {
            "store_component": scores.store_score(
                [column(m) for m in QUALITY_METRICS],
                F.coalesce(column("store_verified").cast("boolean"), F.lit(False)),
                F.coalesce(column("seller_verified").cast("boolean"), F.lit(False)),
                column("broken_link_rate"),
            ),
            "shipping_component": F.when(shipping == 0, 100.0).otherwise(72.0),
            "availability_component": scores.availability_score(column("availability").cast("string")),
            "warranty_component": scores.warranty_score(
                column("warranty_months"), column("warranty_type").cast("string"), column("warranty_provider").cast("string")
            ),
            "freshness_component": scores.freshness_score(column("last_success_at").cast("timestamp_ntz"), at),
            "match_component": scores.match_score(column("match_quality_score"), column("match_confidence").cast("string")),
            "delivery_component": scores.delivery_score(
                F.coalesce(column("pickup_available").cast("boolean"), F.lit(False)),
                column("min_delivery_days"),
                column("max_delivery_days"),
            ),
        }
    )


def score_offers(
    offers: DataFrame,
    history: DataFrame,
    as_of: str | Column,
    rules: PricingRules = PRICING,
    weights: ScoreWeights = WEIGHTS,
) -> DataFrame:
    """Decision score, safety score and price position of every visible offer.

    The cheapest clear cost of a variant (any cost if none is clear) and its
    number of offers come from one aggregate joined back, not from a window,
    so a variant with very many offers stays spread.
    """
    visible = offers.filter(
        (F.coalesce("anomaly_status", F.lit("clear")) != "blocked") & (F.col("cash_price") >= rules.floor)
    )
    costed = visible.withColumn("final_cost", cash_final_cost(visible, rules)).filter(F.col("final_cost") >= rules.floor)
    costed = costed.withColumn("is_clear", F.coalesce("anomaly_status", F.lit("clear")) == "clear")
    market = costed.groupBy("variant_id").agg(
        F.coalesce(F.min(F.when(F.col("is_clear"), F.col("final_cost"))), F.min("final_cost")).alias("_lowest"),
        F.count(F.lit(1)).alias("market_offers"),
    )
    past = history.select(
        "variant_id",
        F.col("average_90d").cast("double"),
        F.col("lowest_90d").cast("double"),
        "sufficient_for_recommendation",
    )
    def weighted(table: dict[str, float]) -> Column:
        total = F.lit(0.0)
        for name, weight in table.items():
            total = total + F.col(f"{name}_component") * weight
        return clamp(total)

    judged = with_components(costed, as_of).withColumn("safety_score", weighted(weights.safety))
    rows = judged.join(market.join(past, "variant_id", "left"), "variant_id", "left")
    gap = (F.col("final_cost") - F.col("_lowest")) / F.greatest(F.col("_lowest"), F.lit(1.0))
    rows = rows.withColumns(
        {
            "price_component": clamp(100 - gap * 140),
            "market_coverage_component": clamp(F.col("market_offers") * 18.0),
        }
    )

    position = scores.price_position(
        F.col("final_cost"), F.col("average_90d"), F.col("lowest_90d"), F.col("sufficient_for_recommendation")
    )
    return rows.withColumns(
        {
            "decision_score": weighted(weights.decision),
            "verification_status": F.when(F.col("is_clear"), "verified").otherwise("needs_review"),
            "price_position": position,
        }
    ).drop("_lowest")


def with_reasons(scored: DataFrame, limit: int = 4) -> DataFrame:
    """First reasons why an offer is attractive, as codes; needs ``cheapest_rank``."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("cheapest_rank") == 1, "lowest_final_cost"),
            F.when(F.col("store_component") >= 75, "strong_store"),
            F.when(F.col("availability_component") >= 80, "confirmed_availability"),
            F.when(F.col("warranty_component") >= 70, "clear_warranty"),
            F.when(F.col("freshness_component") >= 80, "recent_update"),
            F.when(F.col("match_component") >= 85, "strong_match"),
            F.when(F.col("market_offers") >= 3, "confirmed_by_market"),
        )
    )
    return scored.withColumn("reasons", F.slice(reasons, 1, limit))


def mode_orders(scored: DataFrame, skew: SkewRules = SKEW, wanted: Sequence[str] | None = None) -> DataFrame:
    """Ranks of every offer under the cheapest, safest and fastest orders (clear offers first), or those ``wanted``."""
    review = (~F.col("is_clear")).cast("int")

    def order(value: Column) -> tuple[list, Column]:
        return [review, value, "offer_id"], review.cast("double") * 1e12 + value

    orders = {
        "cheapest_rank": order(F.col("final_cost")),
        "safest_rank": order(-F.col("safety_score")),
        "fastest_rank": order(-F.col("delivery_component")),
    }
    if wanted is not None:
        orders = {name: orders[name] for name in wanted}
    return with_row_numbers_by_size(scored, ["variant_id"], orders, "market_offers", skew)


def rank_plans(plans: DataFrame, skew: SkewRules = SKEW) -> DataFrame:
    """Instalment plans without duplicates, ranked by true cost, with their warning flags."""
    costed = plans.filter((F.coalesce("anomaly_status", F.lit("clear")) != "blocked") & (F.col("months") > 0))
    costed = costed.withColumn("final_installment_cost", instalment_final_cost())
    costed = costed.filter(F.col("final_installment_cost").isNotNull()).withColumns(
        {
            "_provider": F.lower(F.coalesce("provider_name", F.lit(""))),
            "_down": F.coalesce("down_payment", F.lit(0)),
        }
    )
    same = ["variant_id", "store_id", "_provider", "months", "periodic_payment", "_down", "final_installment_cost"]
    distinct = earliest_per(costed, same, ["plan_id"]).drop("_provider", "_down")
    order = (["final_installment_cost", "plan_id"], F.col("final_installment_cost"))
    ranked = with_row_numbers(distinct, ["variant_id"], {"installment_rank": order}, skew)
    cash, monthly = F.col("cash_price_at_observation"), F.col("periodic_payment")
    trap = (monthly < cash * 0.08) & (F.col("final_installment_cost") > cash * 1.18)
    return ranked.withColumns(
        {
            "lowest_total": F.col("installment_rank") == 1,
            "low_payment_high_total": F.coalesce(trap & (monthly > 0) & (cash > 0), F.lit(False)),
        }
    )


def purchase_decisions(scored: DataFrame) -> DataFrame:
    """One decision per variant: best offer, whether it may be recommended, and the savings spread."""
    lead = F.struct((~F.col("is_clear")).alias("review"), "final_cost", "offer_id")
    best = F.min_by(
        F.struct(
            "offer_id", "store_id", "final_cost", "decision_score", "availability", "is_clear", "match_component",
            "price_position", "sufficient_for_recommendation",
        ),
        lead,
    )
    trusted = F.col("is_clear") & F.coalesce("availability", F.lit("")).isin(*PURCHASABLE)
    rows = scored.groupBy("variant_id").agg(
        best.alias("b"),
        F.count_distinct("store_id").alias("known_store_count"),
        F.min_by("final_cost", F.struct((~trusted).alias("t"), (~F.col("is_clear")).alias("c"), "final_cost")).alias("_price"),
        F.max(F.when(trusted, F.col("final_cost"))).alias("_highest"),
    )
    ready = (
        F.coalesce(F.col("b.sufficient_for_recommendation"), F.lit(False))
        & F.col("b.is_clear")
        & F.lower(F.coalesce("b.availability", F.lit(""))).isin(*PURCHASABLE)
        & (F.col("b.match_component") >= 70)
    )
    return rows.select(
        "variant_id",
        F.col("b.offer_id").alias("best_offer_id"),
        F.col("b.store_id").alias("best_store_id"),
        F.col("b.final_cost").alias("best_final_cost"),
        ready.alias("recommendation_ready"),
        F.when(ready, F.col("b.decision_score")).alias("score"),
        F.when(ready, F.col("b.price_position.tone")).otherwise("unknown").alias("tone"),
        F.when(ready, F.col("b.price_position.percent_vs_average")).alias("percent_vs_average"),
        "known_store_count",
        F.greatest(F.col("_highest") - F.col("_price"), F.lit(0.0)).alias("savings_spread"),
    )


def filter_offers(
    offers: DataFrame, in_stock_only: bool = False, official_warranty: bool = False, pickup: bool = False
) -> DataFrame:
    """Shopper filters of the comparison table."""
    out = offers
    if in_stock_only:
        out = out.filter(F.col("availability").isin(*PURCHASABLE))
    if official_warranty:
        kind = F.lower(F.concat_ws(" ", "warranty_type", "warranty_provider"))
        out = out.filter(kind.contains("official") | kind.contains("manufacturer") | kind.contains("رسمي"))
    if pickup:
        out = out.filter(F.coalesce("pickup_available", F.lit(False)))
    return out


def _named_in_pounds(df: DataFrame, currency: str) -> Column:
    code = F.upper(F.trim(F.coalesce("currency", F.lit(currency))))
    return (code == currency) & (F.trim(F.coalesce("store_name", F.lit(""))) != "")


def valid_offers(offers: DataFrame, rules: PricingRules = PRICING) -> DataFrame:
    """Offers fit to be served: a public price, the public currency and a named store."""
    return offers.filter((F.col("cash_price") >= rules.floor) & _named_in_pounds(offers, rules.currency))


def served_plans(plans: DataFrame, rules: PricingRules = PRICING) -> DataFrame:
    """Plans fit to be served, the first of each (store, provider, duration, payment, total)."""
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    amounts = [c for c in ("periodic_payment", "normalized_total", "total_published", "total_calculated") if c in plans.columns]
    useful = positive(amounts[0])
    for name in amounts[1:]:
        useful = useful | positive(name)
    valid = plans.filter(_named_in_pounds(plans, rules.currency) & positive("months") & useful).withColumns(
        {
            "_store": F.lower(F.trim("store_name")),
            "_provider": F.lower(F.trim(F.coalesce("provider_name", F.lit("")))),
            "_down": F.coalesce("down_payment", F.lit(0)),
            "_total": F.coalesce(*[c for c in amounts if c != "periodic_payment"]),
        }
    )
    same = ["variant_id", "_store", "_provider", "months", "periodic_payment", "_down", "_total"]
    return earliest_per(valid, same, ["plan_id"]).drop("_store", "_provider", "_down", "_total")
