"""Freshness, match quality and the component scores of an offer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.config import PRICING, PricingRules


def moment(as_of: str | datetime | Column) -> Column:
    """An explicit point in time as a zone-less timestamp (the ledger is kept in UTC)."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{minutes}' MINUTE")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{days}' DAY")


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{hours}' HOUR")


def freshness(last_success: Column, as_of: Column, rules: PricingRules = PRICING) -> Column:
    """unseen, fresh, late or stale."""
    return (
        F.when(last_success.isNull(), "unseen")
        .when(last_success >= minutes_before(as_of, rules.fresh_minutes), "fresh")
        .when(last_success >= minutes_before(as_of, rules.stale_minutes), "late")
        .otherwise("stale")
    )


# One confidence vocabulary for both spellings in the data.
CONFIDENCE_WORDS = {"عالية": "high", "متوسطة": "medium", "منخفضة": "low"}
CONFIDENCE_SCORES = {"high": 95.0, "medium": 72.0, "low": 38.0, "ambiguous": 20.0}
CONFIDENCE_DEFAULT = 55.0
AVAILABILITY_SCORES = {
    "available": 100.0,
    "in_stock": 100.0,
    "limited": 82.0,
    "preorder": 55.0,
    "unknown": 38.0,
    "out_of_stock": 0.0,
    "unavailable": 0.0,
}
AVAILABILITY_DEFAULT = 38.0


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    chosen = None
    for name, score in table.items():
        chosen = F.when(key == name, score) if chosen is None else chosen.when(key == name, score)
    return chosen.otherwise(default)


def confidence_label(c: Column) -> Column:
    """Match confidence as high / medium / low / ambiguous, whatever language it was stored in."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for word, label in CONFIDENCE_WORDS.items():
        text = F.when(text == word, label).otherwise(text)
    return text


def confidence_score(c: Column) -> Column:
    return _lookup(confidence_label(c), CONFIDENCE_SCORES, CONFIDENCE_DEFAULT)


def score_label(score: Column) -> Column:
    """Confidence label of a match score."""
    return F.when(score >= 80, "high").when(score >= 55, "medium").otherwise("low")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bounded and rounded to three places; NULL stays NULL."""
    return F.when(c.isNotNull(), F.round(F.greatest(F.lit(low), F.least(F.lit(high), c)), 3))


def match_score(explicit: Column, confidence: Column) -> Column:
    return F.coalesce(clamp(explicit.cast("double")), confidence_score(confidence))


def freshness_score(last_success: Column, as_of: Column) -> Column:
    def within(h: int) -> Column:
        return last_success >= hours_before(as_of, h)

    return (
        F.when(last_success.isNull(), 25.0)
        .when(within(6), 100.0)
        .when(within(24), 90.0)
        .when(within(48), 72.0)
        .when(within(96), 48.0)
        .otherwise(20.0)
    )


def availability_score(c: Column) -> Column:
    return _lookup(F.lower(F.coalesce(c, F.lit("unknown"))), AVAILABILITY_SCORES, AVAILABILITY_DEFAULT)


def warranty_score(months: Column, kind: Column, provider: Column) -> Column:
    length = F.coalesce(months.cast("double"), F.lit(0.0))
    label = F.lower(F.coalesce(kind, F.lit("")))
    official = label.contains("official") | label.contains("manufacturer") | label.contains("رسمي")
    return clamp(
        F.lit(15.0)
        + F.when(length >= 12, 35).when(length > 0, 20).otherwise(0)
        + F.when(official, 35).when(label != "", 20).otherwise(0)
        + F.when(F.trim(F.coalesce(provider, F.lit(""))) != "", 15).otherwise(0)
    )


def store_score(metrics: list[Column], store_verified: Column, seller_verified: Column, broken_rate: Column) -> Column:
    """Mean of the known quality metrics (55 when none), plus verification, minus broken links."""
    known = F.filter(F.array(*[m.cast("double") for m in metrics]), lambda m: m.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, m: a + m) / F.nullif(F.size(known), F.lit(0))
    return clamp(
        F.coalesce(mean, F.lit(55.0))
        + F.when(store_verified, 10).otherwise(0)
        + F.when(seller_verified, 5).otherwise(0)
        - F.coalesce(broken_rate.cast("double"), F.lit(0.0)) * 30
    )


def delivery_score(pickup: Column, min_days: Column, max_days: Column) -> Column:
    days = F.coalesce(max_days, min_days)
    return (
        F.when(pickup, 100.0)
        .when(days.isNull(), 40.0)
        .when(days <= 1, 96.0)
        .when(days <= 2, 86.0)
        .when(days <= 4, 70.0)
        .when(days <= 7, 48.0)
        .otherwise(25.0)
    )


def price_position(cost: Column, average: Column, low: Column, sufficient: Column) -> Column:
    """``struct(tone, percent_vs_average)`` of a cost against its 90-day history."""
    percent = F.round((cost - average) / average * 100, 2)
    usable = cost.isNotNull() & F.coalesce(sufficient, F.lit(False))
    has_average = F.coalesce(average > 0, F.lit(False))
    tone = (
        F.when(~usable, "unknown")
        .when(~has_average, "neutral")
        .when(F.coalesce((low != 0) & (cost <= low * 1.02), F.lit(False)), "excellent")
        .when(percent <= -7, "good")
        .when(percent <= 3, "fair")
        .when(percent <= 10, "high")
        .otherwise("expensive")
    )
    return F.struct(tone.alias("tone"), F.when(usable & has_average, percent).alias("percent_vs_average"))
