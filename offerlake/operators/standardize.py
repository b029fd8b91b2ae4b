"""Standardising jobs: typed, normalised columns for whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.config import PRICING, SCHEDULE, PricingRules, RunSchedule
from offerlake.functions import ids, numbers, scores, specs, text, urls


def standardize_text(df: DataFrame, column: str) -> DataFrame:
    """Matching form, tokens, search key, slug and clean display text of one column."""
    c = F.col(column)
    return df.withColumn("normalized_text", text.normalized_text(c)).withColumns(
        {
            "tokens": text.tokens(F.col("normalized_text")),
            "search_key": text.search_key(c),
            "slug": text.slug(c),
            "clean_text": text.clean_text(c),
        }
    )


def standardize_prices(df: DataFrame, price: str, currency: str | None = None, availability: str | None = None) -> DataFrame:
    out = df.withColumns({"price": numbers.parsed_price(F.col(price)), "money": numbers.parsed_money(F.col(price))})
    if currency:
        out = out.withColumn("currency_code", numbers.currency_code(F.col(currency)))
    if availability:
        out = out.withColumn("availability_class", numbers.availability_class(F.col(availability)))
    return out


def standardize_urls(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.withColumns(
        {
            "normalized_url": urls.normalized_url(c),
            "canonical_url": urls.canonical_url(c),
            "host": urls.bare_host(c),
            "slug_title": urls.slug_title(c),
            "is_product_url": urls.is_product_url(c),
        }
    )


def filter_allowed_hosts(df: DataFrame, column: str, hosts: Sequence[str]) -> DataFrame:
    return df.filter(urls.host_allowed(F.col(column), F.array(*[F.lit(h) for h in hosts])))


def filter_product_urls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(urls.is_product_url(F.col(column)))


def standardize_specs(df: DataFrame, title: str) -> DataFrame:
    normalized = text.normalized_text(F.col(title))
    return df.withColumn("_n", normalized).withColumns(
        {
            "storage_values": specs.storage_values(F.col("_n")),
            "ram_values": specs.ram_values(F.col("_n")),
            "technical_specs": specs.technical_specs(F.col("_n")),
            "inferred_specs": specs.inferred_specs(F.col(title)),
        }
    ).drop("_n")


def standardize_ids(df: DataFrame, gtin: str, sku: str) -> DataFrame:
    return df.withColumns(
        {
            "valid_gtin": ids.valid_gtin(F.col(gtin)),
            "compact_sku": text.compact_key(F.col(sku)),
        }
    ).withColumn("distinctive_sku", ids.distinctive_sku(F.col("compact_sku")))


def with_freshness(df: DataFrame, column: str, as_of: str | Column, rules: PricingRules = PRICING) -> DataFrame:
    return df.withColumn("freshness", scores.freshness(F.col(column), scores.moment(as_of), rules))


def with_match_quality(df: DataFrame, confidence: str, explicit: str | None = None) -> DataFrame:
    given = F.col(explicit) if explicit else F.lit(None).cast("double")
    return df.withColumn("match_quality", scores.match_score(given, F.col(confidence)))


def local_time(ts: Column, timezone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), ts.cast("timestamp_ntz"))


def utc_time(ts: Column, timezone: str) -> Column:
    return F.convert_timezone(F.lit(timezone), F.lit("UTC"), ts)


def run_slot(ts: Column, schedule: RunSchedule = SCHEDULE) -> Column:
    """UTC start of the latest local refresh hour at or before ``ts``."""
    local = local_time(ts, schedule.timezone)
    midnight = F.date_trunc("day", local).cast("timestamp_ntz")
    slot = midnight - F.expr(f"INTERVAL '{24 - max(schedule.hours)}' HOUR")
    for h in sorted(schedule.hours):
        slot = F.when(F.hour(local) >= h, midnight + F.expr(f"INTERVAL '{h}' HOUR")).otherwise(slot)
    return utc_time(slot, schedule.timezone)


def next_run_slot(ts: Column, schedule: RunSchedule = SCHEDULE) -> Column:
    """UTC start of the first local refresh hour after ``ts``."""
    local = local_time(ts, schedule.timezone)
    midnight = F.date_trunc("day", local).cast("timestamp_ntz")
    slot = midnight + F.expr(f"INTERVAL '{24 + min(schedule.hours)}' HOUR")
    for h in sorted(schedule.hours, reverse=True):
        slot = F.when(F.hour(local) < h, midnight + F.expr(f"INTERVAL '{h}' HOUR")).otherwise(slot)
    return utc_time(slot, schedule.timezone)


def catalog_slot(ts: Column, schedule: RunSchedule = SCHEDULE) -> Column:
    """UTC start of the latest nightly catalogue slot at or before ``ts``."""
    local = local_time(ts, schedule.timezone)
    offset = F.expr(f"INTERVAL '{schedule.catalog_hour * 60 + schedule.catalog_minute}' MINUTE")
    return utc_time(F.date_trunc("day", local - offset).cast("timestamp_ntz") + offset, schedule.timezone)


def with_run_slot(df: DataFrame, column: str, schedule: RunSchedule = SCHEDULE) -> DataFrame:
    c = F.col(column)
    return df.withColumns({"run_slot": run_slot(c, schedule), "next_slot": next_run_slot(c, schedule)})


def bounded_payload(payload: Column, limit: int = 80_000) -> Column:
    """A JSON text when it is at most ``limit`` bytes, else its digest in place of the text."""
    digest = F.to_json(F.struct(F.lit(True).alias("truncated"), F.sha2(payload, 256).alias("sha256")))
    return F.when(F.octet_length(payload) <= limit, payload).otherwise(digest)


def with_search_documents(variants: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    names = ["canonical_name", "brand", "model", "variant_name", "manufacturer_sku", "gtin", "ram_gb", "storage_gb"]
    columns = {n: F.col(n) for n in names if n in variants.columns}
    columns.update({n: F.col(c) for n, c in (extra or {}).items()})
    return variants.withColumn("search_document", text.search_document(columns))
