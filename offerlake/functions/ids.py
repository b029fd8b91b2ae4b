"""Stable identifiers, code validity and identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.numbers import key_text
from offerlake.functions.text import compact_key, let, normalized_text


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """``PREFIX-<hex>`` from the SHA-256 of the joined key parts."""
    digest = F.sha2(F.concat_ws("|", *[key_text(p) for p in parts]), 256)
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(digest, 1, length)))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def valid_gtin(c: Column) -> Column:
    """The digits of a trade item number of 8, 12, 13 or 14 digits, else NULL."""
    digits = digits_only(c)
    return F.when(F.length(digits).isin(8, 12, 13, 14), digits)


def distinctive_sku(compact: Column) -> Column:
    """Codes long and mixed enough to be searched inside free text."""
    numeric = compact.rlike(r"^\p{N}+$")
    mixed = (F.length(compact) >= 6) & compact.rlike(r"\p{L}") & compact.rlike(r"\p{Nd}")
    return F.when(numeric, F.length(compact) >= 8).otherwise(mixed)


def distinctive_model_token(c: Column) -> Column:
    """Model tokens that point to few products."""
    return let(
        compact_key(c),
        lambda k: (F.length(k) >= 3) & k.rlike(r"\p{L}") & (k.rlike(r"\p{Nd}") | (F.length(k) >= 5)),
    )


def identity_key(gtin: Column, brand: Column, sku: Column, store_id: Column, url: Column) -> Column:
    """Strongest identity of an observed product: trade number, brand and part number, or its URL."""
    number, maker, code = valid_gtin(gtin), compact_key(brand), compact_key(sku)
    return (
        F.when(number.isNotNull(), F.concat(F.lit("gtin:"), number))
        .when((maker != "") & (F.length(code) >= 4), F.concat_ws(":", F.lit("mpn"), maker, code))
        .otherwise(
            F.concat(F.lit("store_url:"), store_id.cast("string"), F.lit(":"), F.trim(F.coalesce(url, F.lit(""))))
        )
    )


def identity_strength(key: Column) -> Column:
    return F.when(key.startswith("gtin:"), 100).when(key.startswith("mpn:"), 90).otherwise(60)


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("CPE-"), F.upper(F.substring(F.sha2(key, 256), 1, 20)))


def candidate_fingerprint(gtin: Column, title: Column, brand: Column, sku: Column) -> Column:
    """Identity a discovered candidate carries by itself, else NULL."""
    number = valid_gtin(gtin)
    maker, code = normalized_text(brand), normalized_text(sku)
    in_title = F.regexp_extract(
        F.replace(normalized_text(title), F.lit(" "), F.lit("")), r"(?<![0-9])([0-9]{8}|[0-9]{12,14})(?![0-9])", 1
    )
    return (
        F.when(number.isNotNull(), F.concat(F.lit("gtin:"), number))
        .when(
            (maker != "") & (F.length(code) >= 4),
            F.concat(F.lit("brand-sku:"), F.substring(F.sha1(F.concat_ws("|", maker, code)), 1, 24)),
        )
        .when(in_title != "", F.concat(F.lit("gtin:"), in_title))
    )


def is_publishable(
    *,
    status: Column,
    url: Column,
    title: Column,
    price: Column,
    currency: Column,
    availability: Column,
    origin: Column,
    gtin: Column,
    brand: Column,
    sku: Column,
    method: Column,
    price_evidence: Column,
    signal_count: Column,
    floor: float = 10.0,
) -> Column:
    """Whether an observation may enter the public catalogue."""
    base = (
        (F.coalesce(status, F.lit("accepted")) != "rejected")
        & F.coalesce(url, F.lit("")).rlike("^https?://")
        & (F.length(normalized_text(title)) >= 3)
        & (F.coalesce(price.cast("double"), F.lit(0.0)) >= floor)
        & (F.upper(F.coalesce(currency, F.lit("EGP"))) == "EGP")
        & ~F.lower(F.coalesce(availability, F.lit(""))).isin("out_of_stock", "unavailable")
    )
    imported = F.coalesce(price_evidence, F.lit(False)) & (F.coalesce(signal_count, F.lit(0)) >= 2)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    discovered = (
        valid_gtin(gtin).isNotNull()
        | (has(brand) & has(sku))
        | F.coalesce(method, F.lit("")).rlike("^(?:jsonld|microdata|html_visible_direct)")
    )
    return base & F.when(origin == "catalog_import", imported).otherwise(discovered)
