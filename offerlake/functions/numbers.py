"""Numbers, money, currency, availability and typed casts from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.text import ascii_digits, let, normalized_text, squeeze, strip

# Words that decide the availability class, in order of precedence.
AVAILABILITY_WORDS = (
    ("out_of_stock", ("outofstock", "out of stock", "sold out", "غير متوفر", "نفد", "غير متاح", "unavailable")),
    ("limited", ("limited", "كمية محدودة", "اخر قطعة", "last piece")),
    ("preorder", ("preorder", "pre order", "طلب مسبق", "احجز")),
    ("available", ("instock", "in stock", "متوفر", "available", "اضف للسلة", "add to cart")),
)

# Currency markers in normalised text, and signs in the raw text.
CURRENCY_MARKERS = (
    ("EGP", ("egp", "جنيه", "ج م", "ج.م"), None),
    ("USD", ("usd",), "$"),
    ("EUR", ("eur",), "€"),
    ("SAR", ("sar", "ريال سعودي"), None),
    ("AED", ("aed", "درهم"), None),
)

# Spellings of true in seed files.
TRUE_WORDS = ("true", "1", "yes", "نعم", "صح")


def parsed_number(c: Column) -> Column:
    """First number in a text under local separators.

    ``1.234,5`` and ``1,234.5`` are 1234.5; ``1,5`` is 1.5; ``12.500`` is 12500;
    digits separated by blanks are joined.
    """
    found = F.regexp_extract(ascii_digits(c.cast("string")), r"(?U)[-+]?[0-9][0-9\s,٬.٫]*", 0)
    return let(F.translate(F.replace(found, F.lit(" "), F.lit("")), "٬٫", ",."), _from_separators)


def _from_separators(raw: Column) -> Column:
    no_commas = F.replace(raw, F.lit(","), F.lit(""))
    no_dots = F.replace(raw, F.lit("."), F.lit(""))
    comma_to_dot = F.replace(raw, F.lit(","), F.lit("."))
    has_comma, has_dot = raw.contains(","), raw.contains(".")
    plain = (
        F.when(has_comma & has_dot & raw.rlike(r"\.[^,.]*\z"), no_commas)
        .when(has_comma & has_dot, F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(has_comma & raw.rlike(r"\A[^,]*,[^,]{1,2}\z"), comma_to_dot)
        .when(has_comma, no_commas)
        .when(raw.rlike(r"\..*\.") | raw.rlike(r"[^.]\.[^.]{3}\z"), no_dots)
        .otherwise(raw)
    )
    return strip(plain).try_cast("double")


def parsed_price(c: Column) -> Column:
    """A positive amount rounded to two places, else NULL."""
    return let(parsed_number(c), lambda v: F.when(v > 0, F.round(v, 2)))


def parsed_money(c: Column) -> Column:
    """A non-negative amount rounded to two places, else NULL."""
    return let(parsed_number(c), lambda v: F.when(v >= 0, F.round(v, 2)))


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def currency_code(c: Column, default: str = "EGP") -> Column:
    def choose(text: Column) -> Column:
        chosen = None
        for code, words, sign in CURRENCY_MARKERS:
            hit = _mentions(text, words)
            if sign:
                hit = hit | F.coalesce(c, F.lit("")).contains(sign)
            chosen = F.when(hit, code) if chosen is None else chosen.when(hit, code)
        return chosen.otherwise(default)

    return let(normalized_text(c), choose)


def availability_class(c: Column) -> Column:
    """out_of_stock, limited, preorder, available, unknown; NULL for empty text."""

    def choose(text: Column) -> Column:
        chosen = F.when(text == "", F.lit(None).cast("string"))
        for label, words in AVAILABILITY_WORDS:
            chosen = chosen.when(_mentions(text, words), label)
        return chosen.otherwise("unknown")

    return let(normalized_text(c), choose)


def import_currency(currency: Column, price_text: Column) -> Column:
    """Currency of an imported record: EGP markers win, then a three-letter code."""
    both = F.lower(F.concat_ws(" ", currency, price_text))
    code = F.regexp_extract(F.upper(F.coalesce(currency, F.lit(""))), r"\b([A-Z]{3})\b", 1)
    return F.when(both.contains("egp") | both.contains("جنيه") | both.rlike(r"(?U)\ble\b"), "EGP").when(
        code != "", code
    )


def import_price(c: Column) -> Column:
    """Price text of an imported record: grouped thousands and one decimal part."""
    raw = F.regexp_extract(c.cast("string"), r"(?:\d{1,3}(?:[,. ]\d{3})+|\d+)(?:[.,]\d{1,2})?", 0)
    raw = F.replace(raw, F.lit(" "), F.lit(""))
    value = (
        F.when(raw.contains(",") & raw.contains("."), F.replace(raw, F.lit(","), F.lit("")))
        .when(raw.rlike(r"^[^,]*,[^,]{0,2}$"), F.replace(raw, F.lit(","), F.lit(".")))
        .otherwise(F.replace(raw, F.lit(","), F.lit("")))
    ).try_cast("decimal(24,6)")
    return F.when((value > 0) & (value <= 1_000_000_000), value.cast("double"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def seed_number(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def seed_integer(c: Column) -> Column:
    return F.coalesce(seed_number(c).cast("bigint"), F.lit(0).cast("bigint"))


def seed_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def seed_timestamp(c: Column) -> Column:
    return blank_to_null(c).try_cast("timestamp")


def key_text(c: Column) -> Column:
    """Key part of a stable id: trimmed, lower case, single blanks."""
    return F.lower(squeeze(F.coalesce(c.cast("string"), F.lit(""))))
