"""Text normal forms, tokens and trigrams as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic-Indic and extended Arabic-Indic digits and their ASCII twins.
LOCAL_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"

# Bilingual search aliases.
SEARCH_ALIASES = {
    "ايفون": "iphone",
    "آيفون": "iphone",
    "أيفون": "iphone",
    "سامسونج": "samsung",
    "شاومي": "xiaomi",
    "ريدمي": "redmi",
    "هونر": "honor",
    "هواوي": "huawei",
    "اوبو": "oppo",
    "أوبو": "oppo",
    "ريلمي": "realme",
    "ماك بوك": "macbook",
    "لاب توب": "laptop",
    "لابتوب": "laptop",
    "برو ماكس": "pro max",
    "الترا": "ultra",
    "جيجا بايت": "gb",
    "جيجابايت": "gb",
    "جيجا": "gb",
    "رامات": "ram",
    "رام": "ram",
}

# Phone edition suffixes.
PHONE_EDITIONS = (r"pro\s+max", "pro", "plus", "ultra", "max", "mini", "air", "lite", "se")

# Words that prove nothing about a product.
EVIDENCE_STOPWORDS = (
    "gb", "ram", "storage", "w", "kg", "eg", "en", "p", "5g", "4g", "lte", "dual", "sim",
    "كجم", "لتر", "بوصة", "وات", "سم", "مل",
)

# A number with its unit.
UNIT_SUFFIX = r"^(\d+(?:\.\d+)?)(?:gb|tb|mb|kg|g|l|ml|w|inch|inches|hz|cm|mm)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def once(value: Column) -> Column:
    """``value`` as the only row of a generator: filters on it stay behind it and do not compute it again for each mention."""
    return F.explode(F.array(value))


def listed(*ranges: str, out: bool = False) -> str:
    """A pattern class that names each of its ASCII characters, or with ``out`` all other ASCII characters.

    The JVM tests a class of named characters by one table; a class of several
    ranges or a negated one is a chain of tests for every character.
    """
    named = {code for r in ranges for code in range(ord(r[0]), ord(r[-1]) + 1)}
    return "[" + "".join(rf"\x{code:02x}" for code in range(128) if (code in named) != out) + "]"


def by_script(c: Column, plain: Callable[[Column], Column], whole: Callable[[Column], Column]) -> Column:
    """``plain`` of an ASCII text, ``whole`` of any other."""
    return let(c, lambda v: F.when(v.rlike(r"[^\x00-\x7F]"), whole(v)).otherwise(plain(v)))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, LOCAL_DIGITS, ASCII_DIGITS)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, evaluated in the JVM for non-ASCII values only.

    Spark has no normalisation function; the ICU library that ships with it is
    reached through the SQL function ``reflect``, so no Python worker is needed.
    """

    def composed(v: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), v, F.lit(True))

    return let(c, lambda v: F.when(v.rlike(r"[^\x00-\x7F]"), composed(v)).otherwise(v))


def squeeze(c: Column) -> Column:
    """Collapse every whitespace run to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized_text(c: Column) -> Column:
    """Matching form: NFKC, ASCII digits, no diacritics, lower case, punctuation to blanks."""

    def whole(v: Column) -> Column:
        text = F.lower(F.regexp_replace(ascii_digits(nfkc(v)), r"[\u064B-\u065F\u0670\u06D6-\u06ED]", ""))
        text = F.regexp_replace(text, r"\u0640", "")
        return squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\u0600-\u06FF.+/-]+", " "))

    # An ASCII text needs none of the letter rules, and its runs of other signs, white space among them, are one blank each.
    signs = listed("a-z", "A-Z", "0-9", *"_.+/-", out=True) + "+"
    plain = lambda v: F.trim(F.regexp_replace(F.lower(v), signs, " "))
    return F.coalesce(by_script(c, plain, whole), F.lit(""))


def code_runs(normalized: Column, between: str) -> Column:
    """The runs of ASCII letters, digits and Arabic signs of a normal form with ``between`` between them."""
    signs = listed("a-z", "0-9", out=True) + "+"
    return by_script(
        normalized, lambda v: F.regexp_replace(v, signs, between), lambda v: F.regexp_replace(v, r"[^a-z0-9\u0600-\u06FF]+", between)
    )


def tokens(normalized: Column) -> Column:
    """Distinct tokens longer than one character of an already normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) > 1))


def compact_key(c: Column) -> Column:
    """Normal form without separators, for codes."""
    return code_runs(normalized_text(c), "")


def search_key(c: Column, aliases: Mapping[str, str] = SEARCH_ALIASES) -> Column:
    """Bilingual search form; aliases are replaced longest first."""
    text = F.regexp_replace(nfkc(ascii_digits(c)), r"[\u064B-\u065F\u0670]", "")
    text = F.lower(F.translate(text, "أإآىة", "ااايه"))
    text = F.regexp_replace(text, r"(?U)(?<=\d)\s*(?:gb|g|جيجا)\b", " gb")
    text = squeeze(F.regexp_replace(text, "[-_/]+", " "))
    for alias in sorted(aliases, key=len, reverse=True):
        text = F.replace(text, F.lit(alias), F.lit(aliases[alias]))
    return squeeze(text)


def trigrams(c: Column) -> Column:
    """Distinct trigrams, word by word, with two blanks before and one after each word."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def clean_text(c: Column, limit: int = 180) -> Column:
    """Control characters and angle brackets to blanks, collapsed, bounded for display."""
    text = squeeze(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x1F\x7F<>]", " "))
    return F.substring(text, 1, limit)


def slug(c: Column) -> Column:
    """URL slug: letters and digits joined by dashes, ``item`` when nothing is left."""
    dashed = F.regexp_replace(F.lower(nfkc(clean_text(c, 120))), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(trimmed == "", "item").otherwise(trimmed)


def _words(c: Column) -> Column:
    return F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def _without_prefix(words: Column, prefix: Column) -> Column:
    """Drop the leading words that repeat ``prefix`` (case-insensitive, whole prefix only)."""
    n = F.size(prefix)
    head = F.transform(F.slice(words, 1, n), F.lower)
    repeats = (n > 0) & (F.size(words) >= n) & (head == F.transform(prefix, F.lower))
    return F.when(repeats, F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))).otherwise(words)


def display_name(brand: Column, model: Column, variant: Column) -> Column:
    """Brand, model and variant as one name without repeated prefixes or adjacent equal words."""
    first = _words(nfkc(brand))
    second = _without_prefix(_words(nfkc(model)), first)
    third = _without_prefix(_without_prefix(_words(nfkc(variant)), first), second)
    return F.aggregate(
        F.concat(first, second, third),
        F.lit(""),
        lambda name, w: F.when(name == "", w)
        .when(F.lower(F.substring_index(name, " ", -1)) == F.lower(w), name)
        .otherwise(F.concat_ws(" ", name, w)),
    )


def family_name(model: Column, product_type: Column) -> Column:
    """Product family: phone models lose their edition words and what follows them."""
    name = F.trim(F.coalesce(model, F.lit("")))
    is_phone = F.lower(product_type).contains("phone") | product_type.contains("هاتف")
    family = F.trim(F.regexp_replace(name, r"(?i)\s+(?:" + "|".join(PHONE_EDITIONS) + r")\b.*$", ""))
    return F.when(is_phone & (family != ""), family).otherwise(name)


def evidence_tokens(c: Column) -> Column:
    """Tokens that prove a product: unit suffix stripped, generic words dropped."""
    text = F.lower(nfkc(F.coalesce(F.try_url_decode(c), c)))
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, UNIT_SUFFIX, "$1"))
    keep = lambda w: (w != "") & ((F.length(w) > 1) | w.rlike(r"^\p{Nd}$")) & ~w.isin(*EVIDENCE_STOPWORDS)
    return F.filter(bare, keep)


def search_document(columns: Mapping[str, Column]) -> Column:
    """One lower-case searchable text per variant from names, ids, specs and aliases."""
    part = columns.get
    pieces = [part(n) for n in ("canonical_name", "brand", "model", "variant_name", "manufacturer_sku", "gtin")]
    pieces += [
        F.concat(columns[n].cast("string"), F.lit(suffix))
        for n, suffix in (("ram_gb", " gb ram"), ("storage_gb", " gb storage"))
        if n in columns
    ]
    if "search_aliases" in columns:
        pieces.append(F.array_join(columns["search_aliases"], " "))
    if "specs" in columns:
        pieces.append(F.to_json(columns["specs"]))
    return F.lower(F.regexp_replace(F.concat_ws(" ", *[p for p in pieces if p is not None]), r"\s+", " "))
