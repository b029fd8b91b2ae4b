from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerlake.functions import ids, numbers, specs, text, urls
from offerlake.operators import standardize
from offerlake.plans.quality import percent_or_null


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("١٠٤٬٩٩٠ ج.م", 104990.0), ("EGP 18,999", 18999.0), ("1,234.50", 1234.5), ("1.234,5", 1234.5), ("1,5", 1.5),
        ("12.500", 12500.0), ("1 250 000", 1250000.0), ("free", None), ("-5", None), ("0", None), (None, None),
    ],
)
def test_price(spark, raw, expected):
    assert one(spark, raw, numbers.parsed_price) == expected


def test_zero_is_money_but_no_price(spark):
    assert one(spark, "0", numbers.parsed_money) == 0.0


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("متوفر الآن", "available"), ("Out of stock", "out_of_stock"), ("غير متوفر", "out_of_stock"), ("", None),
        ("https://schema.org/InStock", "available"), ("Limited stock available", "limited"), ("call us", "unknown"),
    ],
)
def test_availability(spark, raw, expected):
    assert one(spark, raw, numbers.availability_class) == expected


@pytest.mark.parametrize(
    ("raw", "expected"), [("جنيه", "EGP"), ("$ 20", "USD"), ("20 €", "EUR"), ("ريال سعودي", "SAR"), ("درهم", "AED"), ("", "EGP")]
)
def test_currency(spark, raw, expected):
    assert one(spark, raw, numbers.currency_code) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("ايفون 17 برو ماكس", "iphone 17 pro max"), ("سامسونج S26 الترا", "samsung s26 ultra"),
        ("  iPhone   17 PRO  ", None),
    ],
)
def test_search_key(spark, raw, expected):
    got = one(spark, raw, text.search_key)
    assert got == (expected or "iphone 17 pro") or got.replace("برو", "pro") == (expected or "iphone 17 pro")


def test_search_key_holds_all_parts(spark):
    got = one(spark, "ايفون ١٥ برو ماكس ٢٥٦ جيجا", text.search_key)
    assert all(part in got for part in ("iphone", "15", "pro max", "256", "gb"))


def test_normalized_text(spark):
    assert one(spark, "ﬁne  Ａ① — Çà! «x»", text.normalized_text) == "fine a1 çà x"
    assert one(spark, None, text.normalized_text) == ""


def test_canonical_url(spark):
    assert one(spark, "https://www.example.com/product/phone/?utm_source=x&color=blue&gclid=1", urls.canonical_url) == (
        "https://www.example.com/product/phone?color=blue"
    )
    assert one(spark, "HTTPS://WWW.Example.COM:443//a//b/?b=2&a=1&ref=z", urls.canonical_url) == "https://www.example.com/a/b?a=1&b=2"


def test_import_url(spark):
    assert one(spark, "ftp://example.com/a", urls.import_url) is None


@pytest.mark.parametrize(
    ("ref", "expected"),
    [
        ("/a", "https://s.example/a"), ("b?x=1", "https://s.example/p/b?x=1"), ("//c.example/d", "https://c.example/d"),
        ("../up", "https://s.example/up"), ("./here", "https://s.example/p/here"), ("https://o.example/z/", "https://o.example/z"),
    ],
)
def test_relative_urls(spark, ref, expected):
    assert one(spark, ref, lambda c: urls.normalized_url(c, F.lit("https://s.example/p/q"))) == expected


def test_slug_title(spark):
    assert one(spark, "https://shop.example/p/samsung-galaxy-s26-ultra.html", urls.slug_title) == "samsung galaxy s26 ultra"


@pytest.mark.parametrize(
    ("path", "expected"), [("/products/iphone-17-pro-256gb", True), ("/account/login", False), ("/media/phone.jpg", False)]
)
def test_product_url(spark, path, expected):
    assert one(spark, "https://shop.example" + path, urls.is_product_url) is expected


def test_hosts(spark):
    hosts = F.array(F.lit("www.example.com"))
    assert one(spark, "https://m.example.com/a", lambda c: urls.host_allowed(c, hosts)) is True
    assert one(spark, "https://badexample.com/a", lambda c: urls.host_allowed(c, hosts)) is False


@pytest.mark.parametrize(
    ("title", "ram", "storage"), [("iPhone 17 Pro 256/12", 12.0, 256.0), ("Laptop 1TB 16GB RAM", 16.0, 1024.0), ("plain", None, None)]
)
def test_technical_specs(spark, title, ram, storage):
    got = one(spark, title, lambda c: specs.technical_specs(text.normalized_text(c)))
    assert (got["ram_gb"], got["storage_gb"]) == (ram, storage)


@pytest.mark.parametrize(
    ("moment", "slot"),
    [
        ("2026-07-30 10:01:00", "2026-07-30 07:00:00"), ("2026-07-30 16:59:00", "2026-07-30 07:00:00"),
        ("2026-07-30 17:00:00", "2026-07-30 17:00:00"),
    ],
)
def test_run_slot_follows_summer_time(spark, moment, slot):
    assert str(one(spark, moment, lambda c: standardize.run_slot(c.cast("timestamp_ntz")))) == slot


def test_catalog_slot(spark):
    got = one(spark, "2026-07-30 22:00:00", lambda c: standardize.catalog_slot(c.cast("timestamp_ntz")))
    assert str(got) == "2026-07-29 23:30:00"


@pytest.mark.parametrize(
    ("part", "whole", "expected"), [(0, 0, None), (10, 0, None), (8, 10, 80.0), (15, 10, 100.0), (-1, 10, 0.0)]
)
def test_quality_percent(spark, part, whole, expected):
    df = spark.createDataFrame([(part, whole)], "p int, w int")
    assert df.select(percent_or_null(F.col("p"), F.col("w")).alias("r")).first()["r"] == expected


def test_identity(spark):
    rows = spark.createDataFrame(
        [("6221234567890", "A", "X-1234", 1, "https://a/1"), ("6221234567890", "B", None, 2, "https://b/1"), (None, None, None, 1, "https://a/2")],
        "gtin string, brand string, sku string, store long, url string",
    )
    key = ids.identity_key(F.col("gtin"), F.col("brand"), F.col("sku"), F.col("store"), F.col("url"))
    got = rows.select(key.alias("k"), ids.identity_strength(key).alias("s")).collect()
    assert got[0]["k"] == got[1]["k"] and got[0]["s"] == 100
    assert got[2]["k"] == "store_url:1:https://a/2" and got[2]["s"] == 60


def test_display_name(spark):
    got = one(spark, "Samsung", lambda c: text.display_name(c, F.lit("samsung Galaxy S26"), F.lit("Galaxy S26 256GB 256GB")))
    assert got == "Samsung Galaxy S26 256GB"


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("Washer 7.5 kg, 1200 RPM, Top-Loading", {"الحمولة بالكيلوجرام": "7.5 كجم", "سرعة العصر": "1200 لفة/دقيقة", "نوع التحميل": "تحميل علوي"}),
        ("ثلاجة 310 لتر", {"السعة باللتر": "310 لتر"}),
        ("Screen 50 in Mini-LED full HD", {"مقاس الشاشة": "50 بوصة", "تقنية الشاشة": "MINI-LED", "الدقة": "FULL HD"}),
        ("5 inch ledger, 12 lamps, frontloader, hdmi", {}),
        ("9 kg or 11 kg", {"الحمولة بالكيلوجرام": "9 كجم"}),
        ("", {}),
        (None, {}),
    ],
)
def test_inferred_specs(spark, title, expected):
    assert one(spark, title, specs.inferred_specs) == expected


@pytest.mark.parametrize(
    ("title", "storage", "ram"),
    [
        ("x 8gbram, disk 1.5 tb", [8.0, 1536.0], [8.0]),
        ("رام 6 جيجا 128 جيجابايت", [6.0, 128.0], [6.0]),
        ("program 9 of 3", [], []),
        ("64 gb 64 gb", [64.0], []),
    ],
)
def test_capacities(spark, title, storage, ram):
    assert one(spark, title, lambda c: specs.storage_values(text.normalized_text(c))) == storage
    assert one(spark, title, lambda c: specs.ram_values(text.normalized_text(c))) == ram


def test_spec_list_order(spark):
    raw = "A: 1 | اسم النسخة: first | B: 2 | A: 3 | B: 4 | اسم النسخة: last | no value"
    inferred = F.create_map(F.lit("S"), F.lit("read"), F.lit("A"), F.lit("not this"))
    got = one(spark, raw, lambda c: specs.spec_list(c, ["Z", "A", "S"], inferred))
    assert [tuple(e) for e in got] == [("A", "3"), ("S", "read"), ("B", "2"), ("اسم النسخة", "last")]
    assert one(spark, None, lambda c: specs.spec_list(c, ["A"])) == []
