"""Category trees of any depth, defaults of dimensions, point reads of comparison documents, resets of candidates."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from offerlake.operators import matching
from offerlake.plans import browse, dimensions
from offerlake.session import checkpoint_folder


def test_closure_of_a_deep_tree(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("z", None), ("lost", "nowhere")], "category_id string, parent_id string")
    pairs = {(r.ancestor_id, r.category_id, r.distance) for r in dimensions.closure(tree).collect()}
    assert {("a", "d", 3), ("b", "d", 2), ("b", "e", 1), ("z", "z", 0), ("nowhere", "lost", 1)} <= pairs
    assert len([p for p in pairs if p[1] == "d"]) == 4 and not any(p[0] == "z" and p[1] != "z" for p in pairs)
    assert dimensions.closure(tree.limit(0)).count() == 0


def test_defaults_and_families(spark):
    rows = spark.createDataFrame(
        [
            (1, "Kettle One", None, None, None, None, None, 1.5, None, None),
            (2, "x", " Home ", "Home", "Acme", "K-2", " Red ", None, 8.0, "catalog"),
            (3, "x", "home", "Smart Phone", "ACME", "Nova 9 Ultra Max", "", None, None, ""),
        ],
        "variant_id int, canonical_name string, section string, product_type string, brand string, model string, color string, ram_gb double, storage_gb double, source_status string",
    )
    out = dimensions.described(rows)
    got = {r.variant_id: r for r in out.collect()}
    assert got[1].section == got[1].product_type == dimensions.UNCLASSIFIED and got[1].brand == dimensions.UNKNOWN_BRAND and got[1].model == "Kettle One"
    assert got[3].family == "Nova 9" and got[2].brand_id == got[3].brand_id and got[2].root_id == got[3].root_id
    tree = {r.name: r for r in dimensions.categories(out).collect() if r.source_key.startswith("type:")}
    assert tree["Home"].level == 1 and tree["Home"].parent_id is None and tree["Smart Phone"].parent_id == got[3].root_id and tree["Smart Phone"].level == 2
    assert [r.name for r in dimensions.brands(out).filter("normalized_name = 'acme'").collect()] == ["ACME"]
    assert {(r.variant_id, r.code, r.normalized_text, r.value_number) for r in dimensions.attribute_values(out).collect()} == {(1, "ram_gb", None, 1.5), (2, "storage_gb", None, 8.0), (2, "color", "red", None)}
    assert {r.source_status for r in dimensions.products(out).collect()} == {"mapped", "catalog"}
    assert dimensions.products(out.limit(0)).count() == 0


def test_one_product_is_read_from_one_bucket(spark):
    offers = spark.range(4000).select(
        (F.col("id") % 50).alias("variant_id"), (F.col("id") / 50).cast("int").alias("offer_rank"), F.col("id").alias("offer_id"), F.lit("s").alias("store_name"),
        F.lit(10.0).alias("cash_price"), F.lit(11.0).alias("comparable_total"), F.lit("fresh").alias("computed_freshness"), F.lit("available").alias("availability"), F.lit(True).alias("eligible_for_ranking"),
    )
    plans = offers.filter("offer_rank < 30").select(
        "variant_id", F.col("offer_rank").alias("plan_rank"), F.col("offer_id").alias("plan_id"), "store_name", F.lit("p").alias("provider_name"), F.lit(5).alias("periodic_payment"),
        F.lit(60).alias("normalized_total"), F.lit(12).alias("months"), "computed_freshness", "eligible_for_ranking",
    )
    name = f"entries_{uuid.uuid4().hex}"
    table = browse.write_comparisons(browse.comparison_entries(offers, plans), name, f"{checkpoint_folder(spark)}/{name}", 8)
    one = browse.comparison_of(table, 7)
    rows = one.collect()
    assert [(r.kind, r.rank) for r in rows] == [("offer", n) for n in range(80)] + [("plan", n) for n in range(30)]
    # the plan tells the pruned buckets only of a scan that keeps its bucketing
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    shown = browse.comparison_of(spark.table(name), 7)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"SelectedBucketsCount: 1 out of 8", shown)
    spark.sql(f"DROP TABLE {name}")


def test_changed_candidates_lose_their_decision(spark):
    shape = "candidate_id string, normalized_url string, title string, brand string, sku string, gtin string, currency string, observed_price double, availability string, last_seen_at timestamp"
    day = lambda n: datetime(2024, 1, n)
    row = lambda i, title, price, n: (i, "u", title, None, None, None, "EGP", price, "available", day(n))
    stored = spark.createDataFrame([row("same", "t", 5.0, 1), row("new price", "t", 5.0, 1), row("unseen", None, None, 1), row("null to value", None, 5.0, 1)], shape)
    stored = stored.withColumns({"match_version": F.lit(3), "checked_at": F.lit(day(1))})
    seen = spark.createDataFrame([row("same", "t", 5.0, 2), row("new price", "t", 6.0, 2), row("new price", "t", 5.0, 1), row("null to value", "t", 5.0, 2), row("first", "t", 1.0, 2)], shape)
    got = {r.candidate_id: (r.match_version, r.checked_at is None, r.observed_price, r.last_seen_at.day) for r in matching.merge_candidates(stored, seen).collect()}
    assert got == {"same": (3, False, 5.0, 2), "new price": (0, True, 6.0, 2), "unseen": (3, False, None, 1), "null to value": (0, True, 5.0, 2), "first": (0, True, 1.0, 2)}
    assert {r.candidate_id for r in matching.due_for_reconcile(matching.merge_candidates(stored, seen), 3).collect()} == {"new price", "null to value", "first"}
