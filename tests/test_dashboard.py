from __future__ import annotations

from datetime import datetime

from offerlake.plans import dashboard


def tables(spark, rows: bool):
    def make(schema, *data):
        return spark.createDataFrame(list(data) if rows else [], schema)

    at = datetime(2024, 5, 1)
    return (
        make("store_id long, active boolean", (1, True), (2, False), (3, None)),
        make("variant_id long, source_status string", (1, "catalog"), (2, "catalog_provisional")),
        make(
            "store_id long, active boolean, direct_product_url string, direct_url_status string",
            (1, True, "", "verified"), (1, True, "u", None), (2, False, "u", "verified"),
        ),
        make("store_id long, variant_id long, observed_at timestamp", (1, 1, at), (1, 2, None)),
        make(
            "run_id long, status string, error_code string",
            (1, "failed", "old"), (2, "success", None), (2, "failed", "timeout"), (2, "failed", "timeout"), (2, "running", None),
        ),
        make(
            "store_id long, status string, brand string, gtin string, sku string",
            (1, "pending_match", "", "9", None), (1, "pending_match", "b", None, ""), (2, "needs_review", None, None, "s"), (3, "matched", "b", "1", "2"),
        ),
    )


def test_dashboard_counts(spark):
    r = dashboard.system_dashboard(*tables(spark, True)).collect()
    assert len(r) == 1
    r = r[0].asDict()
    assert (r["products"], r["registry_stores"], r["active_stores"]) == (1, 3, 1)
    assert (r["connected_stores"], r["active_mappings"], r["mappings_with_direct_url"], r["verified_direct_urls"]) == (1, 2, 1, 1)
    assert (r["visible_cash_offers"], r["visible_priced_stores"], r["visible_priced_products"]) == (2, 1, 2)
    assert (r["discovery_candidates"], r["review_candidates"], r["review_distinct_stores"]) == (4, 3, 2)
    assert (r["pending_match_candidates"], r["pending_match_with_brand"], r["pending_match_without_brand"]) == (2, 1, 1)
    assert (r["needs_review_candidates"], r["review_with_gtin"], r["review_with_sku"]) == (1, 1, 1)
    assert (r["latest_run_id"], r["latest_run_status"], r["latest_run_queued"], r["latest_run_failed"]) == (2, "running", 4, 2)
    assert r["latest_run_error_codes"] == {"timeout": 2} and r["latest_run_task_states"] == {"failed": 2, "running": 1, "success": 1}


def test_dashboard_of_empty_tables(spark):
    (r,) = dashboard.system_dashboard(*tables(spark, False)).collect()
    assert r["products"] == 0 and r["review_candidates"] == 0 and r["latest_run_id"] is None and r["latest_cash_update"] is None
