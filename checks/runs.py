"""Run-ledger, operations and alert checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from offerlake.plans import dashboard, history, runs, views
from offerlake.sources.fixtures import AS_OF, DriverTables

STREAM_NOON = "2024-01-20 12:00:00"


@check(
    "work_groups",
    """
    WITH e AS (SELECT mapping_id, store_id, CASE WHEN direct_url_status = 'verified' AND NULLIF(direct_product_url, '') IS NOT NULL
        THEN direct_product_url ELSE source_url END AS u FROM fx_listings WHERE active)
    SELECT store_id, u AS effective_source_url, count(*) AS mapping_count, min(mapping_id) AS first_mapping_id FROM e GROUP BY 1, 2
    """,
)
def work_groups(t: DriverTables) -> DataFrame:
    rows = views.effective_urls(t.fx_listings.filter("active")).join(t.fx_stores.select("store_id", "requests_per_minute"), "store_id")
    return runs.group_work(rows.withColumn("effective_url_type", F.lit("product"))).drop("work_key")


@check(
    "run_counters",
    """
    WITH c AS (SELECT run_id, count(*) AS queued, count(*) FILTER (status IN ('success', 'failed')) AS completed,
      count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM fx_tasks GROUP BY 1)
    SELECT *, CASE WHEN completed < queued THEN 'running' WHEN succeeded = 0 THEN 'failed' WHEN failed > 0 THEN 'completed_with_errors' ELSE 'success' END AS status FROM c
    """,
)
def run_counters(t: DriverTables) -> DataFrame:
    return runs.run_counters(t.fx_tasks)


@check(
    "expired_tasks",
    """
    WITH e AS (SELECT *, status = 'running' AND finished_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 355 MINUTE AS x FROM fx_tasks)
    SELECT task_id, CASE WHEN x THEN 'failed' ELSE status END AS status, CASE WHEN x THEN COALESCE(error_code, 'run_deadline_exceeded') ELSE error_code END AS error_code, x AS expired FROM e
    """,
)
def expired_tasks(t: DriverTables) -> DataFrame:
    return runs.expire_tasks(t.fx_tasks, STREAM_NOON, 355).select("task_id", "status", "error_code", "expired")


@check(
    "terminal_states",
    """
    SELECT DISTINCT ON (task_id) task_id, event_id, status, error_code FROM (SELECT store_id * 100 + run_id AS task_id, task_id AS event_id, status, error_code, finished_at FROM fx_tasks)
    WHERE status <> 'running' ORDER BY task_id, finished_at, event_id
    """,
)
def terminal_states(t: DriverTables) -> DataFrame:
    events = t.fx_tasks.withColumnRenamed("task_id", "event_id").withColumn("task_id", F.col("store_id") * 100 + F.col("run_id"))
    return runs.terminal_state(events).select("task_id", "event_id", "status", "error_code")


@check(
    "superseded_tasks",
    """
    WITH r AS (SELECT run_id, count(*) FILTER (status <> 'running') AS completed FROM fx_tasks GROUP BY 1),
    k AS (SELECT run_id FROM r ORDER BY completed DESC, run_id LIMIT 1),
    bad AS (SELECT DISTINCT store_id FROM fx_tasks WHERE run_id = (SELECT run_id FROM k) AND error_code = 'timeout')
    SELECT task_id, run_id, 'superseded_duplicate_run' AS error_code FROM fx_tasks WHERE run_id <> (SELECT run_id FROM k) AND status = 'running'
      AND store_id NOT IN (SELECT store_id FROM bad)
    """,
)
def superseded_tasks(t: DriverTables) -> DataFrame:
    tasks = t.fx_tasks.withColumn("error_code", F.when(F.col("error_code") == "timeout", "internal_timeout").otherwise(F.col("error_code")))
    active = runs.run_counters(tasks).select("run_id", "completed", F.lit("running").alias("status"))
    return runs.supersede_runs(active, tasks).select("task_id", "run_id", "error_code")


@check(
    "overdue_deliveries",
    """
    SELECT task_id, task_id % 5 + 1 AS recovery_count FROM fx_tasks
    WHERE status = 'running' AND finished_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 60 MINUTE AND task_id % 5 < 3
    """,
)
def overdue_deliveries(t: DriverTables) -> DataFrame:
    tasks = t.fx_tasks.withColumn("recovery_count", F.col("task_id") % 5)
    return runs.overdue_deliveries(tasks, STREAM_NOON, 60).select("task_id", "recovery_count")


@check(
    "slot_statistics",
    """
    WITH l AS (SELECT *, ts + INTERVAL 2 HOUR AS l, date_trunc('day', ts + INTERVAL 2 HOUR) AS m FROM events)
    SELECT strftime((CASE WHEN hour(l) >= 20 THEN m + INTERVAL 20 HOUR WHEN hour(l) >= 10 THEN m + INTERVAL 10 HOUR ELSE m - INTERVAL 4 HOUR END) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS slot,
      count(*) AS events, round(sum(value), 2) AS total, max(value) AS largest FROM l GROUP BY 1
    """,
)
def slot_statistics(t: DriverTables) -> DataFrame:
    return runs.slot_stats(t.events, "ts", "value")


@check(
    "failure_histogram",
    """
    WITH c AS (SELECT run_id, error_code, count(*) AS n FROM fx_tasks WHERE status = 'failed' GROUP BY 1, 2)
    SELECT run_id, CAST(sum(n) AS BIGINT) AS failures, string_agg(concat(error_code, '=', n), ', ' ORDER BY n DESC, error_code) AS failure_summary,
      CASE WHEN count(*) = 1 THEN min(error_code) ELSE 'all_mappings_failed' END AS root_cause FROM c GROUP BY 1
    """,
)
def failure_histogram(t: DriverTables) -> DataFrame:
    return runs.failure_histogram(t.fx_tasks)


@check(
    "error_count_maps",
    """
    WITH c AS (SELECT store_id, error_code, count(*) AS n FROM fx_tasks WHERE status = 'failed' GROUP BY 1, 2)
    SELECT store_id, string_agg(concat(error_code, ':', n), ',' ORDER BY error_code) AS counts FROM c GROUP BY 1
    """,
)
def error_count_maps(t: DriverTables) -> DataFrame:
    rows = runs.count_map(t.fx_tasks.filter("status = 'failed'"), ["store_id"], "error_code")
    entries = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return rows.select("store_id", F.array_join(entries, ",").alias("counts"))


@check(
    "launch_readiness",
    """
    WITH a AS (SELECT * FROM fx_listings WHERE active), p AS (SELECT variant_id, count(DISTINCT store_id) AS n FROM a GROUP BY 1),
    s AS (SELECT store_id, count(*) AS n FROM a GROUP BY 1)
    SELECT (SELECT count(*) FROM p) AS mapped_variants, (SELECT count(*) FROM p WHERE n >= 2) AS comparable_variants, (SELECT count(*) FROM s) AS connected_stores,
      (SELECT round(max(n) / sum(n), 4) FROM s) AS largest_store_share, (SELECT count(*) FROM fx_offers WHERE active AND extraction_status = 'success') AS live_prices, true AS ready
    """,
)
def launch_readiness(t: DriverTables) -> DataFrame:
    return runs.readiness(t.fx_listings, t.fx_offers)


@check(
    "store_capacity",
    """
    SELECT l.store_id, count(*) AS mapping_count, count(DISTINCT source_url) AS unique_source_urls, any_value(requests_per_minute) AS requests_per_minute,
      round((count(DISTINCT source_url) - 1) / any_value(requests_per_minute), 2) AS planned_minutes,
      (count(DISTINCT source_url) - 1) / any_value(requests_per_minute) <= 60 AS fits_price_run_window
    FROM fx_listings l JOIN fx_stores s USING (store_id) WHERE l.active GROUP BY 1
    """,
)
def store_capacity(t: DriverTables) -> DataFrame:
    return runs.capacity(t.fx_listings, t.fx_stores, 60)


@check(
    "popularity_windows",
    """
    WITH e AS (SELECT user_id AS subject_id, event_type, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) AS age FROM events
               WHERE ts <= TIMESTAMP '2024-01-31 00:00:00'),
    w AS (SELECT unnest([1, 7, 30, 90, 365]) AS window_days)
    SELECT subject_id, window_days, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS selections,
      count(*) FILTER (event_type = 'purchase') AS comparisons FROM e JOIN w ON age <= window_days * 86400000000 GROUP BY 1, 2
    """,
)
def popularity_windows(t: DriverTables) -> DataFrame:
    return runs.popularity(t.events.withColumnRenamed("user_id", "subject_id"), "2024-01-31 00:00:00")


@check(
    "stores_needing_attention",
    """
    WITH m AS (SELECT store_id, count(DISTINCT mapping_id) AS mappings FROM fx_listings WHERE active GROUP BY 1),
    o AS (SELECT store_id, max(last_success_at) AS t FROM fx_offers WHERE active GROUP BY 1),
    r AS (SELECT store_id, count(DISTINCT report_id) AS n FROM fx_reports WHERE status = 'open' GROUP BY 1)
    SELECT store_id, store_name, COALESCE(mappings, 0) AS mappings, strftime(t, '%Y-%m-%d %H:%M:%S') AS latest_price_update, COALESCE(n, 0) AS open_reviews
    FROM fx_stores s LEFT JOIN m USING (store_id) LEFT JOIN o USING (store_id) LEFT JOIN r USING (store_id) WHERE s.active
    ORDER BY COALESCE(n, 0) DESC, t NULLS FIRST, store_name LIMIT 12
    """,
)
def stores_needing_attention(t: DriverTables) -> DataFrame:
    return runs.stores_needing_attention(t.fx_stores, t.fx_listings, t.fx_offers, t.fx_reports)


@check(
    "attached_cases",
    """
    WITH c AS (SELECT report_id, CASE WHEN report_id % 2 = 0 THEN store_id END AS s, offer_id FROM fx_reports WHERE status = 'open'),
    m AS (SELECT report_id, s AS store_id FROM c WHERE s IS NOT NULL UNION SELECT report_id, l.store_id FROM c JOIN fx_listings l ON l.variant_id = c.offer_id WHERE s IS NULL)
    SELECT store_id, COALESCE(n, 0) AS open_reviews FROM fx_stores LEFT JOIN (SELECT store_id, count(DISTINCT report_id) AS n FROM m GROUP BY 1) USING (store_id)
    """,
)
def attached_cases(t: DriverTables) -> DataFrame:
    on_store = F.col("report_id") % 2 == 0
    listing_ids = t.fx_listings.select(F.col("variant_id").alias("offer_id"), "mapping_id")
    direct = t.fx_reports.filter(on_store).select(F.col("report_id").alias("review_id"), "status", F.lit("store").alias("entity_type"), F.col("store_id").cast("string").alias("entity_id"))
    mapped = t.fx_reports.filter(~on_store).join(listing_ids, "offer_id").select(F.col("report_id").alias("review_id"), "status", F.lit("store_product_mapping").alias("entity_type"), F.col("mapping_id").alias("entity_id"))
    return runs.attach_cases(t.fx_stores, t.fx_listings, direct.unionByName(mapped))


@check(
    "review_queue",
    "SELECT severity, status, count(*) AS count, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 3 END AS severity_rank FROM fx_reports GROUP BY 1, 2",
)
def review_queue(t: DriverTables) -> DataFrame:
    return runs.review_queue(t.fx_reports)


@check(
    "status_snapshot",
    """
    WITH l AS (SELECT * FROM fx_tasks WHERE run_id = (SELECT max(run_id) FROM fx_tasks)),
    c AS (SELECT error_code, count(*) AS n FROM l WHERE status = 'failed' GROUP BY 1),
    f AS (SELECT CAST(sum(n) AS BIGINT) AS failures, string_agg(concat(error_code, '=', n), ', ' ORDER BY n DESC, error_code) AS failure_summary,
      CASE count(*) WHEN 0 THEN NULL WHEN 1 THEN min(error_code) ELSE 'all_mappings_failed' END AS root_cause FROM c)
    SELECT any_value(run_id) AS run_id, count(*) AS queued, count(*) FILTER (status <> 'running') AS completed, count(*) FILTER (status = 'success') AS succeeded,
      count(*) FILTER (status = 'failed') AS failed, 'running' AS status, any_value(failures) AS failures, any_value(failure_summary) AS failure_summary,
      any_value(root_cause) AS root_cause FROM l, f
    """,
)
def status_snapshot(t: DriverTables) -> DataFrame:
    return runs.status_snapshot(t.fx_tasks)


BACKLOG = """CASE WHEN item_id % 5 = 0 THEN 'needs_review' WHEN item_id % 5 < 3 THEN 'pending_match' ELSE 'matched' END"""


@check(
    "system_dashboard",
    f"""
    WITH b AS (SELECT *, {BACKLOG} AS status FROM fx_items),
    l AS (SELECT * FROM fx_tasks WHERE run_id = (SELECT max(run_id) FROM fx_tasks)),
    e AS (SELECT error_code, count(*) AS n FROM l WHERE error_code IS NOT NULL GROUP BY 1), s AS (SELECT status, count(*) AS n FROM l GROUP BY 1)
    SELECT (SELECT count(*) FROM fx_variants WHERE source_status <> 'catalog_provisional') AS products,
      (SELECT count(*) FROM fx_stores) AS registry_stores, (SELECT count(*) FROM fx_stores WHERE active) AS active_stores,
      (SELECT count(DISTINCT store_id) FROM fx_listings WHERE active) AS connected_stores, (SELECT count(*) FROM fx_listings WHERE active) AS active_mappings,
      (SELECT count(*) FROM fx_listings WHERE active AND direct_product_url <> '') AS mappings_with_direct_url,
      (SELECT count(*) FROM fx_listings WHERE active AND direct_url_status = 'verified') AS verified_direct_urls,
      (SELECT count(*) FROM fx_offers) AS visible_cash_offers, (SELECT count(DISTINCT store_id) FROM fx_offers) AS visible_priced_stores,
      (SELECT count(DISTINCT variant_id) FROM fx_offers) AS visible_priced_products,
      (SELECT strftime(max(observed_at), '%Y-%m-%d') FROM fx_offers) AS latest_cash_update,
      (SELECT count(*) FROM b) AS discovery_candidates, (SELECT count(*) FROM b WHERE status <> 'matched') AS review_candidates,
      (SELECT count(*) FROM b WHERE status = 'pending_match') AS pending_match_candidates, (SELECT count(*) FROM b WHERE status = 'needs_review') AS needs_review_candidates,
      (SELECT count(*) FROM b WHERE status = 'pending_match' AND brand IS NOT NULL) AS pending_match_with_brand,
      (SELECT count(*) FROM b WHERE status = 'pending_match' AND brand IS NULL) AS pending_match_without_brand,
      (SELECT count(gtin) FROM b WHERE status <> 'matched') AS review_with_gtin, (SELECT count(sku) FROM b WHERE status <> 'matched') AS review_with_sku,
      (SELECT count(DISTINCT store_id) FROM b WHERE status <> 'matched') AS review_distinct_stores,
      (SELECT max(run_id) FROM l) AS latest_run_id, 'running' AS latest_run_status, (SELECT count(*) FROM l) AS latest_run_queued,
      (SELECT count(*) FROM l WHERE status <> 'running') AS latest_run_completed, (SELECT count(*) FROM l WHERE status = 'success') AS latest_run_succeeded,
      (SELECT count(*) FROM l WHERE status = 'failed') AS latest_run_failed,
      (SELECT string_agg(concat(status, '=', n), ',' ORDER BY status) FROM s) AS latest_run_task_states,
      (SELECT COALESCE(string_agg(concat(error_code, '=', n), ',' ORDER BY error_code), '') FROM e) AS latest_run_error_codes
    """,
)
def system_dashboard(t: DriverTables) -> DataFrame:
    backlog = t.fx_items.withColumn("status", F.expr(BACKLOG))
    row = dashboard.system_dashboard(t.fx_stores, t.fx_variants, t.fx_listings, t.fx_offers, t.fx_tasks, backlog)
    shown = lambda name: F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    maps = {c: shown(c) for c in ("latest_run_task_states", "latest_run_error_codes")}
    return row.withColumns({**maps, "latest_cash_update": F.date_format("latest_cash_update", "yyyy-MM-dd")})


ALERT = """CASE c_custkey % 8 WHEN 0 THEN 'below_amount' WHEN 1 THEN 'at_90_day_low' WHEN 2 THEN 'back_in_stock' WHEN 3 THEN 'coupon_available'
    WHEN 4 THEN 'final_cost_drop' WHEN 5 THEN 'interest_free_installment' WHEN 6 THEN 'store_available' ELSE 'weekly_wishlist_digest' END"""


@check(
    "fired_alerts",
    f"""
    WITH best AS (SELECT variant_id, arg_min(availability, (cash_price, offer_id)) AS availability, arg_min(coupon_code, (cash_price, offer_id)) AS a,
        arg_min(struct_pack(c := coupon_code), (cash_price, offer_id)).c AS coupon_code, CAST(min(cash_price) AS DOUBLE) AS cost,
        CAST(arg_min(struct_pack(c := old_price), (cash_price, offer_id)).c AS DOUBLE) AS prev FROM fx_offers GROUP BY 1),
    h AS (SELECT variant_id, COALESCE(min(p) FILTER (observed_at >= {{as_of}} - INTERVAL 90 DAY), min(p)) AS low FROM
        (SELECT variant_id, observed_at, CAST(cash_price + COALESCE(shipping_cost, 0) AS DOUBLE) AS p FROM fx_observations WHERE observed_at <= {{as_of}}) GROUP BY 1),
    f AS (SELECT variant_id, bool_or(interest_free) AS interest_free FROM fx_plans GROUP BY 1),
    r AS (SELECT c_custkey AS alert_id, c_custkey % 200 AS variant_id, {ALERT} AS rule_type, c_acctbal * 2 AS threshold_amount FROM customer)
    SELECT alert_id, variant_id, rule_type FROM r JOIN best USING (variant_id) LEFT JOIN h USING (variant_id) LEFT JOIN f USING (variant_id)
    WHERE CASE rule_type WHEN 'below_amount' THEN cost <= threshold_amount WHEN 'at_90_day_low' THEN cost <= low WHEN 'back_in_stock' THEN availability IN ('available', 'limited')
      WHEN 'store_available' THEN availability IN ('available', 'limited') WHEN 'interest_free_installment' THEN interest_free WHEN 'weekly_wishlist_digest' THEN true
      WHEN 'coupon_available' THEN coupon_code IS NOT NULL ELSE cost < prev END
    """,
)
def fired_alerts(t: DriverTables) -> DataFrame:
    rules = t.customer.select(
        F.col("c_custkey").alias("alert_id"), (F.col("c_custkey") % 200).alias("variant_id"), F.expr(ALERT).alias("rule_type"), (F.col("c_acctbal") * 2).alias("threshold_amount")
    )
    best = F.min_by(F.struct("availability", "coupon_code", "cash_price", "old_price"), F.struct("cash_price", "offer_id")).alias("b")
    offers = t.fx_offers.groupBy("variant_id").agg(best).select(
        "variant_id", "b.availability", "b.coupon_code", F.col("b.cash_price").alias("final_cost"), F.col("b.old_price").cast("double").alias("previous_cost")
    )
    free = t.fx_plans.groupBy("variant_id").agg(F.bool_or("interest_free").alias("interest_free"))
    past = history.price_history(t.fx_observations, AS_OF)
    return runs.evaluate_alerts(rules, offers.join(free, "variant_id", "left"), past).select("alert_id", "variant_id", "rule_type")


@check(
    "opened_cases",
    """
    WITH o AS (SELECT DISTINCT offer_id, report_type FROM fx_reports WHERE status = 'open' AND created_at < TIMESTAMP '1998-01-01')
    SELECT min(report_id) AS report_id, offer_id AS entity_id, report_type AS issue_code FROM fx_reports r WHERE created_at >= TIMESTAMP '1998-01-01'
      AND NOT EXISTS (SELECT 1 FROM o WHERE o.offer_id = r.offer_id AND o.report_type = r.report_type) GROUP BY 2, 3
    """,
)
def opened_cases(t: DriverTables) -> DataFrame:
    border = F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t.fx_reports.select("report_id", F.col("offer_id").alias("entity_id"), F.col("report_type").alias("issue_code"), "status", "created_at")
    return runs.open_cases(rows.filter(F.col("created_at") >= border), rows.filter(F.col("created_at") < border)).select("report_id", "entity_id", "issue_code")


@check(
    "operational_listings",
    "SELECT mapping_id FROM fx_listings l JOIN fx_stores s ON s.store_id = l.store_id AND s.enabled WHERE l.active AND url_type = 'product'",
)
def operational_listings(t: DriverTables) -> DataFrame:
    return runs.operational_listings(t.fx_listings, t.fx_stores).select("mapping_id")


@check(
    "catalog_statistics",
    """
    SELECT v.variant_id, v.section, v.brand, COALESCE(n, 0) AS mapped_stores FROM fx_variants v
      LEFT JOIN (SELECT variant_id, count(DISTINCT store_id) AS n FROM fx_listings WHERE active GROUP BY 1) USING (variant_id)
    """,
)
def catalog_statistics(t: DriverTables) -> DataFrame:
    return runs.catalog_stats(t.fx_variants, t.fx_listings)
