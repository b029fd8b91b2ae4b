"""Run-ledger analytics and operations reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions.scores import minutes_before, moment
from offerlake.operators.skew import earliest_per
from offerlake.operators.standardize import run_slot

TERMINAL = ("success", "failed")


def group_work(mappings: DataFrame) -> DataFrame:
    """One unit of fetch work per store, URL and all connector settings; settings that ``mappings`` lacks have their defaults.

    Mapping ids of a unit stay rows (``work_key`` on every mapping) and only
    their number is aggregated, so a URL shared by very many mappings is fine.
    """
    setting = lambda name, default: (
        F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in mappings.columns else F.lit(default)
    )
    parts = [
        F.col("store_id").cast("string"), "effective_source_url", setting("effective_url_type", ""), setting("allowed_hosts", "[]"),
        setting("connector_mode", "auto"), setting("connector_version", "generic-v1"), setting("respect_robots", "true"), setting("browser_required", "false"),
        setting("requests_per_minute", "10"), setting("max_concurrency", "1"),
    ]
    keyed = mappings.withColumn("work_key", F.sha1(F.concat_ws("|", *parts)))
    return keyed.groupBy("work_key", "store_id", "effective_source_url").agg(
        F.count(F.lit(1)).alias("mapping_count"), F.min("mapping_id").alias("first_mapping_id")
    )


def run_counters(tasks: DataFrame) -> DataFrame:
    """Counters and status of every run, rebuilt from its tasks."""
    done = F.col("status").isin(*TERMINAL)
    rows = tasks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("queued"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    status = (
        F.when(F.col("completed") < F.col("queued"), "running")
        .when(F.col("succeeded") == 0, "failed")
        .when(F.col("failed") > 0, "completed_with_errors")
        .otherwise("success")
    )
    return rows.withColumn("status", status)


def expire_tasks(tasks: DataFrame, as_of: str | Column, max_minutes: int, code: str = "run_deadline_exceeded") -> DataFrame:
    """Unfinished tasks older than the limit fail; an error that is already known is kept."""
    overdue = ~F.col("status").isin(*TERMINAL) & (F.col("finished_at") < minutes_before(moment(as_of), max_minutes))
    return tasks.withColumns(
        {
            "status": F.when(overdue, "failed").otherwise(F.col("status")),
            "error_code": F.when(overdue, F.coalesce("error_code", F.lit(code))).otherwise(F.col("error_code")),
            "expired": overdue,
        }
    )


def terminal_state(events: DataFrame, keys: Sequence[str] = ("task_id",), order: Sequence[str] = ("finished_at", "event_id")) -> DataFrame:
    """First terminal result of every task; later results are ignored."""
    return earliest_per(events.filter(F.col("status").isin(*TERMINAL)), keys, order)


def supersede_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks of overlapping full runs that the most advanced run makes redundant.

    A task stays when the keeper failed the same store with an internal error.
    The keeper is one row, joined by a constant key.
    """
    active = runs.filter(F.col("status").isin("created", "enqueuing", "queued", "running"))
    keeper = active.agg(F.min_by("run_id", F.struct(-F.coalesce("completed", F.lit(0)), F.col("run_id"))).alias("keeper_id"))
    rows = tasks.join(active.select("run_id"), "run_id", "left_semi").withColumn("_one", F.lit(1)).join(
        F.broadcast(keeper.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")
    internal = rows.filter(
        (F.col("run_id") == F.col("keeper_id")) & (F.col("status") == "failed") & F.col("error_code").startswith("internal_")
    ).select("store_id").distinct()
    open_tasks = rows.filter((F.col("run_id") != F.col("keeper_id")) & ~F.col("status").isin(*TERMINAL))
    dropped = open_tasks.join(internal, "store_id", "left_anti")
    return dropped.withColumns(
        {"status": F.lit("failed"), "error_code": F.coalesce("error_code", F.lit("superseded_duplicate_run"))}
    )


def overdue_deliveries(tasks: DataFrame, as_of: str | Column, minutes: int, max_recoveries: int = 3) -> DataFrame:
    """Queued tasks whose delivery is overdue and may still be tried again, as their next generation."""
    late = (F.col("status") == "running") & (F.col("finished_at") < minutes_before(moment(as_of), minutes))
    again = tasks.filter(late & (F.coalesce("recovery_count", F.lit(0)) < max_recoveries))
    return again.withColumn("recovery_count", F.coalesce("recovery_count", F.lit(0)) + 1)


def slot_stats(events: DataFrame, column: str, value: str) -> DataFrame:
    """Counts and values per local refresh slot."""
    return events.groupBy(run_slot(F.col(column)).alias("slot")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum(value), 2).alias("total"), F.max(value).alias("largest")
    )


def failure_histogram(tasks: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Failure codes of every run with the root cause when there is one only."""
    failed = tasks.filter(F.col("status") == "failed").groupBy(*keys, "error_code").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("error_code").alias("code"))))
    rows = failed.groupBy(*keys).agg(order.alias("_codes"), F.sum("n").alias("failures"))
    summary = F.array_join(F.transform("_codes", lambda c: F.concat(c["code"], F.lit("="), (-c["neg"]).cast("string"))), ", ")
    cause = F.when(F.size("_codes") == 1, F.col("_codes")[0]["code"]).otherwise("all_mappings_failed")
    return rows.select(*keys, "failures", summary.alias("failure_summary"), cause.alias("root_cause"))


def count_map(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """``map<code,count>`` per key; codes are an enumeration, so a map stays small."""
    counts = df.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "_n")))).alias("counts"))


def readiness(listings: DataFrame, offers: DataFrame, min_variants: int = 100, min_stores: int = 25) -> DataFrame:
    """Launch gates: live prices, variants with two stores, store floor and concentration."""
    active = listings.filter("active")
    pairs = active.groupBy("variant_id").agg(F.count_distinct("store_id").alias("stores"))
    variants = pairs.agg(F.count(F.lit(1)).alias("mapped_variants"), F.count_if(F.col("stores") >= 2).alias("comparable_variants"))
    per_store = active.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    share = per_store.agg(
        F.count(F.lit(1)).alias("connected_stores"), F.round(F.max("n") / F.sum("n"), 4).alias("largest_store_share")
    )
    live = offers.agg(F.count_if(F.col("active") & (F.col("cash_price") > 0) & (F.col("extraction_status") == "success")).alias("live_prices"))
    row = variants.withColumn("_one", F.lit(1)).join(share.withColumn("_one", F.lit(1)), "_one").join(live.withColumn("_one", F.lit(1)), "_one")
    ready = (
        (F.col("live_prices") > 0)
        & (F.col("comparable_variants") >= min_variants)
        & (F.col("connected_stores") >= min_stores)
        & (F.col("largest_store_share") < 0.40)
    )
    return row.drop("_one").withColumn("ready", ready)


def capacity(listings: DataFrame, connectors: DataFrame, window_minutes: float = 350.0) -> DataFrame:
    """Distinct URLs of every store and whether its rate fits them into the run window."""
    urls = listings.filter("active").groupBy("store_id").agg(
        F.count(F.lit(1)).alias("mapping_count"), F.count_distinct("source_url").alias("unique_source_urls")
    )
    rate = F.greatest(F.lit(1), F.col("requests_per_minute"))
    rows = urls.join(connectors.select("store_id", "requests_per_minute"), "store_id")
    minutes = F.greatest(F.lit(0.0), (F.col("unique_source_urls") - 1) / rate)
    return rows.withColumns({"planned_minutes": F.round(minutes, 2), "fits_price_run_window": minutes <= window_minutes})


def popularity(events: DataFrame, as_of: str | Column, windows: Sequence[int] = (1, 7, 30, 90, 365)) -> DataFrame:
    """Views, selections and comparisons per subject over several trailing windows.

    Events are counted first by their age in started days before ``as_of``, so
    an event exactly ``n`` days old is in the window of ``n`` days; windows then
    multiply these counts, not events.
    """
    at = moment(as_of)
    is_in = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    started = events.filter(F.col("ts") <= at).withColumn("_age", micros).withColumn("_days", F.expr("(_age + 86399999999) DIV 86400000000"))
    days = started.groupBy("subject_id", "_days").agg(
        is_in("view").alias("views"), is_in("click").alias("selections"), is_in("purchase").alias("comparisons")
    )
    spread = days.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows]))).filter("_days <= window_days")
    return spread.groupBy("subject_id", "window_days").agg(
        F.sum("views").alias("views"), F.sum("selections").alias("selections"), F.sum("comparisons").alias("comparisons")
    )


def stores_needing_attention(
    stores: DataFrame, listings: DataFrame, offers: DataFrame, reviews: DataFrame, limit: int = 12
) -> DataFrame:
    """Active stores by open reviews, then stalest prices; each input is counted per store first."""
    mappings = listings.filter("active").groupBy("store_id").agg(F.count_distinct("mapping_id").alias("mappings"))
    latest = offers.filter("active").groupBy("store_id").agg(F.max("last_success_at").alias("latest_price_update"))
    cases = reviews.filter(F.col("status") == "open").groupBy("store_id").agg(F.count_distinct("report_id").alias("open_reviews"))
    rows = (
        stores.filter("active")
        .select("store_id", "store_name")
        .join(mappings, "store_id", "left")
        .join(latest, "store_id", "left")
        .join(cases, "store_id", "left")
        .fillna(0, ["mappings", "open_reviews"])
    )
    return rows.orderBy(F.desc("open_reviews"), F.col("latest_price_update").asc_nulls_first(), "store_name").limit(limit)


def attach_cases(stores: DataFrame, listings: DataFrame, cases: DataFrame) -> DataFrame:
    """Open cases of a store, filed on the store itself or on one of its listings.

    The OR of the two conditions is two equality joins whose case ids are then counted once.
    """
    opened = cases.filter(F.col("status") == "open")
    direct = opened.filter(F.col("entity_type") == "store").select(F.col("entity_id").alias("store_id"), "review_id")
    mapped = opened.filter(F.col("entity_type") == "store_product_mapping").select(F.col("entity_id").alias("mapping_id"), "review_id")
    by_listing = mapped.join(listings.select("mapping_id", F.col("store_id").cast("string")), "mapping_id").select("store_id", "review_id")
    counted = direct.unionByName(by_listing).groupBy("store_id").agg(F.count_distinct("review_id").alias("open_reviews"))
    keyed = stores.select("store_id", F.col("store_id").cast("string").alias("_s"))
    return keyed.join(counted.withColumnRenamed("store_id", "_s"), "_s", "left").drop("_s").fillna(0, ["open_reviews"])


def review_queue(cases: DataFrame) -> DataFrame:
    """Cases per severity and status, most severe first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return cases.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("count")).withColumn("severity_rank", rank)


def status_snapshot(tasks: DataFrame) -> DataFrame:
    """Latest run, its progress and its error histogram as one row."""
    latest = tasks.agg(F.max("run_id").alias("run_id"))
    rows = tasks.join(latest, "run_id")
    counters = run_counters(rows)
    return counters.join(failure_histogram(rows), "run_id", "left")


def evaluate_alerts(rules: DataFrame, offers: DataFrame, history: DataFrame) -> DataFrame:
    """Alert rules that hold now: amount, 90-day low, stock, coupon and cost rules.

    ``offers`` holds the best visible offer of a variant: final_cost, availability, coupon_code,
    interest_free and previous_cost.
    """
    rows = rules.join(offers, "variant_id").join(history.select("variant_id", "lowest_90d"), "variant_id", "left")
    kind, cost = F.col("rule_type"), F.col("final_cost").cast("double")
    fired = (
        F.when(kind == "below_amount", cost <= F.col("threshold_amount"))
        .when(kind == "at_90_day_low", cost <= F.col("lowest_90d"))
        .when(kind == "interest_free_installment", F.col("interest_free"))
        .when(kind.isin("store_available", "back_in_stock"), F.col("availability").isin("available", "in_stock", "limited"))
        .when(kind == "coupon_available", F.col("coupon_code").isNotNull())
        .when(kind == "final_cost_drop", cost < F.col("previous_cost"))
        .when(kind == "weekly_wishlist_digest", F.lit(True))
    )
    return rows.filter(F.coalesce(fired, F.lit(False)))


def open_cases(reports: DataFrame, existing: DataFrame) -> DataFrame:
    """New review cases from reports: one per (entity, issue), unless one is already open."""
    fresh = earliest_per(reports, ["entity_id", "issue_code"], ["report_id"])
    already = existing.filter(F.col("status") == "open").select("entity_id", "issue_code")
    return fresh.join(already, ["entity_id", "issue_code"], "left_anti")


def operational_listings(listings: DataFrame, connectors: DataFrame, types: Sequence[str] = ("product",)) -> DataFrame:
    """Listings that may run: active, with an enabled connector and an accepted URL type."""
    enabled = connectors.filter("enabled").select("store_id")
    return listings.filter(F.col("active") & F.col("url_type").isin(*types)).join(enabled, "store_id", "left_semi")


def catalog_stats(variants: DataFrame, listings: DataFrame) -> DataFrame:
    """Mapped store count of every variant."""
    stores = listings.filter("active").groupBy("variant_id").agg(F.count_distinct("store_id").alias("mapped_stores"))
    return variants.select("variant_id", "section", "brand").join(stores, "variant_id", "left").fillna(0, ["mapped_stores"])


def build_dimensions(rows: DataFrame) -> dict[str, DataFrame]:
    """Category, brand, product, attribute and identifier dimensions with stable ids."""
    from offerlake.functions.ids import stable_id

    brand_id, category_id = stable_id("BR", F.col("brand")), stable_id("CAT", F.col("section"))
    product_id = stable_id("PR", F.col("brand"), F.col("model"), F.col("section"))
    attributes = rows.select(
        "variant_id",
        F.explode(
            F.map_from_arrays(
                F.array(F.lit("storage_gb"), F.lit("ram_gb"), F.lit("color")),
                F.array(F.col("storage_gb").cast("string"), F.col("ram_gb").cast("string"), F.col("color")),
            )
        ).alias("attribute", "value"),
    ).filter(F.col("value").isNotNull())
    identifiers = rows.select(
        "variant_id",
        F.explode(
            F.map_from_arrays(F.array(F.lit("gtin"), F.lit("manufacturer_sku")), F.array("gtin", "manufacturer_sku"))
        ).alias("kind", "value"),
    ).filter(F.col("value").isNotNull())
    return {
        "categories": rows.select(category_id.alias("category_id"), F.col("section").alias("name")).distinct(),
        "brands": rows.select(brand_id.alias("brand_id"), F.col("brand").alias("name")).distinct(),
        "products": rows.select(
            product_id.alias("product_id"), brand_id.alias("brand_id"), category_id.alias("category_id"), "model"
        ).distinct(),
        "attributes": attributes,
        "identifiers": identifiers,
    }


def build_catalog(products: DataFrame, mapping: DataFrame, cash: DataFrame, instalment: DataFrame, sources: DataFrame) -> DataFrame:
    """Presence rows from workbook sheets: product mappings joined with prices and plans on (variant, source)."""
    keys = ["variant_id", "source_id"]
    plans = instalment.groupBy(*keys).agg(F.count(F.lit(1)).alias("plan_count"))
    return (
        mapping.join(products, "variant_id")
        .join(sources, "source_id", "left")
        .join(cash, keys, "left")
        .join(plans, keys, "left")
        .fillna(0, ["plan_count"])
    )
