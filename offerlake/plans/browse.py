"""Facets, directories, pagination and product groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.config import PRICING, SKEW, SkewRules
from offerlake.functions import text
from offerlake.operators.skew import earliest_per, top_per, with_row_numbers

FRESHNESS_RANK = ("fresh", "late", "stale")
AVAILABILITY_RANK = ("available", "limited", "preorder", "unknown")


def position_in(c: Column, names: Sequence[str]) -> Column:
    """Index of a value in a fixed order; anything else comes last."""
    spot = F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return F.when(F.coalesce(spot, F.lit(0)) > 0, spot - 1).otherwise(len(names)).cast("int")


def published(variants: DataFrame) -> DataFrame:
    return variants.filter(F.coalesce("source_status", F.lit("")) != "catalog_provisional")


def facets(variants: DataFrame, level: str, parents: dict[str, str] | None = None) -> DataFrame:
    """Values of one facet with their variant counts, under the chosen parents."""
    rows = published(variants).filter(F.coalesce(F.col(level), F.lit("")) != "")
    for column, value in (parents or {}).items():
        rows = rows.filter(F.col(column) == value)
    return rows.groupBy(level).agg(F.count(F.lit(1)).alias("variant_count"))


def brand_summary(products: DataFrame) -> DataFrame:
    return products.groupBy("brand").agg(
        F.count(F.lit(1)).alias("variants"), F.count_distinct("model").alias("models")
    )


def spec_dimensions(specs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct specification names with their display position (``specs`` is a map column)."""
    names = specs.select(F.explode(F.map_keys("specs")).alias("name")).distinct()
    return names.withColumn("position", position_in(F.col("name"), order))


def rank_offers(offers: DataFrame, skew: SkewRules = SKEW) -> DataFrame:
    """Comparison order per variant: eligible, cheapest delivered, freshest, most available, by store name."""
    cost = F.coalesce("comparable_total", "cash_price").cast("double")
    first = (~F.col("eligible_for_ranking")).cast("int")
    order = [
        first,
        cost.asc_nulls_last(),
        F.col("cash_price").asc_nulls_last(),
        position_in(F.col("computed_freshness"), FRESHNESS_RANK),
        position_in(F.col("availability"), AVAILABILITY_RANK),
        "store_name",
        "offer_id",
    ]
    lead = first.cast("double") * 1e12 + F.coalesce(cost, F.lit(9e11))
    return with_row_numbers(offers, ["variant_id"], {"offer_rank": (order, lead)}, skew)


def rank_visible_plans(plans: DataFrame, skew: SkewRules = SKEW) -> DataFrame:
    """Comparison order of instalment plans per variant."""
    first = (~F.col("eligible_for_ranking")).cast("int") * 10 + position_in(F.col("computed_freshness"), FRESHNESS_RANK)
    order = [
        first,
        "starting_from_only",
        F.col("normalized_total").asc_nulls_last(),
        F.col("periodic_payment").asc_nulls_last(),
        F.col("months").asc_nulls_last(),
        "store_name",
        "plan_id",
    ]
    return with_row_numbers(plans, ["variant_id"], {"plan_rank": (order, first.cast("double"))}, skew)


def top_k(df: DataFrame, order: Sequence[Column | str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows overall (TakeOrdered) or per group (limited before the shuffle)."""
    return top_per(df, by, order, k) if by else df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page with ``total`` and ``has_more``; only ``offset + limit`` rows are ever sorted together."""
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    rows = df.orderBy(*order).limit(offset + limit).offset(offset).withColumn("_one", F.lit(1))
    joined = rows.join(F.broadcast(total), "_one").drop("_one")
    return joined.withColumn("has_more", F.col("total") > offset + limit)


def next_batch(df: DataFrame, key: str, cursor: object, limit: int) -> DataFrame:
    """Keyset pagination: the next ``limit`` rows after a cursor."""
    return df.filter(F.col(key) > F.lit(cursor)).orderBy(key).limit(limit)


def earliest_due(sources: DataFrame, as_of: Column) -> DataFrame:
    """Earliest due source of every store."""
    due = sources.filter(F.col("enabled") & (F.col("next_scan_at") <= as_of))
    return earliest_per(due, ["store_id"], ["next_scan_at", "source_id"])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First occurrence of every key."""
    return earliest_per(df, keys, order)


def priced_directory(public_offers: DataFrame, variants: DataFrame, query: str | None = None, section: str | None = None) -> DataFrame:
    """Products with visible cash prices: confirmed prices, review flags and counts per variant."""
    ok = F.col("eligible_for_ranking")
    offers = public_offers.groupBy("variant_id").agg(
        F.min("cash_price").alias("lowest_cash_price"),
        F.min(F.when(ok, F.col("cash_price"))).alias("lowest_confirmed_cash_price"),
        F.min(F.when(ok, F.coalesce("comparable_total", "cash_price"))).alias("lowest_final_cost"),
        F.min(F.when(ok, F.col("comparable_total"))).alias("lowest_delivered_total"),
        F.count(F.lit(1)).alias("cash_offer_count"),
        F.count_if(ok).alias("confirmed_cash_offer_count"),
        F.count_if(~ok).alias("review_cash_offer_count"),
    )
    rows = _listed(variants, query, section).join(offers, "variant_id")
    review = (F.col("confirmed_cash_offer_count") == 0) & (F.col("review_cash_offer_count") > 0)
    return rows.withColumn("cash_price_review_required", review)


def priced_plan_directory(public_plans: DataFrame, variants: DataFrame, query: str | None = None, section: str | None = None) -> DataFrame:
    """Products with visible instalment plans."""
    ok = F.col("eligible_for_ranking")
    shown = public_plans.filter(F.col("periodic_payment").isNotNull() | F.col("normalized_total").isNotNull())
    plans = shown.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("installment_plan_count"),
        F.count_if(ok).alias("confirmed_installment_plan_count"),
        F.count_if(~ok).alias("review_installment_plan_count"),
        F.min(F.when(ok, F.col("periodic_payment"))).alias("lowest_periodic_payment"),
        F.min(F.when(ok, F.col("normalized_total"))).alias("lowest_installment_total"),
        F.min("periodic_payment").alias("lowest_visible_periodic_payment"),
        F.min("normalized_total").alias("lowest_visible_installment_total"),
    )
    rows = _listed(variants, query, section).join(plans, "variant_id")
    review = (F.col("confirmed_installment_plan_count") == 0) & (F.col("review_installment_plan_count") > 0)
    return rows.withColumn("installment_price_review_required", review)


def _listed(variants: DataFrame, query: str | None, section: str | None) -> DataFrame:
    rows = published(variants).filter("active")
    if query:
        rows = rows.filter(F.lower(F.concat_ws(" ", "canonical_name", "brand", "model", "variant_name")).contains(query.lower()))
    if section:
        rows = rows.filter(F.col("section") == section)
    return rows.select("variant_id", "canonical_name", "section", "product_type", "brand", "model", "variant_name")


def directory_order() -> list[Column]:
    """Order of the cash directory: most confirmed offers, then cheapest, then name."""
    cost = F.coalesce("lowest_final_cost", "lowest_confirmed_cash_price", "lowest_cash_price")
    return [F.desc("confirmed_cash_offer_count"), cost.asc_nulls_last(), F.asc("canonical_name"), F.asc("variant_id")]


def list_variants(variants: DataFrame, summary: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """Variants with their offer summary, filtered, in specification order (``position``)."""
    rows = published(variants)
    for column, value in (filters or {}).items():
        rows = rows.filter(F.col(column) == value)
    prices = summary.select("variant_id", "lowest_cash_price", "lowest_delivered_total", "cash_offer_count", "installment_plan_count")
    return rows.join(prices, "variant_id", "left").orderBy(
        F.col("storage_gb").asc_nulls_last(), F.col("ram_gb").asc_nulls_last(), "variant_name", "canonical_name", "variant_id"
    )


def product_comparison(ranked_offers: DataFrame, variant_id: object | None = None) -> DataFrame:
    """Ranked offers of one product (a filter that reaches the scan) or of all products."""
    rows = ranked_offers if variant_id is None else ranked_offers.filter(F.col("variant_id") == variant_id)
    return rows.select("variant_id", "offer_rank", "offer_id", "store_name", "cash_price", "comparable_total", "computed_freshness", "availability", "eligible_for_ranking")


def materialize_comparisons(ranked_offers: DataFrame) -> DataFrame:
    """Serving rows of all offers of every product, for point reads by (variant, rank).

    Rows stay one per offer: a document per product would pull every offer of
    a product into one value.
    """
    return product_comparison(ranked_offers)


def comparison_entries(ranked_offers: DataFrame, ranked_plans: DataFrame) -> DataFrame:
    """What the comparison document of a product holds, one row per entry: all its offers, then all its instalment plans, each in rank order."""
    cash = lambda c: F.col(c).cast("decimal(18,2)")
    none = lambda kind: F.lit(None).cast(kind)
    offers = ranked_offers.select(
        "variant_id", F.lit("offer").alias("kind"), F.col("offer_rank").alias("rank"), F.col("offer_id").cast("bigint").alias("entry_id"), "store_name",
        none("string").alias("provider_name"), cash("cash_price").alias("amount"), cash("comparable_total").alias("total"), none("int").alias("months"),
        "computed_freshness", "availability", "eligible_for_ranking",
    )
    plans = ranked_plans.select(
        "variant_id", F.lit("plan").alias("kind"), F.col("plan_rank").alias("rank"), F.col("plan_id").cast("bigint").alias("entry_id"), "store_name",
        "provider_name", cash("periodic_payment").alias("amount"), cash("normalized_total").alias("total"), F.col("months").cast("int").alias("months"),
        "computed_freshness", none("string").alias("availability"), "eligible_for_ranking",
    )
    return offers.unionByName(plans)


def write_comparisons(entries: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The entries as table ``table`` at ``path``, bucketed by product and sorted inside: a read of one product opens one bucket."""
    placed = entries.repartition(buckets, "variant_id")
    placed.write.bucketBy(buckets, "variant_id").sortBy("variant_id", "kind", "rank").option("path", path).mode("overwrite").saveAsTable(table)
    return entries.sparkSession.table(table)


def comparison_of(table: DataFrame, variant_id: object) -> DataFrame:
    """The document of one product in reading order."""
    return table.filter(F.col("variant_id") == variant_id).orderBy("kind", "rank")


def model_groups(products: DataFrame) -> DataFrame:
    """Products grouped by normalised brand and model, with a representative and the number of variants."""
    key = F.concat_ws("|", text.normalized_text(F.col("brand")), text.normalized_text(F.coalesce("model", "canonical_name")))
    return products.withColumn("model_key", key).groupBy("model_key").agg(
        F.min_by("variant_id", F.struct("variant_name", "variant_id")).alias("representative_id"),
        F.min("brand").alias("brand"),
        F.min("section").alias("section"),
        F.count(F.lit(1)).alias("variant_count"),
    )


def assign_taxonomy(products: DataFrame, leaves: DataFrame) -> DataFrame:
    """First taxonomy leaf whose section and type match, and whose subtype matches or is open.

    ``leaves`` has section, type, subtype (NULL = any), leaf and position.
    """
    p = products.select("variant_id", "section", F.col("product_type").alias("type"), F.col("subtype").alias("_sub"))
    hits = p.join(leaves, ["section", "type"]).filter(F.col("subtype").isNull() | (F.col("subtype") == F.col("_sub")))
    best = hits.groupBy("variant_id").agg(F.min_by("leaf", "position").alias("leaf"))
    return p.select("variant_id").join(best, "variant_id", "left")


def taxonomy_counts(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("leaf").isNotNull()).groupBy("leaf").agg(F.count(F.lit(1)).alias("product_count"))


def directories(verified: DataFrame, products: DataFrame, by: str, slug_from: str | None = None) -> DataFrame:
    """Brand, store or category directory over verified presence: products, stores and slug per value."""
    rows = verified.select("variant_id", "store_id").distinct().join(products, "variant_id")
    grouped = rows.groupBy(by).agg(
        F.count_distinct("variant_id").alias("product_count"), F.count_distinct("store_id").alias("store_count")
    )
    return grouped.withColumn("slug", text.slug(F.col(slug_from or by).cast("string")))


def compare(variants: DataFrame, costs: DataFrame, ids: Sequence[object], specs: str = "specs") -> DataFrame:
    """Value score of two to four products: price 45, completeness 35, stores 20.

    ``costs`` has lowest_final_cost and confirmed_store_count per variant.
    """
    unique = list(dict.fromkeys(ids))
    if not 2 <= len(unique) <= 4:
        raise ValueError("choose between two and four distinct products")
    rows = variants.filter(F.col("variant_id").isin(unique)).join(costs, "variant_id", "left")
    everything = Window.partitionBy(F.lit(1))
    keys = F.size(F.array_distinct(F.flatten(F.collect_list(F.map_keys(specs)).over(everything))))
    price = F.col("lowest_final_cost").cast("double")
    top = F.coalesce(F.max(F.when(price > 0, price)).over(everything), F.lit(1.0))
    score = (
        F.coalesce(1 - price / top, F.lit(0.0)) * 45
        + F.size(F.map_keys(specs)) / F.greatest(keys, F.lit(1)) * 35
        + F.least(F.coalesce("confirmed_store_count", F.lit(0)) / 4, F.lit(1.0)) * 20
    )
    return rows.withColumn("value_score", F.round(score, 2))


def comparison_matrix(variants: DataFrame, ids: Sequence[object], specs: str = "specs") -> DataFrame:
    """One row per specification name, one column per product."""
    chosen = variants.filter(F.col("variant_id").isin(list(ids))).select("variant_id", F.explode(specs).alias("name", "value"))
    return chosen.groupBy("name").pivot("variant_id", list(ids)).agg(F.first("value"))


def matrix_diff(matrix: DataFrame) -> DataFrame:
    """Rows of a comparison matrix whose values differ."""
    columns = [c for c in matrix.columns if c != "name"]
    values = F.transform(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]), lambda v: F.coalesce(v, F.lit("\u0000")))
    return matrix.filter(F.size(F.array_distinct(values)) > 1)


def alternative_costs(cash: DataFrame, plans: DataFrame, floor: float = PRICING.floor) -> DataFrame:
    """Lowest true cost per variant over clear offers whose price and cost reach ``floor``, and lowest instalment total; variants with neither have no row."""
    clear = cash.filter((F.col("anomaly_status") == "clear") & (F.col("cash_price") >= floor) & (F.col("final_cost") >= floor))
    lowest = clear.groupBy("variant_id").agg(F.min("final_cost").alias("lowest_final_cost"))
    total = plans.groupBy("variant_id").agg(F.min("final_installment_cost").alias("lowest_installment_total")).filter("lowest_installment_total IS NOT NULL")
    return lowest.join(total, "variant_id", "full")


def alternatives(requested: DataFrame, variants: DataFrame, costs: DataFrame, k: int = 12) -> DataFrame:
    """Best ``k`` alternatives in the same category for each requested variant.

    ``requested`` (variant_id) is the short list being served, so the work is
    one pass over the variants per request and never a pairing of all variants.
    ``variants`` has category_id, brand, model, active and the compared ``specs``
    map; ``costs`` has lowest_final_cost and may have lowest_installment_total.
    Candidates are active and have either cost; a candidate with instalments
    alone has no price gap.
    """
    instalment = F.col("lowest_installment_total") if "lowest_installment_total" in costs.columns else F.lit(None)
    entries = F.map_entries(F.transform_values("specs", lambda _, v: text.search_key(v)))
    base = variants.join(costs, "variant_id", "left").select(
        "variant_id", F.coalesce(F.col("category_id").cast("string"), F.lit("\u0000")).alias("category"), "brand", "model",
        F.col("lowest_final_cost").cast("double").alias("price"), entries.alias("specs"),
        (F.col("active") & (F.col("lowest_final_cost").isNotNull() | instalment.isNotNull())).alias("offered"),
    )
    asked = base.join(requested.select("variant_id").distinct(), "variant_id", "left_semi")
    left = asked.select(*[F.col(c).alias("l_" + c) for c in ("variant_id", "category", "brand", "model", "price", "specs")])
    right = base.filter("offered").drop("offered").withColumnRenamed("variant_id", "alternative_id")
    pairs = left.join(right, (F.col("l_category") == F.col("category")) & (F.col("l_variant_id") != F.col("alternative_id")))
    shared = F.filter("l_specs", lambda e: F.exists("specs", lambda o: o["key"] == e["key"]))

    def points(e: Column) -> Column:
        other = F.get(F.filter("specs", lambda o: o["key"] == e["key"]), 0)["value"]
        return F.when(e["value"] == other, 1.0).when(other.contains(e["value"]) | e["value"].contains(other), 0.65).otherwise(0.0)

    similarity = F.coalesce(
        F.aggregate(shared, F.lit(0.0), lambda acc, e: acc + points(e)) / F.nullif(F.size(shared), F.lit(0)), F.lit(0.0)
    )
    gap = F.col("price") - F.col("l_price")
    same_brand = F.col("brand").eqNullSafe(F.col("l_brand"))
    pairs = pairs.withColumns({"similarity": similarity, "price_gap": gap})
    s, g = F.col("similarity"), F.col("price_gap")
    kind = (
        F.when((g < 0) & (s >= 0.45), "cheaper_similar")
        .when((g > 0) & (g <= F.greatest(F.col("l_price") * 0.12, F.lit(1500.0))) & (s >= 0.55), "small_upgrade")
        .when(~same_brand & (s >= 0.50), "same_budget_other_brand")
        .when(same_brand & F.col("model").eqNullSafe(F.col("l_model")), "different_capacity")
        .otherwise("similar")
    )
    penalty = F.coalesce(F.abs(g) / F.greatest(F.col("l_price"), F.lit(1.0)) * 30, F.lit(10.0))
    pairs = pairs.withColumns({"alternative_type": kind, "rank_score": F.round(s * 100 - penalty, 6)})
    ranked = top_per(pairs, ["l_variant_id"], [F.desc("rank_score"), "alternative_id"], k, "alternative_rank")
    return ranked.select(
        F.col("l_variant_id").alias("variant_id"), "alternative_id", F.round(F.col("similarity") * 100, 2).alias("similarity_score"),
        "price_gap", "alternative_type", "rank_score", "alternative_rank",
    )


def offer_documents(offers: DataFrame, variants: DataFrame) -> DataFrame:
    """Structured product export: low, high and number of offers as one JSON text per product."""
    priced = offers.filter((F.col("cash_price") > 0) & (F.col("currency") == "EGP"))
    span = priced.groupBy("variant_id").agg(
        F.min("cash_price").alias("lowPrice"), F.max("cash_price").alias("highPrice"), F.count(F.lit(1)).alias("offerCount")
    )
    rows = variants.join(span, "variant_id", "left")
    offer = F.when(
        F.col("offerCount") > 0,
        F.struct(F.when(F.col("offerCount") > 1, "AggregateOffer").otherwise("Offer").alias("@type"), F.lit("EGP").alias("priceCurrency"), "lowPrice", "highPrice", "offerCount"),
    )
    document = F.struct(
        F.lit("Product").alias("@type"), text.clean_text(text.display_name(F.col("brand"), F.col("model"), F.lit(None).cast("string"))).alias("name"),
        F.col("variant_id").cast("string").alias("sku"), F.col("brand").alias("brand"), offer.alias("offers"),
    )
    return rows.select("variant_id", F.to_json(document).alias("document"))
