"""Cases of the third round of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlake.functions import urls
from offerlake.operators import matching, replay
from offerlake.operators.extraction import normalize_import
from offerlake.plans import history, search


def test_one_cent_is_a_change_in_binary_prices(spark):
    rows = spark.sql("SELECT 1L AS variant_id, id AS obs_id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,id) AS observed_at, CASE id WHEN 0 THEN 100.02D ELSE 100.01D END AS price FROM range(2)")
    assert history.price_changes(rows).first()["change_count"] == 1


def test_codes_keep_numbers_whole(spark):
    rows = [("a", "/p/mx10995-495"), ("b", "/p/mx11004-4"), ("c", "/p/sm-123-456-case"), ("d", "/p/mx109954"), ("e", "/p/blackmx10995case")]
    items = spark.createDataFrame([(i, "Thing", "https://shop.example" + u) for i, u in rows], "item_id string, title string, normalized_url string")
    codes = spark.createDataFrame([(k,) for k in ("mx10995", "mx109954", "mx11004", "mx110044", "sm123456")], "key string")
    found = sorted((r["item_id"], r["key"]) for r in matching.codes_in_text(items, codes).collect())
    assert found == [("a", "mx10995"), ("b", "mx11004"), ("c", "sm123456"), ("d", "mx109954"), ("e", "mx10995")]


def test_token_search_never_broadcasts_the_pieces_of_texts(spark, tables):
    queries = spark.createDataFrame([("1", "ring red"), ("2", "zz"), ("3", "r")], "query_id string, query string")
    rows = search.token_search(queries, tables.fx_variants, 5)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    shown = tables.fx_variants.select("variant_id", "canonical_name", F.lower(F.concat_ws(" ", "brand", "model", "canonical_name", "variant_name")).alias("t"))
    from offerlake.plans.browse import published

    known = published(tables.fx_variants).select("variant_id").join(shown, "variant_id").collect()
    want = []
    for number, words in (("1", ["ring", "red"]), ("2", ["zz"]), ("3", ["r"])):
        hits = sorted((r["canonical_name"], r["variant_id"]) for r in known if all(w in r["t"] for w in words))
        want += [(number, rank, v) for rank, (_, v) in enumerate(hits[:5], 1)]
    assert sorted((r["query_id"], r["rank"], r["variant_id"]) for r in rows.collect()) == want


def test_references_are_evaluated_once(spark):
    slow = F.col("u")
    text = spark.range(1).select(F.lit("https://a.example/x/y").alias("b"), F.lit("../z/").alias("u")).select(urls.absolute_url(slow, F.col("b")).alias("r"))
    plan = text._jdf.queryExecution().analyzed().toString()
    assert plan.count("trim(u#") == 1
    assert text.first()["r"] == "https://a.example/z/"


def test_import_names_by_rank_path_and_place(spark):
    record = '{"name": "outer", "product": {"title": "T", "name": "inner"}, "offers": {"price": "7", "sale-price": "5"}}'
    rows = spark.createDataFrame([(record,)], "j string").select(F.try_parse_json("j").alias("record"))
    row = normalize_import(rows).first()
    # a path outranks every inner name: productname is the product's name here
    assert (row["title"], row["price"]) == ("inner", 5.0)


def test_no_price_is_near_a_base_of_zero(spark):
    """A first price of 0 stays the base; nothing is within a ratio of it."""
    rows = spark.sql(
        "SELECT 1L AS offer_key, id AS obs_id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,id) AS observed_at,"
        " CAST(array(0, 5, 0, 7)[id] AS DECIMAL(18,2)) AS cash_price FROM range(4)"
    )
    got = replay.gate_price_ratio(rows).orderBy("obs_id").collect()
    assert [r["accepted"] for r in got] == [True, False, False, False]
    assert [None if r["base_price"] is None else float(r["base_price"]) for r in got] == [None, 0.0, 0.0, 0.0]


def test_history_takes_the_difference_of_binary_prices(spark):
    """1000.02 - 1000.01 falls short of 0.01, 100.03 - 100.02 does not."""
    prices = "array(array(1000.01, 1000.02), array(100.02, 100.03))[v]"
    rows = spark.sql(
        f"SELECT v AS variant_id, v * 10 + id AS obs_id, 1L AS store_id, timestamp_ntz'2001-06-01' + make_interval(0,0,0,id) AS observed_at,"
        f" CAST({prices}[id] AS DECIMAL(18,2)) AS cash_price, CAST(NULL AS DECIMAL(18,2)) AS shipping_cost"
        " FROM range(2) CROSS JOIN (SELECT id AS v FROM range(2))"
    )
    got = {r["variant_id"]: r["change_count"] for r in history.price_history(rows, "2001-06-15 00:00:00").collect()}
    assert got == {0: int(abs(1000.02 - 1000.01) >= 0.01), 1: int(abs(100.03 - 100.02) >= 0.01)} == {0: 0, 1: 1}


def test_a_decision_shuffles_the_ledger_once(spark, tables):
    """Offers, listings and store quality read one pick of the newest observations; only keys are picked beside it."""
    from checks import decisions

    plan = decisions.decision_inputs(tables)
    plan.write.format("noop").mode("overwrite").save()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "hashpartitioning(mapping_id" not in text
    once = tables.picked_by_aggregate()
    columns = ["obs_id", "cash_price", "availability", "anomaly_status"]
    assert sorted(map(tuple, once.fx_offers.select(*columns).collect()), key=str) == sorted(map(tuple, tables.fx_offers.select(*columns).collect()), key=str)


def test_the_history_of_a_decision_is_that_of_the_history(spark, tables):
    columns = ["variant_id", "average_90d", "lowest_90d", "sufficient_for_recommendation"]
    at = "2001-06-15 00:00:00"
    whole = history.price_history(tables.fx_observations, at).select(*columns).collect()
    assert sorted(map(tuple, history.decision_history(tables.fx_observations, at).select(*columns).collect())) == sorted(map(tuple, whole))


def test_row_numbers_by_size_equal_plain_ones(spark):
    from pyspark.sql import Window

    from offerlake.config import SkewRules
    from offerlake.operators import skew

    rows = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("k"), "id", (F.col("id") * 37 % 101).cast("double").alias("x"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    got = skew.with_row_numbers_by_size(rows, ["k"], {"r": (["x", "id"], F.col("x"))}, "n", SkewRules(min_rows=50))
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("x", "id")))
    assert sorted(map(tuple, got.select("id", "r").collect())) == sorted(map(tuple, want.select("id", "r").collect()))


def test_a_price_cluster_reads_its_context_once(spark):
    from offerlake.operators import extraction as ex

    prices = F.array(F.lit(1200.0), F.lit(None).cast("double"), F.lit(100.0), F.lit(1500.0))
    rows = spark.range(1).select(ex.split_price_cluster(prices, F.concat(F.lit("Monthly "), F.col("id"))).alias("s"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(Monthly ") <= 2 and "array_sort" not in plan  # not once per word
    assert tuple(rows.first()["s"]) == (1200.0, 1500.0)
