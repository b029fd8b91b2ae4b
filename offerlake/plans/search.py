"""Catalogue search for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text
from offerlake.operators.skew import top_per
from offerlake.plans.browse import published


def search(variants: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """One query over name, model and brand: name hits first, then trigram relevance."""
    key = text.search_key(F.lit(query))
    hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), key)
    rows = published(variants).filter(hit("canonical_name") | hit("model") | hit("brand"))
    relevance = text.trigram_similarity(text.trigrams(F.col("canonical_name")), text.trigrams(key))
    rows = rows.withColumns({"name_hit": F.when(hit("canonical_name"), 0).otherwise(1), "relevance": relevance})
    return rows.orderBy("name_hit", F.desc("relevance"), "canonical_name", "variant_id").limit(limit)


def smart_search(
    queries: DataFrame, variants: DataFrame, aliases: DataFrame, k: int = 20, alias_threshold: float = 0.18, threshold: float = 0.12
) -> DataFrame:
    """Best ``k`` variants per query: document, name, alias similarity or an exact code.

    ``queries`` has query_id and query; ``variants`` has search_document; ``aliases``
    has variant_id and normalized_alias.  A query sees of a text only the
    trigrams that queries have, their number and the queries it contains: texts
    alike in these are compared once, and of the variants whose texts are all
    alike only the first ``k`` by name can be among the best.
    """
    q = queries.withColumn("key", text.search_key(F.col("query"))).filter(F.col("key") != "")
    keys = q.select("key").distinct().withColumn("grams", text.trigrams(F.col("key")))
    live = published(variants).filter("active").select(
        "variant_id", "canonical_name", "search_document", F.lower("canonical_name").alias("name"),
        F.lower(F.coalesce("manufacturer_sku", F.lit(""))).alias("sku"), F.lower(F.coalesce("gtin", F.lit(""))).alias("gtin"),
    )
    asked = keys.agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("_asked"), F.collect_list("key").alias("_keys"))  # one row

    def seen(c: Column) -> Column:
        grams = text.trigrams(c)
        known = text.let(grams, lambda g: F.struct(F.array_sort(F.array_intersect(g, "_asked")).alias("grams"), F.size(g).alias("n")))
        held = F.array_sort(F.filter("_keys", lambda k: F.contains(c, k)))
        return F.struct(known.alias("known"), F.coalesce(held, F.array().cast("array<string>")).alias("held"))

    own = aliases.groupBy("variant_id").agg(F.collect_set("normalized_alias").alias("_aliases"))
    rows = live.join(own, "variant_id", "left").join(F.broadcast(asked))
    sights = rows.select(
        "variant_id", "canonical_name", seen(F.col("search_document")).alias("document"), seen(F.col("name"))["known"].alias("name"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("_aliases", F.array().cast("array<string>")), seen))).alias("others"),
    )
    alike = ["document", "name", "others"]
    firsts = top_per(sights, alike, ["canonical_name", "variant_id"], k, "_nth").drop("_nth")
    kinds = firsts.select(*alike).distinct().withColumn("kind", F.struct(*alike)).drop(*alike)
    none = F.array().cast("array<string>")
    each = F.concat(
        F.array(F.struct(F.lit("document").alias("of"), F.col("kind.document.known").alias("known"), F.col("kind.document.held").alias("held"))),
        F.array(F.struct(F.lit("name").alias("of"), F.col("kind.name").alias("known"), none.alias("held"))),
        F.transform("kind.others", lambda o: F.struct(F.lit("alias").alias("of"), o["known"].alias("known"), o["held"].alias("held"))),
    )
    parts = kinds.select("kind", F.explode(each).alias("t")).select("kind", "t.of", "t.known", "t.held")
    left = keys.select("key", F.size("grams").alias("kn"), F.explode("grams").alias("gram"))
    right = parts.select("known").distinct().select("known", F.explode("known.grams").alias("gram"))
    shared = left.join(right, "gram").groupBy("key", "known", "kn").agg(F.count(F.lit(1)).alias("c"))
    near = shared.select("key", "known", (F.col("c") / (F.col("kn") + F.col("known.n") - F.col("c"))).alias("similarity"))
    least = F.when(F.col("of") == "document", threshold).when(F.col("of") == "alias", alias_threshold)
    entry = F.coalesce((F.col("similarity") > least) | F.array_contains("held", F.col("key")), F.lit(False))
    met = parts.join(near, "known").withColumn("entry", entry).filter(F.col("entry") | (F.col("of") == "name"))
    scores = met.groupBy("kind", "key").agg(F.max("similarity").alias("search_score"), F.bool_or("entry").alias("entry")).filter("entry")
    found = scores.join(firsts.select("variant_id", "canonical_name", F.struct(*alike).alias("kind")), "kind").select("key", "variant_id", "canonical_name", "search_score")
    codes = live.select("variant_id", "canonical_name", F.explode(F.array("sku", "gtin")).alias("key")).filter(F.col("key") != "")
    exact = keys.select("key").join(codes, "key").select("key", "variant_id", "canonical_name", F.lit(1.0).alias("search_score"))
    scored = found.unionByName(exact).groupBy("key", "variant_id", "canonical_name").agg(F.max("search_score").alias("search_score"))
    best = top_per(scored, ["key"], [F.desc("search_score"), "canonical_name", "variant_id"], k)
    rows = q.select("query_id", "key").join(best, "key")
    suggestion = F.when((F.col("rank") == 1) & (F.col("search_score") >= 0.25), F.col("canonical_name"))
    return rows.select("query_id", "rank", "variant_id", "canonical_name", "search_score", suggestion.alias("suggestion"))


def token_search(queries: DataFrame, variants: DataFrame, k: int = 16) -> DataFrame:
    """Variants whose text contains every token of a query.

    Tokens may match inside words, so each query's longest token is looked up
    in a trigram table first and the rest is verified on those rows.
    """
    q = queries.withColumn("_tokens", F.filter(F.split(text.search_key(F.col("query")), " "), lambda t: t != ""))
    longest = F.element_at(F.array_sort(F.transform("_tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"]
    q = q.filter(F.size("_tokens") > 0).withColumn("_lead", F.substr(longest, F.lit(1), F.lit(3)))
    words = text.search_key(F.concat_ws(" ", "brand", "model", "canonical_name", "variant_name"))
    # Of the variants with one text and name only the first k can be among a query's first k, so a text is cut up once.
    docs = published(variants).select("variant_id", "canonical_name", words.alias("_text"))
    same = top_per(docs, ["_text", "canonical_name"], ["variant_id"], k, "_nth").drop("_nth")
    lead_sizes = q.agg(F.collect_set(F.length("_lead")).alias("_sizes"))  # one row
    texts = same.select("_text").distinct().join(F.broadcast(lead_sizes))
    pieces = F.flatten(
        F.transform(
            "_sizes",
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("_text") - n + 1, F.lit(1))), lambda i: F.substr("_text", i, n)
            ),
        )
    )
    # Catalyst sizes the exploded pieces by the columns they come from; the hint keeps it from broadcasting them.
    index = texts.select("_text", F.explode(F.array_distinct(pieces)).alias("_lead")).hint("merge")
    met = index.join(q, "_lead").filter(F.forall("_tokens", lambda t: F.contains(F.col("_text"), t)))
    hits = met.select("query_id", "_text").join(same, "_text")
    return top_per(hits, ["query_id"], ["canonical_name", "variant_id"], k).select("query_id", "rank", "variant_id", "canonical_name")
