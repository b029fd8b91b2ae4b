"""Catalogue matching: blocking keys, exact and fuzzy joins, pair scores, winner choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.config import MATCHING, MatchRules
from offerlake.functions import ids, specs, text, urls
from offerlake.functions.similarity import sequence_ratio
from offerlake.operators.skew import earliest_per, top_per
from offerlake.session import checkpointed

# Model words that separate variants, and colour words.
DECISIVE_WORDS = ("pro", "max", "plus", "ultra", "mini", "air", "fe")
COLOR_WORDS = (
    "black", "white", "blue", "green", "red", "pink", "purple", "violet", "silver", "gold", "gray", "grey", "beige",
    "brown", "orange", "yellow", "اسود", "أبيض", "ابيض", "ازرق", "أزرق", "اخضر", "أخضر", "احمر", "أحمر", "فضي", "ذهبي",
    "رمادي",
)


# --- blocking ----------------------------------------------------------------------------


def receives_offers() -> Column:
    return F.coalesce("active", F.lit(True)) & (F.coalesce("source_status", F.lit("")) != "catalog_provisional")


def matchable(variants: DataFrame) -> DataFrame:
    """Variants that may receive offers."""
    return variants.filter(receives_offers())


def variant_keys(variants: DataFrame) -> DataFrame:
    """``(kind, key, variant_id)``: trade number, compact part number, brand and model anchors."""
    sku = text.compact_key(F.col("manufacturer_sku"))
    anchors = F.filter(text.tokens(text.normalized_text(F.col("model"))), ids.distinctive_model_token)
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    single = F.array(
        entry("gtin", ids.valid_gtin(F.col("gtin"))),
        entry("sku", F.when(F.length(sku) >= 4, sku)),
        entry("brand", F.nullif(text.normalized_text(F.col("brand")), F.lit(""))),
    )
    entries = F.concat(single, F.transform(anchors, lambda a: entry("model_anchor", a)))
    rows = matchable(variants).select("variant_id", F.explode(entries).alias("e"))
    return rows.select("variant_id", "e.kind", "e.key").filter(F.col("key").isNotNull())


def idle_codes(variants: DataFrame) -> DataFrame:
    """``key`` of the compact part numbers of variants that receive no offers: known, though nothing matches them."""
    sku = text.compact_key(F.col("manufacturer_sku"))
    return variants.filter(~receives_offers()).select(sku.alias("key")).filter(F.length("key") >= 4)


def unique_keys(keys: DataFrame, kind: str) -> DataFrame:
    """Keys of one kind that point to exactly one variant."""
    grouped = keys.filter(F.col("kind") == kind).groupBy("key").agg(
        F.min("variant_id").alias("variant_id"), F.max("variant_id").alias("_other")
    )
    return grouped.filter(F.col("variant_id") == F.col("_other")).drop("_other")


def searchable(title: Column, url: Column) -> Column:
    """Normalised title and URL path as one text."""
    return text.normalized_text(F.concat_ws(" ", title, F.replace(urls.decoded_path(url), F.lit("/"), F.lit(" "))))


# --- deterministic cascade -------------------------------------------------------------


def match_exact(items: DataFrame, keys: DataFrame) -> DataFrame:
    """``(item_id, variant_id, score, method)`` by a unique trade number, else a unique part number."""
    rows = items.select(
        "item_id",
        F.explode(
            F.array(
                F.struct(F.lit("gtin").alias("kind"), ids.valid_gtin(F.col("gtin")).alias("key"), F.lit(200.0).alias("score")),
                F.struct(F.lit("sku").alias("kind"), text.compact_key(F.col("sku")).alias("key"), F.lit(185.0).alias("score")),
            )
        ).alias("e"),
    ).select("item_id", "e.*")
    rows = rows.filter(F.col("key").isNotNull() & ((F.col("kind") == "gtin") | (F.length("key") >= 4)))
    known = unique_keys(keys, "gtin").withColumn("kind", F.lit("gtin")).unionByName(
        unique_keys(keys, "sku").withColumn("kind", F.lit("sku"))
    )
    hits = rows.join(known, ["kind", "key"])
    best = hits.groupBy("item_id").agg(F.max_by(F.struct("variant_id", "score", "kind"), "score").alias("b"))
    method = F.when(F.col("b.kind") == "gtin", "catalog_exact_gtin").otherwise("catalog_exact_manufacturer_sku")
    return best.select("item_id", "b.variant_id", "b.score", method.alias("method"))


def contained_keys(texts: DataFrame, keys: DataFrame, id_column: str = "item_id") -> DataFrame:
    """``(id, key)`` for every key that occurs inside the compact text of a row.

    Containment becomes two equality joins: the windows of a text as long as
    the shortest key meet the (prefix, length) pairs that keys really have,
    and only those places are cut to full length and looked up.  No text meets
    every key, and equal texts are cut once.
    """
    known = keys.select("key").distinct()
    shortest = F.broadcast(known.agg(F.min(F.length("key")).alias("_n")).withColumn("_one", F.lit(1)))  # one row
    cut = known.withColumn("_one", F.lit(1)).join(shortest, "_one")
    heads = cut.select(F.substr("key", F.lit(1), F.col("_n")).alias("_head"), F.length("key").alias("_len")).distinct()
    distinct = texts.select("compact").distinct().withColumn("_one", F.lit(1)).join(shortest, "_one")
    places = F.sequence(F.lit(1), F.length("compact") - F.col("_n") + 1)
    windows = distinct.filter(F.length("compact") >= F.col("_n")).select("compact", "_n", F.explode(places).alias("_at"))
    windows = windows.select("compact", "_at", F.substr("compact", F.col("_at"), F.col("_n")).alias("_head"))
    spots = windows.join(heads, "_head").select("compact", F.substr("compact", F.col("_at"), F.col("_len")).alias("key"))
    hits = spots.distinct().join(known, "key")
    return texts.select(id_column, "compact").join(hits, "compact").select(id_column, "key")


def codes_in_text(items: DataFrame, codes: DataFrame, idle: DataFrame | None = None) -> DataFrame:
    """``(item_id, key)`` for every code (``key``) inside an item's title or URL path, numbers kept whole.

    A code never starts or ends inside a number.  One that runs on from a number
    into the next word's number (``mx11004`` and ``4``) counts only in a text
    that holds no code without doing so.  Such a code may also be one of
    ``idle``, which are known but never returned.
    """
    spaced = text.code_runs(searchable(F.col("title"), F.col("normalized_url")), " ")
    marked = F.replace(F.regexp_replace(spaced, "(?<=[0-9]) (?=[0-9])", "\n"), F.lit(" "), F.lit(""))
    texts = items.select("item_id", marked.alias("_marked"))
    distinct = texts.select("_marked").distinct().withColumn("compact", F.replace("_marked", F.lit("\n"), F.lit("")))
    codes = codes.select("key").distinct()
    known = codes if idle is None else codes.unionByName(idle.select("key"))
    found = contained_keys(distinct, known, "_marked")
    bound = lambda body: F.concat(
        F.when(F.col("key").rlike("^[0-9]"), "(?<![0-9])").otherwise(""), body, F.when(F.col("key").rlike("[0-9]$"), "(?![0-9])").otherwise("")
    )
    joined = bound(F.regexp_replace("key", "(?<=[0-9])(?=[0-9])", "\n?"))
    found = found.withColumn("_whole", F.rlike("_marked", bound(F.col("key")))).filter(F.col("_whole") | F.rlike("_marked", joined))
    any_whole = F.max("_whole").over(Window.partitionBy("_marked"))
    found = found.withColumn("_any", any_whole).filter(F.col("_whole") | ~F.col("_any"))
    if idle is not None:
        found = found.join(codes, "key", "left_semi")
    return texts.join(found.select("_marked", "key"), "_marked").select("item_id", "key")


def match_sku_in_text(items: DataFrame, keys: DataFrame, idle: DataFrame | None = None) -> DataFrame:
    """A distinctive part number inside title or URL that leaves exactly one variant."""
    skus = keys.filter((F.col("kind") == "sku") & ids.distinctive_sku(F.col("key")))
    others = None if idle is None else idle.filter(ids.distinctive_sku(F.col("key")))
    hits = codes_in_text(items, skus, others).join(skus.select("key", "variant_id"), "key")
    one = hits.groupBy("item_id").agg(F.min("variant_id").alias("variant_id"), F.max("variant_id").alias("_other"))
    return one.filter(F.col("variant_id") == F.col("_other")).select(
        "item_id", "variant_id", F.lit(175.0).alias("score"), F.lit("catalog_url_manufacturer_sku").alias("method")
    )


def models_in_text(items: DataFrame, models: DataFrame) -> DataFrame:
    """``(item_id, model)`` where the model's compact form or all its tokens occur in the item.

    ``models`` has normalised ``model``.  Token sets are found through each
    model's rarest token, then verified.
    """
    prepared = models.select("model").distinct().withColumns(
        {
            "key": text.code_runs(F.col("model"), ""),
            "tokens": text.tokens(F.col("model")),
        }
    )
    distinctive = F.exists("tokens", lambda t: t.rlike(r"\p{Nd}")) | (F.length("key") >= 6)
    prepared = prepared.filter(distinctive & (F.col("key") != ""))
    compact_hits = contained_keys(items, prepared).join(prepared.select("key", "model"), "key").select("item_id", "model")
    words = prepared.select("model", "tokens", F.explode("tokens").alias("token"))
    frequency = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(frequency, "token").groupBy("model").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("tokens")
    )
    spoken = items.select("item_id", "item_tokens", F.explode("item_tokens").alias("token"))
    token_hits = spoken.join(rarest, "token").filter(F.size(F.array_except("tokens", "item_tokens")) == 0)
    return compact_hits.unionByName(token_hits.select("item_id", "model")).distinct()


def decisive_words(model_tokens: Column) -> Column:
    """The tokens of a model that separate variants: those with a digit, and fixed edition words."""
    return F.filter(model_tokens, lambda t: t.rlike(r"\p{Nd}") | t.isin(*DECISIVE_WORDS))


def decisive_lost(decisive: Column, title_tokens: Column, compact_title: Column) -> Column:
    """Whether a title lacks a decisive word of a model, as a token and inside its compact form."""
    return (F.size(F.array_except(decisive, title_tokens)) > 0) & F.exists(decisive, lambda t: ~compact_title.contains(t))


def _agreeing_sizes(said: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Pairs with equal ``on`` whose sizes agree or are unknown, by one equality join on steps of the size."""
    unknown, whole = F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint")
    step = lambda c: F.floor(c.cast("double") * 100)
    steps = F.array_distinct(F.flatten(F.transform("_sizes", lambda v: F.array(step(v) - 1, step(v), step(v) + 1))))
    sought = F.when(F.size("_sizes") > 0, F.array_append(steps, unknown)).otherwise(F.array(whole))
    held = F.array(F.coalesce(step(F.col("t_storage_gb")), unknown), whole)
    met = said.withColumn("_step", F.explode(sought)).join(target.withColumn("_step", F.explode(held)), [*on, "_step"]).drop("_step")
    return met.filter(_sizes_agree())


def _sizes_agree() -> Column:
    size = F.col("t_storage_gb").cast("double")
    return (F.size("_sizes") == 0) | size.isNull() | F.exists("_sizes", lambda v: F.abs(v - size) < 0.01)


def _said(hits: DataFrame) -> DataFrame:
    """Texts and models with the few values that may contradict a variant, in one order."""
    title_tokens = text.tokens(F.col("title"))
    return hits.withColumns(
        {
            "_sizes": F.array_sort("_sizes"),
            "_memory": F.array_sort(specs.ram_values(F.col("title"))),
            "_colors": F.array_sort(F.filter(title_tokens, lambda w: w.isin(*COLOR_WORDS))),
            "_lost": decisive_lost(decisive_words(text.tokens(F.col("model"))), title_tokens, F.replace("title", F.lit(" "), F.lit(""))),
            "_blank": F.col("title") == "",
            "_kind": F.when(F.col("_code") != "", "code").when(F.col("gtin") != "", "signs").otherwise("none"),
        }
    )


def _told_ends(told: DataFrame, target: DataFrame, brand_ok: Column, rules: MatchRules) -> DataFrame:
    """``(doc, _low, _high)``: the least and greatest variant of a text's models that nothing in the text contradicts.

    What contradicts a variant is read from few values: sizes, colours and code
    of the text, and those of the variant.  Texts that say the same and variants
    that are told apart by nothing else meet as one row each, so the pairs grow
    with the different values and not with texts times variants.
    """
    branded = told.filter("NOT _anchored").join(target.select("model", "_brand").distinct(), "model").filter(brand_ok)
    told = told.filter("_anchored").withColumn("_for", F.lit("")).unionByName(branded.withColumnRenamed("_brand", "_for"))
    # A model anchor stands for every brand: the same variants once without and once with their brand.
    either = F.explode(F.array(F.struct(F.lit(True).alias("a"), F.lit("").alias("b")), F.struct(F.lit(False).alias("a"), F.col("_brand").alias("b"))))
    variants = target.withColumn("_e", either).withColumns({"_anchored": F.col("_e.a"), "_for": F.col("_e.b")})
    variants = variants.withColumns({"_bare": F.col("_gtin") == "", "_filled": F.coalesce("t_gtin", F.lit("")) != "", "_code": F.col("_gtin")})

    on = ["model", "_anchored", "_for"]
    traits = [c for c in ("t_storage_gb", "t_ram_gb", "t_color", "t_store_sku") if c in target.columns]
    says = [*on, "_sizes", "_memory", "_colors", "_lost", "_blank", "_kind", *(["sku"] if "t_store_sku" in traits else [])]
    ends = [F.min("t_variant_id").alias("_low"), F.max("t_variant_id").alias("_high")]

    def open_ends(texts: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
        scored = score_pairs(pairs.withColumn("t_model", F.col("model")), ratios=False).filter(F.col("score") > rules.conflict)
        found = scored.groupBy(*keys).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        return texts.join(found, keys).select("doc", "_low", "_high")

    coded, holders = told.filter("_code <> ''"), variants.filter("NOT _bare")
    said = coded.groupBy(*says, "_code").agg(F.min("title").alias("title"), F.min("gtin").alias("gtin"))
    alike = holders.groupBy(*on, *traits, "_code").agg(*ends, F.min("t_gtin").alias("t_gtin"))
    by_code = open_ends(coded, [*says, "_code"], said.join(alike, [*on, "_code"]).filter(_sizes_agree()))
    # A code contradicts every other code, so all codes count alike for the variants that have none.
    said = told.groupBy(*says).agg(F.min("title").alias("title"), F.min("gtin").alias("gtin"))
    alike = variants.groupBy(*on, *traits, "_bare", "_filled").agg(*ends, F.min("t_gtin").alias("t_gtin"))
    pairs = _agreeing_sizes(said, alike, on).filter((F.col("_kind") != "code") | F.col("_bare"))
    return by_code.unionByName(open_ends(told, says, pairs))


def match_brand_model(items: DataFrame, variants: DataFrame, rules: MatchRules = MATCHING) -> DataFrame:
    """A distinctive model in the text whose brand or model anchor is present and whose specs leave one variant.

    Equal texts are matched once.  A text without code, size or colour cannot
    tell the variants of a model apart, so it meets one row per model (or per
    model and brand).  Telling texts that say the same meet the variants that
    are told apart by nothing else as one row each (``_told_ends``).
    """
    # Equal contents are found on the raw columns, so each text is normalised once and after the shuffle.
    docs = items.select(
        "item_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.regexp_replace(F.coalesce("normalized_url", F.lit("")), "^[^:/]*://[^/?#]*", "").alias("_path"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.coalesce("gtin", F.lit("")).alias("gtin"),
        F.coalesce("sku", F.lit("")).alias("sku"),
    )
    content = ["title", "_path", "brand", "gtin", "sku"]
    docs = docs.withColumn("doc", F.sha2(F.concat_ws("\x1f", *content), 256))
    palette = F.array(*[F.lit(c) for c in COLOR_WORDS])
    distinct = docs.select("doc", *content).distinct().select(
        "doc",
        searchable(F.col("title"), F.concat(F.lit("http://host"), F.col("_path"))).alias("_s"),
        text.normalized_text(F.col("title")).alias("title"),
        text.normalized_text(F.col("brand")).alias("item_brand"),
        "gtin",
        "sku",
    )
    # The normalised texts and their model hits are read several times below: keep them instead of recomputing.
    distinct = checkpointed(
        distinct.withColumns(
            {
                "compact": text.code_runs(F.col("_s"), ""),
                "item_tokens": text.tokens(F.col("_s")),
                "_sizes": specs.storage_values(F.col("title")),
                "_code": text.normalized_text(F.col("gtin")),
            }
        )
    )
    # Catalogue variants carry no store code, so an item's code alone contradicts none of them.
    coded = F.col("sku") != "" if "store_sku" in variants.columns else F.lit(False)
    tells = (
        (F.col("gtin") != "")
        | coded
        | (F.size("_sizes") > 0)
        | (F.size(specs.ram_values(F.col("title"))) > 0)
        | F.arrays_overlap(text.tokens(F.col("title")), palette)
    )
    known = matchable(variants).withColumn("_model", text.normalized_text(F.col("model"))).filter(F.col("_model") != "")
    target = known.select(
        F.col("_model").alias("model"),
        text.normalized_text(F.col("brand")).alias("_brand"),
        text.normalized_text(F.col("gtin")).alias("_gtin"),
        *[F.col(c).alias("t_" + c) for c in TARGET_FIELDS if c in known.columns],
    )
    found = models_in_text(distinct.select(F.col("doc").alias("item_id"), "compact", "item_tokens"), target.select("model"))
    hits = distinct.join(found.withColumnRenamed("item_id", "doc"), "doc").withColumn("_tells", tells)
    hits = hits.withColumn(
        "_anchored",
        F.exists(F.array_intersect(text.tokens(F.col("model")), F.col("item_tokens")), ids.distinctive_model_token),
    )
    hits = checkpointed(_said(hits.drop("_s", "compact")))
    brand_tokens = text.tokens(F.col("_brand"))
    brand_ok = (F.col("item_brand") == F.col("_brand")) | (
        (F.size(brand_tokens) > 0) & (F.size(F.array_except(brand_tokens, F.col("item_tokens"))) == 0)
    )
    ends = [F.min("t_variant_id").alias("_low"), F.max("t_variant_id").alias("_high")]
    vague = hits.filter(~F.col("_tells"))
    by_model = vague.filter("_anchored").join(target.groupBy("model").agg(*ends), "model")
    by_brand = vague.filter("NOT _anchored").join(target.groupBy("model", "_brand").agg(*ends), "model").filter(brand_ok)
    pairs = (
        by_model.select("doc", "_low", "_high")
        .unionByName(by_brand.select("doc", "_low", "_high"))
        .unionByName(_told_ends(hits.filter("_tells"), target, brand_ok, rules))
    )
    one = pairs.groupBy("doc").agg(F.min("_low").alias("variant_id"), F.max("_high").alias("_other"))
    one = one.filter(F.col("variant_id") == F.col("_other")).drop("_other")
    return docs.select("item_id", "doc").join(one, "doc").select(
        "item_id", "variant_id", F.lit(150.0).alias("score"), F.lit("catalog_unique_brand_model").alias("method")
    )


def match_cascade(items: DataFrame, variants: DataFrame) -> DataFrame:
    """First deterministic match of each item: exact codes, a code in the text, a unique brand and model."""
    keys = variant_keys(variants)
    hits = match_exact(items, keys).unionByName(match_sku_in_text(items, keys, idle_codes(variants))).unionByName(match_brand_model(items, variants))
    best = hits.groupBy("item_id").agg(F.max_by(F.struct("variant_id", "score", "method"), "score").alias("b"))
    return best.select("item_id", "b.*")


def gate_fuzzy(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items with a code, a known brand or a model anchor: worth the fuzzy lookup."""
    coded = (F.coalesce("gtin", F.lit("")) != "") | (F.coalesce("sku", F.lit("")) != "")
    words = items.withColumn("item_tokens", text.tokens(searchable(F.col("title"), F.col("normalized_url"))))
    anchors = keys.filter(F.col("kind") == "model_anchor").select(F.col("key").alias("token"))
    brands = keys.filter(F.col("kind") == "brand").select("key").distinct()
    brands = brands.withColumn("tokens", text.tokens(F.col("key"))).filter(F.size("tokens") > 0)
    first = brands.select("tokens", F.element_at("tokens", 1).alias("token"))
    open_items = words.filter(~coded).select("item_id", "item_tokens", F.explode("item_tokens").alias("token"))
    by_anchor = open_items.join(anchors, "token", "left_semi").select("item_id")
    by_brand = (
        open_items.join(first, "token").filter(F.size(F.array_except("tokens", "item_tokens")) == 0).select("item_id")
    )
    evidence = by_anchor.unionByName(by_brand).unionByName(items.filter(coded).select("item_id"))
    return items.join(evidence, "item_id", "left_semi")


# --- similarity join ---------------------------------------------------------------------


def gram_frequency(texts: DataFrame) -> DataFrame:
    """``(gram, n)``: in how many rows of ``grams`` each trigram occurs."""
    return texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(left_text, right_text, similarity)`` of distinct texts with trigram similarity of at least ``threshold``.

    The trigrams of a text are put in one order, rarest first.  Two sets this
    similar meet in their first ``n - ceil(threshold * n) + 1`` trigrams, so only
    those are joined and the trigrams that most texts have rarely meet.  A pair
    stays open while its sizes allow the threshold and the trigrams met so far,
    with all that follow the last of them, could still reach it; open pairs are
    compared in full.  Equal texts are compared once.
    """
    grams = text.trigrams(F.col("text"))
    lefts = left.select("text").distinct().withColumn("grams", grams).filter(F.size("grams") > 0)
    rights = right.select("text").distinct().withColumn("grams", grams).filter(F.size("grams") > 0)
    frequency = gram_frequency(rights)

    def rarest(side: DataFrame, alias: str) -> DataFrame:
        spread = side.select("text", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
        ordered = spread.join(frequency, "gram", "left").groupBy("text", "size").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("ordered")
        )
        kept = F.slice("ordered", 1, F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1)
        return ordered.select(
            F.col("text").alias(f"{alias}_text"), F.col("size").alias(f"{alias}_size"),
            F.posexplode(F.transform(kept, lambda g: g["gram"])).alias(f"{alias}_at", "gram"),
        )

    sizes = (F.col("left_size") >= F.col("right_size") * threshold - 1e-9) & (F.col("right_size") >= F.col("left_size") * threshold - 1e-9)
    met = rarest(lefts, "left").join(rarest(rights, "right"), "gram").filter(sizes)
    after = F.least(F.col("left_size") - F.max("left_at"), F.col("right_size") - F.max("right_at")) - 1
    pairs = met.groupBy("left_text", "right_text", "left_size", "right_size").agg((F.count(F.lit(1)) + after).alias("most"))
    pairs = pairs.filter(F.col("most") * (1 + threshold) >= (F.col("left_size") + F.col("right_size")) * threshold - 1e-6).select("left_text", "right_text")
    full = pairs.join(lefts.select(F.col("text").alias("left_text"), F.col("grams").alias("_l")), "left_text").join(
        rights.select(F.col("text").alias("right_text"), F.col("grams").alias("_r")), "right_text"
    )
    scored = full.withColumn("similarity", text.trigram_similarity(F.col("_l"), F.col("_r"))).drop("_l", "_r")
    return scored.filter(F.col("similarity") >= threshold)


def best_alike(texts: DataFrame, names: DataFrame, k: int, threshold: float, first: float = 0.6) -> DataFrame:
    """``(left_text, variant_id, similarity)``: the best ``k`` variants of each distinct text, ties to the smaller id.

    A text with ``k`` variants at the high threshold ``first`` needs no others,
    as all of them are less alike; only the rest is joined at ``threshold``.
    """

    def found(side: DataFrame, least: float) -> DataFrame:
        hits = similarity_join(side, names.select("text"), least).join(names.withColumnRenamed("text", "right_text"), "right_text")
        return top_per(hits, ["left_text"], [F.col("similarity").desc(), "variant_id"], k).select("left_text", "variant_id", "similarity", "rank")

    if threshold >= first:
        return found(texts, threshold).drop("rank")
    strong = found(texts, first)
    full = strong.filter(F.col("rank") == k).select("left_text")
    rest = texts.select("text").distinct().join(full.withColumnRenamed("left_text", "text"), "text", "left_anti")
    return strong.join(full, "left_text", "left_semi").unionByName(found(rest, threshold)).drop("rank")


def fuzzy_candidates(
    items: DataFrame, variants: DataFrame, k: int = MATCHING.fuzzy_limit, threshold: float = MATCHING.fuzzy_threshold
) -> DataFrame:
    """Best ``k`` variants per item by title similarity; variants with the item's own code come first.

    The best ``k`` are found once per distinct title, so items with a common
    title do not multiply its candidates; coded pairs are compared on their own.
    """
    names = variants.select("variant_id", "canonical_name", "gtin", "manufacturer_sku")
    best = best_alike(items.select(F.col("title").alias("text")), names.select("variant_id", F.col("canonical_name").alias("text")), k, threshold)
    by_title = items.select("item_id", F.col("title").alias("left_text")).join(best, "left_text").select(
        "item_id", "variant_id", "similarity", F.lit(2).alias("tier")
    )
    pair = ["item_id", "variant_id", "title", "canonical_name"]
    by_gtin = items.select("item_id", "title", "gtin").join(names.select("variant_id", "canonical_name", "gtin"), "gtin")
    by_sku = items.select("item_id", "title", F.col("sku").alias("manufacturer_sku")).join(
        names.select("variant_id", "canonical_name", "manufacturer_sku"), "manufacturer_sku"
    )
    near = text.trigram_similarity(text.trigrams(F.col("title")), text.trigrams(F.col("canonical_name")))
    coded = by_gtin.select(*pair, F.lit(0).alias("tier")).unionByName(by_sku.select(*pair, F.lit(1).alias("tier")))
    coded = coded.select("item_id", "variant_id", F.when(near >= threshold, near).otherwise(0.0).alias("similarity"), "tier")
    merged = by_title.unionByName(coded).groupBy("item_id", "variant_id").agg(
        F.min("tier").alias("tier"), F.max("similarity").alias("similarity")
    )
    return top_per(merged, ["item_id"], ["tier", F.col("similarity").desc(), "variant_id"], k)


# --- pair score --------------------------------------------------------------------------

TARGET_FIELDS = (
    "variant_id", "store_id", "canonical_name", "brand", "model", "storage_gb", "ram_gb", "color", "manufacturer_sku",
    "store_sku", "gtin", "title_as_seen",
)


def _contains_number(values: Column, expected: Column) -> Column:
    """Whether a list of sizes holds the expected one; NULL when either side is unknown."""
    hit = F.exists(values, lambda v: F.abs(v - expected) < 0.01)
    return F.when(expected.isNotNull() & (F.size(values) > 0), hit)


def score_pairs(pairs: DataFrame, ratios: bool = True, rules: MatchRules = MATCHING) -> DataFrame:
    """Score (target, candidate) pairs: target columns are prefixed ``t_``, candidate columns are plain.

    Conflicting codes, sizes, colours or decisive model words give the conflict
    score.  ``ratios=False`` leaves the sequence ratios out, which never turn a
    conflict into a match.
    """
    have = set(pairs.columns)
    value = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    norm = lambda c: text.normalized_text(value(c))
    title = F.coalesce(F.nullif(value("title"), F.lit("")), value("text"))
    p = pairs.withColumns(
        {
            "_title": text.normalized_text(title), "_name": norm("t_canonical_name"), "_model": norm("t_model"),
            "_brand": norm("t_brand"), "_color": norm("t_color"),
        }
    )
    p = p.withColumns(
        {
            "_tt": text.tokens(F.col("_title")),
            "_nt": text.tokens(F.col("_name")),
            "_mt": text.tokens(F.col("_model")),
            "_ct": F.replace(F.col("_title"), F.lit(" "), F.lit("")),
            "_read": specs.sizes(F.col("_title")),
        }
    ).withColumns({"_cap": specs.storage_of(F.col("_read")), "_ram": specs.ram_of(F.col("_read"))})
    filled = lambda c: F.coalesce(value(c), F.lit("")) != ""
    both = lambda a, b: filled(a) & filled(b)
    gtin_same = norm("t_gtin") == norm("gtin")
    store_same = norm("t_store_sku") == norm("sku")
    maker_same = norm("t_manufacturer_sku") == norm("sku")

    p = p.withColumn("_decisive", decisive_words(F.col("_mt")))
    decisive = F.col("_decisive")
    lost = decisive_lost(decisive, F.col("_tt"), F.col("_ct"))
    matched = F.size(F.array_intersect("_mt", "_tt"))
    compact_model = F.replace(F.col("_model"), F.lit(" "), F.lit(""))
    model_part = (
        F.when(F.col("_model") == "", 0.0)
        .when((matched == F.size("_mt")) & (matched > 0), 48.0)
        .when(matched > 0, 15.0 * (matched / F.size("_mt")))
        .when((compact_model != "") & F.col("_ct").contains(compact_model), 40.0)
        .otherwise(-45.0)
    )
    shared = F.size(F.array_intersect("_nt", "_tt"))
    union = F.size(F.array_union("_nt", "_tt"))
    comparable = (F.size("_nt") > 0) & (F.size("_tt") > 0)

    storage, ram = value("t_storage_gb", "double"), value("t_ram_gb", "double")
    storage_hit = _contains_number(F.col("_cap"), storage)
    implied = F.filter("_cap", lambda v: (F.abs(v - storage) >= 0.01) & (v <= 64))
    ram_seen = F.when(
        (F.size("_ram") == 0) & ram.isNotNull() & F.coalesce(storage_hit, F.lit(False)), implied
    ).otherwise(F.col("_ram"))
    ram_hit = _contains_number(ram_seen, ram)

    colors = lambda words: F.filter(words, lambda w: w.isin(*COLOR_WORDS))
    color = F.col("_color")
    title_colors, target_colors = colors("_tt"), colors(text.tokens(color))
    color_clash = (F.size(title_colors) > 0) & (F.size(target_colors) > 0) & ~F.arrays_overlap(title_colors, target_colors)

    conflict = (
        (both("t_gtin", "gtin") & ~gtin_same)
        | (both("t_store_sku", "sku") & ~store_same)
        | ((F.col("_model") != "") & (F.size(decisive) > 0) & lost)
        | F.coalesce(~storage_hit, F.lit(False))
        | F.coalesce(~ram_hit, F.lit(False))
        | ((color != "") & color_clash)
    )
    brand = F.col("_brand")
    score = (
        F.when(both("t_gtin", "gtin") & gtin_same, 100.0).otherwise(0.0)
        + F.when(both("t_store_sku", "sku") & store_same, 80.0)
        .when(~both("t_store_sku", "sku") & both("t_manufacturer_sku", "sku") & maker_same, 80.0)
        .otherwise(0.0)
        + F.when(brand == "", 0.0).when(F.col("_title").contains(brand), 12.0).otherwise(-8.0)
        + model_part
        + F.when(comparable, 25.0 * (shared / union)).otherwise(0.0)
        + F.when(F.coalesce(storage_hit, F.lit(False)), 18.0).otherwise(0.0)
        + F.when(F.coalesce(ram_hit, F.lit(False)), 16.0).otherwise(0.0)
        + F.when((color != "") & F.col("_title").contains(color), 6.0).otherwise(0.0)
        + F.when(value("price", "double").isNotNull(), 3.0).otherwise(0.0)
        + F.when(F.coalesce(value("url"), value("normalized_url"), F.lit("")) != "", 2.0).otherwise(0.0)
    )
    p = p.withColumns({"_conflict": conflict, "_score": score})
    if ratios:
        # Only pairs without a conflict reach the Python workers.
        p = p.withColumn("_known", F.when(~F.col("_conflict"), F.nullif(norm("t_title_as_seen"), F.lit(""))))
        p = p.withColumn("_named", F.when(~F.col("_conflict") & comparable, F.col("_name")))
        p = p.withColumns(
            {"_r1": sequence_ratio("_named", "_title"), "_r2": sequence_ratio("_known", "_title")}
        )
        p = p.withColumn(
            "_score", F.col("_score") + 10 * F.coalesce("_r1", F.lit(0.0)) + 12 * F.coalesce("_r2", F.lit(0.0))
        )
    final = (
        F.when(F.col("_title") == "", -100.0).when(F.col("_conflict"), rules.conflict).otherwise(F.round("_score", 3))
    )
    return p.withColumn("score", final).drop(*[c for c in p.columns if c.startswith("_") and c not in have])


def same_offer(a: Column, b: Column, ratio: Column) -> Column:
    """Two candidates that are one offer: same page, no conflicting price or code, near-equal titles."""
    page = urls.page_url(a["url"]) == urls.page_url(b["url"])
    price_clash = F.coalesce(F.abs(a["price"] - b["price"]) >= 0.01, F.lit(False))

    def code_clash(name: str) -> Column:
        x, y = text.normalized_text(a[name]), text.normalized_text(b[name])
        return (x != "") & (y != "") & (x != y)

    x, y = text.normalized_text(a["title"]), text.normalized_text(b["title"])
    titles = (x != "") & (y != "") & (x.contains(y) | y.contains(x) | (F.coalesce(ratio, F.lit(0.0)) >= 0.90))
    return F.coalesce(page, F.lit(False)) & ~price_clash & ~code_clash("gtin") & ~code_clash("sku") & titles


def choose_best(scored: DataFrame, target: str = "mapping_id", rules: MatchRules = MATCHING) -> DataFrame:
    """Winner per target; none when a rival within the margin is a different offer.

    ``scored`` has title, url, price, sku, gtin and score.  The best row is an
    aggregate; rivals are compared with it row by row, never with each other.
    """
    distinct = scored.withColumn("_t", text.normalized_text(F.col("title"))).dropDuplicates([target, "_t", "url", "price"])
    valid = distinct.filter(F.col("score") > rules.conflict).drop("_t")
    row = F.struct("title", "url", "price", "sku", "gtin", "score")
    best = valid.groupBy(target).agg(
        F.max_by(row, F.struct("score", F.coalesce("url", F.lit("")), "title")).alias("best")
    )
    rivals = valid.join(best, target).filter(F.col("best.score") - F.col("score") < rules.margin)
    rivals = rivals.withColumn(
        "_ratio", sequence_ratio(text.normalized_text(F.col("best.title")), text.normalized_text(F.col("title")))
    ).withColumn("_row", row)
    is_best = rivals["_row"].eqNullSafe(rivals["best"])
    other = rivals.select(
        target, (~is_best & ~same_offer(F.col("best"), F.col("_row"), F.col("_ratio"))).alias("_other")
    )
    ambiguous = other.groupBy(target).agg(F.bool_or("_other").alias("ambiguous"))
    return best.join(ambiguous, target).select(
        target, F.when(~F.col("ambiguous"), F.col("best")).alias("winner"), F.col("best.score").alias("score"), "ambiguous"
    )


def decide_match(scored: DataFrame, rules: MatchRules = MATCHING) -> DataFrame:
    """auto_matched, needs_review or pending_match from best and runner-up scores."""
    lead = F.col("best_score") - F.coalesce("runner_up_score", F.lit(rules.conflict * 10))
    decision = (
        F.when((F.col("best_score") >= rules.automatic) & (lead >= rules.margin), "auto_matched")
        .when(F.col("best_score") >= rules.review, "needs_review")
        .otherwise("pending_match")
    )
    return scored.withColumn("decision", decision)


def match_contained(items: DataFrame, keys: DataFrame, kind: str = "sku", idle: DataFrame | None = None) -> DataFrame:
    """``(item_id, key, variant_id)`` for every known code inside an item's text."""
    known = keys.filter(F.col("kind") == kind)
    return codes_in_text(items, known, idle).join(known.select("key", "variant_id"), "key")


# --- identity clusters -------------------------------------------------------------------


def build_clusters(obs: DataFrame, floor: float = 10.0) -> DataFrame:
    """One row per identity with its evidence, status and best attributes.

    Observations that change identity need no special care: clusters are
    recomputed from the observations.
    """
    order = F.struct("last_seen_at", "item_id")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    stats = obs.groupBy("identity_key").agg(
        F.max("strength").alias("identity_strength"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.count_if(F.col("price") >= floor).alias("priced_evidence_count"),
        F.count_if("publishable").alias("publishable_count"),
        F.max_by("title", F.struct(F.length("title"), F.col("title"))).alias("canonical_title"),
        first("brand"),
        first("sku"),
        first("gtin"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    stores = obs.groupBy("identity_key", "store_id").agg(F.bool_or("publishable").alias("p")).groupBy("identity_key").agg(
        F.count(F.lit(1)).alias("evidence_store_count"), F.count_if("p").alias("publishable_store_count")
    )
    rows = stats.join(stores, "identity_key")
    status = (
        F.when((F.col("identity_strength") >= 90) & (F.col("publishable_store_count") >= 2), "cross_store_verified")
        .when(F.col("publishable_count") >= 1, "source_verified")
        .otherwise("candidate")
    )
    return rows.withColumns({"entity_id": ids.entity_id(F.col("identity_key")), "status": status})


def resolve_clusters(clusters: DataFrame, variants: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """Variant of each cluster: promoted earlier, unique trade number, unique brand and code, else a new id."""
    keys = variant_keys(variants)
    by_gtin = unique_keys(keys, "gtin").select(F.col("key").alias("_gtin"), F.col("variant_id").alias("_v_gtin"))
    known = matchable(variants).select(
        F.concat_ws("|", text.compact_key(F.col("brand")), text.compact_key(F.col("manufacturer_sku"))).alias("_maker"),
        "variant_id",
    )
    by_maker = known.groupBy("_maker").agg(F.min("variant_id").alias("_v_maker"), F.max("variant_id").alias("_m"))
    by_maker = by_maker.filter(F.col("_v_maker") == F.col("_m")).drop("_m")
    maker = F.concat_ws("|", text.compact_key(F.col("brand")), text.compact_key(F.col("sku")))
    rows = clusters.withColumns(
        {
            "_gtin": ids.valid_gtin(F.col("gtin")),
            "_maker": F.when(F.col("brand").isNotNull() & (F.length(text.compact_key(F.col("sku"))) >= 4), maker),
        }
    )
    rows = rows.join(by_gtin, "_gtin", "left").join(by_maker, "_maker", "left")
    chosen = [F.col("_v_gtin").cast("string"), F.col("_v_maker").cast("string")]
    if promoted is not None:
        rows = rows.join(promoted.select("entity_id", F.col("variant_id").alias("_v_old")), "entity_id", "left")
        chosen.insert(0, F.col("_v_old").cast("string"))
    fresh = F.when(F.col("publishable_count") >= 1, F.concat(F.lit("VAR-"), F.substring("entity_id", 5, 20)))
    resolved = F.coalesce(*chosen, fresh)
    method = F.when(F.col("_v_gtin").isNotNull(), "gtin").when(F.col("_v_maker").isNotNull(), "brand_sku")
    method = method.when(fresh.isNotNull(), "new").otherwise("unresolved")
    if promoted is not None:
        method = F.when(F.col("_v_old").isNotNull(), "promoted").otherwise(method)
    drop = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumns({"resolved_variant_id": resolved, "resolution": method}).drop(*drop)


def promote_provisional(sightings: DataFrame, min_stores: int = MATCHING.provisional_min_stores) -> DataFrame:
    """Provisional products seen in at least ``min_stores`` stores."""
    stores = sightings.groupBy("variant_id").agg(F.count_distinct("store_id").alias("store_count"))
    return stores.filter(F.col("store_count") >= min_stores)


def promote_mappings(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Listing of every match: the active one of (variant, store), else a deterministic new id."""
    active = earliest_per(listings.filter("active").select("variant_id", "store_id", "mapping_id"), ["variant_id", "store_id"], ["mapping_id"])
    rows = matches.join(active, ["variant_id", "store_id"], "left")
    fresh = ids.stable_id("MAP", F.col("variant_id").cast("string"), F.col("store_id").cast("string"), F.col("normalized_url"))
    return rows.withColumns(
        {
            "action": F.when(F.col("mapping_id").isNull(), "mapping_created").otherwise("mapping_repaired"),
            "mapping_id": F.coalesce("mapping_id", fresh),
        }
    )


def url_conflicts(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Matches whose (store, url) already belongs to another variant."""
    owners = listings.filter("active").select("store_id", F.col("source_url").alias("normalized_url"), F.col("variant_id").alias("owner"))
    clash = matches.join(owners, ["store_id", "normalized_url"]).filter(F.col("owner") != F.col("variant_id"))
    return clash.groupBy("store_id", "normalized_url", "variant_id").agg(F.count_distinct("owner").alias("owner_count"), F.min("owner").alias("first_owner"))


def import_summary(items: DataFrame, run: str = "import_id") -> DataFrame:
    """Outcome counters and status of every import run."""
    is_in = lambda *names: F.col("validation_status").isin(*names)
    counts = items.groupBy(run).agg(
        F.count(F.lit(1)).alias("rows_received"),
        F.count_if(~is_in("rejected")).alias("rows_accepted"),
        F.count_if(is_in("rejected")).alias("rows_rejected"),
        F.count_if(is_in("mapping_created", "mapping_repaired")).alias("rows_matched"),
        F.count_if(is_in("mapping_created")).alias("mappings_created"),
        F.count_if(is_in("mapping_repaired")).alias("mappings_repaired"),
        F.count_if(F.col("observed_price").isNotNull()).alias("prices_observed"),
        F.count_if(is_in("pending_match", "url_variant_conflict")).alias("review_count"),
    )
    status = F.when(F.col("review_count") > 0, "completed_with_review").otherwise("completed")
    return counts.withColumn("status", status)


# What a candidate says of its product; a change of any asks for a new decision.
RECONCILED = ("normalized_url", "title", "brand", "sku", "gtin", "currency", "observed_price", "availability")


def merge_candidates(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored candidates with those of a new scan: unknown ones start at version 0, changed ones go back to it, equal ones keep their decision.

    Both have candidate_id, ``last_seen_at`` and the ``RECONCILED`` columns, the
    stored ones also match_version and checked_at.  Of several rows of a scan
    with one id the latest counts.
    """
    values = lambda: F.struct(*RECONCILED)
    newest = seen.groupBy("candidate_id").agg(F.max_by(F.struct(values().alias("said"), "last_seen_at"), F.struct("last_seen_at", values())).alias("new"))
    old = stored.select("candidate_id", F.struct(values().alias("said"), "last_seen_at", "match_version", "checked_at").alias("old"))
    both = old.join(newest, "candidate_id", "full")
    changed = F.col("new").isNotNull() & ~F.col("new.said").eqNullSafe(F.col("old.said"))
    now = F.coalesce("new", F.struct("old.said", "old.last_seen_at"))
    return both.select(
        "candidate_id", now["said"].alias("said"), now["last_seen_at"].alias("last_seen_at"),
        F.when(changed, 0).otherwise(F.coalesce("old.match_version", F.lit(0))).alias("match_version"), F.when(~changed, F.col("old.checked_at")).alias("checked_at"),
    ).select("candidate_id", "said.*", "last_seen_at", "match_version", "checked_at")


def due_for_reconcile(candidates: DataFrame, version: int, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """Candidates matched under an older rule version, after a cursor, in id order."""
    due = candidates.filter(F.coalesce("match_version", F.lit(0)) < version)
    if cursor is not None:
        due = due.filter(F.col("candidate_id") > F.lit(cursor))
    return due if limit is None else due.orderBy("candidate_id").limit(limit)


def hydration_queue(candidates: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Per store: unseen URLs first, then the oldest links without product data; at most ``k``."""
    past = known.select("store_id", "normalized_url", "observed_price", "source_method", "last_seen_at", F.lit(True).alias("_known"))
    rows = candidates.select("store_id", "normalized_url").distinct().join(past, ["store_id", "normalized_url"], "left")
    weak = F.col("observed_price").isNull() | F.coalesce("source_method", F.lit("")).startswith("sitemap")
    rows = rows.withColumn("tier", F.when(F.col("_known").isNull(), 0).when(weak, 1).otherwise(2)).filter(F.col("tier") < 2)
    return top_per(rows, ["store_id"], ["tier", F.col("last_seen_at").asc_nulls_first(), "normalized_url"], k, "position").select(
        "store_id", "normalized_url", "tier", "position"
    )


# Wording of trusted presence rows and of specifications that must be visible in the URL.
TRUSTED_CONFIDENCE = ("high", "عالية")
READY_REVIEW = ("ready", "جاهز لأول رصد")
FEED_LINK = ("product_feed", "تغذية منتجات")
DIRECT_LINK = ("direct_product", "رابط منتج مباشر")
EVIDENCE_SPECS = r"(?i)اللون|السعة|ram|الذاكرة|الحمولة|مقاس|الحجم"


def verified_presence(presence: DataFrame, products: DataFrame) -> DataFrame:
    """Presence rows proven by a product feed, or by brand, model and key specs in a direct URL.

    ``products`` has variant_id, brand, model and ``specs`` (map); ``presence`` has match_confidence,
    review_status, link_type and source_url.
    """
    rows = presence.join(products.select("variant_id", "brand", "model", "specs"), "variant_id")
    seen = text.evidence_tokens(F.col("source_url"))

    def proven(c: Column) -> Column:
        wanted = text.evidence_tokens(c)
        return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.col("_seen"))) == 0)

    rows = rows.withColumn("_seen", seen)
    key_specs = F.map_filter("specs", lambda k, _: k.rlike(EVIDENCE_SPECS))
    all_specs = F.forall(F.map_values(key_specs), proven)
    trusted = F.col("match_confidence").isin(*TRUSTED_CONFIDENCE) & F.col("review_status").isin(*READY_REVIEW)
    direct = F.col("link_type").isin(*DIRECT_LINK) & proven(F.col("brand")) & proven(F.col("model")) & F.coalesce(all_specs, F.lit(True))
    return rows.filter(trusted & (F.col("link_type").isin(*FEED_LINK) | direct)).drop("_seen")
