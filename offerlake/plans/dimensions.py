"""The catalogue as dimension tables: category tree with its closure, brands, families, products, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text
from offerlake.functions.ids import stable_id
from offerlake.functions.numbers import key_text

# Names that stand for a missing section or brand, and the described attributes with type and unit.
UNCLASSIFIED = "غير مصنف"
UNKNOWN_BRAND = "غير محدد"
ATTRIBUTES = (("ram_gb", "number", "GB"), ("storage_gb", "number", "GB"), ("color", "text", None))


def described(rows: DataFrame) -> DataFrame:
    """Catalogue rows with defaults and with the ids of the dimensions they belong to."""
    given = lambda c, other: F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), other))
    out = rows.withColumn("section", given("section", F.lit(UNCLASSIFIED)))
    out = out.withColumns(
        {"product_type": given("product_type", F.col("section")), "brand": given("brand", F.lit(UNKNOWN_BRAND)), "model": given("model", F.col("canonical_name"))}
    )
    out = out.withColumns(
        {
            "root_id": stable_id("CAT", F.lit("root"), F.col("section"), length=16),
            "category_id": stable_id("CAT", F.lit("leaf"), F.col("section"), F.col("product_type"), length=16),
            "brand_id": stable_id("BRD", F.col("brand"), length=16),
            "family": text.family_name(F.col("model"), F.col("product_type")),
        }
    )
    return out.withColumns(
        {
            "family_id": stable_id("FAM", F.col("category_id"), F.col("brand_id"), F.col("family"), length=18),
            "product_key": stable_id("PRD", F.col("category_id"), F.col("brand_id"), F.col("model"), length=18),
        }
    )


def _last(rows: DataFrame, key: str, *columns: Column) -> DataFrame:
    """One row per key: the spelling of the row with the largest variant id."""
    best = F.max_by(F.struct(*columns), "variant_id").alias("_row")
    return rows.groupBy(key).agg(best).select(key, "_row.*")


def categories(rows: DataFrame) -> DataFrame:
    """Sections as roots, types under them; a type named like its section is a root of its own."""
    split = F.col("product_type") != F.col("section")
    roots = _last(rows.withColumn("_id", F.col("root_id")), "_id", F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("section:"), key_text(F.col("section"))).alias("source_key"), F.col("section").alias("name"), F.lit(1).alias("level"))
    source = F.concat_ws(":", F.lit("type"), key_text(F.col("section")), key_text(F.col("product_type"))).alias("source_key")
    leaves = _last(rows.withColumn("_id", F.col("category_id")), "_id", F.when(split, F.col("root_id")).alias("parent_id"), source, F.col("product_type").alias("name"), F.when(split, 2).otherwise(1).alias("level"))
    return roots.unionByName(leaves).withColumnRenamed("_id", "category_id")


def closure(tree: DataFrame) -> DataFrame:
    """``(ancestor_id, category_id, distance)`` of a category tree of any depth, each category with itself included.

    ``tree`` is ``(category_id, parent_id)``; a category whose parent is unknown is
    a root.  A cycle ends in Spark's recursion limit, an error.
    """
    return tree.sparkSession.sql(
        """
        WITH RECURSIVE up(ancestor_id, category_id, distance) AS (
          SELECT category_id, category_id, 0 FROM {tree}
          UNION ALL SELECT t.parent_id, up.category_id, up.distance + 1 FROM up JOIN {tree} t ON t.category_id = up.ancestor_id
          WHERE t.parent_id IS NOT NULL)
        SELECT ancestor_id, category_id, distance FROM up
        """,
        tree=tree,
    )


def brands(rows: DataFrame) -> DataFrame:
    return _last(rows, "brand_id", F.col("brand").alias("name"), key_text(F.col("brand")).alias("normalized_name"))


def families(rows: DataFrame) -> DataFrame:
    return _last(rows, "family_id", F.col("category_id"), F.col("brand_id"), F.col("family").alias("name"), key_text(F.col("family")).alias("normalized_name"))


def products(rows: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif("source_status", F.lit("")), F.lit("mapped")).alias("source_status")
    named = F.concat_ws(" ", F.nullif("brand", F.lit("")), F.nullif("model", F.lit(""))).alias("name")
    return _last(rows, "product_key", F.col("family_id"), F.col("category_id"), F.col("brand_id"), named, F.col("model"), status)


def attribute_values(rows: DataFrame) -> DataFrame:
    """``(variant_id, attribute_id, code, value_text, value_number, normalized_text, unit)`` of the attributes a variant has."""
    each = []
    for code, kind, unit in ATTRIBUTES:
        value = F.nullif(F.trim(F.col(code).cast("string")), F.lit(""))
        number = value.cast("double") if kind == "number" else F.lit(None).cast("double")
        words = value if kind == "text" else F.lit(None).cast("string")
        each.append(
            F.struct(
                F.lit(code).alias("code"), value.alias("value"), words.alias("value_text"), number.alias("value_number"),
                F.when(words.isNotNull(), key_text(words)).alias("normalized_text"), F.lit(unit).cast("string").alias("unit"),
            )
        )
    flat = rows.select("variant_id", "category_id", F.inline(F.array(*each))).filter("value IS NOT NULL")
    return flat.select("variant_id", stable_id("ATR", F.col("category_id"), F.col("code"), length=18).alias("attribute_id"), "code", "value_text", "value_number", "normalized_text", "unit")
