"""Catalog dimensions, mined synonyms, and sets over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def catalog_brands(catalog: DataFrame) -> DataFrame:
    """Distinct trimmed brands with their length; sort by it, descending, to prefer longer names."""
    return catalog.select(F.trim("brand").alias("brand")).where("brand != ''").distinct().withColumn("length", F.length("brand"))


def brand_categories(catalog: DataFrame) -> DataFrame:
    return catalog.where("trim(brand) != ''").groupBy(F.trim("brand").alias("brand")).agg(F.sort_array(F.collect_set("category")).alias("categories"))


def category_pairs(catalog: DataFrame) -> DataFrame:
    return catalog.where("category is not null and sub_category is not null").select("category", "sub_category").distinct()


def synonym_candidates(texts_of: DataFrame, terms: DataFrame, limit: int, curated: DataFrame | None = None, texts: int | None = 20) -> DataFrame:
    """Candidates (trigger, term, score, in_catalog): 3 for a curated pair, 2 for being among the 2 * limit words that most often come with the trigger.

    texts_of: product_id, text; terms: trigger. `texts` bounds how many
    matching texts per trigger are looked at, in id order; None: all. A trigger
    that is no word of any text looks at those that share a letter with it.
    """
    words = texts_of.select("product_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    hits = words.join(terms.select(F.col("trigger").alias("term")).distinct(), "term").withColumnRenamed("term", "trigger")
    letters = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: F.trim(x) != ""))).alias("letter")
    lone = terms.select("trigger").distinct().join(hits.select("trigger").distinct(), "trigger", "left_anti").select("trigger", letters("trigger"))
    hits = hits.unionByName(texts_of.select("product_id", letters("text")).join(lone, "letter").select("product_id", "trigger").distinct())
    if texts:
        hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("trigger").orderBy("product_id"))).where(F.col("n") <= texts).drop("n")
    near = hits.join(words, "product_id").where("term != trigger").groupBy("trigger", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("trigger").orderBy(F.desc("n"), F.desc("term"))
    votes = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * limit).select("trigger", "term", F.lit(2).alias("vote"))
    if curated is not None:
        votes = votes.unionByName(curated.select("trigger", "term", F.lit(3).alias("vote")))
    known = words.select("term").distinct().withColumn("known", F.lit(True))
    scored = votes.groupBy("trigger", "term").agg(F.sum("vote").alias("score")).join(known, "term", "left")
    return scored.select("trigger", "term", "score", F.coalesce("known", F.lit(False)).alias("in_catalog"))


def ordered_union(*arrays: Column | str) -> Column:
    """First occurrences in order."""
    return F.array_distinct(F.concat(*arrays))


def ordered_difference(left: Column | str, right: Column | str) -> Column:
    """What of `left` is not in `right`, whatever its case."""
    low = F.transform(right, lambda x: F.lower(x))
    return F.filter(left, lambda x: ~F.array_contains(low, F.lower(x)))
