"""Catalog documents: chunks, search texts, labels and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def chunks(catalog: DataFrame) -> DataFrame:
    """One row per description, FAQ entry with a question or an answer, and review with content; ids count per product and kind."""
    k = F.col("rag_knowledge")
    text_of = lambda c: F.coalesce(c, F.lit(""))
    desc = F.when(~blank(k["marketing_description"]), F.array(F.struct(F.trim(k["marketing_description"]).alias("text"), F.lit(None).cast("int").alias("rating"))))
    faq = F.transform(F.filter(k["official_faq"], lambda f: ~blank(f["question"]) | ~blank(f["answer"])), lambda f: F.struct(F.concat(F.lit("问："), text_of(f["question"]), F.lit("\n答："), text_of(f["answer"])).alias("text"), F.lit(None).cast("int").alias("rating")))
    review = F.transform(F.filter(k["user_reviews"], lambda r: ~blank(r["content"])), lambda r: F.struct(F.concat(F.lit("评分 "), r["rating"].cast("string"), F.lit("/5："), r["content"]).alias("text"), r["rating"].alias("rating")))
    none = F.array().cast("array<struct<text:string,rating:int>>")
    parts = F.array(*(F.struct(F.lit(n).alias("chunk_type"), F.coalesce(a, none).alias("own")) for n, a in (("desc", desc), ("faq", faq), ("review", review))))
    out = catalog.select("*", F.explode(parts).alias("_p")).select("*", F.posexplode("_p.own").alias("_i", "_c"))
    return out.select(
        F.concat_ws("::", F.col("product_id").cast("string"), "_p.chunk_type", F.col("_i").cast("string")).alias("chunk_id"), "product_id", F.col("_p.chunk_type").alias("chunk_type"), F.col("_c.text").alias("text"),
        "category", "sub_category", "brand", "base_price", F.coalesce("currency", F.lit("CNY")).alias("currency"), F.col("_c.rating").alias("rating"),
    )


def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def search_text(description: str = "description") -> Column:
    return joined(F.col("title"), F.col("brand"), F.col("category"), F.col("sub_category"), F.substring(description, 1, 400))


def rerank_text(description: str = "description") -> Column:
    return joined(F.col("title"), F.col("brand"), F.substring(description, 1, 240))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def price_label() -> Column:
    """CNY price, with the original price and rate date when converted; else the raw price, marked unavailable."""
    cny = F.concat(F.lit("¥"), money("price_cny"))
    return (
        F.when(F.upper("currency") == "CNY", cny)
        .when(F.col("price_cny").isNotNull(), F.concat(cny, F.lit(" (原价 "), F.col("currency"), F.lit(" "), money("base_price"), F.lit("; 参考汇率日期 "), F.col("rate_date"), F.lit(")")))
        .otherwise(F.concat(F.col("currency"), F.lit(" "), money("base_price"), F.lit(" (unavailable)")))
    )


def context_line() -> Column:
    return F.concat(F.lit("- "), F.concat_ws(" | ", F.col("product_id").cast("string"), "title", "brand", price_label(), F.substring("description", 1, 120)))


def product_card(catalog: DataFrame) -> DataFrame:
    """Card projection: local images percent-encoded per path part, else an external http(s) address, else null; origin defaults."""
    parts = F.transform(F.split("image_path", "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    local = F.when(~blank("image_path"), F.concat(F.lit("/images/"), F.array_join(parts, "/")))
    external = F.when(F.col("image_url_external").rlike("^https?://"), F.col("image_url_external"))
    return catalog.withColumn("image_url", F.coalesce(local, external)).withColumn("origin_country", F.coalesce("origin_country", F.lit("CN")))
