"""Joins: origins, aliases, prices and rates, users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEMO = "AI-gen (demo)"


def enrich_hits(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hits with their product; unknown ids go."""
    return hits.join(catalog, "product_id")


def match_filters(filters: DataFrame, catalog: DataFrame, slices: int = 256) -> DataFrame:
    """(query_id, product_id) of every filter row (query_id, want_category, price_min, price_max) against the catalog.

    Filters with a category join on it. Those without one join on slices of the
    catalog's price range, so that a filter meets the products of its own slices only; a
    product without a price is in the first slice, for filters without bounds.
    """
    inside = (F.col("price_min").isNull() | (F.col("base_price") >= F.col("price_min"))) & (F.col("price_max").isNull() | (F.col("base_price") <= F.col("price_max")))
    some, free = filters.where("want_category is not null"), filters.where("want_category is null")
    keyed = some.join(catalog.withColumnRenamed("category", "want_category"), "want_category").where(inside)
    span = catalog.agg(F.min("base_price").alias("_low"), F.greatest(F.max("base_price") - F.min("base_price"), F.lit(1e-9)).alias("_width"))

    def slice_of(price: Column, missing: int) -> Column:
        at = F.floor((price - F.col("_low")) / F.col("_width") * slices)
        return F.least(F.greatest(F.coalesce(at, F.lit(missing)), F.lit(0)), F.lit(slices - 1)).cast("int")

    low, high = slice_of(F.col("price_min"), 0), slice_of(F.col("price_max"), slices - 1)
    span = F.broadcast(span)  # one row
    left = free.crossJoin(span).where(low <= high).withColumn("_slice", F.explode(F.sequence(low, high)))
    right = catalog.crossJoin(span).select("product_id", "base_price", slice_of(F.col("base_price"), 0).alias("_slice"))
    ranged = left.join(right, "_slice").where(inside)
    return keyed.select("query_id", "product_id").unionByName(ranged.select("query_id", "product_id"))


def containing(wholes: DataFrame, parts: DataFrame) -> DataFrame:
    """(whole, part) of all distinct strings where one holds the other. They meet on the part's first three letters (or all it has), which must be among the whole's."""
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("whole") - n + 1, F.lit(1))), lambda i: F.substring(F.col("whole"), i, F.lit(n)))
    keyed = parts.where("part != ''").select("part").distinct().withColumn("key", F.substring("part", 1, 3))
    held = wholes.where("whole != ''").select("whole").distinct().withColumn("key", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))))
    return held.join(keyed, "key").where(F.contains("whole", "part")).select("whole", "part")


def brand_origin(brands: DataFrame, origins: DataFrame) -> DataFrame:
    """(brand, country) of distinct brands: exact key of the origin table (known, country, ordinal), else the first known brand that contains or is contained in it."""
    keys = brands.where("brand is not null").select("brand", F.lower(F.trim("brand")).alias("key")).where("key != ''").distinct()
    exact = keys.join(origins.select(F.col("known").alias("key"), "country", "ordinal"), "key").groupBy("brand").agg(F.min_by("country", "ordinal").alias("country"))
    rest = keys.join(exact, "brand", "left_anti")
    keys, known = rest.select(F.col("key").alias("whole")), origins.select(F.col("known").alias("whole"))
    within = containing(keys, known.withColumnRenamed("whole", "part")).toDF("key", "known").unionByName(containing(known, keys.withColumnRenamed("whole", "part")).toDF("known", "key"))
    loose = rest.join(within, "key").join(origins, "known").groupBy("brand").agg(F.min_by("country", "ordinal").alias("country"))
    return exact.unionByName(loose)


def product_origin(products: DataFrame, origins: DataFrame) -> DataFrame:
    """Adds origin: an explicit two-letter country wins; for demo rows the brand's origin comes first; else the brand's origin."""
    known = brand_origin(products, origins).withColumnRenamed("country", "of_brand")
    given = F.upper(F.trim(F.coalesce("origin_country", F.lit(""))))
    explicit = F.when(F.length(given) == 2, given)
    chosen = F.when(F.col("source_platform").eqNullSafe(DEMO), F.coalesce("of_brand", explicit)).otherwise(F.coalesce(explicit, F.col("of_brand")))
    return products.join(known, "brand", "left").withColumn("origin", chosen).drop("of_brand")


def expand_aliases(brands: DataFrame, clusters: DataFrame) -> DataFrame:
    """(brand, aliases): the alias cluster (cluster_id, alias) of each part of a composite brand name, else the part itself; sorted."""
    parts = brands.select("brand", F.explode(F.filter(F.transform(F.split(F.lower(F.col("brand")), "[/|,、]"), lambda x: F.trim(x)), lambda x: x != "")).alias("alias"))
    found = parts.join(clusters, "alias", "left").groupBy("brand", "alias").agg(F.min("cluster_id").alias("cluster_id"))
    wide = found.join(clusters.withColumnRenamed("alias", "other"), "cluster_id", "left")
    return wide.groupBy("brand").agg(F.array_sort(F.collect_set(F.coalesce("other", "alias"))).alias("aliases"))


def distinct_brand_groups(brands: Column) -> Column:
    """Number of real brands in an array of alias arrays: each joins the first group that it overlaps."""
    empty = F.array().cast("array<array<string>>")

    def merge(groups: Column, own: Column) -> Column:
        hit = F.exists(groups, lambda g: F.arrays_overlap(g, own))
        return F.when(hit, F.transform(groups, lambda g: F.when(F.arrays_overlap(g, own), F.array_union(g, own)).otherwise(g))).otherwise(F.concat(groups, F.array(own)))

    return F.size(F.aggregate(brands, empty, merge))


def convert_prices(catalog: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds price_cny (decimal, two places): CNY as it is, other currencies by rates (currency, rate); null without a rate. SKU prices likewise, where there are skus."""
    money = lambda c, rate: (c.cast("decimal(18,6)") * rate.cast("decimal(18,6)")).cast("decimal(18,2)")
    out = catalog.withColumn("currency", F.upper(F.coalesce("currency", F.lit("CNY")))).join(rates.select("currency", "rate"), "currency", "left")
    rate = F.when(F.col("currency") == "CNY", F.lit(1.0)).otherwise(F.col("rate"))
    out = out.withColumn("price_cny", money(F.col("base_price"), rate))
    if "skus" in catalog.columns:
        out = out.withColumn("skus", F.transform("skus", lambda s: s.withField("price_cny", money(s["price"], rate))))
    return out


def rate_asof(events: DataFrame, quotes: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Each event (ts, currency) with the latest quote not after it: rate, stale (older than ttl). CNY is 1; no quote is null.

    Events and quotes meet per currency and hour. The last quote of each hour is carried
    over to later hours in a table of a row per currency and hour, the only one that a window takes by currency alone.
    """
    slot = lambda at: F.date_trunc("hour", F.col(at))
    quote = F.struct(F.col("quoted_at").alias("at"), F.col("rate").alias("rate"))
    said = quotes.groupBy("currency", "quoted_at").agg(F.max("rate").alias("rate")).select("currency", slot("quoted_at").alias("_slot"), F.col("quoted_at").alias("ts"), F.lit(0).alias("_kind"), quote.alias("_quote"))
    both = events.withColumn("_slot", slot("ts")).withColumn("_kind", F.lit(1)).unionByName(said, allowMissingColumns=True)
    hour = Window.partitionBy("currency", "_slot").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("currency").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("currency", "_slot").agg(F.max("_quote").alias("_end")).select("currency", "_slot", F.last("_end", True).over(before).alias("_carried"))
    seen = both.withColumn("_inside", F.last("_quote", True).over(hour)).where("_kind = 1").join(ends, ["currency", "_slot"], "left")
    got, home = F.coalesce("_inside", "_carried"), F.col("currency") == "CNY"
    out = seen.withColumn("rate", F.when(home, 1.0).otherwise(got["rate"])).withColumn("stale", F.when(home, False).otherwise(F.unix_timestamp("ts") - F.unix_timestamp(got["at"]) > ttl_seconds))
    return out.select(*events.columns, "rate", "stale")


def rekey_users(table: DataFrame, mapping: DataFrame, unique: list[str]) -> DataFrame:
    """Anonymous ids become account ids (mapping: old_id, new_id). If a user's rows would collide on `unique` with rows of the account, none of that user's rows moves."""
    pairs = mapping.where("old_id is not null and new_id is not null and old_id != new_id and old_id != '' and new_id != ''").groupBy("old_id").agg(F.max("new_id").alias("new_id"))
    if unique:
        moved = table.join(pairs, table["user_id"] == pairs["old_id"]).select("old_id", F.col("new_id").alias("user_id"), *unique)
        clash = moved.join(table.select("user_id", *unique).distinct(), ["user_id", *unique], "left_semi").select("old_id")
        twice = moved.groupBy("user_id", *unique).agg(F.count_distinct("old_id").alias("n"), F.collect_set("old_id").alias("olds")).where("n > 1").select(F.explode("olds").alias("old_id"))
        pairs = pairs.join(clash.unionByName(twice).distinct(), "old_id", "left_anti")
    return table.join(pairs, table["user_id"] == pairs["old_id"], "left").withColumn("user_id", F.coalesce("new_id", "user_id")).drop("old_id", "new_id")


def purge_users(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows left, counts of purged rows per user)."""
    gone = table.join(ids.select("user_id"), "user_id", "left_semi")
    return table.join(ids.select("user_id"), "user_id", "left_anti"), gone.groupBy("user_id").agg(F.count("*").alias("purged"))
