"""Catalog queries: documents, filters, origins, prices, dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import aggregates as ag
from ..operators import documents as dc
from ..operators import filters as fl
from ..operators import joins as jn
from ..operators import retrieval as rt
from .base import CAT, catalog_view, query, rates, read


def nested(spark, sf_dir):
    """The catalog with nested texts: a description, one question, and a review for two of three products."""
    return catalog_view(spark, sf_dir).withColumn(
        "rag_knowledge",
        F.struct(
            F.col("description").alias("marketing_description"),
            F.array(F.struct(F.concat(F.lit("size of "), "title").alias("question"), F.col("size").cast("string").alias("answer"))).alias("official_faq"),
            F.when(F.col("product_id") % 3 > 0, F.array(F.struct(F.lit("n").alias("nickname"), (F.col("product_id") % 5 + 1).cast("int").alias("rating"), F.concat(F.lit("good "), "sub_category").alias("content")))).alias("user_reviews"),
        ),
    )


CHUNKS = f"""WITH {CAT}, c AS (SELECT *, 'desc' AS chunk_type, 0 AS i, description AS text, NULL AS rating FROM cat UNION ALL
 SELECT *, 'faq', 0, '问：size of ' || title || chr(10) || '答：' || size, NULL FROM cat UNION ALL
 SELECT *, 'review', 0, '评分 ' || (product_id % 5 + 1) || '/5：good ' || sub_category, product_id % 5 + 1 FROM cat WHERE product_id % 3 > 0)"""


@query(CHUNKS + " SELECT product_id, chunk_type, text FROM c")
def b1_chunks(spark, sf_dir):
    return dc.chunks(nested(spark, sf_dir)).select("product_id", "chunk_type", "text")


@query(CHUNKS + " SELECT product_id, chunk_type, category, sub_category, brand, base_price, currency, CAST(rating AS INTEGER) AS rating FROM c")
def b2_chunk_metadata(spark, sf_dir):
    return dc.chunks(nested(spark, sf_dir)).select("product_id", "chunk_type", "category", "sub_category", "brand", "base_price", "currency", "rating")


@query(CHUNKS + " SELECT product_id || '::' || chunk_type || '::' || i AS chunk_id, text FROM c")
def b3_chunk_id(spark, sf_dir):
    return dc.chunks(nested(spark, sf_dir)).select("chunk_id", "text")


@query(f"WITH {CAT} SELECT product_id, concat_ws(' ', title, brand, category, sub_category, substr(description, 1, 400)) AS search_text, concat_ws(' ', title, brand, substr(description, 1, 240)) AS rerank_text FROM cat")
def b4_search_text(spark, sf_dir):
    c = catalog_view(spark, sf_dir)
    return c.select("product_id", dc.search_text().alias("search_text"), dc.rerank_text().alias("rerank_text"))


@query(f"WITH {CAT} SELECT product_id, concat_ws(' ', title, brand, substr(description, 1, 240)) AS rerank_text FROM cat")
def b5_rerank_text(spark, sf_dir):
    return catalog_view(spark, sf_dir).select("product_id", dc.rerank_text().alias("rerank_text"))


PRICED = f"WITH {CAT}, pr AS (SELECT *, CASE currency WHEN 'CNY' THEN CAST(base_price AS DECIMAL(18,2)) WHEN 'USD' THEN CAST(CAST(base_price AS DECIMAL(18,6)) * 7 AS DECIMAL(18,2)) END AS price_cny FROM cat)"
LABEL = "CASE WHEN currency = 'CNY' THEN '¥' || CAST(price_cny AS VARCHAR) WHEN price_cny IS NOT NULL THEN '¥' || CAST(price_cny AS VARCHAR) || ' (原价 ' || currency || ' ' || CAST(CAST(base_price AS DECIMAL(18,2)) AS VARCHAR) || '; 参考汇率日期 2024-01-02)' ELSE currency || ' ' || CAST(CAST(base_price AS DECIMAL(18,2)) AS VARCHAR) || ' (unavailable)' END"


def priced(spark, sf_dir):
    return jn.convert_prices(catalog_view(spark, sf_dir), rates(spark)).withColumn("rate_date", F.lit("2024-01-02"))


@query(PRICED + f" SELECT product_id, '- ' || product_id || ' | ' || title || ' | ' || brand || ' | ' || {LABEL} || ' | ' || substr(description, 1, 120) AS line FROM pr")
def b6_context_line(spark, sf_dir):
    return priced(spark, sf_dir).select("product_id", dc.context_line().alias("line"))


@query(PRICED + f" SELECT product_id, {LABEL} AS label FROM pr")
def b7_price_label(spark, sf_dir):
    return priced(spark, sf_dir).select("product_id", dc.price_label().alias("label"))


@query(PRICED + " SELECT product_id, title, CAST(price_cny AS DOUBLE) AS price_cny, CASE WHEN product_id % 3 = 0 THEN '/images/' || replace(url_encode(title), '+', '%20') || '/a.jpg' WHEN product_id % 3 = 1 THEN 'https://img.example/' || product_id END AS image_url, 'CN' AS origin_country FROM pr")
def b8_product_card(spark, sf_dir):
    c = priced(spark, sf_dir).withColumn("image_path", F.when(F.col("product_id") % 3 == 0, F.concat("title", F.lit("/a.jpg")))).withColumn("image_url_external", F.when(F.col("product_id") % 3 == 1, F.concat(F.lit("https://img.example/"), "product_id")).otherwise("ftp://x")).withColumn("origin_country", F.lit(None).cast("string"))
    return dc.product_card(c).select("product_id", "title", F.col("price_cny").cast("double").alias("price_cny"), "image_url", "origin_country")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first FROM embeddings")
def b10_l2_normalize(spark, sf_dir):
    from ..operators.vectors import l2_normalize

    v = read(spark, sf_dir, "embeddings").select("vec_id", l2_normalize("embedding").alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


FILTERS = """f AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'PROMO' END AS want_category, CASE WHEN s_suppkey % 4 = 0 THEN ['ring', 'bolt'] END AS want_subs,
 CASE WHEN s_suppkey % 5 = 0 THEN ['brand#2', 'BRAND#7'] END AS brand_include, CASE WHEN s_suppkey % 6 = 0 THEN ['Brand#2'] END AS brand_exclude, CASE WHEN s_suppkey % 2 = 0 THEN 910.0 + s_suppkey % 10 END AS price_min, CASE WHEN s_suppkey % 7 > 0 THEN 950.0 + s_suppkey % 10 END AS price_max FROM supplier)"""
FITS = """(want_category IS NULL OR want_subs IS NOT NULL OR category = want_category) AND (want_subs IS NULL OR list_contains(want_subs, sub_category))
 AND (brand_include IS NULL OR list_contains(list_transform(brand_include, lambda x: lower(x)), lower(brand))) AND (brand_exclude IS NULL OR NOT list_contains(list_transform(brand_exclude, lambda x: lower(x)), lower(brand)))"""


def filter_rows(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS query_id", "CASE s_suppkey % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'PROMO' END AS want_category", "CASE WHEN s_suppkey % 4 = 0 THEN array('ring', 'bolt') END AS want_subs", "CASE WHEN s_suppkey % 5 = 0 THEN array('brand#2', 'BRAND#7') END AS brand_include",
        "CASE WHEN s_suppkey % 6 = 0 THEN array('Brand#2') END AS brand_exclude", "CASE WHEN s_suppkey % 2 = 0 THEN double(910 + s_suppkey % 10) END AS price_min", "CASE WHEN s_suppkey % 7 > 0 THEN double(950 + s_suppkey % 10) END AS price_max",
    )


def bought(spark, sf_dir):
    """(query_id, product_id): a supplier as a query, the products it ships as its candidates."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("product_id")).distinct()


BOUGHT = "bo AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS product_id FROM lineitem)"


@query(f"WITH {CAT}, {FILTERS}, {BOUGHT} SELECT query_id, product_id FROM bo JOIN f USING (query_id) JOIN cat USING (product_id) WHERE {FITS} AND (currency != 'CNY' OR ((price_min IS NULL OR base_price >= price_min) AND (price_max IS NULL OR base_price <= price_max)))")
def c1_apply_filters(spark, sf_dir):
    pairs = bought(spark, sf_dir).join(filter_rows(spark, sf_dir), "query_id").join(catalog_view(spark, sf_dir), "product_id")
    return fl.apply_filters(pairs).select("query_id", "product_id")


@query(PRICED + f", {FILTERS}, {BOUGHT} SELECT query_id, product_id FROM bo JOIN f USING (query_id) JOIN pr USING (product_id) WHERE {FITS} AND (price_min IS NULL OR price_cny >= price_min) AND (price_max IS NULL OR price_cny <= price_max)")
def c2_price_gate_strict(spark, sf_dir):
    pairs = bought(spark, sf_dir).join(filter_rows(spark, sf_dir), "query_id").join(priced(spark, sf_dir).withColumn("price_cny", F.col("price_cny").cast("double")), "product_id")
    return fl.apply_filters(pairs, strict=True).select("query_id", "product_id")


ORIGINS = [("brand#1", "JP", 0), ("brand#2", "US", 1), ("brand#25", "DE", 2), ("brand#7 / seven", "CN", 3)]
ORIGIN = """og AS (SELECT * FROM (VALUES ('brand#1', 'JP', 0), ('brand#2', 'US', 1), ('brand#25', 'DE', 2), ('brand#7 / seven', 'CN', 3)) t(known, country, ordinal)),
 bo2 AS (SELECT brand, coalesce((SELECT country FROM og WHERE known = lower(brand)), (SELECT arg_min(country, ordinal) FROM og WHERE contains(lower(brand), known) OR contains(known, lower(brand)))) AS country FROM (SELECT DISTINCT p_brand AS brand FROM part))"""


def origins(spark):
    return spark.createDataFrame(ORIGINS, "known string, country string, ordinal int")


@query(f"WITH {ORIGIN} SELECT brand, country FROM bo2 WHERE country IS NOT NULL")
def d3_brand_origin(spark, sf_dir):
    return jn.brand_origin(catalog_view(spark, sf_dir), origins(spark))


@query(f"WITH {CAT}, {ORIGIN} SELECT product_id, CASE WHEN product_id % 4 = 0 THEN coalesce(country, 'CN') WHEN product_id % 4 = 1 THEN 'FR' ELSE country END AS origin FROM cat LEFT JOIN bo2 USING (brand)")
def d4_product_origin(spark, sf_dir):
    return jn.product_origin(sourced(spark, sf_dir), origins(spark)).select("product_id", "origin")


def sourced(spark, sf_dir):
    c = catalog_view(spark, sf_dir)
    return c.withColumn("origin_country", F.expr("CASE product_id % 4 WHEN 0 THEN 'cn' WHEN 1 THEN ' FR ' WHEN 2 THEN 'China' END")).withColumn("source_platform", F.when(F.col("product_id") % 4 == 0, jn.DEMO))


EXCLUDED = f"""WITH {CAT}, {ORIGIN}, {BOUGHT}, so AS (SELECT cat.*, CASE WHEN product_id % 4 = 0 THEN coalesce(country, 'CN') WHEN product_id % 4 = 1 THEN 'FR' ELSE country END AS origin FROM cat LEFT JOIN bo2 USING (brand)),
 x AS (SELECT query_id, so.* FROM bo JOIN so USING (product_id))"""


@query(EXCLUDED + " SELECT query_id, product_id FROM x WHERE NOT (query_id % 2 = 0 AND (contains(lower(brand), 'brand#1') OR contains(lower(brand), '#7'))) AND NOT (query_id % 3 = 0 AND category = 'PROMO') AND NOT (query_id % 5 = 0 AND contains(lower(title || ' ' || description), 'red')) AND NOT (query_id % 7 = 0 AND origin IS NOT NULL AND origin IN ('JP', 'FR'))")
def c3_apply_exclusions(spark, sf_dir):
    pairs = bought(spark, sf_dir).join(jn.product_origin(sourced(spark, sf_dir), origins(spark)), "product_id").selectExpr(
        "*", "CASE WHEN query_id % 2 = 0 THEN array('Brand#1', '#7') END AS ex_aliases", "CASE WHEN query_id % 3 = 0 THEN array('PROMO') END AS ex_categories", "CASE WHEN query_id % 5 = 0 THEN array('RED') END AS ex_keywords", "CASE WHEN query_id % 7 = 0 THEN array('JP', 'FR') END AS ex_countries"
    )
    return fl.apply_exclusions(pairs).select("query_id", "product_id")


def few(spark, sf_dir, origin=False):
    """Orders as queries with few candidates each, so that some filters would empty a list; with the origins of products only where they are read."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("product_id")).distinct()
    products = sourced(spark, sf_dir)
    return lines.join(jn.product_origin(products, origins(spark)) if origin else products, "product_id")


FEW = EXCLUDED + ", fw AS (SELECT query_id, so.* FROM (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS product_id FROM lineitem) JOIN so USING (product_id))"


@query(FEW + ", k AS (SELECT *, (origin IS NULL OR origin = 'CN') AS ok, bool_or(origin IS NULL OR origin = 'CN') OVER (PARTITION BY query_id) AS any_ok FROM fw) SELECT query_id, product_id FROM k WHERE query_id % 2 = 1 OR ok OR NOT any_ok")
def c4_domestic_only(spark, sf_dir):
    return fl.domestic_only(few(spark, sf_dir, origin=True).withColumn("domestic", F.col("query_id") % 2 == 0)).select("query_id", "product_id")


@query(FEW + ", k AS (SELECT *, NOT contains(lower(brand), 'brand#1') AS ok, bool_or(NOT contains(lower(brand), 'brand#1')) OVER (PARTITION BY query_id) AS any_ok FROM fw) SELECT query_id, product_id FROM k WHERE ok OR NOT any_ok")
def c5_except_brands(spark, sf_dir):
    return fl.except_brands(few(spark, sf_dir).withColumn("except_aliases", F.array(F.lit("Brand#1")))).select("query_id", "product_id")


@query(FEW + ", n AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN ['ring'] WHEN query_id % 3 = 1 THEN ['bolt', 'gear'] ELSE [] END AS named FROM fw), k AS (SELECT *, len(list_filter(named, lambda x: contains(lower(title), x))) > 0 AS ok FROM n), w AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM k) SELECT query_id, product_id FROM w WHERE ok OR NOT any_ok OR len(named) = 0 OR query_id % 9 = 0 OR query_id % 5 = 0")
def c6_product_line(spark, sf_dir):
    pairs = few(spark, sf_dir).withColumn("text", F.expr("CASE query_id % 3 WHEN 0 THEN 'a RING please' WHEN 1 THEN 'bolt or gear' ELSE 'anything' END")).withColumn("comparison", F.col("query_id") % 9 == 0).withColumn("brand_include", F.expr("CASE query_id % 5 WHEN 0 THEN array('Brand#1', 'Brand#2') WHEN 1 THEN array('Brand#1', 'BRAND#1') END"))
    return fl.product_line(pairs, ["ring", "bolt", "gear", "widget"]).select("query_id", "product_id")


@query(f"WITH {FILTERS} SELECT query_id, CAST(CASE WHEN query_id % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_brands, CAST(CASE WHEN want_category = 'SMALL' THEN 1 ELSE 2 END AS INTEGER) AS n_categories FROM f")
def c7_reconcile_exclusions(spark, sf_dir):
    f = filter_rows(spark, sf_dir).selectExpr("query_id", "want_category", "CASE WHEN query_id % 5 = 0 THEN array('nike', 'x') END AS include_aliases", "array(named_struct('brand', 'Nike', 'aliases', array('nike', '耐克')), named_struct('brand', 'Sony', 'aliases', array('sony'))) AS exclude_brands", "array('SMALL', 'LARGE') AS exclude_categories")
    return fl.reconcile_exclusions(f).select("query_id", F.size("exclude_brands").alias("n_brands"), F.size("exclude_categories").alias("n_categories"))


@query(FEW + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS rank FROM fw), h AS (SELECT query_id, max(CASE WHEN query_id % 4 = 0 THEN 1 WHEN query_id % 4 = 1 AND contains(lower(title || ' ' || brand), 'widget') THEN 1 WHEN query_id % 4 = 2 AND (contains(lower(title), 'red') OR contains(lower(title), 'bolt')) THEN 1 ELSE 0 END) AS o FROM r WHERE rank <= 5 GROUP BY 1) SELECT query_id, o = 1 AS overlap FROM h")
def c9_lexical_overlap(spark, sf_dir):
    pairs = few(spark, sf_dir).withColumn("text", F.expr("CASE query_id % 4 WHEN 0 THEN 'at 12 the' WHEN 1 THEN 'the Widget' WHEN 2 THEN 'red or bolt' ELSE '蓝牙耳机' END"))
    return fl.lexical_overlap(rt.top_k(pairs, 5, order=[F.asc("product_id")]))


@query("""WITH r AS (SELECT event_id, user_id % 10 > 0 AS a, event_type IN ('click', 'error') AS b, value > 20 AS c, event_id % 11 > 0 AS d, event_id % 13 BETWEEN 2 AND 10 AS e FROM events)
 SELECT event_id, coalesce(array_to_string(list_filter([CASE WHEN NOT a THEN 'user_id' END, CASE WHEN NOT b THEN 'signal' END, CASE WHEN NOT c THEN 'target_price_cny' END, CASE WHEN NOT d THEN 'cycle_days' END, CASE WHEN NOT e THEN 'target_size' END], lambda x: x IS NOT NULL), ','), '') AS failed FROM r""")
def c10_all_rules(spark, sf_dir):
    """Events judged by all five rules; rejects name the failed columns."""
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 10 > 0, F.concat(F.lit("user_id_"), F.col("user_id").cast("string"))).otherwise("short").alias("user_id"), F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 5 END").alias("signal"),
        (F.col("value") - 20).alias("target_price_cny"), F.when(F.col("event_id") % 11 > 0, F.when(F.col("event_id") % 11 > 5, 30)).otherwise(4000).alias("cycle_days"), (F.col("event_id") % 13).alias("target_size"),
    )
    good, bad = fl.validate_rows(rows)
    return good.select("event_id", F.lit("").alias("failed")).unionByName(bad.select("event_id", F.array_join("failed", ",").alias("failed")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_acctbal <= 0 THEN 'reject' ELSE 'good' END AS verdict FROM customer")
def c10_validate_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "bad id").otherwise(F.col("c_name")).alias("user_id"), F.col("c_acctbal").alias("target_price_cny"), F.lit(None).cast("int").alias("cycle_days"))
    rows = rows.withColumn("user_id", F.regexp_replace("user_id", "#", "_"))
    good, bad = fl.validate_rows(rows)
    return good.select("c_custkey", F.lit("good").alias("verdict")).unionByName(bad.select("c_custkey", F.lit("reject").alias("verdict")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def c11_known_products(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("product_id"))
    return fl.known_products(events, catalog_view(spark, sf_dir).where("size > 20")).select("event_id", "product_id")


@query(f"WITH {CAT} SELECT l_orderkey, product_id, title FROM (SELECT l_orderkey, l_partkey + 100 AS product_id FROM lineitem) JOIN cat USING (product_id)")
def d1_enrich_hits(spark, sf_dir):
    hits = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") + 100).alias("product_id"))
    return jn.enrich_hits(hits, catalog_view(spark, sf_dir)).select("l_orderkey", "product_id", "title")


@query(f"WITH {CAT}, {FILTERS} SELECT query_id, product_id FROM f JOIN cat ON (want_category IS NULL OR category = want_category) AND (price_min IS NULL OR base_price >= price_min) AND (price_max IS NULL OR base_price <= price_max)")
def d2_match_filters(spark, sf_dir):
    return jn.match_filters(filter_rows(spark, sf_dir).select("query_id", "want_category", "price_min", "price_max"), catalog_view(spark, sf_dir))


@query(f"WITH {CAT} SELECT DISTINCT brand, CASE brand WHEN 'Brand#2' THEN 'brand#2,second,zwei' WHEN 'Brand#3' THEN 'brand#3,drei' ELSE lower(brand) END AS aliases FROM cat")
def d5_expand_aliases(spark, sf_dir):
    clusters = spark.createDataFrame([(1, "brand#2"), (1, "zwei"), (1, "second"), (2, "brand#3"), (2, "drei")], "cluster_id int, alias string")
    return jn.expand_aliases(catalog_view(spark, sf_dir).select("brand").distinct(), clusters).select("brand", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT l_orderkey, CAST(count(DISTINCT p_size % 5) AS INTEGER) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def d6_distinct_brand_groups(spark, sf_dir):
    alias = F.array(F.concat(F.lit("cluster"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("own"), F.col("p_partkey").cast("string")))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("l_orderkey").agg(F.collect_list(alias).alias("b")).select("l_orderkey", jn.distinct_brand_groups(F.col("b")).alias("brands"))


@query(PRICED + " SELECT product_id, currency, CAST(price_cny AS DOUBLE) AS price_cny FROM pr")
def d7_convert_prices(spark, sf_dir):
    return priced(spark, sf_dir).select("product_id", "currency", F.col("price_cny").cast("double").alias("price_cny"))


@query(f"WITH {CAT} SELECT category, brand, count(*) AS products FROM cat GROUP BY ALL")
def g1_brand_categories(spark, sf_dir):
    return ag.brand_categories(catalog_view(spark, sf_dir)).withColumn("category", F.explode("categories")).join(catalog_view(spark, sf_dir).groupBy("brand", "category").agg(F.count("*").alias("products")), ["brand", "category"]).select("category", "brand", "products")


@query("SELECT DISTINCT trim(p_brand, ' ') AS brand, CAST(length(trim(p_brand, ' ')) AS INTEGER) AS length FROM part WHERE trim(p_brand, ' ') != ''")
def g1_catalog_brands(spark, sf_dir):
    """Brands and their lengths, by which longer names are tried first."""
    return ag.catalog_brands(catalog_view(spark, sf_dir))


@query("SELECT DISTINCT p_type AS category, split_part(p_name, ' ', -1) AS sub_category FROM part")
def g2_category_pairs(spark, sf_dir):
    return ag.category_pairs(catalog_view(spark, sf_dir))


@query(FEW + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS rank FROM fw), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), c AS (SELECT query_id, category, count(*) AS c, min(rank) AS first FROM r GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, first, category) AS o FROM c) SELECT query_id, CASE WHEN c >= greatest(3, n // 2) THEN category END AS dominant FROM n JOIN b USING (query_id) WHERE o = 1")
def g3_dominant_category(spark, sf_dir):
    return rt.dominant_category(few(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("product_id"))))


@query(f"WITH {CAT}, t AS (SELECT product_id, title, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM cat), x AS (SELECT a.w AS trigger, b.w AS term, count(DISTINCT a.product_id) AS n FROM t a JOIN t b ON a.product_id = b.product_id AND a.w != b.w GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY n DESC, term DESC) AS r FROM x) SELECT trigger, term, CAST(2 AS BIGINT) AS score, true AS in_catalog FROM o WHERE r <= 6")
def g6_synonym_candidates(spark, sf_dir):
    c = catalog_view(spark, sf_dir)
    words = c.select(F.explode(tokens("title")).alias("trigger")).distinct()
    return ag.synonym_candidates(c.select("product_id", F.col("title").alias("text")), words, limit=3, texts=None)


@query(f"""WITH {CAT}, t AS (SELECT DISTINCT product_id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM cat), tr AS (SELECT DISTINCT w AS trigger FROM t UNION SELECT 'gizmo'), cu AS (SELECT * FROM (VALUES ('ring', 'band'), ('gizmo', 'ring'), ('red', 'blue')) v(trigger, term)),
 m AS (SELECT trigger, product_id FROM tr JOIN t ON w = trigger UNION SELECT trigger, product_id FROM tr JOIN cat ON len(list_intersect(string_split(trigger, ''), string_split(lower(title), ''))) > 0 WHERE trigger NOT IN (SELECT w FROM t)),
 h AS (SELECT trigger, product_id FROM (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY product_id) AS r FROM m) WHERE r <= 20), x AS (SELECT trigger, w AS term, count(*) AS n FROM h JOIN t USING (product_id) WHERE w != trigger GROUP BY ALL),
 v AS (SELECT trigger, term, 2 AS vote FROM (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY n DESC, term DESC) AS r FROM x) WHERE r <= 6 UNION ALL SELECT trigger, term, 3 FROM cu)
 SELECT trigger, term, CAST(sum(vote) AS BIGINT) AS score, term IN (SELECT w FROM t) AS in_catalog FROM v GROUP BY ALL""")
def g6_curated_candidates(spark, sf_dir):
    """With curated pairs, the first twenty titles of each trigger, and a trigger that no title holds."""
    c = catalog_view(spark, sf_dir)
    words = c.select(F.explode(tokens("title")).alias("trigger")).distinct().unionByName(spark.createDataFrame([("gizmo",)], "trigger string"))
    curated = spark.createDataFrame([("ring", "band"), ("gizmo", "ring"), ("red", "blue")], "trigger string, term string")
    return ag.synonym_candidates(c.select("product_id", F.col("title").alias("text")), words, limit=3, curated=curated)


@query("SELECT o_orderkey AS query_id, CAST(len(list_distinct([o_orderpriority, o_orderstatus, 'F', o_orderstatus])) AS INTEGER) AS n_union, CAST(len(list_filter([o_orderpriority, o_orderstatus, 'F'], lambda x: x NOT IN ('F', 'O'))) AS INTEGER) AS n_left, o_orderstatus IN ('F', 'O') AS overlap FROM orders")
def s1_array_sets(spark, sf_dir):
    """Ordered union, case-insensitive difference and intersection tests over arrays (S1, S2, S3)."""
    o = read(spark, sf_dir, "orders").withColumn("a", F.array("o_orderpriority", "o_orderstatus", F.lit("F"))).withColumn("b", F.array(F.lit("f"), F.lit("o")))
    return o.select(F.col("o_orderkey").alias("query_id"), F.size(ag.ordered_union("a", F.array("o_orderstatus"))).alias("n_union"), F.size(ag.ordered_difference("a", "b")).alias("n_left"), F.arrays_overlap(F.array(F.lower("o_orderstatus")), "b").alias("overlap"))


@query(PRICED + ", rw AS (SELECT l_orderkey AS query_id, product_id, min(l_linenumber) AS rank FROM lineitem JOIN pr ON l_partkey = product_id GROUP BY ALL), n AS (SELECT rw.*, category, CAST(price_cny AS DOUBLE) AS price, CASE WHEN query_id % 3 = 0 THEN 'cheap' WHEN query_id % 3 = 1 THEN 'expensive' END AS direction, CASE WHEN query_id % 5 = 0 THEN 6700.0 END AS high FROM rw JOIN pr USING (product_id)), k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM n WHERE high IS NULL OR price <= high), c AS (SELECT query_id, category AS cat, count(*) AS c, min(rank) AS first, any_value(n) AS n FROM k GROUP BY ALL), m AS (SELECT query_id, CASE WHEN c >= greatest(3, n // 2) THEN cat END AS main FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, first, cat) AS o FROM c) WHERE o = 1) SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN direction IS NOT NULL AND main IS NOT NULL AND category != main THEN 1 ELSE 0 END, CASE WHEN direction IS NOT NULL AND price IS NULL THEN 1 ELSE 0 END, CASE direction WHEN 'cheap' THEN price WHEN 'expensive' THEN -price END NULLS FIRST, rank, product_id) AS INTEGER) AS price_rank FROM k JOIN m USING (query_id)")
def e11_price_sort(spark, sf_dir):
    p = priced(spark, sf_dir).select("product_id", "category", F.col("price_cny").cast("double").alias("price"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("product_id")).agg(F.min("l_linenumber").alias("rank"))
    rows = lines.join(p, "product_id").selectExpr("*", "CASE query_id % 3 WHEN 0 THEN 'cheap' WHEN 1 THEN 'expensive' END AS direction", "CAST(NULL AS DOUBLE) AS low", "CASE WHEN query_id % 5 = 0 THEN 6700.0D END AS high")
    return rt.price_sort(rows).select("query_id", "product_id", "price_rank")


@query(f"WITH {CAT}, {BOUGHT}, s AS (SELECT query_id, product_id, list_sum(list_transform(list_filter(string_split('red gear ' || query_id, ''), lambda ch: ch != ' '), lambda ch: (CASE WHEN contains(lower(title), ch) THEN 1.0 ELSE 0.0 END) + (CASE WHEN contains(lower(description), ch) THEN 0.5 ELSE 0.0 END))) AS score FROM bo JOIN cat USING (product_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM s) SELECT query_id, product_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def e7_char_overlap_topk(spark, sf_dir):
    pairs = bought(spark, sf_dir).join(catalog_view(spark, sf_dir), "product_id").withColumn("text", F.concat(F.lit("Red gear "), F.col("query_id").cast("string")))
    return rt.char_overlap_topk(pairs, 5)


@query("SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_size % 3 = 0 THEN '中' || p_name ELSE p_name END AS title, CASE WHEN p_size % 3 = 0 THEN p_name END AS title_en, 's_' || p_partkey || '_1' AS sku_id, CASE WHEN p_size % 2 = 0 THEN 'JPY' ELSE 'USD' END AS currency, CAST(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS reviews, p_type IN ('SMALL', 'LARGE', 'PROMO') AS known FROM part")
def a2_canonicalize_feed(spark, sf_dir):
    """part as a raw feed; three of its types are known categories."""
    from ..sources.files import canonicalize_feed

    provenance = F.when(F.col("p_size") % 2 == 0, F.struct(F.lit(None).cast("string").alias("origin_country"), F.lit(None).cast("string").alias("source_platform"), F.lit("JPY").alias("currency"), F.lit(None).cast("string").alias("external_url"), F.lit(None).cast("string").alias("shipping_note")))
    raw = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("中"), "p_name")).alias("title_zh"), F.col("p_name").alias("title_en"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.lit("s").alias("sub_category"),
        F.col("p_retailprice").alias("base_price"), F.lit(None).cast("string").alias("image_url_external"), F.lit("u").alias("external_url"), provenance.alias("provenance"), F.lit("d").alias("marketing_description"), F.when(F.col("p_size") % 5 == 0, "fine").otherwise(" ").alias("user_reviews_summary"),
    )
    good, bad = canonicalize_feed(raw, spark.createDataFrame([("SMALL",), ("LARGE",), ("PROMO",)], "category string"))
    both = good.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False)))
    return both.select("product_id", "title", "title_en", F.col("skus")[0]["sku_id"].alias("sku_id"), F.col("provenance.currency").alias("currency"), F.size("rag_knowledge.user_reviews").alias("reviews"), "known")


@query(FEW + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base_price DESC, product_id) AS rank FROM fw) SELECT query_id, product_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2")
def s5_top_k(spark, sf_dir):
    """The two dearest products of each order (H1, S5)."""
    return rt.top_k(few(spark, sf_dir), 2, order=[F.desc("base_price"), F.asc("product_id")]).select("query_id", "product_id", "rank")
