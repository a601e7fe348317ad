"""Search operators: BM25, fusion, unions of variants, re-ranking, top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def top_k(scored: DataFrame, k: int, key: str = "query_id", order: list[Column] | None = None, rank: str = "rank") -> DataFrame:
    """First k rows per key with a 1-based rank. The default order is score, then product_id. Spark cuts each partition to k before the shuffle."""
    order = order or [F.desc("score"), F.asc("product_id")]
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


def term_weights(queries: DataFrame, terms: DataFrame, table: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, qtf) of queries, and (term, mean_dl, idf) of their terms over documents (terms, dl). table(df) may write the counts of words, so that documents are read once, and give them back."""
    # One pass counts the documents of every term and, under a null term, all documents and their lengths.
    each = terms.select("dl", F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))).alias("term"))
    counts = table(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total")))
    size = counts.where("term is null").select(F.col("df").alias("docs"), (F.col("total") / F.col("df")).alias("mean_dl"))
    raw = counts.where("term is not null").crossJoin(F.broadcast(size)).withColumn("idf", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # size: one row
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = raw.join(asked.select("term").distinct(), "term").crossJoin(F.broadcast(mean)).select("term", "mean_dl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    return asked, idf


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, allowed: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Okapi BM25 of queries (query_id, text) over docs (product_id, text): query_id, product_id, score, rank.

    A term in more than half of the documents gets a quarter of the mean idf.
    Query terms count as often as they come. Rows with a score of zero or less
    go after the cut; queries without terms give nothing. `allowed`
    (query_id, product_id) keeps only these pairs; `keep` filters the scored
    pairs before the cut. Only words that some query has are shuffled by
    document; the others are only counted, partly in the scan.
    """
    terms = docs.select("product_id", tokens("text").alias("terms")).withColumn("dl", F.size("terms"))  # before the words, so that no word carries its list
    asked, idf = term_weights(queries, terms)
    wanted = asked.select("term").distinct()
    met = terms.select("product_id", "dl", F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    found = met.groupBy("product_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    hits = found.join(idf, "term").select("term", "product_id", weight.alias("weight")).join(asked, "term")
    if allowed is not None:
        hits = hits.join(allowed.select("query_id", "product_id"), ["query_id", "product_id"], "left_semi")
    scored = hits.groupBy("query_id", "product_id").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), 6).alias("score"))
    return top_k(keep(scored) if keep is not None else scored, k).where("score > 0")


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 60, most: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, product_id, rank from 1); ranks come out 0-based and nullable. Ties: dense list first, then its order."""
    left = dense.select("query_id", "product_id", (F.col("rank") - 1).alias("dense_rank"), F.lit(None).cast("int").alias("bm25_rank"))
    right = sparse.select("query_id", "product_id", F.lit(None).cast("int").alias("dense_rank"), (F.col("rank") - 1).alias("bm25_rank"))
    both = left.unionByName(right).groupBy("query_id", "product_id").agg(F.min("dense_rank").alias("dense_rank"), F.min("bm25_rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c) + 1), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("dense_rank") + part("bm25_rank"), 9))
    return top_k(scored, most, order=[F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("product_id")])


def multi_query_union(hits: DataFrame) -> DataFrame:
    """Hits of all variants of a query (query_id, variant, product_id, rank): the first variant that returns a product wins; order by variant and rank."""
    w = Window.partitionBy("query_id", "product_id").orderBy("variant", "rank")
    first = hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("variant", "rank", "product_id")))


def char_overlap_topk(pairs: DataFrame, k: int) -> DataFrame:
    """Fallback scores of pairs (query_id, text, product_id, title, description): 1 per query character in the title, half per one in the description; repeated characters count again."""
    letters = F.filter(F.split(F.lower(F.trim("text")), ""), lambda c: F.trim(c) != "")
    score = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.when(F.contains(F.lower("title"), c), 1.0).otherwise(0.0) + F.when(F.contains(F.lower(F.coalesce("description", F.lit(""))), c), 0.5).otherwise(0.0))
    return top_k(pairs.withColumn("score", score).select("query_id", "product_id", "score"), k)


def rerank(pairs: DataFrame, k: int, score: str = "score", position: str = "rank") -> DataFrame:
    """Order pairs by a scorer's output, null scores and single candidates in input order: rerank_rank from 1."""
    w = Window.partitionBy("query_id")
    scored = pairs.withColumn("candidates", F.count("*").over(w))
    key = F.when(F.col("candidates") > 1, F.col(score))
    return top_k(scored, k, order=[key.desc_nulls_last(), F.asc(position)], rank="rerank_rank").drop("candidates")


def preference_rerank(ranked: DataFrame, weights: DataFrame, alpha: float = 0.5) -> DataFrame:
    """ranked (query_id, user_id, product_id, rank, brand, category, sub_category) by N - index + alpha * liking.

    weights: (user_id, dimension, value, score). Stable; without weights or
    with one item nothing changes. Adds bonus and new_rank.
    """
    long = ranked.select("query_id", "user_id", "product_id", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("brand", "category", "sub_category")))).alias("d")).select("query_id", "user_id", "product_id", "d.*")
    bonus = long.join(weights, ["user_id", "dimension", "value"]).groupBy("query_id", "product_id").agg(F.sum("score").alias("liking"))
    w = Window.partitionBy("query_id")
    out = ranked.join(bonus, ["query_id", "product_id"], "left").withColumn("bonus", F.lit(alpha) * F.coalesce("liking", F.lit(0.0)))
    total = F.count("*").over(w) - (F.col("rank") - 1) + F.col("bonus")
    return out.withColumn("total", total).withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("total"), F.asc("rank")))).drop("liking", "total")


def relevance_gate(scored: DataFrame, floor: float | Column, ceil: float | Column, share: float = 0.15) -> DataFrame:
    """No-match gate and tail trim over scored rows (query_id, product_id, score, specific, overlap, scene).

    A query is emptied if its best score is under `floor` and it has neither
    a specific filter nor lexical overlap. If the best is at least `ceil`, rows
    under share of it and under `ceil` go. Unscored and scene queries pass.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    out = scored.withColumn("best", best)
    free = F.col("best").isNull() | F.col("scene")
    empty = (F.col("best") < floor) & ~F.col("specific") & ~F.col("overlap")
    tail = (F.col("best") >= ceil) & (F.col("score") < F.col("best") * share) & (F.col("score") < ceil)
    return out.where(free | ~(F.coalesce(empty, F.lit(False)) | F.coalesce(tail, F.lit(False)))).drop("best")


def price_sort(ranked: DataFrame) -> DataFrame:
    """Price bounds (low, high; a null price fails one), then the query's dominant category first, price by direction, null last, input order.

    ranked: query_id, product_id, rank, category, price, direction, low, high. Adds price_rank.
    """
    kept = ranked.where((F.col("low").isNull() | F.coalesce(F.col("price") >= F.col("low"), F.lit(False))) & (F.col("high").isNull() | F.coalesce(F.col("price") <= F.col("high"), F.lit(False))))
    main = dominant_category(kept).withColumnRenamed("dominant", "main")
    w = Window.partitionBy("query_id")
    price = F.when(F.col("direction") == "cheap", F.col("price")).when(F.col("direction") == "expensive", -F.col("price"))
    shelf = F.when(F.col("direction").isNotNull() & F.col("main").isNotNull() & ~F.col("category").eqNullSafe(F.col("main")), 1).otherwise(0)
    missing = F.when(F.col("direction").isNotNull() & F.col("price").isNull(), 1).otherwise(0)
    return kept.join(main, "query_id", "left").withColumn("price_rank", F.row_number().over(w.orderBy(shelf, missing, price, "rank", "product_id"))).drop("main")


def dominant_category(ranked: DataFrame) -> DataFrame:
    """(query_id, dominant): the commonest category if it has at least max(3, n div 2) rows; the first seen wins ties."""
    n = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    counts = ranked.where("category is not null").groupBy("query_id", "category").agg(F.count("*").alias("c"), F.min("rank").alias("first"))
    best = counts.withColumn("o", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "first", "category"))).where("o = 1")
    return n.join(best, "query_id", "left").select("query_id", F.when(F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2)), F.col("category")).alias("dominant"))
