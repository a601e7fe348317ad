"""Evaluation of result lists against labelled cases, and latency statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("recall5", "recall10", "mrr", "precision5", "negation")


def returned_lists(results: DataFrame) -> DataFrame:
    """(query_id, returned): product ids of ranked rows in order; lists have tens of entries."""
    return results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"]).alias("returned"))


def case_metrics(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics of every case (query_id, expected, forbidden; arrays, maybe null or empty). Null where a metric does not apply.

    Recall is a share of the expected; MRR looks at the whole list; precision
    is always out of five; negation is 1 - leaked / returned in the top five,
    and 1 if nothing was returned.
    """
    got = cases.join(returned_lists(results), "query_id", "left")
    kind = got.schema["expected"].dataType
    none = F.array().cast(kind)
    got = got.withColumn("returned", F.coalesce("returned", none)).withColumn("expected", F.coalesce("expected", none)).withColumn("forbidden", F.coalesce("forbidden", none))
    found = lambda n: F.size(F.array_intersect(F.slice("returned", 1, n), "expected"))
    asked = F.size("expected") > 0
    first = F.array_position(F.transform("returned", lambda x: F.array_contains("expected", x)), True)
    top = F.slice("returned", 1, 5)
    leaked = F.size(F.filter(top, lambda x: F.array_contains("forbidden", x)))
    return got.select(
        "query_id",
        F.when(asked, found(5) / F.size("expected")).alias("recall5"),
        F.when(asked, found(10) / F.size("expected")).alias("recall10"),
        F.when(asked, F.when(first > 0, 1 / first).otherwise(0.0)).alias("mrr"),
        F.when(asked, found(5) / 5).alias("precision5"),
        F.when(F.size("forbidden") > 0, F.when(F.size(top) > 0, 1 - leaked / F.size(top)).otherwise(1.0)).alias("negation"),
    )


def overall(metrics: DataFrame) -> DataFrame:
    """Means over cases; nulls are skipped."""
    return metrics.agg(F.count("*").alias("cases"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def by_tag(metrics: DataFrame, tags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means per tag (and columns `by`); a case counts in all its tags (query_id, tags), one without any as `untagged`."""
    none = F.array(F.lit("untagged"))
    tagged = metrics.join(tags, "query_id", "left").select("*", F.explode(F.when(F.size("tags") > 0, F.col("tags")).otherwise(none)).alias("tag"))
    return tagged.groupBy("tag", *by).agg(F.count("*").alias("cases"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def no_match(results: DataFrame, cases: DataFrame, titles: DataFrame) -> DataFrame:
    """For cases that expect nothing: 1 - 2 * mean Jaccard of CJK characters of the query (text) and the top five titles, within 0..1; titles without CJK are skipped; 1 if none is left."""
    letters = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("[一-鿿]"), F.lit(0)))
    asked = cases.where("expected is not null and size(expected) = 0").select("query_id", letters("text").alias("q"))
    shown = results.where("rank <= 5").join(titles, "product_id").select("query_id", letters("title").alias("t")).where("size(t) > 0")
    pairs = asked.join(shown, "query_id", "left").select("query_id", F.when(F.col("t").isNotNull(), F.size(F.array_intersect("q", "t")) / F.size(F.array_union("q", "t"))).alias("j"))
    return pairs.groupBy("query_id").agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.avg("j"))), F.lit(1.0)).alias("no_match"))


def compare_modes(metrics: DataFrame, baseline: str) -> DataFrame:
    """Long form (metric, mode, value): best flag (ties all; latency: lower is better) and lift over the baseline mode."""
    base = metrics.where(F.col("mode") == baseline).select("metric", F.col("value").alias("base"))
    sign = F.when(F.col("metric") == "latency_ms", -1.0).otherwise(1.0)
    top = F.max(sign * F.col("value")).over(Window.partitionBy("metric"))
    out = metrics.join(base, "metric", "left")
    return out.select("metric", "mode", "value", (sign * F.col("value") == top).alias("best"), F.round(F.col("value") - F.col("base"), 6).alias("lift"))


def compare_tags(metrics: DataFrame, tags: DataFrame, baseline: str) -> DataFrame:
    """Mean and lift over the baseline per (metric, tag, mode). metrics: query_id, mode and the columns METRICS; tags: query_id, tags."""
    means = by_tag(metrics, tags, ["mode"])
    long = means.select("tag", "mode", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("x")).select("tag", "mode", "x.metric", "x.value")
    base = long.where(F.col("mode") == baseline).select("metric", "tag", F.col("value").alias("base"))
    return long.join(base, ["metric", "tag"], "left").select("metric", "tag", "mode", "value", F.round(F.col("value") - F.col("base"), 6).alias("lift"))


def largest_changes(metrics: DataFrame, metric: str, baseline: str) -> DataFrame:
    """Per mode other than the baseline: the case with the largest gain and the one with the largest loss in a metric (the lower query_id at ties); null where no case gained or lost."""
    base = metrics.where(F.col("mode") == baseline).select("query_id", F.col(metric).alias("base"))
    change = metrics.where(F.col("mode") != baseline).join(base, "query_id").withColumn("change", F.round(F.col(metric) - F.col("base"), 6)).where("change is not null")
    top = lambda sign: F.max(F.when(sign * F.col("change") > 0, F.struct((sign * F.col("change")).alias("by"), (-F.col("query_id")).alias("id"))))
    out = change.groupBy("mode").agg(top(1).alias("up"), top(-1).alias("down"))
    return out.select("mode", (-F.col("up.id")).alias("gain_case"), F.col("up.by").alias("gain"), (-F.col("down.id")).alias("loss_case"), (-F.col("down.by")).alias("loss"))


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("cases"),
        F.count_if(F.size("expected") > 0).alias("with_expected"),
        F.count_if(F.size("expected") == 0).alias("no_match"),
        F.count_if(F.size("messages") > 0).alias("multi_turn"),
        F.count_if(F.size("forbidden") > 0).alias("with_forbidden"),
    )


def picks(rows: DataFrame, value: str, places: dict[str, object], by: list[str]) -> DataFrame:
    """Values at given 0-based places (columns over `n`) of the sorted values of each group; one row per group.

    Equal values are counted first, so the window runs over distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("n", F.sum("m").over(w)).withColumn("upto", F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(at(p).alias(name) for name, p in places.items()))


def latency_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, median, and p95 as the value at place int(0.95 n)."""
    p95 = picks(rows, value, {"p95": F.floor(F.col("n") * 95 / 100)}, by)
    rest = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.median(value).alias("p50"))
    return p95.join(rest, by)


def load_stats(samples: DataFrame, by: list[str], ok: str = "ok", seconds: str = "total_s", span: str = "span_s") -> DataFrame:
    """total, success rate, throughput over `span`, mean and nearest-rank p50, p95, p99 (place round(p * (n - 1)), half to even) of successful requests."""
    place = {f"p{p}": F.bround((F.col("n") - 1) * p / 100, 0) for p in (50, 95, 99)}
    every = samples.groupBy(*by).agg(F.count("*").alias("total"), F.round(F.avg(F.col(ok).cast("double")), 6).alias("success_rate"), F.round(F.count_if(ok) / F.max(span), 6).alias("throughput"), F.round(F.avg(F.when(F.col(ok), F.col(seconds))), 6).alias("mean"))
    return every.join(picks(samples.where(ok), seconds, place, by).drop("n"), by, "left")


def title_rules(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Pass if some title holds a required token (if any are given) and none a forbidden one; no results fail. results: query_id, title; rules: query_id, required, forbidden."""
    shown = results.groupBy("query_id").agg(F.collect_set(F.lower("title")).alias("titles"))
    has = lambda c: F.exists("titles", lambda t: F.exists(c, lambda x: F.contains(t, F.lower(x))))
    out = rules.join(shown, "query_id", "left")
    good = F.col("titles").isNotNull() & ((F.size(F.coalesce("required", F.array().cast("array<string>"))) == 0) | has("required")) & ~F.coalesce(has("forbidden"), F.lit(False))
    return out.select("query_id", F.coalesce(good, F.lit(False)).alias("passed"))


def vector_eval(hits: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Leave-one-in evaluation of vector hits (query_id, product_id, rank), ids from one set: per query label, category, brand, self_recall1, self_recallk, and precision of label and brand among the hits other than itself.

    labels: product_id, category, brand. The first k rows count; a query
    that finds nothing but itself has null precisions.
    """
    own = labels.select(F.col("product_id").alias("query_id"), F.col("category").alias("own_category"), F.col("brand").alias("own_brand"))
    rows = hits.where(F.col("rank") <= k).join(labels, "product_id").join(own, "query_id")
    me = F.col("query_id") == F.col("product_id")
    part = lambda same: F.count_if(~me & same) / F.nullif(F.count_if(~me), F.lit(0))
    return rows.groupBy("query_id", F.col("own_category").alias("category"), F.col("own_brand").alias("brand")).agg(
        F.max(me & (F.col("rank") == 1)).cast("int").alias("self_recall1"), F.max(me).cast("int").alias("self_recallk"),
        part(F.col("category").eqNullSafe(F.col("own_category"))).alias("category_precision"), part(F.col("brand").eqNullSafe(F.col("own_brand"))).alias("brand_recall"),
    )


VECTOR_METRICS = ("self_recall1", "self_recallk", "category_precision", "brand_recall")


def vector_means(per_query: DataFrame) -> DataFrame:
    """Means of vector_eval() overall (a null category) and per category."""
    means = [F.count("*").alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in VECTOR_METRICS)]
    each = per_query.where("category is not null").groupBy(F.col("category").cast("string").alias("category")).agg(*means)
    return per_query.agg(*means).withColumn("category", F.lit(None).cast("string")).unionByName(each)


#: Size of a quantile sketch: the value it gives for a share has a rank within 2 % of all rows of that share (KLL, 99 % of the time).
SKETCH, SKETCH_ERROR = 200, 0.02


def latency_sketches(rows: DataFrame, value: str, groups: list[str], at: str, slot: str = "1 hour") -> DataFrame:
    """(groups, slot, n, total, most, sketch): what is kept per group and hour. It adds up to any longer window, and rows need not be read again."""
    slots = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.window(at, slot)["start"].alias("slot"))
    return slots.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("sketch"))


def rolled_latency(sketches: DataFrame, groups: list[str], window: str | None = None, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """n, mean, max and quantiles (p50, ...) per group, and per window if given, from latency_sketches()."""
    keys = [*groups, *([F.window("slot", window)["start"].alias("start")] if window else [])]
    out = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.max("most").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return out.select(*groups, *(["start"] if window else []), "n", "mean", "max", *(F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares))
