"""Stored state and sketches: the same rows as the plain jobs, by changes of tables in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import lifecycle as lc
from ..sources.state import by_key
from .base import ORACLE, catalog_view, feedback, query, read, scratch
from .events import due_input, now


@query(ORACLE["a7_upsert"])
def a7_stored_upsert(spark, sf_dir):
    """Prices in 16 parts; the views of two days come as two changes, which rewrite the parts of their products."""
    prices = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id"))
    views = read(spark, sf_dir, "events").where("event_type = 'view'").select(F.get_json_object("props", "$.k").cast("long").alias("product_id"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    views = views.join(prices.select("product_id"), "product_id", "left_semi")
    stored = by_key(spark, scratch(spark, "prices"), ["product_id"], 16).create(prices)
    middle = views.select(F.percentile_approx(F.unix_timestamp("ts"), 0.5)).first()[0]
    early = F.unix_timestamp("ts") <= F.lit(middle if middle is not None else 0)
    for batch in (views.where(early), views.where(~early)):
        stored.change(batch, ("ts", "event_id"))
    return stored.rows().select("product_id", "price")


@query(ORACLE["j1_due_reminders"])
def j1_stored_reminders(spark, sf_dir):
    """Reminders from a table of months, of which those up to now are read."""
    stored = lc.due_table(spark, scratch(spark, "due"), due_input(spark, sf_dir), grain="yyyy-MM")
    return lc.due_reminders(lc.due_scan(stored, now()), catalog_view(spark, sf_dir).where("size < 40"), now(), 3).select("id", "user_id", "product_id", "title", "days_overdue", "tier")


@query(ORACLE["j2_mark_shown"])
def j2_stored_shown(spark, sf_dir):
    """Shown rows move to the month in which their snooze ends."""
    stored = lc.due_table(spark, scratch(spark, "due"), due_input(spark, sf_dir), grain="yyyy-MM")
    lc.mark_shown_stored(stored, lc.due_rows(lc.due_scan(stored, now()), now(), 3), now())
    return stored.rows().select("id", "last_shown_at")


@query(ORACLE["g4_preference_scores"])
def g4_stored_scores(spark, sf_dir):
    """Scores from stored folds of days: all but the last day at first, one earlier day incomplete; then the last day comes, and the other again."""
    likes, catalog = feedback(spark, sf_dir), catalog_view(spark, sf_dir)
    day = F.to_date("ts")
    first, last = likes.agg(F.min(day), F.max(day)).first()
    stored = lc.fold_table(spark, scratch(spark, "folds"), lc.preference_folds(likes.where((day < F.lit(last)) & ((day > F.lit(first)) | (F.col("id") % 2 == 0))), catalog))
    for again in (last, first):
        lc.replace_days(stored, lc.preference_folds(likes.where(day == F.lit(again)), catalog), {str(again)})
    return lc.scores_of(stored.rows())


@query()
def i7_rolled_latency(spark, sf_dir):
    """Latencies per event type and day, rolled up from sketches per hour."""
    rows = read(spark, sf_dir, "events").select("event_type", "ts", "value")
    return ev.rolled_latency(ev.latency_sketches(rows, "value", ["event_type"], "ts"), ["event_type"], "1 day")
