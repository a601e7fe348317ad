"""Jobs over users' purchases, watches, feedback, carts, favourites and group buys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import CYCLE_ELSE, CYCLES
from ..sources.state import Stored, by_day

DAY = 86400
DIMENSIONS = ("brand", "category", "sub_category")


def record_purchases(events: DataFrame, catalog: DataFrame, cycles: dict[str, int] | None = None) -> DataFrame:
    """Purchases of known products with cycle_days (explicit, else the product's if positive, else the category's, else 90) and next_due_at."""
    table = cycles or CYCLES
    by_category = F.coalesce(*(F.when(F.col("category") == c, F.lit(d)) for c, d in table.items()), F.lit(CYCLE_ELSE))
    own = F.when(F.col("repurchase_cycle_days") > 0, F.col("repurchase_cycle_days"))
    out = events.join(catalog.select("product_id", "category", "repurchase_cycle_days"), "product_id")
    out = out.withColumn("cycle_days", F.coalesce("cycle_days", own, by_category)).drop("category", "repurchase_cycle_days")
    return out.withColumn("next_due_at", F.timestamp_seconds(F.unix_timestamp("purchased_at") + F.col("cycle_days") * DAY))


def due_rows(purchases: DataFrame, now: Column, limit: int, snooze_h: int = 24) -> DataFrame:
    """The most overdue `limit` per user that are due and not shown within the snooze."""
    rested = F.col("last_shown_at").isNull() | (F.unix_timestamp("last_shown_at") < F.unix_timestamp(now) - snooze_h * 3600)
    w = Window.partitionBy("user_id").orderBy("next_due_at", "id")
    return purchases.where((F.col("next_due_at") <= now) & rested).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def due_reminders(purchases: DataFrame, catalog: DataFrame, now: Column, limit: int, snooze_h: int = 24) -> DataFrame:
    """Reminders with days_overdue and a tier; unknown products go only after the limit."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("next_due_at")) / DAY)
    out = due_rows(purchases, now, limit, snooze_h).withColumn("days_overdue", days).join(catalog.select("product_id", "title"), "product_id")
    return out.withColumn("tier", F.when(F.col("days_overdue") <= 0, "due").when(F.col("days_overdue") <= 7, "overdue").otherwise("long_overdue"))


def mark_shown(purchases: DataFrame, shown: DataFrame, now: Column) -> DataFrame:
    """Purchases with last_shown_at = now for the shown ids (all that the limit chose, unknown products too)."""
    return purchases.join(shown.select("id", F.lit(True).alias("_shown")), "id", "left").withColumn("last_shown_at", F.when(F.col("_shown"), now).otherwise(F.col("last_shown_at"))).drop("_shown")


def price_alerts(watches: DataFrame, catalog: DataFrame, now: Column, limit: int, snooze_h: int = 24) -> DataFrame:
    """Watches that are not snoozed and whose product is known with a CNY price at or under the target; the limit per user counts matches only."""
    rested = F.col("last_alerted_at").isNull() | (F.unix_timestamp("last_alerted_at") < F.unix_timestamp(now) - snooze_h * 3600)
    hits = watches.where(rested).join(catalog.select("product_id", "price_cny"), "product_id").where("price_cny <= target_price_cny")
    w = Window.partitionBy("user_id").orderBy("id")
    return hits.withColumn("savings", F.round(F.col("target_price_cny") - F.col("price_cny"), 2)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def mark_alerted(watches: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """Watches with last_alerted_at = now for those of the alerts, so that the snooze holds them back."""
    return watches.join(alerts.select("id", F.lit(True).alias("_told")), "id", "left").withColumn("last_alerted_at", F.when(F.col("_told"), now).otherwise(F.col("last_alerted_at"))).drop("_told")


def list_watches(watches: DataFrame) -> DataFrame:
    """Watches with their position among their user's, newest first."""
    return watches.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows by unique key: an update replaces the row, the last one in `order` wins."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(F.desc(c) for c in order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in `order`."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_watches(watches: DataFrame, updates: DataFrame) -> DataFrame:
    """The latest target wins and clears last_alerted_at."""
    return upsert(watches, updates.withColumn("last_alerted_at", F.lit(None).cast("timestamp")), ["user_id", "product_id"], ["created_at", "id"])


def remove_watches(watches: DataFrame, gone: DataFrame) -> DataFrame:
    return watches.join(gone.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")


def list_users(users: DataFrame, most: int = 200) -> DataFrame:
    """The newest users, without secrets."""
    return users.select("user_id", "provider", "display_name", "created_at", F.col("password_hash").isNotNull().alias("has_password")).orderBy(F.desc("created_at"), "user_id").limit(most)


def preference_events(feedback: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, dimension, value, ts, id, delta): +1 for a like, -2 for a dislike, for each of the product's dimensions."""
    out = feedback.join(catalog.select("product_id", *DIMENSIONS), "product_id").where("signal in (1, -1)")
    values = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))
    return out.select("user_id", "ts", "id", F.when(F.col("signal") == 1, 1).otherwise(-2).alias("delta"), F.explode(values).alias("d")).select("user_id", "d.*", "ts", "id", "delta").where("value is not null and value != ''")


def clamp_fold(ordered: Column, low: int = -10, high: int = 10) -> Column:
    """The composition of steps x -> clamp(x + delta) as (shift, floor, cap): x -> min(cap, max(floor, x + shift)). Compositions are of the same kind."""
    start = F.struct(F.lit(0).alias("shift"), F.lit(-1_000_000_000).alias("floor"), F.lit(1_000_000_000).alias("cap"))

    def step(s: Column, e: Column) -> Column:
        clamp = lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x))
        return F.struct((s["shift"] + e["delta"]).alias("shift"), clamp(s["floor"] + e["delta"]).alias("floor"), clamp(s["cap"] + e["delta"]).alias("cap"))

    return F.aggregate(ordered, start, step)


def preference_scores(feedback: DataFrame, catalog: DataFrame, bucket: str = "1 day") -> DataFrame:
    """(user_id, dimension, value, score), clamped to [-10, 10] after every event in order of ts and id.

    Events of a key fold within time buckets first, then the buckets' folds
    compose, so a hot key is never gathered event by event in one place.
    """
    keys = ["user_id", "dimension", "value"]
    events = preference_events(feedback, catalog).withColumn("slot", F.window("ts", bucket)["start"])
    ordered = F.array_sort(F.collect_list(F.struct("ts", "id", "delta")))
    folds = events.groupBy(*keys, "slot").agg(ordered.alias("events")).select(*keys, "slot", clamp_fold(F.col("events")).alias("fold"))
    apply = lambda x, e: F.least(e["fold"]["cap"], F.greatest(e["fold"]["floor"], x + e["fold"]["shift"]))
    return folds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "fold"))).alias("slots")).select(*keys, F.aggregate("slots", F.lit(0), apply).alias("score"))


def preference_list(feedback: DataFrame, catalog: DataFrame, wiped: DataFrame | None = None) -> DataFrame:
    """Every user's scores that are not zero, with their position, last touched first; users in `wiped` (user_id) have none."""
    keys = ["user_id", "dimension", "value"]
    touched = preference_events(feedback, catalog).groupBy(*keys).agg(F.max(F.struct("ts", "id")).alias("_last"))
    scores = preference_scores(feedback, catalog).where("score != 0")
    scores = scores.join(wiped.select("user_id"), "user_id", "left_anti") if wiped is not None else scores
    w = Window.partitionBy("user_id").orderBy(F.desc("_last"), "dimension", "value")
    return scores.join(touched, keys).withColumn("position", F.row_number().over(w)).drop("_last")


def cart_state(events: DataFrame) -> DataFrame:
    """Quantities per (user_id, product_id) after add (merges), increment, decrement, set (<= 0 removes), remove and clear, in order of ts and id.

    The last boundary (set, remove, or a clear of the whole cart) fixes a
    start; later changes add up. A line that falls to zero or below goes.
    """
    clears = events.where("action = 'clear'").groupBy("user_id").agg(F.max(F.struct("ts", "id")).alias("cleared"))
    rows = events.where("action != 'clear'").join(clears, "user_id", "left").withColumn("at", F.struct("ts", "id"))
    rows = rows.where(F.col("cleared").isNull() | (F.col("at") > F.col("cleared")))
    edges = rows.where("action in ('set', 'remove')").groupBy("user_id", "product_id").agg(F.max(F.struct("at", F.when(F.col("action") == "set", F.greatest(F.col("quantity"), F.lit(0))).otherwise(0).alias("start"))).alias("edge"))
    change = F.when(F.col("action").isin("add", "increment"), F.coalesce("quantity", F.lit(1))).when(F.col("action") == "decrement", -F.coalesce(F.col("quantity"), F.lit(1))).otherwise(0)
    left = rows.join(edges, ["user_id", "product_id"], "left").withColumn("change", F.when(F.col("edge").isNull() | (F.col("at") > F.col("edge.at")), change).otherwise(0))
    out = left.groupBy("user_id", "product_id").agg((F.coalesce(F.first("edge.start"), F.lit(0)) + F.sum("change")).alias("quantity"))
    return out.where("quantity > 0")


def cart_lines(events: DataFrame) -> DataFrame:
    """Every cart's lines after actions that may name a line by its place: user_id, position (from 0), product_id, quantity, unit_price.

    Actions, in order of ts and id: add (product_id, quantity, unit_price: merges into the
    product's line, and a given price replaces the line's), set (index, quantity; 0 or less
    removes), remove (index), increment and decrement (index; a line that falls to zero
    goes), clear. An index beyond the cart does nothing; -1 is the last line. What a place means depends on
    all actions since the last clear, so these fold in order, one user at a time.
    """
    clears = events.where("action = 'clear'").groupBy("user_id").agg(F.max(F.struct("ts", "id")).alias("cleared"))
    rows = events.where("action != 'clear'").join(clears, "user_id", "left").where(F.col("cleared").isNull() | (F.struct("ts", "id") > F.col("cleared"))).drop("cleared")
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("user_id", "product_id")}

    def fold(key, own: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []  # product, quantity, price
        for row in own.sort_values(["ts", "id"]).itertuples(index=False):
            if row.action == "add":
                amount = 1 if pd.isna(row.quantity) else int(row.quantity)
                found = next((x for x in lines if x[0] == row.product_id), None)
                if found is None:
                    lines.append([row.product_id, amount, row.unit_price])
                else:
                    found[1] += amount
                    if not pd.isna(row.unit_price):
                        found[2] = row.unit_price
                continue
            at = len(lines) - 1 if row.index == -1 else row.index
            if pd.isna(at) or not 0 <= at < len(lines):
                continue
            step = {"set": None, "remove": None, "increment": 1, "decrement": -1}[row.action]
            line = lines[int(at)]
            line[1] = line[1] + step if step else int(row.quantity) if row.action == "set" else 0
            if line[1] <= 0:
                del lines[int(at)]
        return pd.DataFrame([(key[0], n, *x) for n, x in enumerate(lines)], columns=["user_id", "position", "product_id", "quantity", "unit_price"])

    return rows.groupBy("user_id").applyInPandas(fold, f"user_id {kinds['user_id']}, position int, product_id {kinds['product_id']}, quantity long, unit_price double")


def cart_totals(cart: DataFrame, rates: DataFrame) -> DataFrame:
    """Per user: quantity, CNY total over lines that can be converted (each rounded to two places), how many cannot, and their totals by currency, sorted by code. cart: user_id, unit_price, currency, quantity."""
    rate = F.when(F.col("currency") == "CNY", F.lit(1.0)).otherwise(F.col("rate"))
    own = F.col("unit_price").cast("decimal(18,6)") * F.col("quantity").cast("int")
    rows = cart.join(rates.select("currency", "rate"), "currency", "left").withColumn("line", (own * rate.cast("decimal(18,6)")).cast("decimal(18,2)"))
    per = rows.groupBy("user_id", "currency").agg(F.sum("quantity").alias("quantity"), F.sum("line").alias("line"), F.count_if(F.col("line").isNull()).alias("n"), F.sum(F.when(F.col("line").isNull(), own.cast("decimal(18,2)"))).alias("total"))
    unresolved = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("currency", "total"))))
    return per.groupBy("user_id").agg(F.sum("quantity").alias("quantity"), F.coalesce(F.sum("line"), F.lit(0)).cast("decimal(28,2)").alias("total_cny"), F.sum("n").alias("unresolved"), unresolved.alias("unresolved_totals"))


def settle_total(cart: DataFrame, pairs: DataFrame, target: str) -> DataFrame:
    """Per user: the total in one currency, each line rounded to two places, and how many lines have no rate. pairs: currency, target, rate (decimal)."""
    rate = pairs.where(F.col("target") == target).select("currency", F.col("rate").alias("_rate"))
    line = (F.col("unit_price").cast("decimal(18,6)") * F.col("quantity").cast("int") * F.col("_rate")).cast("decimal(18,2)")
    out = cart.join(rate, "currency", "left").withColumn("line", line)
    return out.groupBy("user_id").agg(F.coalesce(F.sum("line"), F.lit(0)).cast("decimal(28,2)").alias("total"), F.count_if(F.col("line").isNull()).alias("unresolved"))


def favorites(toggles: DataFrame) -> DataFrame:
    """Products toggled an odd number of times."""
    return toggles.groupBy("user_id", "product_id").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def group_status(groups: DataFrame, members: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """filled (distinct users), remaining, status (complete before expired before open), price at 85 % and seconds left of each group of a known product."""
    filled = members.groupBy("group_id").agg(F.count_distinct("user_id").alias("filled"))
    out = groups.join(catalog.select("product_id", "price_cny"), "product_id").join(filled, "group_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    status = F.when(F.col("filled") >= F.col("target_size"), "complete").when(F.col("expires_at") <= now, "expired").otherwise("open")
    return out.select(
        "group_id", "product_id", "opener_id", "filled", F.greatest(F.col("target_size") - F.col("filled"), F.lit(0)).alias("remaining"), status.alias("status"),
        (F.col("price_cny").cast("decimal(18,4)") * F.lit("0.85").cast("decimal(4,2)")).cast("decimal(18,2)").alias("group_price"),
        F.greatest(F.unix_timestamp("expires_at") - F.unix_timestamp(now), F.lit(0)).alias("seconds_left"),
    )


def opener_groups(groups: DataFrame) -> DataFrame:
    """Groups with their position among their opener's, newest first."""
    return groups.withColumn("position", F.row_number().over(Window.partitionBy("opener_id").orderBy(F.desc("created_at"), F.desc("group_id"))))


#: When a purchase next has to be looked at: once due, and not before its snooze is over.
WAKES = "greatest(next_due_at, coalesce(last_shown_at + make_dt_interval(0, {0}), next_due_at))"


def due_table(spark, path: str, purchases: DataFrame, snooze_h: int = 24, grain: str = "yyyy-MM-dd") -> Stored:
    """Purchases stored by the day (or month, yyyy-MM) in which they next have to be looked at (J1)."""
    return by_day(spark, path, ["id"], WAKES.format(snooze_h), grain).create(purchases)


def due_scan(stored: Stored, now: Column) -> DataFrame:
    """Rows of the days (or months) up to now: later ones are not listed, so a scan costs what is due."""
    today = stored.spark.range(1).select(F.date_format(now, stored.part.split("'")[-2])).first()[0]
    return stored.rows(only={p for p in stored.manifest()["parts"] if p <= today})


def mark_shown_stored(stored: Stored, shown: DataFrame, now: Column) -> set[str]:
    """mark_shown() on a stored table: the shown rows move to the day their snooze ends; the days they leave and come to are rewritten."""
    found = due_scan(stored, now).join(shown.select("id").distinct(), "id", "left_semi")
    left = {r.part for r in found.select(F.expr(stored.part).alias("part")).distinct().collect()}  # days
    return stored.change(found.withColumn("last_shown_at", now), moved_from=left)


FOLD_KEYS = ["user_id", "dimension", "value", "day"]


def preference_folds(feedback: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, dimension, value, day, shift, floor, cap): what the events of a day do to a score, composed (clamp_fold())."""
    events = preference_events(feedback, catalog).withColumn("day", F.date_trunc("day", "ts").cast("timestamp"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "id", "delta")))
    return events.groupBy(*FOLD_KEYS).agg(clamp_fold(ordered).alias("fold")).select(*FOLD_KEYS, "fold.*")


def fold_table(spark, path: str, folds: DataFrame) -> Stored:
    """Folds stored by day (G4)."""
    return by_day(spark, path, FOLD_KEYS, "day").create(folds)


def replace_days(stored: Stored, folds: DataFrame, days: set[str]) -> set[str]:
    """Put the folds of some days (yyyy-MM-dd) in place of what is stored of them: a new day, or a late one again. Only those days are read and written."""
    return stored.change(folds, gone=stored.rows(only=days).select(*FOLD_KEYS), moved_from=days)


def scores_of(folds: DataFrame) -> DataFrame:
    """preference_scores() from folds of days: a score takes a row for each of its days, and no event."""
    keys = FOLD_KEYS[:3]
    apply = lambda x, e: F.least(e["cap"], F.greatest(e["floor"], x + e["shift"]))
    days = F.array_sort(F.collect_list(F.struct("day", "shift", "floor", "cap")))
    return folds.groupBy(*keys).agg(days.alias("days")).select(*keys, F.aggregate("days", F.lit(0), apply).alias("score"))
