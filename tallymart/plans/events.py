"""Queries over purchases, feedback, watches, carts and requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import lifecycle as lc
from ..operators import retrieval as rt
from .base import CAT, FB, NOW, PUR, catalog_view, feedback, line_id, purchases, query, rates, read
from .catalog import PRICED, priced

CYCLES = {"STANDARD": 90, "LARGE": 14, "SMALL": 30}
DUE = f"""WITH {CAT}, {PUR}, rp AS (SELECT pur.*, coalesce(pur.cycle_days, CASE WHEN size % 10 = 0 THEN size END, CASE category WHEN 'STANDARD' THEN 90 WHEN 'LARGE' THEN 14 WHEN 'SMALL' THEN 30 ELSE 90 END) AS days FROM pur JOIN cat USING (product_id)),
 dp AS (SELECT * EXCLUDE (cycle_days), days AS cycle_days, purchased_at + to_days(CAST(days AS INTEGER)) AS next_due_at, CASE WHEN id % 4 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR WHEN id % 4 = 1 THEN TIMESTAMP '{NOW}' - INTERVAL 25 HOUR END AS last_shown_at FROM rp),
 du AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_due_at, id) AS position FROM dp WHERE next_due_at <= TIMESTAMP '{NOW}' AND (last_shown_at IS NULL OR last_shown_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR))"""


def now():
    return F.lit(NOW).cast("timestamp")


def recorded(spark, sf_dir):
    catalog = catalog_view(spark, sf_dir).withColumn("repurchase_cycle_days", F.expr("CASE WHEN size % 10 = 0 THEN size END"))
    return lc.record_purchases(purchases(spark, sf_dir), catalog, CYCLES)


def due_input(spark, sf_dir):
    at = F.when(F.col("id") % 4 == 0, now() - F.expr("INTERVAL 1 HOUR")).when(F.col("id") % 4 == 1, now() - F.expr("INTERVAL 25 HOURS"))
    return recorded(spark, sf_dir).withColumn("last_shown_at", at)


@query(DUE + " SELECT id, user_id, product_id, CAST(cycle_days AS INTEGER) AS cycle_days, next_due_at FROM dp")
def j3_record_purchases(spark, sf_dir):
    return recorded(spark, sf_dir).select("id", "user_id", "product_id", "cycle_days", "next_due_at")


@query(DUE + f" SELECT id, user_id, product_id, title, CAST(floor(epoch(TIMESTAMP '{NOW}' - next_due_at) / 86400) AS BIGINT) AS days_overdue, CASE WHEN floor(epoch(TIMESTAMP '{NOW}' - next_due_at) / 86400) <= 0 THEN 'due' WHEN floor(epoch(TIMESTAMP '{NOW}' - next_due_at) / 86400) <= 7 THEN 'overdue' ELSE 'long_overdue' END AS tier FROM du JOIN cat USING (product_id) WHERE position <= 3 AND size < 40")
def j1_due_reminders(spark, sf_dir):
    return lc.due_reminders(due_input(spark, sf_dir), catalog_view(spark, sf_dir).where("size < 40"), now(), 3).select("id", "user_id", "product_id", "title", "days_overdue", "tier")


@query(DUE + f" SELECT dp.id, CASE WHEN du.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE dp.last_shown_at END AS last_shown_at FROM dp LEFT JOIN (SELECT id FROM du WHERE position <= 3) du USING (id)")
def j2_mark_shown(spark, sf_dir):
    rows = due_input(spark, sf_dir)
    return lc.mark_shown(rows, lc.due_rows(rows, now(), 3), now()).select("id", "last_shown_at")


WATCH = f"""wt AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey AS id, o_custkey AS user_id, l_partkey AS product_id, floor(l_extendedprice / l_quantity) AS target_price_cny, o_orderdate AS created_at, CASE WHEN l_orderkey % 3 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 2 HOUR END AS last_alerted_at, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def watches(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(line_id().alias("id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("target_price_cny"), F.col("o_orderdate").alias("created_at"), F.when(F.col("l_orderkey") % 3 == 0, now() - F.expr("INTERVAL 2 HOURS")).alias("last_alerted_at"), F.col("l_linenumber").alias("line"))


ALERTS = PRICED + f", {WATCH}, h AS (SELECT wt.*, CAST(price_cny AS DOUBLE) AS price FROM wt JOIN pr USING (product_id) WHERE last_alerted_at IS NULL AND price_cny <= target_price_cny), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS position FROM h)"


def alerts(spark, sf_dir):
    p = priced(spark, sf_dir).select("product_id", F.col("price_cny").cast("double").alias("price_cny"))
    return lc.price_alerts(watches(spark, sf_dir), p, now(), 10)


@query(ALERTS + " SELECT id, user_id, product_id, CAST(CAST(target_price_cny - price AS DECIMAL(18,2)) AS DOUBLE) AS savings, CAST(position AS INTEGER) AS position FROM r WHERE position <= 10")
def j4_price_alerts(spark, sf_dir):
    """The first ten alerts of each user, the limit of a request."""
    return alerts(spark, sf_dir).select("id", "user_id", "product_id", F.col("savings").cast("decimal(18,2)").cast("double").alias("savings"), "position")


@query(ALERTS + f" SELECT wt.id, CASE WHEN r.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE wt.last_alerted_at END AS last_alerted_at FROM wt LEFT JOIN (SELECT id FROM r WHERE position <= 10) r USING (id)")
def j4_mark_alerted(spark, sf_dir):
    return lc.mark_alerted(watches(spark, sf_dir), alerts(spark, sf_dir), now()).select("id", "last_alerted_at")


@query(f"WITH {WATCH} SELECT user_id, id, product_id, target_price_cny, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS position FROM wt")
def j6_list_watches(spark, sf_dir):
    """Every user's watches, newest first."""
    return lc.list_watches(watches(spark, sf_dir)).select("user_id", "id", "product_id", "target_price_cny", "position")


@query(f"WITH {WATCH}, s AS (SELECT user_id, product_id, max(created_at) AS created_at, bool_or(l_linenumber > 4) AS updated FROM wt GROUP BY ALL), g AS (SELECT user_id, product_id, updated, CASE WHEN updated THEN (SELECT max(created_at) FROM wt w WHERE w.user_id = s.user_id AND w.product_id = s.product_id AND l_linenumber > 4) ELSE created_at END AS created_at FROM s) SELECT user_id, product_id, created_at FROM g WHERE product_id % 10 > 0")
def j5_upsert_watches(spark, sf_dir):
    rows = watches(spark, sf_dir).withColumn("updated", F.col("line") > 4)  # not by the digits of id, into which large product ids carry
    old = lc.latest_by_key(rows.where("not updated").drop("updated"), ["user_id", "product_id"], ["created_at", "id"])
    out = lc.upsert_watches(old, rows.where("updated").drop("updated"))
    gone = rows.where("product_id % 10 = 0").select("user_id", "product_id").distinct()
    return lc.remove_watches(out, gone).select("user_id", "product_id", "created_at")


@query("SELECT c_custkey AS user_id, c_name AS display_name, c_acctbal > 0 AS has_password FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200")
def j6_list_users(spark, sf_dir):
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("provider"), F.col("c_name").alias("display_name"), F.col("c_acctbal").alias("created_at"), F.when(F.col("c_acctbal") > 0, "x").alias("password_hash"))
    return lc.list_users(users).select("user_id", "display_name", "has_password")


LIKES = f"WITH {CAT}, {FB}, ev AS (SELECT user_id, unnest([['brand', brand], ['category', category], ['sub_category', sub_category]]) AS d, ts, id, CASE signal WHEN 1 THEN 1 ELSE -2 END AS delta FROM fb JOIN cat USING (product_id)), st AS (SELECT user_id, d[1] AS dimension, d[2] AS value, list(delta ORDER BY ts, id) AS deltas FROM ev GROUP BY ALL), pf AS (SELECT user_id, dimension, value, list_reduce(list_prepend(0, deltas), lambda a, b: greatest(-10, least(10, a + b))) AS score FROM st)"


@query(LIKES + " SELECT user_id, dimension, value, CAST(score AS INTEGER) AS score FROM pf")
def g4_preference_scores(spark, sf_dir):
    return lc.preference_scores(feedback(spark, sf_dir), catalog_view(spark, sf_dir))


@query(LIKES + ", la AS (SELECT user_id, d[1] AS dimension, d[2] AS value, max({'ts': ts, 'id': id}) AS last FROM ev GROUP BY ALL) SELECT user_id, dimension, value, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last DESC, dimension, value) AS INTEGER) AS position FROM pf JOIN la USING (user_id, dimension, value) WHERE score != 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def g5_preference_list(spark, sf_dir):
    """Scores that are not zero, newest first, without the users that wiped theirs."""
    wiped = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return lc.preference_list(feedback(spark, sf_dir), catalog_view(spark, sf_dir), wiped)


@query(LIKES + """, rk AS (SELECT id AS query_id, user_id, product_id, 1 + id % 7 AS rank FROM fb), ls AS (SELECT user_id AS query_id, user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY product_id) AS rank FROM (SELECT DISTINCT user_id, product_id FROM fb)),
 b AS (SELECT ls.*, coalesce((SELECT sum(score) FROM pf WHERE pf.user_id = ls.user_id AND ((dimension = 'brand' AND value = cat.brand) OR (dimension = 'category' AND value = cat.category) OR (dimension = 'sub_category' AND value = cat.sub_category))), 0) * 0.5 AS bonus, count(*) OVER (PARTITION BY query_id) AS n FROM ls JOIN cat USING (product_id))
 SELECT query_id, product_id, CAST(bonus AS DOUBLE) AS bonus, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n - (rank - 1) + bonus DESC, rank) AS INTEGER) AS new_rank FROM b""")
def e10_preference_rerank(spark, sf_dir):
    scores = lc.preference_scores(feedback(spark, sf_dir), catalog_view(spark, sf_dir))
    seen = feedback(spark, sf_dir).select("user_id", "product_id").distinct().withColumn("query_id", F.col("user_id"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("product_id"))).join(catalog_view(spark, sf_dir), "product_id")
    return rt.preference_rerank(ranked, scores).select("query_id", "product_id", "bonus", "new_rank")


@query(f"WITH {FB}, q AS (SELECT 'USD' AS currency, ts AS quoted_at, value AS rate, lead(ts) OVER (ORDER BY ts) AS until FROM (SELECT ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ts)) SELECT id, CASE WHEN id % 3 = 0 THEN 1.0 WHEN id % 3 = 1 THEN q.rate END AS rate, CASE WHEN id % 3 = 0 THEN false ELSE epoch(date_trunc('second', ts)) - epoch(date_trunc('second', quoted_at)) > 3600 END AS stale FROM fb LEFT JOIN q ON id % 3 = 1 AND ts >= quoted_at AND (until IS NULL OR ts < until)")
def d8_rate_asof(spark, sf_dir):
    quotes = read(spark, sf_dir, "events").where("event_type = 'view'").select(F.lit("USD").alias("currency"), F.col("ts").alias("quoted_at"), F.col("value").alias("rate"))
    rows = feedback(spark, sf_dir).select("id", "ts", F.expr("CASE id % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' ELSE 'JPY' END").alias("currency"))
    return jn.rate_asof(rows, quotes).select("id", "rate", "stale")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND c_custkey IS NOT NULL THEN CAST(o_custkey + 1000000 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS user_id FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def d9_rekey_users(spark, sf_dir):
    table = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("user_id"))
    mapping = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0 and c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("old_id"), (F.col("c_custkey") + 1000000).cast("string").alias("new_id"))
    return jn.rekey_users(table, mapping, ["o_orderkey"])


@query("SELECT o_custkey AS user_id, count(*) AS purged FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1")
def d10_purge_users(spark, sf_dir):
    ids = read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return jn.purge_users(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id"), ids)[1]


CART = """ce AS (SELECT event_id AS id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS product_id, CAST(1 + event_id % 3 AS INTEGER) AS quantity,
 CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'decrement' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'set' ELSE CASE WHEN event_id % 7 = 0 THEN 'clear' ELSE 'increment' END END AS action FROM events),
 cl AS (SELECT user_id, max({'ts': ts, 'id': id}) AS cleared FROM ce WHERE action = 'clear' GROUP BY 1),
 cr AS (SELECT ce.*, {'ts': ts, 'id': id} AS pos FROM ce LEFT JOIN cl USING (user_id) WHERE action != 'clear' AND (cleared IS NULL OR {'ts': ts, 'id': id} > cleared)),
 eg AS (SELECT user_id, product_id, max(pos) AS edge, arg_max(CASE WHEN action = 'set' THEN greatest(quantity, 0) ELSE 0 END, pos) AS start FROM cr WHERE action IN ('set', 'remove') GROUP BY ALL),
 cs AS (SELECT user_id, product_id, coalesce(any_value(start), 0) + sum(CASE WHEN edge IS NOT NULL AND pos <= edge THEN 0 WHEN action IN ('add', 'increment') THEN quantity WHEN action = 'decrement' THEN -quantity ELSE 0 END) AS quantity FROM cr LEFT JOIN eg USING (user_id, product_id) GROUP BY ALL HAVING quantity > 0)"""


def cart(spark, sf_dir):
    action = F.expr("CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'decrement' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'set' ELSE CASE WHEN event_id % 7 = 0 THEN 'clear' ELSE 'increment' END END")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "user_id", (F.get_json_object("props", "$.k").cast("long") % 20).alias("product_id"), (1 + F.col("event_id") % 3).cast("int").alias("quantity"), action.alias("action"))
    return lc.cart_state(rows)


@query(f"WITH {CART} SELECT user_id, product_id, CAST(quantity AS BIGINT) AS quantity FROM cs")
def g7_cart_state(spark, sf_dir):
    return cart(spark, sf_dir)


@query("""WITH RECURSIVE ce AS (SELECT event_id AS id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS product_id, CAST(1 + event_id % 3 AS BIGINT) AS quantity, value AS unit_price, CAST(event_id % 4 - 1 AS BIGINT) AS place,
 CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'set' ELSE CASE WHEN event_id % 7 = 0 THEN 'clear' WHEN event_id % 2 = 0 THEN 'decrement' ELSE 'increment' END END AS action FROM events),
 ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS i FROM ce),
 st AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(p BIGINT, q BIGINT, c DOUBLE)[]) AS lines FROM ce UNION ALL
 SELECT user_id, i, CASE action WHEN 'clear' THEN [] WHEN 'add' THEN CASE WHEN len(list_filter(lines, lambda x: x.p = product_id)) > 0 THEN list_transform(lines, lambda x: CASE WHEN x.p = product_id THEN {'p': x.p, 'q': x.q + quantity, 'c': unit_price} ELSE x END) ELSE list_append(lines, {'p': product_id, 'q': quantity, 'c': unit_price}) END
 ELSE list_filter(list_transform(lines, lambda x, n: CASE WHEN n = spot THEN {'p': x.p, 'q': CASE action WHEN 'set' THEN quantity WHEN 'remove' THEN 0 WHEN 'increment' THEN x.q + 1 ELSE x.q - 1 END, 'c': x.c} ELSE x END), lambda x: x.q > 0) END
 FROM (SELECT e.*, s.lines, CASE WHEN place = -1 THEN len(s.lines) ELSE place + 1 END AS spot FROM st s JOIN ev e ON e.user_id = s.user_id AND e.i = s.i + 1)),
 en AS (SELECT user_id, arg_max(lines, i) AS lines FROM st GROUP BY 1)
 SELECT user_id, CAST(n - 1 AS INTEGER) AS position, lines[n].p AS product_id, lines[n].q AS quantity, lines[n].c AS unit_price FROM (SELECT user_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM en)""")
def g7_cart_lines(spark, sf_dir):
    """Events as actions, some by the place of a line; adds bring the price."""
    action = F.expr("CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'set' ELSE CASE WHEN event_id % 7 = 0 THEN 'clear' WHEN event_id % 2 = 0 THEN 'decrement' ELSE 'increment' END END")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "user_id", (F.get_json_object("props", "$.k").cast("long") % 20).alias("product_id"), (1 + F.col("event_id") % 3).alias("quantity"), F.col("value").alias("unit_price"), (F.col("event_id") % 4 - 1).alias("index"), action.alias("action"))
    return lc.cart_lines(rows)


LINES = PRICED + f""", {CART}, ln AS (SELECT user_id, CAST(quantity AS INTEGER) AS quantity, currency, base_price, CAST(CAST(base_price AS DECIMAL(18,6)) * CAST(quantity AS INTEGER) * CASE currency WHEN 'CNY' THEN 1 WHEN 'USD' THEN 7 END AS DECIMAL(18,2)) AS cny FROM cs JOIN pr USING (product_id)),
 lo AS (SELECT user_id, currency, sum(CAST(CAST(base_price AS DECIMAL(18,6)) * quantity AS DECIMAL(18,2))) AS open FROM ln WHERE cny IS NULL GROUP BY ALL), ul AS (SELECT user_id, string_agg(currency || ' ' || CAST(open AS VARCHAR), ',' ORDER BY currency) AS unresolved_totals FROM lo GROUP BY 1)"""


def cart_lines(spark, sf_dir):
    return cart(spark, sf_dir).join(catalog_view(spark, sf_dir), "product_id").withColumnRenamed("base_price", "unit_price")


@query(LINES + " SELECT user_id, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(coalesce(sum(cny), 0) AS DOUBLE) AS total_cny, count(*) FILTER (WHERE cny IS NULL) AS unresolved, any_value(unresolved_totals) AS unresolved_totals FROM ln LEFT JOIN ul USING (user_id) GROUP BY 1")
def g8_cart_totals(spark, sf_dir):
    out = lc.cart_totals(cart_lines(spark, sf_dir), rates(spark))
    return out.withColumn("total_cny", F.col("total_cny").cast("double")).withColumn("unresolved_totals", F.nullif(F.array_join(F.transform("unresolved_totals", lambda x: F.concat_ws(" ", x["currency"], x["total"].cast("string"))), ","), F.lit("")))


@query(LINES + " SELECT user_id, CAST(coalesce(sum(CAST(CASE currency WHEN 'USD' THEN CAST(base_price AS DECIMAL(18,6)) * quantity WHEN 'CNY' THEN CAST(base_price AS DECIMAL(18,6)) * quantity * CAST(0.142857 AS DECIMAL(18,6)) END AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, count(*) FILTER (WHERE currency = 'JPY') AS unresolved FROM ln GROUP BY 1")
def g8_settle_total(spark, sf_dir):
    """Carts settled in USD: each line is rounded on its own."""
    pairs = spark.createDataFrame([("USD", "USD", "1"), ("CNY", "USD", "0.142857")], "currency string, target string, rate string").withColumn("rate", F.col("rate").cast("decimal(18,6)"))
    out = lc.settle_total(cart_lines(spark, sf_dir), pairs, "USD")
    return out.withColumn("total", F.col("total").cast("double"))


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS product_id FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1")
def g9_favorites(spark, sf_dir):
    return lc.favorites(read(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", (F.get_json_object("props", "$.k").cast("long") % 50).alias("product_id")))


@query(PRICED + f", gm AS (SELECT l_orderkey AS group_id, count(DISTINCT l_suppkey) AS filled FROM lineitem GROUP BY 1) SELECT o_orderkey AS group_id, product_id, coalesce(filled, 0) AS filled, greatest(CAST(2 + o_orderkey % 5 AS BIGINT) - coalesce(filled, 0), 0) AS remaining, CASE WHEN coalesce(filled, 0) >= 2 + o_orderkey % 5 THEN 'complete' WHEN o_orderdate <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'open' END AS status, CAST(CAST(CAST(price_cny AS DECIMAL(18,4)) * 0.85 AS DECIMAL(18,2)) AS DOUBLE) AS group_price, CAST(greatest(epoch(o_orderdate) - epoch(TIMESTAMP '{NOW}'), 0) AS BIGINT) AS seconds_left FROM orders JOIN pr ON product_id = o_orderkey % 3000 LEFT JOIN gm ON o_orderkey = group_id")
def g10_group_status(spark, sf_dir):
    groups = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), (F.col("o_orderkey") % 3000).alias("product_id"), F.col("o_custkey").alias("opener_id"), (2 + F.col("o_orderkey") % 5).alias("target_size"), F.col("o_orderdate").alias("expires_at"))
    members = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("user_id"))
    return lc.group_status(groups, members, priced(spark, sf_dir), now()).drop("opener_id").withColumn("group_price", F.col("group_price").cast("double"))


@query("SELECT o_custkey AS opener_id, o_orderkey AS group_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS position FROM orders")
def g10_opener_groups(spark, sf_dir):
    """Every opener's groups, newest first."""
    groups = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_custkey").alias("opener_id"), F.col("o_orderdate").alias("created_at"))
    return lc.opener_groups(groups).select("opener_id", "group_id", "position")


@query("SELECT l_partkey AS product_id, max(l_shipdate) AS shipped, arg_max(l_orderkey, {'s': l_shipdate, 'o': l_orderkey, 'n': l_linenumber}) AS orderkey, arg_max(l_linenumber, {'s': l_shipdate, 'o': l_orderkey, 'n': l_linenumber}) AS line FROM lineitem GROUP BY 1")
def a3_latest_by_key(spark, sf_dir):
    """The last shipped line of every product; the later order and line at ties."""
    return lc.latest_by_key(read(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("shipped"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"))


@query("SELECT p_partkey AS product_id, CASE WHEN value IS NULL THEN p_retailprice ELSE value END AS price FROM part LEFT JOIN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, arg_max(value, {'ts': ts, 'id': event_id}) AS value FROM events WHERE event_type = 'view' GROUP BY 1) ON k = p_partkey")
def a7_upsert(spark, sf_dir):
    prices = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id"))
    updates = read(spark, sf_dir, "events").where("event_type = 'view'").select(F.get_json_object("props", "$.k").cast("long").alias("product_id"), F.col("value").alias("price"), "ts", "event_id")
    return lc.upsert(prices, updates.join(prices.select("product_id"), "product_id", "left_semi"), ["product_id"], ["ts", "event_id"]).select("product_id", "price")
