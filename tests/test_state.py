"""Stored tables: changes rewrite the parts they touch; due scans read due days."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from tallymart.operators import lifecycle as lc
from tallymart.sources.state import by_day, by_key


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/part=*/**/*.parquet", recursive=True)}


def table(df):
    return sorted(tuple(r) for r in df.collect())


def test_few_updates_rewrite_few_parts(spark, tmp_path):
    path = str(tmp_path / "watches")
    rows = spark.range(5000).select("id", (F.col("id") % 700).alias("user_id"), F.lit(1.0).alias("target"))
    stored = by_key(spark, path, ["id"], 32).create(rows)
    before, first = files(path), stored.manifest()
    updates = spark.createDataFrame([(7, 7, 2.0), (9, 9, 3.0), (9, 9, 4.0), (9000, 1, 5.0)], "id long, user_id long, target double")
    touched = stored.change(updates, ("target",))
    assert 1 <= len(touched) <= 3 and stored.manifest()["number"] == 1
    new = {re.match("part=([^/]+)/version=1/", f).group(1) for f in files(path) - before}
    assert new == touched and before <= files(path)  # nothing that a reader may hold is gone
    assert all(v == first["parts"][p] for p, v in stored.manifest()["parts"].items() if p not in touched)
    expected = lc.upsert(rows, updates, ["id"], ["target"])
    assert table(stored.rows()) == table(expected)
    stored.vacuum(1)
    assert table(stored.rows()) == table(expected) and len(files(path)) == len(stored.manifest()["parts"])


def test_keys_that_go_and_parts_that_empty(spark, tmp_path):
    stored = by_key(spark, str(tmp_path / "t"), ["a", "b"], 4).create(spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "a long, b string, n int"))
    stored.change(gone=spark.createDataFrame([(1, "x"), (3, "z")], "a long, b string"))
    assert table(stored.rows()) == [(2, "y", 2)]
    stored.change(gone=spark.createDataFrame([(2, "y")], "a long, b string"))
    assert table(stored.rows()) == [] and stored.manifest()["parts"] == {}
    stored.change(spark.createDataFrame([(5, "q", 9)], "a long, b string, n int"))
    assert table(stored.rows()) == [(5, "q", 9)]


def test_two_changes_at_a_time_do_not_lose_one(spark, tmp_path):
    stored = by_key(spark, str(tmp_path / "t"), ["a"], 4).create(spark.createDataFrame([(1, 1)], "a long, n int"))
    held = stored.manifest()
    stored.change(spark.createDataFrame([(2, 2)], "a long, n int"))
    with pytest.raises(Exception, match="(?i)exist"):
        stored._publish(held["number"] + 1, held["schema"], held["parts"])
    assert table(stored.rows()) == [(1, 1), (2, 2)]


def test_due_scan_reads_due_days_and_snoozed_rows_move(spark, tmp_path):
    path = str(tmp_path / "due")
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    rows = spark.range(400).select("id", (F.col("id") % 20).alias("user_id"), (F.col("id") % 7).alias("product_id"), F.expr("timestamp'2024-02-01 08:00:00' + make_interval(0, 0, 0, int(id % 80))").alias("next_due_at"), F.lit(None).cast("timestamp").alias("last_shown_at"))
    plain = rows
    stored = lc.due_table(spark, path, rows)
    scan = lc.due_scan(stored, now)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    listed = set(re.findall(r"part=(\d{4}-\d\d-\d\d)", " ".join(scan.inputFiles())))
    assert listed and max(listed) == "2024-03-10" and len(stored.manifest()["parts"]) == 80 and "part" in plan
    for hours in (0, 1, 30):
        at = now + F.expr(f"make_interval(0, 0, 0, 0, {hours})")
        got = lc.due_rows(lc.due_scan(stored, at), at, 3)
        expected = lc.due_rows(plain, at, 3)
        assert table(got.select("id", "position")) == table(expected.select("id", "position"))
        shown = spark.createDataFrame([(r.id,) for r in expected.collect()], "id long")
        plain = spark.createDataFrame(lc.mark_shown(plain, shown, at).select(*plain.columns).collect(), plain.schema)
        touched = lc.mark_shown_stored(stored, shown, at)
        assert table(stored.rows().select(*plain.columns)) == table(plain) and len(touched) < 60
