from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.vocabulary import HOUR_US
from loomline.operators import timeops as T

M = 60_000_000


def test_an_end_on_the_hour_touches_no_further_hour(spark):
    events = spark.createDataFrame([("a", 0, HOUR_US), ("b", HOUR_US - 1, HOUR_US + 1), ("c", 5, 5)], "k string, s long, e long")
    rows = T.spread_over_hours(events, "s", "e").select("k", "hour_us").collect()
    assert sorted((r.k, r.hour_us) for r in rows) == [("a", 0), ("b", 0), ("b", HOUR_US)]


def test_union_of_nested_touching_equal_and_apart_intervals(spark):
    data = [("n", 0, 30), ("n", 10, 20), ("t", 0, 10), ("t", 10, 25), ("q", 5, 15), ("q", 5, 15), ("d", 0, 10), ("d", 30, 40), ("f", 0, 70)]
    rows = spark.createDataFrame([(k, s * M, e * M) for k, s, e in data], "k string, s long, e long")
    assert {r.k: r.coverage for r in T.union_minutes(rows, ["k"]).collect()} == {"n": 30, "t": 25, "q": 10, "d": 20, "f": 60}


def test_asof_is_strictly_before_and_ties_go_by_order(spark):
    hours = spark.createDataFrame([("m", HOUR_US), ("m", 2 * HOUR_US), ("x", HOUR_US)], "machine string, hour_us long")
    events = spark.createDataFrame([("m", 10, "a", "PM"), ("m", 10, "b", "CM"), ("m", 2 * HOUR_US, "c", "EM")], "machine string, t0 long, hash string, kind string")
    got = {(r.machine, r.hour_us): (r.last_hash, r.last_kind) for r in T.asof_before(hours, events, "machine", "t0", "hash", ["hash", "kind"]).collect()}
    assert got == {("m", HOUR_US): ("b", "CM"), ("m", 2 * HOUR_US): ("b", "CM"), ("x", HOUR_US): (None, None)}


def test_trailing_sets_leave_the_hour_itself_out_and_count_rows_only_without_ids(spark):
    hours = spark.createDataFrame([("m", h * HOUR_US) for h in (0, 1, 30)], "machine string, hour_us long")
    events = spark.createDataFrame([("m", 5, None), ("m", 6, None), ("m", HOUR_US + 1, "w"), ("m", HOUR_US + 2, "w")], "machine string, t0 long, wo string")
    got = {r.hour_us // HOUR_US: (r.day, r.in_hour) for r in T.trailing_sets(hours, events, "machine", "t0", "wo", {"day": 24}).collect()}
    assert got == {0: (0, 2), 1: (2, 1), 30: (0, 0)}


def test_allocation_sums_back_to_the_total(spark):
    rows = spark.createDataFrame([("j", 10.0, 90.0), ("j", 20.0, 90.0), ("j", None, 90.0), (None, 5.0, 7.0)], "g string, b double, total double")
    got = T.allocate(rows, "g", F.col("b"), "total", "share").collect()
    assert sorted(r.share for r in got if r.share is not None) == [30.0, 60.0]
