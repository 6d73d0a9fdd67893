"""Rules and work lists on rows whose results are worked out by hand."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loomline.functions import scalars
from loomline.plans import models, rules, schedule, summaries

DAY = rules.DAY


def test_rule_risk_and_features(spark):
    works = spark.createDataFrame([("a", 10 * DAY, "CM"), ("a", 5 * DAY, "PM"), ("a", 3 * DAY, "EM"), ("b", 90 * DAY, "PM")], "machine string, txn_us long, work_type string")
    hours = spark.createDataFrame([("a", 11 * DAY, 5.0, 60_000.0), ("a", 9 * DAY, 100.0, 1.0), ("b", 95 * DAY, None, 7.0), ("c", 0, 1.0, 1.0)], "machine string, hour_us long, good_qty double, energy_kwh double")
    got = {r.machine: r for r in rules.rule_risk(rules.maintenance_features_of(hours, works, 101, none_since=20)).collect()}
    a = got["a"]
    assert (a.days_since, a.units_since, a.kwh_since, a.works, a.failures, a.preventive, a.score, a.risk) == (91, 5.0, 60_000.0, 3, 2, 1, 100, "HIGH")
    assert (got["b"].days_since, got["b"].score, got["b"].risk, got["b"].advice) == (11, 0, "LOW", "Continue normal operation")
    assert (got["c"].days_since, got["c"].works, got["c"].score, got["c"].risk) == (81, 0, 20, "LOW")


def test_label_is_unknown_where_the_horizon_passes_the_last_work(spark):
    columns = ["energy_kwh", "good_qty", "production_minutes", "setup_minutes", "planned_stop_minutes", "unplanned_stop_minutes", "idle_minutes"]
    hours = spark.createDataFrame([("a", d * DAY, *[1.0] * 7, 0) for d in (1, 2, 9, 14)], f"machine string, hour_us long, {', '.join(c + ' double' for c in columns)}, works_ever int")
    works = spark.createDataFrame([("a", 2 * DAY, "PM"), ("a", 2 * DAY + 5, "CM"), ("a", 20 * DAY, "CM"), ("z", 19 * DAY, "PM")], "machine string, txn_us long, work_type string")
    got = {r.d: r for r in rules.labelled_days(hours, works, horizon=10).collect()}
    assert {d: r.label for d, r in got.items()} == {1: 1, 2: 0, 9: 0, 14: None}
    assert {d: (r.past, r.past_30d, r.pm_ratio, r.days_since) for d, r in got.items()} == {1: (0, 0, 0.0, None), 2: (2, 2, 0.5, 0), 9: (2, 2, 0.5, 7), 14: (2, 2, 0.5, 12)}


def test_greedy_takes_urgent_jobs_first_and_counts_changes():
    tier = "Material + task history"
    row = lambda job, urgency, material, machine, score, reason=None: (job, "f", material, urgency, 100.0, machine, tier, score, reason, 10.0)
    rows = [row("low", "Low", "x", "m1", 1.0), row("low", "Low", "x", "m2", 20.0), row("high", "High", "y", "m1", 5.0), row("high", "High", "y", "m2", 7.0), row("none", "High", "y", "m3", 1.0, "maintenance_blackout")]
    got = schedule.assign(pd.DataFrame(rows, columns=["job", "family", "material", "urgency", "quantity", "machine", "tier", "score", "exclude_reason", "changeover"]))
    got = {r.job: (r.machine, r.slot, r.score) for r in got.itertuples()}
    assert got["high"] == ("m1", 1.0, 5.0)
    assert got["low"] == ("m1", 2.0, 1.0 + 10.0 + 3.5)  # another material before it, and a share for the second slot
    assert got["none"][0] is None


def test_candidates_have_tiers_penalties_and_blackouts(spark):
    queue = spark.createDataFrame([("j", "f", "x", "t", "Easy", 50.0, "High")], "job string, family string, material string, task string, difficulty string, quantity double, urgency string")
    profiles = spark.createDataFrame([("a", "f", 2.0, 10.0, 8, 240, 0.0), ("b", "f", 2.0, 900.0, None, None, None), ("c", "f", None, None, 3, 60, 0.2), ("d", "f", 1.0, 3000.0, None, None, None)], "machine string, family string, kwh_per_good double, hours_since double, total_events long, days_since long, pm_ratio double")
    inputs = spark.createDataFrame([("a", "x", "t", "Easy", 1.0), ("b", "x", "u", "Easy", 1.0), ("c", "x", "u", "Hard", 1.0)], "machine string, material string, task string, difficulty string, good_qty double")
    context = spark.createDataFrame([(1.5, 10.0)], "price double, changeover double")
    got = {r.machine: r for r in schedule.candidates(queue, profiles, schedule.support(inputs), context).collect()}
    assert [got[m].tier for m in "abcd"] == ["Material + task history", "Material + task-difficulty history", "Material history only", "Machine-family fallback"]
    assert [got[m].exclude_reason for m in "abcd"] == ["maintenance_blackout", None, None, "maintenance_blackout"]
    assert [got[m].maintenance_penalty for m in "abcd"] == pytest.approx([10 * (0.7 + 0.35), 10 * 0.15, 10 * (0.175 + 0.15 + 0.10), 11.0])
    assert [got[m].support_penalty for m in "abcd"] == pytest.approx([0, 1.0, 2.0, 5.5])
    assert got["b"].score == pytest.approx(150 + 1.5 + 1.0) and got["c"].score == pytest.approx(0 + 4.25 + 2.0 + 6.5)


def test_urgency_by_place_in_the_queue(spark):
    queue = spark.createDataFrame([(str(q), float(q)) for q in (10, 20, 30, 40, 50)], "job string, quantity double")
    assert {r.job: r.urgency for r in schedule.with_urgency(queue).collect()} == {"10": "Low", "20": "Low", "30": "Medium", "40": "High", "50": "High"}


def test_review_weighs_the_gap_to_peers(spark):
    rows = [("024-1", "024", "Easy", 1, 10.0, ""), ("024-2", "024", "Easy", 1, 10.0, "x"), ("024-3", "024", "Easy", 1, 10.0, ""), ("024-4", "024", "Easy", 1, 10.0, "team_size_from_preprocessor_default")]
    candidates = spark.createDataFrame(rows, "machine string, family string, difficulty string, hour_us long, good_qty double, notes string")
    predicted = spark.createDataFrame([(m, 1, p, 0.5) for m, p in zip((r[0] for r in rows), (1.0, 3.0, 2.0, 5.0), strict=True)], "machine string, hour_us long, predicted double, confidence double")
    got = {r.machine: (r.support_path, r.baseline, r.gap, r.priority) for r in rules.review(candidates, predicted).collect()}
    assert got["024-4"] == ("Defaulted row", 2.0, 3.0, pytest.approx(3.0 * 10 * 0.5 * 0.65))
    assert got["024-2"] == ("Adapted row", 2.0, 1.0, pytest.approx(10 * 0.5 * 0.85)) and got["024-1"][3] == 0


def test_idle_categories_speeds_and_machine_names(spark):
    hours = [(dt.datetime(2024, 1, day, h), want) for day, h, want in ((6, 12, "weekend_idle"), (2, 3, "overnight_idle"), (2, 12, "lunch_idle"), (2, 7, "shift_change_idle"), (2, 23, "shift_change_idle"), (2, 9, "unexplained_working_idle"), (2, 19, "evening_idle"))]
    assert all(r.got == r.want for r in spark.createDataFrame(hours, "t timestamp, want string").select(scalars.idle_category(F.col("t")).alias("got"), "want").collect())
    speeds = [(999.0, "024-1", False), (1000.0, "024-1", True), (600.0, "035-9", True), (150.0, "777", True), (None, "024-1", False), (-5.0, "777", False)]
    assert all(r.got == r.want for r in spark.createDataFrame(speeds, "s double, m string, want boolean").select(scalars.valid_speed(F.col("s"), F.col("m")).alias("got"), "want").collect())
    names = [("印刷機 024-035(166-001)", "024-035"), ("D-024-007", "024-007"), ("1024-00035 主機", "024-035"), ("UV only", None)]
    assert all(r.got == r.want for r in spark.createDataFrame(names, "n string, want string").select(scalars.machine_pattern(F.col("n")).alias("got"), "want").collect())


def test_audit_status_sees_a_conflict_of_flags(spark):
    rows = spark.createDataFrame([(None, None, None, None, 0, None, None, "missing_source_row_hash"), ("h", 5.0, None, None, 0, None, None, "preserved_existing_landed_positive_basis"), ("h", None, "x", None, 0, None, None, "excluded_minute_budget_anomaly"), ("h", None, None, 4.0, 1, None, "g", "blocked_dominant_identity_conflict"), ("h", None, None, 4.0, 1, None, None, "reconstructed_from_source_flags_missing_dominant_hash_flag"), ("h", None, None, 4.0, 0, None, "h", "reconstructed_from_source_flags_matching_dominant_hash"), ("h", None, None, None, 1, 9.0, "h", "missing_positive_dominant_basis_evidence"), ("h", None, None, None, 0, 9.0, "h", "single_event_row_production_minutes"), ("h", None, None, None, 0, None, "h", "missing_positive_dominant_basis_evidence")], "job_hash string, row_basis double, budget_anomaly string, lead_production double, several_jobs int, production_minutes double, flagged string, want string")
    assert all(r.got == r.want for r in rows.select(summaries.audit_status(F.col("flagged")).alias("got"), "want").collect())


def test_month_labels_in_calendar_order_and_weighted_sample(spark):
    months = spark.createDataFrame([(m,) for m in ("March 2024", "December 2023", "no month", "January 2024")], "month_key string")
    assert [r.month_key for r in summaries.month_places(months).orderBy("place").collect()] == ["December 2023", "January 2024", "March 2024", "no month"]
    kinds = spark.createDataFrame([(f"k{i}", 1000 if i < 3 else 1) for i in range(60)], "k string, w int")
    got = [r.k for r in summaries.weighted_sample(kinds, "w", ["k"], 5).collect()]
    assert len(set(got)) == 5 and {"k0", "k1", "k2"} <= set(got)


def test_share_of_an_order_over_months(spark):
    rows = spark.createDataFrame([(1, 1, 10.0, dt.datetime(1997, 3, 31, 23)), (1, 2, 30.0, dt.datetime(1997, 4, 1)), (2, 1, 5.0, dt.datetime(1997, 4, 2))], "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
    assert [tuple(r) for r in summaries.month_shares(rows, "1997-03").collect()] == [(1, 1, "1997-03", 0.25)]


def test_promotion_needs_no_worse_a_score():
    assert models.promotes(0.80, None) and models.promotes(0.80, 0.80) and not models.promotes(0.5, 0.9)


def test_weak_label_model_after_an_observation(spark):
    days = spark.range(100).select(F.col("id").alias("d"), (F.col("id") % 3 > 0).cast("int").alias("label"), *[(F.col("id") % n).alias(c) for c, n in (("kwh_30d", 7), ("prod_30d", 5), ("past_30d", 4), ("days_30d", 3), ("works", 2))])
    seen = Observation("rows")
    assert days.observe(seen, F.count("*").alias("n")).count() == 100 and seen.get == {"n": 100}
    model, result = models.weak_label_model(days)
    assert [r[:2] for r in result.collect()] == [(80, 20)] and model.transform(days.limit(3)).count() == 3


def test_figures_are_of_a_month(spark):
    from loomline.plans import summaries

    hour = 3_600_000_000
    january, february = 1_704_067_200_000_000, 1_706_745_600_000_000
    rows = spark.createDataFrame([("a", january + h * hour, 1.0, 2.0, None, "production", 0.5) for h in range(120)] + [("a", february + h * hour, 1.0, None, None, None, None) for h in range(3)] + [("b", february, 2.0, 4.0, 1.0, None, 0.5)], "machine string, hour_us long, energy_kwh double, good_qty double, scrap_qty double, machine_state string, kpu double")
    got = {(r.machine, r.month_key): (r.hours, r.status, r.utilization) for r in rules.activity(rows).collect()}
    assert got == {("a", "2024-01"): (120, "Active", 16.7), ("a", "2024-02"): (3, "Idle", 0.4), ("b", "2024-02"): (1, "Idle", 0.1)}
    got = {r.month_key: (r.n_rows, r.machines, r.without_state, r.good) for r in summaries.month_metrics(rows).collect()}
    assert got == {"2024-01": (120, 1, 0, 240.0), "2024-02": (4, 2, 4, 4.0)}
    ready = spark.createDataFrame([("a", january, 1), ("a", february, 0), ("b", february, 1)], "machine string, hour_us long, eligible int")
    assert {r.month_key: (r.n_rows, r.eligible_rows, r.blocked_rows) for r in summaries.readiness_metrics(ready).collect()} == {"2024-01": (1, 1, 0), "2024-02": (2, 1, 1)}
