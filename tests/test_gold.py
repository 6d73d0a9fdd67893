from __future__ import annotations

import pytest

from loomline.functions.vocabulary import CAPPED, HOUR_US
from loomline.plans import gold, readers

M = 60_000_000
METER = "machine string, hour_us long, component string, kwh double, cost double, hash string"
JOB = "machine string, hash string, prod_start_us long, prep_end_us long, prod_end_us long, changeover int, order_id string, suffix string, material string, leader string, task string, job_good double, job_scrap double, prod_min double, planned_min double, unplanned_min double"
REPORT = "machine string, hash string, report_us long, order_id string, suffix string, manpower double"
WORK = "machine string, hash string, txn_us long, work_order string, work_type string"


def job(name, start, end, prod=60.0, **more):
    row = {"machine": "024-001", "hash": name, "prod_start_us": start, "prep_end_us": start, "prod_end_us": end, "changeover": 0, "order_id": "o", "suffix": "1.0", "material": "m", "leader": "l", "task": "Printing", "job_good": 100.0, "job_scrap": 4.0, "prod_min": prod, "planned_min": 0.0, "unplanned_min": 0.0}
    return tuple((row | more).values())


def make(spark, meters, jobs=(), reports=(), works=()):
    frames = [spark.createDataFrame(list(d), s) for d, s in ((meters, METER), (jobs, JOB), (reports, REPORT), (works, WORK))]
    return {(r.machine, r.hour_us // HOUR_US): r for r in gold.machine_hours(*frames).collect()}


HOURS = [("024-001", h * HOUR_US, "main", 10.0, 1.5, f"e{h}") for h in range(4)]


def test_a_total_meter_is_preferred_and_a_combo_is_left_out(spark):
    rows = [("a", 0, "aggregate_total", 50.0, 5.0, "1"), ("a", 0, "main", 30.0, 3.0, "2"), ("b", 0, "main", 1.0, None, "3"), ("b", 0, "uv", 2.0, None, "4"), ("c", 0, "combo", 9.0, 1.0, "5"), (None, 0, "main", 1.0, 1.0, "6"), (" ", 0, "main", 1.0, 1.0, "7")]
    got = {r.machine: r for r in gold.backbone(spark.createDataFrame(rows, METER)).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].energy_kwh, got["a"].energy_method) == (50.0, "aggregate_total_preferred")
    assert (got["b"].energy_kwh, got["b"].energy_cost) == (3.0, None)
    assert (got["c"].energy_kwh, got["c"].energy_method) == (None, "combo_present_no_safe_total")


def test_noise_of_summation_is_no_budget_anomaly(spark):
    got = make(spark, HOURS, [job("x", 0, HOUR_US, prod=None), job("y", 0, 2_030_000_000, prod=None)])
    row = got["024-001", 0]
    assert (row.n_jobs, row.coverage, row.production_minutes, row.budget_anomaly) == (2, 60.0, 60.0, None)


def test_two_competing_jobs_share_the_hour(spark):
    got = make(spark, HOURS, [job("x", 0, HOUR_US), job("b", 0, HOUR_US)])
    row = got["024-001", 0]
    assert (row.coverage, row.production_minutes, row.scale, row.contract, row.job_hash) == (60.0, 60.0, 0.5, CAPPED, "b")
    assert row.machine_state == "production" and row.state_confidence == "medium"


def test_grain_and_conservation_of_pieces(spark):
    got = make(spark, HOURS, [job("x", 30 * M, 2 * HOUR_US + 30 * M, 120.0)])
    assert len(got) == len(HOURS)
    assert sum(r.good_qty for r in got.values() if r.good_qty) == pytest.approx(100.0)
    assert sum(r.scrap_qty for r in got.values() if r.scrap_qty) == pytest.approx(4.0)
    assert got["024-001", 3].machine_state is None


def test_reports_prefer_manpower_then_the_nearest(spark):
    reports = [("024-001", "r1", HOUR_US, "o", "1", 0.0), ("024-001", "r2", 5 * HOUR_US, "o", "1", 2.5), ("024-001", "r3", 30 * HOUR_US, "o", "1", 9.0), ("024-001", "r4", HOUR_US, "other", "1", 9.0)]
    row = make(spark, HOURS, [job("x", 0, HOUR_US)], reports)["024-001", 0]
    assert (row.report_hash, row.team_size) == ("r2", 2.0)


def test_maintenance_of_the_same_hour_is_no_history_and_takes_only_free_hours(spark):
    works = [("024-001", "w1", 2 * HOUR_US + 5, "w", "PM"), ("024-001", "w2", 5, "w", "CM")]
    got = make(spark, HOURS, [job("x", 0, HOUR_US)], works=works)
    assert got["024-001", 2].machine_state == "maintenance" and got["024-001", 2].last_hash == "w2" and got["024-001", 2].works_ever == 1
    assert got["024-001", 0].machine_state == "production" and got["024-001", 0].last_hash is None
    assert got["024-001", 0].promotion_blocked == "maintenance_state_conflicting_operational_minutes"


def test_idle_is_the_rest_of_a_wholly_covered_hour(spark):
    row = make(spark, HOURS, [job("x", 0, HOUR_US, 40.0)])["024-001", 0]
    assert row.idle_minutes == pytest.approx(20.0) and row.machine_state == "production"


def test_energy_goes_by_minutes_then_state(spark):
    fact = spark.createDataFrame([("a", 0, 120.0, "production", 30.0, 30.0, 40.0), ("b", 0, 20.0, "maintenance", None, None, None), ("c", 0, 15.0, "energy_only", None, None, None)], "machine string, hour_us long, energy_kwh double, machine_state string, production_minutes double, idle_minutes double, good_qty double")
    for c in ("setup_minutes", "planned_stop_minutes", "unplanned_stop_minutes", "maintenance_minutes"):
        fact = fact.selectExpr("*", f"cast(null as double) as {c}")
    got = {r.machine: r for r in readers.energy_rows(fact).collect()}
    assert (got["a"].production_kwh, got["a"].idle_kwh, got["a"].kwh_per_good) == (60.0, 60.0, 3.0)
    assert got["b"].maintenance_kwh == 20.0 and got["c"].unallocated_kwh == 15.0


def test_empty_inputs_give_an_empty_fact(spark):
    assert make(spark, []) == {}
