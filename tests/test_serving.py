"""Guards, previews, advice, months and replacement on rows whose results are worked out by hand."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from loomline.plans import months, schedule, serving


def test_guard_takes_only_believable_predictions(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 20.0), (3, -0.1), (4, 20.1), (5, float("nan")), (6, None)], "k int, p double")
    got = {r.k: (r.predicted, r.blocked_reason) for r in serving.guarded(rows, F.col("p")).collect()}
    refused = (None, "predictor_returned_non_model_source")
    assert got == {1: (0.0, None), 2: (20.0, None), 3: refused, 4: refused, 5: refused, 6: refused}
    assert {r.blocked_reason for r in serving.predict_rows(None, rows).collect()} == {"predictor_artifacts_unavailable"}


def test_blocked_rows_and_seeds(spark):
    kind = "machine string, hour_us long, eligible int, blocked_reason string, material string"
    rows = spark.createDataFrame([("a", 1, 0, "x", "m"), ("a", 1, 0, "x", "n"), ("a", 2, 1, None, "m"), ("a", 3, 1, None, "n"), ("b", 1, 1, None, "m")], kind)
    refused = rows.filter("machine = 'b'").withColumn("blocked_reason", F.lit("y"))
    assert sorted((r.machine, r.hour_us, r.blocked_reason) for r in serving.blocked(rows, refused).collect()) == [("a", 1, "x"), ("b", 1, "y")]
    predicted = spark.createDataFrame([("a", 2, 1.5), ("a", 1, 9.0)], "machine string, hour_us long, predicted double")
    got = {r.machine: (r.hour_us, r.material, r.prediction_us, r.predicted) for r in serving.seeds(rows.filter("eligible = 1"), predicted).collect()}
    assert got == {"a": (3, "n", 2, 1.5), "b": (1, "m", None, None)}


def test_recommendations_and_savings(spark):
    day = serving.DAY
    rows = spark.createDataFrame([("a", 40 * day, 6.0, 1200.0, "x"), ("a", 5 * day, 100.0, 0.0, "y"), ("b", 40 * day, 2.0, 3.0, None), ("c", 40 * day, None, 5000.0, None)], "machine string, hour_us long, kpu double, hours_since double, leader string")
    got = sorted((r.machine, r.kind, r.priority, r.expected_savings) for r in serving.recommendations(rows, F.lit(41 * day)).collect())
    assert got == [("a", "Efficiency", "Medium", 3 * 1000 * 663.0), ("a", "Maintenance", "High", 663.0 * 72)]
    parts = spark.range(1).select([c.alias(n) for n, c in serving.savings(F.lit(-0.1)).items()]).first()
    assert round(parts.total_month, 3) == round(1600 * (663 + 704 + 136.7 + 100) + 24 * 1367, 3)
    base = spark.createDataFrame([(100.0,)], "base double")
    got = [(r.month, round(r.savings, 6), round(r.saved_before, 6)) for r in serving.projection(base).orderBy("month").collect()]
    assert got[:3] == [(1, 100.0, 0.0), (2, 105.0, 100.0), (3, 110.0, 205.0)] and len(got) == 12


def test_promotion_gate():
    good = {"r2": 0.5, "mae": 1.0, "rmse": 2.0}
    assert serving.promotion_gate(good, {"r2": 0.5}, ["a"], ["a"], 1.0)["promote"]
    assert not serving.promotion_gate(good, {"r2": 0.6}, ["a"], ["a"], 1.0)["promote"]
    assert not serving.promotion_gate(good, None, ["b"], ["a"], 1.0)["promote"]
    assert not serving.promotion_gate(good, None, ["a"], ["a"], None)["promote"]
    assert not serving.promotion_gate({"r2": 0.5}, None, ["a"], ["a"], 1.0)["promote"]


def test_month_columns(spark):
    row = spark.createDataFrame([("February 2024", "no month", dt.datetime(2025, 1, 31, 5, 6, 7), dt.datetime(2025, 3, 1), None)], "a string, b string, t timestamp, u timestamp, v timestamp")
    got = row.select(
        months.month_start(F.col("a")).alias("s"), months.month_end(F.col("a")).alias("e"), months.month_start(F.col("b")).alias("none"),
        months.moved_to_month(F.col("t"), F.lit("2025-02-01")).cast("string").alias("moved"), months.first_month(F.col("v"), F.col("u"), F.col("t")).alias("first"),
        months.order_suffix_any(F.lit("A.0")).alias("loose"), months.asset_machine(F.lit("1024-00094"), F.lit(None)).alias("own"), months.asset_machine(F.lit("X9"), F.lit("024-094")).alias("old"), months.asset_machine(F.lit("1024"), F.lit("")).alias("neither"),
    ).first()
    assert (got.s, got.e, got.none) == (dt.date(2024, 2, 1), dt.date(2024, 3, 1), None)
    assert (got.moved, got["first"], got.loose, got.own, got.old, got.neither) == ("2025-03-03 05:06:07", "2025-03", "A", "024-094", "024-094", None)


def test_links_take_the_registry_first(spark):
    works = spark.createDataFrame([("r", "1024-00001", None), (None, "1024-00001", None), (None, "M1", "zzz"), ("q", "none", None), (None, None, None)], "canonical_id string, asset string, old_id string")
    matched = spark.createDataFrame([("r", "M0"), ("024-001", "M9"), ("w", "M1")], "machine string, report_id string")
    got = sorted(((r.linked, r.matched) for r in months.link_works(works, matched).collect()), key=str)
    assert got == sorted([("r", 1), ("024-001", 1), ("w", 1), ("q", 0), (None, 0)], key=str)


def test_replacement_is_refused_unless_all_is_conserved(spark):
    kind = "job_hash string, good_qty double, scrap_qty double, shadow_good double, shadow_scrap double, shadow_eligible int"
    fine = spark.createDataFrame([("j", 6.0, None, 4.0, None, 1), ("j", 4.0, None, 6.0, None, 1), ("k", 1.0, 1.0, 1.0, 1.0, 0)], kind)
    written = []
    assert months.replace_guarded(fine, lambda df: written.extend(df.collect())) == {"changed_out_of_scope": 0, "negative": 0, "not_conserved": 0}
    assert sorted(r.good_qty for r in written) == [1.0, 4.0, 6.0]
    bad = spark.createDataFrame([("j", 6.0, None, -4.0, None, 1), ("k", 1.0, 1.0, 2.0, 1.0, 0)], kind)
    written.clear()
    assert months.replace_guarded(bad, lambda df: written.append(df)) == {"changed_out_of_scope": 1, "negative": 1, "not_conserved": 2}
    assert not written
    assert months.replacement_checks(fine.limit(0)).count() == 3


def test_a_failed_month_does_not_stop_the_others():
    def run(month):
        if month == "2":
            raise ValueError("no rows")

    assert months.backfill(["1", "2", "3"], run) == {"1": "done", "2": "failed: no rows", "3": "done"}


def _candidates(*rows):
    tier = "Material + task history"
    return pd.DataFrame([(job, "f", material, urgency, 100.0, machine, tier, score, reason, 10.0) for job, material, urgency, machine, score, reason in rows], columns=["job", "family", "material", "urgency", "quantity", "machine", "tier", "score", "exclude_reason", "changeover"])


def test_swap_lowers_the_sum_and_keeps_to_what_is_allowed():
    rows = _candidates(("a", "x", "High", "m1", 1.0, None), ("a", "x", "High", "m2", 2.0, None), ("b", "x", "Low", "m1", 1.0, None), ("b", "x", "Low", "m2", 9.0, None))
    plan = schedule.assign(rows, most_per_machine=1)
    assert {r.job: (r.machine, r.score) for r in plan.itertuples()} == {"a": ("m1", 1.0), "b": ("m2", 9.0)}
    assert {r.job: (r.machine, r.score) for r in schedule.best_swap(plan, rows).itertuples()} == {"a": ("m2", 2.0), "b": ("m1", 1.0)}
    shut = rows.assign(exclude_reason=[None, "maintenance_blackout", None, None])
    assert schedule.best_swap(plan, shut).equals(plan)


def test_naive_takes_jobs_by_name_to_the_first_free_machine():
    rows = _candidates(("b", "y", "High", "m1", 1.0, None), ("b", "y", "High", "m2", 5.0, None), ("a", "x", "Low", "m1", 9.0, None), ("a", "x", "Low", "m2", 1.0, None))
    assert {r.job: (r.machine, r.slot, r.score) for r in schedule.assign(rows, most_per_machine=1, naive=True).itertuples()} == {"a": ("m1", 1.0, 9.0), "b": ("m2", 1.0, 5.0)}


def test_sequence_goes_to_the_cheapest_change(spark):
    queue = spark.createDataFrame([("f", "1", "x"), ("f", "2", "y"), ("f", "3", "z"), ("f", "4", "x"), ("g", "5", "y")], "family string, job string, material string")
    costs = spark.createDataFrame([("x", "y", 9.0), ("x", "z", 1.0), ("q", "x", 0.0)], "previous string, material string, cost double")
    got = {(r.family, r.place): r.job for r in schedule.sequenced(queue, costs).collect()}
    assert got == {("f", 1): "1", ("f", 2): "4", ("f", 3): "3", ("f", 4): "2", ("g", 1): "5"}
    assert schedule.sequenced(queue, costs.limit(0)).count() == 5


def test_preview_reads_changes(spark):
    rows = [("a", "as_is", 2.0, 10.0, None), ("a", "maintenance", 1.95, 10.0, None), ("a", "crew", 1.5, 10.0, None), ("a", "both", 2.4, 10.0, None), ("b", "as_is", None, 1.0, "x"), ("b", "crew", 1.0, 1.0, None)]
    cases = spark.createDataFrame(rows, "machine string, case string, predicted double, good_qty double, blocked_reason string")
    got = {(r.machine, r.case): (None if r.change_kwh is None else round(r.change_kwh, 6), r.reading, r.best) for r in serving.preview(cases).collect()}
    assert got == {("a", "as_is"): (0.0, None, False), ("a", "maintenance"): (-0.5, "limited", False), ("a", "crew"): (-5.0, "lowers", True), ("a", "both"): (4.0, "raises", False), ("b", "as_is"): (None, None, False), ("b", "crew"): (None, None, False)}


def test_median_of_the_others(spark):
    import statistics

    from loomline.plans import readers

    data = [(f"m{i}", "f" if i < 5 else "g", "Hard" if i % 4 else None, v) for i, v in enumerate([5.0, 1.0, 1.0, 7.0, None, 2.0, 9.0, 4.0, 4.0, None])]
    df = spark.createDataFrame(data, "machine string, family string, difficulty string, v double")
    got = {r.machine: (r.baseline, r.level) for r in readers.peer_baseline(df, "v", 3, 5).collect()}
    for m, family, difficulty, _ in data:
        others = [x for x in data if x[0] != m]
        same = [x for x in others if difficulty and x[2] == difficulty]
        near = [x for x in same if x[1] == family]
        level, peers = ("family", near) if len(near) >= 3 else ("difficulty", same) if len(same) >= 5 else ("all", others)
        known = [x[3] for x in peers if x[3] is not None]
        assert got[m] == (statistics.median(known), level)
    assert readers.peer_baseline(df.limit(1), "v").collect() == []
