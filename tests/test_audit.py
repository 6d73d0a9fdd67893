"""Patches and the audit backfill, staged runs, crews and month votes on tables worked out by hand."""

from __future__ import annotations

import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions.vocabulary import HOUR_US
from loomline.plans import audit, catalog, crews, staged
from loomline.sources import month_vote, patches
from loomline.sources.sinks import replace_months

from .test_catalog import SF, cells
from .test_gold import JOB, job

ROW = "k int, v double, flags string, period string"


def test_a_patch_rewrites_touched_months_only(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_months(spark.createDataFrame([(1, 1.0, '{"b":"1","old":"x"}', "2024-01"), (2, 2.0, None, "2024-01"), (3, 3.0, "as it is", "2024-02")], ROW), path, "period")
    files = {p: p.stat().st_mtime_ns for p in Path(path).glob("period=2024-02/*.parquet")}
    changes = spark.createDataFrame([(1, None, '{"a":"2"}', "2024-01"), (9, 9.0, "{}", "2024-01")], ROW)
    for _ in range(2):
        assert patches.patch_table(spark, path, changes, ["k"], ["v"], flags="flags", drop=["old"]) == {"rows": 1, "months": 1}
        rows = {r.k: (r.v, r.flags) for r in spark.read.parquet(path).collect()}
        assert rows == {1: (None, '{"a":"2","b":"1"}'), 2: (2.0, None), 3: (3.0, "as it is")}
    assert files and all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert patches.patch_table(spark, path, changes.limit(0), ["k"], ["v"]) == {"rows": 0, "months": 0}
    with pytest.raises(Exception, match="two changes of 1"):
        patches.patched(spark.read.parquet(path), changes.unionByName(changes), ["k"], ["v"]).collect()


def test_basis_is_kept_rebuilt_or_refused(spark):
    hour = 10 * HOUR_US
    jobs = spark.createDataFrame([job("fits", hour, hour + HOUR_US, 30.0), job("long", hour, hour + HOUR_US, 500.0), job("away", 0, HOUR_US, 500.0)], JOB)
    kinds = [("landed", "fits", 7.0, 20.0, None), ("fits", "fits", None, 30.0, None), ("long", "long", None, 30.0, None), ("over", "fits", None, 61.0, None), ("told", "away", None, 5.0, '{"csi_dominant_production_minutes":12,"dominant_csi_source_row_hash":"away"}'), ("nobody", "away", 0.0, 5.0, '{"csi_dominant_production_minutes":"12"}'), ("other", "away", None, 5.0, '{"csi_dominant_production_minutes":12,"dominant_csi_source_row_hash":"x"}'), ("none", "gone", None, None, "not json")]
    rows = spark.createDataFrame([(m, hour, j, 0.0, p, 0.0, None, 1.0, None, 1, b, f, "2024-01") for m, j, b, p, f in kinds], "machine string, hour_us long, job_hash string, setup_minutes double, production_minutes double, planned_stop_minutes double, unplanned_stop_minutes double, good_qty double, scrap_qty double, several_jobs int, row_basis double, flags string, period string")
    got = {r.machine: r for r in audit.audit_rows(rows.withColumn("event_basis", F.lit(None).cast("double")), jobs).collect()}
    assert {m: (r.row_basis, r.status) for m, r in got.items()} == {
        "landed": (7.0, "preserved_existing_landed_positive_basis"), "fits": (30.0, "reconstructed_from_csi_event"), "long": (60.0, "reconstructed_from_csi_event"), "over": (None, "excluded_minute_budget_anomaly"), "told": (12.0, "reconstructed_from_source_flags_matching_dominant_hash"),
        "nobody": (12.0, "reconstructed_from_source_flags_missing_dominant_hash_flag"), "other": (None, "blocked_dominant_identity_conflict"), "none": (None, "missing_positive_dominant_basis_evidence"),
    }
    assert got["fits"].event_basis == 37.0 and got["none"].event_basis is None and got["over"].budget_anomaly == "production_minutes_gt_60"
    assert {m: r.alignment for m, r in got.items()} == {"landed": "material_misaligned", "fits": "aligned", "long": "material_misaligned", "over": "missing_positive_row_basis_minutes", "told": "material_misaligned", "nobody": "material_misaligned", "other": "missing_positive_row_basis_minutes", "none": "missing_positive_row_basis_minutes"}
    assert audit.audit_rows(rows.withColumn("event_basis", F.lit(None).cast("double")), jobs, start=hour + 1).count() == 0


# ---- staged runs ----
def test_stages_report_rows_and_values(spark):
    rows = spark.range(10).withColumn("v", F.when(F.col("id") > 6, 1))
    events = []
    got = staged.run_stages(spark, rows, [staged.Stage("all", lambda df: df, ["v"]), staged.Stage("half", lambda df: df.filter("id < 8"), ["v"])], limit=60, notify=lambda e: events.append((e["event"], e["stage"])))
    assert got.state == "done" and got.rows.count() == 8
    assert [(r.stage, r.state, r.n_rows, r.filled) for r in got.report.orderBy("number").collect()] == [("all", "done", 10, {"v": 3}), ("half", "done", 8, {"v": 1})]
    assert events == [("stage_start", "all"), ("stage_end", "all"), ("stage_start", "half"), ("stage_end", "half")]


def test_a_stage_over_its_limit_is_cancelled(spark):
    @F.udf("long")
    def slowly(x):
        time.sleep(30)
        return x

    began = time.monotonic()
    stages = [staged.Stage("quick", lambda df: df), staged.Stage("slow", lambda df: df.select(slowly("id").alias("id"))), staged.Stage("never", lambda df: df)]
    got = staged.run_stages(spark, spark.range(4), stages, limit=6, warn=5)
    assert time.monotonic() - began < 25 and got.state == "timed_out" and got.rows is None
    report = got.report.orderBy("number").collect()
    assert [(r.stage, r.state, r.slow) for r in report] == [("quick", "done", False), ("slow", "timed_out", True), ("never", "skipped", None)]
    assert spark.range(5).count() == 5  # other jobs go on


def test_a_stage_that_fails_stops_the_run(spark):
    got = staged.run_stages(spark, spark.range(3), [staged.Stage("bad", lambda df: df.select(F.raise_error(F.lit("broken")).alias("x"))), staged.Stage("next", lambda df: df)])
    assert got.state == "failed" and [(r.state, "broken" in (r.error or "")) for r in got.report.orderBy("number").collect()] == [("failed", True), ("skipped", False)]


# ---- crews ----
def test_crews_are_one_in_any_order(spark):
    rows = spark.createDataFrame([(1, " L ", '["b", "a", " ", "b", "L"]'), (2, "L", '["a","b"]'), (3, "L", None), (4, None, '["z"]'), (5, None, "nonsense"), (6, "", "[]")], "id int, leader string, roster string")
    got = {r.id: (r.members, r.composition, r.crew_size) for r in crews.with_crew(rows).collect()}
    assert got == {1: (["a", "b"], "L + a, b", 3), 2: (["a", "b"], "L + a, b", 3), 3: ([], "L", 1), 4: (["z"], "z", 1), 5: ([], None, None), 6: ([], None, None)}


def test_figures_need_enough_rows(spark):
    rows = spark.createDataFrame([("c", "t", float(i), 2.0) for i in range(10)] + [("d", "t", 1.0, 1.0)] * 9 + [("c", "t", 1.0, 0.0), (None, "t", 1.0, 1.0)], "composition string, task string, energy_kwh double, good_qty double")
    got = [tuple(r) for r in crews.crew_figures(rows, "composition", crews.CREW_ROWS).collect()]
    assert got == [("c", "t", 2.25, 2.25, 10, 20.0, 4.5)]


# ---- months of sources ----
def test_months_in_text(spark):
    texts = ["Report Jul 2025, also 2025-07-01 and 2025年8月", "sept_2024, then 2024.9", "nothing 1999-01", None, "2025/13"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [sorted(r[0]) for r in rows.orderBy("i").select(month_vote.months_in(F.col("t"))).collect()] == [["2025-07", "2025-07", "2025-08"], ["2024-09", "2024-09"], [], [], ["2025-01"]]


def test_a_month_is_elected(spark):
    cells_ = [("sure", "2025-07-01")] * 3 + [("one", "2025-07-01")] + [("most", "2025-07-01")] * 8 + [("most", "2025-06-01")] * 2 + [("split", "2025-07-01"), ("split", "2025-06-01")] * 5 + [("old", "2019-01-01")]
    cells_df = spark.createDataFrame(cells_, "source string, cell string")
    got = {r.source: (r.month, r.status, r.confidence, r.n, r.total) for r in month_vote.elected(month_vote.votes(cells_df, "source", ["cell"]), cells_df).collect()}
    assert got == {"sure": ("2025-07", "resolved", "high", 3, 3), "one": ("2025-07", "resolved", "medium", 1, 1), "most": ("2025-07", "resolved", "medium", 8, 10), "split": (None, "ambiguous", "low", 5, 10), "old": (None, "unresolved", "none", 0, 0)}


def test_months_with_all_sources(spark):
    seen = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "y")], "month string, family string")
    blocked = spark.createDataFrame([("c", "on hold")], "month string, note string")
    assert {tuple(r) for r in month_vote.month_readiness(seen, ["x", "y"], blocked).collect()} == {("a", "ready", ""), ("b", "missing_sources", "y"), ("c", "blocked", "")}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["audit_backfill", "crew_task_figures", "crew_sizes_by_task", "job_feature_rows", "source_months", "week_readiness"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), columns)
