"""Period runs, sweeps, cleaned layers, rejected rows and versions on small tables worked out by hand."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions.scalars import derived_difficulty, parse_confidence
from loomline.functions.vocabulary import HOUR_US
from loomline.operators.resolve import EXCEPTIONS, REGISTRY, lookup_keys, read_registry, resolve_chain
from loomline.plans import catalog, gold, periods
from loomline.sources import layers, rejects
from loomline.sources.versions import Refused, Versions, inventory, persist_run, replacement_report

from .test_catalog import SF, cells
from .test_gold import JOB, METER, REPORT, WORK, job


def us(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


JANUARY, FEBRUARY = us("2024-01-31T22:00:00"), us("2024-02-01T00:00:00")


def tables(spark):
    hours = [(m, JANUARY + h * HOUR_US, "main", 10.0 + h, 1.0, f"{m}{h}") for m in ("024-001", "035-002") for h in range(6)] + [("024-001", us("2024-03-05T10:00:00"), "main", 5.0, 1.0, "march"), (None, JANUARY, "main", 1.0, 1.0, "x")]
    jobs = [
        job("over", JANUARY + HOUR_US // 2, FEBRUARY + 2 * HOUR_US, 200.0), job("rival", FEBRUARY + HOUR_US, FEBRUARY + 3 * HOUR_US, 100.0),
        job("early", JANUARY, JANUARY + HOUR_US // 3, 10.0), (*("035-002",), *job("other", FEBRUARY, FEBRUARY + HOUR_US)[1:]), (*("035-002",), *job("dated", None, None)[1:]),
    ]
    reports = [("024-001", "r1", JANUARY + HOUR_US, "o", "1", 3.0), ("024-001", "r2", FEBRUARY + HOUR_US, "o", "1", 2.0)]
    works = [("024-001", "w1", us("2023-12-20T10:00:00"), "a", "PM"), ("024-001", "w2", JANUARY + HOUR_US + 5, "b", "CM"), ("035-002", "w3", FEBRUARY + 4 * HOUR_US + 5, None, "EM"), ("024-001", "w4", None, "c", "PM")]
    return [spark.createDataFrame(rows, s) for rows, s in ((hours, METER), (jobs, JOB), (reports, REPORT), (works, WORK))]


@pytest.fixture
def store(spark, tmp_path):
    out = periods.PeriodStore(spark, str(tmp_path / "store"))
    out.put(*tables(spark))
    return out


def test_a_period_equals_the_whole_run(spark, tmp_path):
    unit = "month"
    store = periods.PeriodStore(spark, str(tmp_path / unit), unit)
    store.put(*tables(spark))
    whole = gold.machine_hours(*tables(spark)).withColumn("period", periods.period_of(F.col("hour_us"), unit)).collect()
    known = sorted({r.period for r in whole})
    assert sorted(r.period for r in store.periods().collect()) == known and len(known) > 1
    names = sorted(set(whole[0].asDict()) - {"period"})
    rounded = lambda v: round(v, 9) if isinstance(v, float) else v
    row = lambda r: tuple(rounded(r[c]) for c in names)
    for period in known[:2]:
        got = sorted((row(r) for r in periods.period_plan(store, period).collect()), key=str)
        assert got == sorted((row(r) for r in whole if r.period == period), key=str)


def test_periods(spark):
    rows = spark.createDataFrame([(us("2024-12-30T00:00:00"), us("2025-01-13T00:00:00")), (us("2024-12-29T23:00:00"), us("2024-12-29T23:00:00")), (None, 5)], "a long, b long")
    of = lambda unit: [tuple(r) for r in rows.select(periods.period_of(F.col("a"), unit), periods.touched_periods(F.col("a"), F.col("b"), unit)).collect()]
    assert of("month") == [("2024-12", ["2024-12", "2025-01"]), ("2024-12", ["2024-12"]), (periods.UNDATED, None)]
    assert of("week") == [("2025-W01", ["2025-W01", "2025-W02"]), ("2024-W52", ["2024-W52"]), (periods.UNDATED, None)]
    with pytest.raises(ValueError):
        periods.period_of(F.col("a"), "day")


def partitions_read(df, table):
    """The partition filters of each scan of a stored table, in the executed plan."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 2000)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line[line.index("PartitionFilters") : line.index("PushedFilters")] for line in lines if "PartitionFilters" in line and f"store/{table}" in line]


def test_a_period_reads_its_partitions(store):
    plan = periods.period_plan(store, "2024-01")
    for table, filters in (("meters", "= 2024-01"), ("reports", "= 2024-01"), ("works", "<= 2024-01")):
        found = partitions_read(plan, table)
        assert found and all(filters in line for line in found)
    border = periods.border_hours(store.table("jobs").filter("period = '2024-01'"), "2024-01", "month")
    for rows, table in zip(periods.border_inputs(store, border), ("meters", "jobs"), strict=True):
        assert any("(period" in line and "= 2024-02)" in line for line in partitions_read(rows, table))
    assert not any("2024-03" in line for table in periods.TABLES for line in partitions_read(plan, table))


def test_jobs_are_stored_under_each_period_that_they_touch(store):
    rows = {(r.hash, r.period): r.periods for r in store.table("jobs").collect()}
    assert rows["over", "2024-01"] == ["2024-01", "2024-02"] == rows["over", "2024-02"]
    assert ("rival", "2024-01") not in rows and ("early", "2024-02") not in rows and ("dated", periods.UNDATED) in rows
    borders = periods.border_hours(store.table("jobs").filter("period = '2024-01'"), "2024-01", "month").collect()
    assert sorted((r.period, (r.hour_us - FEBRUARY) // HOUR_US) for r in borders) == [("2024-02", 0), ("2024-02", 1)]


def test_landing_leaves_other_periods(spark, store, tmp_path):
    target = str(tmp_path / "fact")
    periods.land(store, "2024-01", target)
    files = {p: p.stat().st_mtime_ns for p in Path(target).rglob("*.parquet")}
    periods.land(store, "2024-02", target)
    assert files.items() <= {p: p.stat().st_mtime_ns for p in Path(target).rglob("*.parquet")}.items()
    assert spark.read.parquet(target).count() == 12


def test_a_sweep_that_stopped_does_each_period_once(spark, tmp_path):
    wanted = spark.createDataFrame([("2024-01",), ("2024-02",), ("2024-03",), ("2024-02",)], "period string")
    done: list[str] = []

    class Lost(BaseException):
        """The driver is lost: nothing is noted."""

    def work(period):
        if period == "2024-02" and not done.count("2024-02"):
            done.append(period)
            raise Lost
        done.append(period)

    sweep = periods.Sweep(spark, str(tmp_path / "sweep"))
    with pytest.raises(Lost):
        sweep.run(wanted, work, "first")
    assert {(r.period, r.state) for r in sweep.states().collect()} == {("2024-01", "done"), ("2024-02", "claimed")}
    again = periods.Sweep(spark, str(tmp_path / "sweep"))
    assert sorted(r.period for r in again.pending(wanted).collect()) == ["2024-02", "2024-03"]
    assert again.run(wanted, work, "second") == {"2024-02": "done", "2024-03": "done"}
    assert done == ["2024-01", "2024-02", "2024-02", "2024-03"] and again.run(wanted, work, "third") == {}
    assert {r.period: r.tries for r in again.states().collect()} == {"2024-01": 1, "2024-02": 2, "2024-03": 1}


def test_a_failed_period_is_retried_alone(spark, tmp_path):
    wanted = spark.createDataFrame([("a",), ("b",)], "period string")
    sweep = periods.Sweep(spark, str(tmp_path / "sweep"))
    broken = {"b"}

    def work(period):
        if period in broken:
            raise ValueError("no meters")

    assert sweep.report(wanted)["status"] == "error"
    assert sweep.run(wanted, work, "1") == {"a": "done", "b": "failed"}
    assert sweep.report(wanted) == {"status": "partial_error", "done": ["a"], "failed": {"b": "no meters"}}
    assert sweep.run(wanted, work, "2", failed=False) == {}
    broken.clear()
    assert sweep.run(wanted, work, "3") == {"b": "done"} and sweep.report(wanted)["status"] == "success"


# ---- layers ----
def keys(spark, text):
    return spark.createDataFrame([(text,)], "x string").select(lookup_keys(F.col("x"))).first()[0]


def test_lookup_keys_in_order(spark):
    assert keys(spark, "  Press d-024-003 / 1024 - 00003 x ") == ["PRESSD-024-003/1024-00003X", "D-024-003", "024-003", "1024-00003"]
    assert keys(spark, None) == [] == keys(spark, "  ")


def small_registry(spark):
    rows = [("M1", "J1", "R1", ["R9"], "A1", "M1", ["press 024-003", "old one"], "joinable"), ("M2", None, "R2", None, None, "L 2", [], None)]
    return spark.createDataFrame(rows, REGISTRY)


def test_a_chain_of_identifiers(spark):
    odd = spark.createDataFrame([("r 9", "R1-new", "second"), ("", "x", "y")], EXCEPTIONS)
    rows = [(1, "r9", None, None), (2, "zz", "l2", None), (3, " ", None, None), (4, "nothing", "at all", None), (5, "zz", "A1", "GIVEN"), (6, "024-003", None, " "), (6, "024-003", None, " "), (7, "A1", "L2", None)]
    df = spark.createDataFrame(rows, "id int, first string, second string, given string")
    got = resolve_chain(df, ("first", "second"), small_registry(spark), "reports", "given", odd)
    assert got.columns == [*df.columns, "canonical_machine_id", "resolution"]
    found = sorted(((r.id, r.canonical_machine_id, *r.resolution) for r in got.collect()), key=str)
    assert found == [
        (1, "M1", "registry", 1, "mes_secondary_alias", "R9", 1, "R1-new", "second", "joinable", None),
        (2, "M2", "registry", 2, "maintenance_legacy_id", "L 2", 0, "R2", None, None, None),
        (3, None, "unresolved", None, None, None, 0, None, None, None, "no_identifier"),
        (4, None, "unresolved", None, None, None, 0, None, None, None, "not_found"),
        (5, "GIVEN", "given", 0, None, None, 0, None, None, None, None),
        (6, "M1", "registry", 1, "energy_extracted_id", "024-003", 0, "R1", None, "joinable", None),
        (6, "M1", "registry", 1, "energy_extracted_id", "024-003", 0, "R1", None, "joinable", None),
        (7, "M1", "registry", 1, "maintenance_asset_id", "A1", 0, "R1", None, "joinable", None),
    ]
    assert resolve_chain(df.limit(0), ("first",), small_registry(spark), "any").collect() == []


def test_the_own_system_names_the_match(spark):
    of = lambda system: resolve_chain(spark.createDataFrame([("m1",)], "x string"), ("x",), small_registry(spark), system).first().resolution.matched_on
    assert of("jobs") == "canonical_machine_id" and of("works") == "maintenance_legacy_id" and of("any") == "maintenance_legacy_id"


def test_two_machines_of_one_alias_are_an_error(spark):
    bad = small_registry(spark).unionByName(spark.createDataFrame([("M3", " j 1", None, None, None, None, None, None)], REGISTRY))
    with pytest.raises(Exception, match="alias names two machines: J1"):
        resolve_chain(spark.createDataFrame([("J1",)], "x string"), ("x",), bad, "jobs").collect()


def test_registry_of_a_sheet(spark):
    rows = spark.createDataFrame([(" M1 ", "a | b;c,", ""), (None, "x", "y")], "canonical_machine_id string, energy_alias_examples string, mes_primary_resource string")
    assert [tuple(r) for r in read_registry(rows).collect()] == [("M1", None, None, [], None, None, ["a", "b", "c"], None)]


def test_bad_stamps_keep_their_text_and_crews_their_names(spark):
    source = spark.createDataFrame([("J1", "soon", "2024-01-02 03:04:05", " A ", "", "C", "M9")], "`作业` string, `工程開始時間` string, `工程結束時間` string, `機長姓名2` string, `機組人員姓名1` string, `機組人員姓名4` string, canonical_machine_id string")
    raw = layers.typed_raw_rows(source, "jobs", ("canonical_machine_id",))
    first = raw.first()
    assert (first.raw_order_id, first.raw_start_time, first.canonical_machine_id, first.exception_applied) == ("J1", "soon", "M9", 0)
    row = layers.clean_family(raw, "jobs", small_registry(spark)).first()
    assert row.bad_stamps == {"prod_start_ts": "soon"} and row.prod_start_ts is None and str(row.prod_end_ts) == "2024-01-02 03:04:05"
    assert row.team_members == ["A", "C"] and (row.canonical_machine_id, row.resolution.method) == ("M9", "given")


def test_broken_payloads_fall_back_to_raw_columns(spark):
    raw = spark.createDataFrame([("h", "[1]", "R 7", "R1"), ("i", "{broken", "R 8", None), ("j", '{"資源": "R2", "要求生產數量": 5}', None, "R1")], "source_row_hash string, payload string, raw_task string, raw_machine_id_or_label string")
    got = {r.source_row_hash: r for r in layers.clean_family(raw, "reports", small_registry(spark)).collect()}
    assert (got["h"].task_name, got["h"].canonical_machine_id, got["i"].task_name, got["i"].resolution.reason) == ("R 7", "M1", "R 8", "no_identifier")
    assert (got["j"].canonical_machine_id, got["j"].required_qty, got["j"].resource_id_raw) == ("M2", 5.0, "R2")


def test_the_payload_is_parsed_once(spark):
    raw = layers.raw_rows(spark.createDataFrame([("J1", "2")], "`作业` string, `正品數量` string"), "jobs")
    plan = layers.clean_family(spark.createDataFrame(raw.collect(), raw.schema), "jobs")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 1


def test_meters_without_their_sentinel(spark):
    label, value, first, last = layers.SENTINEL
    rows = [(label, first, str(value), str(value)), (label, first, str(value), "1"), (label, "2025-08-17 07:00:00", str(value), str(value)), ("印刷機024-010", "2026-01-05 01:00:00", "1", "1")]
    raw = layers.raw_rows(spark.createDataFrame(rows[:3] + [("印刷機024-010", "2026-01-05 01:00:00", "1", "1")], "machine string, datetime string, kwh string, cost string"), "energy")
    got = layers.clean_meters(raw).collect()
    assert len(got) == 3 and sorted(r.quality_status for r in got) == ["flagged_partial", "ok", "ok"]
    assert [r.quality_flags for r in got if r.quality_flags] == ['{"flagged_month":"2026-01","localized_partial_meter_month":true}']


def test_confidence_and_difficulty(spark):
    rows = spark.createDataFrame([("unknown", "m"), ("main", None), ("aggregate_total", "m"), ("uv", "m")], "c string, m string")
    assert [r[0] for r in rows.select(parse_confidence(F.col("c"), F.col("m"))).collect()] == ["low", "low", "medium", "high"]
    tasks = spark.createDataFrame([(x,) for x in ("印刷+x", "Print", "印刷 UV", "上光", "pack", None)], "t string")
    assert [r[0] for r in tasks.select(derived_difficulty(F.col("t"))).collect()] == ["Hard", "Medium", "Hard", "Easy", None, None]


def test_kinds_of_source():
    assert layers.source_kind("energy_daily_report_v1") == ("meters", "supplementary_only")
    with pytest.raises(KeyError):
        layers.source_kind("other")


# ---- rejects ----
def test_a_queue_file(spark, tmp_path):
    path = tmp_path / "queue.csv"
    path.write_text("Machine Family,MATERIAL,Task Name,quantity,Urgency,Hour-of-day,extra\n024,M1,印刷 + UV,112.5,HIGH,0,e\n024,,Pack,1,,,\n024,M2,Print,none,low,9.6,\n024,M3,Print,0,,,\n024,M4\n024,M5,Pack,10,,,x,y\n035, M6 ,Pack,38,l,13,\n", encoding="utf-8")
    queue, rejected, message = rejects.load_queue(spark, str(path), "May 2025")
    rows = [tuple(r) for r in queue.select("job_id", "material_code", "task_difficulty", "quantity", "urgency_label", "urgency_rank", "hour_of_day", "team_leader", "source_month").collect()]
    assert rows == [("MAN-01", "M1", "Hard", 100.0, "High", 3, 8, "unknown", "May 2025"), ("MAN-07", "M6", None, 50.0, "Low", 1, 13, "unknown", "May 2025")]
    assert [(tuple(r.reasons), r["_raw_line"]) for r in rejected.collect()] == [(("missing_material_code",), None), (("quantity_is_no_number",), None), (("quantity_not_positive",), None), (("broken_line",), "024,M4"), (("broken_line",), "024,M5,Pack,10,,,x,y")]
    assert message == "rejected rows: 5"
    tagged = rejects.queue_reasons(rejects.read_lines(spark, str(path), rejects.QUEUE_REQUIRED, rejects.QUEUE_OPTIONAL).rows)
    assert rejects.write_apart(tagged, str(tmp_path / "apart")) == {"accepted": 2, "rejected": 5}
    assert spark.read.parquet(str(tmp_path / "apart" / "rejected=true")).count() == 5


def test_queues_that_are_refused(spark, tmp_path):
    for name, text, message in (("a.txt", "x", "unsupported file type; give a CSV export"), ("b.csv", "task,material\nx,y\n", "missing required columns: preferred_machine_family, quantity"), ("c.csv", "task,material,quantity,machine family\n", "the file has no rows"), ("d.csv", "task,material,quantity,machine family\n,,,\n", "no valid rows after validation")):
        (tmp_path / name).write_text(text)
        queue, _, said = rejects.load_queue(spark, str(tmp_path / name), "May 2025")
        assert queue is None and said == message


# ---- versions ----
PIECES = "machine string, hour long, job string, good double, state string, ok int"


def pieces(spark, *good, state="run"):
    return spark.createDataFrame([("m", i, "j" if i < 2 else "k", g, state, 1 if i < 2 else 0) for i, g in enumerate(good)], PIECES)


def report(before, after, **more):
    rows = replacement_report(before, after, ["machine", "hour"], "job", ["good"], ["state"], F.col("ok") == 1, **more).collect()
    return {r.rule: r.n for r in rows if r.n}


def test_replacement_rules(spark):
    before = pieces(spark, 1.0, 3.0, 5.0)
    assert report(before, pieces(spark, 2.0, 2.0, 5.0)) == {}
    assert report(before, pieces(spark, 2.0, 3.0, 5.0)) == {"group_not_conserved": 1, "total_of_good": 1}
    assert report(before, pieces(spark, 1.0, 3.0, 6.0)) == {"changed_out_of_scope": 1, "group_not_conserved": 1, "total_of_good": 1}
    assert report(before, pieces(spark, -1.0, 5.0, 5.0, state="idle")) == {"changed_other_column": 3, "negative": 1}
    assert report(before, pieces(spark, 1.0, 3.0)) == {"gone_row": 1, "gone_group": 1, "group_not_conserved": 1, "total_of_good": 1}
    twice = before.unionByName(before.filter("hour = 0"))
    assert report(before, twice)["repeated_key"] == 1
    assert report(before, before, expected={"rows": 3, "allowed": 2, "groups": 2}) == {} and report(before, before, expected={"rows": 4, "groups": 1}) == {"drift_of_rows": 1, "drift_of_groups": 1}
    assert report(before.limit(0), before.limit(0)) == {}


def test_a_refused_or_lost_replacement_leaves_the_old_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no table"):
        store.read("t")
    assert store.publish({"t": store.stage("t", pieces(spark, 1.0, 3.0))}, "one") == 1
    store.stage("t", pieces(spark, 9.0, 9.0))  # lost between stage and swap
    checks = lambda a, b: report(a, b)
    with pytest.raises(Refused) as refused:
        store.replace_guarded("t", pieces(spark, 9.0, 3.0), checks, "two")
    assert refused.value.counts["group_not_conserved"] == 1
    again = Versions(spark, str(tmp_path))
    good = lambda *n: sorted(r.good for r in again.read("t", *n).collect())
    assert good() == [1.0, 3.0]
    assert again.replace_guarded("t", pieces(spark, 2.0, 2.0), checks, "three") == 2 and good() == [2.0, 2.0] and good(1) == [1.0, 3.0]
    assert again.roll_back(1, "back") == 3 and good() == [1.0, 3.0] and good(2) == [2.0, 2.0]
    assert [r.run for r in again.history().collect()] == ["one", "three", "back"]
    with pytest.raises(ValueError, match="no commit"):
        again.roll_back(9, "x")


def run_of(spark, *machines):
    return spark.createDataFrame([(m, f"j{m}", f"r{m}") for m in machines], "machine_id string, job_id string, report_id string")


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    none = spark.createDataFrame([], "machine_id string, system string")
    rows = spark.createDataFrame([(1,)], "v int")
    persist_run(store, "2024-01", "a", {"meters": rows, "jobs": rows}, run_of(spark, "1", "2"), none)
    broken = rows.select(F.raise_error(F.lit("disk")).alias("v"))
    with pytest.raises(Exception, match="disk"):
        persist_run(store, "2024-02", "b", {"meters": rows, "jobs": broken}, run_of(spark, "3"), none)
    assert {r.month for r in store.read("meters").collect()} == {"2024-01"} and store.read("runs").count() == 1
    other = spark.createDataFrame([("9", "energy"), (None, "jobs")], "machine_id string, system string")
    persist_run(store, "2024-02", "c", {"meters": rows, "jobs": rows}, run_of(spark, "2"), other)
    persist_run(store, "2024-02", "d", {"meters": rows.union(rows), "jobs": rows}, run_of(spark, "2"), other)
    assert sorted(r.month for r in store.read("meters").collect()) == ["2024-01", "2024-02", "2024-02"]
    assert {r.machine_id: (r.first_matched, r.last_confirmed) for r in store.read("matches").collect()} == {"1": ("2024-01", "2024-01"), "2": ("2024-01", "2024-02")}
    assert {(r.machine_id, r.system): (r.first_seen, r.last_seen, r.active) for r in store.read("inventory").collect() if r.system == "energy"} == {("1", "energy"): ("2024-01", "2024-01", 0), ("2", "energy"): ("2024-01", "2024-02", 1), ("9", "energy"): ("2024-02", "2024-02", 1)}
    assert sorted((r.machine_id, r.three_way) for r in store.read("presence").filter("month = '2024-02'").collect()) == [("2", 1), ("9", 0), ("j2", 0), ("r2", 0)]
    assert [(r.run, r.month, r.display_order) for r in store.read("runs").orderBy("display_order").collect()] == [("a", "2024-01", 1), ("c", "2024-02", 2), ("d", "2024-02", 3)]
    assert inventory(None, other.filter("machine_id is not null"), "x").count() == 1


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["period_borders", "layer_counts", "cleaned_jobs", "cleaned_reports", "cleaned_works", "cleaned_meters", "uploaded_queue", "queue_rejects", "replacement_audit"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), columns)
