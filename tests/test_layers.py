from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators.resolve import resolve
from loomline.sources import layers, sinks


def values(spark, column, *inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_scalars(spark):
    assert values(spark, S.clean_text, " a ", " ", None) == ["a", None, None]
    assert values(spark, S.lenient_int, "12.9", "x", "-3", None) == [12, None, -3, None]
    assert values(spark, S.order_suffix, "12.0", "A.0", "7") == ["12", "A.0", "7"]
    assert values(spark, S.team_size_of_manpower, 2.5, 3.5, 0.0, None, kind="double") == [2.0, 4.0, None, None]
    assert values(spark, S.meter_component, "024-001 主機", "ＵＶ 024", "UV IR", "024-001", "x", "DOMAIN") == ["main", "uv", "combo", "aggregate_total", "unknown", "unknown"]
    assert values(spark, S.task_difficulty, "Print+X", "printing", "Finishing", "pack") == ["Hard", "Medium", "Easy", None]
    assert values(spark, S.machine_pattern, "1024-00166(UV)", "35-1", "035-166") == ["024-166", None, "035-166"]
    assert values(spark, S.shift_label, 7, 14, 15, 22, 23, kind="int") == ["Day", "Day", "Evening", "Evening", "Night"]


def test_roster_counts_leader_and_named_members(spark):
    df = spark.createDataFrame([("l", '["a", " ", "b"]'), (None, "[]"), ("l", None)], "l string, m string")
    assert [r[0] for r in df.select(S.team_size_of_roster(F.col("l"), F.col("m"))).collect()] == [3, None, 1]


def test_flags_merge_drop_and_sort(spark):
    df = spark.createDataFrame([('{"b":"1","a":"2","x":"9"}', '{"a":"3"}'), (None, '{"k":"v"}')], "o string, n string")
    assert [r[0] for r in df.select(S.merged_flags(F.col("o"), F.col("n"), ["x"])).collect()] == ['{"a":"3","b":"1"}', '{"k":"v"}']


def test_hash_ignores_column_order_and_derived_columns(spark):
    a = layers.raw_rows(spark.createDataFrame([("1", "2", "9")], "p string, q string, d string"), "s", ("d",)).first().source_row_hash
    b = layers.raw_rows(spark.createDataFrame([("2", "1", "8")], "q string, p string, d string"), "s", ("d",)).first().source_row_hash
    assert a == b


def test_clean_job_takes_payload_before_raw_columns(spark):
    raw = layers.raw_rows(spark.createDataFrame([("J1", "x", "12.5", "2025-07-01 10:00:00")], "`作业` string, raw_order_id string, `正品數量` string, raw_start_time string"), "jobs")
    row = layers.clean_family(raw, "jobs").first()
    assert (row.order_id, row.good_qty, str(row.prod_start_ts)) == ("J1", 12.5, "2025-07-01 10:00:00")
    with pytest.raises(ValueError):
        layers.clean_family(raw, "other")


def test_clean_meters_drops_summaries_and_stamps_off_the_hour(spark):
    raw = layers.raw_rows(spark.createDataFrame([("024-001 合計", "2025-07-01 10:00:00", "1"), ("024-001", "2025-07-01 10:00:00", "2"), ("024-001", "2025-07-01 10:00:01", "3"), ("nan", "2025-07-01 10:00:00", "4")], "machine string, datetime string, kwh string").withColumn("cost", F.lit(None).cast("string")), "energy")
    faults = spark.createDataFrame([("2025-07", "024-001", "gap")], "month_key string, label string, flag string")
    rows = layers.clean_meters(raw, faults=faults).collect()
    assert [(r.kwh, r.quality_status, r.canonical_machine_id) for r in rows] == [(2.0, "flagged_partial", "024-001")]


def test_resolution_prefers_own_system_and_first_candidate(spark):
    registry = spark.createDataFrame([("M1", "erp", ["A 1"]), ("M2", "any", ["a1", "B-2"])], "canonical_id string, system string, aliases array<string>")
    rows = spark.createDataFrame([(1, "a 1"), (2, "x b-2"), (3, None), (4, "zz")], "id int, raw string")
    got = {r.id: r.canonical_id for r in resolve(rows, "raw", registry, "erp", r"[A-Z]-\d", "id").collect()}
    assert got == {1: "M1", 2: "M2", 3: None, 4: None}


def test_alias_of_two_ids_is_an_error(spark):
    registry = spark.createDataFrame([("M1", "erp", ["a"]), ("M2", "erp", ["A "])], "canonical_id string, system string, aliases array<string>")
    with pytest.raises(Exception, match="alias names two ids"):
        resolve(spark.createDataFrame([(1, "a")], "id int, raw string"), "raw", registry, "erp", "x", "id").collect()


def test_month_replacement_leaves_other_months(spark, tmp_path):
    path = str(tmp_path / "fact")
    sinks.replace_months(spark.createDataFrame([("2025-06", 1), ("2025-07", 2)], "month_key string, v int"), path)
    for _ in range(2):
        sinks.replace_months(spark.createDataFrame([("2025-07", 5)], "month_key string, v int"), path)
    assert sorted((r.month_key, r.v) for r in spark.read.option("basePath", path).parquet(path).selectExpr("cast(month_key as string) month_key", "v").collect()) == [("2025-06", 1), ("2025-07", 5)]


def test_upsert_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    first = sinks.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), path, ["k"], ["n"], 0)
    second = sinks.upsert(spark.createDataFrame([("a", 2)], "k string, n int"), path, ["k"], ["n"], 1)
    assert first != second and {(r.k, r.n) for r in spark.read.parquet(second).collect()} == {("a", 2), ("b", 1)}
    old = spark.createDataFrame([(None, "x")], "k string, m string")
    assert sinks.new_rows(spark.createDataFrame([(None, "x"), ("", "x"), ("c", "x")], "k string, m string"), old, ["k", "m"]).count() == 1
    assert {(r.k, r.s) for r in sinks.first_seen(spark.createDataFrame([("a", 1)], "k string, s int"), spark.createDataFrame([("a", 9), ("b", 9)], "k string, s int"), "k", "s").collect()} == {("a", 1), ("b", 9)}
    with pytest.raises(ValueError):
        sinks.require_columns(old, ["zz"])
