"""Raw and cleaned layers: content-hashed raw rows with their payload, then typed rows per source family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import clean_text, content_hash, has_value, lenient_double, lenient_int, meter_component, meter_label, parse_confidence
from ..operators.resolve import resolve_chain

#: Target column, kind, payload keys in order, then raw columns.
JOB_FIELDS = (
    ("shift_date", "date", ("班次內日期",), ()), ("shift_name", "text", ("班次",), ()), ("area", "text", ("區域",), ()),
    ("order_id", "text", ("作业",), ("raw_order_id",)), ("suffix", "text", ("作业后缀",), ()), ("operation", "text", ("操作",), ()),
    ("material_code", "text", ("物料",), ("raw_material",)), ("task_name", "text", ("任務",), ()),
    ("prod_start_ts", "time", ("工程開始時間",), ("raw_start_time",)), ("prep_end_ts", "time", ("準備結束時間",), ("raw_prep_end_time",)), ("prod_end_ts", "time", ("工程結束時間",), ("raw_end_time",)),
    ("good_qty", "number", ("正品數量",), ("raw_good_qty",)), ("scrap_qty", "number", ("廢品數量",), ("raw_scrap_qty",)), ("cumulative_qty", "number", ("纍計數量",), ()),
    ("actual_run_minutes", "number", ("心電圖整體運作時間",), ()), ("actual_prod_minutes", "number", ("實際生產時間",), ()), ("actual_speed_per_hour", "number", ("實際速度_本_時",), ()),
    ("actual_changeover_minutes", "number", ("心電圖實際轉版時間",), ()), ("planned_stop_minutes", "number", ("實際計劃停機時間",), ()), ("unplanned_stop_minutes", "number", ("實際無計劃停機時間",), ()),
    ("stop_reason", "text", ("停機原因",), ()), ("stop_count", "whole", ("運作中途總停機次數",), ()), ("team_leader", "text", ("機長姓名1",), ()), ("raw_machine", "text", ("機台編號",), ("raw_machine_id_or_label",)),
)
REPORT_FIELDS = (
    ("report_ts", "time", ("報工時間",), ()), ("order_id", "text", ("作業",), ()), ("suffix", "text", ("後綴",), ()), ("operation", "text", ("操作",), ()),
    ("task_name", "text", ("任務",), ("raw_task",)), ("material_code", "text", ("物料",), ("raw_material_code",)), ("required_qty", "number", ("要求生產數量",), ()), ("reported_qty", "number", ("生產數量",), ()), ("cumulative_qty", "number", ("累計生產數量",), ()),
    ("report_type", "text", ("報工類型",), ()), ("equipment_total_hours", "number", ("設備總用時",), ()), ("prep_hours", "number", ("準備時間",), ()), ("equipment_prod_hours", "number", ("設備生產時間",), ()), ("manpower", "number", ("人數",), ()), ("shift_name", "text", ("班次",), ()), ("upload_status", "text", ("上傳CSI狀態",), ()),
    ("status_changed_ts", "time", ("狀態變更時間",), ()), ("record_created_ts", "time", ("記錄新增時間",), ()), ("resource_id_raw", "text", ("資源", "resource"), ("raw_machine_id_or_label",)),
)
WORK_FIELDS = (
    ("txn_ts", "time", ("交易日期",), ("raw_transaction_date",)), ("work_order_id", "text", ("工單",), ("raw_work_order",)), ("work_order_desc", "text", ("工單描述", "工單說明"), ()), ("work_order_type", "text", ("工單類型",), ("raw_work_order_type",)),
    ("txn_type", "text", ("交易類型",), ("raw_transaction_type",)), ("item_code", "text", ("物料編碼",), ("raw_material_code",)), ("item_desc", "text", ("物料描述",), ()), ("quantity", "number", ("數量",), ("raw_quantity",)),
    ("asset_id", "text", ("資產",), ("raw_asset_id",)), ("asset_legacy_id", "text", ("資產老編號",), ("raw_asset_old_id",)), ("asset_parent_id", "text", ("資產父級",), ()), ("asset_desc", "text", ("資產描述",), ()),
    ("maint_team", "text", ("維修班組",), ()), ("maint_department", "text", ("維修部門",), ()),
)
FAMILIES = {"jobs": JOB_FIELDS, "reports": REPORT_FIELDS, "works": WORK_FIELDS}
#: Payload keys of the crew besides the leader.
MEMBER_KEYS = ("機長姓名2", "機組人員姓名1", "機組人員姓名2", "機組人員姓名3", "機組人員姓名4")
#: Identifiers of a machine in a cleaned row, the one that is asked first in front.
IDENTIFIERS = {"jobs": ("raw_machine",), "reports": ("resource_id_raw",), "works": ("asset_id", "asset_legacy_id")}
#: What a file may be, and whether its rows are normalised.
SOURCE_KINDS = {
    "energy_hourly_report_v1": ("meters", "supported"), "energy_daily_report_v1": ("meters", "supplementary_only"), "energy_tariff_aggregate_v1": ("meters", "separate_family"), "csi_monthly_xlsx_v1": ("jobs", "supported"),
    "csi_monthly_xls_variant_v1": ("jobs", "registered_variant"), "mes_monthly_report_v1": ("reports", "supported"), "maintenance_transaction_v1": ("works", "supported"),
}
#: Raw columns that a raw row has besides its payload, as (name, kind, source columns).
RAW_COLUMNS = {
    "meters": (("raw_machine_id_or_label", "text", ("machine",)), ("raw_timestamp", "text", ("datetime",)), ("raw_kwh", "number", ("electricity_kwh",)), ("raw_cost", "number", ("electricity_cost",))),
    "jobs": (("raw_machine_id_or_label", "text", ("機台編號",)), ("raw_start_time", "text", ("工程開始時間",)), ("raw_end_time", "text", ("工程結束時間",)), ("raw_prep_end_time", "text", ("準備結束時間",)), ("raw_order_id", "text", ("作业",)), ("raw_material", "text", ("物料",)), ("raw_good_qty", "number", ("正品數量",)), ("raw_scrap_qty", "number", ("廢品數量",))),
    "reports": (("raw_machine_id_or_label", "text", ("資源", "resource")), ("raw_task", "text", ("任務", "task")), ("raw_order_number", "text", ("訂單號", "order_number")), ("raw_material_code", "text", ("物料編碼", "material_code")), ("raw_planned_qty", "number", ("計劃數量", "planned_qty", "計劃生產數量")), ("raw_planned_start", "text", ("計劃開始", "planned_start")), ("raw_planned_end", "text", ("計劃結束", "planned_end"))),
    "works": (("raw_machine_id_or_label", "text", ("資產", "資產老編號", "normalized_id")), ("raw_transaction_date", "text", ("交易日期",)), ("raw_work_order", "text", ("工單",)), ("raw_work_order_type", "text", ("工單類型",)), ("raw_transaction_type", "text", ("交易類型",)), ("raw_asset_id", "text", ("資產",)), ("raw_asset_old_id", "text", ("資產老編號",)), ("raw_material_code", "text", ("物料編碼",)), ("raw_quantity", "number", ("數量",))),
}
#: Fixed value: the word of rows that add others up.
SUMMARY_WORD = "合計"


def raw_rows(source: DataFrame, system: str, derived: tuple[str, ...] = ()) -> DataFrame:
    """Raw layer: all columns as one JSON payload and a content hash that leaves ``derived`` columns out."""
    own = [c for c in source.columns if c not in derived]
    name = F.regexp_replace(F.coalesce(F.col("_metadata.file_path"), F.lit("")), r"^.*/", "") if "_metadata" in source.columns else F.lit(system)
    return source.select("*", F.to_json(F.struct(*own)).alias("payload"), F.lit(system).alias("source_system"), name.alias("source_file"), content_hash(own, F.lit(system)).alias("source_row_hash"), F.current_timestamp().alias("ingested_at"))


def typed_raw_rows(source: DataFrame, family: str, derived: tuple[str, ...] = (), root: str = "") -> DataFrame:
    """Raw layer of a family: its raw columns, resolution columns where the source has them, payload and hash.

    The first source column with a value is taken. A ``source_file`` column, else the file read, is named relative to ``root``.
    """
    if family not in RAW_COLUMNS:
        raise ValueError(f"unknown source family {family}")
    raw = raw_rows(source, family, derived)
    text = lambda c: clean_text(F.col(f"`{c}`")) if c in source.columns else F.lit(None).cast("string")
    kinds = {"text": lambda c: c, "number": lenient_double}
    own = [kinds[kind](F.coalesce(*map(text, columns))).alias(name) for name, kind, columns in RAW_COLUMNS[family]]
    path = text("source_file") if "source_file" in source.columns else F.col("_metadata.file_path") if "_metadata" in source.columns else F.lit("")
    plain = F.regexp_replace(F.coalesce(path, F.lit("")), "^file:/+", "/")
    prefix = root.rstrip("/") + "/"
    file = F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1 << 20)).otherwise(plain) if root else plain
    given = [text(c).alias(c) for c in ("canonical_machine_id", "matched_on", "matched_value", "scope_status", "join_status")]
    applied = F.coalesce(text("exception_applied").isin("1", "1.0", "true", "True"), F.lit(False)).cast("int").alias("exception_applied")
    return raw.select("source_system", file.alias("source_file"), "source_row_hash", "ingested_at", *given, applied, *own, "payload")


def source_kind(name: str) -> tuple[str, str]:
    """Family and status of a registered kind of file; only ``supported`` ones are normalised."""
    if name not in SOURCE_KINDS:
        raise KeyError(f"unknown kind of source {name}")
    return SOURCE_KINDS[name]


def payload_of(column: Column, keys: Sequence[str]) -> Column:
    """The payload as a struct of the given keys, parsed once for each row.

    The option keeps the optimizer from splitting it into a parse for each key that is used.
    """
    schema = StructType([StructField(k, StringType()) for k in dict.fromkeys(keys)])
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def _typed(kind: str, value: Column) -> Column:
    return {"text": clean_text, "number": lenient_double, "whole": lenient_int, "time": F.try_to_timestamp, "date": lambda c: F.to_date(F.try_to_timestamp(c))}[kind](value)


def clean_family(raw: DataFrame, family: str, registry: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """Cleaned layer of jobs, reports or works: each field from the payload's keys, then raw columns.

    Text of stamps that are none is kept in ``bad_stamps``, by field. With a registry ``canonical_machine_id`` is that of the raw row, else
    that of the first identifier that resolves (works have two), and ``resolution`` says how or why not.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown source family {family}")
    keys = [k for _, _, own, _ in FAMILIES[family] for k in own] + (list(MEMBER_KEYS) if family == "jobs" else [])
    blank = F.lit(None).cast("string")
    column = lambda c: clean_text(F.col(f"`{c}`")) if c in raw.columns else blank
    parsed = raw.withColumn("_p", payload_of(F.col("payload"), keys))
    texts = {name: F.coalesce(*[x for k in own for x in (clean_text(F.col(f"_p.`{k}`")), column(k))], *map(column, columns)) for name, _, own, columns in FAMILIES[family]}
    fields = [_typed(kind, texts[name]).alias(name) for name, kind, _, _ in FAMILIES[family]]
    stamps = [name for name, kind, _, _ in FAMILIES[family] if kind in ("time", "date")]
    lost = F.array_compact(F.array(*[F.when(texts[n].isNotNull() & F.try_to_timestamp(texts[n]).isNull(), F.struct(F.lit(n).alias("key"), texts[n].alias("value"))) for n in stamps]))
    members = [F.array_compact(F.array(*[clean_text(F.col(f"_p.`{k}`")) for k in MEMBER_KEYS])).alias("team_members")] if family == "jobs" else []
    given = column("canonical_machine_id")
    file = F.col("source_file") if "source_file" in raw.columns else blank.alias("source_file")
    out = parsed.select("source_row_hash", given.alias("canonical_machine_id"), *fields, *members, F.map_from_entries(lost).alias("bad_stamps"), file)
    if registry is None:
        return out
    found = resolve_chain(out.withColumnRenamed("canonical_machine_id", "_raw_canonical"), IDENTIFIERS[family], registry, family, "_raw_canonical", exceptions)
    return found.select("source_row_hash", "canonical_machine_id", *[c for c in out.columns if c not in ("source_row_hash", "canonical_machine_id")], "resolution")


#: A meter that wrote one value over these hours; its label, value, first and last hour.
SENTINEL = ("1024-10032/024-147印刷機UV", 99999999.9999, "2025-08-17 08:00:00", "2025-08-17 17:00:00")
#: Months and labels of meters that measured a part only.
PARTIAL_METERS = (
    ("2025-10", "印刷机024-094"), ("2025-10", "印刷機1024-10006（UV）"), ("2025-10", "印刷機1024-10006（主機）"), ("2025-10", "印刷機1024-10006（馬達）"), ("2025-10", "印刷機024-082風泵用電(測量)"), ("2025-11", "印刷機1024-10009（IR+UV）"),
    ("2026-01", "印刷機024-010"), ("2026-01", "印刷機024-075 UV"), ("2026-01", "印刷機024-075主機"), ("2026-01", "印刷機024-080主機"), ("2026-02", "印刷機024-080 UV"),
)
PARTIAL_FLAG = "localized_partial_meter_month"


def meter_quality(label: Column, hour: Column, kwh: Column, cost: Column, sentinel: tuple[str, float, str, str] = SENTINEL, partial: Sequence[tuple[str, str]] = PARTIAL_METERS) -> Column:
    """(exclude, status, flags): whether a reading is left out, and what is known about it, as a struct."""
    name, value, first, last = sentinel
    out = F.coalesce((label == name) & (kwh == value) & (cost == value) & hour.between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")), F.lit(False))
    month = F.date_format(hour, "yyyy-MM")
    known = F.concat_ws("\t", month, label).isin([f"{m}\t{x}" for m, x in partial]) if partial else F.lit(False)
    flags = F.when(out, F.to_json(F.struct(F.lit(True).alias("sentinel_anomaly_aug_2025")))).when(known, F.to_json(F.struct(month.alias("flagged_month"), F.lit(True).alias(PARTIAL_FLAG))))
    return F.struct(out.alias("exclude"), F.when(out, "excluded_invalid").when(known, "flagged_partial").otherwise("ok").alias("status"), flags.alias("flags"))


def clean_meters(raw: DataFrame, label: str = "machine", time: str = "datetime", kwh: str = "kwh", cost: str = "cost", faults: DataFrame | None = None, registry: DataFrame | None = None, exceptions: DataFrame | None = None, partial: Sequence[tuple[str, str]] = PARTIAL_METERS) -> DataFrame:
    """Cleaned meter hours: no summary rows, stamps exactly on the hour, component parsed from the label, no excluded readings.

    ``faults`` (month_key, label, flag) marks readings of labels known to be partial in a month, besides those of ``partial``. With a
    registry the raw row's machine, else the label's, is taken, and ``resolution`` says how.
    """
    ts = F.try_to_timestamp(F.col(time).cast("string"))
    rows = raw.filter(has_value(F.col(label)) & ~F.col(label).contains(SUMMARY_WORD)).withColumn("hour_ts", ts).filter("hour_ts = date_trunc('hour', hour_ts)")
    name = meter_label(F.col(label))
    given = clean_text(F.col("canonical_machine_id")) if "canonical_machine_id" in raw.columns else F.lit(None).cast("string")
    machine = given if registry is not None else F.coalesce(given, F.nullif(F.regexp_extract(name, r"(\d{3,4}-\d{3,5})", 1), F.lit("")))
    rows = rows.withColumn("_quality", meter_quality(F.trim(label), F.col("hour_ts"), lenient_double(F.col(kwh)), lenient_double(F.col(cost)), partial=partial)).filter("not _quality.exclude")
    out = rows.select("source_row_hash", machine.alias("canonical_machine_id"), F.trim(label).alias("raw_label"), name.alias("meter_label"), meter_component(F.col(label)).alias("meter_component"), "hour_ts", lenient_double(F.col(kwh)).alias("kwh"), lenient_double(F.col(cost)).alias("cost"), F.date_format("hour_ts", "yyyy-MM").alias("month_key"), F.col("_quality.status").alias("quality_status"), F.col("_quality.flags").alias("quality_flags"))
    if registry is not None:
        out = resolve_chain(out.withColumnRenamed("canonical_machine_id", "_raw_canonical"), ("raw_label",), registry, "meters", "_raw_canonical", exceptions).drop("_raw_canonical")
    out = out.withColumn("meter_is_aggregate", F.col("meter_component").isin("aggregate_total", "combo").cast("int")).withColumn("parse_confidence", parse_confidence(F.col("meter_component"), F.col("canonical_machine_id")))
    if faults is None:
        return out
    return out.join(faults.withColumnRenamed("label", "meter_label"), ["month_key", "meter_label"], "left").withColumn("quality_status", F.when(F.col("flag").isNotNull(), "flagged_partial").otherwise(F.col("quality_status")))


def read_sheet_export(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV that a sheet was exported to, as text; ``columns`` are those that a source may lack."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df if columns is None else df.select([F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def alias_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry CSV with (canonical_id, system, aliases); aliases are split at ``|``, ``;`` or ``,``."""
    rows = read_sheet_export(spark, path)
    return rows.select("canonical_id", "system", F.filter(F.transform(F.split("aliases", r"[|;,]"), lambda x: F.trim(x)), lambda x: x != "").alias("aliases"))
