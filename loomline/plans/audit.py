"""Audit metadata of quantities for landed rows: the basis of each row rebuilt from its job, without a change of pieces or minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators.timeops import overlap_minutes
from ..scratch import scratch_path
from ..sources.patches import patch_table, scope
from ..sources.sinks import replace_months
from . import gold_sql as S
from .bindings import bound
from .catalog import _quantity, query
from .gold import OPERATIONAL
from .periods import period_of

BASIS_METHOD = "csi_dominant_event_production_minutes_share"
#: Columns that the backfill sets.
AUDIT = ["basis_method", "row_basis", "event_basis", "basis_gap", "basis_abs_gap", "alignment", "misaligned", "budget_flag", "budget_anomaly"]
#: Keys of the flags that the backfill owns.
AUDIT_KEYS = ("csi_qty_basis_method", "csi_qty_reconstruction_status")


def budget_anomaly() -> Column:
    """Why a row's minutes do not fit its hour; NULL if they do."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = sum((zero(c) for c in OPERATIONAL[1:]), zero(OPERATIONAL[0]))
    return F.when(F.col("production_minutes") > 60, "production_minutes_gt_60").when(F.least(*map(zero, OPERATIONAL)) < -V.BUDGET_TOLERANCE, "negative_operational_minutes").when(total > 60 + V.BUDGET_TOLERANCE, "operational_minutes_exceed_hour_budget")


def rebuilt_basis(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """``rows`` with ``basis`` and ``status``: the landed basis if it is positive, else the job's minutes in the hour, else what the flags say.

    Rows whose minutes exceed the hour get none; nor do those whose flags name another job.
    """
    times = jobs.select(F.col("hash").alias("job_hash"), "prod_start_us", "prep_end_us", "prod_end_us", "prod_min", "planned_min", "unplanned_min")
    both = rows.join(times, "job_hash", "left")
    hour, flag = F.col("hour_us"), lambda k: F.get_json_object("flags", f"$.{k}")
    start = F.coalesce("prep_end_us", "prod_start_us")
    overlap = overlap_minutes(start, F.col("prod_end_us"), hour)
    after = overlap_minutes(F.col("prep_end_us"), F.col("prod_end_us"), hour)
    span = F.when(F.col("prod_end_us") > F.col("prep_end_us"), (F.col("prod_end_us") - F.col("prep_end_us")) / V.MINUTE_US)
    fits = F.coalesce(F.col("prod_min") + F.col("planned_min") + F.col("unplanned_min") - span <= F.greatest(F.lit(5.0), span * 0.05), F.lit(False))
    of_job = F.when(fits, F.col("prod_min") * (after / span)).when(overlap > 0, overlap)
    told, teller = flag("csi_dominant_production_minutes").try_cast("double"), flag("dominant_csi_source_row_hash")
    anomaly, landed = F.col("budget_anomaly").isNotNull(), F.col("row_basis") > 0
    other = (told > 0) & teller.isNotNull() & (teller != F.col("job_hash"))
    basis = F.when(landed, F.col("row_basis")).when(anomaly, None).when(fits | (overlap > 0), of_job).when(other, None).when(told > 0, told)
    rebuilt = (fits & (of_job > 0)) | (overlap > 0)
    status = (
        F.when(landed, "preserved_existing_landed_positive_basis").when(anomaly, "excluded_minute_budget_anomaly").when(rebuilt, "reconstructed_from_csi_event").when(other, "blocked_dominant_identity_conflict")
        .when((told > 0) & teller.isNull(), "reconstructed_from_source_flags_missing_dominant_hash_flag").when(told > 0, "reconstructed_from_source_flags_matching_dominant_hash").otherwise("missing_positive_dominant_basis_evidence")
    )
    return both.withColumns({"basis": basis, "status": status}).drop(*[c for c in times.columns if c != "job_hash"])


def audit_rows(rows: DataFrame, jobs: DataFrame, start: int | None = None, end: int | None = None, several_only: bool = True, pieces_only: bool = True) -> DataFrame:
    """(machine, hour_us, period, audit columns, flags, status) of the landed rows in scope.

    A job's basis is the sum of those of its rows in scope. ``rows`` has the columns of the fact, ``flags`` (JSON) and ``period``.
    """
    has = F.col("good_qty").isNotNull() | F.col("scrap_qty").isNotNull()
    chosen = rows.filter(F.col("job_hash").isNotNull() & scope(start, end))
    chosen = chosen.filter("several_jobs = 1") if several_only else chosen
    chosen = chosen.filter(has) if pieces_only else chosen
    based = rebuilt_basis(chosen.withColumn("budget_anomaly", budget_anomaly()), jobs)
    sums = based.groupBy("job_hash").agg(F.nullif(F.sum(F.when(F.col("basis") > 0, F.col("basis")).otherwise(0.0)), F.lit(0.0)).alias("event_basis"))
    gap = F.col("production_minutes") - F.col("basis")
    usable = F.coalesce(F.col("basis") > 0, F.lit(False))
    alignment = F.when(~usable, "missing_positive_row_basis_minutes").when(F.col("production_minutes").isNull(), "missing_row_production_minutes").when(~has, "no_quantity_allocated").when(F.abs(gap) > V.MATERIAL_DIFFERENCE, "material_misaligned").otherwise("aligned")
    out = based.drop("event_basis").join(sums, "job_hash")
    return out.select(
        "machine", "hour_us", "period", F.lit(BASIS_METHOD).alias("basis_method"), F.col("basis").alias("row_basis"), "event_basis", gap.alias("basis_gap"), F.abs(gap).alias("basis_abs_gap"), alignment.alias("alignment"),
        (alignment == "material_misaligned").cast("int").alias("misaligned"), F.col("budget_anomaly").isNotNull().cast("int").alias("budget_flag"), "budget_anomaly",
        F.to_json(F.create_map(F.lit(AUDIT_KEYS[0]), F.lit(BASIS_METHOD), F.lit(AUDIT_KEYS[1]), F.col("status"))).alias("flags"), "status",
    )


def backfill_audit(spark: SparkSession, path: str, jobs: DataFrame, **scoped: object) -> dict[str, int]:
    """Set the audit columns and flags of the rows in scope of a landed table; rows by what became of them."""
    found = spark.read.parquet(path)
    changes = audit_rows(found.withColumn("period", F.col("period").cast("string")), jobs, **scoped)
    counts = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    done = patch_table(spark, path, changes.drop("status"), ["machine", "hour_us"], AUDIT, "period", "flags", AUDIT_KEYS)
    return counts | {"target_rows": sum(counts.values()), "patched_rows": done["rows"], "patched_months": done["months"]}


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with pieces as an older run landed it: a third of the rows without basis, flags of its own, no audit."""
    rows = _quantity(spark, sf_dir).withColumn("third", F.col("hour_us") / V.HOUR_US % 3)
    old = F.to_json(F.create_map(F.lit("origin"), F.lit("landed"), F.lit(AUDIT_KEYS[1]), F.lit("stale")))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = rows.select("machine", "hour_us", "job_hash", *OPERATIONAL, "good_qty", "scrap_qty", "several_jobs", F.when(F.col("third") != 0, F.col("row_basis")).alias("row_basis"), text.alias("basis_method"), number.alias("event_basis"), number.alias("basis_gap"), number.alias("basis_abs_gap"), text.alias("alignment"), F.lit(0).alias("misaligned"), F.lit(0).alias("budget_flag"), text.alias("budget_anomaly"), old.alias("flags"))
    return rows.withColumn("period", period_of(F.col("hour_us"), "week"))


_FILLED = f"""l AS MATERIALIZED (SELECT *, CASE WHEN hour_us // 3600000000 % 3 <> 0 THEN row_basis END AS kept FROM fq),
a0 AS (SELECT machine, hour_us, job_hash, production_minutes, good_qty, scrap_qty, budget_anomaly, CASE WHEN kept > 0 THEN kept WHEN budget_anomaly IS NOT NULL THEN NULL ELSE lead_production END AS basis,
  CASE WHEN kept > 0 THEN 'preserved_existing_landed_positive_basis' WHEN budget_anomaly IS NOT NULL THEN 'excluded_minute_budget_anomaly' WHEN lead_production > 0 THEN 'reconstructed_from_csi_event' ELSE 'missing_positive_dominant_basis_evidence' END AS status
  FROM l WHERE job_hash IS NOT NULL AND several_jobs = 1 AND (good_qty IS NOT NULL OR scrap_qty IS NOT NULL)),
a AS MATERIALIZED (SELECT *, nullif(sum(CASE WHEN basis > 0 THEN basis ELSE 0 END) OVER (PARTITION BY job_hash), 0) AS event_basis FROM a0)"""


@query(f"SELECT l.machine, l.hour_us, l.good_qty, CASE WHEN a.machine IS NULL THEN l.kept ELSE a.basis END AS row_basis, a.event_basis, abs(a.production_minutes - a.basis) AS basis_abs_gap, CASE WHEN a.machine IS NULL THEN NULL WHEN a.basis IS NULL OR a.basis <= 0 THEN 'missing_positive_row_basis_minutes' WHEN a.production_minutes IS NULL THEN 'missing_row_production_minutes' WHEN abs(a.production_minutes - a.basis) > 0.5 THEN 'material_misaligned' ELSE 'aligned' END AS alignment, a.budget_anomaly, CASE WHEN a.machine IS NULL THEN '{{\"origin\":\"landed\",\"csi_qty_reconstruction_status\":\"stale\"}}' ELSE '{{\"csi_qty_basis_method\":\"{BASIS_METHOD}\",\"csi_qty_reconstruction_status\":\"' || a.status || '\",\"origin\":\"landed\"}}' END AS flags FROM l LEFT JOIN a ON a.machine = l.machine AND a.hour_us = l.hour_us", S.QUANTITY + ",\n" + _FILLED, "good_qty row_basis event_basis basis_abs_gap")
def audit_backfill(spark, sf_dir):
    """Landed rows after the audit columns of hours with several jobs were filled in; the others are as they were."""
    path = f"{scratch_path(spark, 'landed')}/fact"
    replace_months(landed(spark, sf_dir), path, "period")
    backfill_audit(spark, path, bound(spark, sf_dir)["jobs"])
    return spark.read.parquet(path).select("machine", "hour_us", "good_qty", "row_basis", "event_basis", "basis_abs_gap", "alignment", "budget_anomaly", "flags")
