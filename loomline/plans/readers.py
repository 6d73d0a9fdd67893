"""Analytic readers over the machine-hour fact: energy, state, efficiency, scoring, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import band, first_max_label, machine_family, minmax, safe_divide, shift_label, task_difficulty

BUCKETS = {state: f"{state}_kwh" for state in V.STATES}


def with_time(fact: DataFrame) -> DataFrame:
    ts = F.timestamp_micros("hour_us")
    return fact.withColumns({"hour_ts": ts, "hour": F.hour(ts), "day": F.to_date(ts), "month_key": F.date_format(ts, "yyyy-MM"), "family": machine_family(F.col("machine"))})


def _zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def energy_rows(fact: DataFrame) -> DataFrame:
    """Energy of each hour by state: by minute share, else by the row's state, else unallocated."""
    minutes = {s: F.greatest(_zero(c), F.lit(0.0)) for s, c in V.MINUTES.items()}
    out = with_time(fact).withColumn("tracked_minutes", sum(_zero(c) for c in V.MINUTES.values()))
    kwh, shared = F.col("energy_kwh"), F.col("tracked_minutes") > 0
    out = out.withColumn("attribution", F.when(_zero("energy_kwh") <= 0, "no_energy").when(shared, "minute_share").when(F.col("machine_state").isin(*V.STATES), "machine_state_fallback").otherwise("unallocated"))
    bucket = lambda s: F.when(F.col("attribution") == "minute_share", kwh * minutes[s] / F.col("tracked_minutes")).when((F.col("attribution") == "machine_state_fallback") & (F.col("machine_state") == s), kwh).otherwise(0.0)
    out = out.withColumns({name: bucket(s) for s, name in BUCKETS.items()})
    rest = kwh - sum(F.col(c) for c in BUCKETS.values())
    out = out.withColumn("unallocated_kwh", F.when(F.col("attribution") == "unallocated", kwh).when((F.col("attribution") == "minute_share") & (rest > 1e-9), rest).otherwise(0.0))
    return out.withColumn("kwh_per_good", F.when(F.col("good_qty") > 0, kwh / F.col("good_qty")))


def qualifying(df: DataFrame) -> Column:
    return df["energy_kwh"].isNotNull() & (df["good_qty"] > 0)


def ratio(df: DataFrame) -> Column:
    """Sum of energy over sum of pieces, on qualifying rows only."""
    ok = qualifying(df)
    return safe_divide(F.sum(F.when(ok, df["energy_kwh"])), F.sum(F.when(ok, df["good_qty"])))


def month_summary(energy: DataFrame) -> DataFrame:
    return energy.groupBy("month_key").agg(F.count("*").alias("n_rows"), F.countDistinct("machine").alias("machines"), F.sum("energy_kwh").alias("kwh"), F.sum("good_qty").alias("good"), F.count_if(qualifying(energy)).alias("qualifying_rows"), ratio(energy).alias("kwh_per_good"))


def breakdown(energy: DataFrame) -> DataFrame:
    """Bucket totals of the whole table as rows, positive ones."""
    names = [*BUCKETS.values(), "unallocated_kwh"]
    totals = energy.agg(*[F.sum(c).alias(c) for c in names])
    return totals.unpivot([], names, "bucket", "kwh").filter("kwh > 0")


def daily_states(energy: DataFrame) -> DataFrame:
    return energy.groupBy("day").agg(F.sum("energy_kwh").alias("kwh"), *[F.sum(c).alias(c) for c in (*BUCKETS.values(), "unallocated_kwh")])


def daily_anomalies(daily: DataFrame) -> DataFrame:
    """Days outside 1.5 interquartile ranges, if there are four days or more."""
    q = daily.agg(F.percentile("kwh", F.lit(0.25)).alias("q1"), F.percentile("kwh", F.lit(0.75)).alias("q3"), F.count("*").alias("n")).withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    kind = F.when(F.col("kwh") > F.col("high"), "High").when(F.col("kwh") < F.col("low"), "Low")
    return daily.crossJoin(F.broadcast(q)).filter((F.col("n") >= 4) & kind.isNotNull()).select("day", "kwh", "low", "high", kind.alias("anomaly"))


def hourly_profile(energy: DataFrame) -> DataFrame:
    return energy.filter("energy_kwh is not null").groupBy("hour").agg(F.avg("energy_kwh").alias("mean_kwh"), F.sum("energy_kwh").alias("kwh"), F.count("*").alias("n_rows"))


def attribution_trust(energy: DataFrame) -> DataFrame:
    every = Window.partitionBy()
    out = energy.groupBy("attribution").agg(F.count("*").alias("n_rows"), F.sum(_zero("energy_kwh")).alias("kwh"))
    return out.withColumns({"row_share": F.col("n_rows") / F.sum("n_rows").over(every), "kwh_share": safe_divide(F.col("kwh"), F.sum("kwh").over(every))})


def attribution_coverage(energy: DataFrame) -> DataFrame:
    used = F.col("attribution").isin("minute_share", "machine_state_fallback")
    total = F.sum(_zero("energy_kwh"))
    return energy.groupBy("month_key").agg(total.alias("kwh"), F.sum(F.when(used, F.col("energy_kwh") - F.col("unallocated_kwh")).otherwise(0.0)).alias("allocated_kwh"), F.sum("unallocated_kwh").alias("unallocated_kwh"), F.count_if(F.col("attribution") == "minute_share").alias("by_minutes"), F.count_if(F.col("attribution") == "machine_state_fallback").alias("by_state")).withColumn("share", safe_divide(F.col("allocated_kwh"), F.col("kwh")))


def machine_energy(energy: DataFrame, least_rows: int = 1, least_good: float = 0.0) -> DataFrame:
    ok = qualifying(energy)
    out = energy.groupBy("machine").agg(F.count_if(ok).alias("n_rows"), F.sum(F.when(ok, energy["energy_kwh"])).alias("kwh"), F.sum(F.when(ok, energy["good_qty"])).alias("good"), ratio(energy).alias("kwh_per_good"), F.sum("energy_kwh").alias("all_kwh"))
    return out.filter((F.col("n_rows") >= least_rows) & (F.col("good") > least_good))


def efficiency_ranking(energy: DataFrame, limit: int = 20) -> DataFrame:
    return machine_energy(energy).orderBy("kwh_per_good", F.desc("good"), "machine").limit(limit)


def maintenance_age_curve(energy: DataFrame, least: int = 20) -> DataFrame:
    edges = [0, 200, 500, 800, 1200, 2000, 4000]
    place = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        place = F.when((F.col("hours_since") > low) & (F.col("hours_since") <= high), i).otherwise(place)
    ok = energy.filter((F.col("kwh_per_good") > 0) & (F.col("kwh_per_good") < 20)).withColumn("bucket", place).filter("bucket is not null")
    return ok.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.avg("hours_since").alias("mean_hours"), safe_divide(F.sum("energy_kwh"), F.sum("good_qty")).alias("kwh_per_good")).filter(F.col("n_rows") >= least)


def state_summary(fact: DataFrame) -> DataFrame:
    every = Window.partitionBy()
    out = fact.groupBy(F.coalesce("machine_state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n_rows"), F.sum(_zero("energy_kwh")).alias("kwh"))
    return out.withColumn("row_share", F.col("n_rows") / F.sum("n_rows").over(every))


def scored_rows(fact: DataFrame) -> DataFrame:
    """Rows with the safe energy and pieces and the minutes that the scores use."""
    ok = F.coalesce(F.col("energy_kwh").isNotNull() & (F.col("good_qty") > 0), F.lit(False))
    idle = sum(_zero(c) for c in ("setup_minutes", "planned_stop_minutes", "unplanned_stop_minutes", "idle_minutes"))
    return with_time(fact).withColumns({"ok": ok.cast("int"), "safe_kwh": F.when(ok, F.col("energy_kwh")).otherwise(0.0), "safe_good": F.when(ok, F.col("good_qty")).otherwise(0.0), "lost_minutes": idle, "tracked": idle + _zero("production_minutes"), "shift": shift_label(F.hour(F.timestamp_micros("hour_us")))})


def _common() -> list[Column]:
    return [F.sum("ok").alias("eligible_rows"), F.sum("safe_kwh").alias("kwh"), F.sum("safe_good").alias("good"), F.coalesce(F.sum("scrap_qty"), F.lit(0.0)).alias("scrap"), F.sum("tracked").alias("tracked"), F.coalesce(F.sum("production_minutes"), F.lit(0.0)).alias("production"), F.sum("lost_minutes").alias("lost"), F.avg("hours_since").alias("mean_hours_since"), F.coalesce(F.sum("good_qty"), F.lit(0.0)).alias("all_good")]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"kwh_per_good": safe_divide(F.col("kwh"), F.col("good")), "utilization": safe_divide(F.col("production"), F.col("tracked")), "scrap_rate": safe_divide(F.col("scrap"), F.col("all_good") + F.col("scrap")), "lost_share": safe_divide(F.col("lost"), F.col("tracked"))})


def machine_opportunity(fact: DataFrame) -> DataFrame:
    """Where there is most to gain: energy per piece, lost time, time since maintenance and scrap."""
    out = _rates(scored_rows(fact).groupBy("machine", "family").agg(*_common(), F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("all_kwh"), F.count_if(F.col("machine_state") == "maintenance").alias("maintenance_hours"), F.count_if(F.col("machine_state") == "production").alias("production_hours"), F.count_if(F.col("machine_state") == "setup_changeover").alias("setup_hours")))
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), _zero(c)))
    out = out.withColumns({"part0": minmax(F.col("kwh_per_good")), "part1": share("lost_share"), "part2": minmax(F.col("mean_hours_since")), "part3": share("scrap_rate")})
    parts = [F.col(f"part{i}") for i in range(4)]
    score = F.round(sum(p * w for p, w in zip(parts, (0.40, 0.30, 0.15, 0.15), strict=True)), 4)
    out = out.withColumns({"score": score, "driver": first_max_label(parts, V.OPPORTUNITY_DRIVERS, V.NO_OPPORTUNITY)})
    return out.withColumn("flag", band(F.col("score"), 0.55, 0.30)).select("machine", "family", "eligible_rows", "all_kwh", "all_good", "kwh_per_good", "scrap_rate", "utilization", "lost_share", "mean_hours_since", "maintenance_hours", "production_hours", "setup_hours", "score", "flag", "driver")


def schedule_summary(fact: DataFrame) -> DataFrame:
    out = _rates(scored_rows(fact).groupBy("hour", "shift").agg(*_common(), F.countDistinct("machine").alias("machines")).filter("eligible_rows > 0"))
    parts = [(1 - minmax(F.col("kwh_per_good"))) * 0.55, F.least(_zero("utilization"), F.lit(1.0)) * 0.30, minmax(F.col("good")) * 0.15]
    out = out.withColumn("score", F.round(sum(parts), 4))
    return out.withColumn("flag", band(F.col("score"), 0.67, 0.40)).select("hour", "shift", "eligible_rows", "machines", "kwh", "good", "kwh_per_good", "utilization", "score", "flag")


def team_insights(fact: DataFrame) -> DataFrame:
    out = _rates(scored_rows(fact).filter("leader is not null").groupBy("leader").agg(*_common(), F.count("*").alias("n_rows"), F.countDistinct("machine").alias("machines")).filter("good > 0"))
    parts = [(1 - minmax(F.col("kwh_per_good"))) * 0.45, F.least(_zero("utilization"), F.lit(1.0)) * 0.25, (1 - F.least(_zero("scrap_rate"), F.lit(1.0))) * 0.20, minmax(F.col("good")) * 0.10]
    out = out.withColumn("score", F.round(sum(parts), 4))
    return out.withColumn("band", band(F.col("score"), 0.67, 0.40)).select("leader", "n_rows", "machines", "kwh", "good", "kwh_per_good", "scrap_rate", "utilization", "mean_hours_since", "score", "band")


def coverage_snapshot(fact: DataFrame) -> DataFrame:
    """Filtered counts in one pass."""
    tests = {"n_rows": F.lit(True), "with_job": F.col("job_hash").isNotNull(), "with_state": F.col("machine_state").isNotNull(), "with_quantity": F.col("good_qty").isNotNull(), "with_report": F.col("report_hash").isNotNull(), "with_last_maintenance": F.col("last_us").isNotNull(), "with_maintenance_in_hour": F.col("maintenance_in_hour") == 1, "several_jobs": F.col("several_jobs") == 1, "with_idle": F.col("idle_minutes") > 0, "budget_anomalies": F.col("budget_anomaly").isNotNull(), "misaligned": F.col("alignment") == "material_misaligned", "promoted": F.col("promotion_blocked").isNull()}
    return fact.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def _other_minutes() -> Column:
    return F.greatest(_zero("setup_minutes"), _zero("planned_stop_minutes"), _zero("unplanned_stop_minutes"), _zero("idle_minutes")) > 0


def readiness(fact: DataFrame) -> DataFrame:
    """Model inputs of each row with the first reason that blocks it, fallbacks and notes."""
    gap = (
        F.when(F.col("budget_anomaly").isNotNull() | (F.col("alignment") == "missing_positive_row_basis_minutes") | (F.col("qty_warning") == "csi_qty_no_positive_production_minutes"), "source_quality_or_anomaly")
        .when(F.col("alignment") == "material_misaligned", "order_or_material_context_conflict")
        .when((F.col("production_minutes") > 0) & _other_minutes(), "state_label_contradiction")
        .when((F.col("production_minutes") > 0) & F.col("order_id").isNotNull() & F.col("material").isNotNull() & F.col("task").isNotNull(), "quantity_overlay_gap")
        .otherwise("production")
    )
    no_pieces = F.when(F.col("machine_state").isin("setup_changeover", "planned_stop", "unplanned_stop", "idle", "maintenance"), "nonproductive").when(F.col("machine_state") == "production", gap).otherwise("insufficient_context")
    size = F.when(F.col("team_size") > 0, F.col("team_size"))
    out = with_time(fact).withColumn("difficulty", task_difficulty(F.col("task")))
    blocked = F.when(~F.coalesce(F.col("good_qty") > 0, F.lit(False)), no_pieces).when(F.col("hours_since").isNull(), "missing_hours_since_last_maintenance").when(F.col("difficulty").isNull(), "unmapped_task_name")
    notes = F.concat_ws("; ", F.when(size.isNull(), "team_size_from_preprocessor_default"), F.when(F.col("difficulty").isNull(), "task_difficulty_unmapped"), F.when(F.col("last_work_type").isNull(), "last_maintenance_type_unknown"), F.when(F.col("leader").isNull(), "team_leader_unknown"), F.when(F.col("material").isNull(), "material_code_unknown"))
    return out.select("machine", "family", "hour_us", "hour", "month_key", "day", F.coalesce("material", F.lit("unknown")).alias("material"), F.coalesce("leader", F.lit("unknown")).alias("leader"), "task", "difficulty", "good_qty", F.coalesce(size, F.lit(3.0)).alias("team_size"), "hours_since", F.coalesce("last_work_type", F.lit("unknown")).alias("last_work_type"), "works_30d", "works_ever", "energy_kwh", notes.alias("notes"), blocked.alias("blocked_reason"), blocked.isNull().cast("int").alias("eligible"))


def inference_coverage(inputs: DataFrame) -> DataFrame:
    """Rows in each of four fixed buckets, also empty ones, and their share."""
    bucket = F.when(F.col("eligible") == 0, "blocked").when(F.col("notes").contains("default"), "eligible_with_default").when(F.col("notes") != "", "eligible_with_notes").otherwise("eligible_clean")
    counts = inputs.groupBy(bucket.alias("bucket")).count()
    fixed = inputs.sparkSession.createDataFrame([(b,) for b in ("eligible_clean", "eligible_with_notes", "eligible_with_default", "blocked")], "bucket string")
    out = fixed.join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n_rows"))
    return out.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def blocked_reasons(inputs: DataFrame) -> DataFrame:
    out = inputs.filter("eligible = 0").groupBy("blocked_reason").agg(F.count("*").alias("n_rows"))
    return out.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def latest_per_machine(inputs: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("machine").orderBy(F.desc("hour_us")))
    return inputs.filter("eligible = 1").withColumn("_r", rank).filter("_r = 1").drop("_r")


def _median_of_others(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds ``<name>`` and ``<name>_n``: the median of the other rows of the group and how many there are.

    From the rank of a row in its group and the three values around the middle, so rows do not meet each other in pairs; NULL values count as rows only.
    """
    group = Window.partitionBy(*keys)
    out = rows.withColumns({"_r": F.row_number().over(group.orderBy(F.col(value).asc_nulls_last(), "machine")), "_n": F.count(value).over(group), f"{name}_n": F.count("*").over(group) - 1}).withColumn("_h", F.expr("_n div 2"))
    out = out.withColumns({f"_{k}": F.max(F.when(F.col("_r") == F.col("_h") + k, F.col(value))).over(group) for k in range(3)})
    low, mid, high = (F.col(f"_{k}") for k in range(3))
    left = F.when(F.col("_h") < F.col("_r"), low).otherwise(mid)
    right = F.when(F.col("_h") + 1 < F.col("_r"), mid).otherwise(high)
    even = F.col("_n") % 2 == 0
    median = F.when(F.col("_r") > F.col("_n"), F.when(even, (low + mid) / 2).otherwise(mid)).when(even, left).otherwise((left + right) / 2)
    return out.withColumn(name, median).drop("_r", "_n", "_h", "_0", "_1", "_2")


def peer_baseline(inputs: DataFrame, value: str = "kwh_per_good", least_family: int = 3, least_difficulty: int = 5) -> DataFrame:
    """Median of the peers' values without the row itself: same family and difficulty, else same difficulty, else all. A row for each machine."""
    rows = inputs.select("machine", "family", "difficulty", value)
    for name, keys in (("m1", ["family", "difficulty"]), ("m2", ["difficulty"]), ("m3", [])):
        rows = _median_of_others(rows, keys, value, name)
    known = F.col("difficulty").isNotNull()  # rows without one have no peers by it
    near, same = known & (F.col("m1_n") >= least_family), known & (F.col("m2_n") >= least_difficulty)
    return rows.filter("m3_n > 0").select("machine", F.when(near, F.col("m1")).when(same, F.col("m2")).otherwise(F.col("m3")).alias("baseline"), F.when(near, "family").when(same, "difficulty").otherwise("all").alias("level"))
