"""The machine-hour fact: energy backbone, then overlays of jobs, quantity, reports, maintenance, idle and state.

Every overlay is a left join of one row per (machine, hour) onto the backbone, so the grain never
changes. Times are integer microseconds until a minute figure is derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import none_if_zero, order_suffix, team_size_of_manpower
from ..operators.timeops import allocate, asof_before, best_match, hour_of, overlap_join, overlap_minutes, running_distinct, trailing_sets, union_minutes

KEY = ["machine", "hour_us"]
OPERATIONAL = ["setup_minutes", "production_minutes", "planned_stop_minutes", "unplanned_stop_minutes"]


def backbone(meters: DataFrame) -> DataFrame:
    """One row per machine and hour; a total meter is preferred to the sum of components, combos are left out."""
    of = lambda name, col: F.sum(F.when(F.col("component") == name, F.col(col)))
    part = F.col("component").isin(*V.COMPONENTS)
    out = meters.filter((F.coalesce(F.trim("machine"), F.lit("")) != "") & F.col("hour_us").isNotNull()).groupBy(*KEY).agg(
        *[of("aggregate_total", c).alias(f"total_{c}") for c in ("kwh", "cost")],
        *[F.sum(F.when(part, F.col(c))).alias(f"part_{c}") for c in ("kwh", "cost")],
        *[of(name, "kwh").alias(f"{name}_kwh") for name in V.COMPONENTS],
        F.max(F.col("component") == "combo").alias("has_combo"),
        F.count("*").alias("source_rows"),
        F.sort_array(F.collect_set("hash")).alias("source_hashes"),
    )
    total = F.col("total_kwh").isNotNull() | F.col("total_cost").isNotNull()
    parts = F.col("part_kwh").isNotNull() | F.col("part_cost").isNotNull()
    return out.select(
        *KEY,
        F.when(total, F.col("total_kwh")).otherwise(F.col("part_kwh")).alias("energy_kwh"),
        F.when(total, F.col("total_cost")).otherwise(F.col("part_cost")).alias("energy_cost"),
        *[f"{name}_kwh" for name in V.COMPONENTS],
        F.when(total, "aggregate_total_preferred").when(parts, "component_sum_fallback").when(F.col("has_combo"), "combo_present_no_safe_total").otherwise("no_usable_energy_rows").alias("energy_method"),
        "source_rows",
        "source_hashes",
    )


def prepared_jobs(jobs: DataFrame) -> DataFrame:
    """Adds setup start, production start and the window that both span."""
    setup = F.when(F.col("changeover") >= 0, F.col("prep_end_us") - F.round(F.col("changeover") * V.MINUTE_US).cast("bigint"))
    out = jobs.withColumn("setup_us", setup).withColumn("from_us", F.coalesce("prep_end_us", "prod_start_us"))
    return out.withColumn("window_start", F.least("setup_us", "from_us")).withColumn("window_end", F.greatest("prep_end_us", "prod_end_us"))


def job_overlaps(hours: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row for each hour and job that overlap, with the job's minutes in that hour."""
    hour = F.col("hour_us")
    pairs = overlap_join(hours, prepared_jobs(jobs), "machine", "window_start", "window_end")
    pairs = pairs.withColumn("setup_overlap", overlap_minutes(F.col("setup_us"), F.col("prep_end_us"), hour)).withColumn("production_overlap", overlap_minutes(F.col("from_us"), F.col("prod_end_us"), hour))
    pairs = pairs.withColumn("total_overlap", F.col("setup_overlap") + F.col("production_overlap")).filter("total_overlap > 0")
    window = F.when(F.col("prod_end_us") > F.col("prep_end_us"), (F.col("prod_end_us") - F.col("prep_end_us")) / V.MINUTE_US)
    share = overlap_minutes(F.col("prep_end_us"), F.col("prod_end_us"), hour) / F.when(window > 0, window)
    known = F.col("prod_min") + F.col("planned_min") + F.col("unplanned_min")
    fits = window.isNotNull() & known.isNotNull() & (known - window <= F.greatest(F.lit(5.0), window * 0.05))
    return (
        pairs.withColumn("fractional", F.coalesce(fits, F.lit(False)))
        .withColumn("production", F.when(F.col("fractional"), F.col("prod_min") * share).otherwise(F.col("production_overlap")))
        .withColumn("planned", F.when(F.col("fractional"), F.col("planned_min") * share))
        .withColumn("unplanned", F.when(F.col("fractional"), F.col("unplanned_min") * share))
    )


def job_coverage(overlaps: DataFrame) -> DataFrame:
    """Minutes of each hour that any of its jobs covers."""
    end = F.col("hour_us") + V.HOUR_US
    clip = lambda s, e: F.struct(F.greatest(F.col(s), F.col("hour_us")).alias("s"), F.least(F.col(e), end).alias("e"))
    both = overlaps.select(*KEY, F.explode(F.array(F.when(F.col("setup_us").isNotNull(), clip("setup_us", "prep_end_us")), clip("from_us", "prod_end_us"))).alias("i"))
    return union_minutes(both.select(*KEY, "i.s", "i.e"), KEY)


def dominant_job(overlaps: DataFrame) -> DataFrame:
    return best_match(overlaps, KEY, [F.desc("total_overlap"), F.desc("production_overlap"), F.asc("hash")])


def job_blend(overlaps: DataFrame) -> DataFrame:
    """Sums over the jobs of an hour, scaled down to the covered minutes where they exceed them.

    The share of the sum is taken first: it is at most 1, so noise of summation lifts no minutes above those covered.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = overlaps.groupBy(*KEY).agg(zero("setup_overlap").alias("s"), zero("production").alias("p"), zero("planned").alias("l"), zero("unplanned").alias("u"), F.count("*").alias("n_jobs"), F.min("fractional").alias("all_fractional"))
    raw = F.col("s") + F.col("p") + F.col("l") + F.col("u")
    out = sums.join(job_coverage(overlaps), KEY).withColumn("raw_minutes", raw)
    over = (F.col("raw_minutes") > F.col("coverage") + 1e-9) & (F.col("raw_minutes") > 0)
    scale = F.when(over, F.col("coverage") / F.col("raw_minutes")).otherwise(1.0)
    fitted = lambda c: F.when(F.col("raw_minutes") > F.col("coverage"), F.col("coverage") * (F.col(c) / F.col("raw_minutes"))).otherwise(F.col(c))
    return out.select(
        *KEY, "n_jobs", "all_fractional", "coverage", "raw_minutes", scale.alias("scale"),
        F.when(over, V.CAPPED).when(F.col("n_jobs") > 1, V.WITHIN).otherwise(V.PASSTHROUGH).alias("contract"),
        *[fitted(c).alias(name) for c, name in zip("splu", OPERATIONAL, strict=True)],
    )


def state_of_minutes() -> Column:
    state = F.lit(None).cast("string")
    for name, column in reversed(list(zip(V.STATES[:4], OPERATIONAL, strict=True))):
        state = F.when(F.coalesce(F.col(column), F.lit(0.0)) > 0, name).otherwise(state)
    return state


def with_jobs(fact: DataFrame, jobs: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Dominant job, blended minutes and state of each hour."""
    overlaps = job_overlaps(fact if hours is None else hours, jobs)
    lead = dominant_job(overlaps).select(*KEY, F.col("hash").alias("job_hash"), "order_id", order_suffix(F.col("suffix")).alias("order_suffix"), "material", "task", "leader", F.col("production").alias("lead_production"), F.col("fractional").alias("lead_fractional"), "job_good", "job_scrap")
    out = fact.join(lead.join(job_blend(overlaps), KEY), KEY, "left")
    out = out.withColumn("machine_state", state_of_minutes())
    out = out.withColumn("state_confidence", F.when(F.col("machine_state").isNotNull(), F.when(F.col("n_jobs") > 1, "medium").otherwise("high")))
    return out.withColumn("several_jobs", F.coalesce((F.col("n_jobs") > 1).cast("int"), F.lit(0))).withColumns({c: none_if_zero(F.col(c)) for c in OPERATIONAL})


def with_quantity(fact: DataFrame) -> DataFrame:
    """Each job's pieces over the hours that it dominates, by its production minutes there."""
    basis = F.coalesce(F.when(F.col("lead_production") > 0, F.col("lead_production")), F.col("production_minutes"))
    part = F.coalesce("job_hash", F.concat(F.lit("\0"), F.xxhash64(*KEY)))
    out = fact.withColumns({"row_basis": basis, "_one": F.lit(1.0), "_part": part})
    for total, into in (("job_good", "good_qty"), ("job_scrap", "scrap_qty"), ("_one", "basis_share")):
        out = allocate(out, "job_hash", F.col("row_basis"), total, into, "_part")
    out = out.drop("_one", "_part")
    warning = F.when(F.col("job_hash").isNull(), "csi_qty_missing_source_row_hash").when(F.coalesce(F.col("row_basis"), F.lit(0.0)) <= 0, "csi_qty_no_positive_production_minutes").when(F.col("job_good").isNull() & F.col("job_scrap").isNull(), "csi_qty_missing_all").when(F.col("job_good").isNull(), "csi_qty_missing_good_qty").when(F.col("job_scrap").isNull(), "csi_qty_missing_scrap_qty")
    assigned = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in OPERATIONAL)
    broken = F.when(F.col("job_hash").isNull(), None).when(F.col("production_minutes") > 60, "production_minutes_gt_60").when(F.least(*OPERATIONAL) < -V.BUDGET_TOLERANCE, "negative_operational_minutes").when(assigned > 60 + V.BUDGET_TOLERANCE, "operational_minutes_exceed_hour_budget")
    gap = F.col("production_minutes") - F.col("row_basis")
    allocated = F.col("good_qty").isNotNull() | F.col("scrap_qty").isNotNull()
    alignment = F.when(F.col("job_hash").isNull(), None).when(F.coalesce(F.col("row_basis"), F.lit(0.0)) <= 0, "missing_positive_row_basis_minutes").when(F.col("production_minutes").isNull(), "missing_row_production_minutes").when(~allocated, "no_quantity_allocated").when(F.abs(gap) > V.MATERIAL_DIFFERENCE, "material_misaligned").otherwise("aligned")
    return out.withColumns({"qty_warning": warning, "budget_anomaly": broken, "basis_gap": gap, "alignment": alignment, "qty_confidence": F.when(allocated, F.when(F.col("lead_fractional"), "high").otherwise("medium"))})


def with_reports(fact: DataFrame, reports: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The report of the same machine, order, suffix and day: with manpower first, then nearest to the hour's end.

    ``wanted`` has the hours with their order if these come cheaper than from the fact.
    """
    day = lambda c: F.floor(F.col(c) / V.DAY_US)
    wanted = (fact if wanted is None else wanted).filter("order_id is not null").select(*KEY, "order_id", "order_suffix", day("hour_us").alias("day"))
    found = reports.select("machine", "order_id", order_suffix(F.col("suffix")).alias("order_suffix"), day("report_us").alias("day"), "report_us", "manpower", F.col("hash").alias("report_hash"))
    pairs = wanted.join(found, ["machine", "order_id", "order_suffix", "day"])
    distance = F.abs(F.col("report_us") - F.col("hour_us") - V.HOUR_US)
    best = best_match(pairs, KEY, [F.desc(F.coalesce(F.col("manpower"), F.lit(0.0)) > 0), distance.asc(), F.asc("report_hash")])
    return fact.join(best.select(*KEY, "report_us", "report_hash", "manpower", team_size_of_manpower(F.col("manpower")).alias("team_size")), KEY, "left")


def with_maintenance(fact: DataFrame, works: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Last transaction before the hour, distinct work orders of trailing windows, and those of the hour itself.

    ``hours`` has the keys of the fact if these come cheaper than from the fact.
    """
    hours = fact.select(*KEY) if hours is None else hours
    works = works.filter("txn_us is not null")
    last = asof_before(hours, works, "machine", "txn_us", "hash", ["hash", "work_type"])
    counts = trailing_sets(hours, works, "machine", "txn_us", "work_order", {"works_7d": 7 * 24, "works_30d": 30 * 24})
    ever = running_distinct(hours, works, "machine", "txn_us", "work_order", "works_ever")
    types = works.groupBy("machine", hour_of(F.col("txn_us")).alias("hour_us")).agg(F.sort_array(F.collect_set("work_type")).alias("work_types"))
    out = fact
    for more, how in ((last, "left"), (counts, "left"), (ever, "left"), (types, "left")):
        out = out.join(more, KEY, how)
    return out.withColumnRenamed("in_hour", "works_in_hour").withColumn("hours_since", (F.col("hour_us") - F.col("last_us")) / V.HOUR_US).withColumn("maintenance_in_hour", (F.col("works_in_hour") > 0).cast("int"))


def with_idle(fact: DataFrame) -> DataFrame:
    """Residual minutes of hours that jobs cover wholly with reconciled minutes and no maintenance."""
    assigned = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in OPERATIONAL)
    skipped = F.when(F.col("job_hash").isNull(), "idle_missing_csi_source").when(F.col("maintenance_in_hour") == 1, "idle_same_hour_maintenance").when(~F.col("all_fractional"), "idle_non_fractional_csi_minutes").when(F.col("coverage") < V.FULL_HOUR, "idle_partial_csi_coverage").when(60 - assigned <= -0.5, "idle_negative_residual")
    out = fact.withColumn("idle_skipped", skipped)
    rest = 60 - assigned
    out = out.withColumn("idle_minutes", F.when(F.col("idle_skipped").isNull(), F.when(F.abs(rest) < 0.5, 0.0).otherwise(rest)))
    stands = (F.col("idle_minutes") > 0) & (F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in OPERATIONAL]) <= 0)
    return out.withColumns({"machine_state": F.when(stands, "idle").otherwise(F.col("machine_state")), "state_confidence": F.when(stands, "high").otherwise(F.col("state_confidence"))})


def with_state_review(fact: DataFrame) -> DataFrame:
    """Maintenance takes an hour only when nothing else claims it; else the first reason against."""
    busy = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in OPERATIONAL]) > 0
    pieces = F.greatest(F.coalesce("good_qty", F.lit(0.0)), F.coalesce("scrap_qty", F.lit(0.0))) > 0
    blocked = (
        F.when(F.col("maintenance_in_hour") == 0, "maintenance_state_no_same_hour_maintenance")
        .when(F.col("works_in_hour") < 1, "maintenance_state_missing_work_order_in_hour")
        .when(F.col("several_jobs") != 0, "maintenance_state_multiple_csi_overlap")
        .when(busy, "maintenance_state_conflicting_operational_minutes")
        .when(pieces, "maintenance_state_conflicting_quantity")
        .when(F.col("machine_state").isNotNull() & (F.col("machine_state") != "idle"), "maintenance_state_existing_non_idle_state")
        .when(F.col("job_hash").isNotNull() & (F.col("coverage") >= 1), "maintenance_state_existing_csi_overlap")
    )
    out = fact.withColumn("promotion_blocked", blocked)
    promoted = F.col("promotion_blocked").isNull()
    return out.withColumns({"machine_state": F.when(promoted, "maintenance").otherwise(F.col("machine_state")), "state_confidence": F.when(promoted, "low").otherwise(F.col("state_confidence")), "maintenance_minutes": F.lit(None).cast("double")})


def machine_hours(meters: DataFrame, jobs: DataFrame, reports: DataFrame, works: DataFrame) -> DataFrame:
    """The whole fact, over all months at once.

    Overlays take their hours from the meters again, not from the growing fact, so that no overlay
    is planned more than once.
    """
    hours = meters.filter((F.coalesce(F.trim("machine"), F.lit("")) != "") & F.col("hour_us").isNotNull()).select(*KEY).distinct()
    ordered = dominant_job(job_overlaps(hours, jobs)).select(*KEY, "order_id", order_suffix(F.col("suffix")).alias("order_suffix"))
    fact = with_quantity(with_jobs(backbone(meters), jobs, hours))
    return with_state_review(with_idle(with_maintenance(with_reports(fact, reports, ordered), works, hours)))


def quantity_shadow(fact: DataFrame) -> DataFrame:
    """Re-allocation of each job's landed pieces by production minutes, where every row of the job is fit for it."""
    from pyspark.sql import Window

    has = F.col("good_qty").isNotNull() | F.col("scrap_qty").isNotNull()
    rank = F.when(~has, None).when(F.col("budget_anomaly").isNotNull(), 1).when(F.coalesce(F.col("row_basis"), F.lit(0.0)) <= 0, 2).when(F.coalesce(F.col("production_minutes"), F.lit(0.0)) <= 0, 3)
    group = Window.partitionBy("job_hash")
    out = fact.filter("job_hash is not null").withColumn("_worst", F.min(rank).over(group)).withColumn("_any", F.max(has).over(group))
    reason = F.when(~F.col("_any"), "group_has_no_quantity_rows").when(F.col("_worst") == 1, "minute_budget_anomaly").when(F.col("_worst") == 2, "missing_positive_quantity_basis_minutes").when(F.col("_worst") == 3, "missing_positive_production_minutes")
    basis = F.sum(F.when(has, F.coalesce("production_minutes", F.lit(0.0)))).over(group)
    out = out.withColumn("shadow_reason", F.when(reason.isNull() & (F.coalesce(basis, F.lit(0.0)) <= 0), "non_positive_shadow_basis_total").otherwise(reason)).withColumn("_basis", basis)
    fit = F.col("shadow_reason").isNull() & has
    share = F.coalesce("production_minutes", F.lit(0.0)) / F.when(F.col("_basis") > 0, F.col("_basis"))
    new = lambda c: F.when(fit, F.sum(F.when(has, F.coalesce(c, F.lit(0.0)))).over(group) * share).otherwise(F.col(c))
    out = out.withColumns({"shadow_good": new("good_qty"), "shadow_scrap": new("scrap_qty"), "shadow_eligible": fit.cast("int")})
    return out.drop("_worst", "_any", "_basis")
