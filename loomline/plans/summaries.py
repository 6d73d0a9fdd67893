"""Summaries, work lists and samples over the machine-hour fact and the maintenance evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide
from ..scratch import once
from . import gold_sql as S
from . import readers as R
from .bindings import bound
from .catalog import ENERGY, QUERIES, READY, energy, fact, inputs, query
from .catalog import ORACLES
from .gold import backbone
from .rules import AS_OF, DAY, UNIFIED, day_of, one_row, unified


def _inner(name: str) -> str:
    """The SQL of a query as a table."""
    return f"({ORACLES[name]})"


def month_of(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


# ---- figures of a month, of the whole ----
@query("SELECT strftime(hour_ts, '%Y-%m') AS month_key, count(*) AS n_rows, count(DISTINCT machine) AS machines, count(*) FILTER (machine_state IS NULL) AS without_state, sum(energy_kwh) AS kwh, sum(good_qty) AS good, sum(scrap_qty) AS scrap, sum(energy_kwh) FILTER (good_qty > 0) AS used_kwh, sum(good_qty) FILTER (energy_kwh IS NOT NULL AND good_qty > 0) AS used_good, sum(energy_kwh) FILTER (good_qty > 0) / sum(good_qty) FILTER (energy_kwh IS NOT NULL AND good_qty > 0) AS kwh_per_good FROM fact GROUP BY 1", S.FACT, "kwh good scrap used_kwh used_good kwh_per_good")
def fact_month_metrics(spark, sf_dir):
    """Figures of the fact, a row for each month."""
    return month_metrics(fact(spark, sf_dir))


def month_metrics(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("month_key", month_of(F.col("hour_us")))
    ok = R.qualifying(rows)
    used = lambda c: F.sum(F.when(ok, F.col(c)))
    return rows.groupBy("month_key").agg(F.count("*").alias("n_rows"), F.countDistinct("machine").alias("machines"), F.count_if(F.col("machine_state").isNull()).alias("without_state"), *[F.sum(a).alias(b) for a, b in (("energy_kwh", "kwh"), ("good_qty", "good"), ("scrap_qty", "scrap"))], used("energy_kwh").alias("used_kwh"), used("good_qty").alias("used_good"), safe_divide(used("energy_kwh"), used("good_qty")).alias("kwh_per_good"))


@query(f"SELECT count(DISTINCT machine) AS machines, sum(all_kwh) AS kwh, sum(all_good) AS good, count(score) AS with_score, avg(utilization) AS utilization FROM {_inner('machine_opportunity')}", "", "kwh good utilization")
def opportunity_month_metrics(spark, sf_dir):
    return QUERIES["machine_opportunity"](spark, sf_dir).agg(F.countDistinct("machine").alias("machines"), F.sum("all_kwh").alias("kwh"), F.sum("all_good").alias("good"), F.count("score").alias("with_score"), F.avg("utilization").alias("utilization"))


@query("SELECT strftime(make_timestamp(hour_us), '%Y-%m') AS month_key, count(*) AS n_rows, count(DISTINCT machine) AS machines, count(*) FILTER (eligible = 1) AS eligible_rows, count(*) FILTER (eligible = 0) AS blocked_rows, count(DISTINCT machine) FILTER (eligible = 1) AS eligible_machines FROM ready GROUP BY 1", READY)
def readiness_month_metrics(spark, sf_dir):
    """Eligible and blocked rows, a row for each month."""
    return readiness_metrics(inputs(spark, sf_dir))


def readiness_metrics(rows: DataFrame) -> DataFrame:
    ok = F.col("eligible") == 1
    return rows.groupBy(month_of(F.col("hour_us")).alias("month_key")).agg(F.count("*").alias("n_rows"), F.countDistinct("machine").alias("machines"), F.count_if(ok).alias("eligible_rows"), F.count_if(~ok).alias("blocked_rows"), F.countDistinct(F.when(ok, F.col("machine"))).alias("eligible_machines"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (work_type = 'PM') AS preventive, count(DISTINCT machine) AS machines, count(DISTINCT CASE WHEN work_order IS NOT NULL THEN machine END) AS machines_with_order, count(DISTINCT work_order) AS orders, min(txn_us) AS first_us, max(txn_us) AS last_us FROM works", S.DUCK)
def maintenance_coverage(spark, sf_dir):
    return bound(spark, sf_dir)["works"].agg(F.count("*").alias("n_rows"), F.count_if(F.col("work_type") == "PM").alias("preventive"), F.countDistinct("machine").alias("machines"), F.countDistinct(F.when(F.col("work_order").isNotNull(), F.col("machine"))).alias("machines_with_order"), F.countDistinct("work_order").alias("orders"), F.min("txn_us").alias("first_us"), F.max("txn_us").alias("last_us"))


_UNKNOWN = "(machine_state IS NULL OR machine_state IN ('energy_only', 'unknown'))"


def _unknown() -> Column:
    return F.col("machine_state").isNull() | F.col("machine_state").isin("energy_only", "unknown")


@query(f"SELECT count(*) FILTER ({_UNKNOWN}) AS unknown_rows, count(*) FILTER ({_UNKNOWN}) / count(*) AS unknown_share, count(*) FILTER (good_qty > 0) AS good_rows, count(*) FILTER (good_qty > 0) / count(*) AS good_share, count(*) FILTER (maintenance_in_hour = 1) AS maintenance_rows, count(*) FILTER (maintenance_in_hour = 1) / count(*) AS maintenance_share FROM fact", S.FACT, "unknown_share good_share maintenance_share")
def quality_metrics(spark, sf_dir):
    tests = {"unknown": _unknown(), "good": F.coalesce(F.col("good_qty") > 0, F.lit(False)), "maintenance": F.col("maintenance_in_hour") == 1}
    return fact(spark, sf_dir).agg(*[x for n, t in tests.items() for x in (F.count_if(t).alias(f"{n}_rows"), (F.count_if(t) / F.count("*")).alias(f"{n}_share"))])


@query("SELECT category, n AS n_rows, n / greatest(total, 1) AS ratio FROM (UNPIVOT (SELECT count(*) FILTER (machine_state IS NULL OR trim(machine_state) = '') AS null_source, count(*) FILTER (machine_state = 'unknown') AS derived_unknown, count(*) FILTER (machine_state = 'energy_only') AS energy_only, count(*) AS total FROM fact) ON null_source, derived_unknown, energy_only INTO NAME category VALUE n)", S.FACT, "ratio")
def unknown_breakdown(spark, sf_dir):
    """Rows without a state, with one that is unknown, and with energy only; also those that are none."""
    state = F.lower(F.trim(F.coalesce("machine_state", F.lit(""))))
    kinds = {"null_source": state == "", "derived_unknown": state == "unknown", "energy_only": state == "energy_only"}
    counts = fact(spark, sf_dir).agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in kinds.items()])
    return counts.unpivot(["total"], list(kinds), "category", "n_rows").select("category", "n_rows", (F.col("n_rows") / F.greatest("total", F.lit(1))).alias("ratio"))


@query("SELECT strftime(hour_ts, '%Y-%m') AS month_key, count(*) AS n_rows, count(DISTINCT machine) AS machines FROM ready WHERE list_contains(string_split(notes, '; '), 'team_size_from_preprocessor_default') GROUP BY 1", READY)
def team_size_fallback(spark, sf_dir):
    """Rows and machines whose team size is the default, by month; the note is matched as a whole."""
    rows = inputs(spark, sf_dir).filter(F.array_contains(F.split("notes", "; "), "team_size_from_preprocessor_default"))
    return rows.groupBy("month_key").agg(F.count("*").alias("n_rows"), F.countDistinct("machine").alias("machines"))


@query("SELECT min(hour_us) AS first_us, max(hour_us) AS last_us, count(DISTINCT machine) AS machines, count(DISTINCT hour_us) AS hours, count(*) AS n_rows FROM fact", S.FACT)
def route_scope(spark, sf_dir):
    return fact(spark, sf_dir).agg(F.min("hour_us").alias("first_us"), F.max("hour_us").alias("last_us"), F.countDistinct("machine").alias("machines"), F.countDistinct("hour_us").alias("hours"), F.count("*").alias("n_rows"))


@query("SELECT system, count(DISTINCT machine) AS machines, count(*) AS n_rows FROM (SELECT 'energy' AS system, machine FROM meters UNION ALL SELECT 'jobs', machine FROM jobs UNION ALL SELECT 'reports', machine FROM reports UNION ALL SELECT 'maintenance', machine FROM works) GROUP BY system", S.DUCK)
def inventory_by_system(spark, sf_dir):
    b = bound(spark, sf_dir)
    out = None
    for system, name in (("energy", "meters"), ("jobs", "jobs"), ("reports", "reports"), ("maintenance", "works")):
        rows = b[name].groupBy().agg(F.countDistinct("machine").alias("machines"), F.count("*").alias("n_rows")).select(F.lit(system).alias("system"), "machines", "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out.filter("n_rows > 0")


# ---- maintenance ----
@query("SELECT month_key, n_rows, row_number() OVER (ORDER BY m) AS place FROM (SELECT strftime(make_timestamp(txn_us), '%B %Y') AS month_key, date_trunc('month', make_timestamp(txn_us)) AS m, count(*) AS n_rows FROM works GROUP BY ALL)", S.DUCK)
def monthly_record_counts(spark, sf_dir):
    """Works by month with its place in the calendar; labels that are no month come last."""
    rows = bound(spark, sf_dir)["works"].groupBy(F.date_format(F.timestamp_micros("txn_us"), "MMMM yyyy").alias("month_key")).agg(F.count("*").alias("n_rows"))
    return month_places(rows)


def month_places(rows: DataFrame) -> DataFrame:
    """The place of each month label in the calendar; a row for each month."""
    month = F.to_date(F.try_to_timestamp("month_key", F.lit("MMMM yyyy")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.asc_nulls_last(month), "month_key")))


_IMPACT = "CASE WHEN hours_since < 100 THEN '0-100 hours' WHEN hours_since < 500 THEN '100-500 hours' WHEN hours_since < 1000 THEN '500-1000 hours' ELSE '1000+ hours' END"


@query(f"SELECT {_IMPACT} AS bucket, avg(kpu) AS mean_kpu, count(*) AS n_rows FROM uv WHERE kpu > 0 AND kpu < 100 AND hours_since IS NOT NULL GROUP BY 1", UNIFIED, "mean_kpu")
def maintenance_impact(spark, sf_dir):
    return unified(spark, sf_dir).filter("kpu > 0 and kpu < 100 and hours_since is not null").groupBy(F.expr(_IMPACT).alias("bucket")).agg(F.avg("kpu").alias("mean_kpu"), F.count("*").alias("n_rows"))


@query("SELECT machine, max(hours_since) AS overdue, avg(kpu) AS mean_kpu FROM uv WHERE hours_since > 12 AND kpu > 0 AND kpu < 100 GROUP BY machine ORDER BY round(max(hours_since), 6) DESC, machine LIMIT 5", UNIFIED, "overdue mean_kpu")
def overdue_machines(spark, sf_dir):
    """The five machines longest without a work; the query counts from 12 hours on, as the bound works are dense."""
    return overdue(unified(spark, sf_dir), 12)


def overdue(rows: DataFrame, least_hours: float = 720, limit: int = 5) -> DataFrame:
    out = rows.filter((F.col("hours_since") > least_hours) & (F.col("kpu") > 0) & (F.col("kpu") < 100)).groupBy("machine").agg(F.max("hours_since").alias("overdue"), F.avg("kpu").alias("mean_kpu"))
    return out.orderBy(F.desc(F.round("overdue", 6)), "machine").limit(limit)


@query("SELECT leader, avg(kpu) AS mean_kpu, count(*) AS n_rows FROM uv WHERE kpu > 0.5 AND leader IS NOT NULL GROUP BY leader HAVING count(*) > 5 ORDER BY round(avg(kpu), 6) DESC, leader LIMIT 5", UNIFIED, "mean_kpu")
def weak_teams(spark, sf_dir):
    """The five leaders with the most energy per piece in hours over a bound (0.5 for the bound data)."""
    return weak_leaders(unified(spark, sf_dir), 0.5)


def weak_leaders(rows: DataFrame, least: float = 4.0, limit: int = 5) -> DataFrame:
    out = rows.filter((F.col("kpu") > least) & F.col("leader").isNotNull()).groupBy("leader").agg(F.avg("kpu").alias("mean_kpu"), F.count("*").alias("n_rows")).filter("n_rows > 5")
    return out.orderBy(F.desc(F.round("mean_kpu", 6)), "leader").limit(limit)


@query("SELECT machine, count(*) FILTER (maintenance_in_hour = 1) AS maintenance_rows, count(*) FILTER (maintenance_in_hour = 1) / count(*) AS ratio FROM fact GROUP BY machine ORDER BY maintenance_rows DESC, machine LIMIT 15", S.FACT, "ratio")
def maintenance_hot_spots(spark, sf_dir):
    n = F.count_if(F.col("maintenance_in_hour") == 1)
    return fact(spark, sf_dir).groupBy("machine").agg(n.alias("maintenance_rows"), (n / F.count("*")).alias("ratio")).orderBy(F.desc("maintenance_rows"), "machine").limit(15)


@query(f"SELECT machine, count(*) AS n_rows, avg(CASE WHEN work_type = 'PM' THEN 1.0 ELSE 0.0 END) AS pm_ratio, count(*) FILTER (r <= 10) AS recent, avg(CASE WHEN work_type = 'PM' THEN 1.0 ELSE 0.0 END) FILTER (r <= 10) AS recent_pm_ratio, max(work_type) FILTER (r = 1) AS last_type, {AS_OF} - max(txn_us) // {DAY} AS days_since, count(DISTINCT strftime(make_timestamp(txn_us), '%Y-%m')) AS months FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY txn_us DESC, hash DESC) AS r FROM works) GROUP BY machine", S.DUCK, "pm_ratio recent_pm_ratio")
def machine_evidence(spark, sf_dir):
    """Works of a machine in all and among the last ten."""
    return evidence(bound(spark, sf_dir)["works"], AS_OF)


def evidence(works: DataFrame, as_of: int, recent: int = 10) -> DataFrame:
    rows = works.withColumn("r", F.row_number().over(Window.partitionBy("machine").orderBy(F.desc("txn_us"), F.desc("hash"))))
    pm, late = (F.col("work_type") == "PM").cast("double"), F.col("r") <= recent
    return rows.groupBy("machine").agg(F.count("*").alias("n_rows"), F.avg(pm).alias("pm_ratio"), F.count_if(late).alias("recent"), F.avg(F.when(late, pm)).alias("recent_pm_ratio"), F.max(F.when(F.col("r") == 1, F.col("work_type"))).alias("last_type"), (F.lit(as_of) - F.max(day_of("txn_us"))).alias("days_since"), F.countDistinct(F.date_format(F.timestamp_micros("txn_us"), "yyyy-MM")).alias("months"))


@query("SELECT hash, machine, txn_us, work_type FROM works WHERE work_type = 'CM' ORDER BY txn_us DESC, hash LIMIT 100", S.DUCK)
def browse_records(spark, sf_dir):
    return browse(bound(spark, sf_dir)["works"], {"work_type": "CM"})


def browse(works: DataFrame, wanted: dict[str, str], limit: int = 100) -> DataFrame:
    """The latest works that agree with all given values; a value of None asks for nothing."""
    for column, value in wanted.items():
        works = works if value is None else works.filter(F.col(column) == value)
    return works.select("hash", "machine", "txn_us", "work_type").orderBy(F.desc("txn_us"), "hash").limit(limit)


# ---- work lists ----
#: Name of a view: what it sorts by, largest first if negative.
ATTENTION = {"load": ("-all_kwh", "-kwh_per_good"), "intensity": ("-kwh_per_good", "-all_kwh"), "efficient": ("kwh_per_good", "-good")}


def attention(machines: DataFrame, view: str, limit: int = 5) -> DataFrame:
    keys = [F.desc_nulls_last(F.round(c[1:], 6)) if c[0] == "-" else F.asc_nulls_last(F.round(c, 6)) for c in ATTENTION.get(view, ATTENTION["load"])]
    return machines.orderBy(*keys, "machine").limit(limit).select(F.lit(view).alias("view"), "machine", "all_kwh", "good", "kwh_per_good")


_MACHINES = "SELECT machine, sum(energy_kwh) AS all_kwh, sum(good_qty) FILTER (energy_kwh IS NOT NULL AND good_qty > 0) AS good, sum(energy_kwh) FILTER (good_qty > 0) / sum(good_qty) FILTER (energy_kwh IS NOT NULL AND good_qty > 0) AS kwh_per_good FROM energy GROUP BY machine HAVING count(*) FILTER (energy_kwh IS NOT NULL AND good_qty > 0) >= 1"


@query(" UNION ALL ".join(f"(SELECT '{v}' AS view, * FROM ({_MACHINES}) ORDER BY " + ", ".join(f"round({c.lstrip('-')}, 6) {'DESC' if c[0] == '-' else 'ASC'} NULLS LAST" for c in keys) + ", machine LIMIT 5)" for v, keys in ATTENTION.items()), ENERGY, "all_kwh good kwh_per_good")
def attention_views(spark, sf_dir):
    machines = once(R.machine_energy(energy(spark, sf_dir)), "machines")
    views = [attention(machines, v) for v in ATTENTION]
    return views[0].unionByName(views[1]).unionByName(views[2])


_ACTION = "CASE WHEN lower(driver) LIKE '%maintenance%' THEN 'Inspect ' || machine || ' and verify whether maintenance recency is driving the score.' WHEN lower(driver) LIKE '%non-productive%' THEN 'Review setup/stop mix for ' || machine || ' and reduce avoidable non-productive hours.' WHEN lower(driver) LIKE '%scrap%' THEN 'Audit scrap-heavy runs on ' || machine || ' before chasing energy changes.' ELSE 'Review high energy intensity on ' || machine || ' against its closest cohort.' END"


def worklist(machines: DataFrame, family: str | None = None, least_rows: int = 0, least_good: float = 0.0, limit: int = 10) -> DataFrame:
    """The machines with the highest score among those that pass the filters, and what to do about each."""
    rows = machines.filter((F.col("eligible_rows") >= least_rows) & (F.coalesce("all_good", F.lit(0.0)) >= least_good))
    rows = rows if family is None else rows.filter(F.col("family") == family)
    return rows.withColumn("action", F.expr(_ACTION)).orderBy(F.desc("score"), "machine").limit(limit).select("machine", "family", "flag", "score", "driver", "action", "eligible_rows", F.round("all_good", 1).alias("good"))


@query(f"SELECT machine, family, flag, score, driver, {_ACTION} AS action, eligible_rows, round(all_good, 1) AS good FROM {_inner('machine_opportunity')} WHERE eligible_rows >= 1 AND coalesce(all_good, 0) >= 1 ORDER BY score DESC, machine LIMIT 10", "", "score good")
def opportunity_worklist(spark, sf_dir):
    return worklist(QUERIES["machine_opportunity"](spark, sf_dir), least_rows=1, least_good=1.0)


def audit_sample(rows: DataFrame, mode: str, size: int = 20) -> DataFrame:
    """First rows, rows of unknown state, of maintenance or with the most energy per piece; ``random`` takes the least hashes."""
    order = ["hour_us", "machine"]
    if mode == "random":
        return rows.orderBy(F.xxhash64("machine", "hour_us", F.lit(42)), *order).limit(size)
    if mode == "anomalous":
        some = rows.filter("kpu > 0")
        edge = some.agg(F.percentile("kpu", F.lit(0.95)).alias("edge"))
        return one_row(some, edge).filter("kpu >= edge").drop("edge").orderBy(F.desc(F.round("kpu", 6)), F.desc(F.round("energy_kwh", 6)), *order).limit(size)
    tests = {"unknown": _unknown(), "maintenance": F.col("maintenance_in_hour") == 1}
    return (rows.filter(tests[mode]) if mode in tests else rows).orderBy(*order).limit(size)


@query(f"(SELECT 'first' AS mode, machine, hour_us FROM uv ORDER BY hour_us, machine LIMIT 20) UNION ALL (SELECT 'unknown', machine, hour_us FROM uv WHERE {_UNKNOWN} ORDER BY hour_us, machine LIMIT 20) UNION ALL (SELECT 'maintenance', machine, hour_us FROM uv WHERE maintenance_in_hour = 1 ORDER BY hour_us, machine LIMIT 20) UNION ALL (SELECT 'anomalous', machine, hour_us FROM uv WHERE kpu > 0 AND kpu >= (SELECT quantile_cont(kpu, 0.95) FROM uv WHERE kpu > 0) ORDER BY round(kpu, 6) DESC, round(energy_kwh, 6) DESC, hour_us, machine LIMIT 20)", UNIFIED)
def audit_samples(spark, sf_dir):
    rows = once(unified(spark, sf_dir), "unified")
    parts = [audit_sample(rows, m).select(F.lit(m).alias("mode"), "machine", "hour_us") for m in ("first", "unknown", "maintenance", "anomalous")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_KINDS = "SELECT family, material, task, count(*) AS seen FROM ready WHERE eligible = 1 GROUP BY ALL"


@query(f"SELECT family, material, task, seen FROM (SELECT *, cast('0x' || substr(md5('42/' || family || '/' || material || '/' || coalesce(task, '')), 1, 12) AS bigint) AS h FROM ({_KINDS})) ORDER BY round(-ln((h + 1) / 281474976710656.0) / seen, 9), family, material, task LIMIT 12", READY)
def weighted_queue_sample(spark, sf_dir):
    """Twelve kinds of job without replacement, the more likely the more often they were seen; a seed and a hash in place of chance."""
    kinds = inputs(spark, sf_dir).filter("eligible = 1").groupBy("family", "material", "task").agg(F.count("*").alias("seen"))
    return weighted_sample(kinds, "seen", ["family", "material", "task"], 12)


def weighted_sample(rows: DataFrame, weight: str, keys: list[str], size: int, seed: int = 42) -> DataFrame:
    name = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    h = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("bigint")
    return rows.orderBy(F.round(-F.log((h + 1) / F.lit(281474976710656.0)) / F.col(weight), 9), *keys).limit(size)


# ---- hourly view ----
_BASE = "CASE coalesce(task, 'UNKNOWN') WHEN 'Print+Finishing' THEN 1.2 WHEN 'Printing' THEN 1.0 WHEN 'Finishing' THEN 0.8 WHEN 'UNKNOWN' THEN 1.1 ELSE 1.0 END * CASE WHEN h < 6 THEN 1.15 WHEN h < 12 THEN 0.95 WHEN h < 18 THEN 1.0 ELSE 1.05 END * CASE WHEN coalesce(team_size, 2) = 1 THEN 1.2 WHEN coalesce(team_size, 2) >= 4 THEN 0.9 ELSE 1.0 END"


@query(f"SELECT machine, hour_us, {_BASE} AS baseline FROM (SELECT *, hour(hour_ts) AS h FROM fact)", S.FACT, "baseline")
def context_baseline(spark, sf_dir):
    """Expected energy per piece by kind of task, part of the day and team size; a size that is not known counts as two."""
    rows = fact(spark, sf_dir).withColumn("h", F.hour(F.timestamp_micros("hour_us")))
    return rows.select("machine", "hour_us", baseline({"Print+Finishing": 1.2, "Printing": 1.0, "Finishing": 0.8, "UNKNOWN": 1.1}).alias("baseline"))


def baseline(by_task: dict[str, float]) -> Column:
    task, size = F.coalesce("task", F.lit("UNKNOWN")), F.coalesce("team_size", F.lit(2.0))
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in by_task.items() for x in kv]), task), F.lit(1.0))
    part = F.when(F.col("h") < 6, 1.15).when(F.col("h") < 12, 0.95).when(F.col("h") < 18, 1.0).otherwise(1.05)
    return factor * part * F.when(size == 1, 1.2).when(size >= 4, 0.9).otherwise(1.0)


_BASIS = "CASE WHEN job_hash IS NULL THEN 'missing_source_row_hash' WHEN row_basis > 0 THEN 'preserved_existing_landed_positive_basis' WHEN budget_anomaly IS NOT NULL THEN 'excluded_minute_budget_anomaly' WHEN lead_production > 0 THEN 'reconstructed_from_source_flags_matching_dominant_hash' WHEN several_jobs = 1 THEN 'missing_positive_dominant_basis_evidence' WHEN production_minutes > 0 THEN 'single_event_row_production_minutes' ELSE 'missing_positive_dominant_basis_evidence' END"


@query(f"SELECT {_BASIS} AS status, count(*) AS n_rows FROM fact GROUP BY 1", S.FACT)
def quantity_audit_basis(spark, sf_dir):
    """How the minutes that a row's quantity rests on can be told; the fact's dominant job is always the row's own."""
    return fact(spark, sf_dir).groupBy(audit_status().alias("status")).agg(F.count("*").alias("n_rows"))


def audit_status(flagged_hash: Column | None = None) -> Column:
    """Status of a row; ``flagged_hash`` is the dominant job that source flags name, where rows carry one."""
    flagged = F.col("job_hash") if flagged_hash is None else flagged_hash
    lead, several = F.coalesce(F.col("lead_production") > 0, F.lit(False)), F.coalesce(F.col("several_jobs") == 1, F.lit(False))
    return (
        F.when(F.col("job_hash").isNull(), "missing_source_row_hash")
        .when(F.col("row_basis") > 0, "preserved_existing_landed_positive_basis")
        .when(F.col("budget_anomaly").isNotNull(), "excluded_minute_budget_anomaly")
        .when(lead & flagged.isNotNull() & (flagged != F.col("job_hash")) & several, "blocked_dominant_identity_conflict")
        .when(lead & flagged.isNull(), "reconstructed_from_source_flags_missing_dominant_hash_flag")
        .when(lead, "reconstructed_from_source_flags_matching_dominant_hash")
        .when(several, "missing_positive_dominant_basis_evidence")
        .when(F.col("production_minutes") > 0, "single_event_row_production_minutes")
        .otherwise("missing_positive_dominant_basis_evidence")
    )


@query("SELECT order_id, hash, machine, report_us FROM reports QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY report_us, hash) = 1", S.DUCK)
def first_report_of_order(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("order_id").orderBy("report_us", "hash"))
    return bound(spark, sf_dir)["reports"].withColumn("r", first).filter("r = 1").select("order_id", "hash", "machine", "report_us")


_FILLED = ["energy_kwh", "good_qty", "hours_since", "lag_kwh", "mean_4"]


@query("SELECT machine, hour_us, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _FILLED) + ", " + ", ".join(f"CASE WHEN machine_state = '{s}' THEN 1 ELSE 0 END AS is_{s}" for s in ("idle", "maintenance", "production")) + " FROM (SELECT *, lag(energy_kwh) OVER m AS lag_kwh, avg(energy_kwh) OVER (m ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean_4 FROM fact WINDOW m AS (PARTITION BY machine ORDER BY hour_us))", S.FACT, " ".join(_FILLED))
def feature_matrix(spark, sf_dir):
    """Numbers of an hour, the hour before and the last four, 0 where one is not known, and its state as columns of 0 and 1."""
    w = Window.partitionBy("machine").orderBy("hour_us")
    rows = fact(spark, sf_dir).withColumns({"lag_kwh": F.lag("energy_kwh").over(w), "mean_4": F.avg("energy_kwh").over(w.rowsBetween(-3, 0))})
    return one_hot(rows.fillna(0.0, _FILLED), "machine_state", ("idle", "maintenance", "production")).select("machine", "hour_us", *_FILLED, "is_idle", "is_maintenance", "is_production")


def one_hot(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({f"is_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


@query("SELECT machine, baseline - used AS saved_kwh, CASE WHEN baseline > 0 THEN (baseline - used) / baseline * 100 END AS saved_percent, (baseline - used) * 0.15 AS saved_cost FROM (SELECT machine, sum(energy_kwh) AS used, sum(good_qty) * (SELECT sum(energy_kwh) / sum(good_qty) FROM uv WHERE kpu IS NOT NULL) AS baseline FROM uv WHERE kpu IS NOT NULL GROUP BY machine)", UNIFIED, "saved_kwh saved_percent saved_cost")
def energy_savings(spark, sf_dir):
    """What a machine uses less (or more) than its pieces would take at the plant's mean energy per piece."""
    rows = once(unified(spark, sf_dir).filter("kpu is not null"), "unified")
    mean = rows.agg((F.sum("energy_kwh") / F.sum("good_qty")).alias("mean"))
    out = one_row(rows.groupBy("machine").agg(F.sum("energy_kwh").alias("used"), F.sum("good_qty").alias("good")), mean).withColumn("b", F.col("good") * F.col("mean"))
    saved = F.col("b") - F.col("used")
    return out.select("machine", saved.alias("saved_kwh"), F.when(F.col("b") > 0, saved / F.col("b") * 100).alias("saved_percent"), (saved * 0.15).alias("saved_cost"))


@query("SELECT leader, task, count(*) AS n_rows, median(team_size) AS team_size FROM fact WHERE leader IS NOT NULL AND task IS NOT NULL GROUP BY ALL", S.FACT, "team_size")
def composition_by_task(spark, sf_dir):
    return fact(spark, sf_dir).filter("leader is not null and task is not null").groupBy("leader", "task").agg(F.count("*").alias("n_rows"), F.median("team_size").alias("team_size"))


@query("SELECT notes_kind, count(*) AS n_rows FROM (SELECT CASE WHEN notes LIKE '%preprocessor_default%' THEN 'Defaulted row' WHEN trim(notes) <> '' THEN 'Adapted row' ELSE 'Direct canonical row' END AS notes_kind FROM ready) GROUP BY 1", READY)
def support_paths(spark, sf_dir):
    kind = F.when(F.col("notes").contains("preprocessor_default"), "Defaulted row").when(F.trim("notes") != "", "Adapted row").otherwise("Direct canonical row")
    return inputs(spark, sf_dir).groupBy(kind.alias("notes_kind")).agg(F.count("*").alias("n_rows"))


@query("SELECT 'no_job' AS flag, count(*) AS n_rows FROM fact WHERE job_hash IS NULL UNION ALL SELECT qty_warning, count(*) FROM fact WHERE qty_warning IS NOT NULL AND job_hash IS NOT NULL GROUP BY 1 UNION ALL SELECT budget_anomaly, count(*) FROM fact WHERE budget_anomaly IS NOT NULL GROUP BY 1", S.FACT)
def quality_flags(spark, sf_dir):
    """Rows without a job, also if there are none, and rows by each quality flag that they carry."""
    flags = F.array_compact(F.array(F.when(F.col("job_hash").isNull(), "no_job"), F.when(F.col("job_hash").isNotNull(), F.col("qty_warning")), F.col("budget_anomaly")))
    carried = fact(spark, sf_dir).select(F.explode(flags).alias("flag"), F.lit(1).alias("n"))
    return carried.union(spark.range(1).select(F.lit("no_job"), F.lit(0))).groupBy("flag").agg(F.sum("n").alias("n_rows"))


# ---- months of orders, one at a time ----
_OM = "om AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_quantity, strftime(l_shipdate, '%Y-%m') AS month_key FROM lineitem)"


@query("SELECT month_key, count(DISTINCT l_orderkey) AS orders, count(*) AS n_rows, sum(share) AS share FROM (SELECT *, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS share FROM om) WHERE month_key = '1997-03' GROUP BY 1", _OM, "share")
def month_with_support(spark, sf_dir):
    """One month's rows and their share of whole orders, also of rows in other months; only orders of the month are read from these."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return month_shares(rows, "1997-03").groupBy("month_key").agg(F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("n_rows"), F.sum("share").alias("share"))


def month_shares(rows: DataFrame, month: str) -> DataFrame:
    """Rows of a month with their share of the order; totals are of the month's orders over all months."""
    first = F.lit(f"{month}-01").cast("timestamp_ntz")
    inside = (F.col("l_shipdate") >= first) & (F.col("l_shipdate") < F.add_months(F.lit(f"{month}-01").cast("date"), 1).cast("timestamp_ntz"))
    target = rows.filter(inside)
    supporting = rows.join(target.select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    totals = supporting.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    return target.join(totals, "l_orderkey").select("l_orderkey", "l_linenumber", F.lit(month).alias("month_key"), (F.col("l_quantity") / F.col("total")).alias("share"))


@query("SELECT o_custkey, string_agg(DISTINCT m, ', ' ORDER BY m) AS months FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS m FROM orders) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE strftime(o_orderdate, '%Y') >= '1998') GROUP BY o_custkey")
def absent_with_months_seen(spark, sf_dir):
    """Who is not seen any more in the last period, with all months of before."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    now = rows.filter("m >= '1998'").select("o_custkey").distinct()
    return rows.join(now, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("m")), ", ").alias("months"))


@query("SELECT m AS month_key, n, lag(m) OVER (ORDER BY m) AS previous FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1)")
def month_history(spark, sf_dir):
    """Months with the one before that has rows; a row for each month."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month_key")).agg(F.count("*").alias("n"))
    return rows.withColumn("previous", F.lag("month_key").over(Window.partitionBy().orderBy("month_key")))


@query("SELECT machine, sum(kwh) AS kwh, sum(good) AS good, sum(scrap) AS scrap, CASE WHEN sum(good) + sum(scrap) > 0 THEN sum(scrap) / (sum(good) + sum(scrap)) * 100 END AS defect_percent, CASE WHEN sum(good) > 0 THEN sum(kwh) / sum(good) END AS kwh_per_good FROM (SELECT machine, energy_kwh AS kwh, NULL::double AS good, NULL::double AS scrap FROM backbone UNION ALL SELECT machine, NULL, job_good, job_scrap FROM jobs) GROUP BY machine", S.BACKBONE, "kwh good scrap defect_percent kwh_per_good")
def integrated_metrics(spark, sf_dir):
    """Energy and pieces of each machine from sums of either side, so that neither is counted twice."""
    b = bound(spark, sf_dir)
    used = backbone(b["meters"]).groupBy("machine").agg(F.sum("energy_kwh").alias("kwh"))
    made = b["jobs"].groupBy("machine").agg(F.sum("job_good").alias("good"), F.sum("job_scrap").alias("scrap"))
    return used.join(made, "machine", "full_outer").select("machine", "kwh", "good", "scrap", (safe_divide(F.col("scrap"), F.col("good") + F.col("scrap")) * 100).alias("defect_percent"), safe_divide(F.col("kwh"), F.col("good")).alias("kwh_per_good"))
