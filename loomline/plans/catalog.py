"""Every query of the engine by name, with DuckDB SQL that gives the same rows.

Doubles are rounded to six places on both sides, as sums depend on the order of their terms; the
small addend keeps exact halves from falling either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import gold_sql as S
from . import readers as R
from .bindings import bound
from .gold import backbone, dominant_job, job_blend, job_coverage, job_overlaps, machine_hours, quantity_shadow, with_jobs, with_maintenance, with_quantity, with_reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select([(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) if isinstance(df.schema[c].dataType, DoubleType) else c for c in df.columns])


def query(sql: str | None, ctes: str = "", doubles: str = "") -> Callable:
    """Register a query; ``doubles`` names the columns that the SQL rounds."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[name].__name__ = name
        if sql:
            head = f"WITH {ctes},\n" if ctes else "WITH "
            change = ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in doubles.split())
            ORACLES[name] = f"{head}result AS ({sql})\nSELECT * {f'REPLACE ({change})' if change else ''} FROM result"
        return f

    return add


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bound(spark, sf_dir)
    return machine_hours(b["meters"], b["jobs"], b["reports"], b["works"])


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.energy_rows(fact(spark, sf_dir))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.readiness(fact(spark, sf_dir))


_B6 = ["setup_changeover_kwh", "production_kwh", "planned_stop_kwh", "unplanned_stop_kwh", "maintenance_kwh", "idle_kwh"]
_MIN = {"setup_changeover_kwh": "setup_minutes", "production_kwh": "production_minutes", "planned_stop_kwh": "planned_stop_minutes", "unplanned_stop_kwh": "unplanned_stop_minutes", "maintenance_kwh": "0", "idle_kwh": "idle_minutes"}
_STATES = "('setup_changeover', 'production', 'planned_stop', 'unplanned_stop', 'maintenance', 'idle')"
ENERGY = S.FACT + f""",
en0 AS (SELECT *, coalesce(setup_minutes,0)+coalesce(production_minutes,0)+coalesce(planned_stop_minutes,0)+coalesce(unplanned_stop_minutes,0)+coalesce(idle_minutes,0) AS tracked_minutes FROM fact),
en1 AS (SELECT *, CASE WHEN coalesce(energy_kwh,0) <= 0 THEN 'no_energy' WHEN tracked_minutes > 0 THEN 'minute_share' WHEN machine_state IN {_STATES} THEN 'machine_state_fallback' ELSE 'unallocated' END AS attribution FROM en0),
en2 AS (SELECT *, {", ".join(f"CASE WHEN attribution = 'minute_share' THEN energy_kwh * coalesce({m}, 0) / tracked_minutes WHEN attribution = 'machine_state_fallback' AND machine_state = '{b[:-4]}' THEN energy_kwh ELSE 0 END AS {b}" for b, m in _MIN.items())} FROM en1),
energy AS MATERIALIZED (SELECT *, CASE WHEN attribution = 'unallocated' THEN energy_kwh WHEN attribution = 'minute_share' AND energy_kwh - ({" + ".join(_B6)}) > 1e-9 THEN energy_kwh - ({" + ".join(_B6)}) ELSE 0 END AS unallocated_kwh,
  CASE WHEN good_qty > 0 THEN energy_kwh / good_qty END AS kwh_per_good, coalesce(energy_kwh IS NOT NULL AND good_qty > 0, false) AS q, strftime(hour_ts, '%Y-%m') AS month_key, cast(hour_ts AS date) AS day, cast(hour(hour_ts) AS integer) AS hour, split_part(machine, '-', 1) AS family FROM en2)"""


# ---- energy backbone and attribution ----
@query("SELECT machine, hour_us, energy_kwh, energy_cost, main_kwh, uv_kwh, energy_method, source_rows, array_to_string(source_hashes, ',') AS hashes FROM backbone", S.BACKBONE, "energy_kwh energy_cost main_kwh uv_kwh")
def energy_backbone(spark, sf_dir):
    return backbone(bound(spark, sf_dir)["meters"]).select("machine", "hour_us", "energy_kwh", "energy_cost", "main_kwh", "uv_kwh", "energy_method", "source_rows", F.array_join("source_hashes", ",").alias("hashes"))


@query("SELECT component, count(*) AS n_rows, sum(kwh) AS kwh, sum(cost) AS cost, count(DISTINCT machine) AS machines FROM meters GROUP BY component", S.DUCK, "kwh cost")
def energy_component_totals(spark, sf_dir):
    return bound(spark, sf_dir)["meters"].groupBy("component").agg(F.count("*").alias("n_rows"), F.sum("kwh").alias("kwh"), F.sum("cost").alias("cost"), F.countDistinct("machine").alias("machines"))


@query(f"SELECT machine, hour_us, energy_kwh, attribution, {', '.join(_B6)}, unallocated_kwh, kwh_per_good FROM energy", ENERGY, " ".join([*_B6, "energy_kwh unallocated_kwh kwh_per_good"]))
def energy_attribution(spark, sf_dir):
    return energy(spark, sf_dir).select("machine", "hour_us", "energy_kwh", "attribution", *_B6, "unallocated_kwh", "kwh_per_good")


_RATIO = "sum(energy_kwh) FILTER (q) / nullif(sum(good_qty) FILTER (q), 0)"


@query(f"SELECT month_key, count(*) AS n_rows, count(DISTINCT machine) AS machines, sum(energy_kwh) AS kwh, sum(good_qty) AS good, count(*) FILTER (q) AS qualifying_rows, {_RATIO} AS kwh_per_good FROM energy GROUP BY month_key", ENERGY, "kwh good kwh_per_good")
def energy_month_summary(spark, sf_dir):
    return R.month_summary(energy(spark, sf_dir))


@query("SELECT bucket, kwh FROM (UNPIVOT (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in [*_B6, "unallocated_kwh"]) + " FROM energy) ON COLUMNS(*) INTO NAME bucket VALUE kwh) WHERE kwh > 0", ENERGY, "kwh")
def energy_breakdown_unpivot(spark, sf_dir):
    return R.breakdown(energy(spark, sf_dir))


_DAILY = "SELECT day, sum(energy_kwh) AS kwh, " + ", ".join(f"sum({c}) AS {c}" for c in [*_B6, "unallocated_kwh"]) + " FROM energy GROUP BY day"


@query(_DAILY, ENERGY, " ".join(["kwh unallocated_kwh", *_B6]))
def daily_state_energy(spark, sf_dir):
    return R.daily_states(energy(spark, sf_dir))


@query(f"SELECT day, kwh, low, high, CASE WHEN kwh > high THEN 'High' ELSE 'Low' END AS anomaly FROM (SELECT *, q1 - 1.5*(q3-q1) AS low, q3 + 1.5*(q3-q1) AS high FROM ({_DAILY}), (SELECT quantile_cont(kwh, 0.25) AS q1, quantile_cont(kwh, 0.75) AS q3, count(*) AS n FROM ({_DAILY}))) WHERE n >= 4 AND (kwh > high OR kwh < low)", ENERGY, "kwh low high")
def daily_energy_anomalies(spark, sf_dir):
    return R.daily_anomalies(R.daily_states(energy(spark, sf_dir)))


@query("SELECT hour, avg(energy_kwh) AS mean_kwh, sum(energy_kwh) AS kwh, count(*) AS n_rows FROM energy WHERE energy_kwh IS NOT NULL GROUP BY hour", ENERGY, "mean_kwh kwh")
def hourly_energy_profile(spark, sf_dir):
    return R.hourly_profile(energy(spark, sf_dir))


@query("SELECT attribution, count(*) AS n_rows, sum(coalesce(energy_kwh,0)) AS kwh, count(*) / sum(count(*)) OVER () AS row_share, sum(coalesce(energy_kwh,0)) / sum(sum(coalesce(energy_kwh,0))) OVER () AS kwh_share FROM energy GROUP BY attribution", ENERGY, "kwh row_share kwh_share")
def attribution_trust(spark, sf_dir):
    return R.attribution_trust(energy(spark, sf_dir))


@query("SELECT month_key, sum(coalesce(energy_kwh,0)) AS kwh, sum(CASE WHEN attribution IN ('minute_share','machine_state_fallback') THEN energy_kwh - unallocated_kwh ELSE 0 END) AS allocated_kwh, sum(unallocated_kwh) AS unallocated_kwh, count(*) FILTER (attribution = 'minute_share') AS by_minutes, count(*) FILTER (attribution = 'machine_state_fallback') AS by_state, allocated_kwh / sum(coalesce(energy_kwh,0)) AS share FROM energy GROUP BY month_key", ENERGY, "kwh allocated_kwh unallocated_kwh share")
def attribution_coverage(spark, sf_dir):
    return R.attribution_coverage(energy(spark, sf_dir))


_MACHINE_ENERGY = f"SELECT machine, count(*) FILTER (q) AS n_rows, sum(energy_kwh) FILTER (q) AS kwh, sum(good_qty) FILTER (q) AS good, {_RATIO} AS kwh_per_good, sum(energy_kwh) AS all_kwh FROM energy GROUP BY machine HAVING count(*) FILTER (q) >= 1 AND sum(good_qty) FILTER (q) > 0"


@query(_MACHINE_ENERGY + " ORDER BY kwh_per_good, good DESC, machine LIMIT 20", ENERGY, "kwh good kwh_per_good all_kwh")
def machine_efficiency_ranking(spark, sf_dir):
    return R.efficiency_ranking(energy(spark, sf_dir))


@query("SELECT bucket, count(*) AS n_rows, avg(hours_since) AS mean_hours, sum(energy_kwh)/sum(good_qty) AS kwh_per_good FROM (SELECT *, cast(CASE WHEN hours_since > 0 AND hours_since <= 200 THEN 0 WHEN hours_since > 200 AND hours_since <= 500 THEN 1 WHEN hours_since > 500 AND hours_since <= 800 THEN 2 WHEN hours_since > 800 AND hours_since <= 1200 THEN 3 WHEN hours_since > 1200 AND hours_since <= 2000 THEN 4 WHEN hours_since > 2000 AND hours_since <= 4000 THEN 5 END AS integer) AS bucket FROM energy WHERE kwh_per_good > 0 AND kwh_per_good < 20) WHERE bucket IS NOT NULL GROUP BY bucket HAVING count(*) >= 20", ENERGY, "mean_hours kwh_per_good")
def maintenance_age_curve(spark, sf_dir):
    return R.maintenance_age_curve(energy(spark, sf_dir))


# ---- jobs in time ----
def _overlaps(spark, sf_dir):
    b = bound(spark, sf_dir)
    return job_overlaps(backbone(b["meters"]), b["jobs"])


@query("SELECT machine, hour_us, hash, setup_overlap, production_overlap, total_overlap, fractional, production, planned, unplanned FROM om", S.JOBS, "setup_overlap production_overlap total_overlap production planned unplanned")
def job_overlap_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("machine", "hour_us", "hash", "setup_overlap", "production_overlap", "total_overlap", "fractional", "production", "planned", "unplanned")


@query("SELECT machine, hour_us, hash, order_id, total_overlap FROM dom", S.JOBS, "total_overlap")
def job_dominant_event(spark, sf_dir):
    return dominant_job(_overlaps(spark, sf_dir)).select("machine", "hour_us", "hash", "order_id", "total_overlap")


@query("SELECT machine, hour_us, coverage FROM cov", S.JOBS, "coverage")
def job_coverage_minutes(spark, sf_dir):
    return job_coverage(_overlaps(spark, sf_dir)).select("machine", "hour_us", "coverage")


@query("SELECT machine, hour_us, n_jobs, all_fractional, coverage, raw_minutes, scale, contract, setup_minutes, production_minutes, planned_stop_minutes, unplanned_stop_minutes FROM blend", S.JOBS, "coverage raw_minutes scale setup_minutes production_minutes planned_stop_minutes unplanned_stop_minutes")
def job_row_blend(spark, sf_dir):
    return job_blend(_overlaps(spark, sf_dir))


@query("SELECT machine, hour_us, machine_state, state_confidence, several_jobs, job_hash FROM fj", S.JOBS)
def job_state(spark, sf_dir):
    b = bound(spark, sf_dir)
    return with_jobs(backbone(b["meters"]), b["jobs"]).select("machine", "hour_us", "machine_state", "state_confidence", "several_jobs", "job_hash")


def _quantity(spark, sf_dir):
    b = bound(spark, sf_dir)
    return with_quantity(with_jobs(backbone(b["meters"]), b["jobs"]))


@query("SELECT machine, hour_us, job_hash, row_basis, good_qty, scrap_qty, basis_share, qty_warning, qty_confidence FROM fq", S.QUANTITY, "row_basis good_qty scrap_qty basis_share")
def quantity_allocation(spark, sf_dir):
    return _quantity(spark, sf_dir).select("machine", "hour_us", "job_hash", "row_basis", "good_qty", "scrap_qty", "basis_share", "qty_warning", "qty_confidence")


@query("SELECT alignment, budget_anomaly, count(*) AS n_rows, sum(abs(basis_gap)) AS gap_minutes FROM fq GROUP BY ALL", S.QUANTITY, "gap_minutes")
def quantity_audit(spark, sf_dir):
    return _quantity(spark, sf_dir).groupBy("alignment", "budget_anomaly").agg(F.count("*").alias("n_rows"), F.sum(F.abs("basis_gap")).alias("gap_minutes"))


_SHADOW = """WITH r AS (SELECT *, good_qty IS NOT NULL OR scrap_qty IS NOT NULL AS has FROM fq WHERE job_hash IS NOT NULL),
w AS (SELECT *, min(CASE WHEN NOT has THEN NULL WHEN budget_anomaly IS NOT NULL THEN 1 WHEN coalesce(row_basis,0) <= 0 THEN 2 WHEN coalesce(production_minutes,0) <= 0 THEN 3 END) OVER g AS worst, bool_or(has) OVER g AS any_has,
 sum(coalesce(production_minutes,0)) FILTER (has) OVER g AS basis, sum(coalesce(good_qty,0)) FILTER (has) OVER g AS tg, sum(coalesce(scrap_qty,0)) FILTER (has) OVER g AS ts FROM r WINDOW g AS (PARTITION BY job_hash)),
z AS (SELECT *, CASE WHEN NOT any_has THEN 'group_has_no_quantity_rows' WHEN worst = 1 THEN 'minute_budget_anomaly' WHEN worst = 2 THEN 'missing_positive_quantity_basis_minutes' WHEN worst = 3 THEN 'missing_positive_production_minutes' WHEN coalesce(basis,0) <= 0 THEN 'non_positive_shadow_basis_total' END AS shadow_reason FROM w)
SELECT machine, hour_us, job_hash, shadow_reason, CASE WHEN shadow_reason IS NULL AND has THEN 1 ELSE 0 END AS shadow_eligible,
 CASE WHEN shadow_reason IS NULL AND has THEN tg * coalesce(production_minutes,0) / basis ELSE good_qty END AS shadow_good, CASE WHEN shadow_reason IS NULL AND has THEN ts * coalesce(production_minutes,0) / basis ELSE scrap_qty END AS shadow_scrap FROM z"""


@query(_SHADOW, S.QUANTITY, "shadow_good shadow_scrap")
def quantity_shadow_rows(spark, sf_dir):
    return quantity_shadow(_quantity(spark, sf_dir)).select("machine", "hour_us", "job_hash", "shadow_reason", "shadow_eligible", "shadow_good", "shadow_scrap")


@query("SELECT machine, hour_us, report_hash, report_us, manpower FROM rep", S.REPORTS, "manpower")
def report_best_match(spark, sf_dir):
    return with_reports(_quantity(spark, sf_dir), bound(spark, sf_dir)["reports"]).filter("report_hash is not null").select("machine", "hour_us", "report_hash", "report_us", "manpower")


def _maintenance(spark, sf_dir):
    b = bound(spark, sf_dir)
    return with_maintenance(backbone(b["meters"]), b["works"])


@query("SELECT machine, hour_us, last_us, last_hash, last_work_type FROM lastw", S.MAINTENANCE)
def maintenance_asof(spark, sf_dir):
    return _maintenance(spark, sf_dir).filter("last_us is not null").select("machine", "hour_us", "last_us", "last_hash", "last_work_type")


@query("SELECT machine, hour_us, works_7d, works_30d, works_ever, works_in_hour, array_to_string(work_types, ',') AS work_types FROM trail", S.MAINTENANCE)
def maintenance_trailing_counts(spark, sf_dir):
    return _maintenance(spark, sf_dir).select("machine", "hour_us", "works_7d", "works_30d", "works_ever", "works_in_hour", F.array_join("work_types", ",").alias("work_types"))


# ---- idle, state and overview ----
@query("SELECT machine, hour_us, idle_minutes, idle_skipped, machine_state FROM fact", S.FACT, "idle_minutes")
def idle_residual(spark, sf_dir):
    return fact(spark, sf_dir).select("machine", "hour_us", "idle_minutes", "idle_skipped", "machine_state")


@query("SELECT machine, hour_us, promotion_blocked, machine_state, state_confidence FROM fact", S.FACT)
def state_review(spark, sf_dir):
    return fact(spark, sf_dir).select("machine", "hour_us", "promotion_blocked", "machine_state", "state_confidence")


@query("SELECT coalesce(machine_state, 'unknown') AS state, count(*) AS n_rows, sum(coalesce(energy_kwh,0)) AS kwh, count(*) / sum(count(*)) OVER () AS row_share FROM fact GROUP BY ALL", S.FACT, "kwh row_share")
def state_summary(spark, sf_dir):
    return R.state_summary(fact(spark, sf_dir))


@query("SELECT count(*) AS n_rows, count(job_hash) AS with_job, count(machine_state) AS with_state, count(good_qty) AS with_quantity, count(report_hash) AS with_report, count(last_us) AS with_last_maintenance, count(*) FILTER (maintenance_in_hour = 1) AS with_maintenance_in_hour, count(*) FILTER (several_jobs = 1) AS several_jobs, count(*) FILTER (idle_minutes > 0) AS with_idle, count(budget_anomaly) AS budget_anomalies, count(*) FILTER (alignment = 'material_misaligned') AS misaligned, count(*) FILTER (promotion_blocked IS NULL) AS promoted FROM fact", S.FACT)
def coverage_snapshot(spark, sf_dir):
    return R.coverage_snapshot(fact(spark, sf_dir))


# ---- scores ----
SCORES = S.FACT + """,
sr0 AS (SELECT *, coalesce(energy_kwh IS NOT NULL AND good_qty > 0, false) AS ok, coalesce(setup_minutes,0)+coalesce(planned_stop_minutes,0)+coalesce(unplanned_stop_minutes,0)+coalesce(idle_minutes,0) AS lost_minutes, hour(hour_ts) AS hour, split_part(machine, '-', 1) AS family FROM fact),
sr AS MATERIALIZED (SELECT * REPLACE (cast(ok AS integer) AS ok, cast(hour AS integer) AS hour), CASE WHEN ok THEN energy_kwh ELSE 0 END AS safe_kwh, CASE WHEN ok THEN good_qty ELSE 0 END AS safe_good, lost_minutes + coalesce(production_minutes,0) AS tracked, CASE WHEN hour BETWEEN 7 AND 14 THEN 'Day' WHEN hour BETWEEN 15 AND 22 THEN 'Evening' ELSE 'Night' END AS shift FROM sr0)"""


def _agg(keys: str, more: str, where: str = "true", having: str = "true") -> str:
    inner = f"SELECT {keys}, cast(sum(ok) AS bigint) AS eligible_rows, sum(safe_kwh) AS kwh, sum(safe_good) AS good, coalesce(sum(scrap_qty),0) AS scrap, sum(tracked) AS tracked, coalesce(sum(production_minutes),0) AS production, sum(lost_minutes) AS lost, avg(hours_since) AS mean_hours_since, coalesce(sum(good_qty),0) AS all_good, {more} FROM sr WHERE {where} GROUP BY {keys} HAVING {having}"
    return f"(SELECT *, CASE WHEN good > 0 THEN kwh / good END AS kwh_per_good, CASE WHEN tracked > 0 THEN production / tracked END AS utilization, CASE WHEN all_good + scrap > 0 THEN scrap / (all_good + scrap) END AS scrap_rate, CASE WHEN tracked > 0 THEN lost / tracked END AS lost_share FROM ({inner}))"


def _norm(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR max({c}) OVER () - min({c}) OVER () <= 1e-9 THEN 0.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END)"


def _flag(high: str, mid: str) -> str:
    return f"CASE WHEN score >= {high} THEN 'high' WHEN score >= {mid} THEN 'medium' ELSE 'low' END"


@query(
    f"""SELECT machine, family, eligible_rows, all_kwh, all_good, kwh_per_good, scrap_rate, utilization, lost_share, mean_hours_since, maintenance_hours, production_hours, setup_hours, score, {_flag("0.55", "0.30")} AS flag,
CASE WHEN greatest(p0,p1,p2,p3) <= 0 THEN 'No strong canonical opportunity signal' WHEN p0 = greatest(p0,p1,p2,p3) THEN 'High kWh per good unit' WHEN p1 = greatest(p0,p1,p2,p3) THEN 'High non-productive share' WHEN p2 = greatest(p0,p1,p2,p3) THEN 'Long time since last maintenance' ELSE 'Elevated scrap rate' END AS driver
FROM (SELECT *, round(p0*0.40+p1*0.30+p2*0.15+p3*0.15, 4) AS score FROM (SELECT *, {_norm("kwh_per_good")} AS p0, least(1.0, greatest(0.0, coalesce(lost_share, 0))) AS p1, {_norm("mean_hours_since")} AS p2, least(1.0, greatest(0.0, coalesce(scrap_rate, 0))) AS p3 FROM {_agg("machine, family", "coalesce(sum(energy_kwh),0) AS all_kwh, count(*) FILTER (machine_state = 'maintenance') AS maintenance_hours, count(*) FILTER (machine_state = 'production') AS production_hours, count(*) FILTER (machine_state = 'setup_changeover') AS setup_hours")}))""",
    SCORES,
    "all_kwh all_good kwh_per_good scrap_rate utilization lost_share mean_hours_since score",
)
def machine_opportunity(spark, sf_dir):
    return R.machine_opportunity(fact(spark, sf_dir))


@query(
    f"SELECT hour, shift, eligible_rows, machines, kwh, good, kwh_per_good, utilization, score, {_flag('0.67', '0.40')} AS flag FROM (SELECT *, round((1 - {_norm('kwh_per_good')})*0.55 + least(coalesce(utilization,0),1.0)*0.30 + {_norm('good')}*0.15, 4) AS score FROM {_agg('hour, shift', 'count(DISTINCT machine) AS machines', 'true', 'sum(ok) > 0')})",
    SCORES,
    "kwh good kwh_per_good utilization score",
)
def schedule_summary(spark, sf_dir):
    return R.schedule_summary(fact(spark, sf_dir))


@query(
    f"SELECT leader, n_rows, machines, kwh, good, kwh_per_good, scrap_rate, utilization, mean_hours_since, score, {_flag('0.67', '0.40')} AS band FROM (SELECT *, round((1 - {_norm('kwh_per_good')})*0.45 + least(coalesce(utilization,0),1.0)*0.25 + (1 - least(coalesce(scrap_rate,0),1.0))*0.20 + {_norm('good')}*0.10, 4) AS score FROM {_agg('leader', 'count(*) AS n_rows, count(DISTINCT machine) AS machines', 'leader IS NOT NULL', 'sum(safe_good) > 0')})",
    SCORES,
    "kwh good kwh_per_good scrap_rate utilization mean_hours_since score",
)
def team_insights(spark, sf_dir):
    return R.team_insights(fact(spark, sf_dir))


# ---- readiness ----
READY = S.FACT + """,
ri0 AS (SELECT *, greatest(coalesce(setup_minutes,0), coalesce(planned_stop_minutes,0), coalesce(unplanned_stop_minutes,0), coalesce(idle_minutes,0)) > 0 AS other,
  CASE WHEN lower(task) LIKE '%print%' AND (lower(task) LIKE '%finishing%' OR task LIKE '%+%') THEN 'Hard' WHEN lower(task) LIKE '%print%' THEN 'Medium' WHEN lower(task) LIKE '%finishing%' THEN 'Easy' END AS difficulty FROM fact),
ri1 AS (SELECT *, CASE WHEN NOT coalesce(good_qty > 0, false) THEN CASE WHEN machine_state IN ('setup_changeover','planned_stop','unplanned_stop','idle','maintenance') THEN 'nonproductive' WHEN machine_state = 'production' THEN
   CASE WHEN budget_anomaly IS NOT NULL OR alignment = 'missing_positive_row_basis_minutes' OR qty_warning = 'csi_qty_no_positive_production_minutes' THEN 'source_quality_or_anomaly' WHEN alignment = 'material_misaligned' THEN 'order_or_material_context_conflict' WHEN production_minutes > 0 AND other THEN 'state_label_contradiction' WHEN production_minutes > 0 AND order_id IS NOT NULL AND material IS NOT NULL AND task IS NOT NULL THEN 'quantity_overlay_gap' ELSE 'production' END
   ELSE 'insufficient_context' END WHEN hours_since IS NULL THEN 'missing_hours_since_last_maintenance' WHEN difficulty IS NULL THEN 'unmapped_task_name' END AS blocked_reason FROM ri0),
ready AS MATERIALIZED (SELECT machine, split_part(machine,'-',1) AS family, hour_us, coalesce(material,'unknown') AS material, coalesce(leader,'unknown') AS leader, task, difficulty, good_qty, coalesce(CASE WHEN team_size > 0 THEN team_size END, 3.0) AS team_size, hours_since, coalesce(last_work_type,'unknown') AS last_work_type, works_30d, works_ever, energy_kwh, machine_state,
  concat_ws('; ', CASE WHEN coalesce(team_size,0) <= 0 THEN 'team_size_from_preprocessor_default' END, CASE WHEN difficulty IS NULL THEN 'task_difficulty_unmapped' END, CASE WHEN last_work_type IS NULL THEN 'last_maintenance_type_unknown' END, CASE WHEN leader IS NULL THEN 'team_leader_unknown' END, CASE WHEN material IS NULL THEN 'material_code_unknown' END) AS notes,
  blocked_reason, CASE WHEN blocked_reason IS NULL THEN 1 ELSE 0 END AS eligible, hour_ts FROM ri1)"""


@query("SELECT machine, hour_us, material, leader, difficulty, good_qty, team_size, hours_since, last_work_type, works_30d, works_ever, notes, blocked_reason, eligible FROM ready", READY, "good_qty team_size hours_since")
def readiness_taxonomy(spark, sf_dir):
    return inputs(spark, sf_dir).select("machine", "hour_us", "material", "leader", "difficulty", "good_qty", "team_size", "hours_since", "last_work_type", "works_30d", "works_ever", "notes", "blocked_reason", "eligible")


@query("SELECT bucket, count(b) AS n_rows, count(b) / sum(count(b)) OVER () AS share FROM (VALUES ('eligible_clean'),('eligible_with_notes'),('eligible_with_default'),('blocked')) v(bucket) LEFT JOIN (SELECT CASE WHEN eligible = 0 THEN 'blocked' WHEN notes LIKE '%default%' THEN 'eligible_with_default' WHEN notes <> '' THEN 'eligible_with_notes' ELSE 'eligible_clean' END AS b FROM ready) ON b = bucket GROUP BY bucket", READY, "share")
def inference_coverage(spark, sf_dir):
    return R.inference_coverage(inputs(spark, sf_dir))


@query("SELECT blocked_reason, count(*) AS n_rows, count(*) / sum(count(*)) OVER () AS share FROM ready WHERE eligible = 0 GROUP BY blocked_reason", READY, "share")
def blocked_reason_summary(spark, sf_dir):
    return R.blocked_reasons(inputs(spark, sf_dir))


_LATEST = "SELECT * FROM ready WHERE eligible = 1 QUALIFY row_number() OVER (PARTITION BY machine ORDER BY hour_us DESC) = 1"


@query(f"SELECT machine, family, hour_us, material, difficulty, good_qty, hours_since FROM ({_LATEST})", READY, "good_qty hours_since")
def latest_per_machine(spark, sf_dir):
    return R.latest_per_machine(inputs(spark, sf_dir)).select("machine", "family", "hour_us", "material", "difficulty", "good_qty", "hours_since")


@query(f"WITH l AS (SELECT *, energy_kwh / good_qty AS k FROM ({_LATEST})), p AS (SELECT a.machine, count(*) FILTER (a.difficulty = b.difficulty AND a.family = b.family) AS n1, count(*) FILTER (a.difficulty = b.difficulty) AS n2, median(b.k) FILTER (a.difficulty = b.difficulty AND a.family = b.family) AS m1, median(b.k) FILTER (a.difficulty = b.difficulty) AS m2, median(b.k) AS m3 FROM l a JOIN l b ON a.machine <> b.machine GROUP BY a.machine) SELECT machine, CASE WHEN n1 >= 3 THEN m1 WHEN n2 >= 5 THEN m2 ELSE m3 END AS baseline, CASE WHEN n1 >= 3 THEN 'family' WHEN n2 >= 5 THEN 'difficulty' ELSE 'all' END AS level FROM p", READY, "baseline")
def peer_median_baseline(spark, sf_dir):
    latest = R.latest_per_machine(inputs(spark, sf_dir)).withColumn("kwh_per_good", F.col("energy_kwh") / F.col("good_qty"))
    return R.peer_baseline(latest)


@query("SELECT machine, material, coalesce(task,'unknown') AS task, count(*) AS n_rows FROM ready WHERE good_qty > 0 GROUP BY ALL", READY)
def support_maps(spark, sf_dir):
    return inputs(spark, sf_dir).filter("good_qty > 0").groupBy("machine", "material", F.coalesce("task", F.lit("unknown")).alias("task")).agg(F.count("*").alias("n_rows"))


@query("SELECT family, material, task, difficulty, median(good_qty) AS median_qty, count(*) AS n_rows, min(mh) AS usual_hour FROM (SELECT r.*, mode_hour AS mh FROM ready r JOIN (SELECT family, material, task, difficulty, min(h) AS mode_hour FROM (SELECT * FROM (SELECT family, material, task, difficulty, hour(hour_ts) AS h, count(*) AS c FROM ready WHERE eligible = 1 GROUP BY ALL) QUALIFY c = max(c) OVER (PARTITION BY family, material, task, difficulty)) GROUP BY ALL) USING (family, material, task, difficulty) WHERE eligible = 1) GROUP BY family, material, task, difficulty", READY, "median_qty")
def queue_seed(spark, sf_dir):
    return inputs(spark, sf_dir).filter("eligible = 1").groupBy("family", "material", "task", "difficulty").agg(F.median("good_qty").alias("median_qty"), F.count("*").alias("n_rows"), F.mode("hour", True).cast("bigint").alias("usual_hour"))


def _window(*order):
    return Window.partitionBy("machine").orderBy(*order)


# ---- months and layers ----
@query("SELECT strftime(hour_ts, '%Y-%m') AS month_key, count(*) AS n_rows, min(hour_us) AS first_us, max(hour_us) AS last_us FROM (SELECT hour_us, make_timestamp(hour_us) AS hour_ts FROM meters) GROUP BY 1", S.DUCK)
def month_coverage(spark, sf_dir):
    ts = F.timestamp_micros("hour_us")
    return bound(spark, sf_dir)["meters"].groupBy(F.date_format(ts, "yyyy-MM").alias("month_key")).agg(F.count("*").alias("n_rows"), F.min("hour_us").alias("first_us"), F.max("hour_us").alias("last_us"))


_MONTHS = "SELECT DISTINCT strftime(make_timestamp({}), '%Y-%m') AS month_key FROM {}"


@query(" INTERSECT ".join(_MONTHS.format(c, t) for c, t in (("hour_us", "meters"), ("prod_start_us", "jobs"), ("report_us", "reports"))), S.DUCK)
def materializable_months(spark, sf_dir):
    b = bound(spark, sf_dir)
    months = [b[t].select(F.date_format(F.timestamp_micros(c), "yyyy-MM").alias("month_key")) for t, c in (("meters", "hour_us"), ("jobs", "prod_start_us"), ("reports", "report_us"))]
    return months[0].intersect(months[1]).intersect(months[2])


# ---- maintenance evidence ----
@query("SELECT machine, count(*) AS n_rows, count(DISTINCT work_order) AS orders, count(DISTINCT strftime(make_timestamp(txn_us), '%Y-%m')) AS months, max(txn_us) AS last_us, count(*) FILTER (work_type = 'PM') / count(*) AS pm_ratio FROM works GROUP BY machine", S.DUCK, "pm_ratio")
def machine_catalog(spark, sf_dir):
    works = bound(spark, sf_dir)["works"]
    return works.groupBy("machine").agg(F.count("*").alias("n_rows"), F.countDistinct("work_order").alias("orders"), F.countDistinct(F.date_format(F.timestamp_micros("txn_us"), "yyyy-MM")).alias("months"), F.max("txn_us").alias("last_us"), F.avg((F.upper("work_type") == "PM").cast("int")).alias("pm_ratio"))


@query("SELECT work_type, count(*) AS n_rows, count(work_order) AS with_order FROM works GROUP BY work_type", S.DUCK)
def work_order_distribution(spark, sf_dir):
    return bound(spark, sf_dir)["works"].groupBy("work_type").agg(F.count("*").alias("n_rows"), F.count("work_order").alias("with_order"))


_RELIABILITY = "SELECT machine, count(*) AS n_rows, count(*) FILTER (work_type = 'PM') AS pm, count(*) FILTER (work_type = 'CM') AS cm, count(*) FILTER (work_type = 'EM') AS em, (SELECT avg(gap) FROM (SELECT (txn_us - lag(txn_us) OVER (ORDER BY txn_us)) // 86400000000 AS gap FROM works f WHERE f.machine = w.machine AND f.work_type IN ('CM', 'EM'))) AS mtbf_days FROM works w GROUP BY machine"


def _reliability(spark, sf_dir):
    works = bound(spark, sf_dir)["works"]
    counts = works.groupBy("machine").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("work_type") == t).alias(t.lower()) for t in ("PM", "CM", "EM")])
    gaps = works.filter("work_type in ('CM', 'EM')").withColumn("gap", F.floor((F.col("txn_us") - F.lag("txn_us").over(_window("txn_us"))) / 86_400_000_000))
    return counts.join(gaps.groupBy("machine").agg(F.avg("gap").alias("mtbf_days")), "machine", "left")


@query(_RELIABILITY, S.DUCK, "mtbf_days")
def reliability_mtbf(spark, sf_dir):
    return _reliability(spark, sf_dir)


# ---- machine-days, weak labels and risk ----
DAYS = S.FACT + """,
days0 AS (SELECT machine, hour_us // 86400000000 AS d, sum(energy_kwh) AS kwh, coalesce(sum(production_minutes),0) AS prod, max(works_ever) AS works FROM fact GROUP BY ALL),
days AS MATERIALIZED (SELECT *, sum(kwh) OVER w AS kwh_30d, sum(prod) OVER w AS prod_30d, count(*) OVER w AS days_30d FROM days0 WINDOW w AS (PARTITION BY machine ORDER BY d RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def _days(spark, sf_dir):
    days = fact(spark, sf_dir).withColumn("d", F.floor(F.col("hour_us") / 86_400_000_000)).groupBy("machine", "d").agg(F.sum("energy_kwh").alias("kwh"), F.coalesce(F.sum("production_minutes"), F.lit(0.0)).alias("prod"), F.max("works_ever").alias("works"))
    month = _window("d").rangeBetween(-29, 0)
    return days.withColumns({"kwh_30d": F.sum("kwh").over(month), "prod_30d": F.sum("prod").over(month), "days_30d": F.count("*").over(month)})


@query("SELECT machine, d, kwh, prod, kwh_30d, prod_30d, days_30d FROM days", DAYS, "kwh prod kwh_30d prod_30d")
def machine_day_rolling_30d(spark, sf_dir):
    return _days(spark, sf_dir).select("machine", "d", "kwh", "prod", "kwh_30d", "prod_30d", "days_30d")




# ---- legacy hourly features ----
@query("SELECT machine, hour_us, energy_kwh, lag(energy_kwh) OVER m AS lag_kwh, avg(energy_kwh) OVER (m ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean_4, avg(energy_kwh) OVER (m ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mean_24, CASE WHEN energy_kwh IS NOT NULL THEN dense_rank() OVER (PARTITION BY hour_us ORDER BY energy_kwh NULLS LAST) END AS rank_in_hour FROM backbone WINDOW m AS (PARTITION BY machine ORDER BY hour_us)", S.BACKBONE, "energy_kwh lag_kwh mean_4 mean_24")
def lag_rolling_rank(spark, sf_dir):
    w = _window("hour_us")
    mean = lambda n: F.avg("energy_kwh").over(w.rowsBetween(-(n - 1), 0))
    rank = F.dense_rank().over(Window.partitionBy("hour_us").orderBy(F.asc_nulls_last("energy_kwh")))
    return backbone(bound(spark, sf_dir)["meters"]).select("machine", "hour_us", "energy_kwh", F.lag("energy_kwh").over(w).alias("lag_kwh"), mean(4).alias("mean_4"), mean(24).alias("mean_24"), F.when(F.col("energy_kwh").isNotNull(), rank.cast("bigint")).alias("rank_in_hour"))


_CHANGES = "SELECT machine, hash, material, lag(material) OVER (PARTITION BY machine ORDER BY prod_start_us, hash) AS previous, changeover, prod_start_us FROM jobs"


def _changes(spark, sf_dir):
    return bound(spark, sf_dir)["jobs"].withColumn("previous", F.lag("material").over(_window("prod_start_us", "hash")))


@query(f"SELECT machine, count(*) AS n_jobs, count(*) FILTER (previous IS NULL OR previous <> material) AS runs, count(DISTINCT material) AS materials, string_agg(material, '>' ORDER BY prod_start_us, hash) FILTER (previous IS NULL OR previous <> material) AS flow FROM ({_CHANGES}) GROUP BY machine", S.DUCK)
def material_flow(spark, sf_dir):
    new = F.col("previous").isNull() | (F.col("previous") != F.col("material"))
    runs = F.transform(F.array_sort(F.collect_list(F.when(new, F.struct("prod_start_us", "hash", "material")))), lambda x: x["material"])
    return _changes(spark, sf_dir).groupBy("machine").agg(F.count("*").alias("n_jobs"), F.count_if(new).alias("runs"), F.countDistinct("material").alias("materials"), F.array_join(runs, ">").alias("flow"))


@query("SELECT 'energy_good' AS pair, corr(energy_kwh, good_qty) AS r FROM fact UNION ALL SELECT 'energy_production', corr(energy_kwh, production_minutes) FROM fact UNION ALL SELECT 'good_production', corr(good_qty, production_minutes) FROM fact", S.FACT, "r")
def correlations(spark, sf_dir):
    pairs = {"energy_good": ("energy_kwh", "good_qty"), "energy_production": ("energy_kwh", "production_minutes"), "good_production": ("good_qty", "production_minutes")}
    return fact(spark, sf_dir).agg(*[F.corr(*p).alias(n) for n, p in pairs.items()]).unpivot([], list(pairs), "pair", "r")


@query("SELECT machine, hour_us, energy_kwh, z FROM (SELECT machine, hour_us, energy_kwh, (energy_kwh - avg(energy_kwh) OVER ()) / stddev_samp(energy_kwh) OVER () AS z FROM backbone) WHERE abs(z) > 3", S.BACKBONE, "energy_kwh z")
def zscore_outliers(spark, sf_dir):
    rows = backbone(bound(spark, sf_dir)["meters"]).select("machine", "hour_us", "energy_kwh")
    stats = rows.agg(F.avg("energy_kwh").alias("mean"), F.stddev_samp("energy_kwh").alias("dev"))
    return rows.crossJoin(F.broadcast(stats)).withColumn("z", (F.col("energy_kwh") - F.col("mean")) / F.when(F.col("dev") > 0, F.col("dev"))).filter("abs(z) > 3").drop("mean", "dev")


@query("SELECT shift, count(*) AS n_rows, round(sum(energy_kwh), 2) AS kwh, round(avg(energy_kwh), 2) AS mean_kwh FROM (SELECT energy_kwh, CASE WHEN h > 0 AND h <= 8 THEN 'Night' WHEN h > 8 AND h <= 16 THEN 'Day' WHEN h > 16 THEN 'Evening' END AS shift FROM (SELECT *, hour(make_timestamp(hour_us)) AS h FROM backbone)) WHERE shift IS NOT NULL GROUP BY shift", S.BACKBONE, "kwh mean_kwh")
def shift_summary(spark, sf_dir):
    """Hour 0 is in no shift: the bins are open on the left."""
    h = F.hour(F.timestamp_micros("hour_us"))
    shift = F.when((h > 0) & (h <= 8), "Night").when((h > 8) & (h <= 16), "Day").when(h > 16, "Evening")
    return backbone(bound(spark, sf_dir)["meters"]).groupBy(shift.alias("shift")).agg(F.count("*").alias("n_rows"), F.round(F.sum("energy_kwh"), 2).alias("kwh"), F.round(F.avg("energy_kwh"), 2).alias("mean_kwh")).filter("shift is not null")


# ---- resolution and set operations ----
def _systems(spark, sf_dir):
    """Machines that three systems know: the systems see different users."""
    b = bound(spark, sf_dir)
    return b["meters"].filter("component = 'main'").select("machine").distinct(), b["jobs"].filter("changeover > 3").select("machine").distinct(), b["works"].filter("work_type = 'EM'").select("machine").distinct()


_SYS = S.DUCK + """,
s1 AS (SELECT DISTINCT machine FROM meters WHERE component = 'main'), s2 AS (SELECT DISTINCT machine FROM jobs WHERE changeover > 3), s3 AS (SELECT DISTINCT machine FROM works WHERE work_type = 'EM')"""


@query("SELECT machine, e.kwh, e.n_rows FROM s1 JOIN s2 USING (machine) JOIN s3 USING (machine) JOIN (SELECT machine, sum(kwh) AS kwh, count(*) AS n_rows FROM meters WHERE kwh > 0 GROUP BY machine) e USING (machine)", _SYS, "kwh")
def three_way_match(spark, sf_dir):
    a, b, c = _systems(spark, sf_dir)
    energy_of = bound(spark, sf_dir)["meters"].filter("kwh > 0").groupBy("machine").agg(F.sum("kwh").alias("kwh"), F.count("*").alias("n_rows"))
    return energy_of.join(a, "machine", "left_semi").join(b, "machine", "left_semi").join(c, "machine", "left_semi")


@query("SELECT 'energy_only' AS kind, machine FROM (SELECT machine FROM s1 EXCEPT SELECT machine FROM s2 EXCEPT SELECT machine FROM s3) UNION ALL SELECT 'jobs_without_maintenance', machine FROM (SELECT machine FROM s2 EXCEPT SELECT machine FROM s3) UNION ALL SELECT 'maintenance_without_energy', machine FROM (SELECT machine FROM s3 EXCEPT SELECT machine FROM s1)", _SYS)
def partial_match_sets(spark, sf_dir):
    a, b, c = _systems(spark, sf_dir)
    parts = {"energy_only": a.subtract(b).subtract(c), "jobs_without_maintenance": b.subtract(c), "maintenance_without_energy": c.subtract(a)}
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("kind"), "machine")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT k.work_order, k.work_type, k.machine, k.txn_us, k.hash FROM (SELECT * FROM works WHERE txn_us // 86400000000 >= 19737) k WHERE NOT EXISTS (SELECT 1 FROM works o WHERE o.txn_us // 86400000000 < 19737 AND coalesce(o.work_order, '') = coalesce(k.work_order, '') AND o.machine = k.machine AND o.work_type = k.work_type)", S.DUCK)
def dedupe_append_anti(spark, sf_dir):
    """Transactions from mid-January on whose (order, machine, type) no earlier one has."""
    from ..sources.sinks import new_rows

    works = bound(spark, sf_dir)["works"]
    day = F.floor(F.col("txn_us") / 86_400_000_000)
    return new_rows(works.filter(day >= 19737), works.filter(day < 19737), ["work_order", "machine", "work_type"]).select("work_order", "work_type", "machine", "txn_us", "hash")


@query("SELECT machine, order_id, hash, prod_start_us FROM jobs QUALIFY row_number() OVER (PARTITION BY machine, order_id ORDER BY prod_start_us DESC, hash DESC) = 1", S.DUCK)
def upsert_latest(spark, sf_dir):
    from ..sources.sinks import keep_latest

    return keep_latest(bound(spark, sf_dir)["jobs"], ["machine", "order_id"], ["prod_start_us", "hash"]).select("machine", "order_id", "hash", "prod_start_us")


@query("SELECT c_custkey, coalesce(n_name, 'unresolved') AS canonical FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def alias_resolution(spark, sf_dir):
    """Spellings of a nation's name resolve to it: the registry has keys per system, candidates go in order."""
    from ..operators.resolve import resolve

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("canonical_id"), F.array(F.lower("n_name"), F.concat(F.lit("N-"), F.col("n_nationkey"))).alias("aliases"), F.lit("any").alias("system"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" n-"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("at N-"), F.col("c_nationkey"), F.lit(" "))).alias("raw"))
    found = resolve(customers, "raw", nations, "erp", pattern=r"N-\d+", key="c_custkey")
    return found.select("c_custkey", F.coalesce("canonical_id", F.lit("unresolved")).alias("canonical"))


# ---- layers, ingest, schedule and models ----
@query("SELECT machine AS canonical_machine_id, comp AS meter_component, count(*) AS n_rows, sum(value) AS kwh FROM (SELECT machine, value, us, event_id, CASE event_type WHEN 'view' THEN 'main' WHEN 'click' THEN 'uv' WHEN 'error' THEN 'combo' ELSE 'aggregate_total' END AS comp FROM bound WHERE event_type <> 'purchase') WHERE event_id % 5 <> 0 OR us % 3600000000 = 0 GROUP BY ALL", S.DUCK, "kwh")
def raw_to_clean_meters(spark, sf_dir):
    """Labels are written as a meter export has them, one row in five off the hour, and read back through both layers."""
    from ..sources.layers import clean_meters, raw_rows
    from .bindings import _MACHINE

    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type <> 'purchase'")
    label = F.concat(F.expr(_MACHINE.format(text="string")), F.expr("case event_type when 'view' then ' 主機' when 'click' then '　ＵＶ' when 'error' then ' UV IR' else '' end"))
    stamp = F.col("ts").cast("timestamp")
    export = events.select(label.alias("machine"), F.date_format(F.when(F.col("event_id") % 5 != 0, F.date_trunc("hour", stamp)).otherwise(stamp), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"), F.col("value").cast("string").alias("kwh"), F.lit("").alias("cost"), "event_id")
    clean = clean_meters(raw_rows(export, "energy"))
    return clean.groupBy("canonical_machine_id", "meter_component").agg(F.count("*").alias("n_rows"), F.sum("kwh").alias("kwh"))


@query("SELECT event_type, count(*) AS n_rows, sum(value) AS total FROM events GROUP BY event_type", "", "total")
def incremental_ingest(spark, sf_dir):
    """The events file through a checkpointed stream that takes what is there, twice: the second run finds nothing new."""
    from ..scratch import scratch_path
    from ..streaming.ingest import current_rows, ingest_available

    path = scratch_path(spark, "ingest")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for _ in range(2):
        ingest_available(spark, f"{sf_dir}/event[s].parquet", schema, f"{path}/table", f"{path}/state")
    return current_rows(spark, f"{path}/table", ["event_id"], ["ts"]).groupBy("event_type").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))




@query(None)
def efficiency_model(spark, sf_dir):
    from . import models

    rows = models.training_rows(inputs(spark, sf_dir)).persist()
    train, held_out = models.time_split(rows)
    return models.metrics(models.fit_regressors(train), held_out)


# ---- legacy hourly features and diagnostics ----


@query("WITH d AS (SELECT cast(make_timestamp(us) AS date) AS day, value FROM bound WHERE event_type = 'error') SELECT c.day, count(d.day) AS n_rows, coalesce(sum(value), 0) AS total FROM (SELECT cast(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS date) AS day FROM d) c LEFT JOIN d ON d.day = c.day GROUP BY c.day", S.DUCK, "total")
def daily_calendar(spark, sf_dir):
    """Every day from the first to the last, also days without a row."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    days = rows.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(rows, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("v", F.lit(0.0)).alias("total"))


_DAY = 86_400_000_000
_HALF = f"(SELECT DISTINCT machine, order_id FROM jobs WHERE prod_start_us // {_DAY} {{}} 19737)"


@query(f"SELECT 'gained' AS change, machine, order_id FROM (SELECT * FROM {_HALF.format('>=')} EXCEPT SELECT * FROM {_HALF.format('<')}) UNION ALL SELECT 'lost', machine, order_id FROM (SELECT * FROM {_HALF.format('<')} EXCEPT SELECT * FROM {_HALF.format('>=')})", S.DUCK)
def period_delta(spark, sf_dir):
    """(machine, order) pairs that came or went between the halves of the month; anti joins both ways."""
    jobs = bound(spark, sf_dir)["jobs"].withColumn("late", F.floor(F.col("prod_start_us") / _DAY) >= 19737)
    new, old = (jobs.filter(c).select("machine", "order_id").distinct() for c in ("late", "not late"))
    keys = ["machine", "order_id"]
    return new.join(old, keys, "left_anti").select(F.lit("gained").alias("change"), *keys).union(old.join(new, keys, "left_anti").select(F.lit("lost"), *keys))


@query("SELECT machine, hour_us, energy_kwh FROM backbone WHERE energy_kwh >= (SELECT quantile_cont(energy_kwh, 0.95) FROM backbone)", S.BACKBONE, "energy_kwh")
def anomalous_rows(spark, sf_dir):
    rows = backbone(bound(spark, sf_dir)["meters"]).select("machine", "hour_us", "energy_kwh")
    edge = rows.agg(F.percentile("energy_kwh", F.lit(0.95)).alias("edge"))
    return rows.join(F.broadcast(edge), F.col("energy_kwh") >= F.col("edge")).drop("edge")


@query("SELECT machine, n_rows, cast(sum(c) OVER (ORDER BY n_rows RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS place FROM (SELECT machine, count(*) AS n_rows, 1 AS c FROM jobs GROUP BY machine)", S.DUCK)
def order_with_ties(spark, sf_dir):
    """Rank in which ties share the larger place."""
    counts = bound(spark, sf_dir)["jobs"].groupBy("machine").agg(F.count("*").alias("n_rows"))
    return counts.withColumn("place", F.count("*").over(Window.partitionBy().orderBy("n_rows").rangeBetween(Window.unboundedPreceding, 0)))


@query("SELECT machine, energy_share, cume_dist() OVER (ORDER BY energy_share) AS percentile FROM (SELECT machine, sum(energy_kwh) / sum(sum(energy_kwh)) OVER () AS energy_share FROM backbone GROUP BY machine)", S.BACKBONE, "energy_share percentile")
def percentile_rank(spark, sf_dir):
    every = Window.partitionBy()
    out = backbone(bound(spark, sf_dir)["meters"]).groupBy("machine").agg(F.sum("energy_kwh").alias("kwh"))
    return out.withColumn("energy_share", F.col("kwh") / F.sum("kwh").over(every)).select("machine", "energy_share", F.cume_dist().over(every.orderBy("energy_share")).alias("percentile"))


@query("SELECT coalesce(a.order_id, b.order_id) AS order_id, CASE WHEN a.order_id IS NULL THEN 'new' ELSE 'updated' END AS change FROM (SELECT order_id, max(prod_start_us) AS t FROM jobs WHERE prod_start_us // 86400000000 < 19737 GROUP BY 1) a FULL JOIN (SELECT order_id, max(prod_start_us) AS t FROM jobs GROUP BY 1) b USING (order_id) WHERE a.order_id IS NULL OR a.t <> b.t", S.DUCK)
def snapshot_diff(spark, sf_dir):
    """Keys that are new or newer than in an earlier snapshot."""
    jobs = bound(spark, sf_dir)["jobs"]
    state = lambda df, c: df.groupBy("order_id").agg(F.max("prod_start_us").alias(c))
    both = state(jobs.filter(F.floor(F.col("prod_start_us") / _DAY) < 19737), "was").join(state(jobs, "now"), "order_id", "full_outer")
    return both.filter("was is null or was <> now").select("order_id", F.when(F.col("was").isNull(), "new").otherwise("updated").alias("change"))


@query(f"WITH z AS ({_SHADOW}) SELECT coalesce(shadow_reason, 'eligible') AS reason, count(*) AS n_rows, count(DISTINCT z.job_hash) AS jobs, sum(abs(coalesce(shadow_good, 0) - coalesce(f.good_qty, 0))) AS drift FROM z JOIN fq f USING (machine, hour_us) GROUP BY 1", S.QUANTITY, "drift")
def shadow_diagnostics(spark, sf_dir):
    rows = quantity_shadow(_quantity(spark, sf_dir))
    drift = F.abs(F.coalesce("shadow_good", F.lit(0.0)) - F.coalesce("good_qty", F.lit(0.0)))
    return rows.groupBy(F.coalesce("shadow_reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n_rows"), F.countDistinct("job_hash").alias("jobs"), F.sum(drift).alias("drift"))


@query("SELECT component, count(value) AS n_rows, avg(value) AS mean, stddev_samp(value) AS deviation, min(value) AS least, max(value) AS most FROM (SELECT component, kwh AS value FROM meters) GROUP BY component", S.DUCK, "mean deviation least most")
def feature_statistics(spark, sf_dir):
    value = "kwh"
    return bound(spark, sf_dir)["meters"].groupBy("component").agg(F.count(value).alias("n_rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))