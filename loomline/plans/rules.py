"""Rules over the machine-hour fact: maintenance risk, weak labels, scheduling candidates, review and hourly attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import band, idle_category, safe_divide, valid_speed
from ..operators.timeops import spread_over_hours
from ..scratch import once
from . import gold_sql as S
from . import readers as R
from . import schedule
from .bindings import bound
from .catalog import ENERGY, READY, energy, fact, inputs, query
from .gold import backbone, job_overlaps

DAY = 86_400_000_000
#: Days that a weak label looks ahead, and the day that ages are counted to in the queries (2024-04-15).
HORIZON, AS_OF = 14, 19828

UNIFIED = S.FACT + ",\nuv AS MATERIALIZED (SELECT *, CASE WHEN energy_kwh IS NOT NULL AND good_qty > 0 THEN energy_kwh / good_qty END AS kpu FROM fact)"
WORKS = S.DUCK + f",\nwd AS MATERIALIZED (SELECT *, txn_us // {DAY} AS d FROM works)"


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with energy per piece ``kpu``."""
    return fact(spark, sf_dir).withColumn("kpu", F.when(F.col("energy_kwh").isNotNull() & (F.col("good_qty") > 0), F.col("energy_kwh") / F.col("good_qty")))


def one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The rows beside a table of a single row."""
    return df.crossJoin(F.broadcast(stats))


def day_of(c: str) -> Column:
    return F.floor(F.col(c) / DAY)


# ---- maintenance risk ----
def maintenance_features_of(hours: DataFrame, works: DataFrame, as_of: int, none_since: int = 20089) -> DataFrame:
    """Per machine: days since its last work, energy and pieces after it, works, failures and preventive works.

    A machine without any work counts as last maintained on day ``none_since`` (2025-01-01).
    """
    last = works.groupBy("machine").agg(F.max("txn_us").alias("newest"), F.count("*").alias("works"), F.count_if(F.col("work_type").isin("CM", "EM")).alias("failures"), F.count_if(F.col("work_type") == "PM").alias("preventive"))
    rows = hours.select("machine", "hour_us", "good_qty", "energy_kwh").join(last, "machine", "left").withColumn("newest", F.coalesce("newest", F.lit(none_since * DAY)))
    after = F.col("hour_us") > F.col("newest")
    since = lambda c: F.coalesce(F.sum(F.when(after, F.col(c))), F.lit(0.0))
    out = rows.groupBy("machine").agg((F.lit(as_of) - F.floor(F.max("newest") / DAY)).alias("days_since"), since("good_qty").alias("units_since"), since("energy_kwh").alias("kwh_since"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("works", "failures", "preventive")])
    return out


_FEATURES = f"SELECT machine, {AS_OF} - max(l) // {DAY} AS days_since, coalesce(sum(good_qty) FILTER (hour_us > l), 0) AS units_since, coalesce(sum(energy_kwh) FILTER (hour_us > l), 0) AS kwh_since, coalesce(max(n), 0) AS works, coalesce(max(fails), 0) AS failures, coalesce(max(pm), 0) AS preventive FROM (SELECT fact.machine, hour_us, good_qty, energy_kwh, coalesce(w.l, 20089 * {DAY}) AS l, n, fails, pm FROM fact LEFT JOIN (SELECT machine, max(txn_us) AS l, count(*) AS n, count(*) FILTER (work_type IN ('CM', 'EM')) AS fails, count(*) FILTER (work_type = 'PM') AS pm FROM works GROUP BY machine) w USING (machine)) GROUP BY machine"


@query(_FEATURES, S.FACT, "units_since kwh_since")
def maintenance_features(spark, sf_dir):
    return maintenance_features_of(fact(spark, sf_dir), bound(spark, sf_dir)["works"], AS_OF)


def rule_risk(features: DataFrame) -> DataFrame:
    """Points for age (over 90 days 40, over 60 20), use (over 50,000 kWh 30) and more failures than preventive works (30)."""
    old, used, reactive = F.col("days_since") > 90, F.col("kwh_since") > 50_000, F.col("failures") > F.col("preventive")
    score = F.when(old, 40).when(F.col("days_since") > 60, 20).otherwise(0) + F.when(used, 30).otherwise(0) + F.when(reactive, 30).otherwise(0)
    advice = F.concat_ws(" | ", F.when(old, "Schedule preventive maintenance (>90 days)"), F.when(used, "High usage - inspect wear parts"), F.when(reactive, "Increase PM frequency (reactive > preventive)"))
    out = features.withColumn("score", F.least(score, F.lit(100))).withColumn("advice", F.when(advice == "", "Continue normal operation").otherwise(advice))
    return out.withColumn("risk", F.when(F.col("score") > 60, "HIGH").when(F.col("score") > 30, "MEDIUM").otherwise("LOW"))


_RISK = f"SELECT *, CASE WHEN score > 60 THEN 'HIGH' WHEN score > 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN a = '' THEN 'Continue normal operation' ELSE a END AS advice FROM (SELECT machine, days_since, cast(least(100, CASE WHEN days_since > 90 THEN 40 WHEN days_since > 60 THEN 20 ELSE 0 END + CASE WHEN kwh_since > 50000 THEN 30 ELSE 0 END + CASE WHEN failures > preventive THEN 30 ELSE 0 END) AS integer) AS score, concat_ws(' | ', CASE WHEN days_since > 90 THEN 'Schedule preventive maintenance (>90 days)' END, CASE WHEN kwh_since > 50000 THEN 'High usage - inspect wear parts' END, CASE WHEN failures > preventive THEN 'Increase PM frequency (reactive > preventive)' END) AS a FROM ({_FEATURES}))"


@query(f"SELECT machine, days_since, score, risk, advice FROM ({_RISK})", S.FACT)
def rule_risk_score(spark, sf_dir):
    return rule_risk(maintenance_features(spark, sf_dir)).select("machine", "days_since", "score", "risk", "advice")


@query(f"SELECT machine, score, risk FROM ({_RISK}) ORDER BY score DESC, machine LIMIT 20", S.FACT)
def risk_reference(spark, sf_dir):
    return rule_risk_score(spark, sf_dir).select("machine", "score", "risk").orderBy(F.desc("score"), "machine").limit(20)


DAYS = S.FACT + f""",
days0 AS (SELECT machine, hour_us // {DAY} AS d, sum(energy_kwh) AS kwh, coalesce(sum(production_minutes),0) AS prod, max(works_ever) AS works, sum(CASE WHEN energy_kwh IS NOT NULL AND good_qty > 0 THEN energy_kwh END) AS qk, sum(CASE WHEN energy_kwh IS NOT NULL AND good_qty > 0 THEN good_qty END) AS qg,
  sum(coalesce(setup_minutes,0)+coalesce(planned_stop_minutes,0)+coalesce(unplanned_stop_minutes,0)+coalesce(idle_minutes,0)) AS lost FROM fact GROUP BY ALL),
days AS MATERIALIZED (SELECT *, sum(kwh) OVER w AS kwh_30d, sum(prod) OVER w AS prod_30d, count(*) OVER w AS days_30d, sum(qk) OVER w / nullif(sum(qg) OVER w, 0) AS kpu_30d, sum(lost) OVER w / nullif(sum(lost) OVER w + sum(prod) OVER w, 0) AS lost_30d FROM days0 WINDOW w AS (PARTITION BY machine ORDER BY d RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)),
wd AS MATERIALIZED (SELECT machine, txn_us // {DAY} AS wd, work_type FROM works),
labelled0 AS (SELECT days.*, count(wd) AS past, count(wd) FILTER (wd > d - 30) AS past_30d, coalesce(avg(CASE WHEN work_type = 'PM' THEN 1.0 WHEN wd IS NOT NULL THEN 0.0 END), 0) AS pm_ratio, coalesce(avg(CASE WHEN work_type = 'PM' THEN 1.0 WHEN wd IS NOT NULL THEN 0.0 END) FILTER (wd > d - 30), 0) AS pm_ratio_30d, max(wd) AS last_wd FROM days LEFT JOIN wd ON wd.machine = days.machine AND wd <= d GROUP BY ALL),
labelled AS MATERIALIZED (SELECT *, d - last_wd AS days_since, CASE WHEN d + {HORIZON} <= (SELECT max(wd) FROM wd) THEN CASE WHEN EXISTS (SELECT 1 FROM wd f WHERE f.machine = labelled0.machine AND f.wd > d AND f.wd <= d + {HORIZON}) THEN 1 ELSE 0 END END AS label FROM labelled0)"""


def labelled_days(hours: DataFrame, works: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Machine-days with what is known up to the day, and whether a work follows within ``horizon`` days.

    The label is NULL where the horizon reaches past the last work of the table. Works of a day are one row, so all
    looks back and ahead are windows over a union of days.
    """
    w = Window.partitionBy("machine").orderBy("d")
    month, ever, ahead = w.rangeBetween(-29, 0), w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(1, horizon)
    lost = sum(F.coalesce(c, F.lit(0.0)) for c in ("setup_minutes", "planned_stop_minutes", "unplanned_stop_minutes", "idle_minutes"))
    ok = F.col("energy_kwh").isNotNull() & (F.col("good_qty") > 0)
    days = hours.withColumn("d", day_of("hour_us")).groupBy("machine", "d").agg(F.sum("energy_kwh").alias("kwh"), F.coalesce(F.sum("production_minutes"), F.lit(0.0)).alias("prod"), F.max("works_ever").alias("works"), F.sum(F.when(ok, F.col("energy_kwh"))).alias("qk"), F.sum(F.when(ok, F.col("good_qty"))).alias("qg"), F.sum(lost).alias("lost"), F.lit(True).alias("seen"))
    share = lambda a, b: F.sum(a).over(month) / F.nullif(sum(F.sum(c).over(month) for c in b), F.lit(0.0))
    days = days.withColumns({"kwh_30d": F.sum("kwh").over(month), "prod_30d": F.sum("prod").over(month), "days_30d": F.count("*").over(month), "kpu_30d": share("qk", ["qg"]), "lost_30d": share("lost", ["lost", "prod"])})
    per_day = works.groupBy("machine", day_of("txn_us").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("work_type") == "PM").alias("pm"))
    every = days.join(per_day, ["machine", "d"], "full_outer")
    total = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    ratio = lambda over: F.coalesce(F.sum("pm").over(over) / F.sum("n").over(over), F.lit(0.0))
    out = every.withColumns({"past": total("n", ever), "past_30d": total("n", month), "pm_ratio": ratio(ever), "pm_ratio_30d": ratio(month), "days_since": F.col("d") - F.max(F.when(F.col("n") > 0, F.col("d"))).over(ever), "ahead": total("n", ahead)}).filter("seen")
    out = one_row(out, per_day.agg(F.max("d").alias("last_day")))
    return out.withColumn("label", F.when(F.col("d") + horizon <= F.col("last_day"), (F.col("ahead") > 0).cast("int"))).drop("n", "pm", "seen", "ahead", "last_day")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(labelled_days(fact(spark, sf_dir), bound(spark, sf_dir)["works"]), "days")


@query("SELECT machine, d, past, past_30d, pm_ratio, pm_ratio_30d, days_since, label FROM labelled", DAYS, "pm_ratio pm_ratio_30d")
def weak_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("machine", "d", "past", "past_30d", "pm_ratio", "pm_ratio_30d", "days_since", "label")


#: Weight of each factor in the risk of a machine without a model; the last one counts from the top.
FACTORS = {"days_since": 0.35, "past_30d": 0.20, "kpu_30d": 0.15, "lost_30d": 0.15, "pm_ratio": 0.15}


def fallback_risk(days: DataFrame) -> DataFrame:
    """The latest day of each machine, its factors placed between the least and largest of the days with a label (else of the latest days)."""
    latest = days.withColumn("r", F.row_number().over(Window.partitionBy("machine").orderBy(F.desc("d")))).filter("r = 1").drop("r")
    edges = lambda df, p: df.agg(F.count("*").alias(f"{p}n"), *[f(c).cast("double").alias(f"{p}{n}_{c}") for c in FACTORS for n, f in (("low", F.min), ("high", F.max))])
    rows = one_row(one_row(latest, edges(days.filter("label is not null"), "a")), edges(latest, "b"))

    def place(c: str) -> Column:
        low, high = (F.when(F.col("an") > 0, F.col(f"a{n}_{c}")).otherwise(F.col(f"b{n}_{c}")) for n in ("low", "high"))
        return F.when(low.isNull() | (high - low <= 1e-9), 0.0).otherwise((F.coalesce(F.col(c).cast("double"), low) - low) / F.nullif(high - low, F.lit(0.0)))

    score = sum(w * ((1 - place(c)) if c == "pm_ratio" else place(c)) for c, w in FACTORS.items())
    return rows.select("machine", "d", score.alias("score")).withColumn("band", band(F.round("score", 9), 0.70, 0.45, ("High", "Medium", "Low")))


def _place(c: str) -> str:
    low, high = (f"(CASE WHEN (SELECT count(*) FROM ref) > 0 THEN (SELECT {f}({c}) FROM ref) ELSE (SELECT {f}({c}) FROM latest) END)" for f in ("min", "max"))
    return f"(CASE WHEN {low} IS NULL OR {high} - {low} <= 1e-9 THEN 0.0 ELSE (coalesce({c}, {low}) - {low}) / nullif({high} - {low}, 0) END)"


@query("SELECT *, CASE WHEN round(score, 9) >= 0.70 THEN 'High' WHEN round(score, 9) >= 0.45 THEN 'Medium' ELSE 'Low' END AS band FROM (SELECT machine, d, " + " + ".join(f"{w} * " + (f"(1 - {_place(c)})" if c == "pm_ratio" else _place(c)) for c, w in FACTORS.items()) + " AS score FROM latest)", DAYS + ",\nref AS MATERIALIZED (SELECT * FROM labelled WHERE label IS NOT NULL), latest AS MATERIALIZED (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY machine ORDER BY d DESC) = 1)", "score")
def risk_fallback_score(spark, sf_dir):
    return fallback_risk(labelled(spark, sf_dir))


@query("SELECT l.machine, factor, value, (SELECT count(*) FROM labelled r WHERE CASE factor WHEN 'days_since' THEN r.days_since WHEN 'past_30d' THEN r.past_30d WHEN 'kpu_30d' THEN r.kpu_30d WHEN 'lost_30d' THEN r.lost_30d ELSE r.pm_ratio END <= value) / (SELECT count(*) FROM labelled r WHERE CASE factor WHEN 'days_since' THEN r.days_since WHEN 'past_30d' THEN r.past_30d WHEN 'kpu_30d' THEN r.kpu_30d WHEN 'lost_30d' THEN r.lost_30d ELSE r.pm_ratio END IS NOT NULL) AS percentile FROM (UNPIVOT (SELECT machine, cast(days_since AS double) AS days_since, cast(past_30d AS double) AS past_30d, kpu_30d, lost_30d, cast(pm_ratio AS double) AS pm_ratio FROM labelled QUALIFY row_number() OVER (PARTITION BY machine ORDER BY d DESC) = 1) ON days_since, past_30d, kpu_30d, lost_30d, pm_ratio INTO NAME factor VALUE value) l", DAYS, "value percentile")
def evidence_factors(spark, sf_dir):
    """Each factor of a machine's latest day as a row, with the share of all machine-days that are not above it."""
    days = labelled(spark, sf_dir).select("machine", "d", *[F.col(c).cast("double").alias(c) for c in FACTORS])
    rows = days.unpivot(["machine", "d"], list(FACTORS), "factor", "value").filter("value is not null")
    w = Window.partitionBy("factor")
    ranked = rows.withColumn("percentile", F.count("*").over(w.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)) / F.count("*").over(w))
    last = days.groupBy("machine").agg(F.max("d").alias("d"))
    return ranked.join(last, ["machine", "d"], "left_semi").select("machine", "factor", "value", "percentile")


@query(None)
def weak_label_model(spark, sf_dir):
    from . import models

    return models.weak_label_model(labelled(spark, sf_dir))[1]


# ---- scheduling ----
def month_context(hours: DataFrame) -> DataFrame:
    """One row: price of a kWh (at least 1) and cost of a changeover (the median energy of setup hours, at least 5)."""
    used = hours.filter("energy_kwh > 0")
    setup = (F.col("setup_minutes") > 0) | (F.col("machine_state") == "setup_changeover")
    out = used.agg(safe_divide(F.sum(F.coalesce("energy_cost", F.lit(0.0))), F.sum("energy_kwh")).alias("p"), F.median(F.when(setup, F.col("energy_kwh"))).alias("s"), F.median("energy_kwh").alias("m"))
    price = F.when(F.col("p") > 0, F.col("p")).otherwise(1.0)
    return out.select(F.greatest(price, F.lit(1.0)).alias("price"), F.greatest(F.round(F.coalesce(F.coalesce("s", "m") * price, F.lit(25.0)), 4), F.lit(5.0)).alias("changeover"))


_CONTEXT = "SELECT greatest(p, 1.0) AS price, greatest(round(coalesce(coalesce(s, m) * p, 25.0), 4), 5.0) AS changeover FROM (SELECT CASE WHEN sum(coalesce(energy_cost, 0)) > 0 AND sum(energy_kwh) > 0 THEN sum(coalesce(energy_cost, 0)) / sum(energy_kwh) ELSE 1.0 END AS p, median(energy_kwh) FILTER (setup_minutes > 0 OR machine_state = 'setup_changeover') AS s, median(energy_kwh) AS m FROM fact WHERE energy_kwh > 0)"


@query(_CONTEXT, S.FACT, "price changeover")
def schedule_context(spark, sf_dir):
    return month_context(fact(spark, sf_dir))


_QUEUE = "(SELECT *, CASE WHEN quantity >= quantile_cont(quantity, 0.75) OVER () THEN 'High' WHEN quantity >= quantile_cont(quantity, 0.35) OVER () THEN 'Medium' ELSE 'Low' END AS urgency FROM (SELECT *, greatest(25.0, round_even(qty / 25, 0) * 25) AS quantity, concat_ws('/', family, material, task) AS job FROM (SELECT family, material, task, difficulty, median(good_qty) AS qty, count(*) AS seen FROM ready WHERE eligible = 1 GROUP BY ALL ORDER BY seen DESC, family, material, task LIMIT 24)))"
_PROFILES = f"(SELECT p.*, e.n AS total_events, e.pm AS pm_ratio, (SELECT max(hour_us) // {DAY} FROM fact) - e.l // {DAY} AS days_since FROM (SELECT machine, family, sum(energy_kwh) / sum(good_qty) AS kwh_per_good, arg_max(hours_since, hour_us) AS hours_since, count(*) AS support FROM ready WHERE eligible = 1 GROUP BY ALL) p LEFT JOIN (SELECT machine, count(*) AS n, max(txn_us) AS l, avg(CASE WHEN work_type = 'PM' THEN 1.0 ELSE 0.0 END) AS pm FROM works GROUP BY machine) e USING (machine))"
_JOINT = "(SELECT machine, material, task, count(*) AS joint FROM ready WHERE good_qty > 0 GROUP BY ALL)"
_MATERIAL = "(SELECT machine, material, count(*) AS by_material FROM ready WHERE good_qty > 0 GROUP BY ALL)"
_DIFFICULTY = "(SELECT machine, difficulty, count(*) AS by_difficulty FROM ready WHERE good_qty > 0 AND difficulty IS NOT NULL GROUP BY ALL)"
_RISKS = "(least(days_since / 120.0, 2.0) * 0.35 + CASE WHEN pm_ratio < 0.10 THEN 0.35 WHEN pm_ratio < 0.30 THEN 0.15 ELSE 0 END + CASE WHEN total_events < 5 THEN 0.10 ELSE 0 END)"
_TIER = "CASE WHEN joint > 0 THEN 'Material + task history' WHEN by_material > 0 AND by_difficulty > 0 THEN 'Material + task-difficulty history' WHEN by_material > 0 THEN 'Material history only' WHEN by_difficulty > 0 THEN 'Task-difficulty history only' ELSE 'Machine-family fallback' END"
_CANDIDATES = f"""SELECT job, family, urgency, quantity, machine, tier, status, energy_cost, maintenance_penalty, support_penalty, model_penalty, energy_cost + maintenance_penalty + support_penalty + model_penalty AS score, CASE WHEN status = 'Maintenance blackout' THEN 'maintenance_blackout' END AS exclude_reason FROM (
SELECT *, coalesce(kwh_per_good * quantity * price, 0) AS energy_cost, round(changeover * CASE WHEN total_events IS NOT NULL THEN {_RISKS} WHEN hours_since >= 3000 THEN 1.10 WHEN hours_since IS NULL THEN 0.40 ELSE least(hours_since / 1800.0, 1.0) * 0.30 END, 4) AS maintenance_penalty,
CASE WHEN total_events IS NOT NULL THEN CASE WHEN days_since >= 180 AND pm_ratio <= 0.05 THEN 'Maintenance blackout' ELSE 'Evidence-backed maintenance profile' END WHEN hours_since >= 3000 THEN 'Maintenance blackout' ELSE 'Maintenance evidence gap' END AS status,
round(changeover * CASE tier WHEN 'Material + task history' THEN 0 WHEN 'Material + task-difficulty history' THEN 0.10 WHEN 'Material history only' THEN 0.20 WHEN 'Task-difficulty history only' THEN 0.28 ELSE 0.55 END, 4) AS support_penalty, CASE WHEN kwh_per_good IS NULL THEN changeover * 0.65 ELSE 0.0 END AS model_penalty
FROM (SELECT q.*, p.* EXCLUDE (family), {_TIER} AS tier FROM {_QUEUE} q JOIN {_PROFILES} p USING (family) LEFT JOIN {_JOINT} j ON j.machine = p.machine AND j.material = q.material AND j.task = q.task LEFT JOIN {_MATERIAL} m ON m.machine = p.machine AND m.material = q.material LEFT JOIN {_DIFFICULTY} d ON d.machine = p.machine AND d.difficulty = q.difficulty), ({_CONTEXT}))"""


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours, works = once(fact(spark, sf_dir), "fact"), bound(spark, sf_dir)["works"]
    rows = R.readiness(hours)
    last_day = hours.agg(F.max(day_of("hour_us")).alias("today"))
    evidence = works.groupBy("machine").agg(F.count("*").alias("total_events"), F.max(day_of("txn_us")).alias("last_day"), F.avg((F.col("work_type") == "PM").cast("double")).alias("pm_ratio"))
    profiles = one_row(schedule.machine_profiles(rows).join(evidence, "machine", "left"), last_day).withColumn("days_since", F.col("today") - F.col("last_day")).drop("today", "last_day")
    return schedule.candidates(schedule.with_urgency(schedule.job_queue(rows)), profiles, schedule.support(rows), month_context(hours))


@query(_CANDIDATES, READY, "quantity energy_cost maintenance_penalty support_penalty model_penalty score")
def candidate_scores(spark, sf_dir):
    return scored_candidates(spark, sf_dir).drop("difficulty", "material", "task", "changeover")


@query(f"SELECT job, urgency, quantity, seen FROM {_QUEUE}", READY, "quantity")
def queue_urgency(spark, sf_dir):
    return schedule.with_urgency(schedule.job_queue(inputs(spark, sf_dir))).select("job", "urgency", "quantity", "seen")


@query(f"SELECT coalesce(exclude_reason, 'feasible') AS reason, count(*) AS n_rows, count(DISTINCT job) AS jobs FROM ({_CANDIDATES}) GROUP BY 1", READY)
def exclusion_reasons(spark, sf_dir):
    return candidate_scores(spark, sf_dir).groupBy(F.coalesce("exclude_reason", F.lit("feasible")).alias("reason")).agg(F.count("*").alias("n_rows"), F.countDistinct("job").alias("jobs"))


@query(f"SELECT job, machine, score, place FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY round(score, 6), machine) AS place FROM ({_CANDIDATES}) WHERE exclude_reason IS NULL) WHERE place <= 3", READY, "score")
def best_candidates(spark, sf_dir):
    return schedule.top_candidates(scored_candidates(spark, sf_dir).filter("exclude_reason is null"), 3).select("job", "machine", "score", "place")


@query(None)
def greedy_schedule(spark, sf_dir):
    return schedule.greedy(scored_candidates(spark, sf_dir))


@query(None)
def swapped_schedule(spark, sf_dir):
    """The greedy schedule after each family's best exchange of two jobs."""
    return schedule.greedy(scored_candidates(spark, sf_dir), swap=True)


@query(None)
def schedule_comparison(spark, sf_dir):
    """Jobs placed and sum of scores of the greedy schedule and of the naive one, and how far they are apart."""
    scored = once(scored_candidates(spark, sf_dir), "scored")
    sums = lambda df, kind: df.agg(F.count("machine").cast("double").alias("jobs"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score")).unpivot([], ["jobs", "score"], "metric", kind)
    both = sums(schedule.greedy(scored), "optimized").join(sums(schedule.greedy(scored, naive=True), "naive"), "metric")
    return both.withColumn("delta", F.col("optimized") - F.col("naive"))


# ---- review ----
#: Energy per piece above which a row is not learned from, and the least energy and pieces of one that is.
MOST_KPU, LEAST_KWH, LEAST_GOOD = 20.0, 0.25, 1.0
_LEARN = f"eligible = 1 AND good_qty >= {LEAST_GOOD} AND energy_kwh >= {LEAST_KWH} AND energy_kwh / good_qty <= {MOST_KPU}"
FITTED_SQL = f"""SELECT r.* EXCLUDE (task), coalesce(base + slope * good_qty, mean) AS p FROM ready r LEFT JOIN (SELECT family, CASE WHEN var_pop(x) > 1e-9 THEN regr_slope(y, x) END AS slope, CASE WHEN var_pop(x) > 1e-9 THEN regr_intercept(y, x) END AS base, avg(y) AS mean
FROM (SELECT family, energy_kwh / good_qty AS y, good_qty AS x FROM ready WHERE {_LEARN} AND hour_us <= (SELECT min(hour_us) + (max(hour_us) - min(hour_us)) * 4 // 5 FROM ready WHERE {_LEARN})) GROUP BY family) f ON f.family = r.family WHERE eligible = 1"""


def with_family_fit(rows: DataFrame) -> DataFrame:
    """Eligible rows with ``fit``: energy per piece by a line over the pieces, fitted for each machine family on the earlier four fifths of the time.

    Families without two different amounts of pieces there get their mean, those without a row no prediction.
    """
    y, x = F.col("energy_kwh") / F.col("good_qty"), F.col("good_qty")
    learn = rows.filter((F.col("eligible") == 1) & (x >= LEAST_GOOD) & (F.col("energy_kwh") >= LEAST_KWH) & (y <= MOST_KPU))
    cut = learn.agg((F.min("hour_us") + F.expr("(max(hour_us) - min(hour_us)) * 4 div 5")).alias("_cut"))
    varied = F.var_pop(x) > 1e-9
    lines = one_row(learn, cut).filter("hour_us <= _cut").groupBy("family").agg(F.when(varied, F.regr_slope(y, x)).alias("_slope"), F.when(varied, F.regr_intercept(y, x)).alias("_base"), F.avg(y).alias("_mean"))
    out = rows.filter("eligible = 1").join(lines, "family", "left").withColumn("fit", F.coalesce(F.col("_base") + F.col("_slope") * x, "_mean"))
    return out.select(*rows.columns, "fit")


_PREDICTED = f"SELECT * EXCLUDE (p), p AS predicted, least(1.0, support / 200.0) AS confidence FROM (SELECT * FROM ({FITTED_SQL}) QUALIFY row_number() OVER (PARTITION BY machine ORDER BY hour_us DESC) = 1) JOIN (SELECT machine, count(*) AS support FROM ready WHERE eligible = 1 GROUP BY machine) USING (machine)"


def predictions(rows: DataFrame) -> DataFrame:
    """A prediction table for the queries below: what the family's line gives for each machine's latest row, trusted by the machine's row count."""
    support = rows.filter("eligible = 1").groupBy("machine").agg(F.count("*").alias("support"))
    fitted = R.latest_per_machine(with_family_fit(rows))
    return fitted.join(support, "machine").select("machine", "hour_us", F.col("fit").alias("predicted"), F.least(F.lit(1.0), F.col("support") / 200.0).alias("confidence"))


def review(candidates: DataFrame, predicted: DataFrame) -> DataFrame:
    """Candidates by what they are predicted to use over their peers' median, times pieces, confidence and support."""
    rows = candidates.dropDuplicates(["machine", "hour_us"]).join(predicted, ["machine", "hour_us"])
    path = F.when(F.col("notes").contains("preprocessor_default"), "Defaulted row").when(F.trim("notes") != "", "Adapted row").otherwise("Direct canonical row")
    rows = rows.withColumn("support_path", path)
    base = R.peer_baseline(rows, "predicted")
    whole = rows.agg(F.median("predicted").alias("all_median"))
    rows = one_row(rows.join(base, "machine", "left"), whole).withColumn("baseline", F.when(F.col("level").isin("family", "difficulty"), F.col("baseline")).otherwise(F.col("all_median")))
    gap = F.greatest(F.col("predicted") - F.col("baseline"), F.lit(0.0))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in V.SUPPORT_PATHS.items() for x in kv]), F.col("support_path"))
    excess = gap * F.col("good_qty")
    return rows.select("machine", "family", "support_path", "predicted", "baseline", gap.alias("gap"), excess.alias("excess_kwh"), "confidence", (excess * F.greatest(F.lit(0.0), F.least("confidence", F.lit(1.0))) * weight).alias("priority"))


_PEERS = f"WITH l AS ({_PREDICTED}), p AS (SELECT a.machine, count(*) FILTER (a.difficulty = b.difficulty AND a.family = b.family) AS n1, count(*) FILTER (a.difficulty = b.difficulty) AS n2, median(b.predicted) FILTER (a.difficulty = b.difficulty AND a.family = b.family) AS m1, median(b.predicted) FILTER (a.difficulty = b.difficulty) AS m2 FROM l a JOIN l b ON a.machine <> b.machine GROUP BY a.machine)"
_REVIEW = f"""{_PEERS} SELECT machine, family, support_path, predicted, baseline, greatest(predicted - baseline, 0) AS gap, greatest(predicted - baseline, 0) * good_qty AS excess_kwh, confidence, greatest(predicted - baseline, 0) * good_qty * confidence * CASE support_path WHEN 'Direct canonical row' THEN 1.0 WHEN 'Adapted row' THEN 0.85 ELSE 0.65 END AS priority
FROM (SELECT l.*, CASE WHEN n1 >= 3 THEN m1 WHEN n2 >= 5 THEN m2 ELSE (SELECT median(predicted) FROM l) END AS baseline, CASE WHEN notes LIKE '%preprocessor_default%' THEN 'Defaulted row' WHEN trim(notes) <> '' THEN 'Adapted row' ELSE 'Direct canonical row' END AS support_path FROM l LEFT JOIN p USING (machine))"""


@query(_REVIEW, READY, "predicted baseline gap excess_kwh confidence priority")
def review_queue(spark, sf_dir):
    rows = once(inputs(spark, sf_dir), "inputs")
    return review(rows.filter("eligible = 1"), predictions(rows))


@query(f"SELECT machine, row_number() OVER (ORDER BY round(priority, 6) DESC, round(excess_kwh, 6) DESC, round(confidence, 6) DESC, round(predicted, 6) DESC, machine) AS place FROM ({_REVIEW})", READY)
def review_order(spark, sf_dir):
    """The review queue in its order of five keys; it has a row for each machine."""
    keys = [F.desc(F.round(c, 6)) for c in ("priority", "excess_kwh", "confidence", "predicted")]
    return review_queue(spark, sf_dir).select("machine", F.row_number().over(Window.partitionBy().orderBy(*keys, "machine")).alias("place"))


# ---- hourly attribution ----
_SPREAD = "SELECT *, unnest(range(prod_start_us - prod_start_us % 3600000000, prod_end_us, 3600000000)) AS h FROM jobs WHERE prod_end_us > prod_start_us AND job_good > 0"
_INSIDE = "(least(prod_end_us, h + 3600000000) - greatest(prod_start_us, h))"


def spread_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with pieces over their hours, with the microseconds inside each."""
    rows = spread_over_hours(jobs.filter("prod_end_us > prod_start_us and job_good > 0"), "prod_start_us", "prod_end_us")
    return rows.withColumn("inside", F.least("prod_end_us", F.col("hour_us") + V.HOUR_US) - F.greatest("prod_start_us", "hour_us"))


@query(f"SELECT hash, machine, hour_us, minutes, CASE WHEN job_good * share < 0.5 THEN 0.0 ELSE job_good * share END AS good, CASE WHEN job_good * share < 0.5 THEN 0.0 ELSE share END AS share FROM (SELECT hash, machine, h AS hour_us, job_good, {_INSIDE} / 6e7 AS minutes, {_INSIDE} / (prod_end_us - prod_start_us) AS share FROM ({_SPREAD}))", S.DUCK, "minutes good share")
def hourly_allocation(spark, sf_dir):
    """A job's pieces over its hours by share of overlap; under half a piece is none, and its share too. Jobs without pieces have no rows."""
    share = F.col("inside") / (F.col("prod_end_us") - F.col("prod_start_us"))
    none = F.col("job_good") * share < 0.5
    return spread_jobs(bound(spark, sf_dir)["jobs"]).select("hash", "machine", "hour_us", (F.col("inside") / 6e7).alias("minutes"), F.when(none, 0.0).otherwise(F.col("job_good") * share).alias("good"), F.when(none, 0.0).otherwise(share).alias("share"))


_OK_SPEED = "(speed > 0 AND speed BETWEEN CASE split_part(machine, '-', 1) WHEN '024' THEN 1000 WHEN '035' THEN 500 WHEN '166' THEN 500 ELSE 100 END AND CASE split_part(machine, '-', 1) WHEN '024' THEN 50000 WHEN '035' THEN 30000 WHEN '166' THEN 25000 ELSE 50000 END)"


@query(f"SELECT machine, h AS hour_us, sum(CASE WHEN {_OK_SPEED} THEN least(speed * {_INSIDE} / 3.6e9, job_good) ELSE job_good * {_INSIDE} / (prod_end_us - prod_start_us) END) AS good, count(*) FILTER ({_OK_SPEED}) AS by_speed FROM (SELECT *, job_good / (prod_min / 60) AS speed FROM ({_SPREAD})) GROUP BY ALL", S.DUCK, "good")
def speed_allocation(spark, sf_dir):
    """Pieces of an hour by the job's speed, at most all of them, where the speed is one of its family's; else by share of overlap."""
    speed = F.col("job_good") / (F.col("prod_min") / 60)
    ok = valid_speed(speed, F.col("machine"))
    pieces = F.when(ok, F.least(speed * F.col("inside") / 3.6e9, F.col("job_good"))).otherwise(F.col("job_good") * F.col("inside") / (F.col("prod_end_us") - F.col("prod_start_us")))
    return spread_jobs(bound(spark, sf_dir)["jobs"]).groupBy("machine", "hour_us").agg(F.sum(pieces).alias("good"), F.count_if(ok).alias("by_speed"))


def maintenance_hours_of(works: DataFrame) -> DataFrame:
    """(machine, hour_us) of every work and the hours next to it."""
    own = F.col("txn_us") - F.pmod("txn_us", F.lit(V.HOUR_US))
    return works.filter(F.col("work_type").isin("PM", "CM", "EM", "AM")).select("machine", F.explode(F.array(own - V.HOUR_US, own, own + V.HOUR_US)).alias("hour_us")).distinct()


_MHOURS = "SELECT DISTINCT machine, unnest([o - 3600000000, o, o + 3600000000]) AS hour_us FROM (SELECT machine, txn_us - txn_us % 3600000000 AS o FROM works)"


@query(_MHOURS, S.DUCK)
def maintenance_hours(spark, sf_dir):
    return maintenance_hours_of(bound(spark, sf_dir)["works"])


def hour_use(hours: DataFrame, works: DataFrame) -> DataFrame:
    """One use for each hour with energy: maintenance (a work within an hour 1.0, a job's task that says so 0.9), setup, production, else idle with its category."""
    rows = hours.filter("energy_kwh > 0").join(maintenance_hours_of(works).withColumn("near", F.lit(True)), ["machine", "hour_us"], "left")
    said = F.coalesce(F.col("task").rlike("|".join(V.MAINTENANCE_WORDS)), F.lit(False))
    near = F.coalesce("near", F.lit(False))
    use = F.when(near | said, "maintenance").when(F.col("job_hash").isNull(), "idle").when(F.col("setup_minutes") > 0, "setup").when(F.col("good_qty") > 0, "production").otherwise("idle")
    out = rows.withColumn("use", use).withColumn("confidence", F.when(near, 1.0).when(said, 0.9))
    return out.withColumn("category", F.when(F.col("use") == "idle", idle_category(F.timestamp_micros("hour_us"))))


_CATEGORY = "CASE WHEN isodow(t) >= 6 THEN 'weekend_idle' WHEN hour(t) < 7 THEN 'overnight_idle' WHEN hour(t) = 12 THEN 'lunch_idle' WHEN hour(t) IN (7, 15, 23) THEN 'shift_change_idle' WHEN hour(t) BETWEEN 8 AND 17 THEN 'unexplained_working_idle' ELSE 'evening_idle' END"
_USE = f"SELECT machine, hour_us, energy_kwh, use, CASE WHEN near THEN 1.0 END AS confidence, CASE WHEN use = 'idle' THEN {_CATEGORY} END AS category FROM (SELECT fact.*, make_timestamp(fact.hour_us) AS t, m.machine IS NOT NULL AS near, CASE WHEN m.machine IS NOT NULL THEN 'maintenance' WHEN job_hash IS NULL THEN 'idle' WHEN setup_minutes > 0 THEN 'setup' WHEN good_qty > 0 THEN 'production' ELSE 'idle' END AS use FROM fact LEFT JOIN ({_MHOURS}) m ON m.machine = fact.machine AND m.hour_us = fact.hour_us WHERE energy_kwh > 0)"


@query(f"SELECT machine, hour_us, use, confidence FROM ({_USE})", S.FACT, "confidence")
def hour_attribution(spark, sf_dir):
    return hour_use(fact(spark, sf_dir), bound(spark, sf_dir)["works"]).select("machine", "hour_us", "use", "confidence")


@query(f"SELECT category, count(*) AS n_rows, sum(energy_kwh) AS kwh FROM ({_USE}) WHERE use = 'idle' GROUP BY category", S.FACT, "kwh")
def idle_categories(spark, sf_dir):
    return hour_use(fact(spark, sf_dir), bound(spark, sf_dir)["works"]).filter("use = 'idle'").groupBy("category").agg(F.count("*").alias("n_rows"), F.sum("energy_kwh").alias("kwh"))


@query("SELECT machine, hour_us, kwh, kwh * s * f AS setup_kwh, kwh * p * f AS production_kwh, CASE WHEN s + p = 0 THEN kwh ELSE 0 END AS idle_kwh FROM (SELECT machine, hour_us, coalesce(energy_kwh, 0) AS kwh, coalesce(s, 0) AS s, coalesce(p, 0) AS p, CASE WHEN coalesce(s, 0) + coalesce(p, 0) > 0 THEN 1 / (coalesce(s, 0) + coalesce(p, 0)) ELSE 0 END AS f FROM backbone LEFT JOIN (SELECT machine, hour_us, sum(setup_overlap) / 60 AS s, sum(production_overlap) / 60 AS p FROM ov GROUP BY ALL) USING (machine, hour_us))", S.JOBS, "kwh setup_kwh production_kwh idle_kwh")
def proportional_attribution(spark, sf_dir):
    """An hour's energy by the overlap of setups and production, scaled to the whole of it; idle without either."""
    b = bound(spark, sf_dir)
    over = job_overlaps(backbone(b["meters"]), b["jobs"]).groupBy("machine", "hour_us").agg((F.sum("setup_overlap") / 60).alias("s"), (F.sum("production_overlap") / 60).alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = backbone(b["meters"]).join(over, ["machine", "hour_us"], "left").select("machine", "hour_us", zero("energy_kwh").alias("kwh"), zero("s").alias("s"), zero("p").alias("p"))
    busy = F.col("s") + F.col("p")
    part = lambda c: F.when(busy > 0, F.col("kwh") * F.col(c) / F.nullif(busy, F.lit(0.0))).otherwise(0.0)
    return rows.select("machine", "hour_us", "kwh", part("s").alias("setup_kwh"), part("p").alias("production_kwh"), F.when(busy == 0, F.col("kwh")).otherwise(0.0).alias("idle_kwh"))


# ---- teams, material and quality of the hourly view ----
@query("SELECT leader, kwh_per_good, hours, productivity, usual_task, spread, rank() OVER (ORDER BY round(kwh_per_good, 6)) AS place FROM (SELECT leader, sum(coalesce(energy_kwh, 0)) / sum(coalesce(good_qty, 0)) AS kwh_per_good, count(*) AS hours, sum(coalesce(good_qty, 0)) / count(*) AS productivity, coalesce(stddev_pop(kpu) FILTER (kpu > 0), 0) AS spread, (SELECT t FROM (SELECT coalesce(task, 'UNKNOWN') AS t, count(*) AS c FROM uv j WHERE j.leader = uv.leader GROUP BY ALL) ORDER BY c DESC, t LIMIT 1) AS usual_task FROM uv WHERE leader IS NOT NULL GROUP BY leader HAVING sum(coalesce(good_qty, 0)) > 0)", UNIFIED, "kwh_per_good productivity spread")
def team_performance(spark, sf_dir):
    """Teams by energy per piece, the least first; one row for each."""
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    out = unified(spark, sf_dir).filter("leader is not null").groupBy("leader").agg(safe_divide(zero("energy_kwh"), zero("good_qty")).alias("kwh_per_good"), F.count("*").alias("hours"), (zero("good_qty") / F.count("*")).alias("productivity"), F.mode(F.coalesce("task", F.lit("UNKNOWN")), True).alias("usual_task"), F.coalesce(F.stddev_pop(F.when(F.col("kpu") > 0, F.col("kpu"))), F.lit(0.0)).alias("spread")).filter("kwh_per_good is not null")
    return out.withColumn("place", F.rank().over(Window.partitionBy().orderBy(F.round("kwh_per_good", 6))).cast("bigint"))


@query("SELECT leader, task, avg(kpu) AS mean_kpu, median(kpu) AS median_kpu, count(kpu) AS n_rows, sum(good_qty) AS good, max(hour_us) AS last_us FROM uv WHERE leader IS NOT NULL AND task IS NOT NULL GROUP BY ALL HAVING count(kpu) >= 20", UNIFIED, "mean_kpu median_kpu good")
def leader_task_efficiency(spark, sf_dir):
    return unified(spark, sf_dir).filter("leader is not null and task is not null").groupBy("leader", "task").agg(F.avg("kpu").alias("mean_kpu"), F.median("kpu").alias("median_kpu"), F.count("kpu").alias("n_rows"), F.sum("good_qty").alias("good"), F.max("hour_us").alias("last_us")).filter("n_rows >= 20")


_STEPS = "SELECT *, lag(material) OVER (PARTITION BY machine ORDER BY hour_us) AS previous FROM energy WHERE material IS NOT NULL"


@query(f"SELECT previous, material, count(*) AS n_rows, coalesce(avg(setup_changeover_kwh) FILTER (setup_minutes > 0), CASE WHEN previous <> material THEN 5.0 ELSE 0.0 END) AS cost FROM ({_STEPS}) WHERE previous IS NOT NULL GROUP BY previous, material", ENERGY, "cost")
def material_transitions(spark, sf_dir):
    """Mean setup energy of each change of material on a machine; without one 5, or 0 if the material stays."""
    rows = energy(spark, sf_dir).filter("material is not null").withColumn("previous", F.lag("material").over(Window.partitionBy("machine").orderBy("hour_us"))).filter("previous is not null")
    cost = F.avg(F.when(F.col("setup_minutes") > 0, F.col("setup_changeover_kwh")))
    return rows.groupBy("previous", "material").agg(F.count("*").alias("n_rows"), cost.alias("c")).select("previous", "material", "n_rows", F.coalesce("c", F.when(F.col("previous") != F.col("material"), 5.0).otherwise(0.0)).alias("cost"))


@query(None)
def material_sequences(spark, sf_dir):
    """The queue's jobs of each family in the order in which materials are cheapest to change."""
    queue = schedule.job_queue(inputs(spark, sf_dir)).select("family", "job", "material")
    return schedule.sequenced(queue, material_transitions(spark, sf_dir))


@query("SELECT *, availability * performance * quality / 10000 AS oee FROM (SELECT 100.0 * count(*) FILTER (good_qty > 0) / count(*) AS availability, 85.0::double AS performance, 98.0::double AS quality FROM fact)", S.FACT, "availability performance quality oee")
def oee(spark, sf_dir):
    """Hours with pieces, with the default performance and quality of a view that measures neither."""
    out = fact(spark, sf_dir).agg((100.0 * F.count_if(F.col("good_qty") > 0) / F.count("*")).alias("availability"), F.lit(85.0).alias("performance"), F.lit(98.0).alias("quality"))
    return out.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality") / 10000)


_KEYS = ["energy_kwh", "good_qty", "kpu", "leader", "material"]


@query("SELECT n_rows, missing, outliers, greatest(0.0, 100 - 0.2 * missing - 0.5 * outliers) AS score FROM (SELECT count(*) AS n_rows, (" + " + ".join(f"100.0 * count(*) FILTER ({c} IS NULL) / count(*)" for c in _KEYS) + ") AS missing, 100.0 * count(*) FILTER (abs(kpu - (SELECT avg(kpu) FROM uv)) / (SELECT stddev_samp(kpu) FROM uv) > 3) / count(*) AS outliers FROM uv)", UNIFIED, "missing outliers score")
def data_quality_score(spark, sf_dir):
    """100 less a fifth of each key column's missing percent and half the percent of outliers in energy per piece."""
    rows = once(unified(spark, sf_dir), "unified")
    rows = one_row(rows, rows.agg(F.avg("kpu").alias("m"), F.stddev_samp("kpu").alias("s")))
    out = rows.agg(F.count("*").alias("n_rows"), sum(100.0 * F.count_if(F.col(c).isNull()) / F.count("*") for c in _KEYS).alias("missing"), (100.0 * F.count_if(F.abs(F.col("kpu") - F.col("m")) / F.nullif("s", F.lit(0.0)) > 3) / F.count("*")).alias("outliers"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 100 - 0.2 * F.col("missing") - 0.5 * F.col("outliers")))


@query(f"WITH steps AS ({_STEPS}), k AS (SELECT *, CASE WHEN good_qty > 0 THEN energy_kwh / good_qty END AS kpu FROM energy), t AS (SELECT sum(coalesce(energy_kwh, 0)) / sum(coalesce(good_qty, 0)) AS e FROM k WHERE leader IS NOT NULL GROUP BY leader HAVING sum(coalesce(good_qty, 0)) > 0), f AS (SELECT (SELECT sum(idle_kwh) / sum(energy_kwh) * 100 FROM k) AS idle, (SELECT count(*) FROM steps WHERE previous <> material) / (SELECT count(*) FROM k) * 100 AS transitions, (SELECT stddev_pop(e) / avg(e) * 100 FROM t) AS teams, (SELECT avg(kpu) FILTER (isodow(hour_ts) >= 6) / avg(kpu) FILTER (isodow(hour_ts) < 6) * 100 FROM k) AS weekend) SELECT rule, value FROM (UNPIVOT f ON idle, transitions, teams, weekend INTO NAME rule VALUE value) WHERE value > CASE rule WHEN 'idle' THEN 15 WHEN 'transitions' THEN 10 WHEN 'teams' THEN 20 ELSE 120 END", ENERGY, "value")
def threshold_recommendations(spark, sf_dir):
    """Rules over their limit, in percent: idle energy 15, changes of material 10 of the hours, spread of teams 20 of their mean, weekends 120 of weekdays."""
    rows = once(energy(spark, sf_dir), "energy")
    steps = rows.filter("material is not null").withColumn("previous", F.lag("material").over(Window.partitionBy("machine").orderBy("hour_us"))).agg(F.count_if(F.col("previous") != F.col("material")).alias("changes"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    teams = rows.filter("leader is not null").groupBy("leader").agg(safe_divide(zero("energy_kwh"), zero("good_qty")).alias("e")).agg((F.stddev_pop("e") / F.avg("e") * 100).alias("teams"))
    weekend = F.weekday(F.timestamp_micros("hour_us")) >= 5
    mean = lambda c: F.avg(F.when(c, F.col("kwh_per_good")))
    figures = rows.agg((F.sum("idle_kwh") / F.sum("energy_kwh") * 100).alias("idle"), F.count("*").alias("n"), (mean(weekend) / mean(~weekend) * 100).alias("weekend"))
    figures = one_row(one_row(figures, steps), teams).select("idle", (F.col("changes") / F.col("n") * 100).alias("transitions"), "teams", "weekend")
    limit = F.when(F.col("rule") == "idle", 15).when(F.col("rule") == "transitions", 10).when(F.col("rule") == "teams", 20).otherwise(120)
    return figures.unpivot([], ["idle", "transitions", "teams", "weekend"], "rule", "value").filter(F.col("value") > limit)


@query("SELECT machine, strftime(hour_ts, '%Y-%m') AS month_key, count(DISTINCT hour_us) AS hours, sum(good_qty) AS good, sum(energy_kwh) AS kwh, avg(kpu) AS mean_kpu, CASE WHEN count(DISTINCT hour_us) >= 100 THEN 'Active' ELSE 'Idle' END AS status, round(count(DISTINCT hour_us) / 720 * 100, 1) AS utilization FROM uv GROUP BY ALL", UNIFIED, "good kwh mean_kpu utilization")
def machine_activity(spark, sf_dir):
    """Hours, pieces and energy of each machine in each month; a month counts as 720 hours."""
    return activity(unified(spark, sf_dir))


def activity(rows: DataFrame) -> DataFrame:
    hours = F.countDistinct("hour_us")
    month = F.date_format(F.timestamp_micros("hour_us"), "yyyy-MM").alias("month_key")
    return rows.groupBy("machine", month).agg(hours.alias("hours"), F.sum("good_qty").alias("good"), F.sum("energy_kwh").alias("kwh"), F.avg("kpu").alias("mean_kpu"), F.when(hours >= 100, "Active").otherwise("Idle").alias("status"), F.round(hours / 720 * 100, 1).alias("utilization"))


@query("SELECT machine, hour_us, kpu, dense_rank() OVER (PARTITION BY hour_us ORDER BY kpu) AS place, avg(energy_kwh) OVER (PARTITION BY machine ORDER BY hour_us ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS mean_8 FROM uv QUALIFY kpu IS NOT NULL", UNIFIED, "kpu mean_8")
def efficiency_rank_in_hour(spark, sf_dir):
    """Rank of a machine among all of the hour by energy per piece, and its mean energy of eight rows."""
    rows = unified(spark, sf_dir).withColumn("mean_8", F.avg("energy_kwh").over(Window.partitionBy("machine").orderBy("hour_us").rowsBetween(-7, 0))).filter("kpu is not null")
    return rows.select("machine", "hour_us", "kpu", F.dense_rank().over(Window.partitionBy("hour_us").orderBy("kpu")).cast("bigint").alias("place"), "mean_8")

