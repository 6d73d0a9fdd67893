"""What is served from the readiness inputs: guarded predictions, blocked rows, previews, advice, savings and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide
from ..scratch import once
from . import models
from .catalog import READY, inputs, query
from .rules import DAY, FITTED_SQL, UNIFIED, one_row, unified, with_family_fit

#: Predictions above this many kWh per piece are not believed.
MOST = 20.0
#: Currency units an hour of machine, of oil and of both; hours of work a month; price of the introduction.
MACHINE_HOUR, OIL_HOUR, BOTH_HOUR, MONTH_HOURS, INVESTMENT = 663.0, 704.0, 1367.0, 16000.0, 500000.0


# ---- prediction ----
def guarded(rows: DataFrame, prediction: Column, most: float = MOST) -> DataFrame:
    """Rows with ``predicted`` where it is a number in [0, most]; others have no prediction and a reason that blocks them."""
    fit = F.coalesce(~F.isnan(prediction) & (prediction >= 0) & (prediction <= most), F.lit(False))
    return rows.withColumn("predicted", F.when(fit, prediction)).withColumn("blocked_reason", F.when(~fit, "predictor_returned_non_model_source"))


def predict_rows(model: PipelineModel | None, rows: DataFrame, most: float = MOST) -> DataFrame:
    """Eligible rows through a fitted model; without one all are blocked."""
    if model is None:
        return rows.withColumns({"predicted": F.lit(None).cast("double"), "blocked_reason": F.lit("predictor_artifacts_unavailable")})
    return guarded(model.transform(rows), F.col("prediction"), most).drop("raw_features", "features", "prediction")


_BATCH = f"SELECT machine, hour_us, p, CASE WHEN p BETWEEN 0 AND {MOST} THEN p END AS predicted, CASE WHEN p BETWEEN 0 AND {MOST} THEN NULL ELSE 'predictor_returned_non_model_source' END AS blocked_reason FROM ({FITTED_SQL})"


def _batch(rows: DataFrame) -> DataFrame:
    """Eligible rows with the guarded prediction of their family's line, fitted on the earlier four fifths of the time."""
    return guarded(with_family_fit(rows), F.col("fit")).drop("fit")


@query(f"SELECT * EXCLUDE (p) FROM ({_BATCH})", READY, "predicted")
def batch_predictions(spark, sf_dir):
    """Each eligible row with a prediction or the reason that blocks it."""
    return _batch(once(inputs(spark, sf_dir), "inputs")).select("machine", "hour_us", "predicted", "blocked_reason")


@query(f"SELECT DISTINCT machine, hour_us, blocked_reason FROM (SELECT machine, hour_us, blocked_reason FROM ready WHERE eligible = 0 UNION ALL SELECT machine, hour_us, blocked_reason FROM ({_BATCH}) WHERE predicted IS NULL)", READY)
def blocked_rows(spark, sf_dir):
    """Rows that are not eligible beside those whose prediction was refused; one for each machine, hour and reason."""
    rows = once(inputs(spark, sf_dir), "inputs")
    return blocked(rows, _batch(rows).filter("predicted is null")).select("machine", "hour_us", "blocked_reason")


def blocked(rows: DataFrame, refused: DataFrame) -> DataFrame:
    every = rows.filter("eligible = 0").unionByName(refused, allowMissingColumns=True)
    return every.dropDuplicates(["machine", "hour_us", "blocked_reason"])


@query(f"SELECT s.machine, s.hour_us, s.material, p.hour_us AS prediction_us, p.predicted FROM (SELECT * FROM ready WHERE eligible = 1 QUALIFY row_number() OVER (PARTITION BY machine ORDER BY hour_us DESC) = 1) s LEFT JOIN (SELECT * FROM ({_BATCH}) WHERE predicted IS NOT NULL QUALIFY row_number() OVER (PARTITION BY machine ORDER BY hour_us DESC) = 1) p ON p.machine = s.machine", READY, "predicted")
def preview_seeds(spark, sf_dir):
    """Latest eligible row of each machine and its latest prediction, which may be of an earlier hour or missing."""
    rows = once(inputs(spark, sf_dir), "inputs")
    return seeds(rows.filter("eligible = 1"), _batch(rows).filter("predicted is not null")).select("machine", "hour_us", "material", "prediction_us", "predicted")


def seeds(candidates: DataFrame, predicted: DataFrame) -> DataFrame:
    newest = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("machine").orderBy(F.desc("hour_us")))).filter("_r = 1").drop("_r")
    known = predicted.groupBy("machine").agg(F.max("hour_us").alias("prediction_us"), F.max_by("predicted", "hour_us").alias("predicted"))
    return newest.join(known, "machine", "left")


@query(None)
def model_predictions(spark, sf_dir):
    """Eligible rows through a linear model fitted on all but the last part of the time, with the guards."""
    rows = once(inputs(spark, sf_dir), "inputs")
    train, _ = models.time_split(models.training_rows(rows))
    every = models.with_features(rows.filter("eligible = 1"))
    return predict_rows(models.fit_linear(train), every).select("machine", "hour_us", "predicted", "blocked_reason")


@query(None)
def intervention_preview(spark, sf_dir):
    """Predictions of each machine's latest eligible row as it is and under what could be done, and the change each brings."""
    rows = once(inputs(spark, sf_dir), "inputs")
    train, _ = models.time_split(models.training_rows(rows))
    latest = seeds(models.with_features(rows.filter("eligible = 1")), _batch(rows))
    cases = guarded(models.what_if(models.fit_linear(train), latest.drop("predicted", "prediction_us")), F.col("prediction"))
    return preview(cases)


def preview(cases: DataFrame, neutral: float = 0.05) -> DataFrame:
    """What each case changes beside ``as_is`` of its machine: per piece, for the row's pieces, in a word, and whether it is the best that has a prediction.

    ``limited`` is a change of at most ``neutral`` of the prediction as it is (and of 0.001); the best case has the least change, then the
    least prediction, then the first name. ``cases`` has machine, case, predicted, good_qty and blocked_reason.
    """
    machine = Window.partitionBy("machine")
    base = F.max(F.when(F.col("case") == "as_is", F.col("predicted"))).over(machine)
    rows = cases.withColumn("base", base).withColumn("change", F.col("predicted") - F.col("base"))
    counts = (F.col("case") != "as_is") & F.col("change").isNotNull()
    small = F.abs("change") <= F.greatest(F.lit(0.001), F.abs("base") * neutral)
    reading = F.when(counts, F.when(small, "limited").when(F.col("change") < 0, "lowers").otherwise("raises"))
    best = F.min(F.when(counts, F.struct("change", "predicted", "case"))).over(machine)
    return rows.select("machine", "case", "predicted", "change", (F.col("change") * F.col("good_qty")).alias("change_kwh"), reading.alias("reading"), F.coalesce(best["case"] == F.col("case"), F.lit(False)).alias("best"), "blocked_reason")


_HELD = "(cast('0x' || substr(md5('42/' || machine || '/' || cast(hour_us AS varchar)), 1, 8) AS bigint) % 100 >= 80)"


@query(f"SELECT {_HELD} AS held_out, count(*) AS n_rows FROM ready WHERE eligible = 1 GROUP BY 1", READY)
def random_holdout(spark, sf_dir):
    """Sizes of a split four to one by a hash of the row's key, which comes out the same on every run."""
    return random_split(inputs(spark, sf_dir).filter("eligible = 1"), ["machine", "hour_us"]).groupBy("held_out").agg(F.count("*").alias("n_rows"))


def random_split(rows: DataFrame, keys: Sequence[str], percent: int = 20, seed: int = 42) -> DataFrame:
    name = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return rows.withColumn("held_out", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % 100 >= 100 - percent)


# ---- promotion ----
def promotion_gate(candidate: Mapping[str, float], active: Mapping[str, float] | None, features: Sequence[str], expected: Sequence[str], smoke: float | None, most: float = MOST) -> dict[str, bool]:
    """What a fitted model must meet before it takes over; ``promote`` is all of it."""
    checks = {
        "has_metrics": all(k in candidate for k in ("r2", "mae", "rmse")),
        "feature_contract": list(features) == list(expected),
        "smoke_prediction": smoke is not None and 0 <= smoke <= most,
        "not_worse": "r2" in candidate and models.promotes(candidate["r2"], None if active is None else active["r2"]),
    }
    return checks | {"promote": all(checks.values())}


def log_training(spark, path: str, run: str, metrics: DataFrame) -> None:
    """Append a run's metrics to the log of trainings."""
    metrics.withColumns({"run": F.lit(run), "logged_at": F.current_timestamp()}).write.mode("append").parquet(path)


# ---- advice and savings ----
def recommendations(rows: DataFrame, now: Column, days: int = 30, most_hours: float = 1000, most_kpu: float = 5, most_leaders: int = 5, target: float = 3) -> DataFrame:
    """Advice for each machine from its last ``days``: late maintenance, much energy per piece, many leaders."""
    recent = rows.filter(F.col("hour_us") >= now - days * DAY)
    means = recent.groupBy("machine").agg(F.avg("kpu").alias("kpu"), F.avg("hours_since").alias("hours"), F.countDistinct("leader").alias("leaders")).filter("kpu is not null")
    case = lambda test, kind, priority, value: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), value.alias("expected_savings")))
    advice = F.array_compact(F.array(
        case(F.col("hours") > most_hours, "Maintenance", "High", F.lit(MACHINE_HOUR * 72)),
        case(F.col("kpu") > most_kpu, "Efficiency", "Medium", (F.col("kpu") - target) * 1000 * MACHINE_HOUR),
        case(F.col("leaders") > most_leaders, "Team", "Low", F.lit(None).cast("double")),
    ))
    return means.select("machine", F.inline(advice))


_RECENT = f"SELECT machine, avg(kpu) AS kpu, avg(hours_since) AS hours, count(DISTINCT leader) AS leaders FROM uv WHERE hour_us >= (SELECT max(hour_us) FROM uv) - {30 * DAY} GROUP BY machine HAVING avg(kpu) IS NOT NULL"


@query(f"SELECT machine, 'Maintenance' AS kind, 'High' AS priority, 47736.0::double AS expected_savings FROM ({_RECENT}) WHERE hours > 10 UNION ALL SELECT machine, 'Efficiency', 'Medium', (kpu - 0.5) * 1000 * 663 FROM ({_RECENT}) WHERE kpu > 1 UNION ALL SELECT machine, 'Team', 'Low', NULL FROM ({_RECENT}) WHERE leaders > 5", UNIFIED, "expected_savings")
def machine_recommendations(spark, sf_dir):
    """Advice from the last 30 days of the table; the bounds of 10 hours and 1 kWh suit the bound data, which is dense."""
    rows = once(unified(spark, sf_dir), "unified")
    newest = rows.agg(F.max("hour_us").alias("now"))
    return recommendations(one_row(rows, newest), F.col("now"), most_hours=10, most_kpu=1, target=0.5)


def savings(better: Column) -> dict[str, Column]:
    """Monthly savings of a change of energy per piece by ``better`` (a share; a loss counts as much)."""
    share = F.abs(better)
    parts = {"machine_hours": share * (MONTH_HOURS * MACHINE_HOUR), "oil": share * (MONTH_HOURS * OIL_HOUR), "maintenance": F.lit(24 * BOTH_HOUR), "efficiency": share * (MONTH_HOURS * BOTH_HOUR * 0.1), "quality": share * (MONTH_HOURS * 100)}
    total = sum(parts.values(), F.lit(0.0))
    return parts | {"total_month": total, "payback_months": F.coalesce(safe_divide(F.lit(INVESTMENT), total), F.lit(999.0)), "roi_percent": total * 12 / INVESTMENT * 100}


_COMPARED = f"SELECT machine, (k - p) / k AS b FROM (SELECT r.machine, avg(r.energy_kwh / r.good_qty) AS k, avg(p.predicted) AS p FROM ready r JOIN ({_BATCH}) p ON p.machine = r.machine AND p.hour_us = r.hour_us WHERE r.eligible = 1 GROUP BY r.machine) WHERE k > 0 AND p IS NOT NULL"


@query(f"SELECT machine, t AS total_month, 500000 / t AS payback_months, t * 12 / 500000 * 100 AS roi_percent FROM (SELECT machine, abs(b) * 16000 * (663 + 704 + 136.7 + 100) + 24 * 1367 AS t FROM ({_COMPARED}))", READY, "total_month payback_months roi_percent")
def expected_savings(spark, sf_dir):
    """What each machine would save if it ran as predicted, and when that pays for the introduction."""
    out = _batch(once(inputs(spark, sf_dir), "inputs")).groupBy("machine").agg(F.avg(F.col("energy_kwh") / F.col("good_qty")).alias("k"), F.avg("predicted").alias("p")).filter("k > 0 and p is not null")
    parts = savings((F.col("k") - F.col("p")) / F.col("k"))
    return out.select("machine", *[parts[c].alias(c) for c in ("total_month", "payback_months", "roi_percent")])


#: Shares and hours that the plant-wide sum adds to the gain in energy: idle time, failures, output, oil.
PLANT_GAINS = {"idle_reduction": MONTH_HOURS * 0.10 * MACHINE_HOUR, "failure_prevention": 24 * BOTH_HOUR, "production_optimization": MONTH_HOURS * 0.05 * BOTH_HOUR, "oil_optimization": MONTH_HOURS * 0.03 * OIL_HOUR}


@query(f"SELECT part, value FROM (UNPIVOT (SELECT e AS energy_efficiency, 1060800.0::double AS idle_reduction, 32808.0::double AS failure_prevention, 1093600.0::double AS production_optimization, 337920.0::double AS oil_optimization, e + 2525128.0 AS total_month, (e + 2525128.0) * 12 AS total_year, 500000 / (e + 2525128.0) AS payback_months FROM (SELECT 16000 * 663 * abs((k - p) / k) AS e FROM (SELECT avg(r.energy_kwh / r.good_qty) AS k, avg(p.predicted) AS p FROM ready r JOIN ({_BATCH}) p ON p.machine = r.machine AND p.hour_us = r.hour_us WHERE r.eligible = 1))) ON COLUMNS(*) INTO NAME part VALUE value)", READY, "value")
def plant_savings(spark, sf_dir):
    """Parts of the plant's monthly gain, their sum, the year's and the months until it pays; a row for each."""
    rows = _batch(once(inputs(spark, sf_dir), "inputs")).agg(F.avg(F.col("energy_kwh") / F.col("good_qty")).alias("k"), F.avg("predicted").alias("p"))
    parts = {"energy_efficiency": F.abs((F.col("k") - F.col("p")) / F.col("k")) * (MONTH_HOURS * MACHINE_HOUR)} | {k: F.lit(v) for k, v in PLANT_GAINS.items()}
    total = parts["energy_efficiency"] + F.lit(sum(PLANT_GAINS.values()))
    parts |= {"total_month": total, "total_year": total * 12, "payback_months": safe_divide(F.lit(INVESTMENT), total)}
    out = rows.select([c.alias(n) for n, c in parts.items()]).withColumn("_", F.lit(0))
    return out.unpivot(["_"], list(parts), "part", "value").select("part", "value").filter("value is not null")


def projection(base: DataFrame, start: int = 1, growth: float = 0.05) -> DataFrame:
    """Twelve months of savings from a row with ``base``, each a twentieth of it more, and what was saved before each."""
    months = base.select("base", F.explode(F.sequence(F.lit(start), F.lit(start + 11))).alias("month"))
    n = F.col("month") - start
    return months.select("month", (F.col("base") * (1 + n * growth)).alias("savings"), (F.col("base") * (n + growth * n * (n - 1) / 2)).alias("saved_before"))
