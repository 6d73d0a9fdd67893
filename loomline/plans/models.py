"""Models over readiness inputs and machine-days, with pyspark.ml: time-aware split, fit, metrics, gate."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path

NUMBERS = ["good_qty", "team_size", "hours_since", "works_30d", "works_ever", "hour", "is_weekend", "is_night", "overdue", "urgency"]
TEXTS = ["family", "material", "leader", "difficulty", "last_work_type"]


def training_rows(inputs: DataFrame, least_qty: float = 1.0, most: float = 20.0) -> DataFrame:
    """Eligible rows with the target and the derived features."""
    rows = inputs.filter((F.col("eligible") == 1) & (F.col("good_qty") >= least_qty) & F.col("energy_kwh").isNotNull())
    rows = rows.withColumn("label", F.col("energy_kwh") / F.col("good_qty")).filter((F.col("label") <= most) & (F.col("energy_kwh") >= 0.25))
    return with_features(rows)


def with_features(rows: DataFrame) -> DataFrame:
    """Rows of the readiness inputs with the features that the models derive."""
    number = lambda c: F.col(c).cast("double")
    derived = {"is_weekend": (F.weekday("day") >= 5).cast("double"), "is_night": ((F.col("hour") >= 20) | (F.col("hour") < 6)).cast("double"), "overdue": (F.col("hours_since") > 1000).cast("double"), "urgency": F.col("hours_since") / 720}
    return rows.withColumns(derived | {c: number(c) for c in ("works_30d", "works_ever", "hour")})


def time_split(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The last months are held out: two of four or more, else one; a single month is cut by day."""
    months = [r[0] for r in rows.select("month_key").distinct().orderBy("month_key").collect()]
    if len(months) > 1:
        last = months[-2:] if len(months) >= 4 else months[-1:]
        return rows.filter(~F.col("month_key").isin(last)), rows.filter(F.col("month_key").isin(last))
    low, high = rows.agg(F.min("day"), F.max("day")).first()
    if low is None:
        return rows, rows
    cut = F.date_add(F.lit(low), int((high - low).days * share))
    return rows.filter(F.col("day") <= cut), rows.filter(F.col("day") > cut)


def _stages(features: str = "features") -> list:
    codes = [StringIndexer(inputCols=TEXTS, outputCols=[f"{c}_code" for c in TEXTS], stringOrderType="alphabetAsc", handleInvalid="keep"), Imputer(inputCols=NUMBERS, outputCols=[f"{c}_full" for c in NUMBERS], strategy="median")]
    return [*codes, VectorAssembler(inputCols=[f"{c}_full" for c in NUMBERS] + [f"{c}_code" for c in TEXTS], outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol=features, withMean=True)]


def fit_regressors(train: DataFrame, seed: int = 42) -> dict[str, PipelineModel]:
    models = {"linear": LinearRegression(), "forest": RandomForestRegressor(numTrees=40, maxDepth=8, maxBins=64, seed=seed), "boosted": GBTRegressor(maxIter=20, maxDepth=4, maxBins=64, seed=seed)}
    return {name: Pipeline(stages=[*_stages(), m]).fit(train) for name, m in models.items()}


def fit_linear(train: DataFrame) -> PipelineModel:
    return Pipeline(stages=[*_stages(), LinearRegression(regParam=0.01)]).fit(train)


def metrics(models: dict[str, PipelineModel], held_out: DataFrame) -> DataFrame:
    """r2, mae and rmse of each model on the held-out rows, best first."""
    rows = []
    for name, model in models.items():
        scored = model.transform(held_out).cache()
        rows.append((name, *[RegressionEvaluator(metricName=m).evaluate(scored) for m in ("r2", "mae", "rmse")]))
        scored.unpersist()
    return held_out.sparkSession.createDataFrame(rows, "model string, r2 double, mae double, rmse double").orderBy(F.desc("r2"))


def promotes(candidate: float, active: float | None, tolerance: float = 1e-9) -> bool:
    """A candidate takes over only when it is not worse than what is active."""
    return active is None or candidate >= active - tolerance


def what_if(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predictions of each row as it is and under earlier maintenance, one more hand, and both; one transform."""
    sooner = F.greatest(F.col("hours_since") - F.greatest(F.lit(12.0), F.col("hours_since") * 0.25), F.lit(0.0))
    case = lambda name, h, t: F.struct(F.lit(name).alias("case"), h.alias("h"), t.alias("t"))
    cases = F.array(case("as_is", F.col("hours_since"), F.col("team_size")), case("maintenance", sooner, F.col("team_size")), case("crew", F.col("hours_since"), F.col("team_size") + 1), case("both", sooner, F.col("team_size") + 1))
    every = rows.withColumn("_c", F.explode(cases)).withColumn("hours_since", F.col("_c.h")).withColumn("team_size", F.col("_c.t")).withColumn("case", F.col("_c.case")).drop("_c")
    return model.transform(every)


def without_summary(model: PipelineModel) -> PipelineModel:
    """The model as it loads from the shared folder.

    The training summary of a fitted logistic regression holds the session and goes to the tasks with the model, which fails once
    the session has been used for observations or tags; a loaded model has none.
    """
    path = scratch_path(SparkSession.active(), "model")
    model.write().save(path)
    return PipelineModel.load(path)


def weak_label_model(days: DataFrame, share: float = 0.8) -> tuple[PipelineModel, DataFrame]:
    """Logistic regression of the label, where one is known, weighted by class, cut by date; its area under the curve."""
    days = days.filter("label is not null")
    low, high = days.agg(F.min("d"), F.max("d")).first()
    cut = low + int((high - low) * share)
    train, held_out = days.filter(F.col("d") <= cut), days.filter(F.col("d") > cut)
    positive = train.agg(F.avg("label")).first()[0] or 0.5
    train = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(positive, 1e-3)).otherwise(0.5 / max(1 - positive, 1e-3)))
    inputs = ["kwh_30d", "prod_30d", "past_30d", "days_30d", "works"]
    stages = [Imputer(inputCols=inputs, outputCols=[f"{c}_full" for c in inputs], strategy="median"), VectorAssembler(inputCols=[f"{c}_full" for c in inputs], outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), LogisticRegression(weightCol="weight")]
    model = without_summary(Pipeline(stages=stages).fit(train.withColumns({c: F.col(c).cast("double") for c in inputs})))
    scored = model.transform(held_out.withColumns({c: F.col(c).cast("double") for c in inputs}))
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(scored)
    return model, days.sparkSession.createDataFrame([(train.count(), held_out.count(), auc)], "train_rows long, held_out_rows long, auc double")
