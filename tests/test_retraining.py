"""Promotion, refusal and unloadable models on small inputs; the fitted line by family."""

from __future__ import annotations

import shutil

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from loomline.plans import retraining
from loomline.plans.rules import with_family_fit
from loomline.sources.versions import Versions


def rows(spark, slope=2.0):
    return spark.range(60).select(F.col("id").alias("hour_us"), F.lit("m").alias("machine"), (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 7) * slope + 1 + (F.col("id") % 3) * 0.01).alias("label"))


def fitted(df, column="x"):
    return Pipeline(stages=[VectorAssembler(inputCols=[column], outputCol="features"), LinearRegression()]).fit(df)


def saved(model, path):
    model.write().save(str(path))
    return str(path)


def test_a_better_model_takes_over_and_a_worse_one_does_not(spark, tmp_path):
    store, held = Versions(spark, str(tmp_path / "store")), rows(spark)
    assert retraining.active_model(store) is None
    first = retraining.judged(store, saved(fitted(rows(spark, 1.5)), tmp_path / "a"), "a", ["x"], held, "1")
    assert first.state == "promoted" and set(first.metrics) == {"candidate"}
    better = retraining.judged(store, saved(fitted(rows(spark)), tmp_path / "b"), "b", ["x"], held, "2")
    assert better.state == "promoted" and better.metrics["candidate"]["r2"] > better.metrics["active"]["r2"]
    worse = retraining.judged(store, saved(fitted(rows(spark, -1.0)), tmp_path / "c"), "c", ["x"], held, "3")
    assert worse.state == "refused" and "not_worse" in worse.reasons and store.head() == (2, {"efficiency": str(tmp_path / "b")})
    assert retraining.active_model(store).transform(held.limit(1)).first().prediction == pytest.approx(1.0, abs=0.05)
    store.roll_back(1, "back")
    assert store.head()[1] == {"efficiency": str(tmp_path / "a")}


def test_candidates_that_cannot_serve_are_refused(spark, tmp_path):
    store, held = Versions(spark, str(tmp_path / "store")), rows(spark)
    path = saved(fitted(held), tmp_path / "a")
    assert retraining.judged(store, path, "a", ["x", "y"], held, "1").reasons == ("feature_contract",)
    shutil.rmtree(tmp_path / "a" / "stages")
    assert retraining.judged(store, path, "a", ["x"], held, "1").reasons == ("candidate_not_loadable",)
    odd = saved(fitted(held.withColumn("label", F.col("label") + 90)), tmp_path / "b")
    assert "smoke_prediction" in retraining.judged(store, odd, "b", ["x"], held, "2").reasons
    assert store.head() == (0, {})


def test_an_active_model_that_is_gone_does_not_block(spark, tmp_path):
    store, held = Versions(spark, str(tmp_path / "store")), rows(spark)
    store.publish({"efficiency": str(tmp_path / "lost")}, "1")
    assert retraining.active_model(store) is None
    assert retraining.judged(store, saved(fitted(held), tmp_path / "a"), "a", ["x"], held, "2").state == "promoted"


def inputs(spark, n):
    base = spark.range(n).withColumn("good_qty", (F.col("id") % 9 + 2).cast("double"))
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") / 6).cast("int"))
    return base.select((F.col("id") * 3_600_000_000).alias("hour_us"), F.lit("024-001").alias("machine"), F.lit("024").alias("family"), F.lit("m").alias("material"), F.lit("l").alias("leader"), F.lit("Hard").alias("difficulty"), F.lit("PM").alias("last_work_type"), "good_qty", (F.col("good_qty") * 2 + 3).alias("energy_kwh"), F.lit(2.0).alias("team_size"), (F.col("id") % 50).cast("double").alias("hours_since"), (F.col("id") % 4).alias("works_30d"), F.lit(3).alias("works_ever"), (F.col("id") % 24).alias("hour"), day.alias("day"), F.date_format(day, "yyyy-MM").alias("month_key"), F.lit(1).alias("eligible"))


def test_a_whole_retraining(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    assert retraining.retrain(store, inputs(spark, 20), "0").reasons == ("too_few_rows",)
    got = retraining.retrain(store, inputs(spark, 300), "1")
    assert got.state == "promoted" and got.metrics["candidate"]["r2"] > 0.5
    assert retraining.what_happened(got)["commit"] == 1
    log = spark.read.parquet(f"{store.root}/trainings").collect()
    assert sorted((r.run, r.model) for r in log) == [("1", "boosted"), ("1", "forest"), ("1", "linear")]
    assert retraining.active_model(store) is not None


def test_the_line_of_a_family(spark):
    data = [("f", h, 10.0 + h, 2.0 * (10 + h) ** 2, 1) for h in range(8)] + [("f", 9, 5.0, 1.0, 1), ("f", 10, 5.0, 1.0, 0), ("g", 1, 4.0, 8.0, 1), ("h", 10, 4.0, 8.0, 1)]
    df = spark.createDataFrame(data, "family string, hour_us long, good_qty double, energy_kwh double, eligible int").withColumn("energy_kwh", F.col("energy_kwh") / 10)
    got = {(r.family, r.hour_us): r.fit for r in with_family_fit(df).collect()}
    assert got["f", 9] == pytest.approx(0.2 * 5.0) and got["g", 1] == pytest.approx(0.2) and got["h", 10] is None and ("f", 10) not in got
