"""Retraining: candidates saved and loaded again, compared with the active model on the same rows, promoted by a pointer.

Models are folders; which one is active is a commit of ``Versions``, so a promotion is one small write, the model before stays as it was and
can be taken back. Whatever goes wrong before leaves the active model in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import once, scratch_path
from ..sources.versions import Versions
from . import models
from .catalog import inputs, query
from .serving import MOST, log_training, predict_rows, promotion_gate

#: The pointer's name, and the least rows to train on and to judge on.
ACTIVE, LEAST_TRAIN, LEAST_JUDGED = "efficiency", 50, 10


def side_by_side(rows: DataFrame, fitted: Mapping[str, PipelineModel]) -> DataFrame:
    """The rows with a prediction column for each model (``p_<name>``), in one plan."""
    out = rows
    for name, model in fitted.items():
        out = model.transform(out).select(*[f"`{c}`" for c in out.columns], F.col("prediction").alias(f"p_{name}"))
    return out


def figures(rows: DataFrame, fitted: Mapping[str, PipelineModel], label: str = "label") -> dict[str, dict[str, float]]:
    """r2, mae and rmse of each model over the same rows, in one pass."""
    y = F.col(label)
    scored = side_by_side(rows, fitted)
    gap = {n: y - F.col(f"p_{n}") for n in fitted}
    sums = [c for n, g in gap.items() for c in (F.avg(F.abs(g)).alias(f"{n}_mae"), F.avg(g * g).alias(f"{n}_mse"))]
    r = scored.agg(F.var_pop(y).alias("spread"), *sums).first()
    r2 = lambda mse: 1 - mse / r["spread"] if r["spread"] else float("-inf")
    return {n: {"r2": r2(r[f"{n}_mse"]), "mae": r[f"{n}_mae"], "rmse": r[f"{n}_mse"] ** 0.5} for n in fitted if r[f"{n}_mse"] is not None}


def load(path: str | None) -> PipelineModel | None:
    """A saved model; None if there is none or it cannot be loaded."""
    if path is None:
        return None
    try:
        return PipelineModel.load(path)
    except Exception:  # whatever is wrong with the folder, there is no model to use
        return None


def active_model(store: Versions) -> PipelineModel | None:
    return load(store.head()[1].get(ACTIVE))


def features_of(model: PipelineModel) -> list[str]:
    """The columns that a fitted pipeline assembles."""
    return [c for stage in model.stages if stage.hasParam("inputCols") and stage.hasParam("outputCol") for c in stage.getInputCols()]


@dataclass(frozen=True)
class Decision:
    """What became of a candidate: ``promoted``, ``refused`` with the checks that failed, or ``blocked`` before training."""

    state: str
    reasons: tuple[str, ...] = ()
    model: str | None = None
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    commit: int | None = None


def judged(store: Versions, path: str, name: str, train_features: Sequence[str], held_out: DataFrame, run: str) -> Decision:
    """Judge the candidate saved at ``path`` against the active model on ``held_out`` and promote it if every check holds."""
    candidate, active = load(path), active_model(store)
    if candidate is None:
        return Decision("refused", ("candidate_not_loadable",), name)
    fitted = {"candidate": candidate} | ({"active": active} if active is not None else {})
    found = figures(held_out, fitted)
    first = side_by_side(held_out.orderBy("hour_us", "machine").limit(1), {"candidate": candidate}).first()
    checks = promotion_gate(found.get("candidate", {}), found.get("active"), features_of(candidate), train_features, None if first is None else first["p_candidate"], MOST)
    if not checks["promote"]:
        return Decision("refused", tuple(k for k, ok in checks.items() if not ok and k != "promote"), name, found)
    return Decision("promoted", (), name, found, store.publish({ACTIVE: path}, run, f"promoted {name}"))


def retrain(store: Versions, ready: DataFrame, run: str, least_train: int = LEAST_TRAIN, least_judged: int = LEAST_JUDGED) -> Decision:
    """Fit candidates on the earlier part of the readiness inputs, save the best, and judge it as it was saved.

    Too few rows on either side block the run. Every run that trains adds a row for each candidate to the log of trainings.
    """
    rows = once(models.training_rows(ready), "training")
    train, held_out = models.time_split(rows)
    if train.count() < least_train or held_out.count() < least_judged:
        return Decision("blocked", ("too_few_rows",))
    candidates = models.fit_regressors(train)
    found = figures(held_out, candidates)
    log = store.spark.createDataFrame([(n, f["r2"], f["mae"], f["rmse"]) for n, f in sorted(found.items())], "model string, r2 double, mae double, rmse double")
    log_training(store.spark, f"{store.root}/trainings", run, log)
    best = max(sorted(found), key=lambda n: found[n]["r2"])
    path = f"{store.root}/models/{uuid.uuid4().hex}"
    candidates[best].write().save(path)
    return judged(store, path, best, features_of(candidates[best]), held_out, run)


def what_happened(decision: Decision) -> dict[str, object]:
    """A decision as a flat row for a log."""
    own = decision.metrics.get("candidate", {})
    return {"state": decision.state, "reasons": ",".join(decision.reasons), "model": decision.model, "r2": own.get("r2"), "active_r2": decision.metrics.get("active", {}).get("r2"), "commit": decision.commit}


@query(None)
def promoted_predictions(spark, sf_dir):
    """Eligible rows through the model that a retraining promoted and that was read back from its folder, with the guards."""
    rows = once(inputs(spark, sf_dir), "inputs")
    store = Versions(spark, scratch_path(spark, "models"))
    retrain(store, rows, "first")
    every = models.with_features(rows.filter("eligible = 1"))
    return predict_rows(active_model(store), every).select("machine", "hour_us", "predicted", "blocked_reason")
