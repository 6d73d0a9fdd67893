"""Scheduling prototype: a bounded queue, candidates scored against machines of the family, greedy slots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import safe_divide


def machine_profiles(inputs: DataFrame) -> DataFrame:
    """Per machine: typical energy per piece, hours since maintenance of its latest row, support."""
    ok = inputs.filter("eligible = 1")
    latest = F.max_by("hours_since", "hour_us")
    return ok.groupBy("machine", "family").agg(safe_divide(F.sum("energy_kwh"), F.sum("good_qty")).alias("kwh_per_good"), latest.alias("hours_since"), F.count("*").alias("support"))


def job_queue(inputs: DataFrame, size: int = 24) -> DataFrame:
    """The ``size`` commonest kinds of job, with quantity in steps of 25 and urgency by the quantity's place."""
    kinds = inputs.filter("eligible = 1").groupBy("family", "material", "task", "difficulty").agg(F.median("good_qty").alias("qty"), F.count("*").alias("seen"))
    top = kinds.orderBy(F.desc("seen"), "family", "material", "task").limit(size)
    step = F.greatest(F.lit(25.0), F.bround(F.col("qty") / 25) * 25)
    return top.withColumn("quantity", step).withColumn("job", F.concat_ws("/", "family", "material", "task")).drop("qty")


def with_urgency(queue: DataFrame) -> DataFrame:
    """High from the third quartile of the queue's quantities on, medium from the 35th percentile on."""
    edges = queue.agg(F.percentile("quantity", F.lit(0.75)).alias("p75"), F.percentile("quantity", F.lit(0.35)).alias("p35"))
    urgency = F.when(F.col("quantity") >= F.col("p75"), "High").when(F.col("quantity") >= F.col("p35"), "Medium").otherwise("Low")
    return queue.crossJoin(F.broadcast(edges)).withColumn("urgency", urgency).drop("p75", "p35")


def support(inputs: DataFrame) -> dict[str, DataFrame]:
    """Rows with pieces by (machine, material, task), (machine, material) and (machine, difficulty)."""
    rows = inputs.filter("good_qty > 0")
    count = lambda df, keys, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return {
        "joint": count(rows, ["machine", "material", "task"], "joint"),
        "by_material": count(rows, ["machine", "material"], "by_material"),
        "by_difficulty": count(rows.filter("difficulty is not null"), ["machine", "difficulty"], "by_difficulty"),
    }


def candidates(queue: DataFrame, profiles: DataFrame, history: dict[str, DataFrame], context: DataFrame) -> DataFrame:
    """Each job on each machine of its family, in a first slot: energy cost, penalties and why it may not be.

    The energy is that of the machine's history. ``profiles`` have the maintenance evidence; ``context`` is one row.
    """
    pairs = queue.join(profiles, "family")
    pairs = pairs.join(history["joint"], ["machine", "material", "task"], "left").join(history["by_material"], ["machine", "material"], "left").join(history["by_difficulty"], ["machine", "difficulty"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    tiers = list(V.SUPPORT_TIERS)
    tier = F.when(has("joint"), tiers[0]).when(has("by_material") & has("by_difficulty"), tiers[1]).when(has("by_material"), tiers[2]).when(has("by_difficulty"), tiers[3]).otherwise(tiers[4])
    known, late, changeover = F.col("total_events").isNotNull(), F.col("hours_since") >= 3000, F.col("changeover")
    risk = F.least(F.col("days_since") / 120.0, F.lit(2.0)) * 0.35 + F.when(F.col("pm_ratio") < 0.10, 0.35).when(F.col("pm_ratio") < 0.30, 0.15).otherwise(0.0) + F.when(F.col("total_events") < 5, 0.10).otherwise(0.0)
    gap = F.when(F.col("hours_since").isNull(), 0.40).otherwise(F.least(F.col("hours_since") / 1800.0, F.lit(1.0)) * 0.30)
    blackout = F.when(known, (F.col("days_since") >= 180) & (F.col("pm_ratio") <= 0.05)).otherwise(F.coalesce(late, F.lit(False)))
    status = F.when(blackout, "Maintenance blackout").when(known, "Evidence-backed maintenance profile").otherwise("Maintenance evidence gap")
    share = F.element_at(F.create_map(*[F.lit(x) for kv in V.SUPPORT_TIERS.items() for x in kv]), F.col("tier"))
    out = pairs.crossJoin(F.broadcast(context)).withColumns({"tier": tier, "status": status})
    out = out.withColumns({
        "energy_cost": F.coalesce(F.col("kwh_per_good") * F.col("quantity") * F.col("price"), F.lit(0.0)),
        "maintenance_penalty": F.round(changeover * F.when(known, risk).when(late, 1.10).otherwise(gap), 4),
        "support_penalty": F.round(changeover * share, 4),
        "model_penalty": F.when(F.col("kwh_per_good").isNull(), changeover * 0.65).otherwise(0.0),
        "exclude_reason": F.when(F.col("status") == "Maintenance blackout", "maintenance_blackout"),
    })
    score = F.col("energy_cost") + F.col("maintenance_penalty") + F.col("support_penalty") + F.col("model_penalty")
    return out.select("job", "family", "material", "task", "difficulty", "urgency", "quantity", "machine", "tier", "status", "energy_cost", "maintenance_penalty", "support_penalty", "model_penalty", score.alias("score"), "exclude_reason", "changeover")


def top_candidates(scored: DataFrame, n: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("job").orderBy(F.round("score", 6), "machine"))
    return scored.withColumn("place", rank).filter(F.col("place") <= n)


def _slot_score(r, before: list[str]) -> float:
    """Score of a candidate after the materials ``before`` it: a changeover for another material, and the later the more for urgency."""
    change = r.changeover if before and before[-1] != r.material else 0.0
    return r.score + change + r.changeover * V.URGENCY[r.urgency] * len(before)


SCHEDULE = ["job", "machine", "slot", "quantity", "score"]


def assign(rows: pd.DataFrame, most_per_machine: int = 4, naive: bool = False) -> pd.DataFrame:
    """Jobs of one family, the urgent and large ones first, each to the machine that is best with what it has by then.

    A later slot costs a changeover if the material before it is another, and more the more urgent the job is. Ties go to
    the better history, then by machine. A job that no machine may take has none. ``naive`` takes jobs by name, each to the
    first machine by name that is free for it.
    """
    order = {"High": 0, "Medium": 1, "Low": 2}
    tiers = list(V.SUPPORT_TIERS)
    taken: dict[str, list[str]] = {}
    out = []
    for job, own in sorted(rows.groupby("job"), key=lambda x: (x[0],) if naive else (order[x[1]["urgency"].iloc[0]], -x[1]["quantity"].iloc[0], x[0])):
        best = None
        for r in own.itertuples():
            before = taken.get(r.machine, [])
            if len(before) >= most_per_machine or isinstance(r.exclude_reason, str):
                continue
            key = (r.machine,) if naive else (round(_slot_score(r, before), 4), tiers.index(r.tier), r.machine)
            if best is None or key < best[0]:
                best = (key, r, round(_slot_score(r, before), 4))
        if best is None:
            out.append((job, None, None, own["quantity"].iloc[0], None))
            continue
        taken.setdefault(best[1].machine, []).append(best[1].material)
        out.append((job, best[1].machine, float(len(taken[best[1].machine])), best[1].quantity, best[2]))
    return pd.DataFrame(out, columns=SCHEDULE)


def rescored(plan: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame | None:
    """The plan's jobs scored again in the order of their slots; None if one may not be where it is."""
    known = {(r.job, r.machine): r for r in rows.itertuples()}
    before: dict[str, list[str]] = {}
    out = []
    for p in plan[plan["machine"].notna()].sort_values(["slot", "machine", "job"]).itertuples():
        r = known.get((p.job, p.machine))
        if r is None or isinstance(r.exclude_reason, str):
            return None
        out.append((p.job, p.machine, p.slot, p.quantity, round(_slot_score(r, before.get(p.machine, [])), 4)))
        before.setdefault(p.machine, []).append(r.material)
    return pd.concat([pd.DataFrame(out, columns=SCHEDULE), plan[plan["machine"].isna()]], ignore_index=True) if out else plan


def best_swap(plan: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The plan after the one exchange of two jobs' machines and slots that lowers the sum of scores most, if any does."""
    best, least = plan, plan["score"].sum() - 1e-9
    placed = plan.index[plan["machine"].notna()]
    for n, i in enumerate(placed):
        for j in placed[n + 1 :]:
            if plan.at[i, "machine"] == plan.at[j, "machine"]:
                continue
            other = plan.copy()
            other.loc[[i, j], ["machine", "slot"]] = plan.loc[[j, i], ["machine", "slot"]].to_numpy()
            again = rescored(other, rows)
            if again is not None and again["score"].sum() < least:
                best, least = again, again["score"].sum() - 1e-9
    return best


_SCHEMA = "job string, machine string, slot double, quantity double, score double"


def greedy(scored: DataFrame, swap: bool = False, naive: bool = False) -> DataFrame:
    """``assign`` for each family, with the best swap if asked. The queue is bounded by its size, so a family is a few dozen rows."""

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        out = assign(rows, naive=naive)
        return best_swap(out, rows) if swap else out

    return scored.groupBy("family").applyInPandas(plan, _SCHEMA)


def material_sequence(pending: pd.DataFrame, costs: dict[tuple[str, str], float], now: str | None = None, default: float = 5.0) -> pd.DataFrame:
    """Pending jobs with their ``place``: after each the one whose material is cheapest to change to, the first of equals.

    A change that ``costs`` does not know costs ``default``, no change nothing; before any material all are equal.
    """
    left, order = list(pending.index), []
    while left:
        change = lambda i: 0.0 if now is None else costs.get((now, pending.at[i, "material"]), default if pending.at[i, "material"] != now else 0.0)  # noqa: B023, E731
        nxt = min(left, key=change)
        left.remove(nxt)
        order.append(nxt)
        now = pending.at[nxt, "material"]
    return pending.loc[order].assign(place=range(1, len(order) + 1))


def sequenced(queue: DataFrame, transitions: DataFrame) -> DataFrame:
    """``material_sequence`` of each family's jobs in the order of their names; ``transitions`` (previous, material, cost) are of the queue's materials."""
    after = queue.select(F.col("family").alias("of_family"), "material").distinct()
    before = after.select(F.col("of_family").alias("_of"), F.col("material").alias("previous"))
    known = transitions.join(after, "material").join(before, "previous").filter("of_family = _of").select("of_family", "previous", "material", "cost")

    def order(key: tuple, jobs: pd.DataFrame, costs: pd.DataFrame) -> pd.DataFrame:
        table = {(c.previous, c.material): c.cost for c in costs.itertuples()}
        return material_sequence(jobs.sort_values("job"), table)[["family", "job", "material", "place"]]

    return queue.groupBy("family").cogroup(known.groupBy("of_family")).applyInPandas(order, "family string, job string, material string, place long")
