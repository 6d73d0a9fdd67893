"""The fact for one month: inputs partitioned by period, a run that reads only what that period needs, a resumable sweep.

A job is stored under each period that it touches, so a period's jobs are one partition however long a job
is. A job over the border also needs the hours that it leads on the other side, for its pieces are shared out over all of them:
these border hours are few, are written as a small table, and name the only other partitions that are read. So the rows of a period equal those of the run over all periods.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from time import monotonic

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import order_suffix
from ..functions.vocabulary import HOUR_US
from ..operators.timeops import hour_of
from ..scratch import once
from ..sources.sinks import keep_latest, replace_months
from .gold import KEY, backbone, dominant_job, job_overlaps, prepared_jobs, with_idle, with_jobs, with_maintenance, with_quantity, with_reports, with_state_review

#: Where rows without a stamp are kept; no run reads them.
UNDATED = "undated"
TABLES = ("meters", "jobs", "reports", "works")


def period_of(us: Column, unit: str) -> Column:
    """``2024-01`` or, for weeks, ``2024-W03``; both sort as time does."""
    ts = F.timestamp_micros(us)
    if unit == "month":
        return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(UNDATED))
    if unit == "week":
        return F.coalesce(F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")), F.lit(UNDATED))
    raise ValueError(f"unknown period {unit}")


def touched_periods(start: Column, end: Column, unit: str) -> Column:
    """The periods of [start, end), ascending; that of the start when the end is not after it."""
    first, last = F.timestamp_micros(start), F.timestamp_micros(F.greatest(end - 1, start))
    step = F.expr("interval 1 month") if unit == "month" else F.expr("interval 7 days")
    days = F.sequence(F.date_trunc(unit, first), F.date_trunc(unit, last), step)
    return F.transform(days, lambda d: period_of(F.unix_micros(d), unit))


@dataclass(frozen=True)
class PeriodStore:
    """Input tables of the fact in a folder, partitioned by ``period``."""

    spark: SparkSession
    root: str
    unit: str = "month"

    def put(self, meters: DataFrame, jobs: DataFrame, reports: DataFrame, works: DataFrame) -> None:
        """Replace the periods that the rows are of; others stay."""
        at = {"meters": "hour_us", "reports": "report_us", "works": "txn_us"}
        for name, rows in (("meters", meters), ("reports", reports), ("works", works)):
            replace_months(rows.withColumn("period", period_of(F.col(at[name]), self.unit)), f"{self.root}/{name}", "period")
        dated = prepared_jobs(jobs)
        periods = F.when(F.col("window_start").isNull() | F.col("window_end").isNull(), F.array(F.lit(UNDATED))).otherwise(touched_periods(F.col("window_start"), F.col("window_end"), self.unit))
        spread = dated.withColumn("periods", periods).drop("setup_us", "from_us").withColumn("period", F.explode("periods"))
        replace_months(spread, f"{self.root}/jobs", "period")

    def table(self, name: str) -> DataFrame:
        """A table with ``period`` as text."""
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        path = f"{self.root}/{name}"
        found = self.spark.read.parquet(path).schema
        text = ", ".join(f"`{f.name}` {'string' if f.name == 'period' else f.dataType.simpleString()}" for f in found)
        return self.spark.read.schema(text).parquet(path)

    def periods(self) -> DataFrame:
        """The periods that have hours, from the folder's partitions alone."""
        return self.table("meters").select("period").filter(F.col("period") != UNDATED).distinct()


def border_hours(jobs: DataFrame, period: str, unit: str) -> DataFrame:
    """(period, machine, hour_us) of other periods that jobs of ``period`` touch."""
    over = jobs.filter(F.size("periods") > 1)
    hours = F.sequence(hour_of(F.col("window_start")), hour_of(F.col("window_end") - 1), F.lit(HOUR_US))
    spread = over.filter("window_end > window_start").select("machine", F.explode(hours).alias("hour_us")).distinct()
    return spread.select(period_of(F.col("hour_us"), unit).alias("period"), *KEY).filter(F.col("period") != period)


def border_inputs(store: PeriodStore, border: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hours that ``border`` names and that have a meter, and the jobs of their machines there; only the named periods are read.

    ``border`` is written already; the periods that it names go to the driver, a few as jobs are hours or days long.
    """
    named = [r["period"] for r in border.select("period").distinct().collect()]
    of = lambda name: store.table(name).filter(F.col("period").isin(named))
    hours = of("meters").join(border, ["period", *KEY], "left_semi").select(*KEY).distinct()
    return hours, of("jobs").join(border.select("period", "machine").distinct(), ["period", "machine"], "left_semi")


def period_plan(store: PeriodStore, period: str) -> DataFrame:
    """The fact's rows of one period.

    Meters and reports are read from its partition, jobs from its partition and, for hours over the border, from those that
    the border hours name; maintenance from its partition and earlier ones. A period without hours gives no rows. Hours and jobs
    are written once, as several overlays read them.
    """
    of = lambda name: store.table(name).filter(F.col("period") == period)
    own_meters, own_jobs = of("meters").drop("period"), of("jobs")
    over, rivals = border_inputs(store, once(border_hours(own_jobs, period, store.unit), "border"))
    usable = (F.coalesce(F.trim("machine"), F.lit("")) != "") & F.col("hour_us").isNotNull()
    keys = own_meters.filter(usable).select(*KEY).distinct()
    hours = once(keys.withColumn("own", F.lit(True)).unionByName(over.withColumn("own", F.lit(False))), "hours")
    columns = [c for c in own_jobs.columns if c not in ("period", "periods", "window_start", "window_end")]
    own, others = own_jobs.select(columns), rivals.select(columns)
    jobs = once(own.unionByName(others.join(own.select("hash"), "hash", "left_anti").dropDuplicates(["hash"]).select(columns)), "jobs")
    own_hours = hours.filter("own").select(*KEY)
    rows = backbone(own_meters).withColumn("_own", F.lit(True)).unionByName(hours.filter("not own").select(*KEY, F.lit(False).alias("_own")), allowMissingColumns=True)
    fact = with_quantity(with_jobs(rows, jobs, hours.select(*KEY))).filter("_own").drop("_own")
    ordered = dominant_job(job_overlaps(own_hours, jobs)).select(*KEY, "order_id", order_suffix(F.col("suffix")).alias("order_suffix"))
    works = store.table("works").filter(F.col("period") <= period).drop("period")
    return with_state_review(with_idle(with_maintenance(with_reports(fact, of("reports").drop("period"), ordered), works, own_hours)))


def land(store: PeriodStore, period: str, target: str) -> None:
    """Write one period's rows in place of those that ``target`` has of it; other periods keep their files."""
    replace_months(period_plan(store, period).withColumn("period", F.lit(period)), target, "period")


_EVENTS = "period string, run string, state string, error string, seconds double, at timestamp, number bigint"


class Sweep:
    """A work table of periods in a shared folder: each event (claimed, done, failed) is a row that is only ever added.

    One sweep runs at a time. What was claimed and not ended (the driver was lost) counts as not done and is taken up again, as a period's
    rows replace each other.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._schema = spark.createDataFrame([], _EVENTS).schema
        self._lock = threading.Lock()
        self._note([])

    def _note(self, rows: list[tuple]) -> None:
        """Add events; the number orders them, whatever the clocks say."""
        with self._lock:
            self._add(rows)

    def _add(self, rows: list[tuple]) -> None:
        before = self.spark.read.schema(self._schema).parquet(self.path).agg(F.max("number")).first()[0] or 0 if rows else 0
        fresh = self.spark.createDataFrame([(*r, before + 1 + i) for i, r in enumerate(rows)], "period string, run string, state string, error string, seconds double, number bigint")
        fresh.withColumn("at", F.current_timestamp()).select(self._schema.names).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def states(self) -> DataFrame:
        """The last event of each period, and how often it was tried."""
        tries = self.events().groupBy("period").agg(F.count_if(F.col("state") == "claimed").alias("tries"))
        return keep_latest(self.events(), ["period"], ["number"]).join(tries, "period").select("period", "state", "tries", "run", "error", "seconds")

    def pending(self, wanted: DataFrame, failed: bool = True) -> DataFrame:
        """Wanted periods that are not done, with ``failed`` those that failed too."""
        settled = self.states().filter(F.col("state").isin("done", *([] if failed else ["failed"])))
        return wanted.select("period").distinct().join(settled.select("period"), "period", "left_anti")

    def run(self, wanted: DataFrame, work: Callable[[str], object], run: str, failed: bool = True, at_once: int = 1) -> dict[str, str]:
        """Do each pending period by itself, ascending, up to ``at_once`` at a time; one that fails does not stop the others. Its state, by period."""
        periods = sorted(r["period"] for r in self.pending(wanted, failed).collect())

        def one(period: str) -> str:
            self._note([(period, run, "claimed", None, None)])
            began, state, error = monotonic(), "done", None
            try:
                work(period)
            except Exception as problem:  # a period's failure is its result
                state, error = "failed", str(problem)
            self._note([(period, run, state, error, monotonic() - began)])
            return state

        if at_once == 1:
            return {p: one(p) for p in periods}
        with ThreadPoolExecutor(at_once) as pool:
            return dict(zip(periods, pool.map(one, periods), strict=True))

    def report(self, wanted: DataFrame) -> dict[str, object]:
        """``success``, ``partial_error`` or ``error``, with the periods of each state; ``error`` too when nothing is wanted."""
        rows = {r["period"]: r for r in self.states().join(wanted.select("period").distinct(), "period", "left_semi").collect()}
        done = sorted(p for p, r in rows.items() if r["state"] == "done")
        bad = {p: r["error"] for p, r in sorted(rows.items()) if r["state"] == "failed"}
        status = "success" if done and not bad else "partial_error" if done else "error"
        return {"status": status, "done": done, "failed": bad}
