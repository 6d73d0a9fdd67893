"""A run in named stages: seconds, rows and nulls of each stage from the job itself, and a limit that cancels a stage's jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from time import monotonic

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path

_REPORT = "number int, stage string, state string, seconds double, slow boolean, n_rows bigint, filled map<string,bigint>, error string"


@dataclass(frozen=True)
class Stage:
    """A stage takes what the one before wrote (the first one the input) and gives rows; ``watch`` names columns whose values are counted."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    watch: Sequence[str] = ()


@dataclass(frozen=True)
class StagedResult:
    """The last stage's rows, if all were done, and a row for each stage."""

    rows: DataFrame | None
    report: DataFrame
    state: str


def run_stages(spark: SparkSession, start: DataFrame, stages: Sequence[Stage], limit: float | None = None, warn: float | None = None, notify: Callable[[dict[str, object]], None] | None = None) -> StagedResult:
    """Run the stages one after the other; each is written to the shared folder and read again.

    A stage that takes more than ``limit`` seconds is cancelled with all jobs that it started (they carry a tag of their own), and
    later stages do not run; so it is when one fails. Over ``warn`` seconds a stage is marked slow. Rows and values are counted
    while a stage is written. ``notify`` gets an event at each stage's start and end. States: done, timed_out, failed, skipped.
    """
    context = spark.sparkContext
    rows, state, report = start, "done", []
    tell = notify or (lambda event: None)
    for number, stage in enumerate(stages, 1):
        if state != "done":
            report.append((number, stage.name, "skipped", None, None, None, None, None))
            continue
        tell({"event": "stage_start", "stage": stage.name})
        tag, expired = f"stage-{uuid.uuid4().hex}", threading.Event()

        def stop(tag: str = tag, expired: threading.Event = expired) -> None:
            expired.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(limit, stop) if limit is not None else None
        seen, path, began, error, counts = Observation(stage.name), scratch_path(spark, "stage"), monotonic(), None, None
        context.addJobTag(tag)
        try:
            if timer:
                timer.start()
            out = stage.work(rows)
            out.observe(seen, F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in stage.watch]).write.parquet(path)
            counts = dict(seen.get)
            rows = spark.read.schema(out.schema).parquet(path)
        except Exception as problem:
            error = str(problem).splitlines()[0] if str(problem) else type(problem).__name__
        finally:
            if timer:
                timer.cancel()
            context.removeJobTag(tag)
        seconds = monotonic() - began
        state = "timed_out" if expired.is_set() or (limit is not None and seconds > limit) else "failed" if error else "done"
        done = counts if state == "done" else None
        report.append((number, stage.name, state, seconds, warn is not None and seconds > warn, done and done["_rows"], done and {k: v for k, v in done.items() if k != "_rows"}, error if state != "timed_out" else f"more than {limit} seconds"))
        tell({"event": "stage_end", "stage": stage.name, "state": state, "seconds": seconds})
    return StagedResult(rows if state == "done" else None, spark.createDataFrame(report, _REPORT), state)
