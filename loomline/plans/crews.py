"""Crews: a roster's members as sorted names, compositions as a key, their figures by task; features of a job beside its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, safe_divide
from ..functions.vocabulary import MINUTE_US
from . import gold_sql as S
from .bindings import bound
from .catalog import fact, query

#: Rows that a leader, and a composition, needs for a task to be shown.
LEADER_ROWS, CREW_ROWS = 20, 10
UNKNOWN = "UNKNOWN"


def members(roster: Column, ordered: bool = True) -> Column:
    """The names of a roster (a JSON array), trimmed, each once, in their own order or sorted; NULL and other text have none."""
    names = F.coalesce(F.from_json(roster, "array<string>"), F.array().cast("array<string>"))
    kept = F.array_distinct(F.array_compact(F.transform(names, clean_text)))
    return F.array_sort(kept) if ordered else kept


def composition(leader: Column, names: Column) -> Column:
    """``leader + a, b``; the leader alone without members, NULL without anyone."""
    head, rest = clean_text(leader), F.array_join(names, ", ")
    return F.when(F.size(names) > 0, F.concat_ws(" + ", head, rest)).otherwise(head)


def with_crew(rows: DataFrame, leader: str = "leader", roster: str = "roster") -> DataFrame:
    """Adds ``members`` (sorted, so that a crew is one whatever order it was written in), ``composition`` and ``crew_size``; the leader is no member."""
    names = F.array_remove(members(F.col(roster)), F.coalesce(clean_text(F.col(leader)), F.lit("")))
    out = rows.withColumn("members", names).withColumn("composition", composition(F.col(leader), F.col("members")))
    size = F.size("members") + clean_text(F.col(leader)).isNotNull().cast("int")
    return out.withColumn("crew_size", F.when(size > 0, size))


def crew_figures(rows: DataFrame, who: str, least: int) -> DataFrame:
    """Mean, median, count, sum and largest energy per piece by ``who`` and task, where there are ``least`` rows with both energy and pieces."""
    kpu = safe_divide(F.col("energy_kwh"), F.col("good_qty"))
    some = rows.withColumn("kpu", kpu).filter(F.col(who).isNotNull() & F.col("task").isNotNull() & F.col("kpu").isNotNull())
    return some.groupBy(who, "task").agg(F.avg("kpu").alias("mean_kpu"), F.median("kpu").alias("median_kpu"), F.count("*").alias("n_rows"), F.sum("good_qty").alias("good"), F.max("kpu").alias("most_kpu")).filter(F.col("n_rows") >= least)


def crews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with a roster for each job: who it lists goes by the job's order, in an order that varies."""
    roster = F.when(F.col("order_id").cast("int") % 4 == 0, F.lit('["M1", " "]')).when(F.col("order_id").cast("int") % 4 == 1, F.when(F.col("hour_us") / 3_600_000_000 % 2 == 0, '["M2","M1"]').otherwise('["M1","M2"," M2"]')).when(F.col("order_id").cast("int") % 4 == 2, F.concat(F.lit('["'), "leader", F.lit('"]'))).otherwise(F.lit(None))
    return with_crew(fact(spark, sf_dir).withColumn("roster", roster))


_CREW = "crew AS MATERIALIZED (SELECT *, CASE WHEN cast(order_id AS integer) % 4 = 0 THEN leader || ' + M1' WHEN cast(order_id AS integer) % 4 = 1 THEN leader || ' + M1, M2' ELSE leader END AS composition, CASE WHEN leader IS NULL THEN NULL WHEN cast(order_id AS integer) % 4 = 0 THEN 2 WHEN cast(order_id AS integer) % 4 = 1 THEN 3 ELSE 1 END AS crew_size, CASE WHEN good_qty > 0 THEN energy_kwh / good_qty END AS kpu FROM fact)"
_FIGURES = "avg(kpu) AS mean_kpu, median(kpu) AS median_kpu, count(kpu) AS n_rows, sum(good_qty) AS good, max(kpu) AS most_kpu"


@query(f"SELECT 'composition' AS kind, composition AS who, task, {_FIGURES} FROM crew WHERE kpu IS NOT NULL AND composition IS NOT NULL AND task IS NOT NULL GROUP BY composition, task HAVING count(*) >= 10 UNION ALL SELECT 'leader', leader, task, {_FIGURES} FROM crew WHERE kpu IS NOT NULL AND leader IS NOT NULL AND task IS NOT NULL GROUP BY leader, task HAVING count(*) >= 20", S.FACT + ",\n" + _CREW, "mean_kpu median_kpu good most_kpu")
def crew_task_figures(spark, sf_dir):
    """Energy per piece by task, of whole crews (from ten rows on) beside that of leaders (from twenty)."""
    rows = crews(spark, sf_dir)
    parts = [crew_figures(rows, who, least).select(F.lit(kind).alias("kind"), F.col(who).alias("who"), "task", "mean_kpu", "median_kpu", "n_rows", "good", "most_kpu") for kind, who, least in (("composition", "composition", CREW_ROWS), ("leader", "leader", LEADER_ROWS))]
    return parts[0].unionByName(parts[1])


@query("SELECT composition, task, count(*) AS n_rows, median(crew_size) AS crew_size, median(team_size) AS reported_size FROM crew WHERE composition IS NOT NULL AND task IS NOT NULL GROUP BY ALL", S.FACT + ",\n" + _CREW, "crew_size reported_size")
def crew_sizes_by_task(spark, sf_dir):
    """Rows and median size of each composition by task, by its roster and by reports."""
    rows = crews(spark, sf_dir).filter("composition is not null and task is not null")
    return rows.groupBy("composition", "task").agg(F.count("*").alias("n_rows"), F.median("crew_size").alias("crew_size"), F.median("team_size").alias("reported_size"))


def job_features(jobs: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Features of each job beside its newest report: material, task, setup minutes, speed, status, quantities, production hours.

    ``jobs`` has setup_start_us and prep_end_us; what neither side knows is ``UNKNOWN`` or 0.
    """
    newest = reports.groupBy(*keys).agg(F.max_by(F.struct("material", "task", "status", "required_qty", "cumulative_qty"), F.struct("report_us", "hash")).alias("r"))
    rows = jobs.join(newest, keys, "left")
    both = lambda c: F.coalesce(clean_text(F.col(c)), clean_text(F.col(f"r.{c}")), F.lit(UNKNOWN)).alias(c)
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    setup = F.when(F.col("prep_end_us") > F.col("setup_start_us"), (F.col("prep_end_us") - F.col("setup_start_us")) / MINUTE_US)
    return rows.select(*keys, "hash", both("material"), F.coalesce(clean_text(F.col("r.task")), F.lit(UNKNOWN)).alias("task_type"), zero(setup).alias("setup_minutes"), "speed", F.coalesce(clean_text(F.col("r.status")), F.lit(UNKNOWN)).alias("report_status"), zero(F.col("r.required_qty")).alias("planned_qty"), zero(F.col("r.cumulative_qty")).alias("cumulative_qty"), zero(F.col("prod_min") / 60).alias("production_hours"), zero(F.col("job_scrap")).alias("reported_defects"))


_NEWEST = "SELECT machine, order_id, suffix, max_by(CASE WHEN cast(manpower AS bigint) = 0 THEN '' ELSE 'T' || cast(manpower AS bigint) END, (report_us, hash)) AS task, max_by(manpower * 10, (report_us, hash)) AS required_qty FROM reports GROUP BY ALL"


@query(f"SELECT j.hash, j.material, coalesce(nullif(n.task, ''), 'UNKNOWN') AS task_type, cast(changeover AS double) AS setup_minutes, coalesce(n.required_qty, 0) AS planned_qty, coalesce(prod_min, 0) / 60 AS production_hours, coalesce(job_scrap, 0) AS reported_defects, CASE WHEN prod_min > 0 THEN job_good / prod_min * 60 END AS speed FROM jobs j LEFT JOIN ({_NEWEST}) n ON n.machine = j.machine AND n.order_id = j.order_id AND n.suffix = j.suffix", S.DUCK, "setup_minutes planned_qty production_hours reported_defects speed")
def job_feature_rows(spark, sf_dir):
    """Features of every job beside the newest report of its machine, order and suffix."""
    b = bound(spark, sf_dir)
    jobs = b["jobs"].withColumn("setup_start_us", F.col("prep_end_us") - F.col("changeover").cast("bigint") * MINUTE_US).withColumn("speed", safe_divide(F.col("job_good"), F.col("prod_min")) * 60)
    task = F.when(F.col("manpower") == 0, "").otherwise(F.concat(F.lit("T"), F.col("manpower").cast("bigint")))
    reports = b["reports"].select("machine", "order_id", "suffix", "report_us", "hash", F.lit("").alias("material"), task.alias("task"), F.lit(None).cast("string").alias("status"), (F.col("manpower") * 10).alias("required_qty"), F.lit(None).cast("double").alias("cumulative_qty"))
    return job_features(jobs, reports, ["machine", "order_id", "suffix"]).select("hash", "material", "task_type", "setup_minutes", "planned_qty", "production_hours", "reported_defects", "speed")
