"""Months: labels and bounds, membership, re-dating, runs, backfill month by month, and checks before a replacement."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, state_label
from ..scratch import once
from . import gold_sql as S
from . import readers as R
from .bindings import bound
from .catalog import _SHADOW, _quantity, fact, query
from .gold import backbone, quantity_shadow


# ---- columns ----
def month_start(label: Column) -> Column:
    """First day of a month label such as ``June 2025``; NULL for other text."""
    return F.to_date(F.try_to_timestamp(F.trim(label), F.lit("MMMM yyyy")))


def month_end(label: Column) -> Column:
    """First day of the month after, which is not in it any more."""
    return F.add_months(month_start(label), 1)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMMM yyyy")


def first_month(*stamps: Column) -> Column:
    """Year and month of the first stamp that is not NULL, whatever month the others are in."""
    return F.substring(F.coalesce(*[s.cast("string") for s in stamps]), 1, 7)


def order_suffix_any(c: Column) -> Column:
    """Any text that ends in ``.0`` without it, unlike ``order_suffix``, which asks for digits before."""
    return F.regexp_replace(clean_text(c), r"\.0$", "")


def moved_to_month(ts: Column, start: Column) -> Column:
    """The stamp, to the second, as many days after ``start`` as after its own month's first; may run into the month after."""
    return F.timestamp_add("SECOND", F.unix_seconds(ts) - F.unix_seconds(F.date_trunc("month", ts)), start.cast("timestamp"))


def asset_machine(asset: Column, old: Column) -> Column:
    """``1024-00094`` is ``024-094``; else the old number; else NULL."""
    parts = F.split(asset, "-")
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    own = F.when(asset.startswith("1") & (F.length(head) == 4) & tail.isNotNull(), F.concat(F.substring(head, 2, 3), F.lit("-"), F.regexp_replace(tail, "^00", "")))
    return F.coalesce(own, F.nullif(old, F.lit("")))


# ---- orders by month ----
@query("SELECT month_label, strftime(a, '%Y-%m-%d') AS first_day, strftime(a + INTERVAL 1 MONTH, '%Y-%m-%d') AS end_day, n FROM (SELECT strftime(o_orderdate, '%B %Y') AS month_label, date_trunc('month', o_orderdate) AS a, count(*) AS n FROM orders GROUP BY ALL)")
def month_bounds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(month_label(F.col("o_orderdate")).alias("month_label")).agg(F.count("*").alias("n"))
    return rows.select("month_label", month_start(F.col("month_label")).cast("string").alias("first_day"), month_end(F.col("month_label")).cast("string").alias("end_day"), "n")


@query("SELECT strftime(TIMESTAMP '2025-02-01' + (o_orderdate - date_trunc('month', o_orderdate)), '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def redated_orders(spark, sf_dir):
    """Orders by day after they were moved to February 2025; the 29th to 31st come to March."""
    ts = F.col("o_orderdate").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date(moved_to_month(ts, F.lit("2025-02-01"))).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT substr(coalesce(cast(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END AS varchar), cast(o_orderdate AS varchar)), 1, 7) AS month_key, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def rows_by_first_stamp(spark, sf_dir):
    """Lines by month of shipping, or of the order where shipping is not known (every third line)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate")).alias("shipped"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(orders, "l_orderkey").groupBy(first_month(F.col("shipped"), F.col("o_orderdate")).alias("month_key")).agg(F.count("*").alias("n"))


_RUNS = "SELECT o_custkey % 50 AS source, strftime(o_orderdate, '%Y-%m') AS month_key, max(o_orderdate) AS run_date, count(*) AS matches, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY ALL"
#: Orders that a list of runs may be asked for: keys, largest first with a minus.
RUN_ORDERS = {"date_desc": ("-run_date",), "date_asc": ("run_date",), "month": ("month_key", "-run_date"), "match_rate": ("-rate",)}


def run_order(order: str) -> list[Column]:
    """Sort keys of a known order; of any other ``date_desc``."""
    return [F.desc(F.round(k[1:], 6) if k == "-rate" else k[1:]) if k[0] == "-" else F.asc(k) for k in RUN_ORDERS.get(order, RUN_ORDERS["date_desc"])]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.groupBy((F.col("o_custkey") % 50).alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("month_key")).agg(F.max("o_orderdate").alias("run_date"), F.count("*").alias("matches"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))


@query(" UNION ALL ".join(f"(SELECT '{name}' AS listed_by, source, month_key, matches FROM ({_RUNS}) ORDER BY " + ", ".join(f"{'round(rate, 6)' if k == '-rate' else k.lstrip('-')} {'DESC' if k[0] == '-' else 'ASC'}" for k in keys) + ", source, month_key LIMIT 20)" for name, keys in RUN_ORDERS.items()))
def run_history(spark, sf_dir):
    """The first twenty runs (a source's month) in each of the orders that may be asked for."""
    rows = once(_runs(spark, sf_dir), "runs")
    parts = [rows.orderBy(*run_order(o), "source", "month_key").limit(20).select(F.lit(o).alias("listed_by"), "source", "month_key", "matches") for o in RUN_ORDERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"SELECT DISTINCT o_custkey FROM orders WHERE (o_custkey % 50, strftime(o_orderdate, '%Y-%m')) IN (SELECT (source, max(month_key)) FROM ({_RUNS}) GROUP BY source) UNION SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def latest_run_members(spark, sf_dir):
    """Who is in the latest run of their source or has a pending order; each once."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderstatus", (F.col("o_custkey") % 50).alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("month_key"))
    newest = rows.groupBy("source").agg(F.max("month_key").alias("month_key"))
    return rows.join(newest, ["source", "month_key"], "left_semi").select("o_custkey").union(rows.filter("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("SELECT CASE WHEN v % 2 = 0 THEN cast(v AS varchar) ELSE 'A' || cast(v AS varchar) END AS suffix, count(*) AS n FROM (SELECT l_suppkey AS v FROM lineitem) GROUP BY 1")
def loose_suffixes(spark, sf_dir):
    """Lines by a suffix that a sheet wrote as ``12.0`` or ``A7.0``."""
    v = F.col("l_suppkey").cast("string")
    text = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "").otherwise("A"), v, F.lit(".0"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(order_suffix_any(text).alias("suffix")).agg(F.count("*").alias("n"))


# ---- linkage ----
_ASSET = "CASE CAST(substr(hash, 2) AS bigint) % 4 WHEN 0 THEN NULL WHEN 3 THEN 'X-' || machine ELSE '1' || substr(machine, 1, 3) || '-00' || substr(machine, 5) END"


def link_works(works: DataFrame, matched: DataFrame) -> DataFrame:
    """Works with ``linked``: the registry's id, else the id in the asset number, else the report system's; and whether it was matched.

    ``works`` has canonical_id, asset and old_id, ``matched`` machine and report_id.
    """
    own = matched.select("machine").distinct()
    by_report = matched.groupBy("report_id").agg(F.min("machine").alias("_by_report"))
    rows = works.withColumn("normal", asset_machine(F.col("asset"), F.col("old_id")))
    rows = rows.join(own.select(F.col("machine").alias("canonical_id"), F.col("machine").alias("_a")), "canonical_id", "left")
    rows = rows.join(own.select(F.col("machine").alias("normal"), F.col("machine").alias("_b")), "normal", "left")
    rows = rows.join(by_report.withColumnRenamed("report_id", "asset"), "asset", "left")
    hit = F.coalesce("_a", "_b", "_by_report")
    return rows.select("*", F.coalesce(hit, F.col("canonical_id"), F.col("normal")).alias("linked"), hit.isNotNull().cast("int").alias("matched")).drop("_a", "_b", "_by_report")


_SEEN = "m AS (SELECT machine, 'X-' || machine AS report_id FROM jobs WHERE substr(machine, 1, 3) <> '166' GROUP BY machine)"


@query(f"SELECT coalesce(a.machine, b.machine, c.machine, w.canonical_id, w.normal) AS linked, CASE WHEN coalesce(a.machine, b.machine, c.machine) IS NULL THEN 0 ELSE 1 END AS matched, count(*) AS n FROM (SELECT *, CASE WHEN asset LIKE '1%' THEN machine ELSE old_id END AS normal FROM (SELECT *, {_ASSET} AS asset, CASE WHEN CAST(substr(hash, 2) AS bigint) % 8 = 0 THEN machine END AS canonical_id, CASE WHEN CAST(substr(hash, 2) AS bigint) % 4 = 0 THEN machine END AS old_id FROM works)) w LEFT JOIN m a ON a.machine = w.canonical_id LEFT JOIN m b ON b.machine = w.normal LEFT JOIN m c ON c.report_id = w.asset GROUP BY ALL", S.DUCK + ",\n" + _SEEN)
def maintenance_linkage(spark, sf_dir):
    """Works by the machine they were linked to, over three kinds of number."""
    b = bound(spark, sf_dir)
    n, m = F.substring("hash", 2, 20).cast("bigint"), F.col("machine")
    asset = F.when(n % 4 == 0, None).when(n % 4 == 3, F.concat(F.lit("X-"), m)).otherwise(F.concat(F.lit("1"), F.substring(m, 1, 3), F.lit("-00"), F.substring(m, 5, 20)))
    works = b["works"].select(asset.alias("asset"), F.when(n % 8 == 0, m).alias("canonical_id"), F.when(n % 4 == 0, m).alias("old_id"))
    matched = b["jobs"].filter("substr(machine, 1, 3) <> '166'").select("machine", F.concat(F.lit("X-"), m).alias("report_id")).distinct()
    return link_works(works, matched).groupBy("linked", "matched").agg(F.count("*").alias("n"))


# ---- stages and pages ----
def stage_summary(stage: str, rows: DataFrame) -> DataFrame:
    """One row on what a stage of the fact holds; columns that the stage has not yet count as nothing."""
    has = lambda c: F.count(c) if c in rows.columns else F.lit(0).cast("bigint")
    test = lambda c, t: F.count_if(t) if c in rows.columns else F.lit(0).cast("bigint")
    return rows.groupBy().agg(F.lit(stage).alias("stage"), F.count("*").alias("n_rows"), F.countDistinct("machine").alias("machines"), F.countDistinct("hour_us").alias("hours"), has("job_hash").alias("with_job"), has("report_hash").alias("with_report"), test("good_qty", F.expr("good_qty is not null or scrap_qty is not null")).alias("with_quantity"), test("maintenance_in_hour", F.expr("maintenance_in_hour = 1")).alias("with_maintenance"), test("machine_state", F.expr("machine_state = 'maintenance'")).alias("maintenance_state"))


@query("SELECT 'backbone' AS stage, count(*) AS n_rows, count(DISTINCT machine) AS machines, count(DISTINCT hour_us) AS hours, 0 AS with_job, 0 AS with_report, 0 AS with_quantity, 0 AS with_maintenance, 0 AS maintenance_state FROM backbone UNION ALL SELECT 'fact', count(*), count(DISTINCT machine), count(DISTINCT hour_us), count(job_hash), count(report_hash), count(*) FILTER (good_qty IS NOT NULL OR scrap_qty IS NOT NULL), count(*) FILTER (maintenance_in_hour = 1), count(*) FILTER (machine_state = 'maintenance') FROM fact", S.FACT)
def stage_summaries(spark, sf_dir):
    return stage_summary("backbone", backbone(bound(spark, sf_dir)["meters"])).unionByName(stage_summary("fact", fact(spark, sf_dir)))


@query("SELECT machine, hour_us, strftime(hour_ts, '%B %Y') AS month_label, good_qty, CASE WHEN energy_kwh IS NOT NULL AND good_qty > 0 THEN energy_kwh / good_qty END AS kwh_per_good, coalesce(machine_state, 'unknown') AS bucket, array_to_string(list_transform(string_split(coalesce(machine_state, 'unknown'), '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM fact", S.FACT, "good_qty kwh_per_good")
def fact_page(spark, sf_dir):
    """The fact as a page shows it: month, pieces, energy per piece, state as a bucket and in words."""
    rows = fact(spark, sf_dir)
    return rows.select("machine", "hour_us", month_label(F.timestamp_micros("hour_us")).alias("month_label"), "good_qty", F.when(R.qualifying(rows), F.col("energy_kwh") / F.col("good_qty")).alias("kwh_per_good"), F.coalesce("machine_state", F.lit("unknown")).alias("bucket"), state_label(F.col("machine_state")).alias("label"))


@query("SELECT machine, h AS hour_us, count(*) AS plans FROM (SELECT machine, unnest(range(a - a % 3600000000, report_us, 3600000000)) AS h FROM (SELECT machine, report_us - 5400000000 AS a, report_us FROM reports)) GROUP BY ALL", S.DUCK)
def planned_hours(spark, sf_dir):
    """Plans that each hour of a machine overlaps; a plan is the hour and a half before its report. No join: a plan names its hours."""
    hour = 3_600_000_000
    start = F.col("report_us") - 5_400_000_000
    hours = F.sequence(start - start % hour, F.col("report_us") - 1, F.lit(hour))
    return bound(spark, sf_dir)["reports"].select("machine", F.explode(hours).alias("hour_us")).groupBy("machine", "hour_us").agg(F.count("*").alias("plans"))


# ---- replacement and backfill ----
def replacement_checks(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """What must be 0 before shadow quantities may replace landed ones: a row for each check with its count.

    Rows that change without being eligible, negative values, and jobs whose pieces are not conserved.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    apart = lambda a, b: F.abs(zero(a) - zero(b)) > tolerance
    bad = {"changed_out_of_scope": (F.col("shadow_eligible") == 0) & (apart("good_qty", "shadow_good") | apart("scrap_qty", "shadow_scrap")), "negative": (zero("shadow_good") < 0) | (zero("shadow_scrap") < 0)}
    sums = rows.groupBy("job_hash").agg(*[F.count_if(t).alias(n) for n, t in bad.items()], *[F.sum(zero(c)).alias(c) for c in ("good_qty", "shadow_good", "scrap_qty", "shadow_scrap")])
    totals = sums.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in bad], F.count_if(apart("good_qty", "shadow_good") | apart("scrap_qty", "shadow_scrap")).alias("not_conserved"))
    return totals.withColumn("_", F.lit(0)).unpivot(["_"], [*bad, "not_conserved"], "rule", "n").select("rule", "n")


@query(f"SELECT 'changed_out_of_scope' AS rule, count(*) FILTER (shadow_eligible = 0 AND (abs(coalesce(good_qty, 0) - coalesce(shadow_good, 0)) > 1e-6 OR abs(coalesce(scrap_qty, 0) - coalesce(shadow_scrap, 0)) > 1e-6)) AS n FROM (SELECT s.*, q.good_qty, q.scrap_qty FROM ({_SHADOW}) s JOIN fq q ON q.machine = s.machine AND q.hour_us = s.hour_us) UNION ALL SELECT 'negative', count(*) FILTER (shadow_good < 0 OR shadow_scrap < 0) FROM ({_SHADOW}) UNION ALL SELECT 'not_conserved', count(*) FROM (SELECT s.job_hash FROM ({_SHADOW}) s JOIN fq q ON q.machine = s.machine AND q.hour_us = s.hour_us GROUP BY s.job_hash HAVING abs(coalesce(sum(shadow_good), 0) - coalesce(sum(good_qty), 0)) > 1e-6 OR abs(coalesce(sum(shadow_scrap), 0) - coalesce(sum(scrap_qty), 0)) > 1e-6)", S.QUANTITY)
def replacement_guard(spark, sf_dir):
    return replacement_checks(quantity_shadow(_quantity(spark, sf_dir)))


def replace_guarded(rows: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write the shadow quantities in place of the landed ones if every check is 0; the counts either way."""
    counts = {r["rule"]: r["n"] for r in replacement_checks(rows).collect()}
    if not any(counts.values()):
        write(rows.withColumns({"good_qty": F.col("shadow_good"), "scrap_qty": F.col("shadow_scrap")}))
    return counts


def backfill(months: Iterable[str], run: Callable[[str], None]) -> dict[str, str]:
    """Run each month by itself; a month that fails does not stop the others. ``done`` or the error, by month."""
    out = {}
    for month in months:
        try:
            run(month)
            out[month] = "done"
        except Exception as error:  # a month's failure is its result
            out[month] = f"failed: {error}"
    return out
