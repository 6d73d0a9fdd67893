"""Landing queries: the fact period by period, cleaned layers that resolve, rejected rows, guarded replacement, runs persisted together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import machine_pattern
from ..operators.resolve import EXCEPTIONS, REGISTRY
from ..scratch import once, scratch_path
from ..sources.layers import IDENTIFIERS, clean_family, clean_meters, raw_rows, typed_raw_rows
from ..sources.month_vote import elected, month_readiness, votes
from ..sources.rejects import QUEUE_OPTIONAL, QUEUE_REQUIRED, normalised_queue, queue_reasons, read_lines, reject_counts, unresolved
from ..sources.versions import Versions, persist_run, replacement_report
from . import gold_sql as S
from .bindings import _MACHINE, bound
from .catalog import _SHADOW, _quantity, query
from .gold import backbone, quantity_shadow, with_jobs, with_quantity
from .periods import UNDATED, PeriodStore, Sweep, border_hours, land, period_of
from .staged import Stage, run_stages

_WEEK = "strftime(make_timestamp({}), '%G-W%V')"


def stored(spark: SparkSession, sf_dir: str) -> PeriodStore:
    """The bound tables partitioned by week; the data span a month."""
    b = bound(spark, sf_dir)
    store = PeriodStore(spark, scratch_path(spark, "store"), "week")
    store.put(b["meters"], b["jobs"], b["reports"], b["works"])
    return store


# ---- by period ----
_LANDED = ["machine", "hour_us", "period", "energy_kwh", "production_minutes", "good_qty", "scrap_qty", "machine_state", "report_hash", "works_7d", "works_ever", "hours_since", "idle_minutes", "promotion_blocked"]


@query(f"SELECT {', '.join(_WEEK.format('hour_us') + ' AS period' if c == 'period' else c for c in _LANDED)} FROM fact", S.FACT, "energy_kwh production_minutes good_qty scrap_qty hours_since idle_minutes")
def swept_fact(spark, sf_dir):
    """The fact landed week after week by a sweep; each week reads its own partitions and what its border jobs need."""
    store = stored(spark, sf_dir)
    target = f"{store.root}/fact"
    sweep = Sweep(spark, f"{store.root}/sweep")
    result = sweep.run(store.periods(), lambda p: land(store, p, target), "all", at_once=5)
    if failed := {p: s for p, s in result.items() if s != "done"}:
        raise RuntimeError(f"weeks failed: {sweep.report(store.periods())['failed'] or failed}")
    return spark.read.option("basePath", target).parquet(target).select(*_LANDED)


@query(f"SELECT target, period, count(*) AS hours FROM (SELECT DISTINCT {_WEEK.format('a')} AS target, {_WEEK.format('h')} AS period, machine, h FROM (SELECT machine, a, unnest(range(s - s % 3600000000, e, 3600000000)) AS h, s, e FROM (SELECT *, unnest(range(s - s % 86400000000, e, 86400000000)) AS a FROM (SELECT machine, least(prep_end_us - changeover * 60000000, prep_end_us) AS s, greatest(prep_end_us, prod_end_us) AS e FROM jobs WHERE prod_end_us > prep_end_us - changeover * 60000000)))) WHERE target <> period GROUP BY ALL", S.DUCK)
def period_borders(spark, sf_dir):
    """Hours of other weeks that a week's run has to read, as jobs over the border lead some of them."""
    store = stored(spark, sf_dir)
    out = None
    for p in sorted(r["period"] for r in store.table("jobs").select("period").filter(F.col("period") != UNDATED).distinct().collect()):
        rows = border_hours(store.table("jobs").filter(F.col("period") == p), p, store.unit).groupBy("period").agg(F.count("*").alias("hours")).select(F.lit(p).alias("target"), "period", "hours")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "target string, period string, hours bigint") if out is None else out


@query(" UNION ALL ".join(f"SELECT '{t}' AS layer, {_WEEK.format(c)} AS period, count(*) AS n_rows FROM {t} GROUP BY ALL" for t, c in (("meters", "hour_us"), ("reports", "report_us"), ("works", "txn_us"))), S.DUCK)
def layer_counts(spark, sf_dir):
    """Rows of each input table and week, from the partitions."""
    store = stored(spark, sf_dir)
    parts = [store.table(t).groupBy("period").agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("layer"), "period", "n_rows") for t in ("meters", "reports", "works")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- cleaned layers ----
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the bound machines; each system calls them by numbers of its own."""
    machines = bound(spark, sf_dir)["meters"].select("machine").distinct()
    head, tail = F.split_part("machine", F.lit("-"), F.lit(1)), F.split_part("machine", F.lit("-"), F.lit(2))
    number = lambda front, mid: F.concat(F.lit(front), head, F.lit(mid), tail)
    return machines.select(F.col("machine").alias("canonical_id"), F.concat(F.lit("D-"), "machine").alias("job_id"), number("1", "-00").alias("report_id"), F.array(number("1", "-90")).alias("report_aliases"), number("2", "-00").alias("asset_id"), F.col("machine").alias("legacy_id"), F.array(F.concat(F.lit("印刷機"), "machine"), F.concat(F.lit("press no. "), "machine", F.lit(" old"))).alias("meter_aliases"), F.lit("joinable").alias("scope_status")).select([c.split()[0] for c in REGISTRY.split(", ")])


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second numbers of the report system that are to be read as another one."""
    rows = registry(spark, sf_dir).filter("canonical_id like '024%'")
    return rows.select(F.col("report_aliases")[0].alias("alias"), F.concat(F.col("report_id"), F.lit("N")).alias("preferred_report_id"), F.lit("second number").alias("issue")).select([c.split()[0] for c in EXCEPTIONS.split(", ")])


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type") == kind).select("event_id", "user_id", "value", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"))
    return base.withColumn("m", F.expr(_MACHINE.format(text="string")))


def _number(front: str, mid: str) -> Column:
    """The machine ``024-001`` as another system writes it: ``1024-00001`` for front ``1`` and mid ``00``."""
    return F.concat(F.lit(front), F.split_part("m", F.lit("-"), F.lit(1)), F.lit(f"-{mid}"), F.split_part("m", F.lit("-"), F.lit(2)))


def _given() -> Column:
    """The canonical machine that the raw row of every seventh event has."""
    return F.when(F.col("event_id") % 7 == 0, F.col("m")).alias("canonical_machine_id")


def _kind(*values: Column) -> Column:
    """One of five values in turn."""
    out = None
    for i, v in enumerate(values):
        out = F.when(F.col("event_id") % 5 == i, v) if out is None else out.when(F.col("event_id") % 5 == i, v)
    return out


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as a job sheet has them: five ways to name a machine, stamps that are none, crews with gaps."""
    e = _events(spark, sf_dir, "purchase")
    name = _kind(F.col("m"), F.concat(F.lit(" d-"), "m"), F.concat(F.lit("press "), _number("1", "00"), F.lit(" x")), F.lit("  "), F.lit("spare"))
    start = F.when(F.col("event_id") % 13 == 0, "n/a 7").otherwise(F.col("stamp"))
    return e.select(F.col("event_id").cast("string").alias("作业"), name.alias("機台編號"), start.alias("工程開始時間"), F.col("value").cast("string").alias("正品數量"), F.lit("").alias("廢品數量"), F.concat(F.lit("L"), F.col("user_id") % 4).alias("機長姓名1"), F.when(F.col("user_id") % 2 == 0, "M1").alias("機長姓名2"), F.lit(" ").alias("機組人員姓名1"), F.when(F.col("user_id") % 3 == 0, "M3").alias("機組人員姓名2"), _given())


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "signup")
    name = _kind(_number("1", "00"), _number("1", "90"), F.concat(F.lit("RES "), "m"), F.lit(None).cast("string"), F.lit("bench 9"))
    return e.select(F.col("event_id").cast("string").alias("作業"), name.alias("資源"), F.col("stamp").alias("報工時間"), F.col("value").cast("string").alias("生產數量"), (F.col("user_id") % 5).cast("string").alias("人數"), _given())


def work_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "error")
    asset = _kind(_number("2", "00"), F.lit(None).cast("string"), F.lit("pump"), F.lit(""), F.concat(F.lit("hall "), _number("2", "00")))
    legacy = _kind(F.lit(None).cast("string"), F.col("m"), F.concat(F.lit("ex "), "m"), F.lit(" "), F.lit("pump"))
    return e.select(F.col("event_id").cast("string").alias("工單"), asset.alias("資產"), legacy.alias("資產老編號"), F.col("stamp").alias("交易日期"), F.col("value").cast("string").alias("數量"), _given())


def meter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "view")
    label = _kind(F.concat(F.lit("印刷機"), "m"), F.concat("m", F.lit(" 主機")), F.concat(F.lit("press no. "), "m", F.lit(" old")), F.lit("compressor UV"), F.concat("m", F.lit("合計")))
    return e.select(label.alias("machine"), F.date_format(F.date_trunc("hour", F.col("stamp").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("value").cast("string").alias("electricity_kwh"), F.col("event_id").cast("string").alias("electricity_cost"))


def _layer(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    source = {"jobs": job_rows, "reports": report_rows, "works": work_rows}[family](spark, sf_dir)
    return clean_family(typed_raw_rows(source, family, ("canonical_machine_id",)), family, registry(spark, sf_dir), exceptions(spark, sf_dir))


_HOW = ["canonical_machine_id", "resolution.method", "coalesce(resolution.step, -1) as step", "resolution.matched_on", "resolution.exception_applied", "resolution.preferred_report_id", "resolution.reason"]
_CLEAN = "e AS MATERIALIZED (SELECT *, event_id % 5 AS k, event_id % 7 = 0 AS g, substr(machine, 1, 3) AS fam, substr(machine, 5) AS num FROM bound)"
_HOWS = "CASE WHEN g OR {known} THEN machine END AS canonical_machine_id, CASE WHEN g THEN 'given' WHEN {known} THEN 'registry' ELSE 'unresolved' END AS method, CASE WHEN g THEN 0 WHEN {known} THEN {step} ELSE -1 END AS step, CASE WHEN NOT g AND {known} THEN {on} END AS matched_on, CASE WHEN NOT g AND {known} AND {exc} THEN 1 ELSE 0 END AS exception_applied, CASE WHEN NOT g AND {known} THEN '1' || fam || '-00' || num || CASE WHEN {exc} THEN 'N' ELSE '' END END AS preferred_report_id, CASE WHEN g OR {known} THEN NULL WHEN {blank} THEN 'no_identifier' ELSE 'not_found' END AS reason"


@query("SELECT cast(event_id AS varchar) AS order_id, " + _HOWS.format(known="k < 3", step="1", on="['canonical_machine_id', 'csi_machine_id', 'mes_primary_resource'][k + 1]", exc="false", blank="k = 3") + ", CASE WHEN event_id % 13 <> 0 THEN us ELSE 0 END AS start_us, CASE WHEN event_id % 13 = 0 THEN 'n/a 7' END AS bad_start, value AS good_qty, 'L' || (user_id % 4) AS team_leader, concat_ws(',', CASE WHEN user_id % 2 = 0 THEN 'M1' END, CASE WHEN user_id % 3 = 0 THEN 'M3' END) AS members FROM e WHERE event_type = 'purchase'", S.DUCK + ",\n" + _CLEAN, "good_qty")
def cleaned_jobs(spark, sf_dir):
    """The job layer read back from payloads: machine and how it was found, stamps, pieces, crew."""
    return _layer(spark, sf_dir, "jobs").select("order_id", *map(F.expr, _HOW), F.coalesce(F.unix_micros("prod_start_ts"), F.lit(0)).alias("start_us"), F.try_element_at("bad_stamps", F.lit("prod_start_ts")).alias("bad_start"), "good_qty", "team_leader", F.array_join("team_members", ",").alias("members"))


@query("SELECT cast(event_id AS varchar) AS order_id, " + _HOWS.format(known="k < 3", step="1", on="['mes_primary_resource', 'mes_secondary_alias', 'canonical_machine_id'][k + 1]", exc="(k = 1 AND fam = '024')", blank="k = 3") + ", us AS report_us, value AS reported_qty, cast(user_id % 5 AS double) AS manpower FROM e WHERE event_type = 'signup'", S.DUCK + ",\n" + _CLEAN, "reported_qty manpower")
def cleaned_reports(spark, sf_dir):
    """The report layer; a second number of the report system is read as the one that its exception names."""
    return _layer(spark, sf_dir, "reports").select("order_id", *map(F.expr, _HOW), F.unix_micros("report_ts").alias("report_us"), "reported_qty", "manpower")


@query("SELECT cast(event_id AS varchar) AS work_order_id, " + _HOWS.format(known="k <> 3", step="CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END", on="CASE WHEN k IN (0, 4) THEN 'maintenance_asset_id' ELSE 'maintenance_legacy_id' END", exc="false", blank="k = 3") + ", us AS txn_us, value AS quantity FROM e WHERE event_type = 'error'", S.DUCK + ",\n" + _CLEAN, "quantity")
def cleaned_works(spark, sf_dir):
    """The maintenance layer: the asset's number first, then its old one."""
    return _layer(spark, sf_dir, "works").select("work_order_id", *map(F.expr, _HOW), F.unix_micros("txn_ts").alias("txn_us"), "quantity")


@query("SELECT cast(event_id AS double) AS cost, CASE WHEN k < 3 THEN machine END AS canonical_machine_id, CASE WHEN k < 3 THEN 'registry' ELSE 'unresolved' END AS method, CASE WHEN k < 3 THEN ['energy_alias_example', 'energy_extracted_id', 'energy_alias_example'][k + 1] END AS matched_on, CASE WHEN k < 3 THEN NULL ELSE 'not_found' END AS reason, ['aggregate_total', 'main', 'aggregate_total', 'uv'][k + 1] AS meter_component, CASE WHEN k IN (0, 2) THEN 1 ELSE 0 END AS meter_is_aggregate, ['medium', 'high', 'medium', 'low'][k + 1] AS parse_confidence, us - us % 3600000000 AS hour_us, value AS kwh, 'ok' AS quality_status FROM e WHERE event_type = 'view' AND k < 4", S.DUCK + ",\n" + _CLEAN, "kwh cost")
def cleaned_meters(spark, sf_dir):
    """The meter layer: totals are left out, labels resolve by the aliases and the numbers in them."""
    raw = raw_rows(meter_rows(spark, sf_dir), "energy")
    rows = clean_meters(raw, kwh="electricity_kwh", cost="electricity_cost", registry=registry(spark, sf_dir))
    return rows.select("cost", "canonical_machine_id", "resolution.method", "resolution.matched_on", "resolution.reason", "meter_component", "meter_is_aggregate", "parse_confidence", F.unix_micros("hour_ts").alias("hour_us"), "kwh", "quality_status")


@query("SELECT 'jobs' AS family, CASE WHEN k = 4 THEN 'spare' END AS identifier, CASE WHEN k = 4 THEN 'not_found' ELSE 'no_identifier' END AS reason, count(*) AS n_rows FROM e WHERE event_type = 'purchase' AND NOT g AND k >= 3 GROUP BY ALL UNION ALL SELECT 'reports', CASE WHEN k = 4 THEN 'bench 9' END, CASE WHEN k = 4 THEN 'not_found' ELSE 'no_identifier' END, count(*) FROM e WHERE event_type = 'signup' AND NOT g AND k >= 3 GROUP BY ALL UNION ALL SELECT 'works', NULL, 'no_identifier', count(*) FROM e WHERE event_type = 'error' AND NOT g AND k = 3 GROUP BY ALL", S.DUCK + ",\n" + _CLEAN)
def unresolved_identifiers(spark, sf_dir):
    """Rows of the cleaned layers without a machine, by identifier and reason."""
    parts = [unresolved(_layer(spark, sf_dir, f), f, IDENTIFIERS[f]) for f in ("jobs", "reports", "works")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- rejected rows ----
_QUEUE = """q AS MATERIALIZED (SELECT concat(l_orderkey, '/', l_linenumber) AS job_id, l_orderkey % 31 = 0 AS broken, l_orderkey % 23 = 0 AS no_material, l_orderkey % 17 = 0 AS no_number, l_orderkey % 19 = 0 AS negative, l_partkey, l_linenumber, l_quantity AS quantity, ['024', '035', '166'][1 + l_suppkey % 3] AS family, ['Printing', 'UV 光', 'Pack', 'Print + UV'][1 + l_linenumber % 4] AS task, ['high', 'LOW', ''][1 + l_orderkey % 3] AS urgency FROM lineitem)"""
_BAD = "broken OR no_material OR no_number OR negative"


def queue_file(spark: SparkSession, sf_dir: str) -> str:
    """Order lines as CSV with headers of a planner's own and some broken lines; the folder that they were written to."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey")
    quantity = F.when(key % 17 == 0, "a few").when(key % 19 == 0, "-5").otherwise(F.col("l_quantity").cast("string"))
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    line = F.concat_ws(",", F.concat(key, F.lit("/"), "l_linenumber"), pick(("024", "035", "166"), "l_suppkey"), F.when(key % 23 == 0, " ").otherwise(F.concat(F.lit("P"), "l_partkey")), pick(("Printing", "UV 光", "Pack", "Print + UV"), "l_linenumber"), quantity, pick(("high", "LOW", ""), "l_orderkey"), F.when(key % 31 == 0, "one,too many"))
    path = f"{scratch_path(spark, 'queue')}/queue.csv"
    spark.range(1).select(F.lit("Job ID,Machine-Family,Material Code,Task,Quantity,Urgency").alias("value")).write.text(f"{path}-head")
    head = spark.read.text(f"{path}-head")
    # every file of the folder starts with the header, as exports do
    parts = rows.select(line.alias("value"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    heads = parts.select("part").distinct().select(F.lit(head.first()["value"]).alias("value"), "part", F.lit(-1).cast("bigint").alias("place"))
    parts.unionByName(heads).repartition("part").sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").text(path)
    return path


@query(f"SELECT job_id, family AS preferred_machine_family, 'P' || l_partkey AS material_code, task AS task_name, ['Medium', 'Easy', NULL, 'Hard'][1 + l_linenumber % 4] AS task_difficulty, round_even(quantity / 25.0, 0) * 25.0 AS quantity, CASE urgency WHEN 'high' THEN 'High' WHEN 'LOW' THEN 'Low' ELSE 'Medium' END AS urgency_label, CASE urgency WHEN 'high' THEN 3 WHEN 'LOW' THEN 1 ELSE 2 END AS urgency_rank, 8 AS hour_of_day FROM q WHERE NOT ({_BAD})", _QUEUE)
def uploaded_queue(spark, sf_dir):
    """The good rows of an uploaded queue, normalised."""
    read = read_lines(spark, queue_file(spark, sf_dir), QUEUE_REQUIRED, QUEUE_OPTIONAL)
    rows = normalised_queue(queue_reasons(read.rows), "January 2024")
    return rows.select("job_id", "preferred_machine_family", "material_code", "task_name", "task_difficulty", "quantity", "urgency_label", "urgency_rank", "hour_of_day")


@query("SELECT reason, count(*) AS n_rows FROM (SELECT unnest(CASE WHEN broken THEN ['broken_line'] ELSE list_filter([CASE WHEN no_material THEN 'missing_material_code' END, CASE WHEN no_number THEN 'quantity_is_no_number' WHEN negative THEN 'quantity_not_positive' END], lambda x: x IS NOT NULL) END) AS reason FROM q) GROUP BY 1", _QUEUE)
def queue_rejects(spark, sf_dir):
    """Rejected rows of the same queue, by reason."""
    read = read_lines(spark, queue_file(spark, sf_dir), QUEUE_REQUIRED, QUEUE_OPTIONAL)
    return reject_counts(queue_reasons(read.rows))


# ---- a run in stages ----
@query("SELECT 'backbone' AS stage, 'done' AS state, count(*) AS n_rows, count(energy_kwh) AS energy, 0::bigint AS jobs, 0::bigint AS pieces FROM backbone UNION ALL SELECT 'jobs', 'done', count(*), count(energy_kwh), count(job_hash), 0 FROM fj UNION ALL SELECT 'quantity', 'done', count(*), count(energy_kwh), count(job_hash), count(good_qty) FROM fq", S.QUANTITY)
def staged_rows(spark, sf_dir):
    """Rows and values that each stage of the fact wrote, counted while it was written; an hour is more than any stage takes here."""
    b = bound(spark, sf_dir)
    stages = [Stage("backbone", backbone, ["energy_kwh"]), Stage("jobs", lambda rows: with_jobs(rows, b["jobs"]), ["energy_kwh", "job_hash"]), Stage("quantity", with_quantity, ["energy_kwh", "job_hash", "good_qty"])]
    report = run_stages(spark, b["meters"], stages, limit=3600).report
    filled = lambda c: F.coalesce(F.try_element_at("filled", F.lit(c)), F.lit(0))
    return report.select("stage", "state", "n_rows", filled("energy_kwh").alias("energy"), filled("job_hash").alias("jobs"), filled("good_qty").alias("pieces"))


# ---- replacement and runs ----
_SHADOWED = ["machine", "hour_us", "job_hash", "good_qty", "scrap_qty", "production_minutes", "machine_state", "shadow_eligible", "shadow_good", "shadow_scrap"]


def _shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(quantity_shadow(_quantity(spark, sf_dir)).select(*_SHADOWED), "shadowed")


def quantity_checks(before: DataFrame, after: DataFrame) -> DataFrame:
    """The replacement's rules for pieces: only where the row's job is eligible, nothing else changes, jobs keep their pieces."""
    return replacement_report(before, after, ["machine", "hour_us"], "job_hash", ["good_qty", "scrap_qty"], ["job_hash", "production_minutes", "machine_state"], F.col("shadow_eligible") == 1)


@query(f"SELECT machine, hour_us, shadow_good AS good_qty, shadow_scrap AS scrap_qty, 2 AS commit_number FROM ({_SHADOW})", S.QUANTITY, "good_qty scrap_qty")
def guarded_replacement(spark, sf_dir):
    """Pieces by production minutes in place of the landed ones: staged, checked as staged, published; read back by its commit."""
    rows = _shadowed(spark, sf_dir)
    store = Versions(spark, scratch_path(spark, "versions"))
    store.publish({"pieces": store.stage("pieces", rows)}, "landed")
    after = rows.withColumns({"good_qty": F.col("shadow_good"), "scrap_qty": F.col("shadow_scrap")})
    number = store.replace_guarded("pieces", after, lambda a, b: {r["rule"]: r["n"] for r in quantity_checks(a, b).collect()}, "replacement")
    return store.read("pieces", number).select("machine", "hour_us", "good_qty", "scrap_qty", F.lit(number).alias("commit_number"))


_ROUNDED = f"z AS MATERIALIZED (SELECT s.*, q.good_qty, q.scrap_qty, round(q.good_qty + 1e-9) AS r FROM ({_SHADOW}) s JOIN fq q ON q.machine = s.machine AND q.hour_us = s.hour_us)"


@query("SELECT rule, n FROM (SELECT [{'rule': 'repeated_key', 'n': 0}, {'rule': 'gone_row', 'n': 0}, {'rule': 'new_row', 'n': 0}, {'rule': 'changed_out_of_scope', 'n': (SELECT count(*) FROM z WHERE shadow_eligible = 0 AND good_qty IS DISTINCT FROM r)}, {'rule': 'changed_other_column', 'n': 0}, {'rule': 'negative', 'n': 0}, {'rule': 'gone_group', 'n': 0}, {'rule': 'group_not_conserved', 'n': (SELECT count(*) FROM (SELECT job_hash FROM z GROUP BY 1 HAVING abs(sum(coalesce(good_qty, 0)) - sum(coalesce(r, 0))) > 1e-6))}, {'rule': 'total_of_good_qty', 'n': (SELECT cast(abs(sum(good_qty) - sum(r)) > 1e-6 AS bigint) FROM z)}, {'rule': 'total_of_scrap_qty', 'n': 0}] AS x) t, unnest(x) AS u(y), LATERAL (SELECT y.rule AS rule, y.n AS n)", S.QUANTITY + ",\n" + _ROUNDED)
def replacement_audit(spark, sf_dir):
    """What would speak against whole pieces in place of shares."""
    rows = _shadowed(spark, sf_dir)
    return quantity_checks(rows, rows.withColumn("good_qty", F.round(F.col("good_qty") + 1e-9)))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, machine, system, raw): what each system calls the machines that it saw, by week."""
    b = bound(spark, sf_dir)
    week = lambda c: period_of(F.col(c), "week").alias("month")
    tail, head = F.split_part("machine", F.lit("-"), F.lit(2)), F.split_part("machine", F.lit("-"), F.lit(1))
    meters = b["meters"].filter("component = 'main'").select(week("hour_us"), "machine", F.lit("energy").alias("system"), F.concat("machine", F.lit(" 主機")).alias("raw"))
    jobs = b["jobs"].filter("changeover > 12").select(week("prod_start_us"), "machine", F.lit("jobs").alias("system"), F.concat(F.lit("D-"), "machine").alias("raw"))
    reports = b["reports"].filter("manpower > 2").select(week("report_us"), "machine", F.lit("reports").alias("system"), F.concat(F.lit("1"), head, F.lit("-00"), tail).alias("raw"))
    return meters.unionByName(jobs).unionByName(reports).withColumn("pattern", machine_pattern(F.col("raw"))).select("month", "pattern", "system", "raw").distinct()


def matched_systems(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns that all three systems know, with the first raw id of each, and (machine_id, system) of the others."""
    first = lambda s: F.min(F.when(F.col("system") == s, F.col("raw")))
    by = seen.groupBy("pattern").agg(first("energy").alias("energy_id"), first("jobs").alias("job_id"), first("reports").alias("report_id"))
    full = F.col("energy_id").isNotNull() & F.col("job_id").isNotNull() & F.col("report_id").isNotNull()
    others = by.filter(~full).select(F.explode(F.array_compact(F.array(F.when(F.col("energy_id").isNotNull(), F.struct(F.col("pattern").alias("machine_id"), F.lit("energy").alias("system"))), F.when(F.col("job_id").isNotNull(), F.struct(F.col("job_id").alias("machine_id"), F.lit("jobs").alias("system"))), F.when(F.col("report_id").isNotNull(), F.struct(F.col("report_id").alias("machine_id"), F.lit("reports").alias("system")))))).alias("x")).select("x.*")
    return by.filter(full).select(F.col("pattern").alias("machine_id"), "job_id", "report_id"), others


_PRESENT = f"""seen AS MATERIALIZED (SELECT DISTINCT {_WEEK.format('hour_us')} AS month, machine, 'energy' AS system FROM meters WHERE component = 'main' UNION SELECT {_WEEK.format('prod_start_us')}, machine, 'jobs' FROM jobs WHERE changeover > 12 UNION SELECT {_WEEK.format('report_us')}, machine, 'reports' FROM reports WHERE manpower > 2),
named AS MATERIALIZED (SELECT month, machine, system, CASE system WHEN 'energy' THEN machine WHEN 'jobs' THEN 'D-' || machine ELSE '1' || substr(machine, 1, 3) || '-00' || substr(machine, 5) END AS machine_id FROM seen),
three AS MATERIALIZED (SELECT month, machine FROM seen GROUP BY ALL HAVING count(*) = 3)"""


@query("SELECT machine_id, system, min(month) AS first_seen, max(month) AS last_seen, CASE WHEN max(month) = (SELECT max(month) FROM named) THEN 1 ELSE 0 END AS active, count(*) AS months, count(t.month) AS three_way_months FROM named n LEFT JOIN (SELECT month AS month, machine AS m FROM three) t ON t.month = n.month AND t.m = n.machine_id GROUP BY machine_id, system".replace("min(month)", "min(n.month)").replace("max(month) AS last", "max(n.month) AS last").replace("WHEN max(month) =", "WHEN max(n.month) ="), S.DUCK + ",\n" + _PRESENT)
def run_inventory(spark, sf_dir):
    """Inventory after each week's run was persisted under its own id: first and last week, whether it is active, weeks of presence."""
    seen = once(_seen(spark, sf_dir), "seen")
    store = Versions(spark, scratch_path(spark, "runs"))
    for month in sorted(r["month"] for r in seen.select("month").distinct().collect()):
        rows = once(seen.filter(F.col("month") == month).drop("month"), "month")
        matches, others = matched_systems(rows)
        persist_run(store, month, f"run-{month}", {"sources": rows}, matches, others)
    presence = store.read("presence").groupBy("machine_id", "system").agg(F.count("*").alias("months"), F.sum("three_way").cast("bigint").alias("three_way_months"))
    return store.read("inventory").select("machine_id", "system", "first_seen", "last_seen", "active").join(presence, ["machine_id", "system"])


_BY_WEEK = "SELECT month, machine AS pattern, " + ", ".join(f"max(CASE WHEN system = '{s}' THEN machine_id END) AS {s[0]}" for s in ("energy", "jobs", "reports")) + " FROM named GROUP BY ALL"


@query(f"SELECT month, pattern, e || ' 主機' AS energy_id, j AS job_id, r AS report_id, CASE WHEN e IS NOT NULL AND j IS NOT NULL AND r IS NOT NULL THEN 'three_way' ELSE concat_ws('_', CASE WHEN e IS NOT NULL THEN 'energy' END, CASE WHEN j IS NOT NULL THEN 'jobs' END, CASE WHEN r IS NOT NULL THEN 'reports' END) || '_only' END AS kind FROM ({_BY_WEEK})", S.DUCK + ",\n" + _PRESENT)
def system_matches(spark, sf_dir):
    """Machines of each week by the systems that know them, with the first id that each system gives them; matched by the machine number in the ids."""
    return matches_by_kind(_seen(spark, sf_dir), ["month"])


def matches_by_kind(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Patterns with the first raw id of each system and ``three_way``, ``energy_jobs_only`` and so on, for each of ``keys``; ids without a pattern are left out."""
    systems = {"energy": "energy_id", "jobs": "job_id", "reports": "report_id"}
    by = seen.filter("pattern is not null").groupBy(*keys, "pattern").agg(*[F.min(F.when(F.col("system") == s, F.col("raw"))).alias(c) for s, c in systems.items()])
    known = F.concat_ws("_", *[F.when(F.col(c).isNotNull(), s) for s, c in systems.items()])
    every = F.lit(True)
    for c in systems.values():
        every = every & F.col(c).isNotNull()
    return by.withColumn("kind", F.when(every, "three_way").otherwise(F.concat(known, F.lit("_only"))))


# ---- months of sources ----
@query("SELECT source, CASE WHEN status = 'resolved' THEN month END AS month, status, confidence, n, total FROM (SELECT *, CASE WHEN months = 1 OR (n >= 3 AND n / total >= 0.8) THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN months = 1 THEN CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END WHEN n >= 3 AND n / total >= 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT source, month, n, cast(sum(n) OVER (PARTITION BY source) AS bigint) AS total, count(*) OVER (PARTITION BY source) AS months FROM (SELECT o_custkey AS source, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, month) = 1))")
def source_months(spark, sf_dir):
    """The month that each customer's urgent orders are of, if one month has most of them."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderpriority like '1%'")
    return elected(votes(rows.select("o_custkey", "o_orderdate"), "o_custkey", stamps=["o_orderdate"], years=(1900, 2100)))


@query(f"SELECT month, CASE WHEN len(missing) = 0 THEN 'ready' ELSE 'missing_sources' END AS status, array_to_string(missing, ',') AS missing FROM (SELECT month, list_filter(['meters', 'jobs', 'reports', 'works'], lambda x: NOT list_contains(families, x)) AS missing FROM (SELECT month, list(DISTINCT family) AS families FROM ({' UNION ALL '.join(f'SELECT {_WEEK.format(c)} AS month, {t!r} AS family FROM {t} WHERE machine <> {m!r}' for t, c, m in (('meters', 'hour_us', ''), ('jobs', 'prod_start_us', ''), ('reports', 'report_us', ''), ('works', 'txn_us', '')))} ) GROUP BY month))", S.DUCK)
def week_readiness(spark, sf_dir):
    """Weeks that have rows of all four sources."""
    b = bound(spark, sf_dir)
    seen = [b[t].select(period_of(F.col(c), "week").alias("month"), F.lit(t).alias("family")) for t, c in (("meters", "hour_us"), ("jobs", "prod_start_us"), ("reports", "report_us"), ("works", "txn_us"))]
    return month_readiness(seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3]), ["meters", "jobs", "reports", "works"])
