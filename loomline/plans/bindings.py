"""Factory tables bound onto the ``events`` stream, in Spark and as DuckDB CTEs with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MACHINE = "concat(case user_id % 3 when 0 then '024' when 1 then '035' else '166' end, '-', lpad(cast(user_id % 12 as {text}), 3, '0'))"
_MINUTES = "cast(round(value * 100) as bigint) * 600000"
_PARTS = {
    "meters": "select machine, us - us % 3600000000 as hour_us, case event_type when 'view' then 'main' when 'click' then 'uv' else 'aggregate_total' end as component, value as kwh, value * 0.15 as cost, hash from bound where event_type in ('view', 'click', 'signup')",
    "jobs": f"""select machine, hash, us as prod_start_us, us as prep_end_us, us + {_MINUTES} as prod_end_us, event_id % 15 as changeover,
        cast(event_id % 40 as {{text}}) as order_id, cast(event_id % 3 as {{text}}) as suffix, cast(event_id % 5 as {{text}}) as material, cast(user_id % 9 as {{text}}) as leader,
        case event_id % 4 when 0 then 'Print+Finishing' when 1 then 'Printing' when 2 then 'Finishing' else 'Packing' end as task,
        value * 10 as job_good, value * 0.2 as job_scrap,
        case when event_id % 7 = 0 then null when event_id % 11 = 0 then value * 1.5 else value * 0.8 end as prod_min, value * 0.1 as planned_min, value * 0.05 as unplanned_min
        from bound where event_type = 'purchase'""",
    "reports": f"select machine, hash, us + {_MINUTES} as report_us, cast(event_id % 40 as {{text}}) as order_id, cast(event_id % 3 as {{text}}) as suffix, cast(event_id % 4 as double) as manpower from bound where event_type = 'purchase'",
    "works": "select machine, hash, us as txn_us, case when event_id % 10 = 0 then null else cast(event_id % 50 as {text}) end as work_order, case event_id % 4 when 0 then 'PM' when 1 then 'CM' when 2 then 'EM' else 'AM' end as work_type from bound where event_type = 'error'",
}


def bound(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """meters, jobs, reports and works (maintenance transactions) of the events table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    base = events.selectExpr("event_id", "user_id", "event_type", "value", "unix_micros(cast(ts as timestamp)) as us", f"{_MACHINE.format(text='string')} as machine", "concat('e', event_id) as hash")
    return {name: spark.sql(sql.format(text="string").replace("from bound", "from {bound}"), bound=base) for name, sql in _PARTS.items()}


DUCK = (
    f"bound AS MATERIALIZED (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, {_MACHINE.format(text='varchar')} AS machine, concat('e', event_id) AS hash FROM events),\n"
    + ",\n".join(f"{name} AS MATERIALIZED ({sql.format(text='varchar')})" for name, sql in _PARTS.items())
)
