"""Joins and windows in time, on integer microseconds.

Intervals are half-open. Nothing here is a range join without a key: events are spread over the hours
that they touch, so every join is on (key, hour), and as-of look-ups are windows over a union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import HOUR_US, MINUTE_US


def hour_of(us: Column) -> Column:
    return us - F.pmod(us, F.lit(HOUR_US))


def overlap_minutes(start: Column, end: Column, hour: Column) -> Column:
    """Minutes of [start, end) in the hour; 0 without both ends or when they are the wrong way round."""
    inside = F.least(end, hour + HOUR_US) - F.greatest(start, hour)
    return F.when(start.isNotNull() & end.isNotNull() & (end > start), F.greatest(F.lit(0), inside) / MINUTE_US).otherwise(0.0)


def spread_over_hours(events: DataFrame, start: str, end: str, hour: str = "hour_us") -> DataFrame:
    """A row for each hour that [start, end) touches; an end on the hour does not touch it."""
    touched = F.sequence(hour_of(F.col(start)), hour_of(F.col(end) - 1), F.lit(HOUR_US))
    return events.filter(F.col(end) > F.col(start)).withColumn(hour, F.explode(touched))


def overlap_join(hours: DataFrame, events: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Hours and the events that overlap them, as an equi-join on (key, hour_us)."""
    return hours.select(key, "hour_us").join(spread_over_hours(events, start, end), [key, "hour_us"])


def union_minutes(intervals: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", cap: float = 60.0) -> DataFrame:
    """Minutes covered by the union of each key's intervals, at most ``cap``, as ``coverage``."""
    ordered = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(ordered), F.col(start))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), before))
    return intervals.filter(F.col(end) > F.col(start)).withColumn("gain", gain).groupBy(*keys).agg(F.least(F.lit(cap), F.sum("gain") / MINUTE_US).alias("coverage"))


def asof_before(hours: DataFrame, events: DataFrame, key: str, time: str, order: str, values: Sequence[str], prefix: str = "last_") -> DataFrame:
    """For each (key, hour_us) the latest event strictly before it, ties by ``order``; no fan-out join."""
    marks = hours.select(key, F.col("hour_us").alias("_t"), F.lit(0).alias("_event"), F.lit(None).cast("string").alias("_tie"), *[F.lit(None).cast(events.schema[v].dataType).alias(v) for v in values])
    seen = events.select(key, F.col(time).alias("_t"), F.lit(1).alias("_event"), F.col(order).alias("_tie"), *values)
    past = Window.partitionBy(key).orderBy("_t", "_event", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("_event") == 1, F.struct("_t", *values)), ignorenulls=True).over(past)
    found = marks.unionByName(seen).withColumn("_latest", latest).filter("_event = 0")
    return found.select(key, F.col("_t").alias("hour_us"), F.col("_latest._t").alias(f"{prefix}us"), *[F.col(f"_latest.{v}").alias(f"{prefix}{v}") for v in values])


def trailing_sets(hours: DataFrame, events: DataFrame, key: str, time: str, item: str, spans: dict[str, int]) -> DataFrame:
    """For each hour the distinct items of [hour - span, hour), for each span in hours, and of the hour itself.

    An item seen in an hour counts in the hours after it, until its span ends or it is seen again: it comes in
    with +1 and leaves with -1, and a running sum over these edges is the distinct count. So the work does not grow with
    the span. Items without an id are counted only in windows without any id.
    """
    seen = events.select(key, (hour_of(F.col(time)) / HOUR_US).cast("bigint").alias("h"), item)
    again = F.lead("h").over(Window.partitionBy(key, item).orderBy("h"))
    items = seen.filter(F.col(item).isNotNull()).distinct().withColumn("again", again)
    per_hour = seen.groupBy(key, "h").agg(F.count("*").alias("n"), F.countDistinct(item).alias("in_hour"))
    names = [f"{name}_{what}" for name in spans for what in ("ids", "rows")]

    def edge(at: Column, name: str, step: Column) -> Column:
        return F.struct(at.alias("h"), *[(step if c == name else F.lit(0)).cast("bigint").alias(c) for c in names])

    def edges(rows: DataFrame, what: str, step: Column, ends: dict[str, Column]) -> DataFrame:
        every = [x for name in spans for x in (edge(F.col("h") + 1, f"{name}_{what}", step), edge(ends[name] + 1, f"{name}_{what}", -step))]
        return rows.select(key, F.explode(F.array(*every)).alias("e")).select(key, "e.*")

    moves = edges(items, "ids", F.lit(1), {n: F.least("again", F.col("h") + s) for n, s in spans.items()}).unionByName(edges(per_hour, "rows", F.col("n"), {n: F.col("h") + s for n, s in spans.items()}))
    asked = hours.select(key, "hour_us").distinct().withColumn("h", (F.col("hour_us") / HOUR_US).cast("bigint"))
    sums = moves.unionByName(asked.drop("hour_us"), allowMissingColumns=True).groupBy(key, "h").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    past = Window.partitionBy(key).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    out = asked.join(sums.withColumns({c: F.sum(c).over(past) for c in names}), [key, "h"]).join(per_hour, [key, "h"], "left")
    counts = {name: F.when(F.col(f"{name}_ids") > 0, F.col(f"{name}_ids")).otherwise(F.col(f"{name}_rows")) for name in spans}
    counts["in_hour"] = F.when(F.col("in_hour") > 0, F.col("in_hour")).otherwise(F.coalesce("n", F.lit(0)))
    return out.select(key, "hour_us", *[c.cast("bigint").alias(name) for name, c in counts.items()])


def running_distinct(hours: DataFrame, events: DataFrame, key: str, time: str, item: str, name: str) -> DataFrame:
    """For each hour the distinct items of all events before it: a running count of first occurrences."""
    first = events.filter(F.col(item).isNotNull()).groupBy(key, item).agg(F.min(time).alias("t"))
    marks = [hours.select(key, F.col("hour_us").alias("t"), F.lit(0).alias("kind"), F.lit(0).alias("new"), F.lit(0).alias("any")), first.select(key, "t", F.lit(1), F.lit(1), F.lit(0)), events.select(key, F.col(time), F.lit(1), F.lit(0), F.lit(1))]
    past = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = marks[0].union(marks[1]).union(marks[2]).withColumn("ids", F.coalesce(F.sum("new").over(past), F.lit(0))).withColumn("rows", F.coalesce(F.sum("any").over(past), F.lit(0)))
    return rows.filter("kind = 0").select(key, F.col("t").alias("hour_us"), F.when(F.col("ids") > 0, F.col("ids")).otherwise(F.col("rows")).alias(name))


def best_match(pairs: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return pairs.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def allocate(rows: DataFrame, group: str, basis: Column, total: str, into: str, part: str | None = None) -> DataFrame:
    """Each row's share of the group's total by its positive basis; NULL where there is none.

    ``part`` is a column like the group that tells rows without group apart, so that these do not meet in one task.
    """
    positive = F.when(basis > 0, basis)
    whole = F.sum(positive).over(Window.partitionBy(part or group))
    return rows.withColumn(into, F.when(F.col(group).isNotNull() & (whole > 0), F.col(total) * positive / whole))
