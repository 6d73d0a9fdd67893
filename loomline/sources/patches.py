"""Patching some columns of some rows of a partitioned table; partitions without such a row keep their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import merged_flags
from ..scratch import once
from .sinks import replace_months


def patched(rows: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], flags: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``columns`` of ``changes`` where a key has a change; a NULL there is a value.

    ``flags`` is a JSON map: its keys in ``drop`` leave the old text, those of the change are laid over it, the result is sorted by key.
    A key that has two changes is an error when it is read. Rows without a change stay as they are, their flags' text too.
    """
    names = [*columns, *([flags] if flags else [])]
    clash = F.raise_error(F.concat(F.lit("two changes of "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    one = changes.groupBy(*keys).agg(F.first(F.struct(*names)).alias("_new"), F.count("*").alias("_n")).select(*keys, F.when(F.col("_n") > 1, clash.cast("string")).otherwise(F.lit("")).alias("_once"), "_new")
    both = rows.join(one, list(keys), "left")
    hit = F.col("_once") == ""
    value = {c: F.when(hit, F.col(f"_new.`{c}`")).otherwise(F.col(c)) for c in columns}
    if flags:
        value[flags] = F.when(hit, merged_flags(F.col(flags), F.col(f"_new.`{flags}`"), drop)).otherwise(F.col(flags))
    kept = {f.name: f.dataType for f in rows.schema}
    return both.select([value[c].cast(kept[c]).alias(c) if c in value else F.col(c) for c in rows.columns])


def patch_table(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], month: str = "period", flags: str | None = None, drop: Sequence[str] = ()) -> dict[str, int]:
    """Patch a table partitioned by ``month`` in place; ``changes`` has that column too. Rows and months that were touched.

    Only months that have a change are read, patched into the shared folder and swapped in; the others' files are
    not opened. The same changes may be made again after a lost run: they give the same rows.
    """
    fresh = once(changes, "changes")
    found = spark.read.parquet(path).schema
    table = spark.read.schema(", ".join(f"`{f.name}` {'string' if f.name == month else f.dataType.simpleString()}" for f in found)).parquet(path)
    months = [r[0] for r in fresh.select(month).distinct().collect()]
    touched = table.filter(F.col(month).isin(months)) if months else table.limit(0)
    rows = once(patched(touched, fresh, [*keys, month], columns, flags, drop), "patched")
    hits = touched.join(fresh.select(*keys, month), [*keys, month], "left_semi").count()
    if hits:
        replace_months(rows, path, month)
    return {"rows": hits, "months": len(months)}


def scope(start: str | int | None, end: str | int | None, column: str = "hour_us") -> Column:
    """Rows of [start, end); an end that is None is open."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(column) >= start)
    if end is not None:
        inside = inside & (F.col(column) < end)
    return inside
