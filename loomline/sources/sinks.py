"""Write modes: upsert by key, append of new rows, month replacement, deletion by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``newest``. An upsert is this over old and new rows together."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest]))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def new_rows(fresh: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key, with NULL as blank, is not there yet."""
    blank = lambda df: [F.coalesce(df[k].cast("string"), F.lit("")).alias(f"_{k}") for k in keys]
    known = existing.select(*blank(existing)).distinct()
    tagged = fresh.select("*", *blank(fresh))
    return tagged.join(known, [f"_{k}" for k in keys], "left_anti").select(fresh.columns)


def first_seen(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """New state rows that keep the stamp at which their key was first seen."""
    before = old.select(key, F.col(stamp).alias("_first"))
    return new.join(before, key, "left").withColumn(stamp, F.coalesce("_first", stamp)).select(new.columns)


def replace_months(rows: DataFrame, path: str, month: str = "month_key", files: int = 16) -> None:
    """Overwrite the months that ``rows`` has; other months stay. Needs no read of the table.

    A month goes to up to ``files`` tasks by a hash of its rows; a file has ten million rows at most.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c != month and not rows.schema[c].dataType.typeName() == "map"]
    rows.repartition(F.col(month), F.pmod(F.xxhash64(*others), F.lit(files))).write.option("maxRecordsPerFile", 10_000_000).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def upsert(rows: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], version: int) -> str:
    """Merge into the table's next version; returns its path. The version that is read stays whole meanwhile."""
    spark: SparkSession = rows.sparkSession
    old = f"{path}/v{version}"
    every = spark.read.parquet(old).unionByName(rows, allowMissingColumns=True) if version else rows
    keep_latest(every, keys, newest).write.parquet(f"{path}/v{version + 1}")
    return f"{path}/v{version + 1}"


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def export_csv(rows: DataFrame, path: str) -> dict[str, object]:
    """CSV files with a header and a manifest of what they hold."""
    rows.write.mode("overwrite").option("header", True).csv(path)
    return {"path": path, "columns": rows.columns, "rows": rows.count()}
