"""A file read once into good rows and rejected ones: reasons, the raw text, counts.

Lines are parsed permissively; what does not fit the header comes with its raw text in a corrupt-record column. Every
row carries its ``reasons``, so one pass writes both sides apart and counts them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import clean_text, derived_difficulty, lenient_double

#: What a queue file must have and may have, and other names of its columns (letters and digits only, lower case).
QUEUE_REQUIRED = ("preferred_machine_family", "material_code", "task_name", "quantity")
QUEUE_OPTIONAL = ("job_id", "task_difficulty", "urgency_label", "team_leader", "team_size", "hour_of_day", "last_maintenance_type")
QUEUE_NAMES = {
    "jobid": "job_id", "preferredmachinefamily": "preferred_machine_family", "machinefamily": "preferred_machine_family", "material": "material_code", "materialcode": "material_code", "task": "task_name", "taskname": "task_name",
    "taskdifficulty": "task_difficulty", "urgency": "urgency_label", "teamleader": "team_leader", "teamsize": "team_size", "hourofday": "hour_of_day", "lastmaintenancetype": "last_maintenance_type",
}
#: Pieces that a queue's quantities are rounded to, and rank of an urgency.
QUANTITY_STEP = 25.0
URGENCY_RANK = {"High": 3, "Medium": 2, "Low": 1}
RAW = "_raw_line"


def header_name(name: str, names: dict[str, str] = QUEUE_NAMES) -> str:
    """The column that a header means; an unknown one in lower case with underscores."""
    plain = name.strip().lstrip("﻿").lower()
    return names.get("".join(c for c in plain if c.isalnum()), plain.replace("/", "_").replace("-", "_").replace(" ", "_"))


@dataclass(frozen=True)
class Read:
    """Rows of a file as text columns under their meanings; ``missing`` required columns block it."""

    rows: DataFrame
    missing: tuple[str, ...]


def read_lines(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str], names: dict[str, str] = QUEUE_NAMES) -> Read:
    """A CSV file (or folder of files with one header) with the required and optional columns as text, and ``RAW``.

    ``RAW`` has the text of lines with more or fewer values than the header. Of two columns of one meaning the first counts;
    others are not kept, optional ones that are not there are NULL. Lines are parsed whole, as a pruned parse would not see their length.
    """
    header = spark.read.option("header", True).csv(path).columns
    means, taken = [], set()
    for i, h in enumerate(header):
        meaning = header_name(h, names)
        means.append(meaning if meaning not in taken else f"_again_{i}")
        taken.add(meaning)
    missing = tuple(c for c in required if c not in taken)
    schema = StructType([StructField(c, StringType()) for c in (*means, RAW)])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", RAW).csv(path)
    wanted = [F.col(f"`{c}`") if c in means else F.lit(None).cast("string").alias(c) for c in (*required, *optional)]
    return Read(rows.select(*wanted, RAW), missing)


def with_reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: the names of the rules that a row breaks, in their order. A rule that gives NULL is not broken."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def write_apart(tagged: DataFrame, path: str) -> dict[str, int]:
    """Write good and rejected rows into two folders in one pass; how many each has.

    The folders are ``rejected=false`` and ``rejected=true``; counts are taken while rows are written.
    """
    seen = Observation("rows")
    rows = tagged.withColumn("rejected", F.size("reasons") > 0).observe(seen, F.count("*").alias("all"), F.count_if(F.col("rejected")).alias("rejected"))
    rows.write.partitionBy("rejected").parquet(path)
    return {"accepted": seen.get["all"] - seen.get["rejected"], "rejected": seen.get["rejected"]}


def reject_counts(tagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rejected rows by reason; a row of several reasons counts for each."""
    return tagged.select(*by, F.explode("reasons").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n_rows"))


def urgency(c: Column) -> Column:
    low = F.lower(clean_text(c))
    return F.when(low.startswith("h"), "High").when(low.startswith("l"), "Low").otherwise("Medium")


def queue_reasons(rows: DataFrame) -> DataFrame:
    """Queue rows with the reasons against them: broken lines, missing names, quantities that are no positive number."""
    number = lenient_double(clean_text(F.col("quantity")))
    broken = F.col(RAW).isNotNull() if RAW in rows.columns else F.lit(False)
    missing = {f"missing_{c}": ~broken & clean_text(F.col(c)).isNull() for c in QUEUE_REQUIRED[:3]}
    return with_reasons(rows, {"broken_line": broken, **missing, "quantity_is_no_number": ~broken & number.isNull(), "quantity_not_positive": ~broken & (number <= 0)})


def normalised_queue(tagged: DataFrame, month: str, provenance: str = "Real-input pilot queue", mode: str = "real_input_queue_upload", machine: str = "uploaded_pending_queue") -> DataFrame:
    """The queue's columns of the rows that nothing speaks against.

    Quantities are rounded half to even to ``QUANTITY_STEP``; a job without an id is named by its place (``MAN-01`` in a file of one part).
    """
    place = (F.monotonically_increasing_id() + 1).cast("string")
    text = lambda c, default=None: F.coalesce(clean_text(F.col(c)), F.lit(default)) if default else clean_text(F.col(c))
    number = lambda c: lenient_double(clean_text(F.col(c)))
    label = urgency(F.col("urgency_label"))
    hour = F.bround(number("hour_of_day")).cast("int")
    out = tagged.withColumn("_named", F.concat(F.lit("MAN-"), F.when(F.length(place) < 2, F.lpad(place, 2, "0")).otherwise(place))).filter(F.size("reasons") == 0)
    return out.select(
        F.coalesce(text("job_id"), "_named").alias("job_id"), F.lit(provenance).alias("provenance_label"), F.lit(mode).alias("source_mode"), F.lit(month).alias("source_month"), F.lit(machine).alias("source_machine_id"), F.lit(None).cast("timestamp").alias("source_hour_ts"),
        text("preferred_machine_family").alias("preferred_machine_family"), text("material_code").alias("material_code"), text("task_name").alias("task_name"), F.coalesce(text("task_difficulty"), derived_difficulty(F.col("task_name"))).alias("task_difficulty"),
        (F.bround(number("quantity") / QUANTITY_STEP) * QUANTITY_STEP).alias("quantity"), label.alias("urgency_label"), F.when(label == "High", URGENCY_RANK["High"]).when(label == "Low", URGENCY_RANK["Low"]).otherwise(URGENCY_RANK["Medium"]).alias("urgency_rank"),
        text("team_leader", "unknown").alias("team_leader"), number("team_size").alias("team_size"), F.when(hour != 0, hour).otherwise(8).alias("hour_of_day"), text("last_maintenance_type", "unknown").alias("last_maintenance_type"),
    )


def load_queue(spark: SparkSession, path: str, month: str) -> tuple[DataFrame | None, DataFrame | None, str]:
    """(queue, rejected rows, message) of a queue file; no queue when it lacks a column, has no rows or none that is valid."""
    if not path.rstrip("/").lower().endswith(".csv"):
        return None, None, "unsupported file type; give a CSV export"
    read = read_lines(spark, path, QUEUE_REQUIRED, QUEUE_OPTIONAL)
    if read.missing:
        return None, None, "missing required columns: " + ", ".join(read.missing)
    tagged = queue_reasons(read.rows)
    counts = tagged.agg(F.count("*").alias("every"), F.count_if(F.size("reasons") > 0).alias("bad")).first()
    if not counts["every"]:
        return None, None, "the file has no rows"
    rejected = tagged.filter(F.size("reasons") > 0)
    if counts["bad"] == counts["every"]:
        return None, rejected, "no valid rows after validation"
    return normalised_queue(tagged, month), rejected, f"rejected rows: {counts['bad']}" if counts["bad"] else ""


# ---- quarantine ----
def unresolved(cleaned: DataFrame, family: str, identifiers: Sequence[str]) -> DataFrame:
    """(family, identifier, reason, n_rows): rows of a cleaned layer without a machine, by the first identifier that they have."""
    name = F.coalesce(*[clean_text(F.col(c)) for c in identifiers])
    rows = cleaned.filter("canonical_machine_id is null").select(name.alias("identifier"), F.col("resolution.reason").alias("reason"))
    return rows.groupBy("identifier", "reason").agg(F.count("*").alias("n_rows")).select(F.lit(family).alias("family"), "identifier", "reason", "n_rows")


def flagged(meters: DataFrame) -> DataFrame:
    """(month_key, quality_status, quality_flags, n_rows) of readings that are not ok."""
    return meters.filter("quality_status <> 'ok'").groupBy("month_key", "quality_status", "quality_flags").agg(F.count("*").alias("n_rows"))
