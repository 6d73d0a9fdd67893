"""Entity resolution: raw names to canonical ids through an alias registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(raw: Column, pattern: str) -> Column:
    """Upper-cased look-up keys in order: as it is, without white space, then every match of the pattern."""
    text = F.upper(F.trim(raw))
    bare = F.regexp_replace(text, r"\s+", "")
    found = F.concat(F.regexp_extract_all(text, F.lit(f"({pattern})")), F.regexp_extract_all(bare, F.lit(f"({pattern})")))
    return F.array_distinct(F.filter(F.concat(F.array(text, bare), found), lambda x: x != ""))


def alias_index(registry: DataFrame) -> DataFrame:
    """(system, alias) to canonical id. A key that names two ids raises an error when it is read."""
    rows = registry.select("system", "canonical_id", F.explode(F.array_union("aliases", F.array("canonical_id"))).alias("alias")).select("system", "canonical_id", F.upper(F.trim("alias")).alias("alias"))
    index = rows.groupBy("system", "alias").agg(F.min("canonical_id").alias("canonical_id"), F.countDistinct("canonical_id").alias("n"))
    clash = F.raise_error(F.concat(F.lit("alias names two ids: "), F.col("alias"))).cast("string")
    return index.select("system", "alias", F.when(F.col("n") > 1, clash).otherwise(F.col("canonical_id")).alias("canonical_id"))


def resolve(rows: DataFrame, raw: str, registry: DataFrame, system: str, pattern: str, key: str) -> DataFrame:
    """Adds ``canonical_id`` and ``matched_alias``: the system's own map first, then ``any``; first candidate wins.

    Only distinct raw names meet the registry; the registry is a small dimension, which Spark
    broadcasts by its size.
    """
    index = alias_index(registry).filter(F.col("system").isin(system, "any")).withColumn("rank", (F.col("system") == "any").cast("int"))
    names = rows.select(raw).distinct().select(raw, F.posexplode(candidates(F.col(raw), pattern)).alias("place", "alias"))
    hits = names.join(index, "alias").groupBy(raw).agg(F.min_by(F.struct("canonical_id", "alias"), F.struct("rank", "place")).alias("hit"))
    return rows.join(hits, raw, "left").select(*rows.columns, F.col("hit.canonical_id").alias("canonical_id"), F.col("hit.alias").alias("matched_alias"))


# ---- the whole registry: aliases by kind, exceptions, a chain of identifiers ----
#: What an alias is called that was found, by registry column, and the systems that look it up besides ``any``; a later one of the same key names the match.
ALIAS_KINDS = (
    ("canonical_id", "canonical_machine_id", ("jobs", "reports", "meters", "works")),
    ("job_id", "csi_machine_id", ("jobs",)),
    ("report_id", "mes_primary_resource", ("reports",)),
    ("asset_id", "maintenance_asset_id", ("works",)),
    ("legacy_id", "maintenance_legacy_id", ("works",)),
    ("report_aliases", "mes_secondary_alias", ("reports",)),
    ("meter_aliases", "energy_alias_example", ("meters",)),
)
#: Fixed value: the shapes of machine numbers inside longer text.
ID_SHAPES = (r"[Dd]-\d{3}-\d{3}", r"\d{3,4}-\d{3,5}", r"\d{3,4}\s*-\s*\d{3,5}")
REGISTRY = "canonical_id string, job_id string, report_id string, report_aliases array<string>, asset_id string, legacy_id string, meter_aliases array<string>, scope_status string"
EXCEPTIONS = "alias string, preferred_report_id string, issue string"


def lookup_key(c: Column) -> Column:
    """White space out, upper case; NULL without a character."""
    return F.nullif(F.upper(F.regexp_replace(c.cast("string"), r"\s+", "")), F.lit(""))


def lookup_keys(raw: Column) -> Column:
    """The look-up keys of an identifier in order: all of it, then every machine number in it; each once."""
    text = F.trim(raw.cast("string"))
    bare = F.regexp_replace(text, r"\s+", "")
    found = [F.regexp_extract_all(t, F.lit(f"({p})")) for p in ID_SHAPES for t in (text, bare)]
    return F.coalesce(F.array_distinct(F.array_compact(F.transform(F.concat(F.array(text), *found), lookup_key))), F.array().cast("array<string>"))


def registry_keys(registry: DataFrame) -> DataFrame:
    """(system, key, canonical_id, matched_on, matched_value, report_id, scope_status) of a registry of the columns ``REGISTRY``.

    A key that two machines have within a system is an error when it is read.
    """
    systems = lambda own: F.array(*map(F.lit, (*own, "any")))
    entry = lambda kind, own, at: lambda v, i: F.struct(F.trim(v).alias("value"), F.lit(kind).alias("matched_on"), systems(own).alias("systems"), (F.lit(at) + i * 1000).alias("place"))
    entries = []
    for n, (column, kind, own) in enumerate(ALIAS_KINDS):
        values = F.col(column) if column.endswith("aliases") else F.array(column)
        entries.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), entry(kind, own, n * 10_000_000)))
    meters = len(ALIAS_KINDS) - 1
    inner = F.flatten(F.transform(F.coalesce("meter_aliases", F.array().cast("array<string>")), lambda v, i: F.transform(F.filter(lookup_keys(v), lambda k: k != lookup_key(v)), lambda k, j: F.struct(k.alias("value"), F.lit("energy_extracted_id").alias("matched_on"), systems(("meters",)).alias("systems"), (F.lit(meters * 10_000_000 + 1) + i * 1000 + j).alias("place")))))
    rows = registry.select("canonical_id", "report_id", "scope_status", F.explode(F.concat(*entries, inner)).alias("e")).select("canonical_id", "report_id", "scope_status", "e.*")
    rows = rows.withColumn("key", lookup_key(F.col("value"))).filter("key is not null").withColumn("system", F.explode("systems"))
    last = F.max_by(F.struct("canonical_id", "matched_on", F.col("value").alias("matched_value"), "report_id", "scope_status"), "place")
    index = rows.groupBy("system", "key").agg(last.alias("hit"), F.countDistinct("canonical_id").alias("n"))
    clash = F.raise_error(F.concat(F.lit("alias names two machines: "), F.col("key"))).cast("string")
    return index.select("system", "key", F.when(F.col("n") > 1, clash).otherwise(F.col("hit.canonical_id")).alias("canonical_id"), "hit.matched_on", "hit.matched_value", "hit.report_id", "hit.scope_status")


def resolve_chain(rows: DataFrame, steps: Sequence[str], registry: DataFrame, system: str, given: str | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """Adds ``canonical_machine_id`` and ``resolution`` to rows with several identifiers, the first of ``steps`` that is known wins.

    An identifier that is ``given`` as canonical wins without a look-up. For each step the keys of the identifier are looked up in
    order, in the system's own aliases, then in those of ``any``. All steps, keys and systems of the distinct identifiers meet the registry in one join.
    ``resolution`` has method (``given``, ``registry`` or ``unresolved``), step (0 is ``given``), matched_on, matched_value, exception_applied,
    preferred_report_id, issue, scope_status and reason (``no_identifier`` or ``not_found``). ``exceptions`` (columns ``EXCEPTIONS``) replace the report id of
    those matched by such an alias. Rows stay as they are, repeated ones too.
    """
    blank = F.nullif(F.trim(F.col(given).cast("string")), F.lit("")) if given else F.lit(None).cast("string")
    raw = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in steps]
    tagged = rows.withColumn("_given", blank).withColumn("_ids", F.when(F.col("_given").isNull(), F.to_json(F.array(*raw))))
    index = registry_keys(registry).filter(F.col("system").isin(system, "any"))
    asked = tagged.filter("_ids is not null").select("_ids", *[r.alias(f"_{i}") for i, r in enumerate(raw)]).distinct()
    asked = asked.select("_ids", F.posexplode(F.array(*[lookup_keys(F.col(f"_{i}")) for i in range(len(steps))])).alias("step", "keys")).select("_ids", "step", F.posexplode("keys").alias("place", "key"))
    hits = asked.join(index, "key")
    if exceptions is not None:
        known = exceptions.select(lookup_key(F.col("alias")).alias("key"), F.nullif(F.trim("preferred_report_id"), F.lit("")).alias("preferred"), "issue").filter("key is not null").groupBy("key").agg(F.max_by(F.struct("preferred", "issue"), F.struct("issue", "preferred")).alias("x"))
        hits = hits.join(known, "key", "left")
    else:
        hits = hits.withColumn("x", F.lit(None).cast("struct<preferred:string,issue:string>"))
    found = F.struct("canonical_id", (F.col("step") + 1).alias("step"), "matched_on", "matched_value", F.col("x").isNotNull().alias("exception_applied"), F.coalesce("x.preferred", "report_id").alias("preferred_report_id"), "x.issue", "scope_status")
    best = hits.groupBy("_ids").agg(F.min_by(found, F.struct("step", (F.col("system") == "any").cast("int"), "place")).alias("_hit"))
    out = tagged.join(best, "_ids", "left")
    hit, has = F.col("_hit"), F.col("_hit").isNotNull()
    method = F.when(F.col("_given").isNotNull(), "given").when(has, "registry").otherwise("unresolved")
    reason = F.when(F.col("_given").isNotNull() | has, None).when(F.array_max(F.array(*[F.length(r) for r in raw])) == 0, "no_identifier").otherwise("not_found")
    resolution = F.struct(method.alias("method"), F.when(F.col("_given").isNotNull(), 0).otherwise(hit["step"]).alias("step"), hit["matched_on"].alias("matched_on"), hit["matched_value"].alias("matched_value"), F.coalesce(hit["exception_applied"], F.lit(False)).cast("int").alias("exception_applied"), hit["preferred_report_id"].alias("preferred_report_id"), hit["issue"].alias("issue"), hit["scope_status"].alias("scope_status"), reason.alias("reason"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_given", hit["canonical_id"]).alias("canonical_machine_id"), resolution.alias("resolution"))


def read_registry(records: DataFrame) -> DataFrame:
    """A registry of ``REGISTRY`` columns from a sheet's rows; alias lists are split at ``|``, ``;`` or ``,``."""
    names = {"canonical_id": "canonical_machine_id", "job_id": "csi_machine_id", "report_id": "mes_primary_resource", "report_aliases": "mes_secondary_aliases", "asset_id": "maintenance_asset_id", "legacy_id": "maintenance_legacy_id", "meter_aliases": "energy_alias_examples", "scope_status": "scope_status"}
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[|;,]"), lambda x: F.trim(x)), lambda x: x != "")
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c in records.columns else F.lit(None).cast("string")
    return records.select([(parts(text(c)) if k.endswith("aliases") else text(c)).alias(k) for k, c in names.items()]).filter("canonical_id is not null")
