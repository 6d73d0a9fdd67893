"""Tables whose versions are swapped together: stage, check what was staged, publish, roll back.

A folder has a manifest and, for each table, a sub-folder for each staged version. A version's files never change. The manifest is a
table of commits that is only ever added to, one row (one file) for each: it names the path of every table. Spark's committer moves that
file into place at the end, so readers see all tables of a commit or none. What was staged and never published is invisible.
One writer at a time is assumed; a second one's commit with the same number is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import first_seen

_COMMITS = "number bigint, run string, tables map<string,string>, note string, at timestamp"


class Refused(ValueError):
    """A staged version did not pass its checks; ``counts`` has what each check found."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(", ".join(f"{k}: {v}" for k, v in counts.items() if v))
        self.counts = counts


@dataclass(frozen=True)
class Versions:
    """The versioned tables of a folder."""

    spark: SparkSession
    root: str

    def _commits(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _COMMITS)
        return self.spark.read.schema(_COMMITS).parquet(f"{self.root}/manifest")

    def history(self) -> DataFrame:
        return self._commits().orderBy("number")

    def head(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        """Number and paths of a commit, the newest by default; (0, {}) before the first."""
        rows = self._commits() if number is None else self._commits().filter(F.col("number") == number)
        found = rows.orderBy(F.desc("number"), "run").first()
        if found is None and number is not None:
            raise ValueError(f"no commit {number}")
        return (found["number"], dict(found["tables"])) if found else (0, {})

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as of a commit, the newest by default."""
        tables = self.head(number)[1]
        if table not in tables:
            raise ValueError(f"no table {table}")
        return self.spark.read.parquet(tables[table])

    def tables(self) -> list[str]:
        return sorted(self.head()[1])

    def stage(self, table: str, rows: DataFrame, by: Sequence[str] = ()) -> str:
        """Write a new version of a table and return its path; nobody reads it yet."""
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(path)
        return path

    def publish(self, staged: dict[str, str], run: str, note: str = "") -> int:
        """Make staged versions the current ones, all at once; other tables stay as they are. The commit's number."""
        before, tables = self.head()
        row = self.spark.createDataFrame([(before + 1, run, tables | staged, note)], "number bigint, run string, tables map<string,string>, note string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        if self._commits().filter(F.col("number") == before + 1).count() > 1 and self.head(before + 1)[1] != tables | staged:
            raise RuntimeError(f"another writer published commit {before + 1}")
        return before + 1

    def roll_back(self, number: int, run: str) -> int:
        """A new commit with the tables of an older one; the commits between stay readable."""
        tables = self.head(number)[1]
        return self.publish(tables, run, f"rolled back to {number}")

    def replace_guarded(self, table: str, rows: DataFrame, checks: Callable[[DataFrame, DataFrame], dict[str, int]], run: str) -> int:
        """Stage ``rows``, check the staged files against the current version, publish if every count is 0, else ``Refused``."""
        before = self.read(table)
        path = self.stage(table, rows)
        counts = checks(before, self.spark.read.parquet(path))
        if any(counts.values()):
            raise Refused(counts)
        return self.publish({table: path}, run, f"replaced {table}")


def replacement_report(before: DataFrame, after: DataFrame, keys: Sequence[str], group: str, quantities: Sequence[str], others: Sequence[str], allowed: Column, expected: dict[str, int] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(rule, n): what must be 0 before ``after`` may take the place of ``before``.

    ``quantities`` may change where ``allowed`` (a condition on the row before) holds; ``others`` may not change at all. Rules: keys that are there
    twice after, gone or new rows, changes out of scope, changed other columns, negative quantities, groups that are gone, groups
    whose quantities are not conserved, totals apart, and, for each entry of ``expected``, how far the rows before are from the count that
    the caller saw (``rows``, ``allowed``, ``groups``). NULL counts as 0 in sums and differs from values elsewhere.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    old = before.select(*keys, F.col(group).alias("_group"), allowed.alias("_allowed"), F.lit(1).alias("_old"), *[F.col(c).alias(f"_b_{c}") for c in (*quantities, *others)])
    new = after.groupBy(*keys).agg(F.count("*").alias("_copies"), *[F.first(c).alias(f"_a_{c}") for c in (*quantities, *others)])
    both = old.join(new, list(keys), "full")
    differs = lambda c: ~F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}"))
    any_of = lambda tests: F.coalesce(F.array_max(F.array(*tests)), F.lit(False)) if tests else F.lit(False)
    matched = F.col("_old").isNotNull() & F.col("_copies").isNotNull()
    rows = {
        "repeated_key": F.col("_copies") > 1,
        "gone_row": F.col("_copies").isNull(),
        "new_row": F.col("_old").isNull(),
        "changed_out_of_scope": matched & ~F.coalesce("_allowed", F.lit(False)) & any_of([differs(c) for c in quantities]),
        "changed_other_column": matched & any_of([differs(c) for c in others]),
        "negative": any_of([zero(f"_a_{c}") < 0 for c in quantities]),
    }
    sums = {f"{side}{c}": F.sum(zero(f"{side}{c}")).alias(f"{side}{c}") for c in quantities for side in ("_b_", "_a_")}
    counted = both.groupBy("_group").agg(*[F.count_if(t).alias(name) for name, t in rows.items()], *sums.values(), F.count("_old").alias("rows"), F.count_if(F.col("_allowed")).alias("allowed"), F.count("_copies").alias("_left"))
    apart = any_of([F.abs(F.col(f"_b_{c}") - F.col(f"_a_{c}")) > tolerance for c in quantities])
    named = F.col("_group").isNotNull()
    total = counted.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rows],
        F.count_if(named & (F.col("rows") > 0) & (F.col("_left") == 0)).alias("gone_group"),
        F.count_if(named & apart).alias("group_not_conserved"),
        *[(F.abs(F.coalesce(F.sum(f"_b_{c}") - F.sum(f"_a_{c}"), F.lit(0.0))) > tolerance).cast("bigint").alias(f"total_of_{c}") for c in quantities],
        *[F.abs(F.coalesce(F.sum(c), F.lit(0)) - F.lit(n)).alias(f"drift_of_{c}") for c, n in (expected or {}).items() if c != "groups"],
        *[F.abs(F.count_if(named & (F.col("rows") > 0)) - F.lit(n)).alias("drift_of_groups") for c, n in (expected or {}).items() if c == "groups"],
    )
    return total.unpivot([], [c for c in total.columns], "rule", "n").select("rule", F.col("n").cast("bigint").alias("n"))


# ---- one run's tables together ----
def system_rows(matches: DataFrame, partial: DataFrame) -> DataFrame:
    """(machine_id, system, three_way) of a run: ``matches`` has machine_id, job_id, report_id; ``partial`` has (machine_id, system)."""
    of = lambda c, system: F.struct(F.col(c).alias("machine_id"), F.lit(system).alias("system"))
    full = matches.select(F.explode(F.array(of("machine_id", "energy"), of("job_id", "jobs"), of("report_id", "reports"))).alias("x")).select("x.*")
    seen = full.unionByName(partial.select("machine_id", "system")).filter("machine_id is not null").distinct()
    matched = matches.select("machine_id").distinct().withColumn("three_way", F.lit(1))
    return seen.join(matched, "machine_id", "left").withColumn("three_way", F.coalesce("three_way", F.lit(0)))


def month_replaced(old: DataFrame | None, rows: DataFrame, month: str, column: str = "month") -> DataFrame:
    """``rows`` under a month in place of those that ``old`` has of it."""
    fresh = rows.withColumn(column, F.lit(month))
    return fresh if old is None else old.filter(F.col(column) != month).unionByName(fresh, allowMissingColumns=True)


def inventory(old: DataFrame | None, seen: DataFrame, month: str) -> DataFrame:
    """(machine_id, system, first_seen, last_seen, active): first stamps stay, what this run did not see is inactive."""
    fresh = seen.select("machine_id", "system").distinct().select("machine_id", "system", F.lit(month).alias("first_seen"), F.lit(month).alias("last_seen"), F.lit(1).alias("active"))
    if old is None:
        return fresh
    key = F.concat_ws("\0", "system", "machine_id").alias("_key")
    kept = first_seen(old.select(key, "first_seen"), fresh.select("*", key), "_key", "first_seen").drop("_key")
    gone = old.join(fresh, ["machine_id", "system"], "left_anti").withColumn("active", F.when(F.col("last_seen") != month, 0).otherwise(F.col("active")))
    return kept.unionByName(gone)


def persist_run(store: Versions, month: str, run: str, sources: dict[str, DataFrame], matches: DataFrame, partial: DataFrame) -> int:
    """Publish one month's results under a run id: source rows, matches, inventory, presence and the run log, all or none.

    A month's source rows and presence replace those of an earlier run of it; first-seen stamps of matches and inventory stay.
    Nothing is published if any table fails to be written.
    """
    known = set(store.tables())
    old = lambda name: store.read(name) if name in known else None
    seen = system_rows(matches, partial)
    fresh = matches.select("machine_id", "job_id", "report_id").dropDuplicates(["machine_id"]).withColumns({"first_matched": F.lit(month), "last_confirmed": F.lit(month)})
    before = old("matches")
    if before is not None:
        kept = first_seen(before.select("machine_id", "first_matched"), fresh, "machine_id", "first_matched")
        fresh = kept.unionByName(before.join(kept, "machine_id", "left_anti"))
    three_way, every = matches.agg(F.countDistinct("machine_id")).first()[0], seen.agg(F.countDistinct("machine_id", "system")).first()[0]
    log = store.spark.createDataFrame([(run, month, three_way, every)], "run string, month string, three_way bigint, seen bigint").withColumn("run_at", F.current_timestamp())
    tables = {name: month_replaced(old(name), rows, month) for name, rows in sources.items()}
    tables |= {"matches": fresh, "inventory": inventory(old("inventory"), seen, month), "presence": month_replaced(old("presence"), seen, month)}
    runs_before = old("runs")
    order = F.lit(1) if runs_before is None else F.lit((runs_before.agg(F.max("display_order")).first()[0] or 0) + 1)
    tables["runs"] = log.withColumn("display_order", order) if runs_before is None else runs_before.unionByName(log.withColumn("display_order", order))
    return store.publish({name: store.stage(name, rows) for name, rows in tables.items()}, run, f"run of {month}")


def latest_presence(presence: DataFrame) -> DataFrame:
    """Each machine's newest month in each system and how many months it was there."""
    newest = F.row_number().over(Window.partitionBy("machine_id", "system").orderBy(F.desc("month")))
    months = F.count("*").over(Window.partitionBy("machine_id", "system"))
    return presence.select("machine_id", "system", "month", "three_way", newest.alias("_n"), months.alias("months")).filter("_n = 1").drop("_n")
