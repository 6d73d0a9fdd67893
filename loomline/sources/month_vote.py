"""Which month a source is of, by a vote of all its cells; which months have all their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years that a stamp or text is believed to name, votes and share of the largest month that settle a source.
YEARS, LEAST_VOTES, LEAST_SHARE = (2020, 2035), 3, 0.8
#: Names of months in text, by number.
MONTH_WORDS = {1: ("january", "jan"), 2: ("february", "feb"), 3: ("march", "mar"), 4: ("april", "apr"), 5: ("may",), 6: ("june", "jun"), 7: ("july", "jul"), 8: ("august", "aug"), 9: ("september", "sept", "sep"), 10: ("october", "oct"), 11: ("november", "nov"), 12: ("december", "dec")}
_WORDS = "|".join(sorted((w for words in MONTH_WORDS.values() for w in words), key=len, reverse=True))
#: Text such as ``Jul 2025``, and ``2025-07``, ``2025/7`` or ``2025年7月``.
WORD_YEAR = rf"(?i)({_WORDS})[\s_\-/.,]*(20\d{{2}})"
YEAR_NUMBER = r"(20\d{2})\s*[-/.年_]\s*(1[0-2]|0?[1-9])"


def month_number(word: Column) -> Column:
    """Number of a month's name; NULL for other text."""
    low, out = F.lower(word), F.lit(None).cast("int")
    for n, words in MONTH_WORDS.items():
        out = F.when(low.isin(*words), n).otherwise(out)
    return out


def _keys(text: Column, pattern: str, month: int, year: int, words: bool) -> Column:
    names, years = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (month, year))
    number = (lambda x: month_number(x)) if words else (lambda x: x.cast("int"))
    return F.zip_with(years, names, lambda y, m: F.concat_ws("-", y, F.lpad(number(m).cast("string"), 2, "0")))


def months_in(text: Column) -> Column:
    """All months that a text names, as ``yyyy-MM``, repeats included."""
    return F.coalesce(F.concat(_keys(text, WORD_YEAR, 1, 2, True), _keys(text, YEAR_NUMBER, 2, 1, False)), F.array().cast("array<string>"))


def votes(cells: DataFrame, source: str, texts: Sequence[str] = (), stamps: Sequence[str] = (), years: tuple[int, int] = YEARS) -> DataFrame:
    """(source, month, n): how often a source's cells name each month. Every cell counts; sums are made before the shuffle."""
    named = [months_in(F.col(c).cast("string")) for c in texts] + [F.array_compact(F.array(F.date_format(F.col(c).cast("timestamp"), "yyyy-MM"))) for c in stamps]
    rows = cells.select(F.col(source).alias("source"), F.explode(F.flatten(F.array(*named))).alias("month"))
    return rows.filter(F.substring("month", 1, 4).cast("int").between(*years)).groupBy("source", "month").agg(F.count("*").alias("n"))


def elected(counts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, month, status, confidence, n, total): the month that a source is of.

    One month alone is ``resolved`` (``high`` from three votes on, else ``medium``); so is (``medium``) one with at least three votes and four in five of all.
    Else it is ``ambiguous``, and ``unresolved`` for ``sources`` without a vote. Of equal counts the earlier month leads.
    """
    by = counts.groupBy("source").agg(F.max_by("month", F.struct("n", -F.regexp_replace("month", "-", "").cast("int"))).alias("best"), F.max("n").alias("n"), F.sum("n").alias("total"), F.count("*").alias("months"))
    if sources is not None:
        by = sources.select("source").distinct().join(by, "source", "left")
    clear = (F.col("n") >= LEAST_VOTES) & (F.col("n") / F.col("total") >= LEAST_SHARE)
    status = F.when(F.col("months").isNull(), "unresolved").when((F.col("months") == 1) | clear, "resolved").otherwise("ambiguous")
    confidence = F.when(F.col("months").isNull(), "none").when(F.col("months") == 1, F.when(F.col("n") >= LEAST_VOTES, "high").otherwise("medium")).when(clear, "medium").otherwise("low")
    return by.select("source", F.when(status == "resolved", F.col("best")).alias("month"), status.alias("status"), confidence.alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def month_readiness(present: DataFrame, required: Sequence[str], blocked: DataFrame | None = None) -> DataFrame:
    """(month, status, missing): of each month whether all ``required`` families are ``present`` (month, family).

    ``blocked`` months (month, note) are never ready. ``status`` is ready, missing_sources or blocked; ``missing`` in the order of ``required``.
    """
    by = present.groupBy("month").agg(F.collect_set("family").alias("families"))
    lacks = F.filter(F.array(*map(F.lit, required)), lambda f: ~F.array_contains("families", f))
    rows = by.withColumn("missing", F.array_join(lacks, ","))
    if blocked is not None:
        rows = rows.join(blocked.groupBy("month").agg(F.first("note").alias("note")), "month", "left")
    else:
        rows = rows.withColumn("note", F.lit(None).cast("string"))
    status = F.when(F.col("note").isNotNull(), "blocked").when(F.col("missing") == "", "ready").otherwise("missing_sources")
    return rows.select("month", status.alias("status"), "missing")
