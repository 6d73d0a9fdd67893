"""Column expressions: cleaning, lenient casts, guarded ratios, labels and scores."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .vocabulary import SPEEDS

#: Words that name a meter's component, and component words dropped from machine names.
COMPONENT_WORDS = {"main": ("主機", " MAIN"), "uv": ("UV",), "ir": ("IR",), "motor": ("馬達", "MOTOR")}


#: Words of components and sites that are taken out of a machine's name.
NAME_WORDS = ("主機", "馬達", "UV", "IR", "水冷", "Main", "六期", "四期", "UV上光機", "印刷機", "印刷机", "數碼印刷機", "印刷上光機", "IR+UV", "IR+水冷", "主機+水冷")


#: Words that name printing and finishing in a task.
PRINT_WORDS = ("印", "print")
FINISHING_WORDS = ("光", "uv", "油", "上光", "啞", "gp-led", "手感")


def clean_text(c: Column) -> Column:
    """Trimmed text; blank is NULL."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def has_value(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "") & (F.lower(F.trim(c.cast("string"))) != "nan")


def first_present(payload: Column, keys: Sequence[str], *columns: Column) -> Column:
    """The first value among JSON keys of the payload, then columns, that is not blank."""
    return F.coalesce(*[clean_text(F.get_json_object(payload, f"$['{k}']")) for k in keys], *[clean_text(c) for c in columns])


def lenient_double(c: Column) -> Column:
    out = c.cast("string").try_cast("double")
    return F.when(~F.isnan(out), out)


def lenient_int(c: Column) -> Column:
    return F.when(F.abs(lenient_double(c)) < 2.0**53, lenient_double(c)).cast("bigint")


def iso_text(c: Column) -> Column:
    """ISO text of what parses as a timestamp; other text as it is, trimmed."""
    return F.coalesce(F.date_format(F.try_to_timestamp(clean_text(c)), "yyyy-MM-dd'T'HH:mm:ss"), clean_text(c))


def meter_label(c: Column) -> Column:
    """Full-width forms folded to ASCII, white space collapsed."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    return F.trim(F.regexp_replace(F.translate(c, wide + "　", "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " "), r"\s+", " "))


def meter_component(label: Column) -> Column:
    """The component that the label names; several are a combo, a bare machine id is the total."""
    text = F.concat(F.lit(" "), F.upper(meter_label(label)))
    found = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w)), F.lit(name)) for name, words in COMPONENT_WORDS.items()]))
    return F.when(F.size(found) > 1, "combo").when(F.size(found) == 1, found[0]).when(text.rlike(r"\d{3,4}-\d{3,5}"), "aggregate_total").otherwise("unknown")


def parse_confidence(component: Column, machine: Column) -> Column:
    """``low`` without a component or a machine, ``medium`` for a total."""
    return F.when((component == "unknown") | machine.isNull(), "low").when(component == "aggregate_total", "medium").otherwise("high")


def order_suffix(c: Column) -> Column:
    """A number that a sheet wrote as ``12.0`` is ``12``."""
    return F.regexp_replace(clean_text(c), r"^(\d+)\.0$", "$1")


def team_size_of_manpower(c: Column) -> Column:
    return F.when(c > 0, F.bround(c.cast("double")))


def team_size_of_roster(leader: Column, members_json: Column) -> Column:
    members = F.from_json(members_json, "array<string>")
    n = F.coalesce(F.size(F.filter(members, lambda x: clean_text(x).isNotNull())), F.lit(0))
    total = F.when(members.isNull(), 0).otherwise(n) + clean_text(leader).isNotNull().cast("int")
    return F.when(total > 0, total)


def task_difficulty(task: Column) -> Column:
    text = F.lower(task)
    printing, finishing = text.contains("print"), text.contains("finishing")
    return F.when(printing & (finishing | text.contains("+")), "Hard").when(printing, "Medium").when(finishing, "Easy")


def derived_difficulty(task: Column) -> Column:
    """Difficulty of a task from words of both languages; NULL without any."""
    text, low = clean_text(task), F.lower(clean_text(task))
    printing = text.contains(PRINT_WORDS[0]) | low.contains(PRINT_WORDS[1])
    finishing = F.exists(F.array(*map(F.lit, FINISHING_WORDS)), lambda w: low.contains(w))
    return F.when(printing & (text.contains("+") | finishing), "Hard").when(printing, "Medium").when(finishing, "Easy")


def shift_label(hour: Column) -> Column:
    return F.when(hour.between(7, 14), "Day").when(hour.between(15, 22), "Evening").otherwise("Night")


def machine_family(machine: Column) -> Column:
    return F.split_part(machine, F.lit("-"), F.lit(1))


def safe_divide(n: Column, d: Column) -> Column:
    """NULL unless the denominator is positive."""
    return F.when(d > 0, n / d)


def none_if_zero(c: Column) -> Column:
    return F.when(F.abs(c) >= 1e-9, c)


def machine_code(prefix: Column, suffix: Column) -> Column:
    """Three-digit prefix (a leading 1 of four digits goes) and suffix without the zeros of a long one."""
    head = F.when((F.length(prefix) == 4) & prefix.startswith("1"), F.substring(prefix, 2, 3)).otherwise(prefix)
    tail = F.when((F.length(suffix) == 5) & suffix.startswith("00"), F.substring(suffix, 3, 3)).otherwise(suffix)
    return F.concat_ws("-", F.lpad(head, 3, "0"), tail)


def machine_pattern(name: Column) -> Column:
    """The machine code in a name, component words and brackets ignored; NULL without one."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "|".join(sorted(map(re.escape, NAME_WORDS), key=len, reverse=True)), ""), r"[(（][^)）]*[)）]", ""))
    code = r"(\d{3,4})\s*-\s*(\d{3,5})"
    plain = r"^D-(\d{3})-(\d{3})$"
    prefix, suffix = (F.regexp_extract(text, code, i) for i in (1, 2))
    loose = r"^(\d{3,4})[-\s]+(\d{3,5})"
    return (
        F.when(text.rlike(plain), F.concat_ws("-", F.regexp_extract(text, plain, 1), F.regexp_extract(text, plain, 2)))
        .when(prefix != "", machine_code(prefix, suffix))
        .when(text.rlike(loose), machine_code(F.regexp_extract(text, loose, 1), F.regexp_extract(text, loose, 2)))
    )


def in_month(start: Column, end: Column, *stamps: Column) -> Column:
    """Whether any of the stamps is in [start, end)."""
    return F.exists(F.array(*stamps), lambda t: (t >= start) & (t < end))


def content_hash(columns: Sequence[str], *salt: Column) -> Column:
    """SHA-256 over sorted columns as JSON, so that it does not depend on column order."""
    return F.sha2(F.concat_ws("|", F.to_json(F.struct(*sorted(columns))), *salt), 256)


def merged_flags(old: Column, new: Column, drop: Sequence[str] = ()) -> Column:
    """JSON objects merged: keys in ``drop`` leave the old one, the new one wins; keys sorted."""
    kind = "map<string,string>"
    kept = F.map_filter(F.coalesce(F.from_json(old, kind), F.create_map().cast(kind)), lambda k, v: ~k.isin(list(drop) or [""]))
    fresh = F.coalesce(F.from_json(new, kind), F.create_map().cast(kind))
    both = F.map_concat(F.map_filter(kept, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))


def state_label(state: Column) -> Column:
    return F.coalesce(F.initcap(F.replace(state, F.lit("_"), F.lit(" "))), F.lit("Unknown"))


def idle_category(ts: Column) -> Column:
    """Why a machine may stand idle at that time; the first that fits."""
    h = F.hour(ts)
    return F.when(F.weekday(ts) >= 5, "weekend_idle").when(h < 7, "overnight_idle").when(h == 12, "lunch_idle").when(h.isin(7, 15, 23), "shift_change_idle").when(h.between(8, 17), "unexplained_working_idle").otherwise("evening_idle")


def valid_speed(speed: Column, machine: Column) -> Column:
    """Whether a speed lies in the range of the machine's family."""
    limits = F.create_map(*[x for k, (low, high) in SPEEDS.items() for x in (F.lit(k), F.array(F.lit(low), F.lit(high)))])
    own = F.coalesce(F.try_element_at(limits, machine_family(machine)), F.lit([*SPEEDS[""]]))
    return F.coalesce((speed > 0) & speed.between(own[0], own[1]), F.lit(False))


def first_max_label(scores: Sequence[Column], labels: Sequence[str], none: str = "no signal") -> Column:
    """Label of the first largest score; ``none`` when none is positive."""
    array = F.array(*scores)
    return F.when(F.array_max(array) > 0, F.element_at(F.array(*map(F.lit, labels)), F.array_position(array, F.array_max(array)).cast("int"))).otherwise(none)


def band(score: Column, high: float, mid: float, names: Sequence[str] = ("high", "medium", "low")) -> Column:
    return F.when(score >= high, names[0]).when(score >= mid, names[1]).otherwise(names[2])


def minmax(c: Column) -> Column:
    """Share of the way from the least to the largest value of the table; NULL and a flat column are 0.

    A spread under 1e-9 is noise of summation and counts as flat.
    """
    every = Window.partitionBy()
    low, high = F.min(c).over(every), F.max(c).over(every)
    return F.when(c.isNull() | (high - low <= 1e-9), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / F.when(high > low, high - low))))
