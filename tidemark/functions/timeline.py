"""Dates of conversations and phrases relative to them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.dates import add_months_overflow
from tidemark.functions.text import ascii_bounds

# Phrases that are resolved, and numbers in words.
RELATIVE = (
    r"(?i)\b(next|last|previous|following)\s+(day|week|month|year)\b|\b(\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(day|week|month|year)s?\s+(ago|later|earlier)\b"
    r"|\b(yesterday|tomorrow)\b"
)
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
LAYOUTS = ("d MMMM, yyyy", "d MMM, yyyy", "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
CATEGORIES = {
    1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial", 6: "single-session-user", 7: "single-session-assistant", 8: "multi-session",
    9: "temporal-reasoning", 10: "knowledge-update", 11: "abstention", 12: "single-session-preference",
}


def dataset_date(text: Column) -> Column:
    """A moment in one of the layouts that data sets have, after a leading "time on "; null otherwise."""
    t = F.trim(text)
    t = F.when(F.contains(t, F.lit(" on ")), F.substr(t, F.instr(t, " on ") + 4, F.length(t))).otherwise(t)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))
    named = lambda f: F.try_to_timestamp(t, F.lit(f))
    shapes = {"d MMMM, yyyy": r"^\d{1,2} [A-Za-z]+, \d{4}$", "d MMM, yyyy": r"^\d{1,2} [A-Za-z]{3}, \d{4}$", "MMMM d, yyyy": r"^[A-Za-z]+ \d{1,2}, \d{4}$", "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm": r"^\d{4}-\d\d-\d\d \d\d:\d\d$", "yyyy-MM-dd": r"^\d{4}-\d\d-\d\d$"}
    return F.coalesce(iso, *[F.when(t.rlike(shapes[f]), named(f)) for f in LAYOUTS])


def relative_date(text: Column, anchor: Column) -> Column:
    """What the one relative phrase of a text means from a date: a struct (at, phrase, unit); null with none or several.

    Units are day, month and year; weeks are days. Months and years beyond a month's end run over into the next.
    """
    found = F.regexp_extract_all(text, F.lit(ascii_bounds(RELATIVE)), F.lit(0))
    m = F.lower(F.trim(F.element_at(found, 1)))
    unit = F.regexp_extract(m, "(day|week|month|year)", 1)
    numbers = F.create_map(*[F.lit(x) for k, v in NUMBERS.items() for x in (k, v)])
    lead = F.regexp_extract(m, r"^(\S+)", 1)
    n = F.when(m.isin("yesterday", "tomorrow") | lead.isin("next", "last", "previous", "following"), 1).when(lead.rlike(r"^\d+$"), lead.cast("int")).otherwise(F.try_element_at(numbers, lead))
    back = lead.isin("last", "previous", "yesterday") | m.rlike("(ago|earlier)$")
    step = F.when(back, -n).otherwise(n)
    day = F.to_date(anchor)
    months = F.when(unit == "year", 12 * step).otherwise(step)
    at = F.when(unit.isin("month", "year"), add_months_overflow(day, months)).otherwise(F.date_add(day, (step * F.when(unit == "week", 7).otherwise(1)).cast("int")))
    kind = F.when(unit.isin("month", "year"), unit).otherwise("day")
    return F.when((F.size(found) == 1) & (n > 0) & anchor.isNotNull(), F.struct(at.alias("at"), m.alias("phrase"), kind.alias("unit")))


def span_text(days: Column, unit: Column) -> Column:
    """A number of days in words, as exact as the coarser unit of its ends."""
    n = F.abs(days)
    plural = lambda k, name: F.when(k == 1, f"1 {name}").otherwise(F.concat(k.cast("string"), F.lit(f" {name}s")))
    about = lambda k, name: F.concat(F.lit("about "), plural(k, name))
    return F.when(unit == "year", about(F.floor(n / 365), "year")).when(unit == "month", about(F.floor(n / 30), "month")).otherwise(plural(n, "day"))


def category_name(number: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.concat(F.lit("category-"), number.cast("string")))
