"""What a question says of time: windows, states, anchors, order and enumeration, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import ascii_bounds

# Words and patterns that results depend on.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
ORDER = r"(?i)\b(before|after)\b|之前的?|之后的?|以后|以前"
CURRENT = r"(?i)\b(current|currently|latest|today|now)\b|当前|目前|现在|如今|今天"
HISTORICAL = r"(?i)\b(was|were|used to|historical|formerly|previously)\b|过去|以前|曾经|历史"
LAST_MONTH = ("last month", "previous month", "上个月", "上月")
LAST_WEEK = ("last week", "previous week", "上周")
LAST_YEAR = ("last year", "previous year", "去年", "上年")
YESTERDAY, TODAY = ("yesterday", "昨天"), ("today", "今天")
RECENT = ("recent", "lately", "最近", "近期")
EVOLVING = ("before", "previously", "used to", "changed", "change to", "originally", "earlier", "initially", "before that", "prior to", "evolve", "switched", "updated to", "before moving", "what was", "used to be")
PRESENT = ("currently", "current", "now", "latest", "right now", "as of", "present", "today", "recently", "updated", "last known", "what is now")
ENUMERATION = (
    r"(?i)\b(?:what\s+(?:thing|things|item|items|activity|activities|place|places|event|events|ways)|which\s+(?:thing|things|item|items|activity|activities|place|places|event|events|option|options|ones)|"
    r"how\s+(?:many|often)|all\s+the|every\s+time|list\s+(?:of|all|the|out|every|your|their|his|her|its|our|my|them|us|down))\b|哪些|几次|多少[^钱价金费]|每次|分别"
)
COMPARISON = r"(?i)\b(?:compare|comparison|difference\s+between)\b|\bwhich\b[^?!.]{0,80}\b(?:more|less|than)\b|比较|差异|哪个[^?。！？]{0,40}(?:更多|更少|较多|较少)"

_NAME = "(?i:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
#: Days, months and years by name, earlier ones first where two begin at one place; a bare year needs a word before it.
_DATE = (
    r"\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|20\d{2}年(?:\d{1,2}月\d{1,2}日?)?"
    rf"|\b\d{{1,2}}\s+{_NAME},?\s+20\d{{2}}\b|\b{_NAME}\s+\d{{1,2}},?\s+20\d{{2}}\b|\b{_NAME}\s+20\d{{2}}\b"
    r"|(?<=\b(?i:in|during|since|until|before|after|by|between)\s{0,9})\b20\d{2}\b|(?<=\b(?i:between)\s{1,9}20\d{2}\s{1,9}(?i:and)\s{0,9})\b20\d{2}\b"
)
_DATE, _ORDER, _CURRENT, _HISTORICAL = (ascii_bounds(p) for p in (_DATE, ORDER, CURRENT, HISTORICAL))
_MARK = "\x01"


def _says(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def resolution_mode(text: Column) -> Column:
    """window where a year is named, else evolution, current or degraded by the words of the question."""
    q = F.lower(F.trim(text))
    return F.when(q.rlike(ascii_bounds(r"\b(19|20)[0-9]{2}\b")), "window").when(_says(q, EVOLVING), "evolution").when(_says(q, PRESENT), "current").otherwise("degraded")


def enumerates(text: Column) -> Column:
    """Whether a question asks for all of many things, a count or a comparison."""
    return text.rlike(ascii_bounds(ENUMERATION)) | text.rlike(ascii_bounds(COMPARISON))


def _span(found: Column) -> Column:
    """First and last day that one match names; null days where there is no such date."""
    names = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, f"{v:02d}")])
    word = F.lower(F.regexp_extract(found, r"([A-Za-z]+)", 1))
    numbers = F.regexp_extract_all(found, F.lit(r"\d+"), F.lit(0))
    digits = F.size(numbers)
    year = F.when(word == "", F.element_at(numbers, 1)).otherwise(F.element_at(numbers, -1))
    month = F.when(word != "", F.try_element_at(names, word)).when(digits == 3, F.lpad(F.try_element_at(numbers, F.lit(2)), 2, "0")).otherwise("01")
    day = F.when((word == "") & (digits == 3), F.lpad(F.try_element_at(numbers, F.lit(3)), 2, "0")).when((word != "") & (digits == 2), F.lpad(F.element_at(numbers, 1), 2, "0")).otherwise("01")
    as_date = lambda d: F.to_date(F.try_to_timestamp(F.concat_ws("-", year, month, d), F.lit("yyyy-MM-dd")))
    # a day that its month does not have, before the month's name, leaves the month
    first = F.when((word != "") & (digits == 2) & as_date(day).isNull() & found.rlike(r"^\d"), as_date(F.lit("01"))).otherwise(as_date(day))
    whole_month = (word != "") & ((digits == 1) | as_date(day).isNull())
    last = F.when(whole_month, F.last_day(first)).when((word == "") & (digits == 1), F.date_sub(F.add_months(first, 12), 1)).otherwise(first)
    return F.struct(first.alias("first"), last.alias("last"))


def absolute_dates(text: Column) -> Column:
    """Sorted structs (first, last) of the days, months and years that a text names."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0)), _span)
    return F.array_sort(F.filter(spans, lambda d: d["first"].isNotNull()))


def anchor_name(text: Column) -> Column:
    """The name of an event as the words beside an order word give it."""
    t = F.trim(F.regexp_replace(F.trim(F.lower(text)), "^the ", ""))
    t = F.trim(F.regexp_replace(t, "^a ", ""))
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, " on$", "")), " at$", ""))
    return F.regexp_replace(t, r"^[ '.,?!？！，。、]+|[ '.,?!？！，。、]+$", "")


def temporal_window(text: Column, anchor: Column) -> Column:
    """The window that a question means, null where it has none.

    A struct of first and last (dates, both inclusive, null: open), intent (range, before, after, relative, current,
    historical), state (current, historical), entity (the event that an order word names, in lower case, may be empty),
    at (the date an order is relative to, where the question has it) and fuzzy (no anchor was given: the day of the
    run stands for it). Named dates come first, one alone with an order word being a bound; then order
    words that name an event, relative months, weeks, years and days, recent, current and historical words.
    """
    q, day = F.lower(text), F.to_date(F.coalesce(anchor, F.current_date()))
    fuzzy = anchor.isNull()
    dates, masked = absolute_dates(text), F.regexp_replace(text, _DATE, _MARK)
    order = F.nullif(F.regexp_extract(text, _ORDER, 0), F.lit(""))
    side = F.when(F.lower(order).isin("before", "以前") | order.startswith("之前"), "before").otherwise("after")
    first, last = F.array_min(F.transform(dates, lambda d: d["first"])), F.array_max(F.transform(dates, lambda d: d["last"]))
    none, blank = F.lit(None).cast("date"), F.lit(None).cast("string")
    at, mark = F.regexp_instr(masked, F.lit(_ORDER)), F.instr(masked, F.lit(_MARK))
    between = F.when(at < mark, F.substr(masked, at + F.length(order), mark - at - F.length(order))).otherwise(F.substr(masked, mark + 1, at - mark - 1))
    place = F.regexp_instr(text, F.lit(_ORDER))
    beside = anchor_name(F.when(order.startswith("之") | (order == "以后"), F.substr(text, F.lit(1), place - 1)).otherwise(F.substr(text, place + F.length(order), F.length(text))))

    def window(a, b, intent, state, entity=blank, when=none, blurred=F.lit(False)):
        name = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(a.cast("date").alias("first"), b.cast("date").alias("last"), name(intent).alias("intent"), name(state).alias("state"), entity.alias("entity"), when.alias("at"), blurred.alias("fuzzy"))

    relative = lambda a, b, state: window(a, b, "relative", state, blurred=fuzzy)
    one = order.isNotNull() & (F.size(dates) == 1)
    month, week, year = F.trunc(day, "month"), F.trunc(day, "week"), F.trunc(day, "year")
    state = F.when(text.rlike(_CURRENT) | ((last >= day) & ~text.rlike(_HISTORICAL)), "current").otherwise("historical")
    return (
        F.when(one & (side == "before"), window(none, F.date_sub(first, 1), "before", "historical", anchor_name(between), first))
        .when(one, window(F.date_add(last, 1), none, "after", "historical", anchor_name(between), last))
        .when(F.size(dates) > 0, window(first, last, "range", state))
        .when(order.isNotNull() & (order != "以前") & (beside != ""), window(none, none, side, "historical", beside))
        .when(_says(q, LAST_MONTH), relative(F.add_months(month, -1), F.date_sub(month, 1), "historical"))
        .when(_says(q, LAST_WEEK), relative(F.date_sub(week, 7), F.date_sub(week, 1), "historical"))
        .when(_says(q, LAST_YEAR), relative(F.add_months(year, -12), F.date_sub(year, 1), "historical"))
        .when(_says(q, YESTERDAY), relative(F.date_sub(day, 1), F.date_sub(day, 1), "historical"))
        .when(_says(q, TODAY), relative(day, day, "current"))
        .when(_says(q, RECENT), relative(F.date_sub(day, 30), day, "current"))
        .when(text.rlike(_CURRENT), window(none, none, "current", "current", blurred=fuzzy))
        .when(text.rlike(_HISTORICAL), window(none, none, "historical", "historical", blurred=fuzzy))
    )
