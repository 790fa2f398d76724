"""What evidence a question needs, and how far texts give it, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import ENTITY_STOP_WORDS, ascii_bounds, negated

# Words and patterns that results depend on.
TIME_MARKERS = {
    "after": "after", "before": "before", "between": "between", "since": "since", "until": "until", "last": "last", "next": "next", "today": "today",
    "yesterday": "yesterday", "tomorrow": "tomorrow", "之前": "before", "以后": "after", "之后": "after", "最近": "recent", "上个月": "last_month", "去年": "last_year",
}
STATE_MARKERS = {
    "latest": "latest", "current": "current", "currently": "current", "previous": "previous", "changed": "change", "change": "change", "conflict": "conflict",
    "最新": "latest", "当前": "current", "之前": "previous", "变化": "change", "冲突": "conflict",
}
STATE_EVIDENCE = {"current": ("current", "当前"), "latest": ("latest", "最新"), "previous": ("previous", "之前"), "change": ("chang", "变化"), "conflict": ("conflict", "冲突")}
COUNTS = (r"(?i)\b(?:list|top|first|last|give|name|show)\s+(\d+)\b", r"(?i)\b(\d+)\s+(?:items?|things?|cities|people|persons?|facts?|events?|places|names|reasons|examples|times)\b", r"(?:列出|给出|前|最近)([一二三四五六七八九十0-9]+)(?:个|条|项|位|次)")
CHINESE_NUMBERS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
SURNAMES = "张王李赵刘陈杨黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤"
CONNECTIVES = (" and then ", " then ", " also ", " versus ", " vs. ", " vs ")
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
TIME_OPERATORS = ("after", "before", "between", "since", "until", "last", "next", "recent", "last_month", "last_year")


def canonical(values: Column) -> Column:
    """Trimmed, without blanks and repeats, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, F.trim), lambda v: v != "")))


def marked(text: Column, markers: dict[str, str]) -> Column:
    """Sorted distinct names of the markers that a text contains, in lower case."""
    t = F.lower(text)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(k)), v) for k, v in markers.items()]))))


def entities(text: Column) -> Column:
    """Capitalised words that may be names, and Chinese names by their surnames; sorted."""
    words = F.regexp_extract_all(text, F.lit(ascii_bounds(r"\b\p{Lu}[\p{L}\p{M}'-]*\b")), F.lit(0))
    han = F.regexp_extract_all(text, F.lit(rf"[{SURNAMES}]\p{{IsHan}}"), F.lit(0))
    return canonical(F.concat(F.filter(words, lambda w: ~w.isin(*ENTITY_STOP_WORDS)), han))


def update_state(text: Column) -> Column:
    return F.array_join(marked(text, STATE_MARKERS), "|")


def time_constraints(text: Column) -> Column:
    return canonical(F.concat(F.regexp_extract_all(text, F.lit(ascii_bounds(ISO_DATE)), F.lit(0)), marked(text, TIME_MARKERS)))


def cardinality(text: Column) -> Column:
    """The number of things asked for, by the first pattern that gives one above 0; null without."""
    numbers = F.create_map(*[F.lit(x) for k, v in CHINESE_NUMBERS.items() for x in (k, v)])

    def count(pattern):
        found = F.regexp_extract(text, ascii_bounds(pattern), 1)
        n = F.when(found.rlike("^[0-9]{1,9}$"), found.cast("int")).otherwise(F.try_element_at(numbers, found))
        return F.when(n > 0, n)

    return F.coalesce(*[count(p) for p in COUNTS])


def operand(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), r"^[.,!?，。！？；;]+|[.,!?，。！？；;]+$", "")
    return F.lower(F.regexp_replace(t, r"\s+", " "))


def operands(text: Column) -> Column:
    """The things that a question names side by side: its sentences, or what the first connective separates; sorted."""
    blank = lambda o: F.trim(o) != ""
    segments = F.filter(F.transform(F.split(text, r"[?？;；]+"), operand), blank)
    t = F.lower(text)
    parts = segments
    for c in reversed(CONNECTIVES):
        parts = F.when(F.contains(t, F.lit(c)), F.filter(F.transform(F.split(t, c.replace(".", r"\.")), operand), blank)).otherwise(parts)
    return F.array_sort(F.array_distinct(F.when(F.size(segments) < 2, parts).otherwise(segments)))


def need(text: Column) -> Column:
    """All that a question explicitly asks for, as one struct."""
    return F.struct(entities(text).alias("entities"), time_constraints(text).alias("times"), operands(text).alias("operands"), cardinality(text).alias("count"), update_state(text).alias("state"))


def lexical_words(text: Column) -> Column:
    """Distinct runs of a-z, digits and ideographs of two or more, in lower case, without stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9一-龥]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda w: (F.length(w) > 1) & ~w.isin(*[s.lower() for s in ENTITY_STOP_WORDS])))


def supports(words: Column, name: Column) -> Column:
    """Whether any lexical word of a name is among a text's lexical words."""
    return F.arrays_overlap(words, lexical_words(name))


def has_time(text: Column) -> Column:
    t = F.lower(text)
    return text.rlike(ascii_bounds(ISO_DATE)) | t.rlike("today|yesterday|tomorrow") | text.rlike("[年月日]")


def state_met(state: Column, text: Column) -> Column:
    """Whether a text speaks of each of the states, joined by bars; an empty one is met by none."""
    t = F.lower(text)
    out = state != ""
    for name, words in STATE_EVIDENCE.items():
        said = F.contains(t, F.lit(words[0])) | F.contains(t, F.lit(words[1]))
        out = out & (~F.array_contains(F.split(state, r"\|"), name) | (said | negated(text) if name == "conflict" else said))
    return out


def coverage(n: Column, text: Column) -> Column:
    """How many entities, operands and states of a need a text has."""
    t, words = F.lower(text), lexical_words(text)
    named = F.size(F.filter(n["entities"], lambda e: F.contains(t, F.lower(e))))
    held = F.size(F.filter(n["operands"], lambda o: supports(words, o)))
    return named + held + state_met(n["state"], text).cast("int")


def lexical_overlap(n: Column, text: Column) -> Column:
    """How many lexical words of a need's entities, times and operands a text has."""
    asked = F.flatten(F.transform(F.concat(n["entities"], n["times"], n["operands"]), lexical_words))
    return F.size(F.array_intersect(asked, lexical_words(text)))


def satisfied(n: Column, text: Column, sources: Column) -> Column:
    """Whether texts, joined by line ends, of that many sources have all that a need asks for."""
    t, words = F.lower(text), lexical_words(text)
    timely = F.forall(n["times"], lambda c: F.when(c.isin(*TIME_OPERATORS), has_time(text)).otherwise(F.contains(t, F.lower(c))))
    every = F.forall(n["entities"], lambda e: F.contains(t, F.lower(e))) & F.forall(n["operands"], lambda o: supports(words, o))
    return every & timely & (n["count"].isNull() | (sources >= n["count"])) & ((n["state"] == "") | state_met(n["state"], text))


def remaining_gap(n: Column, text: Column, timed: Column) -> Column:
    """The first thing that texts lack: a struct (kind, what), null where nothing is missing. timed: a source has a date."""
    t, words = F.lower(text), lexical_words(text)
    gap = lambda kind, what: F.when(what.isNotNull(), F.struct(F.lit(kind).alias("kind"), what.alias("what")))
    entity = F.try_element_at(F.filter(n["entities"], lambda e: ~F.contains(t, F.lower(e))), F.lit(1))
    day = F.try_element_at(F.filter(n["times"], lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()), F.lit(1))
    when = F.when((F.size(n["times"]) > 0) & ~has_time(text) & ~timed, day)
    second = F.try_element_at(F.filter(n["operands"], lambda o: ~supports(words, o)), F.lit(1))
    return F.coalesce(gap("entity", entity), gap("time_range", when), gap("second_operand", second))


def merged_need(base: Column, proposal: Column) -> Column:
    """The union of a need and a proposal that keeps all of it; null where the proposal drops or alters something."""
    keeps = lambda f: F.size(F.array_except(base[f], proposal[f])) == 0
    states = lambda x: F.filter(F.split(x, r"\|"), lambda s: s != "")
    legal = keeps("entities") & keeps("times") & keeps("operands") & base["count"].eqNullSafe(proposal["count"]) & (F.size(F.array_except(states(base["state"]), states(proposal["state"]))) == 0)
    both = [canonical(F.concat(base[f], proposal[f])).alias(f) for f in ("entities", "times", "operands")]
    return F.when(legal, F.struct(*both, base["count"].alias("count"), F.array_join(canonical(F.concat(states(base["state"]), states(proposal["state"]))), "|").alias("state")))
