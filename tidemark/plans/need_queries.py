"""What questions ask for, and evidence compiled for them: questions made of ids and of conversations, against SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import intent, needs, timeline
from tidemark.functions.dates import at_granularity
from tidemark.functions.text import ENTITY_STOP_WORDS, sentence_rows
from tidemark.operators import compiler as C
from tidemark.plans.registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in ENTITY_STOP_WORDS) + "]"
_LOW = _STOP.lower()


def lex(x: str) -> str:
    """Lexical words in SQL."""
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9\\x{{4e00}}-\\x{{9fa5}}]+'), lambda w: length(w) > 1 AND NOT list_contains({_LOW}, w)))"


def words(x: str) -> str:
    """Number of words in SQL."""
    return f"len(list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))"


# questions about time, a form for each remainder of the id; the SQL works the windows out of the ids alone
_PARTS = "SELECT doc_id, doc_id % 14 AS k, CAST(2020 + doc_id % 5 AS INTEGER) AS y, CAST(doc_id % 12 + 1 AS INTEGER) AS m, CAST(doc_id % 28 + 1 AS INTEGER) AS d FROM documents"
_FORMS = (
    "What happened in {month} {y}?", "What happened before the conference on {y}-{mm}-{dd}?", "What happened after Alice's birthday on {d} {month} {y}?", "What happened between {y} and {next}?", "events of last month", "What did they do before the pottery class?",
    "previous week", "What was the job in {y}?", "What is the current job?", "reach 2048 in the game", "what did they do lately", "{month} {d}, {y} after the pottery class", "since {y}/{mm}/{dd} or in {next}", "where she used to live",
)


@query(f"""WITH p AS ({_PARTS}), x AS (SELECT *, make_date(y, m, d) AS day, make_date(y, m, 1) AS ms, last_day(make_date(y, m, 1)) AS me FROM p), w AS (SELECT doc_id, k,
 CASE k WHEN 0 THEN ms WHEN 2 THEN day + 1 WHEN 3 THEN make_date(y, 1, 1) WHEN 4 THEN DATE '2024-05-01' WHEN 6 THEN DATE '2024-06-03' WHEN 7 THEN make_date(y, 1, 1) WHEN 10 THEN DATE '2024-05-16' WHEN 11 THEN day + 1 WHEN 12 THEN day END AS first,
 CASE k WHEN 0 THEN me WHEN 1 THEN day - 1 WHEN 3 THEN make_date(y + 1, 12, 31) WHEN 4 THEN DATE '2024-05-31' WHEN 6 THEN DATE '2024-06-09' WHEN 7 THEN make_date(y, 12, 31) WHEN 10 THEN DATE '2024-06-15' WHEN 12 THEN make_date(y + 1, 12, 31) END AS last,
 CASE k WHEN 1 THEN 'before' WHEN 2 THEN 'after' WHEN 4 THEN 'relative' WHEN 5 THEN 'before' WHEN 6 THEN 'relative' WHEN 8 THEN 'current' WHEN 10 THEN 'relative' WHEN 11 THEN 'after' WHEN 13 THEN 'historical' ELSE 'range' END AS intent,
 CASE k WHEN 1 THEN 'conference' WHEN 2 THEN 'alice''s birthday' WHEN 5 THEN 'pottery class' WHEN 11 THEN '' END AS entity, CASE WHEN k IN (1, 2, 11) THEN day END AS "at" FROM x WHERE k <> 9)
SELECT doc_id, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, intent, CASE WHEN k IN (8, 10) THEN 'current' WHEN k IN (0, 3, 12) AND last >= DATE '2024-06-15' THEN 'current' ELSE 'historical' END AS state, entity, CAST("at" AS VARCHAR) AS "at" FROM w""")
def temporal_intent(t):
    d, k = t.documents.select("doc_id"), F.col("doc_id") % len(_FORMS)
    y, m, day = 2020 + F.col("doc_id") % 5, F.col("doc_id") % 12 + 1, F.col("doc_id") % 28 + 1
    parts = {"y": y, "next": y + 1, "month": F.date_format(F.make_date(F.lit(2024), m.cast("int"), F.lit(1)), "MMMM"), "mm": F.lpad(m.cast("string"), 2, "0"), "dd": F.lpad(day.cast("string"), 2, "0"), "d": day}
    text = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        out = F.lit(form)
        for name, value in parts.items():
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        text = F.when(k == i, out).otherwise(text)
    w = intent.temporal_window(F.col("question"), F.lit("2024-06-15").cast("date"))
    return d.withColumn("question", text).select("doc_id", w.alias("w")).where("w IS NOT NULL").select("doc_id", *[F.col(f"w.{c}").cast("string").alias(c) for c in ("first", "last", "intent", "state", "entity", "at")])


@query(r"""WITH q AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'in ' || (1990 + event_id % 40) || ' there was ' || event_type WHEN 1 THEN 'has the ' || event_type || ' switched' WHEN 2 THEN 'as of today ' || event_type WHEN 3 THEN 'how many of ' || event_type ELSE 'which ' || event_type || ' is more useful' END AS x, event_id % 5 AS k, event_id FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 'window' WHEN k = 1 THEN 'evolution' WHEN k = 2 THEN 'current' ELSE 'degraded' END AS mode, k >= 3 AS enumerates FROM q""")
def question_modes(t):
    k, kind = F.col("event_id") % 5, F.col("event_type")
    x = F.when(k == 0, F.concat(F.lit("in "), (1990 + F.col("event_id") % 40).cast("string"), F.lit(" there was "), kind)).when(k == 1, F.concat(F.lit("has the "), kind, F.lit(" switched"))).when(k == 2, F.concat(F.lit("as of today "), kind))
    x = x.when(k == 3, F.concat(F.lit("how many of "), kind)).otherwise(F.concat(F.lit("which "), kind, F.lit(" is more useful")))
    return t.events.select("event_id", x.alias("x")).select("event_id", intent.resolution_mode(F.col("x")).alias("mode"), intent.enumerates(F.col("x")).alias("enumerates"))


@query("""WITH x AS (SELECT event_id, CAST(ts AS DATE) AS day, event_id % 6 AS k, CAST(event_id % 11 + 1 AS INTEGER) AS n FROM events),
y AS (SELECT event_id, day, k, n, CASE k WHEN 0 THEN day + n WHEN 1 THEN day - 7 * n WHEN 2 THEN CAST(date_trunc('month', day) + to_months(n) AS DATE) + CAST(day(day) - 1 AS INTEGER) WHEN 3 THEN CAST(date_trunc('month', day) - to_months(12 * n) AS DATE) + CAST(day(day) - 1 AS INTEGER) WHEN 4 THEN day - 1 END AS "at" FROM x)
SELECT event_id, "at", CASE k WHEN 2 THEN 'month' WHEN 3 THEN 'year' ELSE 'day' END AS unit, CASE k WHEN 2 THEN strftime("at", '%B %Y') WHEN 3 THEN strftime("at", '%Y') ELSE day("at") || strftime("at", ' %B %Y') END AS text FROM y WHERE "at" IS NOT NULL""")
def relative_dates(t):
    n, k = (F.col("event_id") % 11 + 1).cast("string"), F.col("event_id") % 6
    x = F.when(k == 0, F.concat(n, F.lit(" days later"))).when(k == 1, F.concat(F.lit("it was "), n, F.lit(" Weeks ago"))).when(k == 2, F.concat(n, F.lit(" months later"))).when(k == 3, F.concat(n, F.lit(" years earlier"))).when(k == 4, "seen yesterday").otherwise("yesterday or tomorrow")
    r = t.events.select("event_id", timeline.relative_date(x, F.col("ts")).alias("r")).where("r IS NOT NULL")
    return r.select("event_id", "r.at", "r.unit", at_granularity(F.col("r.at"), F.col("r.unit")).alias("text"))


@query("""SELECT event_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events""")
def dataset_dates(t):
    at = lambda f: F.date_format("ts", f)
    words = F.when(F.col("event_id") % 2 == 0, F.concat(at("h:mm a"), F.lit(" on "), at("d MMMM, yyyy"))).otherwise(at("MMMM d, yyyy"))
    return t.events.select("event_id", timeline.dataset_date(at("yyyy-MM-dd HH:mm")).alias("minute"), timeline.dataset_date(words).alias("day"))


_NEED = rf"""need AS (SELECT conv_id, turn, text, list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b\p{{Lu}}[\p{{L}}\p{{M}}''-]*\b'), lambda w: NOT list_contains({_STOP}, w)))) AS entities FROM conversations)"""


@query(f"WITH {_NEED} SELECT conv_id, turn, array_to_string(entities, '|') AS entities FROM need")
def need_entities(t):
    return t.conversations.select("conv_id", "turn", F.array_join(needs.entities(F.col("text")), "|").alias("entities"))


_STATES = "['latest', 'current', 'previous', 'changed', 'change', 'conflict']"


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter({_STATES}, lambda m: contains(lower(text), m)), lambda m: CASE m WHEN 'changed' THEN 'change' ELSE m END))), '|') AS state,
array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'), list_filter(['after', 'before', 'between', 'since', 'until', 'last', 'next', 'today', 'yesterday', 'tomorrow'], lambda m: contains(lower(text), m))))), '|') AS times FROM conversations""")
def need_parse(t):
    return t.conversations.select("conv_id", "turn", needs.update_state(F.col("text")).alias("state"), F.array_join(needs.time_constraints(F.col("text")), "|").alias("times"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 9 + 1 WHEN 1 THEN event_id % 7 + 2 WHEN 2 THEN event_id % 10 + 1 END AS n FROM events WHERE event_id % 4 < 3""")
def need_cardinality(t):
    i, k = F.col("event_id"), F.col("event_id") % 4
    chinese = F.element_at(F.array(*[F.lit(c) for c in "一二三四五六七八九十"]), (i % 10 + 1).cast("int"))
    x = F.when(k == 0, F.concat(F.lit("please List "), (i % 9 + 1).cast("string"), F.lit(" of them"))).when(k == 1, F.concat(F.lit("the "), (i % 7 + 2).cast("string"), F.lit(" places seen"))).when(k == 2, F.concat(F.lit("列出"), chinese, F.lit("个"))).otherwise("list 0 of the 4 winds")
    return t.events.select("event_id", needs.cardinality(x).cast("long").alias("n")).where("n IS NOT NULL")


_OPERANDS = """ops AS (SELECT query_id, query, list_sort(list_distinct(CASE WHEN len(s) >= 2 THEN s ELSE list_filter(list_transform(string_split(lower(query), ' and then '), lambda x: regexp_replace(regexp_replace(trim(x), '^[.,!?;]+|[.,!?;]+$', '', 'g'), '[ \\t\\n]+', ' ', 'g')), lambda x: x <> '') END)) AS operands
FROM (SELECT query_id, query, list_filter(list_transform(regexp_split_to_array(query, '[?;]+'), lambda x: lower(regexp_replace(regexp_replace(trim(x), '^[.,!?;]+|[.,!?;]+$', '', 'g'), '[ \\t\\n]+', ' ', 'g'))), lambda x: x <> '') AS s FROM {asked}))"""


@query(f"WITH {_OPERANDS} SELECT query_id, array_to_string(operands, '|') AS operands FROM ops")
def need_operands(t):
    return t.asked.select("query_id", F.array_join(needs.operands(F.col("query")), "|").alias("operands"))


# coverage, overlap and order of every turn of a session for the session's question; the questions name no state or time
_SCORED = f"""{_OPERANDS}, ents AS (SELECT query_id, list_filter(list_distinct(regexp_extract_all(query, '\\b\\p{{{{Lu}}}}[\\p{{{{L}}}}\\p{{{{M}}}}''-]*\\b')), lambda w: NOT list_contains({_STOP}, w)) AS entities FROM {{asked}}),
src AS (SELECT session AS query_id, id AS source_id, ordinal + 1 AS rank, content FROM {{evidence}} WHERE state = 'active'),
asks AS (SELECT query_id, query, operands, entities, list_distinct(list_concat(flatten(list_transform(operands, lambda o: {lex("o")})), flatten(list_transform(entities, lambda e: {lex("e")})))) AS asked FROM ops JOIN ents USING (query_id))""".replace("{{", "{").replace("}}", "}")


def _score(x: str) -> str:
    return f"len(list_filter(entities, lambda e: contains(lower({x}), lower(e)))) + len(list_filter(operands, lambda o: len(list_intersect({lex('o')}, {lex(x)})) > 0))"


_ITEMS = f"""{_SCORED}, raw AS (SELECT query_id, source_id, rank, content, {_score("content")} AS coverage, len(list_intersect(asked, {lex("content")})) AS lexical FROM src JOIN asks USING (query_id)),
pieces AS (SELECT query_id, source_id, rank, content, generate_subscripts(p, 1) AS nth, unnest(p) AS piece FROM (SELECT *, regexp_extract_all(content, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$') AS p FROM src)),
cuts AS (SELECT *, sum(length(piece)) OVER (PARTITION BY source_id ORDER BY nth) - length(piece) AS begin, regexp_replace(piece, '^[ \\t\\n\\r]+', '') AS l FROM pieces),
sents AS (SELECT query_id, source_id, rank, CAST(begin + length(piece) - length(l) AS BIGINT) AS start, regexp_replace(l, '[ \\t\\n\\r]+$', '') AS sentence FROM cuts),
ext AS (SELECT s.query_id, source_id, rank, start, start + length(sentence) AS "end", sentence, {_score("sentence")} AS coverage, len(list_intersect(asked, {lex("sentence")})) AS lexical FROM sents s JOIN asks USING (query_id) WHERE sentence <> ''),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY coverage DESC, lexical DESC, start) AS own FROM ext) WHERE coverage > 0 OR lexical > 0 OR own = 1)"""


@query(f"WITH {_ITEMS} SELECT query_id, source_id, CAST(coverage AS BIGINT) AS coverage, CAST(lexical AS BIGINT) AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, lexical DESC, rank, source_id) AS nth FROM raw")
def need_coverage(t):
    raw, _ = C.items(t.asked, C.resolved(t.candidates, t.sources).where("found"))
    return raw.select("query_id", "source_id", F.col("coverage").cast("long").alias("coverage"), F.col("lexical").cast("long").alias("lexical"), F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {_ITEMS} SELECT query_id, source_id, start, "end", md5(sentence) AS text, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, lexical DESC, rank, source_id || ':' || start || ':' || "end") AS nth FROM kept""")
def extract_items(t):
    _, extracts = C.items(t.asked, C.resolved(t.candidates, t.sources).where("found"))
    return extracts.select("query_id", "source_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.col("text").cast("binary")).alias("text"), F.col("nth").cast("long").alias("nth"))


@query(r"""SELECT doc_id, "start", "start" + length(sentence) AS "end", md5(sentence) AS sentence FROM (SELECT doc_id, CAST(begin + length(piece) - length(l) AS BIGINT) AS "start", regexp_replace(l, '[ \t\n\r]+$', '') AS sentence FROM (
SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth) - length(piece) AS begin, regexp_replace(piece, '^[ \t\n\r]+', '') AS l FROM (
SELECT doc_id, generate_subscripts(p, 1) AS nth, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$') AS p FROM documents)))) WHERE sentence <> ''""")
def sentence_places(t):
    s = sentence_rows(t.documents, "doc_id", "text")
    return s.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.col("sentence").cast("binary")).alias("sentence"))


_CAP = 90
_COMPILED = f"""{_ITEMS}, statics AS (SELECT query_id, {words("query")} AS static FROM {{asked}}), whole AS (SELECT query_id, static + sum({words("content")} + 5) <= {_CAP} AS fits FROM raw JOIN statics USING (query_id) GROUP BY query_id, static),
lined AS (SELECT query_id, source_id, start, "end", sentence, {words("sentence")} + 5 AS size, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, lexical DESC, rank, source_id || ':' || start || ':' || "end") AS nth FROM kept),
fold AS (SELECT query_id, CAST(0 AS BIGINT) AS nth, CAST(static AS BIGINT) AS total, false AS taken FROM statics UNION ALL
 SELECT f.query_id, l.nth, CASE WHEN f.total + l.size <= {_CAP} THEN f.total + l.size ELSE f.total END, f.total + l.size <= {_CAP} FROM fold f JOIN lined l ON l.query_id = f.query_id AND l.nth = f.nth + 1),
bundle AS (SELECT query_id, 'raw' AS status, nth, source_id, content AS text, {words("content")} + 5 AS size FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, lexical DESC, rank, source_id) AS nth FROM raw) JOIN whole USING (query_id) WHERE fits
 UNION ALL SELECT l.query_id, 'extract', l.nth, source_id, sentence, size FROM lined l JOIN fold f USING (query_id, nth) JOIN whole w ON w.query_id = l.query_id WHERE taken AND NOT fits)"""


@query(f"""WITH RECURSIVE {_COMPILED} SELECT s.query_id, coalesce(any_value(status), 'impossible') AS status, count(b.nth) AS items, CAST(static + coalesce(sum(size), 0) AS BIGINT) AS input_tokens, coalesce(string_agg(DISTINCT source_id, ',' ORDER BY source_id), '') AS source_ids, md5(coalesce(string_agg(text, chr(10) ORDER BY nth), '')) AS said
FROM statics s JOIN (SELECT DISTINCT query_id FROM raw) r USING (query_id) LEFT JOIN bundle b ON b.query_id = s.query_id GROUP BY s.query_id, static""")
def evidence_bundles(t):
    b = C.compile_bundles(t.asked, t.candidates, t.sources, _CAP).where("status <> 'unavailable'")
    said = F.array_join(F.transform("kept", lambda x: x["text"]), "\n")
    return b.select("query_id", "status", F.size("kept").cast("long").alias("items"), "input_tokens", F.array_join("source_ids", ",").alias("source_ids"), F.md5(said.cast("binary")).alias("said"))


@query(f"""WITH RECURSIVE {_COMPILED}, said AS (SELECT query_id, string_agg(text, chr(10) ORDER BY nth) AS said FROM bundle GROUP BY 1), g AS (SELECT query_id, said, list_sort(list_filter(entities, lambda e: NOT contains(lower(said), lower(e)))) AS lost, list_filter(operands, lambda o: len(list_intersect({lex("o")}, {lex("said")})) = 0) AS open FROM said JOIN asks USING (query_id))
SELECT query_id, CASE WHEN len(lost) > 0 THEN 'entity' WHEN len(open) > 0 THEN 'second_operand' END AS kind, CASE WHEN len(lost) > 0 THEN lost[1] WHEN len(open) > 0 THEN open[1] END AS what, len(lost) = 0 AND len(open) = 0 AS satisfied FROM g""")
def evidence_gaps(t):
    b = C.compile_bundles(t.asked, t.candidates, t.sources, _CAP).where("status IN ('raw', 'extract')")
    return b.select("query_id", "gap.kind", "gap.what", "satisfied")


@query("""SELECT query_id, id, problem FROM (SELECT query_id, id, unnest(list_filter([CASE WHEN broken = 1 THEN 'kind' END, CASE WHEN broken = 2 THEN 'rank' END, CASE WHEN broken = 3 THEN 'digest' END, CASE WHEN broken = 4 THEN 'sources' END, CASE WHEN broken = 5 THEN 'score' END, CASE WHEN n > 6 THEN 'too many' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT session AS query_id, 'c' || ordinal AS id, (session * 3 + ordinal * 5) % 11 AS broken, count(*) OVER (PARTITION BY session) AS n FROM {evidence}))""")
def candidate_checks(t):
    kind = (F.col("query_id") * 3 + F.col("place") * 5) % 11
    c = t.candidates_all.withColumn("kind", F.when(kind == 1, "poem").otherwise(F.col("kind"))).withColumn("rank", F.when(kind == 2, 0).otherwise(F.col("rank")))
    c = c.withColumn("text_digest", F.when(kind == 3, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.upper("text_digest"))).withColumn("source_ids", F.when(kind == 4, F.array(F.lit("b"), F.lit("a"))).otherwise(F.col("source_ids"))).withColumn("score", F.when(kind == 5, float("nan")).otherwise(F.col("score")))
    return C.candidate_problems(c, 6)


@query("""WITH s AS (SELECT session, id, content, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS k, coalesce(state <> 'active', true) AS gone FROM {evidence}), a AS (SELECT session AS query_id, k AS nth, gone, k % 6 AS kind, length(content) AS n FROM s)
SELECT query_id, nth, CASE WHEN kind = 5 THEN 'unknown action' WHEN gone AND kind <> 2 THEN 'source' ELSE 'shape' END AS problem FROM a WHERE kind IN (2, 4, 5) OR gone OR (kind = 1 AND n < 12)""")
def action_checks(t):
    c = t.candidates_all
    k, n = F.row_number().over(Window.partitionBy("query_id").orderBy("place")), F.length("text")
    a = c.withColumn("k", k.cast("long"))
    kind = F.col("k") % 6
    a = a.select("query_id", F.col("k").alias("nth"), F.element_at(F.array(*[F.lit(x) for x in ("KEEP", "EXTRACT", "DROP", "FETCH_SOURCE", "KEEP", "STEAL")]), (kind + 1).cast("int")).alias("kind"), F.when(kind.isin(0, 2), F.col("id")).alias("candidate_id"), F.when(~kind.isin(0, 2), F.element_at("source_ids", 1)).alias("source_id"),
                 F.when(kind == 1, 2).alias("start"), F.when(kind == 1, 12).alias("end"), F.when(kind == 1, F.sha2(F.substring("text", 3, 10), 256)).alias("digest"), F.when(kind == 4, "why").alias("reason"))
    return C.action_problems(a, c, t.sources)


@query(f"""WITH RECURSIVE {_COMPILED}, s AS (SELECT DISTINCT query_id, b.source_id, content, ' ' || lower(content) || ' ' AS x FROM bundle b JOIN src USING (query_id, source_id)), n AS (SELECT *, contains(x, ' not ') OR contains(x, 'n''t') OR contains(x, ' no ') OR contains(x, ' never ') AS neg FROM s),
p AS (SELECT a.query_id, a.source_id AS "left", b.source_id AS "right", a.neg <> b.neg AS clash, {lex("a.content")} AS wa, {lex("b.content")} AS wb FROM n a JOIN n b ON a.query_id = b.query_id AND a.source_id < b.source_id)
SELECT query_id, 'conflicts' AS kind, "left", "right", '' AS operand FROM p WHERE clash AND len(list_intersect(wa, wb)) >= 2 UNION ALL
SELECT query_id, 'supports_operand', "left", "right", operand FROM (SELECT p.*, unnest(operands) AS operand FROM p JOIN ops USING (query_id)) WHERE len(list_intersect({lex("operand")}, wa)) > 0 AND len(list_intersect({lex("operand")}, wb)) > 0""")
def evidence_relations(t):
    b = C.compile_bundles(t.asked, t.candidates, t.sources, _CAP).where("status IN ('raw', 'extract')")
    rows = b.select("query_id", F.explode("source_ids").alias("id")).join(t.sources.select("id", "content", "occurred_at"), "id").withColumnRenamed("id", "source_id")
    return C.relations(rows, t.asked)


@query("SELECT CAST(0 AS BIGINT) AS problems, count(DISTINCT session) AS bundles FROM {evidence} WHERE state = 'active'")
def bundle_checks(t):
    from tidemark.work import Work

    b = Work(t.spark, "bundles").write(C.compile_bundles(t.asked, t.candidates, t.sources, _CAP).where("status <> 'unavailable'"), "all")
    bad = C.bundle_problems(b, t.sources, _CAP).agg(F.count("*").alias("problems"))
    return bad.crossJoin(b.agg(F.count("*").alias("bundles")))  # one row each
