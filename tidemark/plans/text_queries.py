"""Text, date and digest functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, text as T
from tidemark.plans.registry import query


@query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS norm FROM documents")
def text_normal_form(t):
    return t.documents.select("doc_id", F.md5(T.normal_form(F.coalesce("text", F.lit(""))).cast("binary")).alias("norm"))


@query(r"""SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, array_to_string(list_sort(list_distinct(w))[1:5], ' ') AS first_words
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS w FROM conversations)""")
def text_words(t):
    rows = t.conversations.withColumn("w", T.words("text"))
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.array_join(F.slice(F.sort_array(F.array_distinct("w")), 1, 5), " ").alias("first_words"))


@query(r"""SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS BIGINT) AS n_grams
FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) >= 3)""")
def text_char_grams(t):
    rows = t.documents.select("doc_id", F.col("text").alias("x")).where(F.length("x") >= 3)
    return rows.select("doc_id", F.size(T.char_grams("x")).cast("long").alias("n_grams"))


@query(r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{Nd}_''-]+'), lambda w: regexp_matches(w, '^\p{Lu}[\p{L}\p{M}''-]*$') AND NOT list_contains(['A','An','And','Are','Can','Did','Do','Does','For','Give','How','In','Is','List','Name','Show','The','Then','To','What','When','Where','Which','Who','Why'], w)), ' ') AS names
FROM documents""")
def text_capitalised(t):
    return t.documents.select("doc_id", F.array_join(T.capitalised("text"), " ").alias("names"))


@query(r"SELECT doc_id, trim(substr(trim(regexp_replace(lower(text), '[^a-z0-9\p{Han}]+', '-', 'g'), '-'), 1, 40), '-') AS slug FROM documents")
def text_slug(t):
    return t.documents.select("doc_id", T.slug("text").alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '...' END AS snippet FROM documents")
def text_snippet(t):
    return t.documents.select("doc_id", T.snippet("text").alias("snippet"))


@query(r"""SELECT doc_id, CASE WHEN length(x) <= 80 THEN x ELSE substr(x, 1, 79) || '…' END AS line
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM documents)""")
def text_one_line(t):
    return t.documents.select("doc_id", T.one_line("text", 80).alias("line"))


@query(r"""SELECT doc_id, pos, sentence FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (
 SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$'), lambda x: regexp_replace(x, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), lambda x: x <> '') AS s FROM documents))""")
def sentence_spans(t):
    return t.documents.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(r"""SELECT conv_id, turn, contains(x, ' not ') OR contains(x, 'n''t') OR contains(x, ' no ') OR contains(x, ' never ') AS negated,
 trim(lower(text)) = '' OR contains(lower(text), 'don''t know') OR contains(lower(text), 'do not know') OR contains(lower(text), 'not mentioned') OR contains(lower(text), 'no information') AS unknown
FROM (SELECT *, ' ' || lower(text) || ' ' AS x FROM conversations)""")
def text_markers(t):
    return t.conversations.select("conv_id", "turn", T.negated("text").alias("negated"), T.unknown_answer("text").alias("unknown"))


@query("SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha256('42:' || doc_id), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE < 0.15 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_assignment(t):
    return t.documents.select("doc_id", T.split_of("doc_id", "42").alias("split"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k, sha256(props) AS digest FROM events")
def json_props(t):
    return t.events.select("event_id", F.get_json_object(T.json_object("props"), "$.k").cast("long").alias("k"), F.sha2("props", 256).alias("digest"))


@query("""SELECT name, char_count <= 1200 AS content_ok, length(trigger) <= 120 AND NOT contains(trigger, chr(10)) AND NOT contains(trigger, chr(13)) AS trigger_ok FROM {entries}""")
def entry_budgets(t):
    return t.entries.select("name", (F.col("char_count") <= 1200).alias("content_ok"), ((F.length("trigger") <= 120) & ~F.col("trigger").rlike(r"[\r\n]")).alias("trigger_ok"))


@query(r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email, regexp_matches(text, '[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}') AS phone FROM documents""")
def personal_data(t):
    return t.documents.select("doc_id", F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("email"), F.col("text").rlike(r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}").alias("phone"))


@query(r"""SELECT doc_id, CAST(i AS BIGINT) AS nth, substr(text, CAST(i * 900 + 1 AS INTEGER), 900) AS piece FROM documents, range(0, CAST(ceil(length(text) / 900.0) AS BIGINT)) r(i) WHERE length(text) > 0""")
def slices_900(t):
    n = F.ceil(F.length("text") / 900).cast("int")
    rows = t.documents.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select("doc_id", F.col("i").cast("long").alias("nth"), F.expr("substr(text, i * 900 + 1, 900)").alias("piece"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r]+', ' ', 'g')) AS title,
 CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS n_text FROM pages""")
def page_sections(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\n\r]+", " ")).alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n_text"))


@query("""SELECT event_id, date_trunc('day', ts) AS day, date_trunc('week', ts) AS week, date_trunc('month', ts) AS month,
 CAST(date_trunc('month', ts) + INTERVAL 1 MONTH + to_days(CAST(day(ts) - 1 AS INTEGER)) AS DATE) AS next_month FROM events""")
def date_bounds(t):
    return t.events.select("event_id", F.date_trunc("day", "ts").alias("day"), F.date_trunc("week", "ts").alias("week"), F.date_trunc("month", "ts").alias("month"), dates.add_months_overflow(F.to_date("ts"), 1).alias("next_month"))


@query("""SELECT user_id, event_type, s AS start_ts, e AS end_ts,
 CASE WHEN e < TIMESTAMP '2024-01-10' THEN round(exp(-(epoch_us(TIMESTAMP '2024-01-10') - epoch_us(e)) / 1e6 / 2592000.0), 6) WHEN s > TIMESTAMP '2024-01-20' THEN round(exp(-(epoch_us(s) - epoch_us(TIMESTAMP '2024-01-20')) / 1e6 / 2592000.0), 6) ELSE 1.0 END AS weight,
 e >= TIMESTAMP '2024-01-10' AND s <= TIMESTAMP '2024-01-20' AS inside
FROM (SELECT user_id, event_type, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1, 2)""")
def temporal_decay(t):
    spans = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    low, high = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    s, e = F.col("start_ts"), F.col("end_ts")
    return spans.select("user_id", "event_type", s, e, F.round(dates.decay(s, e, low, high), 6).alias("weight"), dates.intersects(s, e, low, high).alias("inside"))


@query("""SELECT name, round(CAST(hit_count AS DOUBLE) / (hit_count + 1) + 1.0::DOUBLE / (1 + greatest(d_used, 0)) - least(greatest(d_made, 0) / CASE WHEN durability = 'evergreen' THEN 365.0 ELSE 90.0 END, 1.0) - CASE WHEN durability = 'evergreen' THEN 0.0 ELSE 0.3 END, 6) AS score, durability
FROM (SELECT *, (epoch_us(TIMESTAMP '2025-06-01') - epoch_us(updated_at)) / 86400e6 AS d_used, (epoch_us(TIMESTAMP '2025-06-01') - epoch_us(created_at)) / 86400e6 AS d_made FROM {entries}) WHERE NOT pinned""")
def keep_score(t):
    now = F.lit("2025-06-01").cast("timestamp")
    return t.entries.where(~F.col("pinned")).select("name", F.round(dates.keep_score(F.col("hit_count"), F.col("updated_at"), F.col("created_at"), F.col("durability"), now), 6).alias("score"), "durability")


@query("""WITH d AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN ' EverGreen ' WHEN 1 THEN 'volatile' WHEN 2 THEN source END AS said, [translate(substr(text, 3, 9), 'abcdefghij', 'ABCDEFGHIJ'), 'never ' || doc_id, 'also not here'] AS a, ['what is it?', '  ', CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) END] AS q FROM documents),
n AS (SELECT *, list_filter(a, lambda x: x IS NOT NULL AND NOT contains(lower(coalesce(text, '')), lower(x))) AS na, list_filter(q, lambda x: trim(coalesce(x, '')) <> '') AS nq FROM d)
SELECT doc_id, CASE WHEN lower(trim(said)) = 'evergreen' THEN 'evergreen' ELSE 'volatile' END AS durability, md5(array_to_string(na, chr(10))) AS alias_text, md5(array_to_string(nq, chr(10))) AS query_text FROM n""")
def shadow_texts(t):
    """Durability as told, and what is embedded for aliases, of which one is in the content, and for questions, of which one is blank."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, " EverGreen ").when(k == 1, "volatile").when(k == 2, F.col("source"))
    aliases = F.array(F.translate(F.substring("text", 3, 9), "abcdefghij", "ABCDEFGHIJ"), F.concat(F.lit("never "), "doc_id"), F.lit("also not here"))
    asked = F.array(F.lit("what is it?"), F.lit("  "), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)))
    rows = t.documents.select("doc_id", "text", said.alias("said"), aliases.alias("a"), asked.alias("q"))
    digest = lambda c: F.md5(c.cast("binary"))
    return rows.select("doc_id", T.durability("said").alias("durability"), digest(T.alias_text("text", "a")).alias("alias_text"), digest(T.query_text("q")).alias("query_text"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: strlen(x) >= 3 AND NOT list_contains(['the', 'and', 'for', 'that', 'this', 'with', 'are', 'was', 'from', 'have', 'has', 'had', 'will', 'would', 'should', 'could', 'about', 'into', 'than', 'then', 'they', 'them', 'their', 'there', 'what', 'when', 'where', 'which', 'while', 'your', 'youre', 'been', 'being', 'does', 'done', 'did', 'going', 'gonna', 'want', 'need', 'just', 'like', 'know', 'really', 'also', 'but', 'can'], x))) AS w FROM conversations)
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(list_sort(w), ' ')) AS tokens FROM w""")
def significant_tokens(t):
    rows = t.conversations.select("conv_id", "turn", F.array_sort(T.significant("text")).alias("w"))
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("tokens"))


@query(r"""SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM conversations""")
def token_counts(t):
    """Without a caller's counter, tokens are words."""
    from tidemark.plugins import count_tokens

    rows = t.conversations.select(F.struct("conv_id", "turn").alias("at"), "text")
    return count_tokens(rows, "at", "text").select("at.conv_id", "at.turn", "tokens")
