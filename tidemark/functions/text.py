"""Text functions as Column expressions; lengths and offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Markers that results depend on.
NEGATION_MARKERS = (" not ", "n't", " no ", " never ", "没有", "不是", "并非", "未")
IDK_PHRASES = ("don't know", "do not know", "not mentioned", "no information")
# Capitalised words that are no entities.
ENTITY_STOP_WORDS = (
    "A", "An", "And", "Are", "Can", "Did", "Do", "Does", "For", "Give", "How", "In", "Is", "List", "Name", "Show", "The", "Then", "To", "What", "When", "Where", "Which", "Who", "Why",
)


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word boundaries \\b see ASCII letters, digits and _ as word characters, whatever the Java version."""
    return pattern.replace(r"\b", r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_form(text) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"(?U)\s+", " "))


def char_runs(text, n: int = 3) -> Column:
    """All n-grams of characters in order, repeats kept; none in a shorter text."""
    # shifted arrays are joined: a substring by position would walk the text each time
    chars = F.split(_col(text), "")
    runs = chars
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.filter(runs, lambda x: x.isNotNull())


def char_grams(text, n: int = 3, short: str = "whole") -> Column:
    """Distinct n-grams of characters; a shorter text is one gram itself ("whole") or has none ("none")."""
    t = _col(text)
    few = F.array(t) if short == "whole" else F.array().cast("array<string>")
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, few).otherwise(F.array_distinct(char_runs(t, n)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays without repeats; 0 where either is empty."""
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(a) + F.size(b) - same))


def words(text) -> Column:
    """Runs of letters and digits in lower case, in order."""
    return F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


CJK_LETTERS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def query_tokens(text) -> Column:
    """The whole normalised query, each ideograph or kana and each other run of letters and digits, distinct in order."""
    q = normal_form(text)
    runs = F.regexp_extract_all(q, F.lit(rf"[{CJK_LETTERS}]|[\p{{L}}\p{{Nd}}&&[^{CJK_LETTERS}]]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array(q), runs))


# English words that tell nothing of a topic.
TOPIC_STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "are", "was", "from", "have", "has", "had", "will", "would", "should", "could", "about", "into", "than", "then",
    "they", "them", "their", "there", "what", "when", "where", "which", "while", "your", "youre", "been", "being", "does", "done", "did", "going", "gonna", "want",
    "need", "just", "like", "know", "really", "also", "but", "can",
)


def significant(text, stop: tuple[str, ...] = TOPIC_STOP_WORDS) -> Column:
    """Distinct runs of ASCII letters and digits or any character beyond ASCII, of three bytes or more, without stop words."""
    runs = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*stop) if stop else F.octet_length(w) >= 3))


def capitalised(text) -> Column:
    """Capitalised words that may be names, in order, repeats kept."""
    found = F.split(_col(text), r"[^\p{L}\p{M}\p{Nd}_'-]+")
    return F.filter(found, lambda w: w.rlike(r"^\p{Lu}[\p{L}\p{M}'-]*$") & ~w.isin(*ENTITY_STOP_WORDS))


def negated(text) -> Column:
    padded = F.concat(F.lit(" "), F.lower(_col(text)), F.lit(" "))
    hit = F.lit(False)
    for m in NEGATION_MARKERS:
        hit = hit | F.contains(padded, F.lit(m))
    return hit


def unknown_answer(text) -> Column:
    """Empty, or one of the phrases that decline to answer."""
    t = F.lower(F.trim(_col(text)))
    hit = t == ""
    for p in IDK_PHRASES:
        hit = hit | F.contains(t, F.lit(p))
    return hit


def slug(text, limit: int = 40) -> Column:
    """ASCII letters, digits and ideographs kept in lower case, others one hyphen; cut, no hyphen at the ends."""
    t = F.btrim(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9\p{IsHan}]+", "-"), F.lit("-"))
    return F.btrim(F.substring(t, 1, limit), F.lit("-"))


def one_line(text, limit: int) -> Column:
    """White space collapsed, cut to the limit with an ellipsis in the last place."""
    t = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def snippet(text, limit: int = 200) -> Column:
    t = _col(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("...")))


def sentences(text) -> Column:
    """Pieces that end with a full stop, exclamation or question mark or a line end, trimmed, none empty."""
    raw = F.regexp_extract_all(_col(text), F.lit(r"[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$"), F.lit(0))
    return F.filter(F.transform(raw, lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def sentence_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences with their places in code points: (key, start, end, sentence), the end exclusive; ends of a piece are trimmed."""
    pieces = rows.select(key, F.posexplode(F.split(F.col(text), r"(?<=[.!?。！？\n])")).alias("nth", "piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.withColumn("begin", (upto - F.length("piece")).cast("int"))
    left = F.regexp_replace("piece", r"(?U)^\s+", "")
    sentence = F.regexp_replace(left, r"(?U)\s+$", "")
    start = F.col("begin") + F.length("piece") - F.length(left)
    return placed.select(key, start.alias("start"), (start + F.length(sentence)).alias("end"), sentence.alias("sentence")).where("sentence <> ''")


def json_object(text) -> Column:
    """From the first opening brace to the last closing one; null without."""
    return F.nullif(F.regexp_extract(_col(text), r"(?s)\{.*\}", 0), F.lit(""))


def durability(name) -> Column:
    """evergreen, where that is said in any case and spacing; all else, and null, is volatile."""
    return F.when(F.lower(F.trim(_col(name))) == "evergreen", "evergreen").otherwise("volatile")


def alias_text(content, aliases) -> Column:
    """What is embedded for an entry's aliases: those that its content does not hold already, regardless of case, a line each; null for none."""
    said = F.lower(F.coalesce(_col(content), F.lit("")))
    new = F.filter(_col(aliases), lambda a: a.isNotNull() & ~F.contains(said, F.lower(a)))
    return F.when(F.size(new) > 0, F.array_join(new, "\n"))


def query_text(queries) -> Column:
    """What is embedded for the questions that an entry answers: all that are not blank, a line each; null for none."""
    asked = F.filter(_col(queries), lambda q: F.trim(F.coalesce(q, F.lit(""))) != "")
    return F.when(F.size(asked) > 0, F.array_join(asked, "\n"))


def final_answer(text) -> Column:
    """What follows the last closing thought tag, without a leading label."""
    t = F.regexp_replace(_col(text), r"(?s)^.*(</thinking>|</think>)", "")
    return F.trim(F.regexp_replace(F.trim(t), r"(?i)^(final answer|answer)\s*:\s*", ""))


def verdict(text) -> Column:
    """After the word "correct", whether true comes before false."""
    after = F.substring_index(F.lower(_col(text)), "correct", -1)
    yes, no = F.instr(after, F.lit("true")), F.instr(after, F.lit("false"))
    return F.contains(F.lower(_col(text)), F.lit("correct")) & (yes > 0) & ((no == 0) | (yes < no))


def split_of(key, seed: str, share: float = 0.15) -> Column:
    """validation or train by the leading 32 bits of a digest of the seed and the key."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.when(first / 4294967295.0 < share, "validation").otherwise("train")


def span_valid(content, start, end, digest) -> Column:
    """Whether a span lies inside the text and its digest is that of the slice."""
    c, s, e = _col(content), _col(start), _col(end)
    cut = F.substr(c, (s + 1).cast("int"), (e - s).cast("int"))
    return (s >= 0) & (e > s) & (e <= F.length(c)) & (F.sha2(cut, 256) == F.lower(_col(digest)))


def alias_name(entry, kind: str) -> Column:
    return F.concat(_col(entry), F.lit(f"#{kind}"))


def base_name(entry) -> Column:
    """The owner of a shadow vector's name."""
    return F.regexp_replace(_col(entry), "#(query|alias)$", "")
