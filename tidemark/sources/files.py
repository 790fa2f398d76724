"""JSON, JSON lines, CSV and Markdown sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.work import Work


def results(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines of results: bad lines are skipped, or fail the read where it is strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    parsed = T._parse_datatype_string(schema).add("_bad", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", parsed, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad IS NULL").drop("_bad")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key, as a journal is resumed."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def dialogue_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An array of conversations with session_N keys: turns (conv, session, date, place, speaker, text, dia_id) and questions.

    Session keys vary by conversation, so that each is read as a map of JSON texts. Blank turns are dropped.
    """
    raw = spark.read.text(path, wholetext=True)
    items = raw.select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("conv", "x"))
    talk = items.select("conv", F.from_json(F.col("x")["conversation"], "map<string,string>").alias("c"))
    sessions = talk.select("conv", "c", F.explode(F.map_keys("c")).alias("key")).where(F.col("key").rlike(r"^session_\d+$"))
    turn = "array<struct<speaker:string,text:string,dia_id:string,blip_caption:string>>"
    turns = sessions.select(
        "conv", F.regexp_extract("key", r"\d+", 0).cast("int").alias("session"), F.col("c")[F.concat("key", F.lit("_date_time"))].alias("date"), F.posexplode(F.from_json(F.col("c")[F.col("key")], turn)).alias("place", "t")
    )
    turns = turns.select("conv", "session", "date", "place", "t.speaker", "t.text", "t.dia_id").where(F.trim("text") != "")
    qa = "array<struct<question:string,answer:string,evidence:array<string>,category:int>>"
    asked = items.select("conv", F.posexplode(F.from_json(F.col("x")["qa"], qa)).alias("nth", "q"))
    questions = asked.select("conv", "nth", F.concat(F.lit("c"), "conv", F.lit("-q"), "nth").alias("question_id"), "q.question", "q.answer", "q.evidence", "q.category")
    return turns, questions


def session_json(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their own sessions, in an array or an envelope (data, questions or items): one row for each turn."""
    raw = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.data"), F.get_json_object("value", "$.questions"), F.get_json_object("value", "$.items"), F.col("value"))
    items = raw.select(F.explode(F.from_json(inner, "array<map<string,string>>")).alias("x"))
    sessions = items.select(F.col("x")["question_id"].alias("question_id"), F.col("x")["question"].alias("question"), F.col("x")["question_type"].alias("type"), F.from_json(F.col("x")["haystack_dates"], "array<string>").alias("dates"), F.posexplode(F.from_json(F.col("x")["haystack_sessions"], "array<string>")).alias("session", "s"))
    message = "array<struct<role:string,content:string,has_answer:boolean>>"
    own = F.coalesce(F.get_json_object("s", "$.messages"), F.col("s"))
    rows = sessions.select("question_id", "question", "type", "session", F.coalesce(F.get_json_object("s", "$.date"), F.get("dates", F.col("session"))).alias("date"), F.posexplode(F.from_json(own, message)).alias("place", "m"))
    return rows.select("question_id", "question", "type", "session", "date", "place", "m.role", "m.content", F.coalesce("m.has_answer", F.lit(False)).alias("gold"))


def gold_turns(questions: DataFrame, evidence: str = "evidence") -> DataFrame:
    """References such as D3:7 in evidence lists: (question_id, session, turn)."""
    refs = questions.select("question_id", F.explode(evidence).alias("e")).select("question_id", F.explode(F.regexp_extract_all("e", F.lit(r"D(\d+:\d+)"), F.lit(1))).alias("r"))
    return refs.select("question_id", F.split("r", ":")[0].cast("int").alias("session"), F.split("r", ":")[1].cast("int").alias("turn")).distinct()


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Turns (conv, session, date, place, speaker, text) of a file of one of the known kinds: dialogue, sessions, planner, chat."""
    if kind == "dialogue":
        return dialogue_json(spark, path)[0].select(F.col("conv").cast("string").alias("conv"), F.col("session").cast("string").alias("session"), "date", F.col("place").cast("long").alias("place"), "speaker", "text")
    if kind == "sessions":
        return session_json(spark, path).select(F.col("question_id").alias("conv"), F.col("session").cast("string").alias("session"), "date", F.col("place").cast("long").alias("place"), F.col("role").alias("speaker"), F.col("content").alias("text"))
    if kind == "planner":
        return planner_lines(spark, path)[0]
    if kind == "chat":
        return chat_lines(spark, path)
    raise ValueError(f"unknown kind of data set: {kind}")


def planner_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of conversations: turns (conv, session, date, place, speaker, text, turn_id) and queries (conv, question_id, query, type, gold_answer, gold_turns)."""
    schema = "conversation_id string, persona string, sessions array<struct<session_id:string,date:string,turns:array<struct<turn_id:string,speaker:string,text:string>>>>, queries array<struct<question_id:string,query:string,type:string,gold_answer:string,gold_source_turn_ids:array<string>>>"
    rows = results(spark, path, schema)
    sessions = rows.select(F.col("conversation_id").alias("conv"), F.explode("sessions").alias("s"))
    turns = sessions.select("conv", F.col("s.session_id").alias("session"), F.col("s.date").alias("date"), F.posexplode("s.turns").alias("place", "t")).select("conv", "session", "date", F.col("place").cast("long").alias("place"), "t.speaker", "t.text", "t.turn_id")
    asked = rows.select(F.col("conversation_id").alias("conv"), F.explode("queries").alias("q")).select("conv", "q.question_id", "q.query", "q.type", "q.gold_answer", F.col("q.gold_source_turn_ids").alias("gold_turns"))
    return turns, asked


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of messages (from, value) as turns (conv, session, date, place, speaker, text): blank ones go, an unknown role is that of its place."""
    rows = results(spark, path, "messages array<struct<`from`:string,value:string>>").withColumn("conv", F.sha2(F.to_json("messages"), 256))
    m = rows.select("conv", F.posexplode("messages").alias("place", "m"))
    role = F.trim("m.from")
    speaker = F.when(role.isin("user", "assistant"), role).when(F.col("place") % 2 == 1, "assistant").otherwise("user")
    return m.select("conv", F.concat("conv", F.lit("-s0")).alias("session"), F.lit("2024-01-01").alias("date"), F.col("place").cast("long").alias("place"), speaker.alias("speaker"), F.trim("m.value").alias("text")).where("text <> ''")


def first_child_threads(messages: DataFrame) -> DataFrame:
    """Messages (id, parent) along the first child from each root: (root, depth, id), of any depth.

    First children form paths; each message's distance from its path's head is found by doubling steps over written tables.
    """
    work = Work(messages.sparkSession, "threads")
    first = messages.where("parent IS NOT NULL").groupBy("parent").agg(F.min("id").alias("id"))
    up = messages.select("id", F.col("parent").isNull().alias("root")).join(first, "id", "left").select("id", "root", "parent")
    at = work.write(up.select("id", F.coalesce("parent", "id").alias("head"), F.col("parent").isNotNull().cast("long").alias("depth")), "step0")
    roots = up.where("root").select(F.col("id").alias("root"))
    step = 0
    while True:
        on = at.select(F.col("id").alias("mid"), F.col("head").alias("top"), F.col("depth").alias("more"))
        moved = at.join(on, at["head"] == on["mid"], "left").select("id", F.coalesce("top", "head").alias("head"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > 0).alias("moved"))
        step += 1
        nxt = work.write(moved, f"step{step}")
        at = nxt.drop("moved")
        if nxt.where("moved").limit(1).count() == 0:
            break
    return at.join(roots, at["head"] == roots["root"]).select("root", "depth", "id")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str = "digest") -> DataFrame:
    """Append rows whose digest is not there yet; returns what was appended."""
    spark = df.sparkSession
    rows = df.withColumn(key, F.sha2(F.to_json(F.struct(*df.columns)), 256)).dropDuplicates([key])
    try:
        known = spark.read.schema(rows.schema).json(path).select(key)
        rows = rows.join(known, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").json(path)
    return rows


def write_review(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(entries: DataFrame) -> DataFrame:
    """Lines of an export in order: pinned first, then by name."""
    line = F.concat(F.lit("- **"), "name", F.lit("**: "), F.regexp_replace("content", r"\s+", " "))
    return entries.select("pinned", "name", line.alias("line")).orderBy(F.desc("pinned"), "name")


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of Markdown files, cut at headings and rules: (file, nth, title, body)."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    parts = raw.select("file", F.posexplode(F.split("value", r"(?m)^(?=#{1,6} )|^-{3,}\s*$")).alias("nth", "part"))
    return parts.select("file", "nth", F.regexp_extract("part", r"^#{1,6} +([^\n]*)", 1).alias("title"), F.trim(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", "")).alias("body")).where("body <> '' OR title <> ''")


def namespaces(spark: SparkSession, path: str) -> list[str]:
    """Names of the namespaces that a folder of tables holds, one below it for each; names that are not plain are refused."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(conf).listStatus(folder)
    return sorted(check_namespace(f.getPath().getName()) for f in found if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))


def check_namespace(name: str) -> str:
    import re

    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", name):
        raise ValueError(f"not a name of a namespace: {name!r}")
    return name


def legacy_entries(spark: SparkSession, profile: str | None, notes: str | None) -> DataFrame:
    """Entries (name, trigger, content, pinned, durability) of two Markdown files: one pinned one of the profile, one for each section of the notes.

    Names are slugs of titles, or first sentences, with a number where one repeats.
    """
    from tidemark.functions.text import one_line, slug

    out = None
    if profile:
        whole = spark.read.text(profile, wholetext=True).where(F.trim("value") != "")
        out = whole.select(F.lit("user-profile").alias("name"), F.lit("user profile").alias("trigger"), F.trim("value").alias("content"), F.lit(True).alias("pinned"), F.lit("evergreen").alias("durability"))
    if notes:
        s = markdown_sections(spark, notes).withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).where("body <> ''")
        title = F.when(F.col("title") != "", F.col("title")).otherwise(F.regexp_extract("body", r"(?s)^(.*?[.!?\n]|.*$)", 1))
        s = s.withColumn("lead", F.trim(title)).withColumn("own", F.coalesce(F.nullif(slug("lead"), F.lit("")), F.lit("note")))
        nth = F.row_number().over(Window.partitionBy("own").orderBy("file", "nth"))
        rows = s.select(F.when(nth == 1, F.col("own")).otherwise(F.concat_ws("-", "own", nth.cast("string"))).alias("name"), one_line("lead", 120).alias("trigger"), F.col("body").alias("content"), F.lit(False).alias("pinned"), F.lit("volatile").alias("durability"))
        out = rows if out is None else out.union(rows)
    return out


def decode_vectors(rows: DataFrame, key: str, blob: str) -> DataFrame:
    """Vectors (key, vec) of blobs of little-endian 32-bit floats; a blob of another length is null."""
    import pandas as pd

    kind = dict(rows.dtypes)[key]

    def run(frames):
        import numpy as np

        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "vec": [None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist() for b in pdf[blob]]})

    return rows.select(key, blob).mapInPandas(run, f"`{key}` {kind}, vec array<float>")


def encode_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """Blobs (key, blob) of vectors, as decode_vectors reads them."""
    import pandas as pd

    kind = dict(rows.dtypes)[key]

    def run(frames):
        import numpy as np

        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "blob": [None if v is None else np.asarray(v, "<f4").tobytes() for v in pdf[vec]]})

    return rows.select(key, vec).mapInPandas(run, f"`{key}` {kind}, blob binary")


def write_markdown(entries: DataFrame, path: str, by: str = "ns") -> None:
    """An export for each value of a column: lines in order, pinned first, written as sorted parts and never gathered."""
    lines = entries.select(by, "pinned", "name", F.concat(F.lit("- **"), "name", F.lit("**: "), F.regexp_replace("content", r"\s+", " ")).alias("line"))
    lines.repartitionByRange(by, F.desc("pinned"), "name").sortWithinPartitions(by, F.desc("pinned"), "name").select(by, "line").write.mode("overwrite").partitionBy(by).text(path)
