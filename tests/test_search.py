"""The search over a small memory, the memory as an object, plugged-in services and jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import plugins
from tidemark.memory import Config, Conflict, Memory
from tidemark.operators import diagnostics as D, events as E, graph, retrieval as R, search as S, selection as X, training as N, writes as W
from tidemark.sources import files
from tidemark.streaming import jobs

T = dt.datetime


def memory(spark):
    rows = [("trip", "the trip to Lisbon with Ana", T(2024, 5, 1), None), ("work", "Ana works at the harbour office", T(2024, 2, 1), "trip"), ("boat", "a boat trip on the lake", T(2023, 8, 1), None), ("stale", "the trip that never was", T(2024, 5, 2), None), ("food", "Ana likes sardines", None, None)]
    entries = spark.createDataFrame([(n, n, "", c, T(2024, 1, 1 + i), s, s, by) for i, (n, c, s, by) in enumerate(rows)], "name string, id string, trigger string, content string, updated_at timestamp, event_start timestamp, event_end timestamp, superseded_by string")
    vec = {"trip": [1.0, 0.0], "work": [0.9, 0.1], "boat": [0.0, 1.0], "food#alias": [0.99, 0.0], "stale": [1.0, 0.0]}
    entities = spark.createDataFrame([("trip", "lisbon", "Lisbon"), ("trip", "ana", "Ana"), ("work", "ana", "Ana"), ("work", "harbour office", "Harbour Office"), ("boat", "lake", "Lake"), ("food", "ana", "Ana")], "entry string, entity string, raw string")
    return {
        "entries": entries, "vectors": spark.createDataFrame(list(vec.items()), "name string, vec array<double>"), "entities": entities, "aliases": spark.createDataFrame([("food", "portuguese sardine lunch")], "entry string, text string"),
        "projections": spark.createDataFrame([(f"p-{n}", n, "stale" if n == "stale" else "active", "atomic_fact") for n, *_ in rows], "id string, object_key string, state string, kind string"), "edges": graph.co_edges(entities),
    }


def asked(spark, *texts):
    return spark.createDataFrame([(i, t, [1.0, 0.0], dt.date(2024, 6, 15), 3) for i, t in enumerate(texts)], "query_id long, text string, vec array<double>, now date, k int")


def test_search(spark):
    m = memory(spark)
    got = {(r["query_id"], r["rank"]): r for r in S.search(m, asked(spark, "trip Lisbon", "  ", "Ana")).collect()}
    assert got[0, 1]["name"] == "trip" and got[0, 1]["projection_id"] == "p-trip" and got[0, 1]["score"] == pytest.approx(2 / 61 + 1 / 62)  # the stale entry takes no place among vectors
    assert {n for (q, _), r in got.items() for n in [r["name"]] if q == 2} == {"trip", "work", "food"} and not any(q == 1 for q, _ in got)
    options = S.Options(temporal=True, hard_filter=True, associative=True, sweep=True, penalty=0.5, reranker=plugins.reranker(lambda q, docs: [len(d) for d in docs]))
    rows = S.search(m, asked(spark, "trip Lisbon before 2024-03-01", "list all the things of Ana", "Ana"), options).collect()
    first = {r["name"] for r in rows if r["query_id"] == 0}
    assert "boat" in first and "stale" not in {r["name"] for r in rows}
    wide = [r for r in rows if r["query_id"] == 1]
    assert all(r["cluster_sweep"] for r in wide) and {r["name"] for r in wide} >= {"trip", "work", "food"}
    third = [r["name"] for r in sorted((r for r in rows if r["query_id"] == 2), key=lambda r: r["rank"])]
    assert third[0] == "work"  # the longest text


def test_phrases_and_signals(spark):
    m = memory(spark)
    q = spark.createDataFrame([(1, "who is at the Harbour Office now"), (2, "Ana"), (3, "sardine")], "query_id long, text string")
    cues, counts = R.whole_query_signal(q, m["entities"])
    assert {(r["query_id"], r["entity"]) for r in cues.collect()} == {(1, "harbour office"), (2, "ana")}
    assert {(r["query_id"], r["entry"]) for r in counts.collect()} == {(1, "work"), (2, "trip"), (2, "work"), (2, "food")}
    assert [r["name"] for r in S.alias_ranks(m["aliases"], q).collect()] == ["food"]
    overlap = R.bm25(spark.createDataFrame([("a", "banana anan"), ("b", "other words")], "name string, content string"), spark.createDataFrame([(1, "anan"), (2, "don't"), (3, "words other"), (4, "an")], "query_id long, text string"))
    assert {(r["query_id"], r["name"]) for r in overlap.collect()} == {(1, "a"), (3, "b")}


def test_memory_object(spark, tmp_path):
    config = Config.read({"folder": str(tmp_path / "store")}, {"TIDEMARK_NAMESPACE": "one"})
    m = Memory(spark, config)
    at = F.lit("2024-01-01").cast("timestamp")
    new = lambda *rows: spark.createDataFrame(list(rows), "name string, content string").withColumn("at", at)
    m.add(new(("a", "tea in the harbour"), ("b", "a boat")))
    m.add(new(("a", "coffee in the harbour")))
    assert {(r["name"], r["content"], r["revision"]) for r in m.list().collect()} == {("a", "coffee in the harbour", 2), ("b", "a boat", 1)}
    with pytest.raises(ValueError, match="over its limit"):
        m.add(new(("c", "x" * 1201)))
    q = spark.createDataFrame([(1, "harbour"), (2, "tea")], "query_id long, text string")
    assert [(r["query_id"], r["name"]) for r in m.search(q).collect()] == [(1, "a")]
    assert {(r["query_id"], r["returned"], r["degraded"]) for r in m.envelope(q, 5).collect()} == {(1, 1, True), (2, 0, True)}
    with pytest.raises(ValueError, match="positive"):
        m.envelope(q, 0)
    turns = spark.createDataFrame([("t1", "we took a ferry"), ("t2", " ")], "id string, text string")
    m.ingest(turns, lambda t: t.select(F.concat(F.lit("fact-"), "id").alias("name"), F.col("text").alias("content"), F.col("id").alias("evidence_id")), at)
    t = m.tables()
    assert t["lineage"].where("evidence_id = 't1'").count() == 1 and m.get(["fact-t1"]).count() == 1
    m.lifecycle(["t1"], "tombstone")
    assert m.tables()["projections"].where("state = 'stale'").count() == 1
    m.delete(["b"])
    s = m.stats().first()
    assert (s["entries"], s["pinned"]) == (2, 0) and Memory.namespaces(spark, config) == ["one"]
    with pytest.raises(ValueError):
        files.check_namespace("../x")


def test_services(spark):
    rows = spark.createDataFrame([(i, "x" * i, "s") for i in range(5)], "id long, text string, sys string")
    got = plugins.embed(rows, "id", "text", lambda ts: [[float(len(t))] for t in ts], "m", batch=2).collect()
    assert {(r["id"], r["vec"][0], r["dims"]) for r in got} == {(i, float(i), 1) for i in range(5)}

    def model(system, user):
        if user == "xx":
            raise OSError("down")
        return system + user

    assert {(r["id"], r["answer"]) for r in plugins.ask(rows, "id", "sys", "text", model).collect()} == {(i, None if i == 2 else "s" + "x" * i) for i in range(5)}
    turns = spark.createDataFrame([("c", i, t) for i, t in enumerate(["a", "b", "# c", "d"])], "s string, i long, t string")
    assert {(r["episode"], r["first"], r["last"]) for r in plugins.segments(turns, "s", "i", "t", lambda ts: [t.startswith("#") for t in ts]).collect()} == {(0, 0, 1), (1, 2, 3)}
    blobs = files.encode_vectors(spark.createDataFrame([(1, [1.0, 2.5]), (2, None)], "k long, v array<float>"), "k", "v")
    assert {(r["k"], tuple(r["vec"] or ())) for r in files.decode_vectors(blobs, "k", "blob").collect()} == {(1, (1.0, 2.5)), (2, ())}


def test_jobs(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",)], "name string").write.parquet(str(tmp_path / "in"))
    entries = spark.createDataFrame([("a", "", "hello"), ("b", "t", "x")], "name string, trigger string, content string")
    stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    jobs.embed_behind(stream, lambda: entries, lambda ts: [[float(len(t))] for t in ts], "m", str(tmp_path / "v"), str(tmp_path / "c")).awaitTermination()
    assert [(r["name"], r["vec"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [("a", [5.0])]
    ran = []
    jobs.curate_when_due(stream, lambda: True, lambda: ran.append(1), str(tmp_path / "c2")).awaitTermination()
    assert ran == [1]


def test_roles():
    c = lambda *claims, cost=1: {"claims": [dict(zip(("entity", "slot", "value", "time"), x)) for x in claims], "cost": cost}
    rows = [c(("a", "job", "x", "now")), c(), c(("a", "job", "x", "now")), c(("b", "age", "3", "now")), c(("a", "home", "y", "now")), c(("a", "job", "z", "now"))]
    atoms = [{"entity": "a", "slot": "job"}, {"entity": "b", "slot": ""}]
    # anchors, the complement for b, then what is neither repeated nor a lure
    # then what contradicts a shown claim, and the lure last
    assert X.by_roles(rows, atoms, 4) == [0, 1, 3, 5]
    assert X.by_roles(rows, atoms, 9) == [0, 1, 3, 5, 4]
    assert X.by_roles(rows, atoms, 9, ceiling=3) == [0, 1, 3]
    assert X.lures(rows[4]["claims"], [{"entity": "a", "slot": "job"}]) and X.conflicting(rows[0]["claims"][0], rows[5]["claims"][0])


def test_select_roles(spark):
    cand = spark.createDataFrame([(1, i + 1, f"c{i}", 1) for i in range(4)], "query_id long, rank int, name string, cost int")
    claims = spark.createDataFrame([("c0", "A", "job", "x", "now"), ("c2", "a", "Job", "x", "now"), ("c3", "b", "age", "3", "now")], "name string, entity string, slot string, value string, time string")
    atoms = spark.createDataFrame([(1, "b", "")], "query_id long, entity string, slot string")
    got = X.select_roles(cand, claims, atoms, 3).orderBy("place").collect()
    assert [r["name"] for r in got] == ["c0", "c1", "c3"]


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"conversation_id": "c", "sessions": [{"session_id": "s", "date": "d", "turns": [{"turn_id": "t", "speaker": "u", "text": "hi"}]}], "queries": [{"question_id": "q", "query": "?", "gold_source_turn_ids": ["t"]}]}) + "\n")
    assert [r["text"] for r in files.load(spark, str(tmp_path / "p.jsonl"), "planner").collect()] == ["hi"]
    (tmp_path / "u.jsonl").write_text(json.dumps({"messages": [{"from": "human", "value": "a"}, {"from": "bot", "value": "b"}, {"from": "user", "value": " "}]}) + "\n")
    assert [(r["speaker"], r["text"]) for r in files.load(spark, str(tmp_path / "u.jsonl"), "chat").orderBy("place").collect()] == [("user", "a"), ("assistant", "b")]
    with pytest.raises(ValueError):
        files.load(spark, "x", "other")
    (tmp_path / "n.md").write_text("# Tea time\nno milk\n# Tea time\nno sugar\n---\nJust this. And more\n")
    assert {r["name"] for r in files.legacy_entries(spark, None, str(tmp_path / "n.md")).collect()} == {"tea-time", "tea-time-2", "just-this"}
    files.write_review(spark.createDataFrame([(1, "a,b")], "k int, v string"), str(tmp_path / "sheet"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheet")).first()["v"] == "a,b"
    files.write_markdown(spark.createDataFrame([("n", False, "b", "two  lines"), ("n", True, "z", "one")], "ns string, pinned boolean, name string, content string"), str(tmp_path / "md"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md" / "ns=n")).collect()] == ["- **z**: one", "- **b**: two lines"]


def test_deep_threads(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 1000)] + [(5000, 3), (6000, 7777)]
    got = {r["id"]: (r["root"], r["depth"]) for r in files.first_child_threads(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {i: (0, i) for i in range(1000)}


def test_summaries(spark):
    q = spark.createDataFrame([(True, 2, 1, True, True, 1, 1, 3), (False, 0, 0, False, False, 0, 0, None)], "parsed boolean, gold_facts int, dated_facts int, resolved boolean, buried boolean, buried_facts int, lifted_facts int, rank_pool int")
    s = D.temporal_summary(q).first()
    assert (s["parse_coverage"], s["date_coverage"], s["buried_ratio"], s["lift_ratio"], s["p50"], s["verdict"]) == (0.5, 0.5, 1.0, 1.0, 3, "GO")
    a = spark.createDataFrame([(1, ["x"], [], ["o"], None, "", [("KEEP", "1")])], "k int, entities array<string>, times array<string>, operands array<string>, count int, state string, actions array<struct<kind:string,candidate:string>>")
    b = spark.createDataFrame([(1, ["y"], ["t"], [], 2, "latest", [("KEEP", "1"), ("DROP", "2")])], a.schema)
    j = N.joint_label(a, b, "k").first()
    assert (j["entities"], j["times"], j["operands"], j["count"], j["state"], len(j["actions"]), j["changed"]) == (["x", "y"], ["t"], ["o"], 2, "latest", 2, True)
    e = spark.range(1).select(N.label_entities(F.lit('He said "New York" and Ana in 2024, The 5'), ("he", "the")).alias("x")).first()["x"]
    assert e == ["Ana", "New", "New York", "York"]
    assert spark.range(1).select(E.problem(E.parsed(F.lit("{}"))).alias("p")).first()["p"] == "conversation_id"
    assert W.by_id(spark.createDataFrame([("a", 1)], "id string, v int"), spark.createDataFrame([("a",), ("b",)], "id string")).count() == 1


def test_search_takes_active_owners_of_one_model_only(spark):
    names = [f"e{i:03d}" for i in range(300)]
    at = T(2024, 1, 1)
    entries = spark.createDataFrame([(n, n, "", "words", at, None, None, None) for n in names], "name string, id string, trigger string, content string, updated_at timestamp, event_start timestamp, event_end timestamp, superseded_by string")
    # the nearest 200 are stale, the others nearer by shadows of another model
    vectors = [(n, "m", [1.0, i / 1000]) for i, n in enumerate(names)] + [(f"{n}#query", "old", [1.0, 0.0]) for n in names[200:]] + [("gone#alias", "m", [1.0, 0.0]), ("e250#alias", "m", [1.0, 0.0])]
    m = {
        "entries": entries, "vectors": spark.createDataFrame(vectors, "name string, model string, vec array<double>"), "entities": spark.createDataFrame([], "entry string, entity string, raw string"),
        "projections": spark.createDataFrame([(f"p-{n}", n, "stale" if i < 200 else "active", "atomic_fact") for i, n in enumerate(names)] + [("p2", "e210", "stale", "episode")], "id string, object_key string, state string, kind string"),
    }
    q = spark.createDataFrame([(1, "?", [1.0, 0.0], None, 8)], "query_id long, text string, vec array<double>, now date, k int")
    got = [r["name"] for r in S.search(m, q, S.Options(model="m")).orderBy("rank").collect()]
    assert got == ["e250"] + names[200:207]


def test_rerank_looks_at_k_hits(spark):
    m = memory(spark)
    names = [f"n{i:03d}" for i in range(120)]
    entries = spark.createDataFrame([(n, f"text {n}") for n in names], "name string, content string")
    hits = spark.createDataFrame([(1, n, 1.0 / (i + 1), i + 1) for i, n in enumerate(names)], "query_id long, name string, score double, rank int")
    longest = plugins.reranker(lambda q, docs: [-float(d[-3:]) for d in docs])
    for k, seen in ((3, 50), (100, 100)):
        q = spark.createDataFrame([(1, "x", k)], "query_id long, text string, k int")
        assert S.reranked(hits, {"entries": entries, "entities": m["entities"]}, q, longest).count() == seen


def test_best_of_each_owner_before_the_cut(spark):
    rows = [(f"a{i}", [1.0, j / 1000]) for i in range(12) for j in range(8 + 30 * (i < 4))]
    left = spark.createDataFrame(rows, "name string, v array<double>")
    got = R.blocks_cosine(left, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>"), 10)
    assert got.count() == 12 and got.select("name").distinct().count() == 12


def test_search_multi(spark):
    m = memory(spark)
    rows = [(1, 0, " trip Lisbon ", [1.0, 0.0]), (1, 1, "trip Lisbon", [0.0, 1.0]), (2, 0, "Ana", [1.0, 0.0]), (2, 1, "boat lake", [0.0, 1.0]), (3, 0, "  ", [1.0, 0.0])]
    subs = spark.createDataFrame([(*r, dt.date(2024, 6, 15)) for r in rows], "query_id long, sub_id long, text string, vec array<double>, now date")
    got = S.search_multi(m, subs, 3).orderBy("query_id", "rank").collect()
    alone = S.search(m, asked(spark, "trip Lisbon")).orderBy("rank").collect()
    assert [(r["name"], r["score"]) for r in got if r["query_id"] == 1] == [(r["name"], r["score"]) for r in alone]
    two = [r for r in got if r["query_id"] == 2]
    assert len(two) == 3 and not any(r["query_id"] == 3 for r in got) and two[0]["score"] == pytest.approx(max(r["score"] for r in two))


def test_two_writers_lose_nothing(spark, tmp_path):
    config = Config.read({"folder": str(tmp_path / "store")}, {})
    one, two = Memory(spark, config), Memory(spark, config)
    new = lambda name: spark.createDataFrame([(name, f"content of {name}")], "name string, content string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    one.add(new("a"))
    read, between = two.tables, []

    def tables():
        t = read()
        if not between:  # another commits after this one has read
            between.append(1)
            one.add(new("b"))
        return t

    two.tables = tables
    two.add(new("c"))
    assert {r["name"] for r in one.list().collect()} == {"a", "b", "c"}
    stale = one.tables()
    two.tables = read
    two.delete(["b"])
    with pytest.raises(Conflict):
        one._write(stale)
    assert {r["name"] for r in two.list().collect()} == {"a", "c"}


def test_ingest_keeps_dates_entities_and_aliases(spark, tmp_path):
    m = Memory(spark, Config.read({"folder": str(tmp_path / "store")}, {}))
    at = F.lit("2024-01-01").cast("timestamp")
    schema = "name string, content string, evidence_id string, event_start timestamp, entities array<string>, aliases array<string>"

    def ingest(turn, *facts):
        m.ingest(spark.createDataFrame([(turn, "said")], "id string, text string"), lambda t: spark.createDataFrame(list(facts), schema), at)

    ingest("t1", ("f1", "Ana moved to the harbour of Lisbon", "t1", T(2024, 3, 1), ["Ana", "Lisbon ", ""], ["the move"]))
    # as near a text of another day is a correction, of the same day a repeat, and no date tells nothing
    ingest("t2", ("f2", "Ana moved to the harbour of Lisbon!", "t2", T(2024, 4, 1), ["Ana", "Porto"], None), ("f3", "Ana moved to the harbour of Lisbon.", "t2", T(2024, 3, 1), ["x"], None))
    t = m.tables()
    assert {(r["name"], r["event_start"]) for r in t["entries"].collect()} == {("f1", T(2024, 3, 1)), ("f2", T(2024, 4, 1))}
    assert {(r["entry"], r["entity"]) for r in t["entities"].collect()} == {("f1", "ana"), ("f1", "lisbon"), ("f2", "ana"), ("f2", "porto")}
    assert {(r["entity_a"], r["entity_b"], r["weight"]) for r in t["edges"].collect()} == {("ana", "lisbon", 1.0), ("ana", "porto", 1.0)}
    assert [(r["entry"], r["text"]) for r in t["aliases"].collect()] == [("f1", "the move")]


def test_merges_in_order(spark):
    import random

    rng = random.Random(4)
    entries = spark.createDataFrame([(f"e{i}", f"i{i}", 1, i % 11 == 0) for i in range(60)], "name string, id string, revision int, pinned boolean")
    rows = []
    for k in range(150):
        names = rng.sample(range(60), rng.randrange(1, 4))
        rows.append(("n" if k % 4 else "o", k, f"e{names[0]}" if k % 5 else "e1", [f"e{i}" for i in names], [f"i{i}" for i in names], [1 + (k % 17 == 0)] * len(names)))
    rows += [("long", k, f"e{k + 1}", [f"e{k + 1}", f"e{k + 2}"], [f"i{k + 1}", f"i{k + 2}"], [1, 1]) for k in range(8)]
    want, used = set(), set()
    for ns, nth, into, names, _, revisions in sorted(rows, key=lambda r: r[1]):
        legal = len(names) >= 2 and into in names and revisions[0] == 1 and not any(int(n[1:]) % 11 == 0 for n in names)
        if legal and not any((ns, n) in used for n in names):
            want.add((ns, nth))
            used |= {(ns, n) for n in names}
    got = W.applied_merges(spark.createDataFrame(rows, "ns string, nth int, into string, names array<string>, ids array<string>, revisions array<int>"), entries)
    assert {(r["ns"], r["nth"]) for r in got.collect()} == want and len(want) > 10


def test_t_points(spark):
    from tidemark.operators.evaluation import T_95, t_point

    got = {r["n"]: r["t"] for r in spark.range(131).select(F.col("id").alias("n"), t_point(F.col("id")).alias("t")).collect()}
    at = lambda n: 0 if n == 0 else T_95[n] if n in T_95 else next((T_95[k] for k in (30, 40, 60, 120) if n < k), 1.962)
    assert got == {n: at(n) for n in range(131)} and (got[40], got[60]) == (2.021, 2.0)
