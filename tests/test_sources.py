import json

from tidemark.sources import files


def test_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"q": 1, "ok": true}\nnot json\n{"q": 1, "ok": false}\n')
    rows = files.results(spark, str(tmp_path / "r.jsonl"), "q int, ok boolean")
    assert rows.count() == 2


def test_dialogues(spark, tmp_path):
    data = [{"qa": [{"question": "q", "answer": 5, "evidence": ["D1:2; D2:1"], "category": 2}], "conversation": {"session_1": [{"speaker": "a", "text": "hi", "dia_id": "D1:1"}, {"speaker": "b", "text": " ", "dia_id": "D1:2"}], "session_1_date_time": "1 May, 2023"}}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    turns, questions = files.dialogue_json(spark, str(tmp_path / "d.json"))
    assert [(r["session"], r["date"], r["text"]) for r in turns.collect()] == [(1, "1 May, 2023", "hi")]
    assert {(r["session"], r["turn"]) for r in files.gold_turns(questions).collect()} == {(1, 2), (2, 1)}


def test_sessions_in_an_envelope(spark, tmp_path):
    item = {"question_id": "x", "question": "?", "question_type": "t", "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "c", "has_answer": True}], {"date": "e", "messages": [{"role": "user", "content": "f"}]}]}
    (tmp_path / "s.json").write_text(json.dumps({"data": [item]}))
    got = [(r["date"], r["content"], r["gold"]) for r in files.session_json(spark, str(tmp_path / "s.json")).orderBy("session").collect()]
    assert got == [("d", "c", True), ("e", "f", False)]


def test_threads(spark):
    rows = [(1, None, "user", "a"), (2, 1, "assistant", "b"), (3, 1, "assistant", "c"), (4, 2, "user", "d")]
    got = files.first_child_threads(spark.createDataFrame(rows, "id long, parent long, role string, text string"))
    assert [(r["depth"], r["id"]) for r in got.orderBy("depth").collect()] == [(0, 1), (1, 2), (2, 4)]


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "out")
    files.append_new(df, path)
    files.append_new(df, path)
    assert spark.read.json(path).count() == 2


def test_markdown(spark, tmp_path):
    (tmp_path / "m.md").write_text("# One\nbody\n---\nrest\n## Two\n")
    got = [(r["title"], r["body"].strip()) for r in files.markdown_sections(spark, str(tmp_path / "m.md")).orderBy("nth").collect()]
    assert got == [("One", "body"), ("", "rest"), ("Two", "")]
