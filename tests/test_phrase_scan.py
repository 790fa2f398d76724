"""The best keyword hits are those of the whole list, and the rest is neither sent nor written."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import phrase_scan as P, retrieval as R, search as S
from tidemark.operators.keyword_index import KeywordIndex

COLUMNS = ("name", "trigger", "content")


def rows_sent(spark, since):
    """The rows that stages after that one shuffled and wrote."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [(x.stageId(), x.shuffleWriteRecords() + x.outputRecords()) for x in map(stages.apply, range(stages.size())) if x.stageId() > since]


def test_frequent_phrases_pass_on_the_best_only(spark):
    entries = spark.range(3000).selectExpr("concat('d', id) AS name", "'' AS trigger", "repeat('common ', 1 + CAST(id % 7 AS INT)) AS content", "timestamp'2024-01-01' AS updated_at")
    q = spark.range(150).selectExpr("id AS query_id", "IF(id % 2 = 0, 'common', 'mmo COMMON') AS text", "8 AS k").localCheckpoint()
    since = max((n for n, _ in rows_sent(spark, -1)), default=-1)
    got = S.keyword_ranks({"entries": entries}, q).collect()
    assert sum(n for _, n in rows_sent(spark, since)) < 150_000  # all hits are 450,000
    assert len(got) == 150 * 100 and {r["rank"] for r in got if r["query_id"] == 7} == set(range(1, 101))


def test_equals_the_first_of_all_hits(spark, tmp_path, monkeypatch):
    draw = random.Random(5)
    words = ["banana", "anan", "日本語版だよ", "the_end", "x" * 40, "word", "sword", "words", "ab", "naïve", "𠀀𠀁𠀂𠀃"]
    say = lambda n: " ".join(draw.choice(words) + draw.choice(["", "", "s", "1"]) for _ in range(draw.randrange(n)))
    rows = [(f"e{i}", draw.choice([None, "", say(3)]), say(9)) for i in range(300)]
    rows += [(f"c{i}", "", "banana sword") for i in range(80)]  # copies tie
    entries = spark.createDataFrame(rows, "name string, trigger string, content string")
    asked = ["anan", "word", "banana sword", "日本語版", "sword 日本語", "ab word", "nowhere word", "x" * 12, "Banana THE_END", "", "𠀁𠀂𠀃", "e1", "nana ana"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    order = [F.desc(F.round("score", 9)), "name"]
    plain = lambda hits: sorted((r["query_id"], r["rank"], r["name"], round(r["score"], 8)) for r in R.top(hits, ["query_id"], order, 7).collect())
    want = plain(R.bm25(entries, queries, COLUMNS))
    assert len(want) > 50
    assert plain(R.bm25(entries, queries, COLUMNS, limit=7)) == want
    index = KeywordIndex(spark, str(tmp_path / "index"), COLUMNS)
    monkeypatch.setattr(P, "QUERIES", 4)  # several batches
    assert plain(R.bm25(entries, queries, COLUMNS, index=index, limit=7)) == want
    assert plain(R.bm25(entries, queries, COLUMNS, index=index)) == want
    changed = entries.where("name <> 'c3'").union(spark.createDataFrame([("new", "", "anan anan anan")], entries.schema))
    assert plain(R.bm25(changed, queries, COLUMNS, index=index, limit=7)) == plain(R.bm25(changed, queries, COLUMNS))


def test_counts_of_phrases_in_tokens():
    draw = random.Random(1)
    tokens = ["".join(draw.choice("ab東𠀀") for _ in range(draw.randrange(1, 12))) for _ in range(200)]
    phrases = sorted({"".join(draw.choice("ab東𠀀") for _ in range(draw.randrange(3, 6))) for _ in range(60)})
    got = {(t, p): k for t, p, k in zip(*(x.tolist() for x in P.Finder(phrases).find(tokens)))}
    want = {(i, j): k for i, t in enumerate(tokens) for j, p in enumerate(phrases) if (k := sum(t.startswith(p, s) for s in range(len(t))))}
    assert got == want and P.Finder(phrases).find([])[0].size == 0 and P.Finder([]).find(tokens)[0].size == 0


def test_ties_go_by_name():
    scores, names = np.array([1.0] * 50 + [2.0, 1.0 + 1e-10, 0.5]), np.array([f"n{i:02d}" for i in range(53)][::-1], object)
    kept = {names[i] for i in P.first(scores, names, 3)}
    assert {"n02", "n01", "n03", "n04", "n05"} == kept  # 2.0, a near tie, and the first three of the ties
