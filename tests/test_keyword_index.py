"""The kept keyword index: the same hits as without it, and generations of changes only."""

import random

from tidemark.operators import retrieval as R
from tidemark.operators.keyword_index import KeywordIndex

SCHEMA = "name string, trigger string, content string"
COLUMNS = ("name", "trigger", "content")


def hits(spark, entries, index):
    q = spark.createDataFrame([(1, "anan"), (2, "word7 word1"), (3, "日本語版"), (4, "ord"), (5, "e1")], "query_id long, text string")
    return {(r["query_id"], r["name"]): round(r["score"], 9) for r in R.bm25(entries, q, COLUMNS, index=index).collect()}


def test_updates(spark, tmp_path):
    rng = random.Random(2)
    say = lambda: rng.choice([None, "", " ".join(rng.choice(["banana", "日本語版だ", "word"]) + str(rng.randrange(9)) for _ in range(rng.randrange(12)))])
    state = {f"e{i}": (say(), say()) for i in range(40)}
    index, written = KeywordIndex(spark, str(tmp_path / "index"), COLUMNS, most=3), []
    for step in range(6):
        entries = spark.createDataFrame([(k, *v) for k, v in state.items()], SCHEMA)
        written.append(index.update(entries))
        if step in (1, 5):
            want = hits(spark, entries, None)
            assert hits(spark, entries, index) == want and len(want) > 20
        assert index.update(entries) == 0 and len(index.generations()) <= 3
        changed = rng.sample(sorted(state), 3)
        state[changed[0]] = (say(), f"new {step}")
        del state[changed[1]]
        state[f"n{step}"] = (say(), say())
    assert written[0] == 40 and all(0 < n <= 4 for n in written[1:]) and sum(written[1:]) > 9


def test_an_update_that_died_does_not_count(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"), COLUMNS)
    one = spark.createDataFrame([("a", "", "first words"), ("b", None, "other words")], SCHEMA)
    index.update(one)
    # postings of a second generation without its entries
    spark.createDataFrame([("a", "ghost", 1)], "name string, token string, n long").write.parquet(str(tmp_path / "index" / "g00000002" / "postings"))
    assert index.generations() == ["g00000001"] and index.postings().where("token = 'ghost'").count() == 0
    two = spark.createDataFrame([("a", "", "first words"), ("b", None, "changed words")], SCHEMA)
    assert index.update(two) == 1 and {r["token"] for r in index.postings().where("name = 'b'").collect()} == {"changed", "words"}
    assert index.update(spark.createDataFrame([], SCHEMA)) == 2 and index.postings().isEmpty() and index.entries().isEmpty()
