"""A keyword query meets the entries of its rarest phrase, not those of all its phrases."""

from tidemark.functions import keywords as K
from tidemark.operators import retrieval as R
from tidemark.work import Work


def join_rows(df):
    """The most rows that a join of the executed plan gave."""
    most = [0]

    def walk(node):
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            most.append(metrics.apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(most)


def test_a_query_meets_the_entries_of_its_rarest_phrase(spark):
    entries = spark.range(600).selectExpr("concat('d', id) AS name", "concat('common word', IF(id % 200 = 7, ' rareone', ''), IF(id % 2 = 0, ' second', '')) AS content")
    queries = spark.range(40).selectExpr("id AS query_id", "CASE id % 4 WHEN 0 THEN 'common rareone' WHEN 1 THEN 'rareone common second' WHEN 2 THEN 'common' ELSE 'common nowhere' END AS text")
    queries = queries.where("query_id % 4 <> 2 OR query_id = 2")
    assert queries.select(K.mode("text").alias("m")).distinct().collect()[0]["m"] == "match"
    rows, work = R.postings(entries, ("content",), "name"), Work(spark, "rarest")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = R.phrase_scores(lambda tokens: rows.join(tokens, "token"), R.lengths(entries, ("content",), "name"), R.token_grams(rows.select("token").distinct()), R.phrases(queries), work)
        got = hits.collect()
        assert join_rows(hits) <= 800  # 600 of query 2 and 3 of each other query's phrases; all queries with all entries of `common` are 18,600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["name"])
    assert found.pop(2) == {f"d{i}" for i in range(600)}
    assert found == {i: {"d7", "d207", "d407"} for i in range(0, 40, 4)}  # 7, 207 and 407 are odd: none has `second`
