"""Events before or after an anchor: a range of the order of all events, found by numbers."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import search as S


def test_directional_meets_no_more_than_it_returns(spark):
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(hours=h) for h in (0, 0, 0, 5, 24, 24, 30, 96, 97, 97, 400)] + [None]
    events = [(f"e{i:02d}", t, t + dt.timedelta(hours=2) if t and i % 3 == 0 else None) for i, t in enumerate(times)]
    entries = spark.createDataFrame(events, "name string, event_start timestamp, event_end timestamp").withColumn("trigger", F.lit("")).withColumn("content", F.lit("")).withColumn("updated_at", F.col("event_start"))
    days = [0, 1, 2, 4, 5, 30]
    asked = spark.createDataFrame([(2 * k + i, (side, dt.date(2024, 1, 1) + dt.timedelta(days=d), "")) for k, d in enumerate(days) for i, side in enumerate(("before", "after"))], "query_id long, w struct<intent:string,at:date,entity:string>")
    found = S.directional({"entries": entries}, asked, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "query_id" in line for line in plan.splitlines())  # before, each query sorted whole days of events
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["name"]))
    for r in asked.collect():
        at, before = dt.datetime.combine(r["w"]["at"], dt.time()), r["w"]["intent"] == "before"
        of = [(n, (e or s) if before else (s or e)) for n, s, e in events if s]
        ahead = sorted((abs(t - at), n) for n, t in of if (t < at if before else t > at))[:4]
        assert got.get(r["query_id"], []) == [(i + 1, n) for i, (_, n) in enumerate(ahead)]
