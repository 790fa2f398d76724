"""Lifecycle requests by id and revision: a plain machine, and the same whatever way the requests are dealt to batches."""

import random

from tidemark.operators import lifecycle as L
from tidemark.operators.lineage import NEXT

SCHEMA = "item long, seq long, action string, request_id string, revision long"


def plain(rows):
    heads, out = {}, {}
    for item, seq, action, request, revision in sorted(rows, key=lambda r: r[1]):
        state, now, seen = heads.get(item, ("none", 0, {}))
        if state == "none":
            o = "applied" if action == "append" else "missing"
        elif state == "purged":
            o = "repeated" if action == "purge" else "purged"
        elif request and request in seen:
            o = "repeated" if seen[request] == action else "conflict"
        elif revision is not None and revision != now:
            o = "stale"
        else:
            o = "applied" if (state, action) in NEXT else "refused"
        if o == "applied":
            heads[item] = ("active" if state == "none" else NEXT[state, action], now + 1, {**seen, **({request: action} if request else {})})
        out[item, seq] = (o, heads[item][1] if item in heads else 0)
    return heads, out


def requests(n=300):
    rng = random.Random(11)
    return [(rng.randrange(12), k, rng.choice(["append", "tombstone", "tombstone", "restore", "restore", "purge" if k % 3 == 0 else "restore", "odd"]), rng.choice([None, "", "a", "b", "c", "d"]), rng.choice([None, None, 1, 2])) for k in range(n)]


def heads_of(df):
    return {r["item"]: (r["state"], r["revision"], dict(r["recorded"])) for r in df.collect()}


def test_batch(spark):
    rows = requests()
    after, outcomes = L.applied(spark.createDataFrame([], L.HEADS), spark.createDataFrame(rows, SCHEMA))
    heads, out = plain(rows)
    assert heads_of(after) == heads and {(r["item"], r["seq"]): (r["outcome"], r["revision"]) for r in outcomes.collect()} == out
    assert {o for o, _ in out.values()} == {"applied", "repeated", "conflict", "purged", "stale", "missing", "refused"}


def test_stream_in_batches_of_any_size(spark, tmp_path):
    rows, rng = requests(120), random.Random(5)
    cuts = sorted(rng.sample(range(1, 120), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 120])]
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        L.follow(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    heads, out = plain(rows)
    assert heads_of(L.latest(spark, str(tmp_path / "out"), len(parts))) == heads
    got = {(r["item"], r["seq"]): (r["outcome"], r["revision"]) for n in range(len(parts)) for r in spark.read.parquet(str(tmp_path / "out" / f"outcomes-{n}")).collect()}
    assert got == out
    # a request that comes again by its id changes nothing
    again = [(i, 1000 + s, a, r, None) for i, s, a, r, _ in rows if r and out[i, s][0] == "applied" and heads[i][0] != "purged" and heads[i][2].get(r) == a]
    after, told = L.applied(L.latest(spark, str(tmp_path / "out"), len(parts)), spark.createDataFrame(again, SCHEMA))
    assert heads_of(after) == heads and {r["outcome"] for r in told.collect()} <= {"repeated"}
