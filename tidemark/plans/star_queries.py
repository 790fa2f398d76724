"""Relational operators of every kind over the star schema."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.plans.registry import query

_R = "CAST(round({}, 2) AS DOUBLE)"


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def star_pricing(t):
    g = t.lineitem.where(F.col("l_shipdate") <= "1998-09-02").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def star_join(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    j = j.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def star_semi(t):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def star_anti(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT coalesce(n_name, '*') AS nation, coalesce(o_orderstatus, '*') AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)")
def star_rollup(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("n_name", F.lit("*")).alias("nation"), F.coalesce("o_orderstatus", F.lit("*")).alias("status"), "n", "total")


@query("SELECT coalesce(p_brand, '*') AS brand, coalesce(CAST(p_size AS VARCHAR), '*') AS size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def star_cube(t):
    return t.part.cube("p_brand", "p_size").agg(F.count("*").alias("n")).select(F.coalesce("p_brand", F.lit("*")).alias("brand"), F.coalesce(F.col("p_size").cast("string"), F.lit("*")).alias("size"), "n")


@query("SELECT o_custkey, o_orderkey, rank, round(running, 2) AS running, round(o_totalprice - coalesce(prev, 0), 2) AS change FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS rank, sum(o_totalprice) OVER w AS running, lag(o_totalprice) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def star_window(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank"), F.sum("o_totalprice").over(w).alias("running"), F.lag("o_totalprice").over(w).alias("prev"), "o_totalprice")
    return rows.select("o_custkey", "o_orderkey", "rank", F.round("running", 2).alias("running"), F.round(F.col("o_totalprice") - F.coalesce("prev", F.lit(0.0)), 2).alias("change"))


@query("SELECT k FROM ((SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders) UNION (SELECT s_suppkey FROM supplier INTERSECT SELECT l_suppkey FROM lineitem))")
def star_set_ops(t):
    a = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))
    return a.union(t.supplier.select("s_suppkey").intersect(t.lineitem.select("l_suppkey"))).distinct()


@query("SELECT p_partkey, name, rank FROM (SELECT p_partkey, p_name AS name, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def star_topk(t):
    from tidemark.operators.retrieval import top

    return top(t.part, ["p_type"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_partkey", F.col("p_name").alias("name"), F.col("rank").cast("long").alias("rank"))


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def star_pivot(t):
    g = t.lineitem.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count()
    return g.select("l_linestatus", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "ANR"])


@query("SELECT s_suppkey, coalesce(count(l_orderkey), 0) AS lines, coalesce(count(DISTINCT l_partkey), 0) AS parts FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY 1")
def star_outer(t):
    return t.supplier.join(t.lineitem.where("l_quantity > 45"), F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("lines"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("""SELECT user_id, CAST(s AS BIGINT) AS s, count(*) AS n, min(ts) AS first_ts FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY 1, 2""")
def event_sessions(t):
    g = t.events.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return g.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long").alias("s"), "n", "first_ts")
