"""Evaluation statistics over results of runs: votes, paired tests, intervals, percentiles, ROC curves and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Two-sided 95 % points of Student's t by degrees of freedom.
T_95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571,
    6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131,
    16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086,
    21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064, 25: 2.060,
    26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045, 30: 2.042,
    40: 2.021, 60: 2.000, 120: 1.980,
}
T_BEYOND = 1.962
RANGES = 64
Z_95 = 1.96
ADVERSARIAL_WEIGHT = 0.676  # of wrongly flagged answerable questions in the net count


def t_point(df: Column) -> Column:
    """The tabulated point; between entries that of the next larger degrees of freedom."""
    out = F.when(df <= 0, 0.0)
    for n in sorted(T_95):
        out = out.when(df <= n, T_95[n])
    return out.otherwise(T_BEYOND)


def exact_p(b, c) -> Column:
    """Exact two-sided p of b against c discordant pairs, 1 where they are equal: a binomial tail summed from its logarithms.

    Terms go from the tail's largest downwards and end once they no longer count, so that any counts are fine.
    """
    b, c = (F.col(x) if isinstance(x, str) else x for x in (b, c))
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    first = log_choose(n, k) - n * F.log(F.lit(2.0))
    # the term of i - 1 is that of i times i / (n - i + 1); within a few standard deviations of the middle all that counts
    far = F.least(k, F.ceil(12 * F.sqrt(n) + 60)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    step = lambda acc, j: F.struct((acc["term"] * (k - j + 1) / (n - k + j)).alias("term"), (acc["total"] + acc["term"] * (k - j + 1) / (n - k + j)).alias("total"))
    tail = F.when(far >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(far, F.lit(1))), start, step)["total"]).otherwise(1.0)
    return F.when(b == c, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(first) * tail))


def log_gamma(x: Column) -> Column:
    """Stirling's series, after the argument is raised to 8 at least: some 14 digits."""
    shift = F.when(x < 8, F.lit(8.0)).otherwise(0.0)
    low = sum((F.log(x + i) for i in range(8)), F.lit(0.0))
    z = x + shift
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.when(x < 8, low).otherwise(0.0)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def discordant(rows: DataFrame, by: list[str], control: str = "control", treatment: str = "treatment") -> DataFrame:
    a, b = F.col(control), F.col(treatment)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"))


def paired_interval(rows: DataFrame, by: list[str], control: str = "control", treatment: str = "treatment") -> DataFrame:
    """Mean difference in percentage points with its normal interval."""
    d = F.col(treatment).cast("int") - F.col(control).cast("int")
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    margin = F.coalesce(F.lit(Z_95) * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return stats.select(*by, "n", (100 * F.col("mean")).alias("delta_pp"), (100 * (F.col("mean") - margin)).alias("low_pp"), (100 * (F.col("mean") + margin)).alias("high_pp"))


def holm_gate(tests: DataFrame, p: str, name: str, alpha: float = 0.05) -> DataFrame:
    """Step-down gate: in order of p and name the i-th of m passes below alpha / (m - i), and all after a failure fail."""
    order = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    ranked = tests.withColumn("threshold", alpha / (m - F.row_number().over(order) + 1))
    return ranked.withColumn("rejected", F.min((F.col(p) <= F.col("threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def holm_adjusted(tests: DataFrame, p: str, name: str) -> DataFrame:
    order = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return tests.withColumn("scaled", scaled).withColumn("adjusted", F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("scaled")


def wilson(k: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    p = k / n
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - spread, F.lit(0.0)), F.least(centre + spread, F.lit(1.0))


def sweep(rows: DataFrame) -> DataFrame:
    """Points of a sweep over distinct scores of (score, positive, always): flagged positives and negatives at or above each threshold.

    Rows that are always flagged count from the first threshold, which lies above all scores (infinite). Scores are dealt
    to ranges; each range sums its own, and the totals of the ranges above are added: no task has all of them.
    """
    base = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"), F.count_if(F.col("positive") & F.col("always")).alias("bp"), F.count_if(~F.col("positive") & F.col("always")).alias("bn"))
    free = ~F.col("always")
    at = rows.groupBy(F.col("score").alias("threshold")).agg(F.count_if(F.col("positive") & free).alias("pos"), F.count_if(~F.col("positive") & free).alias("neg"))
    cuts = at.approxQuantile("threshold", [i / 64 for i in range(1, 64)], 0.005) if at.limit(1).count() else []
    part = sum(((F.col("threshold") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    at = at.withColumn("part", part)
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("part").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))  # 64 rows at most
    sums = sums.select("part", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("up"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("un"))
    down = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    swept = at.join(F.broadcast(sums), "part").select("threshold", (F.sum("pos").over(down) + F.col("up")).alias("tp"), (F.sum("neg").over(down) + F.col("un")).alias("fp"))
    first = base.select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    both = first.union(swept).crossJoin(F.broadcast(base))  # base: one row
    both = both.withColumn("tp", F.col("tp") + F.col("bp")).withColumn("fp", F.col("fp") + F.col("bn"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("threshold", "tp", "fp", share("tp", "p").alias("recall"), share("fp", "n").alias("false_rate"), F.round(F.col("tp") - F.col("fp") * ADVERSARIAL_WEIGHT).cast("long").alias("net"))


def roc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Points (threshold, tp, fp, recall, false_rate, net) of a sweep over distinct scores, the first above all of them."""
    return sweep(rows.select(F.col(score).cast("double").alias("score"), F.col(positive).alias("positive"), F.lit(False).alias("always")))


def auc(points: DataFrame) -> DataFrame:
    """Area by trapezoids between neighbouring points (false_rate, recall), in this order.

    Points are dealt to ranges of the false rate; each range sums its own trapezoids, and the ranges' first and last
    points give those between ranges: no task has all points.
    """
    cuts = points.approxQuantile("false_rate", [i / RANGES for i in range(1, RANGES)], 0.005) if points.limit(1).count() else []
    dealt = points.select("false_rate", "recall", sum(((F.col("false_rate") > c).cast("int") for c in sorted(set(cuts))), F.lit(0)).alias("part"))
    x, y = F.col("false_rate"), F.col("recall")

    def areas(rows: DataFrame, order, x, y, before_x, before_y) -> DataFrame:
        return rows.select(((x - F.lag(before_x, 1).over(order)) * (y + F.lag(before_y, 1).over(order)) / 2).alias("area"))

    inner = areas(dealt, Window.partitionBy("part").orderBy("false_rate", "recall"), x, y, x, y)
    ends = dealt.groupBy("part").agg(F.min(F.struct("false_rate", "recall")).alias("a"), F.max(F.struct("false_rate", "recall")).alias("b"))  # RANGES rows at most
    outer = areas(ends, Window.orderBy("part"), F.col("a.false_rate"), F.col("a.recall"), F.col("b.false_rate"), F.col("b.recall"))
    return inner.union(outer).agg(F.least(F.greatest(F.coalesce(F.sum("area"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("auc"))


def percentile_ceil(x: str, p: float) -> Column:
    """The value of rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def percentile_ranked(rows: DataFrame, by: list[str], x: str, p: float, rule: str) -> DataFrame:
    """Nearest-rank percentile by another rule: half_up is rank floor(n p + 0.5), zero_based index round-half-even(p (n - 1))."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("nth", F.row_number().over(w.orderBy(x))).withColumn("n", F.count("*").over(w))
    if rule == "half_up":
        want = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") * p + 0.5)))
    else:
        want = F.bround(p * (F.col("n") - 1)).cast("long") + 1
    return ranked.where(F.col("nth") == want).select(*by, F.col(x).alias("value"))
