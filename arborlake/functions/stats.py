"""Statistics of time series: a row per series and idx, with a value.

Series are short (snapshots of a project), and many: each statistic is a grouped aggregate or a fold
over a series' sorted array, so series are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _median(arr: Column) -> Column:
    """Of an array of numbers; null if it is empty."""
    s, n = F.sort_array(arr), F.size(arr)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: v, its values in order of idx."""
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("x"))
    return g.select(*keys, F.transform("x", lambda p: p["idx"]).alias("i"), F.transform("x", lambda p: p["value"].cast("double")).alias("v"))


def modified_z(df: DataFrame, keys: list[str] = ("series",)) -> DataFrame:
    """0.6745 (v - median) / MAD; zeros for fewer than 3 values or a MAD of 0."""
    keys = list(keys)
    a = arrays(df, keys).withColumn("med", _median(F.col("v")))
    a = a.withColumn("mad", _median(F.transform("v", lambda x: F.abs(x - F.col("med")))))
    z = F.when((F.size("v") < 3) | (F.col("mad") == 0), F.transform("v", lambda x: F.lit(0.0))).otherwise(F.transform("v", lambda x: (x - F.col("med")) / (F.col("mad") / 0.6745)))
    return a.withColumn("z", z).select(*keys, "med", "mad", F.explode(F.arrays_zip("i", "v", "z")).alias("p")).select(*keys, F.col("p.i").alias("idx"), F.col("p.v").alias("value"), "med", "mad", F.round("p.z", 6).alias("z"))


def pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """All i < j of each series."""
    a, b = df.select(*keys, F.col("idx").alias("i"), F.col("value").alias("vi")), df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("idx").alias("j"), F.col("value").alias("vj"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, same & (F.col("i") < F.col("j"))).drop(*[f"_{k}" for k in keys])


def theil_sen(df: DataFrame, keys: list[str] = ("series",), x: str = "idx") -> DataFrame:
    """Median of pairwise slopes, and the median intercept; a single point: slope 0 through it."""
    keys = list(keys)
    slopes = pairs(df, keys).filter("i <> j").groupBy(*keys).agg(F.expr("percentile((vj - vi) / (j - i), 0.5)").alias("slope"))
    j = df.join(slopes, keys, "left").withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    return j.groupBy(*keys).agg(F.round(F.max("slope"), 6).alias("slope"), F.round(F.expr("percentile(value - slope * idx, 0.5)"), 6).alias("intercept"))


def normal_cdf(x: Column) -> Column:
    """An approximation whose polynomial is applied to x itself: kept for parity with published p-values; see normal_cdf_exact."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return 0.5 * (1 + F.signum(x) * (1 - poly * F.exp(-a * a / 2)))


def normal_cdf_exact(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for erf(x / sqrt 2): the error is below 2e-7."""
    a = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return 0.5 * (1 + F.signum(x) * (1 - poly * F.exp(-a * a)))


def mann_kendall(df: DataFrame, keys: list[str] = ("series",)) -> DataFrame:
    """S, tau, p and the trend at 5 %, with the variance corrected for ties; fewer than 4 values: no trend."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    s = pairs(df, keys).groupBy(*keys).agg(F.sum(F.signum(F.col("vj") - F.col("vi"))).cast("long").alias("s"))
    t = df.groupBy(*keys, "value").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"))
    j = n.join(s, keys, "left").join(t, keys)
    k = F.col("n")
    var = (k * (k - 1) * (2 * k + 5) - F.col("ties")) / 18.0
    z = F.when(var <= 0, 0.0).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    p = F.when(k < 4, 1.0).otherwise(2 * (1 - normal_cdf(F.abs(z))))
    trend = F.when((k < 4) | (p >= 0.05), "no_trend").when(F.col("s") > 0, "increasing").otherwise("decreasing")
    return j.select(*keys, "n", F.when(k < 4, 0).otherwise(F.col("s")).cast("long").alias("s"), F.round(F.when(k < 4, 0.0).otherwise(F.col("s") / (k * (k - 1) / 2)), 6).alias("tau"), F.round(p, 6).alias("p"), trend.alias("trend"))


def western_electric(df: DataFrame, keys: list[str] = ("series",), mean: float | None = None, sigma: float | None = None) -> DataFrame:
    """Violations (idx, rule): 1 point beyond 3 sigma; 2 of 3 beyond 2; 4 of 5 beyond 1; 8 on one side. Fewer than 8 values or no spread: none.

    All are windows over a series, so values are shuffled once and meet no other table."""
    keys = list(keys)
    own = W.partitionBy(*keys)
    mu, sd = F.lit(mean) if mean is not None else F.avg("value").over(own), F.lit(sigma) if sigma is not None else F.stddev_pop("value").over(own)
    j = df.select(*keys, "idx", "value", F.count("*").over(own).alias("n"), mu.alias("mu"), sd.alias("sd"))
    j = j.filter("n >= 8 AND sd >= 1e-12").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd"))
    w = W.partitionBy(*keys).orderBy("idx")

    def count(cond: Column, k: int) -> Column:
        return F.sum(cond.cast("int")).over(w.rowsBetween(-(k - 1), 0))

    z, at = F.col("z"), F.row_number().over(w)
    rules = [
        F.when(F.abs(z) > 3, 1),
        F.when((at >= 3) & ((count(z > 2, 3) >= 2) | (count(z < -2, 3) >= 2)), 2),
        F.when((at >= 5) & ((count(z > 1, 5) >= 4) | (count(z < -1, 5) >= 4)), 3),
        F.when((at >= 8) & ((count(z > 0, 8) == 8) | (count(z < 0, 8) == 8)), 4),
    ]
    return j.withColumn("rules", F.array_compact(F.array(*rules))).select(*keys, "idx", "value", F.explode("rules").alias("rule"))


def cusum(df: DataFrame, keys: list[str] = ("series",), h: float = 5.0, k: float = 0.5) -> DataFrame:
    """Points at which a one-sided cumulative sum (drift k sigma) passes h sigma; the sum then starts anew. Fewer than 5 values or no spread: none."""
    keys = list(keys)
    a = arrays(df, keys).filter(F.size("v") >= 5)
    a = a.withColumn("mu", F.expr("aggregate(v, 0D, (s, x) -> s + x) / size(v)")).withColumn("sd", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + (x - mu) * (x - mu)) / size(v))")).filter("sd >= 1e-12")
    fold = f"""aggregate(sequence(0, size(v) - 1),
      named_struct('p', 0D, 'm', 0D, 'out', cast(array() as array<struct<idx: bigint, direction: string, magnitude: double>>)),
      (s, q) -> transform(array(named_struct('p', greatest(0D, s.p + v[q] - mu - {k} * sd), 'm', greatest(0D, s.m - v[q] + mu - {k} * sd), 'out', s.out)),
        t -> named_struct('p', if(t.p > {h} * sd, 0D, t.p), 'm', if(t.m > {h} * sd, 0D, t.m),
          'out', concat(t.out, if(t.p > {h} * sd, array(named_struct('idx', cast(i[q] as bigint), 'direction', 'up', 'magnitude', t.p / sd)), cast(array() as array<struct<idx: bigint, direction: string, magnitude: double>>)),
                               if(t.m > {h} * sd, array(named_struct('idx', cast(i[q] as bigint), 'direction', 'down', 'magnitude', t.m / sd)), cast(array() as array<struct<idx: bigint, direction: string, magnitude: double>>)))))[0]).out"""
    return a.withColumn("o", F.expr(fold)).select(*keys, F.explode("o").alias("o")).select(*keys, F.col("o.idx").alias("idx"), F.col("o.direction").alias("direction"), F.round("o.magnitude", 6).alias("magnitude"))


def anomalies(df: DataFrame, keys: list[str] = ("series",), method: str = "auto", limit: float = 3.0) -> DataFrame:
    """One table of what the methods find: zscore, western, cusum, or all (auto)."""
    keys = list(keys)
    parts = []
    if method in ("auto", "zscore"):
        parts.append(modified_z(df, keys).filter(F.abs("z") > limit).select(*keys, "idx", F.lit("zscore").alias("method"), F.format_string("%.3f", "z").alias("detail")))
    if method in ("auto", "western"):
        parts.append(western_electric(df, keys).select(*keys, "idx", F.lit("western").alias("method"), F.concat(F.lit("rule "), F.col("rule")).alias("detail")))
    if method in ("auto", "cusum"):
        parts.append(cusum(df, keys).select(*keys, "idx", F.lit("cusum").alias("method"), F.col("direction").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delta(df: DataFrame, keys: list[str] = ("series",)) -> DataFrame:
    """Change against the previous value, absolute and in percent (infinite from 0)."""
    before = F.lag("value").over(W.partitionBy(*keys).orderBy("idx"))
    d = df.select(*keys, "idx", "value", before.alias("previous"))
    pct = F.when(F.col("previous").isNull(), None).when(F.col("previous") == 0, F.when(F.col("value") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise((F.col("value") - F.col("previous")) / F.abs("previous") * 100)
    return d.select(*keys, "idx", "value", "previous", F.round(F.col("value") - F.col("previous"), 6).alias("change"), F.round(pct, 6).alias("pct"))


BARS = "▁▂▃▄▅▆▇█"


def sparkline(df: DataFrame, keys: list[str] = ("series",), last: int = 8) -> DataFrame:
    """The last values as bars between their least and greatest, and the direction beyond 2 %."""
    a = arrays(df, list(keys)).withColumn("t", F.slice("v", F.greatest(F.lit(1), F.size("v") - (last - 1)), last))
    low, high = F.array_min("t"), F.array_max("t")
    a = a.withColumn("low", low).withColumn("high", high)
    level = lambda x: F.when(F.col("high") == F.col("low"), 4).otherwise(F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * 7 + 0.5) + 1)
    bars = F.array_join(F.transform("t", lambda x: F.substring(F.lit(BARS), level(x).cast("int"), F.lit(1))), "")
    first, end = F.get("t", F.lit(0)), F.element_at("t", -1)
    change = F.when(first == 0, F.signum(end)).otherwise((end - first) / F.abs(first))
    return a.select(*keys, bars.alias("spark"), F.when(change > 0.02, "up").when(change < -0.02, "down").otherwise("flat").alias("direction"))


def alerts(df: DataFrame, keys: list[str] = ("series",), threshold: float = 2.0, good_up: list[str] = (), recent: int = 3) -> DataFrame:
    """The latest value of each series by |z|: CRITICAL above 3, WARNING above threshold; a recent rule violation: INFO. A move in the good direction is INFO at most."""
    keys = list(keys)
    z = modified_z(df, keys)
    last = z.groupBy(*keys).agg(F.max("idx").alias("last"))
    now = z.join(last, keys).filter("idx = last").select(*keys, "last", "value", "z")
    rule = western_electric(df, keys).join(last, keys).filter(F.col("idx") > F.col("last") - recent).groupBy(*keys).agg(F.min("rule").alias("rule"))
    j = now.join(rule, keys, "left")
    level = F.when(F.abs("z") > 3, "CRITICAL").when(F.abs("z") > threshold, "WARNING").when(F.col("rule").isNotNull(), "INFO")
    good = F.col(keys[0]).isin(list(good_up)) & (F.col("z") > 0) if good_up else F.lit(False)
    order = F.element_at(F.create_map(*[F.lit(x) for kv in {"CRITICAL": 0, "WARNING": 1, "INFO": 2}.items() for x in kv]), F.col("level"))
    return j.withColumn("level", F.when(good & level.isNotNull(), "INFO").otherwise(level)).filter("level IS NOT NULL").withColumn("ord", order).select(*keys, "last", "value", "z", "rule", "level", "ord")
