import pytest

from arborlake.functions import stats


def series(spark, **values):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "series string, idx long, value double")


def test_modified_z(spark):
    got = {}
    for r in stats.modified_z(series(spark, two=[1, 2], flat=[5, 5, 5, 5], spike=[1, 2, 1, 2, 1, 2, 100])).collect():
        got.setdefault(r.series, {})[r.idx] = r
    assert all(r.z == 0 for r in [*got["two"].values(), *got["flat"].values()])
    assert got["spike"][6].z == pytest.approx(66.101) and (got["spike"][6].med, got["spike"][6].mad) == (2, 1)


def test_trends(spark):
    d = series(spark, up=range(1, 11), down=range(10, 0, -1), short=[1, 2, 3])
    got = {r.series: r for r in stats.mann_kendall(d).collect()}
    assert (got["up"].s, got["up"].tau, got["up"].trend) == (45, 1, "increasing") and (got["down"].s, got["down"].trend) == (-45, "decreasing")
    assert got["short"].trend == "no_trend" and got["short"].p == 1
    line = {r.series: r for r in stats.theil_sen(series(spark, line=[2, 4, 6, 8, 10], one=[5])).collect()}
    assert (line["line"].slope, line["line"].intercept) == (2, 2) and (line["one"].slope, line["one"].intercept) == (0, 5)


def test_western_electric(spark):
    rules = lambda d, **k: {r.rule for r in stats.western_electric(d, **k).collect()}
    assert 1 in rules(series(spark, a=[0] * 8 + [100]), mean=0.0, sigma=1.0)
    assert 4 in rules(series(spark, a=[0] + [1] * 9), mean=0.5, sigma=0.5)
    assert not rules(series(spark, a=[3] * 8)) and not rules(series(spark, a=[1, 2]))
    assert 2 in rules(series(spark, a=[0] * 6 + [2.5, 2.5]), mean=0.0, sigma=1.0) and 3 in rules(series(spark, a=[0] * 5 + [1.5] * 4), mean=0.0, sigma=1.0)


def test_cusum(spark):
    assert stats.cusum(series(spark, short=[1, 2], flat=[4] * 9)).count() == 0
    values = [0.0] * 20 + [4.0] * 20
    mu = sum(values) / 40
    sd = (sum((v - mu) ** 2 for v in values) / 40) ** 0.5
    p = m = 0.0
    want = []
    for i, v in enumerate(values):
        p, m = max(0, p + v - mu - 0.5 * sd), max(0, m - v + mu - 0.5 * sd)
        if p > 2 * sd:
            want.append((i, "up"))
            p = 0
        if m > 2 * sd:
            want.append((i, "down"))
            m = 0
    assert [(r.idx, r.direction) for r in stats.cusum(series(spark, a=values), h=2.0).orderBy("idx").collect()] == want != []


def test_delta_spark_alerts(spark):
    d = series(spark, a=[0, 5, 5], b=[10, 9, 8, 9, 9, 10, 9, 11, 99])
    got = {(r.series, r.idx): r for r in stats.delta(d).collect()}
    assert got["a", 0].previous is None and got["a", 1].pct == float("inf") and got["b", 1].pct == -10
    bars = {r.series: r for r in stats.sparkline(d).collect()}
    assert bars["a"].spark == "▁██" and bars["b"].direction == "up" and len(bars["b"].spark) == 8
    a = {r.series: r for r in stats.alerts(d).collect()}
    assert a["b"].level == "CRITICAL" and "a" not in a
    assert {r.series: r.level for r in stats.alerts(d, good_up=["b"]).collect()}["b"] == "INFO"
    assert {r.method for r in stats.anomalies(d).collect()} >= {"zscore"}


def test_prices_are_shuffled_once_for_their_rules(spark):
    from arborlake.sources.binding import Model

    found = stats.anomalies(Model(spark, "/root/testdata/sf0.001").prices, method="western")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_a_null_series_has_rules_too(spark):
    rows = [(None, i, float(v)) for i, v in enumerate([0, 1] * 10 + [99])]
    found = stats.western_electric(spark.createDataFrame(rows, "series string, idx long, value double"))
    assert [(r.series, r.idx) for r in found.filter("rule = 1").collect()] == [(None, 20)]
