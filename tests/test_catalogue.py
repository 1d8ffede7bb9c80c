"""Every query against its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from arborlake.plans import catalogue

SF = "/root/testdata/sf0.001"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(df, columns):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if hasattr(v, "item"):
            v = v.item()
        return f"{v:.7g}" if isinstance(v, float) and v != int(v if abs(v) < 1e15 else 0) else str(int(v)) if isinstance(v, (float, bool)) and abs(v) < 1e15 else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got, want = Q[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_queries_without_sql_run(spark):
    for name in sorted(set(Q) - set(SQL)):
        assert Q[name](spark, SF).columns


def test_references_of_all_orders_are_resolved(spark, tmp_path):
    """Brute force over a few orders, with keys on both sides of 2000."""
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    supplier = [(1, "a", 0, 1.0), (2, "b", 0, 1.0), (3, "c", 1, 1.0)]
    part = [(k, "x" if k < 4 else "y", "B", "t", k) for k in range(1, 6)]
    items = [(key, n, 1 + (key + n) % 5, 1 + (key * n) % 3) for key in (1, 1999, 2000, 5000) for n in (1, 2, 3)]
    table("supplier", supplier, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    table("nation", [(0, "n", 0), (1, "m", 0)], "n_nationkey int, n_name string, n_regionkey int")
    table("region", [(0, "r")], "r_regionkey int, r_name string")
    table("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    table("lineitem", items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    nation, name = {i: n for i, _, n, _ in supplier}, {i: n for i, n, *_ in part}
    seen = {}
    for _, _, p, s in items:
        seen.setdefault(p, []).append(s)
    file = {p: min(x, key=lambda s: (-x.count(s), s)) for p, x in seen.items()}
    want = {}
    for key, n, p, s in items:
        found = [c for c in file if name[c] == name[p]]
        want[key * 100 + n] = min(found, key=lambda c: (file[c] != s, nation[file[c]] != nation[s], c % 3 == 0, c))
    assert {r.ref: r.target_id for r in Q["resolve_references"](spark, str(tmp_path)).collect()} == want


def test_graph_queries_without_sql_see_every_succession(spark, tmp_path):
    """More than two successions for each supplier; betweenness by counting shortest paths."""
    import itertools

    orders = [(1, 2, 3, 4, 1), (4, 3, 2, 1), (1, 3), (2, 4, 2), (5, 1, 5), (3, 5)]
    items = [(k, n + 1, 1, s, 1.0, 1.0) for k, o in enumerate(orders) for n, s in enumerate(o)]
    spark.createDataFrame([(k,) for k in range(1, 6)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {e for o in orders for e in zip(o, o[1:])}
    assert len(edges) > 2 * 5
    want = dict.fromkeys(range(1, 6), 0.0)
    for a, b in itertools.permutations(range(1, 6), 2):
        paths = [(a, *p, b) for k in range(4) for p in itertools.permutations(set(range(1, 6)) - {a, b}, k) if all(e in edges for e in zip((a, *p), (*p, b)))]
        short = [p for p in paths if len(p) == min(map(len, paths))]
        for p in short:
            for v in p[1:-1]:
                want[v] += 1 / len(short)
    got = {r.id: r.betweenness for r in Q["betweenness"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5)
    for name in ("louvain", "label_propagation"):
        assert Q[name](spark, str(tmp_path)).count() == 5


def test_references_never_meet_all_symbols_of_their_name(spark):
    """One name, 3,000 symbols of it and 3,000 files that refer to it: no table has a row for each pair."""
    from pyspark.sql import functions as F

    from arborlake.operators import resolve

    n = 3000
    files = spark.range(n).select("id", F.concat(F.lit("d"), (F.col("id") % 50).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"))
    symbols = spark.range(n).select("id", (F.col("id") * 2).alias("file_id"), F.lit("get").alias("name"), F.when(F.col("id") % 3 > 0, 1).otherwise(0).alias("is_exported"))
    refs = spark.range(n).select(F.col("id").alias("ref"), F.col("id").alias("file_id"), F.lit("get").alias("target_name"))
    found = resolve.nearest_homonym(refs, symbols, files)
    got = {r.ref: r.target_id for r in found.collect()}
    at = {k: 2 * k for k in range(n // 2)}
    want = {r: min(at, key=lambda k: (at[k] != r, at[k] % 50 != r % 50, k % 3 == 0, k)) for r in range(0, n, 97)}
    assert {r: got[r] for r in want} == want and len(got) == n

    def most(plan):
        inner = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
        below = plan.children()
        inner += [below.apply(k) for k in range(below.size())] + ([plan.plan()] if "QueryStageExec" in plan.getClass().getSimpleName() else [])
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(most, inner)])

    assert 0 < most(found._jdf.queryExecution().executedPlan()) <= 2 * n


def test_tasks_of_cochange_grow_with_the_input(spark):
    import itertools

    from pyspark.sql import functions as F

    from arborlake.operators import temporal

    small, large = (spark.range(n).select((F.col("id") / 5).cast("long").alias("commit_id"), (F.col("id") * 7 % 11).alias("file_id")) for n in (1000, 20_000_000))
    tasks = temporal.tasks_for(large)
    assert temporal.tasks_for(small) == 8 and tasks > 16 and "REPARTITION_BY_NUM" in temporal.cochange(large)._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k in range(200):
        for p in itertools.combinations(sorted({i * 7 % 11 for i in range(5 * k, 5 * k + 5)}), 2):
            want[p] = want.get(p, 0) + 1
    assert {(r.file_id_a, r.file_id_b): r.cochange_count for r in temporal.cochange(small).collect()} == want


@pytest.mark.parametrize("name", ["western_electric", "top_churn"])
def test_partitions_of_every_query_grow_with_the_tables(spark, db, monkeypatch, name):
    """With a partition for every 8,000 bytes of tables; small tables leave the session as it is."""
    from arborlake import session
    from arborlake.sources.binding import Model

    assert Model(spark, SF).spark is spark
    monkeypatch.setattr(session, "PARTITION_BYTES", 8000)
    m = Model(spark, SF)
    n = -(-session.size_of(spark, SF) // 8000)
    assert n > 20 and m.spark.conf.get("spark.sql.shuffle.partitions") == str(n) and spark.conf.get("spark.sql.shuffle.partitions") == "8"
    assert m.spark.conf.get("spark.sql.session.timeZone") == "UTC" and m.spark.sparkContext is spark.sparkContext
    got, want = Q[name](spark, SF), db.sql(SQL[name]).df()
    assert got.sparkSession.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8000b"
    assert rows(got.toPandas(), sorted(want.columns)) == rows(want, sorted(want.columns))
