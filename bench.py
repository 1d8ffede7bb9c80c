"""Runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line; duckdb: the same SQL there, as a yardstick."""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "coupling", "cochange_pairs", "cochange_entropy", "hyperedges", "file_stats", "file_edges", "callers", "symbol_search", "dead_exports_anti", "line_containment_range_join", "uses_by_kind",
    "complexity_by_file", "file_risk", "weather_hotspots", "western_electric", "mann_kendall", "modified_zscore", "degrees", "scc", "layers", "pagerank", "indent_complexity", "resolve_references", "changed_files",
]


WARM_UP = ["coupling", "degrees"]  # so that the first query doesn't carry the JVM's start


def yardstick(sf: str, sql: dict[str, str], limit: float = 60.0) -> dict[str, float]:
    """Seconds of the same queries in DuckDB, as far as limit seconds go."""
    import duckdb

    db, times, end = duckdb.connect(), {}, time.perf_counter() + limit
    db.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in os.listdir(sf):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    for name in HEADLINE:
        left = end - time.perf_counter()
        if name not in sql or left <= 0:
            continue
        began, timer = time.perf_counter(), threading.Timer(left, db.interrupt)
        timer.start()
        try:
            db.execute(sql[name]).fetchall()
            times[name] = round(time.perf_counter() - began, 3)
        except duckdb.InterruptException:
            pass
        finally:
            timer.cancel()
    return times


def main() -> None:
    from arborlake.plans import catalogue
    from arborlake.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}
    for name in WARM_UP:
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "duckdb": yardstick(sf, catalogue.oracle_sql()), "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
