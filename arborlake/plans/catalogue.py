"""The named queries over the star-schema binding, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions import classify, stats, strings
from arborlake.operators import complexity, graph, incremental, ranking, relational, resolve, scoring, temporal
from arborlake.sources.binding import Model, oracle

_Q: dict[str, Callable[[Model], DataFrame]] = {}
_SQL: dict[str, str] = {}
NEEDLE, FILE, SYMBOL, CLUSTER, NOW = "ring", 7, 12, 3, 1_000_000_000


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Model], DataFrame]):
        _Q[name] = f
        if sql:
            _SQL[name] = oracle(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Model(spark, sf_dir))) for name, f in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files change together: pairs in at least two commits, classed, most coupled first."""
    return _Q["coupling"](Model(spark, sf_dir))


def ids(m: Model, column: str, *values: int) -> DataFrame:
    return m.spark.createDataFrame([(v,) for v in values], f"{column} long")


SYM = "s.id, s.name, s.kind, f.path AS file_path"


def sym(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "name", "kind", "file_path", *more)


# lookups

query("file_by_path", "SELECT id, path, language FROM files WHERE path = (SELECT path FROM files WHERE id = 7)")(
    lambda m: m.files.join(relational.by_id(m.files, "id", FILE).select("path"), "path", "left_semi").select("id", "path", "language")
)
query("file_by_id", "SELECT id, path FROM files WHERE id = 7")(lambda m: relational.by_id(m.files, "id", FILE).select("id", "path"))
query("all_files", "SELECT * FROM files")(lambda m: m.files)
query("files_by_language", "SELECT id, path FROM files WHERE language = 'ASIA'")(lambda m: relational.files_by_language(m.files, "ASIA").select("id", "path"))
query("file_count", "SELECT COUNT(*) AS n FROM files")(lambda m: m.files.agg(F.count("*").alias("n")))
query("symbols_in_file", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE f.id = 7")(lambda m: sym(relational.with_path(m.symbols.filter(f"file_id = {FILE}"), m.files)))
query("symbol_by_name", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.name = 'red widget'")(lambda m: sym(relational.symbols_by(m.symbols, m.files, "name", "red widget")))
query("symbol_by_qualified", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.qualified_name = 'Brand#17.red widget'")(lambda m: sym(relational.symbols_by(m.symbols, m.files, "qualified_name", "Brand#17.red widget")))
query("symbol_by_id", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.id = 12")(lambda m: sym(relational.symbols_by(m.symbols, m.files, "id", SYMBOL)))
query("symbol_search", f"SELECT {SYM}, pagerank FROM symbols s JOIN files f ON s.file_id = f.id LEFT JOIN graph_metrics g ON g.symbol_id = s.id WHERE s.name ILIKE '%RING%' ORDER BY pagerank DESC, s.id LIMIT 20")(
    lambda m: sym(relational.search_symbols(m.symbols, m.files, m.graph_metrics, "RING", 20), "pagerank")
)
query("exported_symbols", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE is_exported = 1")(lambda m: sym(relational.exported_symbols(m.symbols, m.files)))
query("top_by_pagerank", f"SELECT {SYM}, pagerank FROM symbols s JOIN files f ON s.file_id = f.id JOIN graph_metrics g ON g.symbol_id = s.id WHERE s.kind IN ('function', 'class', 'method') ORDER BY pagerank DESC, s.id LIMIT 15")(
    lambda m: sym(relational.ranked(m.symbols, m.files, m.graph_metrics, [F.desc("pagerank")], 15, relational.CALLABLE), "pagerank")
)
query("top_by_betweenness", f"SELECT {SYM}, betweenness FROM symbols s JOIN files f ON s.file_id = f.id JOIN graph_metrics g ON g.symbol_id = s.id ORDER BY betweenness DESC, s.id LIMIT 15")(
    lambda m: sym(relational.ranked(m.symbols, m.files, m.graph_metrics, [F.desc("betweenness")], 15), "betweenness")
)
query("top_by_degree", f"SELECT {SYM}, in_degree, out_degree FROM symbols s JOIN files f ON s.file_id = f.id JOIN graph_metrics g ON g.symbol_id = s.id ORDER BY in_degree + out_degree DESC, s.id LIMIT 50")(
    lambda m: sym(relational.ranked(m.symbols, m.files, m.graph_metrics, [(F.col("in_degree") + F.col("out_degree")).desc()], 50), "in_degree", "out_degree")
)
_NEAR = "SELECT s.id, s.name, s.kind, f.path AS file_path, e.kind AS edge_kind, e.line AS edge_line FROM edges e JOIN symbols s ON e.{} = s.id JOIN files f ON s.file_id = f.id WHERE e.{} = 12"
query("callers", _NEAR.format("source_id", "target_id"))(lambda m: sym(relational.callers(m.edges, m.symbols, m.files, ids(m, "id", SYMBOL)), "edge_kind", "edge_line"))
query("callees", _NEAR.format("target_id", "source_id"))(lambda m: sym(relational.callees(m.edges, m.symbols, m.files, ids(m, "id", SYMBOL)), "edge_kind", "edge_line"))
query("all_edges", "SELECT * FROM edges")(lambda m: m.edges)
query("all_file_edges", "SELECT * FROM file_edges")(lambda m: m.file_edges)
query("file_imports", "SELECT f.id, path, CAST(SUM(symbol_count) AS BIGINT) AS symbol_count FROM file_edges e JOIN files f ON e.target_file_id = f.id WHERE source_file_id = 7 GROUP BY ALL")(lambda m: relational.file_imports(m.file_edges, m.files, FILE).drop("language"))
query("file_imported_by", "SELECT f.id, path, CAST(SUM(symbol_count) AS BIGINT) AS symbol_count FROM file_edges e JOIN files f ON e.source_file_id = f.id WHERE target_file_id = 7 GROUP BY ALL")(lambda m: relational.file_imported_by(m.file_edges, m.files, FILE).drop("language"))
query("metrics_for_symbol", "SELECT * FROM graph_metrics WHERE symbol_id = 12")(lambda m: relational.by_id(m.graph_metrics, "symbol_id", SYMBOL))
query("cluster_for_symbol", "SELECT * FROM clusters WHERE symbol_id = 12")(lambda m: relational.by_id(m.clusters, "symbol_id", SYMBOL))
query("cluster_members_listagg", "SELECT cluster_id, cluster_label, COUNT(*) AS size, string_agg(name, ', ' ORDER BY name) AS members FROM clusters JOIN symbols s ON symbol_id = s.id GROUP BY ALL")(lambda m: relational.clusters_listed(m.clusters, m.symbols))
query("file_stats_by_id", "SELECT * FROM file_stats WHERE file_id = 7")(lambda m: relational.by_id(m.file_stats, "file_id", FILE))
query("top_churn", "SELECT file_id, path, total_churn, commit_count FROM file_stats JOIN files f ON file_id = f.id ORDER BY total_churn DESC, file_id LIMIT 20")(lambda m: relational.top_churn(m.file_stats, m.files, 20).select("file_id", "path", "total_churn", "commit_count"))
query("cochange_for_file", "SELECT f.id, path, cochange_count FROM git_cochange JOIN files f ON f.id = CASE WHEN file_id_a = 7 THEN file_id_b ELSE file_id_a END WHERE 7 IN (file_id_a, file_id_b) ORDER BY cochange_count DESC, f.id LIMIT 10")(
    lambda m: relational.cochange_for_file(m.cochange, m.files, FILE, 10)
)
query("blame_for_file", "SELECT commit_id, file_id, lines_added, lines_removed, author, timestamp, message FROM git_file_changes JOIN git_commits c ON commit_id = c.id WHERE file_id = 7")(lambda m: temporal.blame(m.commits, m.changes, FILE))
query("unreferenced_exports", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE is_exported = 1 AND s.kind IN ('function', 'class', 'method') AND s.id NOT IN (SELECT target_id FROM edges WHERE kind = 'call')")(
    lambda m: sym(relational.unreferenced_exports(m.symbols, m.edges.filter("kind = 'call'"), m.files))
)
query("files_in_dir", "SELECT id, path FROM files WHERE path ILIKE 'europe/%'")(lambda m: relational.files_in_dir(m.files, "europe/").select("id", "path"))
query("symbols_in_dir", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE f.path ILIKE 'europe/%'")(lambda m: sym(relational.with_path(m.symbols, relational.files_in_dir(m.files, "europe/"))))
query("symbol_metrics", "SELECT * FROM symbol_metrics WHERE symbol_id = 12")(lambda m: relational.by_id(m.symbol_metrics, "symbol_id", SYMBOL))
query("cluster_members", f"SELECT {SYM}, pagerank FROM clusters c JOIN symbols s ON c.symbol_id = s.id JOIN files f ON s.file_id = f.id LEFT JOIN graph_metrics g ON g.symbol_id = s.id WHERE cluster_id = 3")(
    lambda m: sym(relational.cluster_members(m.clusters, m.symbols, m.files, m.graph_metrics, CLUSTER), "pagerank")
)
query("file_stats_by_path", "SELECT file_id, path, total_churn FROM file_stats JOIN files f ON file_id = f.id WHERE path LIKE '%Supplier#000000007'")(
    lambda m: m.file_stats.join(m.files.filter(F.col("path").endswith("Supplier#000000007")).select(F.col("id").alias("file_id"), "path"), "file_id").select("file_id", "path", "total_churn")
)
query("language_distribution", "SELECT language, COUNT(*) AS cnt FROM files GROUP BY ALL")(lambda m: relational.distribution(m.files, "language"))
query("kind_distribution", "SELECT kind, COUNT(*) AS cnt FROM symbols GROUP BY ALL")(lambda m: relational.distribution(m.symbols, "kind"))
query("edge_kind_distribution", "SELECT kind, COUNT(*) AS cnt FROM edges GROUP BY ALL")(lambda m: relational.distribution(m.edges, "kind"))
query("symbols_with_file", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id")(lambda m: sym(relational.with_path(m.symbols, m.files)))
query("file_search", "SELECT id, path FROM files WHERE path ILIKE '%nation_1%' ORDER BY path, id LIMIT 10")(lambda m: relational.file_search(m.files, "nation_1", 10).select("id", "path"))

# inline queries

query("complexity_by_file", "SELECT m.file_id, path, symbols, avg_cc, max_cc, complex FROM (SELECT file_id, COUNT(*) AS symbols, round(AVG(cognitive_complexity), 6) AS avg_cc, MAX(cognitive_complexity) AS max_cc, CAST(SUM(CASE WHEN cognitive_complexity >= 15 THEN 1 ELSE 0 END) AS BIGINT) AS complex FROM symbol_metrics JOIN symbols s ON symbol_id = s.id GROUP BY file_id HAVING max_cc > 20) m JOIN files f ON m.file_id = f.id")(
    lambda m: relational.complexity_by_file(m.symbol_metrics, m.symbols, m.files, 20)
)
query("complexity_by_symbol", f"SELECT {SYM}, cognitive_complexity FROM symbol_metrics m JOIN symbols s ON symbol_id = s.id JOIN files f ON s.file_id = f.id WHERE cognitive_complexity >= 15 ORDER BY cognitive_complexity DESC, s.id LIMIT 20")(
    lambda m: sym(relational.complexity_by_symbol(m.symbol_metrics, m.symbols, m.files, 15, 20), "cognitive_complexity")
)
query("coupling", "SELECT file_id_a, file_id_b, a.path AS path_a, b.path AS path_b, cochange_count, CASE WHEN cochange_count > 10 THEN 'tight' WHEN cochange_count > 5 THEN 'moderate' ELSE 'loose' END AS class FROM git_cochange JOIN files a ON file_id_a = a.id JOIN files b ON file_id_b = b.id WHERE cochange_count >= 2 ORDER BY cochange_count DESC, file_id_a, file_id_b LIMIT 50")(
    lambda m: temporal.coupling(m.cochange, m.files, 2, 50)
)
query("coverage_gaps", "WITH c AS (SELECT s.id, s.name, s.kind, f.path AS file_path, COALESCE(pagerank, 0) AS pagerank, CAST(COALESCE(in_degree, 0) AS DOUBLE) AS in_degree, COALESCE(cognitive_complexity, 0) AS cognitive_complexity FROM symbols s JOIN files f ON s.file_id = f.id LEFT JOIN graph_metrics g ON g.symbol_id = s.id LEFT JOIN symbol_metrics m ON m.symbol_id = s.id WHERE is_exported = 1 AND s.kind IN ('function', 'class', 'method', 'interface') ORDER BY pagerank DESC, s.id LIMIT 500) SELECT id, name, kind, file_path, in_degree, cognitive_complexity, floor(pagerank * 10000 * GREATEST(cognitive_complexity, 1) * GREATEST(in_degree, 1) * 0.001::DOUBLE + 0.5) / 1000 AS score FROM c WHERE NOT regexp_matches(file_path, '(^|/)(test|tests|__tests__|spec|specs)/|_test[.]py$') AND id NOT IN (SELECT target_id FROM edges e JOIN symbols t ON e.source_id = t.id JOIN files f ON t.file_id = f.id WHERE e.kind = 'inherits' AND (f.path ILIKE '%test%' OR f.path ILIKE '%spec%'))")(
    lambda m: scoring.coverage_gaps(m.symbols, m.graph_metrics, m.symbol_metrics, m.edges.filter("kind = 'inherits'"), m.files).drop("file_id", "pagerank")
)
query("used_symbols", "SELECT b.file_id, string_agg(DISTINCT b.name, ', ' ORDER BY b.name) AS names FROM edges e JOIN symbols a ON e.source_id = a.id JOIN symbols b ON e.target_id = b.id WHERE a.file_id = 7 AND b.file_id <> 7 GROUP BY b.file_id")(lambda m: relational.used_symbols(m.edges, m.symbols, FILE))
query("fan", "SELECT s.id, s.name, in_degree, out_degree, concat_ws(', ', CASE WHEN out_degree > 15 THEN 'God-object' END, CASE WHEN in_degree > 20 THEN 'High-impact' END, CASE WHEN in_degree > 10 AND out_degree > 10 THEN 'Hub' END) AS flags FROM symbols s JOIN graph_metrics g ON g.symbol_id = s.id WHERE in_degree + out_degree >= 1 ORDER BY in_degree + out_degree DESC, s.id LIMIT 20")(
    lambda m: scoring.fan(m.symbols.join(m.graph_metrics.withColumnRenamed("symbol_id", "id"), "id"), 20).select("id", "name", "in_degree", "out_degree", "flags")
)
query("symbol_grep", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE (s.name ILIKE '%ring%' OR qualified_name ILIKE '%ring%' OR signature ILIKE '%ring%') AND s.kind = 'class' ORDER BY f.path, line_start, s.id LIMIT 200")(
    lambda m: sym(relational.grep_symbols(m.symbols, m.files, NEEDLE, 200, [F.col("kind") == "class"]))
)
query("caller_callee_counts", "SELECT s.id, COALESCE(i, 0) AS callers, COALESCE(o, 0) AS callees FROM symbols s LEFT JOIN (SELECT target_id, COUNT(*) AS i FROM edges GROUP BY 1) ON target_id = s.id LEFT JOIN (SELECT source_id, COUNT(*) AS o FROM edges GROUP BY 1) ON source_id = s.id")(
    lambda m: relational.edge_counts(m.edges, m.symbols)
)
query("index_summary", "SELECT (SELECT COUNT(*) FROM files) AS files, (SELECT COUNT(*) FROM symbols) AS symbols, (SELECT COUNT(*) FROM edges) AS edges, (SELECT COUNT(DISTINCT file_id) FROM symbols) AS files_with_symbols")(
    lambda m: m.files.agg(F.count("*").alias("files")).join(m.symbols.agg(F.count("*").alias("symbols"), F.count_distinct("file_id").alias("files_with_symbols"))).join(m.edges.agg(F.count("*").alias("edges")))
)
query("top_dirs", "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, COUNT(*) AS n, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM files GROUP BY dir ORDER BY n DESC, dir LIMIT 15")(lambda m: relational.directories(m.files, 15))
query("top_level_dirs", "SELECT split_part(path, '/', 1) AS dir, COUNT(*) AS n FROM files GROUP BY ALL")(lambda m: relational.top_directories(m.files))
query("test_importers", "SELECT target_file_id AS file_id, COUNT(DISTINCT source_file_id) AS test_importers FROM file_edges JOIN files f ON source_file_id = f.id WHERE file_role = 'test' OR path ILIKE '%test%' OR path ILIKE '%spec%' GROUP BY ALL")(lambda m: relational.test_importers(m.file_edges, m.files))
query("changed_symbols", "SELECT s.id, s.name, COALESCE(in_degree, 0) AS in_degree, COALESCE(cognitive_complexity, 0) AS cc FROM symbols s LEFT JOIN graph_metrics g ON g.symbol_id = s.id LEFT JOIN symbol_metrics m ON m.symbol_id = s.id WHERE s.file_id IN (7, 8)")(
    lambda m: m.symbols.filter("file_id IN (7, 8)").join(m.graph_metrics.select(F.col("symbol_id").alias("id"), "in_degree"), "id", "left").join(m.symbol_metrics.select(F.col("symbol_id").alias("id"), "cognitive_complexity"), "id", "left")
    .select("id", "name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("cognitive_complexity", F.lit(0.0)).alias("cc"))
)
query("breaking", "SELECT t.id, t.name, t.kind, COUNT(*) AS consumers, CASE WHEN COUNT(*) > 10 THEN 'BREAKING' WHEN COUNT(*) > 3 THEN 'WARNING' ELSE 'INFO' END AS severity FROM symbols t JOIN edges e ON e.target_id = t.id WHERE t.file_id IN (7, 8) AND t.is_exported = 1 GROUP BY t.id, t.name, t.kind")(
    lambda m: scoring.breaking(m.symbols, m.edges, ids(m, "file_id", 7, 8)).drop("file_id")
)
query("similar_symbols", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE (s.kind, regexp_replace(f.path, '/[^/]*$', '')) IN (SELECT s.kind, regexp_replace(f.path, '/[^/]*$', '') FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.id = 12) AND s.id <> 12 ORDER BY s.id LIMIT 10")(
    lambda m: sym(relational.similar_symbols(m.symbols, m.files, SYMBOL))
)
query("shallow_files", "SELECT id, path FROM files WHERE path NOT LIKE '%/%/%/%'")(lambda m: relational.shallow_files(m.files, 3).select("id", "path"))
query("conventions", "SELECT kind, CASE WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN 'snake_case' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') THEN 'UPPER_SNAKE' ELSE 'mixed' END AS style, COUNT(*) AS n FROM symbols WHERE NOT starts_with(name, '_') GROUP BY ALL")(
    lambda m: relational.conventions(m.symbols)
)
query("convention_violations", "WITH s AS (SELECT *, CASE WHEN kind IN ('function', 'method') THEN 'func' WHEN kind IN ('class', 'interface', 'struct') THEN 'type' WHEN kind = 'constant' THEN 'constant' END AS grp FROM names WHERE name <> '' AND name NOT LIKE '@_%' ESCAPE '@' AND name NOT LIKE '<%'), c AS (SELECT language, COUNT(*) FILTER (grp = 'func' AND regexp_matches(name, '^[a-z][a-zA-Z0-9]*$')) AS camel, COUNT(*) FILTER (grp = 'func' AND regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$')) AS snake, COUNT(*) FILTER (grp = 'type') AS types, COUNT(*) FILTER (grp = 'type' AND regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')) AS pascal, COUNT(*) FILTER (grp = 'constant') AS constants, COUNT(*) FILTER (grp = 'constant' AND regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$')) AS uppers FROM s GROUP BY language), r AS (SELECT s.*, CASE grp WHEN 'func' THEN CASE WHEN camel > snake THEN 'camelCase' WHEN snake > camel THEN 'snake_case' END WHEN 'type' THEN CASE WHEN pascal > types * 0.5 THEN 'PascalCase' END WHEN 'constant' THEN CASE WHEN uppers > constants * 0.5 THEN 'UPPER_SNAKE' END END AS expected, CASE WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN 'snake_case' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') THEN 'UPPER_SNAKE' ELSE 'mixed' END AS actual FROM s JOIN c USING (language)) SELECT id, name, kind, language, expected, actual FROM r WHERE expected = 'camelCase' AND NOT regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AND NOT regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') OR expected = 'snake_case' AND NOT regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') AND NOT regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') OR expected = 'PascalCase' AND NOT regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') OR expected = 'UPPER_SNAKE' AND is_exported = 1 AND NOT regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$')")(
    lambda m: relational.convention_violations(m.names)
)
query("betweenness_population", "SELECT list_sort(list(betweenness)) [CAST(LEAST(floor(COUNT(*) * 70 / 100.0), COUNT(*) - 1) AS BIGINT) + 1] AS p70, list_sort(list(betweenness)) [CAST(LEAST(floor(COUNT(*) * 90 / 100.0), COUNT(*) - 1) AS BIGINT) + 1] AS p90 FROM graph_metrics WHERE betweenness > 0")(
    lambda m: m.graph_metrics.filter("betweenness > 0").agg(scoring.percentile_low("betweenness", 70).alias("p70"), scoring.percentile_low("betweenness", 90).alias("p90"))
)
query("search_total", "SELECT COUNT(*) AS n FROM symbols WHERE name ILIKE '%ring%'")(lambda m: m.symbols.filter(strings.contains_ci("name", NEEDLE)).agg(F.count("*").alias("n")))
query("colocated_tests", "SELECT id, path FROM files WHERE path ILIKE 'europe/%' AND file_role = 'test'")(lambda m: m.files.filter(F.col("path").ilike("europe/%") & (F.col("file_role") == "test")).select("id", "path"))
query("file_age", "SELECT file_id, CAST(floor((1000000000 - MIN(timestamp)) / 86400.0) AS BIGINT) AS age_days FROM git_file_changes JOIN git_commits c ON commit_id = c.id GROUP BY file_id")(lambda m: temporal.age_days(m.commits, m.changes, NOW))

# joins

query("uses_by_kind", "SELECT edge_kind, qualified_name, file_path, edge_line, id FROM (SELECT e.kind AS edge_kind, qualified_name, path AS file_path, e.line AS edge_line, s.id, row_number() OVER (PARTITION BY e.kind, qualified_name, path ORDER BY e.line, s.id, target_id) AS r FROM edges e JOIN symbols s ON source_id = s.id JOIN files f ON s.file_id = f.id WHERE target_id IN (12, 13)) WHERE r = 1")(
    lambda m: relational.uses(m.edges, m.symbols, m.files, ids(m, "id", 12, 13)).select("edge_kind", "qualified_name", "file_path", "edge_line", "id")
)
query("edge_dedup_priority", "SELECT of_id, id, edge_kind FROM (SELECT target_id AS of_id, source_id AS id, kind AS edge_kind, row_number() OVER (PARTITION BY target_id, source_id ORDER BY CASE kind WHEN 'call' THEN 0 WHEN 'inherits' THEN 1 WHEN 'import' THEN 2 ELSE 99 END, kind, line) AS r FROM edges) WHERE r = 1")(
    lambda m: relational.neighbour_first_kind(m.edges.select(F.col("target_id").alias("of_id"), F.col("source_id").alias("id"), F.col("kind").alias("edge_kind"), F.col("line").alias("edge_line")), {"call": 0, "inherits": 1, "import": 2}).select("of_id", "id", "edge_kind")
)
query("dead_exports_anti", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE is_exported = 1 AND s.kind IN ('function', 'class', 'method') AND NOT regexp_matches(f.path, '(^|/)(test|tests|__tests__|spec|specs)/|_test[.]py$') AND s.id NOT IN (SELECT target_id FROM edges WHERE kind = 'inherits') AND s.name NOT IN ('__init__', '__main__', 'main', 'setup', 'teardown') AND NOT regexp_matches(s.name, '^(_|test_|Test)')")(
    lambda m: sym(relational.dead_exports(m.symbols, m.edges.filter("kind = 'inherits'"), m.files))
)
query("entry_points_anti", f"SELECT {SYM} FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.id NOT IN (SELECT target_id FROM edges WHERE kind = 'call') AND s.id IN (SELECT source_id FROM edges WHERE kind = 'call')")(
    lambda m: sym(relational.entry_points(m.symbols, m.edges.filter("kind = 'call'"), m.files))
)
query("name_twin_semi", "SELECT source_id, target_id, kind FROM edges WHERE target_id IN (SELECT id FROM symbols WHERE name = 'red widget' AND id <> 1)")(lambda m: relational.edges_to_twins(m.edges, m.symbols, "red widget", 1).select("source_id", "target_id", "kind"))
query("missing_partners", "WITH b AS (SELECT file_id_a AS file_id, file_id_b AS partner, cochange_count FROM git_cochange UNION ALL SELECT file_id_b, file_id_a, cochange_count FROM git_cochange) SELECT * FROM b WHERE cochange_count >= 5 AND file_id IN (7, 8) AND partner NOT IN (7, 8)")(lambda m: relational.missing_partners(m.cochange, ids(m, "file_id", 7, 8), 5))
query("parent_depth", "WITH RECURSIVE up AS (SELECT id, parent_id, 0 AS d FROM symbols UNION ALL SELECT u.id, s.parent_id, d + 1 FROM up u JOIN symbols s ON u.parent_id = s.id WHERE d < 20) SELECT id, CAST(MAX(d) AS BIGINT) AS depth FROM up GROUP BY id")(lambda m: relational.parent_depth(m.symbols))
query("suffix_path_match", "SELECT a AS asked, arg_min(id, id) AS id, arg_min(path, id) AS path FROM (SELECT unnest(['Supplier#000000007', 'NATION_1/Supplier#000000008', 'nothing']) AS a) JOIN files ON ends_with(path, a) GROUP BY a")(
    lambda m: relational.resolve_paths(m.spark.createDataFrame([("Supplier#000000007",), ("NATION_1/Supplier#000000008",), ("nothing",)], "path string"), m.files)
)
query("line_containment_range_join", "SELECT p.file_id, p.line, arg_max(s.id, s.line_start * 1000000000 - s.id) AS symbol_id FROM (SELECT DISTINCT l_suppkey AS file_id, CAST(l_quantity AS BIGINT) AS line FROM lineitem) p JOIN symbols s ON s.file_id = p.file_id AND p.line BETWEEN line_start AND line_end GROUP BY ALL")(
    lambda m: relational.contained_in(m.raw("lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_quantity").cast("long").alias("line")).distinct(), m.symbols)
)
query("shared_neighbours", "WITH n AS (SELECT source_id AS o, target_id AS id FROM edges WHERE source_id BETWEEN 10 AND 14 UNION SELECT target_id, source_id FROM edges WHERE target_id BETWEEN 10 AND 14) SELECT id, COUNT(*) AS shared FROM n WHERE id NOT BETWEEN 10 AND 14 GROUP BY id HAVING COUNT(*) >= 2")(
    lambda m: relational.shared_neighbours(m.edges, ids(m, "id", 10, 11, 12, 13, 14))
)
query("resolve_symbol", f"SELECT s.id, s.name, COALESCE(r, 0) AS refs FROM symbols s LEFT JOIN (SELECT target_id, COUNT(*) AS r FROM edges GROUP BY 1) ON target_id = s.id WHERE s.name = 'red widget' ORDER BY refs DESC, s.id LIMIT 10")(
    lambda m: relational.resolve_symbol(m.symbols, m.edges, "red widget").select("id", "name", "refs")
)

# version history

query("file_stats", "SELECT * FROM stats")(lambda m: temporal.file_stats(m.commits, m.changes))
query("cochange_pairs", "SELECT * FROM git_cochange")(lambda m: m.cochange)
query("cochange_entropy", "WITH b AS (SELECT file_id_a AS f, cochange_count AS n FROM git_cochange UNION ALL SELECT file_id_b, cochange_count FROM git_cochange) SELECT f AS file_id, CASE WHEN COUNT(*) <= 1 THEN 0.0::DOUBLE ELSE floor(-log2(SUM(n * n)::DOUBLE / (SUM(n)::DOUBLE * SUM(n)::DOUBLE)) / log2(COUNT(*)) * 10000 + 0.5) / 10000 END AS entropy FROM b GROUP BY f")(
    lambda m: temporal.entropy(m.cochange)
)
query("hyperedges", "SELECT commit_id, COUNT(*) AS file_count, substr(sha256(string_agg(CAST(file_id AS VARCHAR), '|' ORDER BY file_id)), 1, 16) AS sig_hash FROM commit_files GROUP BY commit_id")(lambda m: temporal.hyperedges(m.changes).drop("files"))
query("hyperedge_members", "SELECT commit_id, row_number() OVER (PARTITION BY commit_id ORDER BY file_id) - 1 AS ordinal, file_id FROM commit_files")(lambda m: temporal.hyperedge_members(temporal.hyperedges(m.changes)).select("commit_id", F.col("ordinal").cast("long").alias("ordinal"), "file_id"))
query("symmetric_weight", "SELECT f AS file_id, CAST(SUM(n) AS BIGINT) AS weight, COUNT(*) AS partners FROM (SELECT file_id_a AS f, cochange_count AS n FROM git_cochange UNION ALL SELECT file_id_b, cochange_count FROM git_cochange) GROUP BY f")(lambda m: temporal.symmetric_weight(m.cochange))
query("coupling_strength", "SELECT partner, n, CASE WHEN n >= 10 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS strength FROM (SELECT CASE WHEN file_id_a = 7 THEN file_id_b ELSE file_id_a END AS partner, cochange_count AS n FROM git_cochange WHERE 7 IN (file_id_a, file_id_b))")(lambda m: temporal.strength(m.cochange, FILE))
query("coupling_density", "SELECT pairs, n, floor(pairs / (n * (n - 1) / 2.0::DOUBLE) * 1000 + 0.5) / 1000 AS density FROM (SELECT (SELECT COUNT(*) FROM git_cochange WHERE cochange_count >= 3) AS pairs, (SELECT COUNT(*) FROM files) AS n)")(lambda m: scoring.coupling_density(m.cochange, m.files))

# windows

query("metric_delta", "SELECT series, idx, value, previous, round(value - previous, 6) AS change, round(CASE WHEN previous = 0 THEN CASE WHEN value = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE (value - previous) / abs(previous) * 100 END, 6) AS pct FROM (SELECT series, idx, value, lag(value) OVER (PARTITION BY series ORDER BY idx) AS previous FROM history)")(
    lambda m: stats.delta(m.history)
)
query("map_token_budget", "WITH r AS (SELECT s.id, GREATEST(1, length(s.qualified_name) // 4) AS cost, pagerank FROM symbols s JOIN graph_metrics g ON g.symbol_id = s.id ORDER BY pagerank DESC, s.id LIMIT 200), c AS (SELECT *, SUM(cost) OVER (ORDER BY pagerank DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM r) SELECT id, cost, CAST(running AS BIGINT) AS running FROM c WHERE running <= 300")(
    lambda m: ranking.running_budget(relational.ranked(m.symbols, m.files, m.graph_metrics, [F.desc("pagerank")], 200).withColumn("cost", strings.tokens("qualified_name")), [F.desc("pagerank"), F.asc("id")], "cost", 300).select("id", "cost", "running")
)
query("layer_top5", "SELECT id, layer FROM (SELECT l.id, layer, row_number() OVER (PARTITION BY layer ORDER BY COALESCE(total_churn, 0) DESC, l.id) AS r FROM layers l LEFT JOIN stats ON l.id = stats.file_id) WHERE r <= 5")(
    lambda m: relational.layer_top(graph.layers(m.graph, graph.strong_components(m.graph, m.vertices)), temporal.file_stats(m.commits, m.changes).select(F.col("file_id").alias("symbol_id"), F.col("total_churn").cast("double").alias("pagerank"))).select("id", "layer")
)
query("commit_header_fill", "SELECT l_orderkey, l_linenumber, l_partkey, last_value(CASE WHEN l_linenumber = 1 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS header FROM lineitem")(
    lambda m: m.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.last(F.when(F.col("l_linenumber") == 1, F.col("l_partkey")), ignorenulls=True).over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(W.unboundedPreceding, 0)).alias("header"))
)

# scores

query("god_components", "SELECT id, name, degree, category, CASE WHEN degree > CASE category WHEN 'utility' THEN 150 ELSE 50 END THEN 'CRITICAL' WHEN degree > CASE category WHEN 'utility' THEN 90 ELSE 30 END THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT s.id, s.name, in_degree + out_degree AS degree, CASE WHEN regexp_matches(lower(f.path), 'composables/|utils/|services/|lib/|helpers/|shared/|config/|core/|hooks/|stores/|output/|db/|common/|internal/|infra/|tests/|test/|spec/|dev/|scripts/|bin/|benchmark/|conftest[.]py|(^|/)(resolve|helpers|common|base)[.]py$') THEN 'utility' ELSE 'actionable' END AS category FROM (SELECT * FROM graph_metrics ORDER BY in_degree + out_degree DESC, symbol_id LIMIT 50) g JOIN symbols s ON g.symbol_id = s.id JOIN files f ON s.file_id = f.id) WHERE degree > 20")(
    lambda m: scoring.god_components(relational.ranked(m.symbols, m.files, m.graph_metrics, [(F.col("in_degree") + F.col("out_degree")).desc()], 50)).select("id", "name", "degree", "category", "severity")
)
_NECKS = "p AS (SELECT list_sort(list(betweenness)) AS x, COUNT(*) AS n FROM graph_metrics WHERE betweenness > 0), t AS (SELECT s.id, floor(betweenness * 10 + 0.5) / 10 AS betweenness, CASE WHEN regexp_matches(lower(f.path), 'composables/|utils/|services/|lib/|helpers/|shared/|config/|core/|hooks/|stores/|output/|db/|common/|internal/|infra/|tests/|test/|spec/|dev/|scripts/|bin/|benchmark/|conftest[.]py|(^|/)(resolve|helpers|common|base)[.]py$') THEN 'utility' ELSE 'actionable' END AS category FROM graph_metrics g JOIN symbols s ON g.symbol_id = s.id JOIN files f ON s.file_id = f.id WHERE betweenness > 0.5 ORDER BY g.betweenness DESC, s.id LIMIT 15), necks AS (SELECT id, t.betweenness, category, CASE WHEN t.betweenness > x[CAST(LEAST(floor(n * 90 / 100.0), n - 1) AS BIGINT) + 1] * CASE category WHEN 'utility' THEN 1.5 ELSE 1 END THEN 'CRITICAL' WHEN t.betweenness > x[CAST(LEAST(floor(n * 70 / 100.0), n - 1) AS BIGINT) + 1] * CASE category WHEN 'utility' THEN 1.5 ELSE 1 END THEN 'WARNING' ELSE 'INFO' END AS severity FROM t, p)"
query("bottleneck_severity", f"WITH {_NECKS} SELECT * FROM necks")(
    lambda m: scoring.bottlenecks(relational.ranked(m.symbols, m.files, m.graph_metrics, [F.desc("betweenness")], 15), m.graph_metrics).select("id", "betweenness", "category", "severity")
)
query("weather_hotspots", "WITH t AS (SELECT file_id, path, total_churn, complexity FROM file_stats JOIN files f ON file_id = f.id ORDER BY total_churn DESC, file_id LIMIT 40), p AS (SELECT list_sort(list(total_churn)) [GREATEST(CAST(ceil(COUNT(*) * 75 / 100.0) AS BIGINT), 1)] AS pa, list_sort(list(complexity)) [GREATEST(CAST(ceil(COUNT(*) * 75 / 100.0) AS BIGINT), 1)] AS pb FROM t), n AS (SELECT *, total_churn::DOUBLE / CASE WHEN pa = 0 THEN 1 ELSE pa END AS a, complexity / CASE WHEN pb = 0 THEN 1 ELSE pb END AS b FROM t, p) SELECT file_id, path, total_churn, complexity, floor(sqrt(a * b) * 1000 + 0.5) / 1000 AS score, CASE WHEN a > 2 * b THEN 'HIGH-CHURN' WHEN b > 2 * a THEN 'HIGH-COMPLEXITY' ELSE 'BOTH' END AS reason FROM n ORDER BY score DESC, file_id LIMIT 20")(
    lambda m: scoring.hotspots(m.file_stats, m.files, 20)
)
query("file_risk", "WITH w AS (SELECT f AS id, SUM(n) AS weight FROM (SELECT file_id_a AS f, cochange_count AS n FROM git_cochange UNION ALL SELECT file_id_b, cochange_count FROM git_cochange) GROUP BY f), ti AS (SELECT target_file_id AS id, COUNT(DISTINCT source_file_id) AS test_importers FROM file_edges JOIN files f ON source_file_id = f.id WHERE file_role = 'test' OR path ILIKE '%test%' OR path ILIKE '%spec%' GROUP BY ALL), j AS (SELECT f.id, f.path, COALESCE(total_churn, 0)::DOUBLE AS a, COALESCE(complexity, 0)::DOUBLE AS b, COALESCE(weight, 0)::DOUBLE AS c, COALESCE(test_importers, 0) AS t FROM files f LEFT JOIN file_stats s ON s.file_id = f.id LEFT JOIN w ON w.id = f.id LEFT JOIN ti ON ti.id = f.id), p AS (SELECT list_sort(list(a)) AS xa, list_sort(list(b)) AS xb, list_sort(list(c)) AS xc, CAST(LEAST(floor(COUNT(*) * 90 / 100.0), COUNT(*) - 1) AS BIGINT) + 1 AS k FROM j), r AS (SELECT id, path, floor((0.3::DOUBLE * LEAST(1, a / CASE WHEN xa[k] = 0 THEN 1 ELSE xa[k] END) + 0.3::DOUBLE * LEAST(1, b / CASE WHEN xb[k] = 0 THEN 1 ELSE xb[k] END) + 0.2::DOUBLE * LEAST(1, c / CASE WHEN xc[k] = 0 THEN 1 ELSE xc[k] END) + 0.2::DOUBLE * CASE WHEN t > 0 THEN 0.5::DOUBLE ELSE 1 END) * 1000 + 0.5) / 1000 AS risk FROM j, p) SELECT id, path, risk, CASE WHEN risk > 0.8 THEN 'CRITICAL' WHEN risk > 0.6 THEN 'HIGH' WHEN risk > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r")(
    lambda m: scoring.file_risk(m.files, m.file_stats.select("file_id", "total_churn", "complexity"), temporal.symmetric_weight(m.cochange).select("file_id", "weight"), relational.test_importers(m.file_edges, m.files)).select("id", "path", "risk", "level")
)
query("dead_decay", "WITH d AS (SELECT s.* FROM symbols s WHERE is_exported = 1 AND kind IN ('function', 'class', 'method') AND id NOT IN (SELECT target_id FROM edges WHERE kind = 'inherits')), a AS (SELECT file_id, floor((1000000000 - MIN(timestamp)) / 86400.0) AS age FROM git_file_changes JOIN git_commits c ON commit_id = c.id GROUP BY file_id), u AS (SELECT DISTINCT name FROM symbols WHERE id IN (SELECT target_id FROM edges WHERE kind = 'inherits')) SELECT d.id, CASE WHEN u.name IS NULL THEN 100 ELSE 70 END AS confidence, CAST(GREATEST(1, floor(0.5::DOUBLE * (line_end - line_start + 1) + 0.5)) AS BIGINT) AS effort, floor(COALESCE(age, 0) / 365.0::DOUBLE * (line_end - line_start + 1) * CASE WHEN u.name IS NULL THEN 100 ELSE 70 END / 100 * 10 + 0.5) / 10 AS decay FROM d LEFT JOIN a ON d.file_id = a.file_id LEFT JOIN u ON d.name = u.name")(
    lambda m: scoring.dead_decay(scoring.dead_confidence(relational.unreferenced_exports(m.symbols, m.edges.filter("kind = 'inherits'"), m.files), m.edges.filter("kind = 'inherits'"), m.symbols), temporal.age_days(m.commits, m.changes, NOW)).select("id", "confidence", "effort", "decay")
)


def project_metrics(m: Model) -> DataFrame:
    """metric, value of the gates."""
    scc = graph.strong_components(m.graph, m.vertices)
    return scoring.project_metrics(m.files, m.symbols, m.edges.filter("kind = 'inherits'"), m.symbol_metrics, m.graph_metrics, m.cochange, scc)


_METRICS = (
    "v AS (SELECT 'avg_complexity' AS metric, (SELECT floor(AVG(cognitive_complexity) * 10 + 0.5) / 10 FROM symbol_metrics WHERE cognitive_complexity > 0) AS value UNION ALL SELECT 'max_complexity', (SELECT MAX(cognitive_complexity) FROM symbol_metrics WHERE cognitive_complexity > 0) "
    "UNION ALL SELECT 'dead_pct', (SELECT floor((SELECT COUNT(*) FROM symbols s WHERE is_exported = 1 AND kind IN ('function', 'class', 'method') AND id NOT IN (SELECT target_id FROM edges WHERE kind = 'inherits'))::DOUBLE / COUNT(*) * 1000 + 0.5) / 10 FROM symbols) "
    "UNION ALL SELECT 'test_ratio', (SELECT floor(COUNT(*) FILTER (path ILIKE '%test%' OR path ILIKE '%spec%')::DOUBLE / COUNT(*) * 1000 + 0.5) / 1000 FROM files) UNION ALL SELECT 'cycle_count', (SELECT COUNT(*)::DOUBLE FROM (SELECT scc_id FROM scc GROUP BY scc_id HAVING COUNT(*) > 1)) "
    "UNION ALL SELECT 'tangle_ratio', (SELECT floor(SUM(CASE WHEN k > 1 THEN k ELSE 0 END)::DOUBLE / SUM(k) * 1000 + 0.5) / 10 FROM (SELECT COUNT(*) AS k FROM scc GROUP BY scc_id)) UNION ALL SELECT 'god_components', (SELECT COUNT(*)::DOUBLE FROM graph_metrics WHERE in_degree + out_degree > 20) "
    "UNION ALL SELECT 'coupling_density', (SELECT floor((SELECT COUNT(*) FROM git_cochange WHERE cochange_count >= 3) / (COUNT(*) * (COUNT(*) - 1) / 2.0::DOUBLE) * 1000 + 0.5) / 1000 FROM files))"
)
query("project_metrics", f"WITH {_METRICS} SELECT * FROM v")(project_metrics)
query("fitness_gates", f"WITH {_METRICS}, g(metric, op, base, strict, python, javascript, go, java, rust) AS (VALUES ('avg_complexity', '<=', 25.0::DOUBLE, 15, 20, 22, 15, 20, 18), ('max_complexity', '<=', 75, 40, 75, 75, 50, 60, 50), ('dead_pct', '<=', 15, 5, 12, 18, 8, 20, 5), ('test_ratio', '>=', 0.1, 0.3, 0.15, 0.08, 0.2, 0.15, 0.2), ('cycle_count', '<=', 5, 0, 5, 5, 2, 5, 1), ('coupling_density', '<=', 0.3, 0.15, 0.3, 0.35, 0.3, 0.25, 0.3), ('god_components', '<=', 3, 0, 3, 3, 3, 3, 3), ('tangle_ratio', '<=', 10, 3, 10, 10, 10, 10, 2)), t AS (SELECT metric, op, unnest(['default', 'strict', 'python', 'javascript', 'go', 'java', 'rust']) AS preset, unnest([base, strict, python, javascript, go, java, rust])::DOUBLE AS threshold FROM g) SELECT preset, metric, op, threshold, value, CASE WHEN op = '>=' THEN value >= threshold ELSE value <= threshold END AS passed FROM t JOIN v USING (metric)")(
    lambda m: _all_presets(m)
)


def _all_presets(m: Model) -> DataFrame:
    metrics = m.spark.createDataFrame(project_metrics(m).collect(), "metric string, value double")  # eight rows
    out = None
    for preset in scoring.PRESETS:
        one = scoring.gates(metrics, preset).withColumn("preset", F.lit(preset)).select("preset", "metric", "op", "threshold", "value", "passed")
        out = one if out is None else out.unionByName(one)
    return out


query("quick_health", f"WITH {_METRICS}, w AS (SELECT MAX(value) FILTER (metric = 'tangle_ratio') AS tangle, MAX(value) FILTER (metric = 'god_components') AS god, MAX(value) FILTER (metric = 'dead_pct') AS dead, MAX(value) FILTER (metric = 'avg_complexity') AS cc, MAX(value) FILTER (metric = 'cycle_count') AS cycles FROM v) SELECT CAST(GREATEST(0, 100 - CASE WHEN tangle > 10 THEN 20 WHEN tangle > 5 THEN 10 ELSE 0 END - CASE WHEN god > 5 THEN 15 WHEN god > 2 THEN 8 ELSE 0 END - CASE WHEN dead > 15 THEN 10 WHEN dead > 5 THEN 5 ELSE 0 END - CASE WHEN cc > 25 THEN 15 WHEN cc > 15 THEN 8 ELSE 0 END - CASE WHEN cycles > 5 THEN 10 ELSE 0 END) AS BIGINT) AS quick_health FROM w")(
    lambda m: scoring.quick_health(project_metrics(m).groupBy().pivot("metric", list(scoring.GATES)).agg(F.first("value"))).select("quick_health")
)
query("pr_risk", "WITH RECURSIVE own AS (SELECT id FROM files f WHERE id IN (5, 7, 8) AND NOT regexp_matches(path, '(^|/)(test|tests|__tests__|spec|specs)/|_test[.]py$')), c AS (SELECT s.* FROM symbols s WHERE file_id IN (SELECT id FROM own)), r AS (SELECT id, 0 AS d FROM c UNION SELECT e.source_id, d + 1 FROM r JOIN edges e ON e.target_id = r.id WHERE d < 10), n AS (SELECT target_id, COUNT(*) AS k FROM edges GROUP BY 1), t AS (SELECT DISTINCT target_id FROM edges e JOIN symbols s ON e.source_id = s.id JOIN files f ON s.file_id = f.id WHERE f.path ILIKE '%test%' OR f.path ILIKE '%spec%'), v AS (SELECT (SELECT COUNT(DISTINCT id) FROM r WHERE id NOT IN (SELECT id FROM c)) AS blast, COUNT(*) FILTER (is_exported = 1 AND k > 0) AS breaking, COUNT(*) FILTER (is_exported = 1 AND t.target_id IS NULL AND pagerank > 0) AS untested, COUNT(*) FILTER (cognitive_complexity > 10) AS complex, (SELECT COUNT(*) FROM own) AS files FROM c LEFT JOIN n ON n.target_id = c.id LEFT JOIN t ON t.target_id = c.id LEFT JOIN graph_metrics g ON g.symbol_id = c.id LEFT JOIN symbol_metrics m ON m.symbol_id = c.id), x AS (SELECT *, floor((0.3::DOUBLE * LEAST(blast / 50.0::DOUBLE, 1) + 0.25::DOUBLE * LEAST(breaking / 10.0::DOUBLE, 1) + 0.2::DOUBLE * LEAST(untested / 10.0::DOUBLE, 1) + 0.15::DOUBLE * LEAST(complex / 5.0::DOUBLE, 1) + CASE WHEN files > 10 THEN 0.1::DOUBLE ELSE files / 100.0::DOUBLE END) * 1000 + 0.5) / 1000 AS risk FROM v) SELECT *, CASE WHEN risk > 0.7 THEN 'CRITICAL' WHEN risk > 0.5 THEN 'HIGH' WHEN risk > 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM x")(
    lambda m: scoring.pr_risk(scoring.pr_facts(ids(m, "file_id", 5, 7, 8), m.symbols, m.edges, m.files, m.graph_metrics, m.symbol_metrics))
)
query("health_score", f"WITH {_NECKS}, tt AS (SELECT floor(SUM(CASE WHEN k > 1 THEN k ELSE 0 END) * 1000.0::DOUBLE / SUM(k) + 0.5) / 10 AS tangle FROM (SELECT COUNT(*) AS k FROM scc GROUP BY scc_id)), g AS (SELECT COUNT(*) AS god, COUNT(*) FILTER (d > CASE WHEN regexp_matches(lower(path), 'lib/') THEN 150 ELSE 50 END) AS gc FROM (SELECT in_degree + out_degree AS d, path FROM graph_metrics g JOIN symbols s ON g.symbol_id = s.id JOIN files f ON s.file_id = f.id ORDER BY d DESC, symbol_id LIMIT 50) WHERE d > 20), b AS (SELECT COUNT(*) AS neck, COUNT(*) FILTER (severity = 'CRITICAL') AS nc FROM necks), w AS (SELECT COUNT(*) AS violations FROM graph JOIN (SELECT s_suppkey AS id, s_nationkey % 5 AS layer FROM supplier) a ON src = a.id JOIN (SELECT s_suppkey AS id, s_nationkey % 5 AS layer FROM supplier) c ON dst = c.id WHERE a.layer > c.layer) SELECT tangle, god, gc AS god_critical, neck, nc AS neck_critical, violations, CAST(floor(100 * exp(0.30::DOUBLE * ln(GREATEST(exp(-tangle / 10), 1e-9)) + 0.20::DOUBLE * ln(GREATEST(exp(-(3 * gc + 0.5::DOUBLE * god) / 5), 1e-9)) + 0.15::DOUBLE * ln(GREATEST(exp(-(2 * nc + 0.3::DOUBLE * neck) / 4), 1e-9)) + 0.15::DOUBLE * ln(GREATEST(exp(-violations / 5.0::DOUBLE), 1e-9)))) AS BIGINT) AS health FROM tt, g, b, w")(
    lambda m: _health(m).drop("avg_health")
)


def _health(m: Model) -> DataFrame:
    tangle = graph.tangle(graph.strong_components(m.graph, m.vertices)).select(F.col("tangle_ratio").alias("tangle"))
    god = scoring.god_components(relational.ranked(m.symbols, m.files, m.graph_metrics, [(F.col("in_degree") + F.col("out_degree")).desc()], 50)).agg(F.count("*").alias("god"), F.count_if(F.col("severity") == "CRITICAL").alias("god_critical"))
    necks = scoring.bottlenecks(relational.ranked(m.symbols, m.files, m.graph_metrics, [F.desc("betweenness")], 15), m.graph_metrics).agg(F.count("*").alias("neck"), F.count_if(F.col("severity") == "CRITICAL").alias("neck_critical"))
    layer = m.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("layer"))
    violations = graph.layer_violations(m.graph, layer).agg(F.count("*").alias("violations"))
    return scoring.health(tangle.join(god).join(necks).join(violations).withColumn("avg_health", F.lit(None).cast("double")))


# statistics

_Z = "WITH a AS (SELECT series, list(value ORDER BY idx) AS v, quantile_cont(value, 0.5) AS med FROM history GROUP BY series), b AS (SELECT h.series, h.idx, h.value, a.med, quantile_cont(abs(h.value - a.med), 0.5) OVER (PARTITION BY h.series) AS mad FROM history h JOIN a USING (series)), z AS (SELECT series, idx, value, med, mad, round(CASE WHEN mad = 0 THEN 0 ELSE (value - med) / (mad / 0.6745::DOUBLE) END, 6) AS z FROM b)"
query("modified_zscore", f"{_Z} SELECT series, idx, value, round(med, 6) AS med, round(mad, 6) AS mad, round(z, 4) AS z FROM z")(lambda m: stats.modified_z(m.history).select("series", "idx", "value", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), F.round("z", 4).alias("z")))
query("mann_kendall", "WITH p AS (SELECT a.series, CAST(SUM(sign(b.value - a.value)) AS BIGINT) AS s FROM history a JOIN history b ON a.series = b.series AND a.idx < b.idx GROUP BY 1), n AS (SELECT series, COUNT(*) AS n FROM history GROUP BY 1), t AS (SELECT series, SUM(k * (k - 1) * (2 * k + 5)) AS ties FROM (SELECT series, value, COUNT(*) AS k FROM history GROUP BY ALL) GROUP BY 1), v AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18.0::DOUBLE AS var FROM p JOIN n USING (series) JOIN t USING (series)), z AS (SELECT *, abs(CASE WHEN var <= 0 THEN 0 WHEN s > 0 THEN (s - 1) / sqrt(var) WHEN s < 0 THEN (s + 1) / sqrt(var) ELSE 0 END) AS z FROM v), c AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z) AS k FROM z), q AS (SELECT *, CASE WHEN n < 4 THEN 1 ELSE 2 * (1 - 0.5::DOUBLE * (1 + sign(z) * (1 - ((((1.061405429::DOUBLE * k - 1.453152027::DOUBLE) * k + 1.421413741::DOUBLE) * k - 0.284496736::DOUBLE) * k + 0.254829592::DOUBLE) * k * exp(-z * z / 2)))) END AS p FROM c) SELECT series, n, CASE WHEN n < 4 THEN 0 ELSE s END AS s, round(CASE WHEN n < 4 THEN 0 ELSE s / (n * (n - 1) / 2.0::DOUBLE) END, 6) AS tau, round(p, 6) AS p, CASE WHEN n < 4 OR p >= 0.05 THEN 'no_trend' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM q")(
    lambda m: stats.mann_kendall(m.history)
)
query("theil_sen", "WITH s AS (SELECT a.series, quantile_cont((b.value - a.value) / (b.idx - a.idx), 0.5) AS slope FROM history a JOIN history b ON a.series = b.series AND a.idx < b.idx GROUP BY 1) SELECT h.series, round(MAX(slope), 5) AS slope, round(quantile_cont(value - slope * idx, 0.5), 5) AS intercept FROM history h JOIN s USING (series) GROUP BY 1")(
    lambda m: stats.theil_sen(m.history).select("series", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))
)
_WE = "z0 AS (SELECT series, idx, value, (value - AVG(value) OVER s) / stddev_pop(value) OVER s AS z, row_number() OVER (PARTITION BY series ORDER BY idx) AS n FROM prices WINDOW s AS (PARTITION BY series)), c AS (SELECT *, COUNT(*) FILTER (z > 2) OVER w3 AS a2, COUNT(*) FILTER (z < -2) OVER w3 AS b2, COUNT(*) FILTER (z > 1) OVER w5 AS a1, COUNT(*) FILTER (z < -1) OVER w5 AS b1, COUNT(*) FILTER (z > 0) OVER w8 AS a0, COUNT(*) FILTER (z < 0) OVER w8 AS b0 FROM z0 WINDOW w3 AS (PARTITION BY series ORDER BY idx ROWS 2 PRECEDING), w5 AS (PARTITION BY series ORDER BY idx ROWS 4 PRECEDING), w8 AS (PARTITION BY series ORDER BY idx ROWS 7 PRECEDING)), we AS (SELECT series, idx, value, 1 AS rule FROM c WHERE abs(z) > 3 UNION ALL SELECT series, idx, value, 2 FROM c WHERE n >= 3 AND (a2 >= 2 OR b2 >= 2) UNION ALL SELECT series, idx, value, 3 FROM c WHERE n >= 5 AND (a1 >= 4 OR b1 >= 4) UNION ALL SELECT series, idx, value, 4 FROM c WHERE n >= 8 AND (a0 = 8 OR b0 = 8))"
query("western_electric", f"WITH {_WE} SELECT * FROM we")(lambda m: stats.western_electric(m.prices))
query("cusum", "WITH st AS (SELECT series, AVG(value) AS mu, stddev_pop(value) AS sd FROM history GROUP BY series HAVING COUNT(*) >= 5 AND stddev_pop(value) >= 1e-12), r AS (SELECT h.series, h.idx, GREATEST(0, value - mu - 0.5::DOUBLE * sd) AS p, GREATEST(0, mu - value - 0.5::DOUBLE * sd) AS m FROM history h JOIN st USING (series) WHERE idx = 0 UNION ALL SELECT h.series, h.idx, GREATEST(0, CASE WHEN p > sd THEN 0 ELSE p END + value - mu - 0.5::DOUBLE * sd), GREATEST(0, CASE WHEN m > sd THEN 0 ELSE m END + mu - value - 0.5::DOUBLE * sd) FROM r JOIN history h ON h.series = r.series AND h.idx = r.idx + 1 JOIN st ON st.series = h.series) SELECT r.series, idx, 'up' AS direction, round(p / sd, 6) AS magnitude FROM r JOIN st USING (series) WHERE p > sd UNION ALL SELECT r.series, idx, 'down', round(m / sd, 6) FROM r JOIN st USING (series) WHERE m > sd")(
    lambda m: stats.cusum(m.history, h=1.0)
)
query("sparkline", "WITH t AS (SELECT series, list(value ORDER BY idx)[-8:] AS t FROM history GROUP BY series), x AS (SELECT *, list_min(t) AS low, list_max(t) AS high FROM t) SELECT series, array_to_string(list_transform(t, lambda v: substr('▁▂▃▄▅▆▇█', CASE WHEN high = low THEN 4 ELSE CAST(floor((v - low) / (high - low) * 7 + 0.5) AS INT) + 1 END, 1)), '') AS spark, CASE WHEN c > 0.02 THEN 'up' WHEN c < -0.02 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, CASE WHEN t[1] = 0 THEN sign(t[-1]) ELSE (t[-1] - t[1]) / abs(t[1]) END AS c FROM x)")(
    lambda m: stats.sparkline(m.history)
)
query("alerts", f"{_Z.replace('history', 'prices')}, {_WE}, l AS (SELECT series, MAX(idx) AS last FROM prices GROUP BY series), f AS (SELECT we.series, MIN(rule) AS rule FROM we JOIN l USING (series) WHERE idx > last - 3 GROUP BY 1), x AS (SELECT z.series, last, value, z, rule, CASE WHEN abs(z) > 3 THEN 'CRITICAL' WHEN abs(z) > 1 THEN 'WARNING' WHEN rule IS NOT NULL THEN 'INFO' END AS level FROM z JOIN l ON z.series = l.series AND idx = last LEFT JOIN f ON f.series = z.series) SELECT series, last, value, round(z, 4) AS z, rule, level, CASE level WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS ord FROM x WHERE level IS NOT NULL")(
    lambda m: stats.alerts(m.prices, threshold=1.0).withColumn("z", F.round("z", 4))
)
query("anomalies", f"WITH {_WE} SELECT series, idx, 'western' AS method, 'rule ' || rule AS detail FROM we")(
    lambda m: stats.anomalies(m.prices, method="western")
)

# graph

query("degrees", "SELECT v.id, (SELECT COUNT(*) FROM graph WHERE dst = v.id) AS in_degree, (SELECT COUNT(*) FROM graph WHERE src = v.id) AS out_degree FROM vertices v")(lambda m: graph.degrees(m.graph, m.vertices))
query("bfs_reachable", "SELECT b AS id FROM reach WHERE a = 1 AND b <> 1")(lambda m: graph.reachable(m.graph, ids(m, "id", 1), 1000).select("id"))
query("bfs_blast_radius", "WITH RECURSIVE r AS (SELECT src AS id, 1 AS d FROM graph WHERE dst = 1 UNION SELECT g.src, d + 1 FROM r JOIN graph g ON g.dst = r.id WHERE d < 3) SELECT id, MIN(d) AS depth FROM r WHERE id <> 1 GROUP BY id")(lambda m: graph.reachable(graph.reverse(m.graph), ids(m, "id", 1), 3))
query("transitive_closure", "SELECT a, b FROM reach")(lambda m: graph.closure(m.graph))
query("connected_components", "WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM graph UNION SELECT dst, src FROM graph), r AS (SELECT id AS a, id AS b FROM vertices UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS id, MIN(b) AS component FROM r GROUP BY a")(lambda m: graph.connected_components(m.graph, m.vertices))
query("scc", "SELECT id, scc_id FROM scc")(lambda m: graph.strong_components(m.graph, m.vertices))
query("tangle_ratio", "SELECT CAST(SUM(k) AS BIGINT) AS n, CAST(SUM(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS in_cycles, floor(SUM(CASE WHEN k > 1 THEN k ELSE 0 END)::DOUBLE / SUM(k) * 1000 + 0.5) / 10 AS tangle_ratio, floor((0.92::DOUBLE - SUM(CASE WHEN k > 1 THEN k ELSE 0 END)::DOUBLE / SUM(k) * 0.10::DOUBLE) * 1000 + 0.5) / 1000 AS alpha FROM (SELECT COUNT(*) AS k FROM scc GROUP BY scc_id)")(
    lambda m: graph.tangle(graph.strong_components(m.graph, m.vertices)).withColumn("tangle_ratio", F.col("tangle_ratio"))
)
query("cycles", "SELECT scc_id, COUNT(*) AS size FROM scc GROUP BY scc_id HAVING COUNT(*) >= 2")(lambda m: graph.cycles(graph.strong_components(m.graph, m.vertices)).select("scc_id", "size"))
query("cycle_severity", "SELECT scc_id, COUNT(*) AS size, COUNT(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs, CASE WHEN COUNT(DISTINCT regexp_replace(path, '/[^/]*$', '')) = 1 THEN 'INFO' WHEN COUNT(*) > 3 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM scc JOIN files f ON scc.id = f.id GROUP BY scc_id HAVING COUNT(*) >= 2")(
    lambda m: graph.annotate_cycles(graph.strong_components(m.graph, m.vertices), m.files).select("scc_id", "size", "dirs", "severity")
)
query("condensation", "SELECT src, dst FROM dag")(lambda m: graph.condensation(m.graph, graph.strong_components(m.graph, m.vertices)))
query("scc_by_joins", "SELECT id, scc_id FROM scc")(lambda m: graph.strong_components(m.graph, m.vertices, small=0))
query("layers_by_joins", "SELECT id, layer FROM layers")(lambda m: graph.layers(m.graph, graph.strong_components(m.graph, m.vertices), small=0))
query("file_graph", "SELECT source_file_id AS src, target_file_id AS dst, kind, CAST(SUM(symbol_count) AS BIGINT) AS weight FROM file_edges GROUP BY ALL")(lambda m: graph.file_graph(m.file_edges, m.files))
query("layers", "SELECT id, layer FROM layers")(lambda m: graph.layers(m.graph, graph.strong_components(m.graph, m.vertices)))
query("layer_sizes", "SELECT layer, COUNT(*) AS n FROM layers GROUP BY layer")(lambda m: graph.layer_sizes(graph.layers(m.graph, graph.strong_components(m.graph, m.vertices))))
query("layer_violations", "WITH l AS (SELECT s_suppkey AS id, s_nationkey % 5 AS layer FROM supplier) SELECT src, dst, a.layer AS from_layer, b.layer AS to_layer, a.layer - b.layer AS distance, floor((a.layer - b.layer)::DOUBLE / GREATEST((SELECT MAX(layer) FROM l), 1) * 1000 + 0.5) / 1000 AS severity FROM graph JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE a.layer > b.layer")(
    lambda m: graph.layer_violations(m.graph, m.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("layer")))
)
_UP = "WITH RECURSIVE w AS (SELECT id AS node, 0 AS d FROM symbols UNION SELECT dst, d + 1 FROM w JOIN forest ON w.node = src)"
query("forest_layers", f"{_UP} SELECT node AS id, MAX(d) AS layer FROM w GROUP BY node")(lambda m: graph.layers(m.forest, graph.strong_components(m.forest, m.symbols.select("id"))))
query("forest_condensation", "SELECT src, dst FROM forest")(lambda m: graph.condensation(m.forest, graph.strong_components(m.forest, m.symbols.select("id"))))
query("forest_order", f"{_UP} SELECT node, MAX(d) AS round FROM w GROUP BY node")(lambda m: graph.topological_order(m.forest, m.symbols.select(F.col("id").alias("node"))))
query("forest_closure", f"{_UP}, p AS (SELECT src AS a, dst AS b FROM forest UNION SELECT p.a, dst FROM p JOIN forest ON p.b = src) SELECT a, b FROM p")(lambda m: graph.closure(m.forest))
query("topological_order", "SELECT node, MAX(layer) AS round FROM walks GROUP BY node")(
    lambda m: (lambda s: graph.topological_order(graph.condensation(m.graph, s), s.select(F.col("scc_id").alias("node")).distinct()))(graph.strong_components(m.graph, m.vertices))
)
query("propagation_cost", "SELECT (SELECT COUNT(*) FROM reach WHERE a <> b) AS pairs, COUNT(*) AS n, floor((SELECT COUNT(*) FROM reach WHERE a <> b) / (COUNT(*) * (COUNT(*) - 1))::DOUBLE * 10000 + 0.5) / 10000 AS propagation_cost FROM vertices")(lambda m: graph.propagation_cost(m.graph, m.vertices))
query("weakest_cycle_edge", "WITH i AS (SELECT a.scc_id, src, dst FROM graph JOIN scc a ON src = a.id JOIN scc b ON dst = b.id WHERE a.scc_id = b.scc_id), k AS (SELECT *, COUNT(*) OVER (PARTITION BY scc_id, src) AS out_n, COUNT(*) OVER (PARTITION BY scc_id, dst) AS in_n FROM i) SELECT scc_id, src, dst, out_n, in_n FROM (SELECT *, row_number() OVER (PARTITION BY scc_id ORDER BY out_n DESC, in_n DESC, src, dst) AS r FROM k) WHERE r = 1")(
    lambda m: graph.weakest_edges(m.graph, graph.strong_components(m.graph, m.vertices)).select("scc_id", "src", "dst", "out_n", "in_n")
)


def _pagerank_sql(rounds: int) -> str:
    out = "WITH deg AS (SELECT src, COUNT(*) AS k FROM graph GROUP BY src), n AS (SELECT COUNT(*)::DOUBLE AS n FROM vertices), r0 AS (SELECT id, 1 / n.n AS r FROM vertices, n)"
    for i in range(rounds):
        lost = f"COALESCE((SELECT SUM(r) FROM r{i} WHERE id NOT IN (SELECT src FROM graph)), 0)"
        out += f", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * {lost} / n.n + 0.85::DOUBLE * COALESCE(x.s, 0) AS r FROM vertices v CROSS JOIN n LEFT JOIN (SELECT dst, SUM(r / k) AS s FROM graph g JOIN deg USING (src) JOIN r{i} ON g.src = r{i}.id GROUP BY dst) x ON v.id = x.dst)"
    return f"{out} SELECT id, round(r, 6) AS rank FROM r{rounds}"


query("pagerank", _pagerank_sql(24))(lambda m: graph.pagerank(m.graph, m.vertices, 0.85, tolerance=1e-10).select("id", F.round("rank", 6).alias("rank")))
query("betweenness")(lambda m: graph.betweenness(m.graph, m.vertices))
query("k_paths", "WITH RECURSIVE p AS (SELECT [1, dst] AS path, dst AS tip FROM graph WHERE src = 1 UNION ALL SELECT list_append(path, dst), dst FROM p JOIN graph ON src = tip WHERE NOT list_contains(path, dst) AND len(path) <= 2 AND tip <> (SELECT MAX(id) - 1 FROM vertices)) SELECT CAST(len(path) - 1 AS BIGINT) AS hops, CAST(len(path) - 1 AS DOUBLE) AS cost, array_to_string(path, '>') AS path FROM p WHERE tip = (SELECT MAX(id) - 1 FROM vertices) ORDER BY hops, path LIMIT 3")(
    lambda m: graph.k_paths(m.graph.select("src", "dst"), 1, m.vertices.agg(F.max("id")).first()[0] - 1, 3)
)
query("louvain")(lambda m: graph.louvain(m.graph, m.vertices))
query("label_propagation")(lambda m: graph.label_propagation(m.graph, m.vertices))
_NAT = "WITH c AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS cluster_id FROM supplier)"
_nat = lambda m: m.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("cluster_id"))
query("cohesion", f"{_NAT} SELECT a.cluster_id, CAST(COUNT(*) FILTER (a.cluster_id = b.cluster_id) AS BIGINT) AS inside, COUNT(*) AS total, CAST(floor(COUNT(*) FILTER (a.cluster_id = b.cluster_id) * 100.0::DOUBLE / COUNT(*) + 0.5) AS BIGINT) AS cohesion FROM graph JOIN c a ON src = a.id JOIN c b ON dst = b.id GROUP BY 1")(lambda m: graph.cohesion(m.graph, _nat(m)))
query("modularity", f"{_NAT}, m AS (SELECT COUNT(*)::DOUBLE AS m FROM graph), o AS (SELECT src, COUNT(*) AS ko FROM graph GROUP BY 1), i AS (SELECT dst, COUNT(*) AS ki FROM graph GROUP BY 1) SELECT floor(SUM(CASE WHEN a.cluster_id = b.cluster_id THEN 1.0::DOUBLE ELSE 0 END - ko * ki / m) / MAX(m) * 10000 + 0.5) / 10000 AS modularity FROM graph g JOIN c a ON g.src = a.id JOIN c b ON g.dst = b.id JOIN o ON g.src = o.src JOIN i ON g.dst = i.dst, m")(lambda m: graph.edge_modularity(m.graph, _nat(m)))
query("dir_mismatch", "WITH c AS (SELECT id, scc_id % 7 AS cluster_id FROM scc), n AS (SELECT cluster_id, regexp_replace(path, '/[^/]*$', '') AS dir, COUNT(*) AS k FROM c JOIN files f ON c.id = f.id GROUP BY ALL) SELECT cluster_id, CAST(SUM(k) AS BIGINT) AS size, COUNT(*) AS dirs, CAST(SUM(k) - MAX(k) AS BIGINT) AS mismatch FROM n GROUP BY 1 HAVING COUNT(*) > 1")(
    lambda m: graph.directory_mismatch(graph.strong_components(m.graph, m.vertices).select("id", (F.col("scc_id") % 7).alias("cluster_id")), m.files)
)
query("affected_tests", "WITH RECURSIVE r AS (SELECT source_id AS id, 1 AS d FROM edges WHERE target_id = 12 UNION SELECT e.source_id, d + 1 FROM r JOIN edges e ON e.target_id = r.id WHERE d < 2), t AS (SELECT f.id AS file_id, f.path, MIN(d) AS depth FROM (SELECT id, MIN(d) AS d FROM r WHERE id <> 12 GROUP BY id) x JOIN symbols s ON x.id = s.id JOIN files f ON s.file_id = f.id WHERE file_role = 'test' GROUP BY ALL), b AS (SELECT id AS file_id, path FROM files WHERE file_role = 'test' AND regexp_replace(path, '/[^/]*$', '') IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.id = 12)) SELECT file_id, path, CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS evidence, depth FROM t UNION ALL SELECT file_id, path, 'colocated', 0 FROM b WHERE file_id NOT IN (SELECT file_id FROM t)")(
    lambda m: scoring.affected_tests(m.edges, m.symbols, m.files, ids(m, "id", SYMBOL), 2)
)

# text

query("indent_complexity", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), i AS (SELECT doc_id, length(regexp_extract(line, '^[ \\t]*')) - length(replace(regexp_extract(line, '^[ \\t]*'), chr(9), '')) + (length(replace(regexp_extract(line, '^[ \\t]*'), chr(9), ''))) / 4.0::DOUBLE AS ind FROM l WHERE trim(line, ' ' || chr(9) || chr(10) || chr(13)) <> '') SELECT doc_id AS id, floor(AVG(ind) * MAX(ind) * 100 + 0.5) / 100 AS complexity FROM i GROUP BY doc_id")(
    lambda m: complexity.indent_complexity(m.raw("documents").select(F.col("doc_id").alias("id"), "text"))
)
query("text_complexity", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), d AS (SELECT doc_id, floor(MAX(length(replace(regexp_extract(line, '^[ \\t]*'), ' ', '')) + length(replace(regexp_extract(line, '^[ \\t]*'), chr(9), '')) / 4.0::DOUBLE)) AS depth FROM l WHERE trim(line, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1), t AS (SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '\\b(and|or)\\b|&&|[|][|]')) AS BIGINT) AS bool_ops, CAST(len(regexp_extract_all(text, '\\breturn\\b')) AS BIGINT) AS returns, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(COALESCE(depth, 0) AS BIGINT) AS depth FROM documents LEFT JOIN d USING (doc_id)) SELECT *, CAST(2 * depth + bool_ops + GREATEST(returns - 1, 0) AS DOUBLE) AS cognitive, round((2 * depth + bool_ops + GREATEST(returns - 1, 0))::DOUBLE / GREATEST(lines, 1), 4) AS density FROM t")(
    lambda m: complexity.text_complexity(m.raw("documents").select(F.col("doc_id").alias("id"), "text"))
)
query("html_references", "SELECT page_id, h AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS h FROM pages)")(
    lambda m: m.raw("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("target"))
)
def _templates(m: Model) -> DataFrame:
    """A component's template for each page, with the page's own words."""
    w = lambda k: F.get(F.regexp_extract_all("html", F.lit("[A-Za-z]+"), F.lit(0)), F.lit(k))
    text = F.concat(F.lit("<script>let x = 1</script><template><div>{{ v"), w(4), F.lit(' }}<p :class="c'), w(5), F.lit('" @click="h'), w(6), F.lit('"/><T'), w(7), F.lit("/>{{ v"), w(4), F.lit(" }}</div></template>"))
    return m.raw("pages").select(F.col("url").alias("path"), text.alias("content"))


query("vue_template_refs", "WITH w AS (SELECT url, regexp_extract_all(html, '[A-Za-z]+') AS w FROM pages), c AS (SELECT url, ['v' || w[5], 'c' || w[6], 'h' || w[7], 'T' || w[8], 'v' || w[5]] AS names FROM w) SELECT url AS path, row_number() OVER (PARTITION BY url ORDER BY k) - 1 AS ordinal, n AS target_name, 'template' AS kind FROM (SELECT url, n, MIN(k) AS k FROM (SELECT url, unnest(names) AS n, unnest(range(5)) AS k FROM c) GROUP BY ALL)")(
    lambda m: resolve.template_refs(_templates(m))
)
query("file_roles", "SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)(test|tests|__tests__|spec|specs)/') THEN 'test' ELSE 'source' END AS role FROM (SELECT page_id, 'src/' || CASE WHEN page_id % 3 = 0 THEN 'tests/' ELSE 'app/' END || page_id || '.py' AS path FROM pages)")(
    lambda m: m.raw("pages").select("page_id", classify.role(F.concat(F.lit("src/"), F.when(F.col("page_id") % 3 == 0, "tests/").otherwise("app/"), F.col("page_id").cast("string"), F.lit(".py"))).alias("role"))
)
query("resolve_references", "WITH r AS (SELECT l_orderkey * 100 + l_linenumber AS ref, MIN(l_suppkey) AS file_id, MIN(l_partkey) AS target FROM lineitem GROUP BY ALL), c AS (SELECT r.ref, s.id, row_number() OVER (PARTITION BY r.ref ORDER BY CASE WHEN s.file_id = r.file_id THEN 0 ELSE 1 END, CASE WHEN regexp_replace(f.path, '/[^/]*$', '') = regexp_replace(g.path, '/[^/]*$', '') THEN 0 ELSE 1 END, 1 - is_exported, s.id) AS k FROM r JOIN part p ON r.target = p_partkey JOIN symbols s ON s.name = p_name JOIN files f ON s.file_id = f.id JOIN files g ON r.file_id = g.id) SELECT ref, id AS target_id FROM c WHERE k = 1")(
    lambda m: resolve.nearest_homonym(
        m.raw("lineitem").groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ref")).agg(F.min("l_suppkey").alias("file_id"), F.min("l_partkey").alias("p_partkey")).join(m.raw("part").select("p_partkey", F.col("p_name").alias("target_name")), "p_partkey").select("ref", "file_id", "target_name"),
        m.symbols, m.files,
    ).select("ref", "target_id")
)

# sets

query("changed_files", "SELECT COALESCE(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT s_suppkey AS id, CAST(s_acctbal AS VARCHAR) AS h FROM supplier WHERE s_suppkey % 10 <> 0) a FULL JOIN (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE CAST(s_acctbal AS VARCHAR) END AS h FROM supplier WHERE s_suppkey % 9 <> 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.h <> b.h")(
    lambda m: incremental.changed_files(
        m.raw("supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("path"), F.col("s_acctbal").cast("string").alias("hash"), F.lit(1.0).alias("mtime")),
        m.raw("supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise(F.col("s_acctbal").cast("string")).alias("hash"), F.lit(2.0).alias("mtime")),
    ).select(F.col("path").alias("id"), "change")
)
query("file_edges", "SELECT source_file_id, target_file_id, symbol_count FROM file_edges")(lambda m: relational.file_edges(m.edges, m.symbols).drop("kind"))
query("path_set_algebra", "SELECT 'both' AS part, COUNT(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7) UNION ALL SELECT 'first', COUNT(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)")(
    lambda m: incremental.part_sizes(m.raw("lineitem"))
)


query("resolve_edges", "WITH sc AS (SELECT s.*, f.path, regexp_replace(f.path, '/[^/]*$', '') AS dir, regexp_extract(qualified_name, '^(.*)(?:::|[.])[^.:]+$', 1) AS scope FROM symbols s JOIN files f ON s.file_id = f.id), by_name AS (SELECT ref, arg_min(id, CASE WHEN source_name = qualified_name THEN 0 ELSE 1000000000 END + id) AS id FROM code_refs r JOIN symbols s ON s.file_id = r.ref_file AND source_name IN (s.name, s.qualified_name) GROUP BY ref), by_line AS (SELECT ref, arg_min(id, CASE WHEN r.line BETWEEN line_start AND line_end THEN -1000 - line_start ELSE line_start END * 1000000 + id) AS id FROM code_refs r JOIN symbols s ON s.file_id = r.ref_file GROUP BY ref), src AS (SELECT r.*, COALESCE(n.id, l.id) AS source_id FROM code_refs r LEFT JOIN by_name n USING (ref) LEFT JOIN by_line l USING (ref)), asks AS (SELECT src.*, sc.scope AS source_scope, f.path AS source_file, regexp_replace(f.path, '/[^/]*$', '') AS source_dir FROM src JOIN sc ON src.source_id = sc.id JOIN files f ON src.ref_file = f.id), cand AS (SELECT a.*, t.id AS target_id, CASE WHEN t.qualified_name = a.target_name THEN 1 WHEN t.name = a.target_name THEN 2 ELSE 3 END AS tier, t.kind AS t_kind, t.file_id AS t_file, t.scope AS t_scope, t.dir AS t_dir, t.path AS t_path, t.is_exported AS t_exp FROM asks a JOIN sc t ON lower(CASE WHEN a.target_name LIKE 'Brand#%.%' THEN split_part(a.target_name, '.', 2) ELSE a.target_name END) = lower(t.name) WHERE a.target_name NOT LIKE 'Brand#%.%' OR t.qualified_name = a.target_name), best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier, CASE WHEN kind = 'call' AND regexp_matches(target_name, '^[A-Z]') AND t_kind IN ('class', 'struct', 'interface') THEN 0 ELSE 1 END, CASE WHEN t_file = ref_file THEN 0 ELSE 1 END, CASE WHEN t_file = ref_file AND source_scope <> '' AND t_scope = source_scope THEN 0 ELSE 1 END, CASE WHEN t_dir = source_dir THEN 0 ELSE 1 END, CASE WHEN import_path <> '' AND '/' || t_path LIKE '%/' || import_path || '/%' THEN 0 ELSE 1 END, t_exp DESC, target_id) = 1) SELECT source_id, target_id, kind, line FROM best WHERE source_id <> target_id QUALIFY row_number() OVER (PARTITION BY source_id, target_id, kind ORDER BY line, ref) = 1")(
    lambda m: resolve.resolve(m.references, m.symbols, m.files)
)
_PATHS = "test/a.x tests/b/c.py src/__tests__/x.js test_a.py a_test.go a.spec.ts FooTest.java vendor/x/y.go node_modules/a/b.js .github/workflows/ci.yml .travis.yml Jenkinsfile dist/a.js Makefile Dockerfile setup.py a.pb.go b_pb2.py c.min.js README.md LICENSE docs/x.rst package.json tsconfig.json pyproject.toml a.ini b.yaml logo.png t.csv d.json x.sqlite documentation/a.py examples/e.py sample/x.py scripts/run.py bin/tool tools/t.go config/app.rb conf/x.unknown settings/s.py src/main.c lib/a.rs x"
query("file_role_rules", f"SELECT p AS path, CASE WHEN regexp_matches(p, '(^|/)(vendor|node_modules|third_party|bower_components|external)/') THEN 'vendored' WHEN regexp_matches(p, '(^|/)(test|tests|__tests__|spec|specs)/') OR regexp_matches(b, '^test_.*[.]py$|_test[.](py|go|rb)$|[.](test|spec)[.][jt]sx?$|Tests?[.](java|cs|cls|kt)$') THEN 'test' WHEN regexp_matches(p, '^([.]github/workflows|[.]circleci|[.]gitlab)/') OR lower(b) IN ('.travis.yml', 'jenkinsfile') THEN 'ci' WHEN regexp_matches(p, '(^|/)(dist|build|out|target)/') OR lower(b) IN ('makefile', 'dockerfile', 'setup.py') THEN 'build' WHEN regexp_matches(lower(b), '([.]pb[.](go|cc|h)|_pb2(_grpc)?[.]py|[.]min[.](js|css))$') THEN 'generated' WHEN regexp_matches(lower(b), '^(readme|license|changelog)([.].*)?$') OR regexp_matches(lower(b), '[.](md|rst|adoc)$') THEN 'docs' WHEN lower(b) IN ('package.json', 'tsconfig.json', 'pyproject.toml') OR regexp_matches(lower(b), '[.](ini|cfg|conf|toml|ya?ml|properties|env)$') THEN 'config' WHEN regexp_matches(lower(b), '[.](png|jpe?g|gif|svg|csv|tsv|json|xml|sqlite|db)$') THEN 'data' WHEN regexp_matches(p, '(^|/)(docs?|documentation)/') THEN 'docs' WHEN regexp_matches(p, '(^|/)(examples?|samples?|demos?)/') THEN 'examples' WHEN regexp_matches(p, '(^|/)(scripts?|bin|tools)/') THEN 'scripts' WHEN regexp_matches(p, '(^|/)(config|conf|settings)/') AND NOT regexp_matches(lower(b), '[.](py|rb|go|js|ts|c|rs)$') THEN 'config' ELSE 'source' END AS role FROM (SELECT p, regexp_replace(p, '^.*/', '') AS b FROM (SELECT unnest(string_split('{_PATHS}', ' ')) AS p))")(
    lambda m: m.spark.createDataFrame([(p,) for p in _PATHS.split()], "path string").select("path", classify.role("path").alias("role"))
)
