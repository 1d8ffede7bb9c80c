"""Lookups, joins and aggregates over the canonical tables.

Every function takes DataFrames and parameters and returns a DataFrame; ranks have an id as the last
key, so that limits are total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.classify import is_test
from arborlake.functions.strings import basename, case_class, contains_ci, depth, dirname, top_dir
from arborlake.operators.ranking import first_per_key, top_by_order, top_per_key

SYMBOL = ["id", "file_id", "name", "qualified_name", "kind", "line_start", "line_end", "is_exported"]
CALLABLE = ["function", "class", "method"]


def with_path(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "language"), "file_id")


# lookups


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def by_id(table: DataFrame, key: str, value: int) -> DataFrame:
    return table.filter(F.col(key) == value)


def files_by_language(files: DataFrame, language: str) -> DataFrame:
    return files.filter(F.col("language") == language)


def files_in_dir(files: DataFrame, prefix: str) -> DataFrame:
    return files.filter(F.col("path").ilike(f"{prefix}%"))


def file_search(files: DataFrame, needle: str, limit: int) -> DataFrame:
    return top_by_order(files.filter(contains_ci("path", needle)), [F.asc("path"), F.asc("id")], limit)


def symbols_in_file(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return with_path(symbols, files.filter(F.col("path") == path))


def symbols_by(symbols: DataFrame, files: DataFrame, column: str, value) -> DataFrame:
    return with_path(symbols.filter(F.col(column) == value), files)


def exported_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return with_path(symbols.filter("is_exported = 1"), files)


def search_symbols(symbols: DataFrame, files: DataFrame, metrics: DataFrame, needle: str, limit: int, kind: str | None = None) -> DataFrame:
    found = symbols.filter(contains_ci("name", needle) if kind is None else contains_ci("name", needle) & (F.col("kind") == kind))
    ranked = found.join(metrics.select(F.col("symbol_id").alias("id"), "pagerank"), "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    return top_by_order(with_path(ranked, files), [F.desc("pagerank"), F.asc("id")], limit)


def grep_symbols(symbols: DataFrame, files: DataFrame, needle: str, limit: int = 200, conditions: list[Column] = ()) -> DataFrame:
    """Name, qualified name or signature; further conditions are and-ed."""
    hit = contains_ci("name", needle) | contains_ci("qualified_name", needle) | contains_ci("signature", needle)
    for c in conditions:
        hit = hit & c
    return top_by_order(with_path(symbols.filter(hit), files), [F.asc("file_path"), F.asc("line_start"), F.asc("id")], limit)


def resolve_symbol(symbols: DataFrame, edges: DataFrame, name: str, hint: str | None = None, fuzzy: int = 10) -> DataFrame:
    """Qualified, then simple, then fuzzy matches: the best tier's; a file hint narrows it unless nothing is left; most referenced first."""
    tier = F.when(F.col("qualified_name") == name, 1).when(F.col("name") == name, 2).when(contains_ci("name", name), 3)
    refs = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("refs"))
    found = symbols.withColumn("tier", tier).filter("tier IS NOT NULL").join(refs, "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    if hint:
        found = found.withColumn("hinted", F.when(contains_ci("file_path", hint), 0).otherwise(1))
    else:
        found = found.withColumn("hinted", F.lit(0))
    best = found.agg(F.min("tier").alias("b_tier"))
    found = found.join(F.broadcast(best), F.col("tier") == F.col("b_tier")).drop("b_tier")
    best = found.agg(F.min("hinted").alias("b_hinted"))
    found = found.join(F.broadcast(best), F.col("hinted") == F.col("b_hinted")).drop("b_hinted", "hinted")
    return top_by_order(found, [F.desc("refs"), F.asc("id")], fuzzy)


# neighbours


def _neighbour(edges: DataFrame, symbols: DataFrame, files: DataFrame, ids: DataFrame, near: str, far: str) -> DataFrame:
    e = edges.join(ids.select(F.col("id").alias(near)), near, "left_semi").select(F.col(near).alias("of_id"), F.col(far).alias("id"), F.col("kind").alias("edge_kind"), F.col("line").alias("edge_line"))
    return with_path(e.join(symbols, "id"), files)


def callers(edges: DataFrame, symbols: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    return _neighbour(edges, symbols, files, ids, "target_id", "source_id")


def callees(edges: DataFrame, symbols: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    return _neighbour(edges, symbols, files, ids, "source_id", "target_id")


def uses(edges: DataFrame, symbols: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """Incoming edges, once per kind and using symbol's name and file: the one of the least line."""
    return first_per_key(callers(edges, symbols, files, ids), ["edge_kind", "qualified_name", "file_path"], [F.asc("edge_line"), F.asc("id"), F.asc("of_id")])


def neighbour_first_kind(neighbours: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One row per neighbour: the edge kind of the highest priority."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("edge_kind")), F.lit(99))
    return first_per_key(neighbours, ["of_id", "id"], [rank, F.asc("edge_kind"), F.asc("edge_line")])


def edge_counts(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, callers, callees of ids: two aggregates in one pass."""
    both = edges.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    n = both.groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))
    return ids.select("id").join(n, "id", "left").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def name_twins(symbols: DataFrame, name: str, other_than: int) -> DataFrame:
    return symbols.filter((F.col("name") == name) & (F.col("id") != other_than))


def edges_to_twins(edges: DataFrame, symbols: DataFrame, name: str, other_than: int) -> DataFrame:
    return edges.join(name_twins(symbols, name, other_than).select(F.col("id").alias("target_id")), "target_id", "left_semi")


def similar_symbols(symbols: DataFrame, files: DataFrame, symbol_id: int, limit: int = 10) -> DataFrame:
    """Of the same kind, in files of the same folder."""
    all_ = with_path(symbols, files).withColumn("dir", dirname("file_path"))
    one = all_.filter(F.col("id") == symbol_id).select(F.col("kind").alias("k"), F.col("dir").alias("d"))
    found = all_.join(F.broadcast(one), (F.col("kind") == F.col("k")) & (F.col("dir") == F.col("d"))).filter(F.col("id") != symbol_id)
    return top_by_order(found.drop("k", "d"), [F.asc("id")], limit)


def shared_neighbours(edges: DataFrame, ids: DataFrame, least: int = 2) -> DataFrame:
    """Symbols that at least so many of ids refer to or are referred to by."""
    out = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("source_id").alias("of_id"), F.col("target_id").alias("id"))
    into = edges.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("of_id"), F.col("source_id").alias("id"))
    n = out.unionByName(into).distinct().groupBy("id").agg(F.count("*").alias("shared"))
    return n.filter(F.col("shared") >= least).join(ids.select("id"), "id", "left_anti")


def parent_depth(symbols: DataFrame, most: int = 20) -> DataFrame:
    """How many ancestors a symbol has: doubling, so that the number of joins is the logarithm of the depth."""
    now = symbols.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    known = symbols.select(F.col("id").alias("up"))
    now = now.join(known.withColumn("there", F.lit(1)), "up", "left").select("id", F.when(F.col("there") == 1, F.col("up")).alias("up"), F.when(F.col("there") == 1, 1).otherwise(0).alias("depth"))
    for _ in range(max(1, (most - 1).bit_length())):
        far = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        now = now.join(far, "up", "left").select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
    return now.select("id", F.least("depth", F.lit(most)).cast("long").alias("depth"))


# files


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol edges between files, counted."""
    at = symbols.select("id", "file_id")
    both = edges.join(at.select(F.col("id").alias("source_id"), F.col("file_id").alias("source_file_id")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("file_id").alias("target_file_id")), "target_id")
    return both.filter("source_file_id <> target_file_id").groupBy("source_file_id", "target_file_id").agg(F.lit("imports").alias("kind"), F.count("*").alias("symbol_count"))


def file_imports(file_edges_: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    g = file_edges_.filter(F.col("source_file_id") == file_id).groupBy(F.col("target_file_id").alias("id")).agg(F.sum("symbol_count").alias("symbol_count"))
    return files.select("id", "path", "language").join(g, "id")


def file_imported_by(file_edges_: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    g = file_edges_.filter(F.col("target_file_id") == file_id).groupBy(F.col("source_file_id").alias("id")).agg(F.sum("symbol_count").alias("symbol_count"))
    return files.select("id", "path", "language").join(g, "id")


def used_symbols(edges: DataFrame, symbols: DataFrame, file_id: int) -> DataFrame:
    """Per imported file, the names that a file uses of it."""
    own = symbols.filter(F.col("file_id") == file_id).select(F.col("id").alias("source_id"))
    there = symbols.filter(F.col("file_id") != file_id).select(F.col("id").alias("target_id"), "file_id", "name")
    return edges.join(own, "source_id", "left_semi").join(there, "target_id").groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


def test_importers(file_edges_: DataFrame, files: DataFrame) -> DataFrame:
    tests = files.filter(contains_ci("path", "test") | contains_ci("path", "spec") | (F.col("file_role") == "test")).select(F.col("id").alias("source_file_id"))
    return file_edges_.join(tests, "source_file_id", "left_semi").groupBy(F.col("target_file_id").alias("file_id")).agg(F.count_distinct("source_file_id").alias("test_importers"))


def resolve_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path -> file: exact, else the first file (by id) whose path ends in it. Suffix candidates meet by file name, so no theta join is needed."""
    p = paths.select(F.col("path").alias("asked")).distinct().withColumn("base", basename("asked"))
    f = files.select(F.col("id"), "path").withColumn("base", basename("path"))
    hit = p.join(f, "base").filter((F.col("path") == F.col("asked")) | F.col("path").endswith(F.col("asked")))
    return first_per_key(hit, ["asked"], [F.when(F.col("path") == F.col("asked"), 0).otherwise(1), F.asc("id")]).select("asked", "id", "path")


# anti joins


def unreferenced_exports(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    return with_path(symbols.filter((F.col("is_exported") == 1) & F.col("kind").isin(CALLABLE)).join(edges.select(F.col("target_id").alias("id")), "id", "left_anti"), files)


NOT_DEAD, NOT_DEAD_PREFIXES = ["__init__", "__main__", "main", "setup", "teardown"], ["_", "test_", "Test"]


def dead_exports(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Without entry-point names, private and test names, and test files."""
    d = unreferenced_exports(symbols, edges, files.filter(~is_test("path"))).filter(~F.col("name").isin(NOT_DEAD))
    for p in NOT_DEAD_PREFIXES:
        d = d.filter(~F.col("name").startswith(p))
    return d


def entry_points(symbols: DataFrame, edges: DataFrame, files: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Symbols that nothing refers to but that refer to something."""
    s = symbols if ids is None else symbols.join(ids.select("id"), "id", "left_semi")
    s = s.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti").join(edges.select(F.col("source_id").alias("id")), "id", "left_semi")
    return with_path(s, files)


def missing_partners(cochange: DataFrame, changed: DataFrame, least: int) -> DataFrame:
    """Files that mostly change with a changed one but haven't: file, partner, count."""
    both = cochange.select(F.col("file_id_a").alias("file_id"), F.col("file_id_b").alias("partner"), "cochange_count").unionByName(cochange.select(F.col("file_id_b").alias("file_id"), F.col("file_id_a").alias("partner"), "cochange_count"))
    c = changed.select("file_id")
    return both.filter(F.col("cochange_count") >= least).join(c, "file_id", "left_semi").join(c.select(F.col("file_id").alias("partner")), "partner", "left_anti")


# aggregates


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("cnt"))


def clusters_listed(clusters: DataFrame, symbols: DataFrame) -> DataFrame:
    j = clusters.join(symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id")
    return j.groupBy("cluster_id", "cluster_label").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("members"))


def cluster_members(clusters: DataFrame, symbols: DataFrame, files: DataFrame, metrics: DataFrame, cluster_id: int) -> DataFrame:
    j = clusters.filter(F.col("cluster_id") == cluster_id).select(F.col("symbol_id").alias("id")).join(symbols, "id").join(metrics.select(F.col("symbol_id").alias("id"), "pagerank"), "id", "left")
    return with_path(j.withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0))), files)


def ranked(symbols: DataFrame, files: DataFrame, metrics: DataFrame, order: list[Column], limit: int, kinds: list[str] | None = None) -> DataFrame:
    s = symbols if kinds is None else symbols.filter(F.col("kind").isin(kinds))
    return top_by_order(with_path(s.join(metrics.withColumnRenamed("symbol_id", "id"), "id"), files), [*order, F.asc("id")], limit)


def top_churn(stats: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    return top_by_order(stats.join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id"), [F.desc("total_churn"), F.asc("file_id")], limit)


def cochange_for_file(cochange: DataFrame, files: DataFrame, file_id: int, limit: int) -> DataFrame:
    """The partner is whichever end the file isn't: an equi-join on a computed key."""
    c = cochange.filter((F.col("file_id_a") == file_id) | (F.col("file_id_b") == file_id)).select(F.when(F.col("file_id_a") == file_id, F.col("file_id_b")).otherwise(F.col("file_id_a")).alias("id"), "cochange_count")
    return top_by_order(files.select("id", "path").join(c, "id"), [F.desc("cochange_count"), F.asc("id")], limit)


def complexity_by_file(metrics: DataFrame, symbols: DataFrame, files: DataFrame, above: float) -> DataFrame:
    j = metrics.join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id")
    cc = F.col("cognitive_complexity")
    g = j.groupBy("file_id").agg(F.count("*").alias("symbols"), F.round(F.avg(cc), 6).alias("avg_cc"), F.max(cc).alias("max_cc"), F.sum(F.when(cc >= 15, 1).otherwise(0)).alias("complex")).filter(F.col("max_cc") > above)
    return g.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def complexity_by_symbol(metrics: DataFrame, symbols: DataFrame, files: DataFrame, least: float, limit: int) -> DataFrame:
    j = metrics.filter(F.col("cognitive_complexity") >= least).withColumnRenamed("symbol_id", "id").withColumnRenamed("line_count", "lines").join(symbols, "id")
    return top_by_order(with_path(j, files), [F.desc("cognitive_complexity"), F.asc("id")], limit)


def directories(files: DataFrame, limit: int) -> DataFrame:
    """Folders by number of files, with their languages."""
    g = files.groupBy(dirname("path").alias("dir")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))
    return top_by_order(g, [F.desc("n"), F.asc("dir")], limit)


def top_directories(files: DataFrame) -> DataFrame:
    return files.groupBy(top_dir("path").alias("dir")).agg(F.count("*").alias("n"))


def shallow_files(files: DataFrame, levels: int) -> DataFrame:
    return files.filter(depth("path") <= levels)


def conventions(symbols: DataFrame) -> DataFrame:
    """Per kind, the case classes of the names that don't begin with _."""
    return symbols.filter(~F.col("name").startswith("_")).groupBy("kind", case_class("name").alias("style")).agg(F.count("*").alias("n"))


_STYLE = {"camelCase": r"^[a-z][a-zA-Z0-9]*$", "snake_case": r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$", "PascalCase": r"^[A-Z][a-zA-Z0-9]*$", "UPPER_SNAKE": r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"}


def convention_violations(symbols: DataFrame) -> DataFrame:
    """symbols: id, name, kind, is_exported, language. Names that break what their language does.

    Functions and methods go by whichever of camelCase and snake_case fits more of their names (none on a tie); classes,
    interfaces and structs are PascalCase and constants UPPER_SNAKE where that fits more than half. Names in PascalCase are
    excused as functions, and constants that aren't exported always. Names that are empty or begin with _ or < don't count."""
    name, group = F.col("name"), F.when(F.col("kind").isin("function", "method"), "func").when(F.col("kind").isin("class", "interface", "struct"), "type").when(F.col("kind") == "constant", "constant")
    s = symbols.filter((name != "") & ~name.startswith("_") & ~name.startswith("<")).withColumn("language", F.coalesce("language", F.lit("unknown"))).withColumn("group", group).filter("group IS NOT NULL")
    fits = {k: name.rlike(v) for k, v in _STYLE.items()}
    n = s.groupBy("language", "group").agg(F.count("*").alias("all"), *[F.count_if(v).alias(k) for k, v in fits.items()])
    func = F.when(F.col("camelCase") > F.col("snake_case"), "camelCase").when(F.col("snake_case") > F.col("camelCase"), "snake_case")
    most = lambda c: F.when(F.col(c) > F.col("all") * 0.5, c)
    rule = F.when(F.col("group") == "func", func).when(F.col("group") == "type", most("PascalCase")).otherwise(most("UPPER_SNAKE"))
    n = n.select("language", "group", rule.alias("expected")).filter("expected IS NOT NULL")
    breaks = F.lit(False)
    for k, v in fits.items():
        breaks = F.when(F.col("expected") == k, ~v).otherwise(breaks)
    excused = F.when(F.col("group") == "func", fits["PascalCase"]).when(F.col("group") == "constant", F.col("is_exported") != 1).otherwise(F.lit(False))
    return s.join(F.broadcast(n), ["language", "group"]).filter(breaks & ~excused).select("id", "name", "kind", "language", "expected", case_class("name").alias("actual"))


def layer_top(layers: DataFrame, metrics: DataFrame, k: int = 5) -> DataFrame:
    j = layers.join(metrics.select(F.col("symbol_id").alias("id"), "pagerank"), "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    return top_per_key(j, ["layer"], [F.desc("pagerank"), F.asc("id")], k)


def contained_in(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points: file_id, line. spans: id, file_id, line_start, line_end. Each point's innermost span (last start), by an equi-join on the file and a range."""
    s = spans.select(F.col("file_id").alias("s_file"), F.col("id").alias("symbol_id"), "line_start", "line_end")
    hit = points.join(s, (F.col("file_id") == F.col("s_file")) & F.col("line").between(F.col("line_start"), F.col("line_end")))
    return hit.groupBy("file_id", "line").agg(F.max(F.struct("line_start", (-F.col("symbol_id")).alias("k"))).alias("x")).select("file_id", "line", (-F.col("x.k")).alias("symbol_id"))
