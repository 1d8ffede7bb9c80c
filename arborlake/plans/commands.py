"""The commands: each composes operators over a store and returns a summary and named tables.

A table's DataFrame is lazy; the front end collects as many rows as it shows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions import classify, stats
from arborlake.functions.strings import abbreviate, contains_ci, dirname, tokens
from arborlake.operators import graph, relational, scoring, temporal
from arborlake.operators.incremental import append_snapshot, read_history
from arborlake.operators.ranking import running_budget
from arborlake.plans import reports
from arborlake.plans.index import Store


@dataclass
class Report:
    command: str
    tables: dict[str, DataFrame]
    summary: dict
    sarif: Callable[[dict[str, list[dict]]], dict] | None = None
    failed: bool = False


COMMANDS: dict[str, Callable[..., Report]] = {}


def command(f: Callable[..., Report]) -> Callable[..., Report]:
    COMMANDS[f.__name__.rstrip("_").replace("_", "-")] = f
    return f


def _ids(s: Store, df: DataFrame) -> DataFrame:
    return df.select("id")


def _edges(s: Store) -> DataFrame:
    return s.get("edges").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "kind")


def _find(s: Store, name: str, limit: int = 1) -> DataFrame:
    """file:symbol or symbol."""
    hint, _, plain = name.rpartition(":")
    return relational.resolve_symbol(relational.with_path(s.get("symbols"), s.get("files")).drop("language"), s.get("edges"), plain or name, hint or None, limit)


def _changed(s: Store, paths: list[str]) -> DataFrame:
    rows = s.spark.createDataFrame([(p,) for p in paths], "path string")
    return relational.resolve_paths(rows, s.get("files")).select(F.col("id").alias("file_id"), "path")


def _symbols_of(s: Store, changed: DataFrame) -> DataFrame:
    return s.get("symbols").join(changed.select("file_id"), "file_id", "left_semi")


def _value(df: DataFrame):
    row = df.first()
    return row[0] if row else None


@command
def search(s: Store, pattern: str, limit: int = 20, kind: str | None = None) -> Report:
    found = relational.search_symbols(s.get("symbols"), s.get("files"), s.get("graph_metrics"), pattern, limit, kind)
    counts = relational.edge_counts(s.get("edges"), found)
    total = _value(s.get("symbols").filter(contains_ci("name", pattern)).agg(F.count("*")))
    return Report("search", {"results": found.join(counts, "id").select("id", "name", abbreviate("kind").alias("kind"), "file_path", "line_start", "callers", "callees").orderBy(F.desc("callers"), "id")}, {"total": total})


@command
def grep(s: Store, pattern: str, limit: int = 200, kind: str | None = None, exported: bool = False) -> Report:
    more = ([F.col("kind") == kind] if kind else []) + ([F.col("is_exported") == 1] if exported else [])
    found = relational.grep_symbols(s.get("symbols"), s.get("files"), pattern, limit, more)
    return Report("grep", {"results": found.join(relational.edge_counts(s.get("edges"), found), "id").select("id", "name", "kind", "file_path", "line_start", "callers", "callees")}, {"pattern": pattern})


@command
def symbol(s: Store, name: str) -> Report:
    one = _find(s, name)
    near = lambda f: relational.neighbour_first_kind(f(s.get("edges"), s.get("symbols"), s.get("files"), one), {"call": 0, "inherits": 1, "implements": 2, "import": 3, "reference": 4}).select("id", "name", "kind", "edge_kind", "file_path", "edge_line")
    return Report("symbol", {"symbol": one.join(s.get("graph_metrics").withColumnRenamed("symbol_id", "id"), "id", "left"), "callers": near(relational.callers), "callees": near(relational.callees)}, {"name": name})


@command
def deps(s: Store, path: str) -> Report:
    f = _changed(s, [path]).first()
    file_id = f.file_id if f else -1
    return Report("deps", {"imports": relational.file_imports(s.get("file_edges"), s.get("files"), file_id).join(relational.used_symbols(s.get("edges"), s.get("symbols"), file_id).withColumnRenamed("file_id", "id"), "id", "left"), "imported_by": relational.file_imported_by(s.get("file_edges"), s.get("files"), file_id)}, {"path": path})


@command
def uses(s: Store, name: str) -> Report:
    found = _find(s, name, 10)
    return Report("uses", {"uses": relational.uses(s.get("edges"), s.get("symbols"), s.get("files"), found).select("edge_kind", "name", "kind", "file_path", "edge_line")}, {"name": name})


@command
def weather(s: Store, count: int = 20) -> Report:
    return Report("weather", {"hotspots": scoring.hotspots(s.get("file_stats"), s.get("files"), count)}, {"count": count})


@command
def file_(s: Store, path: str) -> Report:
    f = _changed(s, [path])
    syms = _symbols_of(s, f)
    return Report("file", {"symbols": syms.join(relational.parent_depth(s.get("symbols")), "id").select("id", "name", "kind", "line_start", "line_end", "depth").orderBy("line_start", "id")}, {"path": path})


@command
def map_(s: Store, budget: int = 2000, count: int = 40) -> Report:
    top = relational.ranked(s.get("symbols"), s.get("files"), s.get("graph_metrics"), [F.desc("pagerank")], count)
    fit = running_budget(top.withColumn("cost", tokens(F.concat_ws(" ", "name", "signature", "file_path"))), [F.desc("pagerank"), F.asc("id")], "cost", budget)
    return Report("map", {"symbols": fit.select("id", "name", "kind", "file_path", "running"), "directories": relational.top_directories(s.get("files")), "edge_kinds": relational.distribution(s.get("edges"), "kind")}, {"budget": budget})


@command
def clusters(s: Store, least: int = 3) -> Report:
    c = s.get("clusters").select(F.col("symbol_id").alias("id"), "cluster_id")
    sizes = relational.clusters_listed(s.get("clusters"), s.get("symbols")).filter(F.col("size") >= least)
    files = s.get("symbols").select("id", "file_id").join(s.get("files").select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")
    return Report("clusters", {"clusters": sizes.join(graph.cohesion(_edges(s), c), "cluster_id", "left"), "mismatch": graph.directory_mismatch(c, files)}, {"quality": _value(graph.edge_modularity(_edges(s), c))})


@command
def layers(s: Store) -> Report:
    at = s.get("layers")
    arch = graph.architecture(at).first()
    return Report("layers", {"layers": graph.layer_sizes(at), "top": relational.layer_top(at, s.get("graph_metrics")).join(s.get("symbols").select("id", "name"), "id"), "violations": graph.layer_violations(_edges(s), at)}, {"layers": arch.layers, "type": arch.arch_type})


@command
def trace(s: Store, source: str, target: str, k: int = 3) -> Report:
    a, b = _find(s, source).first(), _find(s, target).first()
    if a is None or b is None:
        return Report("trace", {}, {"error": "no such symbol"}, failed=True)
    e = _edges(s)
    paths = graph.k_paths(e, a.id, b.id, k)
    if paths.isEmpty():  # one path whichever way the edges point
        paths = graph.k_paths(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")), a.id, b.id, 1)
    scored = graph.trace(paths, s.get("graph_metrics").withColumnRenamed("symbol_id", "id"))
    steps = graph.annotate_paths(paths, s.get("symbols"), s.get("files"))
    return Report("trace", {"paths": scored.orderBy("hops", "cost", "path"), "steps": steps.orderBy("path", "step")}, {"from": source, "to": target})


TASKS = ("refactor", "debug", "extend", "review", "understand")


@command
def context(s: Store, name: str, task: str = "understand") -> Report:
    if task not in TASKS:
        raise ValueError(f"task is one of {', '.join(TASKS)}")
    one = _find(s, name)
    first = one.first()
    callers, callees = (f(s.get("edges"), s.get("symbols"), s.get("files"), one) for f in (relational.callers, relational.callees))
    tables = {"symbol": one, "callers": callers, "callees": callees}
    if first is not None:
        siblings = s.get("symbols").filter((F.col("file_id") == first.file_id) & (F.col("id") != first.id)).select("id", "name", "kind").orderBy("id").limit(10)
        read = callers.select("file_path").unionByName(callees.select("file_path")).groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(10)
        tables |= {"siblings": siblings, "files_to_read": read}
        if task in ("refactor", "review"):
            tables["tests"] = scoring.affected_tests(s.get("edges"), s.get("symbols"), s.get("files"), one)
            tables["blast"] = graph.blast_radius(_edges(s), _ids(s, one), s.get("symbols"))
        if task in ("debug", "review"):
            up = graph.reachable(graph.reverse(_edges(s)), _ids(s, one), 15)
            tables["entry_points"] = relational.entry_points(s.get("symbols"), s.get("edges"), s.get("files"), up).orderBy("id").limit(5)
        if task in ("extend", "understand"):
            tables["similar"] = relational.similar_symbols(s.get("symbols"), s.get("files"), first.id)
            tables["shared"] = relational.shared_neighbours(s.get("edges"), callers.select("id").unionByName(callees.select("id")).distinct())
        tables["coupling"] = temporal.strength(s.get("git_cochange"), first.file_id)
    return Report("context", tables, {"name": name, "task": task})


@command
def diff(s: Store, paths: list[str], coupling: bool = False) -> Report:
    c = _changed(s, paths)
    blast = graph.blast_radius(_edges(s), _ids(s, _symbols_of(s, c)), s.get("symbols"))
    blast = blast.withColumn("risk", scoring.blast_class(F.col("symbols")))
    tables = {"changed": c, "blast": blast, "tests": scoring.affected_tests(s.get("edges"), s.get("symbols"), s.get("files"), _symbols_of(s, c))}
    if coupling:
        tables["missing"] = relational.missing_partners(s.get("git_cochange"), c, 3)
    return Report("diff", tables, {"files": len(paths)})


LEVELS = ("OK", "LOW", "MEDIUM", "HIGH", "CRITICAL")


@command
def preflight(s: Store, paths: list[str]) -> Report:
    """Six checks of what is about to be committed: reach, tests, complexity, partners left out, conventions, kinds of file."""
    c = _changed(s, paths)
    syms = _symbols_of(s, c)
    count = lambda df: _value(df.agg(F.count("*"))) or 0
    level = lambda x, *at: next((LEVELS[-1 - k] for k, least in enumerate(at) if least is not None and x >= least), "OK")
    exported = syms.filter("is_exported = 1")
    blast, n_files = graph.blast_radius(_edges(s), _ids(s, exported), s.get("symbols"), 8).first()
    has_exports = not exported.isEmpty()
    tests = count(scoring.affected_tests(s.get("edges"), s.get("symbols"), s.get("files"), exported).filter("evidence <> 'colocated'")) if has_exports else 0
    worst = _value(s.get("symbol_metrics").join(syms.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").agg(F.max("cognitive_complexity"))) or 0
    missing = count(relational.missing_partners(s.get("git_cochange"), c, 1).withColumn("_rn", F.row_number().over(W.partitionBy("file_id").orderBy(F.desc("cochange_count"), "partner"))).filter("_rn <= 5"))
    is_test, low_risk = classify.is_test("path"), classify.is_low_risk("path")
    kinds = c.agg(F.count_if(is_test).alias("tests"), F.count_if(low_risk).alias("low"), F.count_if(~is_test & ~low_risk).alias("code"), F.count("*").alias("n")).first()
    checks = [
        ("blast radius", level(blast, 50, 20, 5, 1), f"{blast} symbols, {n_files} files affected"),
        ("test coverage", "MEDIUM" if has_exports and not tests else "OK", f"{tests} tests cover changed code" if tests else "no tests found for changed exports" if has_exports else "no exports changed"),
        ("complexity", level(worst, None, 50, 25, 10), f"greatest cognitive complexity: {worst:g}"),
        ("coupling", level(missing, None, 5, 2, 1), f"{missing} files that mostly change along are left out"),
        ("conventions", "OK" if not kinds.code or tests else "LOW", "tests go with the code" if not kinds.code or tests else f"{kinds.code} code files without tests"),
        ("fitness", "OK", f"{kinds.n - kinds.low - kinds.tests} code, {kinds.tests} test, {kinds.low} low-risk files"),
    ]
    worst_level = max((x[1] for x in checks), key=LEVELS.index)
    return Report("preflight", {"checks": s.spark.createDataFrame(checks, "check string, level string, detail string")}, {"risk": worst_level, "files": kinds.n, "symbols": count(syms)})


@command
def dead(s: Store, now: int | None = None) -> Report:
    d = scoring.dead_confidence(relational.dead_exports(s.get("symbols"), s.get("edges"), s.get("files")), s.get("edges"), s.get("symbols"))
    ages = temporal.age_days(s.get("git_commits"), s.get("git_file_changes").filter("file_id IS NOT NULL"), now or int(__import__("time").time()))
    rows = scoring.dead_decay(d, ages).select("id", "name", "kind", "file_path", "line_start", "confidence", "lines", "effort", "decay")
    ids = d.select("id")
    inside = _edges(s).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    groups = graph.connected_components(inside, ids).groupBy("component").agg(F.count("*").alias("size")).filter("size >= 2")
    by_dir = d.groupBy(dirname("file_path").alias("dir")).agg(F.count("*").alias("n"))
    return Report("dead", {"dead": rows.orderBy(F.desc("confidence"), "id"), "clusters": groups, "by_dir": by_dir}, {"dead": _value(d.agg(F.count("*")))}, sarif=lambda t: reports.dead_sarif(t["dead"]))


@command
def complexity(s: Store, least: float = 15, limit: int = 20) -> Report:
    m = s.get("symbol_metrics")
    return Report("complexity", {"symbols": relational.complexity_by_symbol(m, s.get("symbols"), s.get("files"), least, limit), "files": relational.complexity_by_file(m, s.get("symbols"), s.get("files"), least)}, {"least": least}, sarif=lambda t: reports.complexity_sarif(t["symbols"]))


@command
def coupling(s: Store, least: int = 3, limit: int = 20) -> Report:
    c = temporal.coupling(s.get("git_cochange"), s.get("files"), least, limit)
    return Report("coupling", {"pairs": c}, {r["class"]: r.n for r in c.groupBy("class").agg(F.count("*").alias("n")).collect()})


@command
def fan(s: Store, limit: int = 20, least: int = 1) -> Report:
    j = relational.with_path(s.get("symbols"), s.get("files")).join(s.get("graph_metrics").withColumnRenamed("symbol_id", "id"), "id")
    return Report("fan", {"symbols": scoring.fan(j, limit, least).select("id", "name", "kind", "file_path", "in_degree", "out_degree", "flags")}, {"limit": limit})


@command
def risk(s: Store, limit: int = 20) -> Report:
    r = scoring.file_risk(s.get("files"), s.get("file_stats").select("file_id", "total_churn", "complexity"), temporal.symmetric_weight(s.get("git_cochange")).select("file_id", "weight"), relational.test_importers(s.get("file_edges"), s.get("files")))
    return Report("risk", {"files": r.orderBy(F.desc("risk"), "id").limit(limit)}, {"limit": limit})


def _metrics(s: Store) -> DataFrame:
    """The gates' metrics, one row each, computed once."""
    m = scoring.project_metrics(s.get("files"), s.get("symbols"), s.get("edges"), s.get("symbol_metrics"), s.get("graph_metrics"), s.get("git_cochange"), s.get("scc"))
    return s.spark.createDataFrame(m.collect(), "metric string, value double")


@command
def fitness(s: Store, preset: str = "default", record: bool = False, now: int = 0) -> Report:
    m = _metrics(s)
    g = scoring.gates(m, preset)
    v = {r.metric: r.value for r in m.collect()}
    wide = s.spark.createDataFrame([tuple(v[k] for k in scoring.QUICK)], ", ".join(f"{k} double" for k in scoring.QUICK))
    if record:
        row = s.spark.createDataFrame([(now, now, s.get("files").count(), s.get("symbols").count(), *v.values())], "id long, timestamp long, file_count long, symbol_count long, " + ", ".join(f"{k} double" for k in v))
        try:
            old = s.get("metrics_history")
        except FileNotFoundError:
            old = row.limit(0).withColumn("extra_json", F.lit(None).cast("string"))
        s.put("metrics_history", append_snapshot(old, row))
    failed = g.filter("NOT passed").count()
    return Report("fitness", {"gates": g}, {"quick_health": scoring.quick_health(wide).first().quick_health, "failed": failed}, sarif=lambda t: reports.gates_sarif(t["gates"]), failed=failed > 0)


@command
def health(s: Store, no_framework: bool = False) -> Report:
    """Cycles, god components, bottlenecks and layer violations, their severities, and one score."""
    scc, ranked = s.get("scc"), lambda o, n: relational.ranked(s.get("symbols"), s.get("files"), s.get("graph_metrics"), o, n)
    gods = scoring.god_components(ranked([(F.col("in_degree") + F.col("out_degree")).desc()], 50))
    necks = scoring.bottlenecks(ranked([F.desc("betweenness")], 15), s.get("graph_metrics"))
    if no_framework:
        gods, necks = scoring.without_frameworks(gods), scoring.without_frameworks(necks)
    places = s.get("symbols").select("id", "file_id").join(s.get("files").select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")
    cycles = graph.annotate_cycles(scc, places)
    weak = graph.weakest_edges(_edges(s), scc).join(cycles.filter("size >= 3").select("scc_id"), "scc_id", "left_semi")
    violations = graph.layer_violations(_edges(s), s.get("layers"))
    place = relational.with_path(s.get("symbols"), s.get("files"))
    violations = violations.join(place.select(F.col("id").alias("src"), F.col("name").alias("source"), "file_path"), "src").join(place.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    n_violations = violations.count()
    tally = {"CRITICAL": 0, "WARNING": n_violations, "INFO": 0}
    counts = {}
    for name, df in (("cycles", cycles), ("gods", gods), ("necks", necks)):
        counts[name] = {r.severity: r["count"] for r in df.groupBy("severity").count().collect()}
        for k, n in counts[name].items():
            tally[k] += n
    of_files = _value(s.get("file_stats").agg(F.avg("health_score"))) if "health_score" in s.get("file_stats").columns else None
    total = lambda name: sum(counts[name].values())
    row = (float(graph.tangle(scc).first().tangle_ratio or 0), counts["gods"].get("CRITICAL", 0), total("gods"), counts["necks"].get("CRITICAL", 0), total("necks"), n_violations, of_files)
    v = s.spark.createDataFrame([row], "tangle double, god_critical long, god long, neck_critical long, neck long, violations long, avg_health double")
    score = scoring.health(v).first().health
    first = F.when(F.col("category") == "actionable", 0).otherwise(1)
    tables = {
        "cycles": cycles.orderBy(F.desc("size"), "scc_id"), "god_components": gods.select("id", "name", "file_path", "degree", "category", "severity").orderBy(first, F.desc("degree"), "id"),
        "bottlenecks": necks.select("id", "name", "file_path", "betweenness", "category", "severity").orderBy(first, F.desc("betweenness"), "id"), "violations": violations.orderBy(F.desc("severity"), "src", "dst"), "cut": weak,
    }
    summary = {"health": score, "verdict": scoring.verdict(score, tally["CRITICAL"], tally["WARNING"]), "tangle_ratio": row[0], "propagation_cost": graph.propagation_cost(_edges(s), s.get("symbols"), scc).first().propagation_cost, "severities": tally}
    return Report("health", tables, summary, sarif=lambda t: reports.health_sarif(t["cycles"], t["god_components"], t["bottlenecks"], t["violations"]))


@command
def conventions(s: Store) -> Report:
    named = relational.with_path(s.get("symbols"), s.get("files"))
    bad = relational.convention_violations(named).join(named.select("id", "file_path", "line_start"), "id")
    return Report("conventions", {"styles": relational.conventions(s.get("symbols")), "violations": bad}, {"violations": bad.count()}, sarif=lambda t: reports.convention_sarif(t["violations"]))


@command
def breaking(s: Store, paths: list[str]) -> Report:
    b = scoring.breaking(s.get("symbols"), s.get("edges"), _changed(s, paths))
    order = F.when(F.col("severity") == "BREAKING", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return Report("breaking", {"exports": b.orderBy(order, F.desc("consumers"), "id")}, {"files": len(paths)})


@command
def coverage_gaps(s: Store, limit: int = 20, threshold: float = 0.0) -> Report:
    g = scoring.coverage_gaps(s.get("symbols"), s.get("graph_metrics"), s.get("symbol_metrics"), s.get("edges"), s.get("files"), threshold=threshold)
    return Report("coverage-gaps", {"gaps": g.orderBy(F.desc("score"), "id").limit(limit)}, {"limit": limit})


@command
def affected_tests(s: Store, paths: list[str], transitive: bool = True) -> Report:
    return Report("affected-tests", {"tests": scoring.affected_tests(s.get("edges"), s.get("symbols"), s.get("files"), _symbols_of(s, _changed(s, paths)), 8 if transitive else 1)}, {"files": len(paths)})


@command
def pr_risk(s: Store, paths: list[str]) -> Report:
    v = scoring.pr_risk(scoring.pr_facts(_changed(s, paths), s.get("symbols"), s.get("edges"), s.get("files"), s.get("graph_metrics"), s.get("symbol_metrics")))
    one = v.first().asDict()
    return Report("pr-risk", {"risk": s.spark.createDataFrame([one], v.schema)}, one)


def _series(s: Store, since: int | None = None, limit: int = 50) -> DataFrame:
    h = read_history(s.get("metrics_history"), limit, since)
    names = [c for c, t in h.dtypes if t in ("double", "bigint") and c not in ("id", "timestamp")]
    return h.selectExpr("timestamp AS idx", f"stack({len(names)}, " + ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in names) + ") AS (series, value)").filter("value IS NOT NULL")


@command
def trend(s: Store, since: int | None = None) -> Report:
    d = _series(s, since)
    return Report("trend", {"delta": stats.delta(d), "trend": stats.mann_kendall(d), "slope": stats.theil_sen(d), "spark": stats.sparkline(d)}, {})


@command
def alerts(s: Store, threshold: float = 2.0) -> Report:
    a = stats.alerts(_series(s), threshold=threshold, good_up=["test_ratio", "health_score"])
    return Report("alerts", {"alerts": a.orderBy("ord", "series"), "anomalies": stats.anomalies(_series(s))}, {"alerts": a.count()})


@command
def describe(s: Store) -> Report:
    f, y = s.get("files"), s.get("symbols")
    tables = {
        "languages": relational.distribution(f, "language"), "kinds": relational.distribution(y, "kind"), "directories": relational.directories(f, 10), "roles": relational.distribution(f, "file_role"),
        "top_symbols": relational.ranked(y, f, s.get("graph_metrics"), [F.desc("pagerank")], 10).select("name", "kind", "file_path", "pagerank"), "clusters": relational.clusters_listed(s.get("clusters"), y).orderBy(F.desc("size"), "cluster_id").limit(10),
        "churn": relational.top_churn(s.get("file_stats"), f, 10).select("path", "total_churn", "commit_count"), "entry_points": relational.shallow_files(f, 2).filter(F.col("path").rlike(r"(^|/)(main|index|app|cli|server)\.[^/]*$")).select("path").orderBy("path").limit(10), "tests": f.filter("file_role = 'test'").select("path").orderBy("path").limit(10),
    }
    return Report("describe", tables, {"files": f.count(), "symbols": y.count(), "edges": s.get("edges").count(), "cycles": graph.cycles(s.get("scc")).count()})


@command
def understand(s: Store) -> Report:
    r = describe(s)
    f = s.get("files")
    r.tables |= {"frameworks": classify.detect(f, classify.FRAMEWORKS), "build_tools": classify.detect(f, classify.BUILD_TOOLS), "test_pairs": classify.pair_tests(f), "packages": s.get("symbols").filter(F.col("kind").isin("module", "package")).select("name").distinct()}
    return Report("understand", r.tables, r.summary)


@command
def report(s: Store, preset: str = "default") -> Report:
    m = _metrics(s)
    g = scoring.gates(m, preset)
    return Report("report", {"metrics": m, "gates": g, **describe(s).tables}, describe(s).summary | {"failed": g.filter("NOT passed").count()}, sarif=lambda t: reports.gates_sarif(t["gates"]))
