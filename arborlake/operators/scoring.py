"""Scores, percentiles, gates and risk classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.classify import is_low_risk, is_test
from arborlake.functions.strings import any_of, contains_ci, round_half_up
from arborlake.session import Scratch

UTILITY_PATHS = [
    "composables/", "utils/", "services/", "lib/", "helpers/", "shared/", "config/", "core/", "hooks/", "stores/", "output/", "db/", "common/", "internal/", "infra/",
    "tests/", "test/", "__tests__/", "spec/", "dev/", "scripts/", "bin/", "benchmark/", "conftest.py",
]
UTILITY_NAMES = ["resolve.py", "helpers.py", "common.py", "base.py"]
#: Names that frameworks call: a report may leave them out.
FRAMEWORK_NAMES = (
    "__init__ __str__ __repr__ __new__ __del__ __enter__ __exit__ __getattr__ __setattr__ __getitem__ __setitem__ __len__ __iter__ __next__ __call__ __hash__ __eq__ "
    "constructor render toString valueOf toJSON setUp tearDown setup teardown configure register bootstrap main computed ref reactive watch watchEffect defineProps defineEmits "
    "defineExpose defineSlots onMounted onUnmounted onBeforeMount onBeforeUnmount onActivated onDeactivated onUpdated onBeforeUpdate provide inject toRef toRefs unref isRef shallowRef "
    "shallowReactive readonly shallowReadonly nextTick h resolveComponent emit emits props useState useEffect useCallback useMemo useRef useContext useReducer useLayoutEffect "
    "ngOnInit ngOnDestroy ngOnChanges ngAfterViewInit init New Close String Error new default fmt from into drop"
).split()


def is_utility(path: Column | str) -> Column:
    """Shared code, tests and tools, of which many dependents are expected."""
    p = F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/")))
    return any_of(p, UTILITY_PATHS) | F.substring_index(p, "/", -1).isin(UTILITY_NAMES)


def without_frameworks(ranked: DataFrame) -> DataFrame:
    return ranked.filter(~F.col("name").isin(FRAMEWORK_NAMES))


def percentile_low(column: str, p: float) -> Column:
    """An aggregate: of the n values in order, that at index floor(p n / 100), the last at most. Only distinct values and their counts are held.

    percentile_disc takes index ceil(p n) - 1; a little more than p makes that the floor for any n below 1e9."""
    return F.expr(f"percentile_disc({p / 100 + 1e-12!r}D) WITHIN GROUP (ORDER BY {column})")


def percentile_high(column: str, p: float) -> Column:
    """An aggregate: of the n values in order, that at index ceil(p n / 100) - 1."""
    return F.expr(f"percentile_disc({p / 100!r}D) WITHIN GROUP (ORDER BY {column})")


def percentile_or_one(column: str, p: float) -> Column:
    """percentile_low, with 1 in place of 0."""
    x = percentile_low(column, p)
    return F.when(x == 0, 1.0).otherwise(x.cast("double"))


def health(v: DataFrame) -> DataFrame:
    """v: tangle, god_critical, god, neck_critical, neck, violations, avg_health. A weighted geometric mean of decays, 0 to 100."""
    decay = lambda x, scale: F.exp(-x / scale)
    parts = [
        (0.30, decay(F.col("tangle"), 10)), (0.20, decay(3 * F.col("god_critical") + 0.5 * F.col("god"), 5)), (0.15, decay(2 * F.col("neck_critical") + 0.3 * F.col("neck"), 4)),
        (0.15, decay(F.col("violations"), 5)), (0.20, F.coalesce(F.least(F.col("avg_health") / 10, F.lit(1.0)), F.lit(1.0))),
    ]
    total = F.lit(0.0)
    for w, h in parts:
        total = total + w * F.log(F.greatest(h, F.lit(1e-9)))
    return v.withColumn("health", F.least(F.greatest(F.floor(100 * F.exp(total)), F.lit(0)), F.lit(100)).cast("long"))


def god_components(ranked: DataFrame, above: int = 20) -> DataFrame:
    """ranked: symbols with degrees and file_path. Those of a high degree; utility paths are judged more kindly, and listed last."""
    d = F.col("in_degree") + F.col("out_degree")
    utility = is_utility("file_path")
    severity = F.when(utility, F.when(d > 150, "CRITICAL").when(d > 90, "WARNING").otherwise("INFO")).otherwise(F.when(d > 50, "CRITICAL").when(d > 30, "WARNING").otherwise("INFO"))
    return ranked.withColumn("degree", d).filter(F.col("degree") > above).withColumn("category", F.when(utility, "utility").otherwise("actionable")).withColumn("severity", severity)


def bottlenecks(ranked: DataFrame, all_values: DataFrame, above: float = 0.5) -> DataFrame:
    """ranked: symbols with betweenness and file_path, to one decimal, against the 70th and 90th percentile of all_values.betweenness above 0 (half as much again for utility paths)."""
    p = all_values.filter("betweenness > 0").agg(F.coalesce(percentile_low("betweenness", 70), F.lit(0.0)).alias("p70"), F.coalesce(percentile_low("betweenness", 90), F.lit(0.0)).alias("p90"))
    utility = is_utility("file_path")
    scale = F.when(utility, 1.5).otherwise(1.0)
    b = F.col("betweenness")
    found = ranked.filter(b > above).withColumn("betweenness", round_half_up(b, 1)).withColumn("category", F.when(utility, "utility").otherwise("actionable"))
    return found.join(F.broadcast(p)).withColumn("severity", F.when(b > F.col("p90") * scale, "CRITICAL").when(b > F.col("p70") * scale, "WARNING").otherwise("INFO"))


#: Penalties: a metric, and what is taken off above each step, the highest first.
QUICK = {
    "tangle_ratio": [(10, 20), (5, 10)], "god_components": [(5, 15), (2, 8)], "dead_pct": [(15, 10), (5, 5)], "avg_complexity": [(25, 15), (15, 8)], "cycle_count": [(5, 10)],
}


def quick_health(v: DataFrame) -> DataFrame:
    """v: tangle_ratio, god_components, dead_pct, avg_complexity, cycle_count. 100 less a penalty for the highest step that each is above."""
    left = F.lit(100)
    for metric, steps in QUICK.items():
        penalty = F.lit(0)
        for least, off in reversed(steps):
            penalty = F.when(F.col(metric) > least, off).otherwise(penalty)
        left = left - penalty
    return v.withColumn("quick_health", F.least(F.greatest(left, F.lit(0)), F.lit(100)).cast("long"))


def verdict(score: int, critical: int, warnings: int) -> str:
    """The health report's first line."""
    if score >= 80:
        return f"Healthy codebase ({score}/100): {critical} critical issues"
    state = "Fair codebase" if score >= 60 else "Needs attention" if score >= 40 else "Unhealthy codebase"
    return f"{state} ({score}/100): {critical} critical, {warnings} warnings"


def project_metrics(files: DataFrame, symbols: DataFrame, edges: DataFrame, complexity: DataFrame, metrics: DataFrame, cochange: DataFrame, scc: DataFrame) -> DataFrame:
    """metric, value of the gates: eight rows."""
    from arborlake.operators.graph import tangle
    from arborlake.operators.relational import unreferenced_exports

    cc = complexity.filter("cognitive_complexity > 0").agg(F.coalesce(round_half_up(F.avg("cognitive_complexity"), 1), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max("cognitive_complexity"), F.lit(0.0)).alias("max_complexity"))
    dead = unreferenced_exports(symbols, edges, files).agg(F.count("*").alias("dead"))
    n = symbols.agg(F.count("*").alias("symbols"))
    tests = contains_ci("path", "test") | contains_ci("path", "spec")
    f = files.agg(F.coalesce(round_half_up(F.count_if(tests) / F.count("*"), 3), F.lit(0.0)).alias("test_ratio"))
    cycles = scc.groupBy("scc_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("cycle_count"))
    god = metrics.agg(F.count_if(F.col("in_degree") + F.col("out_degree") > 20).alias("god_components"))
    one = cc.join(dead).join(n).join(f).join(cycles).join(tangle(scc).select("tangle_ratio")).join(god).join(coupling_density(cochange, files).select(F.col("density").alias("coupling_density")))
    one = one.withColumn("dead_pct", F.when(F.col("symbols") > 0, round_half_up(F.col("dead") / F.col("symbols"), 3) * 100).otherwise(0.0)).withColumn("dead_pct", round_half_up(F.col("dead_pct"), 1))
    return one.selectExpr(f"stack({len(GATES)}, " + ", ".join(f"'{k}', CAST({k} AS DOUBLE)" for k in GATES) + ") AS (metric, value)")


GATES = {
    "avg_complexity": "<=", "max_complexity": "<=", "dead_pct": "<=", "test_ratio": ">=", "cycle_count": "<=", "coupling_density": "<=", "god_components": "<=", "tangle_ratio": "<=",
}
_BASE = {"avg_complexity": 25.0, "max_complexity": 75.0, "dead_pct": 15.0, "test_ratio": 0.1, "cycle_count": 5.0, "coupling_density": 0.3, "god_components": 3.0, "tangle_ratio": 10.0}
PRESETS = {
    "default": _BASE,
    "strict": {"avg_complexity": 15.0, "max_complexity": 40.0, "dead_pct": 5.0, "test_ratio": 0.3, "cycle_count": 0.0, "coupling_density": 0.15, "god_components": 0.0, "tangle_ratio": 3.0},
    "python": _BASE | {"avg_complexity": 20.0, "dead_pct": 12.0, "test_ratio": 0.15},
    "javascript": _BASE | {"avg_complexity": 22.0, "dead_pct": 18.0, "test_ratio": 0.08, "coupling_density": 0.35},
    "go": _BASE | {"avg_complexity": 15.0, "max_complexity": 50.0, "dead_pct": 8.0, "test_ratio": 0.2, "cycle_count": 2.0},
    "java": _BASE | {"avg_complexity": 20.0, "max_complexity": 60.0, "dead_pct": 20.0, "test_ratio": 0.15, "coupling_density": 0.25},
    "rust": _BASE | {"avg_complexity": 18.0, "max_complexity": 50.0, "dead_pct": 5.0, "test_ratio": 0.2, "cycle_count": 1.0, "tangle_ratio": 2.0},
}


def gates(metrics: DataFrame, preset: str = "default", overrides: dict[str, float] | None = None) -> DataFrame:
    """metrics: metric, value. One check for each metric that has a threshold and a value. An unknown preset is the default one."""
    limits = PRESETS.get(preset, _BASE) | (overrides or {})
    t = metrics.sparkSession.createDataFrame([(k, GATES[k], float(v)) for k, v in limits.items()], "metric string, op string, threshold double")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return metrics.filter("value IS NOT NULL").join(F.broadcast(t), "metric").withColumn("passed", ok)


def file_risk(files: DataFrame, stats: DataFrame, weight: DataFrame, importers: DataFrame) -> DataFrame:
    """0.3 churn + 0.3 complexity + 0.2 coupling, each against its 90th percentile and 1 at most, + 0.2 (halved by a test)."""
    j = files.select("id", "path").join(stats.withColumnRenamed("file_id", "id"), "id", "left").join(weight.withColumnRenamed("file_id", "id"), "id", "left").join(importers.withColumnRenamed("file_id", "id"), "id", "left")
    j = j.select("id", "path", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("total_churn", "complexity", "weight", "test_importers")])
    j = Scratch(files.sparkSession, "risk").save(j, "files")
    p = j.agg(*[percentile_or_one(c, 90).alias(f"p_{c}") for c in ("total_churn", "complexity", "weight")])
    part = lambda c: F.least(F.lit(1.0), F.col(c) / F.col(f"p_{c}"))
    risk = 0.3 * part("total_churn") + 0.3 * part("complexity") + 0.2 * part("weight") + 0.2 * F.when(F.col("test_importers") > 0, 0.5).otherwise(1.0)
    j = j.join(F.broadcast(p)).withColumn("risk", round_half_up(risk, 3))
    return j.withColumn("level", F.when(F.col("risk") > 0.8, "CRITICAL").when(F.col("risk") > 0.6, "HIGH").when(F.col("risk") > 0.3, "MEDIUM").otherwise("LOW"))


def hotspots(stats: DataFrame, files: DataFrame, count: int) -> DataFrame:
    """Of the 2 count most changed files, the geometric mean of churn and complexity, each against its 75th percentile."""
    top = stats.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").orderBy(F.desc("total_churn"), "file_id").limit(2 * count)
    p = top.agg(percentile_high("total_churn", 75).alias("pa"), percentile_high("complexity", 75).alias("pb"))
    against = lambda c, q: F.col(c) / F.when(F.col(q) == 0, 1).otherwise(F.col(q))
    a, b = against("total_churn", "pa"), against("complexity", "pb")
    s = top.join(F.broadcast(p)).withColumn("score", round_half_up(F.sqrt(a * b), 3))
    s = s.withColumn("reason", F.when(a > 2 * b, "HIGH-CHURN").when(b > 2 * a, "HIGH-COMPLEXITY").otherwise("BOTH"))
    return s.select("file_id", "path", "total_churn", round_half_up(F.col("complexity"), 2).alias("complexity"), "score", "reason").orderBy(F.desc("score"), "file_id").limit(count)


def test_callers(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """id, test_callers: edges from symbols of files whose path says test or spec."""
    tests = files.filter(contains_ci("path", "test") | contains_ci("path", "spec")).select(F.col("id").alias("file_id"))
    sources = symbols.join(tests, "file_id", "left_semi").select(F.col("id").alias("source_id"))
    return edges.join(sources, "source_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("test_callers"))


def coverage_gaps(symbols: DataFrame, metrics: DataFrame, complexity: DataFrame, edges: DataFrame, files: DataFrame, limit: int = 500, threshold: float = 0.0) -> DataFrame:
    """Exported functions, classes, methods and interfaces, the first limit by PageRank; of those outside of tests, what no test refers to. The limit comes first: it is part of the report."""
    s = symbols.filter((F.col("is_exported") == 1) & F.col("kind").isin("function", "class", "method", "interface"))
    s = s.join(metrics.withColumnRenamed("symbol_id", "id").select("id", "pagerank", "in_degree"), "id", "left").join(complexity.select(F.col("symbol_id").alias("id"), "cognitive_complexity"), "id", "left")
    s = s.select("id", "name", "kind", "file_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("pagerank", "in_degree", "cognitive_complexity")])
    s = s.orderBy(F.desc("pagerank"), "id").limit(limit)
    s = s.join(files.filter(~is_test("path")).select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    untested = s.join(test_callers(symbols, edges, files), "id", "left_anti")
    one = F.lit(1.0)
    score = round_half_up(F.col("pagerank") * 10000 * F.greatest("cognitive_complexity", one) * F.greatest("in_degree", one) * 0.001) / 1000
    return untested.withColumn("score", score).filter(F.col("score") >= threshold)


def pr_facts(changed: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame, metrics: DataFrame, complexity: DataFrame, most: int = 10) -> DataFrame:
    """changed: file_id. One row: blast, breaking, untested, complex, files, for the changed files that are neither tests nor of low risk."""
    from arborlake.operators.graph import reachable, reverse

    own = files.join(changed.select(F.col("file_id").alias("id")), "id", "left_semi").filter(~is_test("path") & ~is_low_risk("path")).select(F.col("id").alias("file_id"))
    s = symbols.join(own, "file_id", "left_semi").select("id", "is_exported")
    s = s.join(metrics.select(F.col("symbol_id").alias("id"), "pagerank"), "id", "left").join(complexity.select(F.col("symbol_id").alias("id"), "cognitive_complexity"), "id", "left")
    n = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("consumers"))
    s = s.join(n, "id", "left").join(test_callers(symbols, edges, files), "id", "left")
    e = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    blast = reachable(e, s.select("id"), most).agg(F.count("*").alias("blast"))
    exported = F.col("is_exported") == 1
    counts = s.agg(
        F.count_if(exported & (F.col("consumers") > 0)).alias("breaking"),
        F.count_if(exported & F.col("test_callers").isNull() & (F.col("pagerank") > 0)).alias("untested"), F.count_if(F.col("cognitive_complexity") > 10).alias("complex"),
    )
    return blast.join(counts).join(own.agg(F.count("*").alias("files")))


def pr_risk(v: DataFrame) -> DataFrame:
    """v: blast, breaking, untested, complex, files."""
    cap = lambda c, top: F.least(F.col(c) / top, F.lit(1.0))
    s = 0.3 * cap("blast", 50) + 0.25 * cap("breaking", 10) + 0.2 * cap("untested", 10) + 0.15 * cap("complex", 5) + F.when(F.col("files") > 10, 0.1).otherwise(F.col("files") / 100)
    v = v.withColumn("risk", round_half_up(s, 3))
    return v.withColumn("level", F.when(F.col("risk") > 0.7, "CRITICAL").when(F.col("risk") > 0.5, "HIGH").when(F.col("risk") > 0.25, "MEDIUM").otherwise("LOW"))


def dead_confidence(dead: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """100 for a name that is nobody else's, 70 if a symbol of the same name is referred to."""
    used = edges.select(F.col("target_id").alias("id")).distinct().join(symbols.select("id", "name"), "id").select("name").distinct().withColumn("used", F.lit(1))
    return dead.join(used, "name", "left").withColumn("confidence", F.when(F.col("used") == 1, 70).otherwise(100)).drop("used")


def dead_decay(dead: DataFrame, ages: DataFrame) -> DataFrame:
    """dead: line_start, line_end, file_id, confidence; ages: file_id, age_days. Hours to remove, and decay."""
    lines = F.col("line_end") - F.col("line_start") + 1
    j = dead.join(ages, "file_id", "left").withColumn("lines", lines)
    age = F.coalesce("age_days", F.lit(0))
    return j.withColumn("effort", F.greatest(F.lit(1), round_half_up(0.5 * F.col("lines"))).cast("long")).withColumn("decay", round_half_up(age / 365 * F.col("lines") * F.col("confidence") / 100, 1))


def blast_class(n: Column) -> Column:
    return F.when(n >= 50, "CRITICAL").when(n >= 20, "HIGH").when(n >= 5, "MEDIUM").when(n >= 1, "LOW").otherwise("OK")


def breaking_class(n: Column) -> Column:
    return F.when(n > 10, "BREAKING").when(n > 3, "WARNING").otherwise("INFO")


def fan(symbols: DataFrame, limit: int, least: int = 1) -> DataFrame:
    """symbols with degrees. Flags by degree, most connected first."""
    i, o = F.col("in_degree"), F.col("out_degree")
    flags = F.array_compact(F.array(F.when(o > 15, "God-object"), F.when(i > 20, "High-impact"), F.when((i > 10) & (o > 10), "Hub")))
    return symbols.filter(i + o >= least).withColumn("flags", F.array_join(flags, ", ")).orderBy((i + o).desc(), "id").limit(limit)


def coupling_density(pairs: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    n = files.agg(F.count("*").alias("n"))
    k = pairs.filter(F.col("cochange_count") >= least).agg(F.count("*").alias("pairs"))
    return k.join(F.broadcast(n)).select("pairs", "n", round_half_up(F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0), 3).alias("density"))


def breaking(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Exports of changed files (file_id) that anything refers to, with a class by how many edges."""
    s = symbols.filter("is_exported = 1").join(changed.select("file_id"), "file_id", "left_semi").select("id", "name", "kind", "file_id")
    n = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("consumers"))
    return s.join(n, "id").withColumn("severity", breaking_class(F.col("consumers")))


def affected_tests(edges: DataFrame, symbols: DataFrame, files: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """Test files by the best evidence: refers directly (1), transitively (2), or lies in the same folder (3); with the real depth."""
    from arborlake.functions.strings import dirname
    from arborlake.operators.graph import reachable, reverse

    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    r = reachable(reverse(e), starts, most).join(symbols.select("id", "file_id"), "id").groupBy("file_id").agg(F.min("depth").alias("depth"))
    tests = files.filter("file_role = 'test'").select(F.col("id").alias("file_id"), "path", dirname("path").alias("dir"))
    near = tests.join(r, "file_id").select("file_id", "path", "depth", F.when(F.col("depth") == 1, 1).otherwise(2).alias("rank"))
    dirs = symbols.join(starts.select("id"), "id", "left_semi").join(files.select(F.col("id").alias("file_id"), dirname("path").alias("dir")), "file_id").select("dir").distinct()
    beside = tests.join(dirs, "dir", "left_semi").select("file_id", "path", F.lit(0).alias("depth"), F.lit(3).alias("rank"))
    best = near.unionByName(beside).groupBy("file_id", "path").agg(F.min(F.struct("rank", "depth")).alias("x"))
    return best.select("file_id", "path", F.element_at(F.array(F.lit("direct"), F.lit("transitive"), F.lit("colocated")), F.col("x.rank")).alias("evidence"), F.col("x.depth").alias("depth"))
