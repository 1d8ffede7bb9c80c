"""From a source tree to the canonical tables, and the store that keeps them."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import extract as ex
from arborlake.operators import complexity, graph, incremental, relational, resolve, temporal
from arborlake.session import Scratch
from arborlake.sources import repo


@dataclass
class Store:
    """Canonical tables by name, as parquet below a folder. A table is written beside its last version, so that what replaces it may read it."""

    spark: SparkSession
    at: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def _versions(self, name: str) -> list[str]:
        folder = os.path.join(self.at, name)
        return sorted(v for v in (os.listdir(folder) if os.path.isdir(folder) else ()) if os.path.exists(os.path.join(folder, v, "_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._versions("files"))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        before = self._versions(name)
        version = f"v{int(before[-1][1:]) + 1 if before else 1:06d}"
        path = os.path.join(self.at, name, version)
        df.write.mode("overwrite").parquet(path)
        for old in before[:-1]:  # the last stays, as tables not yet written may read it
            shutil.rmtree(os.path.join(self.at, name, old))
        self.tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[name]

    def get(self, name: str) -> DataFrame:
        if name not in self.tables:
            versions = self._versions(name)
            if not versions:
                raise FileNotFoundError(f"no table {name} in {self.at}: run index first")
            self.tables[name] = self.spark.read.parquet(os.path.join(self.at, name, versions[-1]))
        return self.tables[name]


def build(spark: SparkSession, root: str, at: str, full: bool = False, **options) -> Store:
    """Index a project: files, symbols, references, edges, metrics, communities and history. Where a store exists, only files that changed are read anew, unless full."""
    return build_from(spark, repo.read_files(spark, root), at, *repo.git_log(spark, root), full=full, **options)


def _unchanged(s: Store, files: DataFrame) -> DataFrame | None:
    """path of the stored files that are as they were; None if nothing changed at all."""
    changed = incremental.changed_files(files.select("path", "hash", "mtime"), s.get("files").select("path", "hash", "mtime"))
    changed = Scratch(s.spark, "changed").save(changed, "changed")
    return None if changed.isEmpty() else s.get("files").select("path").join(changed.select("path"), "path", "left_anti")


def build_from(spark: SparkSession, files: DataFrame, at: str, commits: DataFrame | None = None, changes: DataFrame | None = None, full: bool = True, sources: int | None = None, communities: str = "louvain") -> Store:
    """files: id, path, language, file_role, hash, mtime, line_count, text.

    sources: from how many symbols betweenness is estimated (exact without). communities: louvain, or labels for graphs too large for one task."""
    s = Store(spark, at)
    same = None
    if not full and s.exists():
        same = _unchanged(s, files)
        if same is None:
            _history(s, commits, changes)
            return s
    if same is None:
        texts = s.put("texts", files)
        found = s.put("found", ex.extract(texts.withColumnRenamed("text", "content")))
    else:  # rows of the files that stay are carried over; the others are read and extracted
        fresh = files.join(same, "path", "left_anti")
        texts = s.put("texts", s.get("texts").join(same, "path", "left_semi").select(*files.columns).unionByName(fresh))
        again = texts.join(same, "path", "left_anti").withColumnRenamed("text", "content")
        found = s.put("found", s.get("found").join(same, "path", "left_semi").unionByName(ex.extract(again)))
    files = s.put("files", texts.drop("text"))

    raw = ex.symbols_of(found).join(files.select("path", F.col("id").alias("file_id")), "path")
    numbered = raw.withColumn("id", F.xxhash64("path", "line_start", "qualified_name", "kind")).dropDuplicates(["id"])
    up = numbered.groupBy("file_id", F.col("qualified_name").alias("parent")).agg(F.min_by("id", F.struct("line_start", "id")).alias("parent_id"))
    symbols = s.put("symbols", numbered.join(up, ["file_id", "parent"], "left").select("id", "file_id", "name", "qualified_name", "kind", "signature", "line_start", "line_end", "docstring", "visibility", "is_exported", "parent_id", "default_value"))

    refs = ex.references_of(found)
    refs = refs.withColumn("ref", F.xxhash64(*[c for c in ("source_file", "line", "kind", "target_name", "source_name") if c in refs.columns]))
    edges = s.put("edges", resolve.resolve(s.put("references", refs), symbols, files).withColumn("id", F.xxhash64("source_id", "target_id", "kind")))
    s.put("file_edges", relational.file_edges(edges, symbols))

    e, v = graph.simple(graph.from_symbols(edges, symbols)).select("src", "dst"), symbols.select("id")
    scc = s.put("scc", graph.strong_components(e, v))
    s.put("layers", graph.layers(e, scc))
    alpha = graph.tangle(scc).first()
    rank = graph.pagerank(e, v, alpha.alpha if alpha and alpha.alpha else 0.85)
    metrics = rank.join(graph.degrees(e, v), "id").join(graph.betweenness(e, v, sources), "id").select(F.col("id").alias("symbol_id"), F.col("rank").alias("pagerank"), "in_degree", "out_degree", "betweenness")
    metrics = s.put("graph_metrics", metrics)
    clusters = {"louvain": graph.louvain, "labels": graph.label_propagation}[communities](e, v)
    labels = graph.cluster_labels(clusters, symbols, files, metrics).select("cluster_id", F.col("label").alias("cluster_label"))
    s.put("clusters", clusters.join(labels, "cluster_id", "left").select(F.col("id").alias("symbol_id"), "cluster_id", "cluster_label"))

    python = complexity.python_metrics(texts.filter("language = 'python'").select("path", F.col("text").alias("content")))
    exact = complexity.match_functions(python, symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")).select("symbol_id", *[c for c in python.columns if c not in ("path", "name", "line_start")])
    callable_ = symbols.filter(F.col("kind").isin("function", "method", "constructor", "trigger"))
    bodies = callable_.join(texts.select(F.col("id").alias("file_id"), "text"), "file_id").select("id", F.array_join(F.slice(F.split("text", "\n", -1), F.col("line_start").cast("int"), F.greatest(F.lit(1), F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n").alias("text"))
    rough = complexity.text_complexity(bodies).select(F.col("id").alias("symbol_id"), F.col("cognitive").alias("cognitive_complexity"), F.col("depth").alias("nesting_depth"), F.col("lines").alias("line_count"), F.col("returns").alias("return_count"), F.col("bool_ops").alias("bool_op_count"), F.col("density").alias("cyclomatic_density"))
    exact = exact.dropDuplicates(["symbol_id"])
    s.put("symbol_metrics", exact.unionByName(rough.join(exact.select("symbol_id"), "symbol_id", "left_anti"), allowMissingColumns=True))

    _history(s, commits, changes)
    return s


def _history(s: Store, commits: DataFrame | None, changes: DataFrame | None) -> None:
    if commits is None:
        return
    files, texts = s.get("files"), s.get("texts")
    commits = s.put("git_commits", commits.withColumn("id", F.xxhash64("hash")))
    changes = changes.withColumn("commit_id", F.xxhash64("hash")).join(files.select("path", F.col("id").alias("file_id")), "path", "left")
    changes = s.put("git_file_changes", changes.select("commit_id", "file_id", "path", "lines_added", "lines_removed"))
    pairs = s.put("git_cochange", temporal.cochange(changes))
    s.put("git_hyperedges", temporal.hyperedges(changes))
    indent = complexity.indent_complexity(texts.select("id", "text")).withColumnRenamed("id", "file_id")
    stats = temporal.file_stats(commits, changes.filter("file_id IS NOT NULL"))
    s.put("file_stats", files.select(F.col("id").alias("file_id")).join(stats, "file_id", "left").join(indent, "file_id", "left").join(temporal.entropy(pairs).withColumnRenamed("entropy", "cochange_entropy"), "file_id", "left").na.fill(0))
