"""Version history: co-change, entropy, hyperedges, file statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.strings import round_half_up, signature_hash

MIN_SET, MAX_SET = 2, 100


def commit_files(changes: DataFrame, least: int = MIN_SET, most: int = MAX_SET) -> DataFrame:
    """Distinct files of each commit that has least to most of them. Larger commits say nothing of coupling, by definition; so no pair explosion can start here."""
    d = changes.filter("file_id IS NOT NULL").select("commit_id", "file_id").distinct()
    n = d.groupBy("commit_id").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    return d.join(n.select("commit_id"), "commit_id", "left_semi")


#: Bytes of changes for a task, as the plan estimates them.
TASK_BYTES = 2 << 20


def tasks_for(df: DataFrame) -> int:
    """Tasks that keep each one's share of df the same at any size; the session's number where the plan knows no size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size >= 1 << 50 else max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def cochange(changes: DataFrame, least: int = MIN_SET, most: int = MAX_SET) -> DataFrame:
    """Unordered pairs of files and the commits that they share. A commit is one row with at most ``most`` files; its pairs are made in place.

    Changes are spread by commit once, over tasks in number with the input, so that a task's memory does not grow with it."""
    changes = changes.select("commit_id", "file_id")
    changes = changes.repartition(tasks_for(changes), "commit_id")
    sets = changes.filter("file_id IS NOT NULL").groupBy("commit_id").agg(F.count_distinct("file_id").alias("n")).filter(F.col("n").between(least, most))
    files = changes.join(sets.select("commit_id"), "commit_id", "left_semi").groupBy("commit_id").agg(F.sort_array(F.collect_set("file_id")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.lit(most)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return files.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("file_id_a"), F.col("p.b").alias("file_id_b")).agg(F.count("*").alias("cochange_count"))


def both_ways(pairs: DataFrame) -> DataFrame:
    a, b = F.col("file_id_a"), F.col("file_id_b")
    return pairs.select(a.alias("file_id"), b.alias("partner"), F.col("cochange_count").alias("n")).unionByName(pairs.select(b.alias("file_id"), a.alias("partner"), F.col("cochange_count").alias("n")))


def entropy(pairs: DataFrame) -> DataFrame:
    """Rényi-2 entropy of a file's co-changes over the most it could be; a single partner: 0."""
    g = both_ways(pairs).groupBy("file_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"), F.count("*").alias("k"))
    h = -F.log2(F.col("s") / (F.col("t") * F.col("t"))) / F.log2("k")
    return g.select("file_id", F.when(F.col("k") <= 1, 0.0).otherwise(round_half_up(h, 4)).alias("entropy"))


def hyperedges(changes: DataFrame) -> DataFrame:
    """commit, number of files, signature of the sorted set."""
    g = commit_files(changes).groupBy("commit_id").agg(F.sort_array(F.collect_set("file_id")).alias("files"))
    return g.select("commit_id", F.size("files").cast("long").alias("file_count"), signature_hash(F.col("files")).alias("sig_hash"), "files")


def hyperedge_members(edges: DataFrame) -> DataFrame:
    return edges.select("commit_id", F.posexplode("files").alias("ordinal", "file_id"))


def file_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    j = changes.join(commits.select(F.col("id").alias("commit_id"), "author"), "commit_id")
    return j.groupBy("file_id").agg(F.count_distinct("commit_id").alias("commit_count"), F.sum(F.col("lines_added") + F.col("lines_removed")).alias("total_churn"), F.count_distinct("author").alias("distinct_authors"))


def coupling(pairs: DataFrame, files: DataFrame, least: int, limit: int) -> DataFrame:
    """Pairs with paths and a class, most coupled first."""
    f = files.select("id", "path")
    j = pairs.filter(F.col("cochange_count") >= least).join(f.select(F.col("id").alias("file_id_a"), F.col("path").alias("path_a")), "file_id_a").join(f.select(F.col("id").alias("file_id_b"), F.col("path").alias("path_b")), "file_id_b")
    c = F.col("cochange_count")
    return j.withColumn("class", F.when(c > 10, "tight").when(c > 5, "moderate").otherwise("loose")).orderBy(F.desc("cochange_count"), "file_id_a", "file_id_b").limit(limit)


def strength(pairs: DataFrame, file_id: int) -> DataFrame:
    n = F.col("n")
    return both_ways(pairs).filter(F.col("file_id") == file_id).select("partner", "n", F.when(n >= 10, "high").when(n >= 3, "medium").otherwise("low").alias("strength"))


def symmetric_weight(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy("file_id").agg(F.sum("n").alias("weight"), F.count("*").alias("partners"))


def first_seen(commits: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(commits.select(F.col("id").alias("commit_id"), "timestamp"), "commit_id").groupBy("file_id").agg(F.min("timestamp").alias("first_ts"))


def age_days(commits: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    return first_seen(commits, changes).select("file_id", F.floor((F.lit(now) - F.col("first_ts")) / 86400).cast("long").alias("age_days"))


def blame(commits: DataFrame, changes: DataFrame, file_id: int) -> DataFrame:
    return changes.filter(F.col("file_id") == file_id).join(commits.select(F.col("id").alias("commit_id"), "author", "timestamp", "message"), "commit_id")
