"""Incremental refresh: change sets, cascades and upserts over parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.ranking import first_per_key


def changed_files(now: DataFrame, stored: DataFrame, within: float = 0.001) -> DataFrame:
    """now, stored: path, hash, mtime. path, change: added, removed or modified. Equal times (within so many seconds) spare the hash."""
    b = stored.select(F.col("path").alias("b_path"), F.col("hash").alias("b_hash"), F.col("mtime").alias("b_mtime"))
    j = now.join(b, F.col("path") == F.col("b_path"), "full_outer")
    change = F.when(F.col("b_path").isNull(), "added").when(F.col("path").isNull(), "removed").when((F.abs(F.col("mtime") - F.col("b_mtime")) >= within) & ~F.col("hash").eqNullSafe(F.col("b_hash")), "modified")
    return j.select(F.coalesce("path", "b_path").alias("path"), change.alias("change")).filter("change IS NOT NULL")


def added(now: DataFrame, stored: DataFrame) -> DataFrame:
    return now.select("path").join(stored.select("path"), "path", "left_anti")


def kept(now: DataFrame, stored: DataFrame) -> DataFrame:
    return now.select("path").intersect(stored.select("path"))


def cascade(tables: dict[str, tuple[DataFrame, list[str]]], removed: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose key columns name a removed id (id)."""
    gone = removed.select("id").distinct()
    out = {}
    for name, (df, keys) in tables.items():
        for k in keys:
            df = df.join(gone.withColumnRenamed("id", k), k, "left_anti").select(*df.columns)
        out[name] = df
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old by key; columns that either lacks are null."""
    both = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, keys, [F.asc("_age")]).drop("_age")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it hasn't, once each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*new.columns), allowMissingColumns=True)


def update_or_insert(stats: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Sets column where values has the key, and adds the keys that stats lacks; other columns stay."""
    v = values.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    j = stats.join(v, F.col(key) == F.col("_key"), "full_outer")
    return j.select(*[F.coalesce(F.col(c), F.col("_key")).alias(c) if c == key else F.coalesce("_new", c).alias(c) if c == column else F.col(c) for c in stats.columns])


def append_snapshot(history: DataFrame, metrics: DataFrame) -> DataFrame:
    """metrics: one row; keys that history has no column for go to extra_json."""
    known = [c for c in metrics.columns if c in history.columns]
    extra = [c for c in metrics.columns if c not in history.columns]
    row = metrics.select(*known, (F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")).alias("extra_json"))
    return history.unionByName(row, allowMissingColumns=True)


def read_history(history: DataFrame, limit: int = 50, since: int | None = None) -> DataFrame:
    """Newest first, extra_json as a map."""
    h = history if since is None else history.filter(F.col("timestamp") >= since)
    return h.withColumn("extra", F.from_json("extra_json", "map<string,string>")).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def part_sizes(lineitem: DataFrame) -> DataFrame:
    """How many suppliers are in both of two position sets, and how many parts only in the first."""
    at = lambda c, n: lineitem.filter(F.col("l_linenumber") == n).select(c)
    both = at("l_suppkey", 1).intersect(at("l_suppkey", 7)).agg(F.lit("both").alias("part"), F.count("*").alias("n"))
    return both.unionByName(at("l_partkey", 1).subtract(at("l_partkey", 7)).agg(F.lit("first").alias("part"), F.count("*").alias("n")))
