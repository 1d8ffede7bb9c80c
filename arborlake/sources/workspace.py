"""Several projects as one: a JSON file of aliases and paths, and the union of their files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.sources.repo import git_log, read_files

FILE = ".arborlake/workspace.json"


def load(root: str) -> dict:
    path = os.path.join(root, FILE)
    if not os.path.exists(path):
        return {"repos": []}
    with open(path) as f:
        return json.load(f)


def save(root: str, config: dict) -> None:
    path = os.path.join(root, FILE)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(config, f, indent=2)


def init(root: str) -> dict:
    config = load(root)
    save(root, config)
    return config


def add(root: str, alias: str, path: str) -> dict:
    config = load(root)
    if any(r["alias"] == alias for r in config["repos"]):
        raise ValueError(f"alias {alias!r} exists already")
    config["repos"].append({"alias": alias, "path": path})
    save(root, config)
    return config


def remove(root: str, alias: str) -> dict:
    config = load(root)
    left = [r for r in config["repos"] if r["alias"] != alias]
    if len(left) == len(config["repos"]):
        raise ValueError(f"no alias {alias!r}")
    config["repos"] = left
    save(root, config)
    return config


def resolve(root: str, config: dict) -> list[dict]:
    """Absolute paths, with whether each exists and has a history."""
    out = []
    for r in config["repos"]:
        path = os.path.normpath(os.path.join(root, r["path"]))
        out.append(r | {"path": path, "exists": os.path.isdir(path), "has_git": os.path.exists(os.path.join(path, ".git"))})
    return out


def read(spark: SparkSession, root: str) -> DataFrame:
    """The files of all projects, paths under their alias, ids in order of path."""
    parts = [read_files(spark, r["path"]).drop("id").withColumn("path", F.concat(F.lit(r["alias"] + "/"), "path")) for r in resolve(root, load(root)) if r["exists"]]
    if not parts:
        raise ValueError("the workspace has no project that exists")
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.withColumn("id", F.xxhash64("path"))


def read_history(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Commits and changes of all projects that have a history, paths under their alias, hashes too, as projects may share commits."""
    commits = changes = None
    for r in resolve(root, load(root)):
        if r["exists"]:
            own = [df.withColumn("hash", F.concat(F.lit(r["alias"] + ":"), "hash")) for df in git_log(spark, r["path"])]
            own[1] = own[1].withColumn("path", F.concat(F.lit(r["alias"] + "/"), "path"))
            commits, changes = own if commits is None else (commits.unionByName(own[0]), changes.unionByName(own[1]))
    return commits, changes
