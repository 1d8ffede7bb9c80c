"""A source tree as DataFrames: listing, filters, texts, hashes, and its version history.

The tree of one project is listed on the driver (its git client answers there); trees that lie in
shared storage are scanned by Spark.
"""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions.classify import language, role
from arborlake.functions.strings import basename, extname

SKIP_DIRS = {"node_modules", ".git", "__pycache__", "dist", "build", "target", "vendor", ".venv", "venv", ".tox", ".mypy_cache", ".idea", ".vscode", "coverage", ".next", "out"}
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "gemfile.lock", "composer.lock", "go.sum", "pipfile.lock"]
BINARY = ["." + x for x in "png jpg jpeg gif bmp ico svg webp mp3 mp4 avi mov wav ogg flac zip gz tar bz2 xz 7z rar jar war class pyc pyo so dll dylib exe bin o a lib pdf doc docx xls xlsx ppt pptx woff woff2 ttf eot otf db sqlite sqlite3 wasm node parquet".split()]
MAX_BYTES, MAX_COMMITS = 1_000_000, 5000


def find_root(start: str) -> str:
    """The nearest folder upwards that has .git; else start."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return os.path.abspath(start)
        at = up


def _git(root: str, *args: str, timeout: int = 120) -> str | None:
    try:
        r = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return r.stdout.decode("utf-8", "replace")


def git_files(root: str) -> list[str] | None:
    out = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard", timeout=30)
    return None if out is None else [x for x in out.split("\0") if x]


def walk(root: str) -> list[str]:
    out = []
    for at, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIP_DIRS and not d.startswith("."))
        out += [os.path.relpath(os.path.join(at, f), root) for f in files]
    return out


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime of the files worth reading, in order: what git lists, else a walk; pruned folders count in both."""
    listed = git_files(root)
    rows = []
    for p in sorted({x.replace("\\", "/") for x in (walk(root) if listed is None else listed)}):
        try:
            s = os.stat(os.path.join(root, p))
        except OSError:
            continue
        rows.append((p, s.st_size, s.st_mtime))
    return keep_sources(spark.createDataFrame(rows, "path string, size long, mtime double"))


def keep_sources(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Without lock files, binaries, minified files, files that are too large, and pruned folders."""
    low = F.lower("path")
    pruned = "(^|/)(" + "|".join(re.escape(d) for d in sorted(SKIP_DIRS)) + ")/"
    return files.filter(~F.lower(basename("path")).isin(LOCK_FILES) & ~F.lower(extname("path")).isin(BINARY) & ~low.rlike(r"\.min\.(js|css)$") & (F.col("size") <= most) & ~F.col("path").rlike(pruned))


def scan_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime, content of all files below a folder of shared storage, read by the executors; filters reach the listing."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.col("path"), "^file:(//)?", "")
    root = path.removeprefix("file://").rstrip("/") + "/"
    return b.select(F.replace(rel, F.lit(root), F.lit("")).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"), "content")


def decode(content: Column) -> Column:
    """UTF-8, else latin-1."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """The canonical file rows with their text: an id from the path, language, role, sha-256, lines."""
    found = keep_sources(scan_tree(spark, root)).withColumn("text", decode(F.col("content")))
    listed = git_files(root)
    if listed is not None:
        found = found.join(spark.createDataFrame([(p,) for p in listed], "path string"), "path", "left_semi")
    return found.select(F.xxhash64("path").alias("id"), "path", language("path").alias("language"), role(F.col("path"), F.col("text")).alias("file_role"), F.sha2("content", 256).alias("hash"), "mtime", F.size(F.split("text", "\n", -1)).cast("long").alias("line_count"), "text")


def git_log(spark: SparkSession, root: str, most: int = MAX_COMMITS) -> tuple[DataFrame, DataFrame]:
    """Commits and changes of a repository; empty tables where there is none."""
    text = _git(root, "log", f"-{most}", "--numstat", "--no-merges", "--format=COMMIT:%H|%an|%at|%s") or ""
    return parse_log(spark.createDataFrame(list(enumerate(text.split("\n"))), "n long, line string"))


def parse_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines: n, line. A header is carried to the lines after it; a subject may hold the separator; binary counts are 0; a rename is its new path.

    The running window covers one log. For several, give lines a column log, which then partitions it."""
    head = F.when(F.col("line").startswith("COMMIT:"), F.substring("line", 8, 1_000_000))
    part = [F.col("log")] if "log" in lines.columns else [F.lit(0)]
    l = lines.withColumn("head", F.last(head, ignorenulls=True).over(W.partitionBy(*part).orderBy("n").rowsBetween(W.unboundedPreceding, 0)))  # noqa: E741
    f = F.split("head", r"\|", 4)
    l = l.filter("head IS NOT NULL").select("n", "line", f[0].alias("hash"), f[1].alias("author"), f[2].cast("long").alias("timestamp"), F.coalesce(F.get(f, F.lit(3)), F.lit("")).alias("message"))  # noqa: E741
    commits = l.filter(F.col("line").startswith("COMMIT:")).select("hash", "author", "timestamp", "message").dropDuplicates(["hash"])
    c = F.split("line", "\t", 3)
    changes = l.filter(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.")).select("hash", F.coalesce(c[0].try_cast("long"), F.lit(0)).alias("lines_added"), F.coalesce(c[1].try_cast("long"), F.lit(0)).alias("lines_removed"), new_path(c[2]).alias("path"))
    return commits, changes


def new_path(path):
    """The path after a rename: a/{b => c}/d or a => b."""
    p = F.regexp_replace(F.regexp_replace(path, r"\{[^}]*? => ([^}]*)\}", "$1"), r"^.* => ", "")
    return F.regexp_replace(p, "//", "/")


def changed_paths(root: str, staged: bool = False, commit_range: str | None = None, base: str | None = None) -> list[str]:
    """What a diff touches: a range, against a base, staged, or the working tree; nothing if git fails."""
    spec = [commit_range] if commit_range else [f"{base}...HEAD"] if base else ["--cached"] if staged else ["HEAD"]
    out = _git(root, "diff", "--name-only", "-z", *spec)
    if out is None and not (commit_range or base or staged):
        out = _git(root, "diff", "--name-only", "-z")
    return [x for x in (out or "").split("\0") if x]
