"""References to symbols: candidates by tier, ranked by nearness; the first of each reference wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions.strings import dirname, import_path
from arborlake.operators.ranking import first_per_key


def scope(qualified: Column | str) -> Column:
    """A qualified name without its last :: or . segment."""
    q = F.col(qualified) if isinstance(qualified, str) else qualified
    return F.regexp_extract(q, r"^(.*)(?:::|\.)[^.:]+$", 1)


def matches_import(path: Column, imported: Column) -> Column:
    """An import's path names a file or its folder."""
    p, i = import_path(path), import_path(F.regexp_replace(imported, r"(?<=\w)\.(?=\w)", "/"))
    return (F.length(i) > 0) & (p.endswith(i) | F.concat(F.lit("/"), p).contains(F.concat(F.lit("/"), i, F.lit("/"))))


def closest_symbol(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs: file_id, line. file_id, line, symbol_id of each place: the innermost symbol that spans the line, else the file's first."""
    s = symbols.select("file_id", F.col("id").alias("symbol_id"), "line_start", "line_end")
    inside = F.col("line").between(F.col("line_start"), F.col("line_end"))
    order = F.struct(F.when(inside, 0).otherwise(1).alias("a"), F.when(inside, -F.col("line_start")).otherwise(F.col("line_start")).alias("b"), "symbol_id")
    best = refs.select("file_id", "line").distinct().join(s, "file_id").groupBy("file_id", "line").agg(F.min(order).alias("x"))
    return best.select("file_id", "line", F.col("x.symbol_id").alias("symbol_id"))


def _sources(r: DataFrame, symbols: DataFrame) -> DataFrame:
    """r with source_id: the symbol of source_name in ref_file (by qualified name first), else the closest; rows without one go."""
    own = symbols.select(F.col("file_id").alias("ref_file"), "id", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("qualified_name").alias("source_name")), F.struct(F.lit(1).alias("rank"), F.col("name").alias("source_name")))).alias("k"))
    named = own.groupBy("ref_file", F.col("k.source_name").alias("source_name")).agg(F.min(F.struct("k.rank", "id")).alias("x")).select("ref_file", "source_name", F.col("x.id").alias("by_name"))
    close = closest_symbol(r.select(F.col("ref_file").alias("file_id"), "line"), symbols).select(F.col("file_id").alias("ref_file"), "line", F.col("symbol_id").alias("by_line"))
    found = r.join(named, ["ref_file", "source_name"], "left").join(close, ["ref_file", "line"], "left")
    return found.withColumn("source_id", F.coalesce("by_name", "by_line")).filter("source_id IS NOT NULL").drop("by_name", "by_line")


def resolve(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """refs: ref (ordinal), source_name, target_name, kind, line, import_path, source_file. Edges: source_id, target_id, kind, line.

    The source is the symbol of that name in the file, else the closest; the target is the best candidate: a unique
    qualified match, then by name, then by name whatever its case; among those, a capitalised call prefers a class, then
    the same file (same parent scope first), the same folder, the imported path, exported ones, the first.
    Self references go; of equal edges the first stays.

    A name may have very many symbols and very many references, so the two never meet: of the symbols of each name, of each
    name in each file, scope and folder, the best is found beforehand, and a reference looks each up by key. Only import
    paths, each once for a name, are held against the symbols of that name."""
    f = files.select(F.col("id").alias("file_id"), "path")
    r = refs.join(f.select(F.col("file_id").alias("ref_file"), F.col("path").alias("source_file")), "source_file")
    src = _sources(r, symbols).join(symbols.select(F.col("id").alias("source_id"), scope("qualified_name").alias("source_scope")), "source_id")
    capital = (F.col("kind") == "call") & F.col("target_name").rlike("^[A-Z]")
    src = src.withColumns({"capital": capital, "source_dir": dirname("source_file"), "import_path": F.coalesce("import_path", F.lit(""))})

    names = F.array(*[F.struct(F.lit(tier).alias("tier"), key.alias("key")) for tier, key in ((1, F.col("qualified_name")), (2, F.col("name")), (3, F.lower("name")))])
    t = symbols.join(f, "file_id").select("id", "is_exported", F.col("kind").isin("class", "struct", "interface").alias("type"), F.col("file_id").alias("t_file"), F.col("path").alias("t_path"), dirname("path").alias("t_dir"), scope("qualified_name").alias("t_scope"), F.explode(names).alias("k"))
    t = t.select("*", "k.tier", "k.key").drop("k")
    rank = F.struct((-F.col("is_exported")).alias("e"), "id")

    def best(rows: DataFrame, level: str, *keys: str) -> DataFrame:
        return rows.groupBy("tier", "key", *keys).agg(F.min(F.when(F.col("type"), rank)).alias(f"{level}_type"), F.min(rank).alias(f"{level}_any"))

    every = best(t, "every")
    for tier, key in ((1, F.col("target_name")), (2, F.col("target_name")), (3, F.lower("target_name"))):
        there = every.filter(F.col("tier") == tier).select(F.col("key").alias(f"key_{tier}"), F.lit(True).alias(f"in_{tier}"))
        src = src.join(there, key == F.col(f"key_{tier}"), "left")
    src = src.withColumn("tier", F.when(F.col("in_1"), 1).when(F.col("in_2"), 2).when(F.col("in_3"), 3)).withColumn("key", F.coalesce("key_1", "key_2", "key_3")).filter("tier IS NOT NULL").drop(*[f"{c}_{k}" for c in ("key", "in") for k in (1, 2, 3)])

    named = {"t_file": "ref_file", "t_scope": "source_scope", "t_dir": "source_dir", "import_path": "import_path"}
    asked = src.filter("import_path <> ''").select("tier", "key", "import_path").distinct()
    imported = t.join(asked, ["tier", "key"]).filter(matches_import(F.col("t_path"), F.col("import_path")))
    levels = [("scope", t.filter("t_scope <> ''"), ["t_file", "t_scope"]), ("file", t, ["t_file"]), ("near", imported, ["import_path", "t_dir"]), ("dir", t, ["t_dir"]), ("imported", imported, ["import_path"]), ("every", t, [])]
    for level, rows, keys in levels:
        found = best(rows, level, *keys)
        for k in keys:
            found = found.withColumnRenamed(k, named[k])
        src = src.join(found, ["tier", "key", *[named[k] for k in keys]], "left")
    types, any_ = ([F.col(f"{level}_{which}") for level, *_ in levels] for which in ("type", "any"))
    chosen = F.coalesce(F.when(F.col("capital"), F.coalesce(*types)), *any_)
    found = src.withColumn("target_id", chosen["id"]).filter("source_id <> target_id")
    return first_per_key(found, ["source_id", "target_id", "kind"], [F.asc("line"), F.asc("ref")]).select("source_id", "target_id", "kind", "line")


def nearest_homonym(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """refs: ref, file_id, target_name. The symbol of that name in the same file, else folder, else exported, else first.

    As in resolve, a name's references and its symbols never meet: the best symbol of each name, and of each name in each
    file and folder, is found beforehand, and each name that a file refers to looks them up by key."""
    f = files.select(F.col("id").alias("file_id"), dirname("path").alias("dir"))
    s = symbols.join(f, "file_id").select("id", "file_id", F.col("name").alias("target_name"), "dir", (-F.col("is_exported")).alias("hidden"))
    asked = refs.select("file_id", "target_name").distinct().join(f, "file_id")
    for level, keys in (("in_file", ["target_name", "file_id"]), ("in_dir", ["target_name", "dir"]), ("any", ["target_name"])):
        best = s.groupBy(*keys).agg(F.min(F.struct("hidden", "id")).alias(level))
        asked = asked.join(best, keys, "inner" if level == "any" else "left")
    found = asked.select("file_id", "target_name", F.coalesce("in_file", "in_dir", "any")["id"].alias("target_id"))
    return refs.join(found, ["file_id", "target_name"]).select("ref", "file_id", "target_name", "target_id")


_TEMPLATE = r"(?s)<template[^>]*>(.*)</template>"
_BINDING = r"""\{\{\s*([A-Za-z_$][\w$]*)|[:@](?:[\w.-]+)="\s*([A-Za-z_$][\w$]*)|<([A-Z][A-Za-z0-9]*)[\s/>]"""


def template_refs(files: DataFrame) -> DataFrame:
    """files: path, content. Names that a template uses: in {{ }}, bindings, handlers and component tags; the first of each name, with its ordinal.

    Rows of one path are one file: a name is listed once for the path, where it comes first in any of them; ties in order of names."""
    body = F.regexp_extract("content", _TEMPLATE, 1)
    names = F.filter(F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(_BINDING), F.lit(k)) for k in (1, 2, 3)])), lambda x: x != "")
    first = files.select("path", F.posexplode(F.array_distinct(names)).alias("at", "target_name")).groupBy("path", "target_name").agg(F.min("at").alias("at"))
    ordinal = F.row_number().over(W.partitionBy("path").orderBy("at", "target_name")) - 1
    return first.select("path", ordinal.alias("ordinal"), "target_name").withColumn("kind", F.lit("template"))
