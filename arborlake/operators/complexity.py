"""Code metrics from text: pure column expressions where that is enough, an AST for Python.

Cognitive complexity of a Python function adds, for each control-flow node at nesting d, 1 + d(d+1)/2; continuations,
jumps and boolean operators add 1 each.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.strings import round_half_up

_BOOL, _RETURN = r"\b(and|or)\b|&&|[|][|]", r"\breturn\b"


def _indents(text: Column) -> Column:
    """Of the lines that aren't blank: tabs plus a quarter for each space."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"[ \t\r\n]", "") != "")
    head = lambda x: F.regexp_extract(x, r"^[ \t]*", 0)
    return F.transform(lines, lambda x: F.length(F.replace(head(x), F.lit(" "), F.lit(""))) + F.length(F.replace(head(x), F.lit("\t"), F.lit(""))) / 4.0)


def indent_complexity(files: DataFrame) -> DataFrame:
    """id, complexity: mean indent times the greatest (2 decimals); files without a line that isn't blank are left out."""
    i = files.select("id", _indents(F.col("text")).alias("i")).filter(F.size("i") > 0)
    mean = F.aggregate("i", F.lit(0.0), lambda a, x: a + x) / F.size("i")
    return i.select("id", round_half_up(mean * F.array_max("i"), 2).alias("complexity"))


def indent_characters(files: DataFrame) -> DataFrame:
    """id, complexity: mean number of leading white-space characters, the variant for workspaces."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    n = F.transform(lines, lambda x: F.length(F.regexp_extract(x, r"^\s*", 0)))
    i = files.select("id", n.alias("i")).filter(F.size("i") > 0)
    return i.select("id", round_half_up(F.aggregate("i", F.lit(0.0), lambda a, x: a + x) / F.size("i"), 2).alias("complexity"))


def text_complexity(files: DataFrame) -> DataFrame:
    """The fallback without a parser: 2 x greatest indent + boolean operators + returns beyond the first."""
    t = files.select("id", F.regexp_count("text", F.lit(_BOOL)).cast("long").alias("bool_ops"), F.regexp_count("text", F.lit(_RETURN)).cast("long").alias("returns"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"), F.floor(F.coalesce(F.array_max(_indents(F.col("text"))), F.lit(0.0))).cast("long").alias("depth"))
    cc = 2 * F.col("depth") + F.col("bool_ops") + F.greatest(F.col("returns") - 1, F.lit(0))
    return t.withColumn("cognitive", cc.cast("double")).withColumn("density", F.round(F.col("cognitive") / F.greatest(F.col("lines"), F.lit(1)), 4))


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> dict[str, Column]:
    """Volume (1 decimal), difficulty, effort, bugs from distinct and total operators and operands."""
    vocabulary, length = n1 + n2, total1 + total2
    v = F.when(vocabulary > 0, round_half_up(length * F.log2(F.greatest(vocabulary, F.lit(1))), 1)).otherwise(0.0)
    d = F.when(n2 > 0, (n1 / 2) * (total2 / n2)).otherwise(0.0)
    return {"halstead_volume": v, "halstead_difficulty": F.round(d, 1), "halstead_effort": round_half_up(d * v), "halstead_bugs": round_half_up(v / 3000, 3)}


_FLOW = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match, ast.IfExp)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _walk(node: ast.AST, depth: int, m: dict) -> None:
    for child in ast.iter_child_nodes(node):
        d = depth
        if isinstance(child, _FLOW):
            elif_ = isinstance(child, ast.If) and isinstance(node, ast.If) and node.orelse == [child]
            m["cognitive"] += 1 if elif_ else 1 + d * (d + 1) // 2
            d = depth if elif_ else depth + 1
        elif isinstance(child, (*_DEFS, ast.Lambda)):
            d = depth + 1
            m["callbacks"] = max(m["callbacks"], d)
        elif isinstance(child, (ast.Break, ast.Continue)):
            m["cognitive"] += 1
        elif isinstance(child, ast.BoolOp):
            m["cognitive"] += len(child.values) - 1
            m["bools"] += len(child.values) - 1
        elif isinstance(child, ast.Return):
            m["returns"] += 1
        if isinstance(child, (ast.operator, ast.cmpop, ast.unaryop, ast.boolop, ast.Assign, ast.AugAssign, ast.Call, ast.Return, *_FLOW)):
            m["ops"].append(type(child).__name__)
        elif isinstance(child, ast.Name):
            m["names"].append(child.id)
        elif isinstance(child, ast.Constant):
            m["names"].append(repr(child.value))
        m["depth"] = max(m["depth"], d)
        _walk(child, d, m)


def measure_python(source: str) -> list[dict]:
    """Metrics of each function and method of a source; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for f in ast.walk(tree):
        if isinstance(f, _DEFS):
            m = {"cognitive": 0, "bools": 0, "returns": 0, "depth": 0, "callbacks": 0, "ops": [], "names": []}
            _walk(f, 0, m)
            lines = (f.end_lineno or f.lineno) - f.lineno + 1
            n1, n2, t1, t2 = len(set(m["ops"])), len(set(m["names"])), len(m["ops"]), len(m["names"])
            v = round((t1 + t2) * math.log2(n1 + n2), 1) if n1 + n2 else 0.0
            d = (n1 / 2) * (t2 / n2) if n2 else 0.0
            a = f.args
            out.append({
                "name": f.name, "line_start": f.lineno, "cognitive_complexity": float(m["cognitive"]), "nesting_depth": m["depth"], "param_count": len(a.posonlyargs + a.args + a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg),
                "line_count": lines, "return_count": m["returns"], "bool_op_count": m["bools"], "callback_depth": m["callbacks"], "cyclomatic_density": round(m["cognitive"] / lines, 4),
                "halstead_volume": v, "halstead_difficulty": round(d, 1), "halstead_effort": float(math.floor(d * v + 0.5)), "halstead_bugs": math.floor(v / 3000 * 1000 + 0.5) / 1000,
            })
    return out


METRICS = "path string, name string, line_start long, cognitive_complexity double, nesting_depth long, param_count long, line_count long, return_count long, bool_op_count long, callback_depth long, cyclomatic_density double, halstead_volume double, halstead_difficulty double, halstead_effort double, halstead_bugs double"


def python_metrics(files: DataFrame) -> DataFrame:
    """files: path, content. A row per function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, **m} for p, c in zip(b.path, b.content) for m in measure_python(c or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in METRICS.split(", ")])

    return files.select("path", "content").mapInPandas(run, METRICS)


def match_functions(metrics: DataFrame, symbols: DataFrame, start: int = 3, end: int = 1) -> DataFrame:
    """Metrics to symbols of the same path and name whose lines agree within start and end."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("path").alias("s_path"), F.col("name").alias("s_name"), F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"))
    near = (F.abs(F.col("line_start") - F.col("s_start")) <= start) & (F.abs(F.col("line_start") + F.col("line_count") - 1 - F.col("s_end")) <= end)
    return metrics.join(s, (F.col("path") == F.col("s_path")) & (F.col("name") == F.col("s_name")) & near)
