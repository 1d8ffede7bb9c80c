"""Renderers: a JSON envelope, text tables, Markdown and SARIF 2.1.0. They take collected rows of a report, which are few."""

from __future__ import annotations

import json
import time
from typing import Any

from arborlake import __version__

TOOL = "arborlake"
_LEVEL = {"CRITICAL": "error", "BREAKING": "error", "HIGH": "error", "WARNING": "warning", "MEDIUM": "warning", "INFO": "note", "LOW": "note"}


def envelope(command: str, summary: dict, payload: dict, project: str = "", index_age_s: int | None = None) -> dict:
    return {"command": command, "version": __version__, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "index_age_s": index_age_s, "project": project, "summary": summary, **payload}


def compact(command: str, payload: dict) -> dict:
    return {"command": command, **payload}


def dump(value: Any) -> str:
    """JSON, with what JSON can't say (infinite numbers, NaN) as null."""

    def clean(x: Any) -> Any:
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return x

    return json.dumps(clean(value), default=str, ensure_ascii=False)


def table(headers: list[str], rows: list[list], budget: int = 0) -> str:
    """Padded columns; beyond budget rows, a notice of how many are left out."""
    shown = rows[:budget] if budget else rows
    cells = [[str("" if c is None else c) for c in r] for r in shown]
    width = [max([len(h), *(len(r[k]) for r in cells)]) for k, h in enumerate(headers)]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip()
    out = [line(headers), "  ".join("-" * w for w in width), *map(line, cells)]
    if len(rows) > len(shown):
        out.append(f"(+{len(rows) - len(shown)} more)")
    return "\n".join(out)


def tsv(headers: list[str], rows: list[list]) -> str:
    return "\n".join("\t".join(str("" if c is None else c) for c in r) for r in [headers, *rows])


def markdown(title: str, sections: list[tuple[str, list[str], list[list]]]) -> str:
    out = [f"# {title}", ""]
    for name, headers, rows in sections:
        out += [f"## {name}", ""]
        if rows:
            out += ["| " + " | ".join(headers) + " |", "|" + " --- |" * len(headers)]
            out += ["| " + " | ".join(str("" if c is None else c).replace("|", "\\|") for c in r) + " |" for r in rows]
        else:
            out.append("None.")
        out.append("")
    return "\n".join(out)


def location(path: str, line: int | None = None) -> dict:
    at: dict = {"artifactLocation": {"uri": path}}
    if line:
        at["region"] = {"startLine": max(1, int(line))}
    return {"physicalLocation": at}


def result(rule: str, severity: str, message: str, locations: list[dict]) -> dict:
    return {"ruleId": rule, "level": _LEVEL.get(severity, "note"), "message": {"text": message}, "locations": locations}


def sarif(rules: dict[str, str], results: list[dict], kind: str = "analysis") -> dict:
    """A log with one run; rules: id to description; kind names the run among others of the tool."""
    driver = {"name": TOOL, "version": __version__, "rules": [{"id": k, "shortDescription": {"text": v}} for k, v in rules.items()]}
    run = {"tool": {"driver": driver}, "automationDetails": {"id": f"{TOOL}/{kind}"}, "invocations": [{"executionSuccessful": True}], "results": results}
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}


def dead_sarif(rows: list[dict]) -> dict:
    return sarif({"dead-code": "An export that nothing refers to"}, [result("dead-code", "WARNING", f"{r['kind']} {r['name']} is never referred to", [location(r["file_path"], r.get("line_start"))]) for r in rows], "dead")


def complexity_sarif(rows: list[dict], limit: float = 15) -> dict:
    return sarif({"complexity": "A symbol that is hard to follow"}, [result("complexity", "CRITICAL" if r["cognitive_complexity"] > 2 * limit else "WARNING", f"{r['name']}: cognitive complexity {r['cognitive_complexity']:g}", [location(r["file_path"], r.get("line_start"))]) for r in rows])


def convention_sarif(rows: list[dict]) -> dict:
    return sarif({"naming": "A name that breaks its kind's convention"}, [result("naming", "INFO", f"{r['name']} is {r['actual']}, {r['kind']}s in {r['language']} here are {r['expected']}", [location(r["file_path"], r.get("line_start"))]) for r in rows], "conventions")


def health_sarif(cycles: list[dict], gods: list[dict], necks: list[dict], violations: list[dict] = ()) -> dict:
    rules = {"cycle": "A dependency cycle", "god-component": "A symbol of very many edges", "bottleneck": "A symbol on very many paths", "layer-violation": "A dependency against the layers"}
    found = [result("cycle", r["severity"], f"cycle of {r['size']}", [location(p) for p in r.get("paths", [])]) for r in cycles]
    found += [result("god-component", r["severity"], f"{r['name']}: {r['degree']} edges", [location(r["file_path"])]) for r in gods]
    found += [result("bottleneck", r["severity"], f"{r['name']}: betweenness {r['betweenness']:g}", [location(r["file_path"])]) for r in necks]
    found += [result("layer-violation", "WARNING", f"{r['source']} (layer {r['from_layer']}) needs {r['target']} (layer {r['to_layer']})", [location(r["file_path"])]) for r in violations]
    return sarif(rules, found, "health")


def gates_sarif(rows: list[dict]) -> dict:
    return sarif({"gate": "A quality gate"}, [result("gate", "CRITICAL", f"{r['metric']} is {r['value']:g}, the gate is {r['op']} {r['threshold']:g}", []) for r in rows if not r["passed"]])
