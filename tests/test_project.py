"""A small project end to end: index, every command, every format."""

import io
import json
import subprocess

import pytest

from arborlake import cli, server
from arborlake.plans import commands, index, reports
from arborlake.plans.index import Store, build
from arborlake.sources import repo, workspace

FILES = {
    "src/models.py": "class Base:\n    def save(self):\n        return 1\n\n\nclass User(Base):\n    def name(self):\n        if self.x and self.y:\n            return self.save()\n        return None\n",
    "src/service.py": "from src.models import User\n\n\ndef make():\n    return User()\n\n\ndef unused():\n    return make()\n",
    "tests/test_service.py": "from src.service import make\n\n\ndef test_make():\n    assert make()\n",
    "README.md": "# demo\n", "package-lock.json": "{}", "logo.png": "x",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first | second")
    (root / "src/service.py").write_text(FILES["src/service.py"] + "\n\ndef more():\n    return 2\n")
    (root / "src/models.py").write_text(FILES["src/models.py"] + "\n")
    git("commit", "-qam", "more")
    return str(root)


@pytest.fixture(scope="module")
def store(spark, project, tmp_path_factory):
    return build(spark, project, str(tmp_path_factory.mktemp("store")))


def test_discovery(spark, project):
    assert [r.path for r in repo.discover(spark, project).orderBy("path").collect()] == ["README.md", "src/models.py", "src/service.py", "tests/test_service.py"]
    assert repo.find_root(project + "/src") == project and repo.git_files("/nonexistent") is None


def test_tables(store):
    names = {r.qualified_name for r in store.get("symbols").collect()}
    assert {"Base", "Base.save", "User", "User.name", "make", "unused", "test_make", "more"} <= names
    ids = {r.id: r.qualified_name for r in store.get("symbols").collect()}
    edges = {(ids[r.source_id], ids[r.target_id], r.kind) for r in store.get("edges").collect()}
    assert {("User", "Base", "inherits"), ("make", "User", "call"), ("unused", "make", "call"), ("test_make", "make", "call"), ("User.name", "Base.save", "call")} <= edges
    assert store.get("git_commits").count() == 2 and store.get("git_cochange").count() == 6
    assert {r.message for r in store.get("git_commits").collect()} == {"first | second", "more"}
    by = {ids[r.symbol_id]: r for r in store.get("symbol_metrics").collect()}
    assert by["User.name"].cognitive_complexity == 2 and by["User.name"].halstead_volume > 0


ARGS = {"search": {"pattern": "make"}, "grep": {"pattern": "a"}, "symbol": {"name": "make"}, "deps": {"path": "src/service.py"}, "uses": {"name": "User"}, "file": {"path": "src/models.py"}, "trace": {"source": "test_make", "target": "Base"}, "context": {"name": "make", "task": "review"}}
NEEDS_PATHS = ("diff", "preflight", "breaking", "affected-tests", "pr-risk")


def test_every_command_runs(store):
    commands.COMMANDS["fitness"](store, record=True, now=100)
    commands.COMMANDS["fitness"](store, record=True, now=200)
    for name, f in commands.COMMANDS.items():
        r = f(store, **(ARGS.get(name) or ({"paths": ["src/models.py"]} if name in NEEDS_PATHS else {})))
        out = json.loads(cli.render(r, "json", 5, "demo"))
        assert out["command"] == r.command and "summary" in out, name
        if r.sarif:
            log = json.loads(cli.render(r, "sarif", 5))
            assert log["version"] == "2.1.0" and log["runs"][0]["tool"]["driver"]["rules"], name
    assert cli.render(commands.COMMANDS["describe"](store), "markdown", 5).startswith("# describe")
    assert "== dead ==" in cli.render(commands.COMMANDS["dead"](store), "table", 5) and "\t" in cli.render(commands.COMMANDS["fan"](store), "tsv", 5)


def test_answers(store):
    rows = lambda r, t: [x.asDict() for x in r.tables[t].collect()]
    assert {x["name"] for x in rows(commands.COMMANDS["dead"](store), "dead")} == {"unused", "more", "name"}  # no one calls User.name
    assert [x["path"] for x in rows(commands.COMMANDS["affected-tests"](store, ["src/models.py"]), "tests")] == ["tests/test_service.py"]
    assert rows(commands.COMMANDS["trace"](store, "test_make", "Base"), "paths")[0]["hops"] == 3


def test_traces_name_their_steps(store):
    r = commands.COMMANDS["trace"](store, "test_make", "Base")
    steps = [x.asDict() for x in r.tables["steps"].collect()]
    assert [x["name"] for x in steps if x["path"] == steps[0]["path"]] == ["test_make", "make", "User", "Base"]
    assert {x["file_path"] for x in steps} == {"tests/test_service.py", "src/service.py", "src/models.py"} and all(x["kind"] != "?" for x in steps)
    assert r.tables["paths"].first().coupling == "structural"


def test_health_has_a_verdict(store):
    r = commands.COMMANDS["health"](store, no_framework=True)
    assert r.summary["verdict"].startswith("Healthy codebase") and r.summary["severities"]["CRITICAL"] == r.summary["severities"]["WARNING"] == 0
    log = r.sarif({k: [] for k in ("cycles", "god_components", "bottlenecks", "violations")})["runs"][0]
    assert log["automationDetails"]["id"].endswith("/health") and log["invocations"][0]["executionSuccessful"]


def test_a_second_index_reads_only_what_changed(spark, tmp_path):
    root, at = tmp_path / "p", str(tmp_path / "s")
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    first = build(spark, str(root), at)
    before = {t: {r.id: r for r in first.get(t).collect()} for t in ("files", "symbols", "edges")}
    seen = []
    keep, index.ex.extract = index.ex.extract, lambda df: seen.extend(r.path for r in df.select("path").collect()) or keep(df)
    try:
        assert {r.id: r for r in build(spark, str(root), at).get("files").collect()} == before["files"] and not seen
        (root / "src/service.py").write_text(FILES["src/service.py"].replace("unused", "renamed") + "\n\nclass Late(User):\n    pass\n")
        (root / "README.md").unlink()
        (root / "src/new.py").write_text("from src.models import Base\n\n\nclass New(Base):\n    pass\n")
        second = build(spark, str(root), at)
    finally:
        index.ex.extract = keep
    assert sorted(seen) == ["src/new.py", "src/service.py"]
    whole = build(spark, str(root), str(tmp_path / "fresh"), full=True)
    for t in ("symbols", "edges", "file_edges", "scc", "layers", "references"):
        key = lambda s, t=t: sorted(map(str, s.get(t).select(*sorted(s.get(t).columns)).collect()))
        assert key(second) == key(whole), t
    now = {r.id: r for r in second.get("symbols").collect()}
    kept = {i for i, r in before["symbols"].items() if r.name in ("Base", "User", "make", "test_make")}
    assert kept <= set(now) and {r.name for r in now.values()} >= {"renamed", "Late", "New"} and "unused" not in {r.name for r in now.values()}
    assert "README.md" not in {r.path for r in second.get("files").collect()} and Store(spark, at).get("symbols").count() == len(now)


def test_every_tool_answers(store):
    ask = lambda method, **params: json.loads(json.dumps(server.answer(store, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, "demo"), default=str))
    assert ask("initialize")["result"]["serverInfo"]["name"] == "arborlake"
    tools = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert set(tools) == set(commands.COMMANDS) and tools["trace"]["required"] == ["source", "target"] and tools["diff"]["properties"]["paths"]["type"] == "array"
    for name in tools:
        got = ask("tools/call", name=name, arguments=ARGS.get(name) or ({"paths": ["src/models.py"]} if name in NEEDS_PATHS else {}))["result"]
        assert not got["isError"] or name in ("trend", "alerts"), (name, got)
        if not got["isError"]:
            assert json.loads(got["content"][0]["text"])["command"] == name
    assert ask("tools/call", name="deps", arguments={"bad": 1})["result"]["isError"] and ask("tools/call", name="none")["error"]["code"] == -32602 and ask("other")["error"]["code"] == -32601
    assert server.answer(store, {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    out = io.StringIO()
    server.serve(store, io.StringIO('{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n\nnot json\n[1]\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [7, None, None]


def test_reports():
    assert reports.dump({"a": float("inf"), "b": [float("nan"), 1]}) == '{"a": null, "b": [null, 1]}'
    assert reports.table(["x"], [[1], [2], [3]], 2).endswith("(+1 more)")


def test_workspace(spark, project, tmp_path):
    root = str(tmp_path)
    workspace.init(root)
    workspace.add(root, "one", project)
    with pytest.raises(ValueError):
        workspace.add(root, "one", project)
    with pytest.raises(ValueError):
        workspace.remove(root, "two")
    assert workspace.resolve(root, workspace.load(root))[0]["has_git"]
    assert "one/src/models.py" in {r.path for r in workspace.read(spark, root).collect()}
    workspace.add(root, "two", project)
    both = index.build_from(spark, workspace.read(spark, root), root + "/tables", *workspace.read_history(spark, root), sources=3, communities="labels")
    assert {r.path.split("/")[0] for r in both.get("files").collect()} == {"one", "two"} and both.get("git_commits").count() == 4
    assert both.get("clusters").count() == both.get("symbols").count() and both.get("git_file_changes").filter("file_id IS NULL AND path LIKE '%.py'").isEmpty()
    assert not Store(spark, root + "/none").exists()
