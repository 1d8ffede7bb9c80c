from pyspark.sql import functions as F

from arborlake.functions import classify, strings
from arborlake.operators import complexity, incremental, resolve
from arborlake.sources import repo

ROLES = [
    (".github/workflows/ci.yml", None, "ci"), ("vendor/lib/foo.js", None, "vendored"), ("tests/test_app.py", None, "test"), ("docs/api.md", None, "docs"), ("examples/demo.py", None, "examples"), ("bin/run.js", None, "scripts"),
    ("dist/bundle.js", None, "build"), ("Makefile", None, "build"), ("LICENSE", None, "docs"), ("src/utils.spec.ts", None, "test"), ("UserTest.cls", None, "test"), ("assets/logo.png", None, "data"), ("tsconfig.json", None, "config"),
    ("model.pb.go", None, "generated"), ("src/api.js", "// DO NOT EDIT - auto-generated", "generated"), ("deploy", "#!/bin/bash", "scripts"), ("src/app.js", None, "source"),
]


def test_roles(spark):
    df = spark.createDataFrame(ROLES, "path string, content string, want string")
    bad = df.withColumn("got", classify.role("path", F.col("content"))).filter("got <> want").collect()
    assert not bad


def test_languages_and_test_pairs(spark):
    lang = lambda *p: [r[0] for r in spark.createDataFrame([(x,) for x in p], "path string").select(classify.language("path")).collect()]
    assert lang("a.py", "b.mjs", "c.TS", "x.object-meta.xml", "d.unknown", "e.pyi", "f.hxx") == ["python", "javascript", "typescript", "sfxml", None, "python", "cpp"]
    pairs = [("pkg/handler.go", "pkg/handler_test.go"), ("src/app.js", "src/app.spec.js"), ("src/main/java/com/App.java", "src/test/java/com/AppTest.java"), ("lib/models/user.rb", "spec/models/user_spec.rb"), ("classes/AccountService.cls", "classes/AccountServiceTest.cls"), ("pkg/calc.py", "pkg/test_calc.py"), ("x/Svc.cs", "x/SvcTests.cs")]
    df = spark.createDataFrame(pairs, "s string, t string").select("s", "t", classify.test_candidates("s").alias("tests"), classify.source_candidates("t").alias("sources"), classify.test_candidates("t").alias("none"))
    for r in df.collect():
        assert r.t in r.tests and r.s in r.sources and r.none == []
    files = spark.createDataFrame([(x,) for p in pairs for x in p], "path string")
    assert {(r.source, r.test) for r in classify.pair_tests(files).collect()} == set(pairs)
    assert {r.name for r in classify.detect(spark.createDataFrame([("a/package.json",), ("Makefile",)], "path string"), classify.BUILD_TOOLS).collect()} == {"npm", "make"}


def test_strings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    p = F.lit
    assert [one(strings.dirname(p(x))) for x in ("a/b/c.js", "a", "/a")] == ["a/b", ".", "/"]
    assert [one(strings.extname(p(x))) for x in ("a/b.tar.gz", ".env", "x")] == [".gz", "", ""]
    assert [one(strings.case_class(p(x))) for x in ("camelCase", "snake_case", "Pascal", "UPPER_CASE", "odd-name")] == ["camelCase", "snake_case", "PascalCase", "UPPER_SNAKE", "mixed"]
    assert one(strings.round_half_up(p(-2.5))) == -2 and one(strings.round_half_up(p(2.345), 2)) == 2.35
    assert one(strings.shorten(p("abcdefghij"), 6)) == "abc..." and one(strings.tokens(p("ab"))) == 1
    assert one(strings.abbreviate(p("function"))) == "fn" and strings.expand_abbreviation("fn") == "function"
    assert one(strings.import_path(p("@/utils/log.js"))) == "src/utils/log" and one(strings.import_path(p("../a/b.ts"))) == "a/b"


def test_text_metrics(spark):
    df = spark.createDataFrame([(1, "a\n\tb\n    c\n\n"), (2, "  \n"), (3, "if a and b:\n        return x or y\n    return 1")], "id long, text string")
    assert {r.id: r.complexity for r in complexity.indent_complexity(df).collect()} == {1: 0.67, 3: 2.0}
    t = {r.id: r for r in complexity.text_complexity(df).collect()}
    assert (t[3].bool_ops, t[3].returns, t[3].depth, t[3].cognitive) == (2, 2, 2, 7.0)


def test_python_metrics(spark):
    source = "def f(a, *b):\n    if a and b:\n        for x in b:\n            if x:\n                break\n    elif a:\n        return 1\n    return lambda: 2\n\ndef broken("
    assert complexity.measure_python(source) == []
    (m,) = complexity.measure_python(source.split("\n\ndef broken")[0])
    assert (m["cognitive_complexity"], m["nesting_depth"], m["param_count"], m["return_count"], m["bool_op_count"]) == (1 + 2 + 4 + 1 + 1 + 1, 3, 2, 2, 1)
    df = spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.py", "x =")], "path string, content string")
    assert [r.name for r in complexity.python_metrics(df).collect()] == ["f"]


def test_resolution(spark):
    files = spark.createDataFrame([(1, "src/calc.py"), (2, "src/app.js")], "id long, path string")
    symbols = spark.createDataFrame([(1, 1, "Calculator", "Calculator", "class", 1, 9, 1), (2, 1, "add", "Calculator.add", "method", 2, 4, 1), (3, 2, "main", "main", "function", 1, 20, 1)], "id long, file_id long, name string, qualified_name string, kind string, line_start long, line_end long, is_exported int")
    schema = "ref long, source_name string, target_name string, kind string, line long, import_path string, source_file string"
    refs = [(1, "main", "Calculator", "call", 5, None, "src/app.js"), (2, "main", "Calculator", "call", 8, None, "src/app.js"), (3, "main", "NonExistent", "call", 6, None, "src/app.js"), (4, "Calculator", "Calculator", "call", 1, None, "src/calc.py"), (5, None, "calculator", "reference", 3, None, "src/calc.py"), (6, None, "Calculator.add", "call", 7, None, "src/app.js")]
    got = {(r.source_id, r.target_id, r.kind, r.line) for r in resolve.resolve(spark.createDataFrame(refs, schema), symbols, files).collect()}
    assert got == {(3, 1, "call", 5), (2, 1, "reference", 3), (3, 2, "call", 7)}
    refs = spark.createDataFrame([("src/App.vue", '<template><Button @click="save">{{ title }} {{ title }}</Button></template>')], "path string, content string")
    assert {r.target_name for r in resolve.template_refs(refs).collect()} == {"Button", "save", "title"}


def test_git_log(spark):
    log = "COMMIT:h1|Ann|100|fix: a|b|c\n3\t1\tsrc/{old => new}/f.py\n-\t-\timg.png\n\nCOMMIT:h2|Bob|200|\n1\t0\ta.txt => b.txt\n5\t5\tx/{ => y}/z.c"
    commits, changes = repo.parse_log(spark.createDataFrame(list(enumerate(log.split("\n"))), "n long, line string"))
    assert {(r.hash, r.author, r.timestamp, r.message) for r in commits.collect()} == {("h1", "Ann", 100, "fix: a|b|c"), ("h2", "Bob", 200, "")}
    assert {(r.hash, r.lines_added, r.lines_removed, r.path) for r in changes.collect()} == {("h1", 3, 1, "src/new/f.py"), ("h1", 0, 0, "img.png"), ("h2", 1, 0, "b.txt"), ("h2", 5, 5, "x/y/z.c")}


def test_incremental(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, hash string, mtime double")
    d = incremental.changed_files(t([("a", "1", 5.0), ("b", "2", 9.0), ("c", "3", 1.0), ("e", "5", 9.0)]), t([("a", "x", 5.0), ("b", "y", 1.0), ("d", "4", 1.0), ("e", "5", 1.0)]))
    assert {r.path: r.change for r in d.collect()} == {"b": "modified", "c": "added", "d": "removed"}
    s = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert {(r.k, r.v) for r in incremental.upsert(s([(1, "a"), (2, "b")]), s([(2, "c"), (3, "d")]), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.k, r.v) for r in incremental.insert_ignore(s([(1, "a")]), s([(1, "z"), (3, "d"), (3, "d")]), ["k"]).collect()} == {(1, "a"), (3, "d")}
    assert {(r.k, r.v) for r in incremental.update_or_insert(s([(1, "a"), (2, "b")]), s([(2, "c"), (3, "d")]), "k", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    gone = spark.createDataFrame([(1,)], "id long")
    assert [r.k for r in incremental.cascade({"t": (s([(1, "a"), (2, "b")]), ["k"])}, gone)["t"].collect()] == [2]
    h = spark.createDataFrame([(1, 10, 1.0)], "id long, timestamp long, avg_complexity double").withColumn("extra_json", F.lit(None).cast("string"))
    both = incremental.append_snapshot(h, spark.createDataFrame([(2, 20, 2.0, 7)], "id long, timestamp long, avg_complexity double, odd long"))
    rows = incremental.read_history(both).collect()
    assert [r.id for r in rows] == [2, 1] and rows[0].extra == {"odd": "7"}


def test_template_names_are_listed_once_for_a_path(spark):
    page = '<template>{{ %s }}<Button @click="save"/></template>'
    refs = spark.createDataFrame([("a.vue", page % "title"), ("a.vue", page % "title"), ("b.vue", page % "title"), ("b.vue", page % "head")], "path string, content string")
    got = sorted((r.path, r.ordinal, r.target_name) for r in resolve.template_refs(refs).collect())
    assert got == [("a.vue", 0, "title"), ("a.vue", 1, "save"), ("a.vue", 2, "Button"), ("b.vue", 0, "head"), ("b.vue", 1, "title"), ("b.vue", 2, "save"), ("b.vue", 3, "Button")]
