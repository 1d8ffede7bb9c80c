"""Languages, file roles and the pairing of sources with tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.strings import basename, extname

_BY_LANGUAGE = {
    "python": "py pyi pyw", "javascript": "js jsx mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "rust": "rs", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs",
    "ruby": "rb", "php": "php", "kotlin": "kt kts", "swift": "swift", "scala": "scala sc", "apex": "cls trigger", "aura": "cmp app evt intf design", "visualforce": "page component", "protobuf": "proto",
    "vue": "vue", "svelte": "svelte", "json": "json", "yaml": "yml yaml", "toml": "toml", "markdown": "md", "html": "html htm", "css": "css scss less", "shell": "sh bash", "sql": "sql", "xml": "xml", "lua": "lua",
}
EXTENSIONS = {"." + e: lang for lang, exts in _BY_LANGUAGE.items() for e in exts.split()}


def language(path: Column | str) -> Column:
    """By suffix; null if unknown."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.endswith("-meta.xml"), "sfxml").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(extname(p))))


_TEST_NAME = r"(^test_.*\.py$|_test\.(py|go|rb)$|\.(test|spec)\.[jt]sx?$|_spec\.rb$|Tests?\.(java|cs|cls|kt)$|^conftest\.py$|_Test\.cls$)"
_SOURCE_EXT = r"\.(py|pyi|js|jsx|mjs|cjs|ts|tsx|mts|cts|go|java|rs|c|h|cpp|cc|cxx|hpp|hxx|cs|rb|php|kt|swift|scala|cls|trigger|cmp|app|evt|page|component|vue|svelte|lua|proto|sql)$"


def role(path: Column | str, content: Column | None = None) -> Column:
    """A file's role. The first rule that fits: generated by its text, vendored, test by folder, test by name, CI, build, generated by name, by name, by folder, by text, else source."""
    p = F.col(path) if isinstance(path, str) else path
    b = basename(p)
    low = F.lower(b)
    head = F.substring(content, 1, 2000) if content is not None else F.lit("")
    lines = F.split(F.coalesce(content, F.lit("")), "\n") if content is not None else F.array(F.lit(""))
    mean_line = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.length(x)) / F.greatest(F.size(lines), F.lit(1))
    return (
        F.when(head.rlike(r"(?i)(do not edit|auto-?generated|@generated|generated by)"), "generated")
        .when(p.rlike(r"(^|/)(vendor|node_modules|third_party|bower_components|external)/"), "vendored")
        .when(p.rlike(_TEST_FOLDER), "test")
        .when(b.rlike(_TEST_NAME), "test")
        .when(p.rlike(r"^(\.github/workflows|\.circleci|\.gitlab)/") | low.isin(".travis.yml", "jenkinsfile", ".gitlab-ci.yml", "azure-pipelines.yml"), "ci")
        .when(p.rlike(r"(^|/)(dist|build|out|target)/") | low.isin("makefile", "dockerfile", "cmakelists.txt", "build.gradle", "rakefile", "gulpfile.js", "webpack.config.js", "setup.py"), "build")
        .when(low.rlike(r"(\.pb\.(go|cc|h)|_pb2(_grpc)?\.py|\.g\.dart|\.min\.(js|css)|\.generated\.[a-z]+)$"), "generated")
        .when(low.rlike(r"^(readme|license|licence|changelog|contributing|authors|notice|copying)(\..*)?$") | low.rlike(r"\.(md|rst|adoc)$"), "docs")
        .when(low.rlike(r"^(package|tsconfig|composer|babel\.config|jest\.config)\.?.*\.json$") | low.rlike(r"^(tsconfig.*\.json|package\.json|pyproject\.toml|setup\.cfg|\.eslintrc.*|\.prettierrc.*|\.editorconfig|\.gitignore|tox\.ini)$") | low.rlike(r"\.(ini|cfg|conf|toml|ya?ml|properties|env)$"), "config")
        .when(low.rlike(r"\.(png|jpe?g|gif|svg|ico|woff2?|ttf|csv|tsv|parquet|json|xml|sqlite|db|pdf|zip|gz)$"), "data")
        .when(p.rlike(r"(^|/)(docs?|documentation)/"), "docs")
        .when(p.rlike(r"(^|/)(examples?|samples?|demos?)/"), "examples")
        .when(p.rlike(r"(^|/)(scripts?|bin|tools)/"), "scripts")
        .when(p.rlike(r"(^|/)(config|conf|settings)/") & ~low.rlike(_SOURCE_EXT), "config")
        .when(head.rlike(r"^#!"), F.when(low.rlike(_SOURCE_EXT), "source").otherwise("scripts"))
        .when(mean_line > 500, "generated")
        .otherwise("source")
    )


_TEST_FOLDER = r"(^|/)(test|tests|__tests__|spec|specs)/"


def is_test(path: Column | str) -> Column:
    """By folder or name, whatever else a file may be."""
    p = F.col(path) if isinstance(path, str) else path
    return p.rlike(_TEST_FOLDER) | basename(p).rlike(_TEST_NAME)


def is_low_risk(path: Column | str) -> Column:
    return role(path).isin("docs", "config", "data", "ci", "generated", "vendored")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def test_candidates(path: Column | str) -> Column:
    """Paths at which a source's tests may lie, by the convention of its language; none for a test."""
    p = F.col(path) if isinstance(path, str) else path
    ext, b = extname(p), basename(p)
    d = F.regexp_extract(p, r"^(.*/)[^/]*$", 1)
    s = _stem(b)
    paths = (
        F.when(ext == ".py", F.array(F.concat(d, F.lit("test_"), b), F.concat(d, s, F.lit("_test.py")), F.concat(d, F.lit("tests/test_"), b), F.concat(F.lit("tests/test_"), b)))
        .when(ext == ".go", F.array(F.concat(d, s, F.lit("_test.go"))))
        .when(ext.rlike(r"^\.[jt]sx?$"), F.array(F.concat(d, s, F.lit(".test"), ext), F.concat(d, s, F.lit(".spec"), ext), F.concat(d, F.lit("__tests__/"), s, F.lit(".test"), ext), F.concat(d, F.lit("__tests__/"), b)))
        .when(ext == ".java", F.array(F.concat(F.regexp_replace(d, "src/main/", "src/test/"), s, F.lit("Test.java")), F.concat(F.regexp_replace(d, "src/main/", "src/test/"), s, F.lit("Tests.java"))))
        .when(ext == ".rb", F.array(F.concat(F.regexp_replace(d, "^(lib|app)/", "spec/"), s, F.lit("_spec.rb")), F.concat(F.regexp_replace(d, "^(lib|app)/", "test/"), s, F.lit("_test.rb"))))
        .when(ext == ".cls", F.array(F.concat(d, s, F.lit("Test.cls")), F.concat(d, s, F.lit("_Test.cls"))))
        .when(ext == ".cs", F.array(F.concat(d, s, F.lit("Tests.cs")), F.concat(d, s, F.lit("Test.cs"))))
    )
    return F.when(b.rlike(_TEST_NAME), F.array().cast("array<string>")).otherwise(F.coalesce(paths, F.array().cast("array<string>")))


def source_candidates(path: Column | str) -> Column:
    """Paths of the source that a test may be for; none if it isn't a test by name."""
    p = F.col(path) if isinstance(path, str) else path
    b = basename(p)
    d = F.regexp_replace(F.regexp_extract(p, r"^(.*/)[^/]*$", 1), r"(__tests__|tests)/$", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"^test_", ""), r"(_test|_spec|\.test|\.spec)(?=\.[^.]*$)", ""), r"(_?Tests?)(?=\.(java|cs|cls|kt)$)", "")
    return F.when(b.rlike(_TEST_NAME), F.array_distinct(F.array(F.concat(d, plain), F.concat(F.regexp_replace(d, "src/test/", "src/main/"), plain), F.concat(F.regexp_replace(d, "^(spec|test)/", "lib/"), plain), F.concat(F.regexp_replace(d, "^(spec|test)/", "app/"), plain)))).otherwise(F.array().cast("array<string>"))


def pair_tests(files: DataFrame) -> DataFrame:
    """source, test: an equi-join of files with the candidates of files."""
    c = files.select(F.col("path").alias("source"), F.explode(test_candidates("path")).alias("test")).distinct()
    return c.join(files.select(F.col("path").alias("test")), "test", "left_semi").select("source", "test")


FRAMEWORKS = {"django": "manage.py", "rails": "config/routes.rb", "next.js": "next.config.js", "vue": "vue.config.js", "angular": "angular.json", "spring": "src/main/resources/application.properties", "salesforce": "sfdx-project.json"}
BUILD_TOOLS = {"npm": "package.json", "maven": "pom.xml", "gradle": "build.gradle", "cargo": "Cargo.toml", "go modules": "go.mod", "poetry": "pyproject.toml", "make": "Makefile", "cmake": "CMakeLists.txt"}


def detect(files: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Names whose marker file is in the tree: one pass with a flag for each."""
    flags = files.agg(*[F.max(((F.col("path") == f) | F.col("path").endswith("/" + f)).cast("int")).alias(n) for n, f in markers.items()])
    return flags.select(F.explode(F.array_compact(F.array(*[F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in markers]))).alias("name"))
