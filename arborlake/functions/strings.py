"""String, path and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {
    "function": "fn", "class": "cls", "method": "meth", "variable": "var", "constant": "const", "interface": "iface", "struct": "struct", "enum": "enum", "module": "mod",
    "package": "pkg", "trait": "trait", "type_alias": "type", "property": "prop", "field": "field", "constructor": "ctor", "decorator": "deco",
}
EDGE_KINDS = {"call": "calls", "import": "imports", "inherits": "extends", "implements": "implements", "reference": "references", "type_ref": "uses type", "template": "used in template"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def dirname(path: Column | str) -> Column:
    p = _c(path)
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(~p.contains("/"), ".").when(d == "", "/").otherwise(d)


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extname(path: Column | str) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1)


def top_dir(path: Column | str) -> Column:
    p = _c(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(".")


def depth(path: Column | str) -> Column:
    return F.size(F.split(_c(path), "/"))


def contains_ci(col: Column | str, needle: str) -> Column:
    """SQLite's LIKE '%needle%': case-insensitive, with % and _ live."""
    return _c(col).ilike(f"%{needle}%")


def case_class(name: Column | str) -> Column:
    """camel, snake, Pascal, UPPER or mixed: the first that matches, in that order."""
    n = _c(name)
    return (
        F.when(n.rlike(r"^[a-z][a-zA-Z0-9]*$"), "camelCase").when(n.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "snake_case")
        .when(n.rlike(r"^[A-Z][a-zA-Z0-9]*$"), "PascalCase").when(n.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), "UPPER_SNAKE").otherwise("mixed")
    )


def abbreviate(kind: Column | str) -> Column:
    k = _c(kind)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), k), k)


def expand_abbreviation(kind: str) -> str:
    """The kind that an abbreviation stands for."""
    return {v: k for k, v in KINDS.items()}.get(kind, kind)


def edge_label(kind: Column | str) -> Column:
    k = _c(kind)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_KINDS.items() for x in kv]), k), k)


def shorten(text: Column | str, most: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def loc(path: Column | str, line: Column | str) -> Column:
    return F.concat_ws(":", _c(path), _c(line).cast("string"))


def tokens(text: Column | str) -> Column:
    """A language model's tokens, roughly: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4)).cast("long")


def line_count(text: Column | str) -> Column:
    return F.size(F.split(_c(text), "\n", -1))


def import_path(path: Column | str) -> Column:
    """An import's path: quotes, @/ and ./ resolved, extension gone."""
    p = F.regexp_replace(_c(path), r"""^["'<]|["'>]$""", "")
    p = F.regexp_replace(F.regexp_replace(p, r"^@/", "src/"), r"^(\.{1,2}/)+", "")
    return F.regexp_replace(p, r"\.(js|jsx|ts|tsx|mjs|cjs|py|vue|svelte|go|java|rs|h|hpp|c|cpp|proto)$", "")


def signature_hash(ids: Column) -> Column:
    """16 hex digits of the sha-256 of ids joined by |."""
    return F.substring(F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), "|"), 256), 1, 16)


def any_of(col: Column | str, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | _c(col).contains(n)
    return out
