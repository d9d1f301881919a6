"""Which paths are worth indexing, as column predicates over repository-relative paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that exclude a path wherever they occur (case counts), and the names and
# extensions of text files (ASCII case does not count).
EXCLUDED_SUBSTRINGS = (
    "/node_modules/", "/vendor/", "/target/", "/dist/", "/build/",
    "/.git/", "/.next/", "/.venv/", "/__pycache__/",
    ".min.js", ".min.css", ".map", ".lock",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "go.sum", "Cargo.lock", "poetry.lock", "uv.lock", "composer.lock",
)
TEXT_NAMES = ("makefile", "dockerfile", "jenkinsfile", "readme", "license", "changelog", "authors", "contributors", "copying", "notice")
TEXT_EXTENSIONS = (
    "py", "pyx", "pyi", "ipynb",
    "js", "jsx", "ts", "tsx", "mjs", "cjs",
    "go", "rs", "java", "kt", "kts", "scala", "swift", "m", "mm",
    "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx",
    "rb", "php", "cs", "fs", "fsx",
    "sh", "bash", "zsh", "fish", "ps1",
    "sql", "proto", "thrift", "graphql",
    "yaml", "yml", "toml", "ini", "cfg", "json", "jsonc",
    "md", "mdx", "rst", "txt", "adoc",
    "html", "htm", "xml", "svg", "css", "scss", "sass", "less",
    "dockerfile", "makefile", "mk", "cmake",
    "tf", "hcl", "nix", "lua", "r", "jl", "hs", "elm",
    "ex", "exs", "erl", "clj", "cljs", "edn",
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot; null without one."""
    return F.when(name.contains("."), F.substring_index(name, ".", -1))


def is_excluded(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (path.contains(s) for s in EXCLUDED_SUBSTRINGS))


def is_textual(path: Column) -> Column:
    """True for paths that hold text by their name and lie in no excluded place; false for null."""
    name = ascii_lower(basename(path))
    by_name = name.isin(*TEXT_NAMES) | F.coalesce(extension(name).isin(*TEXT_EXTENSIONS), F.lit(False))
    return F.coalesce(~is_excluded(path) & by_name, F.lit(False))


def under_prefix(path: Column, prefix: str | None) -> Column:
    """Plain string prefix, not a directory test: ``src/a`` covers ``src/ab.rs``. None or empty covers all."""
    return path.startswith(prefix) if prefix else F.lit(True)


def sql_is_textual(path: str) -> str:
    """The same predicate as DuckDB SQL."""
    name = f"translate(split_part({path}, '/', -1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    excluded = " OR ".join(f"contains({path}, '{s}')" for s in EXCLUDED_SUBSTRINGS)
    return f"(NOT ({excluded}) AND ({name} IN ({quoted(TEXT_NAMES)}) OR (contains({name}, '.') AND split_part({name}, '.', -1) IN ({quoted(TEXT_EXTENSIONS)}))))"


def textual_path(path: str) -> bool:
    """The same predicate for one path, for listings that are filtered before any file is read."""
    name = path.rsplit("/", 1)[-1].translate({c: c + 32 for c in range(65, 91)})
    if any(s in path for s in EXCLUDED_SUBSTRINGS):
        return False
    return name in TEXT_NAMES or "." in name and name.rsplit(".", 1)[1] in TEXT_EXTENSIONS
