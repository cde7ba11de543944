"""The language registry: a dimension of rows, and lookups as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Key, display name, extensions, file names.  The first writer of an extension keeps it.
EXTRACTED = (
    ("python", "Python", (".py", ".pyi", ".pyw"), ()),
    ("javascript", "JavaScript", (".js", ".mjs", ".cjs", ".jsx"), ()),
    ("typescript", "TypeScript", (".ts", ".mts", ".cts"), ()),
    ("tsx", "TypeScript JSX", (".tsx",), ()),
    ("java", "Java", (".java",), ()),
    ("go", "Go", (".go",), ()),
    ("rust", "Rust", (".rs",), ()),
    ("c", "C", (".c", ".h"), ()),
    ("cpp", "C++", (".cc", ".cpp", ".cxx", ".c++", ".hpp", ".hh", ".hxx"), ()),
    ("csharp", "C#", (".cs",), ()),
    ("ruby", "Ruby", (".rb", ".rake", ".gemspec"), ()),
    ("php", "PHP", (".php", ".phtml"), ()),
    ("kotlin", "Kotlin", (".kt", ".kts"), ()),
    ("swift", "Swift", (".swift",), ()),
    ("scala", "Scala", (".scala", ".sc"), ()),
    ("lua", "Lua", (".lua",), ()),
    ("bash", "Shell", (".sh", ".bash", ".zsh"), ()),
    ("dart", "Dart", (".dart",), ()),
)
PARSE_ONLY = (
    ("elixir", "Elixir", (".ex", ".exs"), ()),
    ("erlang", "Erlang", (".erl", ".hrl"), ()),
    ("haskell", "Haskell", (".hs",), ()),
    ("ocaml", "OCaml", (".ml", ".mli"), ()),
    ("clojure", "Clojure", (".clj", ".cljs", ".cljc"), ()),
    ("perl", "Perl", (".pl", ".pm"), ()),
    ("r", "R", (".r", ".R"), ()),
    ("julia", "Julia", (".jl",), ()),
    ("nim", "Nim", (".nim",), ()),
    ("zig", "Zig", (".zig",), ()),
    ("gdscript", "GDScript", (".gd",), ()),
    ("groovy", "Groovy", (".groovy", ".gradle"), ()),
    ("fsharp", "F#", (".fs", ".fsi", ".fsx"), ()),
    ("vb", "Visual Basic", (".vb",), ()),
    ("powershell", "PowerShell", (".ps1", ".psm1"), ()),
    ("batch", "Batch", (".bat", ".cmd"), ()),
    ("objc", "Objective-C", (".mm",), ()),
    ("asm", "Assembly", (".asm", ".s", ".S"), ()),
    ("solidity", "Solidity", (".sol",), ()),
    ("proto", "Protocol Buffers", (".proto",), ()),
    ("thrift", "Thrift", (".thrift",), ()),
    ("graphql", "GraphQL", (".graphql", ".gql"), ()),
    ("make", "Makefile", (".mk",), ("Makefile", "makefile", "GNUmakefile")),
    ("vue", "Vue", (".vue",), ()),
    ("svelte", "Svelte", (".svelte",), ()),
)
NOT_CODE = (
    ("sql", "SQL", (".sql",), ()),
    ("hcl", "HCL / Terraform", (".tf", ".tfvars", ".hcl"), ()),
    ("dockerfile", "Dockerfile", (), ("Dockerfile",)),
    ("cmake", "CMake", (".cmake",), ("CMakeLists.txt",)),
    ("css", "CSS", (".css",), ()),
    ("scss", "SCSS", (".scss",), ()),
    ("html", "HTML", (".html", ".htm"), ()),
    ("xml", "XML", (".xml", ".xsd", ".xsl"), ()),
    ("json", "JSON", (".json",), ()),
    ("yaml", "YAML", (".yaml", ".yml"), ()),
    ("toml", "TOML", (".toml",), ()),
    ("markdown", "Markdown", (".md", ".markdown"), ()),
    ("rst", "reStructuredText", (".rst",), ()),
    ("csv", "CSV", (".csv", ".tsv"), ()),
    ("ini", "INI", (".ini", ".cfg"), ()),
    ("gitignore", "gitignore", (), (".gitignore",)),
    ("requirements", "Python requirements", (), ("requirements.txt",)),
    ("gomod", "Go module", (), ("go.mod",)),
)


def rows() -> list[tuple[str, str, list[str], list[str], bool, bool]]:
    """(key, display name, extensions, file names, is code, has extraction rules) of every language."""
    blocks = ((EXTRACTED, True, True), (PARSE_ONLY, True, False), (NOT_CODE, False, False))
    return [(key, display, list(extensions), list(names), code, extracted) for block, code, extracted in blocks for key, display, extensions, names in block]


def dimension(spark: SparkSession) -> DataFrame:
    """language, display_name, extensions, filenames, is_code, is_extractable: one row per language."""
    return spark.createDataFrame(rows(), "language string, display_name string, extensions array<string>, filenames array<string>, is_code boolean, is_extractable boolean")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))
    return F.try_element_at(table, key)


def detect(path: Column) -> Column:
    """The language of a path: by exact file name, by the name in lower case, by the last extension."""
    names: dict[str, str] = {}
    extensions: dict[str, str] = {}
    for key, _, exts, files, _, _ in rows():
        for f in files:
            names.setdefault(f, key)
        for e in exts:
            extensions.setdefault(e.lower(), key)
    name = F.element_at(F.split(path, "/"), -1)
    low = F.lower(name)
    extension = F.regexp_extract(low, r"^.+(\.[^.]*)$", 1)
    return F.coalesce(_lookup(names, name), _lookup(names, low), _lookup(extensions, extension))


def is_code(language: Column) -> Column:
    return F.coalesce(language.isin([r[0] for r in rows() if r[4]]), F.lit(False))


def is_extractable(language: Column) -> Column:
    return F.coalesce(language.isin([r[0] for r in rows() if r[5]]), F.lit(False))


def display_name(language: Column) -> Column:
    """``Unknown`` for null; a key that isn't registered stands for itself."""
    return F.when(language.isNull(), "Unknown").otherwise(F.coalesce(_lookup({r[0]: r[1] for r in rows()}, language), language))


def summary(spark: SparkSession) -> DataFrame:
    """One row: registered, code_languages, extensions, filenames, extractable."""
    d = dimension(spark)
    spread = d.select(F.explode(F.transform("extensions", F.lower)).alias("e")).agg(F.countDistinct("e").alias("extensions"))
    named = d.select(F.explode("filenames").alias("f")).agg(F.countDistinct("f").alias("filenames"))
    counts = d.agg(F.count("*").alias("registered"), F.count_if("is_code").alias("code_languages"), F.count_if("is_extractable").alias("extractable"))
    return counts.crossJoin(spread).crossJoin(named)  # three tables of one row
