"""Structural summaries, import references and change classes of source texts, as Spark expressions.

Every rule is a regular expression that Spark evaluates in the JVM; texts never pass
through Python. Patterns are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import basename, dirname, extname, resolve_segments, typed_extension
from treeledger.functions.text import line_count

SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts")


def _one(*words: str) -> str:
    return f"(?:{'|'.join(words)})"


def _some(*words: str) -> str:
    """Any number of the words, each with a gap behind."""
    return f"(?:{_one(*words)}[ \\t]+)*"


# Parts that the patterns are made of. A head is what stands at the start of a line.
_HEAD, _GAP, _NAMED, _QUOTED = "(?m)^", r"[ \t]+", r"(\w+)", r"""["']([^"']+)["']"""
_SCRIPT_KIND = _one("class", "const", "enum", "function", "interface", "let", "type", "var")
_RUST_KINDS = ("const", "enum", "fn", "mod", "static", "struct", "trait", "type")
_RECEIVER = r"(?:\([^()]*\)[ \t]*)?"
#: Go: what stands between keyword and name, and behind the name.
_GO_KINDS = {"func": (_RECEIVER, ""), "type": ("", _GAP + _one("interface", "struct")), "var": ("", ""), "const": ("", "")}

# (pattern, group) for lists of names, in the order in which names are listed.
EXPORTS = {
    "script": [(rf"{_HEAD}export{_GAP}{_some('default', 'async', 'abstract')}{_SCRIPT_KIND}[ \t*]+{_NAMED}", 1)],
    "python": [(rf"{_HEAD}{_some('async')}{_one('class', 'def')}{_GAP}([A-Za-z]\w*)", 1)],
    "go": [(rf"{_HEAD}{kind}{_GAP}{before}([A-Z]\w*){after}", 1) for kind, (before, after) in _GO_KINDS.items()],
    "rust": [(rf"{_HEAD}pub{_GAP}{_some('async')}{_one(*_RUST_KINDS)}{_GAP}{_NAMED}", 1)],
}
IMPORTS = {
    "script": [(rf"{_HEAD}import{_GAP}[^\n]*?[ \t]from{_GAP}{_QUOTED}", 1), (rf"{_HEAD}import{_GAP}{_QUOTED}", 1)],
    "python": [(rf"{_HEAD}from{_GAP}(\S+){_GAP}import\b", 1), (rf"{_HEAD}import{_GAP}([\w.]+)", 1)],
    "go": [(rf'\bimport{_GAP}(?:\w+{_GAP})?"([^"]+)"', 1)],
    "rust": [(rf"{_HEAD}{_some('pub')}use{_GAP}([\w:]+(?:\{{[^}}]*\}})?)\s*;", 1), (rf"{_HEAD}[ \t]*mod{_GAP}{_NAMED}[ \t]*;", 1)],
}
DECLARATIONS = {
    "script": rf"{_HEAD}{_some('export', 'declare', 'abstract', 'async')}({_SCRIPT_KIND}[ \t*]+\w+)",
    "python": rf"{_HEAD}{_some('async')}({_one('class', 'def')}{_GAP}\w+)",
    "go": f"{_HEAD}({_one(*(kind + _GAP + before + _NAMED.strip('()') + after for kind, (before, after) in _GO_KINDS.items()))})",
    "rust": rf"{_HEAD}{_some('pub', 'async')}({_one('impl', *_RUST_KINDS)}{_GAP}\w+)",
}
OTHER_PURPOSES = {
    ".json": "config", ".yml": "config", ".yaml": "config", ".env": "config", ".md": "documentation", ".css": "styles", ".scss": "styles", ".less": "styles", ".html": "markup",
    ".svg": "asset", ".png": "asset", ".jpg": "asset", ".jpeg": "asset", ".gif": "asset", ".sh": "script", ".bash": "script", ".lock": "lockfile",
}


def _all(text: Column, rules: list[tuple[str, int]]) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in rules]))


def family(path: Column) -> Column:
    """Family of extraction rules by extension; null for other files."""
    ext = typed_extension(path)
    return F.when(ext.isin(*SCRIPT), "script").when(ext == ".py", "python").when(ext == ".go", "go").when(ext == ".rs", "rust")


def _per_family(path: Column, make) -> Column:
    f = family(path)
    out = F.when(f == "script", make("script"))
    for name in ("python", "go", "rust"):
        out = out.when(f == name, make(name))
    return out.otherwise(F.array().cast("array<string>"))


#: The list of names that a Python file exports.
LISTED = r"__all__\s*=\s*\[([^\]]*)\]"


def exports(path: Column, text: Column) -> Column:
    """Exported names in the order of their first mention; ``__all__`` overrides a Python file's."""

    def make(name: str) -> Column:
        found = _all(text, EXPORTS[name])
        if name == "script":
            default = text.rlike(r"(?m)^export\s+default\s+")
            return F.when(default & ~F.array_contains(found, "default"), F.concat(found, F.array(F.lit("default")))).otherwise(found)
        if name == "python":
            listed = F.regexp_extract(text, LISTED, 1)
            names = F.transform(F.split(listed, ","), lambda s: F.regexp_replace(s, r"""^\s+|\s+$|['"]""", ""))
            return F.when(text.rlike(LISTED), F.array_distinct(F.filter(names, lambda s: s != ""))).otherwise(found)
        return found

    return _per_family(path, make)


def imports(path: Column, text: Column) -> Column:
    """Imported modules as written."""

    def make(name: str) -> Column:
        found = _all(text, IMPORTS[name])
        if name == "go":
            groups = F.regexp_extract_all(text, F.lit(r"\bimport\s*\(([\s\S]*?)\)"), F.lit(1))
            grouped = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit('"([^"]+)"'), F.lit(1))))
            return F.array_distinct(F.concat(grouped, found))
        return found

    return _per_family(path, make)


def modules(path: Column, text: Column) -> Column:
    """As ``imports``, with Kotlin and Java."""
    plain = lambda passes: F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(m)) for p, _, m, _ in passes]))
    f = import_family(path)
    return F.when(f == "kotlin", plain(KOTLIN_PASSES)).when(f == "java", plain(JAVA_PASSES)).otherwise(imports(path, text))


def declarations(path: Column, text: Column) -> Column:
    """Declarations at the start of a line as ``kind name``."""

    def make(name: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(DECLARATIONS[name]), F.lit(1))
        tidy = F.transform(found, lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(d, r"^func[ \t]+\([^()]*\)", "func "), r"\s*\*", " "), r"\s+", " "))
        return F.array_distinct(tidy)

    return _per_family(path, make)


def purpose(path: Column, text: Column) -> Column:
    """Class of a file by its name, then by its text; the first rule that fits counts."""
    base, ext = basename(path), typed_extension(path)
    main = text.rlike(r"\bmain\s*\(")
    python = (
        F.when(base.startswith("test_") | base.endswith("_test.py") | path.contains("/tests/") | path.contains("/test/") | (base == "conftest.py"), "test")
        .when(base.isin("setup.py", "settings.py", "config.py"), "config")
        .when(base.isin("__init__.py", "__main__.py") | text.rlike(r"""\bif\s+__name__\s*==\s*['"]__main__['"]\s*:"""), "entry point")
        .otherwise("source")
    )
    go = F.when(base.endswith("_test.go"), "test").when((base == "main.go") | text.rlike(r"\bfunc\s+main\s*\("), "entry point").otherwise("source")
    rust = (
        F.when(path.contains("/tests/") | base.startswith("test_"), "test")
        .when(base.isin("main.rs", "lib.rs", "mod.rs"), "entry point")
        .when(base == "build.rs", "config")
        .when(text.rlike(r"\bfn\s+main\s*\("), "entry point")
        .otherwise("source")
    )
    others = F.element_at(F.create_map(*[F.lit(x) for p in OTHER_PURPOSES.items() for x in p]), ext)
    code = (
        F.when(ext == ".d.ts", "types")
        .when(base.rlike(r"\.(?:test|spec)\.[tj]sx?$"), "test")
        .when(base.rlike(r"\.config\.(?:[tj]sx?|mjs)$"), "config")
        .when(base.isin("types.ts", "interfaces.ts"), "types")
        .when(base.isin("index.ts", "index.js"), "entry point")
        .when(ext == ".py", python)
        .when(ext == ".go", go)
        .when(ext == ".rs", rust)
        .when(path.contains("/bin/") | main, "entry point")
        .otherwise("source")
    )
    return F.when(family(path).isNotNull(), code).otherwise(F.coalesce(others, F.lit("other")))


def summarise(files: DataFrame, *keep: str) -> DataFrame:
    """(path, summary) of each row of ``files`` (path, contents) by regular expressions, with the columns to ``keep``.

    Null contents give a null summary, empty ones low confidence; files of other languages
    have a purpose only.
    """
    p, t = F.col("path"), F.col("contents")
    lists = files.select("path", "contents", *keep, exports(p, t).alias("exports"), imports(p, t).alias("imports"), declarations(p, t).alias("declarations"), purpose(p, t).alias("purpose"), line_count(t).alias("lines"))
    none = (F.size("exports") == 0) & (F.size("imports") == 0) & (F.size("declarations") == 0)
    clear = F.col("purpose").isin("entry point", "config", "types", "test")
    code = F.when((F.col("lines") == 0) | none, "low").when((F.size("exports") > 0) | clear, "high").otherwise("medium")
    plain = F.when((F.col("lines") > 0) & typed_extension(p).isin(".json", ".yaml", ".yml", ".toml"), "medium").otherwise("low")
    summary = F.struct(
        "purpose", "exports", "imports", F.col("lines").alias("lineCount"), F.col("declarations").alias("topLevelDeclarations"),
        F.when(family(p).isNotNull(), code).otherwise(plain).alias("confidence"),
    )
    return lists.select("path", *keep, F.when(t.isNotNull(), summary).alias("summary"))


# Passes over a text, in order: pattern, place of the specifiers (0 none, -1 '*', -2 namespace), place of the module, type.
_BOUND, _BRACED, _ALL = r"([A-Za-z_$][\w$]*)", r"\{([^{}]*)\}", r"\*"


def _from(keyword: str, what: str) -> str:
    return rf"\b{keyword}\s*{what}\s*\bfrom\s*{_QUOTED}"


def _call(name: str) -> str:
    return rf"\b{name}\(\s*{_QUOTED}\s*\)"


SCRIPT_PASSES = (
    (_from("import", rf"(?:\btype\b)?\s*{_BRACED}"), 1, 2, "static"),
    (_from("import", rf"\s{_BOUND}"), 1, 2, "static"),
    (_from("import", rf"{_ALL}\s*as\s+{_BOUND}"), -2, 2, "static"),
    (rf"\bimport\s*{_QUOTED}", 0, 1, "static"),
    (_call("import"), 0, 1, "dynamic"),
    (_from("export", _BRACED), 1, 2, "re-export"),
    (_from("export", _ALL), -1, 1, "re-export"),
    (_call("require"), 0, 1, "static"),
)
PYTHON_PASSES = (
    (r"(?m)^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)", 0, 1, "static"),
    # In brackets the names up to the closing one, else those of the line.
    (r"(?m)^[ \t]*from[ \t]+(\.{0,3}[\w.]*)[ \t]+import\b[ \t]*\(?((?<=\()[^)]*(?=\))|[^(;\n]+)\)?", 2, 1, "static"),
)

_ALIASED = r"""(?:([\w.]+)[ \t]+)?"([^"]+)\""""
GO_PASSES = ((rf"\bimport[ \t]+{_ALIASED}", 1, 2, "static"),)
GO_GROUP, GO_GROUPED = r"\bimport\s*\(([^()]*)\)", ((_ALIASED, 1, 2, "static"),)
RUST_PASSES = ((r"\b(?:pub\s+)?use\s+([\w:]+)::\{([^}]*)\}\s*;", 2, 1, "static"), (r"\b(?:pub\s+)?use\s+([\w:]+)\s*;", 0, 1, "static"), (r"\bmod\s+(\w+)\s*;", 0, 1, "static"))
KOTLIN_PASSES = (
    (r"(?m)^[ \t]*import\s+([\w.]+)\.\*[ \t]*;?[ \t\r]*$", -1, 1, "static"),
    (r"(?m)^[ \t]*import\s+([\w.]+)\s+as\s+(\w+)[ \t]*;?[ \t\r]*$", 2, 1, "static"),
    (r"(?m)^[ \t]*import\s+([\w.]*\w)[ \t]*;?[ \t\r]*$", 0, 1, "static"),
)
JAVA_PASSES = (
    (r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+)\.\*\s*;", -1, 1, "static"),
    (r"(?m)^[ \t]*import\s+static\s+([\w.]+)\.(\w+)\s*;", 2, 1, "static"),
    (r"(?m)^[ \t]*import\s+(?!static\b)([\w.]*\w)\s*;", 0, 1, "static"),
)


def import_family(path: Column) -> Column:
    """As ``family``, with Kotlin and Java."""
    ext = typed_extension(path)
    return F.coalesce(family(path), F.when(ext.isin(".kt", ".kts"), "kotlin").when(ext == ".java", "java"))


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def _pass(text: Column, number: int, pattern: str, names: int, module: int, kind: str) -> Column:
    """References of one pass, as (pass, module, names, import_type).

    The text is searched once; what the groups hold is read from the short matches.
    """

    def ref(match: Column) -> Column:
        listed = F.lit("*" if names == -1 else "") if names in (0, -1) else F.regexp_extract(match, pattern, max(names, 1))
        told = F.concat(F.lit("* as "), listed) if names == -2 else listed
        return F.struct(F.lit(number).alias("pass"), F.regexp_extract(match, pattern, module).alias("module"), told.alias("names"), F.lit(kind).alias("import_type"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), ref)


def _refs(text: Column, passes) -> Column:
    """References of all passes, in order."""
    return F.concat(*[_pass(text, n, *p) for n, p in enumerate(passes)])


def import_refs(files: DataFrame) -> DataFrame:
    """(source, ordinal, module, specifiers, import_type) read from sources of six languages.

    Aliases keep the original name, but for Go and Kotlin, where the alias is told; ``*``
    stands for all names. Comments and long strings are left out first, but for scripts.
    Rust, Kotlin and Java modules are told as paths. ``ordinal`` follows the passes, so of
    equal references the one with the greatest counts. Null contents give none.
    """
    f, t = import_family(F.col("path")), F.col("contents")
    c_style = _without(t, r"/\*[\s\S]*?\*/", r"//[^\n]*")
    cleaned = {
        "script": t,
        "python": F.regexp_replace(_without(t, r"'''[\s\S]*?'''", r'"""[\s\S]*?"""', r"#[^\n]*"), r"\\\r?\n", " "),
        "go": _without(c_style, r"`[^`]*`"),
        "rust": _without(c_style, r'r#+"[\s\S]*?"#+'),
        "kotlin": _without(c_style, r'"""[\s\S]*?"""'),
        "java": _without(c_style, r'"""[\s\S]*?"""'),
    }
    by_family = lambda columns: reduce(lambda out, kv: F.when(F.col("family") == kv[0], kv[1]).otherwise(out), columns.items(), F.lit(None))
    # Each text is cleaned once, before the passes read it.
    texts = files.where(t.isNotNull() & f.isNotNull()).select(F.col("path").alias("source"), f.alias("family"), "contents").select("source", "family", by_family(cleaned).alias("plain"))
    plain = F.col("plain")
    found = {
        "script": _refs(plain, SCRIPT_PASSES),
        "python": _refs(plain, PYTHON_PASSES),
        "go": F.concat(_refs(plain, GO_PASSES), _refs(F.array_join(F.regexp_extract_all(plain, F.lit(GO_GROUP), F.lit(1)), "\n"), GO_GROUPED)),
        "rust": _refs(plain, RUST_PASSES),
        "kotlin": _refs(plain, KOTLIN_PASSES),
        "java": _refs(plain, JAVA_PASSES),
    }
    rows = texts.select("source", "family", F.posexplode(by_family(found)).alias("ordinal", "r"))
    # `import a, b` of Python names several modules at once; other languages spell paths in their own way.
    several = (F.col("family") == "python") & (F.col("r.pass") == 0)
    own = F.col("r.module")
    spelled = (
        F.when((F.col("family") == "rust") & (F.col("r.pass") == 2), F.concat(F.lit("./"), own))
        .when(F.col("family") == "rust", F.regexp_replace(own, "::", "/"))
        .when(F.col("family").isin("kotlin", "java"), F.translate(own, ".", "/"))
        .otherwise(own)
    )
    modules = F.when(several, F.transform(F.split(own, ","), lambda s: F.regexp_replace(F.trim(s), r"\s+as\s+.*$", ""))).otherwise(F.array(spelled))
    names = F.filter(F.transform(F.split("r.names", ","), lambda s: F.when(s.startswith("* as "), s).otherwise(F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r" as .*$", ""))), lambda s: s != "")
    return rows.select("source", "ordinal", F.explode(modules).alias("module"), names.alias("specifiers"), F.col("r.import_type").alias("import_type"))


# What a script's module may stand for.
PROBES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
SWAPS = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


def module_base(source: Column, module: Column, root: Column) -> Column:
    """Path, without what may be added to it, that a reference means; null for modules that are no paths."""
    below = lambda folder, rest: resolve_segments(F.concat(folder, F.lit("/"), rest))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = F.concat(dirname(source), F.when(dots > 1, F.repeat(F.lit("/.."), dots - 1)).otherwise(""))
    python = below(F.when(dots > 0, up).otherwise(root), F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/"))
    beside = below(dirname(source), F.regexp_replace(F.regexp_replace(module, "^self/", ""), r"\bsuper/", "../"))
    f = _asking(source, module)
    return (
        F.when((f == "script") & module.startswith("."), below(dirname(source), module))
        .when(f == "python", python)
        .when(f == "crate", below(root, F.regexp_replace(module, "^crate/", "")))
        .when((f == "rust") & module.rlike(r"^(?:super|self|\.)/"), beside)
    )


def _asking(source: Column, module: Column) -> Column:
    """Family of a reference: that of its source, but ``crate`` for Rust paths that start at the project."""
    f = import_family(source)
    return F.when((f == "rust") & module.startswith("crate/"), "crate").otherwise(f)


def _answers(path: Column, root: Column) -> Column:
    """Array of (family, base, place): the bases that a file answers to, the best with the least place.

    A file answers to its own path, a script also to its path without extension or with a
    swapped one, and to its folder when it is the index; Python and Rust files likewise. For
    ``crate`` paths a file below ``src`` of its project also answers as if it were below the project.
    """
    ext, stem = extname(path), F.regexp_replace(path, r"\.[^./]*$", "")
    folder, name = dirname(path), basename(path)
    bare = extname(stem) == ""  # only a base without an extension gets one
    answer = lambda family, base, place: F.struct(F.lit(family).alias("family"), base.alias("base"), F.lit(place).alias("place"))
    out = [answer(f, path, 0) for f in ("script", "python", "rust", "crate")]
    for old, new in SWAPS.items():
        out += [F.when(ext == x, answer("script", F.concat(stem, F.lit(old)), 1 + n)) for n, x in enumerate(new)]
    for n, x in enumerate(PROBES):
        out += [F.when((ext == x) & bare, answer("script", stem, 10 + n)), F.when(name == "index" + x, answer("script", folder, 20 + n))]
    for family, x, index in (("python", ".py", "__init__.py"), ("rust", ".rs", "mod.rs"), ("crate", ".rs", "mod.rs")):
        out += [F.when(ext == x, answer(family, stem, 10)), F.when(name == index, answer(family, folder, 20))]
    src = F.when(root == "", F.lit("src/")).otherwise(F.concat(root, F.lit("/src/")))
    hoisted = lambda base: F.concat(F.when(root == "", F.lit("")).otherwise(F.concat(root, F.lit("/"))), F.substring(base, F.length(src) + 1, F.length(base)))
    inside = path.startswith(src)
    out += [F.when(inside, answer("crate", hoisted(path), 30)), F.when(inside & (ext == ".rs"), answer("crate", hoisted(stem), 40)), F.when(inside & (name == "mod.rs"), answer("crate", hoisted(folder), 50))]
    return F.array_compact(F.array(*out))


def resolve_refs(refs: DataFrame, files: DataFrame, root: Callable[[Column], Column] | None = None) -> DataFrame:
    """``refs`` with target and external: the first file that its module may mean, else the path or module as written.

    No file system is asked: each file tells the few bases that it answers to, the best file
    of each base is kept, and every reference finds it by one join. ``root`` gives the folder
    of a path's project; without it paths start there. Relative modules of no file keep their
    resolved path. Null modules are external.
    """
    at = root or (lambda _: F.lit(""))
    told = files.where(F.col("path").isNotNull()).select("path", F.explode(_answers(F.col("path"), at(F.col("path")))).alias("a"))
    best = told.groupBy(F.col("a.family").alias("family"), F.col("a.base").alias("base")).agg(F.min(F.struct("a.place", "path")).getField("path").alias("file"))
    source, module = F.col("source"), F.col("module")
    asked = refs.select("source", "ordinal", "module", "specifiers", "import_type", _asking(source, module).alias("family"), module_base(source, module, at(source)).alias("base"))
    rows = asked.join(best, ["family", "base"], "left")
    own = (
        F.when((F.col("family") == "python") & ~module.startswith("."), F.translate(module, ".", "/"))
        .when(F.col("family") == "crate", F.regexp_replace(module, "^crate/", ""))
        .otherwise(F.coalesce("base", module))
    )
    return rows.select("source", "ordinal", "module", F.coalesce("file", own).alias("target"), "specifiers", "import_type", F.col("file").isNull().alias("external"))


#: A line that exports, imports or declares.
_STRUCTURE_KIND = _one("class", "enum", "function", "interface", "type")
STRUCTURAL = rf"^\s*(?:import\s|export\s+(?:default\s|[*{{])|export\s+(?:default\s+)?(?:{_STRUCTURE_KIND}|const|let|var)\b|(?:abstract\s+)?{_STRUCTURE_KIND}\s+\w)"


def version_pairs(versions: DataFrame) -> DataFrame:
    """(path, mtime, contents, before): each version of a text with the one before; the first has null.

    Rows without path, contents or mtime are left out, repeated ones count once.
    """
    rows = versions.where(F.col("path").isNotNull() & F.col("contents").isNotNull() & F.col("mtime").isNotNull()).select("path", "mtime", "contents").distinct()
    return rows.withColumn("before", F.lag("contents").over(Window.partitionBy("path").orderBy("mtime", "contents")))


def _changed_lines(pairs: DataFrame) -> DataFrame:
    """(path, mtime, version, n_added, n_removed, structural) of ``version_pairs`` that have a version before."""
    sides = F.array(F.struct(F.split("contents", "\n", -1).alias("lines"), F.lit(1).alias("sign")), F.struct(F.split("before", "\n", -1).alias("lines"), F.lit(-1).alias("sign")))
    lines = pairs.where(F.col("before").isNotNull()).select("path", "mtime", F.xxhash64("contents").alias("version"), F.explode(sides).alias("s")).select("path", "mtime", "version", "s.sign", F.explode("s.lines").alias("line"))
    # The window has spread the rows by path, which serves both groupings.
    net = lines.groupBy("path", "mtime", "version", "line").agg(F.sum("sign").alias("net"))
    return net.groupBy("path", "mtime", "version").agg(
        F.sum(F.greatest("net", F.lit(0))).alias("n_added"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("n_removed"), F.max((F.col("net") != 0) & F.col("line").rlike(STRUCTURAL)).alias("structural")
    )


def diff_classes(versions: DataFrame) -> DataFrame:
    """(path, mtime, n_added, n_removed, structural, lines_changed) of each version against the one before.

    ``versions``: path, contents, mtime; as in ``version_pairs``. Lines are compared as
    multisets, so a repeated line counts as often as it was added or removed, and a moved one
    is no change. ``structural`` when an added or removed line exports, imports or declares;
    ``lines_changed`` when the counts differ.
    """
    return _changed_lines(version_pairs(versions)).select("path", "mtime", "n_added", "n_removed", "structural", (F.col("n_added") != F.col("n_removed")).alias("lines_changed"))


def smart_summaries(versions: DataFrame) -> DataFrame:
    """(path, mtime, summary_source, summary) of each version of a text.

    The summary of the version before is kept, with a new line count, while the difference is
    not structural (``diff-partial``); a first version, an unchanged text and one that changed
    in structure are summarised anew (``full``). ``versions`` as in ``version_pairs``.
    """
    pairs = version_pairs(versions)
    partial = ~F.col("structural") & (F.col("n_added") + F.col("n_removed") > 0)
    classes = _changed_lines(pairs).select("path", "mtime", "version", partial.alias("partial"))
    told = pairs.withColumn("version", F.xxhash64("contents")).join(classes, ["path", "mtime", "version"], "left").withColumn("partial", F.coalesce("partial", F.lit(False)))
    read = told.select("path", "mtime", "partial", F.when(F.col("partial"), F.col("before")).otherwise(F.col("contents")).alias("contents"), line_count(F.col("contents")).alias("now"))
    made = summarise(read, "mtime", "partial", "now")
    return made.select("path", "mtime", F.when(F.col("partial"), "diff-partial").otherwise("full").alias("summary_source"), F.col("summary").withField("lineCount", F.col("now")).alias("summary"))
