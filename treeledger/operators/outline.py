"""Outlines of source texts: what a file declares, with method counts and docs, and a line on its purpose.

Rules look at declarations that start a line, as formatted sources have them; they are
regular expressions that Spark evaluates in the JVM. Bodies and comment blocks reach to the
line that ends them, however long: their loops are possessive, which the JVM runs without
recursion. Every rule gives (doc, exported, kind,
name, body); a missing part is the empty string.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import basename, typed_extension
from treeledger.functions.text import line_count
from treeledger.operators import extract

MOST = 160
_BLOCK_DOC = r"(?:/\*\*[ \t]*\r?\n?[ \t]*\*?[ \t]*([^\n*]*)[^*]*+(?:\*(?!/)[^*]*+)*+\*/[ \t]*\r?\n)?"
_SLASH_DOC = r"(?://[ \t]?([^\n]*)\n(?://[^\n]*\n)*+)?"
_RUST_DOC = r"(?:///[ \t]?([^\n]*)\n(?://[^\n]*\n)*+)?(?:#\[[^\n]*\n)*+"
#: Up to the brace that ends the line, or the one that starts a later one, or to the next declaration or the end where that one is missing.
_BRACED = r"\{([^\n]*(?=\}[ \t\r]*$)|[\s\S]*?(?=^\}|^(?:\w+[ \t]+)*?(?:class|interface|object|enum|record|struct)[ \t]+\w|\z))\}?"
_BODY = rf"(?:[^{{;]*{_BRACED})?"


_DECLARED = "array<struct<doc:string,exported:boolean,kind:string,name:string,body:string>>"


@dataclass(frozen=True)
class Rules:
    classes: str
    functions: str | None  # None where the language has none outside of classes
    types: str | None
    constants: str | None
    method: str
    exported: str  # regular expression that the exported part, or the name, must match
    by_name: bool = False
    file_doc: str = r"\A\s*/\*\*?[ \t]*\r?\n?[ \t]*\*?[ \t]*([^\n*/]+)"
    members: str | None = None  # names that an exported class exports itself


# The rules of each language. Groups: doc, exported part, kind, name, body.
RULES = {
    "script": Rules(
        rf"(?m)^{_BLOCK_DOC}((?:export\s+)?)(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(class)\s+(\w+){_BODY}",
        rf"(?m)^{_BLOCK_DOC}((?:export\s+)?)(?:default\s+)?(?:declare\s+)?(?:async\s+)?(function)\s*\*?\s*(\w+)()",
        r"(?m)^()((?:export\s+)?)(?:declare\s+)?(?:const\s+)?(interface|type|enum)\s+(\w+)()",
        r"(?m)^()((?:export\s+)?)(const)\s+(\w+)()",
        r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set|override|abstract)\s+)*\*?#?(?!constructor\b|if\b|for\b|while\b|switch\b|catch\b|return\b)[\w$]+\s*(?:<[^>\n]*>)?\([^)]*\)[^;{=]*\{",
        "export",
    ),
    "python": Rules(
        r"(?m)^()()(class)\s+(\w+)[^\n]*(?:\n|\z)((?:(?:[ \t]++[^\n]*+)?+\n)*+(?:[ \t]+[^\n]*)?)",
        r"(?m)^()()(?:async\s+)?(def)\s+(\w+)()",
        r"(?m)^()()(type)\s+(\w+)\s*=()",
        r"(?m)^()()()([A-Z][A-Z0-9_]*)\s*(?::[^=\n]*)?=()",
        r"(?m)^(?:    |\t)(?:async\s+)?def\s+(?!__init__\b)\w+",
        "^[^_]", True, r"""\A(?:\s*#[^\n]*\n)*+\s*(?:\"\"\"|\'\'\')[ \t]*\n?[ \t]*([^\n"']+)""",
    ),
    "go": Rules(
        rf"(?m)^{_SLASH_DOC}()type\s+()(\w+)\s+struct\b{_BODY}",
        rf"(?m)^{_SLASH_DOC}()(func)\s+(\w+)\s*(?:\[[^\]]*\])?\(()",
        r"(?m)^()()type\s+()(\w+)\s+(?!struct\b)()\S",
        r"(?m)^()()(const|var)\s+(\w+)()",
        "",
        "^[A-Z]", True, r"(?m)^//[ \t]?([^\n]+)\n(?://[^\n]*\n)*+package\b",
    ),
    "rust": Rules(
        rf"(?m)^{_RUST_DOC}((?:pub\s+)?)(struct|enum|trait)\s+(\w+)()",
        rf"(?m)^{_RUST_DOC}((?:pub\s+)?)(?:const\s+|async\s+|unsafe\s+)*(fn)\s+(\w+)()",
        r"(?m)^()((?:pub\s+)?)(type)\s+(\w+)()",
        r"(?m)^()((?:pub\s+)?)(const|static)\s+(\w+)()",
        r"(?m)^[ \t]+(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+\w+",
        "pub", False, r"(?m)\A\s*//![ \t]?([^\n]+)",
    ),
    "kotlin": Rules(
        rf"(?m)^{_BLOCK_DOC}((?:(?:public|private|internal|protected|open|abstract|sealed|inline|value|annotation|fun)\s+)*)((?:data |enum )?class|interface|object)\s+(\w+)(?:[^{{;\n]*{_BRACED})?",
        rf"(?m)^{_BLOCK_DOC}((?:(?:public|private|internal|inline|suspend|operator|infix|tailrec)\s+)*)(fun)\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(\w+)\s*\(()",
        r"(?m)^()((?:(?:public|private|internal)\s+)*)(typealias)\s+(\w+)()",
        r"(?m)^()((?:(?:public|private|internal|const)\s+)*)(val|var)\s+(\w+)()",
        r"(?m)^[ \t]+(?:(?:public|private|internal|protected|open|override|abstract|inline|suspend|operator|infix|tailrec|final)\s+)*fun\s+",
        r"^(?![\s\S]*\b(?:private|internal|protected)\b)",
    ),
    "java": Rules(
        rf"(?m)^{_BLOCK_DOC}((?:(?:public|protected|private|abstract|final|sealed|non-sealed|static|strictfp)\s+)*)(class|interface|enum|record|@interface)\s+(\w+){_BODY}",
        None, None, None,
        r"(?m)^(?:    |\t)(?:(?:public|protected|private|abstract|final|static|synchronized|default|native)\s+)*(?:<[^>\n]*>\s*)?[\w<>\[\], ?.]+\s+\w+\s*\([^)]*\)[^;{=]*[{;]",
        "public", members=r"(?m)^(?:    |\t)public\s+[^\n(=;{]*?\b(\w+)\s*[(=;{]",
    ),
}


def _declared(text: Column, pattern: str, rules: Rules) -> Column:
    """Declarations of one rule, as (doc, exported, kind, name, body).

    The text is searched once; what the groups hold is read from the matches.
    """

    def declaration(match: Column) -> Column:
        doc, mark, kind, name, body = (F.regexp_extract(match, pattern, n) for n in range(1, 6))
        exported = name.rlike(rules.exported) if rules.by_name else mark.rlike(rules.exported)
        return F.struct(first_sentence(doc).alias("doc"), exported.alias("exported"), kind.alias("kind"), name.alias("name"), body.alias("body"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), declaration)


def first_sentence(line: Column) -> Column:
    """Up to the first full stop that white space follows."""
    return F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), r"^(.*?\.)\s.*$", "$1")


def list_names(names: Column, most: int) -> Column:
    """The first names, and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, F.concat(F.lit(" (+"), (F.size(names) - most).cast("string"), F.lit(" more)"))).otherwise(""))


def category(path: Column, text: Column) -> Column:
    """Class of a file by its name; null when the name tells none."""
    base, ext = basename(path), typed_extension(path)
    tests = path.rlike(r"(?:^|/)tests?/")
    python = (
        F.when(base.startswith("test_") | base.endswith("_test.py") | (base == "conftest.py") | tests, "test")
        .when(base.isin("setup.py", "settings.py", "config.py"), "config")
        .when(base.isin("__init__.py", "__main__.py") | text.rlike(r"""\bif\s+__name__\s*==\s*['"]__main__['"]\s*:"""), "entry point")
    )
    kotlin = F.when(base.rlike(r"Test\.kts?$") | tests | path.contains("/androidTest/"), "test").when(base.endswith(".gradle.kts"), "config").when(base == "Main.kt", "entry point")
    return (
        F.when(ext == ".py", python)
        .when(ext == ".go", F.when(base.endswith("_test.go"), "test").when(base == "main.go", "entry point"))
        .when(ext == ".rs", F.when(tests | base.startswith("test_"), "test").when(base.isin("main.rs", "lib.rs", "mod.rs"), "entry point").when(base == "build.rs", "config"))
        .when(ext.isin(".kt", ".kts"), kotlin)
        .when(ext == ".java", F.when(base.rlike(r"Tests?\.java$") | tests, "test").when(base == "Main.java", "entry point"))
        .when(ext == ".d.ts", "types")
        .when(base.rlike(r"\.(?:test|spec)\.[tj]sx?$"), "test")
        .when(base.rlike(r"\.config\.(?:[tj]sx?|mjs)$"), "config")
        .when(base.isin("types.ts", "interfaces.ts"), "types")
        .when(base.rlike(r"^index\.[tj]sx?$"), "entry point")
    )


def _by_language(make: Callable[[str, Rules], Column]) -> Column:
    """The column that the rules of the row's language make; one scan serves all languages."""
    out = F.lit(None)
    for name, rules in RULES.items():
        out = F.when(F.col("language") == name, make(name, rules)).otherwise(out)
    return out


def _names(items: Column) -> Column:
    return F.transform(items, lambda x: x["name"])


def _shown(items: Column) -> Column:
    """The exported ones, or all when none is."""
    public = F.filter(items, lambda x: x["exported"])
    return F.when(F.size(public) > 0, public).otherwise(items)


def _outlined(files: DataFrame, *keep: str) -> DataFrame:
    """Rows of the six languages with language, purpose, and the lists classes, functions, types and constants."""
    t = F.col("contents")
    rows = files.where(t.isNotNull()).select("path", "contents", *keep, extract.import_family(F.col("path")).alias("language")).where(F.col("language").isNotNull())
    listed = lambda n: F.coalesce(_by_language(lambda _, r: _declared(t, getattr(r, n), r) if getattr(r, n) else F.lit(None)), F.array().cast(_DECLARED)).alias(n)
    lists = rows.select("*", *map(listed, ("classes", "functions", "types", "constants")), _by_language(lambda _, r: first_sentence(F.regexp_extract(t, r.file_doc, 1))).alias("file_doc"))
    out = lists.withColumn("shown", _shown(F.col("classes"))).withColumn("counts", _by_language(_method_counts))
    shown, fns = F.col("shown"), _shown(F.col("functions"))
    most = F.array_max("counts")
    place = F.array_position("counts", most).cast("int")
    primary = F.element_at(shown, place)
    others = F.filter(_names(shown), lambda n: n != primary["name"])
    doc = lambda own: F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.col("file_doc"), F.lit("")))
    with_doc = lambda head, sign, own: F.concat(head, F.when(own.isNotNull(), F.concat(F.lit(sign), own)).otherwise(""))
    kind = F.when(primary["kind"] == "", "struct").otherwise(primary["kind"])
    head = F.concat(kind, F.lit(" "), primary["name"], F.lit(" ("), most.cast("string"), F.when(most == 1, F.lit(" method)")).otherwise(F.lit(" methods)")), F.when(F.size(others) > 0, F.concat(F.lit(" +"), list_names(others, 2))).otherwise(""))
    only = F.element_at(fns, 1)
    told = F.when(F.size(fns) == 1, F.concat(F.lit("function "), only["name"])).otherwise(F.concat(F.lit("functions: "), list_names(_names(fns), 3)))
    whole = doc(F.lit(""))
    detail = (
        F.when(F.size(shown) > 0, with_doc(head, ": ", doc(primary["doc"])))
        .when(F.size(fns) > 0, with_doc(told, " — ", doc(only["doc"])))
        .when(F.size("types") > 0, with_doc(F.concat(F.lit("types: "), list_names(_names(F.col("types")), 4)), " — ", whole))
        .when(F.size("constants") > 0, with_doc(F.concat(F.lit("constants: "), list_names(_names(F.col("constants")), 4)), " — ", whole))
        .otherwise(F.coalesce(whole, F.lit("source")))
    )
    main = F.exists("functions", lambda f: f["name"] == "main") | t.startswith("#!") | ((F.col("language") == "java") & t.rlike(r"\bstatic\s+void\s+main\s*\("))
    named = out.withColumn("category", F.coalesce(category(F.col("path"), t), F.when(main, "entry point"))).withColumn("detail", detail)
    line = F.when(F.col("category").isNotNull() & ~F.col("detail").startswith(F.col("category")), F.concat("category", F.lit(": "), "detail")).otherwise(F.col("detail"))
    cut = F.when(F.length(line) > MOST, F.concat(F.substring(line, 1, MOST - 1), F.lit("…"))).otherwise(line)
    return named.withColumn("purpose", cut).withColumn("methods", F.coalesce(most, F.lit(0)))


def outlines(files: DataFrame) -> DataFrame:
    """(path, language, purpose, classes, functions, types, constants, methods, lines) of sources of six languages.

    ``methods`` counts those of the class that has most, the first of equal ones, which the
    purpose names. Texts of other languages and null texts give no row.
    """
    lists = [_names(F.col(n)).alias(n) for n in ("classes", "functions", "types", "constants")]
    return _outlined(files).select("path", "language", "purpose", *lists, "methods", line_count(F.col("contents")).alias("lines"))


def summarise(files: DataFrame) -> DataFrame:
    """(path, summary) of each row of ``files`` (path, contents), made from the outline of its text.

    Texts of other languages, blank and null ones are summarised by ``extract.summarise``.
    Exports are listed by classes, functions, types and constants; confidence is high.
    """
    p, t = F.col("path"), F.col("contents")
    known = F.coalesce(extract.import_family(p).isNotNull() & t.rlike(r"\S"), F.lit(False))
    exported = lambda n: _names(F.filter(n, lambda x: x["exported"]))
    members = F.coalesce(_by_language(lambda _, r: _members(r) if r.members else F.lit(None)), F.array().cast("array<string>"))
    default = F.when((F.col("language") == "script") & t.rlike(r"(?m)^export[ \t]+default\b"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    exports = F.array_distinct(F.concat(exported("classes"), members, exported("functions"), exported("types"), exported("constants"), default))
    exports = F.when((F.col("language") == "python") & t.rlike(extract.LISTED), extract.exports(p, t)).otherwise(exports)
    kinds = lambda n, bare: F.transform(n, lambda x: F.concat(F.coalesce(F.nullif(x["kind"], F.lit("")), F.lit(bare)), F.lit(" "), x["name"]))
    declared = F.array_distinct(F.concat(kinds("classes", "type"), kinds("functions", "func"), kinds("types", "type"), kinds("constants", "const")))
    summary = F.struct("purpose", exports.alias("exports"), extract.modules(p, t).alias("imports"), line_count(t).alias("lineCount"), declared.alias("topLevelDeclarations"), F.lit("high").alias("confidence"))
    return _outlined(files.where(known)).select("path", summary.alias("summary")).unionByName(extract.summarise(files.where(~known)))


def _members(rules: Rules) -> Column:
    """Names that the exported classes export themselves, but for their constructors."""
    open_classes = F.filter("classes", lambda c: c["exported"])
    return F.flatten(F.transform(open_classes, lambda c: F.filter(F.regexp_extract_all(c["body"], F.lit(rules.members), F.lit(1)), lambda n: n != c["name"])))


def _method_counts(name: str, rules: Rules) -> Column:
    """Methods of each shown class: in its body, or by receiver or implementation elsewhere in the text."""
    if name == "go":
        text = F.col("contents")
        return F.transform("shown", lambda c: F.regexp_count(text, F.concat(F.lit(r"(?m)^func\s+\([^)]*\b"), c["name"], F.lit(r"\b[^)]*\)"))))
    if name == "rust":
        text = F.col("contents")
        return F.transform("shown", lambda c: F.regexp_count(F.array_join(F.regexp_extract_all(text, F.concat(F.lit(r"(?m)^impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?"), c["name"], F.lit(r"\b[^{]*" + _BRACED)), F.lit(1)), "\n"), F.lit(rules.method)))
    return F.transform("shown", lambda c: F.regexp_count(c["body"], F.lit(rules.method)))
