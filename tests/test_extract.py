from conftest import rows

from treeledger.operators import extract

TS = """import { a as b, c } from './help.js';
import Def from "../lib/x";
import './side';
export default class Foo {}
export async function run() {}
export const x = 1;
const y = require('zod');
export * from './again';
"""
PY = '''"""import no"""
import os, sys as s
from ..base import Config as C
# import hidden
__all__ = ["one", 'two']
async def main(): ...
class Thing: ...
'''


def summaries(spark, *files):
    df = spark.createDataFrame(list(files), "path string, contents string")
    return {r["path"]: r["summary"] for r in extract.summarise(df).collect()}


def test_summaries(spark):
    s = summaries(spark, ("src/a.ts", TS), ("p/m.py", PY), ("a.rs", "use std::io;\npub fn go() {}\nfn main() {}\n"), ("m.go", 'package m\nimport (\n"fmt"\n)\nfunc (t *T) Do() {}\ntype X struct {}\n'), ("a.json", "{}"), ("e.ts", ""), ("n.ts", None))
    assert s["src/a.ts"]["exports"] == ["Foo", "run", "x", "default"] and s["src/a.ts"]["imports"] == ["./help.js", "../lib/x", "./side"]
    assert s["src/a.ts"]["topLevelDeclarations"] == ["function run", "const x", "const y"] and s["src/a.ts"]["confidence"] == "high"
    assert s["p/m.py"]["exports"] == ["one", "two"] and s["p/m.py"]["topLevelDeclarations"] == ["def main", "class Thing"]
    assert s["a.rs"]["purpose"] == "entry point" and s["a.rs"]["exports"] == ["go"]
    assert s["m.go"]["exports"] == ["Do", "X"] and s["m.go"]["imports"] == ["fmt"] and s["m.go"]["topLevelDeclarations"] == ["func Do", "type X struct"]
    assert s["a.json"]["purpose"] == "config" and s["a.json"]["confidence"] == "medium"
    assert s["e.ts"]["confidence"] == "low" and s["e.ts"]["lineCount"] == 0 and s["n.ts"] is None


def test_import_refs_are_resolved(spark):
    df = spark.createDataFrame([("src/a.ts", TS), ("p/q/m.py", PY), ("n.ts", None)], "path string, contents string")
    known = spark.createDataFrame([("src/help.ts",), ("lib/x/index.ts",), ("p/base.py",)], "path string")
    got = {(r["source"], r["module"]): (r["target"], r["external"], r["specifiers"]) for r in extract.resolve_refs(extract.import_refs(df), known).collect()}
    assert got["src/a.ts", "./help.js"] == ("src/help.ts", False, ["a", "c"])
    assert got["src/a.ts", "../lib/x"] == ("lib/x/index.ts", False, ["Def"])
    assert got["src/a.ts", "zod"] == ("zod", True, []) and got["src/a.ts", "./again"][2] == ["*"]
    assert got["p/q/m.py", "..base"] == ("p/base.py", False, ["Config"]) and ("p/q/m.py", "sys") in got and ("p/q/m.py", "hidden") not in got


def test_python_imports_over_several_lines(spark):
    text = "from .a import (\n    b,  # first (\n    c as d,\n)\nfrom x import (e,\r\n  f)\nfrom y import g, \\\n    h\nimport i, \\\n    j\nfrom z import k; n = (1, 2)\nfrom w import *\nfrom v import(l)\nfrom u import (m\n"
    df = spark.createDataFrame([("p/m.py", text)], "path string, contents string")
    got = {r["module"]: r["specifiers"] for r in extract.import_refs(df).collect()}
    assert got == {".a": ["b", "c"], "x": ["e", "f"], "y": ["g", "h"], "i": [], "j": [], "z": ["k"], "w": ["*"], "v": ["l"], "u": ["m"]}


def test_diff_classes(spark):
    data = [("a", "x = 1\ny", 1), ("a", "x = 2\ny", 2), ("a", "x = 2\ny\nexport const z = 1", 3), ("a", None, 4), (None, "x", 1), ("b", "q", 1), ("b", "q", 1)]
    df = spark.createDataFrame(data, "path string, contents string, mtime bigint")
    assert rows(extract.diff_classes(df)) == [("a", 2, 1, 1, False, False), ("a", 3, 1, 0, True, True)]


def test_import_refs_of_other_languages(spark):
    go = 'package a\nimport x "y/z"\nimport (\n\t"fmt"\n\tq "r"\n)\n// import "no"\nvar s = `import "no"`\n'
    rust = "use std::collections::{HashMap, HashSet};\nuse crate::a::b;\nuse super::c;\nmod utils;\n// use no;\n"
    kotlin = "package p\nimport a.b.C\nimport a.d.*\nimport a.E as F\n/* import no */\n"
    java = "package p;\nimport a.b.C;\nimport static a.b.D.m;\nimport a.e.*;\n"
    df = spark.createDataFrame([("m.go", go), ("src/x/l.rs", rust), ("k.kt", kotlin), ("J.java", java)], "path string, contents string")
    known = spark.createDataFrame([("src/a/b.rs",), ("src/c.rs",), ("src/x/utils/mod.rs",)], "path string")
    got = {(r["source"], r["module"]): (r["target"], r["specifiers"]) for r in extract.resolve_refs(extract.import_refs(df), known).collect()}
    assert {k: v[1] for k, v in got.items() if k[0] == "m.go"} == {("m.go", "y/z"): ["x"], ("m.go", "fmt"): [], ("m.go", "r"): ["q"]}
    assert {k[1]: v for k, v in got.items() if k[0] == "src/x/l.rs"} == {"std/collections": ("std/collections", ["HashMap", "HashSet"]), "crate/a/b": ("src/a/b.rs", []), "super/c": ("src/c.rs", []), "./utils": ("src/x/utils/mod.rs", [])}
    assert {k[1]: v[1] for k, v in got.items() if k[0] == "k.kt"} == {"a/b/C": [], "a/d": ["*"], "a/E": ["F"]}
    assert {k[1]: v[1] for k, v in got.items() if k[0] == "J.java"} == {"a/b/C": [], "a/b/D": ["m"], "a/e": ["*"]}
