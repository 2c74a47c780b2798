import pytest

from treeledger.operators.outline import outlines, summarise

FILES = [
    ("src/greet.ts", "/**\n * Greets people. And more.\n */\nexport function greet(n: string) {\n  return n;\n}\n"),
    ("src/s.ts", "export class A {\n  constructor() {}\n  one() {\n    if (x) {\n    }\n  }\n  async two(a: B) {\n  }\n}\nclass Hidden {\n}\nexport class C {\n}\n"),
    ("src/types.ts", "export interface A {}\nexport type B = 1;\n"),
    ("t/test_m.py", '"""Checks m. Yes."""\nclass T:\n    def __init__(self): ...\n    def a(self):\n        pass\n    async def b(self): ...\n\nclass _H: ...\n'),
    ("a.py", "LIMIT = 1\nOTHER: int = 2\n"),
    ("m.go", "package m\n\n// Store keeps rows. Fast.\ntype Store struct {\n\ta int\n}\n\nfunc (s *Store) Get() {}\nfunc (s Store) put() {}\nfunc main() {}\n"),
    ("l.rs", "/// A list.\n#[derive(X)]\npub struct L<T> {\n    a: T,\n}\n\nimpl<T> L<T> {\n    pub fn a(&self) {}\n    fn b() {}\n}\nfn hidden() {}\n"),
    ("K.kt", "package k\n/** Rows. */\ndata class R(val a: Int)\nprivate fun p() {}\nobject O {\n    fun f() {}\n    override fun g() = 1\n}\n"),
    ("J.java", "package j;\n/** Counts. More. */\npublic class J {\n    int x;\n    public int get(int a) {\n        return a;\n    }\n    void set() {\n    }\n}\n"),
    ("e.ts", ""), ("n.ts", None), ("x.txt", "function a() {}"),
]

WANT = {
    "src/greet.ts": "function greet — Greets people.",
    "src/s.ts": "class A (2 methods) +C",
    "src/types.ts": "types: A, B",
    "t/test_m.py": "test: class T (2 methods): Checks m.",
    "a.py": "constants: LIMIT, OTHER",
    "m.go": "entry point: struct Store (2 methods): Store keeps rows.",
    "l.rs": "struct L (2 methods): A list.",
    "K.kt": "object O (2 methods) +R",
    "J.java": "class J (2 methods): Counts.",
    "e.ts": "source",
}


def test_purpose_lines(spark):
    df = spark.createDataFrame(FILES, "path string, contents string")
    got = {r["path"]: r["purpose"] for r in outlines(df).collect()}
    assert got == WANT


def test_long_lines_are_cut(spark):
    text = "export function f() {}\n".join(["/** " + "word " * 60 + "*/\n", ""])
    df = spark.createDataFrame([("a.ts", text)], "path string, contents string")
    purpose = outlines(df).first()["purpose"]
    assert len(purpose) == 160 and purpose.endswith("…")


def test_long_bodies_and_comments(spark):
    body = "class A:\n" + "    x = 1\n\n" * 20000 + "    def a(self): ...\n    def b(self): ..."
    go = "package m\n\n// Store keeps rows. Fast.\n" + "// More: of it.\n" * 300 + "type Store struct {\n}\n"
    rust = "/// A list. Short.\n" + "/// More: of it.\n" * 300 + "#[a]\n" * 30 + "pub struct L {\n}\n"
    head = "// Package m counts. Fast.\n" + "// More: of it.\n" * 300 + "package m\n"
    df = spark.createDataFrame([("a.py", "class S:\n    def a(self): ...\n" + body), ("m.go", go), ("l.rs", rust), ("h.go", head)], "path string, contents string")
    assert {r["path"]: r["purpose"] for r in outlines(df).collect()} == {
        "a.py": "class A (2 methods) +S", "m.go": "struct Store (0 methods): Store keeps rows.", "l.rs": "struct L (0 methods): A list.", "h.go": "Package m counts.",
    }


LONG = {
    "a.ts": ("export class A {\n" + "  m{n}(x) {{\n    return x;\n  }}\n", "}\n"),
    "a.py": ("class A:\n" + "    def m{n}(self):\n        return 1\n", ""),
    "a.go": ("package a\n\ntype A struct {\n}\n" + "func (a *A) M{n}() {{\n\treturn\n}}\n", ""),
    "a.rs": ("pub struct A {\n}\nimpl A {\n" + "    pub fn m{n}(&self) {{\n        return;\n    }}\n", "}\n"),
    "a.kt": ("class A {\n" + "    fun m{n}() {{\n        return\n    }}\n", "}\n"),
    "A.java": ("public class A {\n" + "    public int m{n}(int x) {{\n        return x;\n    }}\n", "}\n"),
}


@pytest.mark.parametrize("path", LONG)
def test_classes_of_fifty_thousand_lines(spark, path):
    start, end = LONG[path]
    cut = next(i for i in range(len(start)) if "{n}" in start[start.rfind("\n", 0, start.index("{n}")) + 1 :] and i == start.rfind("\n", 0, start.index("{n}")) + 1)
    method = start[cut:]
    text = start[:cut] + "".join(method.format(n=n) for n in range(50_000 // method.count("\n"))) + end
    df = spark.createDataFrame([(path, text)], "path string, contents string")
    assert outlines(df).first()["methods"] == 50_000 // method.count("\n")


def test_summaries(spark):
    files = FILES + [("p.py", "__all__ = ['b']\ndef a(): ...\ndef b(): ...\n"), ("d.ts", "import x from 'y';\nexport default function f() {}\n"), ("M.java", "import a.b.C;\npublic class M {\n    public M() {}\n    public static final int N = 1;\n    private int q() { return 1; }\n    public static void main(String[] a) {\n    }\n}\n")]
    df = spark.createDataFrame(files, "path string, contents string")
    got = {r["path"]: r["summary"] for r in summarise(df).collect()}
    assert got["n.ts"] is None and got["x.txt"]["purpose"] == "other" and got["e.ts"]["confidence"] == "low"
    assert got["p.py"]["exports"] == ["b"] and got["d.ts"]["exports"] == ["f", "default"] and got["d.ts"]["imports"] == ["y"]
    assert got["M.java"]["exports"] == ["M", "N", "main"] and got["M.java"]["imports"] == ["a.b.C"] and got["M.java"]["purpose"].startswith("entry point: class M")
    assert got["src/s.ts"]["exports"] == ["A", "C"] and got["src/s.ts"]["topLevelDeclarations"] == ["class A", "class Hidden", "class C"]
    assert all(s["confidence"] == "high" for p, s in got.items() if p in WANT and p != "e.ts")


def test_bodies_on_one_line(spark):
    files = [
        ("a.ts", "export class A { m() { return {}; } }\nexport class B {\n  x() {\n  }\n  y() {\n  }\n}\nexport class C {}\n"), ("J.java", "class A {}\nclass B {\n    int f() { return 1; }\n}\n"),
        ("m.go", "package m\ntype A struct{}\ntype B struct {\n\tx int\n}\nfunc (b B) F() {}\n"), ("l.rs", "pub struct A {}\nimpl A { }\nimpl A {\n    pub fn f() {}\n}\n"), ("K.kt", "class A { }\nclass B {\n    fun f() {}\n}\nclass C\n"),
    ]
    got = {r["path"]: (r["classes"], r["methods"]) for r in outlines(spark.createDataFrame(files, "path string, contents string")).collect()}
    assert got == {"a.ts": (["A", "B", "C"], 2), "J.java": (["A", "B"], 1), "m.go": (["A", "B"], 1), "l.rs": (["A"], 1), "K.kt": (["A", "B", "C"], 1)}
