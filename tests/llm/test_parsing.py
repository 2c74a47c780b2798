import ast
import random

import pytest
from conftest import rows

from treeledger.llm.parsing import parse_files
from treeledger.llm.syntax import check
from treeledger.llm.syntax.check import first_error

VALID = {
    "json": ['{"a": [1, -2.5e3, null, true, "x\\u00e9"]}', " [] ", '"s"'],
    "python": ["", "# only\n", "x: int = 1\n", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a if b else c\n", "match x:\n    case {'k': [1, *_]} if y: pass\n    case A(b=1) | None: pass\n", "match = 1\nprint(match)\n", "async def f():\n    async with a as b, c: yield\n    return [i async for i in x if i]\n", 'f"{a!r:>{w}} {{x}} {d[\'k\']}"\n', "with (open(a) as b, c):\n  pass\n", "try:\n  pass\nexcept* E as e:\n  pass\nfinally:\n  pass\n", "x = lambda a, *b: (yield)\n", "if x:\n\ty\n", "print(*a, **b, c=1)\nx[1:2, ::3] = y = 3\n", "a = b if c else lambda: d\n@dec(1)\nclass A(B, m=C): x = 1; y = 2\n"],
    "javascript": ["", "import a, { b as c } from 'x';\nexport * as n from './y';", "const f = async (a = 1, { b, ...c }, [d, , e]) => ({ ...a, [b]: 1, get x() { return 1 } });", "a\nb\n++c", "for (const [k, v] of Object.entries(o)) if (k) continue; else break;", "x = a / b / c; y = /[/]\\/(?<n>a)/g.test(z)", "class A extends B { #p = 1; static { } static async *gen() { yield* x } get get() { return this.#p } }", "label: while (1) { do { } while (0) }", "`a ${b + `c ${d}`} e`", "export default function () {}", "if (a) /re/.test(b)", "let of = 1; async () => { await x?.y?.[0]?.(z) ?? 1 }", "switch (a) { case 1: default: b() }"],
    "typescript": ["export type A<T> = T extends (infer U)[] ? { readonly [K in keyof U]?: U[K] } : never;", "function f<T extends object>(this: X, a?: T, ...b: T[]): a is T { return <T>a as unknown as T }", "abstract class A<T> implements B<T> { private readonly x!: Map<string, Array<number>>; constructor(private y: T) { super() } abstract m(): void; get v(): string { return '' } [k: string]: any }", "enum E { A = 1, B = 'x' }\ndeclare module 'm' { export const x: number; }\nnamespace N.M { }", "const x = <T,>(a: T): T => a; let y = a!.b satisfies C;", "import type { A } from './a'; export type { B } from './b'; import { type C } from 'c';", "type F = new (...a: any[]) => void; type T = [a: string, b?: number, ...c: X[]]; let u: typeof import('x');", "interface I extends J<K> { (a: string): void; new (): I; m?(): void; readonly [k: string]: number }", "function over(a: string): void;\nfunction over(a: any) {}", "const r: Record<string, number> = {}; if (a < b && c > d) { }", "let t: `a${string}b` | -1 | unique symbol;"],
    "java": ["", "package a.b; import static c.D.*; @A(x = 1, y = {2, 3}) public final class X<T extends Y & Z> extends W<T[]> implements V<? super T> { static { } X() { this(1); } <U> void m(final int... a) throws E { } }", "sealed interface S permits A, B {} record R<T>(T a, int b) implements S { R { if (b < 0) throw new E(\"x\"); } static int z = 1; }", "enum E { A(1) { int f() { return 1; } }, B; int x; E() {} }", "class X { Object f(Object o) { for (var x : xs) { } try (var a = b; c) { } catch (A | B e) { } finally { } return o instanceof String s && s.length() > 1 ? (Runnable) () -> { } : X::new; } }", "class X { int f(int n) { return switch (n) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new E(); }; } String t = \"\"\"\n  a \"b\" { \\\n  \"\"\"; int[][] a = new int[3][]; int[] b = {1, 2}; List<int[]> c = new ArrayList<>(); }", "class X { void f() { a.<T>b().c[1]++; int x = (int) y + (z) - 1; l: for (int i = 0, j; i < 9; i++, j--) continue l; synchronized (this) { } do { } while (a >>> 1 > 2); assert a : b; int r = a < b ? c : d; } }", "@interface A { int x() default 1; }"],
    "go": ["package a", "package a\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\nfunc (t *T[K, V]) M(a, b int, c ...string) (x int, err error) { return 1, nil }", "package a\nfunc f() {\n\tif x := g(); x > 0 {\n\t} else if y {\n\t}\n\tfor i := range 10 {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase a <- b:\n\tcase c, ok := <-d:\n\t}\n\tdefer func() {}()\n\ta := []T{{1, 2}, {X: 3}}\n\tm := map[string][]int{\"a\": {1}}\n\tb[1:2:3] = *p &^ q\nL:\n\tgoto L\n}", "package a\nvar (\n\tx, y = 1, 2\n\tz chan<- int\n)\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\t~int | string\n\tM()\n}"],
    "rust": ["", "#![a(b)]\nuse a::{b, c::*, d as e};\npub(crate) fn f<'a, T: A + 'a>(x: &'a mut T, mut y: [u8; 3]) -> Result<T, Box<dyn E>> where T: Fn(u8) -> u8 { Ok(x?) }", "fn f() { let x = if a { 1 } else { 2 }; match x { 0 | 1 => {} 2..=5 if y => z(), S { a, .. } => (), Some(n @ 1..) => {}, _ => return } for i in 0..n { } while let Some(x) = y.pop() { } 'l: loop { break 'l; } }", "struct A<T>(pub T, u8); enum B { C, D { x: u8 }, E(String) = 3 } impl<T> Tr for A<T> { const X: u8 = 1; type Y = u8; fn g(&self) -> Self { Self { ..*self } } }", "fn f() { let v: Vec<_> = x.iter().map(|&(a, b)| a as u64 * 2).collect::<Vec<_>>(); println!(\"{}\", a); let s = r#\"a \"b\" {\"#; let c = '\\''; let t = x.0.1; a[1] += 2; (|| async move { b.await? })() }", "/* a /* b */ c */ macro_rules! m { ($a:expr) => { $a } } mod m; static mut X: &[&str] = &[\"a\"]; unsafe extern \"C\" { fn x(); }"],
    "kotlin": ["", "package a.b\nimport c.d.*\nimport e.f as g\n", "@A data class P<out T : Any>(val a: Int = 1, private var b: List<T?>) : Q(1), R by s where T : X {\n  companion object { const val Z = 1 }\n  init { a() }\n  constructor(x: Int) : this(x, y) { }\n  val q: Int\n    get() = 1\n  var w = 1\n    private set\n}", "sealed interface S { fun f(n: Int): String = when {\n n > 1 -> \"a ${n + 1} $n\"\n else -> { \"b\" } } }", "enum class E(val x: Int) { A(1) { override fun f() = 2 }, B(2); open fun f() = 1 }", "fun String.ext(vararg a: Int, b: (Int) -> Unit = {}): Int? {\n  for ((i, x) in a.withIndex()) { if (x !in 1..2) continue else break }\n  val y = a?.b ?: return null\n  x.map { it + 1 }.filter { a, b -> a > b }\n      .take(1)\n  try { } catch (e: E) { } finally { }\n  do { } while (a && b)\n  return if (a is B) 1 else c as? D\n}", "val s = \"\"\"\n ${a} { (\n\"\"\"\nvar t by lazy { 1 }\nfun interface I { fun f() }\ntypealias A = Map<String, (Int) -> Unit>\nobject O : P()\n/* a /* b */ c */\n"],
}
INVALID = {
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": 1", "nul", "01", "[1] x", "// c\n1"],
    "python": ["def f(:\n  pass\n", "x = (\n", "if x:\ny\n", "print 'a'\n", "<<<<<<< HEAD\nx = 1\n", "  x\n", "if x:\n\ty = 1\n        z = 2\n", "class A\n  pass\n", "x = 'a\n", "return)\n", "f'{a'\n", "import a from b\n", "x = 1 +\n", "function f() {}\n"],
    "javascript": ["const x;", "function (a) { }", "let s = 'a", "a b", "interface I { }", "const x: number = 1;", "import type { A } from 'a';", "if (a {", "`a ${b", "{ a: }", "=======", "x = a +", "class { }", "for (;;", "10px"],
    "typescript": ["interface { }", "const = 1", "let s: string = \"open;", "import os\nfrom pathlib import Path", "type X = ;", "a b", "enum E { A B }", "function f(a: ) { }", ">>>>>>> theirs"],
    "java": ["class { }", "package a\nclass X {}", "class X { int f( { return 1; } }", "class X { String s = \"open; }", "<<<<<<< HEAD\nclass A {}", "class X { void f() { return rest } }", "fun f() {}"],
    "go": ["", "// only", "package a\nfunc f( {\n}", "package a\nvar = 1", "package a\nconst s = \"open", "package a\nfunc f() {\n\tx := \n}", "package a\nx := 1"],
    "rust": ["fn f(a: u8 {", "const S: &str = \"open;", "/* a /* b */", "let x = 1;", "fn f() { let = 1; }", "pub enum E { A, B", "struct S { a u8 }"],
    "kotlin": ["val total =", "fun rest(", "val s = \"open", "class Rest(", "fun f() { val x = }", "fun f() { a b c", "import \"errors\"", "return 1", "/* a /* b */"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert first_error(language, text) is None
    assert first_error(language, "\ufeff" + text.replace("\n", "\r\n")) is None or language == "json" and not text


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in INVALID.items() for t in ts])
def test_invalid(language, text):
    assert first_error(language, text) is not None


def test_shebang_and_depth():
    assert first_error("python", "#!/usr/bin/env python\nx = 1\n") is None
    assert first_error("javascript", "#!/usr/bin/env node") is None
    assert first_error("json", "[" * 3000 + "]" * 3000) is None
    assert first_error("python", "x = 1\n" * 20000) is None and first_error("python", "x = 1\n" * 2000 + "y = (") is not None


def test_python_like_its_own_parser():
    random.seed(5)
    whole = "".join(t + "\n" for t in VALID["python"] if "yield)" not in t and "async" not in t)
    for _ in range(300):
        a = random.randrange(len(whole))
        text = random.choice([whole[:a], whole[:a] + whole[a + 1 :], whole[:a] + random.choice("(){}[]:,=.'\" \n") + whole[a:]])
        try:
            ast.parse(text)
            good = True
        except SyntaxError as e:
            good = False
            said = str(e.msg)
            if any(x in said for x in ("assign", "delete", "escape", "outside", "positional", "keyword argument", "default", "non-default", "already", "parameter", "follow", "pattern", "unpack", "star", "target", "argument")):
                continue  # rules beyond the grammar
        assert (first_error("python", text) is None) == good, text


PYTHON_NOT = ["f() = 1", "1 = x", "(*a)", "f(a=1, b)", "f(**a, *b)", "def f(a=1, b): pass", "def f(*): pass", "def f(**a, b): pass", "f(x for x in y, 1)", "[a, b] += 1", "del f()", "lambda a=1, b: a"]
PYTHON = ["a.b().c = 1", "(a, *b), [c, d] = x", "(*a,)", "f(a, *b, c=1, *d, **e, g=2)", "def f(a, b=1, /, c=2, *d, e, g=3, **h): pass", "lambda a, b=1, /, *c, d=2, **e: 0", "(a): int = 1", "del a.b, (c, d), e[0]"]
JAVA_NOT = ["count;", '"text";', "42;", "a.b;", "a[0];", "new int[3];", "this;", "a.b().c;", "for (; ; i) { }"]
JAVA = ["f();", "a.<T>b().c();", "new A() { }.b();", "new int[]{1}.clone();", "super.f();", "i++;", "--i;", "a.b().c = 1;", '"x".length();', "o.new In();", "for (i = 0; ; i++, f()) { }"]


@pytest.mark.parametrize("text", PYTHON_NOT + PYTHON)
def test_python_targets_arguments_and_parameters(text):
    assert (first_error("python", text + "\n") is None) == (text in PYTHON)


@pytest.mark.parametrize("text", JAVA_NOT + JAVA)
def test_java_statement_expressions(text):
    assert (first_error("java", f"class X {{ void f() {{ {text} }} }}") is None) == (text in JAVA)


def test_python_like_its_own_parser_whatever_it_says():
    random.seed(11)
    whole = "".join(t + "\n" for t in VALID["python"] if "yield)" not in t and "async" not in t)
    for i in range(600):
        base = random.choice(PYTHON) + "\n" if i % 2 else whole
        a = random.randrange(len(base))
        text = random.choice([base[:a], base[:a] + base[a + 1 :], base[:a] + random.choice("(){}[]:,=.*'\" \n1") + base[a:]])
        try:
            ast.parse(text)
            good = True
        except SyntaxError:
            good = False
        assert (first_error("python", text) is None) == good, text


def test_rows(spark):
    data = [("p/a.PY", "x = (", 1), ("p/a.PY", "x = 1", 2), ("p/b.js", None, 1), ("p/c.txt", "(", 1), (None, "(", 1), ("p/d.json", "{}", None), ("./p/e.go", "x", 5), ("p/e.go", "x", 5)]
    df = spark.createDataFrame([(*r, "clash", True) for r in data], "path string, contents string, mtime bigint, language string, valid boolean")
    got = rows(parse_files(df).select("path", "project", "language", "valid", "error_line"))
    assert got == sorted([("p/a.PY", "p", "python", True, None), ("p/b.js", "p", "javascript", None, None), ("p/c.txt", "p", None, None, None), ("p/d.json", "p", "json", True, None), ("p/e.go", "p", "go", False, 1)], key=repr)
    assert rows(parse_files(df.limit(0))) == []


# (language, text, whether it is valid): the published grammars decide.
GRAMMAR_CASES = [
    ("python", "type X = int\n", True), ("python", "type X[T] = list[T]\n", True), ("python", "type = 5\ntype(x)\n", True), ("python", "with a as 1:\n  pass\n", False),
    ("kotlin", "class A { companion object { } init { } }", True), ("kotlin", "class A { val x = 1; init { } fun f() { } }", True), ("kotlin", "fun f() {} fun g() {}", True), ("kotlin", "fun f() { val x = 1 val y = 2 }", False),
    ("java", "class A { void f() { 1 = x; } }", False), ("java", "class A { void f() { f() = x; } }", False), ("java", "class A { void f() { a.b[1] = (c) = x; } }", True),
    ("rust", "fn f() { a < b < c; }", False), ("rust", "fn f() { a == b == c; }", False), ("rust", "fn f() { (a < b) == c && d < e; if a >> 1 > b { } }", True), ("rust", "fn f() { if a < b < c { } }", False),
    ("javascript", "a ?? b || c", False), ("javascript", "a && b ?? c", False), ("javascript", "(a ?? b) || c && d; a ?? b ?? c", True), ("javascript", "-1 ** 2", False), ("javascript", "(-1) ** 2 ** -x", True),
    ("javascript", "return 1", False), ("javascript", "if (x) { return 1 }", False), ("javascript", "function f() { if (x) { return 1 } }", True), ("javascript", "x = () => { return 1 }; class A { m() { return 1 } }", True),
    ("javascript", "1 = x", False), ("javascript", "f() = x", False), ("javascript", "[1] = x", False), ("javascript", "({a: 1} = x)", False), ("javascript", "({a=1})", False), ("javascript", "f({a=1})", False), ("javascript", "1++", False), ("javascript", "++f()", False),
    ("javascript", "[a=1, {b=2}, ...c] = d; ({a, b: c.d, ...e} = x); for ({a=1} of x) ; for (a.b of x) ; ({a=1}) => a; this.x = (y) = z; ++a.b; (c)--", True), ("javascript", "for (f() of x) ;", False),
    ("javascript", "if (x) function* f() {}", False), ("javascript", "if (x) class A {}", False), ("javascript", "while (x) const y = 1", False), ("javascript", "if (x) let y = 1", False), ("javascript", "if (x) var y = 1; else z", True), ("javascript", "a?.`x`", False),
    ("typescript", "(a as B) = 1; a! = 2; a![0]++; (<B>a).c = 3", True), ("typescript", "return 1", False),
]


@pytest.mark.parametrize(("language", "text", "good"), GRAMMAR_CASES)
def test_published_grammars(language, text, good):
    assert (first_error(language, text) is None) == good


DEEP = {
    "python": "x = " + "(" * 30000 + "1" + ")" * 30000 + "\n", "javascript": "x = " + "f([" * 30000 + "])" * 30000, "typescript": "x = " + "!" * 40000 + "y", "json": "[" * 100000 + "]" * 100000,
    "java": "class A { int f = " + "(" * 20000 + "1" + ")" * 20000 + "; }", "go": "package a\nvar x = " + "(" * 20000 + "1" + ")" * 20000, "kotlin": "val x = " + "(" * 20000 + "1" + ")" * 20000, "rust": "fn f() { " + "{" * 20000 + "}" * 20000 + " }",
}


@pytest.mark.parametrize("language", DEEP)
def test_deep_nesting(language):
    text = DEEP[language]
    assert first_error(language, text) is None
    middle = len(text) // 2
    assert first_error(language, text[:middle] + " ; ] " + text[middle:]) is not None and first_error(language, text[: len(text) - 1 - len(text) // 9]) is not None


MORE = {
    "javascript": ["a = b / c; d = /x'/.test(`a ${b['c']} /`); // `\n`${ {a: {}} }`", "return /a/ /* */ / 2"],
    "python": ["# f'\nf'a{b}c'  # '\n", "if x:\n    y = '''\n  # no\n'''\n\n  # c\nz\n", 'x = f"{a}" f"{{}} {b!r} {c:>3}"\n'],
    "java": ["class A { // }\n"], "go": ["package a // }\n/* x\n */ func f() { return /* */ }"],
}


@pytest.mark.parametrize("language", check._QUICK)
def test_quick_tokens_are_the_careful_ones(language):
    random.seed(3)
    texts, grammar = VALID[language] + INVALID[language] + MORE.get(language, []), check.grammar_of(language)
    for _ in range(3000):
        base = random.choice(texts)
        a, b = sorted((random.randrange(len(base) + 1), random.randrange(len(base) + 1)))
        text = random.choice([base, base[:a], base[a:], base[:a] + base[b:], base[:a] + random.choice("(){}[]:,=./*'\"`#\\ \n\r\t$0a_é") + base[a:], base + "\n" + random.choice(texts)])
        quick = check._QUICK[language](text, grammar, 0)
        if quick is not None and grammar.accepts(quick):  # others are left to the careful ones
            careful = check._LEXERS[language](text, grammar, 0)
            assert list(quick) == list(careful) and (language not in ("javascript", "typescript") or quick.breaks == careful.breaks), text


def test_copies_are_parsed_once(spark):
    df = spark.range(200).selectExpr("concat('p/f', id, '.py') AS path", "if(id % 2 = 0, 'x = (', 'x = 1') AS contents", "1L AS mtime")
    assert parse_files(df).where("not valid").count() == 100
