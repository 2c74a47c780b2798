"""Whether a source text parses in the language that its extension names."""

from __future__ import annotations

from functools import cache

from treeledger.llm.syntax import grammars as g
from treeledger.llm.syntax import lexers as lx
from treeledger.llm.syntax import quick
from treeledger.llm.syntax.chart import Grammar, dialect

#: Extension, lower-cased: language.
LANGUAGES = {".ts": "typescript", ".js": "javascript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".kt": "kotlin", ".json": "json"}

_LEXERS = {
    "typescript": lx.script_tokens, "javascript": lx.script_tokens, "python": lx.python_tokens, "java": lx.java_tokens,
    "go": lx.go_tokens, "rust": lx.rust_tokens, "kotlin": lx.kotlin_tokens, "json": lx.json_tokens,
}

_QUICK = {"typescript": quick.script, "javascript": quick.script, "python": quick.python, "java": quick.java, "go": quick.go}


@cache
def grammar_of(language: str) -> Grammar:
    if language == "json":
        return Grammar(g.JSON, "text")
    if language in ("typescript", "javascript"):
        return Grammar(dialect(g.SCRIPT, language == "typescript"), "program", ("assign", "call", "propname", *(("type",) if language == "typescript" else ())))
    text, charted = {
        "python": (g.PYTHON, ("expr", "atom", "named", "place", "single")),
        "java": (g.JAVA, ("expr", "type", "postfixed", "annotations")),
        "go": (g.GO, ("expr", "expr_h", "type")),
        "rust": (g.RUST, ("expr", "type", "path", "pathexpr", "rangeend", "blocklike")),
        "kotlin": (g.KOTLIN, ("expr", "postfix", "nullable", "body", "accessor")),
    }[language]
    return Grammar(text, "file", charted)


def first_error(language: str, text: str) -> int | None:
    """None for a valid text, else the offset of its first unrecoverable error.

    A byte-order mark at the start and a first line ``#!`` are skipped.
    """
    grammar = grammar_of(language)
    at = 1 if text.startswith("\ufeff") else 0
    if text.startswith("#!", at) and not (language == "rust" and text.startswith("#![", at)):
        end = text.find("\n", at)
        at = len(text) if end < 0 else end
    tokens = _QUICK[language](text, grammar, at) if language in _QUICK else None
    if tokens and grammar.accepts(tokens):
        return None
    tokens = _LEXERS[language](text, grammar, at)
    wrong = grammar.error_at(tokens)
    return None if wrong is None else tokens.starts[wrong]
