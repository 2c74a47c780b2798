"""Token kinds of usual texts, by one search and one table.

``lexers`` cut a text piece by piece, as some tokens depend on what stands around them. Most
texts need no such care: one search lists all their pieces, and a table that remembers the
kind of every piece it has seen turns them into kinds. A text with a piece that needs care
gives None, and its tokens are left to ``lexers``; so are error places.
"""

from __future__ import annotations

import re
from functools import cache

from treeledger.llm.syntax import lexers as lx
from treeledger.llm.syntax.chart import Grammar, Tokens

#: Codes of pieces that are no tokens: a gap with a line break, one without, and a piece that needs care.
LINE, GAP, CARE, SLASH = -2, -3, -4, -5
#: Pieces that a table remembers.
KEPT = 1 << 16


class _Kinds(dict):
    """Piece: kind, code, or a tuple of kinds where a piece stands for several tokens."""

    def __init__(self, kind_of):
        super().__init__()
        self.kind_of = kind_of

    def __missing__(self, piece: str):
        if len(self) >= KEPT:
            self.clear()
        kind = self[piece] = self.kind_of(piece)
        return kind


def _kind(grammar: Grammar, token: re.Pattern, names: dict[str, str], piece: str) -> int:
    m = token.fullmatch(piece)
    group = m.lastgroup if m else None
    if group in ("word", "id", "op"):
        return grammar.kinds.get(piece, CARE if group == "op" else grammar.kinds["ID"])
    return grammar.kinds.get(names.get(group, ""), CARE)


def _gap(piece: str) -> int | None:
    """Code of white space and comments; None for other pieces."""
    if piece[0].isspace() or piece.startswith(("//", "/*")):
        return LINE if any(c in piece for c in "\n\r\u2028\u2029") else GAP
    return None


# Scripts: a slash behind one of some signs starts a regular expression, behind a value it divides, elsewhere it
# needs care; so does a substitution of more than a few braces and strings.
_JS_GAP = r"(?:[\r\n\u2028\u2029]|//[^\r\n\u2028\u2029]*|/\*.*?\*/)(?:[\s\ufeff]+|//[^\r\n\u2028\u2029]*|/\*.*?\*/)*"
_JS_OPS = lx._JS.pattern.split("(?P<op>")[1].rsplit(r"|\?\.(?!\d)", 1)[0]
_JS_SUBSTITUTED = r"(?:[^{}`\"'\\]|'[^'\\\n]*'|\"[^\"\\\n]*\")*"
_JS_REGEX = rf"(?:(?<=[(=,:\[&|?{{;])|(?<=[(=,:\[&|?{{;] )|(?<=\breturn )){lx._JS_REGEX.pattern}"
_JS_TEXTS = rf"`(?:[^`\\$]|\\.|\$(?!\{{)|\$\{{{_JS_SUBSTITUTED}(?:\{{{_JS_SUBSTITUTED}\}}{_JS_SUBSTITUTED})?\}})*`|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\""
_JS_PIECE = re.compile(rf"[ \t\v\f\xa0\ufeff]*({_JS_GAP}|\#?{lx._JS_ID}|{_JS_TEXTS}|{_JS_REGEX}|\d[\w.$]*(?:(?<=[eE])[+-]\d\w*)?|\.\d\w*|\?\.(?!\d)|{_JS_OPS}|.)", re.S)
_JS_NAMES = {"num": "NUM", "str": "STR", "private": "PRIVATE"}


@cache
def _script_kinds(grammar: Grammar) -> _Kinds:
    def kind_of(piece: str):
        if piece[0] == "`":
            inner = lx.script_tokens(piece, grammar, 0)
            return tuple(zip(inner[:-1], inner.breaks)) if lx.BAD not in inner else CARE
        if piece in ("/", "/="):
            return SLASH if piece == "/" else CARE
        if piece[0] == "/" and piece[1] not in "/*":
            return grammar.kinds["REGEX"]
        if piece == "?.":
            return grammar.kinds["?."]
        gap = _gap(piece)
        return gap if gap is not None else _kind(grammar, lx._JS, _JS_NAMES, piece)

    return _Kinds(kind_of)


def script(text: str, grammar: Grammar, at: int) -> Tokens | None:
    table, known = _script_kinds(grammar), grammar.kinds
    kinds, breaks, broke = [], [], False
    for kind in map(table.__getitem__, _JS_PIECE.findall(text.rstrip(), at)):
        if kind.__class__ is tuple:
            for k, b in kind:
                kinds.append(k)
                breaks.append(b or broke)
                broke = False
        elif kind >= 0:
            kinds.append(kind)
            breaks.append(broke)
            broke = False
        elif kind == LINE:
            broke = True
        elif kind == SLASH and kinds and kinds[-1] in (known["ID"], known["NUM"], known["]"]):
            kinds.append(known["/"])
            breaks.append(broke)
            broke = False
        elif kind != GAP:
            return None
    return _ended(kinds, breaks)


def _ended(kinds: list[int], breaks: list[bool] | None = None) -> Tokens:
    breaks = [False] * len(kinds) if breaks is None else breaks
    kinds.append(0)
    breaks.append(True)
    return Tokens(kinds, breaks, None)


# Python: the text inside a format string's fields is cut by ``lexers``.
_PY_LINE = r"(?:\r?\n|\r)(?:[ \t\f]*(?:\#[^\n\r]*)?(?:\r?\n|\r))*(?:[ \t\f]*\#[^\n\r]*\Z)?[ \t\f]*"
_PY_FIELDS = r"(?:\{\{|\}\}|\{[^{}\"'\\\n]*\})"
_PY_OPS = lx._PY.pattern.split("(?P<op>")[1].rsplit(")", 1)[0]
_PY_TEXTS = r"'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*\""
_PY_PIECE = re.compile(
    rf"(?:[ \t\f]+|\\\r?\n|\#[^\n\r]*)*([fF]'(?!'')(?:[^'\\{{}}\n]|\\[^\n{{}}]|{_PY_FIELDS})*'|[fF]\"(?!\"\")(?:[^\"\\{{}}\n]|\\[^\n{{}}]|{_PY_FIELDS})*\"|(?:[fF][rR]?|[rR][fF])['\"]|(?:[rR]|[bB][rR]?|[rR][bB]|[uU])?(?:{_PY_TEXTS})|{_PY_LINE}|{lx._PY_NUM}|\d\w*|{lx._ID}|{_PY_OPS}|.)",
    re.S,
)
_PY_NAMES = {"num": "NUM", "str": "STR"}


@cache
def _python_kinds(grammar: Grammar) -> tuple[_Kinds, frozenset, frozenset]:
    def kind_of(piece: str):
        if piece[0] in "\r\n":
            return LINE
        if piece[0] in "fF" and piece[-1] in "'\"":
            inner = lx.python_tokens(piece, grammar, 0) if len(piece) > 3 else [lx.BAD]
            return tuple(inner[:-2]) if lx.BAD not in inner else CARE
        return _kind(grammar, lx._PY, _PY_NAMES, piece)

    known = grammar.kinds
    return _Kinds(kind_of), frozenset(known[c] for c in "([{"), frozenset(known[c] for c in ")]}")


def python(text: str, grammar: Grammar, at: int) -> Tokens | None:
    table, opening, closing = _python_kinds(grammar)
    known = grammar.kinds
    newline, indent, dedent = known["NEWLINE"], known["INDENT"], known["DEDENT"]
    widths, depth, kinds = [0], 0, []
    pieces = _PY_PIECE.findall("\n" + text[at:].rstrip() + "\n")  # the first line is indented like any other
    for piece, kind in zip(pieces, map(table.__getitem__, pieces)):
        if kind.__class__ is tuple:
            kinds += kind
        elif kind >= 0:
            kinds.append(kind)
            if kind in opening:
                depth += 1
            elif kind in closing:
                depth = max(0, depth - 1)
        elif kind != LINE:
            return None
        elif not depth:
            if kinds:
                kinds.append(newline)
            lead = piece[max(piece.rfind("\n"), piece.rfind("\r")) + 1 :]
            if "\t" in lead or "\f" in lead or "#" in lead:
                return None
            if len(lead) > widths[-1]:
                widths.append(len(lead))
                kinds.append(indent)
            while len(lead) < widths[-1]:
                widths.pop()
                kinds.append(dedent)
            if len(lead) != widths[-1]:
                return None
    if depth:
        return None
    return _ended(kinds)


# Java: comments hide everything, and nothing depends on its surroundings.
_JAVA_TOKEN = lx._JAVA.pattern.split("|(?P<STR>", 1)[1]
_JAVA_PIECE = re.compile(rf"(?:\s+|//[^\r\n]*|/\*.*?\*/)*+((?:{re.sub(r'[(][?]P<[A-Za-z]+>', '(?:', '(?P<STR>' + _JAVA_TOKEN)})|\d[\w$]*|.|\Z)", re.X | re.S)
_GO_TOKEN = lx._GO.pattern.split("|(?P<STR>", 1)[1]
_GO_PIECE = re.compile(rf"[ \t\r]*((?:\n|//[^\n]*|/\*.*?\*/)(?:\s+|//[^\n]*|/\*.*?\*/)*|(?:{re.sub(r'[(][?]P<[A-Za-z]+>', '(?:', '(?P<STR>' + _GO_TOKEN)})|\d\w*|.)", re.X | re.S)
_PLAIN_NAMES = {"STR": "STR", "CHAR": "CHAR", "NUM": "NUM"}


@cache
def _java_kinds(grammar: Grammar) -> _Kinds:
    return _Kinds(lambda piece: _kind(grammar, lx._JAVA, _PLAIN_NAMES, piece) if piece else GAP)


def java(text: str, grammar: Grammar, at: int) -> Tokens | None:
    kinds = list(map(_java_kinds(grammar).__getitem__, _JAVA_PIECE.findall(text, at)))
    while kinds and kinds[-1] == GAP:  # the empty piece at the end
        kinds.pop()
    return None if CARE in kinds else _ended(kinds)


@cache
def _go_kinds(grammar: Grammar) -> tuple[_Kinds, frozenset]:
    def kind_of(piece: str):
        gap = _gap(piece)
        return gap if gap is not None else _kind(grammar, lx._GO, _PLAIN_NAMES, piece)

    words = {k for w, k in grammar.kinds.items() if re.fullmatch(lx._ID, w) and w not in lx._GO_KEYWORDS and w not in ("EOF",)}
    return _Kinds(kind_of), frozenset(words | {grammar.kinds[w] for w in lx._GO_ENDS if w in grammar.kinds})


def go(text: str, grammar: Grammar, at: int) -> Tokens | None:
    table, ends = _go_kinds(grammar)
    semicolon, last, kinds = grammar.kinds[";"], -1, []
    for kind in map(table.__getitem__, _GO_PIECE.findall(text.rstrip(" \t\r\n") + "\n", at)):
        if kind >= 0:
            kinds.append(kind)
            last = kind
        elif kind == LINE:
            if last in ends:
                kinds.append(semicolon)
            last = -1
        elif kind != GAP:
            return None
    return _ended(kinds)
