"""Tokenisers for ``chart.Grammar``: each turns a text into token kinds, or marks the place that is no token."""

from __future__ import annotations

import re

from treeledger.llm.syntax.chart import Grammar, Tokens

BAD = -1
_ID = r"[^\W\d]\w*"


def _alternatives(*symbols: str) -> str:
    return "|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True))


class _Out:
    """Collects kinds, line-break flags and offsets."""

    def __init__(self, grammar: Grammar):
        self.get, self.kinds, self.breaks, self.starts = grammar.kinds.get, [], [], []

        self.name = grammar.kinds.get("ID", BAD)

    def add(self, text: str, start: int, broke: bool = False) -> None:
        self.kinds.append(self.get(text, BAD))
        self.breaks.append(broke)
        self.starts.append(start)

    def word(self, text: str, start: int, broke: bool = False) -> None:
        self.kinds.append(self.get(text, self.name))
        self.breaks.append(broke)
        self.starts.append(start)

    def done(self, end: int) -> Tokens:
        self.kinds.append(0)
        self.breaks.append(True)
        self.starts.append(end)
        return Tokens(self.kinds, self.breaks, self.starts)

    def broken(self, at: int) -> Tokens:
        self.kinds.append(BAD)
        self.breaks.append(False)
        self.starts.append(at)
        return self.done(at)


_JSON = re.compile(r"""[ \t\r\n]+|(?P<STR>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>[a-z]+)|(?P<op>[{}\[\],:])""", re.A)


def json_tokens(text: str, grammar: Grammar, at: int) -> Tokens:
    out = _Out(grammar)
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            return out.broken(at)
        if m.lastgroup in ("STR", "NUM"):
            out.add(m.lastgroup, at)
        elif m.lastgroup:
            out.add(m.group(), at)
        at = m.end()
    return out.done(at)


_JS_ID = r"(?:[^\W\d]|\$|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$\u200c\u200d]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*"
_JS = re.compile(
    rf"""(?P<space>[ \t\v\f\xa0\ufeff]+)|(?P<line>[\r\n\u2028\u2029]+)|(?P<comment>//[^\r\n\u2028\u2029]*|/\*.*?\*/)|(?P<id>{_JS_ID})|(?P<private>\#{_JS_ID})
    |(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?(?![\w$])
      |(?:(?:0|[1-9](?:_?\d)*)(?:n|(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d(?:_?\d)*)?)|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$]))
    |(?P<str>'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|"(?:[^"\\\r\n]|\\(?:\r\n|.))*")|(?P<tick>`)
    |(?P<op>{_alternatives("...", ">>>=", "===", "!==", "**=", "<<=", ">>=", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", "**", *"{}()[];,<>+-*/%&|^!~?:=.@")}|\?\.(?!\d))""",
    re.X | re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_JS_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_JS_VALUE_END = frozenset(("id", "num", "str", "regex", "template", ")", "]"))
_JS_NO_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())


def script_tokens(text: str, grammar: Grammar, at: int) -> Tokens:
    out, size = _Out(grammar), len(text)
    broke, last = False, ""  # last: what ended before, to tell a regular expression from a division
    braces: list[str] = []
    heads: list[bool] = []  # for each open parenthesis, whether a statement head opened it

    def chunk(begin: int, first: bool) -> int:
        end = _JS_CHUNK.match(text, begin).end()
        if text.startswith("`", end):
            out.add("TEMPLATE" if first else "TAIL", begin, broke)
            return end + 1
        if text.startswith("${", end):
            out.add("HEAD" if first else "MIDDLE", begin, broke)
            braces.append("`")
            return end + 2
        return -1

    while at < size:
        if text[at] == " ":
            at += 1
            continue
        if text[at] == "/" and last not in _JS_VALUE_END and (m := _JS_REGEX.match(text, at)):
            out.add("REGEX", at, broke)
            at, broke, last = m.end(), False, "regex"
            continue
        m = _JS.match(text, at)
        if not m:
            return out.broken(at)
        kind, word = m.lastgroup, m.group()
        if kind == "space":
            at = m.end()
            continue
        if kind in ("line", "comment"):
            broke = broke or "\n" in word or "\r" in word or kind == "line"
            at = m.end()
            continue
        if kind == "op" and word == "?" and text.startswith("?.", at) and not text[at + 2 : at + 3].isdigit():
            word = "?."
        if kind == "id":
            before = last
            out.word(word, at, broke)
            last = word if word in _JS_NO_VALUE and before != "." else "head" if word in ("if", "while", "for", "with") and before != "." else "id"
        elif kind == "private":
            out.add("PRIVATE", at, broke)
            last = "id"
        elif kind in ("num", "str"):
            out.add(kind.upper(), at, broke)
            last = kind
        elif kind == "tick" or word == "}" and braces and braces[-1] == "`":
            if kind != "tick":
                braces.pop()
            end = chunk(at + 1, kind == "tick")
            if end < 0:
                return out.broken(at)
            last = "template" if text[end - 1] == "`" else "{"
            at, broke = end, False
            continue
        else:
            out.add(word, at, broke)
            if word == "(":
                heads.append(last == "head")
            elif word == "{":
                braces.append("{")
            elif word == "}" and braces:
                braces.pop()
            last = word
            if word == ")" and heads and heads.pop():
                last = "head)"
        at, broke = at + len(word), False
    return out.done(size)


_PY_NUM = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ]))(?!\w)"
_PY = re.compile(
    rf"""(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<line>\r?\n|\r)
    |(?P<fopen>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|"))
    |(?P<str>(?:[rR]|[bB][rR]?|[rR][bB]|[uU])?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*'|"(?!\"\")(?:[^"\\\r\n]|\\(?:\r\n|.))*"))
    |(?P<num>{_PY_NUM})|(?P<id>{_ID})
    |(?P<op>{_alternatives("**=", "//=", ">>=", "<<=", "...", "!=", "==", "<=", ">=", "->", ":=", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "**", "//", "<<", ">>", *"+-*/%@&|^~<>()[]{},:.;=")})""",
    re.X | re.S,
)
_PY_INDENT = re.compile(r"[ \t\f]*")


def python_tokens(text: str, grammar: Grammar, at: int) -> Tokens:
    out, size = _Out(grammar), len(text)
    indents, depth, fresh = [(0, 0)], 0, True  # each width with tabs to the next eighth column and with tabs of one
    fields: list[tuple[str, int]] = []  # open format strings: their quote and the depth inside their field

    def literal(begin: int, quote: str, spec: bool) -> int:
        """Text of a format string from ``begin`` up to a field, its end, or a broken line."""
        i = begin
        while i < size:
            c = text[i]
            if c == "\\" and not spec:
                i += 2
            elif c == "\\":
                i += 1
            elif c == "{" and (spec or not text.startswith("{{", i)) or c == "}" and spec:
                break
            elif c == "{" or c == "}" and text.startswith("}}", i):
                i += 2
            elif c == "}" or c == "\n" and len(quote) == 1:
                return -1
            elif text.startswith(quote, i):
                break
            else:
                i += 1
        if i > begin:
            out.add("FTEXT", begin)
        return i if i < size else -1

    def after_text(i: int) -> int:
        """At a field or at the end of a format string."""
        nonlocal depth
        quote = fields[-1][0]
        if text[i] == "{":
            out.add("{", i)
            depth += 1
            fields[-1] = (quote, depth)
            return i + 1
        out.add("FCLOSE", i)
        fields.pop()
        return i + len(quote)

    while at < size:
        if fresh and not depth and not fields:
            m = _PY_INDENT.match(text, at)
            at = m.end()
            if at >= size:
                break
            if text[at] in "\r\n#":
                m = _PY.match(text, at)
                at = m.end()
                continue
            lead = m.group().rpartition("\f")[2]
            width = (len(lead.expandtabs(8)), len(lead))
            if width[0] > indents[-1][0]:
                if width[1] <= indents[-1][1]:
                    return out.broken(at)
                indents.append(width)
                out.add("INDENT", at)
            while width[0] < indents[-1][0]:
                indents.pop()
                out.add("DEDENT", at)
            if width != indents[-1]:
                return out.broken(at)
            fresh = False
        inside = fields and fields[-1][1] == depth
        if inside and text[at] == "!" and not text.startswith("!=", at):
            m = re.compile(r"!\s*(?:r|s|a)\s*(?=[:}])").match(text, at)
            if not m:
                return out.broken(at)
            out.add("CONV", at)
            at = m.end()
            continue
        if inside and text[at] == ":":
            out.add(":", at)
            i = literal(at + 1, fields[-1][0], True)
            if i < 0:
                return out.broken(at)
            if text[i] == "{":  # a field inside the format
                quote = fields[-1][0]
                fields.append((quote, depth + 1))
                out.add("{", i)
                depth += 1
                at = i + 1
            elif text[i] == "}":
                at = i
                out.add("}", at)
                depth -= 1
                at = _leave_field(text, at + 1, fields, literal, after_text, depth)
                if at < 0:
                    return out.broken(i)
            else:
                return out.broken(i)
            continue
        m = _PY.match(text, at)
        if not m:
            return out.broken(at)
        kind, word = m.lastgroup, m.group()
        if kind == "line":
            if not depth and not fields:
                if out.kinds and not fresh:
                    out.add("NEWLINE", at)
                fresh = True
        elif kind == "id":
            out.word(word, at)
        elif kind in ("num", "str"):
            out.add(kind.upper(), at)
        elif kind == "fopen":
            out.add("FOPEN", at)
            quote = word.lstrip("fFrR")
            fields.append((quote, -1))
            i = literal(m.end(), quote, False)
            if i < 0:
                return out.broken(at)
            at = after_text(i)
            continue
        elif kind == "op":
            if word in ("(", "[", "{"):
                depth += 1
            elif word in (")", "]", "}"):
                closes = fields and fields[-1][1] == depth and word == "}"
                depth = max(0, depth - 1)
                if closes:
                    out.add(word, at)
                    at = _leave_field(text, at + 1, fields, literal, after_text, depth)
                    if at < 0:
                        return out.broken(m.start())
                    continue
            out.add(word, at)
        at = m.end()
    if fields:
        return out.broken(size)
    if out.kinds and not fresh:
        out.add("NEWLINE", size)
    for _ in indents[1:]:
        out.add("DEDENT", size)
    return out.done(size)


def _leave_field(text, at, fields, literal, after_text, depth) -> int:
    """Go on behind a field: in the format around it, or in the string's text."""
    nested = len(fields) > 1 and fields[-2][1] == depth and fields[-2][0] == fields[-1][0]
    if not nested:
        fields[-1] = (fields[-1][0], -1)
        i = literal(at, fields[-1][0], False)
        return -1 if i < 0 else after_text(i)
    fields.pop()
    i = literal(at, fields[-1][0], True)
    if i < 0 or text[i] not in "{}":
        return -1
    if text[i] == "{":
        fields.append((fields[-1][0], depth + 1))
        return after_text(i)
    return i


_JAVA_ESC = r"\\(?:u+[0-9a-fA-F]{4}|[0-3]?[0-7]{1,2}|[btnfrs'\"\\])"
_JAVA = re.compile(
    rf"""(?P<space>\s+|//[^\r\n]*|/\*.*?\*/)|(?P<STR>\"\"\"[ \t\f]*\r?\n(?:[^\\"]|{_JAVA_ESC}|\\\r?\n|"(?!\"\"))*\"\"\"|"(?!\"\")(?:[^"\\\r\n]|{_JAVA_ESC})*"|\"\"(?!\"))
    |(?P<CHAR>'(?:[^'\\\r\n]|{_JAVA_ESC})')
    |(?P<NUM>(?:0[xX](?:[0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d[\d_]*[fFdD]?|[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?)|0[bB][01](?:[01_]*[01])?[lL]?|(?:\d(?:[\d_]*\d)?\.?(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)(?![\w$]))
    |(?P<word>non-sealed|(?:[^\W\d]|\$)[\w$]*)
    |(?P<op>{_alternatives("...", ">>>=", "<<=", ">>=", "->", "::", "++", "--", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", *"(){}[];,.@=<>!~?:+-*/&|^%")})""",
    re.X | re.S,
)


def java_tokens(text: str, grammar: Grammar, at: int) -> Tokens:
    out, size = _Out(grammar), len(text)
    while at < size:
        m = _JAVA.match(text, at)
        if not m:
            return out.broken(at)
        kind = m.lastgroup
        if kind == "word":
            out.word(m.group(), at)
        elif kind == "op":
            out.add(m.group(), at)
        elif kind != "space":
            out.add(kind, at)
        at = m.end()
    return out.done(size)


_GO_ESC = r"\\(?:[abfnrtv\\]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_GO = re.compile(
    rf"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<STR>"(?:[^"\\\n]|{_GO_ESC}|\\")*"|`[^`]*`)|(?P<CHAR>'(?:[^'\\\n]|{_GO_ESC}|\\')')
    |(?P<NUM>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?[\d_]+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?[\d_]+)?)i?(?!\w))
    |(?P<word>{_ID})|(?P<op>{_alternatives("...", "<<=", ">>=", "&^=", "&&", "||", "<-", "++", "--", "==", "!=", "<=", ">=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "&^", *"+-*/%&|^<>=!()[]{},;.:~")})""",
    re.X | re.S,
)
_GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


def go_tokens(text: str, grammar: Grammar, at: int) -> Tokens:
    """A semicolon is put after a line's last token where the language says so."""
    out, size, ends = _Out(grammar), len(text), False
    while at < size:
        m = _GO.match(text, at)
        if not m:
            return out.broken(at)
        kind, word = m.lastgroup, m.group()
        if kind == "line" or kind == "comment" and "\n" in word:
            if ends:
                out.add(";", at)
            ends = False
        elif kind == "word":
            out.word(word, at)
            ends = word in _GO_ENDS or word not in _GO_KEYWORDS
        elif kind == "op":
            out.add(word, at)
            ends = word in _GO_ENDS
        elif kind in ("STR", "CHAR", "NUM"):
            out.add(kind, at)
            ends = True
        at = m.end()
    if ends:
        out.add(";", size)
    return out.done(size)


_OPEN_CLOSE = re.compile(r"/\*|\*/")


def _nested_comment(text: str, at: int) -> int:
    """End of the nested comment that starts at ``at``, or -1."""
    depth = 0
    for m in _OPEN_CLOSE.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


_RUST_ESC = r"\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[nrt\\0'\"])"
_RUST = re.compile(
    rf"""(?P<space>\s+|//[^\n]*)|(?P<comment>/\*)|(?P<raw>(?:br|cr|r)(?P<hash>\#*)")|(?P<STR>[bc]?"(?:[^"\\]|{_RUST_ESC}|\\\r?\n)*")|(?P<CHAR>b?'(?:[^'\\\n\r\t]|{_RUST_ESC})')|(?P<LIFETIME>'{_ID}(?!'))
    |(?P<NUM>(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))
    |(?P<word>r\#{_ID}|{_ID})|(?P<op>{_alternatives("...", "..=", "<<=", ">>=", "..", "::", "->", "=>", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", *"+-*/%^!&|=<>@.,;:#$?~(){}[]")})""",
    re.X | re.S,
)


def rust_tokens(text: str, grammar: Grammar, at: int) -> Tokens:
    out, size = _Out(grammar), len(text)
    while at < size:
        if text[at] == " ":
            at += 1
            continue
        m = _RUST.match(text, at)
        if not m:
            return out.broken(at)
        kind, end = m.lastgroup, m.end()
        if kind == "comment":
            end = _nested_comment(text, at)
            if end < 0:
                return out.broken(at)
        elif kind in ("raw", "hash"):
            close = text.find('"' + m["hash"], end)
            if close < 0:
                return out.broken(at)
            out.add("STR", at)
            end = close + 1 + len(m["hash"])
        elif kind == "word":
            out.word(m.group(), at)
        elif kind == "op":
            out.add(m.group(), at)
        elif kind != "space":
            out.add(kind, at)
        at = end
    return out.done(size)


_KT = re.compile(
    rf"""(?P<space>[ \t\f\r]+|//[^\n]*)|(?P<line>\n)|(?P<comment>/\*)|(?P<raw>\"\"\")|(?P<quote>")|(?P<CHAR>'(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{{4}}|[tbrn'"\\$]))')
    |(?P<NUM>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?[\d_]+)?[fF]?|\d[\d_]*(?:[eE][+-]?[\d_]+)?[fF]?)(?:[uU]?L?)(?!\w))
    |(?P<op>!is\b|!in\b|as\?|{_alternatives("...", "..<", "===", "!==", "..", "?.", "?:", "::", "->", "&&", "||", "==", "!=", "<=", ">=", "++", "--", "+=", "-=", "*=", "/=", "%=", "!!", *"{}()[];,.<>+-*/%=!?:@&")})
    |(?P<word>{_ID}|`[^`\r\n]+`)""",
    re.X | re.S,
)
_KT_PART = re.compile(r"(?:[^\"\\$\n]|\\(?:u[0-9a-fA-F]{4}|[tbrn'\"\\$])|\$(?![\w`{]))+")
_KT_RAW_PART = re.compile(r"(?:[^\"$]|\"(?!\"\")|\"(?=\"\"\")|\$(?![\w`{]))+", re.S)
_KT_VAR = re.compile(rf"\$(?:{_ID}|`[^`\r\n]+`)")
_KT_AT = re.compile(rf"@{_ID}")


def kotlin_tokens(text: str, grammar: Grammar, at: int) -> Tokens:
    """Line breaks inside parentheses and brackets are no ends of statements and not flagged."""
    out, size, broke = _Out(grammar), len(text), False
    stack: list[str] = []

    def string_rest(i: int, quote: str) -> int:
        part = _KT_RAW_PART if len(quote) == 3 else _KT_PART
        while True:
            if m := part.match(text, i):
                out.add("PART", i)
                i = m.end()
            if text.startswith(quote, i):
                out.add("CLOSE", i)
                return i + len(quote)
            if text.startswith("${", i):
                out.add("${", i)
                stack.append(quote)
                return i + 2
            m = _KT_VAR.match(text, i)
            if not m:
                return -1
            out.add("VAR", i)
            i = m.end()

    while at < size:
        if text[at] == " ":
            at += 1
            continue
        m = _KT.match(text, at)
        if not m:
            return out.broken(at)
        kind, word, end = m.lastgroup, m.group(), m.end()
        if kind == "line":
            broke = broke or not stack or stack[-1] not in "(["
        elif kind == "comment":
            end = _nested_comment(text, at)
            if end < 0:
                return out.broken(at)
            broke = broke or "\n" in text[at:end] and (not stack or stack[-1] not in "([")
        elif kind in ("raw", "quote"):
            out.add("OPEN", at, broke)
            end, broke = string_rest(end, word), False
            if end < 0:
                return out.broken(at)
        elif kind != "space":
            if kind == "word":
                out.word(word, at, broke)
                if word in ("this", "super", "return", "continue", "break") and (a := _KT_AT.match(text, end)):
                    out.add("THISAT", end)
                    end = a.end()
            elif kind == "op":
                out.add(word, at, broke)
                if word in "([{":
                    stack.append(word)
                elif word in ")]}" and stack:
                    top = stack.pop()
                    if word == "}" and top[0] == '"':
                        end = string_rest(end, top)
                        if end < 0:
                            return out.broken(at)
            else:
                out.add(kind, at, broke)
            broke = False
        at = end
    return out.done(size)
