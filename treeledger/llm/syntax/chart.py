"""A table-driven chart recogniser for grammars written as text.

A grammar is a set of rules over token kinds. Loading it computes the first sets of all
expressions and writes each rule as a function over integer arrays, compiled once: a choice
looks its alternatives up in a table by the kind of the next token, and what a rule matched
at a position is entered in a chart, so that no rule is tried twice at one place.
Alternatives are ordered: the first that matches counts.

Texts nested deeper than the interpreter's stack are read from their end: rules are tried
every few hundred tokens, the last ones first, and leave in the chart what the rules before
them ask for, so no call goes deeper than one such stretch.

Notation, one rule per ``name = expression ;``:
  'x' a literal token, UPPER a token class, lower a rule, ( ) grouping, | choice,
  ? * + repetition, ** repetition after which the chart may be emptied, & ! look-ahead,
  e % 'x' a list of e separated by 'x', NL / NONL line break or none before the token,
  ^UPPER a token of the class stands before,
  UPPER := tokens ;  defines a class, {{ }} holds text for one dialect only.
"""

from __future__ import annotations

import re
import sys

#: Frames that a parse may use, and tokens of a stretch when more are needed.
FRAMES, STRETCH = 20_000, 256
#: Parts of a rule that is written out wherever it is used.
SHORT = 4
_PIECE = re.compile(r"\s+|\#[^\n]*|(?P<lit>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>:=|\*\*|[=|;()?*+&!%^])")


class Tokens(list):
    """Token kinds of one text, ended by the kind of EOF; with line-break flags and offsets."""

    __slots__ = ("breaks", "starts")

    def __init__(self, kinds, breaks, starts):
        super().__init__(kinds)
        self.breaks, self.starts = breaks, starts


class Grammar:
    def __init__(self, text: str, start: str, charted: tuple[str, ...] = ()):
        """``charted``: rules that choices ask for again at one place; others enter the chart only as far as every recursion needs one that does."""
        text = re.sub(r"\{\{|\}\}", "", text)
        self.kinds: dict[str, int] = {"EOF": 0}
        self.classes: dict[str, list[str]] = {}
        self.rules: dict[str, tuple] = {}
        self._pieces = [m for m in _PIECE.finditer(text) if m.lastgroup]
        self._at = 0
        while self._at < len(self._pieces):
            name = self._take("name")
            op = self._take("op")
            if op == ":=":
                members = []
                while self._peek() != ";":
                    members.append(self._pieces[self._at].group().strip("'"))
                    self._at += 1
                self.classes[name] = members
            else:
                self.rules[name] = self._choice()
            self._expect(";")
        for name, members in self.classes.items():
            for m in members:
                self._kind(m)
        self.names = list(self.rules)
        self.sets = {n: frozenset(self._members(n)) for n in self.classes}
        for e in self.rules.values():
            self._register(e)
        self.empty: dict[str, bool] = dict.fromkeys(self.rules, False)
        self.first: dict[str, frozenset] = dict.fromkeys(self.rules, frozenset())
        moved = True
        while moved:
            moved = False
            for n, e in self.rules.items():
                f, nul = self._first(e), self._nullable(e)
                if f != self.first[n] or nul != self.empty[n]:
                    self.first[n], self.empty[n], moved = f, nul, True
        self.start = start
        self.charted = set(charted)
        while cycle := self._recursive(self.charted):
            self.charted.add(max(sorted(cycle), key=lambda n: sum(n in self._refs(e) for m, e in self.rules.items() if m in cycle)))
        self._fast = _Code(self, False, False)
        self._others: dict[tuple[bool, bool], _Code] = {}

    # reading the text

    def _peek(self):
        return self._pieces[self._at].group() if self._at < len(self._pieces) else ";"

    def _take(self, kind):
        m = self._pieces[self._at]
        if m.lastgroup != kind:
            raise ValueError(f"grammar: {kind} expected at {m.group()!r}")
        self._at += 1
        return m.group()

    def _expect(self, op):
        if self._peek() != op:
            raise ValueError(f"grammar: {op} expected, found {self._peek()!r} after {self._pieces[self._at - 1].group()!r} near {[m.group() for m in self._pieces[max(0, self._at - 9) : self._at]]}")
        self._at += 1

    def _choice(self):
        alts = [self._sequence()]
        while self._peek() == "|":
            self._at += 1
            alts.append(self._sequence())
        return alts[0] if len(alts) == 1 else ("alt", *alts)

    def _sequence(self):
        items = []
        while self._peek() not in ("|", ")", ";"):
            items.append(self._item())
        return items[0] if len(items) == 1 else ("seq", *items)

    def _item(self):
        p = self._peek()
        if p in ("&", "!", "^"):
            self._at += 1
            return ({"&": "and", "!": "not", "^": "back"}[p], self._item())
        if p == "(":
            self._at += 1
            e = self._choice()
            self._expect(")")
        else:
            self._at += 1
            e = ("lit", p[1:-1]) if p[0] == "'" else ("brk", p == "NL") if p in ("NL", "NONL") else ("cls", p) if p.isupper() else ("ref", p)
        while self._peek() in ("?", "*", "+", "**", "%"):
            op = self._peek()
            self._at += 1
            if op == "%":
                e = ("seq", e, ("star", ("seq", self._item(), e)))
            else:
                e = {"?": ("opt", e), "*": ("star", e), "**": ("loop", e), "+": ("seq", e, ("star", e))}[op]
        return e

    # sets

    def _kind(self, text):
        return None if text in self.classes else self.kinds.setdefault(text, len(self.kinds))

    def _members(self, name):
        for m in self.classes[name]:
            if m in self.classes:
                yield from self._members(m)
            else:
                yield self.kinds[m]

    def _register(self, e):
        if e[0] == "lit":
            self._kind(e[1])
        elif e[0] == "cls" and e[1] not in self.classes:
            self._kind(e[1])
        elif e[0] == "ref":
            if e[1] not in self.rules:
                raise ValueError(f"grammar: no rule {e[1]}")
        elif e[0] != "brk":
            for x in e[1:]:
                if isinstance(x, tuple):
                    self._register(x)

    def _nullable(self, e):
        t = e[0]
        if t == "ref":
            return self.empty[e[1]]
        if t == "seq":
            return all(map(self._nullable, e[1:]))
        if t == "alt":
            return any(map(self._nullable, e[1:]))
        return t in ("opt", "star", "loop", "and", "not", "back", "brk")

    def _first(self, e):
        t = e[0]
        if t == "lit":
            return frozenset((self.kinds[e[1]],))
        if t == "cls":
            return self.sets[e[1]] if e[1] in self.sets else frozenset((self.kinds[e[1]],))
        if t == "ref":
            return self.first[e[1]]
        if t in ("and", "not", "back", "brk"):
            return frozenset()
        if t == "alt":
            return frozenset().union(*map(self._first, e[1:]))
        out = frozenset()
        for x in e[1:]:
            out |= self._first(x)
            if t == "seq" and not self._nullable(x):
                break
        return out

    def _refs(self, e) -> set[str]:
        return {e[1]} if e[0] == "ref" else set().union(*(self._refs(x) for x in e[1:] if isinstance(x, tuple))) if e[0] not in ("lit", "cls", "brk") else set()

    def _recursive(self, cut: set[str] = frozenset()) -> set[str]:
        """Rules that reach themselves, but not through the rules of ``cut``."""
        below = {n: self._refs(e) - cut for n, e in self.rules.items() if n not in cut}
        moved = True
        while moved:
            moved = False
            for n, found in below.items():
                more = found.union(*(below[m] for m in found))
                if len(more) > len(found):
                    below[n], moved = more, True
        return {n for n, found in below.items() if n in found}

    def accepts(self, tokens: Tokens) -> bool:
        """Whether the tokens form the start rule; False too where a text is nested too deep for a quick answer."""
        if sys.getrecursionlimit() < FRAMES:
            sys.setrecursionlimit(FRAMES)
        try:
            return self._fast.run(tokens)[0] == len(tokens)
        except RecursionError:
            return False

    def error_at(self, tokens: Tokens) -> int | None:
        """None when the tokens form the start rule, else the index of the first token that no parse gets over."""
        if sys.getrecursionlimit() < FRAMES:
            sys.setrecursionlimit(FRAMES)
        deep = False
        try:
            end, _ = self._fast.run(tokens)
        except RecursionError:
            deep = True
            end, _ = self._code(False, True).run(tokens)
        if end == len(tokens):
            return None
        try:
            _, far = self._code(True, deep).run(tokens)
        except RecursionError:
            _, far = self._code(True, True).run(tokens)
        return min(far, len(tokens) - 1)

    def _code(self, tracked: bool, deep: bool) -> _Code:
        if (tracked, deep) not in self._others:
            self._others[tracked, deep] = _Code(self, tracked, deep)
        return self._others[tracked, deep]


class _Code:
    """The functions of a grammar's rules.

    ``tracked`` ones note the furthest token reached; ``deep`` ones keep the whole chart and
    enter every rule that reaches itself.
    """

    def __init__(self, grammar: Grammar, tracked: bool, deep: bool):
        self.g, self.tracked, self.deep = grammar, tracked, deep
        self.charted = grammar._recursive() if deep else grammar.charted
        self.lines: list[str] = []
        self.names: dict = {"chart": {}, "far": [0]}
        self.sets: dict[frozenset, str] = {}
        self.count = 0
        self.tables: list[tuple[str, dict[int, str]]] = []
        self.pending: list[tuple[str, tuple]] = []
        uses = [r for e in grammar.rules.values() for r in self._mentions(e)]
        #: Rules that are written where they are used: those of one place, and short ones.
        self.inline = {n for n, e in grammar.rules.items() if n not in self.charted and n != grammar.start and (uses.count(n) == 1 or self._size(e) <= SHORT)}
        self.number = {n: i for i, n in enumerate(grammar.rules)}
        for name, e in grammar.rules.items():
            if name not in self.inline:
                self._rule(name, e)
        while self.pending:
            name, e = self.pending.pop()
            self._add(0, f"def {name}(p):")
            self._emit(e, "p", "q", 1)
            self._add(1, "return q")
        exec(compile("\n".join(self.lines), "<grammar>", "exec"), self.names)
        for table, functions in self.tables:
            self.names[table].update({k: self.names[f] for k, f in functions.items()})

    def run(self, tokens: Tokens) -> tuple[int, int]:
        """End of the start rule, -1 without one, and the furthest token reached."""
        self.names["k"], self.names["brk"] = list(tokens), tokens.breaks
        chart, far = self.names["chart"], self.names["far"]
        chart.clear()
        far[0] = 0
        if self.deep:
            rules = [(self.g.first[n], self.g.empty[n], self.names[f"r{self.number[n]}"]) for n in self.charted]
            for place in range(len(tokens) // STRETCH * STRETCH, 0, -STRETCH):
                for p in range(place, min(place + 16, len(tokens))):
                    for first, empty, rule in rules:
                        if empty or tokens[p] in first:
                            rule(p)
        try:
            return self.names[f"r{self.number[self.g.start]}"](0), far[0]
        finally:
            chart.clear()

    # writing

    def _add(self, depth: int, line: str) -> None:
        self.lines.append(" " * depth + line)

    def _fresh(self, stem: str) -> str:
        self.count += 1
        return f"{stem}{self.count}"

    def _mentions(self, e):
        if e[0] == "ref":
            yield e[1]
        elif e[0] not in ("lit", "cls", "brk"):
            for x in e[1:]:
                yield from self._mentions(x)

    def _size(self, e) -> int:
        return 1 if e[0] in ("lit", "cls", "brk", "ref") else sum(map(self._size, e[1:]))

    def _token(self, e) -> frozenset | None:
        """The kinds of which the expression is exactly one token; None for anything else."""
        if e[0] in ("lit", "cls"):
            return self.g._first(e)
        if e[0] == "alt":
            parts = [self._token(x) for x in e[1:]]
            return None if None in parts else frozenset().union(*parts)
        if e[0] == "ref" and e[1] not in self.charted:
            return self._token(self.g.rules[e[1]]) if e[1] in getattr(self, "inline", ()) else None
        return None

    def _test(self, kinds: frozenset, at: str) -> str:
        if len(kinds) == 1:
            return f"k[{at}] == {next(iter(kinds))}"
        if kinds not in self.sets:
            self.sets[kinds] = f"s{len(self.sets)}"
            self.names[self.sets[kinds]] = kinds
        return f"k[{at}] in {self.sets[kinds]}"

    def _guard(self, e, at: str) -> str | None:
        """Test of the next token before ``e`` is tried; None when it may match nothing."""
        return None if self.g._nullable(e) else self._test(self.g._first(e), at)

    def _rule(self, name: str, e) -> None:
        number = self.number[name]
        self._add(0, f"def r{number}(p):")
        if name in self.charted:
            self._add(1, f"key = p * {len(self.number)} + {number}")
            self._add(1, "q = chart.get(key)")
            self._add(1, "if q is None:")
            self._emit(e, "p", "q", 2)
            self._add(2, "chart[key] = q")
        else:
            self._emit(e, "p", "q", 1)
        self._add(1, "return q")

    def _reached(self, depth: int, place: str) -> None:
        if self.tracked:
            self._add(depth, f"if {place} > far[0]: far[0] = {place}")

    def _emit(self, e, src: str, dst: str, d: int) -> None:
        """Lines that set ``dst`` to the place behind ``e`` at ``src``, or to -1."""
        kind, kinds = e[0], self._token(e)
        if kinds is not None:
            self._add(d, f"{dst} = {src} + 1 if {self._test(kinds, src)} else -1")
            self._reached(d, dst)
        elif kind == "ref":
            if e[1] in self.inline:
                self._emit(self.g.rules[e[1]], src, dst, d)
                return
            guard = self._guard(e, src)
            call = f"r{self.number[e[1]]}({src})"
            self._add(d, f"{dst} = {call} if {guard} else -1" if guard else f"{dst} = {call}")
        elif kind == "brk":
            self._add(d, f"{dst} = {src} if {'' if e[1] else 'not '}brk[{src}] else -1")
        elif kind == "back":
            self._add(d, f"{dst} = {src} if {self._test(self._token(e[1]), src + ' - 1')} else -1")
        elif kind == "seq":
            if len(e) == 1:
                self._add(d, f"{dst} = {src}")
                return
            to = dst if dst != src else self._fresh("v")
            self._emit(e[1], src, to, d)
            depth = d
            for x in e[2:]:
                if x[0] not in ("opt", "star", "loop") or depth == d:
                    self._add(depth, f"if {to} >= 0:")
                    depth += 1
                self._emit(x, to, to, depth)
            if to != dst:
                self._add(d, f"{dst} = {to}")
        elif kind == "alt":
            self._alternatives(e[1:], src, dst, d)
        elif kind == "first":  # the table has looked at the next token already
            self._emit(e[1], src, dst, d)
            for x in e[2:]:
                self._add(d, f"if {dst} < 0:")
                d += 1
                self._emit(x, src, dst, d)
        elif kind in ("and", "not"):
            kinds, to = self._token(e[1]), self._fresh("v")
            if kinds is not None and not self.tracked:
                test = self._test(kinds, src)
                self._add(d, f"{dst} = {src} if {test} else -1" if kind == "and" else f"{dst} = -1 if {test} else {src}")
                return
            self._emit(e[1], src, to, d)
            self._add(d, f"{dst} = {src} if {to} {'>=' if kind == 'and' else '<'} 0 else -1")
        elif kind == "opt":
            kinds, guard = self._token(e[1]), self._guard(e[1], src)
            if kinds is not None:
                self._add(d, f"{dst} = {src} + 1 if {self._test(kinds, src)} else {src}")
                self._reached(d, dst)
                return
            if dst != src:
                self._add(d, f"{dst} = {src}")
            to = self._fresh("v")
            if guard:
                self._add(d, f"if {guard}:")
                d += 1
            self._emit(e[1], src, to, d)
            self._add(d, f"if {to} >= 0: {dst} = {to}")
        else:
            guard, to = self._guard(e[1], dst), self._fresh("v")
            if dst != src:
                self._add(d, f"{dst} = {src}")
            self._add(d, f"while {guard or 'True'}:")
            self._emit(e[1], dst, to, d + 1)
            self._add(d + 1, f"if {to} <= {dst}: break")
            self._add(d + 1, f"{dst} = {to}")
            if kind == "loop" and not self.deep:
                self._add(d + 1, "chart.clear()")

    def _alternatives(self, parts, src: str, dst: str, d: int) -> None:
        firsts = [(x, self.g._first(x), self.g._nullable(x)) for x in parts]
        to = dst if dst != src else self._fresh("v")
        if len(parts) <= 3:
            self._add(d, f"{to} = -1")
            for n, (x, first, empty) in enumerate(firsts):
                tests = ([f"{to} < 0"] if n else []) + ([] if empty else [self._test(first, src)])
                if tests:
                    self._add(d, f"if {' and '.join(tests)}:")
                self._emit(x, src, to, d + bool(tests))
        else:
            table, functions, made = self._fresh("t"), {}, {}
            for kind in frozenset().union(*(first for _, first, _ in firsts)):
                fits = tuple(n for n, (_, first, empty) in enumerate(firsts) if empty or kind in first)
                if fits not in made:
                    made[fits] = self._choice([parts[n] for n in fits])
                functions[kind] = made[fits]
            self.tables.append((table, functions))
            self.names[table] = {}
            always = [x for x, _, empty in firsts if empty]
            f = self._fresh("v")
            self._add(d, f"{f} = {table}.get(k[{src}])")
            self._add(d, f"{to} = {f}({src}) if {f} else {self._choice(always) + f'({src})' if always else -1}")
        if to != dst:
            self._add(d, f"{dst} = {to}")

    def _choice(self, parts) -> str:
        """Name of a function that tries the parts in order."""
        only = parts[0]
        if len(parts) == 1 and only[0] == "ref" and only[1] not in self.inline:
            return f"r{self.number[only[1]]}"
        name = self._fresh("a")
        self.pending.append((name, only if len(parts) == 1 else ("first", *parts)))
        return name


def dialect(text: str, keep: bool) -> str:
    """The grammar text with its {{ }} parts, or without."""
    return re.sub(r"\{\{(.*?)\}\}", r"\1" if keep else "", text, flags=re.S)
