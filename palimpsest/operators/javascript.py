"""JavaScript and TypeScript sources to entities, calls, identifiers, imports and exports, from a token list."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property
from typing import NamedTuple

_SPACE = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_WORD = re.compile(r"#?[^\W\d][\w$]*|\$[\w$]*|#\$[\w$]*")
_NUMBER = re.compile(r"\d[\w.]*|\.\d[\w.]*")
_QUOTED = re.compile(r"'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_SIGN = re.compile(r"=>|\?\.(?!\d)|\.\.\.|[^\s\w]")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

# Words that are no names.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with yield let await".split()
)
#: Words after which a slash begins a pattern.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_NO_NAMES = RESERVED | {"async", "static", "of", "from"}
_MODIFIERS = frozenset("static async get set public private protected readonly override abstract declare".split())


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    end: int


class Entity(NamedTuple):
    kind: str
    symbol: str
    parent: str | None
    start_line: int
    end_line: int
    text: str
    calls: list[tuple[str, int, int]]
    identifiers: list[str]


def tokens(source: str) -> list[Token]:
    """Words, numbers, strings, patterns and signs; a template is one string, but what its ${} hold is cut into tokens too.

    A slash begins a pattern where no value ends before it. Whatever is left open at the end ends there.
    """
    out: list[Token] = []
    stack: list[str] = []
    at, n = 0, len(source)

    def template(i: int) -> int:
        start = i
        while i < n:
            if source[i] == "\\":
                i += 2
            elif source[i] == "`":
                out.append(Token("string", source[start : i + 1], start, i + 1))
                return i + 1
            elif source.startswith("${", i):
                out.append(Token("string", source[start:i], start, i))
                out.append(Token("sign", "{", i + 1, i + 2))
                stack.append("template")
                return i + 2
            else:
                i += 1
        out.append(Token("string", source[start:], start, n))
        return n

    while at < n:
        if m := _SPACE.match(source, at):
            at = m.end()
            continue
        c = source[at]
        if c == "`":
            out.append(Token("string", "`", at, at + 1))
            at = template(at + 1)
            continue
        if c in "'\"":
            kind, m = "string", _QUOTED.match(source, at)
        elif m := _WORD.match(source, at):
            kind = "word"
        elif m := _NUMBER.match(source, at):
            kind = "number"
        elif c == "/" and not _ends_value(out) and (m := _PATTERN.match(source, at)):
            kind = "string"
        else:
            kind, m = "sign", _SIGN.match(source, at)
        if not m:
            at += 1
            continue
        out.append(Token(kind, m[0], at, m.end()))
        at = m.end()
        if kind == "sign" and m[0] == "{":
            stack.append("block")
        elif kind == "sign" and m[0] == "}" and stack and stack.pop() == "template":
            at = template(at)
    return out


def _ends_value(before: list[Token]) -> bool:
    if not before:
        return False
    last = before[-1]
    return last.kind in ("number", "string") or last.text in (")", "]", "}") or last.kind == "word" and last.text not in _BEFORE_PATTERN


def _partners(found: list[Token]) -> dict[int, int]:
    """Index of the closing sign for each opening one, and the other way round; unclosed ones end with the last token."""
    ends, open_ = {}, []
    for i, t in enumerate(found):
        if t.kind != "sign":
            continue
        if t.text in _OPEN:
            open_.append(i)
        elif t.text in _CLOSE:
            while open_ and _OPEN[found[open_[-1]].text] != t.text:
                ends[open_.pop()] = i
            if open_:
                ends[i] = open_[-1]
                ends[open_.pop()] = i
    for i in open_:
        ends[i] = len(found) - 1
    return ends


class Source:
    """One file, cut into tokens once."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.found = tokens(self.text)
        self.ends = _partners(self.found)
        self.lines = self.text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at, hi=len(self.lines))

    def column(self, at: int) -> int:
        """Byte column, from 1."""
        return len(self.text[self.starts[self.line(at) - 1] : at].encode("utf-8", "replace")) + 1

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.found) and self.found[i].kind != "string" and self.found[i].text in texts

    def _word(self, i: int) -> bool:
        return 0 <= i < len(self.found) and self.found[i].kind == "word"

    def _past_type(self, i: int) -> int:
        """The index behind a `: type` that stands before a body or an arrow; a type with braces is not read."""
        if not self._is(i, ":"):
            return i
        i += 1
        while i < len(self.found) and not self._is(i, "{", "=>", ";", ",", ")", "="):
            i = self.ends.get(i, i) + 1 if self._is(i, "(", "[") else i + 1
        return i

    def _body(self, i: int) -> int | None:
        """The index of the closing brace of parameters and a body that begin at i."""
        if self._is(i, "<"):
            while i < len(self.found) and not self._is(i, "("):
                i += 1
        if not self._is(i, "(") or i not in self.ends:
            return None
        i = self._past_type(self.ends[i] + 1)
        return self.ends[i] if self._is(i, "{") and i in self.ends else None

    def _expression(self, i: int) -> int:
        """The index of the last token of the expression that begins at i: it ends before a comma, a semicolon, a closing
        sign, or a line's start that cannot carry it on."""
        last = i
        while i < len(self.found):
            t = self.found[i]
            if self._is(i, ",", ";", ")", "]", "}"):
                break
            if i > last and self.line(t.at) > self.line(self.found[last].end) and _ends_value(self.found[last : last + 1]) and (t.kind in ("word", "number") and t.text not in ("in", "instanceof")):
                break
            last = self.ends.get(i, i) if self._is(i, "(", "[", "{") else i
            i = last + 1
        return last

    def _function(self, i: int) -> tuple[str, int] | None:
        """(arrow_function or function_expression, index of its last token) of a function that begins at i."""
        if self._is(i, "async"):
            i += 1
        if self._is(i, "function"):
            i += 1
            if self._is(i, "*"):
                return None
            end = self._body(i + 1 if self._word(i) else i)
            return ("function_expression", end) if end is not None else None
        if self._is(i, "<"):
            while i < len(self.found) and not self._is(i, "("):
                i += 1
        if self._is(i, "(") and i in self.ends:
            i = self._past_type(self.ends[i] + 1)
        elif self._word(i) and self.found[i].text not in RESERVED:
            i += 1
        else:
            return None
        if not self._is(i, "=>") or i + 1 >= len(self.found):
            return None
        i += 1
        return "arrow_function", self.ends[i] if self._is(i, "{") and i in self.ends else self._expression(i)

    @cached_property
    def spans(self) -> list[tuple[int, int, str, str]]:
        """(first token, last token, kind, symbol) of each entity, nested ones too."""
        out = []
        classes = set()
        for i, t in enumerate(self.found):
            if t.kind != "word" or self._is(i - 1, ".", "?."):
                continue
            if t.text == "class" and self._word(i + 1) and self.found[i + 1].text not in RESERVED:
                j = i + 2
                while j < len(self.found) and not self._is(j, "{", ";"):
                    j = self.ends.get(j, j) + 1 if self._is(j, "(", "[") else j + 1
                if self._is(j, "{") and j in self.ends:
                    classes.add(j)
                    if self._statement(i):
                        out.append((i, self.ends[j], "class", self.found[i + 1].text))
            elif t.text == "class":
                j = i + 1
                while j < len(self.found) and not self._is(j, "{", ";", ")"):
                    j += 1
                if self._is(j, "{"):
                    classes.add(j)
            elif t.text == "function" and self._word(i + 1):
                first = i - 1 if self._is(i - 1, "async") else i
                end = self._body(i + 2)
                if end is not None and self._statement(first):
                    out.append((first, end, "function", self.found[i + 1].text))
            elif t.text not in RESERVED and self._is(i + 1, "=", ":") and self._declared(i) and (got := self._value(i)):
                out.append((i, got[1], got[0], t.text))
        for j in classes:
            out += self._members(j, True)
        for j, t in enumerate(self.found):
            if t.kind == "sign" and t.text == "{" and j not in classes and self._object(j):
                out += self._members(j, False)
        return sorted(set(out), key=lambda x: (self.line(self.found[x[0]].at), self.found[x[0]].at, self.found[x[1]].end, x[3]))

    def _statement(self, i: int) -> bool:
        """Whether a declaration, not an expression, begins at i."""
        return i == 0 or self._is(i - 1, ";", "{", "}", ")", "export", "default", "else", "declare", "abstract") or self.line(self.found[i - 1].end) < self.line(self.found[i].at) and _ends_value(self.found[i - 1 : i])

    def _declared(self, i: int) -> bool:
        """Whether the word at i is bound by const, let or var, first or behind a comma of the same statement."""
        return self._is(i - 1, "const", "let", "var") or i - 1 in self._commas

    @cached_property
    def _commas(self) -> set[int]:
        """The commas between the bindings of one const, let or var."""
        out, open_ = set(), [False]
        for i, t in enumerate(self.found):
            if self._is(i, "const", "let", "var"):
                open_[-1] = True
            elif self._is(i, ";"):
                open_[-1] = False
            elif self._is(i, *_OPEN):
                open_.append(False)
            elif self._is(i, *_CLOSE) and len(open_) > 1:
                open_.pop()
            elif self._is(i, ",") and open_[-1]:
                out.add(i)
        return out

    def _value(self, i: int) -> tuple[str, int] | None:
        """The function bound to the name at i."""
        i = i + 1
        if self._is(i, ":"):
            while i < len(self.found) and not self._is(i, "=", ";"):
                i = self.ends.get(i, i) + 1 if self._is(i, "(", "[", "{") else i + 1
        return self._function(i + 1) if self._is(i, "=") else None

    def _object(self, j: int) -> bool:
        """Whether the brace at j opens an object, not a block."""
        return self._is(j - 1, "=", "(", ",", "[", ":", "?", "return", "default", "=>", "|", "&") and not (self._is(j - 1, "=>"))

    def _members(self, j: int, of_class: bool) -> list[tuple[int, int, str, str]]:
        """Methods, and functions bound to keys or fields, right below the brace at j."""
        out, i, stop = [], j + 1, self.ends.get(j, len(self.found) - 1)
        while i < stop:
            first = i
            while self._word(i) and self.found[i].text in _MODIFIERS and not self._is(i + 1, "(", "=", ":", ",", ";", "}"):
                i += 1
            if self._is(i, "*"):
                i += 1
            named = self._word(i) or i < stop and self.found[i].kind in ("string", "number")
            if named and (end := self._body(i + 1)) is not None:
                symbol = self.found[i].text
                out.append((first, end, "constructor" if symbol == "constructor" else "method", symbol))
                i = end + 1
                continue
            bound = i + 1
            if of_class and named and self._is(bound, ":"):
                while bound < stop and not self._is(bound, "=", ";"):
                    bound += 1
            if named and self._is(bound, "=" if of_class else ":") and (got := self._function(bound + 1)):
                out.append((first, got[1], "object_method", self.found[i].text))
                i = got[1] + 1
                continue
            while i < stop and not self._is(i, ";" if of_class else ","):
                if of_class and i > first and self._is(i, "}"):
                    break
                i = self.ends.get(i, i) + 1 if self._is(i, "(", "[", "{") and self.ends.get(i, i) > i else i + 1
                if of_class and i < stop and self._word(i) and self.line(self.found[i - 1].end) < self.line(self.found[i].at) and _ends_value(self.found[i - 1 : i]):
                    i -= 1
                    break
            i += 1
        return out

    def calls(self, first: int, last: int) -> list[tuple[str, int, int]]:
        """(name, line, byte column) of each call among tokens first to last; a chain is named from its beginning."""
        out = []
        for i in range(first, last + 1):
            if not self._is(i, "(") or not self._word(i - 1) or i - 1 < first or self.found[i - 1].text in RESERVED - {"super", "import"}:
                continue
            j = i - 1
            while j - 2 >= first and self._is(j - 1, ".", "?."):
                if self._is(j - 2, ")", "]") and self.ends.get(j - 2, j) < j - 2:
                    j = self.ends[j - 2]
                    while j - 1 >= first and (self._word(j - 1) and self.found[j - 1].text not in RESERVED - {"this", "super"} or self._is(j - 1, ")", "]") and self.ends.get(j - 1, j) < j - 1):
                        j = j - 1 if self._word(j - 1) else self.ends[j - 1]
                        if self._is(j - 1, ".", "?."):
                            break
                elif self._word(j - 2) or self.found[j - 2].kind == "string":
                    j -= 2
                else:
                    break
            arrow = self._is(j, "async") and j == i - 1 and i in self.ends and self._is(self._past_type(self.ends[i] + 1), "=>")
            if arrow or self._is(j - 1, "function", "new", "class") or self._is(j - 1, "*") and self._is(j - 2, "function") or self._defines(i):
                continue
            start = self.found[j].at
            out.append((self.text[start : self.found[i - 1].end], self.line(start), self.column(start), (j, -i)))
        return [x[:3] for x in sorted(out, key=lambda x: x[3])]

    def _defines(self, i: int) -> bool:
        """Whether the parenthesis at i holds a method's parameters."""
        return self._body(i) is not None and not self._is(i - 2, ".", "?.") and self._body(i) in self._method_ends

    @cached_property
    def _method_ends(self) -> set[int]:
        return {e for _, e, kind, _ in self.spans if kind in ("method", "constructor")}

    def identifiers(self, first: int, last: int) -> list[str]:
        return sorted({t.text for t in self.found[first : last + 1] if t.kind == "word" and t.text not in _NO_NAMES and not t.text.startswith("#")})

    def statements(self, word: str) -> list[str]:
        """The texts of the top-level statements that begin with word."""
        out, i = [], 0
        while i < len(self.found):
            if self._is(i, word) and not (word == "import" and self._is(i + 1, "(", ".")):
                last = self._statement_end(i)
                out.append(self.text[self.found[i].at : self.found[last].end].strip())
                i = last + 1
            else:
                i = self.ends.get(i, i) + 1 if self._is(i, "(", "[", "{") else i + 1
        return out

    def _statement_end(self, i: int) -> int:
        last = i
        while i < len(self.found) and not self._is(i, ";"):
            t = self.found[i]
            if i > last and self.line(t.at) > self.line(self.found[last].end) and _ends_value(self.found[last : last + 1]) and t.kind == "word" and t.text not in ("from", "in", "instanceof"):
                return last
            last = self.ends.get(i, i) if self._is(i, "(", "[", "{") else i
            i = last + 1
        return i if self._is(i, ";") else last

    def entities(self) -> list[Entity]:
        """Declarations, classes, methods and bound functions by place; each with the smallest one around it."""
        spans = self.spans
        at = [(self.found[a].at, self.found[b].end) for a, b, _, _ in spans]
        out = []
        around: list[int] = []
        by_start = sorted(range(len(spans)), key=lambda k: (at[k][0], -at[k][1]))
        parent: dict[int, str | None] = {}
        for k in by_start:
            while around and at[around[-1]][1] < at[k][1]:
                around.pop()
            parent[k] = spans[around[-1]][3] if around else None
            around.append(k)
        for k, (a, b, kind, symbol) in enumerate(spans):
            lo, hi = self.line(at[k][0]), self.line(at[k][1] - 1)
            out.append(Entity(kind, symbol, parent[k], lo, hi, "\n".join(self.lines[lo - 1 : hi]), self.calls(a, b), self.identifiers(a, b)))
        return sorted(out, key=lambda e: (e.start_line, e.end_line, e.symbol))
