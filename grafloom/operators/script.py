"""Definitions, imports and calls of JavaScript and TypeScript files (with JSX), from a token list.

``tokens`` splits a source and pairs its brackets; ``ScriptFile`` walks the tokens. Named functions, classes and
methods own what their bodies hold; the bodies of nameless functions count as their surroundings. Only what
stands directly in a module or function body is a definition: blocks of ``if`` and loops give calls alone.
"""

from __future__ import annotations

import bisect
import posixpath
import re
from dataclasses import dataclass

CODE = (".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "`<": ">`"}, (")", "]", "}", ">`")
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default", "extends"}
_NOT_CALLED = _BEFORE_VALUE - {"of"} | {"if", "for", "while", "switch", "catch", "with", "function", "super", "import", "var", "let", "const", "class"}
_CONTINUES = {"instanceof", "in", "of", "as", "satisfies", "extends", "implements"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"}
_LEX = re.compile(
    r"""(?P<skip>[\s﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<id>\#?[^\W\d][\w$]*|\#?\$[\w$]*)|(?P<num>\.?\d[\w.]*)|(?P<p>=>|\?\.(?!\d)|\.\.\.|===?|!==?|<=|&&|\|\||\?\?|\+\+|--|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TAG = re.compile(r"<(?=[A-Za-z_$>])(?![\w$]+\s*(?:,|extends\b))")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    mate: int = -1


class _Lexer:
    def __init__(self, source: str, jsx: bool):
        self.source, self.jsx, self.out, self.open = source, jsx, [], []
        self.lines = [m.start() for m in re.finditer("\n", source)]
        self.code(0, None)

    def add(self, kind: str, start: int, end: int, text: str | None = None) -> None:
        token = Token(kind, self.source[start:end] if text is None else text, start, end, bisect.bisect_left(self.lines, start) + 1)
        if kind == "p" and token.text in _OPEN:
            self.open.append(len(self.out))
        elif kind == "p" and token.text in _CLOSE:
            if self.open and _OPEN[self.out[self.open[-1]].text] == token.text:
                token.mate = self.open.pop()
                self.out[token.mate].mate = len(self.out)
            else:
                raise ValueError(f"unpaired {token.text} in line {token.line}")
        self.out.append(token)

    def value_next(self) -> bool:
        """Whether a value may begin here: decides what / and < mean."""
        last = self.out[-1] if self.out else None
        return last is None or (last.text in _BEFORE_VALUE if last.kind == "id" else last.kind == "p" and last.text not in (")", "]", "}", ">`", "++", "--"))

    def code(self, at: int, until: str | None) -> int:
        depth = 0
        while at < len(self.source):
            c = self.source[at]
            if c == "`":
                at = self.template(at)
                continue
            if c == "/" and self.value_next() and (m := _REGEX.match(self.source, at)):
                self.add("re", at, m.end())
                at = m.end()
                continue
            if c == "<" and self.jsx and (self.value_next() or self.out[-1].text == "}") and _TAG.match(self.source, at):
                at = self.element(at)
                continue
            m = _LEX.match(self.source, at)
            if m.lastgroup != "skip":
                if until and m[0] == "{":
                    depth += 1
                elif until and m[0] == "}":
                    if depth == 0:
                        return at
                    depth -= 1
                self.add(m.lastgroup, at, m.end())
            at = m.end()
        return at

    def braced(self, at: int) -> int:
        """Code in braces within a template or an element, braces included."""
        self.add("p", at, at + 1, "{")
        at = self.code(at + 1, "}")
        self.add("p", at, at + 1, "}")
        return at + 1

    def template(self, at: int) -> int:
        self.add("p", at, at + 1, "`<")
        at += 1
        while at < len(self.source) and self.source[at] != "`":
            if self.source.startswith("${", at):
                at = self.braced(at + 1)
            else:
                at += 2 if self.source[at] == "\\" else 1
        self.add("p", at, at + 1, ">`")
        return at + 1

    def element(self, at: int) -> int:
        """A JSX element: of its text only the code in braces gives tokens."""
        begin, depth = at, 0
        self.add("p", at, at + 1, "`<")
        while at < len(self.source):
            if self.source.startswith("<!--", at):
                at += 4
            elif self.source[at] == "<":
                closing = self.source.startswith("</", at)
                at, alone = self.tag(at + 1)
                depth += -1 if closing else 0 if alone else 1
                if depth <= 0:
                    break
            elif self.source[at] == "{":
                at = self.braced(at)
            else:
                at += 1
        else:
            raise ValueError(f"element at {begin} has no end")
        self.add("p", at - 1, at, ">`")
        return at

    def tag(self, at: int) -> tuple[int, bool]:
        while at < len(self.source):
            c = self.source[at]
            if c == "{":
                at = self.braced(at)
            elif c in "\"'":
                end = self.source.find(c, at + 1)
                at = len(self.source) if end < 0 else end + 1
            elif c == ">":
                return at + 1, self.source[at - 1] == "/"
            else:
                at += 1
        return at, True


def tokens(source: str, jsx: bool = True) -> list[Token]:
    """Tokens with paired brackets; ValueError where brackets don't pair."""
    lexer = _Lexer(source, jsx)
    if lexer.open:
        raise ValueError(f"open bracket in line {lexer.out[lexer.open[-1]].line}")
    return lexer.out


def module_of(path: str, ref: str) -> str | None:
    """Name of the module or file that a relative or rooted specifier means; None for packages and addresses."""
    ref = ref.strip().split("?")[0].split("#")[0]
    if not ref.startswith((".", "/")) or ref.startswith("//"):
        return None
    place = posixpath.normpath(ref.lstrip("/") if ref.startswith("/") else posixpath.join(posixpath.dirname(path), ref))
    if place in (".", "..") or place.startswith("../"):
        return None
    root, ext = posixpath.splitext(place)
    if ext and ext.lower() not in CODE:
        return place
    parts = root.split("/")
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] in ("index", "__init__") else parts)


class ScriptFile:
    """Fills ``out`` (node, edge and bind) from one file."""

    def __init__(self, path: str, qname: str, source: str, out):
        self.path, self.qname, self.source, self.out = path, qname, source, out
        self.typed = path.lower().endswith((".ts", ".tsx"))
        self.t = tokens(source, not path.lower().endswith(".ts"))
        self.walk(0, len(self.t), qname, True)

    # Reading tokens

    def at(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind in ("p", "id")

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id"

    def after(self, i: int) -> int:
        return (self.t[i].mate if self.t[i].mate > i else i) + 1

    def line_text(self, i: int, j: int) -> str:
        return " ".join(self.source[self.t[i].start : self.t[j - 1].end].split()) if j > i else ""

    def last_line(self, j: int) -> int:
        token = self.t[j - 1]
        return token.line + self.source.count("\n", token.start, token.end)

    def fresh(self, i: int) -> bool:
        """Whether a statement may begin at i."""
        if i == 0 or self.at(i - 1, ";", "{", "}"):
            return True
        last = self.t[i - 1]
        return self.t[i].line > last.line and (last.kind in ("str", "num", "re") or last.text in (")", "]", ">`", "++", "--") or (last.kind == "id" and last.text not in _BEFORE_VALUE) or (self.typed and last.text in (">", "void")))

    def past_angles(self, i: int) -> int:
        """Behind type parameters that begin at i, if any do."""
        if not self.at(i, "<"):
            return i
        depth = 0
        while i < len(self.t):
            depth += self.at(i, "<") - self.at(i, ">")
            i = self.after(i)
            if depth == 0:
                break
        return i

    def past_type(self, i: int, *ends: str) -> int:
        """At the first of ``ends`` outside brackets, from a type annotation on; braces belong to the type only
        where a type may begin."""
        first = i
        while i < len(self.t) and self.t[i].text not in _CLOSE:
            if i > first and self.is_name(i) and self.t[i].line > self.last_line(i) and (self.fresh(i) or self.at(i - 1, ">")):
                break
            if self.at(i, *ends) and not (self.at(i, "{") and self.at(i - 1, ":", "|", "&", "=>")):
                return i
            if self.at(i, ";"):
                break
            i = self.past_angles(i) if self.at(i, "<") else self.after(i)
        return i

    def function_at(self, i: int) -> tuple[int, int, int, int, int] | None:
        """A function value at i: (parameters from, to, body from, to, end); a body in braces stands without them.
        Without brackets around its parameter, or for other values: from = to, or None."""
        i += self.at(i, "async") and not self.at(i + 1, "=>")
        if self.at(i, "function"):
            i += 1 + self.at(i + 1, "*")
            i = self.past_angles(i + self.is_name(i))
            if not self.at(i, "("):
                return None
            a, b = i, self.after(i)
            body = self.past_type(b + 1, "{") if self.at(b, ":") else b
            return (a, b, body + 1, self.t[body].mate, self.after(body)) if self.at(body, "{") else None
        i = self.past_angles(i)
        if self.is_name(i) and self.at(i + 1, "=>"):
            a = b = arrow = i + 1
        elif self.at(i, "("):
            a, b = i, self.after(i)
            arrow = self.past_type(b + 1, "=>", ",", "=", "?") if self.typed and self.at(b, ":") else b
            if not self.at(arrow, "=>"):
                return None
        else:
            return None
        if self.at(arrow + 1, "{"):
            return a, b, arrow + 2, self.t[arrow + 1].mate, self.after(arrow + 1)
        return a, b, arrow + 1, -1, -1

    def value_end(self, i: int, end: int) -> int:
        first = i
        if found := self.function_at(i):
            i = found[4] if found[4] >= 0 else found[2]
        while i < end and not self.at(i, ",", ";"):
            new_line = i > first and self.t[i].line > self.last_line(i)
            if new_line and self.t[i].kind != "p" and self.t[i].text not in _CONTINUES and self.fresh_value_end(i):
                break
            i = (self.typed and self.type_arguments(i)) or self.after(i)
        return min(i, end)

    def type_arguments(self, i: int) -> int | None:
        """Behind the type arguments of a call that begin at i; None where < compares."""
        if not (self.at(i, "<") and self.is_name(i - 1)):
            return None
        j = self.past_angles(i)
        return j if self.at(j, "(") and all(t.kind in ("id", "str") or t.text in "<>,.[]{}:;|&" for t in self.t[i:j]) else None

    def fresh_value_end(self, i: int) -> bool:
        return self.fresh(i) or self.at(i - 1, "}")

    # Rows

    def depend(self, local: str, specifier: str, symbol: str | None = None) -> None:
        module = module_of(self.path, specifier)
        if module is None:
            self.out.bind(local, specifier, "external")
            self.out.edge("IMPORTS", self.qname, specifier)
        else:
            target = module if symbol is None else f"{module}.{symbol}"
            self.out.bind(local, target, "module" if symbol is None else "symbol")
            self.out.edge("IMPORTS", self.qname, target, local)

    def named(self, kind: str, name: str, owner: str, start: int, end: int, signature: str) -> str:
        qname = f"{owner}.{name}" if owner else name
        self.out.node(kind, name, qname, self.t[start].line, self.last_line(end), signature)
        self.out.edge("CONTAINS", owner, qname)
        return qname

    def function(self, found: tuple, kind: str, name: str, owner: str, start: int, end: int, prefix: str) -> None:
        a, b, body, close, _ = found
        qname = self.named(kind, name, owner, start, end, f"{prefix}{name}{self.line_text(a, b) or '()'}")
        self.walk(body, end if close < 0 else close, qname, close >= 0)

    # Walks

    def walk(self, i: int, end: int, owner: str, direct: bool) -> None:
        """Tokens i to end; ``direct``: they are a module's or a function's body, so definitions count."""
        while i < end:
            if direct and self.is_name(i) and not self.at(i - 1, ".", "?.") and (j := self.definition(i, end, owner)):
                i = j
                continue
            word = self.is_name(i) and not self.at(i - 1, ".", "?.") and not self.at(i + 1, ":")
            if word and self.at(i, "class") and not self.at(i + 1, "=", ",", ")"):
                declared = self.fresh(i) and self.is_name(i + 1)
                body = self.class_body(i + 1)
                if declared:
                    self.walk(body + 1, self.t[body].mate, owner, False)
                i = self.after(body)
                continue
            if word and self.at(i, "function") and (found := self.function_at(i)):
                self.walk(found[2], found[3], owner, not (self.fresh(i) and not self.at(i + 1, "(")))
                i = found[4]
                continue
            if self.at(i, "=>") and self.at(i + 1, "{"):
                self.walk(i + 2, self.t[i + 1].mate, owner, True)
                i = self.after(i + 1)
                continue
            if self.at(i, "("):
                found = self.function_at(i)
                if found:
                    i = found[1]
                    if found[3] >= 0:
                        self.walk(found[2], found[3], owner, True)
                        i = found[4]
                    continue
                self.call(i, owner)
            if self.t[i].mate > i:
                self.walk(i + 1, self.t[i].mate, owner, False)
            i = self.after(i)

    def call(self, paren: int, owner: str) -> None:
        """The call, if any, whose arguments begin at this bracket."""
        last = paren - 1
        if self.at(last, "?."):
            last -= 1
        if self.typed and self.at(last, ">"):
            depth, j = 0, last
            while j >= 0 and (self.t[j].kind in ("id", "str") or self.t[j].text in "<>,.[]|&"):
                depth += self.at(j, ">") - self.at(j, "<")
                j -= 1
                if depth == 0:
                    break
            if depth == 0:
                last = j
        if self.at(last, "import") and not self.at(last - 1, "."):
            if paren + 1 < len(self.t) and self.t[paren + 1].kind == "str":
                spec = self.t[paren + 1].text[1:-1]
                self.depend(spec, spec)
            return
        if not self.is_name(last):
            return
        first, called = last, False
        while self.at(first - 1, ".", "?."):
            j = first - 2
            j -= self.at(j, "!")
            while j >= 0 and self.t[j].kind == "p" and 0 <= self.t[j].mate < j:
                called |= self.at(j, ")")
                j = self.t[j].mate
                # What stands before a bracket belongs to it where it can be called or indexed.
                if not (self.at(j, "(", "[", "`<") and j > 0 and (self.at(j - 1, ")", "]") or (self.is_name(j - 1) and self.t[j - 1].text not in _NOT_CALLED - {"super", "import"}))):
                    break
                j -= 1
            if j < 0:
                break
            first = j
        lone = first == last
        if lone and (self.t[last].text in _NOT_CALLED or self.at(last - 1, "function")):
            return
        if self.at(first - 1, "new"):
            if not called:
                return
            first -= 1
        behind = self.after(paren)
        if lone and (self.at(behind, "{") and self.at(first - 1, "{", ",", "}", ";", "async", "get", "set", "static", "*")):
            return  # a method of an object or class
        self.out.edge("CALLS", owner, self.line_text(first, last + 1))

    def definition(self, i: int, end: int, owner: str) -> int | None:
        """Behind a definition or import at i; None where there is none."""
        word = self.t[i].text
        if word == "import" and self.fresh(i) and not self.at(i + 1, "(", "."):
            return self.imported(i, end)
        if word == "export" and self.fresh(i):
            return self.exported(i, end, owner)
        if word in ("const", "let", "var") and not self.at(i + 1, ":", "=", ",", ")"):
            if self.at(i + 1, "enum"):
                return None
            return self.variables(i + 1, end, owner)
        start = i
        if not (self.fresh(i) or self.at(i - 1, "export", "default", "declare")):
            return None
        if word in ("abstract", "declare") and self.is_name(i + 1) and self.t[i].line == self.t[i + 1].line:
            i += 1
            if self.at(i, "const", "let", "var", "interface", "function"):
                return self.definition(i, end, owner)
        if word == "async" and self.at(i + 1, "function"):
            i += 1
        if self.at(i, "function") and self.is_name(i + 1 + self.at(i + 1, "*")):
            found = self.function_at(i)
            if not found:
                return None
            self.function(found, "Function", self.t[i + 1 + self.at(i + 1, "*")].text, owner, start, found[4], "function ")
            return found[4]
        if self.at(i, "class", "interface") and self.is_name(i + 1) and not self.at(i + 1, "extends", "implements"):
            return self.class_like(i, start, self.t[i + 1].text, owner)
        return None

    def imported(self, i: int, end: int) -> int:
        j = i + 1
        while j < end and self.t[j].kind != "str" and not self.at(j, ";"):
            j = self.after(j)
        if j >= end or self.t[j].kind != "str":
            return j
        specifier, saw = self.t[j].text[1:-1], False
        k = i + 1 + (self.at(i + 1, "type", "typeof") and not self.at(i + 2, ",", "from"))
        while k < j and specifier:
            if self.at(k, "*") and self.at(k + 1, "as"):
                self.depend(self.t[k + 2].text, specifier)
                saw, k = True, k + 3
            elif self.at(k, "{"):
                m, close = k + 1, self.t[k].mate
                while m < close:
                    stop = m
                    while stop < close and not self.at(stop, ","):
                        stop += 1
                    part = [x.text for x in self.t[m:stop]]
                    if len(part) in (2, 4) and part[0] in ("type", "typeof"):
                        part = part[1:]
                    if part:
                        self.depend(part[-1], specifier, part[0])
                        saw = True
                    m = stop + 1
                k = close + 1
            else:
                if self.is_name(k) and not (self.at(k, "from") and k == j - 1):
                    self.depend(self.t[k].text, specifier)
                    saw = True
                k += 1
        if specifier and not saw:
            self.depend(specifier, specifier)
        return j + 1

    def exported(self, i: int, end: int, owner: str) -> int:
        j = i + 1
        j += self.at(j, "type") and self.at(j + 1, "{", "*")
        if self.at(j, "*", "{"):
            j = self.after(j) if self.at(j, "{") else j + 1 + 2 * self.at(j + 1, "as")
            if self.at(j, "from") and j + 1 < end and self.t[j + 1].kind == "str":
                spec = self.t[j + 1].text[1:-1]
                if spec:
                    self.depend(spec, spec)
                return j + 2
            return j
        if not self.at(j, "default"):
            return (self.definition(j, end, owner) if self.is_name(j) and j < end else None) or j
        j += 1
        if self.is_name(j) and j < end and not self.at(j, "const", "let", "var") and (done := self.definition(j, end, owner)):
            return done
        found = self.function_at(j)
        if not found:
            return j
        stop = found[4] if found[4] >= 0 else self.value_end(found[2], end)
        self.function(found, "Function", "default", owner, j, stop, "export default ")
        return stop

    def variables(self, i: int, end: int, owner: str) -> int:
        while i < end:
            name = self.t[i].text if self.is_name(i) else None
            j = self.after(i)
            j += self.at(j, "!")
            if self.at(j, ":"):
                j = self.past_type(j + 1, "=", ",")
            if not self.at(j, "="):
                if not self.at(j, ","):
                    return j
                i = j + 1
                continue
            value, stop = j + 1, self.value_end(j + 1, end)
            found = self.function_at(value) if name else None
            if found and found[4] in (-1, stop):
                self.function(found, "Function", name, owner, i, stop, "const ")
            elif name and self.at(value, "class") and self.after(self.class_body(value + 1)) == stop:
                self.class_like(value, i, name, owner)
            elif name and self.at(value, "require") and self.at(value + 1, "(") and self.after(value + 1) == stop:
                if self.t[value + 2].kind == "str" and len(self.t[value + 2].text) > 2:
                    self.depend(name, self.t[value + 2].text[1:-1])
            else:
                self.walk(value, stop, owner, False)
            if not self.at(stop, ","):
                return stop
            i = stop + 1
        return i

    def class_body(self, i: int) -> int:
        """The opening brace of a class or interface whose head begins at i."""
        while i < len(self.t) and not self.at(i, "{"):
            i = self.past_angles(i) if self.at(i, "<") else self.after(i)
        if i >= len(self.t):
            raise ValueError("class without a body")
        return i

    def class_like(self, i: int, start: int, name: str, owner: str) -> int:
        body = self.class_body(i + 1)
        face = self.at(i, "interface")
        qname = self.named("Interface" if face else "Class", name, owner, start, self.after(body), f"{'interface' if face else 'class'} {name}")
        clause, j = None, i + 1
        while j < body:
            if self.at(j, "extends", "implements"):
                clause = "IMPLEMENTS" if self.at(j, "implements") else "INHERITS"
            elif clause and self.is_name(j):
                k = j + 1
                while self.at(k, ".") and self.is_name(k + 1):
                    k += 2
                if self.at(k, ",", "{", "<", "extends", "implements"):
                    self.out.edge(clause, qname, self.line_text(j, k))
                j = k
                continue
            j = self.past_angles(j) if self.at(j, "<") else self.after(j)
        if not face:
            self.members(body + 1, self.t[body].mate, qname)
        return self.after(body)

    def members(self, i: int, end: int, owner: str) -> None:
        while i < end:
            while self.at(i, "@"):
                i += 2
                while self.at(i, ".", "("):
                    i = self.after(i) if self.at(i, "(") else i + 2
            start = i
            while i < end and (self.at(i, "*") or (self.t[i].text in _MODIFIERS and not self.at(i + 1, "(", "=", ":", ";", "?", "}", "<", "!"))):
                i += 1
            if i >= end:
                return
            if self.at(i, "{", ";", ","):
                i = self.after(i)
                continue
            name, j = self.line_text(i, self.after(i)), self.after(i)
            j += self.at(j, "?", "!")
            j = self.past_angles(j)
            if self.at(j, "("):
                a, b = j, self.after(j)
                body = self.past_type(b + 1, "{") if self.at(b, ":") else b
                if body < end and self.at(body, "{"):
                    self.function((a, b, body + 1, self.t[body].mate, 0), "Method", name, owner, start, self.after(body), "")
                    i = self.after(body)
                else:
                    i = max(self.value_end(b, end), b)
                continue
            if self.at(j, ":"):
                j = self.past_type(j + 1, "=")
            if self.at(j, "=") and j < end:
                stop = self.value_end(j + 1, end)
                found = self.function_at(j + 1)
                if not (found and found[4] in (-1, stop)) and not self.at(j + 1, "class"):
                    self.walk(j + 1, stop, owner, False)
                i = max(stop, j + 1)
            else:
                i = max(j, i + 1)
