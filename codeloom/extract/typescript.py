"""TypeScript and JavaScript files, by a lexer and one walk over bracketed ranges of its tokens."""

from __future__ import annotations

import bisect
import re

from ..functions.parsers import comment_text, split_top, strip_parentheses, type_names
from .rows import VARIABLES, Extracted

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|\$\{[^}]*\}|[^`\\])*`)
    |(?P<number>\d[\w.]*)|(?P<name>[#A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<mark>=>|\?\.(?!\d)|\?\?|\.\.\.|[=!]==?|&&|\|\||.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n])+/[a-z]*")
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "override", "abstract", "declare", "accessor", "get", "set", "export", "default"}
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "await", "in", "of", "with", "void", "delete", "import", "super", "constructor", "instanceof", "yield", "case", "throw", "new", "else", "do"}
#: What a line goes on after, and what it goes on with.
_OPENS = {".", "?.", "=", "=>", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", ",", "(", "[", "{", "<", "|", "&", "==", "===", "!=", "!==", "as", "satisfies", "extends", "in", "of", "instanceof", "keyof", "typeof", "await", "new", "return"}
_JOINS = {".", "?.", "=", "=>", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", ",", "(", "<", "|", "&", "==", "===", "!=", "!==", ">", "as", "satisfies", "extends", "in", "of", "instanceof"}


class _Walk:
    def __init__(self, out: Extracted, text: str):
        self.out, self.text = out, text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.toks: list[tuple[str, str, int]] = []  # kind, text, offset
        self.comments: list[tuple[int, int]] = []
        self._lex()
        self.match = self._brackets()
        self.explicit = self._clauses()

    def _lex(self) -> None:
        at, text = 0, self.text
        while at < len(text):
            m = _TOKEN.match(text, at)
            kind = m.lastgroup
            if kind == "mark" and m[0] == "/" and (not self.toks or self.toks[-1][1] in _OPENS or self.toks[-1][1] in ";}!"):
                m2 = _REGEX.match(text, at)
                if m2:
                    m, kind = m2, "string"
            if kind == "comment":
                self.comments.append((at, m.end()))
            elif kind != "space":
                self.toks.append((kind, m[0], at))
            at = m.end()

    def _brackets(self) -> dict[int, int]:
        pairs, stack = {}, []
        for i, (kind, t, _) in enumerate(self.toks):
            if kind != "mark":
                continue
            if t in "([{":
                stack.append(i)
            elif t in ")]}" and stack:
                pairs[stack.pop()] = i
        for i in stack:
            pairs[i] = len(self.toks)
        return pairs | {b: a for a, b in pairs.items()}

    def _clauses(self) -> set[str]:
        """Names in export clauses without a module."""
        found: set[str] = set()
        for i in range(len(self.toks) - 1):
            if self.t(i) == "export" and self.t(i + 1) == "{" and self.t(self.match[i + 1] + 1) != "from":
                found |= {n.split(" as ")[0].strip() for n in self.src(i + 2, self.match[i + 1]).split(",") if n.strip()}
        return found

    # Tokens and places.
    def t(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def off(self, i: int) -> int:
        return self.toks[i][2] if i < len(self.toks) else len(self.text)

    def stop(self, i: int) -> int:
        return self.off(i) + len(self.t(i))

    def src(self, lo: int, hi: int) -> str:
        return self.text[self.off(lo) : self.stop(hi - 1)] if hi > lo else ""

    def pos(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]

    def row(self, i: int) -> int:
        return self.pos(self.off(i))[0]

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i][0] == "name"

    def end_of(self, i: int, hi: int, stops: str = ";") -> int:
        """The token after an expression or type that begins at i."""
        start = i
        while i < hi:
            t = self.t(i)
            if t in stops and self.toks[i][0] == "mark":
                return i
            if i > start and self.row(i) > self.pos(self.stop(i - 1))[0] and self.t(i - 1) not in _OPENS and t not in _JOINS:
                return i
            i = self.match.get(i, i) + 1 if t in ("(", "[", "{") and self.toks[i][0] == "mark" else i + 1
        return hi

    def find(self, i: int, hi: int, mark: str) -> int:
        """The next `mark` outside of other brackets, or hi."""
        while i < hi:
            if self.t(i) == mark and self.toks[i][0] == "mark":
                return i
            i = self.match.get(i, i) + 1 if self.t(i) in ("(", "[", "{") and self.toks[i][0] == "mark" else i + 1
        return hi

    def docstring(self, lo: int, hi: int) -> str | None:
        """Comments right before a statement, or after it on its last line."""
        start, stop = self.off(lo), self.stop(hi - 1)
        before = self.stop(lo - 1) if lo else 0
        near = self.comments[bisect.bisect_left(self.comments, (before, 0)) : bisect.bisect_left(self.comments, (start, 0))]
        own = [self.text[a:b] for a, b in near if lo == 0 or self.pos(a)[0] > self.pos(before)[0]]
        if not own:
            rest = self.text[stop:].split("\n", 1)[0]
            own = [self.text[a:b] for a, b in self.comments[bisect.bisect_left(self.comments, (stop, 0)) :][:8] if a < stop + len(rest)]
        return comment_text("\n".join(own)) if own else None

    def define(self, name: str, kind: str, lo: int, hi: int, owner: dict, exported: bool = False, decorator: str | None = None, head: int | None = None, **more) -> dict:
        hi = min(max(hi, lo + 1), len(self.toks))
        text = self.src(lo, hi)
        signature = self.src(lo, head) if head is not None and head > lo else text.split("\n", 1)[0]
        more.setdefault("docstring", self.docstring(lo, hi))
        return self.out.symbol(name, kind, self.pos(self.off(lo)), self.pos(self.stop(hi - 1)), text, owner, signature.strip()[:400], exported or name in self.explicit, decorator=decorator, **more)

    @staticmethod
    def caller(owners: list[dict]) -> dict:
        return next(o for o in reversed(owners) if o["kind"] not in VARIABLES)

    # Code.
    def code(self, lo: int, hi: int, owners: list[dict]) -> None:
        i, decorator, exported, start = lo, None, False, lo
        while i < hi:
            t, name = self.t(i), self.t(i + 1)
            statement = i == lo or self.t(i - 1) in (";", "{", "}", "export", "default", "declare", "abstract", "async", ")") or self.row(i) > self.row(i - 1)
            if not exported and decorator is None:
                start = i
            if t == "@" and self.is_name(i + 1):
                decorator, i = self.decorator(i, hi, owners)
                continue
            if statement and t == "export":
                j = self.export(i, hi)
                if j:
                    i, decorator = j, None
                    continue
                exported, start, i = True, i, i + 1
                continue
            if statement and t in ("default", "declare", "abstract", "async") and (exported or self.is_name(i + 1)) and name != "=>":
                i += 1
                continue
            if statement and t == "import" and name not in ("(", "."):
                i = self.imported(i, hi)
                continue
            if t == "class" and (self.is_name(i + 1) or name == "{"):
                i = self.klass(i, hi, owners, exported, decorator, start)
            elif t == "function":
                i = self.function(i, hi, owners, exported, start)
            elif statement and t == "interface" and self.is_name(i + 1):
                open_ = self.find(i, hi, "{")
                self.define(name, "interface", start, self.match.get(open_, hi) + 1, owners[-1], exported, head=open_, inheritence=self.heritage(i + 2, open_))
                i = self.match.get(open_, hi) + 1
            elif statement and t == "type" and self.is_name(i + 1) and self.t(i + 2) in ("=", "<"):
                end = self.end_of(i + 3, hi)
                self.define(name, "type", start, end, owners[-1], exported, inheritence=self.combined(self.find(i + 2, end, "=") + 1, end))
                i = end
            elif statement and t in ("enum", "namespace", "module") and self.is_name(i + 1):
                open_ = self.find(i, hi, "{")
                close = self.match.get(open_, hi)
                symbol = self.define(name, "enum" if t == "enum" else "namespace", start, close + 1, owners[-1], exported, head=open_)
                if t != "enum":
                    self.code(open_ + 1, close, [*owners, symbol])
                i = close + 1
            elif t in ("const", "let", "var") and (self.is_name(i + 1) or name in ("{", "[")) and name != "enum":
                i = self.variables(i, hi, owners, exported, start)
            elif statement and t == "const" and name == "enum":
                i += 1
                continue
            elif t == "throw":
                made = self.t(i + 2) if name == "new" else "Error"
                self.out.raised(self.caller(owners), self.pos(self.off(i)), made or "Error")
                i += 1
            else:
                self.expression(i, owners)
                i += 1
            decorator, exported = None, False

    def expression(self, i: int, owners: list[dict]) -> None:
        """What token i alone tells: a call, or a read of the environment."""
        t = self.t(i)
        if t == "env" and self.t(i - 1) == "." and self.t(i - 2) == "process":
            if self.t(i + 1) in (".", "?.") and self.is_name(i + 2):
                self.out.env(self.caller(owners), self.t(i + 2), self.pos(self.off(i + 2)))
            elif self.t(i + 1) == "[" and self.toks[i + 2][0] == "string":
                self.out.env(self.caller(owners), self.t(i + 2), self.pos(self.off(i + 2)))
            return
        if not self.is_name(i):
            return
        j = i + 1
        if self.t(j) == "<":  # type arguments, if a call follows them
            k = j
            while k < len(self.toks) and k < j + 40 and self.t(k) not in (";", "{", ")"):
                if self.t(k) == ">" and self.t(k + 1) == "(":
                    j = k + 1
                    break
                k += 1
        if self.t(j) == "?." and self.t(j + 1) == "(":
            j += 1
        before = self.t(i - 1)
        if self.t(j) != "(" or (t in _NOT_CALLED and before not in (".", "?.")) or before == "function":
            if before == "new" and self.is_name(i) and self.t(j) != ".":
                self._call(i, i, "constructor_call", owners, i)
            return
        close = self.match.get(j, j)
        if before == "new":
            self._call(i, close, "constructor_call", owners, i)
        elif before in (".", "?."):
            self._call(i, close, "method_call", owners, self.chain(i))
        elif self.t(close + 1) != "{" or self.row(i) == self.row(close):
            self._call(i, close, "function_call", owners, i)

    def chain(self, i: int) -> int:
        """The first token of the member chain that ends with name i."""
        while self.t(i - 1) in (".", "?."):
            i -= 2
            while self.t(i) in (")", "]", "!"):
                if self.t(i) == "!":
                    i -= 1
                    continue
                i = self.match.get(i, i) - 1
                if not (self.is_name(i) or self.t(i) in (")", "]")):
                    return i + 1
                if self.t(i) in _NOT_CALLED and self.t(i) != "super" and self.t(i - 1) not in (".", "?."):
                    return i + 1
        return i - 1 if self.t(i - 1) == "new" else i

    def _call(self, i: int, close: int, kind: str, owners: list[dict], first: int) -> None:
        expression = self.src(first, i + 1).strip()
        base = prop = None
        if kind == "method_call":
            parts = re.split(r"[?!]?\.", re.sub(r"\n\s+", "", expression))
            prop = parts[-1].strip()
            base = ".".join(p.strip() for p in parts[:-1])
            base = strip_parentheses(re.sub(r"\s*(\?\?|\|\|)\s*[^()]*$", "", re.sub(r"\s+as\s+[\w$.<>\[\]]+", "", base)))
        lo = first
        while lo > 0 and self.t(lo - 1) not in (";", "{", "}") and self.row(lo - 1) == self.row(lo):
            lo -= 1
        doc = self.docstring(lo, min(close + 1, len(self.toks)))
        self.out.call(self.caller(owners), kind, self.t(i), expression, self.src(first, close + 1), self.pos(self.off(i)), self.pos(self.stop(i)), base, prop, doc)

    def decorator(self, i: int, hi: int, owners: list[dict]) -> tuple[str, int]:
        j = i + 2
        while self.t(j) == ".":
            j += 2
        text = self.src(i + 1, j)
        if self.t(j) == "(":
            close = self.match.get(j, j)
            self._call(j - 1, close, "decorator_call", owners, i + 1)
            self.code(j + 1, close, owners)
            text, j = self.src(i + 1, close + 1), close + 1
        return text, j

    def heritage(self, lo: int, hi: int) -> list[dict] | None:
        text, out = self.src(lo, hi), []
        for word, names in re.findall(r"\b(extends|implements)\s+(.*?)(?=\bimplements\b|\bextends\b|$)", text, re.S):
            out += [{"inherits_from_name": n, "inherits_from_id": None, "inherits_from_imports_id": None, "inheritence_type": word} for n in type_names(names)]
        return out or None

    def combined(self, lo: int, hi: int) -> list[dict] | None:
        """What a type is put together from by `&`, or `|`, or a generic of one other type."""
        text = self.src(lo, hi).strip().lstrip("|&")
        for mark, kind in (("&", "intersection"), ("|", "union")):
            parts = split_top(text, mark)
            if len(parts) > 1:
                names = [n for p in parts for n in type_names(p)]
                return [{"inherits_from_name": n, "inherits_from_id": None, "inherits_from_imports_id": None, "inheritence_type": kind} for n in names] or None
        inner = re.fullmatch(r"(?:Partial|Required|Readonly|Pick|Omit|Record|NonNullable|Extract|Exclude)<(.*)>", text, re.S)
        names = type_names(split_top(inner[1])[0]) if inner else []
        return [{"inherits_from_name": n, "inherits_from_id": None, "inherits_from_imports_id": None, "inheritence_type": "extends"} for n in names] or None

    def klass(self, i: int, hi: int, owners, exported, decorator, start) -> int:
        named = self.is_name(i + 1) and self.t(i + 1) not in ("extends", "implements")
        open_ = self.find(i, hi, "{")
        close = self.match.get(open_, hi)
        symbol = self.define(self.t(i + 1) if named else "default", "class", start, close + 1, owners[-1], exported, decorator, open_, inheritence=self.heritage(i + 1, open_))
        self.members(open_ + 1, close, [*owners, symbol])
        return close + 1

    def members(self, lo: int, hi: int, owners: list[dict]) -> None:
        i, owner = lo, owners[-1]
        while i < hi:
            if self.t(i) == ";":
                i += 1
                continue
            start, decorator = i, None
            while self.t(i) == "@":
                decorator, i = self.decorator(i, hi, owners)
            while self.t(i) in _MODIFIERS and self.t(i + 1) not in ("(", "=", ":", ";", "?", "!", "<"):
                i += 1
            if self.t(i) == "*":
                i += 1
            if self.t(i) == "{":  # a static block
                self.code(i + 1, self.match.get(i, hi), owners)
                i = self.match.get(i, hi) + 1
                continue
            name_at = i
            name = self.src(i, self.match[i] + 1) if self.t(i) == "[" else self.t(i)
            j = self.match[i] + 1 if self.t(i) == "[" else i + 1
            if self.t(j) in ("?", "!"):
                j += 1
            params = self.find(j, hi, "(") if self.t(j) == "<" else j
            if self.t(params) == "(":
                after = self.match.get(params, hi) + 1
                body = after
                if self.t(body) == ":":
                    body = self._body(body + 1, hi)
                if self.t(body) == "{":
                    close = self.match.get(body, hi)
                    symbol = self.define(name, "method", start, close + 1, owner, False, decorator, body, **self.types(params, body))
                    self.parameters(params, owners, name == "constructor")
                    self.code(params + 1, self.match.get(params, hi), [*owners, symbol])
                    self.code(body + 1, close, [*owners, symbol])
                    i = close + 1
                else:
                    end = self.end_of(after, hi)
                    self.define(name, "method", start, end, owner, False, decorator, end, **self.types(params, end))
                    i = end
            else:
                end = self.end_of(j, hi) if j < hi else hi
                symbol = self.define(name, "property", start, end, owner, False, decorator)
                self.code(self.find(name_at, end, "=") + 1, end, [*owners, symbol])
                i = max(end, i + 1)

    def _body(self, i: int, hi: int) -> int:
        """The brace that opens a body after a return type that begins at i."""
        first = True
        while i < hi:
            if self.t(i) == "{" and not first and self.t(i - 1) not in ("|", "&", ":", "=>", "<", ","):
                return i
            if self.t(i) == ";" or (self.row(i) > self.row(i - 1) and self.t(i - 1) not in _OPENS and self.t(i) not in _JOINS):
                return i
            i = self.match.get(i, i) + 1 if self.t(i) in ("(", "[", "{") else i + 1
            first = False
        return hi

    def types(self, params: int, body: int) -> dict:
        import json

        close, rows = self.match.get(params, params), []
        for part in split_top(self.src(params + 1, close)):
            m = re.match(r"\s*(?:(?:public|private|protected|readonly|override)\s+)*(\.\.\.)?([\w$]+|\{.*?\}|\[.*?\])(\?)?\s*(?::\s*(.*?))?\s*(=(?!>).*)?$", part, re.S)
            if m and m[2] != "this":
                rows.append({"name": m[2], "type": m[4] or None, "optional": bool(m[3] or m[5])})
        returns = self.src(close + 2, body).strip() if self.t(close + 1) == ":" else None
        return {"parameters_json": json.dumps(rows), "return_type": returns or None}

    def parameters(self, params: int, owners: list[dict], constructor: bool) -> None:
        """Constructor parameters with a modifier are properties of the class."""
        if not constructor:
            return
        i, close = params + 1, self.match.get(params, params)
        while i < close:
            end = self.find(i, close, ",")
            if self.t(i) in ("public", "private", "protected", "readonly"):
                j = i
                while self.t(j) in _MODIFIERS:
                    j += 1
                self.define(self.t(j), "property", i, end, owners[-1])
            i = end + 1

    def function(self, i: int, hi: int, owners, exported, start) -> int:
        j = i + 2 if self.t(i + 1) == "*" else i + 1
        if not self.is_name(j):
            return i + 1
        params = self.find(j + 1, hi, "(")
        after = self.match.get(params, hi) + 1
        body = self._body(after + 1, hi) if self.t(after) == ":" else after
        if self.t(body) != "{":
            self.define(self.t(j), "function", start, body, owners[-1], exported, head=body, **self.types(params, body))
            return body
        close = self.match.get(body, hi)
        symbol = self.define(self.t(j), "function", start, close + 1, owners[-1], exported, head=body, **self.types(params, body))
        self.code(params + 1, after - 1, [*owners, symbol])
        self.code(body + 1, close, [*owners, symbol])
        return close + 1

    def arrow(self, i: int, hi: int) -> int | None:
        """The arrow of a function that begins at i."""
        if self.t(i) == "async":
            i += 1
        if self.t(i) == "<":
            i = self.find(i, hi, "(")
        if self.is_name(i) and self.t(i + 1) == "=>":
            return i + 1
        if self.t(i) == "(":
            j = self.match.get(i, hi) + 1
            if self.t(j) == ":":
                while j < hi and self.t(j) not in ("=>", ";"):
                    j = self.match.get(j, j) + 1 if self.t(j) in ("(", "[", "{") else j + 1
            return j if self.t(j) == "=>" else None
        return None

    def variables(self, i: int, hi: int, owners, exported, start) -> int:
        word, i = self.t(i), i + 1
        while i < hi:
            end = self.end_of(i, hi, ";,")
            equals = self.find(i, end, "=")
            if self.is_name(i):
                arrow = self.arrow(equals + 1, end) if equals < end else None
                more = self.types(self.find(equals + 1, end, "("), arrow) if arrow and self.t(arrow - 1) != self.t(equals + 1) and self.find(equals + 1, arrow, "(") < arrow else {}
                symbol = self.define(self.t(i), "arrowFunction" if arrow else word, start if word in self.src(start, i) else i, end, owners[-1], exported, head=arrow, **more)
                self.code(equals + 1, end, [*owners, symbol])
            else:
                self.code(i, end, owners)
            if self.t(end) != ",":
                return end
            i = end + 1
        return hi

    def names(self, lo: int, hi: int) -> list[str]:
        return [re.sub(r"\s+", " ", n).strip() for n in self.src(lo, hi).split(",") if n.strip()] if hi > lo else []

    def imported(self, i: int, hi: int) -> int:
        j, types = i + 1, False
        if self.t(j) == "type" and self.t(j + 1) != "from" and self.t(j + 1) != ",":
            types, j = True, j + 1
        if j < hi and self.toks[j][0] == "string":
            self.out.imported(self.t(j)[1:-1], [], "side-effect")
            return j + 1
        names, kind = [], "default"
        while j < hi and self.t(j) != "from":
            if self.t(j) == "{":
                names += self.names(j + 1, self.match.get(j, hi))
                kind, j = "named" if kind == "default" and len(names) == len(self.names(j + 1, self.match.get(j, hi))) else kind, self.match.get(j, hi)
            elif self.t(j) == "*":
                names, kind, j = [*names, self.t(j + 2)], "namespace", j + 2
            elif self.is_name(j):
                names.append(self.t(j))
            elif self.t(j) == ";":
                return j + 1
            j += 1
        if j + 1 < hi and self.toks[j + 1][0] == "string":
            self.out.imported(self.t(j + 1)[1:-1], names, "type-only" if types else kind)
        return j + 2

    def export(self, i: int, hi: int) -> int | None:
        """Past an export clause or a re-export; None for an exported declaration."""
        j = i + 2 if self.t(i + 1) == "type" and self.t(i + 2) in ("{", "*") else i + 1
        if self.t(j) == "{":
            close = self.match.get(j, hi)
            if self.t(close + 1) == "from":
                self.out.imported(self.t(close + 2)[1:-1], self.names(j + 1, close), "type-only" if j > i + 1 else "named", "re-export")
                return close + 3
            return close + 1
        if self.t(j) == "*":
            names = []
            if self.t(j + 1) == "as":
                names, j = [self.t(j + 2)], j + 2
            self.out.imported(self.t(j + 2)[1:-1], names, "namespace", "export-all")
            return j + 3
        return None


def extract(text: str, path: str, language: str = "typescript") -> Extracted:
    """Rows of one TypeScript or JavaScript file; none where it is empty or can't be followed."""
    out = Extracted(path, language)
    if not text.strip():
        return out
    try:
        walk = _Walk(out, text)
        walk.code(0, len(walk.toks), [out.module(text)])
    except (IndexError, KeyError, RecursionError):
        return Extracted(path, language)
    return out
