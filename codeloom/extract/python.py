"""Python files, by the standard parser."""

from __future__ import annotations

import ast
import re

from ..functions.parsers import comment_text, strip_parentheses
from .rows import VARIABLES, Extracted

_DEFAULT = re.compile(r"\s+or\s+.*$", re.S)


class _Visitor(ast.NodeVisitor):
    def __init__(self, out: Extracted, text: str, tree: ast.Module):
        self.out, self.text, self.lines = out, text, text.split("\n")
        self.stack = [out.module(text)]
        self.top, self.in_class = True, 0
        self.explicit = _all_names(tree)
        self.classes = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
        self.type_only = False
        self.read: set[str] = set()
        self.stack[0]["docstring"] = ast.get_docstring(tree)
        self.comments = _comments(text)
        self.statement: ast.stmt | None = None

    def visit(self, node):
        if isinstance(node, ast.stmt):
            before, self.statement = self.statement, node
            super().visit(node)
            self.statement = before
        else:
            super().visit(node)

    def noted(self) -> str | None:
        """Comments on the lines right above the statement, and after it on its last line."""
        if self.statement is None:
            return None
        at, own = self.statement.lineno - 1, []
        while at in self.comments and self.lines[at - 1].lstrip().startswith("#"):
            own.insert(0, self.comments[at])
            at -= 1
        if self.statement.end_lineno in self.comments:
            own.append(self.comments[self.statement.end_lineno])
        return comment_text("\n".join(own)) if own else None

    # Places: rows from 0, columns in characters.
    def at(self, node) -> tuple[int, int]:
        return node.lineno - 1, self._column(node.lineno, node.col_offset)

    def end(self, node) -> tuple[int, int]:
        return node.end_lineno - 1, self._column(node.end_lineno, node.end_col_offset)

    def _column(self, line: int, offset: int) -> int:
        raw = self.lines[line - 1]
        return offset if raw.isascii() else len(raw.encode("utf-8", "surrogatepass")[:offset].decode("utf-8", "replace"))

    def source(self, node) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def owner(self) -> dict:
        return next(s for s in reversed(self.stack) if s["kind"] not in VARIABLES)

    def _exported(self, name: str) -> bool:
        return (self.top and not name.startswith("_")) or name in self.explicit

    def _define(self, node, kind: str, **more) -> None:
        text = self.source(node)
        signature = re.split(r":[ \t]*(?:#.*)?(?:\n|$)", text, maxsplit=1)[0]
        decorator = ", ".join(self.source(d) for d in node.decorator_list) or None
        name_at = (node.lineno - 1, self._column(node.lineno, node.col_offset) + (6 if kind == "class" else 4))
        symbol = self.out.symbol(node.name, kind, self.at(node), self.end(node), text, self.stack[-1], signature, self._exported(node.name), decorator=decorator, docstring=ast.get_docstring(node), name_at=name_at, **more)
        for d in node.decorator_list:
            self._decorator(d)
        self.stack.append(symbol)
        top, self.top = self.top, False
        for part in ast.iter_child_nodes(node):
            if part not in node.decorator_list:
                self.visit(part)
        self.top = top
        self.stack.pop()

    def visit_ClassDef(self, node) -> None:
        self.in_class += 1
        bases = [{"inherits_from_name": self.source(b), "inherits_from_id": None, "inherits_from_imports_id": None, "inheritence_type": "extends"} for b in node.bases]
        self._define(node, "class", inheritence=bases or None)
        self.in_class -= 1

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "method" if self.in_class else "function", return_type=self.source(node.returns) if node.returns else None, parameters_json=_parameters(self, node.args))

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node) -> None:
        for target in node.targets:
            self._assigned(node, target)
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        self._assigned(node, node.target)
        self.generic_visit(node)

    def _assigned(self, node, target) -> None:
        if isinstance(target, ast.Name):
            self.out.symbol(target.id, "var", self.at(node), self.end(node), self.source(node), self.stack[-1], self.source(node).split("\n", 1)[0], self._exported(target.id), name_at=self.at(target))
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
            holder = next((s for s in reversed(self.stack) if s["kind"] == "class"), None)
            if holder:
                self.out.symbol(target.attr, "property", self.at(node), self.end(node), self.source(node), holder, self.source(node).split("\n", 1)[0], name_at=self.at(target))

    def visit_If(self, node) -> None:
        test, negated = node.test, False
        if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            test, negated = test.operand, True
        checking = (isinstance(test, ast.Name) and test.id == "TYPE_CHECKING") or (isinstance(test, ast.Attribute) and test.attr == "TYPE_CHECKING")
        self.visit(node.test)
        for branch, chosen in ((node.body, not negated), (node.orelse, negated)):
            before = self.type_only
            self.type_only = before or (checking and chosen)
            top, self.top = self.top, False
            for part in branch:
                self.visit(part)
            self.top, self.type_only = top, before

    def visit_Import(self, node) -> None:
        for a in node.names:
            kind = "type-only" if self.type_only else "namespace" if a.asname else "default"
            self.out.imported(a.name, [f"{a.name} as {a.asname}" if a.asname else a.name], kind)

    def visit_ImportFrom(self, node) -> None:
        names = [f"{a.name} as {a.asname}" if a.asname else a.name for a in node.names]
        if node.module or names:
            self.out.imported("." * node.level + (node.module or ""), names, "type-only" if self.type_only else "named")

    def visit_Raise(self, node) -> None:
        made = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        self.out.raised(self.owner(), self.at(node), self.source(made) if made is not None else "Error")
        self.generic_visit(node)

    def _environ(self, node) -> bool:
        return (isinstance(node, ast.Name) and node.id == "environ") or (isinstance(node, ast.Attribute) and node.attr == "environ" and isinstance(node.value, ast.Name) and node.value.id == "os")

    def _read(self, key) -> None:
        """One variable for each symbol of a file at most."""
        owner = self.owner()
        if isinstance(key, ast.Constant) and isinstance(key.value, str) and owner["id"] not in self.read:
            self.read.add(owner["id"])
            self.out.env(owner, key.value, self.at(key))

    def visit_Subscript(self, node) -> None:
        if self._environ(node.value):
            self._read(node.slice)
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        f = node.func
        if isinstance(f, ast.Attribute) and node.args and ((f.attr == "getenv" and isinstance(f.value, ast.Name) and f.value.id == "os") or (f.attr == "get" and self._environ(f.value))):
            self._read(node.args[0])
        self._site(node, None)
        self.generic_visit(node)

    def _decorator(self, node) -> None:
        if isinstance(node, ast.Call):
            self._site(node, "decorator_call")
            for part in ast.iter_child_nodes(node):
                self.visit(part)

    def _site(self, node: ast.Call, kind: str | None) -> None:
        f, base, prop = node.func, None, None
        expression = self.source(f)
        if isinstance(f, ast.Name):
            name, kind = f.id, kind or ("constructor_call" if f.id in self.classes else "super_call" if f.id == "super" else "function_call")
        elif isinstance(f, ast.Attribute):
            name, prop = f.attr, f.attr
            base = strip_parentheses(_DEFAULT.sub("", self.source(f.value).strip("()") if isinstance(f.value, ast.BoolOp) else self.source(f.value)))
            kind = kind or "method_call"
        elif isinstance(f, ast.Subscript) or (isinstance(f, ast.Call) and isinstance(f.func, ast.Name) and f.func.id == "getattr"):
            key = f.slice if isinstance(f, ast.Subscript) else f.args[1] if len(f.args) > 1 else f
            name, kind = key.value if isinstance(key, ast.Constant) and isinstance(key.value, str) else self.source(key), kind or "dynamic_call"
        else:
            return
        self.out.call(self.owner(), kind, name, expression, self.source(node), self.at(f), self.end(f), base, prop, self.noted())


def _parameters(v: _Visitor, args: ast.arguments) -> str:
    import json

    plain = [*args.posonlyargs, *args.args]
    optional = len(plain) - len(args.defaults)
    rows = [(a, i >= optional) for i, a in enumerate(plain)] + [(a, d is not None) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    return json.dumps([{"name": a.arg, "type": v.source(a.annotation) if a.annotation else None, "optional": o} for a, o in rows if a.arg not in ("self", "cls")])


def _comments(text: str) -> dict[int, str]:
    """Comments by line, from 1."""
    import io
    import tokenize

    try:
        return {t.start[0]: t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT}
    except (tokenize.TokenError, SyntaxError):
        return {}


def _all_names(tree: ast.Module) -> set[str]:
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            return {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return set()


def extract(text: str, path: str) -> Extracted:
    """Rows of one Python file; none where it can't be parsed or is empty."""
    out = Extracted(path, "python")
    if not text.strip():
        return out
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    _Visitor(out, text, tree).visit(tree)
    return out
