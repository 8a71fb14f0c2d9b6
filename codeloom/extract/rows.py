"""What an extractor returns for one file, and the ids of its rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from ..schema import MODULE

VARIABLES = ("const", "let", "var")


def digest(*parts) -> str:
    return hashlib.sha256("".join(str(p) for p in parts).encode("utf-8", "surrogatepass")).hexdigest()


@dataclass
class Extracted:
    path: str
    language: str
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    call_sites: list[dict] = field(default_factory=list)
    exceptions: list[dict] = field(default_factory=list)
    env_vars: list[dict] = field(default_factory=list)

    def module(self, text: str) -> dict:
        """The synthetic symbol of a file that is not empty."""
        lines = text.split("\n")
        id_ = digest(MODULE, "module", self.path, 0, 0, self.path)
        return self._add(id_, MODULE, "module", (0, 0), (len(lines) - 1, len(lines[-1])), None, None, False)

    def symbol(self, name: str, kind: str, start: tuple[int, int], end: tuple[int, int], text: str, parent: dict | None, signature: str | None = None, exported: bool = False, **more) -> dict:
        at = more.pop("name_at", start)
        return self._add(digest(name, kind, self.path, *at, text), name, kind, start, end, parent, signature, exported, **more)

    def _add(self, id_, name, kind, start, end, parent, signature, exported, **more) -> dict:
        row = {
            "id": id_, "name": name, "kind": kind, "file_path": self.path, "line": start[0], "column": start[1], "end_line": end[0], "end_column": end[1],
            "signature": signature, "parameters_json": None, "return_type": None, "docstring": None, "parent_id": parent["id"] if parent else None, "decorator": None,
            "exported": exported, "language": self.language, "inheritence": None,
        }
        row |= more
        self.symbols.append(row)
        return row

    def imported(self, module: str, names: list[str], kind: str, edge: str = "import") -> None:
        n = len(self.imports)
        self.imports.append({
            "id": digest("import", self.path, n, module), "file_path": self.path, "sourceModule": module, "importedNames": names, "resolvedPath": None, "resolvedKind": "unresolved",
            "isExternal": not module.startswith("."), "importKind": kind, "resolutionSource": "unresolved", "edgeKind": edge, "isRuntimeDependency": kind != "type-only", "confidence": 0, "reason": None,
        })

    def call(self, caller: dict, kind: str, name: str, expression: str, text: str, start: tuple[int, int], end: tuple[int, int], base: str | None = None, prop: str | None = None, docstring: str | None = None) -> None:
        self.call_sites.append({
            "id": digest("site", self.path, *start, len(self.call_sites)), "caller_id": caller["id"], "caller_file_path": self.path, "language_name": self.language, "call_text": text,
            "callee_expression": expression, "callee_name": name, "callee_base": base, "callee_property": prop, "call_kind": kind, "call_line": start[0] + 1, "call_column": start[1] + 1,
            "end_line": end[0] + 1, "end_column": end[1] + 1, "docstring": docstring,
        })

    def raised(self, owner: dict, start: tuple[int, int], type_: str = "Error") -> None:
        self.exceptions.append({"id": digest("throw", self.path, *start), "symbol_id": owner["id"], "file_path": self.path, "exception_type": type_, "line": start[0], "column": start[1]})

    def env(self, owner: dict, name: str, start: tuple[int, int]) -> None:
        self.env_vars.append({"id": digest("env", self.path, *start, name), "symbol_id": owner["id"], "file_path": self.path, "name": name, "line": start[0], "column": start[1]})
