"""Parsers of nested text, which Column expressions can't follow. Plain functions; `udf_of` makes Spark functions of them."""

import posixpath
import re

_OPEN, _CLOSE = "([{<", ")]}>"


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts of a text between separators that stand outside of brackets and quotes."""
    parts, depth, quote, at = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            if ch == quote and text[i - 1] != "\\":
                quote = ""
        elif ch in "\"'`":
            quote = ch
        elif ch in _OPEN:
            depth += 1
        elif ch in _CLOSE and not (ch == ">" and i and text[i - 1] == "="):
            depth = max(0, depth - 1)
        elif ch == separator and not depth:
            parts.append(text[at:i])
            at = i + 1
    parts.append(text[at:])
    return parts


def type_names(text: str | None) -> list[str]:
    """The names in a list of types, without their type arguments."""
    out = []
    for part in split_top(text or ""):
        name = part.split("<", 1)[0].strip()
        if re.fullmatch(r"[A-Za-z_$][\w$.]*", name):
            out.append(name)
    return out


def arguments(text: str | None) -> list[str]:
    """Arguments of a call's bracketed text, each with single spaces."""
    inner = (text or "").strip()
    if inner.startswith("(") and inner.endswith(")"):
        inner = inner[1:-1]
    return [x for x in (re.sub(r"\s+", " ", p).strip() for p in split_top(inner)) if x]


def receiver_chain(expression: str | None, callee: str) -> list[str]:
    """What stands before the callee in a member chain: `a.b().c` before `c` gives a, b()."""
    parts, depth, at, text = [], 0, 0, (expression or "").replace("?.", ".").replace("!.", ".")
    for i, ch in enumerate(text):
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "." and not depth:
            parts.append(text[at:i].strip())
            at = i + 1
    parts.append(text[at:].strip())
    for i in range(len(parts) - 1, -1, -1):
        if parts[i].split("(", 1)[0] == callee:
            return parts[:i]
    return parts[:-1]


def strip_parentheses(text: str, most: int = 5) -> str:
    """A text without the parentheses that enclose all of it."""
    out = text.strip()
    for _ in range(most):
        if not (out.startswith("(") and out.endswith(")")):
            break
        depth = 0
        for i, ch in enumerate(out):
            depth += (ch == "(") - (ch == ")")
            if not depth and i < len(out) - 1:
                return out
        out = out[1:-1].strip()
    return out


def resolve_module(path: str, module: str) -> str | None:
    """The project path, without extension, that a relative module names from a file; null outside of the project."""
    if not module.startswith("."):
        return module
    if "/" not in module:  # dots as in Python: one for the own folder, one more for each above it
        dots = len(module) - len(module.lstrip("."))
        module = "./" + "../" * (dots - 1) + module[dots:].replace(".", "/")
    out = posixpath.normpath(posixpath.join(posixpath.dirname(path), module))
    return None if out.startswith("..") else out


def comment(text: str, language: str, indent: str = "") -> str:
    """A docstring as a comment of the language."""
    lines = text.strip().splitlines() or [""]
    if language == "python":
        body = f"\n{indent}".join(lines)
        return f'{indent}"""{body}"""' if len(lines) == 1 else f'{indent}"""{body}\n{indent}"""'
    if len(lines) == 1:
        return f"{indent}/** {lines[0]} */"
    return "\n".join([f"{indent}/**", *(f"{indent} * {x}".rstrip() for x in lines), f"{indent} */"])


def comment_text(text: str) -> str:
    """What a comment says, without its marks."""
    out = re.sub(r'^\s*[rRuUbBfF]{0,2}("""|\'\'\')|("""|\'\'\')\s*$', "", text)
    out = re.sub(r"^\s*/\*\*?|\*/\s*$", "", out)
    out = re.sub(r"(?m)^\s*(\*(?!/)|//+|#+) ?", "", out)
    return out.strip()


def udf_of(function, returns: str):
    """A Spark function of one of these that take one text, which works on Arrow batches; null stays null."""
    import pandas as pd
    from pyspark.sql import functions as F

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else function(x))

    return F.pandas_udf(run, returns)
