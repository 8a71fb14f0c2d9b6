"""Ignore patterns: compiled on the driver to regular expressions that a filter evaluates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_pattern(line: str) -> str:
    """A line of an ignore file without blanks at its ends; an escaped last blank stays."""
    line = line.strip("\r\n").lstrip()
    bare = line.rstrip()
    return bare + " " if bare.endswith("\\") and len(line) > len(bare) else bare


def glob_regex(glob: str) -> str:
    """`*` within a folder, `**` across folders, `?`, `[..]` and `{a,b}`."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif ch == "{" and "}" in glob[i:]:
            out, braces = out + "(?:", braces + 1
        elif ch == "}" and braces:
            out, braces = out + ")", braces - 1
        elif ch == "," and braces:
            out += "|"
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(ch)
        i += 1
    return out


def pattern_regexes(pattern: str, scope: str = "") -> list[str]:
    """What an ignore pattern in folder `scope` matches: a path, and all below it."""
    body = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    base = re.escape(scope.strip("/")) + "/" if scope.strip("/") else ""
    any_depth = "" if anchored else "(?:.*/)?"
    shape = f"{base}{any_depth}{glob_regex(body)}"
    return [f"^{shape}/.*$"] if pattern.endswith("/") else [f"^{shape}$", f"^{shape}/.*$"]


@dataclass(frozen=True)
class IgnoreRules:
    """Patterns in order, each with whether it is negated; the last one that matches decides."""

    rules: tuple[tuple[str, bool], ...] = ()

    def plus(self, patterns, scope: str = "") -> IgnoreRules:
        out = list(self.rules)
        for line in patterns:
            line = trim_pattern(line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            out += [(r, negated) for r in pattern_regexes(line[1:] if negated else line.removeprefix("\\"), scope)]
        return IgnoreRules(tuple(out))

    def ignored(self, path: str) -> bool:
        verdict = False
        for regex, negated in self.rules:
            if re.match(regex, path):
                verdict = not negated
        return verdict

    def column(self, path: Column) -> Column:
        verdict = F.lit(False)
        for regex, negated in self.rules:
            verdict = F.when(path.rlike(regex), not negated).otherwise(verdict)
        return verdict


@dataclass(frozen=True)
class LinkedGlobs:
    """Globs in order, where a negated one belongs to the others that match its text.

    The first glob that is not negated and matches a path decides: the path is
    ignored unless a negated glob of that one matches it too. A negated glob
    that belongs to none has no effect. A pattern without wildcards means the
    path and all below it; one without a slash in front, any depth.
    """

    globs: tuple[tuple[str, bool], ...] = ()

    def plus(self, patterns, scope: str = "") -> LinkedGlobs:
        out = dict(self.globs)
        base = scope.strip("/") + "/" if scope.strip("/") else ""
        for line in patterns:
            line = trim_pattern(line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            body = line[1:] if negated else line.removeprefix("\\")
            glob = base + (body[1:] if body.startswith("/") else body if body.startswith("**/") else f"**/{body}")
            bare = glob.rstrip("/")
            out |= dict.fromkeys([glob] if re.search(r"[*?\[\]{}]", body) else [bare, f"{bare}/**/*"], negated)
        return LinkedGlobs(tuple(out.items()))

    def linked(self) -> list[tuple[str, list[str]]]:
        """Expressions of the globs that are not negated, each with those of its negated ones."""
        shape = {glob: f"^{glob_regex(glob)}$" for glob, _ in self.globs}
        negated = [glob for glob, no in self.globs if no]
        return [(shape[glob], [shape[n] for n in negated if re.match(shape[glob], n)]) for glob, no in self.globs if not no]

    def ignored(self, path: str) -> bool:
        for regex, negated in self.linked():
            if re.match(regex, path):
                return not any(re.match(n, path) for n in negated)
        return False

    def column(self, path: Column) -> Column:
        verdict = F.lit(False)
        for regex, negated in reversed(self.linked()):
            kept = F.lit(False)
            for n in negated:
                kept = kept | path.rlike(n)
            verdict = F.when(path.rlike(regex), ~kept).otherwise(verdict)
        return verdict
