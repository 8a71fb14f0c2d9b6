"""Paths of a workspace, on the driver."""

from __future__ import annotations

import json
import os
import re


def resolve_path(path: str, base: str | None = None) -> str:
    """A path with `~` and relative parts worked out, from `base` or the current folder."""
    path = os.path.expanduser(path)
    return os.path.normpath(path if os.path.isabs(path) else os.path.join(base or os.getcwd(), path))


def inside(root: str, path: str) -> str:
    """The absolute path of a workspace's file; an error for one outside of the workspace, also by links."""
    root = os.path.realpath(root)
    full = os.path.realpath(resolve_path(path, root))
    if full != root and not full.startswith(root + os.sep):
        raise ValueError(f"{path!r} is outside of the workspace")
    return full


def path_type(path: str) -> str:
    return "directory" if os.path.isdir(path) else "file" if os.path.isfile(path) else "other"


def loose_json(text: str):
    """JSON with comments and trailing commas."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
