"""Settings of an index, from a JSON file merged over defaults section by section."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

FILE_NAME = "codeloom.json"


@dataclass
class Config:
    ignore: list[str] = field(default_factory=lambda: ["node_modules/", ".git/", "dist/", "build/", "coverage/", "__pycache__/", ".venv/", "venv/"])
    use_gitignore: bool = True
    test_patterns: list[str] = field(default_factory=lambda: ["*.{test,spec}.*", "__tests__/**", "tests/**"])
    languages: dict[str, list[str]] = field(
        default_factory=lambda: {"typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"], "python": [".py"], "javascript": [".js", ".mjs", ".cjs"]}
    )
    source_roots: list[str] = field(default_factory=lambda: ["src", ".", "app", "apps", "packages", "lib", "libs"])
    path_aliases: list[list[str]] = field(default_factory=list)
    embeddings: bool = False
    docstrings: bool = False
    embedding_width: int = 768

    @property
    def extensions(self) -> dict[str, str]:
        """Language of each extension of an enabled language."""
        return {e: lang for lang, es in self.languages.items() for e in es}


def load(root: str) -> Config:
    """The settings of a folder; a section that is missing or of another type than its default keeps the default."""
    out = Config()
    try:
        with open(os.path.join(root, FILE_NAME)) as f:
            given = json.load(f)
    except (OSError, ValueError):
        return out
    for name, default in asdict(out).items():
        if isinstance(given, dict) and isinstance(given.get(name), type(default)):
            setattr(out, name, default | given[name] if isinstance(default, dict) else given[name])
    return out


def save(root: str, config: Config | None = None) -> bool:
    """Writes the settings where there are none yet."""
    path = os.path.join(root, FILE_NAME)
    if os.path.exists(path):
        return False
    with open(path, "w") as f:
        json.dump(asdict(config or Config()), f, indent=2)
    return True
