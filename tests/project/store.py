"""Keeps things."""
import os
import json as js
from typing import TYPE_CHECKING
from .pkg.other import helper as assist

if TYPE_CHECKING:
    from .pkg.other import Unused

__all__ = ["_open", "Store"]
LIMIT: int = 3


def _open(path: str, mode="r"):
    """Opens a path."""
    token = os.environ["STORE_TOKEN"] or os.getenv("OTHER")
    if not token:
        raise ValueError("no token")
    return assist(path)


class Store(Base):
    kinds = []

    def __init__(self, root):
        self.root = root
        super().__init__()

    @property
    def size(self) -> int:
        def inner():
            return len(self.kinds)

        return inner() + self.count()

    def count(self):
        return getattr(self, "x")()


def make():
    return Store(_open("a")).count()
