"""Paths as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of test files, as in ignore files.
TEST_PATTERNS = ("*.{test,spec}.*", "__tests__/**", "tests/**")
#: The same as one regular expression.
TEST_PATH = r"(^|/)[^/]*\.(test|spec)\.[^/]*$|(^|/)(__tests__|tests)/"


def _col(path) -> Column:
    return F.col(path) if isinstance(path, str) else path


def is_test(path) -> Column:
    return _col(path).rlike(TEST_PATH)


def top_dir(path, depth: int = 1) -> Column:
    """The first `depth` folders of a path; `(root)` for a file in none."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))), "/")).otherwise("(root)")


def extension(path) -> Column:
    return F.regexp_extract(_col(path), r"(\.[^./]+)$", 1)


def dirname(path) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def is_path_like(text) -> Column:
    return _col(text).rlike(r"[/\\]")
