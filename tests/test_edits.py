"""Edits, chains of resolvers and walks by tasks."""

import random

import pytest
from graphs import catalog
from pyspark.sql import functions as F

from codeloom import config as settings
from codeloom.operators import chain, edits
from codeloom.sources import files, walk

EDITS = "path string, at int, expected string, text string"


def plain(text, mine):
    out, end, done = "", 0, 0
    for at, n, expected, new in sorted((a, len(x), x, t) for a, x, t in mine):
        if at >= end and at + n <= len(text) and text[at : at + n] == expected:
            out, end, done = out + text[end:at] + new, at + n, done + 1
    return out + text[end:], done, len(mine) - done


def test_edits(spark):
    rng = random.Random(1)
    texts = {f"f{k}": "".join(rng.choice("abé\n") for _ in range(rng.randrange(30))) for k in range(40)} | {"none": "abc"}
    rows = []
    for p, t in texts.items():
        for _ in range(rng.randrange(5)) if p != "none" else ():
            at = rng.randrange(len(t) + 2)
            rows.append((p, at, rng.choice([t[at : at + 2], t[at : at + 2], "", "zz"]), rng.choice(["", "X", "new"])))
    got = {r.path: (r.content, r.applied, r.rejected) for r in edits.apply_edits(spark.createDataFrame(list(texts.items()), "path string, content string"), spark.createDataFrame([*rows, ("gone", 0, "", "x")], EDITS)).collect()}
    assert got == {p: plain(t, [(a, x, n) for q, a, x, n in rows if q == p]) for p, t in texts.items() if any(r[0] == p for r in rows)}


def test_odd_edits(spark):
    rows = [("a", -1, "", "x"), ("a", None, "", "x"), ("a", 0, None, "x"), ("a", 0, "", None), ("a", 9, "", "x"), ("b", 0, "", "x")]
    got = {r.path: (r.content, r.applied, r.rejected) for r in edits.apply_edits(spark.createDataFrame([("a", "abc"), ("b", None)], "path string, content string"), spark.createDataFrame(rows, EDITS)).collect()}
    assert got == {"a": ("abc", 0, 5), "b": ("x", 1, 0)}


def test_docstrings_are_written_back(spark):
    contents = spark.createDataFrame([("a.ts", "const x = 1\n  function f() {\n  }\n"), ("b.py", "class A:\n    def g(self):\n        return 1\n")], "path string, content string")
    c = catalog(spark, symbols=[{"id": "f", "name": "f", "file_path": "a.ts", "line": 1, "language": "typescript"}, {"id": "g", "name": "g", "file_path": "b.py", "line": 1, "language": "python"}])
    made = spark.createDataFrame([("f", "Does f.\nTwice."), ("g", "Does g."), ("h", "Unknown.")], "id string, docstring string")
    out = {r.path: r.content for r in edits.apply_edits(contents, edits.docstring_edits(c, contents, made)).collect()}
    assert out == {"a.ts": "const x = 1\n  /**\n   * Does f.\n   * Twice.\n   */\n  function f() {\n  }\n", "b.py": 'class A:\n    def g(self):\n        """Does g."""\n        return 1\n'}


def test_chain(spark):
    rows = spark.createDataFrame([(f"r{k}", "python" if k % 2 else "typescript", k) for k in range(12)], "id string, language string, k int")
    seen = []

    def answer(low, high):
        def ask(df):
            seen.append(sorted(r.id for r in df.collect()))
            return df.filter(f"k between {low} and {high}").select("id", F.col("k").alias("found")).unionByName(spark.createDataFrame([("other", 1)], "id string, found int"))

        return ask

    def broken(df):
        return df.select("id", F.raise_error(F.lit("no")).cast("int").alias("found"))

    done = chain.run(rows, [chain.Member("scripts", answer(0, 4), ("typescript",)), chain.Member("broken", broken), chain.Member("rest", answer(3, 9))], "id string, found int")
    got = {r.id: (r.member, r.found) for r in done.answers.collect()}
    assert got == {f"r{k}": ("scripts" if k % 2 == 0 and k <= 4 else "rest", k) for k in (0, 2, 4, 3, 5, 6, 7, 8, 9)}
    assert {r.id for r in done.left.collect()} == {"r1", "r10", "r11"} and [n for n, _ in done.failed] == ["broken"]
    assert seen[0] == sorted(f"r{k}" for k in range(0, 12, 2)) and "r0" not in seen[1]


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        ".gitignore": "*.log\nbuild/\n", "a.py": "x = 1\n", "b.log": "", "build/c.py": "y = 1\n", "src/.gitignore": "!keep.log\nsecret.py\n", "src/keep.log": "k", "src/secret.py": "s", "src/deep/er/d.ts": "const d = 1",
        "src/deep/er/secret.py": "t", "node_modules/x/e.ts": "const e = 1", "secret.py": "z = 1",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_walk(spark, tree):
    config = settings.Config()
    found = walk.walk(spark, str(tree), config)
    paths = {r.path for r in found.collect()}
    assert {"a.py", "secret.py", "src/keep.log", "src/deep/er/d.ts"} <= paths
    assert not paths & {"b.log", "build/c.py", "src/secret.py", "src/deep/er/secret.py"}
    row = lambda df: sorted(map(tuple, df.select("path", "content", "language", "hash", "estimated_tokens").collect()))
    assert row(walk.read(spark, str(tree), found, config)) == row(files.scan(spark, str(tree), config, compat=True).filter("path <> 'src/secret.py' and path <> 'src/deep/er/secret.py'"))
    (tree / "a.py").write_text("x = 22\n")
    (tree / "secret.py").unlink()
    (tree / "new.py").write_text("n = 1\n")
    before = found
    assert {(r.path, r.kind) for r in walk.changed(before, walk.walk(spark, str(tree), config)).collect()} == {("a.py", "upsert"), ("new.py", "upsert"), ("secret.py", "unlink")}
    assert walk.walk(spark, str(tree / "nowhere"), config).count() == 0
