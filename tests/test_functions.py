"""Scalar functions and parsers."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import parsers, scalars
from codeloom.functions.globs import IgnoreRules, LinkedGlobs, trim_pattern
from codeloom.functions.paths import is_test, top_dir


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.truncate(lit("abcdef"), 4)) == "abc…" and one(spark, scalars.truncate(lit("abcd"), 4)) == "abcd"
    assert one(spark, scalars.node_id(lit("a.b/c-d_1"))) == "a_b_c_d_1" and one(spark, scalars.collapse_wildcards(lit("a%%%b%"))) == "a%b%"
    assert [one(spark, scalars.confidence(lit(s))) for s in ("dynamic_pattern", "same_class_property", "lsp_hover", "nonsense")] == [100, 72, 60, 0]
    assert [one(spark, scalars.search_mode(lit(q))) for q in ("a/b", "find all of these", " a b c ")] == ["file_compact", "semantic", "symbol"]
    params = '[{"name":"a","type":"int","optional":true},{"name":"b","type":null}]'
    assert one(spark, scalars.format_parameters(lit(params))) == "a?: int, b" and one(spark, scalars.format_parameters(lit("oops"))) == "(none)"
    assert [one(spark, scalars.duration(lit(n))) for n in (0, 999, 61_000, 3_600_000, 3_723_500)] == ["0s", "0s", "1m 1s", "1h", "1h 2m 3s"]
    assert one(spark, scalars.date_time(lit(1_700_000_000_123))) == "2023-11-14T22:13:20Z"
    assert one(spark, scalars.end_of_day(lit(1_700_000_000_123))) - one(spark, scalars.start_of_day(lit(1_700_000_000_123))) == 86_399_999
    assert one(spark, scalars.approximate_cost(lit(12_345))) == 0.037 and one(spark, scalars.token_estimate(lit("123456789"))) == 3
    names = F.array(lit(" a as b "), lit("type T as U"), lit("c"), lit(""))
    assert one(spark, scalars.local_names(names)) == ["b", "c"] and one(spark, scalars.original_names(names, types=True)) == ["a", "T", "c"]
    assert one(spark, scalars.local_names(F.array(lit("Item0"), lit("1up1"), lit(" z2 ")))) == ["Item0", "1up1", "z2"]
    assert one(spark, scalars.path_refs(lit("see src/a.ts, `lib/b` and (c/d/e.py) src/a.ts"))) == ["src/a.ts", "lib/b", "c/d/e.py"]
    assert one(spark, scalars.symbol_refs(lit("`abc` `ab` `abc` `a b`"))) == ["abc"]
    assert one(spark, scalars.callee_parts(lit("a?.b!.c.d"), "typescript")) == ["a", "b", "c", "d"]
    assert [one(spark, scalars.resolution_note(lit(s), lit(n).cast("int"))) for s, n in (("same_file", 80), ("unresolved", 0), (None, None))] == [" [resolution: same_file, confidence 80]", " [resolution: unresolved, confidence 0]", ""]
    hover = one(spark, scalars.hover_signature(lit("function f(a: string, b?: number): Promise<void>")))
    assert (hover.parameters, hover.returns) == ("a: string, b?: number", "Promise<void>")


def test_paths(spark):
    assert [one(spark, top_dir(F.lit(p), n)) for p, n in (("a/b/c.ts", 1), ("a/b/c.ts", 2), ("a/b/c.ts", 9), ("c.ts", 1))] == ["a", "a/b", "a/b", "(root)"]
    assert [one(spark, is_test(F.lit(p))) for p in ("a/x.test.ts", "tests/a.py", "src/__tests__/b.ts", "src/attests/b.ts", "latest.ts")] == [True, True, True, False, False]


def test_parsers(spark):
    assert parsers.type_names("A<B, C>, D.E, F | G, {x: 1}") == ["A", "D.E"]
    assert parsers.arguments("(a, f(b, c),  'x,y', [1, 2])") == ["a", "f(b, c)", "'x,y'", "[1, 2]"] and parsers.arguments("()") == []
    assert parsers.receiver_chain("a.b(c.d)?.e().f", "f") == ["a", "b(c.d)", "e()"]
    assert parsers.strip_parentheses("((a) + (b))") == "(a) + (b)" and parsers.strip_parentheses("((x))") == "x"
    assert parsers.resolve_module("src/a/b.ts", "../c") == "src/c" and parsers.resolve_module("pkg/a.py", "..other") == "other" and parsers.resolve_module("a.ts", "../x") is None
    assert parsers.comment_text("/**\n * One.\n * Two.\n */") == "One.\nTwo." and parsers.comment_text("// a\n// b") == "a\nb" and parsers.comment_text('"""doc"""') == "doc"
    assert parsers.comment("One.\nTwo.", "typescript", "  ") == "  /**\n   * One.\n   * Two.\n   */" and parsers.comment("Doc.", "python") == '"""Doc."""'
    df = spark.createDataFrame([("a, b<c, d>",), (None,)], "t string").select(parsers.udf_of(parsers.type_names, "array<string>")("t").alias("x"))
    assert [r.x for r in df.collect()] == [["a", "b"], None]


@pytest.mark.parametrize(
    ("patterns", "path", "ignored"),
    [
        (["*.log"], "a/b.log", True), (["/a.log"], "b/a.log", False), (["build/"], "x/build/y.ts", True), (["build/"], "build", False), (["a/**/z.ts"], "a/z.ts", True), (["a/**/z.ts"], "a/b/c/z.ts", True),
        (["*.ts", "!keep.ts"], "keep.ts", False), (["!keep.ts", "*.ts"], "keep.ts", True), (["# c", "", "x?.ts"], "xy.ts", True), (["x[0-9].ts"], "x5.ts", True), (["x[!0-9].ts"], "x5.ts", False), (["*.{test,spec}.*"], "q/a.spec.ts", True),
        (["docs"], "src/docs/a.ts", True), (["src/docs"], "a/src/docs/x", False), (["\\#a"], "#a", True), (["*.ts"], "a.tsx", False), (["a/*"], "a/b/c", True), (["a/*.ts"], "a/b/c.ts", False),
    ],
)
def test_ignore_patterns(spark, patterns, path, ignored):
    rules = IgnoreRules().plus(patterns)
    assert rules.ignored(path) == ignored == one(spark, rules.column(F.lit(path)))


@pytest.mark.parametrize(
    ("patterns", "path", "ignored"),
    [
        (["*.ts", "!keep.ts"], "keep.ts", False), (["!keep.ts", "*.ts"], "a/keep.ts", False), (["*.ts", "!keep.ts"], "a/drop.ts", True), (["*.ts", "a/*", "!a/b.js"], "a/b.js", False), (["!a.js"], "a.js", False),
        (["*.ts", "*.t?", "!keep.ts"], "keep.ts", False), (["x.*", "*.ts", "!y.ts"], "y.ts", False), (["docs"], "src/docs/a/b.ts", True), (["docs"], "src/docs", True), (["/docs"], "src/docs/a.ts", False),
        (["docs", "!docs/keep.ts"], "docs/keep.ts", False), (["docs", "!docs/keep.ts"], "docs/other.ts", True), (["keep.ts", "!keep.ts"], "keep.ts", False), (["# c", ""], "c", False),
    ],
)
def test_linked_globs(spark, patterns, path, ignored):
    rules = LinkedGlobs().plus(patterns)
    assert rules.ignored(path) == ignored == one(spark, rules.column(F.lit(path)))


def test_scoped_patterns():
    linked = LinkedGlobs().plus(["*.log"]).plus(["*.ts", "!keep.ts"], "pkg")
    assert linked.ignored("a.log") and linked.ignored("pkg/a/b.ts") and not linked.ignored("pkg/keep.ts") and not linked.ignored("a.ts")
    rules = IgnoreRules().plus(["gen/"]).plus(["/local.ts", "!gen/"], "pkg")
    assert rules.ignored("gen/a.ts") and not rules.ignored("pkg/gen/a.ts") and rules.ignored("pkg/local.ts") and not rules.ignored("local.ts")
    assert trim_pattern("  a\\  ") == "a\\ " and trim_pattern("a  ") == "a"
