"""Edits of files: replacements at places, applied together where the text is still what it was.

Edits of a file are taken in the order of their places; one that begins before
the last accepted one has ended is rejected, and so is one whose expected text
is not there. The new content is put together by a fold over the accepted ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog

_EDIT = "struct<at:int,n:int,expected:string,text:string>"


def apply_edits(contents: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, applied, rejected) of files (path, content) that have edits (path, at, expected, text).

    `at` counts characters from 0; `expected` is what the edit replaces, the
    empty text for an insertion. Insertions at one place are made in the order
    of their text. An edit at a negative place, behind the end or with a null
    is rejected; edits of unknown files are left out.
    """
    one = F.struct(F.col("at").cast("int").alias("at"), F.length("expected").alias("n"), "expected", "text")
    by = edits.groupBy("path").agg(F.sort_array(F.collect_list(one)).cast(f"array<{_EDIT}>").alias("edits"))
    text = F.coalesce("content", F.lit(""))

    def step(acc: Column, e: Column) -> Column:
        there = F.substring(text, e["at"] + 1, e["n"]) == e["expected"]
        good = F.coalesce((e["at"] >= acc["end"]) & (e["at"] + e["n"] <= F.length(text)) & there & e["text"].isNotNull(), F.lit(False))
        made = F.concat(acc["out"], F.substring(text, acc["end"] + 1, e["at"] - acc["end"]), e["text"])
        return F.struct(
            F.when(good, made).otherwise(acc["out"]).alias("out"), F.when(good, e["at"] + e["n"]).otherwise(acc["end"]).alias("end"),
            (acc["applied"] + good.cast("int")).alias("applied"), (acc["rejected"] + (~good).cast("int")).alias("rejected"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))
    done = contents.join(by, "path").withColumn("_d", F.aggregate("edits", start, step))
    rest = F.substring(text, F.col("_d.end") + 1, F.length(text))
    return done.select("path", F.concat("_d.out", rest).alias("content"), F.col("_d.applied").alias("applied"), F.col("_d.rejected").alias("rejected"))


def line_starts(contents: DataFrame) -> DataFrame:
    """(path, line, at, indent): where each line of each file begins, lines from 0, and the white space that it begins with."""
    lines = contents.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("line", "text"), "content")
    # A line begins behind as many characters as the lines before it and their ends have.
    ahead = F.aggregate(F.slice(F.split("content", "\n"), F.lit(1), F.col("line")), F.lit(0), lambda n, x: n + F.length(x) + 1)
    return lines.select("path", "line", ahead.alias("at"), F.regexp_extract("text", r"^(\s*)", 1).alias("indent"))


def docstring_edits(c: Catalog, contents: DataFrame, made: DataFrame) -> DataFrame:
    """Edits that put docstrings made (id, docstring) before their symbols' lines, or in Python below the line that ends with the colon of the definition."""
    wanted = made.filter("docstring <> ''").join(c.symbols.select("id", "file_path", "line", "language"), "id")
    touched = contents.join(wanted.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")
    starts = line_starts(touched).select(F.col("path").alias("file_path"), "line", "at", "indent")
    python = F.col("language") == "python"
    put = wanted.withColumn("line", F.when(python, F.col("line") + 1).otherwise(F.col("line"))).join(starts, ["file_path", "line"])
    words = F.split(F.trim("docstring"), "\n")
    block = lambda first, every, last: F.concat(F.array_join(F.concat(F.array(first), F.transform(words, every), F.array(last)), "\n"), F.lit("\n"))
    i = F.col("indent")
    script = F.when(F.size(words) == 1, F.concat(i, F.lit("/** "), words[0], F.lit(" */\n"))).otherwise(block(F.concat(i, F.lit("/**")), lambda x: F.rtrim(F.concat(i, F.lit(" * "), x)), F.concat(i, F.lit(" */"))))
    plain = F.when(F.size(words) == 1, F.concat(i, F.lit('"""'), words[0], F.lit('"""\n'))).otherwise(block(F.concat(i, F.lit('"""')), lambda x: F.rtrim(F.concat(i, x)), F.concat(i, F.lit('"""'))))
    return put.select(F.col("file_path").alias("path"), "at", F.lit("").alias("expected"), F.when(python, plain).otherwise(script).alias("text"))
