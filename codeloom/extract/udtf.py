"""Extraction and parsers for SQL: a table function and scalar functions under names of their own."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import parsers
from .run import TABLES, extract_file


@udtf(returnType="tab: string, row: string")
class ExtractSource:
    """`select * from codeloom_extract(path, content, language)`: a row of JSON for each row of each table."""

    def eval(self, path: str, content: str, language: str):
        out = extract_file(content or "", path, language)
        for t in TABLES:
            for r in getattr(out, t):
                yield t, json.dumps(r)


def register(spark: SparkSession) -> None:
    """Makes `codeloom_extract`, `codeloom_type_names`, `codeloom_arguments`, `codeloom_strip_parentheses` and `codeloom_comment_text` known to SQL."""
    spark.udtf.register("codeloom_extract", ExtractSource)
    for name, returns in (("type_names", "array<string>"), ("arguments", "array<string>"), ("strip_parentheses", "string"), ("comment_text", "string")):
        spark.udf.register(f"codeloom_{name}", parsers.udf_of(getattr(parsers, name), returns))
