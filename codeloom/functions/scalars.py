"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

PARAMETERS = "array<struct<name:string,type:string,optional:boolean>>"
ELLIPSIS = "…"


def collapse_wildcards(x: Column) -> Column:
    return F.regexp_replace(x, "%+", "%")


def truncate(x: Column, most: int = 80) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit(ELLIPSIS))).otherwise(x)


def node_id(x: Column) -> Column:
    """A text as an identifier of a diagram's node."""
    return F.regexp_replace(x, r"[^A-Za-z0-9_]", "_")


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(x) / 4).cast("long")


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def symbol_hash(name: Column, kind: Column, path: Column, line: Column, column: Column, text: Column) -> Column:
    return F.sha2(F.concat(name, kind, path, line.cast("string"), column.cast("string"), text), 256)


def confidence(source: Column) -> Column:
    out = F.lit(0)
    for name, value in schema.CONFIDENCE.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def search_mode(query: Column) -> Column:
    """How a query is meant: a path, a phrase of more than three words, or a symbol."""
    words = F.size(F.split(F.trim(query), r"\s+"))
    return F.when(query.rlike(r"[/\\]"), "file_compact").when(words > 3, "semantic").otherwise("symbol")


def parameters(json: Column) -> Column:
    """Parameters of a callable; null where the text is no such list."""
    return F.from_json(json, PARAMETERS)


def format_parameters(json: Column) -> Column:
    one = lambda p: F.concat(p["name"], F.when(F.coalesce(p["optional"], F.lit(False)), "?").otherwise(""), F.when(p["type"].isNotNull(), F.concat(F.lit(": "), p["type"])).otherwise(""))
    listed = F.array_join(F.transform(parameters(json), one), ", ")
    return F.when(F.coalesce(listed, F.lit("")) == "", "(none)").otherwise(listed)


def format_inheritance(bases: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(bases, lambda b: F.concat_ws(" ", b["inheritence_type"], b["inherits_from_name"])), "\n"), F.lit(""))


def resolution_note(source: Column, confidence_: Column) -> Column:
    """How a call was resolved, for display; nothing if nothing is known."""
    known = F.concat_ws(", ", source, F.when(confidence_.isNotNull(), F.concat(F.lit("confidence "), confidence_.cast("string"))))
    return F.when(known == "", "").when(confidence_ == 0, " [resolution: unresolved, confidence 0]").otherwise(F.concat(F.lit(" [resolution: "), known, F.lit("]")))


# What counts as a path, and as a symbol, in a text.
PATH_REF = r"""(?m)(?:^|[\s`'"(])([a-zA-Z][\w./\-]*\/[\w./\-]+(\.\w{1,6})?)(?:$|[\s`'")\]:,])"""
SYMBOL_REF = r"`([A-Za-z_$][\w$]*)`"


def path_refs(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(PATH_REF), F.lit(1)))


def symbol_refs(x: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(x, F.lit(SYMBOL_REF), F.lit(1))), lambda v: F.length(v) >= 3)


def approximate_cost(tokens: Column, per_million: float = 3.0) -> Column:
    return F.round(tokens * per_million / 1e6, 4)


def start_of_day(millis: Column) -> Column:
    return F.unix_millis(F.date_trunc("DAY", F.timestamp_millis(millis)))


def end_of_day(millis: Column) -> Column:
    return F.unix_millis(F.date_trunc("DAY", F.timestamp_millis(millis)) + F.expr("interval 1 day")) - 1


def duration(millis: Column) -> Column:
    """`1h 2m 3s`, without parts that are zero; `0s` for less than a second."""
    seconds = F.floor(millis / 1000)
    part = lambda v, unit: F.when(v > 0, F.concat(v.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(F.floor(seconds / 3600), "h"), part(F.floor(seconds % 3600 / 60), "m"), part(seconds % 60, "s"))
    return F.when(text == "", "0s").otherwise(text)


def date_time(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.floor(millis / 1000) * 1000), "yyyy-MM-dd'T'HH:mm:ssXXX")


def callee_parts(x: Column, language: str | Column) -> Column:
    """The parts of a callee expression between its member accesses. Of a column of languages, all but python are read like typescript."""
    plain, typescript = F.split(x, r"\."), F.split(F.regexp_replace(x, r"[?!]\.", "."), r"\.")
    if isinstance(language, Column):
        return F.when(language == "python", plain).otherwise(typescript)
    return typescript if language == "typescript" else plain


def _named(imported: Column, types: bool) -> Column:
    """Trimmed, not empty names; those of types without their mark, or left out."""
    names = F.filter(F.transform(imported, lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(names, lambda x: F.regexp_replace(x, r"^type\s+", "")) if types else F.filter(names, lambda x: ~x.startswith("type "))


def local_names(imported: Column, types: bool = False) -> Column:
    """Names as the importing file calls them: what stands after ` as `, if anything does."""
    return F.transform(_named(imported, types), lambda x: F.when(x.rlike(r"\s+as\s+"), F.trim(F.split(x, r"\s+as\s+")[1])).otherwise(x))


def original_names(imported: Column, types: bool = False) -> Column:
    """Names as the imported file calls them."""
    return F.transform(_named(imported, types), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*$", "")))


def hover_signature(hover: Column) -> Column:
    """(parameters, returns) of a hover text such as `function f(a: string): void`, or `(function) def f(a: str) -> None`."""
    flat = F.regexp_replace(hover, r"\s+", " ")
    shape = r"\((?!function|method|class)(.*)\)\s*(?::|->|=>)\s*(.+?)\s*`*$"
    return F.struct(F.regexp_extract(flat, shape, 1).alias("parameters"), F.regexp_extract(flat, shape, 2).alias("returns"))
