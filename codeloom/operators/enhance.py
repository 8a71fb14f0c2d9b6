"""What a language server knows, taken in as frames, and what signatures say: types of callables, bases of types.

Texts are parsed by Column expressions. Brackets are followed by a fold over
the characters of a signature, which puts a mark at separators outside of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Catalog
from . import changes
from .lookup import among

_MARK = "\x01"
_BASE = "struct<inherits_from_name:string,inherits_from_id:string,inherits_from_imports_id:string,inheritence_type:string>"


def split_outside(text: Column, separator: str = ",") -> Column:
    """Parts of a text between separators that stand outside of brackets; `=>` closes none."""
    depth = lambda acc, ch: acc["depth"] + F.when(ch.isin("(", "[", "{", "<"), 1).when(ch.isin(")", "]", "}") | ((ch == ">") & ~acc["arrow"]), -1).otherwise(0)
    step = lambda acc, ch: F.struct(F.concat(acc["out"], F.when((ch == separator) & (acc["depth"] == 0), F.lit(_MARK)).otherwise(ch)).alias("out"), F.greatest(depth(acc, ch), F.lit(0)).alias("depth"), (ch == "=").alias("arrow"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("arrow"))
    return F.split(F.aggregate(F.split(text, ""), start, step)["out"], _MARK)


def type_names(text: Column) -> Column:
    """The names in a list of types, without their arguments; parts that are no name are left out."""
    names = F.transform(split_outside(text), lambda p: F.regexp_extract(p, r"^\s*([A-Za-z_$][\w$.]*)\s*(?:<.*)?$", 1))
    return F.filter(names, lambda n: n != "")


def bases(kind: Column, signature: Column) -> Column:
    """What a signature's own words derive from, as array<struct<name, type>>.

    Classes and interfaces by `extends` and `implements`; types by the parts of
    an intersection, else of a union, else by the first argument of a generic.
    """
    flat = F.regexp_replace(signature, r"\s+", " ")
    named = lambda text, how: F.transform(type_names(text), lambda n: F.struct(n.alias("name"), F.lit(how).alias("type")))
    # A type parameter's own `extends` stands in brackets and is no base, so brackets right after the name are dropped.
    head = F.regexp_replace(flat, r"^(.*?\b(?:class|interface) [\w$]+) ?<[^{]*?>(?= (?:extends|implements)\b| ?\{|$)", "$1")
    after = lambda word: F.regexp_extract(head, rf"\b{word} (.+?)(?= (?:implements|extends)\b| ?\{{|$)", 1)
    right = F.regexp_extract(flat, r"= ?(.+)$", 1)
    spread = lambda sign: F.array_join(split_outside(right, sign), ",")
    parts = lambda sign: F.size(split_outside(right, sign)) > 1
    generic = F.regexp_extract(right, r"^[\w$.]+ ?< ?([A-Za-z_$][\w$.]*)", 1)
    alias = (
        F.when(parts("&"), named(spread("&"), "intersection"))
        .when(parts("|"), named(spread("|"), "union"))
        .when(generic != "", F.array(F.struct(generic.alias("name"), F.lit("extends").alias("type"))))
        .otherwise(F.array().cast("array<struct<name:string,type:string>>"))
    )
    return F.when(kind == "type", alias).otherwise(F.concat(named(after("extends"), "extends"), named(after("implements"), "implements")))


def enhance_bases(c: Catalog, paths: DataFrame | None = None) -> Catalog:
    """Adds the bases that signatures of classes, interfaces and types name, to those of which at least one name is a symbol's."""
    known = c.symbols.filter(F.col("kind").isin("class", "interface", "type") & F.col("signature").isNotNull())
    known = among(known, "file_path", paths) if paths is not None else known
    found = known.select("id", bases(F.col("kind"), F.col("signature")).alias("found")).filter(F.size("found") > 0)
    names = c.symbols.select("name").distinct()
    real = found.select("id", F.explode("found.name").alias("name")).join(names, "name", "left_semi").select("id").distinct()
    none = F.lit(None).cast("string")
    listed = F.transform("found", lambda b: F.struct(b["name"].alias("inherits_from_name"), none.alias("inherits_from_id"), none.alias("inherits_from_imports_id"), b["type"].alias("inheritence_type")).cast(_BASE))
    return changes.update_inheritance(c, found.join(real, "id").select("id", listed.alias("bases")))


def enhance_implementations(c: Catalog, hits: DataFrame) -> Catalog:
    """Adds interfaces to the symbols at which a language server found implementations of them: hits (interface_id, file_path, line)."""
    face = c.symbols.select(F.col("id").alias("interface_id"), F.col("name").alias("interface_name"))
    at = hits.select("interface_id", "file_path", "line").distinct().join(face, "interface_id").join(c.symbols.select("id", "file_path", "line"), ["file_path", "line"]).filter("id <> interface_id")
    one = F.struct(F.col("interface_name").alias("inherits_from_name"), F.col("interface_id").alias("inherits_from_id"), F.lit(None).cast("string").alias("inherits_from_imports_id"), F.lit("implements").alias("inheritence_type")).cast(_BASE)
    return changes.update_inheritance(c, at.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("bases")))


def hover_parts(hover: Column) -> Column:
    """(name, type) of a hover text: what is in the brackets, or before the mark, and what follows `:`, `->` or `=>`.

    Only fenced code counts, where there is any; a word in brackets before it, as `(method)`, does not.
    """
    fenced = F.regexp_extract_all(hover, F.lit(r"(?s)```[a-z]*\n(.*?)```"), F.lit(1))
    code = F.regexp_replace(F.when(F.size(fenced) > 0, F.array_join(fenced, "\n")).otherwise(hover), r"^(?i)\([a-z]+\)\s*", "")
    call = code.contains("(") & code.contains(")")
    shape = F.when(call, F.lit(r"(?s)\((.*?)\)\s*(?:->|=>|:)\s*([^\\\n$(]+)?")).otherwise(F.lit(r"(?s)(.*?)\s*(?:->|=>|:)\s*([^\\\n$(]+)?"))
    part = lambda n: F.trim(F.regexp_replace(F.call_function("regexp_extract", code, shape, F.lit(n)), r"\s+", " "))
    return F.when(F.call_function("rlike", code, shape), F.struct(part(1).alias("name"), F.trim(F.regexp_replace(part(2), ":$", "")).alias("type")))


def enhance_callables(c: Catalog, hovers: DataFrame) -> Catalog:
    """Sets parameters and return types of callables that lack parameters from hovers (id, text); a text without a signature changes nothing."""
    wanted = among(c.symbols, "kind", schema.CALLABLE_KINDS).filter("parameters_json is null").select("id", "return_type")
    read = wanted.join(hovers.select("id", hover_parts(F.col("text")).alias("h")), "id").filter("h is not null")
    parts = F.filter(F.transform(split_outside(F.col("h.name")), lambda p: F.trim(p)), lambda p: p != "")
    kind = lambda p: F.trim(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1))
    listed = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"(?s)^([^:]*)", 1)).alias("name"), F.when(kind(p) == "", "any").otherwise(kind(p)).alias("type")))
    made = read.select("id", F.to_json(listed).alias("parameters_json"), F.when(F.col("h.type") != "", F.col("h.type")).otherwise(F.col("return_type")).alias("return_type"))
    return changes.update_symbols(c, made)
