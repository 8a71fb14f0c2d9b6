"""Personal data: base patterns, and identifiers that bootstrapped contexts add.

Base kinds are found by their patterns. They are the seeds of a bootstrap for
identifiers that the patterns do not match (a number without its country code,
an address written with "(at)", a card number with a slip): every occurrence of
a seed, and of a candidate of like shape, is an instance with the lexical
patterns around it (the word before, the two words before, the words on both
sides). Rounds over the graph of patterns and instances then score in turn

* a pattern for a kind: the instances known to be of that kind, as a share of all
  that it goes with, where unknown ones that might be of it count a part;
* an instance: the mean score of its patterns that have enough seeds, of which
  several have to be reliable for one kind.

Accepted instances are seeds of the next round. What leaves the texts is a row
for each occurrence; edges are counted once for each pattern and instance, so
copies of a document add nothing, and no group is gathered in one place.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: What found identifiers are called, in the order of KINDS; they come after the base kinds.
LIKE = tuple(f"{k}_like" for k in KINDS)

# What the base kinds look like. Quantifiers are possessive where that changes no match, so that none takes quadratic time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates: numbers of six digits or more in groups, addresses with another sign for "at" or a single label, addresses in hexadecimal groups.
NUMBER = re.compile(r"\(?[0-9](?:[\x20()./-]{0,2}[0-9]){5,}+")
AT = re.compile(r"([\w.%+-]{1,64}) ?(?:[\[({<] ?(?:at|AT) ?[\])}>]|@) ?(\w[\w-]{0,62}(?: ?(?:\.|[\[({<] ?(?:dot|DOT) ?[\])}>]) ?\w[\w-]{0,62}){0,6})")
AT_SIGN = re.compile(r"[\[({<] ?(?:at|AT) ?[\])}>]|@")
GROUPS = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
#: Characters of a candidate at most, and characters on each side in which its context is looked for.
LONGEST, AROUND = 80, 64


@dataclass(frozen=True)
class Rules:
    """Rounds; known instances that a pattern needs; its least score; reliable patterns that an instance needs; its least score; what an unknown instance of like shape counts against a pattern."""

    rounds: int = 3
    support: int = 5
    reliable: float = 0.9
    patterns: int = 2
    accepted: float = 0.9
    unknown: float = 0.25


#: Rows of reliable patterns or accepted instances that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
FOUND = "array<struct<at:int,end:int,kind:int,fits:int,instance:long,patterns:array<long>>>"
SCANNED = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found {FOUND}"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins with the run of local characters before its @, as far back as the match before allows."""
    free = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        while at > free and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            free = m.end()
            yield at, free


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Dotted numbers are taken four parts at a time, as a scan from the left does."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    spans += [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(spans)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, kinds that the shape fits, as bits, normal form) of identifiers that overlap no base span and each other."""
    found = []
    for m in NUMBER.finditer(text):
        if m.end() - m.start() <= LONGEST:
            digits = _digits(m.group())
            fits = (2 if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", m.group()) else 0) | (4 if 12 <= len(digits) <= 19 else 0) | (8 if 7 <= len(digits) <= 15 else 0)
            if fits:
                found.append((m.start(), m.end(), fits, digits))
    joined: list[list[int]] = []
    for a, _, b in taken:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    starts = [a for a, _ in joined]
    clear = lambda a, b: (k := bisect_left(starts, b)) == 0 or joined[k - 1][1] <= a
    for sign in AT_SIGN.finditer(text):
        end = sign.start() - (sign.start() > 0 and text[sign.start() - 1] == " ")
        start = end
        while start > max(end - 64, 0) and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        m = AT.match(text, start) if start < end and clear(*sign.span()) else None
        if m is not None and m.end() > sign.end():
            found.append((start, m.end(), 1, f"{m[1]}@{m[2]}".lower().replace(" ", "")))
    if ":" in text:
        found += [(m.start(), m.end(), 2, m.group().lower()) for m in GROUPS.finditer(text) if sum(c.isdigit() for c in m.group()) > 1]
    free, out = 0, []
    for a, b, fits, form in sorted(found):
        if a >= free and clear(a, b):
            out.append((a, b, fits, form))
            free = b
    return out


def hashed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, a: int, b: int) -> list[int]:
    """Hashes of the lexical patterns around text[a:b]; digits of words are alike."""
    normal = lambda s: re.sub(r"[0-9]", "0", s.lower()).split()
    before, after = normal(text[max(a - AROUND, 0) : a])[-2:], normal(text[b : b + AROUND])[:1]
    out = []
    if before:
        out.append(hashed("before", before[-1]))
        if after:
            out.append(hashed("between", before[-1], after[0]))
    if len(before) == 2:
        out.append(hashed("two before", *before))
    return out


def scan(text: str) -> tuple:
    """Columns of SCANNED without doc_id."""
    spans = base(text)
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    counts = [0] * len(KINDS)
    found = []
    for a, k, b in spans:
        counts[k] += 1
        form = text[a:b].lower() if k < 2 else _digits(text[a:b])
        found.append({"at": a, "end": b, "kind": k, "fits": 1 << k, "instance": hashed(k, form), "patterns": contexts(text, a, b)})
    for a, b, fits, form in candidates(text, spans):
        found.append({"at": a, "end": b, "kind": -1, "fits": fits, "instance": hashed("like", fits, form), "patterns": contexts(text, a, b)})
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined, found)


def scanned(docs: DataFrame) -> DataFrame:
    """SCANNED rows of (doc_id, text): base spans, and all instances with their patterns."""
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("fits", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))]
    names = [part.split()[0] for part in SCANNED.split(" found ")[0].split(", ")] + ["found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(v.as_py() or "") for v in batch.column(1)]
            columns = [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types[1:])]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)


def instances(found: DataFrame) -> DataFrame:
    """(row, at, end, kind, fits, instance, patterns), a row for each occurrence."""
    return found.select("row", F.inline("found"))


def edges(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind, fits): each pattern and instance that occur together, once."""
    return found.select(F.explode("found").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.instance", "x.kind", "x.fits").distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def patterns(graph: DataFrame, known: DataFrame, rules: Rules) -> DataFrame:
    """(pattern, kind, score) of patterns with `support` known instances of some kind: the best kind, and its score.

    known: (instance, label) of accepted candidates, already written.
    """
    labelled = graph.join(_small(known), "instance", "left").withColumn("kind", F.coalesce("label", "kind"))
    of = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"of{k}")
    may = lambda k: F.sum(((F.col("kind") < 0) & (F.col("fits").bitwiseAND(1 << k) != 0)).cast("long")).alias(f"may{k}")
    n = range(len(KINDS))
    sums = labelled.groupBy("pattern").agg(F.count("*").alias("all"), *[of(k) for k in n], *[may(k) for k in n])
    score = lambda k: F.struct((F.col(f"of{k}") / (F.col("all") - (1 - rules.unknown) * F.col(f"may{k}"))).alias("score"), F.lit(-k).alias("k"), F.col(f"of{k}").alias("known"))
    supported = F.filter(F.array(*[score(k) for k in n]), lambda x: x["known"] >= rules.support)
    return sums.select("pattern", F.array_max(supported).alias("best")).filter("best is not null").select("pattern", (-F.col("best.k")).alias("kind"), "best.score")


def accepted(graph: DataFrame, scored: DataFrame, rules: Rules) -> DataFrame:
    """(instance, label) of candidates with enough reliable patterns of one kind that fits them."""
    seen = graph.filter("kind < 0").select("pattern", "instance", "fits").join(_small(scored), "pattern")
    for_kind = lambda k: (F.col("kind") == k) & (F.col("score") >= rules.reliable) & (F.col("fits").bitwiseAND(1 << k) != 0)
    n = range(len(KINDS))
    sums = seen.groupBy("instance").agg(F.count("*").alias("all"), *[F.sum(F.when(for_kind(k), F.col("score")).otherwise(0.0)).alias(f"sum{k}") for k in n], *[F.sum(for_kind(k).cast("int")).alias(f"n{k}") for k in n])
    best = F.array_max(F.filter(F.array(*[F.struct((F.col(f"sum{k}") / F.col("all")).alias("score"), F.lit(-k).alias("k"), F.col(f"n{k}").alias("n")) for k in n]), lambda x: x["n"] >= rules.patterns))
    return sums.select("instance", best.alias("best")).filter(F.col("best.score") >= rules.accepted).select("instance", (-F.col("best.k")).alias("label"))


def bootstrap(graph: DataFrame, scratch: common.Scratch, rules: Rules = Rules()) -> DataFrame:
    """(instance, label) of the candidates that are accepted in the end, as of which kind."""
    known, n = scratch.keep(graph.filter("false").select("instance", F.col("kind").alias("label")), "known0"), 0
    for k in range(1, rules.rounds + 1):
        scored = scratch.keep(patterns(graph, known, rules), f"patterns{k}")
        more = accepted(graph, scored, rules)
        known = scratch.keep(known.unionByName(more.join(known.select("instance"), "instance", "left_anti")), f"known{k}")
        before, n = n, known.count()
        if n == before:
            break
    return known


def personal(docs: DataFrame, scratch: common.Scratch, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of `docs` (doc_id, text).

    `spans` has the base spans and those of accepted candidates, by start. A
    null text is empty; rows that repeat an id, or have none, keep a row each;
    equal texts give equal spans. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    found = scratch.keep(scanned(docs).withColumn("row", F.monotonically_increasing_id()), "scanned")
    shown = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    graph = scratch.keep(edges(found), "edges")
    known = bootstrap(graph, scratch, rules)
    if known.isEmpty():
        return found.select(*shown)
    hits = instances(found).filter("kind < 0").join(_small(known), "instance")
    name = F.element_at(F.array(*[F.lit(k) for k in LIKE]), F.col("label") + 1)
    added = hits.groupBy("row").agg(F.collect_list(F.struct("at", (F.col("label") + len(KINDS)).alias("rank"), F.concat_ws(":", name, F.col("at").cast("string"), F.col("end").cast("string")).alias("span"))).alias("added"))
    added = scratch.keep(added, "added")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    parts = F.filter(F.split("spans", ","), lambda x: x != "")
    own = F.transform(parts, lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("at"), rank[F.split(x, ":")[0]].alias("rank"), x.alias("span")))
    merged = F.array_join(F.transform(F.array_sort(F.concat(own, "added")), lambda x: x["span"]), ",")
    return found.drop("found").join(_small(added), "row", "left").withColumn("spans", F.when(F.col("added").isNull(), F.col("spans")).otherwise(merged)).select(*shown)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return personal(common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op12"))
