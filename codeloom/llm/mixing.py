"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r in [0, CAP]: the number of times the mix takes
it, on average. The rates minimise the relative entropy to "take everything
once", the sum of q * (r * log(r) - r + 1), subject to each source's words,
the sum of size * r, meeting its target. Documents weigh q = size / z in the
entropy, with z = (size / mean size)^TILT: a long one as much more than a
short one as its size to the power 1 - TILT. So the solution is
r = min(CAP, exp(lambda_s * size / q)) = min(CAP, exp(lambda_s * z)), where the
multipliers lambda maximise a concave dual that splits by source; safeguarded
Newton steps find them from per-source sums over a histogram of sizes, which
each step computes as a distributed aggregate.

Rates are rounded into copies by systematic sampling in order of size. What a
source is then off by is mended by the best exchange of up to three copies, in
or out, again and again; a document has 0 to CAP copies. A source of a few
documents comes near its target by this alone.
No step needs the documents of a source together. Equal rows are counted
before anything else and told apart again at the end.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
TILT = 0.5
SEED = 77
MAX_STEPS = 40
TOLERANCE = 1e-7
#: Documents of one size and source that are ranked together, on average.
RANKED = 4096
REPAIRS = 12
#: Exchanges: moves made together at most, copies of one document that a move takes at most, and the share of the target within which a source is left as it is. The second is tried once the first helps no more.
EXCHANGES = ((3, 1, 1e-4), (4, CAP, 5e-3))
#: Sizes nearest to what is missing, and smallest sizes, that an exchange looks at in each direction.
NEAREST, SMALLEST = 10, 6
#: Rows by source that are broadcast at most; more are joined by a shuffle.
SOURCES = 200_000
#: Newton steps between two written states.
STEPS = 3
#: Equal rows that one task tells apart at a time.
CHUNK = 4096


def running(df: DataFrame, scratch: common.Scratch, name: str, order: list, *sums: str) -> DataFrame:
    """`df` in a total order: `rank` from 0, and for each column of `sums` what rows before have together, as `<column>_before`.

    Rows are sorted by range and each partition adds up its own; only the
    totals of partitions, a row each, are then added up in one place.
    """
    at = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), name)
    at = at.withColumn("p", F.shiftright("m", 33))
    own = Window.partitionBy("p").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy("p").agg(F.count("*").alias("n_all"), *[F.sum(c).alias(f"{c}_all") for c in sums])
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("p", *[F.coalesce(F.sum(f"{c}_all").over(earlier), F.lit(0)).alias(f"{c}_all") for c in ("n", *sums)])
    within = at.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_own") for c in sums]).join(F.broadcast(offsets), "p")
    rank = F.col("n_all") + F.col("m").bitwiseAND((1 << 33) - 1)
    return within.select(*df.columns, rank.alias("rank"), *[(F.col(f"{c}_all") + F.col(f"{c}_own")).alias(f"{c}_before") for c in sums])


def targets(sizes: DataFrame, scratch: common.Scratch, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`sid`, `source`, `source_size` and `target` for each source of (source, size, m), `m` rows of that size.

    Sources in code point order, null last, weigh `weights` in turn; they
    share `share` of all sizes and stop at `cap` times their own. What that
    leaves is shared again by weight, which in the end gives every source
    min(cap * size, level * weight) for one level.
    """
    by_source = scratch.keep(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    named = running(by_source, scratch, "by-name", [F.col("source").asc_nulls_last()]).withColumn("w", weight)
    full = (F.lit(float(cap)) * F.col("source_size")).alias("full")
    ordered = named.select(F.col("rank").alias("sid"), "source", "source_size", "w", full).withColumn("ratio", F.col("full") / F.col("w"))
    filled = scratch.keep(running(ordered, scratch, "by-ratio", [F.col("ratio"), F.col("sid")], "full", "w"), "filled")
    whole = filled.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(float(whole[0] or 0) * share) - F.col("full_before")) / (F.lit(float(whole[1] or 0)) - F.col("w_before"))
    # The first source that its level does not fill up sets the level of all the rest.
    last = filled.filter(level <= F.col("ratio")).agg(F.min(F.struct("ratio", "sid", level.alias("level")))["level"]).first()[0]
    most = F.col("full") if last is None else F.least("full", F.lit(last) * F.col("w"))
    return filled.select("sid", "source", "source_size", most.alias("target"))


def _rate(cap: float):
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("z"), F.lit(50.0))))


def exchange(bins: DataFrame, goals: DataFrame, cap: int, most: int, at_once: int, near: float) -> DataFrame:
    """`sid`, `size`, `sub`, `move`: for each source that is off its target, the moves in and out, up to `most`, that leave it nearest.

    bins: (sid, size, sub, n, total), `total` copies of `n` documents of a size.
    Looked at are, in and out, the NEAREST sizes to what is missing and the
    SMALLEST; all of them where a source has fewer.
    """
    off = bins.groupBy("sid").agg(F.sum(F.col("size") * F.col("total")).alias("now")).join(goals, "sid").select("sid", (F.col("target") - F.col("now")).alias("off"), "target")
    off = off.filter(F.abs("off") > F.greatest(F.lit(1.0), F.col("target") * near)).drop("target")
    way = lambda k, v, free: F.struct((v * k).alias("v"), F.floor(free / k).cast("long").alias("free"))
    ways = F.array(*[w for k in range(1, at_once + 1) for w in (way(k, F.col("size"), F.col("n") * cap - F.col("total")), way(k, -F.col("size"), F.col("total")))])
    moves = bins.join(off, "sid").select("sid", "off", "size", "sub", F.inline(ways)).filter("free > 0").withColumn("up", F.col("v") > 0)
    by = Window.partitionBy("sid", "up")
    ranked = moves.withColumn("a", F.dense_rank().over(by.orderBy(F.abs(F.col("size") - F.abs("off")), "size", "sub"))).withColumn("b", F.dense_rank().over(by.orderBy("size", "sub")))
    none = F.array(F.struct(F.lit(0).cast("long").alias("v"), F.lit(most).cast("long").alias("free"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("sub")))
    leg = F.struct("v", F.col("free").cast("long").alias("free"), F.col("size").cast("long").alias("size"), F.col("sub").cast("long").alias("sub"))
    legs = ranked.filter((F.col("a") <= NEAREST) | (F.col("b") <= SMALLEST)).groupBy("sid", "off").agg(F.concat(none, F.sort_array(F.collect_list(leg))).alias("legs"))
    at = lambda i: F.get("legs", i)
    upto = lambda i: F.sequence(i, F.size("legs") - 1)

    def outcome(chosen):
        repeats = [F.lit(1)]
        for i, j in zip(chosen, chosen[1:]):
            repeats.append(F.when(i == j, repeats[-1] + 1).otherwise(1))
        short = reduce(lambda x, y: x | y, [at(i)["free"] < r for i, r in zip(chosen, repeats)])
        same = lambda i, j: (i != j) & (at(i)["size"] == at(j)["size"]) & (at(i)["sub"] == at(j)["sub"]) & (F.signum(at(i)["v"]) == F.signum(at(j)["v"]))
        if at_once > 1:  # a bin's copies are moved by one of its moves
            short = reduce(lambda x, y: x | y, [short, *[same(i, j) for n, i in enumerate(chosen) for j in chosen[n + 1 :]]])
        left = F.when(short, F.lit(float("inf"))).otherwise(F.abs(F.col("off") - reduce(lambda x, y: x + y, [at(i)["v"] for i in chosen])))
        return F.struct(left.alias("left"), *[i.alias(f"i{n}") for n, i in enumerate(chosen)])

    def best_of(chosen):
        if len(chosen) == most:
            return outcome(chosen)
        return F.array_min(F.transform(upto(chosen[-1] if chosen else F.lit(0)), lambda i: best_of([*chosen, i])))

    taken = legs.withColumn("best", best_of([])).filter(F.col("best.left") < F.abs("off") - 1e-6)
    each = taken.select("sid", F.inline(F.array(*[F.get("legs", F.col(f"best.i{n}")) for n in range(most)]))).filter("v <> 0")
    return each.groupBy("sid", "size", "sub").agg(F.sum(F.col("v") / F.col("size")).cast("long").alias("move"))


def solve(scratch: common.Scratch, hist: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """`sid`, `lam`: the multipliers. hist: (sid, size, n, z); goal: (sid, source_size, target)."""
    log_cap = math.log(cap)
    few = goal.count() <= SOURCES
    small = lambda df: F.broadcast(df) if few else df
    start = F.when(F.col("target") <= 0, -60.0).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = goal.filter("source_size > 0").select(
        "sid", "target", "source_size", start.alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
        ((F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12))).alias("ended"),
    ).withColumn("lam", F.when(F.col("target") <= 0, -1e6).when(F.col("ended"), 1e6).otherwise(F.least("lam", F.lit(log_cap))))
    state = scratch.keep(state, "state0")
    for step in range(1, MAX_STEPS + 1):
        words = F.col("n") * F.col("size") * _rate(cap)
        sums = (
            hist.join(small(state.filter(~F.col("ended")).select("sid", "lam")), "sid")
            .groupBy("sid")
            .agg(F.sum(words).alias("now"), F.sum(F.when(F.col("lam") * F.col("z") < log_cap, words * F.col("z")).otherwise(0.0)).alias("slope"))
        )
        off = F.col("now") - F.col("target")
        lo, hi = F.when(off < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")), F.when(off > 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo1")) & (newton < F.col("hi1"))
        middle = F.when(F.col("hi1") >= 1e6, F.greatest(F.col("lam") * 2, F.col("lam") + 1)).when(F.col("lo1") <= -1e6, F.least(F.col("lam") * 2, F.col("lam") - 1)).otherwise((F.col("lo1") + F.col("hi1")) / 2)
        state = (
            state.join(small(sums), "sid", "left")
            .withColumn("lo1", lo).withColumn("hi1", hi)
            .withColumn("done", F.col("ended") | (F.abs(off) <= F.col("target") * TOLERANCE))
            .select("sid", "target", "source_size", F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), F.coalesce("lo1", "lo").alias("lo"), F.coalesce("hi1", "hi").alias("hi"), F.col("done").alias("ended"))
        )
        if step % STEPS == 0 or step == MAX_STEPS:
            state = scratch.keep(state, f"state{step}")
            if state.filter(~F.col("ended")).isEmpty():
                break
    return state.select("sid", "lam")


def mix(docs: DataFrame, scratch: common.Scratch, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id`, `size`, `source_size`, `target`, `copies` for each row of `docs`, and its `keys`.

    Size is the number of words (null text: 0), of very long texts too. Null
    sources form one source. Documents without words get no copies. Documents
    of one size and source are in order of a hash of id and text, so ties of
    ids do not matter; equal rows are rounded one by one. An empty table gives
    an empty result. Other columns are ignored.
    """
    own = ["doc_id", *keys]
    light = docs.select(*own, F.col("source").cast("string").alias("source"), common.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text", F.col("doc_id").isNull()).alias("h"))
    light = scratch.keep(light.groupBy(*own, "source", "size", "h").agg(F.count("*").alias("m")), "light")
    goal = scratch.keep(targets(light.select("source", "size", "m"), scratch, weights, share, cap), "goal")
    known = light.join(goal.select("sid", F.col("source").alias("source_"), "source_size", "target"), F.col("source").eqNullSafe(F.col("source_"))).select(*own, "size", "h", "m", "sid", "source_size", "target")

    mean = goal.join(known.groupBy("sid").agg((F.sum(F.col("size") * F.col("m")) / F.sum("m")).alias("mean")), "sid").select("sid", "mean")
    z = F.pow(F.col("size") / F.col("mean"), F.lit(TILT))
    hist = scratch.keep(known.filter("size > 0").groupBy("sid", "size").agg(F.sum("m").alias("n")).join(mean, "sid").withColumn("z", z).drop("mean"), "hist")
    lam = solve(scratch, hist, goal, cap)

    # Copies by (source, size, hash range): the whole part of the rate for all, one more for `extra` of the documents.
    rated = hist.join(lam, "sid").withColumn("rate", _rate(cap))
    parts = F.ceil(F.col("n") / RANKED)
    rated = scratch.keep(rated.select("sid", "size", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("part"), parts.alias("parts")), "rated")
    split = known.filter("size > 0").join(rated, ["sid", "size"]).withColumn("sub", F.floor(common.unit(F.xxhash64(F.lit(seed + 1), "h")) * F.col("parts")).cast("long"))
    bins = split.groupBy("sid", "size", "sub").agg(F.sum("m").alias("n"), F.first("base").alias("base"), F.first("part").alias("part"))
    run = Window.partitionBy("sid").orderBy("size", "sub")  # a row per bin of about RANKED documents or one size
    upto = F.sum(F.col("n") * F.col("part")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    count = lambda x: F.floor(x + 0.5)
    ended = F.least(F.greatest(count(F.col("upto")) - count(F.coalesce(F.lag("upto").over(run), F.lit(0.0))), F.lit(0)), F.col("n"))
    total = F.col("n") * F.col("base") + ended.cast("long")
    bins = scratch.keep(bins.withColumn("upto", upto).withColumn("total", total).select("sid", "size", "sub", "n", "total"), "bins0")

    goals = goal.select("sid", "target")
    level = 0
    for step in range(1, REPAIRS + 1):
        moved = scratch.keep(exchange(bins, goals, cap, *EXCHANGES[level]), f"moved{step}")
        if moved.isEmpty():
            level += 1
            if level == len(EXCHANGES):
                break
            continue
        bins = scratch.keep(bins.join(moved, ["sid", "size", "sub"], "left").withColumn("total", F.col("total") + F.coalesce("move", F.lit(0))).drop("move"), f"bins{step}")
    bins = bins.withColumn("base", F.floor(F.col("total") / F.col("n")).cast("int")).withColumn("extra", F.col("total") % F.col("n"))

    order = Window.partitionBy("sid", "size", "sub").orderBy("h", *own).rowsBetween(Window.unboundedPreceding, -1)
    chosen = split.select(*own, "size", "h", "m", "sid", "sub", "source_size", "target").withColumn("ahead", F.coalesce(F.sum("m").over(order), F.lit(0))).join(bins.select("sid", "size", "sub", "base", "extra"), ["sid", "size", "sub"])
    more = F.least(F.greatest(F.col("extra") - F.col("ahead"), F.lit(0)), F.col("m")).alias("more")  # of the m equal rows, so many get a copy more
    result = chosen.select(*own, "size", "source_size", "target", "m", "base", more).unionByName(known.filter("size = 0").select(*own, "size", "source_size", "target", "m", F.lit(0).alias("base"), F.lit(0).cast("long").alias("more")))
    shown = [*own, "size", "source_size", "target"]
    if light.filter("m > 1").isEmpty():
        return result.select(*shown, (F.col("base") + F.col("more")).cast("int").alias("copies"))
    number = lambda a, b, name: F.explode(F.sequence(a, b)).alias(name)
    again = result.filter("m > 1").select(*shown, "m", "base", "more", number(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK), "chunk")).repartition(*own, "chunk")
    first = F.col("chunk") * CHUNK
    again = again.select(*shown, "base", "more", number(first, F.least(first + CHUNK, F.col("m")) - 1, "i")).select(*shown, (F.col("base") + (F.col("i") < F.col("more")).cast("int")).cast("int").alias("copies"))
    return result.filter("m = 1").select(*shown, (F.col("base") + F.col("more")).cast("int").alias("copies")).unionByName(again)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix takes from each."""
    mixed = mix(common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op3"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
