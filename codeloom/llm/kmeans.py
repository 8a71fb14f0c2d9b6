"""Centroid clustering of integer vectors with Elkan's bounds.

Vectors are packed into blocks of up to BLOCK, a row each, together with what
is cached for them: the assigned centroid, an upper bound of the distance to
it, and a lower bound of the distance to each of the k centroids. A round
moves the bounds by how far the centroids went (upper bounds are rounded up,
lower ones down) and works out a distance only where a lower bound, and half
the distance between centroids, do not exceed the upper bound. Only strict
excess prunes, so a centroid at an equal distance is always compared, and
those comparisons are of exact integers.

The state of a round is written to the shared folder before the next one, so
a lost executor costs its own tasks. Only sums by cluster and component leave
the tasks. Components beyond WIDE in size, which 64-bit arithmetic can't
multiply safely, are handled as Python integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, ROUNDS, WIDTH, SCALE, SALT = 40, 5, 64, 256, 2
#: Vectors of a block at most, and pairs of vector and centroid worked out together.
BLOCK, PAIRS = 4096, 1 << 16
#: Components up to this size: differences squared and summed over 64 components stay within 64 bits.
WIDE = 1 << 27
#: Bits of a limb, as which sums of wide components are added up.
LIMB = 40
LONGEST = (1 << 63) - 1
#: Relative slack of bounds in double precision.
SLACK = 1e-12

STATE = "ids binary, known binary, wide boolean, vectors binary, at binary, upper binary, lower binary"
SUMS = "cluster int, place int, total long"


def pack(x: np.ndarray, wide: bool) -> bytes:
    return "\n".join(",".join(map(str, row)) for row in x).encode() if wide else x.astype(np.int32).tobytes()


def unpack(raw: bytes, wide: bool, width: int = WIDTH) -> np.ndarray:
    if wide:
        return np.array([[int(v) for v in line.split(",")] for line in raw.decode().split("\n")], dtype=object).reshape(-1, width)
    return np.frombuffer(raw, np.int32).reshape(-1, width).astype(np.int64)


def is_wide(x: np.ndarray) -> bool:
    return x.dtype == object or bool(x.size and (np.abs(x) > WIDE).any())


def squared(x: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs (x[rows], c[cols]); an object array where a side is wide."""
    if x.dtype == object or c.dtype == object:
        out = np.empty(len(rows), dtype=object)
        for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist())):
            out[k] = sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], c[j]))
        return out
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), PAIRS):
        d = x[rows[at : at + PAIRS]] - c[cols[at : at + PAIRS]]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def roots(d: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of exact squares, none below the true root if `up`, else none above it."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64)) * (1 + SLACK if up else 1 - SLACK)
    whole = [math.isqrt(v) + up for v in d]
    most = 1 << 1000  # as a double; a larger root has no upper bound, and this as a lower one
    return np.array([math.inf if up and v > most else float(min(v, most)) * (1 + SLACK if up else 1 - SLACK) for v in whole])


class Centroids:
    """Centroids with the bounds that a round needs; `moved` has an upper bound of how far each went since the round before."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        wide = any(abs(v) > WIDE for row in rows for v in row)
        self.rows = rows
        self.at = np.array(rows, dtype=object if wide else np.int64).reshape(len(rows), -1)
        k = len(rows)
        i, j = (v.ravel() for v in np.indices((k, k)))
        self.apart = roots(squared(self.at, self.at, i, j), up=False).reshape(k, k) / 2
        self.nearest = np.where(np.eye(k, dtype=bool), math.inf, self.apart).min(axis=1)
        if before is not None:
            old = np.array(before, dtype=object if wide or any(abs(v) > WIDE for row in before for v in row) else np.int64)
            self.moved = roots(squared(self.at, old, np.arange(k), np.arange(k)), up=True)


def assign(x: np.ndarray, c: Centroids, at: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, upper bound, lower bounds) of each vector; `at` None: a first round, without bounds."""
    n, k = len(x), len(c.rows)
    if at is None:
        at, upper, lower = np.zeros(n, np.int32), np.full(n, math.inf), np.zeros((n, k))
    else:
        lower = np.maximum((lower - c.moved[None, :]) * np.where(lower > c.moved[None, :], 1 - SLACK, 1), 0)
        upper = (upper + c.moved[at]) * (1 + SLACK)
    open_ = np.flatnonzero(~(upper < c.nearest[at]))
    if not len(open_):
        return at, upper, lower
    own = squared(x, c.at, open_, at[open_])  # bounds are tight from here on
    upper = upper.copy()
    upper[open_], lower[open_, at[open_]] = roots(own, up=True), roots(own, up=False)
    reach = upper[open_, None]
    near = ~(reach < lower[open_]) & ~(reach < c.apart[at[open_]])
    near[np.arange(len(open_)), at[open_]] = False
    place, cols = np.nonzero(near)
    if len(place):
        d = squared(x, c.at, open_[place], cols)
        lower[open_[place], cols] = roots(d, up=False)
        # Of each vector the smallest (distance, centroid), its own included.
        place, cols, d = np.concatenate([place, np.arange(len(open_))]), np.concatenate([cols, at[open_]]), np.concatenate([d, own])
        order = np.lexsort((cols, d, place)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda t: (place[t], d[t], cols[t])))
        first = order[np.r_[True, place[order][1:] != place[order][:-1]]]
        at = at.copy()
        at[open_] = cols[first]
        upper[open_] = roots(d[first], up=True)
    return at, upper, lower


def kept(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, x) of vectors with `width` components, none null or non-finite; components as doubles."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(F.coalesce(x.isNotNull() & (F.size(x) == width) & ~odd, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: a power of two scales a double without rounding, unless it overflows."""
    if not x.size or np.abs(x).max() <= WIDE / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[(n * SCALE) // d for n, d in (float(v).as_integer_ratio() for v in row)] for row in x], dtype=object).reshape(x.shape)


def blocks(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of STATE for (vec_id, x), without bounds yet."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            known = np.array(ids.is_valid())
            ids = np.array(ids.fill_null(0), np.int64)
            far = (np.abs(x) > WIDE / SCALE).any(axis=1)
            for wide in (False, True):
                rows = np.flatnonzero(far == wide)
                for a in range(0, len(rows), BLOCK):
                    part = rows[a : a + BLOCK]
                    yield _state(ids[part].tobytes(), known[part].tobytes(), wide, pack(integers(x[part]), wide))

    return vectors.mapInArrow(packed, STATE)


def _state(ids, known, wide, vectors, at=b"", upper=b"", lower=b"") -> pa.RecordBatch:
    names = [part.split()[0] for part in STATE.split(", ")]
    cells = [[ids], [known], [wide], [vectors], [at], [upper], [lower]]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if n == "wide" else pa.binary()) for n, v in zip(names, cells)], names=names)


def _blocks_of(batch: pa.RecordBatch, width: int):
    for r in range(batch.num_rows):
        ids, known, wide, vectors, at, upper, lower = (c[r].as_py() for c in batch.columns)
        yield ids, known, wide, vectors, unpack(vectors, wide, width), at, upper, lower


def _assigned(c: Centroids, wide, x, at, upper, lower):
    if not at:
        return assign(x, c, None, None, None)
    return assign(x, c, np.frombuffer(at, np.int32), np.frombuffer(upper, np.float64), np.frombuffer(lower, np.float32).reshape(len(x), -1).astype(np.float64))


def step(state: DataFrame, c: Centroids, width: int = WIDTH) -> DataFrame:
    """`state` after one more assignment. Lower bounds are kept in single precision, rounded down."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, wide, raw, x, at, upper, lower in _blocks_of(batch, width):
                at, upper, lower = _assigned(c, wide, x, at, upper, lower)
                short = np.minimum(lower, np.finfo(np.float32).max).astype(np.float32)
                short = np.where(short > lower, np.nextafter(short, np.float32(0)), short).astype(np.float32)
                yield _state(ids, known, wide, raw, at.astype(np.int32).tobytes(), upper.tobytes(), short.tobytes())

    return state.mapInArrow(moved, STATE)


def sums(state: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """SUMS rows of each task: place -1 has the count of a cluster, place limb * width + component a sum."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, _, _, _, x, at, _, _ in _blocks_of(batch, width):
                at = np.frombuffer(at, np.int32)
                for j in np.unique(at).tolist():
                    mine = x[at == j]
                    whole[j, -1] = whole.get((j, -1), 0) + len(mine)
                    for place, v in enumerate(mine.sum(axis=0).tolist()):
                        whole[j, place] = whole.get((j, place), 0) + v
        rows = []
        for (j, place), v in whole.items():
            if abs(v) < LONGEST >> 1 or place < 0:
                rows.append((j, place, v))
                continue
            sign, v, limb = (1 if v > 0 else -1), abs(v), 0
            while v:
                rows.append((j, limb * width + place, sign * (v & ((1 << LIMB) - 1))))
                v, limb = v >> LIMB, limb + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "total"])

    return state.mapInArrow(added, SUMS)


def means(rows, before: list[list[int]], width: int = WIDTH) -> list[list[int]]:
    """floor(sum / count) by component from summed (cluster, place, total) rows; an empty cluster stays where it was."""
    count: dict[int, int] = {}
    total = [[0] * width for _ in before]
    for j, place, v in rows:
        if place < 0:
            count[j] = int(v)
        else:
            total[j][place % width] += int(v) << (LIMB * (place // width))
    return [[v // count[j] for v in total[j]] if count.get(j) else list(before[j]) for j in range(len(before))]


def seeds(vectors: DataFrame, k: int = K, salt: int = SALT) -> list[list[int]]:
    """The vectors of the k smallest hashes of `salt:<vec_id>`, as integers; rows without an id come last, equal hashes by components."""
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    rows = named.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).select("x").collect()
    return [integers(np.array([r.x], float))[0].tolist() for r in rows]


def cluster(df: DataFrame, scratch: common.Scratch, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, salt: int = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of (vec_id, embedding).

    Vectors that are null, of another length, or hold null or non-finite
    components give no row. Repeated rows count, and are returned, one by
    one; a row without vec_id is clustered like others, and is a seed only
    where others do not suffice. With fewer than k vectors there are as many
    centroids; an empty table gives an empty result. Distances and inertias
    that do not fit a long are given as the largest long. Other columns are
    ignored, whatever their names.
    """
    vectors = kept(df.select("vec_id", "embedding"), width)
    start = seeds(vectors, k, salt)
    state = scratch.keep(blocks(vectors, width), "state0")
    c = Centroids(start) if start else None
    for n in range(1, rounds + 2 if start else 1):
        state = scratch.keep(step(state, c, width), f"state{n}")
        scratch.drop(f"state{n - 1}")
        if n <= rounds:
            by = sums(state, k, width).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
            c = Centroids(means(by.collect(), c.rows, width), c.rows)  # k * width rows, and limbs of wide ones

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, _, _, x, at, _, _ in _blocks_of(batch, width):
                at = np.frombuffer(at, np.int32)
                d = squared(x, c.at, np.arange(len(x)), at)
                short = np.array([min(v, LONGEST) for v in d.tolist()], np.int64)
                own = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool))
                yield pa.RecordBatch.from_arrays([own, pa.array(at), pa.array(short)], names=["vec_id", "cluster", "distance"])

    found = scratch.keep(state.mapInArrow(distances, "vec_id long, cluster int, distance long"), "found")
    capped = lambda v: F.least(v, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row per centroid
    whole = sum(int(r.own) for r in totals)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in (c.rows if c else [])]
    table = [(r.cluster, r.own, min(whole, LONGEST), digest[r.cluster]) for r in totals]
    named = df.sparkSession.createDataFrame(table, "cluster int, own decimal(38,0), inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", capped(F.col("own")).alias("cluster_inertia"), "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings in 40 clusters, after five rounds from hashed seeds."""
    return cluster(common.read(spark, sf_dir, "embeddings"), common.Scratch(spark, "op13"))


def _round(n: int) -> str:
    """SQL of assignment n and, for 1 to ROUNDS, of the centroids that follow from it."""
    nearest = f"""a{n} as materialized (
  select rid, arg_min(c.cluster, {{'d': d, 'c': c.cluster}}) as cluster, min(d) as distance from (
    select v.rid, c.cluster, cast(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v cross join c{n - 1} c) c group by rid)"""
    if n > ROUNDS:
        return nearest
    return nearest + f""",
s{n} as (select a.cluster, i, sum(x[i]) as total, count(*) as n from a{n} a join v using (rid), unnest(range(1, {WIDTH + 1})) as t(i) group by 1, 2),
m{n} as (select cluster, list(cast(case when total % n < 0 then total // n - 1 else total // n end as bigint) order by i) as x from s{n} group by 1),
c{n} as materialized (select c.cluster, coalesce(m{n}.x, c.x) as x from c{n - 1} c left join m{n} using (cluster))"""


OP13_SQL = f"""
with v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda y: cast(floor({SCALE} * y::double) as bigint)) as x from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
c0 as materialized (select cast(row_number() over (order by sha256('{SALT}:' || vec_id)) - 1 as integer) as cluster, x from v order by sha256('{SALT}:' || vec_id) limit {K}),
{','.join(_round(n) for n in range(1, ROUNDS + 2))}
select v.vec_id, a.cluster, a.distance, cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.distance) over () as bigint) as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{ROUNDS + 1} a join v using (rid) join c{ROUNDS} c using (cluster)
"""
