"""Near-duplicate embeddings by int8 tile products with rigorous bounds.

Equal vectors are one node. Unit vectors at a cosine of c or more are at most
sqrt(2 - 2c) apart, and so are their projections. Of the leading directions of
a sample, those along which vectors spread over several times that width cut
the space into a grid, of which only neighbouring cells are compared; where no
direction does (vectors that point everywhere alike), there is one cell, and
all pairs are compared. Any choice of directions is exact. Cells are cut into
blocks of up to BLOCK vectors, and a task has a pair of blocks, which it goes
through in tiles of TILE by TILE: there the vectors, quantised to int8 with
one scale each, are multiplied. With x = x' + e the error of a product is at
most |x'||f| + |y'||e| + |e||f|, so most pairs are settled by their quantised
product; only those that it leaves open are computed again in double precision.

A task gives each vector's number of links and a spanning forest of its
links, so what leaves it grows with its vectors, not with its pairs. A vector
is sent once for each block of its cell and the neighbouring ones, n / BLOCK
times if there is one cell: products grow as n^2, rows as n^2 / BLOCK.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

COSINE = 0.9
#: Vectors of a block at most and at least (fewer make more tasks), blocks that a large cell should have, and rows of a product.
BLOCK, LEAST, BLOCKS, TILE = 1 << 14, 2048, 6, 2048
#: Directions of the grid at most, the widths that vectors have to spread over along one, and the vectors (in hash order) that
#: they are fitted on; they only choose the grid.
AXES, SPREAD, FIT_ROWS = 4, 4.0, 4096
#: Slack for rounding in sums of doubles.
SLACK = 1e-9


def usable(vector: str):
    """Not null, not empty or zero, and without null or non-finite components."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest component is scaled to 1 first, so that no square is too large or too small."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of codes * scale, bound of the error's norm) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    about = codes * scale[:, None]
    return codes, scale, np.sqrt((about**2).sum(axis=1)), np.sqrt(((x - about) ** 2).sum(axis=1)) + 1e-12


def tile(x: np.ndarray, y: np.ndarray | None, cosine: float, step: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) at `cosine` or more of the rows of x and y; y None: of x with itself, i < j."""
    own = y is None
    x = units(x)
    y = x if own else units(y)
    qx = quantise(x)
    qy = qx if own else quantise(y)
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers that the type holds exactly
    for a in range(0, len(x), step):
        cx, sx, hx, ex = (v[a : a + step] for v in qx)
        left = cx.astype(kind)
        for b in range(a if own else 0, len(y), step):
            cy, sy, hy, ey = (v[b : b + step] for v in qy)
            about = (left @ cy.astype(kind).T).astype(np.float64)
            about *= sx[:, None]
            about *= sy[None, :]
            off = hx[:, None] * ey[None, :] + ex[:, None] * (hy + ey)[None, :] + SLACK
            i, j = np.nonzero(about + off >= cosine)
            if own and a == b:
                i, j = i[up := i < j], j[up]
            sure = about[i, j] - off[i, j] >= cosine
            i, j = i + a, j + b
            for at in range(0, len(i), 1 << 16):
                p, q, known = i[at : at + (1 << 16)], j[at : at + (1 << 16)], sure[at : at + (1 << 16)]
                open_ = np.flatnonzero(~known)
                known[open_] = np.einsum("ij,ij->i", x[p[open_]], y[q[open_]]) >= cosine
            if sure.any():
                yield i[sure], j[sure]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the smallest node that the links (a, b) lead to."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        after = up.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == up).all():
            return up
        up = after


def directions(nodes: DataFrame, width: float) -> dict[int, np.ndarray]:
    """The leading directions of each vector length along which vectors of a bounded sample spread over SPREAD widths or more."""
    rows = nodes.select("vector").orderBy(F.xxhash64("vector")).limit(FIT_ROWS).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.vector), []).append(r.vector)
    out = {}
    for d, vs in by.items():
        x = units(np.array(vs, float))
        ways = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and d > 1 else np.eye(d))[1][:, ::-1][:, :AXES]
        low, high = np.quantile(x @ ways, (0.05, 0.95), axis=0)
        out[d] = ways[:, high - low >= SPREAD * width]
    return out


def links(nodes: DataFrame, scratch: common.Scratch, cosine: float = COSINE, block: int = BLOCK, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(id, n) and (a, b): each node's number of links, counting equal vectors, and spanning links. nodes: (id, copies, vector)."""
    width = math.sqrt(max(2 - 2 * cosine, 0)) + 1e-6
    axes = directions(nodes, width)
    wide = max([0, *(w.shape[1] for w in axes.values())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column(2):
                x = np.array(v.as_py(), float)
                way = axes.get(len(x))
                at = np.floor(units(x[None, :])[0] @ way / width).astype(int).tolist() if way is not None else []
                cells.append([len(x), *at, *[0] * (wide - len(at))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], ["id", "copies", "vector", "cell"])

    placed = scratch.keep(nodes.select("id", "copies", "vector").mapInArrow(place, "id long, copies long, vector array<double>, cell array<long>"), "placed")
    in_block = F.least(F.greatest(F.count("*") / BLOCKS, F.lit(least)), F.lit(block))
    cells = scratch.keep(placed.groupBy("cell").agg(F.ceil(F.count("*") / in_block).cast("int").alias("blocks")), "cells")
    steps = [[]]
    for _ in range(wide):
        steps = [[*s, k] for s in steps for k in (-1, 0, 1)]
    near = [s for s in steps if s >= [0] * wide]  # each pair of neighbours once
    moved = F.array(*[F.array(F.get("cell", F.lit(0)), *[F.get("cell", F.lit(i + 1)) + k for i, k in enumerate(s)]) for s in near])
    pairs = cells.select("cell", "blocks", F.explode(moved).alias("other")).join(cells.select(F.col("cell").alias("other"), F.col("blocks").alias("more")), "other")
    tiles = (
        pairs.select("cell", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), "more")
        .select("cell", "other", "p", F.explode(F.sequence(F.lit(0), F.col("more") - 1)).alias("q"))
        .filter((F.col("cell") != F.col("other")) | (F.col("p") <= F.col("q")))
        .withColumn("tile", F.xxhash64("cell", "other", "p", "q"))
    )
    tiles = scratch.keep(tiles, "tiles")
    sides = tiles.select("tile", F.when((F.col("cell") == F.col("other")) & (F.col("p") == F.col("q")), 2).otherwise(0).alias("side"), "cell", F.col("p").alias("blk")).unionByName(
        tiles.filter((F.col("cell") != F.col("other")) | (F.col("p") != F.col("q"))).select("tile", F.lit(1).alias("side"), F.col("other").alias("cell"), F.col("q").alias("blk"))
    )
    dealt = placed.join(cells, "cell").withColumn("blk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks").cast("long")).cast("int")).drop("blocks")

    def run(table: pa.Table) -> pa.Table:
        side, ids, copies = (table.column(k).to_numpy() for k in ("side", "id", "copies"))
        flat = table.column("vector").combine_chunks()
        x = flat.flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(side, kind="stable")
        ids, copies, x, cut, own = ids[order], copies[order], x[order], int((side != 1).sum()), bool((side == 2).any())
        n, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in tile(x, None, cosine) if own else tile(x[:cut], x[cut:], cosine) if 0 < cut < len(ids) else ():  # a block can be empty
            j = j if own else j + cut
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            up = forest(np.concatenate((i, np.arange(len(ids)))), np.concatenate((j, up)), len(ids))
        some = np.flatnonzero(n)
        return pa.table({"id": ids[some], "n": n[some], "up": ids[up[some]]})

    found = dealt.join(sides, ["cell", "blk"]).select("tile", "side", "id", "copies", "vector").groupBy("tile").applyInArrow(run, "id long, n long, up long")
    found = scratch.keep(found, "found")
    return found.groupBy("id").agg(F.sum("n").alias("n")), found.filter("id <> up").select(F.col("id").alias("a"), F.col("up").alias("b")).distinct()


def near_vectors(vectors: DataFrame, scratch: common.Scratch, cosine: float = COSINE, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of `vectors` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows with a null vec_id, link with nothing. Vectors of
    different lengths never link. Rows that repeat a vec_id count as vectors of
    their own, which share it as a name; a component is named after its
    smallest vec_id. Finite components may be of any size. An empty table
    gives an empty result. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    good = scratch.keep(rows.filter(usable("vector") & F.col("vec_id").isNotNull()), "good")
    nodes = scratch.keep(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "nodes")
    number, pairs = links(nodes, scratch, cosine, block, least)
    whole = components(scratch, pairs)
    known = (
        nodes.join(number, "id", "left").join(whole, "id", "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = good.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable("vector") | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    found = near_vectors(common.read(spark, sf_dir, "embeddings"), common.Scratch(spark, "op7"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
