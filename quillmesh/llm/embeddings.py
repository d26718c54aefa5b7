"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine >= 0.9 lie within a squared distance of 0.2. An orthogonal rotation (the principal axes of all
vectors) keeps distances; it is cut into blocks of low dimension, and each block gets a share of the 0.2 in proportion
to its part of the total variance. A linked pair keeps within the share of at least one block, so the union of the
blocks' range joins misses none. A block's space is cut into cells across all its coordinates; a row belongs to one cell
and visits the later ones that its radius reaches. Candidates are verified at once on the whole vectors in double
precision, only in the first block that finds them, so every pair is counted once.

How much cells prune depends on the vectors. The width of blocks is the one of WIDTHS that compares the fewest pairs of
a bounded sample; where vectors point in all directions alike no width prunes much, and few wide blocks cost least.

Equal vectors form one class with one representative. Cells are tiled, so that no task holds more than two tiles
whatever the skew; a tile pair returns its rows' numbers of links and a spanning forest of its links, never the pairs.

Null vectors, empty or zero vectors and vectors with null or non-finite components link with nothing. Vectors of
different length do not link. A null vec_id keeps its row, linked with nothing, component_id null, kept. Rows that
repeat a vec_id are one node if their vectors are equal; other columns are ignored. No vectors, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, settled, skew_join
from .components import components

COSINE = 0.9
#: Axes of a block, to choose from.
WIDTHS = (4, 8, 16, 32)
#: Vectors that decide the width and where cells are cut; a cell has at least LEAF of them.
SAMPLE, LEAF = 20_000, 8
#: Rows of a tile: two of them, with their vectors, are what one task holds at a time. Every row is sent to every tile
#: that it may meet: tiles grow with the rows from the first size to the second, so that up to TILES * TILE_MOST rows what
#: is sent grows as the rows do.
TILE, TILE_MOST, TILES = 8_192, 98_304, 16
#: Added to every budget against rounding; verification is exact.
SLACK = 1e-6
ROWS = 4096
#: Rows compared by one matrix product, and candidate pairs checked at a time.
CHUNK, PAIRS = 1024, 32_768


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of x x' over all unit vectors; each task sends dim * dim numbers, which are summed before they are collected."""

    def work(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(matrix(batch.column(0), dim))
            total += x.T @ x
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel(), pa.float64())], names=["at", "v"])

    rows = vectors.select("vector").mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(dim * dim)
    for r in rows:
        total[r["at"]] = r["v"]
    return total.reshape(dim, dim)


def matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: a tiny or huge vector must not lose its direction when squared.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Blocks:
    """The rotation, its blocks of `block` axes and their budgets."""

    def __init__(self, moments: np.ndarray, cosine: float, block: int) -> None:
        values, axes = np.linalg.eigh(moments)
        order = np.argsort(values)[::-1]
        values, self.axes = np.maximum(values[order], 0), np.ascontiguousarray(axes[:, order])
        dim, n = len(values), max(1, -(-len(values) // block))
        # Dealt like cards, so that every block leads with a wide axis.
        self.parts = [np.arange(b, dim, n) for b in range(n)]
        spread = np.array([values[p].sum() for p in self.parts])
        share = spread / spread.sum() if spread.sum() > 0 else np.full(n, 1 / n)
        # No block is left without a budget: a tenth is shared equally.
        self.budget = 2 * (1 - cosine) * (0.9 * share + 0.1 / n) + SLACK
        self.cells: list[Cells] = []

    def rotate(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.axes
        return [np.ascontiguousarray(y[:, p]) for p in self.parts]

    def fit(self, sample: np.ndarray, leaf: int) -> float:
        """Cells of every block from a sample; returns how many pairs they compare, as a multiple of all pairs."""
        parts = self.rotate(sample)
        self.cells = [Cells(part, leaf) for part in parts]
        return sum(cells.compared(part, budget) for cells, part, budget in zip(self.cells, parts, self.budget, strict=True))


class Cells:
    """A block's space cut into boxes by halving, each time across the coordinate in which a sample spreads most."""

    def __init__(self, sample: np.ndarray, leaf: int) -> None:
        dim = sample.shape[1]
        self.low, self.high = [], []

        def halve(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            axis = int(np.argmax(rows.var(axis=0))) if len(rows) > leaf else 0
            at = float(np.median(rows[:, axis])) if len(rows) > leaf else 0.0
            right = rows[:, axis] >= at if len(rows) > leaf else np.zeros(0, bool)
            if len(rows) <= leaf or right.all() or not right.any():
                self.low.append(low)
                self.high.append(high)
                return
            middle = high.copy()
            middle[axis] = at
            halve(rows[~right], low, middle)
            middle = low.copy()
            middle[axis] = at
            halve(rows[right], middle, high)

        halve(sample, np.full(dim, -np.inf), np.full(dim, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def reach(self, part: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(home, near): every row's own cell, and which cells (columns) its ball of the budget touches."""
        gap = np.zeros((len(part), len(self.low)))
        for k in range(part.shape[1]):
            x = part[:, k, None]
            gap += np.maximum(np.maximum(self.low[:, k] - x, x - self.high[:, k]), 0) ** 2
        inside = np.ones(gap.shape, bool)
        for k in range(part.shape[1]):
            inside &= (part[:, k, None] >= self.low[:, k]) & (part[:, k, None] < self.high[:, k])
        return inside.argmax(axis=1), gap <= budget

    def compared(self, part: np.ndarray, budget: float) -> float:
        home, near = self.reach(part[:ROWS], budget)
        size = np.bincount(home, minlength=len(self.low)) / len(home)
        return float((near * size).sum(axis=1).mean())


def within(part: np.ndarray, i: np.ndarray, j: np.ndarray, budget: float) -> np.ndarray:
    """The block test proper; every task that asks about a pair gets the same answer."""
    return np.concatenate([((part[i[k : k + PAIRS]] - part[j[k : k + PAIRS]]) ** 2).sum(axis=1) <= budget for k in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])


def tile_links(size: np.ndarray, x: np.ndarray, side: np.ndarray, visit: bool, block: int, blocks: Blocks, cosine: float):
    """Links of one tile pair: the number of linked vectors of each row, and each row's component within the pair.

    side 0 and 1 are the two tiles; a cell's tile paired with itself has side 0 only.
    """
    parts = blocks.rotate(x)
    own = parts[block].astype("f4")
    half = (own * own).sum(axis=1, keepdims=True) / 2
    # p q - p p / 2 - q q / 2 is minus half the squared distance.
    one = np.ones_like(half)
    rows_, cols_ = np.hstack([own, -half, one]), np.hstack([own, one, -half])
    least = np.float32(-blocks.budget[block] / 2 - 1e-5)
    links, label = np.zeros(len(x), "i8"), np.arange(len(x))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if visit or (side == 1).any() else left
    for start in range(0, len(left), CHUNK):
        rows = left[start : start + CHUNK]
        for begin in range(start if right is left else 0, len(right), CHUNK):
            cols = right[begin : begin + CHUNK]
            i, j = np.nonzero(rows_[rows] @ cols_[cols].T >= least)
            if right is left and begin == start:
                i, j = i[i < j], j[i < j]
            i, j = rows[i], cols[j]
            for b in range(block + 1):
                hit = within(parts[b], i, j, blocks.budget[b])
                hit = hit if b == block else ~hit
                i, j = i[hit], j[hit]
            good = [(x[i[k : k + PAIRS]] * x[j[k : k + PAIRS]]).sum(axis=1) >= cosine for k in range(0, len(i), PAIRS)]
            if not good:
                continue
            good = np.concatenate(good)
            i, j = i[good], j[good]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            while (apart := label[i] != label[j]).any():
                a, b = label[i[apart]], label[j[apart]]
                root = np.arange(len(x))
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
                label = root[label]
    return links, label


def sampled(classes: DataFrame, dim: int) -> np.ndarray:
    """SAMPLE unit vectors at most, those of the smallest hashes: they decide where cells are cut, never what is found."""
    rows = classes.orderBy(F.xxhash64("cid", F.lit("sample"))).limit(SAMPLE).select("vector").collect()
    return unit(np.array([r[0] for r in rows], "f8").reshape(-1, dim))


def tile_rows(n: int) -> int:
    return min(max(TILE, n // TILES), max(TILE, TILE_MOST))


def planned(classes: DataFrame, dim: int, cosine: float, block: int | None, n: int) -> Blocks:
    """Blocks of the given width, or of that among WIDTHS which compares the fewest pairs of the sample of n classes."""
    moments, sample = second_moments(classes, dim), sampled(classes, dim)
    leaf = max(LEAF, len(sample) * tile_rows(n) // max(n, 1))
    plans = []
    for width in [block] if block else sorted({min(w, dim) for w in WIDTHS}):
        blocks = Blocks(moments, cosine, width)
        plans.append((round(blocks.fit(sample, leaf), 3), width, blocks))
    return min(plans, key=lambda p: p[:2])[2]


def joined(classes: DataFrame, dim: int, cosine: float, block: int | None) -> DataFrame:
    """(cid, twin, links, rep, other): partial numbers of links of classes, and edges rep - other."""
    n = classes.count()
    blocks, rows = planned(classes, dim, cosine, block, n), tile_rows(n)
    names = ["cid", "twin", "rep", "size", "vector"]

    def place(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                for b, part in enumerate(blocks.rotate(unit(matrix(batch.column(4), dim)))):
                    home, near = blocks.cells[b].reach(part, blocks.budget[b])
                    # Two rows meet in the later one's cell: as its own, or where the other visits.
                    near &= np.arange(near.shape[1]) > home[:, None]
                    visitor, cell = np.nonzero(near)
                    at = np.concatenate([np.arange(len(home)), visitor])
                    cell, guest = np.concatenate([home, cell]), np.arange(len(at)) >= len(home)
                    for k in range(0, len(at), ROWS):
                        some, m = batch.take(pa.array(at[k : k + ROWS])), len(at[k : k + ROWS])
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(m, b), pa.int32()), pa.array(cell[k : k + m], pa.int32()), pa.array(guest[k : k + m])], names=[*names, "block", "cell", "guest"])

    kind = "cid long, twin long, rep long, size long, vector " + classes.schema["vector"].dataType.simpleString()
    placed = classes.select(*names).mapInArrow(place, f"{kind}, block int, cell int, guest boolean")
    # As many rows as there are cells, which SAMPLE bounds: it can be broadcast.
    count = lambda guest: F.ceil(F.count(F.when(F.col("guest") == guest, 1)) / F.lit(rows)).cast("int")
    tiles = cut(placed.groupBy("block", "cell").agg(count(False).alias("own"), count(True).alias("others")), "tiles")
    mine = F.when(F.col("guest"), F.col("others")).otherwise(F.col("own"))
    placed = placed.join(F.broadcast(tiles), ["block", "cell"]).withColumn("tile", F.pmod(F.xxhash64("cid"), mine).cast("int"))
    upto = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda v: v < n), f)
    task = lambda i, j, visit, side: F.struct(i.alias("i"), j.alias("j"), F.lit(visit).alias("visit"), side.alias("side"))
    tile, zero, one = F.col("tile"), F.lit(0), F.lit(1)
    at_home = F.concat(
        upto(F.col("own"), lambda v: task(F.least(v, tile), F.greatest(v, tile), False, F.when(v < tile, 1).otherwise(0))),
        upto(F.col("others"), lambda v: task(tile, v, True, zero)),
    )
    tasks = F.when(F.col("guest"), upto(F.col("own"), lambda v: task(v, tile, True, one))).otherwise(at_home)
    dealt = placed.select(*names, "block", "cell", F.explode(tasks).alias("t")).select(*names, "block", "cell", "t.*")

    def compare(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        rep, x = col("rep"), unit(matrix(table.column("vector").combine_chunks(), dim))
        links, label = tile_links(col("size"), x, col("side"), bool(table.column("visit")[0].as_py()), int(col("block")[0]), blocks, cosine)
        said = (links > 0) | (label != np.arange(len(x)))
        return pa.table({"cid": col("cid")[said], "twin": col("twin")[said], "links": links[said], "rep": rep[said], "other": rep[label][said]})

    groups = dealt.groupBy("block", "cell", "visit", "i", "j")
    return groups.applyInArrow(compare, "cid long, twin long, links long, rep long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row of vectors (vec_id, embedding)."""
    v = F.col("embedding")
    # Single precision stays as it is until it is compared; anything else is taken in double precision.
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{kind}>").alias("vector"), F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False)).alias("good"))
    # +0.0 and -0.0 are one value.
    rows = rows.withColumn("vector", F.when(F.col("good"), F.transform("vector", lambda e: e + F.lit(0.0).cast(kind))))
    # Equal vectors are equal in two 64-bit hashes.
    rows = rows.withColumns({"cid": F.when(F.col("good"), F.xxhash64("vector")), "twin": F.when(F.col("good"), F.xxhash64(F.lit("twin"), "vector"))})
    key = ["cid", "twin"]
    classes = rows.where("good").groupBy(*key, "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes.select(*key, "rep", "size", "vector"), "vectors")
    # Vectors of different length are different spaces; there is rarely more than one.
    found = None
    for dim in sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect()):
        part = joined(classes.where(F.size("vector") == dim), dim, cosine, block)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = classes.select(*key, F.col("size").alias("links"), "rep", F.col("rep").alias("other"))
    found = cut(found, "tilelinks")
    nodes = settled("nodes", lambda: components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))))
    links = found.groupBy(*key).agg(F.sum("links").alias("links"))
    facts = classes.select(*key, "rep", "size").join(links, key, "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select(*key, (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), "size")
    out = skew_join(rows.where("good").select("vec_id", *key), facts, key, "size").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def planted(vectors: DataFrame) -> DataFrame:
    """vectors and, under ids of their own, variants of every second one by a fixed formula: links that any table has."""
    v = F.col("embedding")
    turn = lambda tenths: F.transform(v, lambda e, i: (e + F.when(i % 4 == 0, F.lit(tenths / 10.0)).otherwise(0.0) * F.abs(e)).cast("double"))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    even = vectors.where("vec_id % 2 = 0")
    for k, tenths in enumerate((3, 9, 15), 1):
        base = base.unionByName(even.select((F.col("vec_id") + k * 1_000_000_000).cast("long").alias("vec_id"), turn(tenths).alias("embedding")))
    return base


def op1_planted(spark, sf_dir: str) -> DataFrame:
    """The operator on vectors that have links, as the given tables may hold none."""
    return near_duplicates(planted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def op1_subspace_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL_OF = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(embedding, lambda e: e <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM {vectors}),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND vec_id IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(coalesce(c.component_id, v.vec_id) = v.vec_id, true) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.vec_id LEFT JOIN c ON v.vec_id = c.vec_id
"""

SQL = SQL_OF.format(vectors="embeddings")
PLANTED_SQL = SQL_OF.format(
    vectors="(SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings UNION ALL "
    "SELECT CAST(vec_id + k.k * CAST(1000000000 AS BIGINT) AS BIGINT), list_transform(CAST(embedding AS DOUBLE[]), lambda e, i: e + CASE WHEN (i - 1) % 4 = 0 THEN k.s ELSE 0.0 END * abs(e)) "
    "FROM embeddings, (VALUES (1, CAST(0.3 AS DOUBLE)), (2, CAST(0.9 AS DOUBLE)), (3, CAST(1.5 AS DOUBLE))) AS k(k, s) WHERE vec_id % 2 = 0)"
)
