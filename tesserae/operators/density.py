"""Density clusters of vectors: core distances, density-connected core points, border points, noise.

Vectors are packed into blocks, which are saved once, in ranges. Each two ranges meet in a task that
reads them where they are saved, so no vector is shuffled to meet others and disk doesn't grow with
the pairs. For all its pairs of blocks a task gives out the nearest distances of each item, then one spanning
forest of near core points (never all near pairs) and the nearest core point of each other one;
Spark joins the forests of all tasks into clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.relational import top_n_per_group

NOISE, LEAST_NEAR, CORE_SHARE = -1, 5, 0.75
#: Bytes of a block's vectors and of a range's, about; both in double precision.
BLOCK_BYTES, RANGE_BYTES = 1 << 20, 64 << 20
#: Bytes of pairs of blocks that are handed to Python at once; Spark's own 64 MB are held several times over by each task.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Rows of a block that are multiplied at once.
STEP = 512


def packed(items: DataFrame, save: Callable[[DataFrame], DataFrame], rows: int | None = None) -> DataFrame:
    """``b, n, ids, single, v``: saved blocks of about ``BLOCK_BYTES``, or of ``rows`` items, by ascending ``b`` in ranges of files."""
    n, width = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    rows = rows or max(1, BLOCK_BYTES // (8 * width))
    blocks, cores = max(1, -(-n // rows)), items.sparkSession.sparkContext.defaultParallelism

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, number = [], 0

        def out(table: pa.Table) -> pa.RecordBatch:
            vectors = table["v"].combine_chunks()
            if len(set(lengths := pc.list_value_length(vectors).to_pylist())) > 1 or None in lengths:
                raise ValueError("vectors must have one length")
            v = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), -1)
            single = bool(np.array_equal(v.astype("f4"), v))  # half the bytes, and nothing lost
            row = {"b": (TaskContext.get().partitionId() << 32) + number, "n": len(v), "ids": table["id"].to_numpy().astype("i8").tobytes(), "single": single, "v": v.astype("f4" if single else "f8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("b", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("single", pa.bool_()), ("v", pa.binary())]))

        for batch in batches:
            kept.append(batch)
            if sum(len(x) for x in kept) >= rows:
                table, at = pa.Table.from_batches(kept), 0
                while len(table) - at >= rows:
                    yield out(table.slice(at, rows))
                    number, at = number + 1, at + rows
                kept = table.slice(at).to_batches()
        if sum(len(x) for x in kept):
            yield out(pa.Table.from_batches(kept))

    ranges = min(blocks, max(ceil(n * width * 8 / RANGE_BYTES), ceil(sqrt(8 * cores))))
    made = items.select("id", "v").coalesce(min(blocks, 4 * cores)).mapInArrow(pack, "b long, n int, ids binary, single boolean, v binary")
    return save(made.repartitionByRange(ranges, "b"))


class Block:
    """A block as arrays: ``ids``, unit vectors (NaN for one without length), the same in single precision, and which items are core points."""

    def __init__(self, row: dict):
        self.b, self.ids = row["b"], np.frombuffer(row["ids"], "i8")
        v = np.frombuffer(row["v"], "f4" if row["single"] else "f8").reshape(row["n"], -1).astype("f8")
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        self.rough = self.unit.astype("f4")
        flags = np.unpackbits(np.frombuffer(row["core"], "u1"), count=row["n"]).astype(bool) if row.get("core") else np.zeros(row["n"], bool)
        self.core, self.other = np.flatnonzero(flags), np.flatnonzero(~flags)


def paired(blocks: DataFrame) -> DataFrame:
    """``x, y``: each two blocks, and each with itself, once. Two ranges of files are a task, which reads both."""
    whole = F.struct(*blocks.columns)
    return blocks.select(whole.alias("x")).hint("shuffle_replicate_nl").join(blocks.select(whole.alias("y")), F.col("x.b") <= F.col("y.b"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Pairs of blocks that are saved inside go to Python in batches of ``BATCH_BYTES``."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block]]:
    """The pairs of blocks that a task gets; a block that comes again in the next pair is not read anew."""
    x = None
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            if x is None or x.b != row["x"]["b"]:
                x = Block(row["x"])
            yield x, x if row["y"]["b"] == x.b else Block(row["y"])


def slack(width: int) -> float:
    """By how much a product of unit vectors in single precision may be below the exact score rounded to 6 places; twice the bound on rounding of sums."""
    return 1e-6 + (width + 8) * 2**-23


def exact(one: np.ndarray, other: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of the unit vectors ``one[row]`` and ``other[at]``, to 6 places; of very many, by the whole product."""
    score = (one @ other.T)[row, at] if 8 * len(row) > len(one) * len(other) else np.einsum("ij,ij->i", one[row], other[at])
    return np.round(score, 6)


def found(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are set, as ``np.nonzero``; few are found faster by eights."""
    if mask.size % 8:
        return np.nonzero(mask)
    flat = mask.reshape(-1)
    at = (np.flatnonzero(flat.view("u8"))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.divmod(at[flat[at]], mask.shape[1])


def _put(best: np.ndarray, fresh: np.ndarray) -> None:
    best[:] = -np.sort(-np.concatenate([best, fresh], axis=1), axis=1)[:, : best.shape[1]]


def _take(best: np.ndarray, row: np.ndarray, at: np.ndarray, one: np.ndarray, other: np.ndarray, same: int | None = None) -> None:
    """Put scores of each of ``one`` among its ``best``, which descend: those of ``other`` that can be among them, ``row`` and ``at``. From ``same`` on, items of both are the same and don't count."""
    k = best.shape[1]
    if len(row) > 4 * k * len(best):  # so many that ordering whole rows is cheaper
        score = one @ other.T
        if same is not None:
            score[np.arange(len(score)), np.arange(same, same + len(score))] = np.nan
        fresh = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
        _put(best, np.where(np.isnan(fresh), -np.inf, np.round(fresh, 6)))
    elif len(row):
        value = exact(one, other, row, at)
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        fresh = np.full(best.shape, -np.inf)
        fresh[row[place < k], place[place < k]] = value[place < k]
        _put(best, fresh)


def core_distances(blocks: DataFrame, save: Callable[[DataFrame], DataFrame], least: int = LEAST_NEAR) -> DataFrame:
    """``b, n, ids, core``, saved: for the items of each block the cosine distance within which an item has ``least`` items, itself counted; NaN where there are fewer."""
    k = max(1, least - 1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = {}, {}
        for x, y in pairs(batches):
            for z in (x, y):
                if z.b not in best:
                    best[z.b], ids[z.b] = np.full((len(z.ids), k), -np.inf), z.ids.tobytes()
            below = slack(x.unit.shape[1])
            for at in range(0, len(x.ids), STEP):
                part = slice(at, at + STEP)
                rough = x.rough[part] @ y.rough.T
                if x is y:
                    rough[np.arange(len(rough)), np.arange(at, at + len(rough))] = np.nan
                _take(best[x.b][part], *found(rough >= (best[x.b][part, -1:] - below).astype("f4")), x.unit[part], y.unit, at if x is y else None)
                if x is not y:
                    row, col = found(rough >= (best[y.b][:, -1] - below).astype("f4"))
                    _take(best[y.b], col, row, y.unit, x.unit[part])
        for b, scores in best.items():
            yield pa.RecordBatch.from_pylist([{"b": b, "n": len(scores), "ids": ids[b], "best": scores.tobytes()}], schema=pa.schema([("b", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("best", pa.binary())]))

    def merged(table: pa.Table) -> pa.Table:
        first, n = table.slice(0, 1).to_pylist()[0], table["n"][0].as_py()
        scores = np.concatenate([np.frombuffer(x.as_buffer(), "f8").reshape(n, k) for x in table["best"]], axis=1)
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        core = np.where(np.isfinite(last) & (least > 1), np.round(1 - last, 6), np.nan)
        return pa.Table.from_pylist([{"b": first["b"], "n": n, "ids": first["ids"], "core": core.tobytes()}], schema=pa.schema([("b", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("core", pa.binary())]))

    partial = paired(blocks).mapInArrow(nearest, "b long, n int, ids binary, best binary")
    with small_batches(blocks.sparkSession):
        return save(partial.groupBy("b").applyInArrow(merged, "b long, n int, ids binary, core binary"))


def by_item(cores: DataFrame) -> DataFrame:
    """``id, core`` of packed core distances; null where there is none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                core = np.frombuffer(row["core"], "f8")
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], "i8")), pa.array(core, mask=np.isnan(core))], ["id", "core"])

    return cores.select("ids", "core").mapInArrow(rows, "id long, core double")


def flagged(cores: DataFrame, eps: float) -> DataFrame:
    """``b, core``: a bit for each item of a block, set for a core point."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flags = np.packbits(np.frombuffer(row["core"], "f8") <= eps).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["b"]], pa.int64()), pa.array([flags], pa.binary())], ["b", "core"])

    return cores.select("b", "core").mapInArrow(bits, "b long, core binary")


def connected(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id, root``: the smallest id that is linked with each end of ``edges`` (``a``, ``b``).

    In each round an id takes the smallest of itself and its neighbours and edges are renamed; an
    edge between an id and its new name stays, so no link is lost; rounds end when no edge is left.
    ``save`` writes a table and reads it back.
    """
    left = save(edges.select("a", "b").filter("a <> b").distinct())
    names: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        if names is None:
            names = least.select(F.col("a").alias("id"), F.col("to").alias("root"))
        else:
            names = names.join(least.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        names = save(names)
        ends = left.join(least.withColumnRenamed("to", "x"), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = save(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0) if names is None else names


class Forest:
    """Trees of items that are linked so far; items of a block follow each other."""

    def __init__(self):
        self.start, self.ids, self.parent = {}, np.empty(0, "i8"), np.empty(0, "i8")

    def places(self, x: Block) -> np.ndarray:
        """The places of a block's core points."""
        if x.b not in self.start:
            self.start[x.b] = len(self.ids)
            self.parent = np.concatenate([self.parent, np.arange(len(self.ids), len(self.ids) + len(x.ids))])
            self.ids = np.concatenate([self.ids, x.ids])
        return self.start[x.b] + x.core

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while not np.array_equal(further := self.parent[up], up):
            up = further
        self.parent[at] = up
        return up

    def link(self, one: np.ndarray, other: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Link places ``one[row]`` and ``other[at]``; gives those that link two trees, as their numbers in the list and the ids."""
        number = np.arange(len(row))
        while len(number):
            a, b = self.roots(one)[row[number]], self.roots(other)[at[number]]
            apart = a != b
            number, a, b = number[apart], a[apart], b[apart]
            # one link for each tree on either side, so that trees at least halve in a round
            some = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
            for k in some:
                p, q = a[k], b[k]
                while (up := self.parent[p]) != p:
                    p = up
                while (up := self.parent[q]) != q:
                    q = up
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    yield number[k], self.ids[one[row[number[k]]]], self.ids[other[at[number[k]]]]


def _forests(batches: Iterator[pa.RecordBatch], eps: float) -> Iterator[pa.RecordBatch]:
    """Of a task's pairs of blocks: a spanning forest of core points within ``eps`` (kind 0), and for each other point its nearest core point within ``eps`` (kind 1)."""
    forest, nearest = Forest(), {}

    def rows(kind: int, one: np.ndarray, other: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(one), kind, "i4")), pa.array(one), pa.array(other), pa.array(far)], ["kind", "id", "other", "distance"])

    def near(x: Block, mine: np.ndarray, theirs: tuple[np.ndarray, np.ndarray], trees: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs within ``eps`` of the items ``mine`` of a block and the unit vectors ``theirs`` (exact, rough), and how far they are; none within one of ``trees``."""
        row, at = found(x.rough[mine] @ theirs[1].T >= np.float32(1 - eps - 1e-6 - slack(x.unit.shape[1])))
        if trees:
            apart = trees[0][row] != trees[1][at]
            row, at = row[apart], at[apart]
        far = np.round(1 - exact(x.unit[mine], theirs[0], row, at), 6)
        return row[far <= eps], at[far <= eps], far[far <= eps]

    def border(x: Block, y: Block) -> None:
        """The nearest core points in ``y`` of the other points of ``x``."""
        core = y.unit[y.core], y.rough[y.core]
        least, which = nearest.setdefault(x.b, (x.ids, np.full(len(x.ids), np.inf), np.zeros(len(x.ids), "i8")))[1:]
        for at in range(0, len(x.other), STEP):
            mine = x.other[at : at + STEP]
            row, col, far = near(x, mine, core)
            other = y.ids[y.core[col]]
            order = np.lexsort((other, far, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            here, far, other = mine[row[first]], far[first], other[first]
            better = (far < least[here]) | (far == least[here]) & (other < which[here])
            least[here[better]], which[here[better]] = far[better], other[better]

    for x, y in pairs(batches):
        one, other, core = forest.places(x), forest.places(y), (y.unit[y.core], y.rough[y.core])
        for at in range(0, len(one), STEP):
            part = slice(at, at + STEP)
            row, col, far = near(x, x.core[part], core, (forest.roots(one[part]), forest.roots(other)))
            links = list(forest.link(one[part], other, row, col))
            if links:
                number, a, b = map(np.array, zip(*links, strict=True))
                yield rows(0, a, b, far[number])
        border(x, y)
        if x is not y:
            border(y, x)
    for ids, least, which in nearest.values():
        held = np.isfinite(least)
        yield rows(1, ids[held], which[held], least[held])


def density_clusters(items: DataFrame, save: Callable[[DataFrame], DataFrame], least: int = LEAST_NEAR, eps: float | None = None, rows: int | None = None) -> DataFrame:
    """``id, cluster, core``: each item's cluster by density, named by its smallest core point, or ``NOISE``.

    Core points have ``least`` items within ``eps`` (cosine distance, 6 places; themselves counted).
    Core points within ``eps`` of each other share a cluster, other points join their nearest core
    point within ``eps`` (ties to the lower id). Without ``eps`` it is the distance within which
    three quarters of all items are core points. Items are ``id`` long (distinct) and ``v``.
    """
    blocks = packed(items, save, rows)
    measured = core_distances(blocks, save, least)
    cores = save(by_item(measured))
    if eps is None:
        eps = cores.agg(F.percentile("core", F.lit(CORE_SHARE))).first()[0]
    eps = -1.0 if eps is None else round(float(eps), 6)
    # an eighth of a byte an item is broadcast
    dealt = blocks.join(F.broadcast(flagged(measured, eps)), "b")
    with small_batches(items.sparkSession):
        met = save(paired(dealt).mapInArrow(lambda batches: _forests(batches, eps), "kind int, id long, other long, distance double"))
    roots = connected(met.filter("kind = 0").select(F.col("id").alias("a"), F.col("other").alias("b")), save)
    own = cores.filter(F.col("core") <= eps).select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    own = save(own)
    border = top_n_per_group(met.filter("kind = 1"), ["id"], [F.asc("distance"), F.asc("other")], 1).join(own.select(F.col("id").alias("other"), "cluster"), "other").select("id", "cluster")
    return cores.join(own.unionByName(border), "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("cluster"), "core")
