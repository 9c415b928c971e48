"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: by how often their cell of a table of counts over all rows was
hit, then by hash, so the rarest come first. A set's candidates are the sets that share one of its
first ``(1 - t) n + 1`` n-grams (every set of a similarity of ``t`` or more does), if sizes and the
parities of their hashed n-grams do not tell them apart; no pair is lost by either test, and sets
without a rare n-gram in common never meet. Candidates that are connected form blocks. Within a
block the order is cut into fragments, partial overlaps are counted fragment by fragment and summed
per pair, which gives exact similarities.

Equal sets meet as one before anything else. A block of more than ``CHUNK`` sets is dealt as pairs
of chunks, so no task holds more than two chunks, and links leave a task as a spanning forest,
never as all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, n_blocks, tidy, written
from tesserae.llm.components import components
from tesserae.llm.suffixes import _mixed, prefix_hashes

#: The contract of op3: similarity as a fraction, here 90/100, of sets of n-grams of so many words.
LEAST = (90, 100)
GRAM = 3
#: The pipeline's, which no contract binds.
STAGE_LEAST, STAGE_GRAM = (80, 100), 5
CHUNK, CHUNK_GRAMS, TASK_BYTES = 1024, 1_000_000, 8 << 20
#: Cells of the table of counts that orders n-grams, and how many go into one row on their way to its sum.
CELLS, CELLS_PART = 1 << 20, 1 << 16
#: Parities of a set at most; beyond it they tell less, but still lose no pair.
MOST_PARITIES = 4096
#: Bytes of text hashed at once in a task.
PART = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def gram_sets(raws: list[bytes], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text: owners and hashes, sorted by both.

    A-Z become lower case; words are runs of anything but ASCII white space; a text of fewer words
    than ``gram`` has its whole sequence as its one n-gram; without words it has none.
    """
    buf = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    buf = _LOWER[buf]
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sums, down = prefix_hashes(buf)
    word = _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(r) + 1 for r in raws])
    owner = np.searchsorted(stops, begin, "right")
    count = np.bincount(owner, minlength=len(raws))
    inside = np.arange(len(word)) - (np.cumsum(count) - count)[owner]
    have = np.minimum(count, gram)[owner]
    start = np.flatnonzero(inside <= count[owner] - have)
    start = start[inside[start] + np.minimum(have[start], gram) <= count[owner[start]]]
    hashed = np.zeros(len(start), np.uint64)
    for k in range(gram):
        at = np.minimum(start + k, len(word) - 1)
        hashed = np.where(k < have[start], _mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + word[at] + np.uint64(k)), hashed)
    owner = owner[start]
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])] if len(owner) else np.zeros(0, bool)
    return owner[first], hashed[first]


def rarest(owner: np.ndarray, hashed: np.ndarray, n: int, least: tuple[int, int], counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and n-grams of the part of each set that every similar set shares one of; the order is by ``counted`` cells, then by hash."""
    part, whole = least
    order = np.lexsort((hashed, counted[hashed & np.uint64(len(counted) - 1)], owner))
    owner, hashed = owner[order], hashed[order]
    size = np.bincount(owner, minlength=n)
    keep = np.arange(len(owner)) - (np.cumsum(size) - size)[owner] <= (size * (whole - part) // whole)[owner]
    return owner[keep], hashed[keep]


def parities(owner: np.ndarray, hashed: np.ndarray, n: int) -> list[bytes]:
    """For each set, the parity of its n-grams in each of 256 to ``MOST_PARITIES`` cells, a power of two, about two for each n-gram."""
    size = np.bincount(owner, minlength=n)
    cells = np.left_shift(1, np.maximum(8, np.minimum(MOST_PARITIES.bit_length() - 1, np.ceil(np.log2(np.maximum(size, 1) * 2)).astype(np.int64))))
    begin = np.cumsum(cells) - cells
    odd = np.bincount(begin[owner] + (hashed & (cells - 1)[owner].astype(np.uint64)).astype(np.int64), minlength=int(cells.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[b // 8 : (b + c) // 8] for b, c in zip(begin.tolist(), cells.tolist(), strict=True)]


def maybe_near(size: np.ndarray, bits: list[bytes], least: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets sizes and parities don't tell apart: each differing n-gram changes one parity."""
    part, whole = least
    near = np.zeros((len(size), len(size)), bool)
    width = np.array([len(b) for b in bits])
    for w in np.unique(width):
        mine, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        all_ = np.frombuffer(b"".join([bits[i] for i in mine]), np.uint64).reshape(len(mine), -1)
        if len(wide):  # cells of twice as many fold into these
            half = np.frombuffer(b"".join([bits[i] for i in wide]), np.uint64).reshape(len(wide), 2, -1)
            all_ = np.concatenate([all_, half[:, 0] ^ half[:, 1]])
        other = np.r_[mine, wide]
        step = max(1, (1 << 18) // all_.size)
        for k in range(0, len(mine), step):
            differ = np.bitwise_count(all_[k : min(k + step, len(mine)), None] ^ all_[None]).sum(2, dtype=np.int64)
            a, b = size[mine[k : k + step]][:, None], size[other][None]
            ok = (differ * (whole + part) <= (a + b) * (whole - part)) & (np.minimum(a, b) * whole >= np.maximum(a, b) * part)
            near[np.ix_(mine[k : k + step], other)] = ok
    return near | near.T


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(owner, kind="stable")
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[order].view(np.int64)))


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``PART`` bytes of text each; only a slice's texts are copied."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        at = size = 0
        for i, more in enumerate(sizes):
            size += more
            if size >= PART or i + 1 == len(sizes):
                part = batch.slice(at, i + 1 - at)
                yield part, [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(text)]
                at, size = i + 1, 0


def _describe(gram: int, least: tuple[int, int], counted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, th, text) to rows (doc_id, th, n, a, b, signs, bits): size, 128-bit name, rarest n-grams and parities of the set."""
        for part, raws in _parts(batches, 2):
            owner, hashed = gram_sets(raws, gram)
            n = len(raws)
            size = np.bincount(owner, minlength=n)
            names = []
            for salt in (1, 2):
                total = np.zeros(n, np.uint64)
                np.add.at(total, owner, _mixed(hashed + np.uint64(salt)))
                names.append(pa.array(_mixed(total + size.astype(np.uint64)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), *names, _lists(*rarest(owner, hashed, n, least, counted), n), pa.array(parities(owner, hashed, n), pa.binary())], names=["doc_id", "th", "n", "a", "b", "signs", "bits"])

    return run


def linked(raws: list[bytes], gram: int = GRAM, fragments: int = 16, least: tuple[int, int] = LEAST) -> np.ndarray:
    """For each of some texts, the least index that links reach; partial overlaps are counted by fragment and summed."""
    owner, hashed = gram_sets(raws, gram)
    n = len(raws)
    size = np.bincount(owner, minlength=n).astype(np.int64)
    names, place, often = np.unique(hashed, return_inverse=True, return_counts=True)
    use = often[place] > 1  # an n-gram of one set is in no overlap
    owner, place = owner[use], place[use]
    shared, place = np.unique(place, return_inverse=True)
    overlap = np.zeros((n, n), np.float32)
    for f in np.array_split(np.arange(len(shared)), max(1, min(fragments, len(shared)), n * len(shared) >> 23)):
        if len(f):
            mine = (place >= f[0]) & (place <= f[-1])
            segment = np.zeros((n, len(f)), np.float32)
            segment[owner[mine], place[mine] - f[0]] = 1
            overlap += segment @ segment.T
    part, whole = least
    near = overlap.astype(np.int64) * (whole + part) >= part * (size[:, None] + size[None, :])
    near &= (size > 0)[:, None] & (size > 0)[None, :]
    return _labels(near)


def _labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least index that they reach."""
    label = np.arange(len(near))
    while True:
        low = np.array([label[row].min() if row.any() else label[i] for i, row in enumerate(near)])
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _cells(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text) to rows (part, cells): how many n-grams fell into each cell of the table."""
        total = np.zeros(CELLS, np.int64)
        for _, raws in _parts(batches, 0):
            total += np.bincount((gram_sets(raws, gram)[1] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        parts = [zlib.compress(total[i : i + CELLS_PART].tobytes(), 1) for i in range(0, CELLS, CELLS_PART)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "cells"])

    return run


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "cells"])


def counted_cells(texts: DataFrame, gram: int) -> np.ndarray:
    """How many n-grams of all rows fell into each cell: a table of one size, however many rows there are."""
    parts = -(-CELLS // CELLS_PART)
    summed = texts.mapInArrow(tidy(_cells(gram)), "part int, cells binary").repartition(parts, "part").mapInArrow(_sum_cells, "part int, cells binary")
    out = np.zeros(CELLS, np.int64)
    for row in summed.collect():
        out[row.part * CELLS_PART :][:CELLS_PART] = np.frombuffer(zlib.decompress(row.cells), np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def _link_sharers(least: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (sign, sid, n, bits), sorted by the first, to rows (a, b): a spanning forest of each sign's pairs that may be similar."""
        sign, held = None, []

        def forest() -> pa.RecordBatch:
            label = _labels(maybe_near(np.array([x[1] for x in held], np.int64), [x[2] for x in held], least))
            sid = np.array([x[0] for x in held], np.int64)
            hit = np.flatnonzero(label != np.arange(len(held)))
            return pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(sid[label[hit]])], names=["a", "b"])

        for batch in batches:
            for one, *rest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if one != sign and held:
                    yield forest()
                    held = []
                sign = one
                held.append(rest)
        if held:
            yield forest()

    return run


def _link_blocks(gram: int, least: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, i, j, sid, text), sorted by the first three, to rows (a, b): a spanning forest of each block's links."""

        def forest(held: list[tuple]) -> pa.RecordBatch:
            label = linked([x[1] for x in held], gram, least=least)
            sid = np.array([x[0] for x in held], np.int64)
            hit = np.flatnonzero(label != np.arange(len(held)))
            return pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(sid[label[hit]])], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for block, i, j, sid, text in zip(*columns, strict=True):
                if (block, i, j) != key and held:
                    yield forest(held)
                    held = []
                key = (block, i, j)
                held.append((sid, (text or "").encode()))
        if held:
            yield forest(held)

    return run


def similar_groups(docs: DataFrame, gram: int = GRAM, least: tuple[int, int] = LEAST) -> DataFrame:
    """``doc_id, th, n, component_id`` of every row of ``docs`` (``doc_id`` long, ``text``).

    Sets of n-grams of ``gram`` words are linked at a similarity of ``least`` (a fraction) or more.
    ``n`` is the size of the row's set; ``component_id`` the least id that links reach (its own for
    an empty set, and where no id of a component is known, null). ``th`` is a hash of the text. Null
    and empty texts have an empty set, linked with nothing; repeated rows come back each; an empty
    table gives none; other columns are ignored.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    counted = counted_cells(docs.select("text"), gram)
    rows = written(keyed.mapInArrow(tidy(_describe(gram, least, counted)), "doc_id long, th long, n long, a long, b long, signs array<long>, bits binary"), "sets")
    full = rows.filter("n > 0")
    sets = full.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("n").alias("n"), F.first("signs").alias("signs"), F.first("bits").alias("bits"))
    sets = written(sets.withColumn("sid", F.xxhash64("a", "b")), "distinct")
    segments = sets.select("sid", F.explode("signs").alias("sign"))
    # counts and leaders by partial aggregation, written, so that a join's skew can be split
    often = written(segments.groupBy("sign").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("b")).filter("c > 1"), "often")
    # joined by shuffle at every size, so that what moves grows in proportion
    shared = written(segments.join(often.hint("merge"), "sign"), "shared")
    star = shared.filter(F.col("c") > CHUNK).filter("sid <> b").select(F.col("sid").alias("a"), "b")  # too many to compare in one task
    few = shared.filter(F.col("c") <= CHUNK).join(sets.select("sid", "n", "bits").hint("merge"), "sid").select("sign", "sid", "n", "bits")
    pairs = few.repartition("sign").sortWithinPartitions("sign").mapInArrow(tidy(_link_sharers(least)), "a long, b long")
    blocks = components(star.union(pairs))

    member = written(blocks.join(sets.select(F.col("sid").alias("node"), "n", "at"), "node"), "members")
    chunks = member.groupBy("label").agg(F.greatest(F.count(F.lit(1)) / F.lit(float(CHUNK)), F.sum("n") / F.lit(float(CHUNK_GRAMS))).alias("size"))
    member = member.join(chunks.select("label", F.greatest(F.lit(1), F.ceil("size")).cast("long").alias("chunks")), "label")
    member = member.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("last", F.col("chunks") - 1)
    # a block of two chunks at most goes to one task; of more, every pair of chunks does
    others = F.when(F.col("last") < 2, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda x: x != F.col("chunk")), lambda x: F.struct(F.least(x, "chunk").alias("i"), F.greatest(x, "chunk").alias("j")))
    )
    dealt = member.select(F.col("label").alias("block"), F.col("node").alias("sid"), F.col("at.doc_id").alias("d"), F.col("at.th").alias("t"), others.alias("pairs"))
    texts = keyed.join(dealt.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))).select("block", "sid", "pairs", "text").dropDuplicates(["block", "sid"])
    texts = written(texts, "texts")
    size = texts.agg(F.sum(F.octet_length("text") * F.size("pairs"))).first()[0]
    placed = texts.select("block", F.explode("pairs").alias("p"), "sid", "text").select("block", "p.i", "p.j", "sid", "text")
    tasks = n_blocks(size, TASK_BYTES)
    links = placed.repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j", "sid").mapInArrow(tidy(_link_blocks(gram, least)), "a long, b long")

    groups = components(links)
    named = sets.select("a", "b", "sid", "least").join(groups.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    # a label's least id is found by partial aggregation, so a very large group is no hot window
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("a", "b", "component_id")
    whole = full.select("doc_id", "th", "n", "a", "b").join(named, ["a", "b"]).select("doc_id", "th", "n", "component_id")
    return whole.union(rows.filter("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("component_id")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the one with the least id, then text hash; rows without words stay.

    Of rows that are equal in id and text, any one stays.
    """
    c, d, t = (fresh(docs, x) for x in ("c", "d", "t"))
    rows = similar_groups(docs, STAGE_GRAM, STAGE_LEAST).filter("n > 0").groupBy("component_id", "doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "c")
    best = rows.groupBy("component_id").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias(d), F.col("k.th").alias(t), F.col("k.c").alias(c))
    kept = docs.join(best, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)))
    several = kept.filter(F.col(c) > 1).dropDuplicates(["doc_id", t])
    without = docs.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.filter(F.col(c) == 1).select(*docs.columns).union(several.select(*docs.columns)).union(without)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-equal texts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_groups(docs, GRAM, LEAST).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i+2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = d.doc_id
"""
