"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed.

The suffixes that can start such a string are found without sorting every byte. Each window of
``LENGTH`` bytes has one anchor, its least hashed 32-byte gram, so equal windows have equal anchors;
consecutive windows of one anchor form a run. Runs are dealt by their anchor; those whose anchor
comes once are done. Equal runs meet as one counted run before any text is moved, so copies of a
document or a passage, however many, cost one suffix block.

The remaining runs' bytes are indexed by a logarithmic family inside each task (``Levels``): each
batch gets a suffix array over its windows, is merge-scanned against the existing levels for
matches of ``LENGTH`` bytes, and equal-sized levels are merged. The matched ranges go back to every
place of their run, and each document's ranges are united and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, give_back, n_blocks, tidy, written

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at once in a task; longer texts are taken in overlapping parts.
PART = 1 << 19
#: Bytes of runs that a task indexes, and that one anchor may bring to a task.
TASK_BYTES, HOT_BYTES = 2 << 20, 16 << 20
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_POSITION = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of the hash base and of its inverse, grown when needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and factors that move a difference of two of them to the origin."""
    up, down = _Powers.of(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[:-1], dtype=np.uint64, out=sums[1:])
    return sums, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span, m = 1, a
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    n = len(a) - width + 1
    return np.minimum(m[:n], m[width - span : width - span + n])


def runs(buf: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the windows that ``valid`` allows to start: anchor hash, run hash, first start and number of starts, by run."""
    sums, down = prefix_hashes(buf)
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(buf) - GRAM + 1])
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(keys, SPAN) & _POSITION).astype(np.int64)
    starts = np.flatnonzero(valid[: len(anchor)])
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (starts, starts)
    at = anchor[starts]
    first = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(at) != 0)])
    low = starts[first]
    count = np.diff(np.r_[first, len(starts)])
    whole = (sums[low + count + LENGTH - 1] - sums[low]) * down[low]
    return grams[at[first]], _mixed(whole + _mixed((at[first] - low).astype(np.uint64) * np.uint64(4096) + count.astype(np.uint64))), low, count


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, th, text) to rows (anchor, run, doc_id, th, low, n)."""

    def parts() -> Iterator[tuple]:
        for batch in batches:
            for name, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer() if text.is_valid else None
                for at in range(0, (len(raw) if raw is not None else 0) - LENGTH + 1, PART):
                    yield name, th, at, raw[at : at + PART + LENGTH - 1]

    def found(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(x[3]) for x in held])
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        valid = np.ones(len(buf), bool)
        for e in ends.tolist():
            valid[e - LENGTH + 1 : e] = False
        anchor, run, low, count = runs(buf, valid)
        owner = np.searchsorted(ends, low, "right")
        rel = low - (ends - sizes)[owner] + np.array([x[2] for x in held])[owner]
        pick = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array([x[0] for x in held], pa.int64()).take(pick), pa.array([x[1] for x in held], pa.int64()).take(pick), pa.array(rel, pa.int64()), pa.array(count, pa.int32())],
            names=["anchor", "run", "doc_id", "th", "low", "n"],
        )

    held, size = [], 0
    for part in parts():
        if size + len(part[3]) > 2 * PART and held:
            yield found(held)
            held, size = [], 0
        held.append(part)
        size += len(part[3])
    if held:
        yield found(held)


class Levels:
    """A logarithmic family of suffix arrays over windows of ``LENGTH`` bytes.

    An array holds windows sorted by their first eight bytes and then by a fingerprint of all of
    them, so windows that agree in ``LENGTH`` bytes are neighbours. ``add`` scans a new array
    against every level, then merges it with levels of its size class. ``repeated`` tells which
    windows, by number of adding, have a match.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.repeated = np.zeros(0, bool)

    def add(self, head: np.ndarray, mark: np.ndarray, often: np.ndarray) -> None:
        """Windows by their first bytes and fingerprint; ``often``: the window is known to occur elsewhere."""
        number = np.arange(len(self.repeated), len(self.repeated) + len(head))
        self.repeated = np.concatenate((self.repeated, often))
        array = self._merged((head, mark, number))
        for level in self.levels:
            self._merged(array, level)
        self.levels.append(array)
        while len(self.levels) > 1 and len(self.levels[-1][0]).bit_length() >= len(self.levels[-2][0]).bit_length():
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))

    def _merged(self, *arrays: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arrays' merge; neighbours that agree are noted as repeated."""
        head, mark, number = (np.concatenate(x) for x in zip(*arrays, strict=True))
        order = np.lexsort((mark, head))
        head, mark, number = head[order], mark[order], number[order]
        same = np.flatnonzero((head[1:] == head[:-1]) & (mark[1:] == mark[:-1]))
        self.repeated[number[same]] = True
        self.repeated[number[same + 1]] = True
        return head, mark, number


def _window_keys(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all windows of some runs: the run's index, the start in the run, the first eight bytes, and the fingerprint."""
    sizes = np.array([len(x) for x in raws], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(raws), np.uint8)
    valid = np.ones(len(buf), bool)
    for e in ends.tolist():
        valid[e - LENGTH + 1 : e] = False
    at = np.flatnonzero(valid)
    sums, down = prefix_hashes(buf)
    mark = _mixed((sums[at + LENGTH] - sums[at]) * down[at])
    head = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))[at].astype(np.uint64)
    owner = np.searchsorted(ends, at, "right")
    return owner, at - (ends - sizes)[owner], head, mark


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, run, copies, bytes) to a row for each window."""
    for batch in batches:
        if batch.num_rows:
            owner, rel, head, mark = _window_keys(batch.column(3).to_pylist())
            pick = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(rel.astype(np.int32)), batch.column(2).take(pick), pa.array(head.view(np.int64)), pa.array(mark.view(np.int64))], names=["anchor", "run", "at", "copies", "head", "mark"])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, run, copies, bytes) of whole anchor groups to rows (anchor, run, lo, hi): repeated bytes of the run."""
    family, kept = Levels(), []
    for batch in batches:
        if not batch.num_rows:
            continue
        owner, rel, head, mark = _window_keys(batch.column(3).to_pylist())
        family.add(head, mark, np.array(batch.column(2).to_pylist())[owner] > 1)
        kept.append((batch.column(0), batch.column(1), owner.astype(np.int32), rel.astype(np.int32)))
    done = 0
    for anchors, names, owner, rel in kept:
        hit = np.flatnonzero(family.repeated[done : done + len(owner)])
        done += len(owner)
        if len(hit):
            first = np.flatnonzero(np.r_[True, (np.diff(owner[hit]) != 0) | (np.diff(rel[hit]) > LENGTH)])
            last = np.r_[first[1:] - 1, len(hit) - 1]
            pick = pa.array(owner[hit][first])
            lo, hi = rel[hit][first], rel[hit][last] + LENGTH
            yield pa.RecordBatch.from_arrays([anchors.take(pick), names.take(pick), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["anchor", "run", "lo", "hi"])
    # a worker waits for further tasks beside the next stage's; it gives back what it can
    del family, kept
    give_back()


def united(ranges: list[dict]) -> list[list[int]]:
    """Sorted, disjoint, non-touching ranges that cover the same bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, th, ranges``: for each text with any, the byte ranges covered by repeated strings.

    ``docs`` has ``doc_id`` (long), ``text``; ``th`` is a hash of the text, so a row is found again by both.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = written(keyed.mapInArrow(tidy(_find_runs), "anchor long, run long, doc_id long, th long, low long, n int"), "all-runs")
    # counted and written before the join, so that a very frequent anchor costs one row a task and the join's skew can be split
    often = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "anchors")
    places = written(found.join(often, "anchor", "left_semi"), "places")
    reps = places.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th", "low", "n")).alias("at"))
    reps = reps.select("anchor", "run", "copies", "at.*").withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))
    bytes_ = F.substring(F.col("text").cast("binary"), (F.col("low") + 1).cast("int"), F.col("n") + F.lit(LENGTH - 1))
    texts = written(reps.join(keyed, same).select("anchor", "run", "copies", bytes_.alias("raw")), "runs")
    sizes = texts.groupBy("anchor").agg(F.sum(F.octet_length("raw")).alias("size"))
    hot = written(sizes.filter(F.col("size") > HOT_BYTES).select("anchor"), "hot-anchors")
    tasks = n_blocks(texts.agg(F.sum(F.octet_length("raw"))).first()[0], TASK_BYTES)
    calm = texts.join(hot, "anchor", "left_anti").repartition(tasks, "anchor").sortWithinPartitions("anchor", "run").mapInArrow(_scan_runs, "anchor long, run long, lo int, hi int")
    # windows of an anchor with very many different runs are dealt by their own fingerprints instead
    windows = texts.join(hot, "anchor", "left_semi").mapInArrow(_windows, "anchor long, run long, at int, copies long, head long, mark long")
    twice = windows.groupBy("head", "mark").agg(F.sum("copies").alias("c")).filter("c > 1").select("head", "mark")
    loose = windows.join(twice, ["head", "mark"], "left_semi").select("anchor", "run", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    hits = written(calm.union(loose), "hits")
    marks = places.join(hits, ["anchor", "run"]).select("doc_id", "th", (F.col("low") + F.col("lo")).alias("lo"), (F.col("low") + F.col("hi")).alias("hi"))
    return marks.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def _with_ranges(docs: DataFrame, name: str = "ranges") -> DataFrame:
    """``docs`` with the ranges of each row's text in column ``name``, which ``docs`` must not have."""
    d, t = fresh(docs, "d"), fresh(docs, "t")
    marks = repeated_ranges(docs).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("ranges").alias(name))
    return docs.join(marks, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left").select(*docs.columns, name)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = memoryview(text.as_buffer() if text.is_valid else b"")
            cut, at, kept = united(ranges or []), 0, hashlib.sha256()
            for lo, hi in cut:
                kept.update(raw[at:lo])
                at = hi
            kept.update(raw[at:])
            rows.append((len(raw), sum(hi - lo for lo, hi in cut), len(cut), kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
        out = []
        for text, ranges in zip(batch.column(at), batch.column(last).to_pylist(), strict=True):
            if not ranges or not text.is_valid:
                out.append(text.as_py())
                continue
            raw, place, kept = text.as_py().encode(), 0, []
            for lo, hi in united(ranges):
                kept.append(raw[place:lo])
                place = hi
            out.append(b"".join([*kept, raw[place:]]).decode("utf-8", "ignore"))
        columns = [batch.column(i) for i in range(last)]
        columns[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` and ``n_chars`` counted anew; texts of which no word stays go.

    Null and short texts have no repeats; a character that a cut splits goes; equal rows are cut alike.
    """
    done = _with_ranges(docs, fresh(docs, "ranges")).mapInArrow(tidy(_cut), docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _with_ranges(docs).select("doc_id", "text", "ranges").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
