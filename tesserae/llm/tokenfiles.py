"""Token-ID files: ids of documents, range-coded in blocks that stand alone.

Documents are dealt to ranges of the id; each range becomes one file of blocks. A block has a fixed
header, the ids and lengths of its documents, and the words of an adaptive context-mixing range
coder (``coder``), whose model starts afresh with each block; a checksum covers the whole body. A
table of the files written (the manifest) makes them visible: files that a lost or repeated task
left behind stand in no manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import coder
from tesserae.llm.common import n_blocks, running_starts, shared_dir, written
from tesserae.llm.wordids import word_ids

END_ID, RANGE_BYTES, BLOCK_BYTES, BLOCK_IDS = 2, 32 << 20, 8 << 20, 1 << 22
#: The file begins with this; so does each block, followed by its counts of ids, documents and words, and the checksum of its body.
FILE_MARK, BLOCK_MARK = b"TSIDS\x00\x01\x00", b"TSBK"
_HEADER = struct.Struct("<4sIIII")
#: A document's part in a block: id (0 if null), how many of the block's ids, whether the id is there, whether the document ends here.
_PART = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("known", "u1"), ("last", "u1")])
MANIFEST, ROWS = "number int, file string, n_ids long, n_docs long, n_bytes long", "doc_id long, start long, ids binary"


class DamagedFile(ValueError):
    """A block's checksum or its marks do not fit."""


def packed_block(parts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: the parts of its documents and all their ids."""
    words = coder.encode(ids)
    body = parts.tobytes() + words.astype("<u2").tobytes()
    return _HEADER.pack(BLOCK_MARK, len(ids), len(parts), len(words), zlib.crc32(body)) + body


def read_blocks(source) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts and ids of each block of an open file."""
    if source.read(len(FILE_MARK)) != FILE_MARK:
        raise DamagedFile("not a file of token ids")
    while head := source.read(_HEADER.size):
        if len(head) < _HEADER.size:
            raise DamagedFile("the file ends inside a header")
        mark, n, n_parts, n_words, crc = _HEADER.unpack(head)
        body = source.read(n_parts * _PART.itemsize + 2 * n_words)
        if mark != BLOCK_MARK or zlib.crc32(body) != crc:
            raise DamagedFile("a block's checksum does not fit")
        cut = n_parts * _PART.itemsize
        yield np.frombuffer(body[:cut], _PART), coder.decode(np.frombuffer(body[cut:], "<u2"), n)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts and ids of about ``BLOCK_BYTES`` of text at a time, at most ``BLOCK_IDS`` ids a block; a long document goes over several."""
    held, size = [], 0

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        names, texts = (pa.concat_arrays([h.column(i) for h in held]) for i in range(2))
        ids, stops = word_ids(path).of(texts, end)
        stops = stops.astype(np.int64)
        for low in range(0, len(ids), BLOCK_IDS):
            high = min(low + BLOCK_IDS, len(ids))
            first, last = np.searchsorted(stops, low, "right"), np.searchsorted(stops, high, "left")
            here = slice(first, last + 1)
            parts = np.zeros(last + 1 - first, _PART)
            parts["doc_id"] = pc.fill_null(names, 0).to_numpy()[here]
            parts["known"] = names.is_valid().to_numpy(zero_copy_only=False)[here]
            ends = np.minimum(stops[here], high)
            parts["n"] = np.diff(ends, prepend=low)
            parts["last"] = stops[here] <= high
            yield parts, ids[low:high]

    for batch in batches:
        low = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for i, more in enumerate(sizes):
            size += more
            if size >= BLOCK_BYTES or i + 1 == len(sizes):
                held.append(batch.slice(low, i + 1 - low))
                low = i + 1
            if size >= BLOCK_BYTES:
                yield from cut()
                held, size = [], 0
    if held:
        yield from cut()


def _writer(folder: str, path: str, end: int):
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) in order to one file, and its row of the manifest; no file for no rows."""
        number, out, n_ids, n_docs, n_bytes = TaskContext.get().partitionId(), None, 0, 0, len(FILE_MARK)
        name = f"{folder}/{number:08d}-{uuid.uuid4().hex}.ids"
        for parts, ids in _blocks(batches, path, end):
            if out is None:
                store, place = fs.FileSystem.from_uri(name)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place)
                out.write(FILE_MARK)
            block = packed_block(parts, ids)
            out.write(block)
            n_ids, n_docs, n_bytes = n_ids + len(ids), n_docs + int(parts["last"].sum()), n_bytes + len(block)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "file": [name], "n_ids": [n_ids], "n_docs": [n_docs], "n_bytes": [n_bytes]})

    return run


def _reader():
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (file, start) to rows (doc_id, start, ids), whose ids are little-endian unsigned 32-bit integers."""
        for batch in batches:
            for name, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_stream(place) as source:
                    begun: list[bytes] = []
                    for parts, ids in read_blocks(source):
                        raw, at, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                        for n, last in zip(parts["n"].tolist(), parts["last"].tolist(), strict=True):
                            begun.append(bytes(raw[at : at + 4 * n]))
                            at += 4 * n
                            if last:
                                rows.append(begun[0] if len(begun) == 1 else b"".join(begun))
                                begun = []
                        ends = parts[parts["last"] == 1]
                        lengths = np.array([len(r) // 4 for r in rows], np.int64)
                        starts = start + np.cumsum(lengths) - lengths
                        start += int(lengths.sum())
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ends["doc_id"], pa.int64(), mask=ends["known"] == 0), "start": starts, "ids": pa.array(rows, pa.binary())})

    return run


def write_ids(df: DataFrame, path: str | None = None, end: int = END_ID, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the ids of all rows of ``df`` (``doc_id`` long, ``text``) into files; the manifest of those files, in order of their ``number``.

    Files follow each other in ascending order of the id (null first), equal ids in order of a hash
    of the text; each document ends with ``end``. A null text is empty, repeated rows are written
    each, other columns are ignored, an empty table gives no file. Rows equal in id and text stay
    in one range. ``start`` of the manifest is the number of ids in all files before.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_dir(df.sparkSession)}/ids-{uuid.uuid4().hex}"
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    n = n_blocks(df.agg(F.sum(F.octet_length("text"))).first()[0], range_bytes)
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = written(dealt.mapInArrow(_writer(folder, path, end), MANIFEST), "manifest")
    return running_starts(files, "number", "n_ids", "start")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids before it) and ``ids`` (little-endian unsigned 32-bit integers), after each block's checksum was tested."""
    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n).mapInArrow(_reader(), ROWS)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written and read back."""
    found = read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
