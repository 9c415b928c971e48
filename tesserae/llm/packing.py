"""Packing: order-preserving dynamic programming over window cuts.

Documents stay in order of their id. The stream of tokens of a block of documents is cut into
windows of at most ``window`` tokens; cuts lie at document or sentence ends, and a dynamic
programme with a monotone queue picks the cuts whose padding plus penalties are least. Spark deals
documents to ranges of the id (equal ids by a hash of the text); each range is tokenized and cut
inside a task, about ``BLOCK_BYTES`` of text at a time, so nothing larger is ever held.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import give_back, n_blocks

WINDOW, END_ID, BLOCK_BYTES = 2048, 1, 8 << 20
#: In tokens of padding: a cut at a document's end, at a sentence's end, and inside a sentence that is longer than a window.
AT_DOCUMENT, AT_SENTENCE, INSIDE = 0, 16, 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
#: A space next to other white space or to an end of the text need not start a token.
_ODD_TEXT, _ODD_WORD = rf"^ | $|{_WHITE} | {_WHITE}", rf"^$|^{_WHITE}|{_WHITE}$"


class Ids:
    """Token ids of texts, as a call of the tokenizer without further arguments than ``add_special_tokens=False`` gives them.

    Texts are cut at their spaces, each of which starts a token, and each distinct piece is encoded
    once a batch. Ranks are the ids, which the file's merges must follow. Added tokens
    (``<|endoftext|>``) that stand in a text become their own ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        vocab, merges = known["model"]["vocab"], known["model"]["merges"]
        ranks = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if ranks != sorted(ranks):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self.added = [(t["content"], t["id"]) for t in known["added_tokens"]]
        # byte-level BPE names a byte by its own character if that prints, the others count on from 256
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        letters = {chr(b if b in prints else next(others)): b for b in range(256)}
        named = {bytes(letters[c] for c in token): i for token, i in vocab.items() if (token, i) not in self.added}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=named, special_tokens={})
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.leads[[i for token, i in named.items() if token[:1] == b" "]] = True

    def one(self, text: str) -> np.ndarray:
        """Ids of one text of any kind."""
        for content, number in self.added:
            if content in text:
                first, *others = (self.one(part) for part in text.split(content))
                return np.concatenate([first, *(x for ids in others for x in (np.array([number], np.uint32), ids))])
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (strings without spaces), each as after a space, laid end to end; and how many each has."""
        words = words.cast(pa.string())
        odd = pc.match_substring_regex(words, _ODD_WORD).to_numpy(zero_copy_only=False)
        rest = words.filter(pa.array(~odd))
        found, lengths = np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        if len(rest):
            line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), " ")[0].as_py()
            found = self.fast.encode_to_numpy(" " + line, disallowed_special=())
            lengths[~odd] = np.diff(np.append(np.flatnonzero(self.leads[found]), len(found)))
        if odd.any():
            alone = [self.fast.encode_to_numpy(" " + w, disallowed_special=()) for w in words.filter(pa.array(odd)).to_pylist()]
            starts = np.cumsum(lengths) - lengths
            found = np.insert(found, np.repeat(starts[odd], [len(a) for a in alone]), np.concatenate(alone))
            lengths[odd] = [len(a) for a in alone]
        return found, lengths

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (null: empty), laid end to end without ends; and how many each has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD_TEXT)
        for content, _ in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        alone = [self.one(t) for t in texts.filter(odd).to_pylist()]
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        begins, flat = cut.offsets.to_numpy()[:-1], cut.flatten().dictionary_encode()
        entry = flat.indices.to_numpy().astype(np.int64)
        known, lengths = self.words(flat.dictionary)
        # a text's first piece has no space before it
        first = flat.take(pa.array(begins)).dictionary_decode().dictionary_encode()
        firsts = [self.fast.encode_to_numpy(t, disallowed_special=()) for t in first.dictionary.to_pylist()]
        entry[begins] = len(lengths) + first.indices.to_numpy()
        entry[begins[odd.to_numpy(zero_copy_only=False)]] = len(lengths) + len(firsts) + np.arange(len(alone))
        lengths = np.concatenate([lengths, np.array([len(x) for x in (*firsts, *alone)], np.int64)])
        known = np.concatenate([known, *firsts, *alone])
        return gathered(known, np.cumsum(lengths) - lengths, lengths, entry), np.add.reduceat(lengths[entry], begins) if len(begins) else np.zeros(0, np.int64)

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its text ends a sentence or a line."""
        n = self.tokenizer.get_vocab_size()
        return np.array([t.rstrip("\"')").endswith((".", "!", "?", "\n", "。")) for t in (self.tokenizer.decode([i], skip_special_tokens=False) for i in range(n))])


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that ``entry`` names, laid end to end."""
    long = lengths[entry]
    stops = np.cumsum(long)
    return values[np.repeat(starts[entry] - (stops - long), long) + np.arange(stops[-1] if len(stops) else 0)]


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's own tokenizer, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The least-cost chain of cuts from 0 to the last place.

    ``places`` ascend from above 0, no two more than ``window`` apart; a window costs its padding
    plus the penalty of the cut that ends it. ``cost[j] = window - places[j] + penalty[j] +
    min(cost[i] + places[i])`` over the places within reach, kept in a monotone queue.
    """
    at, pay = [0, *places.tolist()], [0, *penalty.tolist()]
    came = [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        best, came[j] = queue[0]
        value = best + window + pay[j]  # cost[j] + places[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chain, j = [], len(at) - 1
    while j:
        chain.append(at[j])
        j = came[j]
    return chain[::-1]


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, with penalties: document ends, sentence ends, and inside what is longer than a window."""
    kind = np.full(len(ids) + 1, -1, np.int32)
    kind[np.flatnonzero(ends[ids]) + 1] = AT_SENTENCE
    kind[doc_ends] = AT_DOCUMENT
    places = np.flatnonzero(kind[1:] >= 0) + 1
    for k in np.flatnonzero(np.diff(places, prepend=0) > window):
        low = places[k - 1] if k else 0
        kind[low + window // 4 : places[k] : window // 4] = INSIDE
    places = np.flatnonzero(kind[1:] >= 0) + 1
    return places, kind[places]


def pack_block(names: pa.Array, ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, number: int, window: int = WINDOW) -> tuple[list, int]:
    """Columns of the pieces of some documents, whose sequences are numbered from ``number``, and the next number.

    ``ids`` are the documents' without their ends, ``lengths`` how many each has.
    """
    doc_ends = np.cumsum(lengths + 1)
    closed = np.full(len(ids) + len(lengths), END_ID, "<u4")
    inside = np.ones(len(closed), bool)
    inside[doc_ends - 1] = False
    closed[inside] = ids
    chain = np.array(best_cuts(*candidate_cuts(closed, doc_ends, ends, window), window), np.int64)
    stops = np.union1d(chain, doc_ends)
    starts = np.concatenate(([0], stops[:-1]))
    doc, seq = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(chain, starts, "right")
    view = memoryview(closed.tobytes())
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    begin = doc_ends - lengths - 1
    return [names.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (starts - begin[doc], stops - starts, crc, lengths[doc] + 1, number + seq, starts - np.concatenate(([0], chain))[seq]))], number + len(chain)


def _packer(path: str, window: int, most: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) in order to pieces; a task holds about ``most`` bytes of text at once, however long its range is."""
        give_back()  # what an earlier stage has left in this worker
        coder, ends, number, held, size = ids_of(path), None, TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            docs, texts = (pa.concat_arrays([h.column(i) for h in held]) for i in range(2))
            columns, number = pack_block(docs, *coder.of(texts), ends, number, window)
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            ends = coder.sentence_ends() if ends is None else ends
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            low = 0
            for i, more in enumerate(sizes):
                size += more
                if size >= most or i + 1 == len(sizes):
                    held.append(batch.slice(low, i + 1 - low))
                    low = i + 1
                if size >= most:
                    yield packed()
                    held, size = [], 0
                    give_back()
        if held:
            yield packed()
            held.clear()
        give_back()

    return run


def pack(df: DataFrame, path: str | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The pieces of all rows of ``df`` (``doc_id`` long, ``text``), cut into sequences of at most ``window`` tokens.

    A null text is empty and leaves its end token alone; a null id comes first; repeated rows are
    packed each; other columns are ignored; an empty table gives no pieces. Order is by id, then
    by a hash of the text. A sequence's number is its range's, times 2**32, plus its place there.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    total = df.agg(F.sum(F.octet_length("text"))).first()[0]
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(n_blocks(total, block_bytes), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.select("doc_id", "text").mapInArrow(_packer(path, window, block_bytes), PIECES)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(docs)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens at most."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
