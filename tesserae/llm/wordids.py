"""Ids of a BPE with word ends for batches of texts, each distinct word merged once.

The vocabulary drops white space and lower-cases, so a text is cut at its ASCII white space, and a
word's ids do not depend on its neighbours. A word of plain letters, with or without punctuation
behind it, is merged by ``tiktoken`` over the file's own merges (a zero byte stands for the end of
a word); any other word goes to ``tokenizers`` as it is.
"""

from __future__ import annotations

import json
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker remembers at most; it starts afresh beyond them.
REMEMBERED = 1 << 19
_PLAIN, _PUNCTUATION, _WORD_END = "^[a-zà-öø-ÿœ]+$", string.punctuation, "</w>"


class WordIds:
    """A tokenizer file's ids, equal to ``encode(text, add_special_tokens=False)`` for every text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # byte-level BPE names a byte by its own character if that prints, the others count on from 256
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        named = [chr(b if b in prints else next(others)) for b in range(256)]
        byte = {c: b for b, c in enumerate(named)}

        def raw(token: str) -> bytes:
            body = token.removesuffix(_WORD_END)
            return bytes(byte[c] for c in body) + b"\0" * (len(body) < len(token))

        # ranks: bytes, bytes that end a word, then the merges in their order
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = [(bytes([b]), vocab[c]) for b, c in enumerate(named)] + [(bytes([b, 0]), vocab[c + _WORD_END]) for b, c in enumerate(named)] + [(raw(t), vocab[t]) for t in merged]
        if len({r for r, _ in order}) < len(order):
            raise ValueError(f"{path}: two merges give one token")
        self.merging = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks={r: k for k, (r, _) in enumerate(order)}, special_tokens={})
        self.id_of = np.array([i for _, i in order], np.uint16)
        self.ends = np.array([r.endswith(b"\0") for r, _ in order])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.offsets = np.zeros(0, np.uint16), np.zeros(2, np.int64)

    def entries(self, words: pa.Array) -> np.ndarray:
        """For each word (any string without ASCII white space) its place in ``offsets``."""
        word = words.dictionary_encode()
        names, known = word.dictionary.to_pylist(), self.known
        at = np.array([known.get(w, -1) for w in names], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            plain = pc.match_substring_regex(word.dictionary.take(pa.array(new)), _PLAIN).to_numpy(zero_copy_only=False)
            for some, coded in ((new[plain], self._letters), (new[~plain], self._others)):
                if len(some):
                    texts, first = [names[k] for k in some.tolist()], len(self.offsets) - 1
                    ids, lengths = coded(texts)
                    known.update(zip(texts, range(first, first + len(texts)), strict=True))
                    self.flat = np.concatenate([self.flat, ids])
                    self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
                    at[some] = np.arange(first, first + len(some))
        return at[word.indices.to_numpy()]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters, laid end to end, and how many each has."""
        found = self.merging.encode_to_numpy("\0".join(words) + "\0", disallowed_special=())
        return self.id_of[found], np.diff(np.flatnonzero(self.ends[found]) + 1, prepend=0)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.array(x, np.uint16) for x in coded]), np.array([len(x) for x in coded])

    def of(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (null: empty), each closed by ``end``, laid end to end; and where each text ends."""
        if len(self.known) > REMEMBERED:
            self._forget()
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        word = cut.flatten().dictionary_encode()
        lowered = pc.ascii_lower(word.dictionary)
        stem = pc.ascii_rtrim(lowered, characters=_PUNCTUATION)
        split = pc.and_(pc.match_substring_regex(stem, _PLAIN), pc.less(pc.binary_length(stem), pc.binary_length(lowered)))
        at = split.to_numpy(zero_copy_only=False)
        # a word is one known string, or its letters and the punctuation behind them
        head = pc.if_else(split, stem, word.dictionary)
        tails = pa.array([w[len(s) :] for w, s in zip(lowered.filter(split).to_pylist(), stem.filter(split).to_pylist(), strict=True)], pa.string()).dictionary_encode()
        first = self.entries(head)
        second = np.zeros(len(first), np.int64)
        if at.any():
            second[at] = self.entries(tails.dictionary)[tails.indices.to_numpy()]
        lists = lambda places: pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pa.array(self.flat)).take(pa.array(places))
        both = lists(np.stack([first, second], 1).ravel())
        offsets = np.append(both.offsets.to_numpy()[::2], [len(both.values) + 1]).astype(np.int32)
        of_words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.append(both.values.to_numpy(), np.uint16(end))))
        stops = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        index = np.insert(word.indices.to_numpy(), stops[1:], len(word.dictionary))
        ids = of_words.take(pa.array(index))
        return ids.values.to_numpy(), ids.offsets.to_numpy()[stops[1:] + np.arange(1, len(stops))]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own tokenizer, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
