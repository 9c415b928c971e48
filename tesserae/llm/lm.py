"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

Words (runs of anything but ASCII white space, A-Z lower-cased) are encoded by a public byte-level
BPE as subword ids; an end id closes a text. One layer of causal self-attention over a window of
ids, with the last id's own part, weighs ``LATENT`` distributions over ids, so the chance of one id
needs no sum over all ids. Windows overlap: each covers ``BACK`` ids of context and scores the next
``STEP``, so every id is scored once, in batches with a mask. A word's probability is a mixture of
the attention model's (the product over its ids, ended by the chance that a new word starts) and its
share of the training words (``SHARE``); both are proper distributions over words.

Every text is split once: chunks of a bounded size become distinct words with their training counts,
and texts as places in that list of words. Counts of words and ids cover all training texts and never
pass through one task. The model learns from every id of every training text, in the windows in which
ids are scored: each chunk takes Adam steps from the same weights over its share of a round, and the
chunks' weights are averaged, ``ROUNDS`` times; after the last round every id was to be foretold once
(in a small chunk, several times). Chunks and steps grow with the texts. A round puts together only
its own windows, and both training and scoring work out ``ABREAST`` windows at a time in arrays that
stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import written
from tesserae.llm.packing import Ids, gathered, ids_of

#: Size of the model; ``KNOWN`` ids have rows of their own, the others share rows by frequency.
WIDTH, STEP, BACK, LATENT, KNOWN, SHARED = 16, 24, 8, 64, 3000, 64
#: ``chosen_windows`` gives a window for each so many words begun.
EVERY = 100
#: Ids of its first word that a training window may leave out.
MOST_SKIP = 3
#: Adam steps of a chunk in a round that are aimed at, and windows in a step, at least and at most; a window is drawn
#: once in all rounds together, or in a small chunk up to ``PASSES`` times.
ROUNDS, STEPS, BATCH, MOST_BATCH, RATE, PASSES = 4, 150, 200, 800, 0.1, 12
#: Weight of the words' shares of the training words in the mixture.
SHARE = 0.25
#: Bytes of text of a chunk; ids scored at once in a task; windows worked out side by side: what fits a core's cache.
CHUNK_BYTES, AT_ONCE, ABREAST = 12 << 20, 1 << 13, 96
END = 50256
#: An id that isn't there; ids are kept in 16 bits.
NONE = 0xFFFF
#: Words that a task reads before it hands on a row for each chunk among them.
PACK = 1 << 18
#: Floats of the weights in one row on their way to the average; bytes of a row group, more than the chunks of one file.
PART, MOST_GROUP = 1 << 16, 1 << 30


def summed(rows: np.ndarray, values: np.ndarray, out: np.ndarray, room: np.ndarray) -> None:
    """Set each row of ``out`` (of less than 2**16) to the sum of the values dealt to it; ``room`` holds as many floats as ``values``."""
    order = np.argsort(rows, kind="stable")  # numpy sorts 16 bits by radix
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    dealt = np.take(values, order, axis=0, out=room[: values.size].reshape(values.shape), mode="clip")
    out[:] = 0
    # pairs of floats as one number: half as many sums
    out[rows[first]] = np.add.reduceat(dealt.view(np.complex64), first).view(np.float32)


def bounded(x: np.ndarray) -> None:
    """Keep the exponentials of ``x`` finite."""
    if not x.max(initial=0) <= 60:
        np.minimum(x, 60, out=x)


class Model:
    """Weights of the attention layer, and the rows of ids."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, seed: int = 5):
        """``counts``: training occurrences by id; ``starts``: whether an id starts a word (the end does)."""
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        self.row = np.zeros(len(counts), np.int32)
        self.row[order[:KNOWN]] = np.arange(min(KNOWN, len(counts)))
        for first, kind in ((KNOWN, True), (KNOWN + SHARED // 2, False)):
            rest = order[KNOWN:][starts[order[KNOWN:]] == kind]
            self.row[rest] = first + np.arange(len(rest)) * (SHARED // 2) // max(1, len(rest))
        rows, d = KNOWN + SHARED, WIDTH
        smooth = counts + 0.1
        mass = np.bincount(self.row, smooth, rows)
        self.inside = np.log(smooth / mass[self.row]).astype(np.float32)
        self.starts = np.zeros(rows, np.float32)
        self.starts[self.row[starts]] = 1
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        share = np.log(np.maximum(mass, 1e-9) / mass.sum())[:, None]
        self.w = {"e": small(rows, d), "p": small(BACK + STEP, d), "q": small(d, d) * 3, "k": small(d, d) * 3, "v": small(d, d) * 3, "o": small(d, LATENT), "c": small(rows, LATENT) * 3, "b": small(LATENT) * 0, "m": (share + 5 * small(rows, LATENT)).astype(np.float32)}
        self.causal = (np.arange(BACK + STEP)[None, :] <= BACK + np.arange(STEP)[:, None]).astype(np.float32)

    def emissions(self) -> np.ndarray:
        """The latent distributions over rows, one a column."""
        e = self.w["m"] - self.w["m"].max(0)
        np.exp(e, out=e)
        e /= np.ones(len(e), np.float32) @ e
        return e

    def projected(self) -> dict[str, np.ndarray]:
        """Queries, keys and values of each row and place, side by side: with one layer, attention needs no products of embeddings; and what the last id gives."""
        w = self.w
        every = np.concatenate([w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"]], 1)
        return {"every": every, "rows": w["e"] @ every, "places": w["p"] @ every, "c": w["c"] + w["b"]}

    def mixed(self, x: np.ndarray, ok: np.ndarray, t: dict[str, np.ndarray], room: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of windows of rows ``x`` (``ok``: those that are there), into the arrays of ``room``: queries, keys and values, attention, the inverse of its sums, its outputs, and how latent distributions weigh; neither weights sum to one."""
        n, d = len(x), WIDTH
        many, a, o = room["many"][:n], room["a"][:n], room["o"][:n]
        z, other = room["z"][: n * STEP], room["other"][: n * STEP]
        np.take(t["rows"], x, axis=0, out=many, mode="clip")
        many += t["places"]
        np.matmul(many[:, BACK:, :d], many[:, :, d : 2 * d].transpose(0, 2, 1), out=a)
        bounded(a)
        np.exp(a, out=a)
        a *= self.causal
        lacking = np.flatnonzero(~ok.all(1))
        a[lacking] *= ok[lacking, None, :]
        inverse = 1 / np.maximum(a.reshape(-1, BACK + STEP) @ np.ones(BACK + STEP, np.float32), np.float32(1e-30))
        np.matmul(a, many[:, :, 2 * d :], out=o)
        o = o.reshape(-1, d)
        o *= inverse[:, None]
        np.matmul(o, self.w["o"], out=z)
        np.take(t["c"], x[:, BACK:].ravel(), axis=0, out=other, mode="clip")
        z += other
        bounded(z)
        np.exp(z, out=z)
        return many, a, inverse, o, z

    def fit(self, windows: np.ndarray | Windows, round_: int = 0, rounds: int = 1, steps: int = STEPS, batch: int = BATCH) -> Model:
        """Adam on the cross-entropy of windows (as of ``every_window``), in one of several rounds: the rounds share all windows, each drawn once, or up to ``PASSES`` times where they are few."""
        if not len(windows):
            return self
        rng = np.random.default_rng(len(windows))
        passes = max(1, min(PASSES, steps * batch * rounds // len(windows)))
        mine = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)])[round_::rounds]
        batch = min(MOST_BATCH, max(batch, -(-len(mine) // steps)))
        steps = -(-len(mine) // batch)
        room, row, d = rooms(ABREAST), self.row_of(), WIDTH
        # weights, gradients and moments lie end to end each
        weights = self.flat()
        grads, first, second = (np.zeros_like(weights) for _ in range(3))
        self.w, g = self.cut(weights), self.cut(grads)
        w, latent = self.w, np.ones(LATENT, np.float32)
        rows = np.empty((len(w["e"]), 3 * d), np.float32)
        # of all windows of a step: gradients of queries, keys and values, of weights of latent distributions, and of these
        gmany, gz, gm = (np.zeros((batch, *size), np.float32) for size in ((BACK + STEP, 3 * d), (STEP, LATENT), (STEP, LATENT)))
        order = np.empty(max(gmany.size, gz.size), np.float32)
        turned = lambda x: x.transpose(0, 2, 1)
        for step in range(1, steps + 1):
            drawn = windows[mine[(step - 1) * batch : step * batch]]
            n, of = len(drawn), row[drawn]
            x, y, ok, on = of[:, :-1], of[:, BACK + 1 :], drawn[:, :-1] != NONE, drawn[:, BACK + 1 :] != NONE
            t, emit = self.projected(), self.emissions()
            g["o"][:] = 0
            for low in range(0, n, ABREAST):
                part = slice(low, min(n, low + ABREAST))
                z, after, gmine, real = gz[part].reshape(-1, LATENT), gm[part].reshape(-1, LATENT), gmany[part], on[part].ravel()
                many, a, inverse, o, z = self.mixed(x[part], ok[part], t, room | {"z": z, "other": after})
                q, k, v = many[:, BACK:, :d], many[:, :, d : 2 * d], many[:, :, 2 * d :]
                # gradients of the summed loss of places with a goal; Adam takes no heed of their scale
                np.take(emit, y[part].ravel(), axis=0, out=after, mode="clip")
                after *= z
                after *= (real / np.maximum(after @ latent, np.float32(1e-30)))[:, None]
                z *= (real / np.maximum(z @ latent, np.float32(1e-30)))[:, None]
                z -= after
                g["o"] += o.T @ z
                go = z @ w["o"].T
                go *= inverse[:, None]
                inner = np.einsum("nk,nk->n", go, o).reshape(-1, STEP, 1)
                go, gs = go.reshape(-1, STEP, d), room["gs"][: len(many)]
                np.matmul(go, turned(v), out=gs)
                gs -= inner
                gs *= a
                np.matmul(gs, k, out=gmine[:, BACK:, :d])
                np.matmul(turned(gs), q, out=gmine[:, :, d : 2 * d])
                np.matmul(turned(a), go, out=gmine[:, :, 2 * d :])
            z, after, each = gz[:n].reshape(-1, LATENT), gm[:n].reshape(-1, LATENT), np.ones(n * STEP, np.float32)
            summed(y.ravel(), after, g["m"], order)
            emit *= each @ after
            np.subtract(emit, g["m"], out=g["m"])
            summed(x[:, BACK:].ravel(), z, g["c"], order)
            np.matmul(each, z, out=g["b"])
            # to the tables of rows and places first, and from there to their factors
            summed(x.ravel(), gmany[:n].reshape(-1, 3 * d), rows, order)
            places = (np.ones(n, np.float32) @ gmany[:n].reshape(n, -1)).reshape(-1, 3 * d)
            np.matmul(rows, t["every"].T, out=g["e"])
            np.matmul(places, t["every"].T, out=g["p"])
            g["q"][:], g["k"][:], g["v"][:] = np.split(w["e"].T @ rows + w["p"].T @ places, 3, axis=1)
            g["q"] *= np.float32(d**-0.5)
            now = RATE * min(1, step / 20) * (1 - 0.9 * (round_ + step / steps) / rounds)
            moved(weights, grads, first, second, step, now, 1e-7 * max(1, np.count_nonzero(on)))
        return self

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([x.ravel() for x in self.w.values()])

    def take(self, flat: np.ndarray) -> Model:
        """Set all weights from one row."""
        self.w = {n: x.astype(np.float32) for n, x in self.cut(flat).items()}
        return self

    def cut(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of one row as all weights."""
        at = np.cumsum([0, *(x.size for x in self.w.values())])
        return {n: flat[low : low + x.size].reshape(x.shape) for low, (n, x) in zip(at.tolist(), self.w.items(), strict=False)}

    def row_of(self) -> np.ndarray:
        """Rows of all numbers of 16 bits; those that are no ids have the end's."""
        out = np.full(1 << 16, self.row[END], np.uint16)
        out[: len(self.row)] = self.row
        return out

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring needs beside the weights: as ``projected``, the latent distributions, and what sums them and those of starts of words."""
        emit = self.emissions()
        return self.projected() | {"m": emit, "sums": np.stack([np.ones(LATENT, np.float32), self.starts @ emit], 1)}

    def score(self, ids: np.ndarray, lengths: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each id after its text so far, and of the start of a word at its place.

        ``ids`` are texts laid end to end, each closed by the end id.
        """
        ends = np.cumsum(lengths)
        begins = ends - lengths
        goal = self.row[ids].astype(np.uint16)
        seen = np.r_[goal[:1], goal[:-1]]
        seen[begins] = self.row[END]
        per = -(-lengths // STEP)
        doc = np.repeat(np.arange(len(lengths)), per)
        at = begins[doc] + STEP * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
        got, new = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        room = rooms(min(len(at), ABREAST))
        for low in range(0, len(at), ABREAST):
            mine = slice(low, low + ABREAST)
            place = at[mine, None] + np.arange(-BACK, STEP)
            inside = (place >= begins[doc[mine], None]) & (place < ends[doc[mine], None])
            rows = np.take(seen, place, mode="clip")
            z = self.mixed(rows, inside, t, room)[-1]
            place, real = place[:, BACK:].ravel(), inside[:, BACK:].ravel()
            likely = room["other"][: len(z)]
            np.take(t["m"], np.take(goal, place, mode="clip"), axis=0, out=likely, mode="clip")
            total, starts = (z @ t["sums"]).T
            total = np.maximum(total, np.float32(1e-30))
            place = place[real]
            got[place] = np.log(np.maximum(np.einsum("nk,nk->n", z, likely) / total, 1e-30))[real]
            new[place] = np.log(np.maximum(starts / total, 1e-30))[real]
        return got + self.inside[ids], new


def rooms(n: int) -> dict[str, np.ndarray]:
    """Arrays that batches of ``n`` windows are worked out in: fresh memory for each would cost more than the sums."""
    new = lambda *s: np.empty((n, *s), np.float32)
    return {"many": new(BACK + STEP, 3 * WIDTH), "a": new(STEP, BACK + STEP), "gs": new(STEP, BACK + STEP), "o": new(STEP, WIDTH), "z": new(STEP, LATENT).reshape(-1, LATENT), "other": new(STEP, LATENT).reshape(-1, LATENT)}


def split_chunk(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of some texts: the distinct words (the empty one, last, is the end), all words as places among them with an end after each text, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    coded, owner = flat.filter(some).dictionary_encode(), owner[some.to_numpy(zero_copy_only=False)]
    long = np.bincount(owner, minlength=len(texts)) + 1
    codes = np.full(long.sum(), len(coded.dictionary), np.int32)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(long) - 1] = False
    codes[inside] = coded.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary, pa.array([""])]), codes, long


def chosen_windows(words: pa.Array, codes: np.ndarray, long: np.ndarray, train: np.ndarray, coder: Ids) -> np.ndarray:
    """Rows of ``BACK + 1 + STEP`` ids (``NONE``: none) from the training texts, one for each ``EVERY`` words begun: all but the last are seen, the last ``STEP`` are to come."""
    stops = np.cumsum(long)
    per = np.where(train, -(-long // EVERY), 0)
    doc = np.repeat(np.arange(len(long)), per)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    # evenly spread, from a place that the text's length and words decide
    turn = np.add.reduceat(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), stops - long) >> np.uint64(40) if len(long) else np.zeros(0, np.uint64)
    begin = ((inside + turn[doc] / float(1 << 24)) * (long / np.maximum(per, 1))[doc]).astype(np.int64)
    base = (stops - long)[doc]
    low, high = np.maximum(begin - BACK - 1, 0), np.minimum(begin + STEP + MOST_SKIP, long[doc])
    used, place = np.unique(codes, return_inverse=True)
    # only words of windows are encoded
    wanted = np.zeros(len(used), bool)
    for first, last in ((low, begin), (begin, high)):
        wanted[gathered(place, base + first, last - first, np.arange(len(doc)))] = True
    ids, lengths = coder.words(words.take(pa.array(used[wanted])))
    starts = np.cumsum(lengths) - lengths
    number = np.cumsum(wanted) - 1
    if len(used) and wanted[-1]:  # the end is the last word, if any window has it
        ids, lengths = np.append(ids[: starts[-1]], END), np.append(lengths[:-1], 1)

    def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each window's words from ``first`` to ``last``: their windows, places there, values, and how many a window has."""
        entry = number[gathered(place, base + first, last - first, np.arange(len(doc)))]
        owner = np.repeat(np.arange(len(doc)), last - first)
        count = np.bincount(owner, lengths[entry], len(doc)).astype(np.int64)
        return np.repeat(np.arange(len(doc)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), gathered(ids, starts, lengths, entry).astype(np.int32), count

    out = np.full((len(doc), BACK + 1 + STEP), NONE, np.uint16)
    old, new = spread(low, begin), spread(begin, high)
    # a window may begin inside a word, as windows that are scored do
    skip = np.minimum((inside + (turn[doc] >> np.uint64(4)).astype(np.int64)) % (MOST_SKIP + 1), new[3] - 1)
    for row, at, value in ((old[0], old[1] - old[3][old[0]] - skip[old[0]], old[2]), (new[0], new[1] - skip[new[0]], new[2])):
        inside = (at >= -BACK - 1) & (at < STEP)
        out[row[inside], BACK + 1 + at[inside]] = value[inside]
    opens = np.flatnonzero((low == 0) & (old[3] + skip <= BACK))
    out[opens, (BACK - old[3] - skip)[opens]] = END
    return out


def moved(weights: np.ndarray, grads: np.ndarray, first: np.ndarray, second: np.ndarray, step: int, rate: float, tiny: float) -> None:
    """One step of Adam on ``weights``, in pieces that stay in a core's cache; ``grads`` are used up, and the moments are kept as plain sums that fade."""
    spread = (0.02 / (1 - 0.98**step)) ** 0.5
    rate, tiny = np.float32(rate * 0.1 / (1 - 0.9**step) / spread), np.float32(tiny / spread)
    room = np.empty(1 << 14, np.float32)
    for low in range(0, len(weights), len(room)):
        w, g, m, v = (x[low : low + len(room)] for x in (weights, grads, first, second))
        r = room[: len(w)]
        m *= np.float32(0.9)
        m += g
        g *= g
        v *= np.float32(0.98)
        v += g
        np.sqrt(v, out=r)
        r += tiny
        np.divide(m, r, out=r)
        r *= rate
        w -= r


class Windows:
    """Windows of texts laid end to end, each closed by the end id, cut as they are scored; those asked for are put together then."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.stops = ids.astype(np.uint16), np.cumsum(lengths)
        per = -(-lengths // STEP)
        self.doc = np.repeat(np.arange(len(lengths)), per)
        self.begins = self.stops - lengths
        self.at = self.begins[self.doc] + STEP * (np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per))

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, pick: np.ndarray) -> np.ndarray:
        """Rows of ``BACK + 1 + STEP`` ids (``NONE``: none): all but the last are seen, the last ``STEP`` are to come."""
        doc = self.doc[pick]
        begin, stop, place = self.begins[doc, None], self.stops[doc, None], self.at[pick, None] + np.arange(-BACK - 1, STEP)
        rows = np.take(self.ids, place, mode="clip")
        rows[(place < begin) | (place >= stop)] = NONE
        rows[place == begin - 1] = END
        return rows


def every_window(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All windows of the texts: every id is to come in one row."""
    return Windows(ids, lengths)[np.arange(int((-(-lengths // STEP)).sum()))]


GATHERED = "block long, k int, word string, n long, doc_id long, held_out boolean, codes binary"
_KINDS = {"block": pa.int64(), "k": pa.int32(), "word": pa.string(), "n": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "codes": pa.binary()}


def _rows(size: int, **columns) -> pa.RecordBatch:
    """A batch with the given columns and nulls in the others."""
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(size, kind) for n, kind in _KINDS.items()], names=list(_KINDS))


def _gatherer():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, held_out, text) to rows of two kinds: words of a chunk, and its texts."""
        press = zstandard.ZstdCompressor(level=1)
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def gathered_rows() -> Iterator[pa.RecordBatch]:
            docs, out, texts = (pa.concat_arrays([h.column(i) for h in held]) for i in range(3))
            words, codes, long = split_chunk(texts)
            train = ~out.to_numpy(zero_copy_only=False)
            n = np.bincount(codes[np.repeat(train, long)], minlength=len(words))
            yield _rows(len(words), block=pa.array(np.full(len(words), block)), k=pa.array(np.arange(len(words), dtype=np.int32)), word=words, n=pa.array(n))
            stops = np.cumsum(long)
            packed = [press.compress(codes[a:b]) for a, b in zip((stops - long).tolist(), stops.tolist(), strict=True)]
            yield _rows(len(long), block=pa.array(np.full(len(long), block)), doc_id=docs, held_out=out, codes=pa.array(packed, pa.binary()))

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            low = 0
            for i, more in enumerate(sizes):
                size += more
                if size >= CHUNK_BYTES or i + 1 == len(sizes):
                    held.append(batch.slice(low, i + 1 - low))
                    low = i + 1
                if size >= CHUNK_BYTES:
                    yield from gathered_rows()
                    block, held, size = block + 1, [], 0
        if held:
            yield from gathered_rows()

    return run


def pack(places: np.ndarray, counts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, first: np.ndarray) -> bytes:
    """Words of one chunk in one value: steps between their ascending places there, counts, whether a row is its word's first, how many ids each has, and the ids in 16 bits."""
    steps = np.diff(places, prepend=0)
    return b"".join(x.tobytes() for x in (steps.astype("<i4"), counts.astype("<i8"), first.astype("?"), lengths.astype("<i4"), ids.astype("<u2")))


def unpack(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``pack`` was given, of ``n`` words: places, counts, lengths, ids, first."""
    part = lambda kind, at: np.frombuffer(raw, kind, n, at * n)
    return np.cumsum(part("<i4", 0)), part("<i8", 4), part("<i4", 13).astype(np.int64), np.frombuffer(raw, "<u2", offset=17 * n), part("?", 12)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, k, word, c), sorted by word, to (block, k, c, ids): of each block one row for ``PACK`` words read, with its least place, how many words it holds, and these packed; the empty word is the end."""
        coder, press, last = ids_of(path), zstandard.ZstdCompressor(level=1), None
        held, size = [], 0

        def packs() -> pa.RecordBatch:
            block, k, c, first, lengths = (np.concatenate([h[i] for h in held]) for i in range(5))
            starts, base = [], 0
            for h in held:
                starts.append(h[5] + base)
                base += len(h[6])
            starts, ids = np.concatenate(starts), np.concatenate([h[6] for h in held])
            order = np.lexsort((k, block))
            edges = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
            mine = [order[low:high] for low, high in zip(edges[:-1], edges[1:], strict=True)]
            packed = [press.compress(pack(k[at], c[at], lengths[at], gathered(ids, starts, lengths, at), first[at])) for at in mine]
            heads = np.array([at[0] for at in mine])
            return pa.RecordBatch.from_arrays([pa.array(block[heads]), pa.array(k[heads]), pa.array([len(at) for at in mine], pa.int64()), pa.array(packed, pa.binary())], names=["block", "k", "c", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(2).dictionary_encode()
            ids, lengths = coder.words(words.dictionary)
            # the empty word is the end
            empty, starts = pc.equal(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            starts[empty], lengths[empty] = len(ids), 1
            at = words.indices.to_numpy()
            first = np.r_[batch.column(2)[0].as_py() != last, at[1:] != at[:-1]]
            last = batch.column(2)[-1].as_py()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), first, lengths[at], starts[at], np.append(ids, END).astype(np.uint16)))
            size += batch.num_rows
            if size >= PACK:
                yield packs()
                held, size = [], 0
        if held:
            yield packs()

    return run


def _id_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (c, ids) of packed words to (id, n), occurrences of ids in training texts; with the ids -1 and -2: training tokens, and how many distinct ones occur there."""
        total, tokens, known, opened = np.zeros(size), 0, 0, zstandard.ZstdDecompressor()
        for batch in batches:
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, counts, lengths, ids, first = unpack(opened.decompress(packed), n)
                once = np.where(first, counts, 0)
                total += np.bincount(ids, np.repeat(once, lengths), size)
                tokens, known = tokens + int(once.sum()), known + int((once > 0).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some], pa.int32()), pa.array(np.r_[tokens, known, total[some].astype(np.int64)], pa.int64())], names=["id", "n"])

    return run


def _trainer(model: Model, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of chunks (as of ``_scorer``) to rows (part, weight, values): the sum over this task's chunks of each one's weights after the round, times its windows."""
        start, opened = model.flat(), zstandard.ZstdDecompressor()
        total, weight = np.zeros(len(start)), 0.0
        for chunk, texts in chunks_of(batches):
            held = [np.frombuffer(opened.decompress(codes), np.int32) for part in texts for codes, out in zip(part.column(6).to_pylist(), part.column(5).to_pylist(), strict=True) if not out]
            if not held:
                continue
            at = np.concatenate(held)
            lengths = np.add.reduceat(chunk.lengths[at], np.cumsum([0, *map(len, held[:-1])]))
            windows = Windows(chunk.of(at), lengths)
            total += model.take(start).fit(windows, round_, ROUNDS).flat() * np.float32(len(windows))
            weight += len(windows)
        if weight:
            parts = [total[i : i + PART].astype(np.float32).tobytes() for i in range(0, len(total), PART)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), weight)), pa.array(parts, pa.binary())], names=["part", "weight", "vals"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, weight, vals) to their sums by part, over this task's rows."""
    sums: dict[int, list] = {}
    for batch in batches:
        for part, weight, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = sums.setdefault(part, [0.0, 0.0])
            found[0] += weight
            found[1] = found[1] + np.frombuffer(raw, np.float32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()), pa.array([(v / w).astype(np.float32).tobytes() for w, v in sums.values()], pa.binary())], names=["part", "weight", "vals"])


def trained(model: Model, dealt: DataFrame) -> Model:
    """The model fitted on all training texts of the chunks: in each round every chunk starts from the average of the last."""
    parts = -(-len(model.flat()) // PART)
    for round_ in range(ROUNDS):
        new = dealt.mapInArrow(_trainer(model, round_), "part int, weight double, vals binary")
        rows = new.repartition(parts, "part").sortWithinPartitions("part", "vals").mapInArrow(_added, "part int, weight double, vals binary").collect()  # the size of the model
        if rows:
            model.take(np.concatenate([np.frombuffer(r.vals, np.float32) for r in sorted(rows, key=itemgetter(0))]))
    return model


class Chunk:
    """Words of one chunk, by their places: their training counts and ids."""

    def __init__(self, rows: list[pa.RecordBatch]):
        opened = zstandard.ZstdDecompressor()
        packs = [unpack(opened.decompress(raw), n) for part in rows for n, raw in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
        places, counts, lengths, ids = (np.concatenate([p[i] for p in packs]) for i in range(4))
        # each place has one word; words lie as their packs have them
        order = np.empty(len(places), np.int64)
        order[places] = np.arange(len(places))
        self.counts, self.lengths = counts[order], lengths[order]
        self.lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(ids)).take(pa.array(order))

    def of(self, at: np.ndarray) -> np.ndarray:
        """Ids of the words at places ``at``, laid end to end."""
        return self.lists.take(pa.array(at)).flatten().to_numpy()

    def score(self, model: Model, tables: dict, at: np.ndarray, tokens: np.ndarray, total: int, distinct: int) -> list[np.ndarray]:
        """Known tokens, base and model scores (log10) of texts given as places ``at`` of their words, ``tokens`` each; every id is scored in context."""
        c, length = self.counts[at], self.lengths[at]
        stop = np.cumsum(length)
        begin = stop - length
        bounds = np.cumsum(tokens) - tokens
        got, new = model.score(self.of(at), np.add.reduceat(length, bounds), tables)
        logs = np.add.reduceat(got.astype(np.float64), begin) - new[begin]
        # the chance that a new word starts after this one; nothing follows an end
        after = np.append(new, np.float32(0))[stop]
        after[bounds + tokens - 1] = 0
        mixed = np.log10(SHARE * c / max(1, total) + (1 - SHARE) * np.exp(logs + after))
        base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
        return [np.add.reduceat((c > 0).astype(np.int64), bounds), np.add.reduceat(base, bounds), np.add.reduceat(mixed, bounds)]


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, Iterator[pa.RecordBatch]]]:
    """Rows (block, k, c, ids, doc_id, held_out, codes), packs of words first in each block, to each block's chunk and its rows of texts, which are to be read before the next."""

    def runs() -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        for batch in batches:
            owner, is_text = batch.column(0).to_numpy(), batch.column(6).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(owner) != 0) | (np.diff(is_text.astype(np.int8)) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(owner)], strict=True):
                if low < high:
                    yield int(owner[low]), bool(is_text[low]), batch.slice(low, high - low)

    for _, mine in groupby(runs(), key=itemgetter(0)):
        kinds = groupby(mine, key=itemgetter(1))
        chunk = Chunk([part for _, _, part in next(kinds)[1]])
        yield chunk, (part for _, texts in kinds for _, _, part in texts)


def _scorer(model: Model, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of chunks to the scores of their texts."""
        tables, opened = model.tables(), zstandard.ZstdDecompressor()

        def scored(chunk: Chunk, held: list) -> pa.RecordBatch:
            at = [np.frombuffer(x[2], np.int32) for x in held]
            tokens = np.array([len(x) for x in at], np.int64)
            known, base, score = chunk.score(model, tables, np.concatenate(at), tokens, total, distinct)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.bool_()), pa.array(tokens), pa.array(known), pa.array(np.full(len(held), total, np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for chunk, texts in chunks_of(batches):
            held, size = [], 0
            for part in texts:
                for doc, out, codes in zip(*(part.column(i).to_pylist() for i in (4, 5, 6)), strict=True):
                    raw = opened.decompress(codes)
                    held.append((doc, out, raw))
                    size += len(raw)
                    if size >= AT_ONCE * 8:
                        yield scored(chunk, held)
                        held, size = [], 0
            if held:
                yield scored(chunk, held)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id`` long, ``text``); training texts are those whose id's CRC-32 isn't divisible by 10.

    A null or empty text is its end alone; a null id counts as the empty string, so it is held out;
    repeated rows count and are scored each; an empty table gives none; other columns are ignored.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    all_ = written(docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_gatherer(), GATHERED), "gathered", {"compression": "zstd"})
    words = all_.filter("k is not null").select("block", "k", "word", "n")
    # a very frequent word has one row a chunk
    summed = words.withColumn("c", F.sum("n").over(Window.partitionBy("word"))).select("block", "k", "word", "c")
    none = lambda kind: F.lit(None).cast(kind)
    book = summed.mapInArrow(_encoder(path), "block long, k int, c long, ids binary").select("block", "k", "c", "ids", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("binary").alias("codes"))
    texts = all_.filter("codes is not null").select("block", none("int").alias("k"), none("long").alias("c"), none("binary").alias("ids"), "doc_id", "held_out", "codes")
    blocks = all_.filter("codes is not null").agg(F.count_distinct("block")).first()[0]
    # a chunk is trained and scored where it lies, so it must lie in one row group of one file
    dealt = written(book.union(texts).repartition(max(1, blocks), "block").sortWithinPartitions("block", F.col("codes").isNotNull(), "k"), "chunks", {"parquet.block.size": str(MOST_GROUP), "compression": "zstd"})

    coder = Ids(path)
    ids = coder.tokenizer.get_vocab_size()
    if ids > NONE:
        raise ValueError(f"{path}: more ids than 16 bits hold")
    counts, total, known = np.zeros(ids), 0, 0
    for row in dealt.filter("ids is not null").select("c", "ids").mapInArrow(_id_counts(ids), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # an id each at most
        if row.id == -1:
            total = row.n
        elif row.id == -2:
            known = row.n
        else:
            counts[row.id] = row.n
    starts = coder.leads.copy()
    starts[END] = True
    model = trained(Model(counts, starts), dealt)
    return dealt.mapInArrow(_scorer(model, total, known), SCORES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
