"""Adaptive context-mixing range coder for token ids, many lanes of one block at a time.

A block's ids are cut into lanes of equal length that take turns: at each step every lane codes one
id. All lanes share one model, which starts afresh with each block:

* order 2 and order 1: tables from the last two ids (hashed), or the last id, to a predicted id and
  how sure the table is of it (0 to 7);
* order 0: counts of the ids so far, as slots of a fixed total; ids not met yet share the escape.

The mix of the three depends on how sure both predictions are: for each such state the weights
follow the share of ids that each order got right. A range coder (48 bits of range, words of 16
bits, carries kept) codes which order is right and, where none of the tables is, the id by order 0.
Encoder and decoder take the same integer steps; tables learn after each step, weights and counts
after some steps.
"""

from __future__ import annotations

import numpy as np

#: Most lanes of a block, and the fewest steps that a lane should have.
LANES, STEPS = 8192, 256
#: Ids are below this; one more symbol is the escape.
IDS = 1 << 16
_W, _S = 12, 18  # bits of the weights' total and of the slots' total
_TABLE = 18  # bits of the order-2 table
_SURE = 7
#: The range is at most the top and, between steps, at least the least: quotients of two such numbers are exact as doubles.
_TOP, _LEAST = np.int64(1) << 52, np.int64(1) << 36
_LOW = (np.int64(1) << 36) - 1
#: What a table's entry gains, by whether it was right (8) and how sure it was: one more, or two less.
_GAIN = np.array([0, -1, *[-2] * 6, *[1] * 7, 0], np.int32) << 16


def lanes_of(n: int) -> int:
    """How many lanes ``n`` ids take."""
    return max(1, min(LANES, n // STEPS))


class Model:
    """Predictions for all lanes of a block; both directions call the same methods in the same order."""

    def __init__(self, lanes: int):
        self.a = self.b = np.zeros(lanes, np.int32)
        self.first = np.zeros(IDS, np.int32)
        self.second = np.zeros(1 << _TABLE, np.int32)
        self.hits = np.zeros((128, 3), np.int64)
        self.hits[:] = (1, 1, 2)
        self.counts = np.zeros(IDS + 1, np.int64)
        self.fresh: list[np.ndarray] = []
        self.states: list[np.ndarray] = []
        self.step, self.due = 0, 1
        self._weigh()
        self._slot()

    def _weigh(self) -> None:
        """Weights of the three kinds for each state, each at least 1 of their total."""
        total = self.hits.sum(1, keepdims=True)
        share = 1 + self.hits * ((1 << _W) - 3) // total
        share[:, 2] += (1 << _W) - share.sum(1)
        low = np.zeros((128, 4), np.int64)
        low[:, 1:3] = np.cumsum(share, 1)[:, :2]
        wide = np.ones((128, 4), np.int64)
        wide[:, :3] = share
        self.low, self.wide = low.ravel(), wide.ravel()
        self.cut1, self.cut2 = low[:, 1].copy(), low[:, 2].copy()

    def _slot(self) -> None:
        """Slots of the ids met so far and of the escape."""
        met = np.flatnonzero(self.counts)
        part = self.counts[met]
        free = (1 << _S) - len(met) - 1
        share = 1 + part * free // (part.sum() + max(1, len(met) // 4))
        met, share = np.append(met, IDS), np.append(share, 0)
        share[-1] = (1 << _S) - share.sum()
        self.begin, self.size = np.zeros(IDS + 1, np.int64), np.zeros(IDS + 1, np.int64)
        self.begin[met], self.size[met] = np.cumsum(share) - share, share
        self.at = np.repeat(met.astype(np.int32), share)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that order 2 and order 1 predict, and the state of the mix."""
        self.slot = ((self.a * np.int32(40503) ^ self.b * np.int32(-1640531535)) >> np.int32(7) & np.int32((1 << _TABLE) - 1)).astype(np.int64)
        self.last = self.a.astype(np.int64)
        self.two, self.one = self.second.take(self.slot, mode="clip"), self.first.take(self.last, mode="clip")
        id2, id1 = self.two & np.int32(IDS - 1), self.one & np.int32(IDS - 1)
        state = (self.two >> np.int32(16) << np.int32(3)) + (self.one >> np.int32(16)) + ((id2 == id1).view(np.int8) << np.int32(6))
        return id2, id1, state.astype(np.int64)

    def learn(self, ids: np.ndarray, place: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """Take in one step: its ids, the entry (state and kind) that each was coded by, and whether order 2 and order 1 were right."""
        for table, at, was, right in ((self.second, self.slot, self.two, right2), (self.first, self.last, self.one, right1)):
            key = (was >> np.int32(16)) + (right.view(np.int8) << np.int32(3))
            new = was + _GAIN.take(key, mode="clip")
            lost = np.flatnonzero(key == 0)
            new[lost] = ids[lost] + np.int32(1 << 16)
            table[at] = new
        self.states.append(place)
        self.fresh.append(ids)
        self.b, self.a = self.a, ids
        self.step += 1
        if self.step == self.due:
            self.hits += np.bincount(np.concatenate(self.states), minlength=512).reshape(128, 4)[:, :3] * 8
            self.hits -= self.hits >> 4
            np.maximum(self.hits, 1, out=self.hits)
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=IDS + 1)
            self.fresh, self.states = [], []
            self._weigh()
            self._slot()
            self.due += min(16, self.step)


def encode(ids: np.ndarray) -> np.ndarray:
    """The words (16 bits each) of one block of ids (below 2**16)."""
    if not len(ids):
        return np.zeros(0, np.uint16)
    lanes = lanes_of(len(ids))
    steps = -(-len(ids) // lanes)
    full = np.zeros(lanes * steps, np.int32)
    full[: len(ids)] = ids
    grid = np.ascontiguousarray(full.reshape(lanes, steps).T)
    model = Model(lanes)
    low, wide = np.zeros(lanes, np.int64), np.full(lanes, _TOP)
    who, what = [], []

    def shift(some: np.ndarray) -> None:
        """Those lanes give out their highest word, a carry into the word before it included."""
        top = low.take(some, mode="clip")
        who.append(some.astype(np.uint16))
        what.append((top >> 36).astype(np.int32))
        low[some] = (top & _LOW) << 16
        wide[some] = wide.take(some, mode="clip") << 16

    for now in grid:
        id2, id1, state = model.predict()
        right2, right1 = id2 == now, id1 == now
        kind = (1 - right2.view(np.int8)) * (2 - right1.view(np.int8))
        place = (state << 2) + kind
        part = wide >> _W
        low += part * model.low.take(place, mode="clip")
        wide = part * model.wide.take(place, mode="clip")
        rest = np.flatnonzero(kind == 2)
        here = now.take(rest, mode="clip").astype(np.int64)
        size = model.size.take(here, mode="clip")
        new = np.flatnonzero(size == 0)
        here[new], size[new] = IDS, model.size[IDS]
        part = wide.take(rest, mode="clip") >> _S
        low[rest] += part * model.begin.take(here, mode="clip")
        wide[rest] = part * size
        late = rest[new]
        while len(tiny := late[wide[late] < _LEAST]):
            shift(tiny)
        part = wide[late] >> 16
        low[late] += part * now[late]
        wide[late] = part
        tiny = np.flatnonzero(wide < _LEAST)
        while len(tiny):
            shift(tiny)
            tiny = tiny[wide.take(tiny, mode="clip") < _LEAST]
        model.learn(now, place, right2, right1)
    every = np.arange(lanes)
    for _ in range(4):
        low &= (np.int64(1) << 53) - 1
        shift(every)
    return _ordered(np.concatenate(who), np.concatenate(what), lanes)


def _ordered(who: np.ndarray, what: np.ndarray, lanes: int) -> np.ndarray:
    """Words in the order in which a decoder asks for them: four of each lane, then one at each shift but the last four."""
    order = np.argsort(who, kind="stable")
    words = what[order]
    while len(over := np.flatnonzero(words > 0xFFFF)):  # a lane's first word never overflows, since its value stays below 1
        words[over] &= 0xFFFF
        words[over - 1] += 1
    count = np.bincount(who, minlength=lanes)
    begin = np.cumsum(count) - count
    head = (begin[:, None] + np.arange(4)).ravel()
    asked = np.empty(len(who), np.int64)
    asked[order] = np.arange(len(who)) + 4
    return words[np.concatenate([head, asked[: len(who) - 4 * lanes]])].astype(np.uint16)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of one block."""
    if not n:
        return np.zeros(0, np.int32)
    lanes = lanes_of(n)
    steps = -(-n // lanes)
    words = words.astype(np.int64)
    head = words[: 4 * lanes].reshape(lanes, 4)
    model, at = Model(lanes), 4 * lanes
    # the first word stands above the 36 bits that stay; of the fourth only what lies above the point counts so far
    code, wide, spare = (head[:, 0] << 36) + (head[:, 1] << 20) + (head[:, 2] << 4) + (head[:, 3] >> 12), np.full(lanes, _TOP), head[:, 3] & 0xFFF
    grid = np.empty((steps, lanes), np.int32)

    def shift(some: np.ndarray) -> None:
        """Those lanes take in 16 more bits: the 12 left of their last word and 4 of the next."""
        nonlocal at
        more = words[at : at + len(some)]
        code[some] = (code.take(some, mode="clip") << 16) + (spare.take(some, mode="clip") << 4) + (more >> 12)
        spare[some] = more & 0xFFF
        wide[some] = wide.take(some, mode="clip") << 16
        at += len(some)

    def found(code: np.ndarray, part: np.ndarray, most: int) -> np.ndarray:
        return np.minimum((code / part).astype(np.int64), most)

    for k in range(steps):
        id2, id1, state = model.predict()
        part = wide >> _W
        v = found(code, part, (1 << _W) - 1)
        kind = (v >= model.cut1.take(state, mode="clip")).view(np.int8) + (v >= model.cut2.take(state, mode="clip")).view(np.int8)
        place = (state << 2) + kind
        code -= part * model.low.take(place, mode="clip")
        wide = part * model.wide.take(place, mode="clip")
        now = id2 + (id1 - id2) * kind
        rest = np.flatnonzero(kind == 2)
        part, left = wide.take(rest, mode="clip") >> _S, code.take(rest, mode="clip")
        here = model.at.take(found(left, part, (1 << _S) - 1), mode="clip")
        wait = here.astype(np.int64)
        code[rest] = left - part * model.begin.take(wait, mode="clip")
        wide[rest] = part * model.size.take(wait, mode="clip")
        new = np.flatnonzero(here == IDS)
        late = rest[new]
        while len(tiny := late[wide[late] < _LEAST]):
            shift(tiny)
        part = wide[late] >> 16
        v = found(code[late], part, IDS - 1)
        code[late] -= part * v
        wide[late] = part
        here[new] = v
        now[rest] = here
        tiny = np.flatnonzero(wide < _LEAST)
        while len(tiny):
            shift(tiny)
            tiny = tiny[wide.take(tiny, mode="clip") < _LEAST]
        grid[k] = now
        model.learn(now, place, id2 == now, id1 == now)
    return np.ascontiguousarray(grid.T).ravel()[:n]
