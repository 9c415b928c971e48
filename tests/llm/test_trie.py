"""The conversation trie against its SQL and a plain version."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from oracle import connect, rows_of, rows_of_sql

from tesserae.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            below[key[:-1]] += 1
    for key, who in members.items():
        gain = (len(who) - 1) * len(key[-1][1].encode().split()) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in below
            saved[key[:d]] += gain
    sha = lambda who: hashlib.sha256(",".join(map(str, sorted(who))).encode()).hexdigest()
    return sorted((min(w), len(k), min(members[k[:-1]]) if k else None, len(w), below[k], leaves[k], saved[k], sha(ends[k])) for k, w in members.items())


def key(row):
    return tuple(-1 if x is None else x for x in row)


def run(spark, found, **more):
    got = trie.prefix_trie(spark.createDataFrame(found, SCHEMA).repartition(3), **more)
    assert got.columns == trie.NODES
    return sorted(map(tuple, got.collect()), key=key)


def test_op11(spark, data):
    got = rows_of(trie.op11_prefix_trie(spark, data))
    assert got == rows_of_sql(connect(data), trie.OP11_SQL)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, trie.op11_prefix_trie(spark, data).collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("band, rows", [(2, 7), (3, 40)])
def test_deep_and_hot(spark, band, rows):
    """Long conversations that part at many depths, over several ranges and bands; one holds a third of all rows."""
    rng = random.Random(band)
    found = [(c, t, "u", rng.choice(["a b", "c", "a b"]) if t > 2 else "same start") for c in range(0, 60, 3) for t in range(rng.randint(0, 9))]
    trunk = [("u", f"w{t % 5} x") for t in range(37)]
    for c in range(100, 119):
        cut = rng.randint(5, 37)
        found += [(c, t, *x) for t, x in enumerate(trunk[:cut])] + [(c, cut + t, "v", f"{c % 4} {t}") for t in range(rng.randint(0, 3))]
    found += [(40, t, "r", f"{t % 3}") for t in range(200)]
    rng.shuffle(found)
    assert run(spark, found, band=band, rows=rows) == sorted(brute(found), key=key)


def test_hard_rows(spark):
    """Null turns, roles, texts and ids, ties, repeated rows, an absent base, conversations left without turns, negative ids."""
    rows = [(None, 1, "u", "x"), (21, 1, "u", "a"), (22, None, None, None), (22, 1, "u", "b"), (22, 1, "a", "b"), (22, 1, "u", "b"), (5, 0, "u", "five"), (0, None, None, "z"), (-7, 1, "u", "neg"), (-7, 2, "u", " \t"), (400, 0, "u", "w " * 40_000), (401, 0, "u", "w " * 40_000)]
    rows += [(c, 0, "u", "only") for c in range(60, 70)]
    assert run(spark, rows) == sorted(brute(rows), key=key)
    assert run(spark, []) == [] and run(spark, [(None, 0, "u", "x")]) == []
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as owner", "2 as conv", "3 as words")
    assert sorted(map(tuple, trie.prefix_trie(more).collect()), key=key) == sorted(brute(rows), key=key)
