"""Phrase mining against its SQL and a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, rows_of, rows_of_sql

from tesserae.llm import phrases

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, least=30):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                count.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {g: a for g, a in count.items() if len(g) > 2 and a >= least}
    longer = Counter()
    for (lang, *words), a in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                g = (lang, *words[i : i + k])
                longer[g] = max(longer[g], a)
    found = defaultdict(list)
    for g, a in often.items():
        lang, words = g[0], g[1:]
        score, _, l, r = min((2_000_000 * a // (count[lang, *words[:k]] + count[lang, *words[k:]]), k, count[lang, *words[:k]], count[lang, *words[k:]]) for k in range(1, len(words)))  # noqa: E741
        if 100 * longer[g] < 80 * a:
            found[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def run(spark, rows, **more):
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), **more)
    assert got.columns == phrases.COLUMNS
    return sorted(map(tuple, got.collect()))


def test_op13(spark, data):
    got = phrases.op13_phrase_collocations(spark, data)
    assert rows_of(got) == rows_of_sql(connect(data), phrases.OP13_SQL)
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_chunks_overlap_and_count_once():
    """Own parts cover each word once; overlaps go on for three words at most, never into the next piece; equal passages give equal chunks."""
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randint(0, 400)}" + rng.choice(["", "", "", ".", ","]) for _ in range(900))
    texts = [f"start {passage} end", f"other words here, {passage}", "w " * 3000, "", "a"]
    import pyarrow as pa

    raw, offsets = phrases._buffer(pa.array(texts, pa.string()))
    words = phrases.Words(raw, offsets)
    assert [bytes(raw[a:b]).decode() for a, b in zip(words.begin, words.end, strict=True)] == [w for t in texts for w in re.findall(r"[^ .,]+", t)]
    at, stop, after = words.chunks()
    assert at[0] == 0 and (at[1:] == stop[:-1]).all() and stop[-1] == len(words.begin)
    assert (after - stop <= phrases.OVERLAP).all() and (stop - at <= phrases.MOST_OWN).all() and (after > stop).any()
    assert all(not words.starts[stop[k] : after[k]].any() for k in range(len(at)))
    own = [bytes(raw[words.begin[a] : words.end[b - 1]]) for a, b in zip(at, stop, strict=True)]
    assert sum(c == 2 for c in Counter(own).values()) > 10


@pytest.mark.parametrize("part_bytes", [200, 5000])
def test_small_parts(spark, monkeypatch, part_bytes):
    """Long texts cut at separators, flushes of keys, triggers everywhere: the counts stay."""
    rng = random.Random(part_bytes)
    vocabulary = ["New", "york", "city", "of", "the", "été", "l'eau", "日本", "x"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", " ,\t"]) for _ in range(rng.randint(0, 900)))) for _ in range(25)]
    rows += [("en", "of the york " * 400), ("en", "no separators at all " * 60)]
    for name, value in (("PART_BYTES", part_bytes), ("PART_KEYS", 100), ("EVERY", 3), ("MOST_OWN", 17)):
        monkeypatch.setattr(phrases, name, value)
    import pyarrow as pa

    parsed = list(phrases._parse(iter([pa.RecordBatch.from_pydict({"lang": [x or "und" for x, _ in rows], "text": [t for _, t in rows]})])))
    chunks = Counter((lang, own, over) for b in parsed for lang, own, over in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    batch = pa.RecordBatch.from_pydict({"lang": [k[0] for k in chunks], "text": [" ".join(k[1:]) for k in chunks], "own": pa.array([len(k[1].encode()) for k in chunks], pa.int32()), "times": list(chunks.values())})
    got = Counter()
    for b in phrases._word_counter(iter([batch])):
        for lang, word, times in zip(*(b.column(n).to_pylist() for n in ("lang", "word", "times")), strict=True):
            got[lang, word] += times
    want = Counter((x or "und", w) for x, t in rows for w in re.findall(r"[^\x20\x09.,]+", t.translate(ASCII)))
    assert got == want
    full = type("Filter", (), {"value": np.full(1 << phrases.BLOOM_BITS - 6, 0xFFFFFFFFFFFFFFFF, np.uint64)})
    grams = Counter()
    for b in phrases._gram_counter(full)(iter([batch])):
        for size, times in zip(b.column("size").to_pylist(), b.column("times").to_pylist(), strict=True):
            grams[size] += times
    pieces = [re.findall(r"[^\x20\x09]+", p) for _, t in rows for p in re.split(r"[.,]", t)]
    assert grams == Counter({k: sum(max(0, len(p) - k + 1) for p in pieces) for k in (2, 3, 4)})
    pairs = sum(t for b in phrases._pair_counter(full)(iter([batch])) for t in b.column("times").to_pylist())
    assert pairs == grams[2]


def test_hard_rows(spark, hard, nothing):
    """Null languages and texts, ties, repeated rows, a hot language, long texts, clashing names; no rows."""
    rng = random.Random(1)
    rows = [(r.lang, r.text) for r in hard.collect()] + [(None, "Big data, big DATA; big\x0bdata\tbig  data. " * 12)] * 4 + [("", "a b c d e"), ("de", "a b c d. a b c. a b! a b c d e? x a b"), ("de", None)] * 35
    rows += [("en", " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for _ in range(40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, top=3, least=50) == brute(rows, 3, 50)
    assert sorted(map(tuple, phrases.collocations(hard).collect())) == brute([(r.lang, r.text) for r in hard.collect()])
    assert phrases.collocations(nothing).count() == 0


def test_scores_are_exact(spark):
    """Products beyond 64 bits, floors at whole numbers."""
    cases = [(9_223_372_036_854, 9_223_372_036_855, 9_223_372_036_900), (30, 30, 30), (1 << 50, 1 << 51, (1 << 51) + 1), (7, 3_000_000, 11_000_000)]
    frame = spark.createDataFrame(cases, "a long, l long, r long")
    got = [x[0] for x in frame.select(phrases._scored(*(frame[c] for c in "alr"))).collect()]
    assert got == [2_000_000 * a // (l + r) for a, l, r in cases]
