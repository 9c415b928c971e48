"""Suffix-array dedup and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import components, jaccard, suffixes


def brute_cut(texts, length=200):
    counts = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        out.append((len(b), hit.count(1), len([x for x in bytes(hit).split(b"\0") if x]), hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return out


def cut_rows(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    got = suffixes._with_ranges(df).select("doc_id", "text", "ranges").mapInArrow(suffixes._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return [tuple(r)[1:] for r in got.orderBy("doc_id").collect()]


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß ", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, texts = text(60), []
    for _ in range(12):
        a, b = text(rng.randint(0, 80)), text(rng.randint(0, 80))
        cut = rng.randint(0, len(passage) // 2)
        texts.append(a + passage[cut : cut + rng.randint(80, 260)] + b)
    return [*texts, texts[0], texts[3][:150], "ab" * 400, "x" * 200, "x" * 199, None, "", text(40) * 3]


def test_cut_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TASK_BYTES", 3000)
    for seed in (1, 2):
        texts = planted(seed)
        assert cut_rows(spark, texts) == brute_cut([(t or "").encode() for t in texts])


def test_op2(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = suffixes.op2_suffix_array_dedup(spark, data).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_cut([(r.text or "").encode() for r in docs]) and [r.doc_id for r in got] == [r.doc_id for r in docs]


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BYTES", 0)
    texts = planted(6)
    assert cut_rows(spark, texts) == brute_cut([(t or "").encode() for t in texts])


def test_long_text_in_parts(monkeypatch, spark):
    monkeypatch.setattr(suffixes, "PART", 512)
    texts = planted(3)
    buf = np.frombuffer(("".join(t or "" for t in texts)).encode(), np.uint8)
    anchor, run, low, n = suffixes.runs(buf, np.ones(len(buf), bool))
    assert n.sum() == len(buf) - suffixes.LENGTH + 1 and (low[1:] == low[:-1] + n[:-1]).all()


def test_levels_merge_geometrically():
    family = suffixes.Levels()
    for k in range(8):
        family.add(np.arange(4, dtype=np.uint64) + 4 * (k % 7), np.zeros(4, np.uint64), np.zeros(4, bool))
    assert len(family.levels) == 1 and sorted(np.flatnonzero(family.repeated)) == [0, 1, 2, 3, 28, 29, 30, 31]


def test_cut_hard(spark, hard, nothing):
    got = suffixes.without_repeats(spark, hard, "")
    assert got.schema.names == hard.columns
    assert {r.doc_id for r in got.collect()} >= {1, 2, 5, 6} and suffixes.without_repeats(spark, nothing, "").count() == 0


def grams(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(texts):
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng, texts = random.Random(4), []
    for size in (3, 9, 10, 11, 19, 20, 40, 130, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(0, max(2, size // 25))) for _ in range(14)] + [" ".join(base[: size - size // 20]), " ".join(base).upper()]
    texts += [None, "", " ", "a", "A", "a b", "a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert [(r.n, r.component_id) for r in jaccard.similar_groups(df).orderBy("doc_id").collect()] == brute_groups(texts)


@pytest.mark.parametrize("least", [(90, 100), (80, 100)])
def test_similar_sets_share_a_rare_gram_and_pass_the_parities(least):
    rng = np.random.default_rng(5)
    part, whole = least
    counted = rng.integers(0, 9, 1 << 10).astype(np.uint32)
    for size in (1, 2, 9, 10, 18, 20, 57, 200, 999, 5000):
        for _ in range(20):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            drop = rng.integers(0, size * (whole - part) // whole + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)])
            if whole * (size - drop) < part * (size + drop):
                b = a[drop:]
            if whole * len(np.intersect1d(a, b)) < part * len(np.union1d(a, b)):
                continue
            pair = [np.unique(a), np.unique(b)]
            owner, hashed = np.repeat([0, 1], [len(x) for x in pair]), np.concatenate(pair)
            o, signs = jaccard.rarest(owner, hashed, 2, least, counted)
            assert set(signs[o == 0]) & set(signs[o == 1])
            assert jaccard.maybe_near(np.array([len(x) for x in pair]), jaccard.parities(owner, hashed, 2), least)[0, 1]


def test_unlike_sets_are_told_apart():
    rng = np.random.default_rng(6)
    for size in (10, 12, 25, 400):
        owner, hashed = np.repeat(np.arange(300), size), rng.integers(0, 2**63, 300 * size).astype(np.uint64)
        order = np.lexsort((hashed, owner))
        o, signs = jaccard.rarest(owner, hashed[order], 300, (90, 100), np.zeros(1 << 10, np.uint32))
        assert len(np.unique(signs)) == len(signs)
        near = jaccard.maybe_near(np.full(300, size), jaccard.parities(owner, hashed[order], 300), (90, 100))
        assert near.sum() == 300 if size > 10 else near.sum() < 400


def test_stage_keeps_one_of_each_group_at_80_of_five_words(spark, monkeypatch):
    rng, texts = random.Random(7), []
    for size in (4, 5, 6, 12, 40, 130, 400, 1500):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base[: size - size // 10]), " ".join(base[: size - size * 3 // 10])]
        for edits in range(1, 7):  # edits apart from each other, each in five n-grams of five words
            words = list(base)
            for k in range(min(edits * max(1, size // 130), size)):
                words[(k * 37 + 11 * edits) % size] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["a", "A", "a b", "a b c"]
    sets = [grams(t, 5) for t in texts]
    label = list(range(len(texts)))
    between = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = grams(texts[i]), grams(texts[j])
                between += 100 * len(x & y) < 90 * len(x | y)
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if z == old else z for z in label]
    assert between > 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for chunk in (1024, 4):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        assert sorted(r.doc_id for r in jaccard.one_of_each_group(spark, df, "").collect()) == sorted(set(label))


def test_groups_hard(spark, hard, nothing):
    rows = jaccard.similar_groups(hard).collect()
    assert len(rows) == hard.count() and jaccard.similar_groups(nothing).count() == 0
    kept = jaccard.one_of_each_group(spark, hard, "")
    assert kept.columns == hard.columns and [r.doc_id for r in kept.filter(F.col("text").startswith("a b")).collect()] == [1]
    assert jaccard.one_of_each_group(spark, nothing, "").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 50), (50, 45), (60, 60)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 45: 40, 50: 40, **{100 + i: 100 for i in range(40)}}
