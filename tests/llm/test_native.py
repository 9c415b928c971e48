"""Sharding, quality rules and fingerprints against brute force."""

import hashlib
import re
import statistics
import zlib
from collections import Counter

import pytest
from oracle import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from tesserae.llm import fingerprint, quality, sharding
from tesserae.llm.registry import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(connect(data), SQL[name])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4099])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or got != sorted(got)


def test_op1(spark, data):
    rows = sharding.op1_sharding(spark, data).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in docs.items()}
    check_places(rows, 16)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op1_sharding(spark, data).collect()))


def check_places(rows, shards, shard="shard", slot="slot"):
    counts = Counter(r[shard] for r in rows)
    assert max(counts.values()) - min(counts.get(i, 0) for i in range(shards)) <= 1
    for s in counts:
        assert sorted(r[slot] for r in rows if r[shard] == s) == list(range(counts[s]))


def test_sharding_hard(hard, nothing):
    got = sharding.shard_rows(hard, 4)
    assert got.columns == [*hard.columns, "_shard", "_slot"]
    check_places(got.collect(), 4, "_shard", "_slot")
    assert got.count() == hard.count() and sharding.shard_rows(nothing, 4).count() == 0


def brute_counts(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_hard(hard, nothing):
    rows = quality.judge(hard).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r._kept)
    assert quality.judge(nothing).count() == 0


def test_quality_keeps_good_and_drops_bad(spark, data):
    judged = quality.judge(spark.read.parquet(f"{data}/documents.parquet")).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in judged if r.quality], [r.kept for r in judged if not r.quality]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op7(spark, data, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", 50_000)
    rows = {r.doc_id: r for r in fingerprint.op7_fingerprint(spark, data).collect()}
    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    errors, seen = [], {}
    for i, r in enumerate(docs):
        after, m = docs[(i + 1) % len(docs)].text, len(r.text) // 3
        edited, x = r.text[: len(r.text) - m] + after[:m], rows[r.doc_id]
        assert x.n_chars == len(r.text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(r.text, x.fingerprint) == x.fingerprint and 0 <= x.near_edited <= 1
        errors += [x.near_edited - jaccard(shingles(r.text), shingles(edited)), x.near_next - jaccard(shingles(r.text), shingles(after))]
    assert len(rows) == len(docs) and abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.04


def test_fingerprint_hard(hard):
    got = hard.select("text", fingerprint.fingerprint(F.col("text")).alias("f")).collect()
    for r in got:
        assert r.f == "" if not WORD.search(r.text or "") else len(r.f) == 2 * fingerprint.BINS
    paired = fingerprint.with_next(hard.select("doc_id", "text"), "doc_id", ["text"], 100_000, 700_000)
    assert paired.count() == hard.count()


def test_next_of_one_row(spark):
    one = spark.createDataFrame([(5, "x")], "k long, text string")
    assert [tuple(r) for r in fingerprint.with_next(one, "k", ["text"], 10, 1).collect()] == [(5, "x", "x")]


def test_next_keeps_columns_of_any_name(spark, nothing):
    names = ["text", "k", "head", "host", "_h", "home", "guest", "tie", "bucket", "mine", "homes"]
    df = spark.createDataFrame([(str(i), i, *"abcdefghi") for i in range(9)], ", ".join(f"{n} {'long' if n == 'k' else 'string'}" for n in names))
    got = fingerprint.with_next(df, "k", ["text"], 2, 20).orderBy("k")
    assert got.columns == [*names, "next_text"] and [r.next_text for r in got.collect()] == ["8", *map(str, range(8))]
    assert fingerprint.with_next(nothing, "doc_id", ["text"], 10, 0).count() == 0


def test_next_beside_columns_of_its_name(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, text string, next_text string")
    got = fingerprint.with_next(df, "k", ["text"], 100, 10)
    assert got.columns == ["k", "text", "next_text", "_next_text"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", "b"), (2, "b", "y", "a")]
