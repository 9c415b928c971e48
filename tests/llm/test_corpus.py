"""Mixing, packing, and the pipeline's stages against plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tesserae.llm import jaccard, mixing, packing, quality

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    goal, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not over:
            goal |= {s: unit * weight[s] for s in free}
            break
        goal |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(goal[s] for s in over)
        free -= over
    return goal


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30}, {"a": 100, "b": 1, "c": 1, "d": 5, None: 2}, {"x": 0, "y": 7}, {"z": 5}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([("0" if s is None else "1" + s, n) for s, n in sizes.items()], "key string, source_size long")
    got = {None if r.key == "0" else r.key[1:]: r.target for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)


def test_op9(spark, data):
    rows = mixing.op9_mixing(spark, data).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split()) and r.taken <= 3 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r.taken
        most[s] = max(most[s], r["size"])
    want = brute_targets(dict(sizes))
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_mixing(spark, data).collect()))


def test_mix_hard(spark, hard, nothing):
    got = mixing.mix(hard)
    assert got.count() == hard.count() and got.filter("mix_copies > 3 or mix_copies < 0").count() == 0 and mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(spark, hard, "").columns == hard.columns


def test_mix_sources_without_words(spark):
    """A source of empty and null texts only has target 0, and its documents are taken once."""
    rows = [(1, None, "bare"), (2, "", "bare"), (3, " \t", "bare"), (4, "a b c " * 30, "full"), (5, "d e", "full"), (6, None, None)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == 6 and all(got[i].mix_source_size == 0 and got[i].mix_target == 0 and got[i].mix_copies == 1 for i in (1, 2, 3, 6))
    assert got[4].mix_source_size == 92 and all(r.mix_size == 0 for r in map(got.get, (1, 2, 3, 6)))


def test_mix_keeps_columns_of_any_name(spark, hard):
    named = hard.select("*", *(F.lit("x").alias(n) for n in ("mix_copies", "mix_size", "_mix_key", "_mix_t", "copy", "key")))
    got = mixing.mixed_documents(spark, named, "")
    assert got.columns == named.columns and got.count() == mixing.mixed_documents(spark, hard, "").count()


ODD = ["", "  a  b\n\n c ", "a<|endoftext|>b 's it's I'll don't  x\u00a0y \u3000z 1234 ab12 ...!! \t\tq", " lead", "trail ", "l'eau. 日本語 です🙂 x🙂y", "\n", "a\n b", "a \nb", "x'S 'tis ' s", "q\u2028 bar \x1c baz\x85 q", "a\0 b c"]


def test_ids_equal_the_tokenizer(spark, data):
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    plain = Tokenizer.from_file(PATH)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    coder = packing.Ids(PATH)
    ids, lengths = coder.of(pa.array([*texts, None]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [*want, []]
    words = sorted({w for t in texts for w in t.split(" ") if "<|" not in w})
    ids, lengths = coder.words(pa.array(words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [e.ids for e in plain.encode_batch([" " + w for w in words], add_special_tokens=False)]


def test_ids_of_special_strings():
    ids, _ = packing.Ids(PATH).of(pa.array(["a <|endoftext|> b"]))
    assert ids.tolist() == [64, 220, 50256, 275]


def brute_cost(places, penalty, window):
    at, pay, cost = [0, *places], [0, *penalty], [0]
    for j in range(1, len(at)):
        cost.append(min(cost[i] + window - (at[j] - at[i]) + pay[j] for i in range(j) if at[j] - at[i] <= window))
    return cost[-1]


def test_cuts_are_best():
    rng = np.random.default_rng(2)
    for _ in range(40):
        places = np.cumsum(rng.integers(1, 9, 30))
        penalty = rng.integers(0, 6, 30)
        cuts = packing.best_cuts(places, penalty, 20)
        pay = dict(zip(places.tolist(), penalty.tolist(), strict=True))
        cost = sum(20 - (b - a) + pay[b] for a, b in zip([0, *cuts], cuts, strict=False))
        assert cuts[-1] == places[-1] and cost == brute_cost(places.tolist(), penalty.tolist(), 20)


def check_pieces(rows, docs, window=2048):
    plain = Tokenizer.from_file(PATH)
    ids = Counter((k, np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for k, t in docs)
    parts, places = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    for p in places.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(r.length for r in rows) == sum(n * len(code) // 4 for (_, code), n in ids.items())
    if len({k for k, _ in docs}) == len(docs):
        for (k, code), _ in ids.items():
            at = 0
            for r in sorted(parts[k], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(code) // 4 and r.ids_crc32 == zlib.crc32(code[4 * at : 4 * (at + r.length)])
                at += r.length
            assert at == len(code) // 4
    return sum(r.length for r in rows) / (window * len(places))


def test_op10(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert check_pieces(packing.op10_packing(spark, data).collect(), docs) > 0.97


def test_pack_equal_ids(spark):
    rows = [(7, f"text {i} of many. " * 40) for i in range(300)] + [(None, "no id"), (7, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=20_000).collect()
    check_pieces(got, rows)
    assert len({r.sequence_id >> 32 for r in got}) > 3


def test_pack_hard(hard, nothing):
    check_pieces(packing.pack(hard, block_bytes=100_000).collect(), [(r.doc_id, r.text) for r in hard.collect()])
    assert packing.pack(nothing).count() == 0


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "packing"]
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        outs.append([r.asDict() for r in stage(spark, docs, data).collect()])
        if len(outs) < 5:
            docs = spark.createDataFrame(outs[-1], docs.schema) if outs[-1] else docs.limit(0)
    before = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(before).filter("kept").collect()}
    assert {r["doc_id"] for r in outs[0]} == kept
    groups = jaccard.similar_groups(before.filter(F.col("doc_id").isin(*kept)), jaccard.STAGE_GRAM, jaccard.STAGE_LEAST).collect()
    assert Counter(r["doc_id"] for r in outs[1]) == Counter({r.component_id for r in groups})
    length = 200
    bytes_ = Counter(t[i : i + length] for r in outs[1] for t in [r["text"].encode()] for i in range(len(t) - length + 1))
    for r in outs[2]:
        whole = next(x["text"] for x in outs[1] if x["doc_id"] == r["doc_id"]).encode()
        clean = not any(bytes_[whole[i : i + length]] > 1 for i in range(len(whole) - length + 1))
        assert (r["text"].encode() == whole) == clean and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in outs[3]} <= {r["doc_id"] for r in outs[2]} and max(Counter(r["doc_id"] for r in outs[3]).values()) <= 3
    check_pieces([type("R", (), r) for r in outs[4]], [(r["doc_id"], r["text"]) for r in outs[3]])
    run = corpus_pipeline.run(spark, data)
    assert run.count() == len(outs[4])
