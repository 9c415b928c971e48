"""Token-ID files: coder, words' ids and files against round trips and the plain tokenizer."""

import struct
import zlib
from io import BytesIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import coder, tokenfiles
from tesserae.llm.wordids import word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  a  b\n\n c ", "a<|endoftext|>b 's it's I'll don't,  x y 　z 1234, ab12... ...!! \t\tq", " lead", "trail ", "l'eau. 日本語 です🙂 x🙂y. (end).", "\n", "a\n b", "x'S, 'tis ' s .,'s", "q  bar \x1c baz\x85 q", "a\0 b c\0", "ΣΑΣ É ÉCOLE. ẞ İstanbul éá á. ́", "ab,cd ab.,;cd .,", "A.B,", "snake_case_ x&&& |y| <|startoftext|>"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=400))
def test_coder_round_trip(ids):
    assert coder.decode(coder.encode(np.array(ids, np.int64)), len(ids)).tolist() == ids


@pytest.mark.parametrize("kind", ["uniform", "one", "ends", "skewed", "copies"])
def test_coder_lanes(kind):
    """Many lanes: incompressible ids, one id, the two extreme ids, a skewed law, a repeated passage."""
    rng = np.random.default_rng(3)
    n = 300_007
    ids = {"uniform": rng.integers(0, 65536, n), "one": np.full(n, 65535), "ends": rng.integers(0, 2, n) * 65535, "skewed": np.minimum(rng.zipf(1.3, n), 65535), "copies": np.tile(rng.integers(0, 49408, 700), 500)[:n]}[kind]
    words = coder.encode(ids)
    assert (coder.decode(words, n) == ids).all()
    bits = 16 * len(words) / n
    assert bits < {"uniform": 17.5, "one": 0.8, "ends": 2, "skewed": 7.5, "copies": 6}[kind]


def test_coder_beats_order_0(spark, data):
    """On running text the mix needs fewer bits than the ids' own entropy."""
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    ids, _ = word_ids(PATH).of(pa.array(texts), 2)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert 16 * len(coder.encode(ids)) / len(ids) < entropy + 0.5
    twice = np.concatenate([ids, ids])
    assert 16 * len(coder.encode(twice)) / len(twice) < entropy


def test_word_ids_equal_the_tokenizer(spark, data):
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    plain = Tokenizer.from_file(PATH)
    ids, stops = word_ids(PATH).of(pa.array(texts), 2)
    for text, got in zip(texts, np.split(ids, stops[:-1]), strict=True):
        assert got.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr("tesserae.llm.wordids.REMEMBERED", 3)
    own, plain = word_ids.__globals__["WordIds"](PATH), Tokenizer.from_file(PATH)
    for text in ("one two three four", "five six one", "two,"):
        assert own.of(pa.array([text]), 2)[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [2]


def brute(rows):
    plain, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_op12(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = tokenfiles.op12_token_files(spark, data)
    assert [t for _, t in got.dtypes] == ["bigint"] * 4
    assert sorted(map(tuple, got.collect())) == sorted(brute((r.doc_id, r.text) for r in docs))


def test_many_files_and_blocks(spark, data, monkeypatch):
    """Ranges of several files; documents over several blocks."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    manifest = tokenfiles.write_ids(docs, range_bytes=60_000)
    assert manifest.count() > 4
    got = tokenfiles.read_ids(manifest).selectExpr("doc_id", "start", "octet_length(ids) div 4", "crc32(ids)").collect()
    assert sorted(map(tuple, got)) == sorted(brute((r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()))
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 50)
    texts = ["a b c " * 60, None, "", "tail " * 49, "x"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, 1, 2, 3, 3], pa.int64()), "text": texts})
    out = BytesIO(tokenfiles.FILE_MARK + b"".join(tokenfiles.packed_block(p, i) for p, i in tokenfiles._blocks(iter([batch]), PATH, 2)))
    blocks = list(tokenfiles.read_blocks(out))
    assert len(blocks) > 4 and all(len(i) <= 50 for _, i in blocks) and [int(p["last"].sum()) for p, _ in blocks][:2] == [0, 0]
    assert np.concatenate([i for _, i in blocks]).tolist() == word_ids(PATH).of(pa.array(texts), 2)[0].tolist()


def test_damage_is_found():
    block = tokenfiles.packed_block(np.array([(7, 3, 1, 1)], tokenfiles._PART), np.array([5, 6, 2]))
    good = tokenfiles.FILE_MARK + block
    assert [i.tolist() for _, i in tokenfiles.read_blocks(BytesIO(good))] == [[5, 6, 2]]
    for bad in (good[:-1], good[:-1] + bytes([good[-1] ^ 1]), b"x" + good[1:], good + b"TS"):
        with pytest.raises(tokenfiles.DamagedFile):
            list(tokenfiles.read_blocks(BytesIO(bad)))


def test_hard_rows(spark, hard, nothing):
    """Null ids and texts, ties, repeated rows, long texts, columns with clashing names; no rows."""
    got = tokenfiles.read_ids(tokenfiles.write_ids(hard)).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    plain = Tokenizer.from_file(PATH)
    want = sorted((key(r), tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in hard.collect())
    assert sorted((key(r), struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [key(r) for r in ordered] == sorted(key(r) for r in got)
    assert [r.start for r in ordered] == np.cumsum([0, *(len(r.ids) // 4 for r in ordered)])[:-1].tolist()
    empty = tokenfiles.read_ids(tokenfiles.write_ids(nothing))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "ids"]
