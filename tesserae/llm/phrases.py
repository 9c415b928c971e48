"""Phrase collocations by prefix-free parsing.

Each text's words are cut into chunks at triggers: places whose next three words hash to a multiple
of ``EVERY``. A chunk goes on through the three words of the next trigger, so neighbours overlap,
and equal passages give equal chunks wherever they stand. The distinct chunks of a language, with
how often each comes, are the dictionary; n-grams are counted inside distinct chunks only, times
the chunk's frequency, and an n-gram belongs to the chunk in whose own part (before the next
trigger) it begins, so overlaps count once.

Counts go up by length. Words that come often enough pass a Bloom filter of fixed size on to the
count of pairs, and pairs to that of triples and quadruples; false positives only cost time, since
every length is counted exactly before it is cut off. Words are compared by 64-bit hashes once the
vocabulary is counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, written

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, (80, 100)
#: One word in so many begins a chunk; overlap in words; most words of a chunk's own part, however long no trigger comes.
EVERY, OVERLAP, MOST_OWN = 32, LONGEST - 1, 512
#: Bytes of text and keys that a task works on at once; bits of a Bloom filter (8 MB, whatever the data).
PART_BYTES, PART_KEYS, BLOOM_BITS = 2 << 20, 4 << 20, 26
COLUMNS = "lang rank phrase a l r n score".split()
_SEPARATORS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_SEPARATORS)] = 1, 2
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_FACTORS = np.random.default_rng(12).integers(0, 1 << 64, LONGEST, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1 if n > PART_BYTES else PART_BYTES * 2, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of some lowered texts that lie in one buffer: begin, end, hash, text number, and whether a piece begins there."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        kind = _KIND[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = kind == 0
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        starts = offsets[:-1][(offsets[:-1] < offsets[1:]) & (offsets[:-1] > 0)]
        first[starts] |= inside[1:-1][starts]
        last[starts - 1] |= inside[1:-1][starts - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.begin, "right") - 1
        cuts = np.cumsum(kind == 2, dtype=np.int32)
        self.starts = np.ones(len(self.begin), bool)
        if len(self.begin):
            at = cuts[self.begin]
            self.starts[1:] = (at[1:] != at[:-1]) | (self.text[1:] != self.text[:-1])
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        self.hash = _mixed((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the chunks, the words after their own parts, and the words after their overlaps."""
        n = len(self.begin)
        window = self.hash.copy()
        for k in range(1, OVERLAP):
            window[:-k] += self.hash[k:] * _FACTORS[k]
        fits = np.zeros(n, bool)
        fits[: n - OVERLAP + 1] = self.text[: n - OVERLAP + 1] == self.text[OVERLAP - 1 :]
        cut = fits & (_mixed(window) % np.uint64(EVERY) == 0)
        cut[np.flatnonzero(np.diff(self.text, prepend=-1))] = True
        at = np.flatnonzero(cut)
        own = np.diff(at, append=n)
        if len(own) and own.max() > MOST_OWN:
            parts = -(-own // MOST_OWN)
            at = np.repeat(at, parts) + MOST_OWN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.append(at[1:], n)[: len(at)]
        after, open_ = stop.copy(), np.ones(len(at), bool)
        for _ in range(OVERLAP):
            open_ &= (after < n) & ~self.starts[np.minimum(after, n - 1)]
            after += open_
        return at, stop, after


def _slices(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Pieces of a buffer as strings, in one copy."""
    long = np.maximum(end - begin, 0)
    stops = np.cumsum(long)
    index = np.repeat(begin - (stops - long), long) + np.arange(stops[-1] if len(stops) else 0)
    return pa.StringArray.from_buffers(len(long), pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32)), pa.py_buffer(raw[index]))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``PART_BYTES`` of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    low, total = 0, 0
    for i, more in enumerate(sizes.tolist()):
        total += more
        if total >= PART_BYTES or i + 1 == len(sizes):
            yield low, i + 1
            low, total = i + 1, 0


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, and where each begins."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _long_texts_cut(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The same rows, texts over ``PART_BYTES`` in several: cut at separators of pieces, which no n-gram crosses."""
    if pc.max(pc.binary_length(texts)).as_py() <= PART_BYTES:
        return langs, texts
    kept_langs, kept = [], []
    for lang, text in zip(langs.to_pylist(), texts.to_pylist(), strict=True):
        raw = text.encode()
        marks = np.flatnonzero(_KIND[np.frombuffer(raw, np.uint8)] == 2)
        low = 0
        while low < len(raw):
            k = np.searchsorted(marks, low + PART_BYTES)
            high = int(marks[k]) + 1 if k < len(marks) else len(raw)
            kept_langs.append(lang)
            kept.append(raw[low:high].decode())
            low = high
    return pa.array(kept_langs, pa.string()), pa.array(kept, pa.string())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to the chunks of their texts: lang, own part, overlap."""
    for batch in batches:
        for low, high in _parts(batch, 1):
            langs, texts = (batch.column(i).slice(low, high - low).cast(pa.string()) for i in range(2))
            langs, texts = _long_texts_cut(langs, pc.ascii_lower(texts))
            sizes = pc.binary_length(texts).to_numpy().cumsum()
            edges = np.unique(np.append(np.searchsorted(sizes, np.arange(PART_BYTES, sizes[-1], PART_BYTES)) + 1, [0, len(texts)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                raw, offsets = _buffer(texts.slice(a, b - a))
                words = Words(raw, offsets)
                if not len(words.begin):
                    continue
                at, stop, after = words.chunks()
                tail = after > stop
                begin = words.begin[np.minimum(stop, len(words.begin) - 1)]
                own = _slices(raw, words.begin[at], words.end[stop - 1])
                over = _slices(raw, np.where(tail, begin, 0), np.where(tail, words.end[after - 1], 0))
                yield pa.RecordBatch.from_arrays([langs.slice(a, b - a).take(pa.array(words.text[at])), own, over], names=["lang", "own", "over"])


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct key: a place where it stands, the key, and the sum of its times."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return order[begin], sorted_keys[begin], np.add.reduceat(times[order], begin)


def passes(bloom: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a Bloom filter holds the keys: two bits each, the highest and the lowest of the key."""
    found = np.ones(len(key), bool)
    for place in (key >> np.uint64(64 - BLOOM_BITS), key & np.uint64((1 << BLOOM_BITS) - 1)):
        found &= (bloom[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


class _Grams:
    """Words of some chunks with what an n-gram needs: language, frequency, which words are a chunk's own, how far a piece goes on."""

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column(1)
        self.raw, offsets = _buffer(texts.cast(pa.string()))
        self.words = words = Words(self.raw, offsets)
        langs = batch.column(0).dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        salts = np.array([zlib.crc32(x.encode()) * 0x9E3779B1 + 1 for x in self.names], np.uint64)
        own, times = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
        self.lang = langs.indices.to_numpy()[words.text]
        self.salt = salts[self.lang]
        self.times = times[words.text]
        self.own = words.begin < (offsets[:-1] + own)[words.text]

    def key(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hash of the n-grams that begin at some words, their language included."""
        h = self.salt[at].copy()
        for k in range(n):
            h += self.words.hash[at + k] * _FACTORS[k]
        return _mixed(_mixed(h) + np.uint64(n))

    def joined(self) -> np.ndarray:
        """Words that go on from the word before in one piece."""
        return ~self.words.starts


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own words of the chunks, those of a part of the batch added up."""
    for batch in batches:
        for low, high in _parts(batch, 1):
            g = _Grams(batch.slice(low, high - low))
            at = np.flatnonzero(g.own)
            if len(at):
                some, key, times = _counted(g.key(1, at), g.times[at])
                at = at[some]
                yield pa.RecordBatch.from_pydict({"lang": pa.array(g.names).take(pa.array(g.lang[at])), "word": _slices(g.raw, g.words.begin[at], g.words.end[at]), "h": g.words.hash[at].view(np.int64), "key": key.view(np.int64), "times": times})


def _pair_counter(bloom) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of pairs of words that may both be frequent, with their counts."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            _, key, times = _counted(np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held]))
            held.clear()
            return pa.RecordBatch.from_pydict({"key": key.view(np.int64), "times": times})

        for batch in batches:
            for low, high in _parts(batch, 1):
                g = _Grams(batch.slice(low, high - low))
                often = passes(bloom.value, g.key(1, np.arange(len(g.own))))
                at = np.flatnonzero(g.own[:-1] & g.joined()[1:] & often[:-1] & often[1:])
                held.append((g.key(2, at), g.times[at]))
                if sum(len(k) for k, _ in held) > PART_KEYS:
                    yield out()
        if sum(len(k) for k, _ in held):
            yield out()

    return run


def _gram_counter(bloom) -> Callable:
    names = [f"h{k}" for k in range(LONGEST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the words of 2- to 4-grams all of whose pairs may be frequent, with their counts."""
        for batch in batches:
            for low, high in _parts(batch, 1):
                g = _Grams(batch.slice(low, high - low))
                n_words = len(g.own)
                pair = np.zeros(n_words, bool)  # the word and the next one
                at = np.flatnonzero(g.joined()[1:])
                pair[at] = passes(bloom.value, g.key(2, at))
                begins = pair & g.own
                for n in range(2, LONGEST + 1):
                    if n > 2:
                        begins = begins.copy()
                        begins[: n_words - n + 2] &= pair[n - 2 :]
                        begins[n_words - n + 1 :] = False
                    at = np.flatnonzero(begins)
                    if len(at):
                        some, _, times = _counted(g.key(n, at), g.times[at])
                        at = at[some]
                        hashes = [g.words.hash[at + k].view(np.int64) if k < n else np.zeros(len(at), np.int64) for k in range(LONGEST)]
                        yield pa.RecordBatch.from_pydict({"lang": pa.array(g.names).take(pa.array(g.lang[at])), "size": np.full(len(at), n, np.int32)} | dict(zip(names, hashes, strict=True)) | {"times": times})

    return run


def _bloom(keys: DataFrame) -> np.ndarray:
    """A filter of the keys; the driver gets at most its fixed number of words."""
    key, mask = F.col("key"), (1 << BLOOM_BITS) - 1
    places = keys.select(F.explode(F.array(F.shiftrightunsigned(key, 64 - BLOOM_BITS), key.bitwiseAND(F.lit(mask)))).alias("p"))
    bits = F.expr("shiftleft(1L, cast(p & 63 as int))")
    got = places.groupBy(F.expr("p div 64").alias("at")).agg(F.bit_or(bits).alias("bits")).toArrow()
    bloom = np.zeros(1 << BLOOM_BITS - 6, np.uint64)
    bloom[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bloom


def chunk_dictionary(df: DataFrame) -> DataFrame:
    """Distinct chunks of each language (``lang``, ``own``, ``over``) with how often each comes (``times``)."""
    texts = df.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("text <> ''")
    return texts.mapInArrow(_parse, "lang string, own string, over string").groupBy("lang", "own", "over").agg(F.count("*").alias("times"))


def gram_counts(df: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``lang, word, h, a``) and 2- to 4-grams (``lang, h`` as an array of hashes, ``a``) that come ``least`` times or more, and the number of all words of each language (``lang, n``)."""
    spark = df.sparkSession
    chunks = written(chunk_dictionary(df), "chunks").select("lang", F.concat_ws(" ", "own", "over").alias("text"), F.octet_length("own").alias("own"), "times")
    counted = chunks.mapInArrow(_word_counter, "lang string, word string, h long, key long, times long")
    vocabulary = written(counted.groupBy("lang", "word").agg(F.min("h").alias("h"), F.min("key").alias("key"), F.sum("times").alias("a")), "vocabulary")
    totals = vocabulary.groupBy("lang").agg(F.sum("a").alias("n"))
    often = vocabulary.filter(F.col("a") >= least)
    words = spark.sparkContext.broadcast(_bloom(often))
    pairs = chunks.mapInArrow(_pair_counter(words), "key long, times long").groupBy("key").agg(F.sum("times").alias("a")).filter(F.col("a") >= least)
    found = spark.sparkContext.broadcast(_bloom(pairs))
    names = [f"h{k}" for k in range(LONGEST)]
    grams = chunks.mapInArrow(_gram_counter(found), f"lang string, size int, {', '.join(n + ' long' for n in names)}, times long")
    grams = grams.groupBy("lang", "size", *names).agg(F.sum("times").alias("a")).filter(F.col("a") >= least)
    grams = written(grams.select("lang", F.slice(F.array(*names), F.lit(1), F.col("size")).alias("h"), "a"), "grams")
    return often.select("lang", "word", "h", "a"), grams, totals


def _scored(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)) in decimals, whose products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * wide(a), wide(l) + wide(r))


def collocations(df: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """The ``top`` phrases of each language of ``df`` (``lang``, ``text``) by score: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates have 2 to 4 words and come ``least`` times or more. A null text has no words, a null
    language is ``und``, repeated rows count each, ties go by ``a`` and the phrase's bytes, other
    columns are ignored, an empty table gives no phrases. Exact up to 64-bit hashes of words.
    """
    words, grams, totals = gram_counts(df, least)
    known = words.select("lang", F.array("h").alias("h"), "a").unionByName(grams)
    size = F.size("h")
    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = grams.select("lang", "h", "a", k)
    cuts = cuts.select("*", F.slice("h", F.lit(1), F.col("k")).alias("head"), F.slice("h", F.col("k") + 1, F.size("h") - F.col("k")).alias("rest"))
    for part, count in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("h").alias(part), F.col("a").alias(count)), ["lang", part])
    best = cuts.groupBy("lang", "h", "a").agg(F.min(F.struct(_scored(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))

    sub = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("h", i, n))))).alias("h")
    longer = grams.filter(size > 2).select("lang", sub, "a").groupBy("lang", "h").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "h"], "left").filter(F.coalesce(F.col("longer") * INSIDE[1] < F.col("a") * INSIDE[0], F.lit(True)))

    spelled = kept.select("lang", "h", F.posexplode("h").alias("place", "one")).join(words.select("lang", F.col("h").alias("one"), "word"), ["lang", "one"])
    spelled = spelled.groupBy("lang", "h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(spelled, ["lang", "h"]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")).cast("long")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).join(totals, "lang").select(*COLUMNS)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= 30),
s AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, j, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[u:u + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS u FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM d JOIN n USING (lang) QUALIFY rank <= 2000
"""
