"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Shingles of five words (a shorter text is one shingle) are hashed once; the upper bits of a hash
choose one of ``BINS`` bins, and each bin keeps its least hash. An empty bin copies the first full
bin along its own probe sequence, which visits every bin and is the same for all documents. The
low ``BITS`` bits of each bin are stored as hexadecimal digits; the share of equal bins, less what
chance alone makes equal, estimates the Jaccard similarity of the two shingle sets.

Everything is array functions inside the row; nothing is shuffled for a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, key_cuts, let, n_blocks, range_bucket, words

SHINGLE, BINS, BITS = 5, 256, 8
_SHIFT = 64 - (BINS.bit_length() - 1)
_LOW = (1 << _SHIFT) - 1
#: Probes tried one by one before the search over all full bins.
PROBES = 6
BLOCK_BYTES = 8 << 20


def _sentinel(b: int) -> int:
    """The greatest hash of bin ``b`` (bins are numbered in order of the signed hash); it marks an empty bin."""
    return ((b - BINS // 2) << _SHIFT) + _LOW


_SENTINELS = [_sentinel(b) for b in range(BINS)]
#: Probe sequence of bin j: (step * t + first) mod BINS for t = 0, 1, ...; an odd step visits every bin.
_STEP = [(j * 2654435761 >> 7 & (BINS - 1)) | 1 for j in range(BINS)]
_FIRST = [(j * 40503 + 12345 >> 3) * 2246822519 >> 11 & (BINS - 1) for j in range(BINS)]
_UNSTEP = [pow(s, -1, BINS) for s in _STEP]


def _numbers(values: list[int], kind: str) -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def _bin(h: Column) -> Column:
    return F.shiftright(h, _SHIFT) + F.lit(BINS // 2)


def shingle_hashes(found: Column) -> Column:
    """Hashes of the shingles of an array of words; none for no words."""
    many = F.transform(F.sequence(F.lit(1), F.size(found) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(found, i, SHINGLE)))
    return F.when(F.size(found) >= SHINGLE, many).when(F.size(found) > 0, F.array(F.xxhash64(found))).otherwise(F.array().cast("array<bigint>"))


def _densified(least: Column) -> Column:
    """Low bits of each bin, empty bins filled by optimal densification; ``least`` has one hash a bin."""
    step, first, unstep, marks = _numbers(_STEP, "int"), _numbers(_FIRST, "int"), _numbers(_UNSTEP, "int"), _numbers(_SENTINELS, "bigint")

    def filled(full: Column) -> Column:
        def one(h: Column, j: Column) -> Column:
            def probe(t: int) -> Column:
                at = F.pmod(F.get(step, j) * t + F.get(first, j), F.lit(BINS))
                return F.when(F.get(least, at) != F.get(marks, at), F.get(least, at))

            # of all full bins, the one whose place in the probe sequence comes first
            order = F.array_min(F.transform(full, lambda b: F.pmod((b - F.get(first, j)) * F.get(unstep, j), F.lit(BINS)) * BINS + b))
            rest = F.get(least, F.pmod(order, F.lit(BINS)))
            return F.when(h != F.get(marks, j), h).otherwise(F.coalesce(*(probe(t) for t in range(PROBES)), rest))

        return F.transform(least, lambda h, j: one(h, j))

    full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(least, j) != F.get(marks, j))
    return F.when(F.forall(F.arrays_zip(least.alias("a"), marks.alias("b")), lambda x: x["a"] != x["b"]), least).otherwise(let(full, filled))


def fingerprint(text: Column) -> Column:
    """Hexadecimal digits, two a bin; an empty string for a text without words (null included)."""

    def packed(hashes: Column) -> Column:
        ordered = F.sort_array(F.concat(hashes, _numbers(_SENTINELS, "bigint")))
        least = let(ordered, lambda s: F.filter(s, lambda h, i: F.when(i == 0, F.lit(True)).otherwise(_bin(F.get(s, i - 1)) != _bin(h))))
        digits = F.transform(let(least, _densified), lambda h: F.substring(F.hex(h.bitwiseAND((1 << BITS) - 1) + (1 << BITS)), 2, 2))
        return F.when(F.size(hashes) == 0, F.lit("")).otherwise(F.lower(F.array_join(digits, "")))

    return let(let(words(text), shingle_hashes), packed)


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1; two empty ones are alike."""
    same = F.aggregate(F.zip_with(F.regexp_extract_all(one, F.lit(".."), F.lit(0)), F.regexp_extract_all(other, F.lit(".."), F.lit(0)), lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, x: a + x)
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((one == "") | (other == ""), (one == other).cast("double")).otherwise(estimate)


def with_next(df: DataFrame, key: str, columns: list[str], block_bytes: int, total: int | None, ties: str = "text") -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows in descending order of the long ``key`` (after the last: the first).

    Rows are dealt to ranges of the key; the first row of a range also goes to the range before it
    as a guest, so no ordering of the whole table is needed. Null keys come last; equal keys are
    ordered by a hash of the column ``ties``, and rows that are equal in both follow each other; an
    empty table stays empty; columns of any name are kept, and a new name that ``df`` has gets
    underscores in front.
    """
    blocks = n_blocks(total, block_bytes)
    b, tie, guest, host, head, mine_, homes_ = (fresh(df, x) for x in ("bucket", "tie", "guest", "host", "head", "mine", "homes"))
    placed = df.withColumn(b, range_bucket(F.col(key), key_cuts(df, key, blocks))).withColumn(tie, F.xxhash64(ties))
    order = F.struct(F.coalesce(F.col(key).isNotNull(), F.lit(False)).alias("p"), F.col(key).alias("k"), F.col(tie).alias("t"))
    # one row a range
    heads = placed.groupBy(b).agg(F.max(order).alias(head))
    descending = Window.orderBy(F.col(b).desc())
    before = heads.withColumn(host, F.coalesce(F.lag(b).over(descending), F.min(b).over(Window.partitionBy()))).select(F.col(b).alias(mine_), head, host)
    mine = placed.join(F.broadcast(before), F.col(b) == F.col(mine_), "left")
    homes = F.when(order.eqNullSafe(F.col(head)), F.array(F.struct(F.col(b).alias("home"), F.lit(False).alias("guest")), F.struct(F.col(host).alias("home"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col(b).alias("home"), F.lit(False).alias("guest"))))
    dealt = mine.select(*df.columns, tie, F.explode(homes).alias(homes_)).select(*df.columns, tie, F.col(homes_)["home"].alias(b), F.col(homes_)["guest"].alias(guest))
    near = Window.partitionBy(b).orderBy(guest, F.col(key).desc_nulls_last(), F.col(tie).desc())
    return dealt.select(*df.columns, guest, *(F.lead(c).over(near).alias(fresh(df, f"next_{c}")) for c in columns)).filter(~F.col(guest)).drop(guest)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    marked = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(marked, "doc_id", ["text", "fingerprint"], BLOCK_BYTES, total)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    return (
        paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
        .select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
    )
