"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words; a document is first allocated the certain whole copies
of its expected number, then the remaining words are a fixed-size sample with unequal
probabilities: documents are ranked by random odds divided by inclusion odds, and taken in that
order until the source's words come nearest to its target.

No source meets in one task: words are summed into a fixed number of bins of the rank per source,
a window over those bins finds the bin in which the target is reached, and only that bin's
documents are ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, fresh, written

WEIGHTS, CAP, SHARE, BINS = (1, 2, 3), 3, 1.0, 4096
#: Source tables of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Documents of ordinary length are somewhat likelier than very short or very long ones.
ORDINARY, LIKELIER, LESS_LIKELY = (50, 5000), 1.1, 0.9


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def _measured(df: DataFrame, seed: int) -> tuple[Column, Column, Column, Column]:
    """Source key, size in words, priority and a uniform number in (0, 1), from a row's own columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")), F.lit(str(seed))).cast("binary"))
    uniform = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return _source_key(F.col("source").cast("string")), size, F.when(size.between(*ORDINARY), LIKELIER).otherwise(LESS_LIKELY), uniform


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = SHARE) -> DataFrame:
    """``key, source_size`` with ``target``: the share of all words, by weight, none above ``cap`` times its size.

    Weights go round by rank of the key (null last). The excess of capped sources is reshared in
    closed form: in order of cap over weight, a source is capped while its cap is at most its part
    of what earlier capped ones left. Works on one row a source.
    """
    by_name = Window.orderBy(F.substring("key", 1, 1).desc(), F.col("key"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    weighted = ranked.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights)))
    weighted = weighted.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    every = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    stepped = weighted.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(order))
    free = F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct("place", "level"))
    level = F.min(free).over(every)["level"]
    return stepped.withColumn("target", F.least(F.coalesce(F.col("weight") * level, F.col("most")), F.col("most")))


def _sources(small: DataFrame) -> DataFrame:
    """For each source: size, target and the mean priority of its words."""
    sums = small.groupBy("key").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("priority")).alias("weighted"))
    return targets(sums).select("key", "source_size", "target", F.try_divide("weighted", "source_size").alias("mean"))


def _rate(target: str, source_size: str) -> Column:
    """Expected copies of a source's documents; a source without words is taken as it is, once."""
    return F.coalesce(F.try_divide(target, source_size), F.lit(1.0))


def _mean(mean: str) -> Column:
    """The mean priority of a source's words; that of documents without words where it has none."""
    return F.coalesce(mean, F.lit(LESS_LIKELY))


def _copies(rate: Column, priority: Column, mean: Column) -> tuple[Column, Column]:
    """Certain whole copies, and the inclusion probability of one more (null: none is possible)."""
    expected = F.least(F.lit(float(CAP)), rate * priority / mean)
    whole = F.floor(expected)
    return whole, F.when(whole < CAP, expected - whole)


def _rank(uniform: Column, chance: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) into (0, 1); null never comes."""
    odds = (uniform / (1 - uniform)) / (chance / (1 - chance))
    return F.when(chance > 0, odds / (1 + odds))


def mix(df: DataFrame, seed: int = 0) -> DataFrame:
    """``df`` (``doc_id``, ``text``, ``source``) with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``, last and in this order.

    Where ``df`` has columns of these names, the new ones get underscores in front.

    A null text has no words, a null source is a source of its own and comes last; documents without
    words are taken with the whole copies of their rate, once in a source that has no words at all; rows that are equal in id and text share
    one rank, so all or none of them get the last copy; an empty table stays empty.
    """
    key, size, priority, uniform = _measured(df, seed)
    small = written(df.select(key.alias("key"), size.alias("size"), priority.alias("priority"), uniform.alias("u")), "mix")
    sources = written(_sources(small), "mix-sources")
    broadcast = F.broadcast if sources.count() <= BROADCAST_ROWS else (lambda x: x)

    ranked = small.join(broadcast(sources), "key")
    whole, chance = _copies(_rate("target", "source_size"), F.col("priority"), _mean("mean"))
    ranked = ranked.select("key", "size", "u", "target", (whole * F.col("size")).alias("certain"), _rank(F.col("u"), chance).alias("z"))
    binned = ranked.withColumn("bin", F.floor(F.col("z") * BINS).cast("int"))

    sums = binned.groupBy("key", "bin").agg(F.sum("certain").alias("certain"), F.sum("size").alias("words"), F.first("target").alias("target"))
    need = F.col("target") - F.sum("certain").over(Window.partitionBy("key"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = sums.withColumn("need", need).filter(F.col("bin").isNotNull()).withColumn("upto", upto)
    reached = bins.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
    reached = reached.select("key", "bin", (F.col("need") - F.col("upto") + F.col("words")).alias("room"), F.lit(True).alias("found"))

    last = binned.join(broadcast(reached), ["key", "bin"])
    run = F.sum("size").over(Window.partitionBy("key").orderBy("z", "u", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = last.withColumn("run", run).filter(F.col("run") - F.col("size") / 2 < F.col("room"))
    edge = taken.groupBy("key").agg(F.max("z").alias("edge"))
    full = bins.groupBy("key").agg(F.max("upto").alias("upto"), F.max("need").alias("need"))
    # below the bin that reaches the target all are taken; a source that never reaches it gives all it can
    cut = full.join(reached, "key", "left").join(edge, "key", "left").select(
        "key", F.when(F.col("need") <= 0, F.lit(-1.0)).when(F.col("found"), F.coalesce(F.col("edge"), F.col("bin") / F.lit(BINS) - 1e-12)).otherwise(F.lit(2.0)).alias("cut")
    )
    cuts = written(sources.join(cut, "key", "left"), "mix-cuts")

    k, s, p, u, ss, t, m, at = (fresh(df, f"_mix_{x}") for x in ("key", "size", "priority", "u", "ss", "t", "m", "cut"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*columns, key.alias(k), size.alias(s), priority.alias(p), uniform.alias(u))
    joined = rows.join(broadcast(cuts.select(F.col("key").alias(k), F.col("source_size").alias(ss), F.col("target").alias(t), F.col("mean").alias(m), F.col("cut").alias(at))), k)
    whole, chance = _copies(_rate(t, ss), F.col(p), _mean(m))
    more = F.coalesce(_rank(F.col(u), chance) <= F.col(at), F.lit(False)).cast("long")
    return joined.select(*columns, F.col(s).alias(fresh(df, "mix_size")), F.col(ss).alias(fresh(df, "mix_source_size")), F.col(t).alias(fresh(df, "mix_target")), (whole + more).cast("long").alias(fresh(df, "mix_copies")))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns only."""
    mixed = mix(docs)
    n = F.col(mixed.columns[-1])
    picked = mixed.filter(n > 0).withColumn(fresh(mixed, "copy"), F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return picked.select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken")
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
m AS (
  SELECT *, CASE WHEN size BETWEEN 50 AND 5000 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END AS priority,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(t) || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * priority) / sum(size) AS mean FROM m GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, source_size * 3.0::DOUBLE AS most,
             row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY most / weight, rnk) AS place,
        (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE most / weight > level),
t AS (SELECT source, source_size, mean, least(coalesce(weight * f.level, most), most)::DOUBLE AS target FROM l LEFT JOIN f ON true),
e AS (SELECT m.doc_id, m.source, m.size, m.u, source_size, target, least(3.0::DOUBLE, target / source_size * priority / mean) AS expected
      FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, floor(expected) AS whole, CASE WHEN floor(expected) < 3 THEN expected - floor(expected) END AS chance FROM e),
z AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds,
             target - sum(whole * size) OVER (PARTITION BY source) AS need FROM c),
r AS (SELECT *, sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds / (1 + odds), u, size ROWS UNBOUNDED PRECEDING) AS run FROM z)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN odds IS NOT NULL AND need > 0 AND run - size / 2.0::DOUBLE < need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
