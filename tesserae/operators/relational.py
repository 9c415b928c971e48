"""Joins, windows, top-k and set operators that take any DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a side that is broadcast, at most.
SMALL = 10_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, else as it is, for Spark to join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` should end in a unique column. No keys: of the table."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``."""
    return top_n_per_group(df, keys, order, 1)


#: Rows of a range of a group, about, where neighbours are sought, and ranges of a group at most.
RANGE_ROWS, MOST_RANGES = 200_000, 1024


def dealt_by_depth(df: DataFrame, keys: list[str], order: str, rows: int = RANGE_ROWS, ranges: int = MOST_RANGES) -> DataFrame:
    """``df`` with ``_part``: ranges of ``order`` in the group, in its order, of about equal numbers of rows.

    Only groups of more than ``rows`` are cut, at two quantiles for each ``rows`` of the largest group,
    at most ``ranges``, so the sketches of quantiles stay small; a table of one row a cut group, thus
    of one for each ``rows`` rows at most, is broadcast. A value that is several quantiles at once is shared by hash among as many ranges, so
    neither an outlier nor a heavy value makes a large one; ranges after the first of such a value
    hold it alone. Null is a range of its own, before the others. ``order`` is a number, date or time.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    large = df.groupBy(*keys).agg(F.count(order).alias("_n")).filter(F.col("_n") > rows)
    most = large.agg(F.max("_n")).first()[0]
    if most is None:
        return df.withColumn("_part", F.when(F.col(order).isNull(), -1).otherwise(0))
    ranges = max(2, min(ranges, -(-2 * most // rows)))
    within = df.select(*keys, order).alias("d").join(F.broadcast(large).alias("l"), same("d", "l"), "left_semi")
    shares = [i / ranges for i in range(1, ranges)]
    cuts = within.groupBy(*keys).agg(F.percentile_approx(order, shares, 10 * ranges).alias("_cuts"))
    joined = df.alias("d").join(F.broadcast(cuts).alias("c"), same("d", "c"), "left").select("d.*", "c._cuts")

    def below(holds) -> Column:
        """How many cuts ``holds``, by halving."""
        powers = [1 << b for b in reversed(range((ranges - 1).bit_length()))]
        return F.aggregate(F.array(*(F.lit(p) for p in powers)), F.lit(0), lambda n, p: F.when(F.coalesce(holds(F.get("_cuts", n + p - 1)), F.lit(False)), n + p).otherwise(n))

    x = F.col(order)
    placed = joined.withColumn("_at", F.struct(below(lambda c: c < x).alias("lo"), below(lambda c: c <= x).alias("hi")))
    share = F.col("_at.hi") - F.col("_at.lo")
    others = [c for c in df.columns if c not in keys and df.schema[c].dataType.typeName() not in ("map", "variant")]
    spread = F.col("_at.lo") + F.when(share > 1, F.pmod(F.xxhash64(*others), share)).otherwise(0).cast("int")
    part = F.when(x.isNull(), -1).when(F.col("_cuts").isNull(), 0).otherwise(spread)
    return placed.withColumn("_part", part).drop("_cuts", "_at")


def with_prev_next(df: DataFrame, keys: list[str], order: str, rows: int = 0, ranges: int = MOST_RANGES) -> DataFrame:
    """``df`` with ``prev`` and ``next``: the neighbouring values of ``order`` (number, date or time) in the group.

    A group is dealt to ranges of equal depth, and the ends of ranges are looked up in a table of one
    row a range, so a group of any size is shared by many tasks. Of equal values any may be first;
    those of a null group are neighbours, too, and null values come before the others.
    """
    dealt = dealt_by_depth(df, keys, order, rows or RANGE_ROWS, ranges)
    near = Window.partitionBy(*keys, "_part").orderBy(order)
    ends = dealt.groupBy(*keys, "_part").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.select(*keys, "_part", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    inner = lambda f: F.when(f(F.lit(1)).over(near).isNotNull(), F.struct(f(order).over(near).alias("x")))
    on = reduce(lambda x, y: x & y, [F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*keys, "_part"]])
    both = dealt.withColumn("prev", inner(F.lag)).withColumn("next", inner(F.lead)).alias("d").join(ends.alias("e"), on).select("d.*", "e._before", "e._after")
    found = lambda side, end: F.when(F.col(side).isNotNull(), F.col(f"{side}.x")).otherwise(F.col(end))
    return both.withColumn("prev", found("prev", "_before")).withColumn("next", found("next", "_after")).drop("_part", "_before", "_after")


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of each group (null for none): only values near it, by an approximate bracket, are ordered."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_one"))
    on = [*keys, "_one"]
    bracket = known.groupBy(*on).agg(F.percentile_approx("_v", [0.499, 0.501], 10_000).alias("_q"), F.count(F.lit(1)).alias("_n"))
    placed = known.join(bracket, on)
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    below = placed.groupBy(*on).agg(F.count_if(F.col("_v") < low).alias("_below"), F.first("_n").alias("_n"))
    inside = placed.filter(F.col("_v").between(low, high)).groupBy(*on, "_v").agg(F.count(F.lit(1)).alias("_c")).join(below, on)
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*on).orderBy("_v"))
    at = lambda half: F.min(F.when(F.col("_upto") > half((F.col("_n") - 1) / 2), F.col("_v")))
    return inside.withColumn("_upto", upto).groupBy(*on).agg(((at(F.floor) + at(F.ceil)) / 2).alias(name)).select(*keys, name)


#: Rows of a part that ``in_parts`` aims at.
PART_ROWS = 500_000


def in_parts(df: DataFrame, total: int, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt by ``keys`` to parts of about ``rows`` of ``total`` rows, so what a later join or window on these keys sorts in a task doesn't grow."""
    return df.repartition(max(1, -(-total // (rows or PART_ROWS))), *keys)


def number_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Numbers missing between the least and the greatest of each group."""
    gaps = with_prev_next(df.select(*keys, number).filter(F.col(number).isNotNull()).distinct(), keys, number).filter(F.col("next") - F.col(number) > 1)
    return gaps.select(*keys, F.explode(F.sequence(F.col(number) + 1, F.col("next") - 1)).alias("missing"))


def publish_cadence(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Median days between consecutive dates, rounded to 2; null for fewer than two."""
    dated = df.select(*keys, date).filter(F.col(date).isNotNull())
    gaps = with_prev_next(dated, keys, date).withColumn("_gap", (F.unix_timestamp(date) - F.unix_timestamp("prev")) / 86400.0)
    return dated.select(*keys).distinct().join(medians(gaps, keys, "_gap", "median_days"), keys, "left").select(*keys, F.round("median_days", 2).alias("median_days"))


def char_budget_prefix(df: DataFrame, key: str, order: str, text: str, cap: int) -> DataFrame:
    """Rows of each source until the running length (one more a row) passes ``cap``."""
    used = F.sum(F.length(text) + 1).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).filter(F.col("used") <= cap)


def claim_once(df: DataFrame, item: str, order: list[str]) -> DataFrame:
    """``df`` with ``kept`` (the first group that claims an item keeps it) and ``claimed_by``."""
    w = Window.partitionBy(item).orderBy(*order)
    return df.withColumn("kept", F.row_number().over(w) == 1).withColumn("claimed_by", F.first(order[0]).over(w))


def systematic_sample(df: DataFrame, order: str, n: int, total: int, span: int = 4096) -> DataFrame:
    """Every ``floor(total / n)``-th row by ``order`` (a number), at most ``n``.

    A row's place is the count of keys below it, taken from counts of key ranges of two widths,
    ``span`` and its square, so whole rows are ranked within one range, and the only window
    without a key is over one row for each ``span ** 2`` keys.
    """
    step = max(1, total // n)
    fine = df.groupBy(F.floor(F.col(order) / span).alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_wide", F.floor(F.col("_cell") / span))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = fine.groupBy("_wide").agg(F.sum("_n").alias("_n")).select("_wide", before(Window.orderBy("_wide")).alias("_base"))
    inner = fine.select("_cell", "_wide", before(Window.partitionBy("_wide").orderBy("_cell")).alias("_in"))
    starts = inner.alias("i").join(wide.alias("w"), F.col("i._wide").eqNullSafe(F.col("w._wide"))).select("_cell", (F.col("_in") + F.col("_base")).alias("_before"))
    placed = df.withColumn("_cell", F.floor(F.col(order) / span)).alias("d").join(starts.alias("s"), F.col("d._cell").eqNullSafe(F.col("s._cell"))).select("d.*", "s._before")
    rn = F.row_number().over(Window.partitionBy("_cell").orderBy(order)) + F.col("_before") - 1
    return placed.withColumn("_rn", rn).filter((F.col("_rn") % step == 0) & (F.col("_rn") < step * n)).drop("_cell", "_before", "_rn")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with the total of rows and of pages on each row."""
    totals = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(totals), F.lit(True))


def missing_from(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key ``target`` lacks."""
    return source.join(target.select(*keys).distinct(), keys, "left_anti")


def merge_with_index(fresh: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Fresh rows over indexed ones, column by column; rows of either alone are kept."""
    shared = [c for c in fresh.columns if c != key and c in index.columns]
    rest = [c for c in fresh.columns if c not in (*shared, key)]
    a, b = fresh.alias("a"), index.alias("b")
    return a.join(b, key, "full_outer").select(key, *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in shared), *(F.col(f"a.{c}") for c in rest))


def scoped(df: DataFrame, access: DataFrame, email: str, tenant: str = "tenant_id") -> DataFrame:
    """Rows of tenants that the principal may see; a wildcard row allows all."""
    mine = access.filter(F.col("email") == email)
    return df.join(small(mine), (F.col("access_tenant") == F.col(tenant)) | (F.col("access_tenant") == "*"), "left_semi")


def cascade_delete(child: DataFrame, gone: DataFrame, key: str, *columns: str) -> DataFrame:
    """``child`` without rows that name a deleted id in any of the columns."""
    for c in columns:
        child = child.join(gone.select(F.col(key).alias(c)).distinct(), c, "left_anti").select(*child.columns)
    return child


def first_filled(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, or ``second`` where ``first`` has no rows; of the other side one row at most is moved."""
    any_ = first.limit(1).select(F.lit(1).alias("_any"))
    return first.union(second.join(F.broadcast(any_), F.lit(True), "left_anti").select(*first.columns))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows of the same ``keys`` whose closed intervals meet, each once.

    Both have ``keys``, ``start`` and ``stop``; columns of the two must differ otherwise. Intervals
    are dealt to buckets of ``width``, so only those near each other in time are compared; a pair is
    kept in the first bucket that both touch.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / width)
        kept = df.filter("start <= stop").withColumn("_bucket", F.explode(F.sequence(at("start"), at("stop"))))
        return kept.withColumnsRenamed({"start": f"_{name}_start", "stop": f"_{name}_stop"})

    both = dealt(left, "l").join(dealt(right, "r"), [*keys, "_bucket"])
    meet = (F.col("_l_start") <= F.col("_r_stop")) & (F.col("_r_start") <= F.col("_l_stop"))
    first = F.floor(F.greatest("_l_start", "_r_start") / width) == F.col("_bucket")
    return both.filter(meet & first).drop("_bucket", "_l_start", "_l_stop", "_r_start", "_r_stop")
