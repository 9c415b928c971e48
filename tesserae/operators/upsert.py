"""Writes as plans: upserts, fills, prunes, and audits of what they would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.relational import distinct_on, small


def upsert(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str], order: list[Column]) -> DataFrame:
    """``target`` after ``source``: per column ``replace``, ``keep_if_null`` (old stays where new is null) or ``keep`` (old stays where there is one).

    Several source rows of a key are folded to the first in ``order``. Columns without a policy are replaced.
    """
    new = distinct_on(source, keys, order).select(*target.columns).alias("n")
    both = target.alias("o").join(new, keys, "full_outer")

    def choice(c: str) -> Column:
        old, fresh, how = F.col(f"o.{c}"), F.col(f"n.{c}"), policy.get(c, "replace")
        if how == "keep":
            return F.coalesce(old, fresh).alias(c)
        if how == "keep_if_null":
            return F.coalesce(fresh, old).alias(c)
        return F.when(F.col("_new"), fresh).otherwise(old).alias(c)

    flagged = target.alias("o").join(new.withColumn("_new", F.lit(True)), keys, "full_outer") if "replace" in {policy.get(c, "replace") for c in target.columns if c not in keys} else both
    return flagged.select(*keys, *(choice(c) for c in target.columns if c not in keys)).select(*target.columns)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the source rows whose key it lacks."""
    return target.unionByName(source.select(*target.columns).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def fill_blanks(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null or empty values of the columns are taken from the source."""
    new = source.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = target.join(new, keys, "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in target.columns))


def plan_sync(target: DataFrame, source: DataFrame, keys: list[str], kind: str, label: str, protected: list[str]) -> DataFrame:
    """What a sync would do to each key: INSERT, UPDATE, NO-OP, SKIP (a protected kind differs) or DROP."""
    o, n = target.select(*keys, F.col(kind).alias("old_kind"), F.col(label).alias("old_label"), F.lit(True).alias("_o")), source.select(*keys, F.col(kind).alias("new_kind"), F.col(label).alias("new_label"), F.lit(True).alias("_n"))
    both = o.join(n, keys, "full_outer")
    same = F.col("old_kind").eqNullSafe(F.col("new_kind")) & F.col("old_label").eqNullSafe(F.col("new_label"))
    action = F.when(F.col("_o").isNull(), "INSERT").when(F.col("_n").isNull(), "DROP").when(same, "NO-OP").when(F.col("old_kind").isin(*protected), "SKIP").otherwise("UPDATE")
    return both.select(*keys, "old_kind", "new_kind", action.alias("action"))


def rederive(df: DataFrame, column: str, fresh: Column) -> DataFrame:
    """Counts of rows that re-deriving a column would update, fill or clear."""
    old = F.nullif(F.col(column), F.lit(""))
    new = F.nullif(fresh, F.lit(""))
    return df.agg(
        F.count_if(old.isNotNull() & new.isNotNull() & (old != new)).alias("updated"), F.count_if(old.isNull() & new.isNotNull()).alias("filled"), F.count_if(old.isNotNull() & new.isNull()).alias("cleared")
    )


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``reasons``: the names of the rules that a row breaks (null counts as broken)."""
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return df.withColumn("reasons", F.filter(broken, lambda x: x.isNotNull()))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Children of the touched parents are those of ``fresh``; the others stay."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def check_targets(counts: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``n`` against ``target``, within the greater of 5 and 5 %; no verdict without a target."""
    joined = counts.join(small(targets), key, "full_outer")
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("target"))
    return joined.select(key, F.coalesce("n", F.lit(0)).alias("n"), "target", (off <= F.greatest(F.lit(5.0), F.col("target") * 0.05)).alias("ok"))


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert_by_first_key(target: DataFrame, source: DataFrame, keys: list[tuple[str, Column]], policy: dict[str, str], order: list[Column]) -> DataFrame:
    """Upserts one key after the other: a source row goes by the first key that it has and whose condition holds, else it is skipped."""
    left = F.lit(True)
    for key, holds in keys:
        mine = left & F.coalesce(holds, F.lit(False)) & F.col(key).isNotNull()
        target = upsert(target, source.filter(mine).select(*target.columns), [key], policy, order)
        left = left & ~mine
    return target


def validate_typed(df: DataFrame, kind: str, common: dict[str, Column], by_type: dict[str, dict[str, Column]], strict: bool) -> DataFrame:
    """``df`` with ``reasons`` (names of rules that a row breaks: common ones, and its type's) and ``unknown`` (a type without rules).

    With ``strict`` an unknown type is a reason too. A condition that is null is broken.
    """
    broken = lambda name, rule, when: F.when(when & ~F.coalesce(rule, F.lit(False)), name)
    every = [broken(n, r, F.lit(True)) for n, r in common.items()] + [broken(n, r, F.col(kind).eqNullSafe(F.lit(k))) for k, rules in by_type.items() for n, r in rules.items()]
    unknown = ~F.col(kind).isin(*by_type)
    every += [F.when(F.coalesce(unknown, F.lit(True)), "unknown type")] if strict else []
    return df.withColumn("reasons", F.filter(F.array(*every), lambda x: x.isNotNull())).withColumn("unknown", unknown)
