"""Vector and trigram search with rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.predicates import folded
from tesserae.operators.relational import small, top_n_per_group


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_norm(df: DataFrame, vector: str = "v") -> DataFrame:
    """``df`` with the vector's length as ``norm``."""
    return df.withColumn("norm", F.sqrt(dot(F.col(vector), F.col(vector))))


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, same_tenant: bool = True, rows: int = 4096) -> DataFrame:
    """Exact top ``k`` items by cosine for each of query rows (``query_id, tenant, v``), of the same tenant or of all others.

    Scores are rounded to 6 places and ties go to the lower id; a query is not its own hit.
    """
    found = block_products(queries, items, k, "same" if same_tenant else "other", rows=rows).filter("id is not null").select("query_id", "id", (1 - F.col("distance")).alias("score"))
    best = top_n_per_group(found.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.asc("id")], k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))


def least_k(far: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` least finite values of each row, ties to the lower of ``others``; only values up to the k-th are ordered."""
    near = np.isfinite(far)
    if 0 < k < far.shape[1]:
        near &= far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    row, at = np.nonzero(near)
    order = np.lexsort((others[at], far[row, at], row))
    row, at = row[order], at[order]
    mine = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[mine], at[mine]


def block_products(queries: DataFrame, items: DataFrame, k: int, tenants: str, penalty: float = 1.0, most: float | None = None, rows: int = 4096) -> DataFrame:
    """``query_id, id, distance``: partial lists of the ``k`` nearest items of each query, from products of blocks of vectors.

    ``tenants`` says which items count: ``same``, ``other`` or ``any``. Distances (one less the cosine)
    of the query's own tenant are multiplied by ``penalty``; those beyond ``most`` are dropped, and a
    row without id tells how many. Queries and items are dealt to blocks of about ``rows`` rows by
    counts, and each pair of blocks meets in one group, so neither side is broadcast.
    """
    key = F.col("tenant").cast("string") if tenants == "same" else F.lit("")

    def dealt(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy(key.alias("g")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(f"{name}_blocks"))
        return df.select(key.alias("g"), F.col(name).alias("id"), "tenant", "v"), sizes

    (q, q_sizes), (x, x_sizes) = dealt(queries, "query_id"), dealt(items, "id")
    sizes = q_sizes.join(x_sizes, "g").withColumnsRenamed({"query_id_blocks": "qs", "id_blocks": "xs"})
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes, "g").select("g", block("qs").alias("i"), every("xs").alias("j"), F.lit(True).alias("asks"), "id", "tenant", "v")
    right = x.join(sizes, "g").select("g", every("qs").alias("i"), block("xs").alias("j"), F.lit(False).alias("asks"), "id", "tenant", "v")

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, out = pdf[pdf["asks"]], pdf[~pdf["asks"]], []
        if len(a) and len(b):
            one, two = (np.stack(part["v"].to_list()) for part in (a, b))
            one, two = (u / np.linalg.norm(u, axis=1, keepdims=True) for u in (one, two))
            ids, others, ours, theirs = a["id"].to_numpy(), b["id"].to_numpy(), a["tenant"].to_numpy(), b["tenant"].to_numpy()
            for at in range(0, len(ids), 512):
                part = slice(at, at + 512)
                same = ours[part, None] == theirs[None, :]
                far = np.round(1 - np.round(one[part] @ two.T, 6), 6)
                far = np.round(far * np.where(same, penalty, 1.0), 6)
                far[(ids[part, None] == others[None, :]) | (same if tenants == "other" else False)] = np.inf
                beyond = np.isfinite(far) & (far > most) if most is not None else np.zeros(far.shape, bool)
                far[beyond] = np.inf
                row, col = least_k(far, others, k)
                out.append(pd.DataFrame({"query_id": ids[part][row], "id": others[col], "distance": far[row, col]}))
                if most is not None:
                    out.append(pd.DataFrame({"query_id": ids[part], "id": pd.array([None] * len(ids[part]), "Int64"), "distance": beyond.sum(1).astype(float)}))
        got = pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": []})
        return got.astype({"query_id": "int64", "id": "Int64", "distance": "float64"})

    return left.union(right).groupBy("g", "i", "j").applyInPandas(nearest, "query_id long, id long, distance double")


def pairs_of_blocks(items: DataFrame, blocks: int | None, rows: int) -> DataFrame:
    """``id, tenant, v, b, i, j``: each item in block ``b`` of its tenant, once for each pair ``i, j`` of blocks with its own."""
    number = F.lit(blocks) if blocks else F.ceil(F.count(F.lit(1)) / F.lit(rows))
    sizes = items.groupBy(F.col("tenant").alias("of")).agg(number.cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = items.join(sizes, F.col("tenant").eqNullSafe(F.col("of"))).select("id", "tenant", "v", "blocks", block.alias("b"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "b").alias("i"), F.greatest(x, "b").alias("j")))
    return placed.select("id", "tenant", "v", "b", F.explode(pairs).alias("p")).select("id", "tenant", "v", "b", "p.i", "p.j")


def all_pairs_top_k(items: DataFrame, k: int, blocks: int | None = None, rows: int = 4096) -> DataFrame:
    """Each item's ``k`` nearest others in its tenant, from products of blocks of vectors.

    A tenant's items are dealt to blocks of about ``rows`` items, or to ``blocks`` blocks; every pair
    of blocks meets in one group, whose product gives partial top-k lists; only those are shuffled to
    the merge, never all pairs.
    """
    dealt = pairs_of_blocks(items, blocks, rows)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        left, right = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        out = []
        for a, b in ((left, right), (right, left)) if i != j else ((left, left),):
            if a.empty or b.empty:
                continue
            unit = [np.stack(x["v"].to_list()) for x in (a, b)]
            unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in unit]
            ids, others = a["id"].to_numpy(), b["id"].to_numpy()
            for at in range(0, len(ids), 512):
                score = np.round(unit[0][at : at + 512] @ unit[1].T, 6)
                score[ids[at : at + 512, None] == others[None, :]] = -np.inf
                row, col = least_k(-score, others, k)
                out.append(pd.DataFrame({"id": ids[at : at + 512][row], "other": others[col], "score": score[row, col]}))
        got = pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "score": []})
        return got[np.isfinite(got["score"].astype(float))].astype({"id": "int64", "other": "int64", "score": "float64"})

    partial = dealt.groupBy("tenant", "i", "j").applyInPandas(best, "id long, other long, score double")
    merged = top_n_per_group(partial, ["id"], [F.desc("score"), F.asc("other")], k)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.asc("other"))))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two arrays of them, rounded to 6 places."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.round(F.when(every > 0, shared / every).otherwise(0.0), 6)


#: Queries that every item is held against inside its own row, at most.
CROSSED = 64


def trigram_search(queries: DataFrame, items: DataFrame, columns: list[str], k: int, least: float = 0.1, crossed: int = CROSSED) -> DataFrame:
    """Items by the best trigram similarity of any column to the query text, above ``least``: top ``k`` a query.

    Up to ``crossed`` queries are broadcast and held against each item inside its row, so nothing is
    grouped. Of more, trigrams are joined with those of items and shared ones are counted for each
    query, item and column, so only items that share one are touched. A null column has none.
    """
    grams = lambda c: trigrams(F.coalesce(F.col(c), F.lit("")))
    q = queries.select("query_id", grams("query").alias("q"))
    score = lambda n, nq, ng: F.round(n / (nq + ng - n), 6)
    if q.limit(crossed + 1).count() <= crossed:
        every = F.broadcast(q.agg(F.collect_list(F.struct("query_id", "q")).alias("_q")))
        met = items.select("id", *(grams(c).alias(f"_g{i}") for i, c in enumerate(columns))).join(every, F.lit(True))

        def held(x: Column) -> Column:
            """The query with its best score; shared trigrams are counted once."""
            of = lambda g: F.transform(F.array(F.size(F.array_intersect(g, x["q"]))), lambda n: F.when(n > 0, score(n, F.size(x["q"]), F.size(g))))
            return F.struct(x["query_id"].alias("query_id"), F.array_max(F.concat(*(of(F.col(f"_g{i}")) for i in range(len(columns))))).alias("score"))

        scored = met.select("id", F.explode(F.filter(F.transform("_q", held), lambda s: s["score"] > least)).alias("s")).select("s.query_id", "id", "s.score")
    else:
        asked = q.select("query_id", F.size("q").alias("nq"), F.explode("q").alias("gram"))
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), grams(c).alias("g")) for i, c in enumerate(columns))))
        indexed = items.select("id", each.alias("x")).select("id", "x.c", F.size("x.g").alias("ng"), F.explode("x.g").alias("gram"))
        shared = indexed.join(small(asked), "gram").groupBy("query_id", "id", "c").agg(F.count(F.lit(1)).alias("n"), F.first("nq").alias("nq"), F.first("ng").alias("ng"))
        scored = shared.withColumn("score", score(F.col("n"), F.col("nq"), F.col("ng"))).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = top_n_per_group(scored.filter(F.col("score") > least), ["query_id"], [F.desc("score"), F.asc("id")], k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))


def rank_fusion(semantic: DataFrame, lexical: DataFrame, n: int, weights: tuple[float, float] = (0.7, 0.3), base: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of two ranked legs, with the kind of match; top ``n`` a query, ties to the lower id."""
    a, b = semantic.select("query_id", "id", F.col("rank").alias("r_sem")), lexical.select("query_id", "id", F.col("rank").alias("r_lex"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda c, w: F.coalesce(F.lit(w) / (F.col(c) + base), F.lit(0.0))
    kind = F.when(F.col("r_lex").isNull(), "semantic").when(F.col("r_sem").isNull(), "lexical").otherwise("both")
    fused = both.select("query_id", "id", F.round(part("r_sem", weights[0]) + part("r_lex", weights[1]), 6).alias("score"), kind.alias("match"))
    return top_n_per_group(fused, ["query_id"], [F.desc("score"), F.asc("id")], n)


def boosted(queries: DataFrame, items: DataFrame, excluded: list, most: float, n: int, penalty: float = 1.2) -> DataFrame:
    """``query_id, id, adjusted``, nearest first after a penalty on the query's own tenant, with the query's counts of what was left out.

    ``n_excluded`` items are of excluded tenants, ``n_far`` are beyond ``most``; a query without hits has a row without id.
    """
    out = items.filter(F.col("tenant").isin(*excluded)).agg(F.count(F.lit(1)).alias("n_excluded"))
    found = block_products(queries, items.filter(~F.col("tenant").isin(*excluded)), n, "any", penalty, most)
    far = found.filter("id is null").groupBy("query_id").agg(F.sum("distance").cast("long").alias("n_far"))
    best = top_n_per_group(found.filter("id is not null").withColumnRenamed("distance", "adjusted"), ["query_id"], [F.asc("adjusted"), F.asc("id")], n)
    # one row of totals; a query of an excluded tenant is not among what was left out for it
    own = queries.select("query_id", F.col("tenant").isin(*excluded).cast("long").alias("own"))
    return own.join(far, "query_id", "left").join(best, "query_id", "left").join(F.broadcast(out), F.lit(True)).select("query_id", "id", "adjusted", (F.col("n_excluded") - F.col("own")).alias("n_excluded"), F.coalesce("n_far", F.lit(0).cast("long")).alias("n_far"))


def best_part(parts: DataFrame, queries: DataFrame, group: str, order: str, title: str, content: str) -> DataFrame:
    """Of each query and group, the part with most points: 1 for a term in title or content, 2 more in the title; none at 0.

    Terms are the query's words of three letters or more, without marks, distinct or not.
    """
    words = F.filter(F.split(folded(F.lower("query")), r"\W+"), lambda w: F.length(w) >= 3)
    terms = small(queries.select("query_id", F.explode(words).alias("term")))
    low = parts.select(group, order, F.lower(title).alias("_title"), F.lower(F.concat(F.col(title), F.lit(" "), F.col(content))).alias("_all"))
    hits = low.join(terms, F.contains("_all", "term"))
    points = hits.groupBy("query_id", group, order).agg(F.sum(F.lit(1) + F.contains("_title", "term").cast("int") * 2).alias("score"))
    return top_n_per_group(points, ["query_id", group], [F.desc("score"), F.asc(order)], 1)


def project(items: DataFrame) -> DataFrame:
    """``id, x, y``: two principal components of every vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = items.select("id", array_to_vector("v").alias("features"))
    xy = vector_to_array("flat")
    return PCA(k=2, inputCol="features", outputCol="flat").fit(ready).transform(ready).select("id", F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))


def map_model(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a user's model function from a pandas frame to a pandas frame, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
