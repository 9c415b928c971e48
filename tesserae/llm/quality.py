"""Quality rules: a threshold table compiled into one projection, without user functions.

``RULES`` names a numerator, a denominator and the allowed range of their ratio; ``kept_by``
turns the table into one Boolean column. The counts come from arrays inside the row, so nothing
is shuffled and long texts need no more than their own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, fresh, let, words

#: Frequent short words of English, French, Spanish and German: running text has some of them.
STOP_WORDS = sorted(
    set(
        "the and of to in is was that it for on with as be are this by or from at an not but have has he they you we his her their which "
        "le la les de des du un une et est en que qui dans sur par pour pas au aux avec il elle ce se ne ou "
        "el los las del al y es por con para una su lo como se no más o pero "
        "der die das und ist nicht ein eine von mit zu den dem im auf für sich als auch es an werden aus er hat dass sie nach bei".split()
    )
)

#: name, numerator, denominator, least, most (None: open). A document is kept if every ratio lies in its range.
RULES = [
    ("word length", "word_chars", "n_words", 1.5, 25.0),
    ("symbols a word", "n_symbols", "n_words", None, 0.3),
    ("stop words a word", "n_stop_words", "n_words", 0.02, None),
    ("repeated lines a line", "n_dup_lines", "n_text_lines", None, 0.5),
]
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, (20, 100)


def _repeated(found: Column) -> Column:
    """Words that lie in a window of five words which the text has twice or more."""

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            starts = F.transform(s, lambda x, k: F.when(F.when(k > 0, same(k - 1, x)).otherwise(F.lit(False)) | same(k + 1, x), x["i"]))
            return F.sort_array(F.filter(starts, lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(let(pairs, places), total))

    grams = F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(found, i, WINDOW)))
    return F.when(F.size(found) > WINDOW, let(grams, covered)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of the counts of one text (null: no words)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counts(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
            F.size(F.filter(found, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeated(found).cast("long").alias("n_repeat_words"),
        )

    def line_counts(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_text_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    return F.struct(let(words(text), counts).alias("w"), let(lines, line_counts).alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Too short, or too many repeated words."""
    return (n_words < MIN_WORDS) | (n_repeat_words * MAX_REPEAT[1] > n_words * MAX_REPEAT[0])


def kept_by(rules: list[tuple], column: dict[str, Column]) -> Column:
    """The table of rules as one Boolean column; a denominator of 0 passes."""
    verdict = F.lit(True)
    for _, top, below, least, most in rules:
        ratio = column[top] / F.when(column[below] == 0, None).otherwise(column[below])
        for bound in ([ratio >= least] if least is not None else []) + ([ratio <= most] if most is not None else []):
            verdict = verdict & F.coalesce(bound, F.lit(True))
    return verdict


def judge(df: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """``df`` with the counts, ``base_failed`` and ``kept`` (column names that ``df`` has get underscores in front).

    A null or empty text has no words, so it fails; repeated rows get equal results; an empty table stays empty.
    """
    m = fresh(df, "measured")
    col = {k: F.col(f"{m}.w.{k}") for k in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")} | {k: F.col(f"{m}.l.{k}") for k in ("n_text_lines", "n_dup_lines")} | {"n_symbols": F.col(f"{m}.n_symbols")}
    failed = base_failed(col["n_words"], col["n_repeat_words"])
    more = {k: col[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_text_lines")} | {"base_failed": failed, "kept": ~failed & kept_by(rules, col)}
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn(m, measures(F.col(f"`{text}`"))).select(*kept, *(v.alias(fresh(df, k)) for k, v in more.items()))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    judged = judge(docs)
    return judged.filter(F.col(judged.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).drop("text", "n_stop_words", "n_text_lines")


OP4_SQL = (
    r"""
WITH base AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT k, i, w[i:i+4] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) > 5)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT k, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM twice) GROUP BY k),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars0,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(w, lambda x: list_contains(["""
    + ", ".join(f"'{w}'" for w in STOP_WORDS)
    + r"""], lower(x)))) AS n_stop
  FROM base LEFT JOIN covered USING (k))
SELECT doc_id, n_words, coalesce(word_chars0, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20)
       AND coalesce(word_chars0 / n_words::DOUBLE BETWEEN 1.5 AND 25.0, true) AND coalesce(n_symbols / n_words::DOUBLE <= 0.3, true)
       AND coalesce(n_stop / n_words::DOUBLE >= 0.02, true) AND (n_lines = 0 OR n_dup_lines / n_lines::DOUBLE <= 0.5) AS kept
FROM counts
"""
)
