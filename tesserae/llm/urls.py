"""URL filters: rules by host and path first, then a classifier of the words in the name.

Names are written together, so a unigram model splits each host label and path part into its
likeliest words (Viterbi); a multinomial naive Bayes over the words of host and path then decides.
Word counts, for splitting and for the classifier, are taken over all rows; seed words tell which
rows the classifier learns from as bad ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path) prefixes with their verdicts; a rule fits its host and all subdomains.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words of names that are bad for certain; rows with one of them, split or not, are the classifier's bad rows.
SEEDS = frozenset("spam casino pills bets bet poker viagra porn xxx warez ads adserver track tracker malware phish lottery jackpot loan loans".split())
#: Occurrences that a seed word has among the bad from the start.
SEED_COUNT = 2
#: Ordinary words that names are made of, so that written-together names can be split in small tables too.
ORDINARY = "free win cheap farm play best online shop news blog mail home world the my top web site host data book club play game games money cash deal deals health care book photo video music sport travel food".split()
#: Size of the model: most frequent words that the splitter and the classifier know. Counts themselves cover all rows.
VOCABULARY = 100_000
LONGEST = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", text) > 0, F.substring(text, F.locate("://", text) + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        where, _, start = name.partition("/")
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


class Splitter:
    """Splits letters into the likeliest sequence of words under unigram counts."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.counts, self.total = counts, total
        self.cost = {w: -math.log10(c / total) for w, c in counts.items()}
        self.unknown = math.log10(total)
        self.known: dict[str, list[str]] = {}

    def split(self, letters: str, own: int = 0) -> list[str]:
        """An unknown word costs the more the longer it is, so names of known words come apart and others stay whole.

        ``own`` occurrences of the whole are its own and don't vouch for it.
        """
        if not own and letters in self.known:
            return self.known[letters]
        n, cost = len(letters), self.cost.get
        if own:
            left = self.counts.get(letters, 0) - own
            whole = -math.log10(left / self.total) if left > 0 else None
            cost = lambda w: whole if w == letters else self.cost.get(w)
        best, came = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            found = (math.inf, 0)
            for start in range(max(0, end - LONGEST), end):
                c = cost(letters[start:end])
                c = self.unknown + 1 + 0.8 * (end - start) if c is None else c
                if end - start < 3:
                    c += 2
                found = min(found, (best[start] + c, start))
            if end > LONGEST:  # a longer unknown word goes on
                found = min(found, (best[end - 1] + 0.8, came[end - 1]))
            best[end], came[end] = found
        words, end = [], n
        while end:
            words.append(letters[came[end] : end])
            end = came[end]
        if not own:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[letters] = words[::-1]
        return words[::-1]


def url_words(splitter: Splitter, host: str, path: str) -> list[str]:
    """Words of the name with the part of the URL they come from; the public suffix and a leading www say nothing."""
    labels = host.split(":")[0].split(".")
    if len(labels) > 1:
        labels = labels[:-1]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    out = []
    for kind, text in (("h", " ".join(labels)), ("p", path.lower())):
        for token in _TOKEN.findall(text):
            out += [f"{kind}:#"] if token.isdigit() else [f"{kind}:{w}" for w in (splitter.split(token) if kind == "h" else [token])]
    return out


class Bayes:
    """Multinomial naive Bayes with add-one smoothing over two classes of words."""

    def __init__(self, counts: dict[str, tuple[int, int]], rows: tuple[int, int]):
        good, bad = (sum(c[i] for c in counts.values()) + len(counts) + 1 for i in (0, 1))
        self.odds = {w: math.log((b + 1) / bad) - math.log((g + 1) / good) for w, (g, b) in counts.items()}
        self.unknown = math.log(good / bad)
        self.prior = 0.0 if min(rows) < 1 else 0.5 * math.log(rows[1] / rows[0])  # half way to even classes: bad rows are few

    def bad(self, words: list[str]) -> bool:
        """Whether a name is more probably bad; a name without words is not."""
        return bool(words) and self.prior + sum(self.odds.get(w, self.unknown) for w in words) > 0


def train(parsed: DataFrame) -> tuple[Splitter, Bayes]:
    """Splitter and classifier from all rows of ``host, path``; at most ``VOCABULARY`` words of each reach the driver.

    Words are counted twice: as labels are written, then in the likeliest split of each label, for
    which its own occurrences don't count, so names written together are no words for being frequent.
    """
    names = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    tokens = names.select(F.explode(F.array_distinct(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0)))).alias("w"), "n")
    counted = tokens.filter(F.length("w").between(2, LONGEST)).groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(VOCABULARY)
    listed = Counter([*ORDINARY, *SEEDS])
    first = Splitter(listed + Counter({r.w: r.n for r in counted.collect()}))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(part, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for part in first.split(w, n)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["w", "n"])

    labels = tokens.filter(F.length("w") > 1).groupBy("w").agg(F.sum("n").alias("n"))
    split = labels.mapInArrow(apart, "w string, n long").filter(F.length("w").between(2, LONGEST)).groupBy("w").agg(F.sum("n").alias("n"))
    splitter = Splitter(listed + Counter({r.w: r.n for r in split.orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()}))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], int] = {}
            for host, path, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = url_words(splitter, host, path)
                bad = int(any(w[2:] in SEEDS for w in found if w[0] == "h"))
                for w in [*found, ""]:
                    sums[w, bad] = sums.get((w, bad), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["w", "bad", "n"])

    by_word = names.mapInArrow(words, "w string, bad int, n long").groupBy("w").agg(F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("bad"))
    rows = {r.w: (r.good, r.bad) for r in by_word.orderBy(F.desc(F.col("good") + F.col("bad")), "w").limit(VOCABULARY).collect()}
    totals = rows.pop("", (0, 0))
    for w in SEEDS:
        good, bad = rows.get(f"h:{w}", (0, 0))
        rows[f"h:{w}"] = (good, bad + SEED_COUNT)
    return splitter, Bayes(rows, totals)


def judged(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of ``pages`` (``page_id``, ``url``).

    A null URL, or one without ``://``, has empty parts and is allowed; equal URLs are judged alike;
    an empty table gives none; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    splitter, bayes = train(parsed.select("host", "path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [v or ("block" if bayes.bad(url_words(splitter, h, p)) else "allow") for h, p, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(said, pa.string())], names=batch.schema.names)

    return parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
