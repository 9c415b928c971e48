"""Transcript operators: chunks, merges, verbatim quotes, lens scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.predicates import folded, verbatim_key
from tesserae.operators.relational import small


def chunk_segments(df: DataFrame, seconds: float) -> DataFrame:
    """Segments of each source gathered until a chunk spans ``seconds``; then the next begins. One fold a source."""
    items = F.array_sort(F.collect_list(F.struct("idx", "start_s", "end_s")))
    kind = "array<struct<lo:double,hi:double,first:bigint,last:bigint>>"
    zero = F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("struct<lo:double,hi:double,first:bigint,last:bigint>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.when(acc["open"].isNull(), F.struct(x["start_s"].alias("lo"), x["end_s"].alias("hi"), x["idx"].alias("first"), x["idx"].alias("last"))).otherwise(
            F.struct(acc["open"]["lo"].alias("lo"), F.greatest(acc["open"]["hi"], x["end_s"]).alias("hi"), acc["open"]["first"].alias("first"), x["idx"].alias("last"))
        )
        full = grown["hi"] - grown["lo"] >= seconds
        return F.struct(F.when(full, F.array_append(acc["out"], grown)).otherwise(acc["out"]).alias("out"), F.when(~full, grown).alias("open"))

    done = F.aggregate(items, zero, step, lambda acc: F.when(acc["open"].isNotNull(), F.array_append(acc["out"], acc["open"])).otherwise(acc["out"]))
    return df.groupBy("source_id").agg(done.alias("c")).select("source_id", F.posexplode("c").alias("chunk", "x")).select("source_id", "chunk", "x.lo", "x.hi", "x.first", "x.last")


def merge_chunks(df: DataFrame) -> DataFrame:
    """Segments that start before the greatest end of earlier ones are dropped."""
    before = F.max("end_s").over(Window.partitionBy("source_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("start_s") >= F.col("_before"))).drop("_before")


#: Bits of a filter a key, and bits of a filter at most (8 MB), past which it only lets more through.
BITS_A_KEY, MOST_BITS = 16, 1 << 26


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def key_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """One row ``words``: a Bloom filter with two bits for each hash in ``column``, as ``bits / 64`` longs."""
    word = lambda at: F.shiftright(at, 6).cast("int").alias("word")
    on = keys.select(F.explode(F.array(F.pmod(column, F.lit(bits)), F.pmod(F.shiftrightunsigned(column, 32), F.lit(bits)))).alias("at")).select(word(F.col("at")), _bit(F.col("at")).alias("set"))
    off = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("set"))
    full = on.union(off).groupBy("word").agg(F.bit_or("set").alias("set"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words"))  # bounded by MOST_BITS


def may_hold(words: Column, key: Column, bits: int) -> Column:
    """Whether a filter may hold the hash ``key``, which is computed once."""

    def hit(at: Column) -> Column:
        return F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0

    return F.exists(F.array(key), lambda k: hit(F.pmod(k, F.lit(bits))) & hit(F.pmod(F.shiftrightunsigned(k, 32), F.lit(bits))))


def verbatim_matches(quotes: DataFrame, texts: DataFrame, probe: int = 8) -> DataFrame:
    """``item_id, doc_id`` of quotes (three characters or more) that occur in texts after folding, each pair once.

    A quote may begin and end inside a word. One of three words or more is known by a hash of its
    inner words, ``probe`` at most, with the characters next to them; a shorter one by that of its
    first characters, ``probe`` at most. The hashes are a Bloom filter, which every text is held
    against inside its own row; only places that pass become rows, each with a piece of the text as
    long as the longest quote, and an exact join decides. So what is shuffled follows the matches,
    not the words, and no text moves. Null and empty quotes and texts match nothing.
    """
    q = quotes.select("item_id", verbatim_key(F.col("text")).alias("q")).filter(F.length("q") >= 3).withColumn("w", F.split("q", " "))
    inner = F.least(F.size("w") - 2, F.lit(probe))
    q = q.withColumn("kind", F.when(F.size("w") > 2, inner).otherwise(-F.least(F.length("q"), F.lit(probe))))

    def run(w: Column, i: Column, n: Column) -> Column:
        """Hash of ``n`` words from place ``i``, with the last character before and the first after them."""
        return F.xxhash64(n, F.substring(F.get(w, i - 2), -1, 1), F.slice(w, i, n), F.substring(F.get(w, i + n - 1), 1, 1))

    def start(chars: Column, i: Column, n: Column) -> Column:
        return F.xxhash64(-n, F.slice(chars, i, n))

    keyed = q.withColumn("h", F.when(F.col("kind") > 0, run(F.col("w"), F.lit(2), F.col("kind"))).otherwise(start(F.split("q", ""), F.lit(1), -F.col("kind")))).select("item_id", "q", "kind", "h", F.size("w").alias("n"))
    # scalars only: at most 2 * probe kinds, the longest quotes, and how many hashes there are
    known = keyed.agg(F.collect_set("kind").alias("kinds"), F.max("n").alias("words"), F.max(F.when(F.col("kind") < 0, F.length("q"))).alias("chars"), F.approx_count_distinct("h").alias("keys")).first()
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_A_KEY * known.keys).bit_length()))
    held = key_filter(keyed.select("h"), "h", bits)

    t = texts.select("doc_id", verbatim_key(F.col("text")).alias("t")).withColumn("w", F.split("t", " "))
    t = t.withColumn("chars", F.split("t", "") if any(k < 0 for k in known.kinds) else F.array().cast("array<string>")).drop("t").join(F.broadcast(held), F.lit(True))

    def places(kind: int) -> Column:
        """Places of the text that pass the filter as a quote of this kind."""
        n = F.lit(abs(kind))
        last = F.size("w") - n if kind > 0 else F.size("chars") - n + 1
        first = 2 if kind > 0 else 1
        key = (lambda i: run(F.col("w"), i, n)) if kind > 0 else (lambda i: start(F.col("chars"), i, n))
        found = F.filter(F.sequence(F.lit(first), last), lambda i: may_hold(F.col("words"), key(i), bits))
        return F.transform(F.when(last >= first, found).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("i")))

    none = F.array().cast("array<struct<kind:int,i:int>>")
    # the outer form, since Spark would compute the places a second time to drop texts without one
    at = t.select("doc_id", "w", "chars", F.explode_outer(F.concat(none, *(places(k) for k in sorted(known.kinds)))).alias("at")).filter("at is not null").select("doc_id", "w", "chars", "at.kind", "at.i")
    whole = F.col("kind") > 0
    key = F.when(whole, run(F.col("w"), F.col("i"), F.col("kind"))).otherwise(start(F.col("chars"), F.col("i"), -F.col("kind")))
    piece = F.when(whole, F.array_join(F.slice("w", F.when(whole, F.col("i") - 1).otherwise(1), F.lit(known.words or 1)), " ")).otherwise(F.array_join(F.slice("chars", "i", F.lit(known.chars or 1)), ""))
    return at.select("doc_id", key.alias("h"), piece.alias("piece")).join(keyed.select("h", "item_id", "q"), "h").filter(F.contains("piece", F.col("q"))).select("item_id", "doc_id").distinct()


def timestamp_audit(notes: DataFrame, segments: DataFrame, before: float = 15, after: float = 90, slack: float = 1, probe: int = 8) -> DataFrame:
    """``notes`` (``source_id, note, start_s, end_s, text``) with ``status`` and ``actual``.

    The first that applies: ``untimed`` (no start), ``bounds`` (start or end past the source's last
    end by more than ``slack`` seconds, or a source without segments), ``order`` (an end that is not
    after the start), ``ok`` for a note without text. Of a text, the ``probe`` words in its middle are
    sought as whole words in a row in the source's joined segments, across their borders: ``ok`` if
    the segments of the first and the last of them start within ``before`` and ``after`` of the note's
    start, else ``elsewhere``, with the start of the segment where the first occurrence ends as
    ``actual``, else ``missing``, as is a text with fewer words. Every segment takes along the next
    words of its source; its runs are held against a filter of the probes inside its row, so only
    likely ones are joined. One row a note; repeated notes stay.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(folded(F.lower(c)), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    said = F.col("_said")
    middle = F.slice(said, F.greatest(F.lit(0), F.floor(F.size(said) / 2).cast("int") - probe // 2) + 1, probe)
    asked = notes.withColumn("_said", words("text")).withColumn("_probe", F.when(F.size(said) >= probe, F.array_join(middle, " ")))
    probes = asked.filter("_probe is not null and start_s is not null").select("source_id", "_probe", "start_s").distinct().withColumn("_h", F.xxhash64("_probe"))
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_A_KEY * probes.agg(F.approx_count_distinct("_h")).first()[0]).bit_length()))

    own = segments.select("source_id", "idx", F.transform(words("text"), lambda w: F.struct(w.alias("w"), F.col("start_s").alias("s"))).alias("own")).filter(F.size("own") > 0)
    # every segment here has a word, so the next probe - 1 of them hold all words that a run can need
    later = Window.partitionBy("source_id").orderBy("idx").rowsBetween(1, probe - 1)
    rest = F.slice(F.flatten(F.collect_list(F.slice("own", 1, probe - 1)).over(later)), 1, probe - 1)
    joined = own.select("source_id", "idx", F.size("own").alias("n"), F.concat("own", rest).alias("all")).join(F.broadcast(key_filter(probes.select("_h"), "_h", bits)), F.lit(True))
    run = lambda i: F.array_join(F.transform(F.slice("all", i, probe), lambda x: x["w"]), " ")
    last = F.least(F.col("n"), F.size("all") - (probe - 1))
    hits = F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), lambda i: may_hold(F.col("words"), F.xxhash64(run(i)), bits)))
    found = joined.select("source_id", "idx", "all", F.explode_outer(hits).alias("i")).filter("i is not null")
    found = found.select("source_id", "idx", "i", run(F.col("i")).alias("_probe"), F.get("all", F.col("i") - 1)["s"].alias("_from"), F.get("all", F.col("i") + (probe - 2))["s"].alias("_to"))
    inside = lambda c: F.col(c).between(F.col("start_s") - before, F.col("start_s") + after)
    told = probes.join(found, ["source_id", "_probe"]).groupBy("source_id", "_probe", "start_s").agg(F.bool_or(inside("_from") & inside("_to")).alias("_near"), F.min(F.struct("idx", "i", "_to")).alias("_first"))

    ends = segments.groupBy("source_id").agg(F.max("end_s").alias("_most"))
    full = asked.join(ends, "source_id", "left").join(told, ["source_id", "_probe", "start_s"], "left")
    past = F.coalesce(F.greatest("start_s", "end_s") > F.col("_most") + slack, F.lit(True))
    status = (
        F.when(F.col("start_s").isNull(), "untimed").when(past, "bounds").when(F.col("end_s") <= F.col("start_s"), "order").when(F.col("text").isNull() | F.coalesce("_near", F.lit(False)), "ok")
        .when(F.col("_first").isNotNull(), "elsewhere").otherwise("missing")
    )
    return full.withColumn("status", status).select(*notes.columns, "status", F.when(F.col("status") == "elsewhere", F.col("_first._to")).alias("actual"))


def score_lenses(events: DataFrame, lenses: DataFrame, text: str = "text") -> DataFrame:
    """Share of a lens's concepts that occur in an event's folded text; 0 for an empty list or text."""
    low = folded(F.lower(text))
    joined = events.withColumn("_t", low).join(small(lenses), F.lit(True))
    hits = F.size(F.filter("concepts", lambda c: (c != "") & F.contains(F.col("_t"), F.lower(c))))
    return joined.withColumn("score", F.round(F.when((F.size("concepts") > 0) & (F.length("_t") > 0), hits / F.size("concepts")).otherwise(0.0), 6)).drop("_t")


def choose_attempt(df: DataFrame, key: str, order: str, least: float) -> DataFrame:
    """The first attempt that passed with at least ``least``, else the best, the earliest of equals."""
    good = F.when(F.col("passed") & (F.col("score") >= least), F.col(order))
    done = df.groupBy(key).agg(F.min(good).alias("a"), F.min(F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"))).alias("b"))
    return done.select(key, F.coalesce("a", "b.o").alias(order), F.col("a").isNotNull().alias("passed"))


def validated_quotes(quotes: DataFrame, segments: DataFrame, authors: list[str], window: int, blocked: list[str], cap: int, slack: float = 10.0, shortest: int = 10, longest_short: int = 280) -> DataFrame:
    """``quotes`` (``source_id, quote, author, first, last, quoted``) with ``reason`` and ``platforms``.

    The first that applies: too short (``schema``), not an allowed author, a segment number out of
    bounds, one beyond the ``window`` that was shown, words that the segments within ``slack`` seconds
    don't have in this order, a blocked phrase; of the rest ``cap`` a source are ``kept``. Quotes of
    more than ``longest_short`` characters go without the short platform.
    """
    ends = segments.groupBy("source_id").agg(F.max("idx").alias("most"))
    at = segments.select("source_id", "idx", "start_s", "end_s")
    known = quotes.join(ends, "source_id").join(at.select("source_id", F.col("idx").alias("first"), F.col("start_s").alias("_from")), ["source_id", "first"], "left").join(at.select("source_id", F.col("idx").alias("last"), F.col("end_s").alias("_to")), ["source_id", "last"], "left")
    # only quotes that get as far as the comparison meet segments
    reason = F.when(F.length(F.trim("quoted")) < shortest, "schema").when(~F.col("author").isin(*authors), "author").when(F.col("last") > F.col("most"), "bounds").when(F.greatest("first", "last") >= window, "window")
    judged = known.withColumn("reason", reason)
    timed = judged.filter("reason is null").select("source_id", "quote", "_from", "_to").join(segments.select("source_id", "idx", "start_s", "end_s", "text"), "source_id")
    near = timed.filter((F.col("end_s") >= F.col("_from") - slack) & (F.col("start_s") <= F.col("_to") + slack)).groupBy("source_id", "quote").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ").alias("_near"))
    said = F.coalesce((F.length(verbatim_key(F.col("quoted"))) >= 3) & F.contains(verbatim_key(F.col("_near")), verbatim_key(F.col("quoted"))), F.lit(False))
    bad = F.exists(F.array(*(F.lit(b) for b in blocked)), lambda b: F.contains(F.lower("quoted"), b))
    full = judged.join(near, ["source_id", "quote"], "left").withColumn("reason", F.coalesce("reason", F.when(~said, "not verbatim").when(bad, "blocked")))
    passed = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("source_id").orderBy("quote"))
    short = F.when(F.length("quoted") > longest_short, F.array(F.lit("web"))).otherwise(F.array(F.lit("web"), F.lit("short")))
    return full.withColumn("_passed", passed).select(*quotes.columns, F.coalesce("reason", F.when(F.col("_passed") > cap, "cap").otherwise("kept")).alias("reason"), short.alias("platforms"))
