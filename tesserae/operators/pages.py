"""Structure of pages: elements as a table of numbered tags, the main element, what is left of it without excluded parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A comment, a script or style with its text, a tag, a text, or a lone bracket; together they are the whole page.
TOKEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[a-z/!?][^>]*>|[^<]+|<"
#: Elements without an end tag, or whose inside is no markup.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "script", "source", "style", "track", "wbr"]
#: Elements that never hold their like, so that the next one ends an open one.
FLAT = ["a", "p"]


def tokens(html: Column) -> Column:
    """The page as an array of ``TOKEN``; joined, they give the page back."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def selected(selector: str, name: str = "name", tag: str = "tag") -> Column:
    """Whether an element fits ``name``, ``.class``, ``name.class`` or ``#id``."""
    if selector[0] == "#":
        return F.regexp_extract(tag, r"""(?i)\sid\s*=\s*["']?([^"'\s>]*)""", 1) == selector[1:]
    kind, _, cls = selector.partition(".")
    words = F.split(F.regexp_extract(tag, r"""(?i)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0), r"""[\s"'=]+""")
    return (F.col(name) == kind if kind else F.lit(True)) & (F.array_contains(F.slice(words, 3, 1_000_000), cls) if cls else F.lit(True))


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row an element: ``key, name, tag, pre, post, stop, chars, paras, parent``.

    ``pre`` is the token of its start tag, ``post`` that of its end, ``stop`` the first token after
    it, so an element holds those with numbers between its own. ``chars`` counts the characters of
    its texts, blanks folded, and ``paras`` its ``p``. An end tag belongs to the last open start tag
    of its name: those of one name and one level alternate, so the pairs are neighbours in a window
    and no stack is kept. An element without an end tag reaches to the end of the page and is
    nobody's ``parent``; ``p`` and ``a`` end with the next of their kind. ``parent`` (of a ``p``) is
    the innermost element around it. Only numbers and start tags leave a page's row; windows are
    those of one page. ``key`` must be unique; null and empty pages have no element.
    """
    each = pages.select(key, F.posexplode(tokens(F.col(html))).alias("pos", "tok"))
    name = F.lower(F.regexp_extract("tok", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    each = each.withColumn("name", name).withColumn("closes", (name != "") & F.startswith("tok", F.lit("</")))
    each = each.withColumn("opens", (F.col("name") != "") & ~F.col("closes") & ~F.col("name").isin(*VOID) & ~F.endswith("tok", F.lit("/>")))
    text = F.when(~F.startswith("tok", F.lit("<")), F.length(F.trim(F.regexp_replace("tok", r"\s+", " ")))).otherwise(0)
    along = Window.partitionBy(key).orderBy("pos")
    whole = Window.partitionBy(key)
    each = each.select(key, "pos", "name", "opens", "closes", F.when(F.col("opens"), F.col("tok")).alias("tag"), text.alias("text"), (F.col("opens") & (F.col("name") == "p")).cast("int").alias("p"))
    each = each.withColumn("c", F.sum("text").over(along)).withColumn("q", F.sum("p").over(along))
    each = each.withColumn("end", F.struct((F.max("pos").over(whole) + 1).alias("pos"), F.max("c").over(whole).alias("c"), F.max("q").over(whole).alias("q"))).filter(F.col("opens") | F.col("closes"))

    flat = F.col("name").isin(*FLAT)
    open_now = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(Window.partitionBy(key, "name").orderBy("pos"))
    each = each.withColumn("level", F.when(flat, 0).when(F.col("opens"), open_now).otherwise(open_now + 1))
    same = Window.partitionBy(key, "name", "level").orderBy("pos")
    each = each.withColumn("then", F.lead(F.struct("pos", "c", "q", "closes")).over(same)).withColumn("ended", F.col("opens") & F.col("then").isNotNull() & (flat | F.col("then.closes")))
    ends = F.col("closes") & F.coalesce(F.lag("opens").over(same), F.lit(False))
    at = lambda c: F.when(F.col("ended"), F.col(f"then.{c}")).otherwise(F.col(f"end.{c}"))
    each = each.withColumn("step", F.when(flat, 0).when(F.col("ended"), 1).when(ends, -1).otherwise(0)).withColumn("post", at("pos")).withColumn("chars", at("c") - F.col("c")).withColumn("paras", at("q") - F.col("q"))
    each = each.withColumn("stop", F.col("post") + F.when(F.col("ended") & F.col("then.closes"), 1).otherwise(0))
    around = F.when(F.col("step") == 1, F.struct(F.col("pos").alias("pre"), "post", "paras"))
    upto = Window.partitionBy(key, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("depth", F.sum("step").over(along)).withColumn("parent", F.last(around, ignorenulls=True).over(upto))
    return each.filter("opens").select(key, "name", "tag", F.col("pos").alias("pre"), "post", "stop", "chars", "paras", F.when(F.col("name") == "p", F.col("parent")).alias("parent"))


def main_parts(pages: DataFrame, key: str, html: str, roots: list[str], excluded: list[str], least: int, paragraphs: int = 3) -> DataFrame:
    """``pages`` with ``content``: the markup inside the main element, without excluded elements, scripts, styles and comments.

    The main element is the first one in the page that fits the first selector of ``roots`` whose
    first element has more than ``least`` characters of text; if there is none, the parent of a
    ``p`` that holds the most ``p``, at least ``paragraphs``, the first of equals; else ``content``
    is null. The element table is reduced to a row a page before it meets the pages again.
    """
    found = elements(pages, key, html)
    firsts = [F.min(F.when(selected(s), F.struct("pre", "post", "chars"))).alias(f"_r{i}") for i, s in enumerate(roots)]
    most = F.min(F.when((F.col("name") == "p") & (F.col("parent.paras") >= paragraphs), F.struct((-F.col("parent.paras")).alias("n"), "pre", F.struct(F.col("parent.pre").alias("pre"), F.col("parent.post").alias("post")).alias("e"))))
    cut = F.collect_list(F.when(reduce(lambda a, b: a | b, [selected(s) for s in excluded], F.lit(False)), F.struct("pre", "stop")))
    chosen = found.groupBy(key).agg(*firsts, most.alias("_most"), cut.alias("_cut"))
    root = F.coalesce(*(F.when(F.col(f"_r{i}.chars") > least, F.struct(F.col(f"_r{i}.pre").alias("pre"), F.col(f"_r{i}.post").alias("post"))) for i in range(len(roots))), F.col("_most.e"))
    chosen = chosen.select(key, root.alias("_root"), "_cut").filter("_root is not null")
    inside = F.filter(F.array_sort("_cut"), lambda e: (e["pre"] > F.col("_root.pre")) & (e["pre"] < F.col("_root.post")))
    # pieces between excluded elements: an excluded one inside another is passed over
    start = F.struct((F.col("_root.pre") + 1).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))
    piece = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(acc: Column, e: Column) -> Column:
        return F.when(e["pre"] < acc["at"], acc).otherwise(F.struct(F.least(e["stop"], F.col("_root.post")).alias("at"), F.array_append(acc["out"], piece(acc["at"], e["pre"])).alias("out")))

    pieces = F.aggregate(inside, start, step, lambda acc: F.array_append(acc["out"], piece(acc["at"], F.col("_root.post"))))
    chosen = chosen.select(key, pieces.alias("_pieces"))
    kept = F.flatten(F.transform("_pieces", lambda s: F.slice(tokens(F.col(html)), s["lo"] + 1, F.greatest(F.lit(0), s["hi"] - s["lo"]))))
    plain = F.filter(kept, lambda x: ~F.rlike(x, F.lit("(?i)^<(?:!--|(?:script|style)\\b)")))
    return pages.join(chosen, key, "left").withColumn("content", F.array_join(plain, "")).drop("_pieces")
