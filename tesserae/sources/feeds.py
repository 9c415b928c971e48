"""Landed feeds, pages with JSON-LD, and JSON documents as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import html_to_text, parse_duration, title_number

ITEM = "title string, episode string, image struct<_href:string>, guid string, pubDate string, duration string, season string, explicit string, enclosure struct<_url:string,_length:string>, description string, encoded string"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of feed files, with the folder's partition columns; an item that is cut off gives none, a bad field is null."""
    return parse_feeds(spark.read.text(path, wholetext=True), "value")


def read_feeds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Items of several folders of feeds, those that could be read; a folder that is missing gives none."""
    found = []
    for path in paths:
        try:
            found.append(read_feed(spark, path))
        except Exception as e:  # one feed less is no reason to lose the others
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not found:
        raise ValueError(f"none of the feeds is there: {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).filter("guid is not null")


def parse_feeds(df: DataFrame, xml: str) -> DataFrame:
    """Items of feed texts in a column, one row each, with the other columns."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<item>.*?</item>"), F.lit(0))
    rest = [c for c in df.columns if c != xml]
    return df.select(*rest, F.explode(items).alias("_x")).select(*rest, F.from_xml("_x", ITEM).alias("i")).select(*rest, "i.*")


def item_records(items: DataFrame) -> DataFrame:
    """Typed records: number from its tag or the title, image, season, seconds, audio, size, first body that isn't empty."""
    body = F.coalesce(F.nullif(F.trim("encoded"), F.lit("")), "description")
    return items.select(
        "*", F.coalesce(F.try_to_number("episode", F.lit("999999999")).cast("long"), title_number(F.col("title"))).alias("number"), F.col("image._href").alias("image_url"), F.try_to_number("season", F.lit("999")).cast("int").alias("season_number"), parse_duration(F.col("duration")).alias("seconds"), F.col("enclosure._url").alias("audio"),
        F.col("enclosure._length").cast("long").alias("size"), F.lower("explicit").isin("yes", "true").alias("is_explicit"), html_to_text(body).alias("text"),
    )


CHANNEL = "channel struct<title:string,author:string,keywords:string,explicit:string,owner:struct<name:string,email:string>,image:struct<_href:string>,category:array<struct<_text:string,category:array<struct<_text:string>>>>>"


def channel_records(df: DataFrame, xml: str) -> DataFrame:
    """Channel fields of feed texts: title, author, owner, image, categories with their parts, distinct keywords, flag (``clean`` is not explicit)."""
    head = F.from_xml(F.regexp_replace(xml, r"(?s)<item>.*</item>", ""), CHANNEL)
    pick = lambda path: F.nullif(F.trim(F.col(f"_c.channel.{path}")), F.lit(""))
    words = F.array_distinct(F.filter(F.transform(F.split(pick("keywords"), ","), lambda w: F.lower(F.trim(w))), lambda w: w != ""))
    kinds = F.transform("_c.channel.category", lambda c: F.struct(c["_text"].alias("name"), F.coalesce(F.transform(c["category"], lambda s: s["_text"]), F.array().cast("array<string>")).alias("parts")))
    flag = F.lower(pick("explicit"))
    read = df.withColumn("_c", head)
    return read.select(*(c for c in df.columns if c != xml), pick("title").alias("channel"), pick("author").alias("author"), words.alias("keywords"), flag.isin("yes", "true").alias("is_explicit"), pick("owner.name").alias("owner"), pick("owner.email").alias("email"), pick("image._href").alias("image"), kinds.alias("categories"))


def json_ld(pages: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes of JSON-LD blocks, an object or a ``@graph`` of them; with ``kind``, those of this type."""
    node = "struct<`@type`:string,name:string,url:string>"
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    parsed = pages.select("page_id", F.explode(blocks).alias("b")).select("page_id", F.from_json("b", f"struct<`@type`:string,name:string,url:string,`@graph`:array<{node}>>").alias("j"))
    single = F.array(F.struct(F.col("j.`@type`").alias("@type"), F.col("j.name").alias("name"), F.col("j.url").alias("url")))
    return parsed.select("page_id", F.explode(F.coalesce("j.`@graph`", single)).alias("n")).select("page_id", F.col("n.`@type`").alias("type"), "n.name", "n.url").filter(F.lit(True) if kind is None else F.col("type") == kind)


def read_documents(spark: SparkSession, path: str, items: str) -> DataFrame:
    """Text files of JSON documents, each an object over many lines; ``items`` is the document as that type."""
    whole = spark.read.text(path, wholetext=True)
    # a file may hold several documents, each of which starts and ends at a line's first character
    docs = F.regexp_extract_all("value", F.lit(r"(?ms)^\{.*?^\}"), F.lit(0))
    return whole.select(F.explode(docs).alias("d")).select(F.from_json("d", items).alias("items"))
