"""Landed sources and sinks: feeds, channels, JSON documents, JSON-LD, partitioned writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import upsert as U
from tesserae.plans.registry import query
from tesserae.plans.streams import place
from tesserae.sources import feeds
from tesserae.sources.tables import Tables


def feed_texts(t: Tables):
    """One feed a tenant, written from its items."""
    item = F.format_string(
        "<item><title>%s</title>%s<image href=\"%s.png\"/><guid>%s</guid><duration>%d:%02d</duration><season>%d</season><explicit>no</explicit><enclosure url=\"%s\" length=\"%d\"/><description>&lt;p&gt;By %s&lt;/p&gt;</description></item>",
        F.when(F.col("id") % 2 == 0, F.regexp_replace(F.regexp_replace("title", "[<&>]", " "), "^#[0-9]+ - ", "")).otherwise(F.regexp_replace("title", "[<&>]", " ")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("<episode>"), "id", F.lit("</episode>"))).otherwise(""), "url", "guid", F.floor(F.col("duration_seconds") / 60).cast("int"), (F.col("duration_seconds") % 60), (F.col("id") % 9).cast("int"), "url", F.col("duration_seconds") * 100, "guest",
    )
    part = F.floor(F.col("id") / 1000)
    items = t.episodes.withColumn("part", part).groupBy("tenant_id", "part").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("x"))
    return items.select("tenant_id", "part", F.concat(F.lit("<rss><channel><title>Feed</title><author>A. Uthor</author><owner><name>O. Wner</name><email>o@x.example</email></owner><image href='https://x.example/c.png'/><category text='Business'><category text='Careers'/><category text='Investing'/></category><category text='News'/><keywords>one, Two,two,</keywords><explicit>clean</explicit>"), "x", F.lit("</channel></rss>")).alias("xml"))


@query("SRC4", "SELECT tenant_id, guid, CASE WHEN id % 2 = 0 THEN regexp_replace(title, '^#[0-9]+ - ', '') ELSE title END AS title FROM episodes")
def src4(t: Tables):
    """A main and a second folder of landed feeds, one item cut off, and a folder that is missing: the good items of all."""
    where, texts = place(t), feed_texts(t)
    for name, part in (("main", F.col("tenant_id") != "5-LOW"), ("second", F.col("tenant_id") == "5-LOW")):
        texts.filter(part).select("tenant_id", "xml").write.partitionBy("tenant_id").text(f"{where}/{name}")
    t.spark.range(1).select(F.lit("1-URGENT").alias("tenant_id"), F.lit("<rss><item><title>cut off</title>").alias("xml")).write.mode("append").partitionBy("tenant_id").text(f"{where}/main")
    return feeds.read_feeds(t.spark, [f"{where}/main", f"{where}/second", f"{where}/missing"]).select("tenant_id", "guid", "title")


@query("TXT15", "SELECT tenant_id, id AS number, (id % 9)::INT AS season_number, duration_seconds::BIGINT AS seconds, url AS audio, url || '.png' AS image, duration_seconds::BIGINT * 100 AS size, trim('By ' || guest) AS text FROM episodes")
def txt15(t: Tables):
    r = feeds.item_records(feeds.parse_feeds(feed_texts(t), "xml"))
    return r.select("tenant_id", "number", "season_number", "seconds", "audio", F.col("image_url").alias("image"), "size", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query("TXT16", "SELECT tenant_id, (id // 1000) AS part, 'Feed' AS channel, 'A. Uthor' AS author, ['one', 'two'] AS keywords, false AS is_explicit, 'O. Wner' AS owner, 'o@x.example' AS email, 'https://x.example/c.png' AS image, 'Business > Careers, Investing; News' AS categories FROM episodes GROUP BY 1, 2")
def txt16(t: Tables):
    r = feeds.channel_records(feed_texts(t), "xml")
    lines = F.transform("categories", lambda c: F.concat_ws(" > ", c["name"], F.nullif(F.array_join(c["parts"], ", "), F.lit(""))))
    return r.withColumn("categories", F.array_join(lines, "; "))


@query("SRC6", "SELECT page_id, 'PodcastEpisode' AS type, url AS name, url FROM pages WHERE page_id % 3 <> 2")
def src6(t: Tables):
    """Pages with data written in as JSON-LD, alone, in a graph, or of another type; those of the wanted type are read back."""
    kind = F.when(F.col("page_id") % 3 == 2, "Article").otherwise("PodcastEpisode")
    node = F.struct(kind.alias("@type"), F.col("url").alias("name"), "url")
    other = F.struct(F.lit("Organization").alias("@type"), F.lit("x").alias("name"), F.lit("https://x.example").alias("url"))
    data = F.when(F.col("page_id") % 3 == 1, F.to_json(F.struct(F.array(other, node).alias("@graph")))).otherwise(F.to_json(node))
    block = F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))
    return feeds.json_ld(t.pages.select("page_id", F.concat(block, "html").alias("html")), "PodcastEpisode")


@query("SRC3", "SELECT id, title, pillar, list_sort([pillar, difficulty]) AS kinds FROM episodes")
def src3(t: Tables):
    """Documents of many lines, each an object of items by their id with nested arrays."""
    where = place(t)
    item = F.struct("title", F.struct("pillar", F.array("pillar", "difficulty").alias("kinds")).alias("class"))
    by_part = t.episodes.withColumn("part", F.floor(F.col("id") / 500)).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), item))).alias("m"))
    by_part.repartition(8, "part").sortWithinPartitions("part").select(F.to_json("m", {"pretty": "true"}).alias("value")).write.partitionBy().text(f"{where}/json")
    read = feeds.read_documents(t.spark, f"{where}/json", "map<string, struct<title:string, class:struct<pillar:string, kinds:array<string>>>>")
    return read.select(F.explode("items").alias("id", "i")).select(F.col("id").cast("long").alias("id"), "i.title", "i.class.pillar", F.array_sort("i.class.kinds").alias("kinds"))


@query("SNK2", "SELECT tenant_id, count(*) AS n FROM (SELECT tenant_id, id FROM episodes WHERE tenant_id <> '1-URGENT' UNION ALL SELECT tenant_id, id FROM episodes WHERE tenant_id = '1-URGENT' AND id % 2 = 0) GROUP BY 1")
def snk2(t: Tables):
    where = place(t)
    U.overwrite_partitions(t.episodes.select("id", "tenant_id"), where, ["tenant_id"])
    U.overwrite_partitions(t.episodes.filter("tenant_id = '1-URGENT' and id % 2 = 0").select("id", "tenant_id"), where, ["tenant_id"])
    return t.spark.read.schema("id long, tenant_id string").parquet(where).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("SNK3", "SELECT episode_id, tag FROM tags")
def snk3(t: Tables):
    where = place(t)
    t.tags.write.parquet(where)
    return t.spark.read.schema("episode_id long, tag string").parquet(where)


@query("SNK4", "SELECT vec_id AS id, label AS tenant FROM embeddings")
def snk4(t: Tables):
    where = place(t)
    t.vectors.select("id", "tenant").write.json(where)
    return t.spark.read.schema("id long, tenant int").json(where)


@query("SNK5", "SELECT id, guest FROM episodes WHERE guest = ''")
def snk5(t: Tables):
    """Rows that a clean-up removes are written away before the table is."""
    where = place(t)
    t.episodes.filter("guest = ''").select("id", "guest").write.parquet(f"{where}/_deleted")
    return t.spark.read.schema("id long, guest string").parquet(f"{where}/_deleted")
