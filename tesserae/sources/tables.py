"""Reference-shaped tables, built from the driver's Parquet tables.

``Tables`` gives each as a lazy DataFrame with only the columns it needs; ``CTES`` holds the same
shapes as SQL, and ``with_ctes`` puts those that a query names in front of it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = "cat.example.com"


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        """A driver table as it is."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def episodes(self) -> DataFrame:
        """Orders as published items, customers as their guests."""
        key = F.col("o_orderkey")
        kind = F.when(key % 7 == 0, None).when(key % 7 == 1, "bonus").otherwise("full")
        return self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("id"), F.col("o_orderpriority").alias("tenant_id"), key.alias("episode_number"),
            F.concat(F.lit("#"), key, F.lit(" - "), "c_name", F.when(key % 9 == 0, " (extrait)").otherwise(""), F.lit(" - about "), F.lower("c_mktsegment")).alias("title"),
            F.when(key % 11 == 0, "").otherwise(F.col("c_name")).alias("guest"), F.col("c_name").alias("guest_from_title"),
            F.concat(F.lit("P"), key % 10).alias("pillar"), F.when(key % 13 != 0, F.col("o_orderstatus")).alias("difficulty"),
            F.col("o_orderdate").alias("date_created"), F.floor(F.col("o_totalprice") / 100).cast("int").alias("duration_seconds"), kind.alias("episode_type"),
            F.when(key % 5 == 0, "extract").otherwise("full").alias("editorial_type"), F.concat(F.lit(f"https://{HOST}/e/"), key).alias("url"), F.concat(F.lit("g"), key).alias("guid"),
        )

    @cached_property
    def guests(self) -> DataFrame:
        """One person per tenant and customer."""
        named = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        key = F.col("c_custkey")
        return named.select(
            (key * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("id"), F.col("o_orderpriority").alias("tenant_id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("company"),
            F.when(key % 4 != 0, F.concat(F.lit("Bio "), F.expr("repeat('x ', cast(c_custkey % 40 as int))"))).alias("bio"), F.when(key % 3 == 0, F.concat(F.lit("https://www.profiles.example/in/"), F.lower(F.regexp_replace("c_name", "#", "-")))).alias("linkedin_url"),
            (key % 100).cast("int").alias("authority_score"),
        ).distinct()

    @cached_property
    def guest_episodes(self) -> DataFrame:
        """Bridge of persons and items."""
        return self.raw("orders").select((F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("guest_id"), F.col("o_orderkey").alias("episode_id"))

    @cached_property
    def links(self) -> DataFrame:
        """Outbound links of items, one per item and URL."""
        brand = F.lower(F.regexp_replace("p_brand", "#", ""))
        url = (
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 == 0), F.concat(F.lit(f"https://{HOST}/e/"), "l_partkey"))
            .when(F.col("l_returnflag") == "N", F.concat(F.lit("https://www."), F.element_at(F.array(*(F.lit(x) for x in SLUGS)), (F.col("l_suppkey") % 5 + 1).cast("int")), F.lit(".example.net/show/"), "l_partkey"))
            .otherwise(F.concat(F.lit("https://www."), brand, F.lit(".example.org/p/"), F.col("l_partkey") % 50))
        )
        kind = F.when(F.col("l_returnflag") == "N", "episode_ref").when(F.col("l_linestatus") == "O", "tool").otherwise("company")
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("episode_id"), url.alias("url"), F.col("p_name").alias("label"), kind.alias("link_type")
        ).groupBy("episode_id", "url").agg(F.min("id").alias("id"), F.min("label").alias("label"), F.min("link_type").alias("link_type"))

    @cached_property
    def lined(self) -> DataFrame:
        """Ids of items that have links and tags, one row a line."""
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("episode_id"))

    @cached_property
    def tags(self) -> DataFrame:
        """Distinct tags of items."""
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("episode_id"), F.col("p_brand").alias("tag")).distinct()

    @cached_property
    def enrichment(self) -> DataFrame:
        """Sorted tag arrays of items."""
        return self.tags.groupBy("episode_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))

    @cached_property
    def vectors(self) -> DataFrame:
        """Embeddings by tenant, in double precision."""
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), F.col("embedding").cast("array<double>").alias("v"))

    @cached_property
    def documents(self) -> DataFrame:
        """Texts with a tenant."""
        return self.raw("documents")

    @cached_property
    def pages(self) -> DataFrame:
        """Landed web pages."""
        return self.raw("pages")

    @cached_property
    def segments(self) -> DataFrame:
        """Conversations as transcripts: a turn is a segment."""
        return self.raw("conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("idx"), (F.col("turn") * 60).cast("double").alias("start_s"), (F.col("turn") * 60 + F.least(F.length("text"), F.lit(900)) / 15.0).alias("end_s"), "role", "text")

    @cached_property
    def answers(self) -> DataFrame:
        """Events as quiz answers: right above a value of 10."""
        return self.raw("events").select("event_id", "user_id", F.col("event_type").alias("pillar"), (F.col("value") > 10).alias("right"), "ts")


SLUGS = ["urgent", "high", "medium", "notspecified", "low"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

CTES = {
    "episodes": f"""SELECT o_orderkey AS id, o_orderpriority AS tenant_id, o_orderkey AS episode_number,
      '#' || o_orderkey || ' - ' || c_name || CASE WHEN o_orderkey % 9 = 0 THEN ' (extrait)' ELSE '' END || ' - about ' || lower(c_mktsegment) AS title,
      CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE c_name END AS guest, c_name AS guest_from_title, 'P' || (o_orderkey % 10) AS pillar,
      CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS difficulty, o_orderdate AS date_created, floor(o_totalprice / 100)::INT AS duration_seconds,
      CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'bonus' ELSE 'full' END AS episode_type, CASE WHEN o_orderkey % 5 = 0 THEN 'extract' ELSE 'full' END AS editorial_type,
      'https://{HOST}/e/' || o_orderkey AS url, 'g' || o_orderkey AS guid FROM orders JOIN customer ON o_custkey = c_custkey""",
    "guests": """SELECT DISTINCT c_custkey * 10 + substr(o_orderpriority, 1, 1)::BIGINT AS id, o_orderpriority AS tenant_id, c_name AS name, lower(c_mktsegment) AS company,
      CASE WHEN c_custkey % 4 <> 0 THEN 'Bio ' || repeat('x ', (c_custkey % 40)::INT) END AS bio,
      CASE WHEN c_custkey % 3 = 0 THEN 'https://www.profiles.example/in/' || lower(replace(c_name, '#', '-')) END AS linkedin_url, (c_custkey % 100)::INT AS authority_score
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "guest_episodes": "SELECT o_custkey * 10 + substr(o_orderpriority, 1, 1)::BIGINT AS guest_id, o_orderkey AS episode_id FROM orders",
    "links": f"""SELECT episode_id, url, min(id) AS id, min(label) AS label, min(link_type) AS link_type FROM (
      SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS id, l_orderkey AS episode_id, p_name AS label,
        CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'https://{HOST}/e/' || l_partkey
             WHEN l_returnflag = 'N' THEN 'https://www.' || (['urgent', 'high', 'medium', 'notspecified', 'low'])[l_suppkey % 5 + 1] || '.example.net/show/' || l_partkey
             ELSE 'https://www.' || lower(replace(p_brand, '#', '')) || '.example.org/p/' || (l_partkey % 50) END AS url,
        CASE WHEN l_returnflag = 'N' THEN 'episode_ref' WHEN l_linestatus = 'O' THEN 'tool' ELSE 'company' END AS link_type
      FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY episode_id, url""",
    "tags": "SELECT DISTINCT l_orderkey AS episode_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey",
    "enrichment": "SELECT episode_id, list_sort(list(tag)) AS tags FROM tags GROUP BY episode_id",
    "vectors": "SELECT vec_id AS id, label AS tenant, embedding::DOUBLE[] AS v FROM embeddings",
    "segments": "SELECT conv_id AS source_id, turn AS idx, (turn * 60)::DOUBLE AS start_s, turn * 60 + least(length(text), 900) / 15.0::DOUBLE AS end_s, role, text FROM conversations",
    "answers": 'SELECT event_id, user_id, event_type AS pillar, value > 10 AS "right", ts FROM events',
}


def with_ctes(sql: str) -> str:
    """``sql`` with the shapes that it names in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    return f"WITH {head},\n{body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
