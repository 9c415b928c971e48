"""Scans, filters, projections, joins, windows, sorts and set operations over the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import predicates as P
from tesserae.functions import text as X
from tesserae.operators import relational as R
from tesserae.plans.registry import query
from tesserae.sources.tables import PRIORITIES, Tables

FULL = "(episode_type IS NULL OR episode_type = 'full')"
GUEST_NAME = "coalesce(nullif(guest, ''), guest_from_title)"
GUEST = f"lower(trim({GUEST_NAME}))"
#: ``valid_person_name`` of ``{n}``.
NAME_SQL = (
    r"regexp_matches({n}, '^[A-ZÀ-Ý]') AND len(list_filter(regexp_split_to_array({n}, '[\s-]+'), lambda w: w <> '')) >= 2 AND length({n}) <= 50 AND NOT regexp_matches({n}, '^[\[#]|^[0-9]+$|[:/|«»’]|[''‘`]$|\s-\s.*\s-\s')"
    + rf" AND NOT regexp_matches({{n}}, '(?i)^({P.TITLE_WORDS})\b') AND NOT regexp_matches({{n}}, '(?i)\b({P.TITLE_VERBS})\b')"
)


@query("SRC1", "SELECT id, title, pillar FROM episodes WHERE tenant_id = '1-URGENT'")
def src1(t: Tables):
    return t.episodes.filter(F.col("tenant_id") == "1-URGENT").select("id", "title", "pillar")


@query("SRC2", """WITH k AS (SELECT DISTINCT tenant_id FROM guests WHERE company = 'none such'), f AS (SELECT DISTINCT tenant_id FROM guests WHERE company = 'building')
SELECT tenant_id, count(*) AS n FROM episodes WHERE tenant_id IN (SELECT tenant_id FROM k UNION SELECT tenant_id FROM f WHERE NOT EXISTS (SELECT 1 FROM k)) GROUP BY 1""")
def src2(t: Tables):
    """Tenants of a first table, of a second where the first is empty."""
    first, second = (t.guests.filter(F.col("company") == c).select("tenant_id").distinct() for c in ("none such", "building"))
    return t.episodes.join(R.first_filled(first, second), "tenant_id", "left_semi").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("SRC5", "SELECT page_id, url, length(html) AS size FROM pages WHERE html IS NOT NULL")
def src5(t: Tables):
    return t.pages.filter(F.col("html").isNotNull()).select("page_id", "url", F.length("html").cast("long").alias("size"))


@query("SRC7", """SELECT doc_id, source, len(list_intersect(list_distinct(string_split(substr(text, 1, 2000), ' ')), ['the', 'of', 'de', 'la', 'und']))::INT AS overlap FROM documents ORDER BY overlap DESC, doc_id LIMIT 20""")
def src7(t: Tables):
    """Texts landed as Markdown with front matter, which is stripped before the cap and the ranking."""
    landed = t.documents.select("doc_id", "source", F.concat(F.lit("---\ntitle: the of\nlang: "), "lang", F.lit("\n---\n"), "text").alias("markdown"))
    words = F.array_distinct(F.split(F.substring(X.without_front_matter(F.col("markdown")), 1, 2000), " "))
    wanted = F.array(*(F.lit(x) for x in ("the", "of", "de", "la", "und")))
    return landed.select("doc_id", "source", F.size(F.array_intersect(words, wanted)).alias("overlap")).orderBy(F.desc("overlap"), "doc_id").limit(20)


@query("FLT1", "SELECT id, title FROM episodes WHERE pillar = 'P3' AND difficulty = 'F' AND (lower(title) LIKE '%building%' OR lower(guest) LIKE '%building%')")
def flt1(t: Tables):
    wanted = {"pillar": "P3", "difficulty": "F"}
    return t.episodes.filter(P.all_of([F.col(k) == v for k, v in wanted.items()]) & P.contains_any("building", "title", "guest")).select("id", "title")


@query("FLT2", f"SELECT id, episode_type FROM episodes WHERE {FULL}")
def flt2(t: Tables):
    return t.episodes.filter(P.full_episode()).select("id", "episode_type")


@query("FLT3", """SELECT 'episode' AS kind, id, title AS name FROM (SELECT id, title FROM episodes WHERE contains(lower(title), '000123') ORDER BY id LIMIT 20)
UNION ALL SELECT 'person', id, name FROM (SELECT id, name FROM guests WHERE contains(lower(name), '000123') ORDER BY id LIMIT 10)""")  # fmt: skip
def flt3(t: Tables):
    a = t.episodes.filter(P.contains_any("000123", "title")).orderBy("id").limit(20).select(F.lit("episode").alias("kind"), "id", F.col("title").alias("name"))
    return a.union(t.guests.filter(P.contains_any("000123", "name")).orderBy("id").limit(10).select(F.lit("person"), "id", "name"))


@query("FLT4", "SELECT episode_id FROM enrichment WHERE contains(lower(array_to_string(tags, ',')), 'brand#1,')")
def flt4(t: Tables):
    return t.enrichment.filter(F.contains(F.lower(F.array_join("tags", ",")), F.lit("brand#1,"))).select("episode_id")


@query("FLT5", "SELECT id, guest FROM episodes WHERE NOT contains(guest, '0007') AND NOT contains(guest, '0011')")
def flt5(t: Tables):
    return t.episodes.filter(P.contains_none("guest", ["0007", "0011"])).select("id", "guest")


@query("FLT6", "SELECT DISTINCT label FROM links WHERE regexp_matches(label, '[a-zA-Z]') AND NOT regexp_matches(label, '(?i)^(http|www|small)') AND NOT regexp_matches(label, '(?i)(ring|bolt)') AND length(trim(label)) BETWEEN 2 AND 40")
def flt6(t: Tables):
    label = F.col("label")
    return t.links.filter(label.rlike("[a-zA-Z]") & ~label.rlike("(?i)^(http|www|small)") & ~label.rlike("(?i)(ring|bolt)") & F.length(F.trim(label)).between(2, 40)).select("label").distinct()


@query("FLT7", "SELECT id, url FROM links WHERE url NOT LIKE '%brand1.%' AND NOT regexp_matches(url, '/p/[0-9]$') AND link_type NOT IN ('tool')")
def flt7(t: Tables):
    return t.links.filter(~F.col("url").like("%brand1.%") & ~F.col("url").rlike(r"/p/[0-9]\z") & ~F.col("link_type").isin("tool")).select("id", "url")


@query("FLT8", "SELECT n.episode_id, e.date_created FROM enrichment n JOIN episodes e ON e.id = n.episode_id WHERE list_has_any(tags, ['Brand#3', 'Brand#9']) AND pillar = 'P3' ORDER BY e.date_created, n.episode_id LIMIT 50")
def flt8(t: Tables):
    """Optional parameters: values for tags and pillar, none for difficulty, which therefore passes all."""
    rows = t.enrichment.join(t.episodes.select(F.col("id").alias("episode_id"), "pillar", "difficulty", "date_created"), "episode_id")
    wanted = P.overlaps_or_all("tags", ["Brand#3", "Brand#9"]) & P.equals_or_all("pillar", "P3") & P.equals_or_all("difficulty", None)
    return rows.filter(wanted).select("episode_id", "date_created").orderBy("date_created", "episode_id").limit(50)


@query("FLT9", "SELECT id FROM episodes WHERE episode_type IS DISTINCT FROM editorial_type")
def flt9(t: Tables):
    return t.episodes.filter(~F.col("episode_type").eqNullSafe(F.col("editorial_type"))).select("id")


@query("FLT10", rf"""WITH c AS (SELECT doc_id AS id, 'text' AS kind, trim(regexp_extract(text, '^[^.\n]*')) AS n FROM documents UNION ALL SELECT id, 'guest', guest FROM episodes UNION ALL SELECT id, 'title', trim(replace(title, '#', '')) FROM episodes
 UNION ALL SELECT page_id, 'page', trim(regexp_extract(html, '<h1>([^<]*)', 1)) FROM pages)
SELECT id, kind, n FROM c WHERE {NAME_SQL.format(n='n')}""")  # fmt: skip
def flt10(t: Tables):
    """Names among first sentences, guests, titles and headings."""
    found = (
        t.documents.select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.trim(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("n"))
        .union(t.episodes.select("id", F.lit("guest"), "guest")).union(t.episodes.select("id", F.lit("title"), F.trim(F.regexp_replace("title", "#", ""))))
        .union(t.pages.select("page_id", F.lit("page"), F.trim(F.regexp_extract("html", "<h1>([^<]*)", 1))))
    )
    return found.filter(P.valid_person_name(F.col("n")))


@query("FLT11", "SELECT tenant_id, count(*) AS n FROM episodes WHERE tenant_id IN ('1-URGENT', '5-LOW') GROUP BY 1")
def flt11(t: Tables):
    rows = [("a@example.org", "1-URGENT"), ("a@example.org", "5-LOW"), ("root@example.org", "*")]
    access = t.spark.createDataFrame(rows, "email string, access_tenant string")
    return R.scoped(t.episodes, access, "a@example.org").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("FLT12", "SELECT id FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = e.id)")
def flt12(t: Tables):
    return t.episodes.select("id").join(t.vectors.select("id"), "id", "left_anti")


@query("FLT13", "SELECT id, name FROM guests WHERE trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') = 'customer-000000123'")
def flt13(t: Tables):
    return t.guests.filter(P.slug(F.col("name")) == "customer-000000123").select("id", "name")


@query("FLT14", "SELECT id, tenant_id FROM episodes WHERE (tenant_id, episode_number % 1000) IN (('1-URGENT', 7), ('2-HIGH', 8), ('5-LOW', 9))")
def flt14(t: Tables):
    wanted = t.spark.createDataFrame([("1-URGENT", 7), ("2-HIGH", 8), ("5-LOW", 9)], "tenant_id string, k long")
    return t.episodes.withColumn("k", F.col("episode_number") % 1000).join(F.broadcast(wanted), ["tenant_id", "k"], "left_semi").select("id", "tenant_id")


@query("PRJ1", "SELECT id, coalesce(nullif(guest, ''), guest_from_title) AS guest, coalesce(difficulty, 'X') AS difficulty FROM episodes")
def prj1(t: Tables):
    return t.episodes.select("id", F.coalesce(F.nullif(F.col("guest"), F.lit("")), "guest_from_title").alias("guest"), F.coalesce("difficulty", F.lit("X")).alias("difficulty"))


@query("PRJ2", "SELECT e.id, round(duration_seconds / 60.0::DOUBLE)::BIGINT AS minutes, duration_seconds > 2000 AS is_long, coalesce(n, 0)::BIGINT AS link_count FROM episodes e LEFT JOIN (SELECT episode_id, count(*) AS n FROM links GROUP BY 1) l ON l.episode_id = e.id")
def prj2(t: Tables):
    n = t.links.groupBy(F.col("episode_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return t.episodes.join(n, "id", "left").select("id", F.round(F.col("duration_seconds") / 60.0).cast("long").alias("minutes"), (F.col("duration_seconds") > 2000).alias("is_long"), F.coalesce("n", F.lit(0)).alias("link_count"))


@query("PRJ3", """SELECT doc_id, CASE WHEN length(text) >= 500 THEN 'article' WHEN length(text) >= 200 THEN 'chapters' WHEN length(text) >= 100 THEN 'description' ELSE 'fallback' END AS kind,
 CASE WHEN length(text) >= 500 THEN 0.8::DOUBLE WHEN length(text) >= 200 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS quality FROM documents""")  # fmt: skip
def prj3(t: Tables):
    n = F.length("text")
    return t.documents.select("doc_id", F.when(n >= 500, "article").when(n >= 200, "chapters").when(n >= 100, "description").otherwise("fallback").alias("kind"), F.when(n >= 500, 0.8).when(n >= 200, 0.5).otherwise(0.1).alias("quality"))


@query("PRJ4", r"SELECT id, substr(concat_ws(' | ', nullif(substr(regexp_replace(title, '\s+', ' ', 'g'), 1, 500), ''), nullif(guest, ''), pillar, difficulty), 1, 5000) AS body FROM episodes")
def prj4(t: Tables):
    title = F.nullif(F.substring(F.regexp_replace("title", r"\s+", " "), 1, 500), F.lit(""))
    return t.episodes.select("id", F.substring(F.concat_ws(" | ", title, F.nullif(F.col("guest"), F.lit("")), "pillar", "difficulty"), 1, 5000).alias("body"))


@query("PRJ5", "SELECT e.id, lower(concat_ws(' ', title, guest, pillar, array_to_string(tags, ' '))) AS search_text FROM episodes e LEFT JOIN enrichment x ON x.episode_id = e.id")
def prj5(t: Tables):
    e = t.episodes.join(t.enrichment.withColumnRenamed("episode_id", "id"), "id", "left")
    return e.select("id", F.lower(F.concat_ws(" ", "title", "guest", "pillar", F.array_join("tags", " "))).alias("search_text"))


@query("PRJ6", "SELECT episode_id, len(tags)::INT AS n, tags[1] AS first_tag FROM enrichment")
def prj6(t: Tables):
    return t.enrichment.select("episode_id", F.size("tags").alias("n"), F.get("tags", F.lit(0)).alias("first_tag"))


@query("PRJ7", """WITH l AS (SELECT episode_id, string_agg(link_type || ': ' || urls, '; ' ORDER BY link_type) AS links FROM (SELECT episode_id, link_type, string_agg(url, ' ' ORDER BY id, url) AS urls FROM links GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT l.episode_id, string_agg(coalesce(o.id || ' ' || o.title, '-'), '; ' ORDER BY l.id, coalesce(o.id || ' ' || o.title, '-')) AS refs FROM links l LEFT JOIN episodes o ON o.url = l.url WHERE l.link_type = 'episode_ref' GROUP BY 1),
p AS (SELECT b.episode_id, min(g.name) AS name, min(g.linkedin_url) AS profile FROM guest_episodes b JOIN guests g ON g.id = b.guest_id GROUP BY 1)
SELECT e.id, e.title, e.duration_seconds, p.name, p.profile, coalesce(l.links, '') AS links, coalesce(r.refs, '') AS refs, coalesce(array_to_string(x.tags, ', '), '') AS tags, lag(e.episode_number) OVER w AS prev, lead(e.episode_number) OVER w AS next
 FROM episodes e LEFT JOIN p ON p.episode_id = e.id LEFT JOIN l ON l.episode_id = e.id LEFT JOIN r ON r.episode_id = e.id LEFT JOIN enrichment x ON x.episode_id = e.id WINDOW w AS (PARTITION BY e.tenant_id ORDER BY e.episode_number)""")  # fmt: skip
def prj7(t: Tables):
    """An item with its person, links by type, references resolved to items (misses kept as a dash), tags, and the items before and after."""
    text = lambda c: F.coalesce(c, F.lit(""))
    sorted_ = lambda order, what: F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(what).alias("x")))), lambda v: v["x"])
    by_kind = t.links.groupBy("episode_id", "link_type").agg(F.concat(F.col("link_type"), F.lit(": "), F.array_join(sorted_("id", "url"), " ")).alias("line"))
    links = by_kind.groupBy(F.col("episode_id").alias("id")).agg(F.array_join(sorted_("link_type", "line"), "; ").alias("links"))
    items = t.episodes.select("url", F.concat("id", F.lit(" "), "title").alias("line"))
    refs = t.links.filter("link_type = 'episode_ref'").join(items, "url", "left").withColumn("line", F.coalesce("line", F.lit("-")))
    refs = refs.groupBy(F.col("episode_id").alias("ref_of")).agg(F.array_join(sorted_("id", "line"), "; ").alias("refs")).withColumnRenamed("ref_of", "id")
    people = t.guest_episodes.join(t.guests.select(F.col("id").alias("guest_id"), "name", "linkedin_url"), "guest_id").groupBy(F.col("episode_id").alias("id")).agg(F.min("name").alias("name"), F.min("linkedin_url").alias("profile"))
    e = R.with_prev_next(t.episodes, ["tenant_id"], "episode_number").join(people, "id", "left").join(links, "id", "left").join(refs, "id", "left").join(t.enrichment.withColumnRenamed("episode_id", "id"), "id", "left")
    return e.select("id", "title", "duration_seconds", "name", "profile", text("links").alias("links"), text("refs").alias("refs"), text(F.array_join("tags", ", ")).alias("tags"), "prev", "next")


@query("JON1", "SELECT b.episode_id, min(g.id) AS guest_id FROM guest_episodes b JOIN guests g ON g.id = b.guest_id GROUP BY 1")
def jon1(t: Tables):
    return t.guest_episodes.join(t.guests.select(F.col("id").alias("guest_id")), "guest_id").groupBy("episode_id").agg(F.min("guest_id").alias("guest_id"))


@query("JON2", "SELECT e.id, g.company, g.linkedin_url FROM episodes e LEFT JOIN guests g ON g.tenant_id = e.tenant_id AND g.name = e.guest")
def jon2(t: Tables):
    g = t.guests.select("tenant_id", F.col("name").alias("guest"), "company", "linkedin_url")
    return t.episodes.join(g, ["tenant_id", "guest"], "left").select("id", "company", "linkedin_url")


@query("JON3", f"SELECT e.id, g.bio FROM (SELECT *, {GUEST} AS k FROM episodes) e LEFT JOIN guests g ON g.tenant_id = e.tenant_id AND lower(trim(g.name)) = e.k")
def jon3(t: Tables):
    g = t.guests.select("tenant_id", F.lower(F.trim("name")).alias("k"), "bio")
    return t.episodes.withColumn("k", P.guest_key()).join(g, ["tenant_id", "k"], "left").select("id", "bio")


@query("JON4", "SELECT e.id, count(*) AS n FROM links l JOIN episodes e ON e.url = l.url GROUP BY 1")
def jon4(t: Tables):
    return t.links.join(t.episodes.select("id", "url").withColumnRenamed("id", "target"), "url").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("JON5", "SELECT l.episode_id AS source, e.id AS target FROM links l JOIN episodes e ON e.url = l.url JOIN episodes s ON s.id = l.episode_id WHERE s.id <> e.id")
def jon5(t: Tables):
    target = t.episodes.select(F.col("id").alias("target"), "url")
    edges = t.links.select(F.col("episode_id").alias("source"), "url").join(target, "url").filter("source <> target")
    return edges.join(t.episodes.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target")


@query("JON7", "SELECT episode_id, unnest(tags) AS tag FROM enrichment")
def jon7(t: Tables):
    return t.enrichment.select("episode_id", F.explode("tags").alias("tag"))


@query("JON8", "SELECT a.episode_id, a.tag AS t1, b.tag AS t2 FROM tags a JOIN tags b ON a.episode_id = b.episode_id AND a.tag < b.tag")
def jon8(t: Tables):
    one = t.enrichment.select("episode_id", F.explode("tags").alias("t1"), "tags")
    return one.select("episode_id", "t1", F.explode(F.filter("tags", lambda x: x > F.col("t1"))).alias("t2"))


@query("JON9", "SELECT tenant_id, count(DISTINCT guest) FILTER (guest IN (SELECT name FROM guests WHERE linkedin_url IS NOT NULL)) AS with_profile FROM episodes GROUP BY 1")
def jon9(t: Tables):
    known = t.guests.filter("linkedin_url is not null").select(F.col("name").alias("guest"), F.lit(True).alias("hit")).distinct()
    return t.episodes.join(known, "guest", "left").groupBy("tenant_id").agg(F.count_distinct(F.when(F.col("hit"), F.col("guest"))).alias("with_profile"))


@query("JON10", "SELECT id FROM episodes WHERE id NOT IN (SELECT episode_id FROM links WHERE link_type = 'tool')")
def jon10(t: Tables):
    return t.episodes.select("id").join(t.links.filter("link_type = 'tool'").select(F.col("episode_id").alias("id")).distinct(), "id", "left_anti")


@query("JON11", """WITH src AS (SELECT doc_id AS k, 'g' || doc_id AS guid, 'https://cat.example.com/e/' || (doc_id + 7) AS url FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'none' || doc_id, 'https://cat.example.com/e/' || doc_id FROM documents WHERE doc_id % 2 = 1)
SELECT k, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'guid' ELSE 'url' END AS rule FROM src LEFT JOIN episodes a ON a.guid = src.guid LEFT JOIN episodes b ON b.url = src.url WHERE a.id IS NOT NULL OR b.id IS NOT NULL""")  # fmt: skip
def jon11(t: Tables):
    d = F.col("doc_id")
    src = t.documents.select(d.alias("k"), F.concat(F.when(d % 2 == 0, "g").otherwise("none"), d).alias("guid"), F.concat(F.lit("https://cat.example.com/e/"), F.when(d % 2 == 0, d + 7).otherwise(d)).alias("url"))
    first = src.join(t.episodes.select("id", "guid"), "guid").select("k", "id", F.lit("guid").alias("rule"))
    rest = src.join(first.select("k"), "k", "left_anti").join(t.episodes.select("id", "url"), "url")
    return first.union(rest.select("k", "id", F.lit("url")))


@query("JON14", """SELECT l.id, e.tenant_id AS from_tenant, h.tenant_id AS to_tenant FROM links l JOIN episodes e ON e.id = l.episode_id
JOIN (VALUES ('urgent.example.net', '1-URGENT'), ('high.example.net', '2-HIGH'), ('medium.example.net', '3-MEDIUM'), ('notspecified.example.net', '4-NOT SPECIFIED'), ('low.example.net', '5-LOW')) h(host, tenant_id)
 ON h.host = regexp_replace(l.url, '^https?://(www[.])?([^/]+).*', '\\2') WHERE h.tenant_id <> e.tenant_id AND regexp_extract(l.url, '^https?://[^/]+(/.*)$', 1) NOT IN ('', '/')""".replace("\\\\2", "\\2"))  # fmt: skip
def jon14(t: Tables):
    return host_refs(t).select("id", "from_tenant", "to_tenant")


def host_refs(t: Tables):
    """Links of one tenant's items to another tenant's site: equality of parsed hosts with a broadcast table of sites."""
    slugs = ("urgent", "high", "medium", "notspecified", "low")
    sites = t.spark.createDataFrame([(f"{s}.example.net", p) for s, p in zip(slugs, PRIORITIES, strict=True)], "host string, to_tenant string")
    found = t.links.withColumn("host", P.host_of(F.col("url"))).join(F.broadcast(sites), "host")
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)
    return found.filter(~path.isin("", "/")).join(t.episodes.select(F.col("id").alias("episode_id"), F.col("tenant_id").alias("from_tenant")), "episode_id").filter("from_tenant <> to_tenant")


@query("JON15", """SELECT c.source_id, c.idx, count(*) AS n, string_agg(s.idx::VARCHAR, ',' ORDER BY s.idx) AS parts FROM segments c JOIN segments s ON s.source_id = c.source_id AND s.end_s >= c.start_s - 10 AND s.start_s <= c.end_s + 10 GROUP BY 1, 2""")
def jon15(t: Tables):
    s = t.segments
    around = s.select("source_id", "idx", (F.col("start_s") - 10).alias("start"), (F.col("end_s") + 10).alias("stop"))
    met = R.overlapping(around, s.select("source_id", F.col("idx").alias("part"), F.col("start_s").alias("start"), F.col("end_s").alias("stop")), ["source_id"], 300.0)
    parts = F.array_join(F.array_sort(F.collect_list("part")).cast("array<string>"), ",")
    return met.groupBy("source_id", "idx").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts"))


@query("JON16", f"SELECT id, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM episodes WHERE {FULL} WINDOW w AS (PARTITION BY tenant_id ORDER BY id)")
def jon16(t: Tables):
    return R.with_prev_next(t.episodes.filter(P.full_episode()), ["tenant_id"], "id").select("id", "prev", "next")


@query("JON17", "SELECT s.conv_id, s.turn, e.id AS step_id, e.title FROM (SELECT conv_id, turn, conv_id * 17 + turn * 31 AS ref FROM conversations) s LEFT JOIN episodes e ON e.id = s.ref")
def jon17(t: Tables):
    steps = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("conv_id") * 17 + F.col("turn") * 31).alias("ref")))).alias("steps"))
    rows = steps.select("conv_id", F.inline("steps"))
    return rows.join(t.episodes.select(F.col("id").alias("step_id"), "title"), F.col("ref") == F.col("step_id"), "left").select("conv_id", "turn", "step_id", "title")


@query("JON18", "SELECT g.name, count(*) AS n, string_agg(e.tenant_id || ':' || e.id, ',' ORDER BY e.tenant_id || ':' || e.id) AS refs FROM guests g JOIN guest_episodes b ON b.guest_id = g.id JOIN episodes e ON e.id = b.episode_id GROUP BY 1")
def jon18(t: Tables):
    rows = t.guest_episodes.join(t.guests.select(F.col("id").alias("guest_id"), "name"), "guest_id").join(t.episodes.select(F.col("id").alias("episode_id"), "tenant_id"), "episode_id")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat("tenant_id", F.lit(":"), "episode_id"))), ",").alias("refs"))


@query("JON19", f"SELECT {GUEST} AS k FROM episodes WHERE tenant_id = '1-URGENT' INTERSECT SELECT {GUEST} FROM episodes WHERE tenant_id = '2-HIGH'")
def jon19(t: Tables):
    keys = t.episodes.select("tenant_id", P.guest_key().alias("k"))
    return keys.filter("tenant_id = '1-URGENT'").select("k").intersect(keys.filter("tenant_id = '2-HIGH'").select("k"))


@query("JON20", "SELECT g.id, list_sort(list(b.episode_id)) AS numbers FROM guests g JOIN guest_episodes b ON b.guest_id = g.id WHERE g.id = (SELECT min(id) FROM guests WHERE contains(lower(name), '00012')) GROUP BY 1")
def jon20(t: Tables):
    one = t.guests.filter(P.contains_any("00012", "name")).agg(F.min("id").alias("guest_id"))
    return t.guest_episodes.join(F.broadcast(one), "guest_id").groupBy(F.col("guest_id").alias("id")).agg(F.array_sort(F.collect_list("episode_id")).alias("numbers"))


@query("WIN1", "SELECT tenant_id, id, rn FROM (SELECT tenant_id, id, (row_number() OVER (PARTITION BY tenant_id ORDER BY date_created DESC NULLS LAST, id DESC))::INT AS rn FROM episodes) WHERE rn <= 3")
def win1(t: Tables):
    order = [F.desc_nulls_last("date_created"), F.desc("id")]
    top = R.top_n_per_group(t.episodes, ["tenant_id"], order, 3)
    return top.select("tenant_id", "id", F.row_number().over(Window.partitionBy("tenant_id").orderBy(*order)).alias("rn"))


@query("WIN2", "SELECT episode_id, min(id) AS id FROM links WHERE link_type = 'company' GROUP BY 1")
def win2(t: Tables):
    return R.distinct_on(t.links.filter("link_type = 'company'"), ["episode_id"], [F.asc("id")]).select("episode_id", "id")


@query("WIN3", "SELECT guest, id FROM (SELECT guest, id, row_number() OVER (PARTITION BY guest ORDER BY date_created, id) AS rn FROM episodes) WHERE rn = 1")
def win3(t: Tables):
    return R.distinct_on(t.episodes, ["guest"], [F.asc("date_created"), F.asc("id")]).select("guest", "id")


@query("WIN4", "SELECT episode_id, id FROM (SELECT episode_id, id, row_number() OVER (PARTITION BY episode_id ORDER BY id) AS rn FROM links) WHERE rn <= 5")
def win4(t: Tables):
    return R.top_n_per_group(t.links, ["episode_id"], [F.asc("id")], 5).select("episode_id", "id")


@query("WIN5", "SELECT id, lag(episode_number) OVER w AS prev, lead(episode_number) OVER w AS next FROM episodes WINDOW w AS (PARTITION BY tenant_id ORDER BY episode_number)")
def win5(t: Tables):
    return R.with_prev_next(t.episodes, ["tenant_id"], "episode_number").select("id", "prev", "next")


@query("WIN6", "SELECT tenant_id, round(quantile_cont(gap, 0.5), 2) AS median_days FROM (SELECT tenant_id, (epoch(date_created) - epoch(lag(date_created) OVER (PARTITION BY tenant_id ORDER BY date_created))) / 86400.0::DOUBLE AS gap FROM episodes) GROUP BY 1")
def win6(t: Tables):
    return R.publish_cadence(t.episodes, ["tenant_id"], "date_created")


@query("WIN7", "SELECT tenant_id, unnest(range(episode_number + 1, nxt)) AS missing FROM (SELECT tenant_id, episode_number, lead(episode_number) OVER (PARTITION BY tenant_id ORDER BY episode_number) AS nxt FROM episodes) WHERE nxt - episode_number > 1")
def win7(t: Tables):
    return R.number_gaps(t.episodes, ["tenant_id"], "episode_number")


@query("WIN9", "SELECT source_id, idx, used FROM (SELECT source_id, idx, (sum(length(text) + 1) OVER (PARTITION BY source_id ORDER BY idx ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM segments) WHERE used <= 2000")
def win9(t: Tables):
    return R.char_budget_prefix(t.segments, "source_id", "idx", "text", 2000).select("source_id", "idx", "used")


@query("WIN11", "SELECT tag, episode_id, row_number() OVER w = 1 AS kept, first(tag) OVER w AS claimed_by FROM tags WINDOW w AS (PARTITION BY episode_id ORDER BY tag)")
def win11(t: Tables):
    return R.claim_once(t.tags, "episode_id", ["tag"]).select("tag", "episode_id", "kept", "claimed_by")


@query("WIN12", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM episodes) WHERE rn % greatest(1, n // 80) = 0 AND rn < 80 * greatest(1, n // 80)")
def win12(t: Tables):
    rows = t.episodes.select("id")
    return R.systematic_sample(rows, "id", 80, t.raw("orders").count())


@query("TOP1", "SELECT id, (SELECT count(*) FROM episodes) AS total, ceil((SELECT count(*) FROM episodes) / 25.0)::BIGINT AS pages FROM episodes ORDER BY id DESC LIMIT 25 OFFSET 50")
def top1(t: Tables):
    return R.page(t.episodes.select("id"), [F.desc("id")], 3, 25)


@query("TOP2", "SELECT id, other FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.date_created DESC, b.id DESC) AS rn FROM episodes a JOIN episodes b ON b.pillar = a.pillar AND b.tenant_id = a.tenant_id AND b.id <> a.id) WHERE rn <= 5")
def top2(t: Tables):
    """Newest five of the same pillar; the newest six of a pillar are enough for any item, so the join meets six rows a group."""
    newest = [F.desc("date_created"), F.desc("id")]
    best = R.top_n_per_group(t.episodes.select("tenant_id", "pillar", "date_created", "id"), ["tenant_id", "pillar"], newest, 6).withColumnRenamed("id", "other")
    mine = t.episodes.select("tenant_id", "pillar", "id")
    return R.top_n_per_group(mine.join(best, ["tenant_id", "pillar"]).filter("id <> other"), ["id"], [F.desc("date_created"), F.desc("other")], 5).select("id", "other")


@query("TOP4", "SELECT user_id, pillar, (CASE pillar WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END)::INT AS priority FROM (SELECT user_id, pillar, row_number() OVER (PARTITION BY user_id ORDER BY CASE pillar WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, pillar) AS rn FROM (SELECT DISTINCT user_id, pillar FROM answers WHERE NOT \"right\")) WHERE rn = 1")
def top4(t: Tables):
    rank = F.when(F.col("pillar") == "error", 0).when(F.col("pillar") == "click", 1).otherwise(2)
    unseen = t.answers.filter(~F.col("right")).select("user_id", "pillar").distinct().withColumn("priority", rank)
    return R.distinct_on(unseen, ["user_id"], [F.asc("priority"), F.asc("pillar")])


@query("TOP5", "SELECT id, pillar FROM episodes ORDER BY md5('7|' || id), id LIMIT 20")
def top5(t: Tables):
    return t.episodes.select("id", "pillar").orderBy(F.md5(F.concat(F.lit("7|"), "id").cast("binary")), "id").limit(20)


@query("TOP6", "SELECT id, tenant_id, date_created FROM episodes ORDER BY date_created DESC, id DESC LIMIT 500")
def top6(t: Tables):
    return t.episodes.select("id", "tenant_id", "date_created").orderBy(F.desc("date_created"), F.desc("id")).limit(500)


@query("TOP7", """WITH m AS (SELECT l.id, l.episode_id, l.label, e.date_created FROM links l JOIN episodes e ON e.id = l.episode_id WHERE contains(lower(l.label), 'widget') ORDER BY e.date_created DESC, l.id LIMIT 50)
SELECT episode_id, id, (SELECT count(*) FROM m) AS total_mentions FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id) AS rn FROM m) WHERE rn = 1""")  # fmt: skip
def top7(t: Tables):
    hits = t.links.filter(P.contains_any("widget", "label")).join(t.episodes.select(F.col("id").alias("episode_id"), "date_created"), "episode_id")
    newest = hits.orderBy(F.desc("date_created"), "id").limit(50)
    return R.distinct_on(newest, ["episode_id"], [F.asc("id")]).select("episode_id", "id").join(F.broadcast(newest.agg(F.count(F.lit(1)).alias("total_mentions"))), F.lit(True))


@query("TOP8", "SELECT guest, id FROM (SELECT guest, id, row_number() OVER (PARTITION BY guest ORDER BY date_created DESC, id DESC) AS rn FROM episodes WHERE guest <> '') WHERE rn <= 4")
def top8(t: Tables):
    return R.top_n_per_group(t.episodes.filter("guest <> ''"), ["guest"], [F.desc("date_created"), F.desc("id")], 4).select("guest", "id")


@query("TOP9", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def top9(t: Tables):
    return R.top_n_per_group(t.raw("events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 5).select("user_id", "event_id")


@query("SET1", "SELECT doc_id AS k, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def set1(t: Tables):
    return t.documents.select(F.col("doc_id").alias("k"), "lang").unionByName(t.raw("conversations").select(F.col("conv_id").alias("k"), "role"), allowMissingColumns=True)


@query("SET2", "SELECT id FROM episodes WHERE guest = '' UNION SELECT episode_id FROM tags WHERE tag = 'Brand#7'")
def set2(t: Tables):
    return t.episodes.filter("guest = ''").select("id").union(t.tags.filter("tag = 'Brand#7'").select("episode_id")).distinct()


@query("SET3", "SELECT tag FROM tags WHERE episode_id % 50 = 1 INTERSECT SELECT tag FROM tags WHERE episode_id % 50 = 2")
def set3(t: Tables):
    return t.tags.filter("episode_id % 50 = 1").select("tag").intersect(t.tags.filter("episode_id % 50 = 2").select("tag"))


@query("SET4", "SELECT doc_id AS id FROM documents EXCEPT SELECT id FROM episodes WHERE id % 3 <> 0")
def set4(t: Tables):
    return R.missing_from(t.documents.select(F.col("doc_id").alias("id")), t.episodes.filter("id % 3 <> 0"), ["id"])


@query("SET5", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name FROM (SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN lang END AS name FROM documents) a FULL JOIN (SELECT id AS k, title AS name FROM episodes) b ON a.k = b.k")
def set5(t: Tables):
    fresh = t.documents.select(F.col("doc_id").alias("k"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("name"))
    return R.merge_with_index(fresh, t.episodes.select(F.col("id").alias("k"), F.col("title").alias("name")), "k")
