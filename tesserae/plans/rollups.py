"""Aggregates over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import predicates as P
from tesserae.operators import measures as M
from tesserae.operators import relational as R
from tesserae.plans.basics import FULL, GUEST, host_refs
from tesserae.plans.registry import query
from tesserae.sources.tables import PRIORITIES, Tables

def _one():
    """Rows."""
    return F.count(F.lit(1))

REFS = """SELECT l.id, e.tenant_id AS from_tenant, h.tenant_id AS to_tenant FROM links l JOIN episodes e ON e.id = l.episode_id
JOIN (VALUES ('urgent.example.net', '1-URGENT'), ('high.example.net', '2-HIGH'), ('medium.example.net', '3-MEDIUM'), ('notspecified.example.net', '4-NOT SPECIFIED'), ('low.example.net', '5-LOW')) h(host, tenant_id)
 ON l.url LIKE 'https://www.' || h.host || '/%' WHERE h.tenant_id <> e.tenant_id"""


@query("AGG1", """SELECT 'episodes' AS kind, '' AS k, count(*) AS n FROM episodes UNION ALL SELECT 'guests', '', count(*) FROM guests UNION ALL SELECT 'links', '', count(*) FROM links UNION ALL SELECT 'pillar', pillar, count(*) FROM episodes GROUP BY pillar UNION ALL SELECT 'difficulty', coalesce(difficulty, '-'), count(*) FROM episodes GROUP BY difficulty
 UNION ALL SELECT * FROM (SELECT 'person', guest, count(*) AS n FROM episodes WHERE guest <> '' GROUP BY guest ORDER BY n DESC, guest LIMIT 5)""")
def agg1(t: Tables):
    e = t.episodes
    whole = lambda df, name: df.agg(_one().alias("n")).select(F.lit(name).alias("kind"), F.lit("").alias("k"), "n")
    top = M.frequency(e.filter("guest <> ''"), "guest").orderBy(F.desc("n"), "guest").limit(5)
    return (
        whole(e, "episodes").union(whole(t.guests, "guests")).union(whole(t.links, "links")).union(top.select(F.lit("person"), "guest", "n"))
        .union(M.frequency(e, "pillar").select(F.lit("pillar"), "pillar", "n")).union(M.frequency(e, "difficulty").select(F.lit("difficulty"), F.coalesce("difficulty", F.lit("-")), "n"))
    )


@query("AGG2", "SELECT tag, count(*) AS n FROM tags GROUP BY 1 ORDER BY n DESC, tag")
def agg2(t: Tables):
    return M.frequency(t.enrichment.select(F.explode("tags").alias("tag")), "tag").orderBy(F.desc("n"), "tag")


@query("AGG3", "SELECT regexp_replace(url, '^https?://(www[.])?([^/]+).*', '\\2') AS domain, count(*) AS n, count(DISTINCT episode_id) AS episodes FROM links GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def agg3(t: Tables):
    return t.links.groupBy(P.host_of(F.col("url")).alias("domain")).agg(_one().alias("n"), F.count_distinct("episode_id").alias("episodes")).orderBy(F.desc("n"), "domain").limit(20)


@query("AGG4", "SELECT pillar, date_trunc('month', date_created)::TIMESTAMP AS month, count(*) AS n FROM episodes GROUP BY 1, 2 ORDER BY month DESC, n DESC, pillar LIMIT 100")
def agg4(t: Tables):
    return M.frequency(t.episodes.select("pillar", F.date_trunc("month", "date_created").alias("month")), "pillar", "month").orderBy(F.desc("month"), F.desc("n"), "pillar").limit(100)


@query("AGG5", "SELECT guest, count(*) AS n, list_sort(list(DISTINCT pillar)) AS pillars FROM episodes WHERE guest <> '' GROUP BY 1 HAVING count(*) > 1")
def agg5(t: Tables):
    return t.episodes.filter("guest <> ''").groupBy("guest").agg(_one().alias("n"), F.array_sort(F.collect_set("pillar")).alias("pillars")).filter("n > 1")


@query("AGG6", "SELECT tenant_id, round(count(DISTINCT guest) / nullif(count(*), 0)::DOUBLE, 3) AS diversity FROM episodes GROUP BY 1")
def agg6(t: Tables):
    return t.episodes.groupBy("tenant_id").agg(F.round(F.count_distinct("guest") / F.nullif(_one(), F.lit(0)), 3).alias("diversity"))


@query("AGG7", "SELECT difficulty, year(date_created)::INT AS y, count(*) AS n FROM episodes GROUP BY 1, 2")
def agg7(t: Tables):
    return M.frequency(t.episodes.select("difficulty", F.year("date_created").alias("y")), "difficulty", "y")


@query("AGG8", "SELECT a.tag AS t1, b.tag AS t2, count(*) AS n FROM tags a JOIN tags b ON a.episode_id = b.episode_id AND a.tag < b.tag GROUP BY 1, 2 ORDER BY n DESC, t1, t2 LIMIT 20")
def agg8(t: Tables):
    pairs = t.enrichment.select(F.explode("tags").alias("t1"), "tags").select("t1", F.explode(F.filter("tags", lambda x: x > F.col("t1"))).alias("t2"))
    return M.frequency(pairs, "t1", "t2").orderBy(F.desc("n"), "t1", "t2").limit(20)


@query("AGG9", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS least, max(value) AS most FROM events")
def agg9(t: Tables):
    values = t.raw("events").select("value")
    rest = values.agg(_one().alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return rest.join(R.medians(values, [], "value", "median"), F.lit(True), "left").select("n", "mean", F.round("median", 6).alias("median"), "least", "most")


@query("AGG10", "SELECT (SELECT count(*) FROM episodes) AS episodes, (SELECT count(DISTINCT episode_id) FROM tags) AS tagged, (SELECT count(DISTINCT episode_id) FROM links) AS linked")
def agg10(t: Tables):
    return t.raw("orders").agg(_one().alias("episodes")).join(t.tags.agg(F.count_distinct("episode_id").alias("tagged")), F.lit(True)).join(t.links.agg(F.count_distinct("episode_id").alias("linked")), F.lit(True))


@query("AGG11", """SELECT tenant_id, round(g, 6) AS gini, round((1 - g) * 100)::BIGINT AS diversity, CASE WHEN round((1 - g) * 100) > 70 THEN 'high' WHEN round((1 - g) * 100) > 50 THEN 'medium' ELSE 'low' END AS band FROM (
 SELECT tenant_id, (2 * sum(i * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n))::DOUBLE AS g FROM (SELECT tenant_id, n, row_number() OVER (PARTITION BY tenant_id ORDER BY n) AS i FROM (SELECT tenant_id, pillar, count(*) AS n FROM episodes GROUP BY 1, 2)) GROUP BY 1)""")  # fmt: skip
def agg11(t: Tables):
    g = M.gini(M.frequency(t.episodes, "tenant_id", "pillar"), ["tenant_id"], "n")
    share = F.round((1 - F.col("gini")) * 100)
    return g.select("tenant_id", F.round("gini", 6).alias("gini"), share.cast("long").alias("diversity"), F.when(share > 70, "high").when(share > 50, "medium").otherwise("low").alias("band"))


@query("AGG12", f"SELECT count(*) AS n, sum(duration_seconds)::BIGINT AS seconds, round(sum(duration_seconds) / 3600.0::DOUBLE)::BIGINT AS hours, count(*) FILTER (guest <> '') AS with_guest, round(avg(duration_seconds))::BIGINT AS mean, count(*) FILTER ({FULL}) AS full_items FROM episodes")
def agg12(t: Tables):
    s = F.col("duration_seconds")
    return t.episodes.agg(_one().alias("n"), F.sum(s).alias("seconds"), F.round(F.sum(s) / 3600.0).cast("long").alias("hours"), F.count_if(F.col("guest") != "").alias("with_guest"), F.round(F.avg(s)).cast("long").alias("mean"), F.count_if(P.full_episode()).alias("full_items"))


@query("AGG13", "SELECT pillar, count(*) AS n, sum(duration_seconds)::BIGINT AS seconds, round(avg(duration_seconds), 6) AS mean FROM episodes GROUP BY 1 ORDER BY seconds DESC")
def agg13(t: Tables):
    return t.episodes.groupBy("pillar").agg(_one().alias("n"), F.sum("duration_seconds").alias("seconds"), F.round(F.avg("duration_seconds"), 6).alias("mean")).orderBy(F.desc("seconds"))


@query("AGG14", "SELECT tenant_id, arg_max(id, duration_seconds * 100000000 - id) AS longest, arg_min(id, duration_seconds * 100000000 + id) AS shortest FROM (SELECT tenant_id, id, duration_seconds::BIGINT AS duration_seconds FROM episodes WHERE duration_seconds > 60) GROUP BY 1")
def agg14(t: Tables):
    s, i = F.col("duration_seconds"), F.col("id")
    return t.episodes.filter(s > 60).groupBy("tenant_id").agg(F.max_by("id", F.struct(s, -i)).alias("longest"), F.min_by("id", F.struct(s, i)).alias("shortest"))


@query("AGG15", "SELECT label, count(DISTINCT episode_id) AS n FROM links WHERE link_type = 'tool' AND regexp_matches(label, '[a-zA-Z]') AND length(label) BETWEEN 2 AND 40 GROUP BY 1 ORDER BY n DESC, label LIMIT 15")
def agg15(t: Tables):
    good = (F.col("link_type") == "tool") & F.col("label").rlike("[a-zA-Z]") & F.length("label").between(2, 40)
    return t.links.filter(good).groupBy("label").agg(F.count_distinct("episode_id").alias("n")).orderBy(F.desc("n"), "label").limit(15)


@query("AGG16", "SELECT count(*) AS people, count(*) FILTER (n > 1) AS recurring, (SELECT count(DISTINCT name) FROM guests WHERE linkedin_url IS NOT NULL) AS with_profile FROM (SELECT guest, count(*) AS n FROM episodes WHERE guest <> '' GROUP BY 1)")
def agg16(t: Tables):
    people = M.frequency(t.episodes.filter("guest <> ''"), "guest").agg(_one().alias("people"), F.count_if(F.col("n") > 1).alias("recurring"))
    return people.join(t.guests.filter("linkedin_url is not null").agg(F.count_distinct("name").alias("with_profile")), F.lit(True))


@query("AGG17", "SELECT guest, count(DISTINCT pillar) AS pillars, count(*) AS n, list_sort(list(DISTINCT pillar)) AS names FROM episodes WHERE guest <> '' GROUP BY 1 HAVING count(DISTINCT pillar) >= 3 ORDER BY pillars DESC, n DESC, guest LIMIT 10")
def agg17(t: Tables):
    found = t.episodes.filter("guest <> ''").groupBy("guest").agg(F.count_distinct("pillar").alias("pillars"), _one().alias("n"), F.array_sort(F.collect_set("pillar")).alias("names"))
    return found.filter("pillars >= 3").orderBy(F.desc("pillars"), F.desc("n"), "guest").limit(10)


@query("AGG18", "SELECT count(*) FILTER (bio IS NOT NULL) AS with_bio, count(*) FILTER (linkedin_url IS NOT NULL) AS with_profile, round(avg(length(coalesce(bio, ''))))::BIGINT AS bio_length FROM guests")
def agg18(t: Tables):
    return t.guests.agg(F.count_if(F.col("bio").isNotNull()).alias("with_bio"), F.count_if(F.col("linkedin_url").isNotNull()).alias("with_profile"), F.round(F.avg(F.length(F.coalesce("bio", F.lit(""))))).cast("long").alias("bio_length"))


@query("AGG19", "SELECT guest, count(*) AS n FROM episodes WHERE guest <> '' GROUP BY 1 ORDER BY n DESC, guest LIMIT 15")
def agg19(t: Tables):
    return M.frequency(t.episodes.filter("guest <> ''"), "guest").orderBy(F.desc("n"), "guest").limit(15)


@query("AGG20", "SELECT tenant_id, count(*) AS n, round(sum(duration_seconds) / 3600.0::DOUBLE)::BIGINT AS hours, count(DISTINCT guest) FILTER (guest <> '') AS people FROM episodes GROUP BY 1")
def agg20(t: Tables):
    return t.episodes.groupBy("tenant_id").agg(_one().alias("n"), F.round(F.sum("duration_seconds") / 3600.0).cast("long").alias("hours"), F.count_distinct(F.when(F.col("guest") != "", F.col("guest"))).alias("people"))


@query("AGG20_totals", "SELECT sum(n)::BIGINT AS n, sum(hours)::BIGINT AS hours FROM (SELECT tenant_id, count(*) AS n, round(sum(duration_seconds) / 3600.0::DOUBLE)::BIGINT AS hours FROM episodes GROUP BY 1)")
def agg20_totals(t: Tables):
    return agg20(t).agg(F.sum("n").alias("n"), F.sum("hours").alias("hours"))


@query("AGG21", f"SELECT k, count(DISTINCT tenant_id) AS tenants FROM (SELECT tenant_id, {GUEST} AS k FROM episodes) WHERE NOT contains(k, '00007') GROUP BY 1 HAVING count(DISTINCT tenant_id) >= 2")
def agg21(t: Tables):
    keys = t.episodes.select("tenant_id", P.guest_key().alias("k")).filter(P.contains_none("k", ["00007"])).distinct()
    return M.frequency(keys, "k", name="tenants").filter("tenants >= 2")


@query("AGG22", "SELECT l.label, count(DISTINCT e.tenant_id) AS tenants FROM links l JOIN episodes e ON e.id = l.episode_id WHERE link_type = 'company' GROUP BY 1 HAVING count(DISTINCT e.tenant_id) >= 2")
def agg22(t: Tables):
    seen = t.links.filter("link_type = 'company'").join(t.episodes.select(F.col("id").alias("episode_id"), "tenant_id"), "episode_id").select("label", "tenant_id").distinct()
    return M.frequency(seen, "label", name="tenants").filter("tenants >= 2")


@query("AGG23", f"""WITH p AS (SELECT {GUEST} AS k, tenant_id, count(*) AS n, list(DISTINCT pillar) AS ps FROM episodes GROUP BY 1, 2), u AS (SELECT k, sum(n)::BIGINT AS n, count(*) AS tenants, list_sort(list_distinct(flatten(list(ps)))) AS pillars, string_agg(tenant_id || ':' || n, ',' ORDER BY tenant_id) AS appearances FROM p GROUP BY 1),
b AS (SELECT lower(trim(name)) AS k, bio, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY length(bio) DESC, id) AS rn FROM guests WHERE bio IS NOT NULL), l AS (SELECT lower(trim(name)) AS k, linkedin_url AS profile, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY id) AS rn FROM guests WHERE linkedin_url IS NOT NULL)
SELECT u.k, n, tenants, pillars, appearances, bio, profile, tenants > 1 AS shared FROM u LEFT JOIN b ON b.k = u.k AND b.rn = 1 LEFT JOIN l ON l.k = u.k AND l.rn = 1 ORDER BY shared DESC, n DESC, u.k LIMIT 500""")  # fmt: skip
def agg23(t: Tables):
    """Each person's appearances a tenant, longest bio (of equal ones the first) and first profile; shared ones first."""
    people = t.guests.withColumn("k", F.lower(F.trim("name")))
    bio = R.distinct_on(people.filter("bio is not null"), ["k"], [F.desc(F.length("bio")), F.asc("id")]).select("k", "bio")
    profile = R.distinct_on(people.filter("linkedin_url is not null"), ["k"], [F.asc("id")]).select("k", F.col("linkedin_url").alias("profile"))
    by_tenant = t.episodes.groupBy(P.guest_key().alias("k"), "tenant_id").agg(_one().alias("n"), F.collect_set("pillar").alias("ps"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tenant_id", "n"))), lambda x: F.concat(x["tenant_id"], F.lit(":"), x["n"])), ",")
    seen = by_tenant.groupBy("k").agg(F.sum("n").alias("n"), _one().alias("tenants"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("pillars"), lines.alias("appearances"))
    top = seen.withColumn("shared", F.col("tenants") > 1).orderBy(F.desc("shared"), F.desc("n"), "k").limit(500)
    return top.join(bio, "k", "left").join(profile, "k", "left").select("k", "n", "tenants", "pillars", "appearances", "bio", "profile", "shared")


@query("AGG24", """WITH m AS (SELECT l.label, e.tenant_id, count(*) AS n FROM links l JOIN episodes e ON e.id = l.episode_id WHERE link_type = 'company' GROUP BY 1, 2)
SELECT label, sum(n)::BIGINT AS total, count(*) AS tenants, string_agg(tenant_id || '=' || n, ',' ORDER BY tenant_id) AS by_tenant FROM m GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, label LIMIT 50""")  # fmt: skip
def agg24(t: Tables):
    m = M.frequency(t.links.filter("link_type = 'company'").join(t.episodes.select(F.col("id").alias("episode_id"), "tenant_id"), "episode_id"), "label", "tenant_id")
    pivot = m.groupBy("label").agg(F.sum("n").alias("total"), _one().alias("tenants"), F.array_join(F.array_sort(F.collect_list(F.concat("tenant_id", F.lit("="), "n"))), ",").alias("by_tenant"))
    return pivot.filter("tenants >= 2").orderBy(F.desc("total"), "label").limit(50)


@query("AGG25", "SELECT date_trunc('month', date_created)::TIMESTAMP AS month, " + ", ".join(f"count(*) FILTER (tenant_id = '{p}') AS t{p[0]}" for p in PRIORITIES) + ", count(*) AS total FROM episodes GROUP BY 1")
def agg25(t: Tables):
    wide = t.episodes.groupBy(F.date_trunc("month", "date_created").alias("month")).pivot("tenant_id", PRIORITIES).agg(_one()).na.fill(0)
    renamed = wide.toDF("month", *(f"t{p[0]}" for p in PRIORITIES))
    return renamed.withColumn("total", sum((F.col(f"t{p[0]}") for p in PRIORITIES), F.lit(0)))


@query("AGG26", f"""SELECT tenant_id, n, numbered, CASE WHEN numbered / n::DOUBLE > 0.8 THEN most ELSE n END AS displayed FROM (
 SELECT tenant_id, count(*) AS n, count(*) FILTER (episode_number % 6 <> 0) AS numbered, max(episode_number) AS most FROM episodes WHERE {FULL} AND editorial_type = 'full' GROUP BY 1)""")  # fmt: skip
def agg26(t: Tables):
    cards = t.episodes.filter(P.full_episode() & (F.col("editorial_type") == "full")).groupBy("tenant_id").agg(_one().alias("n"), F.count_if(F.col("episode_number") % 6 != 0).alias("numbered"), F.max("episode_number").alias("most"))
    return cards.select("tenant_id", "n", "numbered", F.when(F.col("numbered") / F.col("n") > 0.8, F.col("most")).otherwise(F.col("n")).alias("displayed"))


@query("AGG27", f"SELECT from_tenant, to_tenant, count(*) AS n FROM ({REFS}) GROUP BY 1, 2".replace("FROM (SELECT", "FROM (SELECT"))
def agg27(t: Tables):
    return M.frequency(host_refs(t), "from_tenant", "to_tenant")


@query("AGG28", f"""WITH p AS (SELECT from_tenant, to_tenant, count(*) AS n FROM ({REFS}) GROUP BY 1, 2), s AS (SELECT count(*) AS k FROM p WHERE n >= 5)
SELECT from_tenant, to_tenant, n, CASE WHEN k >= 5 THEN 'normal' ELSE 'starter' END AS mode FROM (SELECT *, row_number() OVER (ORDER BY n DESC, from_tenant, to_tenant) AS rn FROM p) JOIN s ON true WHERE n >= 5 AND rn <= CASE WHEN k >= 5 THEN 10 ELSE 3 END""")  # fmt: skip
def agg28(t: Tables):
    """Ten pairs tell whether there are five or more, so the pairs are counted once."""
    from pyspark.sql import Window

    best = agg27(t).filter("n >= 5").orderBy(F.desc("n"), "from_tenant", "to_tenant").limit(10)
    order = Window.orderBy(F.desc("n"), "from_tenant", "to_tenant")  # over ten rows
    ranked = best.withColumn("rn", F.row_number().over(order)).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy()) >= 5)
    return ranked.filter("many or rn <= 3").select("from_tenant", "to_tenant", "n", F.when(F.col("many"), "normal").otherwise("starter").alias("mode"))


@query("AGG29", "SELECT count(*) AS n, count(DISTINCT tenant_id) AS tenants, round(sum(duration_seconds) / 3600.0::DOUBLE)::BIGINT AS hours FROM episodes WHERE tenant_id IN ('1-URGENT', '5-LOW')")
def agg29(t: Tables):
    return t.episodes.filter(F.col("tenant_id").isin("1-URGENT", "5-LOW")).agg(_one().alias("n"), F.count_distinct("tenant_id").alias("tenants"), F.round(F.sum("duration_seconds") / 3600.0).cast("long").alias("hours"))


@query("AGG30", """WITH c AS (SELECT tenant_id, count(*) AS n, round(sum(duration_seconds) / 3600.0::DOUBLE)::BIGINT AS hours FROM episodes GROUP BY 1),
g AS (SELECT tenant_id, guest AS top_guest, c AS top_n, row_number() OVER (PARTITION BY tenant_id ORDER BY c DESC, guest) AS rn FROM (SELECT tenant_id, guest, count(*) AS c FROM episodes WHERE guest <> '' GROUP BY 1, 2)),
s AS (SELECT tenant_id, label AS top_sponsor, row_number() OVER (PARTITION BY tenant_id ORDER BY c DESC, label) AS rn FROM (SELECT e.tenant_id, l.label, count(*) AS c FROM links l JOIN episodes e ON e.id = l.episode_id WHERE link_type = 'company' GROUP BY 1, 2))
SELECT c.tenant_id, n, hours, top_guest, top_n, top_sponsor FROM c LEFT JOIN g ON g.tenant_id = c.tenant_id AND g.rn = 1 LEFT JOIN s ON s.tenant_id = c.tenant_id AND s.rn = 1 UNION ALL SELECT 'all', sum(n)::BIGINT, sum(hours)::BIGINT, NULL, NULL, NULL FROM c""")
def agg30(t: Tables):
    """Each tenant's sums with its top guest and sponsor, and the sums of all."""
    top = R.distinct_on(M.frequency(t.episodes.filter("guest <> ''"), "tenant_id", "guest", name="top_n"), ["tenant_id"], [F.desc("top_n"), F.asc("guest")]).withColumnRenamed("guest", "top_guest")
    named = t.links.filter("link_type = 'company'").join(t.episodes.select(F.col("id").alias("episode_id"), "tenant_id"), "episode_id")
    sponsor = R.distinct_on(M.frequency(named, "tenant_id", "label"), ["tenant_id"], [F.desc("n"), F.asc("label")]).select("tenant_id", F.col("label").alias("top_sponsor"))
    sums = t.episodes.groupBy("tenant_id").agg(_one().alias("n"), F.round(F.sum("duration_seconds") / 3600.0).cast("long").alias("hours"))
    rows = sums.join(top, "tenant_id", "left").join(sponsor, "tenant_id", "left").select("tenant_id", "n", "hours", "top_guest", "top_n", "top_sponsor")
    none = F.lit(None)
    return rows.union(sums.agg(F.sum("n").alias("n"), F.sum("hours").alias("hours")).select(F.lit("all"), "n", "hours", none.cast("string"), none.cast("long"), none.cast("string")))


@query("AGG31", "SELECT g.id, count(*) AS n, count(DISTINCT pillar) AS pillars, sum(round(duration_seconds / 60.0::DOUBLE))::BIGINT AS minutes, count(*) > 1 AS recurring FROM guests g JOIN guest_episodes b ON b.guest_id = g.id JOIN episodes e ON e.id = b.episode_id GROUP BY 1")
def agg31(t: Tables):
    rows = t.guest_episodes.join(t.episodes.select(F.col("id").alias("episode_id"), "pillar", "duration_seconds"), "episode_id").join(t.guests.select(F.col("id").alias("guest_id")), "guest_id", "left_semi")
    return rows.groupBy(F.col("guest_id").alias("id")).agg(_one().alias("n"), F.count_distinct("pillar").alias("pillars"), F.sum(F.round(F.col("duration_seconds") / 60.0)).cast("long").alias("minutes")).withColumn("recurring", F.col("n") > 1)


def reference_edges(t: Tables):
    """Directed edges between items whose links name each other's URL."""
    return t.links.select(F.col("episode_id").alias("source"), "url").join(t.episodes.select(F.col("id").alias("target"), "url"), "url").filter("source <> target").select("source", "target")


@query("AGG32", "WITH x AS (SELECT l.episode_id AS source, e.id AS target FROM links l JOIN episodes e ON e.url = l.url WHERE l.episode_id <> e.id), w AS (SELECT source, target, count(*) AS weight FROM x GROUP BY 1, 2) SELECT source, target, weight, count(*) OVER (PARTITION BY target) AS in_degree FROM w")
def agg32(t: Tables):
    return M.edge_degrees(reference_edges(t), "source", "target").select("source", "target", "weight", "in_degree")


@query("AGG33", "SELECT coalesce(tenant_id, 'total') AS tenant_id, count(*) AS n, round(sum(duration_seconds) / 3600.0::DOUBLE, 3) AS hours FROM episodes GROUP BY ROLLUP (tenant_id)")
def agg33(t: Tables):
    return t.episodes.rollup("tenant_id").agg(_one().alias("n"), F.round(F.sum("duration_seconds") / 3600.0, 3).alias("hours")).withColumn("tenant_id", F.coalesce("tenant_id", F.lit("total")))


@query("AGG34", "SELECT tenant_id, count(*) AS rows, count(*) FILTER (guest <> '') AS guest, count(*) FILTER (difficulty IS NOT NULL) AS difficulty, count(*) FILTER (episode_type IS NOT NULL) AS kind, count(*) FILTER (duration_seconds > 1000) AS long FROM episodes GROUP BY 1")
def agg34(t: Tables):
    return M.fill_rates(t.episodes, ["tenant_id"], {"guest": F.col("guest") != "", "difficulty": F.col("difficulty").isNotNull(), "kind": F.col("episode_type").isNotNull(), "long": F.col("duration_seconds") > 1000})


@query("AGG35", "SELECT episode_type, editorial_type, count(*) AS n, list_sort(list(id) FILTER (rn <= 5)) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY episode_type, editorial_type ORDER BY id) AS rn FROM episodes) GROUP BY 1, 2")
def agg35(t: Tables):
    keys = ["episode_type", "editorial_type"]
    few = R.top_n_per_group(t.episodes.select(*keys, "id"), keys, [F.asc("id")], 5).groupBy(*(F.coalesce(k, F.lit("")).alias(f"_{k}") for k in keys)).agg(F.array_sort(F.collect_list("id")).alias("samples"))
    n = M.frequency(t.episodes, *keys)
    return n.join(few, (F.coalesce(n.episode_type, F.lit("")) == few._episode_type) & (F.coalesce(n.editorial_type, F.lit("")) == few._editorial_type)).select(*keys, "n", "samples")


@query("AGG36", "SELECT CASE WHEN duration_seconds IS NULL THEN 'unknown' WHEN duration_seconds < 600 THEN 'short' WHEN duration_seconds < 1800 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n FROM episodes GROUP BY 1")
def agg36(t: Tables):
    return M.bucketed(t.episodes, "duration_seconds", [600, 1800], ["short", "middle", "long"])


@query("AGG37", """WITH l AS (SELECT CASE WHEN doc_id % 10 = 0 THEN -1 ELSE quality END AS cluster, toxic FROM labels), c AS (SELECT cluster, toxic, count(*) AS n FROM l WHERE cluster <> -1 GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS i, sum(n)::DOUBLE AS t FROM c),
a AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS a FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY cluster)), b AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS b FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY toxic)),
r AS (SELECT CASE WHEN t <= 10 THEN 0 ELSE round((i - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) END AS ari FROM i, a, b) SELECT ari, CASE WHEN ari > 0.5 THEN 'strong' WHEN ari > 0.3 THEN 'moderate' ELSE 'weak' END AS band FROM r""")  # fmt: skip
def agg37(t: Tables):
    """Labels against a second label; a tenth of the rows is marked as noise and left out."""
    labels = t.raw("labels").select(F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("quality")).alias("cluster"), "toxic")
    return M.adjusted_rand(labels, "cluster", "toxic", noise=-1)


@query("AGG38", "SELECT label, pillar, n FROM (SELECT label, pillar, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, pillar) AS rn FROM (SELECT label, vec_id % 7 AS pillar, count(*) AS n FROM embeddings GROUP BY 1, 2)) WHERE rn <= 3")
def agg38(t: Tables):
    counts = M.frequency(t.raw("embeddings").select("label", (F.col("vec_id") % 7).alias("pillar")), "label", "pillar")
    return R.top_n_per_group(counts, ["label"], [F.desc("n"), F.asc("pillar")], 3)


@query("AGG39", r"""WITH m AS (SELECT doc_id AS id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9._-]+@[a-zA-Z0-9-]+[.][a-z]+'), lambda x: lower(x)))) AS contact FROM documents
 UNION ALL SELECT episode_id, regexp_replace(lower(url), '/+$', '') FROM links WHERE link_type <> 'episode_ref') SELECT contact, count(DISTINCT id) AS n FROM m GROUP BY 1 HAVING count(DISTINCT id) >= 5""")
def agg39(t: Tables):
    """Addresses and accounts seen in five items or more; links to content don't count, a slash at the end is dropped."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z0-9._-]+@[a-zA-Z0-9-]+[.][a-z]+"), F.lit(0)), F.lower))
    mails = t.documents.select(F.col("doc_id").alias("id"), F.explode(found).alias("contact"))
    accounts = t.links.filter("link_type <> 'episode_ref'").select("episode_id", F.regexp_replace(F.lower("url"), "/+$", ""))
    return mails.union(accounts).distinct().groupBy("contact").agg(_one().alias("n")).filter("n >= 5")


@query("AGG40", "SELECT lens, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['user', 'assistant', 'system', 'tool']) AS lens) LEFT JOIN (SELECT role AS lens, count(*) AS n FROM conversations GROUP BY 1) USING (lens)")
def agg40(t: Tables):
    lenses = t.spark.createDataFrame([(x,) for x in ("user", "assistant", "system", "tool")], "lens string")
    return lenses.join(M.frequency(t.raw("conversations").withColumnRenamed("role", "lens"), "lens"), "lens", "left").select("lens", F.coalesce("n", F.lit(0)).alias("n"))


@query("AGG41", "SELECT tenant_id, count(*) AS n, coalesce(round(avg(CASE WHEN duration_seconds > 2000 THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END), 2), 0) AS quality FROM episodes GROUP BY 1")
def agg41(t: Tables):
    return t.episodes.groupBy("tenant_id").agg(_one().alias("n"), F.coalesce(F.round(F.avg(F.when(F.col("duration_seconds") > 2000, 0.8).otherwise(0.1)), 2), F.lit(0.0)).alias("quality"))


@query("AGG42", "SELECT lang, count(*) AS rows, count(*) FILTER (regexp_matches(text, '[0-9]{3}')) AS numbers, count(*) FILTER (contains(text, '@')) AS contacts, count(*) FILTER (contains(text, chr(10))) AS blocks FROM documents GROUP BY 1")
def agg42(t: Tables):
    text = F.col("text")
    return M.fill_rates(t.documents, ["lang"], {"numbers": text.rlike("[0-9]{3}"), "contacts": F.contains(text, F.lit("@")), "blocks": F.contains(text, F.lit("\n"))})


@query("AGG43", "SELECT g.id, count(DISTINCT b.episode_id) FILTER (b.episode_id % 3 = 0) AS n FROM guests g LEFT JOIN guest_episodes b ON b.guest_id = g.id GROUP BY 1")
def agg43(t: Tables):
    n = t.guest_episodes.filter("episode_id % 3 = 0").groupBy(F.col("guest_id").alias("id")).agg(F.count_distinct("episode_id").alias("n"))
    return t.guests.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("AGG44", "SELECT episode_id, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (link_type = 'tool') AS tools, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (link_type = 'company') AS companies, count(*) FILTER (link_type NOT IN ('tool', 'company')) AS others FROM links GROUP BY 1")
def agg44(t: Tables):
    ids = lambda kind: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("link_type") == kind, F.col("id")))), ","), F.lit(""))
    return t.links.groupBy("episode_id").agg(ids("tool").alias("tools"), ids("company").alias("companies"), F.count_if(~F.col("link_type").isin("tool", "company")).alias("others"))


@query("AGG45", "SELECT source, target, count(*) AS n FROM (SELECT d.source, r.target FROM documents d JOIN (VALUES ('the', 'src1'), ('que', 'src2'), ('und', 'src3')) r(pattern, target) ON contains(lower(d.text), ' ' || r.pattern || ' ') WHERE d.source <> r.target ORDER BY d.doc_id DESC, r.target LIMIT 300) GROUP BY 1, 2")
def agg45(t: Tables):
    """The newest 300 references, counted by direction."""
    rules = t.spark.createDataFrame([("the", "src1"), ("que", "src2"), ("und", "src3")], "pattern string, target string")
    hits = t.documents.join(F.broadcast(rules), F.contains(F.lower("text"), F.concat(F.lit(" "), "pattern", F.lit(" "))) & (F.col("source") != F.col("target")))
    return M.frequency(hits.select("doc_id", "source", "target").orderBy(F.desc("doc_id"), "target").limit(300), "source", "target")


@query("AGG46", "SELECT e.id, g.linkedin_url FROM episodes e JOIN guest_episodes b ON b.episode_id = e.id JOIN guests g ON g.id = b.guest_id")
def agg46(t: Tables):
    media = t.guest_episodes.join(t.guests.select(F.col("id").alias("guest_id"), "linkedin_url"), "guest_id")
    return t.episodes.select("id").join(media.withColumnRenamed("episode_id", "id"), "id").select("id", "linkedin_url")


@query("AGG47", "SELECT substr(text, 1, 1) AS first, count(*) AS n FROM documents GROUP BY 1")
def agg47(t: Tables):
    return M.frequency(t.documents.select(F.substring("text", 1, 1).alias("first")), "first")


@query("GRF1", "WITH x AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM episodes a JOIN episodes b ON a.guest = b.guest AND a.id < b.id AND a.guest <> '' AND a.tenant_id = b.tenant_id), d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM x UNION ALL SELECT b FROM x) GROUP BY 1) SELECT a, b, p.n AS degree_a, q.n AS degree_b FROM x JOIN d p ON p.id = a JOIN d q ON q.id = b")
def grf1(t: Tables):
    """Edges between items of one guest in one tenant, undirected, with the degrees of their ends; the list itself is what is asked for."""
    e = t.episodes.filter("guest <> ''").select("tenant_id", "guest", "id")
    # an item has one guest, so its degree is the others of its group
    sized = e.join(e.groupBy("tenant_id", "guest").agg((_one() - 1).alias("degree")), ["tenant_id", "guest"])
    a, b = (sized.withColumnsRenamed({"id": x, "degree": f"degree_{x}"}) for x in "ab")
    return a.join(b, ["tenant_id", "guest"]).filter("a < b").select("a", "b", "degree_a", "degree_b")


@query("GRF2", """WITH c AS (SELECT o_orderkey AS id, o_custkey % 97 AS expert FROM orders), s AS (SELECT conv_id * 17 + turn AS k, conv_id, turn FROM conversations),
x AS (SELECT id AS a, lead(id) OVER (PARTITION BY expert ORDER BY id) AS b, 'expert' AS kind, 4 AS w FROM c UNION ALL SELECT k, lead(k) OVER (PARTITION BY conv_id ORDER BY turn), 'step', 2 FROM s UNION ALL SELECT lead(k) OVER (PARTITION BY conv_id ORDER BY turn), k, 'step', 2 FROM s
 UNION ALL SELECT id, lead(id) OVER (PARTITION BY guest ORDER BY id), 'guest', 2 FROM episodes WHERE guest <> '') SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, kind, w FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b""")  # fmt: skip
def grf2(t: Tables):
    """Edges of three kinds: items of one expert (weight 4), steps of a path both ways, items of one guest; once for a pair and kind."""

    def chain(df, group: str, key, kind: str, weight: int):
        near = R.with_prev_next(df.select(F.col(group).alias("g"), key.alias("a")), ["g"], "a")
        return near.select("a", F.col("next").alias("b"), F.lit(kind).alias("kind"), F.lit(weight).alias("w"))

    steps = chain(t.raw("conversations"), "conv_id", F.col("conv_id") * 17 + F.col("turn"), "step", 2)
    back = steps.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", "w")
    rows = chain(t.raw("orders").withColumn("expert", F.col("o_custkey") % 97), "expert", F.col("o_orderkey"), "expert", 4).union(steps).union(back).union(chain(t.episodes.filter("guest <> ''"), "guest", F.col("id"), "guest", 2))
    return rows.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "w").distinct()
