"""People, fuzzy matches, quizzes and category assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import predicates as P
from tesserae.functions import text as X
from tesserae.operators import loads as L
from tesserae.operators import measures as M
from tesserae.operators import people as E
from tesserae.operators import relational as R
from tesserae.plans.basics import FULL, GUEST, GUEST_NAME, NAME_SQL
from tesserae.plans.registry import query
from tesserae.plans.streams import place, saver
from tesserae.sources.tables import Tables

TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 2))"


def tokens(text):
    """Distinct lower-cased tokens of three letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


@query("ENT1", f"""WITH p AS (SELECT replace({GUEST_NAME}, '#', ' ') AS name, tenant_id, episode_number FROM episodes), v AS (SELECT trim(regexp_replace(strip_accents(lower(name)), '\\s+', ' ', 'g')) AS k, * FROM p WHERE {NAME_SQL.format(n='name')}),
a AS (SELECT k, tenant_id, count(*) AS n, list_sort(list(DISTINCT episode_number) FILTER (episode_number IS NOT NULL)) AS numbers FROM v WHERE length(k) >= 3 GROUP BY 1, 2),
g AS (SELECT trim(lower(replace(name, '#', ' '))) AS k, id, bio, linkedin_url FROM guests), b AS (SELECT k, bio, row_number() OVER (PARTITION BY k ORDER BY length(bio) DESC, id) AS rn FROM g WHERE bio IS NOT NULL), l AS (SELECT k, linkedin_url, row_number() OVER (PARTITION BY k ORDER BY id) AS rn FROM g WHERE linkedin_url IS NOT NULL)
SELECT u.*, b.bio, l.linkedin_url AS profile, contains(u.k, '00007') AS host FROM (SELECT k, count(*) AS tenants, sum(n)::BIGINT AS n, string_agg(tenant_id || ':' || array_to_string(numbers, ' '), ',' ORDER BY tenant_id) AS appearances FROM a GROUP BY 1) u LEFT JOIN b ON b.k = u.k AND b.rn = 1 LEFT JOIN l ON l.k = u.k AND l.rn = 1""")  # fmt: skip
def ent1(t: Tables):
    spaced = lambda c: F.regexp_replace(c, "#", " ")
    seen = t.episodes.select(spaced(F.coalesce(F.nullif("guest", F.lit("")), "guest_from_title")).alias("name"), "tenant_id", "episode_number")
    known = t.guests.select("id", spaced(F.col("name")).alias("name"), "bio", F.col("linkedin_url").alias("profile"))
    return E.merged_people(seen, known).withColumn("host", F.contains("k", F.lit("00007")))


#: ``tidy_chunk`` of a text whose blanks are folded.
CHUNK = "CASE WHEN length({t}) >= 60 THEN CASE WHEN length({t}) <= 500 THEN {t} WHEN length(regexp_extract(substr({t}, 1, 500), '^(.*[.!?]) ', 1)) > 201 THEN regexp_extract(substr({t}, 1, 500), '^(.*[.!?]) ', 1) ELSE substr({t}, 1, 500) END END"


def candidates(t: Tables):
    """Profile candidates: links of a guest's items; one label in five names the guest."""
    linked = t.guest_episodes.join(t.guests.select(F.col("id").alias("guest_id"), F.regexp_replace("name", "#", " ").alias("person")), "guest_id").join(t.links.filter("link_type = 'company'"), "episode_id")
    return linked.select("person", "id", F.regexp_extract("url", "/p/([0-9]+)", 1).alias("slug"), F.when(F.col("id") % 5 == 0, F.concat("label", F.lit(" - "), F.lower("person"))).otherwise(F.col("label")).alias("label"))


NAMED = "list_filter(string_split(lower(person), ' '), lambda w: length(w) >= 4)"


@query("ENT2", f"""WITH c AS (SELECT replace(g.name, '#', ' ') AS person, l.id, regexp_extract(l.url, '/p/([0-9]+)', 1) AS slug, CASE WHEN l.id % 5 = 0 THEN l.label || ' - ' || lower(replace(g.name, '#', ' ')) ELSE l.label END AS label FROM guest_episodes b JOIN guests g ON g.id = b.guest_id JOIN links l ON l.episode_id = b.episode_id WHERE l.link_type = 'company'),
h(host, host_slug) AS (VALUES ('Customer 000000007', '7'), ('Customer 000000011', '11')),
r AS (SELECT c.*, slug IN ('3', '4') AS parasite, hs.host_slug IS NOT NULL AS of_host, EXISTS (SELECT 1 FROM h WHERE host = person) AS is_host,
 len(list_filter({NAMED}, lambda w: contains(' ' || regexp_replace(lower(label), '[^a-z]', ' ', 'g') || ' ', ' ' || w || ' '))) > 0 OR contains(lower(label), lower(person)) AS labelled, contains(slug, lower(person)) AS slugged FROM c LEFT JOIN (SELECT DISTINCT host_slug FROM h) hs ON hs.host_slug = c.slug),
k AS (SELECT person, id, CASE WHEN is_host AND of_host THEN 'host' WHEN labelled THEN 'label' WHEN slugged THEN 'slug' ELSE 'order' END AS rule FROM r WHERE NOT parasite AND (NOT of_host OR is_host))
SELECT person, id, rule, 'picked' AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY list_position(['host', 'label', 'slug', 'order'], rule), id) AS rn FROM k) WHERE rn = 1
UNION ALL SELECT DISTINCT person, id, CASE WHEN parasite THEN 'parasite' ELSE 'host' END, 'rejected' FROM r WHERE parasite OR (of_host AND NOT is_host)""")  # fmt: skip
def ent2(t: Tables):
    hosts = t.spark.createDataFrame([("Customer 000000007", "7"), ("Customer 000000011", "11")], "host string, host_slug string")
    picked, rejected = E.pick_profile(candidates(t), hosts, parasites=["3", "4"])
    return picked.withColumn("outcome", F.lit("picked")).union(rejected.withColumn("outcome", F.lit("rejected")))


@query("ENT3", "SELECT DISTINCT tenant_id, variant FROM (SELECT tenant_id, unnest([replace(s, '-', ''), s, replace(s, '-', '.'), s[1] || replace(substr(s, strpos(s, '-') + 1), '-', '')]) AS variant FROM (SELECT tenant_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM guests WHERE authority_score > 95))")
def ent3(t: Tables):
    return t.guests.filter("authority_score > 95").select("tenant_id", F.explode(X.slug_variants(F.col("name"))).alias("variant")).distinct()


@query("ENT4", f"SELECT tenant_id, count(*) AS n, count(*) FILTER (len(list_filter({TOK.format('name')}, lambda w: contains(linkedin_url, w))) < 2) AS bad FROM guests WHERE linkedin_url IS NOT NULL GROUP BY 1")
def ent4(t: Tables):
    some = t.guests.filter("linkedin_url is not null").withColumn("hits", F.size(F.filter(tokens(F.col("name")), lambda w: F.contains(F.col("linkedin_url"), w))))
    return some.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") < 2).alias("bad"))


LOADED = rf"""WITH hosts(tenant_id, host, host_slug) AS (VALUES ('1-URGENT', 'Customer 000000007', '7'), ('5-LOW', 'Customer 000000011', '11')),
ep AS (SELECT e.id, e.tenant_id, replace(guest, '#', ' ') AS guest, trim(regexp_replace(replace({GUEST_NAME}, '#', ' '), '^#[0-9]+ *-? *', '')) AS name, replace(guest_from_title, '#', ' ') AS titled, {FULL} AS whole,
  CASE doc_id % 3 WHEN 1 THEN substr(text, 1, 100) || ' ' || replace(guest_from_title, '#', ' ') || ', ' || substr(text, 101) WHEN 2 THEN substr(text, 1, 50) || ' Customer ' || substr(text, 51) END AS article, CASE WHEN doc_id % 2 = 0 THEN text END AS intro FROM episodes e LEFT JOIN documents d ON d.doc_id = e.id),
p0 AS (SELECT id, tenant_id, replace(name, '#', ' ') AS name, bio, linkedin_url AS profile FROM guests WHERE id // 10 % 5 <> 0),
x AS (SELECT * FROM ep WHERE whole AND {NAME_SQL.format(n='name')} AND NOT EXISTS (SELECT 1 FROM hosts h WHERE h.tenant_id = ep.tenant_id AND host = name)),
q AS (SELECT * FROM p0 UNION ALL SELECT substr(name, 10)::BIGINT * 10 + substr(tenant_id, 1, 1)::BIGINT, tenant_id, name, NULL, NULL FROM (SELECT DISTINCT tenant_id, name FROM x) k WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.tenant_id = k.tenant_id AND p0.name = k.name)),
b AS (SELECT guest_id, episode_id FROM guest_episodes WHERE episode_id % 3 <> 0 AND guest_id // 10 % 5 <> 0 UNION SELECT q.id, x.id FROM x JOIN q ON q.tenant_id = x.tenant_id AND q.name = x.name),
c AS (SELECT q.tenant_id, q.name AS person, l.id, l.url, regexp_extract(l.url, '/p/([0-9]+)', 1) AS slug, CASE WHEN l.id % 5 = 0 THEN l.label || ' - ' || lower(ep.titled) ELSE l.label END AS label FROM q JOIN b ON b.guest_id = q.id JOIN links l ON l.episode_id = b.episode_id JOIN ep ON ep.id = l.episode_id AND ep.tenant_id = q.tenant_id WHERE q.profile IS NULL AND l.link_type = 'company'),
r AS (SELECT c.*, slug IN ('3', '4') AS parasite, EXISTS (SELECT 1 FROM hosts h WHERE h.tenant_id = c.tenant_id AND host_slug = slug) AS of_host, EXISTS (SELECT 1 FROM hosts h WHERE h.tenant_id = c.tenant_id AND host = person) AS is_host,
 len(list_filter({NAMED}, lambda w: contains(' ' || regexp_replace(lower(label), '[^a-z]', ' ', 'g') || ' ', ' ' || w || ' '))) > 0 OR contains(lower(label), lower(person)) AS labelled, contains(slug, lower(person)) AS slugged FROM c),
k AS (SELECT *, CASE WHEN is_host AND of_host THEN 1 WHEN labelled THEN 2 WHEN slugged THEN 3 ELSE 4 END AS rule FROM r WHERE NOT parasite AND (NOT of_host OR is_host)),
l1 AS (SELECT tenant_id, person AS name, url FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, person ORDER BY rule, id) AS rn FROM k) WHERE rn = 1),
f AS (SELECT tenant_id, name, min(id) FILTER (length(article) > 300) AS a, min(id) FILTER (length(intro) > 60) AS i FROM x GROUP BY 1, 2),
g AS (SELECT f.tenant_id, f.name, trim(regexp_replace(CASE WHEN strpos(s.article, f.name) > 0 THEN substr(f.name || ' ' || regexp_replace(substr(s.article, strpos(s.article, f.name) + length(f.name)), '^[\s",.;:!?''«»]+', ''), 1, 600)
  WHEN strpos(s.article, string_split(f.name, ' ')[1]) > 0 THEN substr(s.article, strpos(s.article, string_split(f.name, ' ')[1]), 600) END, '\s+', ' ', 'g')) AS t1, trim(regexp_replace(o.intro, '\s+', ' ', 'g')) AS t2 FROM f LEFT JOIN ep s ON s.id = f.a LEFT JOIN ep o ON o.id = f.i),
h AS (SELECT tenant_id, name, coalesce({CHUNK.format(t='t1')}, {CHUNK.format(t='t2')}) AS told FROM g),
n AS (SELECT guest_id, count(DISTINCT episode_id) AS n FROM b GROUP BY 1)
SELECT 'person' AS kind, q.tenant_id, q.id, q.name, coalesce(nullif(q.bio, ''), told) AS bio, coalesce(q.profile, l1.url) AS profile, coalesce(n.n, 0) AS n FROM q LEFT JOIN l1 ON l1.tenant_id = q.tenant_id AND l1.name = q.name LEFT JOIN h ON h.tenant_id = q.tenant_id AND h.name = q.name LEFT JOIN n ON n.guest_id = q.id
UNION ALL SELECT 'item', ep.tenant_id, ep.id, CASE WHEN ep.guest = '' THEN coalesce(x.name, '') ELSE ep.guest END, NULL, NULL, NULL FROM ep LEFT JOIN x ON x.id = ep.id UNION ALL SELECT 'bridge', NULL, guest_id, NULL, NULL, NULL, episode_id FROM b"""


@query("ENT5", LOADED)
def ent5(t: Tables):
    """The three tables after a load and its replay: people, items with their guests, and the bridge between them."""
    spaced = lambda c: F.regexp_replace(c, "#", " ")
    stored = t.episodes.select("id", "tenant_id", spaced(F.col("guest")).alias("guest"))
    items = saver(t)(t.episodes.select("id", "tenant_id", spaced(F.col("guest_from_title")).alias("guest_from_title"), "episode_type"))
    people = t.guests.filter("id div 10 % 5 <> 0").select("id", "tenant_id", spaced(F.col("name")).alias("name"), "bio", F.col("linkedin_url").alias("profile"), F.lit(0).cast("long").alias("n"))
    bridge = t.guest_episodes.filter("episode_id % 3 <> 0 and guest_id div 10 % 5 <> 0").distinct()
    titled = items.select(F.col("id").alias("episode_id"), "tenant_id", "guest_from_title")
    label = F.when(F.col("id") % 5 == 0, F.concat("label", F.lit(" - "), F.lower("guest_from_title"))).otherwise(F.col("label"))
    links = t.links.filter("link_type = 'company'").join(titled, "episode_id").select("id", "tenant_id", "episode_id", "url", F.regexp_extract("url", "/p/([0-9]+)", 1).alias("slug"), label.alias("label"))
    part = F.col("doc_id") % 3
    told = t.documents.join(titled, F.col("doc_id") == F.col("episode_id"))
    article = F.when(part == 1, F.concat(F.expr("substr(text, 1, 100)"), F.lit(" "), "guest_from_title", F.lit(", "), F.expr("substr(text, 101)"))).when(part == 2, F.concat(F.expr("substr(text, 1, 50)"), F.lit(" Customer "), F.expr("substr(text, 51)")))
    texts = told.select(F.col("episode_id").alias("id"), article.alias("article"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("intro"))
    hosts = t.spark.createDataFrame([("1-URGENT", "Customer 000000007", "7"), ("5-LOW", "Customer 000000011", "11")], "tenant_id string, host string, host_slug string")
    identity = F.expr("cast(substr(name, 10) as bigint) * 10 + cast(substr(tenant_id, 1, 1) as bigint)")

    kept = L.store(t.spark, place(t), buckets=8)
    kept.commit("start", {"items": stored, "people": people, "bridge": bridge})
    for batch in ("load", "load"):
        L.load_people(kept, batch, items, links, texts, hosts, ["3", "4"], identity)
    none = lambda kind: F.lit(None).cast(kind)
    after = kept.read("people").select(F.lit("person").alias("kind"), "tenant_id", "id", "name", "bio", "profile", "n")
    after = after.union(kept.read("items").select(F.lit("item"), "tenant_id", "id", "guest", none("string"), none("string"), none("long")))
    return after.union(kept.read("bridge").select(F.lit("bridge"), none("string"), "guest_id", none("string"), none("string"), none("string"), "episode_id"))


@query("JON12", f"""WITH a AS (SELECT DISTINCT p_name AS key, {TOK.format('p_name')} AS t FROM part), b AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS key, {TOK.format("p_name || ' ' || p_type")} AS t FROM part),
s AS (SELECT a.key AS a, b.key AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE, 6) AS score FROM a JOIN b ON list_has_any(a.t, b.t)),
r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY a ORDER BY score DESC, b))
SELECT a.key AS a, CASE WHEN coalesce(score, 0) >= 0.35 THEN b END AS b, score, CASE WHEN coalesce(score, 0) < 0.35 THEN 'unmatched' WHEN score >= 0.85 OR second IS NULL OR score - second >= 0.05 THEN 'match' ELSE 'ambiguous' END AS status FROM a LEFT JOIN r ON r.a = a.key AND rn = 1""")  # fmt: skip
def jon12(t: Tables):
    p = t.raw("part")
    left = p.select(F.col("p_name").alias("key")).distinct().withColumn("tokens", tokens(F.col("key")))
    right = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("key")).distinct().withColumn("tokens", tokens(F.col("key")))
    return E.jaccard_matches(left, right, 0.35, 0.85, 0.05)


@query("JON13")
def jon13(t: Tables):
    """Items by their guest's slug, and profile slugs of several makes: with a number, whole, longer, shorter, inside."""
    i = F.col("id")
    left = t.episodes.select(i.alias("a"), F.col("episode_number").alias("number"), P.slug(F.coalesce(F.nullif("guest", F.lit("")), "guest_from_title")).alias("x"))
    name = P.slug(F.col("name"))
    made = F.when(i % 5 == 0, F.concat(F.col("authority_score"), F.lit("-"), name)).when(i % 5 == 1, name).when(i % 5 == 2, F.concat(name, F.lit("-more"))).when(i % 5 == 3, F.substring(name, 1, 15)).otherwise(F.concat(F.lit("the-"), name))
    save = saver(t)
    return E.one_to_one(save(left), save(t.guests.select(i.alias("b"), made.alias("y"))), E.slug_rules(), save)


@query("JON21", "SELECT pillar, difficulty, list_sort(list(e.id || ':' || e.title)) AS items FROM (SELECT pillar, difficulty, unnest(list(id * 2)) AS ref FROM episodes GROUP BY 1, 2) n JOIN (SELECT id, title FROM episodes) e ON e.id = n.ref GROUP BY 1, 2")
def jon21(t: Tables):
    """Category to sub-theme to ids, nested twice and written once a thousand ids, resolved to titles; ids without an item are dropped."""
    part = F.floor(F.col("id") / 1000)
    nested = t.episodes.groupBy(part.alias("part"), "pillar", "difficulty").agg(F.collect_list(F.col("id") * 2).alias("ids")).groupBy("part", "pillar").agg(F.collect_list(F.struct("difficulty", "ids")).alias("themes"))
    flat = nested.select("pillar", F.inline("themes")).select("pillar", "difficulty", F.explode("ids").alias("id"))
    return flat.join(t.episodes.select("id", "title"), "id").groupBy("pillar", "difficulty").agg(F.array_sort(F.collect_list(F.concat("id", F.lit(":"), "title"))).alias("items"))


D = "CASE pillar WHEN 'error' THEN 1.0::DOUBLE WHEN 'click' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"


@query("QUI1", f"""WITH RECURSIVE a AS (SELECT user_id, pillar, "right" AS ok, {D} AS d, row_number() OVER (PARTITION BY user_id, pillar ORDER BY ts, event_id) AS i FROM answers),
r AS (SELECT user_id, pillar, i, 0.0::DOUBLE + 0.3::DOUBLE * (ok::INT::DOUBLE - 1 / (1 + exp(-(0.0::DOUBLE - d)))) AS theta, greatest(0, least(100, 50 + CASE WHEN ok THEN 10 ELSE -5 END)) AS score FROM a WHERE i = 1
 UNION ALL SELECT a.user_id, a.pillar, a.i, r.theta + 0.3::DOUBLE * (a.ok::INT::DOUBLE - 1 / (1 + exp(-(r.theta - a.d)))), greatest(0, least(100, r.score + CASE WHEN a.ok THEN 10 ELSE -5 END)) FROM r JOIN a ON a.user_id = r.user_id AND a.pillar = r.pillar AND a.i = r.i + 1)
SELECT user_id, pillar, round(arg_max(theta, i), 6) AS theta, arg_max(score, i) AS score, max(i)::INT AS n FROM r GROUP BY 1, 2""")  # fmt: skip
def qui1(t: Tables):
    d = F.when(F.col("pillar") == "error", 1.0).when(F.col("pillar") == "click", 0.0).otherwise(0.5)
    return E.ability(t.answers, ["user_id", "pillar"], ["ts", "event_id"], "right", d)


@query("QUI2", f"""WITH RECURSIVE a AS (SELECT user_id, pillar, "right" AS ok, {D} AS d, row_number() OVER (PARTITION BY user_id, pillar ORDER BY ts, event_id) AS i FROM answers),
r AS (SELECT user_id, pillar, i, 0.0::DOUBLE + 0.3::DOUBLE * (ok::INT::DOUBLE - 1 / (1 + exp(-(0.0::DOUBLE - d)))) AS theta, greatest(0, least(100, 50 + CASE WHEN ok THEN 10 ELSE -5 END)) AS score FROM a WHERE i = 1
 UNION ALL SELECT a.user_id, a.pillar, a.i, r.theta + 0.3::DOUBLE * (a.ok::INT::DOUBLE - 1 / (1 + exp(-(r.theta - a.d)))), greatest(0, least(100, r.score + CASE WHEN a.ok THEN 10 ELSE -5 END)) FROM r JOIN a ON a.user_id = r.user_id AND a.pillar = r.pillar AND a.i = r.i + 1),
h AS (SELECT user_id, pillar, round(arg_max(theta, i), 6) AS theta, max(i) AS n FROM r GROUP BY 1, 2), c AS (SELECT u.user_id, p.pillar, coalesce(h.n, 0) AS n, coalesce(h.theta, 0) AS theta FROM (SELECT DISTINCT user_id FROM answers) u JOIN (SELECT DISTINCT pillar FROM answers) p ON true LEFT JOIN h ON h.user_id = u.user_id AND h.pillar = p.pillar),
m AS (SELECT *, min(n) OVER (PARTITION BY user_id) AS mn FROM c), x AS (SELECT *, count(*) FILTER (n = mn) OVER (PARTITION BY user_id) > 3 OR mn < 2 AS explores FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN explores THEN (n <> mn)::INT ELSE (n < 2)::INT END, CASE WHEN explores THEN 0 ELSE abs(theta) END, pillar) AS rn FROM x)
SELECT user_id, pillar, explores, CASE WHEN theta < -0.5 THEN 'easy' WHEN theta > 0.5 THEN 'hard' ELSE 'medium' END AS level FROM b WHERE rn = 1""")  # fmt: skip
def qui2(t: Tables):
    d = F.when(F.col("pillar") == "error", 1.0).when(F.col("pillar") == "click", 0.0).otherwise(0.5)
    return E.next_pillar(E.ability(t.answers, ["user_id", "pillar"], ["ts", "event_id"], "right", d))


@query("QUI3", """WITH o AS (SELECT guest AS other FROM (SELECT guest, count(*) AS n FROM episodes WHERE guest <> '' GROUP BY 1 ORDER BY n DESC, guest LIMIT 20)),
w AS (SELECT id, guest, other, row_number() OVER (PARTITION BY id ORDER BY md5(id || other), other) AS rn FROM episodes JOIN o ON guest <> other WHERE guest <> ''), x AS (SELECT id, guest, other AS x FROM w WHERE rn <= 3 UNION ALL SELECT id, guest, guest FROM episodes WHERE guest <> ''),
l AS (SELECT id, any_value(guest) AS guest, list(x ORDER BY md5('o' || id || x), x) AS options FROM x GROUP BY 1) SELECT id, options, (list_position(options, guest) - 1)::BIGINT AS answer FROM l""")
def qui3(t: Tables):
    """Four options a question, three of them from other people of a bounded list, in an order set by hash."""
    names = F.broadcast(M.frequency(t.episodes.filter("guest <> ''"), "guest").orderBy(F.desc("n"), "guest").limit(20).agg(F.collect_list("guest").alias("others")))
    mark = lambda *c: F.md5(F.concat(*c).cast("binary"))
    by_mark = lambda xs, *lead: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(mark(*lead, F.col("id"), x).alias("h"), x.alias("x")))), lambda s: s["x"])
    q = t.episodes.filter("guest <> ''").select("id", "guest").join(names, F.lit(True))
    options = q.withColumn("o", F.slice(by_mark(F.filter("others", lambda x: x != F.col("guest"))), 1, 3)).withColumn("options", by_mark(F.array_append("o", F.col("guest")), F.lit("o")))
    return options.select("id", "options", (F.array_position("options", F.col("guest")) - 1).alias("answer"))


@query("CLS1", """WITH v(category) AS (VALUES ('P1'), ('P2'), ('P3'), ('P4')), a AS (SELECT event_id % 5000 AS id, 'P' || (event_id % 7) AS category, row_number() OVER (PARTITION BY event_id % 5000 ORDER BY event_id DESC) AS rn FROM events WHERE 'P' || (event_id % 7) IN (SELECT category FROM v))
SELECT e.id, coalesce(a.category, 'other') AS category FROM episodes e LEFT JOIN a ON a.id = e.id AND a.rn = 1""")  # fmt: skip
def cls1(t: Tables):
    valid = F.broadcast(t.spark.createDataFrame([(f"P{i}",) for i in range(1, 5)], "category string"))
    said = t.raw("events").select((F.col("event_id") % 5000).alias("id"), F.concat(F.lit("P"), F.col("event_id") % 7).alias("category"), "event_id")
    last = R.distinct_on(said.join(valid, "category", "left_semi"), ["id"], [F.desc("event_id")]).select("id", "category")
    return t.episodes.select("id").join(last, "id", "left").select("id", F.coalesce("category", F.lit("other")).alias("category"))
