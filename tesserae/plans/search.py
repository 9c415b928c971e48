"""Vector and trigram search, fusion, recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import density as D
from tesserae.operators import measures as M
from tesserae.operators import people as E
from tesserae.operators import relational as R
from tesserae.operators import search as S
from tesserae.plans.registry import query
from tesserae.plans.streams import saver
from tesserae.sources.tables import Tables

COS = "round(list_cosine_similarity(a.v, b.v), 6)"
SEM = f"SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (SELECT a.id AS query_id, b.id, {COS} AS score FROM vectors a JOIN vectors b ON a.tenant = b.tenant AND a.id <> b.id WHERE a.id % 50 = 0)"
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
QUERIES = "(VALUES (1, 'customer 123 building'), (2, 'about machinery'), (3, 'extrait 12')) q(query_id, query)"
LEX = f"""SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (SELECT query_id, id, greatest({", ".join(f"CASE WHEN len(list_intersect(q, {x})) > 0 THEN round(len(list_intersect(q, {x})) / (len(q) + len({x}) - len(list_intersect(q, {x})))::DOUBLE, 6) END" for x in "abc")}) AS score
 FROM (SELECT query_id, {GRAMS.format("query")} AS q FROM {QUERIES}) JOIN (SELECT e.id, {GRAMS.format("title")} AS a, {GRAMS.format("coalesce(array_to_string(n.tags, ' '), '')")} AS b, {GRAMS.format("coalesce(guest, '')")} AS c FROM episodes e LEFT JOIN enrichment n ON n.episode_id = e.id) ON true) WHERE score > 0.1"""


def query_vectors(t: Tables):
    """Every fiftieth vector as a query."""
    return t.vectors.filter("id % 50 = 0").withColumnRenamed("id", "query_id")


def query_texts(t: Tables):
    return t.spark.createDataFrame([(1, "customer 123 building"), (2, "about machinery"), (3, "extrait 12")], "query_id int, query string")


def searched(t: Tables):
    """Items with the three texts that the lexical leg looks into; tags stand for the abstract."""
    tags = t.enrichment.select(F.col("episode_id").alias("id"), F.array_join("tags", " ").alias("abstract"))
    return t.episodes.select("id", "title", "guest").join(tags, "id", "left")


LOOKED_AT = ["title", "abstract", "guest"]


@query("VEC1", f"SELECT * FROM ({SEM}) WHERE rank <= 20")
def vec1(t: Tables):
    return S.cosine_top_k(query_vectors(t), t.vectors, 20)


@query("VEC2", f"SELECT * FROM (SELECT id, other, score, (row_number() OVER (PARTITION BY id ORDER BY score DESC, other))::INT AS rank FROM (SELECT a.id, b.id AS other, {COS} AS score FROM vectors a JOIN vectors b ON a.tenant = b.tenant AND a.id <> b.id)) WHERE rank <= 20")
def vec2(t: Tables):
    return S.all_pairs_top_k(t.vectors, 20)


@query("JON6", f"SELECT id, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rn FROM (SELECT a.id, b.id AS other, {COS} AS score FROM vectors a JOIN vectors b ON a.tenant = b.tenant AND a.id <> b.id)) WHERE rn <= 5")
def jon6(t: Tables):
    return S.all_pairs_top_k(t.vectors, 5).select("id", "other")


@query("TOP3", f"SELECT id, other, label FROM (SELECT x.id, other, e.label, row_number() OVER (PARTITION BY x.id ORDER BY score DESC, other) AS rn FROM (SELECT a.id, b.id AS other, {COS} AS score FROM vectors a JOIN vectors b ON a.tenant = b.tenant AND a.id <> b.id) x JOIN embeddings e ON e.vec_id = other) WHERE rn <= 6")
def top3(t: Tables):
    near = S.all_pairs_top_k(t.vectors, 6)
    return near.join(t.raw("embeddings").select(F.col("vec_id").alias("other"), "label"), "other").select("id", "other", "label")


@query("VEC3", f"SELECT * FROM (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (SELECT a.id AS query_id, b.id, {COS} AS score FROM vectors a JOIN vectors b ON a.tenant <> b.tenant WHERE a.id % 50 = 0)) WHERE rank <= 10")
def vec3(t: Tables):
    return S.cosine_top_k(query_vectors(t), t.vectors, 10, same_tenant=False)


@query("VEC4", f"SELECT query_id, id, score FROM ({LEX}) WHERE rank <= 30")
def vec4(t: Tables):
    """No vector for a query: the trigram leg alone answers."""
    return S.trigram_search(query_texts(t), searched(t), LOOKED_AT, 30).select("query_id", "id", "score")


@query("VEC5", """WITH d AS (SELECT a.id AS query_id, b.id, round(round(1 - round(list_cosine_similarity(a.v, b.v), 6), 6) * CASE WHEN a.tenant = b.tenant THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 6) AS adjusted FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % 50 = 0 AND b.tenant NOT IN (3, 4)),
far AS (SELECT query_id, count(*) FILTER (adjusted > 1.0) AS n_far FROM d GROUP BY 1), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted, id) AS rn FROM d WHERE adjusted <= 1.0)
SELECT q.id AS query_id, b.id, b.adjusted, (SELECT count(*) FROM vectors WHERE tenant IN (3, 4)) - (q.tenant IN (3, 4))::INT AS n_excluded, coalesce(n_far, 0)::BIGINT AS n_far FROM vectors q LEFT JOIN far f ON f.query_id = q.id LEFT JOIN best b ON b.query_id = q.id AND b.rn <= 8 WHERE q.id % 50 = 0""")  # fmt: skip
def vec5(t: Tables):
    return S.boosted(query_vectors(t), t.vectors, [3, 4], 1.0, 8)


@query("VEC6")
def vec6(t: Tables):
    """Each vector's place in the plane, its density cluster or noise, and the bands and compositions of the clusters against the labels."""
    clusters = D.density_clusters(t.vectors.select("id", "v"), saver(t))
    known = clusters.join(t.vectors.select("id", "tenant"), "id")
    top = M.composition(known, "cluster", "tenant", noise=D.NOISE).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("least"), "tenant"))).alias("top"))
    rated = M.adjusted_rand(known, "cluster", "tenant", noise=D.NOISE)
    placed = S.project(t.vectors).join(clusters, "id").join(top, "cluster", "left")
    return placed.join(F.broadcast(rated), F.lit(True)).select("id", "x", "y", "cluster", F.col("top.tenant").alias("top_labels"), "ari", "band")


@query("VEC7", """WITH l AS (SELECT episode_id, string_agg(url, ' ' ORDER BY id, url) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id, url) AS rn FROM links) WHERE rn <= 5 GROUP BY 1),
c AS (SELECT source_id, string_agg(substr(text, 1, 20), '; ' ORDER BY idx) AS chapters, string_agg(text, ' ' ORDER BY idx) AS article FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY idx) AS rn FROM segments) WHERE rn <= 8 GROUP BY 1),
b AS (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[^.\\n]{20,60}[.]'), lambda x: true)[1:5], ' / ') AS takeaways FROM documents)
SELECT e.id, concat_ws(' | ', e.title, coalesce(e.guest, ''), coalesce(c.chapters, ''), coalesce(substr(c.article, 1, 200), ''), coalesce(b.takeaways, ''), coalesce(array_to_string(x.tags[1:5], ', '), ''), coalesce(l.urls, '')) AS pack
 FROM episodes e LEFT JOIN enrichment x ON x.episode_id = e.id LEFT JOIN l ON l.episode_id = e.id LEFT JOIN c ON c.source_id = e.id // 50 LEFT JOIN b ON b.doc_id = e.id // 50 WHERE e.id % 50 = 0""".replace("\\\\", "\\"))  # fmt: skip
def vec7(t: Tables):
    """Each hit with its guest, eight chapters at most, an excerpt, takeaways, tags and links; transcripts and texts are found by a fiftieth of the id."""
    hits = t.episodes.filter("id % 50 = 0").select("id", "title", "guest", F.floor(F.col("id") / 50).alias("ref"))
    listed = lambda df, key, order, what, sep: df.groupBy(F.col(key).alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, what))), lambda x: x[what]), sep).alias("_v"))
    few = listed(R.top_n_per_group(t.links, ["episode_id"], [F.asc("id"), F.asc("url")], 5), "episode_id", "id", "url", " ").withColumnsRenamed({"_k": "id", "_v": "urls"})
    parts = R.top_n_per_group(t.segments.withColumn("head", F.substring("text", 1, 20)), ["source_id"], [F.asc("idx")], 8)
    chapters, article = (listed(parts, "source_id", "idx", what, sep).withColumnsRenamed({"_k": "ref", "_v": name}) for what, sep, name in (("head", "; ", "chapters"), ("text", " ", "article")))
    facts = t.documents.select(F.col("doc_id").alias("ref"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^.\n]{20,60}[.]"), F.lit(0)), 1, 5), " / ").alias("takeaways"))
    packed = hits.join(t.enrichment.withColumnRenamed("episode_id", "id"), "id", "left").join(few, "id", "left").join(chapters, "ref", "left").join(article, "ref", "left").join(facts, "ref", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return packed.select("id", F.concat_ws(" | ", "title", text("guest"), text("chapters"), text(F.substring("article", 1, 200)), text("takeaways"), text(F.array_join(F.slice("tags", 1, 5), ", ")), text("urls")).alias("pack"))


@query("TRG1", f"SELECT a, b, round(n / (len(x) + len(y) - n)::DOUBLE, 6) AS score FROM (SELECT a, b, x, y, len(list_intersect(x, y)) AS n FROM (SELECT p.p_partkey AS a, q.p_partkey AS b, {GRAMS.format('p.p_name')} AS x, {GRAMS.format('q.p_name')} AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1))")
def trg1(t: Tables):
    p = t.raw("part")
    pairs = p.select(F.col("p_partkey").alias("a"), S.trigrams(F.col("p_name")).alias("x"), (F.col("p_partkey") + 1).alias("b")).join(p.select(F.col("p_partkey").alias("b"), S.trigrams(F.col("p_name")).alias("y")), "b")
    return pairs.select("a", "b", S.trigram_similarity(F.col("x"), F.col("y")).alias("score"))


@query("TRG2", f"SELECT * FROM ({LEX}) WHERE rank <= 20")
def trg2(t: Tables):
    return S.trigram_search(query_texts(t), searched(t), LOOKED_AT, 20)


@query("RRF1", f"""WITH s AS (SELECT query_id // 50 AS query_id, id, rank FROM ({SEM}) WHERE rank <= 20 AND query_id // 50 BETWEEN 1 AND 3), l AS (SELECT query_id, id, rank FROM ({LEX}) WHERE rank <= 20),
f AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.id, l.id) AS id, round(coalesce(0.7::DOUBLE / (60 + s.rank), 0) + coalesce(0.3::DOUBLE / (60 + l.rank), 0), 6) AS score,
 CASE WHEN l.id IS NULL THEN 'semantic' WHEN s.id IS NULL THEN 'lexical' ELSE 'both' END AS match FROM s FULL JOIN l ON s.query_id = l.query_id AND s.id = l.id)
SELECT query_id, id, score, match FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM f) WHERE rn <= 15""")  # fmt: skip
def rrf1(t: Tables):
    sem = S.cosine_top_k(query_vectors(t), t.vectors, 20).withColumn("query_id", F.floor(F.col("query_id") / 50).cast("int"))
    sem = sem.join(query_texts(t), "query_id", "left_semi")
    lex = S.trigram_search(query_texts(t), searched(t), LOOKED_AT, 20)
    return S.rank_fusion(sem, lex, 15)


@query("RRF2", f"""WITH t AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(query)), '[^a-z0-9_]+'), lambda w: length(w) >= 3)) AS term FROM (VALUES (1, 'The that, of'), (2, 'Qué la UND 12')) q(query_id, query)),
p AS (SELECT query_id, source_id, idx, (count(*) + 2 * count(*) FILTER (contains(lower(substr(text, 1, 40)), term)))::BIGINT AS score FROM segments JOIN t ON contains(lower(substr(text, 1, 40) || ' ' || substr(text, 41)), term) GROUP BY 1, 2, 3)
SELECT query_id, source_id, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, idx) AS rn FROM p) WHERE rn = 1""")  # fmt: skip
def rrf2(t: Tables):
    """Segments as chapters: 40 characters of title, the rest as content."""
    queries = t.spark.createDataFrame([(1, "The that, of"), (2, "Qué la UND 12")], "query_id int, query string")
    parts = t.segments.select("source_id", "idx", F.substring("text", 1, 40).alias("title"), F.expr("substring(text, 41)").alias("content"))
    return S.best_part(parts, queries, "source_id", "idx", "title", "content").select("query_id", "source_id", "idx", "score")


GOALS = {"click": ["P1", "P2"], "error": ["P3"], "purchase": ["P4", "P5"], "signup": ["P2", "P6"], "view": ["P7"]}
LEVELS = ["F", "O", "P"]


@query("REC1", f"""WITH u AS (SELECT user_id, list_sort(list(DISTINCT 'P' || (event_id % 10))[1:2]) AS x, min(event_type) AS goal1, max(event_type) AS goal2, (user_id % 3)::INT AS level FROM events GROUP BY 1),
i AS (SELECT user_id, ['P' || (user_id % 10), 'P' || (user_id % 7)] AS interests, goal1, goal2, level FROM u), g AS (SELECT unnest({list(GOALS)}) AS goal, unnest({list(GOALS.values())}) AS pillars),
e AS (SELECT id, pillar, coalesce(list_position({LEVELS}, difficulty) - 1, 1) AS d, id % 4 = 0 AS path FROM episodes),
s AS (SELECT user_id, e.id, list_contains(interests, e.pillar) AS r1, d = level AS r2, d = level + 1 AS r3, d > level + 1 AS r4, coalesce(list_contains(g1.pillars, e.pillar), false) OR coalesce(list_contains(g2.pillars, e.pillar), false) AS r5, path AS r6, e.id >= 280 AS r7
 FROM i JOIN e ON true LEFT JOIN g g1 ON g1.goal = goal1 LEFT JOIN g g2 ON g2.goal = goal2),
p AS (SELECT user_id, id, 30 * r1::INT + 20 * r2::INT + 10 * r3::INT - 10 * r4::INT + 25 * r5::INT + 10 * r6::INT + 5 * r7::INT AS score,
 concat_ws(',', CASE WHEN r1 THEN 'interest' END, CASE WHEN r2 THEN 'level' WHEN r3 THEN 'next level' END, CASE WHEN r5 THEN 'goal' END, CASE WHEN r6 THEN 'path' END, CASE WHEN r7 THEN 'recent' END) AS reasons FROM s)
SELECT user_id, id, score, reasons FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rn FROM p WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_id = p.id)) WHERE rn <= 5""")  # fmt: skip
def rec1(t: Tables):
    """Users as profiles: two interests, the goals of their first and last kind of event, a level; their events name completed items."""
    u = F.col("user_id")
    events = t.raw("events")
    users = events.groupBy("user_id").agg(F.array(F.min("event_type"), F.max("event_type")).alias("goals")).select("user_id", F.array(F.concat(F.lit("P"), u % 10), F.concat(F.lit("P"), u % 7)).alias("interests"), "goals", (u % 3).cast("int").alias("level"))
    level = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.col("difficulty")), F.lit(0).cast("long")) - 1, F.lit(1).cast("long"))
    items = t.episodes.select("id", "pillar", level.cast("int").alias("level"), (F.col("id") % 4 == 0).alias("path"), (F.col("id") >= 280).alias("recent"))
    done = events.select("user_id", F.col("event_id").alias("id"))
    return E.recommend(users, items, done, GOALS, 5, saver(t))


@query("UDF2", "SELECT source_id, idx, length(text)::VARCHAR AS reply FROM segments")
def udf2(t: Tables):
    def stub(pdf):
        return pdf.assign(reply=[str(len(x or "")) for x in pdf["text"]])[["source_id", "idx", "reply"]]

    return S.map_model(t.segments.select("source_id", "idx", "text"), stub, "source_id long, idx long, reply string")
