"""Text jobs over landed documents, pages and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import notes as N
from tesserae.functions import predicates as P
from tesserae.functions import text as X
from tesserae.operators import pages as G
from tesserae.operators import relational as R
from tesserae.plans.registry import query
from tesserae.sources.tables import HOST, Tables

FOLD = "strip_accents(lower({}))"


@query("TXT1", rf"SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS k FROM documents")
def txt1(t: Tables):
    return t.documents.select("doc_id", P.name_key(F.col("text")).alias("k"))


@query("TXT2", rf"SELECT doc_id, substr(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 20) AS slug FROM documents")
def txt2(t: Tables):
    return t.documents.select("doc_id", P.slug(F.col("text"), 20).alias("slug"))


@query("TXT3", rf"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +', ' ', 'g')) AS k FROM documents")
def txt3(t: Tables):
    return t.documents.select("doc_id", P.verbatim_key(F.col("text")).alias("k"))


#: ``html_to_text`` of the column ``html``.
PLAIN = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'))"""


@query("TXT4", f"SELECT page_id, {PLAIN} AS text FROM pages")
def txt4(t: Tables):
    return t.pages.select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("TXT5", """SELECT conv_id, turn, v, CASE WHEN turn % 3 = 0 THEN conv_id WHEN turn % 3 = 1 THEN (conv_id % 60) * 60 + turn ELSE (conv_id % 10) * 3600 + turn * 60 + 5 END AS seconds
 FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN conv_id::VARCHAR WHEN turn % 3 = 1 THEN (conv_id % 60) || ':' || turn ELSE (conv_id % 10) || ':' || turn || ':05' END AS v FROM conversations)""")  # fmt: skip
def txt5(t: Tables):
    c, k = F.col("conv_id"), F.col("turn")
    v = F.when(k % 3 == 0, c.cast("string")).when(k % 3 == 1, F.concat(c % 60, F.lit(":"), k)).otherwise(F.concat(c % 10, F.lit(":"), k, F.lit(":05")))
    return t.raw("conversations").select("conv_id", "turn", v.alias("v"), X.parse_duration(v).alias("seconds"))


#: What pages get at their end, since they name few addresses: an address with dot segments, a link one folder up, one to another host, and a bare address.
NOTE = ["<p>See <a href='https://Out.example/a/./b/../", "page_id", "?q=1#f'>Reference ", "page_id", "</a>, <a href=\"../up/", "page_id", "\">Episode #", "page_id % 350 + 1", "</a>, <a href='//c.example'>Cdn</a>, <a href='?p=2'>Next</a>, <a href='mailto:a@b.example'>Mail</a> and https://bare.example/", "page_id", ".</p>"]
NOTED = "html || " + " || ".join(f"({x})::VARCHAR" if x.startswith("page_id") else "'" + x.replace("'", "''") + "'" for x in NOTE)


def noted_pages(t: Tables):
    """Pages with ``NOTE`` at their end."""
    return t.pages.withColumn("html", F.concat("html", *(F.expr(x).cast("string") if x.startswith("page_id") else F.lit(x) for x in NOTE)))


def page_links(t: Tables):
    """Links of all pages to the web, resolved, in order."""
    return noted_pages(t).select("page_id", "url", F.posexplode(X.web_links(F.col("html"), F.col("url"))).alias("i", "a")).select("page_id", "url", (F.col("i") + 1).alias("i"), "a.href", "a.label")


ANCHORS = X.ANCHOR.replace("'", "''")
ROOT, PATH = "regexp_extract({u}, '(?i)^[a-z]+://[^/?#]*')", "regexp_extract({u}, '(?i)^[a-z]+://[^/?#]*([^?#]*)', 1)"
#: A web address of ``{h}`` on the page ``url``; and the same with its dot segments folded, from ``whole``.
WHOLE = f"""CASE WHEN {{h}} = '' OR {{h}}[1] = '#' THEN NULL WHEN regexp_matches({{h}}, '(?i)^https?://') THEN {{h}} WHEN regexp_matches({{h}}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN {{h}}[1:2] = '//' THEN string_split(url, '//')[1] || {{h}}
 WHEN {{h}}[1] = '/' THEN {ROOT.format(u='url')} || {{h}} WHEN {{h}}[1] = '?' THEN {ROOT.format(u='url')} || {PATH.format(u='url')} || {{h}} ELSE {ROOT.format(u='url')} || CASE WHEN {PATH.format(u='url')} = '' THEN '/' ELSE regexp_replace({PATH.format(u='url')}, '[^/]*$', '') END || {{h}} END"""
SEGMENTS = f"string_split(regexp_replace({PATH.format(u='whole')}, '^/', ''), '/')"
FOLDED = f"""CASE WHEN whole IS NOT NULL THEN lower({ROOT.format(u='whole')}) || '/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(CASE WHEN {SEGMENTS}[-1] IN ('.', '..') THEN list_append({SEGMENTS}, '') ELSE {SEGMENTS} END, lambda x: [x])),
 lambda kept, s: CASE WHEN s[1] = '.' THEN kept WHEN s[1] = '..' THEN kept[:-2] ELSE list_concat(kept, s) END), '/') || regexp_extract(whole, '(?i)^[a-z]+://[^/?#]*[^?#]*(.*)$', 1) END"""
LINKS = f"""WITH np AS (SELECT page_id, url, {NOTED} AS html FROM pages), ra AS (SELECT page_id, url, generate_subscripts(h, 1) AS i, trim(unnest(h)) AS raw, unnest(x) AS html FROM (SELECT page_id, url, regexp_extract_all(html, '{ANCHORS}', 1) AS h, regexp_extract_all(html, '{ANCHORS}', 2) AS x FROM np)),
a AS (SELECT page_id, url, i, html, {FOLDED} AS href FROM (SELECT *, {WHOLE.format(h='raw')} AS whole FROM ra)),
b AS (SELECT page_id, url, generate_subscripts(h, 1) + 1000000 AS i, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all({PLAIN}, '{X.BARE_URL.replace("'", "''")}') AS h FROM np)),
page_links AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS i, href, label FROM (SELECT page_id, url, i, href, nullif(substr({PLAIN}, 1, 200), '') AS label FROM a WHERE href IS NOT NULL UNION ALL SELECT page_id, url, i, href, NULL FROM b))"""


@query("TXT6", f"{LINKS} SELECT page_id, href, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY i) AS rn FROM page_links) WHERE rn = 1")
def txt6(t: Tables):
    first = R.distinct_on(page_links(t).withColumn("k", F.lower("href")), ["page_id", "k"], [F.asc("i")])
    return first.select("page_id", "href", "label")


KIND = """CASE WHEN coalesce(url, '') = '' THEN 'other' WHEN contains(h, 'profiles.example') THEN 'profile' WHEN contains(h, 'social.example') OR contains(h, 'video.example') THEN 'social' WHEN regexp_matches(url, '(?i)[.](mp3|m4a|wav|ogg)([?]|$)') THEN 'audio' WHEN contains(h, 'audio.example') OR contains(h, 'cast.example') THEN 'cross_ref'
 WHEN contains(h, 'brand1.') OR contains(h, 'brand2.') OR contains(h, 'tool.example') THEN 'tool' WHEN h = 'cat.example.com' AND p NOT IN ('', '/') AND NOT regexp_matches(p, '^/(about|contact|privacy|terms|tag|category|search|login|feed)\\b') THEN 'episode_ref' WHEN regexp_matches(url, '^https?://[^/]+/?$') THEN 'company' ELSE 'resource' END""".replace("\\\\", "\\")
PARTS = r"SELECT *, regexp_replace(url, '^https?://(www[.])?([^/]+).*', '\2') AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM links"


@query("TXT7", f"SELECT id, {KIND} AS kind FROM ({PARTS})")
def txt7(t: Tables):
    return t.links.select("id", X.classify_url(F.col("url"), HOST).alias("kind"))


@query("TXT8", f"SELECT id, CASE WHEN h <> 'cat.example.com' THEN 'host' WHEN p IN ('', '/') THEN 'root' WHEN regexp_matches(p, '^/(about|contact|privacy|terms|tag|category|search|login|feed)\\b') THEN 'utility' ELSE 'match' END AS reason FROM ({PARTS})")
def txt8(t: Tables):
    return t.links.select("id", X.episode_ref_reason(F.col("url"), HOST).alias("reason"))


@query("TXT9", f"SELECT id, contains(h, 'brand1.') OR contains(h, 'brand2.') OR contains(h, 'tool.example') AS is_tool FROM ({PARTS})")
def txt9(t: Tables):
    parts = dict(X.HOST_KINDS)["tool"]
    return t.links.select("id", P.any_of([F.contains(P.host_of(F.col("url")), F.lit(p)) for p in parts]).alias("is_tool"))


HEADS = "SELECT source_id, list(start_s::BIGINT || ':' || rtrim(substr(replace(text, chr(10), ' '), 1, 30), '.,;:') ORDER BY idx) AS chapters FROM segments WHERE trim(substr(replace(text, chr(10), ' '), 1, 30)) = substr(replace(text, chr(10), ' '), 1, 30) AND length(text) > 30 GROUP BY 1"


@query("TXT10", f"""SELECT source_id, 'About number ' || source_id AS topic, 'Guest ' || source_id || ' speaks' AS guest, ['first item, on two lines', 'second ' || source_id] AS items, ['Book ' || source_id || '=https://b.example/' || source_id, 'A paper='] AS refs, ['12:Old one', (source_id % 900 + 20) || ':Other'] AS episodes,
 'ABC' || source_id AS code, 'https://p.example/' || source_id AS promo_url, 'Firm Nord' AS partner, chapters, 'https://video.example/v' || source_id AS video FROM ({HEADS})""")
def txt10(t: Tables):
    """Descriptions of all blocks are written from transcripts, with their chapter lines, and parsed back."""
    title = F.substring(F.regexp_replace("text", "\n", " "), 1, 30)
    rows = t.segments.filter((F.trim(title) == title) & (F.length("text") > 30)).select("source_id", "idx", F.concat(X.to_hms(F.col("start_s")), F.lit(" - "), title).alias("line"))
    lines = rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    i = F.col("source_id")
    parts = [
        "Le sujet : About number ", i, "\nL’invité du jour : Guest ", i, " speaks\nDécouvrez :\n- first item,\non two lines\n- second ", i, "\nRéférences :\n- Book ", i, " : https://b.example/", i, "\n- A paper\nAinsi que d'anciens épisodes :\n#12 - Old one\n#", i % 900 + 20,
        " - Other.\nAvantages : code promo abc", i, " chez Firm Nord pour tous https://p.example/", i, "\nChapitres :\n", F.col("lines"), "\nHébergé par X https://video.example/v", i,
    ]
    found = lines.select("source_id", N.description_blocks(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).alias("d")).select("source_id", "d.*")
    pair = lambda a, b, sep: lambda x: F.concat(x[a], F.lit(sep), F.coalesce(x[b].cast("string"), F.lit("")))
    return found.select(
        "source_id", "topic", "guest", "items", F.transform("references", pair("label", "url", "=")).alias("refs"), F.transform("episodes", pair("number", "title", ":")).alias("episodes"), F.col("promo.code").alias("code"), F.col("promo.url").alias("promo_url"),
        F.col("promo.partner").alias("partner"), F.transform("chapters", pair("seconds", "title", ":")).alias("chapters"), "video",
    )


@query("TXT11")
def txt11(t: Tables):
    return t.episodes.select("id", N.guest_from_title(F.col("title")).alias("g")).select("id", "g.name", "g.company", "g.role")


FIRM = "'Firm' || regexp_extract(url, '//(?:www[.]|m[.]|blog[.])?([a-z]+)', 1)"


@query("TXT12", f"""WITH f AS (SELECT page_id, url, {FIRM} AS firm FROM pages) SELECT page_id, lower(firm) AS sponsor, url AS context FROM f UNION ALL SELECT page_id, 'two de trois', 'shop.example/x' FROM f
 UNION ALL SELECT page_id, lower(firm) || ' nord', 'Bonjour. Brought to you by ' || firm || ' Nord, enjoy. Un grand merci à nos sponsors : ' || substr(firm || ' : ' || url || ' ', 1, 60 - length(', enjoy. Un grand merci à nos sponsors : ')) FROM f""")
def txt12(t: Tables):
    """Notes written from the pages' addresses: a list of sponsors with its end, and a name after a phrase."""
    firm = F.concat(F.lit("Firm"), F.regexp_extract("url", r"//(?:www[.]|m[.]|blog[.])?([a-z]+)", 1))
    parts = ["Bonjour. Brought to you by ", firm, " Nord, enjoy. Un grand merci à nos sponsors : ", firm, " : ", F.col("url"), " Two de Trois : shop.example/x then small : http://no.example Vous souhaitez sponsoriser Late : http://late.example"]
    notes = t.pages.select("page_id", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("text"))
    return notes.select("page_id", F.explode(N.sponsors(F.col("text"))).alias("s")).select("page_id", F.lower("s.name").alias("sponsor"), "s.context")


@query("TXT13", "SELECT d.doc_id, r.name FROM documents d JOIN (VALUES ('einung'), ('desen'), ('para la')) r(name) ON contains(strip_accents(lower(d.text)), r.name)")
def txt13(t: Tables):
    names = t.spark.createDataFrame([("einung",), ("desen",), ("para la",)], "name string")
    return t.documents.withColumn("k", P.folded(F.lower("text"))).join(F.broadcast(names), F.contains("k", "name")).select("doc_id", "name")


@query("TXT14", r"SELECT DISTINCT doc_id, lower(m) AS contact, CASE WHEN contains(m, '@') THEN 'email' ELSE 'phone' END AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._-]+@[a-zA-Z0-9-]+[.][a-z]+|\+[0-9]+ \([0-9]+\) [0-9-]+')) AS m FROM documents)")
def txt14(t: Tables):
    found = F.regexp_extract_all("text", F.lit(r"[a-zA-Z0-9._-]+@[a-zA-Z0-9-]+[.][a-z]+|\+[0-9]+ \([0-9]+\) [0-9-]+"), F.lit(0))
    m = F.col("m")
    return t.documents.select("doc_id", F.explode(found).alias("m")).select("doc_id", F.lower(m).alias("contact"), F.when(F.contains(m, F.lit("@")), "email").otherwise("phone").alias("kind")).distinct()


@query("TXT17", r"""SELECT id, CASE WHEN regexp_matches(lower(title), '\b(extrait|extract)\b') THEN 'extract' WHEN regexp_matches(lower(title), '^#?[0-9]+') THEN 'full' ELSE 'unknown' END AS kind FROM episodes""")
def txt17(t: Tables):
    return t.episodes.select("id", X.editorial_type(F.col("title")).alias("kind"))


@query("TXT18", "SELECT id, list_filter(['building', 'machinery', 'household', 'auto'], lambda k: contains(lower(title), k)) AS tags, 'y' || year(date_created) AS year_tag FROM episodes")
def txt18(t: Tables):
    words = F.array(*(F.lit(k) for k in ("building", "machinery", "household", "auto")))
    return t.episodes.select("id", F.array_distinct(F.filter(words, lambda k: F.contains(F.lower("title"), k))).alias("tags"), F.concat(F.lit("y"), F.year("date_created")).alias("year_tag"))


@query("TXT19", "SELECT DISTINCT e.id, r.theme FROM episodes e JOIN (VALUES ('P1', 'build', 'homes'), ('P1', 'machin', 'industry'), ('P2', 'auto', 'cars'), ('P3', 'house', 'homes')) r(pillar, word, theme) ON r.pillar = e.pillar AND contains(lower(e.title), r.word)")
def txt19(t: Tables):
    rules = t.spark.createDataFrame([("P1", "build", "homes"), ("P1", "machin", "industry"), ("P2", "auto", "cars"), ("P3", "house", "homes")], "pillar string, word string, theme string")
    return t.episodes.join(F.broadcast(rules), "pillar").filter(F.contains(F.lower("title"), F.col("word"))).select("id", "theme").distinct()


@query("TXT20")
def txt20(t: Tables):
    """The text of a source cut at the first words of its turns, each cut sought after the last; word counts of the parts."""
    src = t.segments.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("s"))
    titles = F.transform("s.text", lambda x: F.substring(x, 1, 25))
    start = F.struct(F.array_join("s.text", "\n").alias("rest"), F.array().cast("array<struct<title:string,words:int>>").alias("out"), F.lit(None).cast("string").alias("open"))

    def words(x):
        return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))

    def step(acc, title):
        at = F.instr(acc["rest"], title)
        done = F.when(acc["open"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(acc["open"].alias("title"), words(F.substring(acc["rest"], F.lit(1), at - 1)).alias("words"))))
        return F.when(at > 0, F.struct(F.substring(acc["rest"], at + F.length(title), F.lit(10_000_000)).alias("rest"), done.alias("out"), title.alias("open"))).otherwise(acc)

    end = F.aggregate(titles, start, step, lambda acc: F.array_append(acc["out"], F.struct(acc["open"].alias("title"), words(acc["rest"]).alias("words"))))
    return src.select("source_id", F.posexplode(end).alias("i", "c")).select("source_id", "i", "c.title", "c.words")


#: Pages of three forms: an article around another and an excluded part, one without an article, one as it is.
FORMED = "CASE page_id % 3 WHEN 0 THEN replace(html, '<article>', '<article><article><p>Inner ' || page_id || '</p></article><aside class=\"box\"><div><a href=\"/aside\">Aside</a></div></aside>') WHEN 1 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>') ELSE html END"
MAIN_ROOTS, LEFT_OUT = ["article", "main"], ["nav", "aside", "footer", ".ad"]
#: Tokens, start tags with their ends found by counting levels, main elements, and the texts left of them.
MAIN = f"""WITH pg AS (SELECT page_id, url, {FORMED} AS html FROM pages), tk AS (SELECT page_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS tok FROM (SELECT page_id, regexp_extract_all(html, '{{token}}') AS w FROM pg)),
nm AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, starts_with(tok, '</') AS closes, CASE WHEN tok[1] = '<' THEN 0 ELSE length(trim(regexp_replace(tok, '\\s+', ' ', 'g'))) END AS n FROM tk),
ev AS (SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY pos) AS run FROM nm WHERE name NOT IN ('', {{void}}) AND NOT ends_with(tok, '/>')),
el AS (SELECT o.page_id, o.name, o.tok, o.pos AS pre, (SELECT min(c.pos) FROM ev c WHERE c.page_id = o.page_id AND c.name = o.name AND c.pos > o.pos AND (o.name IN ('a', 'p') OR c.closes AND c.run = o.run - 1)) AS post FROM ev o WHERE NOT closes),
pa AS (SELECT p.page_id, p.pre, max(e.pre) AS parent FROM el p JOIN el e ON e.page_id = p.page_id AND e.name NOT IN ('a', 'p') AND p.pre > e.pre AND p.pre < e.post WHERE p.name = 'p' GROUP BY 1, 2),
mp AS (SELECT pa.page_id, parent AS pre, e.post, min(pa.pre) AS first, (SELECT count(*) FROM el p WHERE p.page_id = pa.page_id AND p.name = 'p' AND p.pre > pa.parent AND p.pre < e.post) AS k FROM pa JOIN el e ON e.page_id = pa.page_id AND e.pre = pa.parent GROUP BY pa.page_id, parent, e.post),
fr AS (SELECT page_id, name, min(pre) AS pre FROM el WHERE name IN ('article', 'main') GROUP BY 1, 2), big AS (SELECT f.page_id, f.name, f.pre, coalesce(e.post, 1000000000) AS post FROM fr f JOIN el e ON e.page_id = f.page_id AND e.pre = f.pre WHERE (SELECT sum(n) FROM nm WHERE nm.page_id = f.page_id AND nm.pos > f.pre AND nm.pos < coalesce(e.post, 1000000000)) > 400),
ro AS (SELECT page_id, coalesce(a.pre, m.pre, b.pre) AS pre, coalesce(a.post, m.post, b.post) AS post FROM pg LEFT JOIN (SELECT * FROM big WHERE name = 'article') a USING (page_id) LEFT JOIN (SELECT * FROM big WHERE name = 'main') m USING (page_id) LEFT JOIN (SELECT page_id, arg_min(pre, (-k, first)) AS pre, arg_min(post, (-k, first)) AS post FROM mp WHERE k >= 3 GROUP BY 1) b USING (page_id)),
ex AS (SELECT e.page_id, e.pre, coalesce(e.post, 1000000000) AS post FROM el e JOIN ro r ON r.page_id = e.page_id AND e.pre > r.pre AND e.pre < r.post WHERE e.name IN ('nav', 'aside', 'footer') OR regexp_matches(e.tok, 'class="ad"')),
ct AS (SELECT r.page_id, coalesce(string_agg(tok, '' ORDER BY pos), '') AS html FROM ro r LEFT JOIN nm t ON t.page_id = r.page_id AND t.pos > r.pre AND t.pos < r.post AND NOT regexp_matches(tok, '^<(!--|script|style)') AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.page_id = t.page_id AND t.pos BETWEEN ex.pre AND ex.post) WHERE r.pre IS NOT NULL GROUP BY 1),
p AS (SELECT page_id, url, c.html AS whole_html, {PLAIN.replace("(html,", "(c.html,")} AS words FROM pg LEFT JOIN ct c USING (page_id)), r AS (SELECT page_id, url, whole_html, words, CASE WHEN length(words) >= 400 THEN whole_html END AS root FROM p)""".replace("{token}", G.TOKEN.replace("'", "''")).replace("{void}", ", ".join(f"'{v}'" for v in G.VOID))


@query("TXT21", MAIN + f""", a AS (SELECT page_id, url, generate_subscripts(h, 1) AS i, trim(unnest(h)) AS href, unnest(x) AS html FROM (SELECT page_id, url, regexp_extract_all(root, '{ANCHORS}', 1) AS h, regexp_extract_all(root, '{ANCHORS}', 2) AS x FROM r)),
l AS (SELECT page_id, i, {FOLDED} AS target, coalesce(substr({PLAIN}, 1, 500), '') AS label FROM (SELECT *, {WHOLE.format(h='href')} AS whole FROM a)), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY i) AS rn FROM l WHERE target IS NOT NULL),
c AS (SELECT page_id, string_agg({PLAIN}, ' / ' ORDER BY i) AS chapters FROM (SELECT page_id, generate_subscripts(h, 1) AS i, unnest(h) AS html FROM (SELECT page_id, regexp_extract_all(root, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1) AS h FROM r)) WHERE {PLAIN} <> '' GROUP BY 1)
SELECT r.page_id, words, coalesce(c.chapters, '') AS chapters, coalesce((SELECT string_agg(target || ' ' || label, ' / ' ORDER BY i) FROM f WHERE f.page_id = r.page_id AND rn = 1), '') AS links FROM r LEFT JOIN c ON c.page_id = r.page_id""")
def txt21(t: Tables):
    """The main element of a page without its excluded parts: text, headings, and links, each once; only the text where it is short."""
    formed = t.pages.withColumn("html", F.expr(FORMED)).select("page_id", "url", "html")
    found = G.main_parts(formed, "page_id", "html", MAIN_ROOTS, LEFT_OUT, 400).withColumn("words", X.html_to_text(F.col("content")))
    found = found.withColumn("root", F.when(F.length("words") >= 400, F.col("content")))
    heads = F.filter(F.transform(F.regexp_extract_all("root", F.lit("(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"), F.lit(1)), X.html_to_text), lambda h: h != "")
    links = F.transform(X.article_links(F.col("root"), F.col("url")), lambda a: F.concat_ws(" ", a["target"], a["label"]))
    return found.select("page_id", "words", *(F.coalesce(F.array_join(c, " / "), F.lit("")).alias(n) for c, n in ((heads, "chapters"), (links, "links"))))


@query("TXT22", f"SELECT id, CASE WHEN h = 'cat.example.com' THEN 'episode_ref' WHEN len(string_split(h, '.')) = 2 THEN 'company' ELSE 'resource' END AS simple, {KIND} AS kind FROM ({PARTS})")
def txt22(t: Tables):
    host = P.host_of(F.col("url"))
    simple = F.when(host == HOST, "episode_ref").when(F.size(F.split(host, "[.]")) == 2, "company").otherwise("resource")
    return t.links.select("id", simple.alias("simple"), X.classify_url(F.col("url"), HOST).alias("kind"))


@query("TXT23", f"{LINKS} SELECT page_id, raw AS href, href AS target FROM a JOIN (SELECT page_id, i, raw FROM ra) USING (page_id, i)")
def txt23(t: Tables):
    """Every anchor's address as it stands and as it is resolved."""
    rows = noted_pages(t).select("page_id", "url", F.explode(X.anchors(F.col("html"))).alias("a"))
    return rows.select("page_id", "a.href", X.absolute_url(F.col("a.href"), F.col("url")).alias("target"))


@query("TXT24", r"SELECT page_id, regexp_replace(url, '^https?://(www[.])?([^/]+).*', '\2') AS host FROM pages")
def txt24(t: Tables):
    return t.pages.select("page_id", P.host_of(F.col("url")).alias("host"))


@query("TXT25", r"""WITH c AS (SELECT doc_id, substr(trim(regexp_replace(substr(text, strpos(lower(text), 'the') + 3), '\s+', ' ', 'g')), 1, 500) AS c FROM documents WHERE strpos(lower(text), 'the') > 0),
b AS (SELECT doc_id, CASE WHEN length(regexp_extract(c, '^(.*[.!?]) ', 1)) > 200 THEN regexp_extract(c, '^(.*[.!?]) ', 1) ELSE c END AS bio FROM c) SELECT doc_id, bio FROM b WHERE length(bio) >= 60""")  # fmt: skip
def txt25(t: Tables):
    return t.documents.select("doc_id", X.bio_chunk(F.col("text"), "the").alias("bio")).filter("bio is not null")


@query("TXT26", r"SELECT id, CASE WHEN regexp_matches(n, '^[\[(#]') OR length(n) < 3 OR NOT regexp_matches(n, '^[A-Z]') THEN NULL ELSE n END AS name FROM (SELECT id, trim(regexp_replace(title, '^#[0-9]+ *-? *', '')) AS n FROM episodes)")
def txt26(t: Tables):
    n = F.trim(F.regexp_replace("title", "^#[0-9]+ *-? *", ""))
    return t.episodes.select("id", F.when(n.rlike(r"^[\[(#]") | (F.length(n) < 3) | ~n.rlike("^[A-Z]"), None).otherwise(n).alias("name"))


@query("TXT27", "SELECT id, lower(regexp_extract(linkedin_url, '/in/([^/?#]+)', 1)) AS slug FROM guests WHERE linkedin_url IS NOT NULL")
def txt27(t: Tables):
    raw = F.regexp_extract("linkedin_url", "/in/([^/?#]+)", 1)
    return t.guests.filter("linkedin_url is not null").select("id", F.lower(F.coalesce(F.try_url_decode(raw), raw)).alias("slug"))


@query("TXT28", "SELECT id, list_sort(list_distinct([array_to_string(p, ''), array_to_string(p, '-'), array_to_string(p, '.'), p[1][1] || array_to_string(p[2:], '')])) AS variants FROM (SELECT id, string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), '-') AS p FROM guests)")
def txt28(t: Tables):
    return t.guests.select("id", F.array_sort(X.slug_variants(F.col("name"))).alias("variants"))


@query("TXT29", r"""SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?(?: ?(?:%|k|kg|km|min|h))?')), lambda n: NOT contains(substr(text, 1, 400), n) AND NOT contains(replace(substr(text, 1, 400), ' ', ''), replace(n, ' ', '')))) AS missing FROM documents""")
def txt29(t: Tables):
    return t.documents.select("doc_id", F.array_sort(X.missing_numbers(F.col("text"), F.substring("text", 1, 400))).alias("missing"))


@query("TXT30", "SELECT d.doc_id, r.phrase FROM documents d JOIN (VALUES ('clown'), ('idiot'), ('of the')) r(phrase) ON contains(lower(d.text), r.phrase)")
def txt30(t: Tables):
    phrases = t.spark.createDataFrame([("clown",), ("idiot",), ("of the",)], "phrase string")
    return t.documents.join(F.broadcast(phrases), F.contains(F.lower("text"), F.col("phrase"))).select("doc_id", "phrase")


@query("TXT31", rf"SELECT substr(sha256(lower(trim(text))), 1, 32) AS k, count(*) AS n FROM documents GROUP BY 1")
def txt31(t: Tables):
    return t.documents.groupBy(F.substring(F.sha2(F.lower(F.trim(F.col("text"))), 256), 1, 32).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("TXT32", "SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events")
def txt32(t: Tables):
    wrapped = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t.raw("events").select("event_id", X.loose_json(wrapped, "k int")["k"].alias("k"))


@query("TXT33", "SELECT id, lpad((duration_seconds // 3600)::VARCHAR, 2, '0') || ':' || lpad((duration_seconds // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((duration_seconds % 60)::VARCHAR, 2, '0') AS hms, duration_seconds::BIGINT AS seconds FROM episodes")
def txt33(t: Tables):
    hms = X.to_hms(F.col("duration_seconds"))
    return t.episodes.select("id", hms.alias("hms"), X.parse_duration(hms).alias("seconds"))


@query("TXT34", "SELECT id, list_sort(list_distinct([s, substr(s, 1, 20), regexp_replace(s, '^(the|le|la|les)-', ''), regexp_replace(s, '-(of|about|the|de)-', '-', 'g')])) AS variants FROM (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM episodes)")
def txt34(t: Tables):
    s = P.slug(F.col("title"), 500)
    variants = F.array(s, F.substring(s, 1, 20), F.regexp_replace(s, "^(the|le|la|les)-", ""), F.regexp_replace(s, "-(of|about|the|de)-", "-"))
    return t.episodes.select("id", F.array_sort(F.array_distinct(variants)).alias("variants"))


@query("TXT35", "SELECT id, CASE difficulty WHEN 'F' THEN 'beginner' WHEN 'O' THEN 'expert' WHEN 'P' THEN 'middle' END AS level, date_created::DATE AS day FROM episodes")
def txt35(t: Tables):
    text = F.when(F.col("id") % 2 == 0, F.date_format("date_created", "dd.MM.yyyy")).otherwise(F.date_format("date_created", "yyyy-MM-dd"))
    levels = F.create_map(*(F.lit(x) for x in ("F", "beginner", "O", "expert", "P", "middle")))
    day = F.coalesce(F.try_to_timestamp(text, F.lit("dd.MM.yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")
    return t.episodes.select("id", F.when(F.col("difficulty").isNotNull(), levels[F.col("difficulty")]).alias("level"), day.alias("day"))


DENIED = ["http", "€", "cookie", "podcast", "apple", "spotify"]
INSIDE = "regexp_extract_all(html, '(?is)<(?:b|strong)>(.*?)</(?:b|strong)>', 1)"


@query("TXT36", LINKS + f""", k AS (SELECT page_id, list_filter(list_transform({INSIDE}, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'))), lambda x: length(x) BETWEEN 21 AND 199 AND len(list_filter({DENIED}, lambda d: contains(lower(x), d))) = 0) AS b FROM np),
f AS (SELECT page_id, i, href, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM page_links WHERE length(label) BETWEEN 4 AND 99 AND NOT contains(href, 'example.com')),
m AS (SELECT page_id, list(n ORDER BY i) AS numbers FROM (SELECT page_id, n, min(i) AS i FROM (SELECT page_id, i, try_cast(nullif(regexp_extract(label, '#([0-9]{{1,3}})', 1), '') AS INT) AS n FROM page_links WHERE regexp_replace(href, '^https?://(www[.])?([^/]+).*', '\\2') = regexp_replace(url, '^https?://(www[.])?([^/]+).*', '\\2')) WHERE n BETWEEN 1 AND 350 GROUP BY 1, 2) GROUP BY 1)
SELECT p.page_id, list_filter(b, lambda x, i: list_position(b, x) = i)[1:10] AS takeaways, (SELECT string_agg(href, ' ' ORDER BY i) FROM f WHERE f.page_id = p.page_id AND rn <= 15) AS refs, coalesce(m.numbers, []) AS numbers,
 try_cast(replace(regexp_extract(html, '([0-9]+(?:[.,][0-9]+)?)\\s*/\\s*5', 1), ',', '.') AS DOUBLE) AS rating, list_filter(['then', 'und der', 'que la'], lambda s: contains(html, s))[1] AS sponsor FROM np p JOIN k ON k.page_id = p.page_id LEFT JOIN m ON m.page_id = p.page_id""")
def txt36(t: Tables):
    """Facts of pages: bold phrases, item numbers in own links, outside references with a label, a rating of five, the first known sponsor in the text."""
    html, links = F.col("html"), F.col("links")
    rows = noted_pages(t).withColumn("links", X.web_links(html, F.col("url")))
    facts = rows.select("page_id", X.bold_phrases(html, DENIED).alias("takeaways"), X.rating(html).alias("rating"), X.first_known(html, ["then", "und der", "que la"]).alias("sponsor"), X.outside_links(links, ["example.com"]).alias("out"), X.linked_numbers(links, P.host_of(F.col("url"))).alias("numbers"))
    return facts.select("page_id", "takeaways", F.nullif(F.array_join(F.transform("out", lambda x: x["href"]), " "), F.lit("")).alias("refs"), "numbers", "rating", "sponsor")


@query("TXT37", "SELECT source_id, string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY idx) AS article FROM segments GROUP BY 1")
def txt37(t: Tables):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "role", "text"))), lambda s: F.concat(F.lit("## "), s["role"], F.lit("\n"), s["text"]))
    return t.segments.groupBy("source_id").agg(F.array_join(parts, "\n\n").alias("article"))


@query("TXT38", r"""WITH b AS (SELECT id, title, string_split(regexp_replace(title, '^#?[0-9]+ *[-:.] *', ''), ' - ') AS p FROM episodes)
SELECT id, CASE WHEN len(p) > 1 AND length(p[-1]) < 50 AND NOT regexp_matches(p[-1], '[?!]') THEN array_to_string(p[:-2], ' - ') ELSE array_to_string(p, ' - ') END AS clean, regexp_extract(title, '^#?([0-9]{1,9})', 1)::BIGINT AS number FROM b""")  # fmt: skip
def txt38(t: Tables):
    return t.episodes.select("id", X.clean_title(F.col("title")).alias("clean"), X.title_number(F.col("title")).alias("number"))
