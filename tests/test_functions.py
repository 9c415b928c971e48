"""Boundary cases of column functions and operators."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import notes as N
from tesserae.functions import predicates as P
from tesserae.functions import scoring
from tesserae.functions import text as X
from tesserae.operators import measures as M
from tesserae.operators import people as E
from tesserae.operators import relational as R
from tesserae.operators import search as S
from tesserae.operators import transcripts as T
from tesserae.operators import upsert as U
from tesserae.streaming import jobs as J


def values(spark, inputs, build):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x")).alias("y")).collect()]


def test_durations(spark):
    assert values(spark, ["75", "1:15", "01:02:03", "x", "", None, "1:2:3:4"], X.parse_duration) == [75, 75, 3723, None, None, None, None]


def test_person_names(spark):
    good = ["Ada Lovelace", "Élodie de la Tour", "Jean-Luc", "Ada Lovelace 2", "Zoomer Ada", " Ada - Lovelace ", "O'Neil Ada"]
    bad = ["ada lovelace", "Ada", "[Ada Lovelace]", "Ada: Lovelace", "A B/C", "Bonus Ada Lovelace", "12 34", "12", "Ada devenir Reine", "Ada Lovelace'", "Ada’s Engine", "A - b - c", "Ada «Lovelace»", "A" * 30 + " " + "B" * 30, "", None]
    assert values(spark, good, P.valid_person_name) == [True] * len(good)
    assert not any(values(spark, bad, P.valid_person_name))


def test_keys(spark):
    assert values(spark, ["  Éric  Dupont ", None], P.name_key) == ["eric dupont", None]
    assert values(spark, ["--Un Été à Paris!--", ""], lambda x: P.slug(x, 9)) == ["un-ete-a-", ""]
    assert values(spark, ["L’été, déjà… 42 !"], P.verbatim_key) == ["l ete deja 42"]


def test_html_to_text(spark):
    assert values(spark, ["<p>a &amp; b<br/>c</p><p>&lt;d&gt;</p>", None], X.html_to_text)[0].split("\n")[0].strip() == "a & b"


def test_links_and_classes(spark):
    urls = ["https://cat.example.com/e/1", "https://cat.example.com/", "https://cat.example.com/about", "https://www.social.example/x", "https://firm.example.org", "https://firm.example.org/a", "", None, "https://a.example/x.MP3?y", "https://cast.example/show/1", "https://a.example/?q=1"]
    assert values(spark, urls, lambda u: X.classify_url(u, "cat.example.com")) == ["episode_ref", "company", "resource", "social", "company", "resource", "other", "other", "audio", "cross_ref", "resource"]
    assert values(spark, urls[:4], lambda u: X.episode_ref_reason(u, "cat.example.com")) == ["match", "root", "utility", "host"]
    base = F.lit("https://a.example/x?y")
    assert values(spark, ["/b", "#c", "mailto:d", "http://e.example/f", "g"], lambda u: X.absolute_url(u, base)) == ["https://a.example/b", None, None, "http://e.example/f", "https://a.example/g"]


def test_addresses_are_resolved(spark):
    """As a browser resolves them: folders, dot segments, other hosts, queries; other schemes and fragments are no links."""
    cases = {
        ("../b?x", "https://a.example/x/y/z?q#f"): "https://a.example/x/b?x", ("//c.example/p", "http://a.example/x"): "http://c.example/p", ("?q=2", "https://a.example/x/y?q=1#t"): "https://a.example/x/y?q=2", ("g", "https://a.example"): "https://a.example/g",
        ("./a/../b/.", "https://a.example/x/"): "https://a.example/x/b/", ("../../../up", "https://a.example/x/y"): "https://a.example/up", ("HTTPS://A.Example", "http://b.example/"): "https://a.example/", ("http://a.example/a/./b/../c#d", "http://b.example/"): "http://a.example/a/c#d",
        ("#c", "https://a.example/"): None, ("", "https://a.example/"): None, ("mailto:x@y.example", "https://a.example/"): None, ("javascript:void(0)", "https://a.example/"): None, ("/a//b", "https://a.example/x"): "https://a.example/a//b", ("..", "https://a.example/x/y/z"): "https://a.example/x/", (" g ", "https://a.example/x/y"): "https://a.example/x/g",
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, h string, b string")
    assert [r[0] for r in df.orderBy("i").select(X.absolute_url(F.col("h"), F.col("b"))).collect()] == list(cases.values())
    page = values(spark, ["<a href='x'>#12 own</a><a href='/y'>see #400</a><a href='//c.example'>#3 other</a><a href='z'>#12 again</a>"], lambda p: X.linked_numbers(X.web_links(p, F.lit("https://a.example/d/e")), F.lit("a.example")))
    assert page == [[12]]


def test_web_links(spark):
    page = """<a class='x' href='https://a.example/1'><b>Bold</b> &amp; more</a> <a href="/local">l</a> see https://b.example/2. <a href="http://c.example"></a> (https://A.example/1)"""
    got = values(spark, [page, "", None], X.web_links)
    assert [(g["href"], g["label"]) for g in got[0]] == [("https://a.example/1", "Bold & more"), ("http://c.example", None), ("https://b.example/2", None), ("https://A.example/1", None)]
    assert got[1] == [] and values(spark, ["---\na: b\n---\nText"], X.without_front_matter) == ["Text"]


def test_titles(spark):
    assert values(spark, ["#12 - Extrait : x", "Bonus x", "12 x", "x", None], X.editorial_type) == ["extract", "bonus", "full", "unknown", "unknown"]
    assert values(spark, ["#12 - A long talk - Ada", "12. What now?", "a - what?"], X.clean_title) == ["A long talk", "What now?", "a - what?"]
    told = {
        "#3 - Ada Lovelace (Engines)": ("Ada Lovelace", "Engines", None), "Ada Lovelace (Engines) : how it began": ("Ada Lovelace", "Engines", "how it began"), "Ada Lovelace, founder": ("Ada Lovelace", None, "founder"),
        "Episode 7: Ada Lovelace, CTO at Acme": ("Ada Lovelace", "Acme", "CTO"), "#12 - Ada Lovelace - CEO de Engines Nord": ("Ada Lovelace", "Engines Nord", "CEO"), "Ada Lovelace - Engines": ("Ada Lovelace", "Engines", None),
        "[EXTRAIT] Anne de la Tour - Engines - CEO": ("Anne de la Tour", "Engines", "CEO"), "Jean-Luc Le Grand et la mer": ("Jean-Luc Le Grand", None, None), "Why not?": (None, None, None), "the sea": (None, None, None), "": (None, None, None),
        "Comment vivre ?": (None, None, None), "#1 - Combien vaut un four ? - Ada Lovelace": ("Ada Lovelace", None, None), "#2 - Combien vaut un four ? - Marine et Paul": ("Marine", None, None), "[ZOOM] Les chiffres de Ada Lovelace - ingénieure": ("Ada Lovelace", None, None),
    }
    assert {t: tuple(g) for t, g in zip(told, values(spark, list(told), N.guest_from_title), strict=True)} == told


def test_chapters(spark):
    got = values(spark, ["00:10 - Start\nwords\n01:00:05 - End", "none"], N.chapters)
    assert [[(c["seconds"], c["title"]) for c in g] for g in got] == [[(10, "Start"), (3605, "End")], []]


def test_title_forms(spark):
    """Names with small words and hyphens, firms and roles around their words, tags, topics."""
    told = {
        "#313 - Matthieu Stefani - CEO de Cosa Vostra": ("Matthieu Stefani", "Cosa Vostra", "CEO"), "#284 — Nom Prénom (Société) : titre": ("Nom Prénom", "Société", "titre"), "Sixte de Vauplane - Animaj - Refaire les dessins": ("Sixte de Vauplane", "Animaj", "Refaire les dessins"),
        "VF - Jean-Marie Le Pen": ("Jean-Marie Le Pen", None, None), "Name Last, Role of many words chez Acme Nord - titre": ("Name Last", "Acme Nord", "Role of many words"), "[BONUS] Anne d'Arc": ("Anne d'Arc", None, None), "Les Grandes Écoles": (None, None, None),
        "Combien gagne une pharmacie ? - Morgane et Benjamin": ("Morgane", None, None), "Pourquoi ? - Bob": (None, None, None), "L'argent d'Ada Lovelace": ("Ada Lovelace", None, None), "Tout savoir - le reste": (None, None, None), "Ada Lovelace – Engines – CTO from Nord": ("Ada Lovelace", "Nord", "Engines - CTO"),
    }
    assert {t: tuple(g) for t, g in zip(told, values(spark, list(told), N.guest_from_title), strict=True)} == told
    assert tuple(values(spark, [None], N.guest_from_title)[0]) == (None, None, None)


def test_sponsor_forms(spark):
    """Lists with and without end, phrases, words that are no sponsor, contexts, each name once."""
    text = {
        "Un grand merci à nos sponsors : Acme : https://acme.example/x Beta Corp : beta.example Vous souhaitez sponsoriser Late : late.example": [("Acme", "https://acme.example/x"), ("Beta Corp", "beta.example")],
        "<p>MERCI &agrave; tous</p> merci a mes partenaires - Un Deux Trois Quatre Cinq : a.example Merci : b.example petit : c.example Zed de Nord : http://z.example": [("Zed de Nord", "http://z.example")],
        "Merci à notre partenaire Nordfirm. Et la suite": [("Nordfirm", None)], "Cet épisode est sponsorisé par Acme, merci. En partenariat avec ACME": [("Acme", None)], "rien": [], "": [],
    }
    got = values(spark, [*text, None], N.sponsors)
    assert [[(s["name"], s["context"] if w[1] else None) for s, w in zip(g, want, strict=True)] for g, want in zip(got, [*text.values(), []], strict=True)] == [*text.values(), []]
    around = values(spark, ["x" * 100 + " sponsorisé par Acme! " + "y" * 100], N.sponsors)[0][0]["context"]
    assert around == "x" * 59 + " sponsorisé par Acme! " + "y" * 58


def test_description_forms(spark):
    """Lists in HTML, fallback of dashed items, chapters with every mark, offers, earlier episodes, blocks that end at others."""
    html = "<p>Le sujet : Un vrai sujet ici</p><p>L&#39;invit\u00e9 du jour : Ada Love</p>Références :<ul><li>Un livre → https://b.example/1.</li><li class='x'>Un film</li></ul>Avantage : offerts chez Nord & Co pour tous avec le code promo abc12, valable.<br>https://p.example/z<br>Chapitres :<br>- 00:20 – Next<br>00:10 : Start<br>00:10 : START.<br>1:00:05 - End;<br>Vivement Lundi présente La Suite"
    got = values(spark, [html, "Au programme : une - deux mots - trois\nTIMELINE :\n00:10", "Ainsi que d’anciens épisodes :\n#12 - Un\n# 13 : Deux.\n#12 - Encore\nHébergé par #99 - x", "voir #7 - Sept et la suite\nhttps://www.video.example/v?1.", "Bonne nouvelle ! Rien", "", None], N.description_blocks)
    one = got[0]
    assert (one["topic"], one["guest"]) == ("Un vrai sujet ici", "Ada Love") and one["cross_promo"] == "Vivement Lundi présente La Suite"
    assert [tuple(r) for r in one["references"]] == [("Un livre", "https://b.example/1"), ("Un film", None)]
    assert tuple(one["promo"]) == ("ABC12", "https://p.example/z", "Nord & Co", "offerts chez Nord & Co pour tous avec le valable")
    assert [tuple(c) for c in one["chapters"]] == [(20, "Next"), (10, "Start"), (3605, "End")]
    assert got[1]["items"] == ["une", "deux mots", "trois"] and got[1]["chapters"] == []
    assert [tuple(e) for e in got[2]["episodes"]] == [(12, "Un"), (13, "Deux")]
    assert [tuple(e) for e in got[3]["episodes"]] == [(7, "Sept et la suite")] and got[3]["video"] == "https://www.video.example/v?1"
    assert all(g["topic"] is None and g["items"] == [] and g["promo"] is None for g in got[4:])
    long = "Découvrez :\n- " + "a" * 200 + ". " + "b" * 200 + "\n• " + "c" * 300 + "\n- ok\nde plus\n\n- x"
    assert values(spark, [long], N.description_blocks)[0]["items"] == ["a" * 200 + ".", "c" * 280, "ok de plus"]


def test_trigrams(spark):
    assert values(spark, ["word"], lambda x: S.trigram_similarity(S.trigrams(x), S.trigrams(F.lit("two words")))) == [0.363636]


def test_gini_and_targets(spark):
    counts = spark.createDataFrame([("a", 1), ("a", 2), ("a", 6), ("b", 5)], "k string, n int")
    assert {r.k: round(r.gini, 5) for r in M.gini(counts, ["k"], "n").collect()} == {"a": 0.37037, "b": 0.0}
    got = U.check_targets(spark.createDataFrame([("a", 104), ("b", 120)], "k string, n int"), spark.createDataFrame([("a", 100), ("b", 100), ("c", 5)], "k string, target int"), "k")
    assert {r.k: r.ok for r in got.collect()} == {"a": True, "b": False, "c": True}


def test_empty_exclusions_keep_all(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert df.filter(P.contains_none("x", [])).count() == 2


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None), (3, "d", None)], "id int, v string, w string")
    once = U.upsert(old, new, ["id"], {"v": "keep_if_null", "w": "keep"}, [F.asc("v")])
    assert sorted(map(tuple, once.collect())) == [(1, "a", None), (2, "b", "y"), (3, "c", None)]
    assert sorted(map(tuple, U.upsert(once, new, ["id"], {"v": "keep_if_null", "w": "keep"}, [F.asc("v")]).collect())) == sorted(map(tuple, once.collect()))


def test_chunks_and_gaps(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 100.0), (1, 1, 100.0, 250.0), (1, 2, 250.0, 300.0)], "source_id int, idx long, start_s double, end_s double")
    assert [(r.lo, r.hi) for r in T.chunk_segments(seg, 240).orderBy("chunk").collect()] == [(0.0, 250.0), (250.0, 300.0)]
    n = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "k string, n int")
    assert sorted(map(tuple, R.number_gaps(n, ["k"], "n").collect())) == [("a", 2), ("a", 3)]


def saver(spark, folder):
    from itertools import count

    k = count()

    def save(df):
        path = f"{folder}/{next(k)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def test_one_to_one_consumes(spark, tmp_path):
    left = spark.createDataFrame([(1, 9, "ada-love"), (2, 9, "ada-love"), (3, 5, "bob-long"), (4, 124, "c"), (5, None, "dora-x"), (6, None, "the-inner-name"), (7, None, "zz")], "a int, number long, x string")
    right = spark.createDataFrame([(10, "ada-love"), (11, "ada-love"), (12, "bob-long-more"), (13, "124-who"), (14, "dora"), (15, "inner-name"), (16, "q")], "b int, y string")
    got = E.one_to_one(left, right, E.slug_rules(), saver(spark, str(tmp_path))).collect()
    assert sorted((r.a, r.rule) for r in got) == [(1, "exact"), (2, "exact"), (3, "begins"), (4, "number"), (5, "begun"), (6, "holds")]
    assert sorted(r.b for r in got) == [10, 11, 12, 13, 14, 15] and {r.b for r in got if r.a < 3} == {10, 11}


def test_one_to_one_leaves_no_candidate(spark, tmp_path):
    import random

    rng = random.Random(5)
    xs = ["-".join(rng.choices(["ann", "bob", "carl", "dora"], k=rng.randint(1, 3))) for _ in range(60)]
    ys = [rng.choice([f"{rng.randint(1, 80)}-", "", "", "my-"]) + "-".join(rng.choices(["ann", "bob", "carl", "dora"], k=rng.randint(1, 3))) for _ in range(50)]
    left, right = spark.createDataFrame([(i, i, x) for i, x in enumerate(xs)], "a int, number long, x string"), spark.createDataFrame(list(enumerate(ys)), "b int, y string")
    got = E.one_to_one(left, right, E.slug_rules(), saver(spark, str(tmp_path))).collect()
    fits = {
        "number": lambda a, x, y: y.split("-")[0] == str(a), "exact": lambda a, x, y: x == y, "begins": lambda a, x, y: len(x) > 3 and y.startswith(x),
        "begun": lambda a, x, y: len(y) > 3 and x.startswith(y), "holds": lambda a, x, y: min(len(x), len(y)) >= 6 and (x in y or y in x),
    }
    free_a, free_b = set(range(60)), set(range(50))
    for rule, fit in fits.items():
        mine = [(r.a, r.b) for r in got if r.rule == rule]
        assert all(fit(a, xs[a], ys[b]) for a, b in mine) and len({a for a, _ in mine}) == len({b for _, b in mine}) == len(mine)
        assert {a for a, _ in mine} <= free_a and {b for _, b in mine} <= free_b
        free_a, free_b = free_a - {a for a, _ in mine}, free_b - {b for _, b in mine}
        assert not [(a, b) for a in free_a for b in free_b if fit(a, xs[a], ys[b])]


def test_one_to_one_saves_what_is_left(spark, tmp_path):
    """No rule repeats the joins by which earlier rules used up rows."""
    plans, inner = [], saver(spark, str(tmp_path))

    def save(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return inner(df)

    left = spark.createDataFrame([(1, 7, "x"), (2, None, "bob-long"), (3, None, "dora-long")], "a int, number long, x string")
    right = spark.createDataFrame([(10, "7-who"), (11, "bob-long"), (12, "dora-long-more")], "b int, y string")
    got = E.one_to_one(left, right, E.slug_rules()[:3], save).collect()
    assert sorted(map(tuple, got)) == [(1, 10, "number"), (2, 11, "exact"), (3, 12, "begins")]
    assert max(p.count("LeftAnti") for p in plans) == 1


def test_one_to_one_joins_by_shuffle(spark, tmp_path):
    """Exploded places and grams look as small as the files they come from, so Spark would broadcast them through the driver; items meet places once for all rules of the same columns."""
    plans, inner = [], saver(spark, str(tmp_path))

    def save(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return inner(df)

    left = spark.createDataFrame([(1, 7, "x"), (2, None, "bob-long"), (3, None, "dora-long"), (4, None, "eve-long-more"), (5, None, "the-inner-name"), (6, None, "bob-long")], "a int, number long, x string")
    right = spark.createDataFrame([(10, "7-who"), (11, "bob-long"), (12, "dora-long-more"), (13, "eve-long"), (14, "inner-name"), (15, "my-bob-long")], "b int, y string")
    got = E.one_to_one(left, right, E.slug_rules(), save).collect()
    assert sorted((r.b, r.rule) for r in got) == [(10, "number"), (11, "exact"), (12, "begins"), (13, "begun"), (14, "holds"), (15, "holds")]
    assert len({r.a for r in got}) == 6 and {r.a for r in got if r.b in (11, 15)} == {2, 6}
    assert not [p for _, p in plans if "Broadcast" in p]
    assert sum(c == ["a", "b", "rule"] for c, _ in plans) == 2


def test_one_to_one_of_hot_slugs(spark, tmp_path):
    """A slug that a third of all rows have: as many matches as the smaller side has, and candidates are slugs, not pairs of rows."""
    seen = []
    inner = saver(spark, str(tmp_path))

    def save(df):
        seen.append(inner(df))
        return seen[-1]

    left = spark.range(3000).select(F.col("id").alias("a"), F.lit(None).cast("long").alias("number"), F.when(F.col("id") % 3 == 0, "custom-guest").otherwise(F.concat(F.lit("custom-guest-"), F.col("id"))).alias("x"))
    right = spark.range(900).select(F.col("id").alias("b"), F.when(F.col("id") < 700, "custom-guest").otherwise(F.concat(F.lit("my-custom-guest-"), F.col("id"))).alias("y"))
    got = E.one_to_one(left, right, E.slug_rules(), save, block=64).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).collect()
    assert {r.rule: (r.n, r.a, r.b) for r in got} == {"exact": (700, 700, 700), "holds": (200, 200, 200)}
    assert max(df.count() for df in seen if "h" in df.columns) < 10 * 3900
    assert E.one_to_one(left.limit(0), right, E.slug_rules(), save).count() == 0


def test_held_inside(spark):
    import random

    rng = random.Random(9)
    hay, needles = [{"".join(rng.choices("ab", k=rng.randint(3, n))) for _ in range(80)} for n in (30, 9)]
    got = E.held_inside(spark.createDataFrame([(x,) for x in hay], "c string"), spark.createDataFrame([(x,) for x in needles], "d string")).collect()
    assert sorted(map(tuple, got)) == sorted((c, d) for c in hay for d in needles if len(d) >= 6 and d in c)


def test_unknown_strategy_fails(spark):
    with pytest.raises(KeyError):
        scoring.score("nothing", F.lit("x"))
    assert scoring.has("concept_match")


def test_all_pairs_in_blocks(spark, data):
    from tesserae.sources.tables import Tables

    t = Tables(spark, data)
    one = {tuple(r) for r in S.all_pairs_top_k(t.vectors, 3, blocks=1).collect()}
    assert one == {tuple(r) for r in S.all_pairs_top_k(t.vectors, 3, blocks=5).collect()}


def test_blocks_follow_the_tenants_rows(spark, data):
    from tesserae.sources.tables import Tables

    t = Tables(spark, data)
    groups = S.pairs_of_blocks(t.vectors, None, 5).groupBy("tenant", "i", "j").count().collect()
    sizes = {r.tenant: r["count"] for r in t.vectors.groupBy("tenant").count().collect()}
    blocks = {x: -(-n // 5) for x, n in sizes.items()}
    assert max(blocks.values()) > 4 and max(r["count"] for r in groups) <= 40
    assert all(max(r.j for r in groups if r.tenant == x) < n for x, n in blocks.items())
    assert {tuple(r) for r in S.all_pairs_top_k(t.vectors, 3, rows=5).collect()} == {tuple(r) for r in S.all_pairs_top_k(t.vectors, 3, blocks=1).collect()}


def landed(spark, folder, batches):
    """Write each batch of (event_id, day, user_id, value) as a file of its own, in order."""
    import datetime as dt
    import os
    import shutil

    for i, rows in enumerate(batches):
        out = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), u, "x", float(v), "{}") for e, d, u, v in rows]
        spark.createDataFrame(out, J.EVENTS).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        part = next(f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        shutil.move(f"{folder}/tmp{i}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return J.read_events(spark, f"{folder}/in", 1)


def test_ability_forgets_idle_users(spark, tmp_path):
    events = landed(spark, str(tmp_path), [[(1, 0, 7, 20), (2, 0, 8, 20)], [(3, 1, 7, 20)], [(4, 60, 8, 20)], [(5, 61, 7, 20)]])
    rows = J.run_once(J.ability(events), spark, f"file://{tmp_path}/work", "ability", "update").collect()
    assert max(r.n for r in rows if r.user_id == 7) == 2 and sorted(r.n for r in rows if r.user_id == 7)[:2] == [1, 1]
    assert {r.theta for r in rows if r.n == 1} == {0.15}


def test_ingest_over_batches_gaps_and_replays(spark, tmp_path):
    events = landed(spark, str(tmp_path), [[(1, 0, 1, 1)], [(2, 0, 2, 1), (3, 0, 3, 1)], [(4, 1, 4, 1)]])
    path = f"file://{tmp_path}/items"
    q = J.ingest(events.select("event_id", "ts", "value"), path, "event_id").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "event_id long, ts timestamp, value double"
    ids = lambda **more: sorted(r.event_id for r in J.read_table(spark, path, schema, **more).collect())
    versions = sorted({r.version for r in J.manifest(spark, path).collect()})
    assert ids() == [1, 2, 3, 4] and ids(before=versions[-1]) == [1, 2, 3] and ids(before=versions[0]) == []
    assert J.manifest(spark, f"{path}/none").count() == 0
    # a gap in the numbers loses nothing, and a replay changes nothing
    landed(spark, f"{tmp_path}/again", [[(4, 1, 4, 9), (5, 2, 5, 1)]])
    batch = spark.read.schema(J.EVENTS).parquet(f"{tmp_path}/again/in").select("event_id", "ts", "value")
    number = versions[-1] + 5
    for _ in range(2):
        J.upsert_batch(batch, number, path, "event_id")
        assert ids() == [1, 2, 3, 4, 5] and {r.event_id: r.value for r in J.read_table(spark, path, schema).collect()}[4] == 9
    # only the buckets of the batch are written, and a batch cut off before its commit is written again
    assert 1 <= J.manifest(spark, path).filter(f"version = {number}").count() <= 2
    written = {r[0] for r in spark.read.parquet(f"{path}/v{number}").select("bucket").distinct().collect()}
    assert len(written) <= 2
    batch.withColumn("value", F.lit(3.0)).withColumn("bucket", F.lit(0)).write.mode("overwrite").parquet(f"{path}/v{number + 1}")  # no commit
    assert {r.event_id: r.value for r in J.read_table(spark, path, schema).collect()}[4] == 9
    J.upsert_batch(batch.withColumn("value", F.lit(7.0)), number + 1, path, "event_id")
    assert {r.event_id: r.value for r in J.read_table(spark, path, schema).collect()}[4] == 7 and ids() == [1, 2, 3, 4, 5]
    J.upsert_batch(batch.limit(0), number + 2, path, "event_id")
    assert J.manifest(spark, path).filter(f"version = {number + 2}").isEmpty()


def test_neighbours_over_ranges(spark):
    import random

    rng = random.Random(3)
    rows = [(g, rng.choice([None, *range(50)]) if g < 2 else 5) for g in range(3) for _ in range(40)] + [(9, None), (None, 4), (None, 2)]
    df = spark.createDataFrame(rows, "g int, x int").withColumn("i", F.monotonically_increasing_id())
    w = Window.partitionBy("g").orderBy("x")
    want = df.withColumn("prev", F.lag("x").over(w)).withColumn("next", F.lead("x").over(w)).drop("i")
    for ranges in (2, 7, 64):
        got = R.with_prev_next(df, ["g"], "x", rows=6, ranges=ranges)
        assert got.columns == ["g", "x", "i", "prev", "next"]
        assert sorted(map(repr, got.drop("i").collect())) == sorted(map(repr, want.collect()))


def test_ranges_of_equal_depth(spark):
    """One outlier, and one value with a third of all rows: no range is above twice the mean, and ranges follow the order."""
    df = spark.range(30_000).select(F.when(F.col("id") == 0, 10**12).when(F.col("id") % 3 == 0, 777).otherwise(F.col("id") % 5000).alias("x"), "id", F.lit(1).alias("g"))
    parts = R.dealt_by_depth(df, ["g"], "x", 1000, 32).groupBy("_part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_part").collect()
    assert len(parts) > 24 and max(p.n for p in parts) <= 2 * 30_000 / 32 and sum(p.n for p in parts) == 30_000
    assert all(a.hi <= b.lo for a, b in zip(parts, parts[1:]))
    days = spark.createDataFrame([(1, f"2024-01-{d:02d}") for d in range(1, 29)], "g int, d string").select("g", F.col("d").cast("date").alias("d"))
    assert R.dealt_by_depth(days, ["g"], "d", 5, 4).select("_part").distinct().count() == 4


def test_systematic_sample(spark):
    df = spark.range(0, 1000, 3).withColumn("_wide", F.lit("kept"))
    got = sorted(r.id for r in R.systematic_sample(df, "id", 10, 334, span=7).collect())
    assert got == [3 * 33 * i for i in range(10)]


def test_medians(spark):
    import statistics

    rows = [(g, float(i * i % 101)) for g, n in ((0, 1), (1, 2), (2, 501), (3, 1000)) for i in range(n)] + [(4, None)]
    got = {r.g: r.m for r in R.medians(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", "m").collect()}
    assert got == {g: statistics.median([x for k, x in rows if k == g]) for g in range(4)}


def test_verbatim_matches(spark):
    import random

    from tesserae.operators import transcripts as T

    rng = random.Random(5)
    words = ["ab", "abc", "b", "cab", "déjà", "a", "zz"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(60)] + ["ab " * 3000, None, "", "¡Ab,  ABC! b."]
    quotes = []
    for _ in range(120):
        whole = rng.choice(texts[:60])
        lo = rng.randint(0, max(0, len(whole) - 1))
        quotes.append(whole[lo : lo + rng.randint(1, 60)])
    quotes += [None, "", "ab", "Déjà", "ab ab ab", "zz zz zz zz zz zz zz zz zz zz", "nowhere at all", "ab " * 2000, "..."]
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, text string").withColumn("doc_id", F.lit("x"))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("item_id", F.lit("x"))
    import re
    import unicodedata

    def plain(x):
        folded = "".join(c for c in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(c))
        return re.sub(" +", " ", re.sub(r"[^\w]", " ", folded)).strip()

    want = {(i, j) for i, x in enumerate(quotes) for j, y in enumerate(texts) if len(plain(x)) >= 3 and plain(x) in plain(y)}
    got = [(r.item_id, r.doc_id) for r in T.verbatim_matches(q, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert T.verbatim_matches(q.limit(0), d).collect() == [] and T.verbatim_matches(q, d.limit(0)).collect() == []


def test_timestamp_audit(spark):
    from tesserae.operators import transcripts as T

    said = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    segments = [("s", 0, 0.0, 10.0, said), ("s", 1, 10.0, 20.0, "Un, deux;  trois."), ("s", 2, 20.0, 30.0, None), ("s", 3, 30.0, 40.0, "..."), ("s", 4, 40.0, 50.0, "quatre cinq six sept huit NEUF dix"), ("s", 5, 900.0, 910.0, said), ("e", 0, 0.0, 5.0, "")]
    notes = [
        ("s", 1, 5.0, None, said, "ok", None), ("s", 2, 300.0, None, said, "elsewhere", 0.0), ("s", 3, 895.0, None, said, "ok", None), ("s", 4, 12.0, None, "un deux trois quatre cinq six sept huit", "ok", None), ("s", 5, 700.0, None, "Un deux trois quatre cinq six sept huit", "elsewhere", 40.0),
        ("s", 6, 5.0, None, "alpha beta gamma", "missing", None), ("s", 7, 5.0, None, "a b c d e f g h i j k", "missing", None), ("s", 8, 911.5, None, said, "bounds", None), ("s", 9, 5.0, 4.0, None, "order", None), ("s", 10, 5.0, 9.0, None, "ok", None), ("s", 11, 5.0, 912.0, None, "bounds", None),
        ("s", 12, None, None, said, "untimed", None), ("e", 13, 1.0, None, said, "missing", None), ("none", 14, 1.0, None, said, "bounds", None), (None, 15, 1.0, None, said, "bounds", None), ("s", 1, 5.0, None, said, "ok", None), ("s", 16, 5.0, None, "", "missing", None),
        # half of the words beyond the window: 40 is after -60 + 90, 10 is not
        ("s", 17, -60.0, None, "un deux trois quatre cinq six sept huit", "elsewhere", 40.0),
    ]
    kind = "source_id string, note int, start_s double, end_s double, text string"
    s = spark.createDataFrame(segments, "source_id string, idx int, start_s double, end_s double, text string")
    got = T.timestamp_audit(spark.createDataFrame([n[:5] for n in notes], kind), s)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, notes))
    assert T.timestamp_audit(spark.createDataFrame([], kind), s).count() == 0


def test_trigram_search_inside_rows_and_by_index(spark):
    items = spark.createDataFrame([(1, "red lamp", None), (2, "red lamps", "lamp"), (3, None, None), (4, "zzz", ""), (5, "red lamp", "x")], "id long, a string, b string")
    queries = spark.createDataFrame([(1, "red lamp"), (2, "lamp"), (3, ""), (4, None)], "query_id int, query string")
    inside = S.trigram_search(queries, items, ["a", "b"], 3)
    index = S.trigram_search(queries, items, ["a", "b"], 3, crossed=2)
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, index.collect())) and inside.count() == 6
    # nothing is grouped by item, so no task holds a row for each query, item and column
    assert "count(1)" not in inside._jdf.queryExecution().optimizedPlan().toString()


def test_least_k_orders_ties_by_id():
    rng = np.random.default_rng(2)
    for width, k in ((1, 4), (4, 4), (60, 4), (60, 1), (60, 100)):
        far, others = rng.integers(0, 4, (20, width)).astype(float), rng.permutation(width)
        far[rng.random(far.shape) < 0.3] = np.inf
        far[0] = np.inf
        row, col = S.least_k(far, others, k)
        want = [(i, others[j]) for i in range(20) for j in np.lexsort((others, far[i]))[:k] if np.isfinite(far[i, j])]
        assert list(zip(row.tolist(), others[col].tolist(), strict=True)) == want


def test_ranges_follow_the_rows(spark):
    df = spark.range(5000).withColumn("g", F.lit(1))
    cut = R.dealt_by_depth(df, ["g"], "id", 1000)
    # two ranges for each thousand rows, not as many as may be
    assert cut.select("_part").distinct().count() == 10 and cut.groupBy("_part").count().agg(F.max("count")).first()[0] < 1000
    whole = R.dealt_by_depth(df, ["g"], "id", 5000)
    assert whole.select("_part").distinct().count() == 1 and "percentile" not in whole._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("classes", [1024, 3])
def test_recommend_by_brute_force(spark, classes):
    """Users with many done items, equal scores over classes, nulls, repeated done rows and users without any score above 0."""
    import random

    rng = random.Random(4)
    goals = {"a": ["P1", "P2"], "b": ["P3"]}
    items = [(i, rng.choice(["P1", "P2", "P3", None]), rng.choice([0, 1, 2]), rng.random() < 0.3, i > 30) for i in range(40)]
    users = [(u, [rng.choice(["P1", "P2", "P9"])], rng.choice([["a"], ["b", "a"], ["c"], []]), rng.choice([0, 1, 2])) for u in range(12)] + [(99, [], [], -5)]
    done = [(u, rng.randrange(60)) for u in range(8) for _ in range(u * 9)] + [(3, i) for i in range(40)]

    def points(user, item):
        (_, interests, wishes, mine), (_, pillar, level, path, recent) = user, item
        wanted = any(pillar in goals.get(g, []) for g in wishes)
        parts = [(30, "interest", pillar in interests), (20, "level", level == mine), (10, "next level", level == mine + 1), (-10, None, level > mine + 1), (25, "goal", wanted), (10, "path", path), (5, "recent", recent)]
        return sum(p for p, _, on in parts if on), ",".join(name for _, name, on in parts if on and name)

    want = set()
    for user in users:
        open_ = [(-points(user, i)[0], i[0], points(user, i)[1]) for i in items if (user[0], i[0]) not in done and points(user, i)[0] > 0]
        want |= {(user[0], i, -score, why) for score, i, why in sorted(open_)[:4]}
    frames = [spark.createDataFrame(users, "user_id int, interests array<string>, goals array<string>, level int"), spark.createDataFrame(items, "id int, pillar string, level int, path boolean, recent boolean"), spark.createDataFrame(done, "user_id int, id int")]
    found = E.recommend(*frames, goals, 4, classes=classes)
    assert sorted((r.user_id, r.id, r.score, r.reasons) for r in found.collect()) == sorted(want) and any(w[0] == 7 for w in want)


def test_recommend_moves_few_rows_a_user(spark):
    """Users leave their rows with the classes that they need, not with all that score above 0."""
    items = spark.range(4000).selectExpr("cast(id as int) as id", "concat('P', id % 10) as pillar", "cast(id % 3 as int) as level", "id % 4 = 0 as path", "id >= 280 as recent")
    users = spark.range(500).selectExpr("cast(id as int) as user_id", "array(concat('P', id % 10)) as interests", "array('x') as goals", "cast(id % 3 as int) as level")
    done = spark.range(500).selectExpr("cast(id as int) as user_id", "cast(id as int) as id")
    found = E.recommend(users, items, done, {"x": ["P1"]}, 5)
    assert found.count() == 2500
    # rows of users and items that meet, before those done are left out
    met = []
    plan = found._jdf.queryExecution().optimizedPlan()
    joins = [plan]
    while joins:
        node = joins.pop()
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftAnti":
            met.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.left()).count())
        joins += [node.children().apply(i) for i in range(node.children().size())]
    assert len(met) == 1 and met[0] <= 500 * 2 * 7


def test_anomalies_deal_rows_to_small_parts(spark, data, monkeypatch):
    """Parts follow the number of rows, whatever the session's sizes; links and tags aren't grouped for it."""
    from tesserae.plans import registry

    registry.load()
    want = sorted(map(tuple, registry.QUERIES["QLT3"](spark, data).collect()))
    monkeypatch.setattr(R, "PART_ROWS", 100)
    found = registry.QUERIES["QLT3"](spark, data)
    assert sorted(map(tuple, found.collect())) == want
    orders, lines = (spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("orders", "lineitem"))
    plan = found._jdf.queryExecution().toString()
    for key, total in (("guid", orders), ("id", max(orders, lines)), ("tenant_id", orders)):
        assert f"RepartitionByExpression [{key}#" in plan and f", {-(-total // 100)}" in plan
    assert "url" not in found._jdf.queryExecution().optimizedPlan().toString()
