"""People loads: whole, replayed, repeated, cut off, over empty tables."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import loads as L

HOSTS = "tenant_id string, host string, host_slug string"
LINKS = "id long, tenant_id string, episode_id long, url string, slug string, label string"
ARTICLE = "It began. Ada Byron, " + "who wrote about engines. " * 40


@pytest.fixture
def tables(spark):
    make = spark.createDataFrame
    return {
        "stored": make([(1, "t", ""), (2, "t", "Ada Byron"), (3, "t", "Hal Host"), (4, "t", None), (5, "u", "Ada Byron"), (6, "t", "x")], L.ITEMS),
        "items": make([(1, "t", "Ada Byron", "full"), (2, "t", None, None), (3, "t", None, "full"), (4, "t", "Bob Stone", "bonus"), (5, "u", None, "full"), (6, "t", None, "full")], "id long, tenant_id string, guest_from_title string, episode_type string"),
        "people": make([(9, "t", "Hal Host", "", None, 7)], L.PEOPLE),
        "links": make([(1, "t", 1, "p/hal", "hal", "x"), (2, "t", 1, "p/bad", "bad", "Ada Byron"), (3, "t", 2, "p/other", "other", "x"), (4, "t", 2, "p/ada", "ada", "by ada byron"), (5, "u", 5, "p/hal", "hal", None)], LINKS),
        "texts": make([(1, ARTICLE, None), (2, "short", "y" * 70), (5, None, "An  introduction that is long enough to be one, with two blanks.")], "id long, article string, intro string"),
        "hosts": make([("t", "Hal Host", "hal")], HOSTS),
    }


def load(kept, t, batch):
    return L.load_people(kept, batch, t["items"], t["links"], t["texts"], t["hosts"], ["bad"], (F.ascii("tenant_id") * 100 + F.length("name")).cast("long"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_load_replay_and_second_load(spark, tables, tmp_path):
    kept = L.store(spark, f"file://{tmp_path}/s", 4)
    kept.commit("start", {"items": tables["stored"], "people": tables["people"]})
    assert load(kept, tables, "a")
    people = {(r.tenant_id, r.name): r for r in kept.read("people").collect()}
    assert set(people) == {("t", "Ada Byron"), ("u", "Ada Byron"), ("t", "Hal Host")}
    ada, other, host = people["t", "Ada Byron"], people["u", "Ada Byron"], people["t", "Hal Host"]
    assert (ada.profile, ada.n, other.profile, other.n, host.n, host.profile) == ("p/ada", 2, "p/hal", 1, 0, None)
    assert ada.bio.startswith("Ada Byron who wrote about engines.") and 201 < len(ada.bio) <= 500 and ada.bio.endswith("engines.")
    assert other.bio == "An introduction that is long enough to be one, with two blanks."
    assert rows(kept.read("bridge")) == [(11609, 1), (11609, 2), (11709, 5)]
    assert {r.id: r.guest for r in kept.read("items").collect()} == {1: "Ada Byron", 2: "Ada Byron", 3: "Hal Host", 4: None, 5: "Ada Byron", 6: "x"}
    before = {name: rows(kept.read(name)) for name in ("items", "people", "bridge")}
    commits = kept.manifest().count()
    assert not load(kept, tables, "a") and kept.manifest().count() == commits
    assert load(kept, tables, "b") and kept.manifest().count() == commits + 1  # nothing left to change: no bucket is written
    assert before == {name: rows(kept.read(name)) for name in before}


def test_cut_off_batch_is_not_seen(spark, tables, tmp_path):
    kept = L.store(spark, f"file://{tmp_path}/s", 4)
    kept.commit("start", {"items": tables["stored"], "people": tables["people"]})
    kept.stage(2, {"people": tables["people"].withColumn("n", F.lit(99).cast("long"))})
    assert [r.n for r in kept.read("people").collect()] == [7] and not kept.holds("a")
    assert load(kept, tables, "a") and 99 not in [r.n for r in kept.read("people").collect()]


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    kept = L.store(spark, f"file://{tmp_path}/s", 16)
    kept.commit("start", {"bridge": spark.range(1000).select(F.col("id").alias("guest_id"), F.col("id").alias("episode_id"))})
    kept.commit("one", {"bridge": spark.createDataFrame([(5, 5000)], L.BRIDGE)})
    last = kept.manifest().filter("batch = 'one' and name is not null")
    assert last.count() == 1 and kept.read("bridge").count() == 1001 and kept.read("bridge", [last.first().bucket]).count() < 200


def test_empty_tables(spark, tables, tmp_path):
    kept = L.store(spark, f"file://{tmp_path}/s", 4)
    assert load(kept, tables, "a")
    assert not any(kept.read(name).count() for name in ("items", "people", "bridge"))


def test_a_persons_profile_is_of_the_picked_row(spark, tables, tmp_path):
    """Links of two items may share an id: each person gets the URL of the own link, once."""
    tables["links"] = spark.createDataFrame([(4, "t", 2, "p/ada", "ada", "by ada byron"), (4, "u", 5, "p/other", "other", "ada byron")], LINKS)
    kept = L.store(spark, f"file://{tmp_path}/s", 4)
    kept.commit("start", {"items": tables["stored"], "people": tables["people"]})
    assert load(kept, tables, "a")
    assert [(r.tenant_id, r.profile) for r in kept.read("people").filter("name = 'Ada Byron'").orderBy("tenant_id").collect()] == [("t", "p/ada"), ("u", "p/other")]


def test_a_load_reads_names_once(spark, tables):
    """What several changes need is saved: none of their plans holds the test of names."""
    saved, made = [], []

    def save(df):
        saved.append(df)
        made.append(spark.createDataFrame(df.collect(), df.schema))
        return made[-1]

    bridge = spark.createDataFrame([], L.BRIDGE)
    changes = L.people_changes(tables["items"], tables["stored"], tables["people"], bridge, tables["links"], tables["texts"], tables["hosts"], ["bad"], F.lit(5).cast("long"), save)
    assert sorted(changes) == ["bridge", "items", "people"]
    named = [("episode_type" in df._jdf.queryExecution().optimizedPlan().toString()) for df in (*saved, *changes.values())]
    assert named == [True] + [False] * (len(named) - 1)
