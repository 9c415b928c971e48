"""People of items loaded into the catalogue: who is missing, their items, blank guests, profiles, biographies, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.predicates import full_episode, valid_person_name
from tesserae.operators.people import pick_profile
from tesserae.operators.relational import small
from tesserae.operators.snapshots import Store

ITEMS = "id long, tenant_id string, guest string"
PEOPLE = "id long, tenant_id string, name string, bio string, profile string, n long"
BRIDGE = "guest_id long, episode_id long"


def store(spark, path: str, buckets: int = 64) -> Store:
    """The three tables that a load changes together."""
    return Store(spark, path, {"items": (ITEMS, ["id"]), "people": (PEOPLE, ["tenant_id", "name"]), "bridge": (BRIDGE, ["guest_id", "episode_id"])}, buckets)


def tidy_chunk(text: Column) -> Column:
    """Blanks folded; at most 500 characters, cut at the last sentence end if more than 201 are left; null under 60."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(clean, 1, 500)
    ended = F.regexp_extract(head, r"^(.*[.!?]) ", 1)
    return F.when(F.length(clean) >= 60, F.when(F.length(clean) <= 500, clean).when(F.length(ended) > 201, ended).otherwise(head))


def mention_chunk(text: Column, name: Column) -> Column:
    """A biography from the first mention of the name on, else from that of its first word; null for neither."""
    at, first = F.position(name, text), F.get(F.split(name, " "), F.lit(0))
    near = F.position(first, text)
    after = F.regexp_replace(F.substring(text, at + F.length(name), F.lit(2**30)), r"""^[\s",.;:!?'«»]+""", "")
    return tidy_chunk(F.when(at > 0, F.substring(F.concat(name, F.lit(" "), after), 1, 600)).when(near > 0, F.substring(text, near, F.lit(600))))


def named_items(items: DataFrame, hosts: DataFrame) -> DataFrame:
    """``tenant_id, id, name`` of full items whose guest, else the one from the title, is a person and no host of the tenant."""
    name = F.trim(F.regexp_replace(F.coalesce(F.nullif("guest", F.lit("")), "guest_from_title"), "^#[0-9]+ *-? *", ""))
    named = items.filter(full_episode()).select("tenant_id", "id", name.alias("name")).filter(valid_person_name(F.col("name")))
    return named.join(small(hosts.select("tenant_id", F.col("host").alias("name")).distinct()), ["tenant_id", "name"], "left_anti")


def biographies(named: DataFrame, texts: DataFrame, people: DataFrame) -> DataFrame:
    """``tenant_id, name, _bio`` of people without one: from their first item with an article over 300 characters, else with an introduction over 60.

    ``texts``: ``id, article, intro``. Only ids are grouped; a text moves once its item is chosen.
    """
    who = ["tenant_id", "name"]
    without = people.filter(F.coalesce(F.nullif("bio", F.lit("")), F.lit("")) == "").select(*who)
    seen = named.join(without, who, "left_semi").join(texts.select("id", (F.length("article") > 300).alias("_long"), (F.length("intro") > 60).alias("_said")), "id")
    first = seen.groupBy(*who).agg(F.min(F.when(F.col("_long"), F.col("id"))).alias("_a"), F.min(F.when(F.col("_said"), F.col("id"))).alias("_i"))
    told = first.join(texts.select(F.col("id").alias("_a"), "article"), "_a", "left").join(texts.select(F.col("id").alias("_i"), "intro"), "_i", "left")
    return told.select(*who, F.coalesce(mention_chunk(F.col("article"), F.col("name")), tidy_chunk(F.col("intro"))).alias("_bio")).filter("_bio is not null")


def people_changes(items: DataFrame, guests: DataFrame, people: DataFrame, bridge: DataFrame, links: DataFrame, texts: DataFrame, hosts: DataFrame, parasites: list[str], identity: Column, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The rows that a load adds or changes in each table; without rows where a load has been made already.

    ``items``: ``id, tenant_id, guest_from_title, episode_type``; ``guests``: ``id, tenant_id, guest``
    as stored; ``links``: ``id, tenant_id, episode_id, url, slug, label`` of profile links; ``hosts``:
    ``tenant_id, host, host_slug``. ``identity`` gives a new person's id from tenant and name. Blank
    guests, null profiles and blank biographies are filled; nothing that is there is replaced.
    ``save`` writes a frame that is used several times, and reads it back.
    """
    who = ["tenant_id", "name"]
    named = save(named_items(guests.join(items.select("id", "guest_from_title", "episode_type"), "id"), hosts))
    fresh = named.select(*who).distinct().join(people, who, "left_anti").select(identity.alias("id"), *who, *(F.lit(None).cast("string").alias(c) for c in ("bio", "profile")), F.lit(0).cast("long").alias("n"), F.lit(True).alias("_new"))
    every = save(people.withColumn("_new", F.lit(False)).unionByName(fresh))
    linked = named.select(*who, F.col("id").alias("episode_id")).join(every.select(F.col("id").alias("guest_id"), *who), who)
    added = save(linked.select("guest_id", "episode_id").distinct().join(bridge, ["guest_id", "episode_id"], "left_anti"))
    met = bridge.unionByName(added)
    filled = guests.filter(F.coalesce("guest", F.lit("")) == "").drop("guest").join(named.select("id", F.col("name").alias("guest")), "id")

    seeking = every.filter("profile is null").select(F.col("id").alias("guest_id"), *who)
    found = met.join(seeking, "guest_id").join(links, ["tenant_id", "episode_id"]).select("tenant_id", F.col("name").alias("person"), "id", "url", "slug", "label")
    picked, _ = pick_profile(found, hosts, parasites, ["tenant_id"], ["url"])
    profile = picked.select("tenant_id", F.col("person").alias("name"), F.col("url").alias("_profile"))

    counts = met.groupBy(F.col("guest_id").alias("id")).agg(F.count_distinct("episode_id").alias("_n"))
    after = every.join(profile, who, "left").join(biographies(named, texts, every), who, "left").join(counts, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    changed = after.filter(F.col("_new") | F.col("_profile").isNotNull() | F.col("_bio").isNotNull() | ~F.col("_n").eqNullSafe(F.col("n")))
    rows = changed.select("id", *who, F.coalesce(F.nullif("bio", F.lit("")), "_bio").alias("bio"), F.coalesce("profile", "_profile").alias("profile"), F.col("_n").alias("n"))
    return {"items": filled, "people": rows, "bridge": added}


def load_people(kept: Store, batch: str, items: DataFrame, links: DataFrame, texts: DataFrame, hosts: DataFrame, parasites: list[str], identity: Column) -> bool:
    """One load, committed in all tables at once; false where the batch is committed already."""
    if kept.holds(batch):
        return False
    return kept.commit(batch, people_changes(items, kept.read("items"), kept.read("people"), kept.read("bridge"), links, texts, hosts, parasites, identity, kept.aside))
