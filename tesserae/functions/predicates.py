"""Predicates and keys that many operators share, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their bare letters.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def full_episode(kind: str = "episode_type") -> Column:
    """A full item: typed so, or not typed."""
    return F.col(kind).isNull() | (F.col(kind) == "full")


def guest_key(guest: str = "guest", other: str = "guest_from_title") -> Column:
    """The person's key: the guest, else the one from the title, trimmed and lower-cased."""
    return F.lower(F.trim(F.coalesce(F.nullif(F.col(guest), F.lit("")), F.col(other))))


def all_of(conditions: list[Column]) -> Column:
    """Their conjunction; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """Their disjunction; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(term: str, *columns: str) -> Column:
    """Whether any of the columns contains ``term``, whatever the case."""
    return any_of([F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])


def contains_none(column: str, patterns: list[str]) -> Column:
    """No pattern occurs in the column; every row passes an empty list."""
    return all_of([~F.contains(F.col(column), F.lit(p)) for p in patterns])


def overlaps_or_all(column: str, values: list[str] | None) -> Column:
    """Whether an array shares one of ``values``; without values every row passes."""
    return F.lit(True) if values is None else F.arrays_overlap(column, F.array(*(F.lit(v) for v in values)))


def equals_or_all(column: str, value: object) -> Column:
    """Whether the column has ``value``; without a value every row passes."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def folded(text: Column) -> Column:
    """Without marks on Latin letters."""
    return F.translate(text, MARKED, BARE)


def name_key(text: Column) -> Column:
    """Accent-folded, lower-cased, white space folded and trimmed."""
    return F.trim(F.regexp_replace(folded(F.lower(text)), r"(?U)\s+", " "))


def slug(text: Column, most: int = 80) -> Column:
    """Folded letters and digits joined by hyphens, cut to ``most`` after the edges are trimmed."""
    return F.substring(F.regexp_replace(F.regexp_replace(folded(F.lower(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def verbatim_key(text: Column) -> Column:
    """Folded words of letters and digits, single-spaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(F.lower(text)), r"[^\p{L}\p{N}]", " "), " +", " "))


def host_of(url: Column) -> Column:
    """Host without scheme and ``www.``."""
    return F.regexp_replace(url, r"^https?://(www\.)?([^/]+).*", "$2")


#: First words of titles that name no person.
TITLE_WORDS = "rediff|extrait|excerpt|bonus|zoom|episode|hors[- ]?serie|interview|special|partenariat|replay|bande[- ]?annonce|teaser|hs"
#: Verbs that tell a title from a name.
TITLE_VERBS = "comment|pourquoi|reprendre|reussir|réussir|construire|explorer|decouvrir|découvrir|devenir|trouver|investir|gagner|monter|lancer|creer|créer|developper|développer"


def valid_person_name(name: Column) -> Column:
    """Two or more words (hyphens part them too), an upper-case start, at most 50 characters, and no mark of a title.

    Marks are: an opening bracket or hash, digits alone, a listed first word, a listed verb, a colon,
    slash, bar or guillemet, a curly apostrophe, a quote at the end, and two dashes between spaces.
    """
    n = F.regexp_replace(name, r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")
    words = F.filter(F.split(n, r"[\s\x{a0}-]+"), lambda w: w != "")
    marks = [r"^[\[#]", r"^[0-9]+$", rf"(?i)^({TITLE_WORDS})(?![A-Za-z0-9_])", rf"(?i)(?<![A-Za-z0-9_])({TITLE_VERBS})(?![A-Za-z0-9_])", r"[:/|«»\x{2019}]", r"['‘`]$", r"(?s)\s-\s.*\s-\s"]
    return F.coalesce(n.rlike("^[A-ZÀ-Ý]") & (F.size(words) >= 2) & (F.length(n) <= 50) & ~any_of([n.rlike(m) for m in marks]), F.lit(False))
