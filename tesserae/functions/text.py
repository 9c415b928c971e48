"""Text extraction as columns: durations, links, classes of URLs and titles, keys, chapters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.predicates import any_of, folded, host_of, slug

#: Named references that landed descriptions use, with their characters, in the order they are replaced.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
#: Kinds of links by parts of the host; the first that fits counts. Replace for another catalogue.
HOST_KINDS = [("profile", ["profiles.example"]), ("social", ["social.example", "video.example"]), ("cross_ref", ["audio.example", "cast.example"]), ("tool", ["brand1.", "brand2.", "tool.example"])]
#: Endings of audio files.
AUDIO_FILE = r"(?i)\.(?:mp3|m4a|wav|ogg)(?:\?|$)"
#: Path parts that never name an item.
UTILITY = "about|contact|privacy|terms|tag|category|search|login|feed"
#: Kinds of items by words of the title, in order of priority.
TITLE_KINDS = [("extract", "extrait|extract"), ("teaser", "teaser|trailer"), ("rerun", "rediff|rerun"), ("bonus", "bonus"), ("special", "hors[- ]?serie|special")]


def html_to_text(html: Column) -> Column:
    """Line ends for breaks and paragraphs, spaces for other tags, named references decoded, blanks folded."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</p>", "\n\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, plain in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n\s*\n+", "\n\n"))


def parse_duration(value: Column) -> Column:
    """Seconds of ``SS``, ``MM:SS`` or ``HH:MM:SS``; null for anything else."""
    v = F.trim(value)
    p = lambda i: F.try_element_at(F.split(v, ":"), F.lit(i)).cast("long")
    return F.when(v.rlike(r"^[0-9]{1,9}\z"), v.cast("long")).when(v.rlike(r"^[0-9]{1,3}:[0-9]{1,2}\z"), p(1) * 60 + p(2)).when(v.rlike(r"^[0-9]{1,3}:[0-9]{1,2}:[0-9]{1,2}\z"), p(1) * 3600 + p(2) * 60 + p(3))


def to_hms(seconds: Column) -> Column:
    """``HH:MM:SS`` of seconds."""
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


#: An anchor with its address and its inside; and an address that stands in plain text.
ANCHOR = r"""(?is)<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
BARE_URL = r"""https?://[^\s<>"'()]+[^\s<>"'().,;:!?]"""


def anchors(html: Column) -> Column:
    """``(href, label)`` of every anchor, in order; labels as text, at most 200 characters, null where empty."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("t"))
    return F.transform(both, lambda a: F.struct(F.trim(a["h"]).alias("href"), F.nullif(F.substring(html_to_text(a["t"]), 1, 200), F.lit("")).alias("label")))


def web_links(html: Column, base: Column | None = None) -> Column:
    """``(href, label)`` of the anchors that lead to the web, resolved against ``base`` where one is given, then of addresses in the text, which have no label."""
    bare = F.transform(F.regexp_extract_all(html_to_text(html), F.lit(BARE_URL), F.lit(0)), lambda u: F.struct(u.alias("href"), F.lit(None).cast("string").alias("label")))
    found = anchors(html) if base is None else F.transform(anchors(html), lambda a: F.struct(absolute_url(a["href"], base).alias("href"), a["label"].alias("label")))
    return F.concat(F.filter(found, lambda a: F.coalesce(a["href"].rlike("(?i)^https?://"), F.lit(False))), bare)


def without_front_matter(markdown: Column) -> Column:
    """Markdown without the block between two lines of three hyphens at its start."""
    return F.regexp_replace(markdown, r"(?s)^---\n.*?\n---\n", "")


def _plain_path(path: Column) -> Column:
    """A path after its first slash without dot segments: a fold over its parts."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(parts, F.lit(""))).otherwise(parts)
    step = lambda kept, part: F.when(part == ".", kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, part))
    return F.array_join(F.aggregate(closed, F.array().cast("array<string>"), step), "/")


def absolute_url(href: Column, base: Column) -> Column:
    """A web address resolved against its page's; null for fragments and for other schemes (mail, telephone, scripts).

    ``//host`` takes the scheme, ``/path`` the host, ``?query`` the path and anything else the folder
    of the base; dot segments are folded, scheme and host are lower-cased, an empty path is ``/``.
    """
    h = F.trim(href)
    root, path = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0), F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    scheme = F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    whole = (
        F.when((h == "") | h.startswith("#"), None).when(scheme.isin("http", "https") & h.rlike("^[A-Za-z]+://"), h).when(scheme != "", None).when(h.startswith("//"), F.concat(F.substring_index(root, "//", 1), h))
        .when(h.startswith("/"), F.concat(root, h)).when(h.startswith("?"), F.concat(root, path, h)).otherwise(F.concat(root, folder, h))
    )
    made = lambda u: F.concat(F.lower(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*", 0)), F.lit("/"), _plain_path(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)), F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*[^?#]*(.*)$", 1))
    return F.get(F.transform(F.array(whole), made), F.lit(0))


def classify_url(url: Column, own_host: str) -> Column:
    """Kind of a link, the first that fits: profile or social by host, audio by the file, other catalogues and tools by host, own items by path, bare hosts as companies, the rest as resources; empty is other."""
    host = host_of(url)
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    kind = F.when(F.coalesce(url, F.lit("")) == "", "other")
    for name, parts in HOST_KINDS:
        if name == "cross_ref":
            kind = kind.when(url.rlike(AUDIO_FILE), "audio")
        kind = kind.when(any_of([F.contains(host, F.lit(p)) for p in parts]), name)
    own = (host == own_host) & ~path.isin("", "/") & ~path.rlike(rf"^/({UTILITY})\b")
    return kind.when(own, "episode_ref").when(url.rlike("^https?://[^/]+/?$"), "company").otherwise("resource")


def episode_ref_reason(url: Column, own_host: str) -> Column:
    """Why a link is or is not an item's: host, root, utility or match."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.when(host_of(url) != own_host, "host").when(path.isin("", "/"), "root").when(path.rlike(rf"^/({UTILITY})\b"), "utility").otherwise("match")


def editorial_type(title: Column) -> Column:
    """Kind of an item from its title; full if numbered, else unknown."""
    low = folded(F.lower(title))
    kind = F.when(title.isNull(), "unknown")
    for name, words in TITLE_KINDS:
        kind = kind.when(low.rlike(rf"\b({words})\b"), name)
    return kind.when(low.rlike(r"^#?[0-9]+"), "full").otherwise("unknown")


def clean_title(title: Column) -> Column:
    """Without a leading number; a short last segment (under 50 characters, no question or exclamation) is dropped."""
    body = F.regexp_replace(title, r"^#?[0-9]+ *[-:.] *", "")
    parts = F.split(body, " - ")
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) > 1) & (F.length(last) < 50) & ~last.rlike("[?!]"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " - ")).otherwise(body)


def title_number(title: Column) -> Column:
    """The leading number, null for none."""
    return F.nullif(F.regexp_extract(title, r"^#?([0-9]{1,9})", 1), F.lit("")).cast("long")


def slug_variants(name: Column) -> Column:
    """Joined, hyphenated, dotted, and initial with the rest; distinct."""
    parts = F.split(slug(name, 200), "-")
    return F.array_distinct(F.array(F.array_join(parts, ""), F.array_join(parts, "-"), F.array_join(parts, "."), F.concat(F.substring(F.get(parts, F.lit(0)), 1, 1), F.array_join(F.slice(parts, 2, 10), ""))))


def bio_chunk(text: Column, name: str) -> Column:
    """Text from the first mention on, at most 500 characters cut at the last sentence end if that leaves over 200; null under 60."""
    at = F.locate(name.lower(), F.lower(text))
    chunk = F.when(at > 0, F.substring(F.trim(F.regexp_replace(F.substring(text, at + len(name), F.lit(100_000)), r"\s+", " ")), 1, 500))
    cut = F.regexp_extract(chunk, r"^(.*[.!?]) ", 1)
    best = F.when(F.length(cut) > 200, cut).otherwise(chunk)
    return F.when(F.length(best) >= 60, best)


def loose_json(text: Column, schema: str) -> Column:
    """The outermost braces of a text, parsed; null where there are none or they don't parse."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema, {"mode": "PERMISSIVE"})


def missing_numbers(candidate: Column, source: Column) -> Column:
    """Numbers with their units in ``candidate`` that ``source`` lacks, also when spaces are ignored."""
    found = F.array_distinct(F.regexp_extract_all(candidate, F.lit(r"[0-9]+(?:[.,][0-9]+)?(?: ?(?:%|k|kg|km|min|h))?"), F.lit(0)))
    bare = F.regexp_replace(source, " ", "")
    return F.filter(found, lambda n: ~F.contains(source, n) & ~F.contains(bare, F.regexp_replace(n, " ", "")))


def bold_phrases(html: Column, denied: list[str], most: int = 10) -> Column:
    """The first ``most`` distinct bold phrases of 21 to 199 characters that hold none of the ``denied`` words."""
    inside = F.regexp_extract_all(html, F.lit(r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>"), F.lit(1))
    plain = F.transform(inside, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"[ \t\n]+", " ")))
    fit = F.filter(plain, lambda x: F.length(x).between(21, 199) & ~any_of([F.contains(F.lower(x), F.lit(d)) for d in denied]))
    return F.slice(F.array_distinct(fit), 1, most)


def outside_links(links: Column, own: list[str], most: int = 15) -> Column:
    """The first ``most`` of some ``(href, label)`` that lead to other sites and whose label has 4 to 99 characters."""
    web = F.filter(links, lambda a: F.coalesce(F.length(a["label"]).between(4, 99), F.lit(False)) & ~any_of([F.contains(a["href"], F.lit(d)) for d in own]))
    return F.slice(web, 1, most)


def linked_numbers(links: Column, own: Column, most: int = 350) -> Column:
    """Numbers ``#n`` (up to ``most``) in the labels of the ``(href, label)`` that lead to the page's own host, each once, in order."""
    told = F.transform(F.filter(links, lambda a: host_of(a["href"]) == own), lambda a: F.nullif(F.regexp_extract(a["label"], "#([0-9]{1,3})", 1), F.lit("")).cast("int"))
    return F.array_distinct(F.filter(told, lambda n: n.between(1, most)))


def rating(text: Column) -> Column:
    """The number before ``/ 5``; null for none."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)\s*/\s*5", 1), F.lit("")), ",", ".").cast("double")


def first_known(text: Column, names: list[str]) -> Column:
    """The first of ``names``, in their order, that occurs in the text; null for none."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(n)), n) for n in names))


def article_links(html: Column, base: Column, most: int = 500) -> Column:
    """``(target, label)`` of the anchors with an absolute address, the first of each; labels of ``most`` characters at most, empty for none."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("t"))
    made = F.filter(F.transform(both, lambda a: F.struct(absolute_url(F.trim(a["h"]), base).alias("target"), F.substring(html_to_text(a["t"]), 1, most).alias("label"))), lambda a: a["target"].isNotNull())
    targets = F.transform(made, lambda a: a["target"])
    return F.filter(made, lambda a, i: F.array_position(targets, a["target"]) == i + 1)
