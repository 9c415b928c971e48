"""Facts told in titles and descriptions, as columns: guests, sponsors, and the blocks of a description.

Nothing here is one long pattern. A title is split at its dashes and its parts are tested word by
word; a description is cut in front of the plain phrases of ``HEADERS`` and its blocks are read as
lines; sponsors are read by a fold over words. Phrases are compared after accents, case, blanks
and apostrophes are folded, which keeps every character's place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.predicates import MARKED, BARE, any_of
from tesserae.functions.text import html_to_text, parse_duration

#: Blocks of a description, the phrases that open one (folded), and the mark that must follow; ``end`` only closes another.
HEADERS = [
    ("topic", "le sujet", ":"), ("guest", "l'invite du jour", ":"), ("guest", "l'invitee du jour", ":"), ("guest", "l'invites du jour", ":"), ("guest", "l'invitees du jour", ":"), ("guest", "les invites", ":"),
    ("guest", "les invitees", ":"), ("guest", "au micro", ":"), ("items", "decouvrez", ":"), ("items", "au programme", ":"), ("items", "dans cet episode", ":"), ("references", "ils citent les references suivantes", ":"),
    ("references", "il cite les references suivantes", ":"), ("references", "references", ":"), ("references", "reference", ":"), ("references", "ressources", ":"), ("episodes", "ainsi que d'anciens episodes", ""),
    ("episodes", "les anciens episodes de", ""), ("promo", "avantages", ":"), ("promo", "avantage", ":"), ("promo", "bonne nouvelle", "!"), ("end", "chapitres", ":"), ("end", "timeline", ":"), ("end", "heberge par", ""),
    ("end", "voir l'acast.com", ""), ("end", "voir acast.com", ""), ("end", "on vous souhaite", ""), ("end", "merci a notre partenaire", ""), ("end", "merci a nos partenaires", ""), ("end", "est un podcast du label", ""),
    ("end", "pour s'abonner a la newsletter", ""), ("end", "pour vous abonner a la newsletter", ""), ("end", "la libre antenne", ""),
]
#: What a sponsor's name follows, by group; what opens and what closes a list of sponsors.
SPONSOR_PHRASES = [
    [f"cet{gap}episode {verb}{what} par " for gap in " -" for verb in ("est ", "") for what in ("sponsorise", "presente")],
    [f"merci a {our}{whom} " for our in ("notre ", "") for whom in ("partenaire", "sponsor")], ["sponsorise par ", "sponsori par ", "sponsor par "], ["en partenariat avec "], ["brought to you by "],
]
LIST_OPENS = [f"merci a {every}{our} {whom}" for every in ("tous ", "") for our in ("nos", "mes") for whom in ("sponsors", "partenaires")]
LIST_ENDS = ["vous souhaitez sponsoriser", "timeline", "heberge par", "montage :", "montages :", "montage -", "montages -", "ecrivez-nous", "ecrivez nous", "ecryvez-nous", "retrouvez-nous", "retrouvez nous", "hors-serie", "hors serie"]
#: Small words inside names of firms, words that are no sponsor, small words inside names of persons.
FIRM_WORDS, NO_SPONSOR = ["de", "du", "des", "la", "le", "les", "d", "&", "et", "y"], ["et", "aussi", "plus", "ainsi", "aujourd'hui", "merci", "grand", "énorme", "enorme", "http", "https"]
NAME_WORDS = ["de", "du", "des", "la", "le", "les", "van", "von", "der", "dos", "da", "del", "di", "y", "d", "ae"]
#: First words (folded) of titles that are topics or questions, and words between a role and a firm.
TOPIC_WORDS = ["comment", "combien", "pourquoi", "tout", "quand", "quoi", "que", "qui", "quel", "quels", "un", "une", "des", "investir", "investissement", "prendre", "faut-il", "saas", "immobilier", "bourse", "crypto", "hors-serie", "hors", "extrait", "bonus", "episode", "saison", "zoom", "serie"]
ROLE_AT = ["at", "chez", "from", "@"]
BULLETS, DASHES, MOST_ITEM, MOST_LIST = "-•*", "-–—", 280, 600
VIDEO_HOST = "video.example"
_ADDRESS = r"https?://[^\s<>\"'()]+"
_STRINGS = "array<string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flat(text: Column) -> Column:
    """Lower-cased without marks, curly apostrophes straight: every character keeps its place."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.translate(text, MARKED + "‘’ʼ", BARE + "'''"), upper, upper.lower())


def _one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _none(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _strings(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _part(words: Column, low: Column | int, n: Column | int = 1_000) -> Column:
    """Words from place ``low`` (from 0) on, at most ``n``, joined."""
    at = low if isinstance(low, Column) else F.lit(low)
    return F.array_join(F.slice(words, at + 1, F.greatest(F.lit(0), n if isinstance(n, Column) else F.lit(n))), " ")


def address(text: Column) -> Column:
    """The first web address of a text, without punctuation behind it; null for none."""
    return _none(F.rtrim(F.regexp_extract(text, _ADDRESS, 0), F.lit(".,;:!?")))


# ---------------------------------------------------------------- titles


def _name_word(word: Column) -> Column:
    """Whether all pieces of a word are small words of names, or begin with a capital and go on in small letters."""
    small = _strings(*NAME_WORDS)
    return F.forall(F.split(word, "[-'’]"), lambda p: p.rlike(r"^[A-ZÀ-Ý][a-zà-ÿ]+$") | F.array_contains(small, p) | p.isin("D", "O", "L", "l"))


def _leading_name(words: Column, least: int) -> Column:
    """The name of ``least`` to five words that some words begin with; a comma ends it, and one word must have a capital. Null for none."""
    bare = lambda w: F.rtrim(w, F.lit(",.!?"))

    def step(state: Column, word: Column) -> Column:
        goes = state["open"] & _name_word(bare(word)) & (state["n"] < 5)
        return F.struct((goes & (bare(word) == word)).alias("open"), (state["n"] + goes.cast("int")).alias("n"))

    count = F.aggregate(words, F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return _let(F.transform(F.slice(words, F.lit(1), count), bare), lambda name: F.when((F.size(name) >= least) & F.exists(name, lambda w: w.rlike("^[A-ZÀ-Ý]")), F.array_join(name, " ")))


def _without_lead(title: Column) -> Column:
    """A title without its number, ``Episode n``, tag in brackets or ``VF`` in front, each followed by a dash or colon where one stands."""
    body = F.trim(title)
    for lead, needs in ((r"^#?\s*[0-9]+", True), (r"(?i)^episode\s+[0-9]+", True), (r"^\[[^\]]*\]", False), (r"(?i)^vf", True)):
        rest = F.regexp_replace(body, lead, "")
        opened = F.ltrim(rest)
        marked = F.substring(opened, 1, 1).isin(*DASHES, ":")
        body = F.when(body.rlike(lead) & (marked | F.lit(not needs)), F.ltrim(F.when(marked, F.substring(opened, F.lit(2), F.length(opened))).otherwise(opened))).otherwise(body)
    return F.trim(body)


def guest_from_title(title: Column) -> Column:
    """Struct of name, company and role that a title tells; all null where it names no person.

    A title that begins as a topic names a person after ``de``, or after its last mark. Else the first
    form that fits counts: ``Name (Company): role``, ``Name, role at Company``, ``Name - role at
    Company``, ``Name - Company - role``, ``Name, role``, a leading name. Names of one word have four
    letters or more.
    """
    none = F.lit(None).cast("string")

    def told(name: Column, company: Column = none, role: Column = none) -> Column:
        return F.struct(*(_none(F.trim(c)).alias(n) for c, n in ((name, "name"), (company, "company"), (role, "role"))))

    def read(body: Column) -> Column:
        words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
        parts = F.split(body, rf"\s+[{DASHES}]\s+|\s*[–—]\s*")
        first = F.get(parts, F.lit(0))
        lead = flat(F.get(words, F.lit(0)))
        article = lead.isin("le", "la", "les") & (F.get(words, F.lit(1)).rlike("^[A-ZÀ-Ý]") | (flat(F.get(words, F.lit(1))) == "chiffres"))
        topic = F.array_contains(_strings(*TOPIC_WORDS), F.rtrim(lead, F.lit(":?!,"))) | article | lead.startswith("l'") | lead.startswith("[")
        # after ``de``, or ``d'`` that opens a word
        of = F.filter(F.transform(words, lambda w, i: F.when(flat(w) == "de", _leading_name(F.slice(words, i + 2, F.lit(6)), 2)).when(flat(w).startswith("d'"), _leading_name(F.concat(F.array(F.substring(w, 3, 100)), F.slice(words, i + 2, F.lit(5))), 2))), lambda n: n.isNotNull())
        after_marks = F.split(body, rf"[?!.]\s+([{DASHES}]\s*)?|\s[{DASHES}]\s|[–—]")
        last = F.filter(F.split(F.element_at(after_marks, -1), r"\s+"), lambda w: w != "")
        joined = lambda w: w.isin("et", "and", "&") | _name_word(F.rtrim(w, F.lit(","))) | w.rlike("^[A-ZÀ-Ý]")
        tail = F.when((F.size(after_marks) > 1) & F.forall(last, joined), _leading_name(last, 1))
        # Name (Company): role
        head, inside, after = F.substring_index(body, "(", 1), F.substring_index(F.substring(body, F.locate("(", body) + 1, F.lit(1000)), ")", 1), F.trim(F.substring(body, F.locate(")", body) + 1, F.lit(1000)))
        fits = lambda c: F.length(F.trim(c)).between(2, 80) & ~F.contains(c, F.lit("|"))
        bracket = (F.locate("(", body) > 0) & (F.locate(")", body) > F.locate("(", body) + 1) & fits(head) & ~F.contains(head, F.lit(",")) & ((after == "") | F.substring(after, 1, 1).isin(*DASHES, ":"))
        # role and company around the first word between the two
        around = lambda ws, keys: _let(F.array_min(F.filter(F.transform(ws, lambda w, i: F.when(F.array_contains(_strings(*keys), F.lower(w)) & (i > 0) & (i < F.size(ws) - 1), i)), lambda i: i.isNotNull())), lambda i: F.when(i.isNotNull(), F.struct(_part(ws, F.lit(0), i).alias("role"), _part(ws, i + 1).alias("company"))))
        behind_comma = F.substring(body, F.locate(",", body) + 1, F.lit(1000))
        comma = around(F.split(F.trim(F.get(F.split(behind_comma, rf"\||\s[{DASHES}]\s|[–—]"), F.lit(0))), r"\s+"), ROLE_AT)
        end = around(F.split(F.trim(F.element_at(parts, -1)), r"\s+"), [*ROLE_AT, "de"])
        role_before = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)), " - ")
        dashed = (F.size(parts) > 1) & fits(first) & end.isNotNull() & ~F.contains(end["company"], F.lit("|"))
        whole = _leading_name(F.split(first, r"\s+"), 2)
        named = (F.size(parts) > 1) & (whole == first) & F.length(F.get(parts, F.lit(1))).between(2, 60)
        before_comma = F.substring_index(body, ",", 1)
        plain = F.contains(body, F.lit(",")) & (_leading_name(F.split(before_comma, r"\s+"), 2) == before_comma) & ~behind_comma.rlike(r"[|–—]| - ")
        return (
            F.when(topic, F.when(F.size(of) > 0, told(F.get(of, F.lit(0)))).when(F.length(tail) >= 4, told(tail)).otherwise(told(none)))
            .when(bracket, told(head, inside, F.ltrim(after, F.lit(f"{DASHES}: ")))).when(F.contains(body, F.lit(",")) & fits(before_comma) & comma.isNotNull(), told(before_comma, comma["company"], comma["role"]))
            .when(dashed, told(first, end["company"], F.concat_ws(" - ", _none(role_before), end["role"]))).when(named, told(whole, F.get(parts, F.lit(1)), F.array_join(F.slice(parts, F.lit(3), F.lit(20)), " - ")))
            .when(plain, told(before_comma, none, behind_comma)).otherwise(told(_leading_name(words, 2)))
        )

    return _let(_without_lead(F.coalesce(title, F.lit(""))), read)


# ---------------------------------------------------------------- sponsors


def _is_address(word: Column) -> Column:
    return word.rlike("^https?://.") | word.rlike(r"^[a-z0-9][a-z0-9.-]*[.][a-z]{2,}(/|$)")


def _listed(block: Column) -> Column:
    """``(name, context)`` of the entries ``Name : address`` of a list: a fold over words that keeps the words since the last address or other mark."""
    state = F.struct(F.array().cast(_STRINGS).alias("name"), F.lit(False).alias("due"), F.array().cast("array<struct<name:string,context:string>>").alias("out"))
    empty = F.array().cast(_STRINGS)

    def step(s: Column, word: Column) -> Column:
        core = F.rtrim(word, F.lit(":"))
        fits = core.rlike("^[A-Za-zÀ-ÿ0-9&'’-]+$")
        kept = F.when(~fits, empty).when((F.size(s["name"]) > 0) | core.rlike("^[A-ZÀ-Ý]"), F.array_append(s["name"], core)).otherwise(empty)
        taken = F.array_append(s["out"], F.struct(F.array_join(s["name"], " ").alias("name"), word.alias("context")))
        return (
            F.when(s["due"] & _is_address(word) & (F.size(s["name"]) > 0), F.struct(empty.alias("name"), F.lit(False).alias("due"), taken.alias("out")))
            .when(word == ":", F.struct(s["name"].alias("name"), F.lit(True).alias("due"), s["out"].alias("out")))
            .otherwise(F.struct(F.when(s["due"] & ~fits, empty).otherwise(kept).alias("name"), (word.endswith(":") & fits).alias("due"), s["out"].alias("out")))
        )

    found = F.aggregate(F.filter(F.split(block, r"\s+"), lambda w: w != ""), state, step, lambda s: s["out"])
    small, wrong = _strings(*FIRM_WORDS), _strings(*NO_SPONSOR)
    proper = lambda n: F.forall(F.split(n, " "), lambda w: F.array_contains(small, F.lower(w)) | w.rlike("^[A-ZÀ-Ý0-9]"))
    return F.filter(found, lambda e: F.length(e["name"]).between(3, 31) & (F.size(F.split(e["name"], " ")) <= 4) & proper(e["name"]) & ~F.array_contains(wrong, F.lower(e["name"])))


def _first_of(text: Column, phrases: list[str], begin: int = 1) -> Column:
    """Place (from 1) and length of the earliest of some phrases, the longest of those; null for none."""
    places = F.array(*(F.struct(F.locate(p, text, begin).alias("at"), F.lit(-len(p)).alias("long")) for p in phrases))
    return F.array_min(F.filter(places, lambda x: x["at"] > 0))


def sponsors(text: Column) -> Column:
    """``(name, context)`` of sponsors: entries of a list, then names after a phrase with 60 characters around; the first of a name, whatever its case.

    A listed name has four words at most, each with a capital or digit first, small words apart. A
    list goes on to a known end, else for 600 characters. Null text has none.
    """

    def read(plain: Column) -> Column:
        def in_list(low: Column) -> Column:
            opens = _first_of(low, LIST_OPENS)
            begin = opens["at"] - opens["long"]
            rest = F.substring(plain, begin, F.lit(1_000_000_000))
            end = _first_of(flat(rest), LIST_ENDS, 2)
            block = F.when(end.isNotNull(), F.substring(rest, F.lit(1), end["at"] - 1)).otherwise(F.substring(rest, 1, MOST_LIST))
            return F.coalesce(_listed(F.ltrim(block, F.lit(f" :{DASHES}"))), F.array().cast("array<struct<name:string,context:string>>"))

        def after(low: Column, phrases: list[str]) -> Column:
            met = _first_of(low, phrases)
            begin = met["at"] - met["long"]
            run = F.regexp_extract(F.substring(plain, begin, F.lit(41)), r"^[A-Z][\w&'’ .-]+", 0)
            name = F.trim(F.get(F.split(run, "[.]"), F.lit(0)))
            low_end = F.greatest(F.lit(1), met["at"] - 60)
            return F.when(F.length(name) >= 2, F.struct(name.alias("name"), F.trim(F.substring(plain, low_end, begin + F.length(run) + 60 - low_end)).alias("context")))

        return _let(flat(plain), lambda low: F.concat(in_list(low), F.filter(F.array(*(after(low, p) for p in SPONSOR_PHRASES)), lambda e: e.isNotNull())))

    def once(every: Column) -> Column:
        keys = F.transform(every, lambda e: F.lower(e["name"]))
        return F.filter(every, lambda e, i: F.array_position(keys, F.lower(e["name"])) == i + 1)

    return _let(_let(F.regexp_replace(html_to_text(F.coalesce(text, F.lit(""))), r"\s", " "), read), once)


# ---------------------------------------------------------------- descriptions


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def _shortened(item: Column) -> Column:
    """At most 280 characters, cut behind the last sentence end if that leaves over half of them."""
    cut = F.substring(item, 1, MOST_ITEM)
    sentence = F.regexp_extract(cut, r"(?s)^.*[.!?]", 0)
    return F.when(F.length(item) <= MOST_ITEM, item).when(F.length(sentence) > MOST_ITEM // 2 + 1, sentence).otherwise(F.trim(cut))


def bullets(block: Column) -> Column:
    """Items of a block: lines that begin with a bullet, each with the lines up to the next; without bullets the parts between spaced dashes, if there are any."""
    none = F.array().cast(_STRINGS)

    def read(lines: Column) -> Column:
        opens = lambda x: x.rlike(rf"^[{BULLETS}]\s*\S")
        at = F.filter(F.transform(lines, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull())
        item = lambda i, k: F.array_join(F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - i), " ")
        items = F.transform(at, lambda i, k: _shortened(_one_space(F.substring(item(i, k), F.lit(2), F.lit(1_000_000)))))
        whole = _one_space(F.array_join(lines, " "))
        dashed = F.when(whole.rlike(r"\s[-—]\s"), F.transform(F.split(whole, r"\s[-—]\s"), lambda x: _shortened(F.trim(x)))).otherwise(none)
        long = lambda x: F.length(x) > 2
        return _let(F.filter(items, long), lambda found: F.when(F.size(found) > 0, found).otherwise(F.filter(dashed, long)))

    return F.coalesce(_let(_lines(block), read), none)


def chapters(text: Column) -> Column:
    """``(seconds, title)`` of the lines ``[bullet] [HH:]MM:SS mark title``, mark a colon or dash; each once, whatever the title's case."""

    def read(line: Column) -> Column:
        body = F.ltrim(line, F.lit(f" {BULLETS}"))
        time = F.regexp_extract(body, r"^[0-9]{1,2}(:[0-9]{2}){1,2}", 0)
        rest = F.ltrim(F.substring(body, F.length(time) + 1, F.lit(100_000)))
        title = F.rtrim(_one_space(F.substring(rest, F.lit(2), F.lit(100_000))), F.lit(".,;:"))
        return F.when((time != "") & F.substring(rest, 1, 1).isin(*DASHES, ":") & (F.length(title) >= 2), F.struct(parse_duration(time).alias("seconds"), title.alias("title")))

    def once(found: Column) -> Column:
        keys = F.transform(found, lambda c: F.concat(c["seconds"].cast("string"), F.lit(":"), F.lower(c["title"])))
        return F.filter(found, lambda c, i: F.array_position(keys, F.concat(c["seconds"].cast("string"), F.lit(":"), F.lower(c["title"]))) == i + 1)

    return _let(F.filter(F.transform(_lines(text), read), lambda c: c.isNotNull()), once)


def _episodes(block: Column, marks: str, least: int, most: int) -> Column:
    """``(number, title)`` of the mentions ``#n mark title`` of a text, each number once; a title ends with its line."""

    def read(part: Column) -> Column:
        line = F.get(F.split(part, "\n"), F.lit(0))
        number = F.regexp_extract(line, r"^\s*([0-9]{1,4})(?![0-9])", 1)
        rest = F.ltrim(F.substring(F.ltrim(line), F.length(number) + 1, F.lit(100_000)))
        title = F.ltrim(F.substring(rest, F.lit(2), F.lit(100_000)))
        fits = (number != "") & F.substring(rest, 1, 1).isin(*marks) & F.length(title).between(least, most)
        return F.when(fits, F.struct(number.cast("int").alias("number"), _none(F.rtrim(_one_space(title), F.lit(".,;:"))).alias("title")))

    parts = F.split(block, "#")
    found = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), read), lambda e: e.isNotNull())
    numbers = F.transform(found, lambda e: e["number"])
    return F.filter(found, lambda e, i: F.array_position(numbers, e["number"]) == i + 1)


def _promo(block: Column) -> Column:
    """Struct of code, url, partner and description of an offer; null where it tells none of them."""

    def read(words: Column) -> Column:
        low = F.transform(words, flat)
        bare = lambda w: F.regexp_replace(w, r"[^A-Za-z0-9]+$", "")
        code_at = F.filter(F.transform(low, lambda w, i: F.when(w == "code", i + F.when(F.get(low, i + 1) == "promo", 2).otherwise(1))), lambda i: bare(F.get(words, i)).rlike("^[A-Za-z][A-Za-z0-9]{2,20}$"))
        code = F.upper(bare(F.get(words, F.get(code_at, F.lit(0)))))
        whom = F.array_position(low, "chez").cast("int")

        def step(s: Column, word: Column) -> Column:
            stop = word.isin("→", "pour", "avec") | word.startswith("(")
            goes = s["open"] & ~stop
            return F.struct((goes & ~word.rlike("[.,:;]$")).alias("open"), F.when(goes, F.array_append(s["name"], F.rtrim(word, F.lit(".,:;")))).otherwise(s["name"]).alias("name"))

        name = F.aggregate(F.slice(words, whom + 1, F.lit(12)), F.struct(F.lit(True).alias("open"), F.array().cast(_STRINGS).alias("name")), step, lambda s: F.array_join(s["name"], " "))
        partner = F.when((whom > 0) & name.rlike("^[A-Z]") & F.length(name).between(2, 41), name)
        spoken = F.filter(words, lambda w, i: ~w.startswith("http") & (w != "→") & ~(F.get(code_at, F.lit(0)).isNotNull() & i.between(F.get(code_at, F.lit(0)) - F.when(F.get(low, F.get(code_at, F.lit(0)) - 1) == "promo", 2).otherwise(1), F.get(code_at, F.lit(0)))))
        sentence = F.trim(F.get(F.split(F.array_join(spoken, " "), "[.!]"), F.lit(0)))
        told = F.when(F.length(sentence).between(6, 199), sentence)
        url = address(F.array_join(words, " "))
        return F.when(F.coalesce(code, url, partner, told).isNotNull(), F.struct(code.alias("code"), url.alias("url"), partner.alias("partner"), told.alias("description")))

    return _let(F.filter(F.split(block, r"\s+"), lambda w: w != ""), read)


def _cross_promo(plain: Column) -> Column:
    """``A présente B``: names with a capital on both sides of the verb inside one clause; null for none."""
    clause = F.filter(F.split(plain, r"[^\p{L}\p{N}_'’ \n-]"), lambda c: F.contains(flat(c), F.lit(" presente ")))

    def read(c: Column) -> Column:
        at = F.locate(" presente ", flat(c))
        left = F.regexp_extract(F.substring(c, F.greatest(F.lit(1), at - 41), F.least(at - 1, F.lit(41))), r"(?s)(?<![\p{L}])[A-ZÀ-Ý].*$", 0)
        right = F.substring(F.ltrim(F.substring(c, at + 10, F.lit(100))), 1, 61)
        return F.when((F.length(left) >= 2) & right.rlike("^[A-ZÀ-Ý]") & (F.length(right) >= 3), _one_space(F.concat(left, F.lit(" présente "), right)))

    return F.get(F.filter(F.transform(clause, read), lambda x: x.isNotNull()), F.lit(0))


def description_blocks(text: Column) -> Column:
    """Struct of a description's parts: topic, guest, items, references, episodes, promo, chapters, video, cross_promo; null or empty where missing.

    Items of an HTML list become bullets. The text is cut in front of every header, so a block ends at
    the nearest other one; of several blocks of a kind the one whose header stands first in
    ``HEADERS`` counts. Without a block of earlier episodes any ``#n - title`` of the text counts.
    """
    listed = F.regexp_replace(F.regexp_replace(text, r"(?i)<li(\s[^>]*)?>", "\n- "), r"(?i)</li>|</?[ou]l(\s[^>]*)?>", "\n")
    plain = F.regexp_replace(F.regexp_replace(F.translate(html_to_text(listed), "‘’ʼ \r", "''' "), "[ \t]+", " "), " *\n *", "\n")
    forms = sorted({phrase + (f" ?{mark}" if mark else "") for _, phrase, mark in HEADERS}, key=len, reverse=True)
    every = "|".join(f.replace(".", "[.]") for f in forms)
    rank = F.create_map(*(F.lit(x) for i, (_, phrase, _) in enumerate(HEADERS) for x in (phrase, i)))

    def cut(whole: Column) -> Column:
        """``(rank, body)`` of each block."""
        pieces = F.split(F.regexp_replace(flat(whole), f"({every})", "\u0001$1"), "\u0001")
        starts = F.aggregate(pieces, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

        def block(p: Column, start: Column) -> Column:
            head = F.regexp_extract(p, f"^({every})", 0)
            return F.struct(rank[F.trim(F.rtrim(head, F.lit(" :!")))].alias("rank"), F.trim(F.substring(whole, start + F.length(head), F.length(p) - F.length(head)), F.lit(" \n")).alias("body"))

        return F.filter(F.zip_with(pieces, starts, block), lambda b: b["rank"].isNotNull())

    def read(both: Column) -> Column:
        whole, blocks = both["whole"], both["blocks"]

        def of(kind: str) -> Column:
            ranks = [i for i, (k, _, _) in enumerate(HEADERS) if k == kind]
            fits = F.filter(F.transform(blocks, lambda b, i: F.struct(b["rank"].alias("rank"), i.alias("i"), b["body"].alias("body"))), lambda b: b["rank"].between(min(ranks), max(ranks)) & (b["body"] != ""))
            return F.array_min(fits)["body"]

        least = lambda c, n: F.when(F.length(_one_space(c)) > n, _one_space(c))

        def reference(item: Column) -> Column:
            url = address(item)
            label = F.when(url.isNull(), item).otherwise(F.trim(F.rtrim(F.trim(F.replace(item, url, F.lit(""))), F.lit(f"→:.,;{DASHES} "))))
            return F.struct(F.coalesce(_none(label), url).alias("label"), url.alias("url"))

        inside = F.coalesce(_episodes(of("episodes"), DASHES + ":", 1, 100_000), F.array().cast("array<struct<number:int,title:string>>"))
        video = F.filter(F.regexp_extract_all(whole, F.lit(_ADDRESS), F.lit(0)), lambda u: u.rlike(rf"^https?://(www[.])?{VIDEO_HOST.replace('.', '[.]')}/"))
        return F.struct(
            least(of("topic"), 10).alias("topic"), least(of("guest"), 5).alias("guest"), bullets(of("items")).alias("items"), F.transform(bullets(of("references")), reference).alias("references"),
            F.when(F.size(inside) > 0, inside).otherwise(_episodes(whole, DASHES, 3, 80)).alias("episodes"), _promo(of("promo")).alias("promo"), chapters(whole).alias("chapters"),
            F.rtrim(F.get(video, F.lit(0)), F.lit(".,;:!?")).alias("video"), _cross_promo(whole).alias("cross_promo"),
        )

    return _let(_let(F.coalesce(plain, F.lit("")), lambda whole: F.struct(whole.alias("whole"), cut(whole).alias("blocks"))), read)


def coverage(blocks: Column) -> dict[str, Column]:
    """Whether each part of a parsed description holds anything."""
    filled = {"topic": blocks["topic"].isNotNull(), "guest": blocks["guest"].isNotNull(), "promo": blocks["promo"].isNotNull(), "video": blocks["video"].isNotNull(), "cross_promo": blocks["cross_promo"].isNotNull()}
    return filled | {k: F.size(blocks[k]) > 0 for k in ("items", "references", "episodes", "chapters")}


def any_part(blocks: Column) -> Column:
    """Whether a parsed description holds anything at all."""
    return any_of(list(coverage(blocks).values()))
