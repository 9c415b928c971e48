"""Elements and main parts of pages, against the standard parser and by hand."""

import random
from html.parser import HTMLParser

import pytest

from tesserae.operators import pages as G


class Tree(HTMLParser):
    """Elements of well-formed pages: name, characters, ``p`` inside, and the name of a ``p``'s parent."""

    def __init__(self):
        super().__init__()
        self.open, self.rows = [], []

    def handle_starttag(self, name, attrs):
        if name in G.VOID:
            return
        for e in self.open:
            e["paras"] += name == "p"
        row = {"name": name, "chars": 0, "paras": 0, "parent": len(self.open) and self.open[-1]["at"], "at": len(self.rows)}
        self.rows.append(row)
        self.open.append(row)

    def handle_endtag(self, name):
        if name not in G.VOID:
            assert self.open.pop()["name"] == name

    def handle_data(self, data):
        for e in self.open:
            e["chars"] += len(" ".join(data.split()))


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["some  text\n here", "<p>one <b>two</b></p>", "<br>", "<!-- <div> -->", "x<img src='a'>", ""])
    name = rng.choice(["div", "article", "section", "main", "ul"])
    return f"<{name} class='k{depth}'>" + "".join(nested(rng, depth - 1) for _ in range(rng.randint(0, 4))) + f"</{name}>"


def test_elements(spark):
    rng = random.Random(7)
    pages = [(i, "<body>" + nested(rng, 5) + "</body>") for i in range(60)] + [(60, None), (61, "")]
    got = {}
    rows = G.elements(spark.createDataFrame(pages, "k int, html string"), "k", "html").collect()
    for r in sorted(rows, key=lambda r: (r.k, r.pre)):
        got.setdefault(r.k, []).append(r)
    assert set(got) == set(range(60))
    for i, html in pages[:60]:
        tree = Tree()
        tree.feed(html)
        assert [(r.name, r.chars, r.paras) for r in got[i]] == [(r["name"], r["chars"], r["paras"]) for r in tree.rows]
        at = {r.pre: n for n, r in enumerate(got[i])}
        assert [at[r.parent.pre] for r in got[i] if r.name == "p"] == [r["parent"] for r in tree.rows if r["name"] == "p"]


LONG = "words " * 5
CASES = [
    # an article in an article: the outer one, with its inner one
    (f"<body><p>out</p><article>{LONG}<article>in</article>tail</article></body>", f"{LONG}<article>in</article>tail"),
    # the first article is short, so the main element counts, though a later article is long
    (f"<article>a</article><main>{LONG}<p>m</p></main><article>{LONG}</article>", f"{LONG}<p>m</p>"),
    # none of them: the parent with the most paragraphs, which are not closed; the first of equals
    ("<div><p>1<p>2</div><section><div><p>3<p>4<p>5</div></section><div><p>6</p><p>7</p><p>8</p></div>", "<p>3<p>4<p>5"),
    # too few paragraphs
    ("<div><p>1</p><p>2</p></div>", None),
    # excluded parts, one in another, one that is not closed, scripts, styles and comments
    (f"<nav>n</nav><article>{LONG}<nav>a<div class='x ad y'>b</div>c</nav>d<div class=ad>e</div><div class='adx'>f</div><script>if (a<b) '</p>'</script><style>p</style><!-- <nav> -->g<nav>h</article>i", f"{LONG}d<div class='adx'>f</div>g"),
    # an excluded part that is the whole
    (f"<article><nav>{LONG}</nav></article>", ""),
    # stray end tags and lone brackets
    (f"</article></div>1 < 2<ARTICLE id=a>{LONG}a < b</div></ARTICLE></article>", f"{LONG}a < b</div>"),
    (None, None), ("", None), ("plain", None),
]


def test_main_parts(spark):
    pages = spark.createDataFrame([(i, html, "kept") for i, (html, _) in enumerate(CASES)], "k int, html string, name string")
    got = G.main_parts(pages, "k", "html", ["article", "main"], ["nav", ".ad"], 20)
    assert got.columns == ["k", "html", "name", "content"]
    assert [r.content for r in got.orderBy("k").collect()] == [want for _, want in CASES]


@pytest.mark.parametrize("selector, want", [("div", 3), (".a", 2), ("div.a", 1), ("#i", 1), ("p", 0)])
def test_selectors(spark, selector, want):
    html = """<div class="b a"></div><section class='a'></section><div class=ab id="i"></div><div data-class="a"></div>"""
    rows = G.elements(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html")
    assert rows.filter(G.selected(selector)).count() == want
