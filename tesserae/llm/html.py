"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks (runs of text between block-level tags) with features of
the ancestors' tags and class names and of the text. The field has two states, main text and
other; it is trained on labelled pages (forward-backward gradients), and Viterbi decodes each page.

Labelled pages are of two kinds: layouts written out below, whose main blocks are marked, and a
bounded sample of the table's own pages whose ``article`` or ``main`` element names the main text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of the table that may train the field, and the bytes of html taken in all.
SAMPLE_PAGES, SAMPLE_BYTES = 150, 2_000_000
OTHER, MAIN = 0, 1
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[/!?a-zA-Z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg")}
#: Form controls whose text is left out; the end of an element around them, or the start of a block, ends them too.
_CONTROLS = frozenset("button datalist option select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open paragraph; of the right-hand ones, an open element of the same name.
_SAME = frozenset("li dt dd tr td th p".split())


def leaf_blocks(html: str) -> list[tuple[str, tuple[str, ...], int]]:
    """Text (references decoded, white space folded), ancestor features and characters inside links, in page order."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0
    in_link = 0
    hidden = False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _BLANK.sub(" ", unescape("".join(text))).strip()
            if whole:
                out.append((whole, stack[-1][1] if stack else (), linked))
            text.clear()
        linked = 0

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.match(html, at)
        token = found[0]
        at = found.end()
        if token[0] != "<" or len(token) == 1:
            if hidden:
                continue
            text.append(token)
            if in_link:
                linked += len(token)
            continue
        named = _NAME.match(token)
        if not named:
            continue
        name = named[1].lower()
        if token[1] == "/":
            if name in _BLOCK:
                flush()
            if name == "a":
                in_link = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    hidden = hidden and any(n in _CONTROLS for n, _ in stack)
                    break
            continue
        if hidden and name in _BLOCK and name not in ("label", "legend"):
            del stack[next(i for i, (n, _) in enumerate(stack) if n in _CONTROLS) :]
            hidden = False
        if name == "br":
            text.append(" ")
        if name in _RAW_END:
            if not token.endswith("/>"):
                closed = _RAW_END[name].search(html, at)
                at = closed.end() if closed else end
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _BLOCK:
            flush()
            closes = {"p"} | ({name} if name in _SAME else set())
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK:
                    break
            in_link = 0
        elif name == "a":
            in_link = 1
        marks = {p for m in _MARKS.finditer(token) for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())} if "=" in token else ()
        above = stack[-1][1] if stack else ()
        if name in _BLOCK or marks:
            mine = dict.fromkeys((*above, *([f"in:{name}"] if name in _BLOCK else ()), *(f"as:{m}" for m in sorted(marks))))
            above = tuple(mine)
        stack.append((name, above))
        hidden = hidden or name in _CONTROLS
    flush()
    return out


def block_features(block: tuple[str, tuple[str, ...], int]) -> list[str]:
    """Names of the block's features: its ancestors, and coarse ones of its text."""
    text, above, linked = block
    share = linked / len(text)
    found = list(above)
    found.append("links:most" if share > 0.6 else "links:some" if share > 0.2 else "links:few")
    found.append("long" if len(text) > 200 else "middling" if len(text) > 60 else "short")
    if text[-1] in ".!?":
        found.append("sentence")
    if "©" in text:
        found.append("copyright")
    return found


class Field:
    """Two-state linear-chain CRF: weights of features by state, and of transitions."""

    def __init__(self) -> None:
        self.weights: dict[str, tuple[float, float]] = {}
        self.moves = np.zeros((2, 2))
        self.first = np.zeros(2)

    def train(self, pages: list[tuple[list[list[str]], list[int]]], steps: int = 100, rate: float = 0.15, decay: float = 2e-3) -> Field:
        """Gradient ascent (Adam) on the pages' mean log likelihood; pages run side by side, padded."""
        names = sorted({f for blocks, _ in pages for b in blocks for f in b})
        index = {f: i for i, f in enumerate(names)}
        n, t = len(pages), max(len(b) for b, _ in pages)
        x = np.zeros((n, t, len(names)), np.float32)
        y, on = np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, (blocks, labels) in enumerate(pages):
            on[i, : len(blocks)] = True
            y[i, : len(labels)] = labels
            for j, b in enumerate(blocks):
                x[i, j, [index[f] for f in b]] = 1
        theta = np.zeros(2 * len(names) + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        gold = np.eye(2)[y] * on[..., None]
        flat = x.reshape(n * t, -1)
        pair_gold = np.einsum("nta,ntb->ab", gold[:, :-1] * on[:, 1:, None], gold[:, 1:])
        logsum = lambda a, axis: np.logaddexp(*np.moveaxis(a, axis, 0))
        for step in range(1, steps + 1):
            w, moves, first = theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
            score = (flat @ w).reshape(n, t, 2)
            ahead, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            ahead[:, 0] = first + score[:, 0]
            for k in range(1, t):
                ahead[:, k] = np.where(on[:, k, None], logsum(ahead[:, k - 1, :, None] + moves, 1) + score[:, k], ahead[:, k - 1])
            for k in range(t - 2, -1, -1):
                back[:, k] = np.where(on[:, k + 1, None], logsum(moves + (score[:, k + 1] + back[:, k + 1])[:, None, :], 2), 0)
            total = logsum(ahead[:, -1], 1)
            mean = np.exp(ahead + back - total[:, None, None]) * on[..., None]
            pair = np.exp(ahead[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - total[:, None, None, None]) * on[:, 1:, None, None]
            grad = np.concatenate([(flat.T @ (gold - mean).reshape(n * t, 2)).ravel(), (pair_gold - pair.sum((0, 1))).ravel(), (gold[:, 0] - mean[:, 0]).sum(0)]) / n - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = theta[: 2 * len(names)].reshape(-1, 2)
        self.weights = {f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}
        self.moves, self.first = theta[-6:-2].reshape(2, 2), theta[-2:]
        return self

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The best sequence of states (Viterbi)."""
        get, none = self.weights.get, (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, features in enumerate(blocks):
            s0 = s1 = 0.0
            for f in features:
                w = get(f, none)
                s0 += w[0]
                s1 += w[1]
            if not k:
                a, b = self.first[0] + s0, self.first[1] + s1
                continue
            from0, from1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
            back.append((from0, from1))
            a, b = max(a + m00, b + m10) + s0, max(a + m01, b + m11) + s1
        state = 0 if a >= b else 1
        path = [state]
        for step in reversed(back):
            state = step[state]
            path.append(state)
        return path[::-1] if blocks else []


#: Parts of labelled layouts: html with ``{w}`` for words; ``+`` before a part marks main text.
_FILL = "so the old mill by the river was opened again and people came from far to see how bread is made there".split()
_ASIDES = [
    '<nav><ul><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li><li><a href="/c">{s}</a></li></ul></nav>',
    '<div class="menu"><a href="/">{s}</a> <a href="/x">{s}</a> <a href="/y">{s}</a></div>',
    '<header class="site-header"><div class="logo">{s}</div><p>{m}</p></header>',
    '<aside class="sidebar"><h3>{s}</h3><p>{l}</p></aside>',
    '<div class="ad"><p>{m}.</p></div>',
    '<div class="ad">{l}.</div>',
    '<div class="advert banner">{m}</div>',
    '<div id="cookie-notice"><p>{l}.</p></div>',
    '<div class="cookie consent notice">{m}.</div>',
    '<form action="/s"><label>{s}</label><p>{m}.</p></form>',
    '<div class="newsletter signup"><form><p>{l}.</p></form></div>',
    '<div class="related promo"><ul><li><a href="/r">{m}</a></li><li><a href="/q">{m}</a></li></ul></div>',
    '<div class="share social"><a href="/f">{s}</a> <a href="/t">{s}</a></div>',
]
_ENDS = [
    '<footer><p>© {m}</p></footer>',
    "<footer>© {s} {m}.</footer>",
    '<div class="footer">{m}</div>',
    '<section class="comments"><h3>{s}</h3><div class="comment"><p>{l}.</p></div><div class="comment reply"><p>{m}.</p></div></section>',
    '<div id="comments"><ol><li><p>{l}.</p></li><li><p>{s}.</p></li></ol></div>',
]
_HOLDERS = ["<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="article content">{}</div>', '<div id="content"><div class="entry post">{}</div></div>', '<section class="story body">{}</section>', '<div class="wrapper"><article>{}</article></div>']
_MAINS = ["<h1>{s}</h1>", "<h2>{s}.</h2>", "<p>{l}.</p>", "<p>{m}.</p>", "<p>{s}.</p>", "<p><b>{m}.<br></b></p>", "<p><b>{l}.<br>", "<p>{s}", "<ul><li>{m}.</li><li>{s}</li></ul>", "<blockquote>{l}.</blockquote>", '<p>{m} <a href="/z">{s}</a> {m}.</p>', "<table><tr><td>{s}</td><td>{m}</td></tr></table>", "<pre>{l}</pre>", "<h1>{l}.</h1>", "<p>{l}"]
_INSIDE = ['<div class="ad">{m}.</div>', '<aside><p>{l}.</p></aside>', '<div class="share">{s}</div>', '<form><p>{m}</p></form>']


def layouts(n: int = 250, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages in many layouts: features of the blocks, and their states."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]

    def filled(part: str) -> str:
        for mark, low, high in (("{s}", 1, 6), ("{m}", 6, 20), ("{l}", 20, 90)):
            while mark in part:
                words = [pick(_FILL) for _ in range(rng.integers(low, high))]
                part = part.replace(mark, " ".join(words).capitalize(), 1)
        return part

    pages = []
    for _ in range(n):
        inside = [(filled(pick(_MAINS)), MAIN) for _ in range(rng.integers(1, 9))]
        if rng.random() < 0.4:
            inside.insert(int(rng.integers(len(inside) + 1)), (filled(pick(_INSIDE)), OTHER))
        before = [(filled(pick(_ASIDES)), OTHER) for _ in range(rng.integers(0, 4))]
        after = [(filled(pick(_ASIDES)), OTHER) for _ in range(rng.integers(0, 2))] + [(filled(pick(_ENDS)), OTHER) for _ in range(rng.integers(0, 3))]
        opened, closed = pick(_HOLDERS).split("{}")
        features, states, html = [], [], "<html><body>"
        # blocks are counted as the page grows: what a part adds is the part's
        for part, state in [*before, (opened, OTHER), *inside, (closed, OTHER), *after]:
            html += part
            more = len(leaf_blocks(html)) - len(states)
            states += [state] * max(0, more)
        features = [block_features(b) for b in leaf_blocks(html)]
        if features:
            pages.append((features, states[: len(features)]))
    return pages


_NOT_MAIN = {"in:nav", "in:aside", "in:footer", "in:form", "in:header", "as:ad", "as:comment", "as:comments"}


def labelled_by_markup(html: str) -> tuple[list[list[str]], list[int]] | None:
    """A page whose own ``article`` or ``main`` element tells its main text; None for other pages."""
    blocks = leaf_blocks(html)
    if not blocks or len(blocks) > 50 or not any("in:article" in b[1] or "in:main" in b[1] for b in blocks):
        return None
    return [block_features(b) for b in blocks], [MAIN if ("in:article" in b[1] or "in:main" in b[1]) and not _NOT_MAIN & set(b[1]) else OTHER for b in blocks]


def train_field(pages: DataFrame) -> Field:
    """A field from the layouts and from a bounded sample of the table's pages, chosen by hash of the html."""
    mark = F.xxhash64("html")
    # a thinned choice first, so that no task sends the driver more than its share of the sample
    thin = F.pmod(mark, F.lit(max(1, pages.count() // (4 * SAMPLE_PAGES)))) == 0
    got = pages.select("html").filter(thin & F.octet_length("html").between(1, SAMPLE_BYTES // 20)).orderBy(mark).limit(SAMPLE_PAGES).collect()
    own, size = [], 0
    for row in got:
        size += len(row[0])
        if size <= SAMPLE_BYTES and (page := labelled_by_markup(row[0])):
            own.append(page)
    return Field().train(layouts() + own)


def extract(field: Field, html: str) -> str:
    """The main text of one page: its main blocks, joined by two line ends."""
    blocks = leaf_blocks(html)
    return "\n\n".join(b[0] for b, s in zip(blocks, field.decode([block_features(b) for b in blocks]), strict=True) if s == MAIN)


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages`` (``page_id`` long, ``url``, ``html``).

    A null or empty html has the empty text, as has a page without main blocks; equal pages have
    equal texts; an empty table gives none; other columns are ignored.
    """
    field = field or train_field(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(field, x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
