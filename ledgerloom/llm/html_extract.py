"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts, each with its open ancestors. Features of a
block are its ancestors' tags, the roles that their class, id and role names stand for, words that parts of a page say about themselves, and the shape of its text: length, links, end marks,
place in the page. The field is trained on labelled pages (labelled_pages() makes them from a seed; others can be given) by gradient
ascent on the exact likelihood, and the best labelling is found by Viterbi.

Text: scripts, styles, comments, the head and what form controls show are no text; character references are decoded; white space inside a block becomes one
space; blocks of the article are joined in page order by one newline.

Nulls and edge cases: a null html is empty and gives an empty text; markup that breaks off, unclosed tags and stray end tags are read like
a browser would, near enough: an unfinished tag at the end is dropped, an end tag closes what it can; rows are independent, so repeated ones give the
same text; null page_ids and urls are carried; pages of any length are read whole; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import json
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.sources.session import ensure_importable

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed lists of the HTML vocabulary.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button input select option optgroup datalist output".split())
#: Controls: what they show is no text of the page.
CONTROLS = frozenset("button select option optgroup datalist input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_ITSELF = frozenset("li td th tr dt dd option p".split())
LIST_ROOTS = frozenset("ul ol table dl select".split())
TAGS = "article main section nav header footer aside form ul ol li table a p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button label div span dialog details dl address option".split()
#: Fixed lists of the names that sites give to the parts of a page.
ROLES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense adslot dfp",
    "foot": "footer foot copyright legal colophon bottom contentinfo",
    "head": "header masthead topbar logo branding site sitename hero",
    "side": "sidebar aside side rail widget related recommended popular trending complementary more",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe banner overlay warning message",
    "reader": "comment comments commentlist respond reply replies discussion disqus feedback",
    "form": "form search login signup register contact",
    "share": "share sharing social follow",
    "content": "content article post entry story body main text prose markdown",
    "byline": "byline author date meta tags tag published category",
}
#: Fixed list of words that the parts of a page say about themselves.
SAYS = {
    "menu": "home about contact menu next previous page archive", "advert": "advertisement sponsored sponsor promoted ad offer deal", "foot": "copyright rights reserved privacy terms imprint policy sitemap",
    "side": "related popular trending recommended also latest recent more newest", "notice": "cookie cookies consent accept subscribe newsletter browser javascript", "reader": "comment comments reply replies posted says", "form": "search password email login register sign submit",
    "share": "share tweet follow facebook twitter email print",
}
SAYS_OF = {w: role for role, words in SAYS.items() for w in words.split()}
ROLE_OF = {name: role for role, names in ROLES.items() for name in names.split()}


@dataclass
class Block:
    text: str
    path: tuple
    linked: int


@lru_cache(maxsize=4096)
def roles(attrs: str) -> frozenset[str]:
    """Roles that an element's class, id and role names stand for."""
    names = " ".join(next((g for g in m if g), "") for m in NAMED.findall(attrs))
    return frozenset(ROLE_OF[x] for p in PART.findall(names) if (x := p.lower()) in ROLE_OF)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not any(t == "head" for t, _ in stack):
                found.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    def pop(tag: str, within: frozenset | None = None) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if within and stack[i][0] in within:
                return

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not any(t in CONTROLS for t, _ in stack):
            text = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text.strip())

    for m in TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m["close"] or m["close2"]:
            if inline and stack and stack[-1][0] != tag and not any(t == tag for t, _ in stack):
                continue
            pop(tag)
            continue
        if tag in ("body", "article", "main"):
            pop("head")
        if tag in CLOSES_P:
            pop("p", LIST_ROOTS | {"article", "section", "div", "aside", "td", "li", "blockquote"})
        if tag in CLOSED_BY_ITSELF:
            pop(tag, LIST_ROOTS)
        if tag not in VOID:
            attrs = m["attrs"] or m["attrs2"] or ""
            stack.append((tag, roles(attrs) if "=" in attrs else frozenset()))
    take(page[at:])
    flush()
    return found


LENGTHS = (1, 2, 3, 5, 8, 12, 20, 40, 80)
NAMES = [f"tag {t}" for t in TAGS] + [f"in {r}" for r in ROLES] + [f"at {r}" for r in ROLES] + [f"below {r}" for r in ROLES] + [f"own {t}" for t in TAGS] + [f"words>={n}" for n in LENGTHS]
NAMES += ["links some", "links most", "links all", "stop", "colon", "copyright", "digits", "first", "last", "early", "late", "no landmark", "bias"]
NAMES += [f"says {r}" for r in SAYS] + ["says nothing"]
INDEX = {n: i for i, n in enumerate(NAMES)}
LANDMARKS = frozenset("article main nav header footer aside form".split())


@lru_cache(maxsize=16384)
def path_features(path: tuple) -> tuple[int, ...]:
    """Features of the open ancestors."""
    out = {INDEX[f"tag {t}"] for t, _ in path if f"tag {t}" in INDEX}
    out |= {INDEX[f"in {r}"] for _, rs in path for r in rs}
    if named := next((rs for _, rs in reversed(path) if rs), None):
        out |= {INDEX[f"at {r}"] for r in named}
    core = max((i for i, (t, rs) in enumerate(path) if t in ("article", "main") or "content" in rs), default=len(path))
    out |= {INDEX[f"below {r}"] for _, rs in path[core + 1 :] for r in rs}
    own = next((t for t, _ in reversed(path) if t not in INLINE), None)
    if f"own {own}" in INDEX:
        out.add(INDEX[f"own {own}"])
    if not any(t in LANDMARKS for t, _ in path):
        out.add(INDEX["no landmark"])
    return tuple(sorted(out | {INDEX["bias"]}))


def text_features(block: Block, i: int, n: int) -> list[int]:
    """Features of the text and its place."""
    text, words = block.text, block.text.count(" ") + 1
    out = [INDEX[f"words>={k}"] for k in LENGTHS if words >= k]
    share = block.linked / len(text)
    out += [INDEX[x] for x, yes in (("links some", share > 0.1), ("links most", share > 0.5), ("links all", share > 0.9), ("stop", text[-1] in ".!?…。\"”»"), ("colon", text[-1] in ":|»>"), ("copyright", "©" in text), ("first", i == 0), ("last", i == n - 1), ("early", i < 0.15 * n), ("late", i >= 0.85 * n)) if yes]
    said = {SAYS_OF[w] for x in text.lower().split()[:40] if (w := x.strip(".,:;!?()|\u00ab\u00bb\"'")) in SAYS_OF} if words <= 40 else ()
    out += [INDEX[f"says {r}"] for r in said] or [INDEX["says nothing"]]
    if words < 12 and 2 * sum(c.isdigit() for c in text) > len(text):
        out.append(INDEX["digits"])
    return out


@dataclass
class Field:
    """Weights of features for the label 'article', of the transitions and of the first label."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES)))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi over the scores of label 1 against 0."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for s in scores[1:]:
            from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11) + s
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def scores(self, found: list[Block]) -> list[float]:
        w, n = self.weights.tolist(), len(found)
        return [sum([w[k] for k in path_features(b.path)]) + sum([w[k] for k in text_features(b, i, n)]) for i, b in enumerate(found)]

    def extract(self, page: str) -> str:
        found = blocks(page)
        if not found:
            return ""
        return "\n".join(b.text for b, keep in zip(found, self.decode(self.scores(found))) if keep)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 250, rate: float = 0.1, decay: float = 2e-5) -> Field:
    """Maximum likelihood with weight decay: forward and backward sums over all pages at once, Adam steps."""
    pages = [p for p in pages if p[0]]
    most, d = max(len(b) for b, _ in pages), len(NAMES)
    x, y, real = np.zeros((len(pages), most, d)), np.zeros((len(pages), most), int), np.zeros((len(pages), most), bool)
    for p, (found, labels) in enumerate(pages):
        for i, b in enumerate(found):
            x[p, i, [*path_features(b.path), *text_features(b, i, len(found))]] = 1
        y[p, : len(labels)], real[p, : len(labels)] = labels, True
    both = real[:, 1:]
    counts = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    first = np.array([(y[:, 0] == a).sum() for a in (0, 1)], float)
    gold = np.einsum("ptd,pt->d", x, y * real)
    theta = np.zeros(d + 6)
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), real.sum()
    for step in range(1, rounds + 1):
        w, steps, start = theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :]
        s = np.stack((np.zeros(y.shape), x @ w), axis=2)
        alpha = np.zeros(s.shape)
        alpha[:, 0] = start + s[:, 0]
        for t in range(1, most):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + steps[0], alpha[:, t - 1, 1, None] + steps[1]) + s[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta, pair = np.zeros(s.shape), np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            ahead = s[:, t + 1] + beta[:, t + 1]
            joint = np.exp(alpha[:, t, :, None] + steps + ahead[:, None] - z[:, None, None])
            pair += joint[real[:, t + 1]].sum(0)
            new = np.logaddexp(steps[:, 0] + ahead[:, 0, None], steps[:, 1] + ahead[:, 1, None])
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * real
        begin = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None]).sum(0)
        grad = np.concatenate((gold - np.einsum("ptd,pt->d", x, one), (counts - pair).ravel(), first - begin)) / total - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :])


MARK = ""


def labelled_pages(n: int = 600, seed: int = 11, nameless: float = 0.25) -> Iterator[str]:
    """Made-up pages whose article blocks start with MARK. Their parts, names, order, nesting and damage vary; on the share `nameless` of the pages names mean nothing."""
    r = random.Random(seed)
    hidden, cue = False, None
    syllables = lambda: "".join(r.choice("ka to re mi sel or an the ing é ß xu ov li".split()) for _ in range(r.randint(1, 4)))
    # parts of a page use words of their own now and then, the article any of them seldom
    word = lambda: r.choice(SAYS[cue].split()) if cue in SAYS and r.random() < 0.12 else r.choice([*SAYS_OF]) if r.random() < 0.006 else syllables()
    words = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    sentence = lambda lo, hi: words(lo, hi).capitalize() + r.choice("..... !?,")
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'

    def about(role: str):
        """What is made inside speaks of this role."""

        def wrap(make):
            def inner() -> str:
                nonlocal cue
                before, cue = cue, role
                made = make()
                cue = before
                return made

            return inner

        return wrap

    def named(tag: str, role: str, inner: str, plain: float = 0.3) -> str:
        name = r.choice(ROLES[role].split()) if not hidden else syllables()
        name = r.choice((name, f"{word()}-{name}", f"{name}-{word()}", f"{name} {word()}", f"{word()}_{name}"))
        attr = "" if tag not in ("div", "section", "ul", "p", "span") and r.random() < plain else f' {r.choice(("class", "class", "id"))}="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links() -> str:
        return r.choice(("<ul>{}</ul>", "{}", "<div>{}</div>", "<ol>{}</ol>")).format("".join(r.choice(("<li>{}</li>", "<li>{}</li>", "<p>{}</p>", "{} | ")).format(link()) for _ in range(r.randint(2, 9))))

    def prose(lo: int = 1, hi: int = 40) -> str:
        return "".join(f"<p>{sentence(lo, hi)}</p>" for _ in range(r.randint(1, 3)))

    @about("reader")
    def reader() -> str:
        one = lambda: f'<{(t := r.choice(("div", "li", "p")))}><b>{word()}</b> {r.choice(("", "<br>"))}{sentence(2, 40)}</{t}>'
        return named(r.choice(("section", "div", "ul", "aside")), "reader", r.choice(("", f"<h3>{words(1, 3)}</h3>")) + "".join(one() for _ in range(r.randint(1, 6))))

    @about("advert")
    def advert() -> str:
        return named(r.choice(("div", "div", "aside", "section", "p", "span")), "advert", r.choice((sentence(2, 30), prose(), link(), f"<p>{sentence(3, 20)}{link()}</p>")))

    @about("notice")
    def notice() -> str:
        return named(r.choice(("div", "section", "dialog", "p", "aside")), "notice", r.choice((sentence(3, 30), prose(3, 30), f"<p>{sentence(4, 30)}</p><button>{words(1, 2)}</button>")))

    @about("form")
    def form() -> str:
        return named("form" if r.random() < 0.8 else "div", "form", f"<label>{words(1, 3)}</label><input name=q>" * r.randint(1, 4) + r.choice((f"<p>{sentence(2, 15)}</p>", "")) + f"<button>{words(1, 2)}</button>")

    @about("side")
    def side() -> str:
        return named(r.choice(("aside", "div", "section", "aside")), "side", f"<h3>{words(1, 4)}</h3>" + r.choice((links(), prose(), links() + prose())))

    @about("menu")
    def menu() -> str:
        return named(r.choice(("nav", "nav", "ul", "div")), "menu", links())

    @about("head")
    def head() -> str:
        return named(r.choice(("header", "header", "div")), "head", r.choice((f"<h1>{words(1, 4)}</h1>", f"<div>{words(1, 5)}</div>", f"<p>{sentence(2, 10)}</p>", link())) + r.choice(("", menu(), form())))

    @about("foot")
    def foot() -> str:
        return named(r.choice(("footer", "footer", "div")), "foot", r.choice((f"&copy; {word()} &middot; {sentence(2, 12)}", f"<p>© 20{r.randint(10, 29)} {words(1, 6)}</p>" + links(), prose(2, 20), sentence(2, 10))))

    @about("share")
    def share() -> str:
        return named("div", "share", links())

    def article() -> str:
        own = lambda lo, hi: MARK + r.choice((sentence, sentence, words))(lo, hi)
        inside = lambda: r.choice((own(1, 12), own(1, 3), own(8, 90), own(20, 60) + r.choice(("", f" {link()} {words(1, 20)}", f"<b>{words(1, 3)}</b> {words(0, 9)}", f"<br>{words(1, 9)}"))))
        body = [f"<h1>{own(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 4, 8, 14, 25))):
            kind = r.random()
            if kind < 0.78:
                body.append(r.choice((f"<p>{inside()}</p>", f"<p>{inside()}</p>", f"<p>{inside()}", f"<p><b>{inside()}<br>", f"<div>{inside()}</div>")))
            elif kind < 0.86:
                body.append(f"<h{(k := r.randint(2, 4))}>{own(1, 8)}</h{k}>")
            elif kind < 0.91:
                body.append("<ul>" + "".join(f"<li>{inside()}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.94:
                body.append(f"<blockquote>{inside()}</blockquote>")
            elif kind < 0.96:
                body.append("<table>" + "".join(f"<tr><td>{own(1, 3)}</td><td>{own(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                body.append(f"<pre>{own(2, 20)}</pre>")
            else:
                body.append(r.choice((advert, notice, share, side, form))())
        if r.random() < 0.15:
            body.append(r.choice((reader, share, side))())
        inner = "".join(body)
        shape = r.random()
        if shape < 0.55:
            return f"<article>{inner}</article>"
        if shape < 0.7:
            return f"<main>{r.choice(('{}', '<article>{}</article>', '<div>{}</div>')).format(inner)}</main>"
        if shape < 0.95:
            return named(r.choice(("div", "section", "div")), "content", inner)
        return f"<div>{inner}</div>"

    for _ in range(n):
        hidden = r.random() < nameless
        before = [f() for f in (head, menu, advert, notice, side, form) if r.random() < 0.45]
        after = [f() for f in (side, reader, advert, notice, foot, share, form, menu) if r.random() < 0.4]
        r.shuffle(before)
        page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(before) + article() + "".join(after) + "</body></html>"
        yield page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.08 else page


def parsed(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a labelled page."""
    found = blocks(page)
    labels = [int(MARK in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(MARK, "") or "-"
    return found, labels


#: The weights that train() gives for labelled_pages(), with the features they belong to; `python -m ledgerloom.llm.html_extract` fits and writes them anew.
FITTED = Path(__file__).with_name("html_field.json")


def as_json(model: Field) -> str:
    rounded = lambda a: np.round(a, 4).tolist()
    return json.dumps({"weights": dict(zip(NAMES, rounded(model.weights))), "steps": rounded(model.steps), "start": rounded(model.start)}, indent=0)


@lru_cache(maxsize=2)
def default_field() -> Field:
    """The field of labelled_pages(): as fitted before, or trained if its features are others now."""
    if FITTED.exists():
        kept = json.loads(FITTED.read_text())
        if list(kept["weights"]) == NAMES:
            return Field(np.array(list(kept["weights"].values())), np.array(kept["steps"]), np.array(kept["start"]))
    return train([parsed(p) for p in labelled_pages()])


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    spark = pages.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model or default_field())  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                made = [shared.value.extract(x or "") for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


if __name__ == "__main__":
    FITTED.write_text(as_json(train([parsed(p) for p in labelled_pages()])))
