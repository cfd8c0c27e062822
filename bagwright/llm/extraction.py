"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

``blocks`` reads a page into leaf blocks: texts between the borders of block-level elements, with
their ancestors' tags and the words of their classes and ids, in time in proportion to the page. The field labels each block as main
text or not, from ancestors, text features and the neighbour's label; ``fit`` trains it by gradient
steps on the likelihood of labelled pages, Viterbi decodes. ``labelled_pages`` makes such pages:
layouts of all common kinds with texts of random words, each block with its label.

Defined results: null html is empty; a page without main text gives an empty string; character
references are decoded, white space in a block is one space, blocks are joined by two line breaks;
a page that ends early is read as far as it goes (an unfinished tag is no text); repeated rows stay;
other columns are ignored by ``extract``; an empty table gives no rows. Pages are read whole.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKETS, EPOCHS, PAGES = 1 << 14, 6, 600

# Fixed values of HTML: elements within a line, elements without content, and elements whose text isn't shown.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template svg math iframe canvas textarea select object audio video".split())
#: Elements that a new one of the same list ends.
SIBLINGS = {t: frozenset(g.split()) for g in ("p", "li", "dt dd", "option", "tr", "td th", "thead tbody tfoot") for t in g.split()}
#: Elements up to which such an end reaches.
HOLDERS = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


@dataclass
class Block:
    text: str
    holder: Element
    linked: int  # characters inside links


class Element:
    """A block-level element: its parent, and the features that it has and none of its ancestors.

    Elements share their ancestors, so a page takes memory in proportion to its size, however deep it is.
    """

    __slots__ = ("depth", "own", "parent", "place", "sum", "tag")

    def __init__(self, tag: str, parent: Element | None, own: tuple[int, ...]):
        self.tag, self.parent, self.own, self.sum = tag, parent, own, None
        self.depth = parent.depth + 1 if parent else 0
        # What only the innermost elements say.
        within = (f"in {tag}",) if tag else ()
        within += (f"in {parent.tag} {tag}",) if parent and parent.tag else ()
        self.place = tuple(map(_bucket, (*within, f"depth {min(self.depth, 8)}")))

    def features(self) -> tuple[int, ...]:
        found, at = list(self.place), self
        while at:
            found += at.own
            at = at.parent
        return tuple(found)

    def evidence(self, weight: list[float]) -> float:
        """The weights of all ``features``; sums along the ancestors are kept."""
        chain, at = [], self
        while at and at.sum is None:
            chain.append(at)
            at = at.parent
        total = at.sum if at else 0.0
        for e in reversed(chain):
            total += sum(map(weight.__getitem__, e.own))
            e.sum = total
        return total + sum(map(weight.__getitem__, self.place))


def _marks(attributes: str) -> tuple[str, ...]:
    return _few_marks(attributes) if len(attributes) < 200 else _all_marks(attributes)


def _all_marks(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _NAMED.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", next(x for x in m.groups() if x is not None))
        found += _WORD.findall(value.lower())
    return tuple(dict.fromkeys(found))


_few_marks = lru_cache(1 << 14)(_all_marks)


@lru_cache(1 << 15)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in their order."""
    out: list[Block] = []
    root = Element("", None, ())
    stack: list[tuple[str, Element, tuple[str, ...]]] = []  # tag, innermost block-level element, its new features
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
    outer: list[int] = [-1]  # places of block-level elements
    seen: set[str] = set()  # features of the elements on the stack
    parts: list[str] = []
    linked = hidden = links = at = 0

    def last(tags) -> int:
        return max([where[t][-1] for t in tags if where.get(t)], default=-1)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else root, linked))
            parts.clear()
            linked = 0

    def enter(tag: str, marks: tuple[str, ...]) -> None:
        nonlocal hidden, links
        above = stack[-1][1] if stack else root
        where[tag].append(len(stack))
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, above, ()))
            return
        new = tuple(f for f in dict.fromkeys((f"tag {tag}", *(f"word {w}" for w in marks if not w.isdigit()))) if f not in seen)
        seen.update(new)
        hidden += tag in HIDDEN
        outer.append(len(stack))
        stack.append((tag, Element(tag, above, tuple(map(_bucket, new))), new))

    def leave(k: int) -> None:
        """Leave all elements from the k-th on."""
        nonlocal hidden, links
        while len(stack) > k:
            tag, _, new = stack.pop()
            where[tag].pop()
            seen.difference_update(new)
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag not in INLINE:
                outer.pop()

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            decoded = html.unescape(piece) if "&" in piece else piece
            parts.append(decoded)
            if links:
                linked += len(decoded)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            tail = page[at:]
            cut = re.search(r"<[/a-zA-Z!?]", tail)  # a tag that never ends
            say(tail[: cut.start()] if cut else tail)
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
                continue
            k = last((tag,))
            if tag in INLINE:
                # An inline end reaches no further than the block that holds it.
                if k > outer[-1]:
                    leave(k)
                continue
            close()
            if k >= 0:
                leave(k)
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                close()
            continue
        if tag in INLINE:
            if not m[3].endswith("/"):
                enter(tag, ())
            continue
        close()
        if tag not in HIDDEN:
            k = last((*SIBLINGS.get(tag, ()), "p"))
            # A paragraph ends only the one that holds it directly; others reach up to their holder.
            if k >= 0 and k > (outer[-1] - 1 if tag == "p" else last(HOLDERS.get(tag, ()))):
                leave(k)
        if tag in _RAW:
            at = _RAW[tag].search(page, at).start()
        if not m[3].endswith("/"):
            if tag == "body":
                leave(where["head"][0] if where["head"] else len(stack))
            enter(tag, _marks(m[3]) if m[3] else ())
    close()
    return out


def said(b: Block, place: int, of: int) -> tuple[int, ...]:
    """Feature buckets of a block itself: its length, links, marks and place."""
    n = len(b.text)
    own = (
        f"length {min(10, n.bit_length())}",
        f"links {4 * min(b.linked, n) // n}",
        f"ends {b.text[-1] in '.!?:;…”\"'}",
        f"commas {min(3, b.text.count(','))}",
        f"sentences {min(3, b.text.count('. '))}",
        f"sign {b.text[0] in '©®|»›'}",
        "first" if not place else "last" if place == of - 1 else "inside",
        f"tag {b.holder.tag} short {n < 40}",
    )
    return tuple(map(_bucket, own))


def features(b: Block, place: int, of: int) -> tuple[int, ...]:
    """All feature buckets of a block: its ancestors' and its own."""
    return b.holder.features() + said(b, place, of)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # buckets: evidence for main text
    move: np.ndarray  # 2 x 2, from label to label


def decode(evidence: list[float], model: Model) -> list[int]:
    """Labels by Viterbi."""
    (oo, om), (mo, mm) = model.move.tolist()
    back, other, main = [], 0.0, 0.0
    for k, e in enumerate(evidence):
        if k:
            a, b = other + oo, main + mo
            c, d = other + om, main + mm
            back.append((a < b, c < d))
            other, main = max(a, b), max(c, d)
        main += e
    if not evidence:
        return []
    labels = [int(main > other)]
    for step in reversed(back):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 7) -> Model:
    """Train on pages of blocks and labels: adaptive gradient steps on the field's log-likelihood."""
    weight, move = np.zeros(BUCKETS), np.zeros((2, 2))
    w_sum, m_sum = np.full(BUCKETS, 1e-2), np.full((2, 2), 1.0)
    ready = [([np.array(features(b, k, len(bs)), np.int64) for k, b in enumerate(bs)], y) for bs, y in pages if bs]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(ready)
        for found, y in ready:
            e = np.array([weight[f].sum() for f in found])
            n = len(e)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = 0, e[0]
            for k in range(1, n):
                ahead[k] = np.logaddexp.reduce(ahead[k - 1][:, None] + move, axis=0) + (0, e[k])
            for k in range(n - 2, -1, -1):
                behind[k] = np.logaddexp.reduce(move + ((0, e[k + 1]) + behind[k + 1]), axis=1)
            whole = np.logaddexp(*ahead[-1])
            chance = np.exp(ahead[:, 1] + behind[:, 1] - whole)
            gap = np.array(y) - chance
            at = np.concatenate(found)
            g = np.bincount(at, np.repeat(gap, [len(f) for f in found]), BUCKETS)
            used = np.unique(at)
            w_sum[used] += g[used] ** 2
            weight[used] += rate * g[used] / np.sqrt(w_sum[used])
            pair = np.zeros((2, 2))
            for k in range(1, n):
                pair[y[k - 1], y[k]] += 1
                pair -= np.exp(ahead[k - 1][:, None] + move + ((0, e[k]) + behind[k]) - whole)
            m_sum += pair**2
            move += rate * pair / np.sqrt(m_sum)
    return Model(weight, move)


class _Maker:
    """Labelled pages of random words in layouts of all common kinds."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.out: list[str] = []

    def words(self, n: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("bcdfglmnprstv") + r.choice("aeiouéü") for _ in range(r.randint(1, 4))) for _ in range(n))

    def sentence(self, n: int) -> str:
        s = self.words(n).capitalize()
        return s.replace(" ", ", ", 1) + self.rng.choice("....?!") if n > 6 else s + self.rng.choice((".", ".", ""))

    def prose(self) -> str:
        return " ".join(self.sentence(self.rng.randint(2, 24)) for _ in range(self.rng.choice((1, 1, 1, 2, 3, 6))))

    def label(self, n: int = 4) -> str:
        return self.words(self.rng.randint(1, n)).title()

    def attribute(self, *names: str) -> str:
        r = self.rng
        kind = r.choice(("class", "id"))
        extra = r.choice(("", " block", " wide", f" {self.words(1)}"))
        return f' {kind}="{r.choice(names)}{extra}"'

    def put(self, tag: str, body: str, attribute: str = "", ends: bool = True) -> str:
        return f"<{tag}{attribute}>{body}" + (f"</{tag}>" if ends else "")

    def links(self, n: int) -> str:
        own = [self.put("a", self.label(3), ' href="/x"') for _ in range(n)]
        style = self.rng.random()
        return self.put("ul", "".join(self.put("li", a) for a in own)) if style < 0.6 else " | ".join(own) if style < 0.8 else "".join(self.put("div", a) for a in own)

    def menu(self) -> str:
        r, body = self.rng, self.links(self.rng.randint(2, 8))
        return r.choice((self.put("nav", body), self.put("nav", body, self.attribute("main-nav", "breadcrumb", "pagination")), self.put("div", body, self.attribute("menu", "navbar", "nav", "navigation", "breadcrumbs", "topnav", "tags", "pager"))))

    def other(self) -> str:
        """Something beside the article."""
        r = self.rng
        text = self.put(r.choice(("p", "div", "span")), r.choice((self.prose(), self.label(8))))
        plain = self.sentence(r.randint(3, 14))
        return r.choice((
            self.menu,
            lambda: self.put("div", plain if r.random() < 0.6 else text, self.attribute("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")),
            lambda: self.put("aside", self.put("h3", self.label()) + text + self.links(3), r.choice(("", self.attribute("sidebar", "related", "widget")))),
            lambda: self.put("div", self.put("h3", self.label()) + text + self.links(2), self.attribute("sidebar", "related", "recommended", "widget", "side", "rail", "trending", "popular", "read-more")),
            lambda: self.put(r.choice(("div", "section")), text + self.put("button", self.label(2)), self.attribute("cookie-notice", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay")),
            lambda: self.put("form", self.put("label", self.label()) + '<input name="q">' + self.put("button", self.label(1)) + text, r.choice(("", self.attribute("search", "newsletter", "subscribe", "signup", "login")))),
            lambda: self.put("div", text, self.attribute("newsletter", "subscribe", "signup", "paywall", "share", "social", "toolbar")),
            lambda: self.comments(),
        ))()

    def comments(self) -> str:
        r = self.rng
        one = lambda: self.put(r.choice(("div", "li", "article")), self.put("span", self.label(2), self.attribute("author", "user")) + self.put("p", self.prose()), self.attribute("comment", "reply", "comment-body"))
        return self.put(r.choice(("section", "div", "ol")), self.put("h3", self.label()) + "".join(one() for _ in range(r.randint(1, 4))), self.attribute("comments", "comment-list", "discussion", "responses", "disqus", "reader-comments"))

    def article(self) -> list[tuple[str, bool]]:
        r, parts = self.rng, []
        title = self.sentence(r.randint(2, 16))
        if r.random() < 0.85:
            parts.append((self.put("h1", title), True))
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            kind = r.random()
            if kind < 0.7:
                parts.append((self.put("p", self.prose(), ends=r.random() < 0.9), True))
            elif kind < 0.76:
                parts.append((self.put("p", f"<b>{self.sentence(5)}<br>", ends=False), True))
            elif kind < 0.82:
                parts.append((self.put(r.choice(("h2", "h3")), self.label(6)), True))
            elif kind < 0.86:
                parts += [("<ul>", True), *((self.put("li", self.prose()), True) for _ in range(3)), ("</ul>", True)]
            elif kind < 0.89:
                parts.append((self.put("blockquote", self.put("p", self.prose())), True))
            elif kind < 0.91:
                parts.append((self.put("pre", self.words(9)), True))
            elif kind < 0.94:
                parts.append((self.put("table", self.put("tr", self.put("td", self.words(3)) + self.put("td", self.words(2)))), True))
            elif kind < 0.96:
                parts.append((self.put("div", self.prose()), True))
            else:
                parts.append((self.other(), False))
        return parts

    def page(self) -> tuple[list[Block], list[int]]:
        r = self.rng
        holder, mark = r.choice((("article", ""), ("article", ""), ("article", self.attribute("post", "entry", "story", "hentry")), ("main", ""), ("div", self.attribute("content", "post", "article", "entry-content", "story-body", "article-body", "main", "body", "text")), ("section", self.attribute("content", "article", "main"))))
        parts: list[tuple[str, bool]] = [(f'<html><head><title>{self.label()}</title><script>var a="<p>{self.words(2)}</p>"</script><style>p{{}}</style></head><body>', False)]
        if r.random() < 0.5:
            parts.append((r.choice((self.put("header", self.put("h1", self.label()) + self.menu()), self.put("div", self.put("p", self.label(6)) + self.menu(), self.attribute("header", "masthead", "top", "site-header")))), False))
        if r.random() < 0.8:
            parts.append((self.menu(), False))
        parts += [(self.other(), False) for _ in range(r.choice((0, 1, 1, 2)))]
        outer = r.choice(("", "", "main", "div"))
        parts.append(((f"<{outer}>" if outer else "") + f"<{holder}{mark}>", False))
        parts += self.article() if r.random() < 0.97 else []
        parts.append((f"</{holder}>" + (f"</{outer}>" if outer else ""), False))
        parts += [(self.other(), False) for _ in range(r.choice((0, 1, 2)))]
        if r.random() < 0.3:
            parts.append((self.comments(), False))
        if r.random() < 0.9:
            said = f"&copy; {self.words(1)}.example &middot; {self.sentence(r.randint(2, 12))}"
            parts.append((r.choice((self.put("footer", said), self.put("footer", self.put("p", said) + self.links(3)), self.put("div", said, self.attribute("footer", "copyright", "legal", "site-footer", "colophon")))), False))
        # Marks that are no white space tell blocks of the article from others once the page is read.
        page = "".join(re.sub(r">([^<]*[^<\s][^<]*)", r">\1" + "\ue000", p) if main else p for p, main in parts)
        if r.random() < 0.1:
            page = page[: r.randint(len(page) // 3, len(page))]
        found = blocks(page)
        labels = [int("\ue000" in b.text) for b in found]
        for b in found:
            b.text = b.text.replace("\ue000", "") or "-"
        return found, labels


def labelled_pages(n: int, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """``n`` made pages as blocks with labels."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


@cache
def trained(n: int = PAGES) -> Model:
    """The field trained on ``n`` labelled pages; always the same."""
    return fit(labelled_pages(n))


def main_text(page: str, model: Model, weight: list[float] | None = None) -> str:
    """The main text of one page."""
    weight = weight or model.weight.tolist()
    found = blocks(page)
    evidence = [b.holder.evidence(weight) + sum(map(weight.__getitem__, said(b, k, len(found)))) for k, b in enumerate(found)]
    return "\n\n".join(b.text for b, label in zip(found, decode(evidence, model)) if label)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # of fixed size
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value.weight.tolist()
        for b in batches:
            texts = [main_text(x.as_py() or "", shared.value, weight) for x in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
