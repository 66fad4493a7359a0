"""Main-text extraction from HTML: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is read into a tree of block elements. The trees score each node from subtree density, attribute tokens, depth
and sibling statistics. Decoding then chooses, from the leaves up, whether a node's whole subtree is kept, or dropped,
or whether its children decide; so no kept node has a dropped ancestor choice above it, nor the other way round.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, bounded_sample, table
from .gbt import Trees, fit

SAMPLE_PAGES = 250  # pages whose semantic elements label nodes for training: the smallest by a hash of the html
MADE_PAGES = 800  # labelled pages made from templates, so that pages without semantic elements are known too

_RAW = "script|style|title|noscript|template|textarea|iframe|svg|select|canvas|object|audio|video"
_NAMED = r"(?=[\s/>]|\Z)"  # the end of a tag's name; a hyphen goes on to a custom element's
_TOKEN = re.compile(
    # <svg/> holds nothing; a slash at the end of an unquoted value belongs to the value
    rf"<!--.*?(?:-->|\Z)|<svg{_NAMED}(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+(?=\s)))*+(?<=/)>"
    rf"|<(?P<raw>{_RAW}){_NAMED}[^>]*+(?:>.*?(?:</(?P=raw){_NAMED}[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:\b(class|id|role|data-y)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta meter q s samp small "
    "span strike strong sub sup time tt u var wbr br button output picture source track param area base col embed rp rt ruby "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction menclose semantics annotation annotation-xml".split()
)
_VOID = frozenset("hr".split())
_CLOSES_P = frozenset("p".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer form body".split())

_TAGS = [("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("article", "main"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "tr", "td", "th"), ("div", "section"), ("pre", "blockquote", "figure", "figcaption"), ("body", "html")]
_TAG_OF = {t: i for i, ts in enumerate(_TAGS) for t in ts}
_CUES = [
    "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "header masthead topbar banner logo", "footer foot copyright colophon legal", "sidebar side aside widget rail related recommended trending popular more tags",
    "cookie cookies notice consent gdpr alert popup modal overlay", "comment comments reply replies respond disqus discussion", "form login search newsletter subscribe signup share social",
    "article content post entry body main text story prose maincontent",
]
_CUE_OF = {w: i for i, ws in enumerate(_CUES) for w in ws.split()}
N_FEATURES = len(_TAGS) * 2 + len(_CUES) * 2 + 20


class Made(str):
    """A page made from templates; only in these does data-y label an element."""


class Node:
    __slots__ = ("chars", "cues", "depth", "feats", "kids", "label", "links", "parent", "punct", "segs", "start", "tag", "tags", "up_cues", "up_tags", "words")

    def __init__(self, tag: str, parent: Node | None, attrs: str, made: bool = False):
        self.tag, self.parent, self.kids, self.segs = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.words = self.links = self.punct = self.start = 0
        self.tags = 1
        self.cues = [0.0] * len(_CUES)
        self.label = parent.label if parent else None
        if attrs and "=" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                value = a or b or c
                if name.lower() == "data-y":
                    if made:
                        self.label = int(value)
                    continue
                for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                    k = _CUE_OF.get(word)
                    if k is not None:
                        self.cues[k] = 1.0
        kind = _TAG_OF.get(tag)
        own = [0.0] * len(_TAGS)
        if kind is not None:
            own[kind] = 1.0
        self.up_tags = [max(x, y) for x, y in zip(parent.up_tags, own)] if parent else own
        self.up_cues = [max(x, y) for x, y in zip(parent.up_cues, self.cues)] if parent else list(self.cues)
        self.feats = own
        if parent:
            parent.kids.append(self)


def _set_text(node: Node, parts: list[str], links: int, at: int) -> None:
    raw = "".join(parts)
    text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
    if text:
        node.segs.append((at, len(node.kids), text, links))


def parse(page: str) -> Node:
    """The tree of block elements. Text belongs to the nearest block, in segments between child blocks; <br> and other
    white space become one space; elements of _RAW (scripts, styles, titles, drawings, ...) and comments hold no text."""
    root = node = Node("html", None, "")
    labels = isinstance(page, Made)
    parts: list[str] = []
    links = anchor = at = order = 0

    def flush() -> None:
        nonlocal links, order
        if parts:
            _set_text(node, parts, links, order)
            order += 1
            parts.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchor:
                links += len(piece)
        at = m.end()
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(m.group("end"))
        if tag in _INLINE:
            if tag == "a":
                anchor = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            node.tags += not closing
            continue
        flush()
        anchor = 0
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in ("html", "body", "head") and node.parent is None:
            if tag == "body":
                node = Node("body", root, m.group("attrs"), labels)
            continue
        if tag in ("html", "body", "head"):
            continue
        if node.tag == "p":
            node = node.parent
        same, up = _SAME.get(tag), node
        if same:
            while up is not None and up.tag not in _SCOPE and up.tag not in same:
                up = up.parent
            if up is not None and up.tag in same:
                while up.parent is not None and up.parent.tag in same and up.tag != tag:
                    up = up.parent
                node = up.parent
        made = Node(tag, node, m.group("attrs"), labels)
        made.start = order
        if tag not in _VOID:
            node = made
    if at < len(page):
        parts.append(page[at:])
    flush()
    return root


def _nodes(root: Node) -> list[Node]:
    """Parents before children, with the totals of each subtree."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.kids
    for n in reversed(out):
        for _, _, t, k in n.segs:
            n.chars += len(t)
            n.words += t.count(" ") + 1
            n.links += min(k, len(t))
            n.punct += t.count(".") + t.count(",") + t.count("?") + t.count("!") + t.count(";")
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.words += n.words
            p.links += n.links
            p.punct += n.punct
            p.tags += n.tags
    return out


def features(nodes: list[Node]) -> np.ndarray:
    page = max(1, nodes[0].chars)
    rows = []
    last = max((s[0] for n in nodes for s in n.segs), default=0) + 1
    place = {id(nodes[0]): (0, 1)}  # place among the siblings, and how many of them have the same tag
    for n in nodes:
        tags = Counter(k.tag for k in n.kids)
        place.update((id(k), (at, tags[k.tag])) for at, k in enumerate(n.kids))
    for n in nodes:
        p = n.parent
        sib = p.kids if p else [n]
        at, alike = place[id(n)]
        own = sum(len(s[2]) for s in n.segs)
        c = max(1, n.chars)
        prev, nxt = (sib[at - 1].chars if at else 0), (sib[at + 1].chars if at + 1 < len(sib) else 0)
        up_links = p.links / max(1, p.chars) if p else 0.0
        rows.append(
            n.feats + n.up_tags + n.cues + n.up_cues
            + [n.chars, n.words, own, n.links / c, n.punct / c, n.tags, c / n.tags, n.chars / max(1, n.words), n.depth, at, len(sib), alike / len(sib),
               n.chars / max(1, p.chars if p else n.chars), n.chars / page, prev, nxt, up_links, n.start / last, len(n.kids), p.chars if p else page]
        )
    return np.array(rows, np.float64)


def decode(nodes: list[Node], score: np.ndarray) -> str:
    """The kept segments in page order: per node the best of keeping the subtree, dropping it, or letting children
    decide (its own segments then stand like a child of its score)."""
    p = np.clip(score, 1e-4, 1 - 1e-4)
    weight = np.log1p([n.chars for n in nodes])
    keep, drop = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
    index = {id(n): i for i, n in enumerate(nodes)}
    best, choice = [0.0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        kids = [index[id(k)] for k in n.kids]
        own = max(keep[i], drop[i]) if n.segs else 0.0
        mixed = own + sum(best[k] for k in kids) if kids else -np.inf
        keep[i] += sum(keep[k] for k in kids)
        drop[i] += sum(drop[k] for k in kids)
        best[i], choice[i] = max((keep[i], 1), (drop[i], 0), (mixed, 2))
    kept, todo = [], [(nodes[0], choice[0])]
    while todo:
        n, c = todo.pop()
        if c == 0:
            continue
        if c == 1 or p[index[id(n)]] >= 0.5:
            kept += n.segs
        todo += [(k, 1 if c == 1 else choice[index[id(k)]]) for k in n.kids]
    kept.sort(key=lambda s: s[0])
    return "\n".join(s[2] for s in kept)


_BOILER = frozenset("nav header footer aside form".split())


def label_by_elements(nodes: list[Node]) -> None:
    """Labels from semantic elements: 1 within article or main, 0 within navigation, header, footer, aside, form or
    an advert; nodes within neither, and nodes that hold both, get none."""
    for n in nodes:
        up = n.parent.label if n.parent else None
        n.label = up
        if n.tag in ("article", "main"):
            n.label = 1
        if n.tag in _BOILER or n.cues[0] or n.cues[5] or n.cues[6]:
            n.label = 0


def labelled(nodes: list[Node]) -> list[int]:
    """Nodes with text and a label that all of their descendants with text share."""
    pure = {}
    for n in reversed(nodes):
        kids = [pure[id(k)] for k in n.kids if k.chars]
        pure[id(n)] = n.label is not None and all(k is not False and k == (n.label,) for k in kids) and (n.label,)
    return [i for i, n in enumerate(nodes) if n.chars and pure[id(n)]]


LAYOUTS = ("article", "main", "named", "named", "plain", "wrapped", "section", "table", "bare", "nested")


def made_page(r: Random, layout: str | None = None) -> Made:
    """A page in one of many layouts (of LAYOUTS, drawn if none is given); data-y gives the label of each block. In the
    last six nothing names the article: it stands in plain containers, in a table's cell or right in the body."""
    syll = ["th", "an", "er", "tion", "re", "ou", "le", "que", "ar", "os", "en", "ung", "sch", "ment", "in", "ed"]
    word = lambda: "".join(r.choices(syll, k=r.choice([1, 1, 2, 2, 3, 4])))
    line = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: (lambda s: s[0].upper() + s[1:] + r.choice([".", ".", ".", "?", "!"]))(line(r.randint(1, 18)))
    para = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8, 12])))
    cls = lambda words: f' {r.choice(["class", "class", "id"])}="{r.choice(words.split())}"' if r.random() < 0.8 else ""
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(r.randint(1, 3))}</a></li>' for _ in range(n))
    layout = layout or r.choice(LAYOUTS)
    unnamed = layout in LAYOUTS[4:] and r.random() < 0.5  # menus and footers then have no telling names either

    def box(tags: str, words: str, body: str, y: int) -> str:
        t = r.choice(tags.split())
        if unnamed and y == 0 and t != "form":
            return f'<div{r.choice(["", "", f' class="{word()}"'])} data-y="0">{body}</div>'
        c = cls(words) if t == "div" else (cls(words) if r.random() < 0.3 else "")
        if t == "div" and not c:
            c = f' class="{r.choice(words.split())}"'
        return f'<{t}{c} data-y="{y}">{body}</{t}>'

    def named(words: str, body: str, tags: str = "div") -> str:
        t = r.choice(tags.split())
        return f'<{t} {r.choice(["class", "class", "id"])}="{r.choice(words.split())}" data-y="0">{body}</{t}>'

    def note(words: str, tags: str = "div") -> str:
        return named(words, r.choice([line(r.randint(2, 12)), f"<p>{para()}</p>", f"<ul>{links(r.randint(2, 6))}</ul>", f"<h3>{line(2)}</h3><p>{sentence()}</p>"]), tags)

    def comments() -> str:
        one = lambda: r.choice(["<div class=\"comment\"><b>{0}</b><p>{1}</p></div>", "<p>{1}</p>", "<li><p>{0}</p><p>{1}</p></li>", "<div><span>{0}</span> {1}</div>", "<blockquote>{1}</blockquote>"]).format(word(), para())
        body = "".join(one() for _ in range(r.choice([1, 2, 3, 5, 12, 40])))
        return named("comments comment replies comment-list disqus discussion respond", (f"<h2>{line(2)}</h2>" if r.random() < 0.6 else "") + body, "div div section aside ol")

    def blocks() -> list[str]:
        out = [f"<h1>{line(r.randint(2, 9))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 8, 8, 15, 15, 60 if r.random() < 0.3 else 25])):
            k = r.random()
            if k < 0.7:
                out.append(f"<p>{para()}</p>" if r.random() < 0.8 else f"<p><b>{para()}<br>")
            elif k < 0.78:
                out.append(f"<h2>{line(4)}</h2>")
            elif k < 0.85:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote>{para()}</blockquote>")
            elif k < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{line(2)}</td><td>{line(2)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(note(r.choice(["ad advert sponsored", "related share", "newsletter"])))
        if r.random() < 0.4:
            out.append(comments())
        return out

    def article() -> str:
        held = blocks()
        text = "".join(held)
        noise = f' class="{r.choice(["wrapper", "container", "page", "row", "col", "inner", "box", word(), word()])}"'
        if layout in ("article", "main", "section"):
            return f'<{layout}{cls("content post entry") if layout == "main" else ""} data-y="1">{text}</{layout}>'
        if layout == "named":
            return box("article div div", "content post entry article main story", text, 1)
        if layout == "plain":
            return f'<div data-y="1">{text}</div>'
        if layout == "wrapped":
            return f'<div{noise} data-y="1">{text}</div>'
        if layout == "table":
            side = box("div", "menu sidebar", f"<ul>{links(r.randint(2, 7))}</ul>", 0) if r.random() < 0.7 else ""
            return f'<table><tr>{f"<td>{side}</td>" if side else ""}<td data-y="1">{text}</td></tr></table>'
        if layout == "nested":
            return f'<div><div{noise}><div data-y="1">{text}</div></div></div>'
        return "".join(h if "data-y" in h[: h.index(">")] else re.sub(r"^<(\w+)", r'<\1 data-y="1"', h) for h in held)

    head = []
    if r.random() < 0.9:
        head.append(box("nav div", "nav menu navbar", f"<ul>{links(r.randint(3, 9))}</ul>", 0))
    if r.random() < 0.5:
        head.insert(r.randint(0, len(head)), note("header masthead", "header div") if unnamed else box("header div", "header masthead", f"<h1>{line(2)}</h1><p>{sentence()}</p>", 0))
    if r.random() < 0.5:
        head.append(note("cookie notice banner"))
    if r.random() < 0.6:
        head.append(note("ad ads advert sponsored"))
    main = article()
    tail = [f() for f, q in ((comments, 0.4), (lambda: note("sidebar widget related", "aside div"), 0.5), (lambda: note("ad promo"), 0.3)) if r.random() < q]
    if r.random() < 0.3:
        tail.append(box("form div", "form newsletter login", f"<p>{sentence()}</p><label>{word()}</label>", 0) if not unnamed else f'<form data-y="0"><p>{sentence()}</p><label>{word()}</label></form>')
    r.shuffle(tail)
    if r.random() < 0.9:
        body = f"&copy; {line(r.randint(2, 9))}."
        tail.append(named("footer copyright", body) if unnamed or r.random() < 0.3 else box("footer div", "footer copyright", body, 0))
    if r.random() < 0.3:
        main = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{main}{"".join(tail[:1])}</div>'
        tail = tail[1:]
    return Made(f"<html><head><title>{line(3)}</title></head><body>{''.join(head)}{main}{''.join(tail)}</body></html>")


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, made: int = MADE_PAGES) -> Trees:
    """Trees over the nodes of a bounded sample of pages, labelled by their elements, and of made pages."""
    picked = bounded_sample(pages.select("html").where(F.length("html") > 0), sample, "html")
    xs, ys = [], []
    for i, page in enumerate([r["html"] for r in picked.collect()] + [made_page(Random(k)) for k in range(made)]):
        nodes = _nodes(parse(page))
        if not isinstance(page, Made):
            label_by_elements(nodes)
        use = labelled(nodes)
        if use:
            xs.append(features(nodes)[use])
            ys += [nodes[k].label for k in use]
    return fit(np.concatenate(xs), np.array(ys, float), trees=60, depth=4)


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """pages with _text, the main text of the whole html, blocks joined by line feeds. Null and empty pages, and pages
    without main text, give the empty string; where keeping and dropping a subtree score alike it is kept; repeated rows
    fare alike; one row per input row; all columns are kept, but for one named _text, which is replaced."""
    held = pages.sparkSession.sparkContext.broadcast(trees)

    def extracted(b: pa.RecordBatch) -> list[pa.Array]:
        out: list[str] = []
        htmls = [x or "" for x in b.column("html").to_pylist()]
        for i in range(0, len(htmls), 64):
            trees_of = [_nodes(parse(h)) for h in htmls[i : i + 64]]
            score = held.value.score(np.concatenate([features(n) for n in trees_of]))
            at = 0
            for nodes in trees_of:
                out.append(decode(nodes, score[at : at + len(nodes)]))
                at += len(nodes)
        return [pa.array(out, pa.string())]

    return appended(pages, extracted, "_text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, train(pages))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
