"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element has a hidden state, content or not. Its own evidence (tag, words of class, id and role, length and
link share of its text, tag with link share) gives a node potential; a parent and its child share a potential of two states each.
Sum-product messages go up the tree and down again and leave exact marginals; the text under an element is kept if
its marginal is at least one half. Potentials are counts on labelled pages (``labelled_pages`` makes a set; any
pages that carry ``data-content`` attributes will do).

Cases: null html is empty and gives the empty text, as do pages without content. Broken markup never raises: open
elements end with the page, stray end tags are ignored, a ``<`` that begins no tag is text. Repeated rows and very
long pages are rows like others. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp math mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle semantics".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: A start tag ends these open elements, searched up to the elements after them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|data-content)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\f\r\v]+")
_BLOCK_END = "\n"


class Node:
    __slots__ = ("tag", "words", "parent", "children", "label", "chars", "links", "inline")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children, self.label = tag, parent, [], None
        self.words: set[str] = set()
        self.chars = self.links = 0
        self.inline = tag in INLINE
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value = a or b or c
            if name.lower() == "data-content":
                self.label = value == "1"
            else:
                self.words.update(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements in page order (parents first) and the pieces of text with the block each stands in.

    Inline elements belong to their block. Contents of raw elements (scripts, styles, titles, ...) are no text.
    """
    root = Node("#page", None)
    nodes, pieces = [root], []
    open_: list[tuple[str, Node]] = [("#page", root)]  # inline elements stand here with their block
    at: dict[str, list[int]] = defaultdict(list)  # where the open elements of each name stand in it
    blocks = [0]  # where the open blocks stand
    links = 0  # open links

    def text(raw: str) -> None:
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            block = open_[-1][1]
            pieces.append((block, said))
            n = len(said.strip())
            block.chars += n
            block.links += n * (links > 0)

    def close(upto: int) -> None:
        nonlocal links
        if blocks[-1] >= upto:
            pieces.append((open_[-1][1], _BLOCK_END))
        for name, _ in reversed(open_[upto:]):
            at[name].pop()
            links -= name == "a"
        while blocks[-1] >= upto:
            blocks.pop()
        del open_[upto:]

    def highest(names: Iterable[str]) -> int:
        return max((at[n][-1] for n in names if at[n]), default=0)

    cursor, last = 0, page.rfind(">")
    while cursor <= last and (m := _TAG.search(page, cursor)) is not None:  # behind the last > there is no tag
        text(page[cursor : m.start()])
        cursor = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            # an end tag closes the nearest such element; one of an inline element does not reach out of its block
            if at[tag] and not (tag in INLINE and at[tag][-1] < blocks[-1]):
                close(at[tag][-1])
            continue
        if tag == "br" or tag == "hr":
            pieces.append((open_[-1][1], _BLOCK_END))
        if tag in VOID:
            continue
        if tag in RAW:
            end = _end_of(tag).search(page, cursor)
            cursor = end.end() if end else len(page)
            continue
        stop = _IN_P if tag in CLOSES_P else ENDS.get(tag)
        if stop and highest(stop[0]) > highest(stop[1]):
            close(highest(stop[0]))
        parent = open_[-1][1]
        at[tag].append(len(open_))
        if tag in INLINE:
            links += tag == "a"
            open_.append((tag, parent))
        else:
            blocks.append(len(open_))
            node = Node(tag, parent, m[3])
            nodes.append(node)
            pieces.append((parent, _BLOCK_END))
            open_.append((tag, node))
    rest = page[cursor:]
    text(rest if not (cut := _OPEN_COMMENT.search(rest)) else rest[: cut.start()])
    for node in reversed(nodes[1:]):  # children come after their parents
        node.parent.chars += node.chars
        node.parent.links += node.links
    return nodes, pieces


_IN_P = ({"p"}, {"table", "td", "th", "button", "object"})
_OPEN_COMMENT = re.compile("<!--")


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


def features(node: Node) -> Iterator[str]:
    yield f"tag={node.tag}"
    for w in node.words:
        yield f"word={w}"
    size = min(12, node.chars.bit_length())
    share = -1 if not node.chars else min(4, 5 * node.links // node.chars)
    yield f"text={size // 2},{share}"
    yield f"tag={node.tag},{share}"


class Model:
    """Node and edge potentials as logarithms of smoothed counts on labelled pages."""

    def __init__(self, pages: Iterable[str], alpha: float = 0.5):
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        states = [0.0, 0.0]
        edges = [[alpha, alpha], [alpha, alpha]]
        for page in pages:
            nodes, _ = parse(page)
            for node in nodes:
                if node.label is None:
                    node.label = node.parent.label if node.parent else True
                states[node.label] += 1
                if node.parent:
                    edges[node.parent.label][node.label] += 1
                for f in features(node):
                    seen[f][node.label] += 1
        self.node = {f: tuple(math.log((n + alpha) / (s + 2 * alpha)) for n, s in zip(of, states)) for f, of in seen.items()}
        self.edge = [[math.log(e / sum(row)) for e in row] for row in edges]
        self.root = [math.log((s + alpha) / (sum(states) + 2 * alpha)) for s in states]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node. ``nodes`` has parents before children."""
        number = {id(n): i for i, n in enumerate(nodes)}
        own = []
        for n in nodes:
            no = yes = 0.0
            for f in features(n):
                a, b = self.node.get(f, (0.0, 0.0))
                no, yes = no + a, yes + b
            own.append([no, yes])
        up = [[0.0, 0.0] for _ in nodes]  # messages to the parent
        belief = [list(x) for x in own]
        for i in range(len(nodes) - 1, 0, -1):  # children first
            message = [_logsum(self.edge[s][0] + belief[i][0], self.edge[s][1] + belief[i][1]) for s in (0, 1)]
            up[i] = message
            p = number[id(nodes[i].parent)]
            belief[p][0] += message[0]
            belief[p][1] += message[1]
        if nodes:
            belief[0] = [b + r for b, r in zip(belief[0], self.root)]
        for i in range(1, len(nodes)):  # parents first
            p = number[id(nodes[i].parent)]
            rest = [belief[p][s] - up[i][s] for s in (0, 1)]
            for s in (0, 1):
                belief[i][s] += _logsum(rest[0] + self.edge[0][s], rest[1] + self.edge[1][s])
        return [1 / (1 + math.exp(max(-700.0, min(700.0, no - yes)))) for no, yes in belief]

    def extract(self, page: str) -> str:
        nodes, pieces = parse(page)
        kept = {id(n) for n, p in zip(nodes, self.marginals(nodes)) if p >= 0.5}
        return _SPACE.sub(" ", "".join(t if id(n) in kept else _BLOCK_END for n, t in pieces)).strip(" ")


def _logsum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


# Words by which sites name the parts of their pages.
_CONTENT = "article post entry content story main text body page blog news single prose".split()
_PARTS = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topnav mainnav links pagination pager toc skip".split(),
    "header": "header banner masthead logo brand top topbar site tagline".split(),
    "footer": "footer foot copyright legal bottom colophon imprint".split(),
    "aside": "sidebar aside widget related recommended trending popular promo secondary rail side tags author bio".split(),
    "div": "ad ads advert advertisement adsense sponsor sponsored banner promo cookie cookies consent notice popup modal overlay gdpr alert share social sharing follow subscribe newsletter signup".split(),
    "section": "comments comment discussion respond replies reply disqus reviews thread".split(),
    "form": "form search login contact signup subscribe newsletter comment".split(),
}


def labelled_pages(n: int = 300, seed: int = 7) -> list[str]:
    """Pages of many layouts with ``data-content`` on the elements where a part begins."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    said = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    named = lambda names: r.choice(["", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'])
    surely = lambda names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{word()} {r.choice(names)}"'])
    links = lambda k: "<ul>" + "".join(f'<li><a href="/">{said(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def block() -> str:
        kind = r.random()
        if kind < 0.62:
            return f"<p>{said(1, 4) if r.random() < 0.2 else said(8, 90)}{r.choice(['', f'<a href=x>{said(1, 3)}</a> {said(2, 9)}', f'<b>{said(1, 4)}</b>'])}</p>"
        if kind < 0.72:
            return f"<h{(k := r.randint(2, 4))}>{said(2, 8)}</h{k}>"
        if kind < 0.79:
            return f"<{(k := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{said(3, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{k}>"
        if kind < 0.84:
            return f"<blockquote><p>{said(6, 30)}</p></blockquote>"
        if kind < 0.88:
            return "<table>" + "".join(f"<tr><th>{said(1, 3)}</th><td>{said(1, 6)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.91:
            return f"<pre>{said(4, 20)}</pre>"
        if kind < 0.94:
            return f"<figure><img src=x><figcaption>{said(3, 12)}</figcaption></figure>"
        return f"<div>{block()}{block()}</div>" if r.random() < 0.6 else f"<section><h2>{said(2, 6)}</h2>{block()}</section>"

    def comment() -> str:
        return f'<{(k := r.choice(["article", "div", "li"]))} class="comment"><p>{said(4, 40)}</p></{k}>'

    def part(kind: str) -> str:
        names = _PARTS[kind]
        tag = kind if r.random() < 0.6 else "div"
        mark = named(names) if tag == kind and kind not in ("div", "section") else surely(names)
        if kind == "section":
            inner = f"<h3>{said(1, 3)}</h3>" + "".join(comment() for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<p>{said(1, 6)}</p><label>{said(1, 2)}</label><input name=q><button>{said(1, 2)}</button>"
        elif kind == "nav":
            inner = links(r.randint(2, 8))
        elif kind == "footer":
            inner = r.choice([f"&copy; {said(2, 12)}", f"<p>{said(2, 20)}</p>", links(4), f"<div>{said(2, 9)}</div>{links(3)}"])
        elif kind == "header":
            inner = r.choice([f"<h1>{said(1, 4)}</h1>", f"<a href=/>{said(1, 3)}</a><p>{said(2, 6)}</p>", f"<div>{said(1, 4)}</div>{links(3)}"])
        elif kind == "aside":
            inner = r.choice([f"<h3>{said(1, 3)}</h3>{links(5)}", f"<p>{said(3, 40)}</p>", f"<div><p>{said(3, 25)}</p></div>"])
        else:
            inner = r.choice([said(2, 14), f"<p>{said(3, 40)}</p>", f"<p>{said(3, 20)}</p><button>{said(1, 2)}</button>", f"<div>{said(2, 20)}</div>", links(3)])
        return f'<{tag}{mark} data-content="0">{inner}</{tag}>'

    def story() -> str:
        blocks = [block() for _ in range(r.randint(1, 12))]
        for _ in range(r.choice([0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), part(r.choice(["div", "aside", "section", "form", "nav"])))
        title = r.choice([f"<h1>{said(2, 12)}</h1>", f"<h1>{said(2, 12)}</h1>", ""])
        return title + "".join(blocks)

    pages = []
    for _ in range(n):
        shape = r.random()
        if shape < 0.5:
            main = f"<article{named(_CONTENT)}>{story()}</article>"
        elif shape < 0.7:
            main = f"<main{named(_CONTENT)}>{r.choice([story(), f'<article>{story()}</article>'])}</main>"
        elif shape < 0.92:
            main = f"<div{surely(_CONTENT)}>{story()}</div>"
        else:
            main = story()
        before = [part(k) for k in ("header", "nav", "div", "form", "aside") if r.random() < 0.5]
        after = [part(k) for k in ("section", "aside", "div", "form", "nav", "footer") if r.random() < 0.5]
        if r.random() < 0.3:
            main = f'<div class="{r.choice(["wrapper", "container", "layout", "row"])}">{main}</div>'
        pages.append(f'<html data-content="1"><body>{"".join(before)}{main}{"".join(after)}</body></html>')
    return pages


_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or Model(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.extract(page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=_SCHEMA.names
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, _SCHEMA)
