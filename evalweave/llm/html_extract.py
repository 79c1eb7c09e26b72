"""Main text of pages by a graphical model on the tree of the page.

Each block element and each run of text between block boundaries is a node with a binary state: there is content in it or
not. Node potentials are the log-odds of a logistic regression on its tag, words of its class and id, length, share of text
in links and the like; potentials of parent and child say how often states go together beyond chance, for runs of text and
for elements apart. Sum-product messages go up the tree and down again and give each node's marginal, which is exact on a
tree. Runs of text whose marginal is over a half are the page's blocks.

Both kinds of potentials are trained on labelled pages: `labelled_pages` makes pages of varied layouts, with semantic tags
or bare divisions, whose blocks are labelled as they are made; tests hold the model against pages made from another seed.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by two line
feeds in page order; empty blocks are none. Unclosed and stray tags are put up with; a line break is white space; scripts,
styles, titles, templates, frames, the fields of forms and comments have no node. Formulas, drawings' text and what stands in
for scripts or media are text like any other. A page is read in time proportional to its length, whatever is left open in it.

Null html, empty pages: the empty text. Null page_id, null url, repeated rows: each is a row of the result. Very long pages
are read whole. An empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag, or begins a quoted value in it.
_QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content isn't looked at.
_UNSEEN = frozenset("script style template title iframe noembed noframes textarea select datalist annotation annotation-xml".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _UNSEEN}
_BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary menu center hgroup dialog button label".split())
#: Of each kind of list or table: the elements that matter to where its parts end.
_GROUPS = {name: k for k, names in enumerate(("li ul ol menu", "dt dd dl", "tr td th table")) for name in names.split()}
#: A start tag closes these where the innermost open element of its group is one of them.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
_NO_P = _BLOCK - {"button", "label"}
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id that stand for one feature each, by their beginning.
_HINTS = ("ad", "advert", "sponsor", "promo", "banner", "cookie", "notice", "consent", "popup", "modal", "menu", "nav", "breadcrumb", "sidebar", "widget", "related", "share", "social", "comment", "reply", "footer", "header", "masthead", "login", "form", "search", "newsletter", "subscribe", "article", "content", "post", "entry", "story", "body", "main", "text", "wrapper", "container", "page")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAGS = sorted(_BLOCK) + ["#text"]
FEATURES = [*(f"tag {t}" for t in _TAGS), *(f"hint {h}" for h in _HINTS), "link share", "log words", "short", "sentence end", "links only", "in article or main", "in boilerplate tag", "constant"]
_INDEX = {f: i for i, f in enumerate(FEATURES)}
_BOILERPLATE = frozenset("nav header footer aside form menu dialog button".split())


class Node:
    __slots__ = ("tag", "parent", "hints", "words", "linked", "text", "ends", "label", "region")

    def __init__(self, tag: str, parent: int, hints: tuple[int, ...] = (), region: int = 0):
        self.tag, self.parent, self.hints, self.region = tag, parent, hints, region
        self.words = self.linked = self.ends = 0
        self.text, self.label = "", 0


class _Open:
    """The open elements: their nodes, and what makes looking for one of them cheap."""

    def __init__(self):
        self.nodes, self.tags = [0], ["html"]
        self.count: dict[str, int] = {}
        self.groups: tuple[list[int], ...] = ([], [], [])  # depths of the elements of each group

    def push(self, node: int, tag: str) -> None:
        if tag in _GROUPS:
            self.groups[_GROUPS[tag]].append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> str:
        self.nodes.pop()
        tag = self.tags.pop()
        self.count[tag] -= 1
        if tag in _GROUPS:
            self.groups[_GROUPS[tag]].pop()
        return tag

    def close(self, tag: str) -> None:
        """The innermost element of this name and what is in it; nothing if none is open."""
        if self.count.get(tag):
            while self.pop() != tag:
                pass

    def make_way(self, tag: str) -> None:
        """For a part of a list or table."""
        group = self.groups[_GROUPS[tag]]
        while group and self.tags[group[-1]] in _CLOSES[tag]:
            at, was = group[-1], self.tags[group[-1]]
            while len(self.nodes) > at:
                self.pop()
            if tag != "tr" or was == "tr":
                break


def _tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(where it starts, where it ends, whether an end tag, lower-case name or empty for what isn't a tag, the rest) of all tags in order.

    Nothing is looked at twice: a tag takes all that its quoted values hold, and a quote that is never closed, which can be
    but the last of its kind, ends its tag at the next >. A reader may send where to go on.
    """
    at, size = 0, len(html)
    while (at := html.find("<", at)) >= 0:
        close = html.startswith("/", at + 1)
        m = _NAME.match(html, at + 1 + close)
        if m is None:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = size if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), at):
                end = html.find(">", at)
                end = size if end < 0 else end + 1
            else:
                at += 1
                continue
            yield at, end, False, "", ""
            at = end
            continue
        end = m.end()
        while q := _QUOTE_OR_END.search(html, end):
            if not q[1]:
                end = q.end()
                break
            closing = html.find(q[1], q.end())
            if closing < 0:
                closing = html.find(">", q.end())
                end = size if closing < 0 else closing + 1
                break
            end = closing + 1
        else:
            end = size
        to = yield at, end, close, m[0].lower(), html[m.end() : end - 1]
        at = end if to is None else to


def parse(html: str) -> list[Node]:
    """The page's nodes, parents first; a #text node for each run of text."""
    nodes, open_ = [Node("html", -1)], _Open()
    run: list[str] = []
    state = {"linked": 0, "in_link": False}

    def flush() -> None:
        if run:
            words = unescape("".join(run)).split() if len(run) == 1 else "".join(map(unescape, run)).split()
            run.clear()
            if words:
                n = Node("#text", open_.nodes[-1], (), nodes[open_.nodes[-1]].region)
                n.text, n.words, n.linked = " ".join(words), len(words), min(state["linked"], len(words))
                n.ends = int(words[-1][-1] in ".!?:;…\"'”»)")
                nodes.append(n)
        state["linked"] = 0

    def say(text: str) -> None:
        run.append(text)
        if state["in_link"]:
            state["linked"] += len(text.split())

    at, tags, to = 0, _tags(html), None
    while True:
        try:
            start, end, close, name, rest = tags.send(to)
        except StopIteration:
            break
        to = None
        if start > at:
            say(html[at:start])
        at = end
        if not name:
            continue
        if name in _UNSEEN:
            if not close and not rest.endswith("/"):
                m = _RAW_END[name].search(html, at)
                at = html.find(">", m.end()) + 1 if m else 0
                to = at = at or len(html)
                if name not in ("annotation", "annotation-xml"):
                    flush()
        elif name == "br":
            say(" ")
        elif name == "a":
            state["in_link"] = not close
        elif name == "hr":
            flush()
        elif name in _BLOCK:
            flush()
            state["in_link"] = False
            if close:
                open_.close(name)
                continue
            if name == "html" or name == "body" and open_.count.get("body"):
                continue
            top = open_.tags[-1]
            if name in _NO_P and (top == "p" or top in _HEADS and name in _HEADS):
                open_.pop()
            if name in _CLOSES:
                open_.make_way(name)
            hints = ()
            if rest:
                found = {_hint(w.lower()) for a in _ATTRIBUTES.finditer(rest) for w in _WORDS.findall(a[2] or a[3] or a[4] or "")}
                hints = tuple(sorted(found - {-1}))
            parent = nodes[open_.nodes[-1]]
            region = 2 if name in _BOILERPLATE or parent.region == 2 else 1 if name in ("article", "main") or parent.region == 1 else 0
            nodes.append(Node(name, open_.nodes[-1], hints, region))
            open_.push(len(nodes) - 1, name)
    if at < len(html):
        say(html[at:])
    flush()
    for n in reversed(nodes):  # children come behind their parents
        if n.parent >= 0:
            p = nodes[n.parent]
            p.words += n.words
            p.linked += n.linked
            p.ends += n.ends
    return nodes


def _hint(word: str) -> int:
    if word in ("ad", "ads"):
        return 0
    for k in range(1, len(_HINTS)):
        if word.startswith(_HINTS[k]):
            return k
    return -1


_LINK, _LOG, _SHORT, _END, _ONLY, _IN, _OUT, _ONE = (_INDEX[f] for f in FEATURES[-8:])
_TAG_AT = {t: _INDEX[f"tag {t}"] for t in _TAGS}
_HINT_AT = _INDEX[f"hint {_HINTS[0]}"]


def features(n: Node) -> list[tuple[int, float]]:
    out = [(_TAG_AT[n.tag], 1.0), (_ONE, 1.0), (_LOG, math.log1p(n.words) / 4)]
    out += [(_HINT_AT + h, 1.0) for h in n.hints]
    if n.linked:
        out.append((_LINK, n.linked / n.words))
        if n.linked == n.words:
            out.append((_ONLY, 1.0))
    if n.words < 8:
        out.append((_SHORT, 1.0))
    if n.ends:
        out.append((_END, 1.0))
    if n.region:
        out.append((_IN if n.region == 1 else _OUT, 1.0))
    return out


def marginals(unary: list[float], parents: list[int], edge: list, kinds: list[int] | None = None) -> list[float]:
    """P(state 1) of each node of a tree by sum-product: unary log-odds, edge[parent state][child state] in logs. Parents first.

    With kinds, which number the children's kinds, edge has such a table for each kind.
    """
    n = len(parents)
    tables = [[x for row in e for x in row] for e in (edge if kinds else [edge])]
    own = [tables[k] for k in kinds] if kinds else tables * n
    up0, up1 = [0.0] * n, list(unary)  # beliefs from below, own potential included
    m0, m1 = [0.0] * n, [0.0] * n  # messages to the parent

    def lse(a: float, b: float) -> float:
        return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))

    for k in range(n - 1, 0, -1):
        a, b = up0[k], up1[k]
        e00, e01, e10, e11 = own[k]
        m0[k], m1[k] = lse(e00 + a, e01 + b), lse(e10 + a, e11 + b)
        p = parents[k]
        up0[p] += m0[k]
        up1[p] += m1[k]
    for k in range(1, n):  # up*[parent] is whole by now: take the child's own message out and send the rest down
        p = parents[k]
        a, b = up0[p] - m0[k], up1[p] - m1[k]
        e00, e01, e10, e11 = own[k]
        up0[k] += lse(e00 + a, e10 + b)
        up1[k] += lse(e01 + a, e11 + b)
    return [1 / (1 + math.exp(min(700.0, a - b))) for a, b in zip(up0, up1, strict=True)]


class Model:
    def __init__(self, weights: list[float], edge: list):
        self.weights, self.edge = weights, edge

    def blocks(self, html: str | None) -> list[str]:
        if not html:
            return []
        nodes, w = parse(html), self.weights
        unary = [sum(w[i] * v for i, v in features(n)) for n in nodes]
        found = marginals(unary, [n.parent for n in nodes], self.edge, [int(n.tag == "#text") for n in nodes])
        return [n.text for n, p in zip(nodes, found, strict=True) if n.tag == "#text" and p > 0.5]


def train(pages: list[tuple[str, set[str]]], ridge: float = 1.0) -> Model:
    """pages: html and the texts of its content blocks. A node's state is 1 if there is such a block in it."""
    rows, y, pairs = [], [], np.full((2, 2, 2), 0.5)  # pairs: by whether the child is a run of text
    for html, content in pages:
        nodes = parse(html)
        for n in reversed(nodes):
            if n.tag == "#text":
                n.label = int(n.text in content)
            if n.label and n.parent >= 0:
                nodes[n.parent].label = 1
        for n in nodes:
            rows.append(features(n))
            y.append(n.label)
            if n.parent >= 0:
                pairs[int(n.tag == "#text"), nodes[n.parent].label, n.label] += 1
    x = np.zeros((len(rows), len(FEATURES)))
    for k, own in enumerate(rows):
        for i, v in own:
            x[k, i] = v
    t, w = np.array(y, float), np.zeros(len(FEATURES))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (t - p) - ridge * w)
        w = w + step
        if abs(step).max() < 1e-6:
            break
    joint = pairs / pairs.sum((1, 2), keepdims=True)
    edge = np.log(joint / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)))
    return Model(w.tolist(), edge.tolist())


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, set[str]]]:
    """Pages of varied layouts with the texts of their content blocks."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(3, 18).capitalize() + r.choice(".....!?")

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(r.randint(a, b))) + "</ul>"

    pages = []
    for _ in range(n):
        content: set[str] = set()
        semantic = r.random() < 0.7

        def keep(text: str, content: set[str] = content) -> str:
            content.add(" ".join(text.split()))
            return text

        def box(tag: str, names: str, inner: str, semantic: bool = semantic) -> str:
            name = r.choice(names.split())
            style = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice(["left", "wide", "x1"])}"'])
            return f"<{tag}{style if r.random() < 0.5 else ''}>{inner}</{tag}>" if semantic else f"<div{style}>{inner}</div>"

        def paragraph() -> str:
            text = keep(" ".join(sentence() for _ in range(r.randint(1, 6))))
            if r.random() < 0.2:
                a, _, b = text.partition(" ")
                text = f'<a href="/x">{a}</a> {b}' if b else text
            return (f"<p>{text}" if r.random() < 0.1 else f"<p>{text}</p>") if r.random() < 0.9 else f"<p><b>{text}<br></p>"

        main = f"<h1>{keep(words(2, 9))}</h1>" if r.random() < 0.9 else ""
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.75:
                main += paragraph()
            elif kind < 0.82:
                main += (lambda k: f"<h{k}>{keep(words(1, 6))}</h{k}>")(r.choice("2234"))
            elif kind < 0.85:
                main += f"<section><h3>{keep(words(1, 5))}</h3>{paragraph()}</section>"
            elif kind < 0.88:
                main += "<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif kind < 0.92:
                main += f"<blockquote><p>{keep(sentence())}</p></blockquote>"
            elif kind < 0.96:
                main += f"<table><tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 3))}</td></tr></table>"
            else:
                main += f'<div class="{r.choice(["ad", "advert", "ads-box", "sponsor"])}">{sentence()}</div>'
        if r.random() < 0.2:
            main += box("aside", "related share social newsletter", links(1, 4) if r.random() < 0.5 else f"<p>{sentence()}</p>")
        article = box("article", "article content post entry story main-text post-body", main)
        if r.random() < 0.3:
            article = box("main", "main content wrapper", article)
        before, after = [], []
        if r.random() < 0.8:
            before.append(box("nav", "nav menu navbar main-nav breadcrumb", links(2, 8)))
        if r.random() < 0.4:
            before.append(box("header", "header masthead banner site-header", f"<h2>{words(1, 3)}</h2>" if r.random() < 0.5 else f"<p>{sentence()}</p>"))
        if r.random() < 0.35:
            before.append(f'<div class="{r.choice(["cookie-notice", "cookie", "consent", "notice", "popup"])}"><p>{" ".join(sentence() for _ in range(r.randint(1, 3)))}</p><button>{words(1, 2)}</button></div>')
        if r.random() < 0.6:
            (before if r.random() < 0.5 else after).append(f'<div class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo"])}">{sentence()}</div>')
        if r.random() < 0.4:
            (before if r.random() < 0.3 else after).append(box("aside", "sidebar widget related side-bar", (f"<h3>{words(1, 3)}</h3>" if r.random() < 0.5 else "") + (links(2, 6) if r.random() < 0.5 else f"<p>{sentence()}</p>")))
        if r.random() < 0.35:
            after.append(box("section", "comments comment-list replies", f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{" ".join(sentence() for _ in range(r.randint(1, 3)))}</p></div>' for _ in range(r.randint(1, 5)))) if semantic else f'<div class="{r.choice(["comments", "comment-list"])}">' + "".join(f"<p>{sentence()}</p>" for _ in range(r.randint(1, 4))) + "</div>")
        if r.random() < 0.25:
            after.append(f'<form class="{r.choice(["search", "login", "subscribe", "newsletter"])}"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>')
        if r.random() < 0.8:
            after.append(box("footer", "footer site-footer page-footer", f"&copy; {words(1, 3)} &middot; {sentence()}" if r.random() < 0.6 else f"<p>{sentence()}</p>{links(1, 3)}"))
        body = "".join(before) + article + "".join(after)
        if not semantic and r.random() < 0.3:  # a table that lays out the page
            body = f"<table><tr><td{r.choice(['', ' width=20%', ' class=left'])}>{''.join(before)}</td><td>{article}</td></tr></table>{''.join(after)}"
        if r.random() < 0.3:  # a line of links without any name
            body = f"<div id={words(1, 1)}>{' | '.join(f'<a href=/{k}>{words(1, 2)}</a>' for k in range(r.randint(1, 5)))}</div>{body}"
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page"])}">{body}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else ""), content))
    return pages


#: Labelled pages that the potentials are trained on.
TRAINING = 400


@cache
def _trained() -> Model:
    return train(labelled_pages(TRAINING))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text."""
    model = model or _trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"page_id": x["page_id"].astype("Int64"), "url": x["url"], "text": ["\n\n".join(model.blocks(h)) for h in x["html"]]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages")).select("*", F.length("text").cast("long").alias("n_chars"))
