"""Main text of web pages by a tree-structured graphical model.

A page's block elements make a tree. Each node is content or not; its own evidence and the potentials between parent and
child make up the model. Evidence is the tag, words in its class, id and role, where it stands to the page's main article,
what the heading before or in it says, and shares of linked text and lengths of its own text and of all below it.
Messages pass from the leaves to the root and back, which gives each node's exact marginal. The potentials are fitted
to labelled pages; `labelled_pages` makes the ones used here.

Text of nodes whose marginal is over a half is the article: character references decoded, white space within a
block one space, blocks in page order joined by a line end.

Tags are read as HTML reads them: a quote is one only where a value starts. Defined results: null and empty pages, and a page without an article, give an empty text; an empty table gives an empty one. Broken markup
is read leniently: open elements end with their parent, an open comment, script or tag with the page. Rows are independent, so repeated ones
agree; null ids and urls come back. The work is linear in the page. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BLOCKS = frozenset("html head body title article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset legend select option button label textarea address details summary dialog menu iframe object svg canvas template noscript hr center".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What these hold is no text of the page. Those of the second line stand within a line of text.
RAW = frozenset("noscript template iframe object svg canvas script style select textarea button".split())
INLINE_RAW = frozenset("script style select textarea button".split())
#: Text of these is characters up to their own end tag.
TEXT_ONLY = frozenset(("title",))
#: An open element of the second kind ends where the first starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# An attribute is a name and perhaps a value: in quotes if it starts with one, else up to the next space.
_ATTRIBUTE = r"""(?>[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]+)?)?)"""
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTE}*+)(>|\Z)", re.DOTALL)
_VALUE = re.compile(r"""(?>[\s/]*)([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]+))?)?""")
_HINTS = ("class", "id", "role", "itemprop")
#: Fixed words of class names: what stands around an article, what holds one, and what says neither.
_AGAINST = frozenset("nav navbar navigation menu foot footer header masthead sidebar side aside ad ads advert advertisement adverts banner promo promotion sponsor sponsored cookie cookies consent notice alert comment comments reply replies disqus share sharing social related recommended recommendations form login signup signin subscribe subscription newsletter breadcrumb breadcrumbs widget popup modal search pagination pager copyright legal toolbar hidden contentinfo complementary".split())
_FOR = frozenset("article content post entry main body story text prose".split())
_EITHER = frozenset("area author bar bottom box card center column container footer form group global header holder id inner items left link links list meta outer page panel posts region right row section site sticky sub title top wrap wrapper".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Headings of what isn't the article, whole: of comments, of other pages, of offers.
_LEAD = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader|user|your|our|all|the|leave (?:a|us a)|post a|add a|join the|share this|more|sign up (?:for|to)|subscribe to|follow|about) )*(?:comments?|repl(?:y|ies)|responses?|discussion|conversation|related(?: (?:articles|posts|stories|links|pages|reading))?|recommended(?: for you)?|you (?:may|might) also like|read next|most (?:read|popular)|trending|newsletter|subscribe|advertisement|sponsored|share|share this|follow us|cookies?|kommentare?|antworten|verwandte (?:artikel|beiträge)|mehr zum thema|das könnte sie auch interessieren|anzeige|werbung|commentaires?|réponses?|articles (?:similaires|liés)|à lire aussi|publicité|comentarios?|respuestas?|artículos relacionados|te puede interesar|publicidad)(?:\W*\(?\d+\)?)?\W*", re.IGNORECASE)
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _hint(names: list[str]) -> int:
    """0: nothing said, 1: against content, 2: for it. A name is against if one of its words is and all others may stand beside
    it, so `related-posts` is and `related-work` isn't."""
    found = 0
    for name in names:
        parts = [x.lower() for x in _PARTS.findall(name)]
        known = [x in _AGAINST for x in parts if x in _AGAINST or x in _FOR]
        if known and known[-1] and all(x in _AGAINST or x in _FOR or x in _EITHER for x in parts) and not (parts[-1] == "header" and parts[0] in _FOR):
            return 1
        if known and not known[-1]:
            found = 2
    return found


def _attributes(raw: str) -> tuple[int, bool, bool]:
    """The hint of its names, whether it is hidden, whether it is labelled content."""
    names, hidden, label = [], False, False
    for m in _VALUE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in _HINTS:
            names += value.split()
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            hidden = True
        elif key == "data-y":
            label = True
    return _hint(names), hidden, label


class Node:
    __slots__ = ("after", "all", "all_linked", "hidden", "hint", "label", "lead", "linked", "own", "parent", "place", "tag")

    def __init__(self, tag: str, parent: int, attributes: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.own = self.linked = self.all = self.all_linked = self.place = self.after = 0
        self.lead = -1
        self.hint, self.hidden, self.label = _attributes(attributes) if attributes else (0, False, False)


def parse(page: str) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """The block nodes in page order, and the text blocks as (node, pieces of raw text)."""
    nodes, blocks, stack, opened = [Node("#root", -1)], [], [0], Counter()
    open_, link, at, end = False, 0, 0, len(page)  # link: how deep the open link stands, 0 for none

    def shut(depth: int) -> None:
        nonlocal link
        for k in stack[depth:]:
            opened[_kind(nodes[k].tag)] -= 1
        del stack[depth:]
        if link > len(stack):
            link = 0

    def text(piece: str) -> None:
        nonlocal open_
        if not piece:
            return
        node = nodes[stack[-1]]
        if not open_:
            if not piece.strip(" \t\n\r\x0b\x0c"):
                return
            blocks.append((stack[-1], []))
            open_ = True
        blocks[-1][1].append(piece)
        node.own += len(piece)
        node.linked += len(piece) if link else 0

    while at < end:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, start)
        if not m:  # a tag whose quote stays open to the end, or a bare `<`
            if re.match(r"</?[a-zA-Z]", page[start : start + 3]):
                text(page[at:start])
                break
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        closing, tag, attributes, ended = m[1], (m[2] or "").lower(), m[3], m[4]
        if not tag or (not ended and tag):
            continue
        if tag in RAW and not closing:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            if tag not in INLINE_RAW:
                open_ = False
            continue
        if tag == "a":
            link = 0 if closing else len(stack)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in BLOCKS:
            continue
        open_ = False
        if tag in VOID:
            continue
        if closing:
            if opened[_kind(tag)]:
                depth = len(stack) - 1
                while _kind(nodes[stack[depth]].tag) != _kind(tag):
                    depth -= 1
                shut(depth)
            continue
        if nodes[stack[-1]].tag == "p":
            shut(len(stack) - 1)
        ends = ENDS.get(tag, ())
        while len(stack) > 1 and nodes[stack[-1]].tag in ends:
            shut(len(stack) - 1)
        nodes.append(Node(tag, stack[-1], attributes))
        stack.append(len(nodes) - 1)
        opened[_kind(tag)] += 1
        if tag in TEXT_ONLY:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            text(page[at : close.start() if close else end])
            at = close.start() if close else end
    _annotate(nodes, blocks)
    return nodes, blocks


def _kind(tag: str) -> str:
    """Headings close each other."""
    return "h" if tag in HEADS else tag


def _annotate(nodes: list[Node], blocks: list[tuple[int, list[str]]]) -> None:
    """What evidence needs of other nodes: sums below, the first words below, headings before, the main article."""
    for v in nodes:
        v.all, v.all_linked = v.own, v.linked
    for v in reversed(nodes[1:]):  # children come after their parents
        nodes[v.parent].all += v.all
        nodes[v.parent].all_linked += v.all_linked
    says: dict[int, bool] = {}
    for k, parts in blocks:
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip(" ") if nodes[k].own < 80 else ""
        against = bool(text and _LEAD.fullmatch(text))
        says.setdefault(k, against)
        while k >= 0 and nodes[k].lead < 0:  # the first block of each node
            nodes[k].lead = int(against)
            k = nodes[k].parent
    under = [0] * len(nodes)  # the level of the open heading that says so, among a node's children
    for k, v in enumerate(nodes[1:], 1):
        if v.tag in HEADS:
            level = int(v.tag[1])
            if says.get(k):
                under[v.parent] = level
            elif level <= under[v.parent]:
                under[v.parent] = 0
        v.after = int(under[v.parent] > 0)
    # The main article: of the outermost `article` elements, or else `main`, the one with the most text that is no link.
    for tag in ("article", "main"):
        inside = [0] * len(nodes)
        for k, v in enumerate(nodes[1:], 1):
            inside[k] = inside[v.parent] or (k if v.tag == tag else 0)
        outer = sorted({x for x in inside if x}, key=lambda x: (nodes[x].all_linked - nodes[x].all, x))
        if outer and 4 * (nodes[outer[0]].all - nodes[outer[0]].all_linked) >= nodes[0].all - nodes[0].all_linked:
            for k, v in enumerate(nodes):
                v.place = 1 if inside[k] == outer[0] else 2
            while (up := nodes[outer[0]].parent) > 0:  # what holds it is on neither side
                nodes[up].place = 0
                outer[0] = up
            break


def evidence(node: Node) -> tuple[tuple[str, object], ...]:
    share = node.linked / node.own if node.own else 0
    below = node.all_linked / node.all if node.all else 0
    return (
        ("bias", 0),
        ("tag", node.tag if node.tag in BLOCKS or node.tag == "#root" else "other"),
        ("hint", 3 if node.hidden else node.hint),
        ("links", 0 if share == 0 else 1 if share < 0.5 else 2),
        ("length", 0 if node.own == 0 else 1 if node.own < 25 else 2 if node.own < 120 else 3),
        ("below", (0 if below == 0 else 1 if below < 0.4 else 2 if below < 0.9 else 3, 0 if node.all < 120 else 1)),
        ("place", node.place),
        ("after", node.after),
        ("lead", max(0, node.lead)),
    )


class Model:
    """Potentials: log odds of content for each piece of evidence, and factors by a parent's and a child's label."""

    def __init__(self, own: dict[tuple[str, object], float], child: list[list[float]]) -> None:
        self.own, self.child = own, child

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content for each node: messages up, then down."""
        n = len(nodes)
        weights = [sum(self.own.get(x, 0.0) for x in evidence(node)) for node in nodes]
        local = [(1.0, 2.718281828459045 ** max(-40.0, min(40.0, w))) for w in weights]
        (t00, t01), (t10, t11) = self.child
        belief = list(local)
        message = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):  # children come after their parents
            b0, b1 = belief[k]
            m0, m1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
            s = m0 + m1
            message[k] = m0, m1 = m0 / s, m1 / s
            p = nodes[k].parent
            q0, q1 = belief[p][0] * m0, belief[p][1] * m1
            s = q0 + q1
            belief[p] = (q0 / s, q1 / s)
        out = [0.0] * n
        final: list[tuple[float, float]] = [(1.0, 0.0)] * n  # the root itself is no content
        for k in range(1, n):
            p = nodes[k].parent
            f0, f1 = final[p][0] / message[k][0], final[p][1] / message[k][1]
            g0, g1 = belief[k][0] * (f0 * t00 + f1 * t10), belief[k][1] * (f0 * t01 + f1 * t11)
            s = g0 + g1
            final[k] = (g0 / s, g1 / s)
            out[k] = g1 / s
        return out


def _pairs(depth: list[np.ndarray], parent: np.ndarray, odds: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Of all nodes of many trees at once the log probabilities of (parent's label, own): messages up and down by depth."""
    inner = np.zeros((len(parent), 2))
    inner[:, 1] = odds
    up = np.zeros((len(parent), 2))
    for at in reversed(depth[1:]):
        up[at] = np.logaddexp(pair[:, 0] + inner[at, :1], pair[:, 1] + inner[at, 1:])
        np.add.at(inner, parent[at], up[at])
    belief = np.zeros((len(parent), 2))
    belief[depth[0], 1] = -1e9  # the roots themselves are no content
    out = np.full((len(parent), 2, 2), -1e9)
    for at in depth[1:]:
        joint = (belief[parent[at]] - up[at])[:, :, None] + pair + inner[at][:, None, :]
        out[at] = joint - np.logaddexp.reduce(joint, axis=(1, 2))[:, None, None]
        belief[at] = np.logaddexp(out[at, 0], out[at, 1])
    return out


def train(pages: list[str], penalty: float = 0.1, steps: int = 150) -> Model:
    """The potentials that make the labels of whole pages likeliest, of pages whose content elements carry the attribute data-y:
    by gradient steps (Adam), observed less expected counts of the evidence and of the pairs, the expected ones from exact marginals."""
    names: dict[tuple[str, object], int] = {}
    depths, parents, labels, places = [], [], [], []
    for page in pages:
        nodes, _ = parse(page)
        base = len(parents)
        for node in nodes:
            depths.append(depths[base + node.parent] + 1 if node.parent >= 0 else 0)
            parents.append(base + max(0, node.parent))
            labels.append(int(node.label))
            places.append([names.setdefault(x, len(names)) for x in evidence(node)])
    parent, y, places = np.array(parents), np.array(labels), np.array(places)
    level = np.array(depths)
    depth = [np.flatnonzero(level == d) for d in range(max(depths) + 1)]
    inside = level > 0
    seen = np.bincount(places[inside].ravel(), np.repeat(y[inside], places.shape[1]).astype(float), len(names))
    moves = np.bincount(2 * y[parent[inside]] + y[inside], minlength=4).astype(float)
    w, mean, square = (np.zeros(len(names) + 4) for _ in range(3))
    for step in range(1, steps + 1):
        p = np.exp(_pairs(depth, parent, w[places].sum(1), w[-4:].reshape(2, 2)))[inside]
        expected = np.bincount(places[inside].ravel(), np.repeat(p[:, :, 1].sum(1), places.shape[1]), len(names))
        slope = np.concatenate((seen - expected, moves - p.sum(0).ravel())) - penalty * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w += 0.25 * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    own = {name: float(w[k]) for name, k in names.items()}
    return Model(own, np.exp(w[-4:]).reshape(2, 2).tolist())


def labelled_pages(n: int = 300, seed: int = 5) -> list[str]:
    """Pages of several layouts with known content: elements of the article carry data-y."""
    r = random.Random(seed)
    y = " data-y"

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b))).capitalize() + r.choice(("", ".", ".", "!"))

    def named(*names: str) -> str:
        """One of the names as class or id, one that says nothing, or none."""
        made = r.choice((*names, *names, "".join(r.choice("bcdfgxyz") for _ in range(5)), ""))
        return f' {r.choice(("class", "class", "id"))}="{made}"' if made else ""

    def links(k: int, mark: str = "") -> str:
        return f"<ul{mark}>" + "".join(f'<li{mark}><a href="/{i}">{words(1, 4)}</a></li>' for i in range(k)) + "</ul>"

    def piece() -> str:
        return r.choice([
            lambda: f"<p{y}>{words(1, 60)}</p>", lambda: f"<p{y}>{words(8, 90)}</p>", lambda: f"<p{y}>{words(1, 3)}</p>", lambda: f"<p{y}>{words(8, 90)}</p>", lambda: f"<p{y}{named('lead', 'intro', 'related')}>{words(3, 40)}</p>",
            lambda: f"<h2{y}>{words(1, 6)}</h2>", lambda: f"<ul{y}>" + "".join(f"<li{y}>{words(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", lambda: links(r.randint(2, 5), y),
            lambda: f"<blockquote{y}><p{y}>{words(6, 30)}</p></blockquote>", lambda: f"<pre{y}>{words(5, 20)}</pre>", lambda: f'<p{y}>{words(4, 20)} <a href="/x">{words(1, 3)}</a> {words(4, 20)}</p>', lambda: f'<p{y}><a href="/x">{words(1, 5)}</a></p>',
            lambda: f"<table{y}>" + "".join(f"<tr{y}><td{y}>{words(1, 3)}</td><td{y}>{words(1, 6)}</td></tr>" for _ in range(3)) + "</table>", lambda: f"<figure{y}><img src=a><figcaption{y}>{words(3, 12)}</figcaption></figure>", lambda: f"<div{y}>{words(5, 40)}</div>",
        ])()

    def comments(bare: bool = False) -> str:
        title = r.choice(("Comments", "3 comments", "Reader comments", "Leave a reply", "Kommentare", "Commentaires", "Comentarios"))
        each = "".join(r.choice((f"<div{named('comment')}><p>{words(4, 50)}</p></div>", f"<p>{words(2, 40)}</p>", f"<li><p>{words(1, 3)}</p><p>{words(4, 40)}</p></li>")) for _ in range(r.randint(1, 4)))
        if bare:
            return f"<h3>{title}</h3>{each}"
        return r.choice((f"<section{named('comments')}><h3>{title}</h3>{each}</section>", f"<div{named('comments', 'replies')}><h2>{title}</h2>{each}</div>"))

    def noise() -> str:
        return r.choice([
            lambda: f"<div{named('ad', 'advert', 'ads-box')}>{words(3, 30)}</div>", lambda: f"<div{named('advert', 'promo', 'sponsored')}><p>{words(5, 25)}</p></div>", lambda: f"<aside><h3>{words(1, 3)}</h3>{links(4)}</aside>", lambda: f"<div{named('sidebar', 'widget')}><p>{words(4, 30)}</p>{links(3)}</div>",
            lambda: f"<div{named('cookie-notice', 'consent')}><p>{words(8, 25)}</p><button>OK</button></div>", lambda: f"<form><label>{words(1, 3)}</label><input><p>{words(2, 9)}</p></form>", lambda: f"<div{named('related', 'related-posts')}><h3>Related articles</h3>{links(4)}</div>",
            comments, lambda: f"<div{named('share', 'social-links')}>{links(3)}</div>", lambda: f"<div{named('newsletter', 'subscribe')}><p>{words(5, 15)}</p></div>", lambda: f"<div hidden>{words(3, 30)}</div>",
        ])()

    pages = []
    for _ in range(n):
        body = r.choice(("", f"<h1{y}>{words(2, 9)}</h1>", f"<h1{y}>{words(2, 9)}</h1>", f"<header{y}><h1{y}>{words(2, 9)}</h1></header>"))
        body += "".join(piece() + (noise() if r.random() < 0.06 else "") for _ in range(r.choice((1, 1, 2, 3, r.randint(1, 12), r.randint(4, 12))))) + (comments(r.random() < 0.5) if r.random() < 0.15 else "")
        holder = r.choice((f"<article{y}>{body}</article>", f"<article{y}>{body}</article>", f"<main><article{y}>{body}</article></main>", f"<div{y}{named('content', 'story')}>{body}</div>", f'<div id="main-content"{y}><div class="post-body"{y}>{body}</div></div>', f"<main{y}>{body}</main>", f"<div><section{y}>{body}</section></div>"))
        top = r.choice((f"<nav>{links(5)}</nav>", f"<header><h2>{words(1, 3)}</h2><nav>{links(4)}</nav></header>", f"<div{named('menu', 'top-nav')}>{links(6)}</div>", f"<div{named('header', 'masthead')}><p>{words(1, 5)}</p>{links(3)}</div>"))
        end = r.choice((f"<footer>{words(3, 20)}</footer>", f"<footer><p>{words(3, 12)}</p>{links(3)}</footer>", f"<div{named('footer', 'site-footer')}><p>{words(3, 20)}</p></div>", ""))
        pages.append(f"<html><head><title>{words(2, 8)}</title></head><body>{top}{''.join(noise() for _ in range(r.randint(0, 2)))}{holder}{''.join(noise() for _ in range(r.randint(0, 2)))}{end}</body></html>")
    return pages


@lru_cache(1)
def standard_model() -> Model:
    return train(labelled_pages())


def main_text(page: str, model: Model) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    inside = model.marginals(nodes)
    out = []
    for node, pieces in blocks:
        if inside[node] > 0.5:
            raw = "".join(pieces)
            if text := _SPACES.sub(" ", html.unescape(raw) if "&" in raw else raw).strip(" "):
                out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text), one row for each row of pages."""
    model = model or standard_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_batches(own, run, "page_id long, url string, text string")
