"""Main text of web pages: content marginals of DOM nodes by message passing over the tree."""

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.shared import by_bytes

# pages of the table that a fit reads at most, and how long those may be
SAMPLE = 300
SAMPLE_CHARS = 50_000
SEED_PAGES = 900
ROUNDS = 150
PAGES_AT_ONCE, BYTES_AT_ONCE = 512, 4 << 20

# elements without text of their own for a reader; fixed values
RAW = ("script", "style", "template", "textarea", "title", "select", "datalist")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    # formulas and drawings stand within a line, and so does what they are made of
    " math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover"
    " mmultiscripts mtable mtr mtd semantics svg g path text tspan textpath circle rect line polyline polygon ellipse defs use desc".split()
)
# a start tag of the left ends open elements of the right
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table body html div section article main".split())

_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


@dataclass
class Page:
    """Nodes in page order, parents first: elements, and leaves that hold a block's text."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)

    def add(self, parent: int, names: list[str], text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.names.append(names)
        self.text.append(text)
        return len(self.parent) - 1


def _length_name(n: int) -> str:
    return f"length {min(n.bit_length(), 11)}"


def parse(source: str) -> Page:
    """Tolerant of unclosed, misnested and unknown tags, comments and stray ``<``; linear in the length."""
    page = Page()
    root = page.add(-1, ["<root"])
    stack = [("", root, 0)]  # (tag, node, links open when it began)
    parts: list[str] = []
    linked = plain = 0
    links = 0
    strict = True

    def flush():
        nonlocal parts, linked, plain
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                share = linked / max(1, linked + plain)
                names = ["text", _length_name(len(text)), f"links {round(share * 4)}", "stop" if text[-1] in ".!?:;\"'»”" else "open"]
                names.append(f"text in {stack[-1][0]}")
                if "©" in text:
                    names.append("copyright sign")
                page.add(stack[-1][1], names, text)
        parts, linked, plain = [], 0, 0

    def close(index: int):
        nonlocal links
        flush()
        links = stack[index][2]
        del stack[index:]

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            start = size
        if start > at:
            parts.append(source[at:start])
            if links:
                linked += start - at
            else:
                plain += start - at
        if start == size:
            break
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if source[start + 1 : start + 2] in ("!", "?"):
            end = source.find(">", start)
            at = size if end < 0 else end + 1
            continue
        named = _NAME.match(source, start + 1)
        if not named:
            parts.append("<")
            at = start + 1
            continue
        end = _TAG_END.match(source, named.end()) if strict else None
        if end:
            at = end.end()
        else:  # an open quote would swallow the rest: from here on, tags end at the next >
            strict = False
            found = source.find(">", named.end())
            at = size if found < 0 else found + 1
        tag = named[1].lower()
        if source[start + 1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                else:
                    flush()
            continue
        if tag in _RAW_END:
            closing = _RAW_END[tag].search(source, at)
            if not source[start:at].endswith("/>"):
                at = closing.end() if closing else size
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            parts.append(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        flush()
        if stack[-1][0] == "p" and tag != "p":
            close(len(stack) - 1)
        ends = CLOSES.get(tag, ("p",) if tag == "p" else ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                close(i)
                break
            if stack[i][0] in BARRIER:
                break
        names = [f"<{tag}", f"<{tag} in {stack[-1][0]}"]
        inside = source[named.end() : at]
        if "=" in inside or "hidden" in inside:
            for m in _ATTRIBUTE.finditer(inside):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key == "style":
                    if "display:none" in value.replace(" ", ""):
                        names.append("=hidden")
                elif "hidden" in key:
                    if value != "false":
                        names.append("=hidden")
                else:
                    names += [f"={t}" for t in dict.fromkeys(_TOKEN.findall(value))]
        stack.append((tag, page.add(stack[-1][1], names), links))
    flush()
    return page


@dataclass
class Forest:
    """The trees of several pages as arrays."""

    parent: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray  # of each feature
    feature: np.ndarray

    @staticmethod
    def of(pages: list[Page], known: dict[str, int]) -> "Forest":
        parent, depth, node, feature = [], [], [], []
        for page in pages:
            base = len(parent)
            parent += [p + base if p >= 0 else -1 for p in page.parent]
            depth += page.depth
            for i, names in enumerate(page.names, base):
                for name in names:
                    if name in known:
                        node.append(i)
                        feature.append(known[name])
        d = np.array(depth, np.int64)
        order = np.argsort(d, kind="stable")
        cuts = np.searchsorted(d[order], np.arange(1, d.max(initial=0) + 1))
        return Forest(np.array(parent, np.int64), np.split(order, cuts), np.array(node, np.int64), np.array(feature, np.int64))


def marginals(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sum-product: the odds of content pass up from the leaves, then down from the roots.

    ``unary[n]`` is the log potential of content (0 for boilerplate), ``pair[parent, child]`` that of
    an edge.  Returns P(content) per node and, summed over edges, P(parent's, child's label).
    """
    n = len(unary)
    own = np.zeros((n, 2))
    own[:, 1] = unary
    up = own.copy()  # with all messages from below
    message = np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        m = np.logaddexp(up[level, 0, None] + pair[None, :, 0], up[level, 1, None] + pair[None, :, 1])
        message[level] = m
        np.add.at(up, forest.parent[level], m)
    belief = up.copy()
    edges = np.zeros((2, 2))
    for level in forest.levels[1:]:
        above = belief[forest.parent[level]] - message[level]
        belief[level] = up[level] + np.logaddexp(above[:, 0, None] + pair[None, 0], above[:, 1, None] + pair[None, 1])
        joint = above[:, :, None] + pair[None] + up[level][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        edges += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), edges


@dataclass
class Model:
    known: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def content(self, pages: list[Page]) -> np.ndarray:
        forest = Forest.of(pages, self.known)
        unary = np.bincount(forest.node, weights=self.weights[forest.feature], minlength=len(forest.parent))
        return marginals(forest, unary, self.pair)[0]


def learn(pages: list[Page], labels: list[np.ndarray], rounds: int = ROUNDS) -> Model:
    """Maximum likelihood of node and edge potentials; expectations are those of `marginals`."""
    names = sorted({x for page in pages for own in page.names for x in own})
    known = {x: i for i, x in enumerate(names)}
    forest = Forest.of(pages, known)
    y = np.concatenate(labels)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]], y[child]), 1)
    weights, pair = np.zeros(len(names)), np.zeros((2, 2))
    values, moments = [weights, pair], [[np.zeros_like(v), np.zeros_like(v)] for v in (weights, pair)]
    for step in range(1, rounds + 1):
        unary = np.bincount(forest.node, weights=weights[forest.feature], minlength=len(y))
        p, edges = marginals(forest, unary, pair)
        slopes = [
            np.bincount(forest.feature, weights=(y - p)[forest.node], minlength=len(names)) - 0.3 * weights,
            seen - edges - 0.3 * pair,
        ]
        for value, slope, moment in zip(values, slopes, moments):
            moment[0] += 0.1 * (slope - moment[0])
            moment[1] += 0.01 * (slope**2 - moment[1])
            value += 0.15 * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
    return Model(known, weights, pair)


def weak_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that says what is what: inside article or main, but not in parts named otherwise."""
    inside = np.zeros(len(page.parent), np.int64)
    for i, names in enumerate(page.names):
        above = inside[page.parent[i]] if page.parent[i] >= 0 else 0
        if names[0] in ("<article", "<main"):
            above = 1
        elif names[0] in ("<nav", "<aside", "<footer", "<form") or any(n[1:] in NOT_CONTENT for n in names if n[0] == "="):
            above = 0
        inside[i] = above
    return inside if inside.any() else None


# Names that pages commonly give to their parts; used to label the pages below.
CONTENT = ("content", "article", "post", "entry", "story", "body", "text", "main", "articlebody", "page", "blog", "single", "markdown", "prose")
NOT_CONTENT = (
    "nav menu navbar navigation breadcrumb breadcrumbs sidebar side widget ad ads advert advertisement sponsored sponsor banner promo "
    "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe signup login search comment comments "
    "commentlist reply replies respond discussion disqus footer foot copyright legal disclaimer header masthead topbar logo site social share sharing "
    "related recommended trending tags pagination pager toolbar skip hidden"
).split()


def labelled_pages(count: int = SEED_PAGES, seed: int = 5) -> tuple[list[Page], list[np.ndarray]]:
    """Pages put together by rule from the common parts of articles and of what surrounds them.

    Every leaf's label is known because its text begins with a mark, which is taken off.
    """
    draw = random.Random(seed)
    yes, no = "", ""

    def words(low, high, stop=True):
        text = " ".join("".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(low, high)))
        return text + ("." if stop else "")

    def prose(mark):
        kind = draw.random()
        if kind < 0.7:
            return f"<p>{mark}{words(8, 90)} {'<a href=x>' + words(1, 3, False) + '</a>' if draw.random() < 0.3 else ''}{'<b>' + words(1, 4) if draw.random() < 0.2 else ''}</p>"
        if kind < 0.78:
            return f"<p>{mark}{words(1, 5)}</p>"
        if kind < 0.84:
            return f"<h{draw.randint(2, 4)}>{mark}{words(1, 7, False)}</h{draw.randint(2, 4)}>"
        if kind < 0.89:
            tag = draw.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{mark}{words(2, 15, draw.random() < 0.5)}</li>" for _ in range(draw.randint(2, 5))) + f"</{tag}>"
        if kind < 0.93:
            return f"<blockquote>{'<p>' if draw.random() < 0.5 else ''}{mark}{words(6, 40)}</blockquote>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{mark}{words(1, 3, False)}</td><td>{mark}{words(1, 3, False)}</td></tr>" for _ in range(draw.randint(2, 4))) + "</table>"
        if kind < 0.98:
            return f"<figure><img src=x><figcaption>{mark}{words(3, 12)}</figcaption></figure>"
        return f"<pre>{mark}{words(5, 30)}</pre>"

    def named(name):
        shown = draw.choice((name, f"{name}-{draw.choice(('box', 'area', 'wrap', 'inner', 'list', 'item'))}", f"{draw.choice(('site', 'page', 'main', 'the', 'block'))}-{name}", name.capitalize()))
        return draw.choice((f'class="{shown}"', f'id="{shown}"', f"class={shown}", f'class="{shown} {draw.choice("abcxyz")}"'))

    def items(low, high):
        return "".join(f'<li><a href="/x">{no}{words(1, 3, False)}</a></li>' for _ in range(draw.randint(low, high)))

    def other(kind=None):
        kind = kind or draw.choice(("nav", "menu", "header", "aside", "ad", "notice", "form", "footer", "comments", "related", "named", "hidden"))
        if kind == "nav":
            return f"<nav><ul>{items(2, 8)}</ul></nav>" if draw.random() < 0.6 else f"<nav><a>{no}{words(1, 2, False)}</a> <a>{words(1, 2, False)}</a></nav>"
        if kind == "menu":
            return f"<div {named(draw.choice(('menu', 'navbar', 'breadcrumb', 'navigation')))}><ul>{items(2, 8)}</ul></div>"
        if kind in ("header", "aside", "footer") and draw.random() < 0.4:
            usual = {"header": ("header", "masthead", "topbar"), "aside": ("sidebar", "side", "widget"), "footer": ("footer", "foot", "copyright")}[kind]
            inner = draw.choice((f"<h3>{no}{words(1, 3, False)}</h3><p>{no}{words(3, 40)}</p>", f"<p>{no}{words(4, 50)}</p>", f"<ul>{items(1, 5)}</ul>"))
            return f"<div {named(draw.choice(usual))}>{inner}</div>"
        if kind == "header":
            return f"<header {named('site') if draw.random() < 0.4 else ''}><h1>{no}{words(1, 4, False)}</h1><p>{no}{words(3, 9, False)}</p></header>"
        if kind == "aside":
            return f"<aside><h3>{no}{words(1, 3, False)}</h3><p>{no}{words(5, 50)}</p><ul>{items(1, 4)}</ul></aside>"
        if kind == "form":
            return f'<form action="/s"><p>{no}{words(2, 25)}</p><label>{no}{words(1, 3, False)}</label><input><button>{no}{words(1, 2, False)}</button></form>'
        if kind == "footer":
            return f"<footer>{'<p>' if draw.random() < 0.5 else ''}{no}&copy; {words(2, 25)}</footer>"
        if kind == "comments":
            inner = "".join(f'<{(t := draw.choice(("li", "div", "article")))} class="comment"><p>{no}{words(4, 60)}</p></{t}>' for _ in range(draw.randint(1, 4)))
            tag = draw.choice(("section", "div", "ol"))
            return f"<{tag} {named(draw.choice(('comments', 'replies', 'discussion', 'commentlist')))}><h3>{no}{words(1, 3, False)}</h3>{inner}</{tag}>"
        name = {"ad": ("ad", "ads", "advert", "sponsored", "banner", "promo"), "notice": ("cookie", "notice", "consent", "alert", "newsletter", "popup"), "related": ("related", "share", "social", "recommended", "tags")}.get(kind, NOT_CONTENT)
        attribute = "hidden" if kind == "hidden" else named(draw.choice(name))
        tag = draw.choice(("div", "div", "section", "p"))
        return f"<{tag} {attribute}>{no}{words(3, 60)}</{tag}>" if tag == "p" or draw.random() < 0.5 else f"<{tag} {attribute}><p>{no}{words(3, 60)}</p></{tag}>"

    def marked(page):
        label = np.zeros(len(page.parent), np.int64)
        for i in range(len(page.parent) - 1, -1, -1):
            text = page.text[i]
            if text is not None:
                label[i] = yes in text
            if label[i] and page.parent[i] >= 0 and page.names[page.parent[i]][0] not in ("<body", "<html", "<root"):
                label[page.parent[i]] = 1
        return label

    pages, labels = [], []
    for _ in range(count):
        body = [f"<h1>{yes}{words(2, 9, draw.random() < 0.5)}</h1>"] if draw.random() < 0.7 else []
        body += [prose(yes) for _ in range(draw.randint(1, 9))]
        if draw.random() < 0.35:
            body.insert(draw.randint(1, len(body)), other(draw.choice(("aside", "ad", "notice", "form", "related", "comments"))))
        if draw.random() < 0.12:
            body[0] = f"<header>{body[0]}</header>" if body[0].startswith("<h1") else body[0]
        style = draw.random()
        if style < 0.3:
            main = f"<article>{''.join(body)}</article>"
        elif style < 0.4:
            main = f"<main>{''.join(body)}</main>"
        elif style < 0.75:
            main = f"<div {named(draw.choice(CONTENT))}>{''.join(body)}</div>"
        elif style < 0.85:
            main = f"<div>{''.join(body)}</div>"
        else:
            main = "".join(body)
        before = [other(k) for k in ("header", "nav", "menu", "notice", "ad", "hidden", "form") if draw.random() < 0.3]
        after = [other(k) for k in ("aside", "comments", "related", "form", "named", "footer", "ad") if draw.random() < 0.35]
        if draw.random() < 0.1:
            before = after = []
        main = "".join((*before[1:], main, *after[1:]))
        if draw.random() < 0.4:
            name = draw.choice(("wrapper", "container", "page", "layout", "row", "main", "grid", "site", ""))
            main = f"<div {draw.choice(('id', 'class'))}={name}>{main}</div>" if name else f"<div>{main}</div>"
        bare = draw.random() < 0.08
        page = parse("".join(body)) if bare else parse(f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before[:1])}{main}{''.join(after[:1])}</body></html>")
        pages.append(page)
        labels.append(marked(page))
    for _ in range(count // 15):  # what stands in for scripts and embedded things, outside of an article and inside
        tag = draw.choice(("noscript", "object", "iframe"))
        aside, inside = f"<{tag}>{no}{words(3, 14)}</{tag}>", f"<{tag}><p>{yes}{words(8, 40)}</p></{tag}>"
        body = "".join([prose(yes), inside, prose(yes)] if draw.random() < 0.4 else [prose(yes), prose(yes)])
        main = f"<article>{body}</article>" if draw.random() < 0.5 else f"<div {named(draw.choice(CONTENT))}>{body}</div>"
        page = parse(f"<!DOCTYPE html><html><head><title>x</title></head><body>{aside}{other('nav')}{main}{other('footer')}</body></html>")
        pages.append(page)
        labels.append(marked(page))
    return pages, labels


def fit(pages: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the pages put together by rule and at most ``sample`` pages of the table that name their parts.

    The table's pages are chosen by a hash of their source, so repeated ones are one; those over ``chars``
    characters are not used for learning.  Only hashes are ranked; the driver gets the chosen pages alone.
    """
    draw = F.xxhash64("html", F.lit(23))
    fitting = pages.where(F.col("html").isNotNull() & (F.length("html") <= chars) & F.col("html").rlike("(?i)<(article|main)\\b"))
    chosen = [r.draw for r in fitting.select(draw.alias("draw")).orderBy("draw").limit(2 * sample).collect()]
    chosen = sorted(set(chosen))[:sample]
    trees, labels = labelled_pages()
    if chosen:
        rows = fitting.where(draw.isin(chosen)).groupBy(draw.alias("draw")).agg(F.min("html").alias("html")).collect()
        for row in sorted(rows, key=lambda r: r["draw"]):
            page = parse(row["html"])
            label = weak_labels(page)
            if label is not None:
                trees.append(page)
                labels.append(label)
    return learn(trees, labels)


def extract(pages: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: blocks with P(content) of at least ``least``.

    Character references are decoded, white space in a block becomes one blank, blocks are joined
    in page order by line feeds.  Null or empty pages, and pages without content, give an empty text.  Whole pages
    are read, however long, a few megabytes or one page at a time.  Repeated rows give equal rows; an empty table gives
    none; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned = shared.value
        for batch in by_bytes(batches, lambda b: b.column(2), BYTES_AT_ONCE, PAGES_AT_ONCE):
            texts = []
            trees = [parse(s or "") for s in batch.column(2).to_pylist()]
            content = learned.content(trees)
            base = 0
            for tree in trees:
                own = content[base : base + len(tree.text)]
                texts.append("\n".join(t for t, p in zip(tree.text, own) if t is not None and p >= least))
                base += len(tree.text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
