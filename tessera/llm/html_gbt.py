"""Main text of web pages with gradient-boosted trees over DOM nodes.

A page is parsed into nodes (elements that make a block or carry attributes).
Each node has features of its tag, its attribute tokens, its subtree (length,
link share, text per tag, punctuation), its depth and its siblings; boosted
trees, trained in numpy, give the probability that its subtree holds article
text. Labels are decoded over the tree: a dropped node drops all below it, so
no text is kept inside a dropped part, and of all consistent choices the one
of highest summed log-probability is taken.

Training pages are a bounded sample of the input (``FIT_PAGES``). They are
labelled by their semantic elements, and their texts are also set into pages of
random layout (articles in plain containers, menus, sidebars, notices, forms,
adverts and reader comments by tag or by attribute), so that the trees don't
depend on one layout. Scripts and styles are never text.

Defined cases: null or empty html gives the empty text; markup that is not
closed ends with its parent or the page; rows of one page_id are extracted one
by one; an empty table gives an empty result; other columns are ignored; a long
page is handled whole.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 300
#: Longer pages are not in the sample.
FIT_LENGTH = 500_000
MADE_PAGES = 700
TREES = 60
TREE_DEPTH = 4
BINS = 32
SEED = 42

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body br button canvas center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol
optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video""".split())
INLINE_BLOCKS = frozenset("br button select option optgroup textarea".split())
GROUPS = {g: i for i, names in enumerate((
    "p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu dir", "div center", "section", "article", "main", "nav", "header",
    "footer", "aside", "form fieldset button select option input label textarea legend", "table tbody thead tr td th",
    "figure figcaption", "blockquote pre", "html body", "head title")) for g in names.split()}
N_GROUPS = 19
#: An open element of the value's kinds ends where the key starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
#: Elements inside which a search for an open one to end stops.
FENCES = frozenset("ul ol dl table select td th body html article section main nav aside header footer form div".split())

# Words of class, id and role attributes that tell of parts around an article, and of the article.
AROUND = frozenset("""ad ads advert advertisement adverts aside banner bar breadcrumb breadcrumbs byline caption comment comments consent
cookie cookies copyright credits disclaimer disqus feedback foot footer form gdpr head header legal links login masthead menu
meta modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promoted promotion
recommend recommended related reply replies responses rss search share sharing sidebar signup skip social sponsor sponsored
subscribe subscription tags teaser toc toolbar topbar tracking warning widget widgets""".split())
WITHIN = frozenset("article body content entry main page post story text".split())

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>?)", re.S)
_NAME_END = re.compile(r"[\s/>]")
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_POINTS = re.compile(r"[.,;:!?]")


class TagEnds:
    """Which `<` can start a tag: from there a `>` outside quotes must follow. One
    backward pass over the page's quotes and `>` tells it for every place, so that a
    long page of tags that never end is not read to its end for each of them."""

    def __init__(self, source: str):
        self.at = [m.start() for m in re.finditer("[>\"']", source)]
        kinds = [source[i] for i in self.at]
        n = len(kinds)
        self.ok = [False] * (n + 1)       # read on from before this one, outside quotes
        after = {}                        # the next quote of each kind
        for t in range(n - 1, -1, -1):
            c = kinds[t]
            if c == ">":
                self.ok[t] = True
            else:
                self.ok[t] = c in after and self.ok[after[c] + 1]
                after[c] = t
        # quotes may be part of a tag's name: how many of the first t are followed well
        self.named = [0]
        for t in range(n):
            self.named.append(self.named[-1] + (kinds[t] != ">" and self.ok[t + 1]))
        self.source, self.name_end = source, -1

    def may_start(self, at: int) -> bool:
        """Does a tag start at the `<` at ``at`` (ascending from call to call)?"""
        first = at + (3 if self.source[at + 1:at + 2] == "/" else 2)
        t = bisect_left(self.at, first)
        if self.ok[t]:
            return True
        if self.name_end < first:
            m = _NAME_END.search(self.source, first)
            self.name_end = m.start() if m else len(self.source)
        end = bisect_left(self.at, self.name_end)
        if end > t and self.named[end] > self.named[t]:
            return True
        return end < len(self.at) and self.at[end] == self.name_end and self.ok[end]


class Page:
    """Nodes in page order, and the page's text as (node, text) with None for a block's end."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["#"], [-1], [0], [()]
        self.flow: list[tuple[int, str] | None] = []
        self.own, self.link, self.points, self.tags, self.inputs = [0], [0], [0], [0], [0]
        stack: list[tuple[str, int]] = [("#", 0)]
        at, end, links = 0, len(source), 0
        open_: Counter = Counter()
        ends = None  # asked only where a tag did not end
        while at < end:
            m, stop = None, at
            while m is None:
                stop = source.find("<", stop)
                if stop < 0:
                    break
                if ends is None or source[stop + 1:stop + 2] in ("!", "?") or ends.may_start(stop):
                    m = _TAG.match(source, stop)
                    if m is None and ends is None and source[stop + 1:stop + 2] not in ("!", "?"):
                        ends = TagEnds(source)
                stop += m is None
            if m is None:
                stop = end
            if stop > at:
                self._text(source[at:stop], stack[-1][1], links)
            if not m:
                break
            at, name = m.end(), m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                depth = open_[name] and next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if depth:
                    open_.subtract(s[0] for s in stack[depth:])
                    links -= sum(s[0] == "a" for s in stack[depth:])
                    if any(s[0] in BLOCKS for s in stack[depth:]):
                        self.flow.append(None)
                    del stack[depth:]
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if name in BLOCKS:
                self.flow.append(None)
                if name not in INLINE_BLOCKS:
                    links -= self._end(stack, open_, {"p"}, FENCES | {"button"})
                    if name in ENDS:
                        links -= self._end(stack, open_, ENDS[name], FENCES - {"td", "th"} if name in ("tr", "td", "th") else FENCES)
            node = stack[-1][1]
            self.tags[node] += 1
            tokens = tuple(t.lower() for a in _ATTR.finditer(m[4]) for t in _TOKEN.findall(a[2] or a[3] or a[4] or "")) if "=" in m[4] else ()
            if name in VOID:
                self.inputs[node] += name == "input"
                continue
            if name in BLOCKS or tokens:
                self.tag.append(name)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.tokens.append(tokens)
                for kept in (self.own, self.link, self.points, self.tags, self.inputs):
                    kept.append(0)
                node = len(self.tag) - 1
                self.inputs[node] = name in ("button", "select", "textarea")
            links += name == "a"
            if not m[4].endswith("/") or name in BLOCKS or name == "a":
                stack.append((name, node))
                open_[name] += 1

    @staticmethod
    def _end(stack: list, open_: Counter, names: set, fences: frozenset) -> int:
        """Close the nearest open element of ``names``; gives the links closed."""
        if not any(open_[n] > 0 for n in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                n = sum(s[0] == "a" for s in stack[i:])
                open_.subtract(s[0] for s in stack[i:])
                del stack[i:]
                return n
            if stack[i][0] in fences:
                return 0
        return 0

    def _text(self, raw: str, node: int, links: int) -> None:
        text = htmllib.unescape(raw) if "&" in raw else raw
        self.flow.append((node, text))
        n = len(text.strip())
        if n:
            self.own[node] += n
            self.points[node] += len(_POINTS.findall(text))
            if links > 0:
                self.link[node] += n

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The consistent choice of kept nodes with the highest summed log-probability;
        a node's own text adds weight to its vote."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        weight = 1 + np.log1p(np.array(self.own, float)) / 4
        keep, drop = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
        for i in range(len(keep) - 1, 0, -1):
            keep[self.parent[i]] += max(keep[i], drop[i])
            drop[self.parent[i]] += drop[i]
        kept = np.zeros(len(keep), bool)
        kept[0] = True
        for i in range(1, len(keep)):
            kept[i] = kept[self.parent[i]] and keep[i] > drop[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        """Kept text: white space in a block becomes one blank, blocks are joined by one."""
        blocks, now = [], []
        for item in [*self.flow, None]:
            if item is None:
                if now and (block := " ".join("".join(now).split())):
                    blocks.append(block)
                now = []
            elif kept[item[0]]:
                now.append(item[1])
        return " ".join(blocks)

    def labels(self) -> np.ndarray | None:
        """Whether a node's subtree holds article text, by semantic elements; None without them."""
        inside = [False] * len(self.tag)
        outside = [False] * len(self.tag)
        for i, (t, ts) in enumerate(zip(self.tag, self.tokens)):
            up = self.parent[i]
            inside[i] = (up >= 0 and inside[up]) or t in ("article", "main") or "main" in ts
            outside[i] = (up >= 0 and outside[up]) or t in ("nav", "header", "footer", "aside", "form", "button", "head", "menu",
                                                           "select", "dialog") or (t not in ("article", "main", "body", "html") and bool(AROUND & set(ts)))
        if not any(inside):
            return None
        return self._holding(np.array([a and not b and o > 0 for a, b, o in zip(inside, outside, self.own)]))

    def _holding(self, own: np.ndarray) -> np.ndarray:
        out = own.copy()
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] |= out[i]
        return out


def features(pages: list[Page], odds: dict[str, float]) -> np.ndarray:
    """Features of all nodes of some pages, one page after the other."""
    sizes = np.array([len(p.tag) for p in pages])
    roots = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    flat = lambda name: np.array([v for p in pages for v in getattr(p, name)], float)
    tags_of, tokens_of = [t for p in pages for t in p.tag], [t for p in pages for t in p.tokens]
    n, depth = len(tags_of), flat("depth").astype(np.int64)
    up = np.maximum(flat("parent").astype(np.int64), 0) + roots[page]
    group = np.array([GROUPS.get(t, N_GROUPS - 1) for t in tags_of])
    own = flat("own")
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 1)))[1:]
    sums = np.stack([own, flat("link"), flat("points"), flat("tags"), flat("inputs"), group == GROUPS["p"], group == GROUPS["li"],
                     np.ones(n)], axis=1).astype(float)
    for level in reversed(levels):
        np.add.at(sums, up[level], sums[level])
    sub, link, points, tags, inputs, ps, lis, nodes = sums.T
    around, within, low, high = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, ts in enumerate(tokens_of):
        if ts:
            got = [odds.get(t, 0.0) for t in ts]
            around[i], within[i] = sum(t in AROUND for t in ts), sum(t in WITHIN for t in ts)
            low[i], high[i] = min(got), max(got)
    anc = np.stack([around, within, np.isin(group, [GROUPS[t] for t in ("nav", "header", "footer", "aside", "form")]),
                    np.isin(group, [GROUPS["article"], GROUPS["main"]])], axis=1).astype(float)
    for level in levels:
        anc[level] += anc[up[level]]
    before = np.cumsum(own) - own
    before -= before[roots][page]
    # siblings: place, number, neighbours' lengths, share of the same kind
    up[roots] = n + np.arange(len(pages))  # a root has no siblings
    order = np.lexsort((np.arange(n), up))
    same = np.concatenate([[False], up[order][1:] == up[order][:-1]])
    first = np.maximum.accumulate(np.where(~same, np.arange(n), 0))
    place, prev, after = np.empty(n), np.zeros(n), np.zeros(n)
    number = np.bincount(up)[up].astype(float)
    place[order] = np.arange(n) - first
    prev[order[1:]] = np.where(same[1:], sub[order[:-1]], 0)
    after[order[:-1]] = np.where(same[1:], sub[order[1:]], 0)
    alike = np.unique(up * 64 + group, return_inverse=True)[1]
    like = np.bincount(alike)[alike] / number
    up[roots] = roots
    total = np.maximum(1.0, sub[roots][page])
    columns = [around, within, low, high, *anc.T, np.log1p(own), np.log1p(sub), sub / total, link / np.maximum(sub, 1),
               sub / (1 + tags), np.log1p(tags), points / np.maximum(sub, 1), inputs, np.log1p(ps), np.log1p(lis), np.log1p(nodes),
               depth.astype(float), place, number, place / number, np.log1p(prev), np.log1p(after), like,
               sub / np.maximum(sub[up], 1), before / total, own / np.maximum(sub, 1), group[up].astype(float)]
    return np.concatenate([np.eye(N_GROUPS)[group], np.stack(columns, axis=1)], axis=1).astype(np.float32)


def _made_page(rng: random.Random, texts: list[str]) -> tuple[str, str]:
    """A page of random layout around article paragraphs, with markers on them."""
    short = lambda: htmllib.escape(" ".join(rng.choice(texts).split()[:rng.randrange(1, 7)]))
    long = lambda: htmllib.escape(" ".join(rng.choice(texts).split()[:rng.randrange(4, 90)]))
    words = sorted(AROUND)
    sep = rng.choice(["-", "_", " "])

    def attrs(*names: str) -> str:
        name = sep.join([*names, *rng.choices(["box", "wrap", "area", "x1", "left", "block"], k=rng.randrange(0, 2))])
        return f'{rng.choice(["class", "class", "id"])}="{name}"'

    def menu() -> str:
        items = "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(rng.randrange(2, 9)))
        return rng.choice(["<nav>{}</nav>", "<div " + attrs(rng.choice(["menu", "nav", "navbar", "breadcrumbs", "links"])) + ">{}</div>",
                           "<header>{}</header>"]).format(f"<ul>{items}</ul>")

    def around(name: str, deep: bool = True) -> str:
        body = "".join(rng.choice([f"<p>{long()}</p>", f"<div>{short()}</div>", long(), f'<a href="#">{short()}</a>', f"<h3>{short()}</h3>"])
                       for _ in range(rng.randrange(1, 4)))
        tag = rng.choice(["div", "section", "aside", "div"] if deep else ["div", "p", "span"])
        return f"<{tag} {attrs(name)}>{body}</{tag}>"

    def form() -> str:
        return f'<form><label>{short()}</label><input name="q"><button>{short()}</button><p>{short()}</p></form>'

    def comments() -> str:
        each = "".join(f'<div {attrs("comment")}><p>{long()}</p></div>' for _ in range(rng.randrange(1, 6)))
        title = f"<h2>{short()}</h2>" if rng.random() < 0.5 else ""
        return f'<{(t := rng.choice(["section", "div", "ol"]))} {attrs(rng.choice(["comments", "responses", "replies", "disqus", "feedback"]))}>{title}{each}</{t}>'

    def head() -> str:
        return f'<header><div>{short()}</div><p>{rng.choice([short, long])()}</p></header>'

    def foot() -> str:
        return rng.choice([f"<footer>&copy; {long()}</footer>", f'<footer><p>{long()}</p><a href="#">{short()}</a></footer>', around("footer")])

    parts, mark = [], "\x00"
    for i in range(rng.randrange(1, 14)):
        parts.append(rng.choice(["<p>{}</p>"] * 6 + ["<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p><b>{}</b><br>", "<div>{}</div>",
                                 '<p class="lead">{}</p>', "<pre>{}</pre>", '<table><tr><td>{}</td></tr></table>']).format(mark + long()))
        if rng.random() < 0.12:
            parts.append(rng.choice([around(rng.choice(words)), around("ad"), form(), f'<aside>{long()}</aside>', around("promo", False)]))
    if rng.random() < 0.7:
        parts.insert(0, f"<h1>{mark}{short()}</h1>")
    inner = "".join(parts) + (comments() if rng.random() < 0.2 else "") + (f"<footer>{short()}</footer>" if rng.random() < 0.1 else "")
    name = rng.choice(["content", "post", "story", "entry", "article", "text", "main"])
    body = rng.choice(["<article>{}</article>"] * 4 + ["<main><article>{}</article></main>", "<main>{}</main>", f"<div {attrs(name)}>{{}}</div>",
                       f"<div {attrs(name, 'body')}>{{}}</div>", "<div>{}</div>", f'<article {attrs(name)}>{{}}</article>',
                       '<div role="main">{}</div>', "<section>{}</section>"]).format(inner)
    above = [f() for f in (menu, head, lambda: around(rng.choice(["banner", "notice", "cookie", "ad", "ads"])), form) if rng.random() < 0.45]
    below = [f() for f in (comments, lambda: around("sidebar"), lambda: f"<aside><h3>{short()}</h3><p>{long()}</p></aside>", lambda: around(rng.choice(words)),
                           lambda: around("related"), form, menu, foot) if rng.random() < 0.35]
    rng.shuffle(above)
    wrap = rng.choice(["{}"] * 3 + ['<div class="wrapper">{}</div>', '<div id="page">{}</div>', "<div><div>{}</div></div>"])
    return (f"<!DOCTYPE html><html><head><title>{short()}</title><style>p{{}}</style></head><body>"
            + wrap.format("".join(above) + body + "".join(below)) + "</body></html>"), mark


def training_pages(sources: list[str]) -> list[tuple[Page, np.ndarray]]:
    """Labelled pages: those of the sample with semantic elements, and made ones."""
    out, texts = [], []
    for s in sources:
        page = Page(s)
        labels = page.labels()
        if labels is not None:
            out.append((page, labels))
        texts += [t for n, t in (x for x in page.flow if x) if len(t.split()) > 3][:40]
    rng = random.Random(SEED)
    texts = texts or [" ".join(rng.choices(["some", "plain", "words", "of", "an", "article,", "and", "more."], k=30)) for _ in range(50)]
    for _ in range(MADE_PAGES):
        source, mark = _made_page(rng, texts)
        page = Page(source)
        own = np.zeros(len(page.tag), bool)
        for item in page.flow:
            if item and mark in item[1]:
                own[item[0]] = True
        out.append((page, page._holding(own)))
    return out


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, rate: float = 0.2):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bins(x)
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        f, self.depth, self.trees = np.full(len(y), self.bias), depth, []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            where = np.zeros(len(y), np.int64)
            split = np.zeros(2 ** depth - 1, np.int64)
            cut = np.full(2 ** depth - 1, BINS, np.int64)
            for level in range(depth):
                n, base = 2 ** level, 2 ** level - 1
                best = np.full(n, 1e-6)
                gs, hs = np.bincount(where, g, n), np.bincount(where, h, n)
                for c in range(x.shape[1]):
                    at = where * BINS + b[:, c]
                    gl = np.cumsum(np.bincount(at, g, n * BINS).reshape(n, BINS), axis=1)[:, :-1]
                    hl = np.cumsum(np.bincount(at, h, n * BINS).reshape(n, BINS), axis=1)[:, :-1]
                    gain = gl ** 2 / (hl + 1) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + 1) - (gs ** 2 / (hs + 1))[:, None]
                    gain[(hl < 0.5) | (hs[:, None] - hl < 0.5)] = 0
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(n), top] > best
                    best[better] = gain[np.arange(n), top][better]
                    split[base:base + n][better], cut[base:base + n][better] = c, top[better]
                where = where * 2 + (b[np.arange(len(y)), split[base + where]] > cut[base + where])
            value = -rate * np.bincount(where, g, 2 ** depth) / (np.bincount(where, h, 2 ** depth) + 1)
            f = f + value[where]
            self.trees.append((split, cut, value))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, rows, f = self._bins(x), np.arange(len(x)), np.full(len(x), self.bias)
        for split, cut, value in self.trees:
            where = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = where + 2 ** level - 1
                where = where * 2 + (b[rows, split[at]] > cut[at])
            f += value[where]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


class Extractor:
    """Attribute token odds and trees; trained on pages' sources."""

    def __init__(self, sources: list[str]):
        pages = training_pages(sources)
        seen: dict[str, list[float]] = {}
        for page, labels in pages:
            for ts, y in zip(page.tokens, labels):
                for t in set(ts):
                    s = seen.setdefault(t, [0.5, 0.5])
                    s[int(y)] += 1
        self.odds = {t: float(np.log(s[1] / s[0])) for t, s in seen.items() if s[0] + s[1] >= 6}
        x = features([p for p, _ in pages], self.odds)
        self.trees = Trees(x, np.concatenate([y for _, y in pages]).astype(float))

    def extract(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        if not pages:
            return []
        p = self.trees.predict(features(pages, self.odds))
        at = np.cumsum([len(page.tag) for page in pages])[:-1]
        return [page.text(page.decode(q)) for page, q in zip(pages, np.split(p, at))]


def train(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> Extractor:
    """On a bounded sample of whole pages, the first in the order of a hash of their source."""
    sources = (pages.select(pages[html_col].cast("string").alias("html")).filter(F.length("html").between(1, FIT_LENGTH))
               .withColumn("h", F.xxhash64("html")))
    # first the hashes alone, so that no task sends pages that are not chosen
    least = sources.select("h").distinct().orderBy("h").limit(fit_pages).agg(F.max("h")).first()[0]
    if least is None:
        return Extractor([])
    chosen = sources.filter(F.col("h") <= least).groupBy("h").agg(F.min("html").alias("html"))
    return Extractor([r.html for r in sorted(chosen.collect())])


def extract_main_text(pages: DataFrame, extractor: Extractor, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html", at_once: int = 200) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, at_once):
                part = b.slice(a, at_once)
                texts = extractor.extract([s or "" for s in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
