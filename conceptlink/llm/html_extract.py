"""Main text of web pages: boosted trees over DOM nodes, decoded hierarchically.

A tolerant parser builds the tree.  Every element gets features (tag, attribute tokens, depth,
subtree density, links, siblings) and a probability to be main content from gradient-boosted trees.
Decoding gives each node one of three states, undecided, kept or dropped, so that the sum of log
probabilities is greatest, under the rule that nothing below a dropped node is kept and nothing below
a kept node becomes undecided again.  The trees are trained on pages composed here, whose
truth is known by construction, with many kinds of layout; no page of the corpus is needed for that.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-label|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
# HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# The tags and attribute words that are features of their own.
TAGS = "article main section div p h1 h2 h3 ul ol li a nav header footer aside form table blockquote pre figure span b body".split()
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts banner bar breadcrumb breadcrumbs captcha comment comments consent contact cookie cookies "
    "copyright dialog disclaimer discussion feedback foot footer form gdpr head header legal links login masthead menu modal nav "
    "navbar navigation newsletter notice notices outbrain overlay pager pagination popup privacy promo promoted promotion "
    "recommended register related reply respond rss search share sharing side sidebar signup skip social sponsor sponsored "
    "subscribe tags teaser toc toolbar tools topbar widget".split()
)
CONTENT = frozenset("article articlebody blog body content entry main page post prose read reader story text".split())
REMARKS = frozenset("comment comments discussion reply replies respond disqus responses reviews".split())


class Tree:
    """Elements in page order (0 is the page), their parents and what stands directly in them."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.words, self.depth = ["#page"], [-1], [()], [0]
        self.texts: list[tuple[int, str, bool]] = []  # element, text, whether a block begins before it
        self.open: Counter[str] = Counter()  # elements of each name on the stack
        stack, fresh, at, n = [0], True, 0, len(page)
        while at < n:
            found = MARKUP.search(page, at)
            upto = found.start() if found else n
            if upto > at:
                self.texts.append((stack[-1], html.unescape(page[at:upto]), fresh))
                fresh = False
            if not found:
                break
            name = found[2]
            if name is None:
                end = page.find("-->" if found[0] == "<!--" else ">", found.end())
                at = n if end < 0 else end + (3 if found[0] == "<!--" else 1)
                continue
            at = tag_end(page, found.end())
            attributes = page[found.end() : at - 1]
            name = name.lower()
            if found[1]:
                fresh |= name in BLOCK
                self._close(stack, name)
                continue
            if name in BLOCK:
                fresh = True
            if name == "br" or name == "wbr":
                self.texts.append((stack[-1], " " if name == "br" else "", False))
                continue
            if name in VOID:
                continue
            if name in RAW:
                # a raw element without an end runs to the end of the page, as in browsers
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if name in CLOSES_P:
                self._close(stack, "p")
            if name in SELF_CLOSING:
                self._imply(stack, name)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(self.depth[stack[-1]] + 1)
            self.words.append(_attribute_words(attributes) if attributes else ())
            if not attributes.endswith("/"):
                stack.append(len(self.tag) - 1)
                self.open[name] += 1

    def _cut(self, stack: list[int], k: int) -> None:
        self.open.subtract(self.tag[i] for i in stack[k:])
        del stack[k:]

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                self._cut(stack, k)
                return
            if name not in BLOCK and self.tag[stack[k]] in BLOCK:
                return
            if name == "p" and self.tag[stack[k]] in ("article", "section", "div", "td", "li", "main", "aside", "body"):
                return

    def _imply(self, stack: list[int], name: str) -> None:
        if not any(self.open[x] for x in SELF_CLOSING[name]):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in SELF_CLOSING[name]:
                self._cut(stack, k)
                return
            if self.tag[stack[k]] in SCOPE[name]:
                return


def tag_end(page: str, at: int) -> int:
    """One past the ``>`` that ends a tag and stands in no quoted value; past the next one where a quote is left open."""
    k, first = at, -1
    while (found := QUOTE_OR_END.search(page, k)) is not None:
        if found[0] == ">":
            return found.end()
        if first < 0 and (first := page.find(">", at)) < 0:
            break
        k = page.find(found[0], found.end()) + 1
        if not k:
            return first + 1
    return len(page)  # a tag that does not end takes the rest, as in browsers


def _attribute_words(raw: str) -> tuple[str, ...]:
    out = []
    for m in ATTRIBUTE.finditer(raw):
        if m[1].lower() == "hidden":
            out.append("hidden")
        for part in PARTS.findall(m[2] or m[3] or m[4] or ""):
            out.append(part.lower())
    return tuple(out)


N_FEATURES = len(TAGS) + 20


def features(tree: Tree) -> np.ndarray:
    """One row per element: see the names at the assignments."""
    n = len(tree.tag)
    parent = np.array(tree.parent)
    text, marks, linked = np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = np.zeros(n, bool)
    for k in range(1, n):
        in_link[k] = tree.tag[k] == "a" or in_link[parent[k]]
    for node, value, _ in tree.texts:
        size = len(value.strip())
        text[node] += size
        marks[node] += value.count(".") + value.count(",")
        linked[node] += size if in_link[node] else 0
    own = text.copy()
    count, paragraphs, forms = np.ones(n), np.zeros(n), np.zeros(n)
    bad, good, remark = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        words = tree.words[k]
        paragraphs[k] = tree.tag[k] in ("p", "blockquote", "pre")
        forms[k] = tree.tag[k] in ("form", "fieldset", "label")
        bad[k] = sum(w in BOILERPLATE for w in words) + (tree.tag[k] in ("nav", "footer", "aside", "form", "menu"))
        good[k] = sum(w in CONTENT for w in words) + (tree.tag[k] in ("article", "main"))
        remark[k] = sum(w in REMARKS for w in words)
    for k in range(n - 1, 0, -1):
        for x in (text, marks, linked, count, paragraphs, forms):
            x[parent[k]] += x[k]
    above_bad, above_good, above_remark = np.zeros(n), np.zeros(n), np.zeros(n)
    rank, family = np.zeros(n), np.zeros(n)
    children = np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        above_bad[k] = above_bad[p] + bad[p]
        above_good[k] = above_good[p] + good[p]
        above_remark[k] = above_remark[p] + remark[p]
        rank[k] = children[p]
        children[p] += 1
    family[1:] = children[parent[1:]]
    out = np.zeros((n, N_FEATURES), np.float32)
    place = {t: i for i, t in enumerate(TAGS)}
    for k in range(n):
        if tree.tag[k] in place:
            out[k, place[tree.tag[k]]] = 1
    before = np.concatenate(([0], np.cumsum(own)[:-1]))
    total = max(1.0, text[0])
    columns = (
        np.array(tree.depth), np.log1p(text), np.log1p(own), linked / np.maximum(text, 1), text / count, marks / np.maximum(text, 1) * 100,
        text / total, before / total, np.log1p(paragraphs), np.log1p(forms), bad, good, remark, above_bad, above_good, above_remark,
        rank / np.maximum(family, 1), np.log1p(family), np.log1p(children), text / np.maximum(text[np.maximum(parent, 0)], 1),
    )
    out[:, len(TAGS) :] = np.stack(columns, axis=1)
    return out


class BoostedTrees:
    """Gradient-boosted regression trees on log loss; splits at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2) -> None:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33)[1:-1])) for k in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1)
        p = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
        self.base, self.depth = float(np.log(p / (1 - p))), depth
        self.feature, self.cut, self.value = [], [], []
        logit = np.full(len(y), self.base)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-logit))
            grad, hess = weight * (y - prob), weight * prob * (1 - prob)
            feature, cut = np.zeros(2**depth, int), np.full(2**depth, np.inf)
            node = np.ones(len(y), int)
            for level in range(depth):
                for leaf in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(node == leaf)
                    best = self._split(bins[rows], grad[rows], hess[rows])
                    if best:
                        feature[leaf], cut[leaf] = best[0], self.edges[best[0]][best[1]]
                        node[rows] = 2 * leaf + (bins[rows, best[0]] > best[1])
                    else:
                        node[rows] = 2 * leaf
            g, h = (np.bincount(node, v, 2 ** (depth + 1)) for v in (grad, hess))
            value = rate * g / (h + 1)
            logit += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        self.feature, self.cut, self.value = np.array(self.feature), np.array(self.cut), np.array(self.value)

    def _split(self, bins: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-3, None
        if len(grad) < 20:
            return None
        total_g, total_h = grad.sum(), hess.sum()
        parent = total_g**2 / (total_h + 1)
        for k, edges in enumerate(self.edges):
            if not len(edges):
                continue
            g = np.cumsum(np.bincount(bins[:, k], grad, len(edges) + 1))[:-1]
            h = np.cumsum(np.bincount(bins[:, k], hess, len(edges) + 1))[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - parent
            gain[(h < 1) | (total_h - h < 1)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, found = float(gain[at]), (k, at)
        return found

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out


UNDECIDED, KEPT, DROPPED = 0, 1, 2


def decode(tree: Tree, logits: np.ndarray) -> np.ndarray:
    """The best consistent states of all elements.

    Kept scores log P(main), dropped log P(not), weighted by the text that stands directly in the
    element; in undecided elements their own text is dropped at a price.  An element that only wraps
    one other is undecided for nothing, so that no depth of wrappers speaks against what is in them.
    """
    n = len(tree.tag)
    weight = np.full(n, 0.3)
    for node, value, _ in tree.texts:
        weight[node] += min(3.0, len(value.strip()) / 20)
    wraps = (np.bincount(np.array(tree.parent[1:], np.int64), minlength=n) == 1) & (weight == 0.3)
    main, other = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    price = np.where(wraps, 0.0, np.minimum(-0.4 * weight, other * weight * 0.5 - 0.2))
    score = np.stack([price, main * weight, other * weight], axis=1)
    choice = np.zeros((n, 3), np.int8)
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        u, keep, drop = score[k]
        best = max(u, keep, drop)
        choice[k] = (UNDECIDED if u == best else KEPT if keep == best else DROPPED), (KEPT if keep >= drop - 0.5 else DROPPED), DROPPED
        score[p] += best, max(keep, drop - 0.5), drop
    state = np.zeros(n, np.int8)
    for k in range(1, n):
        state[k] = choice[k, state[tree.parent[k]]]
    return state


def main_text(tree: Tree, state: np.ndarray) -> str:
    """Blocks of the kept elements: white space becomes one space within a block, one newline between blocks."""
    blocks, current = [], []
    for node, value, fresh in tree.texts:
        if fresh and current:
            blocks.append(current)
            current = []
        if state[node] == KEPT:
            current.append(value)
        elif fresh is False and current and value.strip():
            current.append(" ")
    blocks.append(current)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


# ---------------------------------------------------------------- pages for training


def compose_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of random layout and the texts of its main content's blocks."""
    letters = "etaoinshrdlucmfwypvbgk"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)]
    word = lambda: rng.choice(vocabulary)
    some = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda: (some(4, 18).capitalize() + rng.choice([".", ".", ", " + some(2, 8) + "."]))
    paragraph = lambda lo=1, hi=6: " ".join(sentence() for _ in range(rng.randint(lo, hi)))
    one = rng.choice
    maybe = lambda p: rng.random() < p
    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"
    named = lambda tag, names, inner: f'<{tag} {one(["class", "id"])}="{one(names)}">{inner}</{tag}>'
    truth: list[str] = []

    def keep(text: str) -> str:
        truth.append(text)
        return text

    def advert() -> str:
        return one(
            [
                named("div", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "ad-container"], one([sentence(), link(), paragraph(1, 2)])),
                named("aside", ["ad", "promo", "related", "sponsor"], f"<p>{paragraph(1, 2)}</p>"),
                f"<aside>{paragraph(1, 2)}</aside>",
            ]
        )

    def form() -> str:
        inner = f"<label>{some(1, 4)}</label><input name='q'><p>{sentence()}</p><button>{word()}</button>"
        return one([f"<form>{inner}</form>", named("form", ["newsletter", "search", "login", "subscribe"], inner), named("div", ["newsletter", "signup"], f"<form>{inner}</form>")])

    def sidebar() -> str:
        inner = f"<h3>{some(1, 3)}</h3>" + one([menu(), f"<p>{paragraph(1, 3)}</p>", menu() + f"<p>{sentence()}</p>"])
        return one([f"<aside>{inner}</aside>", named("div", ["sidebar", "side", "widget", "related", "sidebar-right"], inner), named("aside", ["sidebar", "widget"], inner)])

    def comments() -> str:
        each = "".join(
            named("div", ["comment", "comment-body", "reply"], f"<b>{word()}</b><p>{paragraph(1, 4)}</p>") if maybe(0.7) else f"<li><p>{paragraph(1, 3)}</p></li>"
            for _ in range(rng.randint(1, 5))
        )
        inner = f"<h2>{some(1, 2)}</h2>" + each
        return one([named("section", ["comments", "discussion", "responses"], inner), named("div", ["comments", "comment-list", "disqus", "comments-area"], inner), named("ol", ["comments", "commentlist"], each)])

    def notice() -> str:
        return named(one(["div", "div", "p", "section"]), ["cookie", "cookie-notice", "notice", "consent", "gdpr", "cookie-banner", "popup", "disclaimer"], one([paragraph(1, 2), f"<p>{paragraph(1, 3)}</p>" + f"<button>{word()}</button>"]))

    def header() -> str:
        inner = one([some(1, 4), f"<h2>{some(1, 4)}</h2>", f"<p>{some(2, 6)}</p>"]) + (menu() if maybe(0.4) else "")
        return one([f"<header>{inner}</header>", named("div", ["header", "masthead", "site-header", "topbar"], inner)])

    def nav() -> str:
        return one([f"<nav>{menu()}</nav>", named("div", ["menu", "nav", "navbar", "navigation", "breadcrumbs"], menu()), f"<nav>{' '.join(link() for _ in range(4))}</nav>"])

    def footer() -> str:
        inner = one([f"&copy; {word()} &middot; {sentence()}", f"<p>{sentence()}</p>" + menu(), some(3, 10), f"<p>{paragraph(1, 2)}</p>"])
        return one([f"<footer>{inner}</footer>", named("div", ["footer", "foot", "site-footer", "copyright"], inner)])

    def block() -> str:
        kind = rng.random()
        if kind < 0.62:
            text = keep(paragraph(*one([(1, 1), (1, 3), (2, 8)])))
            if maybe(0.2):
                head, _, tail = text.partition(" ")
                text = f"{head} {one(['<b>', '<i>', '<em>', '<span>'])}{tail}"
                return f"<p>{text}</{text.split('<')[1].split('>')[0]}></p>"
            if maybe(0.12):
                head, _, tail = text.rpartition(" ")
                return f'<p>{head} <a href="/x">{tail}</a></p>'
            return f"<p>{text}" + one(["</p>", "</p>", "", "<br>"])
        if kind < 0.72:
            return f"<h{(h := rng.randint(2, 3))}>{keep(some(2, 6))}</h{h}>"
        if kind < 0.82:
            items = "".join(f"<li>{keep(one([some(2, 8), sentence()]))}</li>" for _ in range(rng.randint(2, 5)))
            return f"<{(t := one(['ul', 'ol']))}>{items}</{t}>"
        if kind < 0.87:
            return f"<blockquote>{keep(paragraph(1, 3))}</blockquote>"
        if kind < 0.9:
            return "<table>" + "".join(f"<tr><td>{keep(some(1, 5))}</td><td>{keep(some(1, 5))}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.95:
            return one([advert, form, notice])()
        return f"<div>{keep(paragraph(1, 4))}</div>"

    title = some(2, 9)
    lead = f"<h1>{keep(title)}</h1>" if maybe(0.85) else ""
    if maybe(0.3):
        lead += f"<p><b>{keep(sentence())}<br>"
    inner = lead + "".join(block() for _ in range(one([0, 1, 1, 2, 4, 8, 14])))
    if not truth:
        inner += f"<p>{keep(paragraph(1, 2))}</p>"
    if maybe(0.2):
        inner += one([advert, form, comments, sidebar, lambda: named("div", ["share", "social", "tags", "related"], menu())])()
    shell = rng.random()
    if shell < 0.45:
        inner = f"<article>{inner}</article>"
    elif shell < 0.55:
        inner = f"<main>{inner}</main>"
    elif shell < 0.62:
        inner = f"<main><article>{inner}</article></main>"
    elif shell < 0.9:
        inner = named(one(["div", "section"]), ["content", "post", "entry-content", "article-body", "main", "story", "post-body", "main-content"], inner)
    else:
        inner = f"<div>{inner}</div>"
    if maybe(0.25):
        inner += one([comments, sidebar, form])()
        if maybe(0.4):
            inner = one(["<div>{}</div>", '<div id="page">{}</div>', '<div class="container">{}</div>', '<div class="wrapper">{}</div>']).format(inner)
    before = "".join(x() for x in (header, nav, advert, notice, sidebar, form) if maybe(0.4))
    after = "".join(x() for x in (advert, comments, sidebar, notice, form, footer) if maybe(0.35)) + (footer() if maybe(0.4) else "")
    head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>"
    return head + before + inner + after + one(["</body></html>", ""]), truth


@functools.cache
def trained(pages: int = 700, seed: int = 9) -> BoostedTrees:
    """Trees trained on composed pages; an element is main if most of the text below it is."""
    rng, xs, ys, ws = random.Random(seed), [], [], []
    for _ in range(pages):
        page, truth = compose_page(rng)
        tree = Tree(page)
        good, text = np.zeros(len(tree.tag)), np.zeros(len(tree.tag))
        spans = _truth_sizes(tree, truth)
        for node, size, kept in spans:
            text[node] += size
            good[node] += size * kept
        own = text.copy()
        for k in range(len(tree.tag) - 1, 0, -1):
            text[tree.parent[k]] += text[k]
            good[tree.parent[k]] += good[k]
        have = np.flatnonzero(text > 0)
        xs.append(features(tree)[have])
        ys.append(good[have] / text[have] > 0.5)
        ws.append(0.3 + np.minimum(1.5, own[have] / 40))
    return BoostedTrees(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def _truth_sizes(tree: Tree, truth: list[str]) -> list[tuple[int, int, bool]]:
    """Element, size and whether it is main, for each piece of text: the truth's texts follow in page order."""
    out, at, rest = [], 0, truth[0] if truth else ""
    for node, value, _ in tree.texts:
        piece = " ".join(value.split())
        if not piece:
            continue
        kept = at < len(truth) and rest.startswith(piece)
        if kept:
            rest = rest[len(piece) :].strip()
            if not rest:
                at += 1
                rest = truth[at] if at < len(truth) else ""
        out.append((node, len(piece), kept))
    return out


def extract_batch(pages: list[str], model: BoostedTrees) -> list[str]:
    trees = [Tree(p) for p in pages]
    rows = [features(t) for t in trees]
    if not rows:
        return []
    logits = model.logits(np.concatenate(rows))
    cuts = np.cumsum([0, *(len(r) for r in rows)])
    return [main_text(t, decode(t, logits[a:b])) for t, a, b in zip(trees, cuts[:-1], cuts[1:], strict=True)]


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text and n_chars (code points).

    Null and empty pages, and pages without main content, have an empty text; broken markup is read
    as browsers do; repeated rows are read each; an empty table stays empty.
    """
    source = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), text_or_empty(html_col).alias("_html"))
    shared = df.sparkSession.sparkContext.broadcast(trained())
    types = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pages, texts = batch.column("_html").to_pylist(), []
            for lo in range(0, len(pages), 256):
                texts += extract_batch(pages[lo : lo + 256], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["_id", "_url", "text", "n_chars"],
            )

    done = source.mapInArrow(run, f"_id {types['_id']}, _url {types['_url']}, text string, n_chars long")
    return done.withColumnsRenamed({"_id": id_col, "_url": url_col})
