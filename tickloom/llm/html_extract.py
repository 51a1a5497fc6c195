"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, each with the chain of elements around it. A classifier gives each block a cost
of being called boilerplate and a cost of being called content; these are the capacities to the two
terminals. Neighbours in page order and siblings in the DOM are tied by smoothness edges. A
maximum flow finds the labelling of least total cost, and the blocks on the content side are the text.

The classifier adds up two kinds of log odds. What elements say of themselves (tags, roles, class words) is a fixed
table. What a block's own text says is a logistic regression, fitted on blocks whose elements leave no doubt, with
the fixed weights PRIOR as the mean of its prior; a single page is read with PRIOR alone.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements whose content is never text of the page, and that end with their own tag only.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "canvas", "math"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag ends open elements of these kinds, up to the nearest one on the right-hand side.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCK - {"button", "label", "option", "head", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: Elements nested deeper than this count to the one around them, as in browsers; it bounds the work for a tag.
DEEP = 512
#: Evidence of an element for content (positive) or boilerplate (negative), for the blocks inside it.
_TAG = {"nav": -6.0, "footer": -5.0, "aside": -5.0, "form": -5.0, "button": -5.0, "menu": -5.0, "dialog": -5.0, "search": -5.0, "header": -3.0, "label": -3.0, "article": 3.0, "main": 2.5, "figcaption": -0.5}
_ROLE = {"navigation": -6.0, "banner": -4.0, "contentinfo": -5.0, "complementary": -5.0, "search": -5.0, "form": -5.0, "dialog": -5.0, "alert": -5.0, "alertdialog": -5.0, "menu": -5.0, "main": 2.5, "article": 3.0}
HIDDEN, BAD, GOOD, BODY = -8.0, -5.0, 1.5, 2.5
#: Words that tell in a class or id: alone, or as the first or last part of a name such as site-footer or adSlot.
_COMMENTS = {"comment", "comments", "respond", "reply", "replies", "disqus", "discussion", "reactions"}
_WORDS = _COMMENTS | {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "adslot", "banner", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb",
    "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar", "sidebar", "aside", "widget", "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal",
    "overlay", "paywall", "subscribe", "subscription", "newsletter", "signup", "login", "search", "form", "share", "sharing", "social", "related", "recommended", "recommendations", "outbrain", "taboola",
    "pagination", "pager", "copyright", "hidden",
}
_FINE = {"article", "articlebody", "content", "main", "post", "entry", "story", "text", "body", "prose"}
#: Words that go with those in names of page parts (site-footer, related-posts). A name that has any other word may be the slug of a heading.
_PLACES = {
    "site", "page", "main", "left", "right", "top", "bottom", "inner", "outer", "wrap", "wrapper", "container", "box", "block", "bar", "area", "section", "list", "item", "items", "group", "row", "col",
    "column", "panel", "slot", "unit", "holder", "module", "region", "buttons", "button", "links", "link", "icons", "icon", "posts", "articles", "stories", "news", "content", "title", "header", "head", "body", "thread",
    "primary", "secondary", "global", "mobile", "desktop", "sticky", "fixed", "media", "text", "user", "users", "view", "form", "field", "input", "count", "meta", "author", "policy", "message", "dialog", "google", "gpt", "dfp", "id", "js",
}
#: Names that start with one of these tell of a state (has-sidebar, no-ads, with-comments), not of what is inside.
_STATE = {"has", "no", "not", "with", "without", "is", "non", "show", "hide", "js"}
#: Smoothness: between neighbours in page order, more for the same parent, less the further apart in the DOM.
NEAR, SIBLING, FAR = 1.0, 1.5, 0.25
#: The prior mean of the text weights: one, 8 words or more, 25 or more, ends a sentence, share in links, paragraph, heading, list item, cell.
PRIOR = np.array([-0.6, 0.8, 0.6, 0.4, -3.0, 0.0, 0.0, 0.0, 0.0])
#: Pages that the classifier is fitted on, at most, and blocks of each; how many blocks the prior weighs.
PAGES, PAGE_BLOCKS, WEIGHT = 2000, 200, 50.0


def _named(value: str, is_id: bool) -> tuple[float, bool, bool]:
    """Evidence of a class or id, whether it speaks of readers' comments, and whether it may be a heading's slug.

    Names count as a whole, not what they contain. A slug is an id, or a name of three or more words, that has a word which isn't one of page parts.
    """
    e, comments, slug = 0.0, False, True
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts or parts[0] in _STATE:
            continue
        ends = {parts[0], parts[-1], "".join(parts)}
        if ends & _WORDS and not (parts[-1] == "header" and parts[0] in _FINE):  # entry-header holds the headline
            may = (is_id and len(parts) > 1 or len(parts) > 2) and not all(p in _PLACES or p in _WORDS or p in _FINE or len(p) == 1 for p in parts)
            e, comments, slug = BAD, comments or not may and bool(ends & _COMMENTS), slug and may
        elif e == 0.0 and ends & _FINE:
            e = GOOD
    return e, comments, e < 0 and slug


def _evidence(tag: str, attrs: str, in_article: bool) -> tuple[float, float, bool, bool]:
    """(of tags and roles, of names, whether it holds comments, whether what speaks against it may be a slug) for one element."""
    hard, soft, comments, slug = _TAG.get(tag, 0.0), 0.0, False, True
    if tag == "header" and in_article:
        hard = 0.0  # the head of the article holds its headline
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("html", "body"):
            e, c, may = _named(value, name == "id")
            soft, comments, slug = e if soft == 0 or e < 0 else soft, comments or c, slug and (may or e >= 0)
        elif name == "role":
            hard += _ROLE.get(value.lower(), 0.0)
        elif name == "itemprop":
            hard += BODY if value.lower() == "articlebody" else 0.0
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDES.search(value):
            hard += HIDDEN
    return hard, soft, comments, soft < 0 and slug


class Page:
    """Blocks of a page and the elements around them; element 0 is the page.

    texts, linked (share of characters in links), at (the innermost element) and tag of each block; parent, hard, soft,
    comments and slug of each element. The work is linear in the page's length.
    """

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.linked: list[float] = []
        self.at: list[int] = []
        self.tag: list[str] = []
        self.parent, self.hard, self.soft, self.comments, self.slug = [-1], [0.0], [0.0], [False], [False]
        stack: list[tuple[str, int]] = [("", 0)]
        count: dict[str, int] = {}  # open elements on the stack by tag
        beyond: dict[str, int] = {}  # and those too deep for it
        words: list[str] = []
        state = {"linked": 0, "link": 0, "at": 0, "tag": "", "begun": False}  # link: depth of the open link, 0 for none

        def flush() -> None:
            if state["begun"]:
                text = _SPACE.sub(" ", "".join(words)).strip()
                if text:
                    self.texts.append(text)
                    self.linked.append(min(1.0, state["linked"] / len(text)))
                    self.at.append(state["at"])
                    self.tag.append(state["tag"])
            words.clear()
            state["linked"], state["begun"] = 0, False

        def text(raw: str) -> None:
            if not raw:
                return
            if "&" in raw:
                raw = _html.unescape(raw)
            n = len(raw.strip())
            if n and not state["begun"]:
                state["begun"], state["at"] = True, stack[-1][1]
                state["tag"] = next((t for t, _ in reversed(stack) if t in _BLOCK), "")
            if n and state["link"]:
                state["linked"] += n
            words.append(raw)

        def pop(to: int) -> None:
            for t, _ in stack[to:]:
                count[t] -= 1
            del stack[to:]
            if state["link"] > len(stack):
                state["link"] = 0

        pos, end = 0, len(page)
        endless: set[str] = set()  # raw elements that have no end tag from here on
        while pos < end:
            m = _TOKEN.search(page, pos)
            if m is None:
                text(page[pos:])
                break
            text(page[pos : m.start()])
            pos = m.end()
            if m[2] is None:
                continue
            tag, attrs = m[2].lower(), m[3]
            if m[1]:
                if tag in _BLOCK or tag == "br":
                    flush()
                if tag == "a":
                    state["link"] = 0
                if beyond.get(tag):
                    beyond[tag] -= 1
                elif count.get(tag):
                    i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                    if tag in _BLOCK:
                        pop(i)
                    elif not any(t in _BLOCK for t, _ in stack[i + 1 :]):
                        pop(i)
                    else:  # an end tag of an inline element doesn't end blocks that were opened inside it
                        count[tag] -= 1
                        del stack[i]
                continue
            if tag in _RAW:
                if not attrs.rstrip().endswith("/") or tag not in ("svg", "math", "iframe"):
                    close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                    if close is None and tag in ("noscript", "select", "svg", "math", "object", "canvas"):
                        endless.add(tag)
                        continue
                    pos = close.end() if close else end
                continue
            if tag == "br":
                words.append(" ")
                continue
            block = tag in _BLOCK
            if block:
                flush()
            if tag in _VOID:
                continue
            if tag in _ENDS_P and count.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in _BLOCK:
                        break
            if tag in _CLOSES:
                ends, until = _CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in until:
                        break
                    if stack[i][0] in ends:
                        pop(i)
            hard, soft, comments, slug = _evidence(tag, attrs, bool(count.get("article")))
            if block or hard or soft:  # other inline elements leave no trace
                if len(stack) > DEEP:
                    beyond[tag] = beyond.get(tag, 0) + 1
                else:
                    self.parent.append(stack[-1][1])
                    self.hard.append(hard)
                    self.soft.append(soft)
                    self.comments.append(comments)
                    self.slug.append(slug)
                    stack.append((tag, len(self.parent) - 1))
                    count[tag] = count.get(tag, 0) + 1
            if tag == "a":
                state["link"] = len(stack)
        flush()

    def evidence(self) -> tuple[list[float], list[float]]:
        """Evidence for each block: of all elements around it, and whether it lies in the article.

        Negative tags undo what positive ones around them say, and a bad name holds for all that is inside. Two things
        release a wrapper: the article that has most of the text drops what its ancestors say, unless one of them is
        a sidebar, a menu, a footer or the comments; and a bad name or a form around nine tenths of the
        text of a page without article says nothing. Inside the article a slug speaks against what it names only where the text there
        agrees: half of it links, or no heading and no block of eight words.
        """
        n = len(self.parent)
        size, whole = [0.0] * n, [0.0] * n  # characters outside of links, and all
        prose = [False] * n
        for t, l, e, tag in zip(self.texts, self.linked, self.at, self.tag, strict=True):
            size[e] += len(t) * (1 - l)
            whole[e] += len(t)
            prose[e] |= t.count(" ") >= 7 or tag[:1] == "h" and tag[1:].isdigit()
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            whole[self.parent[e]] += whole[e]
            prose[self.parent[e]] |= prose[e]
        barred, inside = [False] * n, [False] * n
        best = 0
        for e in range(1, n):
            barred[e] = barred[self.parent[e]] or self.comments[e] or self.hard[e] <= -5.0 and self.hard[e] != _TAG["form"]
            if self.hard[e] >= BODY and not barred[e] and self.soft[e] >= 0 and size[e] > size[best] * (best > 0):
                best = e
        up = set()
        e = best
        while e > 0:
            e = self.parent[e]
            up.add(e)
        total = [0.0] * n
        hard, soft = [0.0] * n, [0.0] * n
        for e in range(1, n):
            p, h, s = self.parent[e], self.hard[e], self.soft[e]
            if best and e in up or not best and size[0] > 0 and size[e] >= 0.9 * size[0] and not barred[e] and (s < 0 or h == _TAG["form"]):
                h, s = max(h, 0.0), max(s, 0.0)
            if inside[p] and self.slug[e] and prose[e] and 2 * size[e] > whole[e]:
                s = 0.0
            inside[e] = inside[p] or e == best
            hard[e] = min(hard[p], 0.0) + h if h < 0 else hard[p] if hard[p] < 0 else max(hard[p], h)
            soft[e] = s if s < 0 else soft[p] if soft[p] < 0 else max(s, soft[p])
            total[e] = max(-8.0, min(4.5, hard[e] + soft[e]))
        return [total[e] for e in self.at], [float(best > 0) * (1 if inside[e] else -1) for e in self.at]

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness: between neighbours, weaker with their distance in the DOM, and from a block to the last one under the same parent."""
        depth = [0] * len(self.parent)
        for e in range(1, len(self.parent)):
            depth[e] = depth[self.parent[e]] + 1
        out, last = [], {}
        for i, e in enumerate(self.at):
            parent = self.parent[e]
            if i:
                a, b, apart = self.at[i - 1], e, 0
                while a != b:  # over all blocks no more steps than there are elements, and DEEP for one
                    if depth[a] >= depth[b]:
                        a = self.parent[a]
                    else:
                        b = self.parent[b]
                    apart += 1
                out.append((i - 1, i, NEAR * (SIBLING if apart <= 2 else 1.0) / (1 + 0.5 * max(0, apart - 2))))
                if last.get(parent, i) < i - 1:
                    out.append((last[parent], i, FAR))
            last[parent] = i
        return out

    def features(self) -> np.ndarray:
        """A row for each block, see PRIOR."""
        rows = []
        for t, l, tag in zip(self.texts, self.linked, self.tag, strict=True):
            n = t.count(" ") + 1
            rows.append((1, n >= 8, n >= 25, t[-1] in ".!?…\"'”»。", l, tag == "p", tag[:1] == "h" and tag[1:].isdigit(), tag in ("li", "dd", "dt"), tag in ("td", "th")))
        return np.array(rows, float).reshape(-1, len(PRIOR))


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut. Maximum flow by Dinic's method, iterative."""
    n = len(source)
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def link(a: int, b: int, c: float, back: float):
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if source[i] > 0:
            link(n, i, source[i], 0.0)
        if sink[i] > 0:
            link(i, n + 1, sink[i], 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[n], queue = 0, deque([n])
        while queue:
            a = queue.popleft()
            for e in adj[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt, path = [0] * (n + 2), []
        at = n
        while True:
            if at == n + 1:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[at] < len(adj[at]):
                e = adj[at][nxt[at]]
                if cap[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                nxt[at] += 1
            else:
                if not path:
                    break
                e = path.pop()
                at = to[e ^ 1]
                nxt[at] += 1
                continue
            path.append(e)
            at = to[e]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The article of a page, its blocks in page order joined by a space; empty for a null or empty page.

    A page on which no element speaks of boilerplate is taken whole. Where the cut leaves nothing, what no element speaks
    against is taken, unless it is mostly links.
    """
    x = Page(page or "")
    if not x.texts:
        return ""
    evidence, inside = x.evidence()
    if min(evidence) >= 0 and max(x.linked) < 0.5:
        return " ".join(x.texts)
    # where the page marks its article, what lies outside of it has to make its own case
    scores = [e + s - (1.5 if i < 0 and e < 1.0 else 0.0) for e, s, i in zip(evidence, x.features() @ weights, inside, strict=True)]
    keep = min_cut([max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores], x.edges())
    if not any(keep):
        keep = [e >= 0 and l < 0.5 for e, l in zip(evidence, x.linked, strict=True)]
    return " ".join(t for t, k in zip(x.texts, keep, strict=True) if k)


def fit(x: np.ndarray, y: np.ndarray, weight: float = WEIGHT, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a normal prior around PRIOR; both classes count alike. Newton's method."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    each = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + weight * (w - PRIOR)
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + weight * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(pages: DataFrame, most: int = PAGES) -> np.ndarray:
    """Text weights from at most `most` pages: blocks in the article are content, those that elements speak against are not.

    Pages are chosen by a hash of url and page_id, equal ones once. Without such blocks of both kinds the weights are PRIOR.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for html in batch.column(0):
                page = Page(html.as_py() or "")
                evidence, inside = page.evidence()
                y = np.array([1 if i > 0 and e >= BODY else 0 if e <= -3 else -1 for e, i in zip(evidence, inside, strict=True)], np.int8)[:PAGE_BLOCKS]
                xs.append(page.features()[:PAGE_BLOCKS].astype(np.float32)[y >= 0].tobytes())
                ys.append(y[y >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    x = pages.select("html", F.xxhash64("url", "page_id").alias("h"), F.xxhash64("html").alias("g"))
    some = x.join(F.broadcast(x.select("h", "g").distinct().orderBy("h", "g").limit(most)), ["h", "g"]).dropDuplicates(["h", "g"])
    got = sorted((bytes(r["y"]), bytes(r["x"])) for r in some.select("html").mapInArrow(rows, "x binary, y binary").collect())
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, len(PRIOR)) for _, b in got] or [np.zeros((0, len(PRIOR)))]).astype(float)
    return fit(x, np.concatenate([np.frombuffer(a, np.int8) for a, _ in got] or [np.zeros(0)]).astype(float))


def extract(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages (page_id, url, html).

    Other columns are ignored. A null or empty html has the empty text, and so has a page that is all boilerplate;
    null ids and urls stay null, repeated rows stay, and an empty table gives an empty result. The classifier is fitted on
    at most `most` pages; all pages are then read row by row, without a shuffle; memory follows the longest page.
    """
    weights = train(pages, most)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [main_text(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
