"""HTML main text: maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Each carries a weight learned from labelled pages
(pages that mark their content with <article> or <main>): a logistic regression of lying
inside the content, drawn to default weights.  A word is seen by its nearest containers and its neighbour tags, and
by the names (element, class, id, role) of all containers around it; a tag by these and its
name.  The marks themselves are no feature, so marked and unmarked pages are read alike, but
that the names of containers around a mark are not held against the text.  A linear scan
finds the contiguous region with the largest sum; its text, without words that the containers
around them make unlikely (adverts, forms, comments, ...), is the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import rows

# Element names of HTML.
RAW_TEXT = frozenset("script style noscript template svg textarea iframe object canvas audio video select title noembed noframes xmp".split())
#: Of these, the ones whose text is no markup: without an end tag they last to the end of the page.
UNPARSED = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article aside body details dialog div footer form header main menu nav ol search section table ul fieldset blockquote figure button label li p".split())
MARKS = ("main", "article")
_MARK_TAGS = frozenset(("main", "/main", "article", "/article"))
_NOWHERE = ("none", "none")
BOILER = frozenset("nav aside footer form menu dialog button label fieldset search header".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong br blockquote pre span q cite code sub sup ul ol li dl dt dd table thead tbody tr td th a".split())
# Names in class, id and role (whole ones) of parts of a page other than its text.
PART_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notification alert popup modal "
                       "overlay gdpr newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar menu nav navbar navigation "
                       "breadcrumb breadcrumbs footer header masthead comment comments discussion disqus replies respond widget toolbar pagination pager skip search "
                       "complementary contentinfo search-form tags ad-container ad-slot ad-wrapper cookie-notice cookie-banner cookie-bar cookie-consent share-buttons social-share "
                       "social-links related-posts related-articles comment-list comments-area main-nav main-menu nav-bar site-header site-footer site-nav page-header page-footer "
                       "newsletter-signup newsletter-form login-form side-bar skip-link".split())

# a tag's name is followed by a blank, a slash or its end, and no < stands in it outside quotes: else the < is text
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?=[\s/>])(?:[^"'<>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)((?=[\s/>])[^<>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
TAG_COST = 0.1
TEXT_WEIGHT = 0.5           # of a word that nothing speaks for or against
PULL = 10.0                 # towards a feature's default
PULL_NAMES = 1.0            # ... of a name that has none
FULL = 100.0
STEPS = 300
HIDDEN_LIFT = 4.0


class Box:
    """An open container: what it is called, and what it stands in."""

    __slots__ = ("name", "own", "up", "marks", "near", "lift")

    def __init__(self, name: str, own: tuple[str, ...], up: Box | None):
        self.name, self.own, self.up, self.lift = name, own, up, 0.0
        self.marks, self.near = (up.marks, up.near) if up else ((), _NOWHERE)
        if name not in MARKS:
            self.near = (name, self.near[0])
        elif name not in self.marks:
            self.marks += (name,)


def _own(name: str, attrs: str) -> tuple[str, ...]:
    """Features that a container gives to all words in it."""
    out = {f"e:{name}"} if name in BOILER else set()
    if attrs and name not in ("html", "body", *MARKS):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                out.update(f"c:{x}" for x in value.lower().split())
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
                out.add("h:hidden")
    return tuple(sorted(out))


def tokens(page: str) -> tuple[list[tuple[str, str, Box | None]], list[Box]]:
    """[("tag", name, box) or ("text", raw text, box)] and all boxes, outer before inner; raw-text elements and comments are left out."""
    out: list[tuple[str, str, Box | None]] = []
    stack: list[Box] = []
    boxes: list[Box] = []
    opened = Counter()
    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            out.append(("text", page[at:m.start()], stack[-1] if stack else None))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        close, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if not close and name in RAW_TEXT and not attrs.endswith("/"):
            end = _end_tag(name).search(page, at)  # whatever stands before it is no markup of this page
            if end is not None or name in UNPARSED:
                at = end.end() if end is not None else len(page)
        elif close:
            if opened[name]:
                while True:
                    last = stack.pop().name
                    opened[last] -= 1
                    if last == name:
                        break
        elif name in CONTAINERS:
            while stack and (stack[-1].name == "p" or (name == "li" and stack[-1].name == "li")):
                opened[stack.pop().name] -= 1
            box = Box(name, _own(name, attrs), stack[-1] if stack else None)
            opened[name] += 1
            stack.append(box)
            boxes.append(box)
        out.append(("tag", ("/" if close else "") + name, stack[-1] if stack else None))
    if at < len(page):
        out.append(("text", page[at:], stack[-1] if stack else None))
    return out, boxes


@lru_cache(maxsize=len(RAW_TEXT))
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


def content_mark(boxes: list[Box]) -> str | None:
    """The element that marks content: main, else article, else none."""
    names = {b.name for b in boxes}
    return next((m for m in MARKS if m in names), None)


def _holders(boxes: list[Box], mark: str | None) -> set[Box]:
    """The boxes around all content marks: whatever they are called, they are no part beside the text."""
    common: list[Box] | None = None
    for box in boxes:
        if mark and box.name == mark:
            around: list[Box] = []
            while (box := box.up) is not None:
                around.append(box)
            common = around[::-1] if common is None else [a for a, b in zip(common, reversed(around)) if a is b]
    return set(common or ())


def _clean(raw: str) -> str:
    return _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw)


@lru_cache(65_536)
def _place(inner: str, far: str, before: str, follows: str, tag: str) -> tuple[str, ...]:
    out = (f"u:{inner}", f"p:{inner}<{far}", f"b:{before}", f"a:{follows}")
    return (*out, f"t:{tag}") if tag else out


def _read(seq, clean: bool = True):
    """(kind, value, words, features of its place, box) of each token, without the marks; spaces have no words."""
    after, following = [""] * len(seq), ""
    for i in range(len(seq) - 1, -1, -1):
        after[i] = following
        if seq[i][0] == "tag" and seq[i][1] not in _MARK_TAGS:
            following = seq[i][1]
    before = ""
    for (kind, value, box), follows in zip(seq, after):
        if kind == "text":
            if clean:
                value = _clean(value)
            n = len(value.split())
            yield kind, value, n, _place(*(box.near if box else _NOWHERE), before, follows, "") if n else (), box
        elif value in _MARK_TAGS:
            yield kind, value, 0, (), box
        else:
            yield kind, value, 0, _place(*(box.near if box else _NOWHERE), before, follows, value), box
            before = value


#: A task sends its counts on when it holds so many places.
_FLUSH = 50_000
#: Names further out than so many containers teach nothing.
NEAREST = 64


def _weigh(batches):
    """(place, inside, outside): words and tags of the labelled pages of a task by the features they are seen by."""
    inside, outside = Counter(), Counter()

    def flush():
        places = sorted(set(inside) | set(outside))
        out = pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.string())), pa.array([inside[p] for p in places], pa.int64()),
                                          pa.array([outside[p] for p in places], pa.int64())], names=["place", "inside", "outside"])
        inside.clear()
        outside.clear()
        return out

    for batch in batches:
        for (page,) in rows(batch, "html"):
            seq, boxes = tokens(page)
            mark = content_mark(boxes)
            if mark is None:
                continue
            names: dict[Box | None, tuple[str, ...]] = {None: ()}
            for kind, _, n, features, box in _read(seq, clean=False):
                if not features:
                    continue
                if box not in names:
                    own, up = [], box
                    while up is not None and len(own) < NEAREST:
                        own += up.own
                        up = up.up
                    names[box] = tuple(sorted(own))
                (inside if box is not None and mark in box.marks else outside)[features + names[box]] += n or 1
            if len(inside) + len(outside) > _FLUSH:
                yield flush()
    yield flush()


#: Places beyond this many (names in hostile pages) teach nothing.
MAX_PLACES = 65_536


def default_lift(feature: str) -> float:
    """Log-odds of a feature before labelled pages are read."""
    kind, name = feature[:1], feature[2:]
    if kind == "t":
        return 0.0 if name.lstrip("/") in TEXT_TAGS else -1.0
    if kind == "h":
        return -HIDDEN_LIFT
    if kind == "e" or kind == "c" and name in PART_NAMES:
        return -3.0
    return -3.0 if feature in ("b:a", "a:/a") else 0.0


def fit(places: list[tuple[list[str], int, int]]) -> dict[str, float]:
    """Logistic regression of inside on the features, drawn to their defaults: what the defaults or other features explain moves no weight.

    A place counts as at most FULL words or tags.  Steps by the largest curvature never overshoot.
    """
    names = sorted({f for p, _, _ in places for f in p})
    number = {f: i for i, f in enumerate(names)}
    default = np.array([default_lift(f) for f in names])
    pull = np.array([PULL_NAMES if f[0] == "c" and d == 0 else PULL for f, d in zip(names, default)])
    near = [sum(f[0] in "upbat" for f in p) for p, _, _ in places]
    row = np.repeat(np.arange(len(places)), [len(p) for p, _, _ in places])
    col = np.array([number[f] for p, _, _ in places for f in p], dtype=np.int64)
    x = np.array([1 / k if f[0] in "upbat" else 1.0 for (p, _, _), k in zip(places, near) for f in p])
    n = np.array([i + o for _, i, o in places], dtype=float)
    n, share = n * FULL / (FULL + n), np.array([i / (i + o) for _, i, o in places])
    width = np.bincount(row, x, len(places))
    curve = np.bincount(col, x * (n * width)[row], len(names)) / 4 + pull
    w = default.copy()
    for _ in range(STEPS if names else 0):
        odds = TEXT_WEIGHT + np.bincount(row, x * w[col], len(places))
        wrong = n * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - share)
        w -= (np.bincount(col, x * wrong[row], len(names)) + pull * (w - default)) / curve
    return dict(zip(names, w.tolist()))


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Feature -> weight from the labelled pages (their MAX_PLACES commonest places)."""
    counts = (pages.select(F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
              .mapInArrow(_weigh, "place array<string>, inside long, outside long").groupBy("place")
              .agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy(F.desc(F.col("i") + F.col("o")), "place").limit(MAX_PLACES).collect())
    return fit([(r["place"], r["i"], r["o"]) for r in counts])


def _weight(weights: dict[str, float], feature: str) -> float:
    w = weights.get(feature)
    return default_lift(feature) if w is None else w


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, white space folded, joined by an empty line."""
    seq, boxes = tokens(page)
    holders = _holders(boxes, content_mark(boxes))
    for box in boxes:
        box.lift = (box.up.lift if box.up else 0.0) + (0.0 if box in holders else sum(_weight(weights, f) for f in box.own))
    best, run, start, span = 0.0, 0.0, 0, (0, 0)
    read, known = [], {}
    for i, (kind, value, n, features, box) in enumerate(_read(seq)):
        s = 0.0
        if features:
            place = known.get(features)
            if place is None:
                place = known[features] = sum(_weight(weights, f) for f in features) / len(features)
            if n:  # within [-1, 1] for a word
                around = box.lift if box else 0.0
                s = max(-1.0, min(1.0, TEXT_WEIGHT + place + around)) * n
                if s < 0 and around < 0:  # is dropped wherever it stands, so it hardly parts a region
                    kind, s = "part", -0.05 * n
            elif box and box.lift < 0 and TEXT_WEIGHT + place + box.lift < 0:
                s = -0.05
            else:
                s = max(-0.75, min(0.0, TEXT_WEIGHT + place)) - TAG_COST
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, span = run, (start, i + 1)
        read.append((kind, value))
    blocks, part = [], []
    for kind, value in read[span[0]:span[1]]:
        if kind == "text":
            part.append(value)
        elif kind == "tag":
            if value == "br":
                part.append(" ")
            elif value.lstrip("/") in BLOCKS:
                blocks.append("".join(part))
                part = []
    blocks.append("".join(part))
    return "\n\n".join(b for b in (_SPACE.sub(" ", x).strip() for x in blocks) if b)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, url, text), one row for each page; text is empty where a page has none.

    Null and empty html give an empty text; ids and urls may be null or repeat; other
    columns are ignored; an empty table gives no rows.  Pages of any length are read whole,
    in linear time.  Without labelled pages the default weights hold.
    """
    weights = pages.sparkSession.sparkContext.broadcast(learn_weights(pages, html_col) if weights is None else weights)
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))

    def run(batches):
        for batch in batches:
            text = [main_text(page, weights.value) for (page,) in rows(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["id", "url", "text"])

    out = base.mapInArrow(run, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
