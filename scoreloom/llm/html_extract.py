"""Operator 4, main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier gives each block a cost of being called content and one of being
called boilerplate: they become the capacities of its edges from the source and to the sink. Neighbouring blocks and
blocks near each other in the document tree are joined by smoothness edges. The minimum cut, found by maximum flow,
is the labelling of least total cost; blocks on the source's side are the main text.

The classifier is a logistic model over what a block is like (length, links, signs, capitals, heading, list) and what
the class words and the headings above it say, as one bounded feature among others. Its weights are fitted on a
bounded sample of pages: where they have an article or main element, the blocks inside are content and those outside
boilerplate; the others' blocks are labelled by the cut that these weights give, and fitted once more with them.
Elements that mean content or boilerplate by themselves add a fixed amount.

A name, role or form that speaks against all it holds is believed only where the page has other text that may be its
main text: a wrapper around the article isn't boilerplate, whatever it is called."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, text_or_empty

#: Most pages that the block model is fitted on: those of the smallest hash of their html.
MAX_FIT = 500
SCALE = 1000  # capacities are whole numbers of thousandths
#: What an element that means content adds, one that means boilerplate unless an article lies in it, one that does
#: whatever lies in it, and a name that does; and the most that the fitted model says either way about anything but
#: class words.
GOOD, BAD, NEVER, LOUD, MOST = 4.0, -4.0, -6.0, -2.0, 3.0
#: A name is believed against an article of these words or more only if as many words, or this share of what it holds,
#: lie elsewhere on the page.
ARTICLE, ELSEWHERE, SHARE = 25, 12, 0.125
#: Smoothness between neighbouring blocks of one parent; what each step apart in the tree divides it by; and how fast it
#: fades where class words speak of one block and not of the other.
SMOOTH, FADE = 1.5, 1.0

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT_TAGS = frozenset("script style noscript template title textarea select button iframe object svg canvas audio video head".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
GOOD_TAGS = frozenset(("article", "main"))
NEVER_TAGS = frozenset("nav footer aside menu dialog".split())
#: Of them, those that no article lies in, however long.
MENU_TAGS = frozenset("nav menu dialog".split())
NEVER_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert status tooltip menu menubar banner".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Class words that speak against a block wherever they stand in a name, those that do as the whole name or its end, and
#: those that speak for it.
LOUD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments disqus".split())
BAD_WORDS = frozenset(
    "promo promotion banner notice notices alert newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar "
    "widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead respond reply replies pagination pager popup modal overlay login "
    "search toolbar copyright form".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text prose".split())
#: A name that begins so says what the page has elsewhere, not what the element is.
ABOUT_OTHERS = frozenset("with has no not without is show hide hides include includes enable enabled".split())
#: A heading that has no words but these, at least one of the first or second sort, and numbers opens a part that is no
#: main text: reader comments (first sort) or other things. What it says of the blocks up to the end of the element
#: around it or the next heading of its level.
COMMENT_WORDS = frozenset("comments comment kommentare kommentar commentaires commentaire comentarios comentario".split())
HEADING_WORDS = frozenset("related advertisement advertisements anzeige anzeigen publicité publicidad sponsored newsletter share subscribe".split())
FILL_WORDS = frozenset(
    "a add all an and article articles by content from latest leave links more most news no on our page post posts read reader readers reading story stories the this to top "
    "topics two us user view write your und zum der die das sur les des los las de".split()
)
AFTER_COMMENTS, AFTER_HEADING = -1.0, -0.6
#: A new block element of these ends an open one of the same row.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("html body article aside main section nav div td th table ul ol dl blockquote form footer header".split())

# Possessive throughout: no position is looked at twice.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+|=)*+)>")
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+)?+")
WORD = re.compile(r"[^\W\d]+")
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
STOPS = re.compile("[.,;:!?]")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    links: int  # characters of the text that lie in links
    node: int  # number of the block element around it, and of the one around that
    parent: int
    depth: int  # block elements around it
    shared: int  # of them, those around the block before as well
    element: float  # what elements say by themselves
    words: float  # what class words and headings say, -1 to 1
    tag: str
    named: int  # as in _Element
    menu: bool  # whether it lies in an element that holds no article


@dataclass(slots=True)
class _Element:
    name: str
    node: int
    parent: int
    depth: int
    silent: bool
    linked: bool
    element: float
    words: float
    tag: str
    scope: dict[str, int]  # elements open since the last scope element, by name
    named: int  # number of the innermost element around it that a name speaks against, -1 if there is none
    menu: bool = False  # in an element that holds no article
    section: tuple[int, float] | None = None  # level of the last heading right in it, and what it says


def class_words(value: str) -> float:
    """What a class, id or role says: from -1 (boilerplate) to 1 (content)."""
    good = bad = 0.0
    for name in value.split():
        parts = [w.lower() for w in PART.findall(name)]
        if not parts or parts[0] in ABOUT_OTHERS:
            continue
        if any(w in LOUD_WORDS for w in parts):
            bad = max(bad, 1.0)
        elif parts[-1] in BAD_WORDS:
            bad = max(bad, 1.0 if len(parts) == 1 else 0.8)
        elif parts[0] in BAD_WORDS:
            bad = max(bad, 0.6 if parts[-1] not in GOOD_WORDS else 0.3)
        elif parts[-1] in GOOD_WORDS:
            good = max(good, 0.6 if len(parts) == 1 else 0.4)
    return good - bad if bad else good


def heading_says(text: str) -> float:
    """What a heading says of the blocks below it."""
    words = WORD.findall(text.lower())
    if not words or len(words) > 6 or not all(w in COMMENT_WORDS or w in HEADING_WORDS or w in FILL_WORDS for w in words):
        return 0.0
    return AFTER_COMMENTS if any(w in COMMENT_WORDS for w in words) else AFTER_HEADING if any(w in HEADING_WORDS for w in words) else 0.0


@dataclass(slots=True)
class _Parser:
    void: frozenset[int] = frozenset()  # numbers of the named elements that aren't believed
    stack: list[_Element] = field(default_factory=lambda: [_Element("", 0, 0, 0, False, False, 0.0, 0.0, "", {}, -1)])
    around: list[int] = field(default_factory=list)  # for each element that a name speaks against, the next one around it
    opened: dict[str, int] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    count: int = 0
    low: int = 0  # fewest block elements open since the last block
    at: _Element | None = None  # where the block being read began

    def say(self, text: str) -> None:
        top = self.stack[-1]
        if text and not top.silent:
            if not self.parts:
                self.at = top
            if "&" in text:
                text = html.unescape(text)
            self.parts.append(text)
            if top.linked:
                self.links += len(" ".join(text.split()))

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        e = self.at
        if text:
            said, element = (min(e.words, e.section[1]) if e.section else e.words), e.element
            if e.section and e.section[1] <= AFTER_COMMENTS:
                element = min(element, LOUD)
            if e.tag in HEADINGS:
                holder = next((x for x in reversed(self.stack) if x.tag not in HEADINGS), self.stack[0])
                level = int(e.tag[1])
                if says := heading_says(text):
                    holder.section = (level, says)
                    said = min(said, says)
                    element = min(element, LOUD) if says <= AFTER_COMMENTS else element
                elif holder.section and level <= holder.section[0]:
                    holder.section = None
            self.blocks.append(Block(text, min(self.links, len(text)), e.node, e.parent, e.depth, min(self.low, e.depth), element, said, e.tag, e.named, e.menu))
            self.low = e.depth
        self.parts, self.links = [], 0

    def _pop_to(self, names: tuple[str, ...]) -> None:
        """Ends elements up to and with the innermost of these names."""
        while len(self.stack) > 1:
            e = self.stack.pop()
            self.opened[e.name] -= 1
            below = self.stack[-1].scope
            if e.name in below:
                below[e.name] -= 1
            self.low = min(self.low, self.stack[-1].depth)
            if e.name in names:
                return

    def open(self, name: str, attributes: str) -> None:
        block = name in BLOCK_TAGS
        if block:
            self.flush()
            scope = self.stack[-1].scope
            if scope.get("p"):  # a paragraph holds no other block
                self._pop_to(("p",))
            ends = ENDS.get(name)
            while ends and any(self.stack[-1].scope.get(x) for x in ends):
                self._pop_to(ends)
        elif name == "br":
            if self.parts:
                self.parts.append(" ")
            return
        if name in VOID_TAGS or attributes.endswith("/") and not block and name != "a":
            return
        up = self.stack[-1]
        node, parent, depth = up.node, up.parent, up.depth
        if block:
            self.count += 1
            node, parent, depth = self.count, up.node, up.depth + 1
        element, words, hidden, against = self._says(name, attributes, up)
        named = up.named
        if against:
            self.around.append(named)
            named = len(self.around) - 1
        if up.section and not (name in HEADINGS and int(name[1]) <= up.section[0]):
            words = min(words, up.section[1])
            if up.section[1] <= AFTER_COMMENTS:
                element = min(element, LOUD)
        up.scope[name] = up.scope.get(name, 0) + 1
        self.opened[name] = self.opened.get(name, 0) + 1
        scope = {} if name in SCOPES else up.scope
        self.stack.append(_Element(name, node, parent, depth, up.silent or hidden or name in SILENT_TAGS, up.linked or name == "a", element, words, name if block else up.tag, scope, named, up.menu or name in MENU_TAGS))

    def _says(self, name: str, attributes: str, up: _Element) -> tuple[float, float, bool, bool]:
        """What an element and its name say of what it holds, whether it is hidden, and whether its name, role or kind
        speaks against what it holds."""
        element, words, said, hidden = up.element, up.words, 0.0, False
        role = ""
        if attributes and name not in ("html", "body"):
            names = []
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
                    hidden = True
                elif key == "role":
                    role = value.strip().lower()
                elif key in ("class", "id"):
                    names.append(value)
            said = class_words(" ".join(names))
        against = said < 0 or role in NEVER_ROLES or name in NEVER_TAGS and name not in MENU_TAGS or name == "form"
        if against and len(self.around) in self.void:
            return element, words, hidden, True
        if name in NEVER_TAGS or role in NEVER_ROLES:
            element = NEVER
        elif name in GOOD_TAGS or role in GOOD_TAGS:
            if element > NEVER and element != LOUD:
                element = LOUD if said <= -1 else GOOD
            if element == GOOD and words > -1:
                words = 0.0
        elif element > NEVER and (name == "form" or name == "header" and element <= 0):
            element = BAD
        if said <= -1 and element <= 0:
            element = min(element, LOUD)  # an article inside, as each comment may be, doesn't change it
        if said < 0 and not (name == "header" and up.element > 0):
            words = min(words, said)
        elif said > 0 and words >= 0:
            words = max(words, said)
        if said < 0 and element > 0 and said <= -1:
            element = 0.0
        return element, words, hidden, against

    def close(self, name: str) -> None:
        if name in BLOCK_TAGS:
            self.flush()
            if not self.opened.get(name):
                return
        elif not self.stack[-1].scope.get(name):
            return  # not open, or open outside of what is being read
        self._pop_to((name,))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order: text with references decoded and single spaces, never empty. Where names
    speak against what must be the article, the page is read once more without them."""
    p = _read(page)
    void = disbelieved(p.blocks, p.around)
    return _read(page, void).blocks if void else p.blocks


def _may_be_article(b: Block) -> int:
    """Words of a block that may be part of an article by what it is like."""
    words = b.text.count(" ") + 1
    return words if not b.menu and words >= 5 and 3 * b.links < len(b.text) and (words >= 12 or STOPS.search(b.text)) else 0


def disbelieved(found: list[Block], around: list[int]) -> frozenset[int]:
    """Which of the elements that names speak against hold the page's article.

    The one that holds most is looked at first. It is believed if enough text that may be the article lies elsewhere,
    under no other such name; else it isn't, and what it holds counts from then on as such text."""
    direct, clean = [0] * len(around), 0
    for b in found:
        if b.named < 0:
            clean += _may_be_article(b)
        else:
            direct[b.named] += _may_be_article(b)
    holds = list(direct)
    for k in range(len(around) - 1, -1, -1):  # an element comes after those around it
        if around[k] >= 0:
            holds[around[k]] += holds[k]
    void: set[int] = set()
    for k in sorted((k for k in range(len(around)) if holds[k] >= ARTICLE), key=lambda k: (-holds[k], k)):
        if around[k] >= 0 and around[k] not in void:
            continue  # lies in one that is believed
        if clean < max(ELSEWHERE, SHARE * holds[k]):
            void.add(k)
            clean += direct[k]
    return frozenset(void)


def _read(page: str, void: frozenset[int] = frozenset()) -> _Parser:
    """One pass from left to right. A tag that isn't closed before the page's end is dropped with what follows it."""
    p, at, n = _Parser(void), 0, len(page)
    while (cut := page.find("<", at)) >= 0:
        after = page[cut + 1 : cut + 2]
        if page.startswith("<!--", cut):
            p.say(page[at:cut])
            end = page.find("-->", cut + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            p.say(page[at:cut])
            end = page.find(">", cut)
            at = n if end < 0 else end + 1
        elif after.isascii() and (after.isalpha() or after == "/" and page[cut + 2 : cut + 3].isascii() and page[cut + 2 : cut + 3].isalpha()):
            p.say(page[at:cut])
            m = TAG.match(page, cut)
            if not m:
                at = n
                break
            at, name = m.end(), m[2].lower()
            if m[1]:
                p.close(name)
                continue
            p.open(name, m[3])
            if name in RAW_TAGS:  # what follows is no markup up to the element's end
                end = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(page, at)
                p.close(name)
                at = end.end() if end else n
        else:
            p.say(page[at : cut + 1])
            at = cut + 1
    p.say(page[at:])
    p.flush()
    return p


#: Weights of described() that the fitted ones lean on; the last is the bias.
LEAN = np.array([0.8, -3.0, 1.0, -1.0, 0.0, -2.0, 0.3, -0.3, 6.0, -1.5])
WORDS_AT = 8


def described(b: Block) -> list[float]:
    """What the model sees of a block."""
    words = b.text.count(" ") + 1
    n = len(b.text)
    return [
        min(log1p(words), 5.0), b.links / n, min(1.0, len(STOPS.findall(b.text)) / words), len(CAPITALS.findall(b.text)) / n,
        min(n / words, 20) / 10, float(any(c in b.text for c in "©|»")), float(b.tag in HEADINGS), float(b.tag == "li"), b.words,
    ]


@dataclass(frozen=True)
class BlockModel:
    """Logistic regression over described(), bias last."""

    weights: np.ndarray

    def scores(self, page: list[Block]) -> np.ndarray:
        """The log odds of content of each block: what it is like, within MOST, and what class words say of it."""
        x = np.array([described(b) for b in page])
        said = self.weights[WORDS_AT] * x[:, WORDS_AT]
        return np.clip(x @ self.weights[:-1] - said + self.weights[-1], -MOST, MOST) + said


NO_MODEL = BlockModel(LEAN)


def costs(page: list[Block], model: BlockModel) -> list[tuple[int, int]]:
    """For each block the cost of calling it boilerplate and of calling it content: its terminal capacities."""
    if not page:
        return []
    z = model.scores(page) + np.array([b.element for b in page])
    whole = lambda x: np.rint(SCALE * np.logaddexp(0, x)).astype(int).tolist()
    return list(zip(whole(z), whole(-z)))


def smoothness(page: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (i, j, capacity): between blocks that follow each other, and between those next to each other among the
    blocks of one parent. Steps apart in the tree lower the capacity, and so do class words that differ."""
    edges, last = [], {}

    def join(i: int, j: int, apart: int) -> None:
        alike = exp(-FADE * abs(page[i].words - page[j].words))
        edges.append((i, j, round(SCALE * SMOOTH * alike / (1 + apart) ** 2)))

    for j, b in enumerate(page):
        if j:
            join(j - 1, j, max(0, page[j - 1].depth + b.depth - 2 * b.shared - 2))
        i = last.get(b.parent)
        if i is not None and i != j - 1:
            join(i, j, 0)
        last[b.parent] = j
    return edges


def minimum_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut (the smallest such side).

    terminals: capacities from the source and to the sink. Flow straight through a node is taken first; what remains
    is pushed along shortest paths from nodes with source capacity left to nodes with sink capacity left."""
    left = [a - min(a, b) for a, b in terminals]
    right = [b - min(a, b) for a, b in terminals]
    to: list[list[int]] = [[] for _ in terminals]  # numbers of edges; edge e and e ^ 1 are each other's reverse
    ends, room = [], []
    for i, j, c in edges:
        to[i].append(len(ends))
        to[j].append(len(ends) + 1)
        ends += (j, i)
        room += (c, c)
    while True:
        # Distances from all nodes with source capacity.
        level = [-1] * len(left)
        queue = deque(i for i, c in enumerate(left) if c)
        for i in queue:
            level[i] = 0
        found = False
        while queue:
            i = queue.popleft()
            found = found or right[i] > 0
            for e in to[i]:
                j = ends[e]
                if room[e] and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return [x >= 0 for x in level]
        # A blocking flow along these distances; next edge of each node, so that no dead end is tried twice.
        turn = [0] * len(left)
        for start, c in enumerate(left):
            while left[start]:
                path, i = [], start
                while not right[i]:
                    while turn[i] < len(to[i]):
                        e = to[i][turn[i]]
                        if room[e] and level[ends[e]] == level[i] + 1:
                            break
                        turn[i] += 1
                    else:
                        if not path:
                            break
                        i = ends[path.pop() ^ 1]
                        turn[i] += 1
                        continue
                    path.append(e)
                    i = ends[e]
                if not right[i]:
                    break
                flow = min([left[start], right[i], *(room[e] for e in path)])
                left[start] -= flow
                right[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def main_text(page: str | None, model: BlockModel = NO_MODEL) -> str:
    """The main text of a page: its content blocks in page order, two line feeds between them."""
    found = blocks(page or "")
    keep = minimum_cut(costs(found, model), smoothness(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def fit(pages: DataFrame, html_col: str = "html", max_fit: int = MAX_FIT) -> BlockModel:
    """The block model, from the blocks of at most max_fit pages: content where they lie in an article or main element,
    boilerplate where they lie outside of it on a page that has one. Pages without such elements are then labelled by
    the cut, and fitted with the others, a block of them counting half."""
    source = hash_sample(pages.select(text_or_empty(pages, html_col).alias("html")), max_fit, "html")

    def seen(batches: Iterator[pa.RecordBatch], model: BlockModel | None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = [], []
            for page in b.column(0):
                found = blocks(page.as_py())
                told = any(block.element > 0 for block in found)
                if told and model is None:
                    x += map(described, found)
                    y += [block.element > 0 for block in found]
                elif not told and model is not None:
                    x += map(described, found)
                    y += minimum_cut(costs(found, model), smoothness(found))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], names=["x", "y"])

    def gathered(model: BlockModel | None) -> tuple[np.ndarray, np.ndarray]:
        sample = source.mapInArrow(lambda batches: seen(batches, model), "x array<double>, y boolean").toPandas()
        x = np.array(sample["x"].tolist()).reshape(len(sample), len(LEAN) - 1)
        return np.column_stack((x, np.ones(len(x)))), sample["y"].to_numpy(float)

    x, y = gathered(None)
    told = fitted(x, y, np.ones(len(y)))
    x2, y2 = gathered(told)
    return fitted(np.concatenate((x, x2)), np.concatenate((y, y2)), np.repeat([1.0, 0.5], [len(y), len(y2)])) if len(y2) else told


def fitted(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> BlockModel:
    """Logistic regression by Newton steps with a ridge around LEAN; both classes count alike."""
    if not len(y) or y.min() == y.max():
        return NO_MODEL
    good = y == 1
    weight = np.where(good, 0.5 * counts / counts[good].sum(), 0.5 * counts / counts[~good].sum())
    w = LEAN.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * (w - LEAN)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    w[WORDS_AT] = min(1.5 * LEAN[WORDS_AT], max(0.75 * LEAN[WORDS_AT], w[WORDS_AT]))
    return BlockModel(w)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", model: BlockModel | None = None) -> DataFrame:
    """(id_col, url, text, n_chars) for every row of pages.

    A null or empty html, and one without content blocks, has an empty text. Markup that isn't closed is read as far
    as it goes; pages of any length and depth take time in proportion. Pages are labelled one by one: no shuffle;
    repeated rows and null ids keep their rows; an empty table stays empty."""
    model = model or fit(pages, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    source = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), text_or_empty(pages, html_col).alias("html"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(page.as_py(), shared.value) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(labelled, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
