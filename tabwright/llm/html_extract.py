"""Main text of web pages by minimum-cut labelling of their blocks.

1. A page is cut into blocks of text at block-level tags. A block knows its tags, the words of class and id
   around it, its share of linked text, its length and its punctuation. Scripts, styles, comments and other
   invisible parts are no text. Navigation, asides, footers, adverts and comments speak against all that is in them,
   articles included; forms and words of class and id only until an article begins. Inside an article, such
   words leave a block open: its text and its neighbours decide. Page headers count outside of content only.
2. A logistic classifier says how likely a block is content. It is trained on all pages: blocks whose
   surroundings speak for themselves (inside an article; inside navigation, footers, adverts, forms) are
   its examples. Features are few and discrete, so tasks count their combinations and only these counts, a
   bounded number, reach the driver. Half of the examples are shown without their surroundings, so that it
   learns to judge blocks of pages with plain markup.
3. Labelling is a minimum cut. The classifier's costs are the capacities to the two terminals; smoothness
   edges join blocks that follow each other and, more strongly, blocks near each other in the document tree
   (through one node for each parent element, so their number stays proportional to the blocks). The
   maximum flow separates content from boilerplate with the least sum of costs and broken edges.
4. Content blocks are joined in page order by an empty line.

Defined cases: a null or empty page has an empty text; a page cut off anywhere is read to its end; character
references are decoded, unknown ones stay; very long and very deep pages are read in time proportional to their
length and no depth changes what is read; tags without an end close at the next block or at the end; an
invisible element that is still open when an element around it ends does so too, so it hides no more than the
text up to the next block (only scripts, styles, titles and text fields reach to the end of the page, as in
browsers); a head holds no text of its own and ends at the body or the first block; repeated
rows are read one by one; an empty table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .arrowmap import add_columns
from .pii import logistic_regression

#: Names of HTML elements by what they do to text.
INVISIBLE = frozenset("script style noscript template svg math iframe object canvas title textarea select option".split())
#: Invisible elements without markup inside: only their own end tag ends them.
RAW = frozenset("script style textarea title".split())
#: Start tags that end an open element.
ENDED_BY = {"option": frozenset({"option", "optgroup"}), "select": frozenset({"select", "input", "textarea"})}
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of class, id and role, that speak for or against content.
FOR_TAGS, AGAINST_TAGS, FORM_TAGS = frozenset({"article", "main"}), frozenset("nav footer aside menu dialog".split()), frozenset("form button fieldset".split())
FOR_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|story|entry|body|text)(?:$|[\s_-])", re.I)
ADVERT_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*)(?:$|[\s_-])", re.I)
AGAINST_WORDS = re.compile(
    r"(?:^|[\s_-])(?:banner|promo\w*|nav\w*|menu\w*|sidebar|side|footer|foot|masthead|breadcrumbs?|"
    r"cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|copyright|legal|search|form|alert|skip|reviews?)(?:$|[\s_-])",
    re.I,
)
#: Page headers: only outside of content, where a header holds the title.
HEADER_WORDS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
#: What readers wrote: content inside of it is not the page's own.
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|reply|replies|respond|responses|discussion|disqus|guestbook)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</?\Z", re.S)
ATTRIBUTES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Capacity of an edge between blocks that follow each other, and of one between a block and its parent's node.
FOLLOWS, SIBLING = 0.3, 0.8


@dataclass
class Block:
    text: str
    parent: int  # number of the element around it
    tag: str
    good: bool  # the elements around it speak for content
    bad: bool
    linked: int  # characters inside links


@dataclass(frozen=True)
class Scope:
    """What the elements around a place say of it."""

    good: bool = False
    bad: bool = False
    closed: bool = False  # no article inside can turn it good
    article: bool = False

    def inside(self, name: str, attributes: str) -> Scope:
        """The scope inside an element of this name and these attributes."""
        if self.closed:
            return self
        words = " ".join(next((g for g in a.groups()[1:] if g is not None), "") for a in ATTRIBUTES.finditer(attributes)) if "=" in attributes and name not in ("html", "body") else ""
        if name in AGAINST_TAGS or COMMENT_WORDS.search(words) or ADVERT_WORDS.search(words) or HIDDEN.search(attributes):
            return Scope(bad=True, closed=True)
        against = AGAINST_WORDS.search(words) is not None
        if name in FOR_TAGS:
            return Scope(good=True, bad=against, article=name == "article" or self.article)
        if name in FORM_TAGS or not self.good and (name == "header" or HEADER_WORDS.search(words)):
            return Scope(bad=True)
        if against:
            return Scope(good=self.article, bad=True, article=self.article)
        return Scope(good=True) if not self.bad and not self.good and FOR_WORDS.search(words) else self


class Elements:
    """The open elements of a page. Each name knows its places, so that no end tag makes a search."""

    def __init__(self):
        self.names, self.numbers, self.scopes = [""], [0], [Scope()]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def __len__(self) -> int:
        return len(self.names)

    def push(self, name: str, number: int, scope: Scope) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCKS:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.numbers.append(number)
        self.scopes.append(scope)

    def pop(self) -> str:
        name = self.names.pop()
        self.numbers.pop()
        self.scopes.pop()
        self.places[name].pop()
        if self.blocks[-1] == len(self.names):
            self.blocks.pop()
        return name

    def opened(self, name: str) -> int:
        """The place of the element that an end tag closes; 0 for none. Other tags don't close blocks."""
        places = self.places.get(name)
        return places[-1] if places and (name in BLOCKS or places[-1] > self.blocks[-1]) else 0


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack = Elements()
    parts: list[str] = []
    number = links = linked = 0
    at, n = 0, len(html)
    never_ended: set[int] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            k = stack.blocks[-1]
            # Paragraphs are judged with their neighbours in the element around them.
            out.append(Block(text, stack.numbers[k - 1] if k else 0, stack.names[k], stack.scopes[-1].good, stack.scopes[-1].bad, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m.group(1) or m.group(4):  # an end
            if name in BLOCKS:
                flush()
            elif name == "a" and links:
                links -= 1
            if k := stack.opened(name):
                while len(stack) > k:
                    stack.pop()
            continue
        attributes = m.group(3) or ""
        if name in INVISIBLE:
            if not attributes.rstrip().endswith("/") or name in ("script", "style"):
                at = _raw_end(html, at, name) if name in RAW else _invisible_end(html, at, name, stack, never_ended)
            continue
        if name == "br" or name in ("wbr", "img", "input"):
            if name == "br":
                parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            # A block ends an open paragraph; items, cells and headings end their like.
            while len(stack) > 1 and ((last := stack.names[-1]) == "p" or last not in BLOCKS or (name == last and name in ("li", "td", "th", "tr", "dd", "dt", "option"))):
                if stack.pop() == "a" and links:
                    links -= 1
        elif name == "a":
            links += 1
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        number += 1
        stack.push(name, number, stack.scopes[-1].inside(name, attributes))
    flush()
    return out


def _behind(html: str, at: int) -> int:
    end = html.find(">", at)
    return len(html) if end < 0 else end + 1


def _raw_end(html: str, at: int, name: str) -> int:
    end = ENDS[name].search(html, at)
    return len(html) if end is None else _behind(html, end.end())


def _invisible_end(html: str, at: int, name: str, stack: Elements, never_ended: set[int]) -> int:
    """Where an invisible element ends that was opened before ``at``.

    That is behind its end tag. If an element around it or the page ends first, it has none, and ends at the next
    block or invisible element. ``never_ended``: the places of those known to have none, so no page is read over and over.
    """
    inside: list[tuple[str, int]] = []
    count: Counter = Counter()
    following, stop, start = None, len(html), at
    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            break
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if count[tag]:
                while True:
                    closed, where = inside.pop()
                    count[closed] -= 1
                    if closed == tag:
                        break
                    never_ended.add(where)
            elif tag == name:
                return at
            elif stack.opened(tag):
                stop = m.start()
                break
            continue
        if tag in ENDED_BY.get(name, ()) and not inside:
            return m.start()
        if following is None and (tag in BLOCKS or tag in INVISIBLE):
            following = m.start()
            if start in never_ended:
                return following
        if tag in RAW:
            at = _raw_end(html, at, tag)
        elif tag not in VOID and not (m.group(3) or "").rstrip().endswith("/"):
            inside.append((tag, at))
            count[tag] += 1
    never_ended.update(where for _, where in inside)
    return stop if following is None else following


def features(b: Block) -> tuple[int, ...]:
    """Discrete features: surroundings for and against, element, share of links, length, sentences."""
    n = len(b.text)
    stops = sum(b.text.count(c) for c in ".!?;:,")
    return (
        int(b.good),
        int(b.bad),
        1 if b.tag in HEADINGS else 2 if b.tag in ("li", "td", "th", "dd", "dt") else 0,
        0 if not b.linked else 1 if 3 * b.linked < n else 2,
        0 if n < 25 else 1 if n < 80 else 2 if n < 250 else 3,
        0 if not stops else 1 if stops < 3 else 2,
    )


SIZES = (2, 2, 3, 3, 4, 3)


def one_hot(f: np.ndarray) -> np.ndarray:
    """Indicator columns of discrete features, and one each for surroundings that say nothing or both."""
    columns = [f[:, k] == v for k, size in enumerate(SIZES) for v in range(1, size)]
    return np.column_stack([np.ones(len(f)), *columns, (f[:, 0] == 0) & (f[:, 1] == 0), (f[:, 0] == 1) & (f[:, 1] == 1)]).astype(float)


def count_features(df: DataFrame, html_col: str) -> list[tuple[tuple[int, ...], int]]:
    """(features, n) over the blocks of all pages: at most 432 rows."""
    ship_package(df.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(features(b) for b in blocks_of(t))
        yield pa.RecordBatch.from_pylist([{"f": ",".join(map(str, f)), "n": n} for f, n in seen.items()], pa.schema([("f", pa.string()), ("n", pa.int64())]))

    counted = df.select(html_col).mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).orderBy("f")
    return [(tuple(map(int, r["f"].split(","))), r["n"]) for r in counted.collect()]


#: Examples that hold without any page: prose is content, short linked text is not, and surroundings decide unless they say both.
PRIOR = (
    ((0, 0, 0, 0, 3, 2), 0.9), ((0, 0, 0, 0, 2, 2), 0.8), ((0, 0, 0, 0, 1, 2), 0.7), ((0, 0, 0, 0, 1, 1), 0.6), ((0, 0, 1, 0, 0, 0), 0.6), ((0, 0, 0, 2, 0, 0), 0.1), ((0, 0, 2, 2, 0, 0), 0.1), ((1, 0, 0, 0, 2, 2), 0.98), ((0, 1, 0, 0, 1, 1), 0.02), ((0, 1, 0, 0, 3, 2), 0.02),
    ((1, 1, 0, 0, 3, 2), 0.9), ((1, 1, 0, 0, 2, 2), 0.85), ((1, 1, 0, 0, 1, 1), 0.7), ((1, 1, 0, 0, 0, 0), 0.3), ((1, 1, 0, 2, 0, 0), 0.1), ((1, 1, 2, 2, 0, 0), 0.1),
)


def train(counted: list[tuple[tuple[int, ...], int]]) -> tuple[float, ...]:
    """Weights of the classifier from the counts of feature combinations."""
    rows = []
    for f, n in counted:
        good, bad = f[0], f[1]
        if good == bad:
            continue  # says nothing
        real = 0.98 if good else 0.02
        rows += [(f, real, n / 2), ((0, 0, *f[2:]), real, n / 2)]
    # What holds without any page: prose is content, short linked text is not.
    rows += [(f, real, 20.0) for f, real in PRIOR]
    x, real, n = one_hot(np.array([r[0] for r in rows])), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return tuple(logistic_regression(x, real, n, ridge=0.5).tolist())


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]], n: int) -> list[bool]:
    """Whether each of the first ``len(costs)`` of ``n`` nodes is on the source's side of a minimum cut.

    ``costs``: log odds of content; above 0 the node is cut from the source at that price, below 0 from the
    sink. Edges have the same capacity both ways. Shortest augmenting paths in levels.
    """
    source, sink = n, n + 1
    to: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        to[a].append(len(head))
        head.append(b)
        room.append(there)
        to[b].append(len(head))
        head.append(a)
        room.append(back)

    for k, c in enumerate(costs):
        if c > 0:
            join(source, k, c, 0.0)
        elif c < 0:
            join(k, sink, -c, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in to[a]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(costs))]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[a] < len(to[a]):
                e = to[a][following[a]]
                if room[e] > 1e-9 and level[head[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = head[path.pop() ^ 1]
                continue
            path.append(e)
            a = head[e]


def content_blocks(blocks: list[Block], weights: tuple[float, ...]) -> list[Block]:
    if not blocks:
        return []
    x = one_hot(np.array([features(b) for b in blocks]))
    costs = np.clip(x @ np.array(weights), -6, 6).tolist()
    parents = {p: len(blocks) + k for k, p in enumerate(dict.fromkeys(b.parent for b in blocks))}
    edges = [(k, parents[b.parent], SIBLING) for k, b in enumerate(blocks)]
    edges += [(k - 1, k, FOLLOWS) for k in range(1, len(blocks))]
    chosen = minimum_cut(costs, edges, len(blocks) + len(parents))
    return [b for b, c in zip(blocks, chosen) if c]


def main_text(html: str, weights: tuple[float, ...]) -> str:
    return "\n\n".join(b.text for b in content_blocks(blocks_of(html), weights))


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the main text of each whole page."""
    weights = train(count_features(df, html_col))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(t, weights) if t else "" for t in batch.column(batch.schema.get_field_index(html_col)).to_pylist()], pa.string())]

    return add_columns(df, {text_col: "string"}, run, html_col, keep)
