"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the text between two boundaries of block elements. A naive Bayes classifier over shapes of blocks
(element, length, share of words in links, how the text ends), whose counts are grouped sums over a bounded sample of pages, and
the names of the elements around a block give the cost of either label; they are the capacities from and to the terminals of a
graph. Neighbouring blocks, and blocks next to each other in one container, are joined by edges that it costs to cut. The
minimum cut, found by maximum flow, is the labelling of least total cost; the side of the source is the main text."""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, texts_of

#: Pages that fit the classifier: at most so many, the first by a hash of the row.
SAMPLE = 2000
#: Capacities are integers: costs in nats, times UNIT.
UNIT = 1000
#: What the name of an element around a block says, in nats; a sentence of ordinary shape says some two.
CUE = 6.0
#: Costs of separating two neighbours: in one container, in containers of one parent, further apart; and of two that follow in one container with others between.
NEAR, BESIDE, APART, CONTAINER = 1.5, 0.6, 0.2, 0.8
#: Pseudo-counts of each shape for either label, and what one shape may tell at most: four of them tell less than a name.
SMOOTH, MOST = 2.0, 1.2

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object select xmp noembed noframes canvas audio video".split())
#: Those of them that nothing but their end tag ends.
PLAIN = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TABLE = set("table tbody tfoot thead tr td th body html".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - set("body head html caption tbody td tfoot th thead tr dd dt li option optgroup legend summary".split()) | {"li", "dd", "dt", "table"}
#: An element that is ended by the start of one of these, unless one of the others stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Names in elements, roles, classes and ids that tell main text, and those that tell the rest.
GOOD_TAGS, BAD_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "fieldset", "search", "head"}
GOOD_ROLES, BAD_ROLES = {"main", "article"}, set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tooltip".split())
GOOD_NAMES = set("article articlebody articletext body bodytext content entry hentry main maincontent maintext post postbody postcontent postentry story storybody text".split())
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit alert announcement author-box banner blogroll breadcrumb breadcrumbs byline-share comment commentary comments commentlist "
    "consent contentinfo cookie cookies copyright crumbs disclaimer discussion disqus dropdown feedback foot footer footnav form gdpr globalnav head header hidden legal links login mainmenu masthead menu menubar "
    "message-bar modal more-stories nav navbar navigation navlist newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup privacy promo promoted promotion recommended "
    "recommendations register related replies reply respond responses search searchbox share sharebar sharing shout sidebar side sidenav signin signup skip social sponsor sponsored sponsors subnav subscribe subscription "
    "taboola tagcloud tags teaser toc toolbar tooltip topbar topnav trackback usercomments widget widgets".split()
)
#: Names around which nothing is main text, articles within included.
NEVER_TAGS, NEVER_NAMES = {"nav", "footer", "aside"}, set("comment commentary commentlist comments discussion disqus recommended related replies respond responses sidebar usercomments".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Comments, declarations, tags with quoted values; a tag that never ends takes the rest of the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<(?=/?[A-Za-z]).*", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
_DULL = {"html", "body"}


def cue(tag: str, attributes: str) -> int:
    """1 if an element's names tell main text, -1 if they tell the rest, -2 if they tell it for all within, 0 else. What tells the rest outweighs."""
    bad, good, never = tag in BAD_TAGS, tag in GOOD_TAGS, tag in NEVER_TAGS
    if attributes and tag not in _DULL:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                bad, good = bad or value.lower() in BAD_ROLES, good or value.lower() in GOOD_ROLES
            elif name in ("class", "id") and value:
                parts = set()
                for w in re.split(r"[\s]+", value):
                    parts.add(w.lower())
                    parts.update(x.lower() for x in _WORDS.findall(w))
                    parts.update(re.split(r"[-_]+", w.lower()))
                bad, good, never = bad or not parts.isdisjoint(BAD_NAMES), good or not parts.isdisjoint(GOOD_NAMES), never or not parts.isdisjoint(NEVER_NAMES)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "aria-modal" or name == "style" and _HIDDEN.search(value):
                bad = True
    return -2 if never else -1 if bad else 1 if good else 0


class Element:
    """marks: 2 if it holds a first heading or `main`, 1 if it holds an article. said: what names tell of blocks in it, see named()."""

    __slots__ = ("tag", "parent", "cue", "marks", "said")

    def __init__(self, tag: str, parent: Element | None, cue: int):
        self.tag, self.parent, self.cue, self.marks, self.said = tag, parent, cue, 0, None


class Block:
    __slots__ = ("text", "holder", "linked", "words")

    def __init__(self, text: str, holder: Element, linked: int, words: int):
        self.text, self.holder, self.linked, self.words = text, holder, linked, words


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page, in order: white space is one space, character references are decoded, elements without text and markup are left out."""
    out: list[Block] = []
    root = Element("#", None, 0)
    here, links, pos = root, 0, 0
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p.split()) for p, inside in parts if inside)
                out.append(Block(text, here, linked, text.count(" ") + 1))
            parts.clear()

    def close(tags: set[str], stops: set[str]) -> None:
        """Ends the innermost element of `tags` and all within it, unless one of `stops` is met first or none is open."""
        nonlocal here
        if not any(opened[t] for t in tags):
            return
        e = here
        while e.tag not in tags:
            if e is root or e.tag in stops:
                return
            e = e.parent
        flush()
        while here is not e.parent:
            opened[here.tag] -= 1
            here = here.parent

    def say(text: str) -> None:
        if text:
            parts.append((html.unescape(text) if "&" in text else text, links > 0))

    def past(tag: str) -> int:
        """Where the raw text of an element ends; -1 if nowhere."""
        e = None if tag in endless else _RAW_END[tag].search(page, pos)
        if e is None:
            endless.add(tag)
        return e.end() if e else -1

    end = len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append((m[0][9:].removesuffix("]]>"), links > 0))
            continue
        tag, attributes = m[2].lower(), m[3]
        empty = attributes.endswith("/")
        if m[1]:
            if tag == "a":
                links = 0
            elif tag in BLOCK:
                flush()
                # within a cell, only what the cell holds is ended
                close({tag}, set() if tag in TABLE else {"td", "th"})
        elif tag in RAW:
            if not empty or tag in PLAIN:
                past_it = past(tag)
                pos = past_it if past_it >= 0 else end if tag in PLAIN else pos
        elif tag == "a":
            links = 1
        elif tag == "br":
            parts.append((" ", links > 0))
        elif tag in BLOCK:
            if opened["p"] and tag in ENDS_P:
                close({"p"}, {"table", "td", "th", "button"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            flush()
            if tag in VOID or tag in ("html", "body") and opened[tag]:
                continue
            here = Element(tag, here, cue(tag, attributes))
            opened[tag] += 1
            mark = 2 if tag in ("h1", "main") else 1 if tag == "article" and here.cue > 0 else 0
            e = here.parent
            while e is not None and e.marks < mark:
                e.marks = mark
                e = e.parent
        elif tag not in VOID and not empty and attributes and (told := cue(tag, attributes)) < 0:
            # an inline element that is an advert or hidden, and holds but text, is a block of its own
            stop = page.find("<", pos)
            if page[stop : stop + 2 + len(tag)].lower() == f"</{tag}":
                flush()
                here = Element(tag, here, told)
                say(page[pos:stop])
                flush()
                here, pos = here.parent, stop
    flush()
    return out


def told(e: Element) -> tuple[int, int, bool]:
    """What names tell of blocks in an element: of headings, of others; and whether an article is around.

    The innermost telling name counts, but for those that tell it for all within. A wrapper that holds an article or a first heading doesn't
    tell the rest by its name. A header in an article is the page's but for its headings."""
    chain = []
    while e is not None and e.said is None:
        chain.append(e)
        e = e.parent
    heading, other, article = e.said if e is not None else (0, 0, False)
    for e in reversed(chain):
        if heading > -2:
            if e.cue == -2 and (e.tag in NEVER_TAGS or e.marks < 2):
                heading = other = -2
            elif e.cue > 0:
                heading = other = 1
            elif e.cue < 0 and e.tag == "header":
                heading, other = heading if article else -1, -1
            elif e.cue < 0 and not e.marks:
                heading = other = -1
        article = article or e.tag in GOOD_TAGS
        e.said = heading, other, article
    return heading, other, article


def named(b: Block) -> int:
    """1 if the names around a block tell main text, -1 if they tell the rest, 0 else."""
    heading, other, _ = told(b.holder)
    x = heading if b.holder.tag in HEADINGS else other
    return max(x, -1)


_ENDS = re.compile(r"[.!?:;\"”»…)]$")


def shape(b: Block) -> tuple[int, int, int, int]:
    """Element, length, share of linked words, ending."""
    tag = b.holder.tag
    kind = 0 if tag == "p" else 1 if tag in HEADINGS else 2 if tag == "li" else 3 if tag in ("td", "th", "dd", "dt") else 4 if tag in ("blockquote", "pre", "figcaption") else 5
    size = min(b.words, 63).bit_length()
    share = b.linked / b.words
    return kind, size, 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3, 1 if _ENDS.search(b.text) else 0


SIZES = (6, 7, 4, 2)
OFFSETS = (0, 6, 13, 17)
SHAPES = 19


def fit(pages: DataFrame, id_cols: tuple[str, ...], text: str, sample: int = SAMPLE) -> np.ndarray:
    """Log-odds of main text for each value of each shape, from the blocks of at most `sample` pages whose names tell their label."""
    h = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in id_cols], F.col(f"`{text}`").cast("string"))
    last = pages.select(h.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = pages.where(h <= last).limit(sample) if last is not None else pages.limit(0)

    def count(batches):
        tally = np.zeros((2, SHAPES), np.int64)
        for b in batches:
            for t in texts_of(b.column(0)):
                for x in blocks_of(t.decode()):
                    if label := named(x):
                        for o, v in zip(OFFSETS, shape(x), strict=True):
                            tally[int(label > 0), o + v] += 1
        i, s = np.nonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(tally[i, s])], ["i", "s", "n"])

    page = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")
    tally = np.full((2, SHAPES), SMOOTH)
    for r in rows.select(page).mapInArrow(lean(count), "i long, s long, n long").groupBy("i", "s").agg(F.sum("n").alias("n")).collect():  # 38 rows at most
        tally[r["i"], r["s"]] += r["n"]
    odds = np.zeros(SHAPES)
    for o, k in zip(OFFSETS, SIZES, strict=True):
        p = tally[:, o : o + k] / tally[:, o : o + k].sum(axis=1, keepdims=True)
        odds[o : o + k] = np.clip(np.log(p[1] / p[0]), -MOST, MOST)
    return odds


class Flow:
    """Maximum flow by shortest augmenting levels (Dinic), without recursion."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def run(self, s: int, t: int) -> int:
        """Saturates the graph; what levels() reaches from s is then the side of the source."""
        total = 0
        to, room, out = self.to, self.room, self.out
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(out)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    pushed = min(room[e] for e in path)
                    total += pushed
                    for e in path:
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    cut = next(i for i, e in enumerate(path) if room[e] == 0)
                    a = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges, moved = out[a], False
                while at[a] < len(edges):
                    e = edges[at[a]]
                    if room[e] > 0 and level[to[e]] == level[a] + 1:
                        path.append(e)
                        a = to[e]
                        moved = True
                        break
                    at[a] += 1
                if not moved:
                    if a == s:
                        break
                    level[a] = -1
                    a = to[path.pop() ^ 1]
        return total


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(a, b, cost of separating them): each block and the next one, and the last one before it in the same container."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        box = b.holder.parent
        key = id(box)
        if i:
            other = blocks[i - 1].holder
            near = other is b.holder or other.parent is box or other is box or other.parent is b.holder
            beside = box is not None and other.parent is not None and (other.parent.parent is box.parent or other.parent.parent is box or other.parent is box.parent)
            edges.append((i - 1, i, round(UNIT * (NEAR if near else BESIDE if beside else APART))))
        if key in last and last[key] != i - 1:
            edges.append((last[key], i, round(UNIT * CONTAINER)))
        last[key] = i
    return edges


def costs(blocks: list[Block], odds) -> list[int]:
    """What it costs more to call each block boilerplate than to call it main text."""
    return [round(UNIT * (CUE * named(b) + sum(odds[o + v] for o, v in zip(OFFSETS, shape(b), strict=True)))) for b in blocks]


def labels(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each block is main text in the labelling of least cost; of several, the one with the least main text."""
    n = len(gain)
    if all(g > 0 for g in gain):
        return [True] * n
    if all(g <= 0 for g in gain):
        return [False] * n
    flow = Flow(n + 2)
    for i, g in enumerate(gain):
        if g > 0:
            flow.edge(n, i, g)
        elif g < 0:
            flow.edge(i, n + 1, -g)
    for a, b, c in edges:
        flow.edge(a, b, c, c)
    flow.run(n, n + 1)
    level = flow.levels(n)
    return [x >= 0 for x in level[:n]]


def main_text(page: str, odds) -> str:
    blocks = blocks_of(page)
    keep = labels(costs(blocks, odds), smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extracted(pages: DataFrame, page: str = "html", id_cols: tuple[str, ...] = ("page_id", "url"), sample: int = SAMPLE) -> DataFrame:
    """The columns `id_cols`, text and n_chars (code points), one row for each page.

    A null page is empty, an empty one has an empty text; null ids and addresses stay null, repeated rows count each. Pages are
    read whole, however long or broken. White space is what Unicode calls so; `br` is white space within a block. Other columns
    are ignored, whatever their names. Without pages whose names tell, shapes say nothing and names alone decide."""
    odds = pages.sparkSession.sparkContext.broadcast(fit(pages, id_cols, page, sample).tolist())
    n = len(id_cols)

    def extract(batches):
        for b in batches:
            texts = [main_text(t.decode(), odds.value) for t in texts_of(b.column(n))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    names = [f"c{i}" for i in range(n)]
    rows = pages.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(id_cols, names, strict=True)], F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).alias("t"))
    kinds = ", ".join(f"{k} {kind}" for k, kind in rows.dtypes[:n])
    out = rows.mapInArrow(lean(extract), f"{kinds}, text string, n_chars long")
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, id_cols, strict=True)], "text", "n_chars")


def op11_page_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; see extracted()."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
