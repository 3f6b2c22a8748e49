"""Main text of web pages by minimum-cut labelling.

A page's blocks (runs of text between block-level tags) are nodes. A linear classifier over length, punctuation, share of
linked text, headings, repetition, the elements that a block stands in and the wording of their class and id attributes
gives each block a log-odds of being content; it becomes the capacity from the source (content) or to the sink
(boilerplate). No feature of a block but an element that is boilerplate by its definition decides alone: weights are of
the size of a few sentences' worth of evidence, and edges are as strong, so a block with little evidence of its own
follows its surroundings. Consecutive blocks, and consecutive blocks of one element under one parent, are joined by edges
whose capacity falls with the distance between them in the document tree. The minimum cut is the labelling of least total
cost. A block whose own capacity is at least that of all its edges keeps its side in some minimum cut; it is settled at
once, its edges are added to its neighbours' capacities, and so on, and what then remains enters the maximum flow.

Defined results: null or empty html has an empty text; markup may be cut off, unclosed or misnested; equal pages have
equal texts; pages of any length are read whole, in time nearly linear in their blocks; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm.common import bounded_batches, read_table

_ATTRIBUTES = r"""((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)"""
_RAW = r"<(script|style|title|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|{_RAW}"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_ATTRIBUTES}>"
    r"|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
#: Elements that are skipped as a whole where their end tag is found; without one, only the tag is.
_SKIPPED = frozenset("noscript template select button svg math object canvas audio video".split())
_SKIPS = re.compile(rf"<!--.*?(?:-->|\Z)|{_RAW}|<(/?)({'|'.join(sorted(_SKIPPED))})(?=[\s/>]){_ATTRIBUTES}>", re.S | re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html head legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset(["hr"])
_BOILERPLATE = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "search", "head"])
_CONTENT = frozenset(["article", "main"])
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMED = frozenset(["class", "id", "role", "hidden", "style", "aria-hidden"])
_WORDS = (
    r"(?:ads?|advert\w*+|banner|breadcrumbs?|byline-share|captcha|comments?|cookies?|consent|copyright|disqus|dock|footer|header|hidden|legal|login|masthead|menu\w*+|modal|"
    r"nav\w*+|newsletter|notice|notification|overlay|pagination|pager|popup|promo\w*+|recommend\w*+|related|repl(?:y|ies)|rss|search|share|sharing|sidebar\w*+|signup|skip|social|"
    r"sponsor\w*+|subscribe|subscription|tags?|toolbar|tooltip|widget|alert|complementary|contentinfo|navigation)"
)
#: A whole token of a class, id or role: words of boilerplate, and others that only tell place or shape.
_SHAPES = r"(?:site|global|top|bottom|left|right|bar|box|list|links?|buttons?|area|block|section|wrap|wrapper|container|inner|outer|form|items?|posts?|stories|articles|slots?|units?|zone|\d+)"
_AGAINST = re.compile(rf"(?:^|\s)(?:{_SHAPES}[_-]+)*{_WORDS}(?:[_-]+(?:{_WORDS}|{_SHAPES}))*(?:$|\s)", re.I)
#: Words of what readers write, anywhere in a token but after a word that only tells whether there is any.
_READERS = re.compile(r"(?:^|\s)(?!(?:has|no|with|without|open|closed|enable[sd]?|disable[sd]?|allow)[_-])(?:[^\s_-]+[_-]+)*(?:comment|discuss|disqus|respond|response|repl(?:y|ies)|feedback|reaction|guestbook|talkback|thread)(?!\S*(?:enabled|disabled|open|closed|count)(?:$|\s))", re.I)
#: A short line that tells who wrote something or when.
_BYLINE = re.compile(r"\b\d{1,2}[:.]\d{2}\b|\b(?:19|20)\d{2}\b|\b\d+\s*[a-zäöüéñ]+\s+ago\b|\b(?:says|said|wrote|writes|replied|reply|permalink)\b\W*$", re.I)
_FOR = re.compile(r"(?:^|[\s_-])(?:article\w*|content|entry|main|post(?:-?body|-?text)?|story|text|prose)(?:$|[\s_-])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE = re.compile(r"[.!?…。！？]")

#: Zones: content, unknown, boilerplate by a class, id or role alone, boilerplate.
CONTENT, UNKNOWN, MARKED, AGAINST = 1, 0, -1, -2
#: Log-odds by the block's nearest telling ancestor, and for what it holds: a heading, an end of a sentence, commas (three at most), characters (300 at most), linked text, and text that stood before.
ZONE, HEADING, SENTENCE, COMMA, LINKS, BASE, PER_100, REPEATED = {CONTENT: 1.8, UNKNOWN: 0.0, MARKED: -2.5, AGAINST: -7.0}, 0.8, 0.7, 0.2, -3.5, -1.4, 0.9, -0.7
#: Capacities of edges at no distance between consecutive blocks, and between consecutive ones of one element and parent.
ADJACENT, SIBLINGS = 4.0, 2.0
#: Log-odds of a block outside the page's article, or outside main where there is none, by the share of the text that is inside; of one that comes after it all; and of one in several alike elements that each have a byline, behind other text.
OUTSIDE, AFTER, DATED = -5.0, -1.0, -3.0
#: Characters of a byline at most, and of a block that such elements must follow at least; steps from a byline to its element.
BYLINE, LEADING, CLIMB = 80, 100, 4
#: Elements that part a page: leaving or entering one counts as so many steps more.
_LANDMARKS = _BOILERPLATE | _CONTENT | frozenset(["header", "section"])
BOUNDARY = 3


def _zone(tag: str, attributes: str, above: int) -> int:
    """Nothing within boilerplate is content, but an article or main within what is only marked so is."""
    if above == AGAINST or tag in _BOILERPLATE:
        return AGAINST
    zone = above
    if attributes and attributes != "/":
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name not in _NAMED:
                continue
            if name == "hidden" or (name == "style" and _UNSEEN.search(value)) or (name == "aria-hidden" and value == "true"):
                return AGAINST
            if name in ("class", "id", "role") and zone != MARKED and tag not in ("body", "html", "article", "main"):
                if _AGAINST.search(value) or _READERS.search(value):
                    zone = MARKED
                elif _FOR.search(value):
                    zone = CONTENT
    if tag == "header" and zone == UNKNOWN:
        return AGAINST
    return CONTENT if tag in _CONTENT else zone


def _ends(page: str) -> dict[int, int]:
    """Where the elements of _SKIPPED end, by where their content starts; those without an end tag are left out."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _SKIPS.finditer(page):
        if m[3] is None:
            continue
        starts = opened.setdefault(m[3].lower(), [])
        if not m[2]:
            if not m[4].endswith("/"):
                starts.append(m.end())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


class Block:
    __slots__ = ("text", "odds", "node", "tag", "zone")

    def __init__(self, text: str, odds: float, node: int, tag: str, zone: int):
        self.text, self.odds, self.node, self.tag, self.zone = text, odds, node, tag, zone


def _weigh_place(blocks: list[Block], parents: list[int], kinds: list[str]) -> None:
    """What tells by place and not by words: where a block stands to the page's article, and whether it is one of several alike with bylines, as what readers write is."""
    within = "article" if "article" in kinds else "main"
    inside = [False] * len(parents)
    for node in range(1, len(parents)):
        inside[node] = inside[parents[node]] or kinds[node] == within
    open_ = [b for b in blocks if b.zone >= UNKNOWN]
    total = sum(len(b.text) for b in open_)
    share = sum(len(b.text) for b in open_ if inside[b.node]) / total if total else 0.0
    last = max((i for i, b in enumerate(blocks) if inside[b.node] and b.zone >= UNKNOWN), default=len(blocks))
    alike: dict[tuple[int, str], set[int]] = {}
    begun: dict[tuple[int, str], bool] = {}
    led = False
    for i, b in enumerate(blocks):
        if share and b.zone >= UNKNOWN and not inside[b.node]:
            b.odds += OUTSIDE * share + AFTER * (i > last)
        signed = len(b.text) <= BYLINE and _BYLINE.search(b.text)
        node = b.node
        for _ in range(CLIMB):
            if node <= 0:
                break
            group = parents[node], kinds[node]
            if begun.setdefault(group, led) and signed:  # other text came before the first of them
                alike.setdefault(group, set()).add(node)
            node = parents[node]
        led = led or (len(b.text) >= LEADING and b.zone >= UNKNOWN)
    told = {node for nodes in alike.values() if len(nodes) > 1 for node in nodes if kinds[node].split(" ")[0] not in ("tr", "td", "th", "p")}
    if told:
        dated = [False] * len(parents)
        for node in range(1, len(parents)):
            dated[node] = dated[parents[node]] or node in told
        for b in blocks:
            b.odds += DATED * dated[b.node]


def blocks_of(page: str) -> tuple[list[Block], list[int], list[int]]:
    """Blocks in page order, each tree node's parent, and the steps between both."""
    out: list[Block] = []
    parents, steps, kinds, stack, zones = [-1], [0], [""], [("", 0)], [0]
    parts: list[str] = []
    linked, in_link, at = 0, False, 0
    opened: dict[str, int] = {}
    told: set[str] = set()

    def flush() -> None:
        nonlocal linked
        raw = "".join(parts)
        text = " ".join(unescape(raw).split())
        if text:
            tag, node = stack[-1]
            odds = BASE + ZONE[zones[-1]] + PER_100 * min(len(text), 300) / 100 + LINKS * min(1.0, linked / len(raw))
            odds += HEADING * (tag[0:1] == "h" and tag[1:].isdigit()) + SENTENCE * bool(_SENTENCE.search(text)) + COMMA * min(text.count(","), 3) + REPEATED * (text in told)
            told.add(text)
            out.append(Block(text, odds, node, tag, zones[-1]))
        parts.clear()
        linked = 0

    def pop(k: int) -> None:
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:], zones[k:]

    ends: dict[int, int] | None = None
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _SKIPPED:
            if not m[2]:
                ends = _ends(page) if ends is None else ends
                at = ends.get(at, at)
            continue
        if tag not in _BLOCKS:
            if tag == "a":
                in_link = not m[2]
            elif tag == "br" or tag == "img":
                parts.append(" ")
            continue
        if parts:
            flush()
        if m[2]:
            if opened.get(tag):
                pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k][0]
            if open_tag == "p" or open_tag in _CLOSES.get(tag, ()):
                pop(k)
            elif open_tag not in ("td", "th"):
                break
        if tag not in _VOID:
            parents.append(stack[-1][1])
            steps.append(1 + BOUNDARY * (tag in _LANDMARKS))
            zone = _zone(tag, m[4], zones[-1])
            nested = tag == "article" and opened.get("article") and zone > MARKED  # what readers write of an article, by the elements' definition
            zones.append(MARKED if nested else zone)
            kinds.append(tag if tag in _CONTENT else f"{tag} {m[4].strip()}")
            stack.append((tag, len(parents) - 1))
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        parts.append(page[at:])
    if parts:
        flush()
    _weigh_place(out, parents, kinds)
    return out, parents, steps


def _distance(parents: list[int], steps: list[int], a: int, b: int) -> int:
    """Steps between two nodes of the tree; a parent's number is below its children's."""
    n = 0
    while a != b:
        if a < b:
            a, b = b, a
        n += steps[a]
        a = parents[a]
    return n


def edges_of(blocks: list[Block], parents: list[int], steps: list[int]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, str], int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = ADJACENT / (1 + _distance(parents, steps, blocks[i - 1].node, b.node))
        above = parents[b.node], b.tag
        if (j := last.get(above)) is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLINGS
        last[above] = i
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; odds above 0 are capacities from the source, below 0 to the sink."""
    n = len(odds)
    odds, total, near = list(odds), [0.0] * n, [[] for _ in range(n)]
    for (a, b), c in edges.items():
        total[a] += c
        total[b] += c
        near[a].append((b, c))
        near[b].append((a, c))
    fixed = [False] * n
    ready = deque(i for i in range(n) if abs(odds[i]) >= total[i])
    while ready:
        i = ready.popleft()
        if fixed[i]:
            continue
        fixed[i] = True
        for j, c in near[i]:  # the edge now ends in a terminal
            if not fixed[j]:
                odds[j] += c if odds[i] > 0 else -c
                total[j] -= c
                if abs(odds[j]) >= total[j]:
                    ready.append(j)
    free = [i for i in range(n) if not fixed[i]]
    if free:
        side = _flow(free, odds, near, fixed)
        return [side[i] if not fixed[i] else odds[i] > 0 for i in range(n)]
    return [x > 0 for x in odds]


def _flow(free: list[int], odds: list[float], near: list[list[tuple[int, float]]], fixed: list[bool]) -> dict[int, bool]:
    """Dinic's maximum flow among the nodes that aren't fixed; then what the source still reaches."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: {} for i in [*free, source, sink]}
    for i in free:
        for j, c in near[i]:
            if not fixed[j]:
                room[i][j] = c
        if odds[i] > 0:
            room[source][i], room[i][source] = odds[i], 0.0
        else:
            room[i][sink], room[sink][i] = -odds[i], 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i: i in level for i in free}
        todo = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for v in todo[u]:
                if room[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    blocks, parents, steps = blocks_of(page or "")
    if not blocks:
        return ""
    content = minimum_cut([b.odds for b in blocks], edges_of(blocks, parents, steps))
    return "\n".join(b.text for b, keep in zip(blocks, content) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with html replaced by text string. Narrow: no shuffle."""
    others = [c for c in pages.columns if c not in (html, text)]
    schema = pages.select(*others, F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], texts], [*others, text])

    return pages.select(*others, F.col(html).cast("string").alias(html)).transform(bounded_batches).mapInArrow(run, schema)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
