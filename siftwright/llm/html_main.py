"""Main text of web pages by minimum cut.

A page becomes its blocks of text in page order. A logistic classifier over a block's own traits (tags around it, words in class and
id names, link share, length, punctuation) gives each block a cost for either label: the capacities of its edges to the
two terminals. Neighbours in page order, and next blocks of one container, are joined by smoothness edges. The
maximum flow's cut labels all blocks at the least total cost; what stays on the source side is the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.llm.common import chunks, small_batches

# HTML element names.
RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")
#: Elements whose content is seldom text of the page; one that is never closed counts as not opened.
APART = ("noscript", "template", "svg", "object", "canvas", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br button caption option optgroup legend body html head title td th tr tbody thead tfoot".split())
#: An opening tag of the key closes open elements of the value, up to the nearest of the stops.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Weights of the classifier, in log odds for main text; one value per trait.
TAGS = {
    "article": 5.0, "main": 4.0, "nav": -12.0, "header": -7.0, "footer": -12.0, "aside": -10.0, "form": -12.0, "button": -10.0, "menu": -10.0,
    "dialog": -9.0, "head": -30.0, "label": -6.0, "legend": -6.0, "fieldset": -6.0, "p": 1.0, "blockquote": 1.0, "pre": 1.0, "h1": 1.5, "h2": 0.5, "h3": 0.5,
    "figcaption": 0.5, "li": -0.5, "noscript": -12.0, "template": -30.0, "svg": -8.0, "object": -6.0, "canvas": -6.0, "select": -12.0,
}
NAMED = (
    (re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|replies|reply|respond|discussion|reader[-_]?comments?)(?:$|[-_\s])"), -14.0),
    (re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|outbrain|taboola)(?:$|[-_\s])"), -14.0),
    (re.compile(r"(?:^|[-_\s])(?:side-?bar|aside|widgets?|related|recommended|trending|popular|breadcrumbs?|pagination|pager|tags?|share|sharing|social|toolbar)(?:$|[-_\s])"), -10.0),
    (re.compile(r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|site-?header|masthead|topbar|footer|site-?footer|copyright|colophon|skip(?:-link)?|contentinfo)(?:$|[-_\s])"), -12.0),
    (re.compile(r"(?:^|[-_\s])(?:cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|paywall)(?:$|[-_\s])"), -12.0),
    (re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body|text|prose|page)(?:$|[-_\s])"), 2.0),
)
HIDDEN = -30.0
BIAS, LINK, LENGTH, STOPS = -1.0, -5.0, 1.2, 0.8
NEXT_EDGE, SIBLING_EDGE = 0.8, 0.6
#: No label of one block may cost more than this against its neighbours.
MOST = 40.0

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_APART_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in APART}
_MEMO: dict[str, tuple[float, bool]] = {}


def _named(attributes: str) -> tuple[float, bool]:
    """Log odds from class, id and role names, and whether the element is hidden."""
    found = _MEMO.get(attributes)
    if found is None:
        names, odds, hidden = [], 0.0, False
        for key, a, b, c in _NAMES.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
            elif key in ("class", "id", "role"):
                names.append(value)
        for pattern, weight in NAMED:
            if any(pattern.search(n) for n in names):
                odds += weight
        if len(_MEMO) > 20_000:
            _MEMO.clear()
        found = _MEMO[attributes] = (odds, hidden)
    return found


class Block:
    __slots__ = ("text", "odds", "container", "letters", "linked")

    def __init__(self, container: int, odds: float):
        self.text, self.container, self.odds, self.letters, self.linked = [], container, odds, 0, 0


def blocks_of(page: str) -> list[tuple[str, float, int]]:
    """(text, log odds, container) of each block of text in page order. Broken markup is closed as browsers do, in essence."""
    out: list[tuple[str, float, int]] = []
    # an open element: name, summed odds, container number, inside a link
    stack: list[tuple[str, float, int, bool]] = [("", BIAS, 0, False)]
    serial, now, at, n = 0, None, 0, len(page)
    closed: dict[str, int] = {}

    def add(raw: str) -> None:
        nonlocal now
        if not raw or raw.isspace() and now is None:
            return
        name, odds, container, linked = stack[-1]
        text = html.unescape(raw) if "&" in raw else raw
        if now is None:
            now = Block(container, odds)
        now.text.append(text)
        size = len(text) - text.count(" ")
        now.letters += size
        if linked:
            now.linked += size

    def end() -> None:
        nonlocal now
        if now is not None:
            text = _SPACE.sub(" ", "".join(now.text)).strip()
            if text:
                share = now.linked / max(1, now.letters)
                odds = now.odds + LINK * share + LENGTH * (min(len(text), 400) / 200 - 0.25) + STOPS * min(3, text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", "…")))
                out.append((text, max(-MOST, min(MOST, odds)), now.container))
            now = None

    def pop_to(names: tuple, stops: tuple) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in stops:
                return
            if stack[i][0] in names:
                del stack[i:]
                return

    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        found = _TAG.match(page, start)
        if found is None:  # a lone "<" is text
            add(page[at:start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in BLOCK:
            end()
        if closing and name in _APART_END:
            end()
        if closing:
            if name == "p" or name in BLOCK or name in _APART_END:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i]
                        # an inline element that others were opened in: they keep their own odds
                        break
                    if stack[i][0] in BLOCK:
                        break
            continue
        if name in _RAW_END and not attributes.rstrip().endswith("/"):
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else n
            continue
        if name in VOID:
            continue
        if name in _APART_END and closed.get(name, -1) < at:  # the next end tag of that name is looked for once
            close = _APART_END[name].search(page, at)
            closed[name] = close.start() if close else n + 1
        if closed.get(name, 0) > n:
            continue
        if name in _APART_END:
            end()
        if name in CLOSES_P:
            pop_to(("p",), ("button", "table", "td", "th", "div", "article", "section", "body", "li", "blockquote"))
        if name in SIBLINGS:
            pop_to(*SIBLINGS[name])
        if name == "body":
            stack[:] = [s for s in stack if s[0] != "head"]
        if attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        above = stack[-1]
        odds, hidden = _named(attributes) if attributes else (0.0, False)
        odds += above[1] + TAGS.get(name, 0.0) + (HIDDEN if hidden else 0.0)
        if name in BLOCK:
            serial += 1
        # the container of a block is the element around its paragraph, item or heading
        container = above[2] if name not in BLOCK or name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr") else serial
        stack.append((name, max(odds, -200.0), container, above[3] or name == "a"))
    end()
    return out


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; odds > 0 is capacity from the source, < 0 to the sink.

    Only what neighbours disagree on has to flow: nodes that want one label push what they can through smoothness
    edges to nodes that want the other, along shortest paths found for all of them at once.
    """
    n = len(odds)
    excess = list(odds)
    to: list[list[int]] = [[] for _ in range(n)]
    heads: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        to[a].append(len(heads))
        heads.append(b)
        room.append(w)
        to[b].append(len(heads))
        heads.append(a)
        room.append(w)
    while True:
        via = [-2] * n
        queue = [i for i in range(n) if excess[i] > 1e-9]
        for i in queue:
            via[i] = -1
        sinks = []
        for i in queue:  # the queue grows while it is read
            for e in to[i]:
                j = heads[e]
                if via[j] == -2 and room[e] > 1e-9:
                    via[j] = e
                    queue.append(j)
                    if excess[j] < -1e-9:
                        sinks.append(j)
        moved = False
        for s in sinks:
            push, i = -excess[s], s
            while via[i] >= 0:
                push = min(push, room[via[i]])
                i = heads[via[i] ^ 1]
            push = min(push, excess[i])
            if push <= 1e-9:
                continue
            moved = True
            excess[i] -= push
            excess[s] += push
            i = s
            while via[i] >= 0:
                room[via[i]] -= push
                room[via[i] ^ 1] += push
                i = heads[via[i] ^ 1]
        if not moved:
            return [v != -2 for v in via]


def main_text(page: str | None) -> str:
    """The blocks of the source side, joined by one space."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    edges, last = [], {}
    for i, (_, _, container) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_EDGE))
        if container in last:
            edges.append((last[container], i, SIBLING_EDGE))
        last[container] = i
    keep = cut([b[1] for b in blocks], edges)
    return " ".join(b[0] for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", text_name: str = "main_text") -> DataFrame:
    """All columns of `pages` and the main text; a column of that name is replaced.

    Null and empty pages, and pages without text, give an empty text. Nothing is capped: time and memory grow with the page's
    length. Repeated rows agree; an empty table stays empty.
    """
    small_batches(pages.sparkSession)
    rest = pages.drop(text_name)
    names = rest.columns
    schema = T.StructType(rest.schema.fields + [T.StructField(text_name, T.StringType())])
    source = rest.withColumn("__html", F.col(f"`{html_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__html"):
            text = pa.array([main_text(p) for p in part.column(len(names)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], text], [*names, text_name])

    return source.mapInArrow(run, schema)
