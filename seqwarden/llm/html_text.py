"""Main text of web pages: tag paths are chosen by the ratios of their text, punctuation and nodes."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose source is no text of the page.
RAW = frozenset("script style title noscript template iframe svg math object canvas textarea select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote "
    "figure figcaption header footer nav aside form fieldset address details summary hr center dir menu hgroup search dialog".split()
)
#: A start tag closes the last of the first tags, unless one of the second was opened after it.
CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
#: What tags and roles say of the text in them, as factors of a path's ratio.
TAGS = {t: 0.02 for t in "nav footer aside form button menu dialog search datalist".split()}
ROLES = {r: 0.02 for r in "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()}
LINK = 0.3
OUTSIDE = 0.6  # not in an article or main element, on a page that has one
#: Words of class and id: a strong word tells of boilerplate, a weak one is also used for content, so long text outweighs it.
STRONG, WEAK = 0.1, 0.65
WORDS = {
    w: STRONG
    for w in "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert advertisement adverts sponsor sponsored cookie cookies consent gdpr "
    "popup modal newsletter subscribe signup comment comments disqus replies pagination pager login".split()
} | {
    w: WEAK
    for w in "masthead aside widget promo promotion banner notice overlay subscription reply respond share sharing social related recommended toolbar search skip topbar".split()
}
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that stand for their blocks in the flow around them.
FLOW = frozenset("ul ol dl li dt dd table thead tbody tfoot tr td th blockquote figure details header hgroup".split())
PUNCTUATION = frozenset(".,;:!?…·¿¡。，、；：！？")
THRESHOLD = 0.55  # of the best path's ratio
LEAST_SHARE = 0.05  # of the weighted text that the best paths hold together
TAG_END = re.compile(r"""=\s*["']|>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Node:
    """A run of text: the number of its tag path, the block element it is in (-1: none), its block, whether a link holds it."""

    path: int
    element: int
    block: int
    link: bool
    text: str


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)  # by element number, which is greater than its parent's
    parents: list[int] = field(default_factory=list)
    by_tag: list[float] = field(default_factory=list)  # factors by path
    by_word: list[float] = field(default_factory=list)
    in_article: list[bool] = field(default_factory=list)


def _markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of all markup, in time linear in the source; comments and raw elements have no tag.

    A tag that never ends is text. A quoted value that never ends is no value.
    """
    at, quotes, open_ended = 0, True, set()
    raw_end: dict[str, re.Pattern[str]] = {}
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        if source.startswith("<!--", start):
            ends = [e + 3 for e in (source.find("-->", start + 2),) if e >= 0]
            at = ends[0] if ends else len(source)
            yield start, at, "", False, ""
            continue
        if source[start + 1 : start + 2] in ("!", "?"):
            at = source.find(">", start) + 1 or len(source)
            yield start, at, "", False, ""
            continue
        closing = source.startswith("/", start + 1)
        name = NAME.match(source, start + 1 + closing)
        if not name:
            if closing:
                at = source.find(">", start) + 1
                if not at:
                    return
                yield start, at, "", False, ""
            continue
        end = name.end()
        while found := TAG_END.search(source, end) if quotes else None:
            end = found.end()
            if found[0] == ">":
                break
            mark = found[0][-1]
            if mark not in open_ended:
                close = source.find(mark, end)
                if close >= 0:
                    end = close + 1
                else:
                    open_ended.add(mark)
        if not found:
            quotes, end = False, source.find(">", name.end()) + 1
            if not end:
                return
        tag, attributes, at = name[0].lower(), source[name.end() : end - 1], end
        if tag in RAW and not closing and not attributes.endswith("/"):
            pattern = raw_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.I))
            last = pattern.search(source, end)
            at = (source.find(">", last.end()) + 1 if last else 0) or len(source)
            yield start, at, "", False, ""
            continue
        yield start, end, tag, closing, attributes


def _marks(attributes: str) -> tuple[set[str], str, bool]:
    """(words of class and id, role, hidden)."""
    words: set[str] = set()
    role, hidden = "", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words.update(w for w in re.split(r"[\s_\-]+", value) if w)
        elif name == "role":
            role = value
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return words, role, hidden


def parse(source: str) -> Page:
    """Text nodes that are shown, in page order. Missing end tags are implied as in browsers.

    Paths and elements are numbers that know their parent, and open elements are found by their tag, so a page of any depth takes
    time and memory in proportion to its length.
    """
    page = Page()
    stack: list[tuple[str, int, int, bool]] = []  # tag, number of the innermost block element, path, hidden
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    blocks: list[int] = []  # places of block elements
    paths: dict[tuple[int, str], int] = {}
    block, at = 0, 0

    def text(raw: str) -> None:
        if not raw or stack and stack[-1][3]:
            return
        path, element = (stack[-1][2], stack[-1][1]) if stack else (-1, -1)
        link = bool(where["a"])
        last = page.nodes[-1] if page.nodes and page.nodes[-1].block == block else None
        if raw.isspace():
            if last:
                last.text += " "
        elif last and last.path == path and last.link == link:
            last.text += raw
        else:
            page.nodes.append(Node(path, element, block, link, raw))

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            where[stack.pop()[0]].pop()
        while blocks and blocks[-1] >= down_to:
            blocks.pop()

    def last_open(tags: str) -> int:
        return max((where[t][-1] for t in tags.split() if where[t]), default=-1)

    for start, end, tag, closing, attributes in _markup(source):
        text(source[at:start])
        at = end
        if tag in ("br", "wbr"):
            if tag == "br":
                text(" ")
            continue
        if not tag:
            continue
        block += tag in BLOCK
        if closing:
            # the end of an inline element never closes a block
            if where[tag] and (tag in BLOCK or not blocks or where[tag][-1] > blocks[-1]):
                close(where[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if tag in CLOSES:
            same, limit = (last_open(t) for t in CLOSES[tag])
            if same > limit:
                close(same)
        if tag == "a" and where["a"] and (not blocks or where["a"][-1] > blocks[-1]):
            close(where["a"][-1])
        if tag in ("html", "body") and where[tag]:
            continue
        words, role, hidden = _marks(attributes) if attributes else (set(), "", False)
        parent = stack[-1] if stack else ("", -1, -1, False)
        whole = tag in ("html", "body")
        name = tag if whole else ".".join([tag, *sorted(words)])
        name = f"{name} {role}" if role else name
        path = paths.setdefault((parent[2], name), len(paths))
        if path == len(page.by_tag):
            up_tag, up_word, up_article = (page.by_tag[parent[2]], page.by_word[parent[2]], page.in_article[parent[2]]) if parent[2] >= 0 else (1.0, 1.0, False)
            own = 1.0 if whole else min(TAGS.get(tag, 1.0), ROLES.get(role, 1.0), TAGS["nav"] if tag == "header" and not up_article else 1.0)
            page.by_tag.append(min(up_tag, own))
            page.by_word.append(up_word if whole else min([up_word, *(WORDS.get(w, 1.0) for w in words)]))
            page.in_article.append(up_article or tag in ("article", "main") or role == "main")
        number = parent[1]
        if tag in BLOCK:
            number = len(page.tags)
            page.parents.append(parent[1])
            page.tags.append(tag)
            blocks.append(len(stack))
        where[tag].append(len(stack))
        stack.append((tag, number, path, parent[3] or hidden and not whole))
    text(source[at:])
    for n in page.nodes:
        n.text = html.unescape(n.text)
    page.nodes = [n for n in page.nodes if n.text.strip()]
    return page


def _smooth(values: list[float], paths: list[int]) -> list[float]:
    """Gaussian of width one half over two neighbours on either side; a neighbour of another path counts a quarter."""
    weight = [math.exp(-2 * d * d) for d in range(3)]
    out = []
    for i in range(len(values)):
        near = [(weight[abs(d)] * (1.0 if paths[i + d] == paths[i] else 0.25), values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_ratios(page: Page) -> tuple[dict[tuple[int, bool], float], float]:
    """(ratio by path and link, least ratio of content).

    Text length and punctuation are summed by path and divided by its nodes, smoothed over the nodes in page order, fused, and
    averaged by path. What tags and class words tell is a factor of that ratio. The limit is a share of the ratio that the best paths with
    some share of the text reach; paths in menus, forms and the like and links set no limit, and a page of nothing else has no content.
    """
    size: dict[tuple[int, bool], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    keys = [(n.path, n.link) for n in page.nodes]
    for n, key in zip(page.nodes, keys, strict=True):
        s = size[key]
        s[0] += len(n.text)
        s[1] += sum(c in PUNCTUATION for c in n.text)
        s[2] += 1
    number = {key: i for i, key in enumerate(size)}
    order = [number[k] for k in keys]
    length = _smooth([size[k][0] / size[k][2] for k in keys], order)
    marks = _smooth([size[k][1] / size[k][2] for k in keys], order)
    fused: dict[tuple[int, bool], float] = defaultdict(float)
    for k, a, b in zip(keys, length, marks, strict=True):
        fused[k] += a / (a + 80) * (0.5 + 0.5 * b / (b + 1)) / size[k][2]
    has_article = any(page.in_article[p] for p, _ in size if p >= 0)
    # a word around all of the text tells nothing of its parts
    top_word = max((page.by_word[p] if p >= 0 else 1.0 for p, link in size if not link and (p < 0 or page.by_tag[p] == 1.0)), default=1.0)
    ratios, candidates = {}, {}
    for (p, link), f in fused.items():
        tag, word, article = (page.by_tag[p], page.by_word[p], page.in_article[p]) if p >= 0 else (1.0, 1.0, False)
        word = min(word, top_word)
        ratios[p, link] = f * word * tag * (OUTSIDE if has_article and not article else 1.0) * (LINK if link else 1.0)
        if tag == 1.0 and not link:
            candidates[p, link] = ratios[p, link]
    total, held, best = sum(size[k][0] * v for k, v in candidates.items()), 0.0, math.inf
    for k in sorted(candidates, key=candidates.__getitem__, reverse=True):
        held, best = held + size[k][0] * candidates[k], candidates[k]
        if held >= LEAST_SHARE * total:
            break
    return ratios, THRESHOLD * best


def main_text(source: str) -> str:
    """The article's text: blocks in page order, one per line. No content: empty.

    A block is content if at least half of its text outside links is on paths above the limit, and links are at most half of it. A short block of
    another path is content too if it is a paragraph, heading, list item or cell with no boilerplate in its path and stands in an
    element that holds content blocks, or in an element around those up to the article; lists and tables in which most text is links are not.
    """
    page = parse(source)
    ratios, limit = path_ratios(page)
    blocks: dict[int, list[Node]] = {}
    for n in page.nodes:
        blocks.setdefault(n.block, []).append(n)

    def above(n: Node) -> bool:
        return ratios[n.path, n.link] >= limit

    chosen: set[int] = set()
    for b, nodes in blocks.items():
        plain = sum(len(n.text) for n in nodes if not n.link)
        if 2 * sum(len(n.text) for n in nodes if not n.link and above(n)) >= max(plain, 1) and 2 * plain >= sum(len(n.text) for n in nodes):
            chosen.add(b)
    if not chosen:
        return ""

    # by element: text and linked text, to tell lists of links
    text, linked = [0] * len(page.tags), [0] * len(page.tags)
    for n in page.nodes:
        if n.element >= 0:
            text[n.element] += len(n.text)
            linked[n.element] += len(n.text) * n.link
    article, around, group = [-1] * len(page.tags), [-1] * len(page.tags), [False] * len(page.tags)
    for e in range(len(page.tags) - 1, -1, -1):
        if page.parents[e] >= 0:
            text[page.parents[e]] += text[e]
            linked[page.parents[e]] += linked[e]
    for e, parent in enumerate(page.parents):
        article[e] = e if page.tags[e] in ("article", "main") else article[parent] if parent >= 0 else -1
        # the element in whose flow e stands, and whether a list or table on the way is of links
        flows = page.tags[e] in FLOW
        around[e] = around[parent] if flows and parent >= 0 else e
        group[e] = flows and (2 * linked[e] > text[e] or parent >= 0 and group[parent])

    def flow(e: int) -> int:
        return around[page.parents[e]] if page.parents[e] >= 0 else -1

    holders: set[int] = set()
    for b in chosen:
        e = flow(blocks[b][0].element) if blocks[b][0].element >= 0 else -1
        top = article[e] if e >= 0 else -1
        while e not in holders:
            holders.add(e)
            if e < 0 or top < 0 or e == top:
                break
            e = page.parents[e]
    lines = []
    for b, nodes in blocks.items():
        first = nodes[0]
        keep = b in chosen and not (first.element >= 0 and group[first.element])
        if not keep and b not in chosen and first.element >= 0 and page.tags[first.element] in TEXT and not group[first.element]:
            apart = first.path < 0 or min(page.by_tag[first.path], page.by_word[first.path]) < WEAK
            many_links = 2 * sum(len(n.text) for n in nodes if n.link) > sum(len(n.text) for n in nodes)
            place = flow(first.element)
            heading = page.tags[first.element] in HEADINGS
            near = place in holders or heading and place >= 0 and page.parents[place] in holders
            keep = near and not apart and (heading or not many_links)
        if keep:
            lines.append(" ".join("".join(n.text for n in nodes).split()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null or empty page has an empty text. Repeated rows stay.

    Long pages are taken whole, in time and memory in proportion to their length; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
