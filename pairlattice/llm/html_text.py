"""Main text of web pages by tag-path ratios.

Each page is read once into text runs with their root-to-leaf tag path (tags and classes). Per
path the text length and the punctuation of all its runs, menus and footers included, are summed
and divided by the number of runs (the two ratios). Along the page the ratios of the runs' paths
are smoothed with a Gaussian window weighed by path, both are normalised and fused by their
product's root, and a path is content if its mean fused value reaches ``LEVEL`` standard
deviations, or if no path with text outside the excluded parts has a higher one.

Paths are candidates first. Where a page says which element is its article (``article`` or that role), only runs inside are; where
a container's name says so ("post", "story" ...), runs inside, and outside those whose element is of a kind that content inside has. The threshold
is never above the best candidate path, so that a short article beside a longer notice is found.

Content paths then say what is taken. A run of such a path stays, and so does what belongs to it: all of an element
(the nearest container: div, section, table cell ...) of whose text at least half is of content
paths (of an ``article``'s a fifth), and of an element around such ones in which nothing else stands but headings and paragraphs;
so headings, lists and short paragraphs of the article stay, in as many containers as it has. Of
the body itself only headings, paragraphs and what stands between its content paths' runs are added.

Names exclude as well: navigation, headers, footers, asides, forms, scripts, adverts, notices, comments by
readers, told by tag, role, class or id, never stay; headings and paragraphs of an article are not judged by their names.

Pages of any form take time in proportion to their length: paths are numbers made of the parent's number and a label,
open elements are counted by name, sums go up the tree once, and a tag that does not end makes the
rest of its page be read without regard to quotes.

Defined cases: null or empty html gives an empty text; a page without text outside the excluded parts gives
an empty text; unclosed and stray tags are tolerated; a ``<`` that begins no tag is text; text
outside any tag counts as a block; rows may repeat; further columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlattice.llm.common import bounded_batches

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp svg math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag that ends an open one of these kinds.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
NEVER = frozenset("nav header footer aside form button select menu dialog head script style noscript template iframe svg textarea title object canvas label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids that exclude; they do where they end the name, or only parts that say nothing follow.
NEVER_NAMED = re.compile(r"ads?|advert\w*|adbox|adslot|banners?|breadcrumbs?|comments?|commentlist|respond|reply|replies|cookies?|consent|gdpr|disqus|footers?|header|masthead|menus?|menubar|modal|nav|navbar|navigation|newsletters?|notices?|notifications?|paywall|pagination|pager|popups?|promos?|promotions?|share|sharing|sidebars?|skip|social|sponsor|sponsored|subscribe|subscription|toolbars?|widgets?|signup|login")
NEUTRAL = frozenset("a area bar block body bottom box button buttons col column container content form group inner item items left line link links list main message outer overlay panel part row right section slot space thread top unit wrap wrapper".split())
OWN_HEADER = frozenset("article entry post story content".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
LEVEL, SHARE, SAID_SHARE = 1.25, 0.5, 0.2
#: Parts of class names and ids of an article's container.
NAMED = frozenset("article entry post story".split())
#: Elements that hold blocks of text, among them those of the whole page, and blocks that may stand beside an article's containers.
CONTAINERS = frozenset("div section article main body html td th center details fieldset".split()) | {""}
PAGE = frozenset(("", "html", "body"))
SAID = frozenset(("article",))
MILD = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figcaption hgroup".split())
#: Elements inside which an outer paragraph, item or cell is not ended by a start tag.
SCOPES = frozenset("table ul ol dl div article section td th button".split())

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_QUOTED_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"(?i)(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WRITTEN_APART = re.compile(r"(?i)(side|sign|log)[-_](bar|up|in)\b")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_SPACES = re.compile(r"\s+")


class _Node:
    """An open or closed element. at is its place in page order; scope tells the open elements that a start tag may end."""

    __slots__ = ("at", "tag", "parent", "out", "path", "scope", "article", "said", "named", "container", "block")

    def __init__(self, at: int, tag: str, parent: _Node | None, out: bool, path: int) -> None:
        self.at, self.tag, self.parent, self.out, self.path = at, tag, parent, out, path
        outer = {} if parent is None or tag in SCOPES else parent.scope
        self.scope = {**outer, tag: self} if tag in _ENDED else outer
        self.article = tag == "article" or (parent is not None and parent.article)
        self.said = tag in SAID or (parent is not None and parent.said)
        self.named = parent is not None and parent.named
        self.container = self if tag in CONTAINERS else parent.container
        self.block = self if tag in BLOCK or parent is None else parent.block


_ENDED = frozenset().union(*ENDS.values(), {"p"})


@functools.lru_cache(4096)
def _excluded(named: str) -> bool:
    """Whether one of these class names and ids tells a part that is never article text."""
    for name in named.split():
        parts = [x for x in (_DIGITS.sub("", y).lower() for y in _PARTS.split(_WRITTEN_APART.sub(r"\1\2", name))) if x]
        while len(parts) > 1 and parts[-1] in NEUTRAL and not NEVER_NAMED.fullmatch(parts[-1]):
            parts.pop()
        if parts and NEVER_NAMED.fullmatch(parts[-1]) and not (parts[-1] == "header" and OWN_HEADER & set(parts)):
            return True
    return False


class _Page:
    """A page's elements in order, and its text runs: (node, text, number of its block)."""

    def __init__(self, page: str) -> None:
        self.nodes = [_Node(0, "", None, False, 0)]
        self.runs: list[tuple[_Node, str, int]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _open(self, node: _Node, name: str, attributes: str) -> _Node:
        out, label, found = node.out, name, {}
        if attributes and not attributes.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            if "class" in found:
                label += "." + _DIGITS.sub("", found["class"])
            if name not in ("html", "body", "article", "main") and not (node.article and name in MILD):
                named = f"{found.get('class', '')} {found.get('id', '')}"
                out = out or (named != " " and _excluded(named)) or "hidden" in found or found.get("aria-hidden") == "true"
            out = out or found.get("role", "").lower() in ROLES
        out = out or (name in NEVER and not (name == "header" and node.article))  # an article's own heading stays
        if node.tag in PAGE and name in CONTAINERS:  # parts of the page are told apart even where they are named alike
            label += f"#{len(self.nodes)}"
        path = self.paths.setdefault((node.path, label), len(self.paths) + 1)
        opened = _Node(len(self.nodes), name, node, out, path)
        self.nodes.append(opened)
        opened.said = opened.said or found.get("role", "").lower() in SAID
        opened.named = opened.named or (name in CONTAINERS and any(NAMED & set(_PARTS.split(x.lower())) for k in ("class", "id") for x in found.get(k, "").split()))
        return opened

    def _read(self, page: str) -> None:
        root = node = self.nodes[0]
        opened: dict[str, int] = defaultdict(int)
        block, done, at, n, quotes = 0, 0, 0, len(page), True
        last = page.rfind(">")

        def close(upto: _Node) -> _Node:
            now = node
            while now is not upto:
                opened[now.tag] -= 1
                now = now.parent
            opened[upto.tag] -= 1
            return upto.parent

        while (at := page.find("<", at)) >= 0 and at < last:
            nxt = page[at + 1 : at + 2]
            if nxt in ("!", "?"):
                mark = "-->" if page.startswith("<!--", at) else ">"
                end = page.find(mark, at + 2)
                end = n if end < 0 else end + len(mark)
                name = None
            else:
                m = _NAME.match(page, at)
                if not m:
                    at += 1
                    continue
                e = _QUOTED_END.match(page, m.end()) if quotes else None
                if e is None:
                    quotes, end = False, page.find(">", m.end()) + 1
                    if not end:
                        break
                else:
                    end = e.end()
                name = m[1].lower()
            if at > done:
                self.runs.append((node, page[done:at], block))
            at = done = end
            if name is None:
                continue
            if name in BLOCK:
                block += 1
            if nxt == "/":  # an end tag closes up to its own start tag, if one is open
                if opened[name]:
                    up = node
                    while up.tag != name:
                        up = up.parent
                    node = close(up)
                continue
            if name in VOID:
                continue
            shut = ENDS.get(name, frozenset()) | ({"p"} if name in CLOSES_P else frozenset())
            while shut and (up := next((node.scope[t] for t in shut if t in node.scope), None)) is not None:
                node = close(up)
            attributes = page[m.end() : end - 1]
            if attributes.rstrip().endswith("/") and name in ("svg", "path"):
                continue
            if name in RAW:
                stop = _raw_end(name).search(page, end)
                at = done = stop.end() if stop else n
                continue
            node = self._open(node, name, attributes)
            opened[name] += 1
        if done < n:
            self.runs.append((node, page[done:], block))


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{re.escape(name)}\s*>")


def extract(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    read = _Page(page)
    runs = [(node, entities.unescape(text), block) for node, text, block in read.runs]
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    full = []
    for node, text, _ in runs:
        n = len(text.strip())
        if n:
            length[node.path] += n
            marks[node.path] += len(PUNCTUATION.findall(text))
            count[node.path] += 1
            full.append(node.path)
    stays = _selected(read.nodes, runs, lambda candidates: _content_paths(full, {p: length[p] / count[p] for p in count}, {p: marks[p] / count[p] for p in count}, candidates))
    out, now, current = [], [], None
    for (_, text, block), stay in zip(runs, stays, strict=True):
        if not stay:
            continue
        if block != current and now:
            out.append("".join(now))
            now = []
        current = block
        now.append(text)
    out.append("".join(now))
    return "\n".join(x for x in (_SPACES.sub(" ", b).strip() for b in out) if x)


def _selected(nodes: list[_Node], runs: list[tuple[_Node, str, int]], content_paths: Callable[[set[int]], set[int]]) -> list[bool]:
    """Whether each run stays: candidates by what the page says, content paths among them, and what belongs to these."""
    free = [(node, bool(text.strip())) for node, text, _ in runs if not node.out]
    said, named = ([node for node, full in free if full and getattr(node, kind)] for kind in ("said", "named"))
    candidates = said or named or [node for node, full in free if full]
    if not candidates:
        return [False] * len(runs)
    content = content_paths({node.path for node in candidates})
    kinds = {node.block.tag for node in named if node.path in content}
    able = [not node.out and (node.said if said else not named or node.named or node.block.tag in kinds) for node, _, _ in runs]
    return _staying(nodes, runs, content, able)


def _up(nodes: list[_Node], own: list[int]) -> list[int]:
    """Sums over whole elements; children come after their parents."""
    total = list(own)
    for node in reversed(nodes):
        if node.parent is not None:
            total[node.parent.at] += total[node.at]
    return total


def _inside(nodes: list[_Node], tops: set[int]) -> list[bool]:
    """Whether each node is one of tops or in one."""
    held = [False] * len(nodes)
    for node in nodes:
        held[node.at] = node.at in tops or (node.parent is not None and held[node.parent.at])
    return held


def _staying(nodes: list[_Node], runs: list[tuple[_Node, str, int]], content: set[int], able: list[bool]) -> list[bool]:
    """Whether each run stays: it is able to, and of a content path or belongs to runs that are."""
    size = [len(text.strip()) if a else 0 for (_, text, _), a in zip(runs, able, strict=True)]
    good = [n > 0 and node.path in content for (node, _, _), n in zip(runs, size, strict=True)]
    own, all_ = [0] * len(nodes), [0] * len(nodes)
    for (node, _, _), n, g in zip(runs, size, good, strict=True):
        all_[node.at] += n
        own[node.at] += n * g
    own, all_ = _up(nodes, own), _up(nodes, all_)
    mostly = lambda x: own[x.at] > 0 and own[x.at] >= SHARE * all_[x.at] and x.tag not in PAGE
    tops = {x.at for x in nodes if x.tag == "article" and own[x.at] > 0 and own[x.at] >= SAID_SHARE * all_[x.at]} | {x.at for (node, _, _), g in zip(runs, good, strict=True) if g and mostly(x := node.container)}
    # elements around them that hold no other text than headings and paragraphs of their own or of such elements
    held, other = _inside(nodes, tops), [0] * len(nodes)
    for (node, _, _), n in zip(runs, size, strict=True):
        if n and not held[node.at] and node.block.tag not in MILD:
            other[node.at] += n
    other = _up(nodes, other)
    held = _inside(nodes, tops | {x.at for x in nodes if not other[x.at] and mostly(x)})
    # blocks of content runs elsewhere; in the body itself, what stands between them and headings and paragraphs beside them
    blocks = {block for (_, _, block), g in zip(runs, good, strict=True) if g}
    loose = [i for i, ((node, _, _), g) in enumerate(zip(runs, good, strict=True)) if g and node.container.tag in PAGE]
    first, last = (loose[0], loose[-1]) if loose else (len(runs), -1)
    out = []
    for i, (node, _, block) in enumerate(runs):
        beside = bool(loose) and node.container.tag in PAGE and (node.block.tag in MILD or first <= i <= last)
        out.append(able[i] and (held[node.at] or block in blocks or beside))
    return out


def _content_paths(order: list[int], by_length: dict[int, float], by_marks: dict[int, float], free: set[int]) -> set[int]:
    """Paths whose smoothed and fused ratio is high; order is the page's runs, by path, free the paths with text outside the excluded parts."""
    paths, at = np.unique(np.array(order), return_inverse=True)
    n = len(at)

    def smooth(of: dict[int, float]) -> np.ndarray:
        v, total, weight = np.array([of[p] for p in paths.tolist()])[at], np.zeros(n), np.zeros(n)
        for d in range(-2, 3):
            i, j = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))  # each run, and the one d further on
            w = math.exp(-(d * d) / 2) * np.where(at[i] == at[j], 1.0, 0.25)
            total[i] += w * v[j]
            weight[i] += w
        out = total / weight
        return out / out.max() if out.max() > 0 else out

    fused = np.sqrt(smooth(by_length) * (smooth(by_marks) + 0.05))
    mean = np.bincount(at, weights=fused) / np.bincount(at)
    level = min(LEVEL * float(fused.std()), float(mean[np.isin(paths, list(free))].max()))
    return set(paths[mean >= level].tolist())


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html)."""
    bounded_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(extract, batch.column(2).to_pylist()), pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
