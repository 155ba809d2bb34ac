"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags from the root to
it. Lengths and punctuation marks are summed for each path and divided by its
number of blocks, both ratios are smoothed over the page's blocks in order and
fused with the plain ones to one score, and paths that reach a share of the
scores' spread and mean are content paths. Their blocks choose the container:
the article elements that hold them, or else the main elements, where at least
half of the content text is inside, and otherwise the lowest sectioning element
over all of them.

Elements that aren't part of an article by their kind (navigation, page
headers, footers, asides, forms, scripts, styles), by their role, or by a class
or id that says nothing else (`ad`, `cookie-notice`, `comment-list`) count in no
ratio. Where a class or id has a word that may mean either (`social`, `legal`,
`share`), the scores decide: the element goes if none of its blocks is on a
content path. What lies in the container otherwise is kept whole, however
short: lists, quotes, tables, preformatted text.

Time and memory are in proportion to the page: paths are interned as (path of
the parent, tag), and open elements are found by tag, not by walking up.

Defined cases: a null or empty page has an empty text, and so has a page
without content; broken markup is read as browsers do in the plain cases (an
open p ends where a block starts, unmatched end tags are ignored, a comment or
script without end runs to the end of the page); repeated rows give equal
rows; an empty table gives an empty table; other columns aren't kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from math import exp, inf

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>
    |<(/?)([a-zA-Z][^\s/>]*)([^>]*)>
    |<[!?][^>]*>""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡\"'()«»„“”–—-]")
_BLANK = re.compile(r"[ \t\n\v\f\r]+")

# The names of HTML elements by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key is closed by a start of one of these.
CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option", "optgroup"}),
}
#: The same by the element that starts.
CLOSES = {tag: [kind for kind, starts in CLOSED_BY.items() if tag in starts] for tag in sorted(frozenset().union(*CLOSED_BY.values()))}
#: Elements that hold the scope of implied ends.
SCOPES = frozenset("ul ol dl table select menu article section aside nav div body main form".split())
NOISE_TAGS = frozenset("aside button canvas dialog footer form head iframe menu nav object search select svg video audio".split())
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names that say noise alone or together, names that may say it, and names
#: that say nothing beside them.
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted sidebar "
    "signup sponsor sponsored subscribe toolbar topbar widget".split()
)
DOUBTFUL_WORDS = frozenset(
    "alert copyright disclaimer discussion legal login notification promotion recommended related replies reply search share sharing skip social".split()
)
PLAIN_WORDS = frozenset(
    "area bar block bottom box button buttons container content form global group header inner item items left link links list main media message "
    "outer page panel post posts right row section site slot text thread to top unit wrap wrapper".split()
)
#: Elements that can be the container of a page without article and main, and
#: those of them that are no container if they are a block of text themselves.
CONTAINERS = frozenset("body center div html section td th".split()) | {""}
CELLS = frozenset({"td", "th"})
#: Standard deviation of the smoothing kernel, in blocks, and the shares of the
#: scores' spread and mean that a content path reaches.
SIGMA = 1.0
SPREAD_SHARE = 0.5
MEAN_SHARE = 0.33
_KERNEL = [exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-2, 3)]


class Element:
    """`article` and `main` are the outermost ones around it, `doubtful` the
    innermost element around it whose name may say noise; `first` and `last`
    number the elements from it to the end of its subtree in page order."""

    __slots__ = ("tag", "parent", "noise", "path", "depth", "article", "main", "doubtful", "first", "last")


def _named(value: str, one: bool) -> bool | None:
    """Whether the names in a class (or the one of an id) say noise; None if they may."""
    found: bool | None = False
    for name in [value] if one else value.split():
        words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
        if not words or not all(w in NOISE_WORDS or w in DOUBTFUL_WORDS or w in PLAIN_WORDS for w in words):
            continue
        if not NOISE_WORDS.isdisjoint(words) or sum(w in DOUBTFUL_WORDS for w in words) > 1:
            return True
        if not DOUBTFUL_WORDS.isdisjoint(words):
            found = None
    return found


def _is_noise(tag: str, attributes: str, parent: Element) -> bool | None:
    """Whether the element is noise; None where scores are to decide."""
    if parent.noise or tag in NOISE_TAGS:
        return True
    if tag == "header" and parent.article is None and parent.main is None:
        return True
    found: bool | None = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            named = _named(value, name == "id")
            if tag in ("html", "body", "article", "main") and "comment" not in value.lower():
                continue
            if named:
                return True
            found = None if named is None else found
        elif name == "role" and value.lower() in NOISE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
    return found


class Tree:
    """The open elements of a page, found by tag and by scope."""

    def __init__(self):
        self.open: list[Element] = []
        self.of_tag: dict[str, list[int]] = {}
        self.scopes, self.paths, self.count = [-1], {}, 0
        self.push("", "")

    @property
    def at(self) -> Element:
        return self.open[-1]

    def push(self, tag: str, attributes: str) -> None:
        e, parent = Element(), self.open[-1] if self.open else None
        noise = _is_noise(tag, attributes, parent) if parent else False
        e.tag, e.parent, e.noise, e.depth, e.first, e.last = tag, parent, bool(noise), len(self.open), self.count, None
        e.path = self.paths.setdefault((parent.path if parent else -1, tag), len(self.paths))
        e.article = parent and parent.article or (e if tag == "article" else None)
        e.main = parent and parent.main or (e if tag == "main" else None)
        e.doubtful = e if noise is None else parent and parent.doubtful
        self.count += 1
        self.of_tag.setdefault(tag, []).append(e.depth)
        if tag in SCOPES:
            self.scopes.append(e.depth)
        self.open.append(e)

    def innermost(self, tag: str, least: int) -> int | None:
        """Depth of the innermost open element of a tag, if it is `least` or more."""
        found = self.of_tag.get(tag)
        return found[-1] if found and found[-1] >= least else None

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            e = self.open.pop()
            e.last = self.count - 1
            self.of_tag[e.tag].pop()
            if e.tag in SCOPES:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        least = self.scopes[-1] if tag not in SCOPES and (tag in BLOCKS or tag in CLOSED_BY) else 1
        depth = self.innermost(tag, least)
        if depth:
            self.close(depth)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            depth = self.innermost("p", self.scopes[-1] + 1)
            if depth:
                self.close(depth)
        for kind in CLOSES.get(tag, ()):
            while depth := self.innermost(kind, self.scopes[-1] + 1):
                self.close(depth)
        if tag not in VOID:
            self.push(tag, attributes.removesuffix("/"))


def text_blocks_of(page: str) -> list[tuple[Element, str]]:
    """Blocks of text that no noise element holds, in page order."""
    tree = Tree()
    found, held, block = [], [], tree.at

    def flush():
        if held:
            text = _BLANK.sub(" ", "".join(held)).strip(" ")
            held.clear()
            if text:
                found.append((block, text))

    end = 0
    for m in _TAG.finditer(page):
        if m.start() > end and not tree.at.noise:
            held.append(html.unescape(page[end : m.start()]))
        end = m.end()
        closing, tag, attributes = m.group(2, 3, 4) if m.group(3) else m.group(5, 6, 7)
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if tag == "br":
            held.append(" ")
        if closing:
            tree.end(tag)
        else:
            tree.start(tag, attributes)
        if tag in BLOCKS:
            block = tree.at
    if end < len(page) and not tree.at.noise:
        held.append(html.unescape(page[end:]))
    flush()
    tree.close(0)
    return found


def _smooth(values: list[float]) -> list[float]:
    out, n = [], len(values)
    for i in range(n):
        low, high = max(0, i - 2), min(n, i + 3)
        weights = _KERNEL[low - i + 2 : high - i + 2]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def content_paths(blocks: list[tuple[Element, str]]) -> set[int]:
    sums: dict[int, list[int]] = {}
    for e, text in blocks:
        own = sums.setdefault(e.path, [0, 0, 0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(_PUNCTUATION.findall(text))
    length = [sums[e.path][1] / sums[e.path][0] for e, _ in blocks]
    marks = [sums[e.path][2] / sums[e.path][0] for e, _ in blocks]
    plain = [a * (1 + b) for a, b in zip(length, marks)]
    smooth = [a * (1 + b) for a, b in zip(_smooth(length), _smooth(marks))]
    scores = [(a * b) ** 0.5 for a, b in zip(plain, smooth)]
    mean = sum(scores) / len(scores)
    spread = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
    best: dict[int, float] = {}
    for (e, _), s in zip(blocks, scores):
        best[e.path] = max(s, best.get(e.path, 0.0))
    least = min(max(SPREAD_SHARE * spread, MEAN_SHARE * mean), max(best.values()))
    return {p for p, s in best.items() if s >= least}


def content_containers(content: list[tuple[Element, str]]) -> list[Element]:
    """The elements that are kept whole, given the blocks of content paths."""
    total = sum(len(text) for _, text in content)
    for kind in ("article", "main"):
        inside = [(getattr(e, kind), len(text)) for e, text in content if getattr(e, kind)]
        if inside and 2 * sum(n for _, n in inside) >= total:
            return list(dict.fromkeys(e for e, _ in inside))
    blocks = {e for e, _ in content}
    # The lowest element over the first and the last in page order is over all.
    low, high = min(blocks, key=lambda e: e.first), max(blocks, key=lambda e: e.first)
    while low.last < high.first or low.tag not in CONTAINERS or low.tag in CELLS and low in blocks:
        low = low.parent
    return [low]


def main_text(page: str | None) -> str:
    blocks = text_blocks_of(page or "")
    if not blocks:
        return ""
    paths = content_paths(blocks)
    content = [(e, text) for e, text in blocks if e.path in paths]
    holders = content_containers(content)
    spared: set[Element] = set()
    for e, _ in content:
        at = e.doubtful
        while at is not None and at not in spared:
            spared.add(at)
            at = at.parent.doubtful
    starts = sorted((e.first, e.last) for e in holders)
    out = []
    for e, text in blocks:
        k = bisect_right(starts, (e.first, inf)) - 1  # holders don't overlap
        if k >= 0 and e.first <= starts[k][1] and (e.doubtful is None or e.doubtful in spared):
            out.append(text)
    return "\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
