"""Main text of web pages by tag-path ratios.

Every text block (what stands between block-level tags) has a path of tags and
first classes from the root.  Per path, text length and punctuation are
aggregated over its blocks; both ratios are smoothed along the page and fused by
multiplication, and paths that reach a share of the page's peak are content.

Class, role and id words that name another page part (advert, comments, ...) are
a prior, not a filter: a path below such an element counts as a path of its own,
its score is divided by `AGAINST`, and it sets no peak.  Ids count as a whole, and
not on headings: they are often made from the heading's words.

The article is where the content paths lie: the outermost article or main element
that holds more than half of their text, or else the deepest container that holds
all of it.  It decides ties: paths that lie wholly outside it count half, and a
shorter block inside it (headline, lead, a one-word paragraph) is smoothed with the
mean score of the article's content, so that only the prior can keep it out.  Where
no such element is found, a short block has to stand between two content blocks of
its own container, or be a heading before one.  The text is all blocks whose paths
pass then.

Elements that never hold article text by definition (nav, footer, script, ...), and
hidden ones, are no blocks at all; forms are not, unless they wrap the page, that is,
hold more than half of its text.  Character references are decoded once, white space
inside a block becomes one space, blocks are joined by one line end, nothing is
cut by length.

Defined results: null and empty pages, and pages without a content block, give
an empty text; unclosed tags end where their parents do, a block tag closes an
open paragraph, stray end tags are ignored; repeated pages give equal texts, row
by row; very long and very deep pages are read whole.  The input's columns named
text and n_chars are replaced, all others are kept as they are.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import map_texts

# Element names of the HTML standard by their role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split(),
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(),
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select html body article section div".split())
NOT_ARTICLE = frozenset(
    "head script style noscript template textarea title iframe object svg canvas nav header footer aside button select option input label dialog menu".split(),
)
NOT_ARTICLE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu nav navbar navigation newsletter notice notices pagination popup promo promotion related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split(),
)
CONTAINERS = frozenset("html body article center div main section table".split())
ARTICLE_NAMES = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MODIFIERS = frozenset("has no with without".split())
AGAINST, OUTSIDE = 16.0, 2.0

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Block:
    """A block's text, the path of its tags, the containers, articles and forms (by number) that hold it, whether names speak against it and whether it is a heading."""

    __slots__ = ("path", "holders", "articles", "forms", "text", "against", "heading")

    def __init__(self, path: str, holders: tuple[int, ...], articles: tuple[int, ...], forms: tuple[int, ...], text: str, against: bool, heading: bool) -> None:
        self.path, self.holders, self.articles, self.forms, self.text, self.against, self.heading = path, holders, articles, forms, text, against, heading


def hidden(attributes: str) -> bool:
    """Whether an element with these attributes is not shown."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value)):
            return True
    return False


def named(attributes: str) -> tuple[str, set[str], set[str], set[str]]:
    """The first class, all words of class and role, whole ids, and words of ids."""
    first, words, ids, id_words = "", set(), set(), set()
    for m in NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "class" and value.split():
            first = value.split()[0]
        for name in value.split():
            parts = re.split(r"[_-]+", name)
            own = id_words if m[1].lower() == "id" else words
            own.update(parts if parts[0] not in MODIFIERS else ())  # with-sidebar names the page, not the bar
            if own is id_words:
                ids.add(name)
    return first, words, ids, id_words


def blocks(page: str) -> list[Block]:
    """The page's text blocks outside elements that hold no article text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, bool, bool, bool, bool]] = []  # tag, path, number, excluded, within an article, an article element, named
    parts: list[str] = []
    number = at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text and not (stack and stack[-1][3]):
            own = [s for s in stack if s[0] not in INLINE]
            against = bool(stack) and stack[-1][6]
            path = (own[-1][1] if own else "") + ("!" if against else "")
            forms = tuple(s[2] for s in own if s[0] == "form")
            out.append(Block(path, tuple(s[2] for s in own if s[0] in CONTAINERS), tuple(s[2] for s in own if s[5]), forms, text, against, bool(own) and own[-1][0] in HEADINGS))

    def close(upto: int) -> None:
        if any(s[0] not in INLINE for s in stack[upto:]) or (stack and (stack[-1][3] or stack[-1][6])):
            flush()
        del stack[upto:]

    while True:
        m = MARKUP.search(page, at)
        parts.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in VOID:
            if tag in INLINE:
                parts.append(" " if tag == "br" else "")
            else:
                flush()
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in SIBLINGS.get(tag, ()):
                close(i)
                break
            if stack[i][0] in SCOPES:
                break
        first, words, ids, id_words = named(m[3])
        names = words if tag in HEADINGS else words | ids
        above = stack[-1] if stack else ("", "", 0, False, False, False, False)
        article = tag in ARTICLE_NAMES or "main" in words | id_words
        excluded = above[3] or (tag in NOT_ARTICLE and not (tag == "header" and above[4])) or hidden(m[3])
        against = NOT_ARTICLE_NAMES - ({"header"} if above[4] else set())
        against = above[6] or (bool(names & against) and not article_root(tag))
        if tag not in INLINE or excluded and not above[3] or against and not above[6]:
            flush()
        number += 1
        path = above[1] if tag in INLINE else f"{above[1]}/{tag}.{first}"
        if m[3].endswith("/"):
            continue
        held = article and not excluded and not against
        stack.append((tag, path, number, excluded, above[4] or held, held and tag not in INLINE and not article_root(tag), against))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            parts.clear()
            at = end.start() if end else len(page)
    flush()
    return out


def article_root(tag: str) -> bool:
    """Whether names on this element may not exclude it: they would drop the page."""
    return tag in ("html", "body")


def smoothed(values: list[float]) -> list[float]:
    """Weights 1, 2, 1 over neighbours along the page."""
    out = []
    for i, v in enumerate(values):
        near = [(2.0, v)] + [(1.0, values[j]) for j in (i - 1, i + 1) if 0 <= j < len(values)]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return out


def path_scores(found: list[Block]) -> dict[str, float]:
    """Smoothed and fused ratios of every path, prior included."""
    total: dict[str, list[float]] = {}
    for b in found:
        sums = total.setdefault(b.path, [0, 0.0, 0.0])
        sums[0] += 1
        sums[1] += len(b.text)
        sums[2] += len(PUNCTUATION.findall(b.text))
    length = smoothed([total[b.path][1] / total[b.path][0] for b in found])
    marks = smoothed([total[b.path][2] / total[b.path][0] for b in found])
    fused: dict[str, float] = {}
    for b, a, c in zip(found, length, marks, strict=True):
        score = math.sqrt(a * (1 + c)) * math.log1p(total[b.path][1]) / (AGAINST if b.against else 1.0)
        fused[b.path] = max(fused.get(b.path, 0.0), score)
    return fused


def content_paths(found: list[Block], fused: dict[str, float], share: float) -> set[str]:
    """Paths that reach a share of the best score of a path no name speaks against."""
    peak = max((fused[b.path] for b in found if not b.against), default=math.inf)
    return {p for p, s in fused.items() if s >= share * peak}


def article_of(found: list[Block], content: list[Block]) -> list[Block]:
    """The blocks of the outermost article that holds more than half of the content's text, or else of the deepest container that holds all."""
    weight: dict[int, int] = {}
    for b in content:
        for number in b.articles:
            weight[number] = weight.get(number, 0) + len(b.text)
    half = sum(len(b.text) for b in content) / 2
    articles = [number for number, n in weight.items() if n > half]
    if articles:
        root = min(articles)  # numbers rise with depth
        return [b for b in found if root in b.articles]
    holders = set.intersection(*(set(b.holders) for b in content))
    return [b for b in found if max(holders) in b.holders] if holders else found


def outside_forms(found: list[Block]) -> list[Block]:
    """Blocks in no form, or only in forms that wrap the page."""
    weight: dict[int, int] = {}
    for b in found:
        for number in b.forms:
            weight[number] = weight.get(number, 0) + len(b.text)
    half = sum(len(b.text) for b in found) / 2
    return [b for b in found if all(weight[number] > half for number in b.forms)]


def among(found: list[Block], content: list[Block]) -> list[Block]:
    """Blocks between two of content in one container, and headings before one."""
    is_content = set(map(id, content))
    inner = [b.holders[-1] if b.holders else 0 for b in found]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if id(b) in is_content:
            for number in (0, *b.holders):
                last[number] = i
    out, begun = [], set()
    for i, b in enumerate(found):
        if last.get(inner[i], -1) > i and (b.heading or inner[i] in begun):
            out.append(b)
        if id(b) in is_content:
            begun.update((0, *b.holders))
    return out


def main_text(page: str | None, share: float = 0.5) -> str:
    """The text of the article's blocks whose path is content by itself or smoothed with the article's mean."""
    found = outside_forms(blocks(page or ""))
    fused = path_scores(found)
    paths = content_paths(found, fused, share)
    content = [b for b in found if b.path in paths]
    if not content:
        return ""
    inside = article_of(found, content)
    own = {b.path for b in inside}
    held = set(map(id, inside if any(b.articles for b in inside) else among(found, content)))
    fused = {p: s if p in own else s / OUTSIDE for p, s in fused.items()}
    paths = content_paths(found, fused, share)
    mean = sum(fused[b.path] for b in content) / len(content)
    peak = max((fused[p] for p in paths), default=0.0)
    return "\n".join(b.text for b in found if b.path in paths or (id(b) in held and mean / (AGAINST if b.against else 1.0) >= share * peak))


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of pages (default: all but the page) with text and n_chars (code points)."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (page, "text", "n_chars")]

    def prepare():
        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            out = [main_text(t) for t in texts.to_pylist()]
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return make

    return map_texts(pages, page, keep, "text string, n_chars long", prepare)
