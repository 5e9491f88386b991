"""Main text of web pages by a maximum-scoring run of tokens.

A page is a sequence of words and tags.  Weights come from labelled pages: pages that mark their
article show, for each kind of element and each tag, how often it stands inside and outside of
the article.  The log odds are the scores: a word scores by the element around it, a tag never
above ``-TAG_COST``.  One linear scan finds the contiguous region with the best sum; words of the
region that score negative are left out of the text.  The article mark itself is a label only
and scores nothing, so pages without it are judged alike.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 4_000
KINDS = 20_000
#: Bounds of a word's score, and of a tag's.
LOW, HIGH = -0.5, 2.0
TAG_COST, TAG_LOW = 0.01, -0.5
#: Words that a kind is thought to have held inside and outside before any page is read.
CONTENT_PRIOR, FURNITURE_PRIOR = (3.0, 1.0), (1.0, 20.0)

_OPENING = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: A quote opens a value only after an equals sign.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_MARK = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.IGNORECASE)

#: Fixed by HTML: elements whose text is no text, and elements that do not end a block.
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select"})
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold both the article and the rest, and those that end an unclosed element.
NEUTRAL = frozenset("html body article main".split())
SECTIONS = frozenset("article main section header footer h1".split())
#: Elements and marks that are page furniture unless pages show otherwise.
FURNITURE = frozenset("nav footer aside form button menu dialog head header".split())
FURNITURE_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation navbox "
    "breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices alert popup modal newsletter "
    "subscribe share sharing social related comment comments reply replies respond disqus widget".split()
)
#: Words that only say where or how large: with one of the marks above they name furniture.
LAYOUT = frozenset(
    "site page main top bottom left right list box wrapper wrap container content bar area section block inner outer item items "
    "link links button buttons global primary secondary form the user post all".split()
)


class Token(NamedTuple):
    kind: str  # text, open or close
    value: str
    marks: list[str]


def _marks(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [w for m in _MARK.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()]


def tokens(page: str) -> Iterator[Token]:
    """Text and tags in order, in time linear in the page; raw elements and comments are skipped.

    A comment or raw element that never ends takes the rest of the page.  After a quote that
    swallows the last tag, tags end at the next ``>``; without one the rest is text.
    """
    at = seen = 0
    loose, closing = False, {}
    while opening := _OPENING.search(page, seen):
        begin = opening.start()
        mark = opening[0]
        if mark == "<!--":
            end = page.find("-->", begin + 2)
            after, found = (end + 3 if end >= 0 else len(page)), None
        elif mark in ("<!", "<?"):
            end = page.find(">", begin)
            if end < 0:
                break
            after, found = end + 1, None
        else:
            name = _NAME.match(page, opening.end() - 1)
            rest = None if loose else _REST.match(page, name.end())
            if rest is None:
                loose, end = True, page.find(">", begin)
                if end < 0:
                    break
                after, attributes = end + 1, page[name.end() : end]
            else:
                after, attributes = rest.end(), rest[1]
            value = name[0].lower()
            found = Token("close", value, []) if mark[1] == "/" else Token("open", value, _marks(attributes))
        if begin > at:
            yield Token("text", page[at:begin], [])
        at = seen = after
        if found is None:
            continue
        if found.kind == "open" and found.value in RAW:
            if found.value not in closing:
                closing[found.value] = re.compile(rf"</{found.value}(?=[\s/>])", re.IGNORECASE)
            close = closing[found.value].search(page, at)
            at = seen = page.find(">", close.end()) + 1 if close else 0
            if not at:
                return
        else:
            yield found
    if at < len(page):
        yield Token("text", page[at:], [])


def is_furniture(mark: str) -> bool:
    """``site-footer`` and ``comments`` are, ``social-history`` is not."""
    parts = set(re.split(r"[^a-z]+", mark)) - {""}
    return bool(parts & FURNITURE_MARKS) and parts <= FURNITURE_MARKS | LAYOUT


class Element(NamedTuple):
    name: str
    kind: str  # empty if neutral
    furniture: bool  # itself or around it
    unclosed: bool


def _ends(found: list[Token]) -> list[bool]:
    """For each token whether it opens an element that some tag closes as its own."""
    closed, stack, count = [False] * len(found), [], Counter()
    for i, t in enumerate(found):
        if t.kind == "open" and t.value not in VOID:
            stack.append((t.value, i))
            count[t.value] += 1
        elif t.kind == "close" and count[t.value]:
            while True:
                name, at = stack.pop()
                count[name] -= 1
                if name == t.value:
                    closed[at] = True
                    break
    return closed


def walk(found: list[Token]) -> Iterator[tuple[int, list[Element]]]:
    """Each token's place in the page, with the elements around it (after it, for a tag).

    Furniture that nothing closes ends where the next section begins.
    """
    closed, stack, count, doubtful = _ends(found), [], Counter(), 0

    def pop() -> Element:
        nonlocal doubtful
        last = stack.pop()
        count[last.name] -= 1
        doubtful -= last.unclosed
        return last

    for i, t in enumerate(found):
        if t.kind == "open" and t.value not in VOID:
            while doubtful and t.value in SECTIONS:
                pop()
            kind, bad = _kind(t, count)
            bad_here = bad or bool(stack and stack[-1].furniture)
            lost = bad and not closed[i]
            stack.append(Element(t.value, kind, bad_here, lost))
            count[t.value] += 1
            doubtful += lost
        elif t.kind == "close" and count[t.value]:
            while pop().name != t.value:
                pass
        yield i, stack


def _kind(tag: Token, around: Counter) -> tuple[str, bool]:
    """The kind of an element, and whether it is furniture by name or mark."""
    name = tag.value
    if name in NEUTRAL or name in INLINE and not tag.marks:
        return "", False
    if (name == "header" or "header" in tag.marks) and (around["article"] or around["main"] or around["section"]):
        return "heading", False
    bad = next((m for m in tag.marks if is_furniture(m)), None)
    kind = f"{name}.{bad or tag.marks[0]}" if tag.marks else name
    return kind, bad is not None or name in FURNITURE


def prior(kind: str) -> tuple[float, float]:
    name, _, mark = kind.partition(".")
    return FURNITURE_PRIOR if name in FURNITURE or is_furniture(mark) else CONTENT_PRIOR


class Weights:
    """Scores from counts ``(kind, inside, outside)``; the counts of a tag are those of ``<name``."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.counts = {k: (i, o) for k, i, o in counts}
        self.known: dict[str, float] = {}

    def _odds(self, key: str, before: tuple[float, float]) -> float:
        inside, outside = self.counts.get(key, (0, 0))
        return math.log((inside + before[0]) / (outside + before[1]))

    def word(self, kind: str) -> float:
        """The score of a word in an element of the kind."""
        if kind not in self.known:
            self.known[kind] = min(HIGH, max(LOW, self._odds(kind, prior(kind))))
        return self.known[kind]

    def tag(self, name: str) -> float:
        key = "<" + name
        if key not in self.known:
            self.known[key] = min(-TAG_COST, max(TAG_LOW, self._odds(key, (1.0, 1.0))))
        return self.known[key]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the greatest sum; empty if none is above zero."""
    best = total = 0.0
    begin, region = 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def scored(page: str, weights: Weights) -> tuple[list[float], list[str | None]]:
    """The score of each text and tag, and its text: None where a block ends."""
    found = list(tokens(page))
    scores: list[float] = []
    pieces: list[str | None] = []
    around = [CONTENT_PRIOR[0] / 4]  # the score of a word at each depth
    for i, stack in walk(found):
        # Elements were closed, or at most one was opened.
        del around[len(stack) + 1 :]
        t = found[i]
        if t.kind == "open" and t.value not in VOID:
            del around[len(stack) :]
            # In furniture, or around it, the worse counts; else what is nearest.
            own = weights.word(stack[-1].kind) if stack[-1].kind else around[-1]
            around.append(own if around[-1] >= 0 else min(own, around[-1]))
        if t.kind == "text":
            text = html.unescape(t.value)
            scores.append(around[-1] * len(text.split()))
            pieces.append(text if around[-1] >= 0 else "")
        else:
            scores.append(weights.tag(t.value))
            pieces.append("" if t.value in INLINE else None)
    return scores, pieces


def main_text(page: str, weights: Weights) -> str:
    """The best region's blocks, one to a line; empty if no run of tokens scores above zero."""
    scores, pieces = scored(page, weights)
    begin, end = best_region(scores)
    chosen = pieces[begin:end]
    cuts = [-1, *(i for i, p in enumerate(chosen) if p is None), len(chosen)]
    blocks = (" ".join("".join(chosen[a + 1 : b]).split()) for a, b in pairwise(cuts))
    return "\n".join(b for b in blocks if b)


def counted(page: str) -> tuple[Counter, Counter]:
    """Words by kind and tags by name, inside and outside of the marked article.

    Pages without one say nothing, nor do words of furniture inside it, nor elements that hold
    it.  Words within furniture count for the furniture, not for the plain elements in it.
    """
    found = list(tokens(page))
    inside, outside = Counter(), Counter()
    if not any(t.kind == "open" and t.value == "article" for t in found):
        return inside, outside
    held: list[list] = []  # words so far, holds an article, in an article
    names: list[Element] = []

    def close() -> None:
        words, wraps, within = held.pop()
        last = names.pop()
        plain = last.furniture and prior(last.kind) is CONTENT_PRIOR
        if last.kind and not wraps and not plain and not (within and last.furniture):
            (inside if within else outside)[last.kind] += words
        if held:
            held[-1][0] += 0 if within and last.furniture else words
            held[-1][1] |= wraps or (last.name == "article" and not last.furniture)

    for i, stack in walk(found):
        t = found[i]
        opened = t.kind == "open" and t.value not in VOID
        while len(held) > len(stack) - opened:
            close()
        within = bool(held) and (held[-1][2] or names[-1].name == "article" and not names[-1].furniture)
        if opened:
            held.append([0, False, within])
            names.append(stack[-1])
        if t.kind == "text":
            if held:
                held[-1][0] += len(t.value.split())
        elif t.value not in NEUTRAL and not (within and stack and stack[-1].furniture):
            (inside if within else outside)["<" + t.value] += 1
    while held:
        close()
    return inside, outside


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column("html").to_pylist():
            for total, part in zip((inside, outside), counted(page or ""), strict=True):
                total.update(part)
        kinds = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())],
            names=["kind", "inside", "outside"],
        )


def _extracted(counts: list[tuple[str, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = Weights(counts)
            texts = [main_text(p, weights) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def learned(pages: DataFrame) -> list[tuple[str, int, int]]:
    """``(kind, words inside, words outside)`` of the ``KINDS`` most frequent kinds and tags.

    They come from a hash-chosen sample of about ``TRAINING_PAGES`` rows of ``pages(html)``.
    """
    share = int(min(1.0, TRAINING_PAGES / max(1, pages.count())) * (1 << 20))
    sample = pages.where(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 20)) < share).select("html")
    counts = (
        sample.mapInArrow(_counted, "kind string, inside long, outside long")
        .groupBy("kind")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "kind")
        .limit(KINDS)
        .collect()
    )
    return [(r.kind, r.inside, r.outside) for r in counts]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages(page_id, url, html)``.

    Weights are learned from a bounded sample (``learned``); every page is read whole.  Null and
    empty html, and pages without words outside of page furniture, have empty text.  Without
    marked pages the weights are those of ``prior``.  Repeated rows get equal texts; equal best
    regions go to the first; other columns are not read.
    """
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    counts = learned(pages)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(_extracted(counts), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
