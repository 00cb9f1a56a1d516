"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags
negative, with weights learned on pages that label their own main text (one
``article`` or ``main`` element).  The labels serve to learn alone: the scan
sees these two as any container.  One linear scan finds the contiguous stretch
with the highest sum.

A word scores the share of main text among the words of labelled pages that
stand right in such an element.  Tags are learned by a margin: a page whose
best stretch is not its labelled one lowers the tags that only the wrong
stretch has.  Every page is seen once as it is and once without classes, so
that names alone have weights of use on pages with classes never seen.

Boilerplate also stands inside the stretch.  Its elements are told by the
words that labelled pages keep beside their main text: an element whose name
and classes hold mostly such words is cut out, and in the scan counts as one
weak tag, as it may stand amid an article.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About as many pages are drawn, by hash, to learn weights; longer ones than so many characters are not used for it.
TRAIN_PAGES, TRAIN_CHARS = 4000, 1 << 16
#: Rounds over these pages; by what share a word scores more (beside main texts) or less while learning; weights of tags before learning and at most.
ROUNDS, MARGIN, FIRST, HIGHEST = 12, 0.3, -0.1, -0.05
#: What a step of learning changes, and the first weight of elements that HTML defines as being beside the content.
STEP, BESIDE = 1.0, -4.0
#: Score of an element that is cut out.
CUT = -0.5
#: Words that each element is taken to have had in main texts besides those counted, and the least score of a word.
PRIOR, LEAST_WORD = 20, 0.02

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPENING = re.compile(r"</?[A-Za-z][^\s/>]*+")
_DELIMITER = re.compile(r"[>\"']")
_CLASS = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[^\W\d_]+|[0-9]+")

# Facts of HTML, not of pages: elements without text of the page, without an end tag, beside the content, and blocks.
RAW = frozenset("script style noscript template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form button select iframe object svg canvas dialog menu audio video map fieldset".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption option".split()
)
#: Elements that an end tag of another name, or none, may close.
_LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot colgroup rt rp optgroup".split())


@dataclass(slots=True)
class Token:
    """A stretch of text (``name`` empty) or a tag: its name, the parts of its class, id and role, and the token at which its element ends."""

    name: str
    text: str
    classes: tuple[str, ...] = ()
    end: int = -1
    closing: bool = False


class _Ends:
    """Where a tag that begins in a page would end, known for all places after one pass from the right.

    From a place outside quotes a tag runs to the next ``>``, or from a quote
    over its next like and on; what is never closed is no tag.  So the answer
    hangs on the next delimiter alone, and no tag is looked for twice.
    """

    def __init__(self, page: str):
        self.at = [m.start() for m in _DELIMITER.finditer(page)]
        self.closed = [False] * (len(self.at) + 1)
        following: dict[str, int] = {}
        for k in range(len(self.at) - 1, -1, -1):
            c = page[self.at[k]]
            if c == ">":
                self.closed[k] = True
            else:
                self.closed[k] = c in following and self.closed[following[c] + 1]
                following[c] = k

    def after(self, place: int) -> bool:
        return self.closed[bisect.bisect_left(self.at, place)]


def tokens(page: str) -> list[Token]:
    """Text and tags in page order; content of ``RAW`` elements and comments is markup and left out.

    An end tag closes the innermost open element of its name and all within;
    what is never closed ends with the element around it, or with the page.  A
    ``<`` that begins no tag, comment or declaration with an end is text.  The
    time is linear in the page, however it is broken.
    """
    out: list[Token] = []
    open_at: list[int] = []
    many: Counter = Counter()  # open elements by name
    at, final = 0, page.rfind(">")
    ends: _Ends | None = None  # made where a tag without an end is met
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = end if end >= 0 else len(page)
            out.append(Token("", page[at:end]))
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = None
        if at < final:
            if page[at + 1] in "!?":
                at = page.find(">", at) + 1
                continue
            if ends is None or ((o := _OPENING.match(page, at)) is not None and ends.after(o.end())):
                m = _TAG.match(page, at)
                if m is None and ends is None and _OPENING.match(page, at):
                    ends = _Ends(page)
        if m is None:
            out.append(Token("", "<"))
            at += 1
            continue
        at = m.end()
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if closing:
            if many[name]:
                while open_at:
                    k = open_at.pop()
                    many[out[k].name] -= 1
                    out[k].end = len(out)
                    if out[k].name == name:
                        break
            out.append(Token(name, "", closing=True))
            continue
        classes: tuple[str, ...] = ()
        if "=" in m[3]:
            told = " ".join("".join(c.groups("")) for c in _CLASS.finditer(m[3])).lower()
            classes = tuple(sorted({"#" if part.isdigit() else part for part in _PART.findall(told)}))
        k = len(out)
        out.append(Token(name, "", classes))
        if name in VOID or m[3].endswith("/"):
            out[k].end = k
        else:
            if name in _LOOSE and open_at and out[open_at[-1]].name == name:
                last = open_at.pop()
                many[name] -= 1
                out[last].end = k
            open_at.append(k)
            many[name] += 1
    for k in open_at:
        out[k].end = len(out)
    return out


def _plain(name: str) -> str:
    return "div" if name in MAIN else name


def features(token: Token, classes: bool = True) -> list[str]:
    """What a tag is scored by: its name, and each of its classes; end tags are apart from start tags."""
    name = _plain(token.name)
    if token.closing:
        return ["/" + name]
    return [name, *(f".{c}" for c in token.classes)] if classes else [name]


def words(text: str) -> int:
    return len(html.unescape(text).split()) if "&" in text else len(text.split())


def labelled(found: list[Token]) -> tuple[int, int] | None:
    """First token after, and the token at the end of, the only main element; None without exactly one."""
    mains = [k for k, t in enumerate(found) if t.name in MAIN and not t.closing]
    return (mains[0] + 1, found[mains[0]].end) if len(mains) == 1 else None


@dataclass
class Weights:
    """Scores of tags by feature, and words of labelled pages by the element that holds them.

    ``right`` has [in main texts, beside them] for the elements that words
    stand right in; ``inside`` and ``outside`` are for whole elements: any
    within a main text, and the outermost beside one.
    """

    tag: dict[str, float] = field(default_factory=dict)
    right: dict[str, list[int]] = field(default_factory=dict)
    inside: dict[str, int] = field(default_factory=dict)
    outside: dict[str, int] = field(default_factory=dict)

    def first(self, feature: str) -> float:
        return BESIDE if feature.lstrip("/") in ASIDE else FIRST if "." not in feature else 0.0

    def score(self, tag: list[str]) -> float:
        return min(HIGHEST, sum(self.tag.get(f, self.first(f)) for f in tag))

    def word(self, holder: list[str]) -> float:
        """Score of a word that stands right in an element with these features."""
        seen = [self.right[f] for f in holder[1:] if f in self.right] or [self.right.get(f, (0, 0)) for f in holder[:1]]
        yes, no = sum(x[0] for x in seen), sum(x[1] for x in seen)
        return max(LEAST_WORD, (yes + PRIOR) / (yes + no + PRIOR))

    def boilerplate(self, token: Token) -> bool:
        """Whether labelled pages have the words of such elements beside their main text, or HTML defines it as beside the content."""
        if token.name in ASIDE:
            return True
        told = told_by(token)
        told = [f for f in told if f in self.inside or f in self.outside] or told[:1]
        return all(self.outside.get(f, 0) > self.inside.get(f, 0) for f in told)


def told_by(token: Token) -> list[str]:
    """What an element is told by: its classes, or its name where it has none."""
    return features(token)[1:] or features(token)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the stretch with the highest sum, the first of equal ones; (0, 0) if none is positive."""
    best, best_lo, best_hi, run, lo = 0.0, 0, 0, 0.0, 0
    for k, score in enumerate(scores):
        if run <= 0:
            run, lo = 0.0, k
        run += score
        if run > best:
            best, best_lo, best_hi = run, lo, k + 1
    return best_lo, best_hi


def holders(found: list[Token], classes: bool = True) -> list[list[str]]:
    """For each text the features of the innermost element that it stands in; for a tag nothing."""
    out: list[list[str]] = []
    stack: list[int] = []
    for k, token in enumerate(found):
        while stack and found[stack[-1]].end <= k:
            stack.pop()
        if not token.name:
            out.append(features(found[stack[-1]], classes) if stack else [])
        else:
            out.append([])
            if not token.closing and token.end > k:
                stack.append(k)
    return out


@dataclass
class Lesson:
    """A labelled page: words of each token (0: a tag), what tags and the elements that texts stand in are told by (numbers), and the stretch from the first word to the last."""

    words: np.ndarray
    told: np.ndarray
    lo: int
    hi: int


def lessons(page: str, names: dict[tuple[str, ...], int]) -> list[Lesson]:
    """The page as it is and without classes, if it labels a main text with words; ``names`` numbers what tokens are told by."""
    found = tokens(page)
    span = labelled(found)
    if span is None:
        return []
    size = np.array([0 if t.name else words(t.text) for t in found])
    own = np.zeros(len(found), bool)
    own[span[0] : span[1]] = True
    for k in range(*span):
        if found[k].name in ASIDE and not found[k].closing:
            own[k : found[k].end] = False
    held = np.flatnonzero(own & (size > 0))
    if not len(held):
        return []
    out = []
    for classes in (True, False):
        told = [features(t, classes) if t.name else h if n else () for t, h, n in zip(found, holders(found, classes), size, strict=True)]
        out.append(Lesson(size, np.array([names.setdefault(tuple(x), len(names)) for x in told]), int(held[0]), int(held[-1]) + 1))
    return out


def learn(pages: list[Lesson], names: dict[tuple[str, ...], int], weights: Weights) -> None:
    """Count words by the elements that hold them; then lower tags that only wrong stretches hold, and raise those that only right ones hold, until none is wrong."""
    feature = list(names)
    right, beside = np.zeros(len(names)), np.zeros(len(names))
    for lesson in pages:
        inner = slice(lesson.lo, lesson.hi)
        mine = np.bincount(lesson.told[inner], lesson.words[inner], len(names))
        right += mine
        beside += np.bincount(lesson.told, lesson.words, len(names)) - mine
    for k in np.flatnonzero(right + beside):
        for f in feature[k]:
            seen = weights.right.setdefault(f, [0, 0])
            seen[0] += int(right[k])
            seen[1] += int(beside[k])
    # scores of words are fixed now; only tags change from round to round
    word = np.array([weights.word(list(x)) for x in feature])
    texts = []
    for lesson in pages:
        factor = np.full(len(lesson.words), 1 + MARGIN)
        factor[lesson.lo : lesson.hi] = 1 - MARGIN
        texts.append(lesson.words * word[lesson.told] * factor)
    score = np.array([weights.score(list(x)) if x else 0.0 for x in feature])
    uses: dict[str, list[int]] = {}
    for k, x in enumerate(feature):
        for f in x:
            uses.setdefault(f, []).append(k)
    for _ in range(ROUNDS):
        wrong = 0
        for lesson, text in zip(pages, texts, strict=True):
            tags = lesson.words == 0
            run = np.concatenate(([0.0], np.cumsum(np.where(tags, score[lesson.told], text))))
            hi = int((run - np.minimum.accumulate(run)).argmax())
            lo = int(run[: hi + 1].argmin())
            held = np.flatnonzero(lesson.words[lo:hi]) + lo
            if len(held) and (held[0], held[-1] + 1) == (lesson.lo, lesson.hi):
                continue
            wrong += 1
            change: Counter = Counter()
            for a, b, sign in ((lo, hi, -1), (lesson.lo, lesson.hi, 1)):
                for k, n in zip(*np.unique(lesson.told[a:b][tags[a:b]], return_counts=True), strict=True):
                    for f in feature[k]:
                        change[f] += sign * int(n)
            # a step is shared among the tags that differ, by how often
            step = STEP * min(1.0, 8 / max(1, sum(abs(n) for n in change.values())))
            for f, n in change.items():
                weights.tag[f] = min(0.0, weights.tag.get(f, weights.first(f)) + step * n)
            for k in {k for f, n in change.items() if n for k in uses[f]}:
                score[k] = weights.score(list(feature[k]))
        if not wrong:
            break


def count_page(page: str) -> tuple[Counter, Counter]:
    """Words by feature of the elements that hold them: every element within the main one, and the outermost one beside it.

    The outermost element is what a page sets apart; that a menu has list items
    says nothing of list items.
    """
    inside: Counter = Counter()
    outside: Counter = Counter()
    found = tokens(page)
    span = labelled(found)
    if span is None:
        return inside, outside
    stack: list[int] = []
    for k, token in enumerate(found):
        while stack and found[stack[-1]].end <= k:
            stack.pop()
        if token.name:
            if not token.closing and token.end > k:
                stack.append(k)
            continue
        n = words(token.text)
        if not n:
            continue
        if span[0] <= k < span[1]:
            within = [x for x in stack if x >= span[0]]
            if any(found[x].name in ASIDE for x in within):
                continue
            for x in within:
                for f in told_by(found[x]):
                    inside[f] += n
        else:
            outer = next((x for x in stack if found[x].name not in ("html", "body") and not found[x].end >= span[1] > x), None)
            if outer is not None:
                for f in told_by(found[outer]):
                    outside[f] += n
    return inside, outside


def fit(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from about ``train_pages`` pages of up to ``TRAIN_CHARS`` characters, drawn by hash."""
    rows = pages.count()
    share = min(1.0, train_pages / max(1, rows))
    drawn = pages.select(F.col(html_col).alias("html")).where(F.length("html") <= TRAIN_CHARS)
    drawn = drawn.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["html"])
    return fit_pages(row["html"] for row in drawn.orderBy(F.xxhash64("html"), "html").toLocalIterator())


def fit_pages(pages: Iterable[str]) -> Weights:
    """Weights from these pages; they are read in turn, and what is kept of one is a few bytes for each of its tokens."""
    weights = Weights()
    names: dict[tuple[str, ...], int] = {}
    examples: list[Lesson] = []
    inside: Counter = Counter()
    outside: Counter = Counter()
    for page in pages:
        here, beside = count_page(page)
        inside.update(here)
        outside.update(beside)
        examples += lessons(page, names)
    weights.inside, weights.outside = dict(inside), dict(outside)
    learn(examples, names, weights)
    return weights


def extract(page: str, weights: Weights) -> str:
    """The text of the best stretch: blocks in page order, one a line."""
    found = tokens(page)
    scores, cut, k = [], set(), 0
    held = holders(found)
    while k < len(found):
        token = found[k]
        if not token.name:
            scores.append(words(token.text) * weights.word(held[k]))
        elif not token.closing and token.end > k and weights.boilerplate(token):
            cut.add(k)
            scores += [CUT] + [0.0] * (token.end - k - 1)
            k = token.end
            if k < len(found) and found[k].closing and found[k].name == token.name:
                scores.append(0.0)  # its own end tag
                k += 1
            continue
        else:
            scores.append(weights.score(features(token)))
        k += 1
    lo, hi = best_stretch(scores)
    lines, line = [], []
    k = lo
    while k < hi:
        token = found[k]
        if not token.name:
            line.append(token.text)
        elif token.name in BLOCKS:
            lines.append("".join(line))
            line = []
        elif token.name in ("br", "td", "th"):
            line.append(" ")
        k = token.end if k in cut else k + 1
    lines.append("".join(line))
    return "\n".join(x for x in (" ".join(html.unescape(part).split()) for part in lines) if x)


def _extract(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, shared.value) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row per row: id_col, url_col, text, n_chars (code points of text).

    ``weights`` are learned from ``pages`` unless given.  A null or empty page,
    or one without words, has an empty text.  Character references are decoded;
    white space inside a block is one space; blocks are joined by a newline and
    none is capped.  Of stretches with equal sums the first counts.  Repeated
    rows stay; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit(pages, html_col))
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(_extract(shared), f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
