"""HTML main text by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Tags score negative; a word scores the sum of the log-likelihood ratios of what
its block shows: the block's element, whether it is linked, how many words it has.  The ratios are learned from labelled
pages, that is pages that mark exactly one main element (the only article, else the only main or role="main").  The mark
is the label and never a feature: article and main count as div, and the role is not read at prediction.  One linear scan finds
the contiguous region of the greatest sum.

Elements apart (menus, sidebars, adverts, notices, reader comments) neither add nor take, so that one amid an article does not cut
it in two, and their text is left out.  Which names and class words set an element apart is learned as well, from the words that they hold
in and outside main elements; `APART` gives prior counts.  Forms, scripts, styles and the head are never text.

Defined cases: null or empty html, and pages without any positive word, give an
empty text; unclosed and stray tags are tolerated; a tag that the page's end cuts off is dropped, as browsers do; an unknown tag is
inline; without labelled pages the prior counts alone decide; an element that holds nearly all words is not set apart by a class word; null or repeated
page ids and extra columns change nothing.  Whole pages are read in linear time; nothing is capped.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never text of an article.
NEVER = frozenset("head title form button select option textarea script style noscript template iframe svg canvas object label input".split())
RAW = frozenset("script style noscript template iframe svg textarea object canvas".split())
#: Elements whose name is a mark like a class word.
MARKS = frozenset("nav footer aside menu dialog header".split())
NAMED = MARKS | {"topheader"}
#: Closed by their like.
LIKE = frozenset("li dt dd tr td th option".split())
#: Class words, ids and names that set an element apart before any page is seen, as beginnings; prior counts are PRIOR words outside.
APART = re.compile(
    r"(?:nav|menu|footer|aside|dialog|topheader|masthead|topbar|breadcrumb|sidebar|advert|adsbygoogle|sponsor|promo|banner|cookie|consent|gdpr|notice|popup|modal|overlay|sharing|social|related|recommended|comment|respond|repl(?:y|ies)$|disqus|newsletter|subscribe|signup|login|widget|toolbar|paginat|(?:ads?|side|alert|share|pager|search|foot|contentinfo|complementary)$)"
)
#: Prior log ratios of blocks, prior words behind every ratio, and the ranges of ratios, of tags and of what sets apart.
BLOCKS = {"b:p": 1.0, "b:h1": 1.0, "b:h2": 1.0, "b:h3": 1.0, "b:pre": 1.0, "b:blockquote": 1.0, "b:li": 0.5, "l:0": 0.7, "l:1": -1.0, "l:2": -1.5, "n:0": -0.3, "n:1": -0.1, "n:2": 0.4, "n:3": 1.0}
PRIOR, LIMIT, TAG_LIMIT, SET_APART, NEARLY_ALL = 50.0, 1.5, 0.05, -1.5, 0.9
LENGTHS = (4, 10, 25)

_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?|[\s/]*=?""")
_CLASS_WORD = re.compile(r"[a-z]{2,}")


def _tag_end(page: str, at: int) -> int:
    """Position of the > that ends the tag whose attributes start at `at`, -1 without any; a closed quote after = hides a >."""
    end = page.find(">", at)
    if end < 0:
        return -1
    attrs = page[at:end]
    if "'" not in attrs and attrs.count('"') % 2 == 0:
        return end
    while at < len(page) and page[at] != ">":
        at = max(_ATTR.match(page, at).end(), at + 1)
    return at if at < len(page) else -1


def _attributes(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            if m[1]:
                out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class Page:
    """The parsed page: runs of text and tags in order, and the elements with marks."""

    def __init__(self, page: str | None):
        #: (text, block number, linked, never) or (tag type, breaks a block)
        self.events: list[tuple] = []
        self.words = [0]  # words before each event that may be text
        self.marked: list[list] = []  # [marks, first event, event after]
        self.mains: list[list] = []  # [is article, marks on the way, first event, event after]
        self.block_of: list[str] = [""]  # nearest block element of each block
        self.block_words: list[list[int]] = [[0, 0]]  # words, linked words
        self._parse(page or "")

    def _parse(self, page: str) -> None:
        stack: list[tuple] = []  # name, is never, is link, entry of marked, entry of mains
        where: dict[str, list[int]] = defaultdict(list)  # name to its places in the stack
        blocks: list[int] = []  # places of block elements
        never = links = 0
        events = self.events

        def text(raw: str) -> None:
            if not raw:
                return
            raw = _html.unescape(raw) if "&" in raw else raw
            n = 0
            if not raw.isspace() and not never:
                n = len(raw.split())
                count = self.block_words[-1]
                count[0] += n
                if links:
                    count[1] += n
            events.append((raw, len(self.block_of) - 1, links > 0, never > 0))
            self.words.append(self.words[-1] + n)

        def tag(kind: str, breaks: bool) -> None:
            events.append((kind, breaks))
            self.words.append(self.words[-1])
            if breaks:
                name = stack[blocks[-1]][0] if blocks else ""
                if self.block_words[-1][0]:
                    self.block_of.append(name)
                    self.block_words.append([0, 0])
                else:
                    self.block_of[-1] = name

        def leave(to: int) -> None:
            nonlocal never, links
            while len(stack) > to:
                name, o, a, mark, main = stack.pop()
                never -= o
                links -= a
                where[name].pop()
                if blocks and blocks[-1] == len(stack):
                    blocks.pop()
                for entry in (mark, main):
                    if entry is not None:
                        entry[-1] = len(events)

        at, size = 0, len(page)
        while at < size:
            i = page.find("<", at)
            if i < 0 or i + 1 == size:
                text(page[at:])
                break
            c = page[i + 1]
            if c == "!" or c == "?":
                text(page[at:i])
                if page.startswith("<!--", i):
                    end = page.find("-->", i + 2)
                    at = size if end < 0 else end + 3
                else:
                    end = page.find(">", i)
                    at = size if end < 0 else end + 1
                continue
            close = c == "/"
            m = _OPEN.match(page, i + 1 + close)
            if m is None:
                if close:  # </ and no name: a comment up to the next >
                    text(page[at:i])
                    end = page.find(">", i)
                    at = size if end < 0 else end + 1
                else:
                    text(page[at : i + 1])
                    at = i + 1
                continue
            text(page[at:i])
            end = _tag_end(page, m.end())
            if end < 0:
                break
            at = end + 1
            name = m[0].lower()
            if close:
                if where[name]:
                    leave(where[name][-1])
                elif not where[name]:
                    del where[name]
                tag("t:" + ("div" if name in ("article", "main") else name) if name in BLOCK else "t:inline", name in BLOCK)
                continue
            attrs = page[m.end() : end]
            if name in RAW:
                if not attrs.endswith("/") or name not in ("svg", "object", "canvas"):
                    found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = size if found is None else found.end()
                tag("t:never", False)
                continue
            if name in BLOCK and where.get("p") and blocks and blocks[-1] == where["p"][-1]:
                leave(blocks[-1])  # a block ends an open paragraph
            elif name in LIKE and stack and stack[-1][0] == name:
                leave(len(stack) - 1)
            a = _attributes(attrs)
            hidden = name in NEVER or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            marks = set(_CLASS_WORD.findall(f"{a.get('class', '')} {a.get('id', '')} {a.get('aria-label', '')}".lower())) if a else set()
            role = a.get("role", "").lower()
            if role and role != "main":
                marks.add(role)
            if name in MARKS and (name != "header" or not stack or stack[-1][0] in ("body", "html")):
                marks.add("topheader" if name == "header" else name)
            if name not in VOID and not attrs.endswith("/"):
                mark = [marks, len(events), None] if marks else None
                main = None
                if name in ("article", "main") or role == "main":
                    main = [name == "article", {w for s in stack if s[3] is not None for w in s[3][0]} | marks if len(stack) < 64 else marks, len(events), None]
                    self.mains.append(main)
                if mark is not None:
                    self.marked.append(mark)
                where[name].append(len(stack))
                if name in BLOCK:
                    blocks.append(len(stack))
                stack.append((name, hidden, name == "a", mark, main))
                never += hidden
                links += name == "a"
            tag("t:" + ("div" if name in ("article", "main") else name) if name in BLOCK else "t:inline", name in BLOCK)
            if name == "br":
                text(" ")
        leave(0)

    def label(self) -> tuple[int, int] | None:
        """First event and event after of the page's only main element that no prior mark sets apart."""
        for article in (True, False):
            found = [m for m in self.mains if m[0] == article and not any(APART.match(w) for w in m[1])]
            if len(found) == 1:
                return found[0][2], found[0][3]
        return None

    def features(self, block: int) -> tuple[str, str, str]:
        name = self.block_of[block]
        n, linked = self.block_words[block]
        return "b:" + ("div" if name in ("article", "main", "body", "html", "section", "") else name), f"l:{0 if not linked else 1 if 2 * linked < n else 2}", f"n:{sum(n >= x for x in LENGTHS)}"

    def apart(self, weights: dict[str, float]) -> list[bool]:
        """Whether each event lies in an element apart."""
        depth = [0] * (len(self.events) + 1)
        for marks, a, b in self.marked:
            by = [w for w in marks if set_apart(weights, w)]
            # a class word on a wrapper of the page says nothing; a name does
            if by and (self.words[b] - self.words[a] <= NEARLY_ALL * self.words[-1] or not NAMED.isdisjoint(by)):
                depth[a] += 1
                depth[b] -= 1
        out, d = [], 0
        for x in depth[:-1]:
            d += x
            out.append(d > 0)
        return out


def set_apart(weights: dict[str, float], mark: str) -> bool:
    w = weights.get("m:" + mark)
    return w <= SET_APART if w is not None else bool(APART.match(mark))


def scored(page: Page, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of every event, and whether it lies apart."""
    apart = page.apart(weights)
    of_block: dict[int, float] = {}
    out = []
    for e, off in zip(page.events, apart):
        if off:
            out.append(0.0)
        elif len(e) == 2:
            out.append(0.0 if e[0] == "t:never" else weights.get(e[0], weights["t:*"]))
        elif e[3] or e[0].isspace():
            out.append(0.0)
        else:
            if e[1] not in of_block:
                of_block[e[1]] = sum(weights.get(f, 0.0) for f in page.features(e[1]))
            out.append(of_block[e[1]] * len(e[0].split()))
    return out, apart


def region(scores: list[float]) -> tuple[int, int]:
    """First and last place of the maximum-scoring subsequence; (0, -1) if no sum is positive."""
    best, first, last, run, start = 0.0, 0, -1, 0.0, 0
    for i, w in enumerate(scores):
        run += w
        if run > best:
            best, first, last = run, start, i
        elif run <= 0:
            run, start = 0.0, i + 1
    return first, last


def main_text(page: str | None, weights: dict[str, float]) -> str:
    p = Page(page)
    scores, apart = scored(p, weights)
    first, last = region(scores)
    blocks, open_ = [], []
    for e, off in zip(p.events[first : last + 1], apart[first : last + 1]):
        if len(e) == 2:
            if e[1] and open_:
                blocks.append("".join(open_))
                open_ = []
        elif not off and not e[3]:
            open_.append(e[0])
    blocks.append("".join(open_))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def counted(page: str | None) -> Counter:
    """(feature, inside) counts of a labelled page, in words (tags: in tags); empty if not labelled."""
    p = Page(page)
    got: Counter = Counter()
    label = p.label()
    if label is None:
        return got
    first, last = label
    apart = p.apart({})  # by prior marks: what they hold says nothing about blocks
    of_block: dict[int, tuple] = {}
    for i, (e, off) in enumerate(zip(p.events, apart)):
        inside = first < i < last
        if len(e) == 2:
            got[e[0], inside] += not off
        elif not e[3] and not e[0].isspace():
            n = len(e[0].split())
            got["", inside] += n
            if e[1] not in of_block:
                of_block[e[1]] = p.features(e[1])
            for f in of_block[e[1]]:
                got[f, inside] += n
    for marks, a, b in p.marked:
        n = p.words[b] - p.words[a]
        within = max(0, p.words[min(b, last)] - p.words[max(a, first)]) if a < last and b > first else 0
        for w in marks:
            got["m:" + w, True] += within
            got["m:" + w, False] += n - within
    return got


def learn(pages: DataFrame, least: int = 3) -> dict[str, float]:
    """Weights from the labelled pages.

    The counts are summed per feature before they leave the executors.  Class words that are on fewer than `least` pages are left to the prior,
    and so are those that do not set apart, as they change nothing: the driver gets the features of blocks and the words that set apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            cols = [keys, [total[k, True] for k in keys], [total[k, False] for k in keys], [seen[k] for k in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "i", "o", "n"])

        for batch in batches:
            for page in batch.column("html"):
                got = counted(page.as_py())
                total.update(got)
                seen.update({k for k, _ in got})
                if len(seen) > 100_000:
                    yield out()
                    total.clear()
                    seen.clear()
        yield out()

    got = pages.select("html").mapInArrow(run, "kind string, i long, o long, n long").groupBy("kind").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("n").alias("n"))
    got = got.where(~F.col("kind").startswith("m:") | (F.col("n") >= least) & ((F.col("o") > 2 * F.col("i")) | F.col("kind").rlike("^m:" + APART.pattern)))
    return weights_of({r["kind"]: (r["i"], r["o"]) for r in got.collect()})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-likelihood ratios within their ranges; every ratio starts from PRIOR words that agree with its prior."""
    i_all, o_all = (max(1, x) for x in counts.get("", (1, 1)))
    scale = PRIOR / max(i_all + o_all, PRIOR)
    out = {k: v for k, v in BLOCKS.items()} | {"t:*": -TAG_LIMIT / 2, "t:inline": -TAG_LIMIT / 5}
    for kind, (i, o) in counts.items():
        if kind.startswith("t:") and kind != "t:never":
            odds = math.log((i + 0.5) / (o + 0.5))
            out[kind] = max(min(odds, -0.001), -TAG_LIMIT if kind != "t:inline" else -TAG_LIMIT / 5)
        elif kind[:2] in ("b:", "l:", "n:"):
            tilt = math.exp(BLOCKS.get(kind, 0.0))
            ratio = math.log((i + scale * i_all * tilt) / i_all) - math.log((o + scale * o_all) / o_all)
            out[kind] = max(-LIMIT, min(LIMIT, ratio))
        elif kind.startswith("m:"):
            prior = PRIOR if APART.match(kind[2:]) else 0.0
            out[kind] = math.log((i + 0.5) / i_all) - math.log((o + 0.5 + prior) / o_all) if i else SET_APART - 1
    return out


def extracted(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    weights = weights or learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(p.as_py(), weights) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
