"""Main text of web pages by tag-path ratios (operator 8).

The blocks of a page are grouped by their root-to-leaf path of block elements. Text length outside of links and
punctuation, by block of a path, are smoothed over the paths in page order and fused as the root of their product; paths
that pass a share of the page's mean, weighted by text, are content, and with them paths that end in the same element
further up. Their blocks are the content nodes. The smallest
region with nearly all of them gives its other texts too, headings and short paragraphs; elsewhere so do the blocks
between kept ones that are not mostly links, and headings right before. Elements that HTML defines as something else
(navigation, forms and the like) have no part in this. Names only break ties: an article element wins over as much text
outside, and of paths that passed, parts that name themselves as comments or adverts are dropped, unless they hold the
page's main element or most of its content nodes.
Every page is independent: Spark maps over them, nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches

# Element names of HTML.
RAW = ["script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "button", "audio", "video", "annotation", "annotation-xml"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
MATH = ["annotation", "annotation-xml", "math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"]
INLINE = [*MATH, "canvas", "object", "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr"]
REGION = ["article", "main", "section", "div", "td", "body"]
BOILERPLATE = ["nav", "footer", "aside", "form", "menu", "dialog", "head"]
ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"]
MARKS = ["ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "disclaimer", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "warning", "widget"]
#: Of these, what marks an article as not the main one.
ARTICLE_MARKS = ["advert", "advertisement", "comment", "comments", "promo", "promoted", "related", "replies", "reply", "sponsor", "sponsored", "teaser"]
#: Marks of what stands beside the text and can be longer than it.
BESIDE = {*ARTICLE_MARKS, "ad", "ads", "adverts", "promotion", "disqus", "respond", "cookie", "cookies", "consent", "gdpr"}
#: Of these, what readers wrote.
READERS = {"comment", "comments", "replies", "reply"}
#: An article's class name that ends so tells of its state.
STATES = ["open", "closed", "enabled", "disabled"]
#: A class name that starts so tells of the page around, not of itself.
ABOUT = ["has", "is", "no", "not", "show", "with", "without"]
#: A header of these is part of the text.
OWN = ["article", "content", "entry", "post", "section", "story"]
#: Elements whose content is never text, closed or not.
TO_THE_END = ["script", "style", "textarea", "title", "template", "noscript", "iframe"]
#: A block start closes an open paragraph or item of the same kind.
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
HOLDERS = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "form", "blockquote"}

_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.,;:!?…](?=\s|\Z)|[、。，；：！？]")
_HEADING = re.compile(r"h[1-6]")
#: Blocks that can stand between a heading and the text.
LEAD = 2
#: Power of a path's text in its score.
SHARE = 0.25
#: Share of the page's mean score.
THRESHOLD = 0.6


def _boilerplate(name: str, attrs: str, by_name: bool) -> tuple[bool, set[str]]:
    """Whether an element is never content, and the marks in its names. Names of inline elements tell of style."""
    if name in BOILERPLATE:
        return True, set()
    if not attrs.strip():
        return False, set()
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, set()
    if not by_name or name in ("body", "html", "main") or name in INLINE:
        return False, set()
    named = [_WORDS.findall(_CAMEL.sub(" ", c).lower()) for c in f"{found.get('class', '')} {found.get('id', '')}".split()]
    named = [words for words in named if words and words[0] not in ABOUT and not (name == "article" and words[-1] in STATES)]
    marks = {w for words in named for w in words if w != "header" or not set(words).intersection(OWN)}
    return False, marks.intersection(ARTICLE_MARKS if name == "article" else MARKS)


class Page:
    """Texts of a page with their tag paths; paths and regions form trees by number, so a page takes time in proportion to its length."""

    def __init__(self, source: str, by_name: bool = True):
        self.by_name = by_name
        self.texts: list[list] = []  # [text, path, region, in a link, boilerplate, starts a block, mark]
        self.above, self.leaf, self.heading = [-1], [""], [False]  # of each path: the path above, its element, whether a heading is among its elements
        self.parent, self.kind, self.off, self.mark = [-1], ["body"], [False], [-1]
        self.marks: list[tuple[int, str, set[str], bool]] = []  # parent, element, words, inside an article or main
        self._read(source)
        self._settle()

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int, int, bool, int]] = []  # name, path, region, boilerplate, mark
        opened: Counter[str] = Counter()  # names on the stack
        blocks: list[int] = []  # places on the stack of elements that are not inline
        numbers: dict[tuple[int, str], int] = {}  # of paths
        unclosed: set[str] = set()  # raw elements whose end the page has no more
        at, fresh = 0, True

        def cut(n: int) -> None:
            """Leaves the first ``n`` of the stack."""
            for name, *_ in stack[n:]:
                opened[name] -= 1
            del stack[n:]
            while blocks and blocks[-1] >= n:
                blocks.pop()

        while at < len(s):
            m = _TOKEN.search(s, at)
            if m is None:
                m_start, m_end = len(s), len(s)
            else:
                m_start, m_end = m.span()
            if m_start > at:
                self._add(s[at:m_start], stack, opened, fresh)
                fresh = False
            if m is None:
                break
            at = m_end
            name, attrs = (m["name"] or "").lower(), (m["attrs"] or "").removesuffix(">")
            if m["cdata"]:
                self._add(m["cdata"], stack, opened, fresh)
                fresh = False
            if not name:
                continue
            if name not in INLINE:
                fresh = True
            if m["close"]:
                if opened[name]:
                    cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                continue
            if name in VOID or attrs.endswith("/") and (name in MATH or name not in INLINE) and name not in REGION and name != "p":
                continue
            if name in RAW:
                end = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(s, at)
                if end is None:
                    unclosed.add(name)
                at = end.end() if end else len(s) if name in TO_THE_END else at
                continue
            if name not in INLINE:
                closes = CLOSED_BY.get(name, {"p"})
                while blocks and stack[blocks[-1]][0] in closes and stack[blocks[-1]][0] not in HOLDERS:
                    cut(blocks[-1])
            path, region, off, mark = stack[-1][1:] if stack else (0, 0, False, -1)
            inside = opened["article"] + opened["main"] > 0
            never, words = _boilerplate(name, attrs, self.by_name)
            off = off or never or (name == "header" and not inside)
            if words:
                self.marks.append((mark, name, words, inside))
                mark = len(self.marks) - 1
            if name in REGION and name != "body":
                self.parent.append(region)
                self.kind.append(name)
                self.off.append(off)
                self.mark.append(mark)
                region = len(self.parent) - 1
            if name not in INLINE:
                blocks.append(len(stack))
                path = numbers.setdefault((path, name), len(self.leaf))
                if path == len(self.leaf):
                    self.heading.append(self.heading[up := stack[-1][1] if stack else 0] or _HEADING.fullmatch(name) is not None)
                    self.above.append(up)
                    self.leaf.append(name)
            stack.append((name, path, region, off, mark))
            opened[name] += 1

    def _add(self, raw: str, stack: list, opened: Counter, fresh: bool) -> None:
        _, path, region, off, mark = stack[-1] if stack else ("", 0, 0, False, -1)
        self.texts.append([html.unescape(raw) if "&" in raw else raw, path, region, opened["a"] > 0, off, fresh, mark])

    def _settle(self) -> None:
        """Decides by the ratios which marks hold: none that holds the page's main element or most of its picked text."""
        if not self.marks:
            return
        n = len(self.marks)
        beside = [bool(words & BESIDE) for _, _, words, _ in self.marks]  # or inside such a mark
        for m, (up, *_) in enumerate(self.marks):
            beside[m] = beside[m] or up >= 0 and beside[up]
        named = [-1] * len(self.parent)  # the innermost article or main of a region
        for r, k in enumerate(self.kind):
            named[r] = r if k in ("article", "main") else named[self.parent[r]] if r else -1
        paths = self.content_paths() | self.content_paths({m for m in range(n) if beside[m]})
        held, own, articles, free_of, main = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        total, total_own, free = 0, 0, 0
        for text, path, region, _, off, _, mark in self.texts:
            size = 0 if off or path not in paths else len(text.strip())
            if not size:
                continue
            aside = mark >= 0 and beside[mark]
            total += size
            total_own += 0 if aside else size
            if mark >= 0:
                held[mark] += size
                own[mark] += 0 if aside else size
            if named[region] >= 0:
                if mark >= 0:
                    free_of[mark] += size
                else:
                    free += size
                if not aside and self.mark[named[region]] >= 0:
                    articles[self.mark[named[region]]] += size
        for r, k in enumerate(self.kind):
            if k == "main" and not self.off[r] and self.mark[r] >= 0:
                main[self.mark[r]] = True
        for m in range(n - 1, -1, -1):
            up = self.marks[m][0]
            if up >= 0:
                held[up] += held[m]
                own[up] += own[m]
                articles[up] += articles[m]
                main[up] = main[up] or main[m]
        holds = [True] * n
        for m, (up, name, words, inside) in enumerate(self.marks):
            if up >= 0 and holds[up]:
                continue
            if main[m]:
                holds[m] = False
            elif name == "article":
                holds[m] = held[m] * 2 <= total or bool(words & READERS) and free > 0
            elif words & BESIDE:  # all but a rest of the page
                again = up >= 0 and bool(words & BESIDE & self.marks[up][2])
                holds[m] = not again and (free > 0 and not inside or (total - held[m]) * 10 >= held[m])
            else:
                holds[m] = articles[m] <= free and (own[m] * 2 <= total_own or free > 0 and not inside)
            if not holds[m]:
                free += free_of[m]
        for x in self.texts:
            x[4] = x[4] or x[6] >= 0 and holds[x[6]]
        self.off = [off or m >= 0 and holds[m] for off, m in zip(self.off, self.mark, strict=True)]

    def content_paths(self, without: Collection[int] = ()) -> set[int]:
        """Paths whose smoothed and fused ratios pass the threshold; ``without`` the texts of some marks."""
        total: dict[int, list[float]] = {}  # characters outside of links, blocks, stops
        seen = None  # the path of the block at hand, if it is counted
        for text, path, _, link, off, fresh, mark in self.texts:
            n = len(text.strip())
            seen = None if fresh else seen
            if not off and n and mark not in without:
                f = total.setdefault(path, [0, 0, 0])
                f[1] += seen != path
                seen = path
                if not link:
                    f[0] += n
                    f[2] += len(_STOPS.findall(text))
        ratios = [(f[0] / f[1], f[2] / f[1]) for f in total.values()]  # in page order of their first text
        smooth = lambda v: [(v[max(i - 1, 0)] + 6 * x + v[min(i + 1, len(v) - 1)]) / 8 for i, x in enumerate(v)]
        share = [f[0] ** SHARE for f in total.values()]
        fused = [math.sqrt(length * (1 + stops)) * part for length, stops, part in zip(smooth([r[0] for r in ratios]), smooth([r[1] for r in ratios]), share, strict=True)]
        weight = sum(f[0] for f in total.values())
        mean = sum(score * f[0] for score, f in zip(fused, total.values(), strict=True)) / max(weight, 1)
        picked = {p for (p, f), score in zip(total.items(), fused, strict=True) if f[0] and score >= THRESHOLD * mean}
        # paths that end in the same element further up, below the page itself, go with them
        page = {0}
        for p, (up, leaf) in enumerate(zip(self.above, self.leaf, strict=True)):
            if up == 0 and leaf in ("html", "body") or leaf == "body" and up > 0 and self.above[up] == 0 and self.leaf[up] == "html":
                page.add(p)
        reached: set[tuple[int, str]] = set()
        for p in picked:
            up, leaf = self.above[p], self.leaf[p]
            while up >= 0 and (up, leaf) not in reached:
                reached.add((up, leaf))
                up = self.above[up]
        return picked | {p for p, f in total.items() if f[0] and p and self.above[p] not in page and (self.above[p], self.leaf[p]) in reached}

    def region(self, paths: set[int]) -> int:
        """The innermost region with nearly all picked text. Ties go to an article or main element."""
        held, whole = [0] * len(self.parent), [0] * len(self.parent)
        for text, path, region, link, off, *_ in self.texts:
            if not off and not link:
                held[region] += len(text.strip()) * (path in paths)
                whole[region] += len(text.strip())
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
            whole[self.parent[i]] += whole[i]
        named = [i for i, k in enumerate(self.kind) if k in ("article", "main") and whole[i]]
        if named:
            best = max(named, key=lambda i: (held[i], whole[i], -i))
            if max(held[best], whole[best]) * 2 >= held[0] - held[best]:
                inner = [i for i in named if held[i] >= 0.9 * held[best] and (held[i] or i == best)]
                outer = [i for i in named if i not in inner and held[i] > 0]
                # several articles of weight: their common parent
                return inner[-1] if not outer or held[best] >= 2 * max(held[i] for i in outer) else self._common([i for i in named if held[i] > 0])
        below: list[list[int]] = [[] for _ in held]
        for i in range(1, len(held)):
            below[self.parent[i]].append(i)
        at = 0
        while True:
            inner = next((i for i in below[at] if held[i] >= 0.8 * held[at] > 0), None)
            if inner is None:
                return at
            at = inner

    def _common(self, regions: list[int]) -> int:
        """The innermost region that holds all of ``regions``."""
        n = [0] * len(self.parent)
        for i in regions:
            n[i] += 1
        for i in range(len(n) - 1, 0, -1):
            n[self.parent[i]] += n[i]
        return max(i for i, x in enumerate(n) if x == len(regions))

    def main_text(self) -> str:
        paths = self.content_paths()
        chosen = self.region(paths)
        inside, around = [False] * len(self.parent), [False] * len(self.parent)
        at, outer = chosen, -1
        while at >= 0:  # the outermost article or main around the region
            if self.kind[at] in ("article", "main") and not self.off[at]:
                outer = at
            at = self.parent[at]
        if outer >= 0:
            around[outer] = True
        for i in range(len(self.parent)):
            up = self.parent[i]
            inside[i] = i == chosen and i > 0 or up >= 0 and inside[up]  # the page itself is no region
            around[i] = around[i] or up >= 0 and around[up]
        blocks: list[list] = []  # texts of one block that may be kept
        for x in self.texts:
            if x[5] or not blocks:
                blocks.append([])
            blocks[-1].append(x)
        blocks = [[x for x in block if not x[4]] for block in blocks]
        blocks = [block for block in blocks if any(x[0].strip() for x in block)]
        picked, plain, heads = [], [], []
        for block in blocks:
            size = sum(len(x[0].strip()) for x in block)
            plain.append(sum(len(x[0].strip()) for x in block if x[3]) * 2 <= size)
            picked.append(any(inside[x[2]] or plain[-1] and x[1] in paths and x[0].strip() for x in block))
            heads.append(any(self.heading[x[1]] for x in block))
        kept = [i for i, k in enumerate(picked) if k]
        first, last = (kept[0], kept[-1]) if kept else (0, -1)
        keep = [k or plain[i] and (first < i < last or any(around[x[2]] for x in blocks[i])) for i, k in enumerate(picked)]
        # headings right before, or over a line or two such as names and dates
        at = first
        for i in range(first - 1, -1, -1):
            if not plain[i] or not heads[i] and (at < first or first - i > LEAD):
                break
            if heads[i]:
                keep[i:at] = [True] * (at - i)
                at = i
        return " ".join(" ".join("".join(x[0] for x in block) for block, k in zip(blocks, keep, strict=True) if k).split())


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    text = page.main_text()
    if text or any(k in ("article", "main") and not off for k, off in zip(page.kind, page.off, strict=True)):
        return text
    return Page(source, by_name=False).main_text()  # class names that take everything away were about the page


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``html`` replaced by ``text``: the main text. Null or empty html: empty text. Rows stay rows."""
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "text"])

    return pages.select(*(f.name for f in kept), "html").mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def op8_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
