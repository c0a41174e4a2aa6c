"""HTML extraction by union-free regular expressions inferred for each host.

A page is read as a stream of structural tags and text. Stretches that repeat side by side (list items,
paragraphs) fold into a repeated group, so pages of one layout give the same short expression whatever
their length. The expressions of a host are aligned one after another with the wrapper found so far: equal
parts stay, a part once and a part repeated become a repeated group, what only one side has becomes an optional
group, and texts are slots. No alternatives arise, so the wrapper stays one regular expression.

A host's article is in a marked container (article or main), else in the container that holds most text outside
links over all pages of the host, without what is in menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments. A page that lacks its host's container uses its own layout.
A class, id or role marks such an element if a whole name or its head word says so ('comments-area', not
'notice-of-award' or 'no-sidebar'). A mark around an article or main, or around all text of a host, does not count
if what it holds is the larger part of the text.

The wrapper then tells text from template. Every page's tokens are matched against its host's expression, which gives
each text its slot. A text that stands in the same slot on ``CONSTANT`` of the host's distinct pages that have the
slot is template, be the slot plain, optional or in a repeated group. Template is left out at the start and at the
end of the article only: between texts of its own, as with headings that every page has, it belongs to the
article. Hosts of under ``MIN_PAGES`` such pages show no template, and a page that would be left with nothing keeps its
texts.

Expressions are counted by host before they meet, so a host with a third of all pages brings one row per
distinct layout and task. Layouts are aligned in salted parts of a host first, then part by part. Texts of slots are
counted as hashes, distinct by page and spread over all tasks, then combined in each task. Wrappers, with the
hashes of their template texts, are a table of one row per host, which Spark broadcasts if it is small and joins by
shuffle otherwise.

Defined results: a null, empty or blank page has empty text; broken markup is read as far as it goes and an
unfinished tag at the end is dropped; pages without a host form one group; repeated pages repeat
their text and count in their host's layouts and container, but once for its template; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.llm.url_filter import host_and_path
from diffmill.session import stored

#: Parts in which the layouts of one host are aligned before the parts meet.
SALTS = 16
#: Longest stretch that is looked for as a repeated group, in tokens.
LONGEST_GROUP = 12
#: Least distinct pages of a host that have a slot, and share of them on which a template text stands in it.
MIN_PAGES, CONSTANT = 20, 0.9

_words = lambda text: frozenset(text.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
INLINE = _words(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var"
)
#: Elements that are never article text, and words of a class, id or role that mark such elements.
SKIPPED = _words(
    "head title nav footer aside form script style noscript template iframe button select textarea menu dialog"
)
MARKS = _words(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "sidebar footer masthead breadcrumb breadcrumbs cookie cookies consent notice notices alert popup modal overlay "
    "subscribe subscription newsletter signup login search share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus widget toolbar pagination pager copyright contentinfo complementary"
)
#: Words that a name may have after its head word, and words before it that say something else.
TRAILING = _words(
    "area bar block body box button buttons container content form group inner item items link links list outer panel "
    "post posts row section text top bottom left right title wrap wrapper"
)
LEADING = _words("has have hide no non not show with without")
RAW = _words("script style textarea title noscript template iframe")
MAIN = _words("article main")
_PLAIN = _words("html body article main")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|(\Z))|([^<]+|<)",
    re.S,
)
_MARKED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


#: Why a block is skipped: not, by a mark alone (on an element that holds the article, or not), by its kind.
KEPT, AROUND, MARKED, KIND = range(4)


def marks_of(attributes: str) -> set[str]:
    """Head words of the names in class, id and role that mark an element."""
    found = set()
    for _, *values in _MARKED.findall(attributes):
        for name in "".join(values).split():
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            while len(words) > 1 and words[-1] in TRAILING:
                words.pop()
            if words and words[-1] in MARKS and LEADING.isdisjoint(words):
                found.add(words[-1])
    return found


class Page:
    """Reads one page: ``blocks`` (container, why skipped, text, characters in links) and ``layout``."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, str, int]] = []
        self.layout: list[str] = []
        #: name, label in the path, why skipped, path of containers
        self.stack: list[tuple[str, str, int, str]] = []
        self.pending: list[str] = []
        self.linked = self.in_link = 0
        at = 0
        while at < len(source):
            token = _TOKEN.match(source, at)
            at = token.end()
            closed, opened, attributes, cut, text = token.group(1, 2, 3, 4, 5)
            if text is not None:
                self.pending.append(text)
                if self.in_link:
                    self.linked += len(text)
            elif opened and cut is None:
                at = self._open(opened.lower(), attributes, source, at)
            elif closed:
                self._close(closed.lower())
        self._flush()

    def _flush(self) -> None:
        """End the block of text at hand."""
        if self.pending:
            text = " ".join(html.unescape("".join(self.pending)).split())
            self.pending.clear()
            if text:
                skipped, path = (self.stack[-1][2], self.stack[-1][3]) if self.stack else (KEPT, "")
                self.blocks.append((path, skipped, text, self.linked))
                self.layout.append("#")
        self.linked = 0

    def _open(self, name: str, attributes: str, source: str, at: int) -> int:
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            if end is None:
                return len(source)
            close = source.find(">", end.start())
            return len(source) if close < 0 else close + 1
        if name in VOID:
            if name in ("br", "hr"):
                self._flush()
            return at
        marks = marks_of(attributes) if attributes and name not in _PLAIN else set()
        above = self.stack[-1] if self.stack else ("", "", KEPT, "")
        if name in INLINE:
            self.in_link += name == "a"
            if marks and not above[2]:
                self._flush()
                self.stack.append((name, name, MARKED, above[3]))
            else:
                self.stack.append((name, name, above[2], above[3]))
            return at
        self._flush()
        self._end_implied(name)
        above = self.stack[-1] if self.stack else ("", "", KEPT, "")
        inside = any(x[0] in MAIN for x in self.stack)
        skipped = above[2]
        if name in SKIPPED or (name == "header" and not inside):
            skipped = KIND
        elif skipped == MARKED and name in MAIN and not inside:
            skipped = AROUND
        elif marks and skipped in (KEPT, AROUND):
            skipped = MARKED
        label = ".".join([name, *sorted(marks)])
        path = above[3] if name == "p" else f"{above[3]}/{label}"
        self.stack.append((name, label, skipped, path))
        self.layout.append(label)
        return at

    def _end_implied(self, name: str) -> None:
        """A block ends an open paragraph; an item ends the item before it."""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
        ends = ("p", *same.get(name, ()))
        while True:
            i = len(self.stack) - 1
            while i >= 0 and self.stack[i][0] in INLINE:
                i -= 1
            if i < 0 or self.stack[i][0] not in ends:
                return
            self._cut(i)

    def _close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                if name not in INLINE or self.stack[i][2] != (self.stack[i - 1][2] if i else KEPT):
                    self._flush()
                self._cut(i)
                return
            if name in INLINE and self.stack[i][0] not in INLINE:
                return
            if name not in MAIN and self.stack[i][0] in MAIN:
                return

    def _cut(self, i: int) -> None:
        self.in_link -= sum(x[0] == "a" for x in self.stack[i:])
        del self.stack[i:]


# Expressions: lists of (part, repeated, optional); a part is a token or a list of the same kind.

def folded(tokens: list[str]) -> list:
    """The tokens as an expression in which stretches that repeat side by side are one repeated group."""
    parts = [(t, False, False) for t in tokens]
    size = 1
    while size <= min(LONGEST_GROUP, len(parts) // 2):
        out, i, changed = [], 0, False
        while i < len(parts):
            group = parts[i : i + size]
            j = i + size
            while len(group) == size and parts[j : j + size] == group:
                j += size
            if j > i + size:
                part = group[0][0] if size == 1 else tuple(group)
                out.append((part, True, size == 1 and group[0][2]))
                i, changed = j, True
            else:
                out.append(parts[i])
                i += 1
        parts = out
        size = 1 if changed and size > 1 else size + 1
    return parts


def _regrouped(parts: list, other: list) -> list:
    """``parts`` in which a plain stretch that ``other`` has as a group is that group, once."""
    for group in {p for p, _, _ in other if isinstance(p, tuple)}:
        size, out, i = len(group), [], 0
        while i < len(parts):
            if tuple(parts[i : i + size]) == group:
                out.append((group, False, False))
                i += size
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def aligned(a: list, b: list) -> list:
    """A short expression of this kind that both fit."""
    a, b = _regrouped(a, b), _regrouped(b, a)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else 0
            best[i][j] = max(same, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((a[i][0], a[i][1] or b[j][1], a[i][2] or b[j][2]))
            i, j = i + 1, j + 1
            continue
        from_a = j == m or (i < n and best[i + 1][j] >= best[i][j + 1])
        part, repeated, _ = a[i] if from_a else b[j]
        if out and out[-1][0] == part:  # once more of what came before: a repeated group
            out[-1] = (part, True, out[-1][2])
        else:
            out.append((part, repeated, True))
        i, j = (i + 1, j) if from_a else (i, j + 1)
    return out


def written(parts: list) -> str:
    """The expression as text."""
    def one(part, repeated, optional):
        inner = part if isinstance(part, str) else f"({written(part)})"
        return inner + "+" * repeated + "?" * optional

    return " ".join(one(*p) for p in parts)


def _packed(parts: list) -> str:
    return json.dumps(parts)


def _unpacked(text: str) -> list:
    def back(parts):
        return [(p if isinstance(p, str) else tuple(back(p)), r, o) for p, r, o in parts]

    return back(json.loads(text))


class Matcher:
    """Finds which token of an expression each token of a page is."""

    def __init__(self, parts: list):
        #: for each place (0: the start) the places that may follow, by token
        self.following: list[dict[str, list[int]]] = [{}]
        self.tokens = [""]
        first, last, _ = self._sequence(parts)
        self._link([0], first)
        self.last = set(last)

    def _link(self, places: list[int], following: list[int]) -> None:
        for q in places:
            for p in following:
                known = self.following[q].setdefault(self.tokens[p], [])
                if p not in known:
                    known.append(p)

    def _sequence(self, parts: list) -> tuple[list[int], list[int], bool]:
        """First and last places of a sequence, and whether it may be empty."""
        first, last, empty = [], [], True
        for part, repeated, optional in parts:
            if isinstance(part, str):
                self.tokens.append(part)
                self.following.append({})
                f = ends = [len(self.tokens) - 1]
                none = optional
            else:
                f, ends, none = self._sequence(part)
                none = none or optional
            if repeated:
                self._link(ends, f)
            self._link(last, f)
            first = first + f if empty else first
            last = last + ends if none else ends
            empty = empty and none
        return first, last, empty

    def places(self, tokens: list[str]) -> list[int] | None:
        """The place of each token; None where the expression does not fit."""
        steps: list[dict[int, int]] = []
        here: dict[int, int] = {0: 0}
        for token in tokens:
            then: dict[int, int] = {}
            for q in here:
                for p in self.following[q].get(token, ()):
                    then.setdefault(p, q)
            if not then:
                return None
            steps.append(then)
            here = then
        at = next((p for p in here if p in self.last), None)
        if at is None:
            return None
        out = []
        for step in reversed(steps):
            out.append(at)
            at = step[at]
        return out[::-1]


@lru_cache(maxsize=256)
def _matcher(wrapper: str) -> Matcher:
    return Matcher(_unpacked(wrapper))


def slots(page: Page, wrapper: str | None) -> list[str]:
    """The slot of each block: its place in the wrapper, or its container where the wrapper does not fit."""
    places = _matcher(wrapper).places(page.layout) if wrapper else None
    if places is None:
        return [path for path, *_ in page.blocks]
    return [str(p) for p, token in zip(places, page.layout) if token == "#"]


def _key(*values: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(values).encode("utf-8", "surrogatepass")) - (1 << 63)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layouts and text outside links of containers, marked ones apart, summed over a batch."""
    for batch in batches:
        layouts: Counter = Counter()
        masses: Counter = Counter()
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source or "")
            layouts[host, _packed(folded(page.layout))] += 1
            for path, skipped, text, linked in page.blocks:
                if skipped != KIND:
                    masses[host, "marked" if skipped else "mass", path] += max(0, len(text) - linked)
        rows = [(h, "layout", k, n) for (h, k), n in layouts.items()] + [(h, kind, k, n) for (h, kind, k), n in masses.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
            ["host", "kind", "value", "n"],
        )


def _wrap(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper from the layouts or wrappers of a host's part, the most frequent first."""
    rows = rows.sort_values(["n", "value"], ascending=[False, True])
    wrapper = None
    for value in rows["value"]:
        parts = _unpacked(value)
        wrapper = parts if wrapper is None else aligned(wrapper, parts)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "value": [_packed(wrapper)], "n": [int(rows["n"].sum())]})


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of a page's article (text null) and the texts in them, by hash of the article."""
    for batch in batches:
        rows = set()
        for host, source, wrapper, region in zip(*(c.to_pylist() for c in batch.columns)):
            page = Page(source or "")
            chosen = article_blocks(page, region)
            if chosen:
                own, whole = slots(page, wrapper), _key(*(page.blocks[i][2] for i in chosen))
                for i in chosen:
                    rows.add((host, own[i], None, whole))
                    rows.add((host, own[i], _key(own[i], page.blocks[i][2]), whole))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        rows = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "slot", "text", "page"])


def _templates(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """_host and template, the keys of the texts that stand in the same slot on nearly all pages of a host."""
    large = wrappers.where(F.col("n") >= MIN_PAGES).withColumnRenamed("host", "_host")
    held = pages.join(large, F.col("host") == F.col("_host")).select("host", "html", "wrapper", "region")
    uses = held.mapInArrow(_uses, "host string, slot string, text bigint, page bigint").distinct()
    counts = stored(uses.groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES), "slots")
    of_slot = counts.where("text is null").select(F.col("host").alias("_host"), F.col("slot").alias("_slot"), F.col("n").alias("_n"))
    same = (F.col("host") == F.col("_host")) & (F.col("slot") == F.col("_slot"))
    constant = counts.where("text is not null").join(of_slot, same).where(F.col("n") >= CONSTANT * F.col("_n"))
    return constant.groupBy(F.col("host").alias("_host")).agg(F.array_sort(F.collect_set("text")).alias("template"))


def infer_wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """host, wrapper (an expression), region, the container of its articles (null: the page's own), and template."""
    pages = pages.select(pages[host_col].alias("host"), pages[html_col].alias("html"))
    found = pages.mapInArrow(_evidence, "host string, kind string, value string, n bigint")
    evidence = stored(found.groupBy("host", "kind", "value").agg(F.sum("n").alias("n")), "layouts")
    shape = "host string, value string, n bigint"
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS))
    parts = evidence.where("kind = 'layout'").groupBy("host", salt).applyInPandas(_wrap, shape)
    wrappers = parts.groupBy("host").applyInPandas(_wrap, shape)
    region = F.max_by("value", F.struct("n", "value")).alias("region")
    # a marked container is a host's main one only if the host has no text outside marks
    masses = evidence.where("kind != 'layout' and n > 0").groupBy("host", "kind").agg(region)
    masses = masses.groupBy(F.col("host").alias("_host")).agg(F.max_by("region", "kind").alias("region"))
    both = wrappers.join(masses, F.col("host") == F.col("_host"), "left")
    both = stored(both.select("host", F.col("value").alias("wrapper"), "region", "n"), "wrappers")
    told = both.join(_templates(pages, both), F.col("host") == F.col("_host"), "left")
    return stored(told.select("host", "wrapper", "region", "template"), "wrappers")


def article_blocks(page: Page, region: str | None) -> list[int]:
    """The blocks of a page's article, template included."""
    def within(i: int) -> bool:
        return bool(region) and (page.blocks[i][0] == region or page.blocks[i][0].startswith(f"{region}/"))

    def size(chosen: list[int]) -> int:
        return sum(max(0, len(page.blocks[i][2]) - page.blocks[i][3]) for i in chosen)

    by_skip: list[list[int]] = [[] for _ in range(4)]
    for i, block in enumerate(page.blocks):
        by_skip[block[1]].append(i)
    kept, around, marked, _ = by_skip
    in_main = [i for i in kept if not MAIN.isdisjoint(x.split(".")[0] for x in page.blocks[i][0].split("/"))]
    if around and size(around) > size(in_main or kept):
        return around
    return in_main or [i for i in kept if within(i)] or kept or [i for i in marked if within(i) and "." in region]


def article_text(source: str | None, wrapper: str | None, region: str | None, template: list[int] | None = None) -> str:
    """The text of a page's article: the slots of the host's container without its template, one line each."""
    if not source:
        return ""
    page = Page(source)
    chosen = article_blocks(page, region)
    if template:
        own, known = slots(page, wrapper), frozenset(template)
        told = [k for k, i in enumerate(chosen) if _key(own[i], page.blocks[i][2]) not in known]
        chosen = chosen[told[0] : told[-1] + 1] if told else chosen
    return "\n".join(page.blocks[i][2] for i in chosen)


def extract_articles(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (page_id, url) with host, wrapper (as text) and text, one row per page."""
    keep = ["page_id", url_col] if keep is None else keep
    rows = pages.select(F.struct(*[pages[c] for c in keep]).alias("row"), host_and_path(F.coalesce(pages[url_col], F.lit("")))[0].alias("host"), pages[html_col].alias("html"))
    wrappers = infer_wrappers(rows).withColumnRenamed("host", "_host")

    def extract(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([article_text(*x) for x in zip(*(c.to_pylist() for c in columns))], pa.string())

    text = F.arrow_udf(extract, "string")("html", "wrapper", "region", "template").alias("text")
    shown = F.arrow_udf(_shown, "string")("wrapper").alias("wrapper")
    joined = rows.join(wrappers, F.col("host") == F.col("_host"), "left")
    return joined.select("row", "host", shown, text).select("row.*", "host", "wrapper", "text")


def _shown(wrappers: pa.Array) -> pa.Array:
    known: dict[str | None, str | None] = {None: None}
    for w in wrappers.unique().to_pylist():
        known[w] = written(_unpacked(w)) if w is not None else None
    return pa.array([known[w] for w in wrappers.to_pylist()], pa.string())
