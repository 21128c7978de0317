"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host's pages."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.common import Cut

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
TEXT = "#"
OPTIONAL, REPEATED = 1, 2

# HTML's void elements, elements whose content is raw text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are closed when one of these opens, up to the elements that hold them.
IMPLIED = {t: ({t}, {"ul", "ol", "menu", "dir"}) for t in ("li",)} | {t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")} | {
    t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")
} | {"tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})} | {t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
#: Never main text; of no use even where nothing else is left.
NEVER = frozenset("head nav noscript template button select svg math object canvas dialog menu search audio video datalist".split())
#: Words of class names, ids and roles that mark what stands beside the main text.
BESIDE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar"
    " breadcrumb breadcrumbs pagination pager sidebar widget widgets footer masthead topbar toolbar comment comments commentlist disqus"
    " share sharing social newsletter subscribe subscription signup login popup modal overlay cookie cookies consent gdpr contentinfo"
    " aside recommended recommendations notice notices alert disclaimer copyright complementary search form dialog alertdialog".split()
)
#: Words that may do so, or name a part of an article: there the wrapper's statistics decide, see Wrapper.
MAYBE = frozenset("respond reply replies discussion related".split())
BEGINNINGS = ("adsby", "advert", "breadcrumb", "cookie", "navbar", "newsletter", "sidebar", "sponsor")
# No part is tried again once it has matched, and a part ends at the next tag's beginning.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^<>]*+>.*?(?:</\1\b[^<>]*+>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"'<>]*+>))*+)>|<[!?/][^<>]*+>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements without a mark that lie deeper than this are as one with the element around them.
DEEPEST = 80
#: A text of links has to be this long to be one of an article's references, and a shared one to be an article's own.
REFERENCE, SHARED = 25, 80


def _beside(names: list[str]) -> str:
    """The mark that the names speak for: - beside the main text, ~ maybe so, or none."""
    found = ""
    for name in names:
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in ("has", "with", "no", "is", "js"):
            continue
        if words[0] in BESIDE or words[-1] in BESIDE or any(w.startswith(BEGINNINGS) for w in words):
            return "-"
        if words[0] in MAYBE or words[-1] in MAYBE:
            found = "~"
    return found


_LABELS: dict[tuple[str, str], str] = {}


def label_of(tag: str, attributes: str) -> str:
    """tag#id.class without digits, after a mark: ! never main text, - beside it, ~ maybe so, ^ a header, + the main element."""
    if not attributes and tag not in NEVER:
        mark = "-" if tag in ("footer", "aside", "form") else "^" if tag == "header" else "+" if tag in ("article", "main") else ""
        return mark + tag
    if (tag, attributes) in _LABELS:
        return _LABELS[tag, attributes]
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = [] if tag in ("html", "body") else found.get("class", "").split()
    names = [*classes, "" if tag in ("html", "body") else found.get("id", ""), found.get("role", "")]
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE)
    if tag in NEVER or hidden and tag not in ("html", "body"):
        mark = "!"
    elif tag in ("footer", "aside", "form"):
        mark = "-"
    elif tag not in ("html", "body", "main", "article") and (beside := _beside(names)):
        mark = beside
    elif tag == "header" or any(re.fullmatch(r"(?i)(?:.*[-_])?header", n) for n in names):
        mark = "^"
    elif tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        mark = "+"
    else:
        mark = ""
    out = mark + re.sub(r"\d+", "", tag + "".join(f".{c}" for c in sorted(classes)))[:80]
    if len(_LABELS) > 50_000:
        _LABELS.clear()
    _LABELS[tag, attributes] = out
    return out


def parse(page: str | None) -> tuple[tuple, list[list[tuple[int, str, int]]]]:
    """A page's shape, and for each text place of the shape its blocks: (place on the page, text, characters in links).

    The token stream is balanced first: void and inline elements go, missing end tags are added, stray ones passed
    over. An element is (label, children); equal elements in a row are one, and their texts share a place.
    """
    stack: list[list] = [["", "", [], [], True]]  # tag, label, shapes, places of each shape, is it an element of its own
    held: list[str] = []
    linked, in_link, skip, n, depth = 0, 0, 0, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal linked, n
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text and not skip:
                add(TEXT, [[(n, text, min(linked, len(text)))]])
                n += 1
        linked = 0

    def add(shape, places: list) -> None:
        _, _, shapes, kept, _ = stack[-1]
        if shapes and shapes[-1] == shape:
            for old, new in zip(kept[-1], places, strict=True):
                old.extend(new)
        else:
            shapes.append(shape)
            kept.append(places)

    def close() -> None:
        nonlocal skip, depth
        _, label, shapes, places, own = stack.pop()
        if not own:
            return
        depth -= 1
        if label[0] == "!":
            skip -= 1
        if shapes:
            add((label, tuple(shapes)), [p for some in places for p in some])

    def close_to(tags, holders=()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                flush()
                while len(stack) > i:
                    close()
                return
            if stack[i][0] in holders:
                return

    def say(raw: str) -> None:
        nonlocal linked
        if not skip and raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            held.append(raw)
            if in_link:
                linked += len(raw)

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        tag = name.lower()
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = 0 if m[2] else 1
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        block = tag in BLOCK
        if m[2]:
            if block:
                flush()
            if block or stack[-1][0] == tag:
                if not block:
                    flush()
                close_to({tag}, {"td", "th", "table"} if tag in ("p", "div", "li", "span") else ())
            continue
        label = label_of(tag, m[4])
        if block:
            flush()
            in_link = 0
            close_to({"p"}, {"button", "table", "td", "th", "li", "div", "section", "article", "main", "body", "blockquote"})
            if tag in IMPLIED:
                close_to(*IMPLIED[tag])
        elif label[0] not in "!-~":
            continue
        if not block:
            flush()
        mark = label[0] if label[0] in "!-~^+" else ""
        if depth >= DEEPEST and (not mark or any(x[4] and x[1][:1] == mark for x in stack)):
            stack.append([tag, label, *stack[-1][2:4], False])  # shares the lists of the element around it
            continue
        depth += 1
        if mark == "!":
            skip += 1
        stack.append([tag, label, [], [], True])
    say(page[at:])
    flush()
    while len(stack) > 1:
        close()
    _, _, shapes, places, _ = stack[0]
    return tuple(shapes), [p for some in places for p in some]


# A wrapper's items: [TEXT, flags, characters, characters in links, hashes of the texts that every page has], or
# [label, flags, items]. A group of several elements that repeat together has the label "".


def items_of(shape: tuple, stats: Iterator[list]) -> list:
    """The items of a shape, with the statistics of its text places in order; rows of like elements fold into repeats."""
    out = []
    for s in shape:
        out.append([TEXT, 0, *next(stats)] if s == TEXT else [s[0], 0, items_of(s[1], stats)])
    return fold(out)


def fold(items: list) -> list:
    """Merge what repeats in a row (one, two or three items at a time) into one repeated item or group."""
    for width in (1, 2, 3):
        out, i = [], 0
        while i < len(items):
            labels = [x[0] for x in items[i : i + width]]
            many = 1
            while len(labels) == width and (width == 1 or TEXT not in labels) and [x[0] for x in items[i + many * width : i + (many + 1) * width]] == labels:
                many += 1
            if many == 1:
                out.append(items[i])
                i += 1
                continue
            group = items[i : i + width]
            for k in range(1, many):
                group = [merge(a, b, False) for a, b in zip(group, items[i + k * width : i + (k + 1) * width], strict=True)]
            if width == 1:
                group[0][1] |= REPEATED
                out += group
            else:
                out.append(["", REPEATED, group])
            i += many * width
        items = out
    return items


def _table_pairs(x: list[str], y: list[str]) -> Iterator[tuple[int, int]]:
    """Matching places of a longest common subsequence, by a table of all pairs of places."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1


def _long_pairs(x: list[str], y: list[str], table: int) -> Iterator[tuple[int, int]]:
    """Matching places of long rows in about linear time: labels that both have once are anchors, as many as stand in
    the same order; between anchors small parts go by table, others take each label's next place."""
    once = lambda row: {v for v, n in Counter(row).items() if n == 1}
    place = {v: j for j, v in enumerate(y)}
    both = once(x) & once(y)
    tails: list[int] = []  # a longest increasing row of anchors' places in y
    back: dict[int, tuple[int, int | None]] = {}
    last: list[int] = []
    for i, v in enumerate(x):
        if v in both:
            j = place[v]
            k = bisect_left(tails, j)
            back[j] = (i, last[k - 1] if k else None)
            tails[k : k + 1], last[k : k + 1] = [j], [j]
    chain, j = [], last[-1] if last else None
    while j is not None:
        chain.append((back[j][0], j))
        j = back[j][1]
    a = b = 0
    for i, j in [*reversed(chain), (len(x), len(y))]:
        p, q = x[a:i], y[b:j]
        if len(p) * len(q) <= table:
            yield from ((a + k, b + m) for k, m in _table_pairs(p, q))
        elif p and q:
            where: dict[str, list[int]] = {}
            for m, v in enumerate(q):
                where.setdefault(v, []).append(m)
            at = 0
            for k, v in enumerate(p):
                own = where.get(v, ())
                n = bisect_left(own, at)
                if n < len(own) and (own[n] - at <= 64 or k == 0):
                    yield a + k, b + own[n]
                    at = own[n] + 1
        if i < len(x):
            yield i, j
        a, b = i + 1, j + 1


def pairs(a: list[str], b: list[str], table: int = 250_000) -> list[tuple[int | None, int | None]]:
    """Align two rows of labels; None stands for a missing partner.

    By a longest common subsequence where the rows, without their common beginning and end, have at most ``table``
    pairs of places, else by anchors, see _long_pairs().
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    out: list = [(i, i) for i in range(first)]
    i = j = 0
    found = _table_pairs(x, y) if len(x) * len(y) <= table else _long_pairs(x, y, table)
    for k, m in [*found, (len(x), len(y))]:
        out += [(first + n, None) for n in range(i, k)] + [(None, first + n) for n in range(j, m)]
        if k < len(x):
            out.append((first + k, first + m))
        i, j = k + 1, m + 1
    return out + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def merge(a: list, b: list, across: bool = True) -> list:
    """One item for two with the same label: texts that differ become a slot, elements without a partner optional.

    across: the two are of different pages, so only texts that both have are texts of every page; else of one page.
    """
    if a[0] == TEXT:
        same = set(a[4]) & set(b[4]) if across else {*a[4], *b[4]}
        return [TEXT, a[1] | b[1], a[2] + b[2], a[3] + b[3], sorted(same)]
    return [a[0], a[1] | b[1], merge_rows(a[2], b[2], across)]


def _optional(item: list, across: bool) -> list:
    """An item that some pages lack has no text that every page has."""
    if item[0] == TEXT:
        return [TEXT, item[1] | OPTIONAL, *item[2:4], [] if across else item[4]]
    return [item[0], item[1] | OPTIONAL, [_optional(x, across) for x in item[2]]]


def merge_rows(a: list, b: list, across: bool = True) -> list:
    out = []
    for i, j in pairs([x[0] for x in a], [x[0] for x in b]):
        out.append(_optional(b[j], across) if i is None else _optional(a[i], across) if j is None else merge(a[i], b[j], across))
    return out


def merge_wrappers(a: dict, b: dict) -> dict:
    return {"pages": a["pages"] + b["pages"], "seen": sorted({*a["seen"], *b["seen"]})[:4], "items": merge_rows(a["items"], b["items"])}


class Learner:
    """The wrappers of the pages added so far, by host; pages of one shape are summed before they are merged."""

    def __init__(self):
        self.shapes: dict[tuple[str, tuple], list] = {}

    def add(self, host: str, page: str | None) -> None:
        shape, places = parse(page)
        if not shape:
            return
        hashes = [{xxhash.xxh64_intdigest(t) for _, t, _ in p} for p in places]
        stats = [[sum(len(t) for _, t, _ in p), sum(k for *_, k in p), h] for p, h in zip(places, hashes, strict=True)]
        seen = xxhash.xxh64_intdigest(repr([sorted(h) for h in hashes]))
        old = self.shapes.get((host, shape))
        if old is None:
            self.shapes[host, shape] = [1, [seen], stats]
            return
        old[0] += 1
        old[1] = sorted({*old[1], seen})[:4]
        for o, s in zip(old[2], stats, strict=True):
            o[0] += s[0]
            o[1] += s[1]
            o[2] &= s[2]

    def take(self) -> list[tuple[str, str]]:
        """(host, wrapper as JSON), and forget them."""
        found: dict[str, dict] = {}
        for (host, shape), (pages, seen, stats) in sorted(self.shapes.items(), key=lambda x: repr(x[0])):
            own = {"pages": pages, "seen": seen, "items": items_of(shape, iter([[n, k, sorted(h)] for n, k, h in stats]))}
            found[host] = merge_wrappers(found[host], own) if host in found else own
        self.shapes = {}
        return [(host, json.dumps(w, separators=(",", ":"))) for host, w in found.items()]


def _chars(items: list, passed) -> int:
    """Characters of text outside links, without the elements that are passed over."""
    return sum(x[2] - x[3] if x[0] == TEXT else 0 if passed(x) else _chars(x[2], passed) for x in items)


def _heads(item: list) -> bool:
    """Is there a first-level heading or a main element inside?"""
    return any(x[0] != TEXT and (x[0][:1] == "+" or x[0].split(".")[0] == "h1" or _heads(x)) for x in item[2])


class Wrapper:
    """A host's wrapper, judged: which of its text places are main text, and which texts belong to the template.

    Marked elements are passed over, but for one that holds four fifths of the text and a heading or main element, or
    all of the text. If the elements marked as main hold a quarter of the rest, only they count; else the descent goes
    into the child that holds three fifths of the text for as long as there is one without text of its own. An element
    that its names only maybe mark stays where it stands inside the main text and reads as prose: it has texts of SHARED
    characters on average, mostly outside links, that differ from page to page. Texts mostly made of links are passed
    over; in a main element only short ones do, in places that have mostly such, as longer ones are references. A text
    that each of three or more different pages has belongs to the template. Where such texts are more than three tenths
    of a page's, and its first-level heading is one of them, its host has near copies of one article, and they stay;
    without such headings only short ones that are no heading count as template there.
    """

    def __init__(self, data: dict):
        self.items, self.pages = data["items"], max(1, data["pages"])
        self.template = len(data["seen"]) > 2
        whole, self.opened = _chars(self.items, lambda x: False), set()
        marked = lambda x: x[0][:1] in ("-", "~", "^")
        bare = not _chars(self.items, marked)

        def open_up(items: list) -> None:
            for x in items:
                if x[0] != TEXT and 5 * _chars([x], lambda y: False) >= 4 * whole:
                    if marked(x) and (_heads(x) or bare):
                        self.opened.add(id(x))
                    open_up(x[2])

        if whole:
            open_up(self.items)
        rest = _chars(self.items, self.passed)
        main = self._main(self.items)
        self.region: list | None = main if main and 4 * sum(_chars([x], self.passed) for x in main) >= rest else None
        self.marked = self.region is not None
        if self.region is None:
            row, at = self.items, None
            holds = lambda x: x[0] != TEXT and not self.passed(x) and not x[1] & REPEATED and all(y[0] != TEXT for y in x[2])
            while step := next((x for x in row if holds(x) and 5 * _chars([x], self.passed) >= 3 * rest), None):
                row, at = step[2], step
            self.region = None if at is None else [at]
        titles = [t for x in self._titles(self.items) for t in x[2] if t[0] == TEXT]
        self.one_title = all(t[4] for t in titles) if titles else None  # do all pages have the same?
        self.known: dict[tuple, list[tuple[bool, bool, bool, frozenset]]] = {}

    def _titles(self, items: list) -> list:
        return [y for x in items if x[0] != TEXT and not self.passed(x) for y in ([x] if x[0].split(".")[0] == "h1" else self._titles(x[2]))]

    def passed(self, item: list) -> bool:
        return item[0][:1] in ("-", "~", "^") and id(item) not in self.opened

    def _prose(self, item: list) -> bool:
        """Does a part that may stand beside the main text read as a part of it?"""
        texts, shared = [], 0
        rows = [item[2]]
        while rows:
            for x in rows.pop():
                if x[0] != TEXT:
                    rows.append(x[2])
                elif x[2]:
                    texts.append(x)
                    shared += bool(x[4]) and self.template
        long = [x for x in texts if x[2] >= SHARED * (1 if x[1] & OPTIONAL else self.pages)]
        return bool(long) and 2 * sum(x[3] for x in texts) < sum(x[2] for x in texts) and 2 * shared <= len(texts)

    def _main(self, items: list) -> list:
        out = []
        for x in items:
            if x[0] != TEXT and not self.passed(x):
                out += [x] if x[0][:1] == "+" else self._main(x[2])
        inner = [y for x in out for y in self._main(x[2])]
        return inner if inner and 4 * sum(_chars([y], self.passed) for y in inner) >= 3 * sum(_chars([x], self.passed) for x in out) else out

    def places(self, shape: tuple) -> list[tuple[bool, bool, bool, frozenset]]:
        """For each text place of a page's shape: is it main text, mostly of links, in a heading; the template's texts there."""
        if shape not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            self.known[shape] = list(self._match(shape, self.items, self.region is None, False, False, False))
        return self.known[shape]

    def _match(self, shape: tuple, items: list, inside: bool, out: bool, header: bool, title: bool, heading: bool = False) -> Iterator[tuple[bool, bool, bool, frozenset]]:
        """Align a page's elements with the wrapper's items, both folded, and judge the texts."""
        labels = [TEXT if s == TEXT else s[0] for s in shape]
        mine, flat = [], []  # labels that repeat in a row count once
        for i, x in enumerate(labels):
            if not mine or x != mine[-1]:
                mine.append(x)
                flat.append([])
            flat[-1].append(i)
        spread = [(x[0], x, x) if x[0] else (y[0], y, x) for x in items for y in (x[2] if not x[0] else [x])]
        partner: list = [None] * len(shape)
        again = dict(self._groups(labels, items))
        for i, j in pairs(mine, [s[0] for s in spread]):
            if i is not None and j is not None:
                for k in flat[i]:
                    partner[k] = spread[j][1]
        for k, s in enumerate(shape):
            p = partner[k] or again.get(k)
            if s == TEXT:
                linked = p is not None and 2 * p[3] > p[2]
                yield (inside or title) and not out and (not header or title), linked, heading, frozenset(p[4] if p else ())
                continue
            mark, closed = s[0][0], p is None or id(p) not in self.opened
            if mark == "~":
                closed = closed and not (inside and p is not None and self._prose(p))
                mark = "-"
            yield from self._match(
                s[1], p[2] if p else [], inside or p is not None and self.region is not None and any(p is r for r in self.region) or p is None and mark == "+",
                out or mark == "-" and closed, header or mark == "^" and closed, title or s[0].split(".")[0] == "h1", heading or s[0].split(".")[0] in HEADINGS,
            )

    @staticmethod
    def _groups(labels: list[str], items: list) -> Iterator[tuple[int, list]]:
        """Partners in repeated groups, for elements that the alignment leaves without one."""
        known = {y[0]: y for x in items if not x[0] for y in x[2]} | {x[0]: x for x in reversed(items) if x[0]}
        return ((i, known[x]) for i, x in enumerate(labels) if x in known)

    def text(self, page: str | None) -> str:
        shape, found = parse(page)
        blocks, fixed, total = [], 0, 0
        for (main, links, heading, template), texts in zip(self.places(shape), found, strict=True):
            if main:
                for place, text, linked in texts:
                    if 2 * linked > len(text) and (not self.marked or links and len(text) < REFERENCE):
                        continue
                    same = self.template and bool(template) and xxhash.xxh64_intdigest(text) in template
                    blocks.append((place, text, same, same and len(text) < SHARED and not heading))
                    fixed += len(text) if same else 0
                    total += len(text)
        copies = 10 * fixed > 3 * total and self.one_title is not False  # near copies share more than a template has
        return "\n\n".join(t for _, t, same, short in sorted(blocks) if not (not self.one_title and short if copies else same))


def wrappers(pages: DataFrame, cut: Cut, held: int = 2000, salts: int = 16) -> DataFrame:
    """(host string, wrapper string), one for each host, from (host, html) of all pages.

    Each task merges its own pages, so a host gives a task's output one row for every ``held`` shapes; those rows are
    merged by host and salt and then by host. So no task sees all pages of a host that has very many.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner()

        def out() -> pa.RecordBatch:
            rows = learner.take()
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], names=["host", "wrapper"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                learner.add(host, page)
                if len(learner.shapes) >= held:
                    yield out()
        yield out()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(group["wrapper"])
        one = json.loads(rows[0])
        for row in rows[1:]:
            one = merge_wrappers(one, json.loads(row))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(one, separators=(",", ":"))]})

    parts = pages.where("host IS NOT NULL AND host != ''").select("host", "html").mapInArrow(learn, "host string, wrapper string")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    salted = parts.groupBy("host", "salt").applyInPandas(join, "host string, wrapper string")
    return cut(salted.groupBy("host").applyInPandas(join, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, most_broadcast: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages (page_id, url, html): the main text of the whole html.

    Wrappers are inferred from all pages of a host, each page's text is read through its host's wrapper. Blocks are in
    page order, joined by two newlines; within a block white space is one space and character references are decoded.
    The wrappers are broadcast if they have at most ``most_broadcast`` bytes, else joined by host, where Spark can
    split a host with very many pages. Pages without a host (null or odd url) are read through a wrapper of their own.

    Null and empty html, and pages without main text, give the empty string. Null page_id and url stay null, repeated
    rows come out as often as they went in, an empty table gives no rows, other columns are left out. Unmarked elements
    nested deeper than 80 count as part of the one around them, marked ones at any depth are told apart.
    """
    cut = Cut(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    known = wrappers(plain, cut).withColumnRenamed("host", "of")
    size = known.agg(F.sum(F.length("wrapper") + F.length("of"))).first()[0] or 0
    joined = plain.join(F.broadcast(known) if size <= most_broadcast else known, F.col("host") == F.col("of"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for page, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if wrapper is None:
                    learner = Learner()
                    learner.add("", page)
                    own = learner.take()
                    out.append(Wrapper(json.loads(own[0][1])).text(page) if own else "")
                    continue
                if wrapper not in judged:
                    if len(judged) > 500:
                        judged.clear()
                    judged[wrapper] = Wrapper(json.loads(wrapper))
                out.append(judged[wrapper].text(page))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
