"""One captured page as a flat, document-ordered view of its elements.

A small per-row helper for the HTML jobs in ``tidings.operators.pages``; the
jobs decide what runs where.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = frozenset(("script", "style", "template"))
# A start tag ends an open element of one of these names on top of the stack.
_ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6"
       " header hr main nav ol p pre section table ul".split()},
}
# An end tag reaches an open element only across elements of no higher rank.
_RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "tbody": 4, "thead": 4, "tfoot": 4,
         "table": 5, "head": 6, "body": 6, "html": 7}


class Page(HTMLParser):
    """Elements by index in document order, each with the span of its subtree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parents: list[int] = []
        self.ends: list[int] = []        # first element index after the subtree
        self.texts: list[str] = []       # text nodes in document order
        self.owners: list[int] = []      # element each text node stands in
        self.text_from: list[int] = []
        self.text_to: list[int] = []
        self._open: list[int] = []
        # Places in ``_open`` by tag and by rank, so that an end tag needs no search.
        self._places: dict[str, list[int]] = {}
        self._ranked: list[list[int]] = [[] for _ in range(max(_RANK.values()) + 1)]
        self._pending: list[str] = []
        self._inside: dict[str, list[bool]] = {}
        self.feed(html)
        self.close()
        self._flush()
        while self._open:
            self._end_top()

    # -- building ---------------------------------------------------------
    def handle_data(self, data):
        self._pending.append(data)

    def _flush(self, *_):
        if self._pending:
            self.texts.append("".join(self._pending))
            self.owners.append(self._open[-1] if self._open else -1)
            self._pending.clear()

    handle_comment = handle_decl = handle_pi = unknown_decl = _flush

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            # A declaration that cannot be read is text; the page goes on behind its mark.
            self.handle_data(self.rawdata[i:i + 2])
            return i + 2

    def handle_starttag(self, tag, attrs):
        self._flush()
        ended = _ENDED_BY.get(tag, ())
        while self._open and self.tags[self._open[-1]] in ended:
            self._end_top()
        self.parents.append(self._open[-1] if self._open else -1)
        self._places.setdefault(tag, []).append(len(self._open))
        self._ranked[_RANK.get(tag, 0)].append(len(self._open))
        self._open.append(len(self.tags))
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.ends.append(0)
        self.text_from.append(len(self.texts))
        self.text_to.append(0)
        if tag in _VOID:
            self._end_top()

    def handle_endtag(self, tag):
        self._flush()
        places = self._places.get(tag)
        above = self._ranked[_RANK.get(tag, 0) + 1:]
        if places and all(not ranked or ranked[-1] < places[-1] for ranked in above):
            depth = places[-1]
            while len(self._open) > depth:
                self._end_top()

    def _end_top(self):
        i = self._open.pop()
        self._places[self.tags[i]].pop()
        self._ranked[_RANK.get(self.tags[i], 0)].pop()
        self.ends[i] = len(self.tags)
        self.text_to[i] = len(self.texts)

    # -- reading ----------------------------------------------------------
    def stripped_text(self, i: int) -> str:
        """Text nodes below an element, each trimmed, put together without spaces."""
        return "".join(t.strip() for t in self.texts[self.text_from[i]:self.text_to[i]])

    def title(self) -> str | None:
        return self.stripped_text(self.tags.index("title")) if "title" in self.tags else None

    def visible_text(self, junk: list[Selector]) -> str:
        """Text outside junk elements, spaces squashed."""
        # Most elements have no attributes, so most selectors need no test.
        by_tag = {s.steps[0][0] for s in junk if s.is_tag}
        by_attrs = [s for s in junk if s.steps[-1][1]]
        others = [s for s in junk if not s.is_tag and not s.steps[-1][1]]
        kept, at, i = [], 0, 0
        while i < len(self.tags):
            tests = by_attrs + others if self.attrs[i] else others
            if self.tags[i] in by_tag or any(s.matches(self, i) for s in tests):
                kept += range(at, self.text_from[i])
                at, i = self.text_to[i], self.ends[i]
            else:
                i += 1
        kept += range(at, len(self.texts))
        names = self.tags
        shown = (self.texts[k] for k in kept if self.owners[k] < 0 or names[self.owners[k]] not in _NO_TEXT)
        return " ".join(" ".join(shown).split())

    def where(self, test) -> list[int]:
        return [i for i in range(len(self.tags)) if test(self, i)]

    def within(self, hits: list[int], i: int) -> int | None:
        """First of the ascending ``hits`` strictly below element ``i``."""
        return self.following(hits, i + 1, self.ends[i])

    @staticmethod
    def following(hits: list[int], start: int, stop: int | None = None) -> int | None:
        k = bisect_left(hits, start)
        return hits[k] if k < len(hits) and (stop is None or hits[k] < stop) else None

    def ancestors(self, i: int, count: int):
        for _ in range(count):
            i = self.parents[i]
            if i < 0:
                return
            yield i

    def inside(self, step) -> list[bool]:
        """For every element whether one above it matches the step; one pass from the top, kept."""
        key = repr(step)
        if key not in self._inside:
            own = [Selector._step_matches(step, tag, attrs) for tag, attrs in zip(self.tags, self.attrs)]
            found: list[bool] = []
            for parent in self.parents:
                found.append(parent >= 0 and (own[parent] or found[parent]))
            self._inside[key] = found
        return self._inside[key]

    def time_text(self, i: int | None) -> str:
        """``datetime`` of a ``<time>``, else its text."""
        return "" if i is None else self.attrs[i].get("datetime") or self.stripped_text(i)

    def published_meta(self) -> str:
        for i, tag in enumerate(self.tags):
            if tag == "meta" and self.attrs[i].get("property") == "article:published_time":
                return self.attrs[i].get("content", "")
        return ""


class Selector:
    """``tag``, ``.class``, ``#id``, ``[attr*='x']`` and their compounds, at most one descendant step."""

    _STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+\*?=(?:'[^']*'|\"[^\"]*\"|[\w-]+)\])*)$")
    _PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(\*?)=['\"]?([^'\"\]]*)['\"]?\]")

    def __init__(self, text: str):
        steps = text.split()
        if not 1 <= len(steps) <= 2:
            raise ValueError(f"unsupported selector: {text!r}")
        self.steps = [self._read(s) for s in steps]
        self.is_tag = len(steps) == 1 and not self.steps[0][1] and self.steps[0][0] != "*"

    @classmethod
    def _read(cls, step):
        m = cls._STEP.match(step)
        if not m or not step:
            raise ValueError(f"unsupported selector: {step!r}")
        tag = (m.group(1) or "*").lower()
        return tag, [p.groups() for p in cls._PART.finditer(m.group(2))]

    @staticmethod
    def _step_matches(step, tag, attrs):
        name, parts = step
        if name != "*" and name != tag:
            return False
        for mark, word, attr, contains, value in parts:
            if mark == ".":
                if word not in attrs.get("class", "").split():
                    return False
            elif mark == "#":
                if attrs.get("id") != word:
                    return False
            elif attr not in attrs or not (value in attrs[attr] if contains and value else attrs[attr] == value):
                return False
        return True

    def matches(self, page: Page, i: int) -> bool:
        if not self._step_matches(self.steps[-1], page.tags[i], page.attrs[i]):
            return False
        return len(self.steps) == 1 or page.inside(self.steps[0])[i]


def selectors(texts) -> list[Selector]:
    """Selectors of a list; an unreadable one is left out and the others still count."""
    out = []
    for text in texts:
        try:
            out.append(Selector(text.strip()))
        except (ValueError, AttributeError):
            continue
    return out


_RNS_DATE = re.compile("date")


def _date_classes(pattern: re.Pattern):
    return lambda page, i: page.tags[i] in ("span", "div") and pattern.search(page.attrs[i].get("class", ""))


def rns_items(html: str, epic: str | None) -> dict:
    """Anchors of an issuer's news list with the date text nearest to each; none without an issuer.

    ``texts`` has each date text of the page once; an item's ``date`` points into it.
    """
    if not epic:
        return {"texts": [], "items": []}
    page = Page(html)
    needles = (f"/news-article/{epic.upper()}/", f"/news-article/{epic.lower()}/")
    times = page.where(lambda p, i: p.tags[i] == "time")
    dated = page.where(_date_classes(_RNS_DATE))
    texts: dict[str, int] = {}
    read: dict[int | None, str] = {None: ""}

    def shown(i: int | None, text) -> str:
        if i not in read:
            read[i] = text(i)
        return read[i]

    items = []
    for i, tag in enumerate(page.tags):
        href = page.attrs[i].get("href", "") if tag == "a" else ""
        title = any(n in href for n in needles) and page.stripped_text(i)
        if title:
            near = ""
            for up in page.ancestors(i, 4):
                near = shown(page.within(times, up), page.time_text) or shown(page.within(dated, up), page.stripped_text)
                if near:
                    break
            items.append({"href": href, "title": title, "date": texts.setdefault(near, len(texts)) if near else None})
    return {"texts": list(texts), "items": items}


def ir_items(html: str, base: str, item_selectors, date_selector, date_class: str, join) -> dict:
    """Anchors of an IR page in selector order, first occurrence of an address only.

    ``texts`` has each date text of the page once; an item's ``dates`` point into
    it in order of preference, and the caller takes the first that is a date. An
    address that cannot be resolved stays as it is written, with ``resolved`` false.
    """
    page = Page(html)
    times = page.where(lambda p, i: p.tags[i] == "time")
    dated = page.where(_date_classes(re.compile(date_class)))
    chosen = [s for s in selectors([date_selector]) if date_selector]
    custom = page.where(chosen[0].matches) if chosen else []
    meta = page.published_meta()
    anchors = [i for i, tag in enumerate(page.tags) if tag == "a" and page.attrs[i].get("href")]
    texts: dict[str, int] = {}
    read: dict[int, str] = {}

    def text(i: int | None) -> str:
        if i is None:
            return ""
        if i not in read:
            read[i] = page.stripped_text(i)
        return read[i]

    items, seen = [], set()
    for rank, selector in enumerate(selectors(item_selectors)):
        for i in anchors:
            if not selector.matches(page, i):
                continue
            title, url, resolved = text(i), page.attrs[i]["href"], True
            try:
                url = join(base, url)
            except ValueError:
                resolved = False
            if not title or url in seen:
                continue
            seen.add(url)
            near = [text(page.following(custom, i + 1))]
            for up in page.ancestors(i, 3):
                near += [page.time_text(page.within(times, up)), text(page.within(dated, up))]
            dates = [texts.setdefault(t, len(texts)) for t in dict.fromkeys([*near, meta]) if t]
            items.append({"selector_rank": rank, "url": url, "title": title, "resolved": resolved, "dates": dates})
    return {"texts": list(texts), "items": items}


def detail_date_text(html: str) -> str | None:
    """Date text of an article page: its first ``<time>``, else its published meta."""
    page = Page(html)
    first = page.tags.index("time") if "time" in page.tags else None
    return page.time_text(first) or page.published_meta() or None
