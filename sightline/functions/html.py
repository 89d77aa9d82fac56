"""Saved pages: one pass over the markup for titles, text, links and structured data.

Markup is read once into a list of events, of which each fact is a function of its
own. That is an Arrow-batched Python function which returns one struct for each
page; everything after it is expressions again.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S


def _struct(texts: str, **more: S.DataType) -> S.StructType:
    return S.StructType([S.StructField(c, S.StringType()) for c in texts.split()] + [S.StructField(c, t) for c, t in more.items()])


LINK = _struct("target anchor rel location")
BLOCK = _struct("error headline", at=S.IntegerType(), types=S.ArrayType(S.StringType()), has_context=S.BooleanType(), is_object=S.BooleanType(), relative=S.ArrayType(S.StringType()))
PAGE = _struct("title h1 visible_text content_text canonical robots lang warning", links=S.ArrayType(LINK), blocks=S.ArrayType(BLOCK))

# Tags whose text is not visible, and tags without an end.
HIDDEN = frozenset({"script", "style", "noscript", "template", "svg"})
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_PAGES = ("mailto:", "tel:", "javascript:", "data:")
LINKED_KEYS = ("url", "image", "logo", "sameAs")


def squeezed(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


class Event(NamedTuple):
    """What the markup does next: a tag opens or closes, or text comes, with where that is."""

    kind: str  # "open", "close", or a text's home: "title", "data" (of a JSON-LD script), "body"
    value: str  # the tag's name, or the text
    given: dict  # an opening tag's attributes
    place: str  # footer, nav or content
    shown: bool
    top: bool  # nothing is open around it


class Events(HTMLParser):
    """Markup as a list of events. Tag soup is mended in one way only: a closing tag closes what is open inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []
        self.path: list[str] = []
        self.hidden, self.home = 0, "body"

    def emit(self, kind: str, value: str, given: dict | None = None) -> None:
        place = "footer" if "footer" in self.path else "nav" if "nav" in self.path else "content"
        self.events.append(Event(kind, value, given or {}, place, not self.hidden, not self.path))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {name.lower(): text or "" for name, text in attrs}
        if tag not in EMPTY:
            at_top = not self.path
            self.path.append(tag)
        else:
            at_top = not self.path
        self.emit("open", tag, given)
        self.events[-1] = self.events[-1]._replace(top=at_top)
        self.hidden += tag in HIDDEN
        if is_data(self.events[-1]):
            self.home = "data"
        elif tag == "title" and self.home == "body":
            self.home = "title"

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= bool(self.hidden) and tag in HIDDEN
        if (tag, self.home) in (("script", "data"), ("title", "title")):
            self.home = "body"
        self.emit("close", tag)
        if tag in self.path:
            last = len(self.path) - 1 - self.path[::-1].index(tag)
            del self.path[last:]

    def handle_data(self, data: str) -> None:
        self.emit(self.home, data)


def is_data(e: Event) -> bool:
    return e.kind == "open" and e.value == "script" and e.given.get("type", "").strip().lower() == "application/ld+json"


def opened(events: list[Event], *tags: str) -> Iterator[Event]:
    return (e for e in events if e.kind == "open" and e.value in tags)


def last(values: Iterator[str]) -> str:
    return next(iter(deque(values, maxlen=1)), "")


def title_of(events: list[Event]) -> str:
    return squeezed([e.value for e in events if e.kind == "title"])


def heading_of(events: list[Event]) -> str:
    """Text of the first h1, up to its end or, if it never closes, the page's."""
    start = next((k for k, e in enumerate(events) if e.kind == "open" and e.value == "h1"), len(events))
    end = next((k for k in range(start, len(events)) if events[k].kind == "close" and events[k].value == "h1"), len(events))
    return squeezed([e.value for e in events[start:end] if e.kind == "body"])


def texts_of(events: list[Event]) -> tuple[str, str]:
    """All visible text, and what of it is neither navigation nor footer."""
    seen = [(e.place, " ".join(e.value.split())) for e in events if e.kind == "body" and e.shown]
    return " ".join(t for _, t in seen if t), " ".join(t for place, t in seen if t and place == "content")


def blocks_of(events: list[Event]) -> list[str]:
    """The contents of JSON-LD scripts that close."""
    out, held = [], None
    for e in events:
        if is_data(e):
            held = []
        elif held is not None and e.kind == "data":
            held.append(e.value)
        elif held is not None and (e.kind, e.value) == ("close", "script"):
            out.append("".join(held).strip())
            held = None
    return out


def links_of(events: list[Event], base: str) -> list[dict]:
    """Anchors with an address of a page, from where they open to the next closing tag; anchors inside are part of their text."""
    out, here, words = [], None, []
    for e in events:
        if here is None:
            href = e.given.get("href", "").strip() if (e.kind, e.value) == ("open", "a") else ""
            if e.given.get("href") and not href.startswith("#") and not href.lower().startswith(NOT_PAGES) and e.value == "a":
                here, words = {"target": urljoin(base, href), "rel": e.given.get("rel", ""), "location": e.place}, []
        elif e.kind == "body":
            words.append(e.value)
        elif (e.kind, e.value) == ("open", "img"):
            words.append(e.given.get("alt", ""))
        elif (e.kind, e.value) == ("close", "a"):
            out.append(here | {"anchor": squeezed(words)})
            here = None
    return out


def schema_types(node: object) -> list[str]:
    """Every @type of a JSON-LD tree, a node's own before its children's."""
    found, todo = [], [node]
    while todo:
        here = todo.pop()
        if isinstance(here, dict):
            own = here.get("@type")
            found += [t for t in (own if isinstance(own, list) else [own]) if isinstance(t, str)]
            todo += reversed(list(here.values()))
        elif isinstance(here, list):
            todo += reversed(here)
    return found


def schema_links(node: object) -> list[str]:
    """key=value of every url, image, logo and sameAs string that is not absolute."""
    found, todo = [], [(None, node)]
    while todo:
        key, here = todo.pop()
        if key in LINKED_KEYS:
            for v in here if isinstance(here, list) else [here]:
                if isinstance(v, str) and v and not v.startswith(("http://", "https://", "#")):
                    found.append(f"{key}={v[:180]}")
        if isinstance(here, dict):
            todo += reversed(list(here.items()))
        elif isinstance(here, list):
            todo += [(None, v) for v in reversed(here)]
    return found


def block_facts(at: int, raw: str) -> dict:
    facts = {"at": at, "error": None, "types": [], "has_context": False, "is_object": False, "headline": None, "relative": []}
    if not raw:
        return facts | {"error": f"JSON-LD block {at} is empty"}
    try:
        data = json.loads(raw)
        facts["types"], facts["relative"] = schema_types(data), schema_links(data)
    except (ValueError, RecursionError) as e:
        return facts | {"error": f"JSON-LD block {at}: {e}"}
    if isinstance(data, dict):
        headline = data.get("headline") or data.get("name")
        facts |= {"is_object": True, "has_context": "@context" in data, "headline": str(headline) if headline else None}
    return facts


def page_facts(html: str | None, base: str | None) -> dict:
    """A page's facts. Of several canonical links or robots tags the last counts; the language is that of an outermost html."""
    base, page, warning = base or "", Events(), None
    try:
        page.feed(html or "")
    except Exception as e:  # noqa: BLE001  whatever the markup does, what was read so far counts
        warning = str(e)
    events = page.events
    visible, content = texts_of(events)
    try:
        links = links_of(events, base)
        canonical = last(urljoin(base, e.given["href"]) for e in opened(events, "link") if e.given.get("href") and "canonical" in e.given.get("rel", "").lower().split())
    except ValueError as e:  # an address that cannot be joined
        links, canonical, warning = [], "", warning or str(e)
    return {
        "title": title_of(events), "h1": heading_of(events), "visible_text": visible, "content_text": content, "canonical": canonical,
        "robots": last(e.given.get("content", "") for e in opened(events, "meta") if e.given.get("name", "").lower() == "robots"),
        "lang": last(e.given.get("lang", "").strip() for e in opened(events, "html") if e.top), "warning": warning, "links": links,
        "blocks": [block_facts(k, raw) for k, raw in enumerate(blocks_of(events))],
    }


#: Characters of markup whose facts are told at once: facts as Python objects take many times the markup's memory.
TOLD = 1 << 18


@F.pandas_udf(PAGE)
def parse_page(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    told = lambda facts: pd.DataFrame(facts, columns=PAGE.names)
    for html, base in parts:
        facts, seen = [], 0
        for h, b in zip(html, base, strict=True):
            facts.append(page_facts(h, b))
            seen += len(h or "") + 256
            if seen >= TOLD:
                yield told(facts)
                facts, seen = [], 0
        if facts:
            yield told(facts)
