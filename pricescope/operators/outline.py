"""A page's elements and texts in order. An element is a range of elements and of texts, so that nothing is copied or searched for it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "svg"}
STRUCK = {"del", "s", "strike"}
#: Elements whose contents a parser reads in another way.
RAW = {"script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}
#: Text, end tag, start tag and its attributes of plain markup, and anything else: character references, comments, raw values, stray signs.
_NAME, _SPACE = r"[a-zA-Z][a-zA-Z0-9-]*", r"[ \t\n\r\f]"
_TOKENS = re.compile(rf"""([^<&]+)|</({_NAME}){_SPACE}*>|<({_NAME})((?:{_SPACE}+{_NAME}(?:="[^"<>&]*"|='[^'<>&]*')?)*){_SPACE}*>|(.)""", re.S)
_GIVEN = re.compile(rf"""({_NAME})(?:="([^"]*)"|='([^']*)')?""")


@dataclass(slots=True)
class Element:
    """``parent`` is -1 at the top; ``end`` is the first element behind those inside, ``text_end`` the first text behind."""

    tag: str
    given: dict[str, str]
    parent: int
    text_start: int
    end: int = -1
    text_end: int = -1
    names: set[str] = field(default_factory=set)

    @property
    def classes(self) -> str:
        return self.given.get("class", "")

    @property
    def id(self) -> str:
        return self.given.get("id", "")

    @property
    def hint(self) -> str:
        return f"{self.tag} {self.classes} {self.id}"


class Outline(HTMLParser):
    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        if not self._read_plain(html):
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
        self._end(0)

    def _read_plain(self, html: str) -> bool:
        """Whether a page has plain markup alone, and then its tags and texts as the parser would give them, found by one pattern."""
        found = _TOKENS.findall(html)
        if any(other or start.lower() in RAW for _, _, start, _, other in found):
            return False
        for text, end, start, given, _ in found:
            if text:
                self.handle_data(text)
            elif end:
                self.handle_endtag(end.lower())
            else:
                self.handle_starttag(start.lower(), [(k.lower(), a or b) for k, a, b in _GIVEN.findall(given)] if given else [])
        return True

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        e = Element(tag, given, self.open[-1] if self.open else -1, len(self.texts), names=set(given.get("class", "").split()))
        self.elements.append(e)
        if tag in VOID:
            e.end, e.text_end = len(self.elements), len(self.texts)
        else:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[i]].tag == tag:
                self._end(i)
                break

    def handle_data(self, data):
        if not (self.open and self.elements[self.open[-1]].tag in HIDDEN):
            self.texts.append(data)

    def _end(self, depth: int) -> None:
        """Close the open elements from a depth on."""
        for i in self.open[depth:]:
            self.elements[i].end, self.elements[i].text_end = len(self.elements), len(self.texts)
        del self.open[depth:]

    def inside(self, i: int) -> range:
        """The elements in an element, by number."""
        return range(i + 1, self.elements[i].end)

    def around(self, i: int) -> list[Element]:
        """The elements around an element, the nearest first."""
        found, at = [], self.elements[i].parent
        while at >= 0:
            found.append(self.elements[at])
            at = self.elements[at].parent
        return found

    def marked(self, test) -> list[bool]:
        """For each element, whether it or one around it passes a test. Each is tested once."""
        out: list[bool] = []
        for e in self.elements:
            out.append((e.parent >= 0 and out[e.parent]) or bool(test(e)))
        return out

    def text(self, i: int | None, without: list[int] | None = None, between: str = "") -> str:
        """The text of an element (None: of the whole page), but for that of elements in it, with white space collapsed."""
        start, end = (0, len(self.texts)) if i is None else (self.elements[i].text_start, self.elements[i].text_end)
        parts, at = [], start
        for j in sorted(without or [], key=lambda j: self.elements[j].text_start):
            e = self.elements[j]
            if e.text_end > at:
                parts += self.texts[at : max(at, e.text_start)]
                at = max(at, e.text_end)
        parts += self.texts[at:end]
        return " ".join(between.join(parts).split())
