"""Streaming reading of page payloads into visible lines.

One pass over the standard library's parser events turns a payload into *lines*: the visible
text between two block-level tags, entities decoded, white space runs made one blank. Each line
carries what later stages weigh: how many tags stand in it, how many of its characters are link
text, which block holds it, and whether it is sample code.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from typing import NamedTuple

# Elements of HTML that begin and end lines.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe "
    "legend li main menu nav noscript ol optgroup option p pre script section select style summary table "
    "tbody td template tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = frozenset(("head", "script", "style", "noscript", "template"))
KNOWN_TAGS = sorted(BLOCK_TAGS | frozenset("a abbr b code em font i img input label link meta small span strong sub sup u".split()))
HEADING_TAGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CODE_TAGS = frozenset(("pre", "code", "kbd", "samp"))

#: A payload is HTML when it has at least one tag of a known element, a comment or a doctype.
HTML_MARK = re.compile(r"<(?:!doctype\b|!--|/?(?:%s)(?=[\s/>]))" % "|".join(KNOWN_TAGS), re.I)
#: The same test for Spark's regular expressions.
HTML_MARK_SQL = r"(?i)<(?:!doctype\b|!--|/?(?:%s)(?=[\s/>]))" % "|".join(KNOWN_TAGS)


_START = re.compile(r"<([a-zA-Z][^\t\n\r\f />\x00<]*)(?:[^<>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*?(/?)>")


_END = re.compile(r"</([a-zA-Z][^\t\n\r\f />\x00<]*)\s*>")


class Line(NamedTuple):
    """A visible line of a payload."""

    text: str
    block: str  # innermost open block-level element
    tags: int  # tags seen since the line before
    linked: int  # characters inside links
    code: bool  # wholly inside sample code
    plain: str | None = None  # the text without its sample code, where only a part is that


class _LineReader(HTMLParser):
    """Collects lines from parser events; a page is never held as a tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.title = ""
        self.notice = ""
        self._parts: list[str] = []
        self._prose: list[str] = []
        self._open: list[str] = []
        self._hidden = ""
        self._in_title = False
        self._tags = self._linked = self._code = self._plain = 0
        self._link = self._sample = 0

    def goahead(self, end: bool) -> None:
        """Reads text, tags, comments and declarations in one loop; what is odd or may not be whole is left, with all after it, to the library."""
        raw, i = self.rawdata, 0
        while True:
            if self.cdata_elem is None:
                j = raw.find("<", i)
            else:
                m = self.interesting.search(raw, i)
                j = m.start() if m else -1
            if j < 0:
                break
            after = raw[j + 1 : j + 2]
            if after == "/":
                m = _END.match(raw, j) if self.cdata_elem is None else None
            elif after == "!":
                if self.cdata_elem is not None:
                    break
                m = None
            else:
                m = _START.match(raw, j) if self.cdata_elem is None else None
                if m is None:
                    break
            if i < j:
                text = raw[i:j]
                self.handle_data(html.unescape(text) if "&" in text and self.cdata_elem is None else text)
            i = j
            if m is None:
                k = self.parse_endtag(j) if after == "/" else self.parse_comment(j) if raw.startswith("<!--", j) else self.parse_html_declaration(j)
                if k < 0:
                    break
                i = k
                continue
            tag = m[1].lower()
            if after == "/":
                self.handle_endtag(tag)
            elif m[2]:
                self.handle_startendtag(tag, [])
            else:
                self.handle_starttag(tag, [])
                if tag in self.CDATA_CONTENT_ELEMENTS:
                    self.set_cdata_mode(tag)
            i = m.end()
        self.rawdata = raw[i:]
        super().goahead(end)

    def parse_starttag(self, i: int) -> int:
        """Reads a start tag without its attributes, which no line needs; odd ones are left to the library."""
        m = _START.match(self.rawdata, i)
        if m is None:
            return super().parse_starttag(i)
        tag = m[1].lower()
        if m[2]:
            self.handle_startendtag(tag, [])
        else:
            self.handle_starttag(tag, [])
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers, which nothing here asks for, aren't counted."""
        return j

    def _end_line(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts.clear()
            if text:
                block = self._open[-1] if self._open else ""
                mixed = " ".join("".join(self._prose).split()) if self._code and self._plain else None
                self.lines.append(Line(text, block, self._tags, min(self._linked, len(text)), self._code > 0 and self._plain == 0, mixed))
                self._tags = 0
            self._linked = self._code = self._plain = 0
            self._prose.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._hidden:
            if tag == "title" and self._hidden == "head":
                self._in_title = True
            elif tag == "body" and self._hidden == "head":
                self._hidden = ""
            return
        self._tags += 1
        if tag in BLOCK_TAGS:
            self._end_line()
            if tag in HIDDEN_TAGS:
                self._hidden = tag
                return
            if tag not in ("br", "hr", "col"):
                self._close_implied(tag)
                self._open.append(tag)
        elif tag == "a":
            self._link = 1
        if tag in CODE_TAGS:
            self._sample += 1

    def _close_implied(self, tag: str) -> None:
        """Ends an open p, li, td and the like where the next one begins without an end tag."""
        while self._open and (self._open[-1] == "p" or self._open[-1] == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option")):
            self._open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in_title = False
        if self._hidden:
            if tag == self._hidden:
                self._hidden = ""
            return
        self._tags += 1
        if tag in BLOCK_TAGS:
            self._end_line()
            if tag in self._open:
                while self._open.pop() != tag:
                    pass
        elif tag == "a":
            self._link = 0
        if tag in CODE_TAGS and self._sample:
            self._sample -= 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self._hidden:
            self._tags += 1
            if tag in BLOCK_TAGS:
                self._end_line()

    def handle_data(self, data: str) -> None:
        if self._hidden:
            if self._in_title:
                self.title += data
            elif self._hidden == "noscript":
                self.notice += data
            return
        if data.isspace():
            if self._parts:  # white space that begins a line is none of its text
                self._parts.append(data)
                self._prose.append(data)
            return
        self._parts.append(data)
        self._prose.append(" " if self._sample else data)
        if self._link:
            self._linked += len(data.strip())
        if self._sample:
            self._code += 1
        else:
            self._plain += 1

    def finish(self) -> None:
        self.close()
        self._end_line()


def is_html(payload: str | None) -> bool:
    """Whether the payload has tags; null and blank payloads have none."""
    return bool(payload) and HTML_MARK.search(payload) is not None


def html_lines(payload: str) -> tuple[str, list[Line], str]:
    """Title and visible lines of an HTML payload, in order, and what it says where scripts don't run."""
    reader = _LineReader()
    reader.feed(payload)
    reader.finish()
    return " ".join(reader.title.split()), reader.lines, " ".join(reader.notice.split())


_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_MARK = re.compile(r"^(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s?)+")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_INLINE_CODE = re.compile(r"`[^`\n]*`")


def text_lines(payload: str) -> tuple[str, list[Line]]:
    """Title (none) and lines of a Markdown or plain payload: one for each line that is not blank.

    Fenced lines, and lines that are one code span, count as sample code; list and heading marks and
    link targets are taken off.
    """
    out: list[Line] = []
    fenced = False
    for raw in (html.unescape(payload) if "&" in payload else payload).splitlines():
        if _FENCE.match(raw):
            fenced = not fenced
            continue
        if fenced or raw.startswith(("    ", "\t")):
            text = " ".join(raw.split())
            if text:
                out.append(Line(text, "pre", 0, 0, True))
            continue
        stripped = raw.strip()
        mark = _MARK.match(stripped)
        block = "h1" if stripped.startswith("#") else "li" if mark else "p"
        body = stripped[mark.end() :] if mark else stripped
        linked = sum(len(m) for m in _LINK.findall(body)) if "](" in body else 0
        text = " ".join((_LINK.sub(r"\1", body) if linked else body).split())
        if text:
            code = _INLINE_CODE.sub(" ", text) if "`" in text else text
            out.append(Line(text, block, 0, min(linked, len(text)), code.isspace(), code if code is not text and not code.isspace() else None))
    return "", out


def payload_lines(payload: str | None) -> tuple[str, list[Line], str, bool]:
    """Title, lines, notice for browsers without scripts, and whether the payload is HTML; null and blank payloads have no lines."""
    if not payload or payload.isspace():
        return "", [], "", False
    if is_html(payload):
        return *html_lines(payload), True
    return *text_lines(payload), "", False
