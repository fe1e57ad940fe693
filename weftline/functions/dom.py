"""Pages as trees: typed blocks with locators, tables as grids, inline Markdown, and what a page says about itself.

The tree follows the parser's events: void elements have no children, an end tag without a start is
ignored, and no end tag is implied. Everything is plain Python over one payload; nothing is fetched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PRUNED = frozenset("script style template noscript nav".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong strike sub sup time tt u var br wbr input button select svg math".split())
BOILERPLATE = frozenset("nav header footer aside form".split())
SPAN_CAP = 1000


class Node:
    """An element, or a run of text when tag is empty."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.parent, self.text = tag, attrs or {}, parent, text
        self.children: list[Node] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order; deep trees don't exhaust the stack."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def all(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def string(self, skip: frozenset = PRUNED) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag in skip:
                continue
            if n.tag == "br":
                out.append("\n")
            elif not n.tag:
                out.append(n.text)
            elif n.tag not in INLINE and n is not self:
                out.append(" ")
            stack.extend(reversed(n.children))
        return " ".join("".join(out).split())

    def path(self) -> str:
        """An XPath-like locator; positions count siblings of the same tag from 1."""
        parts, node = [], self
        while node.parent is not None:
            same = [c for c in node.parent.children if c.tag == node.tag]
            parts.append(f"{node.tag}[{next(i for i, c in enumerate(same, 1) if c is node)}]")
            node = node.parent
        return "/" + "/".join(reversed(parts))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.root.tag = "#document"
        self.open: list[Node] = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open[-1]))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(Node("", None, self.open[-1], data))


def tree(payload: str) -> Node:
    builder = _Builder()
    builder.feed(payload)
    builder.close()
    return builder.root


_ESCAPE = re.compile(r"([\\`*_\[\]])")


def inline_markdown(node: Node, href: str) -> str:
    """A node's inline content as Markdown: emphasis, code, deletion, links, images and hard breaks."""

    def one(n: Node) -> str:
        if not n.tag:
            return _ESCAPE.sub(r"\\\1", re.sub(r"\s+", " ", n.text))
        if n.tag in PRUNED:
            return ""
        if n.tag == "br":
            return "  \n"
        if n.tag == "img":
            return f"![{n.attrs.get('alt', '')}]({link(href, n.attrs.get('src', ''))})"
        if n.tag in ("code", "kbd", "samp", "tt"):
            text = n.string()
            fence = "`" * (max([0, *map(len, re.findall(r"`+", text))]) + 1)
            return f"{fence}{' ' if '`' in text else ''}{text}{' ' if '`' in text else ''}{fence}" if text else ""
        inner = "".join(map(one, n.children))
        bare = inner.strip()
        if not bare:
            return inner
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}.get(n.tag)
        if mark:
            return f"{lead}{mark}{bare}{mark}{tail}"
        if n.tag == "a" and n.attrs.get("href"):
            return f"{lead}[{bare}]({link(href, n.attrs['href'])}){tail}"
        return inner

    return "".join(map(one, node.children)).strip()


def link(base: str, target: str) -> str:
    """A target made absolute; a bad address stays as it is."""
    try:
        return urljoin(base, target)
    except ValueError:
        return target


def links(node: Node, href: str) -> list[dict]:
    return [{"text": a.string(), "target": a.attrs.get("href", ""), "resolved_target": link(href, a.attrs.get("href", ""))} for a in node.all("a") if a.attrs.get("href")]


def table_cells(table: Node) -> list[dict]:
    """Cells with their place in the grid. Spans are capped at SPAN_CAP; rowspan 0 reaches to the end of its row group; nested tables keep their own cells."""

    def own_rows(n: Node, group: str) -> Iterator[tuple[str, Node]]:
        for c in n.children:
            if c.tag == "tr":
                yield group, c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from own_rows(c, c.tag)

    rows = list(own_rows(table, "tbody"))
    taken: set[tuple[int, int]] = set()
    out = []
    for r, (group, row) in enumerate(rows):
        left = next((k for k in range(r, len(rows)) if rows[k][0] != group), len(rows)) - r
        c = 0
        for cell in (x for x in row.children if x.tag in ("td", "th")):
            while (r, c) in taken:
                c += 1
            span = lambda name: int(v) if (v := cell.attrs.get(name, "1").strip()).isdigit() else 1  # noqa: B023,E731
            down, across = span("rowspan"), max(1, min(SPAN_CAP, span("colspan")))
            down = left if down == 0 else min(SPAN_CAP, down, len(rows) - r)
            taken |= {(r + i, c + k) for i in range(down) for k in range(across)}
            out.append({"row": r, "column": c, "text": cell.string(), "is_header": cell.tag == "th", "row_group": group, "rowspan": down, "colspan": across})
            c += across
    return out


def _mapping(text: str, payload: str, squeezed: str) -> str:
    """How a block's text is found in the payload: exact, normalized_match, ambiguous or unavailable."""
    if not text:
        return "unavailable"
    n = payload.count(text)
    if n == 1:
        return "exact"
    if n > 1:
        return "ambiguous"
    n = squeezed.count(text)
    return "normalized_match" if n == 1 else "ambiguous" if n > 1 else "unavailable"


def html_blocks(payload: str, href: str = "", prune: bool = True) -> list[dict]:
    """Typed blocks in document order; see the enumeration in `KINDS`. Lists, quotes and definition lists hold others and have no text of their own."""
    root = tree(payload)
    body = next(root.all("body"), root)
    squeezed = " ".join(payload.split())
    out: list[dict] = []

    def add(kind: str, node: Node, parent: str | None, text: str, **more: object) -> str:
        block_id = f"b{len(out):04d}"
        out.append({
            "block_id": block_id, "block_order": len(out), "parent_id": parent, "block_type": kind, "text": text, "heading_level": more.get("level"), "links": links(node, href) if kind not in ("list", "quote") else [],
            "cells": more.get("cells", []), "dom_path": node.path(), "mapping_status": _mapping(text, payload, squeezed), "ordered": more.get("ordered"), "start": more.get("start"), "language": more.get("language"),
            "markdown": more.get("markdown") if "markdown" in more else inline_markdown(node, href) if text and kind not in ("code", "table") else "",
        })
        return block_id

    def loose(nodes: list[Node], parent: str | None, holder: Node) -> None:
        """A run of inline nodes between blocks is a paragraph."""
        shell = Node("span", None, holder.parent)
        shell.children = nodes
        text = shell.string()
        if text:
            block_id = add("paragraph", holder, parent, text, markdown=inline_markdown(shell, href))
            out[int(block_id[1:])]["links"] = links(shell, href)

    def inside(node: Node, parent: str | None) -> None:
        run: list[Node] = []
        for c in node.children:
            if not c.tag or c.tag in INLINE and not any(x.tag and x.tag not in INLINE for x in c.walk()):
                run.append(c)
                continue
            loose(run, parent, node)
            run = []
            visit(c, parent)
        loose(run, parent, node)

    def visit(node: Node, parent: str | None) -> None:
        tag = node.tag
        if prune and (tag in PRUNED or node.attrs.get("role") == "navigation" or tag == "footer" and node.parent is body) or tag in ("script", "style", "template", "head", "title"):
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if text := node.string():
                add("heading", node, parent, text, level=int(tag[1]))
        elif tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start", "")
            mine = add("list", node, parent, "", ordered=tag == "ol", start=int(start) if start.lstrip("-").isdigit() else 1 if tag == "ol" else None)
            for c in node.children:
                if c.tag:
                    visit(c, mine) if c.tag == "li" else inside(c, mine)
        elif tag == "li":
            own = [c for c in node.children if c.tag not in ("ul", "ol", "menu")]
            shell = Node("li", None, node.parent)
            shell.children = own
            mine = add("list_item", node, parent, shell.string(), markdown=inline_markdown(shell, href))
            out[int(mine[1:])]["links"] = links(shell, href)
            for c in node.children:
                if c.tag in ("ul", "ol", "menu"):
                    visit(c, mine)
        elif tag == "blockquote":
            inside(node, add("quote", node, parent, ""))
        elif tag == "pre":
            code = next(node.all("code"), node)
            language = next((c[9:] for c in code.attrs.get("class", "").split() if c.startswith("language-")), None)
            raw = "".join(n.text for n in node.walk() if not n.tag)
            if raw.strip():
                add("code", node, parent, raw.strip("\n"), language=language)
        elif tag == "table":
            cells = table_cells(node)
            if cells:
                add("table", node, parent, "\n".join(" | ".join(c["text"] for c in cells if c["row"] == r) for r in sorted({c["row"] for c in cells})), cells=cells)
        elif tag == "dl":
            mine = add("definition_list", node, parent, "")
            for c in node.all("dt", "dd"):
                if text := c.string():
                    add("definition_term" if c.tag == "dt" else "definition_description", c, mine, text)
        elif tag == "hr":
            add("thematic_break", node, parent, "")
        elif tag in ("img", "figure") and tag == "img":
            add("image", node, parent, node.attrs.get("alt", ""))
        else:
            inside(node, parent)

    inside(body, None)
    return out


# The kinds of blocks.
KINDS = ("heading", "paragraph", "list", "list_item", "quote", "table", "code", "image", "thematic_break", "definition_list", "definition_term", "definition_description")


def text_blocks(payload: str) -> list[dict]:
    """Blocks of a Markdown or plain payload: headings, list items, quotes, fenced code, tables and paragraphs, with line ranges as locators."""
    out: list[dict] = []
    lines = payload.split("\n")
    i = 0

    def add(kind: str, text: str, first: int, last: int, level: int | None = None, language: str | None = None) -> None:
        out.append({
            "block_id": f"b{len(out):04d}", "block_order": len(out), "parent_id": None, "block_type": kind, "text": text, "heading_level": level,
            "links": [{"text": a, "target": b, "resolved_target": b} for a, b in re.findall(r"\[([^\]\n]*)\]\(([^)\s]*)\)", text)] if kind != "code" else [],
            "cells": [], "dom_path": f"lines[{first + 1}:{last + 1}]", "mapping_status": "exact", "ordered": None, "start": None, "language": language, "markdown": text,
        })

    while i < len(lines):
        line = lines[i]
        if fence := re.match(r"^\s{0,3}(```+|~~~+)\s*(\S*)", line):
            j = i + 1
            while j < len(lines) and not lines[j].strip().startswith(fence[1]):
                j += 1
            add("code", "\n".join(lines[i + 1 : j]), i, min(j, len(lines) - 1), language=fence[2] or None)
            i = j + 1
        elif head := re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            add("heading", head[2], i, i, len(head[1]))
            i += 1
        elif re.match(r"^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$", line):
            add("thematic_break", "", i, i)
            i += 1
        elif item := re.match(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$", line):
            add("list_item", item[1].strip(), i, i)
            i += 1
        elif line.lstrip().startswith(">"):
            j = i
            while j < len(lines) and lines[j].lstrip().startswith(">"):
                j += 1
            add("quote", "\n".join(x.lstrip()[1:].strip() for x in lines[i:j]), i, j - 1)
            i = j
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?[\s:|-]*-[\s:|-]*$", lines[i + 1]) and "|" in lines[i + 1]:
            j = i
            while j < len(lines) and "|" in lines[j]:
                j += 1
            cells = []
            for r, row in enumerate([lines[i], *lines[i + 2 : j]]):
                cells += [{"row": r, "column": c, "text": t.strip(), "is_header": r == 0, "row_group": "thead" if r == 0 else "tbody", "rowspan": 1, "colspan": 1} for c, t in enumerate(row.strip().strip("|").split("|"))]
            add("table", "\n".join(lines[i:j]), i, j - 1)
            out[-1]["cells"] = cells
            i = j
        elif not line.strip():
            i += 1
        else:
            j = i
            while j < len(lines) and lines[j].strip() and not re.match(r"^\s{0,3}(?:#{1,6}\s|```|~~~|>|[-*+]\s|\d+[.)]\s)", lines[j] if j > i else ""):
                j += 1
            add("paragraph", "\n".join(x.strip() for x in lines[i:j]), i, j - 1)
            i = j
    return out


def blocks_markdown(blocks: list[dict]) -> str:
    """Blocks as Markdown: list depth as indent, quotes as marks, tables as pipes with a rule under the first row."""
    depth: dict[str, int] = {}
    quoted: dict[str, int] = {}
    out = []
    for b in blocks:
        up = b["parent_id"]
        kind = b["block_type"]
        depth[b["block_id"]] = depth.get(up, 0) + (kind == "list")
        quoted[b["block_id"]] = quoted.get(up, 0) + (kind == "quote")
        body = b["markdown"] or b["text"]
        if kind in ("list", "definition_list") or kind == "quote" and not body:
            continue
        if kind == "heading":
            text = f"{'#' * (b['heading_level'] or 1)} {body}"
        elif kind == "list_item":
            text = f"{'  ' * max(0, depth[b['block_id']] - 1)}- {body}"
        elif kind == "code":
            text = f"```{b['language'] or ''}\n{b['text']}\n```"
        elif kind == "table" and b["cells"]:
            width = 1 + max(c["column"] + c["colspan"] - 1 for c in b["cells"])
            rows: dict[int, list[str]] = {}
            for c in b["cells"]:
                rows.setdefault(c["row"], [""] * width)[c["column"]] = c["text"].replace("|", "\\|")
            lines = [f"| {' | '.join(rows[r])} |" for r in sorted(rows)]
            text = "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]])
        elif kind == "thematic_break":
            text = "---"
        else:
            text = body
        mark = "> " * quoted[b["block_id"]]
        out.append("\n".join(mark + x for x in text.split("\n")) if mark else text)
    return "\n\n".join(x for x in out if x.strip())


def _types(value: object, into: set[str]) -> None:
    if isinstance(value, dict):
        kind = value.get("@type")
        into.update([kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else [])
        for v in value.values():
            _types(v, into)
    elif isinstance(value, list):
        for v in value:
            _types(v, into)


def inventory(payload: str, href: str = "") -> dict:
    """What a page says about itself, and counts of its parts."""
    root = tree(payload)
    text = lambda n: n.string(frozenset()) if n else None
    html = next(root.all("html"), None)
    meta = {(m.attrs.get("name") or m.attrs.get("property") or "").lower(): m.attrs.get("content", "") for m in root.all("meta")}
    canonical = next((n.attrs.get("href") for n in root.all("link") if "canonical" in n.attrs.get("rel", "").lower().split()), None)
    kinds: set[str] = set()
    bad = 0
    for n in root.all("script"):
        if n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                _types(json.loads("".join(c.text for c in n.children)), kinds)
            except ValueError:
                bad += 1
    body = next(root.all("body"), root)
    whole = body.string()
    outside = frozenset(PRUNED | BOILERPLATE)
    focus = max((n for n in root.all("main", "article")), key=lambda n: len(n.string(outside)), default=None)
    count = lambda *t: sum(1 for _ in root.all(*t))
    return {
        "title": text(next(root.all("title"), None)), "lang": html.attrs.get("lang") if html else None, "description": meta.get("description") or meta.get("og:description"),
        "canonical": link(href, canonical) if canonical else None, "json_ld": sorted(kinds), "json_ld_errors": bad, "scripts": count("script"), "tags": sum(1 for n in root.walk() if n.tag) - 1,
        "headings": count("h1", "h2", "h3", "h4", "h5", "h6"), "h1": count("h1"), "paragraphs": count("p"), "items": count("li"), "tables": count("table"), "images": count("img"), "links": count("a"), "code": count("pre"),
        "forms": count("form"), "visible_words": len(re.findall(r"\w+", whole)), "main_words": len(re.findall(r"\w+", body.string(outside))), "focus_words": len(re.findall(r"\w+", focus.string(outside))) if focus else 0,
        "pdf_embed": any("pdf" in (n.attrs.get("type", "") + n.attrs.get("src", "") + n.attrs.get("data", "")).lower() for n in root.all("embed", "object", "iframe")),
    }
