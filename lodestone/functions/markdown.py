"""HTML as Markdown, tag by tag: headings, emphasis, code, links, images, lists, quotations and tables.

Text is taken as a browser takes it: entities are characters, white space is one space, and tags that don't fit close what they
close in a page. Asterisks and underscores of texts are escaped, but for those in code. Scripts, styles and comments go.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "figure", "figcaption", "address", "dl", "dt", "dd", "form", "fieldset"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr", "area", "base", "embed", "source", "track", "param"}
_DROPPED = {"script", "style", "title", "template", "noscript"}
_CELLS, _LISTS = {"td", "th"}, {"ul", "ol"}
#: Tags that a new tag closes if they are open, and tags beyond which it doesn't look for them.
_CLOSES = {
    "li": ({"li"}, _LISTS), "td": (_CELLS, {"tr", "table"}), "th": (_CELLS, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCKS | _LISTS | {"table", "pre", "blockquote", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TABLE_PARTS = {"tr", "thead", "tbody", "tfoot"}
#: Tags that take no white space of their own, tags whose end closes all that stands in them, and all that others look for around them.
_FRAMES, _OUTER = _LISTS | {"table"} | _TABLE_PARTS, _ENDS_P | _CELLS | {"li"} | _TABLE_PARTS
_CODE, _AROUND_P, _AROUND_INLINE = {"code", "kbd", "samp"}, _CELLS | {"li", "blockquote", "table"}, _CELLS | {"li"}
_SPACE, _ESCAPED = re.compile(r"\s+"), re.compile(r"([*_])")
#: Texts between tags that come out as they go in, but for what is escaped: words with single spaces between, without any character that HTML or
#: tables take for more. What stands for such a text in a form (see _form()), with a character to be escaped, and the longest page that is told by its form.
_PLAIN = re.compile(r"""(?<![^>])([^\s<>&|\\"']++(?: [^\s<>&|\\"']++)*+)(?![^<])""")
_PLACE, _LONGEST = re.compile("\ue000([0-9]+)(\\\\?)_\ue001"), 1 << 14


class _Open:
    """An open tag and the Markdown of what it holds so far."""

    __slots__ = ("tag", "attrs", "parts", "rows", "head", "items")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.rows, self.head, self.items = [], False, []

    def last(self) -> str:
        return next((p for p in reversed(self.parts) if p), "")


class _Converter(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", {})]
        self.opened: dict[str, int] = {}  # how many of each tag the stack holds
        self.links: list[tuple[str, str]] = []  # texts that were compared with their links

    # --- what is open

    def _inside(self, tags: set[str]) -> bool:
        return not tags.isdisjoint(self.opened)

    def _push(self, tag: str, attrs: list) -> None:
        self.stack.append(_Open(tag, dict(attrs)))
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def _close_to(self, tags: set[str], stop: set[str]) -> None:
        """Closes the innermost of the tags and all in it, unless one of `stop` is between."""
        if not self._inside(tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P and "p" in self.opened:
            self._close_to({"p"}, _AROUND_P)
        if tag in _CLOSES:
            self._close_to(*_CLOSES[tag])
        if tag == "br":
            self._inline(" " if self._inside(_CELLS) or self._inside(_HEADINGS) else "  \n")
        elif tag == "hr":
            self._block("---")
        elif tag == "img":
            about = dict(attrs)
            self._inline(f"![{about.get('alt') or ''}]({about.get('src') or ''})")
        elif tag not in _VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack[-1].tag == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        # an inline tag's end doesn't close the block that it stands in
        self._close_to({tag}, set() if tag in _OUTER else _AROUND_INLINE)

    def handle_data(self, data: str) -> None:
        if self._inside(_DROPPED):
            return
        if "pre" in self.opened:
            self.stack[-1].parts.append(data)
            return
        data = _SPACE.sub(" ", data)
        if not self._inside(_CODE):
            data = _escaped(data)
        self._inline(data)

    # --- what goes into the tag around

    def _inline(self, text: str) -> None:
        own = self.stack[-1]
        if own.tag in _FRAMES and not text.strip():
            return
        if text.startswith(" ") and "pre" not in self.opened:
            before = own.last()
            if before[-1] in " \n" if before else own.tag not in _INLINE and own.tag not in ("a", "span"):
                text = text[1:]
        if text:
            own.parts.append(text)

    def _block(self, text: str, tight: bool = False) -> None:
        """Text on lines of its own, with an empty line before and behind, or none."""
        own, gap = self.stack[-1], "\n" if tight else "\n\n"
        text = text.strip("\n")
        if not text.strip():
            return
        if own.parts and own.parts[-1] != "\n\n":
            own.parts[-1] = own.parts[-1].rstrip(" ") if not own.parts[-1].endswith("  \n") else own.parts[-1]
            own.parts.append(gap)
        own.parts += [text, "\n\n" if not tight else "\n"]

    def _pop(self) -> None:
        own = self.stack.pop()
        tag, text = own.tag, "".join(own.parts)
        self.opened[tag] -= 1
        if not self.opened[tag]:
            del self.opened[tag]
        if tag in _DROPPED:
            return
        if tag in _INLINE or tag == "a":
            self._inline(self._marked(own, text))
        elif tag in _HEADINGS:
            if line := _SPACE.sub(" ", text).strip():
                self._block("#" * int(tag[1]) + " " + line)
        elif tag == "pre":
            self._block("```\n" + text.strip("\n") + "\n```")
        elif tag == "blockquote":
            self._block("\n".join(("> " + line).rstrip() for line in text.strip().split("\n")) if text.strip() else "")
        elif tag == "li":
            self._item(text)
        elif tag in _LISTS:
            self._list(own, text)
        elif tag in _CELLS:
            self._cell(own, text)
        elif tag == "tr":
            table = next((o for o in reversed(self.stack) if o.tag == "table"), None)
            if table is None:
                self._block(" ".join(own.rows))
            elif own.rows:
                table.head |= not table.rows and (own.head or self._inside({"thead"}))
                table.rows.append(own.rows)
        elif tag in _TABLE_PARTS:
            self._inline(text)
        elif tag == "table":
            self._table(own, text)
        elif tag in _BLOCKS:
            self._block(text.strip())
        else:  # what isn't known leaves its text
            self._inline(text)

    def _marked(self, own: _Open, text: str) -> str:
        core = text.strip()
        if not core or "pre" in self.opened:
            return text
        if own.tag == "a":
            href, title = own.attrs.get("href"), own.attrs.get("title")
            if not href:
                return text
            self.links.append((core, href))
            made = f"<{href}>" if core.replace("\\", "") == href and not title else f"[{core}]({href}{f' "{title}"' if title else ''})"
        else:
            mark = _INLINE[own.tag]
            if any(_INLINE.get(o.tag) == mark for o in self.stack) or mark != "`" and self._inside(_CODE):
                return text
            made = f"{mark}{core}{mark}"
        return text[: len(text) - len(text.lstrip())] + made + text[len(text.rstrip()) :]

    def _item(self, text: str) -> None:
        around = next((o for o in reversed(self.stack) if o.tag in _LISTS), None)
        text = text.strip()
        if around is None or around.tag == "ul":
            depth = sum(o.tag == "ul" for o in self.stack)
            mark = "*+-"[(max(depth, 1) - 1) % 3]
        else:
            start = around.attrs.get("start") or "1"
            mark = f"{(int(start) if start.isdigit() else 1) + len(around.items)}."
        line = f"{mark} {text}".rstrip().replace("\n", "\n" + " " * (len(mark) + 1))
        line = re.sub(r"\n +(?=\n)", "\n", line)
        if around is None:
            self._block(line, tight=True)
        else:
            around.items.append(line)

    def _list(self, own: _Open, text: str) -> None:
        inner = self._inside({"li"})
        items = "\n".join(own.items)
        if text.strip():
            items = text.strip() + "\n" + items
        self._block(items, tight=inner)

    def _cell(self, own: _Open, text: str) -> None:
        row = next((o for o in reversed(self.stack) if o.tag == "tr"), None)
        if row is None:
            self._block(text.strip())
            return
        row.rows.append(_SPACE.sub(" ", text).strip().replace("|", "\\|"))
        row.head |= own.tag == "th"

    def _table(self, own: _Open, text: str) -> None:
        width = max(map(len, own.rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in own.rows]
        if rows and not own.head:
            rows.insert(0, [""] * width)
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        lines[1:1] = ["| " + " | ".join(["---"] * width) + " |"] if rows else []
        self._block("\n\n".join(x for x in (text.strip(), "\n".join(lines)) if x))

    def result(self) -> str:
        self.close()
        while len(self.stack) > 1:
            self._pop()
        return re.sub(r"\n{3,}", "\n\n", "".join(self.stack[0].parts)).strip()


def _escaped(text: str) -> str:
    return _ESCAPED.sub(r"\\\1", text) if "*" in text or "_" in text else text


def convert(html: str) -> str:
    """Pages of one form, which differ in plain texts alone, are parsed once: their texts are put into what came of that form."""
    if len(html) <= _LONGEST and "\ue000" not in html and "\ue001" not in html:
        parts = _PLAIN.split(html)
        texts = parts[1::2]
        page, links = _form(tuple(parts[::2]))
        if not any(_filled(core, texts).replace("\\", "") == _filled(href, texts) for core, href in links):
            return _filled(page, texts)
    return _parsed(html).result()


def _parsed(html: str) -> _Converter:
    converter = _Converter()
    converter.feed(html)
    return converter


#: Pieces of a text, and the number of the plain text that follows each but the last, with whether it is escaped there.
_Form = tuple[list[str], list[tuple[int, bool]]]


@lru_cache(maxsize=256)
def _form(around: tuple[str, ...]) -> tuple[_Form, list[tuple[_Form, _Form]]]:
    """What comes of a page with places for the plain texts, of which the rest stands around, and the texts and targets of links that are
    written otherwise where the plain texts make them equal."""
    converter = _parsed("".join(x if i == 0 else f"\ue000{i - 1}_\ue001{x}" for i, x in enumerate(around)))
    page = converter.result()
    links = [(_cut(core), _cut(href)) for core, href in converter.links]
    return _cut(page), [(core, href) for core, href in links if core[1] or href[1]]


def _cut(text: str) -> _Form:
    parts = _PLACE.split(text)
    return parts[::3], [(int(n), bool(escape)) for n, escape in zip(parts[1::3], parts[2::3], strict=True)]


def _filled(form: _Form, texts: list[str]) -> str:
    pieces, places = form
    out = [""] * (2 * len(places) + 1)
    out[::2] = pieces
    out[1::2] = [_escaped(texts[i]) if escape else texts[i] for i, escape in places]
    return "".join(out)


def _converted(html: pa.Array) -> pa.Array:
    return pa.array([None if page is None else convert(page) for page in html.to_pylist()], pa.string())


def to_markdown(html: Column) -> Column:
    """The page as Markdown; null for null."""
    return F.arrow_udf(_converted, "string")(html)
