"""HTML read as tokens, and the grids of its tables."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

BLANKS = " \t\n\f\r"
RAW_TEXT = {n: re.compile(f"</{n}", re.ASCII | re.IGNORECASE) for n in ("script", "style", "textarea", "title")}  # what is inside is text up to their end tag
SPAN_LIMITS = {"colspan": 1000, "rowspan": 65534}  # fixed values: as far as the HTML standard counts
_NAME = re.compile(r"[^ \t\n\f\r/>=]*")
_ATTRIBUTE = r"""(?: ([A-Za-z]+)=(?:"([^"]*)"|'([^']*)'|([A-Za-z0-9_-]+)))?"""
_PLAIN_TAG = re.compile(rf"<(/?)([A-Za-z][^ \t\n\f\r/>=]*){_ATTRIBUTE}>([^<]*)")  # a tag of at most one attribute, and the text behind it
_PLAIN_CELL = re.compile(rf"<[Tt]([DdHh]){_ATTRIBUTE}>([^<]*(?:<br>[^<]*)*)</[Tt][DdHh]>[^<]*")  # such a cell with nothing but text, and what lies behind it


def _name(html: str, at: int) -> int:
    """Where the name of a tag or an attribute at ``at`` ends."""
    return _NAME.match(html, at).end()


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from ``at`` on, and what follows its ``>``; the first of equal names counts."""
    found: dict[str, str] = {}
    while at < len(html) and html[at] != ">":
        if html[at] in BLANKS or html[at] in "/=":
            at += 1
            continue
        end = _name(html, at)
        name, value = html[at:end].lower(), ""
        at = end
        while at < len(html) and html[at] in BLANKS:
            at += 1
        if html[at : at + 1] == "=":
            at += 1
            while at < len(html) and html[at] in BLANKS:
                at += 1
            quote = html[at : at + 1]
            if quote in ('"', "'"):
                end = html.find(quote, at + 1)
                end = len(html) if end < 0 else end
                value, at = html[at + 1 : end], end + 1
            else:
                end = at
                while end < len(html) and html[end] not in BLANKS and html[end] != ">":
                    end += 1
                value, at = html[at:end], end
        found.setdefault(name, entities.unescape(value))
    return found, at + 1


def _token(html: str, at: int) -> tuple[str, str, dict[str, str], int]:
    """(kind, name or text, attributes, place behind it) of what the ``<`` at ``at`` begins: open, close, text, or nothing (comments, doctypes and the like).
    A ``>`` in an attribute ends no tag."""
    after = html[at + 1 : at + 2]
    if html.startswith("<!--", at):
        end = html.find("-->", at + 4)
        return "nothing", "", {}, len(html) if end < 0 else end + 3
    if after in ("!", "?"):
        end = html.find(">", at)
        return "nothing", "", {}, len(html) if end < 0 else end + 1
    closing = after == "/"
    if not (html[at + 2 : at + 3] if closing else after).isalpha():
        return "text", "<", {}, at + 1
    end = _name(html, at + 1 + closing)
    given, past = _attributes(html, end)
    return ("close" if closing else "open"), html[at + 1 + closing : end].lower(), given, past


@dataclass(slots=True)
class Table:
    number: int
    rows: list[list[tuple[bool, int, int, list[str]]]] = field(default_factory=list)  # cells: heading, columns, rows (0: to the end), text
    head: bool = False
    row: list | None = None
    text: list[str] | None = None  # of the cell that is open


def _span(given: dict[str, str], name: str) -> int:
    """A span as the standard reads it: leading digits, 1 where there are none, a colspan of 0 as 1; a rowspan of 0 stays."""
    text = given.get(name, "").strip(BLANKS)
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    n = min(int(digits), SPAN_LIMITS[name]) if digits else 1
    return max(1, n) if name == "colspan" else n


def tables(html: str) -> list[Table]:
    """The tables of a page in order of their start, those inside cells too; a cell's text holds that of the tables in it. End tags can be left out."""
    every: list[Table] = []
    open_: list[Table] = []
    plain, plain_cell, unescape, size = _PLAIN_TAG.match, _PLAIN_CELL.match, entities.unescape, len(html)
    at = html.find("<") % (size + 1)
    while at < size:  # a ``<`` and the text behind its tag
        met = plain_cell(html, at) if len(open_) == 1 else None
        if met is not None:
            table = open_[0]
            if table.row is None:
                table.row = []
                table.rows.append(table.row)
            kind, key, double, single, bare, text = met.groups()
            wide = down = 1
            if key:
                key, given = key.lower(), unescape(double or single or bare or "")
                if key == "colspan":
                    wide = _span({key: given}, key)
                elif key == "rowspan":
                    down = _span({key: given}, key)
            if "<" in text:
                text = text.replace("<br>", "\n")
            table.row.append((table.head or kind in "Hh", wide, down, [unescape(text) if "&" in text else text]))
            table.text, at = None, met.end()
            continue
        met = plain(html, at)
        if met is not None:
            closing, name, key, double, single, bare, text = met.groups()
            opens, closes, name = not closing, bool(closing), name.lower()
            given = {key.lower(): unescape(double or single or bare or "")} if key else {}
            begin, at = met.start(7), met.end()
        else:
            kind, name, given, begin = _token(html, at)
            opens, closes = kind == "open", kind == "close"
            at = html.find("<", begin) % (size + 1)
            text = html[begin:at]
            if kind == "text":
                text = name + text
        raw = opens and name in RAW_TEXT
        if raw:
            end = RAW_TEXT[name].search(html, begin)
            at = size if end is None else end.start()
            text = html[begin:at]
        if opens and name == "table":
            every.append(Table(len(every) + 1))
            open_.append(every[-1])
        elif not open_ or not (opens or closes):
            pass
        elif name == "br":
            if opens:
                text, raw = "\n" + (unescape(text) if "&" in text else text), True
        elif name == "td" or name == "th":
            table = open_[-1]
            table.text = None
            if opens:
                if table.row is None:
                    table.row = []
                    table.rows.append(table.row)
                table.text = []
                table.row.append((table.head or name == "th", _span(given, "colspan") if given else 1, _span(given, "rowspan") if given else 1, table.text))
        elif name == "tr":
            table = open_[-1]
            table.row = table.text = None
            if opens:
                table.row = []
                table.rows.append(table.row)
        elif name in ("thead", "tbody", "tfoot"):
            table = open_[-1]
            table.row = table.text = None
            table.head = opens and name == "thead"
        elif closes and name == "table":
            open_.pop()
        if text and open_:
            text = unescape(text) if "&" in text and not raw else text
            for table in open_:
                if table.text is not None:
                    table.text.append(text)
    return every


def cells_of(html: str) -> Iterator[tuple[int, list[tuple[int, int, int, int, int, str, bool]]]]:
    """The tables with cells: (number, [(cell, row, column, rows, columns, text, heading)]). Spans fill places in order; a rowspan of 0 reaches the table's end."""
    for table in tables(html):
        busy: dict[int, int] = {}  # column: the first row below the cell that spans rows there
        found = []
        for r, row in enumerate(table.rows):
            c = 0
            for heading, wide, down, text in row:
                while busy.get(c, 0) > r:
                    c += 1
                down = down or len(table.rows) - r
                found.append((len(found) + 1, r, c, down, wide, "".join(text).strip(), heading))
                if down > 1:
                    for x in range(c, c + wide):
                        busy[x] = max(busy.get(x, 0), r + down)
                c += wide
        if found:
            yield table.number, found
