"""Comparable text: what Markdown and typography add is taken away before texts are scored.

A text is read by small scanners: one drops what a line may begin with, one the marks that stand in pairs, one what brackets enclose. They are plain
Python, run on Arrow batches by :mod:`quire.functions.text`, which sends only texts with marks or without ASCII here.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

# fixed values: white space, and the characters that end a line
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_ENDS = "\n\r\u2028\u2029"
# fixed values: typography that counts as its plain form, in scored texts and in unit tests
PLAIN = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-"})
UNIT_PLAIN = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\uff3f": "_", "\u2013": "-", "\u2014": "-", "\u2011": "-", "\u2012": "-",
                            "\u2212": "-", "\u00b5": "\u03bc"})
_RUN = re.compile(f"[{SPACES}]+")
_LINE_END = re.compile(f"[{LINE_ENDS}]")
_OTHER_BLANKS = "\x1c\x1d\x1e\x1f\x85\ufeff"  # either these SPACES or ``str.split`` hold, not both
_ITEM = re.compile(r"[-*+] |[0-9][.)] ")


def _past(text: str, at: int, chars: str, most: int | None = None) -> int:
    """Where the run of ``chars`` at ``at`` ends, ``most`` characters further at the latest."""
    end = len(text) if most is None else min(len(text), at + most)
    while at < end and text[at] in chars:
        at += 1
    return at


def _heading(text: str, at: int) -> int:
    begin = _past(text, at, SPACES, 3)
    end = _past(text, begin, "#")
    after = _past(text, end, SPACES)
    return after if 1 <= end - begin <= 6 and after > end else at


def _item(text: str, at: int) -> int:
    begin = _past(text, at, SPACES, 3)
    number = _past(text, begin, "0123456789")
    end = number + 1 if text[number : number + 1] and text[number] in (".)" if number > begin else "-*+") else begin
    return end + 1 if end > begin and text[end : end + 1] == " " else at


def _quote(text: str, at: int) -> int:
    begin = _past(text, at, SPACES)
    return _past(text, begin + 1, SPACES, 1) if text[begin : begin + 1] == ">" else at


def without_leads(text: str, lead: Callable[[str, int], int]) -> str:
    """``text`` without what ``lead`` finds at the start of lines; a line can begin where a lead ended with a line end."""
    kept, done, at = [], 0, 0
    while True:
        end = lead(text, at)
        if end > at:
            kept.append(text[done:at])
            done = end
            if text[end - 1] in LINE_ENDS:
                at = end
                continue
        at = max(at, end)
        line_end = _LINE_END.search(text, at)
        if line_end is None:
            return "".join(kept) + text[done:]
        at = line_end.end()


def without_fences(text: str) -> str:
    """Code without the lines, or ends of lines, that fence it."""
    parts = text.split("```")
    return parts[0] + "".join(p[p.find("\n") + 1 :] if "\n" in p else "" for p in parts[1:])


def unlinked(text: str, opening: str, least: int) -> str:
    """``[label](target)`` behind ``opening`` leaves its label of ``least`` characters or more."""
    kept, done, at = [], 0, 0
    while (at := text.find(opening, at)) >= 0:
        begin = at + len(opening)
        close = text.find("]", begin)
        end = text.find(")", close + 2) if close >= begin + least and text[close + 1 : close + 2] == "(" else -1
        if end < 0:
            at += 1
            continue
        kept += [text[done:at], text[begin:close]]
        done = at = end + 1
    return "".join(kept) + text[done:]


def untagged(text: str) -> str:
    """A space for each tag."""
    kept, done, at = [], 0, 0
    while (at := text.find("<", at)) >= 0:
        end = text.find(">", at + 1)
        if end < 0:
            break
        if end == at + 1:
            at += 1
            continue
        kept += [text[done:at], " "]
        done = at = end + 1
    return "".join(kept) + text[done:]


def plain(markdown: str) -> str:
    """Display Markdown as text: code stays without its fences, links and pictures leave their labels, tags a space, lines lose their heading, list and quote marks."""
    text = without_fences(markdown) if "```" in markdown else markdown
    if "[" in text:
        text = unlinked(unlinked(text, "![", 0), "[", 1)
    text = untagged(text) if "<" in text else text
    for lead, may in ((_heading, "#" in text), (_item, _ITEM.search(text)), (_quote, ">" in text)):
        text = without_leads(text, lead) if may else text
    for mark in "*_~`":
        text = text.replace(mark, "")
    return text.replace("\r\n", "\n").replace("\r", "\n").strip(SPACES)


def normal(markdown: str) -> str:
    """Plain text, compatibility-composed, straight quotes and dashes, single spaces, lower case."""
    text = unicodedata.normalize("NFKC", plain(markdown))
    if not text.isascii():  # one by one: ``translate`` looks each character up
        for fancy, own in PLAIN.items():
            text = text.replace(chr(fancy), own)
    odd = any(c in text for c in _OTHER_BLANKS)
    return (_RUN.sub(" ", text).strip(" ") if odd else " ".join(text.split())).lower()


def unpaired(text: str, marks: tuple[str, ...]) -> str:
    """``text`` without marks that stand in pairs on one line, the first mark with the next one of its kind."""
    kept, done, at = [], 0, 0
    some = re.compile("|".join(map(re.escape, marks)))
    while (met := some.search(text, at)) is not None:
        mark, at, begin = met.group(), met.start(), met.end()
        end = text.find(mark, begin)
        if end < 0 or _LINE_END.search(text, begin, end):
            at += 1
            continue
        kept += [text[done:at], text[begin:end]]
        done = at = end + len(mark)
    return "".join(kept) + text[done:]


def unit(text: str) -> str:
    """Both sides of a unit test: line breaks, emphasis and bold or italic tags out, single spaces, composed, plain typography."""
    text = text.replace("<br/>", " ").replace("<br>", " ")
    for mark in ("**", "__"):
        text = unpaired(text, (mark,)) if mark in text else text
    for tag in ("<b>", "</b>", "<i>", "</i>"):
        text = text.replace(tag, "")
    for marks in (("**", "__"), ("*", "_")):
        text = unpaired(text, marks) if any(m in text for m in marks) else text
    text = unicodedata.normalize("NFC", _RUN.sub(" ", text))
    if not text.isascii():  # one by one: ``translate`` looks each character up
        for fancy, own in UNIT_PLAIN.items():
            text = text.replace(chr(fancy), own)
    return text
