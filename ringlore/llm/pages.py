"""Reading whole pages: the tree of a page's block elements and, line by line, what a reader sees of it.

Plain text has no elements; its sections, parted by blank lines and ruled lines, stand for them.  Character references are
read there too, as the pages' own programs write them.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_TAG = re.compile(r"(<!--.*?-->|</?[a-zA-Z!][^<>]*>)", re.DOTALL)
_ELEMENT = re.compile(r"</?[a-zA-Z!][^<>]*>")
_BROKEN = re.compile(r"<!--[^\n]*(?<!-->)\n|</?[a-zA-Z!][^<>\n]*\n")
#: A line that is one element without others inside, which needs no tokens.
_WHOLE = re.compile(r"\s*<(p|li|h[1-6]|div|td|th)(?:\s[^<>]*)?>([^<>]*)</\1>\s*", re.IGNORECASE)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_RULE = re.compile(r"^\s*([-=_*~#])\1{2,}\s*$")
_WORDY = re.compile(r"[^\W_]")
#: Elements that become nodes of the tree.
BLOCKS = frozenset("html body div table tbody tr td th ul ol dl nav header footer main article aside section blockquote center form details".split())
#: Elements that part words without being nodes.
BREAKS = frozenset("p li br hr h1 h2 h3 h4 h5 h6 dt dd option title meta pre figcaption figure caption".split())
SILENT = frozenset(("script", "style", "noscript", "template"))


class Leaf(NamedTuple):
    """The text that one line shows within one node; ``tags``: the innermost elements around it that are no nodes."""

    line: int
    node: int
    text: str
    tags: frozenset


class Page(NamedTuple):
    """``names`` and ``parents`` of the nodes, the root first; leaves in reading order; the title element's text."""

    names: list
    parents: list
    leaves: list
    title: str
    markup: bool


def is_markup(text: str) -> bool:
    """Whether a tag or a comment stands anywhere in the text."""
    opened = text.find("<!--")
    return opened >= 0 and text.find("-->", opened + 4) >= 0 or _ELEMENT.search(text) is not None


def read_page(text: str) -> Page:
    """The tree of a page.  A missing end tag closes with the next enclosing one; an end tag without a start is ignored."""
    return _read_markup(text) if is_markup(text) else _read_plain(text)


def _read_plain(text: str) -> Page:
    names, parents, leaves, node, fresh = ["#text"], [-1], [], 0, True
    for n, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            fresh = True
            continue
        if _RULE.match(line):
            names.append("rule" + line.strip()[0])
            parents.append(0)
            node, fresh = len(names) - 1, False
            continue
        if not _WORDY.search(line):
            continue
        if fresh:
            names.append("section")
            parents.append(0)
            node, fresh = len(names) - 1, False
        leaves.append(Leaf(n, node, " ".join((unescape(line) if "&" in line else line).split()), frozenset()))
    return Page(names, parents, leaves, "", False)


_INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|span|font|small|big|sup|sub|blink|marquee|mark|tt|code)(?=[\s>/])[^<>]*>", re.IGNORECASE)


_NONE: frozenset = frozenset()


class _Memo(dict):
    """What was met so far; it travels to the workers empty."""

    def __reduce__(self):
        return type(self), ()


class _Tags(_Memo):
    """Of every tag its element's name, what kind of element that is, and whether the tag closes it or is whole."""

    def __missing__(self, piece: str) -> tuple[str, str, bool, bool]:
        if len(self) > 20_000:
            self.clear()
        name = m[1].lower() if (m := _NAME.match(piece)) else ""
        kind = "" if not name else "silent" if name in SILENT else "block" if name in BLOCKS else "break" if name in BREAKS else "inline"
        read = self[piece] = (name, kind, piece[1] == "/", piece.endswith("/>"))
        return read


#: Tags and short lines met so far.  Lines are kept as (the block element they are, the text they show, the tags around it) if
#: they leave everything as it was, so that a site's furniture, which returns on every page, is taken apart once.
_TAGS, _LINES = _Tags(), _Memo()


def _keep(line: str, read: tuple[str, str, frozenset]) -> None:
    if len(line) < 200:
        if len(_LINES) > 20_000:
            _LINES.clear()
        _LINES[line] = read


def _shown(text: str) -> str:
    return " ".join((unescape(text) if "&" in text else text).split())


def _read_markup(text: str) -> Page:
    if _BROKEN.search(text):
        text = _TAG.sub(lambda m: m[0].replace("\n", "\x01"), text)
    names, parents, leaves, stack, silent, title = ["#page"], [-1], [], [0], "", []
    around: list[str] = []
    n = 0
    for line in text.split("\n"):
        n += 1
        if "<" not in line:
            if not silent and _WORDY.search(line):
                leaves.append(Leaf(n, stack[-1], _shown(line), frozenset(around)))
            continue
        plain = not silent and not around
        if plain:
            if known := _LINES.get(line):
                if known[0]:
                    names.append(known[0])
                    parents.append(stack[-1])
                if known[1]:
                    leaves.append(Leaf(n, len(names) - 1 if known[0] else stack[-1], known[1], known[2]))
                continue
            if m := _WHOLE.fullmatch(line):
                name, said = m[1].lower(), m[2]
                block = name if name in BLOCKS else ""
                if block:
                    names.append(name)
                    parents.append(stack[-1])
                said, tags = _shown(said) if _WORDY.search(said) else "", _NONE if block else frozenset((name,))
                if said:
                    leaves.append(Leaf(n, len(names) - 1 if block else stack[-1], said, tags))
                _keep(line, (block, said, tags))
                continue
        parts: list[str] = []
        tags: set[str] = set(around)
        within, before = True, len(leaves)

        for k, piece in enumerate(_TAG.split(line)):
            if not k & 1:
                if not piece or silent:
                    continue
                if around:
                    if around[-1] == "title":
                        title.append(piece)
                        within = False
                    if not piece.isspace():
                        tags.update(around)
                parts.append(piece)
                continue
            if "\x01" in piece:
                n += piece.count("\x01")
                within = False
            name, kind, closing, whole = _TAGS[piece]
            if not kind:
                continue
            if silent:
                if closing and name == silent:
                    silent = ""
                continue
            if kind == "inline":
                if closing:
                    if name in around:
                        while around.pop() != name:
                            pass
                elif not whole:
                    around.append(name)
            elif kind == "break":
                parts.append(" ")
                if name in ("br", "hr", "meta"):
                    tags.add(name)
                elif closing:
                    tags.add(name)
                    while around and around.pop() != name:
                        pass
                else:
                    around.clear()
                    around.append(name)
            elif kind == "block":
                within = False
                if parts:
                    said = "".join(parts)
                    if _WORDY.search(said):
                        leaves.append(Leaf(n, stack[-1], _shown(said), frozenset(tags)))
                    parts.clear()
                tags = set()
                around.clear()
                if not closing:
                    if not whole:
                        names.append(name)
                        parents.append(stack[-1])
                        stack.append(len(names) - 1)
                elif any(names[s] == name for s in stack[1:]):
                    while names[stack.pop()] != name:
                        pass
            elif not closing and not whole:
                silent = name
        if parts:
            said = "".join(parts)
            if _WORDY.search(said):
                leaves.append(Leaf(n, stack[-1], _shown(said), frozenset(tags)))
        if plain and within and not silent and not around:
            _keep(line, ("", leaves[-1].text, leaves[-1].tags) if len(leaves) > before else ("", "", _NONE))
    return Page(names, parents, leaves, " ".join(unescape("".join(title)).split()), True)


def visible_lines(text: str) -> list[tuple[int, str]]:
    """(line number from 1, what a reader sees of it) for the lines with a letter or digit; the head's title counts as seen."""
    if not is_markup(text):
        return [(n, " ".join((unescape(line) if "&" in line else line).split())) for n, line in enumerate(text.split("\n"), 1) if _WORDY.search(line)]
    out: list[tuple[int, str]] = []
    for leaf in _read_markup(text).leaves:
        if out and out[-1][0] == leaf.line:
            out[-1] = (leaf.line, f"{out[-1][1]} {leaf.text}")
        else:
            out.append((leaf.line, leaf.text))
    return out
