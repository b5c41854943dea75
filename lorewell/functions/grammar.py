"""The grammar of a note: front matter, fences, links, excerpts, statistics.

Everything here takes one text and knows nothing of Spark. The rules are stated as patterns;
the only state carried along is the open fence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import regex

from lorewell.functions.names import WHITE, collapse, document_key, document_name, trim, words

_LINES = regex.compile(r"[^\n]*\n|[^\n]+\Z")
_CODE = regex.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", regex.S)
_WIKI = regex.compile(r"\[\[(.*?)\]\]", regex.S)
_MARKDOWN = regex.compile(r"(!?)\[[^\]]*\]\(([^)]*)\)")
_ANY_MARKDOWN = regex.compile(r"\[[^\]]*\]\(([^)]*)\)")
_PIPE = regex.compile(r"(?P<target>[^|]*?)(?P<escape>(?<!\\)(?:\\\\)*\\)?\|(?P<label>.*)", regex.S)
_FENCE = regex.compile(r"`{3,}|~{3,}")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_NOT_ALNUM = regex.compile(rf"[^\p{{Alphabetic}}\p{{N}}{WHITE}]+")
_LINE_MARKUP = regex.compile(r">|[-*+](?=[ \t\f\r\n])|[0-9]+[.)](?=[ \t\f\r\n])|\[[ xX]\](?=[ \t\f\r\n])|#{1,6}(?=[ \t\f\r\n]|$)")
# Fixed value: signs that separate words in the normalised form.
_AS_SPACE = {ord(c): " " for c in "[]()*_#>!|-"}


class Front(NamedTuple):
    present: bool = False
    body_offset: int = 0
    title: str = ""
    aliases: tuple[str, ...] = ()
    end: int = 0  # characters up to the body


class Link(NamedTuple):
    kind: str
    display_target: str
    target_key: str
    raw_target: str
    context: str


def lines_of(text: str) -> list[str]:
    """Lines with their ends; a last line may have none."""
    return _LINES.findall(text)


def bare(line: str) -> str:
    return line.rstrip("\r\n")


def unquoted(value: str) -> str:
    value = trim(value)
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value


def quoted_commas(value: str) -> list[str]:
    """Parts between commas that stand outside quotes."""
    parts, quote, start = [], "", 0
    for at, char in enumerate(value):
        if char in "\"'" and not quote:
            quote = char
        elif char == quote:
            quote = ""
        elif char == "," and not quote:
            parts.append(value[start:at])
            start = at + 1
    return [*parts, value[start:]]


def key_value(line: str) -> tuple[str, str] | None:
    key, colon, value = line.partition(":")
    return (trim(key), trim(value)) if colon else None


def indented(line: str) -> bool:
    return line[:1] in (" ", "\t")


def front_block(lines: list[str]) -> int:
    """Number of lines of the front matter with both its rulers; 0 if there is none."""
    if not lines or bare(lines[0]) != "---":
        return 0
    return next((i + 1 for i, line in enumerate(lines[1:], 1) if bare(line) == "---"), 0)


def front_matter(text: str) -> Front:
    lines = lines_of(text) if text.startswith("---") else []
    count = front_block(lines)
    if not count:
        return Front()
    title, aliases = "", []
    block = [bare(line) for line in lines[1 : count - 1]]
    at = 0
    while at < len(block):
        pair = key_value(block[at]) if block[at] and not indented(block[at]) else None
        at += 1
        if pair is None:
            continue
        key, value = pair
        if key == "title":
            title = unquoted(value)
        elif key == "aliases" and value:
            aliases += inline_list(value) if value[0] == "[" and value[-1] == "]" else [unquoted(value)]
        elif key == "aliases":
            while at < len(block) and (not block[at] or indented(block[at])):
                item = trim(block[at])
                if item.startswith("- "):
                    aliases.append(unquoted(item[2:]))
                at += 1
    head = "".join(lines[:count])
    return Front(True, len(head.encode()), title, tuple(dict.fromkeys(a for a in aliases if a)), len(head))


def inline_list(value: str) -> list[str]:
    inner = trim(value[1:-1])
    parts = quoted_commas(inner) if inner else []
    return [unquoted(p) for p in (parts[:-1] if parts and not parts[-1] else parts)]


def body_lines(body: str) -> Iterator[tuple[int, str, str, bool]]:
    """(number from 0, line, trimmed line, whether hidden) of a body; fence lines and what they enclose are hidden."""
    fence = ""
    for number, line in enumerate(lines_of(body)):
        text = trim(line)
        run = _FENCE.match(text)
        if run is None:
            yield number, line, text, bool(fence)
            continue
        if not fence:
            fence = run[0]
        elif run[0][0] == fence[0] and len(run[0]) >= len(fence):
            fence = ""
        yield number, line, text, True


def masked(line: str) -> str:
    """The line with the inside of inline code as spaces, at the same length."""
    return _CODE.sub(lambda m: m[1] + " " * len(m[2]) + m[1], line) if "`" in line else line


def wiki_parts(inner: str) -> tuple[str, str | None, bool]:
    """Target, label (None without one) and whether the separator is escaped."""
    found = _PIPE.match(inner)
    if not found:
        return inner, None, False
    if found["escape"]:
        return inner[: found.end("escape") - 1], found["label"], True
    return found["target"], found["label"], False


def markdown_target(destination: str) -> str | None:
    """The document a destination names; None for headings, addresses and empty ones."""
    destination = destination.lstrip(" \t")
    if destination.startswith("<"):
        target, closed, _ = destination[1:].partition(">")
        if not closed:
            return None
    else:
        target = regex.split(r"[ \t]", destination, maxsplit=1)[0]
    target = trim(target)
    if not target or target.startswith(("#", "mailto:")) or "://" in target:
        return None
    return target


def _link(kind: str, target: str, context: str) -> Link | None:
    base, sign, suffix = target.partition("#")
    key = document_key(base)
    if not key:
        return None
    raw = trim(trim(trim(base).strip("<>")).split("#", 1)[0])
    return Link(kind, (document_name(base) or trim(base)) + sign + suffix, key, raw, context)


def links_in_line(line: str, context: str) -> list[Link]:
    """Wiki links, then Markdown links; images and code are none."""
    if "[" not in line:
        return []
    shown = masked(line)
    found = [_link("wiki", trim(wiki_parts(m[1])[0]), context) for m in _WIKI.finditer(shown)]
    for m in _MARKDOWN.finditer(shown):
        target = None if m[1] else markdown_target(m[2])
        found.append(_link("markdown", target, context) if target else None)
    return [x for x in found if x]


def link_spans(line: str) -> list[tuple[int, int]]:
    """Where links stand in a line; an image's brackets count like a link's."""
    shown = masked(line)
    spans = [m.span() for m in _WIKI.finditer(shown) if document_key(trim(wiki_parts(m[1])[0]).split("#", 1)[0])]
    for m in _ANY_MARKDOWN.finditer(shown):
        target = markdown_target(m[1])
        if target and document_key(target.split("#", 1)[0]):
            spans.append(m.span())
    return spans


def only_a_link(text: str) -> bool:
    """Whether a trimmed line has one link and no letter or digit beside it and its line markup."""
    spans = link_spans(text)
    if len(spans) != 1:
        return False
    (begin, end), rest = spans[0], text
    rest = trim(rest[:begin] + " " * (end - begin) + rest[end:])
    while mark := _LINE_MARKUP.match(rest):
        rest = trim(rest[mark.end() :])
    return _ALNUM.search(rest) is None


class Note(NamedTuple):
    front: Front
    excerpt: str
    links: list[Link]
    link_only: list[tuple[int, str]]


def parse(text: str) -> Note:
    """Front matter, excerpt, links in reading order, and lines that hold nothing but a link."""
    front = front_matter(text)
    head, body = text[: front.end], text[front.end :]
    links: list[Link] = []
    for line in lines_of(head):
        links += links_in_line(line, collapse(bare(line)))
    excerpt, link_only = "", []
    first = head.count("\n") + 1
    for number, line, shown, hidden in body_lines(body):
        if hidden or not shown:
            continue
        if not excerpt and not shown.startswith("#"):
            excerpt = collapse(shown)
        if "[" in line:
            found = links_in_line(line, collapse(shown))
            if len(found) == 1 and only_a_link(shown):
                link_only.append((first + number, shown))
            links += found
    return Note(front, excerpt, links, link_only)


def _visible(text: str) -> list[str]:
    front = front_matter(text)
    return [collapse(shown) for _, _, shown, hidden in body_lines(text[front.end :]) if shown and not hidden]


def sizes(text: str) -> tuple[int, int]:
    """Visible lines and words of the body of a note."""
    visible = _visible(text)
    return len(visible), sum(len(words(line)) for line in visible)


def statistics(text: str) -> tuple[int, int, str]:
    """Visible lines, words, and the normalised text of the body of a note."""
    visible = _visible(text)
    joined = "".join(line + "\n" for line in visible)
    return len(visible), len(words(joined)), normalised(joined)


def normalised(visible: str) -> str:
    """Letters and digits in lower case and single spaces; code is dropped, a backtick without partner hides the rest."""
    kept = "".join(visible.split("`")[::2])
    kept = _NOT_ALNUM.sub("", kept.translate(_AS_SPACE))
    # Letter by letter, a capital sigma never becomes the final form.
    low = "".join(map(str.lower, kept)) if "Σ" in kept else kept.lower()
    return collapse(low)
