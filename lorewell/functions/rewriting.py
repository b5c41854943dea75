"""Rewriting of notes: one default style, and links that follow a renamed document."""

from __future__ import annotations

import regex

from lorewell.functions import grammar as g
from lorewell.functions.names import WHITE, clean_relative, document_key, document_name, folder_of, trim

_HEADING = regex.compile(rf"([{WHITE}]*)(#{{1,6}})(?!#)[ \t\n\f\r](.*)", regex.S)
_BULLET = regex.compile(rf"([{WHITE}]*)[*+][ \t\n\f\r](.*)", regex.S)
_LABELLED = regex.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_WIKI = regex.compile(r"\[\[(.*?)\]\]", regex.S)
# What makes a plain YAML value need quotes, and signs no file name may hold.
_QUOTE_FIRST, _QUOTE_ANY, _FORBIDDEN = "-{}[]&*#!|>@`", (": ", " #", "[", "]", ","), '/\\<>:"|?*'
_LISTS = ("aliases", "tags")


def yaml_scalar(value: str) -> str:
    if value and value[0] not in _QUOTE_FIRST and not any(sign in value for sign in _QUOTE_ANY):
        return value
    escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\0")
    return '"' + "".join(c if c.isprintable() else f"\\u{{{ord(c):x}}}" for c in escaped) + '"'


def _top_key(line: str) -> str | None:
    if not trim(line) or g.indented(line) or line.lstrip(WHITE).startswith("#"):
        return None
    pair = g.key_value(line)
    return pair[0] if pair else None


def _list_values(entry: list[str]) -> list[str]:
    pair = g.key_value(trim(entry[0]))
    value = pair[1] if pair else ""
    if value.startswith("[") and value.endswith("]"):
        inner = trim(value[1:-1])
        found = g.quoted_commas(inner) if inner else []
    elif value:
        found = [value]
    else:
        found = [item[2:] for item in map(trim, entry[1:]) if item.startswith("- ")]
    return [v for v in (trim(g.unquoted(x)) for x in found) if v]


def format_front(block: list[str]) -> str:
    """Front matter with title, aliases and tags first, lists as blocks without repeats, the rest as it was."""
    entries: list[tuple[str | None, list[str]]] = []
    for line in block:
        text = g.bare(line).rstrip(WHITE)
        key = _top_key(text)
        if key is None and entries:
            entries[-1][1].append(text)
        else:
            entries.append((key, [text]))
    title, rest = "", []
    lists: dict[str, list[str]] = {name: [] for name in _LISTS}
    for key, entry in entries:
        if key == "title":
            title = trim(g.unquoted(g.key_value(trim(entry[0]))[1]))
        elif key in lists:
            lists[key] += _list_values(entry)
        else:
            rest += entry
    out = ["---"] + ([f"title: {yaml_scalar(title)}"] if title else [])
    for name, values in lists.items():
        if values:
            out += [f"{name}:", *(f"  - {yaml_scalar(v)}" for v in dict.fromkeys(values))]
    return "\n".join([*out, *rest, "---"]) + "\n\n"


def _spaced_wiki(inner: str) -> str:
    target, label, escaped = g.wiki_parts(inner)
    if escaped:
        return trim(inner)
    base, sign, suffix = trim(target).partition("#")
    target = f"{trim(base)}{sign}{trim(suffix)}" if sign else base
    return f"{target}|{trim(label)}" if label is not None and trim(label) else target


def format_line(line: str) -> str:
    heading = _HEADING.fullmatch(line)
    if heading:
        line = f"{heading[1]}{heading[2]} {trim(trim(heading[3]).rstrip('#'))}"
    elif bullet := _BULLET.fullmatch(line):
        line = f"{bullet[1]}- {bullet[2].lstrip(WHITE)}"
    if "`" in line:
        return line
    line = _LABELLED.sub(lambda m: f"[{trim(m[1])}]({trim(m[2])})", line)
    return _WIKI.sub(lambda m: f"[[{_spaced_wiki(m[1])}]]", line)


def format_body(body: str) -> str:
    """Body lines in the default style: blank lines around headings, single elsewhere, none at the ends."""
    out: list[str] = []
    after_heading, fence = False, ""
    for line in g.lines_of(body):
        raw = g.bare(line)
        run = g._FENCE.match(trim(raw))
        if fence and not run:
            out.append(raw)
            continue
        shown = raw if run else format_line(raw.rstrip(WHITE))
        if not run and not trim(shown):
            if out and out[-1]:
                out.append("")
            continue
        heading = _HEADING.fullmatch(shown) is not None
        if (heading or after_heading) and out and out[-1]:
            out.append("")
        out.append(shown)
        after_heading = heading
        if run and not fence:
            fence = run[0]
        elif run and run[0][0] == fence[0] and len(run[0]) >= len(fence):
            fence = ""
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def format_note(text: str) -> str:
    """A note in the default style, ending in one line break. Formatting twice changes nothing more."""
    lines = g.lines_of(text)
    count = g.front_block(lines)
    front = format_front(lines[1 : count - 1]) if count else ""
    return (front + format_body("".join(lines[count:]))).rstrip("\n") + "\n"


def new_name(wanted: str) -> str:
    """A name a document can be renamed to, or ``ValueError``."""
    name = document_name(wanted)
    if not name:
        raise ValueError("new document name must not be empty")
    if any(c in _FORBIDDEN for c in name):
        raise ValueError(f'new document name "{name}" contains invalid path characters')
    return name


def renamed_path(rel_path: str, wanted: str, nested: bool) -> str:
    """The path, without extension, a renamed document moves to."""
    name = new_name(wanted)
    if not nested:
        return name
    if "/" in wanted:
        path = clean_relative(wanted)
        return path[: -len(".md")] if path.endswith(".md") else path
    return clean_relative(f"{folder_of(rel_path)}/{name}" if folder_of(rel_path) else name)


def _retarget_wiki(line: str, key: str, name: str) -> tuple[str, int]:
    out, last, count = [], 0, 0
    for m in _WIKI.finditer(g.masked(line)):
        target, label, escaped = g.wiki_parts(line[m.start(1) : m.end(1)])
        base, sign, suffix = trim(target).partition("#")
        if document_key(base) != key:
            continue
        target = name + (".md" if trim(base).lower().endswith(".md") else "") + sign + suffix
        shown = "" if label is None else ("\\|" if escaped else "|") + label
        out += [line[last : m.start()], f"[[{target}{shown}]]"]
        last, count = m.end(), count + 1
    return "".join([*out, line[last:]]), count


def _retarget_markdown(line: str, key: str, name: str) -> tuple[str, int]:
    out, last, count = [], 0, 0
    for m in _LABELLED.finditer(g.masked(line)):
        begin, end = m.span(2)
        target = g.markdown_target(line[begin:end])
        if not target or document_key(target) != key:
            continue
        at = line.index(target, begin, end)
        base, sign, suffix = target.partition("#")
        folder, slash, file = base.rpartition("/")
        moved = folder + slash + name + (".md" if file.lower().endswith(".md") else "") + sign + suffix
        out += [line[last:at], moved]
        last, count = at + len(target), count + 1
    return "".join([*out, line[last:]]), count


def retarget(text: str, key: str, name: str) -> tuple[str, int]:
    """A note with its links to the document of ``key`` pointing at ``name``, and how many changed."""
    front = g.front_matter(text)
    body = text[front.end :]
    hidden = {number for number, _, _, h in g.body_lines(body) if h}
    lines = [(line, False) for line in g.lines_of(text[: front.end])]
    lines += [(line, number in hidden) for number, line in enumerate(g.lines_of(body))]
    out, count = [], 0
    for line, skip in lines:
        if not skip and "[" in line:
            line, wiki = _retarget_wiki(line, key, name)
            line, markdown = _retarget_markdown(line, key, name)
            count += wiki + markdown
        out.append(line)
    return "".join(out), count


def retitle(text: str, old: str, name: str) -> tuple[str, bool]:
    """A note whose front-matter title, where it is ``old``, is ``name``, in the quotes it had."""
    lines = g.lines_of(text)
    changed = False
    for at in range(1, g.front_block(lines) - 1):
        line = g.bare(lines[at])
        pair = None if g.indented(line) else g.key_value(line)
        if pair and pair[0] == "title" and g.unquoted(pair[1]) == old:
            quote = pair[1][0] if pair[1] != g.unquoted(pair[1]) else ""
            ending = "\r\n" if lines[at].endswith("\r\n") else "\n" if lines[at].endswith("\n") else ""
            lines[at] = f"title: {quote}{name}{quote}{ending}"
            changed = True
    return "".join(lines), changed
