"""Commands over a folder of notes: ``python -m lorewell.cli COMMAND [flags]``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

import lorewell
from lorewell.plans import report
from lorewell.plans.wiki import Wiki
from lorewell.sources import notes

USAGE = """usage: lorewell COMMAND [-root DIR] [-recursive] ...
  lint                      check the graph of links
  format                    rewrite notes in the default style
  links DOCUMENT            what a document links to and is linked from
  path FROM TO              the shortest path between two documents
  wanted                    pages that are linked but missing (-n 10, -sources 10; 0 shows all sources)
  avg-shortest-path         average path length (-samples 500, -examples 1, -seed 1)
  suggest                   candidates for refactoring (--filter NAMES, --samples 2000, --paths 5, -n 10, -seed 1,
                            --long-lines 120, --long-words 1200, --short-words 40, --duplicate-threshold 0.82)
  rename OLD NEW            rename a document and the links to it
  version, help"""

#: Flags of each command: name, option and type. ``-x`` and ``--x`` are the same flag.
_FLAGS: dict[str, dict[str, tuple[str, type]]] = {
    "wanted": {"n": ("limit", int), "sources": ("sources", int)},
    "avg-shortest-path": {"samples": ("samples", int), "examples": ("examples", int), "seed": ("seed", int)},
    "suggest": {
        "filter": ("filters", str), "samples": ("samples", int), "paths": ("paths", int), "n": ("limit", int), "limit": ("limit", int), "seed": ("seed", int), "long-lines": ("long_lines", int),
        "long-words": ("long_words", int), "short-words": ("short_words", int), "duplicate-threshold": ("threshold", float),
    },
}
_POSITIONALS = {"links": 1, "path": 2, "rename": 2, "wanted": 0, "suggest": 0, "format": 0}
_COMMANDS = ("lint", "format", "links", "path", "wanted", "avg-shortest-path", "suggest", "rename")


class Failure(Exception):
    """Something to tell the user; the command ends with code 1."""


def parse(command: str, arguments: list[str]) -> tuple[str, bool, dict, list[str]]:
    """Root, whether nested, options and positionals; ``Failure`` for what the command doesn't know."""
    root, nested, options, rest = ".", False, {}, []
    flags = _FLAGS.get(command, {})
    items = iter(arguments)
    for item in items:
        if not item.startswith("-"):
            rest.append(item)
            continue
        name, given, value = item.lstrip("-").partition("=")
        if name in ("recursive", "r"):
            nested = True
            continue
        if name != "root" and name not in flags:
            raise Failure(f"flag provided but not defined: {item}")
        if not given:
            value = next(items, None)
            if value is None:
                raise Failure(f"flag needs an argument: {item}")
        if name == "root":
            root = value
            continue
        option, kind = flags[name]
        try:
            options[option] = kind(value)
        except ValueError:
            raise Failure(f"bad value for {item}: {value}") from None
        if kind is int and options[option] < 0:
            raise Failure(f"{name} must not be negative")
    if command in _POSITIONALS and len(rest) != _POSITIONALS[command]:
        raise Failure(f"{command} takes {_POSITIONALS[command]} document arguments")
    if "filters" in options:
        options["filters"] = tuple(x.strip() for x in options["filters"].split(",") if x.strip())
        unknown = [x for x in options["filters"] if x not in report.FILTERS]
        if unknown or not options["filters"]:
            raise Failure(f"unknown filter {unknown[0]}" if unknown else "no filter given")
    if not 0 <= options.get("threshold", 0.5) <= 1:
        raise Failure("duplicate threshold must be between 0 and 1")
    return root, nested, options, rest


def run(spark: SparkSession, command: str, arguments: list[str]) -> tuple[str, int]:
    """The text a command prints and its exit code."""
    root, nested, options, rest = parse(command, arguments)
    wiki = Wiki(notes.read_folder(spark, root, nested), nested).check()
    vault = next((r["vault"] for r in wiki.documents.select("vault").head(1)), "")
    if command == "lint":
        text, failed = report.lint(wiki)
        return text, int(failed)
    if command == "format":
        rewritten = wiki.scratch.save(wiki.formatted())
        changed = rewritten.where("changed")
        names = [r["rel_file"][:-3] for r in changed.select("rel_file").orderBy("page_id").toLocalIterator()]
        notes.apply_changes(changed.select("rel_file", "new_content"), root)
        return "\n".join([f"// format documents={rewritten.count()} changed={len(names)}", *names]), 0
    if command == "links":
        return report.links(wiki, wiki.find(rest[0], vault)), 0
    if command == "path":
        return report.path(wiki, *(wiki.find(x, vault) for x in rest)), 0
    if command == "wanted":
        return report.wanted_list(wiki, **options), 0
    if command == "avg-shortest-path":
        return report.average_path(wiki, **options), 0
    if command == "suggest":
        return report.suggest(wiki, **options), 0
    from lorewell.operators.rewrite import rename_totals

    touched = wiki.scratch.save(wiki.renamed(rest[0], rest[1], vault))
    totals = rename_totals(touched).first()
    moved = touched.where("rel_file <> new_rel_file").head(1)
    names = (moved[0]["rel_file"][:-3], moved[0]["new_rel_file"][:-3]) if moved else (rest[0], rest[1])
    notes.apply_changes(touched.select("rel_file", "new_rel_file", "new_content"), root)
    return f"// rename old={names[0]} new={names[1]} files_touched={totals['files_touched']} links_updated={totals['links_updated']} title_updated={str(totals['title_updated']).lower()}", 0


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] not in (*_COMMANDS, "help", "version", "-h", "-help", "--help", "-version", "--version"):
        print(USAGE, file=sys.stderr)
        return 2
    command, rest = arguments[0], arguments[1:]
    if command.lstrip("-") in ("h", "help") or any(x.lstrip("-") in ("h", "help") and x.startswith("-") for x in rest):
        print(USAGE, file=sys.stderr)
        return 0
    if command.lstrip("-") == "version":
        print(lorewell.__version__)
        return 0
    try:
        parse(command, rest)
        text, code = run(SparkSession.builder.appName("lorewell").getOrCreate(), command, rest)
    except (Failure, LookupError, ValueError, FileNotFoundError) as why:
        print(f"lorewell: {why}", file=sys.stderr)
        return 1
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
