"""Names, keys and paths of documents, as plain functions and as columns.

White space is Unicode's White_Space property everywhere (``str.strip`` alone would also
take control characters U+001C to U+001F).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Fixed value: the characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_RUNS = re.compile(f"[{WHITE}]+")


def trim(text: str) -> str:
    return text.strip(WHITE)


def words(text: str) -> list[str]:
    return [w for w in _RUNS.split(text) if w]


def collapse(text: str) -> str:
    """Words joined by single spaces."""
    return " ".join(words(text))


def clean_path(path: str) -> str:
    """A path without ``.`` and with ``..`` applied; a leading slash is dropped, nothing is ``.``."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == ".." and kept and kept[-1] != "..":
            kept.pop()
        elif part not in ("", "."):
            kept.append(part)
    return "/".join(kept) or "."


def clean_relative(path: str) -> str:
    """``clean_path`` of a path inside a collection; the collection itself is the empty string."""
    cleaned = clean_path(trim(path).removeprefix("./"))
    return "" if cleaned in (".", "/") else cleaned


def resolve_from(folder: str, target: str) -> str:
    """A target as seen from a document's folder."""
    return clean_relative(f"{folder}/{target}" if folder not in ("", ".") else target)


def folder_of(path: str) -> str:
    return clean_relative(path).rpartition("/")[0]


def without_extension(path: str) -> str:
    return path[:-3] if path[-3:].lower() == ".md" else path


def document_name(text: str) -> str:
    """The name a link or identifier means: the last path segment without heading and ``.md``, composed (NFC)."""
    text = trim(text).strip("<>")
    if not text:
        return ""
    last = clean_path(text.split("#", 1)[0].removeprefix("./")).rsplit("/", 1)[-1]
    return unicodedata.normalize("NFC", trim(without_extension(last)))


def document_key(text: str) -> str:
    return document_name(text).lower()


def path_key(path: str) -> str:
    """The key of a document in a nested collection: its whole path."""
    return unicodedata.normalize("NFC", without_extension(clean_relative(path))).lower()


@F.pandas_udf(T.StringType())
def _key_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else document_key(x))


@F.pandas_udf(T.StringType())
def _path_key_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else path_key(x))


def key_column(text: Column) -> Column:
    """``document_key`` of a column; plain ASCII names without path signs stay in the JVM."""
    simple = text.rlike(r"^[A-Za-z0-9(][A-Za-z0-9 ,'()&_-]*[A-Za-z0-9)]$")
    return F.when(simple, F.lower(text)).otherwise(_key_udf(F.when(~simple, text)))


def path_key_column(path: Column) -> Column:
    return _path_key_udf(path)


def white_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def preview(text: Column, limit: int = 140) -> Column:
    """Text cut to ``limit`` characters with three dots at the end where it is longer."""
    trimmed = white_trimmed(F.coalesce(text, F.lit("")))
    if limit <= 3:
        return F.when(F.length(trimmed) <= limit, trimmed).otherwise("." * limit)
    return F.when(F.length(trimmed) <= limit, trimmed).otherwise(F.concat(white_trimmed(F.substring(trimmed, 1, limit - 3)), F.lit("...")))


def document_line(name: Column, excerpt: Column) -> Column:
    shown = preview(excerpt)
    return F.concat(F.lit("[["), name, F.lit("]]: "), F.when(shown == "", "(empty)").otherwise(shown))
