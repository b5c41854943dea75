"""Problem 3: one form for text that looks the same but has different characters.

Method: script-aware repair. Invisible characters go, compatibility forms (full width,
ligatures, special hyphens and spaces) become plain, accents compose. Then, per token, the
dominant script is determined; look-alike letters are substituted only in tokens that mix
scripts, and only if the result exists in the corpus vocabulary. The dominant script is
tried first, the other scripts of the token after it. A token of one script inside a text of
another one ("ΟΗ-12 seedbed" in Greek capitals) counts as mixed with the words around it if
all its letters have look-alikes in the text's dominant script.

A visible accent stays: it makes a different form. Letter case is folded last, after the
substitution, because capitals and small letters have different look-alikes.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Letters that look like a Latin letter, by script, in the order of the Latin ones.
_LATIN_FOR_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏԌԚԜҮѴѵ", "ABESIJKMHOPCTYXaesijopcyxhdqwlGQWYVv", strict=True))
_LATIN_FOR_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικυγτχϲϳϹͿ", "ABEZHIKMNOPTYXavopikuytxcjCJ", strict=True))

_SCRIPTS = ("latin", "cyrillic", "greek")
_TABLES: dict[tuple[str, str], dict[int, str]] = {
    ("cyrillic", "latin"): str.maketrans(_LATIN_FOR_CYRILLIC),
    ("greek", "latin"): str.maketrans(_LATIN_FOR_GREEK),
    ("latin", "cyrillic"): str.maketrans({b: a for a, b in reversed(_LATIN_FOR_CYRILLIC.items())} | {"k": "к", "m": "м", "t": "т", "n": "п", "r": "г"}),
    ("latin", "greek"): str.maketrans({b: a for a, b in reversed(_LATIN_FOR_GREEK.items())}),
    ("cyrillic", "greek"): str.maketrans({a: {v: k for k, v in _LATIN_FOR_GREEK.items()}[b] for a, b in _LATIN_FOR_CYRILLIC.items() if b in set(_LATIN_FOR_GREEK.values())}),
    ("greek", "cyrillic"): str.maketrans({a: {v: k for k, v in _LATIN_FOR_CYRILLIC.items()}[b] for a, b in _LATIN_FOR_GREEK.items() if b in set(_LATIN_FOR_CYRILLIC.values())}),
}

# Hyphens that are printed as the plain one, and quotes as the plain ones.
_PLAIN = str.maketrans({"‐": "-", "‑": "-", "﹣": "-", "－": "-", "ˈ": "'", "ʹ": "'"})


def script(char: str) -> str | None:
    """Script of a letter among those with look-alikes; None for anything else."""
    code = ord(char)
    if code < 0x41:
        return None
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin" if char.isalpha() else None
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek" if char.isalpha() else None
    if 0x400 <= code < 0x530:
        return "cyrillic" if char.isalpha() else None
    return None


def _visible(text: str) -> str:
    """Without format characters, variation selectors and fillers; with every space plain."""
    out = []
    for char in text:
        kind = unicodedata.category(char)
        if kind == "Cf" or "︀" <= char <= "️" or char in "͏ᅟᅠㅤﾠ឴឵":
            continue
        out.append(" " if kind in ("Zs", "Zl", "Zp") or char in "\t\n\r\x0b\x0c\x85" else char)
    return "".join(out)


def _compatible(char: str) -> str:
    """The plain form of a full- or half-width character or ligature; others as they are."""
    code = ord(char)
    if 0xFF01 <= code <= 0xFFEE or 0xFB00 <= code <= 0xFB06 or 0xFB13 <= code <= 0xFB17 or 0x1D400 <= code <= 0x1D7FF or char in "ĲĳǄǅǆǇǈǉǊǋǌŀĿ":
        return unicodedata.normalize("NFKC", char)
    return char


@lru_cache(maxsize=1 << 16)
def plain_form(text: str) -> str:
    """Everything but the look-alike letters; runs of spaces are one space, ends are trimmed."""
    text = _visible(text)
    text = "".join(map(_compatible, text)).translate(_PLAIN)
    text = unicodedata.normalize("NFC", text)
    return re.sub(" +", " ", text).strip(" ")


def mixed(token: str) -> bool:
    """Whether a token holds letters of two scripts that have look-alikes."""
    return len({s for s in map(script, token) if s}) > 1


def options(token: str) -> list[str]:
    """What a mixed token may have been meant as, the dominant script first (ties: Latin,
    Cyrillic, Greek); empty for a token of one script. Accents are kept on their letters."""
    counts = {s: 0 for s in _SCRIPTS}
    for char in token:
        if s := script(char):
            counts[s] += 1
    present = [s for s in _SCRIPTS if counts[s]]
    if len(present) < 2:
        return []
    found = []
    for target in sorted(present, key=lambda s: -counts[s]):
        parts = unicodedata.normalize("NFD", token)
        swapped = "".join(c if script(c) in (None, target) else c.translate(_TABLES[script(c), target]) for c in parts)
        whole = unicodedata.normalize("NFC", swapped)
        if not mixed(whole):
            found.append(whole)
    return found


def foreign(token: str, dominant: str) -> str | None:
    """A token of one script spelled in another, the dominant one of its text, if all its letters can be."""
    own = {s for s in map(script, token) if s}
    if len(own) != 1 or dominant in own:
        return None
    swapped = unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(_TABLES[own.pop(), dominant]))
    return swapped if all(script(c) in (None, dominant) for c in swapped) else None


def dominant_script(text: str) -> str | None:
    """The script of most letters of a text (ties: Latin, Cyrillic, Greek); None without letters of these."""
    counts = [sum(script(c) == s for c in text) for s in _SCRIPTS]
    return _SCRIPTS[counts.index(max(counts))] if any(counts) else None


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and marks, and what stands between them."""
    return re.findall(r"[^\W_]+|[\W_]+", text)


_plain_udf = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else plain_form(x)), T.StringType())


def plain(column: Column) -> Column:
    """``plain_form`` of a column; ASCII-only text without runs of spaces never leaves the JVM."""
    simple = (F.octet_length(column) == F.length(column)) & ~column.rlike(r"^ |  |[\t-\r\x1c-\x1f]| $")
    return F.when(simple, column).otherwise(_plain_udf(F.when(~simple, column)))


_OPTIONS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("script", T.StringType()), T.StructField("options", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_OPTIONS)
def _mixed_tokens(texts: pd.Series) -> pd.Series:
    def of(text):
        if text is None:
            return None
        found, dominant = [], dominant_script(text)
        for t in dict.fromkeys(tokens(text)):
            if mixed(t):
                found.append({"token": t, "script": "", "options": options(t)})
            elif whole := foreign(t, dominant):
                found.append({"token": t, "script": dominant, "options": [whole]})
        return found

    return texts.map(of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _whole_tokens(texts: pd.Series) -> pd.Series:
    """Lower-case tokens of one script, the vocabulary entries of a text."""
    return texts.map(lambda x: None if x is None else list({t.lower() for t in tokens(x) if t[:1].isalnum() and not mixed(t)}))


@F.pandas_udf(T.StringType())
def _substituted(texts: pd.Series, repairs: pd.Series) -> pd.Series:
    def of(text, pairs):
        known = {p["token"]: p["repaired"] for p in pairs}
        return "".join(known.get(t, t) for t in tokens(text))

    return pd.Series([of(t, p) for t, p in zip(texts, repairs)])


#: A Java pattern: the text holds a Cyrillic or Greek letter next to a Latin one somewhere.
_BOTH = r"(?s)(?=.*[A-Za-z\x{C0}-\x{24F}\x{370}-\x{3FF}\x{1F00}-\x{1FFF}])(?=.*[\x{370}-\x{52F}\x{1F00}-\x{1FFF}])"


def repaired_forms(texts: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """(text, form) of every distinct non-null value of ``column``, ``form`` without look-alikes and lower-case.

    ``vocabulary`` is (token), lower-case words of one script. Only values with letters of
    two scripts are split into tokens and joined with it, on the distinct mixed tokens.
    """
    distinct = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    formed = distinct.withColumn("plain", plain(F.col("text")))
    suspect = F.col("plain").rlike(_BOTH)
    marked = formed.where(suspect).select("text", "plain", F.explode(_mixed_tokens("plain")).alias("m"))
    tries = marked.select("m.token", "m.script", F.posexplode("m.options").alias("rank", "repaired")).distinct()
    known = tries.withColumn("key", F.lower("repaired")).join(vocabulary.select(F.col("token").alias("key")), "key", "left_semi")
    best = known.groupBy("token", "script").agg(F.min_by("repaired", "rank").alias("repaired"))
    per_text = marked.select("text", "plain", "m.token", "m.script").join(best, ["token", "script"]).groupBy("text", "plain").agg(F.collect_list(F.struct("token", "repaired")).alias("repairs"))
    fixed = per_text.select("text", F.lower(_substituted("plain", "repairs")).alias("fixed"))
    return formed.join(fixed, "text", "left").select("text", F.coalesce("fixed", F.lower("plain")).alias("form"))


def vocabulary_of(texts: DataFrame, column: str) -> DataFrame:
    """(token) of all lower-case one-script words of a column, over all rows."""
    plain_text = plain(F.col(column))
    ascii_words = F.array_distinct(F.split(F.lower(column), r"[^a-z0-9]+"))
    simple = F.octet_length(column) == F.length(column)
    words = texts.where(F.col(column).isNotNull()).select(F.explode(F.when(simple, ascii_words).otherwise(_whole_tokens(F.when(~simple, plain_text)))).alias("token"))
    return words.where("token <> ''").distinct()


def link_name(raw: Column) -> Column:
    """A raw target without a leading ``./`` and a trailing ``.md``."""
    return F.regexp_replace(F.regexp_replace(raw, r"^\./", ""), r"(?i)\.md$", "")


def look_alike_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(link_id, page_id): links whose target is no page's name of their vault, letter case
    aside, but looks the same as the name of that page.

    Null targets, names, vaults and ids give no row; a repeated row counts once; a link that
    looks like several pages of its vault gets a row for each. The vocabulary is the words
    of all page names of all vaults.
    """
    names = pages.select("page_id", "vault", "name").where("page_id is not null and name is not null").distinct()
    targets = links.select("link_id", "vault", link_name(F.col("raw_target")).alias("target")).where("link_id is not null and target is not null").distinct()
    both = targets.select("vault", F.col("target").alias("text")).distinct()
    # A target that is a name, character for character, needs no form.
    exact = names.select("vault", F.lower("name").alias("low")).distinct()
    open_targets = both.withColumn("low", F.lower("text")).join(exact, ["vault", "low"], "left_anti").select("vault", "text")
    vocabulary = vocabulary_of(names, "name")
    forms = repaired_forms(names.select(F.col("name").alias("text")).unionByName(open_targets.select("text")), "text", vocabulary)
    page_forms = names.join(forms, names["name"] == forms["text"]).select("vault", "form", "page_id")
    target_forms = open_targets.join(forms, "text").join(page_forms, ["vault", "form"]).select("vault", F.col("text").alias("target"), "page_id")
    return targets.join(target_forms, ["vault", "target"]).select("link_id", "page_id").distinct()


def canonical_names(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(origin, text, form) of every distinct page name and link target."""
    names = pages.select(F.lit("name").alias("origin"), F.col("name").alias("text"))
    targets = links.select(F.lit("raw_target").alias("origin"), link_name(F.col("raw_target")).alias("text"))
    every = names.unionByName(targets).where("text is not null").distinct()
    return every.join(repaired_forms(every, "text", vocabulary_of(pages, "name")), "text").select("origin", "text", "form")
