"""Problem 6: link variant spellings of a person or organisation to its page.

Method: suffix blocking. The telling word of every entity (a person's surname, an
organisation's place) is indexed by all its suffixes of at least ``LEAST`` letters, of the
word and of the word reversed, and refined by the vault. A word of a link is looked up by
its shortest suffix that, so refined, is not overly common; longer suffixes than (almost)
half a word are never needed, as one typing error leaves one half intact, and so that half
is used however common it is. Pairs of words are compared by longest-common-subsequence
ratio, which alone decides whether two words are spellings of one. Links and pages meet
where such words stand beside others that begin or end alike; names are then compared word
by word: initials, nicknames, abbreviations, acronyms, reordered and left-out parts.

Which titles are persons or organisations, and which short forms belong to a first name,
is learned from all titles, names and aliases: a comma form or a known nickname beside the
same surname shows a person, an "of" form or abbreviation beside the same words shows an
organisation.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lorewell.llm.lookalike import repaired_forms, vocabulary_of
from lorewell.session import Scratch

#: Letters of the shortest indexed suffix, and the least common-subsequence ratio of two words.
LEAST, RATIO = 2, 0.8
#: Telling words of a vault that share a suffix from which it is overly common, so that a longer one is asked for.
COMMON = 32

# What may stand before or after a person's name, and words without weight in names of organisations.
HONORIFICS = frozenset("dr prof professor mr mrs ms miss sir dame herr frau mme mlle dipl ing med phd jr sr".split())
FILLERS = frozenset("the of for and der die das fur von des du de la le".split())


def fold(text: str) -> str:
    """Lower-case letters without accents; ß, ø, æ and the like as letter groups."""
    text = text.casefold().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    """Folded words of a name; dots end abbreviations, hyphens and apostrophes stay inside."""
    return [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", fold(text))]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def alike(a: str, b: str) -> int | None:
    """Errors between two words: 0 if equal, else those of a pair whose ratio is at least ``RATIO``; None for other pairs.

    Errors are the letters of the longer word, on average of both, that the common subsequence
    leaves out; at least one.
    """
    if a == b:
        return 0
    if min(len(a), len(b)) < 3 or 2 * min(len(a), len(b)) < RATIO * (len(a) + len(b)):
        return None
    shared = common_subsequence(a, b)
    if 2 * shared < RATIO * (len(a) + len(b)):
        return None
    return max(1, round((len(a) + len(b)) / 2 - shared))


def abbreviates(short: str, full: str) -> bool:
    """Whether a word is the other's beginning, or its first letter and later ones in order."""
    if len(short) < 2 or len(short) >= len(full) or short[0] != full[0]:
        return False
    if full.startswith(short):
        return True
    return len(short) <= 0.7 * len(full) and common_subsequence(short, full) == len(short)


def without_honorifics(words: list[str]) -> list[str]:
    kept = [w for w in words if w not in HONORIFICS]
    return kept if len(kept) >= 2 else words


def person_errors(words: list[str], title: list[str], nicknames: frozenset[str]) -> float | None:
    """Cost with which the words of a link spell the person of a title, None if they don't.

    One word must be the surname and another the first name, a nickname of it or its
    initial; what is left must fit the middle names, or be one initial where there are none.
    """
    first, *middle, last = title
    best = None
    for i, surname in enumerate(words):
        far = alike(surname, last)
        if far is None or len(surname) < 3:
            continue
        for j, given in enumerate(words):
            if i == j:
                continue
            if len(given) == 1:
                near = 0.3 if given == first[0] else None
            else:
                near = alike(given, first)
                if near is None:
                    near = 0.2 if given in nicknames else next((1.2 for n in nicknames if len(n) > 2 and alike(given, n) is not None), None)
            if near is None:
                continue
            rest = [w for k, w in enumerate(words) if k not in (i, j)]
            extra = 0.0
            open_middle = list(middle)
            for w in rest:
                fit = next((m for m in open_middle if w == m or (len(w) == 1 and w == m[0]) or alike(w, m) is not None), None)
                if fit is not None:
                    open_middle.remove(fit)
                elif not middle and len(w) == 1:
                    extra += 0.1
                else:
                    extra = 9.0
            cost = far + near + extra
            if cost < 2.5 and (best is None or cost < best):
                best = cost
    return best


def organisation_errors(words: list[str], title: list[str], raw: str) -> float | None:
    """Cost with which the words of a link spell the organisation of a title, None if they don't.

    The place and the field must be there, abbreviated or not; the kind may be left out. A
    lone group of capitals may be the initials of all three.
    """
    if len(words) == 1:
        initials = "".join(w[0] for w in title)
        letters = re.sub(r"[^A-Za-z]", "", raw)
        return 0.5 if words[0] == initials and letters.isupper() else None
    if len(words) == len(initials := "".join(w[0] for w in title)) and all(len(w) == 1 for w in words):
        return 0.5 if "".join(words) == initials else None
    words = [w for w in words if w not in FILLERS]
    if not len(title) - 1 <= len(words) <= len(title):
        return None
    place, *others = title
    cost, open_words = None, None
    for i, w in enumerate(words):
        far = alike(w, place)
        if far is not None and len(w) >= 3 and (cost is None or far < cost):
            cost, open_words = far, words[:i] + words[i + 1 :]
    if cost is None:
        return None
    left = list(others)
    for w in open_words:
        fits = [(c, m) for m in left if (c := alike(w, m)) is not None] + [(0.2, m) for m in left if abbreviates(w, m)]
        if not fits:
            return None
        c, m = min(fits)
        cost += c
        left.remove(m)
    if left and (left != [title[-1]] or len(words) < 2):
        return None
    cost += 0.4 * len(left)
    return cost if cost < 2.5 else None


def suffixes(word: str, most: int | None = None) -> list[str]:
    """The suffixes of a word and of the word reversed, of ``LEAST`` to ``most`` letters, shortest first."""
    sizes = range(LEAST, min(len(word), most or len(word)) + 1)
    return [x for n in sizes for x in ("<" + word[:n], word[-n:] + ">")]


def needed(word: str) -> int:
    """Letters of the longest suffix a word is looked up by: an error or a swap of neighbours leaves as many at one end."""
    return max(LEAST, (len(word) - 1) // 2)


def marks(words: list[str]) -> set[str]:
    """First and last letters of words, by which suffixes are refined: one error cannot change both."""
    return {"^" + w[0] for w in words} | {w[-1] + "$" for w in words if len(w) > 1}


def evidence(title: str | None, name: str | None, aliases: list[str] | None) -> list[tuple[str, str, str]]:
    """What a page's spellings show: ('first', name, ''), ('nick', name, short), ('kind', word, '')."""
    parts = words_of(title or "")
    if len(parts) < 2:
        return []
    first, last = parts[0], parts[-1]
    found = set()
    spellings = [s for s in [name, *(aliases or [])] if s]
    for spelling in spellings:
        words = without_honorifics(words_of(spelling))
        before, comma, after = spelling.partition(",")
        if comma and not re.search(r"\b(?:of|for)\b", spelling.lower()):
            surname, given = words_of(before), without_honorifics(words_of(after))
            if len(surname) == 1 and given and alike(surname[0], last) is not None:
                if given[0] == first or given[0] == first[0] or alike(given[0], first) is not None:
                    found.add(("first", first, ""))
                elif len(given[0]) > 1:
                    found.add(("nick", first, given[0]))
        elif re.search(r"\b(?:of|for)\b", spelling.lower()):
            rest = [w for w in words if w not in FILLERS]
            if len(rest) == len(parts) and rest != parts and all(any(alike(w, p) is not None for w in rest) for p in parts):
                found.add(("kind", last, ""))
        elif len(words) == 2 and alike(words[1], last) is not None and alike(words[0], first) is None and len(words[0]) > 1:
            found.add(("nick", first, words[0]))
        elif len(words) == 2 and alike(words[0], last) == 0 and alike(words[1], first) == 0:
            found.add(("first", first, ""))
    return sorted(found)


_EVIDENCE = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("role", "full", "short")]))


@F.pandas_udf(_EVIDENCE)
def _evidence(title: pd.Series, name: pd.Series, aliases: pd.Series) -> pd.Series:
    def of(t, n, a):
        return [dict(zip(("role", "full", "short"), e)) for e in evidence(t, n, None if a is None else [x for x in a if x])] if t else []

    return pd.Series([of(*x) for x in zip(title, name, aliases)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else words_of(x))


_MARKED = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("word", "mark")]))


@F.pandas_udf(_MARKED)
def _entity_words(kind: pd.Series, words: pd.Series, nicknames: pd.Series) -> pd.Series:
    """An entity's telling word with the marks of its other words; its initials as a word of their own."""

    def of(k, w, nicks):
        w = list(w)
        if k == "person":
            return [{"word": w[-1], "mark": m} for m in sorted(marks([w[0], *nicks]))]
        return [{"word": w[0], "mark": m} for m in sorted(marks(w[1:]))] + [{"word": "".join(x[0] for x in w), "mark": "="}]

    return pd.Series([of(*x) for x in zip(kind, words, nicknames)])


@F.pandas_udf(_MARKED)
def _link_words(text: pd.Series) -> pd.Series:
    """Each word of a link that may be the telling one, with the marks of the others; its initials as a word of their own."""

    def of(x):
        words = [w for w in words_of(x) if w not in FILLERS]
        found = {(w, m) for i, w in enumerate(words) if len(w) > LEAST for m in marks(words[:i] + words[i + 1 :])}
        if len(words) == 1 or (words and all(len(w) == 1 for w in words)):
            found.add(("".join(words), "="))
        return [{"word": w, "mark": m} for w, m in sorted(found)]

    return text.map(of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_suffixes(word: pd.Series) -> pd.Series:
    return word.map(suffixes)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _needed_suffixes(word: pd.Series) -> pd.Series:
    return word.map(lambda w: suffixes(w, needed(w)))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) is not None for x, y in zip(a, b)], dtype=bool)


def near_words(asked: DataFrame, telling: DataFrame, common: int = COMMON) -> DataFrame:
    """(vault, word, telling) of the alike words, by their suffixes; both inputs are distinct (vault, word)."""
    index = telling.select("vault", F.col("word").alias("telling"), F.explode(_all_suffixes("word")).alias("suffix"))
    looked = asked.select("vault", "word", F.explode(_needed_suffixes("word")).alias("suffix")).withColumn("letters", F.length("suffix") - 1)
    # The shortest suffix of each end that is not overly common; the longest that is asked for, however common.
    counts = index.groupBy("vault", "suffix").agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(LEAST), F.floor((F.length("word") - 1) / 2))
    found = looked.join(counts, ["vault", "suffix"]).where((F.col("n") <= common) | (F.col("letters") >= last))
    chosen = found.groupBy("vault", "word", F.col("suffix").startswith("<").alias("reversed")).agg(F.min_by("suffix", "letters").alias("suffix"))
    near = chosen.join(index, ["vault", "suffix"]).select("vault", "word", "telling").distinct()
    return near.where(_alike("word", "telling"))


def candidates(texts: DataFrame, known: DataFrame, scratch: Scratch, common: int = COMMON) -> DataFrame:
    """(vault, text, shown, page_id) of the links with a word alike to the telling word of an
    entity, and another word that begins or ends like one of its others.

    Words are compared once a vault, not once a link or page. ``texts`` is (vault, text,
    shown), ``known`` what ``entities`` gives.
    """
    index = scratch.save(known.select("vault", "page_id", F.explode(_entity_words("kind", "words", "nicknames")).alias("k")).select("vault", "page_id", "k.*"))
    held = scratch.save(texts.select("vault", "text", "shown", F.explode(_link_words("shown")).alias("w")).select("vault", "text", "shown", "w.*"))
    words = lambda frame: frame.where("mark <> '='").select("vault", "word").distinct()
    near = scratch.save(near_words(words(held), scratch.save(words(index)), common))
    parts = held.where("mark <> '='").join(near, ["vault", "word"]).join(index.withColumnRenamed("word", "telling"), ["vault", "telling", "mark"])
    whole = held.where("mark = '='").join(index.where("mark = '='").select("vault", "word", "page_id"), ["vault", "word"])
    columns = ["vault", "text", "shown", "page_id"]
    return parts.select(*columns).unionByName(whole.select(*columns)).distinct()


@F.pandas_udf(T.DoubleType())
def _cost(raw: pd.Series, kind: pd.Series, words: pd.Series, nicknames: pd.Series) -> pd.Series:
    def of(x, k, title, nicks):
        found = words_of(x)
        if k == "person":
            return person_errors(without_honorifics(found), list(title), frozenset(nicks))
        return organisation_errors(found, list(title), x)

    return pd.Series([of(*x) for x in zip(raw, kind, words, nicknames)], dtype=float)


def nicknames_in_links(links: DataFrame, persons: DataFrame, firsts: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """(full, short): given names used in links for the one person of a vault with the surname beside them.

    A short form counts if at least ``least`` persons have it, mostly of one first name, and
    if it is no first name itself.
    """
    alone = persons.groupBy("vault", "last").agg(F.count("*").alias("n"), F.min("first").alias("first")).where("n = 1").select("vault", "last", "first")
    pairs = links.select("vault", _words("text").alias("w")).where("size(w) = 2")
    both = pairs.select("vault", F.explode(F.array(F.struct(F.col("w")[0].alias("short"), F.col("w")[1].alias("last")), F.struct(F.col("w")[1].alias("short"), F.col("w")[0].alias("last")))).alias("p"))
    used = both.select("vault", "p.*").where("length(short) > 1").distinct().join(alone, ["vault", "last"]).where("short <> first")
    used = used.join(firsts.select(F.col("first").alias("short")), "short", "left_anti")
    counted = used.groupBy("short", "first").agg(F.count("*").alias("n"))
    best = counted.groupBy("short").agg(F.max(F.struct("n", "first")).alias("b"), F.sum("n").alias("all"))
    return best.where((F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("all"))).select(F.col("b.first").alias("full"), "short")


def entities(pages: DataFrame, front_matter: DataFrame, links: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(vault, page_id, kind, words, nicknames) of the pages whose title and aliases show a person or organisation.

    ``links`` is (vault, text); with it, nicknames used in links alone are learned too.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    # Two rows of one page count once: the one with the greatest spelling.
    front = front_matter.where("page_id is not null").groupBy("page_id").agg(F.max(F.struct("title", "aliases")).alias("f")).select("page_id", "f.*")
    known = pages.select("page_id", "vault", "name").where("page_id is not null and vault is not null").distinct().join(front, "page_id")
    known = known.where(F.col("title").isNotNull())
    known = scratch.save(known)
    shown = scratch.save(known.select(F.explode(_evidence("title", "name", "aliases")).alias("e")).select("e.*").distinct())
    firsts = shown.where("role = 'first'").select(F.col("full").alias("first"), F.lit(True).alias("is_first")).distinct()
    kinds = shown.where("role = 'kind'").select(F.col("full").alias("last"), F.lit(True).alias("is_kind")).distinct()
    nicks = shown.where("role = 'nick'").select("full", "short")
    worded = known.withColumn("words", _words("title")).where("size(words) > 1")
    worded = scratch.save(worded).withColumn("first", F.col("words")[0]).withColumn("last", F.element_at("words", -1))
    if links is not None:
        nicks = nicks.unionByName(nicknames_in_links(links, worded.join(firsts, "first", "left_semi"), firsts))
    nicks = nicks.groupBy(F.col("full").alias("first")).agg(F.collect_set("short").alias("nicknames"))
    typed = worded.join(firsts, "first", "left").join(kinds, "last", "left").join(nicks, "first", "left")
    kind = F.when(F.col("is_kind"), "organisation").when(F.col("is_first"), "person")
    typed = typed.select("vault", "page_id", kind.alias("kind"), "words", F.coalesce("nicknames", F.array().cast("array<string>")).alias("nicknames"))
    return typed.where("kind is not null")


def variant_links(links: DataFrame, pages: DataFrame, front_matter: DataFrame) -> DataFrame:
    """(link_id, page_id) of the unresolved links that are another spelling of a page's person or organisation.

    A link whose text looks the same as a name, title or alias of any page of its vault is
    no case, and neither is one that fits several pages equally well. Null or blank texts,
    vaults and ids give no row; repeated rows of a link count once.
    """
    scratch = Scratch(links.sparkSession)
    open_links = links.where("resolved is null and link_id is not null and vault is not null").select("link_id", "vault", F.regexp_replace(F.substring_index("display_target", "#", 1), r"(?i)\.md$", "").alias("text"))
    open_links = open_links.where(F.length(F.trim("text")) > 0).distinct()
    spellings = front_matter.select("page_id", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text")).where("text is not null")
    titled = spellings.join(pages.select("page_id", "vault"), "page_id").select("vault", "text")
    own = titled.unionByName(pages.select("vault", F.col("name").alias("text"))).where("vault is not null and text is not null").distinct()
    own, texts = scratch.save(own), scratch.save(open_links.select("vault", "text").distinct())
    forms = repaired_forms(own.select("text").unionByName(texts.select("text")), "text", scratch.save(vocabulary_of(own, "text")))
    forms = scratch.save(forms)
    taken = own.join(forms, "text").select("vault", "form").distinct()
    # The repaired text keeps the case the acronyms need only where nothing had to be repaired.
    fresh = texts.join(forms, "text").join(taken, ["vault", "form"], "left_anti")
    fresh = fresh.withColumn("shown", F.when(F.octet_length("text") == F.length("text"), F.col("text")).otherwise(F.col("form")))
    fresh = scratch.save(fresh)
    known = scratch.save(entities(pages, front_matter, texts, scratch))
    pairs = candidates(fresh, known, scratch)
    costs = pairs.join(known.select("page_id", "kind", "words", "nicknames"), "page_id").withColumn("cost", _cost("shown", "kind", "words", "nicknames"))
    costs = costs.where("cost is not null and not isnan(cost)").select("vault", "text", "page_id", "cost")
    ranked = costs.groupBy("vault", "text").agg(F.min(F.struct("cost", "page_id")).alias("best"), F.min("cost").alias("least"), F.collect_list("cost").alias("costs"))
    lone = ranked.where(F.size(F.filter("costs", lambda c: c < F.col("least") + 0.05)) == 1)
    return open_links.join(lone.select("vault", "text", F.col("best.page_id").alias("page_id")), ["vault", "text"]).select("link_id", "page_id").distinct()
