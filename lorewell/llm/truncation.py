"""Problem 10: texts that lost their end.

Method: self-join by prefix. A value is cut where it is a strict prefix of a longer copy
elsewhere. That is applied at three lengths: whole texts (those that share a hashed
beginning, ordered, each compared with its successors), last words (a last word no text
holds inside, but which begins a longer word of the corpus), and the last runs of one to
three words (a run that the corpus always continues is the prefix of longer runs, never
their end). Cut texts seldom have a longer copy of the whole text, so the shorter units
find most cases.

Some endings need no look-up: broken constructs (an open fence, link or table row, a broken
character, an ellipsis set by an exporter) are cut, and terminal punctuation, closed fences
and complete table rows are whole. Last lines without a stop whose runs are too rare for
the join are cut if the text's other lines (or its source's texts) have stops. Which
beginnings mark closing lines (signatures, tags, sources) is read from the corpus too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lorewell.session import Scratch

#: Characters of the hashed prefix that texts must share before they are ordered and compared.
PREFIX = 48
#: Bits (a power of two) of the map of asked runs, which is sent to every worker: a megabyte, whatever the data.
MAP_BITS = 23
#: Tokens counted at once by one worker.
BLOCK = 500_000
#: A run of words seen inside texts at least so often, and ending a unit in less than this share, continues.
SEEN, CONTINUES = 20, 0.03
#: A number before a full stop is cut if its run ends a unit in less than this share.
NUMBER_ENDS = 0.3
#: A line's beginning marks closing lines if it begins this many last lines and so large a share of its lines.
CLOSERS, CLOSING_SHARE = 4, 0.6
#: Sources in which at least this share of lines ends without a stop have texts written so.
UNSTOPPED_SOURCE = 0.04

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[A-Z]{2}-\d+|\d+(?:[.,]\d+)*|[^\W\d_぀-ヿ㐀-鿿]+(?:['’-][^\W\d_]+)*|\S")
_LINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r"(`{3,}|~{3,})")
_HEADING = re.compile(r"#{1,6} ")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)])\s+")
_CLOSED = re.compile(r"[.!?。！？؟।][\"'’”»)\]}*_~`]*\s*[^\w\s.,:;]*$")
_MARK = re.compile(r"\s*(?:…|\.\.\.+|�+|\[(?:…|\.\.\.)\])$")
_NUMBER = re.compile(r"(?:^|[\s(])\d[\d,]*\.$")
_DATE = re.compile(r"\d{1,2}\.? [^\W\d]+ \d{4}$|\d{4}-\d\d-\d\d$|\d{1,2}[./]\d{1,2}[./]\d{4}$")
_SIGNS = re.compile(r"[^\w\s]+\s?")
_STOPS = frozenset(".!?。！？")
_OPENERS = frozenset("“\"'(*_->#«[")


def _mask(token: str, first: bool) -> str:
    if token[0].isdigit():
        return "9" * min(len(token), 4) if token.isdigit() else "9.9"
    if len(token) > 3 and token[2] == "-" and token[3].isdigit():
        return "ID"
    if token[0].isupper() and not first:
        return "N"
    return token.lower()


def _tokens(line: str) -> tuple[list[str], list[str]]:
    """Tokens of a line and their masks: numbers by length, names inside a sentence as N."""
    found = _TOKEN.findall(line)
    masks, first = [], True
    for token in found:
        masks.append(_mask(token, first))
        first = token in _STOPS or (first and token in _OPENERS)
    return found, masks


def lines_of(text: str) -> tuple[list[str], bool, bool]:
    """Non-blank lines outside fences and front matter, whether a fence stays open, and
    whether the text ends with a closing fence."""
    lines, fence, closing = [], "", False
    rows = _LINE.split(text)
    start = 0
    if rows and rows[0].strip() == "---":
        end = next((i for i, x in enumerate(rows[1:], 1) if x.strip() == "---"), None)
        if end is None:
            return [x.strip() for x in rows if x.strip()], True, False
        start = end + 1
    for row in rows[start:]:
        line = row.strip()
        opening = _FENCE.match(line)
        if opening and (not fence or (line[0] == fence[0] and len(opening[1]) >= len(fence))):
            closing, fence = bool(fence), "" if fence else opening[1]
            continue
        if line and not fence:
            lines.append(line)
        closing = closing and not line
    return lines, bool(fence), closing


def opening_key(line: str, found: list[str] | None = None) -> str:
    """What a line begins with: its signs before the first word, or its first two tokens."""
    if signs := _SIGNS.match(line):
        return signs[0]
    if found is None:
        found = [m[0] for m, _ in zip(_TOKEN.finditer(line), range(2))]
    return " ".join(_mask(x, i == 0) for i, x in enumerate(found[:2]))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mask_hash(mask: str) -> int:
    return xxhash.xxh64_intdigest(mask)


def run_place(hashes: list) -> np.ndarray:
    """The place of runs in the map, from the hashes of their masks in order: arrays or numbers."""
    mixed = np.uint64(0)
    for h in hashes:
        mixed = (mixed ^ np.asarray(h, np.uint64)) * _STEP
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * _STEP) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def ending(text: str | None) -> dict | None:
    """What a text's end shows; None for null and blank texts.

    ``state`` is 'whole', 'cut', or what needs the corpus: 'prose', 'item' or 'number'.
    ``word`` is the last word, ``runs`` its masked runs of one to three words, ``key`` the
    last line's beginning, ``lines`` and ``stopped`` count the prose lines before the last
    one that end in a full stop or nothing, and in a full stop.
    """
    if text is None or not text.strip():
        return None
    lines, open_fence, closing_fence = lines_of(text)
    out = {"state": "whole", "word": "", "runs": [], "key": "", "lines": 0, "stopped": 0, "places": []}
    for line in lines[:-1]:
        if len(line) > 40 and not _HEADING.match(line) and not _ITEM.match(line) and line[0] not in "|>":
            bare = line.rstrip("\"'’”»)]*_ ")
            if bare[-1:] not in "!?！？:…":
                out["lines"] += 1
                out["stopped"] += _CLOSED.search(line) is not None
    if open_fence:
        return out | {"state": "cut"}
    if closing_fence or not lines:
        return out
    last = lines[-1]
    out["key"] = opening_key(last)
    mark = _MARK.search(last)
    if mark:
        return out | {"state": "cut"}
    if last.startswith("|"):
        above = lines[-2] if len(lines) > 1 and lines[-2].startswith("|") else last
        whole = last.endswith("|") and len(last) > 1 and last.count("|") == above.count("|")
        return out | {"state": "whole" if whole else "cut"}
    number = _NUMBER.search(last) is not None
    if _CLOSED.search(last) and not number:
        return out
    if last.count("[[") > last.count("]]") or re.search(r"\]\([^)]*$", last):
        return out | {"state": "cut"}
    if _DATE.search(last):
        return out
    found, masks = _tokens(last)
    while masks and not masks[-1][0].isalnum():
        masks.pop(), found.pop()
    if not masks:
        return out
    out["word"] = found[-1]
    ends = [masks[-n:] for n in (1, 2, 3) if len(masks) >= n]
    out["runs"] = [" ".join(x) for x in ends]
    with np.errstate(over="ignore"):
        out["places"] = [int(run_place([mask_hash(m) for m in x])) for x in ends]
    out["state"] = "number" if number else "item" if _ITEM.match(last) else "prose"
    return out


_ENDINGS = "doc_id long, source string, state string, word string, runs array<string>, key string, lines int, stopped int, places array<long>"


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, source, text in batch.itertuples(index=False, name=None):
            found = ending(text)
            if found:
                rows.append((doc, source, *found.values()))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENDINGS.split(", ")])


_UNITS = "kind string, unit string, seen long, ends long, last long"


class _Numbers(dict):
    """Numbers of strings in the order of their first look-up."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class _Later(dict):
    """Numbers of the masks that tokens have inside a sentence."""

    def __init__(self, masks: _Numbers):
        self.masks = masks

    def __missing__(self, token: str) -> int:
        self[token] = number = self.masks[_mask(token, False)]
        return number


class _Block:
    """Counts of words, runs and beginnings of many lines, by arrays of numbered tokens."""

    def __init__(self, asked: np.ndarray):
        self.asked = asked
        self.words, self.masks = _Numbers(), _Numbers()
        self.later = _Later(self.masks)
        self.word, self.mask, self.sizes, self.finals, self.ends = [], [], [], [], []
        self.keys, self.closing = Counter(), Counter()

    def add(self, line: str, final: bool) -> None:
        found = _TOKEN.findall(line)
        key = opening_key(line, found)
        self.keys[key] += 1
        self.closing[key] += final
        most = len(found)
        while most and not found[most - 1][0].isalnum():
            most -= 1
        if not most:
            return
        tokens, words, later = found[:most], self.words, self.later
        masks = [later[t] for t in tokens]
        stops = [i for i, t in enumerate(tokens) if t in _STOPS]
        # What begins a sentence, after quotes and the like too, is read as a first word.
        for i in (0, *[i + 1 for i in stops]):
            while i < most:
                masks[i] = self.masks[_mask(tokens[i], True)]
                if tokens[i] not in _OPENERS:
                    break
                i += 1
        start = len(self.mask)
        self.ends += [start + i - 1 for i in stops if i]
        self.word += [words[t] for t in tokens]
        self.mask += masks
        self.sizes.append(most)
        self.finals.append(final)

    def rows(self) -> pd.DataFrame:
        """Counts of all words and beginnings, and of the runs whose place is set in the map of asked ones."""
        parts = [pd.DataFrame({"kind": "key", "unit": list(self.keys), "seen": list(self.keys.values()), "ends": 0, "last": [self.closing[k] for k in self.keys]})]
        if self.mask:
            word, mask, sizes = (np.array(x, np.int64) for x in (self.word, self.mask, self.sizes))
            closes = np.cumsum(sizes) - 1
            at = np.arange(len(mask)) - np.repeat(closes + 1 - sizes, sizes)
            end, last = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
            end[closes] = end[self.ends] = True
            last[closes] = self.finals
            names, spelled = np.array(list(self.masks), object), np.array([m[0].isalnum() for m in self.masks])
            hashes = np.array([mask_hash(m) for m in self.masks], np.uint64)
            counted = spelled[mask]
            n = len(self.words)
            seen = np.bincount(word[counted], minlength=n)
            held = np.flatnonzero(seen)
            parts.append(pd.DataFrame({"kind": "word", "unit": np.array(list(self.words), object)[held], "seen": seen[held], "ends": 0, "last": np.bincount(word[counted & last], minlength=n)[held]}))
            for size in (1, 2, 3):
                i = np.flatnonzero(counted & (at >= size - 1))
                steps = [mask[i - k] for k in range(size - 1, -1, -1)]
                place = run_place([hashes[m] for m in steps])
                hit = (self.asked[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                i, steps = i[hit], [m[hit] for m in steps]
                key = steps[0]
                for m in steps[1:]:
                    key = key * len(names) + m
                unique, first, back = np.unique(key, return_index=True, return_inverse=True)
                unit = names[steps[0][first]]
                for m in steps[1:]:
                    unit = unit + " " + names[m[first]]
                total = lambda flags: np.bincount(back, weights=flags, minlength=len(unique)).astype(np.int64)
                parts.append(pd.DataFrame({"kind": "run", "unit": unit, "seen": np.bincount(back, minlength=len(unique)), "ends": total(end[i]), "last": total(last[i])}))
        return pd.concat([p for p in parts if len(p)] or parts)


def _units(asked):
    """Per block: how often each word ('word') and asked run ('run') occurs, ends a unit, and is
    a text's very last; and how often each beginning ('key') begins a line and a last line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.frombuffer(asked.value, np.uint8)
        block = _Block(places)
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                lines, _, closing = lines_of(text)
                for n, line in enumerate(lines):
                    block.add(line, n == len(lines) - 1 and not closing)
                    if len(block.mask) >= BLOCK:
                        yield block.rows()
                        block = _Block(places)
        yield block.rows()

    return run


def asked_runs(ends: DataFrame) -> bytes:
    """The map of the runs that end some text: one bit each of 2 ** ``MAP_BITS``, set together by runs that share it.

    It only spares counts that nobody asks for: runs are joined by their text afterwards.
    """
    place = ends.select(F.explode("places").alias("p")).select((F.col("p") + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    found = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in parts.collect():  # at most 2 ** MAP_BITS / 32,768 rows of 4 kB
        found[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return found.tobytes()


_STOP_ONLY = frozenset(".!?。！？؟।")
#: Successors that can lack the decision: one for each closing stop, and one more.
AHEAD = len(_STOP_ONLY) + 1


def _continued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of ordered distinct texts, those that a later one continues; and the texts still open at the end of the part.

    All texts that begin with a text follow it directly, so only texts that nothing but a
    closing stop has continued yet are held.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    columns = ["part", "at", "role", "h", "g", "text"]
    waiting: list[tuple[str, int, int]] = []
    at = 0
    for batch in batches:
        rows = []
        for text, h, g in zip(batch["bare"], batch["h"], batch["g"]):
            if at < AHEAD:
                rows.append((part, at, "first", h, g, text))
            at += 1
            kept = []
            for cut, *key in waiting:
                if text.startswith(cut):
                    if text[len(cut) :] in _STOP_ONLY:
                        kept.append((cut, *key))
                    else:
                        rows.append((part, 0, "cut", *key, None))
            waiting = [*kept, (text, h, g)]
        yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame([(part, 0, "open", h, g, text) for text, h, g in waiting], columns=columns)


def prefix_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX, scratch: Scratch | None = None) -> DataFrame:
    """(key) of the texts that, without an exporter's mark at the end, are a strict prefix of a longer text.

    Texts of ``prefix`` characters and more are looked at if another text has the same hashed
    beginning. They are ordered in ranges; a text's longer copies follow it directly, so each
    is compared with its successors alone, whatever share of all texts begins alike. Shorter
    texts are looked up among the beginnings of all texts, at each length that occurs. Equal
    texts count once. A text that lacks nothing but a closing stop is not cut.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    hashed = lambda c: (F.xxhash64(c).alias("h"), F.xxhash64(F.lit(7), c).alias("g"))
    ended = F.rtrim(F.col(text))
    marked = ended.endswith("…") | ended.endswith("...") | ended.endswith("\ufffd")
    bare = F.when(marked, F.rtrim(F.regexp_replace(ended, r"(?:…|\.\.\.+|\x{FFFD}+)$", ""))).otherwise(ended)
    texts = docs.select(F.col(key), bare.alias("bare")).where(F.length("bare") > 0)
    begin = F.xxhash64(F.substring("bare", 1, prefix)).alias("begin")
    rows = scratch.save(texts.select(key, *hashed(F.col("bare")), begin, F.length("bare").alias("n")))
    shared = scratch.save(rows.where(F.col("n") >= prefix).groupBy("begin").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("begin"))
    distinct = texts.where(F.length("bare") >= prefix).select("bare", begin).join(shared, "begin", "left_semi").select("bare", *hashed(F.col("bare")))
    distinct = scratch.save(distinct.groupBy("h", "g").agg(F.first("bare").alias("bare")))
    ordered = distinct.select("bare", "h", "g").repartitionByRange("bare").sortWithinPartitions("bare")
    compared = scratch.save(ordered.mapInPandas(_continued, "part int, at int, role string, h long, g long, text string"))
    # Texts at the end of a part meet the first ones of the parts that follow: a few rows a part.
    firsts = compared.where("role = 'first'").select("part", "text", F.row_number().over(Window.orderBy("part", "at")).alias("place"))
    reached = firsts.groupBy("part").agg(F.max("place").alias("place"))
    opened = compared.where("role = 'open'").join(reached, "part").withColumn("place", F.explode(F.sequence(F.col("place") + 1, F.col("place") + AHEAD)))
    opened = opened.join(firsts.select("place", F.col("text").alias("other")), "place")
    rest = F.expr("substring(other, length(text) + 1)")
    cut = compared.where("role = 'cut'").select("h", "g").unionByName(opened.where(F.col("other").startswith(F.col("text")) & ~rest.isin(sorted(_STOP_ONLY))).select("h", "g"))
    short = scratch.save(rows.where(F.col("n") < prefix).select("h", "g", "n").distinct())
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # fewer than ``prefix``
    if lengths:
        begun = texts.select("bare", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.length("bare") > F.col("n"))
        begun = begun.where((F.length("bare") > F.col("n") + 1) | ~F.right("bare", F.lit(1)).isin(sorted(_STOP_ONLY)))
        begun = begun.select(F.expr("substring(bare, 1, n)").alias("start")).withColumn("h", F.xxhash64("start")).join(short.select("h", "g"), "h")
        cut = cut.unionByName(begun.where(F.col("g") == F.xxhash64(F.lit(7), "start")).select("h", "g"))
    return rows.join(cut.distinct(), ["h", "g"], "left_semi").select(key)


def decided(docs: DataFrame, scratch) -> DataFrame:
    """(doc_id, source, cut, why) of every text that is neither null nor blank.

    ``docs`` is (doc_id, source, text); repeated ids give repeated rows, a null source is a
    source of its own. Word and run counts are of all texts, each whole; a word or run that
    a third of all rows hold is combined in its block before it is shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    ends = scratch.save(texts.mapInPandas(_endings, _ENDINGS))
    asked = docs.sparkSession.sparkContext.broadcast(asked_runs(ends.where(F.col("state").isin("prose", "item", "number"))))
    units = texts.select("text").mapInPandas(_units(asked), _UNITS).groupBy("kind", "unit").agg(*[F.sum(c).alias(c) for c in ("seen", "ends", "last")])
    units = scratch.save(units)
    open_ends = ends.where(F.col("state").isin("prose", "item", "number"))

    # The longest run of the end that texts hold inside often enough says whether it continues.
    # Closing lines stand only at ends: of them, runs of three words count with all they have.
    runs = open_ends.select("doc_id", F.posexplode("runs").alias("n", "unit"))
    known = units.where("kind = 'run'").select("unit", "seen", "ends", "last")
    needed = runs.select("unit").distinct()
    told = runs.join(known.join(needed, "unit"), "unit")
    inside = F.col("seen") - F.col("last")
    told = told.withColumn("share", F.when(inside >= SEEN, (F.col("ends") - F.col("last")) / inside)).withColumn("all_share", F.when((F.col("n") == 2) & (F.col("seen") > SEEN), (F.col("ends") - 1) / (F.col("seen") - 1)))
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")).otherwise(-1))
    told = told.groupBy("doc_id").agg(longest("share").alias("share"), longest("all_share").alias("all_share"))

    # (Korean names stand bare in closing lines and with particles elsewhere, so there they are no half words.)
    # Last words no text holds inside, but that begin a longer word: the self-join of words by prefix.
    words = units.where("kind = 'word'").select(F.col("unit").alias("word"), (F.col("seen") - F.col("last")).alias("inside"))
    tails = open_ends.select("word").where(~F.col("word").rlike(r"^[\d.,]+$")).distinct()
    unknown = tails.join(words.where("inside > 0"), "word", "left_anti").withColumnRenamed("word", "prefix")
    prefixes = words.where("inside > 0").select(F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), n -> substring(word, 1, n))")).alias("prefix")).distinct()
    halves = unknown.join(prefixes, "prefix", "left_semi").select(F.col("prefix").alias("word"), F.lit(True).alias("half"))

    keys = units.where(f"kind = 'key' and last >= {CLOSERS} and last >= {CLOSING_SHARE} * seen").select(F.col("unit").alias("key"), F.lit(True).alias("closer"))
    # One row a source: how its lines end.
    styles = ends.groupBy("source").agg((1 - F.sum("stopped") / F.greatest(F.sum("lines"), F.lit(1))).alias("unstopped"))
    copies = prefix_copies(docs, scratch=scratch).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("copy", F.lit(True))

    rows = ends.join(told, "doc_id", "left").join(halves, "word", "left").join(keys, "key", "left").join(copies, "doc_id", "left")
    rows = rows.join(styles.select(F.col("source").alias("s"), "unstopped"), F.col("source").eqNullSafe(F.col("s")), "left")
    half = F.coalesce("half", F.lit(False))
    runs_on = F.coalesce(F.col("share") < CONTINUES, F.lit(False))
    lone = F.col("lines") == 0
    stopped = F.when(lone, F.coalesce("unstopped", F.lit(0.0)) < UNSTOPPED_SOURCE).otherwise(2 * F.col("stopped") >= F.col("lines"))
    why = (
        F.when(F.coalesce("copy", F.lit(False)), "longer copy")
        .when(F.col("state") == "cut", "broken construct")
        .when(F.col("state") == "whole", None)
        .when(F.col("state") == "number", F.when(F.col("share") < NUMBER_ENDS, "inside a number"))
        .when(F.coalesce("closer", F.lit(False)), F.when(half & ~F.col("word").rlike(r"[\x{AC00}-\x{D7A3}]"), "inside a word").when(F.col("all_share") < CONTINUES, "runs on"))
        .when(half, "inside a word")
        .when(F.col("state") == "item", F.when(runs_on, "runs on"))
        .when(runs_on, "runs on")
        .when(stopped, "no stop where the text has stops")
    )
    return rows.select("doc_id", "source", why.isNotNull().alias("cut"), why.alias("why"))


def source_rates(decisions: DataFrame) -> DataFrame:
    """(source, texts, cut, share) of every source with a text that is not blank."""
    cut = F.sum(F.col("cut").cast("long"))
    return decisions.groupBy("source").agg(F.count("*").alias("texts"), cut.alias("cut"), (cut / F.count("*")).alias("share"))
