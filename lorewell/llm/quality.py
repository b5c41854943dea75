"""Problem 1: per-document text statistics that tell prose from lists, tables and junk.

Method: tables and lists show in the vertical alignment of delimiters, the periodicity of
indentation and the autocorrelation of line lengths; these are combined with word, symbol
and punctuation ratios. The combination is a logistic model fitted on a bounded sample of
hand-labelled pages; a fit that trims the most contradicted labels keeps wrong ones out.

The visible text is the body without front matter, fenced blocks and blank lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Labelled rows the model is fitted on at most (those with the smallest hashed ids).
FIT_ROWS = 5000

STATS = ("words", "visible_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_end_share", "common_share",
         "item_share", "aligned_share", "column_share", "indent_period", "length_autocorrelation")
_TYPES = "words int, visible_lines int, " + ", ".join(f"{name} double" for name in STATS[2:])
_FEATURES = STATS[2:]

_FRONT = re.compile(r"---\r*\n(?:.*?\n)?---\r*(?:\n|$)", re.S)
_FENCE = re.compile(r"(`{3,}|~{3,})")
_HEADING = re.compile(r"#{1,6}(?:\s|$)")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+(?:\[[ xX]\]\s+)?")
_WIKI_LINK = re.compile(r"!?\[\[([^\[\]|\n]*?)(?:\\?\|([^\[\]\n]*))?\]\]")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:<[^<>\n]*>|[^()\s]*)[^()\n]*\)")
_CODE = re.compile(r"`+[^`\n]*`+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|\{\{[^{}\n]*\}\}")
_END = re.compile(r"[.!?:。！？…][\W_]*(?:\d{1,2}[\W_]*)?$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SEPARATOR = re.compile(r"[\s|:+-]+")
# What separates the cells of a row, each a pattern of its own.
_DELIMITERS = (re.compile(r"(?<!\\)\|"), re.compile(r"\t"), re.compile(r";"), re.compile(r"(?<=\S) {2,}(?=\S)"), re.compile(r",(?=[^\s\d])|(?<!\d),(?=\d)"))


def visible_lines(content: str) -> list[str]:
    """Lines of the body that a reader sees; an unclosed fence hides all that follows."""
    front = _FRONT.match(content)
    if front:
        content = content[front.end() :]
    lines, fence = [], ""
    for line in re.split(r"\r?\n|\r", content):
        text = line.strip()
        if opening := _FENCE.match(text):
            run = opening[1]
            if not fence:
                fence = run
            elif run[0] == fence[0] and len(run) >= len(fence):
                fence = ""
            continue
        if text and not fence:
            lines.append(line)
    return lines


def _plain(text: str) -> str:
    """Lines as shown: links by their labels, inline code as a letter, without tags and templates."""
    if "[" in text:
        text = _MD_LINK.sub(r"\1", _WIKI_LINK.sub(lambda m: m[2] or m[1], text))
    if "`" in text:
        text = _CODE.sub("x", text)
    return _TAG.sub("", text) if "<" in text or "{" in text else text


def aligned(lines: list[str]) -> tuple[list[bool], float]:
    """Whether each line has delimiters that recur, as many times, in the line above or below;
    and the share of all delimiters that stand in the same column as one there, give or take one.
    """
    found = [False] * len(lines)
    in_column = delimiters = 0
    whole = "\n".join(lines)
    for delimiter in _DELIMITERS:
        if not delimiter.search(whole):
            continue
        places = [[m.end() for m in delimiter.finditer(x)] for x in lines]  # where the next cell begins
        for i, own in enumerate(places):
            if not own:
                continue
            around = [places[k] for k in (i - 1, i + 1) if 0 <= k < len(places)]
            if any(len(own) == len(x) for x in around):
                found[i] = True
            columns = {c + d for x in around for c in x for d in (-1, 0, 1)}
            in_column += sum(c in columns for c in own)
            delimiters += len(own)
    return found, in_column / max(delimiters, 1)


def autocorrelation(values: list[int], most: int = 8) -> float:
    """The largest autocorrelation of a series over lags 1 to ``most``; 0 for short or constant ones.

    Constant line lengths are the strongest rhythm there is and count as 1 from 4 lines on.
    """
    x = np.asarray(values, dtype=float)
    if len(x) < 4:
        return 0.0
    x = x - x.mean()
    spread = float(x @ x)
    if spread <= 1e-9:
        return 1.0
    return max(0.0, max(float(x[:-k] @ x[k:]) / spread for k in range(1, min(most, len(x) - 2) + 1)))


def indent_period(lines: list[str]) -> float:
    """Share of lines whose indent and marker recur with a period of one to three lines."""
    if len(lines) < 4:
        return 0.0
    marks = []
    for line in lines:
        indent, item = len(line) - len(line.lstrip()), _ITEM.match(line)
        marks.append((indent, re.sub(r"\d+", "9", item[0].strip()) if item else ""))
    best = 0
    for period in (1, 2, 3):
        best = max(best, sum(a == b and a != (0, "") for a, b in zip(marks, marks[period:])))
    return best / (len(lines) - 1)


def page_profile(content: str | None, common: frozenset[str]) -> tuple:
    """The statistics of one text in the order of ``STATS``; zeros for null, empty and blank ones."""
    lines = visible_lines(content) if content else []
    words = sum(len(x.split()) for x in lines)
    if not words:
        return (0, len(lines)) + (0.0,) * len(_FEATURES)
    whole = _plain("\n".join(lines))
    plain = whole.split("\n")
    grid, in_column = aligned(plain)
    found = _WORD.findall(whole.lower())
    letters, digits, signs = sum(map(str.isalpha, whole)), sum(map(str.isdigit, whole)), len("".join(whole.split()))
    ended = body = chars_all = chars_items = chars_grid = 0
    for line, in_grid in zip(plain, grid):
        text = line.strip()
        if _HEADING.match(text) or _SEPARATOR.fullmatch(text):
            continue
        chars = len(text) - text.count(" ")
        body += 1
        ended += _END.search(text) is not None
        chars_all += chars
        chars_grid += chars * in_grid
        chars_items += chars * (_ITEM.match(line) is not None)
    return (
        words, len(lines), sum(map(len, found)) / max(len(found), 1), (signs - letters - digits) / max(signs, 1), digits / max(signs, 1), ended / max(body, 1), sum(w in common for w in found) / max(len(found), 1),
        chars_items / max(chars_all, 1), chars_grid / max(chars_all, 1), in_column, indent_period(lines), autocorrelation([len(x) for x in lines]),
    )


def _profiles(common: frozenset[str], key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [page_profile(x, common) for x in batch["content"]]
            out = pd.DataFrame(rows, columns=list(STATS))
            out.insert(0, "readable", batch["content"].notna().to_numpy())
            out.insert(0, "received_at", batch["received_at"].to_numpy())
            out.insert(0, key, batch[key].to_numpy())
            yield out

    return run


def word_set(common_words: DataFrame, most: int = 100_000) -> frozenset[str]:
    """The lower-case frequent words of all languages; more than ``most`` rows are an error."""
    rows = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    return frozenset(r["w"] for r in rows)


def page_quality(files: DataFrame, common_words: DataFrame, key: str = "page_id") -> DataFrame:
    """One row of ``STATS`` for every page; a page is its id, however many rows carry it.

    The statistics are those of the newest readable row (ties: the row with most words), of
    zeros if no row is readable. Rows with a null id are left out. Contents are profiled
    where they are read; only the statistics are shuffled to find a page's newest row.
    """
    rows = files.where(F.col(key).isNotNull()).select(F.col(key), F.col("content"), F.col("received_at"))
    kind = files.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, received_at timestamp_ntz, readable boolean, {_TYPES}"
    rows = rows.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    stats = rows.mapInPandas(_profiles(word_set(common_words), key), schema)
    newest = F.struct("readable", "received_at", *STATS)
    best = stats.groupBy(key).agg(F.max(newest).alias("s"))
    return best.select(key, *[F.col(f"s.{name}").alias(name) for name in STATS])


def fit(stats: DataFrame, labels: DataFrame, key: str = "page_id", most: int = FIT_ROWS, features: tuple[str, ...] = _FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, scales) of the model that tells prose (0) from the rest (1).

    At most ``most`` labelled pages are used. Labels other than prose, list, table and junk,
    and pages with several labels, are left out. Without both kinds the model falls back to
    the share of lines that end a sentence alone, at one half.
    """
    known = labels.where(F.col("shape").isin("prose", "list", "table", "junk") & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.min("shape").alias("shape"), F.max("shape").alias("s")).where("shape = s")
    chosen = known.orderBy(F.xxhash64(key), key).limit(most)
    rows = stats.where("words > 0").join(F.broadcast(chosen), key).select("shape", *features).toPandas()
    x, y = rows[list(features)].to_numpy(float), (rows["shape"] != "prose").to_numpy(float)
    if not len(y) or y.min() == y.max():
        weights = np.zeros(len(features) + 1)
        weights[0], weights[1 + features.index("punct_end_share")] = 5.0, -10.0
        return weights, np.zeros(len(features)), np.ones(len(features))
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - means) / scales]
    weights = _logistic(z, y)
    chance = 1 / (1 + np.exp(-z @ weights))
    trusted = np.abs(chance - y) < 0.9  # the rest contradict the model so far that they count as mistakes
    weights = _logistic(z[trusted], y[trusted])
    return weights, means, scales


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    weights = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (y - p) - penalty * weights
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        weights = weights + move
        if np.abs(move).max() < 1e-8:
            break
    return weights


def scored(stats: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], features: tuple[str, ...] = _FEATURES) -> DataFrame:
    """``stats`` with ``chance``, the model's probability that a page is not prose; null without words."""
    weights, means, scales = model
    line = F.lit(float(weights[0]))
    for name, w, m, s in zip(features, weights[1:], means, scales):
        line = line + (F.col(name) - float(m)) * float(w / s)
    return stats.withColumn("chance", F.when(F.col("words") > 0, 1 / (1 + F.exp(-line))))
