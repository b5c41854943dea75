"""Problem 7: markup residue in texts.

Method: a recurrent block labeller. A document is a sequence of leaves: the excerpt split
at its constructs, each with the path of constructs open around it, then the normalised
text in runs of ``LEAF`` words. A numpy bidirectional LSTM reads hashed vectors of the
paths and words and labels every leaf with the context of the whole document. Words that
may be a name with another word glued on carry a sign of what the corpus says about it
(``hint``), which the model reads beside them. A leaf is marked up from a chance of one
half; what is labelled is then checked exactly: an excerpt's leaf must overlap a construct
of the grammar, a normalised text's leaf must hold a word with a hint.

The same labels drive the cleaning: constructs of marked leaves are rendered as text that
keeps headings, list items, code and formulas, and glued words lose the names.

The model is trained on a bounded sample of pages (``SAMPLE``): their excerpts with and
without constructs put in, labelled by the grammar, and their normalised texts before and
after markup is put in and normalised again, so the labels are known. Names of templates
and the like are read from all excerpts, word counts from all normalised texts.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lorewell.session import Scratch

#: Pages the labeller is trained on at most, words of a leaf of norms and of excerpts, and construct texts it is trained on at most.
SAMPLE, LEAF, LONG_LEAF, CONSTRUCTS = 900, 8, 24, 5000
#: Distinct names that are held by the driver and each worker; more are an error, none is left out.
MOST_NAMES = 1_000_000
#: Hash slots, width of leaf vectors, width of each LSTM direction.
SLOTS, WIDTH, HIDDEN = 1 << 15, 24, 16
#: Chance from which a leaf is marked up.
CHANCE = 0.5
#: Times a hint is read, so that it is not lost among a leaf's words.
REPEAT = 6
#: Share of all norms from which a word is too common to be a short rest with a name glued on.
COMMON = 0.004

# Element, attribute, entity and command names common in such texts.
TAGS = """a abbr article aside b big blockquote body br caption center cite code col dd del details div dl dt em
 figcaption figure font footer h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark
 math meta nav nowiki ol p pre q ref references s samp script section small source span strike strong style sub
 summary sup svg table tbody td tfoot th thead time title tr tt u ul var video""".split()
ATTRIBUTES = "align alt bgcolor border class color colspan height href id lang name rel rowspan src style target title type valign width".split()
ENTITIES = """amp apos bull cent copy deg euro frac12 gt hellip laquo ldquo lsquo lt mdash middot minus nbsp ndash para
 pound quot raquo rdquo reg rsquo sect shy thinsp times trade zwj zwnj""".split()
COMMANDS = """alpha begin beta bibitem caption cdot cite citep citet delta emph end footnote frac gamma geq hline
 href hspace includegraphics infty int item itemize label lambda ldots left leq mathbb mathbf mathit mathrm mu ne noindent
 omega paragraph partial pi prod qquad quad ref right section sigma sqrt subsection sum tabular text textbf textit
 textsc texttt theta times underline url usepackage vec vspace""".split()

_TAG = r"</?[A-Za-z][A-Za-z0-9:]*(?:\s+[A-Za-z][\w:-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))*\s*/?>"
_GRAMMAR = [
    ("code", re.compile(r"(`+)(?!`)(?:(?!\1).)+?\1(?!`)", re.S)),
    ("comment", re.compile(r"<!--.*?(?:-->|$)", re.S)),
    ("tag", re.compile(_TAG)),
    ("autolink", re.compile(r"<(?:https?|mailto|ftp):[^\s<>]+>")),
    ("entity", re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")),
    ("template", re.compile(r"\{\{[^{}]*\}\}|\{\{\{?|\}\}\}?")),
    ("wiki_table", re.compile(r"^\{\||^\|\}|^\|-")),
    ("image", re.compile(r"!\[[^\[\]]*\]\((?:<[^<>]*>|[^()]*)\)")),
    ("wiki_link", re.compile(r"!?\[\[[^\[\]]+\]\]")),
    ("link", re.compile(r"\[[^\[\]]*\]\((?:<[^<>]*>|[^()]*)\)|\[[^\[\]]+\]\[[^\[\]]*\]|\[\^[^\[\]]+\]")),
    ("external_link", re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?: [^\]]*)?\]")),
    ("formula", re.compile(r"\$\$[^$]+\$\$|\$(?=[^\s$])[^$\n]*[\\^_=][^$\n]*(?<=[^\s\\])\$(?!\d)|\\\(.*?\\\)|\\\[.*?\\\]")),
    ("command", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\[\]]*\])?(?:\{[^{}]*\})*")),
    ("wiki_quote", re.compile(r"(?<!')('{2,5})(?!')(?=\S)[^'\n]+(?:'(?!')[^'\n]*)*\1")),
    ("wiki_heading", re.compile(r"(?<!=)(={2,6})(?!=)\s*[^=\n]*[^=\s][^=\n]*?\s*\1(?!=)")),
    ("strike", re.compile(r"~~(?=\S)[^~\n]+~~")),
    ("strong", re.compile(r"\*\*(?=[^\s*])(?:[^*\n]|\*(?!\*))*?(?<=\S)\*\*|(?<!\w)__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?!\w)")),
    ("emphasis", re.compile(r"(?<![\w*])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?!\w)")),
    ("heading", re.compile(r"^#{1,6} +\S")),
    ("quote", re.compile(r"^> ?\S")),
    ("list", re.compile(r"^(?:[-*+]|\d{1,3}[.)]) +(?:\[[ xX]\] +)?\S")),
    ("table_row", re.compile(r"^\|.*\|$")),
    ("escape", re.compile(r"\\[|_*#\[\]`]")),
]
_HTML = frozenset(TAGS)


def _is_base64(text: str) -> bool:
    return len(text) > 24 and re.fullmatch(r"[A-Za-z0-9+/=]+", text) is not None


def _is_tag(tag: str, text: str) -> bool:
    """Whether what has a tag's form is one: a name of HTML, an attribute or a closing tag says so."""
    name = re.match(r"</?([A-Za-z][A-Za-z0-9:]*)", tag)[1].lower()
    return name in _HTML or "=" in tag or tag.startswith("</") or f"</{name}" in text.lower()


def constructs(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the markup in a line of text, in order; code hides what is inside.

    Signs used as plain signs are none: lone stars, comparison signs, ``a<b and c>d``,
    snake_case, prices, ``[sic]``, ``#19``. A tag needs attributes with values, or none.
    """
    if not text or _is_base64(text.strip()):
        return []
    found: list[tuple[int, int, str]] = []
    hidden: list[tuple[int, int]] = []
    for kind, pattern in _GRAMMAR:
        for m in pattern.finditer(text):
            begin, end = m.span()
            if any(a <= begin and end <= b for a, b in hidden):
                continue
            if kind == "tag" and not _is_tag(m[0], text):
                continue
            found.append((begin, end, kind))
            if kind in ("code", "comment", "formula"):
                hidden.append((begin, end))
    return sorted(found)


# -- leaves -----------------------------------------------------------------------------

_SIGNS = re.compile(rf"{_TAG}|&#?\w+;|\{{\{{|\}}\}}|\[\[|\]\]|!?\[|\]\(|\]|\)|\*+|_+|`+|~~|'{{2,}}|={{2,}}|\$|\\[A-Za-z]+|[|<>#^{{}}\\]")


def excerpt_leaves(text: str | None) -> list[tuple[list[str], int, int]]:
    """(tokens, begin, end) of each leaf of an excerpt: a construct's sign with the text after
    it. Tokens are the words, the sign, its neighbours' classes, and the open path."""
    if not text:
        return []
    cuts = [(m.start(), m.end()) for m in _SIGNS.finditer(text)]
    leaves, path = [], []
    begins = [0, *[a for a, _ in cuts if a]]
    ends = [*begins[1:], len(text)]
    signs = dict(cuts)
    for begin, end in zip(begins, ends):
        sign = text[begin : signs[begin]] if begin in signs else ""
        name = re.sub(r"\d+", "9", sign.lower())
        if len(name) > 1 and name[0] == "<" and name[-1] == ">":
            label = re.match(r"</?\s*([a-z0-9:]*)", name)[1]
            tokens = ["tag", f"tag:{label}"]
            if "=" in name:
                tokens.append("attributes")
            if name.startswith("</"):
                tokens.append("close")
                if label in path:
                    del path[len(path) - 1 - path[::-1].index(label) :]
            elif not name.endswith("/>"):
                path.append(label)
        elif sign:
            around = _class(text[begin - 1 : begin]) + _class(text[signs[begin] : signs[begin] + 1])
            paired = "2" if text.count(sign) > 1 else "1"
            kind = "entity" if name[0] == "&" else "command" if name[0] == "\\" and len(name) > 1 else "mark"
            tokens = [f"kind:{kind}", f"sign:{name}", f"sign:{name}:{around}", f"sign:{name}:{paired}:{around}"]
            if sign in path:
                path.remove(sign)
                tokens.append(f"close:{name}")
            elif sign in ("[", "![", "[[", "{{", "*", "**", "_", "__", "`", "~~", "''", "'''", "==", "$"):
                path.append(sign)
        else:
            tokens = []
        around = [f"path:{p}" for p in dict.fromkeys(path)]
        words = list(re.finditer(r"\S+", text[signs.get(begin, begin) : end]))
        shift = signs.get(begin, begin)
        # Long texts between two signs become several leaves; only the first holds the sign.
        for at in range(0, max(len(words), 1), LONG_LEAF):
            part = words[at : at + LONG_LEAF]
            till = end if at + LONG_LEAF >= len(words) else shift + words[at + LONG_LEAF].start()
            leaves.append((tokens + around + [f"w:{w[0].lower()}" for w in part], begin, till))
            tokens, begin = ["goes on:"], till
    return leaves


def _class(char: str) -> str:
    return "-" if not char else "s" if char.isspace() else "d" if char.isdigit() else "a" if char.isalpha() else "p"


def norm_leaves(words: list[str], known: dict[int, tuple[str, str]]) -> list[list[str]]:
    """Leaves of a norm's words; ``known`` holds hints by position, each read as a token of its own."""
    leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
    for at, (kind, _) in known.items():
        leaves[at // LEAF] = [*leaves[at // LEAF], f"kind:{kind}", *["hint:name" if kind == "plain" else "hint:markup"] * REPEAT]
    return leaves


def features(token: str, frequent: bool) -> np.ndarray:
    """Hash slots of a token. Words of normalised text count as themselves only if frequent,
    and by their beginnings, ends and inner letters, so that a rare word is not learned by heart."""
    keys = ["=" + token if frequent or ":" in token else "rare"]
    if ":" not in token:
        bare = re.sub(r"\d+", "9", token)
        n = len(bare)
        keys += [f"<{bare[:k]}" for k in (2, 3, 4, 5, 6) if k <= n] + [f"{bare[-k:]}>" for k in (1, 2, 3, 4, 5, 6) if k <= n]
        keys += [f"~{bare[i : i + 4]}" for i in range(n - 3)] + [f"#{min(n, 12)}"]
    return np.array([zlib.crc32(k.encode()) % SLOTS for k in keys], dtype=np.int64)


class Bag:
    """Leaves of several documents as distinct tokens and offsets."""

    def __init__(self, documents: list[list[list[str]]], frequent: frozenset[str]):
        index: dict[str, int] = {}
        tokens, starts, self.lengths = [], [], []
        for leaves in documents:
            self.lengths.append(len(leaves))
            for leaf in leaves:
                starts.append(len(tokens))
                tokens += [index.setdefault(t, len(index)) for t in leaf] or [index.setdefault("empty:", len(index))]
        self.tokens, self.starts = np.array(tokens, dtype=np.int64), np.array(starts, dtype=np.int64)
        rows = [_cached(t, t in frequent) for t in index]
        self.slots = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.slot_starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64) if rows else np.empty(0, np.int64)


@lru_cache(maxsize=1 << 18)
def _cached(token: str, frequent: bool) -> np.ndarray:
    return features(token, frequent)


# -- the labeller -----------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """A bidirectional LSTM over leaves; ``fit`` by Adam, ``chances`` of each leaf."""

    NAMES = ("table", "bias", "wf", "bf", "wb", "bb", "out", "out_bias")

    def __init__(self, frequent: frozenset[str], seed: int = 1):
        self.frequent = frequent
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.table = (rng.standard_normal((SLOTS, WIDTH)) * 0.1).astype(np.float32)
        self.bias = np.zeros(WIDTH, np.float32)
        self.wf, self.wb = scale(WIDTH + HIDDEN, 4 * HIDDEN), scale(WIDTH + HIDDEN, 4 * HIDDEN)
        self.bf, self.bb = np.zeros(4 * HIDDEN, np.float32), np.zeros(4 * HIDDEN, np.float32)
        self.bf[HIDDEN : 2 * HIDDEN] = self.bb[HIDDEN : 2 * HIDDEN] = 1
        self.out, self.out_bias = scale(2 * HIDDEN + WIDTH, 1), np.full(1, -2, np.float32)

    def _leaves(self, bag: Bag):
        words = np.maximum(np.add.reduceat(self.table[bag.slots], bag.slot_starts, axis=0) + self.bias, 0)
        return words, np.add.reduceat(words[bag.tokens], bag.starts, axis=0)

    @staticmethod
    def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
        steps, docs, _ = x.shape
        h, c = np.zeros((docs, HIDDEN), np.float32), np.zeros((docs, HIDDEN), np.float32)
        wide = x.reshape(steps * docs, -1) @ w[:WIDTH] + b
        wide = wide.reshape(steps, docs, -1)
        hs, memory = np.zeros((steps, docs, HIDDEN), np.float32), []
        for t in range(steps):
            z = wide[t] + h @ w[WIDTH:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh_new = np.tanh(new)
            if keep:
                memory.append((h, c, i, f, o, g, tanh_new, m))
            h, c = np.where(m, o * tanh_new, h), np.where(m, new, c)
            hs[t] = h
        return hs, memory

    @staticmethod
    def _back(dh_all: np.ndarray, x: np.ndarray, memory: list, w: np.ndarray):
        dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1], np.float32), np.zeros_like(x)
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        for t in range(len(memory) - 1, -1, -1):
            h, c, i, f, o, g, tanh_new, m = memory[t]
            dh = dh + dh_all[t]
            live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
            dnew = live_h * o * (1 - tanh_new**2) + live_c
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live_h * tanh_new * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
            dw[:WIDTH] += x[t].T @ dz
            dw[WIDTH:] += h.T @ dz
            db += dz.sum(axis=0)
            dx[t] = dz @ w[:WIDTH].T
            dh = np.where(m, 0, dh) + dz @ w[WIDTH:].T
            dc = np.where(m, dnew * f, dc)
        return dw, db, dx

    @staticmethod
    def _padded(lengths: list[int]):
        steps, docs = max(lengths), len(lengths)
        mask = np.arange(steps)[:, None] < np.array(lengths)[None]
        at = np.zeros((steps, docs), np.int64)
        start = 0
        for d, n in enumerate(lengths):
            at[:n, d] = np.arange(start, start + n)
            start += n
        reverse = np.where(mask, np.array(lengths)[None] - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        return mask, at, reverse

    def _forward(self, bag: Bag, keep: bool):
        words, leaves = self._leaves(bag)
        mask, at, reverse = self._padded(bag.lengths)
        x = leaves[at] * mask[:, :, None]
        docs = np.arange(x.shape[1])[None]
        forth, memory_f = self._run(x, mask, self.wf, self.bf, keep)
        turned = x[reverse, docs]
        back, memory_b = self._run(turned, mask, self.wb, self.bb, keep)
        both = np.concatenate([forth, back[reverse, docs], x], axis=2)
        return words, x, turned, mask, at, reverse, docs, memory_f, memory_b, both, (both @ self.out)[:, :, 0] + self.out_bias

    def chances(self, documents: list[list[list[str]]], block: int = 256) -> list[np.ndarray]:
        """Per document the chance of each leaf; documents of like length share a block."""
        results: list[np.ndarray] = [np.empty(0, np.float32)] * len(documents)
        order = sorted((i for i, d in enumerate(documents) if d), key=lambda i: len(documents[i]))
        at = 0
        while at < len(order):
            longest = len(documents[order[min(at + block, len(order)) - 1]])
            size = max(1, min(block, 200_000 // longest))
            part = order[at : at + size]
            logits = self._forward(Bag([documents[i] for i in part], self.frequent), False)[-1]
            for d, i in enumerate(part):
                results[i] = _sigmoid(logits[: len(documents[i]), d])
            at += size
        return results

    def fit(self, documents: list[list[list[str]]], labels: list[list[int]], epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 1, positive: float = 3.0) -> Labeller:
        """Labels are 1, 0, or -1 for leaves that are read but not learned from."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        usable = [i for i, d in enumerate(documents) if d]
        step = 0
        for epoch in range(epochs):
            order = sorted(usable, key=lambda i: len(documents[i]) + 0.3 * len(documents[i]) * rng.random())
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(batches)
            for part in batches:
                bag = Bag([documents[i] for i in part], self.frequent)
                words, x, turned, mask, at, reverse, docs, memory_f, memory_b, both, logits = self._forward(bag, True)
                target = np.zeros(mask.shape, np.float32)
                for d, i in enumerate(part):
                    target[: len(labels[i]), d] = labels[i]
                delta = np.where(target < 0, 0, _sigmoid(logits) - target) * mask * np.where(target > 0, positive, 1)
                delta = (delta / max(1.0, np.sqrt(mask.sum()))).astype(np.float32)
                grads = {"out": both.reshape(-1, both.shape[2]).T @ delta.reshape(-1, 1), "out_bias": np.array([delta.sum()], np.float32)}
                dboth = delta[:, :, None] * self.out[:, 0]
                grads["wf"], grads["bf"], dx = self._back(dboth[:, :, :HIDDEN], x, memory_f, self.wf)
                grads["wb"], grads["bb"], dturned = self._back(dboth[:, :, HIDDEN : 2 * HIDDEN][reverse, docs], turned, memory_b, self.wb)
                dx = (dx + dturned[reverse, docs] + dboth[:, :, 2 * HIDDEN :]) * mask[:, :, None]
                dleaves = np.zeros((len(bag.starts), WIDTH), np.float32)
                dleaves[at[mask]] = dx[mask]
                sizes = np.diff(np.append(bag.starts, len(bag.tokens)))
                dwords = np.zeros_like(words)
                np.add.at(dwords, bag.tokens, np.repeat(dleaves, sizes, axis=0))
                dwords *= words > 0
                dtable = np.zeros_like(self.table)
                np.add.at(dtable, bag.slots, np.repeat(dwords, np.diff(np.append(bag.slot_starts, len(bag.slots))), axis=0))
                grads["table"], grads["bias"] = dtable, dwords.sum(axis=0)
                step += 1
                pace = rate * min(1.0, step / 20) * (1 - 0.8 * epoch / epochs)
                for n in self.NAMES:
                    g = grads[n].astype(np.float32)
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.01 * (g * g - second[n])
                    move = (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
                    setattr(self, n, (getattr(self, n) - pace * move).astype(np.float32))
        return self


# -- training data ----------------------------------------------------------------------

_DROPPED = re.compile(r"[\[\]()*_#>!|-]")


def normalise(text: str) -> str:
    """The normalised form a page's text is compared in: code dropped, some signs as spaces,
    letters and digits in lower case, all else deleted."""
    text = re.sub(r"`[^`]*(?:`|$)", "", text)
    text = _DROPPED.sub(" ", text)
    return " ".join("".join(c.lower() if c.isalnum() else " " if c.isspace() else "" for c in text).split())


def construct_names(raw: str) -> set[str]:
    """Names a construct leaves in normalised text, as that text spells them."""
    names = set()
    for m in re.finditer(_TAG, raw):
        tag = m[0].strip("<>/ ")
        names.add(normalise(re.match(r"[A-Za-z0-9:]*", tag)[0]))
        for attribute, value in re.findall(r"\s([A-Za-z][\w:-]*)\s*=\s*\"?([^\"<>\s]*)", tag):
            names |= {normalise(attribute), *normalise(attribute + value).split()}
    names |= {normalise(e) for e in re.findall(r"&([A-Za-z][A-Za-z0-9]+);", raw)}
    names |= {normalise(c) for c in re.findall(r"\\([A-Za-z]+)", raw)}
    for m in re.finditer(r"\{\{\s*([^{}|=]+?)\s*(?:\||\}\})", raw):
        names |= set(normalise(m[1]).split())
    return {n for n in names if n}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _names(excerpt: pd.Series) -> pd.Series:
    return excerpt.map(lambda x: sorted(excerpt_names(x)))


def excerpt_names(text: str | None) -> set[str]:
    """Names that all constructs of an excerpt leave in normalised text, nested ones too; code leaves none."""
    if not text or _is_base64(text.strip()):
        return set()
    text = re.sub(r"`[^`]*(?:`|$)", "", text)
    return construct_names(re.sub(_TAG, lambda m: m[0] if _is_tag(m[0], text) else " ", text))


def _put(words: list[str], flags: list[int], raw: str, rng: np.random.Generator, names: frozenset[str]) -> tuple[list[str], list[int]]:
    """Words and their flags with one construct put around one to three of them; words its names changed get 1."""
    i, k = int(rng.integers(0, len(words))), int(rng.integers(1, 4))
    before, after = ("" if rng.random() < 0.3 else " "), ("" if rng.random() < 0.3 else " ")
    inner, first, last = words[i : i + k], words[max(0, i - 1) : i], words[i + k : i + k + 1]
    text = raw.replace("\0", " ".join(inner)) if "\0" in raw else raw + after + " ".join(inner)
    made = normalise("".join(first) + before + text + after + "".join(last)).split()
    old = dict(zip(words[max(0, i - 1) : i + k + 1], flags[max(0, i - 1) : i + k + 1]))
    fresh = [old[w] if w in old else int(any(n in w for n in names)) for w in made]
    return words[: max(0, i - 1)] + made + words[i + k + 1 :], flags[: max(0, i - 1)] + fresh + flags[i + k + 1 :]


#: Constructs put into excerpts beside the mined ones; \0 stands for the words around which they are put.
_SHAPES = ("**\0**", "__\0__", "*\0*", "_\0_", "~~\0~~", "''\0''", "'''\0'''", "== \0 ==", "=== \0 ===", "`\0`", "[\0](page.md)", "![\0](img/a.png)", "[[\0]]", "[[\0|b]]",
           "<!-- \0 -->", "$x_1 = \\alpha$", "[^1]", "[https://a.example \0]", "{{note|\0}}", "<https://a.example>")


def _put_in_excerpt(text: str, raws: list[str], rng: np.random.Generator) -> str:
    """An excerpt with one or two constructs put around one to four of its words, or a sign put before all."""
    words = text.split(" ")
    for _ in range(int(rng.integers(1, 3))):
        i, k = int(rng.integers(0, len(words))), int(rng.integers(1, 5))
        raw = raws[rng.integers(0, len(raws))] if rng.random() < 0.5 else _SHAPES[rng.integers(0, len(_SHAPES))]
        inner = " ".join(words[i : i + k])
        glue = " " if rng.random() < 0.6 else ""
        words[i : i + k] = [raw.replace("\0", inner) if "\0" in raw else inner + glue + raw if rng.random() < 0.5 else raw + glue + inner]
    start = rng.random()
    return ("# " if start < 0.03 else "- " if start < 0.06 else "> " if start < 0.09 else "") + " ".join(words)


def _raw_constructs(mined: list[str], rng: np.random.Generator, n: int) -> list[str]:
    """Constructs for training: those mined from excerpts, and others from the fixed names."""
    made = list(mined)
    tags, commands = ([x for x in names if x not in _ENGLISH] for names in (TAGS, COMMANDS))
    for _ in range(n):
        kind = rng.integers(0, 6)
        tag = tags[rng.integers(0, len(tags))]
        if kind == 0:
            made.append(f"<{tag}>\0</{tag}>")
        elif kind == 1:
            made.append(f'<{tag} {ATTRIBUTES[rng.integers(0, len(ATTRIBUTES))]}="x{rng.integers(0, 99)}">\0</{tag}>')
        elif kind == 2:
            made.append(f"&{ENTITIES[rng.integers(0, len(ENTITIES))]};")
        elif kind == 3:
            made.append(f"\\{commands[rng.integers(0, len(commands))]}{{\0}}")
        elif kind == 4:
            made.append(f"<{tag}/>")
        else:
            made.append(f"$\\{commands[rng.integers(0, len(commands))]}{{a}}{{{rng.integers(1, 99)}}}$")
    return made


def _emptied(found: re.Match, group: int) -> str:
    """A construct with the text of one group replaced by a mark."""
    begin, end = found.start(group) - found.start(), found.end(group) - found.start()
    return found[0][:begin] + "\0" + found[0][end:]


def mined_constructs(excerpts: list[str]) -> list[str]:
    """Constructs of excerpts with the text they wrap replaced by a mark."""
    found = {}
    for text in excerpts:
        for pattern, shape in (
            (r"<([A-Za-z][A-Za-z0-9]*)(\s[^<>]*=[^<>]*)?>([^<>]*)</\1>", lambda m: _emptied(m, 3) if m[3].strip() and "{" not in m[3] else m[0]),
            (r"<[A-Za-z]+\s*/?>", lambda m: m[0]),
            (r"&[A-Za-z]+;", lambda m: m[0]),
            (r"\\[A-Za-z]+\{[^{}]*\}(?:\{[^{}]*\})?", lambda m: m[0]),
            (r"\{\{([^{}|]+)\|([^{}|=]+)\}\}", lambda m: _emptied(m, 2)),
            (r"\{\{[^{}]+\}\}", lambda m: m[0]),
        ):
            for m in re.finditer(pattern, text):
                raw = shape(m)
                if construct_names(raw):
                    found[re.sub(r"\d+", "9", raw)] = raw
    return sorted(found.values())


def train(pages: list[tuple[str | None, str | None]], mined: list[str], hints, seed: int = 1) -> Labeller:
    """The labeller fitted on (excerpt, norm) of sampled pages.

    ``hints`` gives the hints of lists of words, as ``hint`` states them. Pages may hold
    residue nobody marked, so of their own leaves those with a hint that is no everyday word
    count as marked, and those with several words that a mined construct leaves in a row.
    """
    rng = np.random.default_rng(seed)
    raws = _raw_constructs(mined * max(1, 1200 // max(len(mined), 1)), rng, 200)
    runs = {run for raw in mined for run in [normalise(raw.replace("\0", " \n "))] if len(run.split()) > 1}
    counts = Counter(w for _, norm in pages if norm for w in set(norm.split()))
    frequent = frozenset(w for w, n in counts.items() if n >= max(3, 0.004 * len(pages)))
    heads, changed, put_in = [], [], []
    copies = min(40, max(1, SAMPLE // max(len(pages), 1)))  # small tables give as many training texts as large ones
    for excerpt, norm in pages:
        words = norm.split() if norm else []
        for put in range(1 + copies):
            shown, now, flags = excerpt, list(words), [0] * len(words)
            if put and excerpt and excerpt.strip():
                shown = _put_in_excerpt(excerpt, raws, rng)
            if put and words:
                for _ in range(max(3, min(12, len(words) // 40))):
                    raw = raws[rng.integers(0, len(raws))]
                    now, flags = _put(now, flags, raw, rng, frozenset(construct_names(raw)))
            heads.append(shown)
            changed.append(now)
            put_in.append(flags)
    documents, labels = [], []
    for excerpt, words, flags, known in zip(heads, changed, put_in, hints(changed)):
        spans = constructs(excerpt)
        head = [(tokens, int(any(a < end and begin < b for a, b, _ in spans))) for tokens, begin, end in excerpt_leaves(excerpt)]
        leaves, marks = norm_leaves(words, known), []
        for i in range(0, len(words), LEAF):
            kinds = {known.get(at, ("", ""))[0] for at in range(i, min(i + LEAF, len(words)))}
            around = f" {' '.join(words[max(0, i - 1) : i + LEAF + 1])} "
            # A lone name may be an everyday word: in a page's own text it is taken for one.
            marks.append(int(1 in flags[i : i + LEAF] or bool(kinds & {"sure", "inside", "glued"}) or ("plain" in kinds and any(f" {run} " in around for run in runs))))
        documents.append([t for t, _ in head] + leaves)
        labels.append([m for _, m in head] + marks)
    return Labeller(frequent, seed).fit(documents, labels, epochs=4, seed=seed)


# -- exact checks -----------------------------------------------------------------------


def splits(word: str, names: frozenset[str], telling: frozenset[str]) -> list[tuple[str, int, str, str]]:
    """Ways to read a word as a name with another word glued on: (that word, how many times
    more common it must be than the whole, what is left without the name, kind). The kinds
    are 'sure' for a telling name and 'plain' for a name that is an everyday word, which need
    no look-up, 'inside' for a telling name inside a word and 'glued' for one at its end.

    Names of entities and commands can be glued on anywhere; a tag's name only to the end of
    the word before it, as its closing sign leaves a space; the tags s, a, q and u are too
    common as endings to be told there.
    """
    bare = word.strip("0123456789")
    if (word in names and len(word) > 1) or bare in telling or (bare in names and len(bare) > 2):
        return [("", 0, "", "plain" if is_plain(word, names, telling) else "sure")]
    longest = _longest(telling)
    inside = {word[i:j] for i in range(len(word)) for j in range(i + 1, min(len(word), i + longest) + 1)} & telling
    if inside:
        parts = [p for p in re.split("|".join(sorted(map(re.escape, inside), key=len, reverse=True)), word) if p]
        rest = " ".join(parts)
        left = [p for p in (x.strip("0123456789") for x in parts) if p]
        return [(p, 1, rest, "inside") for p in left] if any(len(p) > 2 for p in left) else [("", 0, rest, "plain" if is_plain(word, names, telling) else "sure")]
    glued = [(word[:i], n) for i in range(len(word)) if (n := word[i:]) in names and n not in ("s", "a", "q", "u")]
    # Short rests and single letters need more: random letters make such words too.
    return [(p, (20 if len(p) == 2 else 1) if len(n) > 1 else 20 if len(p) == 3 else 3, p, "glued") for p, n in glued if len(p) > 2 or (len(p) == 2 and len(n) > 1)]


@lru_cache(maxsize=8)
def _longest(names: frozenset[str]) -> int:
    return max(map(len, names), default=0)


def everyday(word: str) -> bool:
    """Whether a name is also a plain word, so that only its context tells."""
    return word in _ENGLISH or len(word) < 3


def coded(word: str, following: str) -> bool:
    """Whether two letters are a code, like the BR of BR-639."""
    return len(word) == 2 and re.match(r"\d{3}", following) is not None


def is_plain(word: str, names: frozenset[str], telling: frozenset[str]) -> bool:
    """Whether a name is an everyday word, or one that excerpts without constructs hold as well."""
    return everyday(word) or (len(word) >= 4 and word in names and word not in telling)


def hint(word: str, names: frozenset[str], telling: frozenset[str], docs: dict[str, int], common: float) -> tuple[str, str] | None:
    """(kind, rest) of one word by the counts of norms that hold it and its parts: 'inside' and
    'glued' only if what is left without the name is a word more common than the whole. None
    for other words."""
    own = max(docs.get(word, 0), 1)
    held = [(docs.get(part, 0), rest, kind) for part, times, rest, kind in splits(word, names, telling) if not times or (docs.get(part, 0) >= times * own + times and (times < 20 or own < common))]
    return max(held)[:0:-1] if held else None


def placed(words: list[str], known: dict[str, tuple[str, str]]) -> dict[int, tuple[str, str]]:
    """Hints of a norm's words by position; two letters that are a code have none."""
    return {i: known[w] for i, w in enumerate(words) if w in known and not coded(w, words[i + 1] if i + 1 < len(words) else "")}


def _doubtful(names: frozenset[str], telling: frozenset[str]):
    """(page_id, word) of the words of each norm that can be read as a name with something glued on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doubt = lru_cache(maxsize=1 << 17)(lambda word: bool(splits(word, names, telling)))
        for batch in batches:
            pages, words = [], []
            for page, norm in zip(batch["page_id"], batch["norm"]):
                found = [w for w in set(norm.split()) if doubt(w)]
                pages += [page] * len(found)
                words += found
            yield pd.DataFrame({"page_id": np.array(pages, np.int64), "word": words})

    return run


def _readings(names: frozenset[str], telling: frozenset[str]):
    """(word, own, kind, part, times, rest) of each reading of distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, own in zip(batch["word"], batch["own"]):
                rows += [(word, own, kind, part, times, rest) for part, times, rest, kind in splits(word, names, telling)]
            yield pd.DataFrame(rows, columns=["word", "own", "kind", "part", "times", "rest"])

    return run


_LABELLED = "page_id long, in_excerpt boolean, in_norm boolean, excerpt string, norm string"


def _predict(model_bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(model_bytes.value)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.iloc[at : at + 1024]
                heads = [excerpt_leaves(x) for x in batch["excerpt"]]
                norms = [x.split() if x else [] for x in batch["norm"]]
                hints = [placed(words, {h["word"]: (h["kind"], h["rest"]) for h in known} if known is not None else {}) for words, known in zip(norms, batch["hints"])]
                chances = model.chances([[t for t, _, _ in h] + norm_leaves(words, known) for h, words, known in zip(heads, norms, hints)])
                rows = []
                for page, excerpt, norm, head, words, known, chance in zip(batch["page_id"], batch["excerpt"], batch["norm"], heads, norms, hints, chances):
                    marked = [(b, e) for (_, b, e), c in zip(head, chance) if c >= CHANCE]
                    spans = [x for x in constructs(excerpt) if any(b < x[1] and x[0] < e for b, e in marked)] if marked else []
                    tail = chance[len(head) :]
                    changed = {i: rest for i, (_, rest) in known.items() if tail[i // LEAF] >= CHANCE}
                    clean = " ".join(filter(None, (changed.get(i, w) for i, w in enumerate(words)))) if changed else norm
                    rows.append((page, bool(spans), bool(changed), rendered(excerpt, spans) if spans else excerpt, clean))
                yield pd.DataFrame(rows, columns=["page_id", "in_excerpt", "in_norm", "excerpt", "norm"])

    return run


# -- cleaning ---------------------------------------------------------------------------

#: Tags whose text starts a line of its own, and commands whose argument is no text.
_HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
_SECTIONS = {"section": "# ", "subsection": "## ", "subsubsection": "### ", "paragraph": "#### "}
_NO_TEXT = frozenset("cite citep citet ref label bibitem includegraphics usepackage vspace hspace begin end noindent".split())


def rendered(text: str, spans: list[tuple[int, int, str]]) -> str:
    """A text with the constructs of ``spans`` rendered as plain text.

    Headings, list items, code and formulas stay as Markdown, whatever markup they came from;
    links, emphasis, tags and templates leave the text they wrap, entities the sign they
    stand for, table rows their cells with tabs between them; references, comments and
    templates without a text leave nothing. Constructs may be nested.
    """
    out, at = [], 0
    for begin, end, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if begin < at:
            continue
        inside = [(a - begin, b - begin, k) for a, b, k in spans if begin <= a and b <= end and (a, b, k) != (begin, end, kind)]
        out += [text[at:begin], _shown(text[begin:end], kind, inside)]
        at = end
    found = "".join([*out, text[at:]])
    return re.sub(r"[ ]{2,}", " ", found).strip() if spans else text


def _shown(raw: str, kind: str, inside: list[tuple[int, int, str]]) -> str:
    def within(begin: int, end: int) -> str:
        """The part of a construct from ``begin`` to ``end``, with what is nested in it rendered."""
        nested = [(a - begin, b - begin, k) for a, b, k in inside if begin <= a and b <= end]
        return rendered(raw[begin:end], nested) if nested else raw[begin:end]

    def group(pattern: str) -> str:
        m = re.match(pattern, raw, re.S)
        return within(*m.span(1)) if m else raw

    if kind in ("code", "formula", "heading", "list"):
        return raw
    if kind in ("comment", "wiki_table"):
        return ""
    if kind == "tag":
        return _shown_tag(raw)
    if kind == "entity":
        return html.unescape(raw)
    if kind == "autolink":
        return raw[1:-1]
    if kind == "template":
        parts = raw.strip("{}").split("|")[1:]
        texts = [p.strip() for p in parts if "=" not in p and p.strip()]
        return texts[-1] if texts else ""
    if kind in ("image", "link"):
        return "" if raw.startswith("[^") else group(r"!?\[([^\[\]]*)\]")
    if kind == "wiki_link":
        return group(r"!?\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]$")
    if kind == "external_link":
        return group(r"\[\S+?(?: ([^\]]*))?\]$") if " " in raw else raw[1:-1]
    if kind == "command":
        name = re.match(r"\\([A-Za-z]+)", raw)[1]
        arguments = [m.span(1) for m in re.finditer(r"\{([^{}]*)\}", raw)]
        if name == "item":
            return "\n- "
        if name in _NO_TEXT or not arguments:
            return "" if name in _NO_TEXT or name in COMMANDS else raw
        return ("\n" + _SECTIONS[name] if name in _SECTIONS else "") + within(*arguments[-1])
    if kind == "wiki_heading":
        level = len(raw) - len(raw.lstrip("="))
        return "#" * level + " " + group(r"=+\s*(.*?)\s*=+$")
    if kind in ("wiki_quote", "strike", "strong", "emphasis"):
        width = len(raw) - len(raw.lstrip(raw[0])) if kind == "wiki_quote" else 1 if kind == "emphasis" else 2
        return within(width, len(raw) - width)
    if kind == "quote":
        # The span ends with the first sign of the quoted text.
        return raw.lstrip("> ")
    if kind == "table_row":
        return "\t".join(rendered(c, constructs(c)).strip() for c in raw.strip("|").split("|"))
    return raw[1:]  # an escaped sign


def _shown_tag(raw: str) -> str:
    name, closing = re.match(r"<(/?)([A-Za-z][A-Za-z0-9:]*)", raw).group(2, 1)
    name = name.lower()
    if name in _HEADINGS:
        return "\n" if closing else "\n" + _HEADINGS[name]
    if name == "li":
        return "" if closing else "\n- "
    if name in ("code", "kbd", "samp", "tt"):
        return "`"
    if name == "pre":
        return "\n```\n"
    if name == "math":
        return "$"
    return "\n" if name in ("br", "p", "div", "tr") and not closing and name == "br" else ""


def mined_names(pages: DataFrame, most: int = CONSTRUCTS) -> tuple[list[str], frozenset[str], frozenset[str]]:
    """(constructs, names, telling names) of excerpts: the most frequent ``most`` construct texts, to train on, and all names.

    Names are read from every excerpt as a whole, whatever their number or length. Telling
    names are words that no excerpt without constructs holds as a word.
    """
    raw = pages.where("excerpt is not null").select(F.explode(F.regexp_extract_all("excerpt", F.lit(r"(<[^<>]{1,80}>[^<>]{0,60}</[A-Za-z0-9]+>|<[A-Za-z]+\s*/?>|&[A-Za-z]+;|\\[A-Za-z]+\{[^{}]{0,60}\}(?:\{[^{}]*\})?|\{\{[^{}]{1,80}\}\})"), F.lit(1))).alias("c"))
    shape = F.regexp_replace(F.regexp_replace("c", r"\d+", "9"), r"(?<=[>|{])[^<>|{}=]+(?=<|\}\})", "x")
    counted = raw.groupBy(shape.alias("shape")).agg(F.min("c").alias("c"), F.count("*").alias("n"))
    rows = [r["c"] for r in counted.orderBy(F.desc("n"), "shape").limit(most).collect()]
    mined = mined_constructs(rows)
    held = pages.where(F.col("excerpt").rlike(r"[<&\\{]")).select(F.explode(_names("excerpt")).alias("n")).distinct().limit(MOST_NAMES + 1).collect()
    if len(held) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names of tags, attributes, entities, commands and templates")
    seen = frozenset(r["n"] for r in held)
    names = seen | fixed_names()
    plain = pages.where(F.col("excerpt").isNotNull() & ~F.col("excerpt").rlike(r"[<>&\\{}]"))
    words = plain.select(F.explode(F.split(F.lower("excerpt"), r"[^\p{L}\p{N}]+")).alias("w")).distinct()
    asked = pages.sparkSession.createDataFrame(pd.DataFrame({"w": sorted(names)}))
    natural = frozenset(r["w"] for r in words.join(asked, "w", "left_semi").collect())  # at most as many as there are names
    names = seen | (names - natural)
    telling = frozenset(n for n in names if len(n) >= 4 and n not in natural and n not in _ENGLISH)
    return mined, names, telling


def fixed_names() -> frozenset[str]:
    """The fixed names that are no everyday words."""
    return (frozenset(TAGS) | frozenset(ENTITIES) | frozenset(COMMANDS) | frozenset(ATTRIBUTES)) - _ENGLISH


# Names that are everyday words as well.
_ENGLISH = frozenset("""a alpha b col del footnote i id ins li ne p pi pre q ref s u ul var alt lang rel align apos
 cent deg hr lt gt tr tt mu th dd dl dt ol html alpha article aside beta body border bull caption cent center class code color delta details end entry euro figure font footer
 gamma head header height html image input item label lambda lang left link main mark math meta minus name note omega para
 paragraph part partial pound prod quad quot quote references right samp sample script section sigma small source span strike
 strong style sub sum summary table tabular target text theta time times title type underline url video width begin int copy
 reg sect thead trade""".split())


def labelled_fields(pages: DataFrame, stats: DataFrame, seed: int = 1, sample: int = SAMPLE, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, in_excerpt, in_norm, excerpt, norm) of every page: whether its fields hold
    markup, and the fields cleaned of it.

    Pages without a row in ``stats`` have no norm, and the reverse; null and empty fields
    hold nothing and stay as they are. A page is one row; of repeated ones that differ the
    greatest text counts. Long fields are read whole. ``labeller`` is used instead of a trained one if given.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    one = lambda frame, c: frame.where("page_id is not null").groupBy("page_id").agg(F.max(c).alias(c))
    fields = one(pages, "excerpt").join(one(stats, "norm"), "page_id", "full")
    fields = scratch.save(fields.select(F.col("page_id").cast("long").alias("page_id"), "excerpt", "norm"))
    mined, names, telling = mined_names(pages)
    norms = fields.where("norm is not null and norm <> ''")
    total = norms.count()

    # What the corpus says about words that may have a name glued on.
    counts = scratch.save(norms.select(F.explode(F.array_distinct(F.split("norm", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("docs")))
    doubts = scratch.save(norms.select("page_id", "norm").mapInPandas(_doubtful(names, telling), "page_id long, word string"))
    words = doubts.select("word").distinct().join(counts, "word").withColumnRenamed("docs", "own")
    readings = scratch.save(words.mapInPandas(_readings(names, telling), "word string, own long, kind string, part string, times int, rest string"))
    known = readings.where("times > 0").join(counts.select(F.col("word").alias("part"), "docs"), "part")
    known = known.where((F.col("docs") >= F.col("times") * F.col("own") + F.col("times")) & ((F.col("times") < 20) | (F.col("own") < COMMON * total)))
    known = known.groupBy("word").agg(F.max(F.struct("docs", "rest", "kind")).alias("r")).select("word", "r.kind", "r.rest")
    hints = scratch.save(known.unionByName(readings.where("times = 0").select("word", "kind", "rest")))
    # A page's hints are some of its own words.
    held = doubts.distinct().join(hints, "word").groupBy("page_id").agg(F.collect_list(F.struct("word", "kind", "rest")).alias("hints"))
    read = fields.join(held, "page_id", "left")

    if labeller is None:
        chosen = fields.where("norm is not null or excerpt is not null").orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(sample).collect()
        labeller = train([(r["excerpt"], r["norm"]) for r in chosen], mined, lambda texts: _looked_up(counts, texts, names, telling, COMMON * total), seed)
    sent = spark.sparkContext.broadcast(pickle.dumps(labeller))  # a fixed size, whatever the data
    return scratch.save(read.mapInPandas(_predict(sent), _LABELLED))


def _looked_up(counts: DataFrame, texts: list[list[str]], names: frozenset[str], telling: frozenset[str], common: float) -> list[dict[int, tuple[str, str]]]:
    """Hints by position of the training texts; only the counts of their doubtful words and parts are fetched."""
    doubtful = {w: r for w in {w for words in texts for w in words} if (r := splits(w, names, telling))}
    asked = set(doubtful) | {part for r in doubtful.values() for part, times, _, _ in r if times}
    frame = counts.sparkSession.createDataFrame(pd.DataFrame({"word": sorted(asked)}), "word string")
    docs = {r["word"]: r["docs"] for r in counts.join(frame, "word").collect()}
    known = {w: h for w in doubtful if (h := hint(w, names, telling, docs, common))}
    return [placed(words, known) for words in texts]


def marked_fields(pages: DataFrame, stats: DataFrame, seed: int = 1, sample: int = SAMPLE, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, field) of the excerpts that hold markup and the norms that hold names from it; each once."""
    labelled = labelled_fields(pages, stats, seed, sample, labeller)
    field = F.array_compact(F.array(F.when(F.col("in_excerpt"), "excerpt"), F.when(F.col("in_norm"), "norm")))
    return labelled.select("page_id", F.explode(field).alias("field")).distinct()


def clean_fields(pages: DataFrame, stats: DataFrame, seed: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(page_id, excerpt, norm): the texts of every page without markup, null where the field is null."""
    return labelled_fields(pages, stats, seed, sample).select("page_id", "excerpt", "norm")
