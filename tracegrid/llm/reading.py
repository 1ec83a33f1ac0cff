"""Reading level of each document's prose, on the scale of graded passages."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.tokens import TOKENIZERS, VOCABULARY, encoder
from tracegrid.runtime import bounded_rows, columns_named

LEAST_SENTENCES = 6
#: Graded passages used for calibration at most.
PASSAGES = 10_000
RIDGE = 1.0

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_TABLE = re.compile(r"\{\|(?:(?!\{\|).)*?\|\}", re.S)
_TEMPLATE = re.compile(r"\{\{\{[^{}]*\}\}\}|\{\{[^{}]*\}\}")
#: Depth of nesting that is taken off layer by layer, which is quicker for shallow texts than the one pass for any depth.
SHALLOW = 4
_TABLE_END = re.compile(r"\{\||\|\}")
_BRACES = re.compile(r"\{+|\}+")
_OPEN_TEMPLATE = re.compile(r"\{\{[^\n]*")
_ASIDE = re.compile(r"\[\[\s*(?:category|file|image|media|[a-z]{2,3}(?:-[a-z]+)?)\s*:[^\[\]]*\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_OUTSIDE = re.compile(r"\[(?:https?:)?//[^\s\]]*\s*([^\]]*)\]")
_NOT_PROSE = tuple("=*#:;|!{}_<[")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_LOWER_WORD = re.compile(r"(?<![A-Za-zß-ÿ'-])[a-zß-ÿ]+(?:['-][a-zß-ÿ]+)*")
_SHOUT = re.compile(r"[A-Z]{3,}")
_REPEATED = re.compile(r"(\w)\1{2,}")

#: Words that tell English prose from its neighbours, and those of the neighbours.
ENGLISH = frozenset("the of and in to is was are were it its by for with that which this from at on as an be has had have not but or they their there some many most who when because after before into than more where you we he she all now also been".split())
OTHERS = frozenset("le la les des du et est une un en que qui dans pour sur avec au aux der die das und ist von den dem ein eine mit auf für im wurde el los las una y es por con para del se su fue era".split())
#: Connectives and words that open a subordinate clause.
CONNECTIVES = frozenset("although though because since while whereas however therefore moreover nevertheless notwithstanding despite unless until consequently furthermore hence thus insofar albeit accordingly correspondingly nonetheless".split())
SUBORDINATORS = frozenset("which who whom whose that when where after before if whether as than what how".split())



def _without_templates(t: str) -> str:
    """``t`` without ``{{...}}`` and ``{{{...}}}``, nested to any depth, in one pass; braces without a partner stay."""
    out: list[str] = []
    #: Runs of opening braces that may still close: (place in ``out``, braces left).
    opened: list[list[int]] = []
    at = 0
    for m in _BRACES.finditer(t):
        if m.start() > at:
            out.append(t[at : m.start()])
        at = m.end()
        n = at - m.start()
        if t[m.start()] == "{":
            opened.append([len(out), n])
            out.append(t[m.start() : at])
            continue
        while n >= 2 and opened and opened[-1][1] >= 2:
            place, have = opened[-1]
            k = 3 if n >= 3 and have >= 3 else 2
            n -= k
            del out[place + 1 :]
            opened[-1][1] = have - k
            out[place] = "{" * (have - k)
            if have == k:
                opened.pop()
                out.pop()
        if n:
            out.append("}" * n)
            opened.clear()
    out.append(t[at:])
    return "".join(out)


def _without_tables(t: str) -> str:
    """``t`` without ``{|...|}``, nested to any depth, in one pass; marks without a partner stay."""
    out: list[str] = []
    opened: list[int] = []
    at = 0
    for m in _TABLE_END.finditer(t):
        out.append(t[at : m.start()])
        at = m.end()
        if m[0] == "{|":
            opened.append(len(out))
            out.append(m[0])
        elif opened:
            del out[opened.pop() :]
        else:
            out.append(m[0])
    out.append(t[at:])
    return "".join(out)


def prose(text: str | None) -> list[str]:
    """The sentences of running prose of a wiki text, without markup and vandals' insertions.

    NULL or empty text, redirects, lists, tables and templates give none.
    """
    if not text:
        return []
    t = text
    for _ in range(2):
        if "&" in t:
            t = html.unescape(t)
    if t.lstrip()[:1] == "#":
        return []
    if "<" in t:
        t = _COMMENT.sub("", t)
        t = _TAG.sub("", _REF.sub("", t))
    if "{" in t:
        for pattern, rest in ((_TEMPLATE, _without_templates), (_TABLE, _without_tables)):
            for _ in range(SHALLOW):
                t, n = pattern.subn("", t)
                if not n:
                    break
            else:
                t = rest(t)
        t = _OPEN_TEMPLATE.sub("", t)
    if "[" in t:
        t = _ASIDE.sub("", t)
        t = _LINK.sub(r"\1", t)
        t = _OUTSIDE.sub(r"\1", t).replace("[[", "").replace("]]", "")
    if "''" in t:
        t = t.replace("'''", "").replace("''", "")
    out = []
    for line in t.splitlines():
        line = line.strip()
        if not line or line.startswith(_NOT_PROSE):
            continue
        out.extend(s for s in _SENTENCE.split(line) if s)
    return out


def is_prose_sentence(s: str) -> bool:
    """A sentence of prose has two words and ends in a full stop; it is no shouting and has no word with a letter three times running."""
    words = s.split()
    if len(words) < 2 or not s.rstrip("\"')]").endswith((".", "?")) or "!" in s:
        return False
    if sum(w.isupper() and len(w) > 1 for w in words) * 2 > len(words):
        return False
    plain = _LOWER_WORD.findall(s.lower())
    return not any(_REPEATED.search(w) for w in plain)


class Words:
    """What the model counts of a word: letters, length class, rarity, language, connection, oddity.

    Rarity is told from the place of the word's pieces in a vocabulary built by
    frequency; every distinct word is looked up once.
    """

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
        self.encode = encoder(folder, vocabulary).encode_ordinary
        self.memo: dict[str, tuple] = {}

    def __call__(self, word: str) -> tuple:
        r = self.memo.get(word)
        if r is None:
            pieces = self.encode(" " + word)
            rarity = math.log(1 + max(pieces)) + 1.5 * (len(pieces) - 1)
            odd = bool(_REPEATED.search(word))
            r = (len(word) >= 9, rarity, word in ENGLISH, word in OTHERS, word in CONNECTIVES, word in SUBORDINATORS, odd)
            if len(self.memo) < 1_000_000:
                self.memo[word] = r
        return r


FEATURES = ("words_a_sentence", "letters_a_word", "long_words", "diversity", "rarity", "connectives", "clauses")
_NOTHING = [0.0] * len(FEATURES)


def features(text: str | None, lookup: Words, least: int = 1) -> tuple[int, float, list[float]]:
    """(prose sentences, English share, features) of a text.

    Features are rates and medians, so that they do not depend on the length of a
    text, and a few sentences of another level hardly move them.  Capitalised words
    inside a sentence (names) do not count.
    """
    kept = [x for x in prose(text) if x[-1] != "!" and " " in x]
    if len(kept) < least:
        return len(kept), 0.0, _NOTHING
    for attempt in range(2):
        joined = "\n".join([x[0].lower() + x[1:] for x in kept])
        plain = _LOWER_WORD.findall(joined)
        counts = Counter(plain)
        long = rarity = english = others = connectives = clauses = odd = 0
        for w, n in counts.items():
            a, b, c, d, e, f, o = lookup(w)
            long += a * n
            rarity += b * n
            english += c * n
            others += d * n
            connectives += e * n
            clauses += f * n
            odd += o
        if attempt or not (odd or "!" in joined or _SHOUT.search(joined) or not all(x.endswith((".", "?")) for x in kept)):
            break
        kept = [x for x in kept if is_prose_sentence(x)]
    n, m = len(kept), len(plain)
    if n < least or not m:
        return n, 0.0, _NOTHING
    clauses += joined.count(",") + joined.count(";")
    sizes = [x.count(" ") + 1 for x in kept]
    letters = [len(x) / k for x, k in zip(kept, sizes, strict=True)]
    slices = [plain[i : i + 40] for i in range(0, m - m % 40, 40)] or [plain]
    share = english / (english + others) if english * 12 >= m else 0.0
    return n, share, [math.log(median(sizes)), median(letters), long / m, sum([len(set(x)) / len(x) for x in slices]) / len(slices), rarity / m, connectives / n, math.log1p(clauses / n)]


@dataclass
class OrdinalModel:
    """Proportional odds with a ridge penalty: P(level <= k) = 1 / (1 + exp(x b - cut_k))."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.spread) @ self.weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.cuts, self.score(x))]


def fit_ordinal(x: np.ndarray, level: np.ndarray, ridge: float = RIDGE, rounds: int = 3000) -> OrdinalModel:
    """Fits by gradient descent with momentum; the same input always gives the same model."""
    levels, y = np.unique(level, return_inverse=True)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = (x - centre) / spread
    k = len(levels) - 1
    b = np.full(z.shape[1], 0.5)
    s = np.sort(z @ b)
    shares = np.cumsum(np.bincount(y))[:-1] / len(y)
    first, gaps = np.quantile(s, shares[0]), np.log(np.maximum(np.diff(np.quantile(s, shares)), 1e-2))
    theta = np.r_[b, first, gaps]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -50, 50)))
    for step in range(1, rounds + 1):
        b, cuts = theta[: z.shape[1]], theta[z.shape[1]] + np.r_[0, np.cumsum(np.exp(theta[z.shape[1] + 1 :]))]
        f = z @ b
        upper, lower = np.r_[cuts, np.inf][y], np.r_[-np.inf, cuts][y]
        pu, pl = np.where(np.isinf(upper), 1, sig(upper - f)), np.where(np.isinf(lower), 0, sig(lower - f))
        p = np.maximum(pu - pl, 1e-12)
        du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
        gb = z.T @ (du - dl) / len(y) + ridge * b / len(y)
        gc = np.array([-(du[y == j].sum() - dl[y == j + 1].sum()) for j in range(k)]) / len(y)
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.r_[gb, tail[0], tail[1:] * np.exp(theta[z.shape[1] + 1 :])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    b, cuts = theta[: z.shape[1]], theta[z.shape[1]] + np.r_[0, np.cumsum(np.exp(theta[z.shape[1] + 1 :]))]
    return OrdinalModel(centre, spread, b, cuts, levels)


def calibrate(graded_passages: DataFrame, folder: str = TOKENIZERS, ridge: float = RIDGE, vocabulary: str = VOCABULARY) -> OrdinalModel:
    """The model fitted to the graded passages, of which there may be at most ``PASSAGES``."""
    rows = bounded_rows(columns_named(graded_passages, "level", "text").dropna().orderBy("level", "text"), PASSAGES, "graded_passages")
    if len({r[0] for r in rows}) < 2:
        raise ValueError("graded passages of at least two levels are needed")
    lookup = Words(folder, vocabulary)
    x = np.array([features(r[1], lookup)[2] for r in rows])
    return fit_ordinal(x, np.array([r[0] for r in rows]), ridge)


def reading_levels(documents: DataFrame, graded_passages: DataFrame, folder: str = TOKENIZERS, least_sentences: int = LEAST_SENTENCES) -> DataFrame:
    """(doc_id, level, score, sentences): the level of every document with enough English prose.

    Whole texts are cleaned of markup, tables, templates and vandals' insertions;
    the language is told from the text, not from its label.  Documents with fewer
    than ``least_sentences`` sentences or in another language, redirects, lists
    and blanked revisions have no row, nor have NULL texts or doc_ids.  Equal
    documents get equal levels; repeated rows of one doc_id count once; an empty
    table gives an empty result.  One pass without a shuffle of texts.
    """
    model = calibrate(graded_passages, folder)

    @F.pandas_udf("struct<level:int,score:double,sentences:int>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = Words(folder)
        for texts in batches:
            rows = [features(x if isinstance(x, str) else None, lookup, least_sentences) for x in texts]
            x = np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES))
            good = np.array([r[0] >= least_sentences and r[1] >= 0.7 for r in rows], bool)
            level = pd.Series(model.predict(x), dtype="Int32").where(good)
            yield pd.DataFrame({"level": level, "score": model.score(x), "sentences": np.array([r[0] for r in rows], np.int32)})

    d = columns_named(documents, "doc_id", "text").where("doc_id is not null and length(text) > 0")
    d = d.select("doc_id", judge("text").alias("r")).where("r.level is not null")
    return d.groupBy("doc_id").agg(F.max(F.struct("r.level", "r.score", "r.sentences")).alias("r")).select("doc_id", "r.level", "r.score", "r.sentences")
