"""Operator 4: toxicity by a learned, weighted lexicon and Aho-Corasick matching.

Texts are lower-cased, look-alike letters of other scripts and digits that stand for letters are folded, and all
that isn't a letter becomes a gap (a run of them is one). One pass of an Aho-Corasick automaton finds all lexicon entries, which are word
beginnings; hits inside an exception phrase (whole words) don't count. The summed weight, alone and normalised by the
number of words, goes through a logistic curve. Exception phrases are learned too: pairs of words with a lexicon hit that stand in
several clean texts and in no toxic one; more can be given.

Lexicon, weights and curve are learned from at most `sample` labelled rows, those first in a seeded hash order
(a documented bound; every text is scored). Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from.
Inputs of a score are the text alone.

Nulls: a null text is empty, and an empty text has the score of a text without hits; a null doc_id has a null
held_out and is not learned from; labels that are null are ignored, of several labels of a document the highest
counts. Without labels of both kinds every score is 0. Repeated rows are scored each. Empty tables give no rows.
Very long texts are folded and matched whole. Extra columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import fresh, give_back, pick, small_batches, table, tidied
from ._text import mix

SAMPLE, FOLDS = 8000, 5
LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ո": "n", "ɡ": "g",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ӏ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


class _Fold(dict):
    """Translation of any character, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = LIKE.get(c, c)
        if not c.isalpha():
            wide = unicodedata.normalize("NFKC", c).lower()
            c = LIKE.get(wide, wide) if wide.isalpha() and not c.isspace() else ("" if unicodedata.category(chr(code)) in ("Cf", "Mn") else " ")
        elif not c.isascii():
            wide = unicodedata.normalize("NFKC", c).lower()
            c = LIKE.get(wide, wide)
        self[code] = c
        return c


_fold = _Fold()


def fold(text: str | None) -> str:
    """Folded words with one gap before each and one at the end; a word of digits alone folds too, which no entry matches."""
    return " ".join(["", *(text or "").translate(_fold).split(), ""]) if text else " "


def n_words(folded: str) -> int:
    return max(folded.count(" ") - 1, 0)


@dataclass
class Model:
    """Lexicon entries (word beginnings) with weights, exception phrases and the curve over (weight, weight by length)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def matcher(self):
        """A function from folded text to (number of hits, summed weight)."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w, x in self.weights.items():
            auto.add_word(" " + w, (len(w) + 1, x))
        for e in self.exceptions:
            auto.add_word(" " + e + " ", (len(e) + 2, None))
        if not len(auto):
            return lambda text: (0, 0.0)
        auto.make_automaton()

        def match(text: str) -> tuple[int, float]:
            hits, spared = {}, []
            for end, (n, x) in auto.iter(text):
                begin = end - n + 1
                if x is None:
                    spared.append((begin, end))
                else:
                    hits[begin] = max(hits.get(begin, 0.0), x)
            if spared and hits:  # a phrase's last gap is the first of what follows, and doesn't spare it
                spared.sort()
                lows, reach = [lo for lo, _ in spared], list(accumulate((hi for _, hi in spared), max))
                hits = {b: x for b, x in hits.items() if not ((k := bisect_right(lows, b)) and b < reach[k - 1])}
            return len(hits), sum(hits[b] for b in sorted(hits))

        return match

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        b, c, d = self.curve
        z = b + c * np.log1p(weight) + d * np.log1p(100 * weight / (words + 20.0))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Words:
    """Texts as numbers of words: vocabulary, places of all words (text, number), texts parted by a number of their own."""

    def __init__(self, texts: Sequence[str]):
        known: dict[str, int] = {"": 0}
        end, parts = np.zeros(1, np.int32), []
        for t in texts:
            parts.append(np.array([0, *(known.setdefault(w, len(known)) for w in t.split()), 0], dtype=np.int32))
        self.names, self.text = list(known), np.concatenate([end, np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]), end])
        self.ids = np.concatenate([end, *parts, end])

    def contexts(self, which: np.ndarray, turns: int = 16) -> np.ndarray:
        """For either half (by a checksum of the context) and each word: in how many different contexts, two words to either side, it stands in the texts `which`.

        Words take turns, so that little is held at once.
        """
        out = np.zeros((2, len(self.names)), dtype=np.int64)
        ok = (self.ids > 0) & which[self.text]
        for turn in range(turns):
            at = np.flatnonzero(ok & (self.ids % turns == turn))
            context = np.zeros(len(at), dtype=np.uint64)
            for k in (-2, -1, 1, 2):
                context = mix(context * np.uint64(0x9E3779B97F4A7C15) + self.ids[at + k].astype(np.uint64) + np.uint64(1))
            word = self.ids[at]
            order = np.lexsort((context, word))
            word, context = word[order], context[order]
            new = np.ones(len(word), dtype=bool)
            new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
            word, side = word[new], context[new] >> np.uint64(63)
            for s in (0, 1):
                out[s] += np.bincount(word[side == s], minlength=len(self.names))
        return out


def learn_lexicon(words: Words, toxic: np.ndarray, least: int = 3, lift: float = 6.0, surprise: float = 30.0, shortest: int = 3, longest: int = 9) -> dict[str, float]:
    """Word beginnings that are far more frequent in toxic texts, with log-lift weights.

    words: of distinct folded texts; toxic: of each text. A word counts once for each context, so that copies of a passage don't add up. Of beginnings that contain each other, the one whose counts are the most surprising (by the log-likelihood
    ratio) stands; ties go to the longer. It must have `least` contexts in toxic texts (1% of their number, if that is more) and
    be `lift` times as frequent there as in clean ones; and it must hold where it wasn't found: contexts fall into
    two halves, and in either alone it must be in a toxic text and lifted half as much (in logs).
    """
    bad, good = words.contexts(toxic), words.contexts(~toxic)
    total = np.array([bad.sum(axis=1), good.sum(axis=1)]) + 1.0
    counts: dict[str, list[int]] = {}
    for k in np.flatnonzero(bad.sum(axis=0)):
        w = words.names[k]
        for n in range(shortest, min(longest, len(w)) + 1):
            c = counts.setdefault(w[:n], [0, 0, 0, 0])
            c[0] += int(bad[0, k])
            c[1] += int(bad[1, k])
    least = max(least, int(toxic.sum()) // 100)
    counts = {p: c for p, c in counts.items() if c[0] + c[1] >= least and c[0] and c[1]}
    for k in np.flatnonzero(good.sum(axis=0)):
        w = words.names[k]
        for n in range(shortest, min(longest, len(w)) + 1):
            if c := counts.get(w[:n]):
                c[2] += int(good[0, k])
                c[3] += int(good[1, k])

    def log_lift(n: int, m: int, of: np.ndarray) -> float:
        return math.log((n + 0.5) / of[0] * of[1] / (m + 0.5))

    share = total[0].sum() / total.sum()
    found = []
    for p, c in counts.items():
        n, m = c[0] + c[1], c[2] + c[3]
        weight = log_lift(n, m, total.sum(axis=1))
        g = 2 * (n * math.log(n / ((n + m) * share)) + (m * math.log(m / ((n + m) * (1 - share))) if m else 0.0))
        if weight >= math.log(lift) and g >= surprise and all(log_lift(c[s], c[2 + s], total[:, s]) >= math.log(lift) / 2 for s in (0, 1)):
            found.append((g, len(p), p, weight))
    chosen: dict[str, float] = {}
    above: set[str] = set()
    for _, _, p, weight in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
        if p not in above and not any(p[:k] in chosen for k in range(shortest, len(p) + 1)):
            chosen[p] = weight
            above.update(p[:k] for k in range(shortest, len(p) + 1))
    return chosen


def learn_exceptions(words: Words, toxic: np.ndarray, lexicon: dict[str, float], least: int = 3) -> list[str]:
    """Pairs of neighbouring words, one or both with a lexicon hit, that stand in `least` distinct clean texts and in no toxic one."""
    sizes, size = sorted({len(p) for p in lexicon}), len(words.names)
    hit = np.array([any(w[:k] in lexicon for k in sizes) for w in words.names])
    a, b = words.ids[:-1], words.ids[1:]
    at = np.flatnonzero((a > 0) & (b > 0) & (hit[a] | hit[b]))
    pair, bad = a[at].astype(np.int64) * size + b[at], toxic[words.text[at]]
    each = np.unique(np.stack([pair[~bad], words.text[at][~bad]]), axis=1)[0]
    found, n = np.unique(each, return_counts=True)
    found = np.setdiff1d(found[n >= least], pair[bad])
    return sorted(f"{words.names[p // size]} {words.names[p % size]}" for p in found.tolist())


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(texts: Sequence[str | None], labels: Sequence[int], exceptions: Sequence[str] = ()) -> Model:
    """A model from labelled texts; exceptions: phrases besides those that are learned."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model()
    folded = list(map(fold, texts))
    kinds = dict(zip(folded, labels)) | {t: 1 for t, k in zip(folded, labels) if k == 1}
    words_of, toxic = Words(list(kinds)), np.array(list(kinds.values())) == 1
    lexicon = learn_lexicon(words_of, toxic)
    model = Model(lexicon, tuple(dict.fromkeys([*(fold(e).strip() for e in exceptions), *learn_exceptions(words_of, toxic, lexicon)])))
    match = model.matcher()
    weight, words = np.array([match(t)[1] for t in folded]), np.array([n_words(t) for t in folded])
    model.curve = fit_curve(np.stack([np.ones(len(y)), np.log1p(weight), np.log1p(100 * weight / (words + 20.0))], axis=1), y)
    return model


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 17) -> Model:
    """A model from at most `sample` labelled documents outside the held-out fold."""
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(remainder() != 0)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(sample)  # at most `sample` rows of two numbers: small enough to broadcast
    rows = pick(documents, "doc_id", "text").join(F.broadcast(known), "doc_id").orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), F.xxhash64("text")).limit(sample).select("text", "toxic").toArrow()
    texts, toxic = rows["text"].to_pylist(), rows["toxic"].to_pylist()
    del rows
    model = train(texts, toxic)
    del texts
    give_back()
    return model


def score(documents: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), prefix: str = "tox") -> DataFrame:
    """keep columns of documents with tox_score, tox_hits, tox_weight and tox_words (folded words), or another prefix."""
    extra = [f"{prefix}_score", f"{prefix}_hits", f"{prefix}_weight", f"{prefix}_words"]
    added = ", ".join(f"`{n}` {t}" for n, t in zip(extra, ("double", "int", "double", "int")))
    own = [c for c in keep if c != "text"]
    kept = documents.select(*[F.col(f"`{c}`") for c in own], F.col("text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for b in batches:
            hits, weight, words = [], [], []
            for t in b.column(b.num_columns - 1):
                f = fold(t.as_py())
                h, w = match(f)
                hits.append(h)
                weight.append(w)
                words.append(n_words(f))
            s = model.score(np.array(weight, dtype=float), np.array(words, dtype=float))
            names = [n for n in b.schema.names if n in keep]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(s), pa.array(hits, pa.int32()), pa.array(weight, pa.float64()), pa.array(words, pa.int32())], names=[*names, *extra])

    small_batches(documents.sparkSession)
    return kept.mapInArrow(tidied(run), f"{ddl}, {added}")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), "tox_hits", "tox_weight")


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    names, own = documents.columns, fresh(documents, "__tox")
    return score(documents, fit(documents, labels), keep=names, prefix=own).where(F.col(f"{own}_score") < 0.5).select(*[F.col(f"`{c}`") for c in names])
