"""Operator 5: licence scans by template markup.

A template is text with markup: `[[ ... ]]` is optional, `{{name:least-most}}` is replaceable by that many words,
and `(a|b)` takes either word. Templates are compiled into token automata over word hashes; a text is accepted where
all mandatory wording stands exactly, at any place in it; the templates are in data/licenses.txt. Beside them, plain
phrases are counted wherever their words stand consecutively. The bytes of a text are scanned once; an automaton runs only
around its anchor: the longest two mandatory words that stand together in its template (one, if none do; a template
without a mandatory word is run from everywhere).

Words: A-Z is lower-cased, and all ASCII characters but letters and digits separate words; other characters belong to them.
Nulls: a null text is empty: no words, no labels, score 0; a null doc_id stays null. Repeated rows and ties are scanned each.
Empty tables give no rows; very long texts are scanned in pieces, whole. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text
from ._run import as_batch, pick, table, tidied

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
GAP = np.zeros(256, dtype=bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_MARK = re.compile(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|\([^)]*\)|[^\s\[\]{}()]+")


def read_templates(path: str = os.path.join(os.path.dirname(__file__), "data", "licenses.txt")) -> dict[str, str]:
    """Templates by label from a file in which a line of <label> begins each."""
    out: dict[str, list[str]] = {}
    with open(path) as f:
        for line in f:
            if line.startswith("<"):
                rows = out.setdefault(line.strip()[1:-1], [])
            elif not line.startswith("#"):
                rows.append(line)
    return {k: " ".join(v) for k, v in out.items()}


TEMPLATES = read_templates()


def hash_of(word: str) -> int:
    """The hash that a word of a text gets."""
    b = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(_text._scan(b, np.zeros(1, np.int64), GAP)[1][0])


class Automaton:
    """States of a template: each takes a set of words (None: any word); `skip` leads past optional parts."""

    def __init__(self, template: str):
        self.steps: list[frozenset[int] | None] = []
        self.skips: dict[int, list[int]] = {}
        open_: list[int] = []
        words: list[str | None] = []
        depth: list[int] = []
        for mark in _MARK.findall(template):
            if mark == "[[":
                open_.append(len(self.steps))
            elif mark == "]]":
                self.skips.setdefault(open_.pop(), []).append(len(self.steps))
            elif mark.startswith("{{"):
                least, most = map(int, mark[:-2].split(":")[1].split("-"))
                for k in range(most):
                    if k >= least:
                        self.skips.setdefault(len(self.steps), []).append(len(self.steps) + most - k)
                    self.steps.append(None)
                    words.append(None)
                    depth.append(1)
            else:
                some = mark[1:-1].split("|") if mark[0] == "(" else [mark]
                self.steps.append(frozenset(hash_of(w) for w in some))
                words.append(some[0] if len(some) == 1 else None)
                depth.append(len(open_))
        self.end = len(self.steps)
        sure = [w if w and not d else "" for w, d in zip(words, depth)]
        pairs = [(len(sure[i]) + len(sure[i + 1]), i) for i in range(self.end - 1) if sure[i] and sure[i + 1]]
        ones = [(len(w), i) for i, w in enumerate(sure) if w]
        #: Where the anchor stands among the steps, and its words; none: the automaton runs from everywhere.
        self.at, span = (max(pairs)[1], 2) if pairs else (max(ones)[1], 1) if ones else (0, 0)
        self.anchor = tuple(next(iter(self.steps[i])) for i in range(self.at, self.at + span))

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def run(self, h: list[int], at: int) -> int:
        """Number of words of the longest match that begins at `at`, or 0."""
        states, best = self._closed({0}), 0
        for k in range(at, min(len(h), at + self.end)):
            states = self._closed({s + 1 for s in states if s < self.end and (self.steps[s] is None or h[k] in self.steps[s])})
            if not states:
                break
            if self.end in states:
                best = k - at + 1
        return best

    def find(self, h: np.ndarray, place: int) -> tuple[int, int]:
        """(start, words) of the longest match that holds the anchor at `place`, or (0, 0); of equally long ones the first."""
        if not self.anchor:
            return place, self.run(h[place : place + self.end + 1].tolist(), 0)
        lo, hi = max(0, place - self.at), min(len(h), place + self.end + 1)
        near = h[lo:hi].tolist()
        best = (0, 0)
        for s in range(place - lo + 1):
            if (n := self.run(near, s)) > best[1] and s + n > place - lo:
                best = (lo + s, n)
        return best


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, base: Mapping[str, str] = BASE) -> DataFrame:
    """Per row of documents (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    spans: array of "label:first word:words" of template matches. score: 1 where a template matches, else 0.5 where a
    phrase stands, else 0.
    """
    fields = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [([np.uint64(hash_of(w)) for w in p.split()], label) for p, label in base.items()]
        automata = [(label, a, np.array(a.anchor, dtype=np.uint64)) for label, a in ((k, Automaton(t)) for k, t in templates.items())]
        for b in batches:
            cols: dict[str, list] = {f.name: [] for f in schema}
            cols["doc_id"] = b.column(0)
            raw, at = _text.utf8(b.column(1))
            for i, j in _text.chunks(at):
                h, bounds = _text.words(raw, at, i, j, gap=GAP)
                n = j - i
                places: list[list[int]] = [[] for _ in range(n)]
                names: list[set[str]] = [set() for _ in range(n)]
                found: list[dict] = [{} for _ in range(n)]
                for p, label in phrases:
                    for k, d in _places(h, bounds, p):
                        places[d].append(k - int(bounds[d]))
                        names[d].add(label)
                for label, a, anchor in automata:
                    for k, d in _places(h, bounds, list(anchor)):
                        lo, hi = int(bounds[d]), int(bounds[d + 1])
                        start, size = a.find(h[lo:hi], k - lo)
                        if size:
                            found[d][(label, start)] = size
                for d in range(n):
                    labels = names[d] | {label for label, _ in found[d]}
                    cols["n_words"].append(int(bounds[d + 1] - bounds[d]))
                    cols["n_base"].append(len(places[d]))
                    cols["first_word"].append(min(places[d], default=None))
                    cols["last_word"].append(max(places[d], default=None))
                    cols["base_labels"].append(",".join(sorted(names[d])))
                    cols["labels"].append(",".join(sorted(labels)))
                    cols["score"].append(1.0 if found[d] else 0.5 if places[d] else 0.0)
                    cols["spans"].append([f"{label}:{s}:{size}" for (label, s), size in sorted(found[d].items())])
            yield as_batch(schema, **cols)

    return pick(documents, "doc_id", "text").mapInArrow(tidied(run), fields)


def _places(h: np.ndarray, bounds: np.ndarray, phrase: list) -> list[tuple[int, int]]:
    """(place, text) of all places where the words stand consecutively in one text."""
    if len(h) < max(len(phrase), 1):
        return []
    at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0]) if phrase else np.arange(len(h))
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    doc = np.searchsorted(bounds, at, side="right") - 1
    ok = at + len(phrase) <= bounds[doc + 1]
    return list(zip(at[ok].tolist(), doc[ok].tolist()))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
