"""Operator 2: main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block elements and text runs. Each node has a log-linear potential of its tag, class and
id words and link density, a section also of how much text it holds, of which share of the page's that is, of its sentences and of whether
it stands beside the article, or beside the section of most text; each edge has a parent-child potential by the child's tag. Sum-product
messages upward and then downward give every node's marginal of being content; text runs above one half are kept. Both
kinds of potentials are trained from labelled pages (a parameter; the default set is generated below from a seed, and what it gives is
kept in data/html_model.json: `python -m millrace.llm.htmltext` makes it again).

Scripts, styles, heads, embedded objects and other markup that shows no text are no nodes. Inline elements are part of
their run, whose white space (line breaks included) becomes one space; character references are decoded once.

Elements deeper than `DEEPEST` hang on the last one above that, as in browsers. Marks of labels are read in training only.

Nulls: a null html is empty, and an empty page gives an empty text; a null page_id or url stays null. Repeated rows
are extracted each. Empty tables give no rows. Very long pages are read whole; unclosed or cut markup ends with the page.
Extra columns are not read.
"""

from __future__ import annotations

import html
import json
import os
import random
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._run import as_batch, pick, table, tidied

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSED = re.compile(r"""(?<!=)(?:^|[\s"']|(?:^|\s)[^\s=]+)/\Z""")  # a slash at the end that no unquoted value takes in
_WORD = re.compile(r"[a-z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe head title button select textarea object canvas audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
PEERS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


DEEPEST = 256
SECTIONS = frozenset("div section aside nav header footer form ul ol dl table center fieldset details dialog menu address".split())

NEUTRAL = frozenset("#text p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead blockquote pre figure figcaption".split())
PLAIN = frozenset("#page body div section article main".split())


class Tree:
    """Nodes in page order: parent (always earlier), tag ("#text" for runs), words of class, id and role, text, link characters."""

    def __init__(self) -> None:
        self.parent, self.tag, self.words, self.text, self.links, self.label, self.depth = [-1], ["#page"], [()], [""], [0], [None], [0]

    def add(self, parent: int, tag: str, words: tuple = (), text: str = "", links: int = 0, label: int | None = None) -> int:
        if self.depth[parent] >= DEEPEST:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.links.append(links)
        self.label.append(self.label[parent] if label is None else label)
        return len(self.parent) - 1


class _Open:
    """Open elements, innermost last, with the places of each tag and of the blocks: nothing is ever searched through."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int | None]] = [("#page", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]
        self.links = self.dropped = 0

    def push(self, tag: str, node: int | None) -> None:
        k = len(self.stack)
        self.places.setdefault(tag, []).append(k)
        self.stack.append((tag, node))
        if node is not None:
            self.blocks.append(k)
        self.links += tag == "a"
        self.dropped += tag in DROPPED

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, node = self.stack.pop()
            self.places[tag].pop()
            if node is not None:
                self.blocks.pop()
            self.links -= tag == "a"
            self.dropped -= tag in DROPPED

    def last(self, *tags: str) -> int:
        """The place of the innermost of these tags, 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    @property
    def block(self) -> int:
        return self.stack[self.blocks[-1]][1]


def parse(page: str, labels: bool = False) -> Tree:
    """The tree of a page; with `labels`, data-label="1" or "0" marks what is in an element (training only)."""
    tree, open_, run, links = Tree(), _Open(), [], 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                tree.add(open_.block, "#text", (), text, min(links, len(text)))
            run.clear()
        links = 0

    def say(s: str) -> None:
        nonlocal links
        if s and not open_.dropped:
            run.append(s)
            if open_.links:
                links += len(s)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end
            if k := open_.last(tag):
                if open_.blocks[-1] >= k:
                    flush()
                open_.pop_to(k)
            elif tag not in INLINE and tag != "br":
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in DROPPED:
            if tag in ("head", "svg", "math") and _CLOSED.search(m[3] or m[6] or ""):
                continue
            if tag in RAW:
                e = _RAW_END[tag].search(page, at)
                at = size if e is None else e.start()
            open_.push(tag, None)
            continue
        if tag == "body" and open_.dropped and open_.places.get("head"):
            open_.pop_to(open_.places["head"][0])
        if open_.dropped:
            open_.push(tag, None)
            continue
        if tag in INLINE:
            if tag == "a" and open_.links:
                open_.pop_to(open_.places["a"][0])
            open_.push(tag, None)
            continue
        flush()
        if tag in CLOSES_P and open_.stack[open_.blocks[-1]][0] == "p":
            open_.pop_to(open_.blocks[-1])
        if tag in PEERS:
            peers, limits = PEERS[tag]
            while (k := open_.last(*peers.split())) > open_.last(*limits):
                open_.pop_to(k)
                if tag != "tr":
                    break
        attributes, words, label = m[3] or m[6] or "", [], None
        if attributes:
            for a in _ATTR.finditer(attributes):
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
                if a[1].lower() != "data-label":
                    words += _WORD.findall(value.lower())
                elif labels and value in ("0", "1"):
                    label = int(value)
        open_.push(tag, tree.add(open_.block, tag, tuple(dict.fromkeys(words)), label=label))
    flush()
    return tree


_SENTENCE = re.compile(r"[\w,;:)\"'»”] ?[.!?…](?:\s|\Z)")


def kinds(tree: Tree) -> list[tuple]:
    """What each node's potential depends on: tag, words, link density, for a run the parent's tag, for a section its text.

    Lengths of single paragraphs are left out on purpose: weak evidence from each of many would add up against their section.
    """
    n = len(tree.parent)
    chars, links, ends = [len(t) for t in tree.text], list(tree.links), [0] * n
    for i, text in enumerate(tree.text):
        if text:
            ends[i] = len(_SENTENCE.findall(text))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        ends[p] += ends[i]
    marked = max((i for i, t in enumerate(tree.tag) if t in ("article", "main")), key=lambda i: (chars[i], -i), default=-1)  # of several the one of most text
    told = 1 if marked >= 0 else 2
    if marked < 0:  # else the innermost section that holds half of the page's text, less of it in links
        marked = max((i for i, t in enumerate(tree.tag) if t in SECTIONS and 2 * chars[i] >= chars[0] and 2 * links[i] < chars[i]), key=lambda i: (tree.depth[i], -i), default=-1)
    holds, inside, i = set(), [False] * n, marked
    while i >= 0:
        holds.add(i)
        i = tree.parent[i]
    for i in range(1, n):
        inside[i] = i == marked or inside[tree.parent[i]]
    out = []
    for i in range(n):
        tag, more = tree.tag[i], ()
        if tag == "#text":
            up = tree.tag[tree.parent[i]]
        else:
            up = ""
            if tag in ("article", "main"):
                more = (i == marked,)
            elif tag in SECTIONS:  # what is marked as an article is one however short
                share = chars[i] / max(chars[0], 1)
                beside = told if marked >= 0 and i not in holds and not inside[i] else 0
                more = (min(chars[i].bit_length(), 11) // 2, 0 if share < 0.05 else 1 if share < 0.2 else 2 if share < 0.5 else 3, min(ends[i], 3), beside)
        out.append((tag, tree.words[i], 4 * links[i] // max(chars[i], 1), up, more))
    return out


def features(kind: tuple) -> list[str]:
    """Names of a kind's features; what stands in content and elsewhere alike, and often, says nothing by its tag."""
    tag, words, link, up, more = kind
    of = [f"{name}={x}" for name, x in zip(("size", "share", "ends", "beside") if len(more) > 1 else ("most",), more)]
    own = [] if tag in NEUTRAL and not link else [f"tag={tag}", f"link={link}"] if tag not in NEUTRAL else [f"link={link}"]
    return [*own, *(f"word={w}" for w in words), *([f"in={up}"] if up and up not in NEUTRAL and up not in PLAIN else []), *of]


class Forest:
    """Trees side by side, with sum-product in log odds, level by level."""

    def __init__(self, trees: Sequence[Tree]):
        self.start = np.concatenate([[0], np.cumsum([len(t.parent) for t in trees])]).astype(int)
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, self.start)]) if trees else np.zeros(0, int)
        depth = np.zeros(len(self.parent), dtype=int)
        for t, s in zip(trees, self.start):
            d = [0] * len(t.parent)
            for i in range(1, len(d)):
                d[i] = d[t.parent[i]] + 1
            depth[s : s + len(d)] = d
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []

    def beliefs(self, z: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log odds of each node's marginal, of its subtree alone, of its parent without it); edge: log potentials [node, parent's label, own label]."""
        up, message = z.copy(), np.zeros(len(z))
        for level in reversed(self.levels[1:]):
            x = up[level]
            message[level] = np.logaddexp(edge[level, 1, 0], edge[level, 1, 1] + x) - np.logaddexp(edge[level, 0, 0], edge[level, 0, 1] + x)
            np.add.at(up, self.parent[level], message[level])
        full, cavity = up.copy(), np.zeros(len(z))
        for level in self.levels[1:]:
            c = cavity[level] = full[self.parent[level]] - message[level]
            full[level] = up[level] + np.logaddexp(edge[level, 0, 1], edge[level, 1, 1] + c) - np.logaddexp(edge[level, 0, 0], edge[level, 1, 0] + c)
        return full, up, cavity


class Model:
    """Unary weights by feature and log edge potentials by child tag."""

    def __init__(self, weights: dict[str, float], edges: dict[str, list]):
        self.weights, self.edges, self.known = weights, edges, {}

    def spell(self, word: str) -> list[str]:
        """The word, or, if it isn't known, the longest known word that it begins and that it ends with."""
        if f"word={word}" in self.weights or len(word) < 5:
            return [word]
        ends = [next((p for k in range(len(word) - 1, 3, -1) if f"word={(p := cut(k))}" in self.weights), None) for cut in (lambda k: word[:k], lambda k: word[-k:])]
        return list(dict.fromkeys(e for e in ends if e))

    def z(self, kind: tuple) -> float:
        got = self.known.get(kind)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            tag, words, *rest = kind
            spelt = tuple(dict.fromkeys(p for w in words for p in self.spell(w)))
            got = self.known[kind] = sum(self.weights.get(f, 0.0) for f in features((tag, spelt, *rest)))
        return got

    def marginals(self, trees: Sequence[Tree]) -> list[np.ndarray]:
        """Each tree's log odds of being content, by sum-product."""
        if not trees:
            return []
        forest = Forest(trees)
        z = np.array([self.z(k) for t in trees for k in kinds(t)])
        other = self.edges["*"]
        edge = np.array([self.edges.get(tag, other) for t in trees for tag in t.tag]).reshape(-1, 2, 2)
        full = forest.beliefs(z, edge)[0]
        return [full[i:j] for i, j in zip(forest.start, forest.start[1:])]

    def extract(self, pages: Sequence[str | None]) -> list[str]:
        trees = [parse(p or "") for p in pages]
        return ["\n".join(x for x, k, tag in zip(t.text, m.tolist(), t.tag) if k > 0 and tag == "#text") for t, m in zip(trees, self.marginals(trees))]


def train(pages: Sequence[str], rounds: int = 200, rate: float = 0.4, ridge: float = 1.0) -> Model:
    """From pages whose elements are marked data-label="1" (content) or "0" (not) for themselves and what is in them.

    Maximum likelihood of the labels of whole trees (Adagrad from zero); a block is content if any text in it is.
    Edge potentials are distributions of the child's label given the parent's, so that a child without evidence of its
    own says nothing about its parent, however many there are.
    """
    trees = [parse(p, labels=True) for p in pages]
    forest, label = Forest(trees), []
    for t in trees:
        good = [t.label[i] == 1 and tag == "#text" for i, tag in enumerate(t.tag)]
        for i in range(len(good) - 1, 0, -1):
            good[t.parent[i]] += good[i]
        label += [int(g > 0) for g in good]
    y, names, rows, cols = np.array(label, dtype=float), {}, [], []
    for r, kind in enumerate(k for t in trees for k in kinds(t)):
        for f in features(kind):
            rows.append(r)
            cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    tags = {"*": 0}
    of = np.array([tags.setdefault(tag, len(tags)) for t in trees for tag in t.tag])
    child = np.flatnonzero(forest.parent >= 0)
    yp, yc = y[forest.parent[child]].astype(int), y[child].astype(int)
    w, e = np.zeros(len(names)), np.zeros((len(tags), 2, 2))
    sw, se = np.full(len(w), 1e-9), np.full(e.shape, 1e-9)
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[cols], minlength=len(y))
        whole = np.concatenate([e[:1], e[1:] + e[0]])
        soft = whole - np.logaddexp(whole[:, :, :1], whole[:, :, 1:])
        edge = soft[of]
        full, up, cavity = forest.beliefs(z, edge)
        gap = 1 / (1 + np.exp(-np.clip(full, -40, 40))) - y
        joint = edge[child] + np.stack([np.zeros(len(child)), cavity[child]], axis=1)[:, :, None] + np.stack([np.zeros(len(child)), up[child]], axis=1)[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        joint[np.arange(len(child)), yp, yc] -= 1
        gw = np.bincount(cols, weights=gap[rows], minlength=len(w)) + ridge * w
        raw = np.zeros(e.shape)
        np.add.at(raw, of[child], joint)
        raw -= np.exp(soft) * raw.sum(axis=2, keepdims=True)
        ge = ridge * e + raw
        ge[0] += raw[1:].sum(axis=0)
        sw, se = sw + gw * gw, se + ge * ge
        w, e = w - rate * gw / np.sqrt(sw), e - rate * ge / np.sqrt(se)
    whole = np.concatenate([e[:1], e[1:] + e[0]])
    soft = whole - np.logaddexp(whole[:, :, :1], whole[:, :, 1:])
    return Model({f: float(w[k]) for f, k in names.items()}, {t: soft[k].tolist() for t, k in tags.items()})


_CONTENT = ["<article{}>", "<article{}>", "<article{}>", "<article{}>", "<main{}>", '<div class="content"{}>', '<div id="main-content"{}>', '<div class="post-body"{}>', '<section class="story"{}>', '<div class="entry-content"{}>', '<div class="article-text"{}>', '<article class="post"{}>', '<div id="article"{}>']
_OTHER = {
    "nav": ["<nav{}>", '<div class="menu"{}>', '<ul class="nav navbar"{}>', '<div class="breadcrumb breadcrumbs"{}>', '<div id="navigation" role="navigation"{}>', '<div class="pagination pager"{}>', '<div class="tags share social"{}>'],
    "line": ['<header{}>', '<div id="header" class="site-header masthead"{}>', '<div class="top bar banner" role="banner"{}>', "<footer{}>", '<div id="footer" class="site-footer"{}>', '<div class="copyright legal" role="contentinfo"{}>'],
    "ad": ['<div class="ad"{}>', '<div class="ads advert advertisement"{}>', '<div class="sponsored sponsor promo promotion"{}>', '<div id="banner-ad"{}>', '<aside class="ad"{}>', '<section class="promo"{}>', '<p class="ad advert"{}>'],
    "side": ["<aside{}>", '<div class="sidebar"{}>', '<div id="sidebar" class="widget"{}>', '<div class="related recommended more"{}>', '<section class="sidebar related"{}>', '<aside class="sidebar"{}>'],
    "note": ['<div class="cookie cookies notice consent"{}>', '<div class="notice"{}>', '<div id="cookie-banner" class="gdpr privacy"{}>', '<div class="alert warning popup modal overlay" role="alert"{}>', '<div class="paywall subscribe newsletter signup"{}>', '<p class="notice"{}>', '<section class="notice"{}>'],
    "form": ["<form{}>", '<form class="search" role="search"{}>', '<form class="comment-form"{}>', '<form id="login"{}>', '<div class="search login signup"{}>'],
    "talk": ['<section class="comments"{}>', '<div id="comments"{}>', '<div class="comment-list discussion replies"{}>', '<ol class="commentlist"{}>', '<section id="comments" class="reader-comments"{}>', '<div class="responses feedback comment"{}>'],
}


def labelled_pages(n: int = 700, seed: int = 11) -> list[str]:
    """Pages of many layouts with marked content, generated from a seed."""
    rng = random.Random(seed)
    parts, hidden = "ba co di fu ge ha li mo nu pe ra si to ve zu la ner tin sal mor".split(), 0.0

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def sentences(lo: int, hi: int) -> str:
        return " ".join(words(3, 14).capitalize() + rng.choice("....?!") for _ in range(rng.randint(lo, hi)))

    def link(lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{words(1, 1)}">{words(lo, hi)}</a>'

    def unnamed(open_: str) -> str:
        """The element without telling names: of another tag maybe, and of class words that are seen nowhere else."""
        tag = rng.choice([re.match(r"<(\w+)", open_)[1], "div", "div", "section"]) if "<p" not in open_ else "div"
        if tag in ("article", "main", "nav", "header", "footer", "aside", "form"):
            tag = "div"
        name = "".join(rng.choice(parts) for _ in range(3)) + rng.choice(["", "-" + rng.choice(parts), "__" + rng.choice(parts), "_" + str(rng.randint(1, 99))])
        return rng.choice([f'<{tag} class="{name}"{{}}>', f'<{tag} id="{name}"{{}}>', f"<{tag}{{}}>", f'<{tag} class="{name} {rng.choice(parts)}{rng.randint(1, 9)}"{{}}>'])

    def close(open_: str) -> str:
        return f"</{re.match(r'<(\w+)', open_)[1]}>"

    def other(kind: str) -> str:
        open_ = rng.choice(_OTHER[kind])
        if rng.random() < hidden and kind != "talk":
            open_ = unnamed(open_)
        if kind == "nav":
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>" if not open_.startswith("<ul") else "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        elif kind == "line":
            inner = rng.choice([f"&copy; {words(1, 3)} &middot; {sentences(1, 1)}", f"<p>{words(2, 8)}</p>", f"<h1>{words(1, 3)}</h1><p>{words(2, 5)}</p>", f"<h2>{link()}</h2>", f"<span>{words(1, 4)}</span>{link()} | {link()}", sentences(1, 2)])
        elif kind == "form":
            inner = rng.choice([f"<label>{words(1, 3)}</label><input name=q>", f"<p>{sentences(1, 1)}</p><input type=email><button>{words(1, 1)}</button>", f"<label>{words(1, 2)} <select><option>{words(1, 1)}</select></label>", words(1, 4) + "<input>"])
        elif kind == "talk":
            item = rng.choice(["<div class=\"comment\"><p>{}</p></div>", "<p>{}</p>", "<li class=\"comment\"><b>x</b> {}</li>", *(["<article class=\"comment\"><p>{}</p></article>"] * (rng.random() < 0.2)), "<div class=\"comment\"><span class=\"author\">z</span><p>{}</p></div>"])
            inner = rng.choice([f"<h2>{words(1, 3)}</h2>", f"<h3>{words(1, 2)}</h3>", ""]) + "".join(item.format(sentences(1, 4)) for _ in range(rng.randint(1, 5)))
        elif kind == "side":
            inner = rng.choice([f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link(2, 6)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<p>{sentences(1, 3)}</p>", f"<h2>{words(1, 3)}</h2><p>{sentences(1, 2)}</p>", sentences(1, 2)])
        else:
            inner = rng.choice([sentences(1, 2), f"<p>{sentences(1, 2)}</p>", f"<b>{words(1, 3)}</b> {sentences(1, 1)} {link()}", f"{sentences(1, 1)}<button>{words(1, 1)}</button>"])
        return open_.format(' data-label="0"') + inner + close(open_)

    def body() -> str:
        out = []
        if rng.random() < 0.85:
            title = f"<h1>{words(2, 9)}</h1>"
            out.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6, 9, 14, 30])):
            kind = rng.random()
            if kind < 0.7:
                text = rng.choice([sentences(1, rng.choice([1, 2, 4, 9])), sentences(1, rng.choice([1, 2, 4, 9])), words(1, 3) + " ", " ".join([words(1, 1)] * rng.choice([3, 30, 300])), " ".join(w + rng.choice(["%%%", " |", "***", ","]) for w in words(5, 60).split())])
                out.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{words(2, 6)} {link()} {text}</p>", f"<p>{text}</p>", f"<div>{text}</div>", f"<p>{words(1, 2)}.</p>"]))
            elif kind < 0.78:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{words(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{sentences(1, 3)}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{words(2, 20)}</pre>")
            elif kind < 0.97:
                out.append(f"<figure><figcaption>{words(2, 9)}</figcaption></figure>")
            else:
                out.append(other(rng.choice(["ad", "nav", "side", "note", "form"])))
        if rng.random() < 0.12:
            out.append(other("talk"))
        return "".join(out)

    pages = []
    for _ in range(n):
        hidden = rng.choice([0.0, 0.0, 0.5, 0.9])
        open_ = rng.choice(_CONTENT)
        if rng.random() < hidden / 2:
            open_ = unnamed(open_)
        content = open_.format(' data-label="1"') + body() + close(open_)
        whole = rng.random()
        if whole < 0.12:
            content = f'<div data-label="1">{body()}</div>'
        elif whole < 0.2:
            content = open_.format(' data-label="1"') + rng.choice(["<p>{}</p>", "<h1>{}</h1>", "<p>{}", "{}", "<h1>{}</h1><p>{}.</p>"]).replace("{}", words(1, 3)) + close(open_)
        bare = whole > 0.9
        if bare:
            content = body()
        before = [other(k) for k in rng.sample(["nav", "line", "ad", "note", "form", "side"], rng.randint(0, 4))]
        after = [other(k) for k in rng.sample(["line", "ad", "side", "talk", "form", "note", "nav"], rng.randint(0, 4))]
        inside = "".join(before) + content + "".join(after)
        if rng.random() < 0.3:
            inside = rng.choice(['<div id="page" class="wrapper container">', '<div class="container">', '<div id="wrap">']) + inside + "</div>"
        if rng.random() < 0.3:
            head = other("line") + other("nav")
            inside = head + inside
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body{' data-label="1"' * bare}>{inside}</body></html>")
    return pages


MODEL = os.path.join(os.path.dirname(__file__), "data", "html_model.json")


@lru_cache(maxsize=1)
def default_model() -> Model:
    with open(MODEL) as f:
        kept = json.load(f)
    return Model(kept["weights"], kept["edges"])


def save(model: Model, path: str = MODEL) -> None:
    with open(path, "w") as f:
        json.dump({"weights": {k: round(w, 4) for k, w in sorted(model.weights.items())}, "edges": {k: np.round(e, 4).tolist() for k, e in sorted(model.edges.items())}}, f, indent=0)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    model = model or default_model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = model.extract(part.column(2).to_pylist())
                yield as_batch(schema, page_id=part.column(0), url=part.column(1), text=texts, n_chars=[len(t) for t in texts])

    return pick(pages, "page_id", "url", "html").mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


if __name__ == "__main__":
    save(train(labelled_pages()))
