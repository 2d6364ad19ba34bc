"""Operator 6: exact n-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into size bands; in a band, sets that are similar enough differ in at most k elements.
The feature domain is split into n1 first-level partitions of n2 parts each; of the n1 partitions one has at most
k2 differing elements, so two similar sets agree on all but k2 of its n2 parts, and share the signature
that stands for that subset of parts. Every band enumerates subsets (k2 > 0 wherever k > 0); which n1, n2 and k2 is a matter of
cost (`design`). How many signatures two sets at a distance must share is known (`shared`), and an exact filter before any set is compared.

A signature of more than `BLOCK` classes is hot. A class whose hot signatures are fewer than it must share with any
similar set is found by its other ones and leaves the hot groups; for what stays there, blocks of a group meet pair by pair,
each pair of blocks in a task of its own.

Equal sets are one class from the start (partial aggregation by set key), so copies are never paired, and each
task emits the signatures of a class once. Only classes that share enough signatures have their sets compared.

Nulls: a null text is empty; an empty text has no shingles, links with nothing and is its own component (by doc_id;
rows that repeat a doc_id or have none count as documents of their own, a null doc_id giving a null component when
nothing else is in it). Repeated rows and ties link as equal sets do. Empty tables give no rows. Very long texts are
scanned in pieces, whole. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._run import as_batch, fresh, pick, small_batches, stash, table, tidied

WIDTH, PERCENT = 5, 90
BAND_GROWTH, BLOCK, SEEN, MOST_SKIPPED, SLACK = 1.5, 256, 1 << 18, 8, 1.15
_U = np.uint64


def bands(growth: float = BAND_GROWTH) -> np.ndarray:
    """Lower ends of the size bands."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * growth)))
    return np.array(ends, dtype=np.int64)


BANDS = bands()


def max_distance(total: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The most elements in which sets of together `total` elements can differ at Jaccard percent / 100."""
    return total * (100 - percent) // (100 + percent)


def design(k: int, least: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for distance k and sets of at least `least` elements: the fewest signatures that hold 3 elements each.

    Where none holds as many (small sets), the one that holds the most. From k = 8 on there are some more partitions than k needs,
    so that sparse signatures can be left out (see `signatures`) and the count filter is sharp.
    """
    if k == 0:
        return 1, 1, 0
    found = []
    for k2 in range(1, min(k, 4) + 1):
        n1 = -(-(k + 1) // (k2 + 1)) if k < 8 else math.ceil(SLACK * (k + 1) / (k2 + 1))
        for n2 in range(k2 + 2, k2 + 5):
            held = least * (n2 - k2) / (n1 * n2)
            found.append((min(held, 3.0), -n1 * math.comb(n2, k2), held, (n1, n2, k2)))
    return max(found)[3]


DESIGNS = [design(int(max_distance(2 * (int(BANDS[q + 1]) - 1))), int(BANDS[q])) for q in range(len(BANDS) - 1)]


def shared(d: int, n1: int, n2: int, k2: int) -> int:
    """The fewest signatures that two sets at distance d share: differences do most harm if all partitions have as many."""
    q, r = divmod(d, n1)
    left = [math.comb(max(n2 - x, 0), n2 - k2) for x in (q, q + 1)]
    return (n1 - r) * left[0] + r * left[1]


@lru_cache(maxsize=1 << 16)
def least_shared(n: int, band: int) -> int:
    """The fewest that a set of n elements and any similar one share in a band, sparse ones left out."""
    return -(-shared(int(max_distance(n + n * 100 // PERCENT)), *DESIGNS[band]) // 2)


def bands_of(n: int) -> list[int]:
    """The bands in which a set of n elements has signatures: its own, and the next if a similar set may be there."""
    q = int(np.searchsorted(BANDS, n, side="right")) - 1
    return [q, q + 1] if 100 * n >= PERCENT * int(BANDS[q + 1]) else [q]


@lru_cache(maxsize=256)
def _subsets(n2: int, k2: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), n2 - k2)))


def signatures(s: np.ndarray, band: int) -> np.ndarray:
    """PartEnum signatures of a set of hashes in one band.

    Signatures of few elements, on which sets agree that share a passage or nothing, are left out: all below the
    largest size for which they are at most half of the signatures that similar sets must share. The other half is left to find
    them by: a signature that two sets share is of as many elements in both, and of two such bounds the higher leaves half of what they share.
    """
    n1, n2, k2 = DESIGNS[band]
    slots = n1 * n2
    if slots == 1:  # distance 0: only equal sets are similar, and those are one class already
        return np.zeros(0, dtype=_U)
    acc = np.zeros(slots, dtype=_U)
    place = (s % _U(slots)).astype(np.int64)
    np.add.at(acc, place, _text.mix(s ^ _U(0x5851F42D4C957F2D)))
    acc = _text.mix(acc + np.arange(slots, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(band * 7919 + 1)).reshape(n1, n2)
    held, subsets = np.bincount(place, minlength=slots).reshape(n1, n2), _subsets(n2, k2)
    out = _text.mix(acc[:, subsets].sum(axis=2, dtype=_U) + np.arange(len(subsets), dtype=_U) * _U(97) + _U(13)).ravel()
    size = held[:, subsets].sum(axis=2).ravel()
    below = np.cumsum(np.bincount(np.minimum(size, MOST_SKIPPED), minlength=MOST_SKIPPED + 1))[:MOST_SKIPPED]
    least = int((2 * below <= shared(int(max_distance(len(s) + len(s) * 100 // PERCENT)), n1, n2, k2)).sum())
    return out[size >= least]


def sets_of(batch: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, at = _text.utf8(batch)
    for i, j in _text.chunks(at):
        h, bounds = _text.words(raw, at, i, j)
        s, bounds = _text.shingles(h, bounds, width)
        for t in range(j - i):
            x = np.sort(s[bounds[t] : bounds[t + 1]])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a set; used together with its size."""
    return int(_text.mix(np.array([_text.mix(s).sum(dtype=_U) + _U(len(s))], dtype=_U)).astype(np.int64)[0]) if len(s) else 0


def _profile(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("sigs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n, key, sigs = [], [], []
                for s in sets_of(part.column(1), width):
                    k = (set_key(s), len(s))
                    n.append(len(s))
                    key.append(k[0])
                    if not len(s) or k in seen:
                        sigs.append(None)
                        continue
                    seen[k] = None
                    if len(seen) > SEEN:
                        seen.popitem(last=False)
                    sigs.append(np.concatenate([signatures(s, q) for q in bands_of(len(s))]).view(np.int64))
                yield as_batch(schema, doc_id=part.column(0), n=n, key=key, sigs=pa.array(sigs, type=pa.list_(pa.int64())))

    return run


def _groups(block: int, all_of: bool = False):
    """From (sig, key, n) in order: the members of each signature that several classes share, at most `block` in a row.

    sig and part (which block of it) are given of hot signatures only, unless all_of. No more than a block is held.
    """
    schema = pa.schema([("sig", pa.int64()), ("part", pa.int32()), ("key", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, part, held, size, last = None, 0, [], 0, None

        def block_of(most: int) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held, size
            key, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held, size = [(key[most:], n[most:])], max(size - most, 0)
            return key[:most], n[:most]

        def close() -> None:
            if now is not None and size and (part or size > 1):
                rows.append((now, part, *block_of(block)) if part or all_of else (None, 0, *block_of(block)))

        def made() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=schema.types[k]) for k in range(4)], schema=schema)
            rows.clear()
            return got

        for b in batches:
            sig, key, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(sig):
                continue
            new = np.ones(len(sig), dtype=bool)  # tasks that saw copies of a class gave its signatures each
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
            new[0] = (sig[0], key[0], n[0]) != last
            last = (sig[-1], key[-1], n[-1])
            sig, key, n = sig[new], key[new], n[new]
            if not len(sig):
                continue
            edges = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]])
            some = np.diff(edges) > 1
            some[[0, -1]] = True
            for g in np.flatnonzero(some):
                lo, hi = edges[g], edges[g + 1]
                if now is None or sig[lo] != now:
                    close()
                    now, part, held, size = sig[lo], 0, [], 0
                held.append((key[lo:hi], n[lo:hi]))
                size += int(hi - lo)
                while size > block:
                    rows.append((now, part, *block_of(block)))
                    part += 1
                if len(rows) >= 1000:
                    yield made()
        close()
        if rows:
            yield made()

    return run


_PAIRS = pa.schema([(c, pa.int64()) for c in ("a", "na", "b", "nb")])


def _cross(a: np.ndarray, na: np.ndarray, b: np.ndarray | None = None, nb: np.ndarray | None = None) -> pa.RecordBatch:
    """Pairs of classes of one block, or of two, whose sizes allow the similarity, in one order."""
    if b is None:
        (i, j), b, nb = np.triu_indices(len(a), 1), a, na
    else:
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    x, nx, y, ny = a[i], na[i], b[j], nb[j]
    fit = (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)) & ((x != y) | (nx != ny))
    x, nx, y, ny = x[fit], nx[fit], y[fit], ny[fit]
    swap = (x > y) | ((x == y) & (nx > ny))
    return as_batch(_PAIRS, a=np.where(swap, y, x), na=np.where(swap, ny, nx), b=np.where(swap, x, y), nb=np.where(swap, nx, ny))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks (key, n): the pairs in each."""
    for batch in batches:
        waiting, size = [], 0
        for key, n in zip(*batch.columns):
            waiting.append(_cross(key.values.to_numpy(), n.values.to_numpy()))
            size += waiting[-1].num_rows
            if size > 50_000:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, size = [], 0
        if size:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sig, lo, hi, key, n) in order, two blocks of each (sig, lo, hi), or one where lo is hi: the pairs of them."""
    first = None
    for batch in batches:
        for sig, lo, hi, key, n in zip(*batch.columns):
            at, block = (sig.as_py(), lo.as_py(), hi.as_py()), (key.values.to_numpy(), n.values.to_numpy())
            if at[1] == at[2]:
                yield _cross(*block)
            elif first is not None and first[0] == at:
                yield _cross(*first[1], *block)
                first = None
            else:
                first = at, block


def _class_needs(ns: pa.Array) -> pa.Array:
    """How many signatures a class of n elements shares at least with any similar one."""
    return pa.array([min(least_shared(n, q) for q in bands_of(n)) for n in ns.to_pylist()], type=pa.int64())


def _pair_needs(na: pa.Array, nb: pa.Array) -> pa.Array:
    """How many signatures a pair shares at least if it is similar, sparse ones left out."""
    out = []
    for x, y in zip(na.to_pylist(), nb.to_pylist()):
        out.append(-(-shared(int(max_distance(x + y)), *DESIGNS[bands_of(max(x, y))[0]]) // 2))
    return pa.array(out, type=pa.int64())


def candidates(sigs: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, na, b, nb of the pairs of classes (sig, key, n) that share as many signatures as similar ones must."""
    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def grouped(rows: DataFrame, all_of: bool = False) -> DataFrame:
        rows = rows.select("sig", "key", "n").repartition(parts, "sig").sortWithinPartitions("sig", "key", "n")
        return rows.mapInArrow(tidied(_groups(block, all_of)), "sig long, part int, key array<long>, n array<long>")

    blocks = stash(grouped(sigs), "blocks")
    found = blocks.where("sig is null").select("key", "n").mapInArrow(tidied(_pairs), "a long, na long, b long, nb long")
    hot = blocks.where("sig is not null")
    need = F.arrow_udf(_pair_needs, returnType="long")("na", "nb")
    if hot.isEmpty():
        return found.groupBy("a", "na", "b", "nb").count().where(F.col("count") >= need).drop("count")
    members = hot.select("sig", F.explode(F.arrays_zip("key", "n")).alias("x")).select("sig", "x.key", F.col("x.n").cast("int").alias("n"))
    marked = stash(members.groupBy("key", "n").agg(F.count("*").alias("p")).withColumn("unsafe", F.col("p") >= F.arrow_udf(_class_needs, returnType="long")("n")), "marked")
    kept = stash(grouped(members.join(marked.where("unsafe").select("key", "n"), ["key", "n"], "left_semi"), all_of=True), "hot")
    sizes = kept.groupBy("sig").agg(F.max("part").alias("last"))
    met = kept.join(sizes, "sig").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    met = met.select("sig", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "key", "n")
    met = met.repartition(parts, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(tidied(_meet), "a long, na long, b long, nb long")
    counted = found.unionByName(met).groupBy("a", "na", "b", "nb").count()
    for c in "ab":
        p = marked.select(F.col("key").alias(c), F.col("n").cast("long").alias(f"n{c}"), F.col("p").alias(f"p{c}"))
        counted = counted.join(p, [c, f"n{c}"], "left")
    less = F.least(F.coalesce("pa", F.lit(0)), F.coalesce("pb", F.lit(0)))
    return counted.where(F.col("count") + less >= need).select("a", "na", "b", "nb")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (u, v): large-star and small-star rounds until nothing changes, each round written."""
    e = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = large.where("u <> v").distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        small = e1.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stash(small.where("u <> v").distinct(), "cc")
        same = new.count() == e.count() and new.exceptAll(e).isEmpty()
        e = new
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def similar_classes(documents: DataFrame, width: int = WIDTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(profile: doc_id, n, key of each row; links: a, na, b, nb between classes of equal sets), both written."""
    docs = pick(documents, "doc_id", "text")
    profile = stash(docs.mapInArrow(tidied(_profile(width)), "doc_id long, n long, key long, sigs array<long>"), "profile")
    sigs = profile.where("sigs is not null").select(F.explode("sigs").alias("sig"), "key", F.col("n").cast("int").alias("n"))
    pairs = stash(candidates(sigs, block), "pairs")

    ends = pairs.select(F.col("a").alias("key"), F.col("na").alias("n")).union(pairs.select("b", "nb")).distinct()
    first = profile.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("doc_id")).join(ends, ["key", "n"]).select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.join(first, docs["doc_id"].eqNullSafe(first["__id"]), "left_semi")
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                got = list(sets_of(b.column(1).slice(lo, 256), width))
                yield as_batch(schema, key=[set_key(s) for s in got], n=[len(s) for s in got], set=[s.tobytes() for s in got])

    sets = texts.mapInArrow(tidied(load), "key long, n long, set binary").join(ends, ["key", "n"], "left_semi").groupBy("key", "n").agg(F.first("set").alias("set"))
    sets = stash(sets, "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([(c, pa.int64()) for c in ("a", "na", "b", "nb")])
        for b in batches:
            ok = []
            for sa, sb in zip(b.column(4), b.column(5)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (sa, sb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in range(4)], schema=out)

    sa, sb = (sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("set").alias(f"s{c}")) for c in "ab")
    checked = pairs.join(sa, ["a", "na"]).join(sb, ["b", "nb"]).select("a", "na", "b", "nb", "sa", "sb")
    return profile.select("doc_id", "n", "key"), stash(checked.mapInArrow(tidied(compare), "a long, na long, b long, nb long"), "links")


def near_duplicates(documents: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id of each row of documents (doc_id, text), class_key, class_size, and leads.

    Components are of classes, not of doc_ids, which may repeat or be null. Of each one class leads: that of the smallest
    doc_id (the smallest key of several); leads marks the rows of it that have that doc_id, and all rows without shingles.
    """
    profile, links = similar_classes(documents, width, block)
    some = profile.where("n > 0")
    classes = some.groupBy("key", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    a, b = (classes.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("copies").alias(f"c{c}"), F.col("node").alias(f"i{c}")) for c in "ab")
    full = stash(links.join(a, ["a", "na"]).join(b, ["b", "nb"]), "full")
    near = full.select(F.col("a").alias("key"), F.col("na").alias("n"), F.col("cb").alias("c")).union(full.select("b", "nb", "ca")).groupBy("key", "n").agg(F.sum("c").alias("near"))
    roots = components(full.select(F.col("ia").alias("u"), F.col("ib").alias("v")))
    roots = roots.union(roots.select("root", "root").distinct())
    heads = roots.join(classes, "node").groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key", "n", "node")).alias("head"))
    roots = roots.join(heads, "root").select("node", "head")
    per = classes.join(near, ["key", "n"], "left").join(roots, "node", "left")
    per = per.select(
        "key", "n", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_similar"),
        F.when(F.col("head").isNull(), F.col("first")).otherwise(F.col("head.first")).alias("component_id"), F.coalesce(F.col("head.node") == F.col("node"), F.lit(True)).alias("leads"),
    )
    leads = (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("leads")
    out = some.join(per, ["key", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "n_similar", "component_id", F.col("key").alias("class_key"), F.col("copies").alias("class_size"), leads)
    none = profile.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("class_key"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("leads"))
    return out.unionByName(none)


def with_class(documents: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """documents with the (key, n) of each row's set of shingles, in a column of that name."""

    def run(texts: pa.Array) -> pa.Array:
        got = [(set_key(s), len(s)) for s in sets_of(texts, width)]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], type=pa.int64()) for k in (0, 1)], names=["key", "n"])

    return documents.withColumn(name, F.arrow_udf(run, returnType="struct<key: bigint, n: bigint>")("text"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component: one that `near_duplicates` says leads; and every row without words, which copies nothing.

    What is dropped is the smaller side of the join, so that texts needn't move where few documents go. Only where a
    doc_id is repeated (or null) it doesn't tell the rows apart: sets of those rows are made again, and each row is judged by its own.
    """
    small_batches(documents.sparkSession)
    own = fresh(documents, "__set")
    near = near_duplicates(documents).groupBy(F.col("doc_id").alias("__id"), F.struct(F.col("class_key").alias("key"), F.col("n_shingles").alias("n")).alias("__of")).agg(F.count("*").alias("rows"), F.max("leads").alias("leads"))
    stay = F.when(F.col("__of.n") == 0, F.col("rows")).otherwise(F.col("leads").cast("long"))
    near = stash(near.select("__id", "__of", "rows", stay.alias("stay")), "kept")
    by_id = stash(near.groupBy("__id").agg(F.sum("rows").alias("rows"), F.sum("stay").alias("stay")).where("stay < rows"), "decided")
    gone, again = by_id.select("__id"), by_id.where("stay > 0").select("__id")
    once = documents.join(gone, documents["doc_id"].eqNullSafe(gone["__id"]), "left_anti")
    some = documents.join(again, documents["doc_id"].eqNullSafe(again["__id"]), "left_semi")
    has_words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    lead = near.where("stay > 0 and __of.n > 0").select("__id", "__of").join(again.withColumnRenamed("__id", "__again"), F.col("__id").eqNullSafe(F.col("__again")), "left_semi")
    led = with_class(some.where(has_words), own)
    led = led.join(lead, led["doc_id"].eqNullSafe(lead["__id"]) & (led[own] == lead["__of"]), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return once.unionByName(led).unionByName(some.where(~has_words))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_similar", "component_id")


OP6_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH} - 1], ' ')) END)) AS g FROM w),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
c AS (SELECT doc_id AS v, doc_id AS r FROM w UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.v WHERE c.r < l.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(d.k, 0) AS n_similar, m.r AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM l GROUP BY a) d USING (doc_id)
JOIN (SELECT v AS doc_id, min(r) AS r FROM c GROUP BY v) m USING (doc_id)
"""
