"""Operator 9: threshold-scaled sketches (every shingle hash below a fixed fraction is kept).

A sketch grows with its text, two sketches merge by union, and the share of one that lies in the other estimates
containment however unequal the texts are. Shingles are `WIDTH` lower-cased words (fewer words: the whole sequence).
The fraction is 1/4; a text of at most `FEW` distinct shingles keeps all of its hashes, so that short texts are compared exactly.
Sketches of both kinds are compared, and merged, below the fraction. The fingerprint string is the base64 of the
sorted 32 upper bits, after "=" where all are kept; of a text without words it is empty.

Following documents (ascending doc_id, ties by text hash, nulls first) are brought together by ranges of doc_id;
a doc_id (or null) that fills several ranges is split by text hash. Each range also gets the first document of the next one,
found from one row per range. Texts are moved once.

Nulls: a null text is empty; two texts without words are alike (1.0), one without and one with are not (0.0).
A null doc_id sorts first. Repeated rows stay, each followed by the next. Empty tables give no rows; of a single
document the next is itself. Very long texts are scanned in pieces, whole. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._run import as_batch, pick, table, tidied

WIDTH, FRACTION_BITS, FEW = 3, 2, 256
_U = np.uint64
Sketch = tuple[np.ndarray, bool]


def sketches(texts: pa.Array, width: int = WIDTH, bits: int = FRACTION_BITS, few: int = FEW) -> Iterator[Sketch]:
    """(sorted distinct 32-bit values, whether they are all) of each text: hashes below 2 ** -bits of the range, or all of few."""
    raw, at = _text.utf8(texts)
    for i, j in _text.chunks(at):
        h, bounds = _text.words(raw, at, i, j)
        s, bounds = _text.shingles(h, bounds, width)
        top = (s >> _U(32)).astype(np.uint32)
        low = np.flatnonzero(top < 1 << (32 - bits))
        kept, edges = top[low], np.searchsorted(low, bounds)
        for t in range(j - i):
            n, part = int(bounds[t + 1] - bounds[t]), None
            if n > few:
                part = np.unique(kept[edges[t] : edges[t + 1]])
            if part is not None and len(part) > few:
                yield part, False
                continue
            whole = np.unique(top[bounds[t] : bounds[t + 1]])
            yield (whole, True) if len(whole) <= few else (part, False)


def to_string(values: np.ndarray, whole: bool) -> str:
    return ("=" if whole and len(values) else "") + base64.b64encode(values.astype(">u4").tobytes()).decode().rstrip("=")


def from_string(text: str) -> Sketch:
    body = text.removeprefix("=")
    return np.frombuffer(base64.b64decode(body + "=" * (-len(body) % 4)), dtype=">u4").astype(np.uint32), text[:1] in ("", "=")


def _level(a: Sketch, b: Sketch, bits: int = FRACTION_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The values of both below the lower of their limits."""
    if a[1] == b[1]:
        return a[0], b[0]
    return tuple(v[: np.searchsorted(v, 1 << (32 - bits))] if whole else v for v, whole in (a, b))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    return np.union1d(*_level(a, b)), a[1] and b[1]


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity; exact for two texts of few shingles."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    x, y = _level(a, b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has too; of a text that has none below the limit it says 0."""
    if not len(a[0]):
        return 1.0
    x, y = _level(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / max(len(x), 1)


def with_next(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text and ahead of documents, partitioned and sorted so that each row is followed by the next document.

    Rows with ahead = 1 are copies of the first document of the next range and stand last in theirs.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * parts
    docs = pick(documents, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("some")).first()
    none = ranges * (rows.n - rows.some) // max(rows.n, 1)  # ranges of rows without doc_id, besides the first
    some = max(ranges - none, 1)
    cuts = docs.approxQuantile("doc_id", [k / some for k in range(1, some)], 0.25 / some) if some > 1 and rows.some else []
    edges = np.sort(np.array(cuts, dtype=np.float64)).astype(np.int64)
    h = F.xxhash64("text")

    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The range of each row; one of several by the text's hash where a doc_id fills them."""
        lost = ids.is_null().to_numpy(zero_copy_only=False)
        key, part = ids.fill_null(0).to_numpy(), (hashes.to_numpy() >> 32) / 2.0**32 + 0.5
        below, upto = np.searchsorted(edges, key, side="left") + none, np.searchsorted(edges, key, side="right") + none
        below[lost], upto[lost] = 0, none
        return pa.array((below + np.minimum((part * (upto - below + 1)).astype(np.int64), upto - below)).astype(np.int32))

    bucket = F.arrow_udf(place, returnType="int")("doc_id", "h")
    keyed = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", "h", bucket.alias("bucket"))
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")
    firsts = sorted(keyed.groupBy("bucket").agg(F.min(key).alias("k")).collect())  # one row per range
    if not firsts:
        return keyed.select("doc_id", "text", "bucket", F.lit(0).alias("ahead"))
    before = [(f.k.doc_id, f.k.h, firsts[k - 1].bucket) for k, f in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "fid long, fh long, prior int"))  # as few
    marked = keyed.join(heads, keyed["doc_id"].eqNullSafe(heads["fid"]) & (keyed["h"] == heads["fh"]), "left")
    own = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ahead")))
    both = F.when(F.col("prior").isNull(), own).otherwise(F.concat(own, F.array(F.struct(F.col("prior").alias("b"), F.lit(1).alias("ahead")))))
    spread_rows = marked.select("doc_id", "text", "h", F.explode(both).alias("x")).select("doc_id", "text", "h", F.col("x.b").alias("bucket"), F.col("x.ahead").alias("ahead"))
    rows = spread_rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "h")
    return rows.select("doc_id", "text", "bucket", "ahead")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, next text), each followed by the next but where a range ends."""
        edited = []
        for _, text, after in rows:
            n = len(text) // 4
            edited.append(text[: len(text) - n] + after[:n])
        mine = list(sketches(pa.array([t for _, t, _ in rows], type=pa.large_string())))
        theirs = list(sketches(pa.array(edited, type=pa.large_string())))
        loose = [k for k in range(len(rows)) if k + 1 == len(rows) or rows[k + 1][1] is not rows[k][2]]
        after = dict(zip(loose, sketches(pa.array([rows[k][2] for k in loose], type=pa.large_string()))))
        nexts = [after[k] if k in after else mine[k + 1] for k in range(len(rows))]
        return as_batch(
            schema, doc_id=[r[0] for r in rows], n_chars=[len(r[1]) for r in rows], edited_sha256=[hashlib.sha256(e.encode()).hexdigest() for e in edited],
            fingerprint=[to_string(*s) for s in mine], edited_fingerprint=[to_string(*s) for s in theirs],
            near_edited=[likeness(a, b) for a, b in zip(mine, theirs)], near_next=[likeness(a, b) for a, b in zip(mine, nexts)],
        )

    last, rows, size = None, [], 0
    for b in batches:
        for doc_id, text, bucket, ahead in zip(*(c.to_pylist() for c in b.columns)):
            if last is not None and last[2] == bucket:
                rows.append((last[0], last[1], text))
                size += len(last[1]) + 1000
                if size > 4_000_000:
                    yield done(rows)
                    rows, size = [], 0
            last = None if ahead else (doc_id, text, bucket)
    if rows:
        yield done(rows)


def fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents).mapInArrow(tidied(_edit), fields)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
