"""Keep-first deduplication that doesn't depend on parallelism: exact, by SimHash and by embedding.

Near duplicates follow the order of rows: a row stays if no kept earlier row is within the threshold (the
lexicographically first maximal independent set of the similarity graph). Candidates come from equi-joins that
lose none: SimHash bands by the pigeonhole principle. Embeddings meet all embeddings, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BITS, normalize, simhashes
from ..plans.storage import file_system, folders, stash, work_dir


def keep_first(df: DataFrame, key: Column, order: str | Sequence[str | Column], state: DataFrame | None = None) -> DataFrame:
    """The first row by `order`, one column or several, of each key that `state` (key) doesn't hold. Rows with a null key are dropped."""
    out = df.withColumn("__key", key).where("__key is not null")
    if state is not None:
        out = out.join(state.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti")
    by = Window.partitionBy("__key").orderBy(order)
    return out.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def _choices(threshold: int, spare: int, bits: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Where the blocks of a fingerprint begin and end, and the choices of blocks."""
    count = min(threshold + spare, bits)
    return [round(k * bits / count) for k in range(count + 1)], list(combinations(range(count), max(count - threshold, 1)))


def bands(value: Column, threshold: int, spare: int = 1, bits: int = BITS) -> Column:
    """Of threshold + spare blocks of a fingerprint, all choices of `spare`: two within the threshold agree on one of them."""
    edges, choices = _choices(threshold, spare, bits)
    blocks = [F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < bits else value for lo, hi in zip(edges, edges[1:])]
    out = []
    for k, some in enumerate(choices):
        key = F.lit(0).cast("long")
        for i in some:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(blocks[i])
        out.append(F.struct(F.lit(k).alias("band"), key.alias("bits")))
    return F.array(*out)


def first_band(differ: Column, threshold: int, spare: int = 1, bits: int = BITS) -> Column:
    """The first of `bands` on which two fingerprints agree, of the bits in which they differ."""
    edges, choices = _choices(threshold, spare, bits)
    out = F.lit(None).cast("int")
    for k, some in reversed(list(enumerate(choices))):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in some)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out = F.when(differ.bitwiseAND(F.lit(mask).cast("long")) == 0, k).otherwise(out)
    return out


def spare_blocks(n: int) -> int:
    """More blocks give longer keys, hence smaller buckets, for more rows; none of the choices loses a pair."""
    return 1 if n < 1 << 18 else 2 if n < 1 << 26 else 3


def simhash_pairs(prints: DataFrame, threshold: int, other: DataFrame | None = None, spare: int = 1) -> DataFrame:
    """(i, j) of prints (id, print: an id once) within the threshold, i < j; with `other`, (i, j) of a row and one of the other.

    A pair that meets in several bands counts in the first, so that nothing is held to drop repeats. Both sides are sorted, not broadcast.
    """

    def keyed(df: DataFrame, id_: str, print_: str) -> DataFrame:
        return df.select(F.col("id").alias(id_), F.col("print").alias(print_), F.inline(bands(F.col("print"), threshold, spare)))

    joined = keyed(prints, "i", "print").join(keyed(prints if other is None else other, "j", "jprint").hint("merge"), ["band", "bits"])
    if other is None:
        joined = joined.where("i < j")
    differ = F.col("print").bitwiseXOR(F.col("jprint"))
    return joined.where((F.bit_count(differ) <= threshold) & (first_band(differ, threshold, spare) == F.col("band"))).select("i", "j")


def deduplicate_texts(texts: Sequence[str], threshold: int = 3) -> list[str]:
    """Of texts in memory, those within the threshold of no kept earlier one. Tables have `check_simhash`."""
    kept, prints = [], np.zeros(0, dtype=np.uint64)
    for text, print_ in zip(texts, simhashes([normalize(t) for t in texts]).view(np.uint64)):
        if not len(prints) or np.bitwise_count(prints ^ print_).min() > threshold:
            kept.append(text)
            prints = np.append(prints, print_)
    return kept


class Blocks:
    """(id, v) rows in the shared folder, in files of at most `rows` rows of one width, which Python tasks read one at a time. Rows without an id or a vector are left out."""

    def __init__(self, vectors: DataFrame, rows: int):
        self.path = path = work_dir(vectors.sparkSession, "blocks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, held, count = TaskContext.get().partitionId(), {}, {}

            def block(w: int) -> pa.RecordBatch:
                ids, v = (np.concatenate(x) for x in zip(*held.pop(w)))
                count[w] = count.get(w, -1) + 1
                return pa.RecordBatch.from_arrays([pa.array([x]) for x in (f"{w}-{part}-{count[w]}", ids.tobytes(), v.tobytes())], names=["b", "ids", "v"])

            for b in batches:
                size = b.column(1).value_lengths().to_numpy()
                for w in np.unique(size).tolist():
                    some = b.filter(pa.array(size == w))
                    ids, v = some.column(0).to_numpy(), some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
                    at = 0
                    while at < len(ids):
                        room = rows - sum(len(x) for x, _ in held.get(w, ()))
                        held.setdefault(w, []).append((ids[at : at + room], v[at : at + room]))
                        at += room
                        if at <= len(ids):
                            yield block(w)
            for w in list(held):
                yield block(w)

        ready = vectors.select(F.col("id").cast("long").alias("id"), "v").where("id is not null and size(v) > 0")
        packed = ready.repartition(max(1, -(-ready.count() // rows))).mapInArrow(run, "b string, ids binary, v binary")
        packed.write.partitionBy("b").parquet(path)
        self.by_width: dict[int, list[str]] = {}
        for name in folders(vectors.sparkSession, path):
            self.by_width.setdefault(int(name[2:].split("-")[0]), []).append(name)

    def read(self, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and vectors of the k-th block of a width."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, at = file_system(f"{self.path}/{self.by_width[width][k]}")
        (info,) = (i for i in system.get_file_info(fs.FileSelector(at)) if i.base_name.startswith("part-"))
        with system.open_input_file(info.path) as f:
            t = pq.ParquetFile(f).read(columns=["ids", "v"])
        return np.frombuffer(t["ids"][0].as_py(), np.int64), np.frombuffer(t["v"][0].as_py()).reshape(-1, width)


def block_rows(n: int, width: int) -> int:
    """Rows of a block of n vectors: some blocks for parallel work on small tables, at most 32 MB."""
    return max(1, min(max(512, -(-n // 32)), 8192, (32 << 20) // (8 * max(width, 1))))


def _tasks(spark: SparkSession, tasks: Sequence[tuple], f: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The batches of f(*task), each in a Spark task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from f(*tasks[k])

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, schema)


def nearest_cosine(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(i, j, distance, rank): the k of vectors (id, v: unit length) at the least 1 - cosine from each query (id, v), itself left out.

    Exact. Both are written once to the shared folder in blocks; a task holds a block of queries, streams blocks of vectors past
    it and keeps the best k of each query; ties go to the smaller id. Nothing goes through the driver.
    """
    asked, held = Blocks(queries, block), Blocks(vectors, max(block, 8192) if block >= 1024 else block)
    tasks = []
    for w, names in asked.by_width.items():
        m = len(held.by_width.get(w, ()))
        stripes = min(m, max(1, -(-24 // len(names))))
        tasks += [(w, q, range(s, m, stripes)) for q in range(len(names)) for s in range(stripes)]
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("distance", pa.float64())])

    def best(row: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Places of the k least of each row, by distance and j."""
        order = np.lexsort((j, distance, row))
        row = row[order]
        return order[np.arange(len(row)) - np.searchsorted(row, row) < k]

    def run(w: int, q: int, some: range) -> Iterator[pa.RecordBatch]:
        i, x = asked.read(w, q)
        top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # row, j, distance
        for b in some:
            ids, v = held.read(w, b)
            tile = max(1, 2_000_000 // len(ids))
            for lo in range(0, len(i), tile):
                distance = np.round(np.abs(x[lo : lo + tile] @ v.T - 1), 9)  # equal vectors tie
                distance[(i[lo : lo + tile, None] == ids[None, :]) | np.isnan(distance)] = np.inf
                last = np.partition(distance, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                row, col = np.nonzero((distance <= last[:, None]) & np.isfinite(distance))
                few = best(row, ids[col], distance[row, col])
                top = tuple(np.concatenate([a, c]) for a, c in zip(top, (row[few] + lo, ids[col[few]], distance[row[few], col[few]])))
            top = tuple(a[few] for few in [best(*top)] for a in top)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i[top[0]], *top[1:])], schema=schema)

    found = _tasks(queries.sparkSession, tasks, run, "i long, j long, distance double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))).where(F.col("rank") <= k)


def unit(vector: Column) -> Column:
    """A vector over its length; null where that is zero or a component is null."""

    def run(column: pa.Array) -> pa.Array:
        flat, size = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
        x, ends = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size)
        some = size > 0
        total, lost = np.zeros(len(size)), np.zeros(len(size), dtype=np.int64)
        if some.any():
            with np.errstate(all="ignore"):
                total[some] = np.sqrt(np.add.reduceat(x * x, (ends - size)[some]))
            lost[some] = np.add.reduceat(flat.is_null().to_numpy(zero_copy_only=False).astype(np.int64), (ends - size)[some])
        null = (total == 0) | (lost > 0)
        with np.errstate(all="ignore"):
            x = x / np.repeat(total, size)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), type=pa.int32()), pa.array(x), mask=pa.array(null))

    return F.arrow_udf(run, returnType="array<double>")(vector.cast("array<double>"))


def embedding_pairs(vectors: DataFrame, threshold: float, width: int, other: DataFrame | None = None) -> DataFrame:
    """(i, j, distance) of vectors (id, v: unit length, `width` components) with 1 - cosine < threshold, i < j; with `other`, of a row and one of the other.

    Exact, and quadratic: all blocks of rows meet as matrix products of single precision, wide of the threshold by its error, and what
    these leave is decided in double precision. A task holds two blocks, which it reads from the shared folder.
    """
    rows = block_rows(vectors.count(), width)
    left = Blocks(vectors, rows)
    right = left if other is None else Blocks(other, rows)
    tasks, within = [], other is None
    for w, names in left.by_width.items():
        m = len(right.by_width.get(w, ()))
        # each block meets itself and the next half of the ring of blocks, so that all tasks have as much to do
        reach = m // 2 + 1 if within else m
        stripes = max(1, min(reach, -(-48 // len(names))))
        for a in range(len(names)):
            meets = list(range(m)) if not within else [(a + k) % m for k in range(reach) if 2 * k < m or a < m // 2]
            tasks += [(w, a, meets[s::stripes]) for s in range(stripes)]
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("distance", pa.float64())])

    def run(w: int, a: int, meets: Sequence[int]) -> Iterator[pa.RecordBatch]:
        i, x = left.read(w, a)
        low, error, step = x.astype(np.float32), 2e-7 * (w + 8), max(1, (16 << 20) // (8 * w))
        for b in meets:
            j, y = right.read(w, b)
            other_low, tile = y.astype(np.float32), max(1, 2_000_000 // len(j))
            for lo in range(0, len(i), tile):
                row, col = np.nonzero(low[lo : lo + tile] @ other_low.T > 1 - threshold - error)
                row += lo
                if within:
                    ok = i[row] < j[col] if a == b else i[row] != j[col]
                    row, col = row[ok], col[ok]
                for at in range(0, len(row), step):
                    r, c = row[at : at + step], col[at : at + step]
                    distance = np.abs(np.einsum("nd,nd->n", x[r], y[c]) - 1)
                    ok = distance < threshold
                    one, two = i[r[ok]], j[c[ok]]
                    if within:
                        one, two = np.minimum(one, two), np.maximum(one, two)
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (one, two, distance[ok])], schema=schema)

    return _tasks(vectors.sparkSession, tasks, run, "i long, j long, distance double")


def independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ids of nodes (id) in the first maximal independent set of edges (i < j), round by round; each round is written.

    A node without an undecided smaller neighbour stays, and its neighbours go.
    """
    left, gone = stash(edges.select("i", "j"), "edges"), None
    while not left.isEmpty():
        waiting = left.select(F.col("j").alias("id")).distinct()
        kept = left.select(F.col("i").alias("id")).distinct().join(waiting, "id", "left_anti")
        out = left.join(kept.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct()
        out = stash(out, "gone")
        gone = out if gone is None else gone.union(out)
        rest = left.join(out.withColumnRenamed("id", "i"), "i", "left_anti").join(out.withColumnRenamed("id", "j"), "j", "left_anti")
        left = stash(rest.select("i", "j"), "edges")
    return nodes if gone is None else nodes.join(gone.distinct(), "id", "left_anti")


def any_earlier(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ids of nodes that have no smaller neighbour at all, kept or not: one anti-join."""
    return nodes.join(edges.select(F.col("j").alias("id")).distinct(), "id", "left_anti")
