"""Operator 8: approximate nearest neighbours by a navigable small-world graph per shard.

Equal vectors are one node, which has the smallest k + 1 of their ids (enough for any query, itself left out): copies
neither fill links or beams nor hide ties, which go to the smallest ids of all copies. Nodes are dealt to shards by a
hash of the vector. Each shard's hierarchical graph is built in batches by vectorised
beam search and kept as flat neighbour arrays; every query searches every shard, the best of each shard are scored
again in double precision on the original vectors, and shard results are merged. For inner products, vectors
get one more component that brings all to one length, so that the graph lives in a metric space; before that they
are scaled by a power of two, so that neither tiny nor huge vectors lose their lengths.

How many shards there are follows from the vectors alone, never from the cluster: at most `SHARD_ROWS` rows and `SHARD_BYTES`
bytes each, so that recall at `EF_SEARCH` is the same at any size. All vectors are indexed. Queries are written
once to the shared folder, and each shard's task streams them from there in blocks; they aren't multiplied by a shuffle.

Nulls: vectors that are null, zero, or hold null or non-finite components take no part, nor do those without an id.
Vectors of several widths have no product with each other: a query's candidates are those of its own width.
Repeated ids are candidates each (but not for a query of the same id); a repeated query with its vector asks once; ties go to the smaller vec_id.
Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._run import as_batch, file_system, pick, stash, table, tidied, work_dir

K, EVERY, M, EF_BUILD, EF_SEARCH, SHARD_ROWS, SHARD_BYTES, LEAST_ROWS, SPREAD = 20, 20, 24, 64, 200, 8192, 128 << 20, 1024, 8


class Graph:
    """A small-world hierarchy over unit-length rows x (float32): levels of (members, neighbour array with -1 for none)."""

    def __init__(self, x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7):
        self.x, self.m, self.ef = x, m, ef
        n = len(x)
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 6)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(int(levels.max(initial=0)) + 1):
            members = np.flatnonzero(levels >= level).astype(np.int32)
            self.levels.append((members, np.full((len(members), 2 * m if level == 0 else m), -1, dtype=np.int32)))
        for level in range(len(self.levels) - 1, -1, -1):
            self._build(level)

    def _start(self, q: np.ndarray, level: int) -> np.ndarray:
        """Rows of `level` near each query, by greedy descent from the top."""
        at = np.zeros(len(q), dtype=np.int64)
        for upper in range(len(self.levels) - 1, level, -1):
            ids, _ = self._beam(q, upper, at[:, None], 1)
            here = self.levels[upper][0][ids[:, 0]]
            at = np.searchsorted(self.levels[upper - 1][0], here)
        return at

    def _beam(self, q: np.ndarray, level: int, start: np.ndarray, ef: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places in the level, similarities) of the ef best found for each query, best first; -1 and -inf fill up."""
        members, links = self.levels[level]
        n, width = len(q), links.shape[1]
        vectors = self.x if level == 0 else self.x[members]
        seen = np.zeros((n, len(members) if limit is None else limit), dtype=bool)
        rows = np.arange(n)[:, None]
        ids = np.full((n, ef), -1, dtype=np.int64)
        sims = np.full((n, ef), -np.inf, dtype=np.float32)
        todo = np.zeros((n, ef), dtype=bool)
        k = start.shape[1]
        ids[:, :k], sims[:, :k], todo[:, :k] = start, np.einsum("nd,nkd->nk", q, vectors[start]), True
        seen[rows, start] = True
        step = max(4, ef // 8) if ef >= 16 else 1
        while True:
            score = np.where(todo, sims, -np.inf)
            active = np.flatnonzero(score.max(axis=1) > -np.inf)
            if not len(active):
                break
            part = score[active]
            pick_ = np.argpartition(-part, step - 1, axis=1)[:, :step] if step < ef else np.argsort(-part, axis=1)[:, :step]
            good = np.take_along_axis(part, pick_, axis=1) > -np.inf
            todo[active[:, None], pick_] = False
            near = links[np.where(good, ids[active[:, None], pick_], 0)]
            near = np.where(good[:, :, None], near, -1).reshape(len(active), step * width).astype(np.int64)
            near[seen[active[:, None], np.maximum(near, 0)]] = -1
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            some = near >= 0
            seen[np.broadcast_to(active[:, None], near.shape)[some], near[some]] = True
            new = np.full(near.shape, -np.inf, dtype=np.float32)
            r, c = np.nonzero(some)
            new[r, c] = np.einsum("ij,ij->i", q[active[r]], vectors[near[r, c]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], new], axis=1)
            all_todo = np.concatenate([todo[active], some], axis=1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[active] = np.take_along_axis(all_ids, best, axis=1)
            sims[active] = np.take_along_axis(all_sims, best, axis=1)
            todo[active] = np.take_along_axis(all_todo, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _choose(self, near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (best first), those nearer to the row than to a chosen one; then the nearest of the rest."""
        n, c = near.shape
        v = vectors[np.maximum(near, 0)]
        cross = np.einsum("nid,njd->nij", v, v)
        taken, count = np.zeros((n, c), dtype=bool), np.zeros(n, dtype=int)
        for j in range(c):
            shaded = (taken[:, :j] & (cross[:, j, :j] > sims[:, j : j + 1])).any(axis=1)
            ok = (near[:, j] >= 0) & ~shaded & (count < most)
            taken[:, j] = ok
            count += ok
        rank = np.where(near < 0, 2, np.where(taken, 0, 1)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(near, order, axis=1)

    def _build(self, level: int) -> None:
        members, links = self.levels[level]
        n, width = links.shape
        vectors = self.x if level == 0 else self.x[members]
        done = 0
        while done < n:
            if done <= width:  # the first few are linked to each other
                size = min(width + 1, n)
                sims = vectors[:size] @ vectors[:size].T
                np.fill_diagonal(sims, -np.inf)
                order = np.argsort(-sims, axis=1)[:, : size - 1]
                links[:size, : size - 1] = order
                done = size
                continue
            size = min(n - done, max(16, done // 2), max(16, 64_000_000 // (n + 1)), 256)
            new = np.arange(done, done + size)
            q = vectors[new]
            start = np.minimum(self._start(q, level), done - 1) if level + 1 < len(self.levels) else np.zeros(size, dtype=np.int64)
            ids, sims = self._beam(q, level, start[:, None], min(self.ef, done))
            within = q @ q.T  # the batch also sees itself
            within[np.arange(size)[:, None] <= np.arange(size)[None, :]] = -np.inf
            top = np.argsort(-within, axis=1)[:, : min(8, size)]
            ids = np.concatenate([ids, np.where(np.take_along_axis(within, top, axis=1) > -np.inf, new[top], -1)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(within, top, axis=1)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = self._choose(ids, sims, vectors, self.m)
            links[new, : chosen.shape[1]] = chosen
            self._back(links, vectors, np.repeat(new, chosen.shape[1]), chosen.ravel())
            done += size

    def _back(self, links: np.ndarray, vectors: np.ndarray, new: np.ndarray, old: np.ndarray) -> None:
        """Links from the old rows back to the new ones; full rows keep the best choice."""
        ok = old >= 0
        new, old = new[ok], old[ok]
        by = np.argsort(old, kind="stable")
        new, old = new[by], old[by]
        rows, first, counts = np.unique(old, return_index=True, return_counts=True)
        extra = np.full((len(rows), int(counts.max(initial=0))), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(rows)), counts), np.arange(len(old)) - np.repeat(first, counts)] = new
        both = np.concatenate([links[rows].astype(np.int64), extra], axis=1)
        width = links.shape[1]
        full = (both >= 0).sum(axis=1) > width
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        links[rows[~full]] = packed[~full][:, :width]
        if full.any():
            r, cand = rows[full], packed[full]
            sims = np.where(cand >= 0, np.einsum("nd,nkd->nk", vectors[r], vectors[np.maximum(cand, 0)]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
            links[r] = self._choose(np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1), vectors, width)

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Rows of the k nearest found for each query, -1 for none."""
        if not len(self.x):
            return np.full((len(q), k), -1)
        ef = min(max(ef, k), len(self.x))
        start = self._start(q, 0)
        return self._beam(q, 0, start[:, None], ef)[0][:, :k]

    def to_bytes(self) -> bytes:
        """x and all levels as flat arrays."""
        import io

        out = io.BytesIO()
        np.savez(out, x=self.x, **{f"{name}{k}": a for k, pair in enumerate(self.levels) for name, a in zip(("members", "links"), pair)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Graph:
        import io

        got, self = np.load(io.BytesIO(raw)), cls.__new__(cls)
        self.x, self.levels = got["x"], []
        self.m, self.ef = M, EF_BUILD
        while f"members{len(self.levels)}" in got:
            self.levels.append((got[f"members{len(self.levels)}"], got[f"links{len(self.levels)}"]))
        return self


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    rows = pick(vectors, id_col, vector).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def shards_for(n: int, width: int) -> int:
    """Shards for n distinct vectors of a width: small enough for recall and memory, and some for parallel work on small tables."""
    rows = max(1, min(SHARD_ROWS, SHARD_BYTES // (12 * width + 8 * M + 64)))
    return max(-(-n // rows), min(SPREAD, -(-n // LEAST_ROWS)))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def distinct(rows: DataFrame, k: int = K) -> DataFrame:
    """(v, ids) of the distinct vectors of rows: the smallest k + 1 ids, ascending, each up to k times if it is repeated."""
    v = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0.0 is 0.0
    copies = rows.select("vec_id", v.alias("v")).select("vec_id", "v", F.xxhash64("v").alias("h")).groupBy("h", "v", "vec_id").agg(F.count("*").alias("c"))
    first = copies.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = F.sort_array(F.collect_list(F.struct("vec_id", F.least("c", F.lit(k)).cast("int").alias("c"))))
    return first.groupBy("h", "v").agg(ids.alias("ids")).select("v", F.flatten(F.transform("ids", lambda x: F.array_repeat(x["vec_id"], x["c"]))).alias("ids"))


def build(nodes: DataFrame, plan: DataFrame, shards: int) -> DataFrame:
    """One row per shard that has nodes (v, ids): shard, width, ids of all nodes, where each node's end, vectors (doubles) and graph, as binaries.

    plan: per width w its first shard, how many it has, and the power of two that scales its vectors to length 1 at most.
    """
    schema = pa.schema([("shard", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("vectors", pa.binary()), ("graph", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            s, scale = b.column(0).to_numpy(), b.column(1).to_numpy()
            for shard in np.unique(s):
                part = b.filter(pa.array(s == shard))
                held.setdefault(int(shard), []).append((part.column(2), _matrix(part.column(3)), int(scale[s == shard][0])))
        for shard in sorted(held):
            parts = held.pop(shard)
            ids, v = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            flat, ends = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy()).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            by = np.lexsort((*v.T[::-1][:1], flat[starts]))
            v, sizes = v[by], (ends - starts)[by]
            flat, ends = flat[_spans(starts[by], sizes)], np.cumsum(sizes)
            x = np.ldexp(v, parts[0][2])
            x = np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))[:, None]], axis=1).astype(np.float32)
            yield as_batch(schema, shard=[shard], width=[v.shape[1]], ids=[flat.tobytes()], ends=[ends.tobytes()], vectors=[v.tobytes()], graph=[Graph(x).to_bytes()])

    dealt = nodes.join(plan, F.size("v") == plan["w"]).select((F.col("first") + F.pmod(F.xxhash64("v"), F.col("shards"))).cast("int").alias("shard"), "scale", "ids", "v")
    return dealt.repartitionById(shards, "shard").mapInArrow(tidied(run), "shard int, width int, ids binary, ends binary, vectors binary, graph binary")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0] .. starts[0] + sizes[0] - 1, then those of the next span, and so on."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def search(index: DataFrame, queries: DataFrame, shards: int, k: int = K, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query (query_id, v) by inner product.

    Queries are written to the shared folder by width; the task of a shard reads those of its width, block by block.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    path = work_dir(queries.sparkSession, "queries")
    queries.withColumn("w", F.size("v")).write.partitionBy("w").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                width = b.column(1)[r].as_py()
                ids, ends = (np.frombuffer(b.column(c)[r].as_buffer(), np.int64) for c in (2, 3))
                held = ids, ends, np.frombuffer(b.column(4)[r].as_buffer()).reshape(len(ends), -1), Graph.from_bytes(b.column(5)[r].as_py())
                for part in _stream(f"{path}/w={width}"):
                    yield from answer(part, held)

    def answer(part: pa.RecordBatch, held: tuple) -> Iterator[pa.RecordBatch]:
        ids, ends, vectors, graph = held
        block = max(16, min(512, 64_000_000 // (len(ends) + 1)))
        for lo in range(0, part.num_rows, block):
            qid, q = part.column(0).slice(lo, block).to_numpy(), _matrix(part.column(1).slice(lo, block))
            unit = q / np.abs(q).max(axis=1, keepdims=True)
            unit = np.concatenate([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)
            found = graph.search(unit.astype(np.float32), 2 * k + 1, ef)
            with np.errstate(all="ignore"):
                score = np.einsum("nd,nkd->nk", q, vectors[np.maximum(found, 0)])
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            starts = np.where(node > 0, ends[node - 1], 0)
            sizes = ends[node] - starts
            near, score, row = ids[_spans(starts, sizes)], np.repeat(score[row, col], sizes), np.repeat(row, sizes)
            other = near != qid[row]
            near, score, row = near[other], score[other], row[other]
            order = np.lexsort((near, -score, row))
            near, score, row = near[order], score[order], row[order]
            ok = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield as_batch(schema, query_id=qid[row[ok]], vec_id=near[ok], score=score[ok])

    found = index.repartitionById(shards, "shard").mapInArrow(tidied(run), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _stream(folder: str) -> Iterator[pa.RecordBatch]:
    """(query_id, v) of the files of a folder, a block at a time; none if there is no such folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = file_system(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda i: i.path):
        if info.type == fs.FileType.File and info.base_name.startswith("part-"):
            with system.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(4096, columns=["query_id", "v"])


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The k nearest others of each vector whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    nodes = stash(distinct(rows, k), "vectors")
    top = F.max(F.array_max(F.transform("v", F.abs)))
    longest = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    plan, first = [], 0
    for r in nodes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), top.alias("top"), longest.alias("longest")).orderBy("w").collect():  # one row per width
        n = shards_for(r.n, r.w)
        size = r.longest if 1e-150 < r.longest < 1e150 else r.top * r.w**0.5  # squares beyond these ends lose digits
        plan.append((r.w, first, n, -math.frexp(min(size, 1e308))[1]))
        first += n
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = stash(build(nodes, spark.createDataFrame(plan, "w int, first int, shards int, scale int"), first), "index")
    return search(index, rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct(), first, k)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
