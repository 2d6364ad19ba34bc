"""Operator 3: token ids as canonical, length-limited Huffman code.

File format (little-endian), files of about FILE_IDS ids each, one after another in ascending doc_id order:
    b"MRH1", then blocks: u32 n_ids, u32 n_bytes, u32 n_marks, u32 bit offset of each mark, the code bytes.
    A mark stands at every MARK-th id, so that any stretch can be decoded alone; blocks are independent.
    Then the document table: doc_ids (i64; null is flagged), null flags (u8), n_ids (u32); last u64 n_docs, u64 byte offset of the table.
    The code itself is lengths.bin beside the files: one u8 length per id; canonical codes follow from it.

Nulls: a null text is empty and still gets its end id; a null doc_id sorts first. Repeated doc_ids stay, ordered by text hash.
Empty tables give no rows. Very long texts run through many blocks. Extra columns are not read.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import as_batch, file_system, pick, stash, tidied, work_dir

MAX_BITS, BLOCK, MARK, TOGETHER, FILE_IDS = 16, 1 << 16, 128, 16, 1 << 25
MAGIC = b"MRH1"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for the ids with a count (package-merge); 0 for the rest."""
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, row = [], leaf
    is_leaf = np.ones(n, dtype=bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, packed])
        by = np.argsort(both, kind="stable")
        row, is_leaf = both[by], by < n
    levels.append(is_leaf)
    take, got = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        got[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For each `limit`-bit window: id << 8 | its length."""
    table, codes = np.zeros(1 << limit, dtype=np.uint32), canonical(lengths)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        lo = int(codes[i]) << (limit - n)
        table[lo : lo + (1 << (limit - n))] = int(i) << 8 | n
    return table


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One block of the file format."""
    n_bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    at = ends - n_bits
    total = int(ends[-1]) if len(ids) else 0
    word, room = at >> 6, (64 - (at & 63)).astype(np.int64)
    value = codes[ids].astype(np.uint64)
    over = n_bits - room
    spills = over > 0
    high = np.where(spills, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros((total + 63) // 64 + 1, dtype=np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(high, first)
        out[word[spills] + 1] += value[spills] << (64 - over[spills]).astype(np.uint64)
    body = out.byteswap().tobytes()[: (total + 7) // 8]
    marks = at[::MARK].astype("<u4").tobytes()
    return struct.pack("<III", len(ids), len(body), len(marks) // 4) + marks + body


def decode_blocks(blocks: list[tuple[int, np.ndarray, bytes]], table: np.ndarray) -> np.ndarray:
    """Ids of (n_ids, marks, code bytes) blocks, all stretches between marks in step."""
    base, starts, counts, parts = 0, [], [], []
    for n, marks, body in blocks:
        starts.append(marks.astype(np.int64) + base * 8)
        c = np.full(len(marks), MARK, dtype=np.int64)
        if len(marks):
            c[-1] = n - MARK * (len(marks) - 1)
        counts.append(c)
        parts.append(body)
        base += len(body)
    raw = np.frombuffer(b"".join(parts) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    p, left = np.concatenate(starts), np.concatenate(counts)
    out = np.empty((len(p), MARK), dtype=np.uint16)
    last = len(window) - 1
    for k in range(MARK):
        at = np.minimum(p >> 3, last)
        got = table[(window[at] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
        out[:, k] = got >> np.uint32(8)
        p += got & np.uint32(255)
    return out[np.arange(MARK)[None, :] < left[:, None]]


@contextmanager
def _writing(path: str) -> Iterator:
    """A stream written beside its place and moved there when it is whole, so that a retried or doubled task leaves one whole file."""
    system, at = file_system(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        yield f
    try:
        system.move(own, at)
    except OSError:  # some file systems don't move onto a file that is there
        system.delete_file(at)
        system.move(own, at)


def _read(path: str) -> bytes:
    """A whole file; files are bounded by FILE_IDS."""
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        return f.read()


def _tokenize(path: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS):
    """From sorted (doc_id, text): raw files of ids and documents, and rows of their names and of the task's counts by id.

    A file ends with the document that fills it to `file_ids` ids; what a task holds is one document and one buffer of ids.
    """
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import encoder

        first, tok, end = TaskContext.get().partitionId() << 24, encoder(tokenizer), int(end_id).to_bytes(2, "little")
        codec, total, made = pa.Codec("zstd", compression_level=3), np.zeros(1 << 16, dtype=np.int64), []
        docs = ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

        def file(doc: tuple) -> tuple | None:
            """One raw file that begins with doc; returns the document after it."""
            shard, ids_of, nulls, sizes, wait, waiting = first + len(made), [], [], [], [], 0
            name = f"{path}/raw/{shard:012d}"
            with _writing(name) as out:

                def flush() -> None:
                    raw = b"".join(wait)
                    total[:] += np.bincount(np.frombuffer(raw, "<u2"), minlength=1 << 16)
                    packed = codec.compress(raw, asbytes=True)
                    out.write(struct.pack("<II", len(raw), len(packed)) + packed)
                    wait.clear()

                while doc is not None and sum_of[0] < file_ids:
                    ids = tok(doc[1]) + end
                    for p in range(0, len(ids), 2 * TOGETHER * BLOCK):
                        wait.append(ids[p : p + 2 * TOGETHER * BLOCK])
                        waiting += len(wait[-1]) // 2
                        if waiting >= TOGETHER * BLOCK:
                            flush()
                            waiting = 0
                    ids_of.append(doc[0] or 0)
                    nulls.append(doc[0] is None)
                    sizes.append(len(ids) // 2)
                    sum_of[0] += sizes[-1]
                    doc = next(docs, None)
                flush()
                at = out.tell()
                out.write(np.array(ids_of, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(sizes, "<u4").tobytes() + struct.pack("<QQ", len(ids_of), at))
            made.append((shard, name, len(ids_of), sum_of[0]))
            sum_of[0] = 0
            return doc

        sum_of, doc = [0], next(docs, None)
        while doc is not None:
            doc = file(doc)
        if not made:
            return
        none = [None] * len(made)
        yield as_batch(schema, **{c: [m[k] for m in made] for k, c in enumerate(("shard", "path", "n_docs", "n_ids"))}, id=none, n=none)
        some = np.flatnonzero(total)
        none = [None] * len(some)
        yield as_batch(schema, shard=none, path=none, n_docs=none, n_ids=none, id=some.astype(np.int32), n=total[some])

    return run


def _encode(path: str, lengths: np.ndarray):
    """From names of raw files: the coded files and their names."""
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, codes = pa.Codec("zstd"), canonical(lengths)
        for b in batches:
            for shard, name, n_docs, n_ids in zip(*(c.to_pylist() for c in b.columns)):
                raw, rest, p = _read(name), np.zeros(0, "<u2"), 0
                at = struct.unpack("<QQ", raw[-16:])[1]
                final = f"{path}/ids-{shard:012d}.mrh"
                with _writing(final) as out:
                    out.write(MAGIC)
                    while p < at:
                        size, packed = struct.unpack_from("<II", raw, p)
                        ids = np.concatenate([rest, np.frombuffer(codec.decompress(raw[p + 8 : p + 8 + packed], size), "<u2")])
                        p += 8 + packed
                        stop = len(ids) if p >= at else len(ids) // BLOCK * BLOCK
                        for i in range(0, stop, BLOCK):
                            out.write(encode_block(ids[i : min(i + BLOCK, stop)], lengths, codes))
                        rest = ids[stop:]
                    table_at = out.tell()
                    out.write(raw[at:-8] + struct.pack("<Q", table_at))
                yield as_batch(schema, shard=[shard], path=[final], n_docs=[n_docs], n_ids=[n_ids])

    return run


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode documents (doc_id, text) into files under `path`; returns one row per file: shard, path, n_docs, n_ids.

    Texts are moved and encoded once: tasks over ranges of doc_id leave their ids in raw files, global counts give the
    code, and the raw files are coded. The driver gets one row per id in use (at most 65,536) and one per file.
    """
    spark = documents.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = pick(documents, "doc_id", "text").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    made = stash(rows.mapInArrow(tidied(_tokenize(path, tokenizer, end_id, file_ids)), "shard long, path string, n_docs long, n_ids long, id int, n long"), "counts")
    some = made.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[some["id"].to_numpy()] = some["n"].to_numpy()
    lengths = code_lengths(counts)
    with _writing(f"{path}/lengths.bin") as f:
        f.write(lengths.tobytes())
    raw = made.where("path is not null").select("shard", "path", "n_docs", "n_ids").toArrow()
    if not raw.num_rows:
        return spark.createDataFrame([], "shard long, path string, n_docs long, n_ids long")
    spread = spark.createDataFrame(raw).coalesce(1).repartition(raw.num_rows)  # in turn: a task has one file
    files = spread.mapInArrow(tidied(_encode(path, lengths)), "shard long, path string, n_docs long, n_ids long").toArrow()
    system, at = file_system(f"{path}/raw")
    system.delete_dir(at)
    return spark.createDataFrame(files)


def read_ids(files: DataFrame, path: str) -> DataFrame:
    """Decode the files of write_ids: doc_id, start, n_tokens, ids_crc32 of each document; ids are streamed, not returned."""
    spark = files.sparkSession
    rows = sorted(files.toArrow().to_pylist(), key=lambda r: r["shard"])  # one row per file
    start, placed = 0, []
    for r in rows:
        placed.append((r["path"], start))
        start += r["n_ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not placed:
        return spark.createDataFrame([], ddl)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            for name, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if table is None:
                    table = decode_table(np.frombuffer(_read(f"{path}/lengths.bin"), np.uint8))
                raw = _read(name)
                n_docs, at = struct.unpack("<QQ", raw[-16:])
                docs = np.frombuffer(raw, "<i8", n_docs, at)
                nulls = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs).astype(bool)
                sizes = np.frombuffer(raw, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
                ends, crcs = np.cumsum(sizes), np.zeros(n_docs, dtype=np.int64)
                doc, done, crc = 0, 0, 0
                for ids in _stretches(raw, at, table):
                    buf, p = ids.astype("<u4").tobytes(), 0
                    while p < len(ids):
                        q = min(len(ids), int(ends[doc]) - done)
                        crc = zlib.crc32(memoryview(buf)[4 * p : 4 * q], crc)
                        if done + q == ends[doc]:
                            crcs[doc], crc, doc = crc, 0, doc + 1
                        p = q
                    done += len(ids)
                yield as_batch(schema, doc_id=pa.array(docs, mask=nulls), start=begin + ends - sizes, n_tokens=sizes, ids_crc32=crcs)

    spots = spark.createDataFrame(placed, "path string, start long").coalesce(1).repartition(len(placed))
    return spots.mapInArrow(tidied(decode), ddl)


def _stretches(raw: bytes, stop: int, table: np.ndarray) -> Iterator[np.ndarray]:
    """The decoded ids of a file, some blocks at a time."""
    if raw[:4] != MAGIC:
        raise ValueError("not a file of this format")
    p, group = 4, []
    while p < stop:
        n, n_bytes, n_marks = struct.unpack_from("<III", raw, p)
        marks = np.frombuffer(raw, "<u4", n_marks, p + 12)
        p += 12 + 4 * n_marks
        group.append((n, marks, raw[p : p + n_bytes]))
        p += n_bytes
        if len(group) == TOGETHER or p >= stop:
            yield decode_blocks(group, table)
            group = []


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._run import table

    documents, path = table(spark, sf_dir, "documents"), work_dir(spark, "op3")
    return read_ids(write_ids(documents, path, public_tokenizers.path("word_bpe_49k.json")), path)
