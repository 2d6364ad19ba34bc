"""Operator 7: hierarchical multi-length packing.

Documents are routed to context tiers by length; each tier's windows are packed longest first, their gaps are
filled from shorter tiers (whole documents that fit best, then one that is cut), and sequences are dealt to
step groups of about equal tokens. Every window comes out exactly full; what is left over at the end of a
buffer is laid into windows of falling powers of two. So nothing is padded.

A task packs what it reads, in buffers of `buffer_tokens`: there is no shuffle, and memory doesn't follow the input.
Nulls: a null text counts as empty (its end id only); a null doc_id stays null. Repeated rows are packed each.
Empty tables give no rows. Texts of any length are cut at window ends. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._run import as_batch, pick, table, tidied

SIZES = (256, 512, 1024, 2048)


class _Shelf:
    """Rests of documents by length, the longest of at most g tokens found at once."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def put(self, n: int, doc: int, start: int) -> None:
        self.by.setdefault(n, []).append((doc, start))
        self.mask |= 1 << n

    def take(self, n: int) -> tuple[int, int]:
        rests = self.by[n]
        got = rests.pop()
        if not rests:
            self.mask &= ~(1 << n)
        return got

    def longest(self, most: int) -> int:
        """The greatest length of at most `most`, or 0."""
        return max((self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)


def pack_lengths(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); their totals are sizes[-1], other sizes, or smaller powers of two."""
    top, shelf, out = sizes[-1], _Shelf(), []
    for d, n in enumerate(lengths):
        whole = n // top * top
        out.extend([(d, s, top)] for s in range(0, whole, top))
        if n > whole:
            shelf.put(n - whole, d, whole)
    for size, floor in zip(reversed(sizes), [*reversed(sizes[:-1]), 0]):
        while (n := shelf.longest(size)) > floor:
            d, s = shelf.take(n)
            window, room = [(d, s, n)], size - n
            while room and shelf.mask:
                if n := shelf.longest(room):
                    d, s = shelf.take(n)
                    window.append((d, s, n))
                    room -= n
                else:  # all rests are longer: the shortest one is cut
                    n = (shelf.mask & -shelf.mask).bit_length() - 1
                    d, s = shelf.take(n)
                    window.append((d, s, room))
                    shelf.put(n - room, d, s + room)
                    room = 0
            if room:
                out.extend(_halves(window))
            else:
                out.append(window)
    return out


def _halves(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that can't be filled, as windows of the powers of two that make up its length."""
    left, out, rest = sum(n for _, _, n in window), [], list(reversed(window))
    while left:
        room, part = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            d, s, n = rest.pop()
            part.append((d, s, min(n, room)))
            if n > room:
                rest.append((d, s + room, n - room))
            room -= part[-1][2]
        out.append(part)
    return out


def step_groups(totals: np.ndarray, step_tokens: int) -> np.ndarray:
    """Groups of about equal tokens: sequences by falling length, dealt forth and back."""
    groups = max(1, -(-int(totals.sum()) // step_tokens))
    order = np.argsort(-totals, kind="stable")
    turn = np.arange(len(totals))
    place = np.where(turn // groups % 2 == 0, turn % groups, groups - 1 - turn % groups)
    out = np.empty(len(totals), dtype=np.int64)
    out[order] = place
    return out


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, sizes: tuple[int, ...] = SIZES, buffer_tokens: int = 2_000_000, step_tokens: int = 1 << 19, with_ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences; with_ids adds each piece's token ids."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"
    schema = pa.schema([(x.split()[0], pa.int64()) for x in fields.split(", ")] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import encoder

        tok, end = encoder(tokenizer, limit=250_000), int(end_id).to_bytes(2, "little")
        base = TaskContext.get().partitionId() << 36
        seen = steps = 0

        def flush(docs: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal seen, steps
            lengths = [len(x) // 2 for x in ids]
            wide = [np.frombuffer(x, "<u2").astype("<u4") for x in ids]
            sequences = pack_lengths(lengths, sizes)
            totals = np.array([sum(n for _, _, n in s) for s in sequences], dtype=np.int64)
            groups = step_groups(totals, step_tokens)
            cols: dict[str, list] = {f.name: [] for f in schema}
            for k, s in enumerate(sequences):
                offset = 0
                for d, start, n in s:
                    cols["doc_id"].append(docs[d])
                    cols["start"].append(start)
                    cols["length"].append(n)
                    cols["ids_crc32"].append(zlib.crc32(wide[d][start : start + n]))
                    cols["doc_tokens"].append(lengths[d])
                    cols["sequence_id"].append(base + seen + k)
                    cols["offset"].append(offset)
                    cols["sequence_tokens"].append(int(totals[k]))
                    cols["step_group"].append(base + steps + int(groups[k]))
                    if with_ids:
                        cols["ids"].append(wide[d][start : start + n].astype(np.int32))
                    offset += n
            seen += len(sequences)
            steps += int(groups.max()) + 1
            return as_batch(schema, **cols)

        docs, ids, tokens = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(doc_id)
                ids.append(tok(text) + end)
                tokens += len(ids[-1]) // 2
                if tokens >= buffer_tokens:
                    yield flush(docs, ids)
                    docs, ids, tokens = [], [], 0
        if docs:
            yield flush(docs, ids)
        tok.parts.clear()  # other stages of a pipeline share the worker

    return pick(documents, "doc_id", "text").mapInArrow(tidied(run), fields + ", ids array<int>" * with_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
