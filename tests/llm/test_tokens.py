import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import huffman, packing
from millrace.llm._tokens import encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "\n", "a  b\n\nc \n d\t e", "İstanbul ΣΑΣ ﬁ é é 日本語 x\xa0y", "<|endoftext|> hi <|startoftext|>", "  lead trail  ", "it's we'll 12 3²½ $$$ --", "\x1c\x1da\x85b\xad", "🙂🙂 a‍b", "a\0b c", "x y\n" * 50, "Z" * 3000]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path, spark, sf):
    e = encoder(path)
    for t in HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]:
        assert np.frombuffer(e(t), "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


@settings(deadline=None)
@given(st.text(max_size=40), st.text(alphabet="ab'sé \n.1", max_size=40))
def test_ids_of_any_text(a, b):
    for path in (WORD, BYTE):
        e = encoder(path)
        for t in (a, b, a + " " + b):
            assert np.frombuffer(e(t), "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_small_memory_gives_the_same_ids():
    e = encoder(BYTE, limit=3)
    assert e("one two three four five one") == encoder(BYTE)("one two three four five one")
    encoder(BYTE)


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(6, 16))
def test_code_lengths(counts, limit):
    c = np.array(counts)
    n = huffman.code_lengths(c, limit)
    used = c > 0
    assert (n[~used] == 0).all() and (n <= limit).all()
    if used.sum() > 1:
        assert (n[used] > 0).all() and sum(2.0 ** -int(x) for x in n[used]) == 1.0
    # the cost without a limit is that of Huffman's own merges
    import heapq

    heap, cost = [int(x) for x in c[used]], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    if used.sum() > 1:
        mine = int((huffman.code_lengths(c, 16)[used].astype(int) * c[used]).sum())
        assert mine >= cost and (max(huffman.code_lengths(c, 16)) == 16 or mine == cost)


@given(st.lists(st.integers(0, 300), max_size=700), st.integers(0, 3))
def test_blocks_round_trip(ids, seed):
    ids = np.array(ids + [5, 6], dtype=np.uint16)
    counts = np.bincount(ids, minlength=400)
    n = huffman.code_lengths(counts)
    raw = huffman.encode_block(ids, n, huffman.canonical(n))
    got = np.concatenate(list(huffman._stretches(huffman.MAGIC + raw + raw, 4 + 2 * len(raw), huffman.decode_table(n))))
    assert np.array_equal(got, np.concatenate([ids, ids]))


def expected(texts, path):
    e = encoder(path).tokenizer
    return [e.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in huffman.op3_token_files(spark, sf).collect()}
    start = 0
    for d, ids in zip(docs, expected([d.text for d in docs], WORD)):
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_file_cases(spark, tmp_path):
    data = [(3, None, 1), (1, "b b", 2), (1, "b b", 2), (None, "", 3), (2, "long word " * 40_000, 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, start long")
    files = huffman.write_ids(docs, f"file://{tmp_path}/x", WORD, partitions=3)
    got = sorted(huffman.read_ids(files, f"file://{tmp_path}/x").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3] and [r.n_tokens for r in got] == [1, 3, 3, 80_001, 1]
    assert [r.start for r in got] == [0, 1, 4, 7, 80_008]
    files = huffman.write_ids(docs.limit(0), f"file://{tmp_path}/y", WORD)
    assert huffman.read_ids(files, f"file://{tmp_path}/y").count() == 0


def check_pieces(pieces, docs):
    by, seq = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seq.setdefault(p.sequence_id, []).append(p)
    for d, ids in docs.items():
        at = 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048 and at & (at - 1) == 0


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_pieces(packing.op7_packing(spark, sf).collect(), {d.doc_id: ids for d, ids in zip(docs, expected([d.text for d in docs], BYTE))})


@given(st.lists(st.integers(1, 5000), max_size=60))
def test_pack_lengths(lengths):
    seen = [[] for _ in lengths]
    for s in packing.pack_lengths(lengths):
        total = sum(n for _, _, n in s)
        assert total <= 2048 and total & (total - 1) == 0
        for d, start, n in s:
            seen[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[d]):
            assert start == at
            at += m
        assert at == n


@given(st.lists(st.integers(1, 2048), min_size=1, max_size=300))
def test_step_groups(totals):
    g = packing.step_groups(np.array(totals), 20_000)
    sums = np.bincount(g, weights=totals)
    assert sums.max() - sums.min() <= 2 * 2048


def test_packing_cases(spark):
    data = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "w " * 30_000, 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, length long")
    got = packing.pack(docs, BYTE, with_ids=True, buffer_tokens=1000).collect()
    assert sum(p.length for p in got) == 3 + len(expected(["w " * 30_000], BYTE)[0]) and all(len(p.ids) == p.length for p in got)
    assert packing.pack(docs.limit(0), BYTE).count() == 0
