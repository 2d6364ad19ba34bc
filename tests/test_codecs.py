import numpy as np
import pytest

from millrace.functions import codecs, text
from millrace.operators import dedup, generate


def test_blobs():
    v = [0.5, -2.0, 1e-3]
    assert np.allclose(codecs.from_blob(codecs.to_blob(v)), v) and len(codecs.to_blob(v, half=True)) == 6
    assert codecs.from_blob(codecs.to_blob(v, half=True), half=True)[:2] == v[:2]
    assert np.allclose(codecs.mean_pool([[3, 0], [3, 8]]), [0.6, 0.8]) and codecs.mean_pool([[0, 0]]) == [0, 0]
    assert codecs.decode(codecs.encode({"a": ["ż", None]})) == {"a": ["ż", None]}
    assert len(codecs.generate_token(20)) == 20 and codecs.env_or("NOT_SET_ANYWHERE", "x") == "x" and len(codecs.random_base64(3)) == 4


def test_simhashes_by_hand():
    import hashlib

    def slow(t):
        votes = [0] * 64
        for w in t.split(" "):
            if w:
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8])
                votes = [v + (1 if h >> (63 - k) & 1 else -1) for k, v in enumerate(votes)]
        n = sum(1 << (63 - k) for k, v in enumerate(votes) if v > 0)
        return n - (1 << 64) if n >> 63 else n

    texts = ["", None, "a", "a a  b", "one two three " * 40_000, "c", *[" ".join(f"w{i * k % 97}" for i in range(k)) for k in range(1, 300, 7)]]
    assert text.simhashes(texts).tolist() == [0, 0, *[slow(t) for t in texts[2:]]]


@pytest.mark.parametrize("spare", [1, 2, 3])
def test_bands_lose_no_pair(spark, spare):
    rng = np.random.default_rng(spare)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    prints = [(k, int(np.int64(base[k % 12]) ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(63, k % 5, replace=False).astype(np.int64), initial=0))) for k in range(120)]
    df = spark.createDataFrame(prints, "id long, print long")
    want = {(i, j) for i, a in prints for j, b in prints if i < j and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert {(r.i, r.j) for r in dedup.simhash_pairs(df, 3, spare=spare).collect()} == want


def test_nearest_cosine(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v[40:] = v[:20]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in dedup.nearest_cosine(df.where("id < 50"), df, 4, block=7).collect():
        got.setdefault(r.i, {})[r["rank"]] = r.j
    d = np.round(np.abs(v @ v.T - 1), 9)
    for i in range(50):
        d[i, i] = np.inf
        assert [got[i][k] for k in (1, 2, 3, 4)] == np.lexsort((np.arange(60), d[i]))[:4].tolist()


def test_deduplicate_texts():
    texts = ["Hello there, you", "hello   there, you", "quite another thing to say", "Quite another thing to say"]
    assert dedup.deduplicate_texts(texts, 3) == [texts[0], texts[2]] and dedup.deduplicate_texts([], 3) == []


@pytest.mark.parametrize("kind", ["conversation", "conversation_lite", "tools_calling", "tools_calling_lite"])
@pytest.mark.parametrize("language", ["en", "pl", "xx"])
def test_judge_prompts(kind, language):
    got = generate.judge_prompt(kind, language, [{"role": "user", "content": "Cześć {x}"}], [{"name": "f"}])
    assert all(name in got for name in generate.judge_schema(kind)["properties"]) and "Cześć {x}" in got
    assert ('{"name": "f"}' in got) == kind.startswith("tools") and ("Oceniasz" in got) == (language == "pl")


def test_texts_are_hashed_in_slices():
    import pyarrow as pa

    texts = ["a b " * 300, None, "", "c " * 5000, *["d e"] * 50]
    parts = text.slices(pa.array(texts), 1000)
    assert len(parts) > 1 and [x for p in parts for x in p.to_pylist()] == texts
    assert all(sum(len(x or "") for x in p.to_pylist()[1:]) < 1000 for p in parts)
    assert [p.to_pylist() for p in text.slices(pa.array([], pa.string()))] == [[]]
