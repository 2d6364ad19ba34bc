import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import hnsw, partenum, urls

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    """{position: (n_shingles, n_similar, component)} of (doc_id, text) by comparing all sets."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(docs)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((docs[i][0], len(sets[i]), len(near[i]), min(docs[j][0] for j in seen)))
    return sorted(out)


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in df.select("doc_id", "n_shingles", "n_similar", "component_id").collect())


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert rows(partenum.op6_ngram_jaccard(spark, sf)) == sorted(con.execute(partenum.OP6_SQL).fetchall())


def test_planted(spark):
    rng = np.random.default_rng(3)
    docs = []
    for size in (3, 5, 9, 14, 24, 40, 90, 300, 1200):
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        docs.append((len(docs), " ".join(base)))
        for edits in (0, 1, 1, 2, 3, 6):
            x = list(base)
            for _ in range(edits):
                x[rng.integers(size)] = f"e{rng.integers(10**6)}"
            docs.append((len(docs), " ".join(x)))
        docs.append((len(docs), " ".join([*base, "tail"])))
        docs.append((len(docs), " ".join(base[: max(1, int(size * 0.93))])))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " \n\t")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, key long")
    assert rows(partenum.near_duplicates(df)) == brute(docs)


def test_blocks_of_a_hot_signature(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    docs = [" ".join([*base, f"x{i}"]) for i in range(12)]
    docs += [" ".join([*base[:120], *[f"y{i}.{k}" for k in range(80)]]) for i in range(9)]  # a long passage shared, but unlike
    for i in range(9):  # half of these differ by one word, the others by many
        own = [f"z{i // 2}.{k}" for k in range(60)]
        docs.append(" ".join([*base[:60], *own[: 60 - i % 2], *[f"q{rng.integers(10**6)}"] * (i % 2)]))
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(partenum.near_duplicates(df, block=3)) == brute(docs)


def test_groups_and_meetings():
    rng = np.random.default_rng(6)
    rows_ = sorted({(int(s), int(k), 20) for s, k in zip(rng.integers(0, 40, 900), rng.integers(0, 60, 900))})
    want = {(a, b) for s in range(40) for a in [k for t, k, _ in rows_ if t == s] for b in [k for t, k, _ in rows_ if t == s] if a < b}
    copies = [r for r in rows_ for _ in range(1 + r[1] % 2)]
    for size in (1, 7, 1000):
        parts = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*copies[i : i + size])], names=["sig", "key", "n"]) for i in range(0, len(copies), size)]
        plain, hot = [], {}
        for b in partenum._groups(4)(iter(parts)):
            for sig, part, key, n in zip(*(c.to_pylist() for c in b.columns)):
                assert len(key) <= 4
                plain.append((key, n)) if sig is None else hot.setdefault(sig, {}).setdefault(part, (key, n))
        kinds = pa.list_(pa.int64())
        got = [p for b in partenum._pairs(iter([pa.record_batch([pa.array([x[k] for x in plain], kinds) for k in (0, 1)], names=["key", "n"])])) for p in zip(*(b.column(k).to_pylist() for k in (0, 2)))]
        for sig, blocks in hot.items():
            assert sorted(blocks) == list(range(len(blocks)))
            met = [(sig, lo, hi, *blocks[x]) for lo in blocks for hi in blocks if lo <= hi for x in dict.fromkeys((lo, hi))]
            b = pa.record_batch([pa.array([m[k] for m in met], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), kinds, kinds))], names=["sig", "lo", "hi", "key", "n"])
            got += [p for c in partenum._meet(iter([b.slice(0, 3), b.slice(3)])) for p in zip(*(c.column(k).to_pylist() for k in (0, 2)))]
        assert set(got) == want


def test_every_band_enumerates_subsets():
    assert all(k2 > 0 and n2 - k2 > 1 and n1 * (k2 + 1) > partenum.max_distance(2 * (int(partenum.BANDS[q + 1]) - 1)) for q, (n1, n2, k2) in enumerate(partenum.DESIGNS) if n1 * n2 > 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 10**6))
def test_similar_sets_share_enough(size, edits, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.int64).astype(np.uint64))
    b = np.unique(np.concatenate([a[rng.permutation(len(a))[min(edits, len(a) - 1) :]], rng.integers(0, 1 << 62, edits // 2, dtype=np.int64).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both < 90 * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    q = partenum.bands_of(max(len(a), len(b)))[0]
    common = len(np.intersect1d(partenum.signatures(a, q), partenum.signatures(b, q)))
    assert common >= partenum._pair_needs(pa.array([len(a)]), pa.array([len(b)]))[0].as_py()
    assert common >= max(partenum._class_needs(pa.array([len(x)]))[0].as_py() for x in (a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 51), (52, 51), (70, 71)]
    got = {r.node: r.root for r in partenum.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and got[51] == got[52] == 50 and got[71] == 70


def test_jaccard_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text, 1), (4, text, 1), (None, text, 2), (7, None, 3), (None, "", 4)], "doc_id long, text string, n long")
    got = {(r.doc_id, r.n_shingles): (r.n_similar, r.component_id) for r in partenum.near_duplicates(docs).collect()}
    assert got == {(4, 26): (2, 4), (None, 26): (2, 4), (7, 0): (0, 7), (None, 0): (0, None)}
    assert partenum.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in partenum.keep_one(docs).collect()) == ["4", "7", "None"]


def test_keep_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = partenum.near_duplicates(docs).toPandas()
    assert sorted(r.doc_id for r in partenum.keep_one(docs).collect()) == sorted(set(near.component_id))


# nearest neighbours


def test_recall_and_scores(spark, sf):
    got = hnsw.op8_nearest(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v, ids = np.stack(e.embedding.to_list()).astype(float), e.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine.score) <= 1e-12).all()
        assert np.allclose(mine.score, [v[np.flatnonzero(ids == x)[0]] @ v[q] for x in mine.vec_id], atol=1e-12, rtol=0)
        hits += len(set(top) & set(mine.vec_id))
        total += 20
    assert hits / total >= 0.95


def test_inner_products_of_unlike_lengths(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 4, size=(3000, 1))
    df = spark.createDataFrame([(i, x.tolist(), 0.0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, score double")
    got = hnsw.nearest(df).toPandas()
    hits = 0
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == q].vec_id))
    assert hits / (150 * 20) >= 0.9


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df).collect()
    assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == [(2, 1.0), (3, 1.0), (20, 0.0), (20, 0.0)]
    assert {r.query_id for r in got} == {0, 20} and hnsw.nearest(df.limit(0)).count() == 0


def test_graph_keeps_its_form():
    x = np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    again = hnsw.Graph.from_bytes(g.to_bytes())
    assert np.array_equal(g.search(x[:20], 5, 40), again.search(x[:20], 5, 40)) and (g.search(x[:20], 5, 40)[:, 0] == np.arange(20)).all()


# urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def rule(host, path):
    fits = [(len(h + p), h + p, act) for act, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in urls.op10_url_filter(spark, sf).collect():
        assert (r.host, r.path) == parts(pages[r.page_id])
        name, act = rule(r.host, r.path)
        assert r.rule == name and r.verdict in ("allow", "block") and (act is None or r.verdict == act)


@pytest.mark.parametrize("url", [None, "", "no scheme", "http://", "HTTP://A.ExaMPLE.Org/es/x?y#z", "http://example.org?x", "a://b://c/d", "http://org/", "http://xorg/", "http://a.com/fr/", "http://a.com/de/\nq#", "http://example.org/en/12", "x" * 200_000 + "://h/p", "http://É.Com/DE/"])
def test_url_cases(spark, url):
    df = spark.createDataFrame([(1, url, "h"), (None, url, "h")], "page_id long, url string, host string")
    for r in urls.judge(df).collect():
        assert (r.host, r.path) == parts(url) and r.rule == rule(*parts(url))[0]
    assert urls.judge(df.limit(0)).count() == 0


def test_classifier_on_held_out_urls():
    import pyarrow as pa

    w = urls.train(urls.labelled_urls())
    bad = ["best-casino-bonus.example.net", "cheap-pills-online.example.com", "www.spam-farm.example.com", "free-poker.test", "casino-win.example.com"]
    good = ["city-library.example.net", "thther.example.com", "blog.tionsh.example.net", "www.museum-garden.test"]
    z = urls.logits(pa.array([f"^{h}$/en/123" for h in bad + good]), w)
    assert (z[: len(bad)] > 0).all() and (z[len(bad) :] < 0).all()
