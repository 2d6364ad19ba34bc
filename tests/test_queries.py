"""Each query of the library against its DuckDB twin."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

from millrace import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]

    def text(x):
        x = x.tolist() if hasattr(x, "tolist") else x
        if isinstance(x, list):
            return str([text(v) for v in x])
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, sf, duck, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_greedy_is_a_maximal_independent_set(spark, sf):
    from millrace.operators import dedup

    prints = queries._first_prints(spark, sf).toPandas()
    pairs = {(r.i, r.j) for r in queries.simhash_pairs_t3(spark, sf).collect()}
    kept = []
    for i in sorted(prints.id):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in queries.simhash_greedy_t3(spark, sf).collect()) == kept
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "i long, j long")
    assert sorted(r.id for r in dedup.independent(nodes, edges).collect()) == [0, 2, 4]
    assert sorted(r.id for r in dedup.any_earlier(nodes, edges).collect()) == [0]


def test_embedding_pairs_lose_none(spark):
    import numpy as np

    from millrace.operators import dedup

    v = np.random.default_rng(0).normal(size=(200, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.i, r.j) for r in dedup.embedding_pairs(df, 0.02, 3).collect()}
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if abs(1 - v[i] @ v[j]) < 0.02}
    assert got == want and want


def test_embeddings_of_many_rows_meet_in_blocks(spark, monkeypatch):
    import numpy as np

    from millrace.operators import dedup

    monkeypatch.setattr(dedup, "block_rows", lambda n, width: 37)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16))
    v[200:] = v[:100]  # copies too
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (300, [1.0, 0.0]), (301, [0.6, 0.8]), (302, None)], "id long, v array<double>")
    got = [(r.i, r.j) for r in dedup.embedding_pairs(df, 0.5, 16).collect()]
    d = np.abs(v @ v.T - 1)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] < 0.5} | {(300, 301)}
    assert len(got) == len(set(got)) and set(got) == want
    some = df.where("id % 3 = 0")
    got = [(r.i, r.j) for r in dedup.embedding_pairs(some, 0.5, 16, df).collect()]
    assert len(got) == len(set(got)) and {(i, j) for i, j in got if max(i, j) < 300} == {(i, j) for i in range(0, 300, 3) for j in range(300) if d[i, j] < 0.5}
    plan = dedup.embedding_pairs(df, 0.5, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_topk_cosine_sends_no_vectors_to_the_driver(spark, sf):
    plan = queries.topk_cosine(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


@pytest.fixture
def scattered(tmp_path):
    """documents in files of unlike size, whose doc_ids don't follow the order of rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    ids = [40, 7, *range(100, 130), 3, 2, 1]
    texts = ["same " * 60, "same " * 60, *[f"text {i} " * (30 + i) for i in range(30)], "same " * 60, "text 4 " * 34, "text 4 " * 34]
    for k, (lo, hi) in enumerate([(0, 2), (2, 32), (32, 35)]):
        t = texts[lo:hi]
        pq.write_table(pa.table({"doc_id": ids[lo:hi], "text": t, "lang": ["en"] * len(t), "source": ["x"] * len(t), "n_chars": [len(x) for x in t]}), folder / f"part-{k}.parquet")
    return str(tmp_path), ids, texts


def _same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    assert Counter(map(tuple, queries.QUERIES[name](spark, folder).select(*names).collect())) == Counter(want.fetchall())


def test_dedup_exact_keeps_the_smallest_id(spark, scattered):
    _same_as_sql(spark, scattered[0], "dedup_exact")


def test_index_follows_files_not_their_sizes(spark, scattered):
    from millrace.sources import scan

    folder, ids, _ = scattered
    got = scan.with_index(queries.read(spark, folder, "documents").select("doc_id")).orderBy("index").collect()
    assert [r.doc_id for r in got] == ids and [r["index"] for r in got] == list(range(len(ids)))


def test_flagship_keeps_the_smallest_id(spark, scattered):
    _same_as_sql(spark, scattered[0], "flagship")


@pytest.fixture
def odd(tmp_path):
    """documents with null ids, ids that repeat with other texts, blank and null texts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = __import__("random").Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)]
    texts[20:40] = texts[:20]
    texts[50:54] = ["", "   ", None, "\n\t"]
    ids = [None if i % 17 == 3 else i % 150 for i in range(200)]
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * 200, "source": ["x"] * 200, "n_chars": [len(t or "") for t in texts]}), folder / "part-0.parquet")
    return str(tmp_path)


def test_fingerprints_of_repeated_ids_and_blank_texts(spark, odd):
    _same_as_sql(spark, odd, "simhash_fingerprint")


def test_classes_of_repeated_ids_and_blank_texts(spark, odd):
    _same_as_sql(spark, odd, "simhash_classes")


def test_simhash_pairs_neither_hold_nor_broadcast(spark, sf, odd):
    _same_as_sql(spark, odd, "simhash_pairs_t3")
    plan = queries.simhash_pairs_t3(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_any_earlier_of_repeated_ids_and_blank_texts(spark, odd):
    _same_as_sql(spark, odd, "simhash_any_earlier_t3")


def test_topk_neighbors_of_repeated_ids_and_blank_texts(spark, odd):
    _same_as_sql(spark, odd, "topk_neighbors")


@pytest.fixture
def uncommon(tmp_path):
    """documents whose texts have white space and letters that engines treat unlike."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["a\x0bb c", "a\x0cb c", "A b\tC", "\xa0a b c\u2003", "a b c", "a\xa0b c", "\u3000 \xa0", "\x0b", " \x0b ", "\x1c", "\u200b", "\u0130stanbul i", "istanbul I", "\u039f\u0394\u039f\u03a3 x", "\u03bf\u03b4\u03bf\u03c3 X", "\u03a3", "a\x00b", "\U00010400 \u1e9e"]
    n = len(texts)
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    pq.write_table(pa.table({"doc_id": range(n), "text": texts, "lang": ["en"] * n, "source": ["x"] * n, "n_chars": [len(t) for t in texts]}), folder / "part-0.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["simhash_classes", "simhash_fingerprint", "text_normalize"])
def test_uncommon_spaces_and_letters(spark, uncommon, name):
    _same_as_sql(spark, uncommon, name)
