import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import mixing


def rows(df):
    return sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in df.collect())


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted((str(a), b, c, d, e) for a, b, c, d, e in con.execute(mixing.OP1_SQL).fetchall())
    assert rows(mixing.op1_mixing(spark, sf)) == want


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes)) and abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    free = [t / w for t, w, s in zip(got, weights, sizes) if t < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1.0, max(free))


def test_overlapping_sources_by_brute_force():
    """Least cost of all integer flows, by trying them."""
    supply, quota = {"a": 2, "ab": 2, "b": 1}, {"A": 4, "B": 4}
    edges = [("a", "A"), ("ab", "A"), ("ab", "B"), ("b", "B")]
    flow = mixing.min_cost_flow(supply, quota, edges)

    def cost(used, n):
        return sum(max(0, min(used, n * k) - n * (k - 1)) * (k - 1) for k in (1, 2, 3))

    def total(f):
        used = {p: sum(v for (q, _), v in f.items() if q == p) for p in supply}
        got = {s: sum(v for (_, t), v in f.items() if t == s) for s in quota}
        if any(used[p] > 3 * supply[p] for p in supply) or any(got[s] > quota[s] for s in quota):
            return None
        return -sum(got.values()), sum(cost(used[p], supply[p]) for p in supply)

    best = min(t for a in range(7) for x in range(7) for y in range(7) for b in range(4) if (t := total(dict(zip(edges, (a, x, y, b))))) is not None)
    assert total(flow) == best


def test_cases(spark):
    data = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, None, "x", 2), (None, "d e", None, 3), (3, "", "y", 4), (4, "w " * 5000, "y", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size long")
    got = mixing.mix(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", "taken")
    assert got.count() == len(data) and all(r.taken <= 3 * r.size for r in got.collect())
    by = {tuple(r.members): (r.t, r.target) for r in mixing.mix(mixing.sized(docs)).groupBy("members").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) <= 1 for t, target in by.values()) and (None,) in by
    assert rows(got) == rows(mixing.mix(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", "taken"))
    empty = docs.limit(0)
    assert mixing.mix(mixing.sized(empty)).count() == 0 and mixing.copies(empty).columns == docs.columns


def test_copies_follow_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(mixing.sized(docs)).collect()}
    n = {r.doc_id: r["count"] for r in mixing.copies(docs).groupBy("doc_id").count().collect()}
    for d, (t, size) in taken.items():
        assert abs(n.get(d, 0) - t / max(size, 1)) <= 0.5 + 1e-9


def test_overlapping_membership_on_tables(spark):
    docs = spark.createDataFrame([(i, 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(300)], "doc_id long, size long, sources array<string>")
    got = mixing.mix(docs)
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(sum(mixing.targets([2000, 2000], [5, 2])), abs=2)
