"""Near copies among rows whose doc_ids repeat or are null."""

import random

from millrace.llm import partenum


def text(seed, tail=()):
    return " ".join([*(f"{seed}w{k}" for k in range(80)), *tail])


def compare(docs):
    """(doc_id, n_similar, component_id) and the component's positions of each row, by comparing all sets of 5-word shingles."""
    sets = []
    for _, t in docs:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    near = [[j for j in range(len(docs)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(len(docs))]
    out = []
    for i in range(len(docs)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append(((docs[i][0], len(near[i]), min(ids, default=None)), frozenset(seen)))
    return out


def mixed():
    """Chains of near copies (neighbours link, ends don't) and single texts, with doc_ids that repeat and null ones."""
    rng, docs = random.Random(4), []
    for c in range(12):
        base = [f"{c}w{k}" for k in range(100)]
        for step in range(rng.randint(1, 4)):
            docs += [(rng.choice([None, None, *range(9)]), " ".join([*base[5 * step :], *(f"{c}x{k}" for k in range(5 * step))]))] * rng.choice([1, 1, 2])
    return [*docs, (None, ""), (None, None), (3, " "), (3, "")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def components(spark, docs):
    return sorted(((r.doc_id, r.n_similar, r.component_id) for r in partenum.near_duplicates(frame(spark, docs)).collect()), key=str)


def test_link_through_a_null_id(spark):
    docs = [(5, text("a")), (None, text("a", "bcde")), (9, text("a", "bcdefghij"))]
    assert [len(x[1]) for x in compare(docs)] == [3, 3, 3] and compare(docs)[0][0][1] == 1
    assert components(spark, docs) == sorted((x for x, _ in compare(docs)), key=str)


def test_classes_of_one_id_stay_apart(spark):
    docs = [(1, text("a")), (1, text("b")), (2, text("a", "c")), (3, text("b", "c"))]
    got = partenum.near_duplicates(frame(spark, docs))
    assert components(spark, docs) == sorted((x for x, _ in compare(docs)), key=str)
    assert got.where("leads").count() == 2


def test_components_of_mixed_ids(spark):
    docs = mixed()
    assert components(spark, docs) == sorted((x for x, _ in compare(docs)), key=str)


def kept(spark, docs):
    return [(r.doc_id, r.text) for r in partenum.keep_one(frame(spark, docs)).collect()]


def test_null_ids_are_documents_of_their_own(spark):
    docs = [(None, text(f"t{k}")) for k in range(9)] + [(None, ""), (None, None), (4, text("t")), (4, text("u"))]
    assert sorted(kept(spark, docs), key=str) == sorted(docs, key=str)


def test_a_unique_text_stays_where_its_id_repeats(spark):
    docs = [(1, text("a")), (7, text("a", "b")), (7, text("c"))]
    assert sorted(kept(spark, docs)) == [docs[0], docs[2]]


def test_one_row_of_each_component_stays(spark):
    docs = mixed()
    want = compare(docs)
    got = kept(spark, docs)
    groups = {}
    for (_, x), (y, members) in zip(docs, want):
        groups.setdefault(members, (y[2], set()))[1].add(x)
    assert len(got) == len(groups)
    for first, texts in groups.values():
        assert sum(t in texts for d, t in got if d == first) >= 1 and (texts & {"", " ", None} or sum(t in texts for _, t in got) == 1)
