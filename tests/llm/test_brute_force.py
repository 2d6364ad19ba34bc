"""Each method against a slow one that says the same in plain words."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from millrace.llm import _text, fingerprints, hnsw, huffman, licenses, mixing, partenum, toxicity, urls

# word hashes


def test_regular_words_do_not_collide():
    """Words that collide under any polynomial hash modulo a power of two."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    words = [a, a.translate(str.maketrans("ab", "ba")), a[:512], a[512:], "ab" * 512, "ba" * 512]
    got = {int(_text.words(*_text.utf8(pa.array([w])), 0, 1)[0][0]) for w in words}
    assert len(got) == len(set(words))


# toxicity


def naive(text, weights, exceptions):
    """(hits, weight) by looking at every word of a folded text."""
    words = text.split()
    spared = set()
    for e in exceptions:
        n = len(e.split())
        for i in range(len(words) - n + 1):
            if words[i : i + n] == e.split():
                spared |= set(range(i, i + n))
    found = [max((x for w, x in weights.items() if word.startswith(w)), default=None) for i, word in enumerate(words) if i not in spared]
    return sum(x is not None for x in found), sum(x or 0.0 for x in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("trash can cannot idiot idiots idiotic clown fish a trashcan sore loser".split()), max_size=12), st.sampled_from([" ", ", ", "!!! ", " - "]))
def test_matcher_equals_naive_scan(words, gap):
    weights, exceptions = {"trash": 3.0, "idiot": 2.0, "idioti": 2.5, "clown": 1.0, "loser": 4.0}, ("trash can", "clown fish", "can idiot", "sore loser")
    got = toxicity.Model(weights, exceptions).matcher()(toxicity.fold(gap.join(words)))
    assert got == naive(toxicity.fold(gap.join(words)), weights, exceptions)


def test_phrases_end_with_a_word_and_punctuation_is_no_word():
    match = toxicity.Model({"trash": 3.0}, ("trash can",)).matcher()
    assert [match(toxicity.fold(t))[0] for t in ("trash cannot", "trash, can!", "a trash can", "trash can trash")] == [1, 0, 0, 1]
    assert [toxicity.n_words(toxicity.fold(t)) for t in ("You idiot!!! ... go, away - now; ok?", "", None, " .. ", "one")] == [6, 0, 0, 0, 1]


def test_scores_equal_naive_ones(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    b, c, d = m.curve
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    for r in docs.collect():
        f = toxicity.fold(r.text)
        hits, weight = naive(f, m.weights, m.exceptions)
        z = b + c * math.log1p(weight) + d * math.log1p(100 * weight / (len(f.split()) + 20))
        g = got[r.doc_id]
        assert g.tox_hits == hits and g.tox_words == len(f.split()) and math.isclose(g.tox_score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_exceptions_are_learned():
    rng = random.Random(1)
    plain = "sun rain wind road tree lake hill bird".split()
    say = lambda *more: " ".join([*rng.choices(plain, k=6), *more, *rng.choices(plain, k=6)])
    bad = [say(rng.choice(plain), "scum", rng.choice(plain)) for _ in range(60)]
    good = [say() for _ in range(600)] + [say("pond", "scum") for _ in range(6)]
    m = toxicity.train(bad + good, [1] * len(bad) + [0] * len(good))
    assert "scum" in m.weights and "pond scum" in m.exceptions
    match = m.matcher()
    assert match(toxicity.fold("pond scum"))[0] == 0 and match(toxicity.fold("you scum"))[0] == 1


# licence templates


def regex_of(template):
    """The template as a regular expression over words that each have a blank after them."""
    out = ""
    for mark in licenses._MARK.findall(template):
        if mark == "[[":
            out += "(?:"
        elif mark == "]]":
            out += ")?"
        elif mark.startswith("{{"):
            least, most = mark[:-2].split(":")[1].split("-")
            out += rf"(?:\S+ ){{{least},{most}}}"
        elif mark[0] == "(":
            out += rf"(?:{mark[1:-1]}) "
        else:
            out += re.escape(mark) + " "
    return re.compile(r"(?:^|(?<= ))" + out)


def sample_of(template, rng):
    """A text that the template takes."""
    words, skip = [], []
    for mark in licenses._MARK.findall(template):
        if mark == "[[":
            skip.append(rng.random() < 0.5)
        elif mark == "]]":
            skip.pop()
        elif not any(skip):
            if mark.startswith("{{"):
                least, most = map(int, mark[:-2].split(":")[1].split("-"))
                words += [rng.choice(["acme", "tool", "the", "of"]) for _ in range(rng.randint(least, most))]
            else:
                words.append(rng.choice(mark[1:-1].split("|")) if mark[0] == "(" else mark)
    return words


EXTRA = {"alone": "(mit|bsd) {{x:1-2}} license", "open": "[[a]] {{x:1-2}}", "nested": "[[x [[y]] z]] end here"}


def test_templates_equal_regular_expressions(spark):
    rng = random.Random(7)
    docs = []
    for template in [*licenses.TEMPLATES.values(), *EXTRA.values()]:
        for kind in range(6):
            words = sample_of(template, rng)
            if kind > 2:  # a mandatory word changed, or lost
                k = rng.randrange(len(words))
                words[k : k + 1] = [] if kind == 3 else ["other"]
            docs.append((len(docs), " ".join(["so", *words, "then"] if kind % 2 else words)))
    templates = {**licenses.TEMPLATES, **EXTRA}
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates, {}).collect()}
    for doc_id, text in docs:
        want = {label for label, t in templates.items() if regex_of(t).search(text + " ")}
        assert set(filter(None, rows[doc_id].labels.split(","))) == want, text
    whole = {label for label in licenses.TEMPLATES for r in rows.values() if label in r.labels.split(",")}
    assert whole == set(licenses.TEMPLATES)


# fingerprints


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 900), st.integers(0, 900), st.integers(0, 10**6))
def test_estimates_against_true_sets(n, m, seed):
    rng = np.random.default_rng(seed)
    pool = [f"w{k}" for k in rng.integers(0, 10**6, 1200)]
    a, b = pool[:n], pool[300 : 300 + m]
    true = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set() for w in (a, b)]
    x, y = fingerprints.sketches(pa.array([" ".join(a), " ".join(b)]))
    jaccard = len(true[0] & true[1]) / max(len(true[0] | true[1]), 1) if true[0] or true[1] else 1.0
    exact = max(len(t) for t in true) <= fingerprints.FEW
    assert abs(fingerprints.likeness(x, y) - jaccard) < (1e-9 if exact else 0.25)
    assert fingerprints.from_string(fingerprints.to_string(*x))[0].tolist() == x[0].tolist()
    merged, both = fingerprints.merge(x, y), len(true[0] | true[1])
    assert abs(len(merged[0]) * (1 if merged[1] else 4) - both) <= (0 if merged[1] else 6 * (3 * both) ** 0.5 + 4)


def test_near_edited_and_next_against_true_sets(spark, sf):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()

    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got = {r.doc_id: r for r in fingerprints.op9_fingerprints(spark, sf).collect()}
    errors = []
    for k, (doc_id, text) in enumerate(docs):
        after, n = docs[(k + 1) % len(docs)][1], len(text) // 4
        sets = [shingles(t) for t in (text, text[: len(text) - n] + after[:n], after)]
        for estimate, other in ((got[doc_id].near_edited, sets[1]), (got[doc_id].near_next, sets[2])):
            true = len(sets[0] & other) / len(sets[0] | other) if sets[0] or other else 1.0
            errors.append((max(len(sets[0]), len(other)), abs(estimate - true)))
    assert all(e < 1e-9 for n, e in errors if n <= fingerprints.FEW)
    assert np.mean([e for n, e in errors if n > fingerprints.FEW] or [0]) < 0.05


def test_null_and_repeated_ids_follow_each_other(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, None, 5, 5, *range(20)]), " ".join(rng.choices("abcdefghij", k=rng.randint(0, 9))) + f" {i}") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = sorted((r[0] or -1, r[1], order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    rows, out = fingerprints.with_next(df, ranges=16), []
    for part in rows.rdd.glom().collect():
        for a, b in zip(part, part[1:]):
            if a.bucket == b.bucket and not a.ahead:
                out.append((a.doc_id or -1, a.text, b.text))
    assert sorted(out) == want


# urls


def test_logistic_scores_one_by_one():
    w = urls.default_weights()
    texts = ["^a.org$/x", "", "^", "^casino.example.com$/en/1", "^ü$", "^" + "long-" * 500 + "$/"]

    def slow(text):
        b, total, n = text.encode(), 0.0, 0
        for size in urls.GRAMS:
            for i in range(len(b) - size + 1):
                code = np.uint64(int.from_bytes(b[i : i + size], "big"))
                with np.errstate(over="ignore"):
                    h = _text.mix(np.array([code + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))]))[0]
                total, n = total + w[int(h >> np.uint64(64 - urls.BITS))], n + 1
        return 8 * total / max(n, 1) ** 0.5 + w[-1]

    got = urls.logits(pa.array(texts), w)
    assert np.allclose(got, [slow(t) for t in texts], rtol=1e-9)
    assert all(urls.logits(pa.array([t]), w)[0] == g for t, g in zip(texts, got))  # neighbours don't matter


def test_url_table_cross_validated():
    rows = urls.labelled_urls()

    def host(u):
        return re.match(r"[^:]*://([^/?#]*)([^?#]*)", u)

    fold = [zlib.crc32(re.sub(r"^(www|m|blog|news|forum)\.", "", host(u)[1]).encode()) % 4 for u, _ in rows]
    hit = false = missed = 0
    for k in range(4):
        w = urls.train([r for r, f in zip(rows, fold) if f != k], rounds=200)
        held = [r for r, f in zip(rows, fold) if f == k]
        z = urls.logits(pa.array([f"^{host(u)[1]}${host(u)[2]}" for u, _ in held]), w) >= 0
        y = np.array([label for _, label in held]) == 1
        hit, false, missed = hit + (z & y).sum(), false + (z & ~y).sum(), missed + (~z & y).sum()
    assert hit / (hit + false) > 0.93 and hit / (hit + missed) > 0.93


@pytest.mark.parametrize("url, bad", [("adultlearning.edu", 0), ("casinoroyale-filmreview.com", 0), ("www.library.essex.gov.uk", 0), ("www.sussex.ac.uk", 0), ("m.casino-win.example.com", 1), ("free-bets.example.com", 1), ("best-sex-cams.net", 1)])
def test_hosts_outside_the_table(url, bad):
    assert (urls.logits(pa.array([f"^{url}$/"]), urls.default_weights())[0] > 0) == bad


# neighbours


@pytest.mark.parametrize("scale", [1e-170, 1e-30, 1.0, 1e150, 1e170])
def test_vectors_of_any_length(spark, scale):
    v = np.random.default_rng(4).normal(size=(60, 6)) * scale
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, every=20).collect()
    assert len(got) == 60 and all(len({r.vec_id for r in got if r.query_id == q} - {q}) == 20 for q in (0, 20, 40))
    if 1e-140 < scale < 1e140:
        for q in (0, 20, 40):
            s = v @ v[q]
            s[q] = -np.inf
            mine = {r.vec_id for r in got if r.query_id == q}
            assert len(mine & set(np.argsort(-s)[:20].tolist())) >= 18


def test_widths_apart(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=4 + 2 * (i % 2)).tolist()) for i in range(100)] + [(200, [1.0])]
    got = hnsw.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), every=25, k=5).collect()
    assert {r.query_id for r in got} == {0, 25, 50, 75} and all((r.query_id - r.vec_id) % 2 == 0 for r in got) and len(got) == 20


def test_shards_follow_from_the_data():
    assert [hnsw.shards_for(n, 64) for n in (1, 1024, 8000, 10_000, 100_000, 1_000_000)] == [1, 1, 8, 8, 13, 123]
    assert hnsw.shards_for(100_000, 20_000) > 13  # wide vectors: bounded by bytes


def test_recall_of_a_full_shard():
    """Gaussian vectors, which have no structure that helps: the hardest case. A shard never holds more, whatever the table's size."""
    v = np.random.default_rng(9).normal(size=(hnsw.SHARD_ROWS, 64))
    top = np.sqrt((v * v).sum(axis=1).max())
    x = (np.concatenate([v, np.sqrt(np.maximum(top * top - (v * v).sum(axis=1), 0))[:, None]], axis=1) / top).astype(np.float32)
    q = v[:150]
    found = hnsw.Graph(x).search(np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((150, 1))], axis=1).astype(np.float32), 41, hnsw.EF_SEARCH)
    true = np.argsort(-(q @ v.T), axis=1)[:, :21]
    assert np.mean([len(set(f) & set(t)) / 21 for f, t in zip(found, true)]) > 0.93


# token files


def test_files_of_bounded_size(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(i, "some words here " * (i % 40)) for i in range(400)], "doc_id long, text string")
    path = f"file://{tmp_path}/x"
    files = huffman.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), partitions=2, file_ids=1000)
    rows = files.collect()
    assert len(rows) > 10 and all(r.n_ids < 1000 + 200 for r in rows) and len({r.path for r in rows}) == len(rows)
    got = sorted(huffman.read_ids(files, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(400)) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


# the pipeline as a whole


def test_pipeline_by_brute_force(spark, sf, tmp_path):
    """Documents with nulls, empty texts, repeated rows, clashing columns: stage by stage in plain Python."""
    rng = random.Random(11)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 60))), "en", rng.choice(["x", "y", None]), 1, 2) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " tail", "en", "x", 1, 2) for i in range(5)] + [(200 + i, docs[i][1], "en", "y", 1, 2) for i in range(5)]
    docs += [(300, None, None, None, None, None), (301, "", "en", "x", 0, 0), (None, "a text of no id at all", "en", "x", 3, 3), (302, "you are an idiot and scum and trash " * 3, "en", "y", 4, 4), docs[7], docs[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __mix_k long"
    folder = tmp_path / "sf"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    labelled = spark.read.parquet(f"{sf}/labels.parquet")
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    labels = labelled.join(text, "doc_id").selectExpr("doc_id + 10000 as doc_id", "quality", "toxic")
    labels.write.parquet(f"{folder}/labels.parquet")
    more = text.join(labelled, "doc_id", "left_semi").selectExpr("doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars", "1L as __mix_k")
    all_docs = spark.createDataFrame(docs, schema).unionByName(more)
    now = [tuple(r) for r in all_docs.collect()]

    model = toxicity.fit(all_docs, labels)
    b, c, d = model.curve

    def bad(t):
        f = toxicity.fold(t)
        w = naive(f, model.weights, model.exceptions)[1]
        return b + c * math.log1p(w) + d * math.log1p(100 * w / (len(f.split()) + 20)) >= 0

    kept = corpus_pipeline.drop_toxic(spark, all_docs, str(folder))
    now = [r for r in now if not bad(r[1])]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(now, key=key) and kept.columns == all_docs.columns
    assert 302 not in {r[0] for r in now}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, group = [shingles(r[1]) for r in now], list(range(len(now)))
    for i in range(len(now)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = corpus_pipeline.drop_near_copies(spark, kept, str(folder))
    after = [tuple(r) for r in out.collect()]
    empty = [r for r, s in zip(now, sets) if not s]
    groups = {g for g, s in zip(group, sets) if s}
    assert len(after) == len(groups) + len(empty) and sorted((r for r in after if not shingles(r[1])), key=key) == sorted(empty, key=key)
    assert sorted(group[now.index(r)] for r in after if shingles(r[1])) == sorted(groups)

    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    mixed = [tuple(r) for r in corpus_pipeline.mix_sources(spark, out, str(folder)).collect()]
    names = sorted({r[3] for r in after}, key=lambda s: (s is None, s))
    sizes = [sum(size(r) for r in after if r[3] == s) for s in names]
    want = mixing.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    longest = max(size(r) for r in after)
    for s, target in zip(names, want):
        assert abs(sum(size(r) for r in mixed if r[3] == s) - target) <= longest
    assert all(mixed.count(r) <= 3 * after.count(r) for r in set(mixed)) and set(mixed) <= set(after)

    clash = out
    for name in ("__set", "__tox_score", "__id", "__of", "rows", "leads", "key", "bucket", "at"):
        clash = clash.selectExpr("*", f"doc_id as {name}")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, clash, str(folder)).columns == clash.columns
    assert corpus_pipeline.drop_near_copies(spark, clash, str(folder)).where("doc_id <> __set or doc_id <> key").count() == 0
    empty_docs = all_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, str(folder)).count() == 0
