import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import _text, fingerprints, licenses, toxicity

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x85\u2003", max_size=12), max_size=8))
def test_word_hashes_equal_for_equal_words(texts):
    raw, at = _text.utf8(pa.array(texts, pa.string()))
    known = {}
    for i, j in _text.chunks(at):
        h, b = _text.words(raw, at, i, j)
        for k in range(j - i):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[i + k].translate(UPPER))
            got = h[b[k] : b[k + 1]].tolist()
            assert len(got) == len(words)
            for w, x in zip(words, got):
                assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_long_text_in_pieces():
    text = "word another " * 250_000
    raw, at = _text.utf8(pa.array([text]))
    h, b = _text.words(raw, at, 0, 1)
    assert b.tolist() == [0, 500_000] and len(set(h.tolist())) == 2
    giant = "x" * (3 << 20)
    raw, at = _text.utf8(pa.array([giant]))
    assert len(_text.words(raw, at, 0, 1)[0]) == 1


@given(st.lists(st.integers(0, 9), max_size=5), st.integers(1, 4))
def test_shingle_counts(lengths, width):
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    s, b = _text.shingles(np.arange(bounds[-1], dtype=np.uint64), bounds, width)
    assert np.diff(b).tolist() == [max(n - width + 1, min(n, 1)) for n in lengths] and len(set(s.tolist())) == len(s)


# fingerprints


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fingerprints.op9_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        after, n, r = docs[(i + 1) % len(docs)].text, len(d.text) // 4, got[d.doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256((d.text[: len(d.text) - n] + after[:n]).encode()).hexdigest()
        a, b = (fingerprints.from_string(got[x.doc_id].fingerprint) for x in (d, docs[(i + 1) % len(docs)]))
        a, b = ({v for v in x[0].tolist() if v < 1 << 30 or a[1] and b[1]} for x in (a, b))  # below the lower limit of the two
        assert abs(r.near_next - len(a & b) / len(a | b)) < 1e-9
    assert np.mean([r.near_edited for r in got.values()]) > 0.5


def test_estimates():
    words = [f"w{i}" for i in range(40_000)]
    big, small = " ".join(words), " ".join(words[:4000])
    a, b = fingerprints.sketches(pa.array([big, small]))
    assert abs(fingerprints.containment(b, a) - 1) < 1e-9 and abs(fingerprints.containment(a, b) - 0.1) < 0.03 and abs(fingerprints.likeness(a, b) - 0.1) < 0.03
    c = next(fingerprints.sketches(pa.array([" ".join(words[4000:])])))
    m = fingerprints.merge(b, c)
    assert abs(len(m[0]) - len(a[0])) <= 2 and fingerprints.from_string(fingerprints.to_string(*m))[0].tolist() == m[0].tolist()
    x, y = fingerprints.sketches(pa.array(["a b", "a b c d"]))
    assert len(x[0]) and len(fingerprints.merge(x, y)[0]) and fingerprints.likeness(x, x) == 1.0


def test_fingerprint_cases(spark):
    data = [(5, None, 1), (5, "a b c d e f g h", 2), (5, "a b c d e f g h", 2), (None, "x", 3), (9, "w " * 300_000, 4)] + [(7, f"t{i} u v", 0) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, h long")
    got = fingerprints.fingerprint(docs).collect()
    assert len(got) == len(data)
    assert {r.fingerprint for r in got if r.n_chars == 15} == {next(r.fingerprint for r in got if r.n_chars == 15)}
    assert [r.fingerprint for r in got if r.n_chars == 0] == [""]
    one = fingerprints.fingerprint(docs.where("doc_id = 9")).collect()
    assert one[0].near_next == 1.0 and fingerprints.fingerprint(docs.limit(0)).count() == 0
    ordered = sorted((r for r in got), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert ordered[0].edited_sha256 == hashlib.sha256(b"x").hexdigest()


# licences


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    at, names = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                names.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))


def test_licenses(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op5_licenses(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates(spark):
    texts = {
        1: "x y. This work is licensed under the GNU General Public License, version 3.", 2: "Released under the MIT-License", 3: "mit\nlicense MIT License é mit license", 4: None, 5: "This is licensed under CC BY-NC 4.0!",
        6: "general public general public license", 7: "released beneath the mit license", 8: "a " * 600_000 + "apache license", 9: "The big new parser is available under the terms of the MIT license.", 10: "", 11: "ééMIT License mit licenses",
    }
    docs = spark.createDataFrame([(k, v, "z") for k, v in texts.items()] * 2, "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    assert len(got) == 2 * len(texts) and licenses.scan(docs.limit(0)).count() == 0
    by = {r.doc_id: r for r in got}
    for k, t in texts.items():
        assert (by[k].n_words, by[k].n_base, by[k].first_word, by[k].last_word, by[k].base_labels) == brute(t)
    assert by[1].labels == "gpl,gpl-3.0-notice" and by[1].spans == ["gpl-3.0-notice:2:12"] and by[2].labels == "mit,mit-notice" and by[5].labels == "cc-by-nc-4.0-notice"
    assert by[7].labels == "mit" and by[7].score == 0.5 and by[9].labels == "mit,mit-notice" and by[9].spans == ["mit-notice:0:13"] and by[3].n_base == 3


# toxicity


def test_fold():
    assert toxicity.fold("1D10T, \uff29dі0t!").split() == ["idiot", "idiot"] and toxicity.fold(None) == " "


def test_exceptions_and_weights():
    m = toxicity.Model({"trash": 3.0, "idio": 2.0}, ("trash can",)).matcher()
    assert m(toxicity.fold("trash trash can idiots")) == (2, 5.0) and m(toxicity.fold("nothing")) == (0, 0.0)


def test_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = found = toxic = clean = wrong = 0
    for r in toxicity.op4_toxicity(spark, sf).collect():
        import zlib

        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            toxic += labels[r.doc_id]
            found += labels[r.doc_id] and r.predicted
            clean += 1 - labels[r.doc_id]
            wrong += (1 - labels[r.doc_id]) and r.predicted
            right += labels[r.doc_id] == r.predicted
    assert found / toxic > 0.85 and wrong / clean < 0.02 and right / (toxic + clean) > 0.97


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, f"you idiot fool {chr(97 + i % 26)}{chr(97 + i // 26)}x" if i % 2 else f"a kind word {chr(97 + i % 26)}{chr(97 + i // 26)}x here", 9) for i in range(200)] + [(None, None, 1), (500, "", 2), (501, "idiot " * 50_000, 3)], "doc_id long, text string, tox_score long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (1, None), (3, 0)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    got = {r.doc_id: r.tox_score for r in toxicity.score(docs, m).collect()}
    assert got[501] > 0.5 > got[500] == got[None] and all((got[i] > 0.5) == bool(i % 2) for i in range(200))
    assert sorted(str(r.doc_id) for r in toxicity.clean(docs, labels).collect()) == sorted(["None", "500", *map(str, range(0, 200, 2))])
    assert all(r.tox_score < 1e-9 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())
    assert toxicity.score(docs.limit(0), m).count() == 0
