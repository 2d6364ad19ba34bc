import numpy as np
import public_tokenizers
import zlib

import corpus_pipeline
from millrace.llm import mixing, partenum, toxicity
from millrace.llm._run import work_dir
from millrace.llm._tokens import encoder


def test_stages(spark, sf):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, f in corpus_pipeline.STAGES:
        path = work_dir(spark, "t")
        f(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = [r.doc_id for r in docs.collect()], [r.doc_id for r in out.collect()]
        if name == "toxicity":
            m = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = [r.doc_id for r in toxicity.score(docs, m).collect() if r.tox_score < 0.5]
            assert sorted(after) == sorted(want) and 0 < len(after) < len(before)
        elif name.startswith("n-gram"):
            want = {r.component_id for r in partenum.near_duplicates(docs).collect()}
            assert sorted(after) == sorted(want) and len(after) < len(before)
        elif name.startswith("mixing"):
            for r in mixing.mix(mixing.sized(docs)).collect():
                assert abs(after.count(r.doc_id) - r.taken / max(r.size, 1)) <= 0.5 + 1e-9
        else:
            e, tokens = encoder(public_tokenizers.path("byte_bpe_50k.json")), {}
            for r in docs.collect():
                tokens[r.doc_id] = np.append(np.frombuffer(e(r.text), "<u2").astype("<u4"), np.uint32(1))
            total = 0
            for p in out.collect():
                ids = tokens[p.doc_id]
                assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].astype("<u4").tobytes())
                total += p.length
            assert total == sum(len(tokens[d]) for d in before)
            continue
        assert out.columns == names
        docs = out


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
