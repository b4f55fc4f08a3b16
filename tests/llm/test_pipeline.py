import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from ledgerloom.llm import toxicity
from test_decontaminate import brute as windows
from test_near_dedup import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_against_plain_versions(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    text = {r.doc_id: r.text for r in docs.collect()}
    left = {d: t for d, t in text.items() if toxicity._logistic(model, min(toxicity.evidence(model, t)[0], 50.0)) < toxicity.THRESHOLD}
    last = {t: d for d, t in sorted(left.items())}
    left = {d: left[d] for d in last.values()}
    left = {d: left[d] for d, g in groups(list(left.items())).items() if g[2]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for d, t in left.items() if not windows(t, items)[4]}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in left.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(text) > len(got) > 20


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
