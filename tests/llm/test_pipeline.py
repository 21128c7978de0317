import zlib

import numpy as np
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from quireframe.llm import pii, toxicity
from quireframe.llm.common import WRITTEN
from quireframe.llm.contract import tokenizer_path
from quireframe.llm.mixing import mix


def stages(spark, sf, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"  # with enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean, single, masked, mixed, packed = stages(spark, sf, docs)
    assert all(d.schema.names == docs.schema.names for d in (clean, single, masked, mixed))

    index = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    kept = {r.doc_id: r for r in clean.collect()}
    assert set(kept) == {d for d, s in scores.items() if s < 0.7} and 0.8 * len(scores) < len(kept) < len(scores)
    before = {r.doc_id: r for r in docs.collect()}
    assert all(before[d] == r for d, r in kept.items())

    rows = [(d, plain_fingerprint(r.text)) for d, r in kept.items()]
    groups = plain_components(rows)
    one = {r.doc_id: r for r in single.collect()}
    assert set(one) == {groups[i] for i in range(len(rows))} and all(kept[d] == r for d, r in one.items())

    spans = {r.doc_id: r.spans for r in pii.find(pii.candidates(single), pii.train(pii.candidates(single))).collect()}
    hidden = {r.doc_id: r for r in masked.collect()}
    assert set(hidden) == set(one) and any(spans.values())
    for d, r in hidden.items():
        text, at, out = one[d].text, 0, []
        for s in sorted(spans[d], key=lambda s: (s.start, s.end)):
            if s.start >= at:
                out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text) and (r.lang, r.source) == (one[d].lang, one[d].source)

    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, masked.collect()))
    order = [r.doc_id for r in mix(masked).orderBy("mix_slot", "mix_offset").collect()]
    assert [r.doc_id for r in mixed.collect()] == order

    tokens = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(hidden)
    for d, own in pieces.items():
        ids = np.array([*tokens.encode(hidden[d].text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_run(spark, sf):
    before = len(WRITTEN)
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert len(WRITTEN) == before + 1


def test_stages_with_hard_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "en", None, 0), (7, "", None, "s", None), (7, "", None, "s", None)], docs.schema)
    *most, packed = stages(spark, sf, odd)
    assert [d.count() for d in most] == [4, 1, 1, 1] and [(r.doc_id, r.length) for r in packed.collect()] == [(7, 1)]
    assert [d.count() for d in stages(spark, sf, docs.limit(0))] == [0] * 5
