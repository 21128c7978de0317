import zlib
from collections import defaultdict

import numpy as np
import pytest

from quireframe.llm.contract import op9_packing, tokenizer_path
from quireframe.llm.packing import Packer, TokenIds, pack

TEXTS = ["", None, "a", "one two  three\n four", " lead", "trail ", "x\n\ny z", "don't <|endoftext|> stop  now", "\0 a b", "word " * 3000, "é" * 5000]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_chunked_ids_are_the_tokenizers_ids():
    plain = tokenizer()
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        got = TokenIds(tokenizer_path()).of(texts)
        assert np.frombuffer(got[7], "<u4").tolist().count(50256) == 1  # an added token's text is its id
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, docs, size):
    plain = tokenizer()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & (at - 1) == 0


def test_pieces_cover_every_document_once(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string")
    check(pack(df, tokenizer_path(), size=64, windows=2).collect(), dict(enumerate(TEXTS)), 64)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op9_packing(spark, sf).collect(), docs, 1024)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    rows = pack(twice, tokenizer_path()).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 6 and any(r.doc_id is None for r in rows)


def test_best_fit_keeps_few_windows_open():
    p = Packer(8, 2, 0)
    for d, n in enumerate([5, 4, 3, 6]):
        p.add(d, b"\1\0\0\0" * n)
        assert len(p.open) <= 2
    assert [(r[0], r[2], r[5], r[6]) for r in p.rows][:2] == [(0, 5, 0, 0), (2, 3, 0, 5)]
    with pytest.raises(ValueError):
        Packer(6, 1, 0)
