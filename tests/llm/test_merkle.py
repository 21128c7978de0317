import zlib
from hashlib import sha256

import pytest

from quireframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """(root, for each node its proof, for each node a function that folds a digest)"""
    proofs, places, level = [[] for _ in nodes], [[] for _ in nodes], list(nodes)
    at = list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for i, p in enumerate(at):
            run, k = runs[p // 3], p % 3
            proofs[i] += run[:k] + run[k + 1 :]
            places[i].append((run[:k], run[k + 1 :]))
        at = [p // 3 for p in at]
        level = [h(*r) for r in runs]
    return level[0], proofs, places


def folded(digest, places):
    for left, right in places:
        digest = h(*left, digest, *right)
    return digest


def plain(rows):
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        cut = text if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 2 else text.replace("\n", "")
        by.setdefault(source, []).append((doc_id, plain_leaf(doc_id, source, lang, n_chars, text), plain_leaf(doc_id, source, lang, n_chars, cut)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: plain_tree([leaf for _, leaf, _ in by[s]]) for s in order}
    root, up_proofs, up_places = plain_tree([trees[s][0] for s in order]) if order else ("", [], [])
    out = []
    for i, s in enumerate(order):
        for (doc_id, leaf, shown), proof, places in zip(by[s], trees[s][1], trees[s][2], strict=True):
            got = folded(shown, places + up_places[i])
            out.append((doc_id, leaf, trees[s][0], root, h(*proof, *up_proofs[i]), got, got == root))
    return out


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_hard_rows(spark):
    check(spark, [])
    check(spark, [(1, "a\nb", "en", "s", 3)])
    rows = [(None, None, None, None, None), (None, "x\ny", None, None, 3), (5, None, "de", None, None), (5, "", "", "", 0), (5, "", "", "", 0), (7, "z\n", "en", "é", 1), (8, "\U0001f600\n\n", "en", "z", -1)]
    check(spark, rows * 2 + [(i, "line\n" * i, "en", "hot", i) for i in range(-20, 40)])


def test_trees_of_several_blocks(spark):
    """One source of more than two blocks, with a last block that is one node, and more sources than a block holds."""
    rows = [(i, f"text {i}\n", "en", "hot", i) for i in range(2 * merkle.BLOCK + 1)] + [(10_000 + i, "x\n", None, f"s{i}", i) for i in range(merkle.BLOCK + 5)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_unwind_and_fold_against_a_plain_tree(n):
    nodes = [h(str(i)) for i in range(n)]
    proofs = [bytearray() for _ in nodes]
    root, plain_proofs, _ = plain_tree(nodes)
    assert merkle.unwind([x.encode() for x in nodes], merkle.height_of(n), proofs).decode() == root
    assert [p.decode() for p in proofs] == ["".join(p) for p in plain_proofs]
    for i, node in enumerate(nodes):
        raw = bytes.fromhex(proofs[i].decode())
        assert merkle.fold(bytes.fromhex(node), raw, merkle.path_of(i, n)).hex() == root
        assert n == 1 or merkle.fold(bytes.fromhex(h("other")), raw, merkle.path_of(i, n)).hex() != root


def test_query_against_a_plain_version(spark):
    from quireframe.llm.contract import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    want = plain([tuple(r) for r in docs])
    assert sorted(map(tuple, QUERIES["op12_merkle"](spark, sf).collect())) == sorted(want)
    assert 0 < sum(r[-1] for r in want) < len(want)
