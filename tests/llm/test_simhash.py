import numpy as np
import xxhash

from quireframe.llm.common import Cut, components
from quireframe.llm.contract import op10_simhash
from quireframe.llm.simhash import close_pairs, equal_part_pairs, fingerprint, leaves_of, near_duplicates, part_masks, representatives, vantage_tree


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, limit=2):
    """By all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= limit:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return {i: min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(rows))}


def test_fingerprint():
    for t in ["", None, "  \n", "One", "one two", "One two THREE", "É é x " * 40, "a b c a b c a b c d"]:
        assert fingerprint(t) == plain_fingerprint(t)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    chain = np.array([(1 << i) - 1 for i in range(64)], np.uint64)
    points = np.unique(np.concatenate([base, near, near ^ np.uint64(1 << 40), chain]))
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if int(points[i] ^ points[j]).bit_count() <= 2}
    assert {(i, j) for a, b in close_pairs(points, 2, leaf=8, block=16) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == want
    for depth in (0, 1, 5):
        index, leaf = leaves_of(points, vantage_tree(points[::3], depth), depth, 2)
        homes = {}
        for i, x in zip(index.tolist(), leaf.tolist(), strict=True):
            homes.setdefault(i, set()).add(x)
        assert all(homes[i] & homes[j] for i, j in want)


def test_parts_lose_no_pair_and_deal_each_point_once():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    family = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    points = np.unique(np.concatenate([base, family, base[:500] ^ np.uint64(1 << 63 | 1), np.array([0, 1, 3, 2**64 - 1], np.uint64)]))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))
    got = set()
    for mask in part_masks(3):
        part = points & np.uint64(mask)
        for depth in (1, 7):
            index, leaf = leaves_of(part, vantage_tree(part[::3], depth, 0), depth, 0)
            assert sorted(index.tolist()) == list(range(len(points)))
            by_part = {}
            for i, x in zip(index.tolist(), leaf.tolist(), strict=True):
                assert by_part.setdefault(int(part[i]), x) == x  # equal parts meet
        got |= {tuple(sorted(p)) for i, j in equal_part_pairs(points, mask, 2) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == want and sum(part_masks(3)) == 2**64 - 1


def test_whole_trees_and_other_limits(spark):
    rows = [(i, " ".join(f"w{(i // 3 * 31 + j) % 211 if j % 40 != i % 3 else i}" for j in range(120))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    for limit, parts in ((2, 1), (4, 2), (9, None)):
        want = plain_components(prints, limit)
        got = {r.doc_id: r.component_id for r in near_duplicates(df, limit=limit, parts=parts, per_shard=16).collect()}
        assert got == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (None, 3), (900, 700), (800, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Cut(spark)).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {500: 500} | dict.fromkeys((700, 800, 900), 700)


def check(rows, docs):
    want = plain_components([(d, plain_fingerprint(t)) for d, t in docs])
    expected = sorted(((d is None, d or 0, f"{plain_fingerprint(t):016x}", want[i] or -1) for i, (d, t) in enumerate(docs)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id or -1) for r in rows) == expected


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op10_simhash(spark, sf).collect(), docs)


def test_hard_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(30000))
    docs = [(5, ""), (4, None), (9, "a b c d"), (9, "a b c d"), (3, "A B c D"), (None, "x y z"), (7, long), (6, long + " end")]
    df = spark.createDataFrame([(*d, "fp", 1) for d in docs], "doc_id long, text string, fp string, component_id int")
    check(near_duplicates(df).collect(), docs)
    assert near_duplicates(df.limit(0)).count() == 0


def test_representatives(spark):
    docs = [(5, "", 1), (4, None, 2), (9, "a b c d", 3), (9, "a b c d", 4), (3, "A B c D", 5), (None, "x y z", 6), (None, "x y z", 7), (9, "quite another text", 8), (8, "and one more", 9)]
    df = spark.createDataFrame(docs, "doc_id int, text string, gone int")
    got = sorted((r.doc_id or -1, r.text or "") for r in representatives(df).collect())
    assert got == [(-1, "x y z"), (3, "A B c D"), (4, ""), (8, "and one more"), (9, "quite another text")]
    plain = df.where("gone IN (1, 2, 3, 5, 9)")
    assert sorted(r.gone for r in representatives(plain).collect()) == [2, 5, 9]
    assert representatives(df).columns == df.columns
    assert representatives(df.limit(0)).count() == 0
