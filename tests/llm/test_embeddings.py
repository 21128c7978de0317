import math

import numpy as np
from quireframe.llm.contract import op8_embeddings
from quireframe.llm.embeddings import LINKS, Shard, compare, near_duplicates


def brute(rows, threshold=0.9):
    """By all pairs: (vec_id, n_links, component_id, kept) of each row."""
    units = []
    for _, v in rows:
        x = None if not v or any(a is None for a in v) else np.asarray(v, np.float64)
        ok = x is not None and np.isfinite(x).all() and np.abs(x).max() > 0
        units.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, n, least.get(root(i), d), d is not None and d == least.get(root(i), d)) for i, ((d, _), n) in enumerate(zip(rows, links, strict=True))]


def plain(rows):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in rows)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: r for r in op8_embeddings(spark, sf).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    total = sum(n for _, n, _, _ in want)
    assert found >= 0.95 * total and all(got[d].n_links <= n for d, n, _, _ in want)
    assert sum(got[d].component_id == c for d, _, c, _ in want) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_hard_rows(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.95, 0.2, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, a), (3, a), (9, b), (4, c), (5, None), (6, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (10, [math.nan, 1.0, 0.0]), (11, [math.inf, 1.0, 0.0]), (12, [1.0, 0.0]), (13, []), (14, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, key string")
    assert plain(near_duplicates(df).collect()) == sorted(brute(rows))
    assert near_duplicates(df.limit(0)).count() == 0
    twice = near_duplicates(df.where("vec_id = 4").unionByName(df.where("vec_id = 4"))).collect()
    assert plain(twice) == [(4, 1, 4, True)] * 2


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shard(x):
    return Shard(np.arange(len(x)), np.ones(len(x), np.int64), unit(x), 0.9)


def counted(a, b=None):
    """n_links of the nodes of a (and b) by compare(), the beams being audited ones."""
    out = {}
    for kind, nodes, _, n in compare(a, b, a.audited_beam(0.99, 64)[0], 24 if b is None else b.audited_beam(0.99, 64)[0]):
        for d, k in zip(nodes.tolist(), n.tolist(), strict=True):
            out[d] = out.get(d, 0) + (k if kind == LINKS else 0)
    return out


def test_links_of_classes_are_those_of_all_pairs():
    """Groups as tight and as loose as the linking angle, so that classes link wholly, in part and not at all."""
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(40, 24)))
    x = np.concatenate([rng.normal(size=(300, 24)), *(c + rng.normal(size=(30, 24)) * (0.01 + 0.004 * k) for k, c in enumerate(centres))])
    own = shard(x)
    assert len(own.radius) < len(x) and own.radius.max() <= own.angle / 2
    units = unit(x)
    want = (units @ units.T >= 0.9).sum(axis=1) - 1
    got = counted(own)
    assert sum(min(got.get(i, 0), n) for i, n in enumerate(want)) >= 0.99 * want.sum() and all(got.get(i, 0) <= n for i, n in enumerate(want))
    a, b = shard(x[::2]), shard(x[1::2])
    b.nodes, b.names = b.nodes + 10_000, b.names + 10_000
    cross = (unit(x[::2]) @ unit(x[1::2]).T >= 0.9)
    got = counted(Shard.load(a.save()), Shard.load(b.save()))
    assert sum(got.values()) >= 0.99 * 2 * cross.sum()
    assert all(got.get(i, 0) <= n for i, n in enumerate(cross.sum(axis=1))) and all(got.get(10_000 + i, 0) <= n for i, n in enumerate(cross.sum(axis=0)))


def test_audit_widens_the_beam():
    """Links that a narrow beam loses fail the audit, however many others are found."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.eye(1, 24)[0] + 0.02 * rng.normal(size=(600, 24)), rng.normal(size=(900, 24))])
    own = shard(x)
    beam, recall = own.audited_beam(0.99, 256)
    assert recall >= 0.99
    plain = own.near

    def near(leaders, radii, beam):
        q, p = plain(leaders, radii, beam)
        return (q, p) if beam >= 4 * 24 else (q[::2], p[::2])

    own.near = near
    assert own.audited_beam(0.99, 256)[0] >= 96
    own.near = lambda leaders, radii, beam: plain(leaders, radii, beam) if beam >= len(own.radius) else (np.zeros(0, np.int64),) * 2
    assert own.audited_beam(0.99, 256) == (own.audited_beam(0.99, 256)[0], 1.0)


def test_many_links_against_brute_force(spark):
    """Clusters of 80 and 400 near copies, and a loose one: no link is lost, and recall over all is stated."""
    rng = np.random.default_rng(9)
    centres = unit(rng.normal(size=(17, 32)))
    x = np.concatenate([rng.normal(size=(400, 32)), *(c + 0.018 * rng.normal(size=(400 if k < 4 else 80, 32)) for k, c in enumerate(centres[:16])), centres[16] + 0.06 * rng.normal(size=(300, 32)), x_copies(rng)])
    ids = rng.permutation(len(x)) * 3
    units = unit(x)
    links = units @ units.T >= 0.9
    want = {int(d): int(n) - 1 for d, n in zip(ids, links.sum(axis=1), strict=True)}
    df = spark.createDataFrame([(int(d), v.tolist()) for d, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    recall = sum(got[d].n_links for d in want) / sum(want.values())
    assert recall >= 0.999 and all(got[d].n_links <= n for d, n in want.items()), recall
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(np.triu(links, 1)), strict=True):
        a, b = (find(root, k) for k in (i, j))
        root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(x)):
        least[find(root, i)] = min(int(ids[i]), least.get(find(root, i), 1 << 60))
    wrong = sum(got[int(ids[i])].component_id != least[find(root, i)] for i in range(len(x)))
    assert wrong == 0


def x_copies(rng):
    """Two hundred equal vectors and fifty near them."""
    one = rng.normal(size=(1, 32))
    return np.concatenate([np.repeat(one, 200, axis=0), one + 0.05 * rng.normal(size=(50, 32))])


def find(root, i):
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i
