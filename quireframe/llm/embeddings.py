"""Near-duplicate vectors through hierarchical navigable small-world graphs of their classes, one a shard."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.common import Cut, components, delete, new_folder, store_of


def beam_search(links: np.ndarray, x: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, count: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in lockstep: (positions, cosines), each (queries, beam), best first.

    links[i] are node i's neighbours (-1: none); only nodes below ``count`` are there. Each step expands the best
    ``at_once`` nodes of every query's beam that are not expanded yet, until a beam has none. Missing places are -1.
    """
    b = len(queries)
    beam = max(1, min(beam, count))
    seen = np.zeros((b, count + 1), bool)  # the last column takes what is missing
    seen[:, count] = True
    ids = np.full((b, beam + starts.shape[1]), count, np.int64)
    sims = np.full(ids.shape, -np.inf, np.float32)
    done = np.ones(ids.shape, bool)
    first = np.where((starts >= 0) & (starts < count), starts, count)
    first = np.sort(first, axis=1)
    first[:, 1:][first[:, 1:] == first[:, :-1]] = count
    ids[:, : first.shape[1]] = first
    sims[:, : first.shape[1]] = np.where(first < count, np.einsum("bmd,bd->bm", x[np.minimum(first, count - 1)], queries), -np.inf)
    done[:, : first.shape[1]] = first >= count
    np.put_along_axis(seen, first, True, axis=1)
    ids, sims, done = (a[:, :] for a in (ids, sims, done))
    order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
    ids, sims, done = (np.take_along_axis(a, order, axis=1) for a in (ids, sims, done))
    active = np.arange(b)
    while len(active):
        score = np.where(done[active], -np.inf, sims[active])
        w = min(at_once, beam)
        pick = np.argpartition(-score, w - 1, axis=1)[:, :w]
        open_ = np.take_along_axis(score, pick, axis=1) > -np.inf
        go = open_.any(axis=1)
        active, pick, open_ = active[go], pick[go], open_[go]
        if not len(active):
            break
        nodes = np.take_along_axis(ids[active], pick, axis=1)
        flags = done[active]
        np.put_along_axis(flags, pick, True, axis=1)
        near = links[np.where(open_, nodes, 0)]
        near = np.where(open_[:, :, None] & (near >= 0) & (near < count), near, count).reshape(len(active), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = count
        rows = active[:, None]
        near = np.where(seen[rows, near], count, near)
        seen[rows, near] = True
        fresh = near < count
        new = np.full(near.shape, -np.inf, np.float32)
        r, c = np.nonzero(fresh)
        new[r, c] = np.einsum("nd,nd->n", x[near[r, c]], queries[active[r]])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], new], axis=1)
        all_done = np.concatenate([flags, ~fresh], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, keep, axis=1) for a in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isfinite(sims), ids, -1), sims


def diverse(ids: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (-1: none) at most ``most`` neighbours: those nearer to the node than to any chosen
    one first, the nearest of the rest after them."""
    order = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")[:, : 3 * most]
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    n, c = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = np.einsum("ncd,ned->nce", vectors, vectors)
    chosen, closest = np.zeros((n, c), bool), np.full((n, c), -np.inf)
    taken = np.zeros(n, int)
    for j in range(c):
        good = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (taken < most)
        chosen[good, j] = True
        taken[good] += 1
        closest[good] = np.maximum(closest[good], between[good, j])
    rank = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, rank, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """A hierarchical navigable small world over the leaders of unit vectors.

    Each vector has a random highest layer (geometric); vectors go in sorted by it, so that a layer is a beginning of
    the order. They go in by batches: a search from the top layer down finds a batch's candidates. A vector whose
    nearest leader has a cosine of ``join`` or more becomes a member of its class and no node; the others are leaders,
    other leaders of the batch are candidates too, and neighbours are chosen by diverse() in both directions.
    ``of`` has each vector's class, as the leader's place in ``leaders``, which has places in x.
    """

    def __init__(self, x: np.ndarray, join: float = 2.0, degree: int = 16, build_beam: int = 64, batch: int = 256, seed: int = 1):
        n = len(x)
        top = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree)), 8).astype(int)
        order = np.argsort(-top, kind="stable")
        top = top[order]
        self.x, self.exact = np.zeros(x.shape, np.float32), np.zeros(x.shape)
        layers = [int((top >= level).sum()) for level in range(top.max(initial=0) + 1)]
        self.sizes = [0] * len(layers)
        self.links = [np.full((m, degree * (2 if level == 0 else 1)), -1, np.int32) for level, m in enumerate(layers)]
        self.of, leaders = np.zeros(n, np.int64), []
        for at in range(0, n, batch):
            own = order[at : at + batch]
            self.of[own], new = self._insert(np.asarray(x[own], np.float64), top[at : at + batch], build_beam, join)
            leaders.append(own[new])
        self.leaders = np.concatenate([np.zeros(0, np.int64), *leaders])
        self.x = np.ascontiguousarray(self.x[: self.sizes[0]])
        self.links = [own[:m].copy() for own, m in zip(self.links, self.sizes, strict=True)]
        del self.exact

    def _insert(self, exact: np.ndarray, top: np.ndarray, beam: int, join: float) -> tuple[np.ndarray, np.ndarray]:
        """(class of each new vector, which of them are leaders)."""
        new, a = exact.astype(np.float32), self.sizes[0]
        candidates = []
        starts = np.zeros((len(new), 1), np.int64)
        for level in range(len(self.sizes) - 1, -1, -1):
            if self.sizes[level]:
                found, sims = beam_search(self.links[level], self.x, new, starts, beam if top[0] >= level else 4, self.sizes[level])
                starts = found[:, :4]
            else:
                found, sims = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), -np.inf, np.float32)
            candidates.append((found, sims))
        best = found[:, 0]
        joins = (best >= 0) & (np.einsum("nd,nd->n", exact, self.exact[best]) >= join)
        near = exact @ exact.T
        of, own = np.where(joins, best, -1), []
        for i in np.nonzero(~joins)[0].tolist():
            k = int(near[i, own].argmax()) if own else -1
            if k >= 0 and near[i, own[k]] >= join:
                of[i] = a + k
            else:
                of[i] = a + len(own)
                own.append(i)
        own = np.array(own, np.int64)
        self.x[a : a + len(own)], self.exact[a : a + len(own)] = new[own], exact[own]
        inside = near[np.ix_(own, own)].astype(np.float32)
        np.fill_diagonal(inside, -np.inf)
        for level, (found, sims) in zip(range(len(self.sizes) - 1, -1, -1), candidates, strict=True):
            m = int((top[own] >= level).sum())  # the first of them live in this layer
            if not m:
                continue
            width = self.links[level].shape[1]
            peers = np.argsort(-inside[:m, :m], axis=1, kind="stable")[:, : min(m, 2 * width)]
            peer_sims = np.take_along_axis(inside[:m, :m], peers, axis=1)
            ids = np.concatenate([found[own[:m]], np.where(np.isfinite(peer_sims), peers + a, -1)], axis=1)
            chosen = diverse(ids, np.concatenate([sims[own[:m]], peer_sims], axis=1), self.x, width)
            self.links[level][a : a + m] = chosen
            self._back(level, a, chosen)
            self.sizes[level] = a + m
        return of, own

    def _back(self, level: int, a: int, near: np.ndarray) -> None:
        """Link the new nodes' neighbours back to them."""
        links = self.links[level]
        rows, columns = np.nonzero(near >= 0)
        target, source = near[rows, columns].astype(np.int64), rows + a
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, many)
        width = links.shape[1]
        keep = place < 2 * width
        extra = np.full((len(nodes), min(2 * width, int(many.max(initial=0)))), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), many)[keep], place[keep]] = source[keep]
        for at in range(0, len(nodes), 256):
            own = nodes[at : at + 256]
            ids = np.concatenate([links[own].astype(np.int64), extra[at : at + 256]], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("ncd,nd->nc", self.x[np.maximum(ids, 0)], self.x[own])
            links[own] = diverse(ids, sims, self.x, width)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and (single-precision) cosines of about the ``beam`` nearest, best first; of all nodes by brute
        force where the beam holds as many."""
        if beam >= len(self.x):
            sims = queries @ self.x.T
            ids = np.argsort(-sims, axis=1, kind="stable")
            return ids, np.take_along_axis(sims, ids, axis=1)
        starts = np.zeros((len(queries), 1), np.int64)
        for level in range(len(self.sizes) - 1, 0, -1):
            starts = beam_search(self.links[level], self.x, queries, starts, 4, self.sizes[level])[0]
        return beam_search(self.links[0], self.x, queries, starts, beam, self.sizes[0])


#: Slack of angles (radians) and of single-precision cosines: what lies nearer to a bound is worked out exactly.
ANGLE, COSINE = 1e-7, 1e-5


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class Shard:
    """The vectors of a shard in classes of near copies, and a Graph of the classes' leaders.

    A class's members lie within half the linking angle of its leader, so all of them link with each other; two
    classes can have a link only where their leaders are no farther apart than the linking angle and both radii. The
    members of a class stand in a row, the leader first; a class is named by its smallest node.
    """

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, units: np.ndarray, threshold: float):
        self.threshold, self.angle = threshold, float(_angle(np.float64(threshold)))
        self.graph = Graph(units, np.sqrt((1 + threshold) / 2) + 1e-9)
        of, leaders = self.graph.of, self.graph.leaders
        follows = np.ones(len(nodes), bool)
        follows[leaders] = False
        order = np.lexsort((nodes, follows, of))
        self.nodes, self.copies, self.exact = nodes[order], copies[order], np.ascontiguousarray(units[order])
        self.starts = np.searchsorted(of[order], np.arange(len(leaders) + 1))
        first = self.starts[:-1]
        self.radius, self.names, self.weight = np.zeros(len(leaders)), np.zeros(len(leaders), np.int64), np.zeros(len(leaders), np.int64)
        if len(leaders):
            to_leader = _angle(np.einsum("nd,nd->n", self.exact, self.exact[first][of[order]]))
            self.radius = np.where(np.diff(self.starts) > 1, np.maximum.reduceat(to_leader, first) + ANGLE, 0.0)
            self.names, self.weight = np.minimum.reduceat(self.nodes, first), np.add.reduceat(self.copies, first)

    def reach(self, radii: np.ndarray, more: np.ndarray | float) -> np.ndarray:
        """The least cosine at which leaders of classes with these radii can have a link between them."""
        return np.cos(np.minimum(self.angle + radii + more, np.pi)) - COSINE

    def near(self, leaders: np.ndarray, radii: np.ndarray, beam: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(query, class) of all classes found that may have a link with the query's class.

        A query whose whole beam is that near is searched again with a beam four times as wide.
        """
        widest, n = self.radius.max(initial=0), len(self.radius)
        out, pending, width = [], np.arange(len(leaders)), beam
        while len(pending):
            again = []
            step = max(8, min(batch, (64 << 20) // max(1, width * 256)))
            for at in range(0, len(pending), step):
                own = pending[at : at + step]
                ids, sims = self.graph.search(leaders[own], width)
                full = (sims[:, -1] >= self.reach(radii[own], widest)) & (ids.shape[1] < n)
                again.append(own[full])
                r, c = np.nonzero((ids >= 0) & (sims >= self.reach(radii[own][:, None], self.radius[ids])) & ~full[:, None])
                out.append((own[r], ids[r, c]))
            pending, width = np.concatenate(again), 4 * width
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *(q for q, _ in out)]), np.concatenate([empty, *(p for _, p in out)])

    def audited_beam(self, target: float, audit: int, beam: int = 24, seed: int = 2) -> tuple[int, float]:
        """The first beam of a doubling row with which links are found at the target recall or better, and that recall.

        Audited are up to ``audit`` leaders against brute force in two ways: a probe at just the linking angle from
        each, in a random direction, has to find it and whatever else is that near; and each leader has to find the
        other classes that may have a link with its own. Recall is the lesser mean of the shares found by each query
        that has something to find. A beam of all nodes is brute force, so the target is always met.
        """
        n = len(self.radius)
        chosen = np.unique(np.linspace(0, n - 1, min(audit, n)).astype(np.int64))
        own = self.graph.x[chosen].astype(np.float64)
        aside = np.random.default_rng(seed).normal(size=own.shape)
        aside -= np.einsum("nd,nd->n", aside, own)[:, None] * own
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.where(length > 1e-9, aside / np.maximum(length, 1e-9), 0.0)
        cosine = min(1.0, self.threshold + 1e-4)
        probes = cosine * own + np.sqrt(1 - cosine * cosine) * aside
        queries = np.concatenate([probes, own]).astype(np.float32)
        radii = np.concatenate([np.zeros(len(chosen)), self.radius[chosen]])
        true = queries @ self.graph.x.T >= self.reach(radii[:, None], self.radius[None, :])
        true[np.arange(len(chosen)) + len(chosen), chosen] = False
        links = true.sum(axis=1)
        while True:
            q, p = self.near(queries, radii, beam)
            shares = np.bincount(q, true[q, p], len(queries)) / np.maximum(links, 1)
            halves = [shares[half][links[half] > 0] for half in (slice(0, len(chosen)), slice(len(chosen), None))]
            recall = min((float(x.mean()) for x in halves if len(x)), default=1.0)
            if recall >= target or beam >= n:
                return beam, recall
            beam *= 2

    def save(self) -> bytes:
        out = io.BytesIO()
        own = {k: getattr(self, k) for k in ("nodes", "copies", "exact", "starts", "radius", "names", "weight")}
        np.savez(out, threshold=self.threshold, x=self.graph.x, sizes=np.array(self.graph.sizes), **own, **{f"links{i}": x for i, x in enumerate(self.graph.links)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        own, graph = cls.__new__(cls), Graph.__new__(Graph)
        with np.load(io.BytesIO(data)) as f:
            own.threshold, own.angle, own.graph = float(f["threshold"]), float(_angle(f["threshold"])), graph
            for k in ("nodes", "copies", "exact", "starts", "radius", "names", "weight"):
                setattr(own, k, f[k])
            graph.x, graph.sizes = f["x"], f["sizes"].tolist()
            graph.links = [f[f"links{i}"] for i in range(len(graph.sizes))]
        return own


def links_between(a: Shard, b: Shard, p: np.ndarray, q: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's vectors, links of b's vectors, which pairs link) over the class pairs (p of a, q of b).

    Links count copies. Classes of one vector are compared in one go. Else each member of p is held against q's
    leader: nearer than the linking angle less q's radius it links with all of q, beyond the angle and the radius with
    none, and only in between its cosines with all of q are worked out, in blocks of ``most``.
    """
    out_a, out_b = np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
    linked = np.zeros(len(p), bool)
    single = (np.diff(a.starts)[p] == 1) & (np.diff(b.starts)[q] == 1)
    for at in range(0, int(single.sum()), 1 << 16):
        own = np.nonzero(single)[0][at : at + (1 << 16)]
        i, j = a.starts[p[own]], b.starts[q[own]]
        good = np.einsum("nd,nd->n", a.exact[i], b.exact[j]) >= a.threshold
        linked[own] = good
        np.add.at(out_a, i[good], b.copies[j[good]])
        np.add.at(out_b, j[good], a.copies[i[good]])
    for k in np.nonzero(~single)[0].tolist():
        rows, other = slice(a.starts[p[k]], a.starts[p[k] + 1]), slice(b.starts[q[k]], b.starts[q[k] + 1])
        x, y, radius = a.exact[rows], b.exact[other], b.radius[q[k]]
        cosines = x @ y[0]
        angles = _angle(cosines)
        sure = angles + radius <= a.angle - ANGLE if radius else cosines >= a.threshold
        open_ = np.nonzero(~sure & (angles - radius <= a.angle + ANGLE))[0] if radius else np.zeros(0, np.int64)
        out_a[rows][sure] += b.weight[q[k]]
        out_b[other] += a.copies[rows][sure].sum()
        linked[k] = sure.any()
        step = max(1, most // len(y))
        for at in range(0, len(open_), step):
            own = open_[at : at + step]
            near = x[own] @ y.T >= a.threshold
            out_a[rows][own] += near @ b.copies[other]
            out_b[other] += a.copies[rows][own] @ near
            linked[k] |= near.any()
    return out_a, out_b, linked


def _unit(vector: list | None) -> np.ndarray | None:
    """The vector in double precision over its length; None if it is null or zero or holds what is not a finite number."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.asarray(vector, np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top  # so that no square overflows
    return x / np.linalg.norm(x)


ROWS = "vec_id long, key string, dim int, unit binary"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, unit): unit vectors as double bytes, key a digest of the vector's own values; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [None if i is None else _unit(v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            keys = [None if u is None else hashlib.sha1(u.tobytes()).hexdigest() for u in units]
            dims = [None if u is None else len(u) for u in units]
            raw = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "key", "dim", "unit"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, ROWS)


FOUND = "kind int, a long, b long, n long"
LINKS, EDGE, MEMBER = 0, 1, 2


def compare(a: Shard, b: Shard | None, beam_a: int, beam_b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, a, b, n) columns of what two shards, or one with itself (b None), have between them.

    LINKS: node a has n more links. EDGE: classes a and b link (a spanning forest). MEMBER: node a is in class b.
    Every class of each shard is searched in the other.
    """
    other = a if b is None else b
    q, p = a.near(other.graph.x, other.radius, beam_a)
    if b is None:
        keep = p != q
        found = np.unique(np.minimum(p, q)[keep] * len(a.radius) + np.maximum(p, q)[keep])
    else:
        i, j = b.near(a.graph.x, a.radius, beam_b)
        found = np.unique(np.concatenate([p * len(b.radius) + q, i * len(b.radius) + j]))
    p, q = found // max(1, len(other.radius)), found % max(1, len(other.radius))
    links_a, links_b, linked = links_between(a, other, p, q)
    if b is None:
        of = np.repeat(np.arange(len(a.radius)), np.diff(a.starts))
        links_a += links_b + a.weight[of] - a.copies
        away = a.nodes != a.names[of]
        yield MEMBER, a.nodes[away], a.names[of][away], np.zeros(int(away.sum()), np.int64)
    else:
        yield LINKS, b.nodes[links_b > 0], b.nodes[links_b > 0], links_b[links_b > 0]
    yield LINKS, a.nodes[links_a > 0], a.nodes[links_a > 0], links_a[links_a > 0]
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = []
    for x, y in zip(a.names[p[linked]].tolist(), other.names[q[linked]].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            tree.append((x, y))
    edges = np.array(tree, np.int64).reshape(-1, 2)
    yield EDGE, edges[:, 0], edges[:, 1], np.zeros(len(edges), np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, per_shard: int = 50_000, least_shards: int = 8, recall: float = 0.99, audit: int = 256) -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean), one row per row of (vec_id, embedding).

    Vectors link at a cosine of ``threshold`` or more, verified in double precision. Equal vectors are one node that
    counts as many. Nodes are dealt into shards by hash; a Shard holds them in classes of near copies, so that the
    links inside a class, and mostly those between classes, are counted without looking at pairs. The beam of each
    shard's Graph is widened until an audit finds ``recall`` of what it looks for. Then each pair of shards is a task:
    every class of either is searched in the other's graph, and the links of the classes found are counted for both
    ends. Shards lie as files in the shared folder; a task holds two, so ``per_shard`` vectors bound its memory. Every
    vector's class is searched in every shard, which is the method and grows with the vectors times the shards.

    Null, zero and non-finite vectors link with nothing (n_links 0, component_id their own id); so do rows whose
    vec_id is null (component_id null, kept false). Vectors of different lengths never link. Repeated rows are copies
    of each other. Other columns are left out. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    cut = Cut(spark)
    rows = cut(unit_vectors(vectors), "vectors")
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    nodes = cut(nodes, "nodes")
    folder = new_folder(spark, "graphs")
    sizes = {r.dim: r["count"] for r in nodes.groupBy("dim").count().collect()}

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        dim = int(shard["dim"].iloc[0])
        shard = shard.sort_values("node")
        units = np.frombuffer(b"".join(shard["unit"]), np.float64).reshape(-1, dim)
        own = Shard(shard["node"].to_numpy(np.int64), shard["copies"].to_numpy(np.int64), units, threshold)
        beam, found = own.audited_beam(recall, audit)
        system, at = store_of(folder)
        system.create_dir(at, recursive=True)
        name = f"graph-{uuid.uuid4().hex}.npz"
        with system.open_output_stream(f"{at}/{name}") as out:
            out.write(own.save())
        return pd.DataFrame({"dim": [dim], "shard": [int(shard["shard"].iloc[0])], "path": [f"{folder}/{name}"], "beam": [beam], "recall": [found]})

    number = F.lit(1)
    for dim, n in sizes.items():
        number = F.when(F.col("dim") == dim, max(least_shards, -(-n // per_shard))).otherwise(number)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("key"), number))
    graphs = cut(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, path string, beam int, recall double"), "graphs")
    other = graphs.select(F.col("dim").alias("dim_b"), F.col("shard").alias("shard_b"), F.col("path").alias("path_b"), F.col("beam").alias("beam_b"))
    # A row for each pair of shards: the tasks, and no rows of data.
    pairs = cut(graphs.join(other, (F.col("dim") == F.col("dim_b")) & (F.col("shard") <= F.col("shard_b"))).select("path", "beam", "path_b", "beam_b"), "pairs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(path: str) -> Shard:
            system, at = store_of(path)
            with system.open_input_file(at) as source:
                return Shard.load(source.read())

        last, a = None, None
        for batch in batches:
            for path, beam, path_b, beam_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != last:
                    last, a = path, opened(path)
                for kind, *columns in compare(a, None if path == path_b else opened(path_b), beam, beam_b):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names=[x.split()[0] for x in FOUND.split(", ")])

    tasks = max(1, min(pairs.count(), 100_000))
    found = cut(pairs.repartitionByRange(tasks, "path", "path_b").sortWithinPartitions("path", "path_b").mapInArrow(search, FOUND), "found")
    counts = found.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("n"))
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("member"), F.col("b").alias("class"))
    groups = cut(components(found.where(F.col("kind") == EDGE).select("a", "b"), cut).select(F.col("node").alias("named"), "component"), "groups")
    own = F.coalesce("class", "node")
    known = nodes.select("key", "node", "copies").join(counts, F.col("node") == F.col("linked"), "left").join(members, F.col("node") == F.col("member"), "left")
    known = known.withColumn("class", own).join(groups, F.col("class") == F.col("named"), "left")
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    known = cut(known.select(F.col("key").alias("of"), n_links.alias("n_links"), F.coalesce("component", "class").alias("component_id")), "known", (nodes, graphs, pairs, found, groups))
    delete(spark, folder)
    out = rows.join(known, rows["key"] == known["of"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
