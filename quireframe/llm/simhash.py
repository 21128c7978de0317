"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.llm.common import Cut, components

SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; see fingerprints()."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k, join, digest = words_per_shingle, b" ".join, xxhash.xxh64_intdigest
    hashes = [digest(join(words[i : i + k]), SEED) for i in range(max(1, len(words) - k + 1))]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long): each row's fingerprint, as the signed long with the same bits.

    A-Z are lower-cased; words are runs without ASCII white space; a shingle is so many words joined by spaces
    (a shorter text is one shingle), with repeats; a bit is 1 if it is set in over half of the shingles' XXH64 values.
    Null texts and texts without words have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words_per_shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: int | np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def best_radius(distances: np.ndarray, limit: int) -> tuple[int, int, int]:
    """(radius, inside, outside): the radius that keeps both sides small, those near the border counting on both."""
    upto = np.concatenate([np.zeros(limit + 1, np.int64), np.bincount(distances.astype(np.int64), minlength=65).cumsum()])  # upto[r + limit] are nearer than r
    radius = np.arange(1, 65)
    inside, outside = upto[radius + limit], len(distances) - upto[radius]
    best = int(np.argmin(inside**2 + outside**2))
    return int(radius[best]), int(inside[best]), int(outside[best])


def vantage_tree(sample: np.ndarray, depth: int, limit: int = 2) -> list[tuple[int, int]]:
    """A complete binary tree over unsigned fingerprints, as a heap of (vantage point, radius).

    A point goes inside where its distance from the vantage point is less than the radius, see best_radius(). The
    vantage point is the candidate for which the sample's two sides are smallest.
    """
    nodes: list[tuple[int, int]] = []
    parts = [sample]
    for _ in range(depth):
        nxt = []
        for part in parts:
            if len(part) < 2:
                nodes.append((int(part[0]) if len(part) else 0, 32))
            else:
                tries = part[:: max(1, len(part) // 8)][:8]
                found = [best_radius(_distance(part, v), limit) for v in tries]
                best = int(np.argmin([a * a + b * b for _, a, b in found]))
                nodes.append((int(tries[best]), found[best][0]))
            d = _distance(part, np.uint64(nodes[-1][0])).astype(np.int64) if len(part) else np.zeros(0)
            nxt += [part[d < nodes[-1][1]], part[d + limit >= nodes[-1][1]]]  # as all points will be dealt
        parts = nxt
    return nodes


def leaves_of(points: np.ndarray, nodes: list[tuple[int, int]], depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in which each point must be compared: (index of the point, leaf), some points in several leaves.

    By the triangle inequality a point outside lies within ``limit`` of one inside only if the inner one is at less
    than limit from the radius. So each point follows its own side, and an inner one so near the border is also
    carried outside. Any two points within the limit then meet in at least one leaf.
    """
    index, at = np.arange(len(points)), np.zeros(len(points), np.int64)
    table = np.array([v for v, _ in nodes], np.uint64)
    radius = np.array([r for _, r in nodes], np.int64)
    for level in range(depth):
        node = at + (1 << level) - 1
        d = _distance(points[index], table[node]).astype(np.int64)
        inside = d < radius[node]
        border = inside & (d + limit >= radius[node])
        index = np.concatenate([index, index[border]])
        at = np.concatenate([2 * at + ~inside, 2 * at[border] + 1])
    return index, at


class Links:
    """Union-find over positions; keeps the smallest as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def close_pairs(points: np.ndarray, limit: int, leaf: int = 192, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all distinct pairs of points within the limit, in blocks; a pair may come more than once.

    The points are split by vantage points as in leaves_of() until a part is small or no longer splits; parts are
    compared block by block.
    """
    stack = [np.arange(len(points))]
    while stack:
        part = stack.pop()
        if len(part) > leaf:
            own = points[part]
            found = [(d, *best_radius(d, limit)) for v in own[:: max(1, len(own) // 4)][:4] for d in [_distance(own, v).astype(np.int64)]]
            d, r, _, outside = min(found, key=lambda x: x[2] ** 2 + x[3] ** 2)
            if outside < 0.9 * len(part):
                stack += [part[d < r], part[d + limit >= r]]
                continue
        for a in range(0, len(part), block):
            left = part[a : a + block]
            for b in range(a, len(part), block):
                right = part[b : b + block]
                i, j = np.nonzero(_distance(points[left][:, None], points[right][None, :]) <= limit)
                keep = left[i] < right[j]
                yield left[i[keep]], right[j[keep]]


def part_masks(parts: int) -> list[int]:
    """The 64 bits as so many runs of about equal length."""
    ends = [64 * k // parts for k in range(parts + 1)]
    return [(1 << high) - (1 << low) for low, high in zip(ends, ends[1:], strict=False)]


def equal_part_pairs(points: np.ndarray, mask: int, limit: int, run: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """close_pairs() of the points that agree on all bits of the mask.

    Points are sorted by those bits; short runs of equal ones are compared at each distance in the order at once, runs
    of more than ``run`` points through vantage points.
    """
    part = points & np.uint64(mask)
    order = np.argsort(part, kind="stable")
    part, points = part[order], points[order]
    starts = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0] if len(part) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(part)])
    short = np.repeat(sizes <= run, sizes)
    for k in range(1, run):
        i = np.nonzero(short[:-k] & (part[k:] == part[:-k]))[0]
        if not len(i):
            break
        i = i[_distance(points[i], points[i + k]) <= limit]
        yield order[i], order[i + k]
    for at, n in zip(starts[sizes > run].tolist(), sizes[sizes > run].tolist(), strict=True):
        for i, j in close_pairs(points[at : at + n], limit):
            yield order[at + i], order[at + j]


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), one row per document; settings as of groups()."""
    return groups(docs, **settings).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def groups(docs: DataFrame, limit: int = 2, words_per_shingle: int = 3, parts: int | None = 1, per_shard: int = 32768, least_depth: int = 4, sample: int = 1 << 18) -> DataFrame:
    """(doc_id long, fp long, g long, component_id long), one row per document; g names the group.

    Fingerprints link where at most ``limit`` bits differ, equal ones included; component_id is the smallest doc_id
    reachable. Equal fingerprints are one point, so a large group of copies is one row. A vantage-point tree over the
    Hamming distance of all bits, fitted on about ``sample`` points (by hash), deals all points into 2^depth shards; by
    the triangle inequality only points within the limit of a border may have a partner across it, and those go to the
    shard across it too (see leaves_of), so no link is lost. That deals about a fifth more at each level. A shard holds
    about ``per_shard`` points, or the points over sample / 16 where there are more; it is split by vantage points of its
    own in the same way until parts are small, and hands on only a spanning forest of its links. Links between shards
    meet in components().

    With ``parts`` over 1 (None: limit + 1) the bits are cut into as many runs with a tree each: two points within the limit differ in at
    most limit // parts bits of one. With limit + 1 parts that is no bit, each point is dealt ``parts`` times at any
    number of points, and shards find equal parts by sorting.

    Null texts count as empty; empty texts have fingerprint zero and so form one component. Rows with a null doc_id
    keep it; they take part in links, and a component of null ids alone has component_id null. Repeated rows come out
    as often as they went in. An empty table gives no rows. Other columns are left out.
    """
    cut = Cut(docs.sparkSession)
    by_doc = cut(fingerprints(docs, words_per_shingle), "fingerprints")
    points = cut(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    linked = linked_points(points.select("fp"), cut, limit, parts or limit + 1, per_shard, least_depth, sample)
    group = F.coalesce("component", "fp")
    named = points.join(linked, points["fp"] == linked["node"], "left").select("fp", "least", group.alias("g"))
    named = cut(named, "named")
    least = cut(named.groupBy("g").agg(F.min("least").alias("component_id")), "ids")
    classes = cut(named.join(least, "g").select(F.col("fp").alias("p"), "g", "component_id"), "classes", (points, named, least))
    return by_doc.join(classes, by_doc["fp"] == classes["p"]).select("doc_id", "fp", "g", "component_id")


def representatives(docs: DataFrame, words_per_shingle: int = 3, **settings) -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates: the one with the smallest doc_id.

    Null ids come last; of rows with the same id the one with the least fingerprint stays, of rows that share both any
    one. Only ids are shuffled with the texts' join, and only those of rows that go; where ids are null or repeated,
    those rows alone are told apart by their fingerprints.
    """
    cut = Cut(docs.sparkSession)
    found = cut(groups(docs, words_per_shingle=words_per_shingle, **settings), "groups")
    mark = "_" * (1 + max(map(len, docs.columns)))  # no column of docs begins like this
    fp, other, best_fp = f"{mark}fp", f"{mark}other", f"{mark}best_fp"
    own = docs["doc_id"].cast("long")
    gone = cut(found.where("doc_id != component_id").select(F.col("doc_id").alias(other)).distinct(), "gone")
    odd = cut(found.groupBy(F.col("doc_id").alias(other)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(other).isNull()).select(other), "odd")
    if not odd.take(1):
        return docs.join(gone, own == F.col(other), "left_anti")
    best = found.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")).alias("b")).select(F.col("b.doc_id").alias(other), F.col("b.fp").alias(best_fp))
    schema = T.StructType([*docs.schema, T.StructField(fp, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            fps = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, fp])

    told = docs.join(odd, own.eqNullSafe(F.col(other)), "left_semi").mapInArrow(add, schema).dropDuplicates(["doc_id", fp])
    told = told.join(best, F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(fp) == F.col(best_fp)), "left_semi").drop(fp)
    return docs.where(own.isNotNull()).join(gone.unionByName(odd), own == F.col(other), "left_anti").unionByName(told)


def linked_points(points: DataFrame, cut: Cut, limit: int, parts: int, per_shard: int, least_depth: int, sample: int) -> DataFrame:
    """(node, component) of the distinct points (fp long) that have a link."""
    count = points.count()
    depth = max(least_depth, min(int(np.ceil(np.log2(max(1, count) / per_shard))), int(np.log2(sample / 16))))
    step = max(1, -(-count // sample))
    # About ``sample`` numbers, to which the trees are fitted; all points are dealt.
    chosen = points.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    masks, apart = part_masks(parts), limit // parts
    trees = [vantage_tree(chosen & np.uint64(m), depth, apart) for m in masks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, (mask, nodes) in enumerate(zip(masks, trees, strict=True)):
                index, leaf = leaves_of(own.view(np.uint64) & np.uint64(mask), nodes, depth, apart)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * parts + k), pa.array(own[index])], names=["shard", "fp"])

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        mask = masks[int(shard["shard"].iloc[0]) % parts]
        own = np.unique(shard["fp"].to_numpy(np.int64).view(np.uint64))
        links = Links(len(own))
        for i, j in close_pairs(own, limit) if apart else equal_part_pairs(own, mask, limit):
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                links.join(x, y)
        found = np.array([(i, links.root(i)) for i in np.nonzero(links.parent != np.arange(len(own)))[0]], np.int64).reshape(-1, 2)
        signed = own.view(np.int64)
        return pd.DataFrame({"a": signed[found[:, 0]], "b": signed[found[:, 1]]})

    edges = points.mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInPandas(link, "a long, b long")
    return components(edges, cut)
