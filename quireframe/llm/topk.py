"""Exact top-k search by inner product through a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest norm of a table, a candidate c becomes
(c, sqrt(M^2 - |c|^2)) and a query q (q, 0), and their squared distance is |q|^2 + M^2 - 2 q.c. Candidates are keyed by
their nearest pivot and the distance to it; an annulus is a range of distances around a pivot, stored as blocks in order
of distance. A query expands annuli in order of the least distance that the triangle inequality leaves there, and stops
at the first whose bound is beyond its k-th best.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quireframe.llm.common import Cut

#: Rows and bytes of vectors in a block, queries in a batch, rows that pivots are fitted on (in expectation), most annuli.
BLOCK_ROWS, BLOCK_BYTES, BATCH, SAMPLE, MOST_CELLS = 1024, 1 << 19, 256, 4096, 4096
#: Annuli that a query expands in each round but the last, which takes all that its bound leaves.
ROUNDS = (1, 8)
#: Share of |q|^2 + M^2 by which bounds are loosened, far above what rounding does.
SLACK = 1e-9
EXACT = float(1 << 53)


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def whole_numbers(vectors: DataFrame, scale: float) -> DataFrame:
    """(row, vec_id, dim, norm, vec): floor(scale * x) of each component as doubles, for vectors without null or
    non-finite components (before or after scaling). norm is the squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, vec_id, x in zip(batch["row"].to_pylist(), batch["vec_id"].to_pylist(), batch["embedding"], strict=True):
                if not x.is_valid or x.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all() and np.isfinite(norm := float(v @ v)):
                    out.append((row, vec_id, len(v), norm, v.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["row", "vec_id", "dim", "norm", "vec"])

    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return own.mapInArrow(run, "row long, vec_id long, dim int, norm double, vec binary")


class Pivots:
    """Pivots of the vectors of one length, in the space with the additional coordinate, and the annuli around them.

    Fitted on a sample: Lloyd's means as pivots (any points serve the triangle inequality), quantiles of the sample's
    distances as the annuli's edges. Every vector is keyed by them; the fit decides on speed alone.
    """

    def __init__(self, sample: np.ndarray, norms: np.ndarray, most: float, rows: int, steps: int = 5):
        self.most = most
        cells = int(np.clip(rows // BLOCK_ROWS, 1, MOST_CELLS))
        count = int(np.clip(round(2 * cells**0.5), 1, min(256, len(sample))))
        self.rings = max(1, min(MOST_CELLS // count, -(-cells // count)))
        points = self.lifted(sample, norms)
        centres = points[np.linspace(0, len(points) - 1, count).astype(int)].copy()
        for _ in range(steps):
            near = distances(points, centres).argmin(axis=1)
            for p in range(count):
                if (own := near == p).any():
                    centres[p] = points[own].mean(axis=0)
        self.centres = centres
        reach = distances(points, centres)
        near, self.edges = reach.argmin(axis=1), np.zeros((count, self.rings - 1))
        for p in range(count):
            own = reach[near == p, p]
            self.edges[p] = np.quantile(own if len(own) else np.zeros(1), np.arange(1, self.rings) / self.rings)

    def lifted(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.most - norms))[:, None]], axis=1)

    def keys(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(annulus, distance to its pivot) of each vector."""
        reach = distances(self.lifted(x, norms), self.centres)
        near = reach.argmin(axis=1)
        radius = np.take_along_axis(reach, near[:, None], axis=1)[:, 0]
        ring = (radius[:, None] >= self.edges[near]).sum(axis=1)
        return near * self.rings + ring, radius

    def from_queries(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to all pivots."""
        return distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.centres)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed from differences where rounding could matter (one pass for each of b)."""
    out = np.empty((len(a), len(b)))
    for i, y in enumerate(b):
        d = a - y
        out[:, i] = np.sqrt(np.einsum("nd,nd->n", d, d))
    return out


def beyond(away: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The least distance to a point whose distance to a pivot lies in [least, most], for one as far from the pivot as ``away``."""
    return np.maximum(0.0, np.maximum(away - most, least - away))


def keyed(rows: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """The rows with the annulus (cell) and distance (radius) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, norms, data = batch["dim"].to_numpy(), batch["norm"].to_numpy(), batch["vec"].to_pylist()
            cell, radius = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(data[i] for i in own), np.float64).reshape(len(own), dim)
                cell[own], radius[own] = pivots[dim].keys(x, norms[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("cell int, radius double").fields]))


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """(dim, cell, rows, least, far, data): runs of rows of one annulus in order of distance, at most ``most`` and
    BLOCK_BYTES of vectors in each. Sorted by ranges, so an annulus with very many rows lies in many partitions."""
    keys = ["dim", "cell", "radius", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            dim, cell = held[0][:2]
            radius, row, vec_id, data = (list(c) for c in list(zip(*held, strict=True))[2:])
            ids = np.array([0 if i is None else i for i in vec_id], np.int64)
            body = packed(rows=np.array(row, np.int64), ids=ids, unnamed=np.array([i is None for i in vec_id]), x=np.frombuffer(b"".join(data), np.float64).reshape(len(data), dim))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((dim, cell, len(row), radius[0], radius[-1], body), kinds, strict=True)], names=["dim", "cell", "rows", "least", "far", "data"])

        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in (*keys, "vec_id", "vec")), strict=True):
                if held and (r[:2] != held[0][:2] or len(held) >= min(most, max(1, BLOCK_BYTES // max(1, 8 * r[0])))):
                    yield block()
                    held.clear()
                held.append(r)
        if held:
            yield block()

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, "dim int, cell int, rows long, least double, far double, data binary")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: as doubles while every partial sum is exact, else by Python's integers, and at
    most what a long holds."""
    longest = np.sqrt(np.einsum("nd,nd->n", q, q).max(initial=0.0) * np.einsum("nd,nd->n", x, x).max(initial=0.0))
    if longest < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


FOUND = "batch long, q int, score long, vec_id long, unnamed boolean, row long"


def score(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a block for each query of a batch whose bound lets it in, if they are not below its k-th best."""
    for batch in batches:
        out = []
        for number, asked, least, far, data in zip(*(batch[c].to_pylist() for c in ("batch", "asked", "least", "far", "data")), strict=True):
            a = unpacked(asked)
            worth = (a["reach"] - beyond(a["away"], np.float64(least), np.float64(far)) ** 2) / 2 + SLACK * a["reach"] >= a["floor"]
            if not worth.any():
                continue
            b = unpacked(data)
            for q, query, floor, s in zip(a["q"][worth], a["rows"][worth], a["floor"][worth], products(a["x"][worth], b["x"]), strict=True):
                good = np.flatnonzero((s >= floor) & (b["rows"] != query))
                below = -np.unique(s[good], return_inverse=True)[1]
                best = good[np.lexsort((b["rows"][good], b["ids"][good], b["unnamed"][good], below))[:k]]
                out += [(number, int(q), int(s[i]), int(b["ids"][i]), bool(b["unnamed"][i]), int(b["rows"][i])) for i in best]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


STATE = "batch long, dim int, data binary"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): the k rows with the largest inner products for each query.

    vectors has (vec_id, embedding). Components become floor(scale * x); queries are the rows whose vec_id ``every``
    divides, candidates all rows but the query's own; ties go to the smaller vec_id. Results are exact: rounding only
    loosens bounds, and products are computed in whole numbers (those beyond a long count as its ends).

    Blocks of an annulus and batches of up to 256 neighbouring queries meet in a join on the annulus, whose sides Spark
    may split; a query comes along only where its bound lets it, first with its nearest annulus, then with eight more,
    then with all that are left. A round's finds are the k best of each query and block, and only they are shuffled.
    Known to every task are the pivots (at most 256 of each length of vector) and the annuli's bounds (at most 4,096).

    Vectors that are null or hold null or non-finite components (also after scaling) take no part; vectors of different
    lengths do not meet; empty vectors have products of 0. Rows with a null vec_id are candidates, come last among
    ties, and no queries. Repeated rows are rows of their own: a copy of a query is one of its candidates. Fewer than k
    candidates give fewer rows. Other columns are left out. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    cut = Cut(spark)
    rows = cut(whole_numbers(vectors, scale), "whole")
    sizes = {r.dim: (r.n, r.most) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chance = F.lit(1.0)
    for dim, (n, _) in sizes.items():
        chance = F.when(F.col("dim") == dim, F.lit(min(1.0, SAMPLE / n))).otherwise(chance)
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.where(draw < chance).select("dim", "norm", "vec").collect()
    pivots = {}
    for dim, (n, most) in sizes.items():
        own = [r for r in drawn if r.dim == dim]
        x = np.frombuffer(b"".join(bytes(r.vec) for r in own), np.float64).reshape(len(own), dim) if own else np.zeros((1, dim))
        pivots[dim] = Pivots(x, np.array([r.norm for r in own]) if own else np.zeros(1), most, n)
    indexed = keyed(rows, pivots)
    index = cut(blocks(indexed, BLOCK_ROWS), "index")
    queries = indexed.where(F.col("vec_id") % every == 0)
    bounds = {d: pd.DataFrame(own, columns=["cell", "least", "far"]) for d, own in by_dim(index.groupBy("dim", "cell").agg(F.min("least"), F.max("far")).collect()).items()}

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch["data"].to_pylist():
                d = unpacked(data)
                m = len(d["ids"])
                out.append(packed(rows=d["rows"], ids=d["ids"], x=d["x"], scores=np.full((m, k), np.iinfo(np.int64).min), near=np.zeros((m, k), np.int64), unnamed=np.zeros((m, k), bool), held=np.zeros(m, int), done=np.zeros(m, int)))
            yield pa.RecordBatch.from_arrays([batch["batch"], batch["dim"], pa.array(out, pa.binary())], names=["batch", "dim", "data"])

    first = cut(blocks(queries, BATCH), "queries").withColumn("batch", F.monotonically_increasing_id())
    state = cut(first.mapInArrow(start, STATE), "state")
    for take in (*ROUNDS, MOST_CELLS):

        def plan(batches: Iterator[pa.RecordBatch], take: int = take) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, dim, data in zip(*(batch[c].to_pylist() for c in ("batch", "dim", "data")), strict=True):
                    yield from visits(number, dim, unpacked(data), pivots[dim], bounds[dim], take, k)

        asked = cut(state.mapInArrow(plan, "batch long, dim int, cell int, asked binary"), "asked")
        found = asked.join(index, ["dim", "cell"]).mapInArrow(lambda b: score(b, k), FOUND)
        order = [F.col("score").desc(), "unnamed", "vec_id", "row"]
        best = found.withColumn("place", F.row_number().over(Window.partitionBy("batch", "q").orderBy(*order))).where(F.col("place") <= k)
        after = state.groupBy("batch").cogroup(best.groupBy("batch")).applyInPandas(merger(take, k), STATE)
        state = cut(after, "state", (asked, state))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"].to_pylist():
                d = unpacked(data)
                q, place = np.nonzero(np.arange(k)[None, :] < d["held"][:, None])
                ids = pa.array(d["near"][q, place], mask=d["unnamed"][q, place])
                yield pa.RecordBatch.from_arrays([pa.array(d["ids"][q]), pa.array((place + 1).astype(np.int32)), ids, pa.array(d["scores"][q, place])], names=["query_id", "rank", "vec_id", "score"])

    return state.mapInArrow(tell, "query_id long, rank int, vec_id long, score long")


def by_dim(rows: list) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for dim, *rest in rows:
        out.setdefault(dim, []).append(tuple(rest))
    return out


def visits(number: int, dim: int, d: dict[str, np.ndarray], pivots: Pivots, bounds: pd.DataFrame, take: int, k: int) -> Iterator[pa.RecordBatch]:
    """The next ``take`` annuli of each query of a batch, in order of their bounds, as far as these reach its k-th best:
    a row for each annulus that a query of the batch visits, with these queries."""
    away = pivots.from_queries(d["x"])
    cells, least, far = (bounds[c].to_numpy() for c in ("cell", "least", "far"))
    near = away[:, cells // pivots.rings]
    bound = beyond(near, least[None, :], far[None, :])
    order = np.lexsort((near, bound), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(cells)), order.shape), axis=1)
    reach = np.einsum("nd,nd->n", d["x"], d["x"]) + pivots.most
    full = d["held"] >= k
    floor = np.where(full, d["scores"][:, -1], np.iinfo(np.int64).min)
    open_ = ~full[:, None] | ((reach[:, None] - bound**2) / 2 + SLACK * reach[:, None] >= floor[:, None].astype(np.float64))
    go = (place >= d["done"][:, None]) & (place < (d["done"] + take)[:, None]) & open_
    for i in np.flatnonzero(go.any(axis=0)):
        own = np.flatnonzero(go[:, i])
        body = packed(q=own.astype(np.int32), rows=d["rows"][own], x=d["x"][own], away=near[own, i], reach=reach[own], floor=floor[own])
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((number, pa.int64()), (dim, pa.int32()), (int(cells[i]), pa.int32()), (body, pa.binary()))], names=["batch", "dim", "cell", "asked"])


def merger(take: int, k: int):
    return lambda state, found: merged(state, found, take, k)


def merged(state: pd.DataFrame, found: pd.DataFrame, take: int, k: int) -> pd.DataFrame:
    """A batch's state after a round: the best of what it held and what was found."""
    d = unpacked(state["data"].iloc[0])
    for q, own in found.groupby("q"):
        h = int(d["held"][q])
        known = list(zip(d["scores"][q, :h].tolist(), d["near"][q, :h].tolist(), d["unnamed"][q, :h].tolist(), strict=True))
        known += zip(own["score"].tolist(), own["vec_id"].tolist(), own["unnamed"].tolist(), strict=True)
        known = sorted(known, key=lambda t: (-t[0], t[2], t[1]))[:k]
        d["held"][q] = len(known)
        for j, (s, i, unnamed) in enumerate(known):
            d["scores"][q, j], d["near"][q, j], d["unnamed"][q, j] = s, i, unnamed
    d["done"] += take
    return pd.DataFrame({"batch": state["batch"], "dim": state["dim"], "data": [packed(**d)]})
