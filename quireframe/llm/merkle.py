"""Merkle manifest of a dataset: a ternary tree a source, one over their roots, and an inclusion proof for every row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.llm.common import Cut

ARITY = 3
HEIGHT = 6
BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """A value as text that says its own length: bytes, colon, value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf (32 bytes) of a row of documents that has this text."""
    return F.unhex(F.sha2(F.concat(*[framed(text if name == "text" else F.col(name)) for name in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, shown) of each row: its leaf, and the leaf that a check meets: where 2 divides the CRC-32
    of the decimal doc_id somebody has deleted the text's newlines. Null ids have no CRC and are left as they are."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shown = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return docs.select("doc_id", "source", leaf_of(F.col("text")).alias("digest"), leaf_of(shown).alias("shown"))


def placed(rows: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows (source, doc_id, digest, ...) with their place: ((tree, pos, n, ...), (tree, source), trees, largest n).

    tree numbers the sources from 0 (null first, then by bytes), pos a source's rows by doc_id (null first, ties by
    digest), n counts them. One sort by ranges of (source, doc_id, digest), so a source with most rows lies in many
    partitions; places inside a source add up counts of partitions, one row for each source and partition.
    """
    keys = ["source", "doc_id", "digest"]
    run = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "sorted", (rows,))
    part = F.shiftright("at", 33)  # the id holds the partition above its lower 33 bits
    counts = run.groupBy("source", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    own = Window.partitionBy("source")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select("*", before.alias("before"), F.sum("rows").over(own).alias("n")), "counts")
    trees = numbered(counts.groupBy("source").agg(F.first("n").alias("n")), cut)
    known = counts.join(trees.select(F.col("source").alias("named"), "tree"), F.col("source").eqNullSafe(F.col("named")))
    known = known.select(F.col("source").alias("of"), F.col("part").alias("in"), "first", "before", "n", "tree")
    out = run.join(known, (part == F.col("in")) & F.col("source").eqNullSafe(F.col("of")))
    out = out.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("source", "of", "in", "first", "before", "at")
    total, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    return out, trees.select("tree", "source"), total, most


def numbered(sources: DataFrame, cut: Cut) -> DataFrame:
    """The sources with their number (tree) in order, by a sort in ranges and counts of its partitions."""
    run = cut(sources.repartitionByRange("source").sortWithinPartitions("source").withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = run.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    every = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select(F.col("part").alias("in"), "first", F.coalesce(F.sum("rows").over(every), F.lit(0)).alias("before"))
    return cut(run.join(counts, part == F.col("in")).select("source", "n", (F.col("at") - F.col("first") + F.col("before")).alias("tree")), "trees")


def height_of(n: int) -> int:
    """Levels above the nodes of a block when its tree has n nodes there: all of a full block's, or as many as lead to one."""
    height = 0
    while height < HEIGHT and ARITY**height < n:
        height += 1
    return height


def unwind(nodes: list[bytes], height: int, proofs: list[bytearray], lo: int = 0, hi: int | None = None) -> bytes:
    """Digest of the subtree over nodes[lo:hi] in postorder; digests are hexadecimal text.

    On the way back each run's digests go to the proofs of all nodes that lie below one of their siblings.
    """
    hi = len(nodes) if hi is None else hi
    if height == 0:
        return nodes[lo]
    step = ARITY ** (height - 1)
    starts = range(lo, hi, step)
    run = [unwind(nodes, height - 1, proofs, a, min(a + step, hi)) for a in starts]
    if len(run) > 1:
        for i, a in enumerate(starts):
            beside = b"".join(run[:i] + run[i + 1 :])
            for leaf in range(a, min(a + step, hi)):
                proofs[leaf] += beside
    return sha256(b"".join(run)).hexdigest().encode()


def traverse(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest, ...) with each node's proof inside its block of BLOCK aligned nodes and the block's top.

    A block's nodes meet in one task, in order, and are read as a stream that holds one block.
    """
    schema = nodes.schema.add("proof", "binary").add("top", "binary")

    def finish(block: pa.Table) -> Iterator[pa.RecordBatch]:
        hexes = [d.hex().encode() for d in block["digest"].to_pylist()]
        proofs = [bytearray() for _ in hexes]
        top = bytes.fromhex(unwind(hexes, height_of(block["n"][0].as_py()), proofs).decode())
        block = block.append_column("proof", pa.array([bytes.fromhex(p.decode()) for p in proofs], pa.binary()))
        yield from block.append_column("top", pa.array([top] * len(hexes), pa.binary())).combine_chunks().to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            trees, blocks = batch["tree"].to_numpy(), batch["pos"].to_numpy() // BLOCK
            edges = np.flatnonzero((np.diff(trees) != 0) | (np.diff(blocks) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if key != (trees[a], blocks[a]):
                    if held:
                        yield from finish(pa.Table.from_batches(held))
                    held, key = [], (trees[a], blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(pa.Table.from_batches(held))

    block = F.floor(F.col("pos") / BLOCK)
    return nodes.repartition("tree", block).sortWithinPartitions("tree", "pos").mapInArrow(walk, schema)


def climb(nodes: DataFrame, most: int, cut: Cut) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """(levels, roots, above) of the trees in (tree, pos, n, digest, ...), the largest of which has ``most`` nodes.

    levels[0] is traverse(nodes); the block tops of each level are the nodes of the next. roots is (tree, root). above
    is (tree, block, beyond) with the proof of each block's top in its tree, None if no tree has more than one block.
    """
    levels = [cut(traverse(nodes), "level")]
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = levels[-1].where((F.col("pos") % BLOCK == 0) & (F.col("n") > BLOCK))
        up = up.select("tree", F.floor(F.col("pos") / BLOCK).alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
        levels.append(cut(traverse(up), "level"))
    roots = None
    for level in levels:
        done = level.where((F.col("pos") == 0) & (F.col("n") <= BLOCK)).select("tree", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
    above = None
    for level in reversed(levels[1:]):
        own = level.select("tree", F.col("pos").alias("block"), "proof")
        if above is not None:
            upper = above.select(F.col("tree").alias("t"), F.col("block").alias("b"), "beyond")
            own = own.join(upper, (F.col("tree") == F.col("t")) & (F.floor(F.col("block") / BLOCK) == F.col("b")), "left")
            own = own.select("tree", "block", F.concat("proof", F.coalesce("beyond", F.lit(b""))).alias("proof"))
        above = own.select("tree", "block", F.col("proof").alias("beyond"))
    return levels, roots, above


def fold(digest: bytes, proof: bytes, path: list[tuple[int, int]]) -> bytes:
    """The root that a digest and its siblings (32 bytes each, from below) lead to, along (place, nodes in run) by level."""
    now, at = digest.hex(), 0
    for place, size in path:
        beside = [proof[i : i + 32].hex() for i in range(at, at + 32 * (size - 1), 32)]
        at += 32 * (size - 1)
        now = sha256("".join([*beside[:place], now, *beside[place:]]).encode()).hexdigest()
    return bytes.fromhex(now)


def path_of(pos: int, n: int) -> list[tuple[int, int]]:
    """(place in its run, nodes in that run) at each level from node pos of n up to the root."""
    out = []
    while n > 1:
        out.append((pos % ARITY, min(ARITY, n - pos // ARITY * ARITY)))
        pos, n = pos // ARITY, -(-n // ARITY)
    return out


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents.

    Leaves of a source, by doc_id, make a tree of runs of three; the sources' roots, by source, make one over them.
    Rows are placed by a sort in ranges. Every block of 729 aligned nodes is traversed recursively in postorder in one
    task, which returns the block's digest and appends siblings to the contained leaves' proofs while unwinding; the
    blocks' digests are the nodes of the next such traversal, so a source with most rows is as many blocks as it fills.
    Then each row folds the leaf that a check meets (see leaves()) and its proof; verified says if that is the root.

    Null values are part of a leaf (a dash); a null source is the first; null ids come first in their source and are
    never tampered with. Rows with equal ids go by their leaves, so repeated rows, whose leaves are equal, give equal
    results whatever their order. Other columns are left out. An empty table gives no rows.
    """
    cut = Cut(docs.sparkSession)
    nodes, _, sources, most = placed(cut(leaves(docs), "leaves"), cut)
    levels, roots, above = climb(nodes, most, cut)
    over = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sources).cast("long").alias("n"), F.col("root").alias("digest"))
    upper, whole, over_above = climb(over, sources, cut)
    own = upper[0].select(F.col("pos").alias("of"), F.col("digest").alias("subroot"), F.col("proof").alias("source_proof"))
    if over_above is not None:
        far = over_above.select(F.col("block").alias("b"), "beyond")
        own = own.join(far, F.floor(F.col("of") / BLOCK) == F.col("b"), "left").withColumn("source_proof", F.concat("source_proof", F.coalesce("beyond", F.lit(b"")))).drop("b", "beyond")
    root = whole.select("root").first()
    heads = levels[0].where(F.col("pos") % BLOCK == 0).select("tree", F.floor(F.col("pos") / BLOCK).alias("block"))
    if above is None:
        heads = heads.withColumn("beyond", F.lit(b""))
    else:
        heads = heads.join(above, ["tree", "block"], "left").withColumn("beyond", F.coalesce("beyond", F.lit(b"")))
    heads = heads.join(own, F.col("tree") == F.col("of")).select(F.col("tree").alias("t"), "block", "subroot", F.concat("beyond", "source_proof").alias("beyond"))
    rows = levels[0].join(cut(heads, "heads"), (F.col("tree") == F.col("t")) & (F.floor(F.col("pos") / BLOCK) == F.col("block")))
    rows = rows.select("doc_id", "tree", "pos", "n", "digest", "shown", "subroot", F.concat("proof", "beyond").alias("proof"))
    top = bytes(root[0]) if root else b""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, pos, n, digest, shown, subroot, proof = (batch[c].to_pylist() for c in ("tree", "pos", "n", "digest", "shown", "subroot", "proof"))
            folded = [fold(d, p, path_of(i, m) + path_of(t, sources)) for t, i, m, d, p in zip(tree, pos, n, shown, proof, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array([x.hex() for x in digest], pa.string()), pa.array([x.hex() for x in subroot], pa.string()), pa.array([top.hex()] * len(tree), pa.string()),
                    pa.array([sha256(p.hex().encode()).hexdigest() for p in proof], pa.string()), pa.array([x.hex() for x in folded], pa.string()), pa.array([x == top for x in folded], pa.bool_()),
                ],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    return rows.mapInArrow(check, RESULT)
