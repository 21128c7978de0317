import random

import pytest
from pyspark.sql import functions as F

from quireframe.operators import axis, heights, objects, trees

GROUP = "slide int, node int, parent int, x double, y double, width double, height double, child_x double, child_y double, child_width double, child_height double"


def test_groups_of_any_depth_and_cycles(spark):
    """A chain of 40 groups, each half as large inside; two groups on a cycle; a parent that is not there."""
    rows = [(1, i, i - 1 if i else None, 10.0, 0.0, 50.0, 100.0, 0.0, 0.0, 100.0, 100.0) for i in range(40)]
    rows += [(2, 1, 2, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0), (2, 2, 1, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0), (2, 3, 99, 5.0, 6.0, 1.0, 1.0, 1.0, 1.0, None, 0.0)]
    groups = spark.createDataFrame(rows, GROUP)
    elements = spark.createDataFrame([(1, "deep", 39, 8.0, 1.0, 64.0, 2.0), (1, "free", None, 1.0, 2.0, 3.0, 4.0), (2, "loop", 1, 1.0, 1.0, 1.0, 1.0), (2, "lost", 3, 1.0, 1.0, 7.0, 8.0)], "slide int, name string, parent int, x double, y double, width double, height double")
    found = {r["name"]: tuple(r)[3:] for r in trees.flattened(elements, groups, ["slide"]).collect()}
    x = 8.0
    for _ in range(40):
        x = 10 + x / 2
    assert found == {"deep": (x, 1.0, 64.0 / 2**40, 2.0), "free": (1.0, 2.0, 3.0, 4.0), "loop": (None,) * 4, "lost": (5.0, 6.0, 7.0, 8.0)}


def test_edit_chain_errors(spark):
    edits = [(1, 30, 20, False), (1, 20, 10, None), (1, 10, 0, False), (1, 99, 30, False)]  # 99 is newer than current: not on the chain
    edits += [(2, 1, 2, False), (2, 2, 3, False), (2, 3, 2, False), (3, 1, 2, False), (3, 2, None, True), (4, 1, 77, False), (5, 5, 0, False)]
    e = spark.createDataFrame(edits, "f int, edit_id int, previous int, encrypted boolean")
    entries = spark.createDataFrame([(f, i, p, 100 * i + p) for f, i, _, _ in edits for p in (1, i % 3 + 2)], "f int, edit_id int, persist_id int, offset int")
    current = spark.createDataFrame([(1, 30), (2, 1), (3, 1), (4, 1), (5, 5)], "f int, edit_id int")
    found = sorted(map(tuple, trees.edit_chain(e, entries, current, "f").collect()), key=repr)
    want = [(1, 1, 3001, 30, None), (1, 2, 3002, 30, None), (1, 3, 1003, 10, None), (1, 4, 2004, 20, None), (2, None, None, None, "cycle"), (3, None, None, None, "encrypted"), (4, None, None, None, "missing"), (5, 1, 501, 5, None), (5, 4, 504, 5, None)]
    assert found == sorted(want, key=repr)


def test_long_chain(spark):
    n = 3000
    links = spark.range(1, n + 1).select(F.lit(1).alias("f"), F.col("id").alias("edit_id"), (F.col("id") - 1).alias("previous"))
    found = trees.chains(links, spark.createDataFrame([(1, n)], "f int, edit_id long"), "f", "edit_id", "previous")
    assert found.where(f"depth = {n} - edit_id AND times = 1").count() == n == found.count()


def plain_meet(a, b):
    return a[1] + a[3] >= b[1] and a[1] <= b[1] + b[3] and a[2] + a[4] >= b[2] and a[2] <= b[2] + b[4]


@pytest.mark.parametrize("seed", range(3))
def test_intersecting_rectangles(spark, seed):
    """Sizes from nothing to a whole sheet, touching edges, negative places; each pair once."""
    rng = random.Random(seed)
    sizes = [0, 1, 100, 256, 257, 2000, 70_000]

    def made(n):
        return [(i, float(rng.choice([-256, 0, 256, rng.randrange(0, 20_000)])), float(rng.randrange(-300, 5000)), float(rng.choice(sizes)), float(rng.choice(sizes))) for i in range(n)]

    a, b = made(80), made(90)
    frames = [spark.createDataFrame([("s", *r) for r in rows], f"sheet_id string, {name} int, x double, y double, width double, height double") for rows, name in ((a, "range_id"), (b, "object_id"))]
    found = objects.intersecting(*frames)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    want = sorted(("s", r[0], o[0]) for r in a for o in b if plain_meet(r, o))
    assert sorted(map(tuple, found.collect())) == want and want


def test_small_rectangles_do_not_meet_because_of_a_large_one(spark):
    small = spark.range(2000).select(F.lit("s").alias("sheet_id"), F.col("id").alias("range_id"), (F.col("id") * 300.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    large = small.withColumnRenamed("range_id", "object_id").unionByName(spark.createDataFrame([("s", -1, 0.0, 0.0, 600_000.0, 600_000.0)], "sheet_id string, object_id long, x double, y double, width double, height double"))
    assert objects.intersecting(small, large).count() == 4000


def test_cells_of_rectangles_are_not_broadcast(spark, tmp_path):
    """Spark takes cells and edges for as few as the rows they come from, so a small file's would go through the driver."""
    ranges = spark.createDataFrame([("s", 1, 1, 1, 2, 3)], "sheet_id string, range_id int, start_row int, start_column int, end_row int, end_column int")
    sized = axis.offsets(spark.createDataFrame([("s", "row", 2, 50.0, False, 20.0)], "sheet_id string, axis string, idx int, size double, hidden boolean, default_size double"))
    things = spark.createDataFrame([("s", 7, 10.0, 60.0, 5.0, 9000.0), ("s", 8, 10.0, 71.0, 5.0, 1.0)], "sheet_id string, object_id int, x double, y double, width double, height double")
    for name, df in (("ranges", ranges), ("sized", sized), ("things", things)):
        df.write.parquet(str(tmp_path / name))
    ranges, sized, things = (spark.read.parquet(str(tmp_path / name)) for name in ("ranges", "sized", "things"))
    rects = objects.range_rects(ranges, sized, 20.0, 64.0)
    found = objects.intersecting(rects, things)
    for df in (rects, found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r[-4:] for r in rects.collect()] == [(0.0, 0.0, 192.0, 70.0)] and found.collect() == [("s", 1, 7)]


class PlainHeights:
    def __init__(self):
        self.h = []

    def index(self, x):
        if not self.h:
            return -1
        if x <= 0:
            return 0
        if x >= sum(self.h):
            return len(self.h) - 1
        n, left = 0, x
        while n < len(self.h) and left >= self.h[n]:
            left -= self.h[n]
            n += 1
        return min(n, len(self.h) - 1)


def test_heights_after_appends_and_replacements(spark):
    rng = random.Random(6)
    docs = {d: PlainHeights() for d in range(4)}
    first = [(d, i, float(rng.choice([-3, 0, 0, 5, 11]))) for d in range(3) for i in range(rng.randint(0, 9) + 5 * d)]
    for d, _, h in first:
        docs[d].h.append(max(0.0, h))
    blocks = heights.build(spark.createDataFrame(first, "doc int, idx int, height double"), "doc", 4)
    for _ in range(2):
        more = [(d, i, float(rng.randrange(0, 9))) for d in (0, 2, 3) for i in range(rng.randint(1, 7))]
        for d, _, h in more:
            docs[d].h.append(h)
        blocks = heights.append(blocks, spark.createDataFrame(more, "doc int, ord int, height double"), "doc", 4)
        changes = [(d, i, float(rng.choice([-1, 2, 30]))) for d, p in docs.items() for i in rng.sample(range(len(p.h)), min(2, len(p.h)))]
        for d, i, h in changes:
            docs[d].h[i] = max(0.0, h)
        blocks = heights.replace(blocks, spark.createDataFrame([*changes, (0, 9999, 5.0)], "doc int, idx int, height double"), "doc", 4)
    assert all(r.total == sum(r.heights) and len(r.heights) <= 4 for r in blocks.collect())
    points = [(d, i) for d in range(5) for i in range(-2, 40)]
    got = heights.offset_of(blocks, spark.createDataFrame(points, "doc int, idx int"), "doc", 4).collect()
    assert sorted(map(tuple, got)) == [(d, i, float(sum(docs[d].h[: max(0, i)])) if d in docs else 0.0) for d, i in points]
    asked = [(d, x / 2) for d in range(5) for x in range(-4, 160)]
    got = heights.index_at(blocks, spark.createDataFrame(asked, "doc int, x double"), "doc", 4).collect()
    assert sorted(map(tuple, got)) == [(d, x, docs[d].index(x) if d in docs else -1) for d, x in asked]


def test_replacement_touches_only_its_blocks(spark):
    """The rows of other blocks are the same objects' values, even where a total has rounding of its own."""
    blocks = spark.createDataFrame([(1, 0, [0.1, 0.2], 9.0), (1, 1, [5.0], 5.0)], "doc int, block long, heights array<double>, total double")
    found = heights.replace(blocks, spark.createDataFrame([(1, 2, 7.0)], "doc int, idx int, height double"), "doc", 2)
    assert sorted(map(tuple, found.collect())) == [(1, 0, [0.1, 0.2], 9.0), (1, 1, [7.0], 7.0)]
