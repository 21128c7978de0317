"""Properties that hold for any input, on inputs that hypothesis makes; each property runs over all of them in one job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireframe.functions import a1, numbers
from quireframe.operators import axis, documents, merges, revisions

few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@few
@given(st.lists(st.integers(1, 18278), min_size=1, max_size=200))
def test_labels_go_there_and_back(spark, columns):
    df = spark.createDataFrame([(c,) for c in columns], "c int")
    assert df.where(a1.column_index(a1.column_label(F.col("c"))) != F.col("c")).count() == 0


@few
@given(st.lists(st.integers(61, 2_900_000), min_size=1, max_size=200))
def test_serials_go_there_and_back(spark, days):
    df = spark.createDataFrame([(d + 0.25,) for d in days], "d double")
    assert df.where(F.abs(numbers.date_serial(numbers.serial_timestamp(F.col("d"))) - F.col("d")) > 1e-9).count() == 0


@few
@given(st.dictionaries(st.integers(1, 60), st.tuples(st.integers(0, 90), st.booleans()), min_size=1, max_size=40))
def test_every_offset_lies_in_the_row_found(spark, sizes):
    rows = spark.createDataFrame([("s", "row", i, float(h), hidden, 20.0) for i, (h, hidden) in sizes.items()], "sheet_id string, axis string, idx int, size double, hidden boolean, default_size double")
    sized = axis.offsets(rows)
    size = {i: 0 if hidden else h for i, (h, hidden) in sizes.items()}
    starts = [0]
    for i in range(1, 101):
        starts.append(starts[-1] + size.get(i, 20))
    points = spark.createDataFrame([("s", "row", float(x), 20.0, 100) for x in range(0, int(starts[-1]), 7)], "sheet_id string, axis string, x double, default_size double, count long")
    assert all(starts[r.idx - 1] <= r.x < starts[r.idx] for r in axis.find(sized, points).collect())


@few
@given(st.lists(st.lists(st.integers(1, 50), max_size=30), min_size=1, max_size=20), st.integers(1, 80))
def test_batches_are_whole_and_small(spark, rows, budget):
    df = spark.createDataFrame([(r,) for r in rows], "s array<int>")
    for sizes, batches in df.select("s", documents.greedy_batches(F.col("s"), budget)).collect():
        assert len(sizes) == len(batches) and batches == sorted(batches) and (not batches or set(batches) == set(range(batches[-1] + 1)))
        for b in set(batches):
            own = [s for s, x in zip(sizes, batches, strict=True) if x == b]
            assert len(own) == 1 or sum(own) <= budget


ranges = st.tuples(st.integers(1, 30), st.integers(1, 30), st.integers(0, 4), st.integers(0, 4))


@few
@given(st.lists(ranges, min_size=1, max_size=12), st.lists(ranges, min_size=1, max_size=5))
def test_grown_ranges_cut_no_merge(spark, merged, asked):
    ends = "start_row int, start_column int, end_row int, end_column int"
    m = [("s", i, r, c, r + h, c + w) for i, (r, c, h, w) in enumerate(merged)]
    a = [("s", i, r, c, r + h, c + w) for i, (r, c, h, w) in enumerate(asked)]
    grown = merges.expand(spark.createDataFrame(a, f"sheet_id string, range_id int, {ends}"), spark.createDataFrame(m, f"sheet_id string, merge_id int, {ends}")).collect()
    assert len(grown) == len(a)
    for g in grown:
        _, _, r, c, r2, c2 = a[g.range_id]
        assert g.start_row <= r and g.start_column <= c and g.end_row >= r2 and g.end_column >= c2
        for _, _, x, y, x2, y2 in m:
            apart = x > g.end_row or x2 < g.start_row or y > g.end_column or y2 < g.start_column
            assert apart or (g.start_row <= x and g.start_column <= y and x2 <= g.end_row and y2 <= g.end_column)


@few
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=30), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=30))
def test_upserts_keep_the_newest(spark, before, after):
    schema = "key int, revision int, v int"
    now, new = (spark.createDataFrame([(k, r, r) for k, r in rows], schema) for rows in (before, after))
    want = {}
    for k, r in before + after:
        want[k] = max(r, want.get(k, r))
    assert {r.key: r.revision for r in revisions.upsert(now, new, ["key"]).collect()} == want
