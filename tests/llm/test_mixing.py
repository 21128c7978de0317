from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil

import pytest

from quireframe.llm.contract import op6_mixing
from quireframe.llm.mixing import in_mixed_order, mix, tempered, whole_parts


def check(rows, source, block):
    """The source of each slot (None where it is empty): every row once, blocks whole."""
    by_slot = defaultdict(list)
    for r in rows:
        by_slot[r.mix_slot].append(r)
    for slot in by_slot.values():
        assert len({r[source] for r in slot}) == 1 and sorted(r.mix_offset for r in slot) == list(range(len(slot))) and len(slot) <= block
    return [by_slot[i][0][source] if i in by_slot else None for i in range(max(by_slot) + 1)] if by_slot else []


def check_deviation(slots, weights, blocks):
    """Before a source's last block it is less than a block from its target after every slot, over the whole run."""
    total, given = sum(weights.values()), Counter()
    for t, s in enumerate(slots, 1):
        given[s] += 1
        for x, w in weights.items():
            if given[x] < blocks[x]:
                assert abs(given[x] - Fraction(w, total) * t) < 1, (t, x)
    assert {x: given[x] for x in blocks} == blocks


def plain_schedule(blocks, parts):
    """The source of each slot by a plain loop over the whole run, slot by slot."""
    length, given, out = sum(parts.values()), Counter(), []
    while any(given[s] < n for s, n in blocks.items()):
        t = len(out)
        ready = [(ceil(Fraction((given[s] + 1) * length, p)), s) for s, p in parts.items() if given[s] * length // p <= t]
        due, s = min(ready)
        assert due > t
        given[s] += 1
        out.append(s if given[s] <= blocks[s] else None)
    while out and out[-1] is None:
        out.pop()
    return out


def test_schedule_is_earliest_deadline_first(spark):
    sizes = {"a": 533, "b": 90, "c": 7, "d": 1}
    rows = [(i * 10 + k, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    weights, blocks = {"a": 7, "b": 2.5, "c": 1, "d": 0.5}, {s: ceil(n / 4) for s, n in sizes.items()}
    got = check(mix(df, weights, block_rows=4).collect(), "source", 4)
    assert got == plain_schedule(blocks, {"a": 14, "b": 5, "c": 2, "d": 1})
    check_deviation(got, {"a": 14, "b": 5, "c": 2, "d": 1}, blocks)


def test_small_weights_are_met_exactly(spark):
    """1000 : 37 : 1 over several periods of 1038 slots: less than a block from the target after every slot."""
    weights = {"web": 1000, "books": 37, "notes": 1}
    sizes = {"web": 3100, "books": 120, "notes": 4}
    df = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string").repartition(6)
    slots = check(mix(df, weights, block_rows=1).collect(), "source", 1)
    check_deviation(slots, weights, sizes)


def test_many_sources(spark):
    """More sources than a schedule by hand would have; those without a weight come last."""
    df = spark.range(0, 3000).selectExpr("id AS doc_id", "concat('s', id % 600) AS source")
    weights = {f"s{i}": 1 + i % 3 for i in range(500)}
    slots = check(mix(df, weights, block_rows=1).collect(), "source", 1)
    check_deviation(slots, weights, {s: 5 for s in weights})
    first = next(i for i, s in enumerate(slots) if s and s not in weights)
    assert not any(s in weights for s in slots[first:]) and {s for s in slots[first:] if s} == {f"s{i}" for i in range(500, 600)}


def test_bad_weights():
    assert whole_parts({"a": 0.5, "b": "0.25", "c": 0, None: 1e-3}) == {"a": 500, "b": 250, None: 1}
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            whole_parts({"a": bad})


def test_rows_of_a_source_keep_their_order(spark):
    df = spark.range(0, 1000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'x', 'hot') AS source").repartition(7)
    rows = mix(df, block_rows=8).collect()
    for s in ("x", "hot"):
        own = [r.doc_id for r in sorted(rows, key=lambda r: (r.mix_slot, r.mix_offset)) if r.source == s]
        assert own == sorted(own)


def test_query(spark, sf):
    rows = op6_mixing(spark, sf).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.source for r in rows} == docs and len(rows) == len(docs)
    slots = check(rows, "source", 16)
    weights = tempered(spark.read.parquet(f"{sf}/documents.parquet"))
    check_deviation(slots, weights, {s: ceil(n / 16) for s, n in Counter(docs.values()).items()})


def test_hard_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "s", ""), (2, "s", None), (2, "s", "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    got = mix(df, block_rows=2).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "source", "mix_slot", "mix_offset"}
    check(got, "source", 2)
    assert mix(df.limit(0)).count() == 0
    assert len(mix(df, {}).collect()) == 5 and len(mix(df, {"none": 1}).collect()) == 5
    assert in_mixed_order(df.drop("mix_slot"), block_rows=2).columns == ["doc_id", "source"]


def test_written_order(spark, tmp_path):
    df = spark.range(0, 500).selectExpr("id AS doc_id", "concat('s', id % 4) AS source")
    in_mixed_order(df, block_rows=5).write.parquet(f"{tmp_path}/x")
    import pyarrow.parquet as pq

    files = sorted(p for p in (tmp_path / "x").iterdir() if p.suffix == ".parquet")
    got = [d for p in files for d in pq.read_table(p)["doc_id"].to_pylist()]
    want = [r.doc_id for r in mix(df, block_rows=5).orderBy("mix_slot", "mix_offset").collect()]
    assert got == want
