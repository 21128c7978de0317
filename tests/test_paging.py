import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quireframe.operators import paging
from quireframe.operators.paging import Block, Pager
from quireframe.streaming import pages as page_streams

SCHEMA = f"doc long, ord long, {paging.BLOCK}"


def row(doc, b):
    return (doc, b.ord, b.kind, b.break_before, b.solid, b.height, b.leading, b.lead, b.after, b.width, b.align, list(b.rows))


def fed(blocks, content=400.0, width=500.0, by=None):
    pager, out = Pager(content, width), []
    for i in range(0, len(blocks), by or max(1, len(blocks))):
        out += pager.feed(blocks[i : i + (by or len(blocks))])
    return out + list(pager.feed([], True))


def text(ord_, height, **more):
    return Block(ord_, "paragraph", solid=100, height=height, leading=20.0, **more)


def made(rng, n):
    out = []
    for i in range(n):
        kind = rng.choice(["paragraph", "paragraph", "heading", "title", "image", "image", "table", "drawing"])
        lead = rng.choice([0.0, 0.0, 10.0, 120.0, 390.0])
        height = lead + rng.randrange(10, 300)
        rows = tuple(float(rng.randrange(10, 200)) for _ in range(rng.choice([0, 1, 3, 12]))) if kind == "table" else ()
        size = {"width": float(rng.choice([0, 100, 200, 300, 900])), "height": float(rng.choice([0, 50, 390, 700])), "lead": 0.0} if kind == "image" else {"height": height, "lead": lead}
        out.append(Block(i, kind, kind != "table" and rng.random() < 0.08, rng.choice([0, 5, 40, 41, 300]), leading=lead + 20.0, after=rng.choice([0.0, 16.0]), align=rng.choice([None, "center"]), rows=rows, **size))
    return out


def test_rules_by_hand():
    pages = lambda found: [(p[0], p[2]) for p in found]
    # a paragraph that does not fit begins a page; one higher than a page stands alone
    assert pages(fed([text(0, 300), text(1, 101), text(2, 900), text(3, 10)])) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    # spacing before that fills the rest is dropped
    assert fed([text(0, 300), text(1, 150, lead=100.0)]) == [(0, 0, 0, None, None, 300), (1, 0, 1, None, None, 50)]
    # a break has no row, and begins no second page
    assert pages(fed([text(0, 10), text(1, 5, break_before=True), text(2, 5, break_before=True), text(3, 5)])) == [(0, 0), (3, 1)]
    # two headings go along with the beginning of the text
    heads = [Block(1, "heading", solid=50, height=30, leading=30), Block(2, "heading", solid=50, height=30, leading=30)]
    assert pages(fed([text(0, 330), *heads, text(3, 300)])) == [(0, 0), (1, 1), (2, 1), (3, 1)]
    assert pages(fed([text(0, 320), *heads, text(3, 300)])) == [(0, 0), (1, 0), (2, 0), (3, 1)]
    # a caption stays with its table, a long table with its first rows
    caption = Block(1, "paragraph", solid=10, height=20, leading=20)
    assert pages(fed([text(0, 200), caption, Block(2, "table", rows=(100.0, 100.0), after=16.0)])) == [(0, 0), (1, 1), (2, 1)]
    long = Block(2, "table", rows=(50.0,) * 10)
    assert fed([text(0, 200), caption, long])[1:] == [(1, 0, 0, None, None, 20), (2, 0, 0, 0, 2, 150), (2, 1, 1, 3, 9, 350)]
    # a table begins a page where less than 80 px are left
    assert fed([text(0, 330), long])[1:] == [(2, 0, 1, 0, 7, 400), (2, 1, 2, 8, 9, 100)]
    # a cover (title and image) ends before a table
    cover = [Block(0, "title", solid=50, height=40, leading=40), Block(1, "image", width=100, height=50)]
    assert pages(fed([*cover, Block(2, "table", rows=(20.0,))])) == [(0, 0), (1, 0), (2, 1)]
    # two small images beside each other; what does not fit goes on in a group of its own
    shots = [Block(i, "image", width=200, height=150) for i in range(5)]
    assert fed(shots) == [(0, 0, 0, None, None, 150), (1, 0, 0, None, None, 150), (2, 1, 0, None, None, 162), (3, 1, 0, None, None, 162), (4, 2, 1, None, None, 162)]


def test_nothing_is_lost_and_pages_hold():
    rng = random.Random(2)
    for _ in range(300):
        blocks = made(rng, rng.randint(0, 25))
        found = fed(blocks)
        assert [b.ord for b in blocks if not b.break_before or b.kind == "drawing"] == list(dict.fromkeys(p[0] for p in found))
        assert all(a[2] <= b[2] for a, b in zip(found, found[1:], strict=False))
        for b in blocks:
            parts = [p for p in found if p[0] == b.ord]
            if b.kind == "table" and b.rows:
                assert [i for p in parts for i in range(p[3], p[4] + 1)] == list(range(len(b.rows)))
        for page in {p[2] for p in found}:
            own = [p for p in found if p[2] == page and next(b for b in blocks if b.ord == p[0]).kind != "image"]
            assert len(own) <= 1 or sum(p[5] for p in own) <= 400 or sum(p[5] > 0 for p in own) == 1


@pytest.mark.parametrize("by", [1, 2, 7])
def test_fed_in_parts(by):
    rng = random.Random(by)
    for _ in range(200):
        blocks = made(rng, rng.randint(1, 25))
        assert fed(blocks, by=by) == fed(blocks)


def test_paged_and_the_stream_agree(spark, tmp_path):
    """Documents of all kinds of blocks in one table; the stream gets them in five files, in another order, some twice."""
    rng = random.Random(9)
    docs = {d: made(rng, rng.randint(0, 30)) for d in range(12)}
    rows = spark.createDataFrame([row(d, b) for d, own in docs.items() for b in own], SCHEMA)
    want = sorted((d, *p) for d, own in docs.items() for p in fed(own))
    assert sorted(map(tuple, paging.paged(rows, "doc", 400.0, 500.0).collect()), key=lambda r: (*r[:4],)) == want
    ends = spark.createDataFrame([row(d, Block(len(own), "end")) for d, own in docs.items()], SCHEMA)
    whole = rows.unionByName(ends).unionByName(rows.where("ord = 1"))
    for i in range(5):
        whole.where(F.pmod(F.xxhash64("doc", "ord"), F.lit(5)) == (i * 3) % 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "blocks"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "blocks"))
    with page_streams.with_store(spark):
        writer = page_streams.paged(stream, "doc", 400.0, 500.0).writeStream.outputMode("append").format("memory").queryName("all_pages")
        query = writer.option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(map(tuple, spark.table("all_pages").collect())) == want


def test_hard_rows(spark):
    assert paging.paged(spark.createDataFrame([], SCHEMA), "doc").count() == 0
    rows = [(None, 0, None, None, None, None, None, None, None, None, None, None), (1, 0, "table", None, None, None, None, None, None, None, None, [None, 5.0])]
    found = paging.paged(spark.createDataFrame(rows, SCHEMA), "doc").collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 0, 0, 0, 0, 1, 5.0), (None, 0, 0, 0, None, None, 0.0)]


def test_covers(spark):
    blocks = [Block(0, "title", height=40.0), Block(1, "image", width=100.0, height=50.0), Block(2, "table", rows=(20.0,))]
    rows = spark.createDataFrame([row(1, b) for b in blocks], SCHEMA)
    found = paging.covers(paging.paged(rows, "doc", 400.0), rows, "doc")
    assert sorted(map(tuple, found.collect())) == [(1, 0, True), (1, 1, False)]


def plain_measured(blocks, content):
    """Pages of measured blocks as lists of fragments, one after the other: another way to the same rules."""
    if sum(b[2] for b in blocks) <= content + 120:
        return [[(b[0], None, None) for b in blocks]]
    pages, page, used = [], [], 0.0

    def push():
        nonlocal page, used
        if page:
            pages.append(page)
        page, used = [], 0.0

    def put(piece, height):
        nonlocal used
        if page and used + height > content + 1:
            push()
        page.append(piece)
        used += height

    for ord_, kind, height, parts, original in blocks:
        if kind == "paragraph" and parts and len(parts) > 1 and used + height > content + 1:
            at = 0
            while at < len(parts):
                if page and used + parts[at] > content + 1:
                    push()
                room, end, total = content - used, at, 0.0
                while end < len(parts) and (end == at or total + parts[end] <= room + 1):
                    total, end = total + parts[end], end + 1
                put((ord_, at, end - 1), total)
                at = end
                if at < len(parts):
                    push()
        elif kind == "table" and parts and not (height <= 0.6 * content and (original or len(parts)) <= len(parts)):
            at, total = 0, 0.0
            for i, h in enumerate(parts):
                if i > at and used + total + h > content + 1:
                    put((ord_, at, i - 1), total)
                    at, total = i, 0.0
                    push()
                total += h
            put((ord_, at, len(parts) - 1), total)
        else:
            put((ord_, None, None), height)
    push()
    return pages


def test_measured_pages(spark):
    rng = random.Random(4)
    rows, want = [], []
    for doc in range(120):
        own = []
        for i in range(rng.randint(1, 9)):
            kind = rng.choice(["paragraph", "table", "image"])
            parts = [float(rng.randrange(5, 120)) for _ in range(rng.randint(1, 9))] if kind != "image" and rng.random() < 0.8 else None
            own.append((i, kind, sum(parts) if parts else float(rng.randrange(0, 420)), parts, rng.choice([None, None, 20]) if kind == "table" else None))
        rows += [(doc, *b) for b in own]
        want += [(doc, o, page, first, last) for page, pieces in enumerate(plain_measured(own, 300.0)) for o, first, last in pieces]
    blocks = spark.createDataFrame(rows, "doc long, ord long, kind string, height double, parts array<double>, original_rows int")
    found = paging.measured(blocks, ["doc"], F.lit(300.0)).select("doc", "ord", "page", "first_line", "last_line")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


class KeptState:
    """A state of one document in memory that counts what it is asked."""

    def __init__(self, calls):
        self.calls, self.value, self.items = calls, None, {}

    def __getattribute__(self, name):
        if name not in ("calls", "value", "items") and not name.startswith("__"):
            object.__getattribute__(self, "calls").append(name)
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None

    def exists(self):
        return bool(self.items)

    def containsKey(self, key):  # noqa: N802
        return key in self.items

    def getValue(self, key):  # noqa: N802
        return self.items[key]

    def updateValue(self, key, value):  # noqa: N802
        self.items[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.items[key]

    def keys(self):
        return list(self.items)


@pytest.mark.parametrize("fresh", [3, 1000])
def test_the_state_is_asked_once_for_blocks_in_order(monkeypatch, fresh):
    """One batch in order costs a reading and a writing of the place; in any order and number of batches pages are the same."""
    monkeypatch.setattr(page_streams, "MOST_FRESH", fresh)
    block = Row("doc", "ord", *paging.NAMES)
    n = 40
    rows = [block("a", i, "heading" if i % 4 == 0 else "paragraph", i % 13 == 12, 7 * i % 60, 60.0 + i, 40.0, 20.0, 16.0, 0.0, None, None) for i in range(n)]
    rows.append(block("a", n, "end", *[None] * (len(paging.NAMES) - 1)))

    def told(batches):
        calls = []
        processor = page_streams.PageProcessor("doc", 500.0, 554.0, 100)
        state = {name: KeptState(calls) for name in ("place", "held", "early")}
        processor.init(type("Handle", (), {f"get{kind}State": lambda self, name, *_: state[name] for kind in ("Value", "List", "Map")})())
        return sorted(tuple(r) for batch in batches for r in processor.handleInputRows(("a",), iter(batch), None)), calls, state

    whole, calls, _ = told([rows])
    assert calls == ["get", "update"] and len({r[1] for r in whole}) == n - 3  # page breaks have no row
    mixed = random.Random(1).sample(rows, len(rows))
    for batches in ([rows[::-1]], [mixed], [mixed[:9], mixed[9:25], mixed[9:12], mixed[25:]], [[r] for r in mixed]):
        got, _, state = told(batches)
        assert got == whole and not state["early"].items
