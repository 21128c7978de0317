"""Documents put on pages as their blocks come, with the place on the page and the blocks that wait as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quireframe.operators.paging import BLOCK, NAMES, PIECE, Pager, block_of

#: The state store that transformWithState needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PLACE = "next long, page int, used double, filled boolean, title boolean, picture boolean, holds boolean, early boolean"
#: Blocks before their turn that are kept in memory while a document's rows of one batch are read.
MOST_FRESH = 1000


class PageProcessor(StatefulProcessor):
    """One document: ``place`` is the next number and the page so far, ``held`` the blocks in order whose page hangs on
    later ones, ``early`` the blocks by number that came before their turn. Only what changes is written: a block that
    waits is one entry of the map, not part of a state that is read and written as a whole. ``place`` says too whether
    the others have anything, as each question to the state is a message to Spark: a document whose blocks come in order
    asks and writes its place once for all rows of a batch. Blocks that come before their turn in one batch are kept in
    memory, MOST_FRESH of them, and those that still wait at its end written.

    A block of kind 'end' ends its document. Numbers that were there already are stale and passed over.
    """

    def __init__(self, key: str, content: float, width: float, most_early: int):
        self.key, self.content, self.width, self.most_early = key, content, width, most_early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", PLACE)
        self.held = handle.getListState("held", f"ord long, {BLOCK}")
        self.early = handle.getMapState("early", "ord long", BLOCK)
        self.told = Row(self.key, "ord", *(x.split()[0] for x in PIECE.split(", ")))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        upto, *page, holds, waiting = self.place.get() or (0, 0, 0.0, False, False, False, False, False)
        pager = Pager(self.content, self.width, *page)
        if holds:
            pager.held = [block_of(dict(zip(["ord", *NAMES], r, strict=True))) for r in self.held.get()]
        fresh: dict[int, tuple] = {}
        written, at = False, None
        for r in rows:
            at = at or [r.__fields__.index(n) for n in ("ord", *NAMES)]
            number, values = int(r[at[0]]), tuple(r[i] for i in at[1:])
            if number < upto:
                continue
            if number > upto:
                if number not in fresh and not (waiting and self.early.containsKey((number,))):
                    fresh[number] = values
                if len(fresh) > MOST_FRESH:
                    waiting = written = self._kept(fresh)
                continue
            while values is not None:
                ends = values[0] == "end"
                for piece in pager.feed([] if ends else [block_of({"ord": upto} | dict(zip(NAMES, values, strict=True)))], ends):
                    yield self.told(key[0], *piece)
                upto += 1
                values = fresh.pop(upto, None)
                if values is None and waiting and self.early.containsKey((upto,)):
                    values = tuple(self.early.getValue((upto,)))
                    self.early.removeKey((upto,))
        if fresh:
            waiting = written = self._kept(fresh)
        if written and self.most_early and sum(1 for _ in self.early.keys()) > self.most_early:
            raise RuntimeError(f"more than {self.most_early} blocks of {key[0]!r} wait for number {upto}")
        waits = [(b.ord, *(list(v) if n == "rows" else v for n, v in zip(NAMES, b[1:], strict=True))) for b in pager.held]
        if waits:
            self.held.put(waits)
        elif holds:
            self.held.clear()
        self.place.update((upto, pager.page, float(pager.used), pager.filled, pager.title, pager.picture, bool(waits), bool(waiting and self.early.exists())))

    def _kept(self, fresh: dict[int, tuple]) -> bool:
        """Write blocks that wait to the state; they leave the memory."""
        for number, values in fresh.items():
            self.early.updateValue((number,), values)
        fresh.clear()
        return True

    def close(self) -> None:
        pass


def paged(stream: DataFrame, key: str, content: float = 931.0, width: float = 554.0, most_early: int = 100_000) -> DataFrame:
    """(key, ord, piece, page, first_row, last_row, height): blocks put on pages as they come, as operators.paging.paged()
    does for whole documents, whatever order they come in. The stream has key, ord (from 0, without gaps) and BLOCK's
    columns; a last row of kind 'end' settles what waits. The session's state store has to be PROVIDER's.
    """
    kinds = dict(stream.dtypes)
    own = stream.select(key, F.col("ord").cast("long").alias("ord"), *NAMES)
    processor = PageProcessor(key, content, width, most_early)
    return own.groupBy(key).transformWithState(processor, f"{key} {kinds[key]}, ord long, {PIECE}", "Append", "None")


def with_store(spark: SparkSession):
    """A context in which streams that are started use PROVIDER's state store; the session's setting comes back after."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        before = spark.conf.get(PROVIDER[0], None)
        spark.conf.set(*PROVIDER)
        try:
            yield
        finally:
            spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)

    return held()
