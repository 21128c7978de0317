"""Repair of conversations' structure by weighted finite-state composition and shortest paths.

Three machines: the input acceptor is a conversation's rows in order, each one of nine symbols (see symbol()); the edit
transducer has one state and arcs Keep, Rerole, Delete and Insert with their costs; the role grammar accepts the
initials ``(s?(ua)+)?``. Their composition is never built: step() makes the arcs that leave one input position for a
vector of costs behind it, when that symbol and vector are first met, and remembers them. Positions in reverse are a
topological order. Weights are (cost, label string) in lexicographic order. Going backwards only prepends labels, which
keeps that order, and the arcs that leave one state have different labels, so the first label decides a tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quireframe.llm.common import Cut

#: Rows of a conversation that are read as one piece.
CHUNK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua"
#: The grammar's states: nothing yet, after s, after u, after a; its arcs by initial. It accepts in 0 and 3.
STATES = range(4)
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Symbol of a row that has to be deleted.
GONE = 8

Costs = tuple[int, ...]


class Arc(NamedTuple):
    """What the best path does from one grammar state at a row: labels, roles put in before it, its role ("" for its
    own, None: deleted), the state behind it and the cost."""

    labels: str
    inserted: tuple[str, ...]
    role: str | None
    state: int
    cost: int


def symbol(initial: str, bad: bool, truncated: bool) -> int:
    """The input symbol of a row: GONE if it is blank or a duplicate, else its initial (of s, u, a, others) and ending."""
    return GONE if bad else 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + truncated


def with_inserts(best: list[Arc]) -> tuple[Arc, ...]:
    """The best arcs once rows may be put in before them: relaxed along the grammar's arcs for u and a."""
    out = list(best)
    for _ in STATES:
        for q in STATES:
            for initial, role in ROLES.items():
                if (to := GRAMMAR.get((q, initial))) is not None:
                    then = out[to]
                    new = Arc("I" + then.labels, (role, *then.inserted), then.role, then.state, INSERT + then.cost)
                    if (new.cost, new.labels) < (out[q].cost, out[q].labels):
                        out[q] = new
    return tuple(out)


@lru_cache(maxsize=100_000)
def step(symbol: int, behind: Costs) -> tuple[tuple[Arc, ...], Costs, int]:
    """(arcs, costs, base): the best way from each grammar state over a row, when ``behind`` is what remains after it.

    costs are those of the arcs less their least, base, so that few different vectors ever occur.
    """
    best = []
    for q in STATES:
        ways = [Arc("D", (), None, q, DELETE + behind[q])]
        if symbol != GONE:
            kind, late = divmod(symbol, 2)
            own = GRAMMAR.get((q, INITIALS[kind])) if kind < len(INITIALS) else None
            if own is not None:
                ways.append(Arc("K", (), "", own, KEEP + TRUNCATED * late + behind[own]))
            for initial, role in ROLES.items():
                if (to := GRAMMAR.get((q, initial))) is not None:
                    ways.append(Arc("R", (), role, to, REROLE + TRUNCATED * late + behind[to]))
        best.append(min(ways, key=lambda w: (w.cost, w.labels)))
    arcs = with_inserts(best)
    base = min(arc.cost for arc in arcs)
    return arcs, tuple(min(FAR, arc.cost - base) for arc in arcs), base


#: What remains behind the last row: rows may be put in until the grammar accepts.
ENDING = with_inserts([Arc("", (), None, q, 0 if q in (0, 3) else FAR) for q in STATES])
END: Costs = tuple(arc.cost for arc in ENDING)


def backwards(symbols: list[int], behind: Costs) -> tuple[list[tuple[Arc, ...]], Costs]:
    """The best arcs at each row, and the costs before the first, from the costs behind the last."""
    base = min(behind)
    now, total = tuple(min(FAR, c - base) for c in behind), base
    out = []
    for s in reversed(symbols):
        arcs, now, base = step(s, now)
        out.append(arcs)
        total += base
    out.reverse()
    return out, tuple(min(FAR, c + total) for c in now)


def transfer(symbols: list[int]) -> list[int]:
    """The cheapest cost over a piece from each state (rows) to each state (columns), as 16 numbers."""
    columns = [backwards(symbols, tuple(0 if q == end else FAR for q in STATES))[1] for end in STATES]
    return [columns[end][q] for q in STATES for end in STATES]


def forwards(arcs: list[tuple[Arc, ...]], state: int) -> tuple[list[Arc], int]:
    """The arcs of the best path from a state, and the state behind it."""
    out = []
    for at in arcs:
        out.append(at[state])
        state = at[state].state
    return out, state


# ---- rows


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations after damage by the CRC-32 of ``conv_id:turn`` modulo 20.

    Nulls in the key, the role and the text are one space. A dropped row stays with gone = true, so that its
    conversation does; a repeated row comes twice.
    """
    own = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(own("text"), ".!?", "")).otherwise(own("text"))
    out = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(own("role")).alias("role"),
        F.when(kind != 0, text).alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("copy", "times")


def facts() -> list[Column]:
    """blank and truncated of a row's text: the set of white space is that of the contract."""
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    return [(solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("truncated")]


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """(key, rows) of sorted batches; rows with one key may come from several batches and are one list."""
    held: list[dict] = []
    last = None
    for batch in batches:
        names = batch.schema.names
        rows = (dict(zip(names, r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, own in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            own = list(own)
            if held and key == last:
                held += own
                continue
            if held:
                yield last, held
            last, held = key, own
    if held:
        yield last, held


class Summary:
    """The digest of one conversation, from its rows in order, piece by piece."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit: list[str] = []
        self.hash, self.any = sha256(), False
        self.turns, self.first, self.turn, self.initial = 0, None, None, None

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True

    def add(self, rows: list[dict], state: int, behind: Costs, last: bool) -> None:
        """rows have role, text, turn, fault (blank, duplicate, truncated or None)."""
        symbols = []
        for r in rows:
            fault, initial = r["fault"], r["role"][:1]
            if fault:
                self.counts[fault] += 1
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.counts["illegal"] += 1
            self.initial = initial
            if r["turn"] is not None and r["turn"] != self.turn:
                self.turns += 1
                self.first, self.turn = (r["turn"] if self.first is None else self.first), r["turn"]
            symbols.append(symbol(initial, fault in ("blank", "duplicate"), fault == "truncated"))
        path, state = forwards(backwards(symbols, behind)[0], state)
        for r, s, arc in zip(rows, symbols, path, strict=True):
            self.audit.append(arc.labels)
            for role in arc.inserted:
                self.put(role, "")
            if arc.role is not None:
                self.put(arc.role or r["role"], r["text"])
            done = arc.labels[-1]
            self.counts["cost"] += INSERT * len(arc.inserted) + (DELETE if done == "D" else (REROLE if done == "R" else KEEP) + TRUNCATED * (s % 2))
        if last and rows:
            self.audit.append(ENDING[state].labels)
            self.counts["cost"] += ENDING[state].cost
            for role in ENDING[state].inserted:
                self.put(role, "")

    def row(self, conv_id: int | None) -> list:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return [conv_id, gaps, *self.counts.values(), "".join(self.audit), self.hash.hexdigest()]


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def result(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of at most CHUNK rows, each read as one piece; duplicates are found on the way."""
    done = []
    for (conv_id,), rows in pieces(batches, ["conv_id"]):
        own, seen, out = [], set(), Summary()
        for r in rows:
            if r["gone"]:
                continue
            key = (r["role"], r["text"])
            r["fault"] = "blank" if r["blank"] else "duplicate" if key in seen else "truncated" if r["truncated"] else None
            seen.add(key)
            own.append(r)
        out.add(own, 0, END, True)
        done.append(out.row(conv_id))
        if len(done) == 1000:
            yield result(done)
            done = []
    if done:
        yield result(done)


# ---- long conversations, in pieces that several tasks share

PIECE = ["conv_id", "part", "chunk"]


def of_piece(rows: DataFrame, function, schema: str) -> DataFrame:
    """A function (symbols, first row) -> values over every piece of (piece, at, symbol, ...), in a task each."""
    added = StructType.fromDDL(schema)
    names, kinds = added.names, StructType([*rows.select(*PIECE).schema.fields, *added.fields])
    target = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in pieces(batches, PIECE):
            values = function([r["symbol"] for r in own], own[0])
            yield pa.RecordBatch.from_pylist([dict(zip(PIECE, key, strict=True)) | dict(zip(names, values, strict=True))], schema=target)

    return rows.repartition(*PIECE).sortWithinPartitions(*PIECE, "at").mapInArrow(run, kinds)


def joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null."""
    other = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(other, on).drop(*[f"_{k}" for k in keys])


def along(found: DataFrame, back: bool) -> DataFrame:
    """Through the pieces of each conversation, a row each: backwards with costs (column ``costs``: the transfer; adds
    ``behind``), or forwards with states (column ``exits``; adds ``entry``)."""
    added = StructType.fromDDL("behind array<long>, last boolean" if back else "entry int")
    kinds = StructType([*found.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, fresh = None, None, True
        for batch in batches:
            values = []
            for conv_id, step_of in zip(batch["conv_id"].to_pylist(), batch["costs" if back else "exits"].to_pylist(), strict=True):
                if fresh or conv_id != conv:
                    conv, fresh, now, last = conv_id, False, list(END) if back else 0, True
                values.append((now, last))
                last = False
                now = [min(FAR, *(step_of[4 * q + end] + now[end] for end in STATES)) for q in STATES] if back else step_of[now]
            columns = [pa.array([v[0] for v in values], pa.list_(pa.int64()) if back else pa.int32())] + [pa.array([v[1] for v in values])] * back
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    order = [F.col(c).desc() if back else F.col(c) for c in ("part", "chunk")]
    return found.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, kinds)


def long_ones(rows: DataFrame, cut: Cut) -> DataFrame:
    """The result rows of conversations with many rows: (conv_id, turn, role, text, blank, truncated) of them.

    Rows are sorted in ranges, so that the conversation lies in many partitions, and a piece is up to CHUNK rows of one.
    Each piece gives the costs from state to state; going back along a conversation's pieces gives the costs behind
    each, with which a piece knows its best arcs, and so the state behind it for each before it; going along them gives
    the state that each begins in. Only the last pass, which writes the text and its digest, reads all of a
    conversation in one task, as a stream that holds a piece: a SHA-256 goes from one block to the next.
    """
    keys = ["conv_id", "turn", "role", "text"]
    run = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    run = run.withColumns({"part": F.shiftright("at", 33), "chunk": F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / CHUNK)})
    run = cut(run.withColumn("digest", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "rows")
    first = run.groupBy("conv_id", "digest").agg(F.min("at").alias("first"))
    light = run.select(*PIECE, "at", "digest", F.substring("role", 1, 1).alias("initial"), "blank", "truncated")
    light = joined(light, first, ["conv_id", "digest"])
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated")
    light = light.withColumn("fault", fault)
    kind = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in INITIALS]), F.col("initial")), F.lit(0))
    number = 2 * F.when(kind > 0, kind - 1).otherwise(3) + (F.coalesce("fault", F.lit("")) == "truncated").cast("int")
    light = light.withColumn("symbol", F.when(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), GONE).otherwise(number).cast("int"))
    light = cut(light.select(*PIECE, "at", "fault", "symbol"), "light")
    costs = of_piece(light, lambda symbols, _: [transfer(symbols)], "costs array<long>")
    behind = cut(along(costs, True).drop("costs"), "behind")

    def exits(symbols: list[int], row: dict) -> list:
        arcs = backwards(symbols, tuple(row["behind"]))[0]
        return [[forwards(arcs, q)[1] for q in STATES], row["behind"], row["last"]]

    out = of_piece(joined(light, behind, PIECE), exits, "exits array<int>, behind array<long>, last boolean")
    entries = along(out, False).drop("exits")
    known = joined(light, entries, PIECE).select(F.col("at").alias("of"), "fault", "behind", "last", "entry")
    rows = run.join(known, F.col("at") == F.col("of")).select("conv_id", "turn", "role", "text", "at", "part", "chunk", "fault", "behind", "last", "entry")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None
        for (conv_id, *_), own in pieces(batches, PIECE):
            if out is None or conv_id != now:
                if out is not None:
                    yield result([out.row(now)])
                now, out = conv_id, Summary()
            out.add(own, own[0]["entry"], tuple(own[0]["behind"]), own[0]["last"])
        if out is not None:
            yield result([out.row(now)])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(write, RESULT)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conv_id.

    The table is damaged first (see damaged()); a conversation's rows then go by turn (nulls first; equal turns by role
    and text). audit has the labels of the cheapest edits that give roles ``(s?(ua)+)?``, the ASCII-least of them in a
    tie, and repaired_sha256 is the digest of the repaired ``role:text`` lines.

    A conversation of up to CHUNK rows is one piece of a task that reads sorted rows; longer ones, one of which may hold
    most rows, are cut into pieces (see long_ones()).

    Null roles and texts are one space, null ids are a conversation like others, null turns count for no gap. A role
    with another initial than s, u or a (or none) can only be deleted or changed. Conversations that lose all rows have
    zeros, an empty audit and the digest of nothing. Repeated rows are duplicates. Other columns are left out. An empty
    table gives no rows.
    """
    cut = Cut(conversations.sparkSession)
    rows = damaged(conversations)
    sizes = rows.where("NOT gone").groupBy("conv_id").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > CHUNK).select(F.col("conv_id").alias("large")), "large")
    rows = rows.select("conv_id", "turn", "role", "text", "gone", *facts())
    few = rows
    same = F.col("conv_id").eqNullSafe(F.col("large"))
    any_large = bool(large.take(1))
    if any_large:
        few = rows.join(large, same, "left_anti")
    few = few.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(short, RESULT)
    if not any_large:
        return few
    many = rows.join(large, same, "left_semi").where("NOT gone").drop("gone")
    return few.unionByName(long_ones(many, cut))
