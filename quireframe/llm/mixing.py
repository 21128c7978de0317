"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.llm.common import Cut

ROWS_OF_PARTITION = 33  # bits of monotonically_increasing_id() below the partition's number
NO_SOURCE = "\0"  # stands for null
#: Rows up to which a small table of the schedule is broadcast; beyond, it is joined by key.
MOST_BROADCAST = 1_000_000


def ranks(rows: DataFrame, cut: Cut) -> DataFrame:
    """rows (row, source, key) with rank: the row's place (from 0) in its source by its key.

    A source may hold most rows, so no task gets a whole one: rows are range-partitioned by source and key, numbered
    inside their partition, and each partition's part of a source starts where the parts before it end.
    """
    placed = rows.repartitionByRange("source", "key").sortWithinPartitions("source", "key")
    placed = cut(placed.drop("key").withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("at", ROWS_OF_PARTITION))
    parts = placed.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # One row for each partition and each source at most.
    found = placed.join(F.broadcast(cut(starts, "starts")), ["source", "part"])
    return found.select("row", "source", (F.col("at") + F.col("shift")).alias("rank"))


def whole_parts(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The weights as whole numbers in exactly the same proportions, without a common divisor; zeros are left out.

    Floats count as the decimal numbers that they are written as. Negative, infinite and NaN weights raise ValueError.
    """
    exact = {}
    for source, weight in weights.items():
        try:
            exact[source] = Fraction(str(weight))
        except ValueError as error:
            raise ValueError(f"weight {weight} of source {source!r}") from error
        if exact[source] < 0:
            raise ValueError(f"weight {weight} of source {source!r}")
    scale = lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * scale) for s, w in exact.items() if w}
    divisor = gcd(*parts.values())
    return {s: n // divisor for s, n in parts.items()}


def tempered(docs: DataFrame, source: str = "source", exponent: float = 0.5, parts: int = 1000) -> dict[str | None, int]:
    """Target weights by source: the rows' number to the power ``exponent``, in whole parts of about ``parts``, 1 at least."""
    rows = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n")).collect()  # one for each source
    total = sum(r.n**exponent for r in rows)
    return {r.source: max(1, round(parts * r.n**exponent / total)) for r in rows}


def earliest_deadline_first(parts: str, length: str) -> Column:
    """array<int>: for each slot of a period, the place in ``parts`` (array<struct<source, parts>>) of the source whose block runs.

    Source i has p of the period's L slots. Its block j is released at floor(j L / p) and due by ceil((j + 1) L / p),
    as p / L is its target weight. In each slot the released block with the earliest deadline runs (the first source
    of equal ones). All due times are met, so after every slot each source is less than a block from its target; at
    the period's end all are on it, and the next period is the same again. Slots are worked out in stretches, so that
    no long array is copied for each of them.
    """
    due = f"((s.given[i] + 1) * {length} + p.parts - 1) div p.parts"
    ready = f"s.given[i] < p.parts AND s.given[i] * {length} div p.parts <= t"
    pick = f"array_min(filter(transform({parts}, (p, i) -> IF({ready}, named_struct('due', {due}, 'i', i), NULL)), x -> x IS NOT NULL)).i"
    step = f"transform(array({pick}), k -> named_struct('given', transform(s.given, (g, i) -> IF(i = k, g + 1, g)), 'out', concat(s.out, array(k))))[0]"
    stretch = f"CAST(ceil(sqrt({length})) AS BIGINT)"
    inner = f"aggregate(sequence(a, least(a + {stretch}, {length}) - 1), named_struct('given', o.given, 'out', CAST(array() AS ARRAY<INT>)), (s, t) -> {step})"
    outer = f"transform(array({inner}), x -> named_struct('given', x.given, 'out', concat(o.out, array(x.out))))[0]"
    first = f"named_struct('given', transform({parts}, p -> 0L), 'out', CAST(array() AS ARRAY<ARRAY<INT>>))"
    return F.expr(f"aggregate(sequence(0L, {length} - 1, {stretch}), {first}, (o, a) -> {outer}, o -> flatten(o.out))")


def period(targets: DataFrame) -> DataFrame:
    """(source, nth, slot): the slot of the period in which each source's nth block of it runs, from (tier, source, parts).

    Each tier has a period of its own, as many slots as its parts sum up to, worked out in one row of nested
    functions: its size is that of the weights, whatever the tables have.
    """
    one = targets.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("source", "parts"))).alias("p"), F.sum("parts").alias("length"))
    slots = one.select("tier", "p", F.posexplode(earliest_deadline_first("p", "length")).alias("slot", "i"))
    nth = F.row_number().over(Window.partitionBy("tier", "i").orderBy("slot")) - 1
    return slots.select(F.expr("p[i].source").alias("source"), nth.cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", order: tuple[str, ...] = ("doc_id",), block_rows: int = 16) -> DataFrame:
    """All rows with mix_slot (long) and mix_offset (int): the order in which sources interleave to target weights.

    Rows of a source, by ``order``, form blocks of ``block_rows`` (the last may be shorter); mix_offset counts the rows
    in a block. Each block runs in a slot of its own, see earliest_deadline_first(): with the source's target weight
    w, after any number t of slots the source has had more than w t - 1 and less than w t + 1 blocks. The bound holds
    for the exact weights over the whole run. A source that has no more blocks leaves its slots empty, so mix_slot has
    gaps there and the others keep their places and proportions. No row is dropped or repeated.

    weights maps sources (None: null sources) to relative weights, see whole_parts(); without them they are tempered().
    Sources without a weight, or with zero, come after all others have ended, in equal shares. Null sources are one
    source of their own; null keys sort first; rows equal in ``order`` come in the order of all their columns' hash.
    Any number of sources will do; the schedule has as many slots as the weights have parts. An empty table gives no
    rows. Texts of any length, empty and null ones are carried as they are. Existing columns mix_slot and mix_offset
    are replaced; no other column's name clashes.
    """
    spark, cut = docs.sparkSession, Cut(docs.sparkSession)
    docs = docs.drop("mix_slot", "mix_offset")
    parts = whole_parts(tempered(docs, source) if weights is None else weights)
    given = json.dumps([{"source": NO_SOURCE if s is None else str(s), "parts": n} for s, n in parts.items()])
    given = spark.range(1).select(F.inline(F.from_json(F.lit(given), "array<struct<source string, parts long>>")))
    ties = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    name = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source")
    rows = docs.select(F.struct(*docs.columns).alias("row"), name, F.struct(*order, ties.alias("ties")).alias("key"))  # so no column of docs clashes
    counts = docs.groupBy(name).agg(F.count("*").alias("rows"))
    targets = counts.join(given, "source", "full").select("source", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("parts", F.lit(1)).alias("parts"), F.col("parts").isNull().cast("int").alias("tier"))
    targets = cut(targets, "targets")
    tiers = {r.tier: r for r in targets.groupBy("tier").agg(F.count("*").alias("sources"), F.sum("parts").alias("length")).collect()}
    length = F.lit(0).cast("long")
    for tier, r in tiers.items():
        length = F.when(F.col("tier") == tier, r.length).otherwise(length)
    rounds = F.ceil(F.ceil(F.col("rows") / block_rows) / F.col("parts"))
    weighted = targets.where("tier = 0").agg(F.max(rounds * length)).first()[0] or 0  # slots of the sources with a weight
    plan = _small(cut(period(targets), "plan"), sum(r.length for r in tiers.values()))
    targets = targets.select("source", "parts", length.alias("length"), F.when(F.col("tier") == 1, weighted).otherwise(0).cast("long").alias("base"))
    block = F.floor(F.col("rank") / block_rows)
    found = ranks(rows, cut).join(_small(targets, sum(r.sources for r in tiers.values())), "source")
    found = found.withColumn("nth", block % F.col("parts")).join(plan, ["source", "nth"])
    slot = F.col("base") + F.floor(block / F.col("parts")) * F.col("length") + F.col("slot")
    return found.select("row.*", slot.cast("long").alias("mix_slot"), (F.col("rank") % block_rows).cast("int").alias("mix_offset"))


def in_mixed_order(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, written in the order of mix(): each partition holds a stretch of it, in order.

    All rows and columns come out as they went in, with null, empty, very long and repeated ones, in the order that
    mix() defines for them; an empty table stays one.
    """
    mixed = mix(docs, **settings)
    return mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset").select(*docs.columns)
