"""Trees and chains: values carried up parent links by doubling, groups inside groups, nested sets of headings, edit chains."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.operators.lineage import cut

LEVELS = range(9)


def up_to_roots(nodes: DataFrame, keys: list[str], node: str, parent: str, values: list[str], compose: Callable[[dict[str, Column], dict[str, Column]], dict[str, Column]]) -> DataFrame:
    """nodes with ``values`` composed along the chain of parents up to the root, and cyclic: does the chain never end?

    compose(own, above) gives the value of a way from those of its lower and its upper part; it has to be associative.
    Every node points at its parent first; a round composes its value with that of the node it points at and then
    points where that one did, so n rounds follow 2^n links, whatever the depth. A parent that is not there ends the
    chain. In a tree of m nodes a chain that goes on after log2(m) rounds never ends: those nodes lie on a cycle or lead
    to one, and their values mean nothing. Nodes are unique by keys and node.
    """
    known = nodes.select(*keys, F.col(node).alias("_known"))
    own = nodes.select(*keys, node, F.col(parent).alias("_at"), *values)
    same = [own[k] == known[k] for k in keys]
    now = cut(own.join(known, [*same, F.col("_at") == F.col("_known")], "left").select(*[own[k] for k in keys], node, F.col("_known").alias("_at"), *values))
    most = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most)) + 1):
        if not now.where("_at IS NOT NULL").take(1):
            break
        up = now.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(node).alias("_node"), F.col("_at").alias("_next"), *[F.col(v).alias(f"_{v}") for v in values])
        step = now.join(up, [*(F.col(k) == F.col(f"_{k}") for k in keys), F.col("_at") == F.col("_node")], "left")
        whole = compose({v: F.col(v) for v in values}, {v: F.col(f"_{v}") for v in values})
        now = cut(step.select(*keys, node, F.col("_next").alias("_at"), *[F.when(F.col("_at").isNull(), F.col(v)).otherwise(whole[v]).alias(v) for v in values]))
    return now.select(*keys, node, *values, F.col("_at").isNotNull().alias("cyclic"))


AFFINE = ["scale_x", "scale_y", "move_x", "move_y"]


def group_maps(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, scale_x, scale_y, move_x, move_y, cyclic): the map from a group's child coordinates to the slide's.

    groups (keys, node, parent, x, y, width, height, child_x, child_y, child_width, child_height) may lie in each other to
    any depth; a child size of 0 or null means no scaling. The map is x * scale + move, and maps are composed up the tree.
    """
    scale = lambda side: F.when(F.coalesce(F.col(f"child_{side}"), F.lit(0.0)) != 0, F.col(side) / F.col(f"child_{side}")).otherwise(1.0)
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own = groups.withColumns({"scale_x": scale("width"), "scale_y": scale("height")})
    own = own.withColumns({"move_x": none("x") - none("child_x") * F.col("scale_x"), "move_y": none("y") - none("child_y") * F.col("scale_y")})

    def compose(low: dict[str, Column], high: dict[str, Column]) -> dict[str, Column]:
        out = {f"scale_{a}": low[f"scale_{a}"] * high[f"scale_{a}"] for a in "xy"}
        return out | {f"move_{a}": low[f"move_{a}"] * high[f"scale_{a}"] + high[f"move_{a}"] for a in "xy"}

    return up_to_roots(own, keys, "node", "parent", AFFINE, compose)


def flattened(elements: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """elements (keys, parent, x, y, width, height and more) in the slide's coordinates; an element without a group stays.

    Elements of groups on a cycle have null coordinates.
    """
    maps = group_maps(groups, keys).withColumnRenamed("node", "parent")
    joined = elements.join(maps, [*keys, "parent"], "left")
    at = lambda c, a: F.when(F.col("cyclic"), None).otherwise(F.col(c) * F.coalesce(f"scale_{a}", F.lit(1.0)) + F.coalesce(f"move_{a}", F.lit(0.0)))
    size = lambda c, a: F.when(F.col("cyclic"), None).otherwise(F.col(c) * F.coalesce(f"scale_{a}", F.lit(1.0)))
    placed = {"x": at("x", "x"), "y": at("y", "y"), "width": size("width", "x"), "height": size("height", "y")}
    return joined.withColumns(placed).drop(*AFFINE, "cyclic").select(*elements.columns)


def chains(links: DataFrame, starts: DataFrame, key: str, node: str, previous: str) -> DataFrame:
    """(key, node, depth, times): the nodes that a key's start leads to, with the links up to there.

    links (key, node, previous; null or 0: none), starts (key, node). What is reached doubles with every round: from all
    nodes within 2^n - 1 links the jump of 2^n leads on, and jumps are joined with themselves. A node is reached once,
    and more than once (times) only on a cycle, after as many rounds as the largest key's links can need.
    """
    jump = links.where(F.coalesce(F.col(previous), F.lit(0)) != 0).select(key, node, F.col(previous).alias("_at"))
    reached = starts.select(key, node, F.lit(0).cast("long").alias("depth"))
    most = links.groupBy(key).count().agg(F.max("count")).first()[0] or 1
    for n in range(math.ceil(math.log2(most)) + 1):
        jump = cut(jump)
        on = reached.join(jump, [key, node]).select(key, F.col("_at").alias(node), (F.col("depth") + (1 << n)).alias("depth"))
        reached = cut(reached.unionByName(on))
        if not jump.take(1):
            break
        jump = jump.join(jump.select(key, F.col(node).alias("_at"), F.col("_at").alias("_next")), [key, "_at"]).select(key, node, F.col("_next").alias("_at"))
    return reached.groupBy(key, node).agg(F.min("depth").alias("depth"), F.count("*").alias("times"))


def edit_chain(edits: DataFrame, entries: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, persist_id, offset, edit_id, error): the newest entry of each object along a file's chain of edits.

    edits (key, edit_id, previous, encrypted), entries (key, edit_id, persist_id, offset), current (key, edit_id): the
    newest edit, where the chain begins. A file has one row with an error instead where its chain comes back to itself
    ('cycle'), has an encrypted edit ('encrypted') or leads to an edit that is not there ('missing').
    """
    walked = chains(edits, current, key, "edit_id", "previous").join(edits.select(key, "edit_id", F.coalesce("encrypted", F.lit(False)).alias("locked")), [key, "edit_id"], "left")
    has = lambda c: F.max(c.cast("int")) == 1
    marks = walked.groupBy(key).agg(has(F.col("times") > 1).alias("_c"), has(F.coalesce("locked", F.lit(False))).alias("_e"), has(F.col("locked").isNull()).alias("_m"))
    wrong = marks.select(key, F.when(F.col("_c"), "cycle").when(F.col("_e"), "encrypted").when(F.col("_m"), "missing").alias("error"))
    best = entries.join(walked.select(key, "edit_id", "depth"), [key, "edit_id"]).groupBy(key, "persist_id").agg(F.min_by(F.struct("offset", "edit_id"), F.struct("depth", "offset")).alias("e"))
    good = best.join(wrong.where("error IS NULL"), key, "left_semi").select(key, "persist_id", "e.offset", "e.edit_id", F.lit(None).cast("string").alias("error"))
    return good.unionByName(wrong.where("error IS NOT NULL"), allowMissingColumns=True).select(key, "persist_id", "offset", "edit_id", "error")


def nested_sets(items: DataFrame, key: str, order: str = "ord", level: str = "level", node: str = "id") -> DataFrame:
    """items with enter, leave, depth (roots: 1) and ancestors (from the root down): a heading holds those whose enter
    lies in (enter, leave].

    Headings in order are a tree in preorder: a heading ends before the next of its level or a higher one. Levels are 0
    to 8. The last heading of each level so far and the next one are running values, so one sort a document does it.
    """
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = items.withColumn("enter", F.row_number().over(w).cast("long"))
    own = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    next_ = [F.min(F.when(F.col(level) <= n, F.col("enter"))).over(after).alias(f"_next{n}") for n in LEVELS]
    last = [F.max(F.when(F.col(level) <= n, F.struct("enter", node))).over(before).alias(f"_last{n}") for n in LEVELS]
    marked = own.select("*", *next_, *last)
    end = F.lit(None).cast("long")
    for n in LEVELS:
        end = F.when(F.col(level) == n, F.col(f"_next{n}")).otherwise(end)
    lasts = F.array(*[F.when(F.col(level) > n, F.col(f"_last{n}")) for n in LEVELS])
    open_ = F.array_sort(F.array_distinct(F.filter(lasts, lambda s: s.isNotNull())))
    return marked.select(*items.columns, "enter", (F.coalesce(end, F.col("_n") + 1) - 1).alias("leave"), (F.size(open_) + 1).alias("depth"), F.transform(open_, lambda s: s[node]).alias("ancestors"))


def subtrees(nested: DataFrame, asked: DataFrame, key: str, max_depth: int | None = None) -> DataFrame:
    """(key, asked, id, level_below, is_leaf) of all headings below the asked ones (key, asked) down to max_depth levels.

    An interval condition inside a document; what is asked are a few headings of each.
    """
    named = nested.select(key, F.col("id").alias("asked"), F.col("enter").alias("_a"), F.col("leave").alias("_b"), F.col("depth").alias("_d"))
    top = named.join(asked, [key, "asked"])
    below = nested.join(top, key).where("enter > _a AND enter <= _b").withColumn("level_below", F.col("depth") - F.col("_d"))
    out = below if max_depth is None else below.where(F.col("level_below") <= max_depth)
    return out.select(key, "asked", "id", "level_below", (F.col("enter") == F.col("leave")).alias("is_leaf"))


def top_levels(nested: DataFrame, key: str, max_depth: int) -> DataFrame:
    """(key, id, depth, children): the headings down to a depth, with the number of their direct children."""
    parents = nested.select(key, F.try_element_at("ancestors", F.lit(-1)).alias("id")).where("id IS NOT NULL").groupBy(key, "id").agg(F.count("*").alias("children"))
    return nested.where(F.col("depth") <= max_depth).join(parents, [key, "id"], "left").select(key, "id", "depth", F.coalesce("children", F.lit(0)).cast("long").alias("children"))
