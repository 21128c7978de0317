"""Streams of revisions and of ordered pieces: newest rows, and folds in sequence."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quireframe.operators import revisions


def newest(stream: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The newest row of each key so far, for update or complete output; Spark keeps one row a key as state."""
    return revisions.newest(stream, keys, revision)


def fold_in_order(stream: DataFrame, key: str, sequence: str, columns: list[str], start: object, step: Callable, out_schema: str, most_waiting: int = 100_000) -> DataFrame:
    """Rows of a key folded in the order of their sequence numbers 0, 1, 2 and so on, whatever order they come in.

    step(state, values) gives (state, output values) for each row; state is what JSON can hold, at first ``start``. Rows
    that come before their turn wait in the state, at most ``most_waiting`` of a key, beyond which the stream fails;
    numbers that were there already are stale and passed over. The output has key, sequence and out_schema's columns.
    """
    names = [key, sequence, *(x.split()[0] for x in out_schema.split(", "))]
    kinds = dict(stream.dtypes)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, now, waiting = (0, start, {}) if not state.exists else (lambda s: (s[0], json.loads(s[1]), {int(k): v for k, v in json.loads(s[2]).items()}))(state.get)
        for batch in batches:
            for row in batch[[sequence, *columns]].itertuples(index=False):
                if row[0] >= upto:
                    waiting.setdefault(int(row[0]), [v.item() if hasattr(v, "item") else v for v in row[1:]])
        rows = []
        while upto in waiting:
            now, out = step(now, waiting.pop(upto))
            rows.append((group[0], upto, *out))
            upto += 1
        if len(waiting) > most_waiting:
            raise RuntimeError(f"{len(waiting)} rows of {group[0]!r} wait for number {upto}")
        state.update((upto, json.dumps(now), json.dumps(waiting)))
        yield pd.DataFrame(rows, columns=names, dtype=object)

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {sequence} long, {out_schema}", "upto long, now string, waiting string", "append", GroupStateTimeout.NoTimeout
    )


def paginate(stream: DataFrame, key: str = "doc_id", sequence: str = "ord", height: str = "height", page_height: float = 931.0) -> DataFrame:
    """(key, sequence, page): blocks put on pages as they come, as documents.pages() does for whole documents."""

    def step(state: list, values: list) -> tuple[list, tuple]:
        page, used = state
        page, used = (page + 1, values[0]) if used and used + values[0] > page_height else (page, used + values[0])
        return [page, used], (page,)

    return fold_in_order(stream, key, sequence, [height], [0, 0.0], step, "page int")


def outline(stream: DataFrame, key: str, sequence: str = "ord") -> DataFrame:
    """(key, sequence, id, parent_id) of headings (key, sequence, level, id) as they come, as documents.outline() does for whole documents."""

    def step(state: list, values: list) -> tuple[list, tuple]:
        level, own = values
        open_ = [x for x in state if x[0] < level]  # each is deeper than the one before
        return [*open_, [level, own]], (own, open_[-1][1] if open_ else None)

    return fold_in_order(stream, key, sequence, ["level", "id"], [], step, "id long, parent_id long")


def progress(stream: DataFrame, name: str = "progress") -> DataFrame:
    """The stream with metrics that a StreamingQueryListener sees: rows, and the largest revision if there is one."""
    more = [F.max("revision").alias("revision")] if "revision" in stream.columns else []
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *more)
